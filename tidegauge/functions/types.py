"""Result types of the Arrow functions."""

from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

VECTOR = ArrayType(DoubleType())


def vectors_struct(*names: str) -> StructType:
    return StructType([StructField(n, VECTOR) for n in names])


def once(udf):
    """Keep the optimiser from copying a costly function into inferred filters."""
    return udf.asNondeterministic()
