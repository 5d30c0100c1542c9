"""Features that repeat other features."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame


def correlated_features(wide: DataFrame, columns: list[str], threshold: float = 0.95) -> DataFrame:
    """Columns whose absolute Pearson correlation with an earlier column exceeds the threshold.

    The correlation matrix is computed by Spark; only its columns-by-columns
    result, whose size does not depend on the rows, reaches the driver.
    """
    vec = VectorAssembler(inputCols=columns, outputCol="_v", handleInvalid="error").transform(wide)
    matrix = Correlation.corr(vec.select("_v"), "_v").first()[0].toArray()
    drop = [
        (c,) for j, c in enumerate(columns)
        if any(abs(matrix[i, j]) > threshold for i in range(j))
    ]
    return wide.sparkSession.createDataFrame(drop, "feature string")
