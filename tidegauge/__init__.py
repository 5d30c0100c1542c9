"""Time-series preparation, description and scoring as Spark DataFrame jobs.

The unit of work is the long table ``series(dataset, series_id, idx, ts, y)``.
"""
__version__ = "0.1.0"
