"""pvlens: Spark-native pipeline for drug / vaccine safety report analytics.

Every operator is a lazy ``DataFrame -> DataFrame`` (or ``Column -> Column``)
built from Spark SQL functions, joins, aggregates and windows.
"""

from pvlens.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
