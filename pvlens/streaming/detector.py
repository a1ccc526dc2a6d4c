"""ST1: the batch detector on a stream.

The original calls its batch loop "real-time"; here the same stateless B1/B2
projection runs unchanged on ``readStream``. No state, watermark or window is
needed (the original has none), so any sink works and a restarted query
resumes exactly-once from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pvlens.operators import batch as B


def detect(stream: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """The flat result table (B2) of every incoming text."""
    return B.result_table(B.analyze(stream, text_col, keys=keys), keys=keys)


def stream_results(spark: SparkSession, source_dir: str, schema: T.StructType, text_col: str,
                   keys: list[str], sink_dir: str, checkpoint: str) -> DataFrame:
    """ST1: the stateless B1/B2 projection over a file stream; runs what is
    there now (``availableNow``) and returns the sink as a table. Progress
    lives in ``checkpoint``, so a restarted query resumes exactly-once."""
    stream = spark.readStream.schema(schema).parquet(source_dir)
    table = detect(stream, text_col, keys)
    q = (table.writeStream.format("parquet").option("checkpointLocation", checkpoint)
              .trigger(availableNow=True).start(sink_dir))
    q.awaitTermination()
    return spark.read.parquet(sink_dir)
