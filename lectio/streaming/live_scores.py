"""Scores of predictions as they arrive: a file stream into the same scoring plan, a batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lectio.plans.score import score
from lectio.sources.documents import MARKS

SCHEMA = f"doc_id string, gt_text string, pred_text string, gt_marks {MARKS}, pred_marks {MARKS}"


def arriving(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Pairs from JSON lines files that appear under path."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def score_stream(pairs: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Write each batch's scores under out/batch=<id>; a batch that is run again replaces its own folder, so each counts once."""

    def write(batch: DataFrame, number: int) -> None:
        score(batch).drop("alignment").write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
