"""Recognition over a stream of payload files.

Payloads that were sent twice are told by their content, as keyed state that a watermark on the
time of the file bounds. Registries are written once, bucketed by the keys of the joins, so that a micro-batch
moves only its own rows. Beyond that a payload has nothing to do with any other, and each micro-batch is a batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirelight.operators.rows import forget
from quirelight.plans.recognize import known_facts, recognized
from quirelight.sources.registries import prepare
from quirelight.sources.requests import to_result_json


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Payload files that arrive in a folder (.json, .json.gz), one request each."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).schema("value string").load(path)
    return files.select(F.xxhash64(F.col("_metadata.file_path")).alias("doc_id"), F.col("value").alias("body"), F.col("_metadata.file_modification_time").alias("sent"))


def sent_once(payloads: DataFrame, within: str = "1 hour") -> DataFrame:
    """The first of payloads (doc_id, body, sent) with equal bodies that were sent ``within`` a time of each other.
    State holds a hash of each body for that time."""
    keyed = payloads.withWatermark("sent", within).withColumn("body_key", F.sha2(F.coalesce("body", F.lit("")), 256))
    return keyed.dropDuplicatesWithinWatermark(["body_key"]).select("doc_id", "body")


def recognize_stream(payloads: DataFrame, registry: DataFrame, journals: DataFrame, words: DataFrame, out: str, checkpoint: str, once: bool = False, buckets: int | None = None) -> StreamingQuery:
    """Writes ``doc_id, result`` (JSON) as Parquet, a folder per batch; a batch that is run again
    overwrites its own folder, so that each payload is written once. Registries are prepared when the stream
    starts, in as many ``buckets`` as a shuffle has partitions unless told otherwise."""
    spark = payloads.sparkSession
    prepared = prepare(registry, journals, words, buckets or int(spark.conf.get("spark.sql.shuffle.partitions")))

    def write(batch: DataFrame, number: int) -> None:
        known = known_facts(batch, prepared.registered, prepared.hashed)
        to_result_json(recognized(known, prepared)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        forget(known)

    writer = sent_once(payloads).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
