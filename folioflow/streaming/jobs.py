"""Incremental runs: every job reads new files only and can be stopped and resumed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioflow.functions.text import words
from folioflow.operators import memo
from folioflow.operators.segments import scan
from folioflow.plans import translate as plan
from folioflow.session import few_stores, materialize


def document_stream(spark: SparkSession, folder: str, pattern: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Documents as they arrive; the trigger size is the throttle.

    ``pattern`` names the files of the folder, or a folder in it whose files are the table.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    table = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    if table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isDirectory(table):
        return reader.parquet(f"{folder}/{pattern}")
    return reader.option("pathGlobFilter", pattern).parquet(folder)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything that is new, append it, and stop."""
    _start_available(stream, path, checkpoint).awaitTermination()


def _start_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    with few_stores(stream.sparkSession):
        return (
            stream.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start(path)
        )


def run_tail(stream: DataFrame, path: str, checkpoint: str) -> None:
    """One trigger over what a source without ``availableNow`` holds at the moment."""
    (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(once=True)
        .start(path)
        .awaitTermination()
    )


def run_until(stream: DataFrame, path: str, checkpoint: str, stop_requested: Callable[[StreamingQuery], bool], poll_seconds: float = 0.05) -> bool:
    """Like ``run_available``, but ends early once ``stop_requested`` says so; returns whether everything was processed.

    A micro-batch that the stop interrupts leaves nothing visible, since the sink
    lists a batch's files when it is complete, and is worked on again by the next run.
    """
    query = _start_available(stream, path, checkpoint)
    while not query.awaitTermination(poll_seconds):
        if stop_requested(query):
            query.stop()
            return False
    return True


def segment_stream(documents: DataFrame) -> DataFrame:
    return scan(documents)


def token_stream(documents: DataFrame, ends: bool = False) -> DataFrame:
    """Answer tokens of a streaming service: request_id, pos, token, and with ``ends`` the end mark as ``last``."""
    told = documents.select(F.col("doc_id").alias("request_id"), words(F.col("text")).alias("_words"))
    tokens = told.select("request_id", F.posexplode("_words").alias("pos", "token"), F.size("_words").alias("_size"))
    return tokens.withColumn("last", F.col("pos") == F.col("_size") - 1).drop("_size") if ends else tokens.drop("_size")


def concat_tokens(tokens: DataFrame, sep: str) -> DataFrame:
    """Join the tokens of every request in order; a request's answer is one text."""
    pieces = F.array_sort(F.collect_list(F.struct("pos", "token")))
    return tokens.groupBy("request_id").agg(
        F.array_join(F.transform(pieces, lambda p: p["token"]), sep).alias("text")
    )


def memo_writer(memo_path: str, source_lang: str, target_lang: str, writer: str):
    """A foreachBatch function that maps unfinished texts and appends them to the memo.

    The rows of a micro-batch go to a folder named after ``writer`` and the batch
    and replace what an interrupted attempt left there, so a replayed batch is
    written once and no other stream's rows are touched.
    """

    def write(documents: DataFrame, batch: int) -> None:
        spark = documents.sparkSession
        run = f"{writer}-{batch}"
        asked = materialize(plan.distinct_segments(documents, source_lang, target_lang), "asked")
        work = memo.misses(asked, memo.rows_for(asked, memo_path, but=run))
        memo.append(plan.mock_results(work, source_lang, target_lang), memo_path, run)
        memo.compact_runs(spark, memo_path)

    return write


def run_memo(stream: DataFrame, memo_path: str, checkpoint: str, source_lang: str, target_lang: str) -> None:
    (
        stream.writeStream.foreachBatch(
            memo_writer(memo_path, source_lang, target_lang, hashlib.sha256(checkpoint.encode()).hexdigest()[:16]))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
