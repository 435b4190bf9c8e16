"""Task states: release by dependencies, failure handling, queues, usage totals."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions.services import is_auth, is_lasting, retry_delay
from folioflow.session import work_path


def release_ready(tasks: DataFrame, needs: DataFrame, finished: DataFrame) -> DataFrame:
    """Queued tasks whose dependencies have all finished become PENDING.

    ``needs`` has (task_id, needed_id). Only open dependencies are counted, so
    a task that many others wait for is dropped from the join once finished.
    """
    open_needs = needs.join(finished.select(F.col("task_id").alias("needed_id")), "needed_id", "left_anti")
    waiting = open_needs.groupBy("task_id").agg(F.count("*").alias("open_needs"))
    state = F.when((F.col("state") == "QUEUED") & F.col("open_needs").isNull(), "PENDING")
    return tasks.join(waiting, "task_id", "left").withColumn(
        "state", F.coalesce(state, F.col("state"))
    ).withColumn("open_needs", F.coalesce("open_needs", F.lit(0)))


def after_failure(tasks: DataFrame, failed: Column) -> DataFrame:
    """A failed task retries up to the limit, then stays failed."""
    retry = failed & (F.col("retries") < K.MAX_TASK_RETRIES)
    return tasks.withColumn(
        "state", F.when(retry, "RETRYING").when(failed, "FAILED").otherwise(F.col("state"))
    ).withColumn("retries", F.col("retries") + retry.cast("int"))


def levels(needs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Topological level of every task: 0 without dependencies, else 1 + the deepest.

    Each round releases the tasks whose dependencies are all placed. The state
    is written to the shared folder between rounds, which cuts the lineage and
    survives lost executors. Tasks on a cycle never get a level.
    """
    spark = tasks.sparkSession
    path = work_path(spark, "task-levels")
    waiting = tasks.select("task_id").join(needs.select("task_id").distinct(), "task_id", "left_anti")
    waiting.withColumn("level", F.lit(0)).write.parquet(f"{path}/0")
    schema = spark.read.parquet(f"{path}/0").schema
    for level in itertools.count(1):
        placed = spark.read.schema(schema).parquet(*[f"{path}/{n}" for n in range(level)])
        open_needs = needs.join(
            placed.select(F.col("task_id").alias("needed_id")), "needed_id", "left_anti"
        ).select("task_id").distinct()
        ready = (
            needs.select("task_id").distinct()
            .join(placed, "task_id", "left_anti")
            .join(open_needs, "task_id", "left_anti")
        )
        ready.withColumn("level", F.lit(level)).write.parquet(f"{path}/{level}")
        if spark.read.schema(schema).parquet(f"{path}/{level}").isEmpty():
            break
    return spark.read.schema(schema).parquet(*[f"{path}/{n}" for n in range(level + 1)])


def usage(log: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of a batch log: tokens, cost, outcomes, retries."""
    return log.groupBy(*keys).agg(
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.sum("cost").alias("estimated_cost"),
        F.count_if("ok").alias("successful_chunks"),
        F.count_if(~F.col("ok")).alias("failed_chunks"),
        F.sum("retries").alias("retries"),
    )


def session_status(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Completed and failed chunks of a session: a completion clears earlier failures."""
    return marks.groupBy(*keys, "chunk_id").agg(
        F.bool_or(F.col("mark") == "completed").alias("completed")
    ).withColumn("state", F.when(F.col("completed"), "completed").otherwise("failed")).drop("completed")


def key_states(failures: DataFrame, now: Column) -> DataFrame:
    """Is a service key usable, given its last lasting failure?

    ``failures`` has key, at, code, message. Refused keys never come back; keys
    out of quota revive after the delay their message names, else after the
    default.
    """
    lasting = failures.where(is_lasting(F.col("code"), F.col("message")))
    last = lasting.groupBy("key").agg(
        F.max_by(F.struct("at", "code", "message"), F.struct("at", "message")).alias("_f"),
        F.bool_or(is_auth(F.col("code"), F.col("message"))).alias("refused"),
    )
    delay = retry_delay(F.col("_f.message"), default=K.REVIVE_SECONDS)
    revive = F.when(
        ~F.col("refused"), F.unix_micros("_f.at") + (delay * 1_000_000).cast("bigint")
    )
    ahead = (revive - F.unix_micros(now)) / 1_000_000
    wait = F.when(ahead > 0, ahead).when(ahead <= 0, 0.0)
    return last.select(
        "key", "refused", revive.alias("revive_at"),
        F.coalesce(wait == 0, F.lit(False)).alias("alive"),
        F.coalesce(wait <= K.LONGEST_WAIT_SECONDS, F.lit(False)).alias("worth_waiting"),
    )
