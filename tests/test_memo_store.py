"""The clustered memo: what is read, what repeated and interrupted runs leave behind."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import memo
from folioflow.session import work_path


def rows(spark, texts, mark):
    pairs = spark.createDataFrame([(t, f"{mark} {t}") for t in texts], "text string, translated string")
    return memo.entries(pairs, F.lit("E"), F.lit("K"), F.lit(""), F.lit(0))


def held(spark, path):
    return {r.source_text: r.translated_text for r in memo.load(spark, path).collect()}


def key_of(spark, texts):
    return [r.cache_key for r in rows(spark, texts, "x").collect()]


def files_read(df):
    """Files that the scans of a frame opened, from the metrics of its run."""
    df.collect()
    total, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            nodes.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            nodes.append(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numFiles").value()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
    return total


@pytest.fixture
def path(spark):
    path = work_path(spark, "memo-store")
    memo.create_empty(spark, path)
    return path


def test_the_newest_run_wins_and_a_repeated_one_replaces_itself(spark, path):
    assert held(spark, path) == {} and memo.next_seq(spark, path) == 0
    memo.append(rows(spark, "abc", "one"), path, "a")
    memo.append(rows(spark, "bcd", "two"), path, "b")
    assert held(spark, path) == {"a": "one a", "b": "two b", "c": "two c", "d": "two d"}
    memo.append(rows(spark, "b", "again"), path, "a")
    assert held(spark, path) == {"b": "again b", "c": "two c", "d": "two d"} and memo.next_seq(spark, path) == 3
    memo.append(rows(spark, "", "none"), path, "c")
    assert memo.stored_rows(spark, path).count() == 4
    assert {r.source_text for r in memo.other_rows(spark, path, "b").collect()} == {"b"}
    memo.clear(spark, path)
    assert held(spark, path) == {} and memo.runs(spark, path) == []


def test_a_lookup_opens_only_files_that_can_hold_its_keys(spark, path):
    texts = [f"text {i}" for i in range(2000)]
    memo.append(rows(spark, texts, "old"), path, 0)
    memo.append(rows(spark, texts[:1000], "new"), path, 1)
    assert files_read(memo.stored_rows(spark, path)) == 32
    few = key_of(spark, ["text 5", "text 1500", "unknown"])
    found = memo.lookup(spark, path, few)
    assert {r.source_text: r.translated_text for r in found.collect()} == {"text 5": "new text 5", "text 1500": "old text 1500"}
    assert files_read(memo.lookup(spark, path, few)) == 2 * len({k[0] for k in few}) < 32
    batch = rows(spark, ["text 5", "text 1500", "unknown"], "x").select("cache_key", "source_text").persist()
    candidates = memo.rows_for(batch, path)
    assert files_read(candidates) == 2 * len({k[0] for k in few})
    assert [r.source_text for r in memo.misses(batch, candidates).collect()] == ["unknown"]
    memo.compact_runs(spark, path, fan=2)
    assert files_read(memo.stored_rows(spark, path)) == 256
    assert files_read(memo.rows_for(batch, path)) == len({k[:2] for k in few}) == files_read(memo.lookup(spark, path, few))
    assert [r.source_text for r in memo.misses(batch, memo.rows_for(batch, path)).collect()] == ["unknown"]


def test_files_are_sorted_and_carry_bloom_filters(spark, path):
    import glob

    import pyarrow.parquet as pq

    memo.append(rows(spark, [f"text {i}" for i in range(500)], "old"), path, 0)
    for name in glob.glob(f"{path}/level=0/seq=0/run=0/bucket=*/*.parquet"):
        keys = pq.read_table(name, columns=["cache_key"]).column(0).to_pylist()
        assert keys == sorted(keys) and {k[0] for k in keys} == {name.split("bucket=")[1][0]}
        assert pq.ParquetFile(name).metadata.row_group(0).num_rows == len(keys)


def test_folding_in_levels_keeps_the_newest(spark, path):
    rng, want = random.Random(1), {}
    for run in range(5):
        texts = rng.sample("abcdefghijklmnop", 6)
        memo.append(rows(spark, texts, f"run {run}"), path, run)
        want |= {t: f"run {run} {t}" for t in texts}
        memo.compact_runs(spark, path, fan=2)
        assert held(spark, path) == want
        levels = [r.level for r in memo.runs(spark, path)]
        assert len(levels) == len(set(levels))  # no level is full
    before = len(memo._all_runs(spark, path))
    gone = memo.vacuum(spark, path)
    assert gone > 0 and len(memo._all_runs(spark, path)) == before - gone == len(memo.runs(spark, path))
    assert held(spark, path) == want and memo.vacuum(spark, path) == 0


def test_an_interrupted_or_repeated_fold_loses_nothing(spark, path, monkeypatch):
    memo.append(rows(spark, "abc", "one"), path, "a")
    memo.append(rows(spark, "cd", "two"), path, "b")
    want = held(spark, path)
    monkeypatch.setattr(memo, "json", None)  # ends after the rows are written, before they count
    with pytest.raises(AttributeError):
        memo.compact_runs(spark, path, fan=2)
    monkeypatch.undo()
    assert len(memo._all_runs(spark, path)) == 3 and [r.level for r in memo.runs(spark, path)] == [0, 0]
    assert held(spark, path) == want and memo.vacuum(spark, path) == 0
    mine = memo.runs(spark, path)
    assert memo.compact_runs(spark, path, fan=2) == 1
    assert [r.level for r in memo.runs(spark, path)] == [1] and held(spark, path) == want
    memo._fold(spark, path, mine)  # a second worker does the same again
    assert [r.level for r in memo.runs(spark, path)] == [1] and held(spark, path) == want
    memo.append(rows(spark, "a", "three"), path, "c")
    assert held(spark, path) == want | {"a": "three a"}


def test_an_unfinished_run_is_not_read(spark, path):
    memo.append(rows(spark, "ab", "one"), path, "a")
    rows(spark, "xyz", "half").drop("seq").withColumn("bucket", F.lit("0")).write.partitionBy("bucket").option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/level=0/seq=1/run=b")
    assert held(spark, path) == {"a": "one a", "b": "one b"} and memo.next_seq(spark, path) == 1
