"""What runs read, shuffle and hold: each text is scanned once, runs are dealt finely, sizes travel without texts."""

import glob

from pyspark.sql import functions as F

from folioflow.operators import memo
from folioflow.plans import catalog_flow, translate as plan
from folioflow.plans.inputs import table
from folioflow.session import work_path


def _store(spark, texts, mark, path, run):
    pairs = spark.createDataFrame([(t, f"{mark} {t}") for t in texts], "text string, translated string")
    memo.append(memo.entries(pairs, F.lit("E"), F.lit("K"), F.lit(""), F.lit(0)), path, run)


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_stored_sizes_equal_those_of_the_loaded_rows(spark):  # F22
    path = work_path(spark, "cost-memo")
    memo.create_empty(spark, path)
    assert memo.stored_stats(spark, path).collect() == memo.stats(memo.load(spark, path)).collect()
    _store(spark, [f"é {i}" * 50 for i in range(3000)] * 2, "old", path, 0)
    _store(spark, [f"é {i}" * 50 for i in range(2000, 4000)], "newer", path, 1)
    got = memo.stored_stats(spark, path)
    assert got.collect() == memo.stats(memo.load(spark, path)).collect() and got.first().entries == 4000
    assert "collect_list" not in _plan(got) and "SortAggregate" not in _plan(got)  # sizes are added up by hash


def test_a_large_run_is_dealt_over_more_tasks_than_buckets(spark, monkeypatch):  # F22
    path = work_path(spark, "cost-memo")
    memo.create_empty(spark, path)
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if every part were large
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        _store(spark, [f"text {i}" for i in range(2000)], "old", path, 0)
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    files = glob.glob(f"{path}/level=0/seq=0/run=0/bucket=*/*.parquet")
    assert len(files) > 32 and len({f.split("bucket=")[1][0] for f in files}) == 16
    assert memo.load(spark, path).count() == 2000


def test_results_of_a_memo_run_scan_no_document_again(spark, sf):  # F9, F23
    docs = table(spark, sf, "documents")
    for name in ("memo_run", "memo_mapped_run"):
        assert not [f for f in getattr(catalog_flow, name)(spark, sf).inputFiles() if "documents" in f], name
    path = work_path(spark, "cost-memo")
    memo.create_empty(spark, path)
    assert not [f for f in plan.finish(docs, memo.load(spark, path), "English", "Korean").inputFiles() if "documents" in f]


def test_open_work_is_cut_in_one_shuffle_as_by_blocks(spark, sf):  # F9
    segments = plan.keyed_segments(table(spark, sf, "documents"), "English", "Korean").where("pos % 3 <> 1")
    got = plan._asked_batches(segments, "doc_id", None, plan.Options(placeholders=False), 0)
    rows = got.select("doc_id", "batch_id", F.explode("segments.pos").alias("pos"))
    want = plan.batched_work(segments).select("doc_id", F.col("batch_id").cast("int").alias("batch_id"), "pos")
    assert rows.exceptAll(want).isEmpty() and want.exceptAll(rows).isEmpty() and not rows.isEmpty()
    exchanges = [line for line in _plan(got).split("== Physical Plan ==")[1].splitlines() if "Exchange" in line]
    assert len(exchanges) == 1


def test_what_is_sent_to_a_mapper_does_not_pass_through_pandas(spark, sf):  # F9, F10, F20
    answered = plan.translate(table(spark, sf, "documents"), make_mapper=lambda: str)
    assert "MapInArrow" in _plan(answered) and "MapInPandas" not in _plan(answered)


def test_page_sets_pass_their_events_once(spark, sf):  # F24
    from folioflow.plans import catalog_names

    sets = catalog_names.page_sets(spark, sf)
    assert "Union" not in _plan(sets).split("== Physical Plan ==")[1] and not sets.isEmpty()


def test_batches_are_cut_in_the_row_without_python(spark):  # F10, F20
    import random

    import numpy as np

    from folioflow.operators import batching

    rng = random.Random(4)
    rows = [([rng.choice([0, 3, 40, 99, 100, 101, 500]) for _ in range(n)], [rng.random() < 0.2 for _ in range(n)])
            for n in [0, 1, *(rng.randint(2, 60) for _ in range(60))]]
    df = spark.createDataFrame(rows, "sizes array<int>, kinds array<boolean>")
    cut = df.select("sizes", "kinds", batching.starts_in_row(100, 4)("sizes", "kinds").alias("starts"))
    for r in cut.collect():
        assert r.starts == batching.batch_starts(np.asarray(r.sizes, dtype=np.int64), np.asarray(r.kinds, dtype=bool), 100, 4)
    assert "ArrowEvalPython" not in _plan(cut)
