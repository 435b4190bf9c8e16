"""Operators for groups of any size against brute force, with tiny blocks and hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from folioflow.operators import batching, blocked, ranges, skew


def greedy(rows, max_size, max_rows):
    out, number, size, count, last = [], -1, 0, 0, None
    for length, kind in rows:
        if number < 0 or size + length > max_size or count >= max_rows or kind != last:
            number, size, count = number + 1, 0, 0
        size, count, last = size + length, count + 1, kind
        out.append(number)
    return out


def hot_rows(seed, n):
    """Key 0 holds most of the rows."""
    rng = random.Random(seed)
    counts = {0: n, 1: n // 7, 2: 3, 3: 1}
    rows = []
    for key, count in counts.items():
        for pos in range(count):
            size = rng.choice([0, 1, 5, 20, 90, 300])
            rows.append((key, pos * 2, size, rng.random() < 0.2))
    return rows


@pytest.mark.parametrize("seed,max_size,max_rows", [(1, 100, 4), (2, 50, 2), (3, 400, 7), (4, 10, 8)])
def test_assign_batches_equals_greedy(spark, seed, max_size, max_rows):
    rows = hot_rows(seed, 700)
    df = spark.createDataFrame(rows, "k int, pos int, size int, kind boolean").repartition(4)
    df = blocked.with_block(df, F.col("pos"), 64)
    got = batching.assign_batches(
        df, ["k"], ["pos"], F.col("size"), F.col("kind"), max_size, max_rows, leaf_rows=16, fan=4
    ).collect()
    want = {}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        for r, b in zip(mine, greedy([(r[2], r[3]) for r in mine], max_size, max_rows)):
            want[key, r[1]] = b
    assert {(r.k, r.pos): r.batch_id for r in got} == want


def test_batch_starts_in_row():
    rng = random.Random(7)
    for _ in range(200):
        n = rng.randrange(0, 40)
        rows = [(rng.choice([0, 3, 9, 30]), rng.random() < 0.3) for _ in range(n)]
        import numpy as np

        starts = batching.batch_starts(
            np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=bool), 20, 3)
        want = greedy(rows, 20, 3)
        assert starts == [i + 1 for i in range(n) if i == 0 or want[i] != want[i - 1]]


def test_blocked_windows(spark):
    rows = [(k, p, s, int(f)) for k, p, s, f in hot_rows(5, 400)]
    df = blocked.with_block(
        spark.createDataFrame(rows, "k int, pos int, size int, flag int").repartition(3), F.col("pos"), 32)
    numbered = blocked.row_number(df, ["k"], ["pos"], "n")
    summed = blocked.running_sum(numbered, ["k"], ["pos"], F.col("size"), "s")
    far = blocked.running_max_before(summed, ["k"], ["pos"], F.col("size"), "m")
    runs = blocked.break_runs(far, ["k"], ["pos"], F.col("size"), lambda a, b: a != b, "g")
    got = {(r.k, r.pos): (r.n, r.s, r.m, r.g) for r in runs.collect()}
    want = {}
    for key in {r[0] for r in rows}:
        total, best, last, run = 0, None, None, 0
        for n, (_, pos, size, _) in enumerate([r for r in rows if r[0] == key], 1):
            total += size
            run += last is not None and last != size
            want[key, pos] = (n, total, best, run)
            best, last = size if best is None else max(best, size), size
    assert got == want


def test_ranges_across_spans(spark):
    rng = random.Random(3)
    pages = [(k, rng.randrange(0, 60 if k else 900)) for k in (0, 0, 0, 1) for _ in range(500)]
    got = ranges.collapse(spark.createDataFrame(pages, "k int, page int"), ["k"], span=8)
    back = ranges.expand(got, ["k"]).collect()
    assert sorted((r.k, r.page) for r in back) == sorted(set(pages))
    rows = got.collect()
    edges = {(r.k, r.first) for r in rows}
    assert not any((r.k, r.last + 1) in edges for r in rows)  # maximal


def test_sidecar_parts_keep_every_range(spark):
    r = spark.range(25).select(
        F.lit(1).alias("k"), F.when(F.col("id") % 2 == 0, "translated").otherwise("untranslated").alias("state"),
        (F.col("id") * 3).cast("int").alias("first"), (F.col("id") * 3 + 1).cast("int").alias("last"))
    parts = ranges.sidecar_parts(r, "k", part=4).collect()
    assert sum(len(p.t_ranges) for p in parts) == 13 and sum(len(p.u_ranges) for p in parts) == 12
    assert max(len(p.t_ranges) for p in parts) <= 4


def test_salted_join_keeps_all_rows(spark):
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"))
    unique = rows.select("key").distinct().withColumn("v", F.upper("key"))
    counts = rows.groupBy("key").agg(F.count("*").alias("n"))
    heavy = skew.heavy_keys(counts, "key", floor=500)
    assert [r.key for r in heavy.collect()] == ["hot"]
    joined = skew.join_unique(rows, unique, "key", heavy, ["id"], salts=8)
    assert joined.count() == 3000 and joined.where(F.col("v") != F.upper("key")).count() == 0
    assert joined.where(F.col("v").isNull()).count() == 0


def test_a_box_meets_its_surroundings_in_few_cells(spark):
    """Growing boxes into free space lists each box in a handful of cells; the widened box is no reason for dozens."""
    from folioflow.functions import geometry as G
    from folioflow.operators import spatial

    listed, plain = [], spatial._cells

    def counted(df, *rest):
        out = plain(df, *rest)
        listed.append((df.count(), out.count()))
        return out

    rows = spark.range(400).select(
        (F.col("id") % 4).alias("page"), "id", (F.col("id") * 37 % 500).cast("double").alias("x"), (F.col("id") * 53 % 700).cast("double").alias("y"))
    boxes = rows.select("page", "id", G.box(F.col("x"), F.col("y"), F.col("x") + 30, F.col("y") + 12).alias("box"))
    spatial._cells = counted
    try:
        spatial.free_room(boxes, ["page"], G.box(F.lit(0), F.lit(0), F.lit(600), F.lit(800)))
    finally:
        spatial._cells = plain
    assert len(listed) == 2 and sum(n for _, n in listed) < 5 * sum(n for n, _ in listed)
