"""State of answers: on disk, as compressed columns (F1)."""

import datetime
import glob
import json
import time

import numpy as np
import pyarrow as pa
import pytest

from folioflow import session
from folioflow.streaming import answers, jobs

DAY = datetime.datetime(2024, 1, 1)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _stream(spark, tmp_path, parts, key="long"):
    kind = f"request_id {key}, pos int, token string, last boolean, at timestamp"
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / f"in/part={n}"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
    return stream.parquet(str(tmp_path / "in"))


def _run(spark, tmp_path, stream, **options):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    jobs.run_available(answers.live_answers(stream, **options), out, checkpoint)
    told = json.loads(open(f"{checkpoint}/offsets/0").read().split("\n")[1])["conf"]
    return sorted(((r.request_id, r.text, r.complete) for r in spark.read.parquet(out).collect()), key=str), told[PROVIDER], checkpoint


def test_state_lies_on_disk_unless_a_session_says_otherwise(spark, tmp_path):
    spark.conf.unset(PROVIDER)
    rows = [(1, 0, "a", False, DAY), (1, 1, "b", True, DAY), (2, 0, "open", False, DAY)]
    got, provider, checkpoint = _run(spark, tmp_path / "a", _stream(spark, tmp_path / "a", [rows]))
    assert got == [(1, "a b", True)] and provider == session._STATE_ON_DISK[PROVIDER]
    assert glob.glob(f"{checkpoint}/state/0/*/*.zip") and not glob.glob(f"{checkpoint}/state/0/*/*.delta")
    own = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    spark.conf.set(PROVIDER, own)
    try:
        got, provider, _ = _run(spark, tmp_path / "b", _stream(spark, tmp_path / "b", [rows]))
    finally:
        spark.conf.unset(PROVIDER)
    assert got == [(1, "a b", True)] and provider == own


def test_open_tokens_are_kept_compressed(spark, tmp_path):
    words = [f"word{n % 97}" for n in range(60_000)]
    half = [(n % 20, n // 20, w, False, DAY) for n, w in enumerate(words)]
    _, _, checkpoint = _run(spark, tmp_path, _stream(spark, tmp_path, [half]), buckets=1)
    fields = spark.read.format("statestore").load(checkpoint)
    value = fields.selectExpr("value.*").selectExpr("groupState.*").first()
    assert len(bytes(value.held)) < 0.3 * sum(map(len, words))
    held = answers._unpack(bytes(value.held))
    assert len(held.owner) == len(words) and held.token.to_pylist()[:2] == ["word0", "word20"]


@pytest.mark.parametrize("key", ["string", "long"])
def test_keys_may_be_null_and_tokens_odd(spark, tmp_path, key):
    name = (lambda n: f"r{n}") if key == "string" else (lambda n: n)
    texts = {None: ["x", "", "é\u0000 日本"], name(1): ["only"], name(2): ["", ""]}
    rows = [(k, n, t, n == len(ts) - 1, DAY) for k, ts in texts.items() for n, t in enumerate(ts)]
    again = [(k, n, "changed", last, at) for k, n, _, last, at in rows]  # the first of a position counts
    parts = [rows[::2], again[::2], rows[1::2], rows]
    got, _, _ = _run(spark, tmp_path, _stream(spark, tmp_path, parts, key), sep="|", buckets=1)
    assert got == sorted(((k, "|".join(ts), True) for k, ts in texts.items()), key=str)


def test_packed_tokens_come_back():
    for rows in ([], [(0, 5, "")], [(0, -3, "a"), (0, 2**31 - 1, "é"), (7, -2**31, "日本"), (7, 0, "x" * 1000)]):
        owner, pos = (np.array([r[i] for r in rows], np.int32) for i in (0, 1))
        held = answers._Tokens(owner, pos, pa.array([r[2] for r in rows], pa.string()))
        back = answers._unpack(answers._pack(held))
        assert list(zip(back.owner.tolist(), back.pos.tolist(), back.token.to_pylist())) == rows
        if rows:
            last = answers._Tokens(owner[1:], pos[1:], held.token[1:])  # a part of an array
            assert answers._unpack(answers._pack(last)).token.to_pylist() == [r[2] for r in rows[1:]]


def test_shuffles_of_a_stream_go_with_their_batch(spark, sf):
    from folioflow.plans import catalog_flow

    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f for d in root for f in glob.glob(f"{d}/*/shuffle_*")}

    before = files()
    done = catalog_flow.stream_answers(spark, sf)
    for _ in range(100):  # executors delete them a little later
        if files() - before:
            time.sleep(0.1)
    assert not files() - before and not done.isEmpty()
    assert spark.conf.get(session._CLEANUP_KEY, None) is None


def test_cores_bound_the_number_of_stores(spark, tmp_path):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    most = session.STORES_PER_CORE * spark.sparkContext.defaultParallelism
    stream = _stream(spark, tmp_path, [[(1, 0, "a", True, DAY)]])
    spark.conf.set("spark.sql.shuffle.partitions", str(most + 500))
    try:
        with session.few_stores(spark):
            assert spark.conf.get("spark.sql.shuffle.partitions") == str(most)
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(most + 500)
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(session, "STORES_PER_CORE", 1)
            got, _, checkpoint = _run(spark, tmp_path, stream)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert got == [(1, "a", True)]
    assert len(glob.glob(f"{checkpoint}/state/0/[0-9]*")) == spark.sparkContext.defaultParallelism
