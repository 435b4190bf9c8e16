"""What a run through the memo leaves on disk, and that leaner copies change no row (F2)."""

import glob
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from folioflow import session
from folioflow.operators import memo
from folioflow.plans import catalog_flow, translate as plan

DOCS = [(1, "one line\ntwo lines\none line"), (2, "two lines\nbad line"), (2, "two lines\nbad line"), (2, "another text"),
        (None, "without a key"), (None, "also without"), (4, None), (5, "1 2 3\n- - -\nlast line"), (6, "\n".join(f"line no {n}" for n in range(37)))]
PLAIN = plan.Options(placeholders=False, validation=False)


def _make():
    def make():
        def answer(segments):
            assert all(s["seg_id"] == f"page_{s['pos'] // 10 + 1:03d}_block_{s['pos'] % 10:03d}" and s["page"] == s["pos"] // 10 for s in segments)
            told = [s for s in segments if "bad" not in s["text"] and not (s["attempt"] == 0 and "one" in s["text"])]
            return json.dumps({"translations": [{"segment_id": s["seg_id"], "translated_text": "fr " + s["text"]} for s in told]})

        return answer

    return make


def _want():
    out = []
    for key, text in DOCS:
        for n, line in enumerate((text or "").split("\n")):
            if any(c.isalpha() for c in line):
                bad = "bad" in line
                out.append((key, n, line, line if bad else "fr " + line, "not mapped" if bad else None, bad))
    return sorted(out, key=str)


def _run(spark, path, **more):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    memo.create_empty(spark, path)
    return plan.translate_through_memo(docs, path, _make(), "English", "French", options=PLAIN, **more)


def test_rows_are_whole_with_and_without_texts(spark, tmp_path):
    got = sorted((tuple(r) for r in _run(spark, str(tmp_path / "a")).collect()), key=str)
    assert got == _want()
    bare = _run(spark, str(tmp_path / "b"), with_text=False)
    assert bare.columns == ["doc_id", "pos", "translated", "error", "failed"]
    assert sorted((tuple(r) for r in bare.collect()), key=str) == sorted(((k, n, *rest) for k, n, _, *rest in got), key=str)
    again = _run(spark, str(tmp_path / "b"), with_text=False)  # all but the bad line is there
    assert again.exceptAll(bare).isEmpty() and bare.exceptAll(again).isEmpty()


@pytest.mark.parametrize("with_text", [True, False])
def test_without_attempts_sources_are_kept(spark, tmp_path, with_text):
    got = _run(spark, str(tmp_path / "a"), attempts=0, with_text=with_text).collect()
    assert sorted(r.translated for r in got) == sorted(t for _, _, t, *_ in _want())
    assert all(r.failed and r.error == "not mapped" for r in got)


def test_copies_of_texts_go_when_the_next_step_is_written(spark, sf):
    folder = session.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    done = catalog_flow.memo_mapped_run(spark, sf)
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert left == {"memo", "places", "results"} and not done.isEmpty()


def test_shuffle_files_go_with_the_write(spark):
    root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f for d in root for f in glob.glob(f"{d}/*/shuffle_*")}

    rows = spark.range(50_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))
    before = files()
    copy, path = session.lean_copy(rows.groupBy("k").count(), "counted")
    memo_path = session.work_path(spark, "freed-memo")
    memo.append(memo.entries(rows.select(F.col("k").alias("text"), F.col("k").alias("translated")), F.lit("E"), F.lit("K"), F.lit(""), F.lit(0)), memo_path, 0)
    for _ in range(100):  # executors delete them a little later
        if files() - before:
            time.sleep(0.1)
    assert not files() - before
    assert copy.count() == 50_000 == memo.load(spark, memo_path).count()
    assert spark.conf.get(session._CLEANUP_KEY, None) is None
    session.discard(spark, path)
    assert not os.path.exists(path.removeprefix("file:"))
