"""The interchange source, the log tail, and what a run observes of itself."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from folioflow.plans import translate as plan
from folioflow.sources import interchange
from folioflow.streaming import jobs, logs

ROWS = [("1", "page_001_block_000", 1, 'say "hi",\nthen go', "x\ty"), ("1", "page_001_block_001", 1, "", None), (None, None, None, None, "한글 😀")]


@pytest.fixture
def frame(spark):
    interchange.register(spark)
    logs.register(spark)
    return spark.createDataFrame(ROWS, interchange.SCHEMA)


def read(spark, path):
    return sorted((tuple(r) for r in spark.read.format("interchange").load(path).collect()), key=repr)


def test_rows_come_back_and_overwriting_replaces(spark, frame, tmp_path):
    path = str(tmp_path / "pairs")
    frame.withColumn("extra", F.lit(1)).select("extra", *reversed(frame.columns)).write.format("interchange").mode("append").save(path)
    assert read(spark, path) == sorted(ROWS, key=repr)
    frame.write.format("interchange").mode("append").save(path)
    assert len(read(spark, path)) == 6
    frame.limit(1).write.format("interchange").mode("overwrite").save(path)
    assert read(spark, path) == ROWS[:1]
    frame.limit(0).write.format("interchange").mode("overwrite").save(path)
    assert read(spark, path) == []
    with pytest.raises(Exception, match="interchange rows need source"):
        frame.drop("source").write.format("interchange").mode("append").save(path)


def test_a_failed_job_leaves_nothing_visible(spark, frame, tmp_path):
    path = str(tmp_path / "pairs")
    frame.write.format("interchange").mode("append").save(path)
    rows = spark.range(0, 4, 1, 4).select(F.lit("2").alias("doc_id"), F.lit("s").alias("segment_id"), F.lit(1).alias("page"),
                                          F.lit("t").alias("source"), F.when(F.col("id") == 3, F.raise_error(F.lit("gone"))).otherwise(F.lit("u")).alias("translated"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="gone"):
            rows.write.format("interchange").mode(mode).save(path)
        assert read(spark, path) == sorted(ROWS, key=repr)
    # a job that ends between its two phases: files, no commit
    writer = interchange.Writer(path, True)
    message = writer.write(iter(frame.collect()))
    assert len(message.files) == 1 and read(spark, path) == sorted(ROWS, key=repr)
    writer.abort([None])
    assert not glob.glob(f"{path}/part-{writer.job}-*")


def tail(spark, folder, out, checkpoint):
    jobs.run_tail(spark.readStream.format("log_tail").option("suffix", ".log").load(folder), out, checkpoint)
    got = spark.read.schema(logs.SCHEMA).parquet(out).collect()
    return sorted((os.path.basename(r.file), r.offset, r.line) for r in got)


def test_lines_come_once_while_logs_grow(spark, frame, tmp_path, monkeypatch):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("logs", "out", "check"))
    os.mkdir(folder)

    def append(name, data):
        with open(f"{folder}/{name}", "ab") as f:
            f.write(data)

    append("a.log", b"one\ntwo\r\nhal")
    append("b.log", "첫 줄\n".encode())
    append("c.txt", b"not a log\n")
    assert tail(spark, folder, out, checkpoint) == [("a.log", 0, "one"), ("a.log", 4, "two"), ("b.log", 0, "첫 줄")]
    assert len(tail(spark, folder, out, checkpoint)) == 3
    append("a.log", b"f\n\xff\n")
    append("d.log", b"new\n")
    want = [("a.log", 0, "one"), ("a.log", 4, "two"), ("a.log", 9, "half"), ("a.log", 14, "�"), ("b.log", 0, "첫 줄"), ("d.log", 0, "new")]
    assert tail(spark, folder, out, checkpoint) == want
    with open(f"{folder}/d.log", "wb") as f:  # started anew, shorter
        f.write(b"n\n")
    assert tail(spark, folder, out, checkpoint) == sorted([*want, ("d.log", 0, "n")])
    source = logs.LogTail(folder, ".log")
    monkeypatch.setattr(logs, "PIECE_BYTES", 6)
    parts = source.partitions({}, source.latestOffset())
    assert len(parts) > 5
    assert sorted((os.path.basename(f), o, x) for p in parts for f, o, x in source.read(p)) == sorted(
        [w for w in want if w[0] != "d.log"] + [("d.log", 0, "n")])


def test_a_run_counts_itself_in_its_one_scan(spark, tmp_path, capsys):
    docs = spark.createDataFrame([(1, "one\n123\ntwo"), (2, "bad words"), (3, None), (4, "")], "doc_id bigint, text string")

    def make():
        import json

        def answer(segments):
            if "bad" in segments[0]["text"]:
                raise ValueError("down")
            return json.dumps({"translations": [{"segment_id": s["seg_id"], "translated_text": f"{s['doc_id']} fr"} for s in segments]})

        return answer

    docs.write.parquet(str(tmp_path / "docs"))
    metrics = plan.RunMetrics()
    done = plan.translate(spark.read.parquet(str(tmp_path / "docs")), "French", make_mapper=make, metrics=metrics, keep=["doc_id"])
    done.explain()
    text = capsys.readouterr().out
    assert text.count("FileScan") == 1 and "Exchange" not in text
    rows = done.collect()
    assert {r.translated for r in rows if not r.failed} == {"1 fr"}
    assert metrics.summary() == {"segments": 4, "targets": 3, "skipped": 1, "target_chars": 15, "translated": 2, "failed": 1}
    assert round(metrics.percent(), 3) == 66.667


def test_a_task_of_the_source_holds_a_batch_not_a_file(tmp_path):
    import json
    import tracemalloc

    from folioflow.session import BATCH_BYTES

    path, n = str(tmp_path / "pairs"), 30_000
    rows = ({"doc_id": str(i), "segment_id": "s", "page": 1, "source": "x" * 1000, "translated": None} for i in range(n))
    writer, reader = interchange.Writer(path, False), interchange.Reader(path)
    tracemalloc.start()
    message = writer.write(rows)
    writer.commit([message])
    seen = largest = 0
    for part in reader.partitions():
        for batch in reader.read(part):
            assert batch["doc_id"][0].as_py() == str(seen) and batch["source"][-1].as_py() == "x" * 1000
            seen, largest = seen + batch.num_rows, max(largest, batch.nbytes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n and largest < 2 * BATCH_BYTES and peak < 6 * BATCH_BYTES
    with open(f"{path}/{message.files[0]}") as held:
        assert json.loads(held.readline())["translated"] is None
