"""Bad input and failing mappers change their own rows only."""

import json

from pyspark.sql import functions as F

from folioflow.functions.markup import fence_fault_one, html_fault_one
from folioflow.operators import memo
from folioflow.operators.merging import merge_columns
from folioflow.operators.reconcile import OversizeError, map_batches, parse_answer_one
from folioflow.plans import translate as plan
from folioflow.sources import glossary
from folioflow.streaming import jobs


def test_odd_answers_are_errors_not_exceptions():
    assert parse_answer_one('{"translations":["x", null, {"segment_id":"a","translated_text":"b"}]}')["pairs"] == [
        {"segment_id": "a", "translated_text": "b"}]
    for raw in ('{"translations":null}', '{"translations":{"a":1}}', '{"translations":3}'):
        assert parse_answer_one(raw) == {"pairs": None, "error": "translations is no list"}
    assert parse_answer_one('{"translations":' + "[" * 100_000 + "]" * 100_000 + "}")["error"] == "invalid json"


def test_odd_markup_is_a_fault_not_an_exception():
    assert html_fault_one("<p><![foo[x]]></p>") is not None
    assert fence_fault_one("```json\n" + "[" * 100_000 + "\n```") == "invalid json block"
    assert html_fault_one("<p>fine</p>") is None


def test_odd_glossaries_have_no_entries(spark):
    texts = ["[1, 2]", "{broken", "null", '{"a": 1, "b": "c"}', '[{"source": "s", "target": "t"}]', "[" * 100_000]
    files = spark.createDataFrame([(t,) for t in texts], "value string")
    got = glossary.from_documents(files, "value", "json")
    assert {(r.source, r.target) for r in got.collect()} == {("b", "c"), ("s", "t")}


def _segments(n):
    return [{"seg_id": f"s{i}", "text": f"text {i}"} for i in range(n)]


def test_a_mapper_that_takes_one_row_gets_all_rows_through(spark):
    def make():
        def one_at_a_time(segments):
            if len(segments) > 1:
                raise OversizeError("too many")
            if segments[0]["seg_id"] == "s3":
                raise ValueError("y" * 500)
            return json.dumps({"translations": [{"segment_id": segments[0]["seg_id"], "translated_text": "ok"}]})
        return one_at_a_time

    batches = spark.createDataFrame([(1, _segments(40))], "k int, segments array<struct<seg_id:string,text:string>>")
    got = map_batches(batches, make, ["k"]).first()
    assert len(got.pairs) == 39 and got.error == "y" * 500


def test_mapper_errors_reach_the_result(spark):
    def make():
        def broken(segments):
            raise ValueError("no service " + "z" * 300)
        return broken

    docs = spark.createDataFrame([(1, "plain words")], "doc_id bigint, text string")
    row = plan.translate(docs, "French", make_mapper=make).first()
    assert row.failed and row.error == "no service " + "z" * 300


def test_boxes_without_area_merge_whatever_their_number(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    rows = [(0, i, (10.0, 5.0, 10.0, 25.0), "a", 10.0, True, True) for i in range(1, 4)]
    pieces = spark.createDataFrame(rows, f"page int, id long, box {box}, text string, size double, vertical boolean, needs boolean")
    assert [sorted(r.members) for r in merge_columns(pieces).collect()] == [[1, 2, 3]]
    solid = pieces.withColumn("box", F.col("box").withField("x1", F.lit(20.0)))
    assert merge_columns(solid).count() == 3


def test_two_streams_on_one_memo_keep_each_others_rows(spark, tmp_path):
    path = str(tmp_path / "memo")
    memo.create_empty(spark, path)
    schema = "doc_id bigint, text string"
    for name, text in (("a", "first text"), ("b", "second text")):
        spark.createDataFrame([(1, text)], schema).write.parquet(str(tmp_path / name / "part.parquet"))
        stream = jobs.document_stream(spark, str(tmp_path / name), "part.parquet", schema)
        jobs.run_memo(spark.readStream.schema(schema).parquet(str(tmp_path / name / "*.parquet")), path,
                      str(tmp_path / f"checkpoint-{name}"), "English", "Korean")
        assert stream.isStreaming
    stored = memo.load(spark, path)
    assert {r.source_text for r in stored.collect()} == {"first text", "second text"}
    assert {r.seq for r in stored.collect()} == {0, 1}


def test_a_second_run_is_newer(spark, tmp_path):
    path = str(tmp_path / "memo")
    memo.create_empty(spark, path)
    assert memo.next_seq(spark, path) == 0
    work = spark.createDataFrame([("one", "old")], "text string, translated string")
    for n, translated in enumerate(["old", "new"]):
        rows = memo.entries(work.withColumn("translated", F.lit(translated)), F.lit("E"), F.lit("K"), F.lit(""),
                            F.lit(memo.next_seq(spark, path)))
        memo.append(rows, path, n)
    assert memo.load(spark, path).first().translated_text == "new"


def test_working_files_can_be_released(spark, tmp_path):
    from folioflow import session

    own = spark.range(10)
    kept, session._PATHS[spark.sparkContext.applicationId] = session._PATHS.get(spark.sparkContext.applicationId, []), []
    copy = session.materialize(own, "numbers")
    path = session._PATHS[spark.sparkContext.applicationId][0]
    assert copy.count() == 10 and spark.read.parquet(path).count() == 10
    session.release(spark)
    session._PATHS[spark.sparkContext.applicationId] = kept
    try:
        spark.read.parquet(path).count()
    except Exception as gone:
        assert "PATH_NOT_FOUND" in str(gone)
    else:
        raise AssertionError("still there")


def test_blocks_by_count_stay_small_in_a_hot_group(spark):
    from folioflow.operators import blocked

    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("page"), (F.col("id") % 7).alias("y"), "id")
    cut = blocked.with_counted_block(rows, ["page"], ["y", "id"], 1000)
    largest = cut.groupBy("page", blocked.BLOCK).count().agg(F.max("count")).first()[0]
    assert largest < 3000
    got = blocked.row_number(cut, ["page"], ["y", "id"], "n").where("page = 0").orderBy("y", "id").select("n").collect()
    assert [r.n for r in got] == list(range(1, len(got) + 1))


def test_missing_answers_are_asked_again_and_then_remembered(spark, tmp_path):
    path, calls = str(tmp_path / "memo"), spark.sparkContext.accumulator(0)
    memo.create_empty(spark, path)
    docs = spark.createDataFrame(
        [(1, "see http://a.test now\nplain words\nnever done"), (2, "plain words\nother words")],
        "doc_id bigint, text string")

    def make():
        def answer(segments):
            calls.add(1)
            if any("other" in s["text"] for s in segments) and segments[0]["attempt"] == 0:
                raise ValueError("down")
            kept = [s for s in segments if "never" not in s["text"]
                    and not (segments[0]["attempt"] == 0 and "plain" in s["text"])]
            return json.dumps({"translations": [
                {"segment_id": s["seg_id"], "translated_text": "fr " + s["text"]} for s in kept]})
        return answer

    rows = {(r.doc_id, r.pos): r for r in plan.translate_through_memo(docs, path, make, "English", "French").collect()}
    assert rows[1, 0].translated == "fr see http://a.test now" and not rows[1, 0].failed
    assert rows[1, 1].translated == rows[2, 0].translated == "fr plain words"
    assert rows[2, 1].translated == "fr other words"
    assert rows[1, 2].failed and rows[1, 2].translated == "never done" and rows[1, 2].error == "not mapped"
    before = calls.value
    done = docs.where("doc_id = 2")
    again = plan.translate_through_memo(done, path, make, "English", "French").collect()
    assert calls.value == before and not any(r.failed for r in again)


def test_a_python_worker_gets_small_batches_of_long_texts(spark):
    from pyspark.sql import functions as F

    import __spark_entry__ as entry
    from folioflow.session import _BATCH_KEY, BATCH_BYTES

    def sizes(parts):
        import pyarrow as pa

        for part in parts:
            yield pa.RecordBatch.from_pydict({"n": [part.num_rows], "size": [part.nbytes]})

    before = spark.conf.get(_BATCH_KEY, None)
    try:
        entry.queries()["normalize_text"](spark, "/root/testdata/sf0.001")
        texts = spark.range(0, 600, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("text"))
        got = texts.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in got) == 600 and max(r.size for r in got) < 2 * BATCH_BYTES
        spark.conf.set(_BATCH_KEY, "1000000b")
        entry.queries()["normalize_text"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get(_BATCH_KEY) == "1000000b"
    finally:
        spark.conf.unset(_BATCH_KEY) if before is None else spark.conf.set(_BATCH_KEY, before)
