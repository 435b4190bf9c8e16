import json

import pytest
from pyspark.sql import functions as F

from folioflow.functions import naming
from folioflow.functions.text import segment_lines
from folioflow.operators import glossary, memo
from folioflow.plans import translate as plan
from folioflow.sources import files
from folioflow.sources import glossary as source


def as_dict(df):
    return {(r.profile, r.source): r.target for r in df.collect()}


def test_glossary_files(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"tech": {"net": "망"}, "flat": "평"}), encoding="utf-8")
    (tmp_path / "g.yaml").write_text("default:\n  a: b\nlegal:\n  a: c\n", encoding="utf-8")
    (tmp_path / "g.csv").write_text("x , y\nonly\nx,z\n", encoding="utf-8")
    (tmp_path / "g.txt").write_text("# note\n\n a => b, c\nd, e\nnothing\n", encoding="utf-8")
    (tmp_path / "l.json").write_text(json.dumps([{"source": "s", "target": "t"}]), encoding="utf-8")
    read = lambda n: source.read(spark, str(tmp_path / n))
    assert as_dict(read("g.json")) == {("tech", "net"): "망", (None, "flat"): "평"}
    assert as_dict(read("g.yaml")) == {("default", "a"): "b", ("legal", "a"): "c"}
    assert as_dict(read("g.csv")) == {(None, "x"): "z"}
    assert as_dict(read("g.txt")) == {(None, "a"): "b, c", (None, "d"): "e"}
    assert as_dict(read("l.json")) == {(None, "s"): "t"}
    pick = lambda p: {r.source: r.target for r in glossary.select_profile(read("g.json"), p).collect()}
    assert pick("tech") == {"net": "망"} and pick("other") == {"flat": "평"}


@pytest.mark.parametrize("raw,text", [
    ("한글".encode("utf-8"), "한글"), (b"\xef\xbb\xbfa", "a"), (b"\xff\xfe" + "é".encode("utf-16-le"), "é"),
    (b"\xfe\xff" + "é".encode("utf-16-be"), "é"), ("가나다".encode("cp949") + b"!", "가나다!"),
])
def test_decode(raw, text):
    assert files.decode_one(raw) == text


def test_binary_reader(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xff\xfeh\x00i\x00")
    assert files.read_texts(spark, str(tmp_path / "a.txt")).first().text == "hi"


def test_page_spec(spark):
    rows = spark.createDataFrame(
        [("1-3,7", 10, [0, 1, 2, 6]), ("3-1", 10, []), ("", 10, None), ("9-99999999", 10, [8, 9]),
         (" 2 , 2", 10, [1]), ("50", 10, [])], "s string, n int, want array<int>")
    got = rows.withColumn("got", naming.page_spec(F.col("s"), F.col("n")))
    assert got.where("NOT got <=> want").count() == 0


def test_resume_name_forms(spark):
    names = ["b_translated_001-003_untranslated_004-005_009-009", "b_T_000-000_unT_001-002",
             "b_translated_001-090-MULTI12_untranslated_000-000", "plain"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    a, b, c, d = [r[0] for r in df.select(naming.parse_resume_name(F.col("s"))).collect()]
    assert [tuple(x) for x in a.left] == [(4, 5), (9, 9)] and (a.first_page, a.last_page) == (1, 3)
    assert b.done == [] and [tuple(x) for x in b.left] == [(1, 2)]
    assert c.unresolved and c.done is None
    assert d is None


def test_segment_lines(spark):
    text = "a•b\n\n    \n x-y +z \n\x07t  u\n"
    got = spark.createDataFrame([(text,)], "t string").select(segment_lines(F.col("t"))).first()[0]
    assert got == ["a - b", "x - y +z", "t u"]
    assert spark.createDataFrame([(" \n",)], "t string").select(segment_lines(F.col("t"))).first()[0] == []


def test_memo_is_append_only_and_replayable(spark, tmp_path):
    path = str(tmp_path / "memo")
    memo.create_empty(spark, path)
    docs = spark.createDataFrame([(1, "one\ntwo"), (2, "two\nthree\n12")], "doc_id bigint, text string")
    work = plan.pending(docs, memo.load(spark, path), "English", "Korean")
    assert sorted(r.text for r in work.collect()) == ["one", "three", "two"]
    for _ in range(2):  # a repeated run replaces its own folder
        memo.append(plan.mock_results(work, "English", "Korean"), path, 0)
    assert memo.stored_rows(spark, path).count() == 3
    assert plan.pending(docs, memo.load(spark, path), "English", "Korean").count() == 0
    done = plan.finish(docs, memo.load(spark, path), "English", "Korean")
    assert done.count() == 4 and done.where("translated IS NULL").count() == 0


def test_faults_keep_the_source(spark):
    import json as js

    docs = spark.createDataFrame([(1, "see http://a.test now\nplain words")], "doc_id bigint, text string")

    def dropping(segments):
        return js.dumps({"translations": [
            {"segment_id": s["seg_id"], "translated_text": s["text"].replace("⟦PH0⟧", "")} for s in segments]})

    rows = {r.pos: r for r in plan.translate(docs, "French", make_mapper=lambda: dropping).collect()}
    assert rows[0].failed and rows[0].error == "missing ⟦PH0⟧" and rows[0].translated == "see http://a.test now"
    assert not rows[1].failed and rows[1].translated == "plain words"


def test_document_plan_has_no_shuffle(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = plan.translate(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


def test_plain_exports_may_be_compressed(spark, tmp_path):
    import glob

    pairs = spark.createDataFrame([(1, "s", 1, 'a "b"', "x,\ny")], "doc_id bigint, segment_id string, page bigint, source string, translated string")
    for kind in ("csv", "json", "txt"):
        files.write_pairs(pairs, f"{tmp_path}/{kind}", kind, "gzip")
        assert glob.glob(f"{tmp_path}/{kind}/*.gz") and not glob.glob(f"{tmp_path}/{kind}/*.{kind}")
        files.write_pairs(pairs, f"{tmp_path}/{kind}", kind)
        assert glob.glob(f"{tmp_path}/{kind}/*.{kind}") and not glob.glob(f"{tmp_path}/{kind}/*.gz")
