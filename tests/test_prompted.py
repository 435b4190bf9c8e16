"""The mapper's context, glossary and prompt, beside the column expressions for them."""

import json
import random

from pyspark.sql import functions as F

from folioflow.functions import prompts
from folioflow.plans import prompted

ALL = "|".join("{{" + m + "}}" for m in ("source_language", "target_language", "glossary_data", "document_title", "prev_context", "text_segments"))


def test_prompts_equal_the_expressions(spark):
    rng = random.Random(3)
    rows = []
    for n in range(40):
        pairs = [("s" * rng.randrange(1, 300), "t" * rng.randrange(300)) for _ in range(rng.randrange(13))]
        rows.append((n, pairs, [(f"id{i}", f"text {i}") for i in range(rng.randrange(1, 4))], rng.choice(["auto", "French", " Auto-Detect "])))
    df = spark.createDataFrame(rows, "n int, pairs array<struct<source: string, target: string>>, segments array<struct<seg_id: string, text: string>>, lang string")
    none = {k: F.lit("") for k in ("doc_type", "style", "terminology", "domain", "instructions")}
    got = df.select("n", prompts.user_prompt(
        F.lit(ALL), source_lang=F.col("lang"), target_lang=F.lit("Korean"), glossary=F.lit("a => b"), context=prompts.context_block(F.col("pairs")),
        segments=F.col("segments"), settings={**none, "title": F.lit("{{prev_context}}")}).alias("p")).collect()
    for r, (n, pairs, segments, lang) in zip(sorted(got), rows):
        settings = prompted.Prompting(ALL, source_language=lang, document_title="{{prev_context}}")
        mine = prompted.prompt_of(settings, [{"seg_id": s, "text": t} for s, t in segments], prompted.context_text(pairs), ["a => b"])
        assert mine == r.p, n


def test_context_follows_a_document_and_not_the_next(spark):
    docs = spark.createDataFrame([(d, "\n".join(f"line {i} of {d}" for i in range(35))) for d in range(6)] + [(9, None), (10, "")],
                                 "doc_id bigint, text string").repartition(2)

    def make():
        def answer(request):
            seen = request["context"]
            mine = request["segments"][0]["source"].split()[-1]
            assert all(a.split()[-1] == mine and b.endswith(a) for a, b in seen) and request["glossary"] in ([], ["line 33 => l"])
            if "line 10 " in request["segments"][0]["source"]:
                raise ValueError("down")
            return json.dumps({"translations": [{"segment_id": s["seg_id"], "translated_text": f"{len(seen)} {s['text']}"} for s in request["segments"]]})

        return answer

    from folioflow.plans.translate import Options

    plain = Options(placeholders=False, validation=False)
    rows = prompted.translate_prompted(docs, make, prompted.Prompting("{{text_segments}}"), {"line 33": "l"}, options=plain).collect()
    assert len(rows) == 6 * 35
    for r in rows:
        if r.batch_id == 1:
            assert r.failed and r.error == "down"
        else:
            assert r.translated.split()[0] == {0: "0", 2: "10", 3: "12"}[r.batch_id]
