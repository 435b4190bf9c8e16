import random
import re
import time

import pytest
from pyspark.sql import functions as F

from folioflow.functions import tokens
from folioflow.functions.text import normalize_one

SAMPLES = [
    "go to https://a.test/x?y=1 now",
    "mail joe.d@site.test or @joe about #launch",
    "a **bold [link](http://b.test)** end",
    "``x` y` `z`",
    "<p>hi</p> ```code `in` it``` _a_ __b__ *c*",
    "https://user@host.test/path",
    "plain text",
    "",
    "![alt](u) 한글 😀　wide",
]


@pytest.mark.parametrize("text", SAMPLES)
def test_round_trip(text):
    p = tokens.protect_one(text)
    assert tokens.restore_one(p["text"], p["held"], p["terms"]) == {"text": text, "error": None}


def test_kinds_and_numbers():
    assert tokens.protect_one("see http://a.test") == {
        "text": "see ⟦PH0⟧", "held": ["http://a.test"], "terms": []}
    nested = tokens.protect_one("a **bold [x](http://b.test)** c")
    assert nested["text"] == "a ⟦PH1⟧ c"
    assert nested["held"] == ["[x](http://b.test)", "**bold ⟦PH0⟧**"]
    # a swap completes an earlier match, so the search starts over
    assert tokens.protect_one("``x` y` `z`")["held"] == ["`x`", "`⟦PH0⟧ y`", "`z`"]
    # mail addresses come before links
    assert tokens.protect_one("https://u@h.test/p")["held"] == ["u@h.test", "https://⟦PH0⟧/p"]


def test_glossary_terms_longest_first():
    terms = tokens.longest_first({"net": "망", "network": "네트워크", "": "x"})
    p = tokens.protect_one("network net network", terms)
    assert p["text"] == "⟦GL0⟧ ⟦GL2⟧ ⟦GL1⟧"
    assert tokens.restore_one(p["text"], p["held"], p["terms"])["text"] == "네트워크 망 네트워크"


def test_restore_errors():
    assert tokens.restore_one("gone", ["x"], [])["error"] == "missing placeholder ⟦PH0⟧"
    assert tokens.restore_one("⟦PH0⟧ ⟦PH5⟧", ["x"], [])["error"] == "unresolved placeholder ⟦PH5⟧"
    assert tokens.restore_one("", [], ["x"])["error"] == "missing glossary placeholder ⟦GL0⟧"
    assert tokens.restore_one("⟦GL3⟧", [], [])["error"] == "unresolved glossary placeholder ⟦GL3⟧"


def test_token_checks_and_maps(spark):
    rows = spark.createDataFrame(
        [("⟦PH0⟧ ⟦PH1⟧", "⟦PH1⟧", "missing ⟦PH0⟧"), ("⟦PH0⟧", "⟦PH0⟧⟦PH0⟧", "duplicated ⟦PH0⟧"),
         ("⟦PH0⟧", "⟦PH0⟧⟦GL4⟧", "hallucinated ⟦GL4⟧"), ("⟦PH0⟧", "x ⟦PH0⟧", None)],
        "a string, b string, want string")
    got = rows.withColumn("got", tokens.token_error(F.col("a"), F.col("b")))
    assert got.where("NOT got <=> want").count() == 0
    raws = spark.createDataFrame([([str(n) for n in range(12)],)], "r array<string>")
    back = raws.select(tokens.from_token_map(tokens.token_map("PH", F.col("r"))).alias("r"))
    assert back.first()[0] == [str(n) for n in range(12)]


def test_own_terms_path_equals_small_path(spark):
    from folioflow.operators import glossary

    terms = {"net": "망", "network": "네트워크", "work": "일", "abc": "가", "GL": "나", "0": "영", "PH": "다", "⟦": "괄"}
    t = spark.createDataFrame([(s, g, i) for i, (s, g) in enumerate(terms.items())],
                              "source string, target string, ord int")
    texts = spark.createDataFrame([(1, "network work net"), (2, "none"), (3, "networknet"),
                                   (4, "abc xyz"), (5, "GL0 PH1 abc0"), (6, "a ⟦GL0⟧ b")],
                                  "id int, text string")
    found = glossary.contained_terms(texts, t, "id")
    own = texts.join(glossary.own_terms(found, "id"), "id", "left")
    large = own.select("id", tokens.protect_with_terms("text", "terms").alias("p"))
    small = texts.select("id", tokens.protector(terms)("text").alias("p"))
    assert sorted(large.collect()) == sorted(small.collect())
    back = large.where("id <> 6").withColumn("r", tokens.restore("p.text", "p.held", "p.terms"))
    assert back.where("r.error IS NOT NULL").count() == 0
    assert {r.id: r.r.text for r in back.collect()}[4] == "가 xyz"


@pytest.mark.parametrize("raw,want", [
    ("a   b\t c", "A".lower() + " b c"), ("“q” ‘r’", "\"q\" 'r'"), ("a\n\n\n\nb", "a\n\nb"),
    ("end. next! so", "end. Next! So"), ("x ⟦PH0⟧ .", "x ⟦PH0⟧."), ("ＡＢ（c）", "AB(c)"), ("", ""), (None, None),
])
def test_normalize(raw, want):
    assert normalize_one(raw) == want


def stepwise(text):
    """Literals swapped one at a time, each pattern searched from the start after every swap."""
    from folioflow import constants as K

    held = []
    for _, pattern in K.PROTECTED_PATTERNS:
        while found := re.search(pattern, text):
            token = K.TOKEN_FORMAT % ("PH", len(held))
            held.append(found[0])
            text = text[:found.start()] + token + text[found.end():]
    return {"text": text, "held": held, "terms": []}


def test_one_pass_equals_the_search_from_the_start():
    rng = random.Random(31)
    signs = ["`", "``", "```", "[", "]", "(", ")", "](", "<", ">", "@", ".", "http://", "https://", "#", "*", "**", "_", "__", "\n", " ", "a", "b1", "⟦PH0⟧", "'"]
    swapped = 0
    for _ in range(20_000):
        text = "".join(rng.choices(signs, k=rng.randrange(1, 16)))
        got = tokens.protect_one(text)
        assert got == stepwise(text), text
        swapped += len(got["held"]) > 2
    assert swapped > 500
    ticks = ["`", "`", "`", "a", " ", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choices(ticks, k=rng.randrange(1, 24)))
        assert tokens.protect_one(text) == stepwise(text), text


def test_many_literals_in_a_long_text():
    parts = ["see [a](http://x.test/%d) and `code %d` or ``y` z` u%d@x.test @n%d" % (i, i, i, i) for i in range(20_000)]
    start = time.perf_counter()
    p = tokens.protect_one("\n".join(parts))
    q = tokens.protect_one(" ".join(parts).replace("``", "`"))
    assert time.perf_counter() - start < 20 and len(p["held"]) > 80_000 and len(q["held"]) > 60_000


@pytest.mark.parametrize("shard_bytes", [1 << 20, 4000])
def test_a_large_glossary_finds_the_same(spark, monkeypatch, shard_bytes):
    from folioflow.operators import glossary

    monkeypatch.setattr(glossary, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(glossary, "BLOCK_BYTES", 3000)
    rng = random.Random(32)
    letters = "abcd é한😀"
    sources = sorted({"".join(rng.choices(letters, k=rng.randrange(1, 7))) for _ in range(3000)})
    texts = [(i, "".join(rng.choices(letters, k=rng.randrange(60)))) for i in range(150)] + [(900, None), (901, ""), (None, "abcd")]
    terms = spark.createDataFrame([(s, f"t{n}", n) for n, s in enumerate(sources)] + [("", "x", -1), ("ab", "second", -2)],
                                  "source string, target string, ord int")
    df = spark.createDataFrame(texts, "id int, text string")
    got = sorted((r.id is None, r.id or 0, r.source, r.target) for r in glossary.contained_terms(df, terms, "id").collect())
    pairs = [(s, f"t{n}") for n, s in enumerate(sources)] + [("ab", "second")]
    assert got == sorted((i is None, i or 0, s, t) for i, x in texts if x for s, t in pairs if s in x)
    assert glossary.contained_terms(df, terms.limit(0), "id").count() == 0


def test_protect_with_a_hundred_thousand_terms():
    terms = {f"term {i}": f"t{i}" for i in range(100_000)}
    finder = tokens.TermFinder(terms)
    text = "a term 77777 and term 12, term 5x"
    assert [s for s, _ in finder.within(text)][:2] == ["term 77777", "term 7777"]
    assert tokens.protect_one(text, finder.within(text)) == tokens.protect_one(text, finder.ordered)
