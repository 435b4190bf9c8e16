"""Jobs done whole: parts, languages and documents that earlier rules left out."""

import random

import brute
import pytest
from pyspark.sql import functions as F

from folioflow.llm import blocks, language, secrets, suffixes

WEAK = "Q7f+kP0zX9vB2mN4cR8tY6wL1sD3"


def linked(text):
    return [text[s:e] for s, _, e in secrets.linked_spans(text, secrets.base_spans(text))]


def test_parts_of_all_kinds_complement_each_other(spark, docs_of):
    url = "https://api.acme.com/v1"
    assert linked(f"{url} {WEAK}") == [url, WEAK]
    assert linked(f"login: acme-7 {url}") == ["login: acme-7", url]
    assert linked(f"{url} {url}") == linked(f"{WEAK} {WEAK}") == linked("login: acme-7 user=bob") == []
    assert secrets.redact(docs_of([(1, f"{url} {WEAK}.")])).first().redacted == "[secret] [secret]."


def test_linked_parts_have_any_length():
    for n in (6, 60, 20_000):
        assert linked(f"client_id: acme-7 {WEAK * n}") == ["client_id: acme-7", WEAK * n]
        assert linked(f"client_id: acme{'-7' * n} {WEAK}") == [f"client_id: acme{'-7' * n}", WEAK]
        assert linked(f"https://a.b/{'x/' * n} {WEAK}") == [f"https://a.b/{'x/' * n}", WEAK]


def test_lines_of_a_scope_belong_together():
    between = "\n".join(f"# note {i} on the settings that follow" for i in range(40))
    assert linked(f"client_id: acme-7\n{between}\n{WEAK}") == ["client_id: acme-7", WEAK]
    assert linked(f"{WEAK}\n{between}\nclient_id: acme-7") == [WEAK, "client_id: acme-7"]
    assert linked(f"client_id: acme-7\n{between}\n \t\n{WEAK}") == []
    assert linked("client_id: acme-7" + " x" * 150 + WEAK) == []


def test_texts_stay_where_no_language_could_be_learned(spark, docs_of):
    docs = docs_of([(i, "the quick brown fox") for i in range(20)] + [(20, None), (21, ""), (22, "12 $$"), (23, "x")])
    want = [*range(20), 23]
    for frame in (docs.withColumn("lang", F.lit(None).cast("string")),
                  docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("en")))):
        assert sorted(r.doc_id for r in language.keep_identified(frame).collect()) == want


@pytest.mark.parametrize("block_bytes", [2_000, 4 << 20])
def test_a_hot_anchor_is_parted(spark, docs_of, monkeypatch, block_bytes):
    monkeypatch.setattr(suffixes, "HOT_STRINGS", 200)
    monkeypatch.setattr(suffixes, "_SORT_ROWS", 100)
    pack = suffixes.pack
    monkeypatch.setattr(suffixes, "pack", lambda d, k, t, n, _: pack(d, k, t, n, block_bytes))
    rng = random.Random(3)
    phrase = "a phrase that many documents hold"

    def own(n):
        return "".join(rng.choices("abcdefghij", k=n))

    ends = [own(30) for _ in range(12)]
    rows = [(i, own(40) + rng.choice(ends) + phrase + rng.choice([own(30), *ends]) + own(20)) for i in range(300)]
    rows += [(i, rows[i - 300][1]) for i in range(300, 320)] + [(900, None), (-3, rows[5][1][20:120])]
    docs = docs_of(rows)
    want = brute.substring_dedup({d: (t or "").encode() for d, t in rows})
    for r in suffixes.dedup_report(docs).collect():
        removed, runs, kept = want[r.doc_id]
        assert (r.n_removed, r.n_spans, r.kept_sha256) == (removed, runs, brute.sha(kept)), r.doc_id
    packed = blocks.pack(docs, "doc_id", "text", "hot", block_bytes)
    sent = suffixes._sent(packed, suffixes._splitters(packed)).groupBy("shard").agg(
        F.sum(F.length("keys") / 8).alias("n")).where("shard < 0").collect()
    assert len(sent) > 5 and max(r.n for r in sent) < 400


def test_every_labelled_language_is_learned(spark):
    rng = random.Random(8)
    said = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60)) for _ in range(230)]
    rows = spark.createDataFrame([(n * 230 + i, t, f"l{i:03}") for n in range(2) for i, t in enumerate(said)],
                                 "doc_id long, text string, lang string")
    model = language.train(rows)
    assert model.languages == [f"l{i:03}" for i in range(230)]
    assert max(map(len, model.families)) <= language.FAMILY
    assert sum(model.predict(language.features(t))[0] == f"l{i:03}" for i, t in enumerate(said)) >= 225


def test_number_signs_are_no_letters(spark):
    for text in ("²½", "Ⅷ ①", "١٢٣ ४५", "́̈", "12 _ $", ""):
        assert language.features(text) is None, text
    for text in ("²a", "日", "ª", "Ⅷ ж"):
        assert language.features(text) is not None, text
    rows = [(i, "the quick brown fox", "en") for i in range(40)] + [(90, "²½", None), (91, None, "en"), (92, "Ⅷ", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language.language_of(df).collect()}
    assert {d: p for d, p in got.items() if p != "en"} == {90: "und", 91: "und", 92: "und"}
    assert {r.doc_id for r in language.keep_identified(df).collect()} == set(range(40))


def test_learning_without_keys_and_from_one_key(spark):
    rng = random.Random(12)
    words = {"en": "the and of to in is that for it was".split(), "de": "der die und in den von zu das mit sich".split()}
    said = [(la, " ".join(rng.choices(w, k=12))) for la, w in words.items() for _ in range(1500)]
    for key in (None, 5):
        df = spark.createDataFrame([(key, t, la) for la, t in said] + [(key, "the and of", "en")] * 2000, "doc_id long, text string, lang string")
        model = language.train(df)
        assert model.languages == ["de", "en"]
        assert sum(model.predict(language.features(t))[0] == la for la, t in said) > 2900


def test_pieces_with_a_small_memory(spark, docs_of, monkeypatch):
    import sentencepiece

    from folioflow.llm import pieces

    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rng = random.Random(14)
    bits = ["word", "▁", " ", "  ", "\n", "😀", "é", "\x00", "日本", "x" * 70, "�", "ab" * 40 + "😀", ""]
    digests = pieces._digests(type("Model", (), {"value": open(pieces.default_model(), "rb").read()}), with_ids=True)
    for _ in range(400):
        text = "".join(rng.choices(bits, k=rng.randrange(12)))
        ids = lib.encode(text)
        n, ids_sha, decoded_sha, got = digests(text)
        assert (n, got.tolist()) == (len(ids), ids), text
        assert (ids_sha, decoded_sha) == (brute.sha(",".join(map(str, ids))), brute.sha(lib.decode(ids))), text
