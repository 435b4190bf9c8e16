"""The registered queries on whole small tables, beside their SQL or brute force."""

import brute
import pytest
import sentencepiece
from compare import connect, difference

from folioflow.llm.pieces import default_model
from folioflow.llm.registry import load_queries

ENTRIES = load_queries()


@pytest.fixture(scope="module")
def texts(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def items(spark, sf):
    return {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}


@pytest.mark.parametrize("name", [n for n, e in ENTRIES.items() if e.sql])
def test_agrees_with_sql(spark, sf, name):
    assert difference(spark, connect(sf), ENTRIES[name], sf) is None


def test_all_operators_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in names


def test_pieces(spark, sf, texts):
    lib = sentencepiece.SentencePieceProcessor(model_file=default_model())
    got = {r.doc_id: r for r in ENTRIES["op3_pieces"].run(spark, sf).collect()}
    for d, text in texts.items():
        ids = lib.encode(text or "")
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == (
            len(ids), brute.sha(",".join(map(str, ids))), brute.sha(lib.decode(ids)))


def test_simhash(spark, sf, texts):
    prints = {d: brute.fingerprint(t) for d, t in texts.items()}
    group = brute.groups(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in ENTRIES["op6_simhash"].run(spark, sf).collect()}
    assert got == {d: (f"{prints[d]:016x}", group[d]) for d in texts}


def test_suffixes(spark, sf, texts):
    want = brute.substring_dedup({d: (t or "").encode() for d, t in texts.items()})
    for r in ENTRIES["op8_suffixes"].run(spark, sf).collect():
        removed, runs, kept = want[r.doc_id]
        assert (r.n_removed, r.n_spans, r.kept_sha256) == (removed, runs, brute.sha(kept))


def test_language_on_held_out_rows(spark, sf):
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = ENTRIES["op10_language"].run(spark, sf).collect()
    assert all(r.held_out == brute.held_out(r.doc_id, 4) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == true[r.doc_id] for r in held) >= 0.95 * len(held)


def test_pipeline(spark, sf, texts, items):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language", "lines", "near_duplicates", "decontamination", "pieces"]
    left = {d: t for d, t in texts.items() if t and any(c.isalpha() for c in t)}
    left = {d: kept for d, (_, kept) in brute.line_dedup(left).items()}
    group = brute.groups({d: brute.fingerprint(t) for d, t in left.items()})
    left = {d: t for d, t in left.items() if group[d] == d}
    hits = brute.bench_hits(left, items)
    left = {d: t for d, t in left.items() if not hits[d][1]}
    lib = sentencepiece.SentencePieceProcessor(model_file=default_model())
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == set(left)
    for d, text in left.items():
        ids = lib.encode(text)
        assert list(got[d].ids) == ids and got[d].decoded_sha256 == brute.sha(lib.decode(ids))
