"""Pieces, secrets, language and scores on texts that are odd, long, missing or repeated."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from folioflow.llm import ctw, language, pieces, secrets

ODD = [None, "", " ", "\n", "\t \x0b", "a", "▁ ▁▁", "<s> </s> <unk> <0x41>", "\x00\x01", "漢字 かな 😀", "é" * 300,
       "x" * 5000, "ab " * 3000, "　​", "İK ſ"]


def test_pieces_equal_the_library():
    model = pieces.read_model(None, None)
    table, lib = pieces.table_for(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(3)
    alphabet = list("abcdefghij  \n\t▁.,;éñ漢字😀\x00AZ09-_=/<>")
    made = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)]
    made += [" " * n + "a" for n in range(40)] + ["=" * n for n in range(90)]
    for text in [t or "" for t in ODD] + made:
        ids = lib.encode(text)
        assert table.encode(text) == ids, text
        assert table.decode(ids) == lib.decode(ids), text


def test_decode_broken_bytes_and_unknown():
    model = pieces.read_model(None, None)
    table, lib = pieces.table_for(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(5)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(3, 32000)]) for _ in range(rng.randint(0, 12))]
        assert table.decode(ids) == lib.decode(ids), ids


def test_pieces_frame(spark, docs_of):
    docs = docs_of([(i, t) for i, t in enumerate(ODD)] + [(1, "twice"), (1, "twice"), (None, "no id")])
    got = pieces.encode_pieces(docs).collect()
    assert len(got) == len(ODD) + 3
    nothing = brute.sha("")
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got if r.doc_id == 0] == [
        (0, nothing, nothing, [])]
    assert pieces.piece_digests(docs.limit(0)).count() == 0
    back = pieces.decode_pieces(pieces.encode_pieces(docs.where("doc_id = 9"))).first()
    assert back.decoded == ODD[9]


ASSIGN = re.compile(
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def plain_secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_base_secrets_by_definition(spark, sf):
    rng = random.Random(7)
    bits = ["password", "PassWD", "api_key", "apikey", "ſecret", "toKen", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678",
            "0123456789abcdef", "deadbeef", "x", "é", "\n", "😀", "abc.def-ghi"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for text in texts:
        assert secrets.base_spans(text) == plain_secrets(text), text


def test_linked_secrets(spark, docs_of):
    weak = "Q7f+kP0zX9vB2mN4cR8tY6wL1sD3"
    pair = f"client_id: acme-7 then {weak} here"
    rows = [(1, weak), (2, "client_id: acme-7"), (3, pair), (4, "client_id: acme-7\n\n" + weak),
            (5, f"user=bob postgres://db.test/x {weak}"), (6, "client_id: acme-7" + " " * 300 + weak), (7, None),
            (8, pair), (8, pair)]
    got = defaultdict(list)
    for r in secrets.scan_secrets(docs_of(rows)).collect():
        got[r.doc_id].append(r)
    linked = {d: r[0].n_linked for d, r in got.items()}
    assert linked == {1: 0, 2: 0, 3: 2, 4: 0, 5: 3, 6: 0, 7: 0, 8: 2} and len(got[8]) == 2
    assert got[7][0].base_sha256 == brute.sha("") and got[7][0].spans == ""
    assert secrets.redact(docs_of(rows)).where("doc_id = 3").first().redacted == "[secret] then [secret] here"
    many = " ".join(f"user=u{i} {hashlib.md5(str(i).encode()).hexdigest().upper()}" for i in range(4000))
    assert secrets.scan_secrets(docs_of([(1, many)])).first().n_linked >= 7900  # some digests lack variety


def test_language_edges(spark, docs_of):
    rows = [(i, "the quick brown fox and the lazy dog of that hill") for i in range(12)]
    docs = docs_of(rows + [(20, None), (21, ""), (22, "123 $$ 45"), (None, "the dog")])
    got = {r.doc_id: r for r in language.language_of(docs).collect()}
    assert {d: r.lang_pred for d, r in got.items()} == {
        **{i: "en" for i in range(12)}, 20: "und", 21: "und", 22: "und", None: "en"}
    assert got[20].score == 0 and not got[None].held_out
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.language_of(unlabelled).collect()} == {"und"}
    assert language.language_of(docs.limit(0)).count() == 0
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == 13


def brute_ctw(training, texts, depth):
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)

    def choices(text):
        raw = b"\xff" * depth + text.translate(brute.LOWER).encode() + b"\xff"
        for i in range(depth, len(raw)):
            for bit in range(8):
                yield raw[i - depth:i], (1 << bit) | raw[i] >> (8 - bit), raw[i] >> (7 - bit) & 1

    for text in training:
        for context, node, one in choices(text):
            for d in range(depth + 1):
                counts[context[depth - d:], node][one] += 1
    for context, node in counts:
        if context:
            children[context[1:], node].add((context, node))

    def kt(a):
        return math.lgamma(a[0] + .5) + math.lgamma(a[1] + .5) - 2 * math.lgamma(.5) - math.lgamma(sum(a) + 1)

    weighted = {}
    for key in sorted(counts, key=lambda k: -len(k[0])):
        own = kt(counts[key])
        weighted[key] = own if len(key[0]) == depth else np.logaddexp(
            own, sum(weighted[c] for c in children[key])) - math.log(2)

    def probability(context, node, one):
        p = None
        for d in range(depth, -1, -1):
            a = counts.get((context[depth - d:], node), [0, 0])
            own = (a[one] + .5) / (sum(a) + 1)
            share = math.exp(kt(a) - math.log(2) - weighted.get((context[depth - d:], node), 0.0))
            p = own if p is None else share * own + (1 - share) * p
        return p

    return [sum(math.log10(probability(*c)) for c in choices(t)) for t in texts]


def test_scores_by_definition(spark, docs_of):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choices(["tha", "Then", "ing", "é", "x\ny", "zz"], k=rng.randint(0, 30)))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "UNSEEN words ☃"), (7, "again"), (7, "again"), (None, "no id")]
    got = sorted(ctw.scores(docs_of(rows)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.score))
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    training = [t or "" for d, t in rows if d is None or not brute.held_out(d, 7)]
    counts = Counter(w for t in training for w in [*brute.WORD.findall(t.translate(brute.LOWER)), None])
    n, v = sum(counts.values()), len(counts)
    scores = {(d, t): s for (d, t), s in zip(rows, brute_ctw(training, [t or "" for _, t in rows], ctw.DEPTH))}
    texts = defaultdict(list)
    for d, t in want:
        texts[d].append(t)
    for r in got:
        assert min(abs(r.score - scores[r.doc_id, t]) for t in texts[r.doc_id]) < 1e-6
        text = min(texts[r.doc_id], key=lambda t: abs(r.score - scores[r.doc_id, t])) or ""
        tokens = [*brute.WORD.findall(text.translate(brute.LOWER)), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
    assert ctw.scores(docs_of(rows).limit(0)).count() == 0
    nobody = ctw.scores(docs_of([(1, "ab")]), learned=lambda k: False).first()
    assert nobody.train_tokens == 0 and nobody.score == pytest.approx(-24 * math.log10(2))


def test_groups_are_numbered_alike_with_and_without_the_table(monkeypatch):
    values = np.random.default_rng(1).integers(0, 2**32, 3000).astype(np.uint32)
    for some in (values, values % 70_000, values[:0]):
        found, at = np.unique(some, return_inverse=True)
        for cells in (1 << 26, 1):
            monkeypatch.setattr(ctw, "_TABLE", cells)
            a, b = ctw._numbered(some)
            assert (a == found).all() and (b == at).all()


def test_a_block_is_numbered_in_bounded_memory():
    import tracemalloc

    from folioflow.llm.blocks import squeeze

    rng = np.random.default_rng(3)
    texts = [bytes(t) for t in rng.integers(0x60, 0x98, (200, 10_000)).astype(np.uint8)]  # 3,136 halves: 10 million cells
    row = {"block": 0, "keys": list(range(200)), "ends": (np.arange(1, 201) * 10_000).tobytes(),
           "body": squeeze(b"".join(texts))}
    ctw._Seen(row, lambda k: True)  # imports
    tracemalloc.start()
    seen = ctw._Seen(row, lambda k: True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    every = np.concatenate([ctw.grams(t) for t in texts])
    assert (seen.grams[seen.gram_at] == every).all() and (np.diff(seen.grams.astype(np.int64)) > 0).all()
    assert most < 24 * len(every)
