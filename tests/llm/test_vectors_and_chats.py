"""Codes, hard negatives and chat formatting by their definitions, on odd tables too."""

import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import chat, negatives, quantize

VECTORS = "vec_id long, embedding array<float>, label int"


def odd_names(df):
    for name in ("key", "v", "_v", "_id", "id", "code", "n", "part", "label_error", "asks", "_asks", "_label", "bits", "planes",
                 "across", "down", "row", "conv", "body", "piece", "files", "at", "t", "parts", "read"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit("x"))
    return df


def some_vectors(rng, n, size=16, spread=1.0, labels=4):
    return [(i, [float(np.float32(rng.gauss(0, spread))) for _ in range(size)], rng.randrange(labels)) for i in range(n)]


def whole(v, scale):
    return [int(np.floor(np.float64(np.float32(x)) * scale)) for x in v]


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """{row number: (code, error, label_error)} and the digest."""
    kept = {i: whole(r[1], 1024) for i, r in enumerate(rows) if usable(r[1])}
    size = -(-max(map(len, kept.values())) // parts)
    kept = {i: v + [0] * (size * parts - len(v)) for i, v in kept.items()}
    firsts = {}
    for i, v in kept.items():
        if rows[i][0] is not None:
            firsts[rows[i][0]] = min(firsts.get(rows[i][0], v), v)
    books = [[firsts[k][p * size:(p + 1) * size] for k in sorted(firsts)[:entries]] for p in range(parts)]

    def nearest(book, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            mine = {}
            for v in kept.values():
                part = v[p * size:(p + 1) * size]
                mine.setdefault(nearest(book, part)[1], []).append(part)
            for j, got in mine.items():
                book[j] = [sum(c) // len(got) for c in zip(*got)]
    found = {i: [nearest(b, v[p * size:(p + 1) * size]) for p, b in enumerate(books)] for i, v in kept.items()}
    error = {i: sum(d for d, _ in f) for i, f in found.items()}
    total = {}
    for i, e in error.items():
        total[rows[i][2]] = total.get(rows[i][2], 0) + e
    fit = {k: e if e < 2**63 else None for k, e in total.items()}
    digest = brute.sha(",".join(str(x) for b in books for e in b for x in e))
    return {i: ("".join(f"{j:02x}" for _, j in f), error[i] if error[i] < 2**63 else None, fit[rows[i][2]])
            for i, f in found.items()}, digest


def check_codes(spark, rows, schema=VECTORS, **options):
    df = odd_names(spark.createDataFrame(rows, schema).repartition(3))
    got = quantize.compress(df, **options).collect()
    want, digest = brute_codes(rows, **options)
    told = sorted(((r.vec_id is None, r.vec_id or 0, r.code, r.error, r.label_error) for r in got), key=repr)
    assert told == sorted(((rows[i][0] is None, rows[i][0] or 0, *w) for i, w in want.items()), key=repr)
    assert {r.codebooks_sha256 for r in got} == {digest}


def test_codes_by_definition(spark):
    rng = random.Random(1)
    rows = some_vectors(rng, 120)
    rows += [(500, None, 1), (501, [1.0, None] * 8, 1), (502, [float("nan")] * 16, 2), (503, [float("inf")] * 16, 2),
             (504, [0.5] * 7, None), (505, [], None), (None, [0.25] * 16, 3), (3, [0.125] * 16, 1), rows[7], rows[7]]
    check_codes(spark, rows, entries=24)
    check_codes(spark, rows, entries=256, rounds=1)
    check_codes(spark, rows[:1])
    check_codes(spark, [(i, [0.5, -0.5], None) for i in range(40)])
    assert quantize.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert quantize.compress(spark.createDataFrame([(1, None, 2)], VECTORS)).count() == 0
    assert quantize.compress(spark.createDataFrame([(None, [1.0, 2.0], 2)], VECTORS)).count() == 1


def test_codes_of_huge_numbers(spark):
    rng = random.Random(2)
    rows = some_vectors(rng, 60, size=8)
    check_codes(spark, [*rows, (70, [2e7] * 8, 1), (71, [3e38, -3e38] * 4, 2)], entries=16)
    check_codes(spark, [(-1, [1e30] * 8, 0), (-2, [-5e18] + [0.0] * 7, 1), *rows], entries=16)
    check_codes(spark, [(i, [x * 1e9 for x in v], la) for i, v, la in rows], entries=16)
    wide = [(1, [1e300, -1e307, 1.0], 1), (2, [float(2**52), 0.5, -0.5], 1), (3, [0.0, 1.0, 2.0], None)]
    got = quantize.compress(spark.createDataFrame(wide, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(r.vec_id for r in got) == [2, 3]


def test_limb_products_are_exact():
    rng = np.random.default_rng(3)
    for bits in (4, 12, 20, 26):
        a, b = rng.integers(-2**bits, 2**bits, (40, 64)), rng.integers(-2**bits, 2**bits, (30, 64))
        assert (quantize.exact_products(a, b) == a @ b.T).all()
    top = np.full((2, 16), 2**28 - 1)
    assert (quantize.exact_products(top, -top) == top @ -top.T).all()
    assert [quantize._unpacked(x) for x in quantize._packed([0, -1, 2**62, -(2**62), 10**40, -(10**40)])] == [
        0, -1, 2**62, -(2**62), 10**40, -(10**40)]


def test_a_round_sends_rows_by_task_and_entry_only(spark):
    rows = some_vectors(random.Random(4), 2000)
    sent = []
    for n in (500, 2000):
        vectors = quantize.finite_vectors(spark.createDataFrame(rows[:n], VECTORS).repartition(2), "vec_id", "embedding", 1024)
        got = quantize.used_entries(vectors, quantize.train(vectors, entries=8, rounds=0)).collect()
        assert sum(r.n for r in got) == 4 * n
        sent.append(len(got))
    assert sent == [64, 64]


def brute_negatives(rows, is_anchor, relabel=lambda i, la: la, k=5, m=3, low=50, high=95):
    known = {}
    for i, v, la in rows:
        if i is not None and la is not None and usable(v):
            one = relabel(i, la), [float(np.float32(x)) for x in v]
            known[i] = min(known.get(i, one), one)
    numbers = {i: (la, whole(v, 256)) for i, (la, v) in known.items()}
    out = []
    for a in (i for i in numbers if is_anchor(i)):
        la, va = numbers[a]
        score = {i: max(1 - 2**63, min(2**63 - 1, sum(x * y for x, y in zip(va, v)))) for i, (_, v) in numbers.items()}
        order = sorted(numbers, key=lambda i: (-score[i], i))
        for p in [i for i in order if i != a and numbers[i][0] == la][:k]:
            good = [i for i in order if numbers[i][0] != la and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, r + 1, n, score[p], score[n]) for r, n in enumerate(good[:m])]
    return sorted(out)


def check_negatives(spark, rows, **options):
    df = odd_names(spark.createDataFrame(rows, VECTORS).repartition(3))
    got = negatives.mine(df, F.col("vec_id") % 5 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    told = sorted(tuple(r) for r in got.collect())
    assert told == brute_negatives(rows, lambda i: i % 5 == 0, k=options.get("positives", 5), m=options.get("negatives", 3),
                                   low=options.get("low", 50), high=options.get("high", 95))
    return told


def test_negatives_by_definition(spark, monkeypatch):
    rng = random.Random(5)
    rows = some_vectors(rng, 150, size=13)
    rows += [(i + 150, v, la) for i, v, la in rows[:30]]  # ties
    rows += [(900, None, 1), (905, [1.0, None], 1), (910, [float("nan")] * 3, 2), (915, [1.0] * 13, None), (None, [1.0] * 13, 1),
             (920, [1.5] * 5, 1), (925, [], 1), (10, [9.0] * 13, 0), rows[3], rows[3], (-5, [0.5] * 13, 2), (930, [2.0] * 13, -3)]
    assert len(check_negatives(spark, rows)) > 100
    check_negatives(spark, rows, positives=2, negatives=7, low=-20, high=200)
    monkeypatch.setattr(negatives, "CHUNK", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 16)
    monkeypatch.setattr(negatives, "BLOCK", 3)
    check_negatives(spark, rows)
    one_label = [(i, v, 7 if i % 3 else la) for i, v, la in rows if i is not None]
    check_negatives(spark, one_label)
    assert check_negatives(spark, rows[:1]) == []
    assert negatives.mine(spark.createDataFrame([], VECTORS), F.col("vec_id") % 5 == 0).count() == 0


def test_negatives_of_huge_numbers(spark):
    rows = some_vectors(random.Random(6), 60, size=9)
    rows += [(65, [2e7] * 9, 1), (66, [1.9e7] * 9, 2), (67, [3e9] * 9, 1), (68, [2.5e9] * 9, 3), (70, [3e38] * 9, 1),
             (71, [-3e38] * 9, 2), (72, [2e38] * 9, 2), (75, [1e15] + [0.0] * 8, 3)]
    assert check_negatives(spark, rows)


def test_lookups_give_inner_products():
    rng = np.random.default_rng(7)
    for size, planes, bits in ((1, 4, 4), (8, 12, 12), (13, 10, 20), (64, 30, 28), (9, 64, 40)):
        a = rng.integers(-2 ** (bits - 1), 2 ** (bits - 1), (5, size))
        b = rng.integers(-2 ** (min(planes, 50) - 1), 2 ** (min(planes, 50) - 1), (11, size))
        kind = negatives._kind(size, planes, bits)
        got = negatives.scores(negatives.bit_planes(b, planes), negatives.subset_sums(a.astype(object) if kind is object else a, kind))
        assert (got == b.astype(object) @ a.astype(object).T).all()


def parse(formatted):
    """Turns of a formatted conversation, by a reader of its own."""
    assert formatted.startswith("<s>") and formatted.endswith("</s>")
    out = []
    for piece in formatted[3:].split("</s>")[:-1]:
        role = "assistant"
        if piece.startswith("[INST]"):
            role, body = piece[6:].split("[ROLE]", 1)
            assert body.endswith("[/INST]")
            piece = body[:-7]
        texts = re.split(r"\[(?:TEXT|IMAGE|AUDIO|DOCUMENT|FILE)\]", piece)
        out.append(tuple(re.sub(r"\\(.)", r"\1", t, flags=re.S) for t in (role, "".join(texts))))
    return out


def tricky_texts(rng, n):
    bits = [*chat.CONTROLS, "\\", "\\\\", "<", "/s>", "[", "INST]", "[IMA", "GE]", "\n", "é", "😀", "", "word ", "</s", "<\\s>"]
    return ["".join(rng.choices(bits, k=rng.randrange(8))) for _ in range(n)]


def test_chats_come_back(spark):
    rng = random.Random(8)
    texts = tricky_texts(rng, 300)
    roles = ["user", "assistant", "system", "", "a[ROLE]b\n", "assistant ", "[INST", None]
    rows = [(i // 7, i % 7, rng.choice(roles), t) for i, t in enumerate(texts)]
    rows += [(900, 1, "assistant", None), (900, None, "user", None), (None, 3, "user", "x"), (901, 0, "user", "y" * 400_000),
             (902, 1, "user", "same"), (902, 1, "user", "same"), (902, 1, "assistant", "tie")]
    df = odd_names(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4))
    by_conv = {}
    for c, t, r, x in rows:
        by_conv.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    chats = chat.format_chats(df)
    formatted = {r.conv_id: r.formatted for r in chats.collect()}
    read = {r.conv_id: r for r in chat.read_chats(chats).collect()}
    digests = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    assert formatted.keys() == by_conv.keys() == digests.keys()
    for c, turns in by_conv.items():
        want = [(r, x) for _, _, r, x in sorted(turns)]
        assert parse(formatted[c]) == want == [(t.role, t.text) for t in read[c].read]
        loss = [x for r, x in want if r == "assistant" and x]
        assert list(read[c].loss) == loss
        assert digests[c][1:] == (len(want), brute.sha("".join(f"{r}\n{x}\n" for r, x in want)), len("".join(loss)),
                                  brute.sha("".join(loss)), len(formatted[c]))


def test_parts_are_flattened_in_order(spark):
    def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
        return kind, text, ref, width, height, seconds, pages

    rows = [(1, 0, "user", [part("image", ref="u1", width=56, height=57), part("text", "cap[IMA"), None, part("text", "GE]"),
                            part("audio", ref="a1", seconds=2.5), part("video", ref="v"), part(None, "plain")]),
            (1, 1, "assistant", [part("text", "ok"), part("document", ref="d", pages=3)]), (1, 2, "user", None), (2, 0, "user", []),
            (3, 0, "user", [part("image"), part("audio", seconds=float("nan")), part("document", pages=-4), part("image", width=-1, height=29)])]
    df = odd_names(spark.createDataFrame(rows, f"conv_id long, turn long, role string, text array<{chat.PART}>"))
    chats = chat.format_chats(df)
    got = {r.conv_id: r for r in chats.collect()}
    assert got[1].formatted == ("<s>[INST]user[ROLE][IMAGE][TEXT]cap[IMA[TEXT]GE][AUDIO][FILE][TEXT]plain[/INST]</s>ok[DOCUMENT]</s>"
                                "[INST]user[ROLE][/INST]</s>")
    assert [tuple(a) for a in got[1].attachments] == [(0, "image", "u1", 6), (0, "audio", "a1", 63), (0, "video", "v", 1),
                                                      (1, "document", "d", 768)]
    assert [a.tokens for a in got[3].attachments] == [1, 0, 256, 2]
    for r in got.values():
        for t in r.turns:
            assert r.formatted[t.loss_start:t.loss_start + t.loss_length] in ("", "ok[DOCUMENT]")
        assert len(re.findall(r"\[(?:IMAGE|AUDIO|DOCUMENT|FILE)\]", r.formatted)) == len(r.attachments)
    read = {r.conv_id: r for r in chat.read_chats(chats).collect()}
    assert [(p.kind, p.text) for p in read[1].read[0].parts] == [
        ("image", None), ("text", "cap[IMA"), ("text", "GE]"), ("audio", None), ("other", None), ("text", "plain")]
    assert [[t.text for t in read[c].read] for c in (1, 2, 3)] == [["cap[IMAGE]plain", "ok", ""], [""], [""]]
    assert chat.format_chats(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "<s>", "<\\s>", "[INST][INST]"])
def test_escape_leaves_no_control_string(spark, text):
    row = spark.range(1).select(chat.escape(F.lit(text)).alias("e"), chat.unescape(chat.escape(F.lit(text))).alias("u")).first()
    assert row.u == text and not any(c in row.e for c in chat.CONTROLS)


def test_neighbours_of_huge_numbers(spark):
    from folioflow.llm import neighbours

    rng = random.Random(9)
    rows = some_vectors(rng, 90, size=6)
    rows += [(100, [2e7] * 6, 1), (101, [-2e7] * 6, 1), (102, [3e38] * 6, 2), (103, [65536.0] * 6, 1), (104, [65535.5] * 6, 1), (105, [1e13, -5.0], 0)]
    numbers = {i: whole(v, 256) for i, v, _ in rows}
    for vectors in (rows, rows[-3:], rows[-6:-5]):
        df = odd_names(spark.createDataFrame(vectors, VECTORS).repartition(3))
        got = sorted(tuple(r) for r in neighbours.top_k(df, F.col("vec_id") % 5 == 0).collect())
        want = []
        for q in sorted(i for i, _, _ in vectors if i % 5 == 0):
            score = {i: max(1 - 2**63, min(2**63 - 1, sum(a * b for a, b in zip(numbers[q], numbers[i])))) for i, _, _ in vectors if i != q}
            want += [(q, n + 1, i, score[i]) for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:5])]
        assert got == sorted(want)
