"""Lines, near-duplicates, substrings, benchmark windows, licences and vectors on awkward tables."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import decontam, licenses, lines, neighbours, simhash, suffixes
from folioflow.llm.components import components

LONG = "a line that is certainly long enough to count"


def test_lines(spark, docs_of):
    rng = random.Random(2)
    pool = [LONG, LONG.upper() + "  ", "\t" + LONG, "short", "", "é" * 20, "é" * 19, "w" * 90_000, "once " * 9, "\x1f" + LONG]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 7)))) for i in range(60)] + [(60, None), (61, "")]
    want = brute.line_dedup(dict(rows))
    docs = docs_of(rows)
    got = {r.doc_id: (r.n_dropped, r.kept_sha256) for r in lines.dedup_report(docs).collect()}
    assert got == {d: (n, brute.sha(kept)) for d, (n, kept) in want.items()}
    kept = lines.dedup_lines(docs)
    assert kept.columns == docs.columns
    for r in kept.collect():
        assert (r.text or "") == want[r.doc_id][1] and (r.doc_id != 60 or r.text is None)
        assert r.n_chars == (None if r.text is None else len(r.text))
    # every row is a document: two rows of one id and a third make three, and both keep
    rows = [(5, LONG), (5, LONG), (None, LONG)]
    assert sorted((r.doc_id or -1, r.n_dropped) for r in lines.dedup_report(docs_of(rows)).collect()) == [
        (-1, 1), (5, 0), (5, 0)]
    assert lines.dedup_report(docs.limit(0)).count() == 0 and lines.dedup_lines(docs.limit(0)).count() == 0


def test_perfect_hash_has_a_slot_for_each_key_and_tells_strangers():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000, 50_000):
        high, low = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
        low[: n // 3] = low[:1] if n else low[:0]  # crowded: must end in the list
        table = lines.PerfectHash.build(high, low)
        again = lines.PerfectHash.from_row(table.to_row())
        assert sorted(again.slots(high, low).tolist()) == list(range(n))
        other = again.slots(high + np.uint64(1), low)
        assert ((other >= -1) & (other < max(1, n))).all()


def test_simhash_links(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    prints = {centre, 0, 2**64 - 1}
    for _ in range(300):  # distances 1 to 5 around one centre, and chains away from it
        flipped = centre
        for b in rng.sample(range(64), rng.randint(1, 5)):
            flipped ^= 1 << b
        prints.add(flipped)
    at = rng.getrandbits(64)
    for _ in range(40):
        for b in rng.sample(range(64), 3):
            at ^= 1 << b
        prints.add(at)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    root = {r.node: r.root for r in components(simhash.links(df)).collect()}
    want = brute.groups({i: p % 2**64 for i, p in enumerate(signed)})
    got = {}
    for i, p in enumerate(signed):
        got.setdefault(root.get(p, p), []).append(i)
    assert sorted(sorted(g) for g in got.values()) == sorted(
        sorted(i for i in want if want[i] == r) for r in set(want.values()))


def test_simhash_frame(spark, docs_of):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(9, text), (3, text), (3, text), (4, text + " tail"), (5, None), (6, ""), (7, " \n"), (8, "two words"), (None, text)]
    docs = docs_of(rows)
    got = sorted(simhash.near_duplicates(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert len(got) == len(rows)
    by = {r.doc_id: (r.fingerprint, r.component_id) for r in got}
    assert by[9] == (f"{brute.fingerprint(text):016x}", 3) and by[3][1] == 3 and by[None][1] == 3
    assert by[5] == by[6] == by[7] == ("0" * 16, 5)
    assert by[8] == (f"{brute.fingerprint('two words'):016x}", 8)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    left = brute.groups({d: brute.fingerprint(t) for d, t in rows if d is not None})
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(
        d for d, _ in rows if d is not None and left[d] == d)
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([], "fp long"), radius=9)


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(300)] + [(1000 + rng.randrange(50), 1000 + rng.randrange(50)) for _ in range(60)]
    chain += [(2000, 2000), (None, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(301)} == {0} and 2000 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_suffixes(spark, docs_of, monkeypatch, small):
    if small:  # many buckets, pieces and sorting rounds
        for name, value in (("PIECE", 97), ("BUCKET_ENTRIES", 50), ("_SORT_ROWS", 40)):
            monkeypatch.setattr(suffixes, name, value)
    rng = random.Random(6)
    passage = "".join(rng.choices("abcdefgh é", k=400))
    rows = []
    for i in range(50):
        own = "".join(rng.choices("abcdefgh é", k=rng.randint(0, 200)))
        a = rng.randrange(400)
        rows.append((i, own + passage[a:a + rng.choice([10, 49, 50, 51, 52, 80, 300])] + own[::-1]))
    rows += [(50, None), (51, ""), (52, "x" * 3000), (53, "x" * 49), (54, "y" + "x" * 51), (55, "ab" * 500), (56, "ba" * 400),
             (57, passage), (58, passage), (-4, passage[100:260])]
    want = brute.substring_dedup({d: (t or "").encode() for d, t in rows})
    for r in suffixes.dedup_report(docs_of(rows)).collect():
        removed, runs, kept = want[r.doc_id]
        assert (r.n_removed, r.n_spans, r.kept_sha256) == (removed, runs, brute.sha(kept)), r.doc_id
    if small:
        return
    twice = suffixes.dedup_report(docs_of([(1, passage), (1, passage), (2, passage), (None, passage[:60])])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in twice) == [(0, 0), (1, 60), (1, 60), (2, len(passage.encode()))] \
        or len(passage[:60].encode()) != 60
    assert suffixes.dedup_bytes(docs_of(rows).limit(0)).count() == 0


def test_decontamination(spark, docs_of):
    item = "The quick, brown fox jumps over a lazy dog and Runs"
    items = [(1, item), (2, "short one"), (3, None), (4, "..."), (10, item + " far away"), (None, "nobody knows this")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("hash", F.lit("x"))
    rows = [(1, "x " + item.upper() + " y"), (2, item.replace(" ", "--")), (3, "a short one short one"), (4, None), (5, ""),
            (6, "fox " * 4000), (7, item[:30]), (8, "nobody knows this"), (9, item + " far away " + item), (11, "Σ short ΟΔΟΣ one")]
    rows += [(12, "word " * 20_000 + item)]
    want = brute.bench_hits(dict(rows), {i: t for i, t in items if i is not None})
    docs = docs_of(rows + [(1, rows[0][1]), (None, rows[0][1])])
    got = decontam.contamination(docs, bench).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id == 8:
            assert (r.n_hit, r.n_items, r.contaminated) == (3, 0, True)
            continue
        n, hit, names = want[1 if r.doc_id is None else r.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (
            n, hit, len(names), brute.sha(",".join(names)), hit > 0), r.doc_id
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, _ in sorted(rows) if d != 8 and not want[d][1]]
    cut = {r.doc_id: r.text for r in decontam.cut_windows(docs.where("doc_id > 1"), bench).collect()}
    assert cut[3] == "a " and cut[7] == item[:30] and cut[4] is None
    assert not decontam.contamination(docs, bench.limit(0)).where("contaminated").count()
    assert decontam.contamination(docs.limit(0), bench).count() == 0


def test_decontamination_beyond_the_broadcast_limit(spark, docs_of, monkeypatch):
    monkeypatch.setattr(decontam, "MAX_BROADCAST", 0)
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    got = decontam.contamination(docs_of([(1, "zero One two Three four"), (2, "none")]), bench).orderBy("doc_id").collect()
    assert [(r.n_hit, r.contaminated) for r in got] == [(3, True), (0, False)]


def test_licenses(spark, docs_of):
    mit = licenses.TEMPLATES["MIT-text"]
    rows = [(1, "Released under the MIT License."), (2, "intro\nReleased under  the mit-license!\n" + LONG), (3, None), (4, ""),
            (5, mit), (6, "\n".join(mit[i:i + 60] for i in range(0, len(mit), 60))), (7, "word " * 30_000), (8, "one"),
            (9, "Released under the MIT License."), (9, "Released under the MIT License.")]
    got = {(r.doc_id, r.unit, r.unit_no): r for r in licenses.license_matches(docs_of(rows)).collect()}
    assert got[1, "line", 0].license == "MIT" and got[1, "line", 0].dice == 1
    assert got[2, "line", 1].dice == 1 and got[5, "line", 0].license == "MIT-text"
    assert (6, "block", 0) in got and got[6, "block", 0].license == "MIT-text"
    assert {k[0] for k in got} == {1, 2, 5, 6, 9}
    tie = licenses.license_matches(docs_of([(1, "a b c")]), {"z": "a b c", "y": "A, B, C"}).collect()
    assert [r.license for r in tie] == ["y"]
    lone = licenses.license_matches(docs_of([(1, "one")]), {"z": "One."}).collect()
    assert [(r.n_grams, r.dice) for r in lone] == [(1, 1.0)]
    assert licenses.license_matches(docs_of(rows), {}).count() == 0
    assert licenses.license_matches(docs_of(rows).limit(0)).count() == 0


def brute_top(rows, k):
    clean = {}
    for i, v in rows:
        if i is None or v is None or any(x is None or x != x or abs(x) == float("inf") for x in v):
            continue
        n = [int(np.floor(256 * float(x))) for x in v]
        clean[i] = min(clean.get(i, n), n)
    out = []
    for q, v in clean.items():
        if q % 5 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in clean.items() if c != q)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("chunk", [8192, 7])
def test_top_k(spark, monkeypatch, chunk):
    monkeypatch.setattr(neighbours, "CHUNK", chunk)
    monkeypatch.setattr(neighbours, "STEP", 3 if chunk == 7 else 512)
    monkeypatch.setattr(neighbours, "QUERY_PART", 20 if chunk == 7 else 16384)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(200)]
    rows += [(i, [1.0] * 6) for i in range(200, 260)]  # one vector many times: ties
    rows += [(300, None), (301, [None] * 6), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (305, []), (310, [2.0]),
             (None, [1.0] * 6), (315, [1.0] * 6), (315, [0.5] * 6), (320, [-3e4] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1)).repartition(4)
    got = neighbours.top_k(df, F.col("vec_id") % 5 == 0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows, 5)
    few = neighbours.top_k(df.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert len(few) == 3
    assert neighbours.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0
