"""Merges that run band by band against whole-page brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from folioflow.functions import geometry as G
from folioflow.functions.geometry import spread_words
from folioflow.operators import merging


def pages(seed, count, vertical=True):
    rng = random.Random(seed)
    rows = []
    for page in range(count):
        for i in range(rng.randrange(1, 14)):
            x, y = rng.randrange(0, 240, 4), rng.randrange(0, 240, 4)
            w, h = (8, rng.choice([10, 30, 60])) if vertical else (rng.choice([40, 90]), 10)
            text = rng.choice(["가", "longer text", "end.", "abc", "wxyz"])
            rows.append((page, i, float(x), float(y), float(x + w), float(y + h), text,
                         rng.choice([10.0, 10.5, 14.0]), rng.random() < 0.7))
        if page % 3 == 0:  # copies of one box
            rows += [(page, 100 + n, 0.0, 0.0, 8.0, 30.0, "c", 10.0, True) for n in range(page % 4 + 1)]
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(
        rows, "page int, id bigint, x0 double, y0 double, x1 double, y1 double, text string, size double, vertical boolean")
    return df.select("page", "id", G.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("box"),
                     "text", "size", "vertical", F.lit(True).alias("needs"))


def naive_columns(rows):
    """Round by round over one whole page: the nearest valid pair is merged."""
    live = {}
    for r in sorted(rows, key=lambda r: r[1]):
        live[r[1]] = {"id": r[1], "box": r[2:6], "text": r[6], "size": r[7], "vertical": r[8], "members": [r[1]]}
    pool = {i for i, p in live.items() if p["vertical"] or len(p["text"].strip()) <= 3}
    while True:
        best = None
        for i in sorted(pool & live.keys()):
            for j in sorted(pool & live.keys()):
                if i >= j or not (live[i]["vertical"] or live[j]["vertical"]):
                    continue
                order = merging.reading_pair(live[i], live[j])
                if not order:
                    continue
                a, b = live[i]["box"], live[j]["box"]
                hull = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
                if any(min(hull[2], o["box"][2]) > max(hull[0], o["box"][0])
                       and min(hull[3], o["box"][3]) > max(hull[1], o["box"][1])
                       for k, o in live.items() if k not in (i, j)):
                    continue
                gap = max(b[0] - a[2], a[0] - b[2], 0) + max(b[1] - a[3], a[1] - b[3], 0)
                if best is None or gap < best[0]:
                    best = (gap, i, j, hull, order)
        if best is None:
            return sorted((p["box"], p["text"], tuple(sorted(p["members"]))) for p in live.values())
        _, i, j, hull, (first, second) = best
        base = first if len(first["text"]) >= len(second["text"]) else second
        live[i] = {**base, "box": hull, "text": first["text"] + "\n" + second["text"], "vertical": True,
                   "members": live[i]["members"] + live[j]["members"]}
        del live[j]


@pytest.fixture(params=["whole pages", "bands"])
def any_size(request, monkeypatch):
    """Pages as one unit, and all pages cut into bands."""
    if request.param == "bands":
        monkeypatch.setattr(merging, "PAGE_ROWS", 1)


def test_merge_columns(spark, any_size):
    rows = pages(11, 40)
    got = {}
    for r in merging.merge_columns(frame(spark, rows)).collect():
        got.setdefault(r.page, []).append(((r.x0, r.y0, r.x1, r.y1), r.text, tuple(r.members)))
    merged = 0
    for page in {r[0] for r in rows}:
        want = naive_columns([r for r in rows if r[0] == page])
        assert sorted(got[page]) == want
        merged += any(len(m) > 1 for _, _, m in want)
    assert merged > 5


def naive_lines(rows):
    out = []
    for at, r in enumerate(rows):
        last = out[-1] if out else None
        if last is not None and r["pos"] == last["end"] + 1 and merging._continues(last, r):
            a, b = last["box"], r["box"]
            hull = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
            others = [o["box"] for o in out[:-1]] + [o["box"] for o in rows[at + 1:]]
            if not any(hull[2] - 2 > o[0] and o[2] - 2 > hull[0] and hull[3] - 2 > o[1] and o[3] - 2 > hull[1]
                       for o in others):
                last.update(box=hull, end=r["pos"], text=last["text"].rstrip() + " " + r["text"].lstrip(),
                            members=last["members"] + [r["pos"]])
                continue
        out.append({**r, "end": r["pos"], "members": [r["pos"]]})
    return sorted((o["pos"], o["box"], o["text"], tuple(o["members"])) for o in out)


def test_join_broken_lines(spark, any_size):
    rng = random.Random(5)
    rows = []
    for page in range(30):
        y = 0.0
        for pos in range(rng.randrange(2, 16)):
            y += rng.choice([11.0, 12.0, 14.0, 60.0])
            x = rng.choice([0.0, 0.0, 5.0, 200.0])
            rows.append((page, pos, x, y, x + 80, y + 10, rng.choice(["one", "two ", "stop."]), 10.0, False, 0, True))
    df = spark.createDataFrame(rows, "page int, pos bigint, x0 double, y0 double, x1 double, y1 double, text string,"
                               " size double, bold boolean, color int, needs boolean")
    boxed = df.withColumn("box", G.box(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    got = {}
    for r in merging.join_broken_lines(boxed).collect():
        got.setdefault(r.page, []).append((r.pos, (r.x0, r.y0, r.x1, r.y1), r.text, tuple(r.members)))
    for page in range(30):
        mine = [dict(pos=r[1], box=r[2:6], text=r[6], size=r[7], bold=r[8], color=r[9], needs=r[10])
                for r in rows if r[0] == page]
        assert sorted(got[page]) == naive_lines(mine)
    assert any(len(m) > 1 for p in got.values() for *_, m in p)


def naive_reading(boxes):
    """Centre order, seeds, rows; then right to left and top down."""
    rest = sorted(boxes, key=lambda b: (b[2] + b[4] / 2, b[0]))
    out = []
    while rest:
        seed, group, later = rest[0], [rest[0]], []
        for b in rest[1:]:
            shared = min(seed[2] + seed[4], b[2] + b[4]) - max(seed[2], b[2])
            least = min(seed[4], b[4])
            (group if least > 0 and max(shared, 0) / least > 0.5 else later).append(b)
        out += sorted(group, key=lambda b: (-(b[1] + b[3] / 2), b[2], b[2] + b[4] / 2, b[0]))
        rest = later
    return [b[0] for b in out]


def test_reading_order(spark, any_size):
    rng = random.Random(9)
    rows = [(p, i, float(rng.randrange(300)), float(rng.randrange(0, 200, 3)), 20.0, float(rng.choice([5, 9, 30])))
            for p in range(25) for i in range(rng.randrange(1, 12))]
    got = merging.reading_order(spark.createDataFrame(
        rows, "page int, id bigint, x double, y double, w double, h double")).collect()
    for page in {r[0] for r in rows}:
        order = [r.id for r in sorted((g for g in got if g.page == page), key=lambda g: g.position)]
        # equal (top, height) pairs share a row, so ties between seeds may differ only inside a row
        assert order == naive_reading([r[1:] for r in rows if r[0] == page])


def pieces_of(rows):
    return [{"id": r[1], "box": r[2:6], "text": r[6], "size": r[7], "vertical": r[8], "needs": True, "members": [r[1]],
             "candidate": r[8] or len(r[6].strip()) <= 3} for r in sorted(rows, key=lambda r: r[1])]


def test_merge_pieces_on_crowded_pages():
    rng = random.Random(21)
    merged = 0
    for n in range(300):
        side = rng.choice([20, 60, 150])
        rows = []
        for i in range(rng.randrange(2, 16)):
            x, y = rng.randrange(0, side, 4), rng.randrange(0, side, 4)
            w, h = rng.choice([(8, 10), (8, 30), (0, 10), (8, 0), (60, 4), (4, 60)])
            rows.append((0, i, float(x), float(y), float(x + w), float(y + h), rng.choice(["가", "longer text", "end.", "abc"]),
                         rng.choice([0.5, 0.95, 10.0, 11.0, 12.0, 13.5, 40.0]), rng.random() < 0.7))
        got = sorted((p["box"], p["text"], tuple(sorted(p["members"]))) for p in merging.merge_pieces(pieces_of(rows)))
        assert got == naive_columns(rows), n
        merged += any(len(m) > 1 for *_, m in got)
    assert merged > 50


def test_row_seeds_by_definition():
    rng = random.Random(22)
    for _ in range(400):
        extents = sorted(((float(rng.randrange(60)), rng.choice([0.0, 1.0, 5.0, 9.5, 30.0, 80.0])) for _ in range(rng.randrange(25))),
                         key=lambda e: e[0] + e[1] / 2)
        want, number = [-1] * len(extents), 0
        for i, (top, height) in enumerate(extents):
            if want[i] < 0:
                want[i] = number
                for j in range(i + 1, len(extents)):
                    t, h = extents[j]
                    shared, least = max(0.0, min(top + height, t + h) - max(top, t)), min(height, h)
                    if want[j] < 0 and least > 0 and shared / least > 0.5:
                        want[j] = number
                number += 1
        assert merging.row_seeds(extents) == want


MANY = 200_000


def timed(work):
    start = time.perf_counter()
    out = work()
    assert time.perf_counter() - start < 60
    return out


def test_many_boxes_on_one_page():
    rng = random.Random(23)
    dense = [(0, i, x := rng.uniform(0, 900), y := rng.uniform(0, 900), x + 12.0, y + 12.0, "가", 10.0, True) for i in range(MANY)]
    assert len(timed(lambda: merging.merge_pieces(pieces_of(dense)))) == MANY  # all overlap, nothing may merge
    columns = [(0, i, (i % 450) * 40.0, (i // 450) * 11.0, (i % 450) * 40.0 + 10, (i // 450) * 11.0 + 10, "가" if i // 450 % 10 else "문.", 10.0, True)
               for i in range(MANY)]
    assert len(timed(lambda: merging.merge_pieces(pieces_of(columns)))) < MANY // 5


def test_many_lines_and_extents_on_one_page():
    lines = [dict(pos=i, box=(0.0, i * 12.0, 80.0, i * 12.0 + 10), text="word" if i % 9 else "end.", size=10.0, bold=False, color=0,
                  needs=True) for i in range(MANY)]
    lines += [dict(pos=MANY + i, box=(40.0, i * 12.0, 90.0, i * 12.0 + 10), text="x", size=10.0, bold=True, color=1, needs=True)
              for i in range(0, MANY, 50)]
    assert len(timed(lambda: merging.join_rows(lines))) < MANY // 4
    rng = random.Random(24)
    extents = sorted(((rng.uniform(0, 5e5), rng.uniform(1, 3000)) for _ in range(MANY)), key=lambda e: e[0] + e[1] / 2)
    assert max(timed(lambda: merging.row_seeds(extents))) > 100


def test_spread_words():
    assert spread_words("aa bb cc dd", [10.0, 10.0]) == "aa bb\ncc dd"
    assert spread_words("one", [5.0, 5.0]) == "one"
    assert spread_words("a  b\tc", [1.0]) == "a b c"
    assert spread_words("", [1.0, 2.0]) == ""


def test_a_page_without_a_pair_needs_no_grid(monkeypatch):
    from folioflow.operators import merging

    def piece(i, x):
        return {"id": i, "box": (x, 0.0, x + 5, 12.0), "size": 10.0, "text": "a", "vertical": True, "candidate": True, "needs": True,
                "members": [i], "obstacle": False}

    apart, near = [piece(i, 400.0 * i) for i in range(5)], [piece(i, 8.0 * i) for i in range(2)]
    assert len(merging.merge_pieces(near)) == 1

    def none():
        raise AssertionError("a grid was made")

    monkeypatch.setattr(merging, "BoxGrid", none)
    assert merging.merge_pieces(apart) == apart


def test_bands_come_back_with_their_keys(spark):
    """Bands of several keys, some without a result, in many batches."""
    from pyspark.sql import functions as F

    from folioflow.operators.merging import per_band

    rows = spark.range(5000).select((F.col("id") % 700).alias("page"), F.col("id").cast("string").alias("part"), "id")
    got = per_band(rows, ["page"], lambda band: [{"n": len(band), "last": max(r["part"] for r in band)}] if band[0]["id"] % 2 else [],
                   "n: bigint, last: string").collect()
    assert sorted(r.page for r in got) == list(range(1, 700, 2))
    assert all(r.n == len(range(r.page, 5000, 700)) and int(r.last) % 700 == r.page for r in got)
