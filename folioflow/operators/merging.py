"""Sequential merges of neighbouring boxes, one task per page or part of a page.

Inside a task neighbours and obstacles come from a grid that follows the merges
(``boxgrid``), so a page costs little more than its boxes. Pages of up to
``PAGE_ROWS`` boxes are one unit. Larger ones are cut: each merge only looks a
bounded distance around a box, so across an empty strip wider than that nothing can
merge or collide, and the bands between such strips give the same result alone.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterator, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow import constants as K
from folioflow.functions.text import strip
from folioflow.operators import blocked
from folioflow.operators.boxgrid import Box, BoxGrid, without
from folioflow.operators.skew import heavy_keys, join_unique
from folioflow.session import materialize

if TYPE_CHECKING:
    from pyarrow import RecordBatch

BAND_SPAN = 4096
#: Pages with more boxes than this are cut into bands first.
PAGE_ROWS = 20_000
#: Pieces of a page whose pairs are all looked at before a grid is made.
FEW = 16


def bands(boxes: DataFrame, keys: Sequence[str], low: str, high: str, reach: Column,
          out: str) -> DataFrame:
    """Number the bands along one axis: a gap wider than ``reach`` opens a new one.

    Only distinct extents are ordered, so copies of a box cost nothing. They
    are written out once, because both running steps read them.
    """
    keys = list(keys)
    named = boxes.withColumn("_low", F.col(low)).withColumn("_high", F.col(high))
    extents = materialize(
        named.groupBy(*keys, "_low", "_high").agg(F.max(reach).alias("_reach")), "extents"
    )
    cut = blocked.with_block(extents, F.col("_low"), BAND_SPAN)
    order = ["_low", "_high"]
    cut = blocked.running_max_before(cut, keys, order, F.col("_high"), "_far")
    opens = F.coalesce(F.col("_low") > F.col("_far") + F.col("_reach"), F.lit(False))
    numbered = blocked.running_sum(cut, keys, order, opens.cast("bigint"), out).select(
        *keys, "_low", "_high", out
    )
    return named.join(numbered, [*keys, "_low", "_high"]).drop("_low", "_high")


def by_size(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of pages that are one unit, and rows of larger pages (None without any).

    ``rows`` is read twice here and should be a table. There are at most
    rows / PAGE_ROWS larger pages; Spark broadcasts their keys while these are small
    and otherwise splits their partitions.
    """
    large = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > PAGE_ROWS).select(key)
    large = materialize(large, "large-pages")
    if large.isEmpty():
        return rows, None
    return rows.join(large, key, "left_anti"), rows.join(large, key, "left_semi")


def _page_max(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Add the greatest value of each page; pages may be hot."""
    facts = df.groupBy(key).agg(F.max(value).alias(out), F.count("*").alias("n"))
    return join_unique(df, facts.drop("n"), key, heavy_keys(facts, key), [value], "inner")


def per_band(rows: DataFrame, keys: Sequence[str], work: Callable[[list[dict]], list[dict]],
             result: str) -> DataFrame:
    """Run ``work`` on the rows of every band and explode what it returns.

    A band travels as one array, so an Arrow batch carries many bands and small
    bands cost no call of their own; rows are made of whole columns of a batch. The
    keys are not part of the rows.
    """

    fields = [c for c in rows.columns if c not in keys]
    gathered = rows.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("_rows"))
    shape = T.StructType([*[rows.schema[k] for k in keys], *T.StructType.fromDDL(result).fields])

    def run(batches: Iterator[RecordBatch]) -> Iterator[RecordBatch]:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(shape)
        names = target.names[len(keys):]
        for batch in batches:
            held = batch["_rows"]
            ends = held.offsets.to_pylist()
            columns = [part.to_pylist() for part in held.flatten().flatten()]
            every = [dict(zip(fields, values)) for values in zip(*columns)]
            first, origin, out = ends[0], [], []
            for n, (start, end) in enumerate(zip(ends, ends[1:])):
                done = work(every[start - first:end - first])
                out += done
                origin += [n] * len(done)
            place = pa.array(origin, pa.int64())
            arrays = [batch[k].take(place).cast(target.field(k).type) for k in keys]
            arrays += [pa.array([r[c] for r in out], target.field(c).type) for c in names]
            yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return gathered.mapInArrow(run, shape)


# --- vertical columns --------------------------------------------------------

def _ends_with(text: str, signs: str) -> bool:
    return text.rstrip().endswith(tuple(signs))


def _gaps(a: Box, b: Box) -> tuple[float, float]:
    return max(b[0] - a[2], a[0] - b[2], 0.0), max(b[1] - a[3], a[1] - b[3], 0.0)


def _hull(a: Box, b: Box) -> Box:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def _collide(a: Box, b: Box) -> bool:
    return min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1])


def reading_pair(a: dict, b: dict) -> tuple[dict, dict] | None:
    """The pair in reading order when the merge rule allows it, else None."""
    large = max(a["size"], b["size"], 1.0)
    if large / max(min(a["size"], b["size"]), 0.1) > K.MERGE_FONT_RATIO:
        return None
    across, along = _gaps(a["box"], b["box"])
    stacked = across <= large * K.SAME_COLUMN_GAP
    if stacked:
        in_order = a["box"][1] <= b["box"][1]
        near = along <= large * K.COLUMN_STACK_GAP
    else:
        in_order = a["box"][0] >= b["box"][0]
        shared = min(a["box"][3], b["box"][3]) - max(a["box"][1], b["box"][1])
        lower = min(a["box"][3] - a["box"][1], b["box"][3] - b["box"][1])
        near = (
            across <= large * K.COLUMN_SIDE_GAP
            and shared > 0
            and shared / max(lower, 1e-6) > K.COLUMN_OVERLAP
        )
    first, second = (a, b) if in_order else (b, a)
    if not near or _ends_with(first["text"], K.SENTENCE_END_CHARS):
        return None
    return first, second


def frozen(pieces: list[dict], grid: BoxGrid) -> tuple[set[int], dict[int, int]]:
    """Pieces that can never merge, and of the others the one piece that each overlaps, if any.

    A hull that hits a third box is refused, and boxes only grow. So a piece that
    overlaps another one can merge with that one only, and not if either overlaps
    a third: of overlapping groups only those of exactly two stay free.
    """
    partner: dict[int, int] = {}
    crowded: set[int] = set()
    for i, p in enumerate(pieces):
        for k in grid.near(p["box"]):
            if k != i and _collide(p["box"], grid.boxes[k]) and partner.setdefault(i, k) != k:
                crowded.add(i)
                break
    stuck = crowded | {i for i, k in partner.items() if k in crowded}
    return stuck, {i: k for i, k in partner.items() if i not in stuck}


def size_classes(sizes: set[float]) -> dict[float, float]:
    """For each font size the largest one that a chain of allowed size steps leads to.

    A merged piece has the size of one of its two, so it stays in their class.
    """
    out: dict[float, float] = {}
    chain: list[float] = []
    for size in [*sorted(sizes), None]:
        if chain and (size is None or max(size, 1.0) / max(chain[-1], 0.1) > K.MERGE_FONT_RATIO):
            out.update(dict.fromkeys(chain, chain[-1]))
            chain = []
        chain.append(size)
    return out


def merge_pieces(pieces: list[dict]) -> list[dict]:
    """Merge the nearest allowed pair until none is left.

    A pair refused because its hull hits a third box stays refused: that box only
    ever grows. So one heap of pairs serves all rounds. Pairs are sought within the
    reach of a piece's size class only, and a hull is searched for obstacles only
    outside the larger of its two boxes, which is known to hit nothing else.
    """
    able = [p for p in pieces if p["candidate"]]
    if len(able) < 2 or not any(p["vertical"] for p in able):
        return pieces
    if len(able) <= FEW and not any(
            (a["vertical"] or b["vertical"]) and reading_pair(a, b) for a, b in itertools.combinations(able, 2)):
        return pieces  # no pair to begin with, and so no grid
    live = dict(enumerate(pieces))
    every = BoxGrid()
    for i, p in live.items():
        every.add(i, p["box"])
    stuck, partner = frozen(pieces, every)
    able = [i for i, p in live.items() if p["candidate"] and i not in stuck]
    tops = size_classes({live[i]["size"] for i in able})
    grids = {top: BoxGrid() for top in set(tops.values())}
    version = [0] * len(pieces)
    heap: list[tuple] = []

    def offer(i: int, j: int) -> None:
        a, b = live[i], live[j]
        if (a["vertical"] or b["vertical"]) and partner.get(i, j) == j and partner.get(j, i) == i and reading_pair(a, b):
            heapq.heappush(heap, (sum(_gaps(a["box"], b["box"])), i, j, version[i], version[j]))

    def partners(i: int) -> set[int]:
        top = tops[live[i]["size"]]
        large, box = max(top, 1.0) * (1 + 1e-9), live[i]["box"]
        across, along = large * K.COLUMN_SIDE_GAP, large * K.COLUMN_STACK_GAP
        return set(grids[top].near((box[0] - across, box[1] - along, box[2] + across, box[3] + along))) - {i}

    def blocked_by_other(i: int, j: int, hull: Box) -> bool:
        a, b = live[i]["box"], live[j]["box"]
        own = a if (a[2] - a[0]) * (a[3] - a[1]) >= (b[2] - b[0]) * (b[3] - b[1]) else b
        return any(k not in (i, j) and _collide(hull, every.boxes[k]) for part in without(hull, own) for k in every.near(part))

    for i in able:
        grids[tops[live[i]["size"]]].add(i, live[i]["box"])
    for i in able:
        for k in partners(i):
            if k > i:
                offer(i, k)
    while heap:
        _, i, j, vi, vj = heapq.heappop(heap)
        if i not in live or j not in live or (vi, vj) != (version[i], version[j]):
            continue
        a, b = live[i], live[j]
        hull = _hull(a["box"], b["box"])
        if blocked_by_other(i, j, hull):
            continue
        first, second = reading_pair(a, b)
        base = first if len(first["text"]) >= len(second["text"]) else second
        grid = grids[tops[a["size"]]]
        for k in (i, j):
            every.remove(k)
            grid.remove(k)
            partner.pop(k, None)
        live[i] = {
            **base, "box": hull, "text": first["text"] + "\n" + second["text"], "vertical": True,
            "needs": a["needs"] or b["needs"], "members": a["members"] + b["members"],
        }
        del live[j]
        every.add(i, hull)
        grid.add(i, hull)
        version[i] += 1
        for k in partners(i):
            offer(min(i, k), max(i, k))
    return list(live.values())


MERGED_TYPE = (
    "id:bigint, x0:double, y0:double, x1:double, y1:double, text:string, size:double,"
    " vertical:boolean, needs:boolean, members:array<bigint>"
)


def _merged_rows(rows: list[dict]) -> list[dict]:
    rows = sorted(rows, key=lambda r: r["id"])
    boxed = [{**r, "box": (r["x0"], r["y0"], r["x1"], r["y1"]), "members": [r["id"]]} for r in rows]
    return [
        {"id": m["id"], "x0": m["box"][0], "y0": m["box"][1], "x1": m["box"][2],
         "y1": m["box"][3], "text": m["text"], "size": m["size"], "vertical": m["vertical"],
         "needs": m["needs"], "members": sorted(m["members"])}
        for m in merge_pieces(boxed) if not m["obstacle"]
    ]


def merge_columns(pieces: DataFrame, key: str = "page") -> DataFrame:
    """Merge pieces of vertical text per page.

    ``pieces`` has key, id, box, text, size, vertical, needs.
    """
    flat = [F.col(f"box.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")]
    short = F.length(strip(F.col("text"))) <= K.LOOSE_FRAGMENT_CHARS
    rows = materialize(pieces.select(
        key, *flat, "id", "text", "size", "vertical", "needs", (F.col("vertical") | short).alias("candidate"),
        F.lit(False).alias("obstacle")), "pieces")
    usual, large = by_size(rows, key)
    merged = per_band(usual, [key], _merged_rows, MERGED_TYPE)
    return merged if large is None else merged.unionByName(_merge_large(large, key))


def _merge_large(rows: DataFrame, key: str) -> DataFrame:
    """The same for pages of any size.

    Three or more equal boxes with an area block each other and every hull over
    them, so they leave as they are and act as one obstacle. The rest is cut into
    bands along x, then along y inside those, by the largest reach of the page's fonts.
    """
    box = ["x0", "y0", "x1", "y1"]
    copies = rows.groupBy(key, *box).agg(F.count("*").alias("_n"))
    heavy = heavy_keys(copies.withColumnRenamed("_n", "n"), [key, *box])
    marked = materialize(join_unique(rows, copies, [key, *box], heavy, ["id"]), "marked")
    solid = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    blocking = (F.col("_n") > 2) & F.coalesce(solid, F.lit(False))
    crowd = marked.where(blocking)
    obstacles = crowd.groupBy(key, *box).agg(F.min("id").alias("id"), F.max("size").alias("size")).select(
        key, *box, "id", F.lit("").alias("text"), "size", F.lit(False).alias("vertical"),
        F.lit(False).alias("needs"), F.lit(False).alias("candidate"), F.lit(True).alias("obstacle"),
    )
    every = materialize(marked.where(~blocking).drop("_n").unionByName(obstacles), "pieces")
    every = _page_max(every, key, "size", "_font")
    font = F.greatest(F.col("_font"), F.lit(1.0))
    banded = bands(every, [key], "x0", "x1", font * K.COLUMN_SIDE_GAP, "_xband")
    banded = materialize(banded, "x-bands")
    banded = bands(banded, [key, "_xband"], "y0", "y1", font * K.COLUMN_STACK_GAP, "_yband")
    merged = per_band(
        banded.drop("_font"), [key, "_xband", "_yband"], _merged_rows, MERGED_TYPE
    ).drop("_xband", "_yband")
    untouched = crowd.select(
        key, "id", *box, "text", "size", "vertical", "needs", F.array("id").alias("members")
    )
    return merged.unionByName(untouched)


# --- broken horizontal lines -------------------------------------------------

JOINED_TYPE = (
    "pos:bigint, x0:double, y0:double, x1:double, y1:double, text:string, members:array<bigint>"
)


def _continues(last: dict, row: dict) -> bool:
    if row["pos"] != last["end"] + 1 or not (last["needs"] and row["needs"]):
        return False
    if (last["bold"], last["color"]) != (row["bold"], row["color"]):
        return False
    a, b, font = last["box"], row["box"], last["size"]
    drop = b[1] - a[3]
    shared = min(a[2], b[2]) - max(a[0], b[0])
    narrow = max(min(a[2] - a[0], b[2] - b[0]), 1e-6)
    return (
        abs(font - row["size"]) <= K.LINE_JOIN_FONT
        and -font < drop < font * K.LINE_JOIN_GAP
        and shared > 0
        and shared / narrow > K.LINE_JOIN_OVERLAP
        and len(last["text"]) + len(row["text"]) <= K.LINE_JOIN_CHARS
        and not _ends_with(last["text"], K.LINE_END_CHARS)
    )


def _touch(a: Box, b: Box) -> bool:
    return (
        min(a[2], b[2]) - max(a[0], b[0]) > K.LINE_TOUCH
        and min(a[3], b[3]) - max(a[1], b[1]) > K.LINE_TOUCH
    )


def join_rows(rows: list[dict]) -> list[dict]:
    """One pass over rows in order; a row joins the last output row when the rules allow it.

    The grid holds the output rows and all rows still to come, and so what a
    joined row may not touch.
    """
    grid: BoxGrid | None = None  # most pages need none
    out: list[dict] = []
    for at, row in enumerate(rows):
        row = {**row, "end": row["pos"], "members": [row["pos"]], "at": at}
        last = out[-1] if out else None
        if last and _continues(last, row):
            if grid is None:
                grid = BoxGrid()
                for n, r in enumerate(rows):
                    grid.add(n, r["box"])
            hull = _hull(last["box"], row["box"])
            own = (last["at"], at)
            if not any(k not in own and _touch(hull, grid.boxes[k]) for k in grid.near(hull)):
                for k in own:
                    grid.remove(k)
                grid.add(last["at"], hull)
                last.update(
                    box=hull, end=row["pos"], members=last["members"] + row["members"],
                    text=last["text"].rstrip() + " " + row["text"].lstrip(),
                )
                continue
        out.append(row)
    return out


def _joined_rows(records: list[dict]) -> list[dict]:
    records = sorted(records, key=lambda r: r["pos"])
    boxed = [{**r, "box": (r["x0"], r["y0"], r["x1"], r["y1"])} for r in records]
    return [
        {"pos": r["pos"], "x0": r["box"][0], "y0": r["box"][1], "x1": r["box"][2],
         "y1": r["box"][3], "text": r["text"], "members": r["members"]}
        for r in join_rows(boxed)
    ]


def join_broken_lines(rows: DataFrame, key: str = "page") -> DataFrame:
    """Join consecutive rows of a page that continue one sentence.

    ``rows`` has key, pos (consecutive within the page), box, text, size, bold,
    color, needs.
    """
    flat = [F.col(f"box.{c}").alias(c) for c in ("x0", "y0", "x1", "y1")]
    plain = materialize(rows.select(key, "pos", *flat, "text", "size", "bold", "color", "needs"), "rows")
    usual, large = by_size(plain, key)
    joined = per_band(usual, [key], _joined_rows, JOINED_TYPE)
    if large is None:
        return joined
    banded = bands(_page_max(large, key, "size", "_font"), [key], "y0", "y1", F.col("_font") * K.LINE_JOIN_GAP, "_band")
    return joined.unionByName(per_band(banded.drop("_font"), [key, "_band"], _joined_rows, JOINED_TYPE).drop("_band"))


# --- reading order -----------------------------------------------------------


def row_seeds(extents: list[tuple[float, float]]) -> list[int]:
    """Reading row of every (top, height), given in order of their centres.

    The first extent without a row opens one; it takes all others that share more
    than half of the lower height. That holds for those whose centre lies above its
    bottom and for those whose top lies above its centre, and for no others: the
    former follow it in the order, the latter are met by a second order, by tops.
    Both orders are passed once. Extents without a height take none and are taken by none.
    """
    row = [-1] * len(extents)
    by_top = sorted((i for i, e in enumerate(extents) if e[1] > 0), key=lambda i: extents[i][0])
    number = low = 0

    def shares(i: int, j: int) -> bool:
        (a, h), (b, g) = extents[i], extents[j]
        least = min(h, g)
        return least > 0 and max(0.0, min(a + h, b + g) - max(a, b)) / least > K.READING_ROW_OVERLAP

    for i, (top, height) in enumerate(extents):
        if row[i] >= 0:
            continue
        row[i] = number
        if height > 0:
            centre, bottom = top + height / 2, top + height
            slack = 1e-9 * (1 + abs(top) + height)
            j = i + 1
            while j < len(extents) and extents[j][0] + extents[j][1] / 2 < bottom + slack:
                if row[j] < 0 and shares(i, j):
                    row[j] = number
                j += 1
            at = low
            while at < len(by_top) and extents[by_top[at]][0] < centre + slack:
                if row[by_top[at]] < 0 and shares(i, by_top[at]):
                    row[by_top[at]] = number
                at += 1
            while low < at and row[by_top[low]] >= 0:
                low += 1
        number += 1
    return row


def _seeded(found: list[dict]) -> list[dict]:
    found = sorted(found, key=lambda e: (e["y"] + e["h"] / 2, e["first_id"]))
    numbers = row_seeds([(e["y"], e["h"]) for e in found])
    return [{"y": e["y"], "h": e["h"], "row": n} for e, n in zip(found, numbers)]


def reading_order(boxes: DataFrame, key: str = "page") -> DataFrame:
    """Right-to-left reading order: adds band, row and the 1-based position in the page.

    ``boxes`` has key, id, x, y, w, h. Pages of up to PAGE_ROWS boxes are numbered
    in the row. In larger ones rows come from the distinct (top, height) pairs,
    which is all the grouping looks at, and positions block by block.
    """
    boxes = materialize(boxes.select(key, "id", "x", "y", "w", "h"), "boxes")
    usual, large = by_size(boxes, key)
    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema.fields}

    def numbered(rows: list[dict]) -> list[dict]:
        firsts: dict[tuple, int] = {}
        for r in rows:
            firsts[r["y"], r["h"]] = min(firsts.get((r["y"], r["h"]), r["id"]), r["id"])
        seeds = {(e["y"], e["h"]): e["row"] for e in _seeded([{"y": y, "h": h, "first_id": i} for (y, h), i in firsts.items()])}
        extents = sorted(firsts)
        band, far, bands_of = -1, None, {}
        for y, h in sorted(extents, key=lambda e: (e[0], e[0] + e[1])):
            if far is None or y > far:
                band += 1
            far = y + h if far is None else max(far, y + h)
            bands_of[y, h] = band
        lowest: dict[int, int] = {}
        for e, n in seeds.items():
            lowest[bands_of[e]] = min(lowest.get(bands_of[e], n), n)
        for r in rows:
            r["band"] = bands_of[r["y"], r["h"]]
            r["row"] = seeds[r["y"], r["h"]] - lowest[r["band"]]
        rows.sort(key=lambda r: (r["band"], r["row"], -(r["x"] + r["w"] / 2), r["y"], r["y"] + r["h"] / 2, r["id"]))
        return [{**r, "position": n + 1} for n, r in enumerate(rows)]

    shape = ", ".join(f"{f}: {kinds[f]}" for f in ("id", "x", "y", "w", "h"))
    placed = per_band(usual, [key], numbered, f"{shape}, band: bigint, row: int, position: bigint")
    if large is None:
        return placed
    spans = large.withColumn("_bottom", F.col("y") + F.col("h"))
    banded = materialize(bands(spans, [key], "y", "_bottom", F.lit(0.0), "band").drop("_bottom"), "bands")
    extents = banded.groupBy(key, "band", "y", "h").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    seeded = per_band(extents.drop("n"), [key, "band"], _seeded, f"y:{kinds['y']}, h:{kinds['h']}, row:int")
    place = [key, "band", "y", "h"]
    rest = join_unique(banded, seeded, place, heavy_keys(extents, place), ["id"], "inner")
    rest = rest.withColumn("_right", -(F.col("x") + F.col("w") / 2)).withColumn(
        "_centre", F.col("y") + F.col("h") / 2)
    order = ["band", "row", "_right", "y", "_centre", "id"]
    rest = blocked.row_number(blocked.with_counted_block(rest, [key], order), [key], order, "position")
    return placed.unionByName(rest.drop("_right", "_centre", blocked.BLOCK))
