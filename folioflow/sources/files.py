"""Text with unknown encoding, recognition TSV, interchange and progress files."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.arrow import arrow_batched
from folioflow.functions.naming import parse_resume_name, sidecar_path
from folioflow.functions.text import strip

# byte order marks first, then encodings in the order they are tried
BYTE_ORDER_MARKS = (
    (codecs.BOM_UTF16_LE, "utf-16-le"),
    (codecs.BOM_UTF16_BE, "utf-16-be"),
    (codecs.BOM_UTF8, "utf-8-sig"),
)
TRIED_ENCODINGS = ("utf-8", "utf-16", "cp949")
SIDECAR = (
    "base string, t_ranges array<array<int>>, u_ranges array<array<int>>, doc_page_count int"
)
INTERCHANGE = (
    "segments array<struct<segment_id:string,page:int,source:string,translated:string>>"
)


def decode_one(raw: bytes) -> str | None:
    marked = [encoding for mark, encoding in BYTE_ORDER_MARKS if raw.startswith(mark)]
    for encoding in marked[:1] or TRIED_ENCODINGS:
        try:
            return raw.decode(encoding).lstrip("﻿")
        except UnicodeDecodeError:
            continue
    return None


@arrow_batched("string")
def decode(raw: pd.Series) -> pd.Series:
    """Text of raw bytes; NULL when no encoding fits."""
    return raw.map(lambda b: None if b is None else decode_one(bytes(b)))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", decode("content").alias("text"))


def tsv_words(regions: DataFrame, keys: list[str], tsv: Column) -> DataFrame:
    """Words of recognition TSV texts: header skipped, 12 columns, numbers and text required."""
    line = regions.select(*keys, F.posexplode(F.split(strip(tsv), "\n")).alias("_n", "_line")).where(
        (F.col("_n") > 0) & (strip(F.col("_line")) != "")
    )
    cells = F.split("_line", "\t")
    named = line.where(F.size(cells) >= 12).select(
        *keys,
        *[cells[i].try_cast("int").alias(n)
          for i, n in ((2, "block"), (3, "par"), (4, "line"), (5, "word"))],
        *[cells[i].try_cast("double").alias(n)
          for i, n in ((6, "left"), (7, "top"), (8, "width"), (9, "height"))],
        cells[11].alias("text"),
    )
    sound = strip(F.col("text")) != ""
    for number in ("left", "top", "width", "height"):
        sound = sound & F.col(number).isNotNull()
    return named.where(sound)


def export_documents(pairs: DataFrame, key: str) -> DataFrame:
    """One interchange JSON text per document; a document's segments stem from one row."""
    entry = F.struct("segment_id", "page", "source", "translated")
    return pairs.groupBy(key).agg(
        F.to_json(
            F.struct(F.array_sort(F.collect_list(entry)).alias("segments")),
            {"ignoreNullFields": "false"},
        ).alias("json")
    )


def import_documents(files: DataFrame, key: str, text: str = "json") -> DataFrame:
    """Pairs of interchange texts: key, pos, seg_id, translated."""
    parsed = F.from_json(F.col(text), INTERCHANGE)["segments"]
    return files.select(key, F.posexplode(parsed).alias("pos", "_s")).select(
        key, "pos", F.col("_s.segment_id").alias("seg_id"), F.col("_s.translated").alias("translated")
    )


def write_pairs(pairs: DataFrame, path: str, kind: str, compression: str = "none") -> None:
    """Plain exports: CSV, JSON lines or text; ``compression`` may be gzip."""
    writer = pairs.write.mode("overwrite").option("compression", compression)
    if kind == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif kind == "json":
        writer.json(path)
    elif kind == "txt":
        pairs.select("translated").write.mode("overwrite").option("compression", compression).text(path)
    else:
        raise ValueError(f"no plain export named {kind}")


def sidecar_json(base: Column, done: Column, left: Column, pages: Column) -> Column:
    return F.to_json(F.struct(
        base.alias("base"), done.alias("t_ranges"), left.alias("u_ranges"),
        pages.alias("doc_page_count"),
    ))


def resume_info(outputs: DataFrame, sidecars: DataFrame, path: str = "path") -> DataFrame:
    """Resume state of output paths: the progress file beside them, else the file name.

    ``sidecars`` has (path, json). Names that only hold a compact summary are
    not resumable without their progress file.
    """
    held = F.from_json("json", SIDECAR)
    side = sidecars.select(F.col("path").alias("_side"), held.alias("_held"))
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1")
    named = parse_resume_name(stem)

    def spans(c: Column) -> Column:
        return F.transform(c, lambda r: F.struct(r[0].alias("first"), r[1].alias("last")))

    joined = (
        outputs.withColumn("_side", sidecar_path(F.col(path))).join(side, "_side", "left")
        .withColumn("_named", F.when(~named["unresolved"], named))
    )
    has = F.col("_held.base").isNotNull()
    done = F.when(has, spans(F.col("_held.t_ranges"))).otherwise(F.col("_named.done"))
    left = F.when(has, spans(F.col("_held.u_ranges"))).otherwise(F.col("_named.left"))
    return joined.select(
        *outputs.columns,
        F.coalesce("_held.base", "_named.base").alias("base"),
        done.alias("done"), left.alias("left"), has.alias("from_sidecar"),
    )


def write_snapshot(df: DataFrame, path: str, label: str, compression: str = "zstd") -> None:
    """Keep a labelled copy of a table beside earlier ones; labels sort by time."""
    df.write.mode("overwrite").option("compression", compression).parquet(f"{path}/{label}")
    df.sparkSession.createDataFrame([(label,)], "label string").write.mode("append").json(f"{path}-labels")


def read_snapshot(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """A labelled copy, else the newest one; no other copy is opened."""
    if label is None:
        label = spark.read.schema("label string").json(f"{path}-labels").agg(F.max("label")).first()[0]
    return spark.read.parquet(f"{path}/{label}")
