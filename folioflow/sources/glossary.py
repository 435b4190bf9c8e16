"""Glossary readers: text, CSV, JSON and YAML to (profile, source, target, ord)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.arrow import arrow_batched
from folioflow.functions.text import strip

ENTRIES = "array<struct<profile:string,source:string,target:string>>"


def parse_line(line: Column) -> Column:
    """STRUCT<source, target> of ``source => target`` or ``source, target``; NULL otherwise."""
    bare = strip(line)
    sep = F.when(bare.contains("=>"), "=>").when(bare.contains(","), ",")
    at = F.instr(bare, sep)
    return F.when(
        (bare != "") & ~bare.startswith("#") & sep.isNotNull(),
        F.struct(
            strip(F.substr(bare, F.lit(1), at - 1)).alias("source"),
            strip(F.substr(bare, at + F.length(sep))).alias("target"),
        ),
    )


def last_wins(entries: DataFrame) -> DataFrame:
    """One row per (profile, source): the last target at the first position."""
    return entries.groupBy("profile", "source").agg(
        F.max_by("target", "ord").alias("target"), F.min("ord").alias("ord")
    )


def from_lines(lines: DataFrame, line: str, order: str) -> DataFrame:
    entries = lines.select(parse_line(F.col(line)).alias("_e"), F.col(order).alias("ord")).where(
        F.col("_e").isNotNull()
    )
    return last_wins(entries.select(F.lit(None).cast("string").alias("profile"), "_e.*", "ord"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    return from_lines(lines, "value", "ord")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """The first two columns, trimmed; rows without a second column are left out."""
    rows = spark.read.option("multiLine", True).option("escape", '"').csv(path)
    if len(rows.columns) < 2:
        rows = rows.withColumn("_c1", F.lit(None).cast("string"))
    return last_wins(
        rows.where(F.col("_c1").isNotNull()).select(
            F.lit(None).cast("string").alias("profile"),
            strip(F.coalesce("_c0", F.lit(""))).alias("source"), strip(F.col("_c1")).alias("target"),
            F.monotonically_increasing_id().alias("ord"),
        )
    )


def _entries(data) -> list[dict]:
    """Entries of a parsed glossary; what has not the shape of one is passed over."""
    out = []
    if isinstance(data, dict):
        items = list(data.items())
    else:
        rows = data if isinstance(data, list) else []
        items = [(d.get("source", ""), d.get("target", "")) for d in rows if isinstance(d, dict)]
    for name, value in items:
        if isinstance(value, dict):
            out += [{"profile": name, "source": s, "target": t} for s, t in value.items()
                    if isinstance(s, str) and isinstance(t, str)]
        elif isinstance(value, str) and name:
            out.append({"profile": None, "source": name, "target": value})
    return out


def _load_yaml(text: str):
    try:
        import yaml
    except ImportError as missing:  # optional package
        raise RuntimeError("YAML glossaries need the yaml package") from missing
    return yaml.safe_load(text) or {}


def _document_parser(load):
    def entries(text: str | None) -> list[dict]:
        try:
            return _entries(load(text or ""))
        except RuntimeError as missing:
            if isinstance(missing, RecursionError):
                return []
            raise
        except Exception:  # a file that is no JSON or YAML has no entries; the other files count
            return []

    @arrow_batched(ENTRIES)
    def parse(files: pd.Series) -> pd.Series:
        return files.map(entries)

    return parse


def from_documents(files: DataFrame, text: str, kind: str) -> DataFrame:
    """Entries of whole JSON or YAML texts, one glossary per row."""
    parse = _document_parser(json.loads if kind == "json" else _load_yaml)
    return last_wins(
        files.select(F.posexplode(parse(F.col(text))).alias("ord", "_e")).select("_e.*", "ord")
    )


def read_document(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return from_documents(spark.read.text(path, wholetext=True), "value", kind)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Reader by suffix; unknown suffixes are text."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "json":
        return read_document(spark, path, "json")
    if suffix in ("yaml", "yml"):
        return read_document(spark, path, "yaml")
    return read_csv(spark, path) if suffix == "csv" else read_text(spark, path)
