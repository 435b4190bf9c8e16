import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use inside."""

    def make(rows, parts=3):
        full = [(d, t, "en", "s", None if t is None else len(t)) for d, t in rows]
        df = spark.createDataFrame(full, SCHEMA).repartition(parts)
        for name in ("key", "_key", "print", "block", "hash", "fp", "rest", "shard", "root", "words", "v", "_k", "_p", "_hit", "_kept", "text_",
                     "_text", "hits", "component_id", "fingerprint", "n", "rank", "x", "cut"):
            df = df.withColumn(name, df["source"])
        return df

    return make
