"""Hash keys of finished work."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions.text import strip


def glossary_digest(glossary: Column) -> Column:
    return F.when(glossary.isNull() | (glossary == ""), F.lit("")).otherwise(F.md5(glossary))


def memo_key(source: Column, source_lang: Column, target_lang: Column, glossary: Column) -> Column:
    """Key of one piece of finished work; outer whitespace does not count."""
    return F.sha2(
        F.concat_ws(
            K.MEMO_SEPARATOR,
            F.lit(K.MEMO_VERSION),
            strip(source),
            strip(source_lang),
            strip(target_lang),
            glossary_digest(glossary),
        ),
        256,
    )


def prompt_key(prompt: Column, provider: Column, model: Column) -> Column:
    return F.sha2(F.concat_ws("|", prompt, provider, model), 256)


def memory_key(text: Column, source_lang: Column, target_lang: Column) -> Column:
    return F.concat_ws("_", source_lang, target_lang, text)
