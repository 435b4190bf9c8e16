"""Expressions about mapper services: errors, delays, model names, devices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow import constants as K
from folioflow.functions.text import strip


def _mentions(message: Column, words: tuple[str, ...]) -> Column:
    low = F.lower(message)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def _coded(code: Column, codes: tuple[int, ...]) -> Column:
    return F.coalesce(code.isin(*codes), F.lit(False))


def is_rate_limit(code: Column, message: Column) -> Column:
    return _coded(code, K.RATE_LIMIT_CODES) | _mentions(message, K.RATE_LIMIT_WORDS)


def is_auth(code: Column, message: Column) -> Column:
    return _coded(code, K.AUTH_CODES) | _mentions(message, K.AUTH_WORDS)


def is_quota(message: Column) -> Column:
    return _mentions(message, K.QUOTA_WORDS)


def is_lasting(code: Column, message: Column) -> Column:
    return is_auth(code, message) | is_quota(message)


def is_oversize(code: Column, message: Column) -> Column:
    return _coded(code, K.OVERSIZE_CODES) | _mentions(message, K.OVERSIZE_WORDS)


def brief_rate_limit(message: Column) -> Column:
    return _mentions(message, K.BRIEF_RATE_LIMIT_WORDS)


def brief_auth(message: Column) -> Column:
    return _mentions(message, K.BRIEF_AUTH_WORDS)


def brief_quota(message: Column) -> Column:
    return _mentions(message, K.BRIEF_QUOTA_WORDS)


def brief_lasting(message: Column) -> Column:
    return brief_auth(message) | brief_quota(message)


def retry_delay(message: Column, header: Column | None = None,
                default: float = K.RETRY_DEFAULT) -> Column:
    """Seconds to wait: the delay a message or header names plus a margin."""
    spoken = F.regexp_extract(message, K.RETRY_IN, 1).try_cast("double")
    field = F.regexp_extract(message, K.RETRY_FIELD, 1).try_cast("double")
    named = F.coalesce(spoken, field)
    if header is not None:
        named = F.coalesce(named, header.try_cast("double"))
    return F.coalesce(named + K.RETRY_MARGIN, F.lit(default))


def backoff(attempt: Column) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(float(K.BACKOFF_CAP)))


def service_backoff(retry: Column) -> Column:
    """Delay before the n-th retry (0-based) of the retrying caller."""
    first, factor, cap = K.SERVICE_BACKOFF
    return F.least(F.lit(first) * F.pow(F.lit(factor), retry), F.lit(cap))


def quant_bits(model: Column) -> Column:
    pattern = "(?i)" + K.QUANT_PATTERN
    found = [F.nullif(F.regexp_extract(model, pattern, i), F.lit("")) for i in range(1, 5)]
    return F.coalesce(*found).cast("int")


def batch_preset(model: Column) -> Column:
    """STRUCT<bits, chars, segments, tokens>, interpolated between the known bit widths."""
    bits = F.coalesce(quant_bits(model), F.lit(K.QUANT_DEFAULT_BITS))
    known = sorted(K.QUANT_PRESETS)

    def value(i: int) -> Column:
        out = F.when(F.lit(False), F.lit(0))
        for b in known:
            out = out.when(bits == b, F.lit(K.QUANT_PRESETS[b][i]))
        for lo, hi in zip(known, known[1:]):
            a, b = K.QUANT_PRESETS[lo][i], K.QUANT_PRESETS[hi][i]
            part = (bits - lo) / (hi - lo)
            out = out.when((bits > lo) & (bits < hi), F.floor(a + part * (b - a)).cast("int"))
        return out

    return F.struct(
        bits.alias("bits"), value(0).alias("chars"), value(1).alias("segments"),
        value(2).alias("tokens"),
    )


def model_device(model: Column) -> Column:
    low = F.lower(model)
    return F.when(low.endswith("-flm") | low.contains("-flm-"), "npu").otherwise("gpu")


def devices(spec: Column) -> Column:
    """STRUCT<devices, unknown> of a comma-separated device list."""
    parts = F.filter(F.transform(F.split(spec, ","), lambda d: F.lower(strip(d))), lambda d: d != "")
    return F.struct(
        parts.alias("devices"),
        F.filter(parts, lambda d: ~d.isin(*K.LOCAL_DEVICES)).alias("unknown"),
    )


def _aliased(name: Column) -> Column:
    out = name
    for short, full in K.PROVIDER_ALIASES.items():
        out = F.when(name == short, full).otherwise(out)
    return out


def _by_shape(key: Column) -> Column:
    return (
        F.when(key.startswith("sk-ant-"), "anthropic")
        .when(key.startswith("AIza") | key.startswith("AQ."), "gemini")
        .when(key.startswith("sk-"), "openai")
    )


def detect_provider(key: Column) -> Column:
    """Provider named before a colon, else guessed from the key's first signs."""
    prefix = strip(F.substring_index(strip(F.substring_index(key, ":", 1)), "@", 1))
    named = _aliased(F.lower(prefix))
    explicit = key.contains(":") & named.isin(*K.PROVIDERS, *K.EXTRA_PROVIDERS)
    return F.when(explicit, named).otherwise(_by_shape(key))


def parse_key_line(line: Column) -> Column:
    """STRUCT<provider, model, secret> of ``provider@model:key``, ``provider:key`` or ``key``."""
    raw = strip(line)
    colon = raw.contains(":")
    prefix = strip(F.substring_index(raw, ":", 1))
    rest = strip(F.substr(raw, F.instr(raw, ":") + F.lit(1)))
    at = prefix.contains("@")
    return F.struct(
        F.when(colon, _aliased(F.lower(strip(F.substring_index(prefix, "@", 1)))))
        .otherwise(detect_provider(raw)).alias("provider"),
        F.when(colon & at, strip(F.substr(prefix, F.instr(prefix, "@") + F.lit(1)))).alias("model"),
        F.when(colon, rest).otherwise(raw).alias("secret"),
    )


def source_language(name: Column) -> Column:
    return F.when(
        F.lower(strip(name)).isin(*K.AUTO_LANGUAGE_WORDS), K.AUTO_LANGUAGE_TEXT
    ).otherwise(name)


def eta_seconds(elapsed: Column, percent: Column) -> Column:
    """Time left; NULL before any progress."""
    return F.when(percent > 0, elapsed / percent * (F.lit(100) - percent))


def progress_line(line: Column) -> Column:
    """STRUCT of the five figures of a progress log line; NULLs for other lines."""
    def figure(i: int, kind: str) -> Column:
        return F.nullif(F.regexp_extract(line, K.PROGRESS_LINE, i), F.lit("")).cast(kind)

    return F.struct(
        figure(1, "int").alias("batch"), figure(2, "int").alias("batches"),
        figure(3, "int").alias("pages"), figure(4, "int").alias("all_pages"),
        figure(5, "double").alias("percent"),
    )
