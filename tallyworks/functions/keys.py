"""Deterministic ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha16(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def uid(*parts: Column) -> Column:
    """Id of the parts joined by "|"; a null part is spelled None."""
    return sha16(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]))


def award_uid(announcement_id: Column, number: Column, raw: Column, ordinal: Column) -> Column:
    """Number if there is one, else "#" and the ordinal, stands between document and name."""
    middle = F.when(F.coalesce(number, F.lit("")) != "", number).otherwise(F.concat(F.lit("#"), ordinal.cast("string")))
    return sha16(F.concat(announcement_id, F.lit("|"), middle, F.lit("|"), F.lower(F.trim(F.coalesce(raw, F.lit(""))))))


def contract_key(number: Column, base: Column) -> Column:
    """First of (base, number) that isn't blank, trimmed."""
    return F.coalesce(F.nullif(F.trim(base), F.lit("")), F.nullif(F.trim(number), F.lit("")))


def contract_uid(number: Column, base: Column) -> Column:
    key = contract_key(number, base)
    return sha16(F.upper(F.regexp_replace(key, r"\s+", " ")))


def hash_boundary(key: Column, size: int) -> Column:
    """Whether the first 32 bits of the key's SHA-256 are a multiple of ``size``."""
    return F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long") % size == 0


def cache_key(model: Column, system: Column, prompt: Column, schema: Column, max_tokens: Column) -> Column:
    """SHA-256 of a canonical JSON object of the request, keys in order."""
    return F.sha2(F.to_json(F.struct(max_tokens.alias("max_tokens"), model.alias("model"), prompt.alias("prompt"), schema.alias("schema"), system.alias("system"))), 256)
