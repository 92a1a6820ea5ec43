"""Keyed pseudonyms and redaction, all within Catalyst."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is redacted, in this order; a card number counts only if its check digit is right.
PATTERNS = (
    ("token", r"(?i)(?:^|[?&\s])(?:token|key|secret|password|auth|sig|access_token)=[^&\s\"'<>]*"),
    ("bearer", r"(?i)\bBearer\s+[A-Za-z0-9\-._~+/=]{15,}"),
    ("aws_key", r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*"),
    ("privkey", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY-----"),
    ("pan", r"\b\d(?:[ -]?\d){12,18}\b"),
    ("email", r"(?<=/)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
)
NAMES = tuple(name for name, _ in PATTERNS)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of text as hex; only hashes of the padded key appear in the plan as literals."""
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    block = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)
    first = F.sha2(F.concat(F.lit(inner), message.cast("binary")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)


def pseudonym(key: bytes, kind: str, value: Column) -> Column:
    """``kind``_ and 12 hex digits; null stays null."""
    return F.when(value.isNotNull(), F.concat(F.lit(kind + "_"), F.substring(hmac_sha256(key, value), 1, 12)))


def luhn(digits: Column) -> Column:
    """Whether a text of digits has a valid check digit."""
    places = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: F.struct(c.cast("int").alias("d"), (i % 2).alias("odd")))
    total = F.aggregate(places, F.lit(0), lambda acc, x: acc + F.when(x["odd"] == 1, F.when(x["d"] * 2 > 9, x["d"] * 2 - 9).otherwise(x["d"] * 2)).otherwise(x["d"]))
    return total % 10 == 0


def _cards(text: Column, shape: str) -> Column:
    """struct(text, n): the digit runs of a text that pass the Luhn check replaced, and their number."""
    found = F.regexp_extract_all(text, F.lit(f"({shape})"), 1)
    right = F.transform(found, lambda m: F.struct(m.alias("m"), luhn(F.regexp_replace(m, "[ -]", "")).alias("ok")))
    parts = F.zip_with(F.split(text, shape, -1), right, lambda t, m: F.concat(t, F.when(m.isNull(), F.lit("")).when(m["ok"], F.lit("<REDACTED:pan>")).otherwise(m["m"])))
    return F.struct(F.array_join(parts, "").alias("text"), F.size(F.filter(right, lambda m: m["ok"])).alias("n"))


def with_redacted(rows: DataFrame, column: str, counts: str, longest: int | None = None) -> DataFrame:
    """``column`` redacted, and ``counts``: a struct with the number of replacements by each pattern.

    Patterns run in order, each on what the one before left, each in a projection of its own: a text is looked
    through once for a pattern, and rewritten only where it occurs.  Null stays null and counts 0.
    """
    out = rows
    for name, shape in PATTERNS:
        c = F.col(f"`{column}`")
        if name == "pan":
            out = out.withColumn("_hit", F.when(c.rlike(shape), _cards(c, shape)))
            out = out.withColumns({column: F.coalesce("_hit.text", c), f"_n_{name}": F.coalesce("_hit.n", F.lit(0))})
        else:
            out = out.withColumn("_hit", F.coalesce(F.regexp_count(c, F.lit(shape)), F.lit(0)))
            out = out.withColumns({column: F.when(F.col("_hit") > 0, F.regexp_replace(c, shape, f"<REDACTED:{name}>")).otherwise(c), f"_n_{name}": F.col("_hit")})
    out = out.withColumn(counts, F.struct(*[F.col(f"_n_{n}").alias(n) for n in NAMES])).drop("_hit", *[f"_n_{n}" for n in NAMES])
    return out.withColumn(column, F.substring(F.col(f"`{column}`"), 1, longest)) if longest else out
