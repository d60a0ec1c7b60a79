"""Identifiers, digests and text clean-up as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the URL name space of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(namespace_hex: str, name: Column) -> Column:
    """The name-based UUID (version 5) of ``name``, from built-in functions only."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8))))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def window_id(minutes: int) -> Column:
    """A window's id from its key and length."""
    from loomwatch.operators.windows import SCHEMA_VERSION

    start = F.unix_micros("window_start")
    parts = F.concat_ws("|", "dataset_kind", "user_id", "host_id", start.cast("string"), (start + minutes * 60_000_000).cast("string"), F.lit(SCHEMA_VERSION))
    return uuid5(URL_NAMESPACE, parts)


def profile_key(user: str = "user_id", host: str = "host_id") -> Column:
    """Sixteen hex digits for a user on a host."""
    return F.left(F.sha2(F.to_json(F.struct(F.col(host).alias("host_id"), F.col(user).alias("user_id"))), 256), F.lit(16))


def pseudonym(prefix: str, salt: str, value: Column) -> Column:
    """A stable stand-in for an identity."""
    return F.concat(F.lit(f"{prefix}-"), F.left(F.sha2(F.concat(F.lit(f"{salt}:"), value), 256), F.lit(16)))


def clean_reason(reason: Column) -> Column:
    """One line of up to 500 characters; a default where nothing is left."""
    plain = F.trim(F.regexp_replace(F.translate(reason, "\0", " "), r"\s+", " "))
    return F.coalesce(F.nullif(F.left(plain, F.lit(500)), F.lit("")), F.lit("manual update"))


def sorted_payload(payload: Column) -> Column:
    """A payload map with its keys in order."""
    return F.map_from_entries(F.array_sort(F.map_entries(payload)))


def payload_hash(payload: Column) -> Column:
    """The digest of a payload map's canonical JSON."""
    return F.sha2(F.to_json(sorted_payload(payload)), 256)


def fingerprint(*parts: Column | str) -> Column:
    """24 hex digits over the parts."""
    return F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(24))
