"""Identifiers and keyed hashes from built-in functions."""
from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, functions as F

from spanquarry.functions.common import as_col, strip

# Namespace of derived trace ids; pass another one to match ids issued elsewhere.
TRACE_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:spanquarry:trace-id")


def uuid5(name, namespace: uuid.UUID = TRACE_NAMESPACE) -> Column:
    """Version 5 UUID: SHA-1 of namespace and name with the version and variant bits set."""
    digest = F.sha1(F.concat(F.lit(bytearray(namespace.bytes)), F.encode(as_col(name), "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def coerce_trace_id(value, namespace: uuid.UUID = TRACE_NAMESPACE) -> Column:
    """Valid UUIDs in canonical form, other text as a derived UUID, empty as null."""
    text = strip(value)
    bare = F.regexp_replace(F.regexp_replace(text, "urn:|uuid:", ""), r"^[{}]+|[{}]+$|-", "")
    low = F.lower(bare)
    parts = [F.substring(low, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return (
        F.when(F.length(text) == 0, None)
        .when(bare.rlike("^[0-9a-fA-F]{32}$"), F.concat_ws("-", *parts))
        .otherwise(uuid5(text, namespace))
    )


def hmac_sha256(message, secret: str) -> Column:
    """Keyed hash (RFC 2104).  The padded key becomes a literal of the plan, so keep plans private."""
    key = secret.encode()
    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    key = key.ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytearray(b ^ 0x36 for b in key)), F.encode(as_col(message), "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(b ^ 0x5C for b in key)), F.unhex(inner)), 256)


def sample_bucket(trace_id, rule_id) -> Column:
    """Position of a trace in a rule's sample, 0..100, from the first 16 bits of a hash."""
    digest = F.sha2(F.concat_ws(":", as_col(rule_id), as_col(trace_id)), 256)
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("double") / 65535 * 100


def in_sample(trace_id, rule_id, rate) -> Column:
    """Deterministic sampling: the same answer on every replay; a higher rate only adds traces."""
    r = rate if isinstance(rate, Column) else F.lit(float(rate))
    return F.when(r >= 100, True).when(r <= 0, False).otherwise(sample_bucket(trace_id, rule_id) < r)
