"""Text and digest columns: sizes, entity tags, signatures, names of derived layers."""

from __future__ import annotations

import hashlib
import hmac

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LABELS, BOUNDARY = "_labels", "_boundary"


def format_bytes(n: Column) -> Column:
    """B, KB and MB with one decimal, GB with two."""
    # Rounded half to even before it is printed, as printing alone would round half up.
    scaled = lambda unit, form: F.format_string(form, F.bround(n.cast("double") / float(unit), int(form[2])))
    return (
        F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1 << 20, scaled(1 << 10, "%.1f KB"))
        .when(n < 1 << 30, scaled(1 << 20, "%.1f MB"))
        .otherwise(scaled(1 << 30, "%.2f GB"))
    )


def etag(data: Column) -> Column:
    """The first eight bytes of the SHA-256 digest in hex, in quotes."""
    return F.concat(F.lit('"'), F.substring(F.sha2(data.cast("binary"), 256), 1, 16), F.lit('"'))


def signature(secret: str, body: bytes) -> str:
    return "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def hmac_signature(body: Column, secret: str) -> Column:
    """The signature header of each body (text or binary)."""
    sign = lambda a: pa.array([None if x is None else signature(secret, x) for x in a.cast(pa.binary()).to_pylist()], pa.string())
    return F.arrow_udf(sign, "string")(body.cast("binary"))


def base_layer(name: Column) -> Column:
    """The layer that a derived layer's name stands for."""
    return F.regexp_replace(name, f"({LABELS}|{BOUNDARY})$", "")
