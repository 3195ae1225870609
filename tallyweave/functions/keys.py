"""Row keys built from hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dim_signature(dims: Sequence[str]) -> Column:
    """First 16 hex digits of sha256 over ``dim=value`` pairs, in alphabetical order."""
    pairs = [F.concat(F.lit(f"{d}="), F.col(d)) for d in sorted(dims)]
    return F.substring(F.sha2(F.concat_ws("|", *pairs), 256), 1, 16)


def event_key(actor: Column, *facts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(actor, F.lit("")), *facts), 256)


def chain_hash(previous: Column, key: Column) -> Column:
    return F.sha2(F.concat(F.coalesce(previous, F.lit("")), F.lit("|"), key), 256)


def row_digest(columns: Sequence[str]) -> Column:
    """sha256 of a row's JSON; fields in name order, NULLs kept."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def lane(digest: Column, index: int) -> Column:
    """The index-th 60-bit piece of a hex digest, as a long."""
    return F.conv(F.substring(digest, 1 + 15 * index, 15), 16, 10).cast("long")
