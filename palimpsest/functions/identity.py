"""Content-addressed identities: SHA-256 over fields that are joined by NUL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F



def _joined(*fields: Column) -> Column:
    out = fields[0].cast("string")
    for f in fields[1:]:
        out = F.concat(out, F.lit("\0"), f.cast("string"))
    return out


def key(*fields: Column) -> Column:
    """Hex SHA-256 of NUL-joined fields; null if any field is null."""
    return F.sha2(_joined(*fields), 256)


def shard(path: Column, shards: int) -> Column:
    """Shard of a source: the first 64 bits of its key, modulo the number of shards."""
    head = F.conv(F.substring(F.sha2(path, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.pmod(head, F.lit(shards).cast("decimal(20,0)")).cast("int")
