"""Hash identities, as Spark columns. Parts are joined by NUL, so no two lists of parts collide."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\u0000"


def sha256(*parts: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of the parts as text."""
    text = [p.cast("string") for p in parts]
    return F.sha2(F.concat_ws(NUL, *text) if len(text) > 1 else text[0], 256)


def short_id(prefix: str, *parts: Column) -> Column:
    """``prefix-`` and the first 16 digits of the hash."""
    return F.concat(F.lit(prefix + "-"), F.substring(sha256(*parts), 1, 16))


def flow_id(entry: Column) -> Column:
    return short_id("flow", entry)


def step_id(flow: Column, ordinal: Column, symbol: Column) -> Column:
    return F.concat(F.lit("step-"), F.substring(F.sha2(F.concat(flow, F.lit("#"), ordinal.cast("string"), F.lit(":"), symbol), 256), 1, 16))


def entry_split(entry: Column) -> Column:
    """struct(file, symbol, member, canonical) of ``file#Symbol.member``."""
    file, symbol = F.substring_index(entry, "#", 1), F.when(F.contains(entry, F.lit("#")), F.regexp_extract(entry, "#(.*)$", 1)).otherwise(F.lit(""))
    return F.struct(file.alias("file"), symbol.alias("symbol"), F.substring_index(symbol, ".", -1).alias("member"), entry.rlike(r"^[^#\s]+#[A-Za-z_$][\w$]*(\.[A-Za-z_$][\w$]*)*$").alias("canonical"))


def artifact_ref(content: Column) -> Column:
    return F.concat(F.lit("cas:sha256:"), F.sha2(content, 256))


def joined_hash(item: Column, *order: Column) -> Column:
    """An aggregate: SHA-256 of all items of a group, in the given order.

    The items of one group (a repository's lines of path and hash, about 100
    bytes each) are held in one row, so a group has at most 2 GB of them.
    """
    rows = F.sort_array(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], item.alias("item"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r["item"]), ""), 256)
