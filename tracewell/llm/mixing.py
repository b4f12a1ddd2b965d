"""Mixing of sources to target weights by Pareto order sampling, with DataFrame functions alone.

A source's target, in words, is its share of the mix by weight, up to a bound.
Each document may expect target / size of its source copies, or more or less
by its priority; the whole copies are certain, the fraction left is its
inclusion probability. Documents are ranked by random odds over inclusion
odds, and the first ones whose words make up the fractions' sum are taken.

Samples are drawn by source and length class (number of binary digits of the
size), after those of the few documents that are long against the source's
words, and what these take too much or too little is made up by all classes.
Where an order is cut is found by two histograms of 256 bins, and rows are ranked in
the last bin alone; no source or class has to fit into a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tracewell.llm.store import join_small, remove, save

WEIGHTS = (5, 2, 1)
#: Words of the mix to all words, and words taken of a document to its own.
SHARE, MOST = 1.5, 2
BINS = 256
#: Documents of a source that are added one by one to fill what the samples of its classes leave.
FILLS = 4
#: Documents of over this part of the words that a source's fractions make up are taken by themselves, before the others.
GIANT = 16
#: Sources (or sources and classes) up to this number are broadcast, some 50 bytes each.
MAX_BROADCAST_ROWS = 100_000
SOURCES_PER_PART = 100_000
#: Added to sums of fractions, so that a sum which should be whole isn't just below.
ROUNDING = 1e-6
WORD = r"[^\x20\x09-\x0D]+"


def water_level(items: DataFrame, groups: DataFrame, made: list[str]) -> DataFrame:
    """(place, level): the level at which min(cap, level * weight) of a group's ``items`` (place, weight, cap) adds up to its ``amount``.

    Items stop at their cap; what they leave is shared among the others by
    weight, again until none is above. Each round only adds up; a group whose
    caps are all below its amount gets no level.
    """
    n, stopped, levels = groups.count(), -1, None
    while True:
        full = F.lit(False) if levels is None else F.col("level").isNull() | (F.col("cap") <= F.col("level") * F.col("weight"))
        now = items if levels is None else join_small(items, levels, "place", "left", n, MAX_BROADCAST_ROWS)
        sums = now.groupBy("place").agg(F.sum(F.when(full, F.col("cap")).otherwise(0)).alias("caps"), F.sum(F.when(~full, F.col("weight"))).alias("free"), F.count(F.when(full, 1)).alias("stopped"))
        levels = save(sums.join(groups, "place").select("place", F.expr("if(free > 0, (amount - caps) / free, null)").cast("double").alias("level"), "stopped"), "levels", made)
        before, stopped = stopped, levels.agg(F.sum("stopped")).first()[0] or 0
        levels = levels.drop("stopped")
        if stopped == before or not n:
            return levels


def source_level(sources: DataFrame, share: float, most: int) -> float | None:
    """As ``water_level``, for all sources together: the driver gets three sums a round."""
    level, stopped = None, -1
    while True:
        cap = F.lit(most) * F.col("source_size")
        full = F.lit(False) if level is None else cap <= F.lit(level) * F.col("weight")
        r = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, cap).otherwise(0)).alias("caps"), F.sum(F.when(~full, F.col("weight"))).alias("free"), F.count(F.when(full, 1)).alias("stopped")).first()
        if r["stopped"] == stopped or not r["free"]:
            return level if r["free"] else None
        level, stopped = (r["all"] * share - r["caps"]) / r["free"], r["stopped"]


def placed(sources: DataFrame, made: list[str]) -> DataFrame:
    """``sources`` with their place by code point from 0, null last; numbered by ranges, so no task holds them all."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = max(1, sources.count() // SOURCES_PER_PART)
    dealt = save(sources.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "sources", made)
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    first = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))
    return dealt.join(first, "part").withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("first")).drop("part", "first")


def cuts(rows: DataFrame, wants: DataFrame, made: list[str]) -> DataFrame:
    """(place, kind, cut): the last key of each stratum whose words, in the order of ``key``, stay within ``want``.

    ``rows`` has place, kind, key (a struct that begins with ``v``, from 0 to 1) and words.
    """
    stratum, n, at = ["place", "kind"], wants.count(), wants.withColumns({"before": F.lit(0).cast("long"), "low": F.lit(0.0)})
    scale = 1
    for _ in range(2):
        scale *= BINS
        bin_ = F.least(F.floor(F.col("v") * scale), F.lit(scale - 1))
        inside = join_small(rows, at, stratum, "inner", n, MAX_BROADCAST_ROWS).filter((F.col("v") >= F.col("low")) & (F.col("v") < F.col("low") + BINS / scale))
        sums = inside.groupBy(*stratum, "want", "before", bin_.alias("bin")).agg(F.sum("words").alias("words"))
        upto = F.col("before") + F.sum("words").over(Window.partitionBy(*stratum).orderBy("bin"))
        found = sums.withColumn("upto", upto).filter("upto > want and upto - words <= want")
        at = save(found.select(*stratum, "want", (F.col("upto") - F.col("words")).alias("before"), (F.col("bin") / scale).alias("low")), "bins", made)
    inside = join_small(rows, at, stratum, "inner", n, MAX_BROADCAST_ROWS).filter((F.col("v") >= F.col("low")) & (F.col("v") < F.col("low") + 1 / scale))
    upto = F.col("before") + F.sum("words").over(Window.partitionBy(*stratum).orderBy("key"))
    last = inside.withColumn("upto", upto).groupBy(*stratum).agg(F.max(F.when(F.col("upto") <= F.col("want"), F.col("key"))).alias("last"))
    edge = F.struct(F.col("low").alias("v"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("size"))
    return save(at.join(last, stratum, "left").select(*stratum, F.coalesce("last", edge).alias("cut")), "cuts", made)


def giants(rows: DataFrame, budgets: DataFrame, n: int) -> DataFrame:
    """``budgets`` with ``last``, the last key taken among a place's documents of over a GIANTth of its budget, and ``factor`` by which other documents' fractions then count.

    Giants are few, whatever the place's size; they are taken in order while
    that comes nearer to the sum of their fractions.
    """
    known = join_small(rows, budgets, "place", "inner", n, MAX_BROADCAST_ROWS).withColumn("giant", F.expr(f"words > budget / {GIANT}"))
    upto = F.sum("words").over(Window.partitionBy("place").orderBy("key"))
    own = F.sum("part").over(Window.partitionBy("place")) + ROUNDING
    large = known.filter("giant").withColumn("taken", upto - F.col("words") / 2 <= own)
    large = large.groupBy("place").agg(F.max(F.when(F.col("taken"), F.col("key"))).alias("last"), F.coalesce(F.sum(F.when(F.col("taken"), F.col("words"))), F.lit(0)).alias("held"))
    others = known.filter("not giant").groupBy("place").agg(F.sum("part").alias("others"))
    now = join_small(join_small(budgets, large, "place", "left", n, MAX_BROADCAST_ROWS), others, "place", "left", n, MAX_BROADCAST_ROWS)
    return now.select("place", "budget", "last", F.expr("greatest(0D, budget - coalesce(held, 0)) / others").alias("factor"))


def mix(docs: DataFrame, priority: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken), one row per row of ``docs`` (doc_id, source, text).

    A null or empty text has size 0 and nothing is taken of it. Null sources
    are one source, the last. ``priority`` (positive; else 1) raises a
    document's inclusion odds within its source. Random numbers are hashes of
    ``seed``, id and size, so reruns agree; rows that are equal in source, id,
    size and priority are one unit, taken together. Ties go by id, then size.
    What the samples leave of a target is filled by a few single documents. ``share`` over ``most``
    brings every source to ``most`` times its size. An empty table gives an
    empty result; other columns of ``docs`` are ignored.
    """
    made: list[str] = []
    given = F.lit(1.0) if priority is None else priority.cast("double")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.when((given > 0) & (given < float("inf")), given).otherwise(1.0).alias("priority"))
    units = save(rows.groupBy("source", "doc_id", "size", "priority").agg(F.count("*").alias("copies")).withColumn("words", F.col("size") * F.col("copies")), "units", made)

    by_source = placed(units.groupBy("source").agg(F.sum("words").alias("source_size")), made)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    by_source = save(by_source.withColumn("weight", weight), "sources", made)
    n = by_source.count()
    level = source_level(by_source, share, most)
    cap = most * F.col("source_size").cast("double")
    own = cap if level is None else F.least(cap, level * F.col("weight"))
    targets = save(by_source.select("place", "source", "source_size", own.alias("target")), "targets", made)

    named = targets.withColumnRenamed("source", "its")
    named = F.broadcast(named) if n <= MAX_BROADCAST_ROWS else named
    units = units.join(named, F.col("source").eqNullSafe(F.col("its"))).drop("its")
    if priority is None:
        units = units.withColumn("expected", F.expr(f"if(source_size > 0, least({most}D, target / source_size), 0D)"))
    else:
        items = units.select("place", (F.col("priority") * F.col("words")).alias("weight"), (most * F.col("words")).alias("cap"))
        levels = save(water_level(items, targets.select("place", F.col("target").alias("amount")), made), "priorities", made)
        units = join_small(units, levels, "place", "left", n, MAX_BROADCAST_ROWS).withColumn("expected", F.expr(f"least({most}D, coalesce(level * priority, {most}D))"))
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("size").cast("string"))), 1, 12), 16, 10).cast("long") + 0.5) / 2**48
    units = units.withColumns({"base": F.floor("expected"), "kind": F.length(F.bin("size")), "u": u}).withColumn("chance", F.col("expected") - F.col("base"))
    odds = F.when(F.col("chance") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("chance") / (1 - F.col("chance"))))
    units = units.withColumn("odds", odds).withColumn("v", F.expr("if(odds is null, null, least(odds / (1 + odds), 1 - pow(2, -53)))")).withColumn("key", F.struct("v", "doc_id", "size"))

    open_ = units.filter("v is not null and words > 0").withColumn("part", F.col("chance") * F.col("words"))
    budgets = save(open_.groupBy("place").agg((F.sum("part") + ROUNDING).alias("budget")), "budgets", made)
    budgets = save(giants(open_, budgets, n), "budgets", made)
    known = join_small(units, budgets, "place", "left", n, MAX_BROADCAST_ROWS).withColumn("giant", F.expr(f"words > budget / {GIANT}"))
    rest = known.filter("v is not null and words > 0 and not giant")
    wants = save(rest.groupBy("place", "kind", "factor").agg(F.sum(F.col("chance") * F.col("words")).alias("want")).select("place", "kind", (F.col("want") * F.col("factor") + ROUNDING).alias("want")), "wants", made)
    found = cuts(rest.select("place", "kind", "v", "key", "words"), wants, made)
    chosen = join_small(known, found, ["place", "kind"], "left", wants.count(), MAX_BROADCAST_ROWS)
    first = F.when(F.col("giant"), F.col("key") <= F.col("last")).otherwise(F.col("cut").isNull() | (F.col("key") <= F.col("cut")))
    open_ = F.col("v").isNotNull() & (F.col("words") > 0)
    chosen = chosen.withColumn("picked", open_ & F.coalesce(first, F.lit(False)))
    chosen = save(chosen.select("place", "doc_id", "source", "size", "copies", "words", "source_size", "target", "key", (F.col("base") + F.col("picked").cast("long")).alias("times"), (open_ & ~F.col("picked")).alias("free")), "chosen")
    state = save(filled(chosen, n, made).select("place", "fills"), "fills")
    out = join_small(chosen, state, "place", "left", n, MAX_BROADCAST_ROWS).withColumn("times", F.col("times") + _among("fills").cast("long"))
    remove(docs.sparkSession, made)
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def _among(keys: str) -> Column:
    return F.exists(keys, lambda x: x.eqNullSafe(F.col("key")))


def filled(chosen: DataFrame, n: int, made: list[str]) -> DataFrame:
    """(place, gap, fits, miss, fills): up to FILLS documents that fit into each source's gap, one by one the largest.

    ``fits`` leave ``gap``; ``fills`` is the best set found, off by ``miss``:
    the fits of some round, or those and one document that goes over.
    """
    gap = F.first("target") - F.sum(F.col("words") * F.col("times"))
    none = F.array().cast(ArrayType(chosen.schema["key"].dataType))
    state = save(chosen.groupBy("place").agg(gap.alias("gap")).select("*", none.alias("fits"), F.abs("gap").alias("miss"), none.alias("fills")), "gaps", made)
    for _ in range(FILLS):
        free = join_small(chosen.filter("free"), state, "place", "inner", n, MAX_BROADCAST_ROWS).filter("words < 2 * gap").filter(~_among("fits"))
        near = F.struct(F.abs(F.col("gap") - F.col("words")).alias("miss"), F.col("key"))
        found = free.groupBy("place").agg(F.min(F.when(F.expr("words <= gap"), near)).alias("fit"), F.min(F.when(F.expr("words > gap"), near)).alias("over"))
        now = join_small(state, found, "place", "left", n, MAX_BROADCAST_ROWS)
        longer = F.array_append("fits", F.col("fit.key"))
        options = [F.struct("miss", "fills"), F.when(F.col("over").isNotNull(), F.struct(F.col("over.miss").alias("miss"), F.array_append("fits", F.col("over.key")).alias("fills"))), F.when(F.col("fit").isNotNull(), F.struct(F.col("fit.miss").alias("miss"), longer.alias("fills")))]
        best = F.least(*options)
        state = save(now.select("place", F.coalesce("fit.miss", "gap").alias("gap"), F.when(F.col("fit").isNull(), F.col("fits")).otherwise(longer).alias("fits"), best["miss"].alias("miss"), best["fills"].alias("fills")), "fills", made)
    return state
