"""Graph operators: loops of joins, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.store import passes, save, scratch


def _cut(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Cuts lineage with a table in the checkpoint folder; the shuffle files behind it go."""
    return save(df, folder)


def reachable(roots: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(root, node, depth) of everything reached from each root (root, node) over edges (source, target), by the shortest way."""
    reached = _cut(roots.select("root", "node", F.lit(0).alias("depth")).distinct())
    front, depth = reached, 0
    steps = _cut(edges.select(F.col("source").alias("node"), F.col("target")).distinct())
    while most is None or depth < most:
        depth += 1
        near = front.join(steps, "node").select("root", F.col("target").alias("node")).distinct()
        front = _cut(near.join(reached, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        reached = reached.union(front)
        if depth % 3 == 0:
            reached = _cut(reached)
    return reached


def reachable_in_passes(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``reachable``, for roots that reach much; many edges are walked in passes over the roots, whose results lie together by root."""
    ways = _cut(edges.select("source", "target").distinct())
    near = lambda part: reachable(part, ways).repartition("root").sortWithinPartitions("root", "depth")
    return passes(roots.select("root", "node"), "root", near, ways.count() // 4)


def impact(roots: DataFrame, edges: DataFrame, depth: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """Callers of each root (root, node) level by level: claims (root, node, depth, parent) and frontiers (root, node, reason).

    edges are (caller, callee, idx, status). The first way to a node counts,
    in order of its parent's place and the edge's number. An edge that isn't
    verified is a frontier, and so is a new node when the root's budget of
    nodes is used up; at the last depth each node with callers is one.
    """
    claims = _cut(roots.select("root", "node", F.lit(0).alias("depth"), F.lit(None).cast(roots.schema["node"].dataType).alias("parent"), F.lit(0).cast("long").alias("place")))
    fronts: DataFrame | None = None
    level = claims
    for d in range(1, depth + 1):
        step = level.select("root", F.col("node").alias("callee"), "place").join(edges, "callee")
        step = step.withColumn("ok", F.col("status") == "verified").join(claims.select("root", F.col("node").alias("caller"), F.lit(True).alias("old")), ["root", "caller"], "left")
        first = Window.partitionBy("root", "caller").orderBy("place", "idx", "callee")
        fresh = step.filter("ok and old is null").withColumn("n", F.row_number().over(first)).filter("n = 1")
        have = claims.groupBy("root").agg(F.count("*").alias("have"))
        fresh = fresh.join(have, "root").withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy("place", "idx", "callee", "caller")))
        fresh = _cut(fresh.withColumn("fits", F.col("have") + F.col("rank") <= budget))
        out = step.filter("not ok").select("root", F.col("caller").alias("node"), F.lit("unresolved_dynamic_caller").alias("reason")).union(fresh.filter("not fits").select("root", F.col("caller"), F.lit("budget_exhausted"))).distinct()
        fronts = out if fronts is None else fronts.union(out).distinct()
        level = fresh.filter("fits").select("root", F.col("caller").alias("node"), F.lit(d).alias("depth"), F.col("callee").alias("parent"), F.col("rank").cast("long").alias("place"))
        if level.isEmpty():
            break
        claims = _cut(claims.union(level))
    else:
        deeper = level.select("root", F.col("node").alias("callee")).join(edges.select("callee"), "callee", "left_semi")
        fronts = fronts.union(deeper.select("root", F.col("callee"), F.lit("depth_limit"))).distinct() if fronts is not None else deeper
    return claims.drop("place"), fronts


def impact_claims(roots: DataFrame, edges: DataFrame, depth: int, budget: int) -> DataFrame:
    """The claims of ``impact`` alone, over no more edges than can lead to one.

    A node is claimed by one of the first ``budget`` verified edges of its
    parent: those before it lead to claimed nodes, which are fewer. A parent
    with so many uses up the budget, so none behind it claims a node.
    """
    good = edges.filter("status = 'verified'").groupBy("callee", "caller").agg(F.min("idx").alias("idx"))
    order = Window.partitionBy("callee").orderBy("idx", "caller")
    good = _cut(good.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= budget))
    full = good.filter(F.col("_n") == budget).select("callee", F.lit(True).alias("_full"))
    good = good.drop("_n")
    claims = _cut(roots.select("root", "node", F.lit(0).alias("depth"), F.lit(None).cast(roots.schema["node"].dataType).alias("parent"), F.lit(0).cast("long").alias("place")))
    level = claims
    for d in range(1, depth + 1):
        have = claims.groupBy("root").agg(F.count("*").alias("have")).filter(F.col("have") < budget)
        parents = level.select("root", F.col("node").alias("callee"), "place").join(full, "callee", "left")
        parents = parents.withColumn("_last", F.min(F.when(F.col("_full"), F.col("place"))).over(Window.partitionBy("root"))).filter("_last is null or place <= _last")
        step = parents.drop("_full", "_last").join(have.select("root"), "root", "left_semi").join(good, "callee")
        step = step.join(claims.select("root", F.col("node").alias("caller")), ["root", "caller"], "left_anti")
        first = Window.partitionBy("root", "caller").orderBy("place", "idx", "callee")
        fresh = step.withColumn("n", F.row_number().over(first)).filter("n = 1").join(have, "root")
        fresh = fresh.withColumn("rank", F.row_number().over(Window.partitionBy("root").orderBy("place", "idx", "callee", "caller"))).filter(F.col("have") + F.col("rank") <= budget)
        level = _cut(fresh.select("root", F.col("caller").alias("node"), F.lit(d).alias("depth"), F.col("callee").alias("parent"), F.col("rank").cast("long").alias("place")))
        claims = claims.union(level)
        if d == depth or level.isEmpty():
            break
    return claims.drop("place")


def expand_calls(entries: DataFrame, calls: DataFrame, limit: int) -> DataFrame:
    """(entry, path, node, depth, cycle, truncated): the call tree of each entry; a node on its own path is a cycle, the limit cuts off.

    The last level, which is the largest, is neither written nor shuffled:
    whether a call leads on is known of the calls before they are joined.
    """
    with scratch(calls.sparkSession) as home:
        once = _cut(calls.select(F.col("caller").alias("node"), F.col("callee")).distinct())
        callers = once.select(F.col("node").alias("callee"), F.lit(True).alias("_more")).distinct()
        pairs = _cut(once.join(callers, "callee", "left"), home)
    level = entries.select(F.array("node").alias("path"), "node", F.lit(False).alias("cycle"))
    out = None
    for d in range(limit + 1):
        if d:
            step = level.filter("not cycle").select("path", "node").join(pairs, "node")
            level = step.select(F.concat("path", F.array("callee")).alias("path"), F.col("callee").alias("node"), F.array_contains("path", F.col("callee")).alias("cycle"), *(["_more"] if d == limit else []))
            level = _cut(level) if d < limit else level
        elif limit == 0:
            level = level.join(pairs.select("node", F.lit(True).alias("_more")).distinct(), "node", "left")
        more = F.coalesce("_more", F.lit(False)) & ~F.col("cycle") if d == limit else F.lit(False)
        rows = level.select(F.col("path")[0].alias("entry"), "path", "node", F.lit(d).alias("depth"), "cycle", more.alias("truncated"))
        out = rows if out is None else out.union(rows)
    return out


def chain_walk(pointers: DataFrame, heads: DataFrame) -> DataFrame:
    """(key, node): nodes on the chains from heads (key, node) along pointers (key, node, next), by doubling the pointers.

    A pointer leads to a larger node, so the pointers run out after as many
    rounds as the longest chain can be halved.
    """
    jump = _cut(pointers.filter("next > node").select("key", "node", "next"))
    reached = heads.select("key", "node").distinct()
    while True:
        more = reached.join(jump, ["key", "node"]).select("key", F.col("next").alias("node"))
        reached = _cut(reached.union(more).distinct())
        if jump.isEmpty():
            return reached
        far = jump.alias("b").select("key", F.col("node").alias("mid"), F.col("next").alias("far"))
        jump = _cut(jump.withColumnRenamed("next", "mid").join(far, ["key", "mid"]).select("key", "node", F.col("far").alias("next")))


def source_boundary(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """(flow, ordinal): nearest readable steps before unreadable ones, over chains of unreadable steps."""
    back = edges.select("flow", F.col("step_ordinal").alias("prev"), F.col("target_ordinal").alias("ordinal")).distinct()
    dark = steps.filter("not readable").select("flow", "ordinal")
    found = None
    front = _cut(dark)
    seen = front
    while True:
        before = front.join(back, ["flow", "ordinal"]).select("flow", F.col("prev").alias("ordinal")).distinct()
        lit_ = before.join(steps.filter("readable"), ["flow", "ordinal"], "left_semi")
        found = lit_ if found is None else found.union(lit_)
        front = _cut(before.join(dark, ["flow", "ordinal"], "left_semi").join(seen, ["flow", "ordinal"], "left_anti"))
        if front.isEmpty():
            return found.distinct()
        seen = _cut(seen.union(front))
