"""Splits that keep related records together: components by random-mate contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelab.operators.resample import order_hash
from quirelab.session import cut

#: Ranges of the hash over which weights are summed up; a power of two.
PIECES = 1 << 14


def star_edges(links: DataFrame, via: str, vertex: str) -> DataFrame:
    """Edges ``a, b`` between vertices that share a ``via`` value: each to the least one.

    Distinct links first, so a value on very many rows costs one row per vertex, and never all
    pairs. Null on either side links nothing.
    """
    pairs = cut(links.select(F.col(via).alias("v"), F.col(vertex).alias("b")).where("v is not null and b is not null").distinct())
    least = pairs.groupBy("v").agg(F.min("b").alias("a"))
    return pairs.join(least, "v").where("a <> b").select("a", "b").distinct()


def components(edges: DataFrame, seed: int = 7, most_rounds: int = 200) -> DataFrame:
    """Connected components of ``a, b``: ``vertex, component`` for every vertex of an edge.

    Random mate: each round every vertex tosses a coin (a hash of vertex and round); a vertex with
    tails and a neighbour with heads is merged into the least such neighbour. Edges are renamed,
    loops and repeats dropped, until none is left: about a quarter of the vertices of any
    component goes each round. Then the labels are unwound, latest round first. ``component`` is
    the least vertex of each component. A round costs two joins on vertices; since a hub keeps
    its many edges over rounds, joins on it are left to AQE's skew handling. The joins are merge
    joins at every size: a broadcast takes 16 MB of the driver each, and there are many rounds.
    """
    spark = edges.sparkSession
    kind = edges.schema["a"].dataType.simpleString()
    live = cut(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    vertices = live.select(F.col("a").alias("vertex")).union(live.select("b")).distinct()
    rounds: list[DataFrame] = []
    while not live.isEmpty():
        if len(rounds) >= most_rounds:
            raise RuntimeError("contraction did not end")
        heads = lambda c: F.pmod(F.xxhash64(c, F.lit(seed), F.lit(len(rounds))), F.lit(2)) == 0
        both = live.select("a", "b").unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        merged = cut(both.where(~heads(F.col("a")) & heads(F.col("b"))).groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("into")))
        rounds.append(merged)
        first = live.join(merged.select(F.col("vertex").alias("a"), F.col("into").alias("x")).hint("merge"), "a", "left").select(F.coalesce("x", "a").alias("a"), "b")
        second = first.join(merged.select(F.col("vertex").alias("b"), F.col("into").alias("y")).hint("merge"), "b", "left").select("a", F.coalesce("y", "b").alias("b"))
        live = cut(second.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # A vertex that was merged into another is not merged again, so roots are found backwards.
    # Each step uses the roots so far twice; without a cut the plan would double every round.
    roots = spark.createDataFrame([], f"vertex {kind}, root {kind}")
    for merged in reversed(rounds):
        step = merged.join(roots.select(F.col("vertex").alias("into"), "root").hint("merge"), "into", "left").select("vertex", F.coalesce("root", "into").alias("root"))
        roots = cut(roots.unionByName(step))
    labelled = vertices.join(roots, "vertex", "left").select("vertex", F.coalesce("root", "vertex").alias("root"))
    least = labelled.groupBy("root").agg(F.min("vertex").alias("component"))
    return labelled.join(least, "root").select("vertex", "component")


def running_start(rows: DataFrame, weight: str, key: Column, seed: int = 7) -> DataFrame:
    """Add ``start``, the sum of ``weight`` over all rows before this one in random order, and ``total``.

    The order is that of the MD5 of seed and key (60 bits), then of the key. The sum is taken in
    two steps, over PIECES ranges of the hash (a table of that size) and then within a range, so no
    sort is global.
    """
    h = rows.withColumn("_h", order_hash(seed, key)).withColumn("_piece", F.expr(f"floor(_h / {(1 << 60) // PIECES})"))
    sums = h.groupBy("_piece").agg(F.sum(weight).alias("_w"))
    order = Window.orderBy("_piece")  # over at most PIECES rows
    sums = sums.select("_piece", (F.sum("_w").over(order) - F.col("_w")).alias("_before"), F.sum("_w").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("_piece").orderBy("_h", key).rowsBetween(Window.unboundedPreceding, -1)
    # One row per range: at most PIECES.
    return h.join(F.broadcast(sums), "_piece").withColumn("start", F.col("_before") + F.coalesce(F.sum(weight).over(within), F.lit(0))).drop("_h", "_piece", "_before")


def split_groups(weights: DataFrame, parts: dict[str, float], seed: int = 7) -> DataFrame:
    """Assign groups ``component, weight`` to parts of the given proportions: adds ``part``.

    Groups are lined up in random order (see :func:`running_start`); a group goes to the part in
    which the middle of its stretch of the cumulative weight falls. A group is never cut, so a part
    is off by at most half the weight of the groups at its ends. Null or negative weights count as
    0. ``component`` is unique.
    """
    total_share = sum(parts.values())
    rows = weights.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0)), F.lit(0)))
    placed = running_start(rows, "weight", F.col("component"), seed)
    middle = F.try_divide(F.col("start") * 2 + F.col("weight"), F.col("total") * 2)
    names, bounds = list(parts), []
    for name in names:
        bounds.append((bounds[-1] if bounds else 0) + parts[name] / total_share)
    part = F.lit(names[-1])
    for name, bound in reversed(list(zip(names[:-1], bounds))):
        part = F.when(F.coalesce(middle, F.lit(0.0)) < bound, name).otherwise(part)
    return placed.select(*weights.columns, part.alias("part"))


def split_records(records: DataFrame, groups: DataFrame, parts: dict[str, float], seed: int = 7) -> DataFrame:
    """Assign records to parts so that records of one group stay together: ``record_id, vertex, component, part``.

    ``records``: ``record_id, vertex``, one row each; ``groups``: ``vertex, component``. A vertex
    without a component is its own group. A record without a vertex is held by nothing and a group
    of its own, named by its id; so every record comes out, in exactly one part.
    """
    named = records.join(groups, "vertex", "left").select("record_id", "vertex", F.coalesce("component", "vertex", F.concat(F.lit("record "), F.col("record_id").cast("string"))).alias("component"))
    sizes = named.groupBy("component").agg(F.count("*").alias("weight"))
    chosen = split_groups(sizes, parts, seed).select("component", "part")
    return named.join(chosen, "component").select("record_id", "vertex", "component", "part")


def split_report(placed: DataFrame, parts: dict[str, float]) -> DataFrame:
    """Shares reached: ``part, wanted, groups, records, share``, for parts that got records."""
    n = placed.groupBy("component", "part").count().groupBy("part").agg(F.count("*").alias("groups"), F.sum("count").alias("records"))
    total = sum(parts.values())
    wanted = F.create_map(*(F.lit(x) for k, v in parts.items() for x in (k, v / total)))
    share = F.col("records") / F.sum("records").over(Window.partitionBy())  # one row a part
    return n.select("part", wanted[F.col("part")].alias("wanted"), "groups", "records", share.alias("share"))


def torn_groups(listed: DataFrame, groups: DataFrame) -> DataFrame:
    """Listed members of groups that a split tears apart: ``split_id, member``.

    ``listed``: ``split_id, fold, member``; ``groups``: ``vertex, component`` (a member without
    one is its own group). A case is each listed member of a group whose listed members stand in
    more than one fold of that split. Null folds are no fold; null members are left out.
    """
    rows = listed.where("member is not null").join(groups.select(F.col("vertex").alias("member"), "component"), "member", "left")
    rows = rows.select("split_id", "fold", "member", F.coalesce("component", "member").alias("component"))
    spread = rows.groupBy("split_id", "component").agg(F.min("fold").alias("lo"), F.max("fold").alias("hi")).where("lo <> hi").select("split_id", "component")
    return rows.join(spread, ["split_id", "component"]).select("split_id", "member").distinct()
