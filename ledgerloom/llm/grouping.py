"""Consolidating pairwise matches into groups by seed-tree pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.scratch import Scratch


def coordinated_pairs(df: DataFrame, a: str, b: str, verdict: str, recency: str, tie: str | None = None) -> DataFrame:
    """(``u``, ``v``), ``u`` < ``v``: unordered pairs whose newest verdict is true.

    The newest is the row with the greatest ``recency`` (nulls lowest), then ``tie``, then verdict. A
    null verdict counts as no. Pairs of a record with itself or with a null link nothing.
    """
    newest = F.max(F.struct(F.col(recency).alias("t"), (F.col(tie) if tie else F.lit(0)).alias("tie"), F.coalesce(verdict, F.lit(False)).alias("yes")))
    ends = df.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    return (
        ends.groupBy(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).agg(newest.alias("n"))
        .where("n.yes").select("u", "v")
    )


def group_pairs(pairs: DataFrame) -> DataFrame:
    """(``member``, ``group_id``) for every end of the given pairs (``u``, ``v``); the id is the group's least member.

    Each round, every vertex proposes the least vertex of its neighbourhood to the whole
    neighbourhood. A vertex that nobody proposed drops out and becomes, in a propagation forest,
    the child of the least vertex proposed to it; the proposals left connect the survivors. Vertices
    that remain without a pair are the seeds of their groups. Their ids then flow down the forest,
    the last round's vertices first. At least half of the vertices with a pair drop out per round
    in practice, so rounds grow with the logarithm of the longest chain.

    Ids need only be ordered (strings go by bytes). Minima are pre-aggregated before each shuffle;
    joins are equi-joins whose one side is unique in the key, so that AQE may split a vertex with
    a third of all pairs. Each round is a written table. Nulls, self pairs, repeated and reversed
    pairs are allowed; no pairs give no rows.
    """
    scratch = Scratch(pairs.sparkSession, "groups")
    u, v = F.col("u"), F.col("v")
    edges = scratch.save(
        pairs.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    )
    dropped: list[DataFrame] = []
    seeds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select("u", "v").unionByName(edges.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        proposals = scratch.save(
            both.join(least, "u").select(F.col("v").alias("x"), "m").unionByName(least.select(F.col("u").alias("x"), "m")).distinct()
        )
        parents = proposals.groupBy("x").agg(F.min("m").alias("parent"), F.max(F.col("m") == F.col("x")).alias("kept"))
        verdict = scratch.save(parents)
        after = scratch.save(
            proposals.join(verdict.select("x", "parent"), "x").where(F.col("m") != F.col("parent"))
            .select(F.least("m", "parent").alias("u"), F.greatest("m", "parent").alias("v")).distinct()
        )
        dropped.append(verdict.where(~F.col("kept")).select("x", "parent"))
        # Kept vertices that no remaining pair touches are the least of their group.
        alive = after.select("u").unionByName(after.select(v.alias("u"))).distinct()
        seeds.append(verdict.where("kept").join(alive, F.col("x") == F.col("u"), "left_anti").select("x"))
        scratch.discard(proposals)  # the pairs stay: seeds are told by them below
        edges = after
    labels = None
    for level, (gone, ended) in enumerate(zip(reversed(dropped), reversed(seeds), strict=True), 1):
        below = ended.select(F.col("x").alias("member"), F.col("x").alias("group_id"))
        known = below if labels is None else labels.unionByName(below)
        flowed = gone.join(known, gone.parent == known.member).select(F.col("x").alias("member"), "group_id")
        labels = known.unionByName(flowed)
        if level % 2 == 0 or level == len(dropped):  # each level reads the one below it twice
            labels = scratch.save(labels)
    if labels is None:
        kind = dict(pairs.dtypes)["u"]
        return pairs.sparkSession.createDataFrame([], f"member {kind}, group_id {kind}")
    return labels
