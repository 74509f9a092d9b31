"""Queries on the funding graph, coordinated pairs and shared holdings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import graph as G
from ledgerloom.sources.tables import table
from ledgerloom.sources.views import FUNDING, HOLDERS, TRADES, funding, holders, trades


def funding_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.degrees(funding(spark, sf_dir))


def funding_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.components(G.undirected(funding(spark, sf_dir), "src", "dst"))


def funding_pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.pagerank(funding(spark, sf_dir))


def funding_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.ancestors(funding(spark, sf_dir), 3)


def shared_funders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funders of two or more wallets within three steps, with the mean distance."""
    a = G.ancestors(funding(spark, sf_dir), 3)
    return a.groupBy("ancestor").agg(F.count("*").alias("wallets"), F.round(F.avg("distance"), 6).alias("mean_distance")).where("wallets >= 2")


def funder_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.first_funding_gap(funding(spark, sf_dir))


def funding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.anchored_windows(funding(spark, sf_dir), "src", "ts", 86_400)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.undirected(table(spark, sf_dir, "wallet_similarities").where("is_coordinated"), "wallet1", "wallet2")


def pair_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.network_summary(_pairs(spark, sf_dir))


def pair_modularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _pairs(spark, sf_dir)
    return G.modularity(e, G.components(e).withColumnRenamed("component", "label"))


def pair_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.label_communities(_pairs(spark, sf_dir))


def pair_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.betweenness(_pairs(spark, sf_dir))


def pair_node_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.learned_vectors(_pairs(spark, sf_dir))


def shared_mint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shared_item_groups(holders(spark, sf_dir), "wallet", "mint", 2)


def pair_shared_mints(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "wallet_similarities").select("wallet1", "wallet2")
    return G.pair_overlaps(pairs, trades(spark, sf_dir), "wallet1", "wallet2", "wallet", "mint")


def size_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten logarithmic size blocks of positive balances per mint."""
    h = holders(spark, sf_dir).withColumn("x", F.log10("balance"))
    span = h.groupBy("mint").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    block = F.when(F.col("hi") - F.col("lo") > 1e-9, F.least(F.floor((F.col("x") - F.col("lo")) * 10 / (F.col("hi") - F.col("lo")) + 1e-9), F.lit(9))).otherwise(F.lit(0))
    return h.join(span, "mint").withColumn("block", block).groupBy("mint", "block").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    funding_degrees, funding_components, funding_pagerank, funding_ancestors, shared_funders, funder_timing, funding_windows, pair_network, pair_modularity,
    pair_communities, pair_betweenness, pair_node_vectors, shared_mint_groups, pair_shared_mints, size_blocks,
)}

_PAIRS = """
    e AS (SELECT DISTINCT least(wallet1, wallet2) AS u, greatest(wallet1, wallet2) AS v FROM wallet_similarities WHERE is_coordinated AND wallet1 <> wallet2)"""
_CLOSE = """
    linked AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
    reach AS (SELECT DISTINCT u AS node, u AS other FROM linked UNION SELECT r.node, l.v FROM reach r JOIN linked l ON l.u = r.other),
    comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""
_UP = """
    up AS (SELECT DISTINCT dst AS node, src AS ancestor FROM funding),
    l2 AS (SELECT DISTINCT a.node, b.ancestor FROM up a JOIN up b ON b.node = a.ancestor),
    l3 AS (SELECT DISTINCT a.node, b.ancestor FROM l2 a JOIN up b ON b.node = a.ancestor),
    anc AS (SELECT node, ancestor, min(distance) AS distance FROM (SELECT *, 1 AS distance FROM up UNION ALL SELECT *, 2 FROM l2 UNION ALL SELECT *, 3 FROM l3) WHERE node <> ancestor GROUP BY ALL)"""


def _communities_sql(rounds: int) -> str:
    steps = "".join(f""",
    v{i} AS MATERIALIZED (SELECT node, label, count(*) AS n FROM (SELECT k.u AS node, r.label FROM linked k JOIN r{i - 1} r ON r.node = k.v UNION ALL SELECT node, label FROM r{i - 1}) GROUP BY ALL),
    r{i} AS MATERIALIZED (SELECT node, arg_min(label, (-n, label)) AS label FROM v{i} GROUP BY node)""" for i in range(1, rounds + 1))
    return f"""WITH {_PAIRS}, linked AS MATERIALIZED (SELECT u, v FROM e UNION SELECT v, u FROM e), r0 AS MATERIALIZED (SELECT DISTINCT u AS node, u AS label FROM linked){steps} SELECT node, label FROM r{rounds}"""


SQL = {
    "pair_communities": _communities_sql(8),
    # Walks of the least length between two nodes are their shortest paths; those through a third are products.
    "pair_betweenness": f"""WITH RECURSIVE {_PAIRS}, linked AS MATERIALIZED (SELECT u, v FROM e UNION SELECT v, u FROM e),
    w AS (SELECT 0 AS k, u AS s, u AS t, 1.0::DOUBLE AS c FROM (SELECT DISTINCT u FROM linked) UNION ALL SELECT w.k + 1, w.s, l.v, sum(w.c) FROM w JOIN linked l ON l.u = w.t WHERE w.k < 250 GROUP BY w.k, w.s, l.v),
    sp AS MATERIALIZED (SELECT s, t, min(k) AS d, arg_min(c, k) AS c FROM w GROUP BY s, t), n AS (SELECT count(DISTINCT u) AS n FROM linked),
    b AS (SELECT a.t AS node, sum(a.c * b.c / x.c) AS x FROM sp a JOIN sp b ON b.s = a.t JOIN sp x ON x.s = a.s AND x.t = b.t AND x.d = a.d + b.d WHERE a.d > 0 AND b.d > 0 GROUP BY a.t)
    SELECT node, round(coalesce(x, 0) / ((n - 1) * (n - 2)), 8) AS betweenness FROM (SELECT DISTINCT u AS node FROM linked) CROSS JOIN n LEFT JOIN b USING (node)""",
    "funding_degrees": f"""WITH {FUNDING}, e AS (SELECT DISTINCT src, dst FROM funding)
    SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node""",
    "funding_components": f"""WITH RECURSIVE {FUNDING}, e AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM funding WHERE src <> dst), {_CLOSE} SELECT * FROM comp""",
    # Every wallet has one funder, so its rank is a sum over its chain of funders; 0.85 ** 200 ends a circle.
    "funding_pagerank": f"""WITH RECURSIVE {FUNDING},
    links AS MATERIALIZED (SELECT DISTINCT src, dst FROM funding), outs AS (SELECT src, 0.85 / count(*) AS part FROM links GROUP BY src),
    up AS MATERIALIZED (SELECT dst, src, part FROM links JOIN outs USING (src)),
    walk AS (SELECT node, node AS at, 1.0::DOUBLE AS w, 0 AS k FROM (SELECT src AS node FROM links UNION SELECT dst FROM links)
      UNION ALL SELECT w.node, u.src, w.w * u.part, w.k + 1 FROM walk w JOIN up u ON u.dst = w.at WHERE w.k < 200),
    x AS (SELECT node, sum(w) AS x FROM walk GROUP BY node)
    SELECT node, round(x / (SELECT sum(x) FROM x), 8) AS rank FROM x""",
    "funding_ancestors": f"WITH {FUNDING}, {_UP} SELECT * FROM anc",
    "shared_funders": f"WITH {FUNDING}, {_UP} SELECT ancestor, count(*) AS wallets, round(avg(distance), 6) AS mean_distance FROM anc GROUP BY ancestor HAVING count(*) >= 2",
    "funder_timing": f"""WITH {FUNDING},
    h AS (SELECT src, hour(ts) AS h, count(*) AS c, min(epoch_us(ts) / 1000000.0) AS a, max(epoch_us(ts) / 1000000.0) AS b FROM funding WHERE ts IS NOT NULL GROUP BY ALL)
    SELECT src, CAST(sum(c) AS BIGINT) AS funded, round(ln(sum(c)) - sum(c * ln(c)) / sum(c) + 0.0, 6) AS hour_entropy, round(max(b) - min(a), 6) AS span_s FROM h GROUP BY src""",
    "funding_windows": f"""WITH RECURSIVE {FUNDING},
    f AS (SELECT src, ts FROM funding WHERE ts IS NOT NULL),
    opened AS (SELECT src, min(ts) AS start FROM f GROUP BY src
      UNION ALL SELECT o.src, (SELECT min(ts) FROM f WHERE f.src = o.src AND f.ts > o.start + INTERVAL 1 DAY) FROM opened o WHERE EXISTS (SELECT 1 FROM f WHERE f.src = o.src AND f.ts > o.start + INTERVAL 1 DAY))
    SELECT o.src, o.start AS window_start, count(*) AS n FROM opened o JOIN f ON f.src = o.src AND f.ts >= o.start AND f.ts <= o.start + INTERVAL 1 DAY GROUP BY ALL""",
    "pair_network": f"""WITH RECURSIVE {_PAIRS}, {_CLOSE},
    deg AS (SELECT u, count(*) AS d FROM linked GROUP BY u),
    t AS (SELECT count(*) AS triangles FROM e a JOIN e b ON b.u = a.v JOIN e c ON c.u = a.u AND c.v = b.v),
    s AS (SELECT max(n) AS largest_component FROM (SELECT count(*) AS n FROM comp GROUP BY component)),
    k AS (SELECT count(*) AS nodes, CAST(sum(d) // 2 AS BIGINT) AS edges, sum(d * (d - 1) / 2) AS open, max(d) AS dmax, sum(d) AS dsum FROM deg)
    SELECT nodes, edges, round(2 * edges / (nodes * (nodes - 1)), 9) AS density, triangles, round(3 * triangles / open, 6) AS transitivity,
           round((nodes * dmax - dsum) / ((nodes - 1) * (nodes - 2)), 6) AS centralization, largest_component FROM k, t, s""",
    "pair_modularity": f"""WITH RECURSIVE {_PAIRS}, {_CLOSE},
    m AS (SELECT count(*) AS m2 FROM linked), c AS (SELECT component, count(*) AS degree FROM linked JOIN comp ON comp.node = linked.u GROUP BY component)
    SELECT round(sum(degree / m2 - pow(degree / m2, 2)), 6) AS modularity FROM c, m""",
    "shared_mint_groups": f"""WITH RECURSIVE {HOLDERS},
    e AS (SELECT a.wallet AS u, b.wallet AS v FROM holders a JOIN holders b ON a.mint = b.mint AND a.wallet < b.wallet GROUP BY ALL HAVING count(*) >= 2), {_CLOSE}
    SELECT node AS wallet, component AS "group" FROM comp""",
    "pair_shared_mints": f"""WITH {TRADES}, h AS (SELECT DISTINCT wallet, mint FROM trades), n AS (SELECT wallet, count(*) AS n FROM h GROUP BY wallet),
    p AS (SELECT DISTINCT wallet1, wallet2 FROM wallet_similarities),
    s AS (SELECT wallet1, wallet2, count(*) AS shared FROM p JOIN h a ON a.wallet = wallet1 JOIN h b ON b.wallet = wallet2 AND b.mint = a.mint GROUP BY ALL)
    SELECT p.wallet1, p.wallet2, coalesce(shared, 0) AS shared, round(CASE WHEN coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(shared, 0) > 0 THEN coalesce(shared, 0) / (coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(shared, 0)) ELSE 0 END, 6) AS jaccard
    FROM p LEFT JOIN s ON s.wallet1 = p.wallet1 AND s.wallet2 = p.wallet2 LEFT JOIN n x ON x.wallet = p.wallet1 LEFT JOIN n y ON y.wallet = p.wallet2""",
    "size_blocks": f"""WITH {HOLDERS}, x AS (SELECT mint, log10(balance) AS x FROM holders), s AS (SELECT mint, min(x) AS lo, max(x) AS hi FROM x GROUP BY mint)
    SELECT mint, CAST(CASE WHEN hi - lo > 1e-9 THEN least(floor((x - lo) * 10 / (hi - lo) + 1e-9), 9) ELSE 0 END AS BIGINT) AS block, count(*) AS n FROM x JOIN s USING (mint) GROUP BY ALL""",
}
