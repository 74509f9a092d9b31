"""Queries of fitted models, permutation tests and regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import graph as G
from ledgerloom.operators import models as M
from ledgerloom.operators import series as S
from ledgerloom.plans.evaluation_queries import _LABELS, _labels
from ledgerloom.plans.graph_queries import _pairs
from ledgerloom.sources.tables import table
from ledgerloom.sources.views import TRADES, trades


def value_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.permutation_test(table(spark, sf_dir, "events"), "event_type", "event_id", F.col("value"))


def synchronised_wallets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.synchronised_groups(trades(spark, sf_dir), "mint", "wallet", "ts", "signature", 900.0, 2)


def pair_eigenvector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.eigenvector(_pairs(spark, sf_dir))


def vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.kmeans(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)


def isotonic_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.isotonic(_labels(spark, sf_dir))


def brier_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.recent_brier(_labels(spark, sf_dir), "domain", "created_at", "id")


def forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.walk_forward(table(spark, sf_dir, "events"), "ts")


def value_posteriors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.conjugate_updates(table(spark, sf_dir, "events"), "event_type", "value", mean0=200.0)


def volume_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = S.daily(trades(spark, sf_dir), ["mint"], "ts", {"volume": F.abs("amount")})
    return M.hidden_regimes(days.withColumn("volume", F.log1p("volume")), "mint", "volume")


def wallet_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = S.activity(trades(spark, sf_dir), ["wallet"], "ts", ["signature"])
    return M.isolation_scores(a, "wallet", ["n", "per_day", "burstiness"])


def position_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = M.evolution(trades(spark, sf_dir), "mint", "ts", "amount")
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def wallet_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.random_walks(_pairs(spark, sf_dir)).select("walk", F.array_join("nodes", ">").alias("nodes"))


QUERIES = {f.__name__: f for f in (
    value_permutations, synchronised_wallets, pair_eigenvector, vector_clusters, isotonic_curve, brier_tracker, forward_folds, value_posteriors, volume_regimes,
    wallet_anomalies, position_evolution, wallet_walks,
)}


SQL = {
    # A thousand steps of the power method in one recursion, scaled by a constant, so that nothing over- or underflows.
    "pair_eigenvector": """WITH RECURSIVE e AS (SELECT DISTINCT least(wallet1, wallet2) AS u, greatest(wallet1, wallet2) AS v FROM wallet_similarities WHERE is_coordinated AND wallet1 <> wallet2),
    linked AS (SELECT u, v FROM e UNION SELECT v, u FROM e), looped AS MATERIALIZED (SELECT u, v FROM linked UNION SELECT u, u FROM linked),
    scale AS MATERIALIZED (SELECT max(d) AS top FROM (SELECT sqrt(count(*)) + 1.0 AS d FROM linked GROUP BY u)),
    r AS (SELECT 0 AS i, u AS node, 1.0::DOUBLE AS x FROM (SELECT DISTINCT u FROM linked)
      UNION ALL SELECT r.i + 1, l.u, sum(r.x) / any_value(top) FROM r JOIN looped l ON l.v = r.node CROSS JOIN scale WHERE r.i < 1000 GROUP BY r.i, l.u)
    SELECT node, round(x / (SELECT sqrt(sum(x * x)) FROM r WHERE i = 1000), 6) AS centrality FROM r WHERE i = 1000""",
    # Of every run of probabilities around one the mean; the curve is the greatest over starts of the least over ends.
    "isotonic_curve": f"""WITH {_LABELS}, g AS (SELECT p, count(*) AS n, sum(y) AS k FROM l WHERE p BETWEEN 0 AND 1 AND y IS NOT NULL GROUP BY p),
    c AS (SELECT *, row_number() OVER (ORDER BY p) AS i, sum(n) OVER (ORDER BY p) AS sn, sum(k) OVER (ORDER BY p) AS sk FROM g),
    e AS (SELECT s.i AS s, t.i AS t, (t.sk - s.sk + s.k) / (t.sn - s.sn + s.n) AS m FROM c s JOIN c t ON t.i >= s.i),
    lows AS (SELECT s, t, min(m) OVER (PARTITION BY s ORDER BY t DESC) AS low FROM e), f AS (SELECT t AS i, max(low) AS v FROM lows GROUP BY t)
    SELECT min(p) AS p_from, max(p) AS p_to, CAST(sum(n) AS BIGINT) AS n, round(v, 6) AS calibrated FROM f JOIN c USING (i) GROUP BY round(v, 12), v""",
    "value_permutations": """WITH b AS (SELECT event_type AS k, CAST(event_id AS VARCHAR) AS i, value AS v FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL),
    slots AS (SELECT k, row_number() OVER (ORDER BY i) AS r FROM b), dealt AS (SELECT rep, v, row_number() OVER (PARTITION BY rep ORDER BY md5(i || ':' || rep), i) AS r FROM b, (SELECT unnest(range(1, 1001)) AS rep)),
    m AS (SELECT rep, k, avg(v) AS m FROM dealt JOIN slots USING (r) GROUP BY ALL), s AS (SELECT k, count(*) AS n, avg(v) AS observed FROM b GROUP BY k)
    SELECT k AS event_type, any_value(n) AS n, round(any_value(observed), 6) AS observed, round(avg(m), 6) AS expected, round(CASE WHEN stddev_pop(m) > 0 THEN (any_value(observed) - avg(m)) / stddev_pop(m) END, 4) AS z,
           round((count(*) FILTER (WHERE m >= observed) + 1) / 1001, 6) AS p FROM m JOIN s USING (k) GROUP BY k""",
    "wallet_walks": """WITH RECURSIVE e AS (SELECT DISTINCT least(wallet1, wallet2) AS u, greatest(wallet1, wallet2) AS v FROM wallet_similarities WHERE is_coordinated AND wallet1 <> wallet2),
    linked AS (SELECT u, v FROM e UNION SELECT v, u FROM e), nb AS MATERIALIZED (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY u) AS d FROM linked),
    w AS (SELECT u || '#' || n AS walk, u AS node, u AS nodes, 0 AS step FROM (SELECT DISTINCT u FROM nb), (SELECT unnest(range(1, 201)) AS n)
      UNION ALL SELECT w.walk, nb.v, w.nodes || '>' || nb.v, w.step + 1 FROM w JOIN nb ON nb.u = w.node AND nb.i = (CAST('0x' || substr(md5(w.walk || ':' || w.step || ':42'), 1, 8) AS BIGINT) % 2147483648) % nb.d WHERE w.step < 29)
    SELECT walk, nodes FROM w WHERE step = 29""",
    "synchronised_wallets": f"""WITH RECURSIVE {TRADES},
    g AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 900 SECOND, true)::INT AS opens FROM trades WINDOW w AS (PARTITION BY mint ORDER BY ts, signature)),
    s AS (SELECT DISTINCT wallet, mint, sum(opens) OVER (PARTITION BY mint ORDER BY ts, signature) AS no FROM g),
    e AS (SELECT a.wallet AS u, b.wallet AS v FROM s a JOIN s b ON a.mint = b.mint AND a.no = b.no AND a.wallet < b.wallet GROUP BY ALL HAVING count(*) >= 2),
    linked AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
    reach AS (SELECT DISTINCT u AS node, u AS other FROM linked UNION SELECT r.node, l.v FROM reach r JOIN linked l ON l.u = r.other)
    SELECT node AS wallet, min(other) AS "group" FROM reach GROUP BY node""",
    "brier_tracker": f"""WITH {_LABELS}, r AS (SELECT domain, p, y FROM l WHERE p IS NOT NULL AND y IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY domain ORDER BY created_at DESC NULLS LAST, id DESC NULLS LAST, p DESC, y DESC) <= 1000)
    SELECT domain, count(*) AS n, round(avg((p - y) * (p - y)), 6) AS brier FROM r GROUP BY domain""",
    "forward_folds": """WITH s AS (SELECT epoch_us(ts) / 1000000.0 AS s FROM events WHERE ts IS NOT NULL), r AS (SELECT min(s) AS a, max(s) AS b FROM s), f AS (SELECT unnest([1, 2, 3, 4, 5]) AS fold)
    SELECT CAST(fold AS INT) AS fold, count(*) FILTER (WHERE s < a + (b - a) * fold / 6 - 86400) AS train, count(*) FILTER (WHERE least(floor((s - a) * 6 / (b - a)), 5) = fold) AS test FROM s, r, f GROUP BY fold""",
    "value_posteriors": """WITH t AS (SELECT event_type, count(*) AS n, avg(value) AS m, var_pop(value) AS s2 FROM events WHERE value IS NOT NULL GROUP BY event_type)
    SELECT event_type, n, round((200.0 + n * m) / (1 + n), 6) AS mean, 1.0 + n AS weight, 2.0 + n / 2 AS shape, round(2.0 + n * s2 / 2 + n * pow(m - 200, 2) / (2 * (1 + n)), 4) AS rate,
           round(sqrt((2.0 + n * s2 / 2 + n * pow(m - 200, 2) / (2 * (1 + n))) / (1.0 + n / 2)), 6) AS deviation FROM t""",
    "position_evolution": f"""WITH {TRADES}, d AS (SELECT mint, CAST(ts AS DATE) AS d, amount FROM trades), r AS (SELECT min(d) AS a, max(d) AS b FROM d),
    g AS (SELECT a + CAST(k * 30 AS INT) AS day FROM (SELECT a, unnest(generate_series(0, CAST(ceil((b - a) / 30.0) AS BIGINT))) AS k FROM r))
    SELECT mint, strftime(day, '%Y-%m-%d') AS day, round(sum(amount), 2) + 0.0 AS position, count(*) AS rows FROM g JOIN d ON d.d <= g.day GROUP BY mint, day""",
}
