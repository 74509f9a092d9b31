"""Queries on sequences, lots, table-level operators and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import amount_similarity, cyclic, half_life, seconds, time_similarity
from ledgerloom.operators import lots as L
from ledgerloom.operators import relational as R
from ledgerloom.operators import sequences as Q
from ledgerloom.operators import series as S
from ledgerloom.sources.tables import table
from ledgerloom.sources.views import TRADES, trades

PATTERNS = {"view_buy": ["view", "purchase"], "signup_click_buy": ["signup", "click", "purchase"], "retry": ["error", "error", "click", "purchase"]}


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")


def action_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.frequencies(_actions(spark, sf_dir), "user_id", "event_type")


def action_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.bigrams(_actions(spark, sf_dir), "user_id", "ts", "event_id", "event_type")


def action_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.motifs(_actions(spark, sf_dir), "user_id", "ts", "event_id", "event_type")


def action_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.signatures(_actions(spark, sf_dir), "user_id", "ts", "event_id", "event_type", PATTERNS)


def fifo_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = L.fifo_matches(trades(spark, sf_dir), ["wallet", "mint"], ["ts", "signature"], "amount", "signature")
    return m.withColumn("matched", F.round("matched", 4))


def remaining_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    return L.open_lots(t, L.fifo_matches(t, ["wallet", "mint"], ["ts", "signature"], "amount", "signature"), ["wallet", "mint"], "amount", "signature")


def order_average_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average cost of a part's daily positions: returned items count as sold."""
    line = table(spark, sf_dir, "lineitem")
    sign = F.when(F.col("l_returnflag") == "R", -1.0).otherwise(1.0)
    d = line.groupBy("l_partkey", F.col("l_shipdate").cast("date").alias("day")).agg(F.sum(sign * F.col("l_quantity")).alias("a"), F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    return L.average_cost(d, ["l_partkey"], ["day"], "a", "p")


def wallet_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "wallets").select("id", "address", "funded_by_id", "created_at")
    old, new = w.where("created_at < '2025-01-01'"), w.where("created_at >= '2025-01-01'")
    return R.upsert(old, new, ["id"], "created_at").select("id", "address", "funded_by_id")


def transaction_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures delivered more than once: first and last version of the amount, and whether it was corrected."""
    t = table(spark, sf_dir, "sweenee_transactions").where(F.col("signature").isNotNull())
    v = F.when(~F.isnan("amount_change"), F.col("amount_change"))
    order = F.struct("cached_at", v.alias("v"))
    out = t.groupBy("signature").agg(F.count("*").alias("versions"), F.min(order).alias("a"), F.max(order).alias("b"))
    return out.where("versions > 1").select("signature", "versions", F.col("a.v").alias("first_amount"), F.col("b.v").alias("last_amount"), (~F.col("a.v").eqNullSafe(F.col("b.v"))).alias("corrected"))


def position_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of net positions at mid-May 2025 against the end."""
    t = trades(spark, sf_dir).select("wallet", "mint", "ts", "amount")
    state = lambda rows: rows.groupBy("wallet", "mint").agg(F.round(F.sum("amount"), 2).alias("position"))
    return R.state_diff(state(t.where("ts < '2025-05-15'")), state(t), ["wallet", "mint"], "position")


def third_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.page(table(spark, sf_dir, "tokens").select("id", "mint", F.lower(F.trim("symbol")).alias("symbol")), [F.col("id")], 2, 10)


def token_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "tokens")
    sources = [t.where(F.col("token_name").isNotNull()).select("id", F.col("token_name").alias("name")), t.where(F.col("symbol").isNotNull()).select("id", F.col("symbol").alias("name")), t.select("id", F.substring("mint", 1, 8).alias("name"))]
    return R.first_available(t.select("id"), "id", sources, "name")


def feature_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.scaled(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("bal")), "s_suppkey", ["bal"])


def vector_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return R.nearest_centroid(e, "vec_id", "embedding", R.centroids(e, "label", "embedding", 64), "label")


def pair_similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time and amount similarity of consecutive trades of a mint within an hour."""
    t = trades(spark, sf_dir).select("mint", "ts", "signature", F.abs("amount").alias("a"))
    back = S.fill(t, ["mint"], "ts", ["signature"], {"b": F.struct("signature", seconds(F.col("ts")).alias("s"), "a")}, include_self=False).where(F.col("b").isNotNull())
    gap = seconds(F.col("ts")) - F.col("b.s")
    return back.where(gap <= 3600).select(F.col("b.signature").alias("earlier"), F.col("signature").alias("later"), F.round(time_similarity(gap, 3600), 6).alias("time_sim"), F.round(amount_similarity(F.col("a"), F.col("b.a")), 6).alias("amount_sim"))


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar functions over events: JSON field, cyclical hour and weekday, decay, transforms."""
    e = table(spark, sf_dir, "events")
    sin, cos = cyclic(F.hour("ts").cast("double"), 24.0)
    age = (F.lit(1706659200.0) - seconds(F.col("ts"))) / 3600
    return e.select(
        "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), (F.round(sin, 6) + 0.0).alias("hour_sin"), (F.round(cos, 6) + 0.0).alias("hour_cos"), F.weekday("ts").alias("weekday"),
        F.round(half_life(age, 240.0), 6).alias("decay"), F.round(F.log1p("value"), 6).alias("log_value"), F.round(F.asinh("value"), 6).alias("asinh_value"), F.substring(F.sha2(F.concat_ws(":", "event_id", "event_type"), 256), 1, 16).alias("hash"),
    )


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wallets by whether they hold, trade or are tracked: intersections and differences of sets."""
    h = table(spark, sf_dir, "wallet_balances").select(F.trim("wallet_address").alias("wallet")).distinct()
    t = table(spark, sf_dir, "sweenee_transactions").select(F.col("wallet_address").alias("wallet")).distinct()
    k = table(spark, sf_dir, "tracked_wallets").select(F.col("address").alias("wallet")).distinct()
    part = lambda df, name: df.agg(F.count("*").alias("n")).withColumn("part", F.lit(name))
    return part(h.intersect(t), "held and traded").unionByName(part(h.exceptAll(t), "held only")).unionByName(part(t.join(k, "wallet", "left_semi"), "traded and tracked")).unionByName(part(k.join(t, "wallet", "left_anti"), "tracked only")).unionByName(part(h.union(t).distinct(), "any"))


def order_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Star join with a rollup: revenue by region and nation, subtotals included."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("x"), F.col("l_discount").alias("d"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum(F.col("x") * (1 - F.col("d"))).alias("v"), F.count("*").alias("n"))
    return rows.join(n, F.col("c_nationkey") == F.col("n_nationkey")).rollup("r_name", "n_name").agg(F.round(F.sum("v"), 2).alias("revenue"), F.sum("n").alias("lines"))


QUERIES = {f.__name__: f for f in (
    action_entropy, action_bigrams, action_motifs, action_signatures, fifo_lots, remaining_lots, order_average_cost, wallet_upsert, transaction_corrections,
    position_changes, third_page, token_names, feature_scaling, vector_classes, pair_similarities, event_features, set_operations, order_summary,
)}

_FIFO = TRADES + """,
    q AS (SELECT wallet, mint, ts, signature, CAST(round(amount * 1000000) AS BIGINT) AS a FROM trades),
    b AS (SELECT *, sum(a) OVER (PARTITION BY wallet, mint ORDER BY ts, signature) AS e FROM q WHERE a > 0),
    s AS (SELECT *, sum(-a) OVER (PARTITION BY wallet, mint ORDER BY ts, signature) AS e FROM q WHERE a < 0),
    m AS (SELECT b.wallet, b.mint, b.signature AS buy, s.signature AS sell, least(b.e, s.e) - greatest(b.e - b.a, s.e + s.a) AS overlap
      FROM b JOIN s ON b.wallet = s.wallet AND b.mint = s.mint AND b.e - b.a < s.e AND s.e + s.a < b.e)"""
_SEQ = """
    seq AS (SELECT user_id, event_type AS a, lag(event_type) OVER w AS a1, lag(event_type, 2) OVER w AS a2, lag(event_type, 3) OVER w AS a3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""

SQL = {
    "action_entropy": """WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL)
    SELECT user_id, CAST(sum(c) AS BIGINT) AS n, count(*) AS distinct_actions, round((log2(sum(c)) - sum(c * log2(c)) / sum(c)) / 3 + 0.0, 6) AS entropy FROM c GROUP BY user_id""",
    "action_bigrams": f"""WITH {_SEQ}, c AS (SELECT a1 AS before, a AS after, count(*) AS n FROM seq WHERE a1 IS NOT NULL GROUP BY ALL)
    SELECT before, after, n, round(n / sum(n) OVER (PARTITION BY before), 6) AS probability FROM c""",
    "action_motifs": f"""WITH {_SEQ}, g AS (SELECT user_id, a1 || '>' || a AS motif FROM seq WHERE a1 IS NOT NULL UNION ALL SELECT user_id, a2 || '>' || a1 || '>' || a FROM seq WHERE a2 IS NOT NULL
      UNION ALL SELECT user_id, a3 || '>' || a2 || '>' || a1 || '>' || a FROM seq WHERE a3 IS NOT NULL), e AS (SELECT count(DISTINCT user_id) AS every FROM events)
    SELECT motif, count(*) AS freq, count(DISTINCT user_id) AS entities, round((least(count(*) / 10, 1.0) + count(DISTINCT user_id) / any_value(every)) / 2, 6) AS confidence FROM g, e GROUP BY motif HAVING count(*) >= 3""",
    "action_signatures": f"""WITH {_SEQ}, w AS (
      SELECT user_id, 'view_buy' AS pattern, CASE WHEN a1 IS NOT NULL THEN (a1 <> 'view')::INT + (a <> 'purchase')::INT END AS wrong FROM seq
      UNION ALL SELECT user_id, 'signup_click_buy', CASE WHEN a2 IS NOT NULL THEN (a2 <> 'signup')::INT + (a1 <> 'click')::INT + (a <> 'purchase')::INT END FROM seq
      UNION ALL SELECT user_id, 'retry', CASE WHEN a3 IS NOT NULL THEN (a3 <> 'error')::INT + (a2 <> 'error')::INT + (a1 <> 'click')::INT + (a <> 'purchase')::INT END FROM seq)
    SELECT user_id, pattern, count(*) FILTER (WHERE wrong = 0) AS exact, count(*) FILTER (WHERE wrong = 1) AS fuzzy FROM w GROUP BY ALL HAVING count(*) FILTER (WHERE wrong <= 1) > 0""",
    "fifo_lots": f"WITH {_FIFO} SELECT wallet, mint, buy, sell, round(overlap / 1000000, 4) AS matched FROM m",
    "remaining_lots": f"""WITH {_FIFO}, u AS (SELECT buy, sum(overlap) AS used FROM m GROUP BY buy)
    SELECT wallet, mint, signature AS buy, round((a - coalesce(used, 0)) / 1000000, 6) AS remaining FROM b LEFT JOIN u ON u.buy = b.signature WHERE a - coalesce(used, 0) > 0""",
    "order_average_cost": """WITH RECURSIVE d AS (SELECT l_partkey AS k, CAST(l_shipdate AS DATE) AS day, sum(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS a, avg(l_extendedprice / l_quantity) AS p FROM lineitem GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY day) AS i FROM d),
    f AS (SELECT k, 0::BIGINT AS i, 0.0::DOUBLE AS q, 0.0::DOUBLE AS c, 0.0::DOUBLE AS r FROM n WHERE i = 1
      UNION ALL SELECT n.k, n.i, CASE WHEN a >= 0 THEN q + a ELSE q - least(-a, q) END, CASE WHEN a >= 0 THEN c + a * p ELSE c - least(-a, q) * CASE WHEN q > 0 THEN c / q ELSE 0 END END,
             CASE WHEN a >= 0 THEN r ELSE r + least(-a, q) * (p - CASE WHEN q > 0 THEN c / q ELSE 0 END) END FROM f JOIN n ON n.k = f.k AND n.i = f.i + 1)
    SELECT k AS l_partkey, round(arg_max(q, i), 2) + 0.0 AS position, round(arg_max(c, i), 2) + 0.0 AS cost, round(arg_max(r, i), 2) + 0.0 AS realised FROM f GROUP BY k""",
    "wallet_upsert": """SELECT id, address, funded_by_id FROM wallets QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC NULLS LAST, address DESC NULLS LAST, funded_by_id DESC NULLS LAST) = 1""",
    "transaction_corrections": """WITH t AS (SELECT signature, cached_at, CASE WHEN NOT isnan(amount_change) THEN amount_change END AS v FROM sweenee_transactions WHERE signature IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY cached_at NULLS FIRST, v NULLS FIRST) AS i, count(*) OVER (PARTITION BY signature) AS versions FROM t)
    SELECT signature, versions, max(CASE WHEN i = 1 THEN v END) AS first_amount, max(CASE WHEN i = versions THEN v END) AS last_amount, max(CASE WHEN i = 1 THEN v END) IS DISTINCT FROM max(CASE WHEN i = versions THEN v END) AS corrected
    FROM r WHERE versions > 1 GROUP BY signature, versions""",
    "position_changes": f"""WITH {TRADES}, b AS (SELECT wallet, mint, round(sum(amount), 2) AS old FROM trades WHERE ts < '2025-05-15' GROUP BY ALL), a AS (SELECT wallet, mint, round(sum(amount), 2) AS new FROM trades GROUP BY ALL)
    SELECT * FROM (SELECT coalesce(a.wallet, b.wallet) AS wallet, coalesce(a.mint, b.mint) AS mint, old, new, CASE WHEN old IS NULL THEN 'new' WHEN new IS NULL THEN 'exited' WHEN old <> new THEN 'changed' END AS change
    FROM b FULL JOIN a ON a.wallet = b.wallet AND a.mint = b.mint) WHERE change IS NOT NULL""",
    "third_page": "SELECT id, mint, lower(trim(symbol)) AS symbol FROM tokens ORDER BY id LIMIT 10 OFFSET 20",
    "token_names": "SELECT id, coalesce(token_name, symbol, substr(mint, 1, 8)) AS name, CAST(CASE WHEN token_name IS NOT NULL THEN 1 WHEN symbol IS NOT NULL THEN 2 ELSE 3 END AS INT) AS source FROM tokens",
    "feature_scaling": """WITH s AS (SELECT s_suppkey, s_acctbal AS bal FROM supplier),
    q AS (SELECT quantile_cont(bal, 0.25) AS lo, quantile_cont(bal, 0.5) AS mid, quantile_cont(bal, 0.75) AS hi FROM s),
    f AS (SELECT s_suppkey, coalesce(bal, mid) AS x, (bal IS NULL)::INT AS missing, lo, mid, hi FROM s, q), m AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM f)
    SELECT s_suppkey, round((x - mu) / sd, 5) AS bal_std, round((x - mid) / (hi - lo), 5) AS bal_robust, round(least(greatest(x, lo - 1.5 * (hi - lo)), hi + 1.5 * (hi - lo)), 5) AS bal_wins, missing AS bal_missing FROM f, m""",
    "vector_classes": """WITH c AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL),
    v AS (SELECT label, list(m ORDER BY i) AS centre FROM c GROUP BY label)
    SELECT vec_id, arg_max(label2, (sim, -label2)) AS assigned, round(max(sim), 6) AS similarity FROM (SELECT e.vec_id, v.label AS label2, round(list_cosine_similarity(e.embedding::DOUBLE[], v.centre), 9) AS sim FROM embeddings e, v) GROUP BY vec_id""",
    "pair_similarities": f"""WITH {TRADES}, p AS (SELECT signature AS later, lag(signature) OVER w AS earlier, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1000000.0 AS gap, abs(amount) AS a, lag(abs(amount)) OVER w AS b FROM trades WINDOW w AS (PARTITION BY mint ORDER BY ts, signature))
    SELECT earlier, later, round(exp(-gap / (3600 / 2.3)), 6) AS time_sim, round(1 / (1 + log10(greatest(a, b) / least(a, b))), 6) AS amount_sim FROM p WHERE gap <= 3600""",
    "event_features": """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, round(sin(hour(ts) * 2 * pi() / 24), 6) + 0.0 AS hour_sin, round(cos(hour(ts) * 2 * pi() / 24), 6) + 0.0 AS hour_cos, CAST(isodow(ts) - 1 AS INT) AS weekday,
    round(pow(0.5, (1706659200 - epoch_us(ts) / 1000000.0) / 3600 / 240), 6) AS decay, round(ln(1 + value), 6) AS log_value, round(asinh(value), 6) AS asinh_value, substr(sha256(event_id || ':' || event_type), 1, 16) AS hash FROM events""",
    "set_operations": """WITH h AS (SELECT DISTINCT trim(wallet_address) AS w FROM wallet_balances), t AS (SELECT DISTINCT wallet_address AS w FROM sweenee_transactions), k AS (SELECT DISTINCT address AS w FROM tracked_wallets)
    SELECT count(*) AS n, 'held and traded' AS part FROM (SELECT w FROM h INTERSECT SELECT w FROM t) UNION ALL SELECT count(*), 'held only' FROM (SELECT w FROM h EXCEPT SELECT w FROM t)
    UNION ALL SELECT count(*), 'traded and tracked' FROM t SEMI JOIN k USING (w) UNION ALL SELECT count(*), 'tracked only' FROM k ANTI JOIN t USING (w) UNION ALL SELECT count(*), 'any' FROM (SELECT w FROM h UNION SELECT w FROM t)""",
    "order_summary": """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""",
}
