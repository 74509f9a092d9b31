"""Queries on label quality, calibration, drift, association and beliefs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import seconds
from ledgerloom.operators import evaluation as E
from ledgerloom.operators import series as S
from ledgerloom.sources.tables import table
from ledgerloom.sources.views import TRADES, trades


def _spelled(c: str):
    joined = F.regexp_replace(F.lower(F.col(c)), r"[\s_-]+", "_")
    return F.nullif(F.regexp_replace(joined, "^_+|_+$", ""), F.lit(""))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rows with labels spelled alike; ``p`` the model's confidence, ``y`` whether the person agreed."""
    rows = table(spark, sf_dir, "labels").select(
        F.col("label_id").alias("id"), F.col("label_domain").alias("domain"), "source_model", _spelled("proposed_label").alias("proposed"), _spelled("human_label").alias("human"),
        _spelled("second_label").alias("second"), F.when(~F.isnan("model_confidence"), F.col("model_confidence")).alias("p"), F.col("human_confidence").alias("hc"), "created_at", "label_version",
    ).distinct()
    return rows.withColumn("y", (F.col("proposed") == F.col("human")).cast("int"))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").groupBy("label_domain", F.lower(F.trim("review_status")).alias("status")).agg(F.count("*").alias("n"))


def reviewer_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.kappa(_labels(spark, sf_dir), "domain", "human", "second")


def model_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.label_quality(_labels(spark, sf_dir), "domain", "proposed", "human")


def model_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.calibration(_labels(spark, sf_dir), "source_model")


def confidence_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.probability_bands(_labels(spark, sf_dir))


def model_discrimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.discrimination(_labels(spark, sf_dir), "domain")


def confidence_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.drift(_labels(spark, sf_dir), "domain", "created_at", "p")


def label_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.mutual_information(_labels(spark, sf_dir), "proposed", "human")


def review_missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").select("reviewer_id", "human_label", "second_reviewer_id", "second_label", "human_confidence", "reviewed_at", "model_confidence")
    return E.missingness(rows, ["reviewer_id", "human_label", "second_label", "second_reviewer_id", "reviewed_at"], F.coalesce(F.col("model_confidence") >= 0.7, F.lit(False)))


def platt_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.platt(_labels(spark, sf_dir))


def event_beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beta beliefs per user from events as evidence, decayed to the end of the data."""
    ev = table(spark, sf_dir, "events")
    end = ev.agg(F.max("ts").alias("end"))
    rows = ev.join(F.broadcast(end)).withColumn("age_h", (seconds(F.col("end")) - seconds(F.col("ts"))) / 3600)  # one row
    direction = F.when(F.col("event_type") == "error", F.lit(0.8)).when(F.col("event_type") == "purchase", F.lit(-0.6)).otherwise(F.lit(0.1))
    return E.beta_beliefs(rows, "user_id", "event_type", F.least(F.col("value") / 500, F.lit(1.0)), direction, F.col("age_h"), {"error": 2.0, "purchase": 1.5, "click": 0.5})


def event_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.noisy_or(table(spark, sf_dir, "events").where("event_type = 'error'"), "user_id", F.least(F.col("value") / 5000, F.lit(1.0)))


def volume_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.drift_forecast(S.daily(trades(spark, sf_dir), ["mint"], "ts", {"volume": F.abs("amount")}), "mint", "volume")


def order_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.associations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def sale_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cox model of the days until a holding falls by half, by its first day's size and the wallet's breadth."""
    t = trades(spark, sf_dir)
    days = S.daily(t, ["wallet", "mint"], "ts", {"net": F.col("amount")})
    sold = S.first_sales(S.running_balances(days, ["wallet", "mint"], "net"), ["wallet", "mint"])
    breadth = t.groupBy("wallet").agg(F.log1p(F.count_distinct("mint")).alias("breadth"))
    first = days.groupBy("wallet", "mint").agg(F.asinh(F.min_by("net", "day")).alias("first_net"))
    return E.cox_fit(sold.join(first, ["wallet", "mint"]).join(breadth, "wallet"), "duration", "event", ["first_net", "breadth"])


QUERIES = {f.__name__: f for f in (
    label_counts, reviewer_kappa, model_label_quality, model_calibration, confidence_bands, model_discrimination, confidence_drift, label_association,
    review_missingness, platt_scaling, event_beliefs, event_risk, volume_backtest, order_associations, sale_hazards,
)}

_LABELS = r"""
    spelled AS (
      SELECT DISTINCT label_id AS id, label_domain AS domain, source_model, nullif(trim(regexp_replace(lower(proposed_label), '[\s_-]+', '_', 'g'), '_'), '') AS proposed,
             nullif(trim(regexp_replace(lower(human_label), '[\s_-]+', '_', 'g'), '_'), '') AS human, nullif(trim(regexp_replace(lower(second_label), '[\s_-]+', '_', 'g'), '_'), '') AS second,
             CASE WHEN NOT isnan(model_confidence) THEN model_confidence END AS p, human_confidence AS hc, created_at, label_version FROM labels),
    l AS (SELECT *, (proposed = human)::INT AS y FROM spelled)"""


def _det(rows: list[int], columns: list[int]) -> str:
    """The determinant of part of a correlation matrix with cells r00 .., by its first row."""
    if len(rows) == 1:
        return f"r{min(rows[0], columns[0])}{max(rows[0], columns[0])}"
    return "(" + " ".join(f"{'+-'[j % 2]} r{min(rows[0], c)}{max(rows[0], c)} * {_det(rows[1:], columns[:j] + columns[j + 1:])}" for j, c in enumerate(columns)) + ")"


def _associations_sql(name: str, columns: list[str]) -> str:
    n = range(len(columns))
    cells = ", ".join(f"{f'corr({columns[i]}, {columns[j]})' if i != j else '1.0'} AS r{i}{j}" for i in n for j in n if j >= i)
    vif = lambda i: f"{_det([k for k in n if k != i], [k for k in n if k != i])} / {_det(list(n), list(n))}"
    rows = " UNION ALL ".join(f"SELECT '{columns[i]}' AS a, '{columns[j]}' AS b, round(r{i}{j}, 6) AS pearson, round({vif(i)}, 4) AS vif FROM m" for i in n for j in n if j > i)
    return f"WITH m AS (SELECT {cells} FROM {name}) {rows}"


SQL = {
    "order_associations": _associations_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
    # Fifty Newton steps as a recursion over the two coefficients.
    "platt_scaling": f"""WITH RECURSIVE {_LABELS}, q AS (SELECT ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))) AS x, y FROM l WHERE p IS NOT NULL AND y IS NOT NULL),
    g AS MATERIALIZED (SELECT x, count(*) AS n, sum(y) AS k FROM q GROUP BY x),
    s AS (SELECT 0 AS i, 1.0::DOUBLE AS a, 0.0::DOUBLE AS b UNION ALL
      SELECT i + 1, a + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) FROM (
        SELECT i, a, b, sum((k - n * m) * x) AS g1, sum(k - n * m) AS g2, sum(n * m * (1 - m) * x * x) + 1e-9 AS h11, sum(n * m * (1 - m) * x) AS h12, sum(n * m * (1 - m)) + 1e-9 AS h22
        FROM (SELECT s.i, s.a, s.b, g.x, g.n, g.k, 1 / (1 + exp(-(s.a * g.x + s.b))) AS m FROM s CROSS JOIN g WHERE s.i < 50) GROUP BY i, a, b)),
    f AS (SELECT a, b FROM s WHERE i = 50)
    SELECT round(any_value(a), 5) AS a, round(any_value(b), 5) AS b, round(sum(-(k * ln(1 / (1 + exp(-(a * x + b)))) + (n - k) * ln(1 - 1 / (1 + exp(-(a * x + b)))))) / sum(n), 6) AS log_loss FROM f CROSS JOIN g""",
    "label_counts": "SELECT label_domain, lower(trim(review_status)) AS status, count(*) AS n FROM labels GROUP BY ALL",
    "reviewer_kappa": f"""WITH {_LABELS}, r AS (SELECT domain, human, second FROM l WHERE human IS NOT NULL AND second IS NOT NULL),
    a AS (SELECT domain, human AS x, count(*) AS ca FROM r GROUP BY ALL), b AS (SELECT domain, second AS x, count(*) AS cb FROM r GROUP BY ALL),
    c AS (SELECT domain, sum(ca * cb) AS chance FROM a JOIN b USING (domain, x) GROUP BY domain),
    t AS (SELECT domain, count(*) AS n, count(*) FILTER (WHERE human = second) / count(*) AS po FROM r GROUP BY domain)
    SELECT domain, n, round(po, 6) AS agreement, round((po - chance / (n * n)) / (1 - chance / (n * n)), 6) AS kappa FROM t JOIN c USING (domain)""",
    "model_label_quality": f"""WITH {_LABELS}, r AS (SELECT domain, proposed, human FROM l WHERE human IS NOT NULL AND proposed IS NOT NULL),
    s AS (SELECT domain, proposed AS label, (proposed = human)::INT AS tp, (proposed <> human)::INT AS fp, 0 AS fn FROM r UNION ALL SELECT domain, human, 0, 0, 1 FROM r WHERE proposed <> human),
    t AS (SELECT domain, label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM s GROUP BY ALL)
    SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM t""",
    "model_calibration": f"""WITH {_LABELS}, r AS (SELECT source_model, p, y, least(floor(p * 10), 9) AS bin FROM l WHERE p IS NOT NULL AND y IS NOT NULL),
    b AS (SELECT source_model, count(*) AS n, abs(avg(p) - avg(y)) AS off FROM r GROUP BY source_model, bin),
    e AS (SELECT source_model, sum(n * off) / sum(n) AS ece, max(off) AS mce FROM b GROUP BY source_model),
    t AS (SELECT source_model, count(*) AS n, avg((p - y) * (p - y)) AS brier, regr_slope(y, p) AS slope FROM r GROUP BY source_model)
    SELECT t.source_model, n, round(brier, 6) AS brier, round(slope, 5) AS slope, round(ece, 6) AS ece, round(mce, 6) AS mce FROM t JOIN e ON t.source_model IS NOT DISTINCT FROM e.source_model""",
    "confidence_bands": f"""WITH {_LABELS}, r AS (SELECT (p >= 0.2)::INT + (p >= 0.4)::INT + (p >= 0.6)::INT + (p >= 0.8)::INT AS band, y FROM l WHERE p IS NOT NULL AND y IS NOT NULL),
    t AS (SELECT band, count(*) AS n, avg(y) AS q, 1.959964 AS z FROM r GROUP BY band)
    SELECT band, n, round(q, 6) AS rate, round(greatest((q + z * z / (2 * n) - z * sqrt((q * (1 - q) + z * z / (4 * n)) / n)) / (1 + z * z / n), 0), 6) AS low,
           round(least((q + z * z / (2 * n) + z * sqrt((q * (1 - q) + z * z / (4 * n)) / n)) / (1 + z * z / n), 1), 6) AS high FROM t""",
    "model_discrimination": f"""WITH {_LABELS}, r AS (SELECT domain, p, y FROM l WHERE p IS NOT NULL AND y IS NOT NULL),
    c AS (SELECT domain, p, sum(y) AS pos, count(*) - sum(y) AS neg FROM r GROUP BY ALL),
    k AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER (PARTITION BY domain) AS np, sum(neg) OVER (PARTITION BY domain) AS nn FROM c WINDOW w AS (PARTITION BY domain ORDER BY p))
    SELECT domain, round(sum(pos * (cn - neg / 2)) / (max(np) * max(nn)), 6) AS auc, round(max(abs(cp / np - cn / nn)), 6) AS ks FROM k GROUP BY domain""",
    "confidence_drift": f"""WITH {_LABELS}, e AS (SELECT max(created_at) AS last FROM l),
    t AS (SELECT domain, avg(p) FILTER (WHERE created_at <= last - INTERVAL 30 DAY) AS m0, stddev_samp(p) FILTER (WHERE created_at <= last - INTERVAL 30 DAY) AS s0, count(*) FILTER (WHERE created_at <= last - INTERVAL 30 DAY) AS n_before,
             avg(p) FILTER (WHERE created_at > last - INTERVAL 30 DAY) AS m1, count(*) FILTER (WHERE created_at > last - INTERVAL 30 DAY) AS n_recent FROM l, e WHERE p IS NOT NULL AND created_at IS NOT NULL GROUP BY domain)
    SELECT domain, n_before, n_recent, round((m1 - m0) / (s0 / sqrt(n_recent)), 4) AS z, round((m1 - m0) / abs(m0), 6) AS relative FROM t""",
    "label_association": f"""WITH {_LABELS}, c AS (SELECT proposed AS a, human AS b, count(*) AS c FROM l WHERE proposed IS NOT NULL AND human IS NOT NULL GROUP BY ALL),
    n AS (SELECT sum(c) AS n, sum(c * (c - 1) / 2) AS pj FROM c), a AS (SELECT a, sum(c) AS m FROM c GROUP BY a), b AS (SELECT b, sum(c) AS m FROM c GROUP BY b),
    mi AS (SELECT sum(c.c / n.n * ln(c.c * n.n / (a.m * b.m))) AS mi FROM c JOIN a USING (a) JOIN b USING (b), n),
    ha AS (SELECT -sum(m / n * ln(m / n)) AS ha, sum(m * (m - 1) / 2) AS pa FROM a, n), hb AS (SELECT -sum(m / n * ln(m / n)) AS hb, sum(m * (m - 1) / 2) AS pb FROM b, n)
    SELECT CAST(n AS BIGINT) AS n, round(mi, 6) AS mi, round(2 * mi / (ha + hb), 6) AS nmi, round((pj - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)), 6) AS ari FROM n, mi, ha, hb""",
    "review_missingness": "WITH o AS (SELECT *, coalesce(model_confidence >= 0.7, false)::INT AS o FROM labels), u AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", ({c} IS NULL)::INT AS m, o FROM o" for c in ("reviewer_id", "human_label", "second_label", "second_reviewer_id", "reviewed_at"))
    + """), t AS (SELECT "column", count(*) AS n, CAST(sum(m) AS BIGINT) AS missing, sum(m * o)::DOUBLE AS a, sum(m * (1 - o))::DOUBLE AS b, sum((1 - m) * o)::DOUBLE AS c, sum((1 - m) * (1 - o))::DOUBLE AS d FROM u GROUP BY 1)
    SELECT "column", n, missing, round(missing / n, 6) AS rate, round(CASE WHEN a > 0 AND b > 0 AND c > 0 AND d > 0 THEN n * pow(greatest(abs(a * d - b * c) - n / 2, 0), 2) / ((a + b) * (c + d) * (a + c) * (b + d)) END, 4) AS chi2 FROM t""",
    "event_beliefs": """WITH e AS (SELECT max(ts) AS last FROM events),
    r AS (SELECT user_id, least(value / 500, 1.0) AS s, CASE event_type WHEN 'error' THEN 0.8 WHEN 'purchase' THEN -0.6 ELSE 0.1 END AS d, CASE event_type WHEN 'error' THEN 2.0 WHEN 'purchase' THEN 1.5 WHEN 'click' THEN 0.5 ELSE 1.0 END AS w,
             greatest(pow(0.5, (epoch_us(last) - epoch_us(ts)) / 3600000000.0 / 720), 0.1) AS f FROM events, e),
    i AS (SELECT user_id, d, least(s * abs(d) * w * f, 2.0) AS e FROM r),
    t AS (SELECT user_id, count(*) AS n, 1.5 + sum(CASE WHEN d >= 0 THEN e * d ELSE 0.1 * e * (1 + d) END) AS a, 3.5 + sum(CASE WHEN d >= 0 THEN 0.1 * e * (1 - d) ELSE e * abs(d) END) AS b FROM i GROUP BY user_id)
    SELECT user_id, n, round(a, 6) AS alpha, round(b, 6) AS beta, round(a / (a + b), 6) AS mean, round(a * b / (pow(a + b, 2) * (a + b + 1)), 8) AS variance FROM t""",
    "event_risk": "SELECT user_id, round(1 - exp(sum(ln(1 - least(value / 5000, 1.0)))), 6) AS p_any FROM events WHERE event_type = 'error' GROUP BY user_id",
    "volume_backtest": f"""WITH {TRADES}, days AS (SELECT mint, CAST(ts AS DATE) AS day, sum(abs(amount)) AS v FROM trades GROUP BY ALL),
    s AS (SELECT *, lag(v) OVER (PARTITION BY mint ORDER BY day) AS b FROM days), f AS (SELECT *, b + avg(v - b) OVER (PARTITION BY mint ORDER BY day ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS f FROM s)
    SELECT mint, count(*) AS n, round(avg(abs(v - f)), 4) AS mae, round(sqrt(avg((v - f) * (v - f))), 4) AS rmse, round(avg(CASE WHEN v <> 0 THEN abs((v - f) / v) END), 4) AS mape FROM f WHERE f IS NOT NULL GROUP BY mint""",
}
