"""Agreement, calibration, drift and association measures as mergeable sums; ranks by range where an order is needed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import logistic, safe_div, wilson
from ledgerloom.operators.ranking import mean_ranks, ranked
from ledgerloom.scratch import Scratch


def calibration(pred: DataFrame, by: str, p: str = "p", y: str = "y") -> DataFrame:
    """Per group: ``n``, ``brier``, ``slope`` (least squares of y on p), ``ece``, ``mce`` over ten bins, the last one closed."""
    rows = pred.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(by, F.col(p).alias("p"), F.col(y).cast("double").alias("y"))
    # Sums per bin are all that either measure needs: one shuffle of at most ten rows a group.
    s = rows.withColumn("bin", F.least(F.floor(F.col("p") * 10), F.lit(9))).groupBy(by, "bin").agg(
        F.count("*").alias("n"), F.sum("p").alias("sp"), F.sum("y").alias("sy"), F.sum(F.col("p") * F.col("p")).alias("spp"), F.sum(F.col("p") * F.col("y")).alias("spy"),
        F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("se"),
    )
    off = F.abs(F.col("sp") - F.col("sy"))
    t = s.groupBy(by).agg(F.sum("n").alias("n"), F.sum("se").alias("se"), F.sum("sp").alias("sp"), F.sum("sy").alias("sy"), F.sum("spp").alias("spp"), F.sum("spy").alias("spy"), F.sum(off).alias("off"), F.max(off / F.col("n")).alias("mce"))
    n = F.col("n")
    slope = F.try_divide(n * F.col("spy") - F.col("sp") * F.col("sy"), n * F.col("spp") - F.col("sp") * F.col("sp"))
    return t.select(by, "n", F.round(F.col("se") / n, 6).alias("brier"), F.round(slope, 5).alias("slope"), F.round(F.col("off") / n, 6).alias("ece"), F.round("mce", 6).alias("mce"))


def probability_bands(pred: DataFrame, p: str = "p", y: str = "y", edges: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """Per band of probability: ``n``, ``rate`` of events and its Wilson interval."""
    band = sum((F.when(F.col(p) >= e, 1).otherwise(0) for e in edges), F.lit(0))
    t = pred.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("k"))
    low, high = wilson(F.col("k"), F.col("n"))
    return t.select("band", "n", F.round(F.col("k") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def discrimination(pred: DataFrame, by: str, p: str = "p", y: str = "y", tie: str = "id") -> DataFrame:
    """Per group ``auc`` (0.5 where one class is missing) and ``ks``, the largest distance of the classes' distributions."""
    rows = pred.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(by, F.col(p).alias("p")).agg(F.sum(F.col(y).cast("double")).alias("pos"), F.count("*").alias("c"))
    neg = F.col("c") - F.col("pos")
    r = ranked(rows, [by], [F.col("p")], {"cp": F.col("pos"), "cn": neg})
    # Negatives below each score, ties counted by half.
    below = F.col("cn") - neg / 2
    t = r.groupBy(by).agg(F.sum(F.col("pos") * below).alias("u"), F.max("cp_all").alias("np"), F.max("cn_all").alias("nn"), F.max(F.abs(safe_div(F.col("cp"), F.col("cp_all")) - safe_div(F.col("cn"), F.col("cn_all")))).alias("ks"))
    both = (F.col("np") > 0) & (F.col("nn") > 0)
    return t.select(by, F.round(F.when(both, F.col("u") / (F.col("np") * F.col("nn"))).otherwise(0.5), 6).alias("auc"), F.round(F.when(both, F.col("ks")), 6).alias("ks"))


def kappa(rows: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """Per group: ``n``, ``agreement`` and Cohen's ``kappa`` of two labels; rows with a null on either side don't count."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    sides = cells.select(by, F.explode(F.array(F.struct(F.col("a").alias("l"), F.col("c").alias("ca"), F.lit(0).cast("long").alias("cb")), F.struct(F.col("b").alias("l"), F.lit(0).cast("long").alias("ca"), F.col("c").alias("cb")))).alias("x"))
    margin = sides.groupBy(by, "x.l").agg(F.sum("x.ca").alias("ca"), F.sum("x.cb").alias("cb")).groupBy(by).agg(F.sum(F.col("ca") * F.col("cb")).alias("chance"))
    t = cells.groupBy(by).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("c")).otherwise(0)).alias("same")).join(margin, by)
    po, pe = F.col("same") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return t.select(by, "n", F.round(po, 6).alias("agreement"), F.round(F.when(pe < 1, (po - pe) / (1 - pe)).otherwise(1.0), 6).alias("kappa"))


def label_quality(rows: DataFrame, by: str, predicted: str, actual: str) -> DataFrame:
    """Per group and label: ``tp``, ``fp``, ``fn``, ``precision``, ``recall``, ``f1``."""
    p, a = F.col(predicted), F.col(actual)
    cells = rows.where(p.isNotNull() & a.isNotNull()).groupBy(by, p.alias("p"), a.alias("a")).agg(F.count("*").alias("c"))
    hit = F.col("p") == F.col("a")
    sides = cells.select(by, F.explode(F.when(hit, F.array(F.struct(F.col("p").alias("label"), F.col("c").alias("tp"), F.lit(0).cast("long").alias("fp"), F.lit(0).cast("long").alias("fn"))))
        .otherwise(F.array(F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.col("c").alias("fp"), F.lit(0).cast("long").alias("fn")), F.struct(F.col("a").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"), F.col("c").alias("fn"))))).alias("x"))
    t = sides.groupBy(by, "x.label").agg(F.sum("x.tp").alias("tp"), F.sum("x.fp").alias("fp"), F.sum("x.fn").alias("fn"))
    tp = F.col("tp")
    return t.select(by, "label", "tp", "fp", "fn", F.round(safe_div(tp, tp + F.col("fp")), 6).alias("precision"), F.round(safe_div(tp, tp + F.col("fn")), 6).alias("recall"), F.round(safe_div(2 * tp, 2 * tp + F.col("fp") + F.col("fn")), 6).alias("f1"))


def drift(rows: DataFrame, by: str, time_col: str, value: str, recent_days: int = 30) -> DataFrame:
    """Per group: mean of the last ``recent_days`` against all before: ``z`` (in standard errors), ``relative``, counts of both."""
    end = rows.agg(F.max(F.col(time_col).cast("timestamp")).alias("end"))
    late = F.col(time_col).cast("timestamp") > F.col("end") - F.make_dt_interval(F.lit(recent_days))
    v = F.col(value)
    t = rows.where(v.isNotNull() & F.col(time_col).isNotNull()).join(F.broadcast(end)).groupBy(by).agg(  # one row
        F.avg(F.when(~late, v)).alias("m0"), F.stddev_samp(F.when(~late, v)).alias("s0"), F.count_if(~late).alias("n_before"), F.avg(F.when(late, v)).alias("m1"), F.count_if(late).alias("n_recent"))
    z = F.when((F.col("s0") > 0) & (F.col("n_recent") > 0), (F.col("m1") - F.col("m0")) / (F.col("s0") / F.sqrt("n_recent")))
    return t.select(by, "n_before", "n_recent", F.round(z, 4).alias("z"), F.round(F.try_divide(F.col("m1") - F.col("m0"), F.abs("m0")), 6).alias("relative"))


def associations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of columns with ``pearson`` and ``vif`` of the first, from one pass of sums; rows with a null in any are left out.

    The moments (columns squared numbers) are one row; VIFs are the diagonal of the inverse correlation matrix.
    """
    full = rows.where(sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) == 0)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    r = full.agg(*[F.corr(a, b).alias(f"r_{i}") for i, (a, b) in enumerate(pairs)]).first()
    m = np.eye(len(columns))
    for i, (a, b) in enumerate(pairs):
        if r[f"r_{i}"] is not None:
            m[columns.index(a), columns.index(b)] = m[columns.index(b), columns.index(a)] = r[f"r_{i}"]
    vif = np.diag(np.linalg.pinv(m))
    out = [(a, b, round(float(m[columns.index(a), columns.index(b)]), 6), round(float(vif[columns.index(a)]), 4)) for a, b in pairs if a != b]
    return rows.sparkSession.createDataFrame(out, "a string, b string, pearson double, vif double")


def mutual_information(rows: DataFrame, a: str, b: str) -> DataFrame:
    """``mi`` (nats) and normalised ``nmi`` (arithmetic mean) of two categorical columns, and the adjusted Rand index ``ari``."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count("*").alias("c"))
    pick = lambda n: n * (n - 1) / 2
    ent = lambda col: F.sum(F.col(col) * F.log(col))
    joint = cells.agg(F.sum("c").alias("n"), ent("c").alias("jc"), F.sum(pick(F.col("c"))).alias("pj"))
    side = lambda k: cells.groupBy(k).agg(F.sum("c").alias("m")).agg(ent("m").alias(f"e{k}"), F.sum(pick(F.col("m"))).alias(f"p{k}"))
    t = joint.join(F.broadcast(side("a"))).join(F.broadcast(side("b")))  # single rows
    n = F.col("n")
    ha, hb = F.log(n) - F.col("ea") / n, F.log(n) - F.col("eb") / n
    mi = F.col("jc") / n - F.col("ea") / n - F.col("eb") / n + F.log(n)
    expected, most = F.col("pa") * F.col("pb") / pick(n), (F.col("pa") + F.col("pb")) / 2
    return t.select("n", F.round(mi, 6).alias("mi"), F.round(F.when(ha + hb > 0, 2 * mi / (ha + hb)).otherwise(1.0), 6).alias("nmi"), F.round(F.when(most > expected, (F.col("pj") - expected) / (most - expected)).otherwise(1.0), 6).alias("ari"))


def missingness(rows: DataFrame, columns: list[str], outcome: Column) -> DataFrame:
    """Per column: ``missing``, ``rate`` and the Yates-corrected ``chi2`` of missingness against a 0/1 outcome (null if a cell is empty)."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNull().cast("int").alias("m")) for c in columns]))
    t = rows.select(each.alias("x"), outcome.cast("int").alias("o")).groupBy("x.column").agg(
        F.count("*").alias("n"), F.sum("x.m").alias("missing"), F.sum(F.col("x.m") * F.col("o")).alias("a"), F.sum(F.col("x.m") * (1 - F.col("o"))).alias("b"), F.sum((1 - F.col("x.m")) * F.col("o")).alias("c"), F.sum((1 - F.col("x.m")) * (1 - F.col("o"))).alias("d"))
    a, b, c, d, n = (F.col(x).cast("double") for x in ("a", "b", "c", "d", "n"))
    core = F.greatest(F.abs(a * d - b * c) - n / 2, F.lit(0.0))
    chi = F.when((a > 0) & (b > 0) & (c > 0) & (d > 0), n * core * core / ((a + b) * (c + d) * (a + c) * (b + d)))
    return t.select("column", "n", "missing", F.round(F.col("missing") / n, 6).alias("rate"), F.round(chi, 4).alias("chi2"))


def beta_beliefs(evidence: DataFrame, by: str, kind: str, strength: Column, direction: Column, age_h: Column, weights: dict[str, float], prior: tuple[float, float] = (0.3, 5.0), half_life_h: float = 24.0 * 30) -> DataFrame:
    """Beta posteriors per entity from weighted, decayed evidence; the item's effect (at most 2) doesn't depend on the prior, so sums do.

    Positive evidence e of direction d adds e d to alpha and 0.1 e (1 - d) to beta; negative evidence the reverse.
    """
    w = F.coalesce(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])[F.col(kind)], F.lit(1.0))
    e = F.least(strength * F.abs(direction) * w * F.greatest(F.pow(F.lit(0.5), age_h / half_life_h), F.lit(0.1)), F.lit(2.0))
    up = direction >= 0
    da = F.when(up, e * direction).otherwise(0.1 * e * (1 + direction))
    db = F.when(up, 0.1 * e * (1 - direction)).otherwise(e * F.abs(direction))
    a, b = prior[0] * prior[1] + F.col("da"), (1 - prior[0]) * prior[1] + F.col("db")
    t = evidence.groupBy(by).agg(F.count("*").alias("n"), F.sum(da).alias("da"), F.sum(db).alias("db"))
    return t.select(by, "n", F.round(a, 6).alias("alpha"), F.round(b, 6).alias("beta"), F.round(a / (a + b), 6).alias("mean"), F.round(a * b / (F.pow(a + b, 2) * (a + b + 1)), 8).alias("variance"))


def noisy_or(rows: DataFrame, by: str, p: Column) -> DataFrame:
    """``1 - prod(1 - p)`` per group; a certain event makes it 1."""
    sure = F.max(F.when(p >= 1, 1).otherwise(0))
    return rows.groupBy(by).agg(F.round(F.when(sure == 1, 1.0).otherwise(1 - F.exp(F.sum(F.when(p < 1, F.log(1 - p))))), 6).alias("p_any"))


def drift_forecast(days: DataFrame, by: str, value: str, window: int = 14) -> DataFrame:
    """One-step forecast by the mean change of the last ``window`` steps, walked over the series: ``n``, ``mae``, ``rmse``, ``mape`` per group."""
    w = Window.partitionBy(by).orderBy("day")
    step = days.select(by, "day", F.col(value).alias("v"), F.lag(value).over(w).alias("b")).withColumn("d", F.col("v") - F.col("b"))
    f = step.withColumn("f", F.col("b") + F.avg("d").over(w.rowsBetween(-window, -1)))
    e = F.col("v") - F.col("f")
    return f.where(F.col("f").isNotNull()).groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(F.avg(F.when(F.col("v") != 0, F.abs(e / F.col("v")))), 4).alias("mape"))


def cox_fit(rows: DataFrame, duration: str, event: str, features: list[str], ridge: float = 0.1, rounds: int = 50) -> DataFrame:
    """Cox proportional hazards (Breslow ties): ``feature``, ``coefficient``, ``std_error``.

    Newton steps on sums per distinct duration: each step aggregates exp(bx), x exp(bx) and their products by
    duration, so what is ordered is one row per duration, not per subject. The features are few; their
    square bounds what comes to the driver per duration, and durations are whole days.
    """
    k = len(features)
    scratch = Scratch(rows.sparkSession, "cox")
    clean = scratch.save(rows.where(sum((F.col(c).isNull().cast("int") for c in [duration, event, *features]), F.lit(0)) == 0).select(duration, event, *features))
    x = [F.col(f).cast("double") for f in features]
    beta = np.zeros(k)
    hess = np.eye(k)
    for _ in range(rounds):
        w = F.exp(F.least(sum((float(b) * c for b, c in zip(beta, x, strict=True)), F.lit(0.0)), F.lit(50.0)))
        ev = F.col(event) == 1
        aggs = [F.sum(w).alias("s0"), *[F.sum(w * c).alias(f"s1_{i}") for i, c in enumerate(x)], *[F.sum(w * x[i] * x[j]).alias(f"s2_{i}_{j}") for i in range(k) for j in range(i, k)],
                F.sum(ev.cast("int")).alias("d"), *[F.sum(F.when(ev, c).otherwise(0.0)).alias(f"x_{i}") for i, c in enumerate(x)]]
        t = clean.groupBy(F.col(duration).cast("double").alias("t")).agg(*aggs).toPandas().sort_values("t", ascending=False)
        if t.empty:
            break
        s0 = t["s0"].cumsum().to_numpy()
        s1 = np.stack([t[f"s1_{i}"].cumsum() for i in range(k)], axis=1)
        d = t["d"].to_numpy()
        grad = t[[f"x_{i}" for i in range(k)]].to_numpy().sum(axis=0) - (d[:, None] * s1 / s0[:, None]).sum(axis=0) - ridge * beta
        hess = ridge * np.eye(k)
        for i in range(k):
            for j in range(i, k):
                s2 = t[f"s2_{i}_{j}"].cumsum().to_numpy()
                h = (d * (s2 / s0 - s1[:, i] * s1[:, j] / s0**2)).sum()
                hess[i, j] += h
                if i != j:
                    hess[j, i] += h
        move = np.linalg.solve(hess, grad)
        beta = beta + move
        if np.abs(move).max() < 1e-8:
            break
    else:
        raise RuntimeError(f"no convergence within {rounds} rounds")
    scratch.clear()
    se = np.sqrt(np.maximum(np.diag(np.linalg.inv(hess)), 0))
    return rows.sparkSession.createDataFrame([(f, round(float(b), 5), round(float(s), 5)) for f, b, s in zip(features, beta, se, strict=True)], "feature string, coefficient double, std_error double")


def platt(pred: DataFrame, p: str = "p", y: str = "y", rounds: int = 100) -> DataFrame:
    """Logistic calibration ``1 / (1 + exp(-(a logit(p) + b)))`` by Newton steps on six sums: ``a``, ``b``, ``log_loss``."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    scratch = Scratch(pred.sparkSession, "platt")
    rows = scratch.save(pred.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(F.log(q / (1 - q)).alias("l")).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("k")))
    a, b, loss = 1.0, 0.0, 0.0
    for _ in range(rounds):
        m = logistic(F.lit(a) * F.col("l") + F.lit(b))
        g = F.col("k") - F.col("n") * m
        v = F.col("n") * m * (1 - m)
        s = rows.agg(F.sum(g * F.col("l")), F.sum(g), F.sum(v * F.col("l") * F.col("l")), F.sum(v * F.col("l")), F.sum(v), F.sum(-(F.col("k") * F.log(m) + (F.col("n") - F.col("k")) * F.log(1 - m))) / F.sum("n")).first()
        if s[0] is None:
            break
        loss = s[5]
        h = np.array([[s[2] + 1e-9, s[3]], [s[3], s[4] + 1e-9]])
        step = np.linalg.solve(h, np.array([s[0], s[1]]))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    else:
        raise RuntimeError(f"no convergence within {rounds} rounds")
    scratch.clear()
    return pred.sparkSession.createDataFrame([(round(float(a), 5), round(float(b), 5), round(float(loss), 6))], "a double, b double, log_loss double")


def rank_correlation(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's ``rho`` of two columns (ties take the mean rank) and ``n``; rows with a null in either are left out."""
    full = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("__a"), F.col(b).alias("__b"))
    j = full.join(mean_ranks(full, [], "__a", "ra"), "__a").join(mean_ranks(full, [], "__b", "rb"), "__b")
    return j.agg(F.count("*").alias("n"), F.round(F.corr("ra", "rb"), 6).alias("rho"))


def survival_curve(rows: DataFrame, duration: str = "duration", event: str = "event", z: float = 1.959964) -> DataFrame:
    """Kaplan-Meier: per duration with an event ``at_risk``, ``events``, ``survival``, ``low`` and ``high`` (Greenwood, cut to [0, 1]).

    What is ordered is one row a distinct duration, by distributed running sums.
    """
    d = rows.where(F.col(duration).isNotNull() & F.col(event).isNotNull()).groupBy(F.col(duration).alias("t")).agg(F.count("*").alias("n"), F.sum(F.col(event).cast("long")).alias("d"))
    left = ranked(d, [], [F.col("t")], {"gone": F.col("n")}).withColumn("r", F.col("gone_all") - F.col("gone") + F.col("n")).where("d > 0")
    r, e = F.col("r").cast("double"), F.col("d").cast("double")
    steps = ranked(left.select("t", "r", "d"), [], [F.col("t")], {"ended": F.when(r == e, 1).otherwise(0), "l": F.when(r > e, F.log(1 - e / r)).otherwise(0.0), "g": F.when(r > e, e / (r * (r - e))).otherwise(0.0)})
    s = F.when(F.col("ended") > 0, 0.0).otherwise(F.exp("l"))
    half = z * s * F.sqrt("g")
    return steps.select(F.col("t").alias("duration"), F.col("r").alias("at_risk"), F.col("d").alias("events"), F.round(s, 6).alias("survival"), F.round(F.greatest(s - half, F.lit(0.0)), 6).alias("low"), F.round(F.least(s + half, F.lit(1.0)), 6).alias("high"))


def ks_distance(rows: DataFrame, by: str, value: str, second: Column) -> DataFrame:
    """Per group the Kolmogorov-Smirnov distance ``ks`` between the rows where ``second`` holds and the others: ``n_first``, ``n_second``; null if one is empty."""
    v = F.col(value)
    cells = rows.where(v.isNotNull() & ~F.isnan(v.cast("double"))).groupBy(by, v.alias("v")).agg(F.count_if(~F.coalesce(second, F.lit(False))).alias("a"), F.count_if(second).alias("b"))
    run = ranked(cells, [by], [F.col("v")], {"ca": F.col("a"), "cb": F.col("b")})
    na, nb = F.col("ca_all"), F.col("cb_all")
    gap = F.when((na > 0) & (nb > 0), F.abs(F.col("ca") / na - F.col("cb") / nb))
    return run.groupBy(by).agg(F.max("ca_all").alias("n_first"), F.max("cb_all").alias("n_second"), F.round(F.max(gap), 6).alias("ks"))


def paired_comparison(rows: DataFrame, by: str, p1: str, p2: str, y: str) -> DataFrame:
    """Two models' squared errors on the same rows: ``n``, ``brier_1``, ``brier_2``, ``difference`` and its paired ``t`` (null without spread)."""
    y_ = F.col(y).cast("double")
    e1, e2 = F.pow(F.col(p1) - y_, 2), F.pow(F.col(p2) - y_, 2)
    t = rows.where(F.col(p1).isNotNull() & F.col(p2).isNotNull() & F.col(y).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg(e1).alias("b1"), F.avg(e2).alias("b2"), F.avg(e1 - e2).alias("d"), F.stddev_samp(e1 - e2).alias("s"))
    return t.select(by, "n", F.round("b1", 6).alias("brier_1"), F.round("b2", 6).alias("brier_2"), (F.round("d", 6) + 0.0).alias("difference"), F.round(F.when(F.col("s") > 0, F.col("d") / (F.col("s") / F.sqrt("n"))), 4).alias("t"))


def split_calibration(rows: DataFrame, by: str, time_col: str, tie: str, p: str = "p", y: str = "y", bins: int = 10) -> DataFrame:
    """Calibration fitted on each group's earlier half and judged on the later: ``n``, Brier scores ``raw``, ``binned`` and ``shifted``.

    ``binned`` answers with the bin's rate in the first half (the raw value where it had none), ``shifted`` with the
    value less the first half's mean error, kept within [0, 1].
    """
    placed = ranked(rows.where(F.col(p).between(0, 1) & F.col(y).isNotNull() & F.col(time_col).isNotNull()).select(by, time_col, tie, F.col(p).alias("p"), F.col(y).cast("double").alias("y")), [by], [F.col(time_col), F.col(tie), F.col("p"), F.col("y")])
    halves = placed.withColumn("late", F.col("rank") > F.floor(F.col("size") / 2)).withColumn("bin", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)))
    early = halves.where(~F.col("late")).groupBy(by, "bin").agg(F.count("*").alias("c"), F.sum("y").alias("sy"), F.sum("p").alias("sp"))  # ``bins`` rows a group
    mean = early.groupBy(by).agg((F.sum(F.col("sp") - F.col("sy")) / F.sum("c")).alias("bias"))
    j = halves.where("late").join(early.select(by, "bin", (F.col("sy") / F.col("c")).alias("rate")), [by, "bin"], "left").join(mean, by, "left")
    score = lambda q: F.round(F.avg(F.pow(q - F.col("y"), 2)), 6)
    moved = F.least(F.greatest(F.col("p") - F.coalesce("bias", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return j.groupBy(by).agg(F.count("*").alias("n"), score(F.col("p")).alias("raw"), score(F.coalesce("rate", "p")).alias("binned"), score(moved).alias("shifted"))


def label_shift(rows: DataFrame, by: str, label: str, second: Column, smooth: float = 0.5) -> DataFrame:
    """Per group how the distribution of labels moved to the rows where ``second`` holds: ``kl`` (nats, of the second from the first) and ``js``, smoothed by ``smooth``."""
    cells = rows.where(F.col(label).isNotNull()).groupBy(by, F.col(label).alias("l")).agg(F.count_if(~F.coalesce(second, F.lit(False))).alias("a"), F.count_if(second).alias("b"))
    whole = cells.groupBy(by).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count("*").alias("k"))
    q = (F.col("a") + smooth) / (F.col("na") + smooth * F.col("k"))
    p = (F.col("b") + smooth) / (F.col("nb") + smooth * F.col("k"))
    m = (p + q) / 2
    t = cells.join(whole, by).groupBy(by).agg(F.sum(p * F.log(p / q)).alias("kl"), F.sum(p * F.log(p / m) / 2 + q * F.log(q / m) / 2).alias("js"))
    return t.select(by, (F.round("kl", 6) + 0.0).alias("kl"), (F.round("js", 6) + 0.0).alias("js"))


def most_uncertain(rows: DataFrame, by: str, ident: str, p: str, k: int = 10) -> DataFrame:
    """The ``k`` rows of each group whose probability lies nearest to a half (ties: the least identifier, then value), for review: a top-k report."""
    w = Window.partitionBy(by).orderBy(F.round(F.abs(F.col(p) - 0.5), 9), ident, p)
    return rows.where(F.col(p).isNotNull() & ~F.isnan(p)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select(by, ident, F.col(p).alias("p"), "place")


def concordance(rows: DataFrame, duration: str, event: str, score: str) -> DataFrame:
    """Harrell's C of a risk score: ``concordant``, ``discordant`` and ``tied`` comparable pairs and ``c_index``; null without any.

    A pair is comparable if the one with the shorter duration had the event; it is concordant if that one has the higher score. Pairs are counted,
    not listed: two scores' ranks first differ in one bit, and for each bit, rows that share the bits above it are summed
    along the durations. So the work is the rows times the bits of the number of different scores.
    """
    full = rows.where(F.col(duration).isNotNull() & F.col(event).isNotNull() & F.col(score).isNotNull()).select(F.col(duration).alias("t"), F.col(event).cast("long").alias("e"), F.col(score).alias("s"))
    places = ranked(full.select("s").distinct(), [], [F.col("s")]).select("s", (F.col("rank") - 1).alias("r"), "size")
    placed = full.groupBy("s", "t").agg(F.count("*").alias("n"), F.sum("e").alias("e")).join(places, "s")
    levels = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.col("size").cast("double"))).cast("int") - 1, F.lit(0)))
    bits = placed.select("t", "n", "e", "r", F.explode(levels).alias("l")).select(
        "t", "n", "e", "l", F.expr("shiftright(r, l + 1)").alias("above"), F.expr("shiftright(r, l) & 1").alias("bit"))
    upper = F.col("bit") == 1
    cells = bits.groupBy("l", "above", "t").agg(
        F.sum(F.when(upper, 0).otherwise(F.col("n"))).alias("n0"), F.sum(F.when(upper, F.col("n")).otherwise(0)).alias("n1"),
        F.sum(F.when(upper, 0).otherwise(F.col("e"))).alias("e0"), F.sum(F.when(upper, F.col("e")).otherwise(0)).alias("e1"))
    longer = ranked(cells, ["l", "above"], [F.col("t")], {"c0": F.col("n0"), "c1": F.col("n1")})
    apart = longer.agg(F.sum(F.col("e1") * (F.col("c0_all") - F.col("c0"))).alias("concordant"), F.sum(F.col("e0") * (F.col("c1_all") - F.col("c1"))).alias("discordant"))
    same = ranked(placed.select("r", "t", "n", "e"), ["r"], [F.col("t")], {"c": F.col("n")}).agg(F.sum(F.col("e") * (F.col("c_all") - F.col("c"))).alias("tied"))
    c, d, t = (F.coalesce(x, F.lit(0)) for x in ("concordant", "discordant", "tied"))
    return apart.join(F.broadcast(same)).select(c.alias("concordant"), d.alias("discordant"), t.alias("tied"), F.round(F.try_divide(c + t / 2, c + d + t), 6).alias("c_index"))  # single rows
