"""Consensus of several annotators: iteratively reweighted voting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.scratch import Scratch


#: Accuracies that move by less are stable.
TOLERANCE = 2e-3


def spelled(c: Column) -> Column:
    """Lower case, no surrounding blanks, ``_`` for runs of blanks, ``-`` and ``_`` between words; null if nothing is left."""
    joined = F.regexp_replace(F.lower(c), r"[\s\p{Z}_-]+", "_")
    return F.nullif(F.regexp_replace(joined, "^_+|_+$", ""), F.lit(""))


def judgements(df: DataFrame, group: list[str], sides: list[tuple[str, str, str]], recency: str) -> DataFrame:
    """One row per object (``group``) and reviewer: ``reviewer``, ``label``.

    ``sides`` name (reviewer, label, time) columns. A label without a reviewer, or the reverse, is no
    judgement. Of several by one reviewer on an object the newest counts (by the side's time, then
    the row's ``recency``, nulls lowest, then the greatest label). Null group columns are a value.
    """
    each = F.explode(F.array(*[F.struct(spelled(F.col(r)).alias("reviewer"), spelled(F.col(c)).alias("label"), F.col(t).alias("t")) for r, c, t in sides]))
    rows = df.select(*group, F.col(recency).alias("__row"), each.alias("j")).where(F.col("j.reviewer").isNotNull() & F.col("j.label").isNotNull())
    newest = F.max(F.struct(F.col("j.t").alias("t"), F.col("__row").alias("row"), F.col("j.label").alias("label")))
    return rows.groupBy(*group, F.col("j.reviewer").alias("reviewer")).agg(newest.alias("n")).select(*group, "reviewer", F.col("n.label").alias("label"))


@dataclass
class Consensus:
    """``items``: domain, item, ``consensus_label``, ``confidence``, ``judgements``, ``agreement`` (share that gave this label);
    ``reviewers``: domain, ``reviewer``, ``reliability``, ``judgements``; ``agreement``: domain, ``alpha``, ``objects``."""

    items: DataFrame
    reviewers: DataFrame
    agreement: DataFrame
    #: Rounds taken, and the greatest move of an accuracy in the last one; not below the tolerance if the rounds ran out.
    rounds: int = 0
    change: float = 0.0

    @property
    def converged(self) -> bool:
        return self.change < TOLERANCE


def consensus(
    votes: DataFrame, domain: str, item: str, least_reviewers: int = 3, rounds: int = 30, prior: float = 6.0,
) -> Consensus:
    """Alternate weighted consensus and leave-one-out accuracy of reviewers until stable.

    ``votes``: ``domain``, ``item``, ``reviewer``, ``label``, one row per item and reviewer, no nulls but in the first
    two. All items with two or more votes teach the reviewers' accuracy; items with ``least_reviewers`` or more are returned.

    A vote counts towards *every* label c of its domain, by ``ln P(r says s | c is true)``. So a reviewer who
    is right in p of the cases adds the classic log-odds, one who always says the same adds nothing, and
    one who reliably takes two labels for each other counts for the other one. The probabilities are
    means, over the reviewer's votes, of what the item's *other* votes give (leave-one-out: no reviewer
    confirms itself), smoothed by ``prior`` votes towards a reviewer who errs evenly with the same
    accuracy, which is itself smoothed towards 0.7. Rounds end when no accuracy moves by
    ``TOLERANCE``, or after ``rounds``; the result tells which.

    Ties go to the label that is first by name. Agreement is Krippendorff's alpha for nominal labels,
    which allows for missing ratings; null where all labels are the same. A label known from one
    domain is none of another. Empty input gives no rows.

    What is summed per item and per (reviewer, label) is pre-aggregated before its shuffle, one item's
    votes are never gathered, and the weights (reviewers x labels rows, each an array over the labels)
    are joined, so neither many reviewers nor one much-judged item meet a limit.
    """
    scratch = Scratch(votes.sparkSession, "consensus")
    votes = scratch.save(votes)
    names = votes.groupBy(domain, "label").count()
    place = Window.partitionBy(domain).orderBy("label")
    known = scratch.save(names.select(domain, "label", (F.row_number().over(place) - 1).alias("s"), F.count("*").over(Window.partitionBy(domain)).alias("k")))
    most = known.agg(F.max("k").alias("k")).first()["k"] or 0
    objects = scratch.save(votes.groupBy(domain, item).agg(F.count("*").alias("n")).withColumn("oid", F.monotonically_increasing_id()))
    coded = _null_safe(_null_safe(votes, objects, [domain, item]), known, [domain, "label"])
    base = scratch.save(coded.select("oid", domain, "reviewer", "s", "n", "k"))
    taught = base.where("n >= 2")
    span = range(most)

    def posterior(df: DataFrame, keep: list[str], own: bool) -> DataFrame:
        """``keep`` (with ``k``) and ``q0`` ..: the labels' probabilities by ``total``, less the row's own weights ``w`` if ``own``.

        In steps, as plans grow with nesting, and as SQL text, which is built at once.
        """
        names = [f"`{x}`" for x in keep]
        parts = df.selectExpr(*names, *[f"total[{c}]{f' - w[{c}]' if own else ''} AS p{c}" for c in span])
        topped = parts.selectExpr("*", f"greatest(-1e12D, {', '.join(f'CASE WHEN k > {c} THEN p{c} END' for c in span)}) AS top")
        mass = topped.selectExpr(*names, *[f"CASE WHEN k > {c} THEN exp(p{c} - top) ELSE 0D END AS m{c}" for c in span])
        whole = mass.selectExpr("*", f"{' + '.join(f'm{c}' for c in span)} AS z")
        return whole.selectExpr(*names, *[f"m{c} / z AS q{c}" for c in span])

    def summed(source: DataFrame, model: DataFrame) -> tuple[DataFrame, DataFrame]:
        weighed = _null_safe(source, model.select(domain, "reviewer", "s", "w", "base"), [domain, "reviewer", "s"])
        whole = weighed.groupBy("oid").agg(_array(f"sum(w[{c}]) + coalesce(max(base[{c}]), 0D)" for c in span).alias("total"))
        return weighed, whole

    tallies = taught.groupBy(domain, "reviewer", "s", "k").agg(F.count("*").alias("n"))
    model = _even_weights(tallies, most)
    before, change, taken = None, float("inf") if most else 0.0, 0
    for taken in range(1, (rounds if most else 0) + 1):
        weighed, whole = summed(taught, model)
        others = weighed.join(whole, "oid")
        sums = scratch.save(
            posterior(others, [domain, "reviewer", "s", "k"], True)
            .groupBy(domain, "reviewer", "s", "k").agg(F.count("*").alias("n"), _array(f"sum(q{c})" for c in span).alias("q"))
        )
        new = scratch.save(_weights(sums, domain, most, prior))
        if before is not None:
            moved = _null_safe(new, before.select(domain, "reviewer", "s", F.col("accuracy").alias("was")), [domain, "reviewer", "s"])
            change = moved.agg(F.max(F.abs(F.col("accuracy") - F.col("was"))).alias("d")).first()["d"]
            scratch.discard(before)
            change = change or 0.0
            if change < TOLERANCE:
                model = new
                break
        before = model = new
    judged = base.where(F.col("n") >= least_reviewers)
    if most and least_reviewers < 2:  # what was only said of items with a single vote has taught nothing
        known_model = model.select(domain, "reviewer", "s", "w", "base")
        others = base.where("n < 2").groupBy(domain, "reviewer", "s", "k").agg(F.count("*").alias("n"))
        fresh = _null_safe(_even_weights(others, most), known_model.select(domain, "reviewer", "s"), [domain, "reviewer", "s"], "left_anti")
        blank = F.array(*[F.lit(None).cast("double") for _ in range(most)])
        model = model.select(domain, "reviewer", "s", "k", "n", "accuracy", "w", "base").unionByName(
            fresh.select(domain, "reviewer", "s", "k", "n", "accuracy", "w", blank.alias("base")))
    said = judged.groupBy("oid", "s").agg(F.count("*").alias("c"))
    whole = summed(judged, model)[1] if most else judged.select("oid").withColumn("total", F.array(F.lit(0.0)))
    sizes = _null_safe(objects, known.select(domain, "k").distinct(), [domain])
    scored = whole.join(sizes, "oid")
    kept = ["oid", domain, item, "n", "k"]
    likely = posterior(scored, kept, False) if most else scored.select(*kept, F.lit(1.0).alias("q0"))
    best = likely.select(*kept, F.array(*[F.round(f"q{c}", 9) for c in range(max(most, 1))]).alias("q")).withColumn(
        "confidence", F.array_max("q")).withColumn("s", (F.array_position("q", F.col("confidence")) - 1).cast("int"))
    named = _null_safe(best, known.select(domain, "s", F.col("label").alias("consensus_label")), [domain, "s"])
    items = named.join(said, ["oid", "s"], "left").select(
        domain, item, "consensus_label", F.round("confidence", 6).alias("confidence"), F.col("n").alias("judgements"),
        F.round(F.coalesce("c", F.lit(0)) / F.col("n"), 6).alias("agreement"),
    )
    reviewers = model.groupBy(domain, "reviewer").agg(F.round(F.max("accuracy"), 6).alias("reliability"), F.sum("n").alias("judgements"))
    return Consensus(items, reviewers, krippendorff(votes, domain, item), taken, change)


def _array(parts) -> Column:
    """An array of SQL expressions; one call instead of many for each element."""
    return F.expr(f"array({', '.join(parts)})")


def _even_weights(tallies: DataFrame, most: int, accuracy: float = 0.7) -> DataFrame:
    """The first round's weights: everyone is right in ``accuracy`` of the cases and errs evenly."""
    k = F.greatest(F.col("k"), F.lit(2))
    wrong = F.log((1 - F.lit(accuracy)) / (k - 1))
    w = F.array(*[F.when(F.col("s") == c, F.log(F.lit(accuracy))).otherwise(wrong) for c in range(most)])
    return tallies.withColumn("accuracy", F.lit(accuracy)).withColumn("w", w).withColumn("base", F.array(*[F.lit(0.0) for _ in range(most)]))


def _weights(sums: DataFrame, domain: str, most: int, prior: float) -> DataFrame:
    """Smoothed ``ln P(says s | c)`` per (domain, reviewer, s), with the reviewer's accuracy and the labels' log frequencies."""
    span = range(most)
    at_s = F.element_at("q", F.col("s") + 1)
    person = sums.groupBy(domain, "reviewer").agg(
        F.sum(at_s).alias("right"), F.sum("n").alias("votes"), _array(f"sum(q[{c}])" for c in span).alias("held")
    )
    person = person.withColumn("accuracy", (F.col("right") + 0.7 * prior) / (F.col("votes") + prior)).drop("right", "votes")
    shares = sums.groupBy(domain, "k").agg(_array(f"sum(q[{c}])" for c in span).alias("f"), F.sum("n").alias("total_n")).select(
        domain, _array(f"ln((f[{c}] + 1) / (total_n + k))" for c in span).alias("base")
    )
    joined = _null_safe(_null_safe(sums, person, [domain, "reviewer"]), shares, [domain])
    spread = "(1 - accuracy) / (greatest(k, 2) - 1)"
    w = _array(f"ln((q[{c}] + {prior}D * CASE WHEN s = {c} THEN accuracy ELSE {spread} END) / (held[{c}] + {prior}D))" for c in span)
    return joined.select(domain, "reviewer", "s", "k", "n", "accuracy", w.alias("w"), "base")


def _null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join that takes null keys for equal; of columns on both sides the left one stays."""
    r = right.select(*[F.col(c).alias(f"__{c}") for c in on], *[c for c in right.columns if c not in on and c not in left.columns])
    cond = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on]
    return left.join(r, cond, how).drop(*[f"__{c}" for c in on])


def krippendorff(votes: DataFrame, domain: str, item: str) -> DataFrame:
    """Krippendorff's alpha per domain for nominal labels over items with two or more votes: ``alpha``, ``objects``."""
    n = F.col("n")
    by_label = votes.groupBy(domain, item, "label").agg(F.count("*").alias("c"))
    sizes = by_label.groupBy(domain, item).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("sq")).where(n >= 2)
    observed = sizes.groupBy(domain).agg(F.sum((n * n - F.col("sq")) / (n - 1)).alias("apart"), F.sum("n").alias("total"), F.count("*").alias("objects"))
    kept = _null_safe(by_label, sizes.select(domain, item), [domain, item])
    margins = kept.groupBy(domain, "label").agg(F.sum("c").alias("m")).groupBy(domain).agg(F.sum(F.col("m") * F.col("m")).alias("msq"))
    both = _null_safe(observed, margins, [domain])
    total = F.col("total")
    return both.select(
        domain, F.round(1 - F.try_divide((total - 1) * F.col("apart"), total * total - F.col("msq")), 6).alias("alpha"), "objects"
    )


def label_votes(labels: DataFrame) -> DataFrame:
    """Judgements on (``label_domain``, ``object_id``), first and second labels alike; rows without an object are none."""
    sides = [("reviewer_id", "human_label", "reviewed_at"), ("second_reviewer_id", "second_label", "second_reviewed_at")]
    return judgements(labels.where(F.col("object_id").isNotNull()), ["label_domain", "object_id"], sides, "updated_at")


def label_consensus(labels: DataFrame, **options) -> Consensus:
    """``consensus`` of ``label_votes``."""
    return consensus(label_votes(labels), "label_domain", "object_id", **options)
