"""Action sequences per entity: frequencies, transitions, motifs and signatures.

Neighbouring actions are carried over days, so an entity's sequence is never gathered in one row or
task; an n-gram is the action with the n-1 before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.numeric import safe_div, seconds


def with_history(rows: DataFrame, key: str, time_col: str, tie: str, action: str, n: int) -> DataFrame:
    """Add ``a1`` .. ``a{n-1}``: the actions one to ``n - 1`` rows before, null where there are none.

    Within a day an ordinary window of ``n - 1`` rows does it; what reaches over days comes from the last
    ``n - 1`` actions of the days before, at most as many days. So the source is read twice, whatever ``n``.
    """
    back = n - 1
    cell = F.struct(F.col(action).alias("v"))  # keeps a null apart from no row at all
    days = rows.where(F.col(time_col).isNotNull()).withColumn("__b", F.floor(seconds(F.col(time_col)) / 86_400))
    order = Window.partitionBy(key, "__b").orderBy(time_col, tie)
    last = Window.partitionBy(key, "__b").orderBy(F.desc(time_col), F.desc(tie))
    tails = days.select(key, "__b", F.row_number().over(last).alias("__i"), cell.alias("__c")).where(F.col("__i") <= back)
    per = tails.groupBy(key, "__b").agg(F.sort_array(F.collect_list(F.struct((-F.col("__i")).alias("i"), F.col("__c").alias("c")))).alias("__l"))
    earlier = Window.partitionBy(key).orderBy("__b").rowsBetween(-back, -1)
    carried = per.select(F.col(key).alias("__k"), F.col("__b").alias("__tb"), F.transform(F.flatten(F.collect_list("__l").over(earlier)), lambda x: x["c"]).alias("__e"))
    here = days.withColumn("__n", F.collect_list(cell).over(order.rowsBetween(-back, -1)))
    joined = here.join(carried, here[key].eqNullSafe(carried["__k"]) & (here["__b"] == carried["__tb"]), "left")
    past = joined.withColumn("__p", F.concat(F.coalesce("__e", F.array().cast(carried.schema["__e"].dataType)), "__n"))
    return past.select(*rows.columns, *[F.when(F.size("__p") >= i, F.element_at("__p", -i)["v"]).alias(f"a{i}") for i in range(1, n)])


def frequencies(rows: DataFrame, key: str, action: str, kinds: int = 8) -> DataFrame:
    """Per entity: ``n``, ``distinct_actions`` and the entropy of its actions over that of ``kinds`` equal ones."""
    c = rows.groupBy(key, action).agg(F.count("*").alias("c"))
    x = F.col("c")
    t = c.groupBy(key).agg(F.sum("c").alias("n"), F.count("*").alias("distinct_actions"), (F.log2(F.sum(x)) - F.sum(x * F.log2(x)) / F.sum(x)).alias("h"))
    return t.select(key, "n", "distinct_actions", F.round(F.col("h") / F.log2(F.lit(float(kinds))) + 0.0, 6).alias("entropy"))


def bigrams(rows: DataFrame, key: str, time_col: str, tie: str, action: str) -> DataFrame:
    """(``before``, ``after``, ``n``, ``probability``) of consecutive actions over all entities."""
    pairs = with_history(rows, key, time_col, tie, action, 2).where(F.col("a1").isNotNull() & F.col(action).isNotNull())
    n = pairs.groupBy(F.col("a1").alias("before"), F.col(action).alias("after")).agg(F.count("*").alias("n"))
    total = n.groupBy("before").agg(F.sum("n").alias("t"))
    return n.join(total, "before").select("before", "after", "n", F.round(F.col("n") / F.col("t"), 6).alias("probability"))


def motifs(rows: DataFrame, key: str, time_col: str, tie: str, action: str, longest: int = 4, least: int = 3) -> DataFrame:
    """n-grams of 2 to ``longest`` actions seen ``least`` times or more: ``motif``, ``freq``, ``entities``, ``confidence``.

    Confidence is the mean of min(freq / 10, 1) and the share of all entities that show the motif.
    """
    back = with_history(rows, key, time_col, tie, action, longest)
    grams = [
        F.when(F.col(f"a{n - 1}").isNotNull(), F.concat_ws(">", *[F.col(f"a{i}") for i in range(n - 1, 0, -1)], F.col(action))) for n in range(2, longest + 1)
    ]
    long = back.select(key, F.explode(F.array_compact(F.array(*grams))).alias("motif"))
    per = long.groupBy("motif", key).agg(F.count("*").alias("c")).groupBy("motif").agg(F.sum("c").alias("freq"), F.count("*").alias("entities"))
    every = rows.select(key).distinct().agg(F.count("*").alias("every"))
    share = safe_div(F.col("entities"), F.col("every"))
    return per.where(F.col("freq") >= least).join(F.broadcast(every)).select(  # one row
        "motif", "freq", "entities", F.round((F.least(F.col("freq") / 10, F.lit(1.0)) + share) / 2, 6).alias("confidence"))


def signatures(rows: DataFrame, key: str, time_col: str, tie: str, action: str, patterns: dict[str, list[str]], mismatches: int = 1) -> DataFrame:
    """Per entity and pattern: ``exact`` and ``fuzzy`` (up to ``mismatches`` wrong actions) occurrences; entities with neither give no row."""
    longest = max(map(len, patterns.values()))
    back = with_history(rows, key, time_col, tie, action, longest)
    hits = []
    for name, p in patterns.items():
        cells = [F.col(f"a{len(p) - 1 - i}") if i < len(p) - 1 else F.col(action) for i in range(len(p))]
        wrong = sum((F.when(c.eqNullSafe(F.lit(x)), 0).otherwise(1) for c, x in zip(cells, p, strict=True)), F.lit(0))
        whole = cells[0].isNotNull()
        hits.append(F.struct(F.lit(name).alias("pattern"), (whole & (wrong == 0)).cast("int").alias("e"), (whole & (wrong > 0) & (wrong <= mismatches)).cast("int").alias("f")))
    t = back.select(key, F.explode(F.array(*hits)).alias("x")).groupBy(key, "x.pattern").agg(F.sum("x.e").alias("exact"), F.sum("x.f").alias("fuzzy"))
    return t.where("exact + fuzzy > 0")
