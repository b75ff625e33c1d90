"""Composite scores, red flags, signals, and what explains them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.functions.scalar import normal_cdf, safe_divide
from factorloom.operators.factors import FACTORS
from factorloom.operators.stats import sector_zscore, standardise

#: fixed values: families' weights, bounds of signals, and flags
FAMILY_WEIGHTS = {"value": 0.25, "quality": 0.30, "growth": 0.20, "momentum": 0.15, "sentiment": 0.10}
BUY, SELL, MIN_COVERAGE = 75.0, 45.0, 0.5
FLAGS = ("promoter_pledge", "auditor", "weak_cash_conversion", "promoter_selling", "contingent_liabilities", "rating_downgrade")


def factor_z(raw: DataFrame, factors: dict[str, tuple[str, bool, float]] = FACTORS) -> DataFrame:
    """Adds z (sector-relative, signed so that more is better), family and weight to as_of, isin, sector, factor, raw. factors: family, whether more is better, and weight of each."""
    z = sector_zscore(raw, "raw", ["as_of", "factor"], "sector", "z")
    table = raw.sparkSession.createDataFrame([(name, family, float(weight), 1 if up else -1) for name, (family, up, weight) in factors.items()], "factor string, family string, weight double, _sign int")
    told = z.join(F.broadcast(table), "factor", "left")  # one row a factor
    return told.select(*raw.columns, (F.col("z") * F.col("_sign")).alias("z"), "family", "weight")


def family_scores(z: DataFrame) -> DataFrame:
    """as_of, isin, family, mean_z, family_z, coverage: weighted over the factors that are present."""
    present = F.when(F.col("z").isNotNull(), F.col("weight"))
    rows = z.groupBy("as_of", "isin", "family").agg(F.sum(F.col("z") * F.col("weight")).alias("a"), F.sum(present).alias("b"), F.sum("weight").alias("c"))
    rows = rows.select("as_of", "isin", "family", safe_divide(F.col("a"), F.col("b")).alias("mean_z"), (F.coalesce("b", F.lit(0.0)) / F.col("c")).alias("coverage"))
    return rows.withColumn("family_z", standardise("mean_z", ["as_of", "family"]))


def family_weight() -> Column:
    return F.create_map(*[F.lit(x) for pair in FAMILY_WEIGHTS.items() for x in pair])[F.col("family")]


def composite(families: DataFrame) -> DataFrame:
    """as_of, isin, coverage, composite_z, factor_score: families renormalised over those present; too little coverage leaves no score."""
    w = family_weight()
    rows = families.groupBy("as_of", "isin").agg(F.sum(w * F.col("coverage")).alias("coverage"), F.sum(w * F.col("family_z")).alias("a"), F.sum(F.when(F.col("family_z").isNotNull(), w)).alias("b"))
    rows = rows.withColumn("composite_z", F.when(F.col("coverage") >= MIN_COVERAGE, safe_divide(F.col("a"), F.col("b")))).drop("a", "b")
    return rows.withColumn("_s", standardise("composite_z", ["as_of"])).withColumn("factor_score", normal_cdf(F.col("_s")) * 100).drop("_s")


def percentiles(families: DataFrame) -> DataFrame:
    """as_of, isin, family, percentile."""
    # z is a column of its own: the distribution function names it many times, and each would be windows anew
    rows = families.withColumn("_s", standardise("family_z", ["as_of", "family"]))
    return rows.select("as_of", "isin", "family", (normal_cdf(F.col("_s")) * 100).alias("percentile"))


def signals(scores: DataFrame, flags: DataFrame) -> DataFrame:
    """Adds n_flags, score (NULL when flagged) and signal; an unscored company has no signal, flagged or not."""
    rows = scores.join(flags, ["as_of", "isin"], "left").withColumn("n_flags", F.coalesce("n_flags", F.lit(0)))
    s = F.col("factor_score")
    signal = F.when(s.isNull(), None).when(F.col("n_flags") > 0, "SELL").when(s >= BUY, "BUY").when(s >= SELL, "HOLD").otherwise("SELL")
    return rows.withColumn("score", F.when(F.col("n_flags") == 0, s)).withColumn("signal", signal)


def tri_state(condition: Column, known: Column) -> Column:
    return F.when(~F.coalesce(known, F.lit(False)), "UNKNOWN").when(condition, "TRIPPED").otherwise("CLEAR")


def red_flags(grid: DataFrame, history: DataFrame, holding: DataFrame) -> DataFrame:
    """as_of, isin, flag, state for every company and flag.

    history: visible annual rows numbered from the newest (rn); holding: visible
    shareholding rows numbered likewise.
    """
    first = lambda c: F.max(F.when(F.col("rn") == 1, F.col(c)))
    weak = safe_divide(F.col("ocf"), F.col("pat"))
    years = history.where("rn <= 3").groupBy("as_of", "isin").agg(first("auditor_opinion").alias("opinion"), first("contingent_liabilities").alias("contingent"), first("total_equity").alias("equity"), F.count(weak).alias("n_weak"), F.bool_and(weak < 0.5).alias("weak"))
    seen = holding.where("promoter_pct is not null").withColumn("k", F.row_number().over(Window.partitionBy("as_of", "isin").orderBy("rn"))).where("k <= 4")
    falls = seen.groupBy("as_of", "isin").agg(F.count("*").alias("n_held"), *(F.max(F.when(F.col("k") == k, F.col("promoter_pct"))).alias(f"h{k}") for k in range(1, 5)))
    pledged = holding.where("rn = 1").select("as_of", "isin", F.col("promoter_pledged_pct").alias("pledged"))
    rows = grid.select("as_of", "isin").join(years, ["as_of", "isin"], "left").join(falls, ["as_of", "isin"], "left").join(pledged, ["as_of", "isin"], "left")
    c = F.col
    states = {
        "promoter_pledge": tri_state(c("pledged") > 25, c("pledged").isNotNull()),
        "auditor": tri_state(c("opinion").isin("QUALIFIED", "ADVERSE", "DISCLAIMER"), c("opinion").isNotNull() & (c("opinion") != "NOT_STATED")),
        "weak_cash_conversion": tri_state(c("weak"), c("n_weak") == 3),
        "promoter_selling": tri_state((c("h1") < c("h2")) & (c("h2") < c("h3")) & (c("h3") < c("h4")), c("n_held") == 4),
        "contingent_liabilities": tri_state(F.when(c("equity") > 0, c("contingent") > 0.5 * c("equity")).otherwise(c("contingent") > 0), c("contingent").isNotNull() & c("equity").isNotNull()),
        "rating_downgrade": F.lit("UNKNOWN"),
    }
    return rows.select("as_of", "isin", *(s.alias(n) for n, s in states.items())).unpivot(["as_of", "isin"], list(FLAGS), "flag", "state")


def flag_summary(flags: DataFrame) -> DataFrame:
    """as_of, isin, n_flags, red_flags, unknown_flags (names in order, joined by commas)."""
    names = lambda s: F.array_join(F.array_sort(F.collect_list(F.when(F.col("state") == s, F.col("flag")))), ",")
    return flags.groupBy("as_of", "isin").agg(F.count_if(F.col("state") == "TRIPPED").alias("n_flags"), names("TRIPPED").alias("red_flags"), names("UNKNOWN").alias("unknown_flags"))


def contributions(families: DataFrame) -> DataFrame:
    """as_of, isin, family, contribution, verdict: contributions of a company add up to its composite."""
    w = F.when(F.col("family_z").isNotNull(), family_weight())
    total = F.sum(w).over(Window.partitionBy("as_of", "isin"))
    verdict = F.when(F.col("family_z").isNull(), "MISSING").when(F.col("family_z") >= 0.75, "STRENGTH").when(F.col("family_z") <= -0.75, "WEAKNESS").otherwise("NEUTRAL")
    return families.select("as_of", "isin", "family", (w * F.col("family_z") / total).alias("contribution"), verdict.alias("verdict"))


def dominant_family(parts: DataFrame) -> DataFrame:
    """as_of, isin, family: the family with the greatest contribution in size."""
    return parts.where("contribution is not null").groupBy("as_of", "isin").agg(F.max_by("family", F.struct(F.abs("contribution"), "family")).alias("dominant"))
