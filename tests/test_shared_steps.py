"""Steps that many queries share, against plain readings of their rules, and what their plans must not hold."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from factorloom.operators import factors as V
from factorloom.operators import point_in_time as P
from factorloom.operators import scoring as X
from factorloom.operators import stats as A

day = dt.date.fromisoformat


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_of_prices_are_counted_without_looking_over_them(spark):
    rng = random.Random(3)
    days = sorted(rng.sample(range(1_500), 600))
    rows = [(1, day("2018-01-01") + dt.timedelta(d), float(rng.randint(1, 50) if rng.random() > 0.02 else -1)) for d in days] + [(2, day("2020-01-01"), 5.0)]
    prices = spark.createDataFrame(rows, "isin int, date date, adj_close double")
    dates = [day("2017-12-31"), day("2018-03-31"), day("2018-12-31"), day("2020-06-30"), day("2021-12-31"), day("2023-08-31")]
    grid = spark.createDataFrame([(d, i, "s") for d in dates for i in (1, 2, 3)], "as_of date, isin int, sector string")
    found = V.price_windows(grid, prices)
    assert "RangeFrame" not in plan(found) and plan(found).count("Exchange hashpartitioning(isin") == 1
    got = {(r.as_of, r.isin): r for r in found.collect()}
    told = {(r.as_of, r.isin): r.price_to_200dma for r in V.priced(grid, prices, 1, 1, 1).collect()}
    assert len(got) == 18
    for (d, i), r in got.items():
        own = [(x, v) for j, x, v in rows if j == i and v > 0 and x <= d]
        assert [r.n410, r.n320, r.n212] == [sum((d - x).days <= n for x, _ in own) for n in (410, 320, 212)]
        assert r.price == (own[-1][1] if own and (d - own[-1][0]).days <= 45 else None)
        near = [v for x, v in own if (d - x).days <= 320][-200:]
        want = near[-1] / (sum(near) / len(near)) if near else None
        assert told[d, i] == want or math.isclose(told[d, i], want)


def test_z_of_a_group_takes_one_exchange_and_equals_the_windows(spark):
    rng = random.Random(5)
    value = lambda: rng.choice([None, 1.0, rng.gauss(0, 1), rng.gauss(0, 1), 1e6 * rng.gauss(0, 1)])
    rows = [(t, f, i, rng.choice(["a", "b", "c", None]) if i else "few", value()) for t in ("t", "u", None) for f in ("x", "y") for i in range(60)]
    rows += [("flat", "x", i, "a" if i < 6 else None, 2.0) for i in range(8)] + [("one", "x", 1, "a", 7.0), ("none", "x", 1, "a", None)]
    df = spark.createDataFrame(rows, "as_of string, factor string, isin int, sector string, raw double")
    keys = ["as_of", "factor"]
    z = A.sector_zscore(df, "raw", keys, "sector", "z")
    assert "Window" not in plan(z) and plan(z).count("Exchange") == 1
    stats = A.winsor_stats(A.winsor_stats(df, "raw", keys, "_u"), "raw", [*keys, "sector"], "_s")
    own = F.col("sector").isNotNull() & (F.col("_sn") >= A.MIN_SECTOR)
    mean, std = F.when(own, F.col("_smean")).otherwise(F.col("_umean")), F.when(own, F.col("_sstd")).otherwise(F.col("_ustd"))
    flat = F.when(F.col("raw").isNotNull() & F.col("sector").isNotNull(), 0.0)
    want = {(r.as_of, r.factor, r.isin): r.z for r in stats.select(*df.columns, F.when(std > 0, (F.col("raw") - mean) / std).otherwise(flat).alias("z")).collect()}
    got = {(r.as_of, r.factor, r.isin): r.z for r in z.collect()}
    assert got.keys() == want.keys() and all((a is None) == (want[k] is None) and (a is None or math.isclose(a, want[k], rel_tol=1e-9, abs_tol=1e-12)) for k, a in got.items())


def test_statements_are_worked_out_for_filing_days_and_carried(spark):
    rng = random.Random(9)
    rows = [(1, day("1990-12-31") + dt.timedelta(365 * rng.randint(0, 20)), day("1991-01-01") + dt.timedelta(rng.randint(0, 3_000)), rng.choice(["CONSOLIDATED", "STANDALONE", None]), k) for k in range(500)]
    rows += [(1, None, day("1995-01-01"), "STANDALONE", -1), (1, day("2001-12-31"), None, "CONSOLIDATED", -2), (2, day("1994-12-31"), day("1995-05-05"), "STANDALONE", -3)]
    facts = spark.createDataFrame(rows, "isin int, period_end_date date, filing_date date, basis string, x int")
    dates = [day("1990-01-01"), day("1991-01-20"), day("1995-05-04"), day("1995-05-05"), day("2010-01-01")]
    grid = spark.createDataFrame([(d, i, "s") for d in dates for i in (1, 2, 3)], "as_of date, isin int, sector string")
    rows_of = lambda df: sorted((str(r.as_of), r.isin, r.rn, r.x) for r in df.collect())
    apart = lambda df: P.carried(grid, df).select("as_of", "isin", F.posexplode("best").alias("rn", "r")).select("as_of", "isin", (F.col("rn") + 1).alias("rn"), "r.x")
    order = [P.newest("period_end_date")]
    assert rows_of(apart(P.states(facts, "filing_date", order, 8))) == rows_of(P.latest_known(grid, facts, "filing_date", order, 8))
    assert rows_of(apart(P.states_of_basis(facts, 5))) == rows_of(P.newest_of_basis(grid, facts, 5))


def test_factors_get_their_family_from_a_table_once(spark):
    raw = spark.createDataFrame([("t", i, "s", f, float(i)) for f in ("roe", "accruals", "unknown") for i in range(6)], "as_of string, isin int, sector string, factor string, raw double")
    got = {(r.factor, r.isin): (r.z, r.family, r.weight) for r in X.factor_z(raw).collect()}
    assert len(got) == 18 and got["roe", 5][0] == -got["accruals", 5][0] > 0 and got["accruals", 5][1:] == ("quality", 0.15) and got["unknown", 5] == (None, None, None)


def test_percentiles_standardise_a_family_once(spark):
    families = spark.createDataFrame([(day("2020-01-31"), i, "value", float(i * i)) for i in range(4)], "as_of date, isin int, family string, family_z double")
    found = X.percentiles(families)
    text = found._jdf.queryExecution().analyzed().toString()
    assert text.count("stddev_samp(") <= 4, text.count("stddev_samp(")  # two, as windows and as they are named
    shown = [round(r.percentile, 1) for r in found.orderBy("isin").collect()]
    z = [(x - 3.5) / math.sqrt(49 / 3) for x in (0, 1, 4, 9)]
    assert shown == [round(50 * (1 + math.erf(v / math.sqrt(2))), 1) for v in z]
