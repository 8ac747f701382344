"""Joins, aggregates and evaluation tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.rolling import log_return, pct_change, sma_n
from tidemark.operators import alignment, coverage, evaluation, moments, summaries
from tidemark.registry.core import OFF_MIDDLE, SQL, out, q6, r6, register
from tidemark.registry.inputs import (
    EV, EV_KEYS, EV_WINDOW, MACRO_SOURCE, NATION, SCORED, ln_sql, nation_days, panel_events, scored_events, sma_sql, table,
)
from tidemark.session import shared_dir, shared_path

# -- joins -------------------------------------------------------------------------------------

# One series per order priority, each with days of its own.
PARTS = {f"x_{n}": v for n, v in MACRO_SOURCE.items()}
_parts = ", ".join(
    f"""{n} AS (SELECT c_nationkey AS nation, cast(o_orderdate AS date) AS day, max(o_totalprice) AS {n}
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '{v}' GROUP BY ALL)"""
    for n, v in PARTS.items()
)


@register("merge_outer", f"WITH {_parts} SELECT nation, day, {', '.join(q6(n, n) for n in PARTS)} FROM "
          + " FULL JOIN ".join(f"{n} USING (nation, day)" if i else n for i, n in enumerate(PARTS)))
def merge_outer(spark, sf):
    orders = table(spark, sf, "orders", ["o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority"])
    customers = table(spark, sf, "customer", ["c_custkey", "c_nationkey"])
    prices = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_nationkey").alias("nation"), F.col("o_orderdate").cast("date").alias("day"), "o_orderpriority", "o_totalprice"
    )
    # One series for each priority, from one stored join instead of a join for each.
    shared_dir(spark)
    prices = prices.groupBy("nation", "day", "o_orderpriority").agg(F.max("o_totalprice").alias("o_totalprice")).checkpoint()
    frames = [
        prices.filter(F.col("o_orderpriority") == v).groupBy("nation", "day").agg(F.max("o_totalprice").alias(n))
        for n, v in PARTS.items()
    ]
    return out(alignment.merge_outer(frames, ["nation", "day"]), ["nation", "day"], list(PARTS))


@register("align_inner", f"""WITH {NATION}, o AS (SELECT nation, day, orders FROM nat WHERE orders > 1)
  SELECT nation, day, {q6('x / orders', 'per_order')} FROM nat JOIN o USING (nation, day, orders)""")
def align_inner(spark, sf):
    days = nation_days(spark, sf)
    several = days.filter("orders > 1").select("nation", "day", "orders")
    return alignment.align_inner(days.drop("orders"), several, ["nation", "day"], {"per_order": r6(F.col("x") / F.col("orders"))})


@register("merge_predictions", f"""WITH {SCORED} SELECT user_id, event_id, {q6('y', 'y')}, {q6('p', 'p')},
  cast((p >= 0.5) = (y >= 0.5) AS bigint) AS hit, {q6('change', 'change')} FROM scored WHERE change IS NOT NULL""")
def merge_predictions(spark, sf):
    shared_dir(spark)
    scored = scored_events(spark, sf).df.select(*EV_KEYS, "y", "p").checkpoint()
    returns = panel_events(spark, sf).roll({"change": pct_change("x")}).df
    merged = alignment.merge_predictions(
        scored.select(*EV_KEYS, "y"),
        scored.select(*EV_KEYS, "p"),
        scored.select(*EV_KEYS, S.hit_flag("p", "y").cast("long").alias("hit")),
        returns.select(*EV_KEYS, "change"),
        EV_KEYS,
    )
    return out(merged, [*EV_KEYS, "hit"], ["y", "p", "change"])


@register("calendar_densify", f"""WITH {NATION}, cal AS (
  SELECT nation, cast(unnest(generate_series(min(day)::timestamp, max(day)::timestamp, INTERVAL 1 DAY)) AS date) AS day FROM nat GROUP BY nation)
  SELECT nation, day, {q6('x', 'x')} FROM cal LEFT JOIN nat USING (nation, day)""")
def calendar_densify(spark, sf):
    return out(alignment.calendar_densify(nation_days(spark, sf).drop("orders"), ["nation"], "day"), ["nation", "day"], ["x"])


# -- descriptive aggregates --------------------------------------------------------------------


@register("agg_minmax", f"SELECT user_id, {q6('min(value)', 'lo')}, {q6('max(value)', 'hi')} FROM events GROUP BY user_id")
def agg_minmax(spark, sf):
    return out(summaries.agg_minmax(table(spark, sf, "events", ["user_id", "value"]), "value", ["user_id"]), ["user_id"], ["lo", "hi"])


@register("agg_mean_sd", f"SELECT user_id, {q6('avg(value)', 'mean')}, {q6('stddev_samp(value)', 'sd')} FROM events GROUP BY user_id")
def agg_mean_sd(spark, sf):
    return out(summaries.agg_mean_sd(table(spark, sf, "events", ["user_id", "value"]), "value", ["user_id"]), ["user_id"], ["mean", "sd"])


RETURNS = f"""{EV}, feat AS (SELECT *, {sma_sql(5)} AS s FROM ev), ret AS (
  SELECT user_id, event_id, 100e0 * ({ln_sql('s')} - {ln_sql(f'lag(s) OVER ({EV_WINDOW})')}) AS r FROM feat)"""


def sma_returns(spark, sf):
    return panel_events(spark, sf).roll({"r": log_return(sma_n("x", 5))}).df.select(*EV_KEYS, "r")


_JB = "n / 6e0 * (power(m3 / power(m2, 1.5e0), 2) + power(m4 / (m2 * m2) - 3e0, 2) / 4e0)"


@register("jarque_bera", f"""WITH {RETURNS}, c AS (SELECT user_id, r, avg(r) OVER (PARTITION BY user_id) AS m FROM ret WHERE r IS NOT NULL), q AS (
  SELECT user_id, count(*) AS n, avg((r-m)*(r-m)) AS m2, avg((r-m)*(r-m)*(r-m)) AS m3, avg((r-m)*(r-m)*(r-m)*(r-m)) AS m4 FROM c GROUP BY user_id)
  SELECT user_id, n, {q6(_JB, 'statistic')}, {q6(f'exp(-({_JB}) / 2e0)', 'p_value')} FROM q""")
def jarque_bera(spark, sf):
    return out(summaries.jarque_bera(sma_returns(spark, sf), "r", ["user_id"]), ["user_id", "n"], ["statistic", "p_value"])


def histogram_sql(ctes: str, source: str, v: str, bins: int, by: str = "") -> str:
    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    join = f"JOIN b USING ({by})" if by else "CROSS JOIN b"
    return f"""{ctes}, b AS (SELECT {key}min({v}) AS lo, max({v}) AS hi, count({v}) AS total, avg({v}) AS mean, stddev_samp({v}) AS sd FROM {source} {group}),
  placed AS (SELECT {key}cast(least({bins}, greatest(1, coalesce(ceil(({v} - lo) * {bins} / nullif(hi - lo, 0)), 1))) AS bigint) AS bin, count(*) AS n
             FROM {source} {join} WHERE {v} IS NOT NULL GROUP BY ALL),
  frame AS (SELECT *, (hi - lo) / {bins} AS width FROM b CROSS JOIN generate_series(1, {bins}) AS g(bin))"""


HIST_DENSITY = "coalesce(n, 0) / nullif(total * width, 0)"


@register("histogram_density", f"""WITH {histogram_sql(RETURNS, 'ret', 'r', 20)}
  SELECT cast(bin AS bigint) AS bin, {q6('lo + width * (bin - 1)', 'bin_low')}, {q6(HIST_DENSITY, 'density')} FROM frame LEFT JOIN placed USING (bin)""")
def histogram_density(spark, sf):
    df = summaries.histogram(sma_returns(spark, sf), "r", 20)
    return out(df.withColumn("bin", F.col("bin").cast("long")), ["bin"], ["bin_low", "density"])


@register("histogram_counts", f"""WITH {histogram_sql(RETURNS, 'ret', 'r', 8, 'user_id')}
  SELECT user_id, cast(bin AS bigint) AS bin, cast(coalesce(n, 0) AS bigint) AS n FROM frame LEFT JOIN placed USING (user_id, bin)""")
def histogram_counts(spark, sf):
    df = summaries.histogram(sma_returns(spark, sf), "r", 8, ["user_id"])
    return df.select("user_id", F.col("bin").cast("long").alias("bin"), F.col("n").cast("long").alias("n"))


@register("histogram_density_100", f"""WITH {histogram_sql(RETURNS, 'ret', 'r', 100)}
  SELECT cast(bin AS bigint) AS bin, cast(coalesce(n, 0) AS bigint) AS n, {q6(HIST_DENSITY, 'density')} FROM frame LEFT JOIN placed USING (bin)""")
def histogram_density_100(spark, sf):
    df = summaries.histogram(sma_returns(spark, sf), "r", 100)
    return out(df.select(F.col("bin").cast("long").alias("bin"), F.col("n").cast("long").alias("n"), "density"), ["bin", "n"], ["density"])


@register("histogram_counts_20", f"""WITH {histogram_sql(RETURNS, 'ret', 'r', 20, 'user_id')}
  SELECT user_id, cast(bin AS bigint) AS bin, cast(coalesce(n, 0) AS bigint) AS n FROM frame LEFT JOIN placed USING (user_id, bin)""")
def histogram_counts_20(spark, sf):
    df = summaries.histogram(sma_returns(spark, sf), "r", 20, ["user_id"])
    return df.select("user_id", F.col("bin").cast("long").alias("bin"), F.col("n").cast("long").alias("n"))


_MID = "((lo + width * (bin - 1)) + (lo + width * bin)) / 2e0"


@register("normal_overlay", f"""WITH {histogram_sql(RETURNS, 'ret', 'r', 20)}
  SELECT cast(bin AS bigint) AS bin, {q6(_MID, 'x')}, {q6(f'exp(-0.5e0 * power(({_MID} - mean) / sd, 2)) / (sd * sqrt(2e0 * pi()))', 'density')} FROM frame""")
def normal_overlay(spark, sf):
    df = summaries.normal_overlay(sma_returns(spark, sf), "r", 20)
    return out(df.withColumn("bin", F.col("bin").cast("long")), ["bin"], ["x", "density"])


# -- evaluation --------------------------------------------------------------------------------

HIT = "cast((p >= 0.5) = (y >= 0.5) AS double)"


@register("agg_sse", f"WITH {SCORED} SELECT user_id, {q6('sum(0.5e0 * (y - p) * (y - p))', 'sse')} FROM scored GROUP BY user_id")
def agg_sse(spark, sf):
    return out(evaluation.agg_sse(scored_events(spark, sf).df, by=["user_id"]), ["user_id"], ["sse"])


@register("hit_rate", f"WITH {SCORED} SELECT user_id, count(*) AS n, {q6(f'avg({HIT})', 'hit_rate')} FROM scored GROUP BY user_id")
def hit_rate(spark, sf):
    return out(evaluation.hit_rate(scored_events(spark, sf).df, by=["user_id"]), ["user_id", "n"], ["hit_rate"])


CALIBRATION = """, bins AS (SELECT greatest(1, ceil(p * 20)) AS bin, sum(y) AS occurences, count(*) AS total FROM scored {where} GROUP BY 1)
  SELECT cast(g.bin AS bigint) AS bin,
         concat(cast(cast((g.bin - 1) AS decimal(9,0)) / 20 AS decimal(4,2))::varchar, ' to ', cast(cast(g.bin AS decimal(9,0)) / 20 AS decimal(4,2))::varchar) AS label,
         {probability}, {occurences}, cast(coalesce(total, 0) AS bigint) AS total, {comparison}
  FROM generate_series(1, 20) AS g(bin) LEFT JOIN bins ON bins.bin = g.bin"""
_CAL = {
    "probability": q6("occurences / nullif(total, 0)", "probability"),
    "occurences": q6("coalesce(occurences, 0)", "occurences"),
    "comparison": q6("g.bin / 20e0", "comparison"),
}


def _calibration(df):
    keys = [F.col("bin").cast("long").alias("bin"), "label", F.col("total").cast("long").alias("total")]
    return df.select(*keys, *(r6(c).alias(c) for c in _CAL))


@register("calibration", f"WITH {SCORED}" + CALIBRATION.format(where="", **_CAL))
def calibration(spark, sf):
    return _calibration(evaluation.calibration(scored_events(spark, sf).df))


@register("calibration_open", f"WITH {SCORED}" + CALIBRATION.format(where="WHERE p * 20 <> ceil(p * 20)", **_CAL))
def calibration_open(spark, sf):
    return _calibration(evaluation.calibration(scored_events(spark, sf).df, edges="open"))


@register("calibration_ref", f"WITH {SCORED}" + CALIBRATION.format(where="", **_CAL) + " WHERE total > 0")
def calibration_ref(spark, sf):
    return _calibration(evaluation.calibration(scored_events(spark, sf).df, drop_empty=True))


REGIME = "CASE WHEN p > 0.8 THEN 'up' WHEN p < 1e0 - 0.8e0 THEN 'down' ELSE 'middle' END"


def _conditional(change: str) -> str:
    return (f"WITH {SCORED} SELECT {REGIME} AS regime, count(*) AS n, {q6(f'avg({change})', 'mean_return')} "
            f"FROM scored WHERE {change} IS NOT NULL GROUP BY 1")


@register("conditional_return", _conditional("change"))
def conditional_return(spark, sf):
    return out(evaluation.conditional_return(scored_events(spark, sf).df, "p", "change", 0.8), ["regime", "n"], ["mean_return"])


@register("conditional_return_forward", _conditional("next_change"))
def conditional_return_forward(spark, sf):
    return out(evaluation.conditional_return(scored_events(spark, sf).df, "p", "next_change", 0.8), ["regime", "n"], ["mean_return"])


_SURE = "FILTER (WHERE p > 1e0 - 0.2e0 OR p < 0.2e0)"


@register("selective_accuracy", f"""WITH {SCORED} SELECT user_id, count(*) AS total, count(*) {_SURE} AS bets,
  {q6(f'avg({HIT}) {_SURE}', 'hit_rate')}, {q6(f'count(*) {_SURE} / count(*)', 'coverage')} FROM scored GROUP BY user_id""")
def selective_accuracy(spark, sf):
    df = evaluation.selective_accuracy(scored_events(spark, sf).df, extreme=0.2, by=["user_id"])
    return out(df, ["user_id", "total", "bets"], ["hit_rate", "coverage"])


@register("hits_by_year", f"WITH {SCORED} SELECT cast(year(ts) AS bigint) AS year, count(*) AS n, {q6(f'avg({HIT})', 'hit_rate')} FROM scored GROUP BY 1")
def hits_by_year(spark, sf):
    df = evaluation.hits_by_year(scored_events(spark, sf).df, "ts")
    return out(df.withColumn("year", F.col("year").cast("long")), ["year", "n"], ["hit_rate"])


@register("accuracy_tstat", f"""WITH {SCORED} SELECT user_id, count(*) AS n, {q6(f'avg({HIT})', 'hit_rate')},
  {q6(f'(avg({HIT}) - 0.5e0) * sqrt(count(*)) / nullif(stddev_samp({HIT}), 0)', 't_stat')} FROM scored GROUP BY user_id""")
def accuracy_tstat(spark, sf):
    return out(evaluation.accuracy_tstat(scored_events(spark, sf).df, by=["user_id"]), ["user_id", "n"], ["hit_rate", "t_stat"])


# -- states that merge, and every threshold at once ----------------------------------------------


@register("jarque_bera_merge", SQL["jarque_bera"])
def jarque_bera_merge(spark, sf):
    """The test from states of the rows by day: each day is reduced alone, and the states are merged."""
    returns = panel_events(spark, sf).roll({"r": log_return(sma_n("x", 5))}).df.withColumn("day", F.to_date("ts"))
    path = shared_path(spark, "states")
    moments.moments(returns, "r", ["user_id", "day"]).write.parquet(path)
    states = moments.merge_moments(spark.read.parquet(path), ["user_id"], salt=4)
    return out(moments.jarque_bera_of(states, ["user_id"]), ["user_id", "n"], ["statistic", "p_value"])


@register("mean_sd_merge", SQL["agg_mean_sd"])
def mean_sd_merge(spark, sf):
    """Mean and deviation of each user from states by day."""
    rows = table(spark, sf, "events", ["user_id", "value", "ts"]).withColumn("day", F.to_date("ts"))
    states = moments.merge_moments(moments.moments(rows, "value", ["user_id", "day"]), ["user_id"])
    return out(moments.mean_sd_of(states, ["user_id"]), ["user_id"], ["mean", "sd"])


# Scores of both engines differ in the last bit, so thresholds are taken at three decimals.
@register("coverage_curve", f"""WITH {SCORED}, g AS (
  SELECT round(abs(p - 0.5) + {OFF_MIDDLE}, 3) AS confidence, count(*) AS n, sum({HIT}) AS hits FROM scored GROUP BY 1),
  r AS (SELECT confidence, sum(n) OVER (ORDER BY confidence DESC) AS bets, sum(hits) OVER (ORDER BY confidence DESC) AS hits, sum(n) OVER () AS total FROM g)
  SELECT {q6('confidence', 'confidence')}, bets::bigint AS bets, {q6('hits / bets', 'hit_rate')}, {q6('bets / total', 'coverage')} FROM r""")
def coverage_curve(spark, sf):
    confidence = F.round(F.abs(F.col("p") - 0.5) + float(OFF_MIDDLE), 3)
    curve = coverage.coverage_curve(scored_events(spark, sf).df, confidence=confidence, range_rows=50)
    return out(curve, ["bets"], ["confidence", "hit_rate", "coverage"])
