"""Sources, projections, filters, scalar functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import selection as sel
from tidemark.registry.core import out, q6, r6, register
from tidemark.registry.inputs import (
    DESIGN, EV, FEATURES, MARKET, MACRO_SOURCE, SCORED, daily_market, design_events, panel_events, scored_events, table,
)
from tidemark.sources import series_csv as src


@register("scan_series", f"SELECT event_id, user_id, {q6('value', 'value')} FROM events")
def scan_series(spark, sf):
    return out(src.scan_series(spark, f"{sf}/events.parquet", ["event_id", "user_id", "value"]), ["event_id", "user_id"], ["value"])


# Blank cells are made from the table itself: words that start the text of some rows are cut to blanks.
@register("blank_to_null", """SELECT c_custkey, CASE WHEN trim(seg) <> '' THEN seg END AS seg, c_name FROM (
  SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN '' WHEN 'MACHINERY' THEN '   ' ELSE c_mktsegment END AS seg, c_name
  FROM customer)""")
def blank_to_null(spark, sf):
    segment = F.when(F.col("c_mktsegment") == "BUILDING", "").when(F.col("c_mktsegment") == "MACHINERY", "   ").otherwise(F.col("c_mktsegment"))
    df = table(spark, sf, "customer", ["c_custkey", "c_mktsegment", "c_name"]).select("c_custkey", segment.alias("seg"), "c_name")
    return src.blank_to_null(df)


@register("dot_to_null", f"""SELECT event_id, {q6("try_cast(CASE WHEN value < 5 THEN NULL ELSE cast(value AS varchar) END AS double)", 'v')} FROM events""")
def dot_to_null(spark, sf):
    text = F.when(F.col("value") < 5, ".").otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events", ["event_id", "value"]).select("event_id", r6(src.marker_to_null(text)).alias("v"))


@register("parse_day", """SELECT o_orderkey, cast(o_orderdate AS date) AS short_year, cast(o_orderdate AS date) AS long_year,
  CASE WHEN length(d) = 10 THEN cast(try_strptime(d, '%d.%m.%Y') AS date) END AS iso FROM (
  SELECT o_orderkey, o_orderdate, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)""")
def parse_day(spark, sf):
    text = lambda f: F.date_format("o_orderdate", f)
    return table(spark, sf, "orders", ["o_orderkey", "o_orderdate"]).select(
        "o_orderkey",
        src.parse_day(text("dd.MM.yy")).alias("short_year"),
        src.parse_day(text("dd.MM.yyyy")).alias("long_year"),
        src.parse_day(text("yyyy-MM-dd")).alias("iso"),
    )


@register("as_series", f"WITH {EV} SELECT user_id, ts, event_id, rn, {q6('x', 'x')} FROM ev")
def as_series(spark, sf):
    return out(sel.as_series(panel_events(spark, sf), ["x"]), ["user_id", "ts", "event_id", "rn"], ["x"])


@register("select_cols", f"SELECT o_orderkey, {q6('o_totalprice', 'o_totalprice')} FROM orders")
def select_cols(spark, sf):
    return out(sel.select_cols(spark.read.parquet(f"{sf}/orders.parquet"), ["o_orderkey", "o_totalprice"]), ["o_orderkey"], ["o_totalprice"])


@register("row_range", f"WITH {EV} SELECT user_id, event_id, {q6('x', 'x')} FROM ev WHERE rn BETWEEN 5 AND 40")
def row_range(spark, sf):
    return out(sel.row_range(panel_events(spark, sf), 5, 40), ["user_id", "event_id"], ["x"])


@register("time_range", f"SELECT event_id, user_id, {q6('value', 'value')} FROM events WHERE ts >= TIMESTAMP '2024-01-11'")
def time_range(spark, sf):
    df = table(spark, sf, "events", ["event_id", "user_id", "ts", "value"])
    return out(sel.time_range(df, "ts", start=dt.datetime(2024, 1, 11)), ["event_id", "user_id"], ["value"])


@register("drop_null", f"WITH {MARKET} SELECT day, {q6('gold', 'gold')} FROM market WHERE gold IS NOT NULL")
def drop_null(spark, sf):
    return out(sel.drop_null(daily_market(spark, sf).df, "gold"), ["day"], ["gold"])


_odd = "CASE WHEN value < 2 THEN 'Infinity'::double WHEN value < 4 THEN 'NaN'::double ELSE value END"


@register("finite_or_null", f"SELECT event_id, {q6('CASE WHEN isfinite(v) THEN v END', 'v')} FROM (SELECT event_id, {_odd} AS v FROM events)")
def finite_or_null(spark, sf):
    v = F.when(F.col("value") < 2, float("inf")).when(F.col("value") < 4, float("nan")).otherwise(F.col("value"))
    df = table(spark, sf, "events", ["event_id", "value"]).select("event_id", v.alias("v"))
    return out(sel.normalise_missing(df, ["v"]), ["event_id"], ["v"])


_complete = " AND ".join(f"{n} IS NOT NULL" for n in MACRO_SOURCE)


@register("complete_cases", f"WITH {MARKET} SELECT day, {', '.join(q6(n, n) for n in MACRO_SOURCE)} FROM market WHERE {_complete}")
def complete_cases(spark, sf):
    return out(sel.complete_cases(daily_market(spark, sf).df, list(MACRO_SOURCE)), ["day"], list(MACRO_SOURCE))


@register("rename_cols", f"SELECT user_id AS series_id, event_id AS tie, {q6('value', 'x')} FROM events")
def rename_cols(spark, sf):
    df = table(spark, sf, "events", ["user_id", "event_id", "value"])
    return out(sel.rename_cols(df, {"user_id": "series_id", "event_id": "tie", "value": "x"}), ["series_id", "tie"], ["x"])


@register("add_intercept", f"SELECT event_id, {q6('value', 'value')}, 1e0 AS x_0 FROM events")
def add_intercept(spark, sf):
    return out(sel.add_intercept(table(spark, sf, "events", ["event_id", "value"])), ["event_id"], ["value", "x_0"])


@register("scale_const", f"SELECT event_id, {q6('value / 100e0', 'down')}, {q6('value * 100e0', 'up')} FROM events")
def scale_const(spark, sf):
    df = table(spark, sf, "events", ["event_id", "value"])
    return df.select("event_id", r6(S.scale_const("value", 0.01)).alias("down"), r6(S.scale_const("value", 100)).alias("up"))


@register("cast_numeric", f"""SELECT event_id, {q6("try_cast(json_extract_string(props, '$.k') AS double)", 'k')},
  {q6("try_cast(event_type AS double)", 'word')} FROM events""")
def cast_numeric(spark, sf):
    df = table(spark, sf, "events", ["event_id", "event_type", "props"])
    return df.select("event_id", r6(S.cast_numeric(F.get_json_object("props", "$.k"))).alias("k"), r6(S.cast_numeric("event_type")).alias("word"))


@register("threshold_filter", f"WITH {SCORED} SELECT user_id, event_id, {q6('p', 'p')}, 'up' AS regime FROM scored WHERE p > 0.8 "
          f"UNION ALL SELECT user_id, event_id, {q6('p', 'p')}, 'down' FROM scored WHERE p < 1e0 - 0.8e0 "
          f"UNION ALL SELECT user_id, event_id, {q6('p', 'p')}, 'middle' FROM scored WHERE p BETWEEN 1e0 - 0.8e0 AND 0.8")
def threshold_filter(spark, sf):
    scored = scored_events(spark, sf).df
    parts = [sel.threshold_filter(scored, "p", 0.8, kind).withColumn("regime", F.lit(kind)) for kind in ("up", "down", "middle")]
    return out(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["user_id", "event_id", "regime"], ["p"])


@register("extreme_filter", f"WITH {SCORED} SELECT user_id, event_id, {q6('p', 'p')} FROM scored WHERE p > 1e0 - 0.2e0 OR p < 0.2e0")
def extreme_filter(spark, sf):
    return out(sel.extreme_filter(scored_events(spark, sf).df, "p", 0.2), ["user_id", "event_id"], ["p"])


@register("binary_flag", f"WITH {EV} SELECT user_id, event_id, cast(CASE WHEN x - prev > 0 THEN 1 WHEN x - prev <= 0 THEN 0 END AS bigint) AS flag FROM ev")
def binary_flag(spark, sf):
    from tidemark.functions.rolling import diff_1

    df = panel_events(spark, sf).roll({"d": diff_1("x")}).df
    return df.select("user_id", "event_id", S.binary_flag("d").cast("long").alias("flag"))


@register("any_null", f"WITH {MARKET} SELECT bool_or({' OR '.join(f'{n} IS NULL' for n in MACRO_SOURCE)}) AS has_null FROM market")
def any_null(spark, sf):
    return sel.any_null(daily_market(spark, sf).df, list(MACRO_SOURCE))


@register("series_bounds", "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY user_id")
def series_bounds(spark, sf):
    return sel.series_bounds(table(spark, sf, "events", ["user_id", "ts"]), ["user_id"], "ts")


@register("time_order", f"SELECT event_id, ts, {q6('value', 'value')} FROM events ORDER BY ts, event_id")
def time_order(spark, sf):
    return out(sel.time_order(table(spark, sf, "events", ["event_id", "ts", "value"]), ["ts", "event_id"]), ["event_id", "ts"], ["value"])


def _split_sql(shares: list[tuple[str, float]]) -> str:
    cases = " ".join(f"WHEN rn <= round_even(n * {s}::double, 0) THEN '{label}'" for label, s in shares)
    return f"WITH {EV} SELECT user_id, event_id, CASE {cases} ELSE 'test' END AS split FROM ev"


@register("chrono_split", _split_sql([("train", 0.3)]))
def chrono_split(spark, sf):
    return sel.chrono_split(panel_events(spark, sf), {"train": 0.3}).df.select("user_id", "event_id", "split")


@register("three_way_split", _split_sql([("setup", 0.1), ("train", 0.5)]))
def three_way_split(spark, sf):
    return sel.chrono_split(panel_events(spark, sf), {"setup": 0.1, "train": 0.5}).df.select("user_id", "event_id", "split")


# -- scalar functions --------------------------------------------------------------------------


@register("sigmoid", f"SELECT event_id, {q6('1e0 / (1e0 + exp(-(value - 50e0)))', 'o')} FROM events")
def sigmoid(spark, sf):
    return table(spark, sf, "events", ["event_id", "value"]).select("event_id", r6(S.sigmoid(F.col("value") - 50.0)).alias("o"))


@register("sigmoid_grad", f"WITH {SCORED} SELECT user_id, event_id, {q6('p * (1e0 - p)', 'g')} FROM scored")
def sigmoid_grad(spark, sf):
    return scored_events(spark, sf).df.select("user_id", "event_id", r6(S.sigmoid_grad("p")).alias("g"))


@register("log_exp_abs_pow", f"""WITH {EV} SELECT user_id, event_id, {q6('CASE WHEN x > 0 THEN ln(x) END', 'ln_x')},
  {q6('exp(-x / 100e0)', 'exp_x')}, {q6('abs(x - prev)', 'abs_d')}, {q6('(x - prev) * (x - prev)', 'sq_d')} FROM ev""")
def log_exp_abs_pow(spark, sf):
    from tidemark.functions.rolling import diff_1

    df = panel_events(spark, sf).roll({"d": diff_1("x")}).df
    values = {"ln_x": S.safe_ln("x"), "exp_x": F.exp(-F.col("x") / 100.0), "abs_d": F.abs("d"), "sq_d": F.col("d") * F.col("d")}
    return df.select("user_id", "event_id", *(r6(c).alias(n) for n, c in values.items()))


@register("round_even", f"SELECT event_id, {q6('round_even(event_id / 2e0, 0)', 'half')}, {q6('round_even(value, 0)', 'whole')} FROM events")
def round_even(spark, sf):
    df = table(spark, sf, "events", ["event_id", "value"])
    return df.select("event_id", r6(S.round_even(F.col("event_id") / 2.0)).alias("half"), r6(S.round_even("value")).alias("whole"))


@register("is_null_finite", f"""WITH {MARKET} SELECT day, gold IS NULL AS missing, gold IS NOT NULL AND isfinite(gold) AS usable FROM market""")
def is_null_finite(spark, sf):
    df = daily_market(spark, sf).df
    return df.select("day", F.col("gold").isNull().alias("missing"), S.finite_or_null("gold").isNotNull().alias("usable"))


@register("bin_label", f"""WITH {SCORED} SELECT user_id, event_id, bin,
  concat(cast(cast((bin - 1) AS decimal(9,0)) / 20 AS decimal(4,2))::varchar, ' to ', cast(cast(bin AS decimal(9,0)) / 20 AS decimal(4,2))::varchar) AS label
  FROM (SELECT *, cast(greatest(1, ceil(p * 20)) AS bigint) AS bin FROM scored)""")
def bin_label(spark, sf):
    bin_ = S.bin_index("p", 20)
    return scored_events(spark, sf).df.select("user_id", "event_id", bin_.cast("long").alias("bin"), S.bin_label(bin_, 20).alias("label"))


@register("hit_flag", f"WITH {SCORED} SELECT user_id, event_id, cast((p < 0.5 AND y < 0.5) OR (p >= 0.5 AND y >= 0.5) AS bigint) AS hit FROM scored")
def hit_flag(spark, sf):
    return scored_events(spark, sf).df.select("user_id", "event_id", S.hit_flag("p", "y").cast("long").alias("hit"))


@register("predicted_class", f"WITH {SCORED} SELECT user_id, event_id, cast(CASE WHEN p < 0.5 THEN 0 ELSE 1 END AS bigint) AS guess FROM scored")
def predicted_class(spark, sf):
    return scored_events(spark, sf).df.select("user_id", "event_id", S.predicted_class("p").cast("long").alias("guess"))


@register("residual", f"WITH {SCORED} SELECT user_id, event_id, {q6('y - p', 'd')}, {q6('p - y', 'd_test')} FROM scored")
def residual(spark, sf):
    return scored_events(spark, sf).df.select("user_id", "event_id", r6(S.residual("y", "p")).alias("d"), r6(S.residual("y", "p", "p-y")).alias("d_test"))


@register("squared_error", f"WITH {SCORED} SELECT user_id, event_id, {q6('0.5e0 * (y - p) * (y - p)', 'half_sq')} FROM scored")
def squared_error(spark, sf):
    return scored_events(spark, sf).df.select("user_id", "event_id", r6(S.squared_error(S.residual("y", "p"))).alias("half_sq"))


@register("seq_dates", """SELECT user_id, cast(unnest(generate_series(cast(min(ts) AS date)::timestamp, cast(max(ts) AS date)::timestamp, INTERVAL 1 DAY)) AS date) AS day
  FROM events GROUP BY user_id""")
def seq_dates(spark, sf):
    from tidemark.operators.alignment import calendar_days

    df = table(spark, sf, "events", ["user_id", "ts"]).withColumn("day", F.col("ts").cast("date"))
    return calendar_days(df, ["user_id"], "day")


@register("indexed_name", f"WITH {DESIGN} SELECT user_id, event_id, 'w' || src AS name, {q6('v', 'v')} FROM ("
          + " UNION ALL ".join(f"SELECT user_id, event_id, {j} AS src, {f} AS v FROM rows" for j, f in enumerate(FEATURES)) + ")")
def indexed_name(spark, sf):
    df = design_events(spark, sf).df
    long = df.select("user_id", "event_id", F.posexplode(F.array(*FEATURES)).alias("src", "v"))
    return long.select("user_id", "event_id", S.indexed_name("w", "src").alias("name"), r6("v").alias("v"))


@register("read_series", f"""SELECT o_orderkey, cast(o_orderdate AS date) AS day, {q6('CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END', 'price')},
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS status FROM orders""")
def read_series(spark, sf):
    """All orders written as delimited text, with two-digit years, ``.`` for a missing price and blanks for a missing status, and read again."""
    from tidemark.session import shared_path
    from tidemark.sources.series_csv import parse_day, read_series

    orders = table(spark, sf, "orders", ["o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus"])
    price = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice").cast("string")).otherwise(".")
    status = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).otherwise("  ")
    path = shared_path(spark, "delimited")
    orders.select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yy").alias("day"), price.alias("price"), status.alias("status")).write.csv(
        path, sep=";", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    back = read_series(spark, path, "o_orderkey long, day string, price double, status string", sep=";", null_value=".")
    return back.select("o_orderkey", parse_day("day").alias("day"), r6("price").alias("price"), "status")


# -- files of two generations --------------------------------------------------------------------

# A price is missing, unreadable or fine; a newer file has a day that is none now and then.
_PRICE = "CASE WHEN o_orderkey % 7 = 0 THEN '.' WHEN o_orderkey % 11 = 0 THEN 'n/k' ELSE 'fine' END"
_ODD_DAY = "(o_orderkey % 2 = 1 AND o_orderkey % 13 = 0)"


def two_generations(spark, sf):
    """All orders in files of two kinds: the newer ones have other names, another order of columns, a further column and no status."""
    from tidemark.session import shared_path
    from tidemark.sources.ledger import read_ledger

    orders = table(spark, sf, "orders", ["o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus"])
    key = F.col("o_orderkey")
    price = F.when(key % 7 == 0, ".").when(key % 11 == 0, "n/k").otherwise(F.col("o_totalprice").cast("string"))
    older = orders.filter(key % 2 == 0).select("o_orderkey", F.date_format("o_orderdate", "dd.MM.yy").alias("day"), price.alias("price"), F.col("o_orderstatus").alias("status"))
    day = F.when(key % 13 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    newer = orders.filter(key % 2 == 1).select(price.alias("price_usd"), key.alias("order"), F.lit("x").alias("note"), day.alias("day"))
    paths = [shared_path(spark, "delimited") for _ in range(2)]
    older.write.csv(paths[0], sep=";", header=True)
    newer.write.csv(paths[1], sep=";", header=True)
    schema = "o_orderkey long, day date, price double, status string"
    fields = spark.createDataFrame([], schema).schema
    return read_ledger(spark, paths, fields, {"o_orderkey": ["order"], "price": ["price_usd"]}, sep=";")


@register("read_series_ledger", f"""SELECT o_orderkey, CASE WHEN NOT {_ODD_DAY} THEN cast(o_orderdate AS date) END AS day,
  {q6(f"CASE WHEN ({_PRICE}) = 'fine' THEN o_totalprice END", 'price')}, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS status FROM orders""")
def read_series_ledger(spark, sf):
    rows = two_generations(spark, sf).rows
    return rows.select("o_orderkey", "day", r6("price").alias("price"), "status")


@register("read_series_rejected", f"""SELECT 'price' AS "column", 'n/k' AS text, count(*) AS n FROM orders WHERE ({_PRICE}) = 'n/k'
  UNION ALL SELECT 'day', 'soon', count(*) FROM orders WHERE {_ODD_DAY}""")
def read_series_rejected(spark, sf):
    return two_generations(spark, sf).rejected.groupBy("column", "text").agg(F.count(F.lit(1)).alias("n"))


@register("read_series_counts", f"""WITH cells AS (
  SELECT 'o_orderkey' AS "column", 'good' AS kind FROM orders
  UNION ALL SELECT 'day', CASE WHEN {_ODD_DAY} THEN 'bad' ELSE 'good' END FROM orders
  UNION ALL SELECT 'price', CASE ({_PRICE}) WHEN '.' THEN 'gaps' WHEN 'n/k' THEN 'bad' ELSE 'good' END FROM orders
  UNION ALL SELECT 'status', 'good' FROM orders WHERE o_orderkey % 2 = 0)
  SELECT "column", count(*) FILTER (WHERE kind = 'good') AS good, count(*) FILTER (WHERE kind = 'gaps') AS gaps, count(*) FILTER (WHERE kind = 'bad') AS bad
  FROM cells GROUP BY 1""")
def read_series_counts(spark, sf):
    counts = two_generations(spark, sf).counts
    return counts.groupBy("column").agg(*(F.sum(c).alias(c) for c in ("good", "gaps", "bad")))
