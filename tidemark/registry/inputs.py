"""Panels derived from the test tables, in Spark and in SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rolling import label_next_up, log_return, sma_spread

from tidemark.models.scoring import score
from tidemark.models.weights import HIDDEN, OUTPUT, connections
from tidemark.operators.selection import complete_cases
from tidemark.panel import Panel




def table(spark: SparkSession, sf: str, name: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)


# -- events: one series per user --------------------------------------------------------------

EV_KEYS = ["user_id", "event_id"]
EV_WINDOW = "PARTITION BY user_id ORDER BY ts, event_id"
EV = f"""ev AS (
  SELECT user_id, event_id, ts, value AS x, row_number() OVER w AS rn, count(*) OVER (PARTITION BY user_id) AS n,
         lag(value) OVER w AS prev, lead(value) OVER w AS nxt
  FROM events WINDOW w AS ({EV_WINDOW}))"""


def panel_events(spark: SparkSession, sf: str, extra: tuple[str, ...] = (), **options) -> Panel:
    df = table(spark, sf, "events", ["user_id", "ts", "event_id", "value", *extra])
    return Panel(df.withColumnRenamed("value", "x"), "user_id", "ts", "event_id", **options)


# -- orders: one daily market series with five macro columns, some of them with gaps ----------

MACRO_SOURCE = {"risk": "1-URGENT", "gold": "2-HIGH", "vix": "3-MEDIUM", "currency": "4-NOT SPECIFIED", "rf": "5-LOW"}

_avg = "cast(sum(cast(o_totalprice AS decimal(18,2))) {f} AS double) / count(*) {f}"
MARKET = """market AS (
  SELECT 'market' AS series, cast(o_orderdate AS date) AS day, {x} AS x,
         {macro}
  FROM orders GROUP BY ALL)""".format(
    x=_avg.format(f=""),
    macro=",\n         ".join(
        "CASE WHEN count(*) FILTER ({w}) > 0 THEN {a} END AS {n}".format(
            w=f"WHERE o_orderpriority = '{v}'", a=_avg.format(f=f"FILTER (WHERE o_orderpriority = '{v}')"), n=n
        )
        for n, v in MACRO_SOURCE.items()
    ),
)


def _exact_mean(column) -> object:
    return F.sum(column.cast("decimal(18,2)")).cast("double") / F.count(column)


def daily_market(spark: SparkSession, sf: str, **options) -> Panel:
    orders = table(spark, sf, "orders", ["o_orderdate", "o_totalprice", "o_orderpriority"])
    price = F.col("o_totalprice")
    macro = {n: F.when(F.col("o_orderpriority") == v, price) for n, v in MACRO_SOURCE.items()}
    df = (
        orders.groupBy(F.lit("market").alias("series"), F.col("o_orderdate").cast("date").alias("day"))
        .agg(
            _exact_mean(price).alias("x"),
            *(F.when(F.count(c) > 0, F.try_divide(F.sum(c.cast("decimal(18,2)")).cast("double"), F.count(c))).alias(n) for n, c in macro.items()),
        )
    )
    return Panel(df, "series", "day", **options)


# -- orders by nation: 25 daily series ---------------------------------------------------------

NATION = """nat AS (
  SELECT c_nationkey AS nation, cast(o_orderdate AS date) AS day,
         cast(sum(cast(o_totalprice AS decimal(18,2))) AS double) / count(*) AS x, count(*) AS orders
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def nation_days(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])
    customers = table(spark, sf, "customer", ["c_custkey", "c_nationkey"])
    return (
        orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("nation"), F.col("o_orderdate").cast("date").alias("day"))
        .agg(_exact_mean(F.col("o_totalprice")).alias("x"), F.count(F.lit(1)).alias("orders"))
    )


# -- scored events: four features, fixed weights -----------------------------------------------

FEATURES = ["x_0", "x_1", "x_2", "x_3"]


def plr_weight(j: int) -> float:
    return 2.0 * math.cos(j + 1.0)


def mlp_weight(layer: str, src: int, dst: int) -> float:
    return 2.0 * math.cos(src + 3.0 * dst) if layer == HIDDEN else 2.0 * math.cos(1.0 + 2.0 * src)


PLR_NET = {(OUTPUT, j, 0): plr_weight(j) for j in range(4)}
MLP_NEURONS = 3
MLP_NET = {c: mlp_weight(*c) for c in connections(4, MLP_NEURONS)}


def sma_sql(n: int, x: str = "x", window: str = EV_WINDOW) -> str:
    frame = f"OVER ({window} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} = {n} THEN avg({x}) {frame} END"


def ln_sql(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN ln({x}) END)"


DESIGN = f"""{EV}, feat AS (
  SELECT *, {sma_sql(5)} AS s5, {sma_sql(10)} AS s10 FROM ev), design AS (
  SELECT user_id, event_id, ts, x, (x - prev) / nullif(prev, 0) AS change, (nxt - x) / nullif(x, 0) AS next_change,
         1e0 AS x_0, x / 100e0 AS x_1, {ln_sql('x')} - {ln_sql('prev')} AS x_2,
         (s5 - s10) / 50e0 AS x_3, CASE WHEN nxt > x THEN 1e0 WHEN nxt <= x THEN 0e0 END AS y
  FROM feat), rows AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos,
         count(*) OVER (PARTITION BY user_id) AS len
  FROM design WHERE x_2 IS NOT NULL AND x_3 IS NOT NULL AND y IS NOT NULL)"""


def z_sql(weights: list[float]) -> str:
    return " + ".join(f"{name} * ({w!r}::double)" for name, w in zip(FEATURES, weights))


def sigmoid_sql(z: str) -> str:
    return f"(1e0 / (1e0 + exp(-({z}))))"


SCORED = f"{DESIGN}, scored AS (SELECT *, {sigmoid_sql(z_sql([plr_weight(j) for j in range(4)]))} AS p FROM rows)"

MLP_SQL = sigmoid_sql(
    f"({MLP_NET[OUTPUT, 0, 0]!r}::double) + "
    + " + ".join(
        f"({MLP_NET[OUTPUT, n, 0]!r}::double) * {sigmoid_sql(z_sql([MLP_NET[HIDDEN, j, n] for j in range(4)]))}"
        for n in range(1, MLP_NEURONS + 1)
    )
)
MLP_SCORED = f"{DESIGN}, scored AS (SELECT *, {MLP_SQL} AS p FROM rows)"


def design_events(spark: SparkSession, sf: str, **options) -> Panel:
    """Events with four features and a label; complete rows."""
    from tidemark.functions.rolling import forward_change, pct_change

    panel = panel_events(spark, sf, **options).roll(
        {
            "x_2": log_return("x", 1, 1.0),
            "spread": sma_spread("x"),
            "y": label_next_up("x"),
            "change": pct_change("x"),
            "next_change": forward_change("x"),
        }
    )
    df = panel.df.withColumns({"x_0": F.lit(1.0), "x_1": F.col("x") / 100.0, "x_3": F.col("spread") / 50.0}).drop("spread")
    return panel.replace(complete_cases(df, [*FEATURES, "y"]), same_rows=False)


def scored_events(spark: SparkSession, sf: str, **options) -> Panel:
    panel = design_events(spark, sf, **options)
    return panel.replace(score(panel.df, FEATURES, PLR_NET))
