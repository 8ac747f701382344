"""Window functions, recurrences and scaling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tidemark.functions import rolling as R
from tidemark.operators import resume, running, scaling, selection, smoothing
from tidemark.operators.smoothing import Smoothing
from tidemark.registry.core import SQL, out, q6, r6, register
from tidemark.registry.inputs import EV, EV_KEYS, EV_WINDOW, MARKET, SCORED, daily_market, ln_sql, panel_events, scored_events, sma_sql
from tidemark.session import shared_path
from tidemark.sources.store import PanelStore

W = f"OVER ({EV_WINDOW})"


def from_ev(*columns: str, more: str = "") -> str:
    return f"WITH {EV}{more} SELECT user_id, event_id, {', '.join(columns)} FROM {'feat' if more else 'ev'}"


def feat(*columns: str) -> str:
    return f", feat AS (SELECT *, {', '.join(columns)} FROM ev)"


def rolled(name: str, sql: str, make: Callable[[], dict[str, R.Rolling]]) -> None:
    """Register a query that adds indicators to the event panel. They are made when a session exists."""

    @register(name, sql)
    def query(spark, sf):
        indicators = make()
        return out(panel_events(spark, sf).roll(indicators).df, EV_KEYS, list(indicators))


WMA_SQL = "(" + " + ".join(f"{10 - i} * {f'lag(x, {i}) {W}' if i else 'x'}" for i in range(10)) + ") / 55e0"
CCI_MEAN = sma_sql(15)
CCI_PARTS = ", ".join(f"lag(x, {i}) {W} AS l{i}" for i in range(1, 15))
CCI_LAGS = ["x"] + [f"l{i}" for i in range(1, 15)]
CCI_SQL = (
    f"CASE WHEN greatest({', '.join(CCI_LAGS)}) > least({', '.join(CCI_LAGS)}) THEN (x - m) / nullif(0.015e0 * ("
    + " + ".join(f"abs({c} - m)" for c in CCI_LAGS)
    + ") / 15e0, 0) END"
)
SIGNAL_SQL = "CASE WHEN s5 - s10 > 1e-12 * abs(s10) THEN 1 WHEN s5 - s10 <= 1e-12 * abs(s10) THEN 0 END"
LABEL_SQL = "CASE WHEN nxt > x THEN 1 WHEN nxt <= x THEN 0 END"

rolled("lag_k", from_ev(q6("prev", "lag_1"), q6(f"lag(x, 3) {W}", "lag_3")), lambda: dict(lag_1=R.lag_k("x"), lag_3=R.lag_k("x", 3)))
rolled("merge_self_lag", from_ev(q6("x", "now"), q6("prev", "before")), lambda: dict(now=R.value("x"), before=R.lag_k("x")))
rolled("diff_1", from_ev(q6("x - prev", "d")), lambda: dict(d=R.diff_1("x")))
rolled("pct_change", from_ev(q6("(x - prev) / nullif(prev, 0)", "pct")), lambda: dict(pct=R.pct_change("x")))
rolled("log_return", from_ev(q6(f"100e0 * ({ln_sql('x')} - {ln_sql('prev')})", "ret")), lambda: dict(ret=R.log_return("x")))
rolled("roc_n", from_ev(q6(f"{ln_sql('x')} - {ln_sql('l5')}", "roc"), more=feat(f"lag(x, 5) {W} AS l5")), lambda: dict(roc=R.roc_n("x", 5)))
rolled("sma_n", from_ev(q6(sma_sql(5), "sma_5"), q6(sma_sql(10), "sma_10")), lambda: dict(sma_5=R.sma_n("x", 5), sma_10=R.sma_n("x", 10)))
rolled("wma_n", from_ev(q6(WMA_SQL, "wma_10")), lambda: dict(wma_10=R.wma_n("x", 10)))
rolled("label_next_up", from_ev(q6(LABEL_SQL, "up")), lambda: dict(up=R.label_next_up("x")))
rolled("sma_spread", from_ev(q6("s5 - s10", "spread"), more=feat(f"{sma_sql(5)} AS s5", f"{sma_sql(10)} AS s10")), lambda: dict(spread=R.sma_spread("x")))
rolled("sma_signal", from_ev(q6(SIGNAL_SQL, "signal"), more=feat(f"{sma_sql(5)} AS s5", f"{sma_sql(10)} AS s10")), lambda: dict(signal=R.sma_signal("x")))
rolled("cci_n", from_ev(q6(CCI_SQL, "cci"), more=feat(f"{CCI_MEAN} AS m", CCI_PARTS)), lambda: dict(cci=R.cci_n("x", 15)))

CUM = f"{W[:-1]} ROWS UNBOUNDED PRECEDING)"


# Whole numbers make the sums exact, whatever the order of addition.
@register("cum_sum", f"""WITH {MARKET}, whole AS (SELECT series, day, round(x, 0) AS x, round(gold, 0) AS gold FROM market)
  SELECT day, {q6('sum(x) OVER w', 'total')}, {q6('sum(gold) OVER w', 'skipped')},
  {q6('CASE WHEN count(*) OVER w = count(gold) OVER w THEN sum(gold) OVER w END', 'propagated')}
  FROM whole WINDOW w AS (PARTITION BY series ORDER BY day ROWS UNBOUNDED PRECEDING)""")
def cum_sum(spark, sf):
    panel = daily_market(spark, sf)
    panel = panel.replace(panel.df.select("series", "day", F.round("x", 0).alias("x"), F.round("gold", 0).alias("gold")))
    panel = running.cum_sum(panel, {"total": "x", "propagated": "gold"})
    return out(running.cum_sum(panel, {"skipped": "gold"}, na="skip").df, ["day"], ["total", "skipped", "propagated"])


@register("cum_abs_error", f"WITH {SCORED} SELECT user_id, event_id, {q6(f'sum(abs(y - p)) {CUM}', 'cum_abs')} FROM scored")
def cum_abs_error(spark, sf):
    return out(running.cum_abs_error(scored_events(spark, sf), "cum_abs", F.col("y") - F.col("p")).df, EV_KEYS, ["cum_abs"])


# -- recurrences -------------------------------------------------------------------------------


def smoothed_sql(name: str, source: str, x: str, n: int, alpha: str, first: int = 1, key: str = "user_id") -> str:
    """CTE ``name(key, rn, y)``: the serial recurrence over ``source`` from row ``first``."""
    return f"""{name} AS (
  SELECT {key}, {first + n - 1} AS rn, avg({x}) AS y FROM {source} WHERE rn BETWEEN {first} AND {first + n - 1}
  GROUP BY {key} HAVING count({x}) = {n}
  UNION ALL
  SELECT e.{key}, e.rn + 1, ({alpha}) * s.{x} + (1e0 - ({alpha})) * e.y FROM {name} e
  JOIN {source} s ON s.{key} = e.{key} AND s.rn = e.rn + 1)"""


MOVES = "moves AS (SELECT user_id, rn, greatest(x - prev, 0) AS gain, greatest(prev - x, 0) AS loss FROM ev)"
RSI_CTE = ", ".join([MOVES, smoothed_sql("up", "moves", "gain", 15, "1e0/15e0", 2), smoothed_sql("dn", "moves", "loss", 15, "1e0/15e0", 2)])
MACD_CTE = ", ".join([smoothed_sql("fast", "ev", "x", 12, "2e0/13e0"), smoothed_sql("slow", "ev", "x", 26, "2e0/27e0"),
                      "macd AS (SELECT user_id, rn, 100e0 * (fast.y / nullif(slow.y, 0) - 1) AS m FROM fast JOIN slow USING (user_id, rn))"])
RSI_SQL = "100e0 * up.y / nullif(up.y + dn.y, 0)"
EMA_SQL = f"WITH RECURSIVE {EV}, {smoothed_sql('e', 'ev', 'x', 12, '2e0/13e0')} SELECT user_id, event_id, {q6('y', 'ema')} FROM ev LEFT JOIN e USING (user_id, rn)"


@register("ema_n", EMA_SQL)
def ema_n(spark, sf):
    return out(smoothing.ema_n(panel_events(spark, sf), "ema", "x", 12).df, EV_KEYS, ["ema"])


@register("wilder_n", f"WITH RECURSIVE {EV}, {smoothed_sql('e', 'ev', 'x', 15, '1e0/15e0')} SELECT user_id, event_id, {q6('y', 'wilder')} FROM ev LEFT JOIN e USING (user_id, rn)")
def wilder_n(spark, sf):
    return out(smoothing.wilder_n(panel_events(spark, sf), "wilder", "x", 15).df, EV_KEYS, ["wilder"])


@register("rsi_n", f"WITH RECURSIVE {EV}, {RSI_CTE} SELECT ev.user_id, event_id, {q6(RSI_SQL, 'rsi')}, {q6(RSI_SQL + ' / 100e0', 'rsi_scaled')} "
          "FROM ev LEFT JOIN up USING (user_id, rn) LEFT JOIN dn USING (user_id, rn)")
def rsi_n(spark, sf):
    df = smoothing.rsi_n(panel_events(spark, sf), "rsi", "x", 15).df
    return out(df.withColumn("rsi_scaled", F.col("rsi") / 100.0), EV_KEYS, ["rsi", "rsi_scaled"])


@register("macd", f"WITH RECURSIVE {EV}, {MACD_CTE} SELECT user_id, event_id, {q6('m', 'macd')} FROM ev LEFT JOIN macd USING (user_id, rn)")
def macd(spark, sf):
    return out(smoothing.macd(panel_events(spark, sf), "macd", "x").df, EV_KEYS, ["macd"])


SIGNAL_LINE_SQL = (f"WITH RECURSIVE {EV}, {MACD_CTE}, {smoothed_sql('sig', 'macd', 'm', 9, '0.2e0', 26)} "
                   f"SELECT user_id, event_id, {q6('y', 'signal')} FROM ev LEFT JOIN sig USING (user_id, rn)")


@register("macd_signal", SIGNAL_LINE_SQL)
def macd_signal(spark, sf):
    return out(smoothing.macd_signal(panel_events(spark, sf), "signal", "x").df, EV_KEYS, ["signal"])


# -- scaling -----------------------------------------------------------------------------------

SCALE = f"(x - min(x) {{o}}) / nullif(max(x) {{o}} - min(x) {{o}}, 0)"
OVER_USER = "OVER (PARTITION BY user_id)"
TRAIN = "FILTER (WHERE rn <= round_even(n * 0.3::double, 0)) OVER (PARTITION BY user_id)"


@register("minmax_scale", from_ev(q6(SCALE.format(o=OVER_USER), "scaled"), q6(SCALE.format(o=TRAIN), "scaled_on_train")))
def minmax_scale(spark, sf):
    panel = selection.chrono_split(panel_events(spark, sf), {"train": 0.3})
    panel = scaling.minmax_scale(panel, {"scaled_on_train": "x"}, fit_on=F.col("split") == "train")
    return out(scaling.minmax_scale(panel, {"scaled": "x"}).df, EV_KEYS, ["scaled", "scaled_on_train"])


@register("broadcast_params", from_ev(q6(f"min(x) {OVER_USER}", "lo"), q6(f"max(x) {OVER_USER}", "hi")))
def broadcast_params(spark, sf):
    return out(scaling.broadcast_params(panel_events(spark, sf), {"lo": F.min("x"), "hi": F.max("x")}).df, EV_KEYS, ["lo", "hi"])


# -- the same operators with the plan for a series too long for one task -----------------------

LONG = {"max_series_rows": 40, "segment_rows": 25}


@register("rolling_long", from_ev(q6("s10", "sma_10"), q6(WMA_SQL, "wma_10"), q6(CCI_SQL, "cci"), q6(LABEL_SQL, "up"),
          more=feat(f"{sma_sql(10)} AS s10", f"{CCI_MEAN} AS m", CCI_PARTS)))
def rolling_long(spark, sf):
    indicators = {"sma_10": R.sma_n("x", 10), "wma_10": R.wma_n("x", 10), "cci": R.cci_n("x"), "up": R.label_next_up("x")}
    return out(panel_events(spark, sf, **LONG).roll(indicators).df, EV_KEYS, list(indicators))


@register("cum_sum_long", from_ev(q6(f"sum(x) {CUM}", "total")))
def cum_sum_long(spark, sf):
    return out(running.cum_sum(panel_events(spark, sf, **LONG), {"total": "x"}).df, EV_KEYS, ["total"])


@register("macd_signal_long", SIGNAL_LINE_SQL)
def macd_signal_long(spark, sf):
    return out(smoothing.macd_signal(panel_events(spark, sf, **LONG), "signal", "x").df, EV_KEYS, ["signal"])


@register("ema_spans", f"""WITH RECURSIVE {MARKET}, src AS (SELECT series, day, x, row_number() OVER (PARTITION BY series ORDER BY day) AS rn FROM market),
  {smoothed_sql('e', 'src', 'x', 12, '2e0/13e0', key='series')}, {smoothed_sql('v', 'src', 'x', 15, '1e0/15e0', key='series')}
  SELECT src.day, {q6('e.y / 1000', 'ema')}, {q6('v.y / 1000', 'wilder')} FROM src LEFT JOIN e USING (series, rn) LEFT JOIN v USING (series, rn)""")
def ema_spans(spark, sf):
    """One series of some thousand rows, restarted every 128 rows."""
    wanted = {"ema": Smoothing("x", 12), "wilder": Smoothing("x", 15, "wilder")}
    df = smoothing.smooth(daily_market(spark, sf), wanted, span=128).df
    return df.select("day", *(r6(F.col(c) / 1000).alias(c) for c in wanted))


@register("macd_signal_spans", f"""WITH RECURSIVE {MARKET}, src AS (SELECT series, day, x, row_number() OVER (PARTITION BY series ORDER BY day) AS rn FROM market),
  {smoothed_sql('fast', 'src', 'x', 12, '2e0/13e0', key='series')}, {smoothed_sql('slow', 'src', 'x', 26, '2e0/27e0', key='series')},
  macd AS (SELECT series, rn, 100e0 * (fast.y / nullif(slow.y, 0) - 1) AS m FROM fast JOIN slow USING (series, rn)),
  {smoothed_sql('sig', 'macd', 'm', 9, '0.2e0', 26, key='series')}
  SELECT src.day, {q6('m', 'macd')}, {q6('y', 'signal')} FROM src LEFT JOIN macd USING (series, rn) LEFT JOIN sig USING (series, rn)""")
def macd_signal_spans(spark, sf):
    """One series of some thousand rows, longer than a span of the signal line."""
    df = smoothing.momentum_indicators(daily_market(spark, sf), "x", macd="macd", signal="signal").df
    return out(df, ["day"], ["macd", "signal"])


@register("chrono_split_long", f"WITH {EV} SELECT user_id, event_id, CASE WHEN rn <= round_even(n * 0.3::double, 0) THEN 'train' ELSE 'test' END AS split FROM ev")
def chrono_split_long(spark, sf):
    return selection.chrono_split(panel_events(spark, sf, **LONG), {"train": 0.3}).df.select(*EV_KEYS, "split")


# -- from a store ------------------------------------------------------------------------------


def stored_events(spark, sf, **options):
    """Events in a store, in ranges that cut every user's rows."""
    return PanelStore.create(panel_events(spark, sf), shared_path(spark, "store"), range_rows=1000)


@register("rolling_from_store", SQL["rolling_long"])
def rolling_from_store(spark, sf):
    indicators = {"sma_10": R.sma_n("x", 10), "wma_10": R.wma_n("x", 10), "cci": R.cci_n("x"), "up": R.label_next_up("x")}
    return out(stored_events(spark, sf).panel(["x"], **LONG).roll(indicators).df, EV_KEYS, list(indicators))


@register("macd_from_store", SQL["macd"])
def macd_from_store(spark, sf):
    return out(smoothing.macd(stored_events(spark, sf).panel(["x"], **LONG), "macd", "x").df, EV_KEYS, ["macd"])


@register("macd_signal_from_store", SIGNAL_LINE_SQL)
def macd_signal_from_store(spark, sf):
    return out(smoothing.macd_signal(stored_events(spark, sf).panel(["x"], **LONG), "signal", "x").df, EV_KEYS, ["signal"])


def halves(spark, sf):
    """A store that gets the older and then the newer half of the time span."""
    panel = panel_events(spark, sf)
    span = panel.df.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    cut = span["a"] + (span["b"] - span["a"]) / 2
    store = PanelStore.create(panel.replace(panel.df.filter(F.col("ts") < cut), same_rows=False), shared_path(spark, "store"), range_rows=1000)
    store.append(panel.df.filter(F.col("ts") >= cut), range_rows=1000)
    return store


def appended(store, resumed):
    """The older rows, then the newer ones from the stored state of the older; neither reads the other's files."""
    older, state = resumed(store.panel(["x"], batch=0), None)
    path = shared_path(store.spark, "state")
    state.write.parquet(path)
    newer, _ = resumed(store.panel(["x"], batch=1), store.spark.read.parquet(path))
    return older.df.unionByName(newer.df)


@register("ema_append", SQL["ema_n"])
def ema_append(spark, sf):
    df = appended(halves(spark, sf), lambda panel, state: resume.ema_append(panel, "ema", "x", 12, state))
    return out(df, EV_KEYS, ["ema"])


@register("rsi_append", SQL["rsi_n"])
def rsi_append(spark, sf):
    df = appended(halves(spark, sf), lambda panel, state: resume.rsi_append(panel, "rsi", "x", 15, state))
    return out(df.withColumn("rsi_scaled", F.col("rsi") / 100.0), EV_KEYS, ["rsi", "rsi_scaled"])


@register("macd_append", SQL["macd_signal"])
def macd_append(spark, sf):
    df = appended(halves(spark, sf), lambda panel, state: resume.macd_append(panel, "macd", "x", signal="signal", state=state))
    return out(df, EV_KEYS, ["signal"])
