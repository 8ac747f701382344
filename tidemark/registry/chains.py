"""Feature tables and evaluation, end to end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.panel import Panel
from tidemark.plans import evaluate, features
from tidemark.registry.core import out, q6, r6, register
from tidemark.registry.inputs import EV, EV_KEYS, EV_WINDOW, FEATURES, MACRO_SOURCE, MARKET, SCORED, daily_market, ln_sql, panel_events, scored_events, sma_sql
from tidemark.registry.reports import REGIME
from tidemark.registry.windows import CCI_MEAN, CCI_PARTS, CCI_SQL, MACD_CTE, RSI_CTE, RSI_SQL, SIGNAL_SQL, WMA_SQL, W

MACRO = dict(zip(features.MACRO, MACRO_SOURCE))

# -- technical features ------------------------------------------------------------------------


def log_change(c: str) -> str:
    return f"100e0 * ({ln_sql(c)} - {ln_sql(f'lag({c}) {W}')})"


TECHNICAL = f"""{MACD_CTE}, {RSI_CTE}, averages AS (
  SELECT *, {WMA_SQL} AS w10, {sma_sql(5)} AS s5, {sma_sql(10)} AS s10, {CCI_MEAN} AS m, lag(x, 5) {W} AS back_5, {CCI_PARTS} FROM ev), tech AS (
  SELECT a.*, {log_change('w10')} AS SP_WMA_10_return, {log_change('s5')} AS SP_SMA_5_return, {log_change('s10')} AS SP_SMA_10_return,
    {ln_sql('x')} - {ln_sql('back_5')} AS Momentum_5, {RSI_SQL} / 100e0 AS RSI_15, macd.m AS MACD, {CCI_SQL.replace(' m)', ' a.m)')} AS CCI_15, {SIGNAL_SQL} AS Signal
  FROM averages a LEFT JOIN macd USING (user_id, rn) LEFT JOIN up USING (user_id, rn) LEFT JOIN dn USING (user_id, rn))"""


@register("technical_features", f"WITH RECURSIVE {EV}, {TECHNICAL} SELECT user_id, event_id, {', '.join(q6(c, c) for c in features.TECHNICAL)} FROM tech")
def technical_features(spark, sf):
    return out(features.technical_features(panel_events(spark, sf), "x").df, EV_KEYS, features.TECHNICAL)


# -- macro features ----------------------------------------------------------------------------


def scaled(c: str, over: str) -> str:
    return f"({c} - min({c}) {over}) / nullif(max({c}) {over} - min({c}) {over}, 0)"


def changes(source: str, window: str, names: dict[str, str]) -> str:
    parts = [f"({c} - lag({c}) OVER ({window})) / nullif(lag({c}) OVER ({window}), 0) AS {name}" for name, c in names.items()]
    return f"SELECT * EXCLUDE ({', '.join(set(names.values()))}), {', '.join(parts)} FROM {source}"


@register("macro_features", f"WITH {MARKET}, ch AS ({changes('market', 'PARTITION BY series ORDER BY day', MACRO)}) "
          f"SELECT day, {', '.join(q6(scaled(c, 'OVER (PARTITION BY series)'), c) for c in MACRO)} FROM ch")
def macro_features(spark, sf):
    return out(features.macro_features(daily_market(spark, sf), MACRO).df, ["day"], list(MACRO))


# -- design table ------------------------------------------------------------------------------

# Macro columns of the event panel: numbers every event carries. The last one is zero at times.
EV_MACRO = {"change_risk": "k1", "change_gold": "x1", "change_VIX": "h1", "change_Currency": "m1", "change_RF_normalized": "k"}
EV_MACRO_SQL = """mac AS (SELECT user_id, event_id, ts, k + 1 AS k1, value + 1 AS x1, hour(ts) + 1e0 AS h1, minute(ts) + 1e0 AS m1, k
  FROM (SELECT *, cast(json_extract_string(props, '$.k') AS double) AS k FROM events))"""


def macro_panel(spark, sf) -> Panel:
    panel = panel_events(spark, sf, extra=("props",))
    k = F.get_json_object("props", "$.k").cast("double")
    columns = {"k1": k + 1, "x1": F.col("x") + 1, "h1": F.hour("ts") + 1.0, "m1": F.minute("ts") + 1.0, "k": k}
    return panel.with_columns(columns).drop("props")


SCALED = [*features.SCALED_TECHNICAL, *EV_MACRO]
PLAIN = ["RSI_15", "Signal"]
DESIGN_COLUMNS = [*features.FEATURES, features.LABEL]


def design_sql() -> str:
    over = "OVER (PARTITION BY user_id)"
    cells = [f"{scaled(c, over)} AS {c}" for c in SCALED] + PLAIN
    complete = " AND ".join(f"{c} IS NOT NULL" for c in [*SCALED, *PLAIN, features.LABEL])
    return f"""{EV}, {TECHNICAL}, {EV_MACRO_SQL}, ch AS ({changes('mac', EV_WINDOW, EV_MACRO)}), wide AS (
  SELECT user_id, event_id, tech.ts, 1e0 AS x_0, {', '.join(cells)}, CASE WHEN nxt > x THEN 1e0 WHEN nxt <= x THEN 0e0 END AS {features.LABEL}
  FROM tech JOIN ch USING (user_id, event_id)), design_table AS (SELECT * FROM wide WHERE {complete})"""


@register("design_table", f"WITH RECURSIVE {design_sql()} SELECT user_id, event_id, {', '.join(q6(c, c) for c in DESIGN_COLUMNS)} FROM design_table")
def design_table(spark, sf):
    return out(features.design_table(macro_panel(spark, sf), "x", EV_MACRO).df, EV_KEYS, DESIGN_COLUMNS)


# -- evaluation --------------------------------------------------------------------------------

CUM = f"{W[:-1]} ROWS UNBOUNDED PRECEDING)"


@register("error_series", f"""WITH {SCORED} SELECT user_id, event_id, {q6('y - p', 'd')}, {q6('0.5e0 * (y - p) * (y - p)', 'half_sq')},
  {q6('change', 'change')}, {q6(f'sum(y - p) {CUM}', 'cum_d')}, {q6(f'sum(abs(y - p)) {CUM}', 'cum_abs_d')},
  {q6(f'sum(cast((p >= 0.5) = (y >= 0.5) AS double)) {CUM}', 'cum_hits')} FROM scored""")
def error_series(spark, sf):
    df = evaluate.error_series(scored_events(spark, sf)).df
    return out(df, EV_KEYS, ["d", "half_sq", "change", "cum_d", "cum_abs_d", "cum_hits"])


REPORT_PARTS = {
    "residuals": ("y - p", 20), "absolute_residuals": ("abs(y - p)", 20), "squared_errors": ("0.5e0 * (y - p) * (y - p)", 20),
    "scores": ("p", 20), "returns": ("change", 100), "returns_by_regime": ("change", 8),
}


def _histogram(part: str, v: str, bins: int) -> str:
    group = REGIME if part == "returns_by_regime" else "''"
    return f"""SELECT '{part}' AS part, b.grp AS grp, cast(b.bin AS varchar) AS cell, cast(coalesce(n, 0) AS bigint) AS n,
    {q6('coalesce(n, 0) / nullif(total * width, 0)', 'value')}
  FROM (SELECT *, (hi - lo) / {bins} AS width FROM (SELECT {group} AS grp, min({v}) AS lo, max({v}) AS hi, count({v}) AS total FROM scored GROUP BY 1)
        CROSS JOIN generate_series(1, {bins}) AS s(bin)) b
  LEFT JOIN (SELECT grp, least({bins}, greatest(1, coalesce(ceil((v - lo) * {bins} / nullif(hi - lo, 0)), 1)))::bigint AS bin, count(*) AS n
             FROM (SELECT {group} AS grp, {v} AS v, min({v}) OVER (PARTITION BY {group}) AS lo, max({v}) OVER (PARTITION BY {group}) AS hi FROM scored)
             WHERE v IS NOT NULL GROUP BY ALL) c ON c.grp = b.grp AND c.bin = b.bin"""


_HIT = "cast((p >= 0.5) = (y >= 0.5) AS double)"
_SUMMARY = {
    "hit_rate": f"avg({_HIT})", "t_stat": f"(avg({_HIT}) - 0.5e0) * sqrt(count(*)) / nullif(stddev_samp({_HIT}), 0)",
    "sse": "sum(0.5e0 * (y - p) * (y - p)) / 1000e0",
}
REPORT_SQL = f"WITH {SCORED} " + " UNION ALL ".join(
    [_histogram(part, *of) for part, of in REPORT_PARTS.items()]
    + [f"""SELECT 'calibration', '', cast(g.bin AS varchar), cast(coalesce(total, 0) AS bigint), {q6('occurences / nullif(total, 0)', 'value')}
  FROM generate_series(1, 20) AS g(bin) LEFT JOIN (SELECT greatest(1, ceil(p * 20)) AS bin, sum(y) AS occurences, count(*) AS total FROM scored GROUP BY 1) c
    ON c.bin = g.bin""",
       f"SELECT 'conditional_returns', {REGIME}, '', count(*), {q6('avg(change)', 'value')} FROM scored WHERE change IS NOT NULL GROUP BY ALL",
       f"SELECT 'hits_by_year', '', cast(cast(year(ts) AS bigint) AS varchar), count(*), {q6(f'avg({_HIT})', 'value')} FROM scored GROUP BY ALL"]
    + [f"SELECT 'summary', '', '{name}', count(*), {q6(v, 'value')} FROM scored" for name, v in _SUMMARY.items()]
)


@register("evaluation_report", REPORT_SQL)
def evaluation_report(spark, sf):
    """Every value of the report's tables, one row for each."""
    report = evaluate.evaluation_report(scored_events(spark, sf))

    def rows(part: str, df: DataFrame, cell, n, value, group=None) -> DataFrame:
        return df.select(
            F.lit(part).alias("part"), F.lit("").alias("grp") if group is None else F.col(group).alias("grp"),
            F.lit("").alias("cell") if cell is None else F.col(cell).cast("string").alias("cell"),
            F.col(n).cast("long").alias("n"), r6(value).alias("value"),
        )

    tables = [
        rows(part, getattr(report, part), "bin", "n", "density", "regime" if part == "returns_by_regime" else None) for part in REPORT_PARTS
    ]
    tables.append(rows("calibration", report.calibration, "bin", "total", "probability"))
    tables.append(rows("conditional_returns", report.conditional_returns, None, "n", "mean_return", "regime"))
    tables.append(rows("hits_by_year", report.hits_by_year, "year", "n", "hit_rate"))
    summary = report.summary.withColumn("sse", F.col("sse") / 1000.0)
    tables += [rows("summary", summary.withColumn("name", F.lit(name)), "name", "n", name) for name in _SUMMARY]
    return reduce(DataFrame.unionByName, tables)


# -- split, search, two stages, score ----------------------------------------------------------

TRIALS, NEURONS, SEARCH_EPOCHS = 3, 2, 2
STAGES = ({"epochs": 2, "momentum": 0.7}, {"epochs": 1, "momentum": 0.0})


def _chain_sql() -> str:
    from tidemark.registry import fits

    lanes = fits.lanes_sql(TRIALS, NEURONS, fits.WEIGHT_SQL, fits.SETTINGS.format(mu="0.7e0", epochs=SEARCH_EPOCHS), "train")
    best = (f"best AS (SELECT user_id, model_id FROM {fits.curve_sql('f')} WHERE epoch = {SEARCH_EPOCHS} "
            "QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY success DESC, model_id) = 1)")
    second = f"second AS (SELECT * REPLACE (0.7e0 AS mu, 2 AS epochs) FROM {fits.final_sql('f')} JOIN best USING (user_id, model_id))"
    third = f"third AS (SELECT * REPLACE (0e0 AS mu, 1 AS epochs) FROM {fits.final_sql('g')})"
    replay = [fits.replay_sql(name, start, NEURONS, rows="train") for name, start in (("f", "lanes"), ("g", "second"), ("h", "third"))]
    return f"""WITH RECURSIVE {fits.DESIGN}, parts AS (SELECT *, pos <= round_even(len * 0.3::double, 0) AS old FROM rows),
  train AS (SELECT * REPLACE (count(*) OVER (PARTITION BY user_id) AS len) FROM parts WHERE old), {lanes}, {replay[0]}, {best}, {second}, {replay[1]}, {third}, {replay[2]}"""


def _chain_scores_sql() -> str:
    from tidemark.registry import fits

    cells = fits.columns_of(NEURONS)
    total = f"h.{cells[fits.OUTPUT, 0, 0]} + " + " + ".join(
        f"h.{cells[fits.OUTPUT, n, 0]} * " + fits.sigmoid_sql(" + ".join(f"r.{f} * h.{cells[fits.HIDDEN, j, n]}" for j, f in enumerate(FEATURES)))
        for n in range(1, NEURONS + 1)
    )
    return (f"{_chain_sql()} SELECT r.user_id, r.event_id, {q6(fits.sigmoid_sql(total), 'p')}, {q6('r.y', 'y')} "
            f"FROM parts r JOIN {fits.final_sql('h')} h USING (user_id) WHERE NOT r.old")


def _chain(spark, sf):
    from tidemark.registry import fits

    panel = fits.design_events(spark, sf)
    return evaluate.train_test_eval(
        panel, FEATURES, "y", trials=TRIALS, neurons=NEURONS, search_epochs=SEARCH_EPOCHS, stages=STAGES,
        init=fits.start(panel, TRIALS, NEURONS),
    )


@register("train_test_eval", _chain_scores_sql())
def train_test_eval(spark, sf):
    """Restarts and two stages on the first 30 % of every user's rows, scores on the rest."""
    return out(_chain(spark, sf)[0].df, EV_KEYS, ["p", "y"])


def _chain_weights_sql() -> str:
    from tidemark.registry import fits

    return f"{_chain_sql()} {fits.weights_sql('h', NEURONS)}"


@register("train_test_weights", _chain_weights_sql())
def train_test_weights(spark, sf):
    from tidemark.registry import fits

    return fits.weights_out(_chain(spark, sf)[1])


def _chain_curve_sql() -> str:
    from tidemark.registry import fits

    stages = " UNION ALL ".join(
        f"SELECT c.*, {i}::bigint AS stage, {skip} + epoch AS step FROM {fits.curve_sql(name)} c JOIN best USING (user_id, model_id)"
        for i, name, skip in ((1, "f", 0), (2, "g", SEARCH_EPOCHS), (3, "h", SEARCH_EPOCHS + 2))
    )
    return (f"{_chain_sql()} SELECT user_id, model_id, epoch, stage, step::bigint AS step, {q6('sse', 'sse')}, {q6('success', 'success')} FROM ({stages})")


@register("train_test_curve", _chain_curve_sql())
def train_test_curve(spark, sf):
    from tidemark.registry import fits

    return fits.curve_out(_chain(spark, sf)[2].withColumn("stage", F.col("stage").cast("long")), "stage", "step")


WALK_SHARES = (0.1, 0.3, 0.5)


def _walk_sql() -> str:
    from tidemark.registry import fits

    cells = fits.columns_of(NEURONS)
    lanes = fits.lanes_sql(1, NEURONS, fits.WEIGHT_SQL, fits.SETTINGS.format(mu="0.7e0", epochs=1))
    total = f"f.{cells[fits.OUTPUT, 0, 0]} + " + " + ".join(
        f"f.{cells[fits.OUTPUT, n, 0]} * " + fits.sigmoid_sql(" + ".join(f"r.{x} * f.{cells[fits.HIDDEN, j, n]}" for j, x in enumerate(FEATURES)))
        for n in range(1, NEURONS + 1)
    )
    cuts = ", ".join(f"({s}::double)" for s in WALK_SHARES)
    return f"""WITH RECURSIVE {fits.DESIGN}, {lanes}, {fits.replay_sql('f', 'lanes', NEURONS)},
  marks AS (SELECT user_id, share, cast(round_even(len * share, 0) AS bigint) AS step FROM (SELECT DISTINCT user_id, len FROM rows) CROSS JOIN (VALUES {cuts}) AS s(share)),
  latest AS (SELECT user_id, event_id, max(share) AS share, max(step) AS step FROM rows JOIN marks USING (user_id) WHERE step < pos GROUP BY ALL)
  SELECT r.user_id, r.event_id, {q6('l.share', 'share')}, l.step, {q6(fits.sigmoid_sql(total), 'p')}, {q6('r.y', 'y')}
  FROM rows r JOIN latest l USING (user_id, event_id) JOIN f ON f.user_id = r.user_id AND f.step = l.step"""


@register("walk_forward", _walk_sql())
def walk_forward(spark, sf):
    """One training pass, whose weights after a tenth, three tenths and half of a user's rows score the rows behind them."""
    from tidemark.registry import fits

    panel = fits.design_events(spark, sf)
    scored = evaluate.walk_forward(panel, FEATURES, "y", fits.start(panel, 1, NEURONS), WALK_SHARES, eta=0.1, momentum=0.7)
    return out(scored.df, [*EV_KEYS, "step"], ["share", "p", "y"])
