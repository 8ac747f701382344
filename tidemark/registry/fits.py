"""Model queries. Their SQL replays every weight update in a recursive query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.models import batch, batch_series, components, online, scoring, search, weights as wt
from tidemark.models.weights import HIDDEN, OUTPUT, connections
from tidemark.registry.core import out, q6, r6, register
from tidemark.registry.inputs import (
    DESIGN, EV_KEYS, FEATURES, MLP_NET, MLP_NEURONS, MLP_SCORED, SCORED, design_events, scored_events, sigmoid_sql, z_sql,
)
from tidemark.session import shared_path

IN = len(FEATURES)


# -- replay in SQL -----------------------------------------------------------------------------


def columns_of(neurons: int) -> dict[tuple[str, int, int], str]:
    return {c: f"{'h' if c[0] == HIDDEN else 'v'}_{c[1]}_{c[2]}" for c in connections(IN, neurons)}


def lanes_sql(trials: int, neurons: int, weight: str, settings: str, rows: str = "rows") -> str:
    """CTE ``lanes``: one row per user and trial; ``weight`` is an expression over {src}, {dst}, {hid} and ``model_id``."""
    cells = ", ".join(
        f"{weight.format(src=c[1], dst=c[2], hid=int(c[0] == HIDDEN))} AS {name}" for c, name in columns_of(neurons).items()
    )
    return (f"lanes AS (SELECT user_id, model_id, {settings}, {cells} FROM (SELECT DISTINCT user_id FROM {rows}) "
            f"CROSS JOIN generate_series(1, {trials}) AS g(model_id))")


def replay_sql(name: str, lanes: str, neurons: int, perceptron: bool = False, rows: str = "rows") -> str:
    """CTE ``name``: the state after every update, with the residual and hit of the row just seen."""
    cells = columns_of(neurons)
    w = list(cells.values())
    moves = [f"m_{c}" for c in w]
    state = ["user_id", "model_id", "eta", "mu", "epochs", *w, *(moves if neurons else [])]
    start = ", ".join(["user_id", "model_id", "eta", "mu", "epochs", *w, *([f"0e0 AS {m}" for m in moves] if neurons else [])])
    dot = lambda pick: " + ".join(f"{f} * {pick(j)}" for j, f in enumerate(FEATURES))
    seen = (f"SELECT s.* EXCLUDE (len), r.y, r.len, {', '.join('r.' + f for f in FEATURES)} FROM {name} s JOIN {rows} r "
            f"ON r.user_id = s.user_id AND r.pos = s.step % r.len + 1 WHERE s.step < s.epochs * r.len")
    keep = "step + 1 AS step, len, y - p AS d, cast((p >= 0.5) = (y >= 0.5) AS double) AS hit"
    if not neurons:
        body = f"SELECT *, {sigmoid_sql(dot(lambda j: cells[OUTPUT, j, 0]))} AS p FROM ({seen})"
        guess = "(CASE WHEN p >= 0.5 THEN 1e0 ELSE 0e0 END)" if perceptron else "p"
        new = [f"{cells[OUTPUT, j, 0]} + eta * (y - {guess}) * p * (1e0 - p) * {f}" for j, f in enumerate(FEATURES)]
        step = f"SELECT user_id, model_id, eta, mu, epochs, {', '.join(new)}, {keep} FROM ({body})"
    else:
        ns = range(1, neurons + 1)
        hidden = ", ".join(f"{sigmoid_sql(dot(lambda j, n=n: cells[HIDDEN, j, n]))} AS a_{n}" for n in ns)
        total = f"{cells[OUTPUT, 0, 0]} + " + " + ".join(f"a_{n} * {cells[OUTPUT, n, 0]}" for n in ns)
        level1 = f"SELECT *, {hidden} FROM ({seen})"
        level2 = f"SELECT *, {sigmoid_sql(total)} AS p FROM ({level1})"
        level3 = f"SELECT *, (p - y) * p * (1e0 - p) AS e FROM ({level2})"

        def push(c):
            layer, src, dst = c
            if layer == OUTPUT:
                return f"eta * e{f' * a_{src}' if src else ''}"
            return f"eta * e * {cells[OUTPUT, dst, 0]} * a_{dst} * (1e0 - a_{dst}) * {FEATURES[src]}"

        level4 = f"SELECT *, {', '.join(f'{push(c)} + mu * m_{n} AS g_{n}' for c, n in cells.items())} FROM ({level3})"
        step = (f"SELECT user_id, model_id, eta, mu, epochs, {', '.join(f'{c} - g_{c}' for c in w)}, "
                f"{', '.join(f'g_{c}' for c in w)}, {keep} FROM ({level4})")
    return (f"{name}({', '.join(state)}, step, len, d, hit) AS (SELECT {start}, cast(0 AS bigint), cast(0 AS bigint), 0e0, 0e0 FROM {lanes} "
            f"UNION ALL {step})")


def final_sql(name: str) -> str:
    return f"(SELECT * FROM {name} WHERE step = epochs * len AND step > 0)"


def weights_sql(name: str, neurons: int, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT user_id, {extra}cast(model_id AS bigint) AS model_id, '{c[0]}' AS layer, {c[1]}::bigint AS src, {c[2]}::bigint AS dst, {q6(col, 'weight')} FROM {final_sql(name)}"
        for c, col in columns_of(neurons).items()
    )


def curve_sql(name: str) -> str:
    return (f"(SELECT user_id, cast(model_id AS bigint) AS model_id, cast(ceil(step / nullif(len, 0)) AS bigint) AS epoch, sum(0.5e0 * d * d) AS sse, "
            f"avg(hit) AS success FROM {name} WHERE step > 0 GROUP BY ALL)")


# -- the same start in Spark -------------------------------------------------------------------

WEIGHT_SQL = "sin({src} + 3e0 * {dst} + 7e0 * {hid} + model_id)"


def start_weight():
    layer = F.when(F.col("layer") == HIDDEN, 7.0).otherwise(0.0)
    return F.sin(F.col("src") + 3.0 * F.col("dst") + layer + F.col("model_id"))


def start(panel, trials: int, neurons: int):
    models = search.trials_of(panel.df.select("user_id").distinct(), trials)
    return wt.weight_rows(models, IN, neurons, start_weight())


def weights_out(df, *extra: str):
    return df.select("user_id", *extra, "model_id", "layer", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), r6("weight").alias("weight"))


def curve_out(df, *extra: str):
    return df.select("user_id", "model_id", F.col("epoch").cast("long").alias("epoch"), *extra, r6("sse").alias("sse"), r6("success").alias("success"))


SETTINGS = "0.1e0 AS eta, {mu} AS mu, {epochs} AS epochs"
PLR = f"WITH RECURSIVE {DESIGN}, {lanes_sql(1, 0, WEIGHT_SQL, SETTINGS.format(mu='0e0', epochs=2))}, {replay_sql('f', 'lanes', 0)}"


def fitted_plr(spark, sf, **options):
    panel = design_events(spark, sf, **{k: options.pop(k) for k in ("max_series_rows", "segment_rows") if k in options})
    return online.fit_online(panel, FEATURES, "y", start(panel, 1, 0), eta=0.1, epochs=2, **options)


@register("plr_fit", f"{PLR} {weights_sql('f', 0)}")
def plr_fit(spark, sf):
    return weights_out(fitted_plr(spark, sf).weights)


# Series beyond the limit train in rounds over slices; every user has more rows than that here.
@register("plr_fit_long", f"{PLR} {weights_sql('f', 0)}")
def plr_fit_long(spark, sf):
    return weights_out(fitted_plr(spark, sf, max_series_rows=30, segment_rows=30).weights)


@register("plr_modes", f"""WITH RECURSIVE {DESIGN}, {lanes_sql(1, 0, WEIGHT_SQL, SETTINGS.format(mu='0e0', epochs=2))},
  {replay_sql('f', 'lanes', 0)}, {replay_sql('g', 'lanes', 0, perceptron=True)}
  {weights_sql('f', 0, "'adaline' AS mode, ")} UNION ALL {weights_sql('g', 0, "'perceptron' AS mode, ")}""")
def plr_modes(spark, sf):
    adaline, perceptron = fitted_plr(spark, sf).weights, fitted_plr(spark, sf, perceptron=True).weights
    both = adaline.withColumn("mode", F.lit("adaline")).unionByName(perceptron.withColumn("mode", F.lit("perceptron")))
    return weights_out(both, "mode")


@register("weight_trace", f"{PLR} " + " UNION ALL ".join(
    f"SELECT f.user_id, f.step, {j}::bigint AS src, {q6(f'v_{j}_0', 'weight')} FROM f JOIN (SELECT DISTINCT user_id, len FROM rows) l USING (user_id) WHERE f.step < 2 * l.len"
    for j in range(IN)))
def weight_trace(spark, sf):
    trace = fitted_plr(spark, sf, trace_every=1).trace
    return trace.select("user_id", "step", F.col("src").cast("long").alias("src"), r6("weight").alias("weight"))


MLP = f"WITH RECURSIVE {DESIGN}, {lanes_sql(1, 2, WEIGHT_SQL, SETTINGS.format(mu='0.7e0', epochs=3))}, {replay_sql('f', 'lanes', 2)}"


def fitted_mlp(spark, sf, trials=1, epochs=3, momentum=0.7, batches=1):
    panel = design_events(spark, sf)
    return online.fit_online(panel, FEATURES, "y", start(panel, trials, 2), eta=0.1, momentum=momentum, epochs=epochs, batches=batches)


@register("mlp_fit", f"{MLP} {weights_sql('f', 2)}")
def mlp_fit(spark, sf):
    return weights_out(fitted_mlp(spark, sf).weights)


@register("epoch_curve", f"{MLP} SELECT user_id, model_id, epoch, {q6('sse', 'sse')}, {q6('success', 'success')} FROM {curve_sql('f')}")
def epoch_curve(spark, sf):
    return curve_out(fitted_mlp(spark, sf).curve)


TRIALS = 6
SEARCH = f"WITH RECURSIVE {DESIGN}, {lanes_sql(TRIALS, 2, WEIGHT_SQL, SETTINGS.format(mu='0.7e0', epochs=2))}, {replay_sql('f', 'lanes', 2)}"
BEST = f"SELECT * FROM {curve_sql('f')} WHERE epoch = 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY success DESC, model_id) = 1"


@register("best_trial", f"{SEARCH} SELECT user_id, model_id, {q6('success', 'success')} FROM ({BEST})")
def best_trial(spark, sf):
    return out(search.best_trial(fitted_mlp(spark, sf, TRIALS, 2, batches=3).curve, ["user_id"]), ["user_id", "model_id"], ["success"])


@register("restart_search", f"{SEARCH} SELECT w.* FROM ({weights_sql('f', 2)}) w JOIN ({BEST}) b USING (user_id, model_id)")
def restart_search(spark, sf):
    panel = design_events(spark, sf)
    best, fits = search.restart_search(
        panel, FEATURES, "y", trials=TRIALS, neurons=2, epochs=2, momentum=0.7, init=start(panel, TRIALS, 2), batches=3
    )
    return weights_out(fits.weights.join(best.select("user_id", "model_id"), ["user_id", "model_id"]))


def descent_sql(name: str, lanes: str, neurons: int, rows: str = "rows") -> str:
    """CTE ``name``: the state after one step down the mean gradient of all rows; ``lanes`` has weights, moves ``m_`` and settings."""
    cells = columns_of(neurons)
    ns = range(1, neurons + 1)
    dot = lambda n: " + ".join(f"{f} * {cells[HIDDEN, j, n]}" for j, f in enumerate(FEATURES))
    seen = f"SELECT s.*, r.y, {', '.join('r.' + f for f in FEATURES)} FROM {lanes} s JOIN {rows} r USING (user_id)"
    level1 = f"SELECT *, {', '.join(f'{sigmoid_sql(dot(n))} AS a_{n}' for n in ns)} FROM ({seen})"
    total = f"{cells[OUTPUT, 0, 0]} + " + " + ".join(f"a_{n} * {cells[OUTPUT, n, 0]}" for n in ns)
    level2 = f"SELECT *, {sigmoid_sql(total)} AS p FROM ({level1})"
    level3 = f"SELECT *, (p - y) * p * (1e0 - p) AS e FROM ({level2})"

    def slope(c):
        layer, src, dst = c
        if layer == OUTPUT:
            return f"e * a_{src}" if src else "e"
        return f"e * {cells[OUTPUT, dst, 0]} * a_{dst} * (1e0 - a_{dst}) * {FEATURES[src]}"

    same = ["eta", "mu", *cells.values(), *(f"m_{c}" for c in cells.values())]
    sums = ", ".join(f"avg({slope(c)}) AS g_{n}" for c, n in cells.items())
    grouped = f"SELECT user_id, model_id, {', '.join(f'any_value({c}) AS {c}' for c in same)}, {sums}, avg(cast((p >= 0.5) = (y >= 0.5) AS double)) AS success FROM ({level3}) GROUP BY ALL"
    stepped = ", ".join(f"eta * g_{n} + mu * m_{n} AS m_{n}" for n in cells.values())
    moved = ", ".join(f"{n} - (eta * g_{n} + mu * m_{n}) AS {n}" for n in cells.values())
    return f"{name} AS (SELECT user_id, model_id, eta, mu, success, {moved}, {stepped} FROM ({grouped}))"


def _batch_search_sql() -> str:
    cells = columns_of(2)
    start = f"at0 AS (SELECT *, {', '.join(f'0e0 AS m_{n}' for n in cells.values())} FROM lanes)"
    lanes = lanes_sql(TRIALS, 2, WEIGHT_SQL, "2e0 AS eta, 0.7e0 AS mu")
    best = "best AS (SELECT * FROM at2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY success DESC, model_id) = 1)"
    ctes = ", ".join([DESIGN, lanes, start, descent_sql("at1", "at0", 2), descent_sql("at2", "at1", 2), best])
    return f"WITH {ctes} " + " UNION ALL ".join(
        f"SELECT user_id, cast(model_id AS bigint) AS model_id, '{c[0]}' AS layer, {c[1]}::bigint AS src, {c[2]}::bigint AS dst, {q6(n, 'weight')} FROM best"
        for c, n in cells.items()
    )


@register("restart_search_batch", _batch_search_sql())
def restart_search_batch(spark, sf):
    """Two epochs down the gradient of all rows of a user, from several starts; the rows of a user are in several places."""
    panel = design_events(spark, sf)
    best, fits = batch_series.restart_search_batch(
        panel, FEATURES, "y", trials=TRIALS, neurons=2, epochs=2, eta=2.0, momentum=0.7, init=start(panel, TRIALS, 2), rows_per_place=20
    )
    return weights_out(search.of_best(fits.weights, best, ["user_id"]))


GRID_EPOCHS, GRID_MOMENTUM = [1, 2], [0.1, 0.5, 0.9]
_GRID = ("0.1e0 AS eta, [{m}][(model_id - 1) % 3 + 1] AS mu, [{e}][(model_id - 1) // 3 + 1] AS epochs"
         .format(m=", ".join(f"{m}::double" for m in GRID_MOMENTUM), e=", ".join(map(str, GRID_EPOCHS))))


@register("param_grid", f"""WITH RECURSIVE {DESIGN}, {lanes_sql(6, 2, WEIGHT_SQL, _GRID)}, {replay_sql('f', 'lanes', 2)}
  SELECT user_id, model_id, epoch, {q6('sse', 'sse')}, {q6('success', 'success')} FROM {curve_sql('f')}""")
def param_grid(spark, sf):
    panel = design_events(spark, sf)
    grid = search.param_grid(spark, [2], GRID_EPOCHS, GRID_MOMENTUM)
    return curve_out(search.grid_search(panel, FEATURES, "y", grid, start_weight(), batches=2).curve)


STAGED = (f"WITH RECURSIVE {DESIGN}, {lanes_sql(1, 2, WEIGHT_SQL, SETTINGS.format(mu='0.7e0', epochs=2))}, {replay_sql('f', 'lanes', 2)}, "
          f"second AS (SELECT * REPLACE (0e0 AS mu, 1 AS epochs) FROM {final_sql('f')}), {replay_sql('g', 'second', 2)}")
STAGES = [{"epochs": 2, "momentum": 0.7}, {"epochs": 1, "momentum": 0.0}]


@register("staged_fit", f"{STAGED} {weights_sql('g', 2)}")
def staged_fit(spark, sf):
    panel = design_events(spark, sf)
    return weights_out(search.staged_fit(panel, FEATURES, "y", start(panel, 1, 2), STAGES)[0])


@register("append_curves", f"""{STAGED} SELECT user_id, model_id, epoch, stage, step, {q6('sse', 'sse')}, {q6('success', 'success')} FROM (
  SELECT *, 1::bigint AS stage, epoch AS step FROM {curve_sql('f')} UNION ALL SELECT *, 2::bigint AS stage, 2 + epoch AS step FROM {curve_sql('g')})""")
def append_curves(spark, sf):
    panel = design_events(spark, sf)
    curve = search.staged_fit(panel, FEATURES, "y", start(panel, 1, 2), STAGES)[1]
    return curve_out(curve.withColumn("stage", F.col("stage").cast("long")), "stage", "step")


INIT_NEURONS, INIT_SEED = 5, 7


def _uniform_sql(stream: int) -> str:
    key = f"concat_ws('|', '{INIT_SEED}', '{stream}', user_id::VARCHAR, model_id::VARCHAR, layer, src::VARCHAR, dst::VARCHAR)"
    return f"((('0x' || substr(md5({key}), 1, 13))::BIGINT)::DOUBLE + 1e0) / 4503599627370496e0"


_CELLS = ", ".join(f"('{a}', {s}, {d})" for a, s, d in connections(IN, INIT_NEURONS))


@register("random_init", f"""WITH {DESIGN}, models AS (
  SELECT user_id, cast(model_id AS bigint) AS model_id FROM (SELECT DISTINCT user_id FROM rows) CROSS JOIN generate_series(1, 3) AS g(model_id))
  SELECT user_id, model_id, layer, src::bigint AS src, dst::bigint AS dst,
    {q6(f'sqrt(-2e0 * ln({_uniform_sql(1)})) * cos(2e0 * pi() * {_uniform_sql(2)})', 'weight')}
  FROM models CROSS JOIN (VALUES {_CELLS}) AS c(layer, src, dst)""")
def random_init(spark, sf):
    panel = design_events(spark, sf)
    models = search.trials_of(panel.df.select("user_id").distinct(), 3)
    return weights_out(wt.random_init(models, IN, INIT_NEURONS, sd=1.0, seed=INIT_SEED))


@register("load_model", f"{PLR} SELECT * FROM ({weights_sql('f', 0)}) WHERE user_id = (SELECT max(user_id) FROM rows)")
def load_model(spark, sf):
    """One model out of a table of many."""
    fit = fitted_plr(spark, sf).pinned()
    path = shared_path(spark, "model")
    wt.save_model(fit.weights, path)
    newest = fit.weights.agg(F.max("user_id")).scalar()
    return weights_out(wt.load_model(spark, path).filter(F.col("user_id") == newest))


@register("save_model", f"{PLR} {weights_sql('f', 0)}")
def save_model(spark, sf):
    path = shared_path(spark, "model")
    wt.save_model(fitted_plr(spark, sf).weights, path)
    return weights_out(wt.load_model(spark, path))


_MOVED = " OR ".join(f"abs(f.{col} - ({WEIGHT_SQL.format(src=c[1], dst=c[2], hid=int(c[0] == HIDDEN))})) > 0" for c, col in columns_of(0).items())
_SUM = " + ".join(f"f.{col}" for col in columns_of(0).values())


@register("weights_unchanged", f"""{PLR} SELECT count(*) * {IN} AS n_weights, {q6(f'sum({_SUM})', 'total')}, true AS after_scoring,
  NOT bool_or({_MOVED}) AS after_fitting FROM {final_sql('f')} f""")
def weights_unchanged(spark, sf):
    """Scoring leaves the stored weights as they were, to the sum that a replay gives; fitting doesn't."""
    panel = design_events(spark, sf)
    before, path = start(panel, 1, 0), shared_path(spark, "model")
    wt.save_model(fitted_plr(spark, sf).weights, path)
    trained = wt.load_model(spark, path)
    scored = scoring.score_by_key(panel.df, FEATURES, trained, ["user_id"])
    used = scored.select("user_id", "p").na.drop().select("user_id").distinct()
    same = wt.weights_unchanged(trained, wt.load_model(spark, path).join(used, "user_id", "left_semi"), "after_scoring")
    moved = wt.weights_unchanged(before, trained, "after_fitting")
    sums = trained.agg(F.count(F.lit(1)).alias("n_weights"), r6(F.sum("weight")).alias("total"))
    return sums.select("n_weights", "total", same.scalar().alias("after_scoring"), moved.scalar().alias("after_fitting"))


_FINAL_P = sigmoid_sql(" + ".join(f"r.{f} * f.{columns_of(0)[OUTPUT, j, 0]}" for j, f in enumerate(FEATURES)))


@register("rescoring_check", f"""{PLR}, again AS (SELECT user_id, y, {_FINAL_P} AS p FROM rows r JOIN {final_sql('f')} f USING (user_id))
  SELECT user_id, {q6('any_value(c.success)', 'learning')}, {q6('avg(cast((p >= 0.5) = (y >= 0.5) AS double))', 'rescored')}
  FROM again JOIN (SELECT user_id, success FROM {curve_sql('f')} WHERE epoch = 2) c USING (user_id) GROUP BY user_id""")
def rescoring_check(spark, sf):
    """Success while learning in the last epoch, and success of the learned weights on the same rows."""
    from tidemark.operators.evaluation import hit_rate

    fit = fitted_plr(spark, sf).pinned()
    scored = scoring.score_by_key(design_events(spark, sf).df, FEATURES, fit.weights, ["user_id"])
    learning = fit.curve.filter("epoch = 2").select("user_id", F.col("success").alias("learning"))
    rescored = hit_rate(scored, by=["user_id"]).select("user_id", F.col("hit_rate").alias("rescored"))
    return out(learning.join(rescored, "user_id"), ["user_id"], ["learning", "rescored"])


@register("learning_scores", f"""{PLR} SELECT f.user_id, cast(f.step - l.len AS bigint) AS rn, {q6('r.y - f.d', 'p')}, {q6('f.d', 'difference')}
  FROM f JOIN (SELECT DISTINCT user_id, len FROM rows) l USING (user_id) JOIN rows r ON r.user_id = f.user_id AND r.pos = f.step - l.len
  WHERE f.step > l.len""")
def learning_scores(spark, sf):
    """Scores and residuals of the rows in the last of two epochs, each before the update that the row makes."""
    return out(fitted_plr(spark, sf, keep_scores=True).scores, ["user_id", "rn"], ["p", "difference"])


# -- gradient of all rows ----------------------------------------------------------------------


def _gradient_sql() -> str:
    ns = range(1, MLP_NEURONS + 1)
    a = ", ".join(f"{sigmoid_sql(z_sql([MLP_NET[HIDDEN, j, n] for j in range(IN)]))} AS a_{n}" for n in ns)
    parts = []
    for layer, src, dst in connections(IN, MLP_NEURONS):
        if layer == OUTPUT:
            term = f"e * a_{src}" if src else "e"
        else:
            term = f"e * ({MLP_NET[OUTPUT, dst, 0]!r}::double) * a_{dst} * (1e0 - a_{dst}) * {FEATURES[src]}"
        parts.append(f"SELECT 'm' AS model_id, '{layer}' AS layer, {src}::bigint AS src, {dst}::bigint AS dst, {q6(f'sum({term})', 'gradient')} FROM g")
    parts.append(f"SELECT 'm', 'loss', 0, 0, {q6('sum(0.5e0 * (y - p) * (y - p))', 'gradient')} FROM g")
    return f"WITH {MLP_SCORED}, g AS (SELECT *, (p - y) * p * (1e0 - p) AS e, {a} FROM scored) " + " UNION ALL ".join(parts)


def fixed_net(panel):
    """The closed-form net as a weight table."""
    models = panel.df.sparkSession.range(1).select(F.lit("m").alias("model_id"))
    weight = F.when(F.col("layer") == HIDDEN, 2.0 * F.cos(F.col("src") + 3.0 * F.col("dst"))).otherwise(2.0 * F.cos(1.0 + 2.0 * F.col("src")))
    return wt.weight_rows(models, IN, MLP_NEURONS, weight)


@register("batch_gradient", _gradient_sql())
def batch_gradient(spark, sf):
    panel = design_events(spark, sf)
    gradient = batch.batch_gradient(panel.df, FEATURES, "y", fixed_net(panel))
    ends = [F.col(c).cast("long").alias(c) for c in ("src", "dst")]
    return gradient.select("model_id", "layer", *ends, r6("gradient").alias("gradient"))


# -- scoring -----------------------------------------------------------------------------------


@register("mlp_score", f"WITH {MLP_SCORED} SELECT user_id, event_id, {q6('p', 'p')} FROM scored")
def mlp_score(spark, sf):
    panel = design_events(spark, sf)
    return out(scoring.mlp_score(panel.df, FEATURES, fixed_net(panel)), EV_KEYS, ["p"])


@register("plr_score", f"""WITH {SCORED} SELECT user_id, event_id, {q6('p', 'p')}, cast(p >= 0.5 AS bigint) AS guess,
  cast((p >= 0.5) = (y >= 0.5) AS bigint) AS hit FROM scored""")
def plr_score(spark, sf):
    from tidemark.functions.scalars import hit_flag, predicted_class

    df = scored_events(spark, sf).df
    return df.select(*EV_KEYS, r6("p").alias("p"), predicted_class("p").cast("long").alias("guess"), hit_flag("p", "y").cast("long").alias("hit"))


_BY_USER = " + ".join(f"{f} * cos({j} + 0.1e0 * user_id)" for j, f in enumerate(FEATURES))


@register("weights_apply", f"WITH {DESIGN} SELECT user_id, event_id, {q6(_BY_USER, 'z')}, {q6(sigmoid_sql(_BY_USER), 'p')} FROM rows")
def weights_apply(spark, sf):
    """Every user has weights of their own."""
    panel = design_events(spark, sf)
    models = panel.df.select("user_id").distinct().withColumn("model_id", F.col("user_id"))
    weights = wt.weight_rows(models, IN, 0, F.cos(F.col("src") + 0.1 * F.col("user_id")))
    scored = scoring.score_by_key(panel.df, FEATURES, weights, ["user_id"])
    return scored.select(*EV_KEYS, r6(-F.ln(1.0 / F.col("p") - 1.0)).alias("z"), r6("p").alias("p"))


WIDE_NEURONS = 30


def wide_weight(by_user: bool):
    """Closed-form weights of a net with many neurons, of one model or one for each user."""
    shift = F.col("user_id") * 0.1 if by_user else F.lit(0.0)
    return F.when(F.col("layer") == HIDDEN, F.cos(F.col("src") + 3.0 * F.col("dst") + shift)).otherwise(F.cos(1.0 + 2.0 * F.col("src") + shift) / 5.0)


def _wide_sql(shift: str) -> str:
    neurons = " + ".join(
        f"(cos(1e0 + {2 * n}e0 + {shift}) / 5e0) * "
        + sigmoid_sql(" + ".join(f"{f} * cos({j}e0 + {3 * n}e0 + {shift})" for j, f in enumerate(FEATURES)))
        for n in range(1, WIDE_NEURONS + 1)
    )
    p = sigmoid_sql(f"(cos(1e0 + {shift}) / 5e0) + {neurons}")
    return f"WITH {DESIGN} SELECT user_id, event_id, {q6(p, 'p')} FROM rows"


@register("mlp_score_30", _wide_sql("0e0"))
def mlp_score_30(spark, sf):
    """One net of thirty neurons over all rows."""
    panel = design_events(spark, sf)
    net = wt.weight_rows(spark.range(1).select(F.lit("m").alias("model_id")), IN, WIDE_NEURONS, wide_weight(False))
    return out(scoring.mlp_score(panel.df, FEATURES, net), EV_KEYS, ["p"])


@register("score_by_key_30", _wide_sql("0.1e0 * user_id"))
def score_by_key_30(spark, sf):
    """A net of thirty neurons for each user."""
    panel = design_events(spark, sf)
    weights = wt.weight_rows(panel.df.select("user_id").distinct(), IN, WIDE_NEURONS, wide_weight(True))
    return out(scoring.score_by_key(panel.df, FEATURES, weights, ["user_id"], WIDE_NEURONS), EV_KEYS, ["p"])


_LAMBDA = "((a + c) / 2 + sqrt(power((a - c) / 2, 2) + b * b))"


@register("principal_component", f"""WITH {DESIGN}, m AS (SELECT var_samp(x_1) AS a, var_samp(x_2) AS c, covar_samp(x_1, x_2) AS b FROM rows),
  v AS (SELECT b / sqrt(b * b + power({_LAMBDA} - a, 2)) AS v1, ({_LAMBDA} - a) / sqrt(b * b + power({_LAMBDA} - a, 2)) AS v2 FROM m),
  s AS (SELECT v1 * g AS v1, v2 * g AS v2 FROM (SELECT *, CASE WHEN abs(v1) >= abs(v2) THEN sign(v1) ELSE sign(v2) END AS g FROM v))
  SELECT user_id, event_id, {q6('x_1 * v1 + x_2 * v2', 'pc1')} FROM rows CROSS JOIN s""")
def principal_component(spark, sf):
    return out(components.principal_component(design_events(spark, sf).df, ["x_1", "x_2"]), EV_KEYS, ["pc1"])


_BY_ROW = "((a + c) / 2 + sqrt(power((a - c) / 2, 2) + b * b))"


@register("principal_component_by", f"""WITH {DESIGN}, m AS (
    SELECT user_id, var_samp(x_1) AS a, var_samp(x_2) AS c, covar_samp(x_1, x_2) AS b FROM rows GROUP BY user_id),
  v AS (SELECT user_id, b / sqrt(b * b + power({_BY_ROW} - a, 2)) AS v1, ({_BY_ROW} - a) / sqrt(b * b + power({_BY_ROW} - a, 2)) AS v2 FROM m),
  s AS (SELECT user_id, v1 * g AS v1, v2 * g AS v2 FROM (SELECT *, CASE WHEN abs(v1) >= abs(v2) THEN sign(v1) ELSE sign(v2) END AS g FROM v))
  SELECT user_id, event_id, {q6('x_1 * v1 + x_2 * v2', 'pc1')} FROM rows JOIN s USING (user_id)""")
def principal_component_by(spark, sf):
    """Each user has loadings of their own."""
    return out(components.principal_component_by(design_events(spark, sf).df, ["x_1", "x_2"], ["user_id"]), EV_KEYS, ["pc1"])
