"""Personal data: regex, gazetteer and context labelers vote; expectation-maximisation weighs them; a span classifier decides."""

from __future__ import annotations

import math
import operator
from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import whole

# The four base patterns. Possessive runs, and the look-behind that stops a search inside a run already tried,
# find the same matches without trying every start in a long run; cards match from 14 digits on, as shorter ones are dropped.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A text without this has no match, and needs no further search.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

# Candidates beyond the base. What the labelers make of them decides.
_IN = r"A-Za-z0-9_/+=\-"
CANDIDATES = {
    "secret": rf"(?<![{_IN}@.])(?=[A-Z0-9_/+=-]*+[a-z]|[0-9_/+=-]*+[A-Z])(?=[A-Za-z_/+=-]*+[0-9])[{_IN}]{{16,}}+(?![@])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
CANDIDATE_HINT = r"[0-9]"
KINDS = (*BASE, *CANDIDATES)
CONTEXT = 24
# Words that announce a kind, known prefixes of keys, countries with account numbers.
ANNOUNCED = {
    "secret": r"(?i)(key|token|secret|passwd|password|pwd|bearer|credential)[^\n]*$",
    "iban": r"(?i)(iban|account|konto|cuenta|compte)[^\n]*$",
    "ssn": r"(?i)(ssn|social security)[^\n]*$",
}
KNOWN = {
    "secret": r"^(AKIA|ASIA|ghp_|gho_|glpat-|sk_|pk_|xox|AIza|eyJ)",
    "iban": r"^(AT|BE|CH|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
}
SHAPE = {
    "secret": r"^([0-9a-f]{32,}|[0-9A-F]{32,}|(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9].*[0-9]).{20,})$",
    "iban": r"^[A-Z0-9\x20]{15,42}$",
    "ssn": r"^[0-9-]{11}$",
}
ASSIGNED = r"[=:]\s*[\"'`]?$|[\"'`]$"

NO, YES, ABSTAIN = 0, 1, 2
LABELERS = ("shape", "gazetteer", "context", "assigned", "digits")
FEATURES = ("length", "digit_share", "letters")


def _running(values: Column, chunk: int = 1024, join: Callable[[Column, Column], Column] = operator.add) -> Column:
    """Inclusive running totals (or what `join` makes of two) of an int array, built in chunks so that long arrays aren't copied for each
    element. The first one is joined to 0."""
    n = F.size(values)
    zero = F.lit(0)
    no = F.array().cast("array<int>")
    parts = F.sequence(zero, F.floor((n - 1) / chunk).cast("int"))

    def part(c: Column) -> Column:
        return F.slice(values, c * chunk + 1, F.lit(chunk))

    def extend(state: Column, x: Column) -> Column:
        at = join(state["at"], x)
        return F.struct(at.alias("at"), F.concat(state["out"], F.array(at)).alias("out"))

    def empty(at: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), no.alias("out"))

    sums = F.transform(parts, lambda c: F.aggregate(part(c), zero, join))
    ends = F.aggregate(sums, empty(zero), extend, lambda s: s["out"])
    several = F.flatten(F.transform(parts, lambda c: F.aggregate(
        part(c), empty(F.coalesce(F.get(ends, c - 1), zero)), extend, lambda s: s["out"])))
    single = F.aggregate(values, empty(zero), extend, lambda s: s["out"])
    return F.when(n == 0, no).when(n <= chunk, single).otherwise(several)


def _pieces(text: Column, pattern: str) -> Column:
    """What stands before, between and after the matches: one piece more than matches."""
    return F.split(text, pattern, -1)


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: F.when(F.length(p) <= 3, p.cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _code(kind: str, found: Column, before: Column) -> Column:
    """Votes and features of one candidate as a number: a base-3 digit for each labeler, then the features."""
    n = F.length(found)
    digits = F.length(F.regexp_replace(found, "[^0-9]", ""))

    def yes(condition: Column, other: int = NO) -> Column:
        return F.when(condition, YES).otherwise(other)

    votes = {
        "shape": yes(F.rlike(found, F.lit(SHAPE[kind]))),
        "gazetteer": yes(F.rlike(found, F.lit(KNOWN[kind])), ABSTAIN if kind == "secret" else NO),
        "context": yes(F.rlike(before, F.lit(ANNOUNCED[kind]))),
        "assigned": yes(F.rlike(before, F.lit(ASSIGNED)), ABSTAIN if kind != "secret" else NO),
        "digits": F.when(digits * 8 < n, NO).otherwise(ABSTAIN),
    }
    features = {
        "length": F.least(F.floor(F.log2(n.cast("double"))).cast("int"), F.lit(9)),
        "digit_share": F.floor(digits * 4 / n).cast("int"),
        "letters": yes(F.rlike(found, F.lit("[a-z]"))) + 2 * yes(F.rlike(found, F.lit("[A-Z]"))),
    }
    code = F.lit(0)
    for name in LABELERS:
        code = code * 3 + votes[name]
    for name in FEATURES:
        code = code * 10 + features[name]
    return code.cast("int")


def _decoded(code: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    features = []
    for _ in FEATURES:
        code, x = divmod(code, 10)
        features.append(x)
    votes = []
    for _ in LABELERS:
        code, x = divmod(code, 3)
        votes.append(x)
    return tuple(votes[::-1]), tuple(features[::-1])


def _codes(text: Column, kind: str) -> Column:
    """The candidates' codes in order of the text. The context of one ends where the candidate before it ended."""
    found = _matches(text, CANDIDATES[kind])
    return F.transform(
        F.arrays_zip(F.slice(_pieces(text, CANDIDATES[kind]), F.lit(1), F.size(found)).alias("gap"), found.alias("found")),
        lambda x: _code(kind, x["found"], F.right(x["gap"], F.lit(CONTEXT))),
    )


@dataclass(frozen=True)
class Model:
    """The codes that the span classifier accepts, by kind, and what expectation-maximisation made of the labelers."""

    accepted: dict[str, tuple[int, ...]]
    reliabilities: dict[str, dict[str, tuple[float, float]]] = field(default_factory=dict)


def _log_odds(p: float) -> float:
    p = min(max(p, 1e-9), 1 - 1e-9)
    return math.log(p / (1 - p))


def _learn(counts: dict[int, int], rounds: int = 50) -> tuple[set[int], dict[str, tuple[float, float]]]:
    """Reliabilities of the labelers by expectation-maximisation, then a classifier of votes and features.

    Each labeler has a chance to say yes to a true and to a false candidate, with priors that it is right; abstentions say nothing.
    The posterior of each vote pattern labels the candidates softly, and a naive Bayes classifier of features and votes learns from
    those labels. Its decision for each code that occurs is the result.
    """
    decoded = {c: _decoded(c) for c in counts}
    posterior = {}
    for c, (votes, _) in decoded.items():
        said = [v for v in votes if v != ABSTAIN]
        posterior[c] = (sum(said) + 0.5) / (len(said) + 1)
    hit, false, prior = {}, {}, 0.5
    for _ in range(rounds):
        yes = defaultdict(lambda: [8.0, 2.0, 1.0, 9.0])
        mass = [1.0, 1.0]
        for c, (votes, _) in decoded.items():
            p, n = posterior[c], counts[c]
            mass[0] += n * p
            mass[1] += n * (1 - p)
            for name, v in zip(LABELERS, votes, strict=True):
                if v != ABSTAIN:
                    at = yes[name]
                    at[0 if v == YES else 1] += n * p
                    at[2 if v == YES else 3] += n * (1 - p)
        hit = {x: yes[x][0] / (yes[x][0] + yes[x][1]) for x in LABELERS}
        false = {x: yes[x][2] / (yes[x][2] + yes[x][3]) for x in LABELERS}
        prior = mass[0] / sum(mass)

        def evidence(votes: Iterable[int]) -> float:
            return sum(
                math.log(hit[x] / false[x]) if v == YES else math.log((1 - hit[x]) / (1 - false[x]))
                for x, v in zip(LABELERS, votes, strict=True) if v != ABSTAIN
            )

        posterior = {c: 1 / (1 + math.exp(-max(-30, min(30, _log_odds(prior) + evidence(v))))) for c, (v, _) in decoded.items()}
    tables = []
    for i in range(len(FEATURES)):
        true, other = defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)
        for c, (_, features) in decoded.items():
            true[features[i]] += counts[c] * posterior[c]
            other[features[i]] += counts[c] * (1 - posterior[c])
        n_true, n_other = sum(true.values()) + 10, sum(other.values()) + 10
        tables.append({v: math.log(true[v] / n_true) - math.log(other[v] / n_other) for v in {*true, *other}})
    accepted = {
        c for c, (votes, features) in decoded.items()
        if _log_odds(prior) + evidence(votes) + sum(t[v] for t, v in zip(tables, features, strict=True)) >= 0
    }
    return accepted, {x: (hit[x], false[x]) for x in LABELERS}


def fit(df: DataFrame, text: str = "text") -> Model:
    """Count the vote patterns of all candidates of all texts, and learn from the counts.

    Only counts by pattern reach the driver: at most 3^5 votes by 10^3 features for each of three kinds, whatever the size of the table.
    """
    t = whole(text)
    rows = df.filter(F.rlike(t, F.lit(CANDIDATE_HINT))).select(t.alias("t"))
    each = rows.select(F.explode(F.concat(*(
        F.transform(_codes(F.col("t"), kind), lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("code")))  # noqa: B023
        for kind in CANDIDATES
    ))).alias("c"))
    counts: dict[str, dict[int, int]] = {kind: {} for kind in CANDIDATES}
    for row in each.groupBy("c.kind", "c.code").count().collect():
        counts[row["kind"]][row["code"]] = row["count"]
    learned = {kind: _learn(dict(sorted(n.items()))) for kind, n in counts.items() if n}
    return Model(
        {kind: tuple(sorted(learned[kind][0])) if kind in learned else () for kind in CANDIDATES},
        {kind: r for kind, (_, r) in learned.items()},
    )


def _keeps(model: Model, kind: str, found: Column, gap: Column) -> Column:
    if kind in BASE:
        return valid(kind, found)
    return _code(kind, found, F.right(gap, F.lit(CONTEXT))).isin(list(model.accepted.get(kind, ())))


def _patterns(model: Model) -> dict[str, tuple[str, str]]:
    used = {k: (BASE[k], HINTS[k]) for k in BASE}
    return used | {k: (CANDIDATES[k], CANDIDATE_HINT) for k in CANDIDATES if model.accepted.get(k)}


def detect(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds `found`: all spans as an array of (start, rank, end, kind), by start and then kind; code points, end exclusive.

    Spans of the base patterns come whatever the model says; those of candidates that it accepts are added. Kinds may overlap.
    Everything is local to the row: a null or empty text has none, equal rows have equal spans, an empty table stays empty.
    A column `found` in the table is replaced.
    """
    df = df.drop("found").withColumn("_t", whole(text))
    t = F.col("_t")
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    columns = []
    for kind, (pattern, hint) in _patterns(model).items():
        has = F.rlike(t, F.lit(hint))
        df = df.withColumn(f"_{kind}_m", F.when(has, _matches(t, pattern)))
        m = F.col(f"_{kind}_m")
        df = df.withColumn(f"_{kind}_p", F.when(F.size(m) > 0, F.slice(_pieces(t, pattern), F.lit(1), F.size(m))))
        p = F.col(f"_{kind}_p")
        df = df.withColumn(f"_{kind}_e", F.when(F.size(m) > 0, _running(F.zip_with(p, m, lambda a, b: F.length(a) + F.length(b)))))
        zipped = F.arrays_zip(F.col(f"_{kind}_e").alias("end"), m.alias("found"), p.alias("gap"))
        kept = F.filter(zipped, lambda x: _keeps(model, kind, x["found"], x["gap"]))  # noqa: B023
        made = F.transform(kept, lambda x: F.struct(  # noqa: B023
            (x["end"] - F.length(x["found"])).alias("start"), F.lit(KINDS.index(kind)).alias("rank"),  # noqa: B023
            x["end"].alias("end"), F.lit(kind).alias("kind"),  # noqa: B023
        ))
        columns.append(F.when(F.size(m) > 0, made).otherwise(none))
    df = df.withColumn("found", F.sort_array(F.concat(*columns)))
    return df.drop("_t", *(f"_{kind}_{x}" for kind in _patterns(model) for x in "mpe"))


def ledger(found: Column) -> Column:
    """`kind:start:end` of the spans, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def base_only(found: Column) -> Column:
    return F.filter(found, lambda x: x["rank"] < len(BASE))


#: Spans that are masked from one copy of their part of the text.
BLOCK = 512


def mask(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The text with `<EMAIL>`, `<IP>` and so on in place of the spans that `detect` finds in it; null stays null.

    Spans that overlap are one piece, which is named for the span that begins first (of equal ones, for the kind listed first). All spans are
    those of the original text, so what the operator reports is what goes. Other columns stay, whatever their names.
    """
    order = df.columns
    kept = {"found": "_own_found"} if "found" in order else {}
    df = detect(df.withColumnsRenamed(kept), model, text)
    found, t = F.col("found"), F.col(text)
    reach = _running(F.transform(found, lambda x: x["end"]), join=lambda a, b: F.greatest(a, b))
    df = df.withColumn("_reach", F.when(F.size(found) > 0, reach))
    reach, places = F.col("_reach"), F.sequence(F.lit(0), F.size(found) - 1)
    df = df.withColumn("_first", F.when(F.size(found) > 0, F.filter(places, lambda i: (i == 0) | (F.get(found, i)["start"] >= F.get(reach, i - 1)))))
    first = F.col("_first")
    ends = F.concat(F.slice(first, F.lit(2), F.size(first)), F.array(F.size(found)))
    df = df.withColumn("_spans", F.zip_with(first, ends, lambda i, n: F.struct(
        F.coalesce(F.get(reach, i - 1), F.lit(0)).alias("after"), F.get(found, i)["start"].alias("start"), F.get(reach, n - 1).alias("end"),
        F.get(found, i)["kind"].alias("kind"))))
    # Four bytes a code point: a piece is cut out by its place, without counting from the start of the text. Each piece is read
    # behind a byte order mark of its own, or one that the text has would be taken for it. Every look at the whole text
    # copies it, so it is cut into blocks of many spans first.
    spans, wide, order_mark = F.col("_spans"), F.col("_wide"), F.unhex(F.lit("0000FEFF"))
    df = df.withColumn("_wide", F.when(F.size(spans) > 0, F.encode(t, "UTF-32")))

    def piece(source: Column, start: Column, length: Column) -> Column:
        return F.decode(F.concat(order_mark, F.substring(source, start * 4 + 1, length * 4)), "UTF-32")

    def block(own: Column) -> Column:
        """The text up to the last of these spans, from the end of the one before them."""
        begin = F.element_at(own, 1)["after"]
        part = F.struct(F.substring(wide, begin * 4 + 1, (F.element_at(own, -1)["start"] - begin) * 4).alias("bytes"), begin.alias("begin"), own.alias("spans"))
        return F.array_join(F.flatten(F.transform(F.array(part), lambda p: F.transform(p["spans"], lambda x: F.concat(
            piece(p["bytes"], x["after"] - p["begin"], x["start"] - x["after"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))))), "")

    blocks = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int"))
    masked = F.transform(F.transform(blocks, lambda b: F.slice(spans, b * BLOCK + 1, F.lit(BLOCK))), block)
    last = F.element_at(spans, -1)["end"]
    tail = piece(wide, last, F.length(t) - last)
    # An exploded array of one text, as filters on it stay above it: pushed below, they would repeat these expressions in each other
    # until the planner does not end.
    df = df.withColumn(text, F.explode(F.array(F.when(F.size(spans) > 0, F.concat(F.array_join(masked, ""), tail)).otherwise(t))))
    return df.drop("found").withColumnsRenamed({v: k for k, v in kept.items()}).select(*order)
