"""URL filters: host-suffix and path-prefix expressions, joined on short hashes, confirmed by digest, longest rule first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lower_ascii

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
SHAPES = 100_000


def url_host(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def _digest(host: Column, path: Column) -> Column:
    # A host has no slash, so host and path joined at the path's slash can be told apart.
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _prefix(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def filter_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow") -> DataFrame:
    """Judge every URL by the longest rule that fits it. Adds `host`, `path`, `rule` and `verdict`.

    `rules` has `host`, `path` (a prefix, compared by character) and `verdict`. A rule fits its host and all
    subdomains of it. Only expressions of a shape that some rule has (labels of the host, characters of the path) are
    made, so a URL of any length gives at most as many as there are shapes. They meet the rules in an equi-join on
    the first 32 bits of a digest; the full digest confirms. Of several rules the longest in characters wins, then the one with
    the longer host, then `block`. Equal URLs are judged once.

    No rule fits: rule null, verdict `default`. A null URL or one without `://` has an empty host and path, which
    only a rule with an empty host could fit. Repeated rows stay repeated; columns of the same names in `pages` are replaced.
    Rules with a null host, path or verdict are left out; no rules or no pages are no error.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    judged = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    rules = rules.select("host", "path", "verdict").na.drop().distinct().select(
        _digest(F.col("host"), F.col("path")).alias("rule_digest"),
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("rule_host_length"),
        _labels(F.col("host")).alias("n_labels"),
        F.length("path").alias("n_chars"),
        F.col("verdict").alias("rule_verdict"),
    )
    shapes = rules.select("n_labels", "n_chars").distinct().limit(SHAPES + 1).collect()
    if len(shapes) > SHAPES:
        raise ValueError(f"the rules have more than {SHAPES} shapes")
    if not shapes:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    expressions = []
    for labels in sorted({s["n_labels"] for s in shapes}):
        lengths = F.array(*(F.lit(n) for n in sorted({s["n_chars"] for s in shapes if s["n_labels"] == labels})))
        suffix = F.substring_index(F.col("host"), ".", -labels)
        fits = F.filter(lengths, lambda n: F.length("path") >= n)
        made = F.transform(fits, lambda n: _digest(suffix, F.substring(F.col("path"), F.lit(1), n)))  # noqa: B023
        expressions.append(F.when(_labels(F.col("host")) >= labels, made).otherwise(F.array().cast("array<string>")))

    seen = judged.select("host", "path").distinct()
    made = seen.select("host", "path", F.explode(F.flatten(F.array(*expressions))).alias("digest"))
    met = made.withColumn("short", _prefix(F.col("digest"))).join(
        rules.withColumn("short", _prefix(F.col("rule_digest"))), "short"
    ).filter(F.col("digest") == F.col("rule_digest"))
    precedence = F.struct(
        F.length("rule").alias("length"), F.col("rule_host_length"), (F.col("rule_verdict") == "block").alias("blocks"),
        F.col("rule_verdict"), F.col("rule"),
    )
    best = met.groupBy("host", "path").agg(F.max(precedence).alias("best")).select(
        "host", "path", F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("verdict")
    )
    kept = [c for c in judged.columns if c not in ("host", "path")]
    return judged.join(best, ["host", "path"], "left").select(
        *kept, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
