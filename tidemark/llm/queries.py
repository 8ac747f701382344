"""The registered queries of the subpackage, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.registry.core import Query

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The rules that the URL query applies, by host and path.
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]

URL_SQL = f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
urls AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM urls JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN best USING (host, path)
"""


@register("op5_url_filters", URL_SQL)
def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.urls import filter_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


RULES_POLICY = "v1"
RULES_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, i, list_slice(w, i, i + 4) AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words)),
twice AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS next
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1),
again AS (SELECT doc_id, sum(least(5, coalesce(next - i, 5))) AS n FROM twice GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM words),
m AS (
  SELECT words.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM words JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT 100 * n_symbols > 30 * n_words AS kept FROM b
"""


@register("op6_quality_rules", RULES_SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.rules import BASE, apply_policy, fails, ledger

    rows = apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), RULES_POLICY)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", fails(BASE).alias("base_failed"), "kept"
    )


@register("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.tokens import count_tokens

    counted = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


@register("op10_quality_classifier")
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import classify, fit

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = fit(documents, table(spark, sf_dir, "labels"))
    return classify(documents, trees).select("doc_id", "held_out", "score", "predicted")


# Pattern of weights, cap, block and seed of the mixing query, in its SQL as well.
MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS k,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS place
  FROM documents),
s0 AS (SELECT k, any_value(source) AS source, sum(size)::BIGINT AS ss FROM d GROUP BY k),
s1 AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w FROM s0),
total AS (SELECT sum(ss)::BIGINT AS t, count(*) AS m FROM s1),
s2 AS (SELECT *, row_number() OVER r AS rank, sum(3 * ss) OVER r AS held, sum(w) OVER () - sum(w) OVER r AS rest
  FROM s1 WINDOW r AS (ORDER BY ss::DOUBLE / w, k ROWS UNBOUNDED PRECEDING)),
levels AS (
  SELECT 0 AS n, (SELECT t FROM total)::DOUBLE / (SELECT sum(w) FROM s1)::DOUBLE AS level
  UNION ALL SELECT rank, ((SELECT t FROM total) - held)::DOUBLE / rest::DOUBLE FROM s2 WHERE rest > 0),
level AS (
  SELECT level FROM levels WHERE NOT EXISTS (SELECT 1 FROM s2 WHERE rank > n AND 3 * ss < level * w)
  ORDER BY n LIMIT 1),
s3 AS (SELECT k, source, ss, least((3 * ss)::DOUBLE, (SELECT level FROM level) * w) AS target FROM s1),
n AS (SELECT floor(t::DOUBLE / 128 + 0.5)::BIGINT AS blocks, (2 * floor(t::DOUBLE / 128 + 0.5) + m) / t::DOUBLE AS last FROM total),
seats AS (
  SELECT k, (2 * i + 1)::DOUBLE / target AS o
  FROM (SELECT k, target, unnest(range(0, greatest(0, floor((target * (SELECT last FROM n) - 1) / 2 + 1e-6)::BIGINT + 1))) AS i
        FROM s3 WHERE target > 0)),
won AS (SELECT k, count(*) AS blocks FROM (SELECT k FROM seats ORDER BY o, k LIMIT (SELECT blocks FROM n)) GROUP BY k),
p0 AS (SELECT s3.*, least(coalesce(blocks, 0) * 128, 3 * ss)::BIGINT AS wanted FROM s3 LEFT JOIN won USING (k)),
p AS (
  SELECT k, ss, target, CASE WHEN ss > 0 THEN wanted // ss ELSE 0 END AS passes, CASE WHEN ss > 0 THEN wanted % ss ELSE 0 END AS rest,
    (ss // 128)::BIGINT AS whole, greatest(ss // 128, 1)::BIGINT AS nb FROM p0),
q AS (
  SELECT *, ceil(rest / 128)::BIGINT AS chosen,
    CASE WHEN 1048583 % nb <> 0 THEN 1048583 WHEN 1048589 % nb <> 0 THEN 1048589 WHEN 1048601 % nb <> 0 THEN 1048601
      WHEN 1048609 % nb <> 0 THEN 1048609 ELSE 1 END AS step,
    ('0x' || substr(md5('17|' || k), 1, 15))::BIGINT % nb AS shift FROM p),
blocks AS (
  SELECT k, b * 128 AS lo, b * 128 + least(128, rest - o * 128) AS hi
  FROM (SELECT k, rest, chosen, b, CASE WHEN b = whole THEN b ELSE (b * step + shift) % nb END AS o
        FROM (SELECT *, unnest(range(0, whole + 1)) AS b FROM q))
  WHERE o < chosen),
placed AS (
  SELECT doc_id, source, size, k, sum(size) OVER (PARTITION BY k ORDER BY place, doc_id ROWS UNBOUNDED PRECEDING) - size AS pos FROM d),
touched AS (SELECT doc_id, k, pos, pos + size AS stop, unnest(range((pos // 128)::BIGINT, ((pos + size - 1) // 128)::BIGINT + 1)) AS b
  FROM placed WHERE size > 0),
partly AS (
  SELECT t.doc_id, t.k, t.pos, sum(greatest(0, least(t.stop, hi) - greatest(t.pos, lo))) AS n
  FROM touched t JOIN blocks ON blocks.k = t.k AND blocks.lo = t.b * 128 GROUP BY ALL)
SELECT d.doc_id, d.source, d.size, q.ss AS source_size, q.target, (q.passes * d.size + coalesce(partly.n, 0))::BIGINT AS taken
FROM placed d JOIN q ON q.k = d.k LEFT JOIN partly ON partly.k = d.k AND partly.pos = d.pos AND partly.doc_id = d.doc_id AND d.size > 0
"""


@register("op2_source_mixing", MIX_SQL)
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))[0]


@register("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm import pii

    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.detect(documents, pii.fit(documents))

    def count(kind: str):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *(count(kind) for kind in pii.BASE),
        F.sha2(pii.ledger(pii.base_only(F.col("found"))), 256).alias("base_sha256"), pii.ledger(F.col("found")).alias("spans"),
    )


@register("op1_simhash_near_dedup")
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def _words_sql(table: str, key: str) -> str:
    """CTE with the words of a table: raw, as a template, and as a template without names."""
    from tidemark.llm.decontaminate import UNITS

    units = ", ".join(f"'{u}'" for u in UNITS)
    number, name = r"regexp_matches(w, '^\p{N}')", r"regexp_matches(w, '^\p{Lu}\p{Ll}')"
    unit = rf"(i > 1 AND regexp_matches(cased[i - 1], '^\p{{N}}') AND lower(w) IN ({units}))"
    joined = "translate(coalesce(text, ''), '_', ' ')"
    for _ in range(2):  # twice, as the digits between two separators belong to both
        joined = rf"regexp_replace({joined}, '(\p{{N}})[.,:/](\p{{N}})', '\1_\2', 'g')"
    return f"""{table}_t AS (
  SELECT {key}, string_split(regexp_replace(trim(regexp_replace({joined}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')),
    '(\\p{{N}})(\\p{{L}})', '\\1 \\2', 'g'), ' ') AS cased FROM {table}),
{table}_w AS (
  SELECT {key}, list_transform(cased, lambda w: lower(w)) AS raw,
    list_transform(cased, lambda w, i: CASE WHEN {number} THEN '<num>' WHEN {name} THEN '<name>' WHEN {unit} THEN '<unit>' ELSE lower(w) END) AS form,
    list_transform(cased, lambda w, i: CASE WHEN {number} THEN '<num>' WHEN {unit} THEN '<unit>' ELSE lower(w) END) AS plain
  FROM {table}_t WHERE len(cased) >= 5)"""


def _decontamination_sql() -> str:
    return f"""
WITH {_words_sql("documents", "doc_id")}, {_words_sql("benchmark", "item_id")},
cut AS (
  SELECT item_id, raw[i:i + 4] AS words, form[i:i + 4] AS form, plain[i:i + 4] AS plain
  FROM (SELECT *, unnest(range(1, len(raw) - 3)) AS i FROM benchmark_w)),
items AS (
  SELECT DISTINCT item_id, words, form FROM (SELECT item_id, words, form FROM cut UNION ALL SELECT item_id, words, plain FROM cut)
  WHERE len(list_filter(form, lambda w: w[1] <> '<')) >= 2),
totals AS (SELECT item_id, count(DISTINCT words) AS n_windows FROM items GROUP BY item_id),
windows AS (
  SELECT doc_id, raw[i:i + 4] AS own, form[i:i + 4] AS form
  FROM (SELECT *, unnest(range(1, len(raw) - 3)) AS i FROM documents_w)),
hits AS (
  SELECT DISTINCT doc_id, item_id, words,
    list_filter(list_transform(range(1, 6), lambda k: CASE WHEN items.form[k][1] = '<' THEN {{'item': words[k], 'value': own[k]}} END), lambda x: x IS NOT NULL) AS pairs
  FROM windows JOIN items ON windows.form = items.form),
wanted AS (
  SELECT hits.*, n_windows, row_number() OVER () AS hit FROM hits JOIN totals USING (item_id)
  WHERE (doc_id, item_id) IN (
    SELECT (doc_id, item_id) FROM hits h JOIN totals t USING (item_id) GROUP BY doc_id, item_id, n_windows HAVING count(DISTINCT words) >= 0.8 * n_windows)),
slots AS (
  SELECT doc_id, item_id, hit, p.item AS item, p.value AS value FROM (SELECT doc_id, item_id, hit, unnest(pairs) AS p FROM wanted)),
best AS (
  SELECT doc_id, item_id, item, value AS best FROM (SELECT doc_id, item_id, item, value, count(*) AS n FROM slots GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, item ORDER BY n DESC, value DESC) = 1),
judged AS (SELECT hit, bool_and(value = best) AS fits, bool_and(value = item) AS equal FROM slots JOIN best USING (doc_id, item_id, item) GROUP BY hit),
found AS (
  SELECT doc_id, item_id, n_windows, count(DISTINCT words) FILTER (WHERE coalesce(fits, true)) AS n_found,
    count(DISTINCT words) FILTER (WHERE coalesce(equal, true)) AS n_verbatim
  FROM wanted LEFT JOIN judged USING (hit) GROUP BY doc_id, item_id, n_windows)
SELECT doc_id, item_id, n_windows, n_found, n_verbatim, n_found / n_windows AS coverage,
  CASE WHEN n_verbatim >= 0.8 * n_windows THEN 'verbatim' ELSE 'template' END AS kind
FROM found WHERE n_found >= 0.8 * n_windows OR n_verbatim >= 0.8 * n_windows
"""


@register("op4_benchmark_decontamination", _decontamination_sql())
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "n_found", "n_verbatim", "coverage", "kind")


@register("op8_suffix_array_dedup")
def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.suffixes import remove_repeats

    removed = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register("op3_license_scans")
def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


AUDIT_FILTERS = "ABCDE"
AUDIT_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t),
     regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails
  FROM words LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM judged GROUP BY ALL),
f AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (
  SELECT list_aggregate(list_transform(o, lambda i: substr('ABCDE', i, 1)), 'string_agg', '') AS filter_order, s AS step, o[s] AS own,
    o[1:s - 1] AS before, list_filter([1, 2, 3, 4, 5], lambda i: i <> o[s]) AS others
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
audit AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (WHERE NOT early AND NOT fails[own]), 0) AS kept,
    coalesce(sum(n) FILTER (WHERE NOT early AND fails[own]), 0) AS removed,
    coalesce(sum(n) FILTER (WHERE early AND fails[own]), 0) AS redundant,
    coalesce(sum(n) FILTER (WHERE fails[own] AND NOT other), 0) AS unique_fails,
    coalesce(sum(good) FILTER (WHERE NOT early AND fails[own]), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE NOT early AND fails[own]), 0) AS toxic_lost
  FROM (SELECT *, len(list_filter(before, lambda i: fails[i])) > 0 AS early, len(list_filter(others, lambda i: fails[i])) > 0 AS other
        FROM steps, counts)
  GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM audit
"""


@register("op11_filter_interactions", AUDIT_SQL)
def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.interactions import audit, failure_counts

    counts = failure_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return audit(counts, AUDIT_FILTERS, lost=["good_lost", "toxic_lost"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


@register("op12_conversation_prefix_trie")
def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.tries import grafted, prefix_trie, turns_of

    conv = F.col("conv")
    shared = F.crc32(conv.cast("string").cast("binary")) % 9
    turns, lengths = grafted(turns_of(table(spark, sf_dir, "conversations")), conv - conv % 5, shared, limit=8)
    return prefix_trie(turns, lengths).drop("entered", "left")


@register("op13_language_id")
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.languages import fit, identify_languages

    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify_languages(documents.drop("lang"), fit(documents))
    return found.select("doc_id", "held_out", "lang_pred", "score")
