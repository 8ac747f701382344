"""URL filters, quality rules and token counts."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from llm.rows import LONG, empty, odd
from pyspark.sql import functions as F

from tidemark.llm import rules, tokens, urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block"), (None, "/", "block")]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, "allow")))


def test_urls(spark):
    rng = random.Random(3)
    parts = ["http://", "https://", "", "ftp://x://"], ["", "a.", "A.b.", "not", "."], ["example.org", "ORG", "org", "x.com", "com", "example.com:80"], [
        "", "/", "/es/", "/en/1", "/en/12?x", "/en/", "/fr/a#b", "/de/", "?/de/", "#x", "/d\ne/"]
    texts = [None, "", "://", "x", "://org/"] + ["".join(rng.choice(p) for p in parts) for _ in range(400)]
    texts.append("http://" + "a." * 20_000 + "org/" + "x" * 100_000)
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate([*texts, texts[9]])], "page_id long, url string, host string")
    table = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages, table).collect()}
    assert got == {i: judged(u) for i, u in enumerate([*texts, texts[9]])}
    assert urls.filter_urls(pages.filter("false"), table).count() == 0
    nothing = urls.filter_urls(pages, table.filter("false"), default="block").collect()
    assert {(r["rule"], r["verdict"]) for r in nothing} == {(None, "block")}


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_rules_match_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " ", "\n\n", LONG] + [
        "".join(rng.choice(["a", "b", " ", " ", "\n", "# ", "é", "😀 ", "a b c d e ", "\x1c"]) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in rules.ledger(df).select("doc_id", *columns).collect()}
    assert got == {i: measures(t) for i, t in enumerate(texts)}


def test_policies_and_ablations(spark):
    book = rules.ledger(odd(spark))
    assert book.count() == odd(spark).count() and rules.ledger(empty(spark)).count() == 0
    for policy, names in rules.POLICIES.items():
        rows = rules.apply_policy(book, policy).select("failed", "kept").collect()
        bits = rules.mask(names)
        assert all(r["kept"] == (r["failed"] & bits == 0) for r in rows)
        for r in rules.ablations(book, policy).collect():
            bit = rules.mask((r["rule"],))
            assert r["n_failed"] == sum(bool(x["failed"] & bit) for x in rows)
            assert r["n_only"] == sum(x["failed"] & bits == bit for x in rows)
            assert r["n_kept"] == sum(x["kept"] for x in rows) and r["n_kept_without"] == r["n_kept"] + r["n_only"]


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(tokens.public_path("piece_bpe_32k.model"))


def test_spliced_counts_equal_whole_counts(encoder):
    assert encoder.splices
    rng = random.Random(6)
    parts = ["the", "é", "日本", " ", "  ", "\n", "\t", "▁", "a", "x" * 50, " token ", "=", "😀", "<s>", "   ", "1.2", "\0"]
    for _ in range(150):
        text = "".join(rng.choice(parts) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 300)))
        for chunk, overlap in ((64, 16), (200, 30), (37, 5)):
            assert tokens.long_count(encoder, text, chunk, overlap) == encoder.counts([text])[0]
    for text in ("x" * 5000, "  " * 3000, "日本" * 2000, LONG):
        assert tokens.long_count(encoder, text, 100, 10) == encoder.counts([text])[0]


def test_counts_of_odd_rows(spark, encoder):
    rows = tokens.count_tokens(odd(spark), limit=5, chunk=1000, overlap=50).collect()
    assert len(rows) == odd(spark).count() and tokens.count_tokens(empty(spark)).count() == 0
    for r in rows:
        text = r["text"] or ""
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), encoder.counts([text])[0])
        assert r["over_limit"] == (r["n_tokens"] > 5) and r["score"] == "score"


def test_shapes_are_few(spark):
    df = spark.createDataFrame([("http://a.b.c.org/x/y",)], "url string").select("url", urls.url_host(F.col("url")).alias("h"))
    assert df.first()["h"] == "a.b.c.org"
