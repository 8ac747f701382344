"""Decontamination, license scans, the registered queries and the pipeline."""

from __future__ import annotations

import random
import re
import textwrap

import pytest
from compare import connect, differences, spark_rows, sql_rows
from llm.rows import empty, odd
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from tidemark.llm import decontaminate, licenses
from tidemark.llm.common import without

SF = "/root/testdata/sf0.01"
ITEM = "Tom has 3 apples and buys 5 kg of rice for Anna in Rome today while Anna waits"


def contaminated(spark, texts, items, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.contamination(docs, bench, **options).collect()}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_slots(spark, limit):
    texts = [
        f"before it. {ITEM}*** after", ITEM.upper(), ITEM.lower(),
        "Bob has 7 apples and buys 9 lb of rice for Eva in Oslo today while Eva waits",
        # The name Anna stands for two values: the windows of one of them don't count.
        "Bob has 7 apples and buys 9 lb of rice for Eva in Oslo today while Max waits",
        "Bob has 7 apples and buys 9 lb of rice", "3 5 7 9 11 13 15 17", None, "", ITEM[:30] + " else " + ITEM[30:],
    ]
    got = contaminated(spark, texts, [ITEM, None, "", "one two three", "1 2 3 4 5 6 7"], broadcast_limit=limit, least=0.9)
    assert got == {(0, 0): "verbatim", (1, 0): "verbatim", (2, 0): "verbatim", (3, 0): "template"}


def test_a_number_is_one_slot(spark):
    """Separators, decimals, fractions and times belong to the number, whichever of them the other text has."""
    item = "A train goes 300 km in 4 hours and leaves at 9 so how far does it get in 7 hours at half the speed"
    texts = [
        "A train goes 1,250 km in 4.5 hours and leaves at 12:30 so how far does it get in 7.5 hours at half the speed",
        "A train goes 3/4 km in 4 hours and leaves at 9_30 so how far does it get in 7.000.000,25 hours at half the speed",
        item.replace("300", "300.").replace("7", "7,"), "300 km in 4.5 hours",
    ]
    assert contaminated(spark, texts, [item], least=0.7) == {(0, 0): "template", (1, 0): "template", (2, 0): "verbatim"}
    assert contaminated(spark, [t.replace("9_30", "9") for t in texts], [item, texts[0]])[1, 0] == "template"


@pytest.mark.parametrize("limit", [200_000, 0])
def test_a_preamble_that_many_items_share(spark, limit):
    """What is stored is near the pairs found, not documents times items."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    preamble = " ".join(word() for _ in range(18))
    own = [" ".join(word() for _ in range(20)) for _ in range(300)]
    docs = spark.createDataFrame([(i, f"{preamble} {' '.join(word() for _ in range(30))}") for i in range(300)] + [(300 + i, f"{preamble} {own[i]}") for i in range(5)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"{preamble} {t}") for i, t in enumerate(own)], "item_id long, text string")
    kept = []
    real = decontaminate.stored
    try:
        decontaminate.stored = lambda df, label: kept.append((label, real(df, label))) or kept[-1][1]
        found = decontaminate.contamination(docs, bench, broadcast_limit=limit)
        assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(300 + i, i) for i in range(5)}
    finally:
        decontaminate.stored = real
    assert {label: df.count() for label, df in kept if label != "benchmark"} | {"short": 0} == {"candidates": 5, "hits": 5 * 34, "wanted": 5 * 34, "counted": 5, "short": 0}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_slots_of_each_occurrence(spark, limit):
    first = "Bob has 7 apples and buys 9 lb of rice for Eva in Oslo today while Eva waits"
    second = "Max has 8 apples and buys 2 lb of rice for Ida in Kiel today while Ida waits"
    texts = [f"{first} {second}", f"{second}. It is so. {first.replace('apples', 'very fine apples')}", None]
    got = contaminated(spark, texts, [ITEM, None], broadcast_limit=limit)
    assert got == {(0, 0): "template", (1, 0): "template"}


@pytest.mark.parametrize("limit", [200_000, 0])
def test_items_without_windows_are_found_whole(spark, limit):
    texts = ["so 12 + 7 - 3 * 4 = 20 it is", "12 7 3 4", "Blue Whale", "a blue whale's song", "the blue sea, a whale", "1 2 3 4 5 6 7", "1 2 3 4 5 6 8", None, ""]
    items = ["12 + 7 - 3 * 4 = 20", "Blue whale", "1 2 3 4 5 6 7", None, "", "?!"]
    got = contaminated(spark, texts, items, broadcast_limit=limit)
    assert got == {(0, 0): "verbatim", (2, 1): "verbatim", (3, 1): "verbatim", (5, 2): "verbatim"}


@pytest.mark.parametrize("changed", [False, True])
def test_slots_equal_sql(spark, tmp_path, changed):
    """The query and its SQL on small tables with slots, changed values, repeats and short texts."""
    import duckdb

    from tidemark.llm.queries import QUERIES, SQL

    other = "Bob has 7 apples and buys 9 lb of rice for Eva in Oslo today while Eva waits"
    texts = [ITEM, ITEM.upper(), other, other + " " + ITEM, other.replace("Eva waits", "Max waits") if changed else other, "5kg of 3g 4x", "", None, "a b", other.replace("7", "1,250").replace("9", "2.5"), ITEM.replace("3", "3/4").replace("5", "12:30:15")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, other), (3, "5 kg of 3 g 4 x"), (4, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    expected = sql_rows(con, SQL["op4_benchmark_decontamination"])
    assert len(expected[1]) >= 8 and not differences(expected, spark_rows(QUERIES["op4_benchmark_decontamination"](spark, str(tmp_path))))


def test_all_planted_items_are_found(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))

    def plain(text):
        return " ".join(re.sub(r"[^\w]+", " ", text.replace("_", " ")).lower().split())

    texts = {r["doc_id"]: plain(r["text"]) for r in docs.collect()}
    items = {r["item_id"]: plain(r["text"]) for r in bench.collect()}
    whole = {(d, i) for i, w in items.items() for d, t in texts.items() if f" {w} " in f" {t} "}
    found = decontaminate.contamination(docs, bench).collect()
    assert whole and whole <= {(r["doc_id"], r["item_id"]) for r in found}
    for r in found:
        item, text = items[r["item_id"]].split(), texts[r["doc_id"]]
        windows = {" ".join(item[k : k + 5]) for k in range(len(item) - 4)}
        assert sum(f" {w} " in f" {text} " for w in windows) >= 0.8 * len(windows)
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(texts) - len({r["doc_id"] for r in found})


def test_decontamination_of_odd_rows(spark):
    bench = spark.createDataFrame([(1, "same words here again and again same words"), (1, None), (None, "an id that is null and a text")],
                                  "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(odd(spark), bench).collect()}
    assert found == {(6, 1), (7, 1), (None, None)}
    assert decontaminate.decontaminated(odd(spark), bench).count() == odd(spark).count() - 3
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    assert decontaminate.contamination(odd(spark), bench.filter("false")).count() == 0


def test_without_broadcast(spark, monkeypatch):
    gone = odd(spark).filter("doc_id in (3, 4)").select(F.xxhash64("doc_id", "text").alias("key1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("key2"))
    few = without(odd(spark), gone).count()
    monkeypatch.setattr("tidemark.llm.common.KEYS_BROADCAST", 0)
    assert few == without(odd(spark), gone).count() == odd(spark).count() - 3


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner()


def test_every_wording_is_its_license(scanner):
    for name, _, texts in licenses.TEMPLATES:
        for text in texts:
            found = licenses.statements(scanner, f"words stand before.\n{text}\nwords stand after.")
            assert name in {f["license"] for f in found}, (name, text, found)
            assert len({f["license"] for f in found} - {name}) <= 1


def test_wordings_that_differ(scanner):
    def named(text):
        return [f["license"] for f in licenses.statements(scanner, text)]

    assert named("This project is released under the terms of the MIT license.") == ["MIT"]
    assert named("LICENSED UNDER CC BY-NC 4.0.") == ["CC-BY-NC-4.0"] and named("Licensed under CC BY 4.0!!") == ["CC-BY-4.0"]
    assert named("He had a license to kill, and the copyright office knew.") == [] == named("") == named("no cue")
    assert named("Released under the MIT License.\nLicensed under the Apache License, Version 2.0.") == ["MIT", "Apache-2.0"]
    broken = licenses.TEMPLATES[1][2][3].replace(" may not use this file ", "\nmay not use this\nfile ")
    assert "Apache-2.0" in named(broken)


def test_declarations_in_long_sentences(scanner):
    for n in (5, 20, 60, 300):
        text = "stone water river hill road " * n + "which is released under the MIT License and was " + "tree light wind sand " * n
        found = licenses.statements(scanner, text)
        assert [(f["license"], text[f["start"] : f["stop"]]) for f in found] == [("MIT", "released under the MIT License")]


def test_wrapped_notices_with_list_numbers(scanner):
    notice = next(texts[-1] for name, _, texts in licenses.TEMPLATES if name == "BSD-3-Clause")
    for k, start in enumerate(("Redistributions of source", "Redistributions in binary", "Neither the name")):
        notice = notice.replace(start, f"\n\n{k + 1}. {start}")
    for width in (30, 60, 80):
        wrapped = "\n\n".join(textwrap.fill(p, width) for p in notice.split("\n\n"))
        text = f"Copyright (c) 2019, Some One\nAll rights reserved.\n\n{wrapped}\n"
        assert [f["license"] for f in licenses.statements(scanner, text)] == ["BSD-3-Clause"]


@pytest.mark.parametrize("times", [1, 12])
def test_notices_one_after_another(scanner, times):
    names = ["MIT", "ISC", "BSD-3-Clause", "BSD-2-Clause", "Apache-2.0"] * times
    wordings = {name: texts[-1] for name, _, texts in licenses.TEMPLATES}
    notices = [textwrap.fill(wordings[name], 70) for name in names]
    text = "\n\n".join(f"Package {i}\nCopyright (c) 2020 Some One\n\n{x}" for i, x in enumerate(notices))
    found = licenses.statements(scanner, text)
    assert [f["license"] for f in found] == names
    assert all(text[f["start"] : f["stop"]] == x for f, x in zip(found, notices, strict=True))


def test_conditional_size_is_smaller(scanner):
    text = "Licensed under the Apache License, Version 2.0."
    alone, given, best = scanner.ranked(text)[0]
    assert given < alone / 2 and scanner.templates[best][0] == "Apache-2.0"


def test_compressed_sizes_decide_between_passages():
    """The template that leaves much of itself out of the text gives way, though it counts more equal words."""
    text = "alpha beta to gamma of delta in epsilon zeta eta theta iota kappa lambda license"
    fits = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda license"
    long = ["xylophonequartzjudgementvowp", "knightlyfjordbuckwheatzymurgy", "wizardrymnemonicsphinxqubit"]
    leaves = text.replace("eta theta", f"eta {long[0]} theta {long[1]}").replace("kappa", f"{long[2]} kappa")
    scanner = licenses.Scanner([("Leaves", "license", (leaves,)), ("Fits", "license", (fits,))])
    assert [(f["license"], f["n_missing"], f["n_extra"]) for f in licenses.statements(scanner, text)] == [("Fits", 0, 3)]
    alone = licenses.Scanner([("Leaves", "license", (leaves,))])
    assert [(f["license"], f["n_missing"]) for f in licenses.statements(alone, text)] == [("Leaves", 3)]


def test_templates_are_ranked_before_wording_is_compared():
    """All that a block may hold are compressed with it, and only then compared, most saved first."""
    seen = []

    class Watched(licenses.Scanner):
        def ranked(self, block, among=None):
            found = super().ranked(block, among)
            seen.append([i for *_, i in found])
            return found

        def _passages(self, i, own):
            seen.append(i)
            return super()._passages(i, own)

    scanner = Watched()
    assert [f["license"] for f in licenses.statements(scanner, "Released under the MIT License.")] == ["MIT"]
    assert len(seen[0]) >= 2 and seen[1:] == seen[0] and scanner.templates[seen[0][0]][1] == "Released under the MIT License."



def test_scan_places_and_odd_rows(spark):
    text = "é 😀 first.\nReleased under the MIT License.\nlast"
    df = odd(spark).unionByName(odd(spark).limit(1).withColumn("text", F.lit(text)))
    rows = licenses.scan(df).collect()
    assert [(text[r["start"] : r["stop"]].strip(), r["license"], r["n_missing"], r["n_extra"]) for r in rows] == [
        ("Released under the MIT License.", "MIT", 0, 0)]
    assert licenses.scan(empty(spark)).count() == 0
    rebuilt = licenses.scan(df.withColumn("text", F.repeat(F.lit(text + "\n"), 2000)).limit(1)).count()
    assert rebuilt == 2000


LLM = ["op1_simhash_near_dedup", "op2_source_mixing", "op3_license_scans", "op4_benchmark_decontamination", "op5_url_filters",
       "op6_quality_rules", "op7_token_counts", "op8_suffix_array_dedup", "op9_pii", "op10_quality_classifier", "op11_filter_interactions",
       "op12_conversation_prefix_trie", "op13_language_id", "pipeline"]
WITH_SQL = ["op2_source_mixing", "op4_benchmark_decontamination", "op5_url_filters", "op6_quality_rules", "op11_filter_interactions"]


def test_queries_are_registered():
    assert set(LLM) <= set(entry_point.queries())
    assert {n for n in LLM if n in entry_point.oracle_sql()} == set(WITH_SQL)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, name):
    expected = sql_rows(connect(SF), entry_point.oracle_sql()[name])
    assert expected[1] and not differences(expected, spark_rows(entry_point.queries()[name](spark, SF)))


@pytest.mark.parametrize("name", ["op1_simhash_near_dedup", "op3_license_scans", "op7_token_counts", "op8_suffix_array_dedup", "op9_pii"])
def test_query_returns_each_document(spark, name):
    rows = entry_point.queries()[name](spark, SF)
    n = rows.select("doc_id").distinct().count()
    assert n == 1000 if name != "op3_license_scans" else 0 < n < 1000


def test_pipeline(spark):
    """Each stage against brute force on what the stage before it wrote."""
    from llm.test_duplicates import brute_components, brute_fingerprint
    from llm.test_mixing_pii_quality import base, expected_targets

    from tidemark.llm.common import stored
    from tidemark.llm.quality import classify, fit

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    results = [docs]
    for _, stage in corpus_pipeline.STAGES:
        results.append(stored(stage(spark, results[-1], SF), "test"))
    tables = [{r["doc_id"]: r for r in x.collect()} for x in results]
    assert all(x.columns == docs.columns for x in results[:-1])
    scores = classify(docs, fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).filter("score >= 0.5")
    assert set(tables[1]) == {r["doc_id"] for r in scores.collect()}
    fps = {i: brute_fingerprint(r["text"]) for i, r in tables[1].items()}
    roots = brute_components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert set(tables[2]) == set(roots.values()) and all(tables[2][i] == tables[1][i] for i in tables[2])
    found = decontaminate.contamination(results[2], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    assert set(tables[3]) == set(tables[2]) - {r["doc_id"] for r in found}
    assert set(tables[4]) == set(tables[3])
    for i, r in tables[4].items():
        assert not base(r["text"]) and r["n_chars"] == len(r["text"])
        if not base(tables[3][i]["text"]) and "token" not in r["text"]:
            assert r["text"] == tables[3][i]["text"]
    sizes: dict = {}
    for r in tables[4].values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    wanted = expected_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))})
    for s, target in wanted.items():
        rows = [r for r in tables[5].values() if r["source"] == s]
        assert abs(sum(r["taken"] for r in rows) - target) <= 128
    assert corpus_pipeline.run(spark, SF).count() == len(tables[5])


@pytest.mark.parametrize("rows", [odd, empty])
def test_stages_take_odd_rows(spark, tmp_path, rows):
    """Nulls in any column, empty and very long texts, repeated rows, empty tables, and columns with names that operators use."""
    docs = rows(spark).withColumns({"n_chars": F.length("text").cast("long"), "lang": F.lit(None).cast("string")})
    kept = docs.filter("doc_id in (4, 5, 6)")
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns, name
        here = found.collect()
        if name in ("benchmark decontamination", "pii"):
            assert len(here) == docs.count(), name
            assert sorted(map(str, here)) == sorted(map(str, docs.collect())), name
        if name == "simhash near-dedup":
            assert len({r["doc_id"] for r in here if r["doc_id"] in (4, 5)}) == (1 if kept.count() else 0)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert all(r["taken"] > 0 and r["text"] is not None for r in mixed) and bool(mixed) == bool(kept.count())
