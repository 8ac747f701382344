"""Language spans: the path and the words against brute force, held-out accuracy, odd rows."""

from __future__ import annotations

import unicodedata
import zlib

import numpy as np
import pytest
from llm.rows import CLASHES, empty, odd
from pyspark.sql import functions as F

from tidemark.llm import languages
from tidemark.llm.queries import QUERIES


def path_by_hand(scores, counts, penalty, start):
    path, at = [], 0
    for count in counts:
        value, back = start.copy(), []
        for row in scores[at : at + count]:
            top = value.argmax()
            back.append(np.where(value >= value[top] - penalty, np.arange(len(value)), top))
            value = np.maximum(value, value[top] - penalty) + row
        label, own = value.argmax(), []
        for step in reversed(back):
            own.append(label)
            label = step[label]
        path += own[::-1]
        at += count
    return path


@pytest.mark.parametrize("labels", [1, 2, 5])
@pytest.mark.parametrize("block", [1, 3, 8, 128])
def test_best_path(labels, block):
    rng = np.random.default_rng(labels * 100 + block)
    for _ in range(10):
        counts = rng.integers(0, 40, 12)
        scores, start = rng.normal(0, 2, (counts.sum(), labels)), rng.normal(0, 1, labels)
        assert languages.best_path(scores, counts, 3.0, start, block).tolist() == path_by_hand(scores, counts, 3.0, start)
    assert languages.best_path(np.zeros((0, labels)), np.array([0, 0]), 3.0, np.zeros(labels)).tolist() == []


def words_by_hand(text):
    """Runs of letters of one script, with their marks."""
    def script(c):
        for number, ranges in enumerate(languages.SCRIPTS.values(), 1):
            if any(a <= ord(c) <= b for a, b in ranges):
                return number
        return languages.OTHER

    found, run = [], None
    for i, c in enumerate([*text, " "]):
        category = unicodedata.category(c)[0]
        kind = script(c) if category == "L" else run[1] if category == "M" and run else None
        if run and kind != run[1]:
            found.append((run[0], i, run[1]))
            run = None
        if kind and not run:
            run = (i, kind)
    return found


def test_words():
    texts = ["", "a", "The cat's 2 dogs!", "Привет мир hello", "日本語テキスト и", "été ́x", "naïve\0Ünï", "12 34", "हिन्दी भाषा", "x\U0002A6D6y", "\U00030000"]
    words = languages.words_of(texts)
    found = list(zip(words.text.tolist(), words.start.tolist(), words.stop.tolist(), words.script.tolist()))
    assert found == [(i, *w) for i, t in enumerate(texts) for w in words_by_hand(t)]
    # A word has the same buckets whatever stands beside it and however it is capitalised.
    one, two = languages.words_of(["straße"]), languages.words_of(["x Straße, y"])
    assert one.whole[0] == two.whole[1]
    for a, b in zip(one.groups, two.groups):
        assert a.tolist() == b[1:7].tolist()


def made(spark):
    """Four invented languages, two of them in other scripts, as whole documents."""
    rng = np.random.default_rng(9)
    kinds = {"aa": "abcdeilmnost", "bb": "gjkpqruvwxyz", "cc": "абвгдежзиклм", "dd": "אבגדהוזחטיכל"}
    rows = []
    for i in range(240):
        lang = list(kinds)[i % 4]
        text = " ".join("".join(rng.choice(list(kinds[lang]), rng.integers(2, 9))) for _ in range(rng.integers(5, 60)))
        rows.append((i, text, lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), kinds


def test_spans_of_mixed_texts(spark):
    documents, kinds = made(spark)
    model = languages.fit(documents)
    assert model.languages == list(kinds)
    texts = {r["lang"]: r["text"] for r in documents.orderBy(F.desc("doc_id")).limit(4).collect()}
    mixed = [(1, texts["aa"] + ". " + texts["bb"]), (2, texts["bb"] + " " + texts["cc"] + "; " + texts["aa"]), (3, texts["dd"])]
    df = spark.createDataFrame(mixed, "doc_id long, text string")
    found = {r["doc_id"]: r for r in languages.identify_languages(df, model).collect()}
    assert [s["lang"] for s in found[1]["spans"]] == ["aa", "bb"]
    assert [s["lang"] for s in found[2]["spans"]] == ["bb", "cc", "aa"]
    assert [s["lang"] for s in found[3]["spans"]] == ["dd"] and found[3]["score"] > 0.99
    for i, text in mixed:
        cut = [text[s["start"] : s["end"]] for s in found[i]["spans"]]
        expected = {1: [texts["aa"], texts["bb"]], 2: [texts["bb"], texts["cc"], texts["aa"]], 3: [texts["dd"]]}[i]
        assert cut == expected
    # A word of another script can't have a label that its script rules out, whatever its neighbours.
    one = languages.identify(model, [texts["cc"] + " abc " + texts["cc"]], 8.0).to_pylist()[0]
    assert [s["lang"] for s in one["spans"]][0::2] == ["cc", "cc"] and one["spans"][1]["lang"] in ("aa", "bb")


def test_bound_of_the_sample(spark):
    documents, kinds = made(spark)
    few = languages.fit(documents, most_rows=24)
    assert few.languages == list(kinds) and np.allclose(np.exp(few.prior).sum(), 1)
    found = languages.identify_languages(documents, few)
    assert found.filter("lang_pred = lang").count() >= 0.95 * documents.count()


def test_odd_rows(spark):
    documents, _ = made(spark)
    model = languages.fit(documents.unionByName(documents.limit(3).withColumn("lang", F.lit(None).cast("string"))))
    found = languages.identify_languages(odd(spark), model)
    assert set(CLASHES) - {"score", "spans"} <= set(found.columns)
    rows = found.collect()
    assert len(rows) == odd(spark).count()
    for r in rows:
        letters = any(unicodedata.category(c)[0] == "L" for c in r["text"] or "")
        assert (r["lang_pred"] in model.languages) if letters else (r["lang_pred"], r["score"], r["spans"]) == ("und", 0.0, [])
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert languages.identify_languages(empty(spark), model).count() == 0
    nothing = languages.fit(documents.filter("false"))
    assert {(r["lang_pred"], r["score"]) for r in languages.identify_languages(odd(spark), nothing).collect()} == {("und", 0.0)}
    one = languages.fit(documents.filter("lang = 'aa'"))
    assert {r["lang_pred"] for r in languages.identify_languages(documents, one).collect()} == {"aa"}


def test_query(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    rows = QUERIES["op13_language_id"](spark, sf)
    joined = rows.join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert len(joined) == documents.count()
    held = [r for r in joined if r["held_out"]]
    assert held and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    # Labels and ids of held-out rows change nothing.
    other = documents.withColumn("lang", F.when(languages.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    again = languages.identify_languages(other, languages.fit(other)).select(*rows.columns)
    assert again.exceptAll(rows).count() == 0
