"""Source mixing, personal data and the quality classifier."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm.rows import CLASHES, LONG, empty, odd
from pyspark.sql import functions as F

from tidemark.llm import mixing, pii, quality


def made(spark, n=400, seed=2):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 200)), rng.choice(["a", "a", "a", "b", "c", "é", None]), "x") for i in range(n)]
    rows += [(n, "w " * 5000, "solo", "x"), (n + 1, "", "none", "x"), (n + 2, "w w", "tiny", "x"), (5, "w w w", "a", "x"), (5, "w w w", "a", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, at string")


def expected_targets(sizes, weights, cap=3):
    total, capped = sum(sizes.values()), set()
    while True:
        rest = [s for s in sizes if s not in capped]
        level = (total - sum(cap * sizes[s] for s in capped)) / sum(weights[s] for s in rest)
        over = {s for s in rest if cap * sizes[s] < level * weights[s]}
        if not over:
            return {s: cap * sizes[s] if s in capped else level * weights[s] for s in sizes}
        capped |= over


@pytest.mark.parametrize("block", [1, 16, 128])
def test_mix(spark, block):
    result, quotas = mixing.mix(made(spark), block=block, shard=16, keep=["at"])
    rows = result.collect()
    assert len(rows) == made(spark).count() and {r["at"] for r in rows} == {"x"}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(r["source_size"] == sizes[r["source"]] for r in rows)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = expected_targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    for s in sizes:
        assert target[s] == pytest.approx(wanted[s]) and abs(taken[s] - target[s]) <= block
    # Highest quotients, all blocks allotted, whole shards but the last.
    n = int(sum(sizes.values()) / block + 0.5)
    by_source, by_shard = defaultdict(int), defaultdict(int)
    for r in quotas.collect():
        by_source[r["source"]] += r["blocks"]
        by_shard[r["shard"]] += r["blocks"]
    seats = sorted(((2 * k + 1) / wanted[s], s or "") for s in sizes if wanted[s] for k in range(int(wanted[s] / block) + 3))[:n]
    expected = defaultdict(int)
    for _, s in seats:
        expected[s or None] += 1
    assert by_source == expected and sum(by_shard.values()) == n
    assert all(by_shard[i] == 16 for i in range(n // 16))


def test_mix_reruns_agree_and_odd_rows(spark):
    first, second = (sorted(map(str, mixing.mix(made(spark).repartition(p))[0].collect())) for p in (3, 7))
    assert first == second
    rows = mixing.mix(odd(spark), keep=CLASHES)[0]
    assert rows.count() == odd(spark).count() and set(CLASHES) <= set(rows.columns)
    assert [x.count() for x in mixing.mix(empty(spark))] == [0, 0]
    given = spark.createDataFrame([("a", 1), (None, 3)], "source string, weight long")
    weighed = mixing.mix(made(spark), weights=given, block=1)[0].groupBy("source").agg(F.sum("taken").alias("n")).collect()
    assert all(r["n"] == 0 for r in weighed if r["source"] not in ("a", None))


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def base(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits)))
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and total % 10 == 0, "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def random_texts(n):
    rng = random.Random(8)
    parts = ["a.b@c.de", "x@y", "@", "4111 1111 1111 1111", "4111-1111-1111-1111", "1.2.3.4", "256.1.1.1", "001.02.3.04", "1.2.3.4.5.6.7.8.9",
             "+1 (017) 555-7713", " ", "é", "😀", "a", ".", "-", "_", "%", "12", "7", "5", " 3", "+", "00", "\n", "4539148803436467",
             "a@b.cc_d@e.ff", "(", ")", "378282246310005"]
    return [None, "", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n))]


def test_base_spans(spark):
    texts = random_texts(1500)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.detect(df, pii.Model({})).select("doc_id", pii.ledger(F.col("found")).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in found} == {i: base(t) for i, t in enumerate(texts)}


def test_long_texts_take_no_quadratic_time(spark):
    texts = ["1 " * 30_000, "4111111111111111 " * 5000, "a" * 200_000, "1.2.3.4 " * 5000, "+1" + "-" * 100_000, "a@" * 50_000, ("a" * 50 + ".") * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = {r["doc_id"]: r["n"] for r in pii.detect(df, pii.fit(df)).select("doc_id", F.size("found").alias("n")).collect()}
    assert n[3] == 5000 and n[2] == n[4] == n[5] == 0
    spans = pii.detect(df, pii.Model({})).filter("doc_id = 3").select(pii.ledger(F.col("found"))).first()[0]
    assert spans == ",".join(f"ip:{8 * i}:{8 * i + 7}" for i in range(5000))


def test_votes_find_secrets_and_leave_words_alone(spark):
    rng = random.Random(9)
    hexes = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(60)]
    texts = [f'words before token = "{h}" and after' for h in hexes] + [f"see figure4-overview-of-results{i} and part {i}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.fit(df)
    got = {r["doc_id"]: r["s"] for r in pii.detect(df, model).select("doc_id", pii.ledger(F.col("found")).alias("s")).collect()}
    assert all(got[i] == "secret:22:62" for i in range(60)) and not any(got[i] for i in range(60, 120))
    hit, false = model.reliabilities["secret"]["context"]
    assert hit > 0.9 > 0.1 > false
    assert all("<SECRET>" in r["text"] for r in pii.mask(df, model).filter("doc_id < 60").collect())


def masked_by_hand(text, spans):
    """The union of overlapping spans, named for the one that begins first."""
    out, at, end = [], 0, 0
    for start, _, stop, kind in spans:
        if start >= end:
            out += [text[max(at, end):start], f"<{kind.upper()}>"]
            end = stop
        end = max(end, stop)
        at = end
    return "".join(out) + text[end:] if spans else text


def test_mask_replaces_every_span_that_is_found(spark):
    texts = random_texts(300) + [
        "call +33.1.42.68.53.00 now", "\ufeffmail a@b.cd,\ufeffx \U0001f600 10.0.0.1\U0001f600", "a@b.cd" * 3, "token = abcdef0123456789abcdef0123456789abcdef01 +49 30 123456789",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"found": F.lit("own"), "_x": F.lit(1)}).drop("_x")
    model = pii.fit(df)
    masked = pii.mask(df, model)
    assert masked.columns == df.columns
    rows = {r["doc_id"]: r for r in masked.collect()}
    for r in pii.detect(df.drop("found"), model).collect():
        spans = [tuple(x) for x in r["found"]]
        assert rows[r["doc_id"]]["text"] == masked_by_hand(r["text"], spans) and rows[r["doc_id"]]["found"] == "own"
    assert "call <PHONE> now" in {r["text"] for r in rows.values()}


def test_masking_many_spans_takes_time_in_proportion(spark):
    import time

    text = "x@y.zz 1.2.3.4 and " * 4_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model = pii.fit(df)
    begin = time.perf_counter()
    row = pii.mask(df, model).first()
    assert row["text"] == "<EMAIL> <IP> and " * 4_000 and time.perf_counter() - begin < 30


def test_mask_of_odd_rows(spark):
    df = spark.createDataFrame(list(enumerate(random_texts(100))), "doc_id long, text string")
    model = pii.fit(df)
    assert pii.mask(odd(spark), model).count() == pii.detect(odd(spark), model).count() == odd(spark).count()
    assert pii.detect(empty(spark), pii.fit(empty(spark))).count() == 0
    assert pii.mask(odd(spark), model).filter("text is null").count() == odd(spark).filter("text is null").count()


def test_filters_on_masked_text_end(spark):
    texts = ["mail a@b.co or c@d.co now", "nothing here", None, "call +1 202 555 0100 please"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    masked = pii.mask(df, pii.Model({"secret": (1,), "iban": (1,), "ssn": (1,)}))
    # The text is made once, below the filter that asks for it. Plans only: the planner itself did not end.
    plan = masked.filter(F.contains("text", F.lit("<EMAIL>")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UTF-32") < 20
    assert [r["doc_id"] for r in masked.filter(F.contains("text", F.lit("<EMAIL>"))).collect()] == [0]
    assert [r["doc_id"] for r in masked.filter("text is null").collect()] == [2]
    assert [r["text"] for r in masked.join(masked.select("text"), "text").filter("doc_id > 1").collect()] == ["call <PHONE> please"]


def test_trees_learn_and_traverse(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 6)).round(1)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > -0.1)).astype(float)
    trees = quality.train(x[:2000], y[:2000])
    assert ((trees.scores(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97
    assert quality.train(x[:0], y[:0]).scores(x[:3]).tolist() == [0.5] * 3
    assert (quality.train(x, np.ones(3000)).scores(x) > 0.99).all()
    # The flat arrays give what walking the nodes one by one gives.
    for row in x[2000:2020]:
        total = trees.start
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - len(f)]
        assert trees.scores(row[None])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(docs, quality.fit(docs, labels)).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95
    few = quality.fit(docs, labels, most_rows=100)
    assert few.feature.shape == (60, 15)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 1), (None, 1), (4, None), (5, 1)], "doc_id long, quality int")
    trees = quality.fit(odd(spark), labels)
    rows = quality.classify(odd(spark), trees).collect()
    assert len(rows) == odd(spark).count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["text"] == LONG}) == 1
    assert quality.classify(empty(spark), quality.fit(empty(spark), labels)).count() == 0
