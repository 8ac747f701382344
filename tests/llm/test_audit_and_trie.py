"""Filter interactions and the conversation trie against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import connect, differences, spark_rows, sql_rows
from llm.rows import LONG, empty, odd
from pyspark.sql import functions as F

from tidemark.llm import interactions, tries
from tidemark.llm.queries import QUERIES, SQL

# -- filter interactions -----------------------------------------------------------------------


def audit_by_hand(rows, filters, lost=()):
    """Every order applied to every document: rows of (part, set of failed filters, *flags)."""
    result = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        removed_sum = defaultdict(int)
        for order in itertools.permutations(filters):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = sum(f in r[1] for r in mine)
                alone = sum(r[1] == {f} for r in mine)
                result[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), alone, *(sum(r[2 + i] for r in gone) for i in range(len(lost)))]
                removed_sum[f] += len(gone)
        for order in itertools.permutations(filters):
            for step, f in enumerate(order, 1):
                result[part, "".join(order), step].append(removed_sum[f])
    return result


@pytest.mark.parametrize("filters", ["ABCDE", "xyz", "q"])
def test_audit(spark, filters):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "", None]), {f for f in filters if rng.random() < 0.3}, rng.random() < 0.4) for _ in range(300)]
    cells = [(p, sum(1 << filters.index(f) for f in fs), 1, int(flag)) for p, fs, flag in rows]
    counts = spark.createDataFrame(cells, "part string, pattern long, n long, good long")
    found = interactions.audit(counts, filters, lost=["good"]).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in found} == audit_by_hand(rows, filters, ["good"])


def failures_by_hand(rows):
    """Rows (id, text, part): the failing filters of each, by the definitions."""
    result = []
    for i, text, part in rows:
        t = text or ""
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", t) if w]
        fails = set()
        if len(words) < 50:
            fails.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t):
            fails.add("C")
        if any(c in "#$%&*|" for c in t):
            fails.add("D")
        if i is not None and any((u or "") == t and j is not None and j < i for j, u, _ in rows):
            fails.add("E")
        result.append((part or "", fails, i))
    return result


def test_failures_of_odd_rows(spark):
    documents = odd(spark).unionByName(odd(spark).filter("doc_id = 4 or text is null").withColumn("doc_id", F.col("doc_id") + 40)).unionByName(
        odd(spark).filter("doc_id = 8").withColumns({"doc_id": F.lit(70).cast("long"), "text": F.lit("A B #")})
    )
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (5, 0, 1), (44, 1, 1), (None, 1, 1), (3, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in documents.collect()]
    good, toxic = {4, 44}, {5, 44}
    flagged = [(p, f, i in good, i in toxic) for p, f, i in failures_by_hand(rows)]
    counts = interactions.failure_counts(documents, labels)
    found = interactions.audit(counts, "ABCDE", lost=["good_lost", "toxic_lost"]).collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in found} == audit_by_hand(flagged, "ABCDE", ["good", "toxic"])
    assert interactions.audit(interactions.failure_counts(empty(spark), labels), "ABCDE").count() == 0
    without_labels = interactions.failure_counts(documents, labels.filter("false"))
    assert without_labels.agg(F.sum("n"), F.sum("good_lost")).first() == (len(rows), 0)


def test_audit_query(spark, sf):
    assert not differences(sql_rows(connect(sf), SQL["op11_filter_interactions"]), spark_rows(QUERIES["op11_filter_interactions"](spark, sf)))


def test_filters_are_named_once(spark):
    counts = spark.createDataFrame([("a", 0, 1)], "part string, pattern long, n long")
    for filters in ("", "AA", "ABCDEFGH"):
        with pytest.raises(ValueError):
            interactions.audit(counts, filters)


# -- conversation trie -------------------------------------------------------------------------


def trie_by_hand(convs: dict[int, list[tuple[str, str]]]):
    """Nodes of the sequences of (role, text), recursively."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    nodes = {}

    def visit(node):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        below = [visit(child) for child in children[node]]
        leaves = sum(b[0] for b in below) or (0 if children[node] else 1)
        saved = own + sum(b[1] for b in below)
        ends = ",".join(str(c) for c in sorted(c for c in members[node] if len(convs[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        nodes[min(members[node]), len(node)] = (parent, len(members[node]), len(children[node]), leaves, saved, digest)
        return leaves, saved

    if convs:
        visit(())
    return nodes


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(turns, key=lambda x: x[:2])] for c, turns in convs.items()}


def rebuilt(convs):
    result = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 9
        result[c] = convs.get(c - c % 5, [])[:h] + convs[c][h:]
    return result


def as_nodes(df):
    fields = ["parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = df.collect()
    nodes = {(r["conv_id"], r["depth"]): tuple(r[f] for f in fields) for r in rows}
    assert len(nodes) == len(rows)
    return nodes


def table_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit(1), "n": F.lit(2), "head": F.lit("x")})


def random_rows(seed, conversations, longest=6, words=("a", "bb", "", "é", None)):
    rng = random.Random(seed)
    rows = []
    for c in range(conversations):
        turns = rng.sample(range(100), rng.randint(1, longest))
        if rng.random() < 0.2:
            turns[0] = None
        rows += [(c * 3 - 10, t, rng.choice(["user", "bot", None]), rng.choice(words)) for t in turns]
    return rows


@pytest.mark.parametrize(("seed", "conversations", "base"), [(1, 40, 40), (2, 60, 20_000), (3, 1, 1)])
def test_trie(spark, seed, conversations, base):
    rows = random_rows(seed, conversations)
    turns = tries.turns_of(table_of(spark, rows))
    found = tries.prefix_trie(turns, tries.lengths_of(turns), base)
    assert as_nodes(found) == trie_by_hand(ordered(rows))
    # Places in the tour are those of arcs that nest.
    places = sorted(p for r in found.collect() for p in (r["entered"], r["left"]))
    assert places == list(range(len(places)))


def test_trie_of_long_conversations(spark, monkeypatch):
    """Small slices, so that prefixes, numbers and runs cross them; equal copies end at one node."""
    monkeypatch.setattr(tries, "SLICE", 4)
    rows = [(c, t, "u", f"t{t if t < 15 + c else t + c}") for c in range(5) for t in range(30)]
    rows += [(c, t, "u", f"t{t}") for c in range(3000, 5100) for t in range(3)]
    rows += [(9, 1, "u", "x")] * 7 + [(None, 1, "u", "x"), (11, None, None, None), (12, 5, "u", LONG), (13, 5, "u", LONG)]
    turns = tries.turns_of(table_of(spark, rows), max_series_rows=8, segment_rows=8)
    found = tries.prefix_trie(turns, tries.lengths_of(turns), base=100, max_series_rows=8, segment_rows=8)
    assert as_nodes(found) == trie_by_hand(ordered(rows))


def test_rebuilt_conversations(spark, monkeypatch):
    """Conversations whose first turns are another's, some of them left without any turn."""
    monkeypatch.setattr(tries, "SLICE", 4)
    rows = [(c, t, "u", f"{c % 7}-{t}") for c in (*range(40), 101, 102, 203, 10**12 + 1) for t in range(1 + c % 11)]
    conv = F.col("conv")
    turns, lengths = tries.grafted(tries.turns_of(table_of(spark, rows)), conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9, limit=8)
    expected = rebuilt(ordered(rows))
    assert any(not t for t in expected.values())
    assert as_nodes(tries.prefix_trie(turns, lengths, base=100)) == trie_by_hand(expected)


def test_trie_of_nothing(spark):
    turns = tries.turns_of(table_of(spark, [(None, 1, "u", "x")]))
    assert tries.prefix_trie(turns, tries.lengths_of(turns)).count() == 0


def test_list_ranks_of_any_list(spark):
    """Elements in random order, several lists at once."""
    order = np.random.default_rng(3).permutation(200)
    rows, expected = [], {}
    for chain in (order[:150], order[150:199], order[199:]):
        total = np.zeros(3, int)
        for i, x in enumerate(chain):
            after = int(chain[i + 1]) if i + 1 < len(chain) else None
            weights = (1, int(x) % 3, int(x))
            rows.append((int(x), int(x) + 7, after, None if after is None else after + 7, *weights))
            expected[int(x)] = tuple(int(v) for v in total)
            total = total + weights
    links = spark.createDataFrame(rows, "conv long, arc long, next_conv long, next_arc long, steps long, leaves long, saved long")
    found = tries.list_ranks(links, base=60)
    assert {r["conv"]: (r["p_steps"], r["p_leaves"], r["p_saved"]) for r in found.collect()} == expected


def test_trie_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert as_nodes(QUERIES["op12_conversation_prefix_trie"](spark, sf)) == trie_by_hand(rebuilt(ordered(rows)))
