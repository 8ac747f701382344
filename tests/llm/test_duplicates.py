"""SimHash near-duplicates and repeated byte strings."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from llm.rows import LONG, empty, odd
from pyspark.sql import functions as F

from tidemark.llm import simhash, suffixes


def brute_fingerprint(text, n=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(nodes), 2):
        if linked(a, b):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_fingerprints():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["A", "b", "É", " ", "\t", "\x1c", " word ", "\x0b", "日本 "]) for _ in range(rng.randint(0, 60)))
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)
    assert simhash.fingerprint(LONG.encode()) == brute_fingerprint(LONG)


def test_any_four_positions_hold_a_list():
    for size, n in ((3, 20), (4, 70)):
        lists = simhash.byte_lists(size)
        assert len(lists) == n
        assert all(any(set(t) <= set(four) for t in lists) for four in combinations(range(8), 4))


def clustered(seed, n=250):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        center = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            x = center
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            out.add(int(np.uint64(x).astype(np.int64)))
            if rng.random() < 0.3:
                center = x
    return sorted(out)


@pytest.mark.parametrize(("bits", "limit", "width"), [(4, 512, 3), (4, 512, 4), (4, 3, 3), (4, 1, 4), (2, 2, 3), (0, 4, 3)])
def test_components_equal_all_pairs(spark, bits, limit, width):
    nodes = clustered(bits + limit)
    df = spark.createDataFrame([(x,) for x in nodes], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, bits, limit, width)).collect()}
    expected = brute_components(nodes, lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1") <= bits)
    assert {x: roots.get(x, x) for x in nodes} == expected


def test_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1001: 1000}


def test_near_duplicates(spark):
    rng = random.Random(7)
    base = [" ".join(rng.choices("abcdefghijkl", k=300)) for _ in range(30)]
    texts = base + [t + " end" for t in base[:10]] + base[:5] + [None, "", " ", "a b", "A  B"]
    ids = [1000 - i for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    fps = {i: brute_fingerprint(t) for i, t in zip(ids, texts, strict=True)}
    expected = brute_components(ids, lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    rows = simhash.near_duplicates(df).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {i: (f"{fps[i]:016x}", expected[i]) for i in ids}
    kept = simhash.deduplicated(df).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(expected.values()))


def test_near_duplicates_of_odd_rows(spark):
    rows = simhash.near_duplicates(odd(spark)).collect()
    assert len(rows) == odd(spark).count()
    kept = simhash.deduplicated(odd(spark))
    assert kept.columns == odd(spark).columns
    # Null, empty and blank texts share fingerprint zero; 3, 4 and 6 stand for their copies, each once.
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 3), (False, 4), (False, 6), (False, 8), (True, 0)]
    assert simhash.near_duplicates(empty(spark)).count() == simhash.deduplicated(empty(spark)).count() == 0


def test_collection_against_sorting():
    rng = random.Random(2)
    for _ in range(100):
        docs = [np.array([rng.choice(b"abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 25))], np.uint16) for _ in range(rng.randint(1, 9))]
        suffixes_ = sorted(([*d[i:].tolist(), -1000 + k], d[i - 1] if i else 0xFFFF) for k, d in enumerate(docs) for i in range(len(d) + 1))
        # End markers sort before all symbols, in the order of the documents.
        bwt, lcp = suffixes.collection(docs, 10**4)
        assert bwt.tolist() == [int(c) for _, c in suffixes_]
        for (a, _), (b, _), n in zip(suffixes_, suffixes_[1:], lcp[1:].tolist(), strict=False):
            same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert n == same


def brute_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    n = Counter(hashlib.md5(d[i : i + length]).digest() for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if n[hashlib.md5(d[i : i + length]).digest()] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, bytes(x for x, g in zip(d, gone, strict=True) if not g)))
    return out


def passages(seed):
    rng = random.Random(seed)
    shared = ["".join(rng.choices("abcdef éà\n", k=rng.randint(60, 200))) for _ in range(8)]
    texts = ["".join(rng.choice([rng.choice(shared), "".join(rng.choices("abcdef éà", k=rng.randint(1, 90)))]) for _ in range(rng.randint(1, 8)))
             for _ in range(60)]
    return [*texts, texts[0], texts[0] + "x", None, "", "a" * 500, "ab" * 300, "日本語" * 100, "é" * 63]


@pytest.mark.parametrize(("length", "limit", "size"), [(64, 4096, 1024), (64, 2, 4), (100, 4096, 3), (48, 1, 1)])
def test_repeats_equal_brute_force(spark, length, limit, size):
    texts = passages(length)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
           for r in suffixes.remove_repeats(df, length=length, core_limit=limit, size=size).collect()}
    assert got == dict(enumerate(brute_removal(texts, length)))


def test_long_text_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 300)
    texts = ["".join(passages(9)[:60])[:5000], *passages(9)[:20]]
    data = [(t or "").encode() for t in texts]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(len(data)), pa.int64()), pa.array(range(len(data)), pa.int64()), pa.array(texts, pa.string())], names=["key1", "key2", "text"])
    windows = Counter()
    for out in suffixes._scan(64)([batch]):
        for k, start, n in zip(out.column("key1").to_pylist(), out.column("start").to_pylist(), out.column("n").to_pylist(), strict=True):
            windows.update((k, i) for i in range(start, start + n))
    assert windows == Counter((k, i) for k, d in enumerate(data) for i in range(len(d) - 63))


def test_repeats_of_odd_rows(spark):
    rows = suffixes.remove_repeats(odd(spark)).collect()
    assert len(rows) == odd(spark).count() and suffixes.remove_repeats(empty(spark)).count() == 0
    for r in rows:
        n = len((r["text"] or "").encode())
        assert r["n_removed"] == (n if n >= 400 else 0) and r["spans"] == "spans"


def test_spans_of_many_equal_rows_do_not_grow(spark):
    """Rows that repeat an id and its text share one array of spans, as long as that of two such rows."""
    rng = random.Random(11)
    passage = "".join(rng.choices("abcdefgh ", k=900))
    other = passage[:500] + "".join(rng.choices("xyz", k=700))
    rows = lambda n: spark.createDataFrame([(1, passage)] * n + [(2, other)], "doc_id long, text string")
    sizes = [suffixes.repeated_spans(rows(n)).select(F.max(F.size("spans")).alias("n")).first()["n"] for n in (2, 5000)]
    assert sizes[0] == sizes[1] and sizes[1] < 100
    kept = suffixes.remove_repeats(rows(5000)).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_removed").alias("m"), F.min("n_removed").alias("l"))
    assert {r["doc_id"]: (r["n"], r["m"], r["l"]) for r in kept.collect()} == {1: (5000, 900, 900), 2: (1, 500, 500)}
