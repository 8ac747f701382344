"""Quality scores: gradient-boosted trees on histograms of document statistics, traversed as flat arrays."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import slices

FEATURES = (
    "log_bytes", "lower", "upper", "digits", "space", "symbols", "marks", "exclaims", "stops", "high", "other",
    "log_words", "word_length", "long_words", "short_words", "distinct_words", "top_word", "repeated_pairs", "capitalised",
    "mixed_words", "log_lines", "repeated_lines", "words_per_line", "byte_entropy",
)
_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789",
    "space": b" \t\n\x0b\x0c\r", "symbols": b"#*$%&|<>", "marks": b",;:'\"()-", "exclaims": b"!", "stops": b".?",
    "high": bytes(range(128, 256)),
}


def _class_matrix() -> np.ndarray:
    rows = np.zeros((256, len(_CLASSES) + 1))
    for i, members in enumerate(_CLASSES.values()):
        rows[list(members), i] = 1
    rows[rows.sum(axis=1) == 0, -1] = 1
    return rows


_MATRIX = _class_matrix()


def statistics(text: bytes) -> list[float]:
    """The statistics of one whole text, in the order of FEATURES; all zero for an empty one."""
    n = len(text)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = (counts @ _MATRIX) / n
    seen = counts[counts > 0] / n
    words = text.split()
    k = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    kinds = Counter(words)
    pairs = max(1, len(words) - 1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    rows = max(1, len(lines))
    alphabetic = sum(m for w, m in kinds.items() if w.isalpha())
    return [
        np.log1p(n), *shares, np.log1p(len(words)),
        float(lengths.mean()) if words else 0.0, float((lengths > 15).mean()) if words else 0.0,
        float((lengths < 3).mean()) if words else 0.0, len(kinds) / k, max(kinds.values(), default=0) / k,
        1 - len(set(zip(words, words[1:], strict=False))) / pairs if len(words) > 1 else 0.0,
        sum(m for w, m in kinds.items() if w[:1].isupper()) / k, 1 - alphabetic / k,
        np.log1p(len(lines)), 1 - len(set(lines)) / rows, len(words) / rows, float(-(seen * np.log2(seen)).sum()),
    ]


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth, flattened: inner node i has the children 2i+1 and 2i+2, leaves follow."""

    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray  # (trees, inner nodes); a row goes right where its value is above
    leaf: np.ndarray  # (trees, leaves)
    start: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner] if len(x) else 0.0
        return 1 / (1 + np.exp(-total))


def train(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15,
    least: int = 20, ridge: float = 1.0,
) -> Trees:
    """Boosted trees by Newton steps on the logistic loss; splits are chosen on histograms of at most `bins` bins.

    Without rows the score is one half; with one class only, the smoothed share of that class. Repeated and tied
    values share a bin. A node without a useful split sends all its rows to the left.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    if len(y) == 0 or y.min() == y.max():
        return Trees(feature, threshold, leaf, start)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    f = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            local = node - first
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                key = local * bins + binned[:, j]
                shape = (width, bins)
                g = np.bincount(key, grad, width * bins).reshape(shape).cumsum(axis=1)
                h = np.bincount(key, hess, width * bins).reshape(shape).cumsum(axis=1)
                n = np.bincount(key, minlength=width * bins).reshape(shape).cumsum(axis=1)
                gl, hl, nl = g[:, : len(e)], h[:, : len(e)], n[:, : len(e)]
                gr, hr, nr = g[:, -1:] - gl, h[:, -1:] - hl, n[:, -1:] - nl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain[(nl < least) | (nr < least)] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                for i in np.flatnonzero(top > best):
                    best[i], feature[t, first + i], threshold[t, first + i] = top[i], j, e[at[i]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        at = node - inner
        g, h = np.bincount(at, grad, leaves), np.bincount(at, hess, leaves)
        leaf[t] = rate * g / (h + ridge)
        f += leaf[t, at]
    return Trees(feature, threshold, leaf, start)


def _bytes(array: pa.Array) -> Iterator[list[bytes]]:
    for part in slices([pa.record_batch([array], names=["t"])], "t"):
        yield [x or b"" for x in part.column(0).cast(pa.binary()).to_pylist()]


def statistics_of(text: Column) -> Column:
    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            yield pa.array([statistics(t) for part in _bytes(array) for t in part], pa.list_(pa.float64()))

    return measure(F.coalesce(text, F.lit("")))


def held_out(doc_id: Column) -> Column:
    """Whether labels of the row are kept from training: crc32 of the id as text leaves 1 by 3. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(
    documents: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    most_rows: int = 30_000, **options,
) -> Trees:
    """Train on labelled rows that aren't held out.

    `most_rows` bounds the sample that reaches the driver: statistics of at most about that many rows, chosen by a hash of
    the id, never texts. Null ids and labels are left out; an id labelled twice counts with its smallest label, and an id with
    several texts with the one whose statistics come first.
    """
    known = (
        labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("_label")).na.drop()
        .filter(~held_out(F.col("_id"))).groupBy("_id").agg(F.min("_label").alias("_label"))
    )
    n = known.count()
    parts = 1 << 20
    if n > most_rows:
        known = known.filter(F.pmod(F.xxhash64("_id", F.lit(10)), F.lit(parts)) < parts * most_rows // n)
    # The sample is bounded by `most_rows`, so the documents needn't be shuffled to meet it.
    rows = (
        documents.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(known), "_id")
        .select("_id", "_label", statistics_of(F.col("_text")).alias("_x"))
        .groupBy("_id").agg(F.min("_label").alias("_label"), F.min("_x").alias("_x")).orderBy("_id").toArrow()
    )
    x = np.array(rows.column("_x").to_pylist(), float).reshape(rows.num_rows, len(FEATURES))
    y = np.array(rows.column("_label").to_pylist(), float)
    return train(x, y, **options)


def score(trees: Trees, text: Column) -> Column:
    """Probability of label 1 by the statistics of the whole text; a null text is scored as an empty one."""

    @F.arrow_udf(T.DoubleType())
    def traverse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            parts = [trees.scores(np.array([statistics(t) for t in part], float)) for part in _bytes(array) if part]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return traverse(F.coalesce(text, F.lit("")))


def classify(
    documents: DataFrame, trees: Trees, *, text: str = "text", doc_id: str = "doc_id", least: float = 0.5
) -> DataFrame:
    """Adds `held_out`, `score` and `predicted` to every row. Equal texts have equal scores; no other column is an input.

    Columns of these names are replaced; an empty table stays empty.
    """
    return documents.withColumns({"held_out": held_out(F.col(doc_id)), "score": score(trees, F.col(text))}).withColumn(
        "predicted", (F.col("score") >= least).cast("int")
    )
