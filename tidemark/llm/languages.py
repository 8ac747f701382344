"""Languages of a text and of its spans: scripts narrow the candidates of a word, a Viterbi path over the words labels them.

Each word has a score for each learned language, from hashed letter groups and the word itself. A change of language between two words
costs a fixed penalty, so a span needs evidence to get another label than its surroundings. The path with the best total is found
exactly: words are cut into blocks, each block is reduced to a matrix of best scores from its first to its last label, and blocks are
joined by (max, +) products, which numpy does for all blocks of a batch side by side. A text of any length is labelled whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import slices

UNKNOWN = "und"

# Ranges of code points of scripts, by Unicode blocks.
SCRIPTS = {
    "latin": [(0x0041, 0x024F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x0530, 0x058F)],
    "hebrew": [(0x0590, 0x05FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x0900, 0x097F)],
    "bengali": [(0x0980, 0x09FF)],
    "gurmukhi": [(0x0A00, 0x0A7F)],
    "gujarati": [(0x0A80, 0x0AFF)],
    "tamil": [(0x0B80, 0x0BFF)],
    "telugu": [(0x0C00, 0x0C7F)],
    "kannada": [(0x0C80, 0x0CFF)],
    "malayalam": [(0x0D00, 0x0D7F)],
    "thai": [(0x0E00, 0x0E7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "ethiopic": [(0x1200, 0x137F)],
    "khmer": [(0x1780, 0x17FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
OTHER = len(SCRIPTS) + 1
_MARK = 255
#: Code points from here on share the class of the last one below.
_KNOWN = 0x32400

TABLES, BUCKETS = 4, 1 << 16  # groups of two, three and four letters, and words
#: A script holds at least this share of a language's letters, or words in it can't be of that language.
SCRIPT_SHARE = 0.01
_NOT_A_CANDIDATE = -1e4
#: Frequency that stands for a group never seen in a language: the same for all, whatever their share of the training texts.
_FLOOR = 1e-6
#: Words of a block, and the numbers that the matrices of all blocks may hold.
BLOCK, MATRIX_CELLS = 128, 4_000_000


@lru_cache(maxsize=1)
def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """Class of each code point (0: no letter, script, mark) and its lower case where that is one code point."""
    kind, lower = np.zeros(_KNOWN, np.uint8), np.arange(_KNOWN, dtype=np.uint32)
    script = np.full(_KNOWN, OTHER, np.uint8)
    for number, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            script[first : last + 1] = number
    for code in range(_KNOWN):
        category = unicodedata.category(chr(code))
        if category[0] == "L":
            kind[code] = script[code]
            small = chr(code).lower()
            if len(small) == 1:
                lower[code] = ord(small)
        elif category[0] == "M":
            kind[code] = _MARK
    return kind, lower


@dataclass(frozen=True)
class Words:
    """The words of some texts, one after another: maximal runs of letters of one script, with the marks on them."""

    text: np.ndarray  # number of the word's text
    start: np.ndarray  # offsets in its text, in code points
    stop: np.ndarray
    script: np.ndarray
    groups: tuple[np.ndarray, ...]  # buckets of two, three and four letters, by letter
    ends: np.ndarray  # buckets of the last letter with the word's end
    first: np.ndarray  # number of the word's first letter
    whole: np.ndarray  # bucket of the word

    def __len__(self) -> int:
        return len(self.text)


def _bucket(values: np.ndarray) -> np.ndarray:
    """Multiplicative hash of 64-bit numbers to BUCKETS."""
    return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)


def words_of(texts: list[str]) -> Words:
    kind_of, lower = _code_points()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    # One code point between the texts keeps them apart.
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32)
    offsets = np.cumsum(lengths + 1) - lengths - 1
    codes = np.minimum(codes, _KNOWN - 1)
    kind = kind_of[codes]
    if (marks := kind == _MARK).any():
        place = np.where(marks, 0, np.arange(len(kind)))
        kind = kind[np.maximum.accumulate(place)]
        kind = np.where(kind == _MARK, 0, kind)
    letter = np.flatnonzero(kind)
    own = kind[letter]
    breaks = np.ones(len(letter), bool)
    breaks[1:] = (np.diff(letter) != 1) | (own[1:] != own[:-1])
    first = np.flatnonzero(breaks)
    count = np.diff(np.append(first, len(letter)))
    word = np.repeat(np.arange(len(first)), count)
    position = np.arange(len(letter)) - first[word] if len(first) else np.zeros(0, np.int64)
    c = lower[codes[letter]].astype(np.uint64) + np.uint64(1)

    def earlier(k: int) -> np.ndarray:
        back = np.zeros_like(c)
        back[k:] = c[:-k] if len(c) > k else c[:0]
        return np.where(position >= k, back, np.uint64(0))

    p1, p2, p3 = earlier(1), earlier(2), earlier(3)
    a, b, d = np.uint64(1 << 18), np.uint64(1 << 36), np.uint64(0xC2B2AE3D27D4EB4F)
    two, three = c + p1 * a, c + p1 * a + p2 * b
    groups = (_bucket(two), _bucket(three + np.uint64(1)), _bucket(three + p3 * d + np.uint64(2)))
    last = first + count - 1
    ends = _bucket(c[last] * a + p1[last] * b + np.uint64(3)) if len(first) else np.zeros(0, np.int64)
    mixed = (c + position.astype(np.uint64) * a) * d
    mixed ^= mixed >> np.uint64(29)
    whole = _bucket(np.add.reduceat(mixed * np.uint64(0x165667B19E3779F9), first)) if len(first) else np.zeros(0, np.int64)
    begin = letter[first]
    text = np.searchsorted(offsets, begin, side="right") - 1
    start = begin - offsets[text]
    return Words(text, start, start + count, own[first], groups, ends, first, whole)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    prior: np.ndarray  # log share of the training rows
    scores: np.ndarray  # (table, bucket, language)
    candidate: np.ndarray  # (script, language)

    def word_scores(self, words: Words) -> np.ndarray:
        """Log scores (word, language); far below all others where the script rules a language out."""
        if not len(words):
            return np.zeros((0, len(self.languages)))
        letters = self.scores[0][words.groups[0]]
        for table in (1, 2):
            letters = letters + self.scores[table][words.groups[table]]
        total = np.add.reduceat(letters, words.first, axis=0) + self.scores[1][words.ends] + self.scores[3][words.whole]
        # Groups overlap: a letter is in about three of them.
        return np.where(self.candidate[words.script], total / 3.0, _NOT_A_CANDIDATE)


def best_path(scores: np.ndarray, counts: np.ndarray, penalty: float, start: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Labels of the words that maximise the sum of their scores less `penalty` for each change of label, text by text.

    `counts` says how many of the words (in order) each text has; `start` scores the label before the first. Exact for any length.
    """
    n, labels = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    block = max(block, -(-n * labels * labels // MATRIX_CELLS))
    parts = -(-counts // block)
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(np.cumsum(counts) - counts, parts) + number * block
    length = np.minimum(block, np.repeat(counts, parts) - number * block)
    # Longest first, so that the blocks that still have a word are always a prefix.
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    active = len(length) - np.searchsorted(length[::-1], np.arange(block), side="right")
    active = active[active > 0]

    ahead = np.where(np.eye(labels, dtype=bool), 0.0, -penalty)[None].repeat(len(begin), axis=0)
    for at, m in enumerate(active):
        if at:
            best = ahead[:m].max(axis=2, keepdims=True) - penalty
            np.maximum(ahead[:m], best, out=ahead[:m])
        ahead[:m] += scores[begin[:m] + at][:, None, :]

    where = np.empty(len(order), np.int64)
    where[order] = np.arange(len(order))
    first_part = np.cumsum(parts) - parts
    held = np.flatnonzero(parts)
    entry = np.empty((len(order), labels))
    state = np.tile(start, (len(held), 1))
    by_parts = held[np.argsort(-parts[held], kind="stable")]
    longest = int(parts.max())
    open_texts = len(by_parts) - np.searchsorted(parts[by_parts][::-1], np.arange(longest), side="right")
    for k, m in enumerate(open_texts):
        place = where[first_part[by_parts[:m]] + k]
        entry[place] = state[:m]
        state[:m] = (state[:m, :, None] + ahead[place]).max(axis=1)

    back = np.empty((n, labels), np.int16)
    value, own = entry, np.arange(labels)
    for at, m in enumerate(active):
        top = value[:m].argmax(axis=1)
        change = value[np.arange(m), top][:, None] - penalty
        back[begin[:m] + at] = np.where(value[:m] >= change, own, top[:, None])
        value[:m] = np.maximum(value[:m], change) + scores[begin[:m] + at]

    # For each label at the end of a block, the labels before it; `came` ends as the label before the block.
    paths = np.empty((n, labels), np.int16)
    came = np.tile(own, (len(begin), 1))
    for at in range(len(active) - 1, -1, -1):
        m = active[at]
        paths[begin[:m] + at] = came[:m]
        came[:m] = np.take_along_axis(back[begin[:m] + at], came[:m], axis=1)
    chosen = np.empty(len(order), np.int64)
    label = state.argmax(axis=1)
    for k in range(longest - 1, -1, -1):
        m = open_texts[k]
        place = where[first_part[by_parts[:m]] + k]
        chosen[place] = label[:m]
        label[:m] = came[place, label[:m]]
    of_word = np.repeat(chosen[where], length[where])
    return paths[np.arange(n), of_word].astype(np.int64)


def identify(model: Model, texts: list[str], penalty: float) -> pa.StructArray:
    """Predicted language, score and spans of each text."""
    names = np.array([*model.languages, UNKNOWN], object)
    words = words_of(texts) if model.languages else words_of([])
    scores = model.word_scores(words)
    counts = np.bincount(words.text, minlength=len(texts)) if len(words) else np.zeros(len(texts), np.int64)
    path = best_path(scores, counts, penalty, model.prior)
    size, languages = words.stop - words.start, len(model.languages)
    letters = np.bincount(words.text * languages + path, size, len(texts) * languages).reshape(len(texts), languages) if len(words) else np.zeros((len(texts), max(1, languages)))
    top = letters.argmax(axis=1)
    some = counts > 0
    share = letters[np.arange(len(texts)), top] / np.maximum(letters.sum(axis=1), 1)
    # How much better than any other language the prediction fits the words that it labels.
    margin = np.full(len(texts), np.inf)
    if languages > 1 and len(words):
        mine = path == top[words.text]
        sums = np.stack([np.bincount(words.text[mine], scores[mine, i], len(texts)) for i in range(languages)], axis=1)
        own = sums[np.arange(len(texts)), top].copy()
        sums[np.arange(len(texts)), top] = -np.inf
        margin = own - sums.max(axis=1)
    score = np.where(some, share / (1 + np.exp(-np.clip(margin, -50, 50))), 0.0)

    breaks = np.ones(len(words), bool)
    breaks[1:] = (path[1:] != path[:-1]) | (words.text[1:] != words.text[:-1])
    begins = np.flatnonzero(breaks)
    lasts = np.append(begins[1:], len(words))[: len(begins)] - 1
    spans = pa.StructArray.from_arrays(
        [pa.array(words.start[begins], pa.int64()), pa.array(words.stop[lasts] if len(begins) else words.stop[:0], pa.int64()), pa.array(names[path[begins]], pa.string())],
        ["start", "end", "lang"],
    )
    per_text = np.bincount(words.text[begins], minlength=len(texts)) if len(begins) else np.zeros(len(texts), np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_text)]), pa.int32()), spans)
    return pa.StructArray.from_arrays(
        [pa.array(names[np.where(some, top, languages)], pa.string()), pa.array(score, pa.float64()), lists], ["lang", "score", "spans"]
    )


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())]))
RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", SPAN)])


def languages_of(model: Model, text: Column, penalty: float = 8.0) -> Column:
    """Struct of `lang`, `score` and `spans` (`start`, `end` in code points, `lang`) of the whole text.

    The language is the one with most letters; `und` without any letter, or without a learned language. The score is the share of letters
    with that label, times the probability against the next best language by the words' scores. A null text is an empty one.
    """

    @F.arrow_udf(RESULT)
    def label(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in batches:
            parts = slices([pa.record_batch([array], names=["t"])], "t", 2_000_000)
            found = [identify(model, p.column(0).to_pylist(), penalty) for p in parts]
            yield pa.concat_arrays(found) if found else identify(model, [], penalty)

    return label(F.coalesce(text, F.lit("")))


# -- training ----------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Whether the row is kept from training: crc32 of the id as text leaves 2 by 4. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the buckets (tables 0 to 3) and of letters by script (table 4) by language, for the texts of one partition."""
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in slices(batches, "text", 2_000_000):
        by_language: dict[str, list[str]] = {}
        for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            by_language.setdefault(language, []).append(text)
        for language, texts in by_language.items():
            words = words_of(texts)
            tables, scripts = sums.setdefault(language, (np.zeros((TABLES, BUCKETS), np.int64), np.zeros(OTHER + 1, np.int64)))
            for table, buckets in enumerate((words.groups[0], np.concatenate([words.groups[1], words.ends]), words.groups[2], words.whole)):
                tables[table] += np.bincount(buckets, minlength=BUCKETS)
            scripts += np.bincount(words.script, words.stop - words.start, OTHER + 1).astype(np.int64)
    for language, (tables, scripts) in sums.items():
        for table, counts in enumerate([*tables, scripts]):
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pandas(
                pd.DataFrame({"lang": language, "part": np.int32(table), "bucket": seen, "n": counts[seen]}), preserve_index=False
            )


def fit(documents: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most_rows: int = 20_000) -> Model:
    """Learn from rows with an id, a text and a language that aren't held out.

    `most_rows` bounds the texts that are read for training: about an equal number of each language, chosen by a hash of the id, as
    whole texts. Shares of languages are counted over all rows. Only counts by bucket reach the driver, whose number depends on
    languages and buckets; buckets seen once in a language are left out. Without rows nothing is learned.
    """
    rows = documents.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id"))
    )
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros(0), np.zeros((TABLES, BUCKETS, 0), np.float32), np.ones((OTHER + 1, 0), bool))
    each, parts = -(-most_rows // len(languages)), 1 << 30
    limits = documents.sparkSession.createDataFrame([(c, min(parts, parts * each // n)) for c, n in totals.items()], "lang string, most long")
    chosen = rows.join(F.broadcast(limits), "lang").filter(F.pmod(F.xxhash64("id", F.lit(13)), F.lit(parts)) < F.col("most"))
    counted = chosen.select("lang", "text").mapInArrow(_counted, "lang string, part int, bucket long, n long")
    found = counted.groupBy("lang", "part", "bucket").agg(F.sum("n").alias("n")).filter("n > 1 or part = 4").toPandas()
    number = {c: i for i, c in enumerate(languages)}
    counts = np.zeros((TABLES, BUCKETS, len(languages)))
    scripts = np.zeros((OTHER + 1, len(languages)))
    column = found["lang"].map(number).to_numpy(np.int64)
    part, bucket, n = (found[c].to_numpy(np.int64) for c in ("part", "bucket", "n"))
    counts[part[part < TABLES], bucket[part < TABLES], column[part < TABLES]] = n[part < TABLES]
    scripts[bucket[part == TABLES], column[part == TABLES]] = n[part == TABLES]
    shares = scripts / np.maximum(scripts.sum(axis=0), 1)
    candidate = shares >= SCRIPT_SHARE
    candidate[~candidate.any(axis=1)] = True
    frequency = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    scores = np.log(frequency + _FLOOR).astype(np.float32)
    prior = np.log(np.array([totals[c] for c in languages]) / sum(totals.values()))
    return Model(languages, prior, scores, candidate)


def identify_languages(documents: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text", penalty: float = 8.0) -> DataFrame:
    """Adds `held_out`, `lang_pred`, `score` and `spans` to every row, replacing columns of these names. Only the text is read for them."""
    found = documents.withColumns({"held_out": held_out(F.col(doc_id)), "_found": languages_of(model, F.col(text), penalty)})
    return found.withColumns({"lang_pred": F.col("_found.lang"), "score": F.col("_found.score"), "spans": F.col("_found.spans")}).drop("_found")
