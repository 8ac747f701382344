"""Suffix-array deduplication: byte strings that occur twice, by column-wise construction of collection BWTs."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import is_empty, row_keys, slices, stored, whole

LENGTH = 400
GRAM = 32
RANGE = 46
#: Different pieces around one shared core that are put into one collection; more are compared window by window in a shuffle.
CORE_LIMIT = 4096
COLLECTION = 1024
CHUNK = 1 << 20
_END = 0xFFFF
_ODD = 0x9E3779B97F4A7C15


def _range_minima(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The minimum of a[low:high] for each pair, none empty."""
    order = np.argsort(low, kind="stable")
    edges = np.empty(2 * len(low), np.int64)
    edges[0::2], edges[1::2] = low[order], high[order]
    out = np.empty(len(low), a.dtype)
    out[order] = np.minimum.reduceat(np.append(a, a[:1]), edges)[::2]
    return out


def collection(documents: list[np.ndarray], cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The Burrows-Wheeler transform of a collection and the common prefixes of neighbouring suffixes, up to `cap`.

    A document is an array of symbols below 65535, which stands for the end.

    Round j inserts the suffix of length j of every document that is that long, by its first symbol: a new suffix stands
    among those with the same first symbol as the suffix without it stands among the suffixes after that symbol. The common prefix of a
    new suffix and a neighbour with the same first symbol is one more than the minimum of the common prefixes between
    the two without it. Both columns are kept in files that each round reads and writes from start to end. Documents end in
    markers that differ, in their order.
    """
    n_docs = len(documents)
    lengths = np.array([len(d) for d in documents])
    longest = int(lengths.max(initial=0))
    columns = np.full((longest + 1, n_docs), _END, np.uint16)
    for i, d in enumerate(documents):
        columns[: len(d), i] = d[::-1]
    bwt, lcp = columns[0].copy(), np.zeros(n_docs, np.uint16)
    place = np.arange(n_docs)
    with tempfile.TemporaryFile() as symbols, tempfile.TemporaryFile() as prefixes:
        bwt.tofile(symbols)
        lcp.tofile(prefixes)
        n = n_docs
        for j in range(1, longest + 1):
            symbols.seek(0)
            prefixes.seek(0)
            bwt, lcp = np.fromfile(symbols, np.uint16, n), np.fromfile(prefixes, np.uint16, n)
            order = np.argsort(bwt, kind="stable")
            rank = np.empty(n, np.int32)
            rank[order] = np.arange(n, dtype=np.int32)
            counts = np.bincount(bwt, minlength=_END + 1)
            ends = counts.cumsum()
            active = np.flatnonzero(lengths >= j)
            at = place[active]
            k, c = rank[at], bwt[at]
            new = n_docs + k.astype(np.int64)
            has_left, has_right = k > ends[c] - counts[c], k + 1 < ends[c]
            low = np.concatenate([order[k[has_left] - 1] + 1, at[has_right] + 1])
            high = np.concatenate([at[has_left] + 1, order[k[has_right] + 1] + 1])
            minima = np.minimum(_range_minima(lcp, low, high).astype(np.int64) + 1, cap) if len(low) else low
            own = np.zeros(len(active), np.uint16)
            own[has_left] = minima[: has_left.sum()]
            old = np.ones(n + len(active), bool)
            old[new] = False
            bwt2, lcp2 = np.empty(len(old), np.uint16), np.empty(len(old), np.uint16)
            bwt2[old], lcp2[old] = bwt, lcp
            bwt2[new] = columns[j, active]
            after, value = new[has_right] + 1, minima[has_left.sum() :]
            kept = old[after]
            lcp2[after[kept]] = value[kept]
            lcp2[new] = own
            place[active] = new
            n = len(old)
            symbols.seek(0)
            prefixes.seek(0)
            bwt2.tofile(symbols)
            lcp2.tofile(prefixes)
            bwt, lcp = bwt2, lcp2
    return bwt, lcp


def repeated_windows(documents: list[np.ndarray], length: int = LENGTH) -> list[np.ndarray]:
    """For each document, whether the string of `length` symbols at each place also starts elsewhere in the collection."""
    bwt, lcp = collection(documents, length)
    found = [np.zeros(max(0, len(d) - length + 1), bool) for d in documents]
    if not documents:
        return found
    twin = (lcp >= length) | np.append(lcp[1:] >= length, False)
    step = np.empty(len(bwt), np.int64)
    step[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
    at = np.arange(len(documents))
    lengths = np.array([len(d) for d in documents])
    for j in range(1, int(lengths.max()) + 1):
        active = np.flatnonzero(lengths >= j)
        at[active] = len(documents) + step[at[active]]
        if j >= length:
            for i in active[twin[at[active]]]:
                found[i][lengths[i] - j] = True
    return found


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` (a power of two) bytes at each place."""
    with np.errstate(over="ignore"):
        h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        factor, n = np.uint64(_ODD), 1
        while n < size:
            h = h[:-n] * factor + h[n:]
            factor, n = factor * factor, 2 * n
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _sliding_minimum(a: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        a, n = np.minimum(a[:-n], a[n:]), 2 * n
    return np.minimum(a[: len(a) - (width - n)], a[width - n :]) if width > n else a


def anchored(data: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of windows with one anchor: first window, window after the last, place and hash of the anchor.

    The anchor of a window is the leftmost of its grams with the smallest hash, so equal windows have it at the same distance and with the
    same hash. Ties in the leading 40 bits go to the leftmost too.
    """
    h = _gram_hashes(data, gram)
    places = np.uint64((1 << 24) - 1)
    least = _sliding_minimum((h & ~places) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    place = (least[first] & places).astype(np.int64)
    return first, np.append(first[1:], len(least)), place, h[place].view(np.int64)


def _digest(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


_PIECES = T.StructType([
    T.StructField("key1", T.LongType()), T.StructField("key2", T.LongType()), T.StructField("start", T.IntegerType()),
    T.StructField("n", T.IntegerType()), T.StructField("offset", T.IntegerType()), T.StructField("anchor", T.LongType()),
    T.StructField("piece", T.LongType()),
])


def _scan(length: int, rows: int = 50_000):
    """Pieces of every whole text; long texts go in overlapping chunks, which may cut a piece in two."""
    def made(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_PIECES.fieldNames())

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in slices([batch], "text", 1_000_000):
                texts = part.column("text").cast(pa.binary())
                for key1, key2, value in zip(part.column("key1").to_pylist(), part.column("key2").to_pylist(), texts, strict=True):
                    text = value.as_py()
                    for low in range(0, len(text) - length + 1, CHUNK):
                        data = text[low : low + CHUNK + length - 1]
                        first, last, place, anchor = anchored(np.frombuffer(data, np.uint8), length)
                        ends = zip(first.tolist(), (last + (length - 1)).tolist(), strict=True)
                        digests = np.fromiter((_digest(data[a:b]) for a, b in ends), np.int64, len(first))
                        held.append((
                            np.full(len(first), key1), np.full(len(first), key2), (first + low).astype(np.int32),
                            (last - first).astype(np.int32), (place - first).astype(np.int32), anchor, digests))
                        n += len(first)
                        if n >= rows:
                            yield made(held)
                            held, n = [], 0
        if held:
            yield made(held)

    return scan


_CUTS = "piece long, copies long, offset int, data binary"


def _cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted pieces of each text."""
    for batch in slices(batches, "text", 2_000_000):
        out: list[list] = [[], [], [], []]
        for text, wanted in zip(batch.column("text").cast(pa.binary()), batch.column("wanted").to_pylist(), strict=True):
            data = text.as_py()
            for w in wanted:
                out[0].append(w["piece"])
                out[1].append(w["copies"])
                out[2].append(w["offset"])
                out[3].append(data[w["start"] : w["stop"]])
                if len(out[0]) >= 4096:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)],
                        names=["piece", "copies", "offset", "data"])
                    out = [[], [], [], []]
        if out[0]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)],
                names=["piece", "copies", "offset", "data"])


_SUBS = "piece long, copies long, first int, n int, lead int, core long, sub long"


def _split(length: int, width: int):
    """Windows of a piece by ranges of the anchor's distance: all windows of a range hold a core around the anchor.

    Equal windows have equal cores. `first` and `n` are the range's windows in the piece, `sub` names the bytes under them, and
    the core begins `lead` bytes after their start.
    """
    def made(out: list[list]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["piece", "copies", "first", "n", "lead", "core", "sub"])

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            columns = (batch.column(x).to_pylist() for x in ("piece", "copies", "offset", "data"))
            for piece, copies, offset, data in zip(*columns, strict=True):
                windows = len(data) - length + 1
                # A window that starts at s has its anchor at distance offset - s.
                for r in range((offset - windows + 1) // width, offset // width + 1):
                    first, last = max(0, offset - (r + 1) * width + 1), min(windows - 1, offset - r * width)
                    begin, end = offset - r * width, offset - (r + 1) * width + 1 + length
                    row = (piece, copies, first, last - first + 1, begin - first,
                           _digest(data[begin:end] + r.to_bytes(4)), _digest(data[first : last + length]))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                if len(out[0]) >= 20_000:
                    yield made(out)
                    out = [[] for _ in range(7)]
            yield made(out)

    return split


_RUNS = "core long, sub long, low int, high int"


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True))


def _search(length: int, width: int, size: int):
    """Repeated windows of collections of whole cores. The rows of a task come sorted by core.

    All windows of a sub-piece hold its core, so the core is one symbol, the same for all that share it, and a window is `width` symbols.
    """
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def judged(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
            out: list[list] = [[], [], [], []]
            numbers = {core: 256 + i for i, core in enumerate(dict.fromkeys(r[0] for r in rows))}
            documents = []
            for core, _, lead, data in rows:
                symbols = np.frombuffer(data, np.uint8).astype(np.uint16)
                documents.append(np.concatenate([symbols[:lead], [numbers[core]], symbols[lead + length + 1 - width :]]).astype(np.uint16))
            for (core, sub, _, _), flags in zip(rows, repeated_windows(documents, width), strict=True):
                for low, high in _runs(flags):
                    for column, value in zip(out, (core, sub, low, high), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["core", "sub", "low", "high"])

        held: list[tuple[int, int, int, bytes]] = []
        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("core", "sub", "lead", "data")), strict=True):
                if len(held) >= size and held[-1][0] != row[0]:
                    yield judged(held)
                    held = []
                held.append(row)
        if held:
            yield judged(held)

    return search


def _windows(length: int):
    """Every window of a piece by its hash, for cores that too many pieces share."""
    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for core, sub, data in zip(*(batch.column(x).to_pylist() for x in ("core", "sub", "data")), strict=True):
                n = len(data) - length + 1
                digests = [hashlib.blake2b(data[i : i + length], digest_size=16).digest() for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([core] * n, pa.int64()), pa.array([sub] * n, pa.int64()), pa.array(range(n), pa.int32()),
                     pa.array(digests, pa.binary())], names=["core", "sub", "at", "digest"])

    return windows


def repeated_spans(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, core_limit: int = CORE_LIMIT,
    size: int = COLLECTION,
) -> DataFrame:
    """`key1`, `key2` and `spans`, an array of (start, stop) in bytes, of each row key with a repeated string of `length` bytes.

    Spans may overlap. Equal windows have the same anchor at the same distance, so only pieces with the same anchor are compared:

    1. pieces whose anchor occurs once hold no repeated window; if all pieces of an anchor are equal, all windows are repeated;
    2. of the other pieces, each text is kept once with its number of copies, and cut into overlapping sub-pieces whose windows share a
       core of nearly `length` bytes. Again a core with one text only is decided by the number of copies;
    3. of the rest, whole cores are gathered into collections of about `size` sub-pieces. The column-wise construction of their
       Burrows-Wheeler transform and common prefixes tells which windows occur twice. A core shared by more than `core_limit`
       texts is not gathered in one task: its windows are counted by digest in a shuffle.
    """
    width = min(RANGE, length - GRAM)
    docs = df.select(*(c.alias(n) for n, c in row_keys(doc_id, text).items()), whole(text).alias("text"))
    docs = docs.filter(F.octet_length("text") >= length)
    pieces = stored(docs.mapInArrow(_scan(length), _PIECES), "pieces")
    anchors = pieces.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("times"), F.min("piece").alias("least"), F.max("piece").alias("most")
    ).filter("times > 1").select("anchor", (F.col("least") != F.col("most")).alias("several"))
    # Joined as tables, so that adaptive execution can split an anchor, core or piece that a large share of all rows have.
    marked = stored(pieces.join(stored(anchors, "anchors"), "anchor"), "marked")
    stop = F.col("start") + F.col("n") + (length - 1)
    sure = marked.filter("not several").select("key1", "key2", F.array(F.struct("start", stop.alias("stop"))).alias("spans"))

    # The name of a piece includes its anchor: equal bytes can only meet there.
    open_ = marked.filter("several").withColumn("piece", F.xxhash64("anchor", "piece", "n", "offset"))
    chosen = open_.groupBy("piece").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("key1", "key2", "start", stop.alias("stop"), "offset")).alias("one"))
    wanted = chosen.groupBy("one.key1", "one.key2").agg(
        F.collect_list(F.struct("piece", "copies", "one.offset", "one.start", "one.stop")).alias("wanted"))
    texts = docs.dropDuplicates(["key1", "key2"]) if _repeats(docs) else docs
    cuts = stored(texts.join(wanted, ["key1", "key2"]).select("text", "wanted").mapInArrow(_cut, _CUTS), "cuts")
    subs = stored(cuts.mapInArrow(_split(length, width), _SUBS), "subs")

    kinds = stored(subs.groupBy("core", "sub").agg(
        F.sum("copies").alias("copies"), F.min(F.struct("piece", "first", "n", "lead")).alias("one")), "kinds")
    cores = stored(kinds.groupBy("core").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1"), "cores")
    found = kinds.filter("copies > 1").select("core", "sub", F.lit(0).alias("low"), F.col("one.n").alias("high"))
    mixed = kinds.join(cores, "core").select("core", "sub", "texts", F.col("one.piece").alias("piece"), "one.first", "one.n", "one.lead")
    bytes_of = F.expr(f"substring(data, first + 1, n + {length - 1})")
    mixed = stored(mixed.join(cuts, "piece").select("core", "sub", "texts", "lead", bytes_of.alias("data")), "mixed")
    rest = mixed.filter(F.col("texts") <= core_limit).select("core", "sub", "lead", "data")
    found = found.unionByName(rest.repartition("core").sortWithinPartitions("core").mapInArrow(_search(length, width, size), _RUNS))
    many = mixed.filter(F.col("texts") > core_limit).select("core", "sub", "data")
    if not is_empty(many):
        each = stored(many.mapInArrow(_windows(length), "core long, sub long, at int, digest binary"), "windows")
        twice = each.groupBy("digest").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("digest")
        found = found.unionByName(
            each.join(twice, "digest").select("core", "sub", F.col("at").alias("low"), (F.col("at") + 1).alias("high")))

    runs = subs.join(stored(found, "runs"), ["core", "sub"]).groupBy("piece").agg(
        F.collect_set(F.struct((F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high")).alias("high"))).alias("runs"))
    placed = open_.join(stored(runs, "repeats"), "piece").select(
        "key1", "key2",
        F.transform("runs", lambda x: F.struct(
            (F.col("start") + x["low"]).alias("start"), (F.col("start") + x["high"] + (length - 1)).alias("stop"))).alias("spans"))
    # A set: rows that repeat an id and its text share a row key, and each brings the spans of the same pieces.
    return sure.unionByName(placed).groupBy("key1", "key2").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def _repeats(docs: DataFrame) -> bool:
    return not is_empty(docs.groupBy("key1", "key2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))


_KEPT = T.StructType([
    T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
    T.StructField("kept", T.BinaryType()),
])


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs: spans that overlap or touch become one."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    first = np.append(True, start[1:] > reach[:-1])[: len(start)]
    return start[first], reach[np.append(first[1:], True)[: len(start)]]


def _remove(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, spans in batches:
        # The spans stay in Arrow's arrays: a text of short periods has one for each few bytes.
        counts = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = spans.flatten()
        starts, stops = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        ends = counts.cumsum()
        out: list[list] = [[], [], [], []]
        for value, low, high in zip(texts.cast(pa.binary()), (ends - counts).tolist(), ends.tolist(), strict=True):
            text, at, kept = value.as_py() or b"", 0, []
            begin, end = merged(starts[low:high], stops[low:high])
            for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            for column, x in zip(out, (len(text), int((end - begin).sum()), len(begin), b"".join(kept)), strict=True):
                column.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        yield pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=_KEPT.fieldNames())


def remove_repeats(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Adds `n_bytes`, `n_removed`, `n_spans` and `kept`, the remaining bytes, to every row.

    Each byte under a string of `length` bytes that also starts anywhere else, in the same text or another, goes; strings are judged on
    the input. Bytes are those of UTF-8, so what is kept may cut a character. A null text counts as empty; texts shorter than
    `length` keep all; repeated rows are copies of each other like other equal texts. Columns of these names are replaced.
    """
    columns = [c for c in df.columns if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    spans = repeated_spans(df, doc_id=doc_id, text=text, **options)
    spans = spans.select(F.col("key1").alias("_key1"), F.col("key2").alias("_key2"), F.col("spans").alias("_spans"))
    keyed = df.withColumns({f"_{n}": c for n, c in row_keys(doc_id, text).items()}).join(spans, ["_key1", "_key2"], "left")
    remove = F.arrow_udf(_remove, _KEPT)
    return keyed.withColumn("_out", remove(whole(text), F.col("_spans"))).select(*columns, "_out.*")
