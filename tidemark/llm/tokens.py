"""Token counts of whole texts; huge texts go in overlapping chunks that are spliced where both encodings must agree."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import slices

CHUNK = 1 << 16
OVERLAP = 1 << 9
MARK = "▁"


def public_path(name: str) -> str:
    """Place of a vocabulary file of the installed package, on whichever machine asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """A sentencepiece model, and whether its texts may be spliced.

    A boundary before a single space between two other characters is stable if no piece holds the space mark after another
    character and if the normaliser leaves characters as they are: no merge can then cross it, whatever stands on either side.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        inner = any(a != MARK and b == MARK for p in pieces for a, b in zip(p, p[1:], strict=False))
        sample = "  Aｋé é  b\t c "
        same = self.model.normalize(sample) == MARK + sample.replace(" ", MARK)
        self.splices = same and not inner

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def begins(self, data: bytes) -> list[int]:
        """Where the tokens begin, in bytes."""
        return [p.begin for p in self.model.encode(data.decode(), return_type="proto").pieces]


def stable(data: bytes, low: int, high: int) -> int | None:
    """The last place in [low, high) of a single space between two characters that are neither spaces nor space marks."""
    mark = MARK.encode()
    at = data.rfind(b" ", low, high)
    while at >= 0:
        if 0 < at < len(data) - 1 and data[at - 1 : at] != b" " != data[at + 1 : at + 2]:
            if data[max(0, at - 3) : at] != mark != data[at + 1 : at + 4]:
                return at
        at = data.rfind(b" ", low, at)
    return None


def long_count(encoder: Encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a huge text; `chunk` and `overlap` in bytes.

    Chunks overlap; tokens of the left chunk count up to a stable place in the overlap, those of the right chunk from there on,
    provided that in both encodings a token begins there. If the overlap has no such place it is doubled, and then the chunk.
    """
    data = text.encode()
    if not encoder.splices or len(data) <= chunk:
        return encoder.counts([text])[0]
    # Of the chunk from `start`, tokens from place `shift` on count: the chunk to the left counts those before.
    total, start, shift, size = 0, 0, 0, chunk
    while True:
        end = min(len(data), start + size)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        left = [start + b for b in encoder.begins(data[start:end])]
        places = set(left)
        if shift and shift not in places and start != shift + 1:
            return encoder.counts([text])[0]
        if end == len(data):
            return total + sum(b >= shift for b in left)
        at, wide = None, overlap
        while at is None:
            low = max(shift + 1, end - wide)
            at = stable(data, low, end - 1)
            if at is not None and at not in places:
                at = None
            if low == shift + 1:
                break
            wide *= 2
        if at is None:
            size *= 2
            continue
        # The right chunk begins at a stable place of its own before, so that the two overlap around the place of the splice.
        before = stable(data, max(shift + 1, at - overlap), at)
        total += sum(shift <= b < at for b in left)
        start, shift, size = (at if before is None else before) + 1, at, chunk


def count_tokens(
    df: DataFrame,
    *,
    model: str = "piece_bpe_32k.model",
    text: str = "text",
    limit: int = 4096,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Adds `n_bytes`, `n_tokens` and `over_limit` to every row; the other columns stay in the JVM.

    `model` is a path, or a file name of the installed vocabulary package. A null text counts as empty: no bytes, no tokens. Each
    row is counted by itself, so repeated rows and empty tables are nothing special. Columns of these names are replaced.
    """

    @F.arrow_udf(T.LongType())
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(model if "/" in model else public_path(model))
        for array in batches:
            out: list[int] = []
            for part in slices([pa.record_batch([array], names=["t"])], "t", 4_000_000):
                texts = [x or "" for x in part.column(0).to_pylist()]
                short = iter(encoder.counts([x for x in texts if len(x) <= chunk]))
                out.extend(next(short) if len(x) <= chunk else long_count(encoder, x, chunk, overlap) for x in texts)
            yield pa.array(out, pa.int64())

    return df.withColumns({
        "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint"),
        "n_tokens": tokens(F.coalesce(F.col(text), F.lit(""))),
    }).withColumn("over_limit", F.col("n_tokens") > limit)
