"""Quality rules: compression bands.

zstandard ratios (raw bytes over compressed bytes) of the whole text and of fixed chunks place a document in a band.
Repetitive text compresses far better than prose of its length, random text far worse; the limits depend on the length,
since a longer text always compresses better.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from priceloom.llm.common import append_columns, packs, text_bytes, window_hashes, word_hashes

#: (bytes below which a row holds, least ratio, greatest ratio); the last row holds for all longer texts.
BANDS: tuple[tuple[int, float, float], ...] = (
    (256, 0.70, 2.2),
    (512, 0.95, 2.5),
    (1024, 1.00, 2.7),
    (2048, 1.15, 2.9),
    (4096, 1.20, 3.1),
    (16384, 1.30, 3.4),
    (1 << 62, 1.40, 3.8),
)
CHUNK_BYTES = 4096
#: Limits of one chunk, and the share of a text's chunks that may lie outside them. The last chunk ends with the text.
CHUNK_BAND = (1.20, 3.3)
BAD_CHUNK_SHARE = 0.34
LEVEL = 3

_SYMBOLS = b"#*$%&|<>"
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("word_chars", T.LongType()),
    T.StructField("n_symbols", T.LongType()),
    T.StructField("n_dup_lines", T.LongType()),
    T.StructField("n_repeat_words", T.LongType()),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("ratio", T.DoubleType()),
    T.StructField("n_chunks", T.LongType()),
    T.StructField("n_bad_chunks", T.LongType()),
]


def duplicate_lines(blob: bytes) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in blob.split(b"\n") if x.strip(b"\x20\x09\x0b\x0c\x0d")]
    return len(lines) - len(set(lines))


def repeated_words(words: np.ndarray, n: int = 8) -> int:
    """Words that stand in a run of n words found twice or more."""
    grams = window_hashes(words, n)
    if len(grams) < 2:
        return 0
    order = np.argsort(grams, kind="stable")
    same = grams[order][1:] == grams[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(grams), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + n, -1)
    return int((np.cumsum(edges) > 0).sum())


def in_band(size: int, ratio: float, bands: Sequence[tuple[int, float, float]] = BANDS) -> bool:
    for below, low, high in bands:
        if size < below:
            return low <= ratio <= high
    return True


def compression_bands(
    df: DataFrame,
    text_col: str = "text",
    bands: Sequence[tuple[int, float, float]] = BANDS,
    chunk_bytes: int = CHUNK_BYTES,
    chunk_band: tuple[float, float] = CHUNK_BAND,
    bad_chunk_share: float = BAD_CHUNK_SHARE,
    min_words: int = 20,
) -> DataFrame:
    """Every row with its base counts, its compression figures and the verdict `kept`; one pass, no shuffle.

    A null or empty text has no words: base_failed is true and kept false. Repeated rows get equal verdicts. Columns of
    the names added here are replaced, all others pass through. An empty table gives an empty table.
    """

    def rate(batch: pa.RecordBatch) -> list[pa.Array]:
        blobs = text_bytes(batch, text_col)
        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        is_symbol = np.zeros(256, bool)
        is_symbol[list(_SYMBOLS)] = True
        rows: list[tuple] = []
        for lo, hi in packs(blobs):
            part = blobs[lo:hi]
            hashes, starts, ends, first = word_hashes(part)
            data = np.frombuffer(b" ".join(part) + b" ", np.uint8)
            points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
            chars = np.concatenate(([0], np.cumsum(points[ends] - points[starts])))
            symbols = np.concatenate(([0], np.cumsum(is_symbol[data])))
            at = 0
            for i, blob in enumerate(part):
                a, b = first[i], first[i + 1]
                words = int(b - a)
                repeats = repeated_words(hashes[a:b])
                failed = words < min_words or 100 * repeats > 30 * words
                ratio = len(blob) / len(squeeze(blob)) if blob else 0.0
                chunks = [blob[j : j + chunk_bytes] for j in range(0, len(blob) - chunk_bytes + 1, chunk_bytes)]
                if chunks and len(blob) % chunk_bytes:
                    chunks.append(blob[-chunk_bytes:])
                bad = sum(not chunk_band[0] <= chunk_bytes / len(squeeze(c)) <= chunk_band[1] for c in chunks)
                kept = not failed and in_band(len(blob), ratio, bands) and bad <= bad_chunk_share * len(chunks)
                rows.append(
                    (words, int(chars[b] - chars[a]), int(symbols[at + len(blob)] - symbols[at]), duplicate_lines(blob), repeats, failed, kept, ratio, len(chunks), bad)
                )
                at += len(blob) + 1
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(FIELDS)
        kinds = {"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
        return [pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(columns, FIELDS, strict=True)]

    return append_columns(df, FIELDS, rate)
