"""Substring dedup by content-defined chunking with a gear rolling hash.

A cut stands behind a blank whose gear hash of the last 16 bytes is the lowest of some WINDOW blanks in a row, so chunks
hold whole words, follow the content and fall into step again after an insertion. Any WINDOW blanks hold a cut, in
periodic text too: a repeated passage loses at most 16 bytes and WINDOW words before its first common cut and WINDOW
words behind its last, so spans of MIN_SPAN_WORDS words catch passages of over 50 words. Chunks of more than MAX_BYTES
are cut by the same rule at characters instead of blanks, and spans of MIN_SPAN_BYTES bytes count whatever their words.

Chunks hold a few words, and a stock phrase may be one, so runs of RUN chunks are compared, by digest: the first
occurrence, by (doc_id, text, place), stays; later ones are repeats. Repeated runs that begin at consecutive chunks, so
that each shares all but one chunk with the next, form a span, and spans of at least min_words words or min_bytes bytes
are dropped.

A digest has 64 bits and is compared together with the run's length in bytes. Two different runs agree in both with a
chance of about 1 in 10^21, so a collection of 10^11 chunks has a handful of such pairs; most of them are too short to
drop text alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceloom.llm.common import BLANKS, append_columns, fresh_name, packs, segment_hashes, separator_table, text_bytes, written

#: Blanks, or characters of a chunk of more than MAX_BYTES, of which the one with the lowest hash is a cut.
WINDOW = 8
CHARACTER_WINDOW = 32
MAX_BYTES = 256
MIN_SPAN_WORDS = 24
MIN_SPAN_BYTES = 256
#: Chunks whose digests are compared as one.
RUN = 3

_GEAR = np.random.default_rng(97).integers(0, 1 << 16, 256, dtype=np.uint16)
_BLANK = separator_table(BLANKS)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h = (h << 1) + gear[byte] in 16 bits, at every byte: a window of 16 bytes, built by doubling."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        shifted = h.copy()
        shifted[step:] += h[:-step] << np.uint16(step)
        h = shifted
    return h


def lowest(hashes: np.ndarray, window: int) -> np.ndarray:
    """Indices of the lowest hash, the last of equal ones, of every window."""
    if len(hashes) < window:
        return np.zeros(0, np.int64)
    last = len(hashes) - 1
    low = (hashes.astype(np.int64) << 32) + (last - np.arange(last + 1))
    done = 1
    while done < window:
        step = min(done, window - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    picked = np.zeros(last + 1, bool)
    picked[last - (low & 0xFFFFFFFF)] = True
    return np.flatnonzero(picked)


def chunk_ends(blob: bytes, window: int = WINDOW, max_bytes: int = MAX_BYTES, character_window: int = CHARACTER_WINDOW) -> np.ndarray:
    """Where the chunks of a text end; the last end is its length, an empty text has none."""
    if not blob:
        return np.zeros(0, np.int64)
    data = np.frombuffer(blob, np.uint8)
    hashes = gear_hashes(data)
    blank = _BLANK[data]
    at = np.flatnonzero(blank[:-1] & ~blank[1:])
    ends = np.append(at[lowest(hashes[at], window)] + 1, len(blob))
    starts = np.append(0, ends[:-1])
    more = [ends]
    for k in np.flatnonzero(ends - starts > max_bytes):
        inner = np.flatnonzero((data[starts[k] + 1 : ends[k]] & 0xC0) != 0x80) + starts[k]  # the next byte begins a character
        more.append(inner[lowest(hashes[inner], character_window)] + 1)
    return np.sort(np.concatenate(more)) if len(more) > 1 else ends


def chunks(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, text_hash, place, start, stop, first_word, last_word, digest) of every run of chunks of (doc_id, text_hash,
    text): its bytes start to stop, its words counted from the text's first. A text of fewer chunks is one run."""
    numbers = ("place", "start", "stop", "first_word", "last_word")
    schema = T.StructType([docs.schema["doc_id"], docs.schema["text_hash"], *[T.StructField(n, T.IntegerType()) for n in numbers], T.StructField("digest", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = text_bytes(batch, "text")
            for lo, hi in packs(blobs):
                part = blobs[lo:hi]
                data = np.frombuffer(b"".join(part), np.uint8)
                ends = [chunk_ends(b) for b in part]
                counts = np.array([len(e) for e in ends])
                if not counts.sum():
                    continue
                owner = np.repeat(np.arange(len(part)), counts)
                base = np.cumsum([0, *[len(b) for b in part]])[owner]
                stop = np.concatenate(ends)
                place = np.arange(len(stop)) - (np.cumsum(counts) - counts)[owner]
                start = np.where(place == 0, 0, np.roll(stop, 1))
                is_run = (place + run <= counts[owner]) | (place == 0)
                tail = np.minimum(place + run, counts[owner])[is_run] - 1 + (np.cumsum(counts) - counts)[owner[is_run]]
                place, start, stop, base, owner = place[is_run], start[is_run], stop[tail], base[is_run], owner[is_run]
                begins = ~_BLANK[data]
                begins[1:] &= _BLANK[data[:-1]]
                begins[base[place == 0]] = ~_BLANK[data[base[place == 0]]]
                words = np.concatenate(([0], np.cumsum(begins)))
                numbers_ = (place, start, stop, words[base + start] - words[base], words[base + stop] - words[base])
                digest = segment_hashes(data, base + start, base + stop)
                at = pa.array(lo + owner)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), *[pa.array(x.astype(np.int32)) for x in numbers_], pa.array(digest.view(np.int64))], names=schema.names
                )

    return docs.select("doc_id", "text_hash", "text").mapInArrow(cut, schema)


def _text_hash(text: Column) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(text.cast("string"))


def _documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), _text_hash(F.col(text_col)).alias("text_hash"))


def repeated_spans(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_SPAN_WORDS, min_bytes: int = MIN_SPAN_BYTES
) -> DataFrame:
    """One row per span to drop: doc_id, text_hash, first_doc_id (the smallest id that keeps a run of it), start, stop
    (bytes), n_words.

    Digests are counted with partial sums before the shuffle; only those that recur are joined back, where Spark splits
    frequent ones. Null and empty texts have no chunks. Equal rows are one document; rows that share an id but not the text
    are told apart by text_hash. Only the id and the text are read; an empty table
    gives an empty table.
    """
    docs = _documents(df, id_col, text_col)
    pieces = chunks(docs).withColumn("size", F.col("stop") - F.col("start"))
    first = F.struct("doc_id", "text_hash", "place")
    firsts = written(
        pieces.groupBy("digest", "size").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
        "repeated-runs",
    )
    later = (
        pieces.join(firsts, ["digest", "size"])
        .where(first != F.col("first"))
        .select("doc_id", "text_hash", "place", "start", "stop", "first_word", "last_word", F.col("first.doc_id").alias("first_doc_id"))
    )
    in_order = Window.partitionBy("doc_id", "text_hash").orderBy("place")
    return (
        later.withColumn("island", F.col("place") - F.dense_rank().over(in_order))
        .groupBy("doc_id", "text_hash", "island")
        .agg(
            F.min("first_doc_id").alias("first_doc_id"),
            F.min("start").alias("start"),
            F.max("stop").alias("stop"),
            (F.max("last_word") - F.min("first_word")).alias("n_words"),
        )
        .where((F.col("n_words") >= min_words) | (F.col("stop") - F.col("start") >= min_bytes))
        .drop("island")
    )


def without_spans(df: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the spans of repeated_spans cut out of its texts; rows without spans stay as they are (a null text stays
    null), and equal rows lose the same spans."""
    key, text_key, cuts = (fresh_name(df, x) for x in ("span_doc", "span_text", "span_cuts"))
    lists = spans.groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(text_key)).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(cuts))
    same = F.col(text_key) == _text_hash(F.col(text_col))
    joined = df.join(lists, F.col(id_col).eqNullSafe(F.col(key)) & same, "left").drop(key, text_key)

    def apply(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        out = []
        for text, gone in zip(texts, batch.column(batch.schema.get_field_index(cuts)).to_pylist(), strict=True):
            if text and gone:
                blob, at, kept = text.encode(), 0, []
                for x in gone:
                    kept.append(blob[at : x["start"]])
                    at = max(at, x["stop"])
                text = b"".join([*kept, blob[at:]]).decode()
            out.append(text)
        return [pa.array(out, pa.string())]

    return append_columns(joined, [T.StructField(text_col, T.StringType())], apply).select(*[f"`{c}`" for c in df.columns])
