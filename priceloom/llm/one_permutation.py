"""Near duplicates by one-permutation MinHash with optimal densification.

A document is the set of its distinct word shingles (64-bit hashes). Documents whose sets reach the similarity link, and
linked documents form a component, of which the one with the smallest id is kept.

1. Signature. One hash of every shingle serves all bins: its highest bits name the bin, and each bin holds its smallest
   hash. An empty bin borrows from another one: each bin has its own random order of all bins, the same for every
   document, and takes the value of the first that is not empty. Two sets then agree in a bin as often as their
   similarity says, empty bins included, and borrowed bins agree independently of each other.
2. Bands. Every BAND bins are hashed into one bucket. At a similarity of 0.85, two sets share none of the 64 buckets of 8
   bins in fewer than one of a million pairs, whatever their sizes (5e-8 on average; the tests measure it).
3. Edges. Equal sets are one set. Inside a bucket, members are compared with a few centres in star-shaped edges, so a
   bucket makes about as many pairs as it has members; components are merged and new centres are taken, and only
   components that are still apart in a bucket are compared with each other, where sizes and bitmaps allow a link.
4. Check. Whole sets are intersected, so no pair links by chance.

Texts are read twice: for signatures, and for the whole sets of documents that share a bucket with another set.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceloom.llm.common import Scratch, mix, packs, small, text_bytes, word_hashes
from priceloom.llm.jaccard_join import BITMAP, BITMAP_WORDS, BROADCAST_IDS, STAR_ROUNDS, held_by_several, linked_in_buckets, links_sql, named_components, one_of_each, parity_bitmap, set_digest, shingle_set

SHINGLE_WORDS = 3
PERCENT = 85
#: Bins of a signature (a power of two) and bins of a band.
BINS = 512
BAND = 8


@cache
def lending_ranks(bins: int = BINS) -> np.ndarray:
    """Row i: the place of every bin in the order in which bin i asks them for a value."""
    rng = np.random.default_rng(20260113)
    return np.array([rng.permutation(bins) for _ in range(bins)], np.uint16)


def signature(tokens: np.ndarray, bins: int = BINS) -> np.ndarray:
    """The smallest token of every bin, of sorted distinct tokens (not none); empty bins filled by densification."""
    of = (tokens >> np.uint64(65 - bins.bit_length())).astype(np.int64)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    full = of[first]
    out = np.zeros(bins, np.uint64)
    out[full] = tokens[first]
    if len(full) < bins:
        empty = np.ones(bins, bool)
        empty[full] = False
        out[empty] = tokens[first[lending_ranks(bins)[empty][:, full].argmin(axis=1)]]
    return out


def bands(signatures: np.ndarray, band: int = BAND) -> np.ndarray:
    """One hash of every band, row by row."""
    rows = signatures.reshape(len(signatures), -1, band)
    out = np.broadcast_to(mix(np.arange(1, rows.shape[1] + 1, dtype=np.uint64)), rows.shape[:2]).copy()
    for k in range(band):
        out = (out ^ rows[:, :, k]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    return mix(out)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        blobs = text_bytes(batch, "text")
        for lo, hi in packs(blobs):
            hashes, _, _, first = word_hashes([b.lower() for b in blobs[lo:hi]])
            yield batch.column(0).slice(lo, hi - lo), [shingle_set(hashes[a:b], n) for a, b in zip(first[:-1], first[1:], strict=True)]


def _list_column(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat.view(np.int64)))


def _facts(id_field: T.StructField, rest: list[T.StructField]) -> T.StructType:
    return T.StructType([id_field, T.StructField("n", T.IntegerType()), T.StructField("set_id", T.LongType()), *rest])


def banded_sets(docs: DataFrame, n: int = SHINGLE_WORDS, bins: int = BINS, band: int = BAND) -> DataFrame:
    """(doc_id, n, set_id, bands) of (doc_id, text); an empty set has no bands."""
    schema = _facts(docs.schema["doc_id"], [T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, n):
            held = [s for s in sets if len(s)]
            hashed = iter(bands(np.array([signature(s, bins) for s in held]), band) if held else [])
            found = _list_column([next(hashed) if len(s) else s for s in sets])
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int32()), pa.array([set_digest(s) for s in sets], pa.int64()), found], names=schema.names)

    return docs.mapInArrow(run, schema)


def whole_sets(docs: DataFrame, n: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n, set_id, tokens, bitmap words) of (doc_id, text)."""
    schema = _facts(docs.schema["doc_id"], [T.StructField("tokens", T.ArrayType(T.LongType())), *[T.StructField(b, T.LongType()) for b in BITMAP]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, n):
            bits = np.array([parity_bitmap(s) for s in sets]).reshape(-1, BITMAP_WORDS)
            facts = [ids, pa.array([len(s) for s in sets], pa.int32()), pa.array([set_digest(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([*facts, _list_column(sets), *[pa.array(b) for b in bits.T]], names=schema.names)

    return docs.mapInArrow(run, schema)


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    bins: int = BINS,
    band: int = BAND,
    broadcast_ids: int = BROADCAST_IDS,
    star_rounds: int = STAR_ROUNDS,
) -> DataFrame:
    """Per row of df: doc_id, n_shingles, component_id, the smallest id that links reach (its own at least), and kept,
    whether that is its own.

    A null or empty text, or one of blanks, has no shingles and no links. Equal texts are one set. Rows may repeat and share
    ids: rows with the id of their component are all kept. Null ids come last: they name a component of null ids only. Only
    the id and the text are read. An empty table gives an empty table.
    """
    scratch = Scratch(df.sparkSession, "minhash")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    id_ = F.col(f"`{id_col}`")
    docs = df.select(F.struct(id_.isNull().alias("no_id"), id_.alias("id"), F.xxhash64(text).alias("text_hash")).alias("doc_id"), text.alias("text"))
    banded = scratch.write(banded_sets(docs, n, bins, band), "bands")
    one_each = one_of_each(banded, scratch, broadcast_ids)
    every = one_each.select("set_id", F.explode("bands").alias("sig"))
    postings = scratch.write(held_by_several(every, "sig", scratch, broadcast_ids).withColumn("inner", F.lit(True)), "postings")
    near = scratch.write(postings.select("set_id").distinct(), "near")
    chosen = scratch.write(one_each.select("set_id", "doc_id").join(small(near, broadcast_ids), "set_id", "left_semi").select("doc_id").distinct(), "chosen")
    found = scratch.write(whole_sets(docs.join(small(chosen, broadcast_ids), "doc_id", "left_semi"), n).drop("doc_id"), "sets")
    # A repeated row brings its set again.
    sets = found if found.groupBy("set_id").count().where("count > 1").isEmpty() else scratch.write(found.dropDuplicates(["set_id"]), "sets")
    facts = sets.select("set_id", "n", F.col("n").alias("n_held"), *BITMAP)
    groups = linked_in_buckets(sets.select("set_id", "n", "tokens"), postings, facts, scratch, percent, star_rounds)
    place = named_components(banded, groups, scratch, broadcast_ids)
    scratch.drop(banded, postings, near, chosen, found)
    doc, component = F.col("doc_id.id"), F.col("lowest.id")
    return place.select(doc.alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), doc.eqNullSafe(component).alias("kept"))


SQL = links_sql(SHINGLE_WORDS, PERCENT, ", s.doc_id = component_id AS kept")
