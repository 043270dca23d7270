"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of normalized words. Shared runs of SEED_WORDS words pick the (document, item)
pairs. For a pair, Karp-Rabin scans look for the longest matches between words that no tile holds yet, mark them as tiles
and go on with shorter ones, so passages count whatever their order. A document is contaminated by an item when its tiles
cover at least MIN_COVERAGE of the item's words.

Items are the query side. They are taken in blocks of about BLOCK_WORDS words, each of which fits a task; a pass over the
documents serves one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceloom.llm.common import packs, text_bytes, window_hashes, word_hashes

SEED_WORDS = 5
MIN_COVERAGE = 0.6
BLOCK_WORDS = 2_000_000
#: The first search length of the scans.
FIRST_LENGTH = 16

#: Letters in lower case, digits and all bytes of characters beyond ASCII stay; the rest separates words.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

RESULT = [
    T.StructField("n_item_words", T.IntegerType()),
    T.StructField("n_tiles", T.IntegerType()),
    T.StructField("covered_words", T.IntegerType()),
    T.StructField("longest_tile", T.IntegerType()),
    T.StructField("coverage", T.DoubleType()),
]


def normalized(text: bytes) -> bytes:
    return (text if text.isascii() else text.decode().lower().encode()).translate(_NORMAL)


def _window_starts(words: list[int], taken: bytearray, length: int) -> Iterator[tuple[int, int]]:
    """Start and rolling hash of each run of free words of that length."""
    base, modulus = 1_000_003, (1 << 61) - 1
    drop = pow(base, length - 1, modulus)
    h = run = 0
    for i, w in enumerate(words):
        if taken[i]:
            h = run = 0
            continue
        if run == length:
            h = (h - words[i - length] * drop) % modulus
        else:
            run += 1
        h = (h * base + w) % modulus
        if run == length:
            yield i - length + 1, h


def greedy_tiles(item: list[int], doc: list[int], closed: bytearray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Tiles (length, place in item, place in doc). closed marks the places of doc that belong to no match (breaks)."""
    free_item, free_doc = bytearray(len(item)), bytearray(closed)
    tiles: list[tuple[int, int, int]] = []
    length = max(least, min(FIRST_LENGTH, len(item)))
    while True:
        where: dict[int, list[int]] = {}
        for j, h in _window_starts(doc, free_doc, length):
            where.setdefault(h, []).append(j)
        found, longest = [], 0
        for i, h in _window_starts(item, free_item, length):
            for j in where.get(h, ()):
                if i and j and not free_item[i - 1] and not free_doc[j - 1] and item[i - 1] == doc[j - 1]:
                    continue  # inside a match that began further left
                k = 0
                while i + k < len(item) and j + k < len(doc) and not free_item[i + k] and not free_doc[j + k] and item[i + k] == doc[j + k]:
                    k += 1
                if k >= length:
                    found.append((k, i, j))
                    longest = max(longest, k)
        if longest > 2 * length:
            length = longest
            continue
        for k, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if not any(free_item[i : i + k]) and not any(free_doc[j : j + k]):
                free_item[i : i + k] = free_doc[j : j + k] = b"\1" * k
                tiles.append((k, i, j))
            elif k > length:  # what is left of it is looked for again
                longest = -1
        if longest == -1:
            continue
        if length == least:
            return tiles
        length = max(least, length // 2)


class ItemBlock:
    """The items of one block and the index of their seeds."""

    def __init__(self, ids: list, texts: list[bytes], least: int) -> None:
        hashes, _, _, first = word_hashes([normalized(t) for t in texts])
        self.ids = ids
        self.words = [(hashes[a:b] >> np.uint64(4)).tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        # An item of fewer words than a seed is one seed as a whole.
        self.least = np.minimum(np.maximum(np.diff(first), 1), least)
        self.indexes = []
        for n in np.unique(self.least).tolist():
            own = np.flatnonzero(self.least == n)
            seeds = [np.unique(window_hashes(hashes[first[k] : first[k + 1]], n)) for k in own.tolist()]
            every, owner = np.concatenate(seeds), np.repeat(own, [len(s) for s in seeds])
            order = np.argsort(every, kind="stable")
            distinct, at = np.unique(every[order], return_index=True)
            if len(distinct):
                self.indexes.append((n, owner[order], distinct, at, np.append(at[1:], len(every))))

    def matches(self, words: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(item, tiles) of every item that shares a seed with a document's words."""
        for least, owner, seeds, at, until in self.indexes:
            windows = window_hashes(words, least)
            if not len(windows):
                continue
            slot = np.minimum(np.searchsorted(seeds, windows), len(seeds) - 1)
            places: dict[int, list[int]] = {}
            for j in np.flatnonzero(seeds[slot] == windows).tolist():
                for item in owner[at[slot[j]] : until[slot[j]]].tolist():
                    places.setdefault(item, []).append(j)
            for item, starts in places.items():
                # Only words under this item's seeds can be in a tile; a closed place keeps separate stretches apart.
                keep = np.unique((np.array(starts)[:, None] + np.arange(least)).ravel())
                breaks = np.flatnonzero(np.diff(keep) > 1) + 1
                values = np.insert((words[keep] >> np.uint64(4)).astype(np.int64), breaks, 0)
                closed = np.insert(np.zeros(len(keep), np.uint8), breaks, 1)
                yield item, greedy_tiles(self.words[item], values.tolist(), bytearray(closed.tobytes()), least)


def tiled_pairs(
    df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = SEED_WORDS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(doc_id, item_id, n_item_words, n_tiles, covered_words, longest_tile, coverage) of every pair with a tile.

    Null and empty texts have no words and no pairs; an item of fewer words than a seed is found where all of it stands.
    Repeated rows give repeated pairs. No shuffle: each block of items is sent to the tasks, whose documents pass through.
    """
    queries = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text IS NOT NULL")
    size = queries.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // (4 * block_words)))
    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("item_id", items.schema[item_col].dataType), *RESULT])
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = df.sparkSession
    result = spark.createDataFrame([], schema)
    for k in range(n_blocks):
        part = queries.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).toArrow()
        ids = part.column("item_id").combine_chunks()
        block = spark.sparkContext.broadcast(ItemBlock(list(range(len(ids))), [x or b"" for x in part.column("text").cast(pa.binary()).to_pylist()], least))

        def tile(batches: Iterator[pa.RecordBatch], block=block, ids=ids) -> Iterator[pa.RecordBatch]:
            index = block.value
            for batch in batches:
                blobs = text_bytes(batch, "text")
                rows, where = [], []
                for lo, hi in packs(blobs):
                    hashes, _, _, first = word_hashes([normalized(b) for b in blobs[lo:hi]])
                    for i in range(hi - lo):
                        for item, tiles in index.matches(hashes[first[i] : first[i + 1]]):
                            if tiles:
                                total, covered = len(index.words[item]), sum(t[0] for t in tiles)
                                rows.append((item, total, len(tiles), covered, max(t[0] for t in tiles), covered / total))
                                where.append(lo + i)
                if rows:
                    item, *rest = zip(*rows, strict=True)
                    columns = [pa.array(x, pa.int32()) for x in rest[:4]] + [pa.array(rest[4], pa.float64())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where)), ids.take(pa.array(item)), *columns], names=schema.names)

        result = result.union(docs.mapInArrow(tile, schema)) if k else docs.mapInArrow(tile, schema)
    return result


def contaminated(df: DataFrame, items: DataFrame, min_coverage: float = MIN_COVERAGE, **columns) -> DataFrame:
    """The pairs of tiled_pairs whose coverage reaches the threshold."""
    return tiled_pairs(df, items, **columns).where(F.col("coverage") >= min_coverage)


def decontaminated(df: DataFrame, items: DataFrame, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without its contaminated rows (by id; a null id counts as an id)."""
    bad = contaminated(df, items, min_coverage, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("bad_id")).distinct()
    return df.join(bad, F.col(id_col).eqNullSafe(F.col("bad_id")), "left_anti")
