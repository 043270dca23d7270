"""Importance resampling towards a target distribution, with bit-sliced sums.

Features are runs of consecutive words; each falls into a bucket by its CRC-32. A bucket's gain is the scaled logarithm of
how much likelier the target makes it than the corpus, rounded down. A document's weight is the sum of the gains of its
features, and the highest weights plus Gumbel noise of its id are drawn.

1. Totals. Every task counts its features by bucket and passes on one row a bucket; the totals (as many numbers as
   there are buckets, whatever the corpus) make the gains.
2. Weights. A document's bucket counts become bit planes of one bit a bucket: plane j holds bit j of every count. The gains
   are planes as well, by sign and bit of their size. Each pair of planes is ANDed and its ones are counted, and the counts
   are added up by powers of two: the exact sum of count times gain in whole numbers.
3. Draw. Scores are sorted range by range; a document's rank is its place inside its range and the rows of the ranges
   before. No task sees more than a range.

Texts are read once for the totals and once for the weights, in pieces, so a long text needs little memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceloom.llm.common import new_path, stored, text_bytes

BUCKETS = 10_000
NGRAM = 1
SCALE = 1000
SEED = "2024"
MIN_WORDS = 20
PERCENT = 10
#: Bytes of text that are cut into words at once.
PIECE = 1 << 20

#: Words are runs of 0-9, a-z (after A-Z are lowered) and everything beyond ASCII; all other bytes separate.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text with blanks for all separators, cut at blanks."""
    clean, at = text.translate(_WORDS), 0
    while len(clean) - at > PIECE:
        cut = clean.find(b" ", at + PIECE)
        if cut < 0:
            break
        yield clean[at:cut]
        at = cut
    yield clean[at:] if at else clean


def bucket_counts(text: bytes, ngram: int = NGRAM, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Words of a text, and how many of its features fall into each bucket."""
    n_words, counts, tail = 0, np.zeros(buckets, np.int64), []
    for piece in _pieces(text):
        fresh = piece.split()
        n_words += len(fresh)
        words = tail + fresh
        # A run's checksum goes on from the run that is one word shorter. Runs that end before this piece are counted already.
        sums = list(map(crc32, words))
        for k in range(ngram):
            if k:
                sums = [crc32(w, crc32(b" ", c)) for w, c in zip(words[k:], sums)]
            ends = sums[max(0, len(tail) - k) :]
            if ends:
                counts += np.bincount(np.array(ends, np.uint32) % np.uint32(buckets), minlength=buckets)
        tail = words[-(ngram - 1) :] if ngram > 1 else []
    return n_words, counts


def bit_planes(numbers: np.ndarray) -> np.ndarray:
    """Rows of bits, packed into 64-bit words: row j holds bit j of each number (not negative)."""
    width = max(1, int(numbers.max(initial=0)).bit_length())
    bits = np.zeros((width, -(-len(numbers) // 64) * 64), np.uint8)
    bits[:, : len(numbers)] = (numbers[None, :] >> np.arange(width)[:, None]) & 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


class Gains:
    """The gains as signed bit planes."""

    def __init__(self, gains: Sequence[int]) -> None:
        numbers = np.array(gains, np.int64)
        self.planes = [(sign, bit_planes(np.maximum(sign * numbers, 0))) for sign in (1, -1)]

    def weight(self, counts: np.ndarray) -> int:
        """The sum of count times gain: ones of each AND of two planes, times their power of two."""
        return sum(self.weights(bit_planes(counts)))

    def weights(self, planes: np.ndarray) -> Iterator[int]:
        for sign, gains in self.planes:
            for j, plane in enumerate(planes):
                ones = np.bitwise_count(plane & gains).sum(axis=1, dtype=np.int64)
                yield sign * sum(int(n) << (j + k) for k, n in enumerate(ones.tolist()))


def _texts(df: DataFrame, text_col: str) -> Column:
    return F.col(f"`{text_col}`").cast("string").alias("text")


def bucket_totals(df: DataFrame, text_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in text_bytes(batch, "text"):
                total += bucket_counts(text, ngram, buckets)[1]
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    counted = df.select(_texts(df, text_col)).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    totals = np.zeros(buckets, np.int64)
    for row in counted.collect():  # as many rows as buckets at most
        totals[row["bucket"]] = row["n"]
    return totals


def gains(corpus: np.ndarray, target: np.ndarray, scale: int = SCALE) -> list[int]:
    """floor(scale * ln((t + 1) * (S + buckets) / ((s + 1) * (T + buckets)))) of every bucket, in doubles."""
    s, t, n = corpus.astype(float), target.astype(float), float(len(corpus))
    return np.floor(scale * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64).tolist()


def weighed(df: DataFrame, bucket_gains: list[int], id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])
    buckets = len(bucket_gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sliced = Gains(bucket_gains)
        for batch in batches:
            rows = []
            for text in text_bytes(batch, "text"):
                n_words, counts = bucket_counts(text, ngram, buckets)
                rows.append((n_words, int(counts.sum()), sliced.weight(counts)))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return df.select(F.col(f"`{id_col}`").alias("doc_id"), _texts(df, text_col)).mapInArrow(run, schema)


def gumbel(id_: Column, seed: str = SEED, scale: int = SCALE) -> Column:
    """floor(-scale * ln(-ln(u))), u being the first 32 bits of a digest of seed and id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-float(scale) * F.log(-F.log(u))).cast("long")


def ranked(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Adds rank, from 1, to the floor(percent * N / 100) highest scores of the N rows with enough words; null for the rest.

    Ties go to the smaller doc_id (null last), then to fewer features. Rows that are equal in all of this are told apart by
    the place they have in the written table, so that even they are dealt over many ranges.
    """
    spark = scored.sparkSession
    rows = stored(scored.withColumn("place", F.monotonically_increasing_id()), new_path(spark, "resampling-scores"))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("n_words"), F.col("place")]
    able = F.col("n_words") >= min_words
    ranges = stored(rows.where(able).repartitionByRange(*order).withColumn("range", F.spark_partition_id()), new_path(spark, "resampling-ranges"))
    per_range = {r["range"]: r["count"] for r in ranges.groupBy("range").count().collect()}  # a number for each range
    drawn = percent * sum(per_range.values()) // 100
    starts, before = [], 0
    for k in sorted(per_range):
        starts.append((k, before))
        before += per_range[k]
    first = F.broadcast(spark.createDataFrame(starts, "range int, first bigint"))
    open_ = [k for k, at in starts if at < drawn]  # ranges come in order: those beyond the draw need no sorting
    last = max(open_, default=-1)
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    top = ranges.where(F.col("range") <= last).join(first, "range").withColumn("rank", (F.col("first") + inside).cast("long"))
    top = top.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    names = [*scored.columns, "rank"]
    no_rank = F.lit(None).cast("long").alias("rank")
    rest = [ranges.where(F.col("range") > last).select(*scored.columns, no_rank), rows.where(~able).select(*scored.columns, no_rank)]
    return top.select(names).unionByName(rest[0]).unionByName(rest[1])


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
    ngram: int = NGRAM,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: str = SEED,
) -> DataFrame:
    """Per row of docs: doc_id, n_features, weight, score, rank and n_words.

    Null and empty texts have no features and weight 0, and get no rank where min_words is above 0. Rows may repeat and
    share ids: each is a document, counted and ranked by itself. Only the id and the text are read. An empty target gives
    every bucket t = 0; an empty table gives an empty table.
    """
    found = gains(bucket_totals(docs, text_col, ngram, buckets), bucket_totals(target, target_col, ngram, buckets))
    scored = weighed(docs, found, id_col, text_col, ngram).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return ranked(scored, percent, min_words).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


#: CRC-32 of each distinct word from a table that the rule of its polynomial makes.
SQL = r"""
WITH bits AS (
  SELECT x AS byte, list_reduce(range(0, 8), lambda c, k: xor(c >> 1, (c & 1) * 3988292384), x) AS step FROM range(0, 256) r(x)
), steps AS (
  SELECT list(step ORDER BY byte) AS step FROM bits
), words AS (
  SELECT 'd' AS kind, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 'b', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), counted AS (
  SELECT kind, id, word, count(*) AS n FROM words GROUP BY ALL
), codes AS (
  SELECT word, xor(list_reduce(list_transform(range(0, strlen(hex(word)) // 2), lambda k: CAST('0x' || substr(hex(word), CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT)),
                               lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM counted), steps
), totals AS (
  SELECT bucket, CAST(sum(CASE WHEN kind = 'd' THEN n ELSE 0 END) AS DOUBLE) AS s, CAST(sum(CASE WHEN kind = 'b' THEN n ELSE 0 END) AS DOUBLE) AS t FROM counted JOIN codes USING (word) GROUP BY bucket
), gained AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM totals) + 10000) / ((s + 1) * ((SELECT sum(t) FROM totals) + 10000)))) AS BIGINT) AS gain FROM totals
), weighed AS (
  SELECT id AS doc_id, CAST(sum(n) AS BIGINT) AS n_words, CAST(sum(n * gain) AS BIGINT) AS weight FROM counted JOIN codes USING (word) JOIN gained USING (bucket) WHERE kind = 'd' GROUP BY id
), scored AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || CAST(d.doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5) / 4294967296.0))) AS BIGINT) AS score
  FROM documents d LEFT JOIN weighed w ON d.doc_id = w.doc_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place FROM scored
)
SELECT doc_id, n_words AS n_features, weight, score,
       CASE WHEN n_words >= 20 AND place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_words >= 20) THEN place END AS rank, n_words
FROM placed
"""
