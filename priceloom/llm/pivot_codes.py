"""Vector codes by product quantization; nearest codebook entries are found with LAESA pivots.

Vectors become whole numbers and are cut into equal parts; every part position has a codebook of whole-number entries, and
a vector's code names the nearest entry of each part. Distances are exact sums of squares.

1. Pivots. A few of the first entries of each codebook, far from one another, are its pivots for good. The distance from
   every part to every pivot is computed once and written with the parts.
2. Rounds. The distances from pivots to the present entries are computed once a round. |d(part, pivot) - d(pivot, entry)|
   is a lower bound of d(part, entry), the largest over the pivots the best one. Entries are tried in the order of their
   bounds, for many parts side by side; a part is done when the next bound is beyond its best distance, so most exact
   evaluations never happen. Bounds are floating-point numbers with a margin for rounding; what decides is exact.
3. Updates. Every task adds up its parts by entry and passes on one row a number of the codebook; the new codebooks are
   the rounded-down means. Only codebooks, whose size no table changes, pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceloom.llm.common import new_path, small, stored

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
PIVOTS = 4
#: Labels whose summed error is sent to every task; more are joined by shuffle.
BROADCAST_LABELS = 100_000
#: Parts that are held against a codebook side by side.
BLOCK = 4096


def _limit(size: int) -> int:
    """Components stop there (some hundred thousand times the scale), so that no distance leaves 64 bits."""
    return int((2**62 / max(1, size)) ** 0.5) // 2


def whole_vectors(df: DataFrame, parts: int = PARTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, int]:
    """(vec_id, label, numbers) of the rows whose vector can be coded, and the vectors' length (0: there are none)."""
    vector = F.col(f"`{vector_col}`")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), vector.alias("vector"))
    rows = rows.where(vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & finite)
    order = F.struct(F.col("vec_id").isNull(), F.col("vec_id"), F.size("vector"))
    size = rows.agg(F.min_by(F.size("vector"), order).alias("size")).first()["size"] or 0
    most = float(_limit(size))
    number = lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), scale * x.cast("double")))).cast("long")
    return rows.where(F.size("vector") == size).select("vec_id", "label", F.transform("vector", number).alias("numbers")), size


def first_codebooks(vectors: DataFrame, size: int, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks (part, entry, position) of the vectors with the smallest ids, ascending; ties go by the numbers."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "numbers").limit(entries).select("numbers").collect()
    return np.array([r["numbers"] for r in rows], np.int64).reshape(len(rows), parts, size // parts).swapaxes(0, 1) if rows else np.zeros((parts, 0, 1), np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distance of every row of a to every row of b, in whole numbers."""
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2)


def choose_pivots(book: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Entries that are far from those chosen before them, the first one to begin with."""
    chosen, far = [0], np.sqrt(distances(book, book[:1])[:, 0])
    while len(chosen) < min(n, len(book)):
        far[chosen] = -1
        chosen.append(int(far.argmax()))
        far += np.sqrt(distances(book, book[chosen[-1:]])[:, 0])
    return book[chosen]


def nearest(points: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry and its squared distance, of every point; ties go to the lower index. And how many exact
    evaluations it took."""
    from_pivots = np.sqrt(distances(pivots, book))
    bounds = np.abs(to_pivots[:, :1] - from_pivots[0])
    for p in range(1, len(pivots)):
        np.maximum(bounds, np.abs(to_pivots[:, p : p + 1] - from_pivots[p]), out=bounds)
    bounds -= 1e-9 + 1e-12 * max(to_pivots.max(initial=0), from_pivots.max(initial=0))  # roots are rounded
    np.maximum(bounds, 0, out=bounds)
    bounds *= bounds
    order = bounds.argsort(axis=1, kind="stable")
    bounds = np.take_along_axis(bounds, order, 1)
    best, at = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(book))
    live, evaluated = np.arange(len(points)), 0
    for k in range(len(book)):
        live = live[bounds[live, k] <= best[live]]
        if not len(live):
            break
        entry = order[live, k]
        found = ((points[live] - book[entry]) ** 2).sum(axis=1)
        evaluated += len(live)
        better = (found < best[live]) | (found == best[live]) & (entry < at[live])
        best[live[better]], at[live[better]] = found[better], entry[better]
    return at, best, evaluated


def _matrix(column: pa.ListArray, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), width)


def with_pivot_distances(vectors: DataFrame, size: int, pivots: list[np.ndarray]) -> DataFrame:
    """Adds to_pivots: the distances of each part to the pivots of its position, part by part."""
    schema = T.StructType([*vectors.schema.fields, T.StructField("to_pivots", T.ArrayType(T.DoubleType()))])
    width = size // len(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = _matrix(batch.column(2), size, np.int64)
            found = [np.sqrt(distances(numbers[:, k * width : (k + 1) * width], p)) for k, p in enumerate(pivots)]
            flat = np.concatenate(found, axis=1)
            at = np.arange(len(batch) + 1, dtype=np.int32) * flat.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(at), pa.array(flat.ravel()))], names=schema.names)

    return vectors.mapInArrow(run, schema)


def _assigned(batch: pa.RecordBatch, books: np.ndarray, pivots: list[np.ndarray], n_pivots: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Part, row of its first point, points, entries and distances, block by block."""
    parts, _, width = books.shape
    numbers, to_pivots = _matrix(batch.column(2), parts * width, np.int64), _matrix(batch.column(3), parts * n_pivots, float)
    for lo in range(0, len(numbers), BLOCK):
        for k in range(parts):
            points = numbers[lo : lo + BLOCK, k * width : (k + 1) * width]
            entry, distance, _ = nearest(points, to_pivots[lo : lo + BLOCK, k * n_pivots : (k + 1) * n_pivots], books[k], pivots[k])
            yield k, lo, points, entry, distance


def updated(coded: DataFrame, books: np.ndarray, pivots: list[np.ndarray]) -> np.ndarray:
    """Codebooks of the rounded-down means of the parts that each entry is nearest to; unused entries stay."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            for k, _, points, entry, _ in _assigned(batch, books, pivots, len(pivots[0])):
                np.add.at(sums, entry + k * entries, points)
                counts += np.bincount(entry + k * entries, minlength=parts * entries)
        used = np.flatnonzero(counts)
        rows = [np.repeat(used, width), np.tile(np.arange(width), len(used)), sums[used].ravel(), np.repeat(counts[used], width)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], names=["entry", "position", "total", "n"])

    found = coded.mapInArrow(run, "entry bigint, position bigint, total bigint, n bigint").groupBy("entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    after = books.copy()
    for r in found.collect():  # as many rows as the codebooks have numbers
        after[r["entry"] // entries, r["entry"] % entries, r["position"]] = r["total"] // r["n"]
    return after


def coded_vectors(coded: DataFrame, books: np.ndarray, pivots: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error) by the given codebooks."""
    schema = T.StructType([coded.schema["vec_id"], coded.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.zeros((len(batch), len(books)), np.int64), np.zeros(len(batch), np.int64)
            for k, lo, points, entry, distance in _assigned(batch, books, pivots, len(pivots[0])):
                codes[lo : lo + len(points), k] = entry
                errors[lo : lo + len(points)] += distance
            digits = [f"{x:02x}" for x in range(books.shape[1])]
            text = ["".join([digits[c] for c in row]) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(errors)], names=schema.names)

    return coded.mapInArrow(run, schema)


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _label_errors(rows: DataFrame, broadcast_labels: int) -> Column | DataFrame:
    totals = stored(rows.groupBy("label").agg(F.try_sum("error").alias("label_error")), new_path(rows.sparkSession, "codes-labels")).withColumnRenamed("label", "_label")
    return rows.join(small(totals, broadcast_labels), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def vector_codes(
    df: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    n_pivots: int = PIVOTS,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    broadcast_labels: int = BROADCAST_LABELS,
) -> DataFrame:
    """Per vector that can be coded: vec_id, code, error, label_error and codebooks_sha256.

    Dropped are vectors that are null, hold null or non-finite components, or have another length than that of the smallest
    id (or one that the parts don't divide). Components beyond some hundred thousand stop there. Rows may repeat and share
    ids; null ids come last and null labels are one label. With fewer vectors than entries the codebooks are smaller; an
    empty table gives an empty table. A label_error beyond 64 bits is null. Only the three named columns are read.
    """
    spark = df.sparkSession
    vectors, size = whole_vectors(df, parts, scale, id_col, vector_col, label_col)
    books = first_codebooks(vectors, size, parts, entries)
    if not books.shape[1]:
        kept = vectors.where("FALSE").select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return kept.withColumns({"label_error": F.col("error"), "codebooks_sha256": F.lit("")})
    pivots = [choose_pivots(book, n_pivots) for book in books]
    coded = stored(with_pivot_distances(vectors, size, pivots), new_path(spark, "codes-parts"))
    for _ in range(rounds):
        books = updated(coded, books, pivots)
    rows = stored(coded_vectors(coded, books, pivots), new_path(spark, "codes-rows"))
    return _label_errors(rows, broadcast_labels).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """Assignment of all parts to the codebooks of round k and the codebooks of the next."""
    return f"""
near{k} AS (
  SELECT vec_id, part, x, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT p.vec_id, p.part, p.x, b.entry, CAST(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.y[i]) * (p.x[i] - b.y[i]))) AS BIGINT) AS d
        FROM parts p JOIN book{k} b ON p.part = b.part)
  GROUP BY vec_id, part, x
), means{k} AS (
  SELECT part, entry, list(m ORDER BY i) AS y
  FROM (SELECT part, entry, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM near{k}, range(1, {{width}} + 1) r(i) GROUP BY part, entry, i)
  GROUP BY part, entry
), book{k + 1} AS (
  SELECT b.part, b.entry, coalesce(m.y, b.y) AS y FROM book{k} b LEFT JOIN means{k} m ON b.part = m.part AND b.entry = m.entry
)"""


SQL = (
    """
WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), parts AS (
  SELECT vec_id, label, part, v[part * 4 + 1 : part * 4 + 4] AS x FROM whole, range(0, 16) r(part)
), book0 AS (
  SELECT part, entry, x AS y FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM whole ORDER BY vec_id LIMIT 64) USING (vec_id)
),"""
    + ",".join(_round(k) for k in range(3)).replace("{width}", "4")
    + """, coded AS (
  SELECT vec_id, string_agg(lower(printf('%02x', CAST(entry AS INTEGER))), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY vec_id
)
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, entry)) FROM book2) AS codebooks_sha256
FROM coded c JOIN whole w ON c.vec_id = w.vec_id
"""
)
