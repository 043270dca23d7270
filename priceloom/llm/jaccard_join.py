"""N-gram Jaccard join by token-combination prefixes.

A document is the set of its distinct word shingles (64-bit hashes; equal hashes count as equal shingles, equal sets as
one). Documents link when 100 * intersection >= percent * union, and linked documents form a component.

1. Screen. Equal texts are one set, for which the smallest of their ids stands. In hash order, two linked sets share at
   least k tokens inside their prefixes of (allowed misses + k) tokens. A set that shares fewer prefix tokens with other
   sets than its smallest possible partner demands has no link.
2. Order. For the rest, tokens are counted and ordered rare first. Tokens of one set only drop out, and so do sets that
   keep less than the needed share.
3. Signatures. Rare tokens (up to RARE sets) index a prefix singly. Frequent tokens fall into classes by hash and index it
   by pairs inside a class; a class costs one token, so the prefix is extended until single tokens plus (class size - 1)
   exceed the allowed misses. Any linked pair then shares a signature. The number of classes doubles with the set size;
   sets near a boundary are indexed on both sides, and small sets by single tokens only. The smaller set of a pair may
   miss less (2s / (1 + s) of its tokens are shared), so its signature must come from a shorter prefix.
4. Candidates. Buckets whose members are one component are done. First a member of the smallest and one of the largest
   component are compared with the other components' members (stars), and components are merged, round after round; what
   is left of the buckets is then compared component against component, inside a bucket only sets of one band of sizes
   with those of the same and the next. Pairs inside a component are never made. Pairs that sizes, unshared tokens or a
   parity bitmap of the sets rule out are left out of the join: bits that differ are tokens that differ.
5. Verify. Token arrays of each candidate pair are intersected.

Texts are read twice: for sets and screening prefixes, and for the whole sets of what has passed the screen. Every table
is dropped as soon as nothing reads it any more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceloom.llm.common import Scratch, mix, packs, small, text_bytes, window_hashes, word_hashes

SHINGLE_WORDS = 5
PERCENT = 75
#: Sets that may hold a token of the rare class.
RARE = 16
#: Sets of up to SMALL tokens are indexed by single tokens; the size doubles from level to level.
SMALL = 60
#: Classes of frequent tokens at level 1; they double with the size.
CLASSES = 8
STAR_ROUNDS = 3
#: Lowest signatures of a set by which the last step makes a pair of sets once and not for every signature that they share.
FIRST_SIGNATURES = 16
#: 64-bit words of the parity bitmap.
BITMAP_WORDS = 8
BITMAP = [f"bits{i}" for i in range(BITMAP_WORDS)]
#: Documents that pass the screen are looked up by broadcast up to this count (16 MB of ids), by a shuffled join beyond.
BROADCAST_IDS = 1_000_000
#: Buckets whose two ends (0.2 kB) are looked up by broadcast; several such tables may be alive in an executor.
BROADCAST_ENDS = 5_000


def shingle_set(words: np.ndarray, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes; fewer than n words are one shingle."""
    if not len(words):
        return words
    if len(words) < n:
        return mix(window_hashes(words, len(words)) + np.uint64(len(words)))
    return np.unique(window_hashes(words, n))


def set_digest(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_shared(n: int, percent: int = PERCENT) -> int:
    """Tokens that a set of n shares at least with any set it links to; n - this may miss."""
    return -(-percent * n // 100)


def least_shared_with_larger(n: int, percent: int = PERCENT) -> int:
    """Tokens that a set of n shares at least with any set it links to that is not smaller."""
    return -(-2 * percent * n // (100 + percent))


def screen_margin(n: int) -> int:
    return 1 + n // 16


def _batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    for batch in batches:
        blobs = text_bytes(batch, "text")
        for lo, hi in packs(blobs):
            hashes, _, _, first = word_hashes([b.lower() for b in blobs[lo:hi]])
            yield batch.column(0).slice(lo, hi - lo), [shingle_set(hashes[a:b], n) for a, b in zip(first[:-1], first[1:], strict=True)]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    """Arrays of hashes as one list column."""
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat.view(np.int64)))


def token_sets(docs: DataFrame, n: int = SHINGLE_WORDS, percent: int | None = None) -> DataFrame:
    """(doc_id, n, set_id, tokens) of (doc_id, text), doc_id being of any type; with percent, only the tokens of the screening prefix."""
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("n", T.IntegerType()), T.StructField("set_id", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _batches(batches, n):
            parts = [s[: len(s) - least_shared(len(s), percent) + screen_margin(len(s))] for s in sets] if percent else sets
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int32()), pa.array([set_digest(s) for s in sets], pa.int64()), _lists(parts)], names=schema.names)

    return docs.mapInArrow(run, schema)


def held_by_several(postings: DataFrame, key: str, scratch: Scratch, limit: int = BROADCAST_IDS, having: str = "n > 1", **facts: Column) -> DataFrame:
    """The rows of postings whose key stands in several of them. The keys become a table first: Spark splits a frequent key of
    a join of tables, but not of a join with a grouping by it."""
    counted = postings.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in facts.items()])
    several = scratch.write(counted.where(having).select(key), f"several-{key}")
    return postings.join(small(several, limit) if limit else several, key, "left_semi")


def screened(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """set_id of the sets (set_id, n, prefix tokens) that share enough prefix tokens with others."""
    postings = sets.select("set_id", "n", F.explode("tokens").alias("token"))
    needed = F.lit(1) + F.floor(F.ceil(F.col("n") * percent / 100) / 16)
    return held_by_several(postings, "token", scratch, limit=0).groupBy("set_id", "n").count().where(F.col("count") >= needed).select("set_id")


def prefix_signatures(n: int, counts: np.ndarray, held: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a set of n tokens, of which held (with their counts) are in other sets too, and whether each one lies in
    the prefix that the smaller set of a pair needs."""
    # Unique tokens are the rarest, so they come first in the prefix and count as single tokens.
    unique = n - len(held)
    budget, short = n - least_shared(n, percent) + 1 - unique, n - least_shared_with_larger(n, percent) + 1 - unique
    sigs, inner = [held[:0]], [np.zeros(0, bool)]
    if n <= SMALL:
        sigs.append(mix(held[:budget] ^ np.uint64(1)))
        inner.append(np.arange(len(sigs[-1])) < short)
    level = 1
    while n > SMALL * 2 ** (level - 1) * percent / 100:
        if n <= SMALL * 2**level:
            classes = CLASSES * 2 ** (level - 1)
            of_class: dict[int, list[int]] = {}
            single, spent, short_end = [], 0, 0
            for i, (count, token) in enumerate(zip(counts.tolist(), held.tolist(), strict=True)):
                if spent >= budget:
                    break
                if spent < short:
                    short_end = i + 1
                if count <= RARE:
                    single.append(i)
                    spent += 1
                else:
                    mates = of_class.setdefault(token % classes, [])
                    mates.append(i)
                    spent += len(mates) > 1
            salt = np.uint64(level + 1)
            sigs.append(mix(held[single] ^ salt))
            inner.append(np.array(single, int) < short_end)
            for mates in of_class.values():
                a, b = np.triu_indices(len(mates), 1)
                place, m = np.array(mates), held[mates]
                sigs.append(mix(mix(np.minimum(m[a], m[b]) ^ salt) + np.maximum(m[a], m[b])))
                inner.append(place[b] < short_end)
        level += 1
    return np.concatenate(sigs), np.concatenate(inner)


def parity_bitmap(held: np.ndarray) -> np.ndarray:
    """Each token flips one bit, so two bitmaps differ in at most as many bits as the sets differ in tokens."""
    bits = np.bincount((mix(held) % np.uint64(64 * BITMAP_WORDS)).astype(int), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def signatures(df: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(sig, set_id, inner) of (set_id, n, held), held being structs (df, token) of the tokens that other sets hold too."""
    schema = T.StructType([T.StructField("sig", T.LongType()), T.StructField("set_id", T.LongType()), T.StructField("inner", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, held, counts in _held(batches):
            parts = []
            for i, n in enumerate(sizes.tolist()):
                order = np.lexsort((held[i], counts[i]))
                sigs, inner = prefix_signatures(n, counts[i][order], held[i][order], percent)
                parts.append((sigs, inner, np.full(len(sigs), i)))
            if parts:
                sigs, inner, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(ids[owner]), pa.array(inner)], names=schema.names)

    return df.select("set_id", "n", "held").mapInArrow(run, schema)


def bitmaps(df: DataFrame) -> DataFrame:
    """(set_id, n, n_held, bitmap words) of (set_id, n, held)."""
    schema = T.StructType(
        [T.StructField("set_id", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("n_held", T.IntegerType()), *[T.StructField(name, T.LongType()) for name in BITMAP]]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, held, _ in _held(batches):
            bits = np.array([parity_bitmap(h) for h in held]).reshape(-1, BITMAP_WORDS)
            columns = [pa.array(ids), pa.array(sizes.astype(np.int32)), pa.array([len(h) for h in held], pa.int32()), *[pa.array(b) for b in bits.T]]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select("set_id", "n", "held").mapInArrow(run, schema)


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """Ids, sizes, tokens and their counts of the sets of each batch."""
    for batch in batches:
        lists = batch.column(2)
        flat, at = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        counts, tokens = flat.field(0).to_numpy(), flat.field(1).to_numpy().view(np.uint64)
        yield batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.split(tokens, at[1:-1]) if len(at) > 1 else [], np.split(counts, at[1:-1]) if len(at) > 1 else []


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for edges (a, b): alternating large and small stars, each round written; component is the smallest
    node. No edges give no rows; repeated edges and loops change nothing."""
    edges = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small_ = large.join(lowest, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = scratch.write(small_.where("a <> b").distinct(), "edges")
        done = after.exceptAll(edges).isEmpty() and edges.exceptAll(after).isEmpty()
        scratch.drop(edges)
        if done:
            return after.select(F.col("a").alias("node"), F.col("b").alias("component")).union(after.select("b", "b").distinct())
        edges = after


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (set_id, n, tokens) reach the similarity. Both joins read the sets in one partitioning, so they shuffle once."""
    a = sets.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("tokens").alias("t_a"))
    b = sets.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("tokens").alias("t_b"))
    shared = F.size(F.array_intersect("t_a", "t_b"))
    return pairs.join(a, "a").join(b, "b").where(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")


def linked_sets(sets: DataFrame, scratch: Scratch, percent: int = PERCENT, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """(set_id, component) of the sets (set_id, n, held); every link that the sets have is respected.

    Ids are distinct and no field is null; sets without held tokens are components of their own, no sets give no rows.
    """
    every = scratch.write(signatures(sets, percent), "signatures")
    postings = scratch.write(held_by_several(every, "sig", scratch, limit=0, having="n > 1 AND open", open=F.max("inner")), "postings")
    facts = scratch.write(bitmaps(sets), "bitmaps")
    scratch.drop(every)
    component = linked_in_buckets(sets.select("set_id", "n", F.col("held.token").alias("tokens")), postings, facts, scratch, percent, star_rounds)
    scratch.drop(postings, facts)
    return component


def linked_in_buckets(sets: DataFrame, postings: DataFrame, facts: DataFrame, scratch: Scratch, percent: int, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """(set_id, component) of the sets (set_id, n, tokens), joined by every link between sets that share a bucket.

    postings (sig, set_id, inner) and facts (set_id, n, n_held, bitmap words) are written tables; a pair counts where it is inner for its
    smaller set. n_held is the number of tokens that the arrays and bitmaps have, the others being in no other set.
    """
    component = sets.select("set_id", F.col("set_id").alias("component"))
    tested: DataFrame | None = None
    old: list[DataFrame] = []
    # Of two linked sets the larger one is in the band of the smaller or in the next.
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))).cast("int")
    member_fields = ("component", "set_id", "n", "n_held", *BITMAP)
    member = F.struct(*member_fields)
    step = 0
    while step <= star_rounds:
        placed = postings.join(facts.join(component, "set_id"), "set_id")
        ends = scratch.write(placed.groupBy("sig").agg(F.min(member).alias("low"), F.max(member).alias("high")).where("low.component <> high.component"), "ends")
        old.append(ends)
        if ends.isEmpty():  # every bucket is one component
            break
        if step < star_rounds:
            pairs = placed.join(small(ends, BROADCAST_ENDS), "sig").select(F.explode(F.array("low", "high")).alias("p"), member.alias("q"))
            once = "TRUE"
        else:
            live = scratch.write(placed.join(small(ends.select("sig"), BROADCAST_IDS), "sig", "left_semi").select("sig", "inner", band.alias("band"), *member_fields), "live")
            old.append(live)
            lowest = lambda c, name: F.slice(F.sort_array(F.collect_list(c)), 1, FIRST_SIGNATURES).alias(name)
            firsts = live.groupBy("set_id").agg(lowest(F.when(F.col("inner"), F.col("sig")), "p_firsts"), lowest("sig", "q_firsts"))
            live = live.join(firsts, "set_id").select("sig", "inner", "band", member.alias("p"), "p_firsts", "q_firsts")
            larger = live.select("sig", "band", F.col("p").alias("q"), "q_firsts")
            # The smaller set of a pair, by (n, set_id), meets it in its shorter prefix. Rounding may move a band by one.
            near = live.where("inner").withColumn("p_before", F.expr("filter(p_firsts, x -> x < sig)"))
            near = near.select("sig", F.explode(F.array(*[F.col("band") + k for k in range(-1, 3)])).alias("band"), "p", "p_before")
            pairs = near.join(larger, ["sig", "band"])
            # A pair that meets in a lower signature of both short lists is made there and not again.
            once = "(p.n < q.n OR p.n = q.n AND p.set_id < q.set_id) AND NOT arrays_overlap(p_before, q_firsts)"
        # A linked pair differs in at most (1 - s) / (1 + s) of its tokens; unique tokens and unequal bits are different ones.
        unequal = "p.n - p.n_held + q.n - q.n_held + " + " + ".join(f"bit_count(p.{b} ^ q.{b})" for b in BITMAP)
        # One choice, so that the cheap tests come first.
        fits = f"p.component <> q.component AND 100 * least(p.n, q.n) >= {percent} * greatest(p.n, q.n) AND {100 + percent} * ({unequal}) <= {100 - percent} * (p.n + q.n)"
        pairs = (
            pairs.where(f"CASE WHEN {fits} THEN {once} ELSE FALSE END")
            .select(F.least("p.set_id", "q.set_id").alias("a"), F.greatest("p.set_id", "q.set_id").alias("b"))
            .distinct()
        )
        pairs = scratch.write(pairs.join(tested, ["a", "b"], "left_anti") if tested else pairs, "pairs")
        old.append(pairs)
        if pairs.isEmpty():  # the stars have nothing new: straight to what is left
            step = star_rounds if step < star_rounds else step + 1
            continue
        step += 1
        links = verified(pairs, sets, percent)
        named = (
            links.join(component.select(F.col("set_id").alias("a"), F.col("component").alias("c_a")), "a")
            .join(component.select(F.col("set_id").alias("b"), F.col("component").alias("c_b")), "b")
            .select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
        )
        merged = connected_components(named, scratch)
        component = scratch.write(
            component.join(merged.withColumnRenamed("component", "lower"), F.col("component") == F.col("node"), "left").select(
                "set_id", F.coalesce("lower", "component").alias("component")
            ),
            "components",
        )
        tested = tested.union(pairs) if tested else pairs
    scratch.drop(*old)
    return component


def one_of_each(rows: DataFrame, scratch: Scratch, limit: int = BROADCAST_IDS) -> DataFrame:
    """Of the rows (doc_id, n, set_id, ...) with equal sets that of the smallest doc_id, without those of empty sets; equal
    rows all stay. Only sets of several documents are looked up; the others stand for themselves."""
    some = rows.where("n > 0")
    copied = some.groupBy("set_id").agg(F.min("doc_id").alias("lowest"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    named = some.join(small(scratch.write(copied, "copied"), limit), "set_id", "left")
    return named.where(F.col("lowest").isNull() | (F.col("doc_id") == F.col("lowest")))


def named_components(rows: DataFrame, groups: DataFrame, scratch: Scratch, limit: int = BROADCAST_IDS) -> DataFrame:
    """Per row of rows (doc_id, n, set_id): doc_id, n, and lowest, the smallest doc_id of its component, itself for empty
    sets; groups (set_id, component) names the sets that have links."""
    placed = scratch.write(rows.join(groups, "set_id", "left").select("doc_id", "n", F.coalesce("component", "set_id").alias("component")), "placed")
    # Components of one document need no look-up.
    lowest = scratch.write(
        placed.where("n > 0").groupBy("component").agg(F.min("doc_id").alias("lowest"), F.count(F.lit(1)).alias("docs")).where("docs > 1").select(F.col("component").alias("of"), "lowest"), "lowest"
    )
    place = placed.join(small(lowest, limit), (F.col("component") == F.col("of")) & (F.col("n") > 0), "left")
    return place.select("doc_id", "n", F.coalesce("lowest", "doc_id").alias("lowest"))


def jaccard_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE_WORDS, percent: int = PERCENT, broadcast_ids: int = BROADCAST_IDS, star_rounds: int = STAR_ROUNDS
) -> DataFrame:
    """Per row of df: doc_id, n_shingles, component_id, the smallest id that links reach (its own at least), text_hash, and
    is_first, whether the row is its component's smallest by (doc_id, text_hash), nulls last.

    A null text is an empty one: no shingles, no links. Equal texts are one set. Rows may repeat and share ids; a component
    without any id that is not null has a null component_id. Equal rows get equal results, so is_first can hold for several.
    Only the id and the text are read. An empty table gives an empty table.
    """
    scratch = Scratch(df.sparkSession, "jaccard")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"))
    docs = df.select(name.alias("doc_id"), text.alias("text"))
    prefixes = scratch.write(token_sets(docs, n, percent), "prefixes")
    one_each = one_of_each(prefixes, scratch, broadcast_ids)
    passed = scratch.write(screened(one_each.select("set_id", "n", "tokens"), percent, scratch), "screened")
    chosen = scratch.write(one_each.select("set_id", "doc_id").join(small(passed, broadcast_ids), "set_id", "left_semi").select("doc_id").distinct(), "chosen")
    whole = docs.join(small(chosen, broadcast_ids), "doc_id", "left_semi")
    found = scratch.write(token_sets(whole, n).where("n > 0").select("set_id", "n", "tokens"), "sets")
    # A repeated row brings its set again.
    again = not found.groupBy("set_id").count().where("count > 1").isEmpty()
    rest = (found.dropDuplicates(["set_id"]) if again else found).select("set_id", "n", F.explode("tokens").alias("token"))
    counts = scratch.write(rest.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("df")).where("df > 1"), "counts")
    sets = scratch.write(
        rest.join(counts, "token").groupBy("set_id", "n").agg(F.collect_list(F.struct("df", "token")).alias("held")).where(100 * F.size("held") >= percent * F.col("n")),
        "token-sets",
    )
    scratch.drop(counts)
    groups = linked_sets(sets, scratch, percent, star_rounds)
    place = named_components(prefixes, groups, scratch, broadcast_ids)
    scratch.drop(prefixes, passed, chosen, found, sets)
    return place.select(
        F.col("doc_id.id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("lowest.id").alias("component_id"),
        "doc_id.text_hash", (F.col("lowest") == F.col("doc_id")).alias("is_first"),
    )


def links_sql(words: int, percent: int, more: str = "") -> str:
    """The rows of the join in SQL: all pairs that share a shingle are counted, and links followed to the end."""
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= {words} THEN list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i : i + {words - 1}], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), flat AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.other = l.a
), lowest AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id{more} FROM sets s JOIN lowest r ON s.doc_id = r.doc_id
"""


SQL = links_sql(SHINGLE_WORDS, PERCENT)
