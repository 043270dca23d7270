"""Importance resampling, vector codes and one-permutation MinHash against plain versions and edge cases."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from priceloom.llm import importance_resampling, one_permutation, pivot_codes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# -- op11 ------------------------------------------------------------------------------------------------------------


def plain_counts(text, ngram, buckets):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + k]) for k in range(1, ngram + 1) for i in range(len(w) - k + 1)]
    return len(w), [zlib.crc32(g.encode()) % buckets for g in grams]


TEXTS = ["Alpha beta", "", None, "ÉTÉ 漢字-x9 _y {z}", "a b " * 3_000, "x" * 5_000, " \n\t", "alpha BETA gamma\x00delta"]


@pytest.mark.parametrize("ngram", [1, 2, 3])
@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_bucket_counts_equal_a_plain_search(monkeypatch, ngram, piece):
    monkeypatch.setattr(importance_resampling, "PIECE", piece)
    rng = random.Random(ngram)
    for text in TEXTS + ["".join(rng.choice("ab 1-É") for _ in range(200)) for _ in range(30)]:
        n, found = plain_counts(text, ngram, 97)
        n_words, counts = importance_resampling.bucket_counts((text or "").encode(), ngram, 97)
        assert n_words == n and counts.tolist() == np.bincount(found, minlength=97).tolist()


def test_bit_sliced_weights_are_exact():
    rng = np.random.default_rng(5)
    for _ in range(60):
        gains = rng.integers(-40_000, 40_000, 700) * (rng.random(700) < 0.8)
        counts = rng.integers(0, 1 << int(rng.integers(1, 40)), 700) * (rng.random(700) < 0.3)
        assert importance_resampling.Gains(gains.tolist()).weight(counts) == sum(int(a) * int(b) for a, b in zip(gains, counts))
    assert importance_resampling.Gains([0] * 10).weight(np.zeros(10, np.int64)) == 0


def test_resampling_equals_a_plain_version(spark):
    rng = random.Random(8)
    rows = [(i if i != 40 else None, " ".join(rng.choice(["Tea", "milk", "rye", "oat", "b2"]) for _ in range(rng.randint(0, 60))), i) for i in range(150)]
    rows += [rows[3]] * 60 + [(500 + i, t, 0) for i, t in enumerate(TEXTS)]  # equal rows, odd texts
    target = [(1, "oat milk oat"), (2, None), (3, ""), (4, "OAT")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    got = importance_resampling.resample(docs, spark.createDataFrame(target, "item_id bigint, text string"), ngram=2, buckets=50, min_words=5, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank", "n_words"]
    s, t = ([0] * 50 for _ in range(2))
    for total, texts in ((s, [r[1] for r in rows]), (t, [r[1] for r in target])):
        for text in texts:
            for b in plain_counts(text, 2, 50)[1]:
                total[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 50) / ((a + 1) * (sum(t) + 50)))) for a, b in zip(s, t)]
    want = []
    for id_, text, _ in rows:
        n, found = plain_counts(text, 2, 50)
        h = int(hashlib.sha256(f"2024:{'' if id_ is None else id_}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        want.append([id_, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((w for w in want if w[5] >= 5), key=lambda w: (-w[3], w[0] is None, w[0] or 0, w[1], w[5]))
    for k, w in enumerate(able[: 30 * len(able) // 100]):
        w[4] = k + 1
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want), key=key)
    none = docs.limit(0)
    assert importance_resampling.resample(none, docs.limit(0)).count() == 0
    assert importance_resampling.resample(docs, docs.limit(0)).count() == len(rows)


def test_ranks_of_equal_rows_are_dealt_over_ranges(spark):
    docs = spark.createDataFrame([(7, "a " * 30)] * 3_000 + [(i, f"w{i} " * 25) for i in range(8, 40)], "doc_id bigint, text string").repartition(6)
    rows = importance_resampling.resample(docs, docs, percent=100).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 3_033))


# -- op12 ------------------------------------------------------------------------------------------------------------


def plain_codes(vectors, parts, entries, rounds):
    """{vec_id: (code, error)} and the codebooks of {vec_id: whole numbers}, one distance after the other."""
    ids = sorted(vectors)
    width = len(vectors[ids[0]]) // parts
    part = lambda i, p: vectors[i][p * width : (p + 1) * width]
    books = [[part(i, p) for i in ids[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for i in ids:
                groups.setdefault(near(part(i, p), book)[1], []).append(part(i, p))
            books[p] = [[sum(c) // len(c) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(book)]
    found = {i: [near(part(i, p), books[p]) for p in range(parts)] for i in ids}
    return {i: ("".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for i, f in found.items()}, books


def test_vector_codes_equal_a_plain_version(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.0, 1.0, 3.9999]) if i % 3 else rng.gauss(0, 1) for _ in range(12)], rng.choice([1, 2, None])) for i in range(90)]
    rows[50] = (50, rows[49][1], 1)  # repeated
    bad = [(900, None, 1), (901, [None] * 12, 1), (902, [float("nan")] * 12, 2), (903, [0.0] * 11 + [float("inf")], None), (904, [0.0] * 8, 1), (905, [], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id bigint, embedding array<double>, label int, code string")
    got = {r["vec_id"]: r for r in pivot_codes.vector_codes(df, parts=4, entries=8, rounds=3, n_pivots=3).collect()}
    want, books = plain_codes({i: [math.floor(256 * x) for x in v] for i, v, _ in rows}, 4, 8, 3)
    assert {i: (r["code"], r["error"]) for i, r in got.items()} == want
    totals = {}
    for i, _, label in rows:
        totals[label] = totals.get(label, 0) + want[i][1]
    assert all(got[i]["label_error"] == totals[label] for i, _, label in rows)
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    assert {r["codebooks_sha256"] for r in got.values()} == {digest}
    by_shuffle = pivot_codes.vector_codes(df, parts=4, entries=8, rounds=3, n_pivots=3, broadcast_labels=0)
    assert sorted(map(str, by_shuffle.collect())) == sorted(map(str, got.values()))


def test_vector_codes_of_few_null_and_huge_vectors(spark):
    df = spark.createDataFrame([(None, [1e300, -1e300], None), (5, [0.1, 0.2], None), (5, [0.1, 0.2], 1)], "vec_id bigint, embedding array<double>, label int")
    got = pivot_codes.vector_codes(df, parts=2, entries=8).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["5", "5", "None"] and all(r["error"] == 0 for r in got)
    none = pivot_codes.vector_codes(df.where("vec_id = 6"))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert pivot_codes.vector_codes(df.select("vec_id", F.lit(None).cast("array<float>").alias("embedding"), "label")).count() == 0


def test_pivots_prune_and_ties_go_to_the_lower_index():
    rng = np.random.default_rng(2)
    for spread in (1, 3, 200, 1 << 26):
        points, book = rng.integers(-spread, spread, (500, 4)), rng.integers(-spread, spread, (64, 4))
        book[10] = book[3]
        pivots = pivot_codes.choose_pivots(book)
        at, best, evaluated = pivot_codes.nearest(points, np.sqrt(pivot_codes.distances(points, pivots)), book, pivots)
        exact = pivot_codes.distances(points, book)
        assert (best == exact.min(axis=1)).all() and (at == exact.argmin(axis=1)).all()
        assert evaluated < 0.6 * exact.size
    assert len(pivot_codes.choose_pivots(book[:2])) == 2


# -- op13 ------------------------------------------------------------------------------------------------------------


def test_densified_bins_agree_as_often_as_the_similarity():
    rng = np.random.default_rng(4)
    for shared, own in ((6, 1), (40, 30), (300, 40)):
        equal = []
        for _ in range(200):
            t = rng.integers(0, 1 << 64, shared + 2 * own, dtype=np.uint64)
            a, b = np.sort(t[: shared + own]), np.sort(np.concatenate([t[:shared], t[shared + own :]]))
            equal.append((one_permutation.signature(a) == one_permutation.signature(b)).mean())
        assert abs(np.mean(equal) - shared / (shared + 2 * own)) < 0.03


def test_linked_pairs_share_a_band():
    """At the threshold itself, from the share of equal bins: below one loss in a million pairs of every size."""
    rng = np.random.default_rng(9)
    for n in (7, 13, 20, 33, 64, 100, 300, 2_000):
        same = -(-170 * n // 185)
        lost = []
        for _ in range(150):
            t = rng.integers(0, 1 << 64, 2 * n - same, dtype=np.uint64)
            a, b = np.sort(t[:n]), np.sort(np.concatenate([t[:same], t[n:]]))
            equal = (one_permutation.signature(a) == one_permutation.signature(b)).mean()
            lost.append((1 - equal**one_permutation.BAND) ** (one_permutation.BINS // one_permutation.BAND))
        assert np.mean(lost) < 1e-6


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(12)
    vocabulary = [f"W{i}" for i in range(300)]
    docs = []
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 7)):
            d = list(base)
            for _ in range(rng.randint(0, 3)):
                d[rng.randrange(len(d))] = rng.choice(vocabulary)
            docs.append(" ".join(d))
    passage = [rng.choice(vocabulary) for _ in range(60)]
    docs += [" ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randint(4, 30))]) for _ in range(60)]
    docs += ["one two", "ONE\ttwo", "one", None, "", "  "]
    sets = []
    for t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    lowest = list(range(len(docs)))
    for _ in range(len(docs)):
        before = list(lowest)
        for a in range(len(docs)):
            for b in range(a):
                shared = len(sets[a] & sets[b])
                if shared and 100 * shared >= 85 * len(sets[a] | sets[b]):
                    lowest[a] = lowest[b] = min(lowest[a], lowest[b])
        if lowest == before:
            break
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id bigint, text string, kept int")
    want = {i: (len(sets[i]), lowest[i], lowest[i] == i) for i in range(len(docs))}
    for found in (one_permutation.near_duplicates(df), one_permutation.near_duplicates(df, broadcast_ids=0, star_rounds=0)):
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found.collect()} == want


def test_near_duplicates_edges(spark):
    prose = " ".join(f"w{i}" for i in range(50))
    rows = [(4, prose), (4, prose), (2, prose + " x"), (None, prose), (None, "lonely text of its own"), (5, None), (6, ""), (7, "word " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in one_permutation.near_duplicates(df).collect())))
    assert got == sorted(map(str, [(4, 48, 2, False), (4, 48, 2, False), (2, 49, 2, True), (None, 48, 2, False), (None, 3, None, True), (5, 0, 5, True), (6, 0, 6, True), (7, 1, 7, True)]))
    assert one_permutation.near_duplicates(df.limit(0)).count() == 0
