"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Every line is good or bad. Its features are counts of character classes and repeated words, those of the line before and
of the line behind. Forward-backward gives each line's probability of being good; weighted by line length they make the
document's share of good text, which a logistic curve turns into the score.

Training uses documents' labels: all lines of a document get its label, the field is fitted, lines of bad documents that
look good are relabelled, and the field is fitted again. At most SAMPLE_PER_LABEL labelled documents and SAMPLE_BYTES bytes of
each label are fitted, whole texts in the order of a hash of their id; the logistic curve weighs them by the labels of all
training rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priceloom.llm.common import append_columns, packs, text_bytes, word_hashes

SAMPLE_PER_LABEL = 2000
SAMPLE_BYTES = 32 << 20
#: Training cuts longer texts into chains of so many lines, since its steps are as many as the longest chain has lines.
CHAIN_LINES = 64
THRESHOLD = 0.3
FOLDS, HELD_OUT_FOLD = 5, 0

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "pipe": b"|<>",
    "symbol": b"#*$%&@~^_=+\\/{}[]",
    "exclaim": b"!?",
    "stop": b".,;:",
    "wide": range(128, 256),
}
N_FEATURES = len(_CLASSES) + 6
_FLOOR = 1e-6


def _class_tables() -> np.ndarray:
    tables = np.zeros((len(_CLASSES), 256), np.int64)
    for row, members in zip(tables, _CLASSES.values(), strict=True):
        row[list(members)] = 1
    return tables


def line_features(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and byte length of every line with a word, and the first line of each text (one more at the end)."""
    hashes, starts, ends, _ = word_hashes(blobs)
    data = np.frombuffer(b" ".join(blobs) + b" ", np.uint8)
    text_at = np.cumsum([0, *[len(b) + 1 for b in blobs]])
    heads = np.union1d(text_at[:-1], np.flatnonzero(data == 10) + 1)
    heads = heads[heads < len(data)]
    tails = np.append(heads[1:], len(data))
    of_word = np.searchsorted(heads, starts, "right") - 1
    n_words = np.bincount(of_word, minlength=len(heads))
    size = (tails - heads).astype(float)
    counts = np.stack([np.add.reduceat(table[data], heads) for table in _class_tables()], 1) if len(heads) else np.zeros((0, len(_CLASSES)))
    same = np.zeros(len(hashes), bool)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (of_word[1:] == of_word[:-1])
    stutter = np.bincount(of_word, weights=same, minlength=len(heads))
    order = np.lexsort((hashes, of_word))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of_word[order][1:] != of_word[order][:-1])
    distinct = np.bincount(of_word[order], weights=new, minlength=len(heads))
    letters = np.bincount(of_word, weights=ends - starts, minlength=len(heads))
    with np.errstate(invalid="ignore", divide="ignore"):
        words = np.maximum(n_words, 1)
        x = np.column_stack(
            [
                np.sqrt(counts / size[:, None]),
                stutter / words,
                distinct / words,
                np.log1p(n_words),
                letters / words / 10,
                np.log1p(size) / 5,
                (counts[:, 3] + counts[:, 4]) / words,
            ]
        )
    real = n_words > 0
    first = np.searchsorted(heads[real], text_at)
    return x[real], size[real], first


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features, those of its neighbours in the text, marks for a first and a last line, and a constant."""
    before, behind = np.zeros_like(x), np.zeros_like(x)
    before[1:], behind[:-1] = x[:-1], x[1:]
    begin, end = np.zeros((len(x), 1)), np.zeros((len(x), 1))
    full = first[:-1] < first[1:]
    begin[first[:-1][full]] = 1
    end[first[1:][full] - 1] = 1
    return np.hstack([x, before * (1 - begin), behind * (1 - end), begin, end, np.ones((len(x), 1))])


@dataclass
class LineField:
    """weights: of the features for bad against good; moves: log factors from state to state; curve: slope and height of the score."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    curve: tuple[float, float]

    def inputs(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return with_neighbours((x - self.mean) / self.scale, first)


def forward_backward(emit: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of bad for each line, and expected counts of the four moves; all texts advance together, line by line."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    begin, n = first[:-1][order], n[order]
    steps = int(n[0]) if len(n) else 0
    active = [int(np.searchsorted(-n, -t, "left")) for t in range(steps)]  # texts of more than t lines
    node = np.stack([np.zeros(len(emit)), emit], 1)
    alpha, beta = np.zeros_like(node), np.zeros_like(node)
    for t in range(steps):
        at = begin[: active[t]] + t
        if t:
            alpha[at] = node[at] + np.logaddexp(alpha[at - 1][:, :1] + moves[0], alpha[at - 1][:, 1:] + moves[1])
        else:
            alpha[at] = node[at]
    pairs = np.zeros((2, 2))
    for t in range(steps - 1, 0, -1):
        at = begin[: active[t]] + t
        ahead = node[at] + beta[at]
        beta[at - 1] = np.logaddexp(moves[:, 0] + ahead[:, :1], moves[:, 1] + ahead[:, 1:])
        joint = alpha[at - 1][:, :, None] + moves + ahead[:, None, :]
        joint -= joint.max(axis=(1, 2), keepdims=True)
        joint = np.exp(joint)
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(0)
    both = alpha + beta
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -50, 50))), pairs


def _fit(z: np.ndarray, y: np.ndarray, first: np.ndarray, rounds: int = 150, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Maximum likelihood of the labels y by gradient steps (Adam) with a small quadratic penalty."""
    inner = np.ones(len(y), bool)
    inner[first[:-1][first[:-1] < len(y)]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:-1][inner[1:]].astype(int), y[1:][inner[1:]].astype(int)), 1)
    theta = np.zeros(z.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        p, pairs = forward_backward(z @ theta[:-4], theta[-4:].reshape(2, 2), first)
        slope = np.concatenate([z.T @ (p - y), (pairs - seen).ravel()]) / len(y) + decay * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def good_share(p_bad: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-weighted probability of good per text, 0 for a text without lines."""
    good = np.concatenate(([0], np.cumsum((1 - p_bad) * size)))
    total = np.concatenate(([0], np.cumsum(size)))
    span = total[first[1:]] - total[first[:-1]]
    return np.where(span > 0, (good[first[1:]] - good[first[:-1]]) / np.maximum(span, 1), 0.0)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, _FLOOR, 1 - _FLOOR)
    return np.log(p / (1 - p))


def _curve(share: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and height of the logistic curve from the share's logit to the label, by Newton steps."""
    a = np.column_stack([_logit(share), np.ones(len(share))])
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(2), a.T @ (weight * (p - label)) + 0.05 * (w - [1, 0]))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit_field(x: np.ndarray, size: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> LineField:
    field = LineField(x.mean(0), x.std(0) + 1e-6, np.zeros(0), np.zeros((2, 2)), (1.0, 0.0))
    z = field.inputs(x, first)
    chains = np.unique(np.concatenate([first, *[np.arange(a, b, CHAIN_LINES) for a, b in zip(first[:-1], first[1:], strict=True)]]))
    of_text = np.repeat(np.arange(len(label)), np.diff(first))
    y = (1 - label)[of_text].astype(float)
    field.weights, field.moves = _fit(z, y, chains)
    p, _ = forward_backward(z @ field.weights, field.moves, chains)
    worst = np.zeros(len(label))
    np.maximum.at(worst, of_text, p)
    y = y * ((p >= 0.5) | (p == worst[of_text]))
    field.weights, field.moves = _fit(z, y, chains)
    p, _ = forward_backward(z @ field.weights, field.moves, first)
    field.curve = _curve(good_share(p, size, first), label, weight)
    return field


#: Texts of more than this share of a label's bytes are not learned from, so that one of them takes no other's place.
LONGEST_SHARE = 16


def _sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, per_label: int, sample_bytes: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts, labels and weights of the bounded training sample."""
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1) AND id IS NOT NULL")
    usable = usable.where(~held_out(F.col("id"))).dropDuplicates(["id"])
    sizes = {r["label"]: r["count"] for r in usable.groupBy("label").count().collect()}
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    chosen = [usable.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(per_label) for k in (0, 1)]
    found = texts.join(F.broadcast(chosen[0].union(chosen[1])), "id").select("id", "label", F.col("text").cast("binary").alias("text"))
    # At most 2 * per_label rows are left, so a window over each label is bounded.
    by_hash = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id", F.xxhash64("text"))
    fits = F.octet_length("text") <= sample_bytes // LONGEST_SHARE
    within = found.where("text IS NOT NULL").where(fits).withColumn("bytes", F.sum(F.octet_length("text")).over(by_hash)).where(F.col("bytes") <= sample_bytes)
    table = within.drop("bytes").toArrow().sort_by("id")
    rows = list(zip(table.column("text").to_pylist(), table.column("label").to_pylist(), strict=True))
    label = np.array([r[1] for r in rows], int)
    drawn = np.bincount(label, minlength=2)
    share = [sizes.get(k, 0) / max(1, sum(sizes.values())) for k in (0, 1)]
    weight = np.array([share[k] * len(rows) / max(1, drawn[k]) for k in label])
    return [bytes(r[0]) for r in rows], label, weight


def held_out(key: Column) -> Column:
    """Whether the row is in the fold that is never trained on."""
    return F.crc32(key.cast("string").cast("binary")) % FOLDS == HELD_OUT_FOLD


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = SAMPLE_PER_LABEL, sample_bytes: int = SAMPLE_BYTES) -> LineField | float:
    """The fitted field; where the training rows lack one of the labels, the share of label 1 (0.5 without rows).

    Labels other than 0 and 1, null ids, null texts and held-out rows are left out, and so are texts of more than a sixteenth of
    sample_bytes; of repeated labels of an id one counts.
    """
    texts, label, weight = _sample(df, labels, id_col, text_col, label_col, per_label, sample_bytes)
    if len(set(label.tolist())) < 2:
        return float(label.mean()) if len(label) else 0.5
    parts = [line_features(texts[lo:hi]) for lo, hi in packs(texts)]
    x, size = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    first = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p[2]) for p in parts]))))
    return fit_field(x, size, first, label, weight)


def score_quality(df: DataFrame, model: LineField | float, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row with held_out, score, predicted and n_lines; one pass, no shuffle. Only the text enters the score.

    Null texts, empty texts and texts without words have no lines and score 0. Rows with a null id are not held out.
    Columns of the names added here are replaced, all others pass through.
    """

    def score(batch: pa.RecordBatch) -> list[pa.Array]:
        blobs = text_bytes(batch, text_col)
        scores, lines = [np.zeros(0)], [np.zeros(0, int)]
        for lo, hi in packs(blobs):
            x, size, first = line_features(blobs[lo:hi])
            lines.append(np.diff(first))
            if isinstance(model, float):
                scores.append(np.where(lines[-1] > 0, model, 0.0))
                continue
            p, _ = forward_backward(model.inputs(x, first) @ model.weights, model.moves, first)
            slope, height = model.curve
            value = 1 / (1 + np.exp(-np.clip(slope * _logit(good_share(p, size, first)) + height, -30, 30)))
            scores.append(np.where(lines[-1] > 0, value, 0.0))
        value = np.concatenate(scores)
        return [pa.array(value), pa.array((value >= threshold).astype(np.int32)), pa.array(np.concatenate(lines).astype(np.int64))]

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_lines", T.LongType())]
    flag = F.coalesce(held_out(F.col(id_col)), F.lit(False))
    return append_columns(df, fields, score).withColumn("held_out", flag)
