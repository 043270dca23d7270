"""Token counts by heap-and-linked-list byte-pair merging.

The count of a text is its initial symbols minus the merges that fit: a heap holds the adjacent pairs by rank, then by
place; the lowest is popped, its right symbol leaves the linked list and the two new pairs are pushed. No token
identifier is ever made. The model file is read for its pieces and ranks only.

A piece of several characters never holds the word mark behind another character, and characters that no chain of pieces
connects (letters of two scripts, letters and punctuation) never meet in one piece. Merges cannot cross those places, so
a text falls into independent segments there, and a task keeps the counts of the segments that it has seen in a table of
bounded size.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections.abc import Iterable

import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from priceloom.llm.common import append_columns

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Segments whose counts a task keeps, and the characters beyond which a segment is not kept.
CACHE_SIZE = 400_000
CACHE_CHARS = 64
MAX_TOKENS = 4096


def connected(pieces: Iterable[str]) -> list[set[str]]:
    """Classes of characters that meet in pieces, directly or through others, the largest first; the word mark is in none."""
    parent: dict[str, str] = {}

    def root(c: str) -> str:
        while parent.setdefault(c, c) != c:
            c = parent[c]
        return c

    for piece in pieces:
        if inner := piece.lstrip(MARK):
            for c in inner[1:]:
                parent[root(c)] = root(inner[0])
            root(inner[0])
    classes: dict[str, set[str]] = {}
    for c in parent:
        classes.setdefault(root(c), set()).add(c)
    return sorted(classes.values(), key=len, reverse=True)


class PieceModel:
    """Pieces with their ranks, and the splitting pattern that follows from them."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = {}
        self.single: set[str] = set()
        for i in range(model.get_piece_size()):
            if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            piece = model.id_to_piece(i)
            (self.single.add(piece) if len(piece) == 1 else pieces.__setitem__(piece, -model.get_score(i)))
        self.rank: dict[str, float] = pieces
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds the word mark behind another character: segments would not be independent")
        classes = "|".join(f"{MARK}*[{''.join(map(re.escape, sorted(c)))}]+" for c in connected(pieces))
        self.segments = re.compile(f"{classes}|{MARK}+|.", re.S)
        self.cached = functools.lru_cache(CACHE_SIZE)(self.segment_count)

    def symbol_count(self, symbol: str) -> int:
        """Tokens of a symbol that is left: itself, or its bytes if the model does not know it."""
        return 1 if len(symbol) > 1 or symbol in self.single else len(symbol.encode())

    def segment_count(self, text: str) -> int:
        n = len(text)
        if n == 1:
            return self.symbol_count(text)
        symbols: list[str | None] = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        heap = [(r, i, p) for i in range(n - 1) if (r := rank.get(p := text[i : i + 2])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, left, pair = heapq.heappop(heap)
            right = after[left]
            if symbols[left] is None or right >= n or symbols[left] + symbols[right] != pair:
                continue
            symbols[left], symbols[right] = pair, None
            after[left] = following = after[right]
            merges += 1
            if following < n:
                before[following] = left
                if (r := rank.get(p := pair + symbols[following])) is not None:
                    heapq.heappush(heap, (r, left, p))
            if (previous := before[left]) >= 0 and (r := rank.get(p := symbols[previous] + pair)) is not None:
                heapq.heappush(heap, (r, previous, p))
        bytes_more = sum(len(c.encode()) - 1 for c in symbols if c and len(c) == 1 and c not in self.single)
        return n - merges + bytes_more

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        cached, long = self.cached, self.segment_count
        return sum(cached(s) if len(s) <= CACHE_CHARS else long(s) for s in self.segments.findall(marked))


@functools.lru_cache(2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def token_counts(df: DataFrame, text_col: str = "text", model_path: str | None = None, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Every row with n_bytes, n_tokens and over_limit (n_tokens > max_tokens); one pass, no shuffle.

    Null and empty texts have 0 bytes and 0 tokens. Texts are counted whole, whatever their length. Columns of the names
    added here are replaced, all others pass through. An empty table gives an empty table.
    """
    path = model_path or public_tokenizers.path(MODEL)

    def count(batch: pa.RecordBatch) -> list[pa.Array]:
        model = piece_model(path)
        texts = [x or "" for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
        tokens = [model.count(x) for x in texts]
        return [
            pa.array([len(x.encode()) for x in texts], pa.int64()),
            pa.array(tokens, pa.int64()),
            pa.array([n > max_tokens for n in tokens], pa.bool_()),
        ]

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return append_columns(df, fields, count)
