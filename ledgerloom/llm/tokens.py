"""Encoding of a corpus with a public byte-level BPE vocabulary, without regular expressions.

Pre-tokenisation runs over all code points of a batch at once. Each code point gets a class from a
table; a finite automaton whose states say what kind of token is open turns classes into token
boundaries. Because a class is a function from states to states and functions compose
associatively, the automaton is evaluated as a scan: within fixed blocks for all blocks and all
start states side by side, then across blocks. The slices go through a cache of merged pieces.
"""

from __future__ import annotations

import base64
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TOKENIZERS = "/opt/tokenizers"

# The white space of Unicode (property White_Space).
WHITE_SPACE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]

# Classes of code points. The last four depend on what follows.
LETTER, NUMBER, OTHER, SPACE, BREAK, QUOTE_1, QUOTE_2, BLANK_LAST, SPACE_LAST = range(9)
# States: what is open after a code point.
START, WORD, DIGITS, MARKS, GAP, PREFIX, ENDING_1, ENDING_2, ENDING_1_OF_2 = range(9)
STATES = 9


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE for every code point, by its Unicode general category."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE_SPACE] = SPACE
    return table


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, does a token begin here), both by [class, state].

    A word, number or run of marks may begin with one blank, the last one before it (PREFIX). A run
    of white space keeps its last character apart from what precedes it if something else follows.
    An apostrophe that begins a token takes the English endings s t d m / ll re ve with it.
    """
    to = np.zeros((9, STATES), np.uint8)
    cut = np.ones((9, STATES), bool)
    for kind, state in ((LETTER, WORD), (NUMBER, DIGITS), (OTHER, MARKS)):
        to[kind] = state
        cut[kind, [state, PREFIX]] = False
    # The letters of an ending belong to it; what follows them begins anew.
    to[LETTER, ENDING_1], to[LETTER, ENDING_2], to[LETTER, ENDING_1_OF_2] = START, ENDING_1_OF_2, START
    cut[LETTER, [ENDING_1, ENDING_2, ENDING_1_OF_2]] = False
    for kind, state in ((QUOTE_1, ENDING_1), (QUOTE_2, ENDING_2)):
        to[kind] = state
        to[kind, [MARKS, PREFIX]] = MARKS  # an apostrophe within marks, or after a blank, is a mark
        cut[kind, [MARKS, PREFIX]] = False
    to[SPACE] = GAP
    cut[SPACE, GAP] = False
    to[SPACE_LAST], to[BLANK_LAST] = START, PREFIX  # each the last white space before something else
    to[BREAK] = START
    return to, cut


def boundaries(classes: np.ndarray, block: int = 128) -> np.ndarray:
    """Where tokens begin, by an associative scan over the transition functions of ``classes``."""
    to, cut = automaton()
    n = len(classes)
    blocks = -(-n // block)
    padded = np.full(blocks * block, BREAK, np.uint8)
    padded[:n] = classes
    steps = np.ascontiguousarray(padded.reshape(blocks, block).T)
    # Composition within blocks: what each block makes of each state it may be entered in.
    whole = np.tile(np.arange(STATES, dtype=np.uint8), (blocks, 1))
    for c in steps:
        whole = to[c[:, None], whole]
    # Across blocks: inclusive scan by doubling, function after function.
    reach = 1
    while reach < blocks:
        whole[reach:] = _after(whole[:-reach], whole[reach:])
        reach *= 2
    state = np.concatenate([[START], whole[:-1, START]]).astype(np.uint8)
    begins = np.empty((block, blocks), bool)
    for i, c in enumerate(steps):
        begins[i] = cut[c, state]
        state = to[c, state]
    return begins.T.reshape(-1)[:n]


def _after(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Row-wise composition: the second function applied to the first one's result."""
    return np.take_along_axis(second, first, axis=1)


def classify(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Classes of concatenated texts; ``ends``: positions of the separators, one after each text."""
    c = class_table()[points].copy()
    c[ends] = BREAK
    space, after = c == SPACE, np.append(c[1:], BREAK)
    # Followed by neither white space nor the text's end.
    last = space & (after != SPACE) & (after != BREAK)
    blank = points == 32
    c[last] = SPACE_LAST
    c[last & blank] = BLANK_LAST
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        tail = np.append(points, [0, 0, 0])
        one, two = tail[quotes + 1], tail[quotes + 2]
        c[quotes[np.isin(one, [ord(x) for x in "stmd"])]] = QUOTE_1
        pair = one.astype(np.int64) * 256 + np.minimum(two, 255)
        c[quotes[np.isin(pair, [ord(a) * 256 + ord(b) for a, b in ("re", "ve", "ll")])]] = QUOTE_2
    return c


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of least rank (leftmost first) is merged until none is in the vocabulary.

    With a heap over a linked list, so that a piece of n bytes takes O(n log n) steps.
    """
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # part at i: piece[i:end[i]]; 0 when merged away
    prev = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            prev[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if i and (r := ranks.get(piece[prev[i] : stop])) is not None:
            heappush(heap, (r, prev[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes batches of texts; keeps merged pieces between batches, up to ``cache_pieces`` of them."""

    def __init__(self, ranks: dict[bytes, int], cache_pieces: int = 500_000, cache_chars: int = 64):
        self.ranks, self.cache, self.cache_pieces, self.cache_chars = ranks, {}, cache_pieces, cache_chars

    def pieces(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """The texts joined by a separator, the places at which tokens begin, and the separators' places."""
        joined = "\0".join([*texts, ""])
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        return joined, np.flatnonzero(boundaries(classify(points, ends))), ends

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ids per text, piece offsets in code points, ids per piece) of all texts, in order."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined, starts, ends = self.pieces(texts)
        bounds = [*starts.tolist(), len(joined)]
        cache, get = self.cache, self.cache.get
        separators, flat, sizes = set(ends.tolist()), [], []
        extend = flat.extend
        for a, b in zip(bounds, bounds[1:], strict=False):
            if a in separators:
                sizes.append(0)
                continue
            piece = joined[a:b]
            if (ids := get(piece)) is None:
                ids = merge(piece.encode("utf-8", "replace"), self.ranks)
                if len(piece) <= self.cache_chars:
                    if len(cache) >= self.cache_pieces:
                        cache.clear()
                    cache[piece] = ids
            extend(ids)
            sizes.append(len(ids))
        sizes = np.array(sizes, np.int64)
        text_of = np.searchsorted(ends, starts)
        per_text = np.bincount(text_of, weights=sizes, minlength=len(texts)).astype(np.int64)
        kept = sizes > 0
        origin = np.concatenate([[0], ends[:-1] + 1])
        return np.array(flat, np.int32), per_text, (starts - origin[text_of])[kept], sizes[kept]


def encode_corpus(
    df: DataFrame, id_col: str, text_col: str, vocabulary: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS,
    offsets: bool = False, batch_chars: int = 1_000_000,
) -> DataFrame:
    """``id_col`` and ``ids`` (array<int>) of every row, in ordinary encoding (no special tokens).

    Null and empty texts give an empty array; nothing is trimmed or normalised. With ``offsets`` also
    ``piece_starts`` (code points into the text) and ``piece_ids`` (ids per piece), which tell each
    piece's place for decoding. One row in, one row out, in map tasks without a shuffle; a task
    holds about ``batch_chars`` characters at a time, or one text if that is longer.

    The vocabulary file ``{tokenizers}/{vocabulary}.tiktoken`` must be readable on every executor.
    """
    path = f"{tokenizers}/{vocabulary}.tiktoken"
    id_type = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, ids array<int>" + (", piece_starts array<int>, piece_ids array<int>" if offsets else "")

    def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load_ranks(path))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            start = 0
            while start < len(texts):
                stop, chars = start, 0
                while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= batch_chars):
                    chars += len(texts[stop])
                    stop += 1
                ids, per_text, at, sizes = encoder.encode(texts[start:stop])
                columns = [b.column(0).slice(start, stop - start), lists(ids, per_text)]
                if offsets:
                    ends = np.cumsum(per_text)
                    owner = np.searchsorted(ends, np.cumsum(sizes), side="left")
                    pieces = np.bincount(owner, minlength=stop - start) if len(sizes) else np.zeros(stop - start, np.int64)
                    columns += [lists(at, pieces), lists(sizes, pieces)]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "piece_starts", "piece_ids"][: len(columns)])
                start = stop

    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode_corpus(df: DataFrame, id_col: str, ids_col: str = "ids", vocabulary: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS) -> DataFrame:
    """``id_col`` and ``text`` of encoded rows; a null array gives a null text, ids outside the vocabulary raise."""
    path = f"{tokenizers}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {i: t for t, i in load_ranks(path).items()}
        for b in batches:
            texts = [None if ids is None else b"".join([known[i] for i in ids]).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, text string")
