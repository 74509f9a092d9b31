"""Evaluation passages in training text: a stored positional inverted index, searched from the rarest terms.

The index is cut by documents into segments. A segment holds the postings (token positions by term) of a
block of documents and is one row of a written table, so that neither building nor searching shuffles a
posting, and any number of test sets can be searched without reading the texts again. Test items are
the queries; they go to the tasks in bounded blocks, and one vectorised pass a segment answers a block.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ledgerloom.scratch import Scratch

#: Tokens of test items that one pass over the index answers; more take further passes.
ITEM_TOKENS = 2_000_000

_ESCAPES = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|%([0-9a-fA-F]{2})(?:%([0-9a-fA-F]{2}))?")
_CONTROLS = re.compile(r"\\+[nrt]|\\+(?=[\"'/\\])")
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]{0,80}>")
_INVISIBLE = re.compile("[͏­؜ᅟᅠ᠋-᠎​-‏‪-‮⁠-⁯︀-️︠-︯﻿]")
_MARKS = re.compile("[̀-ͯ]")
#: A word as it stands, its accents written apart or not.
_RAW = re.compile("[^\\W_][^\\W_̀-ͯ]*(?:[̀-ͯ]+[^\\W_]*)*")
_WORD = re.compile(r"[^\W_]+")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑]\s*\n\s*(?:[>|*#]\s*)?(?=[^\W\d_])")

# Letters of other scripts that look like Latin ones, and what they look like.
LOOKALIKES = str.maketrans(
    "авекмнорстухіјѕԁԛԝһαεικνορτυχıłøđ",
    "abekmhopctyxijsdqwhaeiknoptuxilod",
)


def _unescape(m: re.Match) -> str:
    if m[1] or m[2]:
        return chr(int(m[1] or m[2], 16))
    first, second = int(m[3], 16), m[4] and int(m[4], 16)
    if second and first >= 0xC2:
        return bytes([first, second]).decode("utf-8", "replace")
    return chr(first) + (chr(second) if second else "") if first < 128 else " "


def raw_words(text: str | None) -> list[str]:
    """Words as they stand in the text once layout, markup and escapes are gone."""
    t = text or ""
    if "\\" in t or "%" in t:
        t = _CONTROLS.sub(" ", _ESCAPES.sub(_unescape, t))
    if "&" in t:
        t = html.unescape(html.unescape(t))
    if "<" in t:
        t = _MARKUP.sub(" ", t)
    if not t.isascii():
        t = _INVISIBLE.sub("", t)
    if "\n" in t:
        t = _BROKEN.sub("", t)
    return _RAW.findall(t)


@lru_cache(maxsize=200_000)
def normal(raw: str) -> tuple[str, ...]:
    """What a word is compared by, whatever its case and character forms; some forms stand for several words or none."""
    if raw.isascii():
        return (raw.lower(),)
    return tuple(_WORD.findall(_MARKS.sub("", unicodedata.normalize("NFKD", raw)).casefold().translate(LOOKALIKES)))


def words(text: str | None) -> list[str]:
    """Words of a text, alike whatever its layout, case, punctuation, character forms and escapes."""
    return [w for raw in raw_words(text) for w in normal(raw)]


def term(word: str) -> int:
    """The number of a term, the same in every segment and every test set."""
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def tokens_of(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token as an index of terms, terms, tokens of each text)."""
    raws = [raw_words(t) for t in texts]
    sizes = np.array([len(r) for r in raws], np.int64)
    code, kinds = pd.factorize(np.array([w for r in raws for w in r], object))
    forms = [normal(w) for w in kinds]
    several = np.array([len(f) for f in forms], np.int64)
    flat, terms = pd.factorize(np.array([w for f in forms for w in f], object))
    starts = np.concatenate([[0], np.cumsum(several)[:-1]]).astype(np.int64) if len(forms) else several
    times = several[code]
    ahead = np.concatenate([[0], np.cumsum(times)]).astype(np.int64)
    token = flat[np.repeat(starts[code] - ahead[:-1], times) + np.arange(ahead[-1])] if len(code) else np.zeros(0, np.int64)
    bounds = ahead[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)]
    return token.astype(np.int64), np.array([term(w) for w in terms], np.int64), np.diff(bounds)


class Segment:
    """Positional index of a block of documents: ``terms`` in order, and per term the sorted positions of its tokens."""

    def __init__(self, terms: np.ndarray, starts: np.ndarray, postings: np.ndarray, begins: np.ndarray):
        #: ``begins`` has the first position of each document and, last, one past the end; ``GAP`` positions part documents.
        self.terms, self.starts, self.postings, self.begins = terms, starts, postings, begins
        self.counts = np.diff(starts)
        self.tokens = np.full(int(begins[-1]), -1, np.int32)
        self.tokens[postings] = np.repeat(np.arange(len(terms), dtype=np.int32), self.counts)

    @classmethod
    def build(cls, texts: Sequence[str | None]) -> Segment:
        token, terms, sizes = tokens_of(texts)
        begins = GAP + np.concatenate([[0], np.cumsum(sizes + GAP)]).astype(np.int64)
        at = np.arange(len(token)) + np.repeat(begins[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes).astype(np.int64)
        by_number = np.argsort(terms, kind="stable")
        place = np.empty(len(terms), np.int64)
        place[by_number] = np.arange(len(terms))
        order = np.argsort(place[token], kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(place[token], minlength=len(terms)))])
        return cls(terms[by_number], starts, at[order], begins)

    def locate(self, numbers: np.ndarray) -> np.ndarray:
        """The place of each term in this segment, -1 for those it hasn't."""
        if not len(self.terms):
            return np.full(len(numbers), -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, numbers), len(self.terms) - 1)
        return np.where(self.terms[at] == numbers, at, -1)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, position, side="right") - 1


#: Empty positions between documents and between items, as many as the longest phrase looked for has words.
GAP = 5


def build_index(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 2_000_000) -> DataFrame:
    """The positional index of ``documents`` as a table, one row a segment.

    ``ids``: the documents; ``begins``: their first positions; ``terms``: 64-bit numbers of the terms, in order; ``starts``:
    where each term's postings begin; ``gaps``: the postings, each less the one before it, which compresses well.
    Null texts aren't indexed. A segment holds ``block_chars`` characters or one longer text, whole.
    """
    docs = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema["id"].dataType.simpleString()
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for start, stop in blocks([len(t) for t in texts], block_chars):
                s = Segment.build(texts[start:stop])
                ids = pa.ListArray.from_arrays(pa.array([0, stop - start], pa.int32()), b.column(0).slice(start, stop - start))
                lists = [pa.array([x], t) for x, t in ((s.begins, ints), (s.terms, longs), (s.starts, ints), (np.diff(s.postings, prepend=0), ints))]
                yield pa.RecordBatch.from_arrays([ids, *lists], names=["ids", "begins", "terms", "starts", "gaps"])

    return docs.mapInArrow(run, f"ids array<{kind}>, begins array<int>, terms array<long>, starts array<int>, gaps array<int>")


def blocks(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs (start, stop) of about ``most`` in all, a larger one by itself."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def piece(n: int, window: int = GAP) -> int:
    """Words of the passage that an item of ``n`` words is looked for by: a third of it; all of it below ``window`` words."""
    return n if n < window else -(-n // 3)


class Queries:
    """A block of test items, concatenated with gaps, by the length of the phrases they are looked for with."""

    def __init__(self, items: Sequence[tuple[str, Sequence[int]]], window: int):
        self.ids = [i for i, _ in items]
        self.seqs = [np.asarray(s, np.int64) for _, s in items]
        self.terms, codes = np.unique(np.concatenate([np.zeros(0, np.int64), *self.seqs]), return_inverse=True)
        ends = np.cumsum([0, *map(len, self.seqs)])
        self.codes = [codes[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        #: Per phrase length: (codes, item) of each place, -1 in the gaps.
        self.runs = {}
        for w in sorted({min(window, piece(len(s), window)) for s in self.seqs}):
            some = [i for i, s in enumerate(self.seqs) if min(window, piece(len(s), window)) == w]
            gap = np.full(window, -1)
            code = np.concatenate([gap, *(x for i in some for x in (self.codes[i], gap))])
            owner = np.concatenate([gap, *(x for i in some for x in (np.full(len(self.codes[i]), i), gap))])
            self.runs[w] = code, owner
        self.sizes = np.array([len(s) for s in self.seqs], np.int64)

    def at(self, segment: Segment) -> np.ndarray:
        """The places of the block's terms in the segment; its last element is the gaps'."""
        return np.append(segment.locate(self.terms), -1)


def phrase_hits(segment: Segment, seq: np.ndarray, gap: np.ndarray, window: int, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(document position, item position, words to the left, to the right) of anchors of exact phrases of ``window`` or more words.

    ``seq`` holds all items with gaps between. Of every window of an item the rarest term is an anchor, so each
    phrase of that length holds one. The anchors' postings, moved by their offset, are intersected with those of
    the terms next to them, then of the rest of the phrase (at most ``window`` - 1 words each way).
    """
    rarity = np.where(gap, -1, np.where(seq >= 0, segment.counts[np.maximum(seq, 0)] if len(segment.counts) else 0, 0))
    views = np.lib.stride_tricks.sliding_window_view(rarity, window)
    anchors = np.unique(views.argmin(axis=1) + np.arange(len(views)))
    anchors = anchors[rarity[anchors] > 0]
    tokens = np.concatenate([np.full(window, -1, np.int32), segment.tokens, np.full(window, -1, np.int32)])
    wanted = np.concatenate([np.full(window, -2), np.where(seq >= 0, seq, -2), np.full(window, -2)])
    for first, last in blocks(rarity[anchors], most):
        some = anchors[first:last]
        sizes = rarity[some]
        item_at = np.repeat(some, sizes)
        firsts = np.repeat(segment.starts[seq[some]] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        doc_at = segment.postings[firsts + np.arange(len(firsts))]
        if window > 1:
            near = (tokens[doc_at + window - 1] == wanted[item_at + window - 1]) | (tokens[doc_at + window + 1] == wanted[item_at + window + 1])
            doc_at, item_at = doc_at[near], item_at[near]
        left, right = np.zeros(len(doc_at), np.int64), np.zeros(len(doc_at), np.int64)
        for count, side in ((left, -1), (right, 1)):
            on = np.arange(len(doc_at))
            for step in range(1, window):
                on = on[tokens[doc_at[on] + window + side * step] == wanted[item_at[on] + window + side * step]]
                count[on] += 1
        whole = left + right + 1 >= window
        yield doc_at[whole], item_at[whole], left[whole], right[whole]


def run_codes(tokens: np.ndarray, run: int, base: int) -> np.ndarray:
    """A number for each run of ``run`` tokens (-1 or more, less than ``base`` - 2)."""
    code = np.zeros(max(len(tokens) - run + 1, 0), np.int64)
    for k in range(run):
        code = code * base + tokens[k : len(tokens) - run + 1 + k] + 2
    return code


def run_length(n: int, window: int = GAP) -> int:
    """Words of the runs that ``carried`` compares: three, fewer where a third of the item is shorter."""
    return min(3, piece(n, window))


def carried(
    of_doc: np.ndarray, ranked: np.ndarray, order: np.ndarray, n: int, window: int = GAP, least: float = 0.0, reach: int = 14, drift: int = 4, company: int = 10, bridge: int = 3,
) -> tuple[float, list[tuple[int, int, int]]]:
    """Share of the item's ``n`` words that the document carries, and its passages: proximity matches in the item's order.

    ``of_doc``: the document's run codes; ``ranked``, ``order``: the item's, in order, with their places.

    Equal runs (``run_length``) count where ``company`` others lie within ``reach`` words of the item at an offset
    that differs by at most ``drift``: passages in the item's own words, with altered, lost or added words between, but
    no stock phrases. Of a short item fewer others are asked for: a third of those that an unaltered third of it holds.
    Up to ``bridge`` words between two carried ones count as carried. Passages: (first word of the item, its words,
    first word of the document). A share that cannot reach ``least``, even if every equal run counted, is given as 0 early.
    """
    run = run_length(n, window)
    company = min(company, (piece(n, window) - run) // 3)
    lo, hi = np.searchsorted(ranked, of_doc), np.searchsorted(ranked, of_doc, side="right")
    times = hi - lo
    at_doc = np.repeat(np.arange(len(of_doc)), times)
    if not len(at_doc):
        return 0.0, []
    at_item = order[np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(len(at_doc))]
    places = np.unique(at_item)
    steps = np.diff(places, append=places[-1] + n)
    if np.where(steps <= run + bridge, steps, run).sum() < least * n:
        return 0.0, []
    shift = at_doc - at_item
    # In the order of their offset, of which each holds at most one match a place: a text that repeats an item stays linear.
    by_shift = np.argsort(shift, kind="stable")
    at_item, shift = at_item[by_shift], shift[by_shift]
    good = np.zeros(len(at_item), bool)
    for i in range(0, len(at_item), 512):
        a, s = at_item[i : i + 512], shift[i : i + 512]
        from_, to = np.searchsorted(shift, s[0] - drift), np.searchsorted(shift, s[-1] + drift, side="right")
        close = (np.abs(at_item[None, from_:to] - a[:, None]) <= reach) & (np.abs(shift[None, from_:to] - s[:, None]) <= drift)
        good[i : i + 512] = close.sum(axis=1) > company
    covered, begins = np.zeros(n + 1, bool), np.full(n, np.iinfo(np.int64).max)
    for k in range(run):
        covered[at_item[good] + k] = True
        np.minimum.at(begins, at_item[good] + k, at_item[good] + shift[good] + k)
    where = np.flatnonzero(covered)
    for a, b in zip(where[:-1], where[1:], strict=True):
        if b - a <= bridge + 1:
            covered[a:b] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[False], covered])))
    return float(covered[:n].mean()), [(int(a), int(b - a), int(begins[a])) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def search_segment(segment: Segment, queries: Queries, window: int, first_share: float, least_share: float) -> Iterator[tuple[int, int, float, list, list]]:
    """(document number, item number, share carried, passages, exact phrases) of all pairs with enough exact phrases."""
    place, base = queries.at(segment), len(segment.terms) + 3
    codes_of: dict[int, np.ndarray] = {}
    ordered: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def measured(d: int, i: int) -> tuple[float, list[tuple[int, int, int]]]:
        n = int(queries.sizes[i])
        run = run_length(n, window)
        if run not in codes_of:
            codes_of[run] = run_codes(segment.tokens, run, base)
        if i not in ordered:
            code = run_codes(place[queries.codes[i]], run, base)
            order = np.argsort(code, kind="stable")
            ordered[i] = code[order], order
        # Runs that reach into the gap behind the document hold a -1, which unknown words of an item also have: they end before it.
        here = codes_of[run][segment.begins[d] : max(segment.begins[d], segment.begins[d + 1] - GAP - run + 1)]
        return carried(here, *ordered[i], n, window, least_share)

    for w, (code, owner) in queries.runs.items():
        inside = np.flatnonzero(owner >= 0)
        first = np.zeros(len(queries.sizes), np.int64)
        first[owner[inside[::-1]]] = inside[::-1]
        spans, hits = [], []
        for doc_at, item_at, left, right in phrase_hits(segment, place[code], owner < 0, w):
            pair = segment.document(doc_at) * len(queries.sizes) + owner[item_at]
            for k in range(1 - w, w):
                on = (k >= -left) & (k <= right)
                spans.append(np.unique(pair[on] * len(code) + item_at[on] + k))
            hits.append(np.stack([pair, doc_at - left, item_at - left, left + right + 1]))
        if not spans:
            continue
        # Words of the item in exact phrases, by document and item.
        pairs, held = np.unique(np.unique(np.concatenate(spans)) // len(code), return_counts=True)
        pairs = pairs[held >= first_share * queries.sizes[pairs % len(queries.sizes)]]
        found = np.concatenate(hits, axis=1)
        found = found[:, np.isin(found[0], pairs)]
        found = found[:, np.argsort(found[0], kind="stable")]
        for p in pairs:
            d, i = divmod(int(p), len(queries.sizes))
            share, passages = measured(d, i)
            if share >= least_share:
                some = found[:, np.searchsorted(found[0], p) : np.searchsorted(found[0], p, side="right")]
                yield d, i, share, passages, _joined(some[1] - segment.begins[d], some[2] - first[i], some[3])


def _joined(doc_at: np.ndarray, item_at: np.ndarray, size: np.ndarray) -> list[tuple[int, int, int]]:
    """Exact phrases (item word, words, document word); those that overlap along one offset become one."""
    out: list[list[int]] = []
    for s, a, n in sorted(zip((doc_at - item_at).tolist(), item_at.tolist(), size.tolist(), strict=True)):
        if out and out[-1][3] == s and a <= out[-1][0] + out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n - out[-1][0])
        else:
            out.append([a, n, a + s, s])
    return sorted((a, n, d) for a, n, d, _ in out)


MATCH = "array<struct<item_at: int, words: int, doc_at: int>>"


def search_index(index: DataFrame, queries: Queries, window: int, first_share: float, least_share: float) -> DataFrame:
    """(``id``, ``item_id``, ``share``, ``passages``, ``phrases``) of one block of items over a written index."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    shared = index.sparkSession.sparkContext.broadcast(queries)  # bounded by ITEM_TOKENS
    match = pa.list_(pa.struct([("item_at", pa.int32()), ("words", pa.int32()), ("doc_at", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for b in batches:
            for row in range(b.num_rows):
                ids, begins, terms, starts, gaps = (b.column(c).slice(row, 1).flatten() for c in range(5))
                numbers = [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, starts, gaps, begins)]
                segment = Segment(numbers[0], numbers[1], np.cumsum(numbers[2]), numbers[3])
                hits = list(search_segment(segment, items, window, first_share, least_share))
                if hits:
                    d, i, share, passages, phrases = zip(*hits, strict=True)
                    struct = lambda ms: pa.array([[dict(zip(("item_at", "words", "doc_at"), m, strict=True)) for m in ms_] for ms_ in ms], match)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(d)), pa.array([items.ids[j] for j in i], pa.string()), pa.array(share, pa.float64()), struct(passages), struct(phrases)],
                        names=["id", "item_id", "share", "passages", "phrases"])

    return index.select("ids", "begins", "terms", "starts", "gaps").mapInArrow(run, f"id {kind}, item_id string, share double, passages {MATCH}, phrases {MATCH}")


def own_words(items: DataFrame) -> DataFrame:
    """(``item_id``, ``own``): term numbers of each prompt without the words that all different prompts of its suite begin with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = [[term(w) for w in words(t)] for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(seqs, pa.list_(pa.int64()))], names=["item_id", "suite", "seq"])

    rows = items.where(F.col("item_id").isNotNull() & F.col("prompt").isNotNull()).select(F.col("item_id").cast("string"), F.col("suite").cast("string").alias("suite"), "prompt")
    seqs = rows.mapInArrow(run, "item_id string, suite string, seq array<long>")
    # What the least and the greatest sequence of a suite share, all share.
    ends = seqs.where(F.size("seq") > 0).groupBy("suite").agg(F.min("seq").alias("a"), F.max("seq").alias("z")).select(F.col("suite").alias("of"), "a", "z")
    n = F.least(F.size("a"), F.size("z"))
    differs = F.array_position(F.zip_with(F.slice("a", F.lit(1), n), F.slice("z", F.lit(1), n), lambda x, y: x != y), True)
    opening = F.when(F.col("a") == F.col("z"), 0).when(differs > 0, differs - 1).otherwise(n).cast("int")
    joined = seqs.where(F.size("seq") > 0).join(ends.withColumn("opening", opening), F.col("suite").eqNullSafe(F.col("of")))
    return joined.select("item_id", F.slice("seq", F.col("opening") + 1, F.greatest(F.size("seq") - F.col("opening"), F.lit(0))).alias("own")).where(F.size("own") > 0)


def item_blocks(rows: Iterator[Row], window: int) -> Iterator[Queries]:
    """The items in blocks of ``ITEM_TOKENS`` tokens, read one by one."""
    held, tokens = [], 0
    for r in rows:
        if held and tokens + len(r["own"]) > ITEM_TOKENS:
            yield Queries(held, window)
            held, tokens = [], 0
        held.append((r["item_id"], r["own"]))
        tokens += len(r["own"])
    if held:
        yield Queries(held, window)


def find_leaks(
    documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_share: float = 0.32, window: int = GAP,
    first_share: float = 0.08, block_chars: int = 2_000_000,
) -> DataFrame:
    """(``id_col``, ``item_id``, ``share``, ``passages``, ``phrases``): documents that carry ``least_share`` or more of an item's own words.

    The default lies a little under a third, as words at the edges of altered passages aren't counted.
    ``phrases`` are the exact matches, ``passages`` the proximity matches, both as (first word of the item's own,
    number of words, first word of the document), counted from 0.

    ``items``: ``item_id``, ``suite``, ``prompt``. What all prompts of a suite open with is no item's own text. The
    documents are indexed whole (``build_index``, written once) and the index is searched for exact phrases of
    ``window`` words; documents in which they touch ``first_share`` of an item's words are then measured by ``carried``. Items
    of under fifteen words are looked for with shorter phrases, of a third of their words, so that any third of an item of any
    length comes out in one piece; items of one to four words with the whole of them. In long items (from about a hundred
    words) a piece counts from thirteen words: shorter ones are stock phrases, which texts of the same style share.

    Null prompts and ids and items without own words aren't looked for; null and empty texts carry nothing. Of repeated
    item ids each prompt is searched, the greatest share counts. A text of any length is indexed whole.
    Empty tables give no rows. ``window`` can be 1 to ``GAP``.
    """
    scratch = Scratch(documents.sparkSession, "leaks")
    index = scratch.save(build_index(documents, id_col, text_col, block_chars))
    own = scratch.save(own_words(items))
    # One block of items at a time is on the driver; what it finds is written before the next is read.
    found = None
    for queries in item_blocks(own.toLocalIterator(), window):
        hits = scratch.save(search_index(index, queries, window, first_share, least_share))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        kind = index.schema["ids"].dataType.elementType.simpleString()
        found = documents.sparkSession.createDataFrame([], f"id {kind}, item_id string, share double, passages {MATCH}, phrases {MATCH}")
    scratch.discard(index, own)  # what was found is written
    # Few rows are left; repeated item ids fold into one.
    best = found.groupBy("id", "item_id").agg(F.max(F.struct("share", "passages", "phrases")).alias("m"))
    return best.select(F.col("id").alias(id_col), "item_id", F.round("m.share", 6).alias("share"), "m.passages", "m.phrases")
