"""Encoding against the vocabulary's own library."""

import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.tokens import TOKENIZERS, Encoder, automaton, boundaries, decode_corpus, encode_corpus, load_ranks, merge

tiktoken = pytest.importorskip("tiktoken")
PATH = f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = ["'", "'s", "'ll", "'re", "'ve", "'S", " ", "  ", "\n", "\t", "a", "bc", "é", "1", "٣", "²", "!", "…", " ", "　", "​", "\x1c", "\x85", "😀", "l", "e", "́", "漢", "\r\n", "<|endoftext|>", "\0"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(texts):
    ids, per, _, _ = Encoder(load_ranks(PATH)).encode(texts)
    out, at = [], 0
    for n in per:
        out.append(ids[at : at + n].tolist())
        at += n
    return out


def test_mixtures_of_hard_pieces(reference):
    rng = random.Random(1)
    texts = ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(4000)]
    assert encoded(texts) == [reference.encode_ordinary(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=40), max_size=4))
def test_any_text(texts):
    back = {i: b for b, i in load_ranks(PATH).items()}
    for t, ids in zip(texts, encoded(texts), strict=True):
        assert b"".join(back[i] for i in ids).decode() == t


def test_long_texts_and_long_pieces(reference):
    texts = ["a" * 20_000, "ab" * 5_000 + " " * 3_000 + "!" * 4_000, "word " * 20_000]
    assert encoded(texts) == [reference.encode_ordinary(t) for t in texts]


def test_scan_equals_stepping_through_the_automaton():
    import numpy as np

    to, cut = automaton()
    classes = np.random.default_rng(2).integers(0, 9, 5000).astype(np.uint8)
    state, want = 0, []
    for c in classes:
        want.append(cut[c, state])
        state = to[c, state]
    for block in (1, 7, 128, 9000):
        assert (boundaries(classes, block) == np.array(want)).all()


def test_merge_takes_the_leftmost_of_equal_ranks():
    ranks = {b"a": 0, b"aa": 1, b"aaaa": 2}
    assert merge(b"aaaaa", ranks) == [2, 0] and merge(b"aaa", ranks) == [1, 0]


def test_corpus_with_nulls_empties_offsets_and_round_trip(spark, reference):
    texts = [None, "", " ", "It's 12 o'clock — «né» 漢字\n\n ok", "x" * 3000, "'s" * 50, None]
    df = spark.createDataFrame([(i, t, "e", [1]) for i, t in enumerate(texts)], "doc_id long, text string, extra string, ids array<int>")
    out = encode_corpus(df, "doc_id", "text", offsets=True, batch_chars=50)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert r.ids == ([] if not t else reference.encode_ordinary(t))
        at = 0
        for j, (start, n) in enumerate(zip(r.piece_starts, r.piece_ids, strict=True)):
            stop = r.piece_starts[j + 1] if j + 1 < len(r.piece_starts) else len(t)
            assert reference.decode(r.ids[at : at + n]) == t[start:stop]
            at += n
        assert at == len(r.ids)
    back = {r.doc_id: r.text for r in decode_corpus(out, "doc_id").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0
