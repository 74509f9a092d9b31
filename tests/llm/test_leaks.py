"""Planted passages in invented text."""

import random

import numpy as np
import pytest

from ledgerloom.llm.leaks import Queries, Segment, build_index, carried, find_leaks, own_words, run_codes, search_segment, term, words

WORDS = [a + b for a in ("ba", "ko", "mi", "tru", "sel", "vo", "dan", "gri") for b in ("rta", "len", "mok", "sin", "tal", "ver", "nop", "dus")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def setup(seed=1, items=12):
    rng = random.Random(seed)
    intro = "Read the case with care and answer."
    return rng, intro, [(f"it{i}", "s", f"{intro} {prose(rng, 60)}", "en") for i in range(items)]


def found(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string, share double")
    i = spark.createDataFrame(items, "item_id string, suite string, prompt string, text string")
    return {(r.doc_id, r.item_id) for r in find_leaks(d, i, **kw).collect()}


def test_whole_parts_pieces_and_disguises(spark):
    rng, intro, items = setup()
    own = [p[len(intro) + 1 :].split() for _, _, p, _ in items]
    text = {
        1: prose(rng, 80) + " " + " ".join(own[0]) + " " + prose(rng, 50), 2: " ".join(own[1][:30]).upper() + "! " + prose(rng, 40),
        3: " ".join(own[2][:14]) + ". " + prose(rng, 20) + " " + " ".join(own[2][30:44]), 4: "* " + "\n* ".join(" ".join(own[3][i : i + 6]) for i in range(0, 60, 6)),
        5: '{"q": "' + "\\n".join(own[4]) + '"}', 6: " ".join(w if i % 9 else "other" for i, w in enumerate(own[5])), 7: "&nbsp;".join(own[6]), 8: " ".join(own[7]).translate(str.maketrans("aeo", "аео")),
        9: " ".join("".join(chr(ord(c) + 0xFEE0) for c in w) for w in own[8]), 10: " ".join(w[:2] + "​" + w[2:] for w in own[9]), 11: prose(rng, 5000) + " " + " ".join(own[10]),
        20: intro + " " + prose(rng, 80), 21: " ".join(own[11][:6]) + " " + prose(rng, 60), 22: prose(rng, 120), 23: None, 24: "", 25: "  \n", 26: " ".join(sorted(own[11])),
    }
    docs = [(k, t, "x", 0.5) for k, t in text.items()] + [(30, text[1], "x", 0.1), (None, text[2], "x", 0.1)]
    want = {(k, f"it{k - 1}") for k in range(1, 12)} | {(30, "it0"), (None, "it1")}
    assert found(spark, docs, items) == want
    assert found(spark, docs, items, block_chars=500) == want


def unique_words(n, start=0):
    """Words that no other text holds."""
    return [f"q{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x" for i in range(start, start + n)]


@pytest.mark.parametrize("pieces", [1, 2])
def test_any_third_half_and_whole_of_items_of_every_length(spark, pieces):
    """In one piece, and (from thirty words, so that a piece isn't just a few words) in two that stand apart."""
    rng = random.Random(5)
    items, docs, want = [], [], set()
    for n in range(1, 41):
        own = unique_words(n, 40 * n)
        items.append((f"n{n}", "s", "Read and answer. " + " ".join(own), "en"))
        for j, share in enumerate((3, 2, 1)):
            m = n if n < 5 else -(-n // share)
            if pieces == 2 and n < 30:
                continue
            begin = rng.randrange(n - m + 1)
            got = own[begin : begin + m]
            text = f" {prose(rng, 25)} ".join(" ".join(got[a:b]) for a, b in ([(0, m)] if pieces == 1 else [(0, m // 2), (m // 2, m)]))
            docs.append((n * 10 + j, f"{prose(rng, 30)} {text} {prose(rng, 30)}", "x", 0.1))
            want.add((n * 10 + j, f"n{n}"))
    assert found(spark, docs, items) == want


def test_single_altered_words_in_short_items(spark):
    items = [("a", "s", "Answer: " + " ".join(unique_words(24)), "en"), ("b", "s", "Answer: " + " ".join(unique_words(24, 100)), "en")]
    text = unique_words(24)
    text[4] = text[10] = text[16] = "other"
    assert found(spark, [(1, " ".join(text), "x", 0.1)], items) == {(1, "a")}


def test_matches_tell_where(spark):
    own = unique_words(30)
    items = spark.createDataFrame([("a", "s", "Answer: " + " ".join(own)), ("b", "s", "Answer: " + " ".join(unique_words(30, 90)))], "item_id string, suite string, prompt string")
    docs = spark.createDataFrame([(7, "one two " + " ".join(own[:14]) + " three " + " ".join(own[14:]) + " four")], "doc_id long, text string")
    r = find_leaks(docs, items).first()
    assert r.share == 1.0 and [tuple(p) for p in r.passages] == [(0, 30, 2)]
    assert [tuple(p) for p in r.phrases] == [(0, 14, 2), (14, 16, 17)]


def test_thousands_of_items_in_one_pass():
    rng = random.Random(9)
    texts = [prose(rng, 200) for _ in range(300)]
    seqs = [(f"i{i}", [term(w) for w in prose(rng, 60).split()]) for i in range(6000)]
    for i in (3, 77, 5999):
        texts[i % 300] += " " + " ".join(unique_words(60, 60 * (i % 100)))
        seqs[i] = (f"i{i}", [term(w) for w in unique_words(60, 60 * (i % 100))])
    hits = {(d, i) for d, i, *_ in search_segment(Segment.build(texts), Queries(seqs, 5), 5, 0.08, 0.32)}
    assert hits == {(i % 300, i) for i in (3, 77, 5999)}


def test_index_holds_every_token_of_every_text(spark):
    texts = ["a b a", "", "c", "b " * 50]
    rows = build_index(spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id long, text string").coalesce(1), block_chars=4).collect()
    assert sorted(i for r in rows for i in r.ids) == [0, 1, 2, 3]
    assert sum(len(r.gaps) for r in rows) == sum(len(t.split()) for t in texts)


def test_nulls_repeats_and_empty_tables(spark):
    rng, intro, items = setup(2, 4)
    docs = [(1, items[0][2], "x", 0.1)]
    odd = [("it0", "s", None, None), (None, "s", items[1][2], None), ("it0", "s", items[0][2], None), ("t", None, "never heard words", None), ("empty", "s", "", None), ("signs", "s", "?!", None), ("one", "alone", items[0][2], None)]
    assert found(spark, docs, items + odd) == {(1, "it0"), (1, "one")}
    assert found(spark, [], items) == set() and found(spark, docs, []) == set()


def test_items_in_several_blocks(spark, monkeypatch):
    import ledgerloom.llm.leaks as L

    rng, intro, items = setup(3, 6)
    monkeypatch.setattr(L, "ITEM_TOKENS", 100)
    docs = [(i, p, "x", 0.1) for i, (_, _, p, _) in enumerate(items)]
    assert found(spark, docs, items) == {(i, f"it{i}") for i in range(6)}


def test_words_and_carried():
    assert words("Café &amp; NÖN—ＡＢ caf\\u00e9\\nx %41b") == ["cafe", "non", "ab", "cafe", "x", "ab"]
    assert words(None) == words("") == [] and words("cafe\u0301s ½") == ["cafes", "1", "2"]
    seq = np.arange(40)
    order = np.argsort(run_codes(seq, 3, 60), kind="stable")
    measure = lambda doc, **kw: carried(run_codes(doc, 3, 60), run_codes(seq, 3, 60)[order], order, 40, **kw)
    assert measure(seq)[0] == 1.0 and measure(seq[::-1])[0] == 0.0 and measure(np.full(50, 50))[0] == 0.0 and measure(seq[:2])[0] == 0.0
    assert measure(seq[:14], least=0.5) == (0.0, []) and measure(seq[:14]) == (0.35, [(0, 14, 0)])


def test_introductions(spark):
    rows = [("a", "s", "same start one two"), ("b", "s", "same start six"), ("c", "t", "alone here"), ("d", None, "x y"), ("e", None, "x z"), ("f", "s", None), ("g", "s", "")]
    own = {r.item_id: list(r.own) for r in own_words(spark.createDataFrame(rows, "item_id string, suite string, prompt string")).collect()}
    assert own == {k: [term(w) for w in v.split()] for k, v in {"a": "one two", "b": "six", "c": "alone here", "d": "y", "e": "z"}.items()}


def test_a_long_text_that_repeats_an_item():
    seq = [term(w) for w in unique_words(8)]
    hits = list(search_segment(Segment.build([" ".join(unique_words(8)) + " "] + [(" ".join(unique_words(8)) + " ") * 20_000]), Queries([("a", seq)], 5), 5, 0.08, 0.32))
    assert [(d, i, share) for d, i, share, _, _ in hits] == [(0, 0, 1.0), (1, 0, 1.0)]
