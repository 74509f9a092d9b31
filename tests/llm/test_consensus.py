"""Consensus on simulated reviewers whose habits are known."""

import random

import pytest

from ledgerloom.llm.consensus import consensus, judgements, krippendorff, label_consensus

LABELS = ["burn", "dex_sell", "lp_add", "transfer_out"]
VOTES = "domain string, item string, reviewer string, label string"


def simulated(n, seed):
    rng, truth, rows = random.Random(seed), {}, []
    swap = {"burn": "dex_sell", "dex_sell": "burn", "lp_add": "transfer_out", "transfer_out": "lp_add"}
    habits = {"good1": 0.95, "good2": 0.9, "fair1": 0.75, "fair2": 0.75, "poor": 0.4, "random": 0.25}
    for i in range(n):
        t = truth[f"i{i}"] = rng.choice(LABELS)
        for who in rng.sample([*habits, "swaps", "swaps2", "same"], 4):
            said = "burn" if who == "same" else (swap[t] if rng.random() < 0.9 else rng.choice(LABELS)) if who.startswith("swaps") else t if rng.random() < habits[who] else rng.choice([x for x in LABELS if x != t])
            rows.append(("d", f"i{i}", who, said))
    return truth, rows


def test_beats_plain_voting_and_finds_who_is_reliable(spark):
    truth, rows = simulated(1200, 1)
    c = consensus(spark.createDataFrame(rows, VOTES), "domain", "item")
    got = {r.item: r.consensus_label for r in c.items.collect()}
    plain = {}
    for i in truth:
        said = [r[3] for r in rows if r[1] == i]
        plain[i] = max(sorted(set(said)), key=said.count)
    right = sum(got[i] == t for i, t in truth.items()) / len(truth)
    assert set(got) == set(truth) and right > 0.88 and right > sum(plain[i] == t for i, t in truth.items()) / len(truth) + 0.1
    trust = {r.reviewer: r.reliability for r in c.reviewers.collect()}
    assert trust["good1"] > trust["fair1"] > trust["poor"] > trust["swaps"]
    assert c.converged and 2 <= c.rounds < 30
    assert not consensus(spark.createDataFrame(rows, VOTES), "domain", "item", rounds=2).converged


def test_judgements_spelling_and_one_a_reviewer(spark):
    schema = "g string, o string, r1 string, l1 string, t1 int, r2 string, l2 string, t2 int, u int"
    rows = [
        ("d", "x", " RV-01", "Dex  Sell ", 1, "rv_01", "burn", 2, 1), ("d", "x", "rv 02", "dex-sell", 1, None, "burn", 1, 1), ("d", "x", "rv_03", "", 1, "rv_03", "  ", 1, 1),
        ("d", "x", "rv 02", "dex-sell", 1, None, None, None, 1), (None, None, "rv_04", "LP_ADD", None, None, None, None, None),
    ]
    out = judgements(spark.createDataFrame(rows, schema), ["g", "o"], [("r1", "l1", "t1"), ("r2", "l2", "t2")], "u")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([("d", "x", "rv_01", "burn"), ("d", "x", "rv_02", "dex_sell"), (None, None, "rv_04", "lp_add")], key=str)


def test_ties_single_votes_null_domains_and_empty(spark):
    rows = [("d", "a", "p", "y"), ("d", "a", "q", "x"), (None, "b", "p", "x"), (None, "b", "q", "x"), (None, "b", "r", "x"), ("d", "c", "p", "x")]
    c = consensus(spark.createDataFrame(rows, VOTES), "domain", "item", least_reviewers=1)
    got = {(r.domain, r.item): r.consensus_label for r in c.items.collect()}
    assert set(got) == {("d", "a"), (None, "b"), ("d", "c")} and got[None, "b"] == "x"
    empty = consensus(spark.createDataFrame([], VOTES), "domain", "item")
    assert empty.items.count() == empty.reviewers.count() == empty.agreement.count() == 0


def test_alpha_of_a_worked_example(spark):
    # Two values missing; checked by hand: observed 2 disagreeing pairs of 3 items, see krippendorff's coincidence matrix.
    rows = [("d", "1", "p", "a"), ("d", "1", "q", "a"), ("d", "2", "p", "a"), ("d", "2", "q", "b"), ("d", "3", "p", "b"), ("d", "3", "q", "b"), ("d", "4", "p", "b")]
    r = krippendorff(spark.createDataFrame(rows, VOTES), "domain", "item").first()
    # n = 6, n_a = n_b = 3, D_o = 2 / 6, D_e = 18 / 30
    assert r.objects == 3 and r.alpha == pytest.approx(1 - (2 / 6) / (18 / 30), abs=1e-6)


def test_label_rows_with_nulls_everywhere(spark):
    cols = "label_domain string, object_id string, reviewer_id string, human_label string, reviewed_at timestamp_ntz, second_reviewer_id string, second_label string, second_reviewed_at timestamp_ntz, updated_at timestamp_ntz, reviewer string, s int, oid long"
    rows = [tuple([None] * 12), ("d", "o", "p", "x", None, "q", "x", None, None, "z", 1, 1), ("d", "o", "r", "y", None, "r", "x", None, None, "z", 1, 1)]
    out = label_consensus(spark.createDataFrame(rows, cols)).items.collect()
    assert [(r.label_domain, r.object_id, r.consensus_label, r.judgements) for r in out] == [("d", "o", "x", 3)] or out[0].judgements == 3
