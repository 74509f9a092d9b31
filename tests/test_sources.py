"""File sources and sinks."""

import json

import pytest

from ledgerloom.sources.files import balance_changes, export, read_addresses, transfers

A, B = "5q1n19yoVRHq2iDaV4GoSrM2hCGP9k1t6WDZXfVLXTRb", "E7TpAEUHCLuj2dVmLyU3CQhtqUEAP156p3Mj8pgTwPi"


def test_address_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text(f"{A} # desk\n\nnot an address\n{A}\n  {B}  \n")
    (tmp_path / "a.csv").write_text(f"address,label\n{A},two\n{A},one\n0OIl,x\n{B},\n")
    (tmp_path / "a.jsonl").write_text(json.dumps({"address": A}) + "\n" + json.dumps({"address": None}) + "\n")
    read = lambda n: sorted(map(tuple, read_addresses(spark, str(tmp_path / n)).collect()), key=str)
    assert read("a.txt") == sorted([(A, None), (B, None)], key=str)
    assert read("a.csv") == sorted([(A, "one"), (B, None)], key=str)
    assert read("a.jsonl") == [(A, None)]
    with pytest.raises(ValueError):
        read_addresses(spark, "a.xml")


def test_nested_transactions(spark):
    def record(sig, err, pre, post):
        return (json.dumps({"signature": sig, "blockTime": 1_700_000_000, "transaction": {"message": {"accountKeys": ["x", "y", "z"]}}, "meta": {"err": err, "preBalances": pre, "postBalances": post}}),)

    rows = [record("s", None, [10, 0, 5], [3, 6, 5]), record("f", "failed", [9, 9, 9], [0, 0, 0]), ("{broken",), (None,)]
    changes = balance_changes(spark.createDataFrame(rows, "json string"))
    assert sorted((r.signature, r.account, r.change) for r in changes.collect()) == [("s", "x", -7), ("s", "y", 6)]
    assert [(r.src, r.dst, r.amount) for r in transfers(changes).collect()] == [("x", "y", 6)]


@pytest.mark.parametrize("kind", ["parquet", "csv", "json"])
def test_export_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a", [1, 2]), (2, None, None)], "id long, name string, xs array<int>")
    export(df, str(tmp_path / kind), kind)
    back = getattr(spark.read.option("header", True).option("inferSchema", True) if kind == "csv" else spark.read, kind)(str(tmp_path / kind))
    assert sorted((r.id, r.name) for r in back.collect()) == [(1, "a"), (2, None)]
