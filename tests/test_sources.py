"""Landed files and streams on small inputs."""

import datetime as dt
import json

from pyspark.sql import functions as F

from folioforge.sources import landed

D = dt.date


def values(spark, docs):
    return spark.createDataFrame([(json.dumps(x),) for x in docs], "value string")


def test_equity_dates_are_the_markets(spark):
    at = int(dt.datetime(2024, 1, 10, 23, 30, tzinfo=dt.UTC).timestamp())
    got = {tuple(r) for r in landed.equity_daily(values(spark, [{"symbol": "7203.T", "timestamps": [at, at + 86400], "closes": [10.5, None]}, {"symbol": "X", "timestamps": [at], "closes": [3.0]}])).collect()}
    assert got == {("7203.T", D(2024, 1, 11), 10.5), ("X", D(2024, 1, 10), 3.0)}


def test_fx_and_coins(spark):
    fx = landed.fx_daily(values(spark, [{"base": "USD", "rates": {"2024-01-10": {"JPY": 145.5, "EUR": 0.9}, "2024-01-11": {"EUR": 0.9}, "bad": {"JPY": 1.0}}}]))
    assert [tuple(r) for r in fx.collect()] == [("USD", D(2024, 1, 10), 145.5)]
    day = int(dt.datetime(2024, 1, 10, tzinfo=dt.UTC).timestamp()) * 1000
    coins = landed.coin_daily(values(spark, [{"coin": "btc", "prices": [[day + 5, 2.0], [day + 3, 1.0], [day + 86_400_000, 9.0], [day + 7, None]]}]))
    assert {tuple(r) for r in coins.collect()} == {("btc", D(2024, 1, 10), 2.0), ("btc", D(2024, 1, 11), 9.0)}


def test_fund_files(spark, tmp_path):
    (tmp_path / "nav.csv").write_bytes("年月日,基準価額\n2024/01/05,\"10,123\"\nx,1\n2024/01/06,-\n".encode("shift_jis"))
    got = landed.fund_nav(spark, str(tmp_path / "nav.csv")).collect()
    assert [(r.date, float(r.nav)) for r in got] == [(D(2024, 1, 5), 10123.0)]


def test_file_kinds_and_delimiters(spark, tmp_path):
    files = spark.createDataFrame([(b"%PDF-1.7",), (b"PK\x03\x04..xl/workbook.xml",), (b"PK\x03\x04..word/document.xml",), (b"\x10\x01\x00ab",), (bytes.fromhex("D0CF11E0A1B11AE1"),), (b"a,b\n1,2",), (b"",)], "content binary")
    assert [r[0] for r in files.select(landed.file_kind()).collect()] == ["pdf", "xlsx", "unknown", "unknown", "xls", "csv", "unknown"]
    for text in ("基準価額,純資産\n１２,34", "ｶﾌﾞ 株式,100", "投資信託 100"):
        for name in ("cp932", "euc-jp", "iso-2022-jp", "utf-8", "utf-8-sig", "utf-16"):
            if name == "iso-2022-jp" and "ｶ" in text:
                continue  # that encoding has no half-width kana
            assert landed.decoded(text.encode(name)) == text, (name, text)
    lines = spark.createDataFrame([("f", "a;b;c"), ("f", "1;2,0;3"), ("f", "4;5;6"), ("g", "x,y"), ("g", ""), ("g", "1,2")], "file string, value string")
    best = {r.file: (r.delimiter, r.fields) for r in landed.delimiter_scores(lines, ["file"]).groupBy("file").agg(F.max_by("delimiter", "score").alias("delimiter"), F.max_by("fields", "score").alias("fields")).collect()}
    assert best == {"f": (";", 3), "g": (",", 2)}


def test_overlapping_exports_are_ingested_once(spark, tmp_path):
    from folioforge.streaming import ingest

    schema = "day string, kind string, quantity long"
    put = lambda rows, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    put([("1", "buy", 5), ("1", "buy", 5), ("2", "sell", 1)], "a")
    source = f"{tmp_path}/in/*"
    run = lambda: ingest.ingest(spark, source, spark.createDataFrame([], schema).schema, f"{tmp_path}/table", f"{tmp_path}/state", ["day", "kind", "quantity"])
    run()
    put([("1", "buy", 5), ("1", "buy", 5), ("2", "sell", 1), ("3", "buy", None)], "b")
    run()
    got = sorted((r.day, r.kind, r.quantity) for r in spark.read.parquet(f"{tmp_path}/table").collect())
    assert got == [("1", "buy", 5), ("1", "buy", 5), ("2", "sell", 1), ("3", "buy", None)]
