"""Audits of a stored table: verdicts by day against cases made by hand, and repairs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import integrity as I
from tessera.sources import lake

D = lambda d: dt.date(2024, 1, d)
MS = lambda d, h, m=0: int(dt.datetime(2024, 1, d, h, m, tzinfo=dt.timezone.utc).timestamp() * 1000)
SCHEMA = "symbol string, trade_date date, close double, volume double, quote_ts long"


@pytest.fixture(scope="module")
def table(spark):
    rows = [
        # 2: batch only; 3: quoted during the day; 4: after the close; 5: stamped on another day
        ("A", D(2), 10.0, 5.0, None), ("B", D(2), 20.0, 5.0, None),
        ("A", D(3), 10.0, 5.0, MS(3, 10)), ("B", D(3), 20.0, 5.0, None),
        ("A", D(4), 10.0, 5.0, MS(4, 15)), ("B", D(4), 20.02, 5.0, MS(4, 23, 59)),
        ("A", D(5), 10.0, 5.0, MS(6, 16)),
        # 8: a left-over of a suspended symbol beside the batch; 9: nothing but such
        ("A", D(8), 10.0, 0.0, MS(8, 9)), ("B", D(8), 20.0, 5.0, None), ("C", D(8), 3.0, 5.0, None), ("C", D(8), 3.0, 5.0, None),
        ("A", D(9), 10.0, 0.0, MS(9, 9)),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def authority(spark):
    rows = [("A", D(2), 10.004, 5.0), ("B", D(2), 20.0, 5.0), ("S", D(2), 7.0, 0.0), ("A", D(3), 10.0, 5.0), ("B", D(3), 20.0, 5.0), ("C", D(3), 3.0, 5.0), ("D", D(3), 4.0, None), ("A", D(4), 10.0, 5.0), ("B", D(4), 20.0, 5.0), ("Z", D(5), 1.0, 1.0), ("B", D(8), 20.0, 5.0), ("C", D(8), 3.0, 5.0)]
    return spark.createDataFrame(rows, "symbol string, trade_date date, close double, volume double")


def by_day(df):
    return {r["trade_date"].day: r for r in df.collect()}


def test_snapshots(table):
    got = by_day(I.snapshots(table))
    assert {d: r["state"] for d, r in got.items()} == {2: "authoritative", 3: "snapshot", 4: "authoritative", 5: "snapshot", 8: "authoritative", 9: "snapshot"}
    assert (got[8]["rows"], got[8]["suspicious_rows"], got[8]["batch_rows"]) == (4, 1, 3)
    assert {r["state"] for r in I.snapshots(table.drop("quote_ts")).collect()} == {"unknown"}
    assert {d: r["state"] for d, r in by_day(I.snapshots(table, tz="Asia/Shanghai")).items()}[3] == "authoritative"


def test_values_and_coverage(table, authority):
    got = by_day(I.audit(table, authority))
    assert {d: r["value_status"] for d, r in got.items()} == {2: "ok", 3: "ok", 4: "mismatch", 5: "no_overlap", 8: "ok", 9: "no_authority"}
    assert got[4]["mismatches"] == 1 and got[4]["max_diff"] == pytest.approx(0.02) and got[4]["checked"] == 2
    assert {d: r["coverage_status"] for d, r in got.items()} == {2: "ok", 3: "gap", 4: "ok", 5: "gap", 8: "ok", 9: "no_authority"}
    assert (got[3]["missing"], got[3]["n_missing"], got[3]["expected"], got[3]["actual"]) == (["C", "D"], 2, 4, 2)
    assert (got[2]["rows"], got[2]["authority_rows"], got[2]["expected"]) == (2, 3, 2)
    assert (got[5]["n_extra"], got[8]["rows"]) == (1, 4)
    plain = by_day(I.audit(table, authority.drop("volume", "close")))
    assert plain[2]["value_status"] == "no_value_column" and plain[3]["coverage_status"] == "no_halt_filter"
    assert {(r["value_status"], r["coverage_status"]) for r in I.audit(table, None).collect()} == {("no_authority", "no_authority")}


def test_report_and_plan(spark, table, authority):
    calendar = spark.createDataFrame([(D(d),) for d in (2, 3, 4, 10)], "trade_date date")
    got = by_day(I.report(table, authority, calendar))
    assert {d: r["reasons"] for d, r in got.items() if r["repair"]} == {3: ["snapshot", "coverage_gap"], 4: ["value_mismatch"], 5: ["snapshot", "coverage_gap"], 9: ["snapshot"], 10: ["missing_day"]}
    assert got[10]["state"] == "missing" and got[10]["rows"] == 0
    assert I.plan(I.report(table.drop("quote_ts"))).count() == 0  # unknown is no reason
    assert I.report(table.limit(0), authority).count() == 0


def test_repair(spark, table, authority, tmp_path):
    root = f"{tmp_path}/daily"
    lake.write_daily(table.dropDuplicates(["symbol", "trade_date"]).unionByName(spark.createDataFrame([("A", dt.date(2023, 5, 5), 1.0, 1.0, MS(5, 9))], SCHEMA)), root)
    stored = lake.read_daily(spark, root).drop("year")
    planned = I.plan(I.report(stored, authority))
    assert {r["trade_date"] for r in planned.collect()} == {D(3), D(4), D(5), D(9), dt.date(2023, 5, 5)}
    lying = I.files(spark, root, planned).collect()
    assert sum(r["rows"] for r in lying) == 7 and all("year=" in r["path"] for r in lying)
    fresh = authority.where(F.col("trade_date") != D(5))
    before = sorted(map(str, lake.read_daily(spark, root).collect()))
    assert sum(r["deleted"] for r in I.repair(spark, root, planned, fresh).collect()) == 7
    assert sorted(map(str, lake.read_daily(spark, root).collect())) == before
    done = {r["trade_date"]: (r["deleted"], r["written"]) for r in I.repair(spark, root, planned, fresh, dry_run=False).collect()}
    assert done == {D(3): (2, 4), D(4): (2, 2), D(5): (1, 0), D(9): (1, 0), dt.date(2023, 5, 5): (1, 0)}
    now = lake.read_daily(spark, root).drop("year")
    assert {(r["symbol"], r["trade_date"]) for r in now.collect()} == {("A", D(2)), ("B", D(2)), ("A", D(8)), ("B", D(8)), ("C", D(8)), ("A", D(3)), ("B", D(3)), ("C", D(3)), ("D", D(3)), ("A", D(4)), ("B", D(4))}
    assert I.plan(I.report(now, fresh)).count() == 0


def test_a_large_year_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lake, "FILE_ROWS", 10)
    root = f"{tmp_path}/daily"
    df = spark.range(40).selectExpr("concat('s', id) AS symbol", "DATE'2024-01-02' AS trade_date", "id * 1.0D AS close", "0 AS quality_flags", "'x' AS source")
    lake.write_daily(df, root)
    assert lake.read_daily(spark, root).count() == 40
    assert lake.read_daily(spark, root).select("_metadata.file_path").distinct().count() > 1
