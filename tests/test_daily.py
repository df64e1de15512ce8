"""Numbers of days against brute force, and days that are kept once."""

import datetime as dt

from pyspark.sql import functions as F

from shelfsight.operators.daily import history, keep_days, kept_days, standing

DAY = dt.datetime(2024, 3, 1)
SCHEMA = "scope string, n long, day date"


def _rows():
    return [(k if k else None, DAY + dt.timedelta(hours=7 * i + k), i, None if i % 7 == 3 else (i * (k + 2)) % 3 > 0, "xyz"[k % 3]) for k in range(6) for i in range(1, 40, k + 1)]


def test_standing_equals_brute_force(spark):
    rows, first, last = _rows(), dt.date(2024, 3, 4), dt.date(2024, 3, 11)
    table = spark.createDataFrame([*rows, (9, None, 1, True, "x"), (8, DAY, 1, True, None)], "k long, at timestamp, id long, on boolean, kind string")
    got = standing(table, ["k"], "at", ["id"], F.array(F.lit("all"), "kind"), {"seen": F.lit(True), "on": F.col("on")}, first, last)
    rows.append((8, DAY, 1, True, None))
    want = {}
    for n in range((last - first).days + 1):
        day = first + dt.timedelta(days=n)
        newest = {}
        for k, at, i, on, kind in sorted(rows, key=lambda r: (r[1], r[2])):
            if at.date() <= day:
                newest[k] = (on, kind)
        for scope in ("all", "x", "y", "z"):
            held = [on for on, kind in newest.values() if scope in ("all", kind)]
            want[day, scope] = (len(held), sum(bool(on) for on in held))
    assert {(r.day, r.scope): (r.seen, r.on) for r in got.collect()} == want
    assert standing(table.limit(0), ["k"], "at", ["id"], F.array("kind"), {"on": F.col("on")}, first, last).collect() == []


def test_a_day_is_kept_once(spark, tmp_path):
    folder = f"file://{tmp_path}/days"
    day = lambda n: dt.date(2024, 5, n)
    counts = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    read = lambda days=9, scope="all": sorted((r.day.day, r.n) for r in history(spark, folder, SCHEMA, days, day(9), scope).collect())
    assert read() == [] and kept_days(spark, folder) == []
    keep_days(counts(("all", 1, day(7)), ("x", 1, day(7)), ("all", 2, day(8)), ("all", 5, None)), folder)
    keep_days(counts(("all", 99, day(7)), ("all", 3, day(9))), folder)
    assert read() == [(7, 1), (8, 2), (9, 3)] and read(scope="x") == [(7, 1)] and read(days=2) == [(8, 2), (9, 3)]
    keep_days(counts(("all", 4, day(7))), folder, replace=True)
    assert read() == [(7, 4), (8, 2), (9, 3)] and read(scope="x") == [] and kept_days(spark, folder) == [day(7), day(8), day(9)]
    keep_days(counts(), folder)
    assert "PartitionFilters: [isnotnull(day" in history(spark, folder, SCHEMA, 2, day(9))._jdf.queryExecution().toString() and len(read()) == 3
