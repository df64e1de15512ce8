"""Splits, rebuilds and settling against plain Python on small catalogues."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from shelfsight.operators import settling
from shelfsight.operators.matching import axes
from shelfsight.operators.settling import converge, rebuild, settle, settle_after_reread
from shelfsight.operators.splitting import candidates, split

AXES = ["size", "colour"]


def with_axes(df):
    return df.withColumn("axes", axes(size=F.col("size"), colour=F.col("colour"))).drop("size", "colour")


def entries_of(spark, rows):
    return with_axes(spark.createDataFrame([(i, "a", "c", m, s, c) for i, m, s, c in rows], "variant_id long, brand string, category string, model string, size string, colour string"))


def listings_of(spark, rows):
    """offer_id, gtin, model, size, colour"""
    full = [(i, g, "a", "a", "resolved", None, m, "t", s, c, "c", True) for i, g, m, s, c in rows]
    df = spark.createDataFrame(full, "offer_id long, gtin string, brand string, brand_raw string, brand_state string, mpn string, model string, title string, size string, colour string, category string, trusted boolean")
    return with_axes(df).withColumn("excused", F.array().cast("array<string>"))


def state_of(spark, entries, placed, gtins=(), mpns=()):
    return {
        "entries": entries_of(spark, entries), "gtins": spark.createDataFrame(list(gtins), "gtin string, variant_id long, learned boolean"), "mpns": spark.createDataFrame(list(mpns), "brand string, mpn string, variant_id long"),
        "placed": spark.createDataFrame([(o, v, "gtin") for o, v in placed], "offer_id long, variant_id long, method string"), "notes": spark.createDataFrame([], "`from` long, into long"),
    }


def kinds(spark):
    return spark.createDataFrame([("c", ["size", "colour"], False)], "category string, required array<string>, strict boolean")


def seen(entries):
    return {r.variant_id: (r.model, r.axes.get("size"), r.axes.get("colour")) for r in entries.collect()}


def test_split(spark):
    entries = [(1, "Lamp", "s", None), (2, "Lamp", "s", "blue"), (3, "Desk", None, None), (4, "Torn", "s", None), (5, "Even", "s", None), (6, "Half", "s", None)]
    listings = [
        (10, "g1", "Lamp", "s", "red"), (11, "g1", "Lamp", "s", "red"), (12, "g2", "Lamp", "s", "blue"), (13, None, "Lamp", "s", "green"), (14, "g1", "Lamp", "s", "plain"),  # the barcode's shown value takes 14 along
        (20, None, "Desk", "m", "red"), (21, None, "Desk", "m", None), (30, "g9", "Torn", "s", "red"), (31, "g9", "Torn", "s", "blue"), (40, None, "Even", "s", "plain"), (41, None, "Even", "s", "red"),  # a tie keeps what titles hide
        (50, "g7", "Half", "s", "grey"), (51, "g7", "Half", "s", "plain"), (52, None, "Half", "s", "grey"),  # one side only: nothing moves
    ]
    on = {1: range(10, 15), 3: (20, 21), 4: (30, 31), 5: (40, 41), 6: (50, 51, 52)}
    state = state_of(spark, entries, [(o, v) for v, some in on.items() for o in some], [("g1", 1, False), ("g2", 1, False), ("g9", 4, False)])
    rows = candidates(state["entries"], state["placed"], listings_of(spark, listings), AXES)
    assert {r.variant_id for r in rows.collect()} == {1, 4, 5, 6}
    hidden = spark.createDataFrame([("colour", "plain")], "axis string, value string")
    got = split(state["entries"], state["placed"], state["gtins"], rows, hidden, AXES, 1000)
    parts = {(r.variant_id, r.value): (r.kept, r.into, r.created, r.listings, r.refused) for r in got.parts.collect()}
    assert parts == {
        (1, "red"): (True, 1, False, 3, None), (1, "blue"): (False, 2, False, 1, None), (1, "green"): (False, 1013, True, 1, None), (4, None): (None, None, False, 0, "g9"),
        (5, "plain"): (True, 5, False, 1, None), (5, "red"): (False, 1041, True, 1, None), (6, "grey"): (True, 6, False, 3, None),
    }
    now = {r.offer_id: r.variant_id for r in got.placed.collect()}
    assert now == {o: v for v, some in on.items() for o in some} | {12: 2, 13: 1013, 41: 1041}
    assert sorted(map(tuple, got.gtins.collect())) == [("g1", 1, False), ("g2", 2, False), ("g9", 4, False)]
    assert seen(got.entries) == {1: ("Lamp", "s", "red"), 2: ("Lamp", "s", "blue"), 3: ("Desk", None, None), 4: ("Torn", "s", None), 5: ("Even", "s", "plain"), 6: ("Half", "s", "grey"), 1013: ("Lamp", "s", "green"), 1041: ("Even", "s", "red")}
    assert got.same.collect() == []


def rebuilt(entries, on, listings):
    """One round in plain Python: axes, then names; changed entries that equal another one go into it."""
    said = {o: (m, s, c) for o, _, m, s, c in listings}
    by = defaultdict(list)
    for o, v in on.items():
        by[v].append(said[o])
    counts = Counter()

    def fold(now, changed):
        groups = defaultdict(list)
        for v, x in now.items():
            groups[x[0].lower().replace(" ", ""), x[1], x[2]].append(v)
        for some in groups.values():
            keep = min(some, key=lambda v: (v in changed, v))
            for v in some:
                if v != keep and v in changed:
                    del now[v]
                    counts["merged"] += 1
                    for o in on:
                        on[o] = keep if on[o] == v else on[o]

    now, changed = dict(entries), set()
    for v, x in entries.items():
        x = list(x)
        for i in (1, 2):
            reads = [r[i] for r in by[v]]
            stated = {r for r in reads if r is not None}
            if len(stated) == 1 and (x[i] is not None or None not in reads) and x[i] not in stated:
                x[i] = stated.pop()
                changed.add(v)
                counts["realigned"] += 1
        now[v] = tuple(x)
    fold(now, changed)
    by = defaultdict(Counter)
    for o, v in on.items():
        if said[o][0]:
            by[v][said[o][0]] += 1
    changed = set()
    for v, reads in by.items():
        if now[v][0] not in reads:
            now[v] = (min(reads, key=lambda m: (-reads[m], len(m), m)), *now[v][1:])
            changed.add(v)
    counts["renamed"] = len(changed)
    fold(now, changed)
    return now, counts


ENTRIES = {1: ("Lamp 12", "s", "red"), 2: ("Lamp", "s", "red"), 3: ("Desk", "m", None), 4: ("Desk", "l", "blue"), 5: ("Old", None, None), 6: ("Sofa", "s", "red"), 7: ("Bed", "s", "red")}
LISTED = [
    (10, None, "Lamp", "s", "red"), (11, None, "Lamp", "s", "red"), (20, None, "Desk", "l", "blue"), (21, None, "Desk", "l", "blue"), (30, "x1", "New", "m", None), (31, None, "Newer", "m", "red"), (32, None, "New", "m", "red"), (40, None, "Sofa", "s", "red"), (41, None, "Couch", "s", None),
    (50, "b1", None, None, None), (60, "n1", "Shelf", "m", "red"), (61, "n1", "Shelf 2", None, None), (62, None, "Shelf", "m", "red"), (63, None, "Lamp", "s", "red"), (64, None, "Rug", None, None),
]
PLACED = [(10, 1), (11, 2), (20, 3), (21, 4), (30, 5), (31, 5), (32, 5), (40, 6), (41, 6), (50, 7)]


def test_rebuild_converges(spark, tmp_path):
    listings = listings_of(spark, LISTED)
    state = state_of(spark, [(i, *x) for i, x in ENTRIES.items()], PLACED, [("e1", 1, False), ("e3", 3, True), ("e4", 4, False)])
    after, reports = converge(state, lambda s: rebuild(s, listings, kinds(spark), AXES), str(tmp_path / "r"))
    now, on, want = dict(ENTRIES), dict(PLACED), []
    while not want or any(want[-1].values()):
        now, counts = rebuilt(now, on, LISTED)
        want.append({k: counts[k] for k in ("realigned", "renamed", "merged")})
    assert reports == want and len(reports) > 1
    assert seen(after["entries"]) == now and {r.offer_id: r.variant_id for r in after["placed"].collect()} == on
    assert {r["from"] for r in after["notes"].collect()} == set(ENTRIES) - set(now)
    assert {(r.gtin, r.variant_id) for r in after["gtins"].collect()} == {("e1", 2), ("e3", 4), ("e4", 4)}


def test_a_round_that_is_written_is_not_made_again(spark, tmp_path):
    state = state_of(spark, [(1, "Lamp", None, None)], [])
    calls = []

    def step(s):
        calls.append(1)
        return s, {"left": max(0, 3 - len(calls))}

    assert converge(state, step, str(tmp_path / "r"), 2)[1] == [{"left": 2}, {"left": 1}] and len(calls) == 2
    assert converge(state, step, str(tmp_path / "r"), 5)[1] == [{"left": 2}, {"left": 1}, {"left": 0}] and len(calls) == 3
    assert seen(converge(state, step, str(tmp_path / "r"), 5)[0]["entries"]) == {1: ("Lamp", None, None)} and len(calls) == 3


def test_settle(spark, tmp_path):
    listings = listings_of(spark, LISTED)
    state = state_of(spark, [(i, *x) for i, x in ENTRIES.items()], PLACED)
    after, reports = settle(state, listings, kinds(spark), AXES, str(tmp_path / "s"), 1000)
    assert reports[-1] == {"matched": 1, "promoted": 1, "matched_after": 0}  # 63 is on a lamp, 60 makes a shelf that 61 and 62 join, and 64 has nothing to go by
    on = {r.offer_id: r.variant_id for r in after["placed"].collect()}
    assert on[63] == 2 and on[60] == on[61] == on[62] == 1060 and 64 not in on


def test_settle_after_reread(spark, tmp_path):
    entries = [(1, "Lamp", "s", None), (2, "Lamp", "s", "red")]
    listings = listings_of(spark, [(10, "g", "Lamp", "s", "red"), (11, None, "Lamp", "s", "red"), (12, None, "Lamp", "s", "blue"), (13, None, "Lamp", "s", "red")])
    state = state_of(spark, entries, [(10, 1), (11, 1), (12, 1), (13, 2)], [("g", 1, False)])
    hidden = spark.createDataFrame([], "axis string, value string")
    after, reports = settle_after_reread(state, listings, kinds(spark), AXES, hidden, str(tmp_path / "s"), 1000)
    assert {"split": 1, "moved": 1} in reports
    assert seen(after["entries"]) == {2: ("Lamp", "s", "red"), 1012: ("Lamp", "s", "blue")}  # the kept value made the entry what another one is
    assert {r.offer_id: r.variant_id for r in after["placed"].collect()} == {10: 2, 11: 2, 12: 1012, 13: 2}
    assert [tuple(r) for r in after["gtins"].collect()] == [("g", 2, False)] and [tuple(r) for r in after["notes"].collect()] == [(1, 2)]


def test_a_table_that_is_saved_once(spark):
    import shutil

    from shelfsight.operators.saved import saved_once

    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        got = saved_once(spark, ("some", "key"), make)
        assert got.count() == 3 and len(calls) == 1
    shutil.rmtree(got.inputFiles()[0].removeprefix("file://").rpartition("/")[0])
    assert saved_once(spark, ("some", "key"), make).count() == 3 and len(calls) == 2


def test_listings_meet_what_they_are_placed_on_by_a_shuffle(spark, monkeypatch):
    state = {k: settling.saved(v) for k, v in state_of(spark, [(i, *x) for i, x in ENTRIES.items()], PLACED).items()}
    listings, plans, save = settling.saved(listings_of(spark, LISTED)), [], settling.saved

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(df)

    monkeypatch.setattr(settling, "saved", kept)
    rebuild(state, listings, kinds(spark), AXES)
    assert "SortMergeJoin" in plans[0] and "BroadcastExchange" not in plans[0]
