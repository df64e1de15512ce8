"""Work that must not grow with repeats of what was said or of days."""

import datetime as dt

from shelfsight.operators import matching
from shelfsight.plans import funnel


def test_each_text_is_looked_up_once(spark, monkeypatch):
    looked, save = [], matching.saved

    def kept(df):
        looked.append(save(df))
        return looked[-1]

    monkeypatch.setattr(matching, "saved", kept)
    said = [("Acme", "x", None), (None, "Acme phone", "m"), ("", "the Acme", ""), (None, None, None)]
    rows = spark.createDataFrame([(i, *said[i % 4]) for i in range(40)], "offer_id long, brand_raw string, title string, model string")
    got = matching.brand_lookup(rows, spark.createDataFrame([("acme", "Acme")], "alias string, brand string")).collect()
    assert looked[0].count() == 4 and len(got) == 40
    want = [("Acme", "resolved"), ("Acme", "resolved_title"), ("Acme", "resolved_title"), (None, "none_given")]
    assert {(r.offer_id, r.brand, r.brand_state) for r in got} == {(i, *want[i % 4]) for i in range(40)}


def test_days_are_counted_once_for_all_writes(spark, monkeypatch):
    asked, days = [], funnel._days
    monkeypatch.setattr(funnel, "_days", lambda *a: asked.append(a) or days(*a))
    got = funnel.funnel_history(spark, "/root/testdata/sf0.001").select("day").distinct().count()
    assert len(asked) == 1 and got == (funnel.LAST - funnel.FIRST).days + 1 and isinstance(funnel.MIDDLE, dt.date)
