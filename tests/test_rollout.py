"""Each gate of a rollout's evidence, one at a time."""

from driftline.operators import rollout

RULES = rollout.Evidence(span=1000, slot=10, missing=2, gap=30, after=10, before=20, order_usd=100.0, impact=2.0, liquidity=50.0, kept=0.9, accepted=0.5, apart=100)
NOW = 2000


def gates(spark, started=0, slots=None, references=(("r", 1500, 60.0),), reviews=(("r", 1515, 100.0, 1.0),), samples=(("r", 1511, 55.0),), sent=(("t", 1, 0), ("t", 2, 500))):
    slots = list(range(1000, 2000, 10)) if slots is None else slots
    frame = lambda rows, ddl: spark.createDataFrame([tuple(r) for r in rows], ddl)
    found = rollout.evidence(
        frame([("s", started)], "scope string, started_at long"), frame([("s", t) for t in slots], "scope string, at long"), frame([("s", *r) for r in references], "scope string, id string, at long, liquidity double"),
        frame(reviews, "id string, checked_at long, order_usd double, impact double"), frame(samples, "id string, at long, liquidity double"), frame([("s", *x) for x in sent], "scope string, token string, id long, at long"), NOW, RULES,
    )
    (r,) = found.collect()
    assert r["approved"] == (not r["blockers"])
    return r["blockers"]


def test_gates(spark):
    every = list(range(1000, 2000, 10))
    assert gates(spark) == []
    assert gates(spark, started=1500) == ["days"] and gates(spark, started=None) == ["days"]
    assert gates(spark, slots=every[:-3]) == ["coverage"]
    assert gates(spark, slots=[t for t in every if t not in (1500, 1510)]) == [] and gates(spark, slots=[t for t in every if not 1500 <= t <= 1520]) == ["coverage", "gap"]
    assert gates(spark, slots=[]) == ["coverage"]
    assert gates(spark, references=[]) == ["candidates"] and gates(spark, references=[("r", 1990, 60.0)]) == ["candidates"]
    assert gates(spark, reviews=[("r", 1515, 100.0, 1.0)] * 2) == ["reviews"]
    for reviews in ([], [("r", 1509, 100.0, 1.0)], [("r", 1521, 100.0, 1.0)], [("r", 1515, 99.0, 1.0)], [("r", 1515, 100.0, 2.5)], [(None, 1515, 100.0, 1.0)]):
        assert gates(spark, reviews=reviews) == ["acceptance"]
    for samples in ([], [("r", 1521, 55.0)], [("r", 1511, 49.0), ("r", 1512, 60.0)], [("r", 1511, 53.0)]):
        assert gates(spark, samples=samples) == ["acceptance"]
    assert gates(spark, references=[("r", 1500, 60.0), ("q", 1500, 60.0)]) == []  # half is enough here
    assert gates(spark, sent=[("t", 1, 0), ("t", 2, 99)]) == ["duplicates"] and gates(spark, sent=[]) == []
