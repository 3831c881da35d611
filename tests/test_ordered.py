"""Distributed places, running sums and last values against plain Python."""

import random

from lakequill.operators.ordered import last_before, numbered


def test_places_and_running_sums(spark):
    r = random.Random(3)
    rows = [(("hot" if r.random() < 0.7 else f"g{r.randint(0, 5)}"), r.choice([None, *range(40)]), r.randint(1, 9), "x") for _ in range(600)]
    df = spark.createDataFrame(rows, "g string, o int, v long, at_ string").repartition(5)
    got = numbered(df, ["o", "v"], ["g"], {"before": "v"}, parts=7).collect()
    for g in {x[0] for x in rows}:
        own = sorted((x for x in got if x.g == g), key=lambda x: x["at"])
        assert [x["at"] for x in own] == list(range(len(own)))
        assert [(x.o, x.v) for x in own] == sorted(((x[1], x[2]) for x in rows if x[0] == g), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        assert [x.before for x in own] == [sum(y.v for y in own[:i]) for i in range(len(own))]
    assert sorted(x["at"] for x in numbered(df, ["o"], parts=3).collect()) == list(range(600))
    assert numbered(df.where("false"), ["o"], ["g"]).count() == 0


def test_equal_rows_are_told_apart(spark):
    df = spark.range(1000).selectExpr("1 a", "cast(null as string) b")
    assert sorted(x["at"] for x in numbered(df, ["b"], ["a"], parts=6).collect()) == list(range(1000))


def test_last_value_before(spark):
    r = random.Random(4)
    rows = [("f" if r.random() < 0.8 else "g", i, r.choice([None, None, None, f"h{i}"])) for i in range(400)]
    got = {(x.f, x.o): x.h for x in last_before(spark.createDataFrame(rows, "f string, o int, v string").repartition(3), ["o"], ["f"], "v", "h", parts=6).collect()}
    now = {}
    for f, o, v in rows:
        now[f] = v or now.get(f)
        assert got[f, o] == now[f]
