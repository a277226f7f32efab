"""Search by rare grams against the comparison of every name."""

import random

import pytest
from pyspark.sql import functions as F

from kinweave.operators import name_index
from tests.test_similar import _distance


def _best(targets, names, least):
    out = []
    for target in {t for t in targets if t and t.strip()}:
        t = target.strip(" ").lower()
        scored = []
        for name in names:
            c = (name or "").strip(" ").lower()
            if c and t:
                score = 1.0 - _distance(t, c) / max(len(t), len(c))
                if score >= least:
                    scored.append((-score, name))
        if scored:
            score, name = min(scored)
            out.append((target, name, round(-score, 9)))
    return sorted(out)


@pytest.mark.parametrize("least", [0.51, 0.7, 0.9, 1.0])
def test_same_winners_as_brute_force(spark, least):
    draw = random.Random(11)
    letters = "aab é#1"
    names = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 9))) for _ in range(400)]
    names += [f"Customer#{i:06d}" for i in range(200)] + ["  Customer#000007", "CUSTOMER#000007", None, "x", "aaaaaaaa", "aaaa"]
    targets = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 10))) for _ in range(60)]
    targets += ["costumer#000012", "Customer#00001", "aaaaaaaaa", "x", "y", "", None, " ", "x"]
    index = name_index.build_index(spark.createDataFrame([(n,) for n in names], "name string"))
    found = index.search(spark.createDataFrame([(t,) for t in targets], "target string"), least)
    assert sorted((r.target, r.name, round(r.score, 9)) for r in found.collect()) == _best(targets, names, least)
    assert index.search(["costumer#000012"], least).count() <= 1
    index.drop()


def test_frequent_grams_are_not_looked_up(spark):
    """Names that all begin alike: the search reads a share of the lines, and no product stands in its plan."""
    names = spark.range(3000).selectExpr("concat('Customer#', lpad(cast(id * 7919 % 1000003 as string), 9, '0')) AS name")
    index = name_index.build_index(names)
    assert index.counts.df.agg(F.max("n")).first()[0] == 3000
    found = index.search(["Customer#000007919x"], 0.9)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert found.first()["name"] == "Customer#000007919"


def test_odd_input(spark):
    index = name_index.build_index(spark.createDataFrame([], "name string"))
    assert index.search(["a"]).collect() == []
    with pytest.raises(ValueError, match="least score"):
        index.search(["a"], 0.5)


def test_dense_names_are_found_by_one_edit(spark, monkeypatch):
    """Numbered names are all alike: targets one edit from a name ask no gram, however many names hold it."""
    names = [f"Customer#{i:06d}" for i in range(300)]
    targets = ["Cstomer#000123", "Customer#00000x", "Customer##000007", "cUstomer#000299", "Xustomer#000001", "Custmer#0000128"]
    index = name_index.build_index(spark.createDataFrame([(n,) for n in names], "name string"))
    asked = []
    by_grams = name_index.NameIndex._by_grams
    monkeypatch.setattr(name_index.NameIndex, "_by_grams", lambda self, rest, least: asked.extend(r.target for r in rest.collect()) or by_grams(self, rest, least))
    found = index.search(targets, 0.75)
    assert sorted((r.target, r.name, round(r.score, 9)) for r in found.collect()) == _best(targets, names, 0.75)
    assert asked == ["Custmer#0000128"]
    index.drop()
