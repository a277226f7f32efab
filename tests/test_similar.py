"""Matches through one similar value, against all pairs."""

import random

import pytest

from kinweave.functions import skew
from kinweave.operators import components, resolution, similar
from kinweave.plans.resolve import resolve
from kinweave.sources import shared
from tests.test_resolution import SCHEMA, groups_of


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _matches(a, b):
    """Whether equal fields, and at most one similar one, reach the threshold."""
    both = [f for f in resolution.FIELDS if a[f] is not None and b[f] is not None]
    equal = sum(resolution.MATCH_WEIGHTS[f] for f in both if a[f] == b[f])
    near = [w for f, w in similar.SIMILAR_WEIGHTS.items() if f in both and min(len(a[f]), len(b[f])) >= similar.MIN_LENGTH and _distance(a[f], b[f]) == 1]
    return equal + max(near, default=0) >= resolution.MATCH_THRESHOLD


def _typed(draw, word):
    """The word with up to two errors."""
    for _ in range(draw.choice([0, 0, 1, 1, 2])):
        at, letter = draw.randrange(len(word)), draw.choice("abé")
        word = draw.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]])
    return word


def _records(n, seed):
    draw = random.Random(seed)
    words = ["aabb", "marianne", "mariane", "johannsen", "ab", "bbaabb", "lindenweg 12", "anna@mail.example", "ana@mail.example"]

    def pick(field):
        if draw.random() < 0.35:
            return None
        if field in ("phone", "birthdate"):
            return f"{field}{draw.randrange(4)}"
        return _typed(draw, draw.choice(words))

    return [{"record_id": f"r{i:04d}", "datasource": "s", **{f: pick(f) for f in resolution.FIELDS}} for i in range(n)]


def _found(df):
    exact = resolution.pairs(df).select("id_a", "id_b")
    near = similar.similar_pairs(df).select("id_a", "id_b")
    links = components.connected_components(exact.unionByName(near))
    return {r.record_id: r.entity_id for r in resolution.unified(df, links).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_entities_equal_all_pairs(spark, seed):
    records = _records(200, seed)
    edges = [(a["record_id"], b["record_id"]) for i, a in enumerate(records) for b in records[:i] if _matches(a, b)]
    df = spark.createDataFrame([tuple(r.values()) for r in records], SCHEMA)
    assert _found(df) == groups_of(edges, [r["record_id"] for r in records])
    by = {r["record_id"]: r for r in records}
    for pair in similar.similar_pairs(df).collect():
        assert _matches(by[pair.id_a], by[pair.id_b])


def test_rules():
    assert [r.name for r in similar.similar_rules()] == [
        "~email+address", "~email+birthdate", "~email+given_name+surname", "~address+birthdate+given_name", "~address+birthdate+surname",
        "~given_name+address+surname", "~given_name+birthdate+surname", "~surname+address+given_name", "~surname+birthdate+given_name",
    ]
    with pytest.raises(ValueError, match="worth"):
        similar.similar_rules(similar={"email": 9.0})


def test_hot_values_are_stars(spark, tmp_path):
    """Thousands of records under two similar values: a line a record, not one for every pair."""
    spark.range(3000).selectExpr(
        "concat('r', lpad(id, 5, '0')) AS record_id", "'s' AS datasource", "'anna' AS given_name", "'smith' AS surname",
        "IF(id % 2 = 0, 'anna.smith@x.org', 'ana.smith@x.org') AS email", "CAST(NULL AS string) AS phone", "CAST(NULL AS string) AS address",
        "CAST(NULL AS string) AS birthdate",
    ).write.parquet(str(tmp_path / "records"))
    df = spark.read.parquet(str(tmp_path / "records"))
    near = similar.similar_pairs(df)
    assert near.count() == 1500 and near.select("id_b").distinct().count() == 1
    assert {r.rules for r in near.select("rules").distinct().collect()} == {"~email+given_name+surname"}
    scored = similar.similar_scores(near).first()
    assert scored.score == 2.0 and 0.9 < scored.confidence < 1
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_odd_records(spark):
    """No records, no values, no ids, repeated ids, no similar fields."""
    df = spark.createDataFrame(
        [("a", "s", "anna", "smith", "anna@x.org", None, None, None), ("a", "s", "anna", "smith", "ana@x.org", None, None, None),
         (None, "s", "anna", "smith", "anne@x.org", None, None, None), ("b", "s", None, None, None, None, None, None)], SCHEMA,
    )
    assert similar.similar_pairs(df).collect() == []
    assert similar.similar_pairs(df.limit(0)).collect() == []
    assert similar.similar_pairs(df, similar={}).collect() == []


def test_resolve_links_one_wrong_letter(spark):
    rows = [(1, "Anna", "Smith", "anna.smith@x.org"), (2, "Anna", "Smith", "anna.smth@x.org"), (3, "Anna", "Smith", "other@y.org")]
    tables = {"crm": spark.createDataFrame(rows, "id int, g string, s string, m string")}
    semantics = {"crm": {"g": "given-name", "s": "surname", "m": "email"}}
    for alike, expected in ((similar.SIMILAR_WEIGHTS, 2), ({}, 3)):
        found, edges, shared = resolve(tables, semantics, {"crm": "id"}, alike=alike)
        assert found.select("entity_id").distinct().count() == expected
        assert edges.count() == 3 - expected
        for t in shared:
            t.drop()


def test_lines_of_keys_carry_no_fields(spark, monkeypatch):
    """Whatever a record's fields hold, the tables of keys and of their smallest records hold numbers and hashes."""
    written = []

    def kept(df, name):
        written.append((name, df.schema))
        return shared.materialise(df, name)

    for module in (skew, similar, resolution):
        monkeypatch.setattr(module, "materialise", kept)
    records = _records(200, 1)
    near = similar.similar_pairs(spark.createDataFrame([tuple(r.values()) for r in records], SCHEMA))
    exact = resolution.pairs(spark.createDataFrame([tuple(r.values()) for r in records], SCHEMA))
    assert near.count() > 0 and exact.count() > 0
    assert len(written) >= 6
    for _, schema in written:
        assert not any(f.name in ("a", "b") or f.dataType.typeName() == "struct" for f in schema)
    hubs = [schema for name, schema in written if name == "right" and "n_b" in schema.names]
    assert len(hubs) == 2 and all({f.dataType.typeName() for f in schema} == {"long"} for schema in hubs)


def test_live_places(spark):
    """Places of shared keys: of a letter put in, of one replaced, and of a run of equal letters only the first."""
    df = spark.createDataFrame([("anna",), ("annna",), ("anne",), ("zzzzzz",), ("ann",), (None,)], "given_name string")
    found = {r.value: sorted(r.places) for r in similar.live_places(df, ["given_name"]).collect()}
    assert found == {"anna": [0, 4], "annna": [-2], "anne": [4]}
