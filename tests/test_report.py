import pytest
from pyspark.sql import functions as F

from kinweave.functions.scoring import LEVELS, WEIGHTS
from kinweave.operators import report_global, report_overlap, report_source, scores
from kinweave.plans.report import identity_report

SCHEMA = (
    "entity_id string, datasource string, given_name string, surname string, email string, phone string, "
    "address string, birthdate string"
)
EDGE_ROWS = [
    ("A", "crm", "Ann", None, "a@x.org", None, None, None),
    ("A", "web", None, "Lee", None, "555", None, None),
    ("A", "web", None, None, "", None, None, None),
    ("B", "crm", None, None, None, None, None, None),
    ("C", None, "Cy", None, "c@x.org", "1", None, None),
    ("C", "crm", None, None, None, None, "Road 1", None),
    (None, "web", "No", "One", None, None, None, None),
    ("D", None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(EDGE_ROWS, SCHEMA)


@pytest.fixture(scope="module")
def view(records):
    return scores.unified_view(records)


@pytest.fixture(scope="module")
def prof(view):
    return scores.profile(view)


def weight(*values):
    return sum(w for w, v in zip(WEIGHTS.values(), values) if v is not None)


def brute_force(records_in):
    """Entity, source and the four scores, record by record."""
    kept = []
    for r in records_in:
        entity, source = r[0], r[1]
        if entity is None or source is None:
            continue
        same_entity = [x for x in records_in if x[0] == entity]
        same_source = [x for x in same_entity if x[1] == source]

        def merged(group):
            return [next((x[i] for x in group if x[i] is not None), None) for i in range(2, 8)]

        kept.append(
            (
                entity,
                source,
                weight(*r[2:]),
                weight(*merged(same_source)),
                weight(*merged(same_entity)),
                max(weight(*x[2:]) for x in same_entity),
            )
        )
    return sorted(kept, key=repr)


def test_scores_match_brute_force(view, rows):
    df = scores.scored(view)
    got = rows(df, "entity_id", "source", *scores.SCORES)
    assert got == brute_force(EDGE_ROWS)


def test_profile_scores_carry_all_records(view, prof, rows):
    graded = scores.profile_levels(prof)
    from_profile = []
    for r in graded.collect():
        from_profile += [(r.entity_id, r.source, r.row_known_unknown, r.entity_known_unknown)] * r.records
    direct = rows(scores.levels(view), "entity_id", "source", "row_known_unknown", "entity_known_unknown")
    assert sorted(from_profile, key=repr) == direct


def test_hot_entity_gives_the_same_rows(spark, rows):
    """A third of all rows in one entity, another third in one source."""
    df = spark.range(6000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('e', id) END AS entity_id",
        "CASE WHEN id % 3 = 1 THEN 'big' ELSE concat('s', id % 7) END AS datasource",
        "CASE WHEN id % 2 = 0 THEN 'g' END AS given_name",
        "CASE WHEN id % 5 = 0 THEN 's' END AS surname",
        "CASE WHEN id % 11 = 0 THEN 'e' END AS email",
        "CAST(NULL AS STRING) AS phone",
        "CASE WHEN id = 3 THEN 'a' END AS address",
        "CAST(NULL AS STRING) AS birthdate",
    )
    view = scores.unified_view(df)
    found = scores.levels(view)
    best = view.groupBy("entity_id").agg(*[F.max(c).alias(c) for c in scores.WEIGHTS])
    score = scores.completeness().alias("entity_pii_score")
    want = view.select("entity_id", "source").join(best.select("entity_id", score), "entity_id")
    assert rows(found, "entity_id", "source", "entity_pii_score") == rows(want, "entity_id", "source", "entity_pii_score")
    assert found.count() == 6000


def test_mapping_merges_sources(records, rows):
    mapped = scores.unified_view(records, {"crm": "Customers", "web": "Customers", "unused": "x"})
    assert set(rows(mapped, "source")) == {("Customers",), (None,)}
    assert mapped.count() == len(EDGE_ROWS)


def test_empty_weights_and_low_scores(view, rows):
    assert {r[0] for r in rows(scores.record_scores(view, {}), "record_pii_score")} == {0.0}
    levels = scores.record_levels(view, levels={"some": 0.5})
    assert {r[0] for r in rows(levels, "row_known_unknown")} == {"some", None}


def test_empty_table(spark):
    empty = scores.profile(scores.unified_view(spark.createDataFrame([], SCHEMA)))
    assert report_global.records_vs_entities(empty).first()[:] == (0, 0)
    assert report_global.dedupe_rate(empty).first()["de_dupe_rate"] is None
    assert report_overlap.overall_consolidation(empty).count() == 0
    assert report_overlap.venn_regions(empty).count() == 0
    assert report_global.improvement(scores.profile_levels(empty)).count() == 0


def test_counts_with_nulls(prof, rows):
    assert report_global.records_vs_entities(prof).first()[:] == (8, 4)
    by_source = {r.source: (r.source_ids, r.entity_ids) for r in report_source.by_source(prof).collect()}
    assert by_source == {"crm": (3, 3), "web": (3, 1), None: (2, 2)}
    counts = {r.number_of_sources: r.entity_ids for r in report_overlap.source_count(prof).collect()}
    assert counts == {"1 Source": 3, "2 Sources": 1, "Check": 1}


def test_improvement_keeps_levels_of_one_side(prof, rows):
    graded = scores.profile_levels(prof)
    out = {r.pii_classification: (r.before_cnt, r.after_cnt) for r in report_global.improvement(graded).collect()}
    before, after = {}, {}
    for r in graded.collect():
        before[r.row_known_unknown] = before.get(r.row_known_unknown, 0) + r.records
        after[r.entity_known_unknown] = after.get(r.entity_known_unknown, 0) + r.records
    assert out == {k: (before.get(k), after.get(k)) for k in {*before, *after}}
    text = {r.pii_classification: r.before_cnt_text for r in report_global.improvement(graded).collect()}
    assert all((text[k] is None) == (k not in before) for k in out)


def test_regions_for_any_number_of_sources(prof, rows):
    assert rows(report_overlap.all_venn_regions(prof, ["web", "crm"])) == [(1, "crm", 2), (2, "web", 1), (3, "crm, web", 1)]
    assert rows(report_overlap.all_venn_regions(prof, ["crm"])) == [(1, "crm", 3)]
    assert report_overlap.all_venn_regions(prof, []).count() == 0
    assert rows(report_overlap.venn_regions(prof), "venn_group", "cnt") == [("crm", 2), ("crm, web", 1), ("web", 1)]


def test_regions_of_a_hundred_sources(spark, rows):
    prof = spark.range(5000).selectExpr("concat('e', id % 1000) AS entity_id", "concat('s', id % 97 + 1000) AS source", "1L AS records")
    found = report_overlap.venn_regions(prof)
    assert found.agg(F.sum("cnt")).first()[0] == 1000 and found.filter("size(sources) <> 5").isEmpty()


def test_more_weights_than_one_number_holds(spark):
    weights = {f"c{i}": float(i + 1) for i in range(130)}
    df = spark.range(20).select(
        (F.col("id") % 3).cast("string").alias("entity_id"), F.lit("s").alias("source"),
        *[F.when((F.col("id") * (i + 1)) % 7 == 0, "x").alias(f"c{i}") for i in range(130)],
    )
    for r in scores.scored(df, weights).collect():
        assert r.record_pii_score == sum(w for c, w in weights.items() if r[c])
        assert r.entity_pii_score >= r.record_pii_score


def test_pairs_ignore_null_entity_and_source(prof, rows):
    assert rows(report_overlap.pairwise_overlap(prof)) == [("crm", "web", 1), ("web", "crm", 1)]
    matrix = report_overlap.overlap_matrix(prof)
    assert sorted(matrix.columns) == ["crm", "source_1", "web"]


def test_ties_go_by_name(spark, rows):
    tied = spark.createDataFrame([("A", s) + (None,) * 6 for s in "dcba"], SCHEMA)
    top = report_overlap.top_sources(scores.profile(scores.unified_view(tied)), 2)
    assert rows(top, "source") == [("a",), ("b",)]


def test_whole_report_reads_records_once(records, rows):
    reports, shared = identity_report(records)
    direct = scores.profile(scores.unified_view(records))
    assert rows(reports["by_source"]) == rows(report_source.by_source(direct))
    assert rows(reports["shift"]) == rows(report_global.shift(scores.profile_levels(direct)))
    assert all(df.columns for df in reports.values())
    for table in shared:
        table.drop()


def test_levels_are_closed():
    assert list(LEVELS) == sorted(LEVELS) and list(LEVELS.values()) == sorted(LEVELS.values())
