"""Registered queries and SQL of the resolution report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from checks.views import view, with_views
from kinweave.operators import report_global, report_overlap, report_source, scores
from kinweave.functions.scoring import LEVELS, WEIGHTS
from kinweave.sources.catalog import distinct_sources

# Friendly names; two of the order sources become one.
MAPPING = {"orders_F": "Orders closed", "orders_P": "Orders closed", "crm": "CRM"}
PAIRED = ["crm", "orders_F", "orders_O", "orders_P", "web"]


def _unified(spark: SparkSession, folder: str) -> DataFrame:
    return scores.unified_view(view(spark, folder, "unified"))


def _profile(spark: SparkSession, folder: str) -> DataFrame:
    return scores.profile(_unified(spark, folder))


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    return scores.sizes(_unified(spark, folder))


def _graded(spark: SparkSession, folder: str) -> DataFrame:
    return scores.profile_levels(_profile(spark, folder))


def _three_regions(s: SparkSession, d: str) -> DataFrame:
    sizes = _sizes(s, d)
    return report_overlap.all_venn_regions(sizes, [r["source"] for r in report_overlap.top_sources(sizes).collect()])


QUERIES = {
    "rpt_unified_view": lambda s, d: scores.unified_view(view(s, d, "unified"), MAPPING),
    "rpt_record_score": lambda s, d: scores.record_scores(_unified(s, d)).select("pk", "record_pii_score"),
    "rpt_classify": lambda s, d: scores.record_levels(_unified(s, d)).select("pk", "row_known_unknown"),
    "rpt_source_score": lambda s, d: scores.source_scores(_profile(s, d)),
    "rpt_cluster_score": lambda s, d: scores.entity_scores(_profile(s, d)),
    "rpt_score_join": lambda s, d: scores.scored(_unified(s, d)),
    "rpt_levels": lambda s, d: scores.levels(_unified(s, d)),
    "rpt_records_vs_entities": lambda s, d: report_global.records_vs_entities(_sizes(s, d)),
    "rpt_dedupe_rate": lambda s, d: report_global.dedupe_rate(_sizes(s, d)),
    "rpt_improvement": lambda s, d: report_global.improvement(_graded(s, d)),
    "rpt_shift": lambda s, d: report_global.shift(_graded(s, d)),
    "rpt_shift_matrix": lambda s, d: report_global.shift_matrix(_graded(s, d), list(LEVELS)),
    "rpt_by_source": lambda s, d: report_source.by_source(_sizes(s, d)),
    "rpt_dedupe_by_source": lambda s, d: report_source.dedupe_by_source(_sizes(s, d)),
    "rpt_consolidation": lambda s, d: report_source.consolidation(_sizes(s, d)),
    "rpt_improvement_by_source": lambda s, d: report_source.improvement_by_source(_graded(s, d)),
    "rpt_source_level_entities": lambda s, d: report_source.source_level_entities(_graded(s, d)),
    "rpt_overall_consolidation": lambda s, d: report_overlap.overall_consolidation(_sizes(s, d)),
    "rpt_source_count": lambda s, d: report_overlap.source_count(_sizes(s, d)),
    "rpt_top_sources": lambda s, d: report_overlap.top_sources(_sizes(s, d)),
    "rpt_overlap_groups": lambda s, d: report_overlap.overlap_groups(_sizes(s, d)),
    "rpt_venn_regions": _three_regions,
    "rpt_venn_occurring": lambda s, d: report_overlap.venn_regions(_sizes(s, d)).drop("sources"),
    "rpt_pairwise_overlap": lambda s, d: report_overlap.pairwise_overlap(_sizes(s, d)),
    "rpt_overlap_matrix": lambda s, d: report_overlap.overlap_matrix(_sizes(s, d), PAIRED),
    "distinct_sources": lambda s, d: distinct_sources(view(s, d, "unified")),
}


def _score_sql(name: str) -> str:
    terms = [f"CASE WHEN {c} IS NOT NULL THEN CAST({w} AS DOUBLE) ELSE 0 END" for c, w in WEIGHTS.items()]
    return f"({' + '.join(terms)}) AS {name}"


def _level_sql(score: str, name: str) -> str:
    ranked = sorted(LEVELS.items(), key=lambda kv: -kv[1])
    return f"CASE {' '.join(f'WHEN {score} >= {v} THEN {chr(39)}{k}{chr(39)}' for k, v in ranked)} END AS {name}"


_MAXES = ", ".join(f"max({c}) AS {c}" for c in WEIGHTS)
_BASE = (
    with_views(["unified"])
    + f""",
v AS (SELECT entity_id, datasource AS source, pk, {', '.join(WEIGHTS)} FROM unified),
r AS (SELECT *, {_score_sql('record_pii_score')} FROM v),
ss AS (SELECT entity_id, source, {_score_sql('source_pii_score')}
       FROM (SELECT entity_id, source, {_MAXES} FROM r GROUP BY 1, 2)),
es AS (SELECT entity_id, max_record_pii_score, {_score_sql('entity_pii_score')}
       FROM (SELECT entity_id, {_MAXES}, max(record_pii_score) AS max_record_pii_score FROM r GROUP BY 1)),
j AS (SELECT r.*, ss.source_pii_score, es.entity_pii_score, es.max_record_pii_score
      FROM r JOIN ss ON r.entity_id = ss.entity_id AND r.source = ss.source JOIN es ON r.entity_id = es.entity_id),
lv AS (SELECT entity_id, source, record_pii_score, {_level_sql('record_pii_score', 'row_known_unknown')},
         source_pii_score, {_level_sql('source_pii_score', 'source_known_unknown')},
         entity_pii_score, {_level_sql('entity_pii_score', 'entity_known_unknown')},
         max_record_pii_score, {_level_sql('max_record_pii_score', 'max_record_known_unknown')} FROM j),
es_sizes AS (SELECT entity_id, source, count(*) AS records FROM v GROUP BY 1, 2),
e_sizes AS (SELECT entity_id, count(*) AS records, count(DISTINCT source) AS sources FROM v GROUP BY 1),
top3 AS (SELECT source FROM (SELECT source, count(*) AS n FROM v GROUP BY 1 ORDER BY n DESC, source LIMIT 3)),
groups AS (SELECT venn_group, count(*) AS cnt FROM (
   SELECT entity_id, string_agg(DISTINCT source, ', ' ORDER BY source) AS venn_group
   FROM v WHERE source IN (SELECT source FROM top3) GROUP BY 1) GROUP BY 1),
members AS (SELECT DISTINCT entity_id, source FROM v),
pairs AS (SELECT a.source AS source_1, b.source AS source_2, count(*) AS cnt
          FROM members a FULL JOIN members b ON a.entity_id = b.entity_id WHERE a.source <> b.source GROUP BY 1, 2)
"""
)


def _sides(keys: str, on: str) -> str:
    lead = f"{keys}, " if keys else ""
    n = 2 if keys else 1
    by = ", ".join(str(i + 1) for i in range(n))
    return (
        f"(SELECT {lead}row_known_unknown, count(*) AS before_cnt FROM lv GROUP BY {by}) b FULL JOIN "
        f"(SELECT {lead}entity_known_unknown, count(*) AS after_cnt FROM lv GROUP BY {by}) a "
        f"ON b.row_known_unknown = a.entity_known_unknown{on}"
    )


def _share(part: str, whole: str) -> str:
    return f"round({part} * CAST(100 AS DOUBLE) / {whole}, 1)"


_SQL = {
    "rpt_record_score": "SELECT pk, record_pii_score FROM r",
    "rpt_classify": f"SELECT pk, {_level_sql('record_pii_score', 'row_known_unknown')} FROM r",
    "rpt_source_score": "SELECT * FROM ss",
    "rpt_cluster_score": "SELECT * FROM es",
    "rpt_score_join": "SELECT * FROM j",
    "rpt_levels": "SELECT * FROM lv",
    "rpt_records_vs_entities": "SELECT count(*) AS source_ids, count(DISTINCT entity_id) AS entity_ids FROM v",
    "rpt_dedupe_rate": "SELECT count(*) AS record_cnt, count(DISTINCT entity_id) AS entity_cnt, "
    "1 - CAST(count(DISTINCT entity_id) AS DOUBLE) / NULLIF(count(*), 0) AS de_dupe_rate FROM v",
    "rpt_improvement": f"""SELECT *, format('{{:,}}', before_cnt) AS before_cnt_text,
  format('{{:,}}', after_cnt) AS after_cnt_text, CAST(perc_pre AS VARCHAR) || '%' AS perc_pre_text,
  CAST(perc_post AS VARCHAR) || '%' AS perc_post_text FROM (
  SELECT coalesce(row_known_unknown, entity_known_unknown) AS pii_classification, before_cnt, after_cnt,
    {_share('before_cnt', 'sum(before_cnt) OVER ()')} AS perc_pre,
    {_share('after_cnt', 'sum(after_cnt) OVER ()')} AS perc_post,
    {_share('after_cnt', 'sum(before_cnt) OVER ()')} AS perc_post_of_pre FROM {_sides('', '')})""",
    "rpt_shift": "SELECT row_known_unknown AS pre_level, entity_known_unknown AS post_level, count(*) AS record_cnt "
    "FROM lv GROUP BY 1, 2",
    "rpt_shift_matrix": "SELECT row_known_unknown AS pre_level, "
    + ", ".join(f"count(*) FILTER (entity_known_unknown = '{k}') AS \"{k}\"" for k in LEVELS)
    + " FROM lv GROUP BY 1",
    "rpt_by_source": "SELECT source, count(*) AS source_ids, count(DISTINCT entity_id) AS entity_ids FROM v GROUP BY 1",
    "rpt_dedupe_by_source": """SELECT source, count(*) AS source_ids, count(DISTINCT entity_id) AS entity_ids,
  round(1 - CAST(count(DISTINCT entity_id) AS DOUBLE) / count(*), 3) AS source_dupe_rate,
  CAST(round(100 - CAST(100 AS DOUBLE) * count(DISTINCT entity_id) / count(*), 1) AS VARCHAR) || '%'
    AS source_dedupe_rate_perc,
  count(*) - count(DISTINCT entity_id) AS records_de_duped FROM v GROUP BY 1""",
    "rpt_consolidation": """SELECT source, CASE WHEN records = 1 THEN '1 Record to 1 Cluster'
    WHEN records = 2 THEN '2 Records to 1 Cluster' ELSE '3+ Records to 1 Cluster' END AS records_in_cluster,
  count(*) AS cnt FROM es_sizes GROUP BY 1, 2""",
    "rpt_improvement_by_source": f"""SELECT *, format('{{:,}}', before_cnt) AS before_cnt_text,
  format('{{:,}}', after_cnt) AS after_cnt_text,
  CAST(percent_of_before AS VARCHAR) || '%' AS percent_of_before_text,
  CAST(percent_of_after AS VARCHAR) || '%' AS percent_of_after_text FROM (
  SELECT coalesce(b.source, a.source) AS source, coalesce(row_known_unknown, entity_known_unknown) AS pii_known_unknown,
    before_cnt, after_cnt,
    {_share('before_cnt', 'sum(before_cnt) OVER (PARTITION BY b.source)')} AS percent_of_before,
    {_share('after_cnt', 'sum(after_cnt) OVER (PARTITION BY a.source)')} AS percent_of_after
  FROM {_sides('source', ' AND b.source = a.source')})""",
    "rpt_source_level_entities": """SELECT source, source_known_unknown, entity_known_unknown, count(*) AS entities
  FROM (SELECT DISTINCT source, entity_id, source_pii_score, source_known_unknown, entity_pii_score,
        entity_known_unknown FROM lv) GROUP BY 1, 2, 3""",
    "rpt_overall_consolidation": """
SELECT 'Clusters' AS source, '1 Record Clusters' AS resolution_type,
  CAST(sum(CASE WHEN records = 1 THEN 1 ELSE 0 END) AS BIGINT) AS value FROM e_sizes
UNION SELECT 'Clusters', '2+ Record Clusters', CAST(sum(CASE WHEN records >= 2 THEN 1 ELSE 0 END) AS BIGINT) FROM e_sizes
UNION SELECT 'Source IDs', '1 Record to 1 Cluster', CAST(sum(CASE WHEN records = 1 THEN 1 ELSE 0 END) AS BIGINT) FROM e_sizes
UNION SELECT 'Source IDs', '2+ Records to 1 Cluster',
  CAST(sum(CASE WHEN records >= 2 THEN records ELSE 0 END) AS BIGINT) FROM e_sizes""",
    "rpt_source_count": """SELECT CASE WHEN sources = 1 THEN '1 Source' WHEN sources = 2 THEN '2 Sources'
    WHEN sources = 3 THEN '3 Sources' WHEN sources = 4 THEN '4 Sources' WHEN sources >= 5 THEN '5+ Sources'
    ELSE 'Check' END AS number_of_sources, count(*) AS entity_ids, CAST(sum(records) AS BIGINT) AS source_count,
  CAST(sum(CASE WHEN records > sources THEN 1 ELSE 0 END) AS BIGINT) AS intra_source_dupe_count
  FROM e_sizes GROUP BY 1""",
    "rpt_top_sources": "SELECT source, count(*) AS record_count FROM v WHERE source IN (SELECT source FROM top3) "
    "GROUP BY 1",
    "rpt_overlap_groups": "SELECT venn_group, cnt FROM groups ORDER BY 1",
    "rpt_venn_regions": """SELECT CAST(region AS BIGINT) AS region, regions.venn_group,
  CAST(coalesce(cnt, 0) AS BIGINT) AS cnt FROM (
  SELECT region, string_agg(source, ', ' ORDER BY source) AS venn_group
  FROM (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM top3), range(1, 8) AS g(region)
  WHERE (region >> i) & 1 = 1 GROUP BY 1) AS regions
  LEFT JOIN groups ON regions.venn_group = groups.venn_group""",
    "rpt_venn_occurring": """SELECT venn_group, count(*) AS cnt FROM (SELECT entity_id,
  string_agg(DISTINCT source, ', ' ORDER BY source) AS venn_group FROM v WHERE source IS NOT NULL GROUP BY 1) GROUP BY 1""",
    "rpt_pairwise_overlap": "SELECT * FROM pairs",
    "rpt_overlap_matrix": "SELECT source_1, "
    + ", ".join(f"CAST(sum(CASE WHEN source_2 = '{s}' THEN cnt END) AS BIGINT) AS {s}" for s in PAIRED)
    + " FROM pairs GROUP BY 1",
    "distinct_sources": "SELECT DISTINCT source AS datasource FROM v WHERE source IS NOT NULL",
}

ORACLES = {name: f"{_BASE}\n{sql}" for name, sql in _SQL.items()}
ORACLES["rpt_unified_view"] = (
    with_views(["unified"])
    + f"""
SELECT entity_id, pk, {', '.join(WEIGHTS)}, CASE datasource
  {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in MAPPING.items())} ELSE datasource END AS source FROM unified"""
)
