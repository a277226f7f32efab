"""Registered queries and SQL of the resolution step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from checks.rules import MATCH_RULES, MATCH_WEIGHTS, SIMILAR_LENGTH, SIMILAR_RULES, SIMILAR_WEIGHTS
from checks.views import table
from kinweave.operators import components, entity_store, resolution, scores, similar
from kinweave.operators.report_overlap import pairwise_overlap
from kinweave.sources.outputs import write_resolution
from kinweave.sources.shared import materialise, scratch_path

# Every match rule has records that it links, and some that it alone links.
SEMANTICS = {
    "crm": {"c_name": "full-name", "mail": "email", "street": "address", "nation": "country", "c_mktsegment": "surname"},
    "orders": {"mail": "email", "caller": "phone"},
    "vendors": {"s_name": "full-name"},
    "web": {"mail": "email", "born": "birthdate"},
    "members": {"c_name": "given-name", "c_mktsegment": "surname", "street": "address", "born": "birthdate"},
    "guests": {"guest": "given-name", "c_mktsegment": "surname", "street": "address", "born": "birthdate"},
}
KEYS = {"crm": "c_custkey", "orders": "o_orderkey", "vendors": "s_suppkey", "web": "event_id", "members": "m_id", "guests": ["c_nationkey", "c_custkey"]}


def _tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """Source tables as they come: mixed case, stray blanks, phones with signs, dates in another order."""
    return {
        "crm": table(s, d, "customer").selectExpr(
            "CASE WHEN c_custkey % 97 <> 1 THEN c_custkey END AS c_custkey",
            "c_name",
            "c_mktsegment",
            "CASE WHEN c_custkey % 2 = 0 THEN concat(' U', CAST(c_custkey AS STRING), '@Example.COM ') END AS mail",
            "CASE WHEN c_acctbal > 0 THEN concat('Street  ', CAST(c_nationkey AS STRING)) END AS street",
            "CASE WHEN c_acctbal > 5000 THEN concat('Nation ', CAST(c_nationkey AS STRING)) END AS nation",
        ),
        "orders": table(s, d, "orders").selectExpr(
            "o_orderkey",
            "CASE WHEN o_orderkey % 3 = 0 THEN concat('u', CAST(o_custkey AS STRING), '@example.com') END AS mail",
            "CASE WHEN o_orderpriority = '1-URGENT' THEN concat('(555) ', CAST(o_custkey AS STRING), '-00') END AS caller",
        ),
        "vendors": table(s, d, "supplier").selectExpr("s_suppkey - IF(s_suppkey % 10 = 3, 1, 0) AS s_suppkey", "s_name"),
        "members": table(s, d, "customer").selectExpr(
            "c_custkey AS m_id",
            "c_name",
            "c_mktsegment",
            "CASE c_custkey % 3 WHEN 0 THEN concat('STREET ', CAST(c_nationkey AS STRING)) "
            "WHEN 1 THEN concat('Lane ', CAST(c_custkey AS STRING)) END AS street",
            "CASE WHEN c_custkey % 4 <> 0 THEN concat('02/01/19', CAST(60 + c_custkey % 30 AS STRING)) END AS born",
        ),
        "guests": table(s, d, "customer").filter("c_custkey % 5 < 3").selectExpr(
            "c_custkey",
            "c_nationkey",
            "c_mktsegment",
            "CASE WHEN c_custkey % 5 = 0 THEN upper(c_name) ELSE concat('guest ', CAST(c_custkey AS STRING)) END AS guest",
            "CASE WHEN c_custkey % 5 = 1 THEN concat('lane  ', CAST(c_custkey AS STRING)) END AS street",
            "CASE WHEN c_custkey % 7 <> 0 THEN concat('19', CAST(60 + c_custkey % 30 AS STRING), '-02-01') END AS born",
        ),
        "web": table(s, d, "events").selectExpr(
            "event_id",
            "CASE WHEN event_type = 'signup' THEN concat('u', CAST(user_id AS STRING), '@example.com') END AS mail",
            "CASE WHEN event_type = 'purchase' THEN '12/31/1990' WHEN event_type = 'view' THEN 'n/a' END AS born",
        ),
    }


def _records(s: SparkSession, d: str) -> DataFrame:
    return resolution.standardise(_tables(s, d), SEMANTICS, KEYS)


def _edges(s: SparkSession, d: str) -> DataFrame:
    return resolution.pair_scores(resolution.pairs(_records(s, d)))


def _unified(s: SparkSession, d: str) -> DataFrame:
    return resolution.unified(_records(s, d), components.connected_components(_edges(s, d)))


def _stored_overlap(s: SparkSession, d: str) -> DataFrame:
    """Resolve, store both output tables, and report source overlap from the stored records."""
    path = scratch_path(s, "resolution")
    records = materialise(_records(s, d), "records")
    edges = materialise(resolution.pair_scores(resolution.pairs(records.df)), "edges")
    resolved = resolution.unified(records.df, components.connected_components(edges.df))
    write_resolution(resolved, edges.df, path, as_tables=False)
    for part in (records, edges):
        part.drop()
    stored = s.read.parquet(f"{path}/unified_coalesced")
    return pairwise_overlap(scores.profile(scores.unified_view(stored)))


def _typed_records(s: SparkSession, d: str) -> DataFrame:
    """Records of the two sources with names, and of forms that people filled in with one letter wrong."""
    source = table(s, d, "customer").filter("c_custkey % 3 = 1").selectExpr(
        "c_custkey AS f_id",
        "CASE c_custkey % 5 WHEN 0 THEN replace(c_name, 'o', '') WHEN 1 THEN concat(c_name, 'x') WHEN 2 THEN replace(c_name, 'C', 'K') ELSE c_name END AS name",
        "CASE WHEN c_custkey % 2 = 0 THEN substr(c_mktsegment, 2) ELSE c_mktsegment END AS family",
        "CASE WHEN c_custkey % 4 < 2 THEN concat('u', CAST(c_custkey AS STRING), '@exmple.com') END AS mail",
        "CASE WHEN c_custkey % 6 < 3 THEN concat('Strete ', CAST(c_nationkey AS STRING)) ELSE concat('Stret ', CAST(c_nationkey AS STRING)) END AS street",
        "CASE WHEN c_custkey % 8 > 3 THEN concat('19', CAST(60 + c_custkey % 30 AS STRING), '-02-01') END AS born",
    )
    tags = {"name": "given-name", "family": "surname", "mail": "email", "street": "address", "born": "birthdate"}
    forms = resolution.standardise({"forms": source}, {"forms": tags}, {"forms": "f_id"})
    known = resolution.standardise({n: t for n, t in _tables(s, d).items() if n in ("crm", "members")}, SEMANTICS, KEYS)
    return known.unionByName(forms)


def _similar_edges(s: SparkSession, d: str) -> DataFrame:
    return similar.similar_scores(similar.similar_pairs(_typed_records(s, d)))


def _similar_unified(s: SparkSession, d: str) -> DataFrame:
    records = materialise(_typed_records(s, d), "records").df
    exact = resolution.pairs(records).select("id_a", "id_b")
    edges = exact.unionByName(similar.similar_pairs(records).select("id_a", "id_b"))
    return resolution.unified(records, components.connected_components(edges)).select("record_id", "entity_id")


def _survey_blocks(s: SparkSession, d: str) -> DataFrame:
    """Customers with postal codes in two spellings."""
    source = table(s, d, "customer").selectExpr(
        "c_custkey", "c_mktsegment",
        "CASE c_custkey % 3 WHEN 0 THEN concat('ab', CAST(c_nationkey AS STRING), ' 1x') WHEN 1 THEN concat('AB-', CAST(c_nationkey AS STRING), '1X') ELSE '--' END AS zip",
        "CASE WHEN c_custkey % 4 <> 0 THEN concat('19', CAST(60 + c_custkey % 30 AS STRING), '-02-01') END AS born",
    )
    tags = {"c_mktsegment": "surname", "zip": "postal", "born": "birthdate"}
    records = resolution.standardise({"crm": source}, {"crm": tags}, {"crm": "c_custkey"}, postal=True)
    return resolution.blocks(records, resolution.SURVEY_BLOCKS)


def _in_batches(s: SparkSession, d: str) -> entity_store.EntityStore:
    """The records of ``er_unified``, stored in three batches; later ones join entities of earlier ones."""
    records = _records(s, d)
    store = entity_store.EntityStore(s, scratch_path(s, "entities"), buckets=16)
    for sources in (("crm", "vendors", "web"), ("guests",), ("orders", "members")):
        store.add(records.filter(F.col("datasource").isin(*sources)))
    return store


QUERIES = {
    "er_incremental": lambda s, d: _in_batches(s, d).entities().select("record_id", F.min("record_id").over(Window.partitionBy("entity_id")).alias("entity_id")),
    "er_survey_blocks": _survey_blocks,
    "er_similar_pairs": _similar_edges,
    "er_similar_unified": _similar_unified,
    "er_standardise": _records,
    "er_rejected": lambda s, d: resolution.rejected(_tables(s, d), KEYS),
    "er_blocks": lambda s, d: resolution.blocks(_records(s, d)),
    "er_pairs": lambda s, d: resolution.pairs(_records(s, d)).select("id_a", "id_b", "rules"),
    "er_scores": _edges,
    "er_components": lambda s, d: components.connected_components(_edges(s, d)),
    "er_unified": _unified,
    "er_stored_overlap": _stored_overlap,
}

_FIELDS = ", ".join(resolution.FIELDS)


def _block(fields: tuple[str, ...]) -> str:
    key = " || chr(31) || ".join(fields)
    present = " AND ".join(f"{f} IS NOT NULL" for f in fields)
    return f"SELECT record_id, '{'+'.join(fields)}' AS rule, {key} AS block_key FROM records WHERE {present}"


def _agrees(fields: tuple[str, ...]) -> str:
    return f"CASE WHEN {' AND '.join(f'a.{f} = b.{f}' for f in fields)} THEN '{'+'.join(fields)}' END"


_AGREE = ", ".join(_agrees(rule) for rule in MATCH_RULES)
_RECORDS = """
SELECT concat('crm:', c_custkey) AS record_id, 'crm' AS datasource, lower(c_name) AS given_name,
  lower(c_mktsegment) AS surname, CASE WHEN c_custkey % 2 = 0 THEN concat('u', c_custkey, '@example.com') END AS email,
  CAST(NULL AS VARCHAR) AS phone, CASE WHEN c_acctbal > 5000 THEN concat('street ', c_nationkey, ' nation ', c_nationkey)
    WHEN c_acctbal > 0 THEN concat('street ', c_nationkey) END AS address, CAST(NULL AS VARCHAR) AS birthdate
  FROM customer WHERE c_custkey % 97 <> 1
UNION ALL SELECT concat('orders:', o_orderkey), 'orders', NULL, NULL,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('u', o_custkey, '@example.com') END,
  CASE WHEN o_orderpriority = '1-URGENT' THEN concat('555', o_custkey, '00') END, NULL, NULL FROM orders
UNION ALL SELECT concat('vendors:', s_suppkey - CASE WHEN s_suppkey % 10 = 3 THEN 1 ELSE 0 END), 'vendors', lower(s_name),
  NULL, NULL, NULL, NULL, NULL FROM supplier
UNION ALL SELECT concat('web:', event_id), 'web', NULL, NULL,
  CASE WHEN event_type = 'signup' THEN concat('u', user_id, '@example.com') END, NULL, NULL,
  CASE WHEN event_type = 'purchase' THEN '1990-12-31' END FROM events
UNION ALL SELECT concat('members:', c_custkey), 'members', lower(c_name), lower(c_mktsegment), NULL, NULL,
  CASE c_custkey % 3 WHEN 0 THEN concat('street ', c_nationkey) WHEN 1 THEN concat('lane ', c_custkey) END,
  CASE WHEN c_custkey % 4 <> 0 THEN concat('19', 60 + c_custkey % 30, '-02-01') END FROM customer
UNION ALL SELECT concat('guests:', c_nationkey, chr(31), c_custkey), 'guests',
  CASE WHEN c_custkey % 5 = 0 THEN lower(c_name) ELSE concat('guest ', c_custkey) END, lower(c_mktsegment), NULL, NULL,
  CASE WHEN c_custkey % 5 = 1 THEN concat('lane ', c_custkey) END,
  CASE WHEN c_custkey % 7 <> 0 THEN concat('19', 60 + c_custkey % 30, '-02-01') END FROM customer WHERE c_custkey % 5 < 3"""
_BASE = f"""WITH RECURSIVE records AS ({_RECORDS}),
blocks AS ({' UNION ALL '.join(_block(rule) for rule in MATCH_RULES)}),
hubs AS (SELECT rule, block_key, min(record_id) AS hub FROM blocks GROUP BY ALL),
found AS (SELECT blocks.record_id AS id_a, hub AS id_b, rule, coalesce({_AGREE}) AS first_rule,
    concat_ws(', ', {_AGREE}) AS rules
  FROM blocks JOIN hubs USING (rule, block_key) JOIN records a ON a.record_id = blocks.record_id
  JOIN records b ON b.record_id = hub WHERE blocks.record_id <> hub),
pairs AS (SELECT id_a, id_b, rules FROM found WHERE rule = first_rule),
links AS (SELECT id_a AS x, id_b AS y FROM pairs UNION SELECT id_b, id_a FROM pairs),
reach AS (SELECT DISTINCT x AS node, x AS seen FROM links
  UNION SELECT node, y FROM reach JOIN links ON seen = x),
comps AS (SELECT node, min(seen) AS component FROM reach GROUP BY 1),
resolved AS (SELECT records.*, coalesce(component, record_id) AS entity_id
  FROM records LEFT JOIN comps ON node = record_id)
"""


def _scores_sql() -> str:
    score, alike, known = [], [], []
    for f, w in MATCH_WEIGHTS.items():
        both = f"a.{f} IS NOT NULL AND b.{f} IS NOT NULL"
        near = f"1 - CAST(levenshtein(a.{f}, b.{f}) AS DOUBLE) / greatest(length(a.{f}), length(b.{f}))"
        score.append(f"CASE WHEN a.{f} = b.{f} THEN CAST({w} AS DOUBLE) ELSE 0 END")
        alike.append(f"CASE WHEN {both} THEN ({near}) * CAST({w} AS DOUBLE) ELSE 0 END")
        known.append(f"CASE WHEN {both} THEN CAST({w} AS DOUBLE) ELSE 0 END")
    return (
        f"SELECT id_a, id_b, {' + '.join(score)} AS score, round(({' + '.join(alike)}) / ({' + '.join(known)}), 6) "
        "AS confidence, rules FROM pairs JOIN records a ON a.record_id = id_a JOIN records b ON b.record_id = id_b"
    )


_FORMS = """
SELECT concat('forms:', c_custkey) AS record_id, 'forms' AS datasource, lower(CASE c_custkey % 5 WHEN 0 THEN replace(c_name, 'o', '')
    WHEN 1 THEN concat(c_name, 'x') WHEN 2 THEN replace(c_name, 'C', 'K') ELSE c_name END) AS given_name,
  lower(CASE WHEN c_custkey % 2 = 0 THEN substr(c_mktsegment, 2) ELSE c_mktsegment END) AS surname,
  CASE WHEN c_custkey % 4 < 2 THEN concat('u', c_custkey, '@exmple.com') END AS email, CAST(NULL AS VARCHAR) AS phone,
  CASE WHEN c_custkey % 6 < 3 THEN concat('strete ', c_nationkey) ELSE concat('stret ', c_nationkey) END AS address,
  CASE WHEN c_custkey % 8 > 3 THEN concat('19', 60 + c_custkey % 30, '-02-01') END AS birthdate FROM customer WHERE c_custkey % 3 = 1"""


def _alike(f: str) -> str:
    return f"(a.{f} <> b.{f} AND least(length(a.{f}), length(b.{f})) >= {SIMILAR_LENGTH} AND levenshtein(a.{f}, b.{f}) = 1)"


def _near(field: str, equal: tuple[str, ...]) -> str:
    return f"CASE WHEN {' AND '.join([_alike(field), *(f'a.{f} = b.{f}' for f in equal)])} THEN '{'+'.join(['~' + field, *equal])}' END"


def _similar_keys() -> str:
    """A line per record, rule and key: the rest without the letter at a position, and the value as centre."""
    parts = []
    for field, equal in SIMILAR_RULES:
        rule, key = "+".join(["~" + field, *equal]), " || chr(31) || ".join(equal)
        present = " AND ".join(f"{f} IS NOT NULL" for f in equal)
        rest = f"left({field}, pos - 1) || substr({field}, pos + 1)"
        of = f"SELECT DISTINCT record_id, '{rule}' AS rule, {key} AS equal"
        held = f"records WHERE {present} AND length({field}) >= {SIMILAR_LENGTH}"
        cut = f"(SELECT *, unnest(range(1, length({field}) + 1)) AS pos FROM {held})"
        parts += [f"{of}, pos, {rest} AS rest, false AS centre FROM {cut}", f"{of}, 0, {rest}, false FROM {cut}", f"{of}, 0, {field}, true FROM {held}"]
    return " UNION ALL ".join(parts)


_NEAR = ", ".join(_near(*rule) for rule in SIMILAR_RULES)
_TYPED = f"""WITH RECURSIVE every AS ({_RECORDS} UNION ALL {_FORMS}),
records AS (SELECT * FROM every WHERE datasource IN ('crm', 'members', 'forms'))"""
_BOTH = ", ".join(f"CASE WHEN {_alike(f)} THEN CAST({w} AS DOUBLE) ELSE 0 END" for f, w in SIMILAR_WEIGHTS.items())
_EQUAL_WORTH = " + ".join(f"CASE WHEN a.{f} = b.{f} THEN CAST({w} AS DOUBLE) ELSE 0 END" for f, w in MATCH_WEIGHTS.items())


def _similar_pairs_sql() -> str:
    scored = _scores_sql().replace(" AS score", f" + greatest({_BOTH}) AS score")
    return f"""{_TYPED},
keys AS ({_similar_keys()}),
hubs AS (SELECT rule, equal, pos, rest, min(record_id) FILTER (pos > 0 OR centre) AS hub FROM keys GROUP BY ALL HAVING count(*) > 1),
found AS (SELECT record_id AS id_a, hub AS id_b, rule FROM keys JOIN hubs USING (rule, equal, pos, rest) WHERE hub <> record_id),
pairs AS (SELECT id_a, id_b, concat_ws(', ', {_NEAR}) AS rules FROM found JOIN records a ON a.record_id = id_a JOIN records b ON b.record_id = id_b
  WHERE coalesce({_AGREE}) IS NULL AND rule = coalesce({_NEAR}))
{scored}"""


ORACLES = {
    "er_survey_blocks": """WITH r AS (SELECT concat('crm:', c_custkey) AS record_id, lower(c_mktsegment) AS surname,
  CASE WHEN c_custkey % 3 < 2 THEN concat('ab', c_nationkey, '1x') END AS postal,
  CASE WHEN c_custkey % 4 <> 0 THEN concat('19', 60 + c_custkey % 30, '-02-01') END AS birthdate FROM customer)
SELECT record_id, 'surname+birthdate' AS rule, surname || chr(31) || birthdate AS block_key FROM r WHERE birthdate IS NOT NULL
UNION ALL SELECT record_id, 'postal+surname', postal || chr(31) || surname FROM r WHERE postal IS NOT NULL""",
    "er_similar_pairs": _similar_pairs_sql(),
    # All pairs with one equal field, as every rule has one, compared by edit distance.
    "er_similar_unified": f"""{_TYPED},
links AS (SELECT DISTINCT a.record_id AS x, b.record_id AS y FROM records a JOIN records b ON a.record_id <> b.record_id
    AND (a.surname = b.surname OR a.given_name = b.given_name OR a.address = b.address OR a.birthdate = b.birthdate OR a.email = b.email)
  WHERE {_EQUAL_WORTH} + greatest({_BOTH}) >= 2),
reach AS (SELECT DISTINCT x AS node, x AS seen FROM links UNION SELECT node, y FROM reach JOIN links ON seen = x),
comps AS (SELECT node, min(seen) AS component FROM reach GROUP BY 1)
SELECT record_id, coalesce(component, record_id) AS entity_id FROM records LEFT JOIN comps ON node = record_id""",
    "er_standardise": _RECORDS,
    "er_rejected": """
SELECT 'crm' AS datasource, CAST(NULL AS VARCHAR) AS record_key, 'no key' AS reason, count(*) AS lines FROM customer
  WHERE c_custkey % 97 = 1 HAVING count(*) > 0
UNION ALL SELECT 'vendors', CAST(s_suppkey - 1 AS VARCHAR), 'repeated key', 2 FROM supplier WHERE s_suppkey % 10 = 3""",
    "er_blocks": f"{_BASE} SELECT * FROM blocks",
    "er_pairs": f"{_BASE} SELECT * FROM pairs",
    "er_scores": f"{_BASE} {_scores_sql()}",
    "er_components": f"{_BASE} SELECT * FROM comps",
    "er_unified": f"{_BASE} SELECT * FROM resolved",
    "er_incremental": f"{_BASE} SELECT DISTINCT record_id, entity_id FROM resolved",
    "er_stored_overlap": f"""{_BASE}, m AS (SELECT DISTINCT entity_id, datasource FROM resolved)
SELECT a.datasource AS source_1, b.datasource AS source_2, count(*) AS cnt FROM m a JOIN m b USING (entity_id)
WHERE a.datasource <> b.datasource GROUP BY 1, 2""",
}
