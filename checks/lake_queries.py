"""Registered queries and SQL on catalogue, PII, tags and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.rules import NAME_PATTERNS, NUMERIC_TYPES, SEMANTICS, UNSUPPORTED_TYPES, UUID_PATTERN, VALUE_PATTERNS
from checks.views import SCHEMAS, TABLES, table, view, with_views
from kinweave.functions.types import normalise_type
from kinweave.operators import content, edits, inventory, manifest, name_index, pii, sketches, tags
from kinweave.plans import tagging
from kinweave.sources import catalog, footers, manifests, paging, planned, readers
from kinweave.sources.shared import materialise, scratch_path
from kinweave.sources.tag_table import TagTable

SKIP = "_resolved"
AT = "2024-06-01 00:00:00"
RULES = manifest.ManifestRules(settings=("output_catalog_name", "output_schema_name"))
# The string columns of the given tables, by their stated schemas.
TEXT_COLUMNS = {
    name: found
    for name, schema in SCHEMAS.items()
    if (found := [c.split()[0] for c in schema.split(", ") if c.endswith(" string")])
}
# Their columns of integers and texts.
PROFILED = {
    name: found
    for name, schema in SCHEMAS.items()
    if (found := [c.split()[0] for c in schema.split(", ") if c.split()[1] in ("int", "bigint", "string")])
}
TARGETS = ["customer#000000012", "SUPPLIER#00000000", "nation_2", "nation", "zz top"]
CHUNK_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _columns(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "columns")


def _scan(s: SparkSession, d: str) -> DataFrame:
    """Name rules on all tables that are not outputs of an earlier run."""
    return pii.classify_columns(pii.skip_tables(_columns(s, d), SKIP))


def _answered(s: SparkSession, d: str) -> DataFrame:
    return pii.ingest_answers(pii.skip_tables(_columns(s, d), SKIP), view(s, d, "answers"))


def _kept_answers(s: SparkSession, d: str) -> DataFrame:
    """The answered scan as a written table, for operators that read it more than once."""
    return materialise(_answered(s, d), "scan").df


def _summary(s: SparkSession, d: str) -> DataFrame:
    return pii.table_summary(_answered(s, d), pii.skip_tables(view(s, d, "listing"), SKIP))


def _edits(s: SparkSession, d: str, action: str) -> DataFrame:
    return view(s, d, "edits").filter(F.col("action") == action)


def _semantics_text(fields: DataFrame) -> DataFrame:
    return fields.withColumn("semantics", F.array_join("semantics", ","))


def _profiles(s: SparkSession, d: str) -> DataFrame:
    """Profiles of two batches of every table, each stored, then merged."""

    def batch(k: int) -> DataFrame:
        parts = {n: table(s, d, n) for n in PROFILED}
        parts = {n: (df.filter(F.pmod(F.xxhash64(PROFILED[n][0]), F.lit(2)) == k), PROFILED[n]) for n, df in parts.items()}
        return materialise(sketches.column_profiles(parts), "profiles").df

    return sketches.read_profiles(sketches.merge_profiles(batch(0), batch(1))).drop("n_distinct", "median")


def _profiles_sql() -> str:
    """The same from all values. Sketches of distinct values are only asked whether a column may be a key."""
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, COUNT(*) AS n_rows, COUNT(*) - COUNT({c}) AS n_null, "
        f"MIN(length(CAST({c} AS VARCHAR))) AS min_length, MAX(length(CAST({c} AS VARCHAR))) AS max_length, "
        f"COUNT(*) > 0 AND COUNT(*) = COUNT({c}) AND COUNT(DISTINCT {c}) >= {sketches.NEAR_UNIQUE} * COUNT(*) AS may_be_key FROM {t}"
        for t, columns in PROFILED.items()
        for c in columns
    )


def _names(s: SparkSession, d: str) -> DataFrame:
    parts = [("customer", "c_name"), ("supplier", "s_name"), ("nation", "n_name"), ("part", "p_name")]
    found = [table(s, d, t).select(F.col(c).alias("name")) for t, c in parts]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def _inventory(s: SparkSession, d: str) -> DataFrame:
    given = {name: table(s, d, name) for name in TABLES}
    for name, df in given.items():
        df.createOrReplaceTempView(name)
    columns = catalog.column_catalog(s, TABLES)
    listing = columns.select("table_name").distinct()
    return inventory.table_inventory(
        listing, inventory.table_column_counts(columns, ["table_name"]), inventory.table_row_counts(given)
    )


def _csv_chunks(s: SparkSession, d: str) -> DataFrame:
    path = scratch_path(s, "chunks")
    table(s, d, "customer").select(*CHUNK_COLUMNS).write.option("escape", '"').csv(path)
    chunks = readers.csv_chunks(s, path, len(CHUNK_COLUMNS))
    return readers.cast_columns(
        readers.name_columns(chunks, CHUNK_COLUMNS), {"c_custkey": "bigint", "c_nationkey": "int", "c_acctbal": "double"}
    )


def _chunk_page(s: SparkSession, d: str) -> DataFrame:
    """A page of a result given as ordered chunks with their counts."""
    path = scratch_path(s, "chunks")
    ordered = table(s, d, "customer").select(*CHUNK_COLUMNS).repartitionByRange(5, "c_custkey").sortWithinPartitions("c_custkey")
    ordered.write.option("escape", '"').csv(path)
    rows = readers.csv_chunks(s, path, CHUNK_COLUMNS).groupBy(F.input_file_name().alias("path")).count().collect()
    chunks = [(i, file, n) for i, (file, n) in enumerate(sorted(tuple(r) for r in rows))]
    page = paging.chunk_page(s, chunks, CHUNK_COLUMNS, 700)
    return readers.cast_columns(page, {"c_custkey": "bigint", "c_nationkey": "int", "c_acctbal": "double"})


def _run_sql(s: SparkSession, d: str) -> DataFrame:
    table(s, d, "orders").createOrReplaceTempView("orders")
    query = """SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS dearest FROM orders
               WHERE o_totalprice > :least GROUP BY o_orderpriority"""
    return readers.run_sql(s, query, {"least": 100000.0})


def _manifest_roundtrip(s: SparkSession, d: str) -> DataFrame:
    path = scratch_path(s, "manifest")
    scan = tagging.scan_columns(_columns(s, d), SKIP)
    tagging.store_manifest(scan, {"output_schema_name": "resolution_outputs"}, path)
    return _semantics_text(manifests.manifest_fields(manifests.read_manifest(s, path)))


def _tag_refs(s: SparkSession, d: str) -> DataFrame:
    ref = F.expr(
        "CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN concat(c_mktsegment, '.', c_name) "
        "ELSE concat('lake.', c_mktsegment, '.', c_name) END"
    )
    refs = table(s, d, "customer").select("c_custkey", ref.alias("ref"))
    return tags.resolve_table_ref(refs, "ref", "main", "public")


def _targets(s: SparkSession, d: str) -> DataFrame:
    target = F.expr(
        "CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN concat('.', c_name) WHEN 2 THEN concat(c_name, '.') "
        "WHEN 3 THEN concat('a.b.', c_name) ELSE concat(c_mktsegment, '.', c_name) END"
    )
    return inventory.parse_targets(table(s, d, "customer").select("c_custkey", target.alias("target")))


def _results(s: SparkSession, d: str) -> DataFrame:
    return _columns(s, d).selectExpr(
        "table_name",
        "column_name",
        "position % 4 <> 0 AS success",
        "CASE WHEN position % 4 = 0 AND position % 8 <> 0 THEN concat('permission denied on ', schema_name) END AS error",
    )


def _tagged_customers(s: SparkSession, d: str) -> DataFrame:
    customer = table(s, d, "customer")
    customer.createOrReplaceTempView("customer")
    rules = pii.classify_columns(catalog.column_catalog(s, ["customer"]))
    known = rules.withColumn("semantic", F.when(F.col("column_name") == "c_name", F.lit("full-name")))
    chosen = known.filter("semantic IS NOT NULL").select(F.col("column_name").alias("column"), "semantic")
    tagged = tags.with_semantics(customer, chosen)
    lines = [
        F.struct(
            F.lit(f.name).alias("column"),
            F.lit(f.metadata.get("semantic")).cast("string").alias("semantic"),
            F.count(f.name).alias("non_null"),
        )
        for f in tagged.schema
    ]
    return tagged.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))


def _nested(s: SparkSession, d: str) -> DataFrame:
    """Tables of one name in several schemas and two catalogues, nested."""
    scan = _kept_answers(s, d)
    pond = scan.filter("position % 3 = 0").withColumn("catalog_name", F.lit("pond"))
    nested = manifest.nest_fields(manifest.manifest_from_scan(scan.unionByName(pond)))
    names = F.array_join(F.col("fields.field-name"), ",")
    return nested.select("catalog_name", "schema_name", "path", F.size("fields").alias("n_fields"), names.alias("names"))


def _listed_chunks(s: SparkSession, d: str) -> DataFrame:
    """Customers as ordered result chunks, read through the planned source: names, numbers and types of a result."""
    path = scratch_path(s, "chunks")
    ordered = table(s, d, "customer").select(*CHUNK_COLUMNS).repartitionByRange(5, "c_custkey").sortWithinPartitions("c_custkey")
    ordered.write.option("escape", '"').csv(path)
    counts = readers.csv_chunks(s, path, CHUNK_COLUMNS).groupBy(F.input_file_name().alias("path")).agg(F.count("*").alias("rows"))
    # Files of a sorted result are named in order.
    number = F.regexp_extract("path", "part-([0-9]+)", 1).cast("long").alias("chunk_index")
    listing = scratch_path(s, "listing")
    counts.select(number, "path", "rows").write.parquet(listing)
    found = planned.read_chunks(s, listing, CHUNK_COLUMNS).drop("chunk_index")
    return readers.cast_columns(found, {"c_custkey": "bigint", "c_nationkey": "int", "c_acctbal": "double"})


def _ranged_orders(s: SparkSession, d: str) -> DataFrame:
    """Orders of a range of keys, through row groups chosen by their footers."""
    listing = scratch_path(s, "groups")
    footers.row_groups(footers.list_files(s, f"{d}/orders.parquet"), "o_orderkey").write.parquet(listing)
    return planned.read_ranges(s, listing, "o_orderkey", table(s, d, "orders").schema).filter("o_orderkey BETWEEN 2000 AND 9000")


def _file_catalog(s: SparkSession, d: str) -> DataFrame:
    """Columns of the given tables, by the footers of all their files."""
    lines = footers.file_columns(footers.list_files(s, d))
    named = lines.withColumn("table_name", F.regexp_extract("path", "([a-z]+)[.]parquet(/|$)", 1))
    merged = footers.merged_columns(named.filter(F.col("table_name").isin(TABLES)))
    return merged.filter("conflict IS NULL").select("table_name", "column_name", "data_type", "position")


def _given_columns(s: SparkSession, d: str) -> DataFrame:
    for name in TABLES:
        table(s, d, name).createOrReplaceTempView(name)
    return catalog.column_catalog(s, TABLES)


def _with_evidence(s: SparkSession, d: str) -> DataFrame:
    """The given tables' columns, classified by name, then by what a hundredth of their values look like."""
    found = content.content_evidence({n: (df, cs) for n in TABLES if (cs := content.text_columns(df := table(s, d, n)))})
    scan = pii.classify_columns(_given_columns(s, d))
    return pii.with_evidence(scan, found, 0.01).select("table_name", "column_name", "semantic")


def _schema_edits(s: SparkSession, d: str) -> DataFrame:
    wanted = _edits(s, d, "exclude_column").withColumn("schema_name", F.lit("s1"))
    return edits.exclude_columns(_scan(s, d), wanted)


def _tag_table(s: SparkSession, d: str) -> TagTable:
    """A tag table of two commits: the tags already stored, then the batch."""
    stored = TagTable(s, scratch_path(s, "tag-table"))
    stored.commit(view(s, d, "tags").drop("updated_at"), F.lit("2024-01-01 00:00:00").cast("timestamp"))
    stored.commit(view(s, d, "tag_batch"), F.lit(AT).cast("timestamp"))
    return stored


def _name_search(s: SparkSession, d: str) -> DataFrame:
    """Suppliers' and parts' names with errors, looked up among all names."""
    wrong = table(s, d, "supplier").selectExpr("replace(s_name, 'u', '') AS target").unionByName(
        table(s, d, "part").filter("p_size < 10").selectExpr("concat(' ', replace(p_name, 'a', 'o'), 'X') AS target")
    )
    return name_index.build_index(_names(s, d)).search(wrong, 0.75)


def _listed_tables(s: SparkSession, d: str) -> DataFrame:
    """The given tables as views of the session, as its catalogue lists them, with their rows."""
    for name in TABLES:
        table(s, d, name).createOrReplaceTempView(f"given_{name}")
    listed = catalog.list_tables(s, pattern="given_*").withColumn("table_name", F.substr("table_name", F.lit(7)))
    counts = inventory.table_row_counts({n: table(s, d, n) for n in TABLES})
    return listed.filter("table_type = 'TEMPORARY'").join(counts, "table_name").select("table_name", "table_type", "row_count")


def _location_check(s: SparkSession, d: str) -> DataFrame:
    """Locations that customers' lines name, most of them wrong, against the schemas of the column catalogue."""
    asked = table(s, d, "customer").selectExpr(
        "CASE c_custkey % 4 WHEN 0 THEN 'lake' WHEN 1 THEN 'LAKE' WHEN 2 THEN c_mktsegment ELSE '' END AS catalog",
        "CASE c_custkey % 5 WHEN 0 THEN 's1' WHEN 1 THEN 'S2' WHEN 2 THEN concat('s', c_nationkey) WHEN 3 THEN c_name END AS schema",
    )
    return inventory.location_report(asked, _columns(s, d).select("catalog_name", "schema_name"))


QUERIES = {
    "listed_tables": _listed_tables,
    "location_check": _location_check,
    "sample_rows": lambda s, d: inventory.sample_rows(table(s, d, "orders"), ["o_orderkey"]),
    "csv_chunk_scan": _csv_chunks,
    "chunk_page": _chunk_page,
    "chunk_source_scan": _listed_chunks,
    "chunk_source_page": lambda s, d: _listed_chunks(s, d).filter("row_number >= 700 AND row_number < 750"),
    "range_source_scan": _ranged_orders,
    "file_catalog": _file_catalog,
    "run_sql": _run_sql,
    "column_catalog": lambda s, d: catalog.read_columns(_columns(s, d), "lake", ["s1", "s2"], view(s, d, "tags")),
    "catalog_columns": lambda s, d: _given_columns(s, d).select("table_name", "column_name", "data_type", "position"),
    "pii_classify_with_evidence": _with_evidence,
    "pii_exclude_column_in_schema": _schema_edits,
    "read_semantic_tags": lambda s, d: catalog.read_tags(view(s, d, "tags"), "lake", "s2"),
    "manifest_roundtrip": _manifest_roundtrip,
    "table_column_counts": lambda s, d: inventory.table_column_counts(_columns(s, d)),
    "table_row_counts": lambda s, d: inventory.table_row_counts({n: table(s, d, n) for n in TABLES}),
    "table_inventory": _inventory,
    "stored_page_after": lambda s, d: paging.store_pages(table(s, d, "orders"), ["o_custkey", "o_orderkey"]).page_after([300, 20000], 200),
    "result_page": lambda s, d: paging.store_pages(table(s, d, "lineitem"), _PAGE_KEY).page(25000),
    "result_page_front": lambda s, d: inventory.result_page(table(s, d, "orders"), ["o_orderkey"], 100),
    "result_page_after": lambda s, d: inventory.page_after(table(s, d, "orders"), "o_orderkey", 7500),
    "name_search": _name_search,
    "fuzzy_name_match": lambda s, d: inventory.fuzzy_name_match(_names(s, d), TARGETS, None),
    "fuzzy_name_score": lambda s, d: inventory.fuzzy_name_match(_names(s, d), ["costumer 12", "gren widgit"]),
    "target_parse": _targets,
    "pii_column_classify": _scan,
    "pii_answer_ingest": _answered,
    "pii_numeric_guard": lambda s, d: pii.numeric_guard(
        _columns(s, d).withColumn("semantic", F.expr("CASE WHEN position % 2 = 0 THEN 'email' END"))
    ),
    "pii_single_pk": lambda s, d: pii.single_pk(_scan(s, d)),
    "pii_table_summary": _summary,
    "pii_schema_rollup": lambda s, d: pii.schema_rollup(_summary(s, d)),
    "pii_location_rollup": lambda s, d: pii.location_rollup(_summary(s, d)),
    "pii_exclude_table": lambda s, d: pii.table_summary(
        edits.exclude_tables(_scan(s, d), _edits(s, d, "exclude_table"))
    ),
    "pii_exclude_table_containing": lambda s, d: pii.table_summary(
        edits.exclude_tables_containing(_scan(s, d), ["T10", "5"])
    ),
    "pii_exclude_column": lambda s, d: edits.exclude_columns(_scan(s, d), _edits(s, d, "exclude_column")),
    "pii_change_semantic": lambda s, d: edits.change_semantics(_scan(s, d), _edits(s, d, "change_semantic")),
    "pii_unmatched_edits": lambda s, d: edits.unmatched_edits(_scan(s, d), view(s, d, "edits")),
    "pii_column_profiles": _profiles,
    "pii_content_evidence": lambda s, d: content.content_evidence(
        {n: (df, found) for n in TABLES if (found := content.text_columns(df := table(s, d, n)))}
    ),
    "pii_text_findings": lambda s, d: content.text_findings(table(s, d, "documents"), "doc_id", "text"),
    "table_profile": lambda s, d: pii.table_profile(_scan(s, d), AT),
    "tag_upsert": lambda s, d: tags.upsert_tags(
        view(s, d, "tags"), view(s, d, "tag_batch"), F.lit(AT).cast("timestamp")
    ),
    "tag_table": lambda s, d: _tag_table(s, d).read(),
    "tag_table_before": lambda s, d: _tag_table(s, d).read(1),
    "tag_upsert_errors": lambda s, d: tags.tag_errors(view(s, d, "tag_batch")),
    "tag_upsert_check": lambda s, d: tags.verify_upsert(
        tags.upsert_tags(view(s, d, "tags"), view(s, d, "tag_batch"), F.lit(AT).cast("timestamp")),
        view(s, d, "tag_batch"),
    ),
    "tag_apply_metadata": _tagged_customers,
    "table_ref_resolve": _tag_refs,
    "tag_outcome_summary": lambda s, d: tags.failure_summary(_results(s, d)),
    "tag_outcomes": lambda s, d: tags.tag_outcomes(_results(s, d)),
    "tag_plan": lambda s, d: tags.tag_plan(_answered(s, d)),
    "type_normalise": lambda s, d: _columns(s, d).select("position", normalise_type(F.col("data_type")).alias("type")),
    "type_normalise_upper": lambda s, d: _columns(s, d).select(
        "position", normalise_type(F.col("data_type"), "redshift", upper=True).alias("type")
    ),
    "type_normalise_strict": lambda s, d: _columns(s, d).select(
        "position", normalise_type(F.col("data_type"), "strict").alias("type")
    ),
    "manifest_unsupported": lambda s, d: manifest.unsupported_fields(_scan(s, d)),
    "manifest_from_scan": lambda s, d: _semantics_text(manifest.manifest_from_scan(_kept_answers(s, d))),
    "manifest_nested": _nested,
    "manifest_from_tags": lambda s, d: _semantics_text(
        manifest.manifest_from_tags(_columns(s, d), view(s, d, "tags"), "lake", "s3")
    ),
    "manifest_multi_schema": lambda s, d: _semantics_text(
        manifest.manifest_multi_schema(_columns(s, d), view(s, d, "tags"))
    ),
    "resolution_config": lambda s, d: _semantics_text(manifest.resolution_config(_kept_answers(s, d))),
    "manifest_validate": lambda s, d: manifest.validate_manifest(view(s, d, "manifests"), RULES)
    .withColumn("errors", F.array_join("errors", "; "))
    .drop("body"),
}

_PAGE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_tax", "l_quantity"]


# ---- SQL ---------------------------------------------------------------------------------------------------

_K = "catalog_name, schema_name, table_name"
_SNAKE = r"lower(regexp_replace(column_name, '([a-z])([A-Z])', '\1_\2', 'g'))"
_BASE_TYPE = r"upper(trim(regexp_extract(data_type, '^[^(<]*')))"
_NUMERIC = f"{_BASE_TYPE} IN ({', '.join(repr(t) for t in NUMERIC_TYPES)})"
_UNSUPPORTED = f"split_part({_BASE_TYPE}, ' ', 1) IN ({', '.join(repr(t) for t in UNSUPPORTED_TYPES)})"
_RULE_CASE = " ".join(f"WHEN regexp_matches({_SNAKE}, '{p}') THEN '{semantic}'" for semantic, p in NAME_PATTERNS)
_ODD = f"[x FOR x IN (doc->>'$[*].semantic') IF x IS NOT NULL AND x <> '' AND x NOT IN ({', '.join(map(repr, SEMANTICS))})]"
_COLUMNS = with_views(["columns"])

_SCAN = f"""{_COLUMNS},
own AS (SELECT * FROM columns WHERE NOT starts_with(table_name, '{SKIP}')),
scan AS (SELECT *, CASE WHEN {_NUMERIC} THEN NULL {_RULE_CASE} END AS semantic FROM own)
"""

_KEYED_SCAN = f"""{_SCAN.replace('scan AS', 'tagged AS')},
scan AS (SELECT * EXCLUDE (place) REPLACE (CASE WHEN semantic = 'pk' AND place > 1 THEN NULL ELSE semantic END AS semantic)
  FROM (SELECT *, row_number() OVER (PARTITION BY {_K}, semantic ORDER BY
    NOT (regexp_matches({_SNAKE}, '{UUID_PATTERN}') OR lower(data_type) = 'uuid'), position) AS place FROM tagged))
"""

_ANSWERED = f"""{with_views(["columns", "answers", "listing"])},
own AS (SELECT * FROM columns WHERE NOT starts_with(table_name, '{SKIP}')),
texts AS (SELECT {_K}, CASE WHEN starts_with(t, '```json') THEN trim(t[8:-4], e' \\n')
    WHEN starts_with(t, '```') THEN trim(t[4:-4], e' \\n') ELSE t END AS t
  FROM (SELECT {_K}, trim(response, e' \\n') AS t FROM answers)),
docs AS (SELECT {_K}, count(*) OVER (PARTITION BY {_K}) AS answers, CASE WHEN json_valid(t) AND json_type(t) = 'ARRAY' THEN CAST(t AS JSON) END AS doc FROM texts),
sizes AS (SELECT {_K}, count(*) AS n FROM own GROUP BY ALL),
checked AS (SELECT sizes.*, doc, CASE WHEN answers > 1 THEN format('{{}} answers for one table', answers)
    WHEN doc IS NULL THEN 'Failed to parse the answer'
    WHEN json_array_length(doc) <> n THEN format('Expected {{}} items, got {{}}', n, json_array_length(doc))
    WHEN len({_ODD}) > 0 THEN format('Unknown semantic ''{{}}''', {_ODD}[1]) END AS error
  FROM sizes LEFT JOIN (SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY {_K}) = 1) USING ({_K})),
entries AS (SELECT {_K}, item->>'$.name' AS column_name, nullif(item->>'$.semantic', '') AS semantic
  FROM (SELECT {_K}, unnest(CAST(doc AS JSON[])) AS item FROM checked WHERE error IS NULL)),
scan AS (SELECT own.*, semantic, error FROM own LEFT JOIN checked USING ({_K})
  LEFT JOIN entries USING ({_K}, column_name)),
summary AS (SELECT {_K}, CAST(coalesce(CASE WHEN error IS NULL THEN n END, 0) AS BIGINT) AS column_count,
    CAST(coalesce(CASE WHEN error IS NULL THEN n_pii END, 0) AS BIGINT) AS pii_column_count,
    error IS NULL AND coalesce(n_pii, 0) > 0 AS has_pii, error
  FROM listing LEFT JOIN (SELECT {_K}, count(*) AS n, count(semantic) AS n_pii, max(error) AS error
                          FROM scan GROUP BY ALL) USING ({_K})
  WHERE NOT starts_with(table_name, '{SKIP}'))
"""

_SUMMARY_OF = f"""SELECT {_K}, count(*) AS column_count, count(semantic) AS pii_column_count,
  count(semantic) > 0 AS has_pii, CAST(NULL AS VARCHAR) AS error FROM changed GROUP BY ALL"""

_EDITS = _SCAN.replace(_COLUMNS, with_views(["columns", "edits"]))


def _edited(action: str, value: str) -> str:
    return f"""{_EDITS},
asked AS (SELECT lower(table_name) AS t, lower(column_name) AS c, {value} AS v FROM edits
          WHERE action = '{action}' AND column_name IS NOT NULL),
hits AS (SELECT position, coalesce(
    (SELECT max(v) FROM asked WHERE t = lower(table_name) AND c = lower(column_name)),
    (SELECT max(v) FROM asked WHERE t IS NULL AND c = lower(column_name))) AS v FROM scan)
"""


def _type_case(texts: list[tuple[str, list[str]]]) -> str:
    branches = [
        "WHEN " + " OR ".join(f"contains(lower(data_type), '{w}')" for w in words) + f" THEN '{short}'"
        for short, words in texts
    ]
    return f"CASE {' '.join(branches)} ELSE 'string' END"


# Texts in type names and the short names they stand for.
_REFERENCE_TYPE = _type_case(
    [
        ("string", ["varchar", "char", "text", "string"]),
        ("long", ["int", "integer", "smallint", "bigint"]),
        ("decimal", ["decimal", "numeric"]),
        ("double", ["float", "double", "real"]),
        ("boolean", ["bool"]),
        ("date", ["date"]),
        ("timestamp", ["timestamp"]),
    ]
)
_REDSHIFT_TYPE = "upper(" + _REFERENCE_TYPE.replace("'string')", "'character')") + ")"

_PII_TABLES = f"""clean AS (SELECT * FROM scan WHERE {_K.split(', ')[0]} IS NOT NULL),
with_pii AS (SELECT * FROM clean WHERE ({_K}) IN (SELECT ({_K}) FROM clean WHERE semantic <> ''))"""
_ANSWERED_PII = f"""{_ANSWERED},
clean AS (SELECT * FROM scan WHERE error IS NULL),
with_pii AS (SELECT * FROM clean WHERE ({_K}) IN (SELECT ({_K}) FROM clean WHERE semantic <> ''))"""

_TAGGED = f"""{with_views(["columns", "tags"])},
joined AS (SELECT c.*, t.semantic_type FROM columns c LEFT JOIN tags t ON c.catalog_name = t.database_name
    AND c.schema_name = t.schema_name AND c.table_name = t.table_name AND c.column_name = t.column_name
  WHERE (c.catalog_name, c.schema_name, c.table_name) IN (SELECT (database_name, schema_name, table_name) FROM tags))"""

_TAG_BASE = f"""{with_views(["columns", "tags", "tag_batch"])},
good AS (SELECT * FROM tag_batch WHERE database_name <> '' AND schema_name <> '' AND table_name <> '' AND column_name <> ''
  AND semantic_type <> ''),
touched AS (SELECT DISTINCT database_name, schema_name, table_name FROM tag_batch
  WHERE database_name <> '' AND schema_name <> '' AND table_name <> ''),
stored AS (SELECT * FROM tags WHERE (database_name, schema_name, table_name) NOT IN (FROM touched SELECT (database_name, schema_name, table_name))
  UNION ALL SELECT database_name, schema_name, table_name, column_name, min(semantic_type), TIMESTAMP '{AT}'
  FROM good GROUP BY 1, 2, 3, 4)"""

_NAMES = """names AS (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier
  UNION ALL SELECT n_name FROM nation UNION ALL SELECT p_name FROM part)"""

_MANIFEST = f"""{with_views(["manifests"])},
docs AS (SELECT manifest_id, CAST(body AS JSON) AS doc FROM manifests),
tabs AS (SELECT manifest_id, unnest(CAST(doc->'$.tables' AS JSON[])) AS tab,
    unnest(range(CAST(json_array_length(doc->'$.tables') AS BIGINT))) AS i
  FROM docs WHERE json_type(doc, '$.tables') = 'ARRAY'),
flds AS (SELECT manifest_id, i, unnest(CAST(tab->'$.fields' AS JSON[])) AS fld,
    unnest(range(CAST(json_array_length(tab->'$.fields') AS BIGINT))) AS j
  FROM tabs WHERE json_type(tab, '$.fields') = 'ARRAY'),
found AS (
  SELECT manifest_id, 1 AS a, 0 AS i, 0 AS j, 0 AS k, 'Missing ''tables''' AS error FROM docs WHERE json_type(doc, '$.tables') IS NULL
  UNION ALL SELECT manifest_id, 2, 0, 0, 0, 'Missing ''settings''' FROM docs WHERE json_type(doc, '$.settings') IS NULL
  UNION ALL SELECT manifest_id, 3, 0, 0, 0, '''tables'' must be a list' FROM docs WHERE json_type(doc, '$.tables') <> 'ARRAY'
  UNION ALL SELECT manifest_id, 4, i, -1, 1, format('Table {{}} missing ''path''', i) FROM tabs WHERE json_type(tab, '$.path') IS NULL
  UNION ALL SELECT manifest_id, 4, i, -1, 2, format('Table {{}} missing ''fields''', i) FROM tabs WHERE json_type(tab, '$.fields') IS NULL
  UNION ALL SELECT manifest_id, 4, i, -1, 3, format('Table {{}} ''fields'' must be a list', i) FROM tabs WHERE json_type(tab, '$.fields') <> 'ARRAY'
  UNION ALL SELECT manifest_id, 4, i, j, 1, format('Table {{}} field {{}} missing ''field-name''', i, j) FROM flds WHERE json_type(fld, '$."field-name"') IS NULL
  UNION ALL SELECT manifest_id, 4, i, j, 2, format('Table {{}} field {{}} missing ''type''', i, j) FROM flds WHERE json_type(fld, '$.type') IS NULL
  UNION ALL SELECT manifest_id, 4, i, j, 3, format('Table {{}} field {{}} missing ''semantics''', i, j) FROM flds WHERE json_type(fld, '$.semantics') IS NULL
  UNION ALL SELECT manifest_id, 4, i, j, 4, format('Table {{}} field {{}} ''semantics'' must be a list', i, j) FROM flds WHERE json_type(fld, '$.semantics') <> 'ARRAY'
  UNION ALL SELECT manifest_id, 5, 0, 0, 1, 'Missing ''output_catalog_name'' in settings' FROM docs
    WHERE json_type(doc, '$.settings') IS NOT NULL AND json_type(doc, '$.settings.output_catalog_name') IS NULL
  UNION ALL SELECT manifest_id, 5, 0, 0, 2, 'Missing ''output_schema_name'' in settings' FROM docs
    WHERE json_type(doc, '$.settings') IS NOT NULL AND json_type(doc, '$.settings.output_schema_name') IS NULL)"""


def _evidence_sql() -> str:
    parts = []
    for name, columns in TEXT_COLUMNS.items():
        for column in columns:
            for kind, shape in VALUE_PATTERNS.items():
                parts.append(
                    f"SELECT '{name}' AS table_name, '{column}' AS column_name, '{kind}' AS pattern, "
                    f"count({column}) AS non_null, "
                    f"CAST(coalesce(sum(CASE WHEN regexp_matches({column}, '{shape}') THEN 1 ELSE 0 END), 0) AS BIGINT) "
                    f"AS matches FROM {name}"
                )
    return f"SELECT *, round(CAST(matches AS DOUBLE) / non_null, 6) AS share FROM ({' UNION ALL '.join(parts)})"


_ANY = "|".join(f"(?:{p})" for p in VALUE_PATTERNS.values())
_KIND_CASE = " ".join(f"WHEN regexp_full_match(value, '{p}') THEN '{k}'" for k, p in VALUE_PATTERNS.items())
_ROW_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES)

_TYPE_NAMES = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "TIMESTAMP": "timestamp_ntz", "FLOAT[]": "array<float>"}
_TYPE_NAME = f"CASE data_type {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in _TYPE_NAMES.items())} END"
#: Other tables and schemas may be registered beside the given tables.
_GIVEN_COLUMNS = f"""(SELECT DISTINCT table_name, column_name, data_type, column_index FROM duckdb_columns()
  WHERE NOT internal AND schema_name = 'main' AND table_name IN {tuple(TABLES)})"""
_GIVEN = f"""SELECT table_name, column_name, {_TYPE_NAME} AS data_type, CAST(column_index - 1 AS BIGINT) AS position
  FROM {_GIVEN_COLUMNS}"""

ORACLES = {
    "listed_tables": f"SELECT table_name, 'TEMPORARY' AS table_type, row_count FROM ({_ROW_COUNTS})",
    "location_check": f"""{_COLUMNS}, asked AS (SELECT
    CASE c_custkey % 4 WHEN 0 THEN 'lake' WHEN 1 THEN 'LAKE' WHEN 2 THEN c_mktsegment ELSE '' END AS catalog,
    CASE c_custkey % 5 WHEN 0 THEN 's1' WHEN 1 THEN 'S2' WHEN 2 THEN concat('s', c_nationkey) WHEN 3 THEN c_name END AS schema FROM customer),
judged AS (SELECT *, coalesce(catalog <> '' AND schema <> '', false) AS complete,
    EXISTS (SELECT 1 FROM columns c WHERE lower(c.catalog_name) = lower(catalog) AND lower(c.schema_name) = lower(schema)) AS found FROM asked)
SELECT catalog, schema, complete AND found AS accessible, CASE WHEN NOT complete THEN 'Missing catalog or schema'
  WHEN NOT found THEN concat('Schema ', catalog, '.', schema, ' not found') END AS error FROM judged""",
    "sample_rows": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10",
    "csv_chunk_scan": f"SELECT {', '.join(CHUNK_COLUMNS)} FROM customer",
    "chunk_page": f"SELECT {', '.join(CHUNK_COLUMNS)} FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 700",
    "run_sql": "SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS dearest FROM orders "
    "WHERE o_totalprice > 100000 GROUP BY 1",
    "column_catalog": f"{with_views(['columns', 'tags'])} SELECT * FROM columns WHERE catalog_name = 'lake' AND "
    "schema_name IN ('s1', 's2') AND (schema_name, table_name) IN (SELECT (schema_name, table_name) FROM tags)",
    "chunk_source_scan": f"SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_number, {', '.join(CHUNK_COLUMNS)} FROM customer",
    "chunk_source_page": f"""SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_number, {', '.join(CHUNK_COLUMNS)} FROM customer
ORDER BY c_custkey LIMIT 50 OFFSET 700""",
    "range_source_scan": "SELECT * FROM orders WHERE o_orderkey BETWEEN 2000 AND 9000",
    "file_catalog": _GIVEN,
    "catalog_columns": _GIVEN,
    "pii_classify_with_evidence": f"""WITH given AS ({_GIVEN}), named AS (SELECT table_name, column_name,
  CASE WHEN {_NUMERIC} THEN NULL {_RULE_CASE} END AS semantic FROM given),
seen AS (SELECT table_name, column_name, arg_max(pattern, (share, pattern)) AS kind FROM ({_evidence_sql()})
  WHERE pattern IN ('email', 'phone') AND share >= 0.01 GROUP BY ALL)
SELECT table_name, column_name, coalesce(semantic, kind) AS semantic FROM named LEFT JOIN seen USING (table_name, column_name)""",
    "pii_exclude_column_in_schema": f"""{_edited('exclude_column', '1')} SELECT scan.* REPLACE
  (CASE WHEN v IS NULL OR schema_name <> 's1' THEN semantic END AS semantic) FROM scan JOIN hits USING (position)""",
    "read_semantic_tags": f"{with_views(['tags'])} SELECT table_name AS \"table\", column_name AS \"column\", "
    "semantic_type AS semantic FROM tags WHERE database_name = 'lake' AND schema_name = 's2'",
    "table_column_counts": f"{_COLUMNS} SELECT {_K}, count(DISTINCT column_name) AS column_count FROM columns GROUP BY ALL",
    "table_row_counts": _ROW_COUNTS,
    "table_inventory": f"SELECT r.table_name, CAST(c.n AS BIGINT) AS column_count, row_count, "
    f"CAST(row_count AS VARCHAR) AS row_count_text FROM ({_ROW_COUNTS}) r JOIN (SELECT table_name, count(*) AS n "
    f"FROM {_GIVEN_COLUMNS} GROUP BY 1) c ON r.table_name = c.table_name",
    "stored_page_after": "SELECT * FROM orders WHERE (o_custkey, o_orderkey) > (300, 20000) ORDER BY o_custkey, o_orderkey LIMIT 200",
    "result_page": f"SELECT * FROM lineitem ORDER BY {', '.join(_PAGE_KEY)} LIMIT 50 OFFSET 25000",
    "result_page_front": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100",
    "result_page_after": "SELECT * FROM orders WHERE o_orderkey > 7500 ORDER BY o_orderkey LIMIT 50",
    "name_search": f"""WITH {_NAMES}, wanted AS (SELECT replace(s_name, 'u', '') AS target FROM supplier
  UNION SELECT concat(' ', replace(p_name, 'a', 'o'), 'X') FROM part WHERE p_size < 10),
folded AS (SELECT lower(trim(name)) AS c, min(name) AS name FROM names GROUP BY 1),
scored AS (SELECT target, name, 1 - CAST(levenshtein(lower(trim(target)), c) AS DOUBLE) / greatest(length(trim(target)), length(c)) AS score
  FROM wanted JOIN folded ON abs(length(trim(target)) - length(c)) <= 0.25 * greatest(length(trim(target)), length(c)))
SELECT * FROM scored WHERE score >= 0.75 QUALIFY row_number() OVER (PARTITION BY target ORDER BY score DESC, name) = 1""",
    "fuzzy_name_match": f"""WITH {_NAMES}, wanted AS (SELECT unnest({TARGETS!r}) AS target),
ranked AS (SELECT target, name, CASE WHEN lower(trim(name)) = lower(trim(target)) THEN 'equal'
    WHEN contains(lower(name), lower(target)) THEN 'contains' END AS match FROM wanted, names)
SELECT target, name, match, CAST(1 AS DOUBLE) AS score FROM ranked WHERE match IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY target ORDER BY match DESC, name) = 1""",
    "target_parse": """WITH t AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN c_name WHEN 1 THEN concat('.', c_name)
    WHEN 2 THEN concat(c_name, '.') WHEN 3 THEN concat('a.b.', c_name) ELSE concat(c_mktsegment, '.', c_name) END AS target
  FROM customer), p AS (SELECT *, regexp_full_match(target, '[^.]+[.][^.]+') AS good FROM t)
SELECT c_custkey, target, CASE WHEN good THEN split_part(target, '.', 1) END AS catalog,
  CASE WHEN good THEN split_part(target, '.', 2) END AS schema,
  CASE WHEN NOT good THEN concat('Invalid target format: ''', target, '''. Expected ''catalog.schema''') END AS error
FROM p""",
    "pii_column_classify": f"{_SCAN} SELECT * FROM scan",
    "pii_answer_ingest": f"{_ANSWERED} SELECT * FROM scan",
    "pii_numeric_guard": f"{_COLUMNS} SELECT *, CASE WHEN position % 2 = 0 AND NOT {_NUMERIC} THEN 'email' END AS semantic "
    "FROM columns",
    "pii_single_pk": f"{_KEYED_SCAN} SELECT * FROM scan",
    "pii_table_summary": f"{_ANSWERED} SELECT * FROM summary",
    "pii_schema_rollup": f"""{_ANSWERED} SELECT catalog_name, schema_name, count(*) AS tables_scanned_attempted,
  count(*) FILTER (error IS NULL) AS tables_successfully_processed, count(*) FILTER (has_pii) AS tables_with_pii,
  CAST(sum(pii_column_count) AS BIGINT) AS total_pii_columns FROM summary GROUP BY ALL""",
    "pii_location_rollup": f"""{_ANSWERED} SELECT concat(catalog_name, '.', schema_name) AS location, 'success' AS status,
  count(*) FILTER (has_pii) AS tables, CAST(sum(CASE WHEN has_pii THEN column_count ELSE 0 END) AS BIGINT) AS columns,
  CAST(sum(CASE WHEN has_pii THEN pii_column_count ELSE 0 END) AS BIGINT) AS pii_columns FROM summary
  GROUP BY catalog_name, schema_name""",
    "pii_exclude_table": f"""{_EDITS}, changed AS (SELECT * REPLACE (CASE WHEN lower(table_name) IN (SELECT lower(table_name)
  FROM edits WHERE action = 'exclude_table' AND table_name IS NOT NULL) THEN NULL ELSE semantic END AS semantic) FROM scan)
{_SUMMARY_OF}""",
    "pii_exclude_table_containing": f"""{_SCAN}, changed AS (SELECT * REPLACE (CASE WHEN contains(table_name, 't10')
  OR contains(table_name, '5') THEN NULL ELSE semantic END AS semantic) FROM scan) {_SUMMARY_OF}""",
    "pii_exclude_column": f"""{_edited('exclude_column', '1')} SELECT scan.* REPLACE
  (CASE WHEN v IS NULL THEN semantic END AS semantic) FROM scan JOIN hits USING (position)""",
    "pii_change_semantic": f"""{_edited('change_semantic', 'new_semantic')} SELECT scan.* REPLACE
  (CASE WHEN semantic IS NOT NULL THEN coalesce(v, semantic) END AS semantic) FROM scan JOIN hits USING (position)""",
    "pii_unmatched_edits": f"""{_EDITS},
has AS (SELECT lower(table_name) AS t, lower(column_name) AS c FROM scan WHERE semantic IS NOT NULL),
judged AS (SELECT *, CASE
  WHEN action = 'exclude_table' AND table_name IS NULL THEN 'No table specified'
  WHEN action = 'exclude_table' AND lower(table_name) NOT IN (SELECT lower(table_name) FROM scan)
    THEN concat('Table ''', table_name, ''' not found')
  WHEN action <> 'exclude_table' AND column_name IS NULL THEN 'No column specified'
  WHEN action <> 'exclude_table' AND table_name IS NULL AND lower(column_name) NOT IN (SELECT c FROM has)
    THEN concat('Column ''', column_name, ''' not found in PII results')
  WHEN action <> 'exclude_table' AND table_name IS NOT NULL
    AND (lower(table_name), lower(column_name)) NOT IN (SELECT (t, c) FROM has)
    THEN concat('Column ''', column_name, ''' not found in PII results') END AS reason FROM edits)
SELECT * FROM judged WHERE reason IS NOT NULL""",
    "pii_column_profiles": _profiles_sql(),
    "pii_content_evidence": _evidence_sql(),
    "pii_text_findings": f"""SELECT doc_id, CASE {_KIND_CASE} END AS kind, value, count(*) AS hits
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{_ANY}')) AS value FROM documents) GROUP BY ALL""",
    "table_profile": f"""{_SCAN} SELECT {_K}, CAST(to_json({{'table': {{'catalog_name': catalog_name, 'schema_name': schema_name,
    'table_name': table_name}}, 'schema': list({{'name': column_name, 'type': data_type}} ORDER BY position),
  'pii_tags': coalesce(list({{'name': column_name, 'semantic': semantic}} ORDER BY position) FILTER (semantic IS NOT NULL), []),
  'profiling_timestamp': '{AT}'}}) AS VARCHAR) AS profile FROM scan GROUP BY {_K}""",
    "tag_upsert": f"{_TAG_BASE} SELECT * FROM stored",
    "tag_table": f"{_TAG_BASE} SELECT * FROM stored",
    "tag_table_before": f"{with_views(['tags'])} SELECT * FROM tags",
    "tag_upsert_errors": f"""{_TAG_BASE} SELECT *, CASE WHEN table_name <> '' AND column_name <> '' AND semantic_type <> ''
    THEN 'Missing database or schema' ELSE 'Missing table, column, or semantic_type' END AS error FROM tag_batch
  WHERE NOT coalesce(database_name <> '' AND schema_name <> '' AND table_name <> '' AND column_name <> '' AND semantic_type <> '', FALSE)
UNION ALL SELECT good.*, 'Column tagged twice in one batch' FROM good JOIN (SELECT * EXCLUDE (semantic_type),
  min(semantic_type) AS kept FROM good GROUP BY ALL) USING (database_name, schema_name, table_name, column_name)
  WHERE semantic_type <> kept""",
    "tag_upsert_check": f"""{_TAG_BASE}, n AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (semantic_type) FROM good))
  AS expected, (SELECT count(*) FROM stored WHERE (database_name, schema_name, table_name) IN
  (FROM touched SELECT (database_name, schema_name, table_name))) AS actual) SELECT *, expected = actual AS success FROM n""",
    "tag_apply_metadata": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {semantic} AS semantic, count({c}) AS non_null FROM customer"
        for c, semantic in [("c_custkey", "NULL"), ("c_name", "'full-name'"), ("c_nationkey", "NULL"), ("c_acctbal", "NULL"), ("c_mktsegment", "NULL")]
    ),
    "table_ref_resolve": """WITH r AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name
    WHEN 1 THEN concat(c_mktsegment, '.', c_name) ELSE concat('lake.', c_mktsegment, '.', c_name) END AS ref,
    CASE WHEN c_custkey % 3 = 2 THEN 'lake' ELSE 'main' END AS database_name,
    CASE WHEN c_custkey % 3 = 0 THEN 'public' ELSE c_mktsegment END AS schema_name, c_name AS table_name FROM customer)
SELECT * FROM r""",
    "tag_outcome_summary": f"""{_COLUMNS}, f AS (SELECT CASE WHEN position % 8 <> 0
    THEN concat('permission denied on ', schema_name) ELSE 'Unknown error' END AS error, count(*) AS columns
  FROM columns WHERE position % 4 = 0 GROUP BY 1)
SELECT *, format('{{}} column(s) failed due to: {{}}', columns, error) AS message FROM f""",
    "tag_outcomes": f"""{_COLUMNS} SELECT table_name, count(*) FILTER (position % 4 <> 0) AS tagged,
  count(*) FILTER (position % 4 = 0) AS failed FROM columns GROUP BY 1""",
    "tag_plan": f"""{_ANSWERED} SELECT catalog_name AS database_name, schema_name, table_name, column_name,
  semantic AS semantic_type FROM scan WHERE error IS NULL AND semantic IS NOT NULL""",
    "type_normalise": f"{_COLUMNS} SELECT position, {_REFERENCE_TYPE} AS type FROM columns",
    "type_normalise_upper": f"{_COLUMNS} SELECT position, {_REDSHIFT_TYPE} AS type FROM columns",
    "type_normalise_strict": f"""{_COLUMNS} SELECT position, CASE {_BASE_TYPE} WHEN 'BIGINT' THEN 'long'
  WHEN 'DECIMAL' THEN 'decimal' WHEN 'NUMBER' THEN 'decimal' WHEN 'DATETIME' THEN 'timestamp'
  WHEN 'TIMESTAMP' THEN 'timestamp' ELSE 'string' END AS type FROM columns""",
    "manifest_unsupported": f"""{_SCAN}, {_PII_TABLES} SELECT concat_ws('.', {_K}) AS path, column_name, data_type AS type,
  semantic FROM with_pii WHERE {_UNSUPPORTED}""",
    "manifest_roundtrip": f"""{_KEYED_SCAN}, {_PII_TABLES} SELECT concat_ws('.', {_K}) AS path,
  CAST(row_number() OVER (PARTITION BY {_K} ORDER BY position) - 1 AS INTEGER) AS position, column_name AS field_name,
  data_type AS type, CASE WHEN {_NUMERIC} THEN '' ELSE coalesce(semantic, '') END AS semantics
  FROM with_pii WHERE NOT {_UNSUPPORTED}""",
    "manifest_nested": f"""{_ANSWERED}, both_lakes AS (SELECT * FROM scan UNION ALL
  SELECT * REPLACE ('pond' AS catalog_name) FROM scan WHERE position % 3 = 0),
clean AS (SELECT * FROM both_lakes WHERE error IS NULL)
SELECT catalog_name, schema_name, table_name AS path, CAST(count(*) AS INTEGER) AS n_fields,
  string_agg(column_name, ',' ORDER BY position) AS names FROM clean
WHERE ({_K}) IN (SELECT ({_K}) FROM clean WHERE semantic <> '') GROUP BY ALL""",
    "manifest_from_scan": f"""{_ANSWERED_PII} SELECT table_name AS path, catalog_name, schema_name, position, column_name AS field_name,
  {_REFERENCE_TYPE} AS type, coalesce(semantic || ',pii', '') AS semantics FROM with_pii""",
    "manifest_from_tags": f"""{_TAGGED} SELECT table_name AS path, position, column_name AS field_name,
  {_REDSHIFT_TYPE} AS type, coalesce(semantic_type, '') AS semantics FROM joined WHERE schema_name = 's3'""",
    "manifest_multi_schema": f"""{_TAGGED} SELECT concat(schema_name, '.', table_name) AS path, catalog_name, position,
  column_name AS field_name, {_REFERENCE_TYPE} AS type, coalesce(semantic_type || ',pii', '') AS semantics FROM joined""",
    "resolution_config": f"""{_ANSWERED_PII} SELECT concat_ws('.', {_K}) AS path, position, column_name AS field_name,
  data_type AS type, CASE WHEN {_NUMERIC} THEN '' ELSE coalesce(semantic, '') END AS semantics
  FROM with_pii WHERE NOT {_UNSUPPORTED}""",
    "manifest_validate": f"""{_MANIFEST},
listed AS (SELECT manifest_id, string_agg(error, '; ' ORDER BY a, i, j, k) AS errors, count(*) AS n,
    arg_min(error, (a, i, j, k)) AS first_error FROM found GROUP BY 1)
SELECT docs.manifest_id, n IS NULL AS valid, first_error, coalesce(n, 0) AS error_count, coalesce(errors, '') AS errors
FROM docs LEFT JOIN listed ON docs.manifest_id = listed.manifest_id""",
}
