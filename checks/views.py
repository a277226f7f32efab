"""Views over the given tables. Each is one SQL text that Spark and DuckDB both accept."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Schemas of the given tables, stated so that no job has to read file footers to find them.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}
TABLES = list(SCHEMAS)

# Records of six sources with the entity each belongs to.
UNIFIED = """
SELECT concat('E', CAST(c_custkey AS STRING)) AS entity_id, 'crm' AS datasource,
  concat('crm-', CAST(c_custkey AS STRING)) AS pk,
  c_name AS given_name, c_mktsegment AS surname,
  CASE WHEN c_custkey % 2 = 0 THEN concat('u', CAST(c_custkey AS STRING), '@example.com') END AS email,
  CAST(NULL AS STRING) AS phone,
  CASE WHEN c_acctbal > 0 THEN concat('nation-', CAST(c_nationkey AS STRING)) END AS address,
  CAST(NULL AS STRING) AS birthdate
FROM customer
UNION ALL
SELECT concat('E', CAST(o_custkey AS STRING)), concat('orders_', o_orderstatus),
  concat('ord-', CAST(o_orderkey AS STRING)), CAST(NULL AS STRING), CAST(NULL AS STRING),
  CASE WHEN o_orderkey % 3 = 0 THEN concat('u', CAST(o_custkey AS STRING), '@example.com') END,
  CASE WHEN o_orderpriority = '1-URGENT' THEN concat('555-', CAST(o_custkey AS STRING)) END,
  CASE WHEN o_orderkey % 5 = 0 THEN concat('ship-', CAST(o_custkey AS STRING)) END,
  CAST(NULL AS STRING)
FROM orders
UNION ALL
SELECT concat('E', CAST(user_id AS STRING)), 'web', concat('evt-', CAST(event_id AS STRING)),
  CAST(NULL AS STRING), CAST(NULL AS STRING),
  CASE WHEN event_type = 'signup' THEN concat('u', CAST(user_id AS STRING), '@example.com') END,
  CAST(NULL AS STRING), CAST(NULL AS STRING),
  CASE WHEN event_type = 'purchase' THEN '1990-01-01' END
FROM events WHERE event_type IN ('signup', 'purchase')
UNION ALL
SELECT concat('S', CAST(s_suppkey AS STRING)), 'vendor', concat('sup-', CAST(s_suppkey AS STRING)),
  s_name, CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING),
  CAST(NULL AS STRING)
FROM supplier
"""

# Job observations: every event is one look at the job of its user.
RUNS = """
SELECT concat('job-', CAST(user_id AS STRING)) AS job_id, concat('run-', CAST(event_id AS STRING)) AS run_id,
  event_id AS obs_id, ts AS seen_at,
  CASE event_type WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED'
                  WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'PENDING' END AS state,
  CASE WHEN event_id % 4 = 0 THEN 'not a time' ELSE CAST(ts AS STRING) END AS created_at,
  CASE WHEN event_id % 3 = 0 THEN CAST(ts AS STRING) END AS start_time,
  CASE WHEN event_type IN ('purchase', 'error') THEN ts + INTERVAL '65' SECOND END AS end_at,
  CASE WHEN event_type = 'purchase' THEN event_id END AS record_count,
  CASE WHEN event_type = 'purchase' THEN value END AS credits
FROM events
"""

# A column catalogue: every customer is a table (equal names in five schemas), every order one of its columns.
COLUMNS = """
SELECT 'lake' AS catalog_name, concat('s', CAST(o_custkey % 5 AS STRING)) AS schema_name,
  concat(CASE WHEN o_custkey % 40 = 39 THEN '_resolved_t' ELSE 't' END,
         CAST(o_custkey - o_custkey % 5 AS STRING)) AS table_name,
  concat(CASE o_orderkey % 29
    WHEN 0 THEN 'email' WHEN 1 THEN 'first_name' WHEN 2 THEN 'lastName' WHEN 3 THEN 'phone_number'
    WHEN 4 THEN 'street_address' WHEN 5 THEN 'address_line2' WHEN 6 THEN 'city' WHEN 7 THEN 'state'
    WHEN 8 THEN 'zip_code' WHEN 9 THEN 'country' WHEN 10 THEN 'date_of_birth' WHEN 11 THEN 'gender'
    WHEN 12 THEN 'salutation' WHEN 13 THEN 'suffix' WHEN 14 THEN 'full_name' WHEN 15 THEN 'created_at'
    WHEN 16 THEN 'updatedAt' WHEN 17 THEN 'customer_uuid' WHEN 18 THEN 'customer_id' WHEN 19 THEN 'work_email'
    WHEN 20 THEN 'amount' WHEN 21 THEN 'note' WHEN 22 THEN 'score' WHEN 23 THEN 'payload'
    WHEN 24 THEN 'location' WHEN 25 THEN 'mobile' WHEN 26 THEN 'account_id' ELSE 'attribute' END,
    '_', CAST(o_orderkey AS STRING)) AS column_name,
  CASE WHEN o_orderkey % 7 = 0 THEN 'DECIMAL(10,2)' WHEN o_orderkey % 11 = 0 THEN 'NUMBER(38,0)'
    WHEN o_orderkey % 13 = 0 THEN 'ARRAY<STRING>' WHEN o_orderkey % 17 = 0 THEN 'interval'
    WHEN o_orderkey % 19 = 0 THEN 'datetime' WHEN o_orderkey % 23 = 0 THEN 'GEOGRAPHY'
    WHEN o_orderkey % 5 = 0 THEN 'varchar(20)' WHEN o_orderkey % 4 = 1 THEN 'timestamp'
    WHEN o_orderkey % 37 = 0 THEN 'bigint' ELSE 'string' END AS data_type,
  o_orderkey AS position
FROM orders
"""

# The tables of that catalogue, also those without a single column.
LISTING = """
SELECT 'lake' AS catalog_name, concat('s', CAST(c_custkey % 5 AS STRING)) AS schema_name,
  concat(CASE WHEN c_custkey % 40 = 39 THEN '_resolved_t' ELSE 't' END,
         CAST(c_custkey - c_custkey % 5 AS STRING)) AS table_name,
  c_mktsegment AS table_type
FROM customer
"""

# What a model answered for each table, as text: right, fenced, cut short, with an item missing, no list, with a semantic
# that does not exist, or twice.
ANSWERS = """
SELECT catalog_name, schema_name, table_name,
  CASE k % 9 WHEN 1 THEN concat('```json', chr(10), body, chr(10), '```') WHEN 2 THEN concat('```', body, '```')
    WHEN 3 THEN substr(body, 1, length(body) - 4) WHEN 4 THEN concat('[', item, ']')
    WHEN 5 THEN concat('{"columns":', body, '}') ELSE concat('  ', body, chr(10)) END AS response
FROM (
  SELECT 'lake' AS catalog_name, concat('s', CAST(o_custkey % 5 AS STRING)) AS schema_name,
    concat(CASE WHEN o_custkey % 40 = 39 THEN '_resolved_t' ELSE 't' END,
           CAST(o_custkey - o_custkey % 5 AS STRING)) AS table_name,
    o_custkey AS k, min(item) AS item, concat('[', listagg(item, ', '), ']') AS body
  FROM (
    SELECT o_custkey, concat('{"name": "', column_name, '", "semantic": ', CASE WHEN o_orderkey % 211 = 5
      THEN '"nickname"' ELSE CASE o_orderkey % 6 WHEN 0 THEN '"email"' WHEN 1 THEN '"phone"'
        WHEN 2 THEN '"given-name"' WHEN 3 THEN '""' ELSE 'null' END END,
      '}') AS item
    FROM orders JOIN columns ON position = o_orderkey
  ) AS items
  GROUP BY o_custkey
) AS tables
UNION ALL SELECT 'lake', concat('s', CAST(c_custkey % 5 AS STRING)),
  concat(CASE WHEN c_custkey % 40 = 39 THEN '_resolved_t' ELSE 't' END, CAST(c_custkey - c_custkey % 5 AS STRING)), '[]'
FROM customer WHERE c_custkey % 53 = 1
"""

# Semantic tags already stored.
TAGS = """
SELECT 'lake' AS database_name, schema_name, table_name, column_name,
  CASE position % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'phone' WHEN 2 THEN 'surname' ELSE 'address' END
    AS semantic_type,
  CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS updated_at
FROM columns WHERE data_type IN ('string', 'varchar(20)')
"""

# Tags to store: some lack a field, some columns are tagged twice. Positions of these columns are 1 more than a multiple
# of 4, and no multiples of 5, 7, 11, 13, 17, 19 or 23.
TAG_BATCH = """
SELECT CASE WHEN position % 31 = 1 THEN CAST(NULL AS STRING) ELSE 'lake' END AS database_name,
  CASE WHEN position % 37 = 2 THEN '' ELSE schema_name END AS schema_name,
  CASE WHEN position % 41 = 3 THEN CAST(NULL AS STRING) ELSE table_name END AS table_name,
  CASE WHEN position % 9 = 0 THEN CAST(NULL AS STRING) ELSE column_name END AS column_name,
  CASE WHEN position % 27 = 3 THEN '' WHEN position % 3 = 1 THEN 'email' ELSE 'full-name' END AS semantic_type
FROM columns WHERE data_type = 'timestamp'
UNION ALL SELECT 'lake', schema_name, table_name, column_name, 'surname'
FROM columns WHERE data_type = 'timestamp' AND position % 29 = 1
"""

# Requests to change a scan result: exclude a table, exclude a column, change a semantic.
EDITS = """
SELECT CASE WHEN o_totalprice > 480000 THEN 'exclude_table' WHEN o_orderpriority < '3' THEN 'exclude_column'
    ELSE 'change_semantic' END AS action,
  CASE WHEN o_orderkey % 4 = 1 THEN CAST(NULL AS STRING) WHEN o_orderkey % 50 = 8 THEN 'nowhere'
    ELSE upper(table_name) END AS table_name,
  CASE WHEN o_totalprice > 480000 THEN CAST(NULL AS STRING) WHEN o_orderkey % 8 = 7 THEN concat(column_name, '_x')
    ELSE upper(column_name) END AS column_name,
  CASE WHEN o_totalprice <= 480000 AND o_orderpriority >= '3' THEN 'title' END AS new_semantic
FROM orders JOIN columns ON position = o_orderkey
"""

# Manifests as JSON text, one per customer, some of them broken in one or more places.
MANIFESTS = """
SELECT c_custkey AS manifest_id, concat('{"tables": ', tables, settings, '}') AS body
FROM (
  SELECT c_custkey,
    CASE c_custkey % 12 WHEN 0 THEN '{}' WHEN 1 THEN '[]' ELSE concat('[{',
      CASE WHEN c_custkey % 10 = 7 THEN '' ELSE concat('"path": "t', CAST(c_custkey AS STRING), '", ') END,
      '"fields": ', CASE WHEN c_custkey % 14 = 9 THEN '"none"' ELSE concat('[{"field-name": "', c_name,
        '", "type": "string", "semantics": ', CASE WHEN c_custkey % 6 = 3 THEN '"email"' ELSE '["email", "pii"]' END,
        '}, {', CASE WHEN c_custkey % 16 = 5 THEN '' ELSE '"field-name": "balance", ' END,
        CASE WHEN c_custkey % 18 = 11 THEN '' ELSE '"type": "double", ' END, '"semantics": []}]') END,
      '}]') END AS tables,
    CASE WHEN c_custkey % 20 = 13 THEN '' ELSE concat(', "settings": {',
      CASE WHEN c_custkey % 15 = 2 THEN '' ELSE '"output_catalog_name": "lake", ' END,
      '"output_schema_name": "out"}') END AS settings
  FROM customer
) AS parts
"""

VIEWS = {
    "unified": UNIFIED,
    "runs": RUNS,
    "columns": COLUMNS,
    "listing": LISTING,
    "answers": ANSWERS,
    "tags": TAGS,
    "tag_batch": TAG_BATCH,
    "edits": EDITS,
    "manifests": MANIFESTS,
}

# Views each view reads.
USES = {"answers": ["columns"], "tags": ["columns"], "tag_batch": ["columns"], "edits": ["columns"]}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def _needed(names: list[str]) -> list[str]:
    """The named views and those they read, in the order they have to be stated."""
    found: list[str] = []
    for name in names:
        found += [part for part in [*USES.get(name, []), name] if part not in found]
    return found


def with_views(names: list[str]) -> str:
    """A WITH clause holding the named views; the given tables must be registered under their own names."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _needed(names))


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A view over the given tables below ``folder``."""
    text = " ".join(VIEWS[n] for n in _needed([name]))
    for given in TABLES:
        if re.search(rf"\b{given}\b", text):
            table(spark, folder, given).createOrReplaceTempView(given)
    return spark.sql(f"{with_views([name])}\nSELECT * FROM {name}")
