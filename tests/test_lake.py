from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from kinweave.functions.patterns import NAME_RULES, SEMANTICS
from kinweave.functions.types import is_numeric, is_unsupported, normalise_type
from kinweave.operators import content, edits, inventory, manifest, pii, tags
from kinweave.plans import tagging
from kinweave.sources import catalog, manifests, paging, readers

COLUMNS = "catalog_name string, schema_name string, table_name string, column_name string, data_type string, position bigint"
KEYS = "catalog_name string, schema_name string, table_name string"

LAKE = [
    ("users", "id", "bigint"),
    ("users", "email", "string"),
    ("users", "full_name", "string"),
    ("users", "phone", "string"),
    ("customers", "customer_id", "string"),
    ("customers", "customer_uuid", "string"),
    ("customers", "street_address", "varchar(10)"),
    ("customers", "city", "string"),
    ("customers", "tags", "ARRAY<STRING>"),
    ("logs", "amount", "DECIMAL(10,2)"),
    ("logs", "message", "string"),
    ("_resolved_temp", "email", "string"),
    ("geo", "email", "GEOGRAPHY"),
]


def lake(spark, entries=LAKE, schema="public"):
    data = [("dev", schema, t, c, k, i) for i, (t, c, k) in enumerate(entries)]
    return spark.createDataFrame(data, COLUMNS)


@pytest.fixture(scope="module")
def scan(spark):
    return pii.classify_columns(pii.skip_tables(lake(spark), "_resolved"))


def semantics(df):
    return {(r.table_name, r.column_name): r.semantic for r in df.collect()}


# ---- types ----


@pytest.mark.parametrize(
    "name, reference, strict",
    [
        ("interval", "long", "string"),
        ("point", "long", "string"),
        ("datetime", "date", "timestamp"),
        ("NUMBER(38,0)", "string", "decimal"),
        ("DECIMAL(10,2)", "decimal", "decimal"),
        ("character varying(10)", "string", "string"),
        ("BIGINT", "long", "long"),
        ("Boolean", "boolean", "boolean"),
        ("real", "double", "double"),
        ("timestamp", "timestamp", "timestamp"),
        ("super", "string", "string"),
    ],
)
def test_type_modes(spark, name, reference, strict):
    df = spark.createDataFrame([(name,)], "t string")
    got = df.select(normalise_type(F.col("t")), normalise_type(F.col("t"), "strict"), normalise_type(F.col("t"), "redshift", True))
    assert got.first()[:] == (reference, strict, reference.upper())


def test_type_mode_is_checked(spark):
    with pytest.raises(ValueError):
        normalise_type(F.col("t"), "other")


def test_type_groups_go_by_base_type(spark):
    names = ["DECIMAL(10,2)", "ARRAY<STRING>", "interval day to second", "struct<a:int>", "string", None]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    got = [tuple(r) for r in df.select(is_numeric(F.col("t")), is_unsupported(F.col("t"))).collect()]
    assert got == [(True, False), (False, True), (False, True), (False, True), (False, False), (False, False)]


# ---- classification ----


def test_rules_use_known_semantics():
    assert {r.semantic for r in NAME_RULES} == set(SEMANTICS)


def test_classify(scan):
    found = semantics(scan)
    assert found[("users", "email")] == "email" and found[("users", "id")] is None
    assert found[("users", "full_name")] == "full-name" and found[("customers", "street_address")] == "address"
    assert ("_resolved_temp", "email") not in found


def test_one_primary_key_prefers_uuid(scan):
    found = semantics(pii.single_pk(scan))
    assert found[("customers", "customer_uuid")] == "pk" and found[("customers", "customer_id")] is None
    assert found[("users", "email")] == "email"


def answers_for(spark, **texts):
    return spark.createDataFrame([("dev", "public", t, x) for t, x in texts.items()], f"{KEYS}, response string")


def test_answers(spark):
    columns = lake(spark, [("a", "x", "string"), ("a", "y", "string"), ("b", "x", "string"), ("c", "x", "string"), ("d", "x", "string"), ("e", "x", "string")])
    answers = answers_for(
        spark,
        a='```json\n[{"name": "y", "semantic": "email"}, {"name": "unknown", "semantic": "phone"}]\n```',
        b='[{"name": "x", "semantic": "email"}',
        c='[{"name": "x", "semantic": "email"}, {"name": "x", "semantic": null}]',
        d='```[{"name": "x", "semantic": ""}]```',
    )
    got = {(r.table_name, r.column_name): (r.semantic, r.error) for r in pii.ingest_answers(columns, answers).collect()}
    assert got == {
        ("a", "x"): (None, None),
        ("a", "y"): ("email", None),
        ("b", "x"): (None, "Failed to parse the answer"),
        ("c", "x"): (None, "Expected 1 items, got 2"),
        ("d", "x"): (None, None),
        ("e", "x"): (None, "Failed to parse the answer"),
    }


def test_answers_that_are_no_answers(spark):
    columns = lake(spark, [("a", "x", "string"), ("b", "x", "string")])
    two = answers_for(spark, a='[{"name": "x", "semantic": "email"}]', b='[{"name": "x", "semantic": "nickname"}]')
    got = pii.ingest_answers(columns, two.unionByName(answers_for(spark, a='[{"name": "x", "semantic": "phone"}]'))).collect()
    assert sorted((r.table_name, r.semantic, r.error) for r in got) == [
        ("a", None, "2 answers for one table"),
        ("b", None, "Unknown semantic 'nickname'"),
    ]


def test_last_entry_of_a_name_counts(spark):
    columns = lake(spark, [("a", "x", "string"), ("a", "y", "string")])
    text = '[{"name": "x", "semantic": "email"}, {"name": "x", "semantic": "phone"}]'
    got = semantics(pii.ingest_answers(columns, answers_for(spark, a=text)))
    assert got == {("a", "x"): "phone", ("a", "y"): None}


def test_summary_and_rollups(spark, scan):
    failed = scan.withColumn("error", F.when(F.col("table_name") == "geo", F.lit("no access")))
    listing = spark.createDataFrame([("dev", "public", t) for t in ["users", "customers", "logs", "geo", "empty"]], KEYS)
    summary = pii.table_summary(failed, listing)
    got = {r.table_name: (r.column_count, r.pii_column_count, r.has_pii, r.error) for r in summary.collect()}
    assert got["empty"] == (0, 0, False, None) and got["geo"] == (0, 0, False, "no access")
    assert got["users"] == (4, 3, True, None) and got["logs"] == (2, 0, False, None)
    rolled = pii.schema_rollup(summary).first()
    assert rolled[2:] == (5, 4, 2, got["users"][1] + got["customers"][1])
    places = spark.createDataFrame([("dev", "public"), ("dev", "closed")], "catalog_name string, schema_name string")
    located = {r.location: r for r in pii.location_rollup(summary, places).collect()}
    assert located["dev.closed"].status == "error" and located["dev.public"].tables == 2
    assert located["dev.public"].columns == 9 and located["dev.public"].pii_columns == 7


def test_profile_holds_columns_in_order(spark, scan):
    import json

    profiles = {r.table_name: json.loads(r.profile) for r in pii.table_profile(scan, "2024-01-01T00:00:00").collect()}
    users = profiles["users"]
    assert [c["name"] for c in users["schema"]] == ["id", "email", "full_name", "phone"]
    assert [t["semantic"] for t in users["pii_tags"]] == ["email", "full-name", "phone"]
    assert users["table"]["table_name"] == "users" and users["profiling_timestamp"].startswith("2024")


# ---- edits ----


def asked(spark, *entries):
    return spark.createDataFrame(list(entries), "action string, table_name string, column_name string, new_semantic string")


def test_edits(spark, scan):
    without = edits.exclude_tables(scan, asked(spark, ("exclude_table", "USERS", None, None)))
    assert {t for (t, _), s in semantics(without).items() if s} == {"customers", "geo"}
    assert {r.table_name for r in without.filter("excluded").collect()} == {"users"}
    part = edits.exclude_tables_containing(scan, ["USER", "geo"])
    assert {t for (t, _), s in semantics(part).items() if s} == {"customers"}
    fewer = semantics(edits.exclude_columns(scan, asked(spark, ("", None, "EMAIL", None), ("", "logs", "phone", None))))
    assert fewer[("users", "email")] is None and fewer[("users", "phone")] == "phone"
    changed = semantics(
        edits.change_semantics(
            scan,
            asked(spark, ("", None, "email", "title"), ("", "users", "Email", "gender"), ("", "logs", "message", "city")),
        )
    )
    assert changed[("users", "email")] == "gender" and changed[("geo", "email")] == "title"
    assert changed[("logs", "message")] is None


def test_edits_of_one_schema(spark):
    columns = lake(spark, [("t", "email", "string")], "s1").unionByName(lake(spark, [("t", "email", "string")], "s2"))
    scan = pii.classify_columns(columns)
    here = asked(spark, ("x", "T", "EMAIL", "surname")).withColumn("schema_name", F.lit("S2"))
    changed = {r.schema_name: r.semantic for r in edits.change_semantics(scan, here).collect()}
    assert changed == {"s1": "email", "s2": "surname"}
    excluded = {r.schema_name: r.excluded for r in edits.exclude_tables(scan, here).collect()}
    assert excluded == {"s1": False, "s2": True}
    everywhere = asked(spark, ("x", None, "email", None))
    assert edits.exclude_columns(scan, everywhere).filter("semantic IS NOT NULL").isEmpty()
    assert edits.exclude_tables(scan, everywhere).filter("excluded").isEmpty()


def test_values_tell_what_names_do_not(spark):
    scan = pii.classify_columns(lake(spark, [("t", "a", "string"), ("t", "b", "string"), ("t", "phone", "string")]))
    df = spark.createDataFrame([("a@x.org", "call 555-123-4567", "n/a"), ("b@x.org", "x", "n/a"), (None, None, None)], "a string, b string, phone string")
    found = content.content_evidence({"t": (df, content.text_columns(df))})
    got = {r.column_name: r.semantic for r in pii.with_evidence(scan, found, 0.6).collect()}
    assert got == {"a": "email", "b": None, "phone": "phone"}


def test_unmatched_edits(spark, scan):
    wanted = asked(
        spark,
        ("exclude_table", "nowhere", None, None),
        ("exclude_table", "Users", None, None),
        ("exclude_table", None, None, None),
        ("exclude_column", "users", "id", None),
        ("exclude_column", None, "phone", None),
        ("change_semantic", "logs", "phone", "title"),
        ("change_semantic", None, None, "title"),
    )
    reasons = sorted(r.reason for r in edits.unmatched_edits(scan, wanted).collect())
    assert reasons == [
        "Column 'id' not found in PII results",
        "Column 'phone' not found in PII results",
        "No column specified",
        "No table specified",
        "Table 'nowhere' not found",
    ]


# ---- tags ----

TAGS = "database_name string, schema_name string, table_name string, column_name string, semantic_type string"


def test_upsert(spark, rows):
    at = F.lit("2024-02-02 00:00:00").cast("timestamp")
    old = spark.createDataFrame(
        [("dev", "public", "users", "name", "full-name"), ("dev", "public", "orders", "email", "email"), ("dev", "other", "users", "email", "email")],
        TAGS,
    ).withColumn("updated_at", F.lit("2020-01-01 00:00:00").cast("timestamp"))
    batch = spark.createDataFrame(
        [
            ("dev", "public", "users", "email", "email"),
            ("dev", "public", "users", "email", "phone"),
            ("dev", "public", "users", None, "email"),
            ("dev", "public", "customers", "ssn", "title"),
            ("dev", "public", "orders", "x", ""),
        ],
        TAGS,
    )
    after = tags.upsert_tags(old, batch, at)
    assert rows(after, *TAGS.replace(" string", "").split(", ")) == [
        ("dev", "other", "users", "email", "email"),
        ("dev", "public", "customers", "ssn", "title"),
        ("dev", "public", "users", "email", "email"),
    ]
    assert tags.verify_upsert(after, batch).first()[:] == (2, 2, True)
    assert tags.verify_upsert(after.filter("table_name <> 'customers'"), batch).first()[:] == (2, 1, False)
    assert sorted(r.error for r in tags.tag_errors(batch).collect()) == [
        "Column tagged twice in one batch",
        "Missing table, column, or semantic_type",
        "Missing table, column, or semantic_type",
    ]
    assert rows(tags.upsert_tags(old, batch.limit(0), at)) == rows(old)


def test_metadata_survives_parquet(spark, tmp_path):
    df = spark.createDataFrame([(1, "a@x.org")], "id int, email string")
    tagged = tags.with_semantics(df, spark.createDataFrame([("t", "email", "email"), ("t", "gone", "phone")], "table string, column string, semantic string"))
    tagged.write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t")).schema
    assert stored["email"].metadata == {"semantic": "email"} and stored["id"].metadata == {}


def test_table_refs(spark, rows):
    df = spark.createDataFrame([("t",), ("s.t",), ("d.s.t",), ("a.b.c.d",)], "ref string")
    got = rows(tags.resolve_table_ref(df, "ref", "D", "S"))
    assert got == [("a.b.c.d", "D", "S", "a.b.c.d"), ("d.s.t", "d", "s", "t"), ("s.t", "D", "s", "t"), ("t", "D", "S", "t")]


def test_failures(spark, rows):
    df = spark.createDataFrame(
        [("t", "a", True, None), ("t", "b", False, "denied"), ("u", "c", False, "denied"), ("u", "d", False, None)],
        "table_name string, column_name string, success boolean, error string",
    )
    assert rows(tags.tag_outcomes(df)) == [("t", 1, 1), ("u", 0, 2)]
    assert [r.message for r in tags.failure_summary(df).collect()] == [
        "2 column(s) failed due to: denied",
        "1 column(s) failed due to: Unknown error",
    ]


# ---- manifests ----


def test_config_and_unsupported(scan, rows):
    config = {(r.path, r.field_name): list(r.semantics) for r in manifest.resolution_config(scan).collect()}
    assert config[("dev.public.users", "email")] == ["email"] and config[("dev.public.users", "id")] == []
    assert ("dev.public.customers", "tags") not in config
    assert not any(path.endswith((".geo", ".logs")) for path, _ in config)
    assert rows(manifest.unsupported_fields(scan)) == [
        ("dev.public.customers", "tags", "ARRAY<STRING>", None),
        ("dev.public.geo", "email", "GEOGRAPHY", "email"),
    ]


def test_numeric_columns_lose_their_semantic(scan):
    forced = scan.withColumn("semantic", F.lit("email"))
    fields = {r.field_name: list(r.semantics) for r in manifest.resolution_config(forced).filter("path LIKE '%logs'").collect()}
    assert fields == {"amount": [], "message": ["email"]}


def test_same_table_name_in_two_schemas(spark):
    columns = lake(spark, [("t", "email", "string")], "s1").unionByName(lake(spark, [("t", "email", "varchar")], "s2"))
    stored = spark.createDataFrame([("dev", "s1", "t", "email", "email")], TAGS)
    got = [(r.path, r.type, list(r.semantics)) for r in manifest.manifest_multi_schema(columns, stored).collect()]
    assert got == [("s1.t", "string", ["email", "pii"])]


def test_equal_paths_are_not_mixed_when_nested(spark):
    columns = lake(spark, [("t", "email", "string")], "s1").unionByName(lake(spark, [("t", "phone", "string")], "s2"))
    nested = manifest.nest_fields(manifest.manifest_from_scan(pii.classify_columns(columns)))
    got = sorted((r.schema_name, r.path, [f["field-name"] for f in r.fields]) for r in nested.collect())
    assert got == [("s1", "t", ["email"]), ("s2", "t", ["phone"])]


def test_secrets_are_found_at_any_depth(spark, scan):
    nested = manifest.nest_fields(manifest.resolution_config(scan))
    with pytest.raises(ValueError, match="api_token"):
        manifest.documents(nested, {"a": [{"b": {"api_token": "x"}}]})


def test_manifest_from_tags(spark):
    columns = lake(spark, [("customers", "email", "varchar"), ("customers", "phone", "varchar"), ("customers", "id", "int"), ("other", "x", "int")])
    stored = spark.createDataFrame([("dev", "public", "customers", c, c) for c in ["email", "phone"]], TAGS)
    fields = manifest.manifest_from_tags(columns, stored, "dev", "public").orderBy("position").collect()
    assert [(r.path, r.field_name, r.type, list(r.semantics)) for r in fields] == [
        ("customers", "email", "STRING", ["email"]),
        ("customers", "phone", "STRING", ["phone"]),
        ("customers", "id", "LONG", []),
    ]


def test_manifest_files(spark, scan, tmp_path, rows):
    path = str(tmp_path / "m")
    fields = manifest.resolution_config(scan)
    manifests.write_manifest(manifest.nest_fields(fields), {"data_provider": "redshift"}, path)
    back = manifests.manifest_fields(manifests.read_manifest(spark, path))
    cells = ["path", "field_name", "type", "semantics"]
    assert rows(back, *cells) == rows(fields, *cells)
    assert rows(manifests.read_settings(spark, path)) == [("data_provider", "redshift")]
    with pytest.raises(ValueError, match="secrets"):
        manifests.write_manifest(manifest.nest_fields(fields), {"redshift_config": {"password": "x"}}, path)


GOOD = '{"name": "n", "tables": [{"path": "t", "fields": [{"field-name": "a", "type": "string", "semantics": []}]}], "settings": {"output_catalog_name": "c", "output_schema_name": "s"}}'


@pytest.mark.parametrize(
    "body, first",
    [
        (GOOD, None),
        (GOOD.replace('"name": "n", ', ""), "Missing 'name'"),
        (GOOD.replace('"path": "t", ', ""), "Table 0 missing 'path'"),
        (GOOD.replace('"path": "t"', '"path": null'), None),
        (GOOD.replace('"type": "string", ', ""), "Table 0 field 0 missing 'type'"),
        (GOOD.replace('"semantics": []', '"semantics": "x"'), "Table 0 field 0 'semantics' must be a list"),
        (GOOD.replace('"output_schema_name": "s"', '"x": 1'), "Missing 'output_schema_name' in settings"),
        ('{"name": 1, "tables": 5, "settings": {}}', "'tables' must be a list"),
        ("not json", "Not a JSON document"),
        (None, "Not a JSON document"),
    ],
)
def test_validate(spark, body, first):
    row = manifest.validate_manifest(spark.createDataFrame([(body,)], "body string")).first()
    assert (row.first_error, row.valid) == (first, first is None)


def test_validate_other_rule_sets(spark):
    body = '{"tables": [], "settings": {"snowflake_config": {"account": ""}, "redshift_config": {}}}'
    df = spark.createDataFrame([(body,)], "body string")
    snow = manifest.validate_manifest(df, manifest.SNOWFLAKE_RULES).first()
    assert snow.first_error == "No tables in manifest" and "Missing 'snowflake_config.account' in settings" in snow.errors
    red = manifest.validate_manifest(df, manifest.REDSHIFT_RULES).first()
    assert list(red.errors) == [
        f"Missing '{k}' in settings"
        for k in ["s3_temp_dir", "redshift_iam_role", "redshift_config.database", "redshift_config.schema"]
    ]


@pytest.mark.parametrize(
    "settings, rules",
    [
        (manifest.config_settings("lake"), manifest.CONFIG_RULES),
        (manifest.redshift_settings("dev", "public", "s3://bucket/tmp/", "role", region="eu-1"), manifest.REDSHIFT_RULES),
        (manifest.snowflake_settings("acc", "me", "mydb", "myschema", "wh"), manifest.SNOWFLAKE_RULES),
    ],
    ids=["config", "redshift", "snowflake"],
)
def test_generated_manifests_are_valid(spark, scan, tmp_path, settings, rules):
    nested = manifest.nest_fields(manifest.resolution_config(scan))
    checked = manifest.validate_manifest(manifest.documents(nested, settings, "run"), rules).collect()
    assert len(checked) == 2 and all(r.valid for r in checked)
    kept = tagging.Scan(tagging.materialise(scan, "scan"), scan, scan)
    tagging.store_manifest(kept, settings, str(tmp_path / "m"), rules)
    assert manifests.read_manifest(spark, str(tmp_path / "m")).count() == 2
    with pytest.raises(ValueError, match="Missing"):
        tagging.store_manifest(kept, {}, str(tmp_path / "n"), rules)


def test_settings():
    red = manifest.redshift_settings("dev", "public", "t", "r", host="h", user="u")
    assert red["redshift_config"] == {"database": "dev", "schema": "public", "host": "h", "port": 5439, "user": "u"}
    snow = manifest.snowflake_settings("a", "u", "d", "s", "w", role="x", output_database="o")
    assert snow["output_database_name"] == "o" and snow["snowflake_config"]["role"] == "x"


def test_plan_from_catalogue_to_manifest(spark, tmp_path):
    scanned = tagging.scan_columns(lake(spark), "_resolved")
    assert scanned.schemas.first().tables_with_pii == 3
    path = str(tmp_path / "tags")
    stored, check = tagging.store_tags(scanned, F.current_timestamp(), path)
    assert check.first().success and stored.count() == check.first().actual
    before_count = stored.count()
    other = tagging.scan_columns(lake(spark, [("t", "email", "string")], "s9"), "_resolved")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "tags").rglob("*.parquet")}
    both, check = tagging.store_tags(other, F.current_timestamp(), path)
    assert check.first().success and both.count() == before_count + 1 and both.filter("schema_name = 's9'").count() == 1
    assert before and all(p.stat().st_mtime_ns == t for p, t in before.items())
    left_out = tagging.store_manifest(scanned, {"output_schema_name": "out"}, str(tmp_path / "manifest"))
    assert left_out.count() == 2 and manifests.read_manifest(spark, str(tmp_path / "manifest")).count() == 2


# ---- inventory, paging, names ----


def test_inventory(spark, rows):
    columns = lake(spark)
    counts = inventory.table_column_counts(columns, ["table_name"])
    listing = columns.select("table_name").distinct().unionByName(spark.createDataFrame([("none",)], "table_name string"))
    sizes = inventory.table_row_counts({"users": spark.range(7), "logs": spark.range(0)})
    got = {r.table_name: (r.column_count, r.row_count, r.row_count_text) for r in inventory.table_inventory(listing, counts, sizes).collect()}
    assert got["users"] == (4, 7, "7") and got["logs"] == (2, 0, "0") and got["none"] == (0, None, "-")


def test_catalogue_scans(spark, rows):
    spark.sql("CREATE DATABASE IF NOT EXISTS shop")
    spark.range(3).selectExpr("id", "CAST(id AS STRING) AS email").write.mode("overwrite").saveAsTable("shop.people")
    detail = catalog.table_details(spark, "shop", "peo*").filter("NOT is_temporary").first()
    assert detail.table_name == "people" and detail.table_type == "MANAGED" and detail.format == "parquet"
    assert detail.created and detail.location.endswith("people") and detail.schema_name == "shop"
    listed = catalog.list_tables(spark, "shop", "peo*")
    assert rows(listed, "schema_name", "table_name") == [("shop", "people")]
    assert ("spark_catalog", "shop") in rows(catalog.list_schemas(spark, "shop"))
    assert ("spark_catalog",) in rows(catalog.list_catalogs(spark))
    cells = ["catalog_name", "schema_name", "table_name", "column_name", "data_type", "position"]
    wanted = [
        ("spark_catalog", "shop", "people", "email", "string", 1),
        ("spark_catalog", "shop", "people", "id", "bigint", 0),
    ]
    for name in ["spark_catalog.shop.people", "shop.people"]:
        assert rows(catalog.column_catalog(spark, [name]), *cells) == wanted
    spark.range(1).createOrReplaceTempView("people_view")
    assert rows(catalog.column_catalog(spark, ["people_view"]), *cells[:3]) == [("spark_catalog", "default", "people_view")]
    checked = inventory.check_locations(spark, [("spark_catalog", "shop"), ("spark_catalog", "gone"), ("", "x")])
    assert [r.accessible for r in checked.collect()] == [True, False, False]


def test_locations_against_a_listing(spark, rows):
    asked = spark.createDataFrame([("a", "x"), ("A", "X"), ("a", "y"), ("", "x"), ("a", None), ("a", "x")], "catalog string, schema string")
    schemas = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "catalog_name string, schema_name string")
    none = "Missing catalog or schema"
    want = [("a", "x", True, None), ("A", "X", True, None), ("a", "y", False, "Schema a.y not found"), ("", "x", False, none), ("a", None, False, none), ("a", "x", True, None)]
    assert rows(inventory.location_report(asked, schemas)) == sorted(want, key=repr)
    assert rows(inventory.location_report(asked.limit(0), schemas)) == []


def test_pages_fit_together(spark):
    df = spark.range(130).selectExpr("id AS k", "id % 7 AS v")
    by_offset = [r.k for start in range(0, 150, 50) for r in inventory.result_page(df, ["k"], start).collect()]
    by_key, last = [], None
    while page := inventory.page_after(df, "k", last).collect():
        by_key += [r.k for r in page]
        last = page[-1].k
    assert by_offset == by_key == list(range(130))


def test_pages_over_given_chunks(spark, tmp_path):
    chunks, at = [], 0
    for number, size in enumerate([7, 0, 30, 1, 12]):
        path = tmp_path / f"c{number}.csv"
        path.write_text("".join(f'{at + i},"line ""{at + i}""\nof two"\n' for i in range(size)))
        chunks.append((number, str(path), size))
        at += size
    shuffled = chunks[::-1]
    for start in (0, 5, 7, 36, 37, 49, 50, 99):
        got = [(int(r.k), r.v) for r in paging.chunk_page(spark, shuffled, ["k", "v"], start, 10).collect()]
        assert got == [(i, f'line "{i}"\nof two') for i in range(start, min(start + 10, 50))]


def test_stored_pages(spark):
    df = spark.range(1000).selectExpr("(id * 37) % 1000 AS k", "id AS `odd name`", "array(id) AS a").repartition(7)
    assert paging.store_pages(df, ["k"]).total_rows == 1000
    stored = paging.store_pages(df, ["k"], chunks=6)
    zones = [tuple(r) for r in stored.zones.select("start", "stop", "low.k", "high.k").collect()]
    assert stored.total_rows == 1000 and len(zones) > 1
    assert all((low, high) == (start, stop - 1) for start, stop, low, high in zones)
    edge = zones[1][0]
    inner = zones[1][1] - edge - 1
    assert len(stored.page(edge, inner).inputFiles()) == 1 and len(stored.page(edge - 1, 2).inputFiles()) == 2
    for start, n in [(0, 50), (edge - 3, 6), (edge, 1), (120, 700), (990, 50), (1000, 50)]:
        assert [r.k for r in stored.page(start, n).collect()] == list(range(start, min(start + n, 1000)))
    seen = [(len(part), more) for part, more in stored.pages(300)]
    assert seen == [(300, True), (300, True), (300, True), (100, False)]
    assert stored.page(0).columns == df.columns
    again = paging.open_pages(spark, stored.path)
    for last in (-1, edge - 1, edge, edge + 5, 998, 999, 5000):
        assert [r.k for r in again.page_after([last], 30).collect()] == list(range(last + 1, min(last + 31, 1000)))
    assert len(again.page_after([edge], inner - 2).inputFiles()) <= 2


def test_stored_pages_by_several_columns_with_nulls(spark, tmp_path):
    df = spark.range(300).selectExpr("IF(id < 100, NULL, concat('g', id % 3)) AS `a b`", "id AS k", "-id AS v").repartition(5)
    want = sorted(((r["a b"], r.k) for r in df.collect()), key=lambda t: (t[0] is not None, t[0] or "", t[1]))
    stored = paging.store_pages(df, ["a b", "k"], f"{tmp_path}/with blank", chunks=7)
    seen = [(r["a b"], r.k) for part, _ in stored.pages(41) for r in part]
    assert seen == want
    for at in (0, 99, 100, 250, 299):
        assert [(r["a b"], r.k) for r in stored.page_after(want[at], 9).collect()] == want[at + 1 : at + 10]
    with pytest.raises(ValueError):
        stored.page_after(["g1"])


def test_many_files_are_numbered_in_runs(spark, monkeypatch):
    monkeypatch.setattr(paging, "_RUN", 3)
    stored = paging.store_pages(spark.range(500), ["id"], chunks=14)
    assert [r.id for part, _ in stored.pages(77) for r in part] == list(range(500))


def test_stored_pages_of_nothing(spark):
    stored = paging.store_pages(spark.range(0), ["id"])
    assert stored.total_rows == 0 and stored.page(0).count() == 0 and list(stored.pages()) == []


def test_sources_fall_back(spark, rows):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "datasource string")
    assert rows(catalog.distinct_sources(df)) == [("a",), ("b",)]
    assert rows(catalog.distinct_sources(df.limit(0))) == [("default_source",)]


def brute_best(target, names, least):
    scored = []
    for n in names:
        t, c = target.lower().strip(), n.lower().strip()
        ratio = SequenceMatcher(None, t, c).ratio()
        rank = 2 if t == c else 1 if t in c else 0
        if rank or ratio >= least:
            scored.append((-rank, -1.0 if rank else -ratio, n))
    return min(scored)[2] if scored else None


def test_fuzzy_names_match_brute_force(spark):
    names = ["Main", "main_archive", "Sales", "sales_2023", "saels", "", "Marketing", "mrkt", "finance"]
    targets = ["main", "SALE", "markt", "finanse", "archive", "qqqq", " sales "]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {r.target: r.name for r in inventory.fuzzy_name_match(df, targets).collect()}
    wanted = {t: brute_best(t, [n for n in names if n], 0.4) for t in targets}
    assert got == {t: n for t, n in wanted.items() if n}


def test_targets(spark):
    df = spark.createDataFrame([(t,) for t in ["c.s", "c", "c.", ".s", "a.b.c", "", None]], "target string")
    got = [(r.catalog, r.schema, r.error is None) for r in inventory.parse_targets(df).collect()]
    assert got == [("c", "s", True)] + [(None, None, False)] * 6


# ---- files and content ----


def test_csv_chunks(spark, tmp_path, rows):
    for i, text in enumerate(['1,"a ""quoted"", b"\n2,\n', '3,"two\nlines"\n']):
        (tmp_path / f"chunk-{i}.csv").write_text(text)
    got = readers.csv_chunks(spark, [str(tmp_path / f"chunk-{i}.csv") for i in range(2)], 2)
    assert got.columns == ["column_1", "column_2"]
    assert rows(got) == [("1", 'a "quoted", b'), ("2", None), ("3", "two\nlines")]
    cast = readers.cast_columns(got, {"column_1": "int", "column_2": "double"})
    assert rows(cast) == [(1, None), (2, None), (3, None)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.csv_chunks(spark, str(tmp_path / "missing.csv"), 2).count()


def test_sources_by_format(spark, tmp_path, rows):
    path = str(tmp_path / "j")
    spark.range(3).write.json(path)
    assert readers.read_source(spark, "json", path).count() == 3
    spark.range(4).createOrReplaceTempView("four")
    assert readers.read_source(spark, "table", "four").count() == 4
    got = readers.run_sql(spark, "SELECT id FROM four WHERE id > :n", {"n": 1}, database="default")
    assert rows(got) == [(2,), (3,)]
    assert readers.name_columns(got).columns == ["column_1"]


def test_a_query_elsewhere_leaves_the_session_where_it_was(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS elsewhere")
    try:
        assert readers.run_sql(spark, "SELECT current_database() AS d", database="elsewhere").first()[0] is not None
        assert spark.catalog.currentDatabase() == "default"
        with pytest.raises(Exception, match="(?i)not.found"):
            readers.run_sql(spark, "SELECT * FROM no_such_table", database="elsewhere")
        assert spark.catalog.currentDatabase() == "default"
    finally:
        spark.sql("DROP DATABASE elsewhere")


def test_jdbc_needs_partitions(spark):
    for kind in ("jdbc", "databricks"):
        with pytest.raises(ValueError, match="partitionColumn"):
            readers.read_source(spark, kind, url="jdbc:x", dbtable="t")


@pytest.mark.parametrize("phone", ["555-123-4567", "(555) 123-4567", "+1 (555) 123-4567", "+44 555 123 4567", "555.123.4567"])
def test_shapes_of_phones(spark, phone):
    found = content.text_findings(spark.createDataFrame([(1, f"call {phone}, please")], "id int, body string"), "id", "body")
    assert [(r.kind, r.value) for r in found.collect()] == [("phone", phone)]


def test_content(spark, rows):
    texts = ["mail a@x.org or b@y.org, a@x.org", "card 4111 1111 1111 1111 ip 10.0.0.1", None, "tel +1 (555) 123-4567 on 2024-01-31"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    found = rows(content.text_findings(df, "id", "body"))
    assert found == [
        (0, "email", "a@x.org", 2),
        (0, "email", "b@y.org", 1),
        (1, "card", "4111 1111 1111 1111", 1),
        (1, "ipv4", "10.0.0.1", 1),
        (3, "date", "2024-01-31", 1),
        (3, "phone", "+1 (555) 123-4567", 1),
    ]
    evidence = {r.pattern: (r.non_null, r.matches) for r in content.content_evidence({"t": (df, ["body"])}).collect()}
    assert evidence == {"email": (3, 1), "ipv4": (3, 1), "card": (3, 1), "phone": (3, 1), "date": (3, 1)}
