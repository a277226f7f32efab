"""Resolving records into entities, from published methods (Fellegi-Sunter scoring, connected components).

Two records match when the weights of the fields they agree on add up to at least a threshold. That is the case
exactly when they agree on all fields of some minimal field set reaching the threshold, so those sets, the *match
rules*, are the blocking keys. All records sharing a key then match one another, and one line per record, to the
smallest id of its key, connects the group as fully as all pairs would. A key held by a third of all records costs
as many lines as it has records; no block is cut off or left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.skew import join_by_key
from kinweave.functions.unions import union_all
from kinweave.sources.shared import materialise

FIELDS = ["given_name", "surname", "email", "phone", "address", "birthdate"]

# Weight of agreement on each field, and the sum at which two records count as one person.
MATCH_WEIGHTS: dict[str, float] = {
    "email": 2.0,
    "phone": 2.0,
    "address": 1.0,
    "birthdate": 1.0,
    "given_name": 0.5,
    "surname": 0.5,
}
MATCH_THRESHOLD = 2.0

KEY_SEPARATOR = "\u001f"

#: Keys under which records are often put side by side; the postal code needs ``standardise(..., postal=True)``.
SURVEY_BLOCKS = [("email",), ("phone",), ("surname", "birthdate"), ("postal", "surname")]


def match_rules(
    weights: Mapping[str, float] = MATCH_WEIGHTS, threshold: float = MATCH_THRESHOLD
) -> list[tuple[str, ...]]:
    """The minimal sets of fields whose weights reach the threshold."""
    if threshold <= 0 or any(w <= 0 for w in weights.values()):
        raise ValueError("weights and threshold must be positive")
    rules: list[tuple[str, ...]] = []
    for size in range(1, len(weights) + 1):
        for fields in combinations(weights, size):
            reaches = sum(weights[f] for f in fields) >= threshold
            if reaches and not any(set(rule) <= set(fields) for rule in rules):
                rules.append(fields)
    return rules


def _clean(text: Column) -> Column:
    """Trimmed, lower case, inner blanks single, empty as null."""
    return F.nullif(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), F.lit(""))


def _digits(text: Column) -> Column:
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit(""))


def _day(text: Column) -> Column:
    formats = ["yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd"]
    tried = [F.try_to_timestamp(F.trim(text), F.lit(f)).cast("date") for f in formats]
    return F.date_format(F.coalesce(*tried), "yyyy-MM-dd")


def standardise(
    tables: Mapping[str, DataFrame], semantics: Mapping[str, Mapping[str, str]], keys: Mapping[str, str | Sequence[str]],
    postal: bool = False,
) -> DataFrame:
    """Records of all tables in one form: ``record_id, datasource`` and the six identity columns.

    ``semantics`` gives, for each table (by its manifest path, which becomes ``datasource``), the columns and their
    tags; ``keys`` its key column, or several that make the key together. Lines without a key are no records (see
    ``rejected``); lines of one key are one record in resolution. Names, e-mail and address are trimmed and lower-cased, phones keep digits only,
    dates become ISO dates; what is empty or unreadable is null. A full name is split at its first blank where no
    given name or surname is tagged; address parts are joined in the order address, address2, city, state, postal,
    country. With ``postal`` the postal code is a column of its own as well, its letters and digits alone.
    """
    parts = []
    for path, df in tables.items():
        by_tag: dict[str, list[str]] = {}
        for column, tag in semantics[path].items():
            by_tag.setdefault(tag, []).append(column)

        def text(tag: str, by_tag: dict[str, list[str]] = by_tag) -> Column:
            columns = [F.col(c).cast("string") for c in by_tag.get(tag, [])]
            return F.coalesce(*columns) if columns else F.lit(None).cast("string")

        full = _clean(text("full-name"))
        first = F.split_part(full, F.lit(" "), F.lit(1))
        rest = F.nullif(F.ltrim(F.substr(full, F.length(first) + 1)), F.lit(""))
        lines = ["address", "address2", "city", "state", "postal", "country"]
        address = F.nullif(F.concat_ws(" ", *[_clean(text(t)) for t in lines]), F.lit(""))
        parts.append(
            df.filter(_key(keys[path]).isNotNull()).select(
                F.concat(F.lit(f"{path}:"), _key(keys[path])).alias("record_id"),
                F.lit(path).alias("datasource"),
                F.coalesce(_clean(text("given-name")), first).alias("given_name"),
                F.coalesce(_clean(text("surname")), rest).alias("surname"),
                _clean(text("email")).alias("email"),
                _digits(text("phone")).alias("phone"),
                address.alias("address"),
                _day(text("birthdate")).alias("birthdate"),
                *([F.nullif(F.regexp_replace(F.lower(text("postal")), "[^0-9a-z]", ""), F.lit("")).alias("postal")] if postal else []),
            )
        )
    return union_all(parts)


def _key(columns: str | Sequence[str]) -> Column:
    """The key of a line as text; null if any part is."""
    names = [columns] if isinstance(columns, str) else list(columns)
    text = [F.col(c).cast("string") for c in names]
    return reduce(lambda a, b: F.concat(a, F.lit(KEY_SEPARATOR), b), text)


def rejected(tables: Mapping[str, DataFrame], keys: Mapping[str, str | Sequence[str]]) -> DataFrame:
    """``datasource, record_key, reason, lines``: lines without a key, which ``standardise`` leaves out, and keys held by
    more than one line. A line per key."""
    parts = []
    for path, df in tables.items():
        counts = df.groupBy(_key(keys[path]).alias("record_key")).agg(F.count("*").alias("lines"))
        reason = F.when(F.col("record_key").isNull(), F.lit("no key")).when(F.col("lines") > 1, F.lit("repeated key"))
        parts.append(counts.select(F.lit(path).alias("datasource"), "record_key", reason.alias("reason"), "lines"))
    return union_all(parts).filter("reason IS NOT NULL")


def record_keys(rules: Sequence[Sequence[str]]) -> Column:
    """The keys of a record: one for each rule all of whose fields it has."""

    def key(fields: Sequence[str]) -> Column:
        present = reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in fields])
        value = F.concat_ws(KEY_SEPARATOR, *fields)
        return F.when(present, F.struct(F.lit("+".join(fields)).alias("rule"), value.alias("block_key")))

    return F.array_compact(F.array(*[key(fields) for fields in rules]))


def blocks(records: DataFrame, rules: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """``record_id, rule, block_key``: the keys under which each record is compared."""
    return records.select("record_id", F.inline(record_keys(rules or match_rules())))


def numbered(records: DataFrame) -> DataFrame:
    """``n, record_id`` and the fields, ``n`` in the order of the ids, then of the fields: so the smallest number of a group
    is that of its smallest record. Write the result before it is used twice."""
    return records.select("record_id", *FIELDS).orderBy("record_id", *FIELDS).withColumn("n", F.monotonically_increasing_id())


def with_fields(linked: DataFrame, records: DataFrame) -> DataFrame:
    """``linked`` (``n, n_b`` and others) with ``id_a, id_b, a, b``: ids and fields of the numbered records."""
    parts = F.struct(*FIELDS)
    first = records.select("n", F.col("record_id").alias("id_a"), parts.alias("a"))
    second = records.select(F.col("n").alias("n_b"), F.col("record_id").alias("id_b"), parts.alias("b"))
    # Any number of lines may be linked to one record; both tables lie in files, so adaptive execution can split those.
    return linked.join(second, "n_b").join(first, "n")


def _agreeing(rules: Sequence[Sequence[str]]) -> Column:
    """Names of the rules on all of whose fields the records ``a`` and ``b`` agree."""

    def name(fields: Sequence[str]) -> Column:
        same = reduce(lambda x, y: x & y, [F.col(f"a.{f}") == F.col(f"b.{f}") for f in fields])
        return F.when(same, F.lit("+".join(fields)))

    return F.array_compact(F.array(*[name(fields) for fields in rules]))


def pairs(
    records: DataFrame, rules: Sequence[Sequence[str]] | None = None
) -> DataFrame:
    """``id_a, id_b, a, b, rules``: records with the smallest id of a group they belong to, each pair once.

    ``a`` and ``b`` are the fields of the two records, ``rules`` the names of all rules they agree on. Records with a key
    are numbered and written to the shared folder first; groups are found over numbers and hashes. Records without an id
    match nothing.

    A pair found by a rule is kept if it agrees on no earlier rule. Otherwise both records are in one group of that
    earlier rule and connected there, so the components are the same, and no shuffle is needed to find repeats.
    """
    rules = rules or match_rules()
    held = records.filter("record_id IS NOT NULL").filter(F.size(record_keys(rules)) > 0)
    narrow = materialise(numbered(held), "records").df
    text = F.concat_ws("\0", "rule", "block_key")
    names = F.array(*[F.lit("+".join(rule)) for rule in rules])
    keyed = narrow.select("n", F.inline(record_keys(rules))).select(
        "n", (F.array_position(names, F.col("rule")) - 1).cast("int").alias("rule"), F.xxhash64(F.lit(1), text).alias("high"), F.xxhash64(F.lit(2), text).alias("low")
    )
    key = ["high", "low"]
    hubs = keyed.groupBy(*key).agg(F.min("n").alias("n_b"), F.count("*").alias("size")).filter("size > 1").select(*key, "n_b")
    linked = join_by_key(keyed, hubs, key, "inner").filter("n <> n_b").select("n", "n_b", "rule")
    return (
        with_fields(linked, narrow)
        .filter("id_a <> id_b")
        .withColumn("agreeing", _agreeing(rules))
        .filter(F.get("agreeing", F.lit(0)) == F.get(names, F.col("rule")))
        .select("id_a", "id_b", "a", "b", F.array_join("agreeing", ", ").alias("rules"))
    )


def pair_scores(candidates: DataFrame, weights: Mapping[str, float] = MATCH_WEIGHTS) -> DataFrame:
    """``id_a, id_b, score, confidence, rules`` of candidate pairs: the table of match edges.

    ``score`` adds the weights of equal fields. ``confidence`` is between 0 and 1: the weighted mean likeness
    (1 - edit distance / longer length) over the fields both records have.
    """
    score, alike, known = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for field, weight in weights.items():
        a, b = F.col(f"a.{field}"), F.col(f"b.{field}")
        both = a.isNotNull() & b.isNotNull()
        longer = F.greatest(F.length(a), F.length(b))
        near = F.when(a == b, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longer)
        score = score + F.when(a == b, F.lit(weight)).otherwise(F.lit(0.0))
        alike = alike + F.when(both, near * F.lit(weight)).otherwise(F.lit(0.0))
        known = known + F.when(both, F.lit(weight)).otherwise(F.lit(0.0))
    return candidates.select(
        "id_a",
        "id_b",
        score.alias("score"),
        F.round(F.try_divide(alike, known), 6).alias("confidence"),
        "rules",
    )


def unified(records: DataFrame, components: DataFrame) -> DataFrame:
    """``records`` with ``entity_id``: the component each belongs to, its own id if it matched nothing."""
    return (
        records.join(components.withColumnRenamed("node", "record_id"), "record_id", "left")
        .withColumn("entity_id", F.coalesce("component", "record_id"))
        .drop("component")
    )
