"""Agreement of similar values: records whose values differ by one letter, found by deletion neighbourhoods.

Two values are *alike* if one insertion, deletion or substitution turns one into the other. That is so exactly when

* taking out the letter at the same position leaves the same rest (substitution), or
* taking out one letter of the longer leaves the shorter (insertion).

So a value has a key for every letter: (position, rest). Values that share such a key are all alike to one another, and
one line per record, to the smallest id of the key, connects them. And (rest) is the key of the shorter value itself, the
*centre*, to which all longer ones are alike. No pairs are listed, nothing is compared with everything, no key is capped.

Which keys at least two values share (*live* keys) is found on distinct values, not on records, and only the places of those
keys go to the records. A match rule with a similar field adds the fields that must be equal to the key. Lines of records
carry numbers and hashes; the fields of the two records of a pair are joined once pairs are known.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.skew import join_by_key
from kinweave.operators.resolution import FIELDS, KEY_SEPARATOR, MATCH_THRESHOLD, MATCH_WEIGHTS, match_rules, numbered, pair_scores, with_fields
from kinweave.sources.shared import materialise

#: What a similar value is worth; a name with one wrong letter as much as an equal one, an e-mail half. Phones and dates
#: differ by one digit too easily.
SIMILAR_WEIGHTS: dict[str, float] = {"email": 1.0, "address": 0.5, "given_name": 0.5, "surname": 0.5}
#: Shorter values are only alike if equal.
MIN_LENGTH = 4


class Rule(NamedTuple):
    """One field that is alike, and others that are equal."""

    field: str
    equal: tuple[str, ...]

    @property
    def name(self) -> str:
        return "+".join([f"~{self.field}", *self.equal])


def similar_rules(
    weights: Mapping[str, float] = MATCH_WEIGHTS, similar: Mapping[str, float] = SIMILAR_WEIGHTS, threshold: float = MATCH_THRESHOLD
) -> list[Rule]:
    """The minimal sets of equal fields that reach the threshold together with one similar field, and not alone."""
    if any(not 0 < similar[f] <= weights[f] for f in similar):
        raise ValueError("a similar value is worth more than 0 and no more than an equal one")
    rules: list[Rule] = []
    for field, worth in similar.items():
        others = [f for f in weights if f != field]
        for size in range(len(others) + 1):
            for equal in combinations(others, size):
                held = sum(weights[f] for f in equal)
                known = any(rule.field == field and set(rule.equal) <= set(equal) for rule in rules)
                if held < threshold <= held + worth and not known:
                    rules.append(Rule(field, equal))
    return rules


def alike(a: Column, b: Column) -> Column:
    """Whether two values differ by exactly one letter; false for nulls and values below ``MIN_LENGTH``."""
    long_enough = F.least(F.length(a), F.length(b)) >= MIN_LENGTH
    return F.coalesce(long_enough & (F.levenshtein(a, b, 1) == 1), F.lit(False))


#: Places of the keys of ``value``: i for the rest without letter i at that position, -i for that rest at any position, 0 for
#: the value itself (the centre). Letters that repeat leave the same rest, so only the first of a run has a negative place.
_PLACES = """concat(array(0), sequence(1, length(value)), filter(transform(sequence(1, length(value)),
  i -> IF(i = 1 OR substr(value, i, 1) <> substr(value, i - 1, 1), -i, 0)), i -> i < 0))"""
_REST = "IF(place = 0, value, concat(left(value, abs(place) - 1), substr(value, abs(place) + 1)))"


def live_places(records: DataFrame, fields: Sequence[str]) -> DataFrame:
    """``field, value, places`` of the distinct values of some columns that are alike to others of their column: the places
    (see ``_PLACES``) of the keys that they share. At most two per letter and one more."""
    held = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    distinct = records.select(held).filter(F.length("value") >= MIN_LENGTH).distinct()
    values = materialise(distinct.withColumn("id", F.monotonically_increasing_id()), "values").df
    placed = values.select("id", "field", "value", F.explode(F.expr(_PLACES)).alias("place"))
    # A hash that two keys share by chance only makes them look live.
    key = F.xxhash64("field", F.greatest("place", F.lit(0)), F.expr(_REST)).alias("key")
    lines = placed.select("id", F.col("place").cast("int").alias("place"), key)
    # A key is held by no more distinct values than there are letters, or letters and places, to put in.
    of_key = Window.partitionBy("key")
    counted = lines.withColumn("n", F.count("*").over(of_key)).withColumn("whole", F.max(F.col("place") >= 0).over(of_key))
    live = counted.filter("n > 1 AND whole").groupBy("id").agg(F.collect_list("place").alias("places"))
    return live.join(values, "id").select("field", "value", "places")


def _equal(rule: Sequence[str]) -> Column:
    """Name of a set of fields if the records ``a`` and ``b`` are equal on all of them."""
    return F.when(reduce(lambda x, y: x & y, [F.col(f"a.{f}") == F.col(f"b.{f}") for f in rule], F.lit(True)), F.lit("+".join(rule)))


def similar_pairs(
    records: DataFrame,
    weights: Mapping[str, float] = MATCH_WEIGHTS,
    similar: Mapping[str, float] = SIMILAR_WEIGHTS,
    threshold: float = MATCH_THRESHOLD,
) -> DataFrame:
    """``id_a, id_b, a, b, rules``: records with a record they match through one similar field, each pair once.

    As ``resolution.pairs``, whose lines are to be added: a record is linked to the smallest id of its key, and pairs that
    a rule of equal fields, or an earlier one with a similar field, connects are left out. Together they have the same
    components as all pairs that reach the threshold with at most one similar field. Records without an id match nothing,
    lines of one id are one record.
    """
    rules = similar_rules(weights, similar, threshold)
    exact = match_rules(weights, threshold)
    held = records.filter("record_id IS NOT NULL").select("record_id", *FIELDS)
    if not rules:
        nothing = held.limit(0).select(F.col("record_id").alias("id_a"), F.col("record_id").alias("id_b"), F.struct(*FIELDS).alias("a"))
        return nothing.select("id_a", "id_b", "a", F.col("a").alias("b"), F.lit("").alias("rules"))
    fields = list(dict.fromkeys(rule.field for rule in rules))

    def ruled(field: str) -> Column:
        """The rules of a similar field whose equal fields the record has, with two hashes of those."""
        made = []
        for at, rule in enumerate(rules):
            if rule.field == field:
                present = reduce(lambda x, y: x & y, [F.col(f).isNotNull() for f in rule.equal], F.lit(True))
                equal = F.concat_ws(KEY_SEPARATOR, F.lit(rule.name), *rule.equal)
                hashes = [F.xxhash64(F.lit(i), equal).alias(name) for i, name in ((1, "high"), (2, "low"))]
                made.append(F.when(present, F.struct(F.lit(at).alias("rule"), *hashes)))
        return F.array_compact(F.array(*made))

    narrow = materialise(numbered(held), "records").df
    # A line for each field that has a value and a rule; live places of a value serve all rules with its field.
    values = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), ruled(f).alias("ruled")) for f in fields])
    by_value = narrow.select("n", F.inline(values)).filter((F.length("value") >= MIN_LENGTH) & (F.size("ruled") > 0))
    found = materialise(join_by_key(by_value, live_places(narrow, fields), ["field", "value"], "inner").drop("field"), "live").df
    placed = found.select("n", "value", "places", F.inline("ruled")).select("n", "value", "rule", "high", "low", F.explode("places").alias("place"))
    rest = [F.greatest("place", F.lit(0)), F.expr(_REST)]
    lines = placed.select(
        "n", "rule", "place", F.xxhash64(F.lit(1), "high", *rest).alias("high"), F.xxhash64(F.lit(2), "low", *rest).alias("low")
    )
    key = ["high", "low"]
    hubs = lines.groupBy(*key).agg(F.min(F.when(F.col("place") >= 0, F.col("n"))).alias("n_b"), F.count("*").alias("size"))
    hubs = hubs.filter("size > 1 AND n_b IS NOT NULL").select(*key, "n_b")
    linked = join_by_key(lines.select("n", "rule", *key), hubs, key, "inner").filter("n <> n_b").select("n", "n_b", "rule")
    named = [F.when(_equal(rule.equal).isNotNull() & alike(F.col(f"a.{rule.field}"), F.col(f"b.{rule.field}")), F.lit(rule.name)) for rule in rules]
    names = F.array(*[F.lit(rule.name) for rule in rules])
    return (
        with_fields(linked, narrow)
        .filter("id_a <> id_b")
        .filter(F.coalesce(*[_equal(rule) for rule in exact]).isNull())
        .withColumn("agreeing", F.array_compact(F.array(*named)))
        .filter(F.get("agreeing", F.lit(0)) == F.get(names, F.col("rule")))
        .select("id_a", "id_b", "a", "b", F.array_join("agreeing", ", ").alias("rules"))
    )


def similar_scores(
    candidates: DataFrame, weights: Mapping[str, float] = MATCH_WEIGHTS, similar: Mapping[str, float] = SIMILAR_WEIGHTS
) -> DataFrame:
    """``id_a, id_b, score, confidence, rules`` like ``resolution.pair_scores``: ``score`` adds the weights of equal fields
    and the largest worth of a similar one."""
    worth = [F.when(alike(F.col(f"a.{f}"), F.col(f"b.{f}")), F.lit(w)).otherwise(F.lit(0.0)) for f, w in similar.items()]
    most = F.greatest(*worth) if len(worth) > 1 else worth[0] if worth else F.lit(0.0)
    scored = pair_scores(candidates.withColumn("rules", F.struct("rules", most.alias("worth"))), weights)
    return scored.select("id_a", "id_b", (F.col("score") + F.col("rules.worth")).alias("score"), "confidence", F.col("rules.rules").alias("rules"))
