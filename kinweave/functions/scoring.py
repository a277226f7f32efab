"""PII completeness: presence bits, weighted scores and levels."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default weight of each identity column.
WEIGHTS: dict[str, float] = {
    "given_name": 0.5,
    "surname": 0.5,
    "email": 1.5,
    "phone": 1.5,
    "address": 1.0,
    "birthdate": 1.0,
}

# Lowest score of each level.
LEVELS: dict[str, float] = {
    "0. unknown": 0.0,
    "1. anonymous": 1.5,
    "2. partial": 2.5,
    "3. known": 3.5,
}


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)


def completeness(weights: Mapping[str, float] = WEIGHTS) -> Column:
    """Sum of the weights of the columns that are not null (an empty string counts as present)."""
    return _total(
        [F.when(F.col(c).isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0)) for c, w in weights.items()]
    )


#: Weighted columns told by one number.
WORD = 62


def bit_names(weights: Mapping[str, float] = WEIGHTS, prefix: str = "bits") -> list[str]:
    """The columns that hold the presence bits: ``bits``, and ``bits_1`` and so on for more than ``WORD`` weights."""
    return [prefix, *(f"{prefix}_{i}" for i in range(1, -(-len(weights) // WORD)))]


def presence_bits(weights: Mapping[str, float] = WEIGHTS) -> list[Column]:
    """One bit per weighted column, set where the column is not null, in the columns ``bit_names``.

    ``bit_or`` of these bits over a group says which columns the whole group holds. It is the same
    question as ``max(column) IS NOT NULL`` for each column, answered by fixed-width numbers, so the
    aggregation stays a hash aggregate and no strings are shuffled.
    """
    columns, words = list(weights), []
    for at, name in enumerate(bit_names(weights)):
        terms = [
            F.when(F.col(c).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
            for i, c in enumerate(columns[at * WORD : (at + 1) * WORD])
        ]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), terms, F.lit(0).cast("bigint")).alias(name))
    return words


def bits_score(weights: Mapping[str, float] = WEIGHTS, prefix: str = "bits") -> Column:
    """The score ``completeness`` would give a row holding exactly the columns set in the bits of this prefix."""
    names = bit_names(weights, prefix)
    return _total(
        [
            F.when(F.col(names[i // WORD]).bitwiseAND(F.lit(1 << i % WORD)) != 0, F.lit(float(w))).otherwise(F.lit(0.0))
            for i, w in enumerate(weights.values())
        ]
    )


def classify(score: Column, levels: Mapping[str, float] = LEVELS) -> Column:
    """Name of the highest level whose lower bound the score reaches; null below the lowest."""
    if not levels:
        return F.lit(None).cast("string")
    ranked = sorted(levels.items(), key=lambda item: item[1], reverse=True)
    branches = [F.when(score >= F.lit(float(bound)), F.lit(name)) for name, bound in ranked]
    return F.coalesce(*branches)


def share_percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """``part`` in percent of ``whole``, null where there is no whole."""
    return F.round(F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double")), digits)


def percent_text(value: Column) -> Column:
    """A rounded percentage as text, null stays null."""
    return F.concat(value.cast("string"), F.lit("%"))


def count_text(value: Column) -> Column:
    """A count with thousands separators, null stays null."""
    return F.format_number(value, 0)
