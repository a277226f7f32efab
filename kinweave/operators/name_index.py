"""Name search over a stored index of q-grams: names within an edit distance, without comparing every name.

Names are folded (outer blanks off, small letters) and cut into pairs of letters, with a mark before the first letter and
after the last; an equal pair that comes again is numbered. A name that is alike enough to a target shares at least so many
pairs with it that it must hold one of the target's few rarest ones (as many as may be missing, and one more). Only these
are looked up; what they find is compared exactly. Frequent pairs are hardly ever touched, and nothing is capped: a name
that holds none of the rare pairs cannot be alike enough.

Where names are dense (numbered ones differ in a few figures), even rare pairs are held by a share of all names. So a target
is first looked up among the names at most one edit away, by whole texts with one letter out: such a key is held by no more
names than there are letters, however many names there are. As no farther name can be as close, only targets without such a
name are searched by their pairs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinweave.functions.skew import join_by_key
from kinweave.sources.shared import SharedTable, materialise

#: Letters of a gram. A likeness above 1 - 1 / Q always leaves a gram to share.
Q = 2
_BEFORE, _AFTER = "\u0002", "\u0003"


def folded(text: Column) -> Column:
    return F.lower(F.trim(text))


def grams(text: Column) -> Column:
    """The numbered grams of a folded text: as many as it has letters, and one more."""
    marked = F.concat(F.lit(_BEFORE), text, F.lit(_AFTER))
    plain = F.transform(F.sequence(F.lit(1), F.char_length(text) + 1), lambda i: F.substring(marked, i, F.lit(Q)))
    seen = lambda g, i: F.size(F.filter(F.slice(plain, F.lit(1), i), lambda x: x == g))
    return F.transform(plain, lambda g, i: F.concat(g, seen(g, i).cast("string")))


def closeness(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.char_length(a), F.char_length(b))


def _without(text: Column, at: Column) -> Column:
    """The text without its letter at a position from 1 on."""
    return F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + 1, F.char_length(text)))


def _edit_keys(text: Column, wanted: bool) -> Column:
    """Hashes of a name (or a wanted name), of which two texts share one if they are equal or one edit apart."""
    places = F.sequence(F.lit(1), F.char_length(text))
    key = lambda kind, at, rest: F.xxhash64(F.lit(kind), at, rest)
    shorter = F.transform(places, lambda i: key("shorter" if wanted else "longer", F.lit(0), _without(text, i)))
    replaced = F.transform(places, lambda i: key("replaced", i, _without(text, i)))
    # A name with one letter less is a wanted one's text without a letter, and the other way round.
    own = [key("shorter", F.lit(0), text), *([key("longer", F.lit(0), text)] if wanted else [])]
    return F.array_distinct(F.concat(F.array(*own), shorter, replaced))


@dataclass(frozen=True)
class NameIndex:
    """A stored index; drop it when it is no longer searched."""

    #: ``c, name``: folded names, each with the first of the names that fold to it.
    names: SharedTable
    #: ``gram, name, length``; the length is that of the folded name.
    grams: SharedTable
    #: ``gram, n``: how many names hold it.
    counts: SharedTable

    def drop(self) -> None:
        for table in (self.names, self.grams, self.counts):
            table.drop()

    def search(self, targets: DataFrame | Sequence[str], min_score: float = 0.7) -> DataFrame:
        """``target, name, score``: the closest name of each target, of at least ``min_score`` (above 1 - 1 / Q); of
        equally close ones the first in sort order. Targets without such a name, null or blank have no line; repeated
        targets have one."""
        if not 1 - 1 / Q < min_score <= 1:
            raise ValueError(f"the least score is above {1 - 1 / Q} and at most 1")
        spark = self.names.df.sparkSession
        given = targets if isinstance(targets, DataFrame) else _as_rows(spark, targets)
        wanted = materialise(given.select("target", folded(F.col("target")).alias("t")).filter("t <> ''").distinct(), "wanted").df
        close = materialise(self._one_edit(wanted, min_score), "close").df
        rest = materialise(wanted.join(close, "target", "left_anti"), "rest").df
        return close.unionByName(self._by_grams(rest, min_score))

    def _one_edit(self, wanted: DataFrame, min_score: float) -> DataFrame:
        """The closest name of those targets that have one at most one edit away. With a least score above 1/2 no name
        farther away scores as much."""
        asked = wanted.select("target", "t", F.explode(_edit_keys(F.col("t"), True)).alias("key"))
        held = self.names.df.select("name", F.explode(_edit_keys(F.col("c"), False)).alias("key"))
        found = held.join(asked, "key").withColumn("c", folded(F.col("name"))).filter(F.levenshtein("t", "c", 1) >= 0)
        return _closest(found, min_score)

    def _by_grams(self, wanted: DataFrame, min_score: float) -> DataFrame:
        """The closest name of each target, by the rarest grams that a name alike enough must share."""
        size = F.char_length("t")
        # Lengths within reach, and the edits that a name of the target's length allows.
        low, high = F.ceil(size * min_score).cast("int"), F.floor(size / min_score).cast("int")
        allowed = F.floor((1 - F.lit(min_score)) * size + F.lit(1e-9)).cast("int")
        # An edit touches Q grams, so one of any Q * allowed + 1 is shared. A name d letters longer may allow (1 - 1 / Q) * d
        # edits more, rounded up, but has d grams of its own to lose: one more is enough.
        lines = wanted.select("target", "t", low.alias("low"), high.alias("high"), (Q * allowed + 2).alias("needed"), F.explode(grams(F.col("t"))).alias("gram"))
        known = join_by_key(lines, self.counts.df, ["gram"], "left")
        rarest = Window.partitionBy("target").orderBy(F.coalesce("n", F.lit(0)), "gram")
        asked = known.withColumn("place", F.row_number().over(rarest)).filter("place <= needed AND n IS NOT NULL")
        asked = asked.select("target", "t", "low", "high", F.col("gram").alias("of"))
        held = self.grams.df.join(asked, (F.col("gram") == F.col("of")) & F.col("length").between(F.col("low"), F.col("high")))
        # What a gram finds is compared where it is found: a name found by several is compared again, but not shuffled.
        return _closest(held.withColumn("c", folded(F.col("name"))), min_score)


def _closest(found: DataFrame, min_score: float) -> DataFrame:
    """``target, name, score`` of the best line of each target (``target, t, name, c``) that scores enough."""
    scored = found.withColumn("score", closeness(F.col("t"), F.col("c"))).filter(F.col("score") >= F.lit(float(min_score)))
    best = scored.groupBy("target").agg(F.min(F.struct((-F.col("score")).alias("score"), "name")).alias("best"))
    return best.select("target", F.col("best.name").alias("name"), (-F.col("best.score")).alias("score"))


def _as_rows(spark: SparkSession, targets: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(t,) for t in targets], "target string")


def build_index(names: DataFrame, column: str = "name") -> NameIndex:
    """Index the distinct names of a column; null and blank ones are left out."""
    rows = names.select(F.col(column).alias("name"), folded(F.col(column)).alias("c")).filter("c <> ''")
    own = materialise(rows.groupBy("c").agg(F.min("name").alias("name")), "names")
    cut = own.df.select(F.explode(grams(F.col("c"))).alias("gram"), "name", F.char_length("c").alias("length"))
    # Names of one gram lie together, so that a search reads few files' row groups.
    stored = materialise(cut.repartitionByRange("gram", "length", "name").sortWithinPartitions("gram", "length"), "grams")
    return NameIndex(own, stored, materialise(stored.df.groupBy("gram").agg(F.count("*").alias("n")), "gram-counts"))
