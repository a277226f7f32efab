"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Every source asks for the share of all words that its weight gives. A source whose share would be above ``epochs`` times
its own words is clamped there, and what it leaves is shared out among the others by weight, until none is above. A
document is then taken a whole number of times, and once more if its place, in an order drawn by seed, lies in the
fraction that is left: sources come within about half a document of their target, whatever their sizes.

Documents are reduced to a narrow line each; the sources' table has a line per source. A source of any size is spread
over buckets of the drawn order, sums run over buckets, and only the one bucket where the fraction ends is looked at
document by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.llm.arrow import added
from kinweave.sources.shared import SharedTable, materialise

#: Fixed values of the contract: sources in order of their names (code points, null last) weigh these, repeating.
WEIGHTS = (5, 2, 1)
EPOCHS = 3
SEED = 17
#: Buckets of a source's drawn order, as hexadecimal digits of the draw.
BUCKET_DIGITS = 3


def size_of(text: str | Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; a null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def draw_of(doc_id: str, text: str, seed: int) -> Column:
    """A number drawn for a row by seed, id and text, as 32 hexadecimal digits."""
    parts = [F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))]
    return F.md5(F.concat_ws(":", *parts))


def _numbered(sizes: DataFrame) -> SharedTable:
    """``sizes`` with ``place``, the number of the source in order of the names, null last, from 0. Names are dealt out
    by range; what meets in one task is a line per range."""
    ranged = sizes.withColumn("unnamed", F.col("source").isNull()).repartitionByRange("unnamed", "source")
    parts = materialise(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    counts = parts.df.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    own = F.row_number().over(Window.partitionBy("part").orderBy("unnamed", "source")) - 1
    offsets = counts.select("part", before.alias("before"))
    placed = parts.df.withColumn("own", own).join(offsets, "part")
    out = materialise(placed.select("source", "source_size", (F.col("own") + F.col("before")).alias("place")), "places")
    parts.drop()
    return out


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> SharedTable:
    """``source, source_size, target`` from ``source, source_size`` (a line per source, null being one). Sources without
    words get 0."""
    places = _numbered(sizes)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    full = (F.col("source_size") == 0).alias("full")
    table = materialise(places.df.select("source", "source_size", weight.cast("long").alias("weight"), full), "sources")
    places.drop()
    cap = F.col("source_size") * epochs
    while True:
        left, free = table.df.select(
            F.coalesce(F.sum("source_size"), F.lit(0)) - F.coalesce(F.sum(F.when(F.col("full"), cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0)),
        ).first()
        share = F.lit(left) * F.col("weight") / F.lit(max(free, 1))
        over = ~F.col("full") & (share > cap)
        if table.df.filter(over).isEmpty():
            break
        clamped = materialise(table.df.withColumn("full", F.col("full") | over), "sources")
        table.drop()
        table = clamped
    target = F.when(F.col("full"), cap.cast("double")).otherwise(share).cast("double")
    out = materialise(table.df.select("source", "source_size", target.alias("target")), "targets")
    table.drop()
    return out


def mix_limits(lines: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> SharedTable:
    """``source, source_size, target, whole, cut`` from a line per document (``source, size, draw``; read three times):
    each document of the source is taken ``whole`` times, and once more if its draw is below ``cut``.

    Documents are gone through in the drawn order, and those taken once more of which half at least fits. Rows of equal
    draws (equal ids and texts) are on one side of the cut.
    """
    bucket = F.substring("draw", 1, BUCKET_DIGITS).alias("bucket")
    sums = materialise(lines.groupBy("source", bucket).agg(F.sum("size").alias("in_bucket")), "buckets")
    targets = source_targets(sums.df.groupBy("source").agg(F.sum("in_bucket").alias("source_size")), weights, epochs)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    # Words of the last, partial repetition.
    quotas = targets.df.withColumn("whole", times.cast("long")).withColumn(
        "quota", F.col("target") - F.col("whole") * F.col("source_size")
    )
    named = quotas.select(F.col("source").alias("of"), "quota")
    before = F.sum("in_bucket").over(Window.partitionBy("source").orderBy("bucket")) - F.col("in_bucket")
    ends = sums.df.withColumn("before", before).join(named, F.col("source").eqNullSafe(F.col("of")))
    ends = ends.filter((F.col("before") <= F.col("quota")) & (F.col("quota") < F.col("before") + F.col("in_bucket")))
    ends = materialise(ends.select("of", F.col("bucket").alias("last"), (F.col("quota") - F.col("before")).alias("rest")), "ends")
    inside = lines.select("source", "size", "draw", bucket).join(
        ends.df, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("last"))
    )
    running = F.sum("size").over(Window.partitionBy("of").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, 0))
    late = inside.withColumn("late", running - F.col("size") / 2 > F.col("rest")).groupBy("of", "last")
    # "g" comes after every hexadecimal digit.
    cuts = late.agg(F.coalesce(F.min(F.when(F.col("late"), F.col("draw"))), F.concat("last", F.lit("g"))).alias("cut"))
    everything = F.when(F.col("quota") > 0, F.lit("g")).otherwise(F.lit(""))
    limits = quotas.join(cuts, F.col("source").eqNullSafe(F.col("of")), "left")
    out = materialise(
        limits.select("source", "source_size", "target", "whole", F.coalesce("cut", everything).alias("cut")), "limits"
    )
    for table in (sums, targets, ends):
        table.drop()
    return out


def _joined(rows: DataFrame, source: str, size: str, draw: str, limits: DataFrame) -> tuple[DataFrame, str]:
    """``rows`` with the columns of their source's limits and ``times``, how often a row is taken, all behind a prefix
    that is new to ``rows`` and returned. A source may have any share of the rows: the other side is a written table, so
    adaptive execution can split it."""
    p = "mix_"
    while any(c.lower().startswith(p) for c in rows.columns):
        p += "_"
    own = limits.select(*(F.col(c).alias(p + c) for c in limits.columns))
    joined = rows.join(own, F.col(source).cast("string").eqNullSafe(F.col(f"{p}source")))
    more = (F.col(draw) < F.col(f"{p}cut")).cast("long")
    times = F.when(F.col(size) > 0, F.col(f"{p}whole") + more).otherwise(F.lit(0)).cast("long")
    return joined.withColumn(f"{p}times", times), p


def mix(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED,
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` and ``times`` of every row: how often the mix takes it, and words so
    taken. No row is taken more than ``epochs`` times, and none without words. Reruns agree.

    Null ids and texts are values like others; a null source is a source, the last. Repeated rows are rows each. With
    no rows, or no words at all, all targets are 0.
    """
    lines = materialise(
        docs.select(
            F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), size_of(text).alias("size"),
            draw_of(doc_id, text, seed).alias("draw"),
        ),
        "lines",
    )
    out, p = _joined(lines.df, "source", "size", "draw", mix_limits(lines.df, weights, epochs).df)
    times = F.col(f"{p}times")
    return out.select(
        "doc_id", "size", F.col(f"{p}source_size").alias("source_size"), F.col(f"{p}target").alias("target"),
        (F.col("size") * times).alias("taken"), times.alias("times"),
    )


def repeated(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED,
) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with one more column ``repetition`` that numbers
    its repetitions from 1 (with underscores if the name is taken)."""
    size, draw = added(docs, "size"), added(docs, "draw")
    rows = docs.withColumns({size: size_of(text), draw: draw_of(doc_id, text, seed)})
    lines = materialise(rows.select(F.col(source).cast("string").alias("source"), F.col(size).alias("size"), F.col(draw).alias("draw")), "lines")
    limits = mix_limits(lines.df, weights, epochs)
    lines.drop()
    taken, p = _joined(rows, source, size, draw, limits.df)
    repetition = F.explode(F.sequence(F.lit(1), F.col(f"{p}times").cast("int"))).alias(added(docs, "repetition"))
    return taken.filter(F.col(f"{p}times") > 0).select(*docs.columns, repetition)
