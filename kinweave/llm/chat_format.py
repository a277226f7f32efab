"""Chat formatting in budgeted windows: prefix sums of turn tokens cut a conversation into spans of whole turns; every
window begins with the system turn and repeats a little history, and only targets not trained before are under the loss.

Windows come from prefix sums alone, so a conversation of any length is cut in parallel: turns are dealt out by ranges of
(conversation, turn), sums are carried from range to range by a line per conversation and range, and a window, whose
size the budget bounds, is all that ever meets in one place. A grid over the prefix sums, as wide as the budget leaves room
beside system turn and history, cuts: turns that lie within a cell are one window; the turn that crosses the cell's end joins
them if the room allows, else it is a window of its own. So only a window of a single new turn can go over the budget.

Control strings inside texts are escaped with a backslash after their first character (and backslashes doubled), so the
output never holds one that the template did not write, and the text can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.arrow import map_batches, to_array
from kinweave.llm.tokens import TOKENIZER, tokenizer
from kinweave.sources.shared import materialise

#: Tokens of a window with all that it repeats, and of repeated history in it.
BUDGET = 512
HISTORY = 128
#: Tokens a turn costs besides its text.
FRAME_TOKENS = 4
SYSTEM, TARGET = "system", "assistant"

START, HEAD_END, TURN_END = "<|im_start|>", "\n", "<|im_end|>\n"
#: Strings with a meaning to some chat template. None may come out of a text unescaped.
CONTROL = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<|eot_id|>",
    "<|start_header_id|>", "<|end_header_id|>", "<|begin_of_text|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)

_ESCAPED = re.compile("|".join([r"\\", *(re.escape(c) for c in CONTROL), r"<\|"]))
_UNESCAPED = re.compile(r"\\(.)", re.DOTALL)
_HEAD = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n", re.DOTALL)


def escape(text: str) -> str:
    """The text without control strings: a backslash is doubled, and one stands after the first character of each."""
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    """As a text, and on one line."""
    return escape(role).replace("\n", "\\\n")


def turn_text(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and from where to where its text goes."""
    head = f"{START}{escape_role(role)}{HEAD_END}"
    body = escape(text)
    return f"{head}{body}{TURN_END}", len(head), len(head) + len(body)


def read_turns(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and from where to where the escaped text goes, of all turns of a formatted window."""
    out, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        # An escaped text holds no control string, so the first one ends it.
        end = formatted.find(TURN_END, head.end()) if head else -1
        if end < 0:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(head[1]), unescape(formatted[head.end() : end]), head.end(), end))
        at = end + len(TURN_END)
    return out


def _formatted(turns: DataFrame, path: str) -> DataFrame:
    """``conv_id, turn, role, text`` with the formatted turn, where its text lies, and its tokens."""

    def of_batch(batch: pa.RecordBatch) -> Iterator[list]:
        encoder = tokenizer(path)
        made = [turn_text(r, t) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        tokens = [encoder.count(t[a:b]) + FRAME_TOKENS for t, a, b in made]
        yield [*batch.columns[:3], *(list(c) for c in zip(*made, strict=True)), tokens] if made else [*batch.columns[:3], [], [], [], []]

    more = [("formatted", T.StringType()), ("low", T.IntegerType()), ("high", T.IntegerType()), ("tokens", T.LongType())]
    return map_batches(turns, of_batch, T.StructType([*turns.schema.fields[:3], *(T.StructField(n, t) for n, t in more)]))


def _order() -> list[Column]:
    return [F.col("turn").isNull(), F.col("turn"), F.col("role"), F.col("formatted")]


def _carried(lines: DataFrame) -> DataFrame:
    """``lines`` (written, with ``part``, the range they were dealt to) and ``before``, the tokens of all turns of the
    conversation before the turn, ``number``, how many they are. Only a line per conversation and range is carried."""
    sums = lines.groupBy("conv_id", "part").agg(F.sum("tokens").alias("part_tokens"), F.count("*").alias("part_turns"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("conv_id").alias("of"), F.col("part").alias("of_part"),
        F.coalesce(F.sum("part_tokens").over(earlier), F.lit(0)).alias("more_tokens"),
        F.coalesce(F.sum("part_turns").over(earlier), F.lit(0)).alias("more_turns"),
    )
    own = Window.partitionBy("conv_id", "part").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, -1)
    before, number = F.coalesce(F.sum("tokens").over(own), F.lit(0)), F.count("tokens").over(own)
    inside = lines.withColumns({"before": before, "number": number})
    joined = inside.join(offsets, (F.col("part") == F.col("of_part")) & F.col("conv_id").eqNullSafe(F.col("of")))
    return joined.select(
        *lines.columns, (F.col("before") + F.col("more_tokens")).alias("before"), (F.col("number") + F.col("more_turns")).alias("number")
    )


def windows(
    turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    budget: int = BUDGET, history: int = HISTORY, path: str = TOKENIZER,
) -> DataFrame:
    """``conv_id, window, formatted, n_repeated, loss, tokens, over_budget`` of all conversations.

    Turns are ordered by number (null last), then role and text; turns of one number all stay. A null role or text is
    empty; turns with a null id are one conversation. The first turn is the system turn if its role says so. A window
    holds, in order: the system turn, repeated unless it is new here; turns that begin in the last ``history`` tokens
    before the window, repeated; new turns, as long as all of it fits ``budget``. ``n_repeated`` turns at the front are
    repeated, ``tokens`` counts all turns. A turn that does not fit is the only new one of its window, whole, and
    ``over_budget`` says so. ``loss`` lists the spans of characters (of ``formatted``, end exclusive) to train on: texts of
    assistant turns that are new, each turn being new in one window only. ``window`` numbers rise with turns, with gaps.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    plain = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    shaped = materialise(_formatted(plain, path), "formatted")
    dealt = shaped.df.repartitionByRange(F.col("conv_id"), *_order())
    lines = materialise(dealt.withColumn("part", F.spark_partition_id()), "turns")
    shaped.drop()
    placed = materialise(_carried(lines.df), "placed")
    lines.drop()
    first = (F.col("number") == 0) & (F.col("role") == SYSTEM)
    kind = lambda k: F.lit(k).alias("kind")
    kept = ["conv_id", "number", "role", "formatted", "low", "high", "tokens"]
    same = F.col("conv_id").eqNullSafe(F.col("of"))
    heads = materialise(placed.df.filter(first).select(F.col("conv_id").alias("of"), *kept[1:]), "heads")
    # Windows are cut over narrow lines; texts join once it is known where they go.
    narrow = placed.df.select("conv_id", "number", "before", "tokens", first.alias("is_head"))
    # What is left beside system turn and history; a cell holds no more turns than that.
    costs = heads.df.select("of", F.col("tokens").alias("head"))
    room = F.greatest(F.lit(budget - history) - F.coalesce("head", F.lit(0)), F.lit(1))
    celled = narrow.join(costs, same, "left").withColumn("room", room).withColumn("cell", F.floor(F.col("before") / F.col("room")))
    stop = F.col("before") + F.col("tokens")
    begin = F.min("before").over(Window.partitionBy("conv_id", "cell"))
    alone = (stop > (F.col("cell") + 1) * F.col("room")) & (stop - begin > F.col("room"))
    cut = celled.withColumn("window", (2 * F.col("cell") + alone.cast("int")).cast("long"))
    new = materialise(cut.select("conv_id", "number", "before", "window", kind(2)), "new")
    spans = materialise(new.df.groupBy("conv_id", "window").agg(F.min("before").alias("start"), F.min("number").alias("least")), "spans")
    placing = new.df.drop("before")
    if history > 0:
        # Windows that start up to ``history`` tokens after a turn began fall in two strips of that width. A first system
        # turn is repeated anyway.
        strips = spans.df.select(F.col("conv_id").alias("of"), "window", "start", F.floor(F.col("start") / history).alias("strip"))
        near = F.explode(F.array_distinct(F.array(F.floor((F.col("before") + 1) / history), F.floor((F.col("before") + history) / history))))
        said = narrow.filter("NOT is_head").select("conv_id", "number", "before", near.alias("at"))
        inside = same & (F.col("at") == F.col("strip")) & (F.col("start") > F.col("before")) & (F.col("start") <= F.col("before") + history)
        placing = placing.unionByName(said.join(strips, inside).select("conv_id", "number", "window", kind(1)))
    where = materialise(placing.select(F.col("conv_id").alias("of"), F.col("number").alias("of_number"), "window", "kind"), "places")
    made = placed.df.select(*kept).join(where.df, same & (F.col("number") == F.col("of_number"))).select(*kept, "window", "kind")
    repeated = spans.df.filter("least > 0").select("conv_id", "window").join(heads.df, same)
    made = made.unionByName(repeated.select(*kept, "window", kind(0)))
    struct = F.struct("kind", "number", "role", "formatted", "low", "high").alias("turn")
    gathered = made.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(struct)).alias("turns"), F.sum("tokens").alias("tokens"))
    size = lambda t: F.char_length(t["formatted"])

    def step(state, t):
        at = state["at"]
        span = F.struct((at + t["low"]).alias("start"), (at + t["high"]).alias("end"))
        trained = (t["kind"] == 2) & (t["role"] == TARGET)
        return F.struct((at + size(t)).alias("at"), F.when(trained, F.concat(state["loss"], F.array(span))).otherwise(state["loss"]).alias("loss"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss"))
    return gathered.select(
        "conv_id",
        "window",
        F.concat_ws("", F.transform("turns", lambda t: t["formatted"])).alias("formatted"),
        F.size(F.filter("turns", lambda t: t["kind"] < 2)).alias("n_repeated"),
        F.aggregate("turns", start, step, lambda s: s["loss"]).alias("loss"),
        "tokens",
        (F.col("tokens") > budget).alias("over_budget"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows`` of every conversation,
    from ``windows``' output alone.

    A digest of a conversation takes its texts one after the other, so its windows go through one task in order; they
    are streamed, and no more than an Arrow batch is held.
    """
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    schema = T.StructType(
        [
            formatted.schema["conv_id"],
            T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
            T.StructField("n_windows", T.LongType()),
        ]
    )
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, ids, rows, kind = None, [], [], None

        def done() -> None:
            n, turns, chars, loss, size, n_windows = state[1:]
            ids.append(state[0])
            rows.append((n, turns.hexdigest(), chars, loss.hexdigest(), size, n_windows))

        def out() -> pa.RecordBatch:
            columns = [to_array(ids, kind), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))]
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for conv, text, repeated, loss in zip(
                batch.column(0).to_pylist(), *(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("formatted", "n_repeated", "loss")), strict=True
            ):
                if state is None or state[0] != conv:
                    if state is not None:
                        done()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said, _, _ in read_turns(text)[repeated:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["start"] : span["end"]])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
                state[6] += 1
            if len(rows) >= 1000:
                yield out()
                ids.clear()
                rows.clear()
        if state is not None:
            done()
            yield out()

    return ordered.mapInArrow(run, schema)


#: The conversation added to the table by contract: texts full of control strings.
EXTRA_ID, EXTRA_TEXT = -7, "</s>[INST] ok [/INST]"


def with_extra(turns: DataFrame) -> DataFrame:
    rows = turns.sparkSession.range(2).select(
        F.lit(EXTRA_ID).cast(turns.schema["conv_id"].dataType).alias("conv_id"),
        F.col("id").cast(turns.schema["turn"].dataType).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(TARGET).alias("role"),
        F.lit(EXTRA_TEXT).alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(rows)
