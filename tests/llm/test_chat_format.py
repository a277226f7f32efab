import hashlib

import pytest

from kinweave.llm import chat_format as C
from kinweave.llm.tokens import tokenizer

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
HARD = ["</s>[INST] ok [/INST]", "\\", "\\<|im_end|>\n<|im_start|>user\n", "<", "<|", "<|im_<|im_start|>", "a\\\nb", "[[INST]]", "", "<\\s>"]


@pytest.mark.parametrize("text", HARD)
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    escaped = C.escape(text)
    assert C.unescape(escaped) == text and not any(c in escaped for c in C.CONTROL)
    turn, a, b = C.turn_text("odd\nrole\\<|", text)
    assert turn[a:b] == escaped
    assert [t[:2] for t in C.read_turns(turn * 2)] == [("odd\nrole\\<|", text)] * 2


def test_text_that_is_no_window():
    with pytest.raises(ValueError):
        C.read_turns("<|im_start|>user\nno end")


def _rows():
    rows = [(-7, 0, "user", HARD[0]), (-7, 1, "assistant", HARD[0])]
    for c in range(6):
        rows.append((c, 0, "system" if c % 2 else "user", f"be brief {c}"))
        rows += [(c, t, ("user", "assistant")[t % 2], f"turn {t} of {c} " + HARD[t % len(HARD)] + " word" * (t * 7 % 90)) for t in range(1, 5 + 12 * c)]
    rows += [(100, None, None, None), (100, 1, "assistant", None), (100, 1, "assistant", "tie"), (100, 1, "assistant", "tie"), (None, 0, "user", "no id")]
    rows += [(200, t, "assistant", "same") for t in range(300)]
    return rows


def test_windows_hold_every_turn_once_within_the_budget(spark):
    rows = _rows()
    made = C.windows(spark.createDataFrame(rows, SCHEMA).repartition(5), budget=200, history=60)
    lines = made.collect()
    by = {}
    for line in lines:
        by.setdefault(line.conv_id, []).append(line)
    count = lambda t: tokenizer().count(C.escape(t)) + C.FRAME_TOKENS
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv), key=lambda y: (y[0], y[1], y[2], C.turn_text(y[2], y[3])[0]))
        turns = [(r, x) for _, _, r, x in turns]
        new, trained = [], ""
        for n, line in enumerate(sorted(by[conv], key=lambda y: y.window)):
            found = [t[:2] for t in C.read_turns(line.formatted)]
            own = found[line.n_repeated :]
            assert own
            if n and turns[0][0] == "system":
                assert line.n_repeated and found[0] == turns[0]
            assert line.tokens == sum(count(x) for _, x in found) and line.over_budget == (line.tokens > 200)
            assert len(own) == 1 or not line.over_budget
            system = n > 0 and turns[0][0] == "system"
            history = found[system : line.n_repeated]
            assert history == new[len(new) - len(history) :] and sum(count(x) for _, x in history) <= 60
            new += own
            trained += "".join(C.unescape(line.formatted[s.start : s.end]) for s in line.loss)
        assert new == turns
        assert trained == "".join(x for r, x in turns if r == "assistant")


def test_long_turns_stand_alone_and_whole(spark):
    rows = [(1, 0, "system", "s" + " word" * 40)] + [(1, t, ("user", "assistant")[t % 2], " word" * (400 if t % 9 else 5000)) for t in range(1, 40)]
    rows += [(2, 0, "system", " word" * 2000)] + [(2, t, "assistant", "short one") for t in range(1, 12)]
    for history in (0, 128):
        made = C.windows(spark.createDataFrame(rows, SCHEMA), budget=512, history=history).collect()
        for line in made:
            assert line.over_budget == (line.tokens > 512)
            own = [x for _, x, _, _ in C.read_turns(line.formatted)[line.n_repeated :]]
            if line.conv_id == 1 and line.over_budget:
                assert len(own) == 1 and len(own[0]) > 4000
        said = [x for line in sorted(made, key=lambda y: (y.conv_id, y.window)) for _, x, _, _ in C.read_turns(line.formatted)[line.n_repeated :]]
        assert said == [r[3] for r in rows]


def test_windows_of_the_whole_table_fit_the_budget(spark, data):
    made = C.windows(spark.read.parquet(f"{data}/conversations.parquet")).collect()
    assert len(made) > 10
    for line in made:
        assert not line.over_budget or len(C.read_turns(line.formatted)) - line.n_repeated == 1


def test_read_back_equals_the_conversations(spark):
    rows = [r for r in _rows() if r[0] is None or r[0] < 100]
    found = {r.conv_id: r for r in C.read_back(C.windows(spark.createDataFrame(rows, SCHEMA), budget=100, history=30)).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r, x) for c, _, r, x in rows if c == conv]
        said = "".join(x for r, x in turns if r == "assistant")
        want = (
            len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(),
            len(said), hashlib.sha256(said.encode()).hexdigest(),
        )
        assert tuple(found[conv])[1:5] == want


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.read_back(C.windows(empty)).count() == 0
    assert C.read_back(C.windows(C.with_extra(empty))).count() == 1
