"""Repairs against all edits of small conversations, and against a plain dynamic programme on whole tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinweave.llm import queries, repair
from tests.llm.conftest import table

GOOD = re.compile("(s?(ua)+)?")


def _edits(rows, audit, cost, initials, longest):
    """All ways to edit the rows, with up to ``longest`` initials."""
    if len(initials) <= longest:
        if not rows:
            yield cost, audit, initials
        else:
            (initial, fault), *rest = rows
            yield from _edits(rest, audit + "D", cost + 4, initials, longest)
            if fault not in (repair.BLANK, repair.DUPLICATE):
                more = cost + 3 * (fault == repair.CUT)
                yield from _edits(rest, audit + "K", more, initials + initial, longest)
                for new in "ua":
                    yield from _edits(rest, audit + "R", more + 3, initials + new, longest)
        for new in "ua":
            yield from _edits(rows, audit + "I", cost + 3, initials + new, longest)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suat"), st.integers(0, 3)), max_size=4))
def test_agenda_against_all_edits(rows):
    # Deleting all costs 4 a row, so no more insertions than that pays for can be cheaper.
    expected = min((c, a) for c, a, w in _edits(rows, "", 0, "", len(rows) + 2) if GOOD.fullmatch(w))
    ((_, found),) = repair.lightest(rows, repair.START, repair.ACCEPT).items()
    assert found == expected


def _ways(rows):
    """Lightest weight by state, by one step after the other: insertions, then the row."""
    best = {repair.START: (0, "")}

    def grow(best):
        for _ in range(3):
            for q, (cost, audit) in list(best.items()):
                for x, to in repair.STEP[q].items():
                    if x in "ua" and (to not in best or (cost + 3, audit + "I") < best[to]):
                        best[to] = (cost + 3, audit + "I")
        return best

    for initial, fault in rows:
        new = {}
        for q, (cost, audit) in grow(best).items():
            options = [(cost + 4, audit + "D", q)]
            if fault not in (repair.BLANK, repair.DUPLICATE):
                more = cost + 3 * (fault == repair.CUT)
                options += [(more + (0 if e == "K" else 3), audit + e, to) for x, to in repair.STEP[q].items() for e in "KR" if (x == initial if e == "K" else x in "ua")]
            for cost_, audit_, to in options:
                if to not in new or (cost_, audit_) < new[to]:
                    new[to] = (cost_, audit_)
        best = new
    best = grow(best)
    return min(best[q] for q in repair.ACCEPT if q in best)


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        say = lambda v: " " if v is None else str(v)
        damage = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
        role, text = say(role), say(text)
        if damage == 1:
            text = ""
        if damage == 2:
            text = re.sub("[.!?]", "", text)
        if damage == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if damage == 0 else 2 if damage == 3 else 1)
    return out


def _brute(original, rows):
    by = {conv: [] for conv, *_ in original}
    for conv, *row in rows:
        by[conv].append(tuple(row))
    out = []
    for conv, own in by.items():
        md5 = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], md5(r)))
        seen, marks, count = set(), [], defaultdict(int)
        for _, role, text in own:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = repair.BLANK if not shown else repair.DUPLICATE if (role, text) in seen else repair.CUT if shown[-1] not in ".!?" else repair.SOUND
            seen.add((role, text))
            count[fault] += 1
            marks.append((role[:1], fault))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = _ways(marks)
        left, said, state = iter(own), [], ""
        for e in audit:
            _, role, text = (None, "", "") if e == "I" else next(left)
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if state == "u" else "user"
            state = role[:1]
            said.append(f"{role}:{text}")
        assert GOOD.fullmatch("".join(s[0] for s in said))
        sha = hashlib.sha256("\n".join(said).encode()).hexdigest()
        out.append((conv, gaps, count[repair.BLANK], count[repair.DUPLICATE], count[repair.CUT], illegal, cost, audit, sha))
    return sorted(out, key=repr)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s", "u", "a", "t", ""]), st.integers(0, 3)), max_size=30), st.lists(st.integers(1, 9), max_size=12))
def test_pieces_join_to_the_whole(rows, sizes):
    pieces, at = [], 0
    for size in itertools.chain(sizes, [1000]):
        part, at = rows[at : at + size], at + size
        if part:
            pieces.append({(a, b): w for a in repair.STEP for b, w in repair.lightest(part, a).items()})
    cost, audit, parts = repair.derive(pieces)
    assert (cost, audit) == _ways(rows) and audit == "".join(p for _, p in parts)


def test_fault():
    assert [repair.fault_of(t, False) for t in ("", " \t", "a.", "a. ", "a", "a!" + " " * 100, "x?\x0b", "a. ")] == [1, 1, 0, 0, 3, 0, 0, 3]
    assert repair.fault_of("a", True) == repair.DUPLICATE and repair.fault_of(" ", True) == repair.BLANK


def test_whole_table(spark, data, rows):
    turns = table(spark, data, "conversations")
    given_ = [tuple(r) for r in turns.collect()]
    got = queries.QUERIES["op13_conversation_repair"](spark, data)
    assert rows(got) == _brute(given_, _damaged(given_))


@pytest.fixture(scope="module")
def odd_turns(spark):
    """Nulls everywhere, ties of turns, repeated rows, unknown and empty roles, a long conversation of repeated and of
    different rows, a long text, conversations that lose every row."""
    draw = random.Random(5)
    said = ["Yes.", "No", "", " ", None, "What?", "Ok!  ", "x" * 70 + "a.", "x" * 70 + "b", "Zeile\numbruch."]
    who = ["system", "user", "assistant", "tool", "", None, "u", "agent"]
    made = [(draw.choice([1, 2, None]), draw.choice([None, 0, 1, 2, 9]), draw.choice(who), draw.choice(said)) for _ in range(150)]
    made += [(5, t, draw.choice(["user", "assistant"]), f"Turn {t}{draw.choice(['.', ''])}") for t in range(2500)]
    made += [(6, t % 7, "user", "Same.") for t in range(1500)]
    made += [(7, t, ("user", "assistant")[t % 2], "long " * 300_000 + ".") for t in range(4)]
    made += [(100 + c, t, draw.choice(who[:3]), draw.choice(said)) for c in range(60) for t in range(draw.randint(1, 3))]
    return made, spark.createDataFrame([(*m, 1, "x", 0) for m in made], "conv_id bigint, turn bigint, role string, text string, cost int, audit string, part int").repartition(5)


def test_odd_conversations(odd_turns, rows):
    made, df = odd_turns
    assert rows(repair.damaged_and_repaired(df)) == _brute(made, _damaged(made))


@pytest.mark.parametrize("size", [20_000, 1 << 30])
def test_any_ranges(odd_turns, rows, size):
    """The same repairs from many ranges and from one."""
    made, df = odd_turns
    plain = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in made]
    assert rows(repair.repair(df, range_bytes=size)) == _brute(plain, plain)


def test_no_rows(odd_turns):
    _, df = odd_turns
    assert repair.damaged_and_repaired(df.limit(0)).collect() == []
