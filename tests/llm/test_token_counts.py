import numpy as np
import pytest

from kinweave.llm import token_counts as C
from kinweave.llm.tokens import tokenizer
from tests.llm.conftest import ODD


def test_counts_add_up_and_spans_give_the_text(odd):
    rows = C.section_tokens(odd.filter("doc_id IN (1, 2, 5, 8, 11, 12)")).collect()
    for doc_id, text, _ in ODD:
        if doc_id in (1, 2, 5, 8, 11, 12):
            own = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.section)
            assert [r.section for r in own] == list(range(len(own)))
            assert "".join((text or "")[r.start : r.end] for r in own) == (text or "")
            assert sum(r.n_tokens for r in own) == tokenizer().count(text or "")


@pytest.mark.parametrize("rule", C.RULES)
def test_crossing_tokens_go_by_rule(rule):
    tokens, sections = np.array([2, 6, 7, 10]), np.array([3, 7, 7, 10])
    where, crosses = C.assign(tokens, sections, rule)
    # The token from 2 to 6 has 1 byte in the first section and 3 in the second.
    assert where.tolist() == {"most": [0, 1, 1, 3], "first": [0, 0, 1, 3], "last": [0, 1, 1, 3]}[rule]
    assert crosses.tolist() == [False, True, False, False]


def test_a_tie_goes_to_the_first():
    assert C.assign(np.array([4]), np.array([2, 4]), "most")[0].tolist() == [0]


def test_fields_are_sections_too(spark):
    docs = spark.createDataFrame([(1, "Title é", "one\ntwo\n\nthree"), (2, None, None), (3, "t", "")], "doc_id int, title string, text string")
    rows = C.section_tokens(docs, ["title", "text"]).collect()
    first = sorted((r.section, r.field, r.start, r.end) for r in rows if r.doc_id == 1)
    assert first == [(0, "title", 0, 7), (1, "text", 0, 4), (2, "text", 4, 8), (3, "text", 8, 9), (4, "text", 9, 14)]
    assert sum(r.n_tokens for r in rows if r.doc_id == 1) == tokenizer().count("Title é\none\ntwo\n\nthree")
    assert sum(r.n_tokens for r in rows if r.doc_id == 2) == 1


def test_nothing(nothing):
    assert C.section_tokens(nothing).count() == 0
    with pytest.raises(ValueError):
        C.section_tokens(nothing, rule="none")
