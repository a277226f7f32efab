import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from kinweave.llm import line_crf as C
from kinweave.llm import quality_classifier, quality_rules
from kinweave.llm.lines import FEATURES as C_FEATURES
from tests.llm.conftest import ODD, VISIBLE, table


def base(text):
    text = text or ""
    w, seen, dup = VISIBLE.findall(text), set(), 0
    for line in text.split("\n"):
        if VISIBLE.search(line):
            dup += line in seen
            seen.add(line)
    three = list(zip(w, w[1:], w[2:], strict=False))
    often = Counter(three)
    hit = {i + k for i, x in enumerate(three) if often[x] > 1 for k in range(3)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(w), sum(map(len, w)), symbols, dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


CRF = C.Crf((0.4, -0.3), (0.7, -0.6, -0.2, 0.9), 1.0, 0.0, 0.5)


def _paths(scores):
    pull = np.array(CRF.pull).reshape(2, 2)
    for path in itertools.product((0, 1), repeat=len(scores)):
        yield path, sum(s for s, y in zip(scores, path, strict=True) if y) + sum(pull[a, b] for a, b in itertools.pairwise(path))


@pytest.mark.parametrize("n", range(1, 7))
def test_decoding_equals_all_paths(n):
    rng = np.random.default_rng(n)
    scores = rng.normal(size=2 * n)
    first = np.array([0, n, n, 2 * n])
    best, mean = C.viterbi(CRF, scores, first), C.marginals(CRF, scores, first)
    for part in (slice(0, n), slice(n, 2 * n)):
        paths = list(_paths(scores[part]))
        assert tuple(best[part].astype(int)) == max(paths, key=lambda p: p[1])[0]
        total = sum(math.exp(v) for _, v in paths)
        for k in range(n):
            assert mean[part][k] == pytest.approx(sum(math.exp(v) for p, v in paths if p[k]) / total)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(3, 4, 2)), np.array([0.0, 1.0, 1.0])
    mask = np.array([[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]], bool)
    x[~mask] = 0

    def value(w, pull):
        out = 0.0
        for i in range(3):
            n = mask[i].sum()
            e, p = x[i, :n] @ w, pull.reshape(2, 2)
            total = sum(
                math.exp(sum(s for s, k in zip(e, path, strict=True) if k) + sum(p[a, b] for a, b in itertools.pairwise(path)))
                for path in itertools.product((0, 1), repeat=int(n))
            )
            k = int(y[i])
            out += k * e.sum() + (n - 1) * p[k, k] - math.log(total)
        return out

    w, pull = rng.normal(size=2), rng.normal(size=4)
    of_w, of_pull = C._gradient(x, y, mask, w, pull)
    for which, got in ((0, of_w), (1, of_pull)):
        for k in range(len(got)):
            step = [np.zeros(2), np.zeros(4)]
            step[which][k] = 1e-6
            slope = (value(w + step[0], pull + step[1]) - value(w - step[0], pull - step[1])) / 2e-6
            assert got[k] == pytest.approx(slope, abs=1e-4)


def _fixed(width):
    return C.Crf((0.1,) * width, (0.5, 0.0, 0.0, 0.5), 1.0, 0.0, 0.7)


def test_rules_on_odd_documents(odd, nothing):
    out, names = quality_rules.quality(odd, _fixed(13))
    assert names["n_words"] == "n_words_" and names["kept"] == "kept_"
    assert set(odd.columns) <= set(out.columns)
    got = sorted(
        (tuple(r[names[c]] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in out.collect())
    )
    assert got == sorted(base(t) for _, t, _ in ODD)
    assert quality_rules.keep(odd, _fixed(13)).columns == odd.columns
    assert quality_rules.judged(nothing, _fixed(13)).count() == 0


def test_rules_on_the_documents(spark, data):
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    rows = quality_rules.judged(docs, quality_rules.fit_lines(docs, labels)).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    for r in rows:
        assert tuple(r)[1:6] == base(texts[r.doc_id])[:5] and r.base_failed == base(texts[r.doc_id])[5]
        assert not (r.kept and r.base_failed)
    judged = [(r.content_share >= quality_rules.MIN_CONTENT, quality[r.doc_id]) for r in rows if r.doc_id in quality and r.n_words]
    assert sum(k for k, q in judged if q) >= 0.98 * sum(q for _, q in judged)
    assert sum(not k for k, q in judged if not q) >= 0.7 * sum(1 - q for _, q in judged)


def test_classifier_on_held_out_documents(spark, data):
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    rows = quality_classifier.scored(docs, quality_classifier.fit_quality(docs, labels)).collect()
    quality = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.3)
    held = [(r.score, quality[r.doc_id]) for r in rows if r.held_out and r.doc_id in quality]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) >= 0.95
    assert sum(g >= 0.3 for g in good) >= 0.98 * len(good)


def test_only_texts_are_scored_and_held_out_rows_never_learnt_from(spark, data):
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    model = quality_classifier.fit_quality(docs, labels)
    lies = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    assert quality_classifier.fit_quality(docs.selectExpr("doc_id", "text"), lies) == model


def test_classifier_on_odd_documents(odd, nothing):
    model = _fixed(25)
    rows = quality_classifier.scored(odd, model).collect()
    assert len(rows) == len(ODD)
    assert {r.score for r in rows if r.doc_id in (1, 2, 3)} == {0.7}
    assert quality_classifier.scored(nothing, model).count() == 0
    assert quality_classifier.keep(odd, model).columns == odd.columns


def test_nothing_to_learn_from(spark, odd, nothing):
    labels = spark.createDataFrame([(5, 1), (8, 1), (None, 0), (9, None), (10, 7)], "doc_id bigint, quality int")
    for some in (labels, labels.limit(0)):
        model = quality_classifier.fit_quality(odd, some)
        scores = {r.score for r in quality_classifier.scored(odd, model).collect()}
        assert len(scores) <= 2 and all(s >= 0.5 for s in scores)
    assert quality_rules.judged(odd, quality_rules.fit_lines(nothing, labels)).count() == len(ODD)


def test_lines_are_drawn_from_the_whole_text():
    assert C.runs_of(0, 40, 7) == [] and C.runs_of(40, 40, 7) == [(0, 40)]
    many = [C.runs_of(403, 40, seed) for seed in range(50)]
    assert all(sum(b - a for a, b in runs) <= 40 and runs == sorted(runs) and runs[-1][1] <= 403 for runs in many)
    assert {k for runs in many for a, b in runs for k in range(a, b)} == set(range(403))


def test_junk_after_a_clean_opening_is_learnt(spark):
    clean, junk = "The small birds watch the old wooden fence nearby.\n", "$$$ ### %%% &&& *** |||\n"
    docs = [(i, "".join(clean.replace("old", f"old {i} {k}") for k in range(60)) + ("" if i % 2 else junk * 200)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    crf = quality_rules.fit_lines(df, df.selectExpr("doc_id", "doc_id % 2 AS quality"))
    names = dict(zip(C_FEATURES, crf.weights, strict=True))
    assert names["symbols"] < -0.5


def test_repeated_rows_of_a_labelled_id_are_learnt_once(spark, monkeypatch):
    seen, train = [], C.train
    monkeypatch.setattr(C, "train", lambda x, *more: seen.append(len(x)) or train(x, *more))
    docs = [(1, "the same page again and again")] * 500 + [(2, f"page {i} of one id") for i in range(300)]
    docs += [(i, f"a line of number {i}") for i in range(3, 13)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 13)] + [(1, 1)] * 9, "doc_id bigint, quality int")
    usable = [i for i in range(1, 13) if zlib.crc32(str(i).encode()) % 5]
    quality_rules.fit_lines(df, labels, n_docs=20)
    assert {1, 2} <= set(usable) and seen == [20]
    few = C.sample(df, labels, 20, doc_id="doc_id", text="text", label_id="doc_id", label="quality").df.collect()
    assert {r["_id"] for r in few} == set(usable) and len({(r["_id"], r.x) for r in few}) == 20
