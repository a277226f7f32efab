"""The registered queries over whole tables: against their SQL, or against plain Python where they have none."""

import hashlib
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from checks import compare
from kinweave.llm import chat_format, mixing, quality_classifier, quality_rules, queries, url_filter
from tests.llm.conftest import VISIBLE, table, words
from tests.llm.test_license_scan import _base
from tests.llm.test_mixing import _targets
from tests.llm.test_url_filter import _brute



@pytest.fixture(scope="module")
def small(data):
    return data.replace("sf0.01", "sf0.001")


@pytest.fixture(scope="module")
def near():
    """All links by an index of shingles."""

    def links(texts):
        sets = {}
        for i, text in texts.items():
            w = words(text)
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        having = defaultdict(list)
        for i, some in sets.items():
            for s in some:
                having[s].append(i)
        parent, count = {i: i for i in sets}, Counter()

        def find(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for i, some in sets.items():
            for j, n in Counter(j for s in some for j in having[s]).items():
                if i != j and n >= 0.8 * (len(some) + len(sets[j]) - n):
                    count[i] += 1
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
        return {i: (find(i), count[i]) for i in sets}

    return links


def test_all_are_registered():
    registered = contract.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(registered)
    assert set(queries.ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, data, name):
    assert compare.differences(queries.QUERIES[name](spark, data), compare.connect(data), queries.ORACLES[name]) == []


def test_license_scan(spark, data):
    texts = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    rows = queries.QUERIES["op1_license_scan"](spark, data).collect()
    assert {r.doc_id: tuple(r)[1:6] for r in rows} == {i: _base(t) for i, t in texts.items()}
    for r in rows:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and (r.score == 1) == bool(r.labels)


def test_token_counts(spark, small):
    rows = queries.QUERIES["op2_token_counts"](spark, small).collect()
    lines = defaultdict(dict)
    for r in rows:
        lines[r.doc_id][r.section] = r
    for r in table(spark, small, "documents").collect():
        own = lines[r.doc_id]
        assert "".join(r.text[own[k].start : own[k].end] for k in range(len(own))) == r.text


def test_chat(spark, data):
    by = defaultdict(list)
    for r in chat_format.with_extra(table(spark, data, "conversations")).collect():
        by[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    rows = queries.QUERIES["op3_chat_format"](spark, data).collect()
    assert len(rows) == len(by)
    for r in rows:
        turns = sorted(by[r.conv_id])
        said = "".join(x for _, role, x in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(said)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.formatted_chars > sum(len(x) for _, _, x in turns)


def test_near_duplicates(spark, data, near):
    texts = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    rows = queries.QUERIES["op6_ngram_jaccard_join"](spark, data).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == near(texts)


def test_urls(spark, data):
    urls = {r.page_id: r.url for r in table(spark, data, "pages").collect()}
    rows = queries.QUERIES["op8_url_filter"](spark, data).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, (rule, verdict) = _brute(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("allow" if r.score >= url_filter.THRESHOLD else "block"))


def _without(text, phrases):
    """The text without the spans of its words that phrases of ten words or fewer cover."""
    spans, w = [m.span() for m in _words(text)], words(text)
    hit = set()
    for p in phrases:
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                hit |= set(range(i, i + len(p)))
    out, at = [], 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out.append(text[at : spans[i][0]])
        at = spans[i][1]
    return "".join([*out, text[at:]])


def _words(text):
    from tests.llm.conftest import ALNUM, LOWER

    return ALNUM.finditer(text.translate(LOWER))


def test_pipeline(spark, small, near):
    docs, labels = table(spark, small, "documents"), table(spark, small, "labels")
    rules = quality_rules.judged(docs, quality_rules.fit_lines(docs, labels))
    kept = {r.doc_id for r in rules.filter("kept").collect()}
    good = quality_classifier.scored(docs, quality_classifier.fit_quality(docs, labels)).filter("predicted = 1")
    kept &= {r.doc_id for r in good.collect()}
    given = {r.doc_id: r for r in docs.collect()}
    classes = near({i: given[i].text for i in kept})
    kept = {i for i in kept if classes[i][0] == i}
    phrases = []
    for r in table(spark, small, "benchmark").collect():
        w = words(r.text)
        phrases += [w[k : k + 10] for k in range(max(1, len(w) - 9))] if w else []
    texts = {i: _without(given[i].text, phrases) for i in kept}
    sizes = defaultdict(int)
    for i in kept:
        sizes[given[i].source] += len(VISIBLE.findall(texts[i]))
    targets = _targets(dict(sizes))
    out = corpus_pipeline.run(spark, small).collect()
    times = Counter(r.doc_id for r in out)
    assert set(times) <= kept and max(times.values()) <= 3
    taken = defaultdict(int)
    for r in out:
        assert r.text == texts[r.doc_id] and r.n_chars == len(r.text)
        assert (r.lang, r.source) == (given[r.doc_id].lang, given[r.doc_id].source)
        taken[r.source] += len(VISIBLE.findall(r.text))
    assert {(r.doc_id, r.repetition) for r in out} == {(i, k + 1) for i, n in times.items() for k in range(n)}
    for source, target in targets.items():
        largest = max(len(VISIBLE.findall(texts[i])) for i in kept if given[i].source == source)
        assert abs(taken[source] - target) <= largest
    assert mixing.EPOCHS == 3


def test_stages_of_odd_and_no_documents(spark, data, odd):
    """Every stage takes clashing columns, nulls and no rows, and all but the last return the columns of its input."""
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, data)
            assert out.count() <= 3 * docs.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "ngram_jaccard_join", "benchmark_decontamination", "source_mix"]
