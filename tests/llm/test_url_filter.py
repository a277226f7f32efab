from random import Random

import pytest

from kinweave.llm import url_filter as U

URLS = [
    "http://www.example.com/en/1", "https://shop.EXAMPLE.com/en/2", "http://example.com/en", "http://example.com/de/1", "http://x.org/en/",
    "https://a.b.net/es/1?x=/fr/", "https://net/fr/", "http://notnet/fr/", "http://h.com", "http://h.com?q", "http://h.com#f", "no scheme com/",
    None, "", "://com/", "ftp://u@h.com:80/en/", "http://a.net/fr/x://b.com/y", "http://www.example.com/en/1", "http://ü.com/\nen/", "x" * 100_000,
]


def _brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, None)

JUNK_HOSTS = ["casino-bonus.example.org", "free-poker.example.com", "www.payday-loans.example.net", "cheap-pills.example.org", "m.xxx-cams.example.com"]
PLAIN_HOSTS = ["river-reading.example.org", "www.garden-museum.example.com", "history.example.net", "blog.forest-letters.example.org"]


@pytest.fixture(scope="module")
def model(spark):
    return U.train(spark)


def test_rules(spark, model):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string").selectExpr("*", "'x' AS host", "1 AS score", "'y' AS grams")
    for r in U.judge(pages, model).collect():
        host, path, (rule, verdict) = _brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("allow" if r.score >= U.THRESHOLD else "block"))


def test_the_model_knows_its_table_and_hosts_made_of_its_words(spark, model):
    known = U.labelled_urls()
    new = [("http://free-casino.example.org/de/5", 0), ("http://m.poker-bonus.example.org/en/77", 0), ("https://www.river-reading.example.org/fr/9", 1)]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(known + new)], "page_id bigint, url string")
    got = {r.page_id: r.score >= 0.5 for r in U.judge(df, model, rules=(("nowhere", "/", "block"),)).collect()}
    right = [got[i] == bool(y) for i, (_, y) in enumerate(known + new)]
    assert sum(right[: len(known)]) >= 0.98 * len(known) and all(right[len(known) :])


@pytest.mark.parametrize("length", [0, 10, 100, 200, 500, 2000])
def test_long_paths_change_no_host(spark, model, length):
    random, rows = Random(5), []
    for label, hosts in enumerate((JUNK_HOSTS, PLAIN_HOSTS)):
        for host in hosts:
            for _ in range(10):
                path = "".join(random.choices("abcdefghijklmnopqrstuvwxyz0123456789/-_.", k=length))
                rows.append((label, f"https://{host}/{path}"))
            words = "/".join((U.JUNK_WORDS if label else U.PLAIN_WORDS) * 10)
            rows.append((label, f"https://{host}/{words[:length]}"))
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    wrong = [r for r in U.judge(df, model, rules=(("nowhere", "/", "block"),)).collect() if (r.verdict == "allow") != bool(r.page_id)]
    assert not wrong


def test_paths_tell_when_hosts_do_not(spark, model):
    rows = [(0, f"https://kvuzip.example.org/en/{w}-{v}") for w, v in zip(U.JUNK_WORDS, U.JUNK_WORDS[9:], strict=False)]
    rows += [(1, f"https://kvuzip.example.org/en/{w}-{v}") for w, v in zip(U.PLAIN_WORDS, U.PLAIN_WORDS[9:], strict=False)]
    df = spark.createDataFrame(rows, "page_id bigint, url string")
    got = U.judge(df, model, rules=(("nowhere", "/", "block"),)).collect()
    assert sum((r.score >= 0.5) == bool(r.page_id) for r in got) >= 0.9 * len(got)


def test_plan_has_no_python(spark, model):
    df = spark.createDataFrame([(1, "http://a.org/")], "page_id bigint, url string")
    plan = U.judge(df, model)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_nothing(spark, model):
    assert U.judge(spark.createDataFrame([], "page_id bigint, url string"), model).count() == 0
    with pytest.raises(ValueError):
        U.train(spark, [("http://a/", 1)])
