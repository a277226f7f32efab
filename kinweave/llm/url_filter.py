"""URL filter: rules on host and path first, then a logistic regression on hashed character n-grams of host and path.
DataFrame functions and Spark's own logistic regression only. Host and path have buckets of their own, and the n-grams of
each are scaled to length 1, so a long path takes nothing from the host.

A rule (host, path) fits its host and all subdomains, if the URL's path starts with the rule's; the longest wins. Rules
and the labelled URLs the model learns from are lists written by a person; they, and the model's 2 * ``BUCKETS`` weights,
travel inside the expression. Scoring is one narrow pass over the URLs.
"""

from __future__ import annotations

from collections.abc import Sequence
from random import Random

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the contract.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Lengths of n-grams, and buckets that those of the host, and those of the path, are hashed to.
NGRAMS = (2, 3, 4, 5)
BUCKETS = 1 << 13
#: A URL is blocked if it is at least twice as likely junk as worth reading.
THRESHOLD = 1 / 3

#: Words of hosts that are not worth reading, and of hosts that are; the labelled URLs are made of them.
JUNK_WORDS = (
    "casino", "poker", "bets", "slots", "jackpot", "win", "bonus", "free", "cheap", "pills", "viagra", "pharma", "adult",
    "porn", "xxx", "cams", "dating", "spam", "farm", "links", "seo", "ads", "track", "tracker", "banner", "click", "popup",
    "loans", "payday", "cash", "crack", "keygen", "warez", "torrent", "replica", "prize",
)
PLAIN_WORDS = (
    "theatre", "garden", "nation", "station", "bread", "river", "northern", "weather", "thing", "other", "there", "history",
    "reading", "letters", "forest", "mountain", "orchestra", "museum", "schule", "zeitung", "wissen", "kirche", "stadt",
    "musique", "lecture", "maison", "jardin", "escuela", "ciencia", "noticias", "cocina", "thought", "brother", "mother",
    "earth", "stones", "ondine", "anthem", "tinder", "health", "method", "rather", "nothing", "interest", "entrance", "hands",
)
_FRONTS = ("", "www.", "blog.", "m.")
_ENDS = ("com", "net", "org")
_LANGS = ("en", "de", "fr", "es")
_TAILS = ("", "/", ".html", "?page=2", "#top", "?utm_source=feed")


#: Lengths of labelled paths that tell nothing.
_LENGTHS = (0, 10, 25, 60, 120, 250, 500, 1000, 2000)
_PLACES = "abcdefghijklmnopqrstuvwxyz0123456789-/"


def labelled_urls() -> list[tuple[str, int]]:
    """A small labelled table: 1 is worth reading, 0 is not. Hosts are one word or two with a hyphen; front, end and
    most paths go round in the same way for both labels, so that they tell nothing. Paths of words tell the label under
    hosts that tell nothing; under the others the host does, whatever words are in the path."""
    out = []
    for label, words, others in ((0, JUNK_WORDS, PLAIN_WORDS), (1, PLAIN_WORDS, JUNK_WORDS)):
        random = Random(17)
        for i, word in enumerate(words):
            hosts = (word, f"{word}-{words[(5 * i + 3) % len(words)]}", f"{words[(3 * i + 7) % len(words)]}-{word}")
            for k, host in enumerate(hosts):
                n = i + 5 * k
                site = f"https://{_FRONTS[(n // 2) % 4]}{host}.example.{_ENDS[n % 3]}"
                out.append((f"{site}/{_LANGS[n % 4]}/{(n + 1) * 7919 % 99991}{_TAILS[n % 6]}", label))
                out.append((f"{site}/{''.join(random.choices(_PLACES, k=_LENGTHS[n % len(_LENGTHS)]))}", label))
                some = random.choices(range(1 << 20), k=(1, 2, 4, 12)[n % 4])
                out.append((f"{site}/{'/'.join(others[j % len(others)] for j in some)}", label))
                site = f"https://{_FRONTS[(n // 2) % 4]}{''.join(random.choices(_PLACES[:26], k=5 + n % 8))}.example.{_ENDS[n % 3]}"
                out.append((f"{site}/{_LANGS[n % 4]}/{'-'.join([word, *(words[j % len(words)] for j in some)])}", label))
    return out


def host_of(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _ngrams(part: str) -> Column:
    """The character n-grams of host or path, which is marked at its ends."""
    text = F.concat(F.lit("^"), F.col(part), F.lit("$"))

    def grams(n: int) -> Column:
        last = F.greatest(F.char_length(text) - n + 1, F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(text, i, F.lit(n)))

    return F.flatten(F.array(*(grams(n) for n in NGRAMS)))


def _hashed(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``host`` and ``path``) and their ``features``: those of the host and those of the path, either of
    length 1."""
    for part in ("host", "path"):
        hashed = HashingTF(numFeatures=BUCKETS, inputCol=f"{part}_grams", outputCol=f"{part}_counts")
        scaled = Normalizer(inputCol=f"{part}_counts", outputCol=f"{part}_scaled")
        rows = scaled.transform(hashed.transform(rows.withColumn(f"{part}_grams", _ngrams(part)))).drop(f"{part}_grams", f"{part}_counts")
    return VectorAssembler(inputCols=["host_scaled", "path_scaled"], outputCol="features").transform(rows).drop("host_scaled", "path_scaled")


def train(spark: SparkSession, labelled: Sequence[tuple[str, int]] | None = None) -> LogisticRegressionModel:
    """Learn from the labelled URLs (a list written by a person). Fails without URLs of both labels."""
    labelled = labelled_urls() if labelled is None else labelled
    if {y for _, y in labelled} != {0, 1}:
        raise ValueError("labelled URLs of both kinds are needed")
    rows = ", ".join("('{}', {}D)".format(u.replace("\\", "\\\\").replace("'", "\\'"), y) for u, y in labelled)
    urls = spark.sql(f"SELECT * FROM VALUES {rows} AS t(url, label)").coalesce(1)
    known = _hashed(urls.select("label", host_of("url").alias("host"), path_of("url").alias("path")))
    return LogisticRegression(regParam=1e-4, standardization=False, maxIter=100).fit(known)


def _rule(host: str, path: str, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as ``struct<size, rule, verdict>``; null if none does."""
    fits = [
        F.when(
            ((F.col(host) == h) | F.endswith(F.col(host), F.lit("." + h))) & F.startswith(F.col(path), F.lit(p)),
            F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r))
    ]
    return F.coalesce(*fits)


def judge(
    pages: DataFrame, model: LogisticRegressionModel, *, page_id: str = "page_id", url: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` of every row: the verdict of the longest fitting rule, else that of
    the model, whose probability of being worth reading is ``score``.

    A null URL, and one without ``://``, has an empty host and path; no rule fits, and the model judges by the empty
    parts. Hosts keep ports and user names, which no rule fits. Repeated rows are judged alike.
    """
    parts = pages.select(F.col(page_id).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    scored = model.transform(_hashed(parts)).withColumn("score", vector_to_array("probability")[1])
    found = scored.withColumn("found", _rule("host", "path", rules))
    by_model = F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block"))
    return found.select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", by_model).alias("verdict"), "score",
    )
