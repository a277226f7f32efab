"""The registered queries of this subpackage, each an operator applied to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinweave.llm import (
    centroids, chat_format, decontaminate, jaccard_join, license_scan, mixing, quality_classifier, quality_rules, repair, token_counts, token_files,
    url_filter, warc,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _decontamination(s: SparkSession, d: str) -> DataFrame:
    return decontaminate.contamination(_table(s, d, "documents"), _table(s, d, "benchmark"))


def _quality_rules(s: SparkSession, d: str) -> DataFrame:
    docs = _table(s, d, "documents")
    return quality_rules.judged(docs, quality_rules.fit_lines(docs, _table(s, d, "labels")))


def _quality_classifier(s: SparkSession, d: str) -> DataFrame:
    docs = _table(s, d, "documents")
    return quality_classifier.scored(docs, quality_classifier.fit_quality(docs, _table(s, d, "labels")))


def _chat(s: SparkSession, d: str) -> DataFrame:
    return chat_format.read_back(chat_format.windows(chat_format.with_extra(_table(s, d, "conversations"))))


def _token_binary(s: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    return token_files.written_and_read(_table(s, d, "documents"), path=public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": lambda s, d: license_scan.scan(_table(s, d, "documents")).drop("matches"),
    "op2_token_counts": lambda s, d: token_counts.section_tokens(_table(s, d, "documents")),
    "op3_chat_format": _chat,
    "op4_source_mix": lambda s, d: mixing.mix(_table(s, d, "documents")).drop("times"),
    "op5_warc": lambda s, d: warc.written_and_read(_table(s, d, "pages")),
    "op6_ngram_jaccard_join": lambda s, d: jaccard_join.near_duplicates(_table(s, d, "documents")),
    "op7_quality_rules": _quality_rules,
    "op8_url_filter": lambda s, d: url_filter.judge(_table(s, d, "pages"), url_filter.train(s)),
    "op9_benchmark_decontamination": _decontamination,
    "op10_quality_classifier": _quality_classifier,
    "op11_centroid_clustering": lambda s, d: centroids.clustered(_table(s, d, "embeddings")),
    "op12_token_binary": _token_binary,
    "op13_conversation_repair": lambda s, d: repair.damaged_and_repaired(_table(s, d, "conversations")),
}

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _rounds(n: int) -> str:
    """Assignments and centroids of ``n`` rounds, as common table expressions."""
    parts = []
    for i in range(n + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, c,
    CAST(list_sum(list_transform(range(1, 65), lambda i: (x[i] - y[i]) * (x[i] - y[i]))) AS BIGINT) AS d FROM v, c{i}) GROUP BY r)""")
        parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(z, y) AS y FROM c{i} LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS z
    FROM (SELECT c, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{i} JOIN v USING (r), range(1, 65) t(i) GROUP BY c, i) GROUP BY c) USING (c))""")
    return ",\n".join(parts[:-1])


ORACLES: dict[str, str] = {
    "op4_source_mix": r"""
WITH l AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(concat_ws(':', '17', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ss, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS BIGINT) AS w
  FROM l GROUP BY source),
c AS (SELECT *, sum(ss) OVER () AS t, sum(w) OVER () AS tw, sum(ss) OVER o - ss AS s0, sum(w) OVER o - w AS w0, row_number() OVER o AS i
  FROM s WINDOW o AS (ORDER BY ss / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT s0, w0, t, tw, i FROM c WHERE ss > 0 AND (t - 3 * s0) * w <= 3 * ss * (tw - w0) ORDER BY i LIMIT 1),
g AS (SELECT source, ss, CASE WHEN ss = 0 OR c.i < f.i THEN CAST(3 * ss AS DOUBLE)
    ELSE CAST((f.t - 3 * f.s0) * w AS DOUBLE) / CAST(f.tw - f.w0 AS DOUBLE) END AS target FROM c LEFT JOIN f ON true),
q AS (SELECT *, CASE WHEN ss > 0 THEN CAST(floor(target / ss) AS BIGINT) ELSE 0 END AS whole FROM g),
r AS (SELECT l.*, ss, target, whole, target - whole * ss AS quota,
    sum(size) OVER (PARTITION BY l.source ORDER BY draw, size ROWS UNBOUNDED PRECEDING) AS run
  FROM l JOIN q ON l.source IS NOT DISTINCT FROM q.source),
x AS (SELECT *, min(CASE WHEN run - size / 2 > quota THEN draw END) OVER (PARTITION BY source) AS cut FROM r)
SELECT doc_id, size, ss AS source_size, target,
  CAST(CASE WHEN size > 0 THEN size * (whole + CASE WHEN quota > 0 AND draw < coalesce(cut, 'g') THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken FROM x""",
    "op5_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(raw) AS BIGINT) AS payload_bytes, array_to_string(flatten([[
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT) >> k) & 31 AS BIGINT) + 1, 1)
    FOR k IN [15, 10, 5, 0]] FOR i IN range(8)]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f USING (h)""",
    "op9_benchmark_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_aggregate(list_slice(w, i, i + least(len(w), 10) - 1), 'string_agg', ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
o AS (SELECT r, i, p.item_id, n FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)
  JOIN (SELECT DISTINCT n AS m FROM p) ON i + m - 1 <= len(w)
  JOIN p ON p.n = m AND p.phrase = list_aggregate(list_slice(w, i, i + m - 1), 'string_agg', ' ')),
h AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS x FROM o) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items,
  string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM o GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)""",
    "op11_centroid_clustering": f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * 256) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('2:', vec_id)), x) - 1 AS c, x AS y FROM v QUALIFY c < 40),
{_rounds(5)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(y, ',')) AS centroid_sha256
FROM a5 JOIN v USING (r) JOIN c5 USING (c)""",
}
