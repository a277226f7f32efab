import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from kinweave.llm import warc as W

SCHEMA = "page_id bigint, url string, html string, payload string, record_type int"
PAGES = [
    (5, "http://a/", "<p>same</p>", "x", 1),
    (3, "http://b/\r\nEvil: 1", "<p>same</p>", "x", 1),
    (4, None, None, "x", 1),
    (9, "http://c/", "", "x", 1),
    (2, "http://é/", "ü" * 200_000 + "\r\n\r\nWARC/1.1", "x", 1),
    (7, "http://d/", "alone", "x", 1),
    (7, "http://d/", "alone", "x", 1),
    (8, "http://d/", "alone", "x", 1),
    (None, "http://e/", "<p>same</p>", "x", 1),
    (None, "http://f/", "only without id", "x", 1),
    (None, "http://g/", "only without id", "x", 1),
]


def _want(min_bytes=0):
    out, groups = [], {}
    for i, url, html, *_ in PAGES:
        groups.setdefault(html or "", []).append((i is None, i, url))
    for html, rows in groups.items():
        raw = html.encode()
        name = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        rows.sort(key=lambda r: (r[0], r[1] or 0, r[2] or ""))
        for n, (_, i, _) in enumerate(rows):
            revisit = n > 0 and len(raw) >= min_bytes
            out.append((i, len(raw), name, "revisit" if revisit else "response", rows[0][1] if revisit else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, SCHEMA).repartition(4)


@pytest.mark.parametrize("min_bytes", [0, 1, 12])
def test_round_trip(pages, min_bytes):
    assert sorted((tuple(r) for r in W.written_and_read(pages, min_bytes=min_bytes).collect()), key=repr) == _want(min_bytes)


def test_files_are_rolled_deterministic_and_whole(spark, pages, tmp_path):
    many = spark.range(500).selectExpr("id AS page_id", "concat('http://x/', id) AS url", "sha2(cast(id % 400 AS string), 512) AS html")
    listed = []
    for run, df in enumerate([many.repartition(3), many.repartition(8)]):
        folder = (tmp_path / str(run)).as_uri()
        manifest = W.write_archives(df, folder, shard_bytes=100_000, roll_bytes=20_000)
        listed.append(sorted(map(tuple, manifest.df.collect())))
        assert sum(r[3] for r in listed[-1]) == 500 and len({r[0] for r in listed[-1]}) > 2 and len(listed[-1]) > 4
        assert sorted(os.listdir(tmp_path / str(run))) == sorted(r[2] for r in listed[-1])
        back = W.read_archives(manifest.df, folder, with_payload=True).collect()
        texts = {r.page_id: bytes(r.payload) for r in back if r.record_type == "response"}
        assert len(texts) == 400 and all(texts[i].decode() == hashlib.sha512(str(i).encode()).hexdigest() for i in texts)
    assert listed[0] == listed[1]
    raw = gzip.decompress((tmp_path / "0" / listed[0][0][2]).read_bytes())
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")


def test_a_damaged_record_fails():
    good = W.record(1, "http://a/", b"text", 0, None, W.DATE)
    assert W.parse(good)["payload"] == b"text"
    with pytest.raises(ValueError):
        W.parse(good.replace(b"\r\n\r\ntext", b"\r\n\r\ntexT"))


def test_a_lost_task_leaves_no_half_file(tmp_path):
    file = W._File(tmp_path.as_uri(), 0, 0)
    file.add(b"half")
    again = W._File(tmp_path.as_uri(), 0, 0)
    again.add(b"whole")
    again.commit()
    assert gzip.decompress((tmp_path / again.name).read_bytes()) == b"whole"


def test_nothing(pages):
    assert W.written_and_read(pages.limit(0)).count() == 0


def test_many_files_are_read_by_many_tasks(spark, tmp_path):
    """Files roll at the size given, and a small manifest is not read by one task."""
    pages = spark.range(2000, numPartitions=4).selectExpr("id AS page_id", "concat('http://a/', id) AS url", "sha2(cast(id AS string), 512) AS html")
    folder = str(tmp_path / "archive")
    manifest = W.write_archives(pages, folder, shard_bytes=100_000, roll_bytes=10_000).df
    files = manifest.count()
    assert files > 30 and manifest.filter("number > 0").count() > 0
    back = W.read_archives(manifest, folder)
    assert back.rdd.getNumPartitions() == files and back.count() == 2000
    used = back.select(F.spark_partition_id().alias("task")).distinct().count()
    assert used > files // 3
