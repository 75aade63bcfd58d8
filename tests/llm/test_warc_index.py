import base64
import gzip
import hashlib
import random

from pyspark.sql import functions as F

from ledgerlens.llm import warc_index as I


def test_round_trip_and_global_order(spark):
    rng = random.Random(2)
    bodies = [None, "", "<p>é</p>\r\n\r\nWARC/1.1\r\n", "x" * 300_000, "same", "same"] + [f"page {k % 7}" for k in range(60)]
    urls = [None, "", "no scheme", "http://b.example.com/x?q=1#f", "https://www.a.example.com:443", "http://a.example.com/\r\nX: y"]
    rows = [(k, urls[k % len(urls)] if k < 12 else f"http://h{rng.randint(0, 3)}.org/{rng.randint(0, 2)}", b) for k, b in enumerate(bodies)]
    rows += [(None, "http://z.org/", "same"), (5, "http://z.org/", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).withColumn("payload", F.lit(2)).repartition(3)
    manifest = I.write_archives(pages, archive_bytes=2000)
    assert manifest.count() > 3
    got = I.merge_runs(I.capture_runs(manifest), ranges=4).collect()
    smallest = {}
    for i, _, b in rows:
        if i is not None:
            smallest[b or ""] = min(i, smallest.get(b or "", i))
    want = sorted(((i, len((b or "").encode()), base64.b32encode(hashlib.sha1((b or "").encode()).digest()).decode(),
                    None if smallest[b or ""] == i else smallest[b or ""]) for i, _, b in rows), key=str)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in got), key=str) == want
    assert all((r.record_type == "revisit") == (r.refers_to is not None) for r in got)
    got.sort(key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(rows)))
    keys = [(r.url_key, r.capture_time, r.page_id is not None, r.page_id or 0) for r in got]
    assert keys == sorted(keys)


def test_archives_are_readable_as_gzip(spark):
    pages = spark.createDataFrame([(1, "http://a.org/", "hello"), (2, "http://a.org/", "hello")], "page_id long, url string, html string")
    text = b"".join(gzip.open(r.archive).read() for r in I.write_archives(pages).collect())
    assert text.count(b"WARC/1.1\r\n") == 2 and text.count(b"hello") == 1 and b"WARC-Refers-To: <urn:page:1>" in text


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame([(k, "http://a.org/", "hello") for k in range(4)], "page_id long, url string, html string")
    runs = I.capture_runs(I.write_archives(pages, revisit_from=6))
    assert {r.record_type for r in runs.collect()} == {"response"}


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert I.merge_runs(I.capture_runs(I.write_archives(pages))).collect() == []


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 8, 13):
        runs = [sorted(rng.randint(0, 20) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        assert list(I.LoserTree(list(map(iter, runs)))) == sorted(x for r in runs for x in r)


def test_history_is_in_the_order_of_any_ids(spark, monkeypatch):
    ids = [10**9 + 5, 3, -7, 2 * 10**9, 10**9, 2**63 - 1, -2**63, 0, None, 999_999_999]
    pages = spark.createDataFrame([(i, "http://a.net/", f"x{i}") for i in ids], "page_id long, url string, html string")
    monkeypatch.setattr(I, "RANGE_ROWS", 1)  # ranges follow from the rows, not only from the session
    merged = I.merge_runs(I.capture_runs(I.write_archives(pages)))
    got = [r.page_id for r in sorted(merged.collect(), key=lambda r: r.position)]
    assert got == [None, *sorted(i for i in ids if i is not None)]
    assert [r.capture_time for r in sorted(merged.collect(), key=lambda r: r.position)] == [I.capture_time(i) for i in got]


def test_capture_times_keep_the_order_of_ids():
    ids = [None, -2**63 + 1, -10**9 - 1, -1, 0, 1, 999_999_999, 10**9, 10**18, 2**63 - 1]
    times = [I.capture_time(i) for i in ids]
    assert times == sorted(set(times)) and len({len(t) for t in times}) == 1
    assert I.capture_time(10**9 + 5) == "2024-01-01T00:00:01.000000005Z"


def test_hot_digest_is_dealt_out(spark):
    """Without broadcasts by size, the rows of a hot digest lie in many partitions, and all get their first page."""
    rows = [(k, "http://a.org/", "hot" if k % 3 else f"body {k // 6}") for k in range(3000)] + [(None, "http://a.org/", "hot")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    read = pages.select("page_id", "url", F.encode("html", "utf-8").alias("payload"))
    read = read.withColumn("digest", F.sha1("payload"))
    twice = read.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = I._with_first(read, twice, 0).withColumn("part", F.spark_partition_id()).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    smallest = {}
    for i, _, b in rows[:-1]:
        smallest[b] = min(i, smallest.get(b, i))
    assert sorted((str(r.page_id), r.refers_to) for r in got) == sorted((str(i), None if smallest[b] == i else smallest[b]) for i, _, b in rows)
    hot = [r.part for r in got if r.payload == b"hot"]
    assert max(hot.count(p) for p in set(hot)) < len(hot) / 2
