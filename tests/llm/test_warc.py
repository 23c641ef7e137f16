import hashlib
from collections import Counter

from pyspark.sql import functions as F

from conftest import SF_TINY
from ledgerlane.llm import warc

LONG = "<p>" + "x" * 2000 + "</p>"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {c: F.lit("other") for c in ("digest", "payload", "salt", "first", "n", "d", "s", "bundle")})


def expected(rows):
    best = {}
    for i, _, h in rows:
        if len((h or "").encode()) >= 1000 and i is not None:
            best[h] = max(best.get(h, i), i)
    shared = Counter(h for _, _, h in rows)
    out = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        first = best.get(h) if shared[h] > 1 else None
        revisit = first is not None and first != i
        out[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None] += 1
    return out


def check(spark, rows, folder, **options):
    warc.write_bundles(warc.with_revisits(pages(spark, rows), salts=3), folder, **options)
    got = warc.read_bundles(spark, folder)
    found = got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, found)) == expected(rows)
    return got


def test_edges_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", LONG), (5, "http://b/?x=1%0A\r\ny", LONG), (5, "http://b/", LONG), (3, None, LONG), (None, "u", LONG),
            (7, "", None), (8, "http://c/", ""), (9, "ünï://é", "kurz"), (10, "x", "kurz"), (11, "big", "é" * 1_500_000),
            (12, "raw", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (-2, "neg", LONG + "!"), (-3, "neg", LONG + "!")]
    got = check(spark, rows, f"file://{tmp_path}/w")
    urls = {(r.page_id, r.url) for r in got.collect()}
    assert (5, "http://b/?x=1%0A\r\ny") in urls and (9, "ünï://é") in urls


def test_index_finds_single_records_in_small_frames(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"page {k} " * 40_000) for k in range(12)]
    folder = f"file://{tmp_path}/w"
    check(spark, rows, folder, bundle_bytes=1)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"  # whose coalescing by bytes must not undo the deal
    tasks = warc.read_bundles(spark, folder, 1).select(F.spark_partition_id()).distinct().count()
    assert tasks > 3
    index = spark.read.parquet(f"{folder}/index").collect()
    assert len(index) == 12 and len({r.bundle for r in index}) > 1
    for r in index:
        row = warc.fetch(folder, r.bundle, r.frame, r.offset)
        assert row[0] == r.page_id and row[-1] == (f"page {r.page_id} " * 40_000).encode()


def test_bundles_are_plain_zstandard_streams(spark, tmp_path):
    import zstandard
    folder = f"file://{tmp_path}/w"
    check(spark, [(1, "u", LONG), (2, "v", LONG * 1000)], folder)
    for bundle in tmp_path.glob("w/*.warc.zst"):
        with open(bundle, "rb") as f:
            table = warc.seek_table(f)
            f.seek(0)
            data = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
        assert len(data) == sum(full for _, _, full in table)
        place, kinds = 0, []
        while place < len(data):
            heads, _, place = warc.parse_record(data, place)
            kinds.append(heads["WARC-Type"])
        assert kinds


def test_empty_table(spark, tmp_path):
    assert check(spark, [], f"file://{tmp_path}/w").count() == 0


def test_table(spark, tmp_path):
    table = spark.read.parquet(f"{SF_TINY}/pages.parquet")
    check(spark, [(r.page_id, r.url, r.html) for r in table.collect()], f"file://{tmp_path}/w")
