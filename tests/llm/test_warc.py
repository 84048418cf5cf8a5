import gzip
import hashlib

from pyspark.sql import functions as F

from tabshift.llm import warc as W

PAGES = "page_id bigint, url string, html string"
LONG = "same payload é " * 100
ROWS = [
    (1, "http://a/1", LONG), (2, "http://a/2", LONG), (9, "http://a/ü x\r\n", LONG), (3, None, "short"), (4, "u", "short"),
    (5, "u", None), (6, "u", ""), (7, "u", "x" * 3_000_000), (8, "u", LONG + "other"), (8, "u", LONG + "other"), (None, "u", LONG),
    (10, "u", "WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n" * 40),
]


def brute(rows):
    out = []
    for id, _, html in rows:
        raw = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == raw and r[0] is not None]
        refers = max(same) if len(raw) >= 1000 and same and max(same) != id else None
        out.append((id, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if refers is not None else "response", refers))
    return sorted(out, key=repr)


def test_round_trip_equals_brute_force(spark):
    df = spark.createDataFrame(ROWS, PAGES).withColumn("id", F.lit(1)).withColumn("digest", F.lit("x")).repartition(3)
    got = W.archived_records(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(ROWS)


def test_payloads_come_back_in_chunks(spark):
    manifest, folder = W.archive_pages(spark.createDataFrame(ROWS, PAGES))
    chunks = W.read_archives(manifest, folder, chunk_bytes=1000).collect()
    big = sorted((r for r in chunks if r["record_id"] == "7"), key=lambda r: r["chunk"])
    assert len(big) == 3000 and [r["chunk"] for r in big] == list(range(3000))
    assert b"".join(r["data"] for r in big) == b"x" * 3_000_000 and [r["last"] for r in big].count(True) == 1
    assert big[10]["digest_so_far"] == hashlib.sha1(b"x" * 11_000).hexdigest() and big[10]["bytes_so_far"] == 11_000
    assert max(len(r["data"]) for r in chunks) == 1000
    assert {r["url"] for r in chunks if r["record_id"] == "9"} == {"http://a/ü x\r\n"}


def test_files_are_gzip_members_of_bounded_size(spark):
    rows = W.with_revisits(spark.createDataFrame([(k, "u", f"{k} " * 2000) for k in range(20)], "id bigint, url string, payload string"))
    folder = W.shared_folder(spark, "warc-test")
    manifest = W.write_archives(rows.coalesce(1), f"file://{folder}", archive_bytes=1).collect()
    assert len(manifest) == 20 and {r["records"] for r in manifest} == {1}
    raw = gzip.open(manifest[0]["path"]).read()
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\n")


def test_empty_table(spark):
    assert W.archived_records(spark.createDataFrame([], PAGES)).collect() == []
