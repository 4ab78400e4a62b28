"""WARC archives: a plain parser over whole files, the contract by brute force, odd rows."""

import gzip
import hashlib
import re
from pathlib import Path

from pyspark.sql import functions as F

from clickwarden.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, file string"
LONG, OTHER = "é" * 500, "x" * 1000
ROWS = [
    (1, "http://a/1", LONG), (5, "http://a/5", LONG), (3, "http://a/3", LONG), (None, "http://a/n", LONG),
    (7, None, OTHER), (2, "http://a/ b\r\nEvil: <1>", OTHER),
    (4, "http://a/4", "x" * 999), (6, "http://a/6", "x" * 999),
    (8, "http://a/8", None), (9, "http://a/9", ""), (-3, "http://a/9", "WARC/1.1\r\n\r\n\r\n" * 200),
    (5, "http://a/5", LONG), (10, "http://a/10", "long \x00 text " * 100_000),
]


def expected(rows, least=1000):
    best = {}
    for page, _, html in rows:
        best.setdefault(html or "", []).append(page)
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        ids = [p for p in best[html or ""] if p is not None]
        keeper = max(ids) if ids and len(payload) >= least else page
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "response" if page == keeper else "revisit",
                    None if page == keeper else keeper))
    return sorted(out, key=str)


def read(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def plain_records(path):
    """All records of a file by following Content-Length alone."""
    content, out = gzip.decompress(Path(path).read_bytes()), []
    while content:
        head, _, rest = content.partition(b"\r\n\r\n")
        length = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
        out.append((head, rest[:length]))
        assert rest[length: length + 4] == b"\r\n\r\n"
        content = rest[length + 4:]
    return out


def test_round_trip_of_odd_rows(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "other", "clash") for r in ROWS], SCHEMA).repartition(3)
    index = warc.write_archives(pages, f"file:{tmp_path}/w", file_bytes=2000)
    assert read(warc.read_records(index)) == expected(ROWS)
    files = list((tmp_path / "w").glob("*.warc.gz"))
    assert len(files) > 3
    heads = [head for f in files for head, _ in plain_records(f)]
    assert sum(b"WARC-Type: warcinfo" in h for h in heads) == len(files)
    assert sum(b"WARC-Type: warcinfo" not in h for h in heads) == len(ROWS)
    assert not any(b"\nEvil" in h for h in heads)
    texts = warc.read_records(index, payloads=True).where("record_type = 'response'").select("page_id", "payload").distinct()
    by_page = {page: html or "" for page, _, html in ROWS}
    assert all(by_page[r.page_id] == r.payload for r in texts.collect())
    urls = {r.page_id: r.url for r in warc.read_records(index).collect()}
    assert urls[7] is None and urls[2] == "http://a/%20b%0D%0AEvil:%20%3C1%3E"


def test_index_names_exact_ranges_and_selects(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "", "") for r in ROWS], SCHEMA)
    index = warc.write_archives(pages, str(tmp_path / "w"))
    for row in index.collect():
        member = Path(row.file.removeprefix("file:")).read_bytes()[row.offset: row.offset + row.length]
        fields, _ = warc.decode_record(member)
        assert warc.page_of(fields["warc-record-id"]) == row.page_id
    some = index.where(F.col("page_id").isin(4, 10))
    assert [r.page_id for r in warc.read_records(some, gap=0).orderBy("page_id").collect()] == [4, 10]


def test_hot_payload_and_empty_table(spark, tmp_path):
    rows = [(i, "http://h/", LONG if i % 3 == 0 else f"{i} " + OTHER) for i in range(4000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert read(warc.read_records(warc.write_archives(pages, str(tmp_path / "h")))) == expected(rows)
    none = warc.write_archives(pages.limit(0), str(tmp_path / "e"))
    assert none.count() == 0 and warc.read_records(none).count() == 0


def test_neighbouring_ranges_are_read_together():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 40, 10), ("a", 45, 5), ("b", 50, 10), ("b", 60, 100)]
    runs = list(warc._ranges(iter(rows), gap=5, most=60))
    assert runs == [("a", [(0, 10), (10, 10)]), ("a", [(40, 10), (45, 5)]), ("b", [(50, 10)]), ("b", [(60, 100)])]


def test_record_ids_hold_page_ids():
    for page in (0, 1, -1, 2**63 - 1, -2**63, None, 12345678901):
        assert warc.page_of(warc.record_id(page, hashlib.sha1(b"x").digest())) == page
