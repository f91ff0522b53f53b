"""The WARC source against the records written, and archives of pages against a plain version."""

import gzip
import hashlib
import io
import os
import random
import shutil
import tempfile
from pathlib import Path

import pytest

from scorelake.llm import warc
from scorelake.llm.warc import Records, archive_pages, archived_pages, member, read_warc, record_bytes, write_warc


def plain(rows):
    """page_id, payload_bytes, digest, type, refers_to of (page_id, url, html) rows; rows alike in id and payload are told apart by number."""
    groups, out = {}, []
    for i, (page, _, html) in enumerate(rows):
        groups.setdefault((html or "").encode(), []).append((page is not None, page or 0, i))
    for body, own in groups.items():
        best = max(own)
        for held, page, i in own:
            again = len(body) >= 1000 and (held, page, i) != best
            out.append((page if held else None, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", (best[1] if best[0] else None) if again else None))
    return sorted(out, key=str)


def folder():
    return f"{tempfile.mkdtemp(prefix='spark-')}/archive"


LONG = "<p>é" * 400
PAGES = [
    (1, "http://a/1", LONG), (9, "http://a/9", LONG), (9, "http://b/9", LONG), (9, "http://b/9", LONG), (4, None, LONG), (None, "http://n", LONG),
    (2, "http://a/2", "short"), (3, "http://a/3", "short"), (5, "u\r\nX: y", None), (6, "", ""), (7, "http://x", "WARC/1.1\r\n\r\n" * 200), (8, "http://y", "WARC/1.1\r\n\r\n" * 200),
    (None, None, "z" * 1000), (None, "v", "z" * 1000), (10, "w", "q" * 999), (11, "w", "q" * 999), (12, "w", "k" * 3_000_000),
]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archive(spark, compression):
    path = folder()
    df = spark.createDataFrame([(*r, "clash", 0) for r in PAGES], "page_id long, url string, html string, digest string, size int").repartition(3)
    archive_pages(df, path, compression=compression)
    assert sorted(map(tuple, archived_pages(spark, path).collect()), key=str) == plain(PAGES)
    # The payloads themselves, and one response a group.
    own = read_warc(spark, path, "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload binary").collect()
    assert len({r.record_id for r in own}) == len(PAGES)
    bodies = [bytes(r.payload) for r in own if r.record_type == "response"]
    assert sorted(b for b in bodies if len(b) >= 1000) == sorted({(h or "").encode() for _, _, h in PAGES if len((h or "").encode()) >= 1000})
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in own if r.record_type == "response")
    assert all(not r.payload for r in own if r.record_type == "revisit")


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    path = folder()
    archive_pages(pages.union(pages.selectExpr("page_id + 1000000", "url", "html")), path, least=100)
    rows = [tuple(r) for r in archived_pages(spark, path).collect()]
    assert len(rows) == 2 * pages.count()
    digests = {hashlib.sha1((r.html or "").encode()).hexdigest() for r in pages.collect()}
    assert {r[2] for r in rows} == digests
    assert all((r[4] is None) == (r[3] == "response") for r in rows)


def test_empty(spark):
    path = folder()
    archive_pages(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert archived_pages(spark, path).collect() == []


def test_predicates_reach_the_reader(spark):
    path = folder()
    archive_pages(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    df = read_warc(spark, path, "record_type string, target_uri string, content_length long")
    picked = df.where("record_type = 'revisit' AND target_uri LIKE 'http://a/%' AND content_length > 10")
    assert {r.target_uri for r in picked.collect()} <= {"http://a/1", "http://a/9"}
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "Filter (isnotnull(content_length" in plan
    assert "record_type" not in plan.split("Filter (")[1].split("\n")[0]
    assert df.where("target_uri IN ('http://x', 'http://y')").count() == 2
    with pytest.raises(Exception, match="no text string"):
        read_warc(spark, path, "text string").collect()


def test_unwanted_payloads_are_passed_by():
    raw = [record_bytes({"WARC-Type": kind}, bytes([65 + i]) * 300_000) for i, kind in enumerate(["response", "revisit", "response"])]
    noise = random.Random(1).randbytes(400_000)
    raw.append(record_bytes({"WARC-Type": "resource"}, noise))
    raw.append(record_bytes({"WARC-Type": "metadata"}, b"end"))
    for whole in (b"".join(member(r, 6) for r in raw), b"".join(raw)):
        records = Records(io.BytesIO(whole), lambda h: h["warc-type"] == "metadata", True)
        assert [b for _, b in records] == [b"end"]
        assert records.passed >= 300_000
        only = Records(io.BytesIO(whole), lambda h: True, False)
        assert [(h["warc-type"], b) for h, b in only] == [(k, None) for k in ("response", "revisit", "response", "resource", "metadata")]
        assert only.passed >= 300_000
        every = [b for _, b in Records(io.BytesIO(whole), lambda h: True, True)]
        assert every == [b"A" * 300_000, b"B" * 300_000, b"C" * 300_000, noise, b"end"]


def test_archives_of_other_writers(spark):
    """One gzip stream of all records, a member a record without lengths, and plain files: the same records. A damaged file is an error."""
    raw = [record_bytes({"WARC-Type": "warcinfo"}, b"a: b\r\n\r\nc"), record_bytes({"WARC-Type": "response", "Content-Type": "application/http"}, b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\r\n\r\n" + b"x" * 200_000), record_bytes({"WARC-Type": "response"}, b"")]
    for name, data in (("a.warc.gz", gzip.compress(b"".join(raw))), ("b.warc.gz", b"".join(map(gzip.compress, raw))), ("c.warc", b"".join(raw))):
        path = folder()
        os.makedirs(path)
        with open(f"{path}/{name}", "wb") as f:
            f.write(data)
        got = [(r.record_type, r.http, bytes(r.payload)) for r in read_warc(spark, path, "record_type string, http string, payload binary").collect()]
        assert got == [("warcinfo", None, b"a: b\r\n\r\nc"), ("response", "HTTP/1.1 200 OK\r\nA: b", b"body\r\n\r\n" + b"x" * 200_000), ("response", None, b"")]
        assert read_warc(spark, f"{path}/{name}", "record_type string").where("record_type = 'response'").count() == 2
    for bad in (b"".join(member(r, 1) for r in raw)[:-9], b"".join(raw)[:-100_000], b"no archive\r\n\r\n"):
        with pytest.raises((ValueError, EOFError, Exception)):
            list(Records(io.BytesIO(bad), lambda h: True, True))


def test_files_roll_and_share_partitions(spark):
    path = folder()
    df = spark.range(200).selectExpr("'resource' AS record_type", "concat('<urn:', id, '>') AS record_id", "cast(repeat(sha2(cast(id AS string), 256), 20) AS binary) AS payload").coalesce(1)
    write_warc(df, path, fileBytes=20_000, compression="none")
    small, large = (read_warc(spark, path, "record_id string, payload binary", partitionBytes=n) for n in (1, 100_000))
    assert small.rdd.getNumPartitions() > large.rdd.getNumPartitions() > 1
    assert {r.record_id: bytes(r.payload) for r in large.collect()} == {r.record_id: bytes(r.payload) for r in small.collect()} == {r.record_id: bytes(r.payload) for r in df.collect()}


def test_files_of_failed_attempts_count_for_nothing(spark):
    path = folder()
    df = spark.createDataFrame([("resource", "<urn:1>", b"x")], "record_type string, record_id string, payload binary")
    write_warc(df, path)
    file = next(Path(path).glob("*.warc.gz"))
    shutil.copy(file, Path(path) / "0-00000.warc.gz")  # what a lost attempt left
    assert read_warc(spark, path).count() == 1
    write_warc(df, path)
    assert [p.name for p in Path(path).glob("*.warc.gz") if not p.name.startswith("0-")] != [file.name]
    assert read_warc(spark, path).count() == 1
    with pytest.raises(Exception, match="holds an archive"):
        df.write.format("warc").mode("append").save(path)
    assert warc.MANIFEST in {p.name for p in Path(path).iterdir()}
