import base64
import gzip
import hashlib
import shutil

import pytest
from pyspark.sql import functions as F

from trackloom.llm import warc

PAGES = "page_id long, url string, html string"


def _pages(spark, rows):
    return spark.createDataFrame(rows, PAGES)


def _rows(n):
    return [(i * 3, f"http://h{i % 7}/p{i}", None if i % 11 == 5 else "same body" if i % 4 == 0 else f"é body {i} " * (i % 50)) for i in range(n)]


def test_round_trip_equals_definition(spark, tmp_path):
    rows = _rows(200)
    manifest = warc.write_archives(_pages(spark, rows).repartition(5), str(tmp_path / "w"), shard_bytes=8_000, roll_bytes=1_500)
    assert manifest.count() > 5 and manifest.agg(F.sum("records")).first()[0] == 200
    first = {}
    for i, _, h in rows:
        first.setdefault(h or "", i)
    got = {r["page_id"]: r for r in warc.read_archives(manifest, str(tmp_path / "w")).collect()}
    assert len(got) == 200
    for i, url, h in rows:
        body = (h or "").encode()
        r = got[i]
        lead = first[h or ""]
        assert (r["payload_bytes"], r["payload_digest"], r["url"], r["intact"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), url, True)
        assert (r["record_type"], r["refers_to"]) == (("response", None) if i == lead else ("revisit", lead))


def test_same_bytes_on_any_partitioning(spark, tmp_path):
    rows = _rows(120)
    files = []
    for k, parts in enumerate((1, 7)):
        m = warc.write_archives(_pages(spark, rows).repartition(parts), str(tmp_path / f"w{k}"), shard_bytes=6_000, roll_bytes=2_000)
        files.append(sorted(tuple(r) for r in m.collect()))
    assert files[0] == files[1]
    for name, size, _, digest in files[0]:
        data = (tmp_path / "w0" / name).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (size, digest) and gzip.decompress(data).startswith(b"WARC/1.1\r\n")


def test_files_outside_the_manifest_do_not_count(spark, tmp_path):
    m = warc.write_archives(_pages(spark, _rows(30)), str(tmp_path / "w"))
    name = m.first()["file"]
    shutil.copy(tmp_path / "w" / name, tmp_path / "w" / "pages-999999999-00000.warc.gz")
    assert warc.read_archives(m, str(tmp_path / "w")).count() == 30


@pytest.mark.parametrize("least,types", [(0, ["response", "revisit"]), (6, ["response", "response"])])
def test_small_payloads_are_not_revisits(spark, tmp_path, least, types):
    m = warc.write_archives(_pages(spark, [(1, "u", "tiny"), (2, "v", "tiny")]), str(tmp_path / "w"), least_bytes=least)
    assert [r["record_type"] for r in warc.read_archives(m, str(tmp_path / "w")).orderBy("page_id").collect()] == types


def test_odd_rows_and_empty_tables(spark, tmp_path):
    rows = [(1, None, "x"), (1, None, "x"), (None, "u", "x"), (None, "u\r\nWARC-Type: evil", None), (2, "u", ""), (3, "ü", "WARC/1.1\r\n\r\n")]
    df = _pages(spark, rows).withColumns({c: F.lit("mine") for c in ("shard", "first_id", "lead", "file")})
    m = warc.write_archives(df, str(tmp_path / "w"))
    got = [(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["intact"]) for r in warc.read_archives(m, str(tmp_path / "w")).collect()]
    assert sorted(got, key=str) == sorted(
        [(1, "response", None, 1, True), (1, "revisit", 1, 1, True), (None, "revisit", 1, 1, True), (None, "revisit", 2, 0, True), (2, "response", None, 0, True), (3, "response", None, 12, True)],
        key=str,
    )
    none = warc.write_archives(_pages(spark, []), str(tmp_path / "none"))
    assert none.count() == 0 and warc.read_archives(none, str(tmp_path / "none")).count() == 0
