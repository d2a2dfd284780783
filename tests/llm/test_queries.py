"""The registered queries next to their SQL, against brute force, and the pipeline's decisions."""

import hashlib
import importlib
import re
import zlib

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from tests.llm.fixtures import labels, odd_documents, save
from trackloom.llm import queries
from trackloom.llm.secrets import PLACEHOLDER

FOLDER = "/root/testdata/sf0.01"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    frame = queries.queries()[name](spark, FOLDER)
    assert sorted(names) == sorted(frame.columns)
    want = sorted((tuple(map(str, (r[names.index(c)] for c in frame.columns))) for r in cur.fetchall()))
    assert sorted(tuple(map(str, r)) for r in frame.collect()) == want


def test_all_operators_are_registered():
    numbers = {int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()}
    assert numbers == set(range(1, 14)) and {*queries.queries(), "pipeline"} <= set(contract.queries())


def test_classifiers_beat_the_share_of_the_larger_class(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    for name, column, least in (("op1_toxicity", "toxic", 0.9), ("op5_quality", "quality", 0.9)):
        rows = queries.queries()[name](spark, FOLDER).collect()
        assert len(rows) == 1000 and all(0 <= r["score"] <= 1 for r in rows)
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
        seen = [(r["predicted"], docs[r["doc_id"]][column]) for r in rows if r["held_out"] and r["doc_id"] in docs]
        assert sum(a == b for a, b in seen) / len(seen) >= least


def test_secret_query_equals_the_patterns(spark):
    patterns = [
        re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+"),
    ]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    total = 0
    for r in queries.op9_secrets(spark, FOLDER).collect():
        found = []
        for kind, p, least in zip(range(3), patterns, (8, 16, 32)):
            found += [(m.start(), kind, m.end()) for m in p.finditer(texts[r["doc_id"]]) if len(m[p.groups]) >= least]
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        counts = tuple(sum(k == i for _, k, _ in found) for i in range(3))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == counts and r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) - {""} <= set(r["spans"].split(","))
        total += len(found)
    assert total > 20


def test_pipeline_decides_and_keeps_clean_documents(spark, tmp_path):
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    folder = str(tmp_path)
    for t in ("labels", "benchmark"):
        save(spark.read.parquet(f"{FOLDER}/{t}.parquet"), folder, t)
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    prose = "Of the there heren and onthe in the that ediner, the andes were than.\nAnd it thether of the edin with on hare. The ere is. "
    base = prose + " ".join(f"thedin{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)) + "."
    extra = [
        (90_001, base + " One more end of it.", "en", "x", 1), (90_002, base + " Other close here.", "en", "x", 1),
        (90_003, prose + item, "en", "x", 1), (90_004, prose[::-1].lower().capitalize() + " token=" + "0123456789abcdef" * 2 + " and more.", "en", "x", 1),
    ]
    save(source.unionByName(spark.createDataFrame(extra, source.schema)), folder, "documents")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert 90_001 in out and 90_002 not in out and 90_003 not in out
    assert "0123456789abcdef" not in out[90_004]["text"] and PLACEHOLDER in out[90_004]["text"]
    assert all(len(r["text"]) == r["n_chars"] and len(r["piece_ids"]) > 0 for r in out.values())
    good = {r["doc_id"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").where("quality = 0").collect()}
    assert len(out) > 700 and len(good & set(out)) < 0.5 * len(good)


def test_pipeline_on_odd_rows_and_empty_tables(spark, tmp_path):
    for name, docs in (("odd", odd_documents(spark)), ("none", odd_documents(spark).limit(0))):
        folder = str(tmp_path / name)
        save(docs, folder, "documents")
        save(labels(spark, [(1, 1, 0), (4, None, None)]), folder, "labels")
        save(spark.createDataFrame([(1, "no such words here")], "item_id long, text string"), folder, "benchmark")
        out = corpus_pipeline.run(spark, folder)
        assert set(docs.columns) <= set(out.columns)
        ids = sorted(r["doc_id"] or 0 for r in out.collect())
        assert ids == ([] if name == "none" else [0, 1, 2, 3, 4, 5, 6])


def test_entry_point_works_without_the_subpackage(monkeypatch):
    import sys

    with monkeypatch.context() as m:
        m.setitem(sys.modules, "corpus_pipeline", None)
        importlib.reload(contract)
        assert not any(n.startswith("op1_") for n in contract.queries()) and "pipeline" not in contract.oracle_sql()
    importlib.reload(contract)
