"""Registered queries against their SQL, the pipeline against plain versions, and the guard."""

import importlib.util
from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__ as contract
import corpus_pipeline
from tests.llm import odd
from tests.llm.test_documents import contamination, jump, mixed
from tidyloom.llm import quality
from tidyloom.llm.oracles import ORACLES
from tidyloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert QUERIES.keys() <= contract.queries().keys() and "pipeline" in contract.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    answer = duck.execute(ORACLES[name])
    columns = sorted(d[0] for d in answer.description)
    rows = QUERIES[name](spark, SF).select(columns).collect()
    order = [[d[0] for d in answer.description].index(c) for c in columns]
    assert Counter(map(repr, map(tuple, rows))) == Counter(repr(tuple(r[i] for i in order)) for r in answer.fetchall())


def test_pipeline(spark):
    """Each stage's decisions, from the classifier's model on by plain versions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = quality.score(docs, quality.train(docs, labels), 1).where("keep").collect()
    prints = [odd.fingerprint(r.text) for r in good]
    near = [(i, j) for i in range(len(good)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    root = odd.roots(len(good), near)
    first = defaultdict(list)
    for i, r in enumerate(good):
        first[root[i]].append(r)
    single = [min(rows, key=lambda r: r.doc_id) for rows in first.values()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {k[0] for k in contamination([(r.doc_id, r.text, None) for r in single], items) if k[5]}
    clean = [r for r in single if r.doc_id not in bad]

    rows = corpus_pipeline.run(spark, SF).collect()
    targets = mixed([(r.doc_id, r.text, r.source) for r in clean])
    size = {r.doc_id: len(odd.words(r.text)) for r in clean}
    copies, taken = Counter(r.doc_id for r in rows), defaultdict(int)
    assert copies.keys() <= size.keys() and max(copies.values()) <= 3
    for r in rows:
        taken[r.source] += size[r.doc_id]
        assert (r.shard, r.grown_shard) == (jump(r.doc_id, 24), jump(r.doc_id, 25))
    assert all(abs(taken[s] - t) <= max(size.values()) for s, (_, t) in targets.items())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_pipeline_without_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_other_queries_remain_without_the_package(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if "llm" in name or name == "corpus_pipeline" else find(name, *a))
    assert not any(n.startswith("op") or n == "pipeline" for n in contract.queries()) and contract.queries()
