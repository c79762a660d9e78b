"""Registered text queries, and the pipeline stage by stage against plain versions."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from check import TABLES, compare  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from doubtline.llm import queries  # noqa: E402
from test_duplicates import plain_components, plain_fingerprint, plain_removal  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.sql()))
def test_against_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cursor = con.execute(entry.oracle_sql()[name])
    assert compare([tuple(r) for r in df.collect()], df.columns, cursor.fetchall(), [d[0] for d in cursor.description]) == "ok"


@pytest.mark.parametrize("name", sorted(queries.plans()))
def test_every_query_gives_whole_results(spark, sf, name):
    rows = entry.queries()[name](spark, sf).count()
    if name.startswith("op10"):
        assert rows == spark.read.parquet(f"{sf}/pages.parquet").count()
    elif name not in ("pipeline", "op7_benchmark_leaks"):
        assert rows == spark.read.parquet(f"{sf}/documents.parquet").count()
    else:
        assert rows > 0


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert len(names) == 5
    stage = dict(corpus_pipeline.STAGES)
    accepted = stage[names[0]](spark, docs, sf)
    assert accepted.columns == columns and 0 < accepted.count() < docs.count()
    single = stage[names[1]](spark, accepted, sf)
    texts = {r.doc_id: r.text for r in accepted.collect()}
    fps, ids = {i: plain_fingerprint(t) for i, t in texts.items()}, sorted(texts)
    group = plain_components([(i, i) for i in ids] + [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 2])
    kept = {r.doc_id: r.text for r in single.collect()}
    assert single.columns == columns and kept == {i: texts[i] for i in set(group.values())}
    cut = stage[names[2]](spark, single, sf)
    order = sorted(kept)
    plain = plain_removal([kept[i] for i in order], 200)
    want = {i: plain[k][4] if plain[k][1] else kept[i] for k, i in enumerate(order)}
    assert cut.columns == columns
    assert {r.doc_id: r.text for r in cut.collect()} == {i: t for k, (i, t) in enumerate(want.items()) if not plain[k][1] or t.strip(" ")}
    clean = stage[names[3]](spark, cut, sf)
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = clean.collect()
    assert clean.columns == columns and not any(b in r.text for r in left for b in bench)
    tokens = stage[names[4]](spark, clean, sf)
    assert sorted(r.doc_id for r in tokens.collect()) == sorted(r.doc_id for r in left)
