"""The batch searches over whole tables against plain versions."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions.text import query_words
from quillon.operators import vectors
from quillon.operators.graph import dependency_edges
from quillon.operators.lexical import name_score, path_score, top
from quillon.plans.catalog import QUERIES_BY_NAME, files
from quillon.sources import tables


def test_bm25_of_every_benchmark_text(spark, sf_dir):
    docs = {r.doc_id: Counter(r.text.lower().split()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    asked = {r.item_id: r.text.lower().split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    assert max(asked) >= 20 and max(map(len, asked.values())) > 6
    df = Counter(t for d in docs.values() for t in d)
    raw = {t: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    length = {i: sum(d.values()) for i, d in docs.items()}
    mean = sum(length.values()) / len(length)
    want = {}
    for q, terms in asked.items():
        s = {i: sum((raw[t] if raw[t] >= 0 else floor) * d[t] * 2.5 / (d[t] + 1.5 * (0.25 + 0.75 * length[i] / mean)) for t in terms if t in d) for i, d in docs.items()}
        best = sorted((-round(x, 9), i) for i, x in s.items() if x > 0)[:10]
        want |= {(q, i): -x for x, i in best}
    got = {(r.query_id, r.doc_id): r.score for r in QUERIES_BY_NAME["bm25_batch_whole"](spark, sf_dir).collect()}
    assert {q for q, _ in got} == set(asked)
    assert got == pytest.approx(want, abs=1e-4)


def test_vectors_of_ids_divisible_by_100(spark, sf_dir):
    rows = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect())
    x = np.array([e for _, e in rows], np.float64)
    assert rows[-1][0] >= 100
    want = {}
    for i, (q, _) in enumerate(rows):
        if q % 100 == 0:
            s = x @ x[i]
            for n, j in enumerate(sorted(range(len(rows)), key=lambda j: (-round(s[j], 12), rows[j][0]))[:5]):
                want[q, rows[j][0]] = (n + 1, min(1.0, max(0.0, s[j])))
    got = {(r.query_id, r.vec_id): (r.rank, r.score) for r in QUERIES_BY_NAME["vector_batch"](spark, sf_dir).collect()}
    assert {k: r for k, (r, _) in got.items()} == {k: r for k, (r, _) in want.items()}
    assert {k: s for k, (_, s) in got.items()} == pytest.approx({k: s for k, (_, s) in want.items()}, abs=1e-6)
    near = {(r.query_id, r.vec_id): r.score for r in QUERIES_BY_NAME["semantic_threshold"](spark, sf_dir).collect()}
    assert near == pytest.approx({k: s for k, (_, s) in want.items() if s >= 0.3}, abs=1e-6)


def test_many_queries_meet_vectors_in_blocks(spark, monkeypatch):
    """Many queries make no row for each pair in the plan, and in several blocks give what row by row gives: ties, nulls, lengths, NaN, paths twice."""
    rng = np.random.default_rng(5)
    rows = [(f"p{i % 90:02}", [float(x) for x in rng.integers(-3, 4, 3)], i % 7) for i in range(130)]
    rows += [("n", None, 1), ("m", [1.0, None, 2.0], 2), ("l", [1.0, 2.0], 3), ("e", [], 4), ("x", [float("nan"), 1.0, 1.0], 5), ("y", [float("inf"), 1.0, 0.0], 6), (None, [1.0, 1.0, 1.0], 7)]
    given = spark.createDataFrame(rows, "path string, embedding array<float>, line_count int")
    asked = spark.createDataFrame([(i, v) for i, (_, v, _) in enumerate(rows[100:])], "query_id int, vector array<float>")
    for name, size in (("VECTOR_BLOCK", 40), ("QUERY_BLOCK", 15), ("TILE_QUERIES", 4), ("TILE_VECTORS", 7)):
        monkeypatch.setattr(vectors, name, size)
    whole = vectors.vector_search(given, asked, 1000)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner" not in plan
    best = vectors.in_blocks(given, asked, 6).select("query_id", "path", "raw")
    row = vectors.by_row(given, asked).select("query_id", "path", "raw")
    first = lambda df: Counter((r.query_id, r.path, str(r.raw), r.rank) for r in top(df, 6, F.desc("raw"), F.asc("path")).collect())
    assert first(best) == first(row)
    assert best.count() < row.count()
    every = lambda df: Counter((r.query_id, r.path, str(r.raw)) for r in df.collect())
    assert every(vectors.in_blocks(given, asked, 1000)) == every(row)


def test_files_are_dealt_out(spark, sf_dir, monkeypatch):
    """The rows of a file of one row group are not one task, and a task's share doesn't grow with them."""
    sizes = lambda df: [len(list(x)) for x in df.rdd.glom().collect()]
    parts = sizes(files(spark, sf_dir).select("relative_path"))
    assert len(parts) == 4 and max(parts) < sum(parts) / 2
    monkeypatch.setattr(tables, "ROWS_A_PART", 20)
    more = sizes(files(spark, sf_dir).select("relative_path"))
    assert sum(more) == sum(parts) and len(more) == -(-sum(parts) // 20)


def test_search_computes_a_tier_once(spark, sf_dir):
    """Answers come from stored tiers, not from tiers computed at each mention; words of a query are not split at each name."""
    assert "bm25" not in QUERIES_BY_NAME["search_enriched"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.createDataFrame([("get red", ["get_red", "Redo"], "src/red.py"), ("", ["a"], "b"), ("x y", [], "y/z")], "query string, names array<string>, path string").withColumn("tokens", query_words("query"))
    q, names, path, tokens = (F.col(c) for c in ("query", "names", "path", "tokens"))
    for r in rows.select(F.array(name_score(q, names), path_score(q, path)), F.array(name_score(q, names, tokens), path_score(q, path, tokens))).collect():
        assert r[0] == r[1]
    assert "split" not in str(name_score(q, names, tokens)) + str(path_score(q, path, tokens))


def test_imports_are_resolved_once_each(spark):
    """Edges join files to their resolved distinct imports; lookups of all names are no part of that plan."""
    given = [("a/x.py", ["y", "a.y", None, "os"]), ("a/y.py", ["b/y", "x", "y"]), ("b/y.py", ["a::x", "y"]), ("c.py", None), ("d.py", ["q.c", "q/c", "d"])]
    edges = dependency_edges(spark.createDataFrame(given, "relative_path string, imports array<string>"))
    assert {tuple(r) for r in edges.collect()} == {("a/x.py", "a/y.py"), ("a/y.py", "b/y.py"), ("a/y.py", "a/x.py"), ("b/y.py", "a/x.py"), ("b/y.py", "a/y.py"), ("d.py", "c.py")}
    assert edges.count() == 6
    assert edges._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1


def test_keyword_scores_are_stored_where_no_postings_are(spark, sf_dir):
    plan = QUERIES_BY_NAME["fast_composite"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(terms" not in plan and "qtf" not in plan
