"""The stages of the pipeline and its whole run against plain versions."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm.mixing import TARGETS, copies_of, fit_domains, memberships
from quillon.llm.quality import fit_quality, score_quality

from . import brute
from .test_packing import check


def dense_rates(p, n, classes):
    """Plain projected steps on one machine: rates at most 1, the total set by the tokens of q1t0."""
    share = n / n.sum()
    weight = np.array([TARGETS[c] for c in classes])
    m0 = share @ p
    want = m0[classes.index("q1t0")] / TARGETS["q1t0"] * weight
    w, ridge, r = 1 / np.maximum(m0, 1e-6), 1e-4, np.ones(len(n))
    eta = 1 / (np.linalg.eigvalsh(np.sqrt(w)[:, None] * (p.T * share @ p) * np.sqrt(w))[-1] + ridge)
    for _ in range(20_000):
        r = np.clip(r - eta * (p @ (w * (share * r @ p - want)) + ridge * (r - 1)), 0, 1)
    return r


def test_stages_and_run(spark, sf_dir, tmp_path):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        kept = sorted(r.doc_id for r in out.select("doc_id").collect())
        if name == "quality":
            model = fit_quality(docs, labels)
            assert model.classes
            scores = {r.doc_id: r.score for r in score_quality(docs, model).collect()}
            want = sorted(i for i, s in scores.items() if s >= 0.5)
        elif name == "exact_dedup":
            want = sorted({k for _, k, _, _ in brute.exact(rows)})
        elif name == "near_dedup":
            want = sorted({c for _, c in brute.near(rows, 80).values()})
        elif name == "mixing":
            model = fit_domains(docs, labels)
            t = memberships(docs.select("doc_id", "text"), model).toPandas()
            p = t[[f"p{i}" for i in range(len(model.classes))]].to_numpy(np.float64)
            rates = dense_rates(p, t.n_tokens.to_numpy(np.float64), model.classes)
            given = spark.createDataFrame([(int(i), float(r)) for i, r in zip(t.doc_id, rates)], "doc_id long, rate double")
            dense = {r.doc_id for r in given.where(copies_of(F.col("rate")) > 0).collect()}
            assert len(kept) == len(set(kept)) and len(dense ^ set(kept)) <= 0.02 * len(rows)
            want = kept
        else:
            check(out.collect(), dict(rows), 2048)
            break
        assert kept == want and out.columns == columns, name
        assert 0 < len(kept) <= len(rows)
        docs = out
    got = corpus_pipeline.run(spark, sf_dir).collect()
    check(got, dict(rows), 2048)
