import numpy as np
import pytest

from quillon.llm.language import fit_languages, predict_languages
from quillon.llm.mixing import Rates, fit_rates, mix
from quillon.llm.quality import fit_quality, keep_quality, score_quality

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_held_out(spark, tables):
    docs, labels = tables
    got = score_quality(docs, fit_quality(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.9 and got.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (None, "x", 9.0)], "doc_id long, text string, score double")
    assert all(0 <= r.score <= 1 for r in score_quality(odd, fit_quality(docs, labels)).collect())
    assert keep_quality(docs, labels.limit(0)).columns == docs.columns


def test_language_held_out(spark, tables):
    docs, _ = tables
    model = fit_languages(docs)
    got = predict_languages(docs, model).where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (4, "the of and")], "doc_id long, text string")
    assert [r.lang_pred for r in predict_languages(odd, model).orderBy("doc_id").collect()][:3] == ["und"] * 3
    assert {r.lang_pred for r in predict_languages(odd, fit_languages(docs.limit(0))).collect()} == {"und"}


def test_rates_against_dense_solution(spark):
    rng = np.random.default_rng(0)
    p = rng.dirichlet([1.0, 0.5, 0.3], 400)
    n = rng.integers(1, 500, 400)
    members = spark.createDataFrame([(int(a), *map(float, x)) for a, x in zip(n, p)], "n_tokens long, p0 double, p1 double, p2 double")
    targets = {"a": 0.3, "b": 0.5, "c": 0.2}
    r = fit_rates(members, list(targets), targets, steps=80, tolerance=1e-3).replay(p)[0]
    assert (r >= 0).all()
    assert np.abs((n * r) @ p / n.sum() - [0.3, 0.5, 0.2]).max() < 2e-3
    # Against a plain run of the same objective on one machine.
    share, ridge = n / n.sum(), 1e-4
    w, plain = 1 / (share @ p), np.ones(400)
    for _ in range(20_000):
        plain = np.clip(plain - 0.3 * (p @ (w * ((share * plain) @ p - [0.3, 0.5, 0.2])) + ridge * (plain - 1)), 0, 4)
    assert np.abs((share * plain) @ p - (share * r) @ p).max() < 5e-3
    assert Rates(1.0, 1e-3, 4.0).replay(p)[0].tolist() == [1.0] * 400


def test_mix(spark, tables):
    docs, labels = tables
    got = mix(docs, labels).toPandas()
    assert len(got) == docs.count() and (got.rate >= 0).all()
    assert {r.rate for r in mix(docs, labels.limit(0)).collect()} == {1.0}
