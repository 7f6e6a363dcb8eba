import random

from quillon.llm import vectors
from quillon.llm.vectors import link_vectors

from . import brute


def test_more_labels_than_pivots(spark, monkeypatch):
    """Labels without pivots are joined whole, in several blocks where they are large; one label has pivots."""
    monkeypatch.setattr(vectors, "BLOCK", 3)
    r = random.Random(2)
    rows = []
    for label in range(12):
        base = [[r.gauss(0, 1) for _ in range(4)] for _ in range(40 if label == 0 else 1 + label % 5)]
        rows += [(v, label) for b in base for v in (b, [x + r.gauss(0, 0.05) for x in b])]
    rows = [(i, v, label) for i, (v, label) in enumerate(rows)]
    forest, links = brute.Forest(), dict.fromkeys(range(len(rows)), 0)
    for i, v, a in rows:
        for j, w, b in rows:
            if i != j and a == b and sum(x * y for x, y in zip(v, w)) / (sum(x * x for x in v) * sum(y * y for y in w)) ** 0.5 >= 0.98:
                links[i] += 1
                forest.tie(i, j)
    want = {i: (n, forest.root(i), forest.root(i) == i) for i, n in links.items()}
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for cell, most in ((10, 6), (1, 3), (1_000, 2)):
        got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in link_vectors(table, cell=cell, max_pivots=most).collect()}
        assert got == want
