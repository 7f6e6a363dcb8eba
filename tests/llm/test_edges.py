"""Nulls, repeated rows, long texts, ties and clashing columns."""

import math
import random

import numpy as np
import pytest

from quillon.llm import passages
from quillon.llm.exact import drop_exact_copies, exact_groups
from quillon.llm.language import fit_languages, predict_languages
from quillon.llm.lines import dedup_lines
from quillon.llm.mixing import TARGETS, fit_domains, fit_rates, memberships, mix, mixed_rows
from quillon.llm.near import bands_for, drop_near_copies, most_bits, near_duplicates, odd_sketch
from quillon.llm.passages import repeated_passages
from quillon.llm.quality import fit_quality, keep_quality, labelled_sample, score_quality
from quillon.llm.secrets import find_secrets
from quillon.llm.vectors import link_vectors

from . import brute

SF = "/root/testdata/sf0.01"
CLASH = "doc_id long, text string, _id int, _sha int, _own_sha int, _text_sha256 int, _p int, p int, q int, _row int, _copies int, id int, sha int, own_sha int, lang string"


def text(r, n):
    return " ".join(f"w{r.randrange(300)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """(doc_id, text) with nulls, empty, repeated and very long texts."""
    r = random.Random(5)
    base, long = text(r, 60), text(r, 30_000)
    return [(1, base), (1, base), (2, base + " tail"), (2, None), (None, base), (None, None), (3, ""), (3, ""), (4, long), (5, long + " end"), (6, "x"), (None, base)]


def clashing(spark, rows):
    return spark.createDataFrame([(d, t, *range(12), "en") for d, t in rows], CLASH).repartition(3)


def test_stages_keep_columns_of_any_name(spark, odd_rows):
    docs = clashing(spark, odd_rows)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for stage in (drop_exact_copies, drop_near_copies, lambda d: keep_quality(d, labels), lambda d: mixed_rows(d, labels)):
        out = stage(docs)
        assert out.columns == docs.columns
        assert all(tuple(row)[2:-1] == tuple(range(12)) for row in out.collect())
    got = predict_languages(docs, fit_languages(docs))
    assert set(docs.columns) < set(got.columns) and {row._p for row in got.collect()} == {4}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sample = clashing(spark, [(row.doc_id, row.text) for row in spark.read.parquet(f"{SF}/documents.parquet").limit(300).collect()])
    for stage in (lambda d: keep_quality(d, labels), lambda d: mixed_rows(d, labels)):
        out = stage(sample)
        assert out.columns == docs.columns and 0 < out.count() <= 4 * 300


def test_near_with_nulls_and_repeats(spark, odd_rows):
    got = sorted(((r.doc_id or 0), r.n_shingles, (r.component_id or 0), r.kept) for r in near_duplicates(clashing(spark, odd_rows)).collect())
    sizes = {}
    for _, t in odd_rows:
        w = (t or "").split()
        sizes[t] = len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else 0
    root = {1: 1, 2: 1, None: None, 3: 3, 4: 4, 5: 4, 6: 6}
    root = [(d, t, root[d] if t else d) for d, t in odd_rows]  # a row without shingles is its own
    assert got == sorted(((d or 0), sizes[t], (c or 0), c == d) for d, t, c in root)


def test_near_large_bucket_in_blocks(spark, monkeypatch):
    """Copies of one text with edits: members that don't link with a hub but with one another, in small blocks."""
    from quillon.llm import near

    monkeypatch.setattr(near, "BLOCK", 7)
    monkeypatch.setattr(near, "PAIRS", 5)
    r = random.Random(9)
    base = text(r, 80).split()

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[r.randrange(len(words))] = f"e{r.randrange(10_000)}"
        return words

    variants = [edited(base, r.randrange(1, 6)) for _ in range(60)]
    rows = list(enumerate(" ".join(edited(r.choice(variants), r.randrange(3))) for _ in range(150)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_duplicates(clashing(spark, rows)).collect()}
    assert got == brute.near(rows, 80)


def test_sketches_pass_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    for percent in (80, 85):
        assert (1 - (percent / 100) ** 6) ** bands_for(percent) <= 1e-6
        for n in (7, 60, 300, 2_000, 20_000):
            for _ in range(40):
                common = math.ceil(2 * n * percent / (100 + percent))
                x = rng.integers(0, 2**64, 2 * n - common, dtype=np.uint64)
                a, b = np.sort(x[:n]), np.sort(np.r_[x[:common], x[n:]])
                assert np.bitwise_count(odd_sketch(a) ^ odd_sketch(b)).sum() <= most_bits(np, float(n), float(n), percent)


def repeated(rows, window=20):
    """Passages where rows may repeat a doc_id: (doc_id, start) orders the windows."""
    top = 2**63 - 1
    first = {}
    split = [((top if d is None else d), d, (t or "").encode().split()) for d, t in rows]
    for k, _, w in split:
        for i in range(len(w) - window + 1):
            s = tuple(w[i : i + window])
            first[s] = min(first.get(s, (k, i)), (k, i))
    out = []
    for k, d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (k, i):
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append(((d or 0), len(w), len(w) - len(kept), b" ".join(kept).decode()))
    return sorted(out)


def test_passages_with_nulls_and_repeats(spark, odd_rows, monkeypatch):
    r = random.Random(2)
    passage = text(r, 40)
    rows = [*odd_rows, (7, f"a b {passage} c"), (7, f"{passage} {passage[:150]}"), (8, passage), (8, f"{text(r, 5)} {passage}"), (0, passage[30:] + " z")]
    for shard, stream in ((20_000, 20_000), (3, 2)):
        monkeypatch.setattr(passages, "SHARD_WINDOWS", shard)
        monkeypatch.setattr(passages, "STREAM", stream)
        got = sorted(((x.doc_id or 0), x.n_words, x.n_removed, x.kept_text) for x in repeated_passages(clashing(spark, rows)).collect())
        assert got == repeated(rows)


def test_passages_are_decided_by_occurrences():
    """The automaton finds windows of passages in any place, and nothing else."""
    a = " ".join(f"a{i}" for i in range(30))
    found = list(passages.occurrences([(a, [0, 10], 1)], [(5, 100, f"x {a}"), (6, 0, a[4:]), (7, 0, "x y")], 20))
    assert found == [(0, [(20, (0, 1)), (30, (1, 1))]), (1, [(28, (1, 1))])]


def test_lines_with_nulls_repeats_and_long_texts(spark):
    line = "every one of these documents has got this very long line " * 2
    rows = [(i, line) for i in range(4)] + [(3, line), (None, line), (None, line), (9, f"{line}\n" + "word " * 50_000), (9, None)]
    got = sorted(((r.doc_id or 0), r.n_lines, r.n_dropped) for r in dedup_lines(clashing(spark, rows)).collect())
    assert got == sorted([(0, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (3, 1, 1), (0, 1, 1), (0, 1, 1), (9, 2, 0), (9, 1, 0)])


def test_lines_in_many_batches(spark):
    r = random.Random(4)
    lines = [f"line number {i} " * 4 for i in range(12)]
    rows = [(i, "\n".join(r.sample(lines, r.randrange(5)))) for i in range(80)]
    held = {x: [i for i, t in rows if x in t.split("\n")] for x in lines}
    want = {i: sum(len(held[x]) >= 5 and i < max(held[x]) for x in t.split("\n") if t) for i, t in rows}
    for keys, fan_in in ((1_000_000, 2), (4, 2), (4, 3)):
        got = {x.doc_id: x.n_dropped for x in dedup_lines(clashing(spark, rows), batch_keys=keys, fan_in=fan_in).collect()}
        assert got == want


def test_secrets_with_repeats_and_long_texts(spark):
    long = "abc " * 50_000 + "secret=abcdefgh " + "0123456789abcdef" * 2
    rows = [(1, "token: abcdef"), (1, "x"), (1, "token: abcdef"), (None, "AKIA" + "B" * 16), (None, None), (2, long)]
    got = sorted(((r.doc_id or 0), r.base_spans) for r in find_secrets(clashing(spark, rows)).collect())
    assert got == sorted(((d or 0), brute.secrets(t)[1]) for d, t in rows)


def test_exact_long_texts(spark, odd_rows):
    got = sorted((r.keep_id or 0, r.group_size) for r in exact_groups(clashing(spark, odd_rows)).collect() if r.doc_id in (4, 5))
    assert got == [(4, 1), (5, 1)]


def test_vectors_with_nulls_repeats_and_ties(spark):
    angle = lambda c: [c, math.sqrt(1 - c * c)]
    inf = float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, angle(0.98 + 1e-12), 1), (3, angle(0.98 - 1e-9), 1), (4, [inf, 1.0], 1), (5, [None, 1.0], 1), (None, [1.0, 0.0], 1), (6, [2.0, 0.0], 1), (6, [2.0, 0.0], 1), (7, [1.0, 0.0], None)]
    table = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<double>, label int, rep int, part int")
    got = sorted(((x.vec_id or 0), x.n_links, (x.component_id or 0)) for x in link_vectors(table).collect())
    # 3 links with 2; 1 with 2 and both rows of 6.
    assert got == sorted([(1, 3, 1), (2, 4, 1), (3, 1, 1), (4, 0, 4), (5, 0, 5), (0, 0, 0), (6, 3, 1), (6, 3, 1), (7, 0, 7)])


def test_samples_are_bounded_by_rows(spark):
    docs = spark.createDataFrame([(1, f"t{i}") for i in range(300)] + [(2, "u")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    assert labelled_sample(docs, labels, labels.quality, 2).count() == 2
    assert labelled_sample(docs, labels, labels.quality, 1).count() == 1


def test_one_class_and_empty_tables(spark):
    docs = clashing(spark, [(i, f"word {i}") for i in range(40)])
    one = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert {r.score for r in score_quality(docs, fit_quality(docs, one)).collect()} == {1.0}
    assert keep_quality(docs, one).count() == 40 and mix(docs, one).count() == 40
    empty = clashing(spark, [])
    assert keep_quality(empty, one).count() == mixed_rows(empty, one).count() == mix(empty, one).count() == 0
    assert predict_languages(empty, fit_languages(docs)).count() == 0


def test_targets_are_met(spark):
    """Expected tokens of each domain, from the rates and posteriors of all documents, against the targets."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = mix(docs, labels).toPandas()
    p, n = np.stack(got.posteriors), got.n_tokens.to_numpy(float)
    have = (got.rate.to_numpy() * n) @ p / n.sum()
    model = fit_domains(docs, labels)
    rates = fit_rates(memberships(docs.select("doc_id", "text"), model), model.classes, TARGETS)
    assert have == pytest.approx([rates.achieved[c] for c in model.classes], rel=1e-6)
    assert rates.unmet(0.01) == {} and have == pytest.approx([TARGETS[c] for c in model.classes], rel=0.011)
    with pytest.warns(UserWarning, match="targets not met"):
        least = fit_rates(memberships(docs.select("doc_id", "text"), model), model.classes, {**TARGETS, "q0t1": 0.9}, most=1.0, steps=3)
    assert "q0t1" in least.unmet(0.01)


def test_scores_equal_a_plain_version(spark):
    """Quality scores and language posteriors from the fitted models, computed a document at a time."""
    from quillon.llm.features import SHAPES, TOKEN, shape_of
    from quillon.llm.language import LETTER, counts_of

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = docs.limit(60).collect()
    few = spark.createDataFrame([(r.doc_id, r.text) for r in rows] + [(-1, None), (-2, "")], "doc_id long, text string")
    model = fit_quality(docs, labels)
    known = {w: i + len(SHAPES) for i, w in enumerate(model.words)}
    got = {r.doc_id: r.score for r in score_quality(few, model).collect()}
    for doc_id, t in [(r.doc_id, r.text) for r in rows] + [(-1, ""), (-2, "")]:
        at = [known.get(w, shape_of(w)) for w in TOKEN.findall(t)]
        v, w = model.vectors[at].astype(float), model.weights[at].astype(float)
        x = np.concatenate([v.sum(0) / max(1, len(at)), w @ v / (w.sum() + 1e-9)])
        net = model.network
        z = (np.tanh((x - net.mean) / net.std @ net.w1 + net.b1) @ net.w2 + net.b2) / net.temperature
        assert got[doc_id] == pytest.approx(float(np.exp(z[1]) / np.exp(z).sum()), abs=1e-3)
    fitted = fit_languages(docs)
    (names, prior, logs), = fitted
    said = {r.doc_id: (r.lang_pred, r.score) for r in predict_languages(few, fitted).collect()}
    for r in rows:
        z = prior + counts_of(r.text, len(logs)) @ logs.astype(float)
        p = np.exp(z - z.max())
        assert said[r.doc_id] == ((names[int(z.argmax())], pytest.approx(float(p.max() / p.sum()), abs=1e-6)) if LETTER.search(r.text) else ("und", 0.0))
