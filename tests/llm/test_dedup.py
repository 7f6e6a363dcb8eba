import random

import pytest

from quillon.llm.components import components
from quillon.llm.exact import drop_exact_copies, exact_groups
from quillon.llm.lines import dedup_lines
from quillon.llm.near import drop_near_copies, near_duplicates
from quillon.llm.passages import repeated_passages
from quillon.llm.secrets import RULES, find_secrets, trigram_query
from quillon.llm.vectors import link_vectors

from . import brute

SCHEMA = "doc_id long, text string, key int, h1 int, component_id int, label string"


def frame(spark, rows):
    """Extra columns have names that the operators use themselves."""
    return spark.createDataFrame([(d, t, 1, 2, 3, "x") for d, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["É", "漢字", "x\x1cy"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = [text(60) for _ in range(12)]
    out = [*base, None, "", " \t\n", "one two", "One  TWO", "one two three"]
    for b in base[:6]:
        w = b.split()
        out += [b, b.upper(), " ".join(w[:30] + ["new"] + w[30:]), " ".join(w[:5] + ["a", "b"] + w[7:40] + ["c"] + w[41:]), "\t" + b.replace(" ", "\n", 9)]
    passage = text(25)
    out += [f"{text(10)} {passage} {text(10)} {passage} {text(3)}" for _ in range(4)] + [("w1 " * 90).strip(), text(3000) + " " + passage]
    return list(enumerate(out))


def test_exact(spark, rows):
    docs = frame(spark, rows)
    for bits in (64, 2):  # two bits: nearly all chunk hashes are shared
        got = sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_groups(docs, bits=bits).collect())
        assert got == brute.exact(rows)
    kept = {r.doc_id for r in drop_exact_copies(docs).collect()}
    assert kept == {k for _, k, _, _ in brute.exact(rows)}


def test_exact_repeated_rows(spark):
    docs = frame(spark, [(5, "a"), (5, "a"), (None, "a"), (None, "b"), (None, "b"), (7, "c")])
    got = sorted(((r.doc_id or 0), (r.keep_id or 0), r.group_size, r.kept) for r in exact_groups(docs).collect())
    assert got == [(0, 0, 2, False), (0, 0, 2, True), (0, 5, 3, False), (5, 5, 3, False), (5, 5, 3, True), (7, 7, 1, True)]
    out = drop_exact_copies(docs)
    assert out.columns == docs.columns and sorted(r.text for r in out.collect()) == ["a", "b", "c"]


def test_near(spark, rows):
    docs = frame(spark, rows)
    for percent in (85, 60):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, percent=percent).collect()}
        assert got == brute.near(rows, percent)
    roots = {c for _, c in brute.near(rows, 80).values()}
    out = drop_near_copies(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == roots


def test_passages(spark, rows):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in repeated_passages(frame(spark, rows)).collect()}
    assert got == brute.passages(rows)


def test_lines(spark):
    line = "A long line of text that many documents hold, É " * 2
    rows = [(i, f"{line}\nown {i}\n  {line.lower().replace('é', 'É')}\t") for i in range(6)] + [(10, None), (11, ""), (12, "short\n" * 3), (3, line)]
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(frame(spark, rows)).collect())
    want = [(i, 3, 2, f"own {i}") for i in range(5)] + [(3, 1, 1, ""), (5, 3, 0, rows[5][1]), (10, 1, 0, ""), (11, 1, 0, ""), (12, 4, 0, "short\n" * 3)]
    assert got == sorted(want)


def test_secrets(spark):
    texts = [None, "", "x", 'PassWord = "abcdef" token: abc, secret=ABCDEFG', "AKIA" + "A1" * 8 + " AKIAXX é漢 " + "ab12" * 9, "api_key='zz/zz+zz' apikey:1234567 passwd  =  qqqqqq", "f" * 23 + " " + "0" * 24, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36]
    got = {r.doc_id: r for r in find_secrets(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        counts, spans = brute.secrets(t)
        assert ((got[i].n_assign, got[i].n_access, got[i].n_hex), got[i].base_spans) == (counts, spans)
    assert got[7].spans.startswith("pem:0:") and "forge:0:40" in got[8].spans
    assert {r.kind: bool(trigram_query(r.pattern)) for r in RULES} == {"assign": True, "access": True, "hex": False, "pem": True, "forge": True}


def test_vectors(spark):
    r = random.Random(1)
    base = [[r.gauss(0, 1) for _ in range(8)] for _ in range(40)]
    rows = [(i, v, i % 2) for i, v in enumerate(base)] + [(100 + i, [x + r.gauss(0, 0.05) for x in v], i % 2) for i, v in enumerate(base)] + [(200 + i, base[0], 0) for i in range(5)]
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan"), 1.0], 0), (303, base[0], None), (304, [], 0), (305, base[0][:7], 0)]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cell=5).collect()}
    forest, links = brute.Forest(), dict.fromkeys((i for i, _, _ in rows), 0)
    usable = [x for x in rows if x[1] and x[2] is not None and any(x[1]) and all(v == v for v in x[1])]
    for i, v, a in usable:
        for j, w, b in usable:
            if i != j and a == b and len(v) == len(w) and sum(x * y for x, y in zip(v, w)) / (sum(x * x for x in v) * sum(y * y for y in w)) ** 0.5 >= 0.98:
                links[i] += 1
                forest.tie(i, j)
    assert got == {i: (n, forest.root(i), forest.root(i) == i) for i, n in links.items()}


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(50, 51), (60, 60)], "a long, b long")
    assert {r.id: r.component_id for r in components(links).collect()} == {**dict.fromkeys(range(41), 0), 50: 50, 51: 50}


def test_empty_tables(spark):
    docs = frame(spark, [])
    for f in (exact_groups, near_duplicates, repeated_passages, dedup_lines, find_secrets):
        assert f(docs).count() == 0
    assert link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
