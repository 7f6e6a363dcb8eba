"""Phrases of the passage operator, and texts hashed together."""

import random

import numpy as np
import pyarrow as pa

from quillon.llm import passages
from quillon.llm.words import placed_words, word_hashes

from . import brute


def words(r, n):
    return " ".join(f"w{r.randrange(400)}" for _ in range(n))


def test_texts_hashed_together_are_as_one_by_one():
    r = random.Random(3)
    texts = ["", words(r, 5), " \t" + words(r, 60).replace(" ", "\n\x0b ", 9) + " ", words(r, 19), words(r, 20), "é " * 40, "x" * 700_000 + " " + words(r, 300), words(r, 90_000), ""]
    texts = [t.encode() for t in texts]
    together = passages.words_of(texts)
    of, head, tail, anchors = passages.runs_of(together, 20)
    for i, t in enumerate(texts):
        a, b = together.bounds[i : i + 2]
        assert np.array_equal(together.hashes[a:b], word_hashes(t)) and together.cut(np.arange(a, b), np.arange(a, b)) == t.split()
        h, at = passages.anchors_of(word_hashes(t), 20)
        first = np.unique(at, return_index=True)[1]
        assert np.array_equal(head[of == i] - a, first) and np.array_equal(anchors[of == i].view(np.uint64), h[first])
        assert np.array_equal(tail[of == i] - a, [*(first[1:] - 1), len(h) - 1] if len(h) else [])
    h, starts, ends = placed_words(texts[6])
    assert len(h) == 301 and (starts[0], ends[0]) == (0, 700_000)
    batch = pa.RecordBatch.from_arrays([pa.array([None, *(t.decode() for t in texts)])], ["text"])
    assert [t for _, part in passages.pieces([batch]) for t in part] == [b"", *texts]


def test_a_phrase_is_one_pattern():
    """Windows in a row need one pattern, the whole phrase, and are found by one hit."""
    phrase = b" ".join(b"a%d" % i for i in range(30))
    segments = [(5, 0, b"x\n" + phrase + b" y"), (6, 0, b"x\n" + phrase + b" y"), (7, 0, phrase[4:]), (8, 0, "é é")]
    assert list(passages.occurrences([(phrase, [0], 1)], segments, None)) == [(i, [(30, (0, 1))]) for i in (0, 1)]


def test_parts_of_phrases(spark, monkeypatch):
    """Rows hold different parts of a passage, some as often as others: where that changes, a phrase ends."""
    r = random.Random(8)
    p = words(r, 60).split()
    cuts = [(0, 60), (0, 60), (0, 21), (1, 22), (3, 24), (2, 40), (2, 40), (30, 60), (25, 45), (39, 60), (0, 20), (40, 60)]
    rows = [(d, " ".join([words(r, r.randrange(4)), *p[a:b], words(r, r.randrange(4))])) for d, (a, b) in enumerate(cuts)]
    rows += [(90, " ".join(p[5:40] + p[8:36] + p[5:40])), (91, "v " * 70), (92, "v " * 45), (93, " ".join(p[:30] * 3))]
    for shard, stream in ((20_000, 100_000), (5, 4)):
        monkeypatch.setattr(passages, "SHARD_WINDOWS", shard)
        monkeypatch.setattr(passages, "STREAM", stream)
        docs = spark.createDataFrame(rows[::-1], "doc_id long, text string")
        got = {x.doc_id: (x.n_words, x.n_removed, x.kept_text) for x in passages.repeated_passages(docs).collect()}
        assert got == brute.passages(rows)
