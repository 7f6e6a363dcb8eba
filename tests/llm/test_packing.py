import functools
import zlib

import numpy as np

from quillon.llm.packing import pack, tokenizer_file

SCHEMA = "doc_id long, text string, sequence_id int"


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def brute_ids(text):
    t = tokenizer()
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def check(rows, texts, size):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for k, pieces in by_doc.items():
        ids, at = brute_ids(texts[k]), 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
    return len(by_sequence)


def test_round_trip_of_odd_texts(spark):
    texts = {1: None, 2: "", 3: "a", 4: "It's  the\tEND.\n\nof <|endoftext|> x" * 40, 5: "éá ß ΑΣ ΑΣΣ İx 漢字  z\x1cq\r\n12 345", 6: "word " * 9000, 8: "A. b, c.d e.. f., 'S it'LL. é. Ü, 9. _. x_, İ. ǅ, e\u0301. ﬁ, \u0345. z" * 9, 7: "don't we'll I'm" * 3}
    docs = spark.createDataFrame([(k, v, 0) for k, v in texts.items()], SCHEMA).repartition(3)
    check(pack(docs, tokenizer_file(), window=64, open_windows=2, min_cut=4).collect(), texts, 64)


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert pack(docs, tokenizer_file()).count() == 0
    docs = spark.createDataFrame([(1, "a b", 0), (1, "a b", 0), (None, "c", 0)], SCHEMA)
    assert sorted((r.doc_id or -1, r.length) for r in pack(docs, tokenizer_file()).collect()) == [(-1, 2), (1, 3), (1, 3)]


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pack(docs, tokenizer_file()).collect()
    n = check(rows, texts, 2048)
    assert sum(r.length for r in rows) / (n * 2048) > 0.95


def test_word_ids_equal_the_tokenizer_on_odd_marks():
    import random

    from quillon.llm.packing import WordIds

    words, draw = WordIds(tokenizer_file()), random.Random(1)
    parts = [*"abzéßAÉ19²¼ªº_.,.,.,  \n\n\t\r\x1c\x85\xa0!?\"'&-", "'s", "İ", "ſ", "... ", ". ", ", ", "word", "ž"]
    for _ in range(5_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))
        assert words.ids(text) + (1).to_bytes(4, "little") == brute_ids(text).tobytes(), text
