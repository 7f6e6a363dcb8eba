"""Packing: bounded-space online packing of token ids into windows.

Each partition keeps a fixed number of open windows. A document's whole windows are emitted at once; its rest goes
where it fits best; when it fits nowhere the fullest window is emitted, filled by a cut piece if the gap is worth one.
What is still open when a partition ends is merged in one further round, as whole windows, largest first.
"""

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, documents, remembered, saved

#: Appended to each document's ids.
END_ID = 1
#: Words remembered with their ids by each Python worker.
REMEMBERED = 300_000
#: Where lower case might depend on context or composition, a text is left to the tokenizer as it is.
BEYOND_LATIN = re.compile("[^\\x00-\u024f]")
#: A point or comma alone between a letter and white space is a word of its own.
MARK = re.compile(r"(?<=[a-zß-öø-ÿ])([.,])(?=[ \n])")
#: A mark that belongs to a longer run of symbols; without one (and without "_"), every mark before white space is alone.
RUN = re.compile(r"[^\w \n][.,][ \n]")
#: Windows that one task of the merging round takes at about the most.
MERGED = 2048

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window_id long, offset long, open boolean"


class WordIds(dict):
    """Text without spaces or newlines to its ids as little-endian 32-bit bytes.

    The tokenizer lowers case, drops white space and never joins across it, or from a letter to a mark, so a text's
    ids are those of its parts, in order. The first words seen are remembered, up to a bound.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, words: list[str]) -> dict[str, bytes]:
        """Ids of many words from one call: a token belongs to the word in which it starts."""
        out = {}
        for i in range(0, len(words), 4_000):
            part = words[i : i + 4_000]
            got = self.tokenizer.encode("\n".join(part), add_special_tokens=False)
            ids = np.array(got.ids, "<u4").tobytes()
            ends = np.cumsum([len(w) + 1 for w in part])
            cuts = np.searchsorted([a for a, _ in got.offsets], ends) * 4
            at = 0
            for word, cut in zip(part, cuts.tolist()):
                out[word] = ids[at:cut]
                at = cut
        if len(self) + len(out) <= REMEMBERED:
            self.update(out)
        return out

    def ids(self, text: str) -> bytes:
        if not BEYOND_LATIN.search(text):
            text = text.lower()
            if "_" in text or RUN.search(text):
                text = MARK.sub(r" \1", text)
            else:
                text = text.replace("\n", " ").replace(". ", " . ").replace(", ", " , ")
        words = text.replace("\n", " ").split(" ")
        out = list(map(self.get, words))
        if None in out:
            new = self.encode(list({w for w, x in zip(words, out) if x is None}))
            out = [new[w] if x is None else x for w, x in zip(words, out)]
        return b"".join(out)


def word_ids(path: str) -> WordIds:
    """One for each worker process and path."""
    return remembered(("ids", path), lambda: WordIds(path))


class OpenWindows:
    """At most ``count`` unfinished windows; ``emit`` gets a window when it is finished."""

    def __init__(self, size: int, count: int, emit):
        self.size, self.count, self.emit, self.windows = size, count, emit, []

    def best(self, length: int) -> list | None:
        fits = [w for w in self.windows if self.size - w[0] >= length]
        return max(fits, key=lambda w: w[0]) if fits else None

    def put(self, window: list, length: int, item) -> None:
        """window: [tokens used, items with their offsets]."""
        window[1].append((window[0], item))
        window[0] += length
        if window[0] == self.size:
            self.close(window)

    def close(self, window: list) -> None:
        self.windows = [w for w in self.windows if w is not window]
        self.emit(window, False)

    def room(self) -> list:
        """A new window; the fullest is emitted if there are too many."""
        if len(self.windows) >= self.count:
            self.close(max(self.windows, key=lambda w: w[0]))
        self.windows.append(new := [0, []])
        return new

    def finish(self, still_open: bool) -> None:
        for w in self.windows:
            self.emit(w, still_open)
        self.windows = []


def pack(docs: DataFrame, tokenizer_path: str, *, window: int = 2048, open_windows: int = 64, min_cut: int = 32) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts have the end id alone. Repeated rows are packed as often as they occur; a null doc_id stays
    null. Each id of a document lies in exactly one piece. At most ``open_windows`` windows a partition are unfinished.
    """
    spark = docs.sparkSession
    bound_batches(spark)

    def fill(batches):
        words = word_ids(tokenizer_path)
        rows: list[tuple] = []
        base, number = TaskContext.get().partitionId() << 40, 0

        def emit(w, still_open):
            nonlocal number
            rows.extend((*item, base + number, offset, still_open) for offset, item in w[1])
            number += 1

        def out():
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "window_id", "offset")
            columns = list(zip(*rows)) or [()] * 8
            batch = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.bool_())], [*names, "open"])
            rows.clear()
            return batch

        space = OpenWindows(window, open_windows, emit)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = words.ids(text.as_py() or "") + END_ID.to_bytes(4, "little")
                n, at = len(ids) // 4, 0

                def piece(length):
                    nonlocal at
                    at += length
                    return doc_id, at - length, length, zlib.crc32(ids[4 * (at - length) : 4 * at]), n

                while n - at >= window:
                    emit([window, [(0, piece(window))]], False)
                while rest := n - at:
                    if not (to := space.best(rest)):
                        if len(space.windows) >= open_windows:
                            fullest = max(space.windows, key=lambda w: w[0])
                            gap = window - fullest[0]
                            if min_cut <= gap <= rest - min_cut:
                                space.put(fullest, gap, piece(gap))
                                continue
                        to = space.room()
                    space.put(to, rest, piece(rest))
            if len(rows) >= 4096:
                yield out()
        space.finish(True)
        yield out()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = saved(source.mapInArrow(fill, PIECES), "pieces")
    # Whole leftover windows are merged; their pieces only learn a new window and offset.
    left = pieces.where("open").groupBy("window_id").agg(F.sum("length").alias("used"))
    parts = max(1, -(-left.count() // MERGED))

    def merge(batches):
        items = sorted((-int(u), int(w)) for b in batches for w, u in zip(b.window_id, b.used))
        rows: list[tuple] = []
        space = OpenWindows(window, open_windows, lambda w, _: rows.extend((item, w[1][0][1], offset) for offset, item in w[1]))
        for used, w in items:
            space.put(space.best(-used) or space.room(), -used, w)
        space.finish(False)
        yield pd.DataFrame(rows, columns=["window_id", "sequence_id", "base"])

    moved = left.repartition(parts, "window_id").mapInPandas(merge, "window_id long, sequence_id long, base long")
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    done = pieces.where("not open").select(*names, F.col("window_id").alias("sequence_id"), "offset")
    rest = pieces.where("open").join(moved, "window_id").select(*names, "sequence_id", (F.col("offset") + F.col("base")).alias("offset"))
    return done.unionByName(rest)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def packing_query(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_file())
