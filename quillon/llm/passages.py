"""Substring dedup by repeated-phrase automata.

Every window of ``window`` words has an anchor, the smallest of the hashes of its short runs of words. Windows around
anchors that recur are grouped over the corpus by hash: those found twice are recurring. Consecutive ones found in the
same segments are one phrase, and an example of each phrase, with its words, goes to the shard of its anchor. A shard
compiles its phrases into an Aho-Corasick automaton, through which the segments of all documents around the shard's
anchors are streamed. Each occurrence is thereby confirmed word by word, and the occurrences decide what goes. Documents
without a recurring anchor hold no recurring window.
"""

import hashlib
from itertools import compress, pairwise, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, documents, forget, saved
from .words import placed_words, run_hashes, word_hashes

#: Words of an anchor.
ANCHOR = 8
#: Windows of a shard's automaton, and segments streamed through one copy of it, at about the most.
SHARD_WINDOWS, STREAM = 20_000, 100_000
#: Bytes of the texts hashed together, and segments of an Arrow batch, at about the most.
PIECE, SEGMENTS = 1 << 19, 20_000


def digest_of(words: np.ndarray) -> bytes:
    """Stands for a word sequence."""
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def tag_of(digest: bytes) -> int:
    """Tells apart rows that repeat a doc_id."""
    return int.from_bytes(digest[:8], "big", signed=True)


def anchors_of(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the anchor of each window, anchor's place): the leftmost smallest of the window's runs of ANCHOR words."""
    k = min(ANCHOR, window)
    h = run_hashes(words, k)
    span = window - k + 1
    if len(h) < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at, done = np.arange(len(h)), 1
    while done < span:  # least of 1, 2, 4, ... runs and its place; the left one of equals
        step = min(done, span - done)
        right = h[step:] < h[:-step]
        h, at = np.where(right, h[step:], h[:-step]), np.where(right, at[step:], at[:-step])
        done += step
    return h, at


def run_ends(starts: np.ndarray, *by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs of starts, which end where starts aren't consecutive or one of by changes."""
    ends = np.diff(starts) != 1
    for x in by:
        ends |= np.diff(x) != 0
    cut = np.flatnonzero(ends)
    some = min(1, len(starts))
    return np.concatenate([np.zeros(some, np.int64), cut + 1]), np.concatenate([cut, np.full(some, len(starts) - 1)])


def pieces(batches):
    """(rows, their texts as bytes) of Arrow batches, of about PIECE bytes."""
    for b in batches:
        texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
        by = np.cumsum([len(t) for t in texts]) // PIECE
        if texts:
            for i, j in pairwise([0, *(np.flatnonzero(np.diff(by)) + 1).tolist(), len(texts)]):
                yield b.slice(i, j - i), texts[i:j]


class Words(NamedTuple):
    """Words of texts, one text after another."""

    data: bytes
    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    bounds: np.ndarray  # first word of each text, and the end

    def cut(self, first: np.ndarray, last: np.ndarray) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.begin[first].tolist(), self.end[last].tolist())]

    def digests(self) -> list[bytes]:
        return [digest_of(self.hashes[a:b]) for a, b in pairwise(self.bounds.tolist())]


def words_of(texts: list[bytes]) -> Words:
    data = b"\n".join(texts)
    hashes, begin, end = placed_words(data)
    return Words(data, hashes, begin, end, np.searchsorted(begin, np.cumsum([0, *(len(t) + 1 for t in texts)])))


def runs_of(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, last window, anchor's hash) of the runs of windows that share the place of their anchor."""
    h, at = anchors_of(words.hashes, window)
    of = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    inside = np.flatnonzero(of[: len(at)] == of[window - 1 :])
    head, tail = (inside[x] for x in run_ends(inside, at[inside]))
    return of[head], head, tail, h[head].view(np.int64)


def listed(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def occurrences(patterns: list[tuple[str | bytes, list[int], int]], segments: list[tuple[int, int, str | bytes]], window: int | None):
    """Yield (segment number, [(last word, (pattern number, id of its first document))]) of segments where patterns occur.

    patterns: (text, offsets of its windows, first id), where a window of None is the whole text; segments: (id, place
    of its first word, text).
    """
    import ahocorasick

    # One character a word: those of the patterns have their own, all others share one that matches nothing.
    split = [_split(text) for text, _, _ in patterns]
    codes = {w: chr(_code(i)) for i, w in enumerate(dict.fromkeys(w for words in split for w in words), 1)}
    automaton, n = ahocorasick.Automaton(), 0
    for words, (_, offsets, first) in zip(split, patterns):
        coded = "".join([codes[w] for w in words])
        for o in offsets:
            automaton.add_word(coded[o : o + window] if window else coded, (n, first))
            n += 1
    if not n:
        return
    automaton.make_automaton()
    other, last, hits = chr(_code(0)), None, []
    for i, (_, _, text) in enumerate(segments):
        if text != last:  # equal ones that follow one another hold the same
            hits, last = list(automaton.iter("".join([codes.get(w, other) for w in _split(text)]))), text
        if hits:
            yield i, hits


def _split(text: str | bytes) -> list[bytes]:
    return (text if isinstance(text, bytes) else text.encode()).split()


def _code(i: int) -> int:
    """Code points in order, without the surrogates."""
    return i + 1 if i < 0xD7FF else i + 0x801


def repeated_passages(docs: DataFrame, *, window: int = 20) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if a window over it has a word sequence that also starts earlier: in a smaller doc_id, or before in
    the same document. Null, empty and short texts lose nothing. Null ids sort last and are one document, as are rows
    that repeat a doc_id: each such row loses what starts earlier in any of them, and equal rows nothing by each other.
    Columns but doc_id and text are not read.
    """
    spark = docs.sparkSession
    bound_batches(spark, mb=4)
    source = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("id"))

    def survey(batches):
        for rows, texts in pieces(batches):
            words = words_of(texts)
            of, _, _, anchors = runs_of(words, window)
            counts = np.diff(words.bounds)
            long = np.flatnonzero(counts >= window)
            digests = pa.array(words.digests(), pa.binary()).take(pa.array(long))
            runs = listed(anchors, np.bincount(of, minlength=len(counts))[long])
            yield pa.RecordBatch.from_arrays([rows.column("id").take(pa.array(long)), digests, runs], ["id", "digest", "anchors"])

    seen = saved(source.select("id", "text").mapInArrow(survey, "id long, digest binary, anchors array<long>"), "survey")
    # Equal word sequences: the later ones go whole, only the first is looked into.
    firsts = saved(seen.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("m")), "firsts")
    later = seen.select("id", "digest").join(firsts.where("m > 1"), "digest").where("id > first_id").select("id", "digest").distinct()
    later = saved(later, "later-copies")
    fresh = seen.join(later.select(F.col("id").alias("_i"), F.col("digest").alias("_g")), (F.col("id") == F.col("_i")) & (F.col("digest") == F.col("_g")), "left_anti")
    places = saved(fresh.select("id", F.explode("anchors").alias("anchor")), "anchors")
    # A table of its own, so that the join below may split an anchor that very many documents hold.
    again = saved(places.groupBy("anchor").count().where("count > 1").select("anchor"), "again")
    found_in = saved(places.join(again, "anchor").select(F.col("id").alias("_id"), "anchor"), "places")
    hits = saved(found_in.groupBy("_id").agg(F.collect_set("anchor").alias("hits")), "recurring-anchors")
    forget(firsts, places, again, found_in)

    def windows(batches):
        """The segments around recurring anchors, with the hashes of their windows."""
        for rows, texts in pieces(batches):
            words = words_of(texts)
            of, head, tail, anchors = runs_of(words, window)
            hashes = run_hashes(words.hashes, window).view(np.int64)
            tags = np.array([tag_of(d) for d in words.digests()], np.int64)
            ids = rows.column("id").to_numpy(zero_copy_only=False)
            wanted = np.flatnonzero(np.isin(anchors, rows.column("hits").flatten().to_numpy(zero_copy_only=False)))
            for k in range(0, len(wanted), SEGMENTS):
                some = wanted[k : k + SEGMENTS]
                own, first, last = of[some], head[some], tail[some]
                sizes = last - first + 1
                each = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                text = pa.array(words.cut(first, last + window - 1), pa.binary())
                columns = [ids[own], tags[own], (first - words.bounds[own]).astype(np.int32), anchors[some], text, listed(hashes[each], sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["id", "tag", "start", "anchor", "text", "hashes"])

    held = source.select("id", "text").join(hits, F.col("id") == F.col("_id")).select("id", "text", "hits")
    found = saved(held.mapInArrow(windows, "id long, tag long, start int, anchor long, text binary, hashes array<long>"), "windows")
    # Where a window is found: the sums of two halves of its segments' hashes.
    run = F.xxhash64("id", "tag", "start")
    each = found.select("id", "start", "anchor", run.alias("run"), F.posexplode("hashes").alias("i", "hash"))
    recurring = each.groupBy("anchor", "hash").agg(
        F.min("id").alias("first_id"),
        F.min_by(F.col("start") + F.col("i"), "id").alias("start"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("run").bitwiseAND(F.lit(2**32 - 1))).alias("low"),
        F.sum(F.shiftrightunsigned("run", 32)).alias("high"),
    )
    recurring = recurring.where("n > 1").select("first_id", F.struct("start", "anchor", "hash", F.xxhash64("n", "low", "high").alias("where")).alias("w"))
    examples = saved(recurring.groupBy("first_id").agg(F.collect_list("w").alias("all")), "recurring-windows")

    def phrases(batches):
        """The examples that lie in a text: consecutive windows of one anchor that are found in the same segments are one."""
        for rows, texts in pieces(batches):
            words = words_of(texts)
            hashes, counts = run_hashes(words.hashes, window).view(np.int64), np.diff(words.bounds)
            some = rows.column("all")
            of = np.repeat(np.arange(len(texts)), some.value_lengths().to_numpy(zero_copy_only=False))
            start, anchor, known, where = (x.to_numpy(zero_copy_only=False) for x in some.flatten().flatten())
            at = words.bounds[of] + start
            # Rows that repeat an id hold different ones.
            here = np.flatnonzero(start + window <= counts[of])
            here = here[hashes[at[here]] == known[here]]
            here = here[np.argsort(at[here], kind="stable")]
            at, of, anchor = at[here], of[here], anchor[here]
            head, tail = run_ends(at, anchor, where[here])
            text = pa.array(words.cut(at[head], at[tail] + window - 1), pa.binary())
            columns = [rows.column("first_id").to_numpy(zero_copy_only=False)[of[head]], anchor[head], (tail - head + 1).astype(np.int32), text]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["first_id", "anchor", "n", "example"])

    # As many shards as keep automata and streams small; only an anchor of very many places needs several copies of one.
    n_windows, n_segments = examples.agg(F.sum(F.size("all"))).first()[0] or 0, found.count()
    shards = max(1, -(-n_windows // SHARD_WINDOWS), -(-2 * n_segments // STREAM))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("shard")
    known = source.select("id", "text").join(examples, F.col("id") == F.col("first_id")).select("first_id", "text", "all")
    known = saved(known.mapInArrow(phrases, "first_id long, anchor long, n int, example binary"), "passages")
    parts = saved(found.groupBy(shard).agg(F.ceil(F.count(F.lit(1)) / STREAM).cast("int").alias("parts")), "shards")

    def stream(pats: pa.Table, segs: pa.Table) -> pa.Table:
        """(id, tag, start, n): n windows from there also start earlier. All segments of a document around an anchor are here."""
        segs = segs.sort_by("text")
        ids, tags, starts = (segs[x].to_numpy() for x in ("id", "tag", "start"))
        sizes, docs_, places = pats["n"].to_pylist(), ids.tolist(), starts.tolist()
        examples = list(zip(pats["example"].to_pylist(), repeat([0]), pats["first_id"].to_pylist()))
        own, at, begin, n = {}, [], [], []
        for i, hits in occurrences(examples, list(zip(docs_, places, segs["text"].to_pylist())), None):
            doc, base = docs_[i], places[i] - window + 2
            for end, (k, first) in hits:
                if first != doc:
                    at.append(i)
                    begin.append(base + end - sizes[k])
                    n.append(sizes[k])
                else:
                    own.setdefault(k, []).append((base + end - sizes[k], i))
        for k, found_at in own.items():  # in the first document all but the first start
            least = min(found_at)[0]
            for start, i in found_at:
                if start > least:
                    at.append(i)
                    begin.append(start)
                    n.append(sizes[k])
        at = np.array(at, np.int64)
        return pa.table({"id": ids[at], "tag": tags[at], "start": pa.array(begin, pa.int32()), "n": pa.array(n, pa.int32())})

    small = F.broadcast(parts) if shards <= 100_000 else parts
    streams = found.select("id", "tag", shard, "start", "text").join(small, "shard").select("shard", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"), "id", "tag", "start", "text")
    copies = small.select(F.col("shard").alias("_shard"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("copy"))
    compiled = known.select("first_id", shard, "n", "example").join(copies, F.col("shard") == F.col("_shard")).select(F.col("shard").alias("of"), "copy", "first_id", "n", "example")
    located = compiled.groupBy("of", "copy").cogroup(streams.groupBy("shard", "part")).applyInArrow(stream, "id long, tag long, start int, n int")
    located = saved(located, "occurrences")
    forget(hits, examples, found, known)
    tag = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long")  # tag_of
    whole = later.select("id", tag.alias("tag"), F.lit(-1).alias("start"), F.lit(0).alias("n"))
    marks = located.unionByName(whole).groupBy(F.col("id").alias("_id")).agg(F.collect_list(F.struct("tag", "start", "n")).alias("marks"))
    # Ids of several rows: whose marks are whose is told by their words.
    several = source.groupBy(F.col("id").alias("_s")).count().where("count > 1").select("_s")
    marks = saved(marks.join(several, F.col("_id") == F.col("_s"), "left").select("_id", "marks", F.col("_s").isNotNull().alias("several")), "marks")

    def covered(data: bytes, n: int, tags: np.ndarray, starts: np.ndarray, sizes: np.ndarray, several: bool) -> np.ndarray:
        """Which words go."""
        if several:
            own = tags == tag_of(digest_of(word_hashes(data)))
            starts, sizes = starts[own], sizes[own]
        if len(starts) and starts.min() < 0:
            return np.ones(n, bool)
        ends = starts + sizes + (window - 1)
        return (np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:-1].cumsum() > 0

    def apply(batches):
        for rows, texts in pieces(batches):
            marks, several = rows.column("marks"), rows.column("several").to_pylist()
            tags, starts, sizes = (x.to_numpy(zero_copy_only=False) for x in marks.flatten().flatten())
            ends = np.cumsum([x or 0 for x in marks.value_lengths().to_pylist()]).tolist()
            n_words, n_kept, kept_text = [], [], []
            for data, many, a, b in zip(texts, several, [0, *ends], ends):
                words = kept = data.split()
                if a < b:
                    kept = list(compress(words, (~covered(data, len(words), tags[a:b], starts[a:b], sizes[a:b], bool(many))).tolist()))
                n_words.append(len(words))
                n_kept.append(len(kept))
                kept_text.append(b" ".join(kept))
            counts = np.array(n_words, np.int64)
            columns = [rows.column("doc_id"), pa.array(counts), pa.array(counts - np.array(n_kept, np.int64)), pa.array(kept_text, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_text"])

    joined = source.join(marks, F.col("id") == F.col("_id"), "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "marks", "several")
    return joined.mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept_text string")


def passages_query(spark, sf_dir: str) -> DataFrame:
    out = repeated_passages(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))


PASSAGES_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM d, unnest(range(1, len(w) - 18)) t(i)),
f AS (SELECT s, min(struct_pack(d := doc_id, i := i)) AS f FROM win GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM win JOIN f USING (s) WHERE struct_pack(d := doc_id, i := i) > f),
x AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM d)
SELECT d.doc_id, count(x.j) AS n_words, count(gone.j) AS n_removed, sha256(coalesce(string_agg(x.x, ' ' ORDER BY x.j) FILTER (gone.j IS NULL), '')) AS kept_sha256
FROM d LEFT JOIN x ON x.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.j = x.j
GROUP BY d.doc_id
"""
