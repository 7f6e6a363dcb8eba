"""Secret scans through a trigram inverted index, with DataFrame functions only.

From each rule's regex a Boolean query over trigrams is derived: what every match must contain. The index has, for each
trigram that some query names, the list of its documents as bits of blocks of ids. A query reads the lists of its own
trigrams and intersects and unites them block by block; rules are verified on their candidates only, and a rule without
mandatory trigrams scans every text.
"""

import functools
import itertools
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, saved


@dataclass(frozen=True)
class Rule:
    """Matches are leftmost and do not overlap; those whose group is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True


#: The rules.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # The longest runs are the same whether short runs are matched and dropped or not matched.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, False),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,255}", 0, 40, False),
)

MOST_STRINGS = 64
#: Documents of a block of posting lists: bits of a long without its sign.
BLOCK = 63


def _strings(node) -> set[str] | None:
    """All strings that a parsed item can match, in lower case, if they are few."""
    op, arg = node
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN" and all(str(x[0]) == "LITERAL" for x in arg):
        return {chr(x[1]).lower() for x in arg}
    if name == "SUBPATTERN":
        return _sequence_strings(arg[-1])
    if name == "BRANCH":
        parts = [_sequence_strings(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] <= 1:
        inner = _sequence_strings(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        part = _strings(node)
        if part is None or len(out) * len(part) > MOST_STRINGS:
            return None
        out = {a + b for a, b in itertools.product(out, part)}
    return out


def _of_strings(strings: set[str]):
    """Query for 'contains one of these': None (no restriction) or a set of alternatives, each a set of trigrams."""
    found = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return None if frozenset() in found or not found else found


def _of_sequence(nodes) -> list:
    """Conjunction: alternatives that must each hold."""
    out, run = [], {""}

    def flush():
        if q := _of_strings(run):
            out.append(q)

    for node in nodes:
        part = _strings(node)
        if part is not None and len(run) * len(part) <= MOST_STRINGS:
            run = {a + b for a, b in itertools.product(run, part)}
            continue
        flush()
        run = {""}
        op, arg = node
        if part is not None:
            run = part
        elif str(op) == "SUBPATTERN":
            out += _of_sequence(arg[-1])
        elif str(op) in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            out += _of_sequence(arg[2])
    flush()
    return out


def trigram_query(pattern: str) -> list[set[frozenset[str]]]:
    """And of ors of ands of lower-case trigrams; empty if nothing is mandatory."""
    return _of_sequence(parser.parse(pattern))


def block_of(doc_id) -> Column:
    """Documents come in blocks of BLOCK neighbouring ids; null ids have a block of their own."""
    return F.coalesce(F.expr(f"{doc_id} div {BLOCK}"), F.lit(-(2**62)))


def bit_of(doc_id) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.coalesce(F.pmod(F.col(doc_id), F.lit(BLOCK)), F.lit(0)).cast("int"))


def index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Posting lists (gram, block, docs) of the lower-cased texts, sorted by gram: the bits of docs are the block's documents.

    Lists combine before they move; only the grams that queries name are kept.
    """
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams)))
    found = docs.select("doc_id", F.lower("text").alias("low")).select(block_of("doc_id").alias("block"), bit_of("doc_id").alias("bit"), F.explode(held).alias("gram"))
    lists = found.groupBy("gram", "block").agg(F.bit_or("bit").alias("docs"))
    return saved(lists.sortWithinPartitions("gram", "block"), "postings")


def candidates(docs: DataFrame, rules=RULES) -> DataFrame:
    """(block, <kind> for each rule with mandatory trigrams): the documents whose postings satisfy the rule's query, as bits."""
    wanted = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    grams = sorted({g for q in wanted.values() for alternatives in q for a in alternatives for g in a})
    if not grams:
        return docs.select(F.lit(0).cast("long").alias("block")).limit(0)
    at = {g: f"g{i}" for i, g in enumerate(grams)}
    none = F.lit(0).cast("long")
    lists = index(docs, grams).groupBy("block").agg(*(F.coalesce(F.bit_or(F.when(F.col("gram") == g, F.col("docs"))), none).alias(c) for g, c in at.items()))

    def both(x: Column, y: Column) -> Column:
        return x.bitwiseAND(y)

    def either(x: Column, y: Column) -> Column:
        return x.bitwiseOR(y)

    masks = {
        kind: functools.reduce(both, (functools.reduce(either, (functools.reduce(both, (F.col(at[g]) for g in sorted(some))) for some in sorted(alternatives, key=sorted))) for alternatives in query))
        for kind, query in wanted.items()
    }
    out = lists.select("block", *(m.alias(k) for k, m in masks.items()))
    return out.where(functools.reduce(either, (F.col(k) for k in masks)) != 0)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """Array of (start, order, end) of a rule's matches, in code points, end exclusive.

    The texts between matches come from split, the matches from regexp_extract_all: their lengths give the places.
    """
    p = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.length)
    value = whole if rule.group == 0 else F.transform(F.regexp_extract_all(text, p, F.lit(rule.group)), F.length)
    gaps = F.slice(between, 1, F.size(whole))
    steps = F.arrays_zip(gaps.alias("gap"), whole.alias("len"), value.alias("val"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))

    def add(s, x):
        begin = s["at"] + x["gap"]
        one = F.struct(begin.alias("start"), F.lit(order).alias("kind"), (begin + x["len"]).alias("end"))
        return F.struct((begin + x["len"]).alias("at"), F.when(x["val"] >= rule.least, F.concat(s["out"], F.array(one))).otherwise(s["out"]).alias("out"))

    return F.aggregate(steps, start, add, lambda s: s["out"])


def _written(spans: Column, rules) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row per row of docs: doc_id, n_<kind> of the base rules, base_spans, spans (kind:start:end by start, then rule).

    Null text counts as empty and has no spans. Rows that repeat a doc_id share their candidates and are verified each.
    """
    text = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = saved(candidates(text, rules), "candidates")
    both = text.withColumn("block", block_of("doc_id")).join(found, "block", "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    columns = {}
    for i, r in enumerate(rules):
        candidate = F.col("text").rlike(r.pattern)
        if trigram_query(r.pattern):
            candidate = (F.coalesce(F.col(r.kind), F.lit(0)).bitwiseAND(bit_of("doc_id")) != 0) & candidate
        columns[f"s_{r.kind}"] = F.when(candidate, spans_of(F.col("text"), r, i)).otherwise(none)
    got = both.select("doc_id", *(c.alias(k) for k, c in columns.items()))
    base = F.array_sort(F.concat(*(f"s_{r.kind}" for r in rules if r.base)))
    every = F.array_sort(F.concat(*columns))
    counts = [F.size(f"s_{r.kind}").cast("long").alias(f"n_{r.kind}") for r in rules if r.base]
    return got.select("doc_id", *counts, _written(base, rules).alias("base_spans"), _written(every, rules).alias("spans"))


def secrets_query(spark, sf_dir: str) -> DataFrame:
    out = find_secrets(documents(spark, sf_dir))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.encode("base_spans", "UTF-8"), 256).alias("base_sha256"), "spans")


def _secrets_sql() -> str:
    """The rules in SQL: lengths of the texts between matches and of the matches give the places."""
    found = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        found.append(
            f"SELECT doc_id, {i} AS kind, '{r.kind}' AS name, {str(r.base).lower()} AS base, {r.least} AS least, generate_subscripts(m, 1) AS i, unnest(m) AS m, unnest(v) AS v, unnest(gaps[1:len(m)]) AS gap\n"
            f"  FROM (SELECT doc_id, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {r.group}) AS v, string_split_regex(text, '{p}') AS gaps FROM d)"
        )
    counts = ", ".join(f"count(*) FILTER (name = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    names = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),\nf AS (\n  " + "\n  UNION ALL ".join(found) + "),\n"
        "p AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop FROM f),\n"
        "s AS (SELECT *, (stop - length(m))::BIGINT AS start, name || ':' || (stop - length(m))::BIGINT || ':' || stop::BIGINT AS span FROM p WHERE length(v) >= least),\n"
        f"g AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY start, kind) FILTER (base) AS base_spans, string_agg(span, ',' ORDER BY start, kind) AS spans FROM s GROUP BY doc_id)\n"
        f"SELECT d.doc_id, {names}, sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON g.doc_id = d.doc_id"
    )


SECRETS_SQL = _secrets_sql()
