"""Column builders for text: newline normalisation, Unicode-aware strip and split, hashes, samples for embedding."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What splits words: Unicode white space and the four separators that Java doesn't count as such.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: Fixed values of the embedding sample: characters a token, shares of lines taken, shares of the budget, what stands between.
CHARS_A_TOKEN = 4
HEAD_LINES, MIDDLE_PART, TAIL_LINES = 0.3, 10, 0.1
SHARES = (0.4, 0.3, 0.2)
BETWEEN = "\n\n...\n\n"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def decoded(content) -> Column:
    """Bytes as text: invalid UTF-8 replaced, every kind of line end as a newline."""
    return F.regexp_replace(F.make_valid_utf8(_col(content).cast("string")), r"\r\n?", "\n")


def stripped(c) -> Column:
    return F.regexp_replace(F.regexp_replace(_col(c), r"(?U)^[\s\x1c-\x1f]+", ""), r"(?U)[\s\x1c-\x1f]+$", "")


def words(c) -> Column:
    return F.filter(F.split(_col(c), SPACE), lambda x: x != "")


def query_words(c) -> Column:
    return words(F.lower(_col(c)))


def content_hash(c) -> Column:
    return F.sha2(F.encode(_col(c), "UTF-8"), 256)


def line_count(c) -> Column:
    c = _col(c)
    return (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).cast("int")


def relative_path(path, root: str) -> Column:
    p, base = _col(path), root.rstrip("/") + "/"
    return F.when(p.startswith(base), F.substr(p, F.lit(len(base) + 1))).otherwise(p)


def related_sample(c) -> Column:
    """Text that stands for a file in a similarity query: the whole, or its first 4000 and last 2000 characters."""
    c = _col(c)
    return F.when(F.length(c) > 8000, F.concat(F.left(c, F.lit(4000)), F.lit("\n...\n"), F.right(c, F.lit(2000)))).otherwise(c)


def embedding_sample(max_tokens: int = 2048):
    """A UDF: the whole text if it has at most four characters a token, else parts of its head, middle and tail."""
    budget = max_tokens * CHARS_A_TOKEN
    takes = (lambda x: x[: max(1, int(len(x) * HEAD_LINES))], lambda x: x[max(0, len(x) // 2 - len(x) // MIDDLE_PART) : len(x) // 2 + len(x) // MIDDLE_PART], lambda x: x[-max(1, int(len(x) * TAIL_LINES)) :])

    def sample(text: str) -> str:
        lines = text.splitlines()
        return BETWEEN.join("\n".join(take(lines))[: int(budget * share)] for share, take in zip(SHARES, takes))

    @F.pandas_udf("string")
    def prepared(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or len(t) <= budget else sample(t))

    return prepared
