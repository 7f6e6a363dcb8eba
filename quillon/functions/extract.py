"""Structure of source text by per-language regular expressions, as Column expressions.

A language is a table of passes. Each pass finds all matches of a pattern and takes a group; passes of a field are
concatenated in order. Only the C function pattern runs in Python: the JVM's matcher recurses on its nested repeats.
"""

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import LINE_BREAK, stripped

FIELDS = ("imports", "exports", "functions", "classes", "comments")
COMMENT_CHARS, MOST_COMMENTS = 200, 50


@dataclass(frozen=True)
class Pass:
    pattern: str
    flags: str = ""  # m: lines, s: dot matches newlines
    drop: tuple[str, ...] = ()

    def found(self, text: Column) -> Column:
        out = F.regexp_extract_all(text, F.lit(f"(?dU{self.flags}){self.pattern}"), F.lit(1))
        return F.filter(out, lambda x: ~x.isin(*self.drop)) if self.drop else out


#: The patterns of each language, in the order in which their matches count.
CONTROL = ("if", "for", "while", "switch", "catch")
SLASH_COMMENTS = (Pass(r"//\s*(.+)$", "m"), Pass(r"/\*\s*(.*?)\s*\*/", "s"))
HASH_COMMENTS = (Pass(r"^\s*#\s*(.+)$", "m"),)
C_FUNCTION = r"^(?:[\w*&:]+\s+)+(\w+)\s*\([^)]*\)\s*\{"
RUST_DOC = Pass(r"^\s*///\s*(.+)$", "m")
GO_BLOCK = Pass(r"import\s*\((.*?)\)", "s")
PYTHON_ALL = r"(?dUm)^__all__\s*=\s*\[([^\]]*)\]"
RUST_IMPL = Pass(r"^\s*impl\s+(\w+)", "m")
SCRIPT = {
    "imports": (Pass(r"import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]"), Pass(r"require\(\s*['\"]([^'\"]+)['\"]\s*\)")),
    "functions": (
        Pass(r"function\s+(\w+)\s*\("),
        Pass(r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\(?(?=(?s:.{0,98}?)=>)"),
        Pass(r"^\s+(\w+)\s*\([^)]*\)\s*\{", "m", (*CONTROL, "constructor")),
    ),
    "classes": (Pass(r"class\s+(\w+)"),),
    "exports": (Pass(r"export\s+(?:default\s+)?(?:class|function|const|let|var)\s+(\w+)"), Pass(r"module\.exports\s*=\s*(\w+)")),
    "comments": SLASH_COMMENTS,
}
C_LIKE = {
    "imports": (Pass(r"^\s*#include\s*[<\"]([^>\"]+)[>\"]", "m"),),
    "classes": (Pass(r"^\s*(?:class|struct)\s+(\w+)", "m"),),
    "comments": SLASH_COMMENTS,
}
LANGUAGES: dict[str, dict[str, tuple[Pass, ...]]] = {
    "python": {
        "imports": (Pass(r"^\s*import\s+([\w.]+)", "m"), Pass(r"^\s*from\s+([\w.]+)\s+import", "m")),
        "functions": (Pass(r"^\s*def\s+(\w+)\s*\(", "m"),),
        "classes": (Pass(r"^\s*class\s+(\w+)", "m"),),
        "comments": (Pass(r'"""(.*?)"""', "s"), Pass(r"'''(.*?)'''", "s")),
    },
    "javascript": SCRIPT,
    "typescript": SCRIPT,
    "java": {
        "imports": (Pass(r"^\s*import\s+([\w.]+);", "m"),),
        "functions": (Pass(r"(?:public|private|protected)\s+(?:static\s+)?(?:final\s+)?(?:[\w<>\[\]]+)\s+(\w+)\s*\(", "", CONTROL),),
        "classes": (Pass(r"(?:public\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+(\w+)"),),
        "comments": SLASH_COMMENTS,
    },
    "go": {
        "imports": (Pass(r"^\s*import\s+\"([^\"]+)\"", "m"),),
        "functions": (Pass(r"^func\s+(?:\([^)]*\)\s+)?(\w+)\s*\(", "m"),),
        "classes": (Pass(r"^type\s+(\w+)\s+struct\b", "m"), Pass(r"^type\s+(\w+)\s+interface\b", "m")),
        "comments": SLASH_COMMENTS,
    },
    "rust": {
        "imports": (Pass(r"^\s*use\s+([\w:]+)", "m"),),
        "functions": (Pass(r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*[<(]", "m"),),
        "classes": (Pass(r"^\s*(?:pub\s+)?struct\s+(\w+)", "m"), Pass(r"^\s*(?:pub\s+)?enum\s+(\w+)", "m"), Pass(r"^\s*(?:pub\s+)?trait\s+(\w+)", "m")),
        "exports": (Pass(r"^\s*pub\s+(?:fn|struct|enum|trait|mod|const|static|type)\s+(\w+)", "m"),),
        "comments": SLASH_COMMENTS,
    },
    "c": C_LIKE,
    "cpp": C_LIKE,
    "ruby": {
        "imports": (Pass(r"^\s*require(?:_relative)?\s+['\"]([^'\"]+)['\"]", "m"),),
        "functions": (Pass(r"^\s*def\s+(\w+)", "m"),),
        "classes": (Pass(r"^\s*class\s+(\w+)", "m"), Pass(r"^\s*module\s+(\w+)", "m")),
    },
    "php": {
        "imports": (Pass(r"^\s*use\s+([\w\\]+)", "m"), Pass(r"^\s*(?:require|include)(?:_once)?\s+['\"]([^'\"]+)['\"]", "m")),
        "functions": (Pass(r"function\s+(\w+)\s*\("),),
        "classes": (Pass(r"(?:class|interface|trait)\s+(\w+)"),),
        "comments": SLASH_COMMENTS,
    },
    "csharp": {
        "imports": (Pass(r"^\s*using\s+([\w.]+)\s*;", "m"),),
        "functions": (Pass(r"(?:public|private|protected|internal)\s+(?:static\s+)?(?:async\s+)?(?:[\w<>\[\]]+)\s+(\w+)\s*\(", "", CONTROL),),
        "classes": (Pass(r"(?:public\s+)?(?:abstract\s+)?(?:static\s+)?(?:class|interface|struct|enum)\s+(\w+)"),),
        "comments": SLASH_COMMENTS,
    },
}


def _none() -> Column:
    return F.array().cast("array<string>")


def _all(passes, text: Column) -> Column:
    found = [p.found(text) for p in passes]
    return F.concat(*found) if len(found) > 1 else found[0] if found else _none()


def _cut(comments: Column) -> Column:
    return F.transform(comments, lambda x: F.left(stripped(x), F.lit(COMMENT_CHARS)))


def _said(comments: Column) -> Column:
    return F.filter(_cut(comments), lambda x: x != "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def c_functions(texts: pd.Series) -> pd.Series:
    found = re.compile(C_FUNCTION, re.MULTILINE)
    names = {*CONTROL, "return"}
    return texts.map(lambda t: None if t is None else [x for x in found.findall(t) if x not in names])


def fields_of(language: str, text: Column) -> dict[str, Column]:
    """The five lists of a language; empty ones for a language without rules."""
    rules = LANGUAGES.get(language, {})
    out = {f: _all(rules.get(f, ()), text) for f in FIELDS}
    out["comments"] = _said(out["comments"])
    if language == "python":
        marks = F.filter(_said(HASH_COMMENTS[0].found(text)), lambda x: ~x.startswith("!"))
        out["comments"] = F.concat(out["comments"], marks)
        listed = F.split(F.regexp_extract(text, PYTHON_ALL, 1), ",")
        out["exports"] = F.transform(F.filter(listed, lambda x: stripped(x) != ""), lambda x: F.btrim(stripped(x), F.lit("'\"")))
    elif language == "go":
        lines = F.flatten(F.transform(GO_BLOCK.found(text), lambda b: F.split(b, LINE_BREAK)))
        packages = F.filter(F.transform(lines, lambda x: F.btrim(stripped(x), F.lit('"'))), lambda x: x != "")
        out["imports"] = F.concat(out["imports"], packages)
        out["exports"] = F.filter(F.concat(out["functions"], out["classes"]), lambda x: x.rlike(r"^\p{Lu}"))
    elif language == "rust":
        out["classes"] = F.concat(out["classes"], F.array_except(RUST_IMPL.found(text), out["classes"]))
        out["comments"] = F.concat(_cut(RUST_DOC.found(text)), out["comments"])
    elif language in ("c", "cpp"):
        out["functions"] = F.coalesce(c_functions(text), _none())
    elif language == "ruby":
        out["comments"] = _cut(HASH_COMMENTS[0].found(text))
    return out


def extracted(files: DataFrame, languages=None) -> DataFrame:
    """files (language, text, ...) with the five lists added; comments are cut to the first fifty.

    One projection: each list is a choice by language, so a row runs its own language's patterns only and files are
    read once. Languages without rules, and null ones, get empty lists.
    """
    wanted = [x for x in (languages or LANGUAGES) if x in LANGUAGES]
    families: list[list[str]] = []
    for x in wanted:
        same = next((g for g in families if LANGUAGES[g[0]] is LANGUAGES[x]), None)
        families.append([x]) if same is None else same.append(x)
    chosen: dict[str, Column] = {}
    for group in families:
        own = F.col("language").isin(*group)
        # The UDF of the C family runs on every row: others send it no text.
        found = fields_of(group[0], F.when(own, F.col("text")) if group[0] in ("c", "cpp") else F.col("text"))
        found["comments"] = F.slice(found["comments"], 1, MOST_COMMENTS)
        for field, value in found.items():
            chosen[field] = chosen[field].when(own, value) if field in chosen else F.when(own, value)
    return files.withColumns({f: chosen[f].otherwise(_none()) if f in chosen else _none() for f in FIELDS})
