"""File names to languages."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The extensions and their languages.
LANGUAGE_OF = {
    "py": "python",
    "js": "javascript",
    "jsx": "javascript",
    "ts": "typescript",
    "tsx": "typescript",
    "java": "java",
    "go": "go",
    "rs": "rust",
    "c": "c",
    "h": "c",
    "cpp": "cpp",
    "hpp": "cpp",
    "cc": "cpp",
    "cxx": "cpp",
    "rb": "ruby",
    "php": "php",
    "cs": "csharp",
    "swift": "swift",
    "html": "html",
    "css": "css",
    "txt": "text",
    "rst": "text",
    "log": "text",
    "md": "markdown",
    "json": "json",
    "yaml": "yaml",
    "yml": "yaml",
    "xml": "xml",
    "csv": "csv",
    "toml": "toml",
    "ini": "config",
    "conf": "config",
    "cfg": "config",
    "properties": "config",
    "env": "config",
}


def extension(path: Column) -> Column:
    """Lower-case extension without its dot. A name that only starts with a dot, or ends with one, has none."""
    name = F.substring_index(path, "/", -1)
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]+)$", 1))


def language(path: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in LANGUAGE_OF.items() for x in pair))
    return F.coalesce(F.element_at(known, extension(path)), F.lit("unknown"))


def indexable(path: Column, excluded) -> Column:
    """Known extension, and none of the excluded patterns anywhere in the path."""
    keep = extension(path).isin(*LANGUAGE_OF)
    for pattern in excluded:
        keep = keep & ~F.contains(path, F.lit(pattern))
    return keep
