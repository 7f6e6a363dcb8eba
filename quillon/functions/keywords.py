"""Search terms of a file: parts of its path, of its symbols' names and of what it imports."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import words

#: What separates path parts, and the pieces of a camel-case name.
PATH_BREAK = r"[/\\_.\-]+"
CAMEL = r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|(?U:\b))"


def path_parts(path: Column) -> Column:
    return F.filter(F.transform(F.split(path, PATH_BREAK), F.lower), lambda x: F.length(x) > 1)


def camel_parts(name: Column) -> Column:
    """Lower-case pieces of more than one letter; underscores separate too."""
    pieces = F.flatten(F.transform(F.split(name, "_+"), lambda t: F.regexp_extract_all(t, F.lit(CAMEL), F.lit(0))))
    return F.transform(F.filter(pieces, lambda x: F.length(x) > 1), F.lower)


def last_part(imported: Column) -> Column:
    return F.substring_index(F.substring_index(F.substring_index(imported, ".", -1), "/", -1), "::", -1)


def keywords(path: Column, functions: Column, classes: Column, imports: Column) -> Column:
    names = F.concat(functions, classes)
    pieces = F.flatten(F.transform(names, camel_parts))
    imported = F.filter(F.transform(imports, last_part), lambda x: F.length(x) > 1)
    return F.array_sort(F.array_distinct(F.concat(path_parts(path), pieces, F.transform(names, F.lower), F.transform(imported, F.lower))))


def search_terms(e) -> Column:
    """The terms that keyword scoring counts for a file row; symbols' names count on top of the keywords."""
    low = lambda c: F.transform(c, F.lower)
    last = F.transform(e["imports"], lambda x: F.lower(F.substring_index(x, ".", -1)))
    said = F.flatten(F.transform(e["comments"], lambda c: words(F.lower(c))))
    return F.concat(e["keywords"], low(e["functions"]), low(e["classes"]), last, said)
