"""The catalogue's queries in SQL (DuckDB), put together from common table expressions."""

from ..functions.extract import C_FUNCTION, CONTROL, GO_BLOCK, HASH_COMMENTS, LANGUAGES, RUST_DOC, RUST_IMPL, Pass
from .catalog import EXTS, FOLDERS, QUERIES, TERMS

SPACE = r"\s+"
DOC_PATH = "source || '/' || lang || '/' || doc_id || '.txt'"
ASKED = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUERIES) + ") t(query_id, query))"

FILES = """files AS (
  SELECT 'src/' || brand || '/' || name || '/mod_' || k || CASE WHEN script THEN '.js' ELSE '.py' END AS relative_path, script,
    CASE WHEN script THEN
      'import x from ''../m/mod_' || other || ''';' || chr(10) || '// size ' || p_size || ' stock' || chr(10) || 'function load' || p_size || '(a) {' || chr(10) || '}' || chr(10)
      || 'export class ' || cls || ' {}' || chr(10) || 'const run_' || name || ' = (a) => a;' || chr(10)
    ELSE
      '""' || '"Module for ' || p_name || ' parts.""' || '"' || chr(10) || 'import os' || chr(10) || 'import mod_' || other || chr(10) || 'from lib.' || name || ' import helper' || chr(10)
      || '# ' || brand || ' stock' || chr(10) || 'class ' || cls || ':' || chr(10) || '    def get_' || name || '(self):' || chr(10) || '        pass' || chr(10)
      || 'def load_' || k || '(x):' || chr(10) || '    return x' || chr(10)
    END AS text
  FROM (SELECT p_partkey AS k, p_name, p_size, replace(p_name, ' ', '_') AS name, lower(replace(p_brand, '#', '')) AS brand,
          (p_partkey * 7 + 1) % 500 AS other, p_partkey % 3 = 2 AS script, 'Part' || replace(p_brand, '#', '') || 'Size' || p_size AS cls FROM part))"""

EXTRACTED = r"""ext AS (
  SELECT relative_path, script, text, length(text) AS size,
    CASE WHEN script THEN regexp_extract_all(text, 'from ''([^'']+)''', 1)
         ELSE list_concat(regexp_extract_all(text, '(?m)^import ([\w.]+)', 1), regexp_extract_all(text, '(?m)^from ([\w.]+) import', 1)) END AS imports,
    CASE WHEN script THEN list_concat(regexp_extract_all(text, 'function (\w+)\(', 1), regexp_extract_all(text, 'const (\w+) = \(\w+\) =>', 1))
         ELSE regexp_extract_all(text, '(?m)^\s*def (\w+)\(', 1) END AS functions,
    regexp_extract_all(text, 'class (\w+)', 1) AS classes,
    CASE WHEN script THEN regexp_extract_all(text, 'export class (\w+)', 1) ELSE [] END AS exports,
    CASE WHEN script THEN regexp_extract_all(text, '(?m)// (.+)$', 1)
         ELSE list_concat(regexp_extract_all(text, '"{3}(.*?)"{3}', 1), regexp_extract_all(text, '(?m)^# (.+)$', 1)) END AS comments
  FROM files)"""

KEYWORDS = r"""kw AS (
  SELECT *, list_sort(list_distinct(list_concat(
      list_filter(regexp_split_to_array(lower(relative_path), '[/\\_.-]+'), lambda x: length(x) > 1),
      list_filter(list_transform(flatten(list_transform(list_concat(functions, classes), lambda n: regexp_extract_all(n, '[A-Z]?[a-z]+'))), lambda x: lower(x)), lambda x: length(x) > 1),
      list_transform(list_concat(functions, classes), lambda x: lower(x)),
      list_filter(list_transform(imports, lambda i: lower(string_split(string_split(i, '.')[-1], '/')[-1])), lambda x: length(x) > 1)))) AS keywords
  FROM ext)"""

TERMS_OF_FILES = r"""corpus AS (
  SELECT relative_path AS id, list_concat(keywords, list_transform(functions, lambda x: lower(x)), list_transform(classes, lambda x: lower(x)),
    list_transform(imports, lambda i: lower(string_split(i, '.')[-1])),
    flatten(list_transform(comments, lambda c: list_filter(regexp_split_to_array(lower(c), '\s+'), lambda x: x <> '')))) AS terms
  FROM kw)"""

TERMS_OF_DOCS = r"""corpus AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS terms FROM documents)"""

STATS = """lens AS (SELECT id, len(terms) AS dl FROM corpus),
posted AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM corpus) GROUP BY id, term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM posted GROUP BY term), (SELECT count(*) AS n FROM corpus)),
stats AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw, (SELECT avg(raw) AS mean FROM raw))"""

SCORED = """scored AS (
  SELECT query_id, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS bm25
  FROM (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(terms) AS term FROM q) GROUP BY query_id, term)
  JOIN stats USING (term) JOIN posted USING (term) JOIN lens USING (id), (SELECT avg(dl) AS avgdl FROM lens)
  GROUP BY query_id, id HAVING sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) > 0)"""

LITERAL_Q = "q AS (SELECT 0 AS query_id, ['" + "', '".join(TERMS) + "'] AS terms)"

NEAR = """near AS (
  SELECT query_id, path, raw, greatest(0, least(1, raw)) AS score, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, path) AS rank
  FROM (SELECT a.vec_id AS query_id, b.vec_id AS path, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS raw FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0))"""

LEXICAL = r"""lex AS (
  SELECT query_id, query, kw.*, regexp_split_to_array(lower(query), '\s+') AS toks FROM kw, asked),
scores AS (
  SELECT *, coalesce(list_max(list_transform(list_concat(functions, classes), lambda n: CASE WHEN lower(n) = lower(query) THEN 1.0 WHEN contains(lower(n), lower(query)) THEN 0.7
      WHEN contains(lower(query), lower(n)) THEN 0.5 WHEN len(list_filter(toks, lambda t: contains(lower(n), t))) > 0 THEN 0.3 ELSE 0.0 END)), 0.0)::DOUBLE AS name,
    CASE WHEN contains(lower(relative_path), lower(query)) THEN 1.0::DOUBLE ELSE len(list_filter(toks, lambda t: contains(lower(relative_path), t)))::DOUBLE / len(toks) * 0.6::DOUBLE END AS path,
    flatten(list_transform(toks, lambda t: list_concat(list_filter(list_concat(functions, classes), lambda n: contains(lower(n), t)), CASE WHEN contains(lower(relative_path), t) THEN [relative_path] ELSE [] END))) AS found
  FROM lex)"""
#: Each term once, in order of first appearance, the first ten.
FOUND = "array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i)[1:10], '|')"

LOOKUP = r"""keys AS (
  SELECT relative_path, regexp_replace(relative_path, '\.(py|js)$', '') AS bare FROM files),
names AS (
  SELECT relative_path, 0 AS short, replace(bare, '/', '.') AS key FROM keys
  UNION ALL SELECT relative_path, 1, string_split(replace(bare, '/', '.'), '.')[-1] FROM keys
  UNION ALL SELECT relative_path, 1, string_split(bare, '/')[-1] FROM keys),
lookup AS (SELECT key, coalesce(max(relative_path) FILTER (short = 0), min(relative_path) FILTER (short = 1)) AS target FROM names GROUP BY key)"""

EDGES = """wanted AS (SELECT relative_path AS src, replace(replace(unnest(imports), '/', '.'), '::', '.') AS i FROM ext),
edges AS (
  SELECT DISTINCT src, coalesce(a.target, b.target) AS dst FROM wanted LEFT JOIN lookup a ON a.key = i LEFT JOIN lookup b ON b.key = string_split(i, '.')[-1]
  WHERE coalesce(a.target, b.target) IS NOT NULL AND coalesce(a.target, b.target) <> src)"""

SNAPSHOTS = f"""old AS (SELECT {DOC_PATH} AS relative_path, sha256(CASE WHEN doc_id % 11 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0),
now AS (SELECT {DOC_PATH} AS relative_path, sha256(text) AS h FROM documents WHERE doc_id % 13 <> 0),
changes AS (
  SELECT relative_path, CASE WHEN now.h IS NULL THEN 'removed' WHEN old.h IS NULL THEN 'new' WHEN old.h = now.h THEN 'unchanged' ELSE 'changed' END AS status
  FROM old FULL JOIN now USING (relative_path))"""

SAMPLE = "CASE WHEN length(text) > 8000 THEN left(text, 4000) || chr(10) || '...' || chr(10) || right(text, 2000) ELSE text END"
RRF = """f AS (SELECT id AS path, bm25, row_number() OVER (ORDER BY bm25 DESC, id) AS r FROM scored),
one AS (SELECT path, min(fr) AS fr, min(sr) AS sr FROM (SELECT path, r AS fr, NULL AS sr FROM f WHERE r <= 10 UNION ALL SELECT path, NULL, rank FROM near WHERE query_id = 0 AND rank <= 10) GROUP BY path),
fused AS (SELECT path, score, row_number() OVER (ORDER BY score DESC, fr NULLS LAST, sr NULLS LAST) AS rank
  FROM (SELECT *, coalesce(0.5::DOUBLE / (60 + fr), 0::DOUBLE) + coalesce(0.5::DOUBLE / (60 + sr), 0::DOUBLE) AS score FROM one))"""


def q(*parts: str) -> str:
    """A query of common table expressions; the last part may bring more of them before its SELECT."""
    return "WITH " + ",\n".join(parts[:-1]) + ("\n" if parts[-1].startswith("SELECT") else ",\n") + parts[-1]


def joined(*columns: str) -> str:
    return ", ".join(f"array_to_string({c}, '|') AS {c}" for c in columns)


def nth(values, index: str) -> str:
    return "['" + "', '".join(values) + f"'][({index}) + 1]"


#: How the embedding sample of 512 tokens (2,048 characters) is cut.
LINES = "CASE WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END"
EMBEDDED = f"""s AS (SELECT doc_id, text, l, len(l) AS n FROM (SELECT doc_id, text, {LINES} AS l FROM documents)),
e AS (SELECT doc_id, CASE WHEN length(text) <= 2048 THEN text ELSE
    left(array_to_string(l[1:greatest(1, floor(n * 0.3::DOUBLE)::INT)], chr(10)), 819) || sep || left(coalesce(array_to_string(l[greatest(0, n // 2 - n // 10) + 1:n // 2 + n // 10], chr(10)), ''), 614) || sep
    || left(array_to_string(l[n - greatest(1, floor(n * 0.1::DOUBLE)::INT) + 1:n], chr(10)), 409) END AS s
  FROM s, (SELECT chr(10) || chr(10) || '...' || chr(10) || chr(10) AS sep))"""


def _found(p: Pass, more: tuple[str, ...] = ()) -> str:
    """All first groups of a pattern in text, by the engine's own regular expressions, which have no look-ahead."""
    pattern = p.pattern.replace("(?=(?s:.{0,98}?)=>)", "(?s:.{0,98}?)=>").replace("'", "''")
    out = f"regexp_extract_all(text, '{'(?' + p.flags + ')' if p.flags else ''}{pattern}', 1)"
    drop = (*p.drop, *more)
    return f"list_filter({out}, lambda x: x NOT IN ({', '.join(f"'{d}'" for d in drop)}))" if drop else out


def _rules(language: str) -> dict[str, str]:
    """SQL of the five lists of a language."""
    rules = LANGUAGES.get(language, {})
    both = lambda *x: f"list_concat({', '.join(x)})" if len(x) > 1 else x[0] if x else "[]::VARCHAR[]"
    out = {f: both(*(_found(p) for p in rules.get(f, ()))) for f in ("imports", "exports", "functions", "classes", "comments")}
    cut = lambda x: f"list_transform({x}, lambda x: left(trim(x, E' \\t\\n\\r\\f\\v'), 200))"
    said = lambda x: f"list_filter({cut(x)}, lambda x: x <> '')"
    out["comments"] = said(out["comments"])
    if language == "python":
        out["comments"] = both(out["comments"], f"list_filter({said(_found(HASH_COMMENTS[0]))}, lambda x: x[1] <> '!')")
    elif language == "go":
        lines = f"flatten(list_transform({_found(GO_BLOCK)}, lambda b: string_split(b, chr(10))))"
        out["imports"] = both(out["imports"], f"""list_filter(list_transform({lines}, lambda x: trim(trim(x, E' \\t\\r'), '"')), lambda x: x <> '')""")
        out["exports"] = f"list_filter({both(out['functions'], out['classes'])}, lambda x: regexp_matches(x, '^[A-Z]'))"
    elif language == "rust":
        out["classes"] = both(out["classes"], f"list_filter({_found(RUST_IMPL)}, lambda x: NOT list_contains({out['classes']}, x))")
        out["comments"] = both(cut(_found(RUST_DOC)), out["comments"])
    elif language in ("c", "cpp"):
        out["functions"] = _found(Pass(C_FUNCTION, "m"), (*CONTROL, "return"))
    elif language == "ruby":
        out["comments"] = cut(_found(HASH_COMMENTS[0]))
    return out | {"comments": f"({out['comments']})[1:50]"}


EVERY_LANGUAGE = " UNION ALL ".join(
    f"SELECT relative_path, '{x}' AS language, " + ", ".join(f"coalesce(array_to_string({v}, '|'), '') AS {k}" for k, v in _rules(x).items()) + " FROM files" for x in (*LANGUAGES, "swift")
)

MADE = (FILES, EXTRACTED)
SYMBOLS = (*MADE, KEYWORDS)
#: Every file that a query matches, ranked.
RANKED = (*SYMBOLS, TERMS_OF_FILES, STATS, ASKED, r"q AS (SELECT query_id, regexp_split_to_array(lower(query), '\s+') AS terms FROM asked)", SCORED, LEXICAL,
    f"""all_of AS (SELECT s.*, coalesce(b.bm25 / max(b.bm25) OVER (PARTITION BY s.query_id), 0) AS keyword FROM scores s LEFT JOIN scored b ON b.query_id = s.query_id AND b.id = s.relative_path),
rows_ AS (SELECT *, (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS line_count FROM kw),
ranked AS (
  SELECT query_id, relative_path AS path, round(score, 4) AS score4, CASE WHEN (keyword > 0)::INT + (name > 0)::INT + (path > 0)::INT > 1 THEN 'composite' WHEN keyword > 0 THEN 'keyword' WHEN name > 0 THEN 'name' ELSE 'path' END AS match_type,
    {FOUND} AS matched_terms, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, relative_path) AS rank, len(functions) AS n_functions, size
  FROM (SELECT *, 0.5::DOUBLE * keyword + 0.3::DOUBLE * name + 0.2::DOUBLE * path AS score FROM all_of WHERE keyword > 0 OR name > 0 OR path > 0))""")  # fmt: skip
LANG = "CASE lower(" + nth(EXTS, "doc_id % 8") + ") WHEN 'py' THEN 'python' WHEN 'tsx' THEN 'typescript' WHEN 'rs' THEN 'rust' WHEN 'h' THEN 'c' WHEN 'txt' THEN 'text' WHEN 'yml' THEN 'yaml' WHEN 'env' THEN 'config' ELSE 'unknown' END"
EXCLUDED = " AND ".join(f"NOT contains(path, '{x}')" for x in (".git", "node_modules", "__pycache__", "venv", "env", ".env", "build", "dist", ".quillon"))

ORACLE = {
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash, (length(text) - length(replace(text, chr(10), '')) + 1)::INT AS line_count FROM documents",
    "language_map": f"SELECT doc_id, {LANG} AS language FROM documents",
    "scan_filter": f"SELECT path FROM (SELECT '/r/' || {nth(FOLDERS, 'doc_id % 8')} || '/' || doc_id || {nth(('.py', '.sql', '.MD'), 'doc_id % 3')} AS path FROM documents) WHERE NOT path LIKE '%.sql' AND {EXCLUDED}",
    "path_tokens": r"SELECT page_id, array_to_string(list_filter(regexp_split_to_array(lower(url), '[/\\_.-]+'), lambda x: length(x) > 1), '|') AS parts FROM pages",
    "camel_split": r"""SELECT p_partkey, array_to_string(list_transform(list_concat(['get'], string_split(p_name, ' '), [p_type]), lambda x: lower(x)), '|') AS parts FROM part""",
    "extract_symbols": q(*MADE, f"SELECT relative_path, {joined('imports', 'functions', 'classes', 'exports')} FROM ext"),
    "extract_comments": q(*MADE, f"SELECT relative_path, {joined('comments')} FROM ext"),
    "extract_all_languages": f"WITH {FILES}\n{EVERY_LANGUAGE}",
    "embed_sampling": f"WITH {EMBEDDED} SELECT doc_id, length(s)::INT AS chars, md5(s) AS sample FROM e",
    "keyword_set": q(*SYMBOLS, f"SELECT relative_path, {joined('keywords')} FROM kw"),
    "doc_lengths": q(TERMS_OF_DOCS, "SELECT id AS doc_id, len(terms) AS dl FROM corpus"),
    "doc_freq": q(TERMS_OF_DOCS, STATS, "SELECT term, df, round(idf, 6) AS idf FROM stats"),
    "bm25_topk": q(TERMS_OF_DOCS, STATS, LITERAL_Q, SCORED, "SELECT id AS doc_id, round(bm25, 4) AS score, row_number() OVER (ORDER BY bm25 DESC, id) AS rank FROM scored QUALIFY rank <= 20"),
    "bm25_batch": q(TERMS_OF_DOCS, STATS, r"q AS (SELECT item_id AS query_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS terms FROM benchmark WHERE item_id % 100 = 0)", SCORED,
                    "SELECT query_id, id AS doc_id, round(bm25, 4) AS score FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) <= 10"),
    "name_match": q(*SYMBOLS, ASKED, LEXICAL, "SELECT query_id, relative_path, name AS score FROM scores WHERE name > 0"),
    "path_match": q(*SYMBOLS, ASKED, LEXICAL, "SELECT query_id, relative_path, round(path, 6) AS score FROM scores WHERE path > 0"),
    "matched_terms": q(*SYMBOLS, ASKED, LEXICAL, f"SELECT query_id, relative_path, {FOUND} AS terms FROM scores WHERE len(found) > 0"),
    "fast_composite": q(*RANKED, """SELECT query_id, path, score4 AS score, match_type, matched_terms, rank, n_functions, size FROM ranked WHERE rank <= 10"""),
    "search_enriched": q(*RANKED, """near AS (
  SELECT query_id, relative_path AS path, row_number() OVER (PARTITION BY query_id ORDER BY line_count DESC, length(relative_path) DESC, relative_path) AS rank FROM rows_, asked QUALIFY rank <= 10),
f AS (SELECT * FROM ranked WHERE rank <= 10),
one AS (SELECT query_id, path, min(fr) AS fr, min(sr) AS sr FROM (SELECT query_id, path, rank AS fr, NULL AS sr FROM f UNION ALL SELECT query_id, path, NULL, rank FROM near WHERE query_id IN (SELECT query_id FROM f)) GROUP BY query_id, path),
fused AS (SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fr NULLS LAST, sr NULLS LAST) AS rank
  FROM (SELECT *, coalesce(0.5::DOUBLE / (60 + fr), 0::DOUBLE) + coalesce(0.5::DOUBLE / (60 + sr), 0::DOUBLE) AS score FROM one) QUALIFY rank <= 8)
SELECT u.query_id, u.path, round(u.score, 8) AS score, 'fused' AS mode, u.rank, coalesce(f.match_type, '') AS match_type, coalesce(f.matched_terms, '') AS matched_terms,
  CASE WHEN r.script THEN 'javascript' ELSE 'python' END AS language, r.size, r.line_count, len(r.functions)::INT AS n_functions, len(r.classes)::INT AS n_classes, len(r.imports)::INT AS n_imports
FROM fused u JOIN rows_ r ON r.relative_path = u.path LEFT JOIN f ON f.query_id = u.query_id AND f.path = u.path"""),
    "vector_topk": q(NEAR, "SELECT path AS vec_id, round(score, 6) AS score, rank FROM near WHERE query_id = 0 AND rank <= 10"),
    "vector_batch": q(NEAR, "SELECT query_id, path AS vec_id, round(score, 6) AS score, rank FROM near WHERE rank <= 5"),
    "semantic_threshold": q(NEAR, "SELECT query_id, path AS vec_id, round(score, 6) AS score FROM near WHERE rank <= 5 AND score >= 0.3"),
    "rrf_fuse": q(TERMS_OF_DOCS, STATS, LITERAL_Q, SCORED, NEAR, RRF, "SELECT path AS id, round(score, 8) AS score, rank FROM fused WHERE rank <= 12"),
    "query_driver_modes": q(TERMS_OF_DOCS, STATS, LITERAL_Q, SCORED, NEAR, RRF, """SELECT 0 AS query_id, path AS id, 'fused' AS mode, rank, round(score, 6) AS score FROM fused WHERE rank <= 5
UNION ALL SELECT 1, path, 'semantic', rank, round(score, 6) FROM near WHERE query_id = 0 AND rank <= 5 AND score >= 0.3
UNION ALL SELECT 2, path, 'fast', r, round(bm25, 6) FROM f WHERE r <= 5"""),
    "module_lookup": q(FILES, LOOKUP, "SELECT key, target FROM lookup"),
    "dep_edges": q(*MADE, LOOKUP, EDGES, "SELECT src, dst FROM edges"),
    "dependents": q(*MADE, LOOKUP, EDGES, """a AS (SELECT src AS path, string_agg(dst, '|' ORDER BY dst) AS imports FROM edges GROUP BY src),
b AS (SELECT dst AS path, string_agg(src, '|' ORDER BY src) AS dependents FROM edges GROUP BY dst)
SELECT path, coalesce(imports, '') AS imports, coalesce(dependents, '') AS dependents FROM a FULL JOIN b USING (path)"""),
    "find_related": q(*MADE, LOOKUP, EDGES, NEAR, """t AS (SELECT min(relative_path) AS t FROM files),
r AS (SELECT dst AS file_path, 'imports' AS relationship, 1.0::DOUBLE AS score, 0 AS kind FROM edges, t WHERE src = t
  UNION ALL SELECT src, 'imported_by', 1.0, 1 FROM edges, t WHERE dst = t
  UNION ALL SELECT 'vec/' || path, 'semantically_similar', round(score, 4), 2 FROM near WHERE query_id = 0 AND rank <= 8),
o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY kind) = 1)
SELECT file_path, relationship, score FROM o ORDER BY score DESC, kind, file_path LIMIT 10"""),
    "incremental_diff": q(SNAPSHOTS, "SELECT relative_path, status FROM changes"),
    "incremental_counts": q(SNAPSHOTS, "SELECT " + ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in ("unchanged", "changed", "new", "removed")) + " FROM changes"),
    "incremental_apply": q(SNAPSHOTS, "SELECT relative_path, now.h AS content_hash, CASE WHEN status = 'unchanged' THEN 'old' ELSE 'now' END AS indexed FROM now JOIN changes USING (relative_path)"),
    "embed_cache_split": """WITH now AS (SELECT doc_id, sha256(text) AS h FROM documents), own AS (SELECT DISTINCT h FROM now JOIN embeddings ON doc_id = vec_id WHERE doc_id % 3 <> 0)
SELECT count(*) AS total, count(own.h) AS cached, count(*) - count(own.h) AS new FROM now LEFT JOIN own USING (h)""",
    "content_sampling": f"SELECT doc_id, md5({SAMPLE}) AS sample, length({SAMPLE})::INT AS chars FROM documents",
    "index_status": q(*MADE, "SELECT CASE WHEN script THEN 'javascript' ELSE 'python' END AS language, count(*) AS file_count, sum(size)::BIGINT AS bytes, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines, sum(len(functions))::BIGINT AS functions FROM ext GROUP BY 1"),
}
