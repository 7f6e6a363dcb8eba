"""Queries over the test tables, one for each operator, with the same query in SQL where SQL has it.

The tables hold no source files: some are made of ``part`` by concatenation, alike in both dialects. ``documents``
stands in for a corpus of plain texts.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.extract import extracted
from ..functions.keywords import camel_parts, keywords, path_parts
from ..functions.languages import indexable, language
from ..functions.text import content_hash, embedding_sample, line_count, query_words, related_sample, words
from ..operators import bm25
from ..operators.fusion import answered, enriched, fused
from ..operators.graph import adjacency, dependency_edges, module_lookup, related
from ..operators.incremental import applied, counts, diff
from ..operators.lexical import fast_search, few, matched_terms, name_score, path_score, top
from ..operators.vectors import cache_split, cache_stats, vector_search
from ..sources.tables import dealt, saved

K = 20
TERMS = ("thinger", "ouon", "the")
QUERIES = ((1, "small ring"), (2, "get red"), (3, "mod_12"), (4, "partbrand2size11"), (5, "brand7/hot bolt"), (6, "load helper"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def doc_path():
    return F.concat("source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "query_id int, query string")


def files(spark: SparkSession, d: str) -> DataFrame:
    """(relative_path, language, text, size) made of part: two of three Python, the others JavaScript."""
    p = dealt(spark.read.parquet(f"{d}/part.parquet"), "p_partkey")
    k, name = F.col("p_partkey").cast("string"), F.replace("p_name", F.lit(" "), F.lit("_"))
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    other = ((F.col("p_partkey") * 7 + 1) % 500).cast("string")
    cls = F.concat(F.lit("Part"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("Size"), F.col("p_size").cast("string"))
    script = F.col("p_partkey") % 3 == 2
    python = F.concat(
        F.lit('"""Module for '), "p_name", F.lit(' parts."""\nimport os\nimport mod_'), other, F.lit("\nfrom lib."), name, F.lit(" import helper\n# "), brand, F.lit(" stock\nclass "), cls,
        F.lit(":\n    def get_"), name, F.lit("(self):\n        pass\ndef load_"), k, F.lit("(x):\n    return x\n"),
    )
    js = F.concat(F.lit("import x from '../m/mod_"), other, F.lit("';\n// size "), F.col("p_size").cast("string"), F.lit(" stock\nfunction load"), F.col("p_size").cast("string"), F.lit("(a) {\n}\nexport class "), cls, F.lit(" {}\nconst run_"), name, F.lit(" = (a) => a;\n"))
    path = F.concat(F.lit("src/"), brand, F.lit("/"), name, F.lit("/mod_"), k, F.when(script, ".js").otherwise(".py"))
    made = p.select(path.alias("relative_path"), F.when(script, js).otherwise(python).alias("text"))
    return made.withColumns({"language": language(F.col("relative_path")), "size": F.length("text").cast("long"), "line_count": line_count("text")})


def index_rows(spark: SparkSession, d: str) -> DataFrame:
    e = extracted(files(spark, d), ["python", "javascript"])
    return e.withColumn("keywords", keywords(F.col("relative_path"), F.col("functions"), F.col("classes"), F.col("imports")))


def body(spark: SparkSession, d: str) -> DataFrame:
    """(id, terms) of the documents' bodies."""
    return documents(spark, d).select(F.col("doc_id").alias("id"), words(F.lower("text")).alias("terms"))


def bm25_topk(spark, d):
    q = spark.createDataFrame([(0, list(TERMS))], "query_id int, terms array<string>")
    found = top(bm25.search(q, body(spark, d)), K, F.desc("bm25"), F.asc("id"))
    return found.select(F.col("id").alias("doc_id"), F.round("bm25", 4).alias("score"), "rank")


def benchmark_queries(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), query_words("text").alias("terms"))


def bm25_batch(spark, d):
    found = top(bm25.search(benchmark_queries(spark, d), body(spark, d)), 10, F.desc("bm25"), F.asc("id"))
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("bm25", 4).alias("score"))


def bm25_batch_whole(spark, d):
    """Every benchmark text with all its words; bm25_batch asks those whose id is divisible by 100."""
    asked = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), query_words("text").alias("terms"))
    texts = documents(spark, d).select(F.col("doc_id").alias("id"), "text")
    terms = words(F.lower("text")).alias("terms")
    posted = saved(bm25.batch_postings(texts.repartition("id").select("id", terms)), "postings")
    lengths = bm25.doc_lengths(texts.select("id", terms))
    found = top(bm25.batch_scores(asked, posted, lengths, bm25.term_stats(posted, lengths)), 10, F.desc("bm25"), F.asc("id"))
    return found.select("query_id", F.col("id").alias("doc_id"), F.round("bm25", 4).alias("score"))


def doc_freq(spark, d):
    return bm25.corpus_stats(body(spark, d)).select("term", "df", F.round("idf", 6).alias("idf"))


def doc_lengths(spark, d):
    return bm25.doc_lengths(body(spark, d)).select(F.col("id").alias("doc_id"), "dl")


def joined(*columns):
    return [F.array_join(c, "|").alias(c) for c in columns]


def extract_symbols(spark, d):
    return extracted(files(spark, d), ["python", "javascript"]).select("relative_path", *joined("imports", "functions", "classes", "exports"))


def extract_comments(spark, d):
    return extracted(files(spark, d), ["python", "javascript"]).select("relative_path", *joined("comments"))


def extract_all_languages(spark, d):
    """Every language's rules over the same made-up texts."""
    from ..functions.extract import FIELDS, LANGUAGES

    every = F.explode(F.array(*(F.lit(x) for x in (*LANGUAGES, "swift"))))
    return extracted(files(spark, d).withColumn("language", every)).select("relative_path", "language", *joined(*FIELDS))


def keyword_set(spark, d):
    return index_rows(spark, d).select("relative_path", *joined("keywords"))


def each_query(spark, d):
    return index_rows(spark, d).crossJoin(few(asked(spark)))


def name_match(spark, d):
    s = name_score(F.col("query"), F.concat("functions", "classes"))
    return each_query(spark, d).select("query_id", "relative_path", s.alias("score")).where("score > 0")


def path_match(spark, d):
    return each_query(spark, d).select("query_id", "relative_path", F.round(path_score(F.col("query"), F.col("relative_path")), 6).alias("score")).where("score > 0")


def matched(spark, d):
    t = matched_terms(F.col("query"), F.concat("functions", "classes"), F.col("relative_path"))
    return each_query(spark, d).select("query_id", "relative_path", F.array_join(t, "|").alias("terms")).where("terms <> ''")


def fast_composite(spark, d):
    out = fast_search(saved(index_rows(spark, d), "index-rows"), asked(spark), 10)
    return out.select("query_id", "path", "score", "match_type", F.array_join("matched_terms", "|").alias("matched_terms"), "rank", F.col("metadata.functions").alias("n_functions"), F.col("metadata.size").alias("size"))


def search_enriched(spark, d):
    """Fused answers with metadata; the files with the most lines and the longest paths stand in for a semantic tier."""
    rows = saved(index_rows(spark, d), "index-rows")
    # The answers of a tier are few and read several times.
    fast = saved(fast_search(rows, asked(spark), 10), "fast")
    likeness = (F.col("line_count") / 100).alias("score")
    near = rows.select(F.col("relative_path").alias("path"), likeness).crossJoin(few(asked(spark)))
    near = saved(top(near, 10, F.desc("score"), F.desc(F.length("path")), F.asc("path")).select("query_id", "path", "score", "rank"), "near")
    out = enriched(answered(asked(spark), fast, near, 8, 0.3), fast, rows)
    m = F.col("metadata")
    return out.select("query_id", "path", F.round("score", 8).alias("score"), "mode", "rank", F.coalesce("match_type", F.lit("")).alias("match_type"), F.coalesce(F.array_join("matched_terms", "|"), F.lit("")).alias("matched_terms"),
                      m.language.alias("language"), m.size.alias("size"), m.line_count.alias("line_count"), m.functions.alias("n_functions"), m.classes.alias("n_classes"), m.imports.alias("n_imports"))


def vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("path"), "embedding")


def vector_query(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def vector_topk(spark, d):
    return vector_search(vectors(spark, d), vector_query(spark, d), 10).select(F.col("path").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


def hundredths(spark, d):
    """Query vectors whose number grows with the table: the ids divisible by 100."""
    return spark.read.parquet(f"{d}/embeddings.parquet").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def vector_batch(spark, d):
    return vector_search(vectors(spark, d), hundredths(spark, d), 5).select("query_id", F.col("path").alias("vec_id"), F.round("score", 6).alias("score"), "rank")


def tiers(spark, d):
    q = spark.createDataFrame([(0, list(TERMS))], "query_id int, terms array<string>")
    fast = top(bm25.search(q, body(spark, d)), 10, F.desc("bm25"), F.asc("id")).select("query_id", F.col("id").alias("path"), F.col("bm25").alias("score"), "rank")
    near = vector_search(vectors(spark, d), vector_query(spark, d).withColumn("query_id", F.lit(0)), 10).select("query_id", "path", "score", "rank")
    return fast, near


def rrf_fuse(spark, d):
    return fused(*tiers(spark, d), 12).select(F.col("path").alias("id"), F.round("score", 8).alias("score"), "rank")


def driver_modes(spark, d):
    """Query 0 has both tiers, 1 the semantic one only, 2 the fast one only, 3 neither."""
    fast, near = tiers(spark, d)
    fast = fast.withColumn("query_id", F.explode(F.array(F.lit(0), F.lit(2))))
    near = near.withColumn("query_id", F.explode(F.array(F.lit(0), F.lit(1))))
    out = answered(spark.range(4).select(F.col("id").cast("int").alias("query_id")), fast, near, 5, 0.3)
    return out.select("query_id", F.col("path").alias("id"), "mode", "rank", F.round("score", 6).alias("score"))


def semantic_threshold(spark, d):
    near = vector_search(vectors(spark, d), hundredths(spark, d), 10).where("rank <= 5 and score >= 0.3")
    return near.select("query_id", F.col("path").alias("vec_id"), F.round("score", 6).alias("score"))


def lookup(spark, d):
    return module_lookup(files(spark, d).select("relative_path"))


def dep_edges(spark, d):
    return dependency_edges(extracted(files(spark, d), ["python", "javascript"]).select("relative_path", "imports"))


def dependents(spark, d):
    return adjacency(dep_edges(spark, d)).select("path", *joined("imports", "dependents"))


def find_related(spark, d):
    target = files(spark, d).agg(F.min("relative_path").alias("t")).first().t
    near = vector_search(vectors(spark, d), vector_query(spark, d), 8)
    near = near.select(F.concat(F.lit("vec/"), F.col("path").cast("string")).alias("path"), "score")
    return related(dep_edges(spark, d), target, near, 10)


def snapshots(spark, d):
    docs = documents(spark, d)
    text = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    old = docs.where("doc_id % 7 <> 0").select(doc_path().alias("relative_path"), text.alias("text"))
    now = docs.where("doc_id % 13 <> 0").select(doc_path().alias("relative_path"), "text")
    return tuple(x.withColumn("content_hash", content_hash("text")) for x in (old, now))


def incremental_diff(spark, d):
    return diff(*(x.drop("text") for x in snapshots(spark, d)))


def incremental_counts(spark, d):
    return counts(incremental_diff(spark, d))


def incremental_apply(spark, d):
    old, now = snapshots(spark, d)
    stamp = lambda df, at: df.withColumn("indexed", F.lit(at))
    out = applied(stamp(old, "old").drop("text"), now.drop("text"), lambda x: stamp(x, "now"))
    return out.select("relative_path", "content_hash", "indexed")


def embed_cache_split(spark, d):
    """The cache holds the vectors of documents whose id is that of a vector, for two models."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    now = documents(spark, d).select(doc_path().alias("relative_path"), content_hash("text").alias("content_hash"), "doc_id")
    cache = now.join(e, F.col("doc_id") == F.col("vec_id")).select("content_hash", F.when(F.col("doc_id") % 3 == 0, "other").otherwise("own").alias("model"), "embedding")
    return cache_stats(cache_split(now.drop("doc_id"), cache, "own"))


def sampling(spark, d):
    return documents(spark, d).select("doc_id", F.md5(F.encode(related_sample("text"), "UTF-8")).alias("sample"), F.length(related_sample("text")).alias("chars"))


def embed_sampling(spark, d):
    s = embedding_sample(512)(F.col("text"))
    return documents(spark, d).select("doc_id", F.length(s).alias("chars"), F.md5(F.encode(s, "UTF-8")).alias("sample"))


def index_status(spark, d):
    f = index_rows(spark, d)
    return f.groupBy("language").agg(F.count(F.lit(1)).alias("file_count"), F.sum("size").alias("bytes"), F.sum("line_count").alias("lines"), F.sum(F.size("functions")).alias("functions"))


def hashes(spark, d):
    return documents(spark, d).select("doc_id", content_hash("text").alias("content_hash"), line_count("text").alias("line_count"))


EXTS = ("py", "TSX", "rs", "h", "txt", "yml", "env", "exe")


def language_map(spark, d):
    ext = F.element_at(F.array(*(F.lit(x) for x in EXTS)), (F.col("doc_id") % 8 + 1).cast("int"))
    return documents(spark, d).select("doc_id", language(F.concat(F.lit("a/b."), ext)).alias("language"))


FOLDERS = ("src", "environment", "dist", "a/build/b", "lib", "venv", "docs", ".git")


def scan_filter(spark, d):
    folder = F.element_at(F.array(*(F.lit(x) for x in FOLDERS)), (F.col("doc_id") % 8 + 1).cast("int"))
    ext = F.element_at(F.array(F.lit(".py"), F.lit(".sql"), F.lit(".MD")), (F.col("doc_id") % 3 + 1).cast("int"))
    path = F.concat(F.lit("/r/"), folder, F.lit("/"), F.col("doc_id").cast("string"), ext)
    return documents(spark, d).select(path.alias("path")).where(indexable(F.col("path"), Config().excluded))


def path_tokens(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.array_join(path_parts(F.col("url")), "|").alias("parts"))


def camel_split(spark, d):
    name = F.concat(F.lit("get"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.col("p_type"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.array_join(camel_parts(name), "|").alias("parts"))


QUERIES_BY_NAME = {
    "content_hash": hashes, "language_map": language_map, "scan_filter": scan_filter, "path_tokens": path_tokens, "camel_split": camel_split,
    "extract_symbols": extract_symbols, "extract_comments": extract_comments, "extract_all_languages": extract_all_languages, "keyword_set": keyword_set,
    "doc_lengths": doc_lengths, "doc_freq": doc_freq, "bm25_topk": bm25_topk, "bm25_batch": bm25_batch, "name_match": name_match, "path_match": path_match,
    "matched_terms": matched, "fast_composite": fast_composite, "search_enriched": search_enriched, "vector_topk": vector_topk, "vector_batch": vector_batch, "semantic_threshold": semantic_threshold,
    "rrf_fuse": rrf_fuse, "query_driver_modes": driver_modes, "module_lookup": lookup, "dep_edges": dep_edges, "dependents": dependents, "find_related": find_related,
    "incremental_diff": incremental_diff, "incremental_counts": incremental_counts, "incremental_apply": incremental_apply, "embed_cache_split": embed_cache_split,
    "content_sampling": sampling, "embed_sampling": embed_sampling, "index_status": index_status,
    "bm25_batch_whole": bm25_batch_whole,
}
