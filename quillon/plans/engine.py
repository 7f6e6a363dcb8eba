"""The engine: index a tree, search it, find related files, report its state."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import INDEX_FOLDER, Config
from ..functions.text import content_hash, embedding_sample, related_sample
from ..operators import bm25
from ..operators.embedding import create_model, embedded
from ..operators.fusion import answered, enriched
from ..operators.graph import dependency_edges, related, resolve_target
from ..operators.incremental import applied, counts, diff
from ..operators.lexical import corpus_of, fast_search
from ..operators.vectors import cache_split, vector_search
from ..sources import store
from ..sources.files import indexed, scan
from ..sources.tables import forget, saved


class Engine:
    """Holds a session, a root folder and settings; all state is in the versions of the index folder."""

    def __init__(self, spark: SparkSession, root: str, config: Config = Config(), index: str | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config
        self.folder = index or f"{self.root}/{INDEX_FOLDER}"

    def table(self, name: str) -> DataFrame | None:
        return store.read(self.spark, self.folder, name)

    def index(self, *, reindex: bool = False, semantic: bool = True, progress=None) -> dict:
        """Bring the index up to date by content hash; counts of what changed.

        progress gets {phase, total, current, percent} between phases. If the embedding model can't be loaded, the keyword
        tier is complete all the same: ``semantic`` is False in the answer and ``note`` says why.
        """
        phases = ["scanning", "writing", *(["embedding"] if semantic else []), "done"]

        def say(phase: str) -> None:
            at, last = phases.index(phase), len(phases) - 1
            if progress:
                progress({"phase": phase, "total": last, "current": at, "percent": 100 * at / last})

        say("scanning")
        now = saved(scan(self.spark, self.root, self.config).withColumn("content_hash", content_hash("text")), "scanned")
        next_ = store.Version(self.spark, self.folder)
        old = None if reindex else next_.read("files")
        if old is None:
            files, changed = indexed(now), None
        else:
            files, changed = applied(old, now, indexed), counts(diff(old, now)).first().asDict()
        say("writing")
        next_.write(files, "files")
        forget(now)
        self.derive(next_)
        embedded_now: dict = {"semantic": False}
        if semantic:
            say("embedding")
            try:
                embedded_now = {"semantic": True, **self.embed(next_)}
            except RuntimeError as e:
                embedded_now["note"] = str(e)
        next_.commit()
        say("done")
        total = self.table("files").count()
        return {"file_count": total, **(changed or {"unchanged": 0, "changed": 0, "new": total, "removed": 0}), **embedded_now}

    def derive(self, to: store.Version) -> None:
        """All tables made of the files table, but for the vectors."""
        files = to.read("files")
        to.write(dependency_edges(files), "edges")
        corpus = corpus_of(files)
        to.write(bm25.postings(corpus), "postings", sort="term")
        to.write(bm25.doc_lengths(corpus), "doc_len")
        to.write(bm25.term_stats(to.read("postings"), to.read("doc_len")), "term_stats", sort="term")
        before = to.read("manifest")
        first = before.first() if before is not None and "created_at" in before.columns else None
        created = F.lit(first.created_at) if first else F.current_timestamp()
        manifest = files.agg(F.count(F.lit(1)).alias("file_count"))
        manifest = manifest.withColumns({"root_path": F.lit(self.root), "version": F.lit("1.0.0"), "created_at": created, "updated_at": F.current_timestamp(), "model": F.lit(self.config.embedding_model)})
        to.write(manifest, "manifest")

    def embed(self, to: store.Version) -> dict:
        """Vectors of all files: taken from the table where path or content and model are the same, made for the others.

        Counts: vectors in all, cached, new, and skipped (files without text to embed).
        """
        key = self.config.embedding_model
        model = create_model(key)
        files = to.read("files").select("relative_path", "content_hash", "language", "line_count", "text")
        old = to.read("vectors")
        if old is None:
            have = files.withColumn("embedding", F.lit(None).cast("array<float>"))
        else:
            have = cache_split(files, old.select("relative_path", "content_hash", "model", "embedding"), key)
        have = have.withColumn("cached", F.col("embedding").isNotNull())
        known = have.where("embedding is not null")
        made = have.where("embedding is null").withColumn("embedding", embedded(embedding_sample(model.max_tokens)(F.col("text")), key))
        rows = known.unionByName(made).where("text is not null").drop("text", "cached").withColumns({"model": F.lit(key), "indexed_at": F.current_timestamp().cast("string")})
        n = have.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("text").isNotNull()).alias("n"), F.count_if("cached").alias("cached")).first()
        to.write(rows, "vectors")
        return {"vectors": n.n, "cached": n.cached, "made": n.n - n.cached, "skipped": n["all"] - n.n}

    def _vectors(self) -> DataFrame | None:
        vectors = self.table("vectors")
        return None if vectors is None else vectors.select(F.col("relative_path").alias("path"), "embedding", "language", "line_count")

    def _similar(self, texts: DataFrame, k: int) -> DataFrame | None:
        vectors = self._vectors()
        if vectors is None:
            return None
        try:
            model = create_model(self.config.embedding_model)
        except RuntimeError:
            return None
        rows = [(r.query_id, [float(x) for x in model.embed_query(r.query)]) for r in texts.collect()]  # as many as queries asked
        return vector_search(vectors, self.spark.createDataFrame(rows, f"query_id {dict(texts.dtypes)['query_id']}, vector array<float>"), k)

    def search(self, queries: str | DataFrame, *, max_results: int | None = None) -> DataFrame:
        """query_id, path, score, mode, rank, match_type, matched_terms, metadata of a query or of queries (query_id, query).

        Without vectors, or where the model can't be loaded, the keyword tier answers alone.
        """
        k = max_results or self.config.max_results
        asked = self.spark.createDataFrame([(0, queries)], "query_id int, query string") if isinstance(queries, str) else queries
        files = self.table("files")
        if files is None:
            raise FileNotFoundError(f"no index at {self.folder}")
        fast = fast_search(files, asked, 2 * k, posted=self.table("postings"), lengths=self.table("doc_len"), stats=self.table("term_stats"))
        near = self._similar(asked, 2 * k)
        if near is None:
            near = fast.limit(0).select("query_id", "path", "score", "rank")
        found = answered(asked, fast, near, k, self.config.similarity_threshold)
        return enriched(found, fast, files).orderBy("query_id", "rank")

    def find_related(self, path: str, *, max_results: int = 10) -> DataFrame:
        """file_path, relationship, score of the files that a file imports, is imported by, or resembles."""
        files = self.table("files")
        target = None if files is None else resolve_target(files, path)
        if target is None:
            raise FileNotFoundError(path)
        text = files.where(F.col("relative_path") == target).select(F.lit(0).alias("query_id"), related_sample("text").alias("query"))
        return related(self.table("edges"), target, self._similar(text, max_results + 5), max_results)

    def status(self) -> dict:
        manifest, vectors = self.table("manifest"), self.table("vectors")
        if manifest is None:
            return {"fast": False, "semantic": False}
        m = manifest.first()
        v = None if vectors is None else vectors.agg(F.count(F.lit(1)).alias("n"), F.first("model").alias("model")).first()
        return {"fast": True, "semantic": v is not None, "file_count": m.file_count, "updated_at": m.updated_at, "vector_count": v.n if v else 0, "model": v.model if v else None}
