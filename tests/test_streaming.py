from quillon.config import Config
from quillon.plans.engine import Engine
from quillon.streaming.ingest import upsert

SCHEMA = "path string, relative_path string, size long, modified_time double, created_time double, language string, text string"


def test_search_and_edges_follow_the_stream(spark, tmp_path):
    root = tmp_path / "r"
    root.mkdir()
    (root / "a.py").write_text("import c\ndef first():\n    pass\n")
    (root / "c.py").write_text("def cc():\n    pass\n")
    (root / "d.py").write_text("def dd():\n    pass\n")
    engine = Engine(spark, str(root), Config(embedding_model="hashing"), index=str(tmp_path / "index"))
    engine.index()
    batch = [("/r/a.py", "a.py", 1, 2.0, None, "python", "import d\ndef second():\n    pass\n"), ("/r/b.py", "b.py", 1, 2.0, None, "python", "def zebra():\n    pass\n")]
    upsert(spark, engine.folder, spark.createDataFrame(batch, SCHEMA))
    terms = {(r.id, r.term) for r in engine.table("postings").collect()}
    assert ("b.py", "zebra") in terms and ("a.py", "second") in terms and ("a.py", "first") not in terms
    assert {(r.src, r.dst) for r in engine.table("edges").collect()} == {("a.py", "d.py")}
    assert {r.id for r in engine.table("doc_len").collect()} == {"a.py", "b.py", "c.py", "d.py"}
    status = engine.status()
    assert (status["file_count"], status["vector_count"], status["model"]) == (4, 4, "hashing")
    assert engine.table("manifest").first().root_path == str(root)
    assert engine.search("zebra").first().path == "b.py"
