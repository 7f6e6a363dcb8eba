from pathlib import Path

import pytest

from quillon.config import Config, assigned, from_dict, ignoring, load, save
from quillon.functions.keywords import camel_parts
from quillon.functions.text import line_count, related_sample
from quillon.operators import bm25
from quillon.cli import main
from quillon.functions.extract import extracted
from quillon.operators.embedding import create_model
from quillon.operators.fusion import fused
from quillon.operators.lexical import name_score, path_score
from quillon.plans.engine import Engine
from quillon.sources import store
from quillon.sources.files import indexed, scan
from quillon.streaming.ingest import follow
from pyspark.sql import functions as F

TREE = {
    "app/validators.py": '"""Checks."""\nimport re\nfrom typing import Any\n\ndef validate_email(x):\n    return x\n',
    "app/api.py": "from app.validators import validate_email\nimport models.user\nclass UserApi:\n    def getUser(self):\n        pass\n",
    "models/user.py": "class User:\n    pass\n",
    "web/user.ts": "import x from './user'\nconst load = async (a) => a;\n// note\n",
    "src/environment.py": "x = 1\n",
    "lib/a.go": 'package a\nimport (\n  "fmt"\n  "os/exec"\n)\nfunc Run() {\n}\ntype T struct {\n}\n',
    "lib/b.c": '#include <stdio.h>\nint main(void) {\n  return 0;\n}\n',
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("r")
    for name, text in TREE.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(text)
    return root


def test_index_search_related(spark, tree):
    engine = Engine(spark, str(tree), Config(embedding_model="hashing"), index=str(tree) + "-index")
    assert engine.status() == {"fast": False, "semantic": False}
    assert engine.index()["new"] == 6  # environment.py holds an excluded pattern
    files = {r.relative_path: r for r in engine.table("files").collect()}
    v = files["app/validators.py"]
    assert (v.imports, v.functions, v.comments, v.line_count, v.language) == (["re", "typing"], ["validate_email"], ["Checks."], 7, "python")
    assert files["lib/a.go"].imports == ["fmt", "os/exec"] and files["lib/a.go"].exports == ["Run", "T"]
    assert files["lib/b.c"].functions == ["main"] and files["web/user.ts"].functions == ["load"]
    edges = {(r.src, r.dst) for r in engine.table("edges").collect()}
    assert ("app/api.py", "app/validators.py") in edges and ("app/api.py", "models/user.py") in edges
    best = engine.search("validate email").collect()
    assert best[0].path == "app/validators.py" and best[0].mode == "fused" and best[0].score <= 1 / 61
    kinds = {r.file_path: r.relationship for r in engine.find_related("api.py").collect()}
    assert kinds["app/validators.py"] == "imports" and "app/api.py" not in kinds
    (tree / "models/user.py").write_text("class Person:\n    pass\n")
    (tree / "lib/b.c").unlink()
    got = engine.index()
    assert (got["unchanged"], got["changed"], got["new"], got["removed"], got["file_count"]) == (4, 1, 0, 1, 5)
    assert engine.status()["vector_count"] == 5


def test_search_has_metadata(spark, tree):
    engine = Engine(spark, str(tree), Config(embedding_model="hashing"), index=str(tree) + "-meta")
    said = []
    engine.index(progress=said.append)
    assert [x["phase"] for x in said] == ["scanning", "writing", "embedding", "done"] and said[-1]["percent"] == 100
    rows = {r.path: r for r in engine.search("validate email", max_results=6).collect()}
    best = rows["app/validators.py"]
    assert best.match_type == "composite" and "validate_email" in best.matched_terms
    assert best.metadata.asDict() == {"language": "python", "size": len(TREE["app/validators.py"]), "line_count": 7, "functions": 1, "classes": 0, "imports": 2}
    alone = [r for r in rows.values() if r.match_type is None]  # found by the semantic tier only
    assert alone and all(r.metadata.language for r in alone)


def test_without_a_model(spark, tree, capsys, tmp_path):
    """The default model needs a package that isn't here: the keyword tier is complete and answers with a warning."""
    engine = Engine(spark, str(tree), Config(), index=str(tree) + "-fast")
    got = engine.index()
    assert got["semantic"] is False and "sentence-transformers" in got["note"] and got["file_count"] == engine.table("files").count()
    assert engine.search("validate email").first().mode == "fast"
    (tmp_path / "a.py").write_text("def load_file():\n    pass\n")
    main(["--config", str(tmp_path / "none.toml"), "index", str(tmp_path), "--no-semantic"])
    main(["--config", str(tmp_path / "none.toml"), "find", "load", "--path", str(tmp_path)])
    said = capsys.readouterr()
    assert "no semantic index" in said.err and '"path":"a.py"' in said.out
    with pytest.raises(ValueError):
        create_model("nothing")


def test_export_import_and_corrupt_tables(spark, tree, tmp_path):
    engine = Engine(spark, str(tree), Config(), index=str(tree) + "-json")
    engine.index(semantic=False)
    engine.index(semantic=False)
    files, edges, manifest = (engine.table(t) for t in ("files", "edges", "manifest"))
    first = manifest.first()
    assert first.created_at < first.updated_at
    store.export_json(files, edges, manifest, str(tmp_path))
    again = store.import_json(spark, str(tmp_path), files.drop("text").schema)
    assert sorted(map(str, again[0].collect())) == sorted(map(str, files.drop("text").collect()))
    assert sorted(again[1].collect()) == sorted(edges.collect()) and again[2].first().file_count == first.file_count
    folder = tmp_path / "bad" / "files" / "x"
    folder.mkdir(parents=True)
    (folder / "part-0.parquet").write_text("no parquet")
    (tmp_path / "bad" / "versions").mkdir()
    (tmp_path / "bad" / "versions" / "1").write_text('{"files": "files/x"}')
    assert store.read(spark, str(tmp_path / "bad"), "files") is None


def test_a_writer_that_dies_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    (tmp_path / "a.py").write_text("def first():\n    pass\n")
    engine = Engine(spark, str(tmp_path), Config(), index=str(tmp_path / "index"))
    engine.index(semantic=False)
    (tmp_path / "a.py").write_text("def second():\n    pass\n")
    whole = store.Version.write

    def dies(self, df, table, **how):
        if table == "term_stats":
            raise OSError("lost")
        whole(self, df, table, **how)

    with monkeypatch.context() as m:
        m.setattr(store.Version, "write", dies)
        with pytest.raises(OSError):
            engine.index(semantic=False)
    assert engine.table("files").first().functions == ["first"] and engine.search("first").count() == 1
    (tmp_path / "index" / "versions" / "2").write_text('{"files"')  # a version that was never finished
    assert engine.table("files").first().functions == ["first"]
    for _ in range(3):
        engine.index(semantic=False)
    assert engine.search("second").count() == 1 and len(store.versions(spark, engine.folder)) == store.KEPT


def test_one_scan(spark, tree):
    plan = indexed(scan(spark, str(tree)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


SNIPPETS = {
    "java": ("import java.util.List;\npublic class A {\n  // note\n  public static int run(int x) {\n    if (x) {}\n  }\n}\n", ["java.util.List"], ["run"], ["A"], [], ["note"]),
    "rust": ("use std::io;\n/// doc\npub fn go(x: u8) {}\npub struct S;\nenum E {}\nimpl S {}\nimpl Other {}\n", ["std::io"], ["go"], ["S", "E", "Other"], ["go", "S"], ["doc", "/ doc"]),
    "ruby": ("require 'json'\n# note\nmodule M\n  class C\n    def run\n    end\n  end\nend\n", ["json"], ["run"], ["C", "M"], [], ["note"]),
    "php": ("<?php\nuse App\\Thing;\nrequire_once 'a.php';\nclass C {\n  function run() {}\n}\n/* note */\n", ["App\\Thing", "a.php"], ["run"], ["C"], [], ["note"]),
    "csharp": ("using System.Text;\npublic class C {\n  public async Task Run() { }\n  private static int Two() { }\n}\n", ["System.Text"], ["Run", "Two"], ["C"], [], []),
    "python": ("__all__ = ['a', \"b\"]\ndef a():\n    pass\n#!x\n# note\n" + "# more\n" * 60, [], ["a"], [], ["a", "b"], ["note"] + ["more"] * 49),
    "swift": ("import Foundation\nfunc a() {}\n", [], [], [], [], []),
}


def test_each_language(spark):
    rows = spark.createDataFrame([(k, v[0]) for k, v in SNIPPETS.items()], "language string, text string")
    got = {r.language: (r.imports, r.functions, r.classes, r.exports, r.comments) for r in extracted(rows).collect()}
    for name, (_, *want) in SNIPPETS.items():
        assert got[name] == tuple(want), name


def test_scores(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    names = lambda *x: F.array(*map(F.lit, x))
    assert [one(name_score(F.lit("user"), names(x))) for x in ("User", "getUser", "use")] == [1.0, 0.7, 0.5]
    assert one(name_score(F.lit("load config"), names("config_dict"))) == 0.3
    assert one(path_score(F.lit("auth token"), F.lit("src/auth/x.py"))) == pytest.approx(0.3)
    assert one(path_score(F.lit("src/auth"), F.lit("src/auth/x.py"))) == 1.0
    assert one(camel_parts(F.lit("getHTTPName_x"))) == ["get", "http", "name"]
    assert [one(line_count(F.lit(x))) for x in ("", "a", "a\n")] == [1, 1, 2]
    assert one(F.length(related_sample(F.repeat(F.lit("a"), 8001)))) == 6005


def test_bm25_by_hand(spark):
    corpus = spark.createDataFrame([(1, ["a", "b", "b"]), (2, ["a", "c"]), (3, ["c", "d"])], "id int, terms array<string>")
    p, n = bm25.postings(corpus), bm25.doc_lengths(corpus)
    ask = lambda t: spark.createDataFrame([(0, [t])], "query_id int, terms array<string>")
    got = bm25.scores(ask("b"), p, n, bm25.term_stats(p, n)).collect()
    assert len(got) == 1 and got[0].bm25 == pytest.approx(0.6684, abs=1e-4)
    assert bm25.scores(ask("a"), p, n, bm25.term_stats(p, n)).count() == 0


def test_fusion_order(spark):
    tier = lambda *p: spark.createDataFrame([(0, x, i + 1) for i, x in enumerate(p)], "query_id int, path string, rank int")
    got = fused(tier("f", "both"), tier("s", "both"), 5).orderBy("rank").collect()
    assert [r.path for r in got] == ["both", "f", "s"] and got[1].score == pytest.approx(0.5 / 61)


def test_config(tmp_path):
    c = ignoring(assigned(assigned(Config(), "search.MAX_RESULTS", "9"), "similarity_threshold", "0.5"), "x", "x", "env")
    assert (c.max_results, c.similarity_threshold, c.excluded[-1]) == (9, 0.5, "x")
    save(c, tmp_path / "c.toml")
    assert load(tmp_path / "c.toml") == c
    assert from_dict({"search": {"MAX_RESULTS": 2}, "llm": {"x": 1}}).max_results == 2
    with pytest.raises(KeyError):
        assigned(Config(), "search.NOPE", "1")


def test_stream(spark, tmp_path):
    schema = "path string, relative_path string, size long, modified_time double, created_time double, language string, text string"
    for i, text in enumerate(("def f():\n pass\n", "def g():\n pass\n")):
        spark.createDataFrame([("/r/a.py", "a.py", 1, float(i), None, "python", text)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        follow(spark, str(tmp_path / "in"), schema, str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination()
    rows = store.read(spark, str(tmp_path / "index"), "files").collect()
    assert [r.functions for r in rows] == [["g"]]


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) >= 33
    assert Path(e.__file__).name == "__spark_entry__.py"
