import ast
import datetime as dt
import io
import json
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from codequarry.functions import text as tx
from codequarry.operators import chunking, graph, memory, ranking, registry, search, structure
from codequarry.sources import files as src


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("authenticateUser", ["authenticate", "user"]), ("create_jwt_token", ["create", "jwt", "token"]), ("HTTPServer2 a 42 x1", ["http", "server2", "x1"]), ("", []), (None, [])])
def test_tokenize(spark, text, want):
    assert one(spark, tx.tokenize_code(F.col("t")), t=text) == want


@pytest.mark.parametrize("path,want", [("src/auth/login.py", 1.0), ("docs/x.md", 0.1), ("tests/x.py", 0.3), ("README.md", 0.1), ("cli.py", 0.8), ("x/y.py", 0.5), ("config/a.py", 0.65), ("api/x.py", 0.85), (None, 0.5)])
def test_path_score(spark, path, want):
    assert one(spark, tx.path_score(F.col("p")), p=path) == want


@pytest.mark.parametrize("path,want", [("a/b.py", "python"), ("x.png", None), ("yarn.lock", None), ("Dockerfile", "dockerfile"), ("docker-compose.override", "yaml"), ("a.unknown", None), (".env.example", "bash"), ("x/Makefile", "makefile"), ("a.TSX", "typescript")])
def test_language(spark, path, want):
    assert one(spark, tx.language_of(F.col("p")), p=path) == want


def test_questions(spark):
    assert one(spark, tx.is_vague(F.col("q")), q="explain that") and not one(spark, tx.is_vague(F.col("q")), q="Where does the parser read its settings from?")
    assert one(spark, tx.question_type(F.col("q")), q="Explain the design") == "explain"
    assert one(spark, tx.architecture_route(F.col("q")), q="What depends on Store?") == "dependency"
    assert one(spark, tx.module_mentioned(F.col("q")), q="What does UserService depend on?") == "UserService"
    assert one(spark, tx.module_mentioned(F.col("q")), q="who calls login.py") == "login"


@pytest.mark.parametrize("url,want", [("https://github.com/Owner/repo", ("owner", "repo", None)), ("github.com/o/r.git", ("o", "r", None)), ("https://github.com/o/r/tree/feature/x/", ("o", "r", "feature")), ("https://gitlab.com/o/r", (None, None, None)), (None, (None, None, None))])
def test_repo_url(spark, url, want):
    assert tuple(one(spark, tx.repo_parts(F.col("u")), u=url)) == want


def test_line_count(spark):
    for text in ("", "a", "a\n", "a\nb", "a\r\nb\r\n", "\n\n"):
        assert one(spark, tx.line_count(F.col("t")), t=text) == len(text.splitlines())


def test_fusion(spark):
    hits = [(1, 0, 1, "a", 0.9), (1, 0, 2, "common", 0.8), (1, 1, 1, "b", 0.7), (1, 1, 2, "common", 0.6), (2, 0, 1, "x", 0.5), (2, 0, 2, "y", 0.4)]
    df = spark.createDataFrame(hits, "query_id int, variant_no int, rank int, id string, similarity double")
    rows = {(r["query_id"], r["id"]): r for r in ranking.fuse(df, 10).collect()}
    c = rows[1, "common"]
    assert c["position"] == 1 and c["appearances"] == 2 and c["similarity"] == 0.6 and c["best_similarity"] == 0.8 and c["rrf_score"] == round(2 / 62, 6)
    assert rows[2, "x"]["rrf_score"] == 0.5
    assert ranking.fuse(df.limit(0), 10).count() == 0


def test_bm25_plus_by_hand(spark):
    docs = {"d1": "alpha beta beta", "d2": "gamma", "d3": ""}
    query = ["beta", "beta", "gamma", "absent"]
    got = {r["id"]: r["bm25"] for r in ranking.bm25_plus(spark.createDataFrame([(1, i, t) for i, t in docs.items()], "query_id int, id string, text string"), spark.createDataFrame([(1, query)], "query_id int, tokens array<string>")).collect()}
    n, avg = 3, 4 / 3
    for i, t in docs.items():
        words, want = t.split(), 0.0
        for w in query:
            df = sum(w in x.split() for x in docs.values())
            if df:
                tf = words.count(w)
                want += math.log((n + 1) / df) * (1 + tf * 2.5 / (1.5 * (0.25 + 0.75 * len(words) / avg) + tf))
        assert got[i] == pytest.approx(want)


def test_context_stops_at_first_overflow(spark):
    rows = [(1, f"c{i}", 1.0 - i / 100, i + 1, 1.0 if i != 1 else 0.1, f"f{i % 2}", "x" * (40 if i != 2 else 400)) for i in range(6)]
    df = spark.createDataFrame(rows, "query_id int, id string, final_score double, final_rank int, path_score double, file_path string, text string")
    got = ranking.pack_context(df, 50).orderBy("place").collect()
    assert [r["id"] for r in got] == ["c0"] and got[0]["truncated"]
    assert ranking.pack_context(df, 10_000).count() == 6


def test_expand(spark):
    q = spark.createDataFrame([(1, "Where is the login error handled"), (2, ""), (3, None)], "query_id int, question string")
    got = [r["variant"] for r in ranking.expand_queries(q).orderBy("variant_no").collect()]
    assert got == ["Where is the login error handled", "where is the authentication error handled", "where is the signin error handled", "is the login error handled function implementation"]


def test_vector_search(spark):
    corpus = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [1.0]), ("f", [2.0, 0.0]), ("g", [float("nan"), 1.0])], "id string, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 3.0])], "query_id int, embedding array<double>")
    for block in (1, 4096):
        got = {(r["query_id"], r["rank"]): (r["id"], r["similarity"]) for r in search.vector_topk(corpus, queries, 2, block=block).collect()}
        assert got == {(1, 1): ("a", 1.0), (1, 2): ("f", 1.0), (2, 1): ("b", 1.0), (2, 2): ("a", 0.0)}
    assert search.vector_topk(corpus, queries, 3, 0.35).count() == 3
    assert search.vector_topk(corpus.limit(0), queries, 3).count() == 0 and search.vector_topk(corpus, queries.limit(0), 3).count() == 0


def test_upsert_twice_changes_nothing(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4), ("c", 4)], "id string, v int")
    once = search.upsert(old, new, "id")
    assert sorted(map(tuple, once.collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert sorted(map(tuple, search.upsert(once, new, "id").collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_embedder_is_deterministic_and_unit(spark):
    e = search.hashing_embedder(16)
    import pandas as pd

    a, b = e(pd.Series(["x y z", "x y z"])), e(pd.Series(["x y z", ""]))
    assert (a[0] == b[0]).all() and abs(float((a[0] ** 2).sum()) - 1) < 1e-5 and not b[1].any()


FILES = "project_id string, file_path string, language string, content string"
PYTHON = '@deco\nclass A(B):\n    """Doc."""\n    def m(self) -> int:\n        def inner():\n            return 1\n        return inner()\n\nasync def f(x):\n    return x\n'


def test_python_definitions():
    got = [(r["chunk_type"], r["function_name"], r["class_name"], r["start_line"], r["is_async"]) for r in chunking.by_python_tree(PYTHON)]
    assert got == [("class", "", "A", 2, False), ("method", "m", "A", 4, False), ("function", "inner", "", 5, False), ("function", "f", "", 9, True)]
    assert chunking.by_python_tree("def f(") == []
    long = "def f():\n" + "    x = 1\n" * 900
    parts = chunking.by_python_tree(long)
    assert len(parts) > 1 and all(len(p["text"]) <= 1500 and p["function_name"] == "f" for p in parts)


def test_brace_definitions():
    js = "export function a(x) { if (x) { return '}' } }\nclass B { m() { return 1 } }\nconst c = async (y) => { y() }\n"
    assert [(r["chunk_type"], r["function_name"] or r["class_name"]) for r in chunking.by_braces(js, "javascript")] == [("function", "a"), ("class", "B"), ("function", "c")]
    go = "package x\n\nfunc (s *S) M(a int) error {\n\treturn nil\n}\n\ntype S struct {\n\tA int\n}\n"
    assert [(r["chunk_type"], r["start_line"], r["end_line"]) for r in chunking.by_braces(go, "go")] == [("method", 3, 5), ("class", 7, 9)]


def test_chunk_router(spark):
    rows = [("p", "a.py", "python", PYTHON), ("p", "b.md", "markdown", "intro\n# A\ntext\n## B\n\nmore\n"), ("p", "c.txt", "text", "A" * 300 + "\n" + "B" * 300), ("p", "d.py", "python", ""), ("p", "e.py", "python", None), ("p", "f.css", "css", "   \n ")]
    got = chunking.chunk_files(spark.createDataFrame(rows, FILES)).collect()
    by = {p: [(r["chunk_type"], r["start_line"]) for r in sorted(got, key=lambda r: r["start_line"]) if r["file_path"] == p] for p in ("a.py", "b.md", "c.txt", "d.py", "e.py", "f.css")}
    assert len(by["a.py"]) == 4 and by["b.md"] == [("heading", 1), ("heading", 2), ("heading", 4)] and len(by["c.txt"]) == 2 and not by["d.py"] and not by["e.py"] and not by["f.css"]
    assert len({r["chunk_id"] for r in got}) == len(got)


def test_python_node():
    n = graph.python_node("src/a/main.py", "import os\nfrom .b import C, d\nfrom x.y import *\nclass K(Base, object, m.Q):\n    def f(self): pass\n@app.get('/')\ndef g(): os.path.join()\nif __name__ == '__main__': g()\n")
    assert n["imports"] == ["os", "src.a.b", "x.y"] and n["classes"] == ["K"] and n["inherits_from"] == ["Base", "m.Q"] and set(n["functions"]) == {"f", "g"}
    assert n["entry_points"] == ["g (app.get)", "__main__ block"] and n["is_entry_point"] and n["calls"] == ["app.get", "os.path.join"] and "f" not in n["exports"]
    assert graph.python_node("x.py", "import a.b\nfrom c import (")["imports"] == ["a.b", "c"]
    assert ast.parse("")  # the extractor and this test use the same parser


def test_script_node(spark):
    common = "const express = require('express')\nconst run = async (x) => x\nconst go = (y) => y\nfunction stop() {}\nrouter.get('/a', run)\napp . use('/no')\napp.post( \"/b\", go)\nmodule.exports = { run, go }\nmodule.exports = { }\n"
    rows = [("p", "src/api.js", "javascript", common), ("p", "web/index.ts", "typescript", "export const a = 1"), ("p", "web/reindex.ts", "typescript", "const b = 1"), ("p", "k.js", "javascript", "new Koa()"), ("p", "f.js", "javascript", "Fastify({})"), ("p", "h.js", "javascript", "http.createServer(x)"), ("p", "n.js", "javascript", None)]
    got = {r["file_path"]: r for r in graph.extract_script(spark.createDataFrame(rows, "project_id string, file_path string, language string, content string")).collect()}
    a = got["src/api.js"]
    assert a["exports"] == ["run, go"] and a["functions"] == ["run", "go", "stop"] and a["entry_points"] == ["GET /a", "POST /b"] and not a["is_entry_point"] and a["imports"] == ["express"]
    assert {p for p, r in got.items() if r["is_entry_point"]} == {"web/index.ts", "k.js", "f.js", "h.js"} and "n.js" not in got


MODULE = "project_id string, file_path string, language string, module_name string, imports array<string>, exports array<string>, classes array<string>, functions array<string>, inherits_from array<string>, entry_points array<string>, is_entry_point boolean, size_lines int"


def graph_of(spark):
    rows = [
        ("p", "app.py", "python", "app", ["auth", "models", "os"], [], [], ["run"], [], ["__main__ block"], True, 10), ("p", "src/auth.py", "python", "auth", ["models"], [], ["Auth"], ["login"], ["Base"], [], False, 20),
        ("p", "src/models.py", "python", "models", ["models"], [], ["Base", "User"], [], [], [], False, 30), ("p", "src/routes.py", "python", "routes.api", ["auth"], [], [], [], [], [], False, 5), ("p", "web/a.js", "javascript", "web/a", ["./b", "../src/c.js"], [], [], [], [], [], False, 5),
        ("p", "web/b.js", "javascript", "web/b", [], [], [], [], [], [], None, 5), ("p", "src/c.js", "javascript", None, [], [], [], [], [], [], False, 5), ("q", "auth.py", "python", "auth", None, [], [], [], [], [], False, 1),
    ]
    return spark.createDataFrame(rows, MODULE)


def test_graph(spark):
    m = graph_of(spark)
    exact = {(r["source"], r["target"]) for r in graph.resolve_exact(m).collect()}
    assert exact == {("app.py", "src/auth.py"), ("app.py", "src/models.py"), ("src/auth.py", "src/models.py"), ("src/routes.py", "src/auth.py")}
    e = graph.resolve_imports(m)
    assert {(r["source"], r["target"]) for r in e.collect()} == exact | {("web/a.js", "web/b.js"), ("web/a.js", "src/c.js")}
    top = graph.top_in_degree(e).where("rank <= 2").collect()
    assert {(r["target"], r["imports"]) for r in top} == {("src/auth.py", 2), ("src/models.py", 2)}
    assert [(r["source"], r["target"]) for r in graph.resolve_inheritance(m).collect()] == [("src/auth.py", "src/models.py")]
    steps = {(r["first"], r["second"]) for r in graph.flow(e, m.where("is_entry_point")).collect()}
    assert steps == {("src/auth.py", "src/models.py"), ("src/models.py", None)}
    stats = {(r["metric"], r["key"]): r["value"] for r in graph.statistics(m, e).where("project_id = 'p'").collect()}
    assert stats["modules", ""] == 7 and stats["classes", ""] == 3 and stats["entry_points", ""] == 1 and stats["language", "javascript"] == 3
    found = graph.find_file(m, spark.createDataFrame([("p", "AUTH"), ("p", "User"), ("p", "web/"), ("p", "none")], "project_id string, name string")).collect()
    assert {(r["name"], r["file_path"]) for r in found} == {("AUTH", "src/auth.py"), ("User", "src/models.py"), ("web/", "web/a.js")}
    assert {r["component"] for r in graph.component_groups(m).collect()} == {"src", "web"}
    assert json.loads(graph.to_json(m).where("file_path = 'app.py'").first()["node"])["imports"] == ["auth", "models", "os"]
    assert graph.mermaid(m, e).first()["diagram"].startswith("graph TD\n")


def test_prefix_modes(spark):
    rows = [("p", "a.py", "python", "api.users", ["api"], [], [], [], [], [], False, 1), ("p", "b.py", "python", "b", ["ap", "api.users.get"], [], [], [], [], [], False, 1)]
    m = spark.createDataFrame(rows, MODULE)
    loose, dotted = ({(r["source"], r["label"]) for r in graph.resolve_prefix(m, d).collect()} for d in (False, True))
    assert loose == {("b.py", "ap"), ("b.py", "api.users.get")} and dotted == {("b.py", "api.users.get")}


MESSAGES = "session_id string, seq int, role string, content string"


def test_sessions(spark):
    rows = [("s", i, "user" if i % 2 else "assistant", f"message {i}. more") for i in range(1, 21)]
    m = spark.createDataFrame(rows, MESSAGES)
    last = memory.last_messages(m).orderBy("place").collect()
    assert [r["seq"] for r in last] == list(range(11, 21))
    assert memory.history(m, 2).first()["history"] == "User: message 19. more\nAssistant: message 20. more"
    q = spark.createDataFrame([(1, "s", "explain that"), (2, "s", "Where is the parser configured today?"), (3, None, "explain that")], "query_id int, session_id string, question string")
    got = {r["query_id"]: r["question"] for r in ranking.enrich(q, m).collect()}
    assert got == {1: "explain that context: message 19. more message 20", 2: "Where is the parser configured today?", 3: "explain that"}
    html = memory.export_html(spark.createDataFrame([("s", 1, "user", "a < b & c"), ("s", 2, "error", "x")], MESSAGES)).first()["html"]
    assert "a &lt; b &amp; c" in html and "x" not in html.replace("</body>", "").split("<section")[0]


def test_generation_and_fallback(spark):
    from codequarry.operators import generation as g

    df = spark.createDataFrame([("What?", "code", None), (None, "", "")], "q string, c string, h string").withColumn("prompt", g.chat_prompt(F.col("q"), F.col("c"), F.col("h")))
    got = [(r["prompt"], r["answer"]) for r in g.answer(df).collect()]
    assert got == [("## Code\ncode\n\n## Question\nWhat?", "[31 characters]"), ("", "[0 characters]")]
    hits = spark.createDataFrame([(1, 1, 1, "a", 0.5)], "query_id int, variant_no int, rank int, id string, similarity double")
    more = spark.createDataFrame([(1, 1, "b", 0.9), (2, 1, "c", 0.4)], "query_id int, rank int, id string, similarity double")
    assert {(r["query_id"], r["variant_no"], r["id"]) for r in ranking.with_fallback(hits, more).collect()} == {(1, 1, "a"), (2, 0, "c")}
    ago = spark.sql("select timestamp_ntz'2025-01-01 10:00:00' a, timestamp_ntz'2025-01-01 12:30:00' b").select(tx.time_ago(F.col("a"), F.col("b")).alias("x"))
    assert ago.first()["x"] == "2h ago"
    assert one(spark, tx.readable_bytes(F.lit(1536)), t="") == "1.5 KB"


def test_registry(spark):
    rows = [("a", "One", "zip", "u/", "completed", 1, 2, "2024-01-01", "2024-01-01"), ("a", "One", "zip", "u/", "failed", 1, 2, "2024-01-01", "2024-02-01"), ("b", "one", "zip", "u", "completed", 1, 2, "2024-01-03", "2024-01-03"), ("c", "One", "zip", None, "pending", 1, 2, "2024-01-04", "2024-01-04")]
    p = spark.createDataFrame(rows, "project_id string, project_name string, source_type string, source_url string, status string, file_count int, chunk_count int, created_at string, updated_at string")
    wanted = spark.createDataFrame([(1, "u//", "x", "zip"), (2, None, "One", "zip"), (3, "v", "none", "zip")], "request_id int, source_url string, project_name string, source_type string")
    assert {r["request_id"]: r["project_id"] for r in registry.find_existing(p, wanted).collect()} == {1: "b", 2: "c", 3: None}
    assert registry.search_names(p, "ON").count() == 3
    files = spark.createDataFrame([("p", f"{d}/f{i}.py", "python") for i in range(3) for d in ("src", "tests", "x")] + [("p", "main.py", "python"), ("p", "a.md", "markdown")], "project_id string, file_path string, language string")
    ranked = [r["file_path"] for r in registry.cap_large(files, 5).orderBy("rank").collect()]
    assert ranked == ["main.py", "src/f0.py", "src/f1.py", "src/f2.py", "x/f0.py"]


def test_large_repo_query_keeps_300(spark, tmp_path):
    import __spark_entry__ as e

    t = dt.datetime(2025, 1, 1)
    rows = [(p, f"src/f{i:03}.py", "python", t) for p, n in (("big", 350), ("mid", 150), ("small", 3)) for i in range(n)]
    spark.createDataFrame(rows, "project_id string, file_path string, language string, ingested_at timestamp_ntz").write.parquet(str(tmp_path / "source_files.parquet"))
    got = {r["project_id"]: (r["n"], r["last"]) for r in e.queries()["large_repo_cap"](spark, str(tmp_path)).groupBy("project_id").agg(F.count("*").alias("n"), F.max("file_path").alias("last")).collect()}
    assert got == {"big": (300, "src/f299.py"), "mid": (150, "src/f149.py"), "small": (3, "src/f002.py")}


def test_ignore_patterns(spark):
    lines = ["# comment", "*.log", "/build/", "docs/**/x.md", "!keep.log", "temp"]
    paths = {"a.log": True, "b/keep.log": False, "build/x": True, "src/build/x": False, "docs/a/b/x.md": True, "temp": True, "a/temp/b": True, "temporal": False}
    df = spark.createDataFrame([(p,) for p in paths], "p string").select("p", src.ignored(F.col("p"), lines).alias("i"))
    assert {r["p"]: r["i"] for r in df.collect()} == paths


def test_tree_and_archives(spark, tmp_path):
    tree = {"src/main.py": b"print('hello')\n", "node_modules/x/a.js": b"var a = 1; // long enough", ".hidden/a.py": b"print('hello')\n", "src/empty.py": b"", "src/bin.txt": b"\0" * 100 + b"text", "src/latin.md": "# Größe und mehr".encode("latin-1"), "src/a.png": b"x" * 50, "b.md": b"tiny"}
    for p, data in tree.items():
        f = tmp_path / "tree" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(data)
    rows = {r["file_path"]: r for r in src.read_tree(spark, str(tmp_path / "tree"), "p").collect()}
    assert set(rows) == {"src/main.py", "src/latin.md"} and rows["src/main.py"]["line_count"] == 1 and rows["src/main.py"]["encoding"] == "utf-8"
    assert set(r["file_path"] for r in src.read_tree(spark, str(tmp_path / "tree"), "p", ["*.md"]).collect()) == {"src/main.py"}

    def archive(members):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for n, d in members.items():
                z.writestr(n, d)
        return b.getvalue()

    (tmp_path / "zips").mkdir()
    (tmp_path / "zips/good.zip").write_bytes(archive({f"root/{p}": d for p, d in tree.items()}))
    (tmp_path / "zips/slip.zip").write_bytes(archive({"../evil.py": b"print('evil evil')"}))
    (tmp_path / "zips/broken.zip").write_bytes(b"no archive")
    got = src.read_zips(spark, str(tmp_path / "zips/*.zip")).collect()
    assert {(r["project_id"], r["file_path"]) for r in got} == {("good", "src/main.py"), ("good", "src/latin.md")}
    assert src.zip_errors(spark, str(tmp_path / "zips/*.zip")).count() == 2
    src.write_partitioned(src.read_zips(spark, str(tmp_path / "zips/*.zip")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_stream_equals_batch_on_closed_sessions(spark, data):
    from codequarry.plans import registry as plans

    closed = plans.QUERIES["stream_sessions"](spark, data)
    rows = spark.read.parquet(f"{data}/events.parquet").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    batch = rows.groupBy("key", F.session_window("ts", "1 hour").alias("w")).agg(F.count("*").alias("events")).select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")
    assert closed.count() > 0 and closed.exceptAll(batch).count() == 0


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    queries, oracles = e.queries(), e.oracle_sql()
    assert set(oracles) <= set(queries) and "retrieve_e2e" in queries
    assert {"query_id", "digest", "chunks"} <= set(e.entry(spark).columns) and e.entry(spark).count() > 0


def test_missing_parts_are_named(monkeypatch):
    """Only the subpackage llm may be missing; another module that can't be imported is an error."""
    import builtins
    import importlib

    import __spark_entry__ as e

    real = builtins.__import__

    def without(name):
        def load(wanted, *rest, **more):
            if wanted == name or (wanted == "codequarry.llm" and name == "codequarry.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)
            if wanted == "codequarry.llm" and name == "regex":
                raise ModuleNotFoundError("No module named 'regex'", name="regex")
            return real(wanted, *rest, **more)

        return load

    with monkeypatch.context() as m:
        m.setattr(builtins, "__import__", without("codequarry.llm"))
        importlib.reload(e)
        assert e.llm is None and "rerank" in e.queries() and not any(k[0] == "p" and k[1].isdigit() for k in e.queries())
    with monkeypatch.context() as m:
        m.setattr(builtins, "__import__", without("regex"))
        with pytest.raises(ModuleNotFoundError):
            importlib.reload(e)
    importlib.reload(e)


NODE = "project_id string, file_path string, language string, module_name string, imports array<string>, classes array<string>, functions array<string>, inherits_from array<string>, entry_points array<string>, is_entry_point boolean, size_lines int"


def test_structural_answers(spark):
    m = spark.createDataFrame([
        ("p", "app.py", "python", "app", ["src.auth", "src.models", "flask"], [], ["main"], [], ["main"], True, 9), ("p", "src/auth.py", "python", "src.auth", ["src.models"], ["Auth"], ["a", "b"], ["Base"], [], False, 5),
        ("p", "src/models.py", "python", "src.models", [], ["Base", "User"], [], [], [], None, 3), ("q", "x.js", None, "x", [], [], [], [], [], False, None), ("q", "y/z.js", "javascript", "y/z", [], [], [], [], [], False, 1),
    ], NODE)
    e = structure.all_edges(m)
    assert {(r["source"], r["target"], r["edge_type"]) for r in e.collect()} == {("app.py", "src/auth.py", "import"), ("app.py", "src/models.py", "import"), ("src/auth.py", "src/models.py", "import"), ("src/auth.py", "src/models.py", "inheritance")}
    (entry,) = structure.entry_answers(m, e).collect()
    assert (entry["file_path"], entry["details"], entry["imports"]) == ("app.py", ["main"], ["auth", "models"])
    names = spark.createDataFrame([("p", "MODELS"), ("p", "auth"), ("p", "User"), ("p", "src/mod"), ("p", "absent"), ("q", "models")], "project_id string, name string")
    got = {(r["project_id"], r["name"]): r for r in structure.dependency_answers(m, e, names).collect()}
    assert got["p", "MODELS"]["imported_by"] == ["app.py", "src/auth.py"] and got["p", "User"]["file_path"] == got["p", "src/mod"]["file_path"] == "src/models.py"
    assert got["p", "auth"]["imports_from"] == ["src/models.py"] and got["p", "auth"]["inherits_from"] == ["Base"] and got["p", "absent"]["file_path"] is None and got["q", "models"]["file_path"] is None
    o = {r["project_id"]: r for r in structure.overview(m, e).collect()}
    assert o["p"]["modules"] == 3 and o["p"]["dependencies"] == 4 and o["p"]["core_modules"][0] == "src/models.py 2" and o["p"]["entry_points"] == ["app.py"] and o["q"]["languages"] == ["1 ", "1 javascript"] and o["q"]["entry_points"] == []
    text = {r["project_id"]: r["summary"] for r in structure.summary_text(m, e).collect()}
    assert text["p"].startswith("3 modules (3 python), 3 classes, 3 functions") and "Most imported: models.py 2" in text["p"] and "Components: src: 2" in text["p"]
    asked = spark.createDataFrame([("p", "Where is the entry point?"), ("p", "Is it fast?"), ("z", "Where is the entry point?"), ("p", None)], "project_id string, question string")
    assert [(r["project_id"], r["route"]) for r in structure.gate(asked, m).collect()] == [("p", "entry_point")]
    none = m.limit(0)
    assert structure.overview(none, structure.all_edges(none)).count() == 0 and structure.entry_answers(none, structure.all_edges(none)).count() == 0


def test_archives_and_ignored_files(spark):
    raw = spark.createDataFrame([("p", "a/b.py", bytearray(b"print('hello')\n"), 15), ("p", "a/c.bin.py", bytearray(b"\0" * 40), 40), ("p", "a/d.py", bytearray("é = 'latin'".encode("latin-1") * 3), 33)], "project_id string, file_path string, bytes binary, length long")
    back = {r["file_path"]: bytes(r["bytes"]) for r in src.unpacked(src.archived(raw, "root").select("project_id", F.col("archive").alias("content"))).collect()}
    assert back == {r["file_path"]: bytes(r["bytes"]) for r in raw.collect()}
    bad = spark.createDataFrame([("p", bytearray(b"no archive"))], "project_id string, content binary")
    assert src.unpacked(bad).count() == 0
    t = {r["file_path"]: r for r in src.as_table(raw).collect()}
    assert set(t) == {"a/b.py", "a/d.py"} and t["a/b.py"]["encoding"] == "utf-8" and t["a/d.py"]["encoding"] != "utf-8"


def test_fusion_orders_by_the_sums_not_the_rounded_scores(spark):
    # 1/(60+100) + 1/(60+101) and 1/(60+99) + 1/(60+102) are equal to six places
    hits = [(1, 0, 100, "b", 0.5), (1, 1, 101, "b", 0.5), (1, 0, 99, "c", 0.5), (1, 1, 102, "c", 0.5), (1, 0, 98, "a", 0.1), (1, 1, 98, "z", 0.1)]
    df = spark.createDataFrame(hits, "query_id int, variant_no int, rank int, id string, similarity double")
    rows = {r["id"]: r for r in ranking.fuse(df, 10).collect()}
    want = sorted(("b", "c"), key=lambda i: -sum(1 / (r + 60) for _, _, r, x, _ in hits if x == i))
    assert sorted(("b", "c"), key=lambda i: rows[i]["position"]) == want
