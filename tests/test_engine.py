"""Index, query, reconcile and status over small trees."""

import json
import os
import subprocess

import pytest

from codelode import schema
from codelode.api import Engine, UnsafeRootError, check_root
from codelode.operators.search import FilterError
from codelode.sources.store import LockedError, Store

AUTH = 'def login(user, password):\n    """Authenticate a user and hand out a session token."""\n    return make_token(user)\n\n\ndef make_token(user):\n    return user\n\n\nclass Sessions:\n    def __init__(self):\n        self.open = {}\n\n    def revoke(self, token):\n        del self.open[token]\n'
DB = "def connect(url):\n    return url\n\n\nclass Connection:\n    def query(self, sql):\n        return sql\n"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg/auth.py").write_text(AUTH)
    (root / "pkg/db.py").write_text(DB)
    return root


@pytest.fixture
def engine(spark):
    return Engine(spark)


def names(engine, tree):
    return {(r["file_path"], r["symbol_name"]) for r in Store(engine.spark, tree / schema.INDEX_DIR).symbols().collect()}


def test_index_query_and_status(engine, tree):
    out = engine.index(tree)
    assert (out["indexed_files"], out["indexed_symbols"], out["dimension"]) == (2, 8, 64)
    found = engine.query("how is a user authenticated, login and password", root=tree, tokens=True)
    assert found["results"][0]["symbol_name"] in ("login", "make_token") and [r["rank"] for r in found["results"]] == [1, 2, 3]
    report = found["token_report"]
    assert report["snippet_tokens"] <= report["full_file_tokens"] and len(report["files"]) == len({r["file_path"] for r in found["results"]})
    assert all(r["kind"] == "class" for r in engine.query("sessions", root=tree, kind="class")["results"])
    assert engine.query("sessions", root=tree, top=0)["results"] == []
    status = engine.status(root=tree)
    assert (status["indexed_files"], status["indexed_symbols"], status["languages"], status["stale"], status["error"]) == (2, 8, ["python"], False, None)
    assert engine.index(tree)["indexed_symbols"] == 8 and len(names(engine, tree)) == 8


def test_missing_file_in_token_report(engine, tree):
    engine.index(tree)
    (tree / "pkg/auth.py").unlink()
    report = engine.query("login password", root=tree, top=1, filter="file_path = 'pkg/auth.py'", tokens=True)["token_report"]
    assert report["full_file_tokens"] == 0 and report["reduction_percent"] == 0.0 and report["unavailable_files"] == [{"file_path": "pkg/auth.py", "reason": "not_found"}]


def test_reconcile(engine, tree):
    engine.index(tree)
    (tree / "pkg/auth.py").write_text("def signin(user):\n    return user\n\n\nclass Sessions:\n    def revoke(self, token):\n        pass\n")
    out = engine.index(tree)
    assert out["deleted"] == 3 and {("pkg/auth.py", "signin"), ("pkg/auth.py", "Sessions.revoke"), ("pkg/db.py", "connect")} <= names(engine, tree)
    assert ("pkg/auth.py", "login") not in names(engine, tree)
    (tree / "pkg/auth.py").write_text("# nothing\n")
    (tree / "pkg/db.py").unlink()
    assert engine.index(tree)["indexed_files"] == 1 and names(engine, tree) == set()


def test_definitions_and_going_without_them(engine, tree):
    (tree / "guide.md").write_text("# Top\n## Sub\nx\n")
    (tree / "AGENTS.md").write_text("# no\n")
    assert engine.index(tree, definitions=True)["indexed_files"] == 3
    assert ("guide.md", "Top.Sub") in names(engine, tree) and not any(p == "AGENTS.md" for p, _ in names(engine, tree))
    engine.index(tree)
    assert not any(p == "guide.md" for p, _ in names(engine, tree))


def test_a_crlf_file_with_bad_bytes_and_a_getter_pair(engine, tree):
    (tree / "odd.py").write_bytes(b"class A:\r\n    @property\r\n    def x(self):\r\n        return '\xff'\r\n\r\n    @x.setter\r\n    def x(self, v):\r\n        pass\r\n")
    engine.index(tree)
    rows = [r for r in Store(engine.spark, tree / schema.INDEX_DIR).symbols().filter("file_path = 'odd.py'").collect()]
    assert {r["symbol_name"]: r["start_line"] for r in rows} == {"A": 1, "A.x": 3}  # the earliest of equal keys stays


def test_stale_conditions(engine, tree):
    engine.index(tree)
    store = Store(engine.spark, tree / schema.INDEX_DIR)
    past = os.stat(tree / "pkg/db.py").st_mtime
    (tree / "pkg/db.py").write_text(DB + "\n# edited\n")
    os.utime(tree / "pkg/db.py", (past, past))
    assert engine.is_stale(tree, store)  # content, though not newer
    engine.index(tree)
    (tree / "new.py").write_text("x = 1\n")
    os.utime(tree / "new.py", (past, past))
    assert engine.is_stale(tree, store)  # added
    engine.index(tree)
    assert not engine.is_stale(tree, store)
    (tree / "new.py").unlink()
    assert engine.is_stale(tree, store)  # deleted
    engine.index(tree)
    os.utime(tree / "pkg/db.py", (past + 9e6, past + 9e6))
    assert engine.is_stale(tree, store)  # newer


def test_filters_and_guards(engine, tree, tmp_path):
    for bad in ("symbol_name == 'x'", "lower(symbol_name) = 'x'", "id = 'x'", "kind IN (SELECT 1)", "kind = 'a'; drop", "(kind = 'a'"):
        with pytest.raises(FilterError):
            engine.query("x", tmp_path / "none", filter=bad)
    with pytest.raises(FilterError):
        engine.query("x", tmp_path / "none", kind="method")
    with pytest.raises(ValueError):
        engine.index(tree) and engine.query("x", root=tree, top=-1)
    with pytest.raises(UnsafeRootError):
        check_root(tmp_path, home=tmp_path / "me")
    assert check_root(tmp_path, force=True, home=tmp_path / "me") == tmp_path.resolve()


def test_status_of_missing_and_damaged(engine, tree):
    assert engine.status(root=tree) | {"db_path": ""} == {"exists": False, "db_path": "", "indexed_files": 0, "indexed_symbols": 0, "dimension": None, "languages": [], "last_indexed_at": None, "stale": None, "missing_grammars": [], "error": None}
    engine.index(tree)
    (tree / schema.INDEX_DIR / "CURRENT").write_text("what")
    status = engine.status(root=tree)
    assert status["exists"] and status["error"] and status["indexed_symbols"] is None
    assert engine.doctor(root=tree)["index"]["error"]


def test_a_second_writer_is_refused(engine, tree):
    store = Store(engine.spark, tree / schema.INDEX_DIR)
    store.db.mkdir()
    code = "import fcntl,sys,time; f=open(sys.argv[1],'w'); fcntl.flock(f,fcntl.LOCK_EX); print('held',flush=True); time.sleep(60)"
    other = subprocess.Popen(["python", "-c", code, str(store.db / ".write.lock")], stdout=subprocess.PIPE)
    try:
        other.stdout.readline()
        assert store.is_locked()
        with pytest.raises(LockedError):
            engine.index(tree)
    finally:
        other.kill()
        other.wait()
    assert not store.is_locked()


def test_missing_grammar_is_reported_and_not_indexed(spark, tree):
    (tree / "main.go").write_text("package x\nfunc A() {}\n")
    engine = Engine(spark, installed=frozenset({"python"}))
    assert engine.index(tree)["indexed_files"] == 2
    assert engine.status(root=tree)["missing_grammars"] == [{"language": "go", "extensions": [".go"], "file_count": 1, "install_hint": "pip install 'codelode[go]'"}]


def test_another_dimension_needs_a_reset(spark, engine, tree):
    from codelode.functions.embed import ModelEmbedder

    engine.index(tree)
    other = Engine(spark, ModelEmbedder(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], 2))
    with pytest.raises(ValueError):
        other.index(tree)
    assert other.index(tree, reset=True)["dimension"] == 2
    assert len(other.query("abc", root=tree)["results"]) == 3


def test_command_line(spark, tree, capsys, monkeypatch):
    from codelode import cli

    def run(*args):
        code = cli.main([str(a) for a in args], spark)
        out = capsys.readouterr().out
        return code, json.loads(out) if out else None

    assert run("--version")[1] == {"codelode": "0.1.0"}
    assert run("index", tree)[1]["indexed_symbols"] == 8
    assert run("query", "login", "--db", tree / schema.INDEX_DIR, "--root", tree, "-n", 2)[1]["results"][0]["symbol_name"] == "login"
    assert run("query", "login", "--db", tree / schema.INDEX_DIR, "--kind", "nope") == (2, None)
    assert run("query", "login", "--db", tree / "nothing") == (1, None)
    assert run("status", "--root", tree)[1]["stale"] is False
    assert run("doctor", "--root", tree)[1]["locks"]["serve"] == {"locked": False, "pid": None}
    monkeypatch.setenv("HOME", str(tree.parent / "home"))
    (tree / ".mcp.json").write_text('{"mcpServers": [], "kept": 1')
    assert run("init", tree, "--skip-index", "--harness", "nope") == (1, None)
    code, out = run("init", tree, "--auto-index", "--skip-index")
    hooks = json.loads((tree.parent / "home/.cursor/hooks.json").read_text())
    assert hooks["hooks"]["sessionStart"] == [{"command": "codelode hook session-start", "type": "command"}]
    assert out["mcp_config_changed"] and out["gitignore_changed"] and out["hook_changed"]
    code, out = run("init", tree, "--auto-index", "--skip-index")
    assert not (out["mcp_config_changed"] or out["gitignore_changed"] or out["hook_changed"])
    monkeypatch.chdir(tree / "pkg")
    assert run("hook", "session-start")[1]["status"] in ("skipped", "indexed")
    assert run("hook", "session-start")[1] == {"status": "skipped", "reason": "fresh"}


def test_init_in_odd_places(engine, tmp_path, monkeypatch, capsys):
    from codelode import bootstrap, cli

    monkeypatch.setenv("HOME", str(tmp_path))
    for text in ("{", "[]", '{"mcpServers": []}', '{"mcpServers": {"x": {}}, "y": 2}'):
        (tmp_path / ".mcp.json").write_text(text)
        out = bootstrap.init(engine, tmp_path, skip_index=True, harness="pi")
        known = json.loads((tmp_path / ".mcp.json").read_text())
        assert out["mcp_config_changed"] and known["mcpServers"]["codelode"]["directTools"] and out["harness"]["name"] == "pi"
    assert set(known) == {"mcpServers", "y"} and set(known["mcpServers"]) == {"x", "codelode"}
    with pytest.raises(UnsafeRootError):
        bootstrap.init(engine, tmp_path)
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / bootstrap.MARKER).write_text("")
    (tmp_path / "w" / "a.py").write_text("def f():\n    pass\n")
    monkeypatch.chdir(tmp_path / "w")
    assert cli.main(["hook", "session-start"], engine.spark) == 0 and json.loads(capsys.readouterr().out)["index"]["indexed_symbols"] == 1
    assert bootstrap.session_start(lambda: 1 / 0, tmp_path / "w")["status"] == "error"
    assert cli.main(["index", str(tmp_path / "w"), "--model", "none/such"], engine.spark) == 1


def test_index_time_falls_back_to_the_files(engine, tree):
    engine.index(tree)
    path = tree / schema.INDEX_DIR / "metadata.json"
    known = json.loads(path.read_text())
    del known["indexed_at"]
    path.write_text(json.dumps(known))
    status = engine.status(root=tree)
    assert status["stale"] is False and abs(status["last_indexed_at"] - path.stat().st_mtime) < 60


def test_what_is_skipped_is_not_opened(spark, engine, tree):
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "2000")
    try:
        for name in ("node_modules/[x]/big.py", "pkg/[odd]{1}/small.py"):
            (tree / name).parent.mkdir(parents=True)
            (tree / name).write_text("def inner():\n    pass\n" + ("#" * 5000 if "big" in name else ""))
        (tree / "pkg/big.bin").write_bytes(b"x" * 9000)
        assert engine.index(tree)["indexed_files"] == 3
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    with pytest.raises(ValueError):
        Store(spark, "hdfs://here/there")


def test_server_answers(engine, tree):
    from codelode.server import answer, tools

    known = tools(engine, str(tree / schema.INDEX_DIR))
    call = lambda name, **a: answer({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": a}}, known)["result"]
    assert call("query_context", query="x")["isError"]
    assert json.loads(call("index_codebase", path=str(tree))["content"][0]["text"])["indexed_files"] == 2
    assert len(json.loads(call("query_context", query="login", top=2)["content"][0]["text"])) == 2
    assert json.loads(call("index_status")["content"][0]["text"])["indexed_symbols"] == 8
    assert len(answer({"id": 2, "method": "tools/list"}, known)["result"]["tools"]) == 3 and answer({"method": "x"}, known) is None


def test_stream_of_changed_files(spark, tmp_path):
    from codelode.operators import sections
    from codelode.streaming import reindex

    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    extract = reindex.extract_with_ids(sections.markdown_sections)

    def drop(name, rows):
        (folder / name).write_text("\n".join(json.dumps(r) for r in rows))
        reindex.start(spark, str(folder), target, str(tmp_path / "cp"), extract).awaitTermination()

    def names_of():
        return {r["symbol_name"] for r in reindex.read(spark, target).collect()}

    drop("1.json", [{"rel": "a.md", "text": "# A\n", "seq": 1}, {"rel": "b.md", "text": "# B\n", "seq": 1}, {"rel": "b.md", "text": "# B2\n", "seq": 2}])
    assert names_of() == {"A", "B2"}
    drop("2.json", [{"rel": "a.md", "text": None, "seq": 3}, {"rel": "c.md", "text": "# C\n", "seq": 3}])
    assert names_of() == {"B2", "C"}
    reindex.start(spark, str(folder), target, str(tmp_path / "another checkpoint"), extract).awaitTermination()
    assert names_of() == {"B2", "C"}
    untouched = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "out").glob("part=*/*.parquet")}
    drop("3.json", [{"rel": "c.md", "text": "# C2\n## D\n", "seq": 4}, {"rel": None, "text": "# no\n", "seq": 4}])
    assert names_of() == {"B2", "C2", "C2.D"}
    after = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "out").glob("part=*/*.parquet")}
    assert len(after.keys() - untouched.keys()) == 1 and all(after[k] == v for k, v in untouched.items() if k in after)  # one part is new
    drop("4.json", [{"rel": r, "text": None, "seq": 5} for r in ("b.md", "c.md")])
    assert names_of() == set()


def test_scan_filters(spark, tmp_path):
    from codelode.sources import scan

    root = tmp_path / "build" / "repo"
    for name in ("a.py", "vendor/b.py", "node_modules/c.py", "döc é.py", "x/knowledge/d.py", "knowledge/e.py", "kept.py", "a b%20c.py"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x = 1\n")
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    (root / ".gitignore").write_text("vendor/\nkept.py\n")
    (root / schema.IGNORE_FILE).write_text("/knowledge/\n")
    subprocess.run(["git", "-C", str(root), "add", "-f", "kept.py"], check=True)
    rels = {r[0] for r in scan.candidates(spark, str(root), {".py"}).select("rel").collect()}
    assert rels == {"a.py", "döc é.py", "x/knowledge/d.py", "kept.py", "a b%20c.py"}  # a tracked file is not ignored by git


def test_layout_gives_the_same_hits(spark, engine, tree):
    """With the layout the pool comes from lists; hits are the same, filters do without it, a new snapshot drops it."""
    from codelode.operators import vectors

    for k in range(60):
        (tree / f"m{k}.py").write_text(f"def fetch_{k}(x):\n    return row_{k % 7}(x)\n\n\nclass Store{k}:\n    pass\n")
    engine.index(tree)
    store = Store(spark, tree / schema.INDEX_DIR)
    ask = lambda **o: engine.query("fetch a row of the store", root=tree, top=5, **o)["results"]
    before, filtered = ask(), ask(kind="class")
    assert store.nearest([1.0] * 64, 3) is None
    told = engine.optimize(root=tree)
    assert told["rows"] == 128 and told["lists"] == 1
    assert ask() == before and ask(kind="class") == filtered
    assert store.nearest([1.0] * 64, 3).count() == 3 and vectors.read_lists(spark, store._path("vectors", store.version())).rows.sum() == 128
    (tree / "m1.py").write_text("def other():\n    pass\n")
    engine.index(tree)
    assert store.nearest([1.0] * 64, 3) is None and "fetch_1" not in {h["symbol_name"] for h in ask(candidates=200)}


def test_summary_is_kept_with_the_snapshot(spark, engine, tree, monkeypatch):
    """Status reads no symbols; counts are exact, and names are estimated."""
    for k in range(300):
        (tree / f"n{k}.py").write_text("".join(f"def name_{k}_{j}():\n    pass\n" for j in range(5)))
    engine.index(tree)
    store = Store(spark, tree / schema.INDEX_DIR)
    exact = store.symbols().selectExpr("count(*)", "count(DISTINCT file_path)", "count(DISTINCT symbol_name)").first()
    monkeypatch.setattr(Store, "symbols", lambda self: pytest.fail("symbols are read"))
    row = store.summary().first()
    assert (row["documents"], row["files"], row["languages"]) == (exact[0], exact[1], "python") and abs(row["names"] - exact[2]) <= 0.03 * exact[2]
    monkeypatch.setattr(Store, "dimension", lambda self: 64)
    assert engine.status(root=tree)["indexed_symbols"] == exact[0]


def test_lookup_of_files_skips_row_groups(spark, engine, tree):
    """Few paths reach Parquet as filters, which statistics and Bloom filters answer; many are joined."""
    from codelode.sources import store as store_module

    engine.index(tree)
    store = Store(spark, tree / schema.INDEX_DIR)
    paths = spark.createDataFrame([("pkg/auth.py",), ("pkg/none.py",), ("pkg/auth.py",)], "file_path string")
    found = store.of_files(paths)
    assert "In(file_path" in found._jdf.queryExecution().executedPlan().toString() and found.count() == 5
    store_module.NAMED, kept = 1, store_module.NAMED
    try:
        joined = store.of_files(paths)
        assert "LeftSemi" in joined._jdf.queryExecution().executedPlan().toString() and sorted(joined.collect()) == sorted(found.collect())
    finally:
        store_module.NAMED = kept
    import pyarrow.parquet as pq

    part = next((tree / schema.INDEX_DIR).glob("symbols-v*/language=python/*.parquet"))
    columns = pq.ParquetFile(part).metadata.row_group(0)
    assert {columns.column(k).path_in_schema for k in range(columns.num_columns)} >= {"id", "file_path"}
    raw = part.read_bytes()
    assert len(raw) > 0 and pq.read_table(part).num_rows == store.symbols().count()


def test_only_candidates_are_read(spark, tmp_path, monkeypatch):
    """Tasks list a folder each; what git ignores is dropped before it is opened, as an unreadable file would show."""
    from codelode.sources import scan

    root = tmp_path / "tree"
    for path in ("a/x.py", "a/deep/er/y.PY", "b/z.py", "b/no.txt", "node_modules/m.py", "top.py", "ignored/secret.py", "a/dist/gone.py"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text("x = 1\n")
    (root / ".gitignore").write_text("ignored/\n")
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    (root / "b/link.py").symlink_to(root / "top.py")
    (root / "b/broken.py").symlink_to(root / "nowhere.py")
    want = {"a/x.py", "a/deep/er/y.PY", "b/z.py", "b/link.py", "top.py"}
    listed = scan.candidates(spark, str(root), {".py"})
    assert {r["rel"] for r in listed.collect()} == want and all(r["size"] == 6 and r["mtime"] > 0 for r in listed.collect())
    monkeypatch.setattr(scan, "READ_BYTES", 7)
    read = scan.candidates(spark, str(root), {".py"}, content=True)
    assert read._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 3  # listing, git, reading: contents come last
    assert {r["rel"]: bytes(r["content"]) for r in read.collect()} == dict.fromkeys(want, b"x = 1\n")
    assert {r["rel"] for r in scan.list_files(spark, str(root), ignore=("deep",)).collect()} >= {"b/no.txt", "top.py"} - {"a/deep/er/y.PY"}


def test_serve_refuses_while_an_index_is_written(spark, tree, capsys):
    from codelode import cli

    held = Store(spark, tree / schema.INDEX_DIR)
    held.db.mkdir()
    code = "import fcntl,sys,time; f=open(sys.argv[1],'w'); fcntl.flock(f,fcntl.LOCK_EX); print('held',flush=True); time.sleep(60)"
    other = subprocess.Popen(["python", "-c", code, str(held.db / ".write.lock")], stdout=subprocess.PIPE)
    try:
        other.stdout.readline()
        assert cli.main(["serve", "--db", str(held.db)], spark) == 1
    finally:
        other.kill()
        other.wait()
    out = capsys.readouterr()
    assert out.out == "" and "already open" in out.err


def test_doctor_and_harness_tell_what_is_missing(engine, tree, tmp_path, monkeypatch):
    from codelode import bootstrap

    engine.index(tree)
    report = engine.doctor(root=tree)
    assert report["install"]["packages"]["pyspark"]["installed"] and report["install"]["packages"]["sentence-transformers"] == {"installed": False, "version": None}
    assert report["install"]["python_version"].startswith("3.") and report["locks"]["index"] == {"readable": True, "locked": False, "error": None}
    monkeypatch.setattr(bootstrap.shutil, "which", lambda _: None)
    monkeypatch.setenv("PI_CODING_AGENT_DIR", str(tmp_path / "agent"))
    lacking = bootstrap.harness_report(tree, "pi")
    assert [lacking["requirements"][k]["installed"] for k in ("pi", "pi_mcp_adapter")] == [False, False]
    assert lacking["requirements"]["pi_mcp_adapter"]["install_hint"] == "pi install npm:pi-mcp-adapter" and len(lacking["guidance"]) == 3
    (tmp_path / "agent/npm/node_modules/pi-mcp-adapter").mkdir(parents=True)
    monkeypatch.setattr(bootstrap.shutil, "which", lambda _: "/usr/bin/pi")
    there = bootstrap.harness_report(tree, "pi")
    assert there["requirements"]["pi"]["executable"] == "/usr/bin/pi" and len(there["guidance"]) == 1 and bootstrap.harness_report(tree, None) is None


def test_named_models_are_loaded_by_workers(spark, tree, tmp_path, monkeypatch):
    """A module in place of the library: it is asked for its dimension, and embeds in batches on the workers."""
    from codelode.functions import embed

    (tmp_path / "sentence_transformers.py").write_text(
        "import numpy as np\nclass SentenceTransformer:\n    def __init__(self, name):\n        assert name == 'tiny'\n    def get_sentence_embedding_dimension(self):\n        return 3\n"
        "    def encode(self, texts, batch_size, **options):\n        assert batch_size == 2 and options['normalize_embeddings']\n        return np.array([[len(t), t.count('a'), 1.0] for t in texts])\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "sentence_transformers.py"))
    own = Engine(spark, embed.named_model("tiny", 2))
    assert own.index(tree)["dimension"] == 3 and len(own.query("login", root=tree)["results"]) == 3
    with pytest.raises(ValueError, match="at least one"):
        embed.named_model("tiny", 0)
