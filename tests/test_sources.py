"""Tree walking, project settings, diffs, test runs, stored facts, streams and envelopes."""

import shutil
import subprocess
import sys

import pytest

from lodeweave.functions.envelope import Envelope
from lodeweave.plans.engine import Engine
from lodeweave.plans.facts import facts
from lodeweave.sources import ledger, store, tree
from lodeweave.sources.diff import changed_lines
from lodeweave.streaming.snapshots import current_facts, stream_facts


def put(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_tree_scan(spark, tmp_path):
    put(tmp_path, {
        "a.py": "x = 1\n", "b.pyi": "x: int\n", "c.txt": "", "pkg/__init__.py": "", "pkg/d.py": "é = 1\n", ".hidden/e.py": "", "build/f.py": "", "pkg/gen_g.py": "", "pkg/gen_keep.py": "", "bad.py": b"\xff\xfe",
        ".gitignore": "/build/\ngen_*\n!gen_keep.py\n", "pkg/.gitignore": "d2.py\n", "pkg/d2.py": "", "d2.py": "",
    })
    rows = {r["path"]: r for r in tree.read_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.py", "b.pyi", "pkg/__init__.py", "pkg/d.py", "pkg/gen_keep.py", "d2.py"}
    assert rows["pkg/d.py"]["text"] == "é = 1\n" and rows["pkg/d.py"]["size"] == 7 and len(rows["a.py"]["sha"]) == 64


def test_project_settings(tmp_path):
    assert tree.source_roots(str(tmp_path)) == [] and tree.console_targets(str(tmp_path)) == []
    put(tmp_path, {"pyproject.toml": '[project.scripts]\nrun = "app.cli:main"\nbad = "nothing"\n[tool.poetry.scripts]\nx = "m:o.a"\n[tool.pytest.ini_options]\npythonpath = [".", "src", "./lib/"]\n'})
    assert tree.source_roots(str(tmp_path)) == ["src", "lib"] and tree.console_targets(str(tmp_path)) == ["app.cli.main", "m.o.a"]
    put(tmp_path, {"pyproject.toml": "broken ["})
    assert tree.source_roots(str(tmp_path)) == []


def test_diff(spark, tmp_path):
    lines = "--- a/x.py\n+++ b/x.py\n@@ -1 +1,2 @@\n+a\n+b\n@@ -9,3 +10,0 @@ def f\n-q\n--- a/y.py\n+++ /dev/null\n@@ -1,2 +0,0 @@\n--- a/z.py\n+++ b/z.py\n@@ -0,0 +5 @@\n+z".split("\n")
    assert {(r["path"], r["line"]) for r in changed_lines(spark, lines).collect()} == {("x.py", 1), ("x.py", 2), ("x.py", 10), ("z.py", 5)}
    assert changed_lines(spark, ["nothing"]).collect() == []
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    put(tmp_path, {"pkg/ops.py": "def f():\n    return 1\n"})
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "x")
    put(tmp_path, {"pkg/ops.py": "def f():\n    x = 1\n    return x\n"})
    assert {(r["path"], r["line"]) for r in changed_lines(spark, tree.git_diff(str(tmp_path), "HEAD")).collect()} == {("pkg/ops.py", 2), ("pkg/ops.py", 3)}
    with pytest.raises(ValueError):
        tree.git_diff(str(tmp_path), "no-such-ref")


SUITE = {
    "pkg/__init__.py": "",
    "pkg/ops.py": "import os\nimport socket\nimport subprocess\n\n\ndef read():\n    return open(os.devnull)\n\n\ndef spawn(run):\n    return getattr(subprocess, run)(['true'])\n\n\ndef ping():\n    return socket.create_connection(('x', 1))\n\n\ndef home():\n    return os.getenv('HOME')\n\n\ndef add(a, b):\n    return a + b\n",
    "test_ops.py": "from pkg import ops\n\n\ndef test_all():\n    ops.read().close()\n    ops.spawn('call')\n    ops.home()\n    assert ops.add(1, 2) == 3 and ops.add(1.0, 2) == 3\n",
}


def test_instrumented_run_and_fusion(spark, tmp_path):
    put(tmp_path, SUITE)
    run = ledger.run_suite(spark, str(tmp_path))
    assert run.exit_code == 0 and run.warnings == []
    seen = {(r["owner_fqn"], r["category"]) for r in run.effects.collect()}
    assert {("pkg.ops.read", "fs"), ("pkg.ops.spawn", "subprocess")} <= seen and not any(o == "pkg.ops.add" for o, _ in seen)
    e = Engine.of_tree(spark, str(tmp_path))
    fused = {(r["owner"], r["category"]): r["confidence"] for r in e.effects(None, run.effects).collect()}
    assert fused["pkg.ops.read", "fs"] == "confirmed" and fused["pkg.ops.spawn", "subprocess"] == "observed" and fused["pkg.ops.ping", "network"] == "predicted" and fused["pkg.ops.home", "env"] == "unverifiable"
    if sys.version_info >= (3, 12):
        assert ("test_ops.py::test_all", "pkg/ops.py", 7) in {tuple(r) for r in run.coverage.collect()}
        assert {r["type_label"] for r in run.shapes.where("fqn = 'pkg.ops.add'").collect()} == {"int", "float"}
        assert e.describe("ops.add", run.shapes).first()["observed_return"] == "float | int"


def test_stored_test_run(spark, tmp_path):
    root, folder = tmp_path / "src", str(tmp_path / "store")
    put(root, SUITE)
    shown = lambda run: [snapshot(t) for t in (run.events, run.coverage, run.shapes) if t is not None]
    first = ledger.stored_run(spark, str(root), folder, "one")
    assert first.exit_code == 0 and first.warnings == [] and shown(first)
    (root / "test_ops.py").unlink()
    again = ledger.stored_run(spark, str(root), folder, "one")
    assert shown(again) == shown(first) and again.exit_code == 0
    # Another state of the tree is run, and replaces the stored run.
    other = ledger.stored_run(spark, str(root), folder, "two")
    assert other.exit_code == 5 and other.events.where("owner_fqn = 'pkg.ops.read'").isEmpty()
    assert ledger.stored_run(spark, str(root), folder, "one").exit_code == 5
    # What ended without a result isn't stored.
    assert ledger.stored_run(spark, str(root), folder, "three", python="/no/such/python").warnings
    put(root, SUITE)
    assert ledger.stored_run(spark, str(root), folder, "three").exit_code == 0


def test_trace_verb(spark, tmp_path, capsys, monkeypatch):
    import json

    from lodeweave.__main__ import main

    put(tmp_path, SUITE)
    monkeypatch.setenv("LODEWEAVE_MASTER", "local[4]")
    assert main(["trace", "test_ops.py", "--root", str(tmp_path), "--json", "-k", "all"]) == 0
    out = json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    assert out["query"]["arguments"] == ["test_ops.py", "-k", "all"] and out["count"] == len(out["results"]) > 0
    rows = [(r["owner_fqn"], r.get("effect", ""), r["event"]) for r in out["results"]]
    assert rows == sorted(rows) and ("pkg.ops.read", "fs", "open") in rows and all(r["hits"] > 0 for r in out["results"])
    with pytest.raises(SystemExit):
        main(["deadcode", "--no-such-option"])


def test_trace_of_a_script(tmp_path):
    import json
    import os

    from lodeweave.sources import trace_plugin

    put(tmp_path, {"job.py": "def work():\n    open('out.txt', 'w').close()\n\n\nif __name__ == '__main__':\n    work()\n    raise SystemExit(3)\n"})
    env = os.environ | {"LODEWEAVE_TRACE_ROOT": str(tmp_path)}
    done = subprocess.run([sys.executable, trace_plugin.__file__, "--script", "job.py", "--out", "t.json"], cwd=tmp_path, env=env, check=False)
    found = json.loads((tmp_path / "t.json").read_text())
    assert done.returncode == 3 == found["pytest_exit"] and ("job.work", "open") in {(r["owner_fqn"], r["event"]) for r in found["rows"]}


def test_run_that_cannot_be(spark, tmp_path):
    run = ledger.run_suite(spark, str(tmp_path), python="/no/such/python")
    assert run.effects is None and run.warnings
    broken = ledger.read_run(spark, {"EFFECTS": "{", "COVERAGE": '{"available": false}'})
    assert broken.effects is None and broken.coverage is None and len(broken.warnings) == 3


def snapshot(df):
    return sorted(map(str, df.collect()))


def test_stored_facts_are_repaired(spark, tmp_path):
    root, folder = tmp_path / "src", str(tmp_path / "store")
    put(root, {"a.py": "def f():\n    pass\n", "b.py": "import a\n", "c.py": "x = 1\n"})

    def both():
        files = tree.read_tree(spark, str(root))
        stored, changed = store.refresh(spark, files, folder)
        assert snapshot(stored) == snapshot(facts(files))
        return {r["path"] for r in changed.collect()}, store.fingerprint(files)

    first, print1 = both()
    assert first == {"a.py", "b.py", "c.py"}
    assert both() == (set(), print1)
    put(root, {"a.py": "def g():\n    f()\n", "d.py": "import b\n"})
    (root / "c.py").unlink()
    second, print2 = both()
    assert second == {"a.py", "c.py", "d.py"} and print2 != print1
    assert {r["fqn"] for r in store.engine(spark, str(root), folder).defs.where("kind = 'function'").collect()} == {"a.g"}
    # A generation that wasn't written to the end is passed over and written again.
    home = next((tmp_path / "store").glob("v*"))
    assert {p.name for p in home.glob("g*")} == {"g3", "g4"}
    (home / "g4" / "DONE").unlink()
    shutil.rmtree(home / "g4" / "facts")
    assert both() == (set(), print2) and (home / "g4" / "DONE").exists()
    store.clean(spark, folder)
    assert both()[0] == {"a.py", "b.py", "d.py"}


def test_stream_of_snapshots(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "facts")
    schema = "path string, text string, version long"
    for rows in ([("a.py", "def f():\n    pass\n", 1), ("b.py", "y = 1\n", 1)], [("a.py", "def g():\n    pass\n", 2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream_facts(spark.readStream.schema(schema).parquet(source), table, str(tmp_path / "cp")).awaitTermination(120)
    now = current_facts(spark.read.parquet(table)).where("fact = 'defs'")
    assert {(r["path"], r["name"]) for r in now.collect()} == {("a.py", "g"), ("b.py", "y")}


def test_envelope(spark):
    df = spark.createDataFrame([("definition", "a.py:1:1", "a.f", 0), ("caller", "b.py:10:1", "b.g", 1), ("caller", "b.py:2:1", "b.hh", 1)], "section string, loc string, fqn string, depth int")
    e = Envelope.of("lodeweave", {"verb": "describe"}, df, "row", warnings=["careful"])
    assert e.to_dict()["count"] == 3 and "notes" not in e.to_dict() and '"summary": "3 rows"' in e.json()
    assert e.text() == "3 rows\n\ndefinition (1)\n  a.py:1:1  a.f  0\n\ncaller (2)\n  b.py:10:1  b.g   1\n  b.py:2:1   b.hh  1\n⚠ careful"
    assert Envelope.of("x", {}, df.limit(0)).text() == "0 results"
