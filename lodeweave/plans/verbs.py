"""The verbs as registered queries over two small source trees, each with its answer in SQL.

The driver's tables hold no Python sources, so these read the trees of
``sample_trees``; the data folder is not used.  The answers were worked out
by hand from the trees.  The queries of one session share one engine a tree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.operators.fusion import counts_by
from lodeweave.plans.engine import Engine
from lodeweave.plans.sample_trees import APP, SAMPLE

_engines: dict[tuple[str, int], Engine] = {}


def _engine(spark: SparkSession, files: dict[str, str]) -> Engine:
    key = (spark.sparkContext.applicationId, id(files))
    if key not in _engines:
        for old in [k for k in _engines if k[0] != key[0]]:
            del _engines[old]
        _engines[key] = Engine(spark, spark.createDataFrame(list(files.items()), "path string, text string"))
    return _engines[key]


def _observed(e: Engine) -> DataFrame:
    rows = [("io_ops.fetch", "network"), ("io_ops.pure", "subprocess"), ("io_ops.pure", "import")]
    return e.effects(None, e.spark.createDataFrame(rows, "owner_fqn string, category string"))


def _shapes(e: Engine) -> DataFrame:
    return e.spark.createDataFrame([("chain.c", "int"), ("chain.c", "float"), ("chain.c", "int")], "fqn string, type_label string")


def _coverage(e: Engine) -> DataFrame:
    changed = e.spark.createDataFrame([("pkg/ops.py", 2), ("pkg/ops.py", 6), ("pkg/ops.py", 2), ("new.py", 1)], "path string, line int")
    ran = e.spark.createDataFrame([("t.py::test_b", "pkg/ops.py", 2), ("t.py::test_a", "pkg/ops.py", 2), ("t.py::test_a", "pkg/ops.py", 3)], "nodeid string, path string, line int")
    return e.change_coverage(changed, ran).withColumn("tests", F.array_join("tests", ","))


def _changed(e: Engine, *paths: str) -> DataFrame:
    return e.spark.createDataFrame([(p,) for p in paths], "path string")


def _values(columns: str, rows: list[tuple]) -> str:
    def spelled(value) -> str:
        if value is None:
            return "NULL"
        return f"'{value}'" if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)

    names = columns.split()
    body = ", ".join("(" + ", ".join(spelled(v) for v in row) + ")" for row in rows)
    return f"SELECT {', '.join(names)} FROM (VALUES {body}) AS t({', '.join(names)})"


#: name: (tree, verb, columns, rows)
_VERBS: dict[str, tuple[dict, Callable[[Engine], DataFrame], str, list[tuple]]] = {
    "defs": (SAMPLE, lambda e: e.defs_of("make_user"), "loc kind role resolves_to", [
        ("app.py:1:30", "import", "binding", "pkg/models.py:6:5"), ("pkg/models.py:6:5", "function", "definition", None)]),
    "defs_scoped": (SAMPLE, lambda e: e.defs_of("models.User").union(e.defs_of("Nope.User")), "loc kind role", [("pkg/models.py:1:7", "class", "definition")]),
    "refs": (SAMPLE, lambda e: e.refs("make_user"), "loc kind role", [
        ("alias.py:1:24", "import", "binding"), ("alias.py:5:5", "call", "reference"), ("alias.py:6:5", "call", "reference"), ("app.py:1:30", "import", "binding"), ("app.py:5:9", "call", "reference"),
        ("pkg/models.py:6:5", "function", "definition")]),
    "callers": (SAMPLE, lambda e: e.callers("make_user"), "loc kind role caller", [
        ("alias.py:5:5", "function", "call", "alias.twice"), ("alias.py:6:5", "function", "call", "alias.twice"), ("app.py:5:9", "function", "call", "app.main")]),
    "callers_of_two": (SAMPLE, lambda e: e.callers("process"), "loc resolves_to caller", [("same.py:12:7", "same.py:2:9", "same.run"), ("same.py:13:7", "same.py:7:9", "same.run")]),
    "graph": (SAMPLE, lambda e: e.graph("chain.a"), "fqn path line col kind depth via", [
        ("chain.b", "chain.py", 5, 5, "function", 1, "chain.a"), ("chain.c", "chain.py", 9, 5, "function", 2, "chain.b")]),
    "graph_depth": (SAMPLE, lambda e: e.graph("chain.a", depth=1).union(e.graph("recur")), "fqn depth", [("chain.b", 1)]),
    "graph_reverse": (SAMPLE, lambda e: e.graph("User", reverse=True), "fqn kind depth via", [
        ("app.main", "function", 1, "pkg.models.User"), ("pkg.models.make_user", "function", 1, "pkg.models.User"), ("alias.twice", "function", 2, "pkg.models.make_user"), ("app", "module", 2, "app.main")]),
    "graph_property": (SAMPLE, lambda e: e.graph("prop.choices", reverse=True), "fqn kind depth", [("prop.Doc.label", "property", 1), ("views.render", "function", 2)]),
    "tests": (SAMPLE, lambda e: e.tests("chain.c"), "fqn depth", [("test_calc.test_c", 1)]),
    "tests_by_method": (APP, lambda e: e.tests("live_helper"), "fqn depth", [("tests.test_app.TestX.test_one", 2)]),
    "describe": (SAMPLE, lambda e: e.describe("chain.c", _shapes(e)), "section fqn loc kind depth detail observed_return", [
        ("definition", "chain.c", "chain.py:9:5", "function", 0, "()", "float | int"), ("caller", "chain.b", "chain.py:5:5", "function", 1, None, None),
        ("caller", "test_calc.helper_not_test", "test_calc.py:10:5", "function", 1, None, None), ("caller", "test_calc.test_c", "test_calc.py:6:5", "function", 1, None, None),
        ("test", "test_calc.test_c", "test_calc.py:6:5", "function", 1, None, None)]),
    "inputs": (APP, lambda e: e.inputs(), "path kind value line col", [("app/settings.py", "env", "X", 2, 5), ("app/settings.py", "env", "Y", 3, 5)]),
    "inputs_of_file": (APP, lambda e: e.inputs("backfill").union(e.inputs("unknown")), "path kind value line", [
        ("app/management/commands/backfill.py", "env", "BACKFILL_TOKEN", 2), ("app/management/commands/backfill.py", "arg", "--dry-run", 7)]),
    "input_scripts": (APP, lambda e: e.input_scripts(), "path", [("app/management/commands/backfill.py",)]),
    "hierarchy": (SAMPLE, lambda e: e.hierarchy("Dog"), "section rank fqn method", [
        ("supertype", 1, "animals.Animal", None), ("external", 0, "ABC", None), ("subtype", 1, "animals.Puppy", None), ("overrides", 0, "animals.Animal.speak", "speak"), ("overridden-by", 0, "animals.Puppy.speak", "speak")]),
    "deadcode": (APP, lambda e: e.deadcode(), "fqn path line kind", [
        ("a2.two", "a2.py", 4, "function"), ("app.client.Client", "app/client.py", 6, "class"), ("app.core.truly_dead", "app/core.py", 12, "function"), ("app.core.orphan_helper", "app/core.py", 16, "function"),
        ("app.shapes.Circle", "app/shapes.py", 6, "class")]),
    "caveat": (APP, lambda e: e.dispatch_caveat("get_label").union(e.dispatch_caveat("registered")).union(e.dispatch_caveat("orphan_helper")), "fqn why", [
        ("app.serial.WidgetSerializer.get_label", "framework-base"), ("app.core.registered", "framework-entry")]),
    "canonical": (APP, lambda e: e.canonical(), "section fqn loc uses markers", [
        ("most-used", "app.core.live_helper", "app/core.py:8:5", 3, None), ("untested", "a2.two", "a2.py:4:5", None, None), ("untested", "app.client.Client", "app/client.py:6:7", None, None),
        ("untested", "app.core.truly_dead", "app/core.py:12:5", None, None), ("untested", "app.core.orphan_helper", "app/core.py:16:5", None, None), ("untested", "app.core.exported", "app/core.py:4:5", None, None),
        ("untested", "app.shapes.Circle", "app/shapes.py:6:7", None, None),
        ("test", "tests.test_app.TestX.test_one", "tests/test_app.py:9:9", None, "django_db,parametrize"), ("test", "tests.test_app.test_p", "tests/test_app.py:13:5", None, "")]),
    "imports": (SAMPLE, lambda e: e.imports(), "importer importer_file target line col internal context", [
        ("alias", "alias.py", "pkg.models", 1, 1, True, "top-level"), ("animals", "animals.py", "abc", 1, 1, False, "top-level"), ("app", "app.py", "pkg.models", 1, 1, True, "top-level"),
        ("config", "config.py", "os", 1, 1, False, "top-level"), ("config", "config.py", "pkg.models", 2, 1, True, "top-level"), ("cyc.a", "cyc/a.py", "cyc.b", 1, 1, True, "top-level"),
        ("cyc.b", "cyc/b.py", "cyc.a", 1, 1, True, "top-level"), ("cyc.t", "cyc/t.py", "typing", 1, 1, False, "top-level"), ("cyc.t", "cyc/t.py", "cyc.u", 3, 5, True, "type-checking"),
        ("cyc.u", "cyc/u.py", "cyc.t", 1, 1, True, "top-level"), ("io_ops", "io_ops.py", "os", 1, 1, False, "top-level"), ("io_ops", "io_ops.py", "random", 2, 1, False, "top-level"),
        ("io_ops", "io_ops.py", "requests", 3, 1, False, "top-level"), ("pipeline", "pipeline.py", "io_ops", 1, 1, True, "top-level"), ("test_calc", "test_calc.py", "chain", 1, 1, True, "top-level"),
        ("test_calc", "test_calc.py", "pytest", 2, 1, False, "top-level"), ("views", "views.py", "prop", 1, 1, True, "top-level")]),
    "imports_reverse": (SAMPLE, lambda e: e.imports("pkg.models", reverse=True), "importer line", [("alias", 1), ("app", 1), ("config", 2)]),
    "import_cycles": (SAMPLE, lambda e: e.import_cycles().withColumn("path", F.array_join("path", " ")), "component size path", [("cyc.a", 2, "cyc.a cyc.b")]),
    "effects": (SAMPLE, lambda e: e.effects(), "owner category api loc import_time confidence", [
        ("io_ops.fetch", "network", "requests.get", "io_ops.py:7:12", False, "predicted"), ("config", "env", "os.getenv", "config.py:3:5", True, "unverifiable"),
        ("io_ops.remember", "global", "STATE", "io_ops.py:15:5", False, "unverifiable"), ("io_ops.jitter", "random", "random.random", "io_ops.py:11:12", False, "unverifiable")]),
    "effects_of": (SAMPLE, lambda e: e.effects("run_all").union(e.effects("pure")), "owner category api", [("io_ops.fetch", "network", "requests.get"), ("io_ops.jitter", "random", "random.random")]),
    "effects_fused": (SAMPLE, _observed, "owner category api confidence", [
        ("io_ops.fetch", "network", "requests.get", "confirmed"), ("io_ops.pure", "subprocess", None, "observed"), ("config", "env", "os.getenv", "unverifiable"),
        ("io_ops.remember", "global", "STATE", "unverifiable"), ("io_ops.jitter", "random", "random.random", "unverifiable")]),
    "effect_counts": (SAMPLE, lambda e: counts_by(_observed(e), "confidence", "category").withColumn("category", F.array_join("category", ",")), "confidence n category", [
        ("confirmed", 1, "network"), ("observed", 1, "subprocess"), ("unverifiable", 3, "env,global,random")]),
    "change_coverage": (SAMPLE, _coverage, "path line status tests", [("pkg/ops.py", 2, "covered", "t.py::test_a,t.py::test_b"), ("pkg/ops.py", 6, "uncovered", ""), ("new.py", 1, "uncovered", "")]),
    "mock_targets": (APP, lambda e: e.mock_targets(), "target loc verdict", [
        ("app.client.requests", "tests/test_app.py:14:5", "valid"), ("app.client.Client.fetch", "tests/test_app.py:15:5", "valid"), ("app.client.helper", "tests/test_app.py:16:5", "valid"),
        ("app.client.open", "tests/test_app.py:17:5", "valid"), ("app.client.deleted_fn", "tests/test_app.py:18:5", "drifted"), ("app.client.Client.gone", "tests/test_app.py:19:5", "drifted"),
        ("os.path.exists", "tests/test_app.py:20:5", "external"), ("app.client.requests.get", "tests/test_app.py:21:5", "unverifiable"), ("app.client.Account.injected", "tests/test_app.py:22:5", "unverifiable"),
        (None, "tests/test_app.py:23:5", "dynamic"), ("app.client.time.sleep", "tests/test_app.py:24:5", "valid"), ("app.client.time.slep", "tests/test_app.py:25:5", "drifted")]),
    "affected": (SAMPLE, lambda e: e.affected(_changed(e, "chain.py")), "path", [("chain.py",), ("test_calc.py",)]),
    "affected_far": (SAMPLE, lambda e: e.affected(_changed(e, "alias.py", "views.py")), "path", [("alias.py",), ("app.py",), ("config.py",), ("pkg/models.py",), ("prop.py",), ("views.py",)]),
    "call_edges": (SAMPLE, lambda e: e.edges.where("src like 'chain%' or src like 'test_calc%' or src like 'app%' or src like 'same%'"), "src dst", [
        ("chain.a", "chain.b"), ("chain.b", "chain.c"), ("chain.recur", "chain.recur"), ("test_calc.test_c", "chain.c"), ("test_calc.helper_not_test", "chain.c"), ("app", "app.main"),
        ("app.main", "pkg.models.make_user"), ("app.main", "pkg.models.User"), ("same.run", "same.Alpha.process"), ("same.run", "same.Beta.process"), ("same.Alpha.process", "same.helper_prop")]),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def query(files: dict, verb: Callable[[Engine], DataFrame], columns: str) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: verb(_engine(spark, files)).select(*columns.split())

    return {f"verb_{name}": query(files, verb, columns) for name, (files, verb, columns, _) in _VERBS.items()}


def oracle_sql() -> dict[str, str]:
    return {f"verb_{name}": _values(columns, rows) for name, (_, _, columns, rows) in _VERBS.items()}
