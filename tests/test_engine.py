"""Verbs over small source trees."""

import pytest

from lodeweave.plans import verbs
from lodeweave.plans.engine import Engine
from lodeweave.plans.sample_trees import APP, SAMPLE


def engine(spark, files, **options):
    return Engine(spark, spark.createDataFrame(list(files.items()), "path string, text string"), **options)


@pytest.fixture(scope="module")
def sample(spark):
    return verbs._engine(spark, SAMPLE)


def column(df, name="fqn"):
    return [r[name] for r in df.collect()]


def test_defs_and_bindings(sample):
    found = sample.defs_of("make_user").collect()
    definition = [r for r in found if r["role"] == "definition"]
    assert [(r["loc"], r["kind"]) for r in definition] == [("pkg/models.py:6:5", "function")]
    assert {r["resolves_to"] for r in found if r["role"] == "binding" and r["path"] == "app.py"} == {"pkg/models.py:6:5"}
    assert sample.defs_of("pkg.models.User").count() == 1
    assert sample.defs_of("models.User").count() == 1 and sample.defs_of("Nope.User").count() == 0


def test_blank_symbol_is_refused(sample):
    with pytest.raises(ValueError):
        sample.graph(" ")


def test_closure(sample):
    assert column(sample.graph("pkg.models.make_user")) == ["pkg.models.User"]
    assert {"pkg.models.make_user", "pkg.models.User"} <= set(column(sample.graph("app.main")))
    assert [(r["fqn"], r["depth"], r["via"]) for r in sample.graph("chain.a").collect()] == [("chain.b", 1, "chain.a"), ("chain.c", 2, "chain.b")]
    assert column(sample.graph("chain.a", depth=1)) == ["chain.b"]
    assert column(sample.graph("recur")) == [] and sample.exists("recur") and not sample.exists("missing")


def test_reverse_closure(sample):
    found = {r["fqn"]: r["depth"] for r in sample.graph("chain.c", reverse=True).collect()}
    assert found["chain.b"] == 1 and found["chain.a"] == 2 and found["test_calc.test_c"] == 1
    users = {r["fqn"]: r["depth"] for r in sample.graph("User", reverse=True).collect()}
    assert users["pkg.models.make_user"] == 1 and users["app.main"] == 1 and users["app"] == 2


def test_property_reads_are_edges(sample):
    assert {"prop.Doc.label", "views.render"} <= set(column(sample.graph("prop.choices", reverse=True)))


def test_callers_through_alias_and_annotations(sample):
    lines = {(r["path"], r["line"]) for r in sample.callers("make_user").collect()}
    assert {("alias.py", 5), ("alias.py", 6), ("app.py", 5)} <= lines
    refs = {(r["path"], r["line"]) for r in sample.refs("make_user").collect()}
    assert lines <= refs and ("app.py", 1) in refs
    both = sample.callers("process").collect()
    assert len(both) == 2 and len({r["resolves_to"] for r in both}) == 2
    assert sample.callers("Alpha.process").count() == 1 and sample.callers("Beta.process").count() == 1


def test_hierarchy(sample):
    animal = {(r["section"], r["fqn"]) for r in sample.hierarchy("Animal").collect()}
    assert {("external", "ABC"), ("subtype", "animals.Dog"), ("subtype", "animals.Puppy"), ("overridden-by", "animals.Dog.speak"), ("overridden-by", "animals.Puppy.speak")} <= animal
    dog = {(r["section"], r["fqn"]) for r in sample.hierarchy("Dog").collect()}
    assert {("supertype", "animals.Animal"), ("overrides", "animals.Animal.speak")} <= dog


def test_imports_and_cycles(sample):
    edges = {(r["importer"], r["target"], r["internal"]) for r in sample.imports().collect()}
    assert ("app", "pkg.models", True) in edges and ("config", "os", False) in edges and ("config", "pkg.models", True) in edges
    assert {r["importer"] for r in sample.imports("pkg.models", reverse=True).collect()} == {"app", "alias", "config"}
    assert [(r["size"], sorted(r["path"])) for r in sample.import_cycles().collect()] == [(2, ["cyc.a", "cyc.b"])]


def test_effects_and_fusion(sample, spark):
    found = {(r["owner"], r["category"], r["confidence"]) for r in sample.effects("run_all").collect()}
    assert ("io_ops.fetch", "network", "predicted") in found and ("io_ops.jitter", "random", "unverifiable") in found
    assert sample.effects("pure").count() == 0
    assert [(r["owner"], r["category"]) for r in sample.effects("remember").collect()] == [("io_ops.remember", "global")]
    seen = spark.createDataFrame([("io_ops.fetch", "network"), ("io_ops.pure", "subprocess"), ("io_ops.pure", "import")], "owner_fqn string, category string")
    fused = {(r["owner"], r["category"]): r["confidence"] for r in sample.effects(None, seen).collect()}
    assert fused["io_ops.fetch", "network"] == "confirmed" and fused["io_ops.pure", "subprocess"] == "observed" and ("io_ops.pure", "import") not in fused
    assert fused["config", "env"] == "unverifiable"


def test_tests_and_describe(sample, spark):
    assert [(r["fqn"], r["depth"]) for r in sample.tests("chain.c").collect()] == [("test_calc.test_c", 1)]
    assert sample.tests("views.render").count() == 0
    shapes = spark.createDataFrame([("chain.c", "int"), ("chain.c", "float")], "fqn string, type_label string")
    rows = sample.describe("chain.c", shapes).collect()
    assert rows[0]["section"] == "definition" and rows[0]["detail"] == "()" and rows[0]["observed_return"] == "float | int"
    assert {(r["section"], r["fqn"]) for r in rows[1:]} == {("caller", "chain.b"), ("caller", "test_calc.test_c"), ("caller", "test_calc.helper_not_test"), ("test", "test_calc.test_c")}


def test_change_coverage(sample, spark):
    changed = spark.createDataFrame([("pkg/ops.py", 2), ("pkg/ops.py", 6)], "path string, line int")
    ran = spark.createDataFrame([("t.py::test_covered", "pkg/ops.py", 2)], "nodeid string, path string, line int")
    assert [(r["line"], r["status"], r["tests"]) for r in sample.change_coverage(changed, ran).collect()] == [(6, "uncovered", []), (2, "covered", ["t.py::test_covered"])]
    assert {r["status"] for r in sample.change_coverage(changed, None).collect()} == {"unknown"}


def test_affected_files(sample, spark):
    changed = spark.createDataFrame([("chain.py",)], "path string")
    assert set(column(sample.affected(changed), "path")) == {"chain.py", "test_calc.py"}


def test_affected_by_recorded_values(spark):
    # A re-exported function: the user's call points into a file that none of its imports name.
    files = {"lib/__init__.py": "", "lib/impl.py": "class Base:\n    def go(self):\n        pass\n", "use.py": "def run(x: 'lib.impl.Base'):\n    x.go()\n", "other.py": "def z():\n    pass\n"}
    e = engine(spark, files)
    e.resolver.call_edges  # the recorded edges are what is joined
    found = set(column(e.affected(spark.createDataFrame([("lib/impl.py",)], "path string")), "path"))
    values = {(r["src"], r["dst"]) for r in e.edges.collect()}
    assert ("use.py" in found) == (("use.run", "lib.impl.Base.go") in values) and "other.py" not in found and "lib/impl.py" in found


@pytest.fixture(scope="module")
def app(spark):
    return verbs._engine(spark, APP)


def test_deadcode(app):
    dead = column(app.deadcode())
    assert {"app.core.truly_dead", "app.core.orphan_helper"} <= set(dead)
    assert not {"app.core.exported", "app.core.live_helper", "app.core.registered", "app.shapes.Circle.area", "app.shapes._pi_helper", "app.serial.WidgetSerializer.get_label"} & set(dead)
    assert column(app.dispatch_caveat("get_label"), "why") == ["framework-base"] and app.dispatch_caveat("live_helper").isEmpty()


def test_canonical(app):
    rows = app.canonical().collect()
    assert ("app.core.live_helper", 3) in {(r["fqn"], r["uses"]) for r in rows if r["section"] == "most-used"}
    untested = {r["fqn"] for r in rows if r["section"] == "untested"}
    assert "a2.two" in untested and "a1.one" not in untested and "app.core.live_helper" not in untested
    assert {r["fqn"]: r["markers"] for r in rows if r["section"] == "test"}["tests.test_app.TestX.test_one"] == "django_db,parametrize"


def test_inputs_views(app):
    assert [r["value"] for r in app.inputs().collect()] == ["X", "Y"]
    assert {r["value"] for r in app.inputs("backfill").collect()} == {"BACKFILL_TOKEN", "--dry-run"}
    assert app.inputs("unknown").count() == 0 and column(app.input_scripts(), "path") == ["app/management/commands/backfill.py"]


def test_mock_targets(app):
    found = {r["target"]: r["verdict"] for r in app.mock_targets().collect()}
    assert found == {
        "app.client.requests": "valid", "app.client.Client.fetch": "valid", "app.client.helper": "valid", "app.client.open": "valid", "app.client.deleted_fn": "drifted", "app.client.Client.gone": "drifted",
        "os.path.exists": "external", "app.client.requests.get": "unverifiable", "app.client.Account.injected": "unverifiable", None: "dynamic", "app.client.time.sleep": "valid", "app.client.time.slep": "drifted",
    }


def test_source_roots_and_suffixes(spark):
    e = engine(spark, {"src/helpers/__init__.py": "", "src/helpers/validators.py": "def check():\n    pass\n", "src/app.py": "from helpers.validators import check\n\n\ndef go():\n    check()\n"}, source_roots=["src"])
    assert {r["path"] for r in e.refs("check").collect()} == {"src/app.py", "src/helpers/validators.py"}
    assert column(e.graph("check", reverse=True)) == ["src.app.go"]
    for spelling in ("helpers.validators", "src.helpers.validators"):
        assert column(e.imports(spelling, reverse=True), "importer") == ["src.app"]


def test_empty_tree(spark):
    e = engine(spark, {"empty.py": ""})
    assert e.deadcode().isEmpty() and e.imports().isEmpty() and e.graph("x").isEmpty() and e.canonical().isEmpty() and e.effects().isEmpty()


def test_deep_names_and_imports_are_followed(spark):
    files = {f"{p}/__init__.py": "" for p in ("a", "a/b", "a/b/c")}
    files["a/b/c/d.py"] = "class Cls:\n    def make():\n        pass\n"
    files["deep.py"] = "import a.b.c.d\n\n\ndef go():\n    a.b.c.d.Cls.make()\n\n\ndef typed(x: a.b.c.d.Cls):\n    x.make()\n"
    files["r0.py"] = "def far():\n    pass\n"
    files |= {f"r{i}.py": f"from r{i - 1} import far\n" for i in range(1, 12)}
    files["last.py"] = "from r11 import far\n\n\ndef end():\n    far()\n"
    files |= {"x1.py": "from x2 import gone\n", "x2.py": "from x3 import gone\n", "x3.py": "from x2 import gone\n"}  # a cycle
    edges = {(r["src"], r["dst"]) for r in engine(spark, files).resolver.call_edges.collect()}
    assert {("deep.go", "a.b.c.d.Cls.make"), ("deep.typed", "a.b.c.d.Cls.make"), ("last.end", "r0.far")} <= edges
