"""The verbs: each is a DataFrame over the fact tables and the resolved graph of one tree."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeweave.functions import predicates as P
from lodeweave.functions.ids import fqn_names, import_module_name, leaf, location, module_name, parent, scope_fqn, scoped_by
from lodeweave.operators.components import joined_to
from lodeweave.operators.fusion import covered_lines, first_by, fuse, sole_value
from lodeweave.operators.graph import LOCAL_EDGES, callers_of, closure, cycles, most_used, reachable, reversed_edges, unreached
from lodeweave.operators.joins import longest_prefix_join, prefix_semi_join, unique_suffix_join
from lodeweave.plans.facts import facts, split
from lodeweave.plans.resolve import Resolver, relative_module
from lodeweave.schema import AUDITABLE
from lodeweave.sources import tree
from lodeweave.workspace import materialize

MOST_USED, MIN_USES = 30, 2
_STRINGS = "array<string>"


def _rows(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def _symbol(symbol: str) -> str:
    if not symbol or not symbol.strip():
        raise ValueError("a symbol is required")
    return symbol.strip()


class Engine:
    """Queries over one tree: ``Engine.of_tree(spark, folder)`` or ``Engine(spark, files)`` with (path, text)."""

    def __init__(
        self, spark: SparkSession, files: DataFrame, source_roots: list[str] | None = None, console: list[str] | None = None,
        root: str | None = None, stored: dict[str, DataFrame] | None = None,
    ):
        self.spark, self.root, self.console = spark, root, console or []
        self.files = files
        if stored is None:
            raw = materialize(facts(files), "facts")
            stored = split(raw)
        self.tables = stored
        self.resolver = Resolver(files, self.tables, source_roots)

    @classmethod
    def of_tree(cls, spark: SparkSession, root: str) -> Engine:
        files = materialize(tree.read_tree(spark, root), "files")
        return cls(spark, files, tree.source_roots(root), tree.console_targets(root), root)

    # Shared tables

    @property
    def defs(self) -> DataFrame:
        return self.resolver.defs

    @cached_property
    def edges(self) -> DataFrame:
        return self.resolver.call_edges.select("src", "dst").distinct()

    @cached_property
    def nodes(self) -> DataFrame:
        """(fqn, path, line, col, kind) of functions and classes, the last definition of a name, and of modules."""
        d = self.defs.where("kind in ('function', 'class')").groupBy("fqn").agg(
            F.max(F.struct("offset", "path", "line", "col", "tag")).alias("d")
        )
        d = d.select("fqn", "d.path", "d.line", "d.col", F.col("d.tag").alias("kind"))
        m = self.files.select(
            module_name(F.col("path")).alias("fqn"), "path", F.lit(1).alias("line"), F.lit(1).alias("col"), F.lit("module").alias("kind"),
        )
        return materialize(d.union(m.join(d.select("fqn"), "fqn", "left_anti")), "nodes")

    def roots(self, symbol: str, kinds: tuple[str, ...] = ("function", "class")) -> DataFrame:
        """Definitions that ``symbol`` names: equal last component, the others the end of module and scope."""
        name = symbol.split(".")[-1]
        return self.defs.where((F.col("name") == name) & F.col("kind").isin(*kinds) & scoped_by(symbol, F.col("path"), F.col("container")))

    @cached_property
    def test_classes(self) -> DataFrame:
        hit = (F.col("kind") == "class") & P.is_test_file(F.col("path")) & (
            F.col("name").startswith("Test") | P.has_test_case_base(F.col("bases"))
        )
        return self.defs.where(hit).select("fqn").distinct()

    @cached_property
    def tests_defs(self) -> DataFrame:
        """Collected tests: functions named ``test*`` in test files, at module level or in a test class."""
        candidates = self.defs.where((F.col("kind") == "function") & P.is_test_file(F.col("path")) & P.is_test_name(F.col("name")))
        owner = scope_fqn(F.col("path"), F.col("container"))
        inside = candidates.withColumn("__owner", owner).join(
            self.test_classes.select(F.col("fqn").alias("__class")), F.col("__owner") == F.col("__class"), "left",
        )
        return inside.where("size(container) = 0 or __class is not null").drop("__owner", "__class")

    # Symbols

    def defs_of(self, symbol: str) -> DataFrame:
        """Definitions and import bindings of a symbol; a binding names the definition if there is just one."""
        symbol = _symbol(symbol)
        found = self.roots(symbol, ("function", "class", "variable", "import"))
        d = found.where("kind <> 'import'").select(
            "path", "line", "col", "kind", F.lit("definition").alias("role"), F.lit(None).cast("string").alias("resolves_to"),
        )
        sole = sole_value(d.select(location().alias("l")), "l").withColumnRenamed("sole", "only")
        # One row, so the side is bounded.
        b = found.where("kind = 'import'").crossJoin(F.broadcast(sole)).select("path", "line", "col", "kind", F.lit("binding"), "only")
        return self._located(d.union(b).dropDuplicates(["path", "line", "col"]))

    @staticmethod
    def _located(df: DataFrame) -> DataFrame:
        return df.withColumn("loc", location()).orderBy("loc")

    def _targets(self, symbol: str) -> DataFrame:
        return self.roots(symbol).select("fqn").distinct()

    def callers(self, symbol: str) -> DataFrame:
        """Call sites of a symbol; ``kind`` is the kind of the callable around the site."""
        symbol = _symbol(symbol)
        calls = self.resolver.resolved.where("is_call").join(self._targets(symbol), "fqn", "left_semi")
        owned = self.resolver.owned(calls.select("path", "container", "line", "col", "fqn"))
        kinds = self.nodes.select(F.col("fqn").alias("owner"), "kind")
        at = self.nodes.select(F.col("fqn").alias("__t"), location().alias("__l"))
        several = self._targets(symbol).agg((F.count("*") > 1).alias("several"))
        out = owned.join(kinds, "owner", "left").join(at, F.col("fqn") == F.col("__t"), "left").crossJoin(F.broadcast(several))
        return self._located(
            out.select(
                "path", "line", "col", F.coalesce("kind", F.lit("callable")).alias("kind"), F.lit("call").alias("role"),
                F.when(F.col("several"), F.col("__l")).alias("resolves_to"), F.col("owner").alias("caller"),
            ).dropDuplicates(["path", "line", "col"])
        )

    def refs(self, symbol: str) -> DataFrame:
        """Reads, writes, calls and import bindings that resolve to a symbol, with its definitions."""
        symbol = _symbol(symbol)
        targets = self._targets(symbol)
        sites = self.resolver.uses.join(targets, "fqn", "left_semi").select(
            "path", "line", "col", F.when(F.col("is_call"), "call").otherwise("read").alias("kind"), F.lit("reference").alias("role"),
        )
        imports = self.resolver.bindings.where("kind = 'from'").join(
            self.resolver.symbols.withColumnsRenamed({"kind": "k"}), "symbol",
        ).join(targets, "fqn", "left_semi").select("path", "offset")
        d = self.defs.where("kind = 'import'").join(imports.distinct(), ["path", "offset"], "left_semi").select(
            "path", "line", "col", F.lit("import"), F.lit("binding"),
        )
        own = self.roots(symbol).select("path", "line", "col", "kind", F.lit("definition"))
        variables = self.roots(symbol, ("variable",)).select("path", "line", "col", F.lit("write"), F.lit("definition"))
        names = self.roots(symbol, ("variable",)).select("fqn").distinct()
        reads = self.resolver.uses.where("kind = 'variable'").join(names, "fqn", "left_semi").select(
            "path", "line", "col", F.lit("read"), F.lit("reference"),
        )
        return self._located(sites.union(d).union(own).union(variables).union(reads).dropDuplicates(["path", "line", "col"]))

    # Graph

    def graph(self, symbol: str, reverse: bool = False, depth: int | None = None) -> DataFrame:
        """(fqn, path, line, col, kind, depth, via) of what a symbol reaches, or with ``reverse`` what reaches it."""
        symbol = _symbol(symbol)
        return self._closure(self._targets(symbol), reverse, depth)

    def _closure(self, targets: DataFrame, reverse: bool, depth: int | None = None) -> DataFrame:
        e = reversed_edges(self.edges) if reverse else self.edges
        found = closure(e, targets.select(F.col("fqn").alias("node")), depth)
        return found.withColumnRenamed("node", "fqn").join(self.nodes, "fqn", "left").select(
            "fqn", "path", "line", "col", "kind", "depth", "via",
        ).orderBy("depth", "fqn")

    def exists(self, symbol: str) -> bool:
        return not self._targets(_symbol(symbol)).isEmpty()

    # Classes

    @cached_property
    def external_classes(self) -> DataFrame:
        """(fqn) of classes with a base outside the tree, their own or an ancestor's."""
        own = self.resolver.supertypes.where("base_fqn is null").select(F.col("class").alias("fqn")).distinct()
        up = self.resolver.ancestors.join(
            own.withColumnRenamed("fqn", "ancestor"), "ancestor", "left_semi",
        ).select(F.col("node").alias("fqn"))
        return materialize(own.union(up).distinct(), "external")

    def hierarchy(self, symbol: str) -> DataFrame:
        """(root, section, rank, fqn, method): supertypes, external bases, subtypes, and methods that override or are overridden."""
        roots = materialize(self.roots(_symbol(symbol), ("class",)).select(F.col("fqn").alias("root")).distinct(), "roots")
        anc = self.resolver.ancestors
        none = F.lit(None).cast("string")
        sup = roots.join(anc, roots["root"] == anc["node"]).select(
            "root", F.lit("supertype").alias("section"), F.col("depth").alias("rank"), F.col("ancestor").alias("fqn"), none.alias("method"),
        )
        own = roots.select("root", F.col("root").alias("class")).union(sup.select("root", F.col("fqn")))
        ext = own.join(
            self.resolver.supertypes.where("base_fqn is null"), "class",
        ).select("root", F.lit("external"), "place", "base", none).distinct()
        sub = roots.join(anc, roots["root"] == anc["ancestor"]).select("root", F.lit("subtype"), "depth", "node", none)
        o = self.resolver.override_edges.withColumns({"src_class": parent(F.col("src")), "dst_class": parent(F.col("dst"))})
        over = roots.join(o, roots["root"] == o["dst_class"]).select("root", F.lit("overrides"), F.lit(0), "src", leaf(F.col("src")))
        under = roots.join(o, roots["root"] == o["src_class"]).select("root", F.lit("overridden-by"), F.lit(0), "dst", leaf(F.col("dst")))
        order = F.array_position(
            F.array(*(F.lit(s) for s in ("supertype", "external", "subtype", "overrides", "overridden-by"))), F.col("section"),
        )
        return sup.union(ext).union(sub).union(over).union(under).orderBy("root", order, "method", "rank", "fqn")

    # Reachability from entry points

    @cached_property
    def managed_classes(self) -> DataFrame:
        """Classes that a framework instantiates: test classes, those in entry files, those with an external ancestor."""
        entry = self.defs.where((F.col("kind") == "class") & P.is_entry_file(F.col("path"))).select("fqn")
        return materialize(self.test_classes.union(entry).union(self.external_classes).distinct(), "managed")

    @cached_property
    def framework_entries(self) -> DataFrame:
        """(fqn, why): definitions that run without a call in the tree, by decorator, name, place, class or console script."""
        d = self.defs.where("kind in ('function', 'class')")
        d = d.withColumn("__owner", scope_fqn(F.col("path"), F.col("container")))
        m = self.managed_classes
        d = d.join(
            m.select(F.col("fqn").alias("__in")), d["__owner"] == F.col("__in"), "left",
        ).join(m.select(F.col("fqn").alias("__is")), d["fqn"] == F.col("__is"), "left")
        why = (
            F.when(F.size("decorators") > 0, "decorated")
            .when(F.col("__in").isNotNull() | F.col("__is").isNotNull(), "framework-base")
            .when(P.is_entry_file(F.col("path")) | P.is_dunder(F.col("name")), "framework-entry")
        )
        for target in self.console:
            why = F.when(why.isNull() & fqn_names(F.col("fqn"), target), "console-script").otherwise(why)
        first = F.min(F.struct("path", "offset", "why"))["why"]
        return materialize(d.withColumn("why", why).where("why is not null").groupBy("fqn").agg(first.alias("why")), "entries")

    @cached_property
    def driven(self) -> DataFrame:
        """(fqn) that a framework or tool runs: framework entries, what modules use when they are loaded, and what dotted strings name."""
        touched = self.resolver.resolved.where("module_scope").select("fqn")
        named = self.tables["dotted_strings"].select("value").distinct()
        known = self.defs.where("kind in ('function', 'class')").select("fqn").distinct()
        strings = unique_suffix_join(named, "value", known, "fqn", "hit").where("hit is not null").select("hit")
        return materialize(self.framework_entries.select("fqn").union(touched).union(strings).distinct(), "driven")

    @cached_property
    def seeds(self) -> DataFrame:
        """(node) from which code runs: framework entries, tests, exports, import-time uses, dotted strings."""
        exported = self.tables["exports"].select(F.concat_ws(".", module_name(F.col("path")), "name").alias("symbol"))
        exported = exported.join(self.resolver.symbols, "symbol").where("kind in ('function', 'class')").select("fqn")
        return self.driven.union(self.tests_defs.select("fqn")).union(exported).distinct().withColumnRenamed("fqn", "node")

    @cached_property
    def _inside(self) -> DataFrame:
        """Edges from a class to its dunder methods, which run without being named."""
        d = self.defs.where((F.col("tag") == "method") & P.is_dunder(F.col("name")))
        return d.select(scope_fqn(F.col("path"), F.col("container")).alias("src"), F.col("fqn").alias("dst"))

    @cached_property
    def references_edges(self) -> DataFrame:
        """Call edges and mentions of a function or class without a call, from the code around them."""
        mentions = self.resolver.resolved.where("not is_call")
        return self.edges.union(self.resolver.owned(mentions).select(F.col("owner").alias("src"), F.col("fqn").alias("dst"))).distinct()

    @property
    def population(self) -> DataFrame:
        """The functions and classes among which ``deadcode`` looks."""
        return self.defs.where("kind in ('function', 'class')")

    def deadcode(self) -> DataFrame:
        """(fqn, path, line, col, kind) of callables that no entry point reaches; methods of a dead class are not listed."""
        live = materialize(
            reachable(self.edges, self.seeds, self.resolver.override_edges.union(self._inside)), "live",
        )
        owned = self.population.withColumn("owner", scope_fqn(F.col("path"), F.col("container")))
        left = unreached(owned, live, "fqn", "owner")
        kind = F.when((F.col("kind") == "function") & (F.size("container") > 0), "method").otherwise(F.col("kind"))
        return left.select("fqn", "path", "line", "col", kind.alias("kind")).orderBy("path", "line", "col")

    def dispatch_caveat(self, symbol: str) -> DataFrame:
        """(fqn, why): the first definition of a symbol, in file order, that something outside the tree may call; at most one row.

        Marks of the definition itself come before uses by a module or a
        dotted string, which make it a framework entry.
        """
        at = self.nodes.select("fqn", "path", "line", "col").join(self._targets(_symbol(symbol)), "fqn", "left_semi")
        own = at.join(self.framework_entries, "fqn").withColumn("o", F.lit(0))
        used = at.join(self.driven, "fqn", "left_semi").withColumns({"why": F.lit("framework-entry"), "o": F.lit(1)})
        return own.unionByName(used).orderBy("o", "path", "line", "col").limit(1).select("fqn", "why")

    def canonical(self) -> DataFrame:
        """(section, fqn, loc, uses, markers): most used callables, public surface that no test reaches, tests with markers."""
        info = self.nodes
        trees = self.defs.where(P.in_test_tree(F.col("path"))).select("fqn").union(
            self.files.where(P.in_test_tree(F.col("path"))).select(module_name(F.col("path")))
        ).distinct()
        entry = self.defs.where(P.is_entry_file(F.col("path"))).select("fqn").distinct()
        skip = trees.union(entry).distinct().withColumnRenamed("fqn", "node")
        uses = callers_of(self.edges.where(~P.is_dunder(leaf(F.col("dst")))), trees.withColumnRenamed("fqn", "node"), skip)
        used = most_used(uses, MIN_USES, MOST_USED).withColumnRenamed("node", "fqn")
        none = F.lit(None).cast("string")
        used = used.join(info, "fqn", "left").select(
            F.lit("most-used").alias("section"), "fqn", location().alias("loc"), "uses", none.alias("markers"),
        )
        public = self.defs.where(
            P.is_public_surface(
                F.col("kind"), F.col("container"), F.col("nested"), F.col("name"),
            ) & ~P.in_test_tree(F.col("path")) & ~P.is_entry_file(F.col("path"))
        )
        reached = materialize(
            reachable(self.edges, self.tests_defs.select(F.col("fqn").alias("node")), self.resolver.override_edges), "tested",
        )
        tested = reached.select(F.col("node").alias("fqn")).union(reached.select(parent(F.col("node")))).distinct()
        left = public.join(tested, "fqn", "left_anti").join(self.driven, "fqn", "left_anti")
        untested = left.select(F.lit("untested"), "fqn", location(), F.lit(None).cast("bigint"), none)
        mark = lambda c: F.transform(F.filter(c, lambda d: d.rlike(r"(^|\.)mark\.\w")), lambda d: F.regexp_extract(d, r"(?:^|\.)mark\.(\w+)", 1))
        owners = self.defs.where("kind = 'class'").select(F.col("fqn").alias("owner"), mark(F.col("decorators")).alias("inherited"))
        t = self.tests_defs.withColumn("owner", scope_fqn(F.col("path"), F.col("container"))).join(owners, "owner", "left")
        marks = F.array_join(
            F.array_sort(F.array_distinct(F.concat(mark(F.col("decorators")), F.coalesce("inherited", F.array().cast(_STRINGS))))), ",",
        )
        tests = t.select(F.lit("test"), "fqn", location(), F.lit(None).cast("bigint"), marks)
        order = F.array_position(F.array(F.lit("most-used"), F.lit("untested"), F.lit("test")), F.col("section"))
        return used.union(untested).union(tests).orderBy(
            order, F.desc_nulls_last("uses"), F.when(F.col("section") == "untested", F.col("loc")).otherwise(F.col("fqn")),
        )

    # Tests

    def tests(self, symbol: str) -> DataFrame:
        """Collected tests that reach a symbol, with depth."""
        found = self.graph(symbol, reverse=True)
        return found.join(self.tests_defs.select("fqn").distinct(), "fqn", "left_semi").orderBy("depth", "fqn")

    def change_coverage(self, changed: DataFrame, coverage: DataFrame | None) -> DataFrame:
        """(path, line, status, tests): changed (path, line) joined to coverage (nodeid, path, line); ``unknown`` without coverage."""
        if coverage is None:
            return changed.distinct().select("path", "line", F.lit("unknown").alias("status"), F.array().cast(_STRINGS).alias("tests"))
        return covered_lines(changed, coverage).orderBy(F.desc("status"), F.concat_ws(":", "path", "line"))

    def describe(self, symbol: str, shapes: DataFrame | None = None) -> DataFrame:
        """(section, fqn, loc, kind, depth, detail) of definition, callers, callees and tests; detail holds the signature."""
        symbol = _symbol(symbol)
        roots = self.roots(symbol)
        bases = F.concat(F.lit("("), F.array_join("bases", ", "), F.lit(")"))
        d = roots.withColumn("text", F.when(F.col("kind") == "class", bases).otherwise(F.col("signature")))
        if shapes is not None:
            s = shapes.groupBy("fqn").agg(F.array_join(F.array_sort(F.collect_set("type_label")), " | ").alias("observed"))
            d = d.join(s, "fqn", "left")
        else:
            d = d.withColumn("observed", F.lit(None).cast("string"))
        doc = F.when(F.length("doc") > 80, F.concat(F.substring("doc", 1, 80), F.lit("…"))).otherwise(F.col("doc"))
        d = d.select(
            F.lit(1).alias("o"), F.lit("definition").alias("section"), "fqn", location().alias("loc"), F.col("tag").alias("kind"), F.lit(0).alias("depth"), F.col("text").alias("detail"),
            doc.alias("doc"), F.array_join("decorators", ", ").alias("decorators"), "line", "end_line", F.col("observed").alias("observed_return"),
        )
        none = F.lit(None)
        pad = [none.cast("string").alias("detail"), none.cast("string"), none.cast("string"), "line", none.cast("int"), none.cast("string")]
        targets = materialize(roots.select("fqn").distinct(), "roots")
        parts = [
            (2, "caller", self._closure(targets, True, 1)), (3, "callee", self._closure(targets, False, 1)),
            (4, "test", self._closure(targets, True).join(self.tests_defs.select("fqn").distinct(), "fqn", "left_semi")),
        ]
        for place, name, rows in parts:
            d = d.union(rows.select(F.lit(place), F.lit(name), "fqn", location(), "kind", "depth", *pad))
        return d.orderBy("o", F.when(F.col("section") == "test", F.col("depth")), "fqn").drop("o")

    # Facts

    def inputs(self, target: str | None = None) -> DataFrame:
        """Inputs of the application, or those of one file.  The former leaves out scripts and tests."""
        i = self.tables["inputs"]
        if target:
            return i.where(P.file_matches(F.col("path"), target)).orderBy("path", "offset")
        guards = self.tables["flags"].where("kind = 'main_guard'").select(F.col("path").alias("__p")).distinct()
        marked = i.join(guards, i["path"] == guards["__p"], "left")
        return marked.where(
            ~P.is_script_file(F.col("path"), F.col("__p").isNotNull()) & ~P.is_test_file(F.col("path"))
        ).drop("__p").orderBy("path", "offset")

    def input_scripts(self) -> DataFrame:
        """(path) of scripts that have inputs of their own."""
        guards = self.tables["flags"].where("kind = 'main_guard'").select(F.col("path").alias("__p")).distinct()
        marked = self.tables["inputs"].join(guards, F.col("path") == F.col("__p"), "left")
        return marked.where(P.is_script_file(F.col("path"), F.col("__p").isNotNull())).select("path").distinct().orderBy("path")

    @cached_property
    def import_edges(self) -> DataFrame:
        """(importer, importer_file, target, line, col, internal, context)"""
        modules = self.files.select(import_module_name(F.col("path")).alias("module")).where("module <> ''").distinct()
        i = self.tables["imports"].select(
            "*", import_module_name(F.col("path")).alias("importer"),
            relative_module(F.col("path"), F.col("module"), F.col("level")).alias("base"),
        )
        sub = i.where("size(names) > 0").select("*", F.explode("names").alias("n")).withColumn("sub", F.concat_ws(".", "base", "n"))
        as_module = sub.join(modules.withColumnRenamed("module", "sub"), "sub", "left_semi")
        subs = as_module.select("importer", "path", F.col("sub").alias("target"), "line", "col", "context")
        spelled = i.select("importer", "path", F.col("base").alias("target"), "line", "col", "context").where("target <> ''")
        plain = spelled.join(subs.groupBy("path", "line", "col").agg(F.count("*").alias("k")), ["path", "line", "col"], "left")
        whole = i.select("path", "line", "col", F.size("names").alias("size"))
        plain = plain.join(whole, ["path", "line", "col"]).where("k is null or k < size").select(
            "importer", "path", "target", "line", "col", "context",
        ).distinct()
        both = unique_suffix_join(plain.union(subs), "target", modules, "module", "hit")
        both = both.withColumn("target", F.coalesce("hit", "target")).drop("hit")
        flagged = prefix_semi_join(both, "target", modules, "module", "internal")
        return materialize(
            flagged.select("importer", F.col("path").alias("importer_file"), "target", "line", "col", "internal", "context").distinct(),
            "imports",
        )

    def imports(self, module: str | None = None, reverse: bool = False) -> DataFrame:
        """Import edges: all, of one module, or with ``reverse`` into it (also below it)."""
        e = self.import_edges
        loc = location("importer_file", "line", "col")
        if not module:
            return e.orderBy(F.concat("importer", loc))
        if not reverse:
            return e.where(fqn_names(F.col("importer"), module)).orderBy(F.concat("target", loc))
        modules = self.files.select(import_module_name(F.col("path")).alias("module")).distinct()
        asked = unique_suffix_join(
            _rows(self.spark, [module], "asked"), "asked", modules, "module", "hit",
        ).select(F.coalesce("hit", "asked").alias("asked"))
        return e.join(F.broadcast(asked), F.col("target") == F.col("asked"), "left_semi").orderBy(loc)

    def import_cycles(self) -> DataFrame:
        """(component, size, path) of cycles among imports that run when a module is loaded."""
        live = self.import_edges.where("internal and context = 'top-level'").select(
            F.col("importer").alias("src"), F.col("target").alias("dst"),
        )
        modules = self.files.select(import_module_name(F.col("path")).alias("dst")).distinct()
        return cycles(live.join(modules, "dst", "left_semi").select("src", "dst").distinct())

    def effects(self, symbol: str | None = None, observed: DataFrame | None = None) -> DataFrame:
        """(owner, category, api, loc, import_time, confidence): static effects fused with observed (owner_fqn, category).

        With a symbol only what it reaches: effects of reached functions, and
        import-time effects of files that define one.
        """
        e = self.tables["effects"]
        owned = self.resolver.owned(e.where("not import_time")).select("path", "kind", "detail", "line", "col", "import_time", "owner")
        at_import = e.where("import_time").select(
            "path", "kind", "detail", "line", "col", "import_time", module_name(F.col("path")).alias("owner"),
        )
        sites = owned.union(at_import).select(
            "owner", F.col("kind").alias("category"), F.col("detail").alias("api"), "path", location().alias("loc"), "import_time",
        )
        reach = None
        if symbol:
            targets = materialize(self._targets(_symbol(symbol)), "roots")
            reach = materialize(
                targets.union(closure(self.edges, targets.withColumnRenamed("fqn", "node")).select("node")).distinct(), "reach",
            )
            play = self.defs.where("kind in ('function', 'class')").join(reach, "fqn", "left_semi").select("path").distinct()
            inside = sites.where("not import_time").join(reach.withColumnRenamed("fqn", "owner"), "owner", "left_semi")
            sites = inside.unionByName(sites.where("import_time").join(play, "path", "left_semi"))
        auditable = F.col("category").isin(*AUDITABLE)
        # Of sites of one place and callee the first counts; what is only observed has no place.
        keys = ["owner", "category"]
        seen = sites.select(*keys).limit(0) if observed is None else observed.select(F.col("owner_fqn").alias("owner"), "category").where("category <> 'import'")
        labels = fuse(sites, seen, keys)
        shown = first_by(sites.select("loc", "api", "owner", "category", "path", "import_time"), ["loc", "api"], [F.col("import_time"), F.col("owner"), F.col("category")])
        sure = F.when((F.col("label") == "predicted") & ~auditable, "unverifiable").otherwise(F.col("label"))
        out = shown.join(labels, keys).withColumn("confidence", sure).drop("label")
        only = labels.where("label = 'observed'")
        if reach is not None:
            only = only.join(reach.withColumnRenamed("fqn", "owner"), "owner", "left_semi")
        none = F.lit(None).cast("string")
        out = out.unionByName(
            only.select("owner", "category", none.alias("api"), none.alias("path"), none.alias("loc"), F.lit(False).alias("import_time"), F.col("label").alias("confidence"))
        )
        rank = F.array_position(F.array(*(F.lit(c) for c in ("confirmed", "observed", "predicted", "unverifiable"))), F.col("confidence"))
        return out.select("owner", "category", "api", "loc", "import_time", "confidence").orderBy(rank, "category", "loc")

    def mock_targets(self) -> DataFrame:
        """(target, loc, verdict) of patch targets: valid, drifted, external, unverifiable or dynamic."""
        m = self.tables["mocks"].select(F.col("value").alias("target"), location().alias("loc"))
        spell = self.resolver.spellings.select("spelling")
        keyed = materialize(m.withColumn("key", F.concat_ws("|", "loc", "target")), "mocks")
        found = longest_prefix_join(keyed.where("target is not null and target <> ''"), "key", "target", spell, "spelling", "prefix")
        found = found.join(self.resolver.spellings.withColumnRenamed("spelling", "prefix"), "prefix", "left")
        found = found.withColumn(
            "rest",
            F.when(
                F.length("target") > F.length("prefix"), F.split(F.substr("target", F.length("prefix") + 2), r"\."),
            ).otherwise(F.array().cast(_STRINGS)),
        )
        found = found.withColumn("first", F.get("rest", F.lit(0))).withColumn("second", F.get("rest", F.lit(1)))
        names = self.resolver.bindings.where("scope = ''").select(
            module_name(F.col("path")).alias("module"), F.col("name").alias("first"), "kind", "target", "symbol",
        )
        names = names.groupBy("module", "first").agg(F.min(F.struct("kind", "target", "symbol")).alias("b")).select(
            "module", "first", F.col("b.kind").alias("b_kind"), F.col("b.target").alias("b_target"), F.col("b.symbol").alias("symbol"),
        )
        found = found.join(names, ["module", "first"], "left").join(self.resolver.symbols, "symbol", "left")
        member = self.resolver.all_members.select(F.col("owner").alias("fqn"), F.col("name").alias("second"), F.lit(True).alias("has"))
        found = found.join(member, ["fqn", "second"], "left")
        ext = self.external_classes.select("fqn", F.lit(True).alias("outside"))
        found = found.join(ext, "fqn", "left")
        std = stdlib_members(
            self.spark, found.where("b_kind in ('module', 'from') and kind is null").select("b_target", "second").distinct(),
        )
        found = found.join(std, ["b_target", "second"], "left")
        size = F.size("rest")
        verdict = (
            F.when(F.col("prefix").isNull(), "external")
            .when(size == 0, "valid")
            .when(F.col("b_kind").isNull() & F.col("first").isin(*P.BUILTINS), "valid")
            .when(F.col("b_kind").isNull(), "drifted")
            .when(size == 1, "valid")
            .when((F.col("kind").isNull() | (F.col("kind") != "class")) & (size == 2) & (F.col("presence") == "present"), "valid")
            .when((F.col("kind").isNull() | (F.col("kind") != "class")) & (size == 2) & (F.col("presence") == "absent"), "drifted")
            .when((F.col("kind") == "module") & (size == 2) & F.col("has"), "valid")
            .when((F.col("kind") == "module") & (size == 2), "drifted")
            .when(F.col("kind").isNull() | (F.col("kind") != "class"), "unverifiable")
            .when(F.col("has") & (size == 2), "valid")
            .when(F.col("has"), "unverifiable")
            .when(F.col("outside"), "unverifiable")
            .otherwise("drifted")
        )
        out = found.select("target", "loc", verdict.alias("verdict")).union(
            keyed.where("target is null or target = ''").select("target", "loc", F.lit("dynamic"))
        )
        return out.orderBy(F.concat("verdict", "loc"))

    # Snapshots

    def affected(self, changed: DataFrame) -> DataFrame:
        """(path) whose resolved facts may change with the files ``changed`` (path).

        Those joined to a changed file by imports in either direction, and
        those with a recorded value that points into one: a callee, a caller,
        the target of a use, or a base class.
        """
        modules = self.files.select(import_module_name(F.col("path")).alias("target"), F.col("path").alias("target_file"))
        links = self.import_edges.join(modules, "target").where("importer_file <> target_file").select("importer_file", "target_file")
        joined = joined_to(links, "importer_file", "target_file", changed.select(F.col("path").alias("node")), LOCAL_EDGES)
        at = self.nodes.select("fqn", "path")
        ends = self.edges.join(at.toDF("src", "src_path"), "src").join(at.toDF("dst", "dst_path"), "dst")
        values = ends.select("src_path", "dst_path").union(ends.select("dst_path", "src_path"))
        values = values.union(self.resolver.resolved.select("path", "fqn").join(at.toDF("fqn", "to"), "fqn").select("path", "to"))
        classes = self.resolver.supertypes.where("base_fqn is not null").select("class", "base_fqn")
        values = values.union(classes.join(at.toDF("class", "of"), "class").join(at.toDF("base_fqn", "to"), "base_fqn").select("of", "to"))
        points = values.toDF("path", "to").join(changed.select(F.col("path").alias("to")), "to", "left_semi").select("path")
        return joined.withColumnRenamed("node", "path").union(changed.select("path")).union(points).distinct()


def stdlib_members(spark: SparkSession, asked: DataFrame) -> DataFrame:
    """(b_target, second, presence) of members of standard-library modules; nothing for other modules.

    The driver looks names up in its own interpreter.  There are no more rows
    than patch targets that name an attribute of an import.
    """
    import importlib
    import sys
    import types

    found = []
    for row in asked.collect():
        name, member = row["b_target"], row["second"]
        if name is None or member is None or name.split(".")[0] not in sys.stdlib_module_names:
            continue
        try:
            module = importlib.import_module(name)
        except Exception:
            continue
        if isinstance(module, types.ModuleType) and not hasattr(module, "__getattr__"):
            found.append((name, member, "present" if hasattr(module, member) else "absent"))
    return spark.createDataFrame(found, "b_target string, second string, presence string")
