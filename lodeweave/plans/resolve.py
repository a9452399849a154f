"""Names to definitions: scopes, imports, attribute chains and class members as joins.

A use of a dotted chain is resolved in two steps.  Its first name is looked up
in the enclosing scopes, nearest first (a class body is seen only from
itself).  Each further name is a join with the table of members: of modules
(definitions, imports followed to their end, submodules) and of classes (own
and inherited).  What a variable, parameter or call result is an instance of
comes from resolving its annotation or constructor call in the same way.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.ids import def_fqn, module_name, path_parts, scope_fqn
from lodeweave.operators.graph import pair_closure
from lodeweave.operators.joins import unique_suffix_table
from lodeweave.workspace import materialize

#: Steps along chains of names after which the state is written.
WALKED = 4
_EMPTY = "cast(array() as array<string>)"


def relative_module(path: Column, module: Column, level: Column) -> Column:
    """Absolute dotted module of ``from {level dots}{module} import``."""
    parts = path_parts(path)
    package = F.slice(parts, 1, F.greatest(F.size(parts) - level, F.lit(0)))
    absolute = F.concat_ws(".", F.array_join(F.filter(package, lambda p: p != "__init__"), "."), F.when(module != "", module))
    return F.when(level > 0, F.regexp_replace(absolute, r"^\.", "")).otherwise(module)


class Resolver:
    """Resolution over the fact tables of one tree.  Tables are built on first use and written once."""

    def __init__(self, files: DataFrame, tables: dict[str, DataFrame], roots: list[str] | None = None):
        self.files, self.tables = files, tables
        self.spark = files.sparkSession
        self.roots = roots or []

    @cached_property
    def defs(self) -> DataFrame:
        d = self.tables["defs"].withColumn("fqn", def_fqn(F.col("path"), F.col("container"), F.col("name")))
        classes = self.tables["scopes"].where("kind = 'class'").select(
            F.col("path").alias("__p"), F.col("container").alias("__c"),
        ).distinct()
        d = d.join(classes, (d["path"] == classes["__p"]) & (d["container"] == classes["__c"]), "left")
        tag = F.when(
            (F.col("kind") == "function") & F.col("__p").isNotNull(),
            F.when(
                F.exists("decorators", lambda x: x.rlike(r"(^|\.)(cached_)?property$|\.setter$|\.getter$")), "property",
            ).otherwise("method"),
        )
        return materialize(d.withColumn("tag", F.coalesce(tag, "kind")).drop("__p", "__c"), "defs")

    @cached_property
    def modules(self) -> DataFrame:
        """(module, path)"""
        return materialize(self.files.select(module_name(F.col("path")).alias("module"), "path").where("module <> ''"), "modules")

    @cached_property
    def spellings(self) -> DataFrame:
        """(spelling, module): how imports may name the modules of the tree, source roots and unique suffixes included."""
        table = unique_suffix_table(self.modules, "module").where("id is not null").select("spelling", F.col("id").alias("module"))
        for root in self.roots:
            prefix = root.replace("/", ".") + "."
            rooted = self.modules.where(F.col("module").startswith(prefix)).select(
                F.substring("module", len(prefix) + 1, 1 << 20).alias("spelling"), "module",
            )
            table = rooted.union(table.join(rooted.select("spelling"), "spelling", "left_anti"))
        return materialize(table, "spellings")

    def _canonical(self, df: DataFrame, column: str, out: str) -> DataFrame:
        table = self.spellings.select(F.col("spelling").alias("__s"), F.col("module").alias(out))
        return df.join(table, df[column] == table["__s"], "left").drop("__s")

    @cached_property
    def bindings(self) -> DataFrame:
        """Bindings with their scope and what imports name: (path, scope, name, kind, value, detail, target, rank)."""
        b = self.tables["bindings"]
        b = b.withColumn("wanted", relative_module(F.col("path"), F.col("module"), F.col("level")))
        b = self._canonical(b, "wanted", "found")
        whole = b.withColumn("sub", F.concat_ws(".", F.col("wanted"), F.col("value")))
        whole = self._canonical(whole, "sub", "submodule")
        target = (
            F.when(F.col("kind") == "module", F.coalesce("found", "wanted"))
            .when(
                F.col("kind") == "from",
                F.when(
                    F.col("submodule").isNotNull() & F.col("found").isNull(), F.col("submodule"),
                ).otherwise(F.concat_ws(".", F.coalesce("found", "wanted"), "value")),
            )
        )
        rank = F.when(
            F.col("kind").isin("function", "class"), 0,
        ).when(F.col("kind").isin("from", "module"), 1).when(F.col("kind").isin("self", "param"), 2).when(F.col("value").isNotNull(), 3).otherwise(4)
        out = whole.select(
            "path", F.array_join("container", ".").alias("scope"), "container", "name", "kind", "value", "detail", "offset", target.alias("target"), rank.alias("rank"),
            F.array_join(F.concat(F.split(module_name(F.col("path")), r"\."), "container", F.array("name")), ".").alias("symbol"),
        )
        return materialize(out, "bindings")

    @cached_property
    def symbols(self) -> DataFrame:
        """(symbol, kind, fqn): module, class, function or variable a dotted name ends at, imports followed."""
        first = F.min(F.struct("rank", "order", "kind", "fqn")).alias("s")
        direct = self.defs.where("kind in ('function', 'class')").select(
            F.col("fqn").alias("symbol"), F.lit(0).alias("rank"), (-F.col("offset")).alias("order"), "kind", "fqn",
        )
        variables = self.bindings.where("kind = 'variable'").select(
            F.col("symbol"), F.lit(2), F.col("offset"), F.lit("variable"), F.col("symbol"),
        )
        mods = self.modules.select(F.col("module").alias("symbol"), F.lit(1), F.lit(0), F.lit("module"), F.col("module"))
        ends = materialize(direct.union(variables).union(mods).groupBy("symbol").agg(first).select("symbol", "s.kind", "s.fqn"), "symbols")
        links = self.bindings.where("kind in ('from', 'module') and target is not null and target <> symbol")
        links = materialize(links.groupBy("symbol").agg(F.min("target").alias("target")).join(ends, "symbol", "left_anti"), "links")
        # Each symbol has one target.  A walk that comes back to where it was at the last power of two goes round a cycle.
        nxt = links.select(F.col("symbol").alias("target"), F.col("target").alias("further"))
        found, open_, step = ends, links.select("symbol", "target", F.col("target").alias("mark")), 1
        while not open_.isEmpty():
            found = found.union(open_.join(ends.withColumnRenamed("symbol", "target"), "target").select("symbol", "kind", "fqn"))
            moved = open_.join(ends.select(F.col("symbol").alias("target")), "target", "left_anti").join(nxt, "target")
            mark = F.col("target") if step & (step - 1) == 0 else F.col("mark")
            open_ = materialize(moved.select("symbol", F.col("further").alias("target"), mark.alias("mark")).where("target <> mark"), "links")
            step += 1
        return materialize(
            found.groupBy("symbol").agg(F.min(F.struct("kind", "fqn")).alias("s")).select("symbol", "s.kind", "s.fqn"), "symbols",
        )

    @cached_property
    def _external_links(self) -> DataFrame:
        """(symbol, target) of imports that leave the tree."""
        links = self.bindings.where("kind in ('from', 'module')").select("symbol", "target")
        return links.join(self.symbols.select("symbol"), "symbol", "left_anti").distinct()

    # Chains

    def _roots(self, uses: DataFrame) -> DataFrame:
        """``uses`` (uid, path, container, chain) with the nearest binding of the first name: columns b_*."""
        depth = F.size("container")
        levels = F.sequence(depth, F.lit(0))
        tried = uses.select("uid", "path", "chain", "container", F.posexplode(levels).alias("distance", "level"))
        tried = tried.withColumn(
            "scope", F.array_join(F.slice("container", 1, F.col("level")), "."),
        ).withColumn("root", F.element_at("chain", 1))
        classes = self.tables["scopes"].where("kind = 'class'").select(
            F.col("path").alias("__p"), F.array_join("container", ".").alias("__c"),
        ).distinct()
        tried = tried.join(
            classes, (tried["path"] == classes["__p"]) & (tried["scope"] == classes["__c"]), "left",
        ).where("__p is null or distance = 0")
        b = self.bindings.select(
            F.col("path").alias("bp"), F.col("scope").alias("bs"), F.col("name").alias("bn"), F.col("kind").alias("b_kind"),
            F.col("symbol").alias("b_symbol"), F.col("rank").alias("b_rank"), F.col("value").alias("b_value"), "offset",
        )
        hit = tried.join(b, (tried["path"] == b["bp"]) & (tried["scope"] == b["bs"]) & (tried["root"] == b["bn"]))
        best = hit.groupBy("uid").agg(
            F.min(
                F.struct("distance", "b_rank", (-F.col("offset")).alias("o"), "b_kind", "b_symbol", "b_value", "path", "scope")
            ).alias("b")
        )
        return uses.join(best.select("uid", "b.b_kind", "b.b_symbol", "b.b_value", F.col("b.scope").alias("b_scope")), "uid", "left")

    def _walk(self, uses: DataFrame, members: DataFrame, types: DataFrame | None) -> DataFrame:
        """(uid, kind, fqn, type) of each chain; types: (symbol, type) of variables, parameters and functions."""
        at = self._roots(uses)
        sym = self.symbols.select(F.col("symbol").alias("b_symbol"), "kind", "fqn")
        at = at.join(sym, "b_symbol", "left")
        own = F.when(F.col("b_kind") == "self", F.concat_ws(".", module_name(F.col("path")), F.col("b_value")))
        at = at.withColumn("type", own).withColumn(
            "kind",
            F.when(
                F.col("b_kind").isin("self", "param", "local") & (F.col("kind").isNull() | (F.col("b_kind") != "local")), "variable",
            ).otherwise(F.col("kind")),
        )
        at = at.withColumn("fqn", F.when(F.col("kind") == "variable", F.col("b_symbol")).otherwise(F.col("fqn")))
        if types is not None:
            t = types.select(F.col("symbol").alias("__sym"), F.col("type").alias("__t"))
            at = at.join(
                t, F.coalesce(at["fqn"], at["b_symbol"]) == t["__sym"], "left",
            ).withColumn("type", F.coalesce("type", "__t")).drop("__sym", "__t")
        state = materialize(at.select("uid", "chain", "kind", "fqn", "type"), "walk")
        longest = state.agg(F.max(F.size("chain"))).first()[0] or 1
        for step in range(2, longest + 1):
            name = F.get("chain", F.lit(step - 1))
            moving = state.withColumn("part", name)
            is_call = F.col("part") == "()"
            owner = F.when(F.col("kind").isin("module", "class"), F.col("fqn")).otherwise(F.col("type"))
            moving = moving.withColumn("owner", F.when(F.col("part").isNotNull() & ~is_call, owner))
            m = members.select(
                F.col("owner").alias("m_owner"), F.col("name").alias("m_name"), F.col("kind").alias("m_kind"), F.col("fqn").alias("m_fqn"),
            )
            moved = moving.join(m, (moving["owner"] == m["m_owner"]) & (moving["part"] == m["m_name"]), "left")
            if types is not None:
                t = types.select(F.col("symbol").alias("__sym"), F.col("type").alias("__t"))
                moved = moved.join(t, moved["m_fqn"] == t["__sym"], "left")
            else:
                moved = moved.withColumn("__t", F.lit(None).cast("string"))
            called = F.when(F.col("kind") == "class", F.col("fqn")).otherwise(F.col("type"))
            state = moved.select(
                "uid", "chain",
                F.when(F.col("part").isNull(), F.col("kind")).when(is_call, F.lit("variable")).otherwise(F.col("m_kind")).alias("kind"),
                F.when(F.col("part").isNull(), F.col("fqn")).when(is_call, F.lit(None)).otherwise(F.col("m_fqn")).alias("fqn"),
                F.when(F.col("part").isNull(), F.col("type")).when(is_call, called).otherwise(F.col("__t")).alias("type"),
            )
            if step % WALKED == 0:
                state = materialize(state, "walk")
        return materialize(state.select("uid", "kind", "fqn", "type"), "walk")

    @cached_property
    def _module_members(self) -> DataFrame:
        """(owner, name, kind, fqn) of modules and of classes' own bodies."""
        return materialize(
            self.symbols.where(F.col("symbol").contains(".")).select(
                F.regexp_replace("symbol", r"\.[^.]*$", "").alias("owner"), F.regexp_extract("symbol", r"[^.]*$", 0).alias("name"), "kind",
                "fqn",
            ), "members"
        )

    @cached_property
    def supertypes(self) -> DataFrame:
        """(class, base, base_fqn): written bases in order, ``object`` left out; base_fqn is null outside the tree."""
        classes = self.defs.where("kind = 'class'").select(
            "path", "offset", "fqn", "container", F.posexplode("bases").alias("place", "base"),
        ).where("base <> 'object'")
        uses = classes.select(
            F.concat_ws(":", "path", "offset", "place").alias("uid"), "path", "container", F.split("base", r"\.").alias("chain"),
        )
        walked = self._walk(uses, self._module_members, None).where("kind = 'class'")
        keyed = classes.withColumn("uid", F.concat_ws(":", "path", "offset", "place"))
        return materialize(
            keyed.join(
                walked.select("uid", F.col("fqn").alias("base_fqn")), "uid", "left",
            ).select(F.col("fqn").alias("class"), "place", "base", "base_fqn"),
            "supers",
        )

    @cached_property
    def ancestors(self) -> DataFrame:
        """(node, ancestor, depth) over classes of the tree."""
        return pair_closure(
            self.supertypes.where("base_fqn is not null and base_fqn <> class").select(
                F.col("class").alias("src"), F.col("base_fqn").alias("dst"),
            )
        )

    @cached_property
    def members(self) -> DataFrame:
        """Members with those that classes inherit from their nearest ancestor."""
        own = self._module_members
        up = self.ancestors.join(own.withColumnRenamed("owner", "ancestor"), "ancestor").select(
            F.col("node").alias("owner"), "name", "depth", "kind", "fqn",
        )
        both = own.select("owner", "name", F.lit(0).alias("depth"), "kind", "fqn").union(up)
        return materialize(
            both.groupBy("owner", "name").agg(
                F.min(F.struct("depth", "kind", "fqn")).alias("m")
            ).select("owner", "name", "m.kind", "m.fqn"),
            "members",
        )

    @cached_property
    def types(self) -> DataFrame:
        """(symbol, type): the class that variables and parameters are instances of and that functions return."""
        named = self.bindings.where("kind in ('param', 'variable') and value is not null").select(
            "symbol", "path", "container", F.split("value", r"\.").alias("chain"),
        )
        fields = self.bindings.where("kind = 'attribute' and value is not null and name like 'self.%' and size(container) > 1")
        fields = fields.select(
            F.concat_ws(
                ".", module_name(F.col("path")), F.array_join(F.slice("container", 1, F.size("container") - 1), "."),
                F.regexp_extract("name", r"[^.]*$", 0),
            ).alias("symbol"),
            "path", "container", F.split("value", r"\.").alias("chain"),
        )
        returning = self.defs.where("kind = 'function' and returns is not null").select(
            F.col("fqn").alias("symbol"), "path", "container", F.split("returns", r"\.").alias("chain"),
        )
        asked = named.union(fields).union(returning)
        asked = materialize(
            asked.withColumn(
                "uid", F.sha2(F.concat_ws("|", "symbol", "path", F.concat_ws(".", "container"), F.concat_ws(".", "chain")), 256),
            ).dropDuplicates(["uid"]),
            "types",
        )
        types, seen, before = None, set(), None
        while before not in seen:  # a pass knows what the functions of the one before return; ends when a table comes again
            seen.add(before)
            walked = self._walk(asked.select("uid", "path", "container", "chain"), self.members, types)
            kinds = F.when(F.col("kind") == "class", F.col("fqn")).otherwise(F.col("type"))
            found = asked.join(walked, "uid").select("symbol", kinds.alias("type")).where("type is not null")
            types = materialize(found.groupBy("symbol").agg(F.min("type").alias("type")), "types")
            mark = F.xxhash64("symbol", "type").cast("decimal(38,0)")
            before = tuple(types.agg(F.count("*"), F.sum(mark), F.sum(F.xxhash64("type", "symbol").cast("decimal(38,0)"))).first())
        return types

    @cached_property
    def all_members(self) -> DataFrame:
        """Members with the attributes that methods give to ``self``."""
        fields = self.bindings.where("kind = 'attribute' and name like 'self.%' and size(container) > 1").select(
            F.concat_ws(
                ".", module_name(F.col("path")), F.array_join(F.slice("container", 1, F.size("container") - 1), "."),
            ).alias("owner"), F.regexp_extract("name", r"[^.]*$", 0).alias("name")
        ).distinct()
        fields = fields.join(self.members.select("owner", "name"), ["owner", "name"], "left_anti")
        return materialize(
            self.members.union(fields.select("owner", "name", F.lit("variable"), F.concat_ws(".", "owner", "name"))), "members",
        )

    @cached_property
    def uses(self) -> DataFrame:
        """Uses with what they resolve to: (path, line, col, offset, chain, container, is_call, module_scope, context, kind, fqn, type)."""
        u = self.tables["uses"]
        # Prefixes of a chain are uses too: obj.attr is a use of obj.
        u = u.withColumn("uid", F.concat_ws(":", "path", "offset", F.array_join("chain", ".")))
        u = materialize(u.dropDuplicates(["uid"]), "uses")
        walked = self._walk(
            u.select("uid", "path", "container", "chain"), self.all_members, self.types,
        )
        return materialize(u.join(walked, "uid", "left").drop("uid"), "uses")

    @cached_property
    def resolved(self) -> DataFrame:
        """Uses of functions and classes of the tree joined to the definition: adds def_path, def_line, def_col, def_offset, def_tag."""
        last = self.defs.where("kind in ('function', 'class')").groupBy("fqn").agg(
            F.max(F.struct("offset", "path", "line", "col", "tag", "name")).alias("d")
        )
        hit = self.uses.where("kind in ('function', 'class')").join(last, "fqn")
        return hit.select(
            "*", F.col("d.path").alias("def_path"), F.col("d.line").alias("def_line"), F.col("d.col").alias("def_col"),
            F.col("d.offset").alias("def_offset"), F.col("d.tag").alias("def_tag"),
        ).drop("d")

    @cached_property
    def function_scopes(self) -> DataFrame:
        return self.tables["scopes"].where("kind = 'function'").select(
            F.col("path").alias("__p"), F.array_join("container", ".").alias("__c"),
        ).distinct()

    def owned(self, df: DataFrame) -> DataFrame:
        """``df`` (path, container) with ``owner``: FQN of the nearest enclosing function, the module where there is none."""
        levels = F.sequence(F.size("container"), F.lit(0), F.lit(-1))
        keyed = df.withColumn("__id", F.monotonically_increasing_id())
        keyed = materialize(keyed, "owned")
        tried = keyed.select("__id", "path", "container", F.explode(levels).alias("level")).withColumn(
            "scope", F.array_join(F.slice("container", 1, F.col("level")), "."),
        )
        hit = tried.join(self.function_scopes, (tried["path"] == F.col("__p")) & (tried["scope"] == F.col("__c")))
        best = hit.groupBy("__id").agg(F.max("level").alias("__level"))
        out = keyed.join(best, "__id", "left")
        return out.withColumn(
            "owner", scope_fqn(F.col("path"), F.slice("container", 1, F.coalesce("__level", F.lit(0)))),
        ).drop("__id", "__level")

    @cached_property
    def call_edges(self) -> DataFrame:
        """(src, dst, dst_path, dst_line, dst_col, dst_kind): calls of functions and classes, and reads of properties."""
        calls = self.resolved.where("is_call or def_tag = 'property'")
        edges = self.owned(calls).select(
            F.col("owner").alias("src"), F.col("fqn").alias("dst"), F.col("def_path").alias("dst_path"),
            F.col("def_line").alias("dst_line"), F.col("def_col").alias("dst_col"), F.col("def_tag").alias("dst_kind"),
        )
        return materialize(edges.distinct(), "edges")

    @cached_property
    def override_edges(self) -> DataFrame:
        """(src, dst): from a base's method to the methods that override it."""
        methods = self.defs.where("tag in ('method', 'property')").select(
            "fqn", F.regexp_replace("fqn", r"\.[^.]*$", "").alias("class"), "name",
        )
        below = methods.select(F.col("class").alias("node"), F.col("fqn").alias("dst"), "name")
        above = methods.select(F.col("class").alias("ancestor"), F.col("fqn").alias("src"), "name")
        return materialize(
            self.ancestors.join(below, "node").join(above, ["ancestor", "name"]).select("src", "dst").distinct(), "overrides",
        )
