"""Facts of Python sources: one visit per file over the standard library's syntax tree.

``extract`` is plain Python and works on one text.  ``facts`` runs it over a
table of files as Arrow batches and gives one wide table of tagged rows, from
which ``split`` cuts the fact tables by filter and projection.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.functions.rules import effect_category
from lodeweave.schema import DYNAMIC, RAW, TABLES
from lodeweave.workspace import ship

_ENV_CALLS = {"getenv", "get_env", "get_var", "getvar", "config", "env"}
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_BATCH_ROWS = 5_000
_FIELDS = pa.schema([(name, _ARROW[kind]) for name, kind in map(str.split, RAW.split(", "))])
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def parse(text: str) -> tuple[ast.Module, str | None]:
    """(tree, error).  After a syntax error the statements before it are kept, as many as still parse."""
    try:
        return ast.parse(text), None
    except (SyntaxError, ValueError) as error:
        message = str(error)
        lines, end = text.split("\n"), (getattr(error, "lineno", None) or 1) - 1
    # Cut before the error, then before each earlier line that begins a top-level statement.
    starts = [i for i in range(min(end, len(lines)) - 1, 0, -1) if lines[i].strip() and lines[i][0] not in " \t)]}#"]
    for cut in (min(end, len(lines)), *starts):
        try:
            return ast.parse("\n".join(lines[:cut])), message
        except (SyntaxError, ValueError):
            continue
    return ast.Module([], []), message


def dotted(node: ast.AST) -> str | None:
    """``a.b.c`` of a chain of names and attributes, else null."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if not isinstance(node, ast.Name):
        return None
    return ".".join([node.id, *reversed(parts)])


def _literal(node: ast.AST | None) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def is_dotted_path(value: str) -> str | None:
    """``value`` with its one colon as a dot if it reads like ``package.module:name``, else null."""
    if len(value.encode("utf-8", "replace")) > 200 or value.count(":") > 1:
        return None
    value = value.replace(":", ".", 1)
    parts = value.split(".")
    return value if len(parts) > 1 and all(_IDENTIFIER.match(p) for p in parts) else None


def _collapsed(text: str) -> str:
    return " ".join(text.split()).replace("( ", "(").replace(" )", ")")


class _Visitor:
    def __init__(self, path: str, text: str, tree: ast.Module):
        self.path, self.lines = path, text.split("\n")
        self.bytes = [line.encode("utf-8", "replace") for line in self.lines]
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.rows: list[dict] = []
        self.scope: list[str] = []
        self.functions = self.depth = self.checking = 0
        self.kinds: list[str] = []
        self.aliases: dict[str, str] = {}
        self.block(tree.body)

    def at(self, line: int, col: int) -> dict:
        """Character position of an ``ast`` position, whose column counts bytes."""
        chars = len(self.bytes[line - 1][:col].decode("utf-8", "replace"))
        return {"line": line, "col": chars + 1, "offset": self.starts[line - 1] + chars}

    def name_at(self, node: ast.AST, name: str) -> dict:
        """Position of the name after a ``def`` or ``class`` keyword."""
        line = node.lineno
        m = re.compile(rf"\b{re.escape(name)}\b").search(
            self.lines[line - 1], len(self.bytes[line - 1][: node.col_offset].decode("utf-8", "replace")) + 3,
        )
        if m is None:
            return self.at(line, node.col_offset)
        return {"line": line, "col": m.start() + 1, "offset": self.starts[line - 1] + m.start()}

    def slice(self, node: ast.AST) -> str:
        first = self.at(node.lineno, node.col_offset)["offset"]
        last = self.at(node.end_lineno, node.end_col_offset)["offset"]
        return "\n".join(self.lines)[first:last]

    def emit(self, fact: str, **columns) -> None:
        self.rows.append({"path": self.path, "fact": fact, **columns})

    def define(self, node: ast.AST, name: str, kind: str, position: dict, **more) -> None:
        base = {"decorators": [], "bases": [], "end_line": position["line"]}
        self.emit("defs", name=name, kind=kind, container=list(self.scope), nested=self.depth > 0, **position, **(base | more))

    def bind(self, name: str, kind: str, position: dict, **more) -> None:
        self.emit("bindings", name=name, kind=kind, container=list(self.scope), line=position["line"], offset=position["offset"], **more)

    # Statements

    def block(self, body: list[ast.stmt]) -> None:
        for statement in body:
            self.statement(statement)

    def statement(self, node: ast.stmt) -> None:
        method = getattr(self, f"on_{type(node).__name__}", None)
        if method:
            method(node)
        else:
            self.children(node)

    def children(self, node: ast.AST) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.stmt):
                self.statement(child)
            elif isinstance(child, ast.expr):
                self.expression(child)
            elif isinstance(
                child,
                ast.ExceptHandler | ast.match_case | ast.withitem | ast.comprehension | ast.keyword | ast.arguments | ast.arg | ast.pattern,
            ):
                if isinstance(child, ast.ExceptHandler) and child.name:
                    self.bind(child.name, "local", self.at(child.lineno, child.col_offset))
                self.children(child)

    def on_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        position = self.name_at(node, node.name)
        signature = _collapsed("(" + self._arguments(node) + ")")
        if node.returns is not None:
            signature += " -> " + _collapsed(self.slice(node.returns))
        decorators = [_collapsed(self.slice(d)) for d in node.decorator_list]
        returns = dotted(node.returns) if node.returns is not None else None
        if returns is None and node.returns is not None:
            returns = _literal(node.returns)
        self.define(
            node, node.name, "function", position, signature=signature, decorators=decorators, doc=self._doc(node),
            end_line=node.end_lineno, returns=returns or self._returned(node),
        )
        self.bind(node.name, "function", position)
        self.depth, self.functions = self.depth + 1, self.functions + 1
        method = bool(self.kinds) and self.kinds[-1] == "class"
        owner = list(self.scope)
        self.scope.append(node.name)
        self.kinds.append("function")
        self.emit("scopes", container=list(self.scope), kind="function", name=node.name, offset=position["offset"])
        arguments = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, *filter(None, (node.args.vararg, node.args.kwarg))]
        static = any(d.split(".")[-1] == "staticmethod" for d in decorators)
        for i, a in enumerate(arguments):
            annotation = self._annotation(a.annotation)
            if method and i == 0 and annotation is None and not static:
                self.bind(a.arg, "self", self.at(a.lineno, a.col_offset), value=".".join(owner))
            else:
                self.bind(a.arg, "param", self.at(a.lineno, a.col_offset), value=annotation)
        for d in node.decorator_list:
            self.expression(d)
        self.children(node.args)
        if node.returns is not None:
            self.expression(node.returns)
        self.block(node.body)
        self.scope.pop()
        self.kinds.pop()
        self.depth, self.functions = self.depth - 1, self.functions - 1

    on_AsyncFunctionDef = on_FunctionDef

    def _arguments(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
        """Source between the parentheses of a ``def``."""
        text, offset = "\n".join(self.lines), self.name_at(node, node.name)["offset"] + len(node.name)
        begin = text.find("(", offset) + 1
        between = text[offset : begin - 1]
        if "[" in between:  # type parameters
            begin = text.find("](", offset) + 2
        level, quote, i = 1, "", begin
        while i < len(text) and level:
            c = text[i]
            if quote:
                if c == "\\":
                    i += 1
                elif text.startswith(quote, i):
                    i += len(quote) - 1
                    quote = ""
            elif c in "'\"":
                quote = c * 3 if text.startswith(c * 3, i) else c
                i += len(quote) - 1
            elif c == "#":
                i = (text.find("\n", i) + 1 or len(text)) - 1
            elif c in "([{":
                level += 1
            elif c in ")]}":
                level -= 1
            i += 1
        return text[begin : i - 1]

    @staticmethod
    def _doc(node: ast.AST) -> str | None:
        text = ast.get_docstring(node, clean=False)
        return next((line.strip() for line in (text or "").splitlines() if line.strip()), None)

    @staticmethod
    def _annotation(node: ast.AST | None) -> str | None:
        """Class an annotation names: ``X``, ``m.X``, ``"X"``, ``X | None``, ``Optional[X]``."""
        if node is None:
            return None
        if isinstance(node, ast.Constant) and isinstance(node.value, str):
            return node.value if all(_IDENTIFIER.match(p) for p in node.value.split(".")) else None
        if isinstance(node, ast.BinOp):
            return _Visitor._annotation(node.left if not isinstance(node.left, ast.Constant) else node.right)
        if isinstance(node, ast.Subscript) and (dotted(node.value) or "").split(".")[-1] == "Optional":
            return _Visitor._annotation(node.slice)
        return dotted(node)

    @staticmethod
    def _returned(node: ast.AST) -> str | None:
        """Callee of the only ``return C(...)`` of a function without nested ones."""
        found = [n.value for n in ast.walk(node) if isinstance(n, ast.Return) and n.value is not None]
        if len(found) == 1 and isinstance(found[0], ast.Call):
            return dotted(found[0].func)
        return None

    def on_ClassDef(self, node: ast.ClassDef) -> None:
        position = self.name_at(node, node.name)
        bases = [b for b in map(dotted, node.bases) if b]
        decorators = [_collapsed(self.slice(d)) for d in node.decorator_list]
        self.define(node, node.name, "class", position, bases=bases, decorators=decorators, doc=self._doc(node), end_line=node.end_lineno)
        self.bind(node.name, "class", position)
        for d in node.decorator_list:
            self.expression(d)
        for b in node.bases:
            self.expression(b)
        for k in node.keywords:
            self.expression(k.value)
        if any(b.split(".")[-1].endswith("BaseSettings") for b in bases):
            for s in node.body:
                if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name):
                    self.emit("inputs", kind="setting", value=s.target.id, **self.at(s.target.lineno, s.target.col_offset))
        self.depth += 1
        self.scope.append(node.name)
        self.kinds.append("class")
        self.emit("scopes", container=list(self.scope), kind="class", name=node.name, offset=position["offset"])
        self.block(node.body)
        self.scope.pop()
        self.kinds.pop()
        self.depth -= 1

    def on_Assign(self, node: ast.Assign) -> None:
        for target in node.targets:
            if isinstance(target, ast.Name):
                position = self.at(target.lineno, target.col_offset)
                self.define(node, target.id, "variable", position)
                called = dotted(node.value.func) if isinstance(node.value, ast.Call) else None
                self.bind(target.id, "variable", position, value=called, detail=dotted(node.value))
                if target.id == "__all__" and not self.functions and isinstance(node.value, ast.List | ast.Tuple):
                    for item in node.value.elts:
                        if _literal(item) is not None:
                            self.emit("exports", name=item.value)
            elif isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and isinstance(node.value, ast.Call):
                self.emit(
                    "bindings", name=f"{target.value.id}.{target.attr}", kind="attribute", container=list(self.scope),
                    value=dotted(node.value.func), **{k: v for k, v in self.at(target.lineno, target.col_offset).items() if k != "col"},
                )
            else:
                self.bound(target)
        value = dotted(node.value)
        if value is not None and (value == "environ" or value.endswith(".environ")):
            self.emit("inputs", kind="env", value=DYNAMIC, **self.at(node.value.lineno, node.value.col_offset))
        for target in node.targets:
            self.expression(target)
        self.expression(node.value)

    def bound(self, target: ast.AST) -> None:
        for n in ast.walk(target):
            if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store):
                self.bind(n.id, "local", self.at(n.lineno, n.col_offset))

    def on_AnnAssign(self, node: ast.AnnAssign) -> None:
        if isinstance(node.target, ast.Name):
            called = dotted(node.value.func) if isinstance(node.value, ast.Call) else None
            self.bind(
                node.target.id, "variable", self.at(node.target.lineno, node.target.col_offset),
                value=self._annotation(node.annotation) or called,
            )
        self.children(node)

    def on_For(self, node: ast.For | ast.AsyncFor) -> None:
        self.bound(node.target)
        self.children(node)

    on_AsyncFor = on_For

    def on_With(self, node: ast.With | ast.AsyncWith) -> None:
        for item in node.items:
            if item.optional_vars is not None:
                self.bound(item.optional_vars)
        self.children(node)

    on_AsyncWith = on_With

    def context(self) -> str:
        return "type-checking" if self.checking else "deferred" if self.functions else "top-level"

    def on_Import(self, node: ast.Import) -> None:
        for alias in node.names:
            position = self.at(alias.lineno, alias.col_offset)
            self.define(node, alias.asname or alias.name, "import", position)
            bound = alias.asname or alias.name.split(".")[0]
            self.bind(bound, "module", position, module=alias.name if alias.asname else bound, level=0)
            self.emit(
                "imports", module=alias.name, level=0, names=[], context=self.context(), line=node.lineno,
                col=self.at(node.lineno, node.col_offset)["col"],
            )

    def on_ImportFrom(self, node: ast.ImportFrom) -> None:
        for alias in node.names:
            position = self.at(alias.lineno, alias.col_offset)
            self.define(node, alias.asname or alias.name, "import", position)
            self.bind(alias.asname or alias.name, "from", position, module=node.module or "", level=node.level, value=alias.name)
        self.emit(
            "imports", module=node.module or "", level=node.level, names=[a.name for a in node.names], context=self.context(),
            line=node.lineno, col=self.at(node.lineno, node.col_offset)["col"],
        )

    def on_If(self, node: ast.If) -> None:
        test = node.test
        if self.depth == 0 and isinstance(test, ast.Compare) and isinstance(test.ops[0], ast.Eq):
            sides = (test.left, test.comparators[0])
            if any(isinstance(a, ast.Name) and a.id == "__name__" and _literal(b) == "__main__" for a, b in (sides, sides[::-1])):
                self.emit("flags", kind="main_guard", flag=True)
        name = dotted(test)
        guard = name is not None and name.split(".")[-1] == "TYPE_CHECKING"
        self.expression(test)
        self.checking += guard
        self.block(node.body)
        self.checking -= guard
        self.block(node.orelse)

    def on_Global(self, node: ast.Global) -> None:
        if self.functions:
            self.emit(
                "effects", kind="global", detail=", ".join(node.names), container=list(self.scope), import_time=False, **self._place(node),
            )

    def _place(self, node: ast.AST) -> dict:
        return {k: v for k, v in self.at(node.lineno, node.col_offset).items() if k != "offset"}

    # Expressions

    def expression(self, node: ast.AST) -> None:
        if isinstance(node, ast.Call):
            self.call(node)
        elif isinstance(node, ast.Name):
            if isinstance(node.ctx, ast.Load):
                self.reference(node, False)
                self.use([node.id], node, False)
        elif isinstance(node, ast.Attribute):
            chain = dotted(node)
            if chain is not None:
                self.use(chain.split("."), node, False, store=not isinstance(node.ctx, ast.Load))
                root = node
                while isinstance(root, ast.Attribute):
                    root = root.value
                self.reference(root, False)
            else:
                self.expression(node.value)
        elif isinstance(node, ast.Subscript):
            name = dotted(node.value)
            if name is not None and (name == "environ" or name.endswith(".environ")):
                self.emit("inputs", kind="env", value=_literal(node.slice) or DYNAMIC, **self.at(node.lineno, node.col_offset))
                self.emit(
                    "effects", kind="env", detail=name, container=list(self.scope), import_time=not self.functions, **self._place(node),
                )
            self.children(node)
        elif isinstance(node, ast.Compare):
            if isinstance(node.ops[0], ast.In | ast.NotIn):
                name = dotted(node.comparators[0])
                if name is not None and (name == "environ" or name.endswith(".environ")):
                    self.emit("inputs", kind="env", value=_literal(node.left) or DYNAMIC, **self.at(node.lineno, node.col_offset))
            self.children(node)
        elif isinstance(node, ast.Constant):
            if isinstance(node.value, str):
                path = is_dotted_path(node.value)
                if path is not None:
                    self.emit("dotted_strings", value=path)
        elif isinstance(node, ast.NamedExpr):
            self.bound(node.target)
            self.children(node)
        elif isinstance(node, ast.Lambda | ast.ListComp | ast.SetComp | ast.DictComp | ast.GeneratorExp):
            for comprehension in getattr(node, "generators", []):
                self.bound(comprehension.target)
            self.children(node)
        else:
            self.children(node)

    def reference(self, node: ast.Name, call: bool) -> None:
        self.emit(
            "refs", name=node.id, is_call=call, module_scope=not self.functions, container=list(self.scope),
            **self.at(node.lineno, node.col_offset),
        )

    def use(self, chain: list[str], node: ast.AST, call: bool, store: bool = False) -> None:
        last = self.at(node.end_lineno, node.end_col_offset)
        position = {"line": last["line"], "col": last["col"] - len(chain[-1]), "offset": last["offset"] - len(chain[-1])}
        self.emit(
            "uses", chain=chain, is_call=call, module_scope=not self.functions, container=list(self.scope),
            context="store" if store else "load", **position,
        )

    def call(self, node: ast.Call) -> None:
        name = dotted(node.func)
        if isinstance(node.func, ast.Name):
            self.reference(node.func, True)
            self.use([node.func.id], node.func, True)
        elif name is not None:
            self.use(name.split("."), node.func, True)
            root = node.func
            while isinstance(root, ast.Attribute):
                root = root.value
            self.reference(root, False)
        else:
            if isinstance(node.func, ast.Attribute) and isinstance(node.func.value, ast.Call):
                inner = dotted(node.func.value.func)
                if inner is not None:  # m(...).attr(...): the receiver is what m makes
                    last = self.at(node.func.end_lineno, node.func.end_col_offset)
                    self.emit("uses", chain=[*inner.split("."), "()", node.func.attr], is_call=True, module_scope=not self.functions, container=list(self.scope), context="load",
                              line=last["line"], col=last["col"] - len(node.func.attr), offset=last["offset"] - len(node.func.attr))
            self.expression(node.func)
        if name is not None:
            self.inputs(node, name)
            self.emit("effects", kind=None, detail=name, container=list(self.scope), import_time=not self.functions, **self._place(node))
            if name == "patch" or name.endswith(".patch"):
                self.emit("mocks", value=_literal(node.args[0]) if node.args else None, **self._place(node))
        for a in node.args:
            self.expression(a)
        for k in node.keywords:
            self.expression(k.value)

    def inputs(self, node: ast.Call, name: str) -> None:
        parts, first = name.split("."), _literal(node.args[0]) if node.args else None
        place = self.at(node.lineno, node.col_offset)
        env = parts[-1] in _ENV_CALLS or (len(parts) > 1 and parts[-2] == "env")
        if env or name.endswith(("environ.get", "environ.setdefault")):
            literal = next((v for v in map(_literal, node.args) if v is not None), None) if env or first is None else first
            self.emit("inputs", kind="env", value=literal if literal is not None else DYNAMIC, **place)
        elif name in ("open", "io.open") and first is not None:
            self.emit("inputs", kind="file", value=first, **place)
        elif name.endswith((".add_argument", ".option", ".argument")):
            literals = [v for v in map(_literal, node.args) if v is not None]
            if literals:
                long = [v for v in literals if v.startswith("--")]
                self.emit("inputs", kind="arg", value=max(long, key=len) if long else literals[0], **place)


def extract(path: str, text: str) -> list[dict]:
    """Tagged fact rows of one file; a row ``flags/parse_error`` tells that only a part was read."""
    tree, error = parse(text)
    try:
        rows = _Visitor(path, text, tree).rows
    except RecursionError:
        rows, error = [], "nested too deeply"
    if error:
        rows.append({"path": path, "fact": "flags", "kind": "parse_error", "flag": True, "detail": error})
    return rows


def facts(files: DataFrame) -> DataFrame:
    """Tagged fact rows of ``files`` (path, text).  Effects without a category are dropped here, by expression."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for path, text in zip(batch.column(0), batch.column(1), strict=True):
                if path.is_valid:
                    held += extract(path.as_py(), text.as_py() or "")
                if len(held) >= _BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema=_FIELDS)
                    held = []
        yield pa.RecordBatch.from_pylist(held, schema=_FIELDS)

    ship(files.sparkSession)
    raw = files.select("path", "text").mapInArrow(run, RAW)
    category = F.coalesce("kind", effect_category(F.col("detail")))
    return raw.withColumn(
        "kind", F.when(F.col("fact") == "effects", category).otherwise(F.col("kind")),
    ).where("fact <> 'effects' OR kind IS NOT NULL")


def split(raw: DataFrame) -> dict[str, DataFrame]:
    """The fact tables of ``raw`` by name."""
    return {name: raw.where(F.col("fact") == name).select(*columns.split(", ")) for name, columns in TABLES.items()}
