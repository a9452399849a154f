"""Names of modules and definitions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_parts(path: Column) -> Column:
    """Components of a path without its ``.py`` or ``.pyi`` ending."""
    bare = F.regexp_replace(path, r"\.pyi?$", "")
    return F.filter(F.split(bare, r"[/\\]"), lambda p: p != "")


def module_parts(path: Column) -> Column:
    """Components of the module of ``path``; ``__init__`` is no component anywhere."""
    return F.filter(path_parts(path), lambda p: p != "__init__")


def module_name(path: Column) -> Column:
    return F.array_join(module_parts(path), ".")


def import_module_name(path: Column) -> Column:
    """Module in the import graph: only an ``__init__`` at the end is dropped."""
    parts = path_parts(path)
    return F.array_join(
        F.when(F.element_at(parts, -1) == "__init__", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts), ".",
    )


def scope_fqn(path: Column, scope: Column) -> Column:
    """Module components and enclosing scopes; the module itself where there is no scope."""
    return F.array_join(F.concat(module_parts(path), F.coalesce(scope, F.array().cast("array<string>"))), ".")


def def_fqn(path: Column, container: Column, name: Column) -> Column:
    return F.array_join(F.concat(module_parts(path), container, F.array(name)), ".")


def leaf(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def parent(fqn: Column) -> Column:
    """All but the last component; null where there is only one."""
    return F.when(fqn.contains("."), F.regexp_replace(fqn, r"\.[^.]*$", ""))


def scoped_by(symbol: str, path: Column, container: Column) -> Column:
    """The components of ``symbol`` but its last are the end of module and container."""
    wanted = symbol.split(".")[:-1]
    if not wanted:
        return F.lit(True)
    have = F.concat(module_parts(path), container)
    tail = F.slice(have, F.greatest(F.size(have) - len(wanted) + 1, F.lit(1)), len(wanted))
    return tail == F.array(*(F.lit(w) for w in wanted))


def fqn_names(fqn: Column, symbol: str) -> Column:
    """``fqn`` is ``symbol`` or ends in it after a dot."""
    return (fqn == symbol) | fqn.endswith("." + symbol)


def location(path: str = "path", line: str = "line", col: str = "col") -> Column:
    """``path:line:col``, which is also the (textual) sort key of locations."""
    return F.concat_ws(":", path, line, col)
