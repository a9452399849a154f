"""Predicates over paths, names and definitions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names that every module has without defining them; fixed values.
BUILTINS = (
    "input open print len range exit quit vars eval exec compile id hash repr format isinstance getattr setattr hasattr delattr next iter super type object".split()
)
#: Base names of files that a framework or tool loads by itself; fixed values.
ENTRY_FILES = "manage wsgi asgi conftest setup urls settings".split()


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def file_matches(path: Column, target: str) -> Column:
    """``target`` is the path, its base name or its stem, or has a slash and ends the path."""
    base = basename(path)
    hit = (path == target) | (base == target) | (F.regexp_replace(base, r"\.[^.]*$", "") == target)
    return hit | path.endswith("/" + target) if "/" in target else hit


def is_test_file(path: Column) -> Column:
    base = basename(path)
    return base.startswith("test_") | base.endswith("_test.py")


def is_test_name(name: Column) -> Column:
    return name.startswith("test")


def has_test_case_base(bases: Column) -> Column:
    return F.exists(F.coalesce(bases, F.array().cast("array<string>")), lambda b: F.element_at(F.split(b, r"\."), -1).endswith("TestCase"))


def is_dunder(name: Column) -> Column:
    return name.startswith("__") & name.endswith("__") & (F.length(name) > 4)


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def _management_command(path: Column) -> Column:
    return F.concat(F.lit("/"), path).contains("/management/commands/")


def is_entry_file(path: Column) -> Column:
    """Loaded by a framework or tool: by name, or in migrations, settings, management commands, scripts or bin."""
    folders = F.slice(_parts(path), 1, F.greatest(F.size(_parts(path)) - 1, F.lit(0)))
    by_name = basename(path).isin([f"{n}.py" for n in ENTRY_FILES])
    return by_name | F.arrays_overlap(
        folders, F.array(F.lit("migrations"), F.lit("settings")),
    ) | _management_command(path) | path.rlike(r"^(scripts|bin)/")


def is_script_file(path: Column, has_main_guard: Column) -> Column:
    """Run by itself rather than imported."""
    base = basename(path)
    return (base != "__init__.py") & (has_main_guard | (base == "manage.py") | _management_command(path) | path.rlike(r"^(scripts|bin)/"))


def in_test_tree(path: Column) -> Column:
    return is_test_file(path) | F.arrays_overlap(_parts(path), F.array(F.lit("tests"), F.lit("test"))) | (basename(path) == "conftest.py")


def is_public_surface(kind: Column, container: Column, nested: Column, name: Column) -> Column:
    """A function or class at module level whose name has no leading underscore."""
    return kind.isin("function", "class") & (F.size(container) == 0) & ~nested & ~name.startswith("_")
