"""Source trees as tables: a Python data source over a folder, and project settings read on the driver.

Spark's own file sources skip names that begin with an underscore, among them
``__init__.py``, so the walk is done here: the driver lists paths, tasks read
them.  A corpus of sources that is already a table of (path, text) needs none
of this.
"""

from __future__ import annotations

import hashlib
import os
import re
import subprocess
import tomllib
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodeweave.workspace import ship

_SCHEMA = "path string, size bigint, mtime timestamp, sha string, text string"


def ignore_rules(text: str) -> list[tuple[re.Pattern, bool, bool]]:
    """(pattern over paths relative to the file's folder, negated, folders only) of a ``.gitignore`` text, in order."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:].removeprefix("\\")
        folder = line.endswith("/")
        line = line.rstrip("/")
        anchored = "/" in line
        out, i = "", 0
        line = line.lstrip("/")
        while i < len(line):
            if line.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif line.startswith("**", i):
                out, i = out + ".*", i + 2
            elif line[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif line[i] == "?":
                out, i = out + "[^/]", i + 1
            elif line[i] == "[" and "]" in line[i + 1 :]:
                end = line.index("]", i + 1)
                out, i = out + "[" + line[i + 1 : end].replace("!", "^", 1) + "]", end + 1
            else:
                out, i = out + re.escape(line[i]), i + 1
        rules.append((re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z"), negated, folder))
    return rules


def walk(root: str) -> Iterator[str]:
    """Relative paths of ``.py`` and ``.pyi`` files: no hidden names, nothing ignored, sorted; errors are skipped."""

    def ignored(rel: str, is_dir: bool, levels: list[tuple[str, list]]) -> bool:
        out = False
        for base, rules in levels:
            local = rel[len(base) :].lstrip("/") if base else rel
            for pattern, negated, folder in rules:
                if (is_dir or not folder) and pattern.match(local):
                    out = not negated
        return out

    def visit(rel: str, levels: list) -> Iterator[str]:
        here = os.path.join(root, rel)
        try:
            names = sorted(os.listdir(here))
        except OSError:
            return
        if ".gitignore" in names:
            try:
                with open(os.path.join(here, ".gitignore"), encoding="utf-8", errors="replace") as f:
                    levels = [*levels, (rel, ignore_rules(f.read()))]
            except OSError:
                pass
        for name in names:
            path = f"{rel}/{name}" if rel else name
            if name.startswith("."):
                continue
            is_dir = os.path.isdir(os.path.join(root, path))
            if ignored(path, is_dir, levels):
                continue
            if is_dir:
                yield from visit(path, levels)
            elif name.endswith((".py", ".pyi")):
                yield path

    yield from visit("", [])


class _Part(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.per_task = options["path"], int(options.get("filesPerTask", 512))

    def partitions(self) -> list[InputPartition]:
        paths = list(walk(self.root))
        return [_Part(paths[i : i + self.per_task]) for i in range(0, len(paths), self.per_task)] or [_Part([])]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for path in partition.paths:
            full = os.path.join(self.root, path)
            try:
                with open(full, "rb") as f:
                    data = f.read()
                stat = os.stat(full)
                text = data.decode("utf-8")
            except (OSError, UnicodeDecodeError):
                continue
            yield path, len(data), datetime.fromtimestamp(stat.st_mtime, UTC), hashlib.sha256(data).hexdigest(), text


class PythonTree(DataSource):
    """``spark.read.format("python-tree").load(folder)``; option ``filesPerTask``.  Unreadable files are skipped."""

    @classmethod
    def name(cls) -> str:
        return "python-tree"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime, sha, text) of the Python files under ``root``."""
    ship(spark)
    spark.dataSource.register(PythonTree)
    return spark.read.format("python-tree").load(root)


def _project(root: str) -> dict:
    try:
        with open(os.path.join(root, "pyproject.toml"), "rb") as f:
            return tomllib.load(f)
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError):
        return {}


def source_roots(root: str) -> list[str]:
    """The ``pythonpath`` entries of pytest's settings, without the root itself; none on any failure."""
    found = _project(root).get("tool", {})
    for key in ("pytest", "ini_options"):
        found = found.get(key, {}) if isinstance(found, dict) else {}
    value = found.get("pythonpath", []) if isinstance(found, dict) else []
    values = value.split() if isinstance(value, str) else [v for v in value if isinstance(v, str)] if isinstance(value, list) else []
    return [v.removeprefix("./").strip("/") for v in values if v.strip("/") not in ("", ".")]


def console_targets(root: str) -> list[str]:
    """``module.object`` of the project's console scripts; entries without a colon are passed over."""
    project = _project(root)
    tables = [project.get("project", {}).get("scripts", {}), project.get("tool", {}).get("poetry", {}).get("scripts", {})]
    values = [v for t in tables if isinstance(t, dict) for v in t.values() if isinstance(v, str)]
    return [v.split("[")[0].strip().replace(":", ".", 1) for v in values if ":" in v]


def git_diff(root: str, base: str) -> list[str]:
    """Lines of the zero-context diff of Python files against ``base``; paths are relative to ``root``."""
    command = ["git", "-C", root, "diff", "--unified=0", "--no-color", "--relative", base, "--", "*.py"]
    done = subprocess.run(command, capture_output=True, text=True, check=False)
    if done.returncode:
        raise ValueError(f"git diff failed: {done.stderr.strip()}")
    return done.stdout.splitlines()
