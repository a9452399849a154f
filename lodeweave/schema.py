"""Fact tables of a source tree.  Lines and columns count from 1, columns and offsets in characters."""

from __future__ import annotations

#: Bumped whenever a stored fact table changes meaning.
SCHEMA_VERSION = 1

FILES = "path string, module string, is_pkg boolean, size bigint, mtime timestamp, sha string, has_main_guard boolean, text string, parse_error string"

#: Every fact row carries the columns of all kinds; ``fact`` says which table it belongs to.
RAW = (
    "path string, fact string, name string, kind string, line int, col int, offset int, container array<string>, nested boolean, "
    "bases array<string>, decorators array<string>, signature string, doc string, end_line int, is_call boolean, module_scope boolean, "
    "value string, module string, level int, names array<string>, context string, detail string, import_time boolean, chain array<string>, "
    "returns string, flag boolean"
)

TABLES = {
    "defs": "path, name, kind, line, col, offset, container, nested, bases, decorators, signature, doc, end_line, returns",
    "refs": "path, name, line, col, offset, is_call, module_scope, container",
    "inputs": "path, kind, value, line, col, offset",
    "imports": "path, module, level, names, context, line, col",
    "effects": "path, kind, detail, line, col, container, import_time",
    "mocks": "path, value, line, col",
    "exports": "path, name",
    "dotted_strings": "path, value",
    "bindings": "path, name, kind, line, offset, container, module, level, value, detail",
    "uses": "path, chain, line, col, offset, is_call, container, module_scope, context",
    "scopes": "path, container, kind, name, offset",
    "flags": "path, kind, flag, detail",
}

DEF_KINDS = ("function", "class", "variable", "import")
INPUT_KINDS = ("env", "file", "arg", "setting")
EFFECT_KINDS = ("fs", "network", "subprocess", "env", "db", "random", "clock", "global")
IMPORT_CONTEXTS = ("top-level", "type-checking", "deferred")
#: Value of an input that is computed at run time.
DYNAMIC = "<dynamic>"
#: Categories that the runtime ledger can observe.
AUDITABLE = ("fs", "network", "subprocess", "db")
