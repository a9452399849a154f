"""Facts of single texts."""

from lodeweave.plans.facts import extract, is_dotted_path, parse


def rows(text, fact, path="pkg/mod.py"):
    return [r for r in extract(path, text) if r["fact"] == fact]


def test_definitions_and_signature():
    text = "@wrap(1)\ndef add(a: int,\n        b=2) -> int:\n    '''\n    Sum.\n    '''\n    return a\nclass C(Base, m.Other, metaclass=M):\n    x = 1\n    y: int = 2\n"
    found = {r["name"]: r for r in rows(text, "defs")}
    assert set(found) == {"add", "C", "x"}  # annotated assignments are no definitions
    assert found["add"]["signature"] == "(a: int, b=2) -> int"
    assert found["add"]["decorators"] == ["wrap(1)"] and found["add"]["doc"] == "Sum."
    assert (found["add"]["line"], found["add"]["col"], found["add"]["end_line"]) == (2, 5, 7)
    assert found["C"]["bases"] == ["Base", "m.Other"] and found["x"]["container"] == ["C"]


def test_positions_count_characters():
    (ref,) = [r for r in rows("s = 'éé'; foo()\n", "refs") if r["name"] == "foo"]
    assert (ref["line"], ref["col"], ref["offset"]) == (1, 11, 10)


def test_attribute_names_are_no_refs():
    assert [r["name"] for r in rows("obj.method(arg)\n", "refs")] == ["obj", "arg"]


def test_inputs():
    text = (
        "import os\na = os.getenv('A')\nb = os.environ['B']\nc = os.environ.get(name)\n'D' in os.environ\nopen('f.txt')\nopen(name)\n"
        "p.add_argument('-v', '--verbose')\np.add_argument('path')\ne = os.environ\nclass S(BaseSettings):\n    host: str\n    port: int = 1\n    plain = 3\n"
    )
    found = [(r["kind"], r["value"]) for r in rows(text, "inputs")]
    assert found == [
        ("env", "A"), ("env", "B"), ("env", "<dynamic>"), ("env", "D"), ("file", "f.txt"), ("arg", "--verbose"), ("arg", "path"), ("env", "<dynamic>"), ("setting", "host"), ("setting", "port"),
    ]


def test_import_contexts():
    text = "import a, b.c\nif TYPE_CHECKING:\n    from d import e\nelse:\n    import f\ndef g():\n    from . import h, i\n"
    found = [(r["module"], r["level"], r["names"], r["context"]) for r in rows(text, "imports")]
    assert found == [
        ("a", 0, [], "top-level"), ("b.c", 0, [], "top-level"), ("d", 0, ["e"], "type-checking"), ("f", 0, [], "top-level"), ("", 1, ["h", "i"], "deferred"),
    ]


def test_patches_exports_strings_and_guard():
    text = "__all__ = ['x', name]\npatch('a.b')\nmock.patch(t)\npatch.object(o, 'a')\nif '__main__' == __name__:\n    pass\ns = 'pkg.mod:fn'\nt = 'a b.c'\n"
    assert [r["value"] for r in rows(text, "mocks")] == ["a.b", None]
    assert [r["name"] for r in rows(text, "exports")] == ["x"]
    assert {r["value"] for r in rows(text, "dotted_strings")} == {"a.b", "pkg.mod.fn"}
    assert [r["kind"] for r in rows(text, "flags")] == ["main_guard"]


def test_broken_source_keeps_what_comes_before():
    text = "import os\nKEY = os.getenv('EARLY_KEY')\ndef alpha():\n    return 1\nclass Broken(\n"
    assert [r["value"] for r in rows(text, "inputs")] == ["EARLY_KEY"]
    assert "alpha" in {r["name"] for r in rows(text, "defs")}
    assert parse(text)[1] and [r["kind"] for r in rows(text, "flags")] == ["parse_error"]


def test_empty_and_odd_texts():
    assert extract("a.py", "") == []
    assert [r["kind"] for r in extract("a.py", "\x00") if r["fact"] == "flags"] == ["parse_error"]
    assert extract("a.py", "x = (" + "(" * 300)


def test_dotted_paths():
    assert is_dotted_path("a.b:c") == "a.b.c" and is_dotted_path("a") is None and is_dotted_path("a:b:c") is None and is_dotted_path("a.1b") is None and is_dotted_path("é.b") is None
