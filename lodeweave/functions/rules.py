"""Ordered rules that name the effect of a dotted callee, as data, as a Column and as a plain function.

Fixed values: the names below are those of Python's and its ecosystem's APIs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (category, exact names, suffixes, substrings); the first rule that matches counts.
#: A suffix that begins with a dot also matches the bare name after the dot.
EFFECT_RULES: list[tuple[str, list[str], list[str], list[str]]] = [
    ("env", ["getenv"], [".getenv", ".environ.get", ".environ.setdefault", ".putenv", ".setenv", ".unsetenv"], []),
    ("subprocess", [], [".system", ".popen", ".execv", ".execve", ".execvp", ".spawnl", ".spawnv"], ["subprocess."]),
    ("network", [], [".urlopen", ".socket"], ["requests.", "httpx.", "aiohttp.", "urllib.request", "socket.", "http.client"]),
    (
        "fs",
        ["open"],
        [
            "io.open", ".read_text", ".write_text", ".read_bytes", ".write_bytes", "os.remove", "os.unlink", "os.mkdir", "os.makedirs",
            "os.rmdir", "os.rename", "os.replace",
        ],
        ["shutil."],
    ),
    (
        "db",
        [],
        [".execute", ".executemany", ".executescript", ".fetchone", ".fetchall", "sqlite3.connect", "psycopg2.connect", "pymysql.connect"],
        [".objects.", "sqlalchemy."],
    ),
    ("random", [], ["os.urandom", ".uuid4", ".uuid1"], ["random.", "secrets.", "uuid."]),
    (
        "clock",
        [],
        [
            "time.time", "time.monotonic", "time.perf_counter", "time.process_time", "time.sleep", "time.gmtime", "time.localtime", ".now",
            ".utcnow", ".today", ".fromtimestamp",
        ],
        [],
    ),
]

#: Audit events of a running interpreter by category: exact names, then prefixes.
EVENT_CATEGORIES: dict[str, list[str]] = {
    "fs": [
        "open", "os.open", "os.mkdir", "os.rmdir", "os.remove", "os.unlink", "os.rename", "os.replace", "os.chmod", "os.chown", "os.truncate", "os.scandir",
        "shutil.copyfile", "shutil.move", "shutil.rmtree", "tempfile.mkstemp",
    ],
    "subprocess": ["os.system", "os.fork", "os.forkpty", "subprocess.Popen"],
    "db": ["sqlite3.connect", "sqlite3.connect/handle"],
    "env": ["os.putenv", "os.unsetenv"],
    "import": ["import"],
    "network": ["urllib.Request"],
}
EVENT_PREFIXES: dict[str, str] = {
    "os.exec": "subprocess", "os.spawn": "subprocess", "os.posix_spawn": "subprocess", "socket.": "network", "ssl.": "network",
}


def _ends(callee: Column, suffix: str) -> Column:
    return callee.endswith(suffix) | (callee == suffix.lstrip("."))


def effect_category(callee: Column) -> Column:
    """Category of a dotted callee, null if no rule matches."""
    out = F.lit(None).cast("string")
    for category, exact, endings, parts in reversed(EFFECT_RULES):
        hit = F.lit(False)
        for name in exact:
            hit = hit | (callee == name)
        for ending in endings:
            hit = hit | _ends(callee, ending)
        for part in parts:
            hit = hit | callee.contains(part)
        out = F.when(hit, F.lit(category)).otherwise(out)
    return out


def event_category(event: Column) -> Column:
    """Category of an audit event: by exact name, else by the longest prefix; null if neither."""
    out = F.lit(None).cast("string")
    for prefix in sorted(EVENT_PREFIXES, key=len):
        out = F.when(event.startswith(prefix), F.lit(EVENT_PREFIXES[prefix])).otherwise(out)
    for category, names in EVENT_CATEGORIES.items():
        out = F.when(event.isin(names), F.lit(category)).otherwise(out)
    return out
