"""The graph and relational operators applied to the driver's tables, each with the same query in SQL.

The edge table E follows parts through orders: the lines of an order in the
order of (line number, part, supplier, quantity, price) give an edge from the
part of the line before to the part of a returned line of high quantity.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeweave.functions import predicates
from lodeweave.functions.ids import def_fqn, fqn_names, import_module_name, module_name, scoped_by
from lodeweave.functions.rules import effect_category, event_category
from lodeweave.operators.components import joined_to
from lodeweave.operators.fusion import counts_by, coverage_totals, covered_lines, fill_header, first_by, first_match, fuse, multiset_digest, sole_value
from lodeweave.operators.graph import LOCAL_EDGES, callers_of, closure, cycles, most_used, pair_closure, reachable, reversed_edges, strong_components, unreached
from lodeweave.operators.joins import longest_prefix_join, prefix_semi_join, unique_suffix_table
from lodeweave.sources.store import snapshot_diff
from lodeweave.workspace import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_edges(spark: SparkSession, sf_dir: str, quantity: int = 47) -> DataFrame:
    """E: distinct (src, dst) of returned lines of at least ``quantity``."""
    over = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = _table(spark, sf_dir, "lineitem").withColumn("src", F.lag("l_partkey").over(over))
    kept = lines.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= quantity) & (F.col("src") != F.col("l_partkey")))
    return materialize(kept.select("src", F.col("l_partkey").alias("dst")).distinct(), "edges")


def _e(quantity: int = 47, name: str = "e") -> str:
    return f"""{name} AS MATERIALIZED (SELECT DISTINCT src, dst FROM (
  SELECT lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS src,
         l_partkey AS dst, l_returnflag, l_quantity FROM lineitem)
  WHERE l_returnflag = 'R' AND l_quantity >= {quantity} AND src <> dst)"""


def q01_closure_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes reached from the smallest source within 4 edges, with depth."""
    e = part_edges(spark, sf_dir)
    return closure(e, e.agg(F.min("src").alias("node")), 4).select("node", "depth")


SQL_Q01 = f"""WITH RECURSIVE {_e()}, r(node, depth) AS (
  SELECT min(src), 0 FROM e UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 4)
SELECT node, min(depth) AS depth FROM r GROUP BY node HAVING min(depth) > 0"""


def q02_closure_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that reach the largest target within 4 edges."""
    e = part_edges(spark, sf_dir)
    return closure(reversed_edges(e), e.agg(F.max("dst").alias("node")), 4).select("node", "depth")


SQL_Q02 = f"""WITH RECURSIVE {_e()}, r(node, depth) AS (
  SELECT max(dst), 0 FROM e UNION SELECT e.src, depth + 1 FROM r JOIN e ON e.dst = r.node WHERE depth < 4)
SELECT node, min(depth) AS depth FROM r GROUP BY node HAVING min(depth) > 0"""


def q03_closure_via(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth and the smallest parent one edge nearer, from the source of most edges."""
    e = part_edges(spark, sf_dir)
    root = e.groupBy("src").count().agg(
        F.max(F.struct("count", (-F.col("src")).alias("s"))).alias("m")
    ).select((-F.col("m.s")).alias("node"))
    return closure(e, root, 8)


SQL_Q03 = f"""WITH RECURSIVE {_e()}, r(node, depth) AS (
  SELECT (SELECT src FROM e GROUP BY src ORDER BY count(*) DESC, src LIMIT 1), 0
  UNION SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 8),
d AS (SELECT node, min(depth) AS depth FROM r GROUP BY node)
SELECT d.node, d.depth, min(p.node) AS via FROM d JOIN e ON e.dst = d.node JOIN d p ON p.node = e.src AND p.depth = d.depth - 1
GROUP BY d.node, d.depth"""


def q01b_closure_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q01 in distributed rounds, as graphs too large for one task are walked."""
    e = part_edges(spark, sf_dir)
    return closure(e, e.agg(F.min("src").alias("node")), 4, local_edges=0).select("node", "depth")


def _brand_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").where("p_brand = 'Brand#13'").select(F.col("p_partkey").alias("node"))


def q04_reachable_extra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts reached from one brand over E and over links to the next part of the same name."""
    part = _table(spark, sf_dir, "part")
    nxt = part.select(
        F.col("p_partkey").alias("src"),
        F.lead("p_partkey").over(Window.partitionBy("p_name", "p_brand").orderBy("p_partkey")).alias("dst"),
    )
    return reachable(part_edges(spark, sf_dir), _brand_seeds(spark, sf_dir), nxt.where("dst is not null"))


SQL_Q04 = f"""WITH RECURSIVE {_e()}, x AS (
  SELECT src, dst FROM e UNION SELECT p_partkey, lead(p_partkey) OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) FROM part),
r(node) AS (SELECT p_partkey FROM part WHERE p_brand = 'Brand#13' UNION SELECT x.dst FROM r JOIN x ON x.src = r.node WHERE x.dst IS NOT NULL)
SELECT node FROM r"""


def q04b_reachable_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts reached from one brand over E, in distributed rounds."""
    return reachable(part_edges(spark, sf_dir), _brand_seeds(spark, sf_dir), local_edges=0)


SQL_Q04B = f"""WITH RECURSIVE {_e()}, r(node) AS (
  SELECT p_partkey FROM part WHERE p_brand = 'Brand#13' UNION SELECT e.dst FROM r JOIN e ON e.src = r.node)
SELECT node FROM r"""


def q05_dead_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no part of the brand reaches."""
    live = reachable(part_edges(spark, sf_dir), _brand_seeds(spark, sf_dir))
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return part.join(live, part["p_partkey"] == live["node"], "left_anti")


SQL_Q05 = f"""WITH RECURSIVE {_e()}, r(node) AS (
  SELECT p_partkey FROM part WHERE p_brand = 'Brand#13' UNION SELECT e.dst FROM r JOIN e ON e.src = r.node)
SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.node = p_partkey)"""


def q06_dead_subsumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers without a line of a reached part, unless their whole nation has none."""
    live = reachable(part_edges(spark, sf_dir), _brand_seeds(spark, sf_dir))
    lines = _table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select("l_partkey", "l_suppkey")
    used = lines.join(live, lines["l_partkey"] == live["node"], "left_semi").select("l_suppkey").distinct()
    key = lambda letter, column: F.concat(F.lit(letter), F.col(column).cast("string"))
    supplier = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", key("s", "s_suppkey").alias("fqn"), key("n", "s_nationkey").alias("owner"))
    nations = supplier.select(F.lit(None).cast("bigint").alias("s_suppkey"), "s_nationkey", F.col("owner").alias("fqn"), F.lit("").alias("owner")).distinct()
    reached = supplier.join(used, supplier["s_suppkey"] == used["l_suppkey"], "left_semi")
    reached = reached.select(F.col("fqn").alias("node")).union(reached.select("owner")).distinct()
    return unreached(supplier.union(nations), reached, "fqn", "owner").where("s_suppkey is not null").select("s_suppkey", "s_nationkey")


SQL_Q06 = f"""WITH RECURSIVE {_e()}, r(node) AS (
  SELECT p_partkey FROM part WHERE p_brand = 'Brand#13' UNION SELECT e.dst FROM r JOIN e ON e.src = r.node),
used AS (SELECT DISTINCT l_suppkey FROM lineitem WHERE l_quantity >= 49 AND l_partkey IN (SELECT node FROM r)),
alive AS (SELECT DISTINCT s_nationkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM used))
SELECT s_suppkey, s_nationkey FROM supplier
WHERE s_suppkey NOT IN (SELECT l_suppkey FROM used) AND s_nationkey IN (SELECT s_nationkey FROM alive)"""


def q07_most_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 30 parts of most distinct suppliers outside one brand."""
    skip = _table(spark, sf_dir, "part").where("p_brand = 'Brand#13'").select(F.concat(F.lit("p"), "p_partkey").alias("node"))
    lines = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    uses = callers_of(lines, None, skip).select(F.substring("node", 2, 20).cast("bigint").alias("node"), "uses")
    return most_used(uses, 2, 30).withColumnRenamed("node", "l_partkey")


SQL_Q07 = """SELECT l_partkey, count(DISTINCT l_suppkey) AS uses FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#13')
GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) >= 2 ORDER BY uses DESC, l_partkey LIMIT 30"""


def q08_strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on cycles with the smallest node of their component."""
    return strong_components(part_edges(spark, sf_dir, 44))


SQL_Q08 = f"""WITH RECURSIVE {_e(44)}, p(a, b) AS (SELECT src, dst FROM e UNION SELECT p.a, e.dst FROM p JOIN e ON e.src = p.b)
SELECT x.a AS node, min(x.b) AS component FROM p x JOIN p y ON y.a = x.b AND y.b = x.a GROUP BY x.a"""


def q08c_strong_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q08 in distributed rounds."""
    return strong_components(part_edges(spark, sf_dir, 44), local_edges=0)


def q08b_cycle_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components with their sizes; a representative cycle is one of its columns' own check."""
    found = cycles(part_edges(spark, sf_dir, 44))
    return found.select(
        "component", F.col("size").cast("long").alias("size"), (F.element_at("path", 1) >= F.col("component")).alias("path_ok"),
    )


SQL_Q08B = f"""WITH RECURSIVE {_e(44)}, p(a, b) AS (SELECT src, dst FROM e UNION SELECT p.a, e.dst FROM p JOIN e ON e.src = p.b),
m AS (SELECT x.a AS node, min(x.b) AS component FROM p x JOIN p y ON y.a = x.b AND y.b = x.a GROUP BY x.a)
SELECT component, count(*) AS size, true AS path_ok FROM m GROUP BY component"""


def q09_subclasses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything below each region of the tree region, nation, customer and supplier, with depth."""
    nation = _table(spark, sf_dir, "nation")
    key = lambda letter, column: F.concat(F.lit(letter + ":"), F.col(column).cast("string"))
    edges = nation.select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst"))
    for table, column, letter, parent in (("customer", "c_custkey", "c", "c_nationkey"), ("supplier", "s_suppkey", "s", "s_nationkey")):
        edges = edges.union(_table(spark, sf_dir, table).select(key("n", parent), key(letter, column)))
    roots = _table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("node"))
    return closure(materialize(edges, "tree"), roots)


SQL_Q09 = """SELECT 'n:' || n_nationkey AS node, 1 AS depth, 'r:' || n_regionkey AS via FROM nation
UNION ALL SELECT 'c:' || c_custkey, 2, 'n:' || c_nationkey FROM customer
UNION ALL SELECT 's:' || s_suppkey, 2, 'n:' || s_nationkey FROM supplier"""


def q10_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers in a tree (key without its last digit is the parent) joined to ancestors of the same segment."""
    customer = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    tree = customer.where("c_custkey >= 10").select(F.col("c_custkey").alias("src"), F.floor(F.col("c_custkey") / 10).alias("dst"))
    pairs = pair_closure(tree)
    up = customer.select(F.col("c_custkey").alias("ancestor"), F.col("c_mktsegment").alias("segment"))
    both = pairs.join(customer, pairs["node"] == customer["c_custkey"]).join(up, "ancestor")
    return both.where("c_mktsegment = segment").select("node", "ancestor", "segment", "depth")


SQL_Q10 = """WITH RECURSIVE p(node, ancestor, depth) AS (
  SELECT c_custkey, c_custkey // 10, 1 FROM customer WHERE c_custkey >= 10
  UNION ALL SELECT node, ancestor // 10, depth + 1 FROM p WHERE ancestor >= 10)
SELECT node, ancestor, a.c_mktsegment AS segment, depth FROM p JOIN customer c ON c.c_custkey = node JOIN customer a ON a.c_custkey = ancestor
WHERE a.c_mktsegment = c.c_mktsegment"""


def q11_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first rule that a text meets, counted by label and language."""
    t = F.col("text")
    label = first_match(
        [
            (t.contains("License"), "license"), (t.contains("@"), "address"), (t.contains("!!"), "shout"), (t.contains(" | "), "table"),
            (F.length(t) < 200, "short"),
        ],
        F.concat(F.lit("text-"), F.col("lang")),
    )
    docs = _table(spark, sf_dir, "documents").select(label.alias("label"), "lang")
    return docs.groupBy("label", "lang").agg(F.count("*").alias("n"))


SQL_Q11 = """SELECT CASE WHEN contains(text, 'License') THEN 'license' WHEN contains(text, '@') THEN 'address' WHEN contains(text, '!!') THEN 'shout'
  WHEN contains(text, ' | ') THEN 'table' WHEN length(text) < 200 THEN 'short' ELSE 'text-' || lang END AS label, lang, count(*) AS n
FROM documents GROUP BY ALL"""


def q12_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the key read from each event's properties, ``<dynamic>`` where there is none."""
    events = _table(spark, sf_dir, "events")
    return events.select(
        "event_id", F.col("event_type").alias("kind"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("<dynamic>")).alias("value"),
    )


SQL_Q12 = "SELECT event_id, event_type AS kind, coalesce(json_extract_string(props, '$.k'), '<dynamic>') AS value FROM events"


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


def q13_link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links of pages, internal if the target is a dotted package of a host."""
    pages = _table(spark, sf_dir, "pages")
    hosts = pages.select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host")).distinct()
    links = _links(spark, sf_dir).select("page_id", "target", F.regexp_replace("target", "^/", "").alias("name")).distinct()
    return prefix_semi_join(links, "name", hosts, "host", "internal").select("page_id", "target", "internal")


SQL_Q13 = r"""WITH hosts AS (SELECT DISTINCT string_split(regexp_extract(url, '^https?://([^/?#]+)', 1), '.') AS h FROM pages),
known AS (SELECT DISTINCT array_to_string(h[1:i], '.') AS k FROM (SELECT h, unnest(range(1, len(h) + 1)) AS i FROM hosts)),
links AS (SELECT DISTINCT page_id, target FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages))
SELECT page_id, target, regexp_replace(target, '^/', '') IN (SELECT k FROM known) AS internal FROM links"""


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host")).distinct()


def q14_unique_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts without their first label, matched to the only host that ends so."""
    hosts = _hosts(spark, sf_dir)
    spelled = hosts.select(F.regexp_replace("host", r"^[^.]*\.", "").alias("spelling")).distinct()
    return spelled.join(unique_suffix_table(hosts, "host"), "spelling", "left").select("spelling", F.col("id").alias("host"), "matches")


SQL_Q14 = r"""WITH hosts AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages),
s AS (SELECT DISTINCT regexp_replace(host, '^[^.]*\.', '') AS spelling FROM hosts)
SELECT spelling, CASE WHEN bool_or(host = spelling) THEN spelling WHEN count(*) = 1 THEN min(host) END AS host, count(*) AS matches
FROM s JOIN hosts ON host = spelling OR ends_with(host, '.' || spelling) GROUP BY spelling"""


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_extract("url", r"^https?://[^/]+/([^?#]*)", 1), "/", ".")
    return _table(spark, sf_dir, "pages").select(
        "page_id", F.concat_ws(".", F.regexp_extract("url", r"^https?://([^/?#]+)", 1), path).alias("name"),
    )


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    pages = _table(spark, sf_dir, "pages")
    deep = F.concat_ws(".", host, F.regexp_extract("url", r"^https?://[^/]+/([^/?#]+)", 1))
    return pages.select(
        F.explode(
            F.array(F.regexp_extract(host, r"^[^.]+\.[^.]+", 0), F.when(F.length(host) > 18, host), F.when(F.col("page_id") > 60, deep))
        ).alias("pkg")
    ).where("pkg is not null").distinct()


def q15_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest package that each page's dotted address begins with."""
    return longest_prefix_join(
        _paths(spark, sf_dir), "page_id", "name", _packages(spark, sf_dir), "pkg", "package",
    ).select("page_id", "package")


_PKG_SQL = r"""u AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([^/?#]+)', 1) AS first,
  replace(regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1), '/', '.') AS path FROM pages),
pkgs AS (SELECT DISTINCT pkg FROM (SELECT regexp_extract(host, '^[^.]+\.[^.]+') AS pkg FROM u
  UNION ALL SELECT host FROM u WHERE length(host) > 18 UNION ALL SELECT host || '.' || first FROM u WHERE page_id > 60)),
names AS (SELECT page_id, host || '.' || path AS name FROM u),
best AS (SELECT page_id, name, max_by(pkg, length(pkg)) AS package FROM names LEFT JOIN pkgs ON name = pkg OR starts_with(name, pkg || '.') GROUP BY ALL)"""
SQL_Q15 = f"WITH {_PKG_SQL} SELECT page_id, package FROM best"


def q16_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict ladder over the package found and what is left of the address."""
    found = longest_prefix_join(_paths(spark, sf_dir), "page_id", "name", _packages(spark, sf_dir), "pkg", "package")
    rest = F.size(F.filter(F.split(F.substr("name", F.length("package") + 2), r"\."), lambda p: p != ""))
    verdict = first_match(
        [
            (F.col("package").isNull(), "external"), (F.col("package") == F.col("name"), "valid"), (rest == 1, "drifted"),
            (F.col("name").rlike(r"\.(de|fr|es)\."), "unverifiable"), (rest > 2, "unverifiable"),
        ],
        F.lit("valid"),
    )
    return found.select("page_id", verdict.alias("verdict"))


SQL_Q16 = rf"""WITH {_PKG_SQL},
r AS (SELECT *, len(list_filter(string_split(substr(name, length(package) + 2), '.'), lambda p: p <> '')) AS rest FROM best)
SELECT page_id, CASE WHEN package IS NULL THEN 'external' WHEN package = name THEN 'valid' WHEN rest = 1 THEN 'drifted'
  WHEN regexp_matches(name, '\.(de|fr|es)\.') THEN 'unverifiable' WHEN rest > 2 THEN 'unverifiable' ELSE 'valid' END AS verdict FROM r"""


def q17_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early events as predictions, late ones as observations."""
    events = _table(spark, sf_dir, "events")
    return fuse(events.where("ts < '2024-01-03'"), events.where("ts >= '2024-01-28'"), ["user_id", "event_type"])


_FUSE_SQL = """s AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts < '2024-01-03'),
o AS (SELECT DISTINCT user_id, event_type FROM events WHERE ts >= '2024-01-28'),
f AS (SELECT coalesce(s.user_id, o.user_id) AS user_id, coalesce(s.event_type, o.event_type) AS event_type,
  CASE WHEN s.user_id IS NOT NULL AND o.user_id IS NOT NULL THEN 'confirmed' WHEN s.user_id IS NOT NULL THEN 'predicted' ELSE 'observed' END AS label
  FROM s FULL JOIN o USING (user_id, event_type))"""
SQL_Q17 = f"WITH {_FUSE_SQL} SELECT user_id, event_type, label FROM f"


def q18_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: rows per label with the sorted types among them."""
    return counts_by(q17_fusion(spark, sf_dir), "label", "event_type").select("label", "n", F.array_join("event_type", ",").alias("types"))


SQL_Q18 = f"WITH {_FUSE_SQL} SELECT label, count(*) AS n, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS types FROM f GROUP BY label"


def q19_change_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines changed (from large order lines) joined to lines executed (hours of events), with the tests that did."""
    lines = _table(spark, sf_dir, "lineitem").where("l_quantity = 50")
    span = F.sequence(F.col("l_linenumber").cast("long") * 3, F.col("l_linenumber").cast("long") * 3 + F.pmod("l_partkey", F.lit(4)))
    changed = lines.select(F.pmod("l_suppkey", F.lit(10)).alias("path"), F.explode(span).alias("line")).distinct()
    events = _table(spark, sf_dir, "events")
    executed = events.select(F.pmod("user_id", F.lit(10)).alias("path"), F.hour("ts").cast("long").alias("line"), F.col("event_type").alias("nodeid"))
    return covered_lines(changed, executed).withColumn("tests", F.array_join("tests", ","))


SQL_Q19 = """WITH c AS (SELECT DISTINCT l_suppkey % 10 AS path, unnest(range(l_linenumber * 3, l_linenumber * 3 + l_partkey % 4 + 1)) AS line FROM lineitem WHERE l_quantity = 50),
x AS (SELECT user_id % 10 AS path, hour(ts) AS line, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS tests FROM events GROUP BY 1, 2)
SELECT path, line, CASE WHEN tests IS NULL THEN 'uncovered' ELSE 'covered' END AS status, coalesce(tests, '') AS tests FROM c LEFT JOIN x USING (path, line)"""


def q19b_coverage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: covered and uncovered lines of each path of q19."""
    return coverage_totals(q19_change_coverage(spark, sf_dir))


SQL_Q19B = f"""SELECT path, count(*) FILTER (status = 'covered') AS covered, count(*) FILTER (status = 'uncovered') AS uncovered
FROM ({SQL_Q19}) GROUP BY path"""


def q20_last_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last user turn at or before each turn of a conversation."""
    talk = _table(spark, sf_dir, "conversations")
    filled = fill_header(talk, ["conv_id"], "turn", F.when(F.col("role") == "user", F.col("text")), "header")
    return filled.select("conv_id", "turn", F.md5(F.coalesce("header", F.lit(""))).alias("header"))


SQL_Q20 = """SELECT conv_id, turn, md5(coalesce(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '')) AS header FROM conversations"""


def q21_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections about the customers of the largest balance of each nation."""
    customer = _table(spark, sf_dir, "customer")
    roots = first_by(
        customer.select("c_nationkey", "c_custkey", "c_name", "c_acctbal"), ["c_nationkey"], [-F.col("c_acctbal"), F.col("c_custkey")],
    )
    nation = _table(spark, sf_dir, "nation")
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    definition = roots.select("c_custkey", F.lit("definition").alias("section"), F.col("c_name").alias("item"))
    caller = roots.join(nation, roots["c_nationkey"] == nation["n_nationkey"]).select("c_custkey", F.lit("caller"), "n_name")
    mine = roots.join(orders, roots["c_custkey"] == orders["o_custkey"])
    callee = mine.select("c_custkey", F.lit("callee"), F.col("o_orderkey").cast("string"))
    test = mine.select("c_custkey", F.lit("test"), "o_orderstatus").distinct()
    return definition.union(caller).union(callee).union(test)


SQL_Q21 = """WITH roots AS (SELECT * FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) = 1)
SELECT c_custkey, 'definition' AS section, c_name AS item FROM roots
UNION ALL SELECT c_custkey, 'caller', n_name FROM roots JOIN nation ON n_nationkey = c_nationkey
UNION ALL SELECT c_custkey, 'callee', CAST(o_orderkey AS VARCHAR) FROM roots JOIN orders ON o_custkey = c_custkey
UNION ALL SELECT DISTINCT c_custkey, 'test', o_orderstatus FROM roots JOIN orders ON o_custkey = c_custkey"""


def q22_snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of the documents compared by hash; one lacks a source each, German texts were edited."""
    docs = _table(spark, sf_dir, "documents")
    edited = F.when(F.col("lang") == "de", F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    old, new = docs.where("source <> 'src3'"), docs.where("source <> 'src5'")
    return snapshot_diff(old.select("doc_id", F.sha2("text", 256).alias("sha")), new.select("doc_id", F.sha2(edited, 256).alias("sha")), "doc_id")


SQL_Q22 = """WITH o AS (SELECT doc_id, sha256(text) AS old FROM documents WHERE source <> 'src3'),
n AS (SELECT doc_id, sha256(CASE WHEN lang = 'de' THEN text || 'x' ELSE text END) AS new FROM documents WHERE source <> 'src5')
SELECT doc_id, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN old <> new THEN 'changed' ELSE 'same' END AS status
FROM o FULL JOIN n USING (doc_id)"""


def q23_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts joined to the smallest source or largest target in either direction."""
    e = part_edges(spark, sf_dir)
    seeds = e.agg(F.explode(F.array(F.min("src"), F.max("dst"))).alias("node"))
    return joined_to(e, "src", "dst", seeds, LOCAL_EDGES)


SQL_Q23 = f"""WITH RECURSIVE {_e()}, u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
r(node) AS (SELECT min(src) FROM e UNION SELECT max(dst) FROM e UNION SELECT u.dst FROM r JOIN u ON u.src = r.node)
SELECT DISTINCT node FROM r"""
SQL_Q23 = SQL_Q23.replace(
    "r(node) AS (SELECT min(src) FROM e UNION SELECT max(dst) FROM e UNION", "r(node) AS (SELECT unnest([min(src), max(dst)]) FROM e UNION",
)


def q24_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash over the row hashes of each nation's customers, and one over those."""
    row = F.sha2(F.concat_ws("|", "c_custkey", "c_name", "c_mktsegment"), 256)
    each = _table(spark, sf_dir, "customer").select("c_nationkey", row.alias("h"))
    parts = each.groupBy("c_nationkey").agg(multiset_digest(F.col("h")).alias("h")).select(
        F.col("c_nationkey").cast("string").alias("part"), "h",
    )
    return parts.union(parts.agg(multiset_digest(F.col("h")).alias("h")).select(F.lit("all"), "h"))


_DIGEST = "sha256(concat_ws('-', count(h), " + ", ".join(
    f"sum(CAST('0x' || substr(h, {1 + 15 * i}, 15) AS HUGEINT))" for i in range(4)
) + "))"
SQL_Q24 = f"""WITH c AS (SELECT c_nationkey, sha256(c_custkey || '|' || c_name || '|' || c_mktsegment) AS h FROM customer),
b AS (SELECT CAST(c_nationkey AS VARCHAR) AS part, {_DIGEST} AS h FROM c GROUP BY c_nationkey)
SELECT part, h FROM b UNION ALL SELECT 'all', {_DIGEST} FROM b"""


def q25_marker_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Own tags of a part joined with those of its brand, sorted and distinct."""
    part = _table(spark, sf_dir, "part")
    brands = part.groupBy("p_brand").agg(F.min("p_type").alias("low"), F.max("p_type").alias("high"))
    tags = F.array_distinct(F.array_sort(F.array("p_type", "p_brand", "low", "high")))
    return part.join(brands, "p_brand").select("p_partkey", F.array_join(tags, ",").alias("tags"))


SQL_Q25 = """SELECT p_partkey, array_to_string(list_sort(list_distinct([p_type, p_brand, low, high])), ',') AS tags
FROM part JOIN (SELECT p_brand, min(p_type) AS low, max(p_type) AS high FROM part GROUP BY p_brand) USING (p_brand)"""


def q26_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, bases and surfaces of definitions built from parts."""
    part = _table(spark, sf_dir, "part").select(
        "p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word"), (F.col("p_size") % 4).alias("k"), F.split(F.lower("p_type"), " ").alias("types")
    )
    word, k = F.col("word"), F.col("k")
    name = F.when(k == 0, F.concat(F.lit("test_"), word)).when(k == 1, F.concat(F.lit("__"), word, F.lit("__"))).when(k == 2, F.concat(F.lit("_"), word)).otherwise(word)
    bases = F.array(F.array_join("types", "."), F.concat(F.lit("unittest."), F.initcap(F.element_at("types", -1)), F.when(k == 0, "TestCase").otherwise("Case")))
    rows = part.select("p_partkey", name.alias("name"), bases.alias("bases"), F.when(k == 3, F.array(word)).otherwise(F.array().cast("array<string>")).alias("container"))
    return rows.select(
        "p_partkey", "name", predicates.is_test_name(F.col("name")).alias("test_name"), predicates.is_dunder(F.col("name")).alias("dunder"),
        predicates.has_test_case_base(F.col("bases")).alias("test_case"),
        predicates.is_public_surface(F.lit("function"), F.col("container"), F.lit(False), F.col("name")).alias("public"),
    )


SQL_Q26 = r"""WITH p AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS word, p_size % 4 AS k FROM part),
n AS (SELECT *, CASE k WHEN 0 THEN 'test_' || word WHEN 1 THEN '__' || word || '__' WHEN 2 THEN '_' || word ELSE word END AS name FROM p)
SELECT p_partkey, name, starts_with(name, 'test') AS test_name, regexp_matches(name, '^__.*__$') AND length(name) > 4 AS dunder, k = 0 AS test_case,
  k <> 3 AND NOT starts_with(name, '_') AS public FROM n"""


def q27_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the lines of one order and number the first by part, supplier and price."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return first_by(
        lines, ["l_orderkey", "l_linenumber"], [F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice")],
    ).drop("l_extendedprice")


SQL_Q27 = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1"""


def q28_location_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each line of an order by its location as text."""
    loc = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey")
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", loc.alias("loc")).distinct()
    return lines.select("loc", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("loc")).cast("long").alias("rank"))


SQL_Q28 = """SELECT loc, row_number() OVER (PARTITION BY l_orderkey ORDER BY loc) AS rank
FROM (SELECT DISTINCT l_orderkey, l_orderkey || ':' || l_linenumber || ':' || l_partkey AS loc FROM lineitem)"""


def q29_caller_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct parts before each part in orders, itself left out."""
    over = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    pairs = _table(spark, sf_dir, "lineitem").select(F.lag("l_partkey").over(over).alias("src"), F.col("l_partkey").alias("dst"))
    return callers_of(pairs).select(F.col("node").alias("dst"), F.col("uses").alias("callers"))


SQL_Q29 = """SELECT dst, count(DISTINCT src) AS callers FROM (SELECT l_partkey AS dst,
  lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS src FROM lineitem)
WHERE src <> dst GROUP BY dst"""


def q30_edge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from two sources, each once, with the sources that have it."""
    lines = _table(spark, sf_dir, "lineitem")
    first = lines.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct().withColumn("source", F.lit("call"))
    second = lines.where("l_quantity >= 45").select("l_partkey", "l_suppkey").distinct().withColumn("source", F.lit("module"))
    both = first.union(second).groupBy("l_partkey", "l_suppkey").agg(
        F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources")
    )
    return both


SQL_Q30 = """SELECT l_partkey, l_suppkey, array_to_string(list_sort(list(DISTINCT source)), '+') AS sources FROM (
  SELECT l_partkey, l_suppkey, 'call' AS source FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT l_partkey, l_suppkey, 'module' FROM lineitem WHERE l_quantity >= 45) GROUP BY l_partkey, l_suppkey"""

_CALLEES = [
    "os.getenv", "os.environ.get", "subprocess.run", "os.system", "run", "requests.get", "client.urlopen", "socket", "open", "io.open", "p.read_text", "shutil.copy", "os.remove", "cur.execute", "User.objects.filter",
    "random.random", "uuid4", "os.urandom", "time.sleep", "datetime.now", "today", "x.y.z", "print", "environ.get", "popen", "http.client.HTTPSConnection", "secrets.token", "json.loads",
]
_EVENTS = [
    "open", "os.mkdir", "os.execve", "os.posix_spawn", "socket.connect", "ssl.wrap", "sqlite3.connect", "os.putenv", "import",
    "urllib.Request", "os.system", "gc.collect", "shutil.move", "os.spawnv", "cpython.run",
]


def _pick(values: list[str], key: str) -> Column:
    """The value at ``key`` modulo their number."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.pmod(F.col(key), F.lit(len(values))) + 1).cast("int"))


def _pick_sql(values: list[str], key: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][CAST({key} % {len(values)} AS INT) + 1]"


def q31_effect_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18, rules 2.2.1: callees named by part key, counted by category."""
    part = _table(spark, sf_dir, "part").select(_pick(_CALLEES, "p_partkey").alias("callee"))
    return part.select(
        "callee", F.coalesce(effect_category(F.col("callee")), F.lit("none")).alias("category"),
    ).groupBy("callee", "category").agg(F.count("*").alias("n"))


SQL_Q31 = f"""WITH c AS (SELECT {_pick_sql(_CALLEES, "p_partkey")} AS callee FROM part)
SELECT callee, CASE WHEN regexp_matches(callee, '(^|\\.)getenv$|(^|\\.)environ\\.(get|setdefault)$|(^|\\.)(putenv|setenv|unsetenv)$') THEN 'env'
  WHEN contains(callee, 'subprocess.') OR regexp_matches(callee, '(^|\\.)(system|popen|execv|execve|execvp|spawnl|spawnv)$') THEN 'subprocess'
  WHEN regexp_matches(callee, 'requests\\.|httpx\\.|aiohttp\\.|urllib\\.request|socket\\.|http\\.client') OR regexp_matches(callee, '(^|\\.)(urlopen|socket)$') THEN 'network'
  WHEN callee = 'open' OR contains(callee, 'shutil.') OR regexp_matches(callee, '(io\\.open|os\\.(remove|unlink|mkdir|makedirs|rmdir|rename|replace))$|(^|\\.)(read|write)_(text|bytes)$') THEN 'fs'
  WHEN contains(callee, '.objects.') OR contains(callee, 'sqlalchemy.') OR regexp_matches(callee, '(^|\\.)(execute|executemany|executescript|fetchone|fetchall)$|(sqlite3|psycopg2|pymysql)\\.connect$') THEN 'db'
  WHEN regexp_matches(callee, 'random\\.|secrets\\.|uuid\\.|os\\.urandom$|(^|\\.)uuid[14]$') THEN 'random'
  WHEN regexp_matches(callee, 'time\\.(time|monotonic|perf_counter|process_time|sleep|gmtime|localtime)$|(^|\\.)(now|utcnow|today|fromtimestamp)$') THEN 'clock'
  ELSE 'none' END AS category, count(*) AS n FROM c GROUP BY ALL"""


def q32_event_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules 2.2.2, A12: audit events named by event id, hits by category; the longest prefix counts."""
    events = _table(spark, sf_dir, "events").select(_pick(_EVENTS, "event_id").alias("event"), "user_id")
    return events.select(
        "event", F.coalesce(event_category(F.col("event")), F.lit("none")).alias("category"),
    ).groupBy("event", "category").agg(F.count("*").alias("hits"))


SQL_Q32 = f"""WITH e AS (SELECT {_pick_sql(_EVENTS, "event_id")} AS event FROM events)
SELECT event, CASE WHEN event IN ('open', 'os.mkdir', 'shutil.move') THEN 'fs' WHEN event = 'os.system' OR regexp_matches(event, '^os\\.(exec|spawn|posix_spawn)') THEN 'subprocess'
  WHEN event = 'sqlite3.connect' THEN 'db' WHEN event = 'os.putenv' THEN 'env' WHEN event = 'import' THEN 'import'
  WHEN event = 'urllib.Request' OR starts_with(event, 'socket.') OR starts_with(event, 'ssl.') THEN 'network' ELSE 'none' END AS category, count(*) AS hits
FROM e GROUP BY ALL"""

_FOLDERS = ["pkg", "tests", "scripts", "app/migrations", "app/management/commands", "src/test"]
_FILES = ["mod.py", "test_mod.py", "mod_test.py", "conftest.py", "__init__.py", "manage.py", "urls.py"]


def q33_path_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4, P5, P11-P13, identity rules: kinds of paths built from part size and key, with their modules."""
    path = F.concat(_pick(_FOLDERS, "p_size"), F.lit("/"), _pick(_FILES, "p_partkey"))
    part = _table(spark, sf_dir, "part").select(path.alias("path"), (F.pmod("p_size", F.lit(2)) == 0).alias("guard"))
    p = F.col("path")
    return part.distinct().select(
        "path", "guard", predicates.is_test_file(p).alias("test_file"), predicates.in_test_tree(p).alias("test_tree"), predicates.is_entry_file(p).alias("entry"),
        predicates.is_script_file(p, F.col("guard")).alias("script"), predicates.file_matches(p, "pkg/mod.py").alias("matches"), module_name(p).alias("module"), import_module_name(p).alias("import_module"),
    )


SQL_Q33 = f"""WITH p AS (SELECT DISTINCT {_pick_sql(_FOLDERS, "p_size")} || '/' || {_pick_sql(_FILES, "p_partkey")} AS path, p_size % 2 = 0 AS guard FROM part),
b AS (SELECT path, guard, split_part(path, '/', -1) AS base, regexp_replace(replace(path, '/', '.'), '\\.py$', '') AS dots FROM p)
SELECT path, guard, starts_with(base, 'test_') OR ends_with(base, '_test.py') AS test_file,
  starts_with(base, 'test_') OR ends_with(base, '_test.py') OR base = 'conftest.py' OR list_has_any(string_split(path, '/'), ['tests', 'test']) AS test_tree,
  base IN ('manage.py', 'conftest.py', 'urls.py') OR contains(path, '/migrations/') OR contains(path, 'management/commands/') OR starts_with(path, 'scripts/') AS entry,
  base <> '__init__.py' AND (guard OR base = 'manage.py' OR contains(path, 'management/commands/') OR starts_with(path, 'scripts/')) AS script,
  path = 'pkg/mod.py' AS matches, replace(dots, '.__init__', '') AS module, regexp_replace(dots, '\\.__init__$', '') AS import_module
FROM b"""


def q34_scoped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of dotted names built from parts that a qualified symbol names."""
    words = F.split(F.lower("p_type"), " ")
    part = _table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.array_join(words, "/"), F.lit(".py")).alias("path"),
        F.array(F.regexp_replace("p_brand", "#", "")).alias("container"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"),
    )
    fqn = def_fqn(F.col("path"), F.col("container"), F.col("name"))
    return part.select(
        "p_partkey", fqn.alias("fqn"), scoped_by("Brand13.x", F.col("path"), F.col("container")).alias("scoped"),
        fqn_names(fqn, "Brand13.almond").alias("named"),
    )


SQL_Q34 = """WITH p AS (SELECT p_partkey, replace(lower(p_type), ' ', '.') || '.' || replace(p_brand, '#', '') || '.' || split_part(p_name, ' ', 1) AS fqn, p_brand FROM part)
SELECT p_partkey, fqn, p_brand = 'Brand#13' AS scoped, fqn = 'Brand13.almond' OR ends_with(fqn, '.Brand13.almond') AS named FROM p"""


def q35_group_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per group with the group's first place and widest text."""
    talk = _table(spark, sf_dir, "conversations")
    return talk.groupBy("conv_id", "role").agg(
        F.count("*").alias("n"), F.min("turn").alias("first"), F.max(F.char_length("text")).cast("long").alias("width"),
    )


SQL_Q35 = "SELECT conv_id, role, count(*) AS n, min(turn) AS first, max(length(text)) AS width FROM conversations GROUP BY conv_id, role"


def q36_sole_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier of high balance of each nation if there is just one."""
    rich = sole_value(_table(spark, sf_dir, "supplier").where("s_acctbal > 6000"), "s_suppkey", "s_nationkey")
    nation = _table(spark, sf_dir, "nation")
    return nation.join(rich, nation["n_nationkey"] == rich["s_nationkey"], "left").select("n_nationkey", "sole")


SQL_Q36 = """SELECT n_nationkey, CASE WHEN count(s_suppkey) = 1 THEN min(s_suppkey) END AS sole
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 6000 GROUP BY n_nationkey"""

_ALL = {
    "q01_closure_forward": (q01_closure_forward, SQL_Q01),
    "q01b_closure_rounds": (q01b_closure_rounds, SQL_Q01),
    "q02_closure_reverse": (q02_closure_reverse, SQL_Q02),
    "q03_closure_via": (q03_closure_via, SQL_Q03),
    "q04_reachable_extra": (q04_reachable_extra, SQL_Q04),
    "q04b_reachable_rounds": (q04b_reachable_rounds, SQL_Q04B),
    "q05_dead_parts": (q05_dead_parts, SQL_Q05),
    "q06_dead_subsumed": (q06_dead_subsumed, SQL_Q06),
    "q07_most_used": (q07_most_used, SQL_Q07),
    "q08_strong_components": (q08_strong_components, SQL_Q08),
    "q08c_strong_rounds": (q08c_strong_rounds, SQL_Q08),
    "q08b_cycle_sizes": (q08b_cycle_sizes, SQL_Q08B),
    "q09_subclasses": (q09_subclasses, SQL_Q09),
    "q10_overrides": (q10_overrides, SQL_Q10),
    "q11_classify": (q11_classify, SQL_Q11),
    "q12_keys": (q12_keys, SQL_Q12),
    "q13_link_edges": (q13_link_edges, SQL_Q13),
    "q14_unique_suffix": (q14_unique_suffix, SQL_Q14),
    "q15_longest_prefix": (q15_longest_prefix, SQL_Q15),
    "q16_verdicts": (q16_verdicts, SQL_Q16),
    "q17_fusion": (q17_fusion, SQL_Q17),
    "q18_label_counts": (q18_label_counts, SQL_Q18),
    "q19_change_coverage": (q19_change_coverage, SQL_Q19),
    "q19b_coverage_totals": (q19b_coverage_totals, SQL_Q19B),
    "q20_last_header": (q20_last_header, SQL_Q20),
    "q21_sections": (q21_sections, SQL_Q21),
    "q22_snapshot_diff": (q22_snapshot_diff, SQL_Q22),
    "q23_affected": (q23_affected, SQL_Q23),
    "q24_fingerprint": (q24_fingerprint, SQL_Q24),
    "q25_marker_union": (q25_marker_union, SQL_Q25),
    "q26_predicates": (q26_predicates, SQL_Q26),
    "q27_first_wins": (q27_first_wins, SQL_Q27),
    "q28_location_order": (q28_location_order, SQL_Q28),
    "q29_caller_index": (q29_caller_index, SQL_Q29),
    "q30_edge_union": (q30_edge_union, SQL_Q30),
    "q31_effect_rules": (q31_effect_rules, SQL_Q31),
    "q32_event_categories": (q32_event_categories, SQL_Q32),
    "q33_path_predicates": (q33_path_predicates, SQL_Q33),
    "q34_scoped_names": (q34_scoped_names, SQL_Q34),
    "q35_group_headers": (q35_group_headers, SQL_Q35),
    "q36_sole_match": (q36_sole_match, SQL_Q36),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items()}
