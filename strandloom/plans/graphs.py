"""Queries of the graph operators; edges come from file dependencies (with cycles) and parts (acyclic)."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions.keys import normal_path
from strandloom.operators import graphs as G, traversal as T
from strandloom.session import table


def _files(spark, d):
    e = table(spark, d, "file_dependencies").filter("dep_type <> 'system' AND trim(target_path) <> ''")
    return e.select(F.col("source_path").alias("src"), normal_path(F.col("target_path")).alias("dst")).distinct()


def _parts(spark, d):
    """A part is made of those at a half and a third of its number."""
    p = table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("src"))
    return p.select("src", F.explode(F.array(F.floor(F.col("src") / 2), F.floor(F.col("src") / 3))).alias("dst")).filter("dst > 0").distinct()


def _roots(spark, d):
    """Every source."""
    return _files(spark, d).select(F.col("src").alias("root")).distinct()


def closure(spark, d):
    return G.reachable(_parts(spark, d), _parts(spark, d).select(F.col("src").alias("root"))).select("root", "node")


def hops(spark, d):
    return T.reachable(_files(spark, d), _roots(spark, d))


def call_paths(spark, d):
    return T.shortest_paths(_files(spark, d), _roots(spark, d))


def scc(spark, d):
    return G.strong_components(_files(spark, d))


def cycle_nodes(spark, d):
    e, c = _files(spark, d), G.strong_components(_files(spark, d))
    many = c.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1")
    return c.join(many, "component", "left_semi").select("node").union(e.filter("src = dst").select("src")).distinct()


def topo(spark, d):
    return G.levels(_parts(spark, d)).select("node", "level")


def critical_path(spark, d):
    cost = table(spark, d, "part").select(F.col("p_partkey").cast("bigint").alias("node"), F.round(F.col("p_retailprice"), 2).alias("cost"))
    return G.levels(_parts(spark, d), cost).select("node", F.round("total", 4).alias("total"))


def graph_roles(spark, d):
    return G.degrees(_files(spark, d))


def hot_callees(spark, d):
    """Called from at least three places."""
    return G.degrees(_files(spark, d)).filter("n_in >= 3").select("node", "n_in")


def cycle_breaks(spark, d):
    e = _files(spark, d)
    return G.weakest_cycle_edges(e.withColumn("w", F.length("src") + F.length("dst")), G.strong_components(e), "w")


def unreachable(spark, d):
    """Nodes that no root reaches."""
    e = _files(spark, d)
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    seen = _from_all_roots(e)
    return nodes.join(seen, "node", "left_anti")


def _from_all_roots(e):
    """Reached from any root: one virtual root before all of them keeps the search linear in the edges."""
    roots = G.degrees(e).filter("role = 'root'").select(F.lit("").alias("src"), F.col("node").alias("dst"))
    start = e.sparkSession.createDataFrame([("",)], "root string")
    return G.reachable(e.unionByName(roots), start).select("node")


def taint(spark, d):
    """Reached from every source without passing a header file; a header as source passes nothing on."""
    e = _files(spark, d)
    stop = e.select(F.col("src").alias("node")).filter("node LIKE '%.h'").distinct()
    return T.reachable(e, _roots(spark, d), blocked=stop).select("root", "node", "hops")


def causal_roots(spark, d):
    """Ancestors without a parent within five steps up, with a confidence of 0.8 to the power of the chain's nodes."""
    up = _parts(spark, d)
    seen = G.reachable(up, up.select(F.col("src").alias("root")), depth=5)
    top = G.degrees(up).filter("role = 'leaf'").select("node")
    return seen.join(top, "node", "left_semi").select("root", "node", F.round(F.pow(F.lit(0.8), F.col("hops") + 1), 6).alias("confidence"))


def merkle_root(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.sha2(F.col("event_type"), 256).alias("digest"))
    place = (F.row_number().over(G.W.partitionBy("user_id").orderBy("event_id")) - 1).cast("bigint")
    return G.merkle_root(e.withColumn("place", place), ["user_id"], "place", "digest")


def snapshot_root(spark, d):
    """Root of the indexed files of each top folder: digest over the digests of a thousand sorted lines of path and content hash each."""
    f = table(spark, d, "file_index_state").groupBy("path").agg(F.max_by("content_hash", F.struct("mtime", "content_hash")).alias("h"))
    line = F.concat("path", F.lit("|"), "h", F.lit("\n"))
    rows = f.select(F.split("path", "/")[0].alias("folder"), F.split("path", "/")[1].alias("sub"), line.alias("line"))
    place = F.row_number().over(G.W.partitionBy("folder", "sub").orderBy("line")) - 1
    digest = lambda c, o: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(o, c))), lambda x: x[c]), ""), 256)
    blocks = rows.withColumn("n", place).groupBy("folder", "sub", F.floor(F.col("n") / 1000).alias("block")).agg(digest("line", "n").alias("d"))
    return blocks.groupBy("folder", "sub").agg(digest("d", "block").alias("root"))


def _defs(spark, d):
    """Parts as symbols: defined at their supplier's file, a file holds a hundred numbers, a module a thousand, a crate ten thousand."""
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").cast("bigint").alias("def_id"), F.col("p_brand").alias("name"), F.floor(F.col("p_partkey") / 100).alias("file"), F.floor(F.col("p_partkey") / 1000).alias("module"), F.floor(F.col("p_partkey") / 10000).alias("crate"))


def symbol_lookup(spark, d):
    """Symbols and the file (supplier's nation) of a name, in order of position."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(F.broadcast(n) if n.limit(1001).count() <= 1000 else n, s["s_nationkey"] == n["n_nationkey"]).filter("n_name IN ('FRANCE', 'GERMANY', 'NATION_1', 'NATION_2')").select("s_suppkey", "s_name", "n_name")


def call_sites(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"]).select("l_orderkey", "l_linenumber", "o_custkey")


def callees(spark, d):
    """Distinct suppliers of an order and the first line that names them."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("first_line"))


def name_counts(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.countDistinct("p_type").alias("types"))


def enclosing_def(spark, d):
    """Events as points in spans of the user's sessions of 1,000 and 100 ids."""
    e = table(spark, d, "events").select("user_id", "event_id")
    wide = e.groupBy("user_id", F.floor(F.col("event_id") / 1000).alias("c")).agg(F.min("event_id").alias("s"), (F.max("event_id") + 1).alias("e"), F.min("event_id").alias("id"))
    tight = e.groupBy("user_id", F.floor(F.col("event_id") / 100).alias("c")).agg(F.min("event_id").alias("s"), F.max("event_id").alias("e"), (F.min("event_id") + 1_000_000_000).alias("id"))
    return G.enclosing(e, wide.unionByName(tight), "user_id", "event_id", "s", "e", "id")


def symbol_resolve(spark, d):
    """Every line uses the brand of its part; definitions in the part's file, else its module, its crate or anywhere."""
    defs = _defs(spark, d)
    uses = table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("use_id"), F.col("l_partkey").alias("def_id")).join(defs, "def_id").select("use_id", "name", "file", "module", "crate")
    return G.resolved(uses, defs, "name", [*((s, s, s) for s in ("file", "module", "crate")), ("workspace", None, None)])


def edit_kinds(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_size", "p_partkey", "p_name", "p_type")
    new = p.withColumn("p_name", F.when(F.col("p_partkey") % 9 == 0, F.concat("p_name", F.lit("_x"))).otherwise(F.col("p_name"))).withColumn("p_type", F.when(F.col("p_partkey") % 14 == 0, F.lit("other")).otherwise(F.col("p_type")))
    return G.edit_kinds(p, new, "p_brand", "p_size", "p_partkey", "p_name", "p_type")


QUERIES = {f.__name__: f for f in (closure, hops, call_paths, scc, cycle_nodes, topo, critical_path, graph_roles, hot_callees, cycle_breaks, unreachable, taint, causal_roots, merkle_root, snapshot_root, symbol_lookup, call_sites, callees, name_counts, enclosing_def, symbol_resolve, edit_kinds)}

#: '..' steps back over the folder before it, once is enough for these tables.
_NORM = "regexp_replace(regexp_replace(regexp_replace(replace(target_path, '\\', '/'), '/+', '/', 'g'), '(^|/)(\\./)+', '\\1', 'g'), '[^/]+/\\.\\./', '', 'g')"
_FILES = f"files AS (SELECT DISTINCT source_path AS src, {_NORM} AS dst FROM file_dependencies WHERE dep_type <> 'system' AND trim(target_path) <> '')"
_PARTS = "parts AS (SELECT DISTINCT src, dst FROM (SELECT p_partkey AS src, unnest([p_partkey // 2, p_partkey // 3]) AS dst FROM part) WHERE dst > 0)"
_ALL = "reach AS (SELECT src, dst FROM files UNION SELECT r.src, f.dst FROM reach r JOIN files f ON r.dst = f.src)"
_SCC = f"{_ALL}, nodes AS (SELECT src AS node FROM files UNION SELECT dst FROM files), comp AS (SELECT node, least(node, coalesce((SELECT min(a.dst) FROM reach a JOIN reach b ON a.dst = b.src AND b.dst = a.src WHERE a.src = node), node)) AS component FROM nodes)"
_LEVEL = "lev AS (SELECT p AS node, 0 AS level FROM (SELECT src AS p FROM parts UNION SELECT dst FROM parts) WHERE p NOT IN (SELECT src FROM parts) UNION SELECT e.src, l.level + 1 FROM lev l JOIN parts e ON e.dst = l.node)"
#: hops, call_paths and taint from every source are too slow in SQL; tests hold them against plain Python.
SQL = {
    "closure": f"WITH RECURSIVE {_PARTS}, r AS (SELECT src AS root, dst AS node FROM parts UNION SELECT r.root, p.dst FROM r JOIN parts p ON r.node = p.src) SELECT * FROM r",
    "scc": f"WITH RECURSIVE {_FILES}, {_SCC} SELECT * FROM comp",
    "cycle_nodes": f"WITH RECURSIVE {_FILES}, {_ALL} SELECT DISTINCT src AS node FROM reach WHERE src = dst",
    "topo": f"WITH RECURSIVE {_PARTS}, {_LEVEL} SELECT node, max(level)::BIGINT AS level FROM lev GROUP BY node",
    "critical_path": f"""WITH RECURSIVE {_PARTS}, c AS (SELECT p_partkey AS node, round(p_retailprice, 2) AS cost FROM part),
lev AS (SELECT node, cost AS total FROM (SELECT src AS node FROM parts UNION SELECT dst FROM parts) JOIN c USING (node) WHERE node NOT IN (SELECT src FROM parts) UNION SELECT e.src, l.total + c.cost FROM lev l JOIN parts e ON e.dst = l.node JOIN c ON c.node = e.src) SELECT node, round(max(total), 4) AS total FROM lev GROUP BY node""",
    "graph_roles": f"WITH {_FILES}, n AS (SELECT node, sum(o)::BIGINT AS n_out, sum(i)::BIGINT AS n_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM files UNION ALL SELECT dst, 0, 1 FROM files) GROUP BY node) SELECT *, CASE WHEN n_in = 0 THEN 'root' WHEN n_out = 0 THEN 'leaf' ELSE 'inner' END AS role FROM n",
    "hot_callees": f"WITH {_FILES} SELECT dst AS node, count(*) AS n_in FROM files GROUP BY dst HAVING count(*) >= 3",
    "cycle_breaks": f"WITH RECURSIVE {_FILES}, {_SCC} SELECT component, src, dst FROM (SELECT a.component, src, dst, row_number() OVER (PARTITION BY a.component ORDER BY length(src) + length(dst), src, dst) AS n FROM files JOIN comp a ON a.node = src JOIN comp b ON b.node = dst WHERE a.component = b.component AND src <> dst) WHERE n = 1",
    "unreachable": f"WITH RECURSIVE {_FILES}, s AS (SELECT DISTINCT src AS node FROM files WHERE src NOT IN (SELECT dst FROM files) UNION SELECT f.dst FROM s JOIN files f ON s.node = f.src) SELECT node FROM (SELECT src AS node FROM files UNION SELECT dst FROM files) WHERE node NOT IN (SELECT node FROM s)",
    "causal_roots": f"WITH RECURSIVE {_PARTS}, r AS (SELECT src AS root, dst AS node, 1 AS hops FROM parts UNION SELECT r.root, p.dst, r.hops + 1 FROM r JOIN parts p ON r.node = p.src WHERE r.hops < 5) SELECT root, node, round(power(0.8::DOUBLE, min(hops) + 1), 6) AS confidence FROM r WHERE node NOT IN (SELECT src FROM parts) GROUP BY 1, 2",
    "snapshot_root": """WITH l AS (SELECT split_part(path, '/', 1) AS folder, split_part(path, '/', 2) AS sub, path || '|' || h || chr(10) AS line FROM (SELECT path, arg_max(content_hash, (mtime, content_hash)) AS h FROM file_index_state GROUP BY path)),
n AS (SELECT *, row_number() OVER (PARTITION BY folder, sub ORDER BY line) - 1 AS n FROM l), b AS (SELECT folder, sub, n // 1000 AS block, sha256(string_agg(line, '' ORDER BY n)) AS d FROM n GROUP BY 1, 2, 3)
SELECT folder, sub, sha256(string_agg(d, '' ORDER BY block)) AS root FROM b GROUP BY 1, 2""",
    "symbol_lookup": "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN ('FRANCE', 'GERMANY', 'NATION_1', 'NATION_2')",
    "call_sites": "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "callees": "SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first_line FROM lineitem GROUP BY 1, 2",
    "name_counts": "SELECT p_brand, count(*) AS n, count(DISTINCT p_type) AS types FROM part GROUP BY p_brand",
    "enclosing_def": """WITH s AS (SELECT user_id, min(event_id) AS s, max(event_id) + 1 AS e, min(event_id) AS id FROM events GROUP BY user_id, event_id // 1000 UNION ALL SELECT user_id, min(event_id), max(event_id), min(event_id) + 1000000000 FROM events GROUP BY user_id, event_id // 100)
SELECT p.user_id, p.event_id, max((s, id))[2] AS owner FROM events p JOIN s ON p.user_id = s.user_id AND p.event_id >= s.s AND p.event_id < s.e GROUP BY 1, 2""",
    "symbol_resolve": """WITH f AS (SELECT p_partkey AS def_id, p_brand AS name, p_partkey // 100 AS file, p_partkey // 1000 AS module, p_partkey // 10000 AS crate FROM part),
u AS (SELECT l_orderkey * 10 + l_linenumber AS use_id, name, file, module, crate FROM lineitem JOIN f ON l_partkey = def_id),
cf AS (SELECT name, file, count(*) AS nf FROM f GROUP BY ALL), cm AS (SELECT name, module, count(*) AS nm FROM f GROUP BY ALL), cc AS (SELECT name, crate, count(*) AS nc FROM f GROUP BY ALL), cw AS (SELECT name, count(*) AS nw FROM f GROUP BY ALL),
lv AS (SELECT u.*, CASE WHEN nf IS NOT NULL THEN 'file' WHEN nm IS NOT NULL THEN 'module' WHEN nc IS NOT NULL THEN 'crate' ELSE 'workspace' END AS scope, round(1 / coalesce(nf, nm, nc, nw), 6) AS confidence FROM u LEFT JOIN cf USING (name, file) LEFT JOIN cm USING (name, module) LEFT JOIN cc USING (name, crate) JOIN cw USING (name))
""" + " UNION ALL ".join(f"SELECT use_id, f.def_id, scope, confidence FROM lv JOIN f ON lv.name = f.name{' AND lv.' + x + ' = f.' + x if x != 'workspace' else ''} WHERE scope = '{x}'" for x in ("file", "module", "crate", "workspace")),
    "edit_kinds": """WITH p AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS ordinal FROM part)
SELECT p_brand, p_size, ordinal, p_name AS old_name, CASE WHEN p_partkey % 9 = 0 THEN p_name || '_x' ELSE p_name END AS new_name, CASE WHEN p_partkey % 9 = 0 AND (p_partkey % 14 <> 0 OR p_type = 'other') THEN 'rename' ELSE 'signature' END AS edit FROM p WHERE p_partkey % 9 = 0 OR (p_partkey % 14 = 0 AND p_type <> 'other')""",
}
