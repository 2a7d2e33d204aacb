"""Queries on the generic tables for what keeps a project's records in order: history, jobs, ids, caches, and what to do first."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import collisions as col
from ..operators import contracts, diffs, graphs, reports
from ..operators import degrees as deg
from ..operators import hotspots as hot
from ..operators import identity as ids
from ..sources import fixtures as fx
from ..sources import history
from ..sources.sinks import write_atomic
from ..storage import new_path
from .jobs import Jobs
from .registry import _COL, _HOT, query

# History

_LOG = """lg AS (SELECT 'p' || l_partkey || '.py' AS path, 'c' || o_orderkey AS c, o_orderdate AS t, 'a' || o_custkey AS author, max(l_linenumber) AS added, min(l_linenumber) AS removed FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)"""


def _log(s, d):
    """Orders as commits, a record of a log each; lines of an order are the files that it changes."""
    files = fx.read(s, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_linenumber").alias("a"), F.min("l_linenumber").alias("r"))
    files = files.groupBy("l_orderkey").agg(F.collect_list(F.format_string("%d\t%d\tp%d.py", "a", "r", "l_partkey")).alias("f"))  # an order's lines
    o = fx.read(s, d, "orders").join(files, F.col("o_orderkey") == F.col("l_orderkey"))
    head = F.concat(F.lit("c"), F.col("o_orderkey").cast("string"), F.lit(history.FIELD), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit(history.FIELD + "a"), F.col("o_custkey").cast("string"))
    return o.select(F.concat_ws("\n", head, F.lit(""), F.array_join("f", "\n"), F.lit("")).alias("value"))


@query(f"WITH {_LOG} SELECT path, c AS commit, t AS committed_at, author, CAST(added AS BIGINT) AS added, CAST(removed AS BIGINT) AS removed FROM lg")
def commit_log(s, d):
    """What each commit of a log changed."""
    return history.parse_log(_log(s, d)).drop("patch")


@query(f"""WITH {_LOG}, n AS (SELECT max(o_orderdate) AS n FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY t DESC, c DESC) AS k FROM lg)
SELECT path, max(CASE WHEN k = 1 THEN c END) AS last_commit, max(t) AS last_modified, max(CASE WHEN k = 1 THEN author END) AS last_author, CAST(count_if(t >= n - INTERVAL 30 DAY) AS BIGINT) AS commits_recent,
  CAST(max(CASE WHEN k = 1 THEN added END) AS BIGINT) AS lines_added, CAST(max(CASE WHEN k = 1 THEN removed END) AS BIGINT) AS lines_removed, least(1.0::DOUBLE, count_if(t >= n - INTERVAL 30 DAY) / 10) AS churn FROM r, n GROUP BY path""")
def file_history(s, d):
    """Last commit and churn of every file, at the time of the newest commit."""
    newest = fx.read(s, d, "orders").agg(F.max("o_orderdate")).first()[0]
    return reports.file_history(history.parse_log(_log(s, d)), F.lit(newest)).drop("patch")


# Jobs


@query("""SELECT 'count' AS kind, 'completed' AS status, (SELECT count(*) FROM lineitem) AS result, '' AS error UNION ALL SELECT 'fails', 'failed', NULL, 'no such layer'
UNION ALL SELECT 'left', 'interrupted', NULL, 'the driver that owned the job is gone' UNION ALL SELECT 'unknown', 'not_found', NULL, ''""")
def job_states(s, d):
    """What is told of a job that ends, one that fails, one whose driver is gone, and one that never was."""

    def fails():
        raise ValueError("no such layer")

    folder = new_path(s, "jobs")
    jobs = Jobs(s, folder)
    started = [jobs.start("count", lambda: fx.read(s, d, "lineitem").count()), jobs.start("fails", fails)]
    write_atomic(s, f"{folder}/0.json", json.dumps({"job_id": "0", "kind": "left", "status": "running", "owner": "another", "result": None}))
    found = [jobs.wait(started[0]), jobs.wait(started[1]), jobs.status("0"), jobs.status("none") | {"kind": "unknown"}]
    return s.createDataFrame([(j["kind"], j["status"], j.get("result"), j.get("error") or "") for j in found], "kind string, status string, result long, error string")


# Ids and caches


@query("""WITH n AS (SELECT max(o_orderdate) AS n FROM orders), e AS (SELECT 'o' || o_orderkey AS path, o_custkey % 40 AS w, o_orderdate AS t FROM orders), k AS (SELECT DISTINCT CAST(s_nationkey AS BIGINT) AS w FROM supplier)
SELECT path, CASE WHEN w NOT IN (SELECT w FROM k) THEN 'orphan' ELSE 'old' END AS reason FROM e, n WHERE w NOT IN (SELECT w FROM k) OR t < n - INTERVAL 365 DAY""")
def expired_entries(s, d):
    """Entries of a cache to drop: nobody's, or not used for a year."""
    o = fx.read(s, d, "orders")
    entries = o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_custkey") % 40).alias("owner"), F.col("o_orderdate").alias("used_at"))
    owners = fx.read(s, d, "supplier").select(F.col("s_nationkey").cast("long").alias("owner"))
    return contracts.expired(entries, owners, F.lit(o.agg(F.max("o_orderdate")).first()[0]), 365)


@query("""WITH r AS (SELECT c_custkey AS slot, max(c_nationkey) AS g FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1) SELECT 'm' || s_suppkey AS name, CAST(greatest(1, coalesce(g + 1, 1)) AS INT) AS generation FROM supplier LEFT JOIN r ON slot = s_suppkey""")
def reused_slots(s, d):
    """Generations of ids in slots that were used before."""
    k = F.col("s_suppkey").cast("int")
    own = fx.read(s, d, "supplier").select(F.lit("module").alias("kind"), k.alias("slot"), F.lit(1).alias("generation"), F.concat(F.lit("m"), k.cast("string")).alias("name"))
    retired = fx.read(s, d, "customer").select(F.lit("module").alias("kind"), F.col("c_custkey").cast("int").alias("slot"), F.col("c_nationkey").alias("generation"))
    return ids.reuse(own, retired).select("name", "generation")


@query("""WITH b AS (SELECT DISTINCT 'c' || o_custkey AS name, (o_custkey + CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END) || '/1' AS obj_id FROM orders UNION SELECT DISTINCT 'c' || c_custkey, c_custkey || '/1' FROM customer),
n AS (SELECT name FROM b GROUP BY name HAVING count(*) = 1), i AS (SELECT obj_id FROM b GROUP BY obj_id HAVING count(*) = 1) SELECT name, obj_id FROM b WHERE name IN (SELECT name FROM n) AND obj_id IN (SELECT obj_id FROM i)""")
def repaired_ids(s, d):
    """Mappings that names and objects don't contradict."""
    t = lambda c: F.col(c).cast("string")
    names = fx.read(s, d, "orders").select(F.concat(F.lit("c"), t("o_custkey")).alias("name"), F.concat(F.expr("cast(o_custkey + if(o_custkey % 3 = 0, 1, 0) as string)"), F.lit("/1")).alias("obj_id"))
    objects = fx.read(s, d, "customer").select(F.concat(F.lit("c"), t("c_custkey")).alias("name"), F.concat(t("c_custkey"), F.lit("/1")).alias("obj_id"))
    return ids.repair(names, objects)


# Names, lists, graphs


@query("""WITH x AS (SELECT p_partkey AS k, (['P', 'p', '_', 'Pa', 'P_', '9'])[CAST(p_size % 6 + 1 AS INT)] || p_partkey AS name FROM part) SELECT name, upper(name) = name AND lower(name) <> name AS is_constant FROM x""")
def constant_names(s, d):
    """Which names are those of constants."""
    first = F.element_at(F.array(*[F.lit(x) for x in ("P", "p", "_", "Pa", "P_", "9")]), (F.col("p_size") % 6 + 1).cast("int"))
    names = fx.read(s, d, "part").select(F.concat(first, F.col("p_partkey").cast("string")).alias("name"))
    return names.select("name", col.is_constant(F.col("name")).alias("is_constant"))


@query("""WITH x AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber, l_partkey) AS p FROM lineitem GROUP BY 1) SELECT k AS order_key, list_sort(list_distinct(p)) <> p AS unsorted FROM x""")
def unsorted_lists(s, d):
    """Which orders list their parts out of order, or one twice."""
    per = fx.read(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))  # an order's lines
    return per.select("order_key", diffs.unsorted(F.transform("x", lambda e: e["l_partkey"])).alias("unsorted"))


@query(f"""WITH RECURSIVE {fx.EDGES}, o AS (SELECT DISTINCT CASE WHEN b AND a > c THEN dst ELSE src END AS src, CASE WHEN b AND a > c THEN src ELSE dst END AS dst FROM (SELECT src, dst, CAST(substr(src, 2) AS BIGINT) AS a, CAST(substr(dst, 2) AS BIGINT) AS c, (a + c) % 7 <> 0 AS b FROM hard)),
r(a, b) AS (SELECT src, dst FROM o UNION SELECT a, dst FROM r JOIN o ON src = b), c AS (SELECT a AS id FROM r WHERE a = b), n AS (SELECT src AS id FROM o UNION SELECT dst FROM o)
SELECT id FROM c UNION SELECT n.id FROM n WHERE id IN (SELECT a FROM r WHERE b IN (SELECT id FROM c)) AND id IN (SELECT b FROM r WHERE a IN (SELECT id FROM c))""")
def cyclic_nodes(s, d):
    """Nodes on cycles or between them; six edges in seven are turned so that they go up."""
    e = deg.hard(fx.edges(s, d))
    a, c = (F.substring(x, 2, 20).cast("long") for x in ("src", "dst"))
    down = ((a + c) % 7 != 0) & (a > c)
    return graphs.cyclic_nodes(e.select(F.when(down, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(down, F.col("src")).otherwise(F.col("dst")).alias("dst")).distinct())


@query(f"""WITH RECURSIVE {fx.USAGE}, e AS (SELECT DISTINCT definer || symbol AS x, 'g' || symbol AS y FROM usage), p AS (SELECT x, min(y) AS y FROM e GROUP BY x) SELECT y AS component, count(*) + 1 AS size FROM p GROUP BY y""")
def component_sizes(s, d):
    """Sizes of the groups that artifacts of one name make."""
    u = fx.usage(s, d).select("definer", "symbol").distinct()
    found = graphs.components(u.select(F.concat("definer", "symbol").alias("src"), F.concat(F.lit("g"), "symbol").alias("dst")))
    return graphs.component_sizes(found)


@query(f"""WITH {_HOT}, c2 AS (SELECT a.src AS x, a.dst AS y FROM hard a JOIN hard b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst), c3 AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM hard a JOIN hard b ON b.src = a.dst JOIN hard c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst),
ri AS (SELECT min(l) AS l FROM (SELECT [x, y, x] AS l FROM c2 UNION ALL SELECT [x, y, z, x] FROM c3)), {_COL},
cr AS (SELECT count(*) AS n, count_if(severity = 'critical') AS k FROM sv WHERE NOT is_identical), wo AS (SELECT name FROM sv WHERE NOT is_identical AND severity = 'critical' ORDER BY name, type LIMIT 1),
oh AS (SELECT module FROM hotspots WHERE type = 'OUTBOUND_HOTSPOT' ORDER BY score DESC, module LIMIT 1)
SELECT 'break_cycle' AS action, array_to_string(l, ',') AS target, NULL::BIGINT AS count FROM ri WHERE l IS NOT NULL UNION ALL SELECT CASE WHEN k > 0 THEN 'fix_collision' ELSE 'resolve_collisions' END, (SELECT name FROM wo), CASE WHEN k > 0 THEN k ELSE n END FROM cr WHERE n > 0
UNION ALL SELECT 'refactor', module, NULL FROM oh""")
def action_items(s, d):
    """What to do first, from short cycles, collisions and hotspots."""
    e = fx.edges(s, d)
    found = reports.action_items(graphs.bounded_cycles(deg.hard(e), 3), col.severity(col.collisions(fx.definitions(s, d))), hot.hotspots(e))
    text = lambda x: ",".join(x) if isinstance(x, list) else x
    return s.createDataFrame([(i["action"], text(i["target"]), i.get("count")) for i in found], "action string, target string, count long")
