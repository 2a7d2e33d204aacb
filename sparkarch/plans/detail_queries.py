"""Queries on the generic tables for single operators: the query language's conditions, names, aliases, tests, diffs and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collisions as col
from ..operators import consumption as con
from ..operators import contracts
from ..operators import degrees as deg
from ..operators import diffs, graphs, layers, prefixes, references, reports, resolve, search
from ..operators import hotspots as hot
from ..sources import fixtures as fx
from ..sources import repository as repo
from ..sources import sinks
from ..streaming import planner
from . import dsl
from .registry import _COL, _HOT, _IMPORT_COUNTS, _TWO, _page_records, _two_graphs, query

# The query language, one condition each; all rows that match, and for each request what a bounded answer returns

_ARTIFACTS = f"""{fx.USAGE}, {fx.SYMBOLS}, ap AS (SELECT module_id AS definer, symbol, list(DISTINCT kind) AS k, max(nullif(signature, '')) AS signature FROM symbols GROUP BY ALL),
au AS (SELECT definer, symbol, list_sort(list(DISTINCT consumer)) AS c FROM usage WHERE consumer <> 'm7' GROUP BY ALL),
ar AS (SELECT symbol AS artifact_name, definer || '::' || symbol AS full_name, definer AS module_name, CASE WHEN len(k) = 1 THEN k[1] ELSE 'ambiguous' END AS kind, signature, CAST(coalesce(len(c), 0) AS BIGINT) AS consumer_count, coalesce(c, []) AS consumers FROM ap LEFT JOIN au USING (definer, symbol))"""
_ASK = {"schema_version": "1.1", "language_version": "1.1"}


def _artifacts(s, d, *filters):
    records = dsl.artifact_records(fx.symbols(s, d), fx.usage(s, d).filter("consumer <> 'm7'"))
    asked = dsl.validate(_ASK | {"root": "artifacts", "filters": [dict(zip(("field", "operator", "value"), f, strict=False)) for f in filters], "select": ["full_name"]})
    return dsl.matched(records, asked).select("full_name", "consumer_count")


def _conditions(name: str, sql: str, *filters) -> None:
    def run(s, d):
        return _artifacts(s, d, *filters)

    run.__name__ = f"dsl_{name}"
    run.__doc__ = f"All artifacts of which {' and '.join(' '.join(map(str, f)) for f in filters)} holds."
    query(f"WITH {_ARTIFACTS} SELECT full_name, consumer_count FROM ar WHERE {sql}")(run)


_conditions("eq", "kind = 'class'", ("kind", "eq", "class"))
_conditions("neq", "kind <> 'class' AND signature <> 'x'", ("kind", "neq", "class"), ("signature", "neq", "x"))
_conditions("in", "kind IN ('class', 'global')", ("kind", "in", ["class", "global"]))
_conditions("contains", "contains(full_name, '9::p1')", ("full_name", "contains", "9::p1"))
_conditions("starts_with", "starts_with(full_name, 'm1')", ("full_name", "starts_with", "m1"))
_conditions("ends_with", "ends_with(full_name, '7')", ("full_name", "ends_with", "7"))
_conditions("gt_lte", "consumer_count > 1 AND consumer_count <= 3", ("consumer_count", "gt", 1), ("consumer_count", "lte", 3))
_conditions("gte_lt", "consumer_count >= 1 AND consumer_count < 2", ("consumer_count", "gte", 1), ("consumer_count", "lt", 2))
_conditions("count_eq", "len(consumers) = 2", ("consumers", "count_eq", 2))
_conditions("count_gt_lte", "len(consumers) > 1 AND len(consumers) <= 3", ("consumers", "count_gt", 1), ("consumers", "count_lte", 3))
_conditions("count_gte_lt", "len(consumers) >= 1 AND len(consumers) < 3", ("consumers", "count_gte", 1), ("consumers", "count_lt", 3))
_conditions("is_empty", "len(consumers) = 0", ("consumers", "is_empty"))
_conditions("is_null", "signature IS NULL", ("signature", "is_null"))


@query(f"WITH {_ARTIFACTS} SELECT full_name, array_to_string(consumers[1:1], ',') AS consumers, len(consumers) > 1 AS consumers_truncated FROM ar ORDER BY module_name, artifact_name LIMIT 200")
def dsl_evidence(s, d):
    """Evidence cut to one consumer, in a bounded answer."""
    records = dsl.artifact_records(fx.symbols(s, d), fx.usage(s, d).filter("consumer <> 'm7'"))
    found = dsl.run(records, _ASK | {"root": "artifacts", "filters": [], "select": ["full_name", "consumers"], "limit": 200, "evidence_limit": 1})
    return found.withColumn("consumers", F.array_join("consumers", ","))


@query(f"WITH {_IMPORT_COUNTS} SELECT module_name, import_count FROM mr ORDER BY module_name LIMIT 5")
def dsl_select(s, d):
    """Two selected fields of the first five records."""
    return dsl.run(_page_records(s, d), {"schema_version": "1.0", "language_version": "1.0", "root": "modules", "filters": [], "select": ["module_name", "import_count"], "limit": 5})


@query("""SELECT * FROM (VALUES ('invalid_request', '$request'), ('unsupported_version_pair', '$request'), ('unknown_root', 'root'), ('invalid_limit', 'limit'), ('unknown_field', 'select[0]'), ('duplicate_select_field', 'select[1]'), ('invalid_operator_for_type', 'filters[0].operator'),
 ('operator_value_mismatch', 'filters[0].value'), ('is_null_on_non_nullable', 'filters[0].operator'), ('missing_required_field', 'select'), ('too_many_filters', 'filters')) t(code, path)""")
def dsl_defects(s, d):
    """The first defect of each of some requests."""
    good = {"schema_version": "1.0", "language_version": "1.0", "root": "modules", "filters": [], "select": []}
    one = lambda **f: {"filters": [{"field": "module_id"} | f]}
    bad = [[], good | {"language_version": "1.1"}, good | {"root": "x", "limit": 0}, good | {"limit": 0, "select": ["x"]}, good | {"select": ["x"]}, good | {"select": ["path", "path"]}, good | one(operator="gt", value=1), good | one(operator="eq", value=1)]
    bad += [good | one(operator="is_null"), {k: v for k, v in good.items() if k != "select"}, good | {"filters": [0] * 11}]
    rows = [dsl.answer(s.range(0), b)["error"] for b in bad]
    return s.createDataFrame([(r["code"], r["path"]) for r in rows], "code string, path string")


@query(f"""WITH {_ARTIFACTS} SELECT 'stale' AS status, (SELECT count(*) FROM ar WHERE kind = 'class') AS matched, (SELECT string_agg(DISTINCT module_name, ',' ORDER BY module_name) FROM ar WHERE kind = 'class' AND module_name IN ('m1', 'm2', 'none')) AS modules""")
def dsl_stale(s, d):
    """What a request is told that touches modules whose last parse failed, and how many records it matches."""
    stale = s.createDataFrame([("m1",), ("m2",), ("none",)], "module_id string")
    records = dsl.artifact_records(fx.symbols(s, d), fx.usage(s, d).filter("consumer <> 'm7'"))
    request = _ASK | {"root": "artifacts", "filters": [{"field": "kind", "operator": "eq", "value": "class"}], "select": ["full_name"]}
    found = dsl.answer(records, request, stale)
    return s.createDataFrame([(found["status"], dsl.matched(records, dsl.validate(request)).count(), ",".join(found["affected_modules"]))], "status string, matched long, modules string")


# Names


@query(f"""WITH {fx.SYMBOLS}, n AS (SELECT symbol, list_sort(list(DISTINCT kind)) AS k FROM symbols WHERE CAST(substr(symbol, 2) AS BIGINT) % 2 = 0 OR kind <> 'class' GROUP BY symbol),
x AS (SELECT DISTINCT CASE WHEN p_size % 5 = 0 THEN '_p' WHEN p_size % 5 = 1 THEN '__p' ELSE 'p' END || p_partkey || CASE WHEN p_size % 5 = 1 AND p_partkey % 2 = 0 THEN '__' ELSE '' END AS symbol, (['class', 'function', 'method', 'global'])[CAST(p_size % 4 + 1 AS INT)] AS kind FROM part)
SELECT symbol, kind, kind AS first_kind, NOT starts_with(symbol, '_') OR (starts_with(symbol, '__') AND ends_with(symbol, '__')) AS is_public FROM x""")
def artifact_names(s, d):
    """The category of each name and whether reports show it: names with two underscores on both sides are public."""
    p = fx.read(s, d, "part")
    five = F.col("p_size") % 5
    name = F.concat(F.when(five == 0, "_p").when(five == 1, "__p").otherwise("p"), F.col("p_partkey").cast("string"), F.when((five == 1) & (F.col("p_partkey") % 2 == 0), "__").otherwise(""))
    kind = F.element_at(F.array(*[F.lit(k) for k in ("class", "function", "method", "global")]), (F.col("p_size") % 4 + 1).cast("int"))
    per = p.select(name.alias("symbol"), kind.alias("kind")).groupBy("symbol").agg(F.collect_set("kind").alias("k"))
    return per.select("symbol", con.single_kind(F.col("k")).alias("kind"), con.first_kind(F.col("k")).alias("first_kind"), con.is_public_artifact(F.col("symbol")).alias("is_public"))


_IDS = """oi AS (SELECT 'm' || s_suppkey AS name, s_suppkey || '/1' AS obj_id FROM supplier WHERE s_suppkey % 9 <> 0)"""


def _ids(s, d):
    k = F.col("s_suppkey")
    return fx.read(s, d, "supplier").select(F.concat(F.lit("m"), k.cast("string")).alias("name"), F.concat(k.cast("string"), F.lit("/1")).alias("obj_id"), F.when(k % 9 != 0, "active").otherwise("gone").alias("status"))


@query(f"WITH {fx.EDGES}, {_IDS} SELECT coalesce(a.obj_id, src) AS src, coalesce(b.obj_id, dst) AS dst, edge_type FROM edges LEFT JOIN oi a ON a.name = src LEFT JOIN oi b ON b.name = dst")
def compact_edges(s, d):
    """Edges with ids for the names that have one."""
    return reports.compact(fx.edges(s, d), ["src", "dst"], _ids(s, d)).select("src", "dst", "edge_type")


def _blocks(s, d):
    k = lambda c, n: F.concat((F.col(c) % n).cast("string"), F.lit("/1"))
    line = fx.read(s, d, "lineitem").select(F.concat(F.lit("A"), F.col("l_partkey").cast("string"), F.lit("/1")).alias("artifact_id"), k("l_partkey", 120).alias("definer"), k("l_suppkey", 130).alias("consumer"))
    return line.groupBy("artifact_id", "definer").agg(F.array_sort(F.collect_set("consumer")).alias("consumers"))


def _block_names(s, d):
    p = fx.read(s, d, "part").filter("p_partkey % 11 <> 0").select(F.concat(F.lit("A"), F.col("p_partkey").cast("string"), F.lit("/1")).alias("obj_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"))
    return p.unionByName(_ids(s, d).select("obj_id", "name")).withColumn("status", F.lit("active"))


_REWRITE = """bl AS (SELECT DISTINCT l_partkey AS p, l_partkey % 120 AS definer, l_suppkey % 130 AS consumer FROM lineitem), nm AS (SELECT s_suppkey AS i FROM supplier),
ok AS (SELECT DISTINCT p, definer FROM bl WHERE p % 11 <> 0 AND p IN (SELECT p_partkey FROM part) AND definer IN (SELECT i FROM nm))"""


@query(f"WITH {_REWRITE} SELECT 'p' || ok.p AS artifact, 'm' || ok.definer AS definer, coalesce(string_agg('m' || i, ',' ORDER BY 'm' || i), '') AS consumers FROM ok LEFT JOIN bl ON bl.p = ok.p LEFT JOIN nm ON nm.i = bl.consumer GROUP BY ok.p, ok.definer")
def rewritten_blocks(s, d):
    """Report blocks with names for ids; blocks with an unknown artifact or definer are left out."""
    out, _ = search.rewrite_ids(_blocks(s, d), _block_names(s, d))
    return out.withColumn("consumers", F.array_join("consumers", ","))


@query(f"""WITH {_REWRITE} SELECT DISTINCT 'A' || p || '/1' AS obj_id, 'artifact' AS role FROM bl WHERE p % 11 = 0 OR p NOT IN (SELECT p_partkey FROM part) UNION SELECT definer || '/1', 'definer' FROM bl WHERE definer NOT IN (SELECT i FROM nm) UNION SELECT consumer || '/1', 'consumer' FROM bl WHERE consumer NOT IN (SELECT i FROM nm)""")
def unknown_block_ids(s, d):
    """Ids that the rewriting has no name for, with their role."""
    _, lost = search.rewrite_ids(_blocks(s, d), _block_names(s, d))
    return lost


@query("""WITH u AS (SELECT DISTINCT 'c' || c_custkey % 50 AS module_id, 'a' || c_custkey % 7 || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '.f' ELSE '.b.f' END AS name FROM customer),
al AS (SELECT DISTINCT 'c' || s_suppkey % 50 AS module_id, 'a' || s_suppkey % 7 AS alias, 'pkg.x' || s_suppkey % 7 AS target FROM supplier UNION SELECT DISTINCT 'c' || s_suppkey % 50, 'a' || s_suppkey % 7 || '.b', 'deep.y' || s_suppkey % 7 FROM supplier WHERE s_suppkey % 2 = 0)
SELECT u.module_id, u.name, coalesce(CASE WHEN b.target IS NOT NULL THEN b.target || substr(u.name, length(b.alias) + 1) END, CASE WHEN a.target IS NOT NULL THEN a.target || substr(u.name, length(a.alias) + 1) END, u.name) AS resolved
FROM u LEFT JOIN al a ON a.module_id = u.module_id AND a.alias = string_split(u.name, '.')[1] LEFT JOIN al b ON b.module_id = u.module_id AND b.alias = string_split(u.name, '.')[1] || '.b' AND contains(u.name, '.b')""")
def alias_resolution(s, d):
    """Used names with the module's longest alias at their start replaced."""
    c, k = F.col("c_custkey"), F.col("s_suppkey")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    uses = fx.read(s, d, "customer").select(name("c", c % 50).alias("module_id"), F.concat(name("a", c % 7), F.when(c % 3 == 0, "").when(c % 3 == 1, ".f").otherwise(".b.f")).alias("name")).distinct()
    sup = fx.read(s, d, "supplier")
    al = sup.select(name("c", k % 50).alias("module_id"), name("a", k % 7).alias("alias"), name("pkg.x", k % 7).alias("target"))
    al = al.unionByName(sup.filter("s_suppkey % 2 = 0").select(name("c", k % 50).alias("module_id"), F.concat(name("a", k % 7), F.lit(".b")).alias("alias"), name("deep.y", k % 7).alias("target")))
    return prefixes.resolve_aliases(uses, al.distinct())


@query("""WITH RECURSIVE al AS (SELECT p_partkey AS i, CASE WHEN p_partkey % 50 = 0 THEN p_partkey + 1 WHEN p_partkey % 50 = 1 AND p_partkey > 1 THEN p_partkey - 1 ELSE p_partkey // 2 END AS t FROM part WHERE p_partkey > 0),
r(i, t, n) AS (SELECT i, t, 1 FROM al UNION ALL SELECT r.i, al.t, n + 1 FROM r JOIN al ON al.i = r.t WHERE n < 40), e AS (SELECT i, t FROM r WHERE t NOT IN (SELECT i FROM al))
SELECT 'p' || i AS name, 'p' || t AS target FROM e""")
def reexports(s, d):
    """Re-exported names followed to the end; those on or into a ring are dropped."""
    i = F.col("p_partkey")
    to = F.when(i % 50 == 0, i + 1).when((i % 50 == 1) & (i > 1), i - 1).otherwise(F.expr("p_partkey div 2"))
    name = lambda x: F.concat(F.lit("p"), x.cast("string"))
    return graphs.reexport_closure(fx.read(s, d, "part").filter("p_partkey > 0").select(name(i).alias("name"), name(to).alias("target")))


@query(f"""WITH {fx.SYMBOLS}, kn AS (SELECT DISTINCT module_id AS definer, symbol FROM symbols), f AS (SELECT DISTINCT 'm' || c_custkey % 100 AS module_id, 'm' || c_custkey % 37 AS module, CASE WHEN c_custkey % 10 = 0 THEN '*' ELSE 'p' || c_custkey END AS symbol FROM customer WHERE c_custkey % 4 <> 1)
SELECT DISTINCT definer, kn.symbol, f.module_id FROM f JOIN kn ON definer = module AND (f.symbol = kn.symbol OR f.symbol = '*') WHERE definer <> f.module_id""")
def import_from_users(s, d):
    """Users of symbols by from-imports, of all public ones by a star."""
    c = F.col("c_custkey")
    name = lambda x: F.concat(F.lit("m"), x.cast("string"))
    rows = fx.read(s, d, "customer").select(name(c % 100).alias("module_id"), name(c % 37).alias("module"), F.array(F.when(c % 10 == 0, "*").otherwise(F.concat(F.lit("p"), c.cast("string")))).alias("names"), (c % 4 != 1).alias("is_from_import"))
    return references.import_from_users(rows, fx.symbols(s, d))


@query(f"WITH {fx.SYMBOLS}, k AS (SELECT DISTINCT module_id, symbol FROM symbols), c AS (SELECT DISTINCT 'm' || c_custkey % 100 AS consumer, 'p' || c_custkey AS symbol FROM customer) SELECT k.module_id, k.symbol, consumer FROM k JOIN c ON c.symbol = k.symbol WHERE consumer <> module_id")
def used_elsewhere(s, d):
    """Symbols that another module uses by their bare name."""
    c = F.col("c_custkey")
    calls = fx.read(s, d, "customer").select(F.concat(F.lit("m"), (c % 100).cast("string")).alias("module_id"), F.concat(F.lit("p"), c.cast("string")).alias("name"))
    return con.used_elsewhere(fx.symbols(s, d), calls)


@query(f"WITH {fx.SYMBOLS} SELECT symbol AS leaf, string_agg(DISTINCT module_id || '.' || symbol, ',' ORDER BY module_id || '.' || symbol) AS ids FROM symbols GROUP BY symbol")
def short_names(s, d):
    return references.short_names(fx.symbols(s, d)).withColumn("ids", F.array_join("ids", ","))


_METHODS = (*references.COMMON_METHODS, "render", "join", "read", "split", "__enter__", "_close", "__half")


@query(f"""WITH n AS (SELECT unnest({list(_METHODS)}) AS name), u AS (SELECT DISTINCT 'q' || c_custkey % 20 AS module_id, CASE WHEN c_custkey % 5 = 0 THEN 'al.sub.' ELSE 'obj.' END || ({list(_METHODS)})[CAST(c_custkey % {len(_METHODS)} + 1 AS INT)] AS name FROM customer),
x AS (SELECT *, string_split(name, '.')[-1] AS leaf, starts_with(name, 'al.sub.') AS rooted FROM u), y AS (SELECT *, NOT rooted AND leaf IN ('render', 'join', 'read', 'split', '_close', '__half') AS g FROM x)
SELECT module_id, name, CASE WHEN g THEN 'lib' END AS definer, CASE WHEN g THEN 'C.' || leaf END AS symbol, CASE WHEN g THEN 'ambiguous' ELSE 'none' END AS match FROM y""")
def method_matches(s, d):
    """Method names that one class has: the common ones, those with two underscores and those below an alias aren't guessed."""
    c = F.col("c_custkey")
    method = F.element_at(F.array(*[F.lit(m) for m in _METHODS]), (c % len(_METHODS) + 1).cast("int"))
    uses = fx.read(s, d, "customer").select(F.concat(F.lit("q"), (c % 20).cast("string")).alias("module_id"), F.concat(F.when(c % 5 == 0, "al.sub.").otherwise("obj."), method).alias("name"))
    known = s.createDataFrame([("lib", f"C.{m}") for m in _METHODS], "module_id string, symbol string")
    return references.match_names(uses, known, uses.select("module_id", F.lit("al.sub").alias("alias")))


@query("""WITH m AS (SELECT 'src/' || s_suppkey % 7 || '/f' || s_suppkey % 40 || '.py' AS path FROM supplier), d AS (SELECT DISTINCT path FROM m), a AS (SELECT DISTINCT CASE WHEN c_custkey % 3 = 0 THEN 'src/' || c_custkey % 8 || '/f' || c_custkey % 40 || '.py' WHEN c_custkey % 3 = 1 THEN c_custkey % 7 || '/f' || c_custkey % 45 || '.py' ELSE 'f' || c_custkey % 45 || '.py' END AS asked FROM customer),
j AS (SELECT asked, max(CASE WHEN path = asked THEN path END) AS whole, count(path) AS n, min(path) AS one FROM a LEFT JOIN d ON path = asked OR ends_with(path, '/' || asked) GROUP BY asked)
SELECT asked, coalesce(whole, CASE WHEN n = 1 THEN one END) AS matched FROM j""")
def suffix_matches(s, d):
    """Paths found by themselves or by their only known path that ends so."""
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    t = lambda x: x.cast("string")
    known = fx.read(s, d, "supplier").select(F.concat(F.lit("src/"), t(k % 7), F.lit("/f"), t(k % 40), F.lit(".py")).alias("path")).distinct()
    whole = F.concat(F.lit("src/"), t(c % 8), F.lit("/f"), t(c % 40), F.lit(".py"))
    asked = F.when(c % 3 == 0, whole).when(c % 3 == 1, F.concat(t(c % 7), F.lit("/f"), t(c % 45), F.lit(".py"))).otherwise(F.concat(F.lit("f"), t(c % 45), F.lit(".py")))
    return prefixes.by_suffix(fx.read(s, d, "customer").select(asked.alias("asked")).distinct(), "asked", known, "path").select("asked", "matched")


# Layers and graph


@query(f"""WITH {fx.EDGES}, {fx.MEMBERS}, e AS (SELECT DISTINCT a.layer || '.' || src AS src, b.layer || '.' || dst AS dst FROM hard JOIN members a ON a.module_id = src JOIN members b ON b.module_id = dst),
c2 AS (SELECT a.src AS x, a.dst AS y FROM e a JOIN e b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst) SELECT x || ' -> ' || y || ' -> ' || x AS message FROM c2 WHERE starts_with(x, 'engine.') AND starts_with(y, 'engine.')""")
def layer_cycles(s, d):
    """Cycles of two modules that lie inside a layer, as violations."""
    m = fx.members(s, d).select("module_id", F.concat_ws(".", "layer", "module_id").alias("name"))
    named = lambda c: m.select(F.col("module_id").alias(c), F.col("name").alias(f"{c}_name"))
    e = deg.hard(fx.edges(s, d)).join(named("src"), "src").join(named("dst"), "dst").select(F.col("src_name").alias("src"), F.col("dst_name").alias("dst"))
    return graphs.cycle_violations(graphs.bounded_cycles(e, 2)).filter(layers.inside("nodes", "engine")).select("message")


@query(f"WITH {_COL} SELECT name, type, nodes FROM sv WHERE NOT is_identical AND list_bool_and(list_transform(string_split(nodes, ','), lambda x: starts_with(x, 'src4.')))")
def layer_collisions(s, d):
    """Real collisions whose modules all lie in one source."""
    return layers.layer_collisions(col.collisions(fx.definitions(s, d)), "src4").select("name", "type", F.array_join("nodes", ",").alias("nodes"))


@query("""WITH n AS (SELECT DISTINCT 'pkg' || c_custkey % 9 || '.' || (['main', 'cli', 'util', 'run', 'app', '__main__', 'core'])[CAST(c_custkey % 7 + 1 AS INT)] AS id FROM customer)
SELECT id, string_split(id, '.')[2] IN ('main', 'cli', 'run', 'app', '__main__') AS entry FROM n""")
def entry_points(s, d):
    c = F.col("c_custkey")
    leaf = F.element_at(F.array(*[F.lit(x) for x in ("main", "cli", "util", "run", "app", "__main__", "core")]), (c % 7 + 1).cast("int"))
    return fx.read(s, d, "customer").select(F.concat(F.lit("pkg"), (c % 9).cast("string"), F.lit("."), leaf).alias("id")).distinct().select("id", graphs.entry_point().alias("entry"))


@query(f"WITH {_HOT} SELECT module, 'ISOLATED' AS state FROM hotspots WHERE type = 'ISOLATED' UNION ALL SELECT module, 'ACTIVE' FROM hotspots WHERE type NOT IN ('ISOLATED', 'NORMAL')")
def hotspot_split(s, d):
    alone, active = hot.split_active(hot.hotspots(fx.edges(s, d)))
    return alone.select("module", F.lit("ISOLATED").alias("state")).unionByName(active.select("module", F.lit("ACTIVE").alias("state")))


@query(f"WITH {fx.EDGES}, b AS (SELECT dst AS module, src AS other, 'dependent' AS way, edge_type FROM edges UNION ALL SELECT src, dst, 'dependency', edge_type FROM edges) SELECT module, way, edge_type, count(*) AS modules, min(other) AS first FROM b GROUP BY ALL")
def module_neighbours(s, d):
    """Dependents and dependencies of every module by type: how many, and the first."""
    e = fx.edges(s, d)
    both = e.select(F.col("dst").alias("module"), F.col("src").alias("other"), F.lit("dependent").alias("way"), "edge_type").unionByName(e.select(F.col("src").alias("module"), F.col("dst").alias("other"), F.lit("dependency").alias("way"), "edge_type"))
    return both.groupBy("module", "way", "edge_type").agg(F.count("*").alias("modules"), F.min("other").alias("first"))


@query(f"WITH {_HOT}, a AS (SELECT count(*) AS n FROM hotspots WHERE type IN ('HUB', 'HOTSPOT', 'OUTBOUND_HOTSPOT')), v AS (SELECT unnest([0, 0, 2, 2]) AS c, unnest([0, 3, 0, 3]) AS k) SELECT c AS cycles, k AS collisions, CASE WHEN c > 0 AND k > 0 THEN 'CRITICAL' WHEN c > 0 OR k > 0 THEN 'BROKEN' WHEN n > 0 THEN 'WARNING' ELSE 'HEALTHY' END AS status FROM v, a")
def project_status(s, d):
    """The status by cycles and collisions, with the hotspots that the graph has."""
    active = hot.hotspots(fx.edges(s, d)).filter("type in ('HUB', 'HOTSPOT', 'OUTBOUND_HOTSPOT')").agg(F.count("*").alias("n"))
    cases = s.createDataFrame([(0, 0), (0, 3), (2, 0), (2, 3)], "cycles int, collisions int")
    return cases.crossJoin(F.broadcast(active)).select("cycles", "collisions", hot.status(F.col("cycles"), F.col("collisions"), F.col("n")).alias("status"))


# Tests

_TESTS = "ts AS (SELECT 'tests/test_m' || c_custkey % 60 || '.py' AS test_path, 'm' || c_custkey % 100 AS module FROM customer), tm AS (SELECT DISTINCT test_path, 'm' || s_suppkey AS module_id FROM ts JOIN supplier ON 'm' || s_suppkey IN (module, replace(replace(test_path, 'tests/test_', ''), '.py', '')))"


def _tests(s, d):
    c = F.col("c_custkey")
    rows = fx.read(s, d, "customer").select(F.concat(F.lit("tests/test_m"), (c % 60).cast("string"), F.lit(".py")).alias("test_path"), F.concat(F.lit("m"), (c % 100).cast("string")).alias("module"))
    tests = rows.groupBy("test_path").agg(F.collect_set("module").alias("imports"))
    return search.tested_modules(tests, fx.members(s, d).select("module_id"))


@query(f"WITH {_TESTS} SELECT * FROM tm")
def tested_modules(s, d):
    """Tests and the modules that they are named after or import."""
    return _tests(s, d)


_TESTED = "ty AS (SELECT DISTINCT module_id, symbol FROM symbols WHERE CAST(substr(symbol, 2) AS BIGINT) IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0))"


def _tested_symbols(s, d):
    names = fx.read(s, d, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("name"))
    return search.tested_symbols(fx.symbols(s, d).select("module_id", "symbol").distinct(), names, s.createDataFrame([(False,), (True,)], "has_assert boolean"))


@query(f"WITH {fx.SYMBOLS}, {_TESTED} SELECT * FROM ty")
def tested_symbols(s, d):
    """Symbols that a test names."""
    return _tested_symbols(s, d).select("module_id", "symbol")


@query(f"""WITH {fx.SYMBOLS}, {_TESTS}, {_TESTED}, k AS (SELECT DISTINCT module_id, symbol FROM symbols), f AS (SELECT module_id, string_agg(test_path, ',' ORDER BY test_path) AS tests FROM tm GROUP BY module_id)
SELECT k.module_id, coalesce(max(f.tests), '') AS tests, count(ty.symbol) AS tested, CAST(count_if(ty.symbol IS NULL) AS BIGINT) AS untested FROM k LEFT JOIN ty ON ty.module_id = k.module_id AND ty.symbol = k.symbol LEFT JOIN f ON f.module_id = k.module_id GROUP BY k.module_id""")
def test_trace(s, d):
    """Tests of each module, and how many of its symbols they name."""
    return reports.test_trace(fx.symbols(s, d), _tested_symbols(s, d), _tests(s, d)).withColumn("tests", F.array_join("tests", ","))


# Reports and differences


@query(f"""WITH {fx.USAGE}, {fx.EDGES}, dr AS (SELECT definer, symbol, string_agg(DISTINCT consumer, ',' ORDER BY consumer) AS direct FROM usage WHERE consumer <> definer GROUP BY ALL), kn AS (SELECT DISTINCT definer, consumer FROM usage WHERE consumer <> definer),
tr AS (SELECT dst AS definer, string_agg(DISTINCT src, ',' ORDER BY src) AS transitive FROM edges WHERE (dst, src) NOT IN (SELECT definer, consumer FROM kn) GROUP BY dst) SELECT dr.definer, symbol, direct, coalesce(transitive, '') AS transitive FROM dr LEFT JOIN tr ON tr.definer = dr.definer""")
def symbol_view(s, d):
    """Direct consumers of every symbol, and modules that import its module without using any."""
    found = reports.symbol_view(fx.usage(s, d), fx.edges(s, d).select(F.col("dst").alias("definer"), F.col("src").alias("module_id")))
    return found.withColumns({c: F.array_join(c, ",") for c in ("direct", "transitive")})


_SIDES = """so AS (SELECT 'm' || s_suppkey % 40 AS module_id, 'f' || s_suppkey AS symbol, CASE WHEN s_suppkey % 6 = 0 THEN 'a' ELSE 'b' END AS signature, 'x' AS body FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 40 <> 7),
sn AS (SELECT 'm' || s_suppkey % 40 AS module_id, 'f' || s_suppkey AS symbol, 'b' AS signature, CASE WHEN s_suppkey % 7 = 0 THEN 'y' ELSE 'x' END AS body FROM supplier WHERE s_suppkey % 8 <> 0 AND s_suppkey % 40 <> 9),
sd AS (SELECT module_id, symbol, CASE WHEN o.signature IS NULL THEN 'added' WHEN n.signature IS NULL THEN 'removed' WHEN o.signature <> n.signature THEN 'signature' WHEN o.body <> n.body THEN 'body' END AS change FROM (SELECT * FROM so) o FULL JOIN (SELECT * FROM sn) n USING (module_id, symbol))"""


def _sides(s, d):
    k = F.col("s_suppkey")
    name = [F.concat(F.lit("m"), (k % 40).cast("string")).alias("module_id"), F.concat(F.lit("f"), k.cast("string")).alias("symbol")]
    sup = fx.read(s, d, "supplier")
    old = sup.filter((k % 5 != 0) & (k % 40 != 7)).select(*name, F.when(k % 6 == 0, "a").otherwise("b").alias("signature"), F.lit("x").alias("body_fp"))
    new = sup.filter((k % 8 != 0) & (k % 40 != 9)).select(*name, F.lit("b").alias("signature"), F.when(k % 7 == 0, "y").otherwise("x").alias("body_fp"))
    return old, new


@query(f"WITH {_SIDES} SELECT * FROM sd WHERE change IS NOT NULL")
def symbol_diff(s, d):
    """Symbols that two versions have differently."""
    return diffs.symbol_diff(*_sides(s, d))


@query(f"""WITH {_SIDES}, mo AS (SELECT DISTINCT module_id FROM so), mn AS (SELECT DISTINCT module_id FROM sn), io AS (SELECT DISTINCT module_id, 'i' || signature AS value FROM so), i2 AS (SELECT DISTINCT module_id, 'i' || body AS value FROM sn),
ch AS (SELECT module_id, 'imports_added' AS k, value FROM (SELECT * FROM i2 EXCEPT SELECT * FROM io) UNION ALL SELECT module_id, 'imports_removed', value FROM (SELECT * FROM io EXCEPT SELECT * FROM i2) UNION ALL SELECT module_id, CASE change WHEN 'added' THEN 'artifacts_added' WHEN 'removed' THEN 'artifacts_removed' ELSE 'artifacts_changed' END, symbol FROM sd WHERE change IS NOT NULL),
ms AS (SELECT module_id FROM ch UNION (SELECT module_id FROM mo EXCEPT SELECT module_id FROM mn) UNION (SELECT module_id FROM mn EXCEPT SELECT module_id FROM mo))
SELECT ms.module_id, ms.module_id NOT IN (SELECT module_id FROM mo) AS is_new, ms.module_id NOT IN (SELECT module_id FROM mn) AS is_deleted, {', '.join(f"coalesce(string_agg(DISTINCT CASE WHEN k = '{n}' THEN value END, ',' ORDER BY CASE WHEN k = '{n}' THEN value END), '') AS {n}" for n in ("imports_added", "imports_removed", "artifacts_added", "artifacts_removed", "artifacts_changed"))}
FROM ms LEFT JOIN ch ON ch.module_id = ms.module_id GROUP BY ms.module_id""")
def file_delta(s, d):
    """What changed in each module between two versions: imports, artifacts and whether it is new or gone."""
    old, new = _sides(s, d)
    value = lambda df, c: df.select("module_id", F.concat(F.lit("i"), c).alias("value")).distinct()
    one = lambda df: df.select("module_id").distinct()
    out = diffs.file_delta(one(old), one(new), value(old, "signature"), value(new, "body_fp"), old, new)
    return out.withColumns({c: F.array_join(c, ",") for c in ("imports_added", "imports_removed", "artifacts_added", "artifacts_removed", "artifacts_changed")})


@query(f"WITH {fx.EDGES}, t AS (SELECT DISTINCT src AS id FROM edges WHERE src <> 'm3'), f AS (SELECT DISTINCT dst AS id FROM edges WHERE dst <> 'm5') SELECT (SELECT count(*) FROM (SELECT * FROM t EXCEPT SELECT * FROM f)) AS missing, (SELECT count(*) FROM (SELECT * FROM f EXCEPT SELECT * FROM t)) AS surplus")
def coverage_check(s, d):
    """How many keys only one side has."""
    e = fx.edges(s, d)
    return diffs.covered(e.filter("src <> 'm3'").select(F.col("src").alias("id")).distinct(), e.filter("dst <> 'm5'").select(F.col("dst").alias("id")).distinct(), ["id"])


@query(f"WITH {fx.EDGES} SELECT src, dst, edge_type FROM edges WHERE src NOT IN ('m1', 'm2') UNION ALL SELECT 'm1', 'new', 'hard'")
def replaced_edges(s, d):
    """A graph with the edges out of two modules replaced."""
    ids = s.createDataFrame([("m1",), ("m2",)], "id string")
    return resolve.replace_out_edges(fx.edges(s, d), ids, s.createDataFrame([("m1", "new", "hard")], "src string, dst string, edge_type string"))


@query(f"WITH {fx.EDGES} SELECT src, dst, edge_type FROM edges WHERE src NOT IN ('m1', 'm2') AND dst NOT IN ('m1', 'm2')")
def dropped_modules(s, d):
    """A graph without two modules."""
    return resolve.drop_modules(fx.edges(s, d), s.createDataFrame([("m1",), ("m2",)], "id string"))


@query(f"WITH {fx.USAGE} SELECT * FROM usage WHERE consumer <> 'm4' UNION ALL SELECT 'm1', 'p0', 'm4', 'direct_calls'")
def replaced_slice(s, d):
    """Usage with one consumer's slice rebuilt."""
    u = fx.usage(s, d)
    return diffs.replace_slice(u, s.createDataFrame([("m4",)], "consumer string"), "consumer", s.createDataFrame([("m1", "p0", "m4", "direct_calls")], u.schema))


@query("""WITH f AS (SELECT 'm' || c_custkey % 120 AS module_id, CASE WHEN c_custkey % 10 <> 0 THEN 'f' END AS name, 'function' AS type, CASE WHEN c_custkey % 15 <> 1 THEN 'x' END AS code FROM customer)
SELECT DISTINCT module_id, 'missing value' AS reason FROM f WHERE name IS NULL OR code IS NULL UNION SELECT DISTINCT module_id, 'unknown module' FROM f WHERE module_id NOT IN (SELECT 'm' || s_suppkey FROM supplier)""")
def incomplete_facts(s, d):
    """Facts that lack what a collision needs, or belong to no module."""
    c = F.col("c_custkey")
    facts = fx.read(s, d, "customer").select(F.concat(F.lit("m"), (c % 120).cast("string")).alias("module_id"), F.when(c % 10 != 0, "f").alias("name"), F.lit("function").alias("type"), F.when(c % 15 != 1, "x").alias("code"))
    return col.incomplete(facts, fx.members(s, d))


@query(f"""WITH {_TWO}, ch AS (SELECT src FROM (SELECT * FROM en EXCEPT SELECT * FROM eo) UNION SELECT src FROM (SELECT * FROM eo EXCEPT SELECT * FROM en)), o AS (SELECT DISTINCT src AS id FROM eo), n AS (SELECT DISTINCT src AS id FROM en)
SELECT src AS module_id, src NOT IN (SELECT id FROM o) AS is_new, src NOT IN (SELECT id FROM n) AS is_deleted, CASE WHEN src NOT IN (SELECT id FROM n) THEN 'delete' WHEN src NOT IN (SELECT id FROM o) THEN 'add' ELSE 'import' END AS rule, CASE WHEN src IN (SELECT id FROM o) AND src IN (SELECT id FROM n) THEN 'none' ELSE 'dependents' END AS recompute FROM ch""")
def change_plans(s, d):
    """The plan for every module that two versions of a tree have differently."""
    sides = []
    for e in _two_graphs(s, d):
        imports = e.select(F.col("src").alias("module_id"), F.col("dst").alias("module"), F.when(F.col("edge_type") == "hard", 0).otherwise(1).alias("level"), F.array().cast("array<string>").alias("names"), F.lit(False).alias("is_local"), F.lit(False).alias("type_only"))
        none = lambda x: s.createDataFrame([], x)
        sides.append({"modules": e.select(F.col("src").alias("module_id")).distinct(), "imports": imports, "symbols": none("module_id string, symbol string, signature string, body_fp string"), "usage": none("module_id string, channel string, value string, extra string"), "collisions": none("module_id string, name string, type string, code string")})
    return planner.plans(planner.deltas(*sides)).select("module_id", "is_new", "is_deleted", "rule", "recompute")


@query("""WITH f AS (SELECT 'd' || doc_id % 9 || '/' || CASE WHEN doc_id % 13 = 0 THEN 'node_modules/' ELSE '' END || 'f' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.MD' WHEN 2 THEN '.bin' ELSE '.txt' END AS path, doc_id FROM documents)
SELECT path, doc_id % 4 IN (0, 1) AND doc_id % 13 <> 0 AND NOT ends_with(lower(path), '/f8.py') AS wanted, doc_id % 13 <> 0 AND NOT starts_with(path, 'd3/') AS kept FROM f""")
def bundle_files(s, d):
    """Which files a bundle takes, and which a scan does."""
    k = F.col("doc_id")
    ending = F.when(k % 4 == 0, ".py").when(k % 4 == 1, ".MD").when(k % 4 == 2, ".bin").otherwise(".txt")
    path = F.concat(F.lit("d"), (k % 9).cast("string"), F.lit("/"), F.when(k % 13 == 0, "node_modules/").otherwise(""), F.lit("f"), k.cast("string"), ending)
    files = fx.read(s, d, "documents").select(path.alias("path"))
    return files.select("path", sinks.wanted(F.col("path"), (".py", ".md"), ("node_modules",), ("f8.py",)).alias("wanted"), repo.keep_path(F.col("path"), ["d3"]).alias("kept"))


@query("""WITH p AS (SELECT 'a/b' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '/__init__' ELSE '' END || '.py' AS path FROM supplier) SELECT path, replace(regexp_replace(path, '\\.py$', ''), '/', '.') AS module_id FROM p""")
def module_ids(s, d):
    k = F.col("s_suppkey")
    path = F.concat(F.lit("a/b"), k.cast("string"), F.when(k % 3 == 0, "/__init__").otherwise(""), F.lit(".py"))
    return fx.read(s, d, "supplier").select(path.alias("path"), repo.module_id(path).alias("module_id"))


@query(f"""WITH {fx.EDGES}, c AS (SELECT count(*) AS n FROM nodes) SELECT CAST(n AS INT) AS nodes, CASE WHEN n <= 30 THEN 8 WHEN n <= 80 THEN 15 WHEN n <= 200 THEN 25 ELSE 40 END AS cluster_size, CASE WHEN n <= 30 THEN 10 WHEN n <= 80 THEN 18 WHEN n <= 200 THEN 30 ELSE 50 END AS refactor_cluster_size FROM c""")
def size_thresholds(s, d):
    n = deg.nodes_of(fx.edges(s, d)).count()
    t = hot.thresholds(n)
    return s.createDataFrame([(n, t["cluster_size"], t["refactor_cluster_size"])], "nodes int, cluster_size int, refactor_cluster_size int")


@query(f"WITH {fx.EDGES} SELECT (SELECT count(*) FROM edges) AS total, (SELECT count(*) FROM edges) > 7 AS truncated, string_agg(src || '>' || dst, ',' ORDER BY src, dst, edge_type) AS items FROM (SELECT * FROM edges ORDER BY src, dst, edge_type LIMIT 7)")
def bounded_list(s, d):
    """The first seven edges, how many there are, and whether some were left out."""
    from ..operators import ranking

    rows, total, cut = ranking.bounded(fx.edges(s, d), ["src", "dst", "edge_type"], 7)
    items = ",".join(f"{r['src']}>{r['dst']}" for r in rows.collect())
    return s.createDataFrame([(total, cut, items)], "total long, truncated boolean, items string")


# Contracts


@query(f"""WITH {fx.USAGE}, x AS (SELECT CASE WHEN CAST(substr(symbol, 2) AS BIGINT) % 40 = 0 THEN '' ELSE usage.definer END AS definer, symbol, CAST(substr(symbol, 2) AS BIGINT) AS p, list_sort(list(DISTINCT consumer)) AS c FROM usage GROUP BY usage.definer, symbol)
SELECT definer, symbol, 'name' AS problem FROM x WHERE definer = '' UNION ALL SELECT definer, symbol, 'consumers' FROM x WHERE p % 41 = 0 AND len(c) > 1 UNION ALL SELECT definer, symbol, 'channel of no consumer' FROM x WHERE p % 43 = 0 UNION ALL SELECT definer, symbol, 'channels' FROM x WHERE p % 47 = 0 AND p % 43 <> 0 UNION ALL SELECT definer, symbol, 'unknown channel' FROM x WHERE p % 53 = 0""")
def consumption_problems(s, d):
    """Consumption of all symbols with some planted defects: each is found, and nothing else."""
    x = con.consumption(fx.usage(s, d))
    p = F.substring("symbol", 2, 9).cast("int")
    name = F.when(p % 40 == 0, "").otherwise(F.col("definer"))
    first = F.col("consumers")[0]
    channels = F.when(p % 43 == 0, F.create_map(F.lit("~nobody"), F.array(F.lit("direct_calls")))).when(p % 47 == 0, F.create_map(first, F.array(F.lit("inheritance"), F.lit("direct_calls")))).otherwise(F.create_map(first, F.array(F.lit("direct_calls"))))
    odd = F.when(p % 53 == 0, F.transform_values(channels, lambda k, v: F.array_sort(F.concat(v, F.array(F.lit("~other")))))).otherwise(channels)
    broken = F.when(p % 47 == 0, channels).otherwise(odd)
    both = F.when((p % 47 == 0) & (p % 53 == 0), F.transform_values(channels, lambda k, v: F.concat(v, F.array(F.lit("~other"))))).otherwise(broken)
    return contracts.consumption_problems(x.select(name.alias("definer"), "symbol", F.when(p % 41 == 0, F.reverse("consumers")).otherwise(F.col("consumers")).alias("consumers"), both.alias("channels")))


@query(f"WITH {fx.EDGES}, {fx.SYMBOLS}, c AS (SELECT 'artifacts' AS name, (SELECT count(*) FROM symbols) AS one, (SELECT count(*) FROM (SELECT DISTINCT module_id FROM symbols)) AS other UNION ALL SELECT 'nodes', (SELECT count(*) FROM nodes), (SELECT count(*) FROM nodes)) SELECT * FROM c WHERE one <> other")
def sanity_checks(s, d):
    """Counts that must agree: one pair does, one doesn't."""
    n, sym = deg.nodes_of(fx.edges(s, d)).count(), fx.symbols(s, d)
    rows = [("artifacts", sym.distinct().count(), sym.select("module_id").distinct().count()), ("nodes", n, n), ("unknown", None, n)]
    return contracts.sanity(s.createDataFrame(rows, "name string, one long, other long"))


@query("""WITH RECURSIVE f AS (SELECT p_partkey AS i, CASE WHEN p_partkey % 97 = 5 THEN 'stale' ELSE 'fresh' END AS state FROM part WHERE p_partkey % 500 <> 499), n AS (SELECT p_partkey AS i, p_partkey // 2 AS t FROM part WHERE p_partkey > 1),
b AS (SELECT i FROM f WHERE state <> 'fresh' UNION SELECT t FROM n WHERE t NOT IN (SELECT i FROM f)), r(i) AS (SELECT i FROM b UNION SELECT n.i FROM r JOIN n ON n.t = r.i)
SELECT 't' || i AS family, state, i NOT IN (SELECT i FROM r) AS is_fresh FROM f""")
def family_freshness(s, d):
    """Tables that can be relied on: fresh, and so is all they are made of."""
    i = F.col("p_partkey")
    name = lambda x: F.concat(F.lit("t"), x.cast("string"))
    p = fx.read(s, d, "part")
    states = p.filter("p_partkey % 500 <> 499").select(name(i).alias("family"), F.when(i % 97 == 5, "stale").otherwise("fresh").alias("state"))
    return contracts.freshness(states, p.filter("p_partkey > 1").select(name(i).alias("family"), name(F.expr("p_partkey div 2")).alias("needed")))


@query("""WITH RECURSIVE b AS (SELECT p_partkey AS i FROM part WHERE p_partkey > 0), r(i, step) AS (SELECT i, 0 FROM b WHERE i = 1 UNION ALL SELECT b.i, step + 1 FROM r JOIN b ON b.i // 2 = r.i AND b.i > 1) SELECT 'b' || i AS name, CAST(step AS INT) AS step FROM r""")
def builder_order(s, d):
    """The step in which each of many builders runs."""
    i = F.col("p_partkey")
    key = lambda x: F.concat(F.lit("k"), x.cast("string"))
    needs = F.when(i > 1, F.array(key(F.expr("p_partkey div 2")))).otherwise(F.array().cast("array<string>"))
    return contracts.build_order(fx.read(s, d, "part").filter("p_partkey > 0").select(F.concat(F.lit("b"), i.cast("string")).alias("name"), needs.alias("requires"), F.array(key(i)).alias("provides")))


@query("""WITH f AS (SELECT 'src' || doc_id % 9 || '/' || lang || '/f' || doc_id || '.py' AS path FROM documents), m AS (SELECT DISTINCT CASE c_custkey % 3 WHEN 0 THEN 'src' || c_custkey % 12 WHEN 1 THEN 'src' || c_custkey % 12 || '/en' ELSE 'src' || c_custkey % 9 || '/en/f' || c_custkey || '.py' END AS original FROM customer)
SELECT original FROM m WHERE EXISTS (SELECT 1 FROM f WHERE path = original OR starts_with(path, original || '/'))""")
def stale_excludes(s, d):
    """Paths that were moved away and are back."""
    k, c = F.col("doc_id"), F.col("c_custkey")
    t = lambda x: x.cast("string")
    files = fx.read(s, d, "documents").select(F.concat(F.lit("src"), t(k % 9), F.lit("/"), "lang", F.lit("/f"), t(k), F.lit(".py")).alias("path"))
    asked = F.when(c % 3 == 0, F.concat(F.lit("src"), t(c % 12))).when(c % 3 == 1, F.concat(F.lit("src"), t(c % 12), F.lit("/en"))).otherwise(F.concat(F.lit("src"), t(c % 9), F.lit("/en/f"), t(c), F.lit(".py")))
    return contracts.stale_excludes(fx.read(s, d, "customer").select(asked.alias("original")), files)
