"""More queries on the generic tables: references, reports, registries and bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import collisions as col
from ..operators import consumption as con
from ..operators import degrees as deg
from ..operators import graphs, layers, prefixes, ranking, references, search, similarity
from ..operators import hotspots as hot
from ..operators import identity as ids
from ..sources import fixtures as fx
from ..sources import repository, sinks
from ..storage import stored
from ..streaming import journal as jr
from ..streaming import planner
from .registry import _HOT, _MATRIX, _RISK_ROWS, _catalogue, query

# Ranking


@query(f"WITH {fx.EDGES} SELECT id, in_degree, round((row_number() OVER (ORDER BY in_degree, id) - 1) / (count(*) OVER () - 1), 4) AS percentile, round(ln(1 + in_degree) / ln(1 + max(in_degree) OVER ()), 4) AS log_share FROM deg")
def normalised_degrees(s, d):
    e = fx.edges(s, d)
    rows = ranking.percentile_rank(deg.degrees(deg.hard(e), deg.nodes_of(e)), "in_degree", "id", "percentile")
    most = rows.agg(F.max("in_degree").alias("m"))
    return rows.crossJoin(F.broadcast(most)).select("id", "in_degree", "percentile", F.round(F.log1p("in_degree") / F.log1p("m"), 4).alias("log_share"))


@query("WITH x AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM x QUALIFY rank() OVER (PARTITION BY user_id ORDER BY n DESC) = 1")
def best_tier(s, d):
    x = fx.read(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return ranking.best(x, ["user_id"], "n").select("user_id", "event_type", "n")


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY user_id")
def first_seen(s, d):
    return ranking.first_seen(fx.read(s, d, "events").select("user_id", "event_type", "event_id"), ["user_id"], ["event_id"])


# Reports


def _shared(s, d):
    """All components of shared usage."""
    return similarity.shared_usage_components(fx.usage(s, d), most=2**31 - 1)


@query()
def debt(s, d):
    e = stored(fx.edges(s, d))  # asked many times
    return hot.debt(graphs.cycles(deg.hard(e), give="summary", n=0), e, hot.hotspots(e), _shared(s, d), col.collisions(fx.definitions(s, d)), deg.nodes_of(e).count())


_GROUPS = """ap AS (SELECT DISTINCT definer, symbol, consumer FROM usage WHERE consumer <> definer), aq AS (SELECT definer, symbol, min(consumer) AS head FROM ap GROUP BY ALL HAVING count(*) >= 2),
ab2 AS (SELECT consumer AS x, head AS y FROM ap JOIN aq USING (definer, symbol) UNION SELECT head, consumer FROM ap JOIN aq USING (definer, symbol)), ar(id, c) AS (SELECT x, x FROM ab2 UNION SELECT y, c FROM ar JOIN ab2 ON x = id),
aw AS (SELECT id, min(c) AS component FROM ar GROUP BY id), groups AS (SELECT component, list_sort(list(id)) AS modules FROM aw GROUP BY component HAVING count(*) >= 2)"""


@query(f"""WITH RECURSIVE {_HOT}, {_RISK_ROWS}, {fx.USAGE}, {_GROUPS}, nn AS (SELECT count(*) AS n FROM nodes), t AS (SELECT * FROM hotspots WHERE type <> 'NORMAL' ORDER BY score DESC, module LIMIT 10)
SELECT CASE type WHEN 'HUB' THEN 'EXTRACT_INTERFACE' ELSE 'SPLIT_MODULE' END AS type, t.module AS targets, CASE WHEN score + risk >= 0.85 THEN 'HIGH' ELSE 'MEDIUM' END AS priority,
  CASE type WHEN 'HOTSPOT' THEN 'high coupling detected' WHEN 'HUB' THEN 'high dependency centrality' WHEN 'OUTBOUND_HOTSPOT' THEN 'too many outgoing dependencies' END AS reason
FROM t JOIN risk ON risk.module = t.module WHERE type <> 'ISOLATED'
UNION ALL SELECT 'SPLIT_PACKAGE', array_to_string(modules, ','), 'MEDIUM', 'large isolated dependency cluster detected' FROM groups, nn WHERE len(modules) >= CASE WHEN n <= 30 THEN 10 WHEN n <= 80 THEN 18 WHEN n <= 200 THEN 30 ELSE 50 END AND len(modules) < n * 0.6""")
def refactor_plan(s, d):
    e = fx.edges(s, d)
    return hot.refactor_plan(hot.hotspots(e), hot.module_risk(e), _shared(s, d), deg.nodes_of(e).count()).withColumn("targets", F.array_join("targets", ","))


@query()
def architecture_signals(s, d):
    e = stored(fx.edges(s, d))  # asked many times
    return hot.architecture_signals(e, graphs.cycles(deg.hard(e), give="members"), hot.hotspots(e)).withColumn("signals", F.array_join("signals", ","))


@query(f"""WITH RECURSIVE {fx.EDGES}, {fx.USAGE}, {fx.MEMBERS}, u AS (SELECT DISTINCT consumer AS id FROM usage WHERE definer = 'm1' AND symbol = (SELECT min(symbol) FROM usage WHERE definer = 'm1')),
p AS (SELECT u.id, m.layer, m.is_test, (SELECT layer FROM members WHERE module_id = 'm1') AS own FROM u LEFT JOIN members m ON m.module_id = u.id),
w AS (SELECT CASE WHEN id = 'm1' THEN 'same_module' WHEN layer IS NULL THEN 'unknown' WHEN is_test THEN 'test' WHEN layer = own THEN 'same_layer' ELSE 'cross_layer' END AS w FROM p),
sd AS (SELECT id FROM u UNION SELECT 'm1'), r(seed, id, depth) AS (SELECT id, id, 0 FROM sd UNION SELECT seed, src, depth + 1 FROM r JOIN hard ON dst = id WHERE depth < 6), z AS (SELECT DISTINCT id FROM r WHERE id <> seed)
SELECT (SELECT count(*) FROM w WHERE w = 'same_module') AS same_module, (SELECT count(*) FROM w WHERE w = 'same_layer') AS same_layer, (SELECT count(*) FROM w WHERE w = 'cross_layer') AS cross_layer, (SELECT count(*) FROM w WHERE w = 'test') AS test, (SELECT count(*) FROM w WHERE w = 'unknown') AS unknown,
  (SELECT count(*) FROM z JOIN members ON module_id = id WHERE NOT is_test) AS downstream_production, (SELECT count(*) FROM z JOIN members ON module_id = id WHERE is_test) AS downstream_test, (SELECT count(*) FROM z WHERE id NOT IN (SELECT module_id FROM members)) AS downstream_unknown""")
def blast_radius(s, d):
    u = fx.usage(s, d).cache()
    first = u.filter("definer = 'm1'").agg(F.min("symbol")).first()[0]
    return con.blast_radius(u, deg.hard(fx.edges(s, d)), fx.members(s, d), "m1", first)


# Names


@query(f"""WITH {fx.SYMBOLS}, k AS (SELECT module_id, kind, symbol FROM symbols), z AS (SELECT DISTINCT module_id FROM symbols)
SELECT module_id AS definer, {', '.join(f"coalesce(string_agg(DISTINCT CASE WHEN kind = '{k}' THEN symbol END, ',' ORDER BY CASE WHEN kind = '{k}' THEN symbol END), '') AS {n}" for k, n in (('class', 'classes'), ('function', 'functions'), ('method', 'methods'), ('global', 'globals')))} FROM k GROUP BY module_id""")
def public_api(s, d):
    return con.public_api(fx.symbols(s, d).withColumnRenamed("module_id", "definer")).select("definer", *[F.array_join(n, ",").alias(n) for n in ("classes", "functions", "methods", "globals")])


@query(f"""WITH {fx.SYMBOLS}, {fx.USAGE} SELECT DISTINCT module_id, symbol FROM symbols WHERE (module_id, symbol) NOT IN (SELECT definer, symbol FROM usage WHERE channel <> 'api_imports') AND kind <> 'global' AND (module_id, symbol) NOT IN (SELECT definer, symbol FROM usage WHERE channel = 'event_bindings')""")
def unused_public(s, d):
    """An import alone is no use."""
    u = fx.usage(s, d).filter("channel <> 'api_imports'").select(F.col("definer").alias("module_id"), "symbol", "channel")
    sym = fx.symbols(s, d)
    return con.unused_public(sym, u, sym.filter("kind = 'global'"), u.filter("channel = 'event_bindings'"))


@query(f"""WITH {fx.SYMBOLS}, un AS (SELECT DISTINCT 'q' || CAST(c_custkey % 20 AS VARCHAR) AS module_id, CASE c_custkey % 4 WHEN 0 THEN 'm' || CAST(1 + c_custkey % 50 AS VARCHAR) || '.p' || CAST(1 + c_custkey % 900 AS VARCHAR) WHEN 1 THEN 'x.p' || CAST(1 + c_custkey % 900 AS VARCHAR) WHEN 2 THEN 'np.p' || CAST(1 + c_custkey % 900 AS VARCHAR) ELSE 'obj.append' END AS name FROM customer),
kn AS (SELECT DISTINCT module_id AS definer, symbol FROM symbols), si AS (SELECT symbol, min(definer) AS d FROM kn GROUP BY symbol HAVING count(*) = 1),
j AS (SELECT un.module_id, un.name, kn.definer, kn.symbol, string_split(un.name, '.')[-1] AS leaf, string_split(un.name, '.')[1] AS root FROM un LEFT JOIN kn ON un.name = kn.definer || '.' || kn.symbol)
SELECT j.module_id, j.name, coalesce(j.definer, CASE WHEN root <> 'np' THEN si.d END) AS definer, coalesce(j.symbol, CASE WHEN root <> 'np' THEN si.symbol END) AS symbol, CASE WHEN j.definer IS NOT NULL THEN 'confirmed' WHEN root <> 'np' AND si.d IS NOT NULL THEN 'ambiguous' ELSE 'none' END AS match FROM j LEFT JOIN si ON si.symbol = j.leaf""")
def name_matches(s, d):
    k = F.col("c_custkey")
    part = lambda n: (1 + k % n).cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("m"), part(50), F.lit(".p"), part(900))).when(k % 4 == 1, F.concat(F.lit("x.p"), part(900))).when(k % 4 == 2, F.concat(F.lit("np.p"), part(900))).otherwise("obj.append")
    owner = F.concat(F.lit("q"), (k % 20).cast("string"))
    uses = fx.read(s, d, "customer").select(owner.alias("module_id"), name.alias("name"))
    return references.match_names(uses, fx.symbols(s, d), uses.select("module_id", F.lit("np").alias("alias")))


@query(f"""WITH {fx.PAGES}, im AS (SELECT a.module_id, b.module_id AS module FROM page_modules a JOIN page_modules b ON b.page_id = a.page_id + 1), t AS (SELECT DISTINCT module_id AS target, string_split(module_id, '.')[-1] AS leaf FROM page_modules)
SELECT DISTINCT target, module_id FROM im JOIN t ON module = target OR (contains(module, '.') AND string_split(module, '.')[-1] = leaf) WHERE target <> module_id""")
def import_users(s, d):
    m = fx.page_modules(s, d)
    imports = m.join(m.select((F.col("page_id") - 1).alias("page_id"), F.col("module_id").alias("module")), "page_id")
    return references.import_users(imports, m.select(F.col("module_id").alias("target")))


@query(f"""WITH {fx.SYMBOLS}, a AS (SELECT 'm' || CAST(i % 30 + 1 AS VARCHAR) || CASE WHEN i % 2 = 0 THEN '::' ELSE '.' END || 'p' || CAST(i AS VARCHAR) AS name FROM (SELECT p_partkey AS i FROM part)), k AS (SELECT DISTINCT module_id, symbol FROM symbols)
SELECT a.name, k.module_id AS definer, k.symbol, CASE WHEN k.symbol IS NULL THEN 'unresolved' ELSE 'resolved' END AS status FROM a LEFT JOIN k ON a.name IN (k.module_id || '::' || k.symbol, k.module_id || '.' || k.symbol)""")
def target_resolution(s, d):
    i = F.col("id")
    asked = fx.read(s, d, "part").select(F.col("p_partkey").alias("id")).select(F.concat(F.lit("m"), (i % 30 + 1).cast("string"), F.when(i % 2 == 0, "::").otherwise("."), F.lit("p"), i.cast("string")).alias("name"))
    return references.resolve_target(asked, fx.symbols(s, d))


@query(f"""WITH {fx.MODULES}, a AS (SELECT CASE doc_id % 3 WHEN 0 THEN path WHEN 1 THEN string_split(path, '/')[-2] || '/' || string_split(path, '/')[-1] ELSE 'elsewhere/' || string_split(path, '/')[-1] END AS asked, module_id FROM modules)
SELECT DISTINCT asked, module_id FROM a""")
def file_locations(s, d):
    m = fx.modules(s, d)
    p = F.split("path", "/")
    asked = F.when(F.col("doc_id") % 3 == 0, F.col("path")).when(F.col("doc_id") % 3 == 1, F.array_join(F.slice(p, -2, 2), "/")).otherwise(F.concat(F.lit("elsewhere/"), F.element_at(p, -1)))
    return references.locate(m.select(asked.alias("asked")), m)


@query(f"""WITH u AS (SELECT DISTINCT 'm' || CAST(l_suppkey AS VARCHAR) AS module_id, 'a' || CAST(l_partkey % 40 AS VARCHAR) || '.f' AS value FROM lineitem), al AS (SELECT DISTINCT 'm' || CAST(s_suppkey AS VARCHAR) AS module_id, 'a' || CAST(s_suppkey % 40 AS VARCHAR) AS alias, 'pkg.mod' AS target FROM supplier)
SELECT DISTINCT u.module_id FROM u JOIN al ON al.module_id = u.module_id AND u.value = al.alias || '.f' UNION SELECT module_id FROM al""")
def changed_dependents(s, d):
    u = fx.read(s, d, "lineitem").select(F.concat(F.lit("m"), F.col("l_suppkey").cast("string")).alias("module_id"), F.lit("direct_calls").alias("channel"), F.concat(F.lit("a"), (F.col("l_partkey") % 40).cast("string"), F.lit(".f")).alias("value"))
    a = fx.read(s, d, "supplier").select(F.concat(F.lit("m"), F.col("s_suppkey").cast("string")).alias("module_id"), F.concat(F.lit("a"), (F.col("s_suppkey") % 40).cast("string")).alias("alias"), F.lit("pkg.mod").alias("target"))
    return planner.dependents(u, a, s.createDataFrame([("pkg.mod",)], "module_id string"))


@query(f"""WITH {fx.MODULES}, r AS (SELECT DISTINCT array_to_string(string_split(module_id, '.')[1:2], '.') AS root FROM modules WHERE doc_id % 5 = 0) SELECT module_id, root FROM modules JOIN r ON module_id = root OR starts_with(module_id, root || '.')""")
def below_root(s, d):
    m = fx.modules(s, d)
    roots = m.filter("doc_id % 5 = 0").select(F.array_join(F.slice(F.split("module_id", r"\."), 1, 2), ".").alias("r"))
    return prefixes.under(m.select("module_id"), "module_id", roots, "r")


# Similarity and usage


@query(f"""WITH RECURSIVE {fx.USAGE}, p AS (SELECT DISTINCT definer, symbol, consumer FROM usage WHERE consumer <> definer) SELECT 'all' AS component, definer, count(DISTINCT symbol) AS artifacts FROM p GROUP BY definer""")
def dominant_definers(s, d):
    u = fx.usage(s, d)
    where = u.select(F.col("consumer").alias("id"), F.lit("all").alias("component")).distinct()
    return similarity.dominant_definers(u, where)


@query(f"""WITH {fx.USAGE}, p AS (SELECT DISTINCT definer, symbol, consumer FROM usage WHERE consumer <> definer), c AS (SELECT CAST(substr(consumer, 2) AS INT) % 4 AS g, definer, symbol, count(*) AS consumers FROM p GROUP BY ALL HAVING count(*) > 1)
SELECT 'g' || CAST(g AS VARCHAR) AS component, definer, symbol, consumers FROM c QUALIFY row_number() OVER (PARTITION BY g ORDER BY consumers DESC, definer, symbol) <= 10""")
def extraction_candidates(s, d):
    u = fx.usage(s, d)
    where = u.select(F.col("consumer").alias("id"), F.concat(F.lit("g"), (F.substring("consumer", 2, 9).cast("int") % 4).cast("string")).alias("component")).distinct()
    return similarity.extraction_candidates(u, where)


@query(f"WITH {fx.ITEMS}, a AS (SELECT owner, list(item) AS s FROM items GROUP BY owner) SELECT x.owner AS a, y.owner AS b, round(len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))), 9) AS jaccard FROM a x, a y WHERE x.owner IN ('u1', 'u2', 'u3') AND y.owner IN ('u4', 'u5')")
def jaccard_values(s, d):
    sets = fx.owner_items(s, d).groupBy("owner").agg(F.collect_set("item").alias("s"))
    pick = lambda p, *names: sets.filter(F.col("owner").isin(*names)).select(F.col("owner").alias(p), F.col("s").alias(f"s{p}"))
    both = pick("a", "u1", "u2", "u3").crossJoin(F.broadcast(pick("b", "u4", "u5")))  # three by two rows
    return both.select("a", "b", F.round(similarity.jaccard(F.col("sa"), F.col("sb")), 9).alias("jaccard"))


@query(f"WITH {_MATRIX}, {fx.MEMBERS} SELECT consumer, definer, weight FROM matrix WHERE consumer IN (SELECT module_id FROM members WHERE layer = 'ui') AND definer IN (SELECT module_id FROM members WHERE layer = 'ui')")
def scoped_matrix(s, d):
    cells = deg.matrix(fx.usage(s, d), fx.edges(s, d)).select(F.col("consumer").alias("src"), F.col("definer").alias("dst"), "weight")
    scope = fx.members(s, d).filter("layer = 'ui'").select(F.col("module_id").alias("id"))
    return deg.scoped(cells, scope).select(F.col("src").alias("consumer"), F.col("dst").alias("definer"), "weight")


@query(f"WITH {fx.EDGES}, {fx.MEMBERS} SELECT src AS \"from\", dst AS \"to\", 'resolver_fallback' AS reason FROM edges WHERE edge_type = 'soft'")
def soft_dependencies(s, d):
    return fx.edges(s, d).filter("edge_type = 'soft'").select(F.col("src").alias("from"), F.col("dst").alias("to"), F.lit("resolver_fallback").alias("reason"))


# Blocks, registries, files


@query(f"""WITH {fx.USAGE}, b AS (SELECT definer || '::' || symbol AS artifact_id, definer, list_sort(list(DISTINCT consumer)) AS c FROM usage GROUP BY definer, symbol)
SELECT artifact_id, definer, array_to_string(list_filter([CASE WHEN definer = 'm5' THEN 'defines' END, CASE WHEN list_contains(c, 'm5') THEN 'consumes' END], lambda x: x IS NOT NULL), ',') AS roles FROM b WHERE definer = 'm5' OR list_contains(c, 'm5')""")
def block_selection(s, d):
    blocks = con.consumption(fx.usage(s, d)).select(F.concat_ws("::", "definer", "symbol").alias("artifact_id"), "definer", "consumers")
    return search.block_selection(blocks, "m5").select("artifact_id", "definer", F.array_join("roles", ",").alias("roles"))


@query("""WITH o AS (SELECT p_partkey AS slot, p_name || CAST(p_partkey AS VARCHAR) AS name, CASE WHEN p_partkey % 2 = 0 THEN 'orphan' ELSE 'active' END AS status FROM part), t AS (SELECT sum(strlen(name)) AS b FROM o),
l AS (SELECT *, coalesce(sum(strlen(name)) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o WHERE status = 'orphan' AND slot % 10 <> 0)
SELECT CAST(slot AS INT) AS slot, name, status FROM o WHERE slot NOT IN (SELECT slot FROM l, t WHERE b - before > 1500)""")
def registry_garbage(s, d):
    p = fx.read(s, d, "part")
    k = F.col("p_partkey")
    table = p.select(F.lit("module").alias("kind"), k.cast("int").alias("slot"), F.lit(1).alias("generation"), F.concat("p_name", k.cast("string")).alias("name"), F.when(k % 2 == 0, "orphan").otherwise("active").alias("status"), F.timestamp_seconds(k).alias("removed_at"))
    refs = p.filter("p_partkey % 10 = 0").select(F.concat(k.cast("string"), F.lit("/1")).alias("obj_id"))
    return ids.collect_garbage(table, refs, "module", 1500).select("slot", "name", "status")


@query("""WITH o AS (SELECT 'f' || CAST(doc_id AS VARCHAR) AS path, doc_id AS m, sha256(coalesce(text, '')) AS h FROM documents WHERE doc_id % 7 <> 1), n AS (SELECT 'f' || CAST(doc_id AS VARCHAR) AS path, doc_id + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS m, CASE WHEN doc_id % 6 = 0 THEN 'new' ELSE sha256(coalesce(text, '')) END AS h FROM documents WHERE doc_id % 7 <> 2)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'create' WHEN n.path IS NULL THEN 'delete' ELSE 'edit' END AS change FROM o FULL OUTER JOIN n ON o.path = n.path WHERE o.path IS NULL OR n.path IS NULL OR (o.m <> n.m AND o.h <> n.h)""")
def changed_files(s, d):
    k = F.col("doc_id")
    docs = fx.read(s, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    path = F.concat(F.lit("f"), k.cast("string")).alias("path")
    old = docs.filter(k % 7 != 1).select(path, k.alias("mtime_ns"), F.lit(1).cast("long").alias("size"), F.col("h").alias("sha256"))
    new = docs.filter(k % 7 != 2).select(path, (k + F.when(k % 3 == 0, 1).otherwise(0)).alias("mtime_ns"), F.lit(1).cast("long").alias("size"), F.when(k % 6 == 0, "new").otherwise(F.col("h")).alias("sha256"))
    return repository.changed_files(old, new)


@query("SELECT count(*) AS files, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes, CAST(sum(len(string_split(coalesce(text, ''), chr(10)))) AS BIGINT) AS lines FROM documents")
def bundle_estimate(s, d):
    return sinks.estimate(fx.texts(s, d).fillna({"text": ""}))


@query(f"""WITH {fx.MODULES} SELECT module_id, string_split(module_id, '.')[1] AS layer, starts_with(module_id, 'src1.') OR module_id = 'src1' AS inside FROM modules""")
def layer_membership(s, d):
    name = F.col("module_id")
    return fx.modules(s, d).select("module_id", layers.top_layer(name).alias("layer"), layers.in_layer(name, "src1").alias("inside"))


@query("""WITH w AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS path, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)')) AS name FROM documents) SELECT DISTINCT path FROM w WHERE name IN ('license', 'License', 'GNU')""")
def text_prefilter(s, d):
    return references.texts_with(fx.texts(s, d), s.createDataFrame([("license",), ("License",), ("GNU",)], "name string")).select("path")


@query("SELECT event_id AS revision, event_type AS operation FROM events WHERE event_id > (SELECT max(event_id) - 100 FROM events)")
def retained_events(s, d):
    return jr.retained(fx.journal(s, d)).select("revision", "operation")


@query("""WITH x AS (SELECT 'm' || CAST(user_id AS VARCHAR) AS module_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new, event_id FROM events),
y AS (SELECT module_id, ts, sum(new) OVER (PARTITION BY module_id ORDER BY ts, event_id) AS k FROM x) SELECT module_id, min(ts) AS session_start, count(*) AS events FROM y GROUP BY module_id, k""")
def journal_sessions(s, d):
    return jr.sessions(fx.journal(s, d)).select("module_id", F.col("session_window.start").alias("session_start"), "events")
