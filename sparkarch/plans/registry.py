"""All queries of the engine by name, each on the generic tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import collisions as col
from ..operators import consumption as con
from ..operators import degrees as deg
from ..operators import diffs, graphs, layers, prefixes, resolve, search, similarity
from ..operators import hotspots as hot
from ..operators import identity as ids
from ..sources import fixtures as fx
from ..streaming import journal as jr
from . import dsl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if it has any."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Degrees, metrics, hotspots


@query(f"WITH {fx.EDGES} SELECT id, in_degree, out_degree FROM deg")
def degrees(s, d):
    e = fx.edges(s, d)
    return deg.degrees(deg.hard(e), deg.nodes_of(e))


@query(f"""WITH {fx.EDGES}, m AS (SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM hard) AS edges_hard, (SELECT count(*) FROM edges WHERE edge_type = 'soft') AS edges_soft, (SELECT count(*) FROM edges) AS edges_total)
SELECT nodes, edges_hard, edges_soft, edges_total, CASE WHEN nodes > 1 THEN round(edges_hard / (nodes * greatest(nodes - 1, 1)), 4) ELSE 0.0 END AS density,
  (SELECT max(in_degree) FROM deg) AS in_degree_max, (SELECT max(out_degree) FROM deg) AS out_degree_max FROM m""")
def graph_metrics(s, d):
    return deg.graph_metrics(fx.edges(s, d))


_HOT = f"""{fx.EDGES},
p AS (SELECT id, in_degree, out_degree, CASE WHEN count(*) OVER () = 1 THEN 1.0 ELSE round((row_number() OVER (ORDER BY in_degree, id) - 1) / (count(*) OVER () - 1), 4) END AS i FROM deg),
q AS (SELECT id, CASE WHEN count(*) OVER () = 1 THEN 1.0 ELSE round((row_number() OVER (ORDER BY out_degree, id) - 1) / (count(*) OVER () - 1), 4) END AS c FROM deg WHERE out_degree > 0),
r AS (SELECT p.id, in_degree, out_degree, i, coalesce(c, 0.0) AS c, in_degree + out_degree AS t, sqrt(CAST(in_degree * out_degree AS DOUBLE)) AS g FROM p LEFT JOIN q ON p.id = q.id),
u AS (SELECT *, round(ln(1 + t) / ln(1 + max(t) OVER ()), 4) AS l, round(g / max(g) OVER (), 4) AS b FROM r),
hotspots AS (
  SELECT id AS module, CASE WHEN t = 0 THEN 'ISOLATED' WHEN i >= 0.9 AND c <= 0.35 THEN 'HUB' WHEN i >= 0.85 AND c >= 0.85 THEN 'HOTSPOT' WHEN c >= 0.9 THEN 'OUTBOUND_HOTSPOT' ELSE 'NORMAL' END AS type,
    CASE WHEN t = 0 THEN 0.0 ELSE round((i + c + l + b) / 4, 4) END AS score, CASE WHEN t = 0 THEN 0.0 ELSE i END AS impact_percentile, CASE WHEN t = 0 THEN 0.0 ELSE c END AS complexity_percentile, in_degree, out_degree FROM u)"""


@query(f"WITH {_HOT} SELECT * FROM hotspots WHERE type <> 'NORMAL'")
def hotspots(s, d):
    return hot.ordered(hot.hotspots(fx.edges(s, d)))


@query(f"WITH {_HOT} SELECT * FROM hotspots WHERE type <> 'NORMAL' ORDER BY score DESC, module LIMIT 5")
def top_hotspots(s, d):
    return hot.ordered(hot.hotspots(fx.edges(s, d)), 5)


@query(f"""WITH {_HOT}, t AS (SELECT *, row_number() OVER (ORDER BY score DESC, module) AS priority FROM hotspots WHERE type <> 'NORMAL' ORDER BY score DESC, module LIMIT 10),
x AS (SELECT module, priority, list_sort(list_distinct(list_filter([CASE type WHEN 'CONFIG_HUB' THEN 'shared_configuration_dependency' WHEN 'HOTSPOT' THEN 'high_coupling' WHEN 'OUTBOUND_HOTSPOT' THEN 'high_out_degree' WHEN 'HUB' THEN 'high_dependency_centrality' END,
  CASE WHEN out_degree >= 10 THEN 'high_out_degree' END, CASE WHEN in_degree >= 10 THEN 'high_in_degree' END, CASE WHEN in_degree >= 20 THEN 'many_dependents' END], lambda s: s IS NOT NULL))) AS signals FROM t)
SELECT module, priority, array_to_string(signals, ',') AS signals FROM x WHERE len(signals) > 0""")
def inspection_targets(s, d):
    found = hot.inspection_targets(hot.hotspots(fx.edges(s, d)))
    return found.withColumn("priority", F.col("priority").cast("long")).withColumn("signals", F.array_join("signals", ","))


_RISK_ROWS = """so AS (SELECT src, count(*) AS k FROM edges WHERE edge_type = 'soft' GROUP BY src),
n AS (SELECT id, in_degree, out_degree, coalesce(k, 0) AS soft FROM deg LEFT JOIN so ON src = id),
risk AS (SELECT id AS module, round((in_degree / greatest(max(in_degree) OVER (), 1)) * 0.5 + (out_degree / greatest(max(out_degree) OVER (), 1)) * 0.3 + least(soft / greatest(max(soft) OVER (), 1), 1.0) * 0.2, 4) AS risk FROM n)"""
_RISK = f"{fx.EDGES}, {_RISK_ROWS}"


@query(f"WITH {_RISK} SELECT * FROM risk")
def module_risk(s, d):
    return hot.module_risk(fx.edges(s, d))


@query(f"WITH {_RISK} SELECT CAST(count_if(risk >= 0.85) AS BIGINT) AS critical, round(avg(risk), 4) AS average, max(risk) AS max FROM risk")
def risk_summary(s, d):
    return hot.risk_summary(hot.module_risk(fx.edges(s, d)))


# Usage and matrix

_MATRIX = f"""{fx.EDGES}, {fx.USAGE},
ty AS (SELECT definer, symbol, list(DISTINCT CASE WHEN channel IN ('direct_calls', 'runtime_calls', 'callback_calls', 'event_bindings') THEN 'call' WHEN channel = 'inheritance' THEN 'inheritance' ELSE 'import' END) AS types FROM usage GROUP BY ALL),
pr AS (SELECT DISTINCT definer, symbol, consumer FROM usage WHERE definer <> consumer),
ce AS (SELECT consumer, definer, 1 AS w, unnest(types) AS t, symbol FROM pr JOIN ty USING (definer, symbol) UNION ALL SELECT src, dst, 0, 'import', NULL FROM hard WHERE src <> dst),
matrix AS (SELECT consumer, definer, count(DISTINCT symbol) AS weight, list_sort(list(DISTINCT t)) AS dep_types FROM ce GROUP BY consumer, definer)"""


@query(f"WITH {_MATRIX} SELECT consumer, definer, weight, array_to_string(dep_types, ',') AS dep_types FROM matrix")
def dependency_matrix(s, d):
    return deg.matrix(fx.usage(s, d), fx.edges(s, d)).withColumn("dep_types", F.array_join("dep_types", ","))


@query(f"WITH {_MATRIX} SELECT unnest(dep_types) AS dep_type, count(*) AS pairs FROM matrix GROUP BY 1")
def dep_type_breakdown(s, d):
    return deg.dep_type_breakdown(deg.matrix(fx.usage(s, d), fx.edges(s, d)))


@query(f"WITH {_MATRIX}, n AS (SELECT consumer AS id FROM matrix UNION SELECT definer FROM matrix) SELECT id, (SELECT count(*) FROM matrix WHERE definer = id) AS fan_in, (SELECT count(*) FROM matrix WHERE consumer = id) AS fan_out FROM n")
def fan_in_out(s, d):
    return deg.fan(deg.matrix(fx.usage(s, d), fx.edges(s, d)))


@query(f"WITH {fx.USAGE} SELECT definer, count(DISTINCT symbol) AS export_degree FROM usage GROUP BY definer")
def export_degree(s, d):
    return deg.export_degree(fx.usage(s, d))


@query(f"""WITH {fx.USAGE}, c AS (SELECT definer, symbol, consumer, list_sort(list(DISTINCT channel)) AS ch FROM usage GROUP BY ALL)
SELECT definer, symbol, string_agg(consumer, ',' ORDER BY consumer) AS consumers, count(*) AS consumer_count, string_agg(consumer || '=' || array_to_string(ch, '+'), ',' ORDER BY consumer) AS channels FROM c GROUP BY definer, symbol""")
def consumption(s, d):
    x = con.consumption(fx.usage(s, d))
    each = F.transform(F.map_entries("channels"), lambda e: F.concat_ws("=", e["key"], F.array_join(e["value"], "+")))
    return x.select("definer", "symbol", F.array_join("consumers", ",").alias("consumers"), "consumer_count", F.array_join(each, ",").alias("channels"))


@query(f"""WITH {fx.USAGE}, o AS (SELECT DISTINCT definer, symbol FROM usage WHERE consumer <> definer)
SELECT DISTINCT definer, symbol, consumer FROM usage JOIN o USING (definer, symbol)""")
def artifact_index(s, d):
    return con.artifact_index(fx.usage(s, d))


@query(f"""WITH {fx.USAGE} SELECT definer, symbol, count(DISTINCT consumer) AS consumer_count, {', '.join(f"count(DISTINCT CASE WHEN channel = '{c}' THEN consumer END) AS {c}" for c in con.CHANNELS)}
FROM usage WHERE consumer <> definer GROUP BY definer, symbol""")
def consumer_counts(s, d):
    return con.consumer_counts(fx.usage(s, d))


@query(f"WITH {fx.USAGE} SELECT definer, symbol, count(DISTINCT consumer) AS consumer_count FROM usage WHERE consumer <> definer GROUP BY definer, symbol HAVING count(DISTINCT consumer) >= 2")
def shared_artifacts(s, d):
    return con.shared_artifacts(fx.usage(s, d))


@query(f"""WITH {fx.USAGE}, {fx.SYMBOLS}, u AS (SELECT definer, symbol, count(*) AS k FROM usage WHERE consumer <> definer GROUP BY ALL),
b AS (SELECT DISTINCT s.module_id, s.symbol, u.k FROM symbols s LEFT JOIN u ON u.definer = s.module_id AND u.symbol = s.symbol)
SELECT count(*) AS symbols, count(k) AS used, CAST(count_if(k IS NULL) AS BIGINT) AS dead, CAST(coalesce(sum(k), 0) AS BIGINT) AS uses FROM b""")
def consumer_summary(s, d):
    return con.consumer_summary(fx.symbols(s, d).withColumnRenamed("module_id", "definer"), fx.usage(s, d))


@query(f"""WITH {fx.USAGE}, {fx.MEMBERS}, x AS (SELECT DISTINCT definer, consumer FROM usage WHERE definer <> consumer),
y AS (SELECT definer, list(DISTINCT coalesce(layer, 'adapter')) AS ls FROM x LEFT JOIN members ON module_id = consumer GROUP BY definer)
SELECT module_id, layer, CASE WHEN ls IS NULL THEN 'private' WHEN len(list_filter(ls, lambda l: l <> layer)) > 0 THEN 'public' ELSE 'internal' END AS visibility FROM members LEFT JOIN y ON definer = module_id""")
def visibility(s, d):
    return layers.visibility(fx.members(s, d).drop("is_test"), fx.usage(s, d))


# Layers

_AB = f"{fx.EDGES}, {fx.MEMBERS}, ab AS (SELECT src, dst, m.layer AS a, n.layer AS b FROM hard LEFT JOIN members m ON m.module_id = src LEFT JOIN members n ON n.module_id = dst)"


@query(f"WITH {_AB} SELECT src, dst, CASE WHEN a = 'engine' AND b = 'engine' THEN 'internal' WHEN b = 'engine' THEN 'inbound' ELSE 'outbound' END AS direction FROM ab WHERE a = 'engine' OR b = 'engine'")
def layer_boundary(s, d):
    return layers.boundary(fx.edges(s, d), fx.members(s, d), "engine")


@query(f"""WITH {_AB}, e AS (SELECT a AS layer, CASE WHEN a = b THEN 'internal' ELSE 'outbound' END AS way FROM ab UNION ALL SELECT b, 'inbound' FROM ab WHERE a <> b),
k AS (SELECT layer, CAST(count_if(way = 'internal') AS BIGINT) AS internal_edges, CAST(count_if(way = 'inbound') AS BIGINT) AS inbound_edges, CAST(count_if(way = 'outbound') AS BIGINT) AS outbound_edges FROM e GROUP BY layer),
z AS (SELECT layer, count(DISTINCT module_id) AS nodes FROM members GROUP BY layer)
SELECT layer, nodes, coalesce(internal_edges, 0) AS internal_edges, coalesce(inbound_edges, 0) AS inbound_edges, coalesce(outbound_edges, 0) AS outbound_edges,
  CASE WHEN nodes > 1 THEN round(coalesce(internal_edges, 0) / (nodes * (nodes - 1)), 4) ELSE 0.0 END AS density, round(CASE WHEN nodes > 1 THEN round(coalesce(internal_edges, 0) / (nodes * (nodes - 1)), 4) ELSE 0.0 END / 0.01, 2) AS density_ratio
FROM z LEFT JOIN k USING (layer)""")
def layer_metrics(s, d):
    return layers.layer_metrics(fx.edges(s, d), fx.members(s, d), 0, 0.01)


@query(f"""WITH {_AB}, o AS (SELECT * FROM ab WHERE a = 'engine' OR b = 'engine')
SELECT module_id AS id, (SELECT count(*) FROM o WHERE dst = module_id) AS in_degree, (SELECT count(*) FROM o WHERE src = module_id) AS out_degree,
  (SELECT count(*) FROM o WHERE dst = module_id AND a = b) AS internal_in, (SELECT count(*) FROM o WHERE src = module_id AND a = b) AS internal_out FROM members WHERE layer = 'engine'""")
def layer_degrees(s, d):
    return layers.layer_degrees(fx.edges(s, d), fx.members(s, d), "engine")


_ORDER = "['tests', 'ui', 'cli', 'contract', 'engine', 'runtime', 'adapter']"


@query(f"""WITH {_MATRIX}, {fx.MEMBERS} SELECT DISTINCT consumer AS src, m.layer AS src_layer, definer AS dst, n.layer AS dst_layer FROM matrix JOIN members m ON m.module_id = consumer JOIN members n ON n.module_id = definer
WHERE consumer <> definer AND list_position({_ORDER}, m.layer) > list_position({_ORDER}, n.layer)""")
def layer_violations(s, d):
    return layers.rank_violations(deg.matrix(fx.usage(s, d), fx.edges(s, d)), fx.members(s, d))


@query(f"WITH {_AB} SELECT src, dst, a || '->' || b AS rule FROM ab WHERE (a = 'ui' AND b = 'cli') OR (a = 'cli' AND b = 'ui')")
def forbidden_dependencies(s, d):
    return layers.rule_violations(fx.edges(s, d), fx.members(s, d))


@query(f"WITH {fx.MEMBERS} SELECT layer, count(*) AS modules FROM members GROUP BY layer")
def layer_distribution(s, d):
    return fx.members(s, d).groupBy("layer").agg(F.count("*").alias("modules"))


@query(f"""WITH {fx.MODULES} SELECT module_id, CASE WHEN starts_with(module_id, 'src1') THEN 'runtime' WHEN starts_with(module_id, 'src0.en') THEN 'ui' WHEN starts_with(module_id, 'src0') THEN 'cli' ELSE 'adapter' END AS layer, string_split(module_id, '.')[1] AS top FROM modules""")
def layer_rules(s, d):
    rules = [("src1", "runtime"), ("src0.en", "ui"), ("src0", "cli")]
    return fx.modules(s, d).select("module_id", layers.layer_by_rules(F.col("module_id"), rules).alias("layer"), layers.top_layer(F.col("module_id")).alias("top"))


# Graph


@query(f"""WITH RECURSIVE {fx.EDGES}, r(id, depth) AS (SELECT 'm1', 0 UNION SELECT src, depth + 1 FROM r JOIN hard ON dst = id WHERE depth < 6)
SELECT 'm1' AS seed, id, min(depth) AS depth FROM r WHERE id <> 'm1' GROUP BY id""")
def transitive_dependents(s, d):
    seeds = s.createDataFrame([("m1",)], "id string")
    return graphs.transitive_dependents(deg.hard(fx.edges(s, d)), seeds)


@query(f"WITH RECURSIVE {fx.EDGES}, r(id) AS (SELECT 'm1' UNION SELECT src FROM r JOIN edges ON dst = id) SELECT id FROM r")
def affected_set(s, d):
    e = fx.edges(s, d)
    return graphs.affected_set(e.filter("src <> 'm2'"), e, s.createDataFrame([("m1",)], "id string"))


@query(f"""WITH RECURSIVE {fx.EDGES},
b AS (SELECT src AS x, dst AS y FROM edges UNION SELECT dst, src FROM edges), r(id, c) AS (SELECT x, x FROM b UNION SELECT y, c FROM r JOIN b ON x = id)
SELECT id, min(c) AS component FROM r GROUP BY id""")
def components(s, d):
    return graphs.components(fx.edges(s, d))


def _unrolled_pagerank(n: int) -> str:
    out = [f"WITH {fx.EDGES}, o AS (SELECT src, count(*) AS k FROM hard GROUP BY src), nd AS (SELECT src AS id FROM hard UNION SELECT dst FROM hard), c AS (SELECT count(*) AS n FROM nd), r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / n AS rank FROM nd, c)"]
    for i in range(n):
        out.append(f"""r{i + 1} AS MATERIALIZED (SELECT nd.id, 0.15::DOUBLE / c.n + 0.85::DOUBLE * (coalesce(g, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM o)) / c.n) AS rank
 FROM nd CROSS JOIN c LEFT JOIN (SELECT dst, sum(rank / k) AS g FROM hard JOIN r{i} ON r{i}.id = hard.src JOIN o ON o.src = hard.src GROUP BY dst) x ON x.dst = nd.id)""")
    return ",\n".join(out) + f" SELECT id, round(rank / max(rank) OVER (), 6) AS pagerank FROM r{n}"


@query(_unrolled_pagerank(50))
def pagerank(s, d):
    return graphs.pagerank(deg.hard(fx.edges(s, d)))


def _unrolled_hits(n: int) -> str:
    out = [f"WITH {fx.EDGES}, nd AS (SELECT src AS id FROM hard UNION SELECT dst FROM hard), h0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE AS hub, 1.0::DOUBLE AS auth FROM nd)"]
    for i in range(n):
        out.append(f"""a{i + 1} AS MATERIALIZED (SELECT dst AS id, sum(hub) AS a FROM hard JOIN h{i} ON id = src GROUP BY dst), b{i + 1} AS MATERIALIZED (SELECT src AS id, sum(a) AS h FROM hard JOIN a{i + 1} ON id = dst GROUP BY src),
h{i + 1} AS MATERIALIZED (SELECT nd.id, coalesce(h, 0) / max(h) OVER () AS hub, coalesce(a, 0) / max(a) OVER () AS auth FROM nd LEFT JOIN a{i + 1} ON a{i + 1}.id = nd.id LEFT JOIN b{i + 1} ON b{i + 1}.id = nd.id)""")
    return ",\n".join(out) + f" SELECT id, round(hub, 6) AS hub_score, round(auth, 6) AS authority_score FROM h{n}"


@query(_unrolled_hits(20))
def hits(s, d):
    return graphs.hits(deg.hard(fx.edges(s, d)))


def _unrolled_betweenness(levels: int, sources: int) -> str:
    """Exact where no shortest path is longer than ``levels``: on the generic tables, not on every graph."""
    out = [f"WITH {fx.EDGES}, nd AS (SELECT src AS id FROM hard UNION SELECT dst FROM hard), l0 AS MATERIALIZED (SELECT id AS s, id, 1.0::DOUBLE AS p FROM (SELECT id FROM nd ORDER BY id LIMIT {sources}))"]
    for i in range(1, levels + 1):
        seen = " UNION ALL ".join(f"SELECT s, id FROM l{j}" for j in range(i))
        out.append(f"l{i} AS MATERIALIZED (SELECT s, dst AS id, sum(p) AS p FROM l{i - 1} JOIN hard ON src = id WHERE (s, dst) NOT IN ({seen}) GROUP BY s, dst)")
    out.append(f"d{levels} AS MATERIALIZED (SELECT s, id, p, 0.0::DOUBLE AS c FROM l{levels})")
    for i in range(levels - 1, -1, -1):
        out.append(f"d{i} AS MATERIALIZED (SELECT a.s, a.id, a.p, coalesce(sum(a.p / b.p * (1 + b.c)), 0) AS c FROM l{i} a LEFT JOIN hard ON src = a.id LEFT JOIN d{i + 1} b ON b.s = a.s AND b.id = dst GROUP BY a.s, a.id, a.p)")
    every = " UNION ALL ".join(f"SELECT s, id, c FROM d{i}" for i in range(levels + 1))
    out.append(f"t AS (SELECT nd.id, coalesce(sum(c), 0) AS c FROM nd LEFT JOIN (SELECT * FROM ({every}) WHERE s <> id) x ON x.id = nd.id GROUP BY nd.id)")
    return ",\n".join(out) + ",\nbt AS (SELECT id, CASE WHEN max(c) OVER () > 0 THEN round(c / max(c) OVER (), 6) ELSE 0.0 END AS betweenness FROM t)"


_BETWEEN = _unrolled_betweenness(12, 80)


@query(_BETWEEN + " SELECT * FROM bt")
def betweenness(s, d):
    return graphs.betweenness(deg.hard(fx.edges(s, d)))


@query(
    _BETWEEN
    + """, k AS (SELECT src, count(*) AS k FROM hard WHERE src <> dst GROUP BY src), c3 AS (SELECT x.src, count(*) AS t FROM hard x JOIN hard z ON x.dst = z.src JOIN hard y ON y.src = x.src AND y.dst = z.dst WHERE x.src <> x.dst AND z.src <> z.dst AND y.src <> y.dst GROUP BY x.src)
SELECT id, round(betweenness * (1 - CASE WHEN k >= 2 THEN coalesce(t, 0) / (k * (k - 1)) ELSE 0.0 END), 6) AS bridge_score FROM bt LEFT JOIN k ON k.src = id LEFT JOIN c3 ON c3.src = id"""
)
def bridge(s, d):
    e = deg.hard(fx.edges(s, d))
    return graphs.bridge(e, graphs.betweenness(e))


@query(f"""WITH {fx.EDGES}, c2 AS (SELECT a.src AS x, a.dst AS y FROM hard a JOIN hard b ON a.dst = b.src AND b.dst = a.src WHERE a.src < a.dst),
c3 AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM hard a JOIN hard b ON b.src = a.dst JOIN hard c ON c.src = b.dst AND c.dst = a.src WHERE a.src < a.dst AND a.src < b.dst AND a.dst <> b.dst)
SELECT x || ' -> ' || y || ' -> ' || x AS cycle FROM c2 UNION ALL SELECT x || ' -> ' || y || ' -> ' || z || ' -> ' || x FROM c3""")
def cycles_bounded(s, d):
    return graphs.bounded_cycles(deg.hard(fx.edges(s, d)), 3).select(F.array_join("nodes", " -> ").alias("cycle"))


@query()
def cycles(s, d):
    return graphs.cycle_violations(graphs.cycles(deg.hard(fx.edges(s, d))))


def _unrolled_chains(target: str, nodes: int) -> str:
    out = [f"WITH {fx.EDGES}, p1 AS (SELECT '{target}' AS target, '{target}' AS id, ['{target}'] AS path)"]
    for i in range(2, nodes + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM p{j}" for j in range(1, i))
        out.append(f"p{i} AS MATERIALIZED (SELECT target, src AS id, min(list_concat([src], path)) AS path FROM p{i - 1} JOIN hard ON dst = id WHERE src NOT IN ({seen}) GROUP BY target, src)")
    return ",\n".join(out) + " " + " UNION ALL ".join(f"SELECT target, id, array_to_string(path, '>') AS path FROM p{i}" for i in range(2, nodes + 1))


@query(_unrolled_chains("m1", 5))
def entry_chains(s, d):
    return graphs.chains(deg.hard(fx.edges(s, d)), s.createDataFrame([("m1",)], "id string")).withColumn("path", F.array_join("path", ">"))


# Similarity

_PAIRS = f"""{fx.ITEMS}, sz AS (SELECT owner, count(*) AS n FROM items GROUP BY owner), ov AS (SELECT a.owner AS a, b.owner AS b, count(*) AS k FROM items a JOIN items b ON a.item = b.item AND a.owner < b.owner GROUP BY 1, 2),
jp AS (SELECT a, b, k / (x.n + y.n - k) AS jaccard FROM ov JOIN sz x ON x.owner = a JOIN sz y ON y.owner = b WHERE k / (x.n + y.n - k) >= 0.3)"""


@query(f"WITH {_PAIRS} SELECT a, b, round(jaccard, 9) AS jaccard FROM jp")
def jaccard_pairs(s, d):
    return similarity.jaccard_pairs(fx.owner_items(s, d)).withColumn("jaccard", F.round("jaccard", 9))


@query()
def clusters(s, d):
    return similarity.clusters(fx.owner_items(s, d))


@query(f"""WITH RECURSIVE {fx.USAGE}, p AS (SELECT DISTINCT definer, symbol, consumer FROM usage WHERE consumer <> definer), q AS (SELECT definer, symbol, min(consumer) AS head FROM p GROUP BY ALL HAVING count(*) >= 2),
b AS (SELECT consumer AS x, head AS y FROM p JOIN q USING (definer, symbol) UNION SELECT head, consumer FROM p JOIN q USING (definer, symbol)), r(id, c) AS (SELECT x, x FROM b UNION SELECT y, c FROM r JOIN b ON x = id),
w AS (SELECT id, min(c) AS component FROM r GROUP BY id), z AS (SELECT component, list_sort(list(id)) AS modules FROM w GROUP BY component), n AS (SELECT component, count(*) AS shared_artifacts FROM q JOIN w ON id = head GROUP BY component)
SELECT array_to_string(modules, ',') AS modules, len(modules) AS size, shared_artifacts FROM z JOIN n USING (component) WHERE len(modules) >= 2 ORDER BY shared_artifacts DESC, size DESC, modules LIMIT 30""")
def shared_usage_components(s, d):
    return similarity.shared_usage_components(fx.usage(s, d)).withColumn("modules", F.array_join("modules", ",")).withColumn("size", F.col("size").cast("long"))


# Collisions, activity

_COL = f"""{fx.DEFS}, f AS (SELECT module_id, name, type, array_to_string(list_filter(list_transform(string_split(code, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)) AS c, len(string_split(code, chr(10))) AS lines FROM defs
  WHERE coalesce(name, '') <> '' AND name NOT IN ('main', 'run', 'get', 'add', 'build') AND NOT starts_with(name, '_') AND NOT starts_with(name, 'visit_')),
g AS (SELECT name, type, string_agg(DISTINCT module_id, ',' ORDER BY module_id) AS nodes, count(DISTINCT c) = 1 AS is_identical, min(lines) AS min_lines, max(lines) AS max_lines FROM f GROUP BY name, type HAVING count(DISTINCT module_id) > 1),
sv AS (SELECT *, CASE WHEN type = 'class' THEN CASE WHEN min_lines > 0 AND max_lines / min_lines >= 2.0 THEN 'critical' WHEN max_lines - min_lines > 5 THEN 'warning' ELSE 'info' END ELSE 'warning' END AS severity FROM g)"""


@query(f"WITH {_COL} SELECT name, type, CASE WHEN is_identical THEN 'IDENTICAL_DEFINITION_DUPLICATE' ELSE 'NAME_COLLISION' END AS kind, nodes, is_identical, CAST(min_lines AS INT) AS min_lines, CAST(max_lines AS INT) AS max_lines, severity FROM sv")
def collisions(s, d):
    return col.severity(col.collisions(fx.definitions(s, d))).drop("message").withColumn("nodes", F.array_join("nodes", ","))


@query(f"WITH {_COL} SELECT severity, count(*) AS count FROM sv WHERE NOT is_identical GROUP BY severity")
def collision_severity(s, d):
    return col.by_severity(col.severity(col.collisions(fx.definitions(s, d))))


_EVIDENCE_SQL = """ev AS (SELECT 'doc.' || CASE WHEN d.doc_id % 50 = 0 THEN '__f' || CAST(d.doc_id AS VARCHAR) || '__' ELSE 'f' || CAST(d.doc_id AS VARCHAR) END AS symbol, source AS module_id, quality = 1 AS is_public, toxic = 1 AS called, d.doc_id % 3 = 0 AS events, d.doc_id % 11 = 0 AS imports, d.doc_id % 13 = 0 AS inheritance, d.doc_id % 7 = 0 AS local_calls
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
ac AS (SELECT *, CASE WHEN starts_with(string_split(symbol, '.')[-1], '__') AND ends_with(string_split(symbol, '.')[-1], '__') THEN 'live_framework' WHEN called OR imports OR inheritance OR local_calls THEN 'live' WHEN events THEN 'live_callback' WHEN is_public THEN 'unused_public_api' ELSE 'unused_internal_candidate' END AS status,
  CASE WHEN called::INT + events::INT + imports::INT + inheritance::INT + local_calls::INT >= 2 THEN 'high' WHEN called::INT + events::INT + imports::INT + inheritance::INT + local_calls::INT = 1 THEN 'medium' ELSE 'low' END AS confidence FROM ev),
rk AS (SELECT symbol, module_id, status, confidence, CASE status || '/' || confidence WHEN 'live/high' THEN 0.15 WHEN 'live/medium' THEN 0.30 WHEN 'live/low' THEN 0.45 WHEN 'live_callback/high' THEN 0.25 WHEN 'live_callback/medium' THEN 0.40 WHEN 'live_callback/low' THEN 0.55
  WHEN 'unused_internal_candidate/high' THEN 0.50 WHEN 'unused_internal_candidate/medium' THEN 0.60 WHEN 'unused_internal_candidate/low' THEN 0.70 WHEN 'unused_public_api/high' THEN 0.70 WHEN 'unused_public_api/medium' THEN 0.80 WHEN 'unused_public_api/low' THEN 0.85 ELSE 0.50 END::DOUBLE AS risk FROM ac)"""


def _evidence(s, d):
    both = fx.read(s, d, "documents").select("doc_id", "source").join(fx.read(s, d, "labels"), "doc_id")
    n = F.col("doc_id")
    leaf = F.when(n % 50 == 0, F.concat(F.lit("__f"), n.cast("string"), F.lit("__"))).otherwise(F.concat(F.lit("f"), n.cast("string")))
    return both.select(F.concat(F.lit("doc."), leaf).alias("symbol"), F.col("source").alias("module_id"), (F.col("quality") == 1).alias("is_public"), (F.col("toxic") == 1).alias("called"), (n % 3 == 0).alias("events"), (n % 11 == 0).alias("imports"), (n % 13 == 0).alias("inheritance"), (n % 7 == 0).alias("local_calls"))


@query(f"WITH {_EVIDENCE_SQL} SELECT symbol, module_id, status, confidence, risk FROM rk")
def activity(s, d):
    return con.symbol_risk(con.activity(_evidence(s, d))).select("symbol", "module_id", "status", "confidence", "risk")


@query(f"WITH {_EVIDENCE_SQL} SELECT count(*) AS total_symbols, CAST(count_if(status = 'live') AS BIGINT) AS live, CAST(count_if(status = 'live_callback') AS BIGINT) AS live_callback, CAST(count_if(status = 'unused_public_api') AS BIGINT) AS unused_public_api, CAST(count_if(status = 'unused_internal_candidate') AS BIGINT) AS unused_internal_candidates FROM ac")
def activity_summary(s, d):
    return con.activity_summary(con.activity(_evidence(s, d)))


@query(f"WITH {_EVIDENCE_SQL} SELECT module_id, ((2 * sum(CAST(round(risk * 100) AS BIGINT)) + count(*)) // (2 * count(*))) / 100 AS risk FROM rk GROUP BY module_id")
def module_symbol_risk(s, d):
    return con.module_symbol_risk(con.symbol_risk(con.activity(_evidence(s, d))))


@query(f"WITH {fx.SYMBOLS} SELECT symbol, string_agg(DISTINCT module_id, ',' ORDER BY module_id) AS modules FROM symbols GROUP BY symbol")
def ecosystem(s, d):
    return con.ecosystem(fx.symbols(s, d)).withColumn("modules", F.array_join("modules", ","))


# Differences


def _facts(s, d, new: bool):
    o = fx.read(s, d, "orders").filter("o_orderkey % 10 <> 0" if new else "o_orderkey % 10 <> 1")
    return o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("module_id"), F.col("o_orderpriority").alias("channel"), F.col("o_orderstatus").alias("value"), F.when(F.col("o_orderkey") % 4 == 0, F.lit("x")).alias("extra"))


_FACTS = """fo AS (SELECT DISTINCT 'c' || CAST(o_custkey AS VARCHAR) AS module_id, o_orderpriority AS channel, o_orderstatus AS value, CASE WHEN o_orderkey % 4 = 0 THEN 'x' END AS extra FROM orders WHERE o_orderkey % 10 <> 1),
fn AS (SELECT DISTINCT 'c' || CAST(o_custkey AS VARCHAR) AS module_id, o_orderpriority AS channel, o_orderstatus AS value, CASE WHEN o_orderkey % 4 = 0 THEN 'x' END AS extra FROM orders WHERE o_orderkey % 10 <> 0)"""


@query(f"WITH {_FACTS} SELECT *, 'added' AS op FROM (SELECT * FROM fn EXCEPT SELECT * FROM fo) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM fo EXCEPT SELECT * FROM fn)")
def facts_diff(s, d):
    return diffs.facts_diff(_facts(s, d, False), _facts(s, d, True))


def _two_graphs(s, d):
    e = fx.edges(s, d)
    return e.filter("src <> 'm3'"), e.filter("dst <> 'm5'")


_TWO = f"{fx.EDGES}, eo AS (SELECT * FROM edges WHERE src <> 'm3'), en AS (SELECT * FROM edges WHERE dst <> 'm5')"


@query(f"WITH {_TWO} SELECT *, 'added' AS op FROM (SELECT * FROM en EXCEPT SELECT * FROM eo) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM eo EXCEPT SELECT * FROM en)")
def edge_delta(s, d):
    return diffs.edge_delta(*_two_graphs(s, d))


@query(f"""WITH {_TWO}, n AS (SELECT src AS id FROM eo UNION SELECT dst FROM eo UNION SELECT src FROM en UNION SELECT dst FROM en),
x AS (SELECT id, (SELECT count(*) FROM eo WHERE dst = id AND edge_type = 'hard') AS old_in, (SELECT count(*) FROM eo WHERE src = id AND edge_type = 'hard') AS old_out, (SELECT count(*) FROM en WHERE dst = id AND edge_type = 'hard') AS new_in, (SELECT count(*) FROM en WHERE src = id AND edge_type = 'hard') AS new_out FROM n)
SELECT * FROM x WHERE old_in <> new_in OR old_out <> new_out""")
def changed_degrees(s, d):
    return diffs.changed_degrees(*_two_graphs(s, d))


def _report(s, d, condition: str):
    o = fx.read(s, d, "orders").filter(condition)
    per = o.groupBy(F.col("o_orderpriority").alias("name")).agg(F.count("*").cast("double").alias("value")).select(F.lit("metrics").alias("section"), "name", "value")
    debt = o.agg(F.count_if(F.col("o_orderstatus") == "O").cast("double").alias("hotspot_count"), F.count_if(F.col("o_orderstatus") == "F").cast("double").alias("isolated_count"), F.round(F.sum("o_totalprice") / 1000, 0).alias("total_score"))
    return per.unionByName(debt.select(F.lit("debt").alias("section"), F.expr("stack(3, 'hotspot_count', hotspot_count, 'isolated_count', isolated_count, 'total_score', total_score) as (name, value)")))


def _report_sql(name: str, condition: str) -> str:
    return f"""{name} AS (SELECT 'metrics' AS section, o_orderpriority AS name, count(*)::DOUBLE AS value FROM orders WHERE {condition} GROUP BY o_orderpriority
 UNION ALL SELECT 'debt', 'hotspot_count', count_if(o_orderstatus = 'O')::DOUBLE FROM orders WHERE {condition} UNION ALL SELECT 'debt', 'isolated_count', count_if(o_orderstatus = 'F')::DOUBLE FROM orders WHERE {condition}
 UNION ALL SELECT 'debt', 'total_score', round(sum(o_totalprice) / 1000, 0) FROM orders WHERE {condition})"""


_DIFF = f"""{_report_sql('ro', "o_orderkey % 5 <> 0")}, {_report_sql('rn', "o_orderkey % 6 <> 0 AND o_orderpriority <> '5-LOW'")},
df AS (SELECT section, name, coalesce(ro.value, 0) AS old, coalesce(rn.value, 0) AS new FROM ro FULL OUTER JOIN rn USING (section, name))"""


def _diff(s, d):
    return diffs.report_diff(_report(s, d, "o_orderkey % 5 <> 0"), _report(s, d, "o_orderkey % 6 <> 0 and o_orderpriority <> '5-LOW'"))


@query(f"WITH {_DIFF} SELECT section, name, old, new, round(new - old, 4) AS delta FROM df WHERE old <> new")
def report_diff(s, d):
    return _diff(s, d)


@query(f"""WITH {_DIFF}, x AS (SELECT name, new - old AS delta FROM df WHERE section = 'debt')
SELECT CASE WHEN max(CASE WHEN name <> 'isolated_count' THEN delta END) > 0 THEN 'REGRESSION' WHEN min(delta) < 0 THEN 'IMPROVED' ELSE 'UNCHANGED' END AS verdict FROM x""")
def regression(s, d):
    return diffs.regression(_diff(s, d))


# Query language

def _page_imports(s, d):
    """Links of pages as imports of the page's module, by the order of the links."""
    pages = fx.read(s, d, "pages").select("page_id", "html").join(fx.page_modules(s, d), "page_id")
    each = pages.select("page_id", "module_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("pos", "link"))
    name = F.regexp_replace("link", "[^A-Za-z0-9]+", "")
    return each.select("page_id", F.col("module_id").alias("own"), "pos", F.col("link").alias("link"), name.alias("name"))


_IMPORT_COUNTS = f"""{fx.PAGES}, im AS (SELECT module_id, len(regexp_extract_all(html, 'href="/([^"]*)"')) AS k FROM pages JOIN page_modules USING (page_id)),
mr AS (SELECT module_id AS module_name, module_id, replace(module_id, '.', '/') || '.py' AS path, CAST(coalesce(sum(k), 0) AS INT) AS import_count FROM im GROUP BY module_id)"""


def _page_records(s, d):
    """Pages as modules, with their links as imports."""
    modules = fx.page_modules(s, d).groupBy("module_id").agg(F.concat(F.translate("module_id", ".", "/"), F.lit(".py")).alias("path"))
    link = _page_imports(s, d)
    imports = link.select((F.col("page_id") * 2**32 + F.col("pos")).alias("pos"), F.col("own").alias("module_id"), F.col("name").alias("module"), F.lit(0).alias("level"), F.array().cast("array<string>").alias("names"), F.lit(False).alias("is_from_import"), F.lit(True).alias("is_local"), F.lit(False).alias("type_only"))
    return dsl.module_records(modules, imports)


@query(f"WITH {_IMPORT_COUNTS} SELECT * FROM mr WHERE starts_with(module_id, 'com') AND contains(path, '/en/') AND module_name <> 'com.example.en' AND import_count <= 30 ORDER BY module_id LIMIT 50")
def dsl_modules(s, d):
    """A bounded request: its limit is part of the language."""
    request = {"schema_version": "1.0", "language_version": "1.0", "root": "modules", "select": ["module_name", "module_id", "path", "import_count"], "limit": 50}
    return dsl.run(_page_records(s, d), request | {"filters": [{"field": "module_id", "operator": "starts_with", "value": "com"}, {"field": "path", "operator": "contains", "value": "/en/"}, {"field": "module_name", "operator": "neq", "value": "com.example.en"}, {"field": "import_count", "operator": "lte", "value": 30}]})


@query(f"WITH {_IMPORT_COUNTS} SELECT * FROM mr")
def module_records(s, d):
    return _page_records(s, d).drop("imports")


@query(f"""WITH {fx.USAGE}, {fx.SYMBOLS}, p AS (SELECT module_id AS definer, symbol, list(DISTINCT kind) AS k, max(nullif(signature, '')) AS signature FROM symbols GROUP BY ALL),
u AS (SELECT definer, symbol, list_sort(list(DISTINCT consumer)) AS c FROM usage GROUP BY ALL)
SELECT symbol AS artifact_name, definer || '::' || symbol AS full_name, CASE WHEN len(k) = 1 THEN k[1] ELSE 'ambiguous' END AS kind, signature, CAST(coalesce(len(c), 0) AS BIGINT) AS consumer_count, coalesce(array_to_string(c[:2], ','), '') AS consumers, coalesce(len(c), 0) > 2 AS consumers_truncated
FROM p LEFT JOIN u USING (definer, symbol) WHERE CASE WHEN len(k) = 1 THEN k[1] ELSE 'ambiguous' END IN ('class', 'method') AND signature IS NOT NULL AND starts_with(signature, 'S') AND coalesce(len(c), 0) >= 1 ORDER BY definer, symbol LIMIT 100""")
def dsl_artifacts(s, d):
    request = {"schema_version": "1.1", "language_version": "1.1", "root": "artifacts", "select": ["artifact_name", "full_name", "kind", "signature", "consumer_count", "consumers"], "limit": 100, "evidence_limit": 2}
    filters = [{"field": "kind", "operator": "in", "value": ["class", "method"]}, {"field": "signature", "operator": "starts_with", "value": "S"}, {"field": "consumers", "operator": "count_gte", "value": 1}]
    return dsl.run(dsl.artifact_records(fx.symbols(s, d), fx.usage(s, d)), request | {"filters": filters}).withColumn("consumers", F.array_join("consumers", ","))


@query(f"WITH {fx.EDGES} SELECT src AS source, dst AS target, edge_type FROM edges WHERE edge_type = 'soft' AND starts_with(src, 'm1') AND dst <> 'm9' ORDER BY src, dst, edge_type LIMIT 200")
def dsl_dependencies(s, d):
    request = {"schema_version": "1.0", "language_version": "1.0", "root": "dependencies", "select": [], "limit": 200}
    filters = [{"field": "edge_type", "operator": "eq", "value": "soft"}, {"field": "source", "operator": "starts_with", "value": "m1"}, {"field": "target", "operator": "neq", "value": "m9"}]
    return dsl.run(dsl.dependency_records(fx.edges(s, d)), request | {"filters": filters})


# Search and resolution


@query("WITH x AS (SELECT p_partkey, p_name, lower(p_name) = 'ring' AS exact FROM part WHERE contains(lower(p_name), 'ring')) SELECT p_partkey, p_name, exact FROM x WHERE exact OR NOT (SELECT coalesce(bool_or(exact), FALSE) FROM x)")
def entity_search(s, d):
    return search.entities(fx.read(s, d, "part").select("p_partkey", "p_name"), "p_name", "Ring")


@query("""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS path, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents)
SELECT path, CAST(line_no AS INT) AS line_no, line, CAST(instr(lower(line), 'license') AS INT) AS column, CAST((length(line) - length(replace(lower(line), 'license', ''))) / 7 AS INT) AS hits FROM l WHERE contains(lower(line), 'license')""")
def source_search(s, d):
    return search.search_source(fx.texts(s, d), "License", case_sensitive=False)


@query("""WITH l AS (SELECT CAST(doc_id AS VARCHAR) AS path, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents) SELECT path, CAST(line_no AS INT) AS line_no, line FROM l WHERE line_no BETWEEN 2 AND 4""")
def source_range(s, d):
    return search.line_range(fx.texts(s, d), 2, 4)


_PREFIX = f"""{fx.PAGES}, t AS (SELECT DISTINCT array_to_string(string_split(module_id, '.')[1:3], '.') AS m FROM page_modules WHERE len(string_split(module_id, '.')) >= 3 AND page_id % 2 = 0),
n AS (SELECT DISTINCT module_id FROM page_modules WHERE page_id % 2 = 1)"""


@query(f"""WITH {_PREFIX}, k AS (SELECT n.module_id, max(t.m) AS prefix FROM n LEFT JOIN t ON n.module_id = t.m OR starts_with(n.module_id, t.m || '.') GROUP BY n.module_id)
SELECT module_id, prefix, CASE WHEN prefix IS NOT NULL THEN substr(module_id, length(prefix) + 2) END AS rest FROM k""")
def longest_prefix(s, d):
    m = fx.page_modules(s, d)
    targets = m.filter("page_id % 2 = 0 and size(split(module_id, '[.]')) >= 3").select(F.array_join(F.slice(F.split("module_id", r"\."), 1, 3), ".").alias("m")).distinct()
    return prefixes.longest_prefix(m.filter("page_id % 2 = 1").select("module_id").distinct(), "module_id", targets, "m")


def _imports(s, d):
    m = fx.page_modules(s, d)
    other = m.select((F.col("page_id") - 1).alias("page_id"), F.col("module_id").alias("full"))
    both = m.join(other, "page_id")
    parts = F.split("full", r"\.")
    way = F.col("page_id") % 4
    module = F.when(way == 0, F.col("full")).when(way == 1, F.concat_ws(".", "full", F.lit("thing"))).when(way == 2, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), ".")).otherwise(F.lit("nowhere.at.all"))
    names = F.when(way == 2, F.array(F.element_at(parts, -1), F.lit("zz"))).otherwise(F.array().cast("array<string>"))
    return both.select("module_id", F.col("page_id").cast("int").alias("pos"), module.alias("module"), F.lit(0).alias("level"), names.alias("names"), (way == 2).alias("is_from_import"), F.lit(False).alias("is_local"), F.lit(False).alias("type_only"))


_RESOLVED = f"""{fx.PAGES}, mo AS (SELECT DISTINCT module_id FROM page_modules), bo AS (SELECT a.page_id, a.module_id, b.module_id AS whole, string_split(b.module_id, '.') AS p FROM page_modules a JOIN page_modules b ON b.page_id = a.page_id + 1),
im AS (SELECT page_id AS pos, module_id, CASE page_id % 4 WHEN 0 THEN whole WHEN 1 THEN whole || '.thing' WHEN 2 THEN array_to_string(p[1:greatest(len(p) - 1, 1)], '.') ELSE 'nowhere.at.all' END AS c, CASE WHEN page_id % 4 = 2 THEN [p[-1], 'zz'] ELSE [] END AS names FROM bo),
px AS (SELECT pos, im.module_id, c, names, max(mo.module_id) AS prefix FROM im LEFT JOIN mo ON c = mo.module_id OR starts_with(c, mo.module_id || '.') GROUP BY ALL),
sy AS (SELECT pos, module_id, min(n) AS n FROM (SELECT pos, module_id, c, unnest(names) AS n FROM px WHERE prefix IS NULL) WHERE c || '.' || n IN (SELECT module_id FROM mo) GROUP BY ALL),
rs AS (SELECT px.module_id, CAST(px.pos AS INT) AS pos, coalesce(prefix, c || '.' || n) AS target, CASE WHEN prefix = c THEN 'MODULE' WHEN prefix IS NOT NULL OR n IS NOT NULL THEN 'FALLBACK' ELSE 'UNKNOWN' END AS kind, CASE WHEN prefix IS NULL THEN n END AS used_symbol FROM px LEFT JOIN sy ON sy.pos = px.pos AND sy.module_id = px.module_id)"""


@query(f"WITH {_RESOLVED} SELECT * FROM rs")
def resolve_imports(s, d):
    return resolve.resolve_imports(_imports(s, d), fx.page_modules(s, d).select("module_id"))


@query(f"WITH {_RESOLVED} SELECT DISTINCT module_id AS src, target AS dst, CASE WHEN kind = 'MODULE' THEN 'hard' ELSE 'soft' END AS edge_type FROM rs WHERE target IS NOT NULL AND target <> module_id")
def build_graph(s, d):
    return resolve.build_graph(_imports(s, d), fx.page_modules(s, d).select("module_id"), root="none")


def _catalogue(s, d):
    p = fx.read(s, d, "part")
    status = F.when(F.col("p_partkey") % 9 == 0, "orphan").otherwise("active")
    artifacts = p.select(F.lit("artifact").alias("kind"), F.concat(F.lit("A"), F.col("p_partkey").cast("string"), F.lit("/1")).alias("obj_id"), F.concat(F.lower(F.regexp_replace("p_brand", "#", "")), F.lit("::"), F.regexp_replace("p_name", " ", "_")).alias("name"), status.alias("status"), F.lit(None).cast("string").alias("path"))
    mods = fx.modules(s, d).select(F.lit("module").alias("kind"), F.concat(F.col("doc_id").cast("string"), F.lit("/1")).alias("obj_id"), F.col("module_id").alias("name"), F.lit("active").alias("status"), "path")
    return artifacts.unionByName(mods)


@query("""SELECT 'module' AS kind, CAST(doc_id AS VARCHAR) || '/1' AS obj_id, source || '.' || lang || '.' || CAST(doc_id AS VARCHAR) AS name, 'basename' AS match, 80 AS score, 'active' AS source FROM documents WHERE doc_id = 7""")
def index_resolution(s, d):
    return search.resolve_index("7.py", _catalogue(s, d))


@query(f"""WITH c AS (SELECT 'A' || CAST(p_partkey AS VARCHAR) || '/1' AS obj_id, lower(replace(p_brand, '#', '')) || '::' || replace(p_name, ' ', '_') AS name, CASE WHEN p_partkey % 9 = 0 THEN 'orphan' ELSE 'active' END AS status FROM part),
a AS (SELECT 'A' || CAST(p_partkey AS VARCHAR) || '/1' AS obj_id FROM part UNION ALL SELECT 'A999999999/1')
SELECT a.obj_id, name, CASE WHEN status = 'active' THEN 'active' WHEN status IS NOT NULL THEN 'recovery' ELSE 'missing' END AS status FROM a LEFT JOIN c USING (obj_id)""")
def id_lookup(s, d):
    asked = fx.read(s, d, "part").select(F.concat(F.lit("A"), F.col("p_partkey").cast("string"), F.lit("/1")).alias("obj_id")).unionByName(s.createDataFrame([("A999999999/1",)], "obj_id string"))
    return search.lookup_ids(asked, _catalogue(s, d).filter("kind = 'artifact'"))


@query()
def enclosing_span(s, d):
    hits = fx.read(s, d, "events").select((F.col("user_id") % 5).alias("key"), F.col("event_id").alias("at"))
    spans = fx.read(s, d, "orders").select((F.col("o_orderkey") % 5).alias("key"), F.col("o_orderkey").alias("first"), (F.col("o_orderkey") + F.col("o_custkey") % 300).alias("last"))
    return search.smallest_enclosing(hits, spans).select("key", F.col("at").alias("spot"), F.col("first").alias("lo"), F.col("last").alias("hi"))


# Journal and identity


@query("SELECT max(event_id) AS latest_revision, max(event_id) - 99 AS earliest_retained_revision, 'gap' AS continuity, TRUE AS resync_required, 'event_retention_gap' AS resync_reason FROM events")
def event_continuity(s, d):
    return jr.continuity(fx.journal(s, d), 20)


@query("SELECT event_id AS revision, event_type AS operation, 'm' || CAST(user_id AS VARCHAR) AS module_id FROM events WHERE event_id > (SELECT max(event_id) - 50 FROM events) ORDER BY event_id LIMIT 20")
def event_page(s, d):
    j = fx.journal(s, d)
    last = j.agg(F.max("revision")).first()[0]
    return jr.page(j, last - 50, 20).select("revision", "operation", "module_id")


@query("SELECT 'm' || CAST(user_id AS VARCHAR) AS module_id, max(event_id) AS revision, arg_max(event_type, event_id) AS operation FROM events GROUP BY user_id")
def latest_state(s, d):
    return jr.latest(fx.journal(s, d))


@query("""WITH o AS (SELECT 'm' || CAST(user_id AS VARCHAR) AS module_id, event_id AS revision, CASE WHEN event_type = 'error' OR event_type = 'signup' THEN 'error' ELSE 'ok' END AS status FROM events),
l AS (SELECT module_id, max(revision) AS revision, arg_max(status, revision) AS status, max(CASE WHEN status = 'ok' THEN revision END) AS good FROM o GROUP BY module_id)
SELECT module_id, revision, CASE WHEN status = 'ok' THEN 'fresh' WHEN good IS NOT NULL THEN 'last_known_good' ELSE 'unavailable' END AS state, good AS good_revision FROM l""")
def parse_state(s, d):
    j = fx.journal(s, d).withColumn("status", F.when(F.col("operation").isin("error", "signup"), "error").otherwise("ok"))
    return jr.parse_state(j)


@query("""WITH x AS (SELECT p_partkey AS k, p_brand AS name FROM part), cur AS (SELECT DISTINCT 'n' || CAST(k AS VARCHAR) AS name FROM x WHERE k % 3 <> 0)
SELECT 'n' || CAST(i AS VARCHAR) AS name, CASE WHEN i % 3 = 0 THEN 'orphan' ELSE 'active' END AS status, i AS slot, 1 AS generation FROM range(1, 31) t(i)
UNION ALL SELECT name, 'active', 30 + row_number() OVER (ORDER BY name), 1 FROM cur WHERE CAST(substr(name, 2) AS INT) > 30""")
def registry_sync(s, d):
    known = s.range(1, 31).select(F.lit("module").alias("kind"), F.col("id").cast("int").alias("slot"), F.lit(1).alias("generation"), F.concat(F.lit("n"), F.col("id").cast("string")).alias("name"), F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("removed_at"))
    current = fx.read(s, d, "part").filter("p_partkey % 3 <> 0").select(F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("name"))
    return ids.sync(known, current, "module").select("name", "status", F.col("slot").cast("long"), "generation")


# Beyond the reference: event-time windows over the journal


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS operation, count(*) AS events FROM events GROUP BY 1, 2")
def journal_windows(s, d):
    j = fx.journal(s, d)
    return j.groupBy(F.window("ts", "1 hour").start.alias("window_start"), "operation").agg(F.count("*").alias("events"))

from . import detail_queries, more_queries, project_queries, source_queries, upkeep_queries  # noqa: E402, F401  register their queries
