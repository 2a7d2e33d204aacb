"""A project as a set of queries: analyse a tree, keep it current, and ask bounded questions about it.

Every answer is a dictionary of JSON values. Lists are bounded and say how much they leave out.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import collisions as col
from ..operators import consumption as con
from ..operators import degrees as deg
from ..operators import diffs, graphs, layers, reports, search, similarity
from ..operators import hotspots as hot
from ..sources import history, revision, sinks
from ..sources import repository as repo
from ..storage import stored
from ..streaming import executor, journal
from . import dsl

MAX_ITEMS, MAX_BYTES = 20, 15_360


def collection(rows: DataFrame, order: list, limit: int | None = MAX_ITEMS) -> dict[str, Any]:
    """``total``, ``truncated``, ``items`` of an ordered frame; no limit for None or 0, nothing for a negative one."""
    total = rows.count()
    found = rows.orderBy(*order)
    if limit:
        found = found.limit(max(limit, 0))
    items = [r.asDict(True) for r in found.collect()] if limit is None or limit >= 0 else []
    return {"total": total, "truncated": len(items) < total, "items": items}


def _cycle_collection(rings: DataFrame) -> dict[str, Any]:
    """The :func:`collection` of the cycles' texts, from their summary by components."""
    total = rings.agg(F.coalesce(F.sum("rings"), F.lit(0))).first()[0]
    first = rings.select(F.explode("first").alias("cycle")).orderBy("cycle").limit(MAX_ITEMS).collect()
    return {"total": total, "truncated": len(first) < total, "items": [r.asDict() for r in first]}


def select_fields(answer: dict[str, Any], fields: list[str] | None) -> dict[str, Any]:
    """The given fields of an answer; an unknown one is an error that names those there are."""
    if not fields:
        return answer
    unknown = [f for f in fields if f not in answer]
    if unknown:
        return {"status": "error", "error": "unknown_fields", "unknown": unknown, "allowed": sorted(answer)}
    return {f: answer[f] for f in fields}


def guarded(answer: dict[str, Any], most: int = MAX_BYTES) -> dict[str, Any]:
    """The answer, or only its size and keys if it is longer than ``most`` bytes as JSON."""
    import json

    size = len(json.dumps(answer, default=str).encode())
    return answer if size <= most else {"status": "too_large", "bytes": size, "max_bytes": most, "keys": sorted(answer)}


def representation(named: Any, indexed: Any, wish: str = "auto", least: int = 512) -> Any:
    """Names or ids; ``auto`` asks for a choice only where ids would save at least so many bytes."""
    import json

    if wish in ("named", "indexed"):
        return named if wish == "named" else indexed
    a, b = (len(json.dumps(x, default=str).encode()) for x in (named, indexed))
    return {"status": "choose_representation", "named_bytes": a, "indexed_bytes": b} if a - b >= least else named


class Project:
    """Analyses of a source tree, stored as revisions below ``state_folder``.

    The tree is the folder ``root``, or the table ``files(path, content)`` where one is given.
    """

    def __init__(self, spark: SparkSession, root: str, state_folder: str, excludes: list[str] | None = None, layer_rules: list[tuple[str, str]] | None = None, files: DataFrame | None = None) -> None:
        self.spark, self.root, self.excludes, self.rules, self._files = spark, root, excludes, layer_rules or [], files
        self.state = executor.State(spark, state_folder, root)

    # Tables

    def files(self) -> DataFrame:
        return repo.scan(self.spark, self.root, self.excludes) if self._files is None else self._files.filter(repo.keep_path(F.col("path"), self.excludes))

    def facts(self, family: str) -> DataFrame:
        return self.state.facts(family)

    def file_facts(self, path: str) -> DataFrame:
        """All facts of one file: those of the state, or of the file as it is where the state holds some families only."""
        here = F.col("path") == path
        return self.state.read("facts").filter(here) if self.state.published().get("families") is None else stored(repo.parse(self.files().filter(here)))

    def members(self) -> DataFrame:
        name = F.col("module_id")
        return self.facts("module").select("module_id", "path", layers.layer_by_rules(name, self.rules).alias("layer"), name.rlike(r"(^|\.)tests?(\.|$)|(^|\.)test_[^.]*$").alias("is_test"))

    def edges(self) -> DataFrame:
        return self.state.read("edges")

    def usage(self) -> DataFrame:
        return self.state.read("usage").filter("channel <> 'ambiguous'")

    # Analyses

    def analyze_project(self) -> dict[str, Any]:
        self.state.rebuild(self.files())
        return self.summary()

    def update_file(self, path: str, change: str = "edit", limit: int = MAX_ITEMS) -> dict[str, Any]:
        """Take one file's change over; what was defined, changed and removed, and which modules depend on it."""
        before = self.state.published()
        old = self.state.read("facts") if before else None
        files = self.files() if self._files is not None or not before else repo.scan_paths(self.spark, self.root, [path], self.excludes)
        now = self.state.update(files, self.spark.createDataFrame([(path, change)], "path string, change string"))
        if before and now["revision"] == before["revision"]:
            return {"status": "unchanged", "revision": now["revision"]}
        here = F.col("path") == path
        new = self.state.read("facts")
        changes = diffs.symbol_diff(repo.family(old.filter(here), "symbols"), repo.family(new.filter(here), "symbols")) if old else repo.family(new.filter(here), "symbols").select("module_id", "symbol", F.lit("added").alias("change"))
        seeds = self.spark.createDataFrame([(path.removesuffix(".py").replace("/", "."),)], "id string")
        below = graphs.reach(self.edges(), seeds, 6).select("id").distinct()
        return {"status": now["status"], "revision": now["revision"], "changes": collection(changes, ["module_id", "symbol"], limit), "affected": collection(below, ["id"], limit)}

    def summary(self) -> dict[str, Any]:
        """Metrics, cycles, hotspots, collisions, debt, risk, status and freshness of the published revision."""
        edges = self.edges().persist()
        try:
            nodes = self.facts("module").select(F.col("module_id").alias("id"))
            metrics = deg.graph_metrics(edges, nodes).first().asDict()
            rings = stored(graphs.cycles(deg.hard(edges), graphs.MOST_EDGES, "summary"))
            cycles = _cycle_collection(rings)
            found = hot.hotspots(edges).persist()
            clashes = col.severity(self.state.read("collisions"))
            groups = graphs.components(deg.hard(edges)).groupBy("component").agg(F.collect_list("id").alias("modules"))
            debt = hot.debt(rings, edges, found, groups, clashes, metrics["nodes"]).first().asDict()
            active = found.filter("type in ('HUB', 'HOTSPOT', 'OUTBOUND_HOTSPOT')").count()
            state = self.spark.range(1).select(hot.status(F.lit(cycles["total"]), F.lit(debt["collision_count"]), F.lit(active)).alias("s")).first()["s"]
            return {
                "status": state, "revision": self.state.published()["revision"], "freshness": self.state.published()["status"], "metrics": metrics, "debt": debt,
                "cycles": cycles, "hotspots": collection(found, [F.desc("score"), "module"], 5),
                "risk": hot.risk_summary(hot.module_risk(edges)).first().asDict(), "collisions": collection(clashes.filter("not is_identical").select("name", "type", "nodes", "severity"), ["name", "type"]),
                "skipped": collection(repo.skipped(self.state.read("facts")), ["path"]), "imports": deg.import_profile(self.facts("imports")).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("global_imports", "local_imports")]).first().asDict(),
            }
        finally:
            edges.unpersist()

    def analyze_layer(self, prefix: str) -> dict[str, Any]:
        """A layer's modules, edges by direction, degrees, cycles and collisions that lie inside it."""
        inside = layers.in_layer(F.col("module_id"), prefix)
        own = self.facts("module").select("module_id", F.when(inside, "layer").otherwise("other").alias("layer"))
        if own.filter("layer = 'layer'").isEmpty():
            return {"status": "error", "error": "unknown_layer"}
        edges = self.edges()
        per = layers.boundary(edges, own, "layer")
        rings = stored(graphs.cycles(deg.hard(edges), graphs.MOST_EDGES, "summary", prefix))
        return {
            "status": "ok", "modules": own.filter("layer = 'layer'").count(), "edges": {r["direction"]: r["n"] for r in per.groupBy("direction").agg(F.count("*").alias("n")).collect()},
            "boundary": collection(per.filter("direction <> 'internal'"), ["direction", "src", "dst"]), "degrees": collection(layers.layer_degrees(edges, own, "layer"), [F.desc("in_degree"), "id"]),
            "cycles": _cycle_collection(rings), "collisions": collection(layers.layer_collisions(self.state.read("collisions"), prefix).select("name", "type", "nodes"), ["name", "type"]),
        }

    def analyze_single_file(self, path: str) -> dict[str, Any]:
        """All facts of one file, its neighbours and its place in the graph."""
        module = path.removesuffix(".py").replace("/", ".")
        found = self.file_facts(path)
        if found.isEmpty():
            return {"status": "error", "error": "unknown_file"}
        out = {"status": "ok", "module": module}
        for name, order in (("symbols", ["line", "symbol"]), ("imports", ["pos"]), ("functions", ["line"]), ("state", ["line"]), ("exports", ["name"]), ("import_usage", ["name"]), ("api", ["line_start"]), ("exposure", ["symbol", "kind"])):
            out[name] = collection(repo.family(found, name).drop("module_id", "path"), order)
        return out | {"context": self.module_context(module)}

    # Questions

    def query(self, request: dict[str, Any]) -> dict[str, Any]:
        roots = {
            "modules": lambda: dsl.module_records(self.facts("module").select("module_id", "path"), self.facts("imports").drop("path")),
            "artifacts": lambda: dsl.artifact_records(self.facts("symbols"), self.usage()),
            "dependencies": lambda: dsl.dependency_records(self.edges()),
        }
        root = request.get("root") if isinstance(request, dict) else None
        records = roots[root]() if isinstance(root, str) and root in roots else roots["modules"]()
        stale = self.facts("skipped").select("module_id")
        return dsl.answer(records, request, stale)

    def describe(self, schema_version: str = "1.1", language_version: str = "1.1") -> dict[str, Any]:
        return dsl.describe(schema_version, language_version)

    def architecture(self) -> dict[str, Any]:
        return {"layers": collection(self.members().groupBy("layer").agg(F.count("*").alias("modules")), [F.desc("modules"), "layer"], None), **{k: v for k, v in self.summary().items() if k in ("status", "freshness", "debt", "metrics")}}

    def module_context(self, module: str, limit: int = MAX_ITEMS) -> dict[str, Any]:
        edges = self.edges()
        dependents = edges.filter(F.col("dst") == module).select(F.col("src").alias("module_id"), "edge_type")
        uses = edges.filter(F.col("src") == module).select(F.col("dst").alias("module_id"), "edge_type")
        return {"module": module, "dependents": collection(dependents, ["module_id", "edge_type"], limit), "dependencies": collection(uses, ["module_id", "edge_type"], limit), "downstream": collection(graphs.reach(deg.hard(edges), self.spark.createDataFrame([(module,)], "id string"), 6).select("id", "depth"), ["depth", "id"], limit)}

    def artifacts(self, module: str, text: str = "", limit: int = MAX_ITEMS, consumers: bool = True) -> dict[str, Any]:
        """A module's artifacts whose name holds a text; without ``consumers`` no uses are asked, and they are null."""
        records = dsl.artifact_records(self.facts("symbols").filter(F.col("module_id") == module), self.usage() if consumers else None)
        return collection(records.filter(F.lower("artifact_name").contains(text.lower())), ["artifact_name"], limit)

    def usage_of(self, module: str) -> DataFrame:
        """What :meth:`usage` has of one module's symbols; of a state without uses only those of modules that name it are resolved."""
        if "usage" in self.state.published()["tables"]:
            return self.usage().filter(F.col("definer") == module)
        path = self.facts("module").filter(F.col("module_id") == module).select("path").first()
        known = repo.family(self.file_facts(path["path"] if path else ""), "symbols")
        return stored(repo.usage_of(self.state.read("facts"), known, module))

    def blast_radius(self, module: str, symbol: str, max_depth: int = 6, uses: DataFrame | None = None) -> dict[str, Any]:
        return con.blast_radius(self.usage_of(module) if uses is None else uses, deg.hard(self.edges()), self.members(), module, symbol, max_depth).first().asDict()

    def edit_context(self, path: str) -> dict[str, Any]:
        """What to know before a file is edited: context, risk, unused public names, tests that reach it and layer rules it breaks."""
        module = path.removesuffix(".py").replace("/", ".")
        edges, members = self.edges(), self.members()
        risk = hot.module_risk(edges).filter(F.col("module") == module).first()
        reach = graphs.chains(deg.hard(edges), self.spark.createDataFrame([(module,)], "id string"), max_nodes=6).join(members.filter("is_test").select(F.col("module_id").alias("id")), "id", "left_semi")
        return {"context": self.module_context(module), "risk": risk["risk"] if risk else 0.0, "tests": collection(reach.select("id", F.array_join("path", " -> ").alias("path")), ["id"]), "violations": collection(layers.rule_violations(edges, members).filter((F.col("src") == module) | (F.col("dst") == module)), ["src", "dst"])}

    def file_history(self, path: str) -> dict[str, Any]:
        """A file's last commit, its churn of the last 30 days and what the last commit changed in it."""
        commits = history.read(self.spark, self.root)
        if commits is None:
            return {"status": "non_git_repo"}
        rows = reports.file_history(commits.filter(F.col("path") == path), F.current_timestamp()).drop("patch")
        row = rows.first()
        found = row.asDict() if row else dict.fromkeys(rows.columns) | {"path": path, "commits_recent": 0, "churn": 0.0}
        return {"status": "ok", "branch": revision.branch(self.root), **found, "patch": history.last_patch(self.root, path)}

    def layer_isolation(self, layer: str, max_clusters: int = 5, fields: list[str] | None = None) -> dict[str, Any]:
        """Edges over a layer's boundary, violations of the layers' order and clusters of shared use; of the given fields nothing else is computed."""
        members = self.members()

        def violations() -> dict[str, Any]:
            broken = layers.rank_violations(deg.matrix(self.usage(), self.edges()), members).filter((F.col("src_layer") == layer) | (F.col("dst_layer") == layer))
            return collection(broken, ["src", "dst"])

        parts = {
            "boundary": lambda: collection(layers.boundary(self.edges(), members, layer).filter("direction <> 'internal'"), ["direction", "src", "dst"]),
            "violations": violations,
            "clusters": lambda: collection(similarity.shared_usage_components(self.usage()), [F.desc("shared_artifacts"), "modules"], max_clusters),
        }
        return {k: f() for k, f in parts.items()} if not fields else {k: parts[k]() for k in fields}

    def report_diff(self, old: dict[str, Any], new: dict[str, Any]) -> dict[str, Any]:
        """What differs between two summaries, and the verdict."""
        rows = []
        for side, report in (("old", old), ("new", new)):
            rows += [(side, "metrics", k, float(report.get("metrics", {}).get(k) or 0)) for k in diffs.METRICS]
            rows += [(side, "debt", k, float(report.get("debt_summary", {}).get(k) or 0)) for k in diffs.DEBT]
            rows += [(side, f"layer {x['layer']}", k, float(x.get(k) or 0)) for x in report.get("layer_index", []) for k in diffs.LAYER]
        df = self.spark.createDataFrame(rows, "side string, section string, name string, value double")
        found = diffs.report_diff(df.filter("side = 'old'"), df.filter("side = 'new'"))
        return {"verdict": diffs.regression(found).first()["verdict"], "changes": collection(found, ["section", "name"], None)}

    def symbol_source(self, symbol: str, module: str | None = None) -> dict[str, Any]:
        """The code of one definition; a name that several modules define is refused with their names."""
        found = self.facts("symbols").filter((F.col("symbol") == symbol) & (F.lit(True) if module is None else F.col("module_id") == module))
        places = [r["module_id"] for r in found.select("module_id").distinct().orderBy("module_id").limit(MAX_ITEMS).collect()]
        if len(places) != 1:
            return {"status": "ambiguous" if places else "unknown", "modules": places}
        row = self.facts("api").filter((F.col("module_id") == places[0]) & (F.col("name") == symbol)).first() or found.first()
        first = row["line_start"] if "line_start" in row else row["line"]
        last = row["line_end"] if "line_end" in row else row["line"]
        return {"status": "ok", "module": places[0], **self.source_range(row["path"], first, last)}

    def texts(self) -> DataFrame:
        return self.files().select("path", F.decode("content", "UTF-8").alias("text"))

    def source_range(self, path: str, first: int, last: int) -> dict[str, Any]:
        rows = search.line_range(self.texts().filter(F.col("path") == path), first, last).orderBy("line_no").collect()
        return {"path": path, "first": first, "last": first + len(rows) - 1, "text": "\n".join(r["line"] for r in rows)}

    def search_source(self, needle: str, case_sensitive: bool = True, limit: int = MAX_ITEMS) -> dict[str, Any]:
        """Lines with the needle, each with the logical span it lies in; a span is listed once."""
        hits = search.search_source(self.texts(), needle, case_sensitive)
        asked = hits.groupBy("path").agg(F.collect_list("line_no").alias("lines"), F.collect_list("column").alias("columns"))
        placed = hits.join(repo.logical_spans(self.texts().join(asked, "path")), ["path", "line_no", "column"])
        per = placed.groupBy("path", "first", "last").agg(F.array_sort(F.collect_set("line_no")).alias("lines"), F.min_by(search.preview(F.col("line")), "line_no").alias("preview"))
        return collection(per, ["path", "first", "last"], limit)

    def search_artifacts(self, term: str, limit: int = MAX_ITEMS) -> dict[str, Any]:
        return collection(search.entities(self.facts("symbols").select("module_id", "symbol", "kind"), "symbol", term), [F.desc("exact"), F.lower("symbol"), "symbol", "module_id"], limit)

    def live_events(self, events: DataFrame, after: int | None = None, limit: int | None = MAX_ITEMS) -> dict[str, Any]:
        kept = journal.retained(events)
        head = journal.continuity(kept, after).first().asDict()
        rows = kept if after is None else kept.filter(F.col("revision") > after)
        return head | {"events": collection(rows, ["revision"], limit)}

    def save(self, folder: str) -> str:
        report = self.summary()
        text = sinks.markdown("Architecture", {"status": report["status"], **report["metrics"]}, {"Hotspots": report["hotspots"]["items"], "Cycles": report["cycles"]["items"]})
        sinks.write_atomic(self.spark, f"{folder}/summary.md", text)
        return sinks.save_bundle(self.spark, {"summary": report}, folder)
