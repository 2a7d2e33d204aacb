"""Versioned state: tables of a revision in a folder, published by a pointer, and updates that rewrite only what a plan names."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import collisions as col
from ..operators import resolve
from ..shipping import ship
from ..sources import repository as repo
from ..storage import cut
from . import planner

SCHEMA_VERSION = 1


class StateError(RuntimeError):
    """A state of another tree or of an unknown version, or a revision that isn't the next."""


class State:
    """Tables ``facts``, ``edges``, ``usage``, ``collisions`` of the last published revision below a folder.

    A revision is a folder of Parquet tables, written whole before its number is published; so readers see one revision, an
    update that fails changes nothing, and a lost executor is Spark's to replace. One writer at a time. Tables that an update
    doesn't touch are named by the revision that wrote them. A state may be built of some tables and families only; what it
    doesn't hold is refused, not empty.
    """

    TABLES = ("facts", "edges", "usage", "collisions")
    #: Families of facts that a table is computed from, and those that every state has.
    NEEDS = {"edges": ("imports",), "usage": ("usage", "symbols"), "collisions": ("collisions",)}
    ALWAYS = ("module", "skipped")

    def __init__(self, spark: SparkSession, folder: str, root: str) -> None:
        self.spark, self.folder, self.root = ship(spark), folder.rstrip("/"), root

    def _fs(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def published(self) -> dict | None:
        """Revision, tables' places and status of the newest published revision; refuses another tree's."""
        fs, base = self._fs(f"{self.folder}/published")
        if not fs.exists(base):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(base)]
        numbers = [int(n.split(".")[0]) for n in names if n.endswith(".json") and n.split(".")[0].isdigit()]
        if not numbers:
            return None
        found = json.loads(self.spark.read.text(f"{self.folder}/published/{max(numbers)}.json", wholetext=True).first()["value"])
        if found["schema_version"] != SCHEMA_VERSION or found["root"] != self.root:
            raise StateError("the state is of another tree or version")
        return found

    def read(self, table: str) -> DataFrame:
        found = self.published()
        if found is None:
            raise StateError("nothing is published")
        if table not in found["tables"]:
            raise StateError(f"the state is built without {table}")
        return self._load(table, found["tables"][table])

    def holds(self, family: str) -> bool:
        """Whether the published facts are of all files for this family."""
        found = self.published()
        return found is not None and (found.get("families") is None or family in found["families"])

    def facts(self, family: str) -> DataFrame:
        facts = self.read("facts")
        if not self.holds(family):
            raise StateError(f"the state is built without {family}")
        return repo.family(facts, family)

    def _load(self, table: str, place: str) -> DataFrame:
        return repo.read_facts(self.spark, place) if table == "facts" else self.spark.read.parquet(place)

    def _store_facts(self, facts: DataFrame) -> tuple[dict[str, str], DataFrame]:
        """Facts written as the next revision's, not yet published; their place, and they read back, so that each is computed once and none is kept in memory."""
        now = self.published()
        place = f"{self.folder}/revisions/{(now['revision'] if now else 0) + 1}/facts"
        repo.write_facts(facts, place)
        return {"facts": place}, repo.read_facts(self.spark, place)

    def publish(self, revision: int, tables: dict[str, DataFrame], keep: dict[str, str], status: str = "fresh", families: list[str] | None = None, root: str | None = None) -> dict:
        """Write the given tables, keep the places of the others, then publish; the number must be the next one. 

        ``families``: those that the facts are of, None for all; ``root``: the package root of the edges.
        """
        now = self.published()
        if revision != (now["revision"] if now else 0) + 1:
            raise StateError(f"revision {revision} isn't the next")
        places = dict(keep)
        for name, df in tables.items():
            places[name] = f"{self.folder}/revisions/{revision}/{name}"
            df.write.mode("overwrite").parquet(places[name])
        entry = {"schema_version": SCHEMA_VERSION, "revision": revision, "root": self.root, "tables": places, "status": status, "families": families, "package_root": root}
        fs, target = self._fs(f"{self.folder}/published/{revision}.json")
        _, temporary = self._fs(f"{self.folder}/published/.{revision}.tmp")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if not fs.rename(temporary, target):
            raise StateError(f"revision {revision} is already published")
        return entry

    def rebuild(self, files: DataFrame, tables: tuple[str, ...] | None = None, families: tuple[str, ...] = ()) -> dict:
        """Publish a revision computed from all files (``path``, ``content``).

        With ``tables`` only these of edges, usage and collisions, and only the facts that they are computed from and ``families``.
        """
        now = self.published()
        asked = tuple(self.NEEDS) if tables is None else tables
        held = None if tables is None else sorted({*self.ALWAYS, *families, *(f for t in asked for f in self.NEEDS[t])})
        place, parsed = self._store_facts(repo.parse(files, held and tuple(held)))
        found, root = {}, None
        if "edges" in asked:
            found["edges"], root = self._graph(parsed)
        if "usage" in asked:
            found["usage"] = repo.usage(parsed)
        if "collisions" in asked:
            found["collisions"] = col.collisions(repo.family(parsed, "collisions").drop("path"))
        return self.publish((now["revision"] if now else 0) + 1, found, place, families=held, root=root)

    def update(self, files: DataFrame, changes: DataFrame) -> dict:
        """Publish a revision in which the changed files' facts are replaced, and of the other tables only those a plan names.

        ``changes(path, change)``: create, edit or delete. A file that can't be parsed keeps its last good facts. The result is
        the same as :meth:`rebuild`'s of the tables and families that the state holds.
        """
        now = self.published()
        if now is None:
            return self.rebuild(files)
        held = now.get("families")
        old = self._load("facts", now["tables"]["facts"])
        todo = files.join(changes.filter("change <> 'delete'").select("path"), "path", "left_semi")
        # of the changed files only, and stored: what is compared below reads neither the tree's facts nor the files again
        near, fresh = cut(old.join(changes.select("path"), "path", "left_semi")), cut(repo.parse(todo, held and tuple(held)))
        broken = cut(fresh.filter("family = 'skipped'").select("path").distinct().join(near.filter("family <> 'skipped'").select("path").distinct(), "path", "left_semi"))
        replaced, put = changes.select("path").join(broken, "path", "left_anti"), fresh.join(broken, "path", "left_anti").select(*old.columns)
        after = near.join(replaced, "path", "left_anti").unionByName(put)
        found = cut(planner.deltas(*[{"modules": repo.modules(side), **{n: repo.family(side, n) for n in ("imports", "symbols", "usage", "collisions")}} for side in (near, after)]))
        flags = [c for c in found.columns if c != "module_id"]
        plans = [planner.plan(planner.Delta(r["module_id"], **{f: r[f] for f in flags})) for r in found.collect()]  # one per changed file
        patch = {f for p in plans for f in p.patch}
        status = "last_known_good" if not broken.isEmpty() else "fresh"
        root = now.get("package_root")
        if not patch:
            return self.publish(now["revision"] + 1, {}, now["tables"], status, held, root) if status != now["status"] else now
        place, new = self._store_facts(old.join(replaced, "path", "left_anti").unionByName(put))
        tables = {}
        if "dependency_graph" in patch and "edges" in now["tables"]:
            tables["edges"], root = self._edges(old, new, found, now)
        if "artifact_consumption" in patch and "usage" in now["tables"]:
            tables["usage"] = repo.usage(new)
        if "collisions" in patch and "collisions" in now["tables"]:
            tables["collisions"] = col.collisions(repo.family(new, "collisions").drop("path"))
        keep = {n: p for n, p in now["tables"].items() if n not in tables} | place
        return self.publish(now["revision"] + 1, tables, keep, status, held, root)

    def _graph(self, parsed: DataFrame) -> tuple[DataFrame, str | None]:
        """All edges, and the package root by which they are resolved."""
        imports, known = repo.imports(parsed), repo.modules(parsed)
        root = resolve.package_root(imports, known)
        return resolve.graph_edges(imports, resolve.resolve_imports(imports, known, root)), root

    def _edges(self, old: DataFrame, new: DataFrame, found: DataFrame, now: dict) -> tuple[DataFrame, str | None]:
        """All edges if modules came or went, since others' imports may resolve differently; else the changed modules' out-edges. With the package root."""
        if not found.filter("is_new or is_deleted").isEmpty():
            return self._graph(new)
        imports, known = repo.imports(new), repo.modules(new)
        root = resolve.package_root(imports, known)
        before = now["package_root"] if "package_root" in now else resolve.package_root(repo.family(old, "imports"), repo.modules(old))
        ids = found.filter("imports or aliases").select(F.col("module_id").alias("id"))
        if root != before:
            return resolve.graph_edges(imports, resolve.resolve_imports(imports, known, root)), root
        own = imports.join(ids.select(F.col("id").alias("module_id")), "module_id", "left_semi")
        own = resolve.graph_edges(own, resolve.resolve_imports(own, known, root))
        return resolve.replace_out_edges(self.spark.read.parquet(now["tables"]["edges"]), ids, own), root


def parse_states(events: DataFrame, key: str = "module_id") -> DataFrame:
    """A stream of ``key``, ``revision``, ``status`` kept as state per key: fresh, last_known_good or unavailable, in any order of arrival."""
    from pyspark.sql.streaming.state import GroupState

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ok, good = state.get if state.exists else (-1, False, -1)
        for f in frames:
            for revision, status in zip(f["revision"], f["status"], strict=True):
                if status == "ok":
                    good = max(good, int(revision))
                if revision > last:
                    last, ok = int(revision), status == "ok"
        state.update((last, ok, good))
        name = "fresh" if ok else "last_known_good" if good >= 0 else "unavailable"
        yield pd.DataFrame({key: [keys[0]], "revision": [last], "state": [name], "good_revision": [good if good >= 0 else None]})

    return events.groupBy(key).applyInPandasWithState(step, f"{key} string, revision long, state string, good_revision long", "last long, ok boolean, good long", "update", "NoTimeout")
