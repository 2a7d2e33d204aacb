"""Source trees as tables: listing, one parallel parse, and the fact tables read from it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prefixes, resolve
from ..storage import stored

#: Folders that are never source. Fixed values.
IGNORED_PARTS = (".git", ".hg", ".svn", ".venv", "venv", "env", "__pycache__", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", "node_modules", "build", "dist", "site-packages", ".idea", ".vscode")


def keep_path(path: Column, excludes: list[str] | None = None) -> Column:
    """Not below an ignored folder, and neither an excluded path nor below one; ``path`` is relative."""
    out = ~F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(p) for p in IGNORED_PARTS]))
    for e in check_excludes(excludes or []):
        out = out & (path != e) & ~path.startswith(f"{e}/")
    return out


def check_excludes(excludes: list[str], most: int = 500) -> list[str]:
    """Excludes as relative paths with slashes, each once; absolute ones and those that leave the tree are refused."""
    if len(excludes) > most:
        raise ValueError(f"more than {most} excludes")
    out = []
    for e in excludes:
        clean = e.replace("\\", "/").strip("/")
        if e.startswith(("/", "\\")) or ":" in e or ".." in clean.split("/") or not clean:
            raise ValueError(f"not a path inside the tree: {e}")
        out.append(clean.removeprefix("./"))
    return list(dict.fromkeys(out))


def module_id(path: Column) -> Column:
    """The relative path without its suffix, joined by dots; ``__init__`` stays."""
    return F.translate(F.regexp_replace(path, r"\.py$", ""), "/", ".")


def _empty_files(spark: SparkSession, root: str) -> DataFrame:
    """Source files of no bytes, which Spark's readers leave out; listed by the driver, which lists the others too."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    found, rows = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True), []
    while found.hasNext():
        f = found.next()
        if not f.getLen() and f.getPath().getName().endswith(".py"):
            rows.append((f.getPath().toString(), bytearray(), f.getModificationTime(), 0))
    return spark.createDataFrame(rows, "path string, content binary, ms long, length long").select("path", F.timestamp_millis("ms").alias("modificationTime"), "length", "content")


def scan(spark: SparkSession, root: str, excludes: list[str] | None = None) -> DataFrame:
    """``path`` (relative), ``absolute_path``, ``content``, ``mtime``, ``size`` of the source files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.py").load(root)
    return _relative(files.unionByName(_empty_files(spark, root)), root).filter(keep_path(F.col("path"), excludes))


def _relative(files: DataFrame, root: str) -> DataFrame:
    base = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    start = len(root.rstrip("/").split("://")[-1]) + 2
    return files.select(F.substring(base, start, 1 << 20).alias("path"), base.alias("absolute_path"), "content", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def scan_paths(spark: SparkSession, root: str, paths: list[str], excludes: list[str] | None = None) -> DataFrame:
    """What :func:`scan` gives of a few relative paths, without listing or reading the rest of the tree; paths that aren't there give no row."""
    found, rows = [], []
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{path}")
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(at):
            status = fs.getFileStatus(at)
            if status.getLen():
                found.append(status.getPath().toString())
            else:  # Spark's readers leave files of no bytes out
                rows.append((status.getPath().toString(), bytearray(), status.getModificationTime(), 0))
    files = spark.createDataFrame(rows, "path string, content binary, ms long, length long").select("path", F.timestamp_millis("ms").alias("modificationTime"), "length", "content")
    if found:
        files = spark.read.format("binaryFile").load(found).unionByName(files)
    return _relative(files, root).filter(keep_path(F.col("path"), excludes))


def parse(files: DataFrame, families: tuple[str, ...] | None = None) -> DataFrame:
    """``module_id``, ``path``, ``family``, ``value``: all facts of ``files(path, content)``, or those of some families, each file parsed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        from .parse import facts

        gc.disable()  # trees are freed as they are dropped; looking for rings in them costs a third
        try:
            for batch in batches:
                for module, path, content in zip(*(batch.column(i) for i in range(3)), strict=True):
                    rows = list(facts(path.as_py(), content.as_py(), families))
                    yield pa.RecordBatch.from_arrays([pa.repeat(module, len(rows)), pa.repeat(path, len(rows)), pa.array([r["family"] for r in rows], pa.string()), pa.array([r["value"] for r in rows], pa.string())], names=["module_id", "path", "family", "value"])
        finally:
            gc.enable()

    return files.select(module_id(F.col("path")).alias("module_id"), "path", F.col("content").cast("binary").alias("content")).mapInArrow(run, "module_id string, path string, family string, value string")


def write_facts(parsed: DataFrame, path: str) -> None:
    """Facts as Parquet, a folder per family, so that a reader of one family reads no other. Rows are not sorted for it: a task keeps a file open per family."""
    conf, key = parsed.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(key, "0")
    conf.set(key, str(2 * len(_SCHEMAS)))
    try:
        parsed.write.mode("overwrite").option("compression", "zstd").option("parquet.block.size", 16 << 20).partitionBy("family").parquet(path)
    finally:
        conf.set(key, before)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_facts` has stored."""
    found = spark.read.schema("module_id string, path string, value string, family string").parquet(path)
    return found.select("module_id", "path", "family", "value")


_SCHEMAS = {
    "module": "doc string, sections array<string>, sha256 string, size long",
    "skipped": "reason string, line_number int, column_number int",
    "imports": "pos int, module string, level int, names array<string>, is_from_import boolean, is_local boolean, type_only boolean",
    "symbols": "symbol string, kind string, signature string, body_fp string, line int",
    "collisions": "name string, type string, code string, line_start int, line_end int, col_start int, col_end int",
    "api": "name string, kind string, visibility string, bases array<string>, decorators array<string>, parameters array<string>, doc string, line_start int, line_end int",
    "functions": "name string, line int, complexity int, nesting int, raises array<string>, catches array<string>, unused array<string>, returned_keys array<string>",
    "state": "name string, line int, mutated_args array<string>, mutated_globals array<string>, self_mutations array<string>, nonlocals array<string>, captures array<string>, io boolean, is_pure boolean",
    "usage": "channel string, value string, extra string",
    "exports": "name string, listed boolean",
    "import_usage": "name string, runtime int, typing int",
    "exposure": "symbol string, kind string",
}


def family(parsed: DataFrame, name: str) -> DataFrame:
    """``module_id``, ``path`` and the columns of one family of facts."""
    rows = parsed.filter(F.col("family") == name).select("module_id", "path", F.from_json("value", _SCHEMAS[name]).alias("v"))
    return rows.select("module_id", "path", "v.*")


def modules(parsed: DataFrame) -> DataFrame:
    return family(parsed, "module").select("module_id", "path")


def skipped(parsed: DataFrame) -> DataFrame:
    return family(parsed, "skipped").drop("module_id")


def imports(parsed: DataFrame) -> DataFrame:
    """Imports as columns, stored: they are read several times when they are resolved."""
    return stored(family(parsed, "imports").drop("path"))


def edges(parsed: DataFrame, root: str | None = None) -> DataFrame:
    """The dependency graph of a parsed tree."""
    return resolve.build_graph(imports(parsed), modules(parsed), root)


def usage(parsed: DataFrame) -> DataFrame:
    """``definer``, ``symbol``, ``consumer``, ``channel``: every use of a known symbol, by its full name or a name that stands for it.

    Aliases of the using module are replaced first, by the longest; then one join with all symbols decides. Imports of a symbol
    count as the channel ``api_imports``. A name that only one module's symbol has in the tree counts as that symbol's too, with
    the channel ``ambiguous``, where the name is no alias.
    """
    # each is read several times below: stored, the joins before it run once
    found = stored(family(parsed, "usage").drop("path"))
    names = found.filter("channel = 'aliases'").select("module_id", F.col("value").alias("alias"), F.regexp_replace("extra", r"^\.+", "").alias("target"))
    used = found.filter("channel <> 'aliases'").select("module_id", "channel", F.regexp_replace("value", r"^\.+", "").alias("name"))
    resolved = stored(prefixes.resolve_aliases(used, names))
    known = stored(family(parsed, "symbols").select("module_id", "symbol").distinct())
    full = known.select(F.col("module_id").alias("definer"), "symbol", F.concat_ws(".", "module_id", "symbol").alias("full"))
    own = known.select(F.col("module_id").alias("definer"), "symbol", F.col("symbol").alias("full"))
    channel = F.when(F.col("channel") == "imports", "api_imports").otherwise(F.col("channel"))
    direct = resolved.join(full, resolved["resolved"] == full["full"]).select("definer", "symbol", F.col("module_id").alias("consumer"), channel.alias("channel"))
    inner = resolved.join(own, (resolved["module_id"] == own["definer"]) & (resolved["resolved"] == own["full"])).select("definer", "symbol", F.col("module_id").alias("consumer"), channel.alias("channel"))
    last = F.element_at(F.split("symbol", r"\."), -1)
    single = known.select("module_id", "symbol", last.alias("leaf")).filter(~F.col("leaf").startswith("__")).groupBy("leaf").agg(F.count("*").alias("k"), F.min(F.struct("module_id", "symbol")).alias("s")).filter("k = 1")
    open_ = resolved.filter((F.col("resolved") == F.col("name")) & (F.col("channel") == "direct_calls")).join(full.select(F.col("full").alias("resolved")), "resolved", "left_anti")
    guess = open_.withColumn("leaf", F.element_at(F.split("name", r"\."), -1)).join(single, "leaf").filter(F.col("s.module_id") != F.col("module_id"))
    guess = guess.select(F.col("s.module_id").alias("definer"), F.col("s.symbol").alias("symbol"), F.col("module_id").alias("consumer"), F.lit("ambiguous").alias("channel"))
    return direct.unionByName(inner).unionByName(guess).distinct()


def usage_of(parsed: DataFrame, known: DataFrame, definer: str) -> DataFrame:
    """What :func:`usage` gives, but for ``ambiguous``, of the symbols of one module; ``known``: its symbols.

    Only modules that are the definer, or name it or what it lies in, in a use or an alias, can resolve a name to it: of those all
    uses are resolved, of the others none.
    """
    found = family(parsed, "usage").select("module_id", "channel", "value", "extra")
    named = F.regexp_replace(F.when(F.col("channel") == "aliases", F.col("extra")).otherwise(F.col("value")), r"^\.+", "")
    may = (F.col("module_id") == definer) | (named == definer) | named.startswith(f"{definer}.") | F.lit(definer).startswith(F.concat(named, F.lit(".")))
    near = stored(found.join(found.filter(may).select("module_id").distinct(), "module_id", "left_semi"))
    names = near.filter("channel = 'aliases'").select("module_id", F.col("value").alias("alias"), F.regexp_replace("extra", r"^\.+", "").alias("target"))
    used = near.filter("channel <> 'aliases'").select("module_id", "channel", F.regexp_replace("value", r"^\.+", "").alias("name"))
    resolved = stored(prefixes.resolve_aliases(used, names))
    symbols = known.filter(F.col("module_id") == definer).select("symbol").distinct()
    channel = F.when(F.col("channel") == "imports", "api_imports").otherwise(F.col("channel"))
    uses = lambda rows, name: rows.join(symbols.withColumn("resolved", name), "resolved").select(F.lit(definer).alias("definer"), "symbol", F.col("module_id").alias("consumer"), channel.alias("channel"))
    return uses(resolved, F.concat(F.lit(f"{definer}."), "symbol")).unionByName(uses(resolved.filter(F.col("module_id") == definer), F.col("symbol"))).distinct()


def logical_spans(asked: DataFrame) -> DataFrame:
    """``path``, ``line_no``, ``column``, ``first``, ``last``: the span of each place in ``asked(path, text, lines, columns)``; a text is read once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .parse import spans_of

        for frame in frames:
            for path, text, rows, columns in zip(frame["path"], frame["text"], frame["lines"], frame["columns"], strict=True):
                span = spans_of(text)
                yield pd.DataFrame([(path, n, c, *span(n, c)) for n, c in zip(rows, columns, strict=True)], columns=["path", "line_no", "column", "first", "last"])

    return asked.select("path", "text", "lines", "columns").mapInPandas(run, "path string, line_no int, column int, first int, last int")


def exposures(parsed: DataFrame) -> DataFrame:
    """``module_id``, ``symbol``, ``kind``, ``by``: symbols that are exposed, and the module that does it.

    Reflection and serialization in any module expose a symbol of that name, or of that name in a class named like its module;
    decorators expose a symbol of their own module.
    """
    found = family(parsed, "exposure").select(F.col("module_id").alias("by"), F.col("symbol").alias("value"), "kind").distinct()
    known = family(parsed, "symbols").select("module_id", "symbol").distinct()
    short = F.element_at(F.split("module_id", r"\."), -1)
    names = known.withColumn("value", F.explode(F.array_distinct(F.array("symbol", F.when(F.col("symbol").startswith(F.concat(short, F.lit("."))), F.expr("substring(symbol, instr(symbol, '.') + 1)")).otherwise(F.col("symbol"))))))
    out = found.join(names, "value").filter("kind in ('reflection', 'serialization') or by = module_id")
    return out.select("module_id", "symbol", "kind", "by").distinct()


def file_state(files: DataFrame) -> DataFrame:
    """``path``, ``mtime_ns``, ``size``, ``sha256``."""
    return files.select("path", (F.unix_micros("mtime") * 1000).alias("mtime_ns"), "size", F.sha2("content", 256).alias("sha256"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path``, ``change``: create, delete, and edit where the time or size and then the hash differ."""
    side = lambda df, p: df.select("path", F.struct("mtime_ns", "size", "sha256").alias(p))
    both = side(old, "o").join(side(new, "n"), "path", "full_outer")
    suspect = (F.col("o.mtime_ns") != F.col("n.mtime_ns")) | (F.col("o.size") != F.col("n.size"))
    change = F.when(F.col("o").isNull(), "create").when(F.col("n").isNull(), "delete").when(suspect & (F.col("o.sha256") != F.col("n.sha256")), "edit")
    return both.select("path", change.alias("change")).filter("change is not null")


def reparse_changed(old_parsed: DataFrame, changes: DataFrame, files: DataFrame) -> DataFrame:
    """All facts with those of changed files replaced; only created and edited files are parsed."""
    kept = old_parsed.join(changes.select("path"), "path", "left_anti").select("module_id", "path", "family", "value")
    todo = files.join(changes.filter("change <> 'delete'").select("path"), "path", "left_semi")
    return kept.unionByName(parse(todo))


def tests(files: DataFrame) -> DataFrame:
    """Files in ``tests`` or ``test`` folders, or named like tests at the top."""
    return files.filter(F.col("path").rlike(r"(^|/)tests?/") | F.col("path").rlike(r"^(test_[^/]*|[^/]*_test)\.py$"))


def paths_in_text(text: str, files: DataFrame) -> DataFrame:
    """Known paths that a text names, the longest reading of each place: every suffix of words that is a path."""
    import re

    words = re.findall(r"[^\s'\"`,;:()\[\]<>]+", text)[:10_000]
    asked = files.sparkSession.createDataFrame([(w.replace("\\", "/").removeprefix("./"),) for w in words], "asked string").distinct()
    return prefixes.by_suffix(asked, "asked", files, "path").filter("matched is not null").select(F.col("matched").alias("path")).distinct()
