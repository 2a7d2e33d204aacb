"""Reports as files: JSON with sorted keys, line by line, latest and dated copies, and text bundles of bounded size."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.search import running_chunks


def write_atomic(spark: SparkSession, path: str, text: str) -> None:
    """A small file written beside its place and moved there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, temporary = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.tmp")
    fs = target.getFileSystem(conf)
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(temporary, target):
        raise OSError(f"can't write {path}")


def save_json(spark: SparkSession, report: Any, path: str, compact: bool = False) -> None:
    write_atomic(spark, path, json.dumps(report, sort_keys=True, ensure_ascii=False, default=str, separators=(",", ":") if compact else None, indent=None if compact else 2))


def write_rows(df: DataFrame, path: str) -> None:
    """One JSON value per line, by all executors."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def save_bundle(spark: SparkSession, reports: dict[str, Any], folder: str, when: datetime | None = None) -> str:
    """Each report under its name and, dated, in the archive; returns the stamp."""
    stamp = (when or datetime.now(UTC)).strftime("%Y%m%d_%H%M%S")
    for name, report in reports.items():
        save_json(spark, report, f"{folder}/{name}.json")
        save_json(spark, report, f"{folder}/history/{name}_{stamp}.json", compact=True)
    return stamp


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def markdown(title: str, facts: dict[str, Any], tables: dict[str, list[dict]]) -> str:
    """A summary for people and language models: facts, then tables."""
    out = [f"# {title}", "", *(f"- {k}: {v}" for k, v in facts.items())]
    for name, rows in tables.items():
        out += ["", f"## {name}", ""]
        if rows:
            columns = list(rows[0])
            out += [" | ".join(columns), " | ".join("-" for _ in columns), *(" | ".join(str(r.get(c, "")) for c in columns) for r in rows)]
        else:
            out.append("none")
    return "\n".join(out) + "\n"


def wanted(path: Column, extensions: tuple[str, ...], blocked_parts: tuple[str, ...] = (), blocked_names: tuple[str, ...] = ()) -> Column:
    """Files with one of the extensions, case aside, not below a blocked folder and without a blocked name."""
    low = F.lower(path)
    parts = F.split(low, "/")
    keep = F.concat(F.lit("."), F.substring_index(low, ".", -1)).isin(*extensions)
    if blocked_parts:
        keep = keep & ~F.arrays_overlap(parts, F.array(*[F.lit(p.lower()) for p in blocked_parts]))
    return keep & ~F.element_at(parts, -1).isin(*[n.lower() for n in blocked_names]) if blocked_names else keep


def estimate(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row: files, bytes and lines of a bundle."""
    return texts.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.size(F.split(text, "\n"))), F.lit(0)).alias("lines"))


def text_parts(texts: DataFrame, kib: int = 512, key: str = "path", text: str = "text") -> DataFrame:
    """``part``, ``content``: marked texts in the order of their keys, cut at line ends into parts of about ``kib`` KiB.

    A running sum over one group orders the lines; bundles are made for reading, not for corpora.
    """
    marked = F.concat_ws("\n", F.concat(F.lit("===== START "), key, F.lit(" =====")), F.coalesce(text, F.lit("")), F.concat(F.lit("===== END "), key, F.lit(" =====")))
    lines = texts.select(F.lit(0).alias("g"), F.col(key).alias("k"), F.posexplode(F.split(marked, "\n")).alias("p", "line"))
    placed = running_chunks(lines, ["k", "p"], F.octet_length("line") + 1, kib * 1024, ["g"])
    return placed.groupBy(F.col("chunk").alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "p", "line"))), lambda x: x["line"]), "\n").alias("content")).orderBy("part")
