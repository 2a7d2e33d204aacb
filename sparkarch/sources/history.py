"""History of a tree: the log of its version control as a table of commits and paths.

The log is one process's output. It goes to the shared folder as it comes, a record per commit, and all executors read it there.
"""

from __future__ import annotations

import shutil
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path

#: What begins a commit, and what separates its fields.
RECORD, FIELD = "\x01", "\x1f"


def _git(root: str, *args: str) -> subprocess.Popen | None:
    found = shutil.which("git")
    command = [found, "-c", "core.quotepath=off", "--no-pager", "-C", root, *args]
    return subprocess.Popen(command, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) if found else None


def parse_log(commits: DataFrame) -> DataFrame:
    """``path``, ``commit``, ``committed_at``, ``author``, ``added``, ``removed``, ``patch`` (null) of ``commits(value)``, a record each.

    A record is a line of commit, time and author, then lines of added, removed and path between tabs; other lines count for
    nothing. Binary files have no numbers. A time that can't be read is null, and so is what a record lacks.
    """
    lines = F.split("value", "\n")
    head = F.split(F.get(lines, F.lit(0)), FIELD)
    rows = commits.select(head.alias("h"), F.explode(F.filter(F.slice(lines, 2, F.size(lines)), lambda x: F.size(F.split(x, "\t")) > 2)).alias("l"))
    h, part = (lambda i: F.get("h", F.lit(i))), F.split("l", "\t", 3)
    return rows.select(part[2].alias("path"), h(0).alias("commit"), F.try_to_timestamp(h(1)).alias("committed_at"), h(2).alias("author"), part[0].try_cast("long").alias("added"), part[1].try_cast("long").alias("removed"), F.lit(None).cast("string").alias("patch"))


def read(spark: SparkSession, root: str) -> DataFrame | None:
    """All commits of the tree's files, as :func:`parse_log` gives them; None outside a repository. Renamed files count as new ones."""
    process = _git(root, "log", "--relative", "--no-renames", "--numstat", "--format=%x01%H%x1f%cI%x1f%an", "--", ".")
    if process is None:
        return None
    path = new_path(spark, "history")
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    with process:
        while part := process.stdout.read(1 << 20):
            out.write(bytearray(part))
        out.close()
    if process.returncode:
        return None
    return parse_log(spark.read.text(path, lineSep=RECORD).filter("value <> ''"))


def last_patch(root: str, path: str, chars: int = 2000) -> str | None:
    """What the last commit changed in a file, cut to so many characters; None where it changed nothing."""
    process = _git(root, "diff", "--relative", "HEAD~1", "HEAD", "--", path)
    if process is None:
        return None
    with process:
        text = process.stdout.read(4 * chars).decode("utf-8", "ignore")
        process.stdout.close()
    return text[:chars].strip() or None
