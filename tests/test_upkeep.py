"""History from a real repository, jobs, and retention."""

import shutil
import subprocess
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkarch.operators import contracts, reports
from sparkarch.plans.jobs import Jobs
from sparkarch.plans.project import Project
from sparkarch.sources import history


def test_log_records_that_lack_something(spark):
    rows = [("h1\x1f2024-01-02T03:04:05+02:00\x1fA B\n\n1\t2\ta.py\n-\t-\tb c.bin\n",), ("h2\x1fnever\n\n3\t0\ta.py",), ("h3",), ("",), ("h4\x1f2024-01-02T03:04:05Z\x1fC\n\n",)]
    got = {(r["commit"], r["path"]): r for r in history.parse_log(spark.createDataFrame(rows, "value string")).collect()}
    assert set(got) == {("h1", "a.py"), ("h1", "b c.bin"), ("h2", "a.py")}
    assert (got["h1", "a.py"]["added"], got["h1", "a.py"]["removed"], got["h1", "a.py"]["author"]) == (1, 2, "A B")
    assert got["h1", "b c.bin"]["added"] is None and got["h2", "a.py"]["committed_at"] is None and got["h2", "a.py"]["author"] is None
    assert history.parse_log(spark.createDataFrame([], "value string")).count() == 0


@pytest.mark.skipif(not shutil.which("git"), reason="no git")
def test_history_of_a_repository(spark, tmp_path):
    tree = tmp_path / "tree"
    (tree / "sub").mkdir(parents=True)
    git = lambda *a: subprocess.run(["git", "-C", str(tree), "-c", "user.name=N", "-c", "user.email=n@n", *a], check=True, capture_output=True)
    assert history.read(spark, str(tree)) is None
    assert Project(spark, str(tree), str(tmp_path / "s")).file_history("a.py") == {"status": "non_git_repo"}
    git("init", "-q")
    for text in ("x = 1\n", "x = 1\ny = 2\n", "y = 2\n"):
        (tree / "a.py").write_text(text)
        (tree / "sub" / "é b.py").write_text("z\n")
        git("add", ".")
        git("commit", "-q", "-m", "m")
    rows = history.read(spark, str(tree)).collect()
    assert sorted((r["path"], r["added"], r["removed"]) for r in rows) == [("a.py", 0, 1), ("a.py", 1, 0), ("a.py", 1, 0), ("sub/é b.py", 1, 0)]
    assert [r["path"] for r in history.read(spark, str(tree / "sub")).collect()] == ["é b.py"]
    found = Project(spark, str(tree), str(tmp_path / "s")).file_history("a.py")
    assert (found["status"], found["commits_recent"], found["churn"], found["last_author"]) == ("ok", 3, 0.3, "N") and "-x = 1" in found["patch"]
    assert Project(spark, str(tree), str(tmp_path / "s")).file_history("none.py")["commits_recent"] == 0
    assert history.last_patch(str(tree), "a.py", 5) is not None and len(history.last_patch(str(tree), "a.py", 5)) <= 5


def test_jobs(spark, tmp_path):
    jobs = Jobs(spark, str(tmp_path / "jobs"))
    assert jobs.status() == {"status": "not_found", "job_id": None} and jobs.names() == []
    one = jobs.start("count", lambda: spark.range(5).count())
    assert jobs.wait(one)["result"] == 5 and jobs.status()["job_id"] == one
    nap = F.udf(lambda x: time.sleep(60), "string")
    slow = jobs.start("slow", lambda: spark.range(2).select(nap("id")).collect())
    for _ in range(100):
        if jobs.status(slow).get("stages"):
            break
        time.sleep(0.1)
    assert jobs.status(slow)["status"] == "running" and jobs.cancel(slow)["status"] == "cancelled"
    assert jobs.wait(slow, 30)["status"] == "cancelled" and jobs.cancel(one)["status"] == "completed"
    other = Jobs(spark, str(tmp_path / "jobs"))
    assert other.status(slow)["status"] == "cancelled" and other.status(one)["result"] == 5
    assert jobs.prune(days=30) == [] and jobs.prune(days=30, keep=1) == [one]
    assert jobs.prune(days=1, now=datetime.now(UTC) + timedelta(days=2)) == [slow] and jobs.names() == []


def test_expired(spark):
    t = datetime(2024, 1, 31)
    entries = spark.createDataFrame([("a", "x", t), ("b", "x", datetime(2023, 1, 1)), ("c", "y", t), ("d", None, t), ("e", "x", None)], "path string, owner string, used_at timestamp")
    got = contracts.expired(entries, spark.createDataFrame([("x",), ("x",), (None,)], "owner string"), F.lit(t)).collect()
    assert sorted(map(tuple, got)) == [("b", "old"), ("c", "orphan"), ("d", "orphan")]
    assert reports.file_history(history.parse_log(spark.createDataFrame([], "value string")), F.lit(t)).count() == 0
