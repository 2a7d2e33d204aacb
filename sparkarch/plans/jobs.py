"""Analyses that run beside the caller: started, asked about and cancelled by number, each in a Spark job group of its own."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime, timedelta
from typing import Any

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from ..sources.sinks import write_atomic
from ..storage import drop_path

RUNNING = ("queued", "running")


class Jobs:
    """Jobs as small JSON files below ``folder``, so that another driver can read them. A job is its driver's: one that was left
    running by a driver that is gone is interrupted. Names of jobs begin with their time, so the last one is the latest.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.owner = spark, folder.rstrip("/"), spark.sparkContext.applicationId
        self._own: dict[str, dict[str, Any]] = {}
        self._threads: dict[str, InheritableThread] = {}

    def _write(self, job: dict[str, Any], **changes: Any) -> dict[str, Any]:
        job |= changes
        self._own[job["job_id"]] = job
        write_atomic(self.spark, f"{self.folder}/{job['job_id']}.json", json.dumps(job, sort_keys=True, default=str))
        return job

    def _read(self, job_id: str) -> dict[str, Any] | None:
        if job_id in self._own:
            return self._own[job_id]
        if job_id not in self.names():
            return None
        return json.loads(self.spark.read.text(f"{self.folder}/{job_id}.json", wholetext=True).first()["value"])

    def names(self) -> list[str]:
        """All jobs, the oldest first; :meth:`prune` keeps them few."""
        base = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = base.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in fs.listStatus(base)] if fs.exists(base) else []
        return sorted(n.removesuffix(".json") for n in found if n.endswith(".json"))

    def start(self, kind: str, work: Callable[[], Any]) -> str:
        """Run ``work`` in the background; its result, a JSON value, becomes the job's."""
        now = datetime.now(UTC)
        job_id = f"{now:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
        job = self._write({"job_id": job_id, "kind": kind, "status": "queued", "owner": self.owner, "created_at": now.isoformat(), "completed_at": None, "error": None, "result": None})

        def run() -> None:
            self.spark.sparkContext.setJobGroup(job_id, kind, interruptOnCancel=True)
            if job["status"] == "queued":
                self._write(job, status="running")
            changes = {"status": "completed"}
            try:
                changes["result"] = work()
            except Exception as e:  # the job's edge: what went wrong is its answer
                changes = {"status": "failed", "error": str(e)}
            if job["status"] != "cancelled":
                self._write(job, **changes, completed_at=datetime.now(UTC).isoformat())

        self._threads[job_id] = InheritableThread(target=run, daemon=True)
        self._threads[job_id].start()
        return job_id

    def wait(self, job_id: str, seconds: float | None = None) -> dict[str, Any]:
        """The job's state once it has ended, or after so many seconds."""
        if job_id in self._threads:
            self._threads[job_id].join(seconds)
        return self.status(job_id)

    def status(self, job_id: str | None = None) -> dict[str, Any]:
        """State of a job, or of the latest; of a running one also its stages that are at work."""
        wanted = job_id or max(self.names(), default=None)
        job = self._read(wanted) if wanted else None
        if job is None:
            return {"status": "not_found", "job_id": job_id}
        if job["status"] in RUNNING and job["owner"] != self.owner:
            return self._write(job, status="interrupted", error="the driver that owned the job is gone", completed_at=datetime.now(UTC).isoformat()).copy()
        if job["status"] not in RUNNING:
            return job.copy()
        tracker = self.spark.sparkContext.statusTracker()
        infos = [tracker.getJobInfo(i) for i in tracker.getJobIdsForGroup(wanted)]
        stages = [tracker.getStageInfo(s) for i in infos if i and i.status == "RUNNING" for s in i.stageIds]
        return job | {"stages": [{"name": s.name, "tasks": s.numTasks, "done": s.numCompletedTasks} for s in stages if s and s.numActiveTasks]}

    def cancel(self, job_id: str) -> dict[str, Any]:
        """Stop a job: what it runs now is interrupted and what it would run later refused. One that has ended stays as it is."""
        job = self._read(job_id)
        if job and job["status"] in RUNNING and job["owner"] == self.owner:
            self._write(job, status="cancelled", completed_at=datetime.now(UTC).isoformat())
            self.spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(job_id)
        return self.status(job_id)

    def prune(self, days: int = 30, keep: int = 100, now: datetime | None = None) -> list[str]:
        """Drop files of jobs that ended over so many days ago, and of all but the last ``keep``; running ones stay."""
        names, oldest = self.names(), f"{(now or datetime.now(UTC)) - timedelta(days=days):%Y%m%dT%H%M%S%f}"
        gone = [n for i, n in enumerate(names) if (n < oldest or i < len(names) - keep) and self.status(n)["status"] not in RUNNING]
        for n in gone:
            drop_path(self.spark, f"{self.folder}/{n}.json")
            self._own.pop(n, None)
        return gone
