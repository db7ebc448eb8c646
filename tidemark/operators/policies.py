"""Lifecycle policies of tables and rollups, run on demand at a given time."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.rollup import Rollup
from tidemark.session import Store
from tidemark.sources.hypertable import Hypertable, _time


@dataclass
class Policy:
    job_id: int
    kind: str
    target: Hypertable | Rollup
    after: timedelta
    until: timedelta = timedelta(0)
    every: timedelta = timedelta(days=1)
    last_run: datetime | None = None


@dataclass
class Policies:
    """compress, tier and drop act on chunks that ended `after` before now; refresh on [now - after, now - until)."""

    jobs: list[Policy] = field(default_factory=list)

    def add(self, kind: str, target: Hypertable | Rollup, after: timedelta, until: timedelta = timedelta(0), every: timedelta = timedelta(days=1), if_not_exists: bool = False) -> int:
        if kind not in ("compress", "tier", "drop", "refresh"):
            raise ValueError(f"no policy of kind {kind}")
        old = next((j for j in self.jobs if j.kind == kind and j.target is target), None)
        if old:
            if if_not_exists:
                return old.job_id
            raise ValueError(f"there is a {kind} policy already; remove it first")
        self.jobs.append(Policy(1000 + len(self.jobs), kind, target, after, until, every))
        return self.jobs[-1].job_id

    def remove(self, job_id: int) -> None:
        self.jobs = [j for j in self.jobs if j.job_id != job_id]

    def run(self, job_id: int, as_of: datetime) -> None:
        job = next(j for j in self.jobs if j.job_id == job_id)
        if job.kind == "refresh":
            job.target.refresh(as_of - job.after, as_of - job.until)
        elif job.kind == "drop":
            job.target.drop_chunks(as_of - job.after)
        else:
            due = [s for s in job.target.chunk_starts() if _time(s) + job.target.spec.chunk <= as_of - job.after]
            (job.target.compress_chunks if job.kind == "compress" else job.target.tier_chunks)(due)
        job.last_run = as_of

    def run_due(self, as_of: datetime) -> list[int]:
        """Run the jobs whose time has come; rollups are refreshed before raw chunks are dropped."""
        due = [j for j in self.jobs if j.last_run is None or as_of - j.last_run >= j.every]
        due.sort(key=lambda j: ("refresh", "compress", "tier", "drop").index(j.kind))
        for j in due:
            self.run(j.job_id, as_of)
        return [j.job_id for j in due]

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the jobs, with when they ran last, as a new version; of two writers one fails."""
        store = Store(spark)
        rows = [{"job_id": j.job_id, "kind": j.kind, "target": j.target.spec.name, "last_run": j.last_run and j.last_run.isoformat()} | {k: getattr(j, k).total_seconds() for k in ("after", "until", "every")} for j in self.jobs]
        store.write_json(f"{path}/{len(store.names(path)) + 1:08d}.json", rows)

    @classmethod
    def load(cls, spark: SparkSession, path: str, targets: list[Hypertable | Rollup]) -> Policies:
        """The jobs that another session saved last; targets are found by their names."""
        store, by = Store(spark), {t.spec.name: t for t in targets}
        jobs = []
        for r in store.read_json(f"{path}/{store.names(path)[-1]}"):
            spans = {k: timedelta(seconds=r[k]) for k in ("after", "until", "every")}
            jobs.append(Policy(r["job_id"], r["kind"], by[r["target"]], last_run=r["last_run"] and datetime.fromisoformat(r["last_run"]), **spans))
        return cls(jobs)

    def catalog(self, spark: SparkSession) -> DataFrame:
        rows = [(j.job_id, j.kind, j.target.spec.name, int(j.after.total_seconds()), int(j.until.total_seconds()), j.last_run) for j in self.jobs]
        return spark.createDataFrame(rows, "job_id int, kind string, target string, after_seconds long, until_seconds long, last_run timestamp_ntz")

    def tiered_chunks(self, table: Hypertable) -> DataFrame:
        return table.chunks().where("is_tiered").select("hypertable_name", "chunk_name", "range_start", "range_end")

    def queued_for_tiering(self, table: Hypertable, as_of: datetime) -> DataFrame:
        """Chunks that the next run of the tier policy moves."""
        job = next((j for j in self.jobs if j.kind == "tier" and j.target is table), None)
        rows = table.chunks().where("not is_tiered").select("hypertable_name", "chunk_name", "range_start", "range_end")
        return rows.limit(0) if job is None else rows.where(rows["range_end"] <= as_of - job.after)
