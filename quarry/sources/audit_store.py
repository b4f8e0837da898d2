"""Audit store (S7-S9): five tables whose states change together.

Rows lie in folders that are never changed once written; a numbered manifest names, for each table and run
date, the folders that hold its rows.  A write puts its rows into new folders and then the next manifest in
place, so a reader sees all tables before it or after it, never between; a write that breaks off leaves
folders that no manifest names.  A delete rewrites only the run dates that hold rows of the deleted sessions.

    <root>/rows/<table>/<write>/run_date=...    rows, sorted by session
    <root>/manifest/<number>                    JSON: {table: {run date: [folder, ...]}}
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables and their columns.
TABLES = {
    "sessions": "id string, user_id string, dataset_path string, problem_statement string, created_at timestamp_ntz",
    "agent_decisions": "id string, session_id string, agent_name string, decision_key string, decision_value string, "
                       "rationale string, timestamp timestamp_ntz",
    "model_runs": "id string, session_id string, mlflow_run_id string, model_type string, hyperparameters string, cv_scores string, "
                  "eval_metrics string, is_selected boolean",
    "risk_flags": "id string, session_id string, level string, code string, description string, feature string, resolved boolean, "
                  "resolution string",
    "human_approvals": "id string, session_id string, gate_name string, approved boolean, reason string, approved_by string, "
                       "approved_at timestamp_ntz",
}


class StaleWrite(RuntimeError):
    """Another write put its manifest in place first."""


class AuditStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- the manifest

    def _path(self, at: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{at}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The number of the newest manifest; 0 before the first write."""
        p, fs = self._path("manifest")
        if not fs.exists(p):
            return 0
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max([int(n) for n in names if n.isdigit()], default=0)

    def manifest(self, version: int | None = None) -> dict[str, dict[str, list[str]]]:
        no = self.version() if version is None else version
        if no == 0:
            return {t: {} for t in TABLES}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.root}/manifest/{no:012d}").collect()))

    def _commit(self, no: int, state: dict) -> None:
        """Put manifest ``no`` in place, or fail if there is one."""
        draft, fs = self._path(f"draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(json.dumps(state, sort_keys=True).encode())
        out.close()
        target, _ = self._path(f"manifest/{no:012d}")
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise StaleWrite(f"manifest {no} of {self.root} is taken")

    def _write(self, table: str, df: DataFrame) -> dict[str, str]:
        """Rows into a new folder: {run date: folder}."""
        folder = f"rows/{table}/{uuid.uuid4().hex}"
        key = "id" if table == "sessions" else "session_id"
        dated = df.select(*[F.col(c.split()[0]) for c in TABLES[table].split(", ")], F.col("run_date").cast("date").alias("run_date"))
        dated.repartition("run_date", key).sortWithinPartitions("run_date", key).write.partitionBy("run_date").parquet(f"{self.root}/{folder}")
        p, fs = self._path(folder)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return {n.split("=", 1)[1]: folder for n in names if n.startswith("run_date=")}

    # ---- S7, S8, S9

    def append(self, tables: dict[str, DataFrame]) -> int:
        """Add rows (with a ``run_date``) to several tables at once; returns the new version."""
        no = self.version()
        state = self.manifest(no)
        for t, df in tables.items():
            for day, folder in self._write(t, df).items():
                state[t].setdefault(day, []).append(folder)
        self._commit(no + 1, state)
        return no + 1

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as the newest manifest (or the given one) has it."""
        return self._read(table, self.manifest(version)[table])

    def _read(self, table: str, days: dict[str, list[str]]) -> DataFrame:
        schema = f"{TABLES[table]}, run_date date"
        paths = [f"{self.root}/{folder}/run_date={day}" for day, folders in sorted(days.items()) for folder in folders]
        if not paths:
            return self.spark.createDataFrame([], schema)
        # the run date comes from the folder's name
        read = self.spark.read.schema(TABLES[table]).parquet(*paths)
        return read.withColumn("run_date", F.regexp_extract(F.col("_metadata.file_path"), "run_date=([0-9-]+)", 1).cast("date"))

    def get_by_id(self, table: str, value: str) -> DataFrame:
        """The row with an id (none, if there is none)."""
        return self.read(table).filter(F.col("id") == F.lit(value))

    def filter_by(self, table: str, **equals) -> DataFrame:
        """Rows that agree with all given values; the filters reach the scan."""
        df = self.read(table)
        for k, v in equals.items():
            df = df.filter(F.col(k) == F.lit(v))
        return df

    def delete(self, doomed: DataFrame) -> int:
        """Remove the sessions whose ``id`` is in ``doomed``, and their rows in all other tables.

        Returns the new version, or the current one if nothing was to remove."""
        no = self.version()
        state, ids = self.manifest(no), doomed.select(F.col("id").alias("_doomed")).distinct()
        changed = False
        for t in TABLES:
            key = "id" if t == "sessions" else "session_id"
            hit = self._read(t, state[t]).join(ids, F.col(key) == F.col("_doomed"), "left_semi")
            days = {str(r[0]) for r in hit.select("run_date").distinct().collect()}  # a row a run date
            if days:
                changed = True
                old = {d: f for d, f in state[t].items() if d in days}
                written = self._write(t, self._read(t, old).join(ids, F.col(key) == F.col("_doomed"), "left_anti"))
                state[t] = {d: f for d, f in state[t].items() if d not in days} | {d: [f] for d, f in written.items()}
        if changed:
            self._commit(no + 1, state)
        return no + changed
