"""All tables change together, broken-off writes don't show, every review status occurs."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from quarry.plans import audit_plans
from quarry.sources import audit_store
from quarry.sources.files import scratch_path

from .conftest import SMALL


@pytest.fixture()
def store(spark):
    s = audit_store.AuditStore(spark, scratch_path(spark, "store"))
    s.append(audit_plans.audit_rows(spark, SMALL))
    return s


def counts(s, version=None):
    return {t: s.read(t, version).count() for t in audit_store.TABLES}


def test_a_delete_that_breaks_off_leaves_all_tables(spark, store, monkeypatch):
    before, sid = counts(store), store.read("sessions").first()["id"]
    doomed = spark.createDataFrame([(sid,)], "id string")
    real, calls = store._write, []

    def broken(table, df):
        calls.append(table)
        if len(calls) == 3:
            raise RuntimeError("executor lost")
        return real(table, df)
    with monkeypatch.context() as m:
        m.setattr(store, "_write", broken)
        with pytest.raises(RuntimeError):
            store.delete(doomed)
    assert len(calls) == 3 and counts(store) == before and store.version() == 1
    assert store.delete(doomed) == 2
    after = counts(store)
    assert after["sessions"] == before["sessions"] - 1 and after["model_runs"] < before["model_runs"]
    assert counts(store, 1) == before  # the old version stays readable
    assert all(store.read(t).filter(F.col("id" if t == "sessions" else "session_id") == sid).count() == 0 for t in audit_store.TABLES)
    assert store.delete(doomed) == 2 and store.delete(doomed.filter("id = 'none'")) == 2


def test_two_writers_cannot_both_win(spark, store):
    state = store.manifest()
    store.append({"sessions": audit_plans.audit_rows(spark, SMALL)["sessions"]})
    with pytest.raises(audit_store.StaleWrite):
        store._commit(2, state)
    assert store.version() == 2 and store.read("sessions").count() == 2 * store.read("sessions", 1).count()


def test_lookups_and_empty_tables(spark, store):
    row = store.read("risk_flags").first()
    assert store.get_by_id("risk_flags", row["id"]).collect() == [row]
    assert store.get_by_id("risk_flags", "it's none").count() == 0
    plan = store.filter_by("model_runs", session_id=row["session_id"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(session_id" in plan
    new = audit_store.AuditStore(spark, scratch_path(spark, "store"))
    assert counts(new) == dict.fromkeys(audit_store.TABLES, 0) and new.version() == 0
    assert new.delete(spark.createDataFrame([("x",)], "id string")) == 0


def test_every_status_and_step_occurs(spark):
    rows = E.queries()["session_verdicts"](spark, SMALL).collect()
    assert {r["status"] for r in rows} == {None, "cleared", "rejected", "invalid", "missing"}
    assert {r["next_step"] for r in rows} == {"halt", "human_review", "preprocessing"}
    assert {r["confidence"] for r in rows} == {"safe", "uncertain", "unsafe"}
