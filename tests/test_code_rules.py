"""Static rules for the library code: nothing that breaks on a cluster."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent / "quarry"
SOURCES = {p: p.read_text() for p in ROOT.rglob("*.py")}


def test_no_local_checkpoint():
    assert not [p for p, s in SOURCES.items() if re.search(r"\.localCheckpoint\(", s)]


def test_no_cross_join():
    pat = re.compile(r"crossJoin|how=\"cross\"|'cross'")
    assert not [p for p, s in SOURCES.items() if pat.search(s)]


def test_no_row_at_a_time_python_udf():
    pat = re.compile(r"@F\.udf|F\.udf\(|@udf\b|\budf\(")
    assert not [p for p, s in SOURCES.items() if pat.search(s)]


def test_machine_local_temp_only_in_local_fallback():
    users = [p.name for p, s in SOURCES.items() if "tempfile" in s]
    assert users == ["session.py"]
    assert 'if not sc.master.startswith("local")' in SOURCES[ROOT / "session.py"]


def test_no_keyless_join():
    # a join given only ``how=`` pairs every row with every row
    pat = re.compile(r"\.join\([^,()]+,\s*how=")
    assert not [p for p, s in SOURCES.items() if pat.search(s)]
