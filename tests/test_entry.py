import importlib.util
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def load():
    spec = importlib.util.spec_from_file_location("driver_entry", ROOT / "__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_every_sql_belongs_to_a_query():
    entry = load()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_base_queries_stand_alone(monkeypatch):
    for name in ("corpus_pipeline", "cliptide.llm", "cliptide.llm.queries"):
        monkeypatch.delitem(sys.modules, name, raising=False)

    class Gone:
        def find_spec(self, name, *_):
            if name == "corpus_pipeline" or name.startswith("cliptide.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Gone(), *sys.meta_path])
    entry = load()
    assert "highlight_selection" in entry.queries() and not any(k.startswith("op") for k in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", [
    "moments_no_speech", "moments_overlapping_speech", "bin_packing", "vertical_names", "path_names", "edit_list", "edit_list_without_failed", "highlight_summary", "duration_probe",
    "loudness_probe", "speech_recognised", "speech_transcripts", "media_formats", "cut_overlap", "request_check", "run_outcomes",
])
def test_agrees_with_sql(spark, name):
    from cliptide.plans import queries  # noqa: F401
    from cliptide.plans.registry import ORACLES, QUERIES

    got = QUERIES[name](spark, str(DATA))
    columns = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{DATA}/events.parquet')")
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(repr, want))
