import os
import subprocess
import sys
from collections import Counter

import pytest

import __spark_entry__ as entry
from signalmill.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalogue.QUERIES) > 80


def test_imports_without_the_llm_folders(tmp_path):
    """A copy without them still imports and has the other queries."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for name in os.listdir(root):
        if name in ("signalmill", "__spark_entry__.py"):
            subprocess.run(["cp", "-r", os.path.join(root, name), str(tmp_path)], check=True)
    if (tmp_path / "signalmill" / "llm").exists():
        (tmp_path / "signalmill" / "llm").rename(tmp_path / "gone")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'asset_scores' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_a_missing_library_costs_only_what_needs_it(tmp_path):
    """A subpackage that can't be imported leaves the other queries alone."""
    code = "import __spark_entry__ as e\ne.import_module = lambda m: (_ for _ in ()).throw(ImportError(m))\nq = e.queries(); assert 'asset_scores' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.abspath(entry.__file__)), env=env, check=True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["g", "symbol", "score", "decision", "rank"]
    assert rows.count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["reject_reasons", "asset_scores", "topics_merged", "insights", "price_pattern", "metrics_upsert", "topic_coins", "history_audit", "rank_feed_merge", "announcement_feed", "rank_list_feed", "sequential_admission", "asset_thesis"])
def test_query_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("part", "lineitem", "events"):
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    found = db.execute(catalogue.SQL[name])
    names = [c[0] for c in found.description]
    df = catalogue.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    plain = lambda x: float(f"{x:.10g}") if isinstance(x, float) else x
    got, want = (Counter(tuple(plain(x) for x in r) for r in rows) for rows in (df.select(*names).collect(), found.fetchall()))
    assert got == want
