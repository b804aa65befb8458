"""The registry: every SQL has its query, queries agree with SQL, and the optional subpackage can be missing."""

import math
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_keys():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert all(callable(f) for f in queries.values())


def test_without_the_text_operators(tmp_path):
    shutil.copytree(f"{ROOT}/spanframe", tmp_path / "spanframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'interval_any' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q), list(q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def plain(rows):
    out = []
    for row in rows:
        cells = [None if isinstance(x, float) and math.isnan(x) else round(float(x), 5) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in row]
        out.append(tuple(map(str, cells)))
    return sorted(out)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["interval_any", "interval_within", "interval_anti", "similarity", "merge_pad", "gap_invert", "nearest_order", "coverage_hist", "region_values", "track_smooth", "bed_shear", "n50_documents", "bh_adjusted", "enrichment", "user_sessions", "bedpe_both"])
def test_agrees_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    found = entry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    got = [tuple(r[c] for c in columns) for r in found.collect()]
    cursor = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({entry.oracle_sql()[name]})")
    assert plain(got) == plain(cursor.fetchall())
