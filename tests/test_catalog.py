"""Every query with SQL gives the rows of its SQL; the others give rows."""

import math
import os

import duckdb
import pytest

from proofgrid.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    def one(v):
        v = v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v
        return float(v) if type(v).__name__ == "Decimal" else None if isinstance(v, float) and math.isnan(v) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = plain(df.select(*columns).collect())
    if name not in catalog.oracle_sql():
        assert df.columns
        return
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    out = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == columns
    assert got == plain([tuple(r[names.index(c)] for c in columns) for r in out.fetchall()])


def test_everything_imports_without_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['proofgrid.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and e.oracle_sql() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
