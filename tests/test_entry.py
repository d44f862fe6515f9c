import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import docketry.plans.curation_queries  # noqa: F401  (registers its queries)
from docketry.plans.queries import QUERIES, SQL

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def values(rows, order):
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    df = QUERIES[name](spark, D)
    result = duck.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    rows = result.fetchall()
    by = sorted(range(len(columns)), key=columns.__getitem__)
    assert values(rows, by) == values([tuple(r) for r in df.collect()], sorted(range(len(df.columns)), key=df.columns.__getitem__))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 5


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_optional_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for p in ("docketry", "__spark_entry__.py"):
        os.symlink(f"{root}/{p}", tmp_path / p) if p.endswith(".py") else subprocess.run(["cp", "-r", f"{root}/{p}", tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "docketry" / "llm", tmp_path / "__spark_entry__.py"], check=True)
    subprocess.run(["cp", f"{root}/__spark_entry__.py", tmp_path], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'vector_topk' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q); print('fine')"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True).stdout.strip() == "fine"
