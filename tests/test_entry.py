import math
import os

import pytest

import __spark_entry__ as entry
from flowloom.plans import files, towns
from flowloom.plans import oracles as engine

DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_engine_stands_alone():
    """Nothing outside the corpus subpackage imports it."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, names in os.walk(os.path.join(root, "flowloom")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    text = f.read()
                assert "llm" not in text, name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_flagship(spark):
    df = entry.entry(spark)
    assert [f.name for f in df.schema] == ["link_id", "flow"]
    assert df.count() > 0


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("lineitem", "orders", "customer", "supplier", "nation"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return con


def in_order(rows):
    """Rows with what isn't a float first, in order."""
    parted = [([x for x in r if not isinstance(x, float)], [x for x in r if isinstance(x, float)]) for r in rows]
    return sorted(parted, key=lambda r: (str(r[0]), r[1]))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(engine.ORACLES | files.ORACLES | towns.ORACLES))
def test_query_meets_its_sql(spark, tables, name):
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    sql = tables.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({entry.oracle_sql()[name]})")
    ours, theirs = in_order([r[c] for c in columns] for r in got.collect()), in_order(sql.fetchall())
    assert [x for x, _ in ours] == [x for x, _ in theirs]
    # Values that are rounded may differ by a unit of their last place.
    assert all(math.isclose(x, y, rel_tol=1e-6, abs_tol=1.1e-4) for (_, a), (_, b) in zip(ours, theirs) for x, y in zip(a, b, strict=True))
