"""Every registered query with oracle SQL against DuckDB on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from voxarbor.operators import matching
from voxarbor.plans import registry

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return round(float(v), 5)
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(map(_value, (r[i] for i in order))) for r in rows], key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, str(DATA))
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs(spark, name):
    registry.QUERIES[name](spark, str(DATA)).collect()


def test_fit_probability_with_a_node_at_the_soma(spark, tmp_path):
    """Of a tree as large as the scale runs' one node lies at (50, 50, 50); here part keys are
    chosen so that the path to it is whole."""
    need, i = set(), next(i for i in range(1, 1113122) if (i * 37 % 101, i * 53 % 103, i * 71 % 107) == (50, 50, 50))
    for i in range(i, i + 5):
        while i:
            need.add(i)
            i = 0 if i == 1 else i // 5 if i % 5 == 0 else i - 1
    duckdb.sql(f"COPY (SELECT CAST(unnest({sorted(need)}) - 1 AS BIGINT) AS p_partkey, 3 AS p_size) TO '{tmp_path}/part.parquet'")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    for name in ("fit_probability", "goodness_of_fit"):
        df, rel = registry.QUERIES[name](spark, str(tmp_path)), con.sql(registry.ORACLES[name])
        assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(rel.columns, rel.fetchall())


def test_fit_probability_with_parents_that_are_no_rows(spark, tmp_path):
    """Keys repeated with a gap between the copies, as of a tree of which parts are missing."""
    con = duckdb.connect()
    con.sql(f"COPY (SELECT p_partkey + 1000000 * k AS p_partkey, p_size FROM '{DATA}/part.parquet', range(3) r(k)) TO '{tmp_path}/part.parquet'")
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    for name in ("fit_probability", "goodness_of_fit"):
        df, rel = registry.QUERIES[name](spark, str(tmp_path)), con.sql(registry.ORACLES[name])
        columns = sorted(df.columns)
        assert _rows(columns, [tuple(r) for r in df.select(columns).collect()]) == _rows(columns, rel.select(*columns).fetchall())


def _broadcast_rows(df):
    """Most rows that one step of a plan broadcasts when it runs."""
    df.collect()
    found, todo = [0], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        name = p.nodeName()
        todo += [p.executedPlan()] if name == "AdaptiveSparkPlan" else [p.plan()] if "QueryStage" in name else []
        if name == "BroadcastExchange":
            found.append(p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return max(found)


#: Rows of supplier and of part are each repeated to the cells around; none of it is broadcast.
@pytest.mark.parametrize("name", ["distance_both_ways", "completeness", "cut_subvolumes", "seed_windows"])
def test_broadcasts_no_repeated_side(spark, name):
    assert _broadcast_rows(registry.QUERIES[name](spark, str(DATA))) <= 200


#: They need the nearest or the smallest in reach, or sums over it, so they get by without the pairs of `within`.
@pytest.mark.parametrize("name", ["forced_soma_edges", "nearest_point", "reached_somas", "merge_in_balls", "mutual_nearest", "mean_shift", "mean_shift_radii"])
def test_needs_no_pairs(spark, monkeypatch, name):
    monkeypatch.setattr(matching, "within", None)
    registry.QUERIES[name](spark, str(DATA)).collect()
