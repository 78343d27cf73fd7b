"""The streaming form, SQL functions, the entry points and the queries' SQL on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from periodica.functions.sql_functions import register
from periodica.ir import col, evaluate
from periodica.operators import shapes as S
from periodica.operators.lattice import Lattice, UnitCell
from periodica.plans import oracles, queries
from periodica.streaming.points import stream_periodic_sdf

ROOT = Path(__file__).resolve().parents[1]


def test_stream_equals_table(spark, sf_dir, tmp_path):
    pts = queries.points(spark, sf_dir).select("pt", "x", "y")
    pts.write.parquet(str(tmp_path / "in"))
    cell = UnitCell(Lattice.hexagonal(1.2), S.Rectangle((0.1, 0.2), (0.6, 0.35), 30.0))
    stream = stream_periodic_sdf(spark.readStream.schema(pts.schema).parquet(str(tmp_path / "in")), cell)
    q = stream.writeStream.format("memory").queryName("sdf_stream").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    a = {r.pt: r.sdf for r in spark.table("sdf_stream").collect()}
    assert a == {r.pt: r.sdf for r in stream_periodic_sdf(pts, cell).collect()} and len(a) == pts.count()


def test_sql_functions(spark):
    assert "pd_sdf_rectangle" in register(spark)
    row = spark.sql("SELECT pd_sdf_rectangle(2, 0, 0, 0, 2, 2, 0, 0) a, pd_sdf_bar_x(0, 3, 0, 2) b, pd_sdf_cross(0.9, 0.9, 0, 0, 2, 0.5, 10, 0.05, 0.1) c").first()
    want = float(evaluate([S.Cross((0, 0), 2, 0.5, 10, 0.05, 0.1).sdf(col("x"), col("y"))], {"x": 0.9, "y": 0.9})[0])
    assert abs(row.a - 1) < 1e-12 and abs(row.b - 2) < 1e-12 and abs(row.c - want) < 1e-12


def test_distances_stay_in_generated_code(spark, sf_dir):
    plan = queries.queries()["sdf_ellipse"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan and "ReadSchema: struct<event_id:bigint,user_id:bigint,value:double>" in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("events", "part", "supplier", "orders", "embeddings"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    a = queries.queries()[name](spark, sf_dir).toPandas()
    b = con.sql(oracles.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    cols = sorted(a.columns)
    rows = [sorted(map(repr, f[cols].astype(object).where(f[cols].notna(), None).itertuples(index=False, name=None))) for f in (a, b)]
    assert rows[0] == rows[1]


def test_entry_without_the_corpus_subpackage():
    """The rest works where the corpus operators and their pipeline are absent."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name in ('periodica.llm', 'corpus_pipeline'):\n"
        "            raise ModuleNotFoundError(name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'fill_fraction' in e.queries() and not any(n.startswith('op') for n in e.queries())\n"
        "assert 'fill_fraction' in e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
