import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from verbascope.functions import vectors
from verbascope.plans import catalog


@pytest.mark.parametrize("name", ["mean_pool", "sense_anchor", "embedding_wsd"])
def test_small_negative_means_keep_their_sign(tmp_path, spark, name):
    """Means and similarities that round to zero from below, and vectors of -0.0, give what SQL gives, down to the sign."""
    vecs = [[-1e-8, 1e-8, -0.0, 1.0] if i % 2 else [-3e-8, -1e-8, -0.0, 1e-5] for i in range(10)] + [[1.0, -2e-8, -0.0, 1e-11 * (i - 5)] for i in range(10)]
    rows = {"vec_id": list(range(20)), "embedding": pa.array(vecs, pa.list_(pa.float32())), "label": pa.array([i % 3 for i in range(20)], pa.int32())}
    pq.write_table(pa.table(rows), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    got = sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())
    answer = con.execute(catalog.ORACLES[name])
    columns = [x[0] for x in answer.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    want = sorted(repr([r[i] for i in order]) for r in answer.fetchall())
    assert got == want and "-0.0" in str(want)


def test_rounding_is_that_of_sql(spark):
    """Ties and what lies beside them: multiples of half a millionth."""
    xs = [s * k / 2e6 for k in range(1, 4001) for s in (1, -1)] + [0.0, float("nan"), 1e9 + 0.5]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i long, x double").orderBy("i").select(vectors.rounded(F.col("x"), 6)).collect()]
    con = duckdb.connect()
    want = con.execute("SELECT list_transform(?, lambda x: round(x, 6))", [xs]).fetchall()[0][0]
    assert list(map(repr, got)) == list(map(repr, want))
