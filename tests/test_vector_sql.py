"""Vector queries against their SQL to the last bit: a zero has no sign, in either."""

import duckdb
import pytest

from quillwave.plans import registry


def _both(spark, folder, rows, name):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    return {r[0]: repr(r[1]) for r in registry.QUERIES[name](spark, str(folder)).collect()}, {k: repr(v) for k, v in db.execute(registry.ORACLE_SQL[name]).fetchall()}


NEAR_ZERO = [(i, v, 0) for i, v in enumerate([[1.0, 0.0, -1e-7], [0.0, 1.0, -1e-7], [0.6, 0.8, -1e-7], [0.8, 0.6, -1e-7]])]


@pytest.mark.parametrize("name", ["blend_vectors", "extrapolate_blend", "slerp_blend", "slerp_pair"])
def test_small_negative_values_become_plain_zero(spark, tmp_path, name):
    got, told = _both(spark, tmp_path, NEAR_ZERO, name)
    assert got == told and all(v.endswith(", 0.0]") for v in got.values())


def test_extrapolation_scales_to_the_first_vector_that_is_there(spark, tmp_path):
    rows = [(1, [3.0, 4.0], 0), (2, [1.0, 0.0], 0), (4, [0.0, 0.0], 0), (5, [0.0, 2.0], 0)]
    got, told = _both(spark, tmp_path, rows, "extrapolate_blend")
    assert got == told and got["b1"] == "[0.0, 0.6]"
