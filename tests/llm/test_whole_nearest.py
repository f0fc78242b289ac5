"""Every query gets its k, however small the lists are that it lies in."""

import numpy as np

from seqloom.llm import ann


def table_of(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(3)


def test_isolated_vectors_get_k(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(ann, "LIST_ROWS", 20)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 12))
    x = np.concatenate([centres[rng.integers(0, 6, 600)] + 0.3 * rng.normal(size=(600, 12)), rng.normal(size=(30, 12))])
    got = ann.nearest(table_of(spark, x), F.lit(True)).toPandas().groupby("query_id").vec_id.nunique()
    assert got.reindex(range(len(x)), fill_value=0).min() == 5


def test_few_equal_vectors_find_each_other(spark):
    from pyspark.sql import functions as F

    got = ann.nearest(table_of(spark, np.array([[1.0, 0.0]] * 3)), F.lit(True)).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in got) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
