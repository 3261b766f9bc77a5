"""Neighbours of rows on which codes and lists choose badly, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from playerday.llm import neighbours


def spread(kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 16))
    if kind == "scales":
        x *= np.exp(3 * rng.normal(size=(1500, 1)))
    elif kind == "heavy tails":
        x = rng.standard_t(1, size=x.shape)
    elif kind == "far clusters":
        x += rng.normal(size=(8, 16))[rng.integers(8, size=1500)] * 1e6
    elif kind == "beyond single precision":
        x = 1e4 + 1e-5 * x
        x[7] = 1e300
    elif kind == "outside the sample":
        x[::20] = 6 + 1e-3 * rng.normal(size=x[::20].shape)
    return x


@pytest.mark.parametrize("kind", ["scales", "heavy tails", "far clusters", "beyond single precision", "outside the sample"])
def test_no_neighbour_is_missed(spark, kind):
    x = spread(kind)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(3)
    got = {}
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, most=300, block_rows=256, shortlist=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = {}
    for q in range(0, len(x), 20):
        far = neighbours.distances(x, x[q])
        far[q] = np.inf
        want[q] = np.lexsort((np.arange(len(x)), far))[:10].tolist()
    assert got == want
