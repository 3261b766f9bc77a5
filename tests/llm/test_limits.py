"""No limits on lengths, ids or terms: many vector lengths, null page ids, repeated ids, blocks of one query."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from playerday.llm import mixing, neighbours, pairing, quality, warc


def test_more_lengths_than_before(spark):
    """18 lengths, each searched among its own; every neighbour as by brute force."""
    rng = np.random.default_rng(4)
    rows = [(width * 100 + i, rng.normal(size=width).tolist()) for width in range(2, 20) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = {}
    for r in neighbours.search(df, F.col("vec_id") % 100 == 0, k=3).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert len(found) == 18
    for query, vector in rows:
        if query % 100 == 0:
            near = sorted((float(np.linalg.norm(np.subtract(v, vector))), i) for i, v in rows if len(v) == len(vector) and i != query)[:3]
            assert [found[query][n + 1][0] for n in range(3)] == [i for _, i in near]
            assert np.allclose([found[query][n + 1][1] for n in range(3)], [d for d, _ in near])


def test_blocks_do_not_change_lists(monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    index = neighbours.Index(x[:40], [x[:16, :4], x[:16, 4:]], [0, 4, 8], 1.0, 5)
    sizes = rng.integers(0, 4, 40)
    whole = index.nearest_lists(x, sizes, 9)
    at, far = neighbours.nearest(x, x[:40])
    monkeypatch.setattr(neighbours, "AT_ONCE", 40)
    assert all((a == b).all() for a, b in zip(whole, index.nearest_lists(x, sizes, 9)))
    assert (neighbours.nearest(x, x[:40])[0] == at).all() and np.allclose(neighbours.nearest(x, x[:40])[1], far, atol=1e-4)


def test_null_page_id_beside_a_known_one(spark, tmp_path):
    """A page without an id is a revisit of the one with an id, in the query and in its SQL."""
    page = "<p>" + "x" * 1200
    rows = [(1, "u", page), (None, "v", page), (None, "w", page + "y"), (None, "w", page + "y"), (4, None, None), (5, "z", "short"), (6, "z", "short")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(str, (tuple(r.asDict().items()) for r in warc.op3_warc(spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(warc.OP3_SQL)
    names = [c[0] for c in want.description]
    assert got == sorted(str(tuple(zip(names, r))) for r in want.fetchall())


def test_rows_of_one_id_are_spread(spark):
    """A third of the rows without an id, a third with one id: different keys, bins of few rows, the same result for every size of bin."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"plain words of text number {i} and more", "a") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    few = mixing.mix(docs, per_bin=10)
    assert sorted(map(str, few.collect())) == sorted(map(str, mixing.mix(docs).collect()))
    target, taken = few.agg(F.first("target"), F.sum("taken")).first()
    assert abs(target - taken) <= 10
    kept = mixing.mixed_documents(docs)
    assert kept.columns == docs.columns and kept.count() == few.agg(F.sum("repeats")).first()[0]


def test_weight_prefers_prose(spark):
    texts = ["the plain words of a usual text that runs on for some time " * 5, "x = {a|b} && $c #1 " * 20, "short", "", None, "0123456789 " * 30, "a" * 5000]
    weights = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.quality_weight(F.col("text"))).collect()]
    assert max(weights) == weights[0] > 0.5 and all(0.05 <= w <= 1 for w in weights) and max(weights[1:]) < 0.4


def test_packed_rows_come_back():
    rng = np.random.default_rng(2)
    for n in (0, 1, 900, 60_000, 700_000):
        found = np.sort(rng.choice(quality.WIDTH, n, replace=False)).astype(np.int32)
        packed = quality.pack(found)
        assert (quality.unpack(packed) == found).all() and len(packed) <= quality.WIDTH // 8 + 1


def test_hot_keys_give_the_same_pairs(spark):
    """Keys of 1,500 rows, most of them of one class, against all pairs; the switch to the main class changes nothing."""
    rng = np.random.default_rng(3)
    rows = [(k, 0 if rng.random() < 0.98 else int(rng.integers(1, 9)), i, int(rng.integers(0, 4))) for k in range(2) for i in range(1500)]
    rows += [(9, i % 3, i, i % 4) for i in range(40)] + [(10, 5, 1, 1)]
    filed = spark.createDataFrame(rows, "key int, class int, id int, x int")
    near, ordered = F.abs(F.col("a.x") - F.col("b.x")) <= 1, F.col("a.id") < F.col("b.id")
    chosen = [F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b"), F.col("a.key").alias("key")]
    found = [sorted(map(tuple, pairing.pairs_between_classes(filed, "class", near, ordered, chosen, hot).distinct().collect())) for hot in (1, 1000, 10**9)]
    assert found[0] == found[1] == found[2]
    by_class = {}
    for k, c, i, x in rows:
        by_class.setdefault(k, []).append((c, i, x))
    want = {(min(i, j), max(i, j), k) for k, some in by_class.items() for c, i, x in some if k > 1 or c for d, j, y in some if c != d and abs(x - y) <= 1}
    assert set(found[0]) == want


def test_centres_of_a_second_level(spark):
    """More lists than the sample can give centres: each centre's residuals are divided alike."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6, 12))[rng.integers(0, 6, 600)] * 4 + rng.normal(size=(600, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    index = neighbours.fit(df, 600, float(np.abs(x).max()), most=80)
    assert len(index.centres) > 80 // 40
    hits = 0
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, k=5, most=80).collect():
        far = np.linalg.norm(x - x[r.query_id], axis=1)
        far[r.query_id] = np.inf
        hits += r.vec_id in set(np.argsort(far, kind="stable")[:5])
    assert hits >= 0.9 * 30 * 5
