import numpy as np
import pytest
from pyspark.sql import functions as F

from quorix.operators import counts as N
from quorix.operators import metrics as M
from quorix.operators import partition as P
from quorix.operators import sparse as D
from quorix.sources import readers as R
from quorix.sources import text as T


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_label_rule_and_libsvm(spark):
    got = T.libsvm(lines(spark, "+1 3:0.5 1:2", "-1 4", "0 1:1", "7", " ")).collect()
    assert [r.label for r in got] == [1, -1, -1, 1]
    assert got[0].idx == [0, 4, 2] and got[0].val == [1, 0.5, 2] and got[1].val == [1.0, 1.0]
    assert T.libsvm(lines(spark, "1 3:0.5"), binary=True).first().val is None
    kept = spark.createDataFrame([(4, 1), (0, 0)], "feature int, index int")
    exploded = T.explode_vectors(T.libsvm(lines(spark, "+1 3:0.5 1:2")).withColumn("row_id", F.lit(1)))
    assert sorted((r.feature, r.value) for r in T.keep_features(exploded, kept).collect()) == [(0, 1.0), (1, 0.5)]


def test_other_formats(spark):
    assert T.int_records(spark.createDataFrame([([3, 5, -1],), ([],)], "features array<int>")).collect()[0][:2] == (-1, [3, 5])
    ads = T.ads(lines(spark, "a\t2\tb\tx y", "a\t0\tb\tx", "bad\tline", "a\tz\tb\tx")).collect()
    assert [(r.label, r.tokens) for r in ads] == [(1, ["x", "y"]), (-1, ["x"])]
    docs = T.documents(lines(spark, "3:2 1:1 x:y 4", "", None)).collect()
    assert [(r.words, r.counts) for r in docs] == [([3, 1], [2, 1]), ([], []), ([], [])]
    assert T.with_unit_gamma(T.documents(lines(spark, "1:1")), 3).first().gamma == [1.0] * 3
    numbered = T.documents(lines(spark, "1:1")).withColumn("doc_id", F.lit(5))
    a, b = (T.with_random_gamma(numbered.repartition(n), 3).first().gamma for n in (1, 3))
    assert a == b and all(0.5 < x < 1.5 for x in a)
    assert [tuple(r) for r in T.docword(lines(spark, "3", "4", "5", "1 2 3")).collect()] == [(0, 1, 3)]
    assert [tuple(r) for r in T.token_table(lines(spark, "7\t1|2|3", "bad")).collect()] == [(7, [1, 2, 3])]
    log = T.click_log(lines(spark, "\t".join(map(str, range(12))))).first()
    assert (log.clicks, log.impressions, log.ad, log.user) == (0, 1, 3, 11)
    assert [tuple(r) for r in T.delimited(lines(spark, "1|2|4", "1|2", "x|2|3"), ("row", "col"), "|", 2.0, 2.0).collect()] == [(1, 2, 1.0)]


def test_headers_are_carried(spark):
    text = ["9|2", "1\t50\t3\t00:00", "2\t70\t4\t00:00", "8|20000", "3\t10\t5\t00:00", "7|1", "4\t30\t6\t00:00"]
    df = spark.createDataFrame(list(enumerate(text)), "line_no int, value string")
    assert sorted(tuple(r) for r in T.yahoo_music(df).collect()) == [(7, 4, 30.0, 6), (9, 1, 50.0, 3), (9, 2, 70.0, 4)]
    probe = spark.createDataFrame(list(enumerate(["5:", "1", "2", "6:", "1"])), "line_no int, value string")
    assert sorted(tuple(r) for r in T.netflix_probe(probe).collect()) == [(1, 5), (1, 6), (2, 5)]


def test_readers_and_writers(spark, tmp_path):
    p = tmp_path / "in"
    p.mkdir()
    (p / "a.txt").write_text("1\t2:3 4:5\n")
    assert sorted(tuple(r) for r in R.read_ratings(spark, str(p), "adjacency").collect()) == [(1, 2, 3.0), (1, 4, 5.0)]
    with pytest.raises(ValueError):
        R.read_ratings(spark, str(p), "nothing")
    (p / "a.txt").write_text("5:\n1,3,2000-01-01\n")
    assert [tuple(r) for r in T.netflix(R.read_numbered_lines(spark, str(p))).collect()] == [(1, 5, 3.0, "2000-01-01")]
    (p / "a.txt").write_text("zero\none\n")
    assert [tuple(r) for r in R.read_dictionary(spark, str(p)).collect()] == [(0, "zero"), (1, "one")]
    ratings = spark.createDataFrame([(1, 2, 3.0), (5, 6, 7.0)], "row int, col int, value double")
    R.write_blocks(P.rating_blocks(ratings, 2, 2, by="modulo"), str(tmp_path / "blocks"), 2)
    back = spark.read.parquet(str(tmp_path / "blocks"))
    assert sorted((r.row, r.rb, r.cb) for r in back.collect()) == [(1, 1, 0), (5, 1, 0)]
    R.write_labelled_lines(spark.createDataFrame([(1, [2, 3]), (None, [4])], "label int, idx array<int>"), str(tmp_path / "lines"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["1 2 3"]
    R.write_split(spark.createDataFrame([(i, f"{i}:1") for i in range(100)], "doc int, line string"), str(tmp_path / "split"), 0.5)
    sizes = [spark.read.text(str(tmp_path / "split" / s)).count() for s in ("train", "validate")]
    assert sum(sizes) == 100 and min(sizes) > 20
    R.write_frequencies(spark.createDataFrame([("a", 2), ("b", 2)], "token string, n int"), str(tmp_path / "freq"))
    assert spark.read.csv(str(tmp_path / "freq/histogram"), header=True).first().tokens == "2"


def test_weighted_document_frequency(spark):
    df = spark.createDataFrame([(9, 1), (9, -1), (9, -1), (8, -1)], "feature int, label int")
    assert [tuple(r) for r in N.weighted_document_frequency(df, 4).collect()] == [(9, 4)]


def test_equal_mass_frames():
    assert N.equal_mass_frames([(1, 4), (2, 4), (3, 4)], 10) == [(1, 0), (2, 0), (3, 1)]


def test_expand_impressions(spark):
    df = spark.createDataFrame([(1, 3), (0, 0)], "clicks int, impressions int")
    assert [r.label for r in N.expand_impressions(df).orderBy("nth").collect()] == [1, -1, -1]


def test_blocks_do_not_depend_on_partitioning(spark):
    df = spark.range(1000).withColumn("b", P.hash_block(7, "id"))
    a = sorted(map(tuple, df.collect()))
    assert a == sorted(map(tuple, spark.range(1000).repartition(13).withColumn("b", P.hash_block(7, "id")).collect()))
    rep = P.replicated_blocks(spark.range(500), "id", 5, 2.0)
    assert rep.select("id").distinct().count() == 500 and 2 * 500 < rep.count() < 4 * 500
    assert spark.range(3).select(P.mix32(F.col("id"))).distinct().count() == 3


def test_dense_index(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("a",), ("c",)], "k string").repartition(3)
    assert [tuple(r) for r in P.dense_index(df, "k").orderBy("index").collect()] == [("a", 0), ("b", 1), ("c", 2)]
    assert P.dense_index(df.limit(0), "k").count() == 0


def test_auc(spark):
    rows = [(i, 1 if i % 2 else -1, 3.0 if i % 2 else -3.0) for i in range(10)]
    df = spark.createDataFrame(rows, "row_id int, label int, score double")
    assert M.auc500(df).first().auc == 1.0
    assert M.auc500(df.withColumn("score", F.lit(0.0))).first().auc == 0.5
    assert M.auc500(df.where("label = 1")).first().auc is None


def test_rmse_counts_unseen_ids_as_zero(spark):
    r = spark.createDataFrame([(1, 1, 3.0)], "row int, col int, value double")
    none = spark.createDataFrame([], "id int, f array<double>")
    assert M.squared_error(M.predictions(r, none, none)).first().se == 9.0


def test_sparse_block():
    rng = np.random.default_rng(0)
    rows, cols, vals = rng.integers(0, 9, 40) * 3, rng.integers(0, 7, 40) * 5, rng.random(40)
    b = D.build_block(rows, cols, vals)
    dense, back = np.zeros((30, 40)), np.zeros((30, 40))
    np.add.at(dense, (rows, cols), vals)
    np.add.at(back, (b.row_map[b.rows], b.col_map[b.col_idx]), b.value_r)
    assert np.allclose(dense, back)
    fr, fc = rng.random((len(b.row_map), 3)), rng.random((len(b.col_map), 3))
    want = sum((v - fr[np.searchsorted(b.row_map, r)] @ fc[np.searchsorted(b.col_map, c)]) ** 2 for r, c, v in zip(rows, cols, vals))
    assert np.isclose(D.squared_error(b, fr, fc), want)
    f = D.feature_major([(np.array([5, 2]), np.array([1.0, 2.0])), (np.array([], int), None), (np.array([2]), None)])
    assert f.row_map.tolist() == [2, 5] and f.col_idx.tolist() == [0, 2, 0] and f.value_r.tolist() == [2.0, 1.0, 1.0]


def test_cube_and_gather():
    rng = np.random.default_rng(1)
    i, j, k = (rng.integers(0, 5, 30) for _ in range(3))
    v = rng.random(30)
    c = D.build_cube(i, j, k, v)
    a, b, t = (rng.random((len(m), 2)) for m in c.maps)
    want = sum((v[n] - (a[np.searchsorted(c.maps[0], i[n])] * b[np.searchsorted(c.maps[1], j[n])] * t[np.searchsorted(c.maps[2], k[n])]).sum()) ** 2 for n in range(30))
    assert np.isclose(D.cube_squared_error(c, a, b, t), want)
    assert sorted(np.concatenate(c.inverted[0]).tolist()) == list(range(30))
    got = D.gather_factors(np.array([1, 4, 9]), np.array([4, 7]), np.array([[1.0], [2.0]]), fill=-1.0)
    assert got.ravel().tolist() == [-1.0, 1.0, -1.0]


def test_streaming_rates_match_batch(spark, tmp_path, data_dir):
    from quorix.plans.relational import clicks
    from quorix.streaming.rates import windowed_rates

    batch = clicks(spark, data_dir)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = windowed_rates(stream, "ts", "user_id", F.col("clicks"), F.col("impressions")).writeStream.outputMode("complete").format("memory").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    want = windowed_rates(batch, "ts", "user_id", F.col("clicks"), F.col("impressions"))
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, want.collect()))


def test_even_labels_give_each_block_its_partition(spark):
    for n in (1, 3, 8, 20):
        labels = P.even_labels(spark, n)
        assert len(set(labels)) == n
        df = spark.range(5 * n).select(P.even_block(spark, n, (F.col("id") % n).cast("int")).alias("block")).repartition(n, "block")
        assert sorted(map(len, df.rdd.glom().map(lambda rows: {r.block for r in rows}).collect())) == [1] * n
