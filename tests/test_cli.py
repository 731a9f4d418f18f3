"""The command line on files, and the data sets it reads."""

import random

import pytest
from pyspark.sql import functions as F

from quorix import cli
from quorix.sources import datasets, readers


def last(run, metric):
    return [r.value for r in run.history.where(F.col("metric") == metric).orderBy("iteration").collect()][-1]


@pytest.fixture(scope="module")
def libsvm_file(tmp_path_factory):
    rng = random.Random(0)
    lines = []
    for _ in range(300):
        x = [rng.gauss(0, 1) for _ in range(4)]
        lines.append(("+1" if x[0] - x[1] > 0 else "-1") + "".join(f" {j}:{v:.4f}" for j, v in enumerate(x)) + f" {100 + rng.randrange(200)}:1")
    path = tmp_path_factory.mktemp("lr") / "train.txt"
    path.write_text("\n".join(lines) + "\n\n")
    return str(path)


@pytest.mark.parametrize("options", [[], ["-model", "dgm"], ["-model", "hecmem", "-reg", "L1", "-reg_para", "0.01"], ["-model", "avgm", "-opt", "cg", "-th", "30"], ["-model", "hmem", "-ard", "-elastic", "0.01", "-stop_crt", "0.001"]])
def test_lr(spark, libsvm_file, tmp_path, options):
    run = cli.main(["lr", "-train", libsvm_file, "-validate", libsvm_file, "-output", str(tmp_path), "-num_slices", "3", "-outer_iter", "3", "-auc", "0.9999", *options], spark)
    assert last(run, "auc") > 0.95
    weights = spark.read.parquet(f"{tmp_path}/weights")
    if "-th" in options:
        assert weights.count() == 1 + spark.read.parquet(f"{tmp_path}/features").where("feature > 0").count() < 60
    assert spark.read.json(f"{tmp_path}/log").count() == run.history.count()


def test_generated_matrix_and_factorizations(spark, tmp_path):
    cli.main(["genmat", "-output", f"{tmp_path}/mat", "-num_rows", "60", "-num_cols", "40", "-K", "2", "-sparsity_level", "0.5", "-lambda", "10000", "-row_blocks", "2", "-col_blocks", "2", "-mean", "3"], spark)
    made = spark.read.parquet(f"{tmp_path}/mat/train")
    assert {tuple(r) for r in made.select("rb", "cb").distinct().collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}
    readers.write_ratings(made.select("row", "col", "value"), f"{tmp_path}/ratings")
    common = ["-train", f"{tmp_path}/ratings", "-seq", "-mean", "3", "-K", "2", "-gamma_r", "0.05", "-gamma_c", "0.05", "-outer_iter", "4"]
    exact = cli.main(["mf", *common, "-model", "dgm", "-output", f"{tmp_path}/out"], spark)
    base = made.agg(F.stddev("value")).first()[0]
    assert last(exact, "rmse") < 0.8 * base
    assert spark.read.parquet(f"{tmp_path}/out/factors").count() == 100
    blocks = cli.main(["mf", *common, "-row_blocks", "2", "-emBayes"], spark)
    assert last(blocks, "local_rmse") < 0.5 * base
    assert {r.dim: len(r.gamma) for r in blocks.model.mean_gamma().collect()} == {0: 2, 1: 2}
    assert blocks.model.mean_gamma(per_block=True).count() == 4
    for options in (["-VB"], ["-ADMM", "-max_norm", "-lambda", "4"], ["-iso"]):
        assert last(cli.main(["mf1", *common, "-col_blocks", "2", *options], spark), "local_rmse") < base


def test_generated_tensor(spark, tmp_path):
    cli.main(["gentensor", "-output", str(tmp_path), "-size1", "20", "-size2", "12", "-size3", "5", "-K", "2", "-sparsity_level", "0.5"], spark)
    run = cli.main(["tf", "-train", f"{tmp_path}/train", "-test", f"{tmp_path}/test", "-synthetic", "-K", "2", "-VB", "-tf", "-num_blocks1", "2", "-gamma1", "0.1", "-gamma2", "0.1", "-gamma3", "0.1", "-outer_iter", "3"], spark)
    assert last(run, "local_rmse") < 1.0


def test_lda(spark, tmp_path):
    rng = random.Random(1)
    docs = [" ".join(f"{w}:{rng.randrange(1, 5)}" for w in sorted(rng.sample(range(10 * (i % 2), 10 * (i % 2) + 10), 5))) for i in range(60)]
    (tmp_path / "docs.txt").write_text("\n".join(docs) + "\n\n")
    (tmp_path / "vocab.txt").write_text("\n".join(f"w{i}" for i in range(20)) + "\n")
    run = cli.main(["lda", "-train", f"{tmp_path}/docs.txt", "-validate", f"{tmp_path}/docs.txt", "-dict", f"{tmp_path}/vocab.txt", "-num_topics", "2", "-outer_iter", "4", "-output", f"{tmp_path}/out", "-top", "3"], spark)
    assert last(run, "perplexity") < 20
    lines = [r.value for r in spark.read.text(f"{tmp_path}/out/top_words").collect()]
    assert len(lines) == 2 and all(len(line.split()) == 4 and " w" in line for line in lines)
    bounds = [r.value for r in run.history.where("metric = 'bound'").orderBy("iteration").collect()]
    assert bounds[-1] > bounds[0]


def test_options_are_checked():
    with pytest.raises(SystemExit):
        cli.main(["lr"])
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["mf", "-train", "x", "-unknown", "1"])


def test_readers_of_headed_files_and_dictionaries_split_anywhere(spark, tmp_path):
    rng = random.Random(2)
    want = []
    for f in range(2):
        lines = []
        for m in range(40):
            movie = f * 100 + m
            lines.append(f"{movie}:")
            for u in range(rng.randrange(0, 60)):
                lines.append(f"{u},{rng.randrange(1, 6)},2001-02-{u % 28 + 1:02d}")
                want.append((u, movie))
        (tmp_path / f"part{f}.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "words").mkdir()
    (tmp_path / "words" / "v.txt").write_text("\n".join(f"w{i}" if i % 50 else "" for i in range(5000)) + "\n\n\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        from quorix.sources.text import netflix

        lines = readers.read_numbered_lines(spark, f"{tmp_path}/part*.txt")
        assert lines.select("line_no.block").distinct().count() > 5
        got = sorted((r.row, r.col) for r in netflix(lines).collect())
        assert got == sorted(want)
        words = readers.read_dictionary(spark, f"{tmp_path}/words")
        assert {(r.word_id, r.word) for r in words.collect()} == {(i, f"w{i}") for i in range(5000) if i % 50}
        train, test = datasets.netflix_tensor(lines, 4, probe=spark.createDataFrame(want[:5], "row int, col int"))
        assert test.count() == 5 and train.count() == len(want) - 5 and train.select("k").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ctr_test_files(spark, tmp_path):
    (tmp_path / "f.txt").write_text("1\tx\t2\t3\t4\t5\t6\t7\t8\t9\t10\n2\tx\t2\t3\t4\t5\t6\t7\t8\t9\t10\n")
    (tmp_path / "l.txt").write_text("2\t1,3,0.5\n3\t0,1,0\n2 broken\n")
    rows = datasets.read_ctr_test(spark, f"{tmp_path}/f.txt", f"{tmp_path}/l.txt").collect()
    assert [(r.id, r.user, r.clicks, r.impressions) for r in rows] == [(2, 10, 1, 3)]


def test_records_round_trip_and_kept_features(spark, tmp_path):
    rows = spark.createDataFrame([([1, 5, 9, 1],), ([2, 5, -1],), ([-1],)], "features array<int>")
    readers.write_records(rows, f"{tmp_path}/r")
    back = datasets.read_lr(spark, f"{tmp_path}/r", records=True)
    assert sorted((r.label, r.idx, r.val) for r in back.collect()) == [(-1, [], None), (-1, [2, 5], None), (1, [1, 5, 9], None)]
    kept = datasets.lr_dataset(back, threshold=2)
    # a positive row counts threshold // 2 = 1: only feature 5 reaches 2
    assert sorted(r.idx for r in kept.collect()) == [[], [1], [1]]
    sample = datasets.lr_dataset(spark.range(4000).select(F.col("id").alias("row_id"), F.lit(1).alias("label"), F.array(F.lit(0)).alias("idx"), F.array(F.lit(1.0)).alias("val")), fraction=0.25, blocks=4)
    assert 850 < sample.count() < 1150 and sample.select("block").distinct().count() == 4
