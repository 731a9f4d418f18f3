"""Command line: `python -m quorix.cli FAMILY -train PATH -output PATH ...`.

Families: lr, mf, mf1 (the older options of mf), tf, lda, genmat, gentensor. Every run reads its data,
trains, writes the model and the log of its metrics below `-output`, and prints the last metrics.
"""

from __future__ import annotations

import argparse
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorix import synth
from quorix.models.lda import fit_lda
from quorix.models.lr import fit_lr
from quorix.models.mf import fit_mf
from quorix.models.tf import fit_tf
from quorix.operators.counts import rating_summary, top_words
from quorix.schema import Bound, LdaParams, LdaStrategy, LrParams, LrStrategy, MfOptimizer, MfParams, MfStrategy, Optimizer, Regularizer, TfParams
from quorix.sources import datasets, readers, text

# Option names are fixed values: those that users of the engine type today.
#: (name, type, default); a bool is a switch without a value.
_PLACE = (("mode", str, None), ("output", str, None), ("num_cores", int, 0), ("num_reducers", int, 0), ("memory", str, None))
_INPUT = (("train", str, None), ("num_slices", int, 0))
_RATINGS = (("test", str, None), ("mean", float, 0.0), ("scale", float, 1.0), ("format", str, "delimited"), ("sep", str, ","), ("seq", bool, False))
_LOOP = (("outer_iter", int, 10), ("inner_iter", int, 5), ("seed", int, 0))
_MATRIX = (("row_blocks", int, 1), ("col_blocks", int, 1), ("K", int, 20), ("gamma_r", float, 10.0), ("gamma_c", float, 10.0), ("num_rows", int, 0), ("num_cols", int, 0), ("interval", int, 1))
#: Accepted and without effect: Spark's own configuration covers them.
_IGNORED = (("jar", str, None), ("tmp_dir", str, None), ("multicore", bool, False), ("buffer", int, 0))

OPTIONS: dict[str, tuple] = {
    "lr": (
        *_PLACE, *_INPUT, *_LOOP, *_IGNORED, ("validate", str, None), ("reg_para", float, 1.0), ("gamma", float, 1.0), ("rho", float, 1.0), ("th", int, 0), ("binary", bool, False), ("seq", bool, False),
        ("auc", float, 1.0), ("ss_rate", float, 0.1), ("sample", float, 1.0), ("model", str, "admm"), ("opt", str, None), ("reg", str, "L2"), ("var", str, "taylor"),
        ("ard", bool, False), ("elastic", float, 0.0), ("t_shape", float, 0.0), ("t_scale", float, 1.0), ("clip", float, 0.0), ("stop_crt", float, 0.0), ("dual", bool, False),
    ),
    "mf": (
        *_PLACE, *_INPUT, *_RATINGS, *_LOOP, *_MATRIX, *_IGNORED, ("reg_para", float, 0.0), ("opt", str, None), ("reg", str, "L2"), ("model", str, "hecmem"),
        ("stop_crt", float, 0.0), ("more_para", bool, False), ("weighted_reg", bool, False), ("emBayes", bool, False),
    ),
    "mf1": (
        *_PLACE, *_INPUT, *_RATINGS, *_LOOP, *_MATRIX, *_IGNORED, ("VB", bool, False), ("ADMM", bool, False), ("lambda", float, 0.0), ("update_gamma_r", bool, False), ("update_gamma_c", bool, False),
        ("update_gamma", bool, False), ("gamma_x", float, 1.0), ("iso", bool, False), ("l1", bool, False), ("max_norm", bool, False),
    ),
    "tf": (
        *_PLACE, *_INPUT, *_RATINGS, *_LOOP, *_IGNORED, *((f"num_blocks{d}", int, 1) for d in (1, 2, 3)), *((f"lambda{d}", float, 0.0) for d in (1, 2, 3)), ("gamma1", float, 10.0), ("gamma2", float, 10.0), ("gamma3", float, 1.0),
        *((f"update_gamma{d}", bool, False) for d in (1, 2, 3)), *((f"size{d}", int, 0) for d in (1, 2, 3)), ("K", int, 20), ("VB", bool, False), ("ADMM", bool, False), ("l1", bool, False), ("max_norm", bool, False),
        ("interval", int, 1), ("synthetic", bool, False), ("markov", bool, False), ("tf", bool, False), ("num_init", int, 0),
    ),
    "lda": (*_PLACE, *_INPUT, *_LOOP, *_IGNORED, ("validate", str, None), ("dict", str, None), ("model", str, "mrlda"), ("num_topics", int, 20), ("alpha", float, 1.0), ("beta0", float, 0.1), ("emBayes", bool, False), ("blocks", int, 4), ("top", int, 10)),
    "genmat": (
        *_PLACE, *_IGNORED, ("mean", float, 0.0), ("num_slices", int, 4), ("row_blocks", int, 1), ("col_blocks", int, 1), ("lambda", float, 100.0), ("K", int, 20), ("num_rows", int, 1_000_000), ("num_cols", int, 1_000_000),
        ("train_ratio", float, 0.9), ("sparsity_level", float, 0.001), ("num_output_blocks", int, 4), ("seed", int, 0),
    ),
    "gentensor": (
        *_PLACE, *_IGNORED, ("mean", float, 0.0), *((f"num_blocks{d}", int, 1) for d in (1, 2, 3)), ("lambda", float, 100.0), ("gamma", float, 1.0), ("K", int, 20), *((f"size{d}", int, 100) for d in (1, 2, 3)), ("train_ratio", float, 0.9),
        ("sparsity_level", float, 0.1), ("seed", int, 0),
    ),
}


@dataclass
class Run:
    """What a run gives: its model (None for generators) and the history of its metrics."""

    model: object
    history: DataFrame | None


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("quorix")
    families = top.add_subparsers(dest="family", required=True)
    for family, options in OPTIONS.items():
        sub = families.add_parser(family, allow_abbrev=False)
        for name, kind, default in options:
            how = {"action": "store_true"} if kind is bool else {"type": kind, "default": default}
            sub.add_argument(f"-{name}", f"--{name}", dest=name, **how)
    return top


def _member(kinds: type, name: str | None):  # noqa: ANN202
    """The enum's member of this value, whatever the case."""
    if name is None:
        return None
    for m in kinds:
        if m.value.lower() == name.lower():
            return m
    raise SystemExit(f"{name!r} is none of {', '.join(m.value for m in kinds)}")


def session(o: argparse.Namespace) -> SparkSession:
    b = SparkSession.builder.appName(f"quorix {o.family}").config("spark.sql.session.timeZone", "UTC")
    if o.mode or o.num_cores:
        b = b.master(o.mode or f"local[{o.num_cores}]")
    if o.num_reducers:
        b = b.config("spark.sql.shuffle.partitions", str(o.num_reducers))
    if o.memory:
        b = b.config("spark.executor.memory", o.memory)
    return b.getOrCreate()


def _slices(df: DataFrame, o: argparse.Namespace) -> DataFrame:
    return df.repartition(o.num_slices) if o.num_slices else df


def _blocks(o: argparse.Namespace) -> int:
    """LR blocks: the slices asked for, else the cores, else 8."""
    return o.num_slices or o.num_cores or 8


def run_lr(spark: SparkSession, o: argparse.Namespace) -> Run:
    raw = datasets.read_lr(spark, o.train, o.binary, o.seq)
    train = datasets.lr_dataset(raw, threshold=0, fraction=o.sample, seed=o.seed).persist()
    kept = datasets.kept_features(train, o.th).persist() if o.th > 0 else None
    data = datasets.lr_dataset(train, kept=kept, seed=o.seed)
    test = datasets.lr_dataset(datasets.read_lr(spark, o.validate, o.binary, o.seq), kept=kept) if o.validate else None
    p = LrParams(
        strategy=_member(LrStrategy, o.model), optimizer=_member(Optimizer, o.opt), regularizer=_member(Regularizer, o.reg), bound=_member(Bound, {"bohning": "bohning"}.get(o.var.lower(), o.var)),
        blocks=_blocks(o), outer=o.outer_iter, inner=o.inner_iter, reg=o.reg_para, rho=o.rho, gamma=o.gamma, subsample=o.ss_rate, target_auc=o.auc, seed=o.seed,
        include_dual=o.dual, ard=o.ard, elastic=o.elastic, t_prior=(o.t_shape, o.t_scale) if o.t_shape > 0 else None, clip=o.clip or None, inner_stop=o.stop_crt,
    )
    model = fit_lr(data, p, test)
    if o.output:
        model.weights.write.mode("overwrite").parquet(f"{o.output}/weights")
        if kept is not None:
            kept.write.mode("overwrite").parquet(f"{o.output}/features")
    return Run(model, model.history)


def _ratings(spark: SparkSession, path: str, o: argparse.Namespace) -> DataFrame:
    return _slices(readers.read_ratings(spark, path, "parquet" if o.seq else o.format, o.sep), o)


def _run_mf(spark: SparkSession, o: argparse.Namespace, p: MfParams) -> Run:
    train = _ratings(spark, o.train, o)
    model = fit_mf(train, p, _ratings(spark, o.test, o) if o.test else None)
    if o.output:
        rating_summary(train).write.mode("overwrite").json(f"{o.output}/summary")
        readers.write_factors(model.factors.select(F.when(F.col("dim") == 0, "r").otherwise("c").alias("side"), "id", "f"), f"{o.output}/factors")
    return Run(model, model.history)


def run_mf(spark: SparkSession, o: argparse.Namespace) -> Run:
    strategy = _member(MfStrategy, {"dgm": "dMAP"}.get(o.model.lower(), o.model))
    return _run_mf(spark, o, MfParams(
        strategy=strategy, optimizer=_member(MfOptimizer, o.opt), regularizer=_member(Regularizer, o.reg), rank=o.K, row_blocks=o.row_blocks, col_blocks=o.col_blocks, outer=o.outer_iter, inner=o.inner_iter,
        reg=o.reg_para, gamma=o.gamma_r, gamma_cols=o.gamma_c, weighted=o.weighted_reg or o.more_para, em_bayes=o.emBayes, mean=o.mean, scale=o.scale, stop=o.stop_crt, seed=o.seed,
    ))


def run_mf1(spark: SparkSession, o: argparse.Namespace) -> Run:
    """The older options: ADMM or averaging, each with VB or MAP; `iso` keeps the blocks apart."""
    strategy = MfStrategy.AVGM if o.iso else MfStrategy.ADMM if o.ADMM and not o.VB else MfStrategy.HECMEM if o.ADMM else MfStrategy.HMEM
    return _run_mf(spark, o, MfParams(
        strategy=strategy, optimizer=MfOptimizer.CDPP, regularizer=Regularizer.L1 if o.l1 else Regularizer.MAX if o.max_norm else Regularizer.L2, rank=o.K, row_blocks=o.row_blocks, col_blocks=o.col_blocks,
        outer=o.outer_iter, inner=o.inner_iter, reg=getattr(o, "lambda"), gamma=o.gamma_r, gamma_cols=o.gamma_c, vb=o.VB, em_bayes=o.update_gamma or o.update_gamma_r or o.update_gamma_c, mean=o.mean, scale=o.scale, seed=o.seed,
    ))


def run_tf(spark: SparkSession, o: argparse.Namespace) -> Run:
    def read(path: str) -> DataFrame:
        if o.format == "movielens":
            cells = text.time_tensor(text.movielens(readers.read_lines(spark, path)), o.interval)
            return _slices(cells.withColumn("value", (F.col("value") - o.mean) / o.scale), o)
        return _slices(readers.read_tensor(spark, path, "parquet" if o.seq or o.synthetic else o.format, o.sep, o.mean, o.scale), o)

    p = TfParams(
        rank=o.K, blocks=(o.num_blocks1, o.num_blocks2, o.num_blocks3), outer=o.outer_iter, inner=o.inner_iter, reg=o.lambda1, gamma=(o.gamma1, o.gamma2, o.gamma3), regularizer=Regularizer.L1 if o.l1 else Regularizer.MAX if o.max_norm else Regularizer.L2,
        vb=o.VB, dual=o.ADMM, time_factors=o.tf, frozen_outer=o.num_init, markov=o.lambda3 if o.markov else None, seed=o.seed,
    )
    model = fit_tf(read(o.train), p, read(o.test) if o.test else None)
    if o.output:
        readers.write_factors(model.factors.select(F.col("dim").alias("side"), "id", "f"), f"{o.output}/factors")
    return Run(model, model.history)


def run_lda(spark: SparkSession, o: argparse.Namespace) -> Run:
    def read(path: str) -> DataFrame:
        return readers.read_documents(spark, path).select(F.monotonically_increasing_id().alias("doc_id"), "words", "counts")

    p = LdaParams(strategy=_member(LdaStrategy, o.model), topics=o.num_topics, blocks=o.blocks, outer=o.outer_iter, inner=o.inner_iter, alpha=o.alpha, beta=o.beta0, update_alpha=o.emBayes, seed=o.seed)
    model = fit_lda(_slices(read(o.train), o), p, validate=read(o.validate) if o.validate else None)
    if o.output:
        model.topics.write.mode("overwrite").parquet(f"{o.output}/topics")
        readers.write_top_words(top_words(model.topics, o.top), f"{o.output}/top_words", readers.read_dictionary(spark, o.dict) if o.dict else None)
    return Run(model, model.history)


def run_genmat(spark: SparkSession, o: argparse.Namespace) -> Run:
    made = synth.synth_matrix(spark, o.num_rows, o.num_cols, o.K, o.sparsity_level, getattr(o, "lambda"), o.train_ratio, o.seed, row_blocks=max(o.num_slices, o.row_blocks))
    made = made.withColumn("value", F.col("value") + o.mean).withColumn("rb", F.floor(F.col("row") * o.row_blocks / o.num_rows).cast("int")).withColumn("cb", F.floor(F.col("col") * o.col_blocks / o.num_cols).cast("int"))
    for name, part in (("train", made.where("is_train")), ("test", made.where("NOT is_train"))):
        readers.write_blocks(part.drop("is_train"), f"{o.output}/{name}", o.num_output_blocks)
    return Run(None, None)


def run_gentensor(spark: SparkSession, o: argparse.Namespace) -> Run:
    made = synth.synth_tensor(spark, (o.size1, o.size2, o.size3), o.K, o.sparsity_level, getattr(o, "lambda"), o.gamma, o.train_ratio, o.seed, blocks=max(4, o.num_blocks1)).withColumn("value", F.col("value") + o.mean)
    for name, part in (("train", made.where("is_train")), ("test", made.where("NOT is_train"))):
        readers.write_tensor(part.drop("is_train"), f"{o.output}/{name}")
    return Run(None, None)


RUNS = {"lr": run_lr, "mf": run_mf, "mf1": run_mf1, "tf": run_tf, "lda": run_lda, "genmat": run_genmat, "gentensor": run_gentensor}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> Run:
    o = parser().parse_args(argv)
    if o.family in ("genmat", "gentensor") and not o.output:
        raise SystemExit("-output is needed")
    if "train" in o and not o.train:
        raise SystemExit("-train is needed")
    run = RUNS[o.family](spark or session(o), o)
    if run.history is not None:
        if o.output:
            readers.write_history(run.history, f"{o.output}/log")
        last = run.history.agg(F.max("iteration")).first()[0]
        for r in run.history.where(F.col("iteration") == last).collect() if last is not None else ():
            print(f"{r['metric']} {r['value']:.6f}")
    return run


if __name__ == "__main__":
    main(sys.argv[1:])
