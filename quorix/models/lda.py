"""Topic models: exact batch variational Bayes (MRLDA) and block consensus without or with dual (HDLDA, VADMM).

Documents stay in blocks. Topics are a table with one row (word, eta) per word; a word's row travels once to
each block that holds the word, and one row of statistics per block and word comes back. The driver holds
only one number per topic, so neither documents nor vocabulary have to fit anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorix.functions import special as S
from quorix.models import kernels_lda as K
from quorix.models.consensus import _lists, _matrix
from quorix.operators.partition import even_block, groups_for, hash_block
from quorix.schema import LdaParams, LdaStrategy
from quorix.session import release, ship_package, snapshot

TOPIC_DDL = "word int, eta array<double>"
_LIST = pa.list_(pa.float64())
_TOPIC = pa.schema([("word", pa.int32()), ("eta", _LIST)])
_STATS = pa.schema([("word", pa.int32()), ("stat", _LIST)])
_GAMMAS = pa.schema([("doc_id", pa.int64()), ("gamma", _LIST)])
_STATE = pa.schema([("block", pa.int32()), ("word", pa.int32()), ("eta", _LIST), ("dual", _LIST)])
_STATE_DDL = "block int, word int, eta array<double>, dual array<double>"
#: Numbers of the topics table that a group of the M-step takes.
BUCKET_CELLS = 4_000_000
#: Rows of a pass that aren't statistics of a word: sums of the documents, and of E[log theta].
_SCALARS, _LOG_THETA = -1, -2


@dataclass
class Topics:
    """rows (word, eta), one row per word of the vocabulary; per topic the sum of eta and what the bound needs."""

    rows: DataFrame
    vocabulary: int
    totals: np.ndarray
    inner: np.ndarray

    @staticmethod
    def of(rows: DataFrame, topics: int, beta: float) -> Topics:
        """Counts the sums over the words; `rows` should be a table, since it is read again."""
        ship_package(rows.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                eta = np.asarray(b.column(0).flatten(), np.float64).reshape(-1, topics)
                inner = (beta - eta) * S.digamma(eta).reshape(eta.shape) + S.lgamma(eta)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(topics)), pa.array(eta.sum(0)), pa.array(inner.sum(0)), pa.array(np.full(topics, len(eta)))], names=["topic", "total", "inner", "n"])

        found = rows.select("eta").mapInArrow(run, "topic bigint, total double, inner double, n bigint").groupBy("topic").agg(F.sum("total").alias("total"), F.sum("inner").alias("inner"), F.sum("n").alias("n")).collect()
        totals, inner = np.zeros(topics), np.zeros(topics)
        for r in found:
            totals[r["topic"]], inner[r["topic"]] = r["total"], r["inner"]
        return Topics(rows, found[0]["n"] if found else 0, totals, inner)

    def bound(self, beta: float) -> float:
        """The topics' part of the evidence lower bound."""
        v, k = self.vocabulary, len(self.totals)
        score = (self.inner - S.digamma(self.totals) * (v * beta - self.totals)).sum() - v * k * S.lgamma(np.array(beta))
        return float(score + k * S.lgamma(np.array(beta * v)) - S.lgamma(self.totals).sum())

    def long(self) -> DataFrame:
        """(topic, word, eta)"""
        return self.rows.select("word", F.posexplode("eta").alias("topic", "eta")).select("topic", "word", "eta")


@dataclass
class DocBlocks:
    """Documents (doc_id, words, counts[, gamma]) in blocks, and (block, word): which block needs which word's row."""

    data: DataFrame
    links: DataFrame

    @staticmethod
    def of(docs: DataFrame, blocks: int, seed: int = 0) -> DocBlocks:
        """Null and empty documents are left out; words must be distinct within a document."""
        columns = ["doc_id", "words", "counts", *(["gamma"] if "gamma" in docs.columns else [])]
        data = docs.where(F.size("words") > 0).select(*columns, even_block(docs.sparkSession, blocks, hash_block(blocks, "doc_id", seed=seed)).alias("block")).repartition(blocks, "block").persist(StorageLevel.MEMORY_AND_DISK)
        return DocBlocks(data, data.select("block", F.explode("words").alias("word")).distinct().persist(StorageLevel.MEMORY_AND_DISK))

    def release(self) -> None:
        self.data.unpersist()
        self.links.unpersist()

    def solve(self, rows: DataFrame, run: Callable, ddl: str, keys: str = "word") -> DataFrame:
        """Each block with its words' rows, through one cogrouped function. `rows` has word and further columns."""
        ship_package(self.data.sparkSession)
        if keys == "word":
            routed = self.links.join(rows, "word").toDF("word", "block", *rows.columns[1:])  # columns of its own
        else:
            routed = rows
        return self.data.groupBy("block").cogroup(routed.groupBy("block")).applyInArrow(run, ddl)


def _local(docs: pa.Table, used: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, object]]:
    """(doc_id, positions of the words in `used`, counts, gamma or None) in doc_id order; words without a row are left out."""
    docs = docs.take(pa.array(np.argsort(docs["doc_id"].to_numpy(), kind="stable")))
    gammas = docs["gamma"].to_pylist() if "gamma" in docs.column_names else [None] * docs.num_rows
    for i, words, counts, g in zip(docs["doc_id"].to_pylist(), docs["words"].to_pylist(), docs["counts"].to_pylist(), gammas):
        w, c = np.array(words, np.int64), np.array(counts, np.float64)
        at = np.minimum(np.searchsorted(used, w), max(len(used) - 1, 0))
        known = used[at] == w if len(used) else np.zeros(len(w), bool)
        yield i, at[known], c[known], g


def _sorted_rows(table: pa.Table, column: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(words rising, their vectors as topics x words)."""
    table = table.take(pa.array(np.argsort(table["word"].to_numpy(), kind="stable")))
    return table["word"].to_numpy(), _matrix(table[column], k).T


def _infer(totals: np.ndarray, alpha: np.ndarray, rounds: int, log_space: bool, want_gammas: bool):  # noqa: ANN202
    k = len(totals)

    def run(docs: pa.Table, topics: pa.Table) -> pa.Table:
        schema = _GAMMAS if want_gammas else _STATS
        if not docs.num_rows:
            return pa.Table.from_batches([], schema)
        used, eta = _sorted_rows(topics, "eta", k)
        log_beta = S.digamma(eta).reshape(eta.shape) - S.digamma(totals)[:, None]
        exp_beta, beta = np.exp(log_beta), eta / totals[:, None]
        stats, theta, sums, gammas = np.zeros(eta.shape), np.zeros(k), np.zeros(4), []
        for i, w, c, start in _local(docs, used):
            g = np.ones(k) if start is None else np.array(start, float)
            if log_space:
                g, s = K.e_step_log(w, c, log_beta[:, w], alpha, g, rounds)
                s = s / np.maximum(exp_beta[:, w], K.PHI_FLOOR)
            else:
                g, s = K.e_step(w, c, exp_beta[:, w], alpha, g, rounds)
            stats[:, w] += s
            theta += S.dirichlet_expectation(g)
            sums += (K.log_likelihood(w, c, g, beta[:, w]), c.sum(), K.document_bound(w, c, g, alpha, log_beta[:, w]), 1.0)
            if want_gammas:
                gammas.append((i, g))
        if want_gammas:
            return pa.Table.from_arrays([pa.array([i for i, _ in gammas], pa.int64()), _lists(np.array([g for _, g in gammas]))], schema=schema)
        vectors = pa.concat_arrays([_lists(stats.T), pa.array([sums.tolist(), theta.tolist()], _LIST)])
        return pa.Table.from_arrays([pa.array(np.append(used, (_SCALARS, _LOG_THETA)), pa.int32()), vectors], schema=schema)

    return run


@dataclass
class Pass:
    """One pass over the documents: statistics (word, stat), a row per block and word; summed E[log theta]; and the
    metrics of the topics it used. bound holds the documents' part of the evidence lower bound."""

    stats: DataFrame
    log_theta: np.ndarray
    llh: float
    tokens: float
    bound: float
    n_docs: int

    def metrics(self, topics: Topics, beta: float) -> dict[str, float]:
        """Log-likelihood, tokens, perplexity and evidence lower bound."""
        perplexity = float(np.exp(-self.llh / self.tokens)) if self.tokens else float("nan")
        return {"llh": self.llh, "tokens": self.tokens, "perplexity": perplexity, "bound": self.bound + topics.bound(beta)}


def e_pass(docs: DocBlocks, topics: Topics, alpha: np.ndarray, rounds: int, log_space: bool = False, replaces: Pass | None = None) -> Pass:
    """Infer every document's topics and sum what the M-step, alpha and the metrics need.

    A column `gamma` of the documents starts them (default: ones). With 0 rounds the given gammas are only evaluated.
    """
    rows = snapshot(docs.solve(topics.rows, _infer(topics.totals, alpha, rounds, log_space, False), "word int, stat array<double>"), replaces=replaces.stats if replaces else None)
    sums, theta = np.zeros(4), np.zeros(len(topics.totals))
    for r in rows.where("word < 0").collect():  # two rows per block
        into = sums if r["word"] == _SCALARS else theta
        into += np.array(r["stat"])
    return Pass(rows, theta, float(sums[0]), float(sums[1]), float(sums[2]), int(sums[3]))


def _per_word(rows: DataFrame, topics: Topics, update: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], beta: float) -> Topics:
    """New topics: `update` of each word's summed vectors in `rows` (word, stat), their number, and its old eta."""
    k = len(topics.totals)

    def run(new: pa.Table, old: pa.Table) -> pa.Table:
        words, eta = _sorted_rows(old, "eta", k)
        total, n = np.zeros((len(words), k)), np.zeros(len(words))
        if new.num_rows and len(words):
            w, stat = new["word"].to_numpy(), _matrix(new["stat"], k)
            order = np.lexsort((stat[:, 0], w))  # float sums then don't depend on the shuffle's order
            w, stat = w[order], stat[order]
            at = np.minimum(np.searchsorted(words, w), len(words) - 1)
            known = words[at] == w
            np.add.at(total, at[known], stat[known])
            np.add.at(n, at[known], 1)
        return pa.Table.from_arrays([pa.array(words, pa.int32()), _lists(update(total.T, n, eta).T)], schema=_TOPIC)

    ship_package(rows.sparkSession)
    buckets = groups_for(rows.sparkSession, topics.vocabulary * k, BUCKET_CELLS)
    bucket = F.pmod(F.xxhash64("word"), F.lit(buckets))
    both = rows.where("word >= 0").withColumn("bucket", bucket).groupBy("bucket").cogroup(topics.rows.withColumn("bucket", bucket).groupBy("bucket"))
    return Topics.of(snapshot(both.applyInArrow(run, TOPIC_DDL), replaces=topics.rows), k, beta)


def m_step(found: Pass, topics: Topics, beta: float) -> Topics:
    """eta = statistics * e^{E log beta} + prior."""
    totals = topics.totals

    def update(total: np.ndarray, n: np.ndarray, eta: np.ndarray) -> np.ndarray:
        return K.m_step(total, np.exp(S.digamma(eta).reshape(eta.shape) - S.digamma(totals)[:, None]), beta)

    return _per_word(found.stats, topics, update, beta)


def word_starts(words: np.ndarray, topics: int, seed: int) -> np.ndarray:
    """Random starts, topics x words, from generators seeded by the word."""
    return np.stack([np.random.default_rng([seed, int(w)]).gamma(10.0, 0.1, topics) for w in words], 1) if len(words) else np.empty((topics, 0))


def initial_topics(spark: SparkSession, p: LdaParams, vocabulary: int) -> Topics:
    ship_package(spark)
    k, seed = p.topics, p.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.int32()), _lists(word_starts(words, k, seed).T)], schema=_TOPIC)

    rows = spark.range(vocabulary).select(F.col("id").cast("int").alias("word")).mapInArrow(run, TOPIC_DDL)
    return Topics.of(snapshot(rows), k, p.beta)


def seed_topics(docs: DataFrame, p: LdaParams, vocabulary: int) -> Topics:
    """Topics from a local fit of a bounded sample of documents: the `sample_docs` with the smallest hash."""
    rows = docs.orderBy(F.xxhash64(F.lit(p.seed), "doc_id"), "doc_id").limit(p.sample_docs).select("words", "counts").collect()
    raw = [(np.array(r["words"], np.int64), np.array(r["counts"], np.float64)) for r in rows]
    used = np.unique(np.concatenate([w for w, _ in raw])) if raw else np.empty(0, np.int64)
    eta = K.fit_local([(np.searchsorted(used, w), c) for w, c in raw], word_starts(used, p.topics, p.seed), p.beta, np.full(p.topics, p.alpha), 5, p.inner)[0]
    spark = docs.sparkSession
    fitted = spark.createDataFrame(pa.table({"word": pa.array(used, pa.int32()), "fitted": _lists(eta.T)}))
    every = spark.range(vocabulary).select(F.col("id").cast("int").alias("word")).join(F.broadcast(fitted), "word", "left")
    return Topics.of(snapshot(every.select("word", F.coalesce("fitted", F.array_repeat(F.lit(float(p.beta)), p.topics)).alias("eta"))), p.topics, p.beta)


def _block_run(p: LdaParams, alpha: np.ndarray, dual_on: bool):  # noqa: ANN202
    k = p.topics

    def run(docs: pa.Table, rows: pa.Table) -> pa.Table:
        if not docs.num_rows or not rows.num_rows:
            return pa.Table.from_batches([], _STATE)
        block = docs["block"][0].as_py()
        rows = rows.take(pa.array(np.argsort(rows["word"].to_numpy(), kind="stable")))
        used, glob = rows["word"].to_numpy(), _matrix(rows["glob"], k).T
        eta, dual = glob.copy(), np.zeros(glob.shape)
        old = np.nonzero(np.asarray(rows["eta"].combine_chunks().is_valid()))[0]
        if len(old):
            kept = rows.take(pa.array(old))
            eta[:, old], dual[:, old] = _matrix(kept["eta"], k).T, _matrix(kept["dual"], k).T
            if dual_on:
                dual = dual + eta - glob
        local = [(w, c) for _, w, c, _ in _local(docs, used)]
        eta, _, _ = K.fit_local(local, eta, np.maximum(glob - dual, K.POSITIVE_FLOOR), alpha, 1, p.inner, log_space=p.log_space)
        return pa.Table.from_arrays([pa.array(np.full(len(used), block), pa.int32()), pa.array(used, pa.int32()), _lists(eta.T), _lists(dual.T)], schema=_STATE)

    return run


def block_round(docs: DocBlocks, state: DataFrame | None, topics: Topics, alpha: np.ndarray, p: LdaParams) -> tuple[DataFrame, Topics]:
    """(state, topics) after one local fit of every block and the average; state rows are (block, word, eta, dual)."""
    dual = LdaStrategy(p.strategy) is LdaStrategy.VADMM
    spark = docs.data.sparkSession
    old = spark.createDataFrame([], _STATE_DDL) if state is None else state
    routed = docs.links.join(topics.rows.withColumnRenamed("eta", "glob"), "word").join(old, ["word", "block"], "left").select("word", "block", "glob", "eta", "dual")
    new = snapshot(docs.solve(routed.toDF(*routed.columns), _block_run(p, alpha, dual), _STATE_DDL, keys="block"), replaces=state)
    value = F.zip_with("eta", "dual", lambda a, b: a + b) if dual else F.col("eta")

    def update(total: np.ndarray, n: np.ndarray, eta: np.ndarray) -> np.ndarray:
        # a word that a block lacks keeps that block's prior, which is the global topic
        return np.maximum((total + (p.blocks - n) * eta + p.beta) / (p.blocks + 1), K.POSITIVE_FLOOR)

    return new, _per_word(new.select("word", value.alias("stat")), topics, update, p.beta)


@dataclass
class LdaModel:
    """topics (topic, word, eta), the Dirichlet parameter alpha and history (iteration, metric, value)."""

    topics: DataFrame
    alpha: np.ndarray
    history: DataFrame
    fitted: Topics

    def document_topics(self, docs: DataFrame, rounds: int = 20, blocks: int = 8) -> DataFrame:
        """(doc_id, gamma) of documents (doc_id, words, counts) after folding in; documents without words give no row."""
        return DocBlocks.of(docs, blocks).solve(self.fitted.rows, _infer(self.fitted.totals, self.alpha, rounds, False, True), "doc_id bigint, gamma array<double>")


def fit_lda(docs: DataFrame, p: LdaParams | None = None, vocabulary: int | None = None, validate: DataFrame | None = None) -> LdaModel:
    """Train on (doc_id, words, counts), words distinct within a document. Null and empty documents are left out.

    `vocabulary` defaults to the largest word id + 1. There are at least as many blocks of documents as cores; `blocks` should
    be large enough for a block's documents and words to fit a task. Metrics are taken on `validate` after folding in; without it, on the
    training documents with the gammas of the next E-step (MRLDA: one pass over the documents per iteration).
    """
    p = p or LdaParams()
    strategy = LdaStrategy(p.strategy)
    spark = docs.sparkSession
    exact = strategy is LdaStrategy.MRLDA
    fine = groups_for(spark, p.blocks, 1)
    blocks = DocBlocks.of(docs.select("doc_id", "words", "counts"), fine if exact else p.blocks, p.seed)
    # the blocks of a consensus are few; metrics are taken in more, smaller ones
    test = DocBlocks.of(validate.select("doc_id", "words", "counts"), fine, p.seed) if validate is not None else None if exact else DocBlocks.of(blocks.data.drop("block"), fine, p.seed + 1)
    v = vocabulary or (blocks.links.agg(F.max("word").alias("m")).first()["m"] or 0) + 1
    alpha = np.full(p.topics, p.alpha)
    history: list[tuple[int, str, float]] = []
    topics = initial_topics(spark, p, v) if exact else seed_topics(blocks.data, p, v)
    current = e_pass(blocks, topics, alpha, p.inner, p.log_space) if exact else None
    state = seen = None
    for t in range(p.outer):
        if exact:
            topics = m_step(current, topics, p.beta)
            if p.update_alpha:
                alpha = K.newton_alpha_from(alpha, current.log_theta, current.n_docs)
            # the next E-step also gives the metrics of these topics
            if test is None or t + 1 < p.outer:
                current = e_pass(blocks, topics, alpha, p.inner, p.log_space, replaces=current)
            seen = current if test is None else e_pass(test, topics, alpha, p.fold_in, replaces=seen)
        else:
            state, topics = block_round(blocks, state, topics, alpha, p)
            seen = e_pass(test, topics, alpha, p.fold_in, replaces=seen)
            if p.update_alpha:
                own = seen if validate is None else e_pass(blocks, topics, alpha, p.inner)
                alpha = K.newton_alpha_from(alpha, own.log_theta, own.n_docs)
        history += [(t, k, float(x)) for k, x in seen.metrics(topics, p.beta).items()]
    for done in (current, seen):
        release(done.stats if done else None)
    release(state)
    blocks.release()
    if test is not None:
        test.release()
    return LdaModel(topics.long(), alpha, spark.createDataFrame(history, "iteration int, metric string, value double"), topics)
