"""Click logs to sparse binary features: smoothed rates, bins, one-hot ids, token features, one row per impression.

The layout is a list of feature blocks, each with a width; offsets follow from the widths. Side tables are
joined, not collected, so their size doesn't matter; Catalyst broadcasts the small ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorix.functions.exprs import bucketize, smoothed_rate
from quorix.operators.counts import clicks_by, expand_impressions, token_counts, top_tokens
from quorix.operators.partition import dense_index
from quorix.session import snapshot

ENTITIES = ("user", "query", "ad", "advertiser", "keyword", "title", "description")
#: Entities whose rate is a feature, in layout order.
RATED = ("ad", "advertiser", "query", "user", "keyword")
#: Widths of the token-length features.
LENGTHS = (("query", 20), ("title", 30), ("description", 50), ("keyword", 10))


@dataclass(frozen=True)
class CtrLayout:
    """Sizes of the id spaces and of the bins."""

    users: int
    queries: int
    ads: int
    query_tokens: int
    keyword_tokens: int
    rate_bins: int = 100
    id_bins: int = 10_000

    def widths(self) -> list[tuple[str, int]]:
        return [
            ("intercept", 1),
            *((f"{e}_rate", self.rate_bins) for e in RATED),
            ("user_id", self.users),
            ("ad_id", self.ads),
            ("query_id", self.queries),
            ("user_bin", self.id_bins),
            ("query_bin", self.id_bins),
            *((f"{e}_length", w) for e, w in LENGTHS),
            ("gender", 3),
            ("age", 6),
            ("place", 6),
            ("query_tokens", self.query_tokens),
            ("keyword_tokens", self.keyword_tokens),
        ]

    def offsets(self) -> dict[str, int]:
        out, at = {}, 0
        for name, width in self.widths():
            out[name] = at
            at += width
        return out


def all_rates(log: DataFrame, entities: tuple[str, ...] = ENTITIES) -> DataFrame:
    """(entity, id, clicks, impressions, rate) of all entities in one GROUPING SETS pass."""
    return clicks_by(log, list(entities)).withColumn("rate", smoothed_rate(F.col("clicks"), F.col("impressions")))


def binned_rates(log: DataFrame, entities: tuple[str, ...], bins: int) -> DataFrame:
    """(entity, id, clicked, bin): whether the id was ever clicked, and its rate's bin of the entity's largest rate over `bins`."""
    rates = snapshot(all_rates(log, entities))  # read once per entity
    largest = rates.groupBy("entity").agg((F.max("rate") / bins).alias("size"))  # one row per entity
    return rates.join(F.broadcast(largest), "entity").select("entity", "id", (F.col("clicks") > 0).alias("clicked"), bucketize(F.col("rate"), F.col("size"), bins).alias("bin"))


def vocabulary(tokens: DataFrame, top: int | None = None, above: int | None = None) -> DataFrame:
    """(token, index): the `top` most frequent tokens, or those above a count, of (id, tokens) rows."""
    counts = token_counts(tokens.select(F.explode("tokens").alias("token")))
    if top is not None:
        return top_tokens(counts, top).select("token", "index")
    return dense_index(counts.where(F.col("n") > above), "token")


def indexed_tokens(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, tokens): known tokens only, as vocabulary indices in their order."""
    known = tokens.select("id", F.posexplode("tokens").alias("pos", "token")).join(vocab, "token")
    kept = known.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "index"))).alias("t")).select("id", F.transform("t", lambda e: e["index"].cast("int")).alias("tokens"))
    return tokens.select("id").distinct().join(kept, "id", "left").select("id", F.coalesce("tokens", F.array().cast("array<int>")).alias("tokens"))


def features(train: DataFrame, log: DataFrame, tokens: dict[str, DataFrame], profile: DataFrame, layout: CtrLayout) -> DataFrame:
    """One row per impression of `log`: (features array<int>, last element the label), rates taken from `train`.

    Entities that `train` never saw get no rate feature; users without profile no gender and age. A rate bin
    is the largest rate over the number of bins. Rows without impressions or with depth 0 give no row.
    Ids and token indices that lie outside their block of the layout raise.
    """
    at, width = layout.offsets(), dict(layout.widths())
    rows = log.where((F.col("impressions") > 0) & (F.col("depth") > 0))
    ad_ids = train.select("ad").distinct()
    rows = rows.join(dense_index(ad_ids, "ad", "ad_index"), "ad", "left")
    rates = binned_rates(train, RATED, layout.rate_bins)
    for e in RATED:
        rows = rows.join(rates.where(F.col("entity") == e).select(F.col("id").alias(e), F.col("clicked").alias(f"{e}_clicked"), F.col("bin").alias(f"{e}_rate")), e, "left")
    for e, _ in LENGTHS:
        rows = rows.join(tokens[e].select(F.col("id").alias(e), F.col("tokens").alias(f"{e}_list")), e, "left")
    rows = rows.join(profile, "user", "left")

    def put(name: str, value: Column) -> Column:
        return F.array((value + at[name]).cast("int"))

    def inside(name: str, value: Column) -> Column:
        message = F.concat(F.lit(f"{name} outside its {width[name]} features: "), value.cast("string"))
        return F.when((value < 0) | (value >= width[name]), F.raise_error(message).cast("int")).otherwise(value)

    def put_if(name: str, condition: Column, value: Column) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), put(name, value)).otherwise(F.array().cast("array<int>"))

    def bag(name: str, entity: str) -> Column:
        moved = F.transform(F.coalesce(F.col(f"{entity}_list"), F.array().cast("array<int>")), lambda t: (inside(name, t) + at[name]).cast("int"))
        return F.when(F.coalesce(F.col(f"{entity}_clicked"), F.lit(False)), moved).otherwise(F.array().cast("array<int>"))

    parts = [
        F.array(F.lit(0)),
        *(put_if(f"{e}_rate", F.col(f"{e}_rate").isNotNull(), F.col(f"{e}_rate")) for e in RATED),
        put_if("user_id", F.col("user_clicked"), inside("user_id", F.col("user"))),
        put_if("ad_id", F.col("ad_clicked"), inside("ad_id", F.col("ad_index"))),
        put_if("query_id", F.col("query_clicked"), inside("query_id", F.col("query"))),
        put("user_bin", bucketize(inside("user_id", F.col("user")), max(layout.users // layout.id_bins, 1), layout.id_bins)),
        put("query_bin", bucketize(inside("query_id", F.col("query")), max(layout.queries // layout.id_bins, 1), layout.id_bins)),
        *(put(f"{e}_length", F.least(F.coalesce(F.size(F.col(f"{e}_list")), F.lit(0)), F.lit(w - 1))) for e, w in LENGTHS),
        put_if("gender", F.col("gender").isNotNull(), F.col("gender")),
        put_if("age", F.col("age").isNotNull(), F.col("age") - 1),
        put("place", F.floor(6 * F.col("position") / F.col("depth"))),
        bag("query_tokens", "query"),
        bag("keyword_tokens", "keyword"),
    ]
    made = rows.withColumn("__f", F.flatten(F.array(*parts)))
    return expand_impressions(made).select(F.concat("__f", F.array("label")).alias("features"))
