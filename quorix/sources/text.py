"""Parsers of the text formats, as Column expressions over a DataFrame of lines (column `value`).

Malformed tokens give null numbers and are dropped with their token; malformed lines give no rows. Each
parser keeps the other columns of its input unless it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as st

LINE = "value"


def label(token: Column) -> Column:
    """Label rule: leading + is 1, leading - or 0 is -1, all else 1."""
    return F.when(token.startswith("+"), 1).when(token.startswith("-") | token.startswith("0"), -1).otherwise(1)


def _tokens(line: Column) -> Column:
    return F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != "")


def _pair_index(t: Column) -> Column:
    return F.split(t, ":")[0].try_cast("int")


def _pair_value(t: Column) -> Column:
    return F.get(F.split(t, ":"), F.lit(1)).try_cast("double")


def libsvm(lines: DataFrame, binary: bool = False, intercept: bool = True) -> DataFrame:
    """`label idx[:val] ...` to (label, idx, val). Real features are shifted by 1, the intercept is 0.

    A token without value counts 1. `binary` gives a null `val` (all ones). Blank lines give no row.
    """
    keep = [c for c in lines.columns if c != LINE]
    # one-element lateral arrays: the line and each token are split once, not in every place of use
    split = lines.select(*keep, F.explode(F.array(_tokens(F.col(LINE)))).alias("__t")).where(F.size("__t") > 0)

    def pair(t: Column) -> Column:
        p = F.split(t, ":")
        return F.struct(p[0].try_cast("int").alias("i"), (F.lit(1.0) if binary else F.coalesce(F.get(p, F.lit(1)).try_cast("double"), F.lit(1.0))).alias("v"))

    pairs = F.filter(F.transform(F.slice("__t", 2, F.greatest(F.size("__t") - 1, F.lit(0))), pair), lambda e: e["i"].isNotNull())
    made = split.select(*keep, label(F.col("__t")[0]).alias("label"), F.explode(F.array(pairs)).alias("__e"))
    shift = 1 if intercept else 0
    idx = F.transform("__e", lambda e: e["i"] + shift)
    val = F.transform("__e", lambda e: e["v"])
    if intercept:
        idx, val = F.concat(F.array(F.lit(0)), idx), F.concat(F.array(F.lit(1.0)), val)
    return made.select(*keep, "label", idx.alias("idx"), (F.lit(None).cast("array<double>") if binary else val).alias("val"))


def explode_vectors(vectors: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, label, feature, value) of (key, label, idx, val); a null val is all ones."""
    pair = F.arrays_zip(F.col("idx").alias("i"), F.coalesce("val", F.transform("idx", lambda _: F.lit(1.0))).alias("v"))
    return vectors.select(key, "label", F.explode(pair).alias("e")).select(key, "label", F.col("e.i").alias("feature"), F.col("e.v").cast("double").alias("value"))


def keep_features(exploded: DataFrame, kept: DataFrame) -> DataFrame:
    """Restrict to the features of `kept` (feature, index) and renumber them; Catalyst picks the join."""
    return exploded.join(kept, "feature").select(*(c for c in exploded.columns if c != "feature"), F.col("index").alias("feature"))


def int_records(df: DataFrame, column: str = "features") -> DataFrame:
    """Int arrays whose last element is the label: (label, idx, val null). No shift, no intercept added."""
    a = F.col(column)
    return df.where(F.size(a) > 0).select(
        *(c for c in df.columns if c != column), F.element_at(a, -1).alias("label"), F.slice(a, 1, F.size(a) - 1).alias("idx"), F.lit(None).cast("array<double>").alias("val")
    )


def ads(lines: DataFrame) -> DataFrame:
    """Ads TSV of four fields: (label, tokens); label is 1 where field 1 is above 0, else -1. Other lines are dropped."""
    p = F.split(F.col(LINE), "\t")
    return lines.where((F.size(p) == 4) & p[1].try_cast("int").isNotNull()).select(
        *(c for c in lines.columns if c != LINE), F.when(p[1].try_cast("int") > 0, 1).otherwise(-1).alias("label"), F.filter(F.split(p[3], " "), lambda t: t != "").alias("tokens")
    )


def _scaled(v: Column, mean: float, scale: float) -> Column:
    return v if mean == 0.0 and scale == 1.0 else (v - F.lit(mean)) / F.lit(scale)


def delimited(lines: DataFrame, names: tuple[str, ...], sep: str, mean: float = 0.0, scale: float = 1.0) -> DataFrame:
    """Integer coordinates `names` and a value, separated by a literal string, optionally centred and scaled."""
    p = F.split(F.col(LINE), "\\Q" + sep + "\\E")
    coordinates = [F.trim(p[i]).try_cast("int").alias(n) for i, n in enumerate(names)]
    value = _scaled(F.trim(p[len(names)]).try_cast("double"), mean, scale).alias("value")
    return lines.where(F.size(p) == len(names) + 1).select(*coordinates, value).dropna()


def adjacency(lines: DataFrame, names: tuple[str, ...] = ("row", "col"), mean: float = 0.0, scale: float = 1.0) -> DataFrame:
    """`a <tab> b[:c]:value ...` to one row per pair; two names for ratings, three for tensor cells."""
    p = F.split(F.col(LINE), "\t")
    n = len(names)
    exploded = lines.where(F.size(p) == 2).select(F.trim(p[0]).try_cast("int").alias(names[0]), F.explode(_tokens(p[1])).alias("t"))
    parts = F.split("t", ":")
    inner = [F.get(parts, F.lit(i)).try_cast("int").alias(x) for i, x in enumerate(names[1:])]
    value = _scaled(F.get(parts, F.lit(n - 1)).try_cast("double"), mean, scale).alias("value")
    return exploded.where(F.size(parts) == n).select(names[0], *inner, value).dropna()


def movielens(lines: DataFrame) -> DataFrame:
    """`user::item::rating::epoch` to (row, col, value, ts)."""
    p = F.split(F.col(LINE), "::")
    return (
        lines.where(F.size(p) == 4)
        .select(p[0].try_cast("int").alias("row"), p[1].try_cast("int").alias("col"), p[2].try_cast("double").alias("value"), p[3].try_cast("int").alias("ts"))
        .dropna()
    )


def time_tensor(ratings: DataFrame, interval: int) -> DataFrame:
    """(i, j, k, value) with k the time bucket counted from the earliest one (a one-row broadcast)."""
    bucket = F.floor(F.col("ts") / F.lit(interval)).cast("int")
    first = ratings.agg(F.min(bucket).alias("first"))
    return ratings.crossJoin(F.broadcast(first)).select(F.col("row").alias("i"), F.col("col").alias("j"), (bucket - F.col("first")).cast("int").alias("k"), "value")


#: Lines of a piece in which headers are carried forward at once.
PIECE_LINES = 1 << 16


def headed(lines: DataFrame, order: str, header: str, group: str | None = None) -> DataFrame:
    """Carry header lines forward: each other line gets the text of the last line above it matching `header`.

    `group` separates files, which are ordered independently; without it all lines form one sequence. `order` is
    a line number, or a struct whose field `block` is the place of the file's piece the line comes from. No task
    holds a whole file: headers are carried inside pieces, and each piece's last header over the table of pieces.
    """
    block = isinstance(lines.schema[order].dataType, st.StructType)
    piece = F.col(order)["block"] if block else F.floor(F.col(order) / PIECE_LINES)
    marked = lines.withColumns({"__piece": piece, "__file": F.col(group) if group else F.lit(0), "__head": F.when(F.col(LINE).rlike(header), F.col(LINE))})
    heads = marked.groupBy("__file", "__piece").agg(F.max_by("__head", F.when(F.col("__head").isNotNull(), F.col(order))).alias("__last"))
    before = Window.partitionBy("__file").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)  # one row per piece
    carried = heads.select(F.col("__file").alias("__f"), F.col("__piece").alias("__p"), F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    w = Window.partitionBy("__file", "__piece").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = marked.withColumn("__own", F.last("__head", ignorenulls=True).over(w)).where(F.col("__head").isNull())
    met = own.join(carried, F.col("__file").eqNullSafe(F.col("__f")) & (F.col("__piece") == F.col("__p")), "left")
    return met.withColumn("header", F.coalesce("__own", "__carried")).where(F.col("header").isNotNull()).select(*lines.columns, "header")


def netflix(lines: DataFrame, order: str = "line_no", group: str | None = "file") -> DataFrame:
    """`movie:` headers with `user,rating,date` lines below: (row user, col movie, value, date)."""
    p = F.split(F.col(LINE), ",")
    body = headed(lines, order, r"^\d+:\s*$", group).where(F.size(p) == 3)
    movie = F.regexp_extract("header", r"^(\d+):", 1).cast("int")
    return body.select(p[0].try_cast("int").alias("row"), movie.alias("col"), p[1].try_cast("double").alias("value"), F.trim(p[2]).alias("date")).dropna()


def netflix_probe(lines: DataFrame, order: str = "line_no", group: str | None = None) -> DataFrame:
    """`movie:` headers with one user per line below: (row, col)."""
    body = headed(lines, order, r"^\d+:\s*$", group)
    return body.select(F.trim(LINE).try_cast("int").alias("row"), F.regexp_extract("header", r"^(\d+):", 1).cast("int").alias("col")).dropna()


def probe_split(ratings: DataFrame, probe: DataFrame, keys: tuple[str, ...] = ("row", "col")) -> tuple[DataFrame, DataFrame]:
    """(train, test): ratings not in, and in, the probe set."""
    return ratings.join(probe, list(keys), "left_anti"), ratings.join(probe, list(keys), "left_semi")


def yahoo_music(lines: DataFrame, order: str = "line_no", group: str | None = None, most: int = 10_000) -> DataFrame:
    """`user|n` headers with `item <tab> rating <tab> day <tab> time` below: (row, col, value, day); users with n >= most are dropped."""
    head = F.split("header", "\\|")
    p = F.split(F.col(LINE), "\t")
    body = headed(lines, order, r"^\d+\|\d+\s*$", group).where((F.size(p) >= 3) & (F.trim(head[1]).cast("int") < most))
    return body.select(head[0].cast("int").alias("row"), p[0].try_cast("int").alias("col"), p[1].try_cast("double").alias("value"), p[2].try_cast("int").alias("day")).dropna()


def documents(lines: DataFrame) -> DataFrame:
    """`word:count ...` lines to (words, counts); malformed tokens are dropped, blank lines give empty arrays."""
    good = F.filter(_tokens(F.coalesce(F.col(LINE), F.lit(""))), lambda t: _pair_index(t).isNotNull() & _pair_value(t).isNotNull())
    return lines.select(*(c for c in lines.columns if c != LINE), F.transform(good, _pair_index).alias("words"), F.transform(good, lambda t: _pair_value(t).cast("int")).alias("counts"))


def with_unit_gamma(docs: DataFrame, topics: int) -> DataFrame:
    return docs.withColumn("gamma", F.array_repeat(F.lit(1.0), topics))


def with_random_gamma(docs: DataFrame, topics: int, seed: int = 0, key: str = "doc_id") -> DataFrame:
    """Gamma(100, 1/100) starts, nearly 1, from a generator seeded by the document, not by the partition."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa
    from quorix.session import ship_package

    ship_package(docs.sparkSession)
    at = docs.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [np.random.default_rng([seed, abs(int(i or 0))]).gamma(100.0, 0.01, topics).tolist() for i in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, pa.list_(pa.float64()))], names=[*b.schema.names, "gamma"])

    schema = st.StructType([*docs.schema.fields, st.StructField("gamma", st.ArrayType(st.DoubleType()))])
    return docs.mapInArrow(run, schema)


def docword(lines: DataFrame) -> DataFrame:
    """UCI `doc word count` lines, 1-based; header lines (fewer fields) are dropped. (doc, word, count), 0-based."""
    p = _tokens(F.col(LINE))
    return lines.where(F.size(p) == 3).select((p[0].try_cast("int") - 1).alias("doc"), (p[1].try_cast("int") - 1).alias("word"), p[2].try_cast("int").alias("count")).dropna()


def bag_of_words_lines(counts: DataFrame) -> DataFrame:
    """(doc, line `word:count ...`) of (doc, word, count), words ascending."""
    rows = counts.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("word", "count"))).alias("w"))
    return rows.select("doc", F.array_join(F.transform("w", lambda e: F.concat_ws(":", e["word"], e["count"])), " ").alias("line"))


def token_table(lines: DataFrame) -> DataFrame:
    """`id <tab> t|t|t` to (id, tokens)."""
    p = F.split(F.col(LINE), "\t")
    return lines.where(F.size(p) == 2).select(p[0].try_cast("int").alias("id"), F.transform(F.split(p[1], "\\|"), lambda t: t.try_cast("int")).alias("tokens")).dropna(subset=["id"])


def int_table(lines: DataFrame, names: tuple[str, ...], drop: tuple[int, ...] = ()) -> DataFrame:
    """Tab-separated integers named in order, skipping the fields at positions `drop` (profiles, click logs)."""
    p = F.split(F.col(LINE), "\t")
    kept = [i for i in range(len(names) + len(drop)) if i not in drop]
    return lines.where(F.size(p) >= len(names) + len(drop)).select(*(p[i].try_cast("int").alias(n) for i, n in zip(kept, names))).dropna()


#: Columns of the click log; the third field of the file is not used.
CTR_COLUMNS = ("clicks", "impressions", "ad", "advertiser", "depth", "position", "query", "keyword", "title", "description", "user")


def click_log(lines: DataFrame) -> DataFrame:
    return int_table(lines, CTR_COLUMNS, drop=(2,))
