"""Texts that lost their end to a field limit or a broken transfer.

Everything is Spark SQL. Word trigrams are counted inside and at ends over the whole corpus; a text whose
final trigram is frequent inside and almost never terminal was cut. Words that are cut themselves form
trigrams that occur nowhere else, so a rare trigram backs off: to its context of two words, to the classes
of its three words (JSON notebooks) and to its last word. In Markdown and scripts an end is the end of a
line; a JSON notebook is one sequence of words whose only end is the end of the text. Every text is asked.

Trigrams can't see a cut that falls on a place where a line may end. For texts that they leave open, other
evidence is added, and named in the result: a JSON document that isn't closed, a Markdown code block without
its closing fence, a length at which far more texts of a source end than its other lengths let expect (a
field limit, in characters or bytes), an odd base64 length, an open bracket in the last line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quorix.llm.bitfilter import BitFilter
from quorix.session import cut, snapshot

#: A final trigram needs so many occurrences to be judged by itself, a final context so many.
LEAST_SEEN = 5
#: It is cut inside a line if at most this share of the occurrences ends a line.
MOST_ENDS = 0.05
#: A final word alone, or the classes of the final words, are asked where trigram and context are rare.
LEAST_WORD_SEEN = 20
#: A field limit: at least so many different texts of a source with exactly this length ...
LIMIT_TEXTS = 3
#: ... which are at least this share of the source's texts ...
LIMIT_SHARE = 0.005
#: ... and at least so many times as many as its neighbourhood of lengths lets expect.
LIMIT_FACTOR = 20.0
#: A UTF-8 text cut at a byte limit may end up to so many bytes before it.
UTF8_SLACK = 3

# White space and control characters that may be missing at the end without making a text truncated.
_BLANK = "concat(' ', char(9), char(10), char(11), char(12), char(13), char(0), char(160), '\u3000', '\ufeff')"
# Digits are one class, so that counts of rows or cells don't make words rare.
_DIGITS = "[0-9]+(?:[.,][0-9]+)*"
# A JSON notebook as one line: escaped and real line ends and commas separate words.
_FLAT = r"translate(replace({text}, '\\n', ' '), concat(char(10), char(13), char(9), ','), '    ')"


def _words(line: str) -> str:
    """The words of a line, as SQL."""
    return rf"split(trim(concat(' ', char(9), char(13)), {line}), '[ \\t\\r]+')"


def _keys(w: str, i: str, whole: str) -> tuple[str, str, str, str]:
    """Trigram, context of two words, single word and classes of the three words at 0-based position `i` of a word
    array, hashed, as SQL. A word's class is its last character; only whole texts (JSON) have the last key."""
    back = [f"coalesce(get({w}, {i} - {d}), '^')" for d in (2, 1)]
    return (
        f"xxhash64({back[0]}, {back[1]}, get({w}, {i}), {whole})",
        f"xxhash64({back[0]}, {back[1]}, 1, {whole})",
        f"xxhash64(get({w}, {i}), 2, {whole})",
        f"CASE WHEN {whole} THEN xxhash64(right({back[0]}, 1), right({back[1]}, 1), right(get({w}, {i}), 1), 3) END",
    )


_KEY_NAMES = ("trigram_key", "context_key", "word_key", "class_key")


def _sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """A query over DataFrames, named in the text as $name; it is analysed at once, so the views don't stay."""
    views = {}
    for name, df in frames.items():
        views[name] = f"quorix_trunc_{name}_{id(df)}"
        df.createOrReplaceTempView(views[name])
        text = text.replace(f"${name}", views[name])
    out = spark.sql(text)
    for view in views.values():
        spark.catalog.dropTempView(view)
    return out


def text_ends(df: DataFrame) -> DataFrame:
    """One row per non-blank text: lengths, final words and structural evidence, but not the text itself."""
    return _sql(
        df.sparkSession,
        rf"""
WITH t AS (
  -- one-element lateral views keep the optimizer from repeating these expressions in each place of use
  SELECT doc_id, source, fmt, coalesce(fmt = 'ipynb', false) AS whole, text, body, last_line FROM $src
  LATERAL VIEW explode(array(rtrim({_BLANK}, text))) AS body
  LATERAL VIEW explode(array(CASE WHEN fmt = 'ipynb' THEN '' ELSE substring_index(body, char(10), -1) END)) AS last_line
  WHERE text IS NOT NULL
), e AS (
  SELECT doc_id, source, fmt, whole, length(text) AS chars, octet_length(text) AS bytes, xxhash64(text) AS text_hash,
    right(text, 1) IN (char(10), char(13)) AS line_end,
    last_line, CASE WHEN whole THEN {_FLAT.format(text="body")} ELSE last_line END AS unit,
    -- a whole document closes its object and parses; notebooks may hold the non-standard numbers NaN and Infinity
    whole AND (right(body, 1) <> '}}' OR CASE WHEN try_parse_json(text) IS NOT NULL THEN false
      ELSE try_parse_json(regexp_replace(regexp_replace(text, '-?\\b(NaN|Infinity)\\b', 'null'), '[\\x00-\\x1f]', ' ')) IS NULL END) AS json_open,
    CASE WHEN fmt = 'md' THEN (length(text) + 1 - length(replace(concat(char(10), text), concat(char(10), '```'), char(10)))) DIV 3 ELSE 0 END AS fences
  FROM t WHERE body <> ''
)
SELECT e.*, words FROM e LATERAL VIEW explode(array({_words(f"regexp_replace(unit, '{_DIGITS}', '0')")})) AS words
""",
        src=df.select("doc_id", "source", "fmt", F.col("text").cast("string").alias("text")),
    )


def end_counts(df: DataFrame, ends: DataFrame) -> DataFrame:
    """(key, inside, at_end): of each final trigram, context, word or class, how often it goes on and how often it ends a line (JSON: a text).

    All words of all texts are counted. A bit filter drops most keys that end no text before the partial
    aggregation; the exact semi join comes after it.
    """
    keys = ends.select(F.explode(F.array(*_KEY_NAMES)).alias("key"))
    known = BitFilter.of(keys, ends.count() * len(_KEY_NAMES))
    return _sql(
        df.sparkSession,
        rf"""
WITH k AS (
  SELECT DISTINCT key FROM (SELECT explode(array({", ".join(_KEY_NAMES)})) AS key FROM $wanted) WHERE key IS NOT NULL
), l AS (
  SELECT whole, CASE WHEN whole THEN array({_FLAT.format(text="body")}) ELSE split(body, '\\n') END AS lines
  FROM (SELECT coalesce(fmt = 'ipynb', false) AS whole, regexp_replace(CASE WHEN fmt = 'ipynb' THEN rtrim({_BLANK}, text) ELSE text END, '{_DIGITS}', '0') AS body FROM $src WHERE text IS NOT NULL)
), w AS (
  SELECT whole, {_words("line")} AS w, NOT whole AND at = size(lines) - 1 AS unended FROM l LATERAL VIEW posexplode(lines) AS at, line WHERE line <> ''
), p AS (
  -- where a text stops without a line end, its last word neither goes on nor ends: that is what is asked
  SELECT whole, w, i, i = size(w) - 1 AS fin FROM w LATERAL VIEW posexplode(w) AS i, word WHERE NOT (unended AND i = size(w) - 1)
), g AS (
  SELECT explode(array({", ".join(_keys("w", "i", "whole"))})) AS key, fin FROM p
)
SELECT c.key, inside, at_end FROM (
  SELECT key, count_if(NOT fin) AS inside, count_if(fin) AS at_end FROM g CROSS JOIN (SELECT /*+ BROADCAST(b) */ __bits FROM $bits b)
  WHERE {known.test("key")} GROUP BY key
) c LEFT SEMI JOIN k ON c.key = k.key
""",
        src=df.select("fmt", F.col("text").cast("string").alias("text")),
        wanted=ends,
        bits=known.bits,
    )


def field_limits(ends: DataFrame) -> DataFrame:
    """(source, unit, length, n): lengths in characters or bytes at which texts of a source were cut.

    Copies count once. The expectation comes from the texts within about 7 % of the length. Where the same
    length stands out in both units, the unit with more texts has the limit; texts at a limit in
    characters don't count for limits in bytes.
    """
    s = ends.sparkSession
    # a histogram of lengths, materialised once: everything below reads this small table
    once = ends.where("source IS NOT NULL").groupBy("source", "text_hash").agg(F.max("chars").alias("chars"), F.max("bytes").alias("bytes"))
    lengths = snapshot(once.groupBy("source", "chars", "bytes").agg(F.count(F.lit(1)).alias("n")))

    def spikes(texts: DataFrame, unit: str) -> DataFrame:
        return _sql(
            s,
            f"""
WITH h AS (
  SELECT source, {unit} AS length, CAST(floor(ln({unit}) / ln(1.05)) AS INT) AS band, sum(n) AS n FROM $texts WHERE {unit} >= 64 GROUP BY source, {unit}
), b AS (
  SELECT source, band, sum(n) AS n_band FROM h GROUP BY source, band
), c AS (
  SELECT source, band + shift AS band, sum(n_band) AS n_near FROM b LATERAL VIEW explode(array(-1, 0, 1)) AS shift GROUP BY 1, 2
), a AS (
  SELECT source, sum(n_band) AS n_all FROM b GROUP BY source
)
SELECT h.source, h.length, h.n FROM h JOIN c ON h.source = c.source AND h.band = c.band JOIN a ON h.source = a.source
WHERE h.n >= {LIMIT_TEXTS} AND h.n >= {LIMIT_SHARE} * n_all AND h.n >= {LIMIT_FACTOR} * (n_near - h.n) / (0.15 * h.length)""",
            texts=texts,
        )

    in_bytes = spikes(lengths, "bytes").select("source", "length", F.col("n").alias("n_bytes"))
    in_chars = spikes(lengths, "chars").join(in_bytes, ["source", "length"], "left").where("n >= coalesce(n_bytes, 0)")
    in_chars = snapshot(in_chars.select("source", F.lit("chars").alias("unit"), "length", "n"))
    rest = lengths.join(in_chars.select("source", F.col("length").alias("chars")), ["source", "chars"], "left_anti")
    return snapshot(in_chars.unionByName(spikes(rest, "bytes").select("source", F.lit("bytes").alias("unit"), "length", "n")))


def detect_truncated(df: DataFrame) -> DataFrame:
    """(doc_id, source, evidence, truncated) of every row of `df` (doc_id, text, source, fmt).

    evidence: 'trigram', 'json', 'fence', 'limit', 'base64' or 'bracket', the first that applies, else null.
    Defined cases: null, empty and blank texts are never truncated, nor are texts that only lack white
    space at the end; a null source may have any source's field limit; an unknown or null fmt is judged by its words;
    repeated rows are judged alike; an empty table gives an empty result; other columns are ignored.
    """
    s = df.sparkSession
    ends = cut(
        text_ends(df).selectExpr(
            "doc_id", "source", "fmt", "whole", "chars", "bytes", "text_hash", "line_end", "right(last_line, 1) AS last_char", "json_open", "fences",
            # a heading of two words or a web address; a list item of two words. In the percent format a Markdown
            # line starts with one more '#', which cell markers and outputs share
            r"last_line RLIKE concat(CASE WHEN fmt = 'percent' THEN '^# ' ELSE '^' END, '#+ [^ ]+ [^ ]+\\s*$') OR last_line RLIKE '://[^ ]*\\s*$' AS headed",
            r"last_line RLIKE concat(CASE WHEN fmt = 'percent' THEN '^# ' ELSE '^' END, ' *- [^ ]+ [^ ]+\\s*$') AS item",
            # a closed string, as at the end of an error line
            r"last_line RLIKE '(^|[ (=,:])([\\x22\\x27])[^\\x22\\x27]*\\2\\s*$' AS quoted",
            r"last_line RLIKE '^[# ]*([-=*_~])\\1{9,}\\s*$' AS ruled",
            "regexp_extract(last_line, '(?:^|[^A-Za-z0-9+/=])([A-Za-z0-9+/=]{60,}+)$', 1) AS code64",
            "length(translate(last_line, '([{', '')) < length(translate(last_line, ')]}', '')) AS bracket_open",
            *(f"{key} AS {name}" for key, name in zip(_keys("words", "(size(words) - 1)", "whole"), _KEY_NAMES)),
        )
    )
    judged = _sql(
        s,
        rf"""
WITH lim AS (
  SELECT source, collect_set(CASE WHEN unit = 'chars' THEN length END) AS char_limits, collect_set(CASE WHEN unit = 'bytes' THEN length END) AS byte_limits
  FROM $limits GROUP BY source
  -- a text of unknown source may have met any source's limit
  UNION ALL SELECT NULL, collect_set(CASE WHEN unit = 'chars' THEN length END), collect_set(CASE WHEN unit = 'bytes' THEN length END) FROM $limits
), residue AS (
  SELECT mode(length(code64) % 4) AS usual FROM $ends WHERE code64 <> '' AND line_end
), j AS (
  SELECT e.*, coalesce(array_contains(char_limits, chars), false)
      OR coalesce(exists(byte_limits, x -> bytes = x OR (chars < bytes AND NOT line_end AND bytes BETWEEN x - {UTF8_SLACK} AND x)), false) AS at_limit,
    -- the end of a whole text is counted, but mustn't speak for itself
    {", ".join(f"coalesce({a}.inside, 0) AS {a}_in, greatest(coalesce({a}.at_end, 0) - CAST(whole AS INT), 0) AS {a}_end" for a in "txuk")}, usual
  FROM $ends e LEFT JOIN lim ON e.source <=> lim.source
  LEFT JOIN $counts t ON e.trigram_key = t.key LEFT JOIN $counts x ON e.context_key = x.key LEFT JOIN $counts u ON e.word_key = u.key LEFT JOIN $counts k ON e.class_key = k.key
  CROSS JOIN residue
), v AS (
  SELECT *,
    CASE WHEN t_in + t_end >= {LEAST_SEEN} THEN t_end <= {MOST_ENDS} * (t_in + t_end)
         WHEN x_in + x_end >= {LEAST_SEEN} THEN x_end <= {MOST_ENDS} * (x_in + x_end)
           -- part of a word: hardly seen as a word, in a context that is well known
           OR (u_in + u_end < {LEAST_SEEN} AND x_in + x_end >= {LEAST_WORD_SEEN})
         WHEN k_in + k_end >= {LEAST_WORD_SEEN} THEN k_end <= {MOST_ENDS} * (k_in + k_end)
         ELSE u_in + u_end >= {LEAST_WORD_SEEN} AND u_end <= {MOST_ENDS} * (u_in + u_end) END AS goes_on,
    -- the end of a sentence, a closed bracket or span, or an emoji; rules are seen as a whole line
    quoted OR last_char RLIKE '[.?!;。？！：…)\\]}}`*]' OR last_char RLIKE '[^\\x00-\\x7f\\p{{L}}\\p{{N}}]' AS closed_end
  FROM j
)
SELECT doc_id, source, CASE
    WHEN whole THEN CASE WHEN goes_on THEN 'trigram' WHEN json_open THEN 'json' END
    -- a list item ends with a word that is known; names in headings may stand nowhere else
    WHEN NOT line_end AND code64 = '' AND goes_on AND NOT (closed_end OR headed OR ruled OR (item AND u_in + u_end >= {LEAST_SEEN})) THEN 'trigram'
    WHEN fences % 2 = 1 THEN 'fence'
    WHEN at_limit AND NOT ruled THEN 'limit'
    WHEN line_end THEN NULL
    WHEN code64 <> '' THEN CASE WHEN length(code64) % 4 <> usual THEN 'base64' END
    WHEN bracket_open THEN 'bracket'
  END AS evidence
FROM v
""",
        ends=ends,
        counts=cut(end_counts(df, ends)),
        limits=field_limits(ends),
    )
    blank = df.where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\s\x00 　﻿]")).select("doc_id", "source", F.lit(None).cast("string").alias("evidence"))
    return judged.unionByName(blank).withColumn("truncated", F.col("evidence").isNotNull())


def truncation_rates(judged: DataFrame) -> DataFrame:
    """(source, n_docs, n_truncated, rate) per source, null sources as one group."""
    n = F.count_if("truncated")
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), n.alias("n_truncated"), (n / F.count(F.lit(1))).alias("rate"))
