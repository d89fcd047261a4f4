"""Quality rules with thresholds that adapt to each language and source.

Every document gets integer rule measures. Their distribution is kept as a log-linear histogram for each language and
source: a quantile sketch whose buckets are exact below 64 and keep six leading bits above, so a quantile is at most
1/32 too low, and whose merge is the sum of counts, in any order. Only rows that pass the base rule are sketched.
Thresholds are fences read from the sketch: a high quantile and a multiple of its distance from a lower one. Groups with
few documents take the merged sketch of their language, and small languages that of the whole corpus. The thresholds
are then joined back to the measures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE, checked, cut, words

MEASURES = ("word_len", "symbol_rate", "dup_line_rate", "repeat_rate")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """One row for each row of docs: id, groups, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words.

    Columns of other names are not read, whatever they are. A null text counts as empty. Texts of any length are
    measured whole. Windows of three words are first matched by 33 hash bits packed with their place in
    one sortable long, and then compared as text, so the count is exact.
    """
    d = docs.select(F.col(id_col), *groups, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    d = d.withColumn("_w", words(F.col("_t")))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(rf"[^{SPACE}]"))
    d = d.withColumn("_l", lines)
    low = F.lit((1 << 31) - 1).cast("long")
    windows = F.transform(
        F.slice("_w", F.lit(1), F.greatest(F.size("_w") - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")),
    )
    d = d.select(
        id_col, *groups, "_w",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", rf"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.sort_array(windows).alias("_p"),
    )
    top = lambda x: F.shiftright(x, 31)
    near = F.filter("_p", lambda x, j: (top(x) == top(F.get("_p", j + 1))) | F.coalesce(top(x) == top(F.get("_p", j - 1)), F.lit(False)))
    d = d.withColumn("_c", F.transform(near, lambda x: x.bitwiseAND(low).cast("int")))
    as_text = F.transform("_c", lambda i: F.struct(F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("g"), i.alias("i")))
    d = d.withColumn("_g", F.sort_array(as_text)).drop("_w", "_p", "_c")
    same = F.filter("_g", lambda s, j: (s.g == F.get("_g", j + 1).g) | F.coalesce(s.g == F.get("_g", j - 1).g, F.lit(False)))
    d = d.withColumn("_i", F.sort_array(F.transform(same, lambda s: s.i))).drop("_g")
    held = F.transform("_i", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_i", k + 1) - x, F.lit(3))))
    total = F.aggregate(held, F.lit(0).cast("long"), lambda a, x: a + x)
    return d.withColumn("n_repeat_words", total).drop("_i")


def rates(d: DataFrame) -> DataFrame:
    """The measures that get adaptive thresholds, as integers; 0 where a text has no word or line."""
    return d.withColumns({
        "word_len": F.expr("div(100 * word_chars, greatest(n_words, 1L))"),
        "symbol_rate": F.expr("div(1000 * n_symbols, greatest(n_words, 1L))"),
        "dup_line_rate": F.expr("div(1000 * n_dup_lines, greatest(n_lines, 1L))"),
        "repeat_rate": F.expr("div(1000 * n_repeat_words, greatest(n_words, 1L))"),
    })


def bucket(v: Column) -> Column:
    """Lower end of the sketch bucket of a value of 0 or more."""
    e = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, e), e)


def sketch(d: DataFrame, groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The mergeable sketch of all rows of d: groups, measure, bucket, n."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES])
    rows = d.select(*groups, F.explode(pairs).alias("x")).select(*groups, "x.measure", "x.bucket")
    return rows.groupBy(*groups, "measure", "bucket").agg(F.count("*").alias("n"))


def merge(s: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    return s.groupBy(*groups, "measure", "bucket").agg(F.sum("n").alias("n"))


#: Lower and higher quantile of each measure in percent, and how many half distances of the two the fence stands beyond
#: the higher one. The bulk sets the limits of word lengths and symbols, the tail those of rates that are mostly 0.
FENCE = {"word_len": (25, 75, 8), "symbol_rate": (25, 75, 8), "dup_line_rate": (50, 99, 1), "repeat_rate": (50, 99, 2)}
#: The least distance, so that equal quantiles still leave room for rounding; documents of a group with its own fences.
UNIT, MIN_DOCS = 5, 40


def quantiles(s: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """groups, and for each measure the two quantiles of its fence; docs, how many rows the sketch has seen."""
    w = W.partitionBy(*groups, "measure")
    q = s.withColumn("_c", F.sum("n").over(w.orderBy("bucket"))).withColumn("_n", F.sum("n").over(w))
    at = lambda m, k: F.min(F.when((F.col("measure") == m) & (100 * F.col("_c") >= k * F.col("_n")), F.col("bucket")))
    return q.groupBy(*groups).agg(F.max("_n").alias("docs"), *[at(m, k).alias(f"{m}_q{k}") for m in MEASURES for k in FENCE[m][:2]])


def fences(s: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, and the highest (word_len: also the lowest) value of each measure that is kept."""
    own, by_lang, overall = quantiles(s, ("lang", "source")), quantiles(merge(s, ("lang",)), ("lang",)), quantiles(merge(s, ()), ())
    name = lambda q, p: q.select(*[F.col(c).alias(c if c in ("lang", "source") else f"{p}_{c}") for c in q.columns])
    own, by_lang, overall = name(own, "o"), name(by_lang, "l").withColumnRenamed("lang", "_lang"), name(overall, "a")
    # the last one is a single row
    t = own.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang"))).join(F.broadcast(overall), F.lit(True))
    pick = lambda c: F.when(F.col("o_docs") >= min_docs, F.col(f"o_{c}")).when(F.col("l_docs") >= min_docs, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))
    out = []
    for m in MEASURES:
        low, high, halves = FENCE[m]
        q0, q1 = pick(f"{m}_q{low}"), pick(f"{m}_q{high}")
        width = F.floor(halves * F.greatest(q1 - q0, F.lit(UNIT)) / 2).cast("long")
        out.append((q1 + width).alias(f"{m}_max"))
        if m == "word_len":
            out.append((q0 - width).alias(f"{m}_min"))
    return t.select("lang", "source", *out)


def quality(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang, source; further columns are ignored): measures and verdicts.

    Null or empty texts have no words and fail the base rule. Null languages and sources form groups of their own.
    Groups whose rows all fail the base rule have no fences; nothing of theirs is kept. Repeated rows each get their row;
    an empty table gives none.
    """
    d = measure(docs).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    d = cut(spark, rates(d))
    f = checked(cut(spark, fences(sketch(d.where(~F.col("base_failed")))))).select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[f"{m}_max" for m in MEASURES], "word_len_min")
    inside = F.col("word_len") >= F.col("word_len_min")
    for m in MEASURES:
        inside = inside & (F.col(m) <= F.col(f"{m}_max"))
    j = d.join(f, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    return j.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))).drop("_lang", "_source")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    q = quality(spark, table(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql_quartiles(name: str, src: str, groups: str) -> str:
    by = f"{groups}, " if groups else ""
    ats = ", ".join(f"min(bucket) FILTER (WHERE measure = '{m}' AND 100 * c >= {k} * t) AS {m}_q{k}" for m in MEASURES for k in FENCE[m][:2])
    return f"""{name}_s AS (SELECT {by}measure, bucket, sum(n) AS n FROM {src} GROUP BY {by}measure, bucket),
{name}_c AS (SELECT *, sum(n) OVER (PARTITION BY {by}measure ORDER BY bucket) AS c, sum(n) OVER (PARTITION BY {by}measure) AS t FROM {name}_s),
{name} AS (SELECT {by}max(t) AS docs, {ats} FROM {name}_c {"GROUP BY " + groups if groups else ""})"""


def _sql() -> str:
    pick = lambda c: f"CASE WHEN o.docs >= {MIN_DOCS} THEN o.{c} WHEN l.docs >= {MIN_DOCS} THEN l.{c} ELSE a.{c} END"
    q = lambda m, k: pick(f"{m}_q{FENCE[m][k]}")
    width = lambda m: f"({FENCE[m][2]} * greatest({q(m, 1)} - {q(m, 0)}, {UNIT})) // 2"
    tops = ", ".join(f"{q(m, 1)} + {width(m)} AS {m}_max" for m in MEASURES)
    inside = " AND ".join(f"r.{m} <= f.{m}_max" for m in MEASURES)
    explode = " UNION ALL ".join(
        f"SELECT lang, source, '{m}' AS measure, ({m} >> greatest(length(bin({m})) - 6, 0)) << greatest(length(bin({m})) - 6, 0) AS bucket FROM r WHERE NOT base_failed"
        for m in MEASURES
    )
    return rf"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT k, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT k, ws, unnest(range(1, greatest(len(ws) - 1, 1))) AS i FROM w)),
h AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g),
p AS (SELECT k, count(DISTINCT i + j) AS n FROM h, (SELECT unnest([0, 1, 2]) AS j) WHERE c > 1 GROUP BY k),
m AS (SELECT w.k, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
 length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words
 FROM w LEFT JOIN p ON w.k = p.k),
r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * word_chars // greatest(n_words, 1) AS word_len, 1000 * n_symbols // greatest(n_words, 1) AS symbol_rate,
 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_rate, 1000 * n_repeat_words // greatest(n_words, 1) AS repeat_rate FROM m),
x AS ({explode}),
s AS (SELECT lang, source, measure, bucket, count(*) AS n FROM x GROUP BY ALL),
{_sql_quartiles("o", "s", "lang, source")},
{_sql_quartiles("l", "s", "lang")},
{_sql_quartiles("a", "s", "")},
f AS (SELECT o.lang, o.source, {tops}, {q("word_len", 0)} - {width("word_len")} AS word_len_min FROM o JOIN l ON o.lang IS NOT DISTINCT FROM l.lang, a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, coalesce(NOT base_failed AND r.word_len >= f.word_len_min AND {inside}, false) AS kept
FROM r LEFT JOIN f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source"""


SQL = _sql()
