"""Result texts: reading logs of queries, and writing matches in their text forms.

Texts are built and parsed line by line as columns; a log's blocks are told apart by a running count of headers within
each file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """query, hit, nodes_examined of result logs: *name count, optional # N nodes examined, then one hit a line.

    A query without hits has one row with a null hit. Lines are numbered within each file by their place in it.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("f"), F.posexplode(F.split("value", "\n")).alias("line", "v"))
    rows = whole.where(F.trim("v") != "").withColumn("_block", F.sum(F.col("v").startswith("*").cast("int")).over(W.partitionBy("f").orderBy("line")))
    by = W.partitionBy("f", "_block")
    rows = rows.withColumns({
        "query": F.max(F.when(F.col("v").startswith("*"), F.regexp_extract("v", r"^\*(\S+)", 1))).over(by),
        "nodes_examined": F.max(F.regexp_extract("v", r"^# (\d+) nodes examined", 1).try_cast("long")).over(by),
        "hit": F.when(~F.col("v").rlike(r"^[*#]"), F.element_at(F.split(F.trim("v"), r"\s+"), 1)),
    })
    hits = rows.where("hit is not null").select("query", "hit", "nodes_examined")
    none = rows.groupBy("f", "_block").agg(F.first("query").alias("query"), F.count("hit").alias("n"), F.first("nodes_examined").alias("nodes_examined"))
    return hits.unionByName(none.where("n = 0").select("query", F.lit(None).cast("string").alias("hit"), "nodes_examined"))


def _ratio(a: str, n: str) -> Column:
    """Six decimals of the single-precision ratio; 0 where n is 0."""
    return F.when(F.col(n) == 0, F.lit("0")).otherwise(F.format_string("%.6f", (F.col(a) / F.col(n)).cast("float").cast("double")))


def lines(queries: DataFrame, matches: DataFrame, counts: bool = False, adjusted: bool = False, all_hits: bool = False, examined: DataFrame | None = None, backward: bool = False) -> DataFrame:
    """batch_ix, line_ix, line: the text of results.

    queries: batch_ix, name. matches: batch_ix, leaf, rank (order within the query), and with counts hits, n, with
    adjusted also adjusted_hits; with all_hits is_hit. A query's header counts its matches (of all hits: the passing
    ones). backward: each line starts with the query's name and there are no headers.
    """
    m = matches.join(queries.select("batch_ix", "name"), "batch_ix")
    text = F.col("leaf")
    if counts or all_hits:
        text = F.concat_ws(" ", text, F.concat_ws("/", F.col("hits").cast("string"), F.col("n").cast("string")), _ratio("hits", "n"))
    if adjusted:
        text = F.concat_ws(" ", text, F.concat_ws("/", F.col("adjusted_hits").cast("string"), F.col("n").cast("string")), _ratio("adjusted_hits", "n"))
    if all_hits:
        text = F.concat_ws(" ", F.col("name"), F.lit("vs"), text, F.when(F.col("is_hit"), F.lit("hit")))
    elif backward:
        text = F.concat_ws(" ", F.col("name"), text)
    body = m.select("batch_ix", (F.col("rank") + 1).cast("long").alias("line_ix"), text.alias("line"))
    if backward:
        return body
    passing = F.count(F.when(F.col("is_hit"), 1)) if all_hits else F.count("leaf")
    heads = queries.select("batch_ix", "name").join(matches.groupBy("batch_ix").agg(passing.alias("c")), "batch_ix", "left")
    out = heads.select("batch_ix", F.lit(0).cast("long").alias("line_ix"), F.concat(F.lit("*"), "name", F.lit(" "), F.coalesce("c", F.lit(0)).cast("string")).alias("line")).unionByName(body)
    if examined is not None:
        out = out.unionByName(examined.select("batch_ix", F.lit(1).cast("long").alias("line_ix"), F.concat(F.lit("# "), F.col("nodes_examined").cast("string"), F.lit(" nodes examined")).alias("line")))
    return out


def kmer_count_lines(queries: DataFrame) -> DataFrame:
    """batch_ix, line: name and number of k-mers. queries: batch_ix, name, n."""
    return queries.select("batch_ix", F.concat_ws(" ", F.col("name"), F.col("n").cast("string")).alias("line"))


def presence_lines(presence: DataFrame) -> DataFrame:
    """line of each (filter_id, name, mer, present)."""
    return presence.select(F.concat_ws(" ", "filter_id", "name", "mer", F.when(F.col("present"), "present").otherwise("absent")).alias("line"))


def node_stat_lines(stats: DataFrame) -> DataFrame:
    """Tab-separated query, node, E/-, P/F/-, and local and total counts of passed, failed and unresolved k-mers; the
    counts of a node that was not examined are dashes. Without a column query the query's number stands for its name."""
    verdict = F.when(~F.col("examined"), "-").when(F.col("passed"), "P").when(F.col("failed"), "F").otherwise("-")
    numbers = [F.when(F.col("examined"), F.col(c).cast("string")).otherwise("-") for c in ("local_pass", "local_fail", "n_pass", "n_fail", "n_unresolved")]
    query = F.col("query") if "query" in stats.columns else F.col("batch_ix").cast("string")
    return stats.select(F.concat_ws("\t", query, F.col("node"), F.when(F.col("examined"), "E").otherwise("-"), verdict, *numbers).alias("line"))


def write_lines(lines_df: DataFrame, path: str) -> None:
    """Results as text, sorted by query and line over all part files."""
    lines_df.repartitionByRange("batch_ix", "line_ix").sortWithinPartitions("batch_ix", "line_ix").select("line").write.mode("overwrite").text(path)


def job_totals(spark: SparkSession, path: str, pattern: str, key_group: int = 1, value_group: int = 2) -> DataFrame:
    """key, n, total of a log: lines that match the pattern, their value summed by key (times, bytes or seconds)."""
    t = spark.read.text(path).where(F.col("value").rlike(pattern))
    v = F.regexp_extract("value", pattern, value_group).cast("double")
    return t.select(F.regexp_extract("value", pattern, key_group).alias("key"), v.alias("v")).groupBy("key").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
