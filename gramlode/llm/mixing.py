"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Shares of the whole are given by weight. A source whose share exceeds max_epochs times its size is clamped there, and
what it leaves goes to the others by weight until no share exceeds its clamp. That fixed point is read off in closed
form: with sources ordered by size over weight, the clamped ones are a prefix. Each document is then taken
floor(target / size of source) times, and a seeded choice of documents once more: those whose hash is below the point
where the running size over hash order reaches the fractional part. That point is found by two histogram levels of
4,096 hash ranges each, so no source is ever sorted or held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, checked, cut, table

MAX_EPOCHS = 3
CYCLE = (5, 2, 1)
SEED = 17


def draw(id_col: Column, seed: int = SEED) -> Column:
    """Seeded number of 24 bits for an id; rows of the same id share it."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: source, source_size, weight (one row each). Adds target (double), the water-filled share of all sizes.

    Ordering the sources takes one task; it gets one row for each source, never rows of documents. A source of size 0
    gets target 0; with no sizes at all every target is 0.
    """
    w = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = w.rowsBetween(W.unboundedPreceding, -1)
    s = sizes.withColumns({
        "_below": F.coalesce(F.sum(max_epochs * F.col("source_size")).over(upto), F.lit(0).cast("long")),
        "_rest": F.sum("weight").over(W.partitionBy()) - F.coalesce(F.sum("weight").over(upto), F.lit(0).cast("long")),
        "_all": F.sum("source_size").over(W.partitionBy()),
    })
    # a source stays free if the level it would get, all before it clamped, is within its clamp; so do all after it
    share = (F.col("_all") - F.col("_below")).cast("double") / F.col("_rest").cast("double")
    free = share * F.col("weight") <= (max_epochs * F.col("source_size")).cast("double")
    s = s.withColumn("_level", F.min(F.when(free, F.struct(F.col("_below"), share.alias("v")))).over(W.partitionBy()))
    clamp = (max_epochs * F.col("source_size")).cast("double")
    return s.withColumn("target", F.least(clamp, F.coalesce(F.col("_level.v") * F.col("weight"), clamp))).drop("_below", "_rest", "_all", "_level")


def weights(sizes: DataFrame, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """Weights dealt to the sources in code point order, null last, over and over."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = F.element_at(F.array(*[F.lit(c).cast("long") for c in cycle]), (rank % len(cycle)) + 1)
    return sizes.withColumn("weight", pick)


def _edge(h: DataFrame, need: Column, source_cols: list[str], at: str) -> DataFrame:
    """The first range of each source in which the running size reaches the need; what is still needed within it."""
    w = W.partitionBy(*source_cols).orderBy(at)
    run = h.withColumn("_run", F.sum("_n").over(w)).withColumn("_need", need)
    edge = run.where((F.col("_run") >= F.col("_need")) & (F.col("_run") - F.col("_n") < F.col("_need")))
    return edge.withColumn("_need", F.col("_need") - (F.col("_run") - F.col("_n"))).drop("_run", "_n")


def plan(spark: SparkSession, sized: DataFrame, cycle: tuple[int, ...] = CYCLE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sized: source, size, _u (the draw). One row for each source: source_size, target, whole, and the cut of the draw."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = targets(weights(sums, cycle), max_epochs)
    t = t.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    t = cut(spark, t.withColumn("_need0", F.round(F.col("target") - (F.col("whole") * F.col("source_size")).cast("double")).cast("long")))
    key = t.select(F.col("source").alias("_s"), "_need0")
    fine = sized.groupBy("source", F.shiftright("_u", 12).alias("_hi"), F.col("_u").bitwiseAND(4095).alias("_lo")).agg(F.sum("size").alias("_n"))
    coarse = fine.groupBy("source", "_hi").agg(F.sum("_n").alias("_n"))
    first = _edge(coarse.join(key, F.col("source").eqNullSafe(F.col("_s"))), F.col("_need0"), ["source"], "_hi").select(F.col("source").alias("_s1"), F.col("_hi").alias("_h1"), "_need")
    second = fine.join(first, F.col("source").eqNullSafe(F.col("_s1")) & (F.col("_hi") == F.col("_h1")))
    w = W.partitionBy("source").orderBy("_lo")
    second = second.withColumn("_run", F.sum("_n").over(w))
    # of the last range all or nothing is taken, whichever comes nearer
    taken = F.when(2 * (F.col("_need") - (F.col("_run") - F.col("_n"))) >= F.col("_n"), F.col("_lo") + 1).otherwise(F.col("_lo"))
    ends = second.where((F.col("_run") >= F.col("_need")) & (F.col("_run") - F.col("_n") < F.col("_need")))
    ends = ends.select(F.col("source").alias("_s2"), (F.col("_h1") * 4096 + taken).alias("cut"))
    out = t.join(ends, F.col("source").eqNullSafe(F.col("_s2")), "left")
    return out.select("source", "source_size", "weight", "target", "whole", F.coalesce("cut", F.lit(0).cast("long")).alias("cut"))


def mix(spark: SparkSession, docs: DataFrame, cycle: tuple[int, ...] = CYCLE, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, source) with _mix: struct of size, source_size, target and copies (how often the mix takes the
    row).

    A null text has size 0. Null sources form one source, ordered last. Rows of one doc_id and source are taken alike.
    A document is taken at most max_epochs times. Texts of any length count whole. Rows travel as one struct, so extra
    columns may have any name but _mix. An empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", size.alias("size"), draw(F.col("doc_id"), seed).alias("_u"))
    sized = cut(spark, d.select("source", "size", "_u"))
    p = checked(cut(spark, plan(spark, sized, cycle, max_epochs))).select(F.col("source").alias("_s"), "source_size", "target", "whole", "cut")
    j = d.join(p, F.col("source").eqNullSafe(F.col("_s")), "left")
    copies = F.least(F.col("whole") + (F.col("_u") < F.col("cut")).cast("long"), F.lit(max_epochs).cast("long"))
    return j.select("row.*", F.struct("size", "source_size", "target", copies.alias("copies")).alias("_mix"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns of the input."""
    taken = mixed.where(F.col("_mix.copies") > 0).withColumn("_mix", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix.copies"))))
    return taken.drop("_mix")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return m.select("doc_id", "_mix.size", "_mix.source_size", "_mix.target", (F.col("_mix.size") * F.col("_mix.copies")).alias("taken"), "_mix.copies")


def _sql() -> str:
    picks = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(CYCLE))
    return rf"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
 ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 6))::BIGINT AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(CYCLE)} {picks} END AS weight FROM s),
b AS (SELECT *, (coalesce(sum({MAX_EPOCHS} * source_size) OVER o, 0))::BIGINT AS below, (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::BIGINT AS rest, (sum(source_size) OVER ())::BIGINT AS total
 FROM w WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min((total - below)::DOUBLE / rest, below) AS v FROM b WHERE (total - below)::DOUBLE / rest * weight <= ({MAX_EPOCHS} * source_size)::DOUBLE),
t AS (SELECT source, source_size, least(({MAX_EPOCHS} * source_size)::DOUBLE, coalesce(v * weight, ({MAX_EPOCHS} * source_size)::DOUBLE)) AS target FROM b, v),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole, round(target - (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size)::DOUBLE)::BIGINT AS need FROM t),
g AS (SELECT source, u, sum(size)::BIGINT AS n FROM d GROUP BY source, u),
r AS (SELECT *, (sum(n) OVER (PARTITION BY source ORDER BY u))::BIGINT AS run FROM g),
c AS (SELECT r.source, CASE WHEN 2 * (need - (run - n)) >= n THEN u + 1 ELSE u END AS cut FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source WHERE run >= need AND run - n < need),
e AS (SELECT p.*, coalesce(cut, 0) AS cut FROM p LEFT JOIN c ON p.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target, size * least(whole + (u < cut)::BIGINT, {MAX_EPOCHS}) AS taken, least(whole + (u < cut)::BIGINT, {MAX_EPOCHS})::BIGINT AS copies
FROM d LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source"""


SQL = _sql()
