"""Sequence files as DataFrames.

Large read files are cut by Spark at record marks, so plain files split and no order of lines is needed. Query files
are small and have rules that look back over lines; each is parsed whole, in parallel over files.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERY_SCHEMA = "batch_ix int, name string, seq string, threshold double"


def parse_queries(text: str, basename: str = "query") -> list[tuple[str, str]]:
    """(name, sequence) of FASTA or of one sequence a line; the first line that is not blank decides.

    Blank lines are skipped but numbered. Empty sequences are dropped. A record without a name, and every sequence of
    a file without headers, is named by the base name and its line number. A header after sequences without one is an
    error.
    """
    lines = [(i, x.strip()) for i, x in enumerate(text.split("\n"), 1) if x.strip()]
    if not lines:
        return []
    if not lines[0][1].startswith(">"):
        if late := next((i for i, x in lines if x.startswith(">")), None):
            raise ValueError(f"line {late}: a header in a file of bare sequences")
        return [(f"{basename}{i}", x) for i, x in lines]
    out: list[tuple[str, list[str]]] = []
    for i, x in lines:
        if x.startswith(">"):
            out.append((x[1:].strip() or f"{basename}{i}", []))
        else:
            out[-1][1].append(x)
    return [(name, "".join(seq)) for name, seq in out if any(seq)]


def query_basename(path: str) -> str:
    return re.sub(r"\.(fa|fasta)$", "", path.rsplit("/", 1)[-1]) or "query"


def split_threshold(spec: str, default: float) -> tuple[str, float]:
    """A path with an optional threshold of its own, as path=F or path:F."""
    from ..functions.numbers import probability

    for mark in ("=", ":"):
        path, found, tail = spec.rpartition(mark)
        if found and path:
            try:
                return path, probability(tail)
            except ValueError:
                continue
    return spec, default


def read_queries(spark: SparkSession, specs: Iterable[str], threshold: float = 0.7) -> DataFrame:
    """Queries of several files in the order given, each file with its own threshold or the general one.

    batch_ix counts the queries from 0 over all files. The files are small; their number bounds the driver's part.
    """
    files = [(n, *split_threshold(s, threshold)) for n, s in enumerate(specs)]
    if not files:
        return spark.createDataFrame([], QUERY_SCHEMA)
    texts = None
    for n, path, theta in files:
        one = spark.read.text(path, wholetext=True).select(F.lit(n).alias("f"), F.lit(query_basename(path)).alias("b"), F.lit(theta).alias("t"), F.col("value").alias("x"))
        texts = one if texts is None else texts.union(one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                q = parse_queries(r["x"], r["b"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["f"]] * len(q), pa.int32()), pa.array(range(len(q)), pa.int32()), pa.array([n for n, _ in q], pa.string()), pa.array([s for _, s in q], pa.string()), pa.array([r["t"]] * len(q), pa.float64())],
                    names=["f", "i", "name", "seq", "threshold"],
                )

    q = texts.mapInArrow(run, "f int, i int, name string, seq string, threshold double")
    before = q.groupBy("f").agg(F.count("*").alias("n"))
    base = before.alias("a").join(F.broadcast(before.alias("b")), F.col("b.f") < F.col("a.f"), "left").groupBy("a.f").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("base"))
    return q.join(F.broadcast(base), "f").select((F.col("base") + F.col("i")).cast("int").alias("batch_ix"), "name", "seq", "threshold")


def queries_from(df: DataFrame, name: str, seq: str, threshold: float = 0.7) -> DataFrame:
    """Queries of any DataFrame; batch_ix follows the order of names.

    Rows are ranged and numbered by part; the driver adds up one count for each part.
    """
    dealt = df.repartitionByRange(F.col(name)).sortWithinPartitions(name).withColumn("_at", F.monotonically_increasing_id()).persist()  # fixes the parts
    part, own = F.shiftright("_at", 33).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r.p: r.n for r in dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(p, 0)
    ix = own + F.get(F.lit(starts or [0]).cast("array<long>"), part)
    return dealt.select(ix.cast("int").alias("batch_ix"), F.col(name).cast("string").alias("name"), F.col(seq).alias("seq"), F.lit(threshold).alias("threshold"))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, name, seq of FASTA records, in no order; records with an empty sequence are dropped."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("path"), F.regexp_replace("value", "^>", "").alias("v"))
    head = F.regexp_extract("v", r"^[^\n]*", 0)
    seq = F.regexp_replace(F.substr(F.col("v"), F.length(head) + 1), r"\s+", "")
    return rows.select("path", F.trim(F.regexp_replace(head, "\r$", "")).alias("name"), seq.alias("seq")).where("seq <> ''")


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, seq of FASTQ records.

    Files are cut at line ends that a plus sign follows. The last line of a chunk is a sequence if the line before it
    is a header; the rest of a chunk is the quality line of the record before.
    """
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    rows = spark.read.option("lineSep", "\n+").text(path).select(F.input_file_name().alias("path"), lines.alias("l"))
    return rows.where(F.get("l", F.size("l") - 2).startswith("@")).select("path", F.element_at("l", -1).alias("seq")).where("seq <> ''")


def read_kmers(spark: SparkSession, path: str | list[str], k: int) -> DataFrame:
    """mer: first field of each line. Another length is an error; k-mers with other letters than A, C, G, T go.

    Repeated lines stay, as they count towards the size of a set.
    """
    mer = F.upper(F.element_at(F.split(F.trim("value"), r"\s+"), 1))
    rows = spark.read.text(path).where(F.trim("value") != "").select(mer.alias("mer"))
    right = F.when(F.length("mer") == k, F.col("mer")).otherwise(F.raise_error(F.concat(F.lit(f"not {k} letters long: "), F.col("mer"))))
    return rows.select(right.alias("mer")).where(F.col("mer").rlike("^[ACGT]+$"))


def read_build_list(spark: SparkSession, path: str) -> DataFrame:
    """out, files, kmersin: one filter a line, written as file.. [--kmersin] [--out=name]; # starts a comment."""
    words = F.split(F.trim(F.regexp_replace("value", "#.*", "")), r"\s+")
    rows = spark.read.text(path).select(words.alias("w")).where(F.get("w", F.lit(0)) != "")
    files = F.filter("w", lambda x: ~x.startswith("--"))
    out = F.regexp_replace(F.get(F.filter("w", lambda x: x.startswith("--out=")), F.lit(0)), "^--out=", "")
    stem = F.regexp_replace(F.element_at(F.split(F.get(files, F.lit(0)), "/"), -1), r"(\.gz)?$", "")
    name = F.coalesce(out, F.concat(F.regexp_replace(stem, r"\.(fa|fasta|fq|fastq|kmers)$", ""), F.lit(".bf")))
    return rows.select(name.alias("out"), files.alias("files"), F.array_contains("w", "--kmersin").alias("kmersin"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """name: one entry a line, blank lines skipped."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")


def subset_by_name(fasta: DataFrame, names: DataFrame, name: str = "name") -> DataFrame:
    """Records whose first header word is among the names."""
    first: Column = F.element_at(F.split(F.trim("name"), r"\s+"), 1)
    return fasta.join(names.select(F.col(name).alias("_wanted")).distinct(), first == F.col("_wanted"), "left_semi")
