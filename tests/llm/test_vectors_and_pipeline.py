import random

from pyspark.sql import functions as F

import corpus_pipeline
from gramlode.llm import vectors


def test_exact_top_k(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(9)]) for i in range(400)]
    rows += [(1000, None), (1050, [float("nan")] * 9), (1100, [None] * 9), (None, [0.5] * 9), (1150, [1.0] * 9), (7, rows[7][1]), (2000, [0.1] * 4), (2050, [1e30] * 9)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, q string")
    import math

    ok = [(i, [math.floor(256 * x) if abs(x) < 1e15 else (1 << 63) - 1 for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, v in ok:
        if q % 50 == 0:
            top = (1 << 63) - 1
            clip = lambda s: max(-top - 1, min(top, s))
            s = sorted((-clip(sum(a * b for a, b in zip(v, w, strict=False))), i) for i, w in ok if i != q)[:5]
            want |= {(q, k, i, -x) for k, (x, i) in enumerate(s, 1)}
    got = vectors.top_k(spark, df).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    again = vectors.top_k(spark, df, block=3)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in again.collect()} == want
    assert vectors.top_k(spark, df.limit(0)).isEmpty() and len(vectors.top_k(spark, df.where("vec_id < 3")).collect()) == 2


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    odd.select("doc_id", F.when(F.col("doc_id") == 301, 1).otherwise(0).alias("toxic")).where("doc_id is not null").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == odd.columns, name
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.count() == docs.count() and docs.where("text like '%0a1b2c3d%'").isEmpty()


def test_run_equals_its_stages_by_brute_force(spark, odd, tmp_path):
    """run() on a small corpus: toxic documents gone, one of each group of copies, secrets masked, sources mixed, ids of
    the library; each stage recomputed plainly from what the one before kept."""
    from collections import Counter

    from gramlode.llm import mixing, pieces, secrets

    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for i in range(160):
        text = " ".join(word() for _ in range(80))
        if i % 5 == 0:
            text += " you idiot and moron" * 4
        if i % 7 == 0:
            text += " token=" + "Zx9" * 8
        rows.append((i, text, "en", f"s{i % 3}"))
    rows += [(500 + i, rows[i][1], "en", "s1") for i in range(1, 40, 2)] + [(700, None, "en", "s0"), (701, "", None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs.select("doc_id", ((F.col("doc_id") % 500 % 5 == 0) & (F.col("doc_id") < 700)).cast("int").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    got = Counter((r.doc_id, r.n_pieces, tuple(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    enc, sp = secrets.encoding(secrets.VOCABULARY), pieces.processor(pieces.MODEL)
    clean = [r for r in rows if "idiot" not in (r[1] or "")]
    first = {}
    for r in sorted(clean):
        first.setdefault(r[1], r)  # the texts are copies or share nothing

    def mask(t):
        for s, e, _ in reversed(secrets.covered(secrets.find(t, enc)[1])):
            t = t[:s] + "[SECRET]" + t[e:]
        return t

    kept = [(r[0], r[1] and mask(r[1]), r[2], r[3]) for r in first.values()]
    mixed = mixing.mix(spark, spark.createDataFrame(kept, "doc_id long, text string, lang string, source string")).select("doc_id", "_mix.copies").collect()
    copies = {r.doc_id: r.copies for r in mixed}
    want = Counter()
    for i, t, _, _ in kept:
        ids = sp.encode(t or "")
        want[i, len(ids), tuple(ids)] += copies[i]
    assert got == +want and all(500 > i or i >= 700 for i, _, _ in got)


def test_stages_leave_executors_heaps_empty(spark):
    import gc

    jvm, docs = spark._jvm, spark.range(3)
    old = spark._sc._gateway.new_array(jvm.byte, 32 << 20)  # so large that only a collection of the whole heap is sure to find it
    cleared = jvm.java.lang.ref.WeakReference(old)
    del old
    gc.collect()  # and with it what keeps it on this side
    before = sum(x.getCollectionCount() for x in jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans())
    assert corpus_pipeline.batched(lambda s, d, sf_dir: d)(spark, docs, "").count() == 3
    assert sum(x.getCollectionCount() for x in jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()) > before
    assert cleared.get() is None
