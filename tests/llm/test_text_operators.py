import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramlode.llm import mixing, pieces, pii, quality, secrets, separators, simhash, tokenfile, toxicity
from gramlode.llm.common import fresh_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_quality_measures_and_odd_rows(spark, odd, empty):
    def brute(t):
        t = t or ""
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        n = Counter(grams)
        hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)

    q = quality.quality(spark, odd)
    got = rows_of(q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    assert got == Counter((r.doc_id, *brute(r.text)) for r in odd.collect())
    assert q.where("kept and base_failed").isEmpty() and quality.quality(spark, empty).isEmpty()


def test_quality_sketch_merges_exactly(spark):
    d = spark.range(5000).select((F.col("id") * 37 % 4001).alias("v"), (F.col("id") % 7).cast("string").alias("lang"), F.lit("s").alias("source"))
    d = d.select("lang", "source", *[F.col("v").alias(m) for m in quality.MEASURES])
    parts = quality.merge(quality.sketch(d), ())
    q = quality.quantiles(parts, ()).first()
    v = sorted(r.word_len for r in d.collect())
    for k in quality.FENCE["word_len"][:2]:
        true = v[-(-len(v) * k // 100) - 1]
        assert true * 31 / 32 <= q[f"word_len_q{k}"] <= true and q.docs == 5000


def test_quality_fences_differ_and_failed_rows_do_not_move_them(spark):
    rng = random.Random(9)
    line = lambda words: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(words))
    rows = [(i, "\n".join(line(12) for _ in range(10)) + (" # #" * (i % 3) if i % 2 else ""), "en", "calm" if i % 2 == 0 else "code") for i in range(400)]
    junk = [(1000 + i, "\n".join([line(6)] * 4 + [line(12) for _ in range(6)]) + " #" * 30, "en", "calm") for i in range(6)]
    failed = [(2000 + i, "# " * 30, "en", "calm") for i in range(300)]
    make = lambda x: spark.createDataFrame(x, "doc_id long, text string, lang string, source string")
    limits = lambda x: {(r.doc_id // 1000, r.source): r.symbol_rate_max for r in quality.quality(spark, make(x)).where("not base_failed").collect()}
    kept = {r.doc_id: r.kept for r in quality.quality(spark, make(rows + junk + failed)).collect()}
    assert all(kept[r[0]] for r in rows) and not any(kept[r[0]] for r in junk + failed)
    a, b = limits(rows + junk), limits(rows + junk + failed)
    assert a == b and a[0, "calm"] < a[0, "code"]


def test_mixing_water_filling(spark, odd, empty):
    m = mixing.mix(spark, odd)
    got = m.select("doc_id", "source", F.col("_mix.size").alias("size"), F.col("_mix.source_size").alias("all"), F.col("_mix.target").alias("target"), F.col("_mix.copies").alias("copies")).collect()
    size = {}
    for r in odd.collect():
        size[r.source] = size.get(r.source, 0) + len(WORD.findall(r.text or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, target, free = sum(size.values()), {}, set(order)
    while True:  # clamp and share again until none is above
        rest = total - sum(target.values())
        w = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / w > 3 * size[s]}
        if not over:
            target |= {s: rest * weight[s] / w for s in free}
            break
        target |= {s: 3 * size[s] for s in over}
        free -= over
    for r in got:
        assert r.all == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 3
    assert len(got) == odd.count() and rows_of(m.select("doc_id", "_mix.copies")) == rows_of(mixing.mix(spark, odd).select("doc_id", "_mix.copies"))
    assert mixing.repeated(m).count() == sum(r.copies for r in got) and mixing.repeated(m).columns == odd.columns
    assert mixing.mix(spark, empty).isEmpty()
    clash = odd.select("*", F.lit(1).alias("whole"), F.lit(2).alias("cut"), F.lit(3).alias("_s"), F.lit(4).alias("size"), F.lit(5).alias("_own_x"), F.lit(6).alias("target"))
    assert mixing.repeated(mixing.mix(spark, clash)).columns == clash.columns
    assert rows_of(mixing.repeated(mixing.mix(spark, clash)).select(odd.columns)) == rows_of(mixing.repeated(m))


def test_secrets(spark, odd, empty):
    s = {(r.doc_id, r.spans) for r in secrets.scan(odd, ["doc_id"]).collect()}
    assert any(i == 400 and x.startswith("assign:0:") and "hex:9:49" in x for i, x in s)
    assert any(i == 401 and "access:" in x and "random:4:24" in x for i, x in s)
    assert all(not x for i, x in s if i not in (400, 401))
    enc = secrets.encoding(secrets.VOCABULARY)
    assert not secrets.exposed("d41d8cd98f00b204e9800998ecf8427e", enc) and not secrets.exposed("123e4567-e89b-12d3-a456-426614174000", enc) and not secrets.exposed("read_only_memory_table_2", enc)
    assert secrets.base_spans("TOKEN: short") == [] and secrets.base_spans("api_key='abcdef'") == [(0, 15, "assign")]
    m = secrets.masked(odd)
    assert m.columns == odd.columns and m.count() == odd.count() and m.where("doc_id = 400 and text like '%[SECRET]%' and text not like '%0a1b2c%'").count() == 1
    assert secrets.scan(empty, ["doc_id"]).isEmpty() and m.where("text is null").count() == odd.where("text is null").count()


def test_random_letters_and_parts_are_exposed():
    enc = secrets.encoding(secrets.VOCABULARY)
    key = "qZ8pW3vX9mK2rT7yL4nBc5Hd"
    for text, at in (("qZxpWbvXgmKhrTdyLcnB", 0), ("services/production/settings/application/configuration/" + key, 55)):
        ((s, e, kind),) = secrets.find(text, enc)[1]
        assert s <= at and e == len(text) and kind == "random"
    for text in ("getElementsByClassNameInternal", "THIS_IS_A_LONG_CONSTANT", "/usr/local/share/applications/", "internationalization", "-" * 30):
        assert secrets.find(text, enc)[1] == []


def brute_secrets(text):
    """The base rule, read character by character."""
    out = []
    key = lambda c: c.isascii() and (c.isalnum() or c in "+/_.=-")
    i, low = 0, "".join(c.lower() if c.isascii() else c for c in text)
    while i < len(text):
        end = None
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(name, i):
                j = i + len(name)
                j += text[j : j + 1] in ('"', "'") and j < len(text)
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] not in (":", "="):
                    continue
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                j += text[j : j + 1] in ('"', "'") and j < len(text)
                k = j
                while k < len(text) and key(text[k]):
                    k += 1
                if k > j:
                    end = (k, k - j)
                    break
        if end:
            out += [(i, end[0], "assign")] * (end[1] >= 6)
            i = end[0]
        else:
            i += 1
    for kind, first, more, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), ("hex", "", set("0123456789abcdef"), 24)):
        i = 0
        while i < len(text):
            j = i + len(first) if text.startswith(first, i) else i
            k = j
            while (j > i or not first) and k < len(text) and text[k] in more:
                k += 1
            if k > j:
                out += [(i, k, kind)] * (k - i >= least)
                i = k
            else:
                i += 1
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


def test_secrets_equal_brute_force():
    rng = random.Random(6)
    parts = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", '"', "'", " ", ":", "=", "AKIA", "AKIAAKIA", "0a1b2c3d4e5f", "deadbeef", "A9Z8", "zz", "\n", "é", ".", "-", "\u212a", "x" * 5]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert secrets.base_spans(t) == brute_secrets(t), t


def test_planted_keys_are_found_beside_base_spans():
    """Random keys of 20 to 40 characters: nearly all are exposed; so is what a base span leaves of a candidate."""
    enc, rng = secrets.encoding(secrets.VOCABULARY), random.Random(7)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    for alphabet in (letters + "0123456789", letters, letters[:26] + "234567", letters + "0123456789+/_-"):
        keys = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(20, 41))) for _ in range(300)]
        hit = sum(any(k == "random" or e - s >= 20 for s, e, k in secrets.find(f"the key {x} is here", enc)[1]) for x in keys)
        assert hit >= 290, (alphabet, hit)
    text = "0a1b2c3d4e5f0a1b2c3d4e5f/qZ8pW3vX9mK2rT7yL4nBc5Hd"
    assert secrets.find(text, enc)[1] == [(0, 24, "hex"), (25, len(text), "random")]
    many = "0a1b2c3d4e5f0a1b2c3d4e5f " * 20_000
    assert len(secrets.find(many, enc)[0]) == 20_000


def test_personal_data(spark, odd, empty):
    f = {r.doc_id: [(x.kind, x.m) for x in r._base] for r in pii.find(spark, odd, ["doc_id"]).collect()}
    assert f[400] == [("email", "me.34@mail7.example.com"), ("ip", "97.51.17.173"), ("card", "4952935900253052"), ("phone", "+1 (487) 555-7209")]
    assert all(not v for k, v in f.items() if k != 400)
    texts = ["a@b.co%x@y.org 1.2.3.4.5.6.7.8 300.1.1.1 001.2.3.4", "4952-9359 0025 3052, 4952935900253053, 4952 9359 0025 3052 4952935900253052", "+12345678 +1 2", "9" * 3000 + "." + "a" * 3000 + "@", "\U0001f600 q@w.de"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: [(x.kind, x.s, x.e) for x in r.b] for r in d.select("doc_id", pii.base_spans(F.col("text")).alias("b")).collect()}
    assert got[0] == [("email", 0, 6), ("email", 6, 14), ("ip", 15, 22), ("ip", 23, 30), ("ip", 41, 50)]
    assert got[1] == [("card", 0, 19)] and got[2] == [("phone", 0, 9)] and got[3] == [] and got[4] == [("email", 2, 8)]
    red = pii.redacted(spark, odd)
    assert red.columns == odd.columns and red.where("doc_id = 400 and text like '%[PII]%'").count() == 1
    assert pii.find(spark, empty, ["doc_id"]).isEmpty()


def test_personal_data_that_the_patterns_miss(spark):
    import random

    rng = random.Random(3)
    n = lambda k: str(rng.randrange(10 ** (k - 1), 10**k))
    cards = []
    while len(cards) < 40:
        c = n(16)
        if sum((2 * int(x) - 9 * (x > "4")) if i % 2 == 0 else int(x) for i, x in enumerate(c)) % 10 == 0:
            cards.append(c)
    rows = [f"mail me{i}.x@mail{n(1)}.example.com or +1 ({n(3)}) {n(3)}-{n(4)} at {n(2)}.{n(2)}.17.{n(2)} and {c} order {n(8)} of 2021-0{n(1)}-1{n(1)}" for i, c in enumerate(cards)]
    odd = ["call (555) 123-4567 now", "ring 020 7946 0958 please", "write john.smith [at] example [dot] com today", "on 2021-03-04 it was 12.04.2013", "from 1990-1995 and 1 000 000 more", f"cards {cards[0]} {cards[1]} here"]
    d = spark.createDataFrame(list(enumerate(odd + rows)), "doc_id int, text string")
    got = {r.doc_id: [(x.kind, x.m) for x in r._spans] for r in pii.find(spark, d, ["doc_id"]).where(f"doc_id < {len(odd)}").collect()}
    assert got == {0: [("number", "(555) 123-4567")], 1: [("number", "020 7946 0958")], 2: [("address", "john.smith [at] example [dot] com")], 3: [], 4: [], 5: [("number", cards[0]), ("number", cards[1])]}


def test_redaction_goes_by_place(spark):
    d = spark.createDataFrame([(1, "1.2.3.4 or 91.2.3.45 or 1.2.3.4", "k"), (2, None, None)], "doc_id int, text string, _t string")
    got = {r.doc_id: r.text for r in pii.redacted(spark, d).collect()}
    assert got == {1: "[PII] or [PII] or [PII]", 2: None}
    again = spark.createDataFrame([(1, "+12345678 12345678")], "doc_id int, text string")
    assert pii.redacted(spark, again).first().text == "+12345678 12345678"  # 16 digits are no phone, and nothing trains


def brute_personal(text):
    """The base rule, by Python's own engine on single kinds, checks written out."""
    luhn = lambda d: sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (2 * int(c) > 9)) for i, c in enumerate(reversed(d))) % 10 == 0
    only = lambda m: "".join(c for c in m if c in "0123456789")
    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(only(m)) <= 19 and luhn(only(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(only(m)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m.group())]


def test_personal_base_spans_equal_brute_force(spark):
    rng = random.Random(8)
    parts = ["a@b.co", "x.y", "@", ".", "-", " ", "+", "(", ")", "1.2.3.4", "255", "256", "4952935900253052", "4952 9359 0025 3052", "12", "7", "+1 (487) 555-7209", "%", "\U0001f600", "é", "\n", "0", "00", "mail"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(25))) for _ in range(3000)]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", pii.base_spans(F.col("t")).alias("b"))
    for r in d.collect():
        assert [(x.kind, x.s, x.e) for x in r.b] == brute_personal(texts[r.i]), texts[r.i]


def test_simhash_components(spark, odd, empty, monkeypatch):
    import xxhash

    fp = {}
    for n, r in enumerate(odd.collect()):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or ""))
        sh = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
        fp[n] = (r.doc_id, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = {n: n for n in fp}
    for a in fp:
        for b in fp:
            if (fp[a][1] ^ fp[b][1]).bit_count() <= 2:
                old, new = root[b], root[a]
                root = {k: new if v == old else v for k, v in root.items()}
    low = {c: min((fp[n][0] for n in fp if root[n] == c and fp[n][0] is not None), default=None) for c in set(root.values())}
    got = rows_of(simhash.near_copies(spark, odd).select("doc_id", "fp", "component_id"))
    assert got == Counter((fp[n][0], simhash.signed(fp[n][1]), low[root[n]]) for n in fp)
    assert simhash.near_copies(spark, empty).isEmpty()
    monkeypatch.setattr("gramlode.llm.common.HOT_ROWS", 1)  # hot fingerprints and components take the other way
    assert rows_of(simhash.near_copies(spark, odd).select("doc_id", "fp", "component_id")) == got


def test_majority_of_a_list_that_stands_alone():
    """A list that is worked on by itself: one that is longer than a step, and the last of a batch after a full step."""
    rng = np.random.default_rng(3)
    for sizes in ([1], [7, 300_000, 0, 5], [1 << 17, 1 << 17, 3], [0, 0], [(1 << 18) + 1]):
        offsets = np.append(0, np.cumsum(sizes))
        values = rng.integers(0, 1 << 63, int(offsets[-1]), dtype=np.uint64)
        want = [sum(1 << k for k in range(64) if 2 * int((v >> np.uint64(k) & np.uint64(1)).sum()) > len(v)) for v in np.split(values, offsets[1:-1])]
        assert simhash.majority(values, offsets).tolist() == want, sizes


def jaccard_rows(texts):
    sets = []
    for t in texts:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return lambda a, b: 1.0 if not (sets[a] | sets[b]) else len(sets[a] & sets[b]) / len(sets[a] | sets[b])


def test_near_copies_by_shingles(spark, odd, empty):
    """Edited copies of many texts, words repeated as in prose: nearly all pairs at 0.8 or more meet in one component,
    and nothing else does."""
    from gramlode.llm import nearcopies

    rng = random.Random(12)
    rare = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9)))
    common = [rare() for _ in range(40)]
    word = lambda: rng.choice(common) if rng.random() < 0.5 else rare()
    texts, base = [], []
    for k in range(120):
        own = [word() for _ in range(rng.randrange(60, 300))]
        for c in range(rng.randrange(2, 6)):
            w = list(own)
            for _ in range(c * len(w) // 100 if k % 3 else 6 * c * len(w) // 100):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
            base.append(k)
    texts += ["same words here " * 40, "same words here " * 41, "x", "x", "", None]
    like = jaccard_rows(texts)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in nearcopies.representatives(spark, d).collect()}
    n = len(base)
    close = [(a, b) for b in range(n) for a in range(b) if base[a] == base[b] and like(a, b) >= 0.8]
    lost = [(a, b) for a, b in close if b in kept]
    assert len(close) > 100 and len(lost) <= 0.05 * len(close)
    alone = [b for b in range(n) if all(like(a, b) < 0.8 for a in range(n) if base[a] == base[b] and a != b)]
    assert len(alone) > 20 and kept.issuperset(alone) and kept.issuperset(base.index(k) for k in range(120))
    assert [i - n for i in sorted(kept) if i >= n] == [0, 2, 4]
    out = nearcopies.representatives(spark, odd.select(F.struct(*odd.columns).alias("_r"), "doc_id", "text"))
    assert {(r.doc_id, r.text) for r in out.collect()}.issubset({(r.doc_id, r.text) for r in odd.collect()}) and nearcopies.representatives(spark, empty).isEmpty()


def test_no_near_copy_is_lost(spark, monkeypatch):
    """Short texts, whose fingerprints stray far, edited in families with one common passage: the classes are exactly those
    of all pairs at 0.8 or more, also where groups are wide and hardly any first link is found."""
    from gramlode.llm import nearcopies

    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(60))
    passage, texts = [word() for _ in range(25)], []
    for k in range(70):
        own = [word() for _ in range(rng.randrange(4, 70))] + (passage if k % 3 == 0 else [])
        for _ in range(rng.randrange(1, 8)):
            w = list(own)
            for _ in range(rng.randrange(0, 3)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(0, 2)] = [word()]
            texts.append(" ".join(w))
    texts += [texts[0].upper(), texts[1], "x", "X", "", None, " "]
    like, root = jaccard_rows(texts), list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            if root[a] != root[b] and like(a, b) >= 0.8:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if x == old else x for x in root]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert 80 < len(set(root)) < len(texts) - 50
    assert sorted(r.doc_id for r in nearcopies.representatives(spark, d).collect()) == sorted(set(root))
    monkeypatch.setattr(nearcopies, "WIDE", 3)
    monkeypatch.setattr(nearcopies, "MANY", 4)
    monkeypatch.setattr(nearcopies, "neighbours", lambda spark, nodes, similarity: nodes.selectExpr("node as u", "node as v").limit(0))
    assert sorted(r.doc_id for r in nearcopies.representatives(spark, d).collect()) == sorted(set(root))


def test_pairs_that_cannot_hold_stay_in_their_task():
    """Members of one token whose sets differ give no pair, however many there are; copies of each other do, once."""
    import pyarrow as pa

    from gramlode.llm import nearcopies

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 62, 100).astype(np.uint64)) for _ in range(90)]
    sets += [np.append(sets[k][:-1], np.uint64(5)) for k in (0, 41)]
    rows = [(t, k, len(x), 1 + (k == 0), k, nearcopies.parity(x).tobytes()) for t, many in ((1, 60), (2, 92)) for k, x in enumerate(sets) if k < many or k > 89]
    rows += [(3, k, 100, 1, 7, nearcopies.parity(sets[k]).tobytes()) for k in (0, 90)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["token", "node", "n", "copies", "root", "bits"])
    found = lambda last: [(u, v) for b in nearcopies._apart(0.8, last)(iter([batch.slice(0, 50), batch.slice(50)])) for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert found(False) == [(90, 0), (91, 41)] and found(True) == [(90, 0), (91, 41)]
    opened = [x for b in nearcopies._open(iter([batch.select(["token", "node", "root"])])) for x in b.column(0).to_pylist()]
    assert Counter(opened) == {1: 62, 2: 92} and not list(nearcopies._open(iter([]))) and not list(nearcopies._apart(0.8, False)(iter([])))


def test_wide_maps_bound_the_difference_of_long_sets():
    """Of long sets, for which a map of BITS bins tells nothing, half-similar ones are apart, and no similar one is."""
    from gramlode.llm import nearcopies

    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(0, 1 << 62, 9000).astype(np.uint64))
    apart, near, longer = pool[2500:7000], pool[450:4500], pool[:4950]
    whole = pool[:4500]
    assert nearcopies.wide_map(pool[:512]) is None and len(nearcopies.wide_map(pool[:513])) == 256
    for other, holds in ((apart, False), (near, True), (longer, True), (whole, True)):
        differ = nearcopies.differing(nearcopies.wide_map(whole), nearcopies.wide_map(other))
        assert differ <= len(np.setxor1d(whole, other))
        assert bool(nearcopies.possible(len(whole), len(other), differ, 0.8)) == holds
        short = int(np.bitwise_count(nearcopies.parity(whole) ^ nearcopies.parity(other)).sum())
        assert nearcopies.possible(len(whole), len(other), short, 0.8)


def test_components_in_one_task_and_by_rounds(spark):
    from gramlode.llm.components import components

    rng = random.Random(2)
    edges = [(a, a + rng.choice([1, 2, 700])) for a in rng.sample(range(-3000, 3000), 2500)] + [(k, k + 1) for k in range(9000, 9400)] + [(5, 5)]
    d = spark.createDataFrame(edges, "u long, v long")
    rounds, alone = rows_of(components(spark, d)), rows_of(components(spark, d, 10_000))
    assert rounds == alone and len(alone) > 2500 and rounds == rows_of(components(spark, d, 100))
    assert components(spark, d.limit(0), 10).isEmpty()


def test_simhash_buckets_split_without_losing_links(spark):
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    vals = {int(s) for s in seeds}
    for s in seeds.tolist():  # dense clusters: most fall into the same buckets
        vals |= {s ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 24, (60, 2))}
    vals = sorted(vals)
    d = spark.createDataFrame([(simhash.signed(v),) for v in vals], "fp long")
    e = simhash.components(spark, simhash.links(spark, d, limit=16)).collect()
    got = {r.node: r.root for r in e}
    root = {v: v for v in vals}
    for a in vals:
        for b in vals:
            if (a ^ b).bit_count() <= 2 and root[a] != root[b]:
                old, new = root[b], root[a]
                root = {k: new if x == old else x for k, x in root.items()}
    groups = lambda m: sorted(sorted(simhash.signed(v) for v in vals if m(v) == c) for c in {m(v) for v in vals})
    assert groups(lambda v: root[v]) == groups(lambda v: got.get(simhash.signed(v), simhash.signed(v)))


def test_token_files_round_trip(spark, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path(tokenfile.VOCABULARY))
    shards = tokenfile.write(spark, odd, fresh_path(spark, "t"))
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.read(spark, shards, True).collect())
    want, start = [], 0
    for r in sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = np.array([*tk.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((start, r.doc_id, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    s = shards[0]
    assert zlib.crc32(tokenfile.fetch(s["path"], s["dictionary"], 0).tobytes()) == want[0][3]
    assert tokenfile.read(spark, tokenfile.write(spark, empty, fresh_path(spark, "t"))).isEmpty()


def test_token_encoder_equals_the_library():
    import random

    import pyarrow as pa

    rng = random.Random(1)
    signs = [*"abcXYZ,.'!<|>endoftext İıΣσςßẞǅéÉñǰ\u0301\u0307\u030cE 01२²\xad\t\r\x0b\x85\u3000漢字ʰªº😀ŉK", "<|endoftext|>", "'s", "'ll", "İ,", "İ."]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(25))) for _ in range(12_000)]
    e = tokenfile.Encoder(tokenfile.VOCABULARY)
    want = [np.array(e.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert e.encode(pa.array(texts)) == want and e.encode(pa.array(["İ,", ""])) == [want_of(e, "İ,"), b""]


def want_of(e, text):
    return np.array(e.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_tasks_of_a_worker_share_an_encoder(monkeypatch):
    """Words that one task has encoded are known to the next, and ids stay the library's when old words are forgotten."""
    import pyarrow as pa

    enc = tokenfile.encoder(tokenfile.VOCABULARY)
    texts = [" ".join(f"word{k}, İx{i} Ünder. a{k % 7}" for k in range(50 * i, 50 * i + 60)) for i in range(12)]
    want = [np.array(e.ids, "<u4").tobytes() for e in enc.library.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(pa.array(texts[:6])) == want[:6]
    learned, learn = [], enc._learn
    monkeypatch.setattr(enc, "_learn", lambda new: (learned.extend(new), learn(new))[1])
    again = tokenfile.encoder(tokenfile.VOCABULARY)
    assert again.encode(pa.array(texts[:6])) == want[:6] and not learned
    monkeypatch.setattr(tokenfile, "MAX_CACHE", 20)
    assert [again.encode(pa.array([t]))[0] for t in texts * 2] == want * 2 and len(learned) > 100


def test_a_full_encoder_looks_up_the_pieces_of_the_call_alone(monkeypatch):
    import pyarrow as pa

    looked = []

    class Counted(dict):
        def __contains__(self, k):
            looked.append(k)
            return super().__contains__(k)

        def __getitem__(self, k):
            looked.append(k)
            return super().__getitem__(k)

        def get(self, k, *default):
            looked.append(k)
            return super().get(k, *default)

    monkeypatch.setattr(tokenfile, "MAX_CACHE", 100)
    e = tokenfile.Encoder(tokenfile.VOCABULARY)
    for i in range(3):
        e.encode(pa.array([" ".join(f"piece{i}x{k}" for k in range(40))]))
    e.known = Counted(e.known)
    texts = ["piece0x1 other", "piece2x3 piece0x1"]
    assert [e.encode(pa.array([t])) for t in texts] == [[want_of(e, t)] for t in texts]
    assert set(looked) <= {"piece0x1", "other", "piece2x3"} and len(looked) < 20


def test_token_files_of_long_documents_share_a_dictionary(spark):
    d = spark.createDataFrame([(1, "some words again " * 3000), (1, "some words again " * 3000)], "doc_id long, text string")
    shards = tokenfile.write(spark, d, fresh_path(spark, "t"))
    assert tokenfile.opened(shards[0]["dictionary"])[0].get_file_info(shards[0]["dictionary"]).size > 0
    assert tokenfile.read(spark, shards).count() == 2


def test_separator_counts(spark, odd, empty):
    enc = secrets.encoding(separators.VOCABULARY)
    assert rows_of(separators.token_counts(spark, odd)) == Counter((r.doc_id, len(enc.encode_ordinary(r.text or ""))) for r in odd.collect())
    assert separators.token_counts(spark, empty).isEmpty()
    folder = separators.made(fresh_path(spark, "flat"))
    path = f"{folder}/x"
    store, local = separators.opened(path)
    with store.open_output_stream(local) as f:
        f.write(np.array([9, 5, 5, 9, 9, 1, 2, 3, 9, 4], "<u2").tobytes())
    c = separators.count(spark, spark.createDataFrame([(path,)], "path string"), end_id=9, block=3)
    assert sorted((r.ordinal, r.n_tokens, r.closed) for r in c.collect()) == [(0, 0, True), (1, 2, True), (2, 0, True), (3, 3, True), (4, 1, False)]


@pytest.mark.parametrize("frequent", [pieces.FREQUENT, 20])
def test_pieces_equal_the_library(spark, odd, empty, frequent):
    sp = pieces.processor(pieces.MODEL)
    got = rows_of(pieces.encode(spark, odd, ["doc_id", "text"], frequent=frequent).select("doc_id", "text", F.col("ids").cast("string")))
    assert got == Counter((r.doc_id, r.text, str(sp.encode(r.text or ""))) for r in odd.collect())
    want = Counter((r.doc_id, len(x := sp.encode(r.text or "")), zlib.crc32(np.array(x, "<u4").tobytes()), True) for r in odd.collect())
    assert rows_of(pieces.encode(spark, odd, ["doc_id", "text"], frequent=frequent, digest=True)) == want
    if frequent != 20:
        assert pieces.encode(spark, empty, ["doc_id"]).isEmpty()
        clash = pieces.encode(spark, odd.withColumnRenamed("_t", "w"), ["doc_id", "w", "_row", "text"])
        assert clash.columns == ["doc_id", "w", "_row", "text", "ids"] and clash.where("w = 'clash' and _row = 7").count() == odd.count()
        back = pieces.decoded(clash)
        assert rows_of(back.select("doc_id", "text")) == Counter((r.doc_id, (r.text or "").replace(pieces.SIGN, " ")) for r in odd.collect())


def test_digests_read_off_what_the_ids_write():
    import pyarrow as pa

    sp = pieces.processor(pieces.MODEL)
    texts = pa.array(["", None, " two  blanks ", "a1-b2,c", "ünï😀漢字 x", "▁sign", "\ufffd", "e\u0301" * 40, "Größe 12a"])
    ids = [sp.encode(t or "") for t in texts.to_pylist()]
    want = [(len(x), zlib.crc32(np.array(x, "<u4").tobytes()), True) for x in ids]
    lists = pa.array(ids, pa.list_(pa.int32()))
    assert pieces._digest(texts, lists, pieces.MODEL) == want
    assert pieces._digest(texts.slice(3, 4), lists.slice(3, 4), pieces.MODEL) == want[3:7]
    assert pieces._digest(texts.slice(0, 2), lists.slice(0, 2), pieces.MODEL) == want[:2]
    lone = pa.array([[pieces.byte_ids(pieces.MODEL)[0xFF]]], pa.list_(pa.int32()))  # bytes that are no UTF-8 write U+FFFD
    assert [x[2] for t in ("\ufffd", "?") for x in pieces._digest(pa.array([t]), lone, pieces.MODEL)] == [True, False]


def test_texts_are_cut_in_steps(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    texts = pa.array(["", None, " two  blanks ", "a1-b2,c", "ünï😀漢字 x", "▁sign", "\ufffd", "e\u0301" * 40, "Größe 12a"])
    words, ends = pieces.cut_words(pieces.signed(texts), pieces.MODEL)
    many = pieces.signed(pa.array(["some words, 12 of them " * 40_000]))
    tracemalloc.start()
    pieces.cut_words(many, pieces.MODEL)
    assert tracemalloc.get_traced_memory()[1] < 12 * len(many[0].as_py())  # was 18 bytes for each one of the text
    tracemalloc.stop()
    for step in (1, 2, 3, 7):
        monkeypatch.setattr(pieces, "STEP", step)
        got, to = pieces.cut_words(pieces.signed(texts), pieces.MODEL)
        assert got.to_pylist() == words.to_pylist() and to.tolist() == ends.tolist()


def test_the_vocabulary_needs_no_python_workers(spark):
    words = spark.createDataFrame([("▁ab",)], "w string")
    plan = pieces.lattice(spark, words)._jdf.queryExecution().optimizedPlan().toString()
    table = [x for x in plan.splitlines() if "_p#" in x and ("LocalRelation" in x or "LogicalRDD" in x)]
    assert table and all("LocalRelation" in x for x in table)


def viterbi_by_merges(word):
    """Brute force: the merge order itself, a pair at a time over the whole word."""
    known, raw = pieces.pieces(pieces.MODEL), pieces.byte_ids(pieces.MODEL)
    parts = list(word)
    while True:
        best = min(((known[a + b][1], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in known), default=None)
        if best is None:
            return [x for p in parts for x in ([known[p][0]] if p in known else [raw[c] for c in p.encode()])]
        k = best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_the_fold_is_the_merge_order(spark):
    rng = random.Random(2)
    signs = "aaabcdeeethsinor.,-'\"09éü漢😀\n"
    words = ["▁" + "".join(rng.choice(signs) for _ in range(rng.randrange(1, 30))) for _ in range(1500)]
    words += ["▁" + "".join(rng.choice("aeth") for _ in range(60)) for _ in range(150)] + ["▁" * rng.randrange(4) + c * k for c in "azeo=-_0." for k in (1, 2, 3, 5, 9, 17, 100)]
    words = sorted(set(words))
    want = {w: viterbi_by_merges(w) for w in words}
    assert all(pieces.fold_long(w) == ids for w, ids in want.items())
    d = pieces.dictionary(spark, spark.createDataFrame([(w.replace("▁", " "), 1, 1) for w in words], "w string, h long, n long"))
    assert {r.w.replace(" ", "▁"): r.ids for r in d.collect()} == want
    sp = pieces.processor(pieces.MODEL)
    for long in ("ab" * 2000, "z" * 3000):
        assert pieces.fold_long("▁" + long) == sp.encode(long)


def test_toxicity_restores_and_scores(spark, odd, empty):
    text = " ".join(["the idiot is stupid and a moron"] * 50 + ["the garden is green and calm"] * 50)
    lm = toxicity.language_model(toxicity.trigram_counts(text))
    for w, plain in (("1d10t", "idiot"), ("$tup1d", "stupid"), ("m.o.r.o.n", "moron"), ("stuuuupid", "stupid"), ("i d i o t", "idiot")):
        assert toxicity.decode(w, lm) == plain
    assert toxicity.Restorer(lm).words("Plain words, plain.")[0] == Counter({"plain": 2, "words": 1})
    docs = [(i, f"the garden is calm and green number {i} " + ("what an idiot and m0r0n" if i % 4 == 0 else "what a day")) for i in range(240)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    labels = d.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    s = toxicity.scored(spark, d, labels, ["doc_id"]).join(labels, "doc_id")
    assert s.where("_toxic <> toxic").count() <= 2 and s.where("_score < 0 or _score > 1").isEmpty()
    none = toxicity.scored(spark, odd, labels.limit(0), ["doc_id", "_row"])
    assert none.count() == odd.count() and none.where("_toxic = 1").isEmpty()
    assert toxicity.scored(spark, empty, labels, ["doc_id"]).isEmpty()


def test_viterbi_equals_all_paths():
    """Brute force: every path through the lattice of short tokens, priced by channel and character model."""
    import itertools

    rng = random.Random(4)
    words = ["idiot", "stupid", "garden", "green", "calm", "moron", "stone"]
    lm = toxicity.language_model(toxicity.trigram_counts(" ".join(rng.choice(words) for _ in range(400))))
    S = toxicity.SYMBOLS

    def price(path):
        a = b = 0
        total = 0.0
        for out, c in path:
            total += c
            if out == " ":
                if b == 0:
                    return None
                total += lm[(a * S + b) * S]
                a = b = 0
            elif out:
                s = toxicity.symbol(out)
                total += lm[(a * S + b) * S + s]
                a, b = b, s
        return total + (lm[(a * S + b) * S] if b else 0.0)

    for _ in range(150):
        token = "".join(rng.choice("idotsup1045$@._ aab") for _ in range(rng.randrange(2, 8)))
        paths = [(price(p), "".join(o for o, _ in p)) for p in itertools.product(*toxicity.options(token))]
        least = min(c for c, _ in paths if c is not None)
        assert toxicity.decode(token, lm) in {t for c, t in paths if c is not None and c <= least + 1e-9}, token
    long = "1d10t.$tup1d-" * 20_000
    assert toxicity.decode(long, lm).startswith("idiot")
    for text in ("i d i o t.", '"i d i o t"', "so i  d  i  o  t, he", "i\td\ti\to\tt"):
        assert toxicity.Restorer(lm).words(text)[0]["idiot"] == 1, text


def test_base_digests_are_stable(spark, odd):
    r = secrets.scan(odd.where("doc_id = 302"), ["doc_id"]).first()
    assert r.base_sha256 == hashlib.sha256(b"").hexdigest()


def test_what_workers_of_the_pipeline_hold(spark, tmp_path):
    """Cutting loads no model once its classes are known, the frequent table is filled in place, an ended task's memory
    is released when nothing holds it, and a task of one operator drops the models of another."""
    import tracemalloc
    import weakref

    import pyarrow as pa

    from gramlode.llm import common

    kinds = pieces.lead_classes(pieces.MODEL)
    for c in (pieces.lead_classes, pieces.pieces, pieces.processor):
        c.cache_clear()
    words, _ = pieces.cut_words(pieces.signed(pa.array(["two words"])), pieces.MODEL, kinds)
    assert words.to_pylist() == [" two", " words"] and not pieces.processor.cache_info().currsize

    n, k = 60_000, 40
    path = f"file://{tmp_path}/frequent"
    spark.range(n, numPartitions=1).selectExpr("id as h", f"if(id % 7 = 0, array(), transform(sequence(1, {k}), x -> cast((id + x) % 60000 as int))) as ids").write.parquet(path)
    pieces._FREQUENT.clear()
    tracemalloc.start()
    h, offsets, flat = pieces._frequent(path)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pieces._FREQUENT.clear()
    assert peak < 1.6 * (h.nbytes + offsets.nbytes + flat.nbytes)  # was over twice that
    assert h.tolist() == list(range(n)) and len(flat) == offsets[-1] == k * sum(i % 7 > 0 for i in range(n))
    assert flat[offsets[8] : offsets[9]].tolist() == [8 + x for x in range(1, k + 1)] and offsets[7] == offsets[8]

    class Held:
        pass

    seen = []

    def run(batches):
        own = Held()
        seen.append(weakref.ref(own))
        yield from batches
        assert own

    assert list(common.tidy(run)([1, 2])) == [1, 2] and seen[0]() is None
    secrets.encoding(secrets.VOCABULARY)
    common.alone(secrets.__name__)
    assert secrets.encoding.cache_info().currsize
    common.alone(pieces.__name__)
    assert not secrets.encoding.cache_info().currsize


def test_the_limits_are_not_spelled_out_in_plans(spark):
    values = [-1, pieces.NEVER, *range(100_000)]
    d = spark.range(4).select(F.get(pieces.constant(values), F.col("id").cast("int")).alias("x"))
    assert [r.x for r in d.collect()] == [-1, pieces.NEVER, 0, 1]
    assert len(d._jdf.queryExecution().toString()) < 5000
