"""Toxicity of restored text: a noisy channel undoes obfuscation before words are scored.

A character trigram model is counted over all documents. A token that may be disguised (letters written as digits or
signs, spaced or separated letters, stretched letters) becomes a lattice: every character can stand for itself, for
the letters it resembles, or for nothing. Viterbi decoding picks the likeliest path under channel and character model.
A token without any such character has a lattice of one path and is its own decoding. A linear model over the words
of the restored text and their beginnings, trained on labelled documents, scores whole documents.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, release, table, tidy

#: Letters that a sign may stand for.
LOOKS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e",
}
SEPARATORS = "._-*~^/\\' "
#: Costs in nats: a sign for a letter, a sign for nothing before and after the last letter, a separator for nothing or
#: for a word break, one more of a letter or sign.
COST_LOOK, COST_SIGN, COST_TAIL, COST_JOIN, COST_BREAK, COST_STRETCH = 1.0, 12.0, 1.0, 0.3, 2.0, 0.7
#: Symbols of the character model: 0 word break, 1 to 26 letters, 27 any other letter.
SYMBOLS = 28
#: Labelled rows that train the model, features it has, documents a feature is in at least, and its threshold.
SAMPLE, WIDTH, LEAST, THRESHOLD = 16_000, 4096, 4, 0.3
MAX_CACHE = 200_000

_TRIM = ".,;:!?\"'()[]{}<>%&*#¿¡"
_SPACED = re.compile(r"(?<!\S)[\"'(\[]?[^\s\"'(\[](?:(?:\s{1,2}|[._*-])[^\s.,;:!?\"')\]]){2,}[.,;:!?\"')\]]*(?!\S)")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_SIGN = re.compile("[" + re.escape("".join(LOOKS) + SEPARATORS.strip()) + "]")
_LETTER = re.compile(r"[^\W\d_]")


def _symbol_table() -> np.ndarray:
    import unicodedata

    out = np.full(0x250, 27, np.uint8)
    for c in range(0x250):
        ch = chr(c).lower()
        bare = unicodedata.normalize("NFD", ch)[:1]
        if not ch.isalpha():
            out[c] = 0
        elif "a" <= bare <= "z":
            out[c] = ord(bare) - 96
    return out


TABLE = _symbol_table()


def symbols(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < len(TABLE), TABLE[np.minimum(c, len(TABLE) - 1)], np.uint8(27))


def symbol(ch: str) -> int:
    return int(TABLE[ord(ch)]) if ord(ch) < len(TABLE) else 27


def trigram_counts(text: str) -> np.ndarray:
    """Counts of symbol trigrams, each word between two word breaks on either side."""
    s = symbols(f"\n{text}\n").astype(np.int32)
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]
    s = np.repeat(s, 1 + (s == 0))
    return np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)


def language_model(counts: np.ndarray) -> list[float]:
    """Costs -log P(c | a, b) by a flat table, smoothed by the bigrams and a constant."""
    tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    bi = tri.sum(0) + 0.1
    p2 = bi / bi.sum(1, keepdims=True)
    p3 = (tri + 2.0 * p2[None]) / (tri.sum(2, keepdims=True) + 2.0)
    return (-np.log(p3)).reshape(-1).tolist()


def disguised(token: str) -> bool:
    """True if the lattice of a lower-case token has more than one path and holds a letter."""
    return bool(_LETTER.search(token)) and bool(_SIGN.search(token) or _STRETCHED.search(token))


def options(token: str) -> list[list[tuple[str, float]]]:
    """For each character of a lower-case token what it may stand for, and the channel's cost."""
    out, last = [], ""
    tail = max((i for i, ch in enumerate(token) if ch.isalpha()), default=-1)
    for at, ch in enumerate(token):
        own: list[tuple[str, float]] = []
        if ch in LOOKS:
            own += [(x, COST_LOOK) for x in LOOKS[ch]] + [("", COST_SIGN if at < tail else COST_TAIL)]
        elif ch in SEPARATORS or ch.isspace():
            own += [("", COST_JOIN), (" ", COST_BREAK)]
        else:
            own.append((ch if ch.isalpha() else "", 0.0))
        if ch == last and (ch.isalpha() or ch in LOOKS):
            own.append(("", COST_STRETCH))
        last = ch
        out.append(own)
    return out


def decode(token: str, lm: list[float]) -> str:
    """The likeliest text of a lower-case token, by Viterbi over states of the last two symbols.

    Back pointers are kept in flat arrays, a few bytes for each state and character, so long tokens need little.
    """
    states: dict[tuple[int, int], tuple[float, int]] = {(0, 0): (0.0, 0)}  # cost, and place among the states of the step
    before, wrote, starts = array("h"), array("i"), array("q")  # of each state: the state it came from, what was written
    for own in options(token):
        new: dict[tuple[int, int], list] = {}
        for (a, b), (cost, place) in states.items():
            row = (a * SYMBOLS + b) * SYMBOLS
            for out, c in own:
                if out == " ":
                    if b == 0:
                        continue
                    to, total = (0, 0), cost + c + lm[row]
                elif out:
                    s = symbol(out)
                    to, total = (b, s), cost + c + lm[row + s]
                else:
                    to, total = (a, b), cost + c
                got = new.get(to)
                if got is None or total < got[0]:
                    new[to] = [total, place, out]
        starts.append(len(before))
        before.extend([x[1] for x in new.values()])
        wrote.extend([ord(x[2]) if x[2] else 0 for x in new.values()])
        states = {to: (x[0], i) for i, (to, x) in enumerate(new.items())}
    at = min(states, key=lambda s: states[s][0] + (lm[(s[0] * SYMBOLS + s[1]) * SYMBOLS] if s[1] else 0.0))
    place, out = states[at][1], []
    for k in range(len(starts) - 1, -1, -1):
        if wrote[starts[k] + place]:
            out.append(chr(wrote[starts[k] + place]))
        place = before[starts[k] + place]
    return "".join(reversed(out))


class Restorer:
    """Restored words of texts; decodings of short tokens are remembered, up to a bounded number.

    stems: beginnings of three characters that matter to the caller; plain words with other beginnings are left out
    of the counts, though not of the total.
    """

    def __init__(self, lm: list[float], stems: frozenset[str] | None = None) -> None:
        self.lm = lm
        self.stems = stems
        self.known: dict[str, tuple[str, ...]] = {}

    def token(self, bare: str) -> tuple[str, ...]:
        got = self.known.get(bare)
        if got is None:
            got = tuple(decode(bare, self.lm).split())
            if len(self.known) < MAX_CACHE and len(bare) <= 64:
                self.known[bare] = got
        return got

    def words(self, text: str) -> tuple[Counter, int]:
        """Restored words of the whole text and how often they occur, and the number of tokens."""
        low, stems = text.lower(), self.stems
        counts: Counter = Counter()
        for m in _SPACED.finditer(low):
            run = m.group().strip(_TRIM)
            if len(set(run[::2])) > 1 and _LETTER.search(run):  # of one letter alone there is nothing to join
                counts.update(decode(run, self.lm).split())
        stretched, total = _STRETCHED.search(low) is not None, 0
        for t, n in Counter(low.split()).items():
            total += n
            bare = t if t.isalpha() else t.strip(_TRIM)
            if bare.isalpha() and not (stretched and _STRETCHED.search(bare)):
                if stems is None or bare[:3] in stems:
                    counts[bare] += n
            elif disguised(bare):
                for w in self.token(bare):
                    if stems is None or w[:3] in stems:
                        counts[w] += n
            elif bare and (stems is None or bare[:3] in stems):
                counts[bare] += n
        return counts, total


def features(word: str) -> list[str]:
    return [f"={word}", *(word[:k] for k in (3, 4, 5, 6, 7) if len(word) >= k)]


def value(count: int, total: int) -> float:
    """Of a feature that count of total words have: it being there, and its share."""
    return 0.3 + min(1.0, 25.0 * count / max(total, 25))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, width: int, l2: float = 1.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows by full-batch gradient steps with a rate for each weight."""
    at = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
    ix = np.concatenate([np.empty(0, np.int64), *(np.asarray(i, np.int64) for i, _ in rows)])
    v = np.concatenate([np.empty(0), *(np.asarray(x, float) for _, x in rows)])
    w, b, n = np.zeros(width), float(np.log((labels.mean() + 1e-6) / (1 - labels.mean() + 1e-6))), len(rows)
    sum_w, sum_b = np.full(width, 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(at, v * w[ix], minlength=n) + b
        r = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - labels) / n
        g, gb = np.bincount(ix, v * r[at], minlength=width) + l2 * w / n, float(r.sum())
        sum_w += g * g
        sum_b += gb * gb
        w -= 0.5 * g / np.sqrt(sum_w)
        b -= 0.5 * gb / sum_b**0.5
    return w, b


def held_out(id_col: str = "doc_id"):
    """True for the quarter of the ids that training never sees."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def _texts(column: pa.Array) -> Iterator[str]:
    for x in column:
        yield x.as_py() or ""


def corpus_model(docs: DataFrame, text_col: str = "text") -> list[float]:
    """The character model of all documents: one count for each trigram and task leaves the executors, then the sums."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SYMBOLS**3, np.int64)
        for b in batches:
            held, size = [], 0
            for t in _texts(b.column(0)):
                held.append(t)
                size += len(t)
                if size > 1 << 20:
                    counts += trigram_counts("\n".join(held))
                    held, size = [], 0
            if held:
                counts += trigram_counts("\n".join(held))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["i", "n"])

    counts = np.zeros(SYMBOLS**3, np.int64)
    for r in docs.select(text_col).mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():  # SYMBOLS**3 rows at most
        counts[r.i] = r.n
    return language_model(counts)


class Model:
    """A trained scorer: selected features with weights, and the constant."""

    def __init__(self, lm: list[float], weights: dict[str, float], constant: float) -> None:
        self.lm, self.weights, self.constant = lm, weights, constant
        self.stems = frozenset(f.removeprefix("=")[:3] for f in weights)

    def scorer(self):
        """score(text): probability of the label, over the whole text."""
        restore = Restorer(self.lm, self.stems)
        weights = self.weights

        def score(text: str) -> float:
            counts, total = restore.words(text)
            seen: Counter = Counter()
            for w, n in counts.items():
                for f in features(w):
                    if f in weights:
                        seen[f] += n
            z = self.constant + sum(weights[f] * value(n, total) for f, n in sorted(seen.items()))
            return float(1.0 / (1.0 + np.exp(-min(30.0, max(-30.0, z)))))

        return score


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, width: int = WIDTH) -> Model:
    """docs: doc_id, text. labels: doc_id, toxic. A bounded sample of labelled rows (the smallest hashes) trains.

    Without rows of both labels the model scores every document 0.
    """
    lm = corpus_model(docs)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = cut(spark, known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    rows = docs.select("doc_id", "text").where("doc_id is not null").join(F.broadcast(known), "doc_id")  # sample rows at most
    ids = rows.select("doc_id", F.xxhash64("text").alias("_h")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "_h").limit(sample)
    ids = F.broadcast(cut(spark, ids))  # sample rows at most, however often a doc_id is repeated
    rows = rows.withColumn("_h", F.xxhash64("text")).join(ids, ["doc_id", "_h"], "left_semi").select("toxic", "text")
    shared = spark.sparkContext.broadcast(lm)

    @tidy
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore, seen = Restorer(shared.value), [Counter(), Counter()]

        def flush() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in seen)], names=["f", "n0", "n1"])
            for c in seen:
                c.clear()
            return out

        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
                seen[y != 0].update({f for w in restore.words(t)[0] for f in features(w)} | {""})
                if len(seen[0]) + len(seen[1]) > 200_000:
                    yield flush()
        yield flush()

    t = rows.mapInArrow(tally, "f string, n0 bigint, n1 bigint").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    t = cut(spark, t.where(F.col("n0") + F.col("n1") >= LEAST))
    whole = t.where("f = ''").first()
    if whole is None or not whole.n0 or not whole.n1:
        return Model(lm, {}, -30.0)
    n0, n1 = float(whole.n0), float(whole.n1)
    a, b = F.col("n1").cast("double"), F.col("n0").cast("double")
    chi = (a * (n0 - b) - b * (n1 - a)) ** 2 / ((a + b) * (n0 + n1 - a - b + 0.5))
    names = [r.f for r in t.where("f <> ''").orderBy(chi.desc(), "f").limit(width).select("f").collect()]
    place = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})

    @tidy
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = place.value
        restore = Restorer(shared.value, frozenset(f.removeprefix("=")[:3] for f in at))
        for b in batches:
            ix, vs = [], []
            for t in _texts(b.column(1)):
                counts, total = restore.words(t)
                seen: Counter = Counter()
                for w, n in counts.items():
                    for f in features(w):
                        if f in at:
                            seen[at[f]] += n
                own = sorted(seen)
                ix.append(np.array(own, ">i4").tobytes())
                vs.append(np.array([value(seen[i], total) for i in own], ">f8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ix, pa.binary()), pa.array(vs, pa.binary())], names=["toxic", "i", "v"])

    # big-endian numbers, none negative: bytes sort as the lists of them do, and take less of the driver's memory
    got = sorted((r.toxic, bytes(r.i), bytes(r.v)) for r in rows.mapInArrow(vectors, "toxic int, i binary, v binary").collect())
    w, c = fit([(np.frombuffer(i, ">i4"), np.frombuffer(v, ">f8")) for _, i, v in got], np.array([y for y, _, _ in got], float), len(names))
    del got
    release()
    return Model(lm, {f: float(x) for f, x in zip(names, w, strict=True) if x}, c)


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """keep, _score (0 to 1) and _toxic (1 from the threshold on) for each row of docs (doc_id, text).

    A null or empty text gets the score of a text without words. Texts and tokens of any length are read whole. Repeated
    rows get equal scores; an empty table gives none. Only the text decides the score. Columns kept may have any names
    but _text, _score and _toxic.
    """
    model = spark.sparkContext.broadcast(train(spark, docs, labels))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = model.value.scorer()
        for b in batches:
            yield pa.array([score(t) for t in _texts(b)], pa.float64())
        del score  # and the words it knows
        release()

    # only texts go to Python; the other columns wait beside them
    score = F.arrow_udf(run, "double")(F.col("text"))
    return docs.select(*keep, score.alias("_score")).withColumn("_toxic", (F.col("_score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    s = scored(spark, docs, table(spark, sf_dir, "labels"), ["doc_id"])
    return s.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), F.col("_toxic").alias("predicted"))
