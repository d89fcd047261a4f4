"""Secret scans: patterned secrets, and random strings exposed by a tokenizer's low yield on them.

A byte-pair vocabulary spends about one token on four characters of words, names and most identifiers, but one on two
or fewer characters of random text. Strings of key characters are encoded with a tiktoken vocabulary; those with few
characters per token are secrets, unless they are digests of a known length, UUIDs, or identifiers made of
words. Parts between signs are tested on their own where the whole string is not exposed.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_model, release, table, tidy

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fewest characters of a candidate; it is exposed at this many characters per token or fewer.
LEAST, RATIO = 20, 2.0

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}")
UUID = re.compile(r"[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
DIGEST = re.compile(r"[0-9a-fA-F]+")
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
PART = re.compile(r"[^+/_=-]+")
SIGNS = "+/_=-"
KINDS = ("assign", "access", "hex", "random")

Span = tuple[int, int, str]


@kept_model(4)
def encoding(vocabulary: str):
    """The tiktoken encoding of a vocabulary file, given by its name in the public tokenizers or by its path."""
    import os

    import public_tokenizers
    import tiktoken

    path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[Span]:
    """Patterned secrets by start, then kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def tokens(s: str, enc) -> int:
    return len(enc.encode_ordinary(s))


def plain(part: str, enc, ratio: float = RATIO) -> bool:
    """True for a part of digits, for letters that the tokenizer shows as words, and for repeats of three letters or fewer.

    Capitals are read as small letters.
    """
    if not part.isalpha():
        return part.isdigit()
    if len(set(part)) <= 3:
        return True
    n = tokens(part.lower() if part.isupper() else part, enc)
    return n == 1 or len(part) > ratio * n


def ordinary(s: str, enc, ratio: float = RATIO) -> bool:
    """True for digests of a known length, UUIDs, and identifiers: words and numbers joined by signs."""
    if UUID.fullmatch(s) or (len(s) in DIGEST_LENGTHS and DIGEST.fullmatch(s)):
        return True
    return all(plain(p, enc, ratio) for p in PART.findall(s))


def exposed(s: str, enc, ratio: float = RATIO) -> bool:
    return not ordinary(s, enc, ratio) and len(s) <= ratio * tokens(s, enc)


def exposed_spans(s: str, enc, ratio: float = RATIO) -> list[tuple[int, int]]:
    """Where a string of key characters is exposed: as a whole, else without plain parts at its ends, else in single parts."""
    if ordinary(s, enc, ratio):
        return []
    parts = [m.span() for m in PART.finditer(s)]
    odd = [(a, b) for a, b in parts if not plain(s[a:b], enc, ratio)]
    core = (odd[0][0], odd[-1][1])
    for a, b in ((0, len(s)), core):
        if b - a >= LEAST and exposed(s[a:b], enc, ratio):
            return [(a, b)]
    return [(a, b) for a, b in odd if b - a >= LEAST and exposed(s[a:b], enc, ratio)]


def random_spans(text: str, enc, taken: list[Span], ratio: float = RATIO) -> list[Span]:
    """Random strings that overlap none of the spans taken, which are sorted by start.

    Where a span covers a part of a candidate, what it leaves on either side is tested on its own. Candidates and spans
    are walked through together once.
    """
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        free, at, j = [], s, k
        while j < len(taken) and taken[j][0] < e:
            if taken[j][0] > at:
                free.append((at, taken[j][0]))
            at = max(at, taken[j][1])
            j += 1
        free.append((at, e))
        for a, b in free:
            while a < b and a > s and text[a] in SIGNS:  # signs that part the rest from a span are not part of it
                a += 1
            while a < b < e and text[b - 1] in SIGNS:
                b -= 1
            if b - a >= LEAST:
                out += [(a + x, a + y, "random") for x, y in exposed_spans(text[a:b], enc, ratio)]
    return out


def covered(spans: list[Span]) -> list[Span]:
    """Sorted spans joined where they overlap, so that neither starts nor ends go back."""
    out: list[Span] = []
    for s, e, k in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]), k)
        else:
            out.append((s, e, k))
    return out


def find(text: str, enc, ratio: float = RATIO) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans; both by start, then kind."""
    base = base_spans(text)
    return base, sorted(base + random_spans(text, enc, covered(base), ratio), key=lambda s: (s[0], KINDS.index(s[2])))


def shown(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str = VOCABULARY, ratio: float = RATIO) -> DataFrame:
    """keep, n_assign, n_access, n_hex, base_sha256, spans, n_spans for each row of docs.

    Whole texts of any length are scanned in one pass. A null or empty text has no spans. Rows are scanned one by one,
    so repeated rows and ties get equal results; an empty table gives none. Other columns are not read; kept ones may
    have any name but those of the results.
    """
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in b.column(b.num_columns - 1):
                base, every = find(t.as_py(), enc, ratio)
                kinds = [k for _, _, k in base]
                for c, v in zip(cols, (*(kinds.count(k) for k in KINDS[:3]), hashlib.sha256(shown(base).encode()).hexdigest(), shown(every), len(every)), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, cols, kinds)], names=[*b.schema.names[:-1], "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_spans"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{own}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_spans bigint")


def masked(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, ratio: float = RATIO) -> DataFrame:
    """docs with every secret in the text replaced by [SECRET]; null texts stay null, all other columns as they are."""
    at = docs.columns.index(text_col)

    def clean(t: str | None, enc) -> str | None:
        spans = find(t, enc, ratio)[1] if t else []
        out, end = [], 0
        for s, e, _ in spans:
            if s >= end:
                out += [t[end:s], "[SECRET]"]
            end = max(end, e)
        return "".join([*out, t[end:]]) if spans else t

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for b in batches:
            texts = pa.array([clean(t.as_py(), enc) for t in b.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)
            del texts
            release()

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), ["doc_id"])
