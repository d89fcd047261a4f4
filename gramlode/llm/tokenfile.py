"""Binary token files: each document compressed alone with a shared zstandard dictionary, behind an offset index.

A shard is MAGIC, the SHA-256 of the dictionary, one zstandard frame for each document (its ids as little-endian
unsigned 32-bit integers), the index (for each document: id, has an id, end of its frame, number of ids; four signed
64-bit integers) and a footer (start of the index, documents, ids; three signed 64-bit integers). Shards follow each
other in ascending order of document id. One short document is read with two small reads: index entry and frame.
"""

from __future__ import annotations

import gc
import hashlib
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, table
from .files import made, opened, own_name, part_number

VOCABULARY, END_ID = "word_bpe_49k.json", 2
MAGIC = b"GRAMTOK1"
HEAD = len(MAGIC) + 32
#: Documents and their greatest length that the dictionary is trained on; its size; level of compression.
SAMPLE, SAMPLE_CHARS, DICTIONARY, LEVEL = 400, 8192, 64 << 10, 3
MAX_CACHE = 600_000
TAILS = (",", ".")
#: Letters whose lower case is one letter of their own: Latin ones, without the dotted capital I.
LETTERS = frozenset(c for c in map(chr, range(0x250)) if c.isalpha() and len(c.lower()) == 1 and c.lower().isalpha())


def byte_letters() -> dict[int, str]:
    """The byte-level spelling: printable Latin-1 bytes are themselves, the others get letters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = byte_letters()


class Encoder:
    """Ids of texts by the tokenizers library, as bytes.

    The vocabulary's rules never join characters across white space, so the library encodes each distinct piece
    between blanks and line ends once, and texts are put together from remembered pieces by Arrow. Letters that have a
    simple lower case are normalized here (LETTERS names them) and spelled in bytes, so that a second instance of the
    tokenizer, without normalizer and byte-level rule, takes them as bare words; every word ends in a piece with the
    end-of-word mark, which parts them again. A last comma or full stop behind such a letter is a run of its own, so
    pieces share the ids of their stems. All other pieces go to the library as they are, many at a time with a special
    token between them. Pieces are remembered in two tables: beyond a bound the newer one becomes the older, whose pieces
    move on when they are asked for again; so a full encoder looks up no more than the pieces of the call.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
        self.library, self.lean = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.lean.normalizer, self.lean.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        added = self.library.get_added_tokens_decoder()
        self.mark_id, self.mark = next(((i, t.content) for i, t in added.items() if t.special), (-1, ""))
        self.first = {t.content[:1] for t in added.values()}
        mark = self.library.model.end_of_word_suffix
        vocab = self.library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for p, i in vocab.items() if mark and p.endswith(mark)]] = True
        self.parted = bool(self.ends.any())

    def _split(self, names: list[str], ids: list[np.ndarray], last: np.ndarray, skip: int) -> None:
        """Remembers names by the ids of all of them; last: where each one's ids end, skip: ids between two of them."""
        if len(last) != len(names):
            raise ValueError("the encoded pieces cannot be told apart")
        raw = np.concatenate(ids).astype("<u4").tobytes() if ids else b""
        ends = (4 * last).tolist()
        self.known.update(zip(names, map(raw.__getitem__, map(slice, [0, *(e + 4 * skip for e in ends[:-1])], ends)), strict=True))

    def _words(self, words: list[str], spelled: list[str]) -> None:
        ids = [np.array(e.ids, "<u4") for e in self.lean.encode_batch_fast([" ".join(spelled[i : i + 512]) for i in range(0, len(spelled), 512)], add_special_tokens=False)]
        self._split(words, ids, np.flatnonzero(self.ends[np.concatenate(ids)]) + 1 if ids else np.empty(0, int), 0)

    def _others(self, pieces: list[str]) -> None:
        if not self.mark:
            return
        for i in range(0, len(pieces), 256):
            some = pieces[i : i + 256]
            ids = np.array(self.library.encode(self.mark.join(some), add_special_tokens=False).ids, "<u4")
            self._split(some, [ids], np.append(np.flatnonzero(ids == self.mark_id), len(ids)), 1)

    def _learn(self, new: list[str]) -> None:
        known = self.known
        words, others, tails = {}, set(), []
        for p in new:
            q, tail = (p[:-1], p[-1]) if p[-1:] in TAILS and p[-2:-1] in LETTERS else (p, "")
            if tail:
                tails.append((p, q, tail))
                if q in known:
                    continue
            if q.isalpha() and LETTERS.issuperset(q) and self.parted:
                words[q] = q.lower()
            else:
                others.add(q)
        if tails:
            others.update(t for t in TAILS if t not in known)
        low = sorted(set(words.values()) - known.keys())
        self._words(low, [w if w.isascii() else w.encode().decode("latin-1").translate(BYTE_LETTERS) for w in low])
        self._others([q for q in others if self.first.isdisjoint(q)])
        rest = [q for q in others if q not in known]
        for q, e in zip(rest, self.library.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[q] = np.array(e.ids, "<u4").tobytes()
        known.update(zip(words, map(known.__getitem__, words.values()), strict=True))
        for p, q, tail in tails:
            known[p] = known[q] + known[tail]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Nothing here makes reference cycles; the collector would only walk the large dictionaries again and again."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._texts(texts)
        finally:
            if collecting:
                gc.enable()

    def _texts(self, texts: pa.Array) -> list[bytes]:
        import pyarrow.compute as pc

        pieces = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        coded = pieces.flatten().dictionary_encode()
        used = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > MAX_CACHE:
            self.older = {p: x for p, x in self.known.items() if len(p) <= 64}
            self.known = {}
        own = list(map(self.known.get, used))
        lost = [k for k, x in enumerate(own) if x is None]
        if lost and self.older:
            again = [used[k] for k in lost]
            self.known.update((p, x) for p, x in zip(again, map(self.older.get, again), strict=True) if x is not None)
        self._learn([used[k] for k in lost if used[k] not in self.known])
        for k in lost:
            own[k] = self.known[used[k]]
        ids = pa.array(own, pa.large_binary()).take(coded.indices)
        ends = np.append(0, np.cumsum(np.asarray(pc.binary_length(ids), np.int64)))
        at = ends[np.asarray(pieces.offsets) - pieces.offsets[0].as_py()]
        raw = memoryview(ids.buffers()[2] or b"")
        return [raw[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


@lru_cache(maxsize=1)
def encoder(vocabulary: str) -> Encoder:
    """The process's encoder: a Python worker takes many tasks, and the words of one are mostly those of the next."""
    return Encoder(vocabulary)


def groups(column: pa.Array, size: int = 8 << 20) -> Iterator[pa.Array]:
    """A text column in slices of about so many bytes."""
    import pyarrow.compute as pc

    at = np.append(0, np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64)))
    k = 0
    while k < len(column):
        to = max(k + 1, int(np.searchsorted(at, at[k] + size, "right")) - 1)
        yield column.slice(k, to - k)
        k = to


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int, sample: int = SAMPLE) -> bytes:
    """A dictionary trained on a bounded sample of documents: short ones, and slices of long ones where those are few.

    Where the sample is too small to train on, its ids themselves are the dictionary; without any text it is empty.
    """
    import zstandard

    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            for g in groups(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([x + end for x in enc.encode(g)], pa.binary())], names=["ids"])

    sliced = docs.where("text <> ''").select("doc_id", F.length("text").alias("_n"), F.substr("text", F.lit(1), F.lit(SAMPLE_CHARS)).alias("text"))
    some = sliced.orderBy(F.col("_n") > SAMPLE_CHARS, F.xxhash64("doc_id"), "doc_id", "text").limit(sample)
    ids = sorted(bytes(r.ids) for r in some.select("text").mapInArrow(run, "ids binary").collect())  # sample rows of bounded length
    try:
        return zstandard.train_dictionary(DICTIONARY, ids).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(ids)[-DICTIONARY:]


def write(spark: SparkSession, docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> list[dict]:
    """docs: doc_id, text (columns of other names, whatever they are, are ignored). Writes shards in ascending doc_id
    order (null first; ties by text).

    A null or empty text is the end id alone, repeated rows are documents each, a text of any length is one frame, and
    an empty table writes no shard with documents.

    Returns what the files hold, in order: path, docs, ids and start (ids before it) of each shard, and the path of
    the dictionary. One short row for each shard reaches the driver.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    made(folder)
    words = train_dictionary(rows, vocabulary, end_id)
    digest = hashlib.sha256(words).digest()
    dictionary = f"{folder}/dictionary-{digest.hex()}"
    store, path = opened(dictionary)
    with store.open_output_stream(path) as f:
        f.write(words)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, pack = encoder(vocabulary), zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words) if words else None, write_content_size=True)
        name, index, at, total = own_name(folder, "shard"), [], HEAD, 0
        store, path = opened(name)
        with store.open_output_stream(path) as f:
            f.write(MAGIC + digest)
            for b in batches:
                ids = iter(b.column(0).to_pylist())
                for g in groups(b.column(1)):
                    for x in enc.encode(g):
                        frame, doc = pack.compress(x + end), next(ids)
                        f.write(frame)
                        at += len(frame)
                        total += len(x) // 4 + 1
                        index.append((doc or 0, doc is not None, at, len(x) // 4 + 1))
            f.write(np.array(index, "<i8").tobytes() + np.array([at, len(index), total], "<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([part_number()], pa.int32()), pa.array([name]), pa.array([len(index)]), pa.array([total])], names=["part", "path", "docs", "ids"])

    head = F.substr("text", F.lit(1), F.lit(32))  # parts the rows of one doc_id; in the order of their texts
    sorted_rows = rows.repartitionByRange("doc_id", head).sortWithinPartitions("doc_id", "text")
    shards = sorted((r.asDict() for r in sorted_rows.mapInArrow(run, "part int, path string, docs long, ids long").collect()), key=lambda r: r["part"])
    start = 0
    for s in shards:
        s |= {"start": start, "dictionary": dictionary}
        start += s["ids"]
    return [s for s in shards if s["docs"]]


@lru_cache(maxsize=4)
def _unpacker(dictionary: str):
    import zstandard

    store, path = opened(dictionary)
    with store.open_input_stream(path) as f:
        words = f.read()
    return hashlib.sha256(words).digest(), zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)


def _index(f) -> np.ndarray:
    at, docs, _ = np.frombuffer(f.read_at(24, f.size() - 24), "<i8")
    return np.frombuffer(f.read_at(int(docs) * 32, int(at)), "<i8").reshape(-1, 4)


def fetch(path: str, dictionary: str, n: int) -> np.ndarray:
    """The ids of the n-th document of a shard, by its index entry."""
    digest, unpack = _unpacker(dictionary)
    store, local = opened(path)
    with store.open_input_file(local) as f:
        if f.read_at(HEAD, 0) != MAGIC + digest:
            raise ValueError(f"{path} was not written with {dictionary}")
        at = int(np.frombuffer(f.read_at(8, f.size() - 24), "<i8")[0])
        start = HEAD if n == 0 else int(np.frombuffer(f.read_at(8, at + 32 * (n - 1) + 16), "<i8")[0])
        to = int(np.frombuffer(f.read_at(8, at + 32 * n + 16), "<i8")[0])
        return np.frombuffer(unpack.decompress(f.read_at(to - start, start)), "<u4")


def read(spark: SparkSession, shards: list[dict], with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document of the shards, from the files alone.

    One row for each document written, null and repeated doc_ids too; no shards give no rows.
    """
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if not shards:
        return spark.createDataFrame([], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.to_pylist():
                digest, unpack = _unpacker(s["dictionary"])
                store, path = opened(s["path"])
                with store.open_input_file(path) as f:
                    if f.read_at(HEAD, 0) != MAGIC + digest:
                        raise ValueError(f"{s['path']} was not written with {s['dictionary']}")
                    index, at, start = _index(f), HEAD, s["start"]
                    for k in range(0, len(index), 1000):
                        rows = []
                        to = int(index[min(k + 1000, len(index)) - 1, 2])
                        block, base = f.read_at(to - at, at), at
                        for doc, known, end, n in index[k : k + 1000].tolist():
                            ids = unpack.decompress(block[at - base : end - base])
                            rows.append({"doc_id": doc if known else None, "start": start, "n_tokens": n, "ids_crc32": zlib.crc32(ids)} | ({"ids": np.frombuffer(ids, "<u4").tolist()} if with_ids else {}))
                            at, start = end, start + n
                        schema = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(schema))

    listed = spark.createDataFrame([(s["path"], s["start"], s["dictionary"]) for s in shards], "path string, start long, dictionary string")
    return listed.repartition(len(shards)).mapInArrow(run, kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, write(spark, table(spark, sf_dir, "documents"), fresh_path(spark, "tokens")))
