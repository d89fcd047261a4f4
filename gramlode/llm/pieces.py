"""SentencePiece encoding and decoding as a relational lattice.

Texts are cut into words where no piece of the vocabulary can cross: before a run of blanks (or word signs), and between
ASCII signs and digits on one side and letters on the other. Every distinct word is encoded once: its substrings of
bounded length are exploded and joined to the piece table by equality, the edges found are grouped by word, and a
higher-order aggregate folds the lattice edge by edge, in the order of their ends.

The vocabulary is a byte-pair model, whose ids are those of a merge order and not of the best sum of scores. The fold
is a Viterbi fold all the same, with this path cost: 0 for two neighbouring pieces that the merges leave apart, and
infinite for two that a merge would join across their border. Merges work locally, so a path costs 0 exactly if it is
the merge order's result, and every place has one such path. Whether a merge joins two neighbours is read off the
lattice itself: an edge over their border joins them if its halves occur on the way to the two pieces (as last part of
the one, first part of the other) and it ranks before the merges that use those halves up. These limits are a fixed
table of the vocabulary.

Python workers cut texts into words by byte classes, without a copy, and match them to the dictionary by hash. The most
frequent words, up to a fixed number, are a sorted table that every worker loads once. Other words (and those of equal
hashes) are joined to the dictionary by the word itself, they alone, and a second pass encodes the texts that have them.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import alone, fresh_path, release, stored, table, tidy
from .files import opened
from .tokenfile import groups

MODEL = "piece_bpe_32k.model"
SIGN = "▁"
#: Most characters of a word whose edges are grouped into one row (the same fold runs over longer ones in Python, where
#: edges need not be held); most words of the frequent table (about 20 bytes each).
FOLD, FREQUENT = 255, 8_000_000
#: Words of a part whose lattices are grouped at once; each part's task also reads the table of limits.
PART = 16_000
#: Bytes of text that a worker cuts at a time.
GROUP = 4 << 20
#: Bytes of text that a worker encodes at a time, beside the frequent table.
SLICE = 1 << 20
#: Bytes of them whose classes are held at a time.
STEP = 256 << 10
#: A limit that no rank reaches.
NEVER = (1 << 31) - 1


@lru_cache(maxsize=2)
def processor(model: str):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model if os.path.isabs(model) else public_tokenizers.path(model))


@lru_cache(maxsize=2)
def pieces(model: str) -> dict[str, tuple[int, int]]:
    """Piece to id and rank (0 the best score) of all ordinary pieces."""
    sp = processor(model)
    own = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    rank = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in own}, reverse=True))}
    return {sp.id_to_piece(i): (i, rank[sp.get_score(i)]) for i in own}


@lru_cache(maxsize=2)
def byte_ids(model: str) -> tuple[int, ...]:
    sp = processor(model)
    return tuple(sp.piece_to_id(f"<0x{b:02X}>") for b in range(256))


def _merged(word: str, known: dict[str, tuple[int, int]]) -> list[tuple]:
    """The merge order on a short string: its parts as trees (start, end, rank, left part, right part)."""
    parts = [(i, i + 1, -1, None, None) for i in range(len(word))]
    while True:
        ranks = [(known[w][1], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (w := word[a[0] : b[1]]) in known]
        if not ranks:
            return parts
        r, k = min(ranks)
        parts[k : k + 2] = [(parts[k][0], parts[k + 1][1], r, parts[k], parts[k + 1])]


@lru_cache(maxsize=2)
def limits(model: str) -> dict[str, tuple[int, int, list[int], list[int]]]:
    """For each piece that merges can make: id, rank, and its limits by length of its last and of its first part.

    The limit is the rank of the merge that uses the part up (NEVER for the whole piece), and -1 where the merges never
    make that part. Characters that only longer pieces hold are listed with id -1.
    """
    known = pieces(model)
    out = {}
    for p, (i, r) in known.items():
        parts = _merged(p, known)
        if len(parts) == 1:
            last, first = [-1] * (len(p) + 1), [-1] * (len(p) + 1)
            for own, at in ((last, 4), (first, 3)):
                node, limit = parts[0], NEVER
                while node:
                    own[node[1] - node[0]] = limit
                    limit, node = node[2], node[at]
            out[p] = (i, r, last, first)
    for c in set("".join(known)) - out.keys():
        out[c] = (-1, NEVER, [-1, NEVER], [-1, NEVER])
    return out


@lru_cache(maxsize=2)
def lead_classes(model: str) -> np.ndarray:
    """Class of a character by its first UTF-8 byte: 0 blank, 1 letter (ASCII and U+00C0 to U+024F), 2 other ASCII
    character, 3 all else; words are cut before blanks and between classes 1 and 2. Where a piece of the vocabulary
    crosses such a cut, classes 1 and 2 are one."""
    out = np.full(256, 3, np.uint8)
    out[:128] = 2
    out[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = 1
    out[32] = 0
    pairs = [(a, b) for p in pieces(model) for a, b in zip(p, p[1:], strict=False)]
    if any(b == SIGN != a for a, b in pairs):
        raise ValueError("pieces of this model cross the borders of words")
    if any(a != SIGN and {int(out[x.encode()[0]]) for x in (a, b)} == {1, 2} for a, b in pairs):
        out[out == 2] = 1
    return out


def signed(texts: pa.Array) -> pa.Array:
    """Texts with a blank before and blanks for word signs, as they are cut; empty for null or empty."""
    import pyarrow.compute as pc

    t = pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), SIGN, " ")
    blank, bare = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    return pc.if_else(pc.equal(t, bare), t, pc.binary_join_element_wise(blank, t, bare))


def cut_words(texts: pa.Array, model: str, kinds: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """All words of signed texts one after another, and the number of words before each text and in all. With kinds (the
    model's lead_classes) the model is not loaded."""
    kinds = lead_classes(model) if kinds is None else kinds
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    raw = texts.buffers()[2] or pa.py_buffer(b"")
    data = np.frombuffer(raw, np.uint8, int(at[-1] - at[0]), int(at[0]))
    cut, before = np.zeros(len(data), bool), np.zeros(1, np.uint8)
    for a in range(0, len(data), STEP):  # what is held besides the words does not grow with the texts
        part = data[a : a + STEP]
        lead = np.flatnonzero((part & 0xC0) != 0x80)
        kind = np.append(before, kinds[part[lead]])
        pair, before = kind[1:] + kind[:-1] * 4, kind[-1:]
        cut[lead[((kind[1:] == 0) & (kind[:-1] != 0)) | (pair == 6) | (pair == 9)] + a] = True
    rel = at - at[0]
    cut[rel[:-1][np.diff(rel) > 0]] = True
    starts = np.flatnonzero(cut)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer((np.append(starts, len(data)) + at[0]).astype(np.int64)), raw)
    return words, np.searchsorted(starts, rel)


def hashes(words: pa.Array) -> np.ndarray:
    """64 bits for each word."""
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words.to_numpy(zero_copy_only=False)), np.uint64, len(words)).view(np.int64)


def word_counts(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """docs: one column, texts. w, h, n: distinct words (with blanks for word signs), their hash and how often."""

    kinds = lead_classes(model)

    def counted(texts: pa.Array) -> pa.RecordBatch:
        coded = cut_words(signed(texts), model, kinds)[0].dictionary_encode()
        n = np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary))
        return pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), pa.array(hashes(coded.dictionary)), pa.array(n)], names=["w", "h", "n"])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone(__name__)
        for b in batches:
            for g in groups(b.column(0), GROUP):
                yield counted(g)
                release()

    return docs.mapInArrow(run, "w string, h long, n long").groupBy("w").agg(F.first("h").alias("h"), F.sum("n").alias("n"))


def lattice(spark: SparkSession, words: DataFrame, model: str = MODEL) -> DataFrame:
    """words: w (distinct, with word signs, FOLD characters at most) and others. The same with edges: array<bigint>, for
    each piece in the word its end (from bit 48 on), start (40), place in the table of limits (20) and rank (0), so that
    they sort by end, the longest first.

    Dealt by word once, in parts of so many words that the edges of a part are grouped in memory: explode, broadcast
    join and grouping keep that dealing. Words without an edge are not returned.
    """
    places, known = _limit_tables(model)[2], limits(model)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), words.count() // PART)
    longest, own = max(map(len, known)), words.columns
    # the fixed vocabulary; as an Arrow table it needs no Python workers, which a list would start beside those of the texts
    p = F.broadcast(spark.createDataFrame(pa.table({"_p": [*places], "_r": [(i << 20) + known[k][1] for k, i in places.items()]})))
    e = words.repartition(parts, "w").select("*", F.explode(F.sequence(F.lit(0), F.length("w") - 1)).alias("_i"))
    e = e.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("w") - F.col("_i")))).alias("_k"))
    e = e.withColumn("_p", F.substr("w", F.col("_i") + 1, F.col("_k"))).join(p, "_p")
    packed = F.shiftleft((F.col("_i") + F.col("_k")).cast("long"), 48) + F.shiftleft(F.col("_i").cast("long"), 40) + F.col("_r")
    return e.select(*own, packed.alias("_e")).groupBy(*own).agg(F.collect_list("_e").alias("edges"))


@lru_cache(maxsize=2)
def _limit_tables(model: str) -> tuple[list[int], list[int], dict[str, int], int]:
    """limits as two flat lists, the place in them of each piece, and of a character without a piece. At a place
    stands the id (-1: none), then the limits by length of the part."""
    last, first, places = [], [], {}
    for p, (i, _, a, b) in limits(model).items():
        if i >= 0:
            places[p] = len(last)
            last += [i, *a[1:]]
            first += [i, *b[1:]]
    if len(last) >= 1 << 20:
        raise ValueError("the table of limits is too large for packed edges")
    return [*last, -1, NEVER], [*first, -1, NEVER], places, len(last)


def constant(values: list[int]) -> Column:
    """A constant array of ints, handed to the JVM as bytes and kept there as one block: a plan that holds it is printed
    again and again, and numbers that stand alone would be spelled out each time."""
    from pyspark import SparkContext
    from pyspark.sql.classic.column import Column as Classic

    jvm = SparkContext._jvm
    array = SparkContext._gateway.new_array(jvm.int, len(values))
    jvm.java.nio.ByteBuffer.wrap(bytearray(np.array(values, ">i4").tobytes())).asIntBuffer().get(array)
    block = jvm.org.apache.spark.sql.catalyst.expressions.UnsafeArrayData.fromPrimitiveArray(array)
    kind = jvm.org.apache.spark.sql.types.ArrayType(jvm.org.apache.spark.sql.types.DataType.fromDDL("int"), False)
    return Classic(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(jvm.org.apache.spark.sql.catalyst.expressions.Literal(block, kind)))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold(w: Column, edges: Column, model: str = MODEL) -> Column:
    """Ids of a word from its edges: one pass in the order of their ends.

    The state holds, for each place reached, the start of the last edge of its path (from bit 20 on) and that edge's place
    in the limits (0). An edge to a place that is reached already is passed over; else it is taken if the path to its start
    ends in a piece that the merges leave apart from it, as is true for one edge of each place. An edge of one character
    comes last to its place, so it is that one. A character that no piece equals is an edge of its own.
    """
    lasts, firsts, _, byte = _limit_tables(model)
    byte0, n, mask = byte_ids(model)[0], F.length(w), F.lit((1 << 20) - 1)
    singles = "".join(p for p, v in limits(model).items() if len(p) == 1 and v[0] >= 0)
    bare = F.transform(F.sequence(F.lit(1), n), lambda j: F.shiftleft(j.cast("long"), 48) + F.shiftleft((j - 1).cast("long"), 40) + F.lit((byte << 20) + (1 << 20) - 1))
    start, place = lambda v: F.shiftright(v, 20), lambda v: v.bitwiseAND(mask)

    def unpacked(e: Column) -> Column:
        own = F.shiftright(e, 20).bitwiseAND(F.lit((1 << 28) - 1)).cast("int")  # start and place, as the state holds them
        return F.struct(F.shiftright(e, 48).cast("int").alias("j"), F.shiftright(e, 40).bitwiseAND(F.lit(255)).cast("int").alias("i"), own.alias("own"), e.bitwiseAND(mask).cast("int").alias("rank"))

    every = F.transform(F.sort_array(F.when(F.translate(w, singles, "") == "", edges).otherwise(F.concat(edges, bare))), unpacked)

    def walk(every: Column, wide: Column, last: Column, first: Column) -> Column:
        def step(s: Column, e: Column) -> Column:
            i = e["i"]
            used = lambda c: F.get(last, place(F.get(s, i)) + (i - c["i"])) > c["rank"]
            starts = lambda c: F.get(first, place(e["own"]) + (c["j"] - i)) >= c["rank"]
            over = lambda c: (c["j"] > i) & (c["i"] < i) & (c["j"] <= e["j"]) & (c["i"] >= start(F.get(s, i))) & used(c) & starts(c)
            return F.when((F.size(s) > e["j"]) | ((i > 0) & (e["j"] > i + 1) & F.exists(wide, over)), s).otherwise(F.array_append(s, e["own"]))

        def path(s: Column) -> Column:
            def back(b: Column, k: Column) -> Column:
                raw, own = F.hex(F.encode(F.substr(w, k, F.lit(1)), "utf-8")), F.get(s, k)
                spelled = F.transform(F.sequence(F.lit(1), F.length(raw) - 1, F.lit(2)), lambda x: F.conv(F.substr(raw, x, F.lit(2)), 16, 10).cast("int") + byte0)
                ids = F.when(place(own) == byte, F.concat(spelled, b["ids"])).otherwise(F.array_prepend(b["ids"], F.get(last, place(own))))
                return F.when(b["k"] == k, F.struct(start(own).alias("k"), ids.alias("ids"))).otherwise(b)

            return F.aggregate(F.sequence(n, F.lit(1), F.lit(-1)), F.struct(n.alias("k"), F.array().cast("array<int>").alias("ids")), back, lambda b: b["ids"])

        return F.aggregate(every, F.array(F.lit(-1)), step, path)

    ways = lambda last, first: let(every, lambda x: let(F.filter(x, lambda e: e["j"] > e["i"] + 1), lambda wide: walk(x, wide, last, first)))
    return let(constant(lasts), lambda last: let(constant(firsts), lambda first: ways(last, first)))


@lru_cache(maxsize=2)
def _parted(model: str) -> tuple[dict[str, tuple[int, int, list, list]], int]:
    """limits with their parts as lists of length and limit, and the length of the longest piece."""
    part = lambda own: [(k, x) for k, x in enumerate(own) if x >= 0]
    known = limits(model)
    return {p: (i, r, part(last), part(first)) for p, (i, r, last, first) in known.items()}, max(map(len, known))


def fold_long(word: str, model: str = MODEL) -> list[int]:
    """The same fold over one word of any length: its edges are looked up as places come, in time linear in the word."""
    (known, longest), raw = _parted(model), byte_ids(model)
    starts, ends = [0], [[]]  # of the best path to each place: where its last edge starts, that edge's limits
    bare = [(1, NEVER)]
    for j in range(1, len(word) + 1):
        at, last = j - 1, bare
        for i in range(max(0, j - longest), j):
            p = word[i:j]
            if p in known:
                _, _, own_last, own_first = known[p]
                crossed = ((word[i - k : i + m], x, y) for k, x in ends[i] for m, y in own_first)
                if i == 0 or not any(c in known and known[c][1] < x and known[c][1] <= y for c, x, y in crossed):
                    at, last = i, own_last
                    break
        starts.append(at)
        ends.append(last)
    out, j = [], len(word)
    while j:
        i = starts[j]
        hit = known.get(word[i:j])
        out.append([hit[0]] if hit and hit[0] >= 0 else [raw[b] for b in word[i:j].encode("utf-8", "surrogatepass")])
        j = i
    return [x for ids in reversed(out) for x in ids]


def dictionary(spark: SparkSession, words: DataFrame, model: str = MODEL) -> DataFrame:
    """words: w (distinct, with blanks for word signs), h, n. Adds ids."""

    @tidy
    def python_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [fold_long(x.replace(" ", SIGN), model) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=["w", "h", "n", "ids"])

    words = words.select("w", "h", "n")
    singles = "".join(p for p, v in limits(model).items() if len(p) == 1 and v[0] >= 0)
    edged = (F.length("w") <= FOLD) & (F.translate(F.col("w"), singles + " ", "") != F.col("w"))  # some character is a piece
    grouped = lattice(spark, words.where(edged).select(F.translate("w", " ", SIGN).alias("w"), "h", "n"), model)
    folded = grouped.select(F.translate("w", SIGN, " ").alias("w"), "h", "n", fold(F.col("w"), F.col("edges"), model).alias("ids"))
    return folded.union(words.where(~edged).mapInArrow(python_fold, "w string, h long, n long, ids array<int>"))


_FREQUENT: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _frequent(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, offsets and ids of the frequent table, whose files are sorted by hash; loaded once by a worker, only the
    latest one is kept."""
    if path not in _FREQUENT:
        import pyarrow.parquet as pq
        from pyarrow import fs

        _FREQUENT.clear()
        store, local = opened(path)
        files = [pq.ParquetFile(store.open_input_file(f)) for f in sorted(x.path for x in store.get_file_info(fs.FileSelector(local)) if x.path.endswith(".parquet"))]
        rows = sum(f.metadata.num_rows for f in files)
        most = sum(f.metadata.row_group(i).column(1).num_values for f in files for i in range(f.metadata.num_row_groups))  # an empty list is one
        h, offsets, flat, at = np.empty(rows, np.int64), np.zeros(rows + 1, np.uint32), np.empty(most, np.uint16), 0
        for f in files:
            for b in f.iter_batches(50_000):
                to = at + b.num_rows
                h[at:to] = np.asarray(b.column(0))
                offsets[at + 1 : to + 1] = int(offsets[at]) + np.cumsum(np.diff(np.asarray(b.column(1).offsets)))
                flat[offsets[at] : offsets[to]] = np.asarray(b.column(1).flatten())
                at = to
            f.close()
            release()
        if (h[1:] <= h[:-1]).any():
            raise ValueError("the frequent table is not sorted")
        _FREQUENT[path] = (h, offsets, flat[: offsets[-1]])
    return _FREQUENT[path]


def _taken(index: np.ndarray, offsets: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the given entries one after another, and their numbers."""
    at, n = offsets[index].astype(np.int64), (offsets[index + 1] - offsets[index]).astype(np.int64)
    to = np.cumsum(n)
    return flat[np.repeat(at - (to - n), n) + np.arange(int(n.sum()))], n


def _encoded(texts: pa.Array, given: dict[str, list[int]], path: str, model: str, kinds: np.ndarray | None = None) -> tuple[pa.Array, list[list[str] | None]]:
    """Ids of texts (null where a word is neither in the table nor given), and the words that such a text lacks."""
    h, offsets, flat = _frequent(path)
    words, ends = cut_words(signed(texts), model, kinds)
    coded = words.dictionary_encode()
    asked, which = hashes(coded.dictionary), np.asarray(coded.indices, np.int64)
    at = np.minimum(np.searchsorted(h, asked), max(len(h) - 1, 0))
    miss = h[at] != asked if len(h) else np.ones(len(asked), bool)
    own, sizes = np.empty(0, np.uint16), np.zeros(len(asked), np.int64)
    if miss.any() and given:
        lost = np.flatnonzero(miss)
        filled = [given.get(w) for w in coded.dictionary.take(pa.array(lost)).to_pylist()]
        miss[lost[[x is not None for x in filled]]] = False
        place = len(offsets) - 1 + np.arange(sum(x is not None for x in filled))
        at[lost[[x is not None for x in filled]]] = place
        own = np.array([i for x in filled if x is not None for i in x], np.uint16)
        offsets = np.append(offsets, offsets[-1] + np.cumsum([len(x) for x in filled if x is not None]).astype(np.uint32))
        flat = np.append(flat, own)
    ids, sizes[~miss] = _taken(at[~miss], offsets, flat) if not miss.all() else (np.empty(0, np.uint16), 0)
    binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(asked), [None, pa.py_buffer(np.append(0, np.cumsum(2 * sizes)).astype(np.int64)), pa.py_buffer(ids.astype("<u2").tobytes())])
    bad = np.diff(np.append(0, np.cumsum(miss[which]))[ends]) > 0
    used = ~np.repeat(bad, np.diff(ends))
    taken = binary.take(pa.array(which[used]))
    to = np.append(0, np.cumsum(np.where(used, sizes[which], 0)))
    every = np.frombuffer(taken.buffers()[2] or b"", "<u2", int(to[-1])).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(to[ends], pa.int32(), mask=np.append(bad, False)) if bad.any() else pa.array(to[ends], pa.int32()), pa.array(every))
    lacks = [sorted(set(coded.dictionary.take(pa.array(np.unique(w[miss[w]]))).to_pylist())) if x else None for x, w in zip(bad, (which[i:j] for i, j in zip(ends, ends[1:], strict=False)), strict=True)] if bad.any() else [None] * len(bad)
    return lists, lacks


def _digest(texts: pa.Array, lists: pa.Array, model: str) -> list[tuple[int, int, bool]]:
    """n_pieces, ids_crc32 and round_trip for each text and its ids. What all ids write is put together by Arrow; only
    where that is not the text, byte for byte, is it decoded."""
    table, blank = _written(model), b" "
    at = np.asarray(lists.offsets, np.int64)
    ids = np.asarray(lists.values)[at[0] : at[-1]]
    rel, raw = at - at[0], memoryview(ids.astype("<u4").tobytes())
    wrote = table.take(pa.array(ids))
    ends = np.frombuffer(wrote.buffers()[1], np.int64, len(wrote) + 1, 8 * wrote.offset)[rel] if len(wrote) else rel
    data = memoryview(wrote.buffers()[2] or b"")

    def one(text: str | None, i: int, j: int, a: int, b: int) -> tuple[int, int, bool]:
        want, back = (text or "").replace(SIGN, " "), bytes(data[a:b])
        same = back == blank + want.encode("utf-8", "surrogatepass") or back.decode("utf-8", "replace").removeprefix(" ") == want
        return j - i, zlib.crc32(raw[4 * i : 4 * j]), same

    return list(map(one, texts.to_pylist(), rel.tolist(), rel[1:].tolist(), ends.tolist(), ends[1:].tolist()))


DIGEST = [T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("round_trip", T.BooleanType())]


def encode(spark: SparkSession, docs: DataFrame, keep: list[str], text_col: str = "text", model: str = MODEL, frequent: int = FREQUENT, digest: bool = False) -> DataFrame:
    """keep, ids (array<int>) for each row of docs: the ids that the library gives the whole text.

    With digest, keep ends in the text, and n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)
    and round_trip (decoding gives the text, word signs in it read as blanks) come instead of text and ids, from the
    same worker. A null or empty text has no ids. Texts and words of any length are encoded whole. Repeated rows get
    equal ids; an empty table gives none. The columns kept travel as one struct, so their names clash with nothing.
    """
    if processor(model).get_piece_size() >= 1 << 16:
        raise ValueError("the frequent table holds ids of 16 bits")
    if digest and keep[-1] != text_col:
        raise ValueError("with digest, the text is the last column kept")
    kept = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.fields
    kept = kept[:-1] if digest else kept
    row = F.struct(*[F.col(f"`{f.name}`") for f in kept]).alias("row")
    texts = F.col(f"`{text_col}`").alias("text")
    words = stored(spark, word_counts(docs.select(texts), model), "piece-counts")
    # the edges of a part are grouped in memory, not sorted; the plan's text, with the limits in it, is cut short
    own = {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": str(4 * PART), "spark.sql.maxPlanStringLength": "10000"}
    before = {c: spark.conf.get(c, None) for c in own}
    try:
        for c, x in own.items():
            spark.conf.set(c, x)
        known = stored(spark, dictionary(spark, words, model), "piece-words")
    finally:
        for c, x in before.items():
            spark.conf.set(c, x) if x is not None else spark.conf.unset(c)
    total = known.count()
    doubled = known.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h")
    top = known if total <= frequent else known.orderBy(F.col("n").desc(), "w").limit(frequent)
    complete = total <= frequent and doubled.isEmpty()
    top = top if complete else top.join(doubled, "h", "left_anti")
    path = fresh_path(spark, "piece-frequent")
    top.select("h", "ids").orderBy("h").write.parquet(path)
    rows, schema = docs.select(row, texts), docs.select(row).schema
    ids = T.StructField("ids", T.ArrayType(T.IntegerType()))
    out = T.StructType([*kept, *DIGEST] if digest else [*kept, ids])

    def finished(row: pa.Array, texts: pa.Array, lists: pa.Array) -> pa.RecordBatch:
        cols = row.flatten()
        if not digest:
            return pa.RecordBatch.from_arrays([*cols, lists], names=out.names)
        got = _digest(texts, lists, model)
        return pa.RecordBatch.from_arrays([*cols, *(pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.bool_())))], names=out.names)

    kinds = lead_classes(model)

    def encoded(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        alone(__name__)
        for b in batches:
            at = 0
            for g in groups(b.column(1), SLICE):
                part = b.slice(at, len(g))
                at += len(g)
                given = {x["w"]: x["ids"] for own in part.column(2).to_pylist() for x in own} if part.num_columns > 2 else {}
                lists, lacks = _encoded(g, given, path, model, kinds)
                if last:
                    yield finished(part.column(0), g, lists)
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), lists, g, pa.array(lacks, pa.list_(pa.string()))], names=["row", "ids", "text", "lost"])
                del lists, lacks, given, part
                release()

    if complete:
        return rows.mapInArrow(tidy(lambda b: encoded(b, True)), out)
    kind = T.StructType([schema[0], ids, T.StructField("text", T.StringType()), T.StructField("lost", T.ArrayType(T.StringType()))])
    first = stored(spark, rows.mapInArrow(tidy(lambda b: encoded(b, False)), kind), "piece-first")
    rest = stored(spark, first.where("ids is null").withColumn("key", F.monotonically_increasing_id()), "piece-rest")  # from here on the keys are fixed
    gone = rest.select("key", F.explode("lost").alias("w")).join(known.select("w", F.col("ids").alias("own")), "w")
    gone = gone.groupBy("key").agg(F.collect_list(F.struct("w", F.col("own").alias("ids"))).alias("given"))
    again = rest.join(gone, "key").select("row", "text", "given").mapInArrow(tidy(lambda b: encoded(b, True)), out)
    done = first.where("ids is not null").select("row", "text", "ids").mapInArrow(lambda batches: (finished(*b.columns) for b in batches), out)
    return done.unionByName(again)


@lru_cache(maxsize=2)
def piece_bytes(model: str) -> list[bytes]:
    """What each id writes; control ids write nothing."""
    sp = processor(model)
    own = pieces(model)
    out = [b""] * sp.get_piece_size()
    for p, (i, _) in own.items():
        out[i] = p.replace(SIGN, " ").encode()
    for b, i in enumerate(byte_ids(model)):
        out[i] = bytes([b])
    return out


@lru_cache(maxsize=2)
def _written(model: str) -> pa.Array:
    return pa.array(piece_bytes(model), pa.large_binary())


def decode_ids(ids: list[int], model: str = MODEL) -> str:
    """Text of ids: pieces by the piece table, runs of byte ids as UTF-8, without the blank that encoding puts first."""
    return b"".join(map(piece_bytes(model).__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def decoded(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """encoded with the text of its ids (array<int>) in the column text, in place of one that is there; null for null.

    Byte ids that are no UTF-8 give the replacement character. An empty list gives an empty text; rows stay as they are.
    """
    encoded = encoded.drop("text")
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if x is None else decode_ids(x, model) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark, table(spark, sf_dir, "documents"), ["doc_id", "text"], digest=True)
