"""Hashes of k-mers: canonical and one-stranded, as column expressions and over whole sequences in numpy.

A strand's core hash is an exclusive or of one value for each place and nucleotide, so both forms look values up in
a table of k rows made from the kernels: place i of the forward strand holds the kernel stepped k - 1 - i times, the
reverse complement the complement's kernel stepped i times. The canonical hash adds both cores and mixes the sum.
Signed 64-bit columns hold the unsigned bit patterns.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Kernels of the nucleotides, shifts of a step, and the shifts and multipliers of the finalizer.
KERNELS = {
    "A": 0xC02069C411718AC9,
    "C": 0x29A37009B8869707,
    "G": 0x1A14AE384351C3F6,
    "T": 0x900E988F0E40231E,
    "N": 0x8C41F1213A951881,
}
STEP_LEFT, STEP_RIGHT = 17, 47
MIX_SHIFT, MIX_1, MIX_2 = 33, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
UNMIX_2, UNMIX_1 = 0x9CB4B2F8129337DB, 0x4F74430C22A54005

MASK = (1 << 64) - 1
_PAIR = {"A": "T", "C": "G", "G": "C", "T": "A", "N": "N"}


def step(u: int) -> int:
    u ^= u << STEP_LEFT & MASK
    return u ^ u >> STEP_RIGHT


def unstep(u: int) -> int:
    """The inverse of step; one doubled shift undoes the left one, as three times 17 is more than the 47 bits kept."""
    u ^= u >> STEP_RIGHT
    for s in (STEP_LEFT, 2 * STEP_LEFT):
        u ^= u << s & MASK
    return u


def mix(u: int) -> int:
    for m in (MIX_1, MIX_2):
        u = (u ^ u >> MIX_SHIFT) * m & MASK
    return u ^ u >> MIX_SHIFT


def unmix(u: int) -> int:
    for m in (UNMIX_2, UNMIX_1):
        u = (u ^ u >> MIX_SHIFT) * m & MASK
    return u ^ u >> MIX_SHIFT


def signed(u: int) -> int:
    return u - (1 << 64) if u >> 63 else u


@lru_cache(maxsize=64)
def place_values(k: int, seed: int = 0, letters: str = "ACGT") -> tuple[tuple[tuple[int, ...], ...], tuple[tuple[int, ...], ...]]:
    """For each place of a k-mer the value of each letter, on the forward strand and on the reverse complement."""
    stepped = {c: [KERNELS[c] * (2 * seed + 1) & MASK] for c in set(letters) | {_PAIR[c] for c in letters}}
    for values in stepped.values():
        for _ in range(k - 1):
            values.append(step(values[-1]))
    forward = tuple(tuple(stepped[c][k - 1 - i] for c in letters) for i in range(k))
    backward = tuple(tuple(stepped[_PAIR[c]][i] for c in letters) for i in range(k))
    return forward, backward


def hash_kmer(kmer: str, seed: int = 0, canonical: bool = True) -> int | None:
    """Unsigned hash of one k-mer in Python; None if it holds another letter than A, C, G, T."""
    at = ["ACGT".find(c) for c in kmer.upper()]
    if not at or -1 in at:
        return None
    f = b = 0
    for i, (x, y) in enumerate(zip(*place_values(len(at), seed), strict=True)):
        f ^= x[at[i]]
        b ^= y[at[i]]
    return mix((f + b if canonical else f) & MASK) or 1


# Arithmetic modulo 2^64 on bigint columns; plain + and * raise on overflow.


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value written once, so that nested uses do not multiply the expression."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def wrapping_sum(terms: list[Column]) -> Column:
    """Sum of a few terms modulo 2^64, by halves."""
    low32 = F.lit(0xFFFFFFFF).cast("long")
    low = high = F.lit(0).cast("long")
    for x in terms:
        low, high = low + x.bitwiseAND(low32), high + F.shiftrightunsigned(x, 32)
    return F.shiftleft(high + F.shiftrightunsigned(low, 32), 32).bitwiseOR(low.bitwiseAND(low32))


def wrapping_multiply(a: Column, m: int) -> Column:
    """a times a constant; products of 32 by 16 bits never overflow, and left shifts drop what does."""
    low, high = a.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned(a, 32)
    limb = lambda s: F.lit(m >> s & 0xFFFF).cast("long")
    terms = [F.shiftleft(low * limb(s), s) for s in (0, 16, 32, 48)] + [F.shiftleft(high * limb(s), s + 32) for s in (0, 16)]
    return F.get(F.transform(F.array(F.array(*terms)), lambda t: wrapping_sum([F.get(t, F.lit(i)) for i in range(len(terms))])), F.lit(0))


def unsigned_mod(u: Column, m: int) -> Column:
    """The unsigned bit pattern modulo m < 2^62."""
    n = F.lit(m).cast("long")
    return let(u, lambda x: F.pmod(F.pmod(F.shiftrightunsigned(x, 1), n) * 2 + x.bitwiseAND(F.lit(1).cast("long")), n))


def mixed(u: Column) -> Column:
    fold = lambda x: x.bitwiseXOR(F.shiftrightunsigned(x, MIX_SHIFT))
    for m in (MIX_1, MIX_2):
        u = let(let(u, fold), partial(wrapping_multiply, m=m))
    return let(u, fold)


def hash_column(kmer: Column, k: int, seed: int = 0, canonical: bool = True) -> Column:
    """Hash of a column of k-mers, all built-in expressions; null if a k-mer has not k letters of A, C, G, T."""

    upper = F.upper(kmer)

    def core(values: tuple[tuple[int, ...], ...]) -> Column:
        # one conditional for each place: no array is built and all of it stays in generated code
        out = None
        for i, row in enumerate(values):
            c = F.substring(upper, i + 1, 1)
            v = F.when(c == "A", F.lit(signed(row[0])).cast("long"))
            for letter, x in zip("CGT", row[1:], strict=True):
                v = v.when(c == letter, F.lit(signed(x)).cast("long"))
            out = v if out is None else out.bitwiseXOR(v)
        return out

    forward, backward = place_values(k, seed)
    both = let(F.array(core(forward), core(backward)), lambda x: wrapping_sum([F.get(x, F.lit(0)), F.get(x, F.lit(1))]))
    h = let(mixed(both if canonical else core(forward)), lambda x: F.when(x == 0, F.lit(1).cast("long")).otherwise(x))
    return F.when((F.length(kmer) == k) & kmer.rlike("^[ACGTacgt]+$"), h)


def _codes(seq: str) -> np.ndarray:
    return _TABLE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]


_TABLE = np.full(256, 4, np.uint8)
for _i, _c in enumerate("ACGT"):
    _TABLE[ord(_c)] = _TABLE[ord(_c.lower())] = _i


def _np_mix(u: np.ndarray) -> np.ndarray:
    for m in (MIX_1, MIX_2):
        u = (u ^ u >> np.uint64(MIX_SHIFT)) * np.uint64(m)
    return u ^ u >> np.uint64(MIX_SHIFT)


def hash_windows(seq: str, k: int, seed: int = 0, canonical: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Starts and unsigned hashes of all windows of k letters A, C, G, T in a sequence."""
    c = _codes(seq)
    n = len(c) - k + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    bad = np.concatenate([[0], np.cumsum(c == 4)])
    starts = np.flatnonzero(bad[k:] == bad[:-k])
    c = np.minimum(c, 3)
    h = np.zeros(n, np.uint64)
    r = np.zeros(n, np.uint64)
    for i, (x, y) in enumerate(zip(*place_values(k, seed), strict=True)):
        w = c[i : i + n]
        h ^= np.array(x, np.uint64)[w]
        if canonical:
            r ^= np.array(y, np.uint64)[w]
    h = _np_mix(h + r)[starts]
    return starts, np.where(h == 0, np.uint64(1), h)


#: Longest k-mer that two bits a nucleotide fit into a bigint.
PACKED = 31


def packed_windows(seq: str, k: int, canonical: bool = True) -> np.ndarray:
    """Packed forms (see packed) of all windows of k letters A, C, G, T; canonical: the lesser of both strands."""
    c = _codes(seq)
    n = len(c) - k + 1
    if n < 1:
        return np.empty(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(c == 4)])
    f, r = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(k):
        w = c[i : i + n].astype(np.int64)
        f = f << 2 | w
        if canonical:
            r |= 3 - w << 2 * i
    return (np.minimum(f, r) if canonical else f)[bad[k:] == bad[:-k]]


def hash_packed(codes: np.ndarray, k: int, seed: int = 0, canonical: bool = True) -> np.ndarray:
    """Unsigned hashes of packed k-mers, equal to those of their letters."""
    h, r = np.zeros(len(codes), np.uint64), np.zeros(len(codes), np.uint64)
    for i, (x, y) in enumerate(zip(*place_values(k, seed), strict=True)):
        w = codes >> 2 * (k - 1 - i) & 3
        h ^= np.array(x, np.uint64)[w]
        if canonical:
            r ^= np.array(y, np.uint64)[w]
    h = _np_mix(h + r)
    return np.where(h == 0, np.uint64(1), h)


def more_hashes(h1: np.ndarray, h2: np.ndarray, count: int) -> list[np.ndarray]:
    """count hash values from two by xorshift128+."""
    out, s0, s1 = [h1, h2], h1, h2
    while len(out) < count:
        x = s1 ^ s1 << np.uint64(23)
        new = x ^ s0 ^ (x >> np.uint64(17)) ^ (s0 >> np.uint64(26))
        out.append(new)
        s0, s1 = x, new
    return out[:count]


def matrix_hash(kmer_bits: Column, rows: list[int]) -> Column:
    """Alternate hash over GF(2): exclusive or of the matrix rows that the set bits of the packed k-mer select."""
    out = F.lit(0).cast("long")
    for i, row in enumerate(rows):
        bit = F.shiftrightunsigned(kmer_bits, i).bitwiseAND(F.lit(1).cast("long"))
        out = out.bitwiseXOR(F.when(bit == 1, F.lit(signed(row)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def packed(kmer: Column) -> Column:
    """Two bits a nucleotide (A 0, C 1, G 2, T 3), the last one lowest; k of 31 or fewer."""
    return F.conv(F.translate(F.upper(kmer), "ACGT", "0123"), 4, 10).cast("long")


def bit_checksum(bits: str) -> int:
    """CRC-32 (polynomial EDB88320, start 0, no final inversion) of bits packed first bit highest, the last byte filled up."""
    crc = 0
    for i in range(0, len(bits), 8):
        crc ^= int(bits[i : i + 8].ljust(8, "0"), 2)
        for _ in range(8):
            crc = crc >> 1 ^ (0xEDB88320 if crc & 1 else 0)
    return crc


def _raw_crc(data: bytes, start: int = 0) -> int:
    """The checksum of bytes behind a start value, by zlib, whose inversions before and after are undone."""
    return zlib.crc32(data, start ^ 0xFFFFFFFF) ^ 0xFFFFFFFF


def chunk_checksum(at: np.ndarray, bits: int) -> int:
    """bit_checksum of a chunk of so many bits with ones at the given places."""
    row = np.zeros(-(-bits // 8) * 8, np.uint8)
    row[at] = 1
    return _raw_crc(np.packbits(row).tobytes())


def _times(matrix: list[int], v: int) -> int:
    out = 0
    for i, row in enumerate(matrix):
        if v >> i & 1:
            out ^= row
    return out


@lru_cache(maxsize=64)
def _zeros(count: int) -> tuple[int, ...]:
    """The matrix over bits that so many zero bytes apply to a checksum, by squaring."""
    if count == 0:
        return tuple(1 << i for i in range(32))
    if count == 1:
        return tuple(_raw_crc(b"\0", 1 << i) for i in range(32))
    half = _zeros(count // 2)
    both = [_times(half, x) for x in half]
    return tuple(_times(_zeros(1), x) for x in both) if count % 2 else tuple(both)


def joined_checksum(chunks: list[tuple[int, int]], num_bits: int, size: int) -> int:
    """Checksum of a vector from its chunks' numbers and checksums, in order; chunks that are missing hold zeros."""
    crc, at = 0, 0
    for chunk, own in chunks:
        end = min((chunk + 1) * size, num_bits)
        crc = _times(_zeros(-(-end // 8) - -(-at // 8)), crc) ^ own
        at = end
    return _times(_zeros(-(-num_bits // 8) - -(-at // 8)), crc)
