"""128-bit FNV-1a and what is built on it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Offset basis and prime of 128-bit FNV-1a.
OFFSET, PRIME, MASK = 0x6C62272E07BB014262B821756295C58D, (1 << 88) + 315, (1 << 128) - 1
SIGNATURE, BAND_ROWS = 64, 4


def fnv(data: bytes) -> int:
    """128-bit FNV-1a."""
    h = OFFSET
    for b in data:
        h = ((h ^ b) * PRIME) & MASK
    return h


def hash_of(t: Column) -> Column:
    """The same without leaving the JVM, for short strings: four 32-bit limbs folded over the bytes."""
    m = 0xFFFFFFFF
    start = [(OFFSET >> (32 * i)) & m for i in range(4)]
    hexed = F.hex(F.encode(t, "utf-8"))
    data = F.transform(F.sequence(F.lit(1), F.octet_length(t)), lambda i: F.conv(F.substring(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("long"))

    def step(s: Column, b: Column) -> Column:
        x = s[0].bitwiseXOR(b)
        a = x * 315
        c1 = s[1] * 315 + F.shiftright(a, 32)
        c2 = s[2] * 315 + F.shiftright(c1, 32) + F.shiftleft(x, 24)
        c3 = s[3] * 315 + F.shiftright(c2, 32) + F.shiftleft(s[1], 24)
        return F.transform(F.array(a, c1, c2, c3), lambda v: v.bitwiseAND(F.lit(m)))

    limbs = F.aggregate(data, F.array(*[F.lit(v).cast("long") for v in start]), step)
    text = F.lower(F.concat(*[F.lpad(F.hex(limbs[i]), 8, "0") for i in (3, 2, 1, 0)]))
    return F.when(t == "", f"{OFFSET:032x}").otherwise(text)


def short(h: Column) -> Column:
    """First eight hex characters."""
    return F.substring(h, 1, 8)


def fingerprint(code: Column, subject: Column) -> Column:
    """code:short hash of the subject."""
    return F.concat(code, F.lit(":"), short(hash_of(subject)))


def minhash(shingle_hashes: Column, seed: int = 0) -> Column:
    """64 minima of xxhash64(i, shingle hash); null for no shingles. JVM-side."""
    n = F.size(shingle_hashes)
    sig = F.transform(F.sequence(F.lit(seed), F.lit(seed + SIGNATURE - 1)), lambda i: F.array_min(F.transform(shingle_hashes, lambda h: F.xxhash64(i, h))))
    return F.when(n > 0, sig)


def exact_minhash(shingle_texts: list[str]) -> list[int]:
    """The bit-exact signature: top 64 bits of H(i:H(shingle)), minima over the shingles."""
    inner = [f"{fnv(s.encode()):032x}" for s in set(shingle_texts)]
    return [min((fnv(f"{i}:{h}".encode()) >> 64 for h in inner), default=2**64 - 1) for i in range(SIGNATURE)]


def bands(signature: Column) -> Column:
    """Sixteen keys of four values each."""
    return F.transform(F.sequence(F.lit(0), F.lit(SIGNATURE // BAND_ROWS - 1)), lambda b: F.xxhash64(b, F.slice(signature, b * BAND_ROWS + 1, BAND_ROWS)))


def estimated_similarity(a: Column, b: Column) -> Column:
    """Floor percent of equal places in two signatures."""
    return F.floor(F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda v: v)) * 100 / SIGNATURE).cast("int")


