"""Texts decoded with the wrong character encoding."""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLUSH = 1 << 20  # pairs that a task holds before it counts them
# Names of 8-bit encodings. Texts read under one of the first row that were
# written in UTF-8, or under the second row written in the third.
READ_UTF8 = ["cp1252", "latin_1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "iso8859_2", "cp1253", "cp1254", "iso8859_15", "koi8_r", "cp866"]
READ_8BIT = ["cp1252", "cp1250", "mac_roman", "cp437", "cp850"]
WRITTEN_8BIT = ["cp1252", "cp1250", "mac_roman", "cp850", "cp437"]
WEAK = -5.0  # nats that a run may speak against the way that explains the rest of its text
BOUND = 6.0  # nats of mutual information between the characters of a sequence that stands for one that no text holds
LOST = "�"
_LOST = ord(LOST)
_ENTITY = re.compile(r"&(?:[A-Za-z]{2,8}|#[0-9]{2,5}|#x[0-9A-Fa-f]{2,4});")


_SINGLE = (1 << 21) - 1


def _keys(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Keys of pairs of code points; single characters have b = 2**21 - 1."""
    return (a.astype(np.int64) << 21) | b


def _chunks(texts: Iterator[str]) -> Iterator[list[str]]:
    """Texts by some FLUSH characters at a time; a longer text goes alone."""
    held: list[str] = []
    size = 0
    for t in texts:
        if held and size + len(t) > FLUSH:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of texts in a row, each between two spaces."""
    return np.frombuffer(f" {'  '.join(texts)} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def pair_counts(df: DataFrame, text: str) -> np.ndarray:
    """Exact counts of adjacent characters and single characters over all texts: the sorted keys, the
    count of each, and as the last element the number of characters.

    Pairs of two ASCII characters are counted in a table of 128 x 128, others per FLUSH
    pairs, then per key; one row per distinct pair reaches the driver, 16 bytes each.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ascii_counts, ascii_pairs, held, size, n = np.zeros(128, np.int64), np.zeros(1 << 14, np.int64), [], 0, 0

        def counted() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts.astype(np.int64))], names=["key", "n"])

        for b in batches:
            for texts in _chunks(t for t in b.column(0).to_pylist() if t):
                c = _codes(texts)
                n += len(c) - 2 * len(texts)
                low = c < 128
                ascii_counts += np.bincount(c[low], minlength=128)
                ascii_counts[32] -= 2 * len(texts)
                plain = low[:-1] & low[1:]
                ascii_pairs += np.bincount((c[:-1][plain].astype(np.int64) << 7) | c[1:][plain], minlength=1 << 14)
                ascii_pairs[(32 << 7) | 32] -= len(texts) - 1  # between two texts
                i = np.flatnonzero(~plain)
                held += [_keys(c[~low], _SINGLE), _keys(c[i], c[i + 1].astype(np.int64))]
                size += len(held[-2]) + len(held[-1])
                if size >= FLUSH:
                    yield counted()
                    held, size = [], 0
        yield counted()
        codes, both = np.flatnonzero(ascii_counts), np.flatnonzero(ascii_pairs)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[_keys(codes, _SINGLE), _keys(both >> 7, both & 127), -1]), pa.array(np.r_[ascii_counts[codes], ascii_pairs[both], n])], names=["key", "n"])

    t = df.select(text).mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, counts = np.asarray(t.column("key")), np.asarray(t.column("n"))
    order = np.argsort(keys)
    order = order[keys[order] >= 0]
    return np.r_[keys[order], counts[order], counts[keys < 0].sum()].astype(np.int64)


class PairModel:
    """Mutual information of adjacent characters, and what follows from it.

    ``mi(a, b)`` is log p(a,b) / p(a)p(b). A damaged sequence is its own best neighbour, so
    the mutual information inside it is high where damage is frequent; what is improbable
    is its rare characters beside ordinary ones. ``surprise`` therefore takes the mutual
    information off the rarity of the second character: -log p(b|a) = -log p(b) - mi(a, b).
    """

    def __init__(self, counts: np.ndarray, smooth: float = 0.5) -> None:
        half = len(counts) // 2
        self.keys, self.counts, self.n, self.smooth = counts[:half], counts[half:-1], max(int(counts[-1]), 1), smooth
        self._c: dict[tuple[int, int], float] = {}
        self._s: dict[tuple[int, int], float] = {}
        self._plain: np.ndarray | None = None
        self._odd: np.ndarray | None = None

    def count(self, a: int, b: int) -> float:
        v = self._c.get((a, b))
        if v is None:
            key = (a << 21) | b
            i = int(np.searchsorted(self.keys, key))
            v = float(self.counts[i]) if i < len(self.keys) and self.keys[i] == key else 0.0
            self._c[(a, b)] = v
        return v

    def rarity(self, b: int) -> float:
        return -math.log((self.count(b, _SINGLE) + self.smooth) / (self.n + 1))

    def mi(self, a: int, b: int) -> float:
        pb = (self.count(b, _SINGLE) + self.smooth) / (self.n + 1)
        return math.log((self.count(a, b) + self.smooth * pb) / (self.count(a, _SINGLE) + self.smooth) / pb)

    def surprise(self, a: int, b: int) -> float:
        v = self._s.get((a, b))
        if v is None:
            # a replacement character is no letter of its word, however often the word is damaged: nothing is taken off its rarity
            lost = _LOST in (a, b)
            v = self._s[(a, b)] = self.rarity(_LOST) if lost else self.rarity(b) - self.mi(a, b)
        return v

    def _counts(self, keys: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return np.where(self.keys[i] == keys, self.counts[i], 0).astype(float) if len(self.keys) else np.zeros(len(keys))

    def surprises(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """surprise() of many pairs."""
        of_b = (self._counts(_keys(b, _SINGLE)) + self.smooth) / (self.n + 1)
        out = -np.log((self._counts(_keys(a, b)) + self.smooth * of_b) / (self._counts(_keys(a, _SINGLE)) + self.smooth))
        out[(a == _LOST) | (b == _LOST)] = self.rarity(_LOST)
        return out

    def odd(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Surprise of pairs that aren't both ASCII. The pairs of the corpus are scored once, for all texts."""
        if self._odd is None:
            self._odd = self.surprises(self.keys >> 21, self.keys & _SINGLE)
        keys = _keys(a, b)
        i = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[i] == keys if len(self.keys) else np.zeros(len(keys), bool)
        out = self._odd[i] if len(self.keys) else np.zeros(len(keys))
        if not known.all():
            out[~known] = self.surprises(a[~known], b[~known])
        return out

    def plain(self) -> np.ndarray:
        """Surprise of every pair of ASCII characters, as one table."""
        if self._plain is None:
            k = np.arange(1 << 14)
            self._plain = self.surprises(k >> 7, k & 127)
        return self._plain

    def chain(self, s: str, stand_in: dict[str, str] | None = None) -> float:
        """Surprise of a text; characters of ``stand_in`` count as their sequence does from outside."""
        if stand_in:
            first, last = [ord(stand_in.get(x, x)[0]) for x in s], [ord(stand_in.get(x, x)[-1]) for x in s]
            return sum(map(self.surprise, last, first[1:]))
        c = [ord(x) for x in s]
        return sum(map(self.surprise, c, c[1:]))


def maximal_segments(scores: list[float]) -> list[tuple[int, int]]:
    """Start and end of every maximal scoring segment: one that no longer or shorter neighbour outscores.

    Linear: each candidate knows the nearest one before it that begins on a lower total, so none is passed twice.
    """
    begin: list[int] = []
    end: list[int] = []
    low: list[float] = []
    high: list[float] = []
    lower: list[int] = []
    total = 0.0
    for i, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        first, least = i, before
        j = len(begin) - 1
        while True:
            while j >= 0 and low[j] >= least:
                j = lower[j]
            if j < 0 or high[j] >= total:
                break
            first, least = begin[j], low[j]
            del begin[j:], end[j:], low[j:], high[j:], lower[j + 1 :]
            j = lower.pop()
        begin.append(first)
        end.append(i + 1)
        low.append(least)
        high.append(total)
        lower.append(j)
    return list(zip(begin, end))


def improbable_runs(model: PairModel, texts: list[str], typical: float) -> list[list[tuple[int, int]]]:
    """For each text its runs of characters beyond ASCII that maximal scoring segments of the whole text reach.

    Every adjacent pair of a text scores its surprise less ``typical``. A stretch of ASCII
    pairs between two others counts with its sum, as one element: no wrong decoding ends inside it. All
    texts are scored at once; nothing joins two of them. Elements that aren't positive begin and end no segment, so
    those in a row are one.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    c = _codes(texts)
    beyond = np.flatnonzero(c > 127)
    if not len(beyond):
        return out
    # pair i stands between the characters i and i + 1
    mark = np.zeros(len(c), bool)
    mark[beyond - 1] = mark[beyond] = True
    odd = np.flatnonzero(mark)
    own = model.odd(c[odd].astype(np.int64), c[odd + 1].astype(np.int64)) - typical
    ascii_only = np.minimum(c, 127).astype(np.int64)
    scored = model.plain()[(ascii_only[:-1] << 7) | ascii_only[1:]] - typical
    scored[odd] = 0.0
    sums = np.cumsum(scored)
    first = np.cumsum([1, *[len(t) + 2 for t in texts[:-1]]])  # where each text begins
    of = np.searchsorted(first, odd + 1, side="right") - 1
    scores = np.empty(2 * len(odd) - 1)
    scores[::2], scores[1::2] = own, sums[odd[1:] - 1] - sums[odd[:-1]]
    scores[1::2][of[1:] != of[:-1]] = 0.0  # between two texts
    good = np.flatnonzero(scores > 0)
    if not len(good):
        return out
    total = np.cumsum(scores)
    short = np.empty(2 * len(good) - 1)
    short[::2], short[1::2] = scores[good], total[good[1:] - 1] - total[good[:-1]]
    step = np.zeros(len(scores) + 1, np.int64)
    cuts = np.flatnonzero(np.diff(of[(good + 1) // 2], prepend=-1, append=len(texts)))  # where the elements of a text begin
    for k, m in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        for a, z in maximal_segments(short[2 * k : 2 * m - 1].tolist()):
            step[good[k + a // 2]] += 1
            step[good[k + (z - 1) // 2] + 1] -= 1
    at = odd[np.cumsum(step[:-1])[::2] > 0]
    edge = np.flatnonzero(np.diff(beyond, prepend=-2) > 1)
    starts, ends = beyond[edge], beyond[np.r_[edge[1:], len(beyond)] - 1] + 1
    hit = np.searchsorted(at, ends - 1, side="right") > np.searchsorted(at, starts - 1)
    for a, z, i in zip(starts[hit].tolist(), ends[hit].tolist(), (np.searchsorted(first, starts[hit], side="right") - 1).tolist()):
        out[i].append((a - int(first[i]), z - int(first[i])))
    return out


@lru_cache(None)
def _bytes_of(encoding: str) -> dict[str, int]:
    """Byte of each character; a byte that the encoding leaves open stands for itself."""
    out = {}
    for i in range(128, 256):
        try:
            out[bytes([i]).decode(encoding)] = i
        except UnicodeDecodeError:
            out[chr(i)] = i
    if encoding == "cp1252":
        for i in range(0x80, 0xA0):
            out.setdefault(chr(i), i)
    return out


@lru_cache(None)
def _swap(read: str, written: str) -> dict[int, str]:
    out = {}
    for ch, i in _bytes_of(read).items():
        try:
            out[ord(ch)] = bytes([i]).decode(written)
        except UnicodeDecodeError:
            pass
    return out


def undo_utf8(s: str, read: str, lowered: bool = False) -> str:
    """Restores the UTF-8 sequences in s as read under ``read``; other characters stay.

    A space after a lead byte may stand for a no-break space. ``lowered``: the text was
    turned to lower case after the damage."""
    table = _bytes_of(read)

    def byte(ch: str, lead: bool) -> int | None:
        v = table.get(ch)
        if lowered and (v is None or lead):
            v = table.get(ch.upper(), v)
        return v

    out, i = [], 0
    while i < len(s):
        v = byte(s[i], True)
        n = 0 if v is None else 1 if 0xC2 <= v <= 0xDF else 2 if 0xE0 <= v <= 0xEF else 3 if 0xF0 <= v <= 0xF4 else 0
        seq = [v]
        for ch in s[i + 1 : i + 1 + n]:
            w = 0xA0 if ch == " " else byte(ch, False)
            if w is None or not 0x80 <= w <= 0xBF:
                if lowered and (w := table.get(ch.upper())) is not None and 0x80 <= w <= 0xBF:
                    seq.append(w)
                    continue
                break
            seq.append(w)
        if n and len(seq) == n + 1:
            try:
                got = bytes(seq).decode()
                out.append(got.lower() if lowered else got)
                i += n + 1
                continue
            except UnicodeDecodeError:
                pass
        out.append(s[i])
        i += 1
    return "".join(out)


def inverses(s: str) -> list[tuple[str, str]]:
    """(way, restored) for every inverse mapping that changes s, repeated ones included."""
    found: dict[str, str] = {}
    frontier = [("", s)]
    for _ in range(3):
        new = []
        for way, t in frontier:
            for e in READ_UTF8:
                for lowered in (False, True) if e in ("cp1252", "latin_1") else (False,):
                    if lowered and t != t.lower():
                        continue
                    r = undo_utf8(t, e, lowered)
                    if r != t and r not in found:
                        found[r] = f"{way}utf-8 read as {e}"
                        new.append((f"{found[r]}, ", r))
        frontier = new
    core = s.rstrip(" ")
    for read in READ_8BIT:
        for written in WRITTEN_8BIT:
            if read != written:
                r = core.translate(_swap(read, written)) + s[len(core) :]
                if r != s and r not in found:
                    found[r] = f"{written} read as {read}"
    return [(way, r) for r, way in found.items()]


@lru_cache(None)
def sequence_of(ch: str, way: str) -> str:
    """What a character becomes when it is decoded wrongly in that way, for ways of UTF-8."""
    s = ch
    for step in reversed(way.split(", ")):
        read: dict[int, str] = {}
        for c, i in _bytes_of(step.removeprefix("utf-8 read as ")).items():
            read.setdefault(i, c)
        s = "".join(read[i] if i > 127 else chr(i) for i in s.encode())
    return s


def stand_ins(model: PairModel, inside: str, fresh: list[str], way: str) -> dict[str, str]:
    """Of the restored characters that no text holds, those whose sequence in the text speaks
    for itself, with that sequence: three or four bytes of UTF-8 (two are formed by ordinary
    letters), no word, and characters that keep to each other (BOUND)."""
    out = {}
    for x in fresh:
        if ord(x) < 0x800 or model.count(ord(x), _SINGLE) or unicodedata.category(x) in ("Cn", "Co", "Cs", "Cc"):
            continue
        written = [sequence_of(x, way), sequence_of(x, way.replace("cp1252", "latin_1"))]  # cp1252 undoes both
        for s in [*written, *map(str.lower, written)]:
            word = s.isalpha() and (s.islower() or s.isupper() or s.istitle())
            if s in inside and not word and min(model.mi(ord(a), ord(b)) for a, b in zip(s, s[1:])) >= BOUND:
                out[x] = s
    return out


def _resolved(text: str) -> tuple[str, list[int] | None]:
    """The text with entities as the characters they name, and where each of its characters begins in the text as written."""
    named = [m for m in _ENTITY.finditer(text) if not html.unescape(m.group()).isascii()] if "&" in text else []
    if not named:
        return text, None
    out, at, i = [], [], 0
    for m in named:
        shown = html.unescape(m.group())
        out.append(text[i : m.start()])
        at += range(i, m.start())
        out.append(shown)
        at += [m.start()] * len(shown)
        i = m.end()
    out.append(text[i:])
    at += range(i, len(text) + 1)
    return "".join(out), at


def examine(model: PairModel, text: str, shown: str, at: list[int] | None, spans: list[tuple[int, int]], cache: dict, floor: float, typical: float) -> tuple[dict[str, float], list[tuple[int, int, dict[str, tuple[float, str]]]]]:
    """Evidence by way and the examined runs (start, end, {way: (gain, restored)}) of a text, of what _resolved()
    made of it, and of the spans that improbable_runs() found there."""
    seen: dict[tuple[str, str], float] = {}
    runs = []
    for a, z in spans:
        run = shown[a:z]
        space = " " if shown[z : z + 1] == " " else ""  # a no-break space may have become a space
        left, right = shown[a - 1 : a] or " ", shown[z + len(space) : z + len(space) + 1] or " "
        begin, end = (a, z + len(space)) if at is None else (at[a], at[z] + len(space))
        plain = at is None or text[begin : end - len(space)] == run
        known = (left, run + space, right, plain)
        got = cache.get(known)
        if got is None:
            got = cache[known] = _examine_run(model, left, run, space, right, plain, floor, typical)
        if got:
            runs.append((begin, end, got))
            for way, (gain, _) in got.items():
                if gain >= floor:
                    seen[way, run] = max(gain, seen.get((way, run), 0.0))
    evidence: dict[str, float] = {}
    for (way, _), gain in seen.items():  # a run counts once however often the text repeats it
        evidence[way] = evidence.get(way, 0.0) + gain
    return evidence, runs


def _examine_run(model: PairModel, left: str, run: str, space: str, right: str, plain: bool, floor: float, typical: float) -> dict[str, tuple[float, str]]:
    full = left + run + space + right
    if LOST in run:
        # what a replacement character stood for is unknown: typical characters in its place
        codes = [ord(x) for x in full]
        gain = sum(model.surprise(x, y) - typical for x, y in zip(codes, codes[1:]) if ord(LOST) in (x, y))
        return {"lost": (gain, run + space)} if gain >= min(floor, WEAK) else {}
    inside, before = run + space, model.chain(full)
    out = {}
    for way, restored in inverses(inside):
        multi = way.startswith("utf-8")
        if not multi and not plain:
            continue  # an entity was never read byte by byte
        fresh = [x for x in restored if ord(x) > 127 and x not in inside]
        known = stand_ins(model, inside, fresh, way) if multi else {}
        if len(fresh) < 3 and any(not model.count(ord(x), _SINGLE) and x not in known for x in fresh):
            continue  # one or two characters that no text holds and no bound sequence stands for are no restored text
        gain = before - model.chain(left + restored + right, known)
        if gain >= min(floor, WEAK) and gain > out.get(way, (-99.0, ""))[0]:
            out[way] = (gain, restored)
    return out


def repair_encoding(docs: DataFrame, key: str = "doc_id", text: str = "text", floor: float = 0.0, accept: float = 4.5, accept_utf8: float = 0.0, typical: float = 3.5) -> DataFrame:
    """One row per damaged text: ``doc_id, way, evidence, n_runs, n_lost, text``.

    A text is damaged if some way of wrong decoding explains runs of it, or replacement characters stand where
    typical characters would be likelier, with enough nats of evidence in all: ``accept`` for 8-bit encodings
    mistaken for each other, ``accept_utf8`` for UTF-8, ``floor`` per run. ``way`` is
    the best explanation ('lost' if there is none), ``text`` the text with every run restored
    by the way that explains it best among accepted ones, replacement characters (n_lost)
    left in place. Null, empty and pure ASCII texts are never damaged.

    All adjacent pairs of a text are scored by mutual information counted over all texts (pair_counts),
    runs of more than ``typical`` surprise are isolated by maximal scoring segments of the whole text, and inverse
    mappings are tried inside them only. The model is a table of all distinct pairs sent to every
    task; texts aren't shuffled.
    """
    counts = pair_counts(docs, text)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("way", T.StringType()), T.StructField("evidence", T.DoubleType()), T.StructField("n_runs", T.IntegerType()), T.StructField("n_lost", T.IntegerType()), T.StructField("text", T.StringType())])

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = PairModel(counts), {}
        for b in batches:
            keys, rows = b.column(0), []
            texts = [(i, s, *_resolved(s)) for i, s in enumerate(b.column(1).to_pylist()) if s and not (s.isascii() and "&" not in s)]
            done = 0
            for shown in _chunks(t[2] for t in texts):
                part = texts[done : done + len(shown)]
                done += len(shown)
                if len(cache) > 400_000:
                    cache.clear()
                for (i, s, whole, at_), spans in zip(part, improbable_runs(model, shown, typical)):
                    if not spans:
                        continue
                    evidence, runs = examine(model, s, whole, at_, spans, cache, floor, typical)
                    ok = {w for w, e in evidence.items() if e >= (accept_utf8 if w.startswith("utf-8") or w == "lost" else accept)}
                    if not ok:
                        continue
                    best = max(ok - {"lost"} or ok, key=lambda w: (evidence[w], w))
                    pieces, at, n, lost = [], 0, 0, s.count(LOST)
                    for a, z, ways in runs:
                        good = [(ways[w][0] + (w == best) * 2.0, w) for w in ways if w in ok and w != "lost" and (w == best or ways[w][0] >= floor)]
                        if good:
                            pieces += [s[at:a], ways[max(good)[1]][1]]
                            at, n = z, n + 1
                    rows.append((i, best, round(evidence[best], 3), n, lost, "".join([*pieces, s[at:]])))
            if rows:
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(cols[0])), pa.array(cols[1]), pa.array(cols[2]), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.string())], names=schema.names)

    return docs.select(key, text).mapInArrow(repair, schema)
