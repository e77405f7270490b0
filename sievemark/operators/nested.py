"""Deeply nested records as flat, linked rows, found by a structural index over JSON text.

A batch's JSON texts are laid into one byte buffer. Whole-buffer passes give the quotes that
open and close strings (an odd run of backslashes escapes one), the mask of string interiors
as a prefix sum of quotes, and the nesting depth as a prefix sum of brackets outside strings.
Element, key and value spans then follow from delimiters at known depths; nothing is parsed
byte by byte and no object tree is built.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OPEN, _CLOSE = np.zeros(256, bool), np.zeros(256, bool)
_OPEN[[ord("["), ord("{")]] = True
_CLOSE[[ord("]"), ord("}")]] = True


class Index:
    """Structural index of a buffer that holds JSON arrays one after the other."""

    def __init__(self, buf: np.ndarray) -> None:
        self.buf = buf
        at = np.arange(len(buf))
        slash = buf == ord("\\")
        quote = buf == ord('"')
        if slash.any():  # a quote is escaped after an odd run of backslashes
            plain = np.maximum.accumulate(np.where(slash, -1, at))
            q = np.flatnonzero(quote)
            q = q[q > 0]
            quote[q[(q - 1 - plain[q - 1]) % 2 == 1]] = False
        self.quotes = np.flatnonzero(quote)
        inside = (np.cumsum(quote) & 1).astype(bool)  # from the opening quote up to before the closing one
        outside = ~inside
        opens, closes = _OPEN[buf] & outside, _CLOSE[buf] & outside
        # depth of a byte: brackets open before it; a closing bracket has its inside's depth
        self.depth = np.cumsum(opens.astype(np.int32)) - np.cumsum(closes.astype(np.int32)) - opens + closes
        self.opens, self.closes = opens, closes
        self.commas = (buf == ord(",")) & outside
        self.colons = (buf == ord(":")) & outside

    def elements(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of arrays whose inside has this depth: (array's start, position, start, end) of each element.

        Only brackets [ and ] count; an empty array has no element."""
        return self._parts(depth, ord("["))

    def _parts(self, depth: int, bracket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        level = self.depth
        starts = np.flatnonzero(self.opens & (level == depth - 1))
        ends = np.flatnonzero(self.closes & (level == depth))
        mine = self.buf[starts] == bracket
        commas = np.flatnonzero(self.commas & (level == depth))
        owner = np.searchsorted(starts, commas, "right") - 1
        commas, owner = commas[mine[owner]], owner[mine[owner]] if len(owner) else owner
        full = np.flatnonzero(mine & (ends - starts > 1))
        begin = np.concatenate([starts[full], commas])
        who = np.concatenate([full, owner])
        order = np.argsort(begin, kind="stable")
        begin, who = begin[order], who[order]
        last = np.r_[who[1:] != who[:-1], True] if len(who) else np.zeros(0, bool)
        stop = np.where(last, ends[who], np.r_[begin[1:], 0]) if len(who) else begin
        first = np.r_[True, who[1:] != who[:-1]] if len(who) else np.zeros(0, bool)
        n = np.arange(len(who))
        position = n - np.maximum.accumulate(np.where(first, n, 0)) if len(who) else n
        return starts[who] if len(who) else begin, position, begin + 1, stop

    def members(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Members of objects whose inside has this depth: key start, key end, value start, value end."""
        _, _, start, stop = self._parts(depth, ord("{"))
        colon = np.flatnonzero(self.colons & (self.depth == depth))
        at = np.searchsorted(colon, start)
        colon = colon[at]
        return start + 1, colon - 1, colon + 1, stop


def _text(buf: bytes, a: int, b: int) -> str | None:
    """A value's text: strings unquoted and unescaped, null as None, anything else as written."""
    v = buf[a:b]
    if v[:1] == b'"':
        return json.loads(v) if b"\\" in v else v[1:-1].decode()
    return None if v == b"null" else v.decode()


def flatten_nested(df: DataFrame, key: str, branches: list[str], lists: dict[str, list[str]], fields: bool = True, step: int = 32) -> DataFrame:
    """Rows ``key, branch, position, sub_position, fields, value`` of each record's nested arrays.

    ``branches`` are array-of-struct columns; ``lists`` names the string lists inside a
    branch's elements. One row per non-null element (sub_position -1, ``fields`` maps its
    scalar members to text) and per non-null string of those lists (branch
    ``<branch>.<list>``, ``value`` the string); positions count from 0 and null elements take
    one. Parent and child share key and position. Null and empty arrays give no rows. Members
    that are null are absent from ``fields``; without ``fields`` the maps are null and cheap.

    A very long array is cut into pieces of ``step`` elements before it becomes text, so no
    task gets an unbounded text. Rows aren't shuffled.
    """
    # all pieces of all branches are exploded from one scan
    def cut(b: str) -> Column:
        at = F.when(F.size(b) > 0, F.sequence(F.lit(0), F.size(b) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda p: F.struct(F.lit(b).alias("branch"), p.alias("base"), F.to_json(F.slice(F.col(b), p + 1, step)).alias("body")))

    texts = df.where(F.col(key).isNotNull()).select(key, F.explode(F.concat(*[cut(b) for b in branches])).alias("_p")).select(key, "_p.branch", "_p.base", "_p.body")
    schema = T.StructType([
        T.StructField(key, df.schema[key].dataType), T.StructField("branch", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("sub_position", T.IntegerType()),
        T.StructField("fields", T.MapType(T.StringType(), T.StringType())), T.StructField("value", T.StringType()),
    ])
    wanted = {b: set(v) for b, v in lists.items()}

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = np.cumsum(np.asarray(pa.compute.binary_length(whole.column("body"))))
            cuts = [0, *(np.flatnonzero(np.diff(sizes // 4_000_000)) + 1), whole.num_rows]  # about 4 MB of text at a time
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield _emit(whole.slice(a, b - a), key, schema, wanted, fields)

    return texts.mapInArrow(emit, schema)


def _emit(batch: pa.RecordBatch, key: str, schema: T.StructType, wanted: dict[str, set[str]], fields: bool) -> pa.RecordBatch:
    bodies = batch.column("body").to_pylist()
    raw = "\n".join(bodies).encode()
    ix = Index(np.frombuffer(raw, np.uint8))
    begins = np.flatnonzero(ix.opens & (ix.depth == 0))  # where each record's array starts
    owner, position, start, stop = ix.elements(1)
    record = np.searchsorted(begins, owner)
    alive = ix.buf[start] == ord("{")
    base = np.asarray(batch.column("base")).astype(np.int64)
    branch = batch.column("branch").to_pylist()
    element_at = start  # starts are ascending: used to find a member's element
    place = base[record] + position
    keys: list[bytes] = []
    maps: list[list[tuple[str, str]]] = [[] for _ in range(len(start))] if fields else []
    ks, ke, vs, ve = ix.members(2)
    of = np.searchsorted(element_at, ks, "right") - 1
    is_list = ix.buf[vs] == ord("[") if len(vs) else np.zeros(0, bool)
    if fields:
        names: dict[bytes, str] = {}
        for e, a, b, c, d in zip(of[~is_list].tolist(), ks[~is_list].tolist(), ke[~is_list].tolist(), vs[~is_list].tolist(), ve[~is_list].tolist()):
            v = _text(raw, c, d)
            if v is not None:
                k = raw[a:b]
                maps[e].append((names.get(k) or names.setdefault(k, k.decode()), v))
    # strings of the wanted lists: elements at depth 3, linked to the member that starts their list
    l_owner, l_pos, l_start, l_stop = ix.elements(3)
    member = np.searchsorted(vs[is_list], l_owner)
    list_vs, list_of = vs[is_list], of[is_list]
    keys = [raw[a:b] for a, b in zip(ks[is_list].tolist(), ke[is_list].tolist())]
    text = ix.buf[l_start] == ord('"') if len(l_start) else np.zeros(0, bool)
    ok = text & (list_vs[np.minimum(member, max(len(list_vs) - 1, 0))] == l_owner) if len(list_vs) else np.zeros(len(l_start), bool)
    sub_branch: list[str] = []
    pick: list[int] = []
    for i in np.flatnonzero(ok).tolist():
        m = member[i]
        b, k = branch[record[list_of[m]]], keys[m].decode()
        if k in wanted.get(b, ()):
            sub_branch.append(f"{b}.{k}")
            pick.append(i)
    picked = np.array(pick, np.int64)
    parent = list_of[member[picked]] if len(picked) else picked
    live = np.flatnonzero(alive)
    rows = np.concatenate([record[live], record[parent]])
    return pa.RecordBatch.from_arrays(
        [
            batch.column(key).take(pa.array(rows)),
            pa.array([branch[r] for r in record[live].tolist()] + sub_branch, pa.string()),
            pa.array(np.concatenate([place[live], place[parent]]), pa.int32()),
            pa.array(np.concatenate([np.full(len(live), -1), l_pos[picked]]), pa.int32()),
            pa.array([maps[i] for i in live.tolist()] + [None] * len(picked), pa.map_(pa.string(), pa.string())) if fields else pa.nulls(len(rows), pa.map_(pa.string(), pa.string())),
            pa.array([None] * len(live) + [_text(raw, a, b) for a, b in zip(l_start[picked].tolist(), l_stop[picked].tolist())], pa.string()),
        ],
        names=schema.names,
    )
