"""The small read-only query language: FROM c [WHERE f op v (AND ...)] [RETURN a, b] [LIMIT n]."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower

DEFAULT_LIMIT, MAX_LIMIT = 50, 200
ALIASES = {"families": "route_families", "snapshots": "runs"}
COLLECTIONS = ["urls", "findings", "claims", "route_families", "chunks", "opportunities", "runs"]


class QueryError(ValueError):
    """A text that isn't a query."""


@dataclass
class Query:
    """A parsed query."""

    collection: str
    filters: list[tuple[str, str, str]] = field(default_factory=list)
    fields: list[str] = field(default_factory=list)
    limit: int = DEFAULT_LIMIT


def _pieces(text: str) -> list[str]:
    """Words, and quoted strings with their quotes."""
    return re.findall(r'(?:[^\s"]|"[^"]*"?)+', text)


def _comparison(text: str) -> tuple[str, str, str]:
    bare = re.sub(r'"[^"]*"?', lambda m: "\0" * len(m.group()), text)  # operators inside quotes don't count
    m = re.search(r"\scontains\s", bare, re.IGNORECASE) or next((m for op in ("!=", ">=", "<=", "=", ">", "<") if (m := re.search(re.escape(op), bare))), None)
    if not m or not text[: m.start()].strip():
        raise QueryError(f"no comparison in {text!r}")
    value = text[m.end() :].strip()
    if len(value) >= 2 and value[0] == value[-1] == '"':
        value = value[1:-1]
    return text[: m.start()].strip(), m.group().strip().lower(), value


def parse(text: str, collections: list[str] | None = None) -> Query:
    """Reads a query; raises QueryError for anything else.

    Keywords have any case; text in double quotes is never a keyword or an operator. The
    limit is brought between 1 and 200.
    """
    words = _pieces(text)
    if not words:
        raise QueryError("empty query")
    if words[0].upper() != "FROM" or len(words) < 2:
        raise QueryError("a query begins with FROM and a collection")
    name = ALIASES.get(words[1].lower(), words[1].lower())
    if name not in (collections or COLLECTIONS):
        raise QueryError(f"unknown collection {words[1]!r}")
    q, at, order = Query(name), 2, ["WHERE", "RETURN", "LIMIT"]
    while at < len(words):
        key = words[at].upper()
        if key not in order:
            raise QueryError(f"unexpected {words[at]!r}")
        order = order[order.index(key) + 1 :]
        end = next((i for i in range(at + 1, len(words)) if words[i].upper() in order), len(words))
        part = words[at + 1 : end]
        if key == "WHERE":
            group: list[str] = []
            for w in [*part, "AND"]:
                if w.upper() == "AND":
                    q.filters.append(_comparison(" ".join(group)))
                    group = []
                else:
                    group.append(w)
        elif key == "RETURN":
            q.fields = [f.strip() for f in " ".join(part).split(",") if f.strip()]
        elif len(part) != 1 or not part[0].isdigit():
            raise QueryError("LIMIT needs one number")
        else:
            q.limit = min(max(int(part[0]), 1), MAX_LIMIT)
        at = end
    return q


def condition(df: DataFrame, name: str, op: str, value: str) -> Column:
    """A comparison as text (ASCII case ignored), or as numbers for < <= > >=.

    Missing fields and nulls fail every comparison, != too."""
    if name not in df.columns:
        return F.lit(False)
    c = F.col(f"`{name}`").cast("string")
    low = "".join(ch.lower() if ch.isascii() else ch for ch in value)
    if op in ("=", "!="):
        hit = ascii_lower(c) == low
        return F.coalesce(hit if op == "=" else ~hit, F.lit(False))
    if op == "contains":
        return F.coalesce(ascii_lower(c).contains(low), F.lit(False))
    try:
        number = float(value)
    except ValueError:
        return F.lit(False)
    x = c.try_cast("double")
    return F.coalesce({"<": x < number, "<=": x <= number, ">": x > number, ">=": x >= number}[op], F.lit(False))


def _found(text: str, collections: Mapping[str, DataFrame]) -> tuple[Query, DataFrame]:
    q = parse(text, list(collections))
    df = collections[q.collection]
    for f in q.filters:
        df = df.where(condition(df, *f))
    return q, df


def run(text: str, collections: Mapping[str, DataFrame], order: list[str] | None = None, flag: str | None = None) -> DataFrame:
    """The query's rows: filtered, limited, then projected to the known fields in name order.

    ``order`` gives the order that the limit follows; filters and fields reach the scan. ``flag`` names a
    column that says in every row whether the limit cut rows off: one row more than the limit is looked at, in the same job.
    """
    q, df = _found(text, collections)
    names = sorted(c for c in df.columns if not q.fields or c in q.fields)
    keys = [F.col(f"`{c}`").asc_nulls_last() for c in (order or sorted(df.columns))]
    shown = [F.col(f"`{c}`") for c in names]
    if flag is None:
        return df.orderBy(*keys).limit(q.limit).select(*shown)
    few = df.orderBy(*keys).limit(q.limit + 1)  # at most 201 rows
    numbered = few.withColumns({"_no": F.row_number().over(Window.orderBy(*keys)), "_all": F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))})
    return numbered.where(F.col("_no") <= q.limit).select(*shown, (F.col("_all") > q.limit).alias(flag))
