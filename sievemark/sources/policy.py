"""The search policy of a repository: which families may be indexed, whether x-default is asked for; and policy packs."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.urls import glob_regex
from ..operators.claims import Claim, Pack

# Parts of patterns that are private where no policy says otherwise.
PRIVATE = ["/admin", "/dashboard", "/auth", "/chats", "/settings", "/pro/", "/tasks/", "/profile"]


class PolicyError(ValueError):
    """A policy that can't be read: what may be indexed is undefined (IDX-001)."""


@dataclass(frozen=True)
class Policy:
    """Globs of families that may be indexed and that must not, and the address of x-default."""

    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    x_default: str | None = None


def _outline(text: str) -> dict:
    """The subset of YAML that policies and packs use: nested maps by two or more blanks, lists of plain values, lists of maps."""
    root: dict = {}
    stack: list[tuple[int, object]] = [(-1, root)]
    rows = [r.split(" #")[0].rstrip() for r in text.splitlines()]
    rows = [r for r in rows if r.strip() and not r.strip().startswith("#")]
    plain = lambda v: v.strip().strip("\"'")
    for i, row in enumerate(rows):
        indent, body = len(row) - len(row.lstrip()), row.strip()
        while stack[-1][0] >= indent and not (body.startswith("- ") and isinstance(stack[-1][1], list) and stack[-1][0] == indent):
            stack.pop()
        holder = stack[-1][1]
        if body.startswith("- "):
            if not isinstance(holder, list):
                raise PolicyError(f"a list item where none is due: {body!r}")
            rest = body[2:].strip()
            key, colon, value = rest.partition(": ") if ": " in rest else (rest[:-1], ":", "") if rest.endswith(":") else (rest, "", "")
            if colon and not rest.startswith(("'", '"')):
                item = {plain(key): plain(value)} if value else {plain(key): []}
                holder.append(item)
                stack.append((indent + 1, item))
                if not value:
                    stack.append((indent + 2, item[plain(key)]))
            else:
                holder.append(plain(rest))
            continue
        key, colon, value = body.partition(":")
        if not colon or not isinstance(holder, dict):
            raise PolicyError(f"no key in {body!r}")
        if value.strip().startswith("[") and value.strip().endswith("]"):
            holder[plain(key)] = [plain(v) for v in value.strip()[1:-1].split(",") if v.strip()]
        elif value.strip():
            holder[plain(key)] = plain(value)
        else:
            deeper = rows[i + 1].strip() if i + 1 < len(rows) else ""
            child: object = [] if deeper.startswith("- ") else {}
            holder[plain(key)] = child
            stack.append((indent, child) if isinstance(child, dict) else (len(rows[i + 1]) - len(rows[i + 1].lstrip()), child))
    return root


def _read(text: str) -> dict:
    body = text.lstrip("\ufeff").strip()
    if body.startswith("{"):
        try:
            return json.loads(body)
        except ValueError as e:
            raise PolicyError(str(e)) from e
    return _outline(body)


def parse_policy(text: str) -> Policy:
    """Reads a policy in JSON or YAML; raises PolicyError for what can't be read."""
    doc = _read(text)
    if not isinstance(doc, dict):
        raise PolicyError("a policy is a map")
    index, world = doc.get("indexability") or {}, doc.get("international") or {}
    if not isinstance(index, dict) or not isinstance(world, dict):
        raise PolicyError("indexability and international are maps")
    return Policy(tuple(index.get("include") or ()), tuple(index.get("exclude") or ()), world.get("x_default") or None)


def parse_pack(text: str) -> Pack:
    """Reads a policy pack: id, market, markers, entities (token, label), claims (id, phrases, requires) and facts (field, false)."""
    d = _read(text)
    if not d.get("id") or not d.get("market"):
        raise PolicyError("a pack needs an id and a market")
    listed = lambda v: tuple(v if isinstance(v, list) else [v])
    return Pack(
        d["id"], d["market"], listed(d.get("markers") or []), tuple((e["token"], e.get("label") or e["token"]) for e in d.get("entities") or []),
        tuple(Claim(c["id"], listed(c.get("phrases") or []), c.get("requires", "")) for c in d.get("claims") or []), tuple((f["field"], listed(f.get("false") or [])) for f in d.get("facts") or []),
    )


def allows(pattern: Column, policy: Policy | None) -> Column:
    """Whether a family or path may be indexed: exclusions win, no inclusion allows all; without a policy private paths and catch-alls are guessed."""
    if policy is None:
        hit = pattern.contains("/*")
        for t in PRIVATE:
            hit = hit | pattern.contains(t)
        return ~hit
    of = lambda globs: [pattern.rlike(glob_regex(g)) for g in globs]
    out, kept = F.lit(not policy.include), F.lit(False)
    for m in of(policy.include):
        out = out | m
    for m in of(policy.exclude):
        kept = kept | m
    return out & ~kept
