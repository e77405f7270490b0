"""Command line: python -m sievemark COMMAND --tables FOLDER [...]

query --q TEXT, retrieve --q TEXT, similar --id N, chunks --q TEXT, explain, audit, inventory, opportunities, plan, compare, diff, gate --site SITE.
Rows are printed as JSON lines, at most --limit of them. Exit code 0, 1 for failures, 2 for wrong use; gate ends with its verdict's code (0, 1, 10 or 11).
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


class NotAllowed(PermissionError):
    """A path outside the allowed folders."""


def allowed_path(path: str, roots: list[str]) -> str:
    """The path with links and dots resolved, if it lies in one of the folders; without folders any path."""
    real = Path(path).resolve()
    if roots and not any(real == r or r in real.parents for r in (Path(x).resolve() for x in roots)):
        raise NotAllowed(f"{path} is outside the allowed folders")
    return str(real)


def _session() -> SparkSession:
    return SparkSession.builder.appName("sievemark").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def commands() -> dict[str, Callable[[SparkSession, argparse.Namespace], DataFrame]]:
    """What each command returns."""
    from .operators import vectors as V
    from .operators.common import table
    from .plans import audit, dsl, graphs, history, live, planning, preparation, site, sources

    docs = lambda s, a: table(s, a.tables, "documents").select("doc_id", "text")
    return {
        "query": lambda s, a: dsl.run(a.q, live.report(s, a.tables)), "retrieve": lambda s, a: V.retrieve(docs(s, a), a.q, a.limit), "similar": lambda s, a: V.similar(docs(s, a), int(a.id), a.limit), "chunks": lambda s, a: V.chunks_for(live.C.sentence_chunks(docs(s, a), keep=("body",)), a.q, a.limit, order=("doc_id", "chunk_no")),
        "explain": lambda s, a: sources.explain_chains(s, a.tables), "audit": lambda s, a: site.page_rules(s, a.tables), "inventory": lambda s, a: history.inventory_counts(s, a.tables), "opportunities": lambda s, a: planning.opportunity_rank(s, a.tables), "plan": lambda s, a: planning.opportunity_plan(s, a.tables),
        "compare": lambda s, a: audit.competitor_gaps(s, a.tables), "diff": lambda s, a: preparation.p3_found(s, a.tables), "gate": lambda s, a: history.gate_verdict(s, a.tables), "links": lambda s, a: graphs.link_degrees(s, a.tables),
    }


def main(argv: list[str] | None = None) -> int:
    """Runs a command and returns its exit code."""
    p = argparse.ArgumentParser(prog="sievemark", description=__doc__)
    table = commands()
    p.add_argument("command", choices=sorted(table))
    p.add_argument("--tables", required=True, help="folder of the Parquet tables")
    p.add_argument("--root", action="append", default=[], help="folders that may be read; any if none is given")
    p.add_argument("--q", default="")
    p.add_argument("--id", default="0")
    p.add_argument("--site", default=None)
    p.add_argument("--limit", type=int, default=50)
    try:
        a = p.parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        a.tables = allowed_path(a.tables, a.root)
        rows = table[a.command](_session(), a)
        if a.command == "gate" and a.site:
            rows = rows.where(rows["site"] == a.site.rstrip("/"))
        shown = rows.limit(a.limit).toJSON().collect() if hasattr(rows, "toJSON") else []
        print("\n".join(shown))
        if a.command == "gate" and a.site:
            found = rows.select("code").first()
            return int(found["code"]) if found else 1
        return 0
    except NotAllowed as e:
        print(e, file=sys.stderr)
        return 2
    except Exception as e:  # noqa: BLE001
        print(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
