"""Command line: python -m graphloom.cli COMMAND ..."""

from __future__ import annotations

import argparse
import sys
import tempfile
from collections.abc import Sequence

from pyspark.sql import SparkSession

from graphloom import outline, projects, render
from graphloom.operators import calls, hierarchy, imports, references, symbols, testing
from graphloom.plans.catalog import CodeGraph
from graphloom.sources import ingest
from graphloom.sources.store import Store

#: command: (positional, options with defaults, query)
QUERIES = {
    "symbol": (["name"], {"kind": None, "file": None}, lambda g, a: symbols.find_symbols(g, a.name, a.kind, a.file)),
    "callers": (["name"], {"file": None, "depth": 1, "outline": False}, lambda g, a: calls.find_callers(g, a.name, a.file, a.depth)),
    "callees": (["name"], {"file": None, "depth": 1}, lambda g, a: calls.find_callees(g, a.name, a.file, a.depth)),
    "dead-code": ([], {"exclude": []}, lambda g, a: symbols.find_dead_code(g, None, a.exclude)),
    "hierarchy": (["name"], {"direction": "both"}, lambda g, a: hierarchy.find_hierarchy(g, a.name, a.direction)),
    "references": (["name"], {"kind": None}, lambda g, a: references.find_references(g, a.name, a.kind)),
    "tested-by": (["name"], {"file": None, "depth": 10}, lambda g, a: testing.find_tested_by(g, a.name, a.file, a.depth)),
    "untested": ([], {"exclude": []}, lambda g, a: testing.find_untested(g, None, a.exclude)),
    "imported-by": (["name"], {"file": None}, lambda g, a: imports.find_imported_by(g, a.name, a.file)),
    "resolve-import": (["name"], {"file": None}, lambda g, a: imports.resolve_import(g, a.name, a.file)),
    "list": ([], {"kind": None, "file": None}, lambda g, a: symbols.list_symbols(g, a.kind, a.file)),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True)
    for name, (positional, options, _) in QUERIES.items():
        c = sub.add_parser(name)
        for a in positional:
            c.add_argument(a)
        for a, default in options.items():
            if default is False:
                c.add_argument(f"--{a}", action="store_true")
            elif default == []:
                c.add_argument(f"--{a}", action="append", default=[])
            else:
                c.add_argument(f"--{a}", default=default, type=int if isinstance(default, int) else str)
        c.add_argument("--path")
    c = sub.add_parser("index")
    c.add_argument("path", nargs="?")
    c.add_argument("--full", action="store_true")
    for name in ("watch", "serve"):
        sub.add_parser(name).add_argument("path", nargs="?")
    sub.add_parser("status").add_argument("--path")
    c = sub.add_parser("outline")
    c.add_argument("paths", nargs="+")
    for flag in ("digest", "no-private", "no-fields", "no-docs", "no-attrs", "no-lines"):
        c.add_argument(f"--{flag}", action="store_true")
    c.add_argument("--glob")
    c.add_argument("--show", action="append", default=[])
    c = sub.add_parser("project").add_subparsers(dest="action", required=True)
    add = c.add_parser("add")
    add.add_argument("name")
    add.add_argument("path")
    c.add_parser("remove").add_argument("name")
    c.add_parser("list")
    return p


def session() -> SparkSession:
    spark = SparkSession.builder.appName("graphloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def outline_files(g: CodeGraph, name: str, file: str | None, found: Sequence) -> list[str]:
    """Files that define the name or call it, each once, sorted."""
    defined = render.rows(symbols.find_symbols(g, name, None, file))
    return sorted({r.file_path for r in defined} | {r.file_path for r in found})


def run(args: argparse.Namespace, spark: SparkSession | None = None) -> str:
    if args.command == "project":
        if args.action == "add":
            projects.add(args.name, args.path)
            return f"Added project {args.name}"
        if args.action == "remove":
            return f"Removed project {args.name}" if projects.remove(args.name) else f"No project {args.name}"
        return "\n".join(f"{n}: {p}" for n, p in sorted(projects.load().items())) or "No projects registered."
    if args.command == "outline":
        found = list(outline.outlines(args.paths, args.glob))
        if args.show:
            return "\n".join(text for o in found for wanted in args.show for text in outline.show(o, wanted))
        if args.digest:
            return outline.digest(found, args.paths[0] if len(args.paths) == 1 else None, privates=not args.no_private, fields=not args.no_fields)
        return "\n\n".join(outline.render(o, privates=not args.no_private, fields=not args.no_fields, docs=not args.no_docs, attrs=not args.no_attrs, lines=not args.no_lines) for o in found)

    spark = spark or session()
    folder = projects.resolve_dir(args.path)
    store = Store(spark, folder / projects.STORE_NAME)
    if args.command == "index":
        return str(ingest.index(store, str(folder), args.full))
    if args.command == "watch":
        from graphloom.streaming.watch import watch

        watch(spark, store, str(folder), tempfile.mkdtemp(prefix="graphloom-watch-")).awaitTermination()
        return ""
    if args.command == "serve":
        return serve(spark, folder)
    ingest.refresh(store, str(folder))
    g = store.graph()
    if args.command == "status":
        return render.status(symbols.status(g).first())
    found = render.rows(QUERIES[args.command][2](g, args))
    text = render.to_json(found, compact=args.command == "list")
    if getattr(args, "outline", False):
        text += "\n" + "\n\n".join(outline.render(o) for o in outline.outlines(outline_files(g, args.name, args.file, found)))
    return text


def serve(spark: SparkSession, folder) -> str:  # noqa: ANN001
    """Tools over standard input: one JSON object {"tool": .., "args": {..}} a line."""
    import json

    from graphloom.api import CodeTools

    tools = CodeTools(spark, folder)
    names = [n for n in vars(CodeTools) if not n.startswith("_") and n not in ("graph",)]
    for line in sys.stdin:
        try:
            asked = json.loads(line)
            if asked.get("tool") not in names:
                raise ValueError(f"no such tool: {asked.get('tool')}")
            answer = {"text": getattr(tools, asked["tool"])(**asked.get("args", {}))}
        except Exception as e:  # noqa: BLE001  a bad request must not end the server
            answer = {"error": f"{type(e).__name__}: {e}"}
        print(json.dumps(answer, ensure_ascii=False), flush=True)
    return ""


def main(argv: Sequence[str] | None = None) -> int:
    print(run(parser().parse_args(argv)))
    return 0


if __name__ == "__main__":
    sys.exit(main())
