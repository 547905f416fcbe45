"""The graph's tables laid out for lookups and joins by name.

Symbols lie in buckets of their name, references of their target's name, imports of
their local name, files of their id, each bucket sorted.  So a name's rows are read
from one bucket of each, and joins of names with names read both sides in place.  The
other columns that lookups filter on (a symbol's file and kind, a reference's source,
target and kind, an import's path) have bloom filters, which skip row groups.
"""

from __future__ import annotations

from dataclasses import replace

from graphloom.plans.catalog import CodeGraph
from graphloom.plans.tables import bucketed, durable


def stored(g: CodeGraph, buckets: int | None = None) -> CodeGraph:
    """The same graph, read from tables written to the shared folder."""
    return replace(
        g,
        files=bucketed(g.files, "id", buckets, ("path",), "files"),
        symbols=bucketed(g.symbols, "name", buckets, ("name", "file_id", "kind"), "symbols"),
        refs=bucketed(g.refs, "target_name", buckets, ("target_name", "source_symbol_id", "target_symbol_id", "kind"), "refs"),
        imports=bucketed(g.imports, "local_name", buckets, ("local_name", "full_path"), "imports"),
    )


def kept(g: CodeGraph) -> CodeGraph:
    """The same graph, derived once and written as it is, for steps that read it many times."""
    return replace(g, files=durable(g.files, "files"), symbols=durable(g.symbols, "symbols"), refs=durable(g.refs, "refs"), imports=durable(g.imports, "imports"))
