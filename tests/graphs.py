"""Small code graphs for tests."""

from graphloom import schema
from graphloom.plans.catalog import CodeGraph


class Builder:
    def __init__(self, spark):
        self.spark, self._files, self._symbols, self._refs, self._imports, self._sources = spark, [], [], [], [], []

    def file(self, path, lang="rust"):
        if not path.startswith("/"):
            path = f"/repo/src/{path}" if "/" not in path else f"/repo/{path}"
        for f in self._files:
            if f[1] == path:
                return f[0]
        self._files.append((len(self._files) + 1, path, "hash", lang, 0, None, None))
        return len(self._files)

    def symbol(self, path, name, kind, line, parent=None, is_test=0, lang="rust"):
        i = len(self._symbols) + 1
        self._symbols.append((i, self.file(path, lang), name, kind, line, line + 2, parent, "pub", None, is_test))
        return i

    def ref(self, path, kind, source, target, line, qualifier=None, resolved=None):
        self._refs.append((len(self._refs) + 1, self.file(path), source, resolved, kind, target, qualifier, line, resolved is not None))

    def imported(self, path, local, full, alias=None, line=0):
        self._imports.append((len(self._imports) + 1, self.file(path), local, full, alias, line))

    def source(self, path, text):
        self._sources.append((self._files[self.file(path) - 1][1], text))

    def graph(self):
        make = lambda rows, ddl: self.spark.createDataFrame(rows, ddl)
        return CodeGraph(make(self._files, schema.FILES), make(self._symbols, schema.SYMBOLS), make(self._refs, schema.REFS), make(self._imports, schema.IMPORTS), make(self._sources, schema.SOURCES))
