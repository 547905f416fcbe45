"""Source trees: an ignore-aware walk, file states and parallel reads.

Spark's file sources skip names that begin with an underscore, so trees are
walked here; only names and states pass the driver, contents are read by tasks.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from graphloom.schema import EXTENSIONS

STATE = "path string, lang string, size long, modified_ns long"


def language(path: str | Path) -> str | None:
    name = os.path.basename(path)
    return EXTENSIONS.get(name.rpartition(".")[2]) if "." in name else None


class Ignore:
    """The rules of one ignore file; later rules win, ! takes back."""

    def __init__(self, folder: Path, text: str) -> None:
        self.folder, self.rules = folder, []
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            line = line[keep:].removeprefix("\\") if not keep else line[1:]
            only_dirs = line.endswith("/")
            body = line.rstrip("/")
            anchored = "/" in body
            self.rules.append((re.compile(_pattern(body.lstrip("/"), anchored)), keep, only_dirs))

    def verdict(self, path: Path, is_dir: bool) -> bool | None:
        relative = path.relative_to(self.folder).as_posix()
        out = None
        for pattern, keep, only_dirs in self.rules:
            if (is_dir or not only_dirs) and pattern.fullmatch(relative):
                out = not keep
        return out


def _pattern(glob: str, anchored: bool) -> str:
    out, i = "" if anchored else "(?:.*/)?", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            out, i = out + "[" + glob[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


def walk(root: str | Path) -> Iterator[str]:
    """Canonical paths of source files below root, hidden and ignored ones left out."""
    root = Path(root).resolve()
    if root.is_file():
        if language(root):
            yield str(root)
        return

    def visit(folder: Path, ignores: list[Ignore]) -> Iterator[str]:
        for name in (".gitignore", ".ignore"):
            try:
                ignores = [*ignores, Ignore(folder, (folder / name).read_text(errors="replace"))]
            except OSError:
                pass
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return
        for e in entries:
            path, is_dir = Path(e.path), e.is_dir(follow_symlinks=False)
            said = next((v for i in reversed(ignores) if (v := i.verdict(path, is_dir)) is not None), False)
            if e.name.startswith(".") or said:
                continue
            if is_dir:
                yield from visit(path, ignores)
            elif e.is_file(follow_symlinks=False) and language(e.name):
                yield e.path

    outer = [Ignore(p, (p / ".gitignore").read_text(errors="replace")) for p in reversed(root.parents) if (p / ".git").exists() and (p / ".gitignore").is_file()]
    yield from visit(root, outer)


def state(path: str) -> tuple[int, int] | None:
    """(size, modification time in ns) of a regular file."""
    try:
        s = os.stat(path)
    except OSError:
        return None
    return s.st_size, s.st_mtime_ns


def states(spark: SparkSession, paths: list[str]) -> DataFrame:
    rows = [(p, language(p), *s) for p in paths if (s := state(p)) and language(p)]
    return spark.createDataFrame(rows, STATE)


def read_contents(files: DataFrame) -> DataFrame:
    """files with content, hash (SHA-256 of the bytes) and error, read by tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            got = []
            for path in batch["path"]:
                try:
                    raw = Path(path).read_bytes()
                    got.append((raw.decode("utf-8"), hashlib.sha256(raw).hexdigest(), None))
                except (OSError, UnicodeDecodeError) as e:
                    got.append((None, None, f"{type(e).__name__}: {e}"))
            yield batch.assign(**{c: [g[k] for g in got] for k, c in enumerate(("content", "hash", "error"))})

    return files.mapInPandas(run, f"{files._jdf.schema().toDDL()}, content string, hash string, error string")


def existing(paths: DataFrame) -> DataFrame:
    """Rows whose path is there, checked by tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[os.path.exists(p) for p in batch["path"]]]

    return paths.mapInPandas(run, paths.schema)
