"""Extractors: source text to symbols, references and imports, by language.

They are plain Python and tolerant: a file that cannot be read gives an error
row, and a construct that is not understood is passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame

from graphloom.schema import EXTRACTED
from graphloom.sources.extract import php, python, qml, rust, typescript
from graphloom.sources.extract.model import Extract

EXTRACTORS = {"php": php.extract, "python": python.extract, "qml": qml.extract, "rust": rust.extract, "typescript": typescript.extract}


def extract_text(lang: str, text: str) -> Extract:
    return EXTRACTORS[lang](text)


def extract_files(files: DataFrame, path: str = "path", lang: str = "lang", content: str = "content") -> DataFrame:
    """(path, symbols, refs, imports, error) for each row; positions in the arrays
    are the order of declaration."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, language, text in zip(batch[path], batch[lang], batch[content]):
                try:
                    found, error = extract_text(language, text), None
                except Exception as e:  # noqa: BLE001  one bad file never fails the job
                    found, error = Extract(), f"{type(e).__name__}: {e}"
                rows.append((p, [asdict(s) for s in found.symbols], [asdict(r) for r in found.refs], [asdict(i) for i in found.imports], error))
            yield pd.DataFrame(rows, columns=["path", "symbols", "refs", "imports", "error"])

    return files.select(path, lang, content).mapInPandas(run, f"path string, {EXTRACTED}, error string")
