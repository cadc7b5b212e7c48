"""Import options and the connector registry."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class ImportOptions:
    header_row: int = 1  # 1-based; 0: no header
    skip_rows: int = 0  # records after the header
    delimiter: str | None = None  # None: found from the first line
    max_rows: int | None = None

    def as_dict(self) -> dict:
        return asdict(self)


class SourceError(ValueError):
    pass


class Connector:
    """One kind of source."""

    name = ""
    extensions: tuple[str, ...] = ()
    schemes: tuple[str, ...] = ()

    def objects(self, spark: SparkSession, path: str) -> list[str]:
        """Names of what the source holds: sheets, tables."""
        return []

    def load(self, spark: SparkSession, path: str, object: str | None = None, options: ImportOptions = ImportOptions()) -> DataFrame:
        raise NotImplementedError


class Registry:
    """Connectors by URL scheme first, then by file extension; the first registered wins."""

    def __init__(self, connectors: list[Connector] = ()):
        self.connectors = list(connectors)

    def register(self, connector: Connector) -> None:
        self.connectors.append(connector)

    def for_path(self, path: str) -> Connector:
        scheme = urlparse(path).scheme.lower() if "://" in path else ""
        if scheme:
            for c in self.connectors:
                if scheme in c.schemes:
                    return c
        extension = Path(path).suffix.lower().lstrip(".")
        for c in self.connectors:
            if extension in c.extensions:
                return c
        raise SourceError(f"no connector for {path}")

    def all_extensions(self) -> list[str]:
        return sorted({e for c in self.connectors for e in c.extensions})

    def browse(self, folder: str) -> list[dict]:
        """Folders, then files that can be read; hidden names are left out."""
        out = []
        for p in Path(folder).iterdir():
            if p.name.startswith((".", "$")):
                continue
            if p.is_dir() or p.suffix.lower().lstrip(".") in self.all_extensions():
                out.append({"name": p.name, "path": str(p), "is_dir": p.is_dir()})
        return sorted(out, key=lambda e: (not e["is_dir"], e["name"].lower()))


def default_registry(plugins: str | None = None) -> Registry:
    from .csv_source import CsvConnector
    from .excel import ExcelConnector
    from .jdbc import MySqlConnector, PostgresConnector
    from .jsonl import JsonlConnector
    from .sqlite import SqliteConnector

    registry = Registry([CsvConnector(), ExcelConnector(), SqliteConnector(), PostgresConnector(), MySqlConnector(), JsonlConnector()])
    if plugins:
        from .plugin import discover

        for c in discover(plugins)[0]:
            registry.register(c)
    return registry
