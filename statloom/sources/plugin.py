"""Connectors in other processes: one process for each request, one JSON line each way."""

from __future__ import annotations

import json
import subprocess
import threading
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ..infer import unique_names
from .base import Connector, ImportOptions, SourceError
from .rows import frame_of

API_VERSION = 1
#: Seconds for each request, and bytes of an answer at most.
TIMEOUTS = {"describe": 5, "list_objects": 30, "load": 600}
MOST_BYTES = 256 << 20
#: Seconds that a plugin has to end after its answer.
LEAVE = 5


def _ask(process: subprocess.Popen, request: bytes) -> None:
    try:
        process.stdin.write(request)
        process.stdin.close()
    except OSError:  # it ended without reading; its answer says why
        pass


def _first_line(pipe, into: bytearray) -> None:
    """The first line with anything in it, or all there is; no more than the bound is held."""
    while len(into) <= MOST_BYTES and (piece := pipe.read1(1 << 16)):
        into += piece if into else piece.lstrip()
        end = into.find(b"\n", max(0, len(into) - len(piece)))
        if end >= 0:
            del into[end:]
            return


def _tail(pipe, into: bytearray, most: int = 1 << 16) -> None:
    while piece := pipe.read1(1 << 16):
        into += piece
        del into[:-most]


class PluginConnector(Connector):
    def __init__(self, folder: Path, manifest: dict):
        self.folder, self.name = folder, manifest["name"]
        self.command = [str(c) for c in manifest["command"]]
        self.extensions = tuple(e.lower().lstrip(".") for e in manifest.get("extensions", []))
        self.schemes = tuple(s.lower() for s in manifest.get("schemes", []))

    def call(self, method: str, **params):
        request = json.dumps({"api_version": API_VERSION, "method": method, "params": params}, ensure_ascii=False) + "\n"
        try:
            process = subprocess.Popen(self.command, cwd=self.folder, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE)
        except OSError as e:
            raise SourceError(f"plugin {self.name} cannot be started: {e}") from e
        out, err = bytearray(), bytearray()
        threads = [threading.Thread(target=f, daemon=True) for f in (lambda: _ask(process, request.encode()), lambda: _first_line(process.stdout, out), lambda: _tail(process.stderr, err))]
        for t in threads:
            t.start()
        threads[1].join(TIMEOUTS[method])  # however long other processes hold the pipe
        late, much = threads[1].is_alive(), len(out) > MOST_BYTES
        if late or much:
            process.kill()
            raise SourceError(f"plugin {self.name} " + ("answered with too much data" if much else f"did not answer in {TIMEOUTS[method]} s"))
        try:
            process.wait(LEAVE)
        except subprocess.TimeoutExpired:
            process.kill()
        threads[2].join(LEAVE)
        try:
            answer = json.loads(out.decode("utf-8"))
        except ValueError as e:
            raise SourceError(f"plugin {self.name} gave no JSON: {err.decode(errors='replace')[-300:]}") from e
        if "error" in answer:
            raise SourceError(f"plugin {self.name}: {answer['error']}")
        return answer.get("result")

    def objects(self, spark: SparkSession, path: str) -> list[str]:
        return [str(o) for o in self.call("list_objects", path=path) or []]

    def load(self, spark: SparkSession, path: str, object: str | None = None, options: ImportOptions = ImportOptions()) -> DataFrame:
        table = self.call("load", path=path, object=object, options=options.as_dict())
        return table_of(spark, table, options.max_rows)


def table_of(spark: SparkSession, table: dict, most: int | None = None) -> DataFrame:
    """columns: names or {name, type}; rows: arrays; nested values become JSON text, short rows are padded."""
    columns = [c if isinstance(c, dict) else {"name": c} for c in table["columns"]]
    rows = table["rows"][:most] if most is not None else table["rows"]
    plain = [[json.dumps(v, ensure_ascii=False) if isinstance(v, (list, dict)) else v for v in r] for r in rows]
    return frame_of(spark, unique_names([c["name"] for c in columns]), plain, [c.get("type") for c in columns])


def discover(folder: str) -> tuple[list[PluginConnector], list[str]]:
    """(connectors, warnings) of the manifests in <folder>/*/plugin.json."""
    found, warnings = [], []
    for path in sorted(Path(folder).glob("*/plugin.json")):
        try:
            m = json.loads(path.read_text(encoding="utf-8"))
            if m.get("api_version") != API_VERSION:
                raise ValueError(f"api_version {m.get('api_version')} is not {API_VERSION}")
            if m.get("kind") != "connector":
                raise ValueError(f"kind {m.get('kind')} is not connector")
            if not m.get("extensions") and not m.get("schemes"):
                raise ValueError("neither extensions nor schemes")
            found.append(PluginConnector(path.parent, m))
        except (ValueError, KeyError, OSError) as e:
            warnings.append(f"{path}: {e}")
    return found, warnings
