"""Records of delimited text with quotes, found by all splits of a file at once.

A quoted cell may hold line ends, so where a split begins nobody knows whether it is within quotes.
Each split therefore says, for either case, how it ends and how many records end in it; from these
few rows the driver learns how each split really begins.  A second pass then puts lines together to
records.  Lines of a record that lies in several splits meet in one group of their own.
"""

from __future__ import annotations

import csv
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import SourceError

#: Splits that one record may lie in; a quote that isn't closed sooner is an error.
MOST_SPLITS = 8

_CLOSING = re.compile(r'(?:[^"]++|"")*+"')


def ends_inside(line: str, inside: bool, delimiter: str) -> bool:
    """Whether a line ends within quotes, if it begins within (or outside of) them.  A quote counts only where a cell begins."""
    at = 0
    while True:
        if inside or line.startswith('"', at):
            closed = _CLOSING.match(line, at if inside else at + 1)
            if not closed:
                return True
            at, inside = closed.end(), False
        at = line.find(delimiter, at) + 1
        if not at:
            return False


def fields(record: str, delimiter: str) -> int:
    return max((len(r) for r in csv.reader(record.split("\n"), delimiter=delimiter)), default=0) if '"' in record else record.count(delimiter) + 1


@dataclass
class Split:
    start: int
    inside: bool = False  # how it begins
    first: int = 0  # number of the first record that begins in it
    owner: int = -1  # the split in which the record begins that is open at its start


def _lines(spark: SparkSession, path: str, encoding: str, line_end: str | None) -> DataFrame:
    reader = spark.read.option("lineSep", line_end) if line_end else spark.read
    value = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    return reader.text(path).select(F.col("_metadata.file_block_start").alias("start"), value.alias("line"))


def _by_split(batches):
    """(start, lines) of pieces of splits in order; a split may come in several."""
    for batch in batches:
        starts, lines = batch.column("start").to_pylist(), batch.column("line").to_pylist()
        a = 0
        while a < len(starts):
            b = a
            while b < len(starts) and starts[b] == starts[a]:
                b += 1
            yield starts[a], lines[a:b]
            a = b


def _summarise(lines: DataFrame, delimiter: str) -> list:
    """A row for each split: how it ends, and how many records end in it, for both ways to begin."""

    def scan(batches):
        import pyarrow as pa

        ends: dict[int, list] = {}
        for start, piece in _by_split(batches):
            found = ends.setdefault(start, [False, 0, True, 0])
            for line in piece:
                quoted = '"' in line
                for i in (0, 2):
                    if quoted:
                        found[i] = ends_inside(line, found[i], delimiter)
                    found[i + 1] += not found[i]
        rows = [(start, *v) for start, v in ends.items()]
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["start", "out", "out_n", "in", "in_n"])

    return lines.mapInArrow(scan, "start long, out boolean, out_n long, `in` boolean, in_n long").orderBy("start").collect()


def _beginnings(summaries: list) -> tuple[dict[int, Split], bool]:
    """How each split begins, and whether any record lies in several or is open at the end."""
    splits, inside, number, owner, reach = {}, False, 0, -1, 0
    for r in summaries:
        splits[r["start"]] = Split(r["start"], inside, number, owner)
        ended = r["in_n"] if inside else r["out_n"]
        after = r["in"] if inside else r["out"]
        if ended or not inside:
            owner, reach = r["start"], 0
        reach += 1
        if after and reach > MOST_SPLITS:
            raise SourceError(f"a quote is opened after byte {owner} and not closed")
        # an open record belongs to the split in which it begins, and is numbered there
        number += ended + (after and (ended > 0 or not inside)) - (inside and ended > 0)
        inside = after
    return splits, inside or any(s.inside for s in splits.values())


def records(spark: SparkSession, path: str, encoding: str, delimiter: str, line_end: str | None = "\n") -> DataFrame:
    """number (from 0, in the order of the file), record, n_fields; blank records are left out but numbered."""
    lines = _lines(spark, path, encoding, line_end)
    splits, pieces = _beginnings(_summarise(lines, delimiter))
    kinds = "owner long, part long, number long, record string, n_fields int"

    def assemble(batches):
        import pyarrow as pa

        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32())
        state: dict[int, list] = {}
        out = []

        def give():
            nonlocal out
            columns = list(zip(*out)) if out else [()] * 5
            out = []
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["owner", "part", "number", "record", "n_fields"])

        for start, piece in _by_split(batches):
            split = splits[start]
            if start not in state:
                # lines held, whether they continue a record of an earlier split, whether within quotes, number of the next record
                state[start] = [[], split.inside, split.inside, split.first]
                if not start and piece:
                    piece[0] = piece[0].removeprefix("﻿")
            now = state[start]
            for line in piece:
                if '"' in line:
                    now[2] = ends_inside(line, now[2], delimiter)
                now[0].append(line)
                if now[2]:
                    continue
                record = "\n".join(now[0]).removesuffix("\r")
                if now[1]:
                    out.append((split.owner, start, None, record, None))
                else:
                    out.append((None, None, now[3], record, fields(record, delimiter)))
                    now[3] += 1
                now[0], now[1] = [], False
            yield give()
        for start, (held, continued, _, number) in state.items():
            if held:  # open at the end: the owner's piece carries the number
                out.append((splits[start].owner if continued else start, start, None if continued else number, "\n".join(held), None))
        yield give()

    rows = lines.mapInArrow(assemble, kinds)
    whole = rows.where("owner is null").select("number", "record", "n_fields")

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            n = [fields(r, delimiter) for r in batch.column("record").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("number"), batch.column("record"), pa.array(n, pa.int32())], ["number", "record", "n_fields"])

    if pieces:
        # a group holds the pieces of one record, from MOST_SPLITS splits at most
        joined = rows.where("owner is not null").groupBy("owner").agg(F.max("number").alias("number"), F.array_sort(F.collect_list(F.struct("part", "record"))).alias("p"))
        joined = joined.select("number", F.array_join("p.record", "\n").alias("record"))
        whole = whole.unionByName(joined.mapInArrow(count, "number long, record string, n_fields int"))
    return whole.where("trim(record) <> ''")
