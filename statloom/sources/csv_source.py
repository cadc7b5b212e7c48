"""Delimited text: encoding and delimiter are found, types are inferred from a sample.

The text is parsed by Spark, split over tasks, with quotes too (quoted.py); only the head is looked
at on the driver.  Encoding, quotes and the widest record are sought in the whole file.  Cells that do not fit their
column's type are kept as text in a column beside it.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..infer import SAMPLE_ROWS, apply_types, cell_types, unique_names
from .base import Connector, ImportOptions
from .quoted import records

#: Delimiters that are tried; ties go to the earlier.
DELIMITERS = (",", "\t", ";", "|")
HEAD = 1 << 20


def sniff_encoding(head: bytes) -> str:
    """UTF-8 if it is, else Shift_JIS; a character cut at the head's end is no error."""
    try:
        head.decode("utf-8")
    except UnicodeDecodeError as e:
        if e.start < len(head) - 4:
            return "Shift_JIS"
    return "UTF-8"


def sniff_delimiter(path: str, first_line: str, given: str | None) -> str:
    if given:
        return "\t" if given in ("tab", "\\t") else given[0]
    if path.lower().endswith(".tsv"):
        return "\t"
    best = max(DELIMITERS, key=first_line.count)
    return best if first_line.count(best) else ","


def read_head(spark: SparkSession, path: str) -> bytes:
    """The first bytes of a file, through Hadoop's file systems; the rest of it is not read."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, HEAD)))
    finally:
        stream.close()


def widest_record(lines: DataFrame, delimiter: str) -> int:
    """Fields of the widest record of a file without quotes."""
    return lines.agg(F.max(F.length("value") - F.length(F.replace("value", F.lit(delimiter))) + 1)).first()[0] or 1


class CsvConnector(Connector):
    name = "csv"
    extensions = ("csv", "tsv", "txt")

    def raw(self, spark: SparkSession, path: str, options: ImportOptions) -> tuple[DataFrame, DataFrame, list[str]]:
        """(all data records as text, short ones padded with null; the first SAMPLE_ROWS of them; names)."""
        head = read_head(spark, path)
        encoding, quoted = sniff_encoding(bytes(head)), b'"' in bytes(head)
        if len(head) >= HEAD:  # the rest of the file, by its raw lines: both encodings have line ends and quotes in bytes of their own
            raw = spark.read.text(path).agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(F.col("value").contains('"')).alias("quoted")).first()
            encoding = "UTF-8" if raw["utf8"] else "Shift_JIS"
            quoted = quoted or bool(raw["quoted"])
        text = bytes(head).decode(encoding, "replace").removeprefix("﻿")
        delimiter = sniff_delimiter(path, text.split("\n", 1)[0], options.delimiter)
        if encoding != "UTF-8":
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        before = options.header_row + options.skip_rows
        whole = list(csv.reader(io.StringIO(text), delimiter=delimiter))
        width = max(max((len(r) for r in whole), default=1), 1)
        header = whole[options.header_row - 1] if 0 < options.header_row <= len(whole) else []
        shape = dict(sep=delimiter, header=False, quote='"', escape='"', mode="PERMISSIVE", ignoreLeadingWhiteSpace=False)
        if quoted:
            found = records(spark, path, encoding, delimiter, "\n" if "\n" in text else None)
            width = max(width if len(head) < HEAD else 1, found.agg(F.max("n_fields")).first()[0] or 1)
            schema = ", ".join(f"_c{i} string" for i in range(width))
            options_ = {k: str(v) for k, v in shape.items() if k != "header"}
            rows = found.select("number", F.from_csv("record", schema, options_).alias("r")).select("number", "r.*")

            def between(first: int, end: int | None) -> DataFrame:
                chosen = rows.where(F.col("number") >= first)
                return (chosen if end is None else chosen.where(F.col("number") < end)).drop("number")

            df = between(before, None if options.max_rows is None else before + options.max_rows)
            sample = between(before, before + min(SAMPLE_ROWS, SAMPLE_ROWS if options.max_rows is None else options.max_rows))
        else:
            if len(head) >= HEAD:
                width = max(width, widest_record(spark.read.option("encoding", encoding).text(path), delimiter))
            schema = ", ".join(f"_c{i} string" for i in range(width))
            df = spark.read.schema(schema).csv(path, encoding=encoding, multiLine=False, enforceSchema=True, **shape)
            if before:
                # records before the data: found by their content at the head of the first partition
                df = df.withColumn("_n", F.monotonically_increasing_id()).where(F.col("_n") >= before).drop("_n")
            if options.max_rows is not None:
                df = df.limit(options.max_rows)
            sample = df.limit(SAMPLE_ROWS)
        return df, sample, unique_names([header[i] if i < len(header) else None for i in range(width)])

    def load(self, spark: SparkSession, path: str, object: str | None = None, options: ImportOptions = ImportOptions()) -> DataFrame:
        df, sample, names = self.raw(spark, path, options)
        kinds = cell_types([list(r) for r in sample.collect()], len(names))
        return apply_types(df, names, kinds)
