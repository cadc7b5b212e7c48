"""Results as files."""

from __future__ import annotations

import csv
import html
import io
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import shared_folder


def _cell(v) -> str:
    return "" if v is None else str(v)


def to_csv(df: DataFrame, path: str, bom: bool = True) -> int:
    """One file; returns the rows.  Tasks write the lines, in the frame's order, to the shared folder; their files are then joined as bytes, so no row passes through Python or is held."""
    spark = df.sparkSession
    shape = {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    names = [f"_c{i}" for i in range(len(df.columns))]  # equal names are no trouble
    lines = df.toDF(*names).select(F.to_csv(F.struct(*[F.col(c).cast("string").alias(c) for c in names]), shape).alias("line"))
    seen = Observation()
    folder = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    lines.observe(seen, F.count(F.lit(1)).alias("n")).write.text(folder)
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    source = jvm.org.apache.hadoop.fs.Path(folder)
    files = source.getFileSystem(conf)
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    try:
        head = io.StringIO()
        csv.writer(head, lineterminator="\n").writerow(df.columns)
        out.write(bytearray((("\ufeff" if bom else "") + head.getvalue()).encode()))
        for part in sorted((s.getPath() for s in files.listStatus(source) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
            stream = files.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
            finally:
                stream.close()
    finally:
        out.close()
        files.delete(source, True)
    return seen.get["n"]


def to_html(df: DataFrame, rows: int = 500) -> str:
    """A table of the first rows, by the frame's own order."""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(_cell(v))}</td>" for v in r) + "</tr>" for r in df.limit(rows).collect())
    return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>"
