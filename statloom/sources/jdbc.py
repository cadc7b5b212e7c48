"""PostgreSQL and MySQL through Spark's JDBC source; a driver jar has to be on the class path.

Limits are pushed down as subqueries.  Names of PostgreSQL objects are shown unqualified in
``public`` and quoted only where they need it.
"""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, unquote, urlencode, urlparse

from pyspark.sql import DataFrame, SparkSession

from ..types import normalise
from .base import Connector, ImportOptions, SourceError

LOGIN_TIMEOUT = 10


def jdbc_url(url: str, kind: str, port: int) -> tuple[str, dict[str, str]]:
    """(JDBC URL without credentials, properties)."""
    u = urlparse(url)
    database = u.path.lstrip("/")
    if not u.hostname or not database:
        raise SourceError("a database URL needs a host and a database")
    props = {k: unquote(v) for k, v in (("user", u.username), ("password", u.password)) if v}
    query = urlencode(parse_qsl(u.query))
    host = f"[{u.hostname}]" if ":" in u.hostname else u.hostname
    return f"jdbc:{kind}://{host}:{u.port or port}/{database}" + (f"?{query}" if query else ""), props


def quote_pg(name: str) -> str:
    """The name as it is shown: quoted only if it has to be."""
    return name if re.fullmatch(r"[a-z_][a-z0-9_]*", name) else '"' + name.replace('"', '""') + '"'


def display_pg(schema: str, table: str) -> str:
    return quote_pg(table) if schema == "public" else f"{quote_pg(schema)}.{quote_pg(table)}"


def split_pg(name: str) -> list[str]:
    """Parts of a shown name; dots within quotes do not split."""
    parts, part, quoted, i = [], "", False, 0
    while i < len(name):
        c = name[i]
        if c == '"':
            if quoted and name[i + 1 : i + 2] == '"':
                part, i = part + '"', i + 1
            else:
                quoted = not quoted
        elif c == "." and not quoted:
            parts.append(part)
            part = ""
        else:
            part += c
        i += 1
    return [*parts, part]


def candidates_pg(name: str) -> list[str]:
    """Quoted references to try in turn: schema and table, then a table whose name has dots."""
    always = lambda p: '"' + p.replace('"', '""') + '"'
    parts = split_pg(name)
    out = [".".join(map(always, parts))]
    if len(parts) > 1 and '"' not in name:
        out.append(always(name))
    return out


class _Jdbc(Connector):
    kind, port, driver = "", 0, ""

    def read(self, spark: SparkSession, url: str, query: str) -> DataFrame:
        target, props = jdbc_url(url, self.kind, self.port)
        return spark.read.format("jdbc").options(url=target, driver=self.driver, query=query, loginTimeout=str(LOGIN_TIMEOUT), **props).load()

    def references(self, name: str) -> list[str]:
        raise NotImplementedError

    def load(self, spark: SparkSession, path: str, object: str | None = None, options: ImportOptions = ImportOptions()) -> DataFrame:
        if not object:
            raise SourceError("a table is needed")
        limit = "" if options.max_rows is None else f" limit {int(options.max_rows)}"
        error: Exception | None = None
        for reference in self.references(object):
            try:
                return normalise(self.read(spark, path, f"select * from {reference}{limit}"))
            except Exception as e:  # the next reference may be the right one
                error = error or e
        raise SourceError(f"cannot read {object}: {error}")


class PostgresConnector(_Jdbc):
    name, kind, port, driver = "postgres", "postgresql", 5432, "org.postgresql.Driver"
    schemes = ("postgres", "postgresql")

    def references(self, name: str) -> list[str]:
        return candidates_pg(name)

    def objects(self, spark: SparkSession, path: str) -> list[str]:
        rows = self.read(spark, path, "select table_schema, table_name from information_schema.tables where table_schema not in ('pg_catalog', 'information_schema')").collect()
        return [display_pg(s, t) for s, t in sorted(((r[0], r[1]) for r in rows), key=lambda p: (p[0] != "public", p))]


class MySqlConnector(_Jdbc):
    name, kind, port, driver = "mysql", "mysql", 3306, "com.mysql.cj.jdbc.Driver"
    schemes = ("mysql", "mariadb")

    def references(self, name: str) -> list[str]:
        return ["`" + name.replace("`", "``") + "`"]

    def objects(self, spark: SparkSession, path: str) -> list[str]:
        rows = self.read(spark, path, "select table_name as t from information_schema.tables where table_schema = database() order by table_name").collect()
        return [r[0] for r in rows]
