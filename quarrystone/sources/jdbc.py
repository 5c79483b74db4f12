"""Tables of a database by JDBC. The connection is named by ``DATABASE_URL``, in the environment or a ``.env`` file."""

from __future__ import annotations

import os
from collections.abc import Mapping
from pathlib import Path
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

DEFAULT_URL = "postgresql://localhost/postgres"
DRIVERS = {"postgresql": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "mariadb": "org.mariadb.jdbc.Driver"}


def settings(env_file: str = ".env", env: Mapping[str, str] = os.environ) -> dict[str, str]:
    """Variables of the file (``key=value`` lines; blank lines and those that begin with # don't count) and of the
    environment, which wins. A missing file has none."""
    path, found = Path(env_file), {}
    for line in path.read_text().splitlines() if path.is_file() else ():
        line = line.strip()
        if line and not line.startswith("#") and "=" in line:
            key, value = line.split("=", 1)
            found.setdefault(key.strip(), value.strip())
    return found | dict(env)


def options(url: str | None = None, env_file: str = ".env", env: Mapping[str, str] = os.environ) -> dict[str, str]:
    """Options of the JDBC source for ``url``, or for ``DATABASE_URL``: ``jdbc:`` ones as they are, others as
    ``scheme://user:password@host:port/name``."""
    url = url or settings(env_file, env).get("DATABASE_URL") or DEFAULT_URL
    if url.startswith("jdbc:"):
        return {"url": url}
    at = urlsplit(url)
    scheme = "postgresql" if at.scheme == "postgres" else at.scheme
    found = {"url": f"jdbc:{scheme}://{at.hostname or 'localhost'}{f':{at.port}' if at.port else ''}{at.path}{'?' + at.query if at.query else ''}"}
    found |= {"driver": DRIVERS[scheme]} if scheme in DRIVERS else {}
    found |= {"user": unquote(at.username)} if at.username else {}
    return found | ({"password": unquote(at.password)} if at.password else {})


def read(spark: SparkSession, table: str, url: str | None = None, split: str | None = None, partitions: int = 32, **more: str) -> DataFrame:
    """The table. With a whole-numbered column to ``split`` by, ``partitions`` tasks read a range of it each (rows where it is
    null with the first); without one a single task reads all. Filters and columns are pushed to the database."""
    held = options(url) | more
    load = lambda **extra: spark.read.format("jdbc").options(**held, **extra).load()
    if split:
        column = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(held["url"]).quoteIdentifier(split)
        low, high = load(query=f"SELECT MIN({column}) AS low, MAX({column}) AS high FROM {table}").first()
        if low is not None:
            return load(dbtable=table, partitionColumn=split, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=partitions)
    return load(dbtable=table)


def write(rows: DataFrame, table: str, url: str | None = None, mode: str = "append", connections: int = 16, **more: str) -> None:
    """Rows to the table, by ``connections`` tasks at most. ``overwrite`` empties the table and keeps its definition. A task
    that is run again writes its rows again, so a table with a key is to be filled through a table of its own."""
    rows.write.format("jdbc").options(**options(url), dbtable=table, numPartitions=connections, truncate="true", **more).mode(mode).save()
