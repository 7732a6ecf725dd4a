"""Keys that are the same however their letters are cased and whatever white space surrounds them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a character class that both Java and RE2 read alike.
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"


def key(c: Column | str) -> Column:
    """Lower case without surrounding white space; null where nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    k = F.lower(F.regexp_replace(c.cast("string"), rf"^{SPACE}+|{SPACE}+$", ""))
    return F.when(k != "", k)


def key_sql(c: str) -> str:
    """The same in SQL for DuckDB."""
    return rf"nullif(lower(regexp_replace(CAST({c} AS VARCHAR), '^{SPACE}+|{SPACE}+$', '', 'g')), '')"
