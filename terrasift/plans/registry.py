"""Where queries and their SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Shared table expressions of the SQL texts.
CELL = """cell AS (SELECT CAST(l_partkey % 256 AS INTEGER) r, CAST(l_orderkey % 256 AS INTEGER) c, max(l_returnflag) flag,
 max(l_extendedprice) v, max(l_quantity) q, max(l_discount) disc, max(l_tax) tax, count(*) n FROM lineitem GROUP BY 1, 2)"""
MASKS = CELL + ", truth AS (SELECT r, c FROM cell WHERE flag = 'R'), pred AS (SELECT r, c FROM cell WHERE flag = 'A')"


def offs(most_d2: int, least_d2: int = 0, name: str = "offs") -> str:
    k = int(most_d2**0.5) + 1
    return f"""{name} AS (SELECT CAST(y AS INTEGER) dy, CAST(x AS INTEGER) dx, CAST(y * y + x * x AS BIGINT) d2 FROM (SELECT unnest(range(-{k}, {k + 1})) y),
 (SELECT unnest(range(-{k}, {k + 1})) x) WHERE y * y + x * x BETWEEN {least_d2} AND {most_d2})"""


def digest(rows: str, by: str = "") -> str:
    """SQL expressions that end in ``tree4`` (by, k, digest, keys): the digest tree of rows (by, k)."""
    own = f"{by}, " if by else ""
    steps = [f"tree0 AS (SELECT {own}k >> 8 AS k, sha256(string_agg(CAST(k AS VARCHAR), ',' ORDER BY k)) AS digest, count(*) AS keys FROM (SELECT DISTINCT {own}k FROM {rows}) x GROUP BY ALL)"]
    for i, shift in enumerate((8, 8, 8, 40)):
        steps.append(f"tree{i + 1} AS (SELECT {own}t.k >> {shift} AS k, sha256(string_agg(t.k || ':' || digest, ',' ORDER BY t.k)) AS digest, CAST(sum(keys) AS BIGINT) AS keys FROM tree{i} t GROUP BY ALL)")
    return ", ".join(steps)


def query(name: str, sql: str | None = None, whole: str = "") -> Callable[[Query], Query]:
    """Registers a query and its SQL; ``whole`` names columns that SQL sums as wider integers."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in whole.split())
            ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql
        return f

    return keep
