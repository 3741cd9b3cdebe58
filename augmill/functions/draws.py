"""Hash draws: every random choice in the engine is a pure function of its key.

A draw is keyed by ``purpose|seed|part1|part2|...``. The md5 of that key gives
an unsigned 60-bit integer (first 15 hex digits), a uniform double (from 8 of them)
and a full-width sort key (the 32 hex digits). Results therefore do not depend on partitioning, retries or
executor loss, and the DuckDB twin in :func:`sql_draw` reproduces them exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _key(purpose: str, seed: int, parts) -> Column:
    cols = [F.lit(purpose), F.lit(str(seed))]
    for p in parts:
        cols.append(p if isinstance(p, Column) else F.lit(p))
    return F.concat_ws("|", *cols)


def draw(purpose: str, seed: int, *parts) -> Column:
    """Unsigned 60-bit integer draw as BIGINT."""
    return F.conv(F.substring(F.md5(_key(purpose, seed, parts)), 1, 15), 16, 10).cast("bigint")


def uniform(purpose: str, seed: int, *parts) -> Column:
    """Uniform double in [0, 1)."""
    return F.conv(F.substring(F.md5(_key(purpose, seed, parts)), 1, 8), 16, 10).cast("bigint") / F.lit(TWO32)


def above(p: float, purpose: str, seed: int, *parts) -> Column:
    """``uniform(...) > p`` from the digits alone: no number is made of them."""
    if not 0 <= p < 1:
        return F.lit(p < 0)
    return F.md5(_key(purpose, seed, parts)) > F.lit(f"{int(p * TWO32):08x}g")  # "g" is above the digits that follow


def sort_key(purpose: str, seed: int, *parts) -> Column:
    """Full md5 hex string: a collision-free random order key."""
    return F.md5(_key(purpose, seed, parts))


def choice(n: Column, purpose: str, seed: int, *parts) -> Column:
    """Uniform integer in [0, n)."""
    return F.pmod(draw(purpose, seed, *parts), n)


# --- SQL twins (Spark SQL text and DuckDB text share the same shape) ---------

def _sql_key(purpose: str, seed: int, parts) -> str:
    return "concat_ws('|', " + ", ".join([f"'{purpose}'", f"'{seed}'", *parts]) + ")"


def sql_draw(purpose: str, seed: int, *parts: str, dialect: str = "duckdb", digits: int = 15) -> str:
    key = _sql_key(purpose, seed, parts)
    if dialect == "duckdb":
        return f"CAST('0x' || substr(md5({key}), 1, {digits}) AS BIGINT)"
    return f"CAST(conv(substr(md5({key}), 1, {digits}), 16, 10) AS BIGINT)"


def sql_uniform(purpose: str, seed: int, *parts: str, dialect: str = "duckdb") -> str:
    return f"({sql_draw(purpose, seed, *parts, dialect=dialect, digits=8)} / 4294967296.0::DOUBLE)" if dialect == "duckdb" \
        else f"({sql_draw(purpose, seed, *parts, dialect=dialect, digits=8)} / 4294967296.0D)"


def sql_sort_key(purpose: str, seed: int, *parts: str) -> str:
    return f"md5({_sql_key(purpose, seed, parts)})"
