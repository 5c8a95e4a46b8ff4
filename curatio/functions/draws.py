"""Deterministic keyed draws (replace process-global ``random`` / ``uuid4``).

``draw(seed, purpose, key, n)`` = first 32 bits of ``md5("seed|purpose|key")`` mod n.
It depends only on the row's natural key, so results are identical under any
partitioning, retries or executor loss, and a DuckDB ``md5`` reproduces them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(seed, purpose: str, *keys) -> Column:
    parts = [F.lit(str(seed)), F.lit(purpose)] + [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.concat_ws("|", *[p.cast("string") for p in parts])


def hash32(seed, purpose: str, *keys) -> Column:
    """Unsigned 32-bit value from md5 of the key (as BIGINT)."""
    return F.conv(F.substring(F.md5(_key(seed, purpose, *keys)), 1, 8), 16, 10).cast("bigint")


def draw(seed, purpose: str, n, *keys) -> Column:
    """Uniform integer in ``[0, n)``; ``n`` may be a Column."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(hash32(seed, purpose, *keys), n.cast("bigint"))


def draw_range(seed, purpose: str, lo, hi, *keys) -> Column:
    """``random.randint(lo, hi)`` analogue (inclusive)."""
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return lo + draw(seed, purpose, hi - lo + 1, *keys)


def order_key(seed, purpose: str, *keys) -> Column:
    """Full md5 text; ordering by it is a seeded shuffle (O2)."""
    return F.md5(_key(seed, purpose, *keys))


def stable_id(*keys) -> Column:
    """Id from natural keys (stable under retries, unlike uuid4)."""
    return F.md5(F.concat_ws("|", *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


# --- DuckDB text of the same expressions (used by the oracle SQL) ---------------

def sql_key(seed, purpose: str, *keys: str) -> str:
    return "concat_ws('|', " + ", ".join([f"'{seed}'", f"'{purpose}'"] + [f"CAST({k} AS VARCHAR)" for k in keys]) + ")"


def sql_hash32(seed, purpose: str, *keys: str) -> str:
    return f"CAST(('0x' || substr(md5({sql_key(seed, purpose, *keys)}), 1, 8)) AS BIGINT)"


def sql_draw(seed, purpose: str, n, *keys: str) -> str:
    return f"(({sql_hash32(seed, purpose, *keys)}) % ({n}))"


def sql_order_key(seed, purpose: str, *keys: str) -> str:
    return f"md5({sql_key(seed, purpose, *keys)})"
