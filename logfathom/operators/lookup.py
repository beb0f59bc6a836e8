"""Left lookup of a keyed table by rows whose keys may be badly skewed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest table that is sent to every executor, in bytes of its text form.
BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_ROWS = 1_000_000
# Copies of a larger table; a key's rows are spread over as many tasks.
SALTS = 32


def fits_broadcast(table: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Measure a table (one aggregate row comes back) against the broadcast bound."""
    size = table.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.length(F.to_json(F.struct("*")))).alias("bytes"),
    ).first()
    return size.n <= BROADCAST_ROWS and (size.bytes or 0) <= max_bytes


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: dict[str, str],
    *,
    salt_by: Sequence[str],
    prefix: str = "",
    small: bool | None = None,
    salts: int = SALTS,
) -> DataFrame:
    """``rows`` left join ``table`` (unique on its key); table columns get ``prefix``.

    A table whose measured size is within the bound is broadcast. A larger
    one is shuffled, and because a key may hold a third of all rows, both
    sides get a salt: every table row is repeated per salt, a row of the big
    side picks one by the hash of ``salt_by``. Keys that are NULL match
    nothing and are spread by the same salt.
    """
    keys = set(on.values())
    named = table.select(
        *[F.col(c).alias(f"__k_{c}") if c in keys else F.col(c).alias(prefix + c) for c in table.columns]
    )
    test = F.lit(True)
    for left, right in on.items():
        test = test & (F.col(left) == F.col(f"__k_{right}"))
    spare = [f"__k_{c}" for c in keys]
    if fits_broadcast(table) if small is None else small:
        return rows.join(F.broadcast(named), test, "left").drop(*spare)
    pick = F.pmod(F.xxhash64(*[F.col(c) for c in salt_by]), F.lit(salts)).cast("int")
    left = rows.withColumn("__salt", pick)
    right = named.withColumn("__tsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = left.join(right, test & (F.col("__salt") == F.col("__tsalt")), "left")
    return joined.drop(*spare, "__salt", "__tsalt")
