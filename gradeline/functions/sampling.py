"""Seeded draws that depend only on a row's key, never on row order or partitioning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A prime below 2^31: products of two residues stay inside a 64-bit long.
MODULUS = 2_147_483_647


def hash_uniform(key: Column, salt: str) -> Column:
    """Uniform draw in [0, 1) from the first 32 bits of md5(salt|key)."""
    digest = F.md5(F.concat_ws("|", F.lit(salt), key.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_digits(key: Column, salt: str) -> Column:
    """Whole-number draw from the first 60 bits of md5(salt|key)."""
    digest = F.md5(F.concat_ws("|", F.lit(salt), key.cast("string")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def poisson_thresholds(limit: int = 12) -> list[int]:
    """Integer cut points of the Poisson(1) distribution on 0..MODULUS-1."""
    total, cuts = 0.0, []
    for k in range(limit):
        total += math.exp(-1.0) / math.factorial(k)
        cuts.append(min(MODULUS, math.ceil(total * MODULUS)))
    return cuts


def replicate_coefficients(seed: int, replicates: int) -> list[tuple[int, ...]]:
    """Seven residues per replicate: a cubic in a row's first residue and one without constant in its second, over a prime field."""
    import hashlib

    rows = []
    for replicate in range(replicates):
        digest = hashlib.sha256(f"{seed}|{replicate}".encode()).hexdigest()
        rows.append(tuple(int(digest[i:i + 8], 16) % MODULUS for i in range(0, 56, 8)))
    return rows


def concat_key(columns: Sequence[Column]) -> Column:
    """One text for a row: each value after its length, a mark for NULL, so that no two rows share one."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("~")) for c in texts])
