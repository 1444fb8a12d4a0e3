"""A portable pseudo-random integer from (place, iteration, seed): the same in any SQL engine with 64-bit integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647


def mixed(place: Column, iteration: Column, seed: int = 0) -> Column:
    """A number below PRIME; three quadratic rounds keep every square below 2^62."""
    x = (place * 1103515245 + iteration * (40503 * 65537) + seed) % PRIME
    for turn in range(3):
        x = (x * x + 12345 + 7919 * turn + place + 31 * iteration) % PRIME
    return x
