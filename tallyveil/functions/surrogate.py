"""Salted surrogate keys: HMAC-SHA256 from built-in functions."""

import hashlib

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_BLOCK = 64
SALT_ID = "surrogate_salt_id"


class Surrogates:
    """Makes surrogate columns for one salt.

    The two key pads are read by scalar subqueries from a one-row table, so neither the salt nor
    its pads stand in any plan text. ``salt_id`` is a public name of the salt; it is kept in the
    column metadata and lets a join refuse keys made with another salt.
    """

    def __init__(self, spark: SparkSession, salt: str, salt_id: str = "default"):
        key = salt.encode("utf-8")
        if len(key) > _BLOCK:
            key = hashlib.sha256(key).digest()
        key = key.ljust(_BLOCK, b"\0")
        row = (bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key))
        pads = spark.createDataFrame([row], "inner_pad BINARY, outer_pad BINARY")
        self._inner = pads.select("inner_pad").scalar()
        self._outer = pads.select("outer_pad").scalar()
        self.salt_id = salt_id

    def of(self, value: Column, prefix: str) -> Column:
        """``prefix-`` and the first 12 hex digits of the keyed hash; null stays null."""
        inner = F.sha2(F.concat(self._inner, F.encode(value.cast("string"), "UTF-8")), 256)
        outer = F.sha2(F.concat(self._outer, F.unhex(inner)), 256)
        return F.concat(F.lit(prefix + "-"), F.substring(outer, 1, 12))

    def column(self, value: Column, prefix: str, name: str) -> Column:
        return self.of(value, prefix).alias(name, metadata={SALT_ID: self.salt_id})


def surrogate(spark: SparkSession, value: Column, salt: str, prefix: str) -> Column:
    return Surrogates(spark, salt).of(value, prefix)
