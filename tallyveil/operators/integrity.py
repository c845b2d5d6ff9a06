"""Reconciliation of lines with their header, fingerprints and tamper checks."""

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyveil.functions.jsontext import line_json, lines_fingerprint
from tallyveil.functions.money import approx_equal
from tallyveil.plans.scale import keep_where
from tallyveil.schema import CHECKS, LINE, MONEY

# Lines hashed as one piece of text; an invoice with more is hashed piece after piece.
CHUNK = 4096
# Lines of an invoice, at most, whose pieces one task gathers.
SPAN = 1 << 16


def _sum(lines: Column, name: str) -> Column:
    zero = F.lit(0).cast("decimal(28,2)")
    return F.aggregate(lines, zero, lambda total, l: (total + l[name]).cast("decimal(28,2)")).try_cast(MONEY)


def checks_of(lines: Column, invoice: Column) -> Column:
    """Counts and sums of a nested line set against the header; no shuffle."""
    tax, total = _sum(lines, "tax_amount"), _sum(lines, "total")
    return F.struct(
        F.size(lines).alias("line_count"),
        tax.alias("line_tax_sum"),
        total.alias("line_total_sum"),
        approx_equal(tax, invoice["amount_tax"]).alias("line_tax_sum_equals_header"),
        approx_equal(total, invoice["amount_total"]).alias("line_total_sum_equals_amount_total"),
    ).cast(CHECKS)


def build_checks(docs: DataFrame) -> DataFrame:
    return docs.withColumn("checks", checks_of(F.col("lines"), F.col("invoice")))


def build_checks_flat(lines: DataFrame, headers: DataFrame, key: str) -> DataFrame:
    """The flat form: partial sums per key, then a join of one row per invoice on each side."""
    sums = lines.groupBy(key).agg(
        F.count("*").cast("int").alias("line_count"),
        F.sum("tax_amount").cast(MONEY).alias("line_tax_sum"),
        F.sum("total").cast(MONEY).alias("line_total_sum"),
    )
    zero = F.lit(0).cast(MONEY)
    joined = headers.select(key, "amount_tax", "amount_total").join(sums, key, "left").select(
        key, "amount_tax", "amount_total",
        F.coalesce("line_count", F.lit(0)).alias("line_count"),
        F.coalesce("line_tax_sum", zero).alias("line_tax_sum"),
        F.coalesce("line_total_sum", zero).alias("line_total_sum"),
    )
    return joined.select(
        key, "line_count", "line_tax_sum", "line_total_sum",
        approx_equal(F.col("line_tax_sum"), F.col("amount_tax")).alias("line_tax_sum_equals_header"),
        approx_equal(F.col("line_total_sum"), F.col("amount_total")).alias("line_total_sum_equals_amount_total"),
    )


def with_fingerprint(docs: DataFrame) -> DataFrame:
    sha = lines_fingerprint(F.col("lines"))
    return docs.withColumn("metadata", F.col("metadata").withField("integrity_sha256", sha))


def fingerprint_flat(lines: DataFrame, key: str, chunk: int = CHUNK, headers: DataFrame | None = None) -> DataFrame:
    """Fingerprint per invoice from a flat line table with dense line indices.

    Lines are rendered where they lie and gathered in pieces of at most ``chunk`` lines. An invoice
    that fits one piece is hashed at once. The pieces of the others are streamed in order through a
    running hash, never held together. The pieces of up to SPAN lines lie in one task, so texts move
    once; only an invoice with more spreads over many tasks, and its pieces move to its hash.
    With ``headers``, their invoices without lines get the fingerprint of no lines.
    """
    text = line_json(F.struct(*[F.col(f) for f in LINE.fieldNames()]))
    span = chunk * max(1, SPAN // chunk)
    place = F.coalesce(F.floor(F.col("line_index") / span), F.lit(0))
    pieces = (
        lines.select(key, "line_index", F.floor(F.col("line_index") / chunk).alias("piece"), place.alias("span"), text.alias("text"))
        .repartition(F.col(key), F.col("span"))
        .groupBy(key, "span", "piece")
        .agg(
            F.count("*").alias("n"),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("line_index", "text"))), lambda s: s["text"]), ","
            ).alias("text"),
        )
    )
    whole = (F.col("piece") == 0) & (F.col("n") < chunk)
    # Filters behind a generator leave both branches on one equal aggregate, whose shuffle Spark reuses.
    small = keep_where(pieces, whole).select(key, F.sha2(F.concat(F.lit("["), "text", F.lit("]")), 256).alias("integrity_sha256"))
    # Of dense lines, those of an invoice that do not fill its first span are all.
    counted = keep_where(pieces.withColumn("held", F.sum("n").over(Window.partitionBy(key, "span"))), ~whole)
    inside = (F.col("span") == 0) & (F.col("held") < span)
    medium = keep_where(counted, inside).select(key, "piece", "text").sortWithinPartitions(key, "piece")
    large = keep_where(counted, ~inside).select(key, "piece", "text").repartition(F.col(key)).sortWithinPartitions(key, "piece")
    key_type = lines.schema[key].dataType.simpleString()

    def running(batches):
        current, digest = None, None
        for batch in batches:
            done = []
            for name, piece in zip(batch[key], batch["text"]):
                if digest is None or name != current:
                    if digest is not None:
                        digest.update(b"]")
                        done.append((current, digest.hexdigest()))
                    current, digest = name, hashlib.sha256(b"[")
                else:
                    digest.update(b",")
                digest.update(piece.encode("utf-8"))
            yield pd.DataFrame(done, columns=[key, "integrity_sha256"])
        if digest is not None:
            digest.update(b"]")
            yield pd.DataFrame([(current, digest.hexdigest())], columns=[key, "integrity_sha256"])

    done = small
    for streamed in (medium, large):
        done = done.unionByName(streamed.mapInPandas(running, f"{key} {key_type}, integrity_sha256 string"))
    if headers is None:
        return done
    bare = headers.select(key).distinct().join(lines.select(key).distinct(), key, "left_anti")
    return done.unionByName(bare.withColumn("integrity_sha256", F.sha2(F.lit("[]").cast("binary"), 256)))


def verify_documents(docs: DataFrame) -> DataFrame:
    """Adds ``sha_ok``, ``checks_ok`` and ``tampered`` by computing both again."""
    again = checks_of(F.col("lines"), F.col("invoice"))
    return (
        docs.withColumn("sha_ok", F.col("metadata.integrity_sha256").eqNullSafe(lines_fingerprint(F.col("lines"))))
        .withColumn("checks_ok", F.col("checks").eqNullSafe(again))
        .withColumn("tampered", ~(F.col("sha_ok") & F.col("checks_ok")))
    )
