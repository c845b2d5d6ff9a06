"""Money and number expressions; all native, none calls Python on the executors."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyveil.schema import MONEY

TOLERANCE = 0.01


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, which may use it many times.

    It is the start of a sum of nothing. An element taken out of an array would cost more: Spark then derives the type of
    the whole ``body`` again for each value.
    """
    return F.aggregate(F.array(), value, lambda kept, _: kept, body)


def round_money(value: Column, places: int = 2) -> Column:
    """Round half up on the shortest decimal text of the value; null stays null."""
    return F.round(value, places)


def _nearest_cents(x: Column) -> Column:
    """Cents of a double, rounded on its exact binary value, ties to the even cent.

    The product ``x * 200`` is split in its rounded value and its rounding error, so the side
    of the half-cent on which ``x`` lies is known exactly.
    """

    def with_product(p: Column) -> Column:
        big = x * F.lit(134217729.0)
        high = big - (big - x)
        error = (high * 200.0 - p) + (x - high) * 200.0
        return let(F.rint(p), lambda half: from_half_cents(half, (p - half) + error))

    def from_half_cents(half: Column, side: Column) -> Column:
        low, up = (half - 1) / 2, (half + 1) / 2
        even = F.when(F.pmod(low, F.lit(2.0)) == 0, low).otherwise(up)
        return (
            F.when(F.pmod(half, F.lit(2.0)) == 0, half / 2)
            .when(side < 0, low)
            .when(side > 0, up)
            .otherwise(even)
        )

    return let(x * 200.0, with_product)


def money_of_double(value: Column) -> Column:
    """A double as money: correct rounding of the binary value to two places."""

    def rounded(x: Column) -> Column:
        exact = (_nearest_cents(x) / 100.0).try_cast(MONEY)
        return F.when(F.abs(x) < 1e13, exact).otherwise(F.round(x, 2).try_cast(MONEY))

    return let(value.cast("double"), rounded)


def approx_equal(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    """Null when either side is null, else whether both agree within the tolerance, inclusive."""
    return F.abs(F.round(a - b, 4)) <= F.lit(tolerance).cast("decimal(18,4)")


def approx_equal_double(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return F.abs(F.round(a - b, 4)) <= F.lit(tolerance)


def tax_amount(subtotal: Column, total: Column) -> Column:
    return (total - subtotal).cast(MONEY)


def float_text(value: Column) -> Column:
    """The shortest text of a double, plain between 1e-4 and 1e16 and with an exponent elsewhere."""
    size = F.abs(value)
    plain = F.regexp_replace(value.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    text = value.cast("string")
    digits = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    power = F.substring_index(text, "E", -1)
    exponent = F.concat(
        F.when(power.startswith("-"), F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(F.ltrim(power, F.lit("-")), 2, "0"),
    )
    return (
        F.when(F.isnan(value), F.lit("NaN"))
        .when(size == float("inf"), F.when(value > 0, F.lit("Infinity")).otherwise(F.lit("-Infinity")))
        .when(value == 0, F.when(text.startswith("-"), F.lit("-0.0")).otherwise(F.lit("0.0")))
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.concat(digits, exponent))
    )


def money_text(value: Column) -> Column:
    """Money as the text of the equal double: two places, or one when the last digit is 0."""
    return F.regexp_replace(value.cast("string"), r"0$", "")
