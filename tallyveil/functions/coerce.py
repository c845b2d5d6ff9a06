"""Coercion of dynamic JSON values (VARIANT columns) to typed columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyveil.functions.money import let, money_of_double
from tallyveil.schema import MONEY


def field(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def seen(value: Column, body) -> Column:
    """``body(value, kind)`` with the kind evaluated once. The value itself is used several times, so
    it should be a column or a struct field; bind anything costlier with ``let`` first."""
    return let(kind(value), lambda k: body(value, k))


def is_text(value: Column) -> Column:
    return kind(value) == "STRING"


def is_list(value: Column) -> Column:
    return kind(value).startswith("ARRAY")


def is_object(value: Column) -> Column:
    """A cast to a struct of one field needs an object and looks at nothing else in it."""
    return F.try_variant_get(value, "$", "struct<id:variant>").isNotNull()


def record(value: Column, *fields: str) -> Column:
    """Some fields of a JSON object as a struct of VARIANTs, in one pass; null for other values."""
    return F.try_variant_get(value, "$", f"struct<{','.join(f'{f}:variant' for f in fields)}>")


def numeric_kind(shape: Column) -> Column:
    return shape.startswith("DECIMAL") | shape.isin("BIGINT", "DOUBLE", "FLOAT")


def is_numeric(value: Column) -> Column:
    return numeric_kind(kind(value))


def items_of(value: Column) -> Column:
    """The elements of a JSON list, or null for any other value."""
    return F.try_variant_get(value, "$", "array<variant>")


def _plain(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def text_of(value: Column) -> Column:
    """A JSON string, or null. ``false`` is not a string here, though a plain cast says 'false'."""
    return F.when(is_text(value), _plain(value))


def filled(text: Column) -> Column:
    return F.when(text != "", text)


def truthy(value: Column) -> Column:
    """Whether a JSON value counts as present: not null, false, zero or empty."""

    def test(v: Column, shape: Column) -> Column:
        return (
            F.when(shape == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
            .when(shape == "STRING", _plain(v) != "")
            .when(shape.startswith("ARRAY"), F.size(items_of(v)) > 0)
            .when(shape.startswith("OBJECT"), shape != "OBJECT<>")
            .when(shape == "VOID", F.lit(False))
            .otherwise(F.try_variant_get(v, "$", "double") != 0)
        )

    return F.coalesce(seen(value, test), F.lit(False))


def relational_name(value: Column) -> Column:
    """Name out of ``{display_name | name}``, ``[id, name]`` or a plain string.

    The shape is told by what the value can be read as, which costs less than its schema.
    """

    def of_object(r: Column) -> Column:
        return F.coalesce(filled(text_of(r["display_name"])), text_of(r["name"]))

    def of_list(i: Column) -> Column:
        return F.when(F.size(i) == 2, text_of(F.get(i, F.lit(1))))

    def other(v: Column) -> Column:
        return let(items_of(v), lambda i: F.when(i.isNotNull(), of_list(i)).otherwise(text_of(v)))

    return let(record(value, "display_name", "name"), lambda r: F.when(r.isNotNull(), of_object(r)).otherwise(other(value)))


def _whole(value: Column) -> Column:
    return let(value, lambda v: F.when(kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint")))


def relational_id(value: Column) -> Column:
    """Id out of ``{id}``, ``[id, ...]`` or a plain integer."""

    def other(v: Column) -> Column:
        return let(items_of(v), lambda i: F.when(i.isNotNull(), _whole(F.get(i, F.lit(0)))).otherwise(_whole(v)))

    return let(record(value, "id"), lambda r: F.when(r.isNotNull(), _whole(r["id"])).otherwise(other(value)))


# Text that counts as a number: digits may be grouped by single underscores.
_NUMBER_TEXT = (
    r"(?i)^[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+(?:_\d+)*)?"
    r"|inf|infinity|nan)$"
)

# Text of so few digits that the nearest cents of its double are its own.
_MONEY_TEXT = r"\A-?\d{1,12}(?:\.\d{1,2})?\z"

# The same as a JSON string, and the JSON text of a number short enough that it gives the double.
_MONEY_QUOTED = r'\A"-?\d{1,12}(?:\.\d{1,2})?"\z'
_NUMBER_JSON = r"\A-?\d{1,15}(?:\.\d{1,15})?\z"


def number_of_text(text: Column) -> Column:
    """Text to double; empty or unreadable text gives null."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(bare.rlike(_NUMBER_TEXT), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double"))


def _nonzero(number: Column) -> Column:
    # NULLIF would evaluate a costly expression twice.
    return let(number, lambda x: F.when(x != 0, x))


def _double(v: Column, shape: Column) -> Column:
    """A JSON number as a double. Reading a variant as another type than its own costs a new cast for each value, its text
    does not; the nearest double is the same."""
    return (
        F.when(shape == "BIGINT", F.try_variant_get(v, "$", "bigint").cast("double"))
        .when(shape.startswith("DECIMAL"), F.to_json(v).try_cast("double"))
        .otherwise(F.try_variant_get(v, "$", "double"))
    )


def _number(v: Column, shape: Column) -> Column:
    return (
        F.when(numeric_kind(shape), _nonzero(_double(v, shape)))
        .when(shape == "STRING", number_of_text(_plain(v)))
        .when(shape == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), F.lit(1.0)))
    )


def to_number(value: Column) -> Column:
    """JSON value to double. Null, false, empty text and a numeric zero give null."""

    def read(json: Column) -> Column:
        return F.when(json.rlike(_NUMBER_JSON), _nonzero(json.try_cast("double"))).otherwise(seen(value, _number))

    return let(F.to_json(value), read)


def money(value: Column) -> Column:
    """JSON value to money: as ``to_number``, then rounded to two places on the binary value.

    A literal with at most two decimals already is its own rounding; its JSON text tells it without a look at its type.
    """

    def read(json: Column) -> Column:
        return (
            F.when(json.rlike(_MONEY_TEXT), _nonzero(json.try_cast(MONEY)))
            .when(json.rlike(_MONEY_QUOTED), F.trim(json, F.lit('"')).try_cast(MONEY))
            .otherwise(seen(value, rounded))
        )

    def rounded(v: Column, shape: Column) -> Column:
        exact = _nonzero(F.to_json(v).try_cast(MONEY))
        short = (shape == "BIGINT") | (shape.startswith("DECIMAL") & F.substring(shape, -3, 3).isin(",0)", ",1)", ",2)"))
        return F.when(short, exact).when(shape == "STRING", let(_plain(v), of_text)).otherwise(money_of_double(_number(v, shape)))

    def of_text(text: Column) -> Column:
        return F.when(text.rlike(_MONEY_TEXT), text.try_cast(MONEY)).otherwise(money_of_double(number_of_text(text)))

    return let(F.to_json(value), read)


def pick(totals: Column, *keys: str) -> Column:
    """Money under the first key that is present and not null, even if it then coerces to null."""
    return let(record(totals, *keys), lambda r: pick_of(r, *keys))


def pick_of(fields: Column, *keys: str) -> Column:
    """The same from a struct of the JSON values."""
    return let(F.coalesce(*[F.when(~F.is_variant_null(fields[key]), fields[key]) for key in keys]), money)


def parse_localized_number(text: Column) -> Column:
    """'1,234.56' or '1.234,56 €' to double: the right-most of two separators is the decimal point;
    lone commas are decimal before one or two final digits, thousands otherwise."""

    def read(kept: Column) -> Column:
        comma, dot = kept.contains(","), kept.contains(".")
        last_comma = F.length(kept) - F.length(F.substring_index(kept, ",", -1))
        last_dot = F.length(kept) - F.length(F.substring_index(kept, ".", -1))
        no_comma = F.replace(kept, F.lit(","), F.lit(""))
        point = F.replace(kept, F.lit(","), F.lit("."))
        tail = F.length(F.substring_index(kept, ",", -1))
        return number_of_text(
            F.when(comma & dot & (last_comma > last_dot), F.translate(kept, ",.", "."))
            .when(comma & dot, no_comma)
            .when(comma & tail.isin(1, 2), point)
            .otherwise(no_comma)
        )

    return let(F.regexp_replace(text, r"[^\p{Nd},.\-]", ""), read)


def year_only(text: Column) -> Column:
    """First four characters when all are digits, else null."""
    return F.when(text.rlike(r"^\p{Nd}{4}"), F.substring(text, 1, 4))
