"""The canonical JSON text of a line set and its fingerprint.

``to_json`` drops nulls, keeps raw Unicode and writes doubles in another notation, so the text
is put together here, key by key in alphabetical order.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyveil.functions.money import float_text, money_text

# JSON short escapes; every other character outside printable ASCII becomes \uXXXX.
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\f": "\\f", "\b": "\\b"}


def _escape_char(char: Column) -> Column:
    units = F.hex(F.encode(char, "UTF-16BE"))
    escaped = F.regexp_replace(F.lower(units), "(.{4})", r"\\u$1")
    out = F.when(char.rlike(r"^[ !#-\[\]-~]$"), char)
    for raw, short in _SHORT.items():
        out = out.when(char == raw, F.lit(short))
    return out.otherwise(escaped)


def json_string(text: Column) -> Column:
    """A JSON string literal in ASCII, or ``null``."""
    chars = F.regexp_extract_all(text, F.lit("(?s)(.)"), F.lit(1))
    slow = F.array_join(F.transform(chars, _escape_char), "")
    body = F.when(text.rlike(r"\A[ !#-\[\]-~]*\z"), text).otherwise(slow)
    return F.coalesce(F.concat(F.lit('"'), body, F.lit('"')), F.lit("null"))


def _or_null(text: Column) -> Column:
    return F.coalesce(text, F.lit("null"))


def line_json(line: Column) -> Column:
    """One line as compact JSON; the keys stand in alphabetical order."""
    taxes = F.array_join(F.transform(line["taxes"], json_string), ",")
    parts = {
        "currency": json_string(line["currency"]),
        "description": json_string(line["description"]),
        "line_index": _or_null(line["line_index"].cast("string")),
        "product": json_string(line["product"]),
        "quantity": _or_null(float_text(line["quantity"])),
        "source": json_string(line["source"]),
        "subtotal": _or_null(money_text(line["subtotal"])),
        "tax_amount": _or_null(money_text(line["tax_amount"])),
        "taxes": F.concat(F.lit("["), F.coalesce(taxes, F.lit("")), F.lit("]")),
        "total": _or_null(money_text(line["total"])),
        "unit_price": _or_null(float_text(line["unit_price"])),
    }
    pieces = []
    for position, (key, text) in enumerate(parts.items()):
        pieces += [F.lit(("{" if position == 0 else ",") + f'"{key}":'), text]
    return F.concat(*pieces, F.lit("}"))


def canonical_json(lines: Column) -> Column:
    """Compact JSON list of an array of lines, in array order."""
    return F.concat(F.lit("["), F.array_join(F.transform(lines, line_json), ","), F.lit("]"))


def lines_fingerprint(lines: Column) -> Column:
    """SHA-256 over the canonical JSON of the lines, ordered by line_index."""
    ordered = F.array_sort(lines, lambda a, b: a["line_index"] - b["line_index"])
    return F.sha2(canonical_json(ordered), 256)
