"""Column types of the extracted document.

Money is DECIMAL(18,2) in tables, so sums do not depend on the order of the rows; it becomes
a double only where a document is rendered as JSON.
"""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

LINE_FIELDS = {
    "line_index": T.IntegerType(),
    "product": T.StringType(),
    "description": T.StringType(),
    "quantity": T.DoubleType(),
    "unit_price": T.DoubleType(),
    "taxes": T.ArrayType(T.StringType()),
    "subtotal": MONEY,
    "total": MONEY,
    "currency": T.StringType(),
    "source": T.StringType(),
    "tax_amount": MONEY,
}
HEADER_FIELDS = {
    "invoice_number": T.StringType(),
    "customer": T.StringType(),
    "invoice_date": T.StringType(),
    "state": T.StringType(),
    "currency": T.StringType(),
    "amount_untaxed": MONEY,
    "amount_tax": MONEY,
    "amount_total": MONEY,
    "source": T.StringType(),
}
CHECK_FIELDS = {
    "line_count": T.IntegerType(),
    "line_tax_sum": MONEY,
    "line_total_sum": MONEY,
    "line_tax_sum_equals_header": T.BooleanType(),
    "line_total_sum_equals_amount_total": T.BooleanType(),
}
METADATA_FIELDS = {
    "tool": T.StringType(),
    "tool_version": T.StringType(),
    "extracted_at": T.StringType(),
    "source": T.StringType(),
    "instance_url": T.StringType(),
    "url_scheme": T.StringType(),
    "deidentified": T.BooleanType(),
    "integrity_sha256": T.StringType(),
}


def struct_of(fields: dict) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


LINE = struct_of(LINE_FIELDS)
HEADER = struct_of(HEADER_FIELDS)
CHECKS = struct_of(CHECK_FIELDS)
METADATA = struct_of(METADATA_FIELDS)
# A line as it leaves the payload: the currency id is still to be resolved.
RAW_LINE = T.StructType(LINE.fields + [T.StructField("currency_id", T.LongType())])
CAPTURE = "seq BIGINT, ts TIMESTAMP, url STRING, request STRING, response STRING"
