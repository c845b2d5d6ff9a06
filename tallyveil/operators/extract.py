"""From a raw invoice record to a typed header and typed lines. Everything stays in one row."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveil.functions import coerce
from tallyveil.functions.coerce import field, filled, money, pick_of, relational_id, relational_name, text_of, to_number
from tallyveil.functions.money import let, tax_amount
from tallyveil.plans.scale import inline_rows, keep_where
from tallyveil.schema import MONEY, RAW_LINE

# Fixed values.
UNNAMED = "(unnamed)"
UNKNOWN = "(unknown)"
RPC_SOURCE = "json-rpc"
DOM_SOURCE = "dom"
HEADER_SOURCE = "json-rpc:account.move/web_read"
FALLBACK_SOURCE = "dom-fallback"
NO_LINES = "no lines"
UNTAXED_KEYS = ("base_amount_currency", "base_amount", "amount_untaxed")
TAX_KEYS = ("tax_amount_currency", "tax_amount", "amount_tax")
TOTAL_KEYS = ("total_amount_currency", "total_amount", "amount_total")


def posted_only(moves: DataFrame) -> DataFrame:
    return moves.filter(F.col("state") == "posted")


def flag_unposted(df: DataFrame, state: str = "state") -> DataFrame:
    """A state other than 'posted' is a warning, not a reason to drop the row."""
    value = F.col(state)
    return df.withColumn("state_warning", F.coalesce((value != "") & (value != "posted"), F.lit(False)))


def customer_invoices_only(moves: DataFrame) -> DataFrame:
    return moves.filter(F.col("move_type") == "out_invoice")


ITEM_FIELDS = (
    "display_type", "product_id", "name", "quantity", "price_unit", "tax_ids", "price_subtotal", "price_total", "currency_id",
)
MOVE_FIELDS = ("name", "partner_id", "invoice_date", "state", "currency_id", "tax_totals")


def _shown_as_product(display_type: Column) -> Column:
    def test(v: Column, json: Column) -> Column:
        plain = json.isin('"product"', "false", "null")
        return F.when(plain, F.lit(True)).when(json.startswith('"'), F.lit(False)).otherwise(~coerce.truthy(v))

    return F.when(display_type.isNull(), F.lit(True)).otherwise(let(F.to_json(display_type), lambda json: test(display_type, json)))


def is_product_line(item: Column) -> Column:
    """An object whose display_type is missing, null, false or 'product'."""
    return coerce.is_object(item) & _shown_as_product(field(item, "$.display_type"))


def tax_names(tax_ids: Column) -> Column:
    """Names of a line's taxes in their order, nameless ones left out."""
    return _names_of(coerce.items_of(tax_ids))


def _names_of(taxes: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.coalesce(F.filter(F.transform(taxes, relational_name), lambda n: n.isNotNull() & (n != "")), empty)


def _items(move: Column, kind: str) -> Column:
    """The line items as values of a type: those of invoice_line_ids, or of line_ids when the first is empty.

    The list is chosen by its path and read once, so its items are not copied on the way.
    """
    first, second, none = F.lit("$.invoice_line_ids"), F.lit("$.line_ids"), F.lit(None).cast("string")
    # Fits every list, whatever its items, and reads next to nothing of them.
    size = F.size(F.try_variant_get(move, "$.invoice_line_ids", "array<struct<id:variant>>"))
    path = let(size, lambda n: F.when(n > 0, first).when(n.isNull() & coerce.truthy(field(move, "$.invoice_line_ids")), none).otherwise(second))
    return F.coalesce(F.try_variant_get(move, path, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))


def raw_items(move: Column) -> Column:
    """The line items: those of invoice_line_ids, or of line_ids when the first is empty."""
    return _items(move, "variant")


def _line(item: Column, index: Column) -> Column:
    zero = F.lit(0).cast(MONEY)
    read = F.struct(
        F.coalesce(money(item["price_subtotal"]), zero).alias("subtotal"),
        F.coalesce(money(item["price_total"]), zero).alias("total"),
        filled(text_of(item["name"])).alias("name"),
    )

    def struct(known: Column) -> Column:
        return F.struct(
            index.alias("line_index"),
            F.coalesce(filled(relational_name(item["product_id"])), known["name"], F.lit(UNNAMED)).alias("product"),
            known["name"].alias("description"),
            F.coalesce(to_number(item["quantity"]), F.lit(0.0)).alias("quantity"),
            F.coalesce(to_number(item["price_unit"]), F.lit(0.0)).alias("unit_price"),
            _names_of(item["tax_ids"]).alias("taxes"),
            known["subtotal"].alias("subtotal"),
            known["total"].alias("total"),
            relational_name(item["currency_id"]).alias("currency"),
            F.lit(RPC_SOURCE).alias("source"),
            tax_amount(known["subtotal"], known["total"]).alias("tax_amount"),
            relational_id(item["currency_id"]).alias("currency_id"),
        )

    return let(read, struct)


def lines_of(move: Column) -> Column:
    """Array of typed product lines with a dense index over the kept items."""
    fields = ",".join(f"{name}:{'array<variant>' if name == 'tax_ids' else 'variant'}" for name in ITEM_FIELDS)
    records = _items(move, f"struct<{fields}>")
    kept = F.filter(records, lambda r: r.isNotNull() & _shown_as_product(r["display_type"]))
    return F.transform(kept, _line)


def extract_lines(moves: DataFrame, move: str = "move") -> DataFrame:
    return moves.withColumn("lines", lines_of(F.col(move)))


def explode_lines(df: DataFrame, *keys: str) -> DataFrame:
    """The flat form: one row per line, no shuffle."""
    return inline_rows(df, "lines", *keys)


def _date_text(value: Column) -> Column:
    def text(v: Column, shape: Column) -> Column:
        return (
            F.when(shape == "STRING", F.try_variant_get(v, "$", "string"))
            .when(shape == "BOOLEAN", F.when(coerce.truthy(v), F.lit("True")))
            .when(coerce.truthy(v), F.try_variant_get(v, "$", "string"))
        )

    return coerce.seen(value, text)


def header_of(move: Column) -> Column:
    def header(m: Column) -> Column:
        return let(coerce.record(m["tax_totals"], *UNTAXED_KEYS, *TAX_KEYS, *TOTAL_KEYS), lambda totals: fields(m, totals))

    def fields(m: Column, totals: Column) -> Column:
        return F.struct(
            filled(text_of(m["name"])).alias("invoice_number"),
            F.coalesce(filled(relational_name(m["partner_id"])), F.lit(UNKNOWN)).alias("customer"),
            _date_text(m["invoice_date"]).alias("invoice_date"),
            text_of(m["state"]).alias("state"),
            relational_name(m["currency_id"]).alias("currency"),
            pick_of(totals, *UNTAXED_KEYS).alias("amount_untaxed"),
            pick_of(totals, *TAX_KEYS).alias("amount_tax"),
            pick_of(totals, *TOTAL_KEYS).alias("amount_total"),
            F.lit(HEADER_SOURCE).alias("source"),
        )

    return let(coerce.record(move, *MOVE_FIELDS), header)


def header_columns(move: str = "move") -> dict[str, Column]:
    currency_id = relational_id(field(F.col(move), "$.currency_id"))
    return {"invoice": header_of(F.col(move)), "invoice_currency_id": currency_id}


def extract_header(moves: DataFrame, move: str = "move") -> DataFrame:
    """Adds ``invoice`` (the header) and ``invoice_currency_id`` (still to be resolved)."""
    return moves.withColumns(header_columns(move))


def choose_lines(rpc: DataFrame, dom: DataFrame, keys: list[str]) -> DataFrame:
    """Payload lines where there are any, else the lines read from the form page.

    ``dom`` has the keys and ``dom_lines``, one row per invoice (see ``sources.html``). Only rows without payload lines
    go through the join. Adds ``used_source`` and ``reject_reason`` ('no lines' when both are empty).
    """
    has_lines = F.size("lines") > 0
    reason = F.lit(None).cast("string")
    settled = keep_where(rpc, has_lines).withColumns({"used_source": F.lit(RPC_SOURCE), "reject_reason": reason})
    return settled.unionByName(fill_from_pages(keep_where(rpc, ~has_lines), dom, keys))


def no_lines() -> Column:
    return F.array().cast(f"array<{RAW_LINE.simpleString()}>")


def fill_from_pages(bare: DataFrame, dom: DataFrame, keys: list[str]) -> DataFrame:
    """The lines of the form page for invoices whose payload has none."""
    pages = dom.select(*keys, F.col("dom_lines").cast(f"array<{RAW_LINE.simpleString()}>").alias("dom_lines"))
    lines = F.coalesce("dom_lines", no_lines())
    filled_in = bare.drop("lines").join(pages, keys, "left").withColumn("lines", lines).drop("dom_lines")
    reason = F.when(F.size("lines") == 0, F.lit(NO_LINES))
    return filled_in.withColumns({"used_source": F.lit(FALLBACK_SOURCE), "reject_reason": reason})


def has_product_lines(move: Column) -> Column:
    """Whether a record will give lines; far cheaper than reading them."""
    return F.exists(raw_items(move), is_product_line)


def with_metadata(
    df: DataFrame, tool: str, version: str, extracted_at: str, page_url: str | None = None,
    instance_url: str | None = None, modern_path: str | None = None,
) -> DataFrame:
    """Adds ``metadata``. ``extracted_at`` is taken once per run (see ``utc_now``).

    The scheme is 'modern' where ``modern_path`` stands in the page url, else 'legacy';
    ``page_url`` names a column.
    """
    scheme = F.lit(None).cast("string")
    if page_url and modern_path:
        scheme = F.when(F.col(page_url).contains(modern_path), F.lit("modern")).otherwise(F.lit("legacy"))
    source = F.when(F.col("used_source") == FALLBACK_SOURCE, F.lit(FALLBACK_SOURCE)).otherwise(F.col("invoice.source"))
    return df.withColumn(
        "metadata",
        F.struct(
            F.lit(tool).alias("tool"),
            F.lit(version).alias("tool_version"),
            F.lit(extracted_at).alias("extracted_at"),
            source.alias("source"),
            F.lit(instance_url).cast("string").alias("instance_url"),
            scheme.alias("url_scheme"),
            F.lit(False).alias("deidentified"),
            F.lit(None).cast("string").alias("integrity_sha256"),
        ),
    )


def utc_now() -> str:
    from datetime import datetime, timezone

    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def assemble(df: DataFrame, *keys: str) -> DataFrame:
    """The document columns: metadata, invoice, lines, checks."""
    return df.select(*keys, "metadata", "invoice", "lines", "checks")
