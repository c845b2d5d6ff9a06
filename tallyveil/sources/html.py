"""Fallback reader: invoice lines out of captured form pages."""

import re
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveil.functions.coerce import filled, parse_localized_number
from tallyveil.functions.money import money_of_double, tax_amount
from tallyveil.functions.patterns import stripped
from tallyveil.operators.extract import DOM_SOURCE, UNNAMED
from tallyveil.plans.scale import inline_rows

# The row class and the cell names of the line table.
ROW_CLASS = "o_data_row"
CELLS = ("product_id", "name", "quantity", "price_unit", "tax_ids", "price_subtotal", "price_total")
_BREAKS = {"br", "p", "div", "li"}

# Markup that needs no parser: text, closing tags, and opening tags whose attributes are quoted and hold no reference.
# A tag whose content is no markup, such as a script, is not of this kind.
_TAG = r"""(?!(?i:script|style|textarea|title|iframe|noembed|noframes|noscript|xmp|plaintext)\b)[a-zA-Z][a-zA-Z0-9]*"""
_ATTRS = r"""(?:[ \t\n\r\f]+[a-zA-Z][-a-zA-Z0-9_]*=(?:"[^"<>&]*"|'[^'<>&]*'))*"""
_TOKEN = re.compile(rf"""([^<]+)|</({_TAG})>|<({_TAG})({_ATTRS})[ \t\n\r\f]*(/?)>""")
# The same without groups: some releases of Python (3.13.0) raise a SystemError for groups in a possessive repeat.
_PLAIN = re.compile(rf"""(?:[^<]+|</{_TAG}>|<{_TAG}{_ATTRS}[ \t\n\r\f]*/?>)*+""")
_ATTR = re.compile(r"""([a-zA-Z][-a-zA-Z0-9_]*)=(?:"([^"]*)"|'([^']*)')""")


class _LineTable(HTMLParser):
    """Collects the text of the first named cell of each kind per line row."""

    def __init__(self):
        super().__init__()
        self.rows, self._row, self._cell = [], None, None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "tr":
            self._cell = None
            self._row = {} if ROW_CLASS in (attrs.get("class") or "").split() else None
            if self._row is not None:
                self.rows.append(self._row)
        elif tag == "td" and self._row is not None:
            name = attrs.get("name")
            self._cell = name if name in CELLS and name not in self._row else None
            if self._cell:
                self._row[self._cell] = ""
        elif tag in _BREAKS and self._cell:
            self._row[self._cell] += "\n"

    def handle_endtag(self, tag):
        if tag in ("td", "tr"):
            self._cell = None

    def handle_data(self, data):
        if self._cell:
            self._row[self._cell] += data

    def feed_plain(self, text: str) -> None:
        """The same calls for a page of plain markup (``_PLAIN``), several times faster."""
        for data, closed, opened, attrs, closes in _TOKEN.findall(text):
            if data:
                if self._cell:
                    self.handle_data(unescape(data))
            elif closed:
                self.handle_endtag(closed.lower())
            else:
                tag = opened.lower()
                self.handle_starttag(tag, [(name.lower(), one or other) for name, one, other in _ATTR.findall(attrs)] if attrs else [])
                if closes:
                    self.handle_endtag(tag)


_CELLS = T.StructType([T.StructField(c, T.StringType()) for c in CELLS])


def _rows_of(page: str) -> list:
    table = _LineTable()
    if _PLAIN.fullmatch(page):
        table.feed_plain(page)
    else:
        table.feed(page)
        table.close()
    return table.rows


@F.arrow_udf(T.ArrayType(_CELLS))
def _line_cells(html: pa.Array) -> pa.Array:
    pages = [_rows_of(page.as_py() or "") for page in html]
    rows = [row for page in pages for row in page]
    cells = pa.StructArray.from_arrays([pa.array([row.get(c, "") for row in rows], pa.string()) for c in CELLS], CELLS)
    ends = np.cumsum([0, *map(len, pages)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)


def _cell(row: Column, name: str) -> Column:
    return stripped(row[name])


def _read(row: Column) -> Column:
    product = stripped(F.substring_index(_cell(row, "product_id"), "\n", 1))
    words = F.split(F.regexp_replace(_cell(row, "tax_ids"), r"(?U)[\s\x1c-\x1f]+", " "), " ")
    subtotal = F.coalesce(parse_localized_number(_cell(row, "price_subtotal")), F.lit(0.0))
    return F.struct(
        product.alias("product"),
        filled(_cell(row, "name")).alias("description"),
        parse_localized_number(_cell(row, "quantity")).alias("quantity"),
        F.coalesce(parse_localized_number(_cell(row, "price_unit")), F.lit(0.0)).alias("unit_price"),
        F.filter(words, lambda w: w != "").alias("taxes"),
        subtotal.alias("subtotal"),
        F.coalesce(parse_localized_number(_cell(row, "price_total")), subtotal).alias("total"),
    )


def _line(row: Column, index: Column) -> Column:
    subtotal, total = money_of_double(row["subtotal"]), money_of_double(row["total"])
    return F.struct(
        index.alias("line_index"),
        F.coalesce(filled(row["product"]), F.lit(UNNAMED)).alias("product"),
        row["description"].alias("description"),
        F.coalesce(row["quantity"], F.lit(0.0)).alias("quantity"),
        row["unit_price"].alias("unit_price"),
        row["taxes"].alias("taxes"),
        subtotal.alias("subtotal"),
        total.alias("total"),
        F.lit(None).cast("string").alias("currency"),
        F.lit(DOM_SOURCE).alias("source"),
        tax_amount(subtotal, total).alias("tax_amount"),
        F.lit(None).cast("bigint").alias("currency_id"),
    )


def lines_from_html(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``dom_lines``, the typed lines of a page in order.

    Python reads only the raw cell text, batch by batch; numbers, defaults and numbering are
    native. A row with neither a product nor a readable quantity is skipped. ``dom_amounts``
    keeps the unrounded subtotal and total of each line.
    """
    rows = pages.withColumn("__cells", _line_cells(html))
    kept = F.filter(
        F.transform("__cells", _read), lambda r: (r["product"] != "") | r["quantity"].isNotNull()
    )
    rows = rows.withColumn("__rows", kept)
    return (
        rows.withColumn("dom_lines", F.transform("__rows", _line))
        .withColumn("dom_amounts", F.transform("__rows", lambda r: F.struct(r["subtotal"].alias("subtotal"), r["total"].alias("total"))))
        .drop("__cells", "__rows")
    )


def lines_of_pages(pages: DataFrame, *keys: str) -> DataFrame:
    """The flat form: one row per line."""
    return inline_rows(lines_from_html(pages), "dom_lines", *keys)
