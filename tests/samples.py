"""Inputs shared by the tests."""

import json
import os

from tallyveil.plans.scale import shared_folder
from tallyveil.schema import CAPTURE

CALL = "https://erp.example/web/dataset/call_kw/account.move"
EUR_ID = 4

# The known fingerprints and surrogates of the two sample documents depend on them.
NUMBER, CUSTOMER = "INV/2026/00001", "Deco Addict"
GOODS = {
    "chair": ("Office Chair", "Office Chair, ergonomic mesh", 2.0, 120.5, "19%", 241.0, 286.79),
    "desk": ("Standing Desk", "Standing Desk, electric height-adjustable", 1.0, 380.0, "19%", 380.0, 452.2),
    "notebook": ("A5 Notebook", "A5 Notebook, dotted (pack)", 10.0, 6.9, "7%", 69.0, 73.83),
}
AMOUNTS = (690.0, 122.82000000000001, 812.82)


def pair(number, text, listed):
    """A relation in one of its two encodings."""
    return [number, text] if listed else {"id": number, "display_name": text}


def item(name, product_id, listed=False, **changed):
    """A product line of an invoice; relations come as lists or as objects."""
    product, label, quantity, price, tax, net, gross = GOODS[name]
    made = {
        "price_total": gross, "price_subtotal": net, "quantity": quantity, "price_unit": price, "name": label,
        "product_id": pair(product_id, product, listed), "tax_ids": [pair(50 + product_id, tax, listed)],
        "display_type": "product", "currency_id": [EUR_ID, "EUR"] if listed else {"id": EUR_ID},
    }
    return made | changed


CHAIR = item("chair", 31)
DESK = item("desk", 32, listed=True)
NOTEBOOK = item("notebook", 33, listed=True, display_type=False, currency_id=EUR_ID)
SECTION = {"name": "Second floor", "display_type": "line_section"}
MOVE = {
    "state": "posted", "invoice_date": "2026-05-20", "currency_id": {"id": EUR_ID}, "name": NUMBER,
    "partner_id": pair(70, CUSTOMER, False),
    "tax_totals": dict(zip(("base_amount_currency", "tax_amount_currency", "total_amount_currency"), AMOUNTS)),
    "invoice_line_ids": [SECTION, CHAIR, DESK, NOTEBOOK],
}
SEARCH = {"length": 1, "records": [{"id": 12, "currency_id": pair(EUR_ID, "EUR", False)}]}


def request(method, model="account.move"):
    return json.dumps({"params": {"model": model, "method": method}})


def exchange(seq, method, response, url=CALL):
    body = response if isinstance(response, str) else json.dumps(response)
    return (seq, None, url, request(method), body)


def captured(spark, *rows):
    return spark.createDataFrame(list(rows), CAPTURE)


def variants(spark, *values):
    from pyspark.sql import functions as F

    rows = [(i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "i INT, j STRING").select("i", F.try_parse_json("j").alias("v"))


def values(df):
    """The single value column of rows (i, x), in order of i."""
    return [r[1] for r in sorted(df.collect(), key=lambda r: r[0])]


def shared_names(spark):
    """What lies in the folder that all executors share."""
    return set(os.listdir(shared_folder(spark, "x").removeprefix("file:").rsplit("/", 1)[0]))
