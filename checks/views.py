"""Billing data derived from the given tables by Spark.

An invoice is an order, whatever its number of lines. The payloads carry the encodings, gaps and
errors that the extraction has to cope with, planted by order key.
"""

import atexit
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyveil.plans.scale import SPLIT, STORED_AS, numbered_within, shared_folder, spread
from tallyveil.schema import MONEY

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
CALL = "https://erp.example/web/dataset/call_kw/account.move"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table for heavy work per row, dealt out over the cores where its files are few."""
    return spread(table(spark, sf, name))


def ensure_shared_folder(spark: SparkSession) -> None:
    """Use the folder the cluster names; only where none is named, as in tests, make one."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    folder = tempfile.mkdtemp(prefix="tallyveil-")
    atexit.register(shutil.rmtree, folder, True)
    spark.sparkContext.setCheckpointDir(folder)


_STORED: dict = {}


def stored(spark: SparkSession, sf: str, name: str, build) -> DataFrame:
    """A derived table, written once per application to the shared folder and read from there.

    Captured exchanges and pages are files in practice; reading them as such keeps the making of
    the inputs out of the plans that work on them.
    """
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STORED:
        ensure_shared_folder(spark)
        path = shared_folder(spark, name)
        df = build(spark, sf)
        df.write.option("parquet.block.size", SPLIT).parquet(path, compression=STORED_AS)
        _STORED[key] = (path, df.schema)
    path, schema = _STORED[key]
    return spread(spark.read.schema(schema).parquet(path))


def js(text: Column) -> Column:
    """A JSON string literal, or null as JSON; plain text needs no JSON writer."""
    listed = F.to_json(F.array(text))
    escaped = F.substring(listed, 2, F.length(listed) - 2)
    plain = F.when(text.rlike(r"^[ !#-\[\]-~]*$"), F.concat(F.lit('"'), text, F.lit('"')))
    return F.when(text.isNull(), "null").otherwise(F.coalesce(plain, escaped))


def _amounts(items: DataFrame) -> DataFrame:
    dec = lambda name: F.col(name).cast(MONEY)
    subtotal = F.round(dec("l_extendedprice") * (F.lit(1) - dec("l_discount")), 2).cast(MONEY)
    items = items.withColumn("subtotal", subtotal)
    return items.withColumn("total", (F.col("subtotal") + F.round(F.col("subtotal") * dec("l_tax"), 2)).cast(MONEY))


def nested_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(k, items): the lines of each invoice in order."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    items = _amounts(table(spark, sf, "lineitem")).join(parts, "l_partkey", "left")
    kept = F.struct(*LINE_ORDER, "subtotal", "total", "p_name")
    return items.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(kept)).alias("items"))


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """The flat line table in the shape of the document's lines, with a dense line_index."""
    ensure_shared_folder(spark)
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    # Only the columns that number the lines or make them pass through the numbering.
    items = table(spark, sf, "lineitem").select("l_orderkey", *LINE_ORDER)
    flat = _amounts(numbered_within(items.join(parts, "l_partkey", "left"), "l_orderkey", LINE_ORDER, "line_index"))
    return flat.select(
        F.col("l_orderkey").alias("seq"), F.col("line_index").cast("int").alias("line_index"),
        F.col("p_name").alias("product"),
        F.concat(F.col("p_name"), F.lit(", lot "), F.col("l_suppkey").cast("string")).alias("description"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("unit_price"),
        F.array(tax_tag(F.col("l_tax"))).alias("taxes"),
        "subtotal", "total",
        F.lit("EUR").alias("currency"),
        F.lit("json-rpc").alias("source"),
        (F.col("total") - F.col("subtotal")).cast(MONEY).alias("tax_amount"),
    )


def tax_tag(rate: Column) -> Column:
    return F.concat(F.round(rate * 100).cast("int").cast("string"), F.lit("%"))


def line_amounts(spark: SparkSession, sf: str) -> DataFrame:
    """(k, subtotal, total, tax_amount) per line, in no order and without a shuffle."""
    items = _amounts(table(spark, sf, "lineitem"))
    tax = (F.col("total") - F.col("subtotal")).cast(MONEY)
    return items.select(F.col("l_orderkey").alias("k"), "subtotal", "total", tax.alias("tax_amount"))


def _summed(spark: SparkSession, sf: str) -> DataFrame:
    sums = [F.sum(c).cast(MONEY).alias(f"sum_{c}") for c in ("subtotal", "total")]
    return line_amounts(spark, sf).groupBy("k").agg(F.count("*").alias("line_count"), *sums)


def _summed_with_items(spark: SparkSession, sf: str) -> DataFrame:
    total = lambda name: F.aggregate("items", F.lit(0).cast(MONEY), lambda acc, i: (acc + i[name]).cast(MONEY))
    sums = {f"sum_{c}": total(c) for c in ("subtotal", "total")}
    return nested_lines(spark, sf).withColumns({"line_count": F.size("items").cast("bigint"), **sums})


def invoices(spark: SparkSession, sf: str, items: bool = False) -> DataFrame:
    """One row per invoice: facts of the order and header amounts with planted errors.

    The amounts come from partial sums; only with ``items`` are the lines themselves gathered.
    """
    billed = _summed_with_items(spark, sf) if items else _summed(spark, sf)
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("customer"), F.col("c_nationkey").alias("nation")
    )
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", "o_orderstatus", "o_orderdate")
    k = F.col("k")
    known = orders.join(customers, "o_custkey", "left").join(billed, "k", "left").fillna(0, ["line_count"])
    digits = k.cast("string")
    padded = F.lpad(digits, F.greatest(F.lit(5), F.length(digits)), "0")
    state = F.when(F.col("o_orderstatus") == "F", "posted").when(F.col("o_orderstatus") == "O", "draft").otherwise("cancel")
    number = F.concat(F.lit("INV/"), F.year("o_orderdate").cast("string"), F.lit("/"), padded)
    listed = ["items"] if items else []
    error = F.when(k % 10 == 0, 1.0).when(k % 10 == 1, 0.01).otherwise(0.0).cast(MONEY)
    missing = (k % 10 == 2) | (F.col("line_count") == 0)
    out = known.select(
        "k", k.alias("seq"), "customer", F.col("nation").cast("bigint").alias("nation"), "line_count", *listed,
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("invoice_date"),
        state.alias("state"), number.alias("number"), error.alias("error"), missing.alias("missing"),
        "sum_subtotal", "sum_total",
    )
    tax = (F.col("sum_total") - F.col("sum_subtotal") + F.col("error")).cast(MONEY)
    return out.select(
        "k", "seq", "customer", "nation", "line_count", *listed, "invoice_date", "state",
        F.when(F.col("state") != "draft", F.col("number")).alias("invoice_number"),
        F.when(~F.col("missing"), F.col("sum_subtotal")).alias("amount_untaxed"),
        F.when(~F.col("missing"), tax).alias("amount_tax"),
        F.when(~F.col("missing"), (F.col("sum_total") + F.col("error")).cast(MONEY)).alias("amount_total"),
    )


def _item_json(k: Column, nation: Column, item: Column, index: Column) -> Column:
    name, part = js(item["p_name"]), item["l_partkey"].cast("string")
    product = (
        F.when(k % 4 == 0, F.concat(F.lit('"product_id":{"id":'), part, F.lit(',"display_name":'), name, F.lit("},")))
        .when(k % 4 == 1, F.concat(F.lit('"product_id":['), part, F.lit(","), name, F.lit("],")))
        .when(k % 4 == 2, F.concat(F.lit('"product_id":{"id":'), part, F.lit(',"display_name":"","name":'), name, F.lit("},")))
        .otherwise(F.lit('"product_id":false,'))
    )
    label = F.when(k % 4 == 3, item["p_name"]).otherwise(
        F.concat(item["p_name"], F.lit(", lot "), item["l_suppkey"].cast("string"))
    )
    display = (
        F.when(index % 3 == 0, F.lit('"display_type":"product",'))
        .when(index % 3 == 1, F.lit('"display_type":false,'))
        .otherwise(F.lit(""))
    )
    tag = js(tax_tag(item["l_tax"]))
    taxes = (
        F.when(k % 3 == 0, F.concat(F.lit('[{"id":18,"display_name":'), tag, F.lit("}]")))
        .when(k % 3 == 1, F.concat(F.lit('[{"id":0,"display_name":""},[18,'), tag, F.lit("]]")))
        .otherwise(F.concat(F.lit("[[18,"), tag, F.lit("]]")))
    )
    amount = lambda name: F.when(
        k % 5 == 1, F.concat(F.lit('"'), item[name].cast("string"), F.lit('"'))
    ).otherwise(item[name].cast("string"))
    code = F.concat(F.lit('"X'), nation.cast("string"), F.lit('"'))
    currency = (
        F.when(k % 4 == 0, F.concat(F.lit(',"currency_id":{"id":'), nation.cast("string"), F.lit("}")))
        .when(k % 4 == 1, F.concat(F.lit(',"currency_id":['), nation.cast("string"), F.lit(","), code, F.lit("]")))
        .when(k % 4 == 2, F.concat(F.lit(',"currency_id":{"id":'), (nation + 1000).cast("string"), F.lit("}")))
        .otherwise(F.lit(""))
    )
    return F.concat(
        F.lit("{"), display, product, F.lit('"name":'), js(label),
        F.lit(',"quantity":'), item["l_quantity"].cast("string"),
        F.lit(',"price_unit":'), item["l_extendedprice"].cast("string"),
        F.lit(',"tax_ids":'), taxes,
        F.lit(',"price_subtotal":'), amount("subtotal"), F.lit(',"price_total":'), amount("total"),
        currency, F.lit("}"),
    )


def moves(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices with their record as JSON text in ``move_json``."""
    inv = invoices(spark, sf, items=True)
    k, nation = F.col("k"), F.col("nation")
    items = F.transform(F.coalesce("items", F.array()), lambda i, n: _item_json(k, nation, i, n))
    bare = F.transform(F.coalesce("items", F.array()), lambda i, n: n.cast("string"))
    section = F.when(k % 3 == 0, F.array(F.lit('{"display_type":"line_section","name":"Section"}'))).otherwise(
        F.array().cast("array<string>")
    )
    shown = F.when(k % 7 == 0, bare).otherwise(F.concat(section, items))
    listed = F.concat(F.lit("["), F.array_join(shown, ","), F.lit("]"))
    in_lines = F.when(
        k % 5 == 0, F.concat(F.lit('"invoice_line_ids":[],"line_ids":'), listed)
    ).otherwise(F.concat(F.lit('"invoice_line_ids":'), listed))
    partner = F.when(
        k % 2 == 0, F.concat(F.lit('{"id":1,"display_name":'), js(F.col("customer")), F.lit("}"))
    ).otherwise(F.concat(F.lit("[1,"), js(F.col("customer")), F.lit("]")))
    currency = F.when(
        k % 2 == 0, F.concat(F.lit('{"id":'), nation.cast("string"), F.lit("}"))
    ).otherwise(F.concat(F.lit("["), nation.cast("string"), F.lit(',"C'), nation.cast("string"), F.lit('"]')))
    ending = F.when(k % 2 == 0, F.lit("_currency")).otherwise(F.lit(""))
    # A float artefact in the far decimals, which rounding must take away again.
    noise = F.when(k % 6 == 0, F.lit("00000000001")).otherwise(F.lit(""))
    amount = lambda key, name: F.concat(F.lit(f'"{key}'), ending, F.lit('":'), F.col(name).cast("string"), noise)
    totals = F.when(F.col("amount_total").isNull(), F.lit("false")).otherwise(
        F.concat(
            F.lit("{"), amount("base_amount", "amount_untaxed"), F.lit(","), amount("tax_amount", "amount_tax"),
            F.lit(","), amount("total_amount", "amount_total"), F.lit("}"),
        )
    )
    move = F.concat(
        F.lit('{"name":'), F.coalesce(F.when(F.col("invoice_number").isNotNull(), js(F.col("invoice_number"))), F.lit("false")),
        F.lit(',"partner_id":'), partner, F.lit(',"invoice_date":'), js(F.col("invoice_date")),
        F.lit(',"state":'), js(F.col("state")), F.lit(',"currency_id":'), currency,
        F.lit(',"tax_totals":'), totals, F.lit(","), in_lines, F.lit("}"),
    )
    return inv.withColumn("move_json", move)


def stored_moves(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "moves", moves)


def parsed_moves(spark: SparkSession, sf: str) -> DataFrame:
    return stored_moves(spark, sf).select("k", "seq", F.try_parse_json("move_json").alias("move"))


def reads(spark: SparkSession, sf: str, listed: Column | None = None) -> DataFrame:
    """Captured read exchanges, some on another path, of another model, failed or empty.

    ``listed`` is what a list of records holds, by default the one record.
    """
    listed = F.col("move_json") if listed is None else listed
    k = F.col("k")
    method = F.when(k % 29 == 0, "write").when(k % 2 == 0, "web_read").otherwise("read")
    model = F.when(k % 17 == 0, "res.partner").otherwise("account.move")
    request = F.when(k % 13 == 0, F.lit("not json")).otherwise(
        F.concat(F.lit('{"params":{"model":"'), model, F.lit('","method":"'), method, F.lit('"}}'))
    )
    url = F.when(k % 11 == 0, F.lit("https://erp.example/web/action/load")).when(
        k % 2 == 0, F.lit(CALL + "/web_read?page=/app/invoices")
    ).otherwise(F.lit(CALL + "/web_read"))
    response = (
        F.when(k % 31 == 0, F.lit("oops"))
        .when(k % 19 == 0, F.lit('{"error":{"code":200,"message":"denied"}}'))
        .when(k % 23 == 0, F.lit('{"result":[]}'))
        .when(k % 3 == 0, F.concat(F.lit('{"result":['), listed, F.lit("]}")))
        .when(k % 3 == 1, F.concat(F.lit('{"error":false,"result":{"records":['), listed, F.lit("]}}")))
        .otherwise(F.concat(F.lit('{"result":'), F.col("move_json"), F.lit("}")))
    )
    return stored_moves(spark, sf).select(
        "seq", F.lit(None).cast("timestamp").alias("ts"), url.alias("url"), request.alias("request"), response.alias("response")
    )


def searches_of(customers: DataFrame) -> DataFrame:
    """Captured list searches, one per customer; some answers are not readable."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    code = F.concat(F.lit('"C'), nation, F.lit("-"), (key % 7).cast("string"), F.lit('"'))
    first = F.concat(F.lit('{"currency_id":{"id":'), nation, F.lit(',"display_name":'), code, F.lit("}}"))
    second = F.concat(F.lit('{"currency_id":['), nation, F.lit(',"D'), nation, F.lit('"]}'))
    response = (
        F.when(key % 11 == 0, F.lit('{"result":{"records":['))
        .when(key % 4 == 0, F.concat(F.lit('{"result":['), first, F.lit(",5,"), second, F.lit("]}")))
        .otherwise(F.concat(F.lit('{"result":{"records":['), first, F.lit(',{"currency_id":false}]}}')))
    )
    method = F.when(key % 2 == 0, "web_search_read").when(key % 5 == 0, "name_search").otherwise("search_read")
    request = F.concat(F.lit('{"params":{"model":"account.move","method":"'), method, F.lit('"}}'))
    return customers.select(
        key.alias("seq"), F.lit(None).cast("timestamp").alias("ts"), F.lit(CALL + "/search").alias("url"),
        request.alias("request"), response.alias("response"),
    )


def searches(spark: SparkSession, sf: str) -> DataFrame:
    return searches_of(table(spark, sf, "customer"))


def capture(spark: SparkSession, sf: str) -> DataFrame:
    """All captured exchanges, searches and reads, as a stored table."""
    return stored(spark, sf, "capture", lambda s, f: searches(s, f).unionByName(reads(s, f)))


def batch_capture(spark: SparkSession, sf: str) -> DataFrame:
    """The same exchanges, but a list in an answer holds its record twice, with a number and an empty object between."""
    return stored(spark, sf, "batch-capture", _batched)


def _batched(spark: SparkSession, sf: str) -> DataFrame:
    twice = F.concat(F.col("move_json"), F.lit(",5,{},"), F.col("move_json"))
    return searches(spark, sf).unionByName(reads(spark, sf, twice))


def _cell(name: str, text: Column) -> Column:
    return F.concat(F.lit(f'<td name="{name}">'), text, F.lit("</td>"))


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Captured form pages (seq, html) as a stored table."""
    return stored(spark, sf, "pages", made_pages)


def made_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Form pages of the invoices whose payload lists bare line ids."""
    k = F.col("k")

    def number(value: Column) -> Column:
        plain = F.format_number(value, 2)
        return F.when(k % 2 == 0, plain).otherwise(F.concat(F.translate(plain, ",.", ".,"), F.lit(" &euro;")))

    def row(item: Column) -> Column:
        total = F.when(k % 14 == 0, F.lit("")).otherwise(_cell("price_total", number(item["total"])))
        return F.concat(
            F.lit('<tr class="o_data_row">'),
            _cell("product_id", F.concat(F.lit(" "), item["p_name"], F.lit("<br>ref "), item["l_partkey"].cast("string"))),
            _cell("name", F.concat(F.lit("<span>"), item["p_name"], F.lit(", lot "), item["l_suppkey"].cast("string"), F.lit("</span>"))),
            _cell("quantity", number(item["l_quantity"])), _cell("price_unit", number(item["l_extendedprice"])),
            _cell("tax_ids", F.concat(F.lit(" "), tax_tag(item["l_tax"]), F.lit("\nincl. "))),
            _cell("price_subtotal", number(item["subtotal"])), total, F.lit("</tr>"),
        )

    section = F.lit('<tr class="o_data_row o_is_line_section"><td name="name">Section</td></tr>')
    shown = stored_moves(spark, sf).filter((k % 7 == 0) & F.col("items").isNotNull())
    body = F.array_join(F.transform("items", row), "")
    html = F.concat(F.lit("<html><body><table><tr><td name='product_id'>no line</td></tr>"), section, body, F.lit("</table></body></html>"))
    return shown.select("seq", html.alias("html"))


def logs_of(events: DataFrame) -> DataFrame:
    """Log records: one per event, some with an exception text or arguments that do not fit."""
    key = F.col("event_id")
    msg = (
        F.when(key % 10 == 0, F.lit("100%% done for %s"))
        .when(key % 10 == 1, F.lit("plain 100%% record"))
        .when(key % 10 == 2, F.lit("user %s only"))
        .when(key % 10 == 3, F.lit("mail user%s@example.com about %s"))
        .otherwise(F.lit("user %s did %s, rank %d"))
    )
    user = F.concat(F.lit("User "), F.col("user_id").cast("string"), F.lit(" %s"))
    kind, rank = F.col("event_type"), F.get_json_object("props", "$.k")
    args = (
        F.when(key % 10 == 0, F.array(user))
        .when(key % 10 == 1, F.array().cast("array<string>"))
        .when(key % 10 == 2, F.array(user, kind))
        .when(key % 10 == 3, F.array(F.col("user_id").cast("string"), kind))
        .otherwise(F.array(user, kind, rank))
    )
    failure = F.concat(F.lit("ValueError: "), kind, F.lit(" at https://h"), key.cast("string"), F.lit(".example.com/p\nfrom 10.0.0."), (key % 250).cast("string"))
    return events.select(
        key, "ts", F.lit("INFO").alias("level"), F.lit("job").alias("logger"), msg.alias("msg"), args.alias("args"),
        F.when(key % 4 == 0, failure).alias("exc_text"),
        F.when(key % 8 == 0, F.concat(F.lit("call +1 212 867 "), F.lpad((key % 10000).cast("string"), 4, "0"), F.lit(" now"))).alias("stack_info"),
    )


def words(df: DataFrame, key: str, min_len: int) -> DataFrame:
    """(key, token): the words of a text of at least ``min_len`` characters."""
    rows = df.select(key, F.explode_outer(F.split("text", r"\s+")).alias("token"))
    return rows.filter(F.length("token") >= min_len).distinct()
