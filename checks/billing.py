"""Queries over derived billing data: sources, extraction, money, integrity, lookups."""

from pyspark.sql import functions as F

from checks import sql
from checks import views as V
from checks.registry import query
from tallyveil.functions import coerce, jsontext, money
from tallyveil.operators import extract, integrity, lookup
from tallyveil.plans.extraction import RunInfo, extract_documents
from tallyveil.plans.scale import shared_folder
from tallyveil.schema import MONEY
from tallyveil.sources import capture as exchanges
from tallyveil.sources import documents as files
from tallyveil.sources import html

RUN = RunInfo(extracted_at="2026-05-29T02:14:46Z", instance_url="https://erp.example", modern_path="/app/")


def documents(spark, sf):
    pages = html.lines_from_html(V.pages(spark, sf)).select("seq", "dom_lines")
    return extract_documents(V.capture(spark, sf), RUN, pages)


def parsed(spark, sf):
    return exchanges.moves_from_result(exchanges.result_of(exchanges.move_reads(V.capture(spark, sf))))


# ---------------------------------------------------------------- sources and sinks

query(
    "move_reads",
    lambda s, sf: exchanges.move_reads(V.capture(s, sf)).select(
        "seq", F.get_json_object("request", "$.params.method").alias("method")),
    f"WITH {sql.INVOICES} SELECT seq, CASE WHEN k % 2 = 0 THEN 'web_read' ELSE 'read' END AS method FROM inv WHERE {sql.IS_READ}",
)
query(
    "move_searches",
    lambda s, sf: exchanges.move_searches(V.capture(s, sf)).select(
        "seq", F.get_json_object("request", "$.params.method").alias("method")),
    """SELECT c_custkey AS seq, CASE WHEN c_custkey % 2 = 0 THEN 'web_search_read' ELSE 'search_read' END AS method
    FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 5 <> 0""",
)
query(
    "moves_from_result_first",
    lambda s, sf: parsed(s, sf).select(
        "seq", F.col("move").isNotNull().alias("has_move"),
        F.try_variant_get("move", "$.invoice_date", "string").alias("invoice_date")),
    f"""WITH {sql.INVOICES} SELECT seq, ({sql.REASON}) IS NULL AS has_move,
      CASE WHEN ({sql.REASON}) IS NULL THEN invoice_date END AS invoice_date FROM inv WHERE {sql.IS_READ}""",
)
query(
    "moves_from_result_all",
    lambda s, sf: exchanges.moves_from_result(exchanges.result_of(exchanges.move_searches(V.searches(s, sf))), "all").select(
        "seq", "record_pos", coerce.relational_id(coerce.field(F.col("move"), "$.currency_id")).alias("currency_id")),
    """WITH s AS (SELECT c_custkey AS seq, CAST(c_nationkey AS BIGINT) AS n FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 5 <> 0)
    SELECT seq, 0 AS record_pos, CASE WHEN seq % 11 <> 0 THEN n END AS currency_id FROM s
    UNION ALL SELECT seq, 1, NULL FROM s WHERE seq % 11 <> 0
    UNION ALL SELECT seq, 2, n FROM s WHERE seq % 11 <> 0 AND seq % 4 = 0""",
)


def _split(s, sf):
    ok, rejects = exchanges.split_errors(parsed(s, sf))
    return ok.select("seq", "reject_reason").unionByName(rejects.select("seq", "reject_reason"))


query("split_errors", _split, f"WITH {sql.INVOICES} SELECT seq, {sql.REASON} AS reject_reason FROM inv WHERE {sql.IS_READ}")
query(
    "lines_from_html",
    lambda s, sf: html.lines_of_pages(V.pages(s, sf), "seq").select(
        "seq", "line_index", "product", "description", "quantity", "unit_price", F.array_join("taxes", " ").alias("taxes"),
        "subtotal", "total", "source", "tax_amount"),
    f"WITH {sql.PAYLOAD_LINES} SELECT seq, line_index, product, description, quantity, unit_price, tag AS taxes, "
    "subtotal, total, source, tax_amount FROM dl",
)


def _written(s, sf):
    V.ensure_shared_folder(s)
    path = shared_folder(s, "documents")
    files.write_documents(documents(s, sf).documents, path)
    return files.read_documents(s, path).select(
        F.col("invoice.invoice_number").alias("invoice_number"), F.col("invoice.customer").alias("customer"),
        F.col("checks.line_count").alias("line_count"), F.col("checks.line_total_sum").alias("line_total_sum"),
        F.col("metadata.integrity_sha256").alias("sha"))


query(
    "write_documents", _written,
    f"WITH {sql.DOCUMENTS} SELECT invoice_number, customer, n AS line_count, line_total_sum, sha FROM docs",
)


def _planted_documents(s, sf):
    """Document texts with planted faults."""
    k = F.col("seq")
    text = F.col("document")
    broken = (
        F.when(k % 9 == 0, F.regexp_replace(text, '"invoice":\\{', '"invoice":{"note":1,'))
        .when(k % 9 == 1, F.regexp_replace(text, '"customer":"[^"]*",', ""))
        .when(k % 9 == 2, F.regexp_replace(text, '"line_index":0,', '"line_index":-1,'))
        .when(k % 9 == 3, F.regexp_replace(text, '"line_count":\\d+', '"line_count":"many"'))
        .when(k % 9 == 4, F.regexp_replace(text, "\\}$", ""))
        .when(k % 9 == 5, F.regexp_replace(text, '"deidentified":false', '"deidentified":"no"'))
        .otherwise(text)
    )
    return files.document_json(documents(s, sf).documents, "seq").withColumn("document", broken)


query(
    "validate_documents",
    lambda s, sf: files.validate_documents(_planted_documents(s, sf))[1],
    f"""WITH {sql.DOCUMENTS}
    SELECT seq, CASE k % 9 WHEN 0 THEN 'invoice' WHEN 1 THEN 'invoice' WHEN 2 THEN 'lines[0]' WHEN 3 THEN 'checks' ELSE '$' END AS path,
      CASE k % 9 WHEN 0 THEN 'note' WHEN 1 THEN 'customer' WHEN 2 THEN 'line_index' WHEN 3 THEN 'line_count' ELSE '' END AS key,
      CASE k % 9 WHEN 0 THEN 'unknown key' WHEN 1 THEN 'missing key' WHEN 2 THEN 'negative' WHEN 3 THEN 'wrong type' ELSE 'not JSON' END AS problem
    FROM docs WHERE k % 9 <= 4""",
)
query(
    "valid_documents",
    lambda s, sf: files.validate_documents(_planted_documents(s, sf))[0].select("seq"),
    f"WITH {sql.DOCUMENTS} SELECT seq FROM docs WHERE k % 9 > 4",
)
query(
    "run_metadata",
    lambda s, sf: documents(s, sf).documents.select("seq", "metadata.*"),
    f"""WITH {sql.DOCUMENTS} SELECT seq, 'tallyveil' AS tool, '{RUN.tool_version}' AS tool_version,
      '{RUN.extracted_at}' AS extracted_at, source, 'https://erp.example' AS instance_url,
      CASE WHEN k % 2 = 0 THEN 'modern' ELSE 'legacy' END AS url_scheme, FALSE AS deidentified, sha AS integrity_sha256
    FROM docs""",
)

# ---------------------------------------------------------------- filters

_FACTS = ("seq", "customer", "state")
query("posted_only", lambda s, sf: extract.posted_only(V.invoices(s, sf)).select(*_FACTS),
      f"WITH {sql.INVOICES} SELECT seq, customer, state FROM inv WHERE state = 'posted'")
query("flag_unposted", lambda s, sf: extract.flag_unposted(V.invoices(s, sf)).select(*_FACTS, "state_warning"),
      f"WITH {sql.INVOICES} SELECT seq, customer, state, state <> 'posted' AS state_warning FROM inv")
query(
    "customer_invoices_only",
    lambda s, sf: extract.customer_invoices_only(
        V.invoices(s, sf).withColumn("move_type", F.when(F.col("k") % 4 == 0, "out_refund").otherwise("out_invoice"))
    ).select(*_FACTS),
    f"WITH {sql.INVOICES} SELECT seq, customer, state FROM inv WHERE k % 4 <> 0",
)
query(
    "is_product_line",
    lambda s, sf: V.parsed_moves(s, sf).select(
        "seq", F.size(extract.raw_items(F.col("move"))).alias("items"),
        F.size(F.filter(extract.raw_items(F.col("move")), extract.is_product_line)).alias("products")),
    f"""WITH {sql.INVOICES} SELECT seq,
      CAST(CASE WHEN k % 7 = 0 THEN line_count ELSE line_count + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END END AS INTEGER) AS items,
      CASE WHEN k % 7 = 0 THEN 0 ELSE line_count END AS products FROM inv""",
)


def _first_rows(s, sf, targets):
    found = lookup.find_customer_rows(extract.posted_only(V.invoices(s, sf)).select("seq", "customer"), targets, "seq")
    return found.select("target", "status", "matched_name", F.col("row.seq").alias("seq"))


def _few_targets(s, sf):
    """A target per nation: a name that no row has, then the last digits of a customer."""
    n = F.col("n_nationkey")
    tail = F.concat(F.lit("ER#0000000"), F.lpad(n.cast("string"), 2, "0"))
    names = F.array(F.struct(F.lit(1).alias("prio"), F.concat("n_name", F.lit(" Ltd")).alias("name")), F.struct(F.lit(2).alias("prio"), tail.alias("name")))
    return V.table(s, sf, "nation").select(F.col("n_name").alias("target"), F.explode(names).alias("t")).select("target", "t.*")


query(
    "find_customer_rows", lambda s, sf: _first_rows(s, sf, _few_targets(s, sf)),
    f"""WITH {sql.INVOICES}, targets AS (
      SELECT n_name AS target, 1 AS prio, n_name || ' Ltd' AS name FROM nation
      UNION ALL SELECT n_name, 2, 'ER#0000000' || right('00' || n_nationkey, 2) FROM nation),
    hits AS (SELECT target, prio, name, seq FROM targets JOIN inv ON contains(lower(customer), lower(name)) AND state = 'posted'),
    best AS (SELECT target, arg_min(name, prio * 1e12 + seq) AS matched_name, arg_min(seq, prio * 1e12 + seq) AS seq FROM hits GROUP BY target)
    SELECT t.target, CASE WHEN b.target IS NULL THEN 'customer_not_found' ELSE 'ok' END AS status, matched_name, seq
    FROM (SELECT DISTINCT target FROM targets) t LEFT JOIN best b USING (target)""",
)
query(
    "find_customer_rows_many_targets",
    lambda s, sf: _first_rows(s, sf, V.table(s, sf, "customer").select(
        F.col("c_custkey").alias("target"), F.lit(1).alias("prio"), F.upper("c_name").alias("name"))),
    f"""WITH {sql.INVOICES}, best AS (SELECT customer, min(seq) AS seq FROM inv WHERE state = 'posted' GROUP BY customer)
    SELECT c_custkey AS target, CASE WHEN seq IS NULL THEN 'customer_not_found' ELSE 'ok' END AS status,
      CASE WHEN seq IS NOT NULL THEN upper(c_name) END AS matched_name, seq
    FROM customer LEFT JOIN best ON customer = c_name""",
)

# ---------------------------------------------------------------- coercion

def _relational(s, sf):
    part = F.col("p_partkey")
    name, key = V.js(F.col("p_name")), part.cast("string")
    text = (
        F.when(part % 8 == 0, F.concat(F.lit('{"id":'), key, F.lit(',"display_name":'), name, F.lit("}")))
        .when(part % 8 == 1, F.concat(F.lit("["), key, F.lit(","), name, F.lit("]")))
        .when(part % 8 == 2, F.concat(F.lit('{"id":'), key, F.lit(',"display_name":"","name":'), name, F.lit("}")))
        .when(part % 8 == 3, name).when(part % 8 == 4, key).when(part % 8 == 5, F.lit("false"))
        .when(part % 8 == 6, F.concat(F.lit("["), key, F.lit(","), name, F.lit(",1]"))).otherwise(F.lit("{}"))
    )
    value = F.col("v")
    return V.table(s, sf, "part").select(part.alias("part"), F.try_parse_json(text).alias("v")).select(
        "part", coerce.relational_name(value).alias("name"), coerce.relational_id(value).alias("id"))


query(
    "relational_name_and_id", _relational,
    """SELECT p_partkey AS part, CASE WHEN p_partkey % 8 IN (0, 1, 2, 3) THEN p_name END AS name,
      CASE WHEN p_partkey % 8 IN (0, 1, 2, 4, 6) THEN p_partkey END AS id FROM part""",
)

_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
_OUT_SQL = ", ".join(_KEY)


def _numbers(s, sf):
    k, price = F.col("l_orderkey"), F.col("l_extendedprice")
    text = (
        F.when(k % 8 == 0, price.cast("string")).when(k % 8 == 1, F.concat(F.lit('" '), price.cast("string"), F.lit(' "')))
        .when(k % 8 == 2, F.lit("0")).when(k % 8 == 3, F.lit('"0"')).when(k % 8 == 4, F.lit("true"))
        .when(k % 8 == 5, F.lit("false")).when(k % 8 == 6, F.concat(F.lit('"'), price.cast("string"), F.lit('d"')))
        .otherwise(F.lit('"1_000.5"'))
    )
    return V.texts(s, sf, "lineitem").select(*_KEY, F.try_parse_json(text).alias("v")).select(
        *_KEY, coerce.to_number(F.col("v")).alias("number"))


query(
    "to_number", _numbers,
    f"""SELECT {_OUT_SQL}, CASE l_orderkey % 8 WHEN 0 THEN l_extendedprice WHEN 1 THEN l_extendedprice WHEN 3 THEN 0.0
      WHEN 4 THEN 1.0 WHEN 7 THEN 1000.5 END AS number FROM lineitem""",
)
_EIGHTHS = ("0.00", "0.12", "0.25", "0.38", "0.50", "0.62", "0.75", "0.88")
query(
    "money",
    lambda s, sf: V.texts(s, sf, "lineitem").select(
        *_KEY, F.try_parse_json((F.col("l_partkey") + F.col("l_orderkey") % 8 / 8).cast("string")).alias("v"),
    ).select(*_KEY, coerce.money(F.col("v")).alias("money")),
    # Eighths are exact in binary, so every second one is a true tie, which goes to the even cent.
    f"""SELECT {_OUT_SQL}, nullif(CAST(l_partkey + CAST(CASE l_orderkey % 8 {' '.join(f'WHEN {i} THEN {e}' for i, e in enumerate(_EIGHTHS))} END
      AS DECIMAL(18,2)) AS DECIMAL(18,2)), 0) AS money FROM lineitem""",
)
query(
    "round_money",
    lambda s, sf: V.texts(s, sf, "lineitem").select(
        *_KEY, money.round_money((F.round(F.col("l_extendedprice") * 100).cast("decimal(18,0)") * 10 + F.col("l_orderkey") % 10).cast("double") / 1000)
        .cast(MONEY).alias("money")),
    f"""SELECT {_OUT_SQL}, CAST(round(CAST(l_extendedprice AS DECIMAL(18,3)) + CAST(l_orderkey % 10 AS DECIMAL(18,3)) * 0.001, 2)
      AS DECIMAL(18,2)) AS money FROM (SELECT * REPLACE (CAST(l_extendedprice AS DECIMAL(18,3)) AS l_extendedprice) FROM lineitem)""",
)


def _localized(s, sf):
    k, plain = F.col("l_orderkey"), F.format_number("l_extendedprice", 2)
    text = (
        F.when(k % 6 == 0, plain).when(k % 6 == 1, F.concat(F.translate(plain, ",.", ".,"), F.lit(" €")))
        .when(k % 6 == 2, F.concat(F.lit("USD "), F.col("l_linenumber").cast("string"), F.lit(",5")))
        .when(k % 6 == 3, F.concat(F.col("l_linenumber").cast("string"), F.lit(",250")))
        .when(k % 6 == 4, F.concat(F.col("l_linenumber").cast("string"), F.lit("-"))).otherwise(F.lit(""))
    )
    return V.texts(s, sf, "lineitem").select(*_KEY, coerce.parse_localized_number(text).alias("number"))


query(
    "parse_localized_number", _localized,
    f"""SELECT {_OUT_SQL}, CASE l_orderkey % 6 WHEN 0 THEN l_extendedprice WHEN 1 THEN l_extendedprice
      WHEN 2 THEN l_linenumber + 0.5 WHEN 3 THEN l_linenumber * 1000 + 250.0 END AS number FROM lineitem""",
)
query(
    "year_only",
    lambda s, sf: V.table(s, sf, "orders").select("o_orderkey", coerce.year_only(
        F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd.MM.yyyy"))
        .when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("199"))).alias("year")),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN CAST(year(o_orderdate) AS VARCHAR) END AS year FROM orders",
)
query(
    "approx_equal",
    lambda s, sf: V.texts(s, sf, "lineitem").select(*_KEY, money.approx_equal(
        F.col("l_extendedprice").cast(MONEY),
        F.when(F.col("l_orderkey") % 4 != 3, F.col("l_extendedprice").cast(MONEY) + (F.col("l_orderkey") % 4).cast(MONEY) / 100).cast(MONEY)).alias("same")),
    f"SELECT {_OUT_SQL}, CASE l_orderkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN FALSE END AS same FROM lineitem",
)


def _picked(s, sf):
    k, price = F.col("o_orderkey"), F.col("o_totalprice").cast(MONEY).cast("string")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit('{"tax_amount_currency":null,"tax_amount":'), price, F.lit(',"amount_tax":1}')))
        .when(k % 4 == 1, F.concat(F.lit('{"tax_amount_currency":false,"tax_amount":'), price, F.lit("}")))
        .when(k % 4 == 2, F.concat(F.lit('{"amount_tax":"'), price, F.lit('"}'))).otherwise(F.lit("{}"))
    )
    return V.table(s, sf, "orders").select("o_orderkey", F.try_parse_json(text).alias("v")).select(
        "o_orderkey", coerce.pick(F.col("v"), *extract.TAX_KEYS).alias("tax"))


query(
    "pick", _picked,
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN nullif(CAST(o_totalprice AS DECIMAL(18,2)), 0)
      WHEN 2 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS tax FROM orders""",
)
query(
    "tax_amount",
    lambda s, sf: V.lines(s, sf).select("seq", "line_index", money.tax_amount(F.col("subtotal"), F.col("total")).alias("tax_amount")),
    f"WITH {sql.INVOICES} SELECT seq, line_index, tax_amount FROM ln",
)

# ---------------------------------------------------------------- extraction

_LINE_COLUMNS = ("line_index", "product", "description", "quantity", "unit_price", "subtotal", "total", "source", "tax_amount")


def _extracted_lines(s, sf):
    done = extract.extract_lines(V.parsed_moves(s, sf))
    return extract.explode_lines(done, "seq").select("seq", *_LINE_COLUMNS, F.array_join("taxes", " ").alias("taxes"))


query("extract_lines", _extracted_lines,
      f"WITH {sql.PAYLOAD_LINES} SELECT seq, {', '.join(_LINE_COLUMNS)}, tag AS taxes FROM pl")
query(
    "tax_names",
    lambda s, sf: V.parsed_moves(s, sf).select("seq", F.explode_outer(F.transform(
        F.filter(extract.raw_items(F.col("move")), extract.is_product_line),
        lambda i: extract.tax_names(coerce.field(i, "$.tax_ids")))).alias("t"))
    .filter(F.col("t").isNotNull()).groupBy(F.array_join("t", "|").alias("taxes")).agg(F.count("*").alias("lines")),
    f"WITH {sql.PAYLOAD_LINES} SELECT tag AS taxes, count(*) AS lines FROM pl GROUP BY tag",
)
query(
    "extract_header",
    lambda s, sf: extract.extract_header(V.parsed_moves(s, sf)).select(
        "seq", "invoice_currency_id", *[F.col(f"invoice.{c}").alias(c) for c in
        ("invoice_number", "customer", "invoice_date", "state", "currency", "amount_untaxed", "amount_tax", "amount_total", "source")]),
    f"""WITH {sql.INVOICES} SELECT seq, nation AS invoice_currency_id, invoice_number, customer, invoice_date, state,
      CASE WHEN k % 2 = 1 THEN 'C' || nation END AS currency, amount_untaxed, amount_tax, amount_total,
      'json-rpc:account.move/web_read' AS source FROM inv""",
)


def _chosen(s, sf):
    rpc = extract.extract_lines(V.parsed_moves(s, sf)).select("seq", "lines")
    pages = html.lines_from_html(V.pages(s, sf)).select("seq", "dom_lines")
    return extract.choose_lines(rpc, pages, ["seq"]).select("seq", "used_source", "reject_reason", F.size("lines").alias("lines"))


query(
    "choose_lines", _chosen,
    f"""WITH {sql.INVOICES} SELECT seq, CASE WHEN k % 7 <> 0 AND line_count > 0 THEN 'json-rpc' ELSE 'dom-fallback' END AS used_source,
      CASE WHEN line_count = 0 THEN 'no lines' END AS reject_reason, line_count AS lines FROM inv""",
)
query(
    "assemble_document",
    lambda s, sf: documents(s, sf).documents.select(
        "seq", F.col("metadata.source").alias("source"), F.col("invoice.customer").alias("customer"),
        F.col("invoice.currency").alias("currency"), F.size("lines").alias("lines"),
        F.element_at("lines", -1)["product"].alias("last_product"), "checks.*"),
    f"""WITH {sql.DOCUMENTS} SELECT seq, source, customer, currency, n AS lines,
      (SELECT arg_max(product, line_index) FROM every e WHERE e.seq = docs.seq) AS last_product,
      n AS line_count, line_tax_sum, line_total_sum, tax_match AS line_tax_sum_equals_header,
      total_match AS line_total_sum_equals_amount_total FROM docs""",
)
query(
    "extract_documents",
    lambda s, sf: files.document_json(documents(s, sf).documents, "seq"),
    f"""WITH {sql.DOCUMENTS}, listed AS (SELECT seq, string_agg({sql.LINE_DOCUMENT}, ',' ORDER BY line_index) AS lines FROM every GROUP BY seq)
    SELECT seq, '{{"metadata":{{"tool":"tallyveil","tool_version":"{RUN.tool_version}","extracted_at":"{RUN.extracted_at}","source":"' || source
      || '","instance_url":"https://erp.example","url_scheme":"' || CASE WHEN k % 2 = 0 THEN 'modern' ELSE 'legacy' END
      || '","deidentified":false,"integrity_sha256":"' || sha || '"}},"invoice":{{"invoice_number":' || coalesce('"' || invoice_number || '"', 'null')
      || ',"customer":"' || customer || '","invoice_date":"' || invoice_date || '","state":"' || state || '","currency":"' || currency
      || '","amount_untaxed":' || coalesce({sql.number_text("amount_untaxed")}, 'null') || ',"amount_tax":' || coalesce({sql.number_text("amount_tax")}, 'null')
      || ',"amount_total":' || coalesce({sql.number_text("amount_total")}, 'null') || ',"source":"json-rpc:account.move/web_read"}},"lines":[' || lines
      || '],"checks":{{"line_count":' || n || ',"line_tax_sum":' || {sql.number_text("line_tax_sum")} || ',"line_total_sum":' || {sql.number_text("line_total_sum")}
      || ',"line_tax_sum_equals_header":' || coalesce(CAST(tax_match AS VARCHAR), 'null')
      || ',"line_total_sum_equals_amount_total":' || coalesce(CAST(total_match AS VARCHAR), 'null') || '}}}}' AS document
    FROM docs JOIN listed USING (seq)""",
)
query(
    "rejected_captures", lambda s, sf: documents(s, sf).rejects,
    f"""WITH {sql.INVOICES} SELECT seq, coalesce({sql.REASON}, 'no lines') AS reject_reason FROM inv
    WHERE {sql.IS_READ} AND (({sql.REASON}) IS NOT NULL OR line_count = 0)""",
)
query(
    "canonical_json",
    lambda s, sf: documents(s, sf).documents.select("seq", jsontext.canonical_json(F.col("lines")).alias("canonical")),
    f"WITH {sql.DOCUMENTS} SELECT seq, canonical FROM docs",
)

def _batch_documents(s, sf):
    pages = html.lines_from_html(V.pages(s, sf)).select("seq", "dom_lines")
    return extract_documents(V.batch_capture(s, sf), RUN, pages, mode="all")


# Answers in lists hold the record twice, at 0 and 3; where both lack lines, the page belongs to neither.
_TWICE = "k % 3 <> 2"
query(
    "extract_documents_all",
    lambda s, sf: _batch_documents(s, sf).documents.select(
        "seq", "record_pos", F.col("metadata.source").alias("source"), F.col("invoice.currency").alias("currency"),
        F.size("lines").alias("lines"), F.col("metadata.integrity_sha256").alias("sha"), F.col("checks.line_total_sum_equals_amount_total").alias("total_match")),
    f"""WITH {sql.DOCUMENTS} SELECT seq, unnest(CASE WHEN {_TWICE} THEN [0, 3] ELSE [0] END) AS record_pos, source, currency, n AS lines, sha, total_match
    FROM docs WHERE NOT ({_TWICE} AND k % 7 = 0)""",
)
query(
    "rejected_captures_all", lambda s, sf: _batch_documents(s, sf).rejects,
    f"""WITH {sql.INVOICES}, r AS (SELECT seq, k, line_count, {sql.REASON} AS reason FROM inv WHERE {sql.IS_READ})
    SELECT seq, reason AS reject_reason FROM r WHERE reason IS NOT NULL
    UNION ALL SELECT seq, unnest(['no record', 'no record']) FROM r WHERE reason IS NULL AND {_TWICE}
    UNION ALL SELECT seq, unnest(['no lines', 'no lines']) FROM r WHERE reason IS NULL AND {_TWICE} AND (k % 7 = 0 OR line_count = 0)
    UNION ALL SELECT seq, 'no lines' FROM r WHERE reason IS NULL AND NOT ({_TWICE}) AND line_count = 0""",
)

# ---------------------------------------------------------------- integrity


def _header_tax():
    """The header's tax as extraction gives it: a plain zero counts as missing."""
    return F.when((F.col("amount_tax") != 0) | (F.col("k") % 6 == 0), F.col("amount_tax"))


def _with_lines(s, sf):
    """Invoices with their lines nested, straight from the derived tables."""
    item = lambda i, n: F.struct(
        n.alias("line_index"), i["p_name"].alias("product"),
        F.concat(i["p_name"], F.lit(", lot "), i["l_suppkey"].cast("string")).alias("description"),
        i["l_quantity"].alias("quantity"), i["l_extendedprice"].alias("unit_price"),
        F.array(V.tax_tag(i["l_tax"])).alias("taxes"), i["subtotal"].alias("subtotal"), i["total"].alias("total"),
        F.lit("EUR").alias("currency"), F.lit("json-rpc").alias("source"),
        (i["total"] - i["subtotal"]).cast(MONEY).alias("tax_amount"))
    inv = V.invoices(s, sf, items=True)
    header = F.struct("invoice_number", "customer", "invoice_date", "state", F.lit("EUR").alias("currency"), "amount_untaxed",
                      _header_tax().alias("amount_tax"), "amount_total", F.lit("json-rpc").alias("source"))
    lines = F.transform(F.coalesce("items", F.array()), item)
    return inv.select("seq", header.alias("invoice"), lines.alias("lines"))


_CHECKS_SQL = f"""WITH {sql.INVOICES} SELECT seq, line_count, coalesce(sum_tax, 0.00) AS line_tax_sum, coalesce(sum_total, 0.00) AS line_total_sum,
  abs(coalesce(sum_tax, 0) - amount_tax) <= 0.01 AS line_tax_sum_equals_header,
  abs(coalesce(sum_total, 0) - amount_total) <= 0.01 AS line_total_sum_equals_amount_total FROM inv"""
query("build_checks", lambda s, sf: integrity.build_checks(_with_lines(s, sf)).select("seq", "checks.*"), _CHECKS_SQL)


def _flat_checks(s, sf):
    headers = V.invoices(s, sf).select(
        "seq", _header_tax().alias("amount_tax"), "amount_total")
    lines = V.line_amounts(s, sf).select(F.col("k").alias("seq"), "total", "tax_amount")
    return integrity.build_checks_flat(lines, headers, "seq")


query("reconcile_flat_lines", _flat_checks, _CHECKS_SQL)

_FLAT_JSON = sql.LINE_JSON.replace("source || '\"", "'json-rpc' || '\"").replace("coalesce('\"' || currency || '\"', 'null')", "'\"EUR\"'")
_PRINT_SQL = f"""WITH {sql.INVOICES} SELECT seq, sha256('[' || string_agg({_FLAT_JSON}, ',' ORDER BY line_index) || ']') AS integrity_sha256
  FROM ln GROUP BY seq"""
_EVERY_PRINT_SQL = f"""WITH {sql.INVOICES} SELECT inv.seq, sha256('[' || coalesce(string_agg({_FLAT_JSON}, ',' ORDER BY line_index), '') || ']') AS integrity_sha256
  FROM inv LEFT JOIN ln ON ln.seq = inv.seq GROUP BY inv.seq"""
query("lines_fingerprint", lambda s, sf: _with_lines(s, sf).select("seq", jsontext.lines_fingerprint(F.col("lines")).alias("integrity_sha256")), _EVERY_PRINT_SQL)
query("fingerprint_flat_lines", lambda s, sf: integrity.fingerprint_flat(V.lines(s, sf), "seq"), _PRINT_SQL)
query("fingerprint_flat_every_invoice",
      lambda s, sf: integrity.fingerprint_flat(V.lines(s, sf), "seq", headers=V.table(s, sf, "orders").select(F.col("o_orderkey").alias("seq"))), _EVERY_PRINT_SQL)
# Pieces of two lines, so that the running hash does most of the work.
query("fingerprint_streamed_pieces", lambda s, sf: integrity.fingerprint_flat(V.lines(s, sf), "seq", chunk=2), _PRINT_SQL)


def _tampered(s, sf):
    docs = documents(s, sf).documents
    k = F.col("seq")
    raised = F.transform("lines", lambda l: F.when(l["line_index"] == 0, l.withField("quantity", l["quantity"] + 1)).otherwise(l))
    docs = docs.withColumn("lines", F.when(k % 10 == 5, raised).otherwise(F.col("lines")))
    checks = F.when(k % 10 == 6, F.col("checks").withField("line_count", F.lit(99999))).otherwise(F.col("checks"))
    return integrity.verify_documents(docs.withColumn("checks", checks)).select("seq", "sha_ok", "checks_ok", "tampered")


query(
    "verify_documents", _tampered,
    f"WITH {sql.DOCUMENTS} SELECT seq, k % 10 <> 5 AS sha_ok, k % 10 <> 6 AS checks_ok, k % 10 IN (5, 6) AS tampered FROM docs",
)

# ---------------------------------------------------------------- lookups and summaries

query("currency_codes", lambda s, sf: lookup.currency_codes(exchanges.move_searches(V.capture(s, sf))),
      f"WITH {sql.CODES} SELECT currency_id, code FROM codes")


def _resolved(s, sf):
    moves = extract.extract_lines(extract.extract_header(V.parsed_moves(s, sf))).drop("move")
    codes = lookup.currency_codes(exchanges.move_searches(V.searches(s, sf)))
    done = lookup.resolve_currency(moves, codes)
    lines = F.transform("lines", lambda l: l["currency"])
    return done.select("seq", F.col("invoice.currency").alias("currency"), F.array_join(F.array_distinct(lines), "|").alias("line_currencies"))


query(
    "resolve_currency", _resolved,
    f"""WITH {sql.PAYLOAD_LINES}, per AS (SELECT seq, string_agg(DISTINCT currency, '|') AS c FROM pl GROUP BY seq)
    SELECT seq, currency, coalesce(c, '') AS line_currencies FROM heads LEFT JOIN per USING (seq)""",
)


def _seeded(s, sf):
    parts = V.table(s, sf, "part")
    known = parts.filter(F.col("p_size") > 25).groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"))
    incoming = parts.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"))
    once = lookup.insert_if_absent(known, incoming, ["name"], "id")
    return lookup.insert_if_absent(once, incoming, ["name"], "id")


query(
    "insert_if_absent", _seeded,
    """WITH known AS (SELECT p_name AS name, min(p_partkey) AS id FROM part WHERE p_size > 25 GROUP BY p_name)
    SELECT name, id FROM known UNION ALL
    SELECT p_name, min(p_partkey) FROM part WHERE p_name NOT IN (SELECT name FROM known) GROUP BY p_name""",
)


def _rates(s, sf):
    rates = V.table(s, sf, "part").select(
        F.col("p_partkey").alias("rate_id"), F.col("p_size").cast("double").alias("amount"),
        F.when(F.col("p_partkey") % 2 == 0, "sale").otherwise("purchase").alias("use"))
    # Preferences: per brand the size 19 or else 20, as a standard rate; per type 7 or else 5.
    prefs = V.table(s, sf, "nation").select(
        F.explode(F.array(*[F.struct(F.concat(F.col("n_name"), F.lit(f"-{kind}")).alias("kind"), F.lit(prio).alias("prio"),
                  (F.lit(amount) + F.col("n_nationkey") * 10 * (0 if kind == "standard" else 1)).cast("double").alias("amount"))
                  for kind, prio, amount in (("standard", 1, 19), ("standard", 2, 20), ("reduced", 1, 7), ("reduced", 2, 5))])).alias("p")).select("p.*")
    return lookup.rate_with_fallback(rates, prefs)


query(
    "rate_with_fallback", _rates,
    """WITH sale AS (SELECT CAST(p_size AS DOUBLE) AS amount, min(p_partkey) AS rate_id FROM part WHERE p_partkey % 2 = 0 GROUP BY 1),
    prefs AS (SELECT n_name || '-standard' AS kind, unnest([1, 2]) AS prio, CAST(unnest([19, 20]) AS DOUBLE) AS amount FROM nation
      UNION ALL SELECT n_name || '-reduced', unnest([1, 2]), CAST(unnest([7, 5]) + n_nationkey * 10 AS DOUBLE) FROM nation)
    SELECT kind, arg_min(rate_id, prio) FILTER (WHERE rate_id IS NOT NULL) AS rate_id
    FROM prefs LEFT JOIN sale USING (amount) GROUP BY kind""",
)
query("state_counts", lambda s, sf: lookup.state_counts(V.invoices(s, sf)),
      f"WITH {sql.INVOICES} SELECT state, count(*) AS invoices FROM inv GROUP BY state")
query(
    "run_summary", lambda s, sf: lookup.run_summary(documents(s, sf).documents),
    f"""WITH {sql.DOCUMENTS} SELECT source, FALSE AS deidentified, count(*) AS documents, CAST(sum(n) AS BIGINT) AS lines_written,
      count(*) FILTER (WHERE tax_match) AS tax_match, count(*) FILTER (WHERE NOT tax_match) AS tax_mismatch,
      count(*) FILTER (WHERE total_match) AS total_match, count(*) FILTER (WHERE NOT total_match) AS total_mismatch
    FROM docs GROUP BY source""",
)
query(
    "run_lines", lambda s, sf: lookup.run_lines(documents(s, sf).documents, "seq"),
    f"""WITH {sql.DOCUMENTS} SELECT seq, n AS lines_written, source, tax_match, total_match, substr(sha, 1, 12) AS sha,
      FALSE AS deidentified FROM docs""",
)


def _status(s, sf):
    done = documents(s, sf)
    outcome = done.documents.select("seq", F.lit(None).cast("string").alias("reject_reason")).unionByName(done.rejects)
    return lookup.run_status(V.invoices(s, sf).select("seq"), outcome, "seq")


query(
    "run_status", _status,
    f"""WITH {sql.INVOICES}, st AS (SELECT seq, CASE WHEN NOT ({sql.IS_READ}) THEN 'customer_not_found'
      WHEN ({sql.REASON}) IN ('JSON-RPC error', 'no record') THEN 'extraction_error'
      WHEN ({sql.REASON}) IS NOT NULL OR line_count = 0 THEN 'unexpected' ELSE 'ok' END AS status FROM inv)
    SELECT seq, status, CASE status WHEN 'ok' THEN 0 WHEN 'unexpected' THEN 1 WHEN 'extraction_error' THEN 2 ELSE 3 END AS code FROM st""",
)
