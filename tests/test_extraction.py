import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks import views
from tallyveil.functions import coerce
from tallyveil.functions.jsontext import lines_fingerprint
from tallyveil.functions.surrogate import Surrogates
from tallyveil.operators import deid, extract, integrity, lookup
from tallyveil.plans.extraction import RunInfo, extract_documents
from tallyveil.sources import capture as exchanges
from tallyveil.sources import documents as files
from tallyveil.sources import html

from .samples import CALL, CHAIR, DESK, EUR_ID, MOVE, SEARCH, SECTION, captured, exchange, request, values, variants

RUN = RunInfo(extracted_at="2026-05-29T02:14:46Z", instance_url="https://erp.example", modern_path="/app/")
D = Decimal


def one(spark, move=MOVE):
    return variants(spark, move).withColumnRenamed("v", "move")


def lines(spark, move):
    return extract.extract_lines(one(spark, move)).first()["lines"]


def test_move_reads_and_searches(spark):
    rows = [
        exchange(1, "web_read", "{}"), exchange(2, "read", "{}"), exchange(3, "write", "{}"), exchange(4, "web_search_read", "{}"),
        exchange(5, "search_read", "{}"), exchange(6, "read", "{}", url="https://erp.example/other"),
        (7, None, CALL, request("read", "res.partner"), "{}"), (8, None, CALL, "no json", "{}"), (9, None, CALL, None, "{}"),
        (10, None, CALL, json.dumps({"params": ["account.move", "read"]}), "{}"), (11, None, None, request("read"), "{}"),
    ]
    capture = captured(spark, *rows)
    assert sorted(r.seq for r in exchanges.move_reads(capture).collect()) == [1, 2]
    assert sorted(r.seq for r in exchanges.move_searches(capture).collect()) == [4, 5]


def results(spark, *results_):
    return captured(spark, *[exchange(i, "read", {"result": r}) for i, r in enumerate(results_)])


def test_record_of_a_result(spark):
    two = {"name": "second", "state": "x"}
    df = exchanges.result_of(results(spark, [MOVE], {"records": [MOVE]}, MOVE, [], {"records": []}, None, "text", 5, [MOVE, two], {"records": 1, "name": "N"}, {}))
    first = exchanges.moves_from_result(df).select("seq", F.try_variant_get("move", "$.name", "string"))
    name = MOVE["name"]
    assert values(first) == [name, name, name, None, None, None, None, None, name, "N", None]
    split = exchanges.with_reject_reason(exchanges.moves_from_result(df)).select("seq", "reject_reason")
    assert values(split) == [None, None, None] + ["no record"] * 5 + [None, None, "no record"]
    every = exchanges.moves_from_result(df, "all").filter("seq = 8").select("record_pos", F.try_variant_get("move", "$.name", "string"))
    assert values(every) == [name, "second"]


def test_records_of_odd_results_with_and_without_the_answer(spark):
    """The record is read from the whole answer where that is there, else from the result, with the same outcome."""
    a, b = {"name": "a"}, {"name": "b"}
    df = exchanges.result_of(results(
        spark, [None, a], [[a]], [5], {"records": [5], "name": "n"}, {"records": [None, a]}, {"records": a, "name": "n"}, {"records": None, "name": "n"}, [a, b]))
    name = F.try_variant_get("move", "$.name", "string")
    for rows in (df, df.drop("body")):
        assert values(exchanges.moves_from_result(rows).select("seq", name)) == [None, None, None, None, None, "n", "n", "a"]
        every = exchanges.moves_from_result(rows, "all").select("seq", "record_pos", name.alias("name")).collect()
        assert sorted((r.seq, r.record_pos, r.name) for r in every) == [
            (0, 0, None), (0, 1, "a"), (1, 0, None), (2, 0, None), (3, 0, None), (4, 0, None), (4, 1, "a"), (5, 0, "n"), (6, 0, "n"), (7, 0, "a"), (7, 1, "b")]


def test_which_list_gives_the_lines(spark):
    other = [{"name": "b"}]
    got = lambda first: [l.description for l in lines(spark, {"invoice_line_ids": first, "line_ids": other})]
    assert [got(x) for x in ([], None, False, 0, "", {})] == [["b"]] * 6
    assert [got(x) for x in ([5], [None], [[1]], True, 1, "x", {"a": 1})] == [[]] * 7
    assert got([[1], {"name": "c"}]) == ["c"] and lines(spark, {"line_ids": False}) == []


def test_errors_are_split_off(spark):
    capture = captured(
        spark, exchange(0, "read", {"error": {"code": 1}}), exchange(1, "read", {"error": {}, "result": [MOVE]}), exchange(2, "read", "oops"),
        exchange(3, "read", {"error": False, "result": []}), exchange(4, "read", "[1]"), exchange(5, "read", {"error": "x", "result": [MOVE]}))
    marked = exchanges.moves_from_result(exchanges.result_of(capture))
    ok, rejects = exchanges.split_errors(marked)
    assert [r.seq for r in ok.collect()] == [1]
    assert {r.seq: r.reject_reason for r in rejects.collect()} == {
        0: "JSON-RPC error", 2: "unreadable body", 3: "no record", 4: "unreadable body", 5: "JSON-RPC error"}


def test_lines_skip_sections_and_read_both_encodings(spark):
    chair, desk = lines(spark, dict(MOVE, invoice_line_ids=[CHAIR, SECTION, DESK]))
    assert (chair.line_index, chair.product, chair.tax_amount, chair.taxes) == (0, "Office Chair", D("45.79"), ["19%"])
    assert (desk.line_index, desk.product, desk.currency, desk.currency_id) == (1, "Standing Desk", "EUR", EUR_ID)
    assert chair.currency is None and chair.currency_id == EUR_ID


def test_line_defaults_and_display_types(spark):
    got = lines(spark, {"invoice_line_ids": [
        {}, {"display_type": None, "name": ""}, {"display_type": 0, "product_id": False, "name": "Fee", "tax_ids": False},
        {"display_type": "line_note"}, 7, "x", None, [1], {"display_type": "", "name": "no"}, {"product_id": [1, ""], "quantity": "2", "price_unit": True},
        {"display_type": "product", "tax_ids": [[1, "a"], [2, ""], {"id": 3}, 4, {"name": "b"}], "price_subtotal": "x", "price_total": 0},
    ]})
    # An empty text is neither null nor false nor 'product', so that line is left out.
    assert [l.product for l in got] == ["(unnamed)", "(unnamed)", "Fee", "(unnamed)", "(unnamed)"]
    assert [l.line_index for l in got] == [0, 1, 2, 3, 4]
    assert [l.description for l in got] == [None, None, "Fee", None, None]
    assert (got[3].quantity, got[3].unit_price) == (2.0, 1.0)
    assert got[4].taxes == ["a", "b"] and got[2].taxes == [] and got[4].subtotal == D("0.00")


def test_second_list_is_used_when_the_first_is_empty(spark):
    assert len(lines(spark, {"invoice_line_ids": [], "line_ids": [CHAIR]})) == 1
    assert len(lines(spark, {"invoice_line_ids": False, "line_ids": [CHAIR]})) == 1
    assert len(lines(spark, {"line_ids": [CHAIR]})) == 1
    assert lines(spark, {"invoice_line_ids": [5], "line_ids": [CHAIR]}) == []
    assert lines(spark, {}) == []


def header(spark, move):
    row = extract.extract_header(one(spark, move)).first()
    return row.invoice, row.invoice_currency_id


def test_header_uses_totals_and_rounds(spark):
    got, currency = header(spark, MOVE)
    assert (got.invoice_number, got.customer, got.invoice_date, got.state) == ("INV/2026/00001", "Deco Addict", "2026-05-20", "posted")
    assert (got.amount_untaxed, got.amount_tax, got.amount_total) == (D("690.00"), D("122.82"), D("812.82"))
    assert currency == EUR_ID and got.currency is None


def test_header_gaps(spark):
    got, currency = header(spark, dict(MOVE, name=False, partner_id=False, invoice_date=False, tax_totals=False, currency_id=False, state=None))
    assert got.invoice_number is None and got.customer == "(unknown)" and got.invoice_date is None and got.state is None
    assert (got.amount_untaxed, got.amount_tax, got.amount_total, currency) == (None, None, None, None)
    # A numeric zero counts as missing, so a tax-free invoice has no tax to compare with.
    assert header(spark, dict(MOVE, tax_totals={"tax_amount": 0}))[0].amount_tax is None
    assert header(spark, dict(MOVE, name=""))[0].invoice_number is None
    assert header(spark, dict(MOVE, invoice_date=""))[0].invoice_date == ""


def test_currency_codes(spark):
    bad = [exchange(9, "search_read", '{"result":{"records":['), exchange(8, "search_read", {"result": 5})]
    late = exchange(3, "search_read", {"result": [{"currency_id": [EUR_ID, "EUX"]}, 7, {"currency_id": [1, "USD"]}, {"currency_id": [1, ""]}]})
    codes = lookup.currency_codes(captured(spark, late, exchange(4, "web_search_read", {"result": SEARCH}), *bad))
    assert {r.currency_id: r.code for r in codes.collect()} == {EUR_ID: "EUR", 1: "USD"}


def test_document_equals_the_known_fingerprint(spark):
    capture = captured(spark, exchange(1, "web_search_read", {"result": SEARCH}), exchange(2, "web_read", {"result": [MOVE]}))
    docs = extract_documents(capture, RUN).documents
    doc = docs.first()
    assert doc.metadata.integrity_sha256 == "dc149831b8a07a77b400fc28e7f19c7e583759cc04214c5df299a863b8c0c886"
    assert doc.invoice.currency == "EUR" and {l.currency for l in doc.lines} == {"EUR"}
    assert (doc.checks.line_count, doc.checks.line_tax_sum, doc.checks.line_total_sum) == (3, D("122.82"), D("812.82"))
    assert doc.checks.line_tax_sum_equals_header is True and doc.checks.line_total_sum_equals_amount_total is True
    assert doc.metadata.url_scheme == "legacy" and doc.metadata.source == "json-rpc:account.move/web_read"
    out = deid.deidentify(docs, Surrogates(spark, "change-me-per-deployment"), own_tokens=True)
    hidden = out.first()
    assert hidden.metadata.integrity_sha256 == "1149a47a2ac7001124b29532fbf2348dea88b9e9f86ab8b5d290700af3768c70"
    assert (hidden.invoice.customer, hidden.invoice.invoice_number, hidden.invoice.invoice_date) == (
        "CUST-1993a88b82db", "INV-117e32dfdc3f", "2026")
    assert {l.description for l in hidden.lines} == {"[REDACTED:PHI]"} and hidden.checks == doc.checks
    assert not integrity.verify_documents(out).first().tampered
    carried = out.withColumn("metadata", F.col("metadata").withField("integrity_sha256", F.lit(doc.metadata.integrity_sha256)))
    assert integrity.verify_documents(carried).first().tampered


def test_the_nested_way_moves_no_rows(spark):
    capture = captured(spark, exchange(2, "web_read", {"result": [MOVE]}))
    codes = spark.createDataFrame([(EUR_ID, "EUR")], "currency_id BIGINT, code STRING")
    docs = extract_documents(capture, RUN, codes=codes).documents
    main = docs._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    assert "Exchange" not in main and "Join" not in main


def test_page_lines_replace_missing_payload_lines(spark):
    page = """<table><tr class="o_data_row"><td name="product_id"> Lamp<br/>SKU 1</td><td name="name">Desk &amp; Lamp</td>
      <td name="quantity">1.234,50</td><td name="price_unit">2,5 €</td><td name="tax_ids"><div>19%</div><div>eco</div></td>
      <td name="price_subtotal">10.00</td></tr>
      <tr class="o_data_row"><td name="name">Section</td></tr>
      <tr><td name="product_id">not a line</td></tr>
      <tr class="x o_data_row"><td name="product_id"></td><td name="quantity">0</td><td name="price_total">1.005</td></tr></table>"""
    pages = html.lines_from_html(spark.createDataFrame([(2, page), (3, "<p>none</p>")], "seq BIGINT, html STRING"))
    two = pages.filter("seq = 2").first()
    lamp, other = two.dom_lines
    assert (lamp.product, lamp.description, lamp.quantity, lamp.unit_price) == ("Lamp", "Desk & Lamp", 1234.5, 2.5)
    assert lamp.taxes == ["19%", "eco"] and (lamp.subtotal, lamp.total) == (D("10.00"), D("10.00"))
    assert (other.line_index, other.product, other.quantity, other.subtotal) == (1, "(unnamed)", 0.0, D("0.00"))
    assert two.dom_amounts[1].total == 1.005
    bare = dict(MOVE, invoice_line_ids=[1, 2])
    capture = captured(spark, *[exchange(i, "read", {"result": [m]}) for i, m in ((1, MOVE), (2, bare), (3, bare))])
    codes = spark.createDataFrame([(EUR_ID, "EUR")], "currency_id BIGINT, code STRING")
    done = extract_documents(capture, RUN, pages.select("seq", "dom_lines"), codes)
    got = {r.seq: r for r in done.documents.collect()}
    assert sorted(got) == [1, 2] and got[2].metadata.source == "dom-fallback" and got[2].lines[0].currency == "EUR"
    assert [tuple(r) for r in done.rejects.collect()] == [(3, "no lines")]


def test_resolve_currency_by_join_equals_the_map(spark):
    moves = captured(spark, *[exchange(i, "read", {"result": [dict(MOVE, currency_id={"id": i})]}) for i in range(1, 4)])
    parsed = extract.extract_lines(extract.extract_header(exchanges.moves_from_result(exchanges.result_of(moves)))).drop("move", "body", "result")
    codes = spark.createDataFrame([(1, "AAA"), (EUR_ID, "EUR")], "currency_id BIGINT, code STRING")
    small = lookup.resolve_currency(parsed, codes, ["seq"]).select("seq", "invoice.currency", "lines.currency").orderBy("seq").collect()
    lookup.is_small, kept = (lambda *a, **k: False), lookup.is_small
    try:
        large = lookup.resolve_currency(parsed, codes, ["seq"]).select("seq", "invoice.currency", "lines.currency").orderBy("seq").collect()
    finally:
        lookup.is_small = kept
    assert small == large
    assert [r[1] for r in small] == ["AAA", None, None] and small[1][2] == ["EUR", "EUR", "EUR"]


@pytest.mark.parametrize("names", [1, 1_500])
def test_an_answer_with_several_records(spark, names):
    """Records of one answer stay apart; a page goes to no record where several lack lines."""
    bare = dict(MOVE, invoice_line_ids=[9])
    answers = [[dict(MOVE, currency_id={"id": 900}), dict(MOVE, name="INV/2026/00002")], [bare, dict(bare, name="X")], [MOVE, bare]]
    capture = captured(spark, *[exchange(i, "read", {"result": a}) for i, a in enumerate(answers, 1)])
    page = "<tr class='o_data_row'><td name='product_id'>Lamp</td><td name='price_subtotal'>5.00</td></tr>"
    pages = html.lines_from_html(spark.createDataFrame([(i, page) for i in (1, 2, 3)], "seq BIGINT, html STRING")).select("seq", "dom_lines")
    codes = spark.createDataFrame([(EUR_ID, "EUR")] + [(899 + i, f"C{i}") for i in range(1, names)], "currency_id BIGINT, code STRING")
    done = extract_documents(capture, RUN, pages, codes, mode="all")
    got = {(r.seq, r.record_pos): r for r in done.documents.collect()}
    assert sorted(got) == [(1, 0), (1, 1), (3, 0), (3, 1)]
    assert got[1, 0].invoice.currency == ("C1" if names > 1 else None) and got[1, 1].invoice.currency == "EUR"
    assert got[3, 1].lines[0].product == "Lamp" and got[3, 0].lines[0].product == "Office Chair"
    assert sorted(tuple(r) for r in done.rejects.collect()) == [(2, "no lines"), (2, "no lines")]


def checks_of(spark, amounts, tax, total):
    rows = [(1, [(D(str(s)), D(str(t))) for s, t in amounts], (tax and D(str(tax)), total and D(str(total))))]
    df = spark.createDataFrame(rows, "k INT, l ARRAY<STRUCT<subtotal: DECIMAL(18,2), total: DECIMAL(18,2)>>, invoice STRUCT<amount_tax: DECIMAL(18,2), amount_total: DECIMAL(18,2)>")
    df = df.withColumn("lines", F.transform("l", lambda l: l.withField("tax_amount", (l["total"] - l["subtotal"]).cast("decimal(18,2)"))))
    return integrity.build_checks(df).first().checks


def test_checks(spark):
    good = checks_of(spark, [(241.0, 286.79), (380.0, 452.2), (69.0, 73.83)], 122.82, 812.82)
    assert tuple(good) == (3, D("122.82"), D("812.82"), True, True)
    assert checks_of(spark, [(100, 119)], 999, 999).line_tax_sum_equals_header is False
    empty = checks_of(spark, [(100, 119)], None, None)
    assert empty.line_tax_sum_equals_header is None and empty.line_total_sum_equals_amount_total is None
    assert tuple(checks_of(spark, [], 1, None))[:3] == (0, D("0.00"), D("0.00"))
    assert checks_of(spark, [(100, 119)], 19.01, 119.02)[3:] == (True, False)


def test_fingerprint_is_ordered_and_sensitive(spark):
    sha = lambda items: sha_of(spark, items)
    assert sha([CHAIR]) == sha([CHAIR]) and len(sha([CHAIR])) == 64
    assert sha([CHAIR]) != sha([dict(CHAIR, price_total=290.0)])


def sha_of(spark, items):
    return extract.extract_lines(one(spark, {"invoice_line_ids": items})).select(lines_fingerprint(F.col("lines"))).first()[0]


def test_flat_fingerprint_of_one_huge_invoice(spark):
    """One invoice holds most rows; its pieces spread over tasks and give the nested result."""
    base = extract.explode_lines(extract.extract_lines(one(spark)), "i").drop("i", "currency_id")
    flat = base.filter("line_index = 0").drop("line_index").crossJoin(spark.range(1000).withColumnRenamed("id", "n")).select(
        F.when(F.col("n") < 900, 1).otherwise(F.col("n")).alias("k"), F.when(F.col("n") < 900, F.col("n")).otherwise(0).cast("int").alias("line_index"),
        *[c for c in base.columns if c != "line_index"])
    nested = flat.groupBy("k").agg(F.collect_list(F.struct(*[c for c in flat.columns if c != "k"])).alias("lines"))
    want = {r.k: r.s for r in nested.select("k", lines_fingerprint(F.col("lines")).alias("s")).collect()}
    for chunk in (4096, 64, 1):
        got = {r.k: r.integrity_sha256 for r in integrity.fingerprint_flat(flat, "k", chunk).collect()}
        assert got == want


def test_written_documents_are_valid_and_read_back(spark, tmp_path):
    capture = captured(spark, exchange(2, "web_read", {"result": [MOVE]}))
    docs = extract_documents(capture, RUN, codes=spark.createDataFrame([], "currency_id BIGINT, code STRING")).documents
    path = str(tmp_path / "a" / "b")
    files.write_documents(docs, path)
    files.write_documents(docs, path)
    text = spark.read.text(path).first()[0]
    parsed = json.loads(text)
    assert list(parsed) == ["metadata", "invoice", "lines", "checks"] and parsed["invoice"]["currency"] is None
    assert parsed["lines"][0]["subtotal"] == 241.0 and list(parsed["lines"][0])[-1] == "tax_amount"
    assert files.read_documents(spark, path).first().lines == docs.first().lines
    valid, bad = files.validate_documents(spark.read.text(path), "value")
    assert valid.count() == 1 and bad.count() == 0


def test_a_failing_write_leaves_the_old_documents(spark, tmp_path):
    capture = captured(spark, exchange(2, "web_read", {"result": [MOVE]}))
    docs = extract_documents(capture, RUN).documents
    path = str(tmp_path / "docs")
    files.write_documents(docs, path)
    broken = docs.withColumn("seq", F.raise_error(F.lit("lost"))).filter("seq = 1").drop("seq")
    with pytest.raises(Exception, match="lost"):
        files.write_documents(broken, path)
    assert files.read_documents(spark, path).count() == 1 and [p.name for p in tmp_path.iterdir()] == ["docs"]


def test_violations(spark):
    bad = {"metadata": {"tool_version": "1", "extracted_at": "x", "source": "s", "deidentified": "maybe"}, "extra": 1,
           "invoice": {"customer": None, "zz": 1}, "lines": [{"line_index": -1, "product": "p", "quantity": "x", "unit_price": 1, "subtotal": None, "total": "5", "taxes": ["a", 1]}, 5],
           "checks": []}
    rows = spark.createDataFrame([(1, json.dumps(bad)), (2, "{"), (3, json.dumps({"lines": {}}))], "k INT, document STRING")
    valid, found = files.validate_documents(rows)
    assert valid.count() == 0
    got = {(r.k, r.path, r.key): r.problem for r in found.collect()}
    assert got == {
        (1, "$", "extra"): "unknown key", (1, "metadata", "deidentified"): "wrong type", (1, "invoice", "customer"): "wrong type",
        (1, "invoice", "zz"): "unknown key", (1, "lines[0]", "line_index"): "negative", (1, "lines[0]", "quantity"): "wrong type",
        (1, "lines[0]", "subtotal"): "wrong type", (1, "lines[0]", "taxes"): "wrong type", (1, "lines[1]", ""): "not an object",
        (1, "checks", ""): "not an object", (2, "$", ""): "not JSON", (3, "$", "metadata"): "missing key",
        (3, "$", "invoice"): "missing key", (3, "$", "checks"): "missing key", (3, "lines", ""): "not a list"}


def test_a_schema_that_shows_a_valid_object_hides_no_violation(spark, monkeypatch):
    line = {"line_index": 0, "product": "P", "quantity": 1, "unit_price": 2.5, "subtotal": 2, "total": 3, "taxes": ["a"], "currency": None}
    changes = [{}, {"taxes": []}, {"taxes": [None]}, {"taxes": ["a", None]}, {"taxes": None}, {"line_index": -1}, {"line_index": -0.5}, {"line_index": None},
               {"quantity": "2"}, {"quantity": "x"}, {"total": True}, {"source": 1}, {"note": 1}, {"a b": 1}, {"product": None}, {"taxes": [["a"]]}]
    lines = [{**line, **c} for c in changes] + [{k: v for k, v in line.items() if k != "total"}, [], "x", {}]
    parts = {"metadata": {"tool_version": "1", "extracted_at": "t", "source": "s"}, "invoice": {"customer": "C"},
             "checks": {"line_count": 1, "line_tax_sum": 0, "line_total_sum": 1e300}}
    rows = spark.createDataFrame([(i, json.dumps({**parts, "lines": [one]})) for i, one in enumerate(lines)], "k INT, document STRING")
    got = sorted(map(str, files.validate_documents(rows)[1].collect()))
    tested = rows.select(F.try_parse_json("document").alias("v")).select(files._plainly_valid(F.struct(
        F.lit("lines").alias("part"), F.try_variant_get("v", "$.lines[0]", "variant").alias("value"))).alias("plain"))
    assert [i for i, r in enumerate(tested.collect()) if r.plain] == [0, 1]
    monkeypatch.setattr(files, "_plainly_valid", lambda item: F.lit(False))
    assert got == sorted(map(str, files.validate_documents(rows)[1].collect())) and len({g.split(",")[0] for g in got}) == 16


def test_customer_rows(spark):
    moves = spark.createDataFrame([(5, "Harbor Mill, Lyon"), (3, "HARBOR MILL"), (1, "Orchard Works"), (0, "Mi\u017fs Smith")], "seq INT, customer STRING")
    wanted = [("a", 1, "Nobody"), ("a", 2, "harbor mill"), ("a", 3, "Orchard"), ("b", 1, "zzz"), ("c", 1, "r"), ("d", 1, "miss smith"), ("e", 1, "")]
    targets = spark.createDataFrame(wanted, "target STRING, prio INT, name STRING")
    more = spark.createDataFrame([(f"x{i}", 1, f"no such {i}") for i in range(100)], "target STRING, prio INT, name STRING")
    for some in (targets, targets.unionByName(more)):
        got = {r.target: (r.status, r.matched_name, r.row and r.row.seq) for r in lookup.find_customer_rows(moves, some, "seq").collect()}
        assert got["d"] == ("ok", "miss smith", 0) and got["e"] == ("customer_not_found", None, None)
        assert got["a"] == ("ok", "harbor mill", 3) and got["b"] == ("customer_not_found", None, None) and got["c"] == ("ok", "r", 1)


def test_insert_if_absent_is_idempotent(spark):
    seed = spark.createDataFrame([("Office Chair", 120.5), ("Standing Desk", 380.0), ("Office Chair", 1.0), (None, 2.0)], "name STRING, price DOUBLE")
    have = spark.createDataFrame([("Standing Desk", 99.0)], "name STRING, price DOUBLE")
    once = lookup.insert_if_absent(have, seed, ["name"], "price")
    twice = lookup.insert_if_absent(once, seed, ["name"], "price")
    assert sorted(map(tuple, once.collect()), key=str) == sorted([("Standing Desk", 99.0), ("Office Chair", 1.0), (None, 2.0)], key=str)
    assert sorted(map(tuple, twice.collect()), key=str) == sorted(map(tuple, once.collect()), key=str)


def test_rates_fall_back(spark):
    rates = spark.createDataFrame([(7, 20.0, "sale"), (9, 20.0, "sale"), (1, 19.0, "purchase"), (3, 5.0, "sale"), (2, 7.0, "sale")], "rate_id INT, amount DOUBLE, use STRING")
    prefs = spark.createDataFrame([("standard", 1, 19.0), ("standard", 2, 20.0), ("reduced", 1, 7.0), ("reduced", 2, 5.0), ("none", 1, 3.0)], "kind STRING, prio INT, amount DOUBLE")
    assert {r.kind: r.rate_id for r in lookup.rate_with_fallback(rates, prefs).collect()} == {"standard": 7, "reduced": 2, "none": None}


def test_run_status(spark):
    targets = spark.createDataFrame([(i,) for i in range(6)], "k INT")
    outcome = spark.createDataFrame([(0, None), (1, "JSON-RPC error"), (2, "no record"), (3, "no lines"), (4, "customer_not_found")], "k INT, reject_reason STRING")
    got = [(r.status, r.code) for r in lookup.run_status(targets, outcome, "k").orderBy("k").collect()]
    assert got == [("ok", 0), ("extraction_error", 2), ("extraction_error", 2), ("unexpected", 1), ("customer_not_found", 3), ("customer_not_found", 3)]


def test_state_filters(spark):
    df = spark.createDataFrame([("posted",), ("draft",), ("",), (None,)], "state STRING")
    assert [r.state for r in extract.posted_only(df).collect()] == ["posted"]
    assert [r.state_warning for r in extract.flag_unposted(df).collect()] == [False, True, False, False]
    assert {r.state: r.invoices for r in lookup.state_counts(df).collect()}["posted"] == 1


def test_numbers_are_read_as_before(spark):
    """The text of a JSON number gives what its cast gave, for all kinds of numbers."""
    rng = random.Random(5)
    texts = ["0", "0.00", "-0.0", "7", "-12", "1e5", "2.5E-3", "9007199254740993", "123456789012345678901234567890", "1.005", "99999999999999999.99", "1" * 38, '"4.5"', "true"]
    texts += [f"{rng.choice(['', '-'])}{rng.randrange(10 ** rng.randrange(1, 18))}.{rng.randrange(100):02d}" for _ in range(100)]
    texts += [f"{rng.choice(['', '-'])}{rng.randrange(10 ** rng.randrange(1, 20))}.{rng.randrange(10 ** 6):0{rng.randrange(1, 7)}d}" for _ in range(300)]
    df = spark.createDataFrame([(f'{{"a":{t}}}',) for t in texts], "j STRING").select(F.try_parse_json("j").alias("v"))
    v = F.try_variant_get("v", "$.a", "variant")
    zero_is_null = lambda c: F.when(c != 0, c)
    rows = df.select(
        coerce.kind(v).alias("k"), coerce.to_number(v).alias("number"), coerce.money(v).alias("money"),
        zero_is_null(F.try_variant_get(v, "$", "double")).alias("cast"), zero_is_null(F.try_variant_get(v, "$", "decimal(18,2)")).alias("exact")).collect()
    numbers = [r for r in rows if r.k not in ("STRING", "BOOLEAN")]
    assert len(numbers) > 300 and all(r.number == r.cast for r in numbers)
    short = [r for r in numbers if r.k == "BIGINT" or r.k.endswith((",0)", ",1)", ",2)"))]
    assert len(short) > 20 and all(r.money == r.exact for r in short)


def test_plain_pages_read_as_by_the_parser():
    rng = random.Random(3)
    bits = ["<tr class='o_data_row x'>", '<tr class="o_data_row">', "<tr>", "</tr>", '<td name="product_id">', "<TD NAME='name'>", '<td class="a" name="quantity" name="tax_ids">', "<td/>",
            "</td>", "</TD>", "<br>", "<br/>", "<p>", "</p >", "<li\n>", "text", " 1,5 &euro; &amp;&lt", "\u00a0", "\n", "&", ">", "<span title='a > b'>", "</span>", "<td name=name>", "<!-- <td> -->",
            "<script>", "</script>", "<3", "<", "<td name='a&amp;b'>", "<tr class>", "<title>", "</title>", "</>", "<svg:td name='name'>"]
    plain = 0
    for size in [*range(1, 6)] * 400 + [30] * 300:
        page = "".join(rng.choice(bits[:22] if rng.random() < 0.7 else bits) for _ in range(size))
        table = html._LineTable()
        table.feed(page)
        table.close()
        assert html._rows_of(page) == table.rows, page
        plain += bool(html._PLAIN.fullmatch(page))
    assert plain > 700


def test_page_lines_of_odd_pages(spark):
    rows = [(1, None), (2, ""), (3, "<tr class='o_data_row'><td name='product_id'>a<br>b</td><td name='quantity'>2</td></tr>" * 2)]
    got = {r.seq: r.dom_lines for r in html.lines_from_html(spark.createDataFrame(rows, "seq BIGINT, html STRING").coalesce(1)).collect()}
    assert got[1] == got[2] == [] and [(x.line_index, x.product, x.quantity) for x in got[3]] == [(0, "a", 2.0), (1, "a", 2.0)]


def test_every_plain_page_is_matched_without_groups():
    """A possessive repeat with groups raised a SystemError where the text before a tag was read as a new group's start."""
    assert html._PLAIN.groups == 0
    row = '<tr class="o_data_row"><td name="product_id">{0}<br>ref</td><td name=\'quantity\'>{0}</td></tr>'
    for page in ("a<a></tr>", "=<td><td>", "</td><td/>x", "<p>" + "".join(row.format(i) for i in range(50)) + "</p>"):
        assert html._PLAIN.fullmatch(page) and len(html._rows_of(page)) == page.count("<tr ")
    for page in ("a<", "<td>a<3", "<tr><script></script></tr>", "<td name=a>"):
        assert not html._PLAIN.fullmatch(page)


def test_pieces_move_again_only_beyond_a_span(spark, monkeypatch):
    """Pieces of one task's lines are hashed where they are; those of a larger invoice still give its fingerprint."""
    line = extract.explode_lines(extract.extract_lines(one(spark)), "i").drop("i", "currency_id").filter("line_index = 0").drop("line_index")
    sizes = spark.createDataFrame([(0, 1), (1, 2), (2, 7), (3, 64), (4, 65), (5, 200)], "k INT, size INT")
    flat = sizes.select("k", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("line_index")).crossJoin(line).repartition(3)
    nested = flat.groupBy("k").agg(F.collect_list(F.struct(*[c for c in flat.columns if c != "k"])).alias("lines"))
    want = {r.k: r.s for r in nested.select("k", lines_fingerprint(F.col("lines")).alias("s")).collect()}
    kept, keep_where = [], integrity.keep_where
    monkeypatch.setattr(integrity, "keep_where", lambda *a: kept.append(keep_where(*a)) or kept[-1])
    for span, chunk, again in ((1 << 16, 2, set()), (64, 2, {3, 4, 5}), (64, 5, {3, 4, 5}), (64, 100, {5}), (64, 1, {3, 4, 5})):
        monkeypatch.setattr(integrity, "SPAN", span, raising=False)
        got = integrity.fingerprint_flat(flat, "k", chunk)
        assert {r.k: r.integrity_sha256 for r in got.collect()} == want and got.count() == len(want)
        assert {r.k for r in kept[-1].select("k").collect()} == again, (span, chunk)


def test_no_column_of_other_use_is_numbered(spark, monkeypatch, tmp_path):
    day, line = "timestamp'2031-02-11'", "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE"
    rows = spark.createDataFrame([(7, 1, 2, 2, 1.0, 100.0, 0.1, 0.2), (7, 9, 2, 1, 3.0, 50.0, 0.0, 0.0)], line)
    rows.selectExpr("*", "'N' AS l_returnflag", f"{day} AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "bolt", "b"), (1, "bolt", "c")], "p_partkey BIGINT, p_name STRING, p_brand STRING").write.parquet(f"{tmp_path}/part.parquet")
    seen, numbered_within = [], views.numbered_within
    monkeypatch.setattr(views, "numbered_within", lambda df, *a: seen.append(set(df.columns)) or numbered_within(df, *a))
    got = views.lines(spark, str(tmp_path)).orderBy("line_index").collect()
    assert seen == [{"l_orderkey", "p_name", *views.LINE_ORDER}]
    # A part that is there twice doubles its lines, which are numbered then.
    assert [(r.seq, r.line_index, r.product, r.subtotal, r.total) for r in got] == [
        (7, 0, None, D("50.00"), D("50.00")), (7, 1, "bolt", D("90.00"), D("108.00")), (7, 2, "bolt", D("90.00"), D("108.00"))]
