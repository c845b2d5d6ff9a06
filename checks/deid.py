"""Queries over de-identified documents, and the streaming forms."""

from pyspark.sql import functions as F

from checks import sql
from checks import views as V
from checks.billing import RUN, _with_lines, documents
from checks.registry import ORACLES, query
from checks.text import MASK, _alternation, _log_deny, logs_sql
from tallyveil.functions.surrogate import Surrogates
from tallyveil.operators import deid, integrity, lookup, redact
from tallyveil.plans.scale import shared_folder
from tallyveil.sources import versions
from tallyveil.streaming import jobs, waiting

SALT = "check-salt"


def _cust(value):
    return f"'CUST-' || {sql.hmac_sql(value, SALT)}"


def _number(value):
    return f"CASE WHEN {value} IS NOT NULL THEN 'INV-' || {sql.hmac_sql(value, SALT)} END"


query(
    "surrogate",
    lambda s, sf: V.table(s, sf, "customer").select("c_custkey", Surrogates(s, SALT).of(F.col("c_name"), "CUST").alias("surrogate")),
    f"SELECT c_custkey, {_cust('c_name')} AS surrogate FROM customer",
)
query(
    "deidentify_header",
    lambda s, sf: deid.deidentify_header(V.invoices(s, sf).select("seq", F.struct("invoice_number", "customer", "invoice_date").alias("invoice")),
                                         Surrogates(s, SALT)).select("seq", "invoice.*"),
    f"""WITH {sql.INVOICES} SELECT seq, {_number('invoice_number')} AS invoice_number, {_cust('customer')} AS customer,
      substr(invoice_date, 1, 4) AS invoice_date FROM inv""",
)


def _line_texts(docs):
    return docs.select("seq", F.explode("lines").alias("l")).select(
        "seq", F.col("l.line_index").alias("line_index"), F.col("l.product").alias("product"), F.col("l.description").alias("description"))


def _noted(s, sf):
    """Documents whose descriptions hold an address and a product name."""
    docs = _with_lines(s, sf)
    return docs.withColumn("lines", F.transform("lines", lambda l: l.withField("description", F.concat(
        F.upper(l["product"]), F.lit(" for p"), l["line_index"].cast("string"), F.lit("@x.example.com")))))


def _products(s, sf):
    return redact.deny_list(V.table(s, sf, "part"), ["p_name"])


query("deidentify_lines_patterns", lambda s, sf: _line_texts(deid.deidentify_lines(_noted(s, sf))),
      f"WITH {sql.INVOICES} SELECT seq, line_index, product, upper(product) || ' for [REDACTED:EMAIL]' AS description FROM ln")
_PRODUCTS_OUT = f"WITH {sql.INVOICES} SELECT seq, line_index, product, '{MASK} for [REDACTED:EMAIL]' AS description FROM ln"
query("deidentify_lines_deny_list", lambda s, sf: _line_texts(deid.deidentify_lines(_noted(s, sf), _products(s, sf), key="seq")), _PRODUCTS_OUT)


def _long_deny(s, sf):
    return _products(s, sf).unionByName(redact.deny_list(V.table(s, sf, "customer"), ["c_name"]))


query("deidentify_lines_long_deny_list",
      lambda s, sf: _line_texts(deid.deidentify_lines(_noted(s, sf), _long_deny(s, sf), key="seq")), _PRODUCTS_OUT)


def _deidentified(s, sf):
    return deid.deidentify(documents(s, sf).documents, Surrogates(s, SALT), own_tokens=True)


_MASKED_JSON = sql.LINE_JSON.replace("|| description ||", f"|| '{MASK}' ||")
_DEID_SQL = f"""{sql.DOCUMENTS}, deid AS (
  SELECT seq, sha256('[' || string_agg({_MASKED_JSON}, ',' ORDER BY line_index) || ']') AS sha2 FROM every GROUP BY seq)"""
query(
    "deidentify",
    lambda s, sf: _deidentified(s, sf).select(
        "seq", "invoice.customer", "invoice.invoice_number", "invoice.invoice_date", "metadata.deidentified",
        "metadata.integrity_sha256", F.array_join(F.array_distinct("lines.description"), "|").alias("descriptions"),
        "checks.line_total_sum"),
    f"""WITH {_DEID_SQL} SELECT seq, {_cust('customer')} AS customer, {_number('invoice_number')} AS invoice_number,
      substr(invoice_date, 1, 4) AS invoice_date, TRUE AS deidentified, sha2 AS integrity_sha256, '{MASK}' AS descriptions,
      line_total_sum FROM docs JOIN deid USING (seq)""",
)
query(
    "deidentified_verifies",
    lambda s, sf: integrity.verify_documents(_deidentified(s, sf)).groupBy("tampered").agg(F.count("*").alias("documents")),
    f"WITH {sql.DOCUMENTS} SELECT FALSE AS tampered, count(*) AS documents FROM docs",
)
query(
    "invoice_tokens",
    lambda s, sf: deid.invoice_tokens(_with_lines(s, sf), "seq", ["Harbor Mill", "X"]),
    f"""WITH {sql.INVOICES}, i AS (SELECT * FROM inv)
    SELECT seq, 'Harbor Mill' AS token FROM i UNION SELECT seq, customer FROM i UNION SELECT seq, invoice_number FROM i WHERE invoice_number IS NOT NULL
    UNION SELECT seq, product FROM ln UNION SELECT seq, description FROM ln""",
)
query(
    "surrogate_collisions",
    # Two hex digits are kept of each surrogate, so that collisions occur at this size.
    lambda s, sf: deid.surrogate_collisions(V.table(s, sf, "customer").select(
        "c_name", F.substring(Surrogates(s, SALT).of(F.col("c_name"), "C"), 1, 4).alias("surrogate")), "surrogate", "c_name"),
    f"""SELECT surrogate, count(DISTINCT c_name) AS originals FROM (SELECT c_name, 'C-' || substr({sql.hmac_sql('c_name', SALT)}, 1, 2) AS surrogate
      FROM customer) GROUP BY surrogate HAVING count(DISTINCT c_name) > 1""",
)


def _joined(s, sf):
    keys = Surrogates(s, SALT, "2026")
    bills = V.invoices(s, sf).select("seq", keys.column(F.col("customer"), "CUST", "who"))
    segments = V.table(s, sf, "customer").select(keys.column(F.col("c_name"), "CUST", "who"), "c_mktsegment")
    return lookup.join_on_surrogate(bills, segments, "who")


query("join_on_surrogate", _joined,
      f"WITH {sql.INVOICES} SELECT seq, {_cust('customer')} AS who, c_mktsegment FROM inv JOIN customer ON c_name = customer")

# ---------------------------------------------------------------- streams


def _finished(stream):
    stream.awaitTermination()
    if stream.exception():
        raise stream.exception()


def _folders(s, *names):
    V.ensure_shared_folder(s)
    return [shared_folder(s, n) for n in names]


#: Rows arrive in so many parts; the stream is started again after each, so each is a micro-batch of its own at least.
ARRIVALS = 3


def _arriving(s, df, part_of, start, parts=ARRIVALS):
    """Rows of a table arrive by the number of their part; ``start`` begins a stream over what has arrived so far."""
    source = _folders(s, "arrived")[0]
    for part in range(parts):
        df.filter(part_of == part).write.mode("append").parquet(source)
        _finished(start(s.readStream.schema(df.schema).parquet(source)))


def _log_stream(s, sf):
    out, checkpoint = _folders(s, "logs", "logs-progress")
    start = lambda events: jobs.scrub_stream(V.logs_of(events), out, checkpoint, _log_deny(s, sf), ["10.0.0.1"])
    _arriving(s, V.table(s, sf, "events"), F.col("event_id") % ARRIVALS, start)
    return versions.committed(s, out).select("event_id", "msg", F.size("args").alias("args"), "exc_text", "stack_info")


query("scrub_stream", _log_stream, logs_sql())


def _code_stream(s, sf):
    out, checkpoint = _folders(s, "codes", "codes-progress")
    start = lambda customers: jobs.start_currency_stream(V.searches_of(customers), out, checkpoint)
    _arriving(s, V.table(s, sf, "customer"), F.col("c_custkey") % ARRIVALS, start)
    return jobs.current_codes(s, out)


query("currency_stream", _code_stream, f"WITH {sql.CODES} SELECT currency_id, code FROM codes")


def _growing(s, sf):
    deny, out, checkpoint = _folders(s, "deny", "turns", "turns-progress")
    # The longest words of the openings are registered as they arrive, and hide from then on.
    tokens = lambda batch: V.words(batch.filter((F.col("turn") == 0) & (F.col("role") == "user")), "conv_id", 14)
    start = lambda turns: jobs.scrub_with_growing_list(turns, tokens, deny, out, checkpoint, ["text"])
    _arriving(s, V.table(s, sf, "conversations").select("conv_id", "turn", "role", "text"), F.col("conv_id") % ARRIVALS, start)
    return versions.committed(s, out).select("conv_id", "turn", "text")


def _grown_sql(part):
    """The turns of one arrival, without the words that this one and those before it registered."""
    listed = rf"""SELECT DISTINCT token FROM (SELECT unnest(string_split_regex(text, '\s+')) AS token FROM conversations
      WHERE turn = 0 AND role = 'user' AND conv_id % {ARRIVALS} <= {part}) WHERE length(token) >= 14"""
    return f"""SELECT conv_id, turn, {sql.scrub_sql('text')} AS text FROM (
      SELECT conv_id, turn, coalesce(regexp_replace(text, pattern, '{MASK}', 'g'), text) AS text
      FROM conversations, ({_alternation(listed)}) WHERE conv_id % {ARRIVALS} = {part})"""


query(
    "scrub_with_growing_list", _growing,
    " UNION ALL ".join(_grown_sql(part) for part in range(ARRIVALS)),
)


def _document_stream(s, sf):
    out, codes, checkpoint = _folders(s, "extracted", "codes", "extract-progress")
    pages = V.pages(s, sf)
    start = lambda capture: jobs.extract_stream(capture, out, codes, checkpoint, RUN, pages)
    # Half of the invoices arrive before the codes that they need, and wait.
    part = F.when(F.col("url").endswith("/search"), 1).otherwise(F.col("seq") % 2 * 2)
    _arriving(s, V.capture(s, sf), part, start)
    return jobs.extracted_documents(s, out).select(
        "seq", F.col("invoice.currency").alias("currency"), F.size("lines").alias("lines"), "metadata.integrity_sha256")


query(
    "extract_stream", _document_stream,
    f"WITH {sql.DOCUMENTS} SELECT seq, currency, n AS lines, sha AS integrity_sha256 FROM docs",
)


def _keyed_stream(s, sf):
    out, checkpoint = _folders(s, "keyed", "keyed-progress")
    pages = V.pages(s, sf)
    start = lambda capture: waiting.extract_keyed_stream(capture, out, checkpoint, RUN, pages, patience=1, salts=4)
    # As above; the exchanges of other paths come last, when only what no search names is left to time out.
    searched, other = F.col("url").endswith("/search"), ~F.col("url").contains("/call_kw/")
    part = F.when(other, 3).when(searched, 1).otherwise(F.col("seq") % 2 * 2)
    _arriving(s, V.capture(s, sf), part, start, ARRIVALS + 1)
    return waiting.keyed_documents(s, out).select(
        "seq", F.col("invoice.currency").alias("currency"), F.size("lines").alias("lines"), "metadata.integrity_sha256")


query("extract_keyed_stream", _keyed_stream, ORACLES["extract_stream"])
