"""Pieces of the independent SQL: the derived billing data, straight from the given tables."""

# Lines of each invoice in order, and its key.
LINES = """
li AS (
  SELECT l_orderkey AS k, l_orderkey AS seq,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
      l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS INTEGER) AS line_index,
    l_partkey AS part, l_suppkey AS supp, p_name AS product, p_name || ', lot ' || l_suppkey AS description,
    l_quantity AS quantity, l_extendedprice AS unit_price,
    CAST(CAST(round(l_tax * 100) AS INTEGER) AS VARCHAR) || '%' AS tag,
    CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))), 2) AS DECIMAL(18,2)) AS subtotal,
    CAST(l_tax AS DECIMAL(18,2)) AS rate
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey),
ln AS (
  SELECT *, CAST(subtotal + round(subtotal * rate, 2) AS DECIMAL(18,2)) AS total,
    CAST(round(subtotal * rate, 2) AS DECIMAL(18,2)) AS tax_amount FROM li)"""

INVOICES = LINES + """,
sums AS (
  SELECT k, CAST(count(*) AS INTEGER) AS line_count, CAST(sum(subtotal) AS DECIMAL(18,2)) AS sum_subtotal,
    CAST(sum(tax_amount) AS DECIMAL(18,2)) AS sum_tax, CAST(sum(total) AS DECIMAL(18,2)) AS sum_total
  FROM ln GROUP BY k),
inv0 AS (
  SELECT o_orderkey AS k, o_orderkey AS seq,
    c_name AS customer, CAST(c_nationkey AS BIGINT) AS nation, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date,
    CASE o_orderstatus WHEN 'F' THEN 'posted' WHEN 'O' THEN 'draft' ELSE 'cancel' END AS state,
    'INV/' || year(o_orderdate) || '/' || CASE WHEN o_orderkey < 10000 THEN right('00000' || o_orderkey, 5)
      ELSE CAST(o_orderkey AS VARCHAR) END AS number,
    CAST(CASE o_orderkey % 10 WHEN 0 THEN 1.00 WHEN 1 THEN 0.01 ELSE 0 END AS DECIMAL(18,2)) AS error,
    (o_orderkey % 10 = 2 OR s.k IS NULL) AS missing,
    coalesce(line_count, 0) AS line_count, sum_subtotal, sum_tax, sum_total
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN sums s ON s.k = o_orderkey),
inv AS (
  SELECT k, seq, customer, nation, invoice_date, state, line_count, sum_subtotal, sum_tax, sum_total,
    CASE WHEN state <> 'draft' THEN number END AS invoice_number,
    CASE WHEN NOT missing THEN nullif(sum_subtotal, 0) END AS amount_untaxed,
    CASE WHEN NOT missing THEN nullif(CAST(sum_tax + error AS DECIMAL(18,2)), CASE WHEN k % 6 <> 0 THEN 0 END) END AS amount_tax,
    CASE WHEN NOT missing THEN nullif(CAST(sum_total + error AS DECIMAL(18,2)), 0) END AS amount_total
  FROM inv0)"""

CODES = """
found AS (
  SELECT CAST(c_nationkey AS BIGINT) AS currency_id, c_custkey AS seq, 0 AS pos,
    'C' || c_nationkey || '-' || (c_custkey % 7) AS code
  FROM customer WHERE c_custkey % 11 <> 0 AND (c_custkey % 2 = 0 OR c_custkey % 5 <> 0)
  UNION ALL
  SELECT CAST(c_nationkey AS BIGINT), c_custkey, 2, 'D' || c_nationkey
  FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 4 = 0),
codes AS (SELECT currency_id, arg_max(code, seq * 10 + pos) AS code FROM found GROUP BY currency_id)"""

# Which exchanges are invoice reads, and which of them fail.
IS_READ = "k % 11 <> 0 AND k % 13 <> 0 AND k % 17 <> 0 AND k % 29 <> 0"
REASON = """CASE WHEN k % 31 = 0 THEN 'unreadable body' WHEN k % 19 = 0 THEN 'JSON-RPC error'
 WHEN k % 23 = 0 THEN 'no record' END"""

# Lines as extracted from payloads: every seventh order lists bare ids, so it has none there.
PAYLOAD_LINES = INVOICES + ", " + CODES + """,
heads AS (
  SELECT inv.*, coalesce(CASE WHEN k % 2 = 1 THEN 'C' || nation END, c.code) AS currency
  FROM inv LEFT JOIN codes c ON c.currency_id = inv.nation),
pl AS (
  SELECT ln.k, ln.seq, ln.line_index, ln.product,
    CASE WHEN ln.k % 4 = 3 THEN ln.product ELSE ln.description END AS description, ln.quantity, ln.unit_price, ln.tag,
    ln.subtotal, ln.total, ln.tax_amount,
    coalesce(CASE ln.k % 4 WHEN 0 THEN c.code WHEN 1 THEN 'X' || heads.nation END, heads.currency) AS currency,
    'json-rpc' AS source
  FROM ln JOIN heads ON heads.seq = ln.seq LEFT JOIN codes c ON c.currency_id = heads.nation
  WHERE ln.k % 7 <> 0),
dl AS (
  SELECT ln.k, ln.seq, ln.line_index, ln.product, ln.description, ln.quantity, ln.unit_price, ln.tag || ' incl.' AS tag,
    ln.subtotal, CASE WHEN ln.k % 14 = 0 THEN ln.subtotal ELSE ln.total END AS total,
    CASE WHEN ln.k % 14 = 0 THEN CAST(0 AS DECIMAL(18,2)) ELSE ln.tax_amount END AS tax_amount,
    heads.currency, 'dom' AS source
  FROM ln JOIN heads ON heads.seq = ln.seq WHERE ln.k % 7 = 0),
every AS (SELECT * FROM pl UNION ALL SELECT * FROM dl)"""


def number_text(value: str) -> str:
    """Shortest text of a double in the ranges of the tables."""
    return f"CAST(CAST({value} AS DOUBLE) AS VARCHAR)"


LINE_JSON = (
    """'{"currency":' || coalesce('"' || currency || '"', 'null') || ',"description":"' || description || '","line_index":' || line_index
 || ',"product":"' || product || '","quantity":' || """ + number_text("quantity")
    + """ || ',"source":"' || source || '","subtotal":' || """ + number_text("subtotal")
    + """ || ',"tax_amount":' || """ + number_text("tax_amount")
    + """ || ',"taxes":["' || replace(tag, ' ', '","') || '"],"total":' || """ + number_text("total")
    + """ || ',"unit_price":' || """ + number_text("unit_price") + """ || '}'"""
)

# A line as it stands in a written document.
LINE_DOCUMENT = (
    """'{"line_index":' || line_index || ',"product":"' || product || '","description":"' || description || '","quantity":' || """
    + number_text("quantity") + """ || ',"unit_price":' || """ + number_text("unit_price")
    + """ || ',"taxes":["' || replace(tag, ' ', '","') || '"],"subtotal":' || """ + number_text("subtotal")
    + """ || ',"total":' || """ + number_text("total") + """ || ',"currency":"' || currency || '","source":"' || source
 || '","tax_amount":' || """ + number_text("tax_amount") + """ || '}'"""
)

# Documents of the whole way: reads that pass, with lines from the payload or the page.
DOCUMENTS = PAYLOAD_LINES + f""",
canon AS (
  SELECT seq, '[' || string_agg({LINE_JSON}, ',' ORDER BY line_index) || ']' AS canonical,
    CAST(count(*) AS INTEGER) AS n, CAST(sum(tax_amount) AS DECIMAL(18,2)) AS line_tax_sum,
    CAST(sum(total) AS DECIMAL(18,2)) AS line_total_sum
  FROM every GROUP BY seq),
docs AS (
  SELECT heads.*, canonical, sha256(canonical) AS sha, n, line_tax_sum, line_total_sum,
    abs(line_tax_sum - amount_tax) <= 0.01 AS tax_match, abs(line_total_sum - amount_total) <= 0.01 AS total_match,
    CASE WHEN k % 7 = 0 THEN 'dom-fallback' ELSE 'json-rpc:account.move/web_read' END AS source
  FROM heads JOIN canon USING (seq) WHERE {IS_READ} AND ({REASON}) IS NULL)"""


def hmac_sql(value: str, salt: str) -> str:
    """HMAC-SHA256 with a short salt, first 12 hex digits."""
    key = salt.encode().ljust(64, b"\0")
    inner = bytes(b ^ 0x36 for b in key).hex()
    outer = bytes(b ^ 0x5C for b in key).hex()
    first = f"sha256(unhex('{inner}') || encode({value}))"
    return f"substr(sha256(unhex('{outer}') || unhex({first})), 1, 12)"


# Identifier patterns for an engine without look-around and with ASCII word edges: every edge of a
# word is marked by two characters, the first belongs to what ends there, the second to what begins.
_W = r"[\p{L}\p{N}_]+"
_IN, _OUT = "\x01", "\x02"
_E, _B = r"\x01", r"\x02"
_X = r"[\x01\x02]*"
_D = r"\p{Nd}"
_EDGED = [
    ("EMAIL", rf"{_B}(?:{_X}[A-Za-z0-9._%+\-])+{_X}@(?:{_X}[A-Za-z0-9.\-])+{_X}\.{_X}[A-Za-z]{{2,}}{_E}", "[REDACTED:EMAIL]", ""),
    ("INVOICE_NO", rf"{_B}[A-Z]{{1,5}}{_E}{_B}[/\-]{_E}{_B}{_D}{{4}}{_E}{_B}[/\-]{_E}{_B}{_D}{{3,}}{_E}", "[REDACTED:INVOICE_NO]", ""),
    ("SSN", rf"{_B}{_D}{{3}}{_E}{_B}-{_E}{_B}{_D}{{2}}{_E}{_B}-{_E}{_B}{_D}{{4}}{_E}", "[REDACTED:SSN]", ""),
    ("CREDIT_CARD", rf"{_B}(?:{_D}(?:{_E}{_B}[ \-]{_E}{_B})?){{12,18}}{_D}(?:{_E}{_B}[ \-]{_E}|{_E})", "[REDACTED:CARD]", ""),
    ("IP", rf"{_B}(?:{_D}{{1,3}}{_E}{_B}\.{_E}{_B}){{3}}{_D}{{1,3}}{_E}", "[REDACTED:IP]", ""),
    ("URL", rf"(?i){_B}https?{_E}{_B}://[^\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}<>\"'')]+", "[REDACTED:URL]", ""),
    ("PHONE", rf"(^|[^\x02])\+{_E}{_B}{_D}(?:{_X}[\p{{Nd}} .\-]){{6,}}{_X}{_D}{_E}", r"\1[REDACTED:PHONE]", ""),
    ("PHONE", rf"\({_X}{_D}{{2,4}}{_X}\){_X}[ .\-]?{_X}{_D}{{2,4}}{_X}[ .\-]?{_X}{_D}{{2,4}}", "[REDACTED:PHONE]", ""),
]


def scrub_sql(text: str, labels: tuple | None = None) -> str:
    """An expression that applies the patterns in order."""
    for label, pattern, mask, _ in _EDGED:
        if labels and label not in labels:
            continue
        marked = f"regexp_replace({text}, '{_W}', chr(1) || chr(2) || '\\0' || chr(1) || chr(2), 'g')"
        replaced = f"regexp_replace({marked}, '{pattern}', '{mask}', 'g')"
        text = f"replace(replace({replaced}, chr(1), ''), chr(2), '')"
    return text
