"""Queries over text and log tables: deny-lists, patterns, scrubbing, audits."""

import re

from pyspark.sql import functions as F

from checks import sql
from checks import views as V
from checks.registry import query
from tallyveil.functions import patterns
from tallyveil.operators import matcher, redact

MASK = patterns.TOKEN_MASK

# ---------------------------------------------------------------- deny-lists


def _customer_values(s, sf):
    """Customer facts as they may be registered: padded, short, repeated in another case."""
    k = F.col("c_custkey")
    padded = F.concat(F.lit("\t "), F.col("c_name"), F.lit(" "))
    return V.table(s, sf, "customer").select(
        padded.alias("name"), F.when(k % 3 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("segment"),
        F.substring("c_mktsegment", 1, 2).alias("short"), F.lit(None).cast("string").alias("none"))


_DENY_SQL = """SELECT c_name AS token FROM customer
  UNION SELECT CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END FROM customer"""


def _deny(s, sf):
    return redact.deny_list(_customer_values(s, sf), ["name", "segment", "short", "none"])


query("deny_list", _deny, _DENY_SQL)
query("secret_count", lambda s, sf: redact.secret_count(_deny(s, sf)), f"SELECT count(*) AS secret_count FROM ({_DENY_SQL})")
query(
    "matcher_order", lambda s, sf: redact.matcher_order(_deny(s, sf)),
    f"SELECT min(token) AS token, CAST(length(min(token)) AS INTEGER) AS size FROM ({_DENY_SQL}) GROUP BY lower(token)",
)


def _bench_tokens(s, sf):
    """The benchmark passages, which some documents quote."""
    return redact.deny_list(V.table(s, sf, "benchmark"), ["text"])


def _word_tokens(s, sf):
    """Many short tokens that overlap: the longer words of the benchmark passages."""
    return redact.deny_list(V.words(V.table(s, sf, "benchmark"), "item_id", 7), ["token"])


def _quoted(token: str) -> str:
    return rf"regexp_replace({token}, '([^\p{{L}}\p{{N}} ])', '\\\1', 'g')"


def _alternation(source: str, group: str = "") -> str:
    """SQL for one case-insensitive pattern, longest token first."""
    return f"SELECT {group + ', ' if group else ''}'(?i)' || string_agg({_quoted('token')}, '|' ORDER BY length(token) DESC, token) AS pattern FROM ({source}){' GROUP BY ' + group if group else ''}"


_BENCH_SQL = "SELECT DISTINCT trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS token FROM benchmark WHERE length(text) >= 3"
_WORDS_SQL = r"SELECT DISTINCT token FROM (SELECT unnest(string_split_regex(text, '\s+')) AS token FROM benchmark) WHERE length(token) >= 7"


def _redacted_sql(table: str, key: str, column: str, source: str) -> str:
    return f"WITH m AS ({_alternation(source)}) SELECT {key}, regexp_replace({column}, pattern, '{MASK}', 'g') AS {column} FROM {table}, m"


def _redact_documents(tokens):
    return lambda s, sf: redact.redact_tokens(V.texts(s, sf, "documents").select("doc_id", "text"), "text", tokens(s, sf))


query("redact_tokens", _redact_documents(_bench_tokens), _redacted_sql("documents", "doc_id", "text", _BENCH_SQL))


def _joined(s, tokens, by=None):
    """The form for token tables too large to gather, used here on small ones."""
    V.ensure_shared_folder(s)
    return matcher.joined_layer(tokens, MASK, by)


def _segments(s, sf):
    return redact.deny_list(_customer_values(s, sf), ["segment"])


def _customer_notes(s, sf):
    """A note per customer that names another one, its segment, and itself in capitals."""
    k = F.col("c_custkey")
    other = F.lpad((k * 7 % 1000).cast("string"), 9, "0")
    note = F.concat(F.lit("x"), F.upper("c_name"), F.lit("y saw customer#"), other, F.lit(" in "), F.col("c_mktsegment"), F.lit("s; Customer#00000"))
    return V.table(s, sf, "customer").select("c_custkey", note.alias("note"))


_NOTE_SQL = """'x' || upper(c_name) || 'y saw customer#' || right('000000000' || (c_custkey * 7 % 1000), 9) || ' in ' || c_mktsegment || 's; Customer#00000'"""
query(
    "redact_few_tokens", lambda s, sf: redact.redact_tokens(_customer_notes(s, sf), "note", _segments(s, sf)),
    f"""WITH t AS (SELECT DISTINCT lower(c_mktsegment) AS token FROM customer), m AS ({_alternation('SELECT * FROM t')})
    SELECT c_custkey, regexp_replace({_NOTE_SQL}, pattern, '{MASK}', 'g') AS note FROM customer, m""",
)
_NAMES_OUT = f"""SELECT c_custkey, 'x{MASK}y saw ' ||
    CASE WHEN EXISTS (SELECT 1 FROM customer o WHERE o.c_custkey = c.c_custkey * 7 % 1000) THEN '{MASK}'
      ELSE 'customer#' || right('000000000' || (c_custkey * 7 % 1000), 9) END || ' in {MASK}s; Customer#00000' AS note FROM customer c"""
query("redact_many_tokens", lambda s, sf: redact.redact_tokens(_customer_notes(s, sf), "note", _deny(s, sf)), _NAMES_OUT)
query(
    "redact_tokens_by_join",
    lambda s, sf: _joined(s, _deny(s, sf))(_customer_notes(s, sf), "note"),
    _NAMES_OUT,
)
_WORDS_OUT = _redacted_sql("documents", "doc_id", "text", _WORDS_SQL)
query("redact_overlapping_words", _redact_documents(_word_tokens), _WORDS_OUT)
query(
    "redact_overlapping_words_by_join",
    lambda s, sf: _joined(s, _word_tokens(s, sf))(V.texts(s, sf, "documents").select("doc_id", "text"), "text"),
    _WORDS_OUT,
)


def _conversation_tokens(s, sf):
    first = V.table(s, sf, "conversations").filter(F.col("turn") == 0)
    return V.words(first, "conv_id", 6)


_SCOPED_SQL = rf"""WITH t AS (SELECT DISTINCT conv_id, token FROM (SELECT conv_id, unnest(string_split_regex(text, '\s+')) AS token
      FROM conversations WHERE turn = 0) WHERE length(token) >= 6), m AS ({_alternation('SELECT * FROM t', 'conv_id')})
    SELECT conv_id, turn, CASE WHEN pattern IS NULL THEN text ELSE regexp_replace(text, pattern, '{MASK}', 'g') END AS text
    FROM conversations LEFT JOIN m USING (conv_id)"""
query(
    "redact_scoped_tokens",
    lambda s, sf: _joined(s, _conversation_tokens(s, sf), "conv_id")(
        V.texts(s, sf, "conversations").select("conv_id", "turn", "text"), "text"),
    _SCOPED_SQL,
)
query(
    "redact_tokens_of_each_scope",
    lambda s, sf: redact.redact_tokens(
        V.texts(s, sf, "conversations").select("conv_id", "turn", "text"), "text", _conversation_tokens(s, sf), by="conv_id"),
    _SCOPED_SQL,
)
query(
    "redact_row_tokens",
    lambda s, sf: V.table(s, sf, "part").select("p_partkey", patterns.redact_row_tokens(
        F.concat(F.upper("p_name"), F.lit(" by "), F.col("p_brand"), F.lit(" \\E.")), F.array("p_name", F.split("p_name", " ")[0], F.lit("\\E."))).alias("text")),
    f"SELECT p_partkey, '{MASK} by ' || p_brand || ' {MASK}' AS text FROM part",
)

# ---------------------------------------------------------------- patterns

_LABELS = tuple(dict.fromkeys(p.label for p in patterns.PATTERNS))


def _pattern_rows(label):
    def run(s, sf):
        texts = V.texts(s, sf, "documents").select(F.lit("documents").alias("tab"), F.col("doc_id").alias("id"), "text").unionByName(
            V.texts(s, sf, "pages").select(F.lit("pages").alias("tab"), F.col("page_id").alias("id"), F.col("html").alias("text"))
        ).unionByName(_made(s, sf))
        return texts.withColumn("text", patterns.redact(F.col("text"), label))
    return run


def _made(s, sf):
    """Texts with the identifiers the tables lack, one per order."""
    k = F.col("k")
    digits = lambda n, width: F.lpad((k % n).cast("string"), width, "0")
    text = F.concat(
        F.lit("ssn "), digits(1000, 3), F.lit("-12-"), digits(10000, 4), F.lit(", call +1 212 867 "), digits(10000, 4),
        F.lit(" now, see https://h"), k.cast("string"), F.lit(".example.com/p) or hTTps://é"), k.cast("string"),
        F.lit(" ref "), F.coalesce("invoice_number", F.lit("DRAFT/1/2")), F.lit(" id é123-45-6789 mail a"), k.cast("string"),
        F.lit("@b.example.co ip 10.0.0."), (k % 300).cast("string"), F.lit(" card 4316 5226 7852 "), digits(10000, 4), F.lit(" ok"))
    return V.invoices(s, sf).select(F.lit("made").alias("tab"), F.col("seq").alias("id"), text.alias("text"))


_MADE_SQL = """'ssn ' || right('000' || k % 1000, 3) || '-12-' || right('0000' || k % 10000, 4) || ', call +1 212 867 ' ||
  right('0000' || k % 10000, 4) || ' now, see https://h' || k || '.example.com/p) or hTTps://é' || k || ' ref ' ||
  coalesce(invoice_number, 'DRAFT/1/2') || ' id é123-45-6789 mail a' || k || '@b.example.co ip 10.0.0.' || (k % 300) ||
  ' card 4316 5226 7852 ' || right('0000' || k % 10000, 4) || ' ok'"""
_TEXTS_SQL = f"""WITH {sql.INVOICES}, texts AS (SELECT 'documents' AS tab, doc_id AS id, text FROM documents
  UNION ALL SELECT 'pages', page_id, html FROM pages UNION ALL SELECT 'made', seq, {_MADE_SQL} FROM inv)"""

for _label in _LABELS:
    query(f"redact_{_label.lower()}", _pattern_rows(_label),
          f"{_TEXTS_SQL} SELECT tab, id, {sql.scrub_sql('text', (_label,))} AS text FROM texts")

# What the made texts become, written out.
query(
    "scrub_made_texts",
    lambda s, sf: redact.scrub(_made(s, sf), ["text"]).select("id", "text"),
    f"""WITH {sql.INVOICES} SELECT seq AS id, 'ssn [REDACTED:SSN], call [REDACTED:PHONE] now, see [REDACTED:URL]) or [REDACTED:URL] ref ' ||
      CASE WHEN invoice_number IS NULL THEN 'DRAFT/1/2' ELSE '[REDACTED:INVOICE_NO]' END ||
      ' id é123-45-6789 mail [REDACTED:EMAIL] ip [REDACTED:IP] card [REDACTED:CARD]ok' AS text FROM inv""",
)
query(
    "redact_allowing",
    lambda s, sf: V.texts(s, sf, "pages").select("page_id", patterns.redact_allowing(patterns.redact_allowing(
        F.concat(F.lit("from "), "url", F.lit(" at 10.0.0.1 and 10.0.0."), F.col("page_id").cast("string"), F.lit(" end")),
        "URL", ["https://m.ththth.example.net", "10.0.0.1"]), "IP", ["10.0.0.12"]).alias("text")),
    """SELECT page_id, 'from ' || CASE WHEN contains(url, 'https://m.ththth.example.net') THEN url ELSE '[REDACTED:URL]' END
      || ' at 10.0.0.1 and ' || CASE WHEN page_id = 1 OR starts_with(CAST(page_id AS VARCHAR), '12') THEN '10.0.0.' || page_id ELSE '[REDACTED:IP]' END || ' end' AS text FROM pages""",
)

# ---------------------------------------------------------------- scrubbing


def _scrub_table(name, key, column):
    query(
        f"scrub_{name}",
        lambda s, sf: redact.scrub(V.texts(s, sf, name).select(*key, column), [column]),
        f"SELECT {', '.join(key)}, {sql.scrub_sql(column)} AS {column} FROM {name}",
    )


_scrub_table("documents", ["doc_id"], "text")
_scrub_table("pages", ["page_id"], "html")
_scrub_table("conversations", ["conv_id", "turn"], "text")
query(
    "scrub_with_deny_list",
    lambda s, sf: redact.scrub(V.texts(s, sf, "documents").select("doc_id", "text"), ["text"], _bench_tokens(s, sf)),
    f"WITH m AS ({_alternation(_BENCH_SQL)}), r AS (SELECT doc_id, regexp_replace(text, pattern, '{MASK}', 'g') AS text FROM documents, m) "
    f"SELECT doc_id, {sql.scrub_sql('text')} AS text FROM r",
)
query(
    "scrub_not_text",
    lambda s, sf: redact.scrub(V.table(s, sf, "orders").select(
        F.col("o_orderkey").alias("k"), "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).alias("price"),
        (F.col("o_orderkey") % 3 == 0).alias("flag")), ["o_orderkey", "price", "flag"]),
    """SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice AS VARCHAR)
      ELSE '' END AS price, CASE WHEN o_orderkey % 3 = 0 THEN 'True' ELSE 'False' END AS flag FROM orders""",
)


def capital_runs():
    """A stand-in for an entity detector: words in capitals of four letters and more."""
    word = re.compile(r"[A-Z]{4,}")

    def find(text):
        return [m.span() for m in word.finditer(text)]

    return find


def failing_detector():
    raise RuntimeError("no model")


query(
    "scrub_with_entities",
    lambda s, sf: redact.scrub(_customer_notes(s, sf), ["note"], ner=capital_runs),
    f"SELECT c_custkey, regexp_replace({_NOTE_SQL}, '[A-Z]{{4,}}', '[REDACTED:NER]', 'g') AS note FROM customer",
)
query(
    "scrub_with_failing_entities",
    lambda s, sf: redact.scrub(_customer_notes(s, sf), ["note"], ner=failing_detector),
    f"SELECT c_custkey, {_NOTE_SQL} AS note FROM customer",
)


def _fragile(text):
    if text.endswith("7"):
        raise ValueError("cannot read")
    return text.lower()


query(
    "scrub_failing_closed",
    lambda s, sf: redact.scrub_with(V.table(s, sf, "customer").select("c_custkey", "c_name"), "c_name", _fragile),
    "SELECT c_custkey, CASE WHEN c_name LIKE '%7' THEN '[REDACTION-ERROR]' ELSE lower(c_name) END AS c_name FROM customer",
)


def _log_deny(s, sf):
    return redact.deny_list(V.table(s, sf, "events").select("event_type").distinct(), ["event_type"])


def _scrubbed_logs(s, sf):
    logs = V.logs_of(V.texts(s, sf, "events"))
    clean = redact.scrub_logs(logs, _log_deny(s, sf), ["10.0.0.1"])
    return clean.select("event_id", "msg", F.size("args").alias("args"), "exc_text", "stack_info")


def logs_sql(source: str = "events") -> str:
    user = "'User ' || user_id || ' %s'"
    return f"""SELECT event_id, CASE event_id % 10 WHEN 0 THEN '100% done for ' || {user} WHEN 1 THEN 'plain 100%% record'
      WHEN 2 THEN '[REDACTION-ERROR: log content suppressed]' WHEN 3 THEN 'mail [REDACTED:EMAIL] about {MASK}'
      ELSE 'user ' || {user} || ' did {MASK}, rank ' || json_extract_string(props, '$.k') END AS msg, 0 AS args,
    CASE WHEN event_id % 4 = 0 AND event_id % 10 <> 2 THEN 'Value' || CASE WHEN EXISTS (SELECT 1 FROM events WHERE event_type = 'error') THEN '{MASK}' ELSE 'Error' END
      || ': {MASK} at [REDACTED:URL]' || chr(10) || 'from ' || CASE WHEN event_id % 250 IN (1) OR starts_with('10.0.0.' || (event_id % 250), '10.0.0.1') THEN '10.0.0.' || (event_id % 250) ELSE '[REDACTED:IP]' END END AS exc_text,
    CASE WHEN event_id % 8 = 0 AND event_id % 10 <> 2 THEN 'call [REDACTED:PHONE] now' END AS stack_info
    FROM {source}"""


query("scrub_logs", _scrubbed_logs, logs_sql())
query(
    "leak_audit",
    lambda s, sf: redact.leak_audit(V.texts(s, sf, "documents"), "text", _word_tokens(s, sf)),
    f"""WITH t AS (SELECT DISTINCT lower(token) AS token FROM ({_WORDS_SQL})), d AS (SELECT lower(text) AS text FROM documents)
    SELECT token, count(*) AS rows FROM t JOIN d ON contains(text, token) GROUP BY token""",
)
query(
    "leak_audit_after_scrub",
    lambda s, sf: redact.leak_audit(redact.redact_tokens(V.texts(s, sf, "documents"), "text", _word_tokens(s, sf)), "text", _word_tokens(s, sf)),
    "SELECT '' AS token, CAST(0 AS BIGINT) AS rows WHERE FALSE",
)
