"""Lookups and summaries: currencies, customers, rates, seeding, run status."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveil.functions import coerce
from tallyveil.functions.surrogate import SALT_ID
from tallyveil.operators.matcher import fold_column, matched_tokens
from tallyveil.plans.scale import is_small, own_key
from tallyveil.schema import LINE

# Currency tables read as one map value, which is searched entry by entry.
MAP_ROWS = 1000


def harvested_codes(searches: DataFrame) -> DataFrame:
    """(seq, pos, currency_id, code) of every record in search answers; bad payloads give nothing."""
    result = coerce.field(F.try_parse_json("response"), "$.result")
    records = F.coalesce(F.try_variant_get(result, "$.records", "array<variant>"), coerce.items_of(result))
    rows = searches.select("seq", F.posexplode_outer(records).alias("pos", "record"))
    currency = coerce.field(F.col("record"), "$.currency_id")
    rows = rows.filter(F.try_variant_get("record", "$", "map<string,variant>").isNotNull()).select(
        "seq", "pos",
        coerce.relational_id(currency).alias("currency_id"),
        coerce.relational_name(currency).alias("code"),
    )
    return rows.filter(F.col("currency_id").isNotNull() & (F.col("code") != ""))


def codes_of(result: Column) -> Column:
    """The currency codes that a search answer holds, as an array of (pos, currency_id, code)."""
    records = F.coalesce(F.try_variant_get(result, "$.records", "array<variant>"), coerce.items_of(result))

    def seen(record: Column, pos: Column) -> Column:
        currency = coerce.field(record, "$.currency_id")
        held = coerce.is_object(record)
        return F.struct(
            pos.alias("pos"), F.when(held, coerce.relational_id(currency)).alias("currency_id"), coerce.relational_name(currency).alias("code")
        )

    return F.filter(F.transform(records, seen), lambda c: c["currency_id"].isNotNull() & (c["code"] != ""))


def latest_codes(harvested: DataFrame) -> DataFrame:
    """(currency_id, code, place): the code seen last per currency, and where it was seen.

    First the last place of each (currency, code) pair, as one decimal, which a hash aggregate
    can hold, so the harvested rows are not sorted; then the latest of the few pairs.
    """
    place = F.col("seq").cast("decimal(19,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col("pos")
    pairs = harvested.groupBy("currency_id", "code").agg(F.max(place).cast("decimal(38,0)").alias("place"))
    return latest_of(pairs)


def latest_of(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("currency_id").agg(F.max_by("code", "place").alias("code"), F.max("place").alias("place"))


def currency_codes(searches: DataFrame) -> DataFrame:
    """Currency id to code; the last one seen, by capture order, wins."""
    return latest_codes(harvested_codes(searches)).drop("place")


def _resolved(lines: Column, header: Column, code_of) -> Column:
    def line(l: Column) -> Column:
        fields = [l[f] if f != "currency" else F.coalesce(coerce.filled(l["currency"]), code_of(l["currency_id"]), header).alias("currency") for f in LINE.fieldNames()]
        return F.struct(*fields)

    return F.transform(lines, line)


def resolve_currency(df: DataFrame, codes: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Currency codes on the header and its lines: an embedded code, else the map by id; lines then
    fall back to the header's code.

    ``codes`` has one row per id. A small one (checked) is read as one map value, so rows do not
    move; a larger one is joined by id. ``key`` names the columns that tell the rows apart; without
    it rows that have to meet the join get numbers of their own.
    """
    columns = df.columns
    invoice = F.col("invoice")
    if is_small(codes, max_rows=MAP_ROWS):
        entries = codes.agg(F.map_from_entries(F.collect_list(F.struct("currency_id", "code"))).alias("m"))
        df = df.withColumn("__codes", entries.scalar())
    else:
        if key is None:
            df, key = own_key(df), ["__key"]
        ids = F.array_compact(F.array_distinct(F.concat(F.array("invoice_currency_id"), F.col("lines.currency_id"))))
        wanted = df.select(*key, F.explode_outer(ids).alias("currency_id")).distinct()
        known = wanted.join(codes, "currency_id")
        maps = known.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("currency_id", "code"))).alias("__codes"))
        df = df.join(maps, key, "left")
    code_of = lambda currency_id: F.try_element_at(F.col("__codes"), currency_id)
    header = F.coalesce(coerce.filled(invoice["currency"]), code_of(F.col("invoice_currency_id")))
    df = df.withColumn("invoice", invoice.withField("currency", header))
    resolved = df.withColumn("lines", _resolved(F.col("lines"), F.col("invoice.currency"), code_of))
    return resolved.select(*[c for c in columns if c != "invoice_currency_id"])


def asked_currencies() -> Column:
    """The currency ids of a header and its lines that have no embedded code."""
    header = F.when(coerce.filled(F.col("invoice.currency")).isNull(), F.col("invoice_currency_id"))
    lines = F.transform("lines", lambda l: F.when(coerce.filled(l["currency"]).isNull(), l["currency_id"]))
    return F.array_compact(F.array_distinct(F.concat(F.array(header), lines)))


def unresolved_currencies(df: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows whose header or lines have a currency id without an embedded code that ``codes`` lacks."""
    rows = df.select("*", F.explode_outer(asked_currencies()).alias("__wanted")).filter(F.col("__wanted").isNotNull())
    known = codes.select(F.col("currency_id").alias("__wanted"))
    return rows.join(known, "__wanted", "left_anti").drop("__wanted")


def find_customer_rows(moves: DataFrame, targets: DataFrame, order_by: str, cell: str = "customer") -> DataFrame:
    """First row per target: its names are tried in order, the first with any row wins.

    ``targets`` has (target, prio, name); a name matches when the cell contains it, in any case. An
    empty name matches nothing.
    The result keeps every target, with status 'customer_not_found' when no name has a row.
    """
    # The first row of each matched name, by partial aggregation; only those meet the targets.
    first_row = F.min_by(F.struct(*moves.columns), order_by)
    named = targets.withColumn("folded", fold_column(F.col("name")))
    found = matched_tokens(moves, cell, targets.select(F.col("name").alias("token")), first_row)
    hits = named.join(found, "folded")
    first = hits.groupBy("target").agg(F.min_by(F.struct("name", F.col("total").alias("row")), "prio").alias("best"))
    wanted = targets.select("target").distinct()
    return wanted.join(first, "target", "left").select(
        "target",
        F.when(F.col("best").isNull(), "customer_not_found").otherwise("ok").alias("status"),
        F.col("best.name").alias("matched_name"),
        F.col("best.row").alias("row"),
    )


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str], order_by: str) -> DataFrame:
    """Existing rows and those incoming ones whose natural key is new; the first by ``order_by`` wins."""
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(order_by, *rest)).alias("__row"))
    first = first.select(*keys, *[F.col("__row")[c].alias(c) for c in rest]).select(*incoming.columns).alias("i")
    known = existing.select(*keys).distinct().alias("e")
    same = F.lit(True)
    for key in keys:
        same = same & F.col(f"i.{key}").eqNullSafe(F.col(f"e.{key}"))
    return existing.unionByName(first.join(known, same, "left_anti"))


def rate_with_fallback(rates: DataFrame, prefs: DataFrame) -> DataFrame:
    """Rate id per kind: the first preferred amount that has a sale rate; null when none has.

    ``rates`` has (rate_id, amount, use), ``prefs`` has (kind, prio, amount).
    """
    sale = rates.filter(F.col("use") == "sale").groupBy("amount").agg(F.min("rate_id").alias("rate_id"))
    tried = prefs.join(sale, "amount", "left")
    hit = F.when(F.col("rate_id").isNotNull(), F.col("prio"))
    return tried.groupBy("kind").agg(F.min_by("rate_id", hit).alias("rate_id"))


def join_on_surrogate(a: DataFrame, b: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Join two de-identified tables on equal surrogates; refuses keys made with different salts.

    ``b`` has one row per surrogate (a dimension); then the result has the rows of ``a``.
    """
    salts = [df.schema[on].metadata.get(SALT_ID) for df in (a, b)]
    if salts[0] is None or salts[0] != salts[1]:
        raise ValueError(f"surrogates of different or unknown salts: {salts}")
    return a.join(b, on, how)


def state_counts(moves: DataFrame, state: str = "state") -> DataFrame:
    return moves.groupBy(state).agg(F.count("*").alias("invoices"))


def run_summary(docs: DataFrame) -> DataFrame:
    """Counts and flags over all documents; nothing that identifies anyone."""
    checks = F.col("checks")
    return docs.groupBy(F.col("metadata.source").alias("source"), F.col("metadata.deidentified").alias("deidentified")).agg(
        F.count("*").alias("documents"),
        F.sum(F.size("lines")).alias("lines_written"),
        F.count_if(checks["line_tax_sum_equals_header"]).alias("tax_match"),
        F.count_if(~checks["line_tax_sum_equals_header"]).alias("tax_mismatch"),
        F.count_if(checks["line_total_sum_equals_amount_total"]).alias("total_match"),
        F.count_if(~checks["line_total_sum_equals_amount_total"]).alias("total_mismatch"),
    )


def run_lines(docs: DataFrame, *keys: str) -> DataFrame:
    """The per-invoice closing line of a run."""
    return docs.select(
        *keys,
        F.size("lines").alias("lines_written"),
        F.col("metadata.source").alias("source"),
        F.col("checks.line_tax_sum_equals_header").alias("tax_match"),
        F.col("checks.line_total_sum_equals_amount_total").alias("total_match"),
        F.substring(F.coalesce("metadata.integrity_sha256", F.lit("")), 1, 12).alias("sha"),
        F.col("metadata.deidentified").alias("deidentified"),
    )


# Exit codes.
STATUS_CODES = {"ok": 0, "unexpected": 1, "extraction_error": 2, "customer_not_found": 3}


def run_status(targets: DataFrame, outcome: DataFrame, key: str) -> DataFrame:
    """Status and code per target from its ``reject_reason``.

    A target without an outcome was not found. An error answer or a missing record is an
    extraction error; any other reason, 'no lines' too, is unexpected.
    """
    reason = F.col("reject_reason")
    status = (
        F.when(F.col("__seen").isNull() | (reason == "customer_not_found"), "customer_not_found")
        .when(reason.isin("JSON-RPC error", "no record"), "extraction_error")
        .when(reason.isNotNull(), "unexpected")
        .otherwise("ok")
    )
    code = F.create_map(*[F.lit(x) for pair in STATUS_CODES.items() for x in pair])
    seen = outcome.select(key, "reject_reason", F.lit(True).alias("__seen"))
    return targets.join(seen, key, "left").select(*targets.columns, status.alias("status")).withColumn(
        "code", F.element_at(code, F.col("status"))
    )
