"""De-identification of documents with salted surrogates, and its audits."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveil.functions.coerce import filled, year_only
from tallyveil.functions.jsontext import lines_fingerprint
from tallyveil.functions.patterns import TOKEN_MASK, redact_each, redact_patterns, stripped
from tallyveil.functions.surrogate import Surrogates
from tallyveil.operators.matcher import gathered_lists
from tallyveil.operators.redact import MIN_TOKEN_LEN, gathered_tokens, scrub
from tallyveil.plans.scale import keep_where, own_key, with_once, written


def deidentify_header(docs: DataFrame, surrogates: Surrogates) -> DataFrame:
    """Customer and number become surrogates, the date its year."""
    invoice = F.col("invoice")
    number = F.when(filled(invoice["invoice_number"]).isNull(), invoice["invoice_number"]).otherwise(
        surrogates.of(invoice["invoice_number"], "INV")
    )
    header = (
        invoice.withField("customer", surrogates.of(invoice["customer"], "CUST"))
        .withField("invoice_number", number)
        .withField("invoice_date", year_only(invoice["invoice_date"]))
    )
    return docs.withColumn("invoice", header)


def _with_descriptions(lines: Column, sweep) -> Column:
    def line(l: Column) -> Column:
        old = l["description"]
        return l.withField("description", F.when(old != "", sweep(old)).otherwise(old))

    return F.transform(lines, line)


def _own_description(text: Column, min_len: int, allow) -> Column:
    """A description swept with the tokens of its own invoice.

    The stripped description is itself one of the tokens. No longer token fits into it, and
    nothing can match in the white space around it, so it is masked as a whole. One too short to
    be a token is too short to hold one, and only the patterns apply.
    """
    masked = F.regexp_replace(text, r"(?Us)^([\s\x1c-\x1f]*).*?([\s\x1c-\x1f]*)$", f"$1{TOKEN_MASK}$2")
    return F.when(F.length(stripped(text)) >= min_len, masked).otherwise(redact_patterns(text, allow))


def deidentify_lines(
    docs: DataFrame, deny: DataFrame | None = None, own_tokens: bool = False, min_len: int = MIN_TOKEN_LEN,
    allow: list[str] | None = None, key: str | None = None,
) -> DataFrame:
    """Descriptions swept for identifiers; products, quantities and money stay.

    ``own_tokens`` sweeps with the tokens of the invoice itself (see ``invoice_tokens``), ``deny``
    with a table of tokens; with both, a description too short to be a token of its invoice is still
    swept for the table's. Of a long table, the tokens that any description holds are found first; where
    they are few enough to go to the tasks, lines are swept where they lie. Otherwise ``deny`` works on
    the flat descriptions; ``key`` names a column that tells the documents apart there; without it they
    get numbers of their own.
    """
    lines, columns, least = F.col("lines"), docs.columns, max(1, min_len)
    too_short = lambda t: F.length(stripped(t)) < least
    if deny is None:
        sweep = (lambda t: _own_description(t, least, allow)) if own_tokens else (lambda t: redact_patterns(t, allow))
        return docs.withColumn("lines", _with_descriptions(lines, sweep))

    def texts_of(docs: DataFrame, *keys: str) -> DataFrame:
        texts = docs.select(*keys, F.explode_outer(F.array_distinct("lines.description")).alias("old")).filter(F.col("old") != "")
        return texts.filter(too_short(F.col("old"))) if own_tokens else texts

    held = gathered_tokens(texts_of(docs), "old", deny)
    if held is not None:
        asked = F.transform(lines, lambda l: F.when(too_short(l["description"]), l["description"]) if own_tokens else l["description"])
        swept = docs.withColumn("__new", redact_each(gathered_lists(held, TOKEN_MASK)(asked), allow))

        def line(l: Column, new: Column) -> Column:
            old = l["description"]
            if own_tokens:
                new = F.when(too_short(old), new).otherwise(_own_description(old, least, allow))
            return l.withField("description", F.when(old != "", new).otherwise(old))

        return with_once(swept, "lines", F.zip_with("lines", "__new", line)).select(*columns)
    if key is None:
        docs, key = own_key(docs), "__key"
    texts = written(texts_of(docs, key), "texts")
    swept = keep_where(scrub(texts.withColumn("new", F.col("old")), ["new"], deny, allow), F.col("new") != F.col("old"))
    maps = swept.groupBy(F.col(key).alias("__of")).agg(F.map_from_entries(F.collect_set(F.struct("old", "new"))).alias("__new"))
    joined = docs.join(maps, F.col(key).eqNullSafe(F.col("__of")), "left")
    new = lambda text: F.coalesce(F.try_element_at(F.col("__new"), text), text)
    if own_tokens:
        swept_text = new
        new = lambda text: F.when(too_short(text), swept_text(text)).otherwise(_own_description(text, least, allow))
    return joined.withColumn("lines", _with_descriptions(lines, new)).select(*columns)


def deidentify(docs: DataFrame, surrogates: Surrogates, **sweep) -> DataFrame:
    """A de-identified copy: surrogates, year, swept descriptions, and a fingerprint of its own."""
    out = deidentify_lines(deidentify_header(docs, surrogates), **sweep)
    metadata = F.col("metadata").withField("deidentified", F.lit(True))
    return out.withColumn("metadata", metadata.withField("integrity_sha256", lines_fingerprint(F.col("lines"))))


def invoice_tokens(docs: DataFrame, key: str, names: list[str] | None = None, min_len: int = MIN_TOKEN_LEN) -> DataFrame:
    """(key, token): the wanted names, then the invoice's own customer, number, products, descriptions."""
    # Read from a one-row table, so no name stands in the plan.
    wanted = docs.sparkSession.createDataFrame([(list(names or []),)], "names ARRAY<STRING>")
    docs = docs.withColumn("__names", wanted.select("names").scalar())
    values = F.concat(
        F.col("__names"), F.array("invoice.customer", "invoice.invoice_number"), F.col("lines.product"), F.col("lines.description")
    )
    tokens = F.filter(F.transform(values, stripped), lambda t: F.length(t) >= max(1, min_len))
    return docs.select(key, F.explode_outer(F.array_distinct(tokens)).alias("token")).filter(F.col("token").isNotNull())


def surrogate_collisions(df: DataFrame, surrogate: str, original: str) -> DataFrame:
    """Surrogates that stand for more than one original; run before the originals are dropped."""
    counts = df.groupBy(surrogate).agg(F.count_distinct(original).alias("originals"))
    return counts.filter(F.col("originals") > 1)
