"""Writing documents as JSON, and checking JSON against the strict document schema."""

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveil import schema
from tallyveil.functions import coerce
from tallyveil.functions.money import let
from tallyveil.plans.scale import inline_rows, keep_where
from tallyveil.sources import versions

DOCUMENT = ("metadata", "invoice", "lines", "checks")
REQUIRED = {
    "metadata": ("tool_version", "extracted_at", "source"),
    "invoice": ("customer",),
    "lines": ("line_index", "product", "quantity", "unit_price", "subtotal", "total"),
    "checks": ("line_count", "line_tax_sum", "line_total_sum"),
}
FIELDS = {
    "metadata": schema.METADATA_FIELDS,
    "invoice": schema.HEADER_FIELDS,
    "lines": schema.LINE_FIELDS,
    "checks": schema.CHECK_FIELDS,
}
# Fields that may be null; all others must hold a value when their key is there.
NULLABLE = {
    "metadata": ("instance_url", "url_scheme", "integrity_sha256"),
    "invoice": ("invoice_number", "invoice_date", "state", "currency", "amount_untaxed", "amount_tax", "amount_total"),
    "lines": ("description", "currency"),
    "checks": ("line_tax_sum_equals_header", "line_total_sum_equals_amount_total"),
}


def _doubles(struct: Column, fields: dict) -> Column:
    return F.struct(
        *[(struct[n].cast("double") if t == schema.MONEY else struct[n]).alias(n) for n, t in fields.items()]
    )


def _document() -> list[Column]:
    """The document as it is written: money as double, all keys in their order."""
    return [
        F.col("metadata"),
        _doubles(F.col("invoice"), schema.HEADER_FIELDS).alias("invoice"),
        F.transform("lines", lambda l: _doubles(l, schema.LINE_FIELDS)).alias("lines"),
        _doubles(F.col("checks"), schema.CHECK_FIELDS).alias("checks"),
    ]


def document_json(docs: DataFrame, *keys: str) -> DataFrame:
    """One JSON text per document, with explicit nulls."""
    body = F.to_json(F.struct(*_document()), {"ignoreNullFields": "false"}).alias("document")
    return docs.select(*keys, body)


def write_documents(docs: DataFrame, path: str) -> None:
    """JSON Lines, one document per line, nulls kept, an existing folder replaced.

    The new documents are written beside the old ones and take their place when all are there; a write that fails
    leaves the old ones as they are.
    """
    spark, staged = docs.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    try:
        docs.select(*_document()).write.option("ignoreNullFields", "false").json(staged)
    except Exception:
        versions.remove(spark, staged)
        raise
    versions.put_in_place(spark, staged, path)


def read_documents(spark, path: str) -> DataFrame:
    fields = ", ".join(
        f"{part} {('array<' + s.simpleString() + '>') if part == 'lines' else s.simpleString()}"
        for part, s in zip(DOCUMENT, (schema.METADATA, schema.HEADER, schema.LINE, schema.CHECKS))
    )
    return spark.read.schema(fields).json(path)


VIOLATION = "array<struct<path:string,key:string,problem:string>>"

# The texts that read as a boolean.
_SPOKEN = ("true", "false", "1", "0", "yes", "no", "on", "off", "t", "f", "y", "n")


# Types, as a VARIANT's schema names them, of which every value fits.
_FITTING = {"string": "STRING", "boolean": "BOOLEAN", "int": "BIGINT", "strings": "ARRAY<(?:STRING|VOID)>"}
_FITTING_NUMBER = r"(?:BIGINT|DOUBLE|DECIMAL\(\d+,\d+\))"


def _plain_shape(part: str) -> str:
    """A pattern for the schema of an object with all keys that must be there, no unknown one, and fitting types."""
    pattern = "^OBJECT<"
    for name, kind in sorted(FIELDS[part].items()):
        kind = "strings" if kind.simpleString().startswith("array") else kind.simpleString()
        fitting = _FITTING.get(kind, _FITTING_NUMBER)
        fitting = f"(?:{fitting}|VOID)" if name in NULLABLE[part] else fitting
        pattern += f"(?:{name}: {fitting}(?:, |>$)){'' if name in REQUIRED[part] else '?'}"
    return pattern + "$"


def _plainly_valid(item: Column) -> Column:
    """Whether the schema alone shows that an object has no violation; others are looked at value by value."""
    value, part = item["value"], item["part"]
    # The schema says neither whether an index is negative nor whether a list of texts has a null.
    index = F.try_variant_get(value, "$.line_index", "double") >= 0
    whole = ~F.exists(F.coalesce(F.try_variant_get(value, "$.taxes", "array<string>"), F.array().cast("array<string>")), lambda t: t.isNull())
    plain = {p: coerce.kind(value).rlike(_plain_shape(p)) for p in FIELDS}
    plain["lines"] = plain["lines"] & index & whole
    found = F.when(part == "lines", plain.pop("lines"))
    for name, test in plain.items():
        found = found.when(part == name, test)
    return F.coalesce(found, F.lit(False))


def _violation(where: Column, key: Column, problem: Column) -> Column:
    return F.struct(where.alias("path"), key.alias("key"), problem.alias("problem"))


def _rules() -> Column:
    """For each part, what each of its keys must hold: a type name, with a '?' where null will do."""
    rules = {"document": {name: "any" for name in DOCUMENT}}
    for part, fields in FIELDS.items():
        for name, kind in fields.items():
            wanted = {"int": "int", "boolean": "boolean", "string": "string"}.get(kind.simpleString(), "number")
            wanted = "strings" if kind.simpleString().startswith("array") else wanted
            rules.setdefault(part, {})[name] = wanted + ("?" if name in NULLABLE[part] else "")
    of_part = lambda keys: F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])
    return F.create_map(*[x for part, keys in rules.items() for x in (F.lit(part), of_part(keys))])


def _required() -> Column:
    lists = {"document": DOCUMENT, **REQUIRED}
    return F.create_map(
        *[x for part, keys in lists.items() for x in (F.lit(part), F.array(*[F.lit(k) for k in keys]))]
    )


def _fits(value: Column, wanted: Column, shape: Column) -> Column:
    """Whether a JSON value of this shape coerces to the wanted type."""
    text = F.when(shape == "STRING", F.try_variant_get(value, "$", "string"))
    numeric = coerce.numeric_kind(shape)
    number = (
        F.when(shape == "BOOLEAN", F.lit(1.0))
        .when(shape == "STRING", coerce.number_of_text(text))
        .when(numeric, F.try_variant_get(value, "$", "double"))
    )
    flag = (
        F.when(shape == "STRING", F.lower(text).isin(*_SPOKEN))
        .when(numeric, number.isin(0.0, 1.0))
        .otherwise(shape == "BOOLEAN")
    )
    kind = F.rtrim(wanted, F.lit("?"))
    fits = (
        F.when(kind == "any", F.lit(True))
        .when(kind == "string", shape == "STRING")
        .when(kind == "boolean", flag)
        .when(kind == "strings", F.forall(coerce.items_of(value), coerce.is_text))
        .when(kind == "int", number == F.floor(number))
        .otherwise(number.isNotNull())
    )
    return F.coalesce(fits, F.lit(False)) | ((shape == "VOID") & wanted.endswith("?"))


def _object_violations(item: Column, rules: Column, required: Column) -> Column:
    """Unknown and missing keys of one JSON object, and values of the wrong type."""
    where, part = item["path"], item["part"]

    def rule(key: Column, value: Column) -> Column:
        wanted = F.try_element_at(F.element_at(rules, part), key)
        return let(wanted, lambda w: F.struct(w.alias("wanted"), F.when(w != "any", coerce.kind(value)).alias("shape")))

    def problem(entry: Column) -> Column:
        key, value = entry["key"], entry["value"]

        # The rule and the value's kind are each looked up once and read many times.
        def of_known(known: Column) -> Column:
            wanted = known["wanted"]
            negative = (key == "line_index") & (F.try_variant_get(value, "$", "double") < 0)
            found = (
                F.when(wanted.isNull(), "unknown key")
                .when(~_fits(value, wanted, known["shape"]), "wrong type")
                .when(negative, "negative")
            )
            return _violation(where, key, found)

        return let(rule(key, value), of_known)

    def of_entries(entries: Column) -> Column:
        bad = F.filter(F.transform(F.map_entries(entries), problem), lambda v: v["problem"].isNotNull())
        missing = F.array_except(F.element_at(required, part), F.map_keys(entries))
        return F.concat(bad, F.transform(missing, lambda k: _violation(where, k, F.lit("missing key"))))

    entries = F.try_variant_get(item["value"], "$", "map<string,variant>")
    no_object = F.array(_violation(where, F.lit(""), F.lit("not an object")))
    slow = F.coalesce(let(entries, of_entries), no_object).cast(VIOLATION)
    return F.when(_plainly_valid(item), F.array().cast(VIOLATION)).otherwise(slow)


def _objects(body: Column) -> Column:
    """Every object of a document as (path, part, value); a part that is not there is left out."""
    item = lambda path, part, value: F.struct(path.alias("path"), F.lit(part).alias("part"), value.alias("value"))
    single = [item(F.lit("$"), "document", body)]
    single += [item(F.lit(p), p, coerce.field(body, f"$.{p}")) for p in ("metadata", "invoice", "checks")]
    lines = coerce.items_of(coerce.field(body, "$.lines"))
    listed = F.transform(lines, lambda l, i: item(F.concat(F.lit("lines["), i.cast("string"), F.lit("]")), "lines", l))
    present = F.filter(F.array(*single), lambda o: o["value"].isNotNull())
    return F.when(listed.isNull(), present).otherwise(F.concat(present, listed))


def validate_documents(raw: DataFrame, document: str = "document") -> tuple[DataFrame, DataFrame]:
    """Valid rows, and one row per violation (path, key, problem) with the other input columns."""
    keys = [c for c in raw.columns if c != document]
    body, lines = F.col("__body"), coerce.field(F.col("__body"), "$.lines")
    unreadable = F.array(_violation(F.lit("$"), F.lit(""), F.lit("not JSON"))).cast(VIOLATION)
    not_list = F.array(_violation(F.lit("lines"), F.lit(""), F.lit("not a list"))).cast(VIOLATION)
    marked = raw.withColumn("__body", F.try_parse_json(document)).withColumns(
        {"__objects": _objects(body), "__rules": _rules(), "__required": _required()}
    )
    of_objects = F.flatten(
        F.transform("__objects", lambda o: _object_violations(o, F.col("__rules"), F.col("__required")))
    )
    no_list = lines.isNotNull() & coerce.items_of(lines).isNull()
    found = F.when(body.isNull(), unreadable).when(no_list, F.concat(of_objects, not_list)).otherwise(of_objects)
    marked = marked.select(*raw.columns, found.alias("__found"))
    valid = keep_where(marked, F.size("__found") == 0).drop("__found")
    return valid, inline_rows(marked, "__found", *keys)
