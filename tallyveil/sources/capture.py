"""Reading captured RPC exchanges: which are invoice reads, and which records they hold."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyveil.functions import coerce
from tallyveil.plans.scale import keep_where

# Fixed values of the captured protocol.
RPC_PATH = "/web/dataset/call_kw"
MOVE_MODEL = "account.move"
READ_METHODS = ("web_read", "read")
SEARCH_METHODS = ("web_search_read", "search_read")

REJECT_ERROR = "JSON-RPC error"
REJECT_EMPTY = "no record"
REJECT_UNREADABLE = "unreadable body"


def _calls(capture: DataFrame, methods: tuple) -> DataFrame:
    """Exchanges of the invoice model by method. The url test comes first, the body is parsed after."""
    on_path = capture.filter(F.col("url").contains(RPC_PATH))
    params = coerce.field(F.try_parse_json("request"), "$.params")
    model, method = coerce.field(params, "$.model"), coerce.field(params, "$.method")
    return on_path.filter(
        coerce.is_object(params)
        & (coerce.text_of(model) == MOVE_MODEL)
        & coerce.text_of(method).isin(*methods)
    )


def move_reads(capture: DataFrame) -> DataFrame:
    return _calls(capture, READ_METHODS)


def move_searches(capture: DataFrame) -> DataFrame:
    return _calls(capture, SEARCH_METHODS)


def calls(capture: DataFrame) -> DataFrame:
    """Reads and searches of the invoice model, told apart by ``kind``; a request is parsed once."""
    # Null unless the parameters are an object.
    params = F.try_variant_get(F.try_parse_json("request"), "$.params", "struct<model:variant,method:variant>")
    seen = capture.filter(F.col("url").contains(RPC_PATH)).withColumn("params", params)
    method = coerce.text_of(F.col("params.method"))
    wanted = coerce.text_of(F.col("params.model")) == MOVE_MODEL
    kind = F.when(wanted & method.isin(*READ_METHODS), "read").when(wanted & method.isin(*SEARCH_METHODS), "search")
    return keep_where(seen.withColumn("kind", kind).drop("params"), F.col("kind").isNotNull())


def _object_or_null(value: Column) -> Column:
    return F.when(coerce.is_object(value), value)


def result_of(df: DataFrame) -> DataFrame:
    """Adds the parsed ``body`` of the response and its ``result``."""
    with_body = df.withColumn("body", F.try_parse_json("response"))
    return with_body.withColumn("result", coerce.field(F.col("body"), "$.result"))


def moves_from_result(df: DataFrame, mode: str = "first") -> DataFrame:
    """Adds ``move`` (the record of a result) and ``record_pos``.

    A list or an object with a list of ``records`` stands for its elements, another object for
    itself. ``first`` keeps one row per exchange, with a null move when there is none; ``all`` is
    the batch form with one row per record.
    """
    # Read from the whole answer where it is there: a result of its own would be one more copy.
    source, root = (F.col("body"), "$.result") if "body" in df.columns else (F.col("result"), "$")
    if mode == "first":
        is_object = lambda path: F.try_variant_get(source, path, "struct<id:variant>").isNotNull()
        single = F.when(F.lit(False), F.lit(None).cast("variant"))
        for path in (f"{root}[0]", f"{root}.records[0]"):
            single = single.when(is_object(path), coerce.field(source, path))
        no_list = F.try_variant_get(source, f"{root}.records", "array<struct<id:variant>>").isNull()
        single = single.when(no_list & is_object(root), coerce.field(source, root))
        return df.withColumn("move", single).withColumn("record_pos", F.lit(0))
    result = coerce.field(source, root)
    listed = F.coalesce(*[F.try_variant_get(source, path, "array<variant>") for path in (root, f"{root}.records")])
    many = F.coalesce(listed, F.filter(F.array(result), lambda r: r.isNotNull()))
    out = df.select("*", F.posexplode_outer(many).alias("record_pos", "move"))
    return out.withColumn("move", _object_or_null(F.col("move"))).fillna(0, ["record_pos"])


def with_reject_reason(df: DataFrame) -> DataFrame:
    """Adds ``reject_reason``: an error answer, an unreadable one, or one without a record."""
    # Only a record without any usual field is looked at for being empty.
    usual = [coerce.field(F.col("move"), f"$.{name}").isNotNull() for name in ("name", "partner_id", "state")]
    empty = F.when(usual[0] | usual[1] | usual[2], F.lit(False)).otherwise(~coerce.truthy(F.col("move")))
    reason = (
        F.when(~coerce.is_object(F.col("body")), REJECT_UNREADABLE)
        .when(coerce.truthy(coerce.field(F.col("body"), "$.error")), REJECT_ERROR)
        .when(empty, REJECT_EMPTY)
    )
    return df.withColumn("reject_reason", reason)


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows to extract, and rejected rows with their reason."""
    marked = with_reject_reason(df)
    passed = F.col("reject_reason").isNull()
    return keep_where(marked, passed), keep_where(marked, ~passed)
