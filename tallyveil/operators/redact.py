"""Deny-lists and the scrubbing of text and log tables."""

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveil.functions.money import float_text
from tallyveil.functions.patterns import (
    ENTITY_MASK, ERROR_MASK, LOG_ERROR_MASK, TOKEN_MASK, stripped, with_patterns,
)
from tallyveil.operators import matcher
from tallyveil.plans.scale import SMALL_BYTES, SMALL_ROWS, measure

MIN_TOKEN_LEN = 3


def deny_list(df: DataFrame, cols: list[str], min_len: int = MIN_TOKEN_LEN, scope: str | None = None) -> DataFrame:
    """Distinct stripped values of the columns (strings or arrays of strings), short ones left out."""
    lists = [
        F.col(c).cast("array<string>") if isinstance(df.schema[c].dataType, T.ArrayType) else F.array(F.col(c).cast("string"))
        for c in cols
    ]
    keys = [scope] if scope else []
    values = df.select(*keys, F.explode_outer(F.concat(*lists)).alias("value"))
    tokens = values.select(*keys, stripped(F.col("value")).alias("token"))
    return tokens.filter(F.length("token") >= max(1, int(min_len))).distinct()


def secret_count(deny: DataFrame) -> DataFrame:
    return deny.agg(F.count_distinct("token").alias("secret_count"))


def matcher_order(deny: DataFrame) -> DataFrame:
    """One token per case-insensitive value, longest first."""
    kept = deny.groupBy(F.lower("token").alias("folded")).agg(F.min("token").alias("token"))
    return kept.select("token", F.length("token").alias("size")).orderBy(F.desc("size"), "token")


def token_layer(deny: DataFrame, by: str | None = None) -> Callable[[DataFrame, str], DataFrame]:
    """What masks the deny-list's tokens in a column; made once, applied to any number of columns.

    One matching rule whatever the number of tokens: those within bounds go to the tasks, more of
    them are confirmed by a join, and tokens scoped by a column meet the texts of their scope.
    Empty tokens match nothing.
    """
    if by:
        return matcher.scoped_layer(deny, TOKEN_MASK, by)
    rows, size = measure(deny)
    if rows > SMALL_ROWS or size > SMALL_BYTES:
        return matcher.joined_layer(deny, TOKEN_MASK)
    return matcher.gathered_layer(deny, TOKEN_MASK)


def gathered_tokens(df: DataFrame, column: str, deny: DataFrame) -> list[str] | None:
    """The folded tokens that a sweep of the column needs, gathered; None where they pass the bounds.

    Of a deny-list within bounds, all; of a longer one, those that some text of the column holds, for which the table
    is read when this is called.
    """
    rows, size = measure(deny)
    if rows > SMALL_ROWS or size > SMALL_BYTES:
        return matcher.gathered_within(matcher.matched_tokens(df, column, deny.select("token"), F.count("*")))
    return matcher.gathered_within(matcher.folded_tokens(deny))


def redact_tokens(df: DataFrame, column: str, deny: DataFrame, by: str | None = None) -> DataFrame:
    """Mask every deny-list token, in any case and inside words too, longest first."""
    return token_layer(deny, by)(df, column)


_LOADED: dict = {}


def loaded(key: str, detector: Callable):
    """The detector's function, made once in each worker; None where it cannot be made."""
    if key not in _LOADED:
        try:
            _LOADED[key] = detector()
        except Exception:
            _LOADED[key] = None
    return _LOADED[key]


def entity_layer(text: Column, detector: Callable[[], Callable[[str], list[tuple[int, int]]]]) -> Column:
    """Mask the spans an entity detector finds.

    ``detector`` is called once per worker and returns a function from text to (start, end) spans.
    When loading or a call fails, the text passes unchanged.
    """
    key = hashlib.sha256(cloudpickle.dumps(detector)).hexdigest()

    @F.pandas_udf("string")
    def cover(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = loaded(key, detector)

        def one(value):
            if find is None or not value:
                return value
            try:
                out, end = [], 0
                for start, stop in sorted(find(value)):
                    if stop <= end:
                        continue
                    out += [value[end:start], ENTITY_MASK] if start >= end else []
                    end = stop
                return "".join(out) + value[end:]
            except Exception:
                return value

        for texts in batches:
            yield texts.map(one, na_action="ignore")

    return cover(text)


def _as_text(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    value = F.col(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = float_text(value.cast("double"))
    elif isinstance(kind, T.BooleanType):
        value = F.when(value, F.lit("True")).when(~value, F.lit("False"))
    return F.coalesce(value.cast("string"), F.lit(""))


def scrub(
    df: DataFrame, cols: list[str], deny: DataFrame | None = None, allow: list[str] | None = None,
    ner=None, by: str | None = None,
) -> DataFrame:
    """Clean text columns: null to empty, deny-list tokens, patterns in order, then the entity layer."""
    mask_tokens = token_layer(deny, by) if deny is not None else None
    for column in cols:
        raw = f"__raw_{column}"
        df = df.withColumn(column, _as_text(df, column)).withColumn(raw, F.col(column))
        if mask_tokens:
            df = mask_tokens(df, column)
        df = with_patterns(df, column, guard=raw, allow=allow).drop(raw)
        if ner is not None:
            df = df.withColumn(column, entity_layer(F.col(column), ner))
    return df


def scrub_with(df: DataFrame, column: str, scrubber: Callable[[str], str]) -> DataFrame:
    """Apply a caller's own scrubber, failing closed: an error masks the value, never passes it."""

    @F.pandas_udf("string")
    def safely(texts: pd.Series) -> pd.Series:
        def one(value):
            try:
                return scrubber(value)
            except Exception:
                return ERROR_MASK

        return texts.map(one, na_action="ignore")

    return df.withColumn(column, F.coalesce(safely(_as_text(df, column)), F.lit("")))


_PLAIN = "%[sdi]"
_FORM = re.compile(r"%[#0\- +]*(\*|\d+)?(?:\.(\*|\d+)?)?[hlL]?(.)", re.DOTALL)


def formatted(msg: str, args: list) -> str:
    """``msg % args`` where the arguments come as text: numbers are read as the conversions ask."""
    values, left = [], iter(args)
    for form in _FORM.finditer(msg):
        values += [int(next(left)) for star in form.group(1, 2) if star == "*"]
        if form[3] == "%":
            continue
        value = next(left)
        if form[3] in "diu":
            value = int(value) if re.fullmatch(r"[+-]?\d+", value) else int(float(value))
        elif form[3] in "oxXc":
            value = int(value) if re.fullmatch(r"[+-]?\d+", value) else value
        elif form[3] in "eEfFgG":
            value = float(value)
        values.append(value)
    return msg % (*values, *left)


@F.pandas_udf(T.StringType())
def _formatted_udf(msg: pd.Series, args: pd.Series) -> pd.Series:
    def one(text, values):
        try:
            return None if text is None else formatted(text, [v for v in values])
        except Exception:
            return None

    return pd.Series([one(m, a) for m, a in zip(msg, args)], dtype=object)


def rendered(msg: Column, args: Column) -> Column:
    """``msg % args``; null when they do not fit together.

    Messages with %s, %d and %i only are split at these and zipped with the arguments, so text
    inside an argument is never read as a conversion. Those with another percent sign go through
    Python's own formatting. Without arguments the message stands as it is.
    """
    other = F.regexp_replace(msg, _PLAIN, "").contains("%")
    pieces = F.split(msg, _PLAIN, -1)
    marks = F.regexp_extract_all(msg, F.lit(f"({_PLAIN})"), F.lit(1))
    whole = F.transform(args, lambda a: F.regexp_extract(a, r"^([+-]?\d+)(\.\d*)?$", 1))
    shown = F.zip_with(
        marks,
        F.zip_with(args, whole, lambda a, w: F.struct(a.alias("text"), w.alias("whole"))),
        lambda mark, arg: F.when(mark == "%s", F.coalesce(arg["text"], F.lit("None"))).when(
            arg["whole"] != "", F.regexp_replace(arg["whole"], r"^\+|(?<=^-)0+(?=\d)|^0+(?=\d)", "")
        ),
    )
    text = F.array_join(F.zip_with(pieces, shown, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    fits = (F.size(marks) == F.size(args)) & F.forall(shown, lambda s: s.isNotNull())
    message = F.coalesce(msg, F.lit("None"))
    some = F.coalesce(F.size(args), F.lit(0)) > 0
    by_python = _formatted_udf(F.when(some & other, msg), args)
    return F.when(~some, message).when(other, by_python).when(fits, text)


def scrub_logs(logs: DataFrame, deny: DataFrame | None = None, allow: list[str] | None = None, ner=None) -> DataFrame:
    """Log records with their message rendered and cleaned, the arguments emptied, and the
    exception and stack text cleaned. A record that cannot be rendered keeps its row and loses
    its content."""
    empty = F.array().cast("array<string>")
    failed = F.col("__failed")
    texts = ["exc_text", "stack_info"]
    kept = {c: f"__had_{c}" for c in texts}
    df = logs.withColumn("msg", rendered(F.col("msg"), F.col("args"))).withColumn("__failed", F.col("msg").isNull())
    for column, had in kept.items():
        df = df.withColumn(had, F.col(column).isNotNull())
    df = scrub(df, ["msg", *texts], deny, allow, ner)
    df = df.withColumn("msg", F.when(failed, F.lit(LOG_ERROR_MASK)).otherwise(F.col("msg"))).withColumn("args", empty)
    for column, had in kept.items():
        df = df.withColumn(column, F.when(F.col(had) & ~failed, F.col(column)))
    return df.select(*logs.columns)


def leak_audit(df: DataFrame, column: str, deny: DataFrame) -> DataFrame:
    """Rows per deny-list token that still contain it, in any case; nothing after a scrub."""
    found = matcher.matched_tokens(df, column, deny.select("token"), F.count("*"))
    return found.select(F.col("folded").alias("token"), F.col("total").alias("rows"))
