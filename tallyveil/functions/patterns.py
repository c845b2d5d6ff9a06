"""Ordered identifier patterns and the expressions that apply them.

Word, digit and space classes are written out, since the JVM's own word boundary is not the
Unicode one these patterns need: a word character is a letter, a number or an underscore.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN_MASK = "[REDACTED:PHI]"
ENTITY_MASK = "[REDACTED:NER]"
ERROR_MASK = "[REDACTION-ERROR]"
LOG_ERROR_MASK = "[REDACTION-ERROR: log content suppressed]"

_W = r"[\p{L}\p{N}_]"
_D = r"\p{Nd}"
_START = rf"(?<!{_W})"
_END = rf"(?!{_W})"
_EDGE = rf"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


@dataclass(frozen=True)
class Pattern:
    label: str
    mask: str
    regex: str
    needs: str  # a text without this literal cannot match, so the regex is not run on it


# Labels, masks, what each pattern accepts, and the order in which they run.
PATTERNS = (
    Pattern("EMAIL", "[REDACTED:EMAIL]", _EDGE + r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}" + _END, "@"),
    Pattern("INVOICE_NO", "[REDACTED:INVOICE_NO]", rf"{_START}[A-Z]{{1,5}}[/\-]{_D}{{4}}[/\-]{_D}{{3,}}{_END}", ""),
    Pattern("SSN", "[REDACTED:SSN]", rf"{_START}{_D}{{3}}-{_D}{{2}}-{_D}{{4}}{_END}", "-"),
    Pattern("CREDIT_CARD", "[REDACTED:CARD]", rf"{_START}(?:{_D}[ \-]?){{13,19}}{_EDGE}", ""),
    Pattern("IP", "[REDACTED:IP]", rf"{_START}(?:{_D}{{1,3}}\.){{3}}{_D}{{1,3}}{_END}", "."),
    Pattern(
        "URL", "[REDACTED:URL]",
        rf"(?iu){_START}https?://[^\s\u000b\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000<>\"')]+",
        "://",
    ),
    Pattern("PHONE", "[REDACTED:PHONE]", rf"{_START}\+{_D}[{_D} .\-]{{6,}}{_D}{_END}", "+"),
    Pattern("PHONE", "[REDACTED:PHONE]", rf"\({_D}{{2,4}}\)[ .\-]?{_D}{{2,4}}[ .\-]?{_D}{{2,4}}", "("),
)
ALLOWLISTABLE = ("URL", "IP")


def patterns_of(label: str) -> list[Pattern]:
    return [p for p in PATTERNS if p.label == label]


def _replace_allowing(text: Column, pattern: Pattern, allow: list[str]) -> Column:
    """Replace matches that no allowed value contains or is contained in; keep the others."""
    values = F.array(*[F.lit(a) for a in allow])
    found = F.regexp_extract_all(text, F.lit(f"({pattern.regex})"), F.lit(1))
    between = F.split(text, pattern.regex, -1)

    def shown(match: Column) -> Column:
        allowed = F.exists(values, lambda a: match.contains(a) | a.contains(match))
        return F.when(allowed, match).otherwise(F.lit(pattern.mask))

    pieces = F.zip_with(between, F.transform(found, shown), lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit(""))))
    return F.array_join(pieces, "")


def _apply(text: Column, pattern: Pattern, allow: list[str]) -> Column:
    if allow and pattern.label in ALLOWLISTABLE:
        return _replace_allowing(text, pattern, allow)
    return F.regexp_replace(text, pattern.regex, pattern.mask)


def redact_allowing(text: Column, label: str, allow: list[str]) -> Column:
    """Apply the patterns of one label, sparing allow-listed URLs and addresses."""
    for pattern in patterns_of(label):
        text = _apply(text, pattern, [a for a in allow if a])
    return text


def redact(text: Column, label: str) -> Column:
    return redact_allowing(text, label, [])


def redact_patterns(text: Column, allow: list[str] | None = None) -> Column:
    """All patterns in order, as one expression (for use inside array transforms)."""
    for pattern in PATTERNS:
        text = _apply(text, pattern, [a for a in allow or [] if a])
    return text


def with_patterns(df: DataFrame, column: str, guard: str | None = None, allow: list[str] | None = None) -> DataFrame:
    """All patterns in order over a column, one projection each.

    Masks never create an '@', '+', '(' and so on, so a literal missing from the text at the start
    (``guard``, default the column itself) is missing throughout, and the regex is skipped.
    """
    allow = [a for a in allow or [] if a]
    source = "__guard"
    df = df.withColumn(source, F.col(guard or column))
    for pattern in PATTERNS:
        replaced = _apply(F.col(column), pattern, allow)
        if pattern.needs:
            replaced = F.when(F.col(source).contains(pattern.needs), replaced).otherwise(F.col(column))
        df = df.withColumn(column, replaced)
    return df.drop(source)


def redact_each(texts: Column, allow: list[str] | None = None) -> Column:
    """All patterns in order over an array of texts; a regex is not run on a text that lacks its literal."""
    allow = [a for a in allow or [] if a]
    for pattern in PATTERNS:
        texts = F.transform(texts, lambda t: F.when(t.contains(pattern.needs), _apply(t, pattern, allow)).otherwise(t))
    return texts


def quoted(token: Column) -> Column:
    """A token as a literal piece of a regex."""
    return F.concat(F.lit(r"\Q"), F.replace(token, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def alternation(tokens: Column) -> Column:
    """One case-insensitive pattern for an array of tokens, longest first; null for no tokens. Empty tokens match nothing."""
    tokens = F.filter(tokens, lambda t: t.isNotNull() & (t != ""))
    ranked = F.array_sort(F.transform(tokens, lambda t: F.struct((-F.length(t)).alias("size"), t.alias("token"))))
    body = F.array_join(F.transform(ranked, lambda r: quoted(r["token"])), "|")
    return F.when(F.size(tokens) > 0, F.concat(F.lit("(?iu)"), body))


def redact_row_tokens(text: Column, tokens: Column) -> Column:
    """Mask the tokens that stand in an array column of the same row."""
    return F.coalesce(F.regexp_replace(text, alternation(tokens), F.lit(TOKEN_MASK)), text)


# White space as stripped from the ends of a token.
STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")
