"""Column expressions over type names, patterns and type texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space around a name.
BLANKS = " \t\n\r\x0b\x0c"
#: The primitive type names, which are no reference types.
PRIMITIVES = ("void", "boolean", "byte", "char", "short", "int", "long", "float", "double")


def plain_name(c: Column | str) -> Column:
    """A type name without surrounding white space and with `.` for `/`; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(F.btrim(c, F.lit(BLANKS)), F.lit("/"), F.lit("."))


def raw_name(c: Column | str) -> Column:
    """A plain name cut before its type arguments."""
    return F.btrim(F.substring_index(plain_name(c), "<", 1), F.lit(BLANKS))


def glob(c: Column, pattern: str, strict: bool = True) -> Column:
    """Whole-text match of a pattern with `*`. Without `*` it is equality. With `strict` only `.` is escaped, so other
    regular-expression characters keep their meaning (`Foo$*` never matches `Foo$1`); else all are escaped."""
    if "*" not in pattern:
        return c == F.lit(pattern)
    return c.rlike(glob_regex(pattern, strict))


def glob_regex(pattern: str, strict: bool = True) -> str:
    special = "." if strict else ".\\+?^${}()|[]"
    return "^(?:" + "".join(".*" if x == "*" else "\\" + x if x in special else x for x in pattern) + ")$"


def erased(c: Column) -> Column:
    """The base of a type text: no `[]`, no type arguments, trimmed; null for primitives and blank text."""
    base = erased_any(c)
    return F.when(~base.isin(*PRIMITIVES) & (base != ""), base)


def erased_any(c: Column) -> Column:
    """As `erased`, but primitives stay."""
    return F.trim(F.substring_index(F.trim(F.replace(c, F.lit("[]"), F.lit(""))), "<", 1))


def returns_match(type_text: Column, wanted: str) -> Column:
    """Whether the base of a return type contains the wanted text; never for primitives and void."""
    return F.coalesce(F.contains(erased(type_text), F.lit(wanted)), F.lit(False))


def package_of(c: Column) -> Column:
    """The text before the last dot, '' without a dot."""
    return F.regexp_extract(c, r"^(.*)\.[^.]*$", 1)


def simple_of(c: Column) -> Column:
    """The text after the last dot and the last `$`."""
    return F.regexp_extract(c, r"([^.$]*)$", 1)


def short_type(c: Column) -> Column:
    """A type text with every qualified name shortened to its last part."""
    return F.regexp_replace(c, r"([\p{L}_$][\p{L}\p{N}_$]*\.)+", "")


def truncated_sha256(c: Column, length: int) -> Column:
    return F.substring(F.sha2(c, 256), 1, length)


def percent_encoded(c: Column) -> Column:
    """Percent encoding that leaves only letters, digits, `-`, `.`, `_` and `~`."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def timeout_minutes(c: Column) -> Column:
    """The minutes of a timeout's text: `30m`, `1h` or a plain number of minutes; anything else is 30."""
    rx = r"^\s*(\d{1,7})\s*([mMhH]?)\s*$"
    hours = F.lower(F.regexp_extract(c, rx, 2)) == "h"
    return F.when(c.rlike(rx), F.regexp_extract(c, rx, 1).try_cast("int") * F.when(hours, 60).otherwise(1)).otherwise(30)


def duration_text(seconds: Column) -> Column:
    """`2h 3m 4s`, `3m 4s` or `4s`."""
    s = seconds.cast("bigint")
    h, m, rest = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, rest)).when(m > 0, F.format_string("%dm %ds", m, rest)).otherwise(F.format_string("%ds", rest))
