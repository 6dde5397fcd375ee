"""Command lines to verbs and arguments, and replies to their text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keyloom.functions.exprs import trimmed

_TOKEN = r'(?s)("[^"\\]*+(?:\\.[^"\\]*+)*+"|[^ "][^ ]*|".*)'


def tokens(line: Column) -> Column:
    """The tokens of a line: parted by blanks, or quoted, with a backslash for the character after it.

    A closing quote ends its token; quotes inside a bare token are characters; an unterminated quote stays
    as it is (see parse).
    """
    raw = F.regexp_extract_all(trimmed(line), F.lit(_TOKEN), F.lit(1))
    return F.transform(raw, lambda t: F.when(_quoted(t), F.regexp_replace(F.substring(t, F.lit(2), F.length(t) - 2), r"(?s)\\(.)", "$1")).otherwise(t))


def _quoted(t: Column) -> Column:
    return F.regexp(t, F.lit(r'(?s)\A"[^"\\]*+(?:\\.[^"\\]*+)*+"\z'))


def parse(line: Column) -> Column:
    """struct(verb, args, error) of a command line; error is null for a good line, and verb upper case."""
    raw = F.regexp_extract_all(trimmed(line), F.lit(_TOKEN), F.lit(1))
    open_ = F.exists(raw, lambda t: t.startswith('"') & ~_quoted(t))
    error = F.when(line.isNull() | (trimmed(line) == ""), "empty line").when(open_, "unterminated quoted string")
    t = tokens(line)
    return F.struct(
        F.when(error.isNull(), F.upper(F.get(t, F.lit(0)))).alias("verb"),
        F.when(error.isNull(), F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0)))).alias("args"),
        error.alias("error"),
    )


def quote(value: Column) -> Column:
    """A value in quotes with backslashes before quotes and backslashes; an error text for null and for line ends."""
    bad = value.isNull() | F.regexp(value, F.lit(r"[\n\r]"))
    return F.when(bad, "(error) ERR value contains newline").otherwise(F.concat(F.lit('"'), F.regexp_replace(value, r'([\\"])', r"\\$1"), F.lit('"')))


def unquote(text: Column) -> Column:
    """A reply's value without its quotes and backslashes; other text as it is."""
    return F.when(_quoted(text), F.regexp_replace(F.substring(text, F.lit(2), F.length(text) - 2), r"(?s)\\(.)", "$1")).otherwise(text)


def to_wire(kind: Column, int_value: Column, str_value: Column, lines: Column) -> Column:
    """A reply as text: OK, NIL, INTEGER, VALUE, ERROR or MULTI."""
    listed = F.array_join(F.concat(F.transform(lines, quote), F.array(F.lit("*END"))), "\n")
    return (
        F.when(kind == "OK", "OK")
        .when(kind == "NIL", "(nil)")
        .when(kind == "INTEGER", F.concat(F.lit("(integer) "), int_value.cast("string")))
        .when(kind == "VALUE", quote(str_value))
        .when(kind == "ERROR", F.concat(F.lit("(error) ERR "), str_value))
        .when(kind == "MULTI", listed)
    )
