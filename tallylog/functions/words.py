"""Levels, routes, messages, numbers and durations in log lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WS, NOT_WS = r"\p{IsWhite_Space}", r"\P{IsWhite_Space}"

#: Level names by rank, and the words that stand for each.
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")
LEVEL_WORDS = {
    "TRACE": ("TRACE", "TRC", "VERBOSE"),
    "DEBUG": ("DEBUG", "DBG"),
    "INFO": ("INFO", "INF", "NOTICE"),
    "WARN": ("WARN", "WARNING", "WRN"),
    "ERROR": ("ERROR", "ERR", "SEVERE"),
    "FATAL": ("FATAL", "CRITICAL", "CRIT", "PANIC"),
}
ERROR_RANK = LEVELS.index("ERROR")
MESSAGE_CHARS, EXAMPLE_CHARS = 160, 120

_WORDS = "|".join(w for words in LEVEL_WORDS.values() for w in words)
#: A level word within the first three tokens, stripped of brackets, colons and bars; then the message.
LEVEL_LINE = rf"(?is)^{WS}*(?:{NOT_WS}+{WS}+){{0,2}}?[\[\]:|<>]*({_WORDS})[\[\]:|<>]*(?={WS}|$)(?:{WS}|[:\]-])*(.*)$"
NUMBER = r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"
_DURATION = r"(?<![0-9A-Za-z.])([0-9][0-9.]*+)(?: *(ms|s)(?![A-Za-z]))?"


def is_blank(text: Column) -> Column:
    return (text == "") | text.rlike(rf"^{WS}*$")


def is_indented(text: Column) -> Column:
    return text.rlike(f"^{WS}")


def trim_start(text: Column) -> Column:
    return F.when(text.rlike(rf"^{WS}"), F.regexp_replace(text, rf"^{WS}+", "")).otherwise(text)


def level_rank(word: Column) -> Column:
    """0 (TRACE) to 5 (FATAL); null for any other word."""
    pairs = [F.lit(x) for name in LEVELS for w in LEVEL_WORDS[name] for x in (w, LEVELS.index(name))]
    return F.try_element_at(F.create_map(*pairs), F.upper(word))


def level_name(rank: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, name in enumerate(LEVELS) for x in (k, name)]), rank)


def seconds(number: Column) -> Column:
    """A run of digits and dots as a double; null unless it is one number."""
    return F.when(number.rlike(NUMBER), number.try_cast("double"))


def _first_duration(message: Column) -> Column:
    """Struct (n, u): the first number that has a unit or is malformed."""
    pairs = F.arrays_zip(F.regexp_extract_all(message, F.lit(_DURATION), F.lit(1)).alias("n"), F.regexp_extract_all(message, F.lit(_DURATION), F.lit(2)).alias("u"))
    return F.get(F.filter(pairs, lambda x: (x["u"] != "") | x["n"].rlike(r"\..*\.")), F.lit(0))


def _in_seconds(first: Column) -> Column:
    scale = F.when(first["u"] == "ms", F.lit(0.001)).when(first["u"] == "s", F.lit(1.0))
    return F.when(~first["n"].rlike(r"\..*\."), first["n"].try_cast("double") * scale)


def message_seconds(message: Column) -> Column:
    """The first number with the unit ms or s, in seconds; a malformed number before it ends the search."""
    return _in_seconds(_first_duration(message))


def with_message_seconds(df: DataFrame, message: str, out: str) -> DataFrame:
    """``message_seconds`` in two steps."""
    return df.withColumn("_first", F.when(F.col(message).rlike("[0-9]"), _first_duration(F.col(message)))).withColumn(out, _in_seconds(F.col("_first"))).drop("_first")


def route(path: Column) -> Column:
    """The path without query and fragment, ids as ``:id``: segments of digits, or of 8 or more hex digits and hyphens."""
    bare = F.substring_index(F.substring_index(path, "?", 1), "#", 1)
    named = F.regexp_replace(bare, r"(?<![^/])(?:[0-9]+|[0-9a-fA-F-]{8,})(?![^/])", ":id")
    return F.when(bare == "", F.lit("(none)")).otherwise(named)


def message_key(message: Column) -> Column:
    """The first 160 characters with each run of digits as ``#``."""
    return F.regexp_replace(F.substring(message, 1, MESSAGE_CHARS), "[0-9]+", "#")
