"""Text rules of the command languages: quotes, blanks, actions and replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip_quotes(x: Column) -> Column:
    """Without one leading and one trailing double quote."""
    return F.regexp_replace(F.regexp_replace(x, r'\A"', ""), r'"\z', "")


def server_line(x: Column) -> Column:
    """A line as the server reads it: no leading blanks, no trailing line ends."""
    return F.regexp_replace(F.regexp_replace(x, r"[\r\n]+\z", ""), r"\A\s+", "")


def shell_value(x: Column) -> Column:
    """A value as the shell reads it: without exactly one leading blank or tab."""
    return F.regexp_replace(x, r"\A[ \t]", "")


def pair(key: Column, value: Column) -> Column:
    return F.format_string("[%s] => %s", key, value)


def listing(key: Column, tag: Column) -> Column:
    return F.concat(F.when(tag == "SUB", F.lit("[DIR]   ")).otherwise(F.lit("[FILE] ")), key)


def percent(ratio: Column) -> Column:
    return F.format_string("%.2f%%", ratio * 100)


def server_stats(live: Column, total: Column) -> Column:
    return F.format_string("LIVE:%d TOTAL:%d", live, total)
