"""Splitting text into words and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def space_tokens(text: Column) -> Column:
    """Words separated by single spaces.

    Trailing empty words are dropped, leading and inner ones are kept. An empty text holds one
    empty word, a text of spaces only holds none.
    """
    body = F.rtrim(text)
    return (
        F.when(text == "", F.array(F.lit("")))
        .when(body == "", F.array().cast("array<string>"))
        .otherwise(F.split(body, " "))
    )


def text_lines(text: Column) -> Column:
    """Lines of a text as a text-file scan delivers them: the last line break ends a line and
    starts none, and an empty text has no line."""
    body = F.regexp_replace(text, r"(\r\n|\n|\r)\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r\n|\n|\r"))
