"""Identifier-aware tokens. Small helpers: queries are split on the driver, texts in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SEPARATORS = re.compile(r"[^a-zA-Z0-9]+")


# Runs of one kind inside a word: capitals up to one that begins a capitalised run, such a run,
# small letters, digits.
_RUNS = re.compile(r"[A-Z]+(?![a-z])|[A-Z][a-z]+|[a-z]+|[0-9]+")
GLUED = 4


def split_identifier(text: str) -> list[str]:
    """H7: the runs of each word; digits and the small letters behind them stay with a token of up
    to `GLUED` signs (utf8), a longer one ends there."""
    tokens: list[str] = []
    for word in _SEPARATORS.split(text):
        token = ""
        for run in _RUNS.findall(word):
            turns = token and run[0].isdigit() != token[-1].isdigit() and not run[0].isupper()
            if token and not (turns and len(token) <= GLUED):
                tokens.append(token.lower())
                token = ""
            token += run
        if token:
            tokens.append(token.lower())
    return tokens


def lex_tokens(text: str, keep_case: bool = False) -> list[str]:
    """H8: every blank-separated field, then its sub-tokens that differ from it.

    Fields are lower-cased before they are split, as the search path does; `keep_case` splits
    first, so that camel case breaks too.
    """
    tokens: list[str] = []
    for field in (text if keep_case else text.lower()).split():
        tokens.append(field.lower())
        tokens.extend(sub for sub in split_identifier(field) if sub != field.lower())
    return tokens


def query_terms(query: str, keep_case: bool = False) -> list[str]:
    """Distinct tokens of at least two bytes, in order of first use."""
    return list(dict.fromkeys(
        t for t in lex_tokens(query, keep_case) if len(t.encode()) >= 2))


def identifier_tokens(text: Column) -> Column:
    """H7 as a column, in Arrow batches."""
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_identifier(t))

    return F.pandas_udf(split, "array<string>")(text)
