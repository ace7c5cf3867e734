"""Text columns: token search and class names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates words in descriptions of an archive, and of directories.
ARCHIVE, DIRECTORIES = "[ .,;]+", "[ .,;_-]+"


def tokens(text: Column, between: str = ARCHIVE) -> Column:
    """Lower-case words, without empty ones."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), between), lambda w: w != "")


def token_overlap(phrase: str, text: Column, between: str = ARCHIVE) -> Column:
    """How many words of the phrase are words of the text; a word given twice counts twice."""
    wanted = tokens(F.lit(phrase), between)
    have = tokens(text, between)
    return F.size(F.filter(wanted, lambda w: F.array_contains(have, w))).cast("long")


def class_name(file: Column) -> Column:
    """From a file's name: no folder, no extension, - and _ as spaces, words with a capital."""
    stem = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[^.]*$", "")
    return F.initcap(F.regexp_replace(stem, "[-_]", " "))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
