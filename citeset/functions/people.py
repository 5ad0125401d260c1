"""Author names as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import parse_list, strip


def coerce_authors(c: Column) -> Column:
    """A comma-separated string as an array of trimmed, non-empty names."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: x != "")


def parse_authors(c: Column) -> Column:
    """A serialised list or tuple, or a comma-separated string, as an array of names; null: none."""
    bare = strip(F.coalesce(c, F.lit("")))
    listed = bare.rlike(r"^[\[(]")
    as_list = F.regexp_replace(F.regexp_replace(bare, r"^\(", "["), r",?\s*\)$", "]")
    names = F.when(listed, parse_list(F.when(listed, as_list))).otherwise(coerce_authors(bare))
    return F.filter(F.transform(names, strip), lambda x: x != "")


def normal_form(name: Column) -> Column:
    """Surname and initials: ``Bhatti H. N.`` becomes ``Bhatti HN``; the first word is the surname."""
    words = F.filter(F.transform(F.split(strip(name), r"(?U)\s+"), lambda w: F.regexp_replace(w, r"""^[\[\]'"]+|[\[\]'"]+$""", "")), lambda w: w != "")
    initials = F.array_join(F.transform(F.slice(words, 2, 1 << 20), lambda w: F.left(w, F.lit(1))), "")
    return F.when(F.size(words) == 0, F.lit("")).otherwise(F.concat_ws(" ", F.get(words, F.lit(0)), F.nullif(initials, F.lit(""))))


def surname(name: Column) -> Column:
    return F.get(F.split(normal_form(name), " "), F.lit(0))


def short_form(name: Column) -> Column:
    """``Surname G``: the surname and the first letter of the next word."""
    words = F.split(strip(name), r"(?U)\s+")
    return F.when(F.size(words) > 1, F.concat_ws(" ", F.get(words, F.lit(0)), F.left(F.get(words, F.lit(1)), F.lit(1)))).otherwise(F.get(words, F.lit(0)))


def author_payload(authors: Column, cited: Column) -> Column:
    """Short names of an article's authors and of each reference's authors."""
    return F.named_struct(F.lit("authors"), F.transform(authors, short_form), F.lit("cited_authors"), F.transform(cited, lambda a: F.transform(a, short_form)))
