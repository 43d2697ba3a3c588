"""Cleaning, keys, tokens and classes of text as Column functions; all run inside Spark's code generation or its higher-order functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a missing value in text files.
NULL_WORDS = ("", "nan", "none", "null", "na", "n/a")


def normalize_name(c: Column) -> Column:
    """Lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def feature_name(c: Column) -> Column:
    """A safe column name: other characters become one underscore; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""), F.lit(""))


def strip_numeric_suffix(c: Column) -> Column:
    """Without a bracketed number at the end."""
    return F.trim(F.regexp_replace(c, r" *\([0-9]+\)$", ""))


def collapse_spaces(c: Column) -> Column:
    """One blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def null_words_to_empty(c: Column) -> Column:
    """'' for null and for every spelling of a missing value."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(F.lower(t).isin(*NULL_WORDS), "").otherwise(t)


def stable_id(prefix: str, *parts: Column, separator: str = "|", fold: bool = True) -> Column:
    """prefix, underscore and 16 hex digits of the SHA-1 of the joined parts, trimmed and in lower case unless fold is off."""
    held = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(F.concat_ws(separator, *(F.lower(F.trim(p)) if fold else p for p in held))), 1, 16))


def term_set(c: Column, stop: Sequence[str] = (), pattern: str = r"[,;/|]+|\band\b") -> Column:
    """Sorted distinct trimmed terms of a delimited list, without stop terms."""
    terms = F.transform(F.split(c, pattern), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(terms, lambda x: (x != "") & ~F.lower(x).isin(list(stop) or [""]))))


def tokens(c: Column, pattern: str = "[a-z0-9]+", stop: Sequence[str] = ()) -> Column:
    """Distinct lower-case tokens in order of first appearance, without stop words."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0)), lambda x: ~x.isin(list(stop) or [""])))


def symbol_like(c: Column) -> Column:
    """Capitals, digits and hyphens only."""
    return F.coalesce(c.rlike("^[A-Z0-9-]+$"), F.lit(False))


def text_class(c: Column) -> Column:
    """placeholder, multi, symbol, pathway or free text; the first class that fits."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return (
        F.when(F.lower(t).isin(*NULL_WORDS, "unknown", "-"), "placeholder")
        .when(t.rlike("[,;|]"), "multi")
        .when(symbol_like(t), "symbol")
        .when(F.lower(t).rlike("pathway|signaling|signalling"), "pathway")
        .otherwise("free_text")
    )


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def term_count(c: Column, term: str) -> Column:
    """Occurrences of a term that do not overlap, in any case."""
    return ((F.length(c) - F.length(F.replace(F.lower(c), F.lit(term.lower()), F.lit("")))) / F.lit(len(term))).cast("long")


def parent_name(c: Column, suffixes: Sequence[str]) -> Column:
    """The name in lower case without trailing suffix words, such as salts and doses."""
    pattern = r"(\s+(" + "|".join(suffixes) + r"))+$"
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), pattern, ""))


def first_keyword(c: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The label of the first rule of which a keyword occurs in the text."""
    low, out = F.lower(c), None
    for label, words in rules:
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def lookup(c: Column, table: Mapping[str, object], default: object = None) -> Column:
    """A literal map, for small tables that are part of the program."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[c], F.lit(default))


def joined_reasons(flags: Sequence[tuple[Column, str]], separator: str = ";") -> Column:
    """Names of the flags that hold, in the given order."""
    return F.array_join(F.array_compact(F.array(*(F.when(f, name) for f, name in flags))), separator)
