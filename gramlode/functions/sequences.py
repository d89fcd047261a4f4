"""Nucleotide strings, names and small tokenizers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Nucleotide codes and their complements, IUPAC codes included.
CODES = "ABCDGHKMNRSTVWYabcdghkmnrstvwy"
COMPLEMENTS = "TVGHCDMKNYSABWRtvghcdmknysabwr"

#: Letters written as nucleotides, so that text can be searched like sequences.
LETTERS, NUCLEOTIDES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"

#: Suffixes of filter files, outermost last.
_FILTER_SUFFIX = r"(\.(?:allsome|detbrief|det))?(\.(?:rrr|roar))?(\.unity)?(\.bf)?$"


def is_acgt(seq: Column) -> Column:
    """True if all characters are A, C, G or T, in either case, and there is one."""
    return seq.rlike("^[ACGTacgt]+$")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, CODES, COMPLEMENTS))


def text_to_nucleotides(text: Column) -> Column:
    """Letters a to z as nucleotides; blanks and sentence marks go, other characters stay and break runs."""
    return F.translate(F.lower(F.regexp_replace(text, "[ \\n\\t\\r.,;:!?]", "")), LETTERS, NUCLEOTIDES)


def is_prefix_of(part: Column, whole: Column) -> Column:
    return F.startswith(whole, part)


def is_suffix_of(part: Column, whole: Column) -> Column:
    return F.endswith(whole, part)


def strip_prefix(text: Column, prefix: str) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, len(prefix) + 1, 1 << 30)).otherwise(text)


def strip_suffix(text: Column, suffix: str) -> Column:
    return F.when(text.endswith(suffix), F.substr(text, F.lit(1), F.length(text) - len(suffix))).otherwise(text)


def strip_blank_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def strip_blank_prefix(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+", "")


def strip_blank_suffix(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def strip_file_path(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def to_lower(text: Column) -> Column:
    return F.lower(text)


def filter_name(path: Column) -> Column:
    """Name of a filter: its file name without path and without the suffixes of filter files."""
    return F.regexp_replace(strip_file_path(path), _FILTER_SUFFIX, "")


def comma_list(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda x: strip_blank_ends(x))


def fields(text: Column) -> Column:
    """White-space separated fields."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def quoted_fields(text: Column) -> Column:
    """White-space separated fields; a field in double quotes may hold white space."""
    return F.transform(F.regexp_extract_all(text, F.lit(r'"[^"]*"|[^\s"]+'), F.lit(0)), lambda x: F.regexp_replace(x, '^"|"$', ""))


def numbered(template: Column, n: int, mark: str = "{number}") -> Column:
    """The template with the mark replaced by 1 to n."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.replace(template, F.lit(mark), i.cast("string")))
