"""Tag strings, weights, taxonomies and labels as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# 21 genres in 10 consolidated categories, and those that are left out.
GENRE_TAXONOMY = {
    "Rock/Pop": ["Pop/Rock"],
    "Electronic": ["Electronic", "Easy Listening"],
    "Hip-Hop/Rap": ["Rap"],
    "R&B/Soul": ["R&B"],
    "Jazz": ["Jazz"],
    "Classical": ["Classical"],
    "Folk/Country": ["Folk", "Country"],
    "Blues": ["Blues"],
    "World": ["International", "Latin", "Reggae"],
    "Experimental": ["Avant-Garde", "New Age"],
}
EXCLUDED_GENRES = ("Children's", "Holiday", "Religious", "Comedy/Spoken", "Stage & Screen", "Vocal")
UNKNOWN_LABEL = "T0"


def ptrim(c: Column) -> Column:
    """Trim all Unicode white space; ``trim`` takes blanks only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    return c.isNull() | (ptrim(c) == "")


def parse_tags(c: Column) -> Column:
    """Split at commas, trim, drop empty parts; order, case and repeats stay. Null gives no tags."""
    parts = F.filter(F.transform(F.split(c, ",", -1), ptrim), lambda x: x != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def lower_tags(c: Column) -> Column:
    """``parse_tags`` in lower case, repeats kept."""
    return F.transform(parse_tags(c), F.lower)


def clean_tags(c: Column) -> Column:
    """Lower-case distinct tags, in the order of their first occurrence."""
    return F.array_distinct(lower_tags(c))


def clean_tag_list(tags: Column) -> Column:
    """``clean_tags`` for an array; a null array gives no tags."""
    cleaned = F.filter(F.transform(tags, lambda x: F.lower(ptrim(x))), lambda x: x.isNotNull() & (x != ""))
    return F.coalesce(F.array_distinct(cleaned), F.array().cast("array<string>"))


def parse_weights(c: Column) -> Column:
    """Integer weights; a part that is no integer is 0, blanks are dropped."""
    parts = F.filter(F.transform(F.split(c, ",", -1), ptrim), lambda x: x != "")
    return F.coalesce(F.transform(parts, lambda x: F.coalesce(x.try_cast("int"), F.lit(0))), F.array().cast("array<int>"))


def top_weight_tags(tags: Column, weights: Column) -> Column:
    """Distinct lower-case tags tied at the greatest weight; all of them if the numbers of tags and weights differ."""
    t, w = lower_tags(tags), parse_weights(weights)
    at_top = F.transform(F.filter(F.arrays_zip(t.alias("t"), w.alias("w")), lambda z: z["w"] == F.array_max(w)), lambda z: z["t"])
    return F.array_distinct(F.when((F.size(t) == F.size(w)) & (F.size(t) > 0), at_top).otherwise(t))


def _lookup(groups: Mapping[str, Sequence[str]], lower: bool) -> Column:
    pairs = [(m.lower() if lower else m, name) for name, members in groups.items() for m in members]
    return F.create_map(*(F.lit(x) for pair in pairs for x in pair))


def consolidate(tags: Column, taxonomy: Mapping[str, Sequence[str]] = GENRE_TAXONOMY, ignore_case: bool = False) -> Column:
    """Categories of the tags, distinct, in order; unknown and excluded tags have none."""
    table = _lookup(taxonomy, ignore_case)
    names = F.transform(tags, lambda x: F.try_element_at(table, F.lower(ptrim(x)) if ignore_case else ptrim(x)))
    return F.array_distinct(F.filter(names, lambda x: x.isNotNull()))


def has_valid_category(tags: Column, excluded: Sequence[str] = EXCLUDED_GENRES) -> Column:
    """Whether any tag isn't excluded; unknown tags are valid, case counts."""
    return F.coalesce(F.exists(tags, lambda x: ~x.isin(*excluded)), F.lit(False))


def has_valid_category_text(c: Column, excluded: Sequence[str] = EXCLUDED_GENRES) -> Column:
    """The variant over text that keeps empty parts, so a trailing comma is valid."""
    return F.coalesce(F.exists(F.transform(F.split(c, ",", -1), ptrim), lambda x: ~x.isin(*excluded)), F.lit(False))


def parse_float(c: Column, default: float | None = None) -> Column:
    """A double; text that is no number, and null, give ``default``; ``nan`` and ``inf`` are numbers."""
    return F.coalesce(ptrim(c).try_cast("double"), F.lit(default).cast("double"))


def required(c: Column, name: str) -> Column:
    """The trimmed text; a missing or blank one raises."""
    return F.when(~is_blank(c), ptrim(c)).otherwise(F.raise_error(F.lit(f"missing value in {name}")).cast("string"))


def optional(c: Column) -> Column:
    """The trimmed text, null where blank."""
    return F.when(~is_blank(c), ptrim(c))


def assign_labels(tags: Column, labels: Mapping[str, Sequence[str]], unknown: str = UNKNOWN_LABEL) -> Column:
    """Distinct labels of the tags in string order, comma-joined; unknown tags get ``unknown``, no tags the empty text."""
    table = _lookup(labels, False)
    return F.array_join(F.array_sort(F.array_distinct(F.transform(tags, lambda x: F.coalesce(F.try_element_at(table, x), F.lit(unknown))))), ",")


def join_tags(tags: Column) -> Column:
    return F.array_join(tags, ",")
