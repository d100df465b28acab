"""Text normalisation, similarity and loose equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space removed by a full Unicode trim, as characters and as a pattern.
SPACE_CHARACTERS = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"

# Fixed value: two names are similar when their score is strictly above this.
NAME_THRESHOLD = 0.85


def full_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARACTERS))


def norm(c: Column) -> Column:
    return F.lower(full_trim(c))


def collapse(c: Column) -> Column:
    return full_trim(F.regexp_replace(c, f"{SPACE}+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_email(c: Column) -> Column:
    """Lower case, first ``mailto:`` dropped, trimmed; NULL when nothing is left."""
    return blank_to_null(full_trim(F.regexp_replace(F.lower(c), r"(?s)^(.*?)mailto:", "$1")))


def url_key(c: Column) -> Column:
    """URL compared without one trailing slash; NULL when empty."""
    return F.when(c != "", F.regexp_replace(c, "/$", ""))


def first_of(c: Column) -> Column:
    return F.try_element_at(c, F.lit(1))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length on normalised text, 0 when either is missing."""
    x, y = norm(a), norm(b)
    return (
        F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), F.lit(0.0))
        .when(x == y, F.lit(1.0))
        .otherwise(edit_score(x, y))
    )


def edit_score(x: Column, y: Column) -> Column:
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(x, y) / longest)


def same_text(a: Column, b: Column) -> Column:
    """Equality that ignores case and outer space; NULL equals NULL only."""
    return norm(a).eqNullSafe(norm(b))


def same_set(a: Column, b: Column) -> Column:
    """Array equality that ignores order, case and outer space."""
    return F.array_sort(F.transform(a, norm)).eqNullSafe(F.array_sort(F.transform(b, norm)))


def same_structure(a: Column, b: Column) -> Column:
    """Equality of two nested values by their JSON text."""
    return F.to_json(a).eqNullSafe(F.to_json(b))


def show_list(c: Column, empty: str = "") -> Column:
    """Array as ``a, b``; the placeholder when it is missing or empty."""
    return F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise(F.lit(empty))


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def distinct_by_norm(c: Column) -> Column:
    """Array without case-insensitive repeats; the first spelling stays."""
    return F.aggregate(
        c,
        F.array().cast("array<string>"),
        lambda acc, x: F.when(F.array_contains(F.transform(acc, norm), norm(x)), acc).otherwise(
            F.array_append(acc, x)
        ),
    )


def strip_tags(c: Column) -> Column:
    """Inline HTML to text: line breaks become dashes, tags vanish, two entities are decoded."""
    text = F.regexp_replace(c, r"(?i)<br\s*/?>", " - ")
    text = F.regexp_replace(text, "<[^>]*>", "")
    text = F.regexp_replace(F.regexp_replace(text, "&nbsp;", " "), "&amp;", "&")
    return full_trim(F.regexp_replace(text, r"\s*-\s*", " - "))


def local_year_month(ts: Column, tz: str = "America/New_York") -> Column:
    """First day of the month of an instant, seen in a named time zone."""
    return F.trunc(F.from_utc_timestamp(ts, tz), "month")


def in_local_month(ts: Column, year: int, month: int, tz: str = "America/New_York") -> Column:
    return F.coalesce(local_year_month(ts, tz) == F.make_date(F.lit(year), F.lit(month), F.lit(1)), F.lit(False))
