"""Person names, positions and school names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlens.functions.text import full_trim

# Words that show a text is a position and not a person's name.
POSITION_WORDS = [
    "coach", "head", "assistant", "director", "manager", "coordinator", "trainer", "analyst", "specialist",
    "consultant", "officer", "administrator", "advisor", "counselor", "professor", "instructor", "teacher",
    "staff", "associate", "senior", "junior", "volunteer", "intern", "graduate", "fellow", "resident",
]
# Linking words that occur in positions only.
LINKING_WORDS = ["of", "for", "and", "&", "in", "to"]
# Host endings dropped from a school name.
HOST_ENDINGS = ["edu", "com", "org", "net", "gov", "us", "uk"]
# Texts written where a value is missing.
UNKNOWN_SCHOOL = "Unknown School"
GENERAL_CONTACT = "(General Contact)"
POSITION_CLEARED = "(Position removed/cleared)"


def first_name(full: Column) -> Column:
    return F.substring_index(full_trim(F.coalesce(full, F.lit(""))), " ", 1)


def last_name(full: Column) -> Column:
    """Everything after the first single space."""
    text = full_trim(F.coalesce(full, F.lit("")))
    gap = F.instr(text, " ")
    return F.when(gap > 0, F.substr(text, gap + 1)).otherwise(F.lit(""))


def strip_honorific(c: Column) -> Column:
    return full_trim(F.regexp_replace(c, r"(?i)^(Mr\.|Ms\.|Mrs\.|Dr\.)\s*", ""))


def _capitalise(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))


def school_from_url(base_url: Column) -> Column:
    """Readable school name from the host; text surgery where the URL has no scheme."""
    host = F.lower(F.regexp_extract(base_url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    bare = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), rf"(?i)\.({'|'.join(HOST_ENDINGS)})$", "")
    words = F.array_join(F.transform(F.split(bare, r"\."), _capitalise), " ")
    named = F.lower(words).contains("university") | F.lower(words).contains("college")
    from_host = F.when(named, words).otherwise(F.concat(words, F.lit(" University")))

    domain = F.substring_index(F.regexp_replace(base_url, r"^(https?://)?(www\.)?", ""), "/", 1)
    spaced = F.regexp_replace(domain, r"^([^.]*)\.", "$1 ")
    pieces = F.regexp_extract_all(spaced, F.lit(r"(\w+|\W+)"), F.lit(1))
    from_text = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\w"), _capitalise(p)).otherwise(p)), "")
    return (
        F.when(F.coalesce(base_url, F.lit("")) == "", F.lit(UNKNOWN_SCHOOL))
        .when(host != "", from_host)
        .otherwise(from_text)
    )


def slug(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]", "-"))


def is_name_like(text: Column, person: Column) -> Column:
    """Does a title look like a person's name? A position word always says no."""
    low = F.lower(text)
    has_position = low.rlike("|".join(POSITION_WORDS))
    linked = low.rlike(f" ({'|'.join(LINKING_WORDS)}) ")
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit(False))
        .when(has_position, F.lit(False))
        .when((F.coalesce(person, F.lit("")) != "") & (text == person), F.lit(True))
        .when(~text.contains(" ") & (F.length(text) < 30), F.lit(True))
        .otherwise(text.rlike(r"^[A-Z][a-z]+(?:\s[A-Z][a-z]+)*$") & ~linked)
    )


def full_export_position(raw_title: Column, title: Column) -> Column:
    return F.coalesce(F.nullif(raw_title, F.lit("")), F.nullif(title, F.lit("")), F.lit(GENERAL_CONTACT))


def school_export_position(raw_title: Column, title: Column, person: Column) -> Column:
    """First of the two titles that is set and does not look like a name."""

    def usable(t: Column) -> Column:
        return (F.coalesce(t, F.lit("")) != "") & ~is_name_like(t, person)

    return F.when(usable(raw_title), raw_title).when(usable(title), title).otherwise(F.lit(""))


def change_position(title: Column, person: Column, code: Column) -> Column:
    """Position of a change row: always shown for job changes, else blank when it says nothing."""
    pos, who = F.coalesce(title, F.lit("")), F.coalesce(person, F.lit(""))
    at = F.position(who, pos)
    rest = full_trim(F.concat(F.substr(pos, F.lit(1), at - 1), F.substr(pos, at + F.length(who))))
    return (
        F.when(F.coalesce(code, F.lit("")).contains("j"), F.when(pos == "", F.lit(POSITION_CLEARED)).otherwise(pos))
        .when(full_trim(pos) == "", F.lit(""))
        .when((F.lower(pos) == "coach") & (who != ""), F.lit(""))
        .when((who != "") & (at > 0) & (rest == ""), F.lit(""))
        .otherwise(pos)
    )
