"""Emails, phones and names found in free text or in links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rosterlens.functions.text import blank_to_null, full_trim

# Patterns for contact details.
EMAIL_PATTERN = r"[\w._%+-]+@[\w.-]+\.[A-Za-z]{2,}"
PHONE_PATTERN = r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}"
PHONE_START_PATTERN = r"\d{3}[-.\s]?\d{3}"
TWO_WORD_NAME_PATTERN = r"[A-Z][a-z]+ [A-Z][a-z]+"
LEADING_NAME_PATTERN = r"^([A-Z][a-z]+ [A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"
EXTENSION_PATTERN = r"Ext\.\s*(\d+)"
PHONE_LABEL_PATTERN = r"(?i)phone:\s*([0-9().\-\s+]*\d)"
# Texts that stand for "no value" in directory tables.
PLACEHOLDERS = ["- Vacant -", "--", "&nbsp;", ""]
# Phrases of challenge or block pages, compared in lower case.
CHALLENGE_PHRASES = [
    "cloudflare", "cf-ray", "__cfuid", "ddos-guard", "security check", "please stand by",
    "verifying you are human", "checking your browser", "jschl_vc", "jschl_answer", "captcha-bypass",
    "ray id", "just a moment",
]


def find_email(text: Column) -> Column:
    # The plain test is far cheaper than the pattern, and most long texts have no address.
    return F.when(F.contains(text, F.lit("@")), blank_to_null(F.regexp_extract(text, f"({EMAIL_PATTERN})", 1)))


def find_phone(text: Column) -> Column:
    return blank_to_null(F.regexp_extract(text, f"({PHONE_PATTERN})", 1))


def find_labelled_phone(text: Column) -> Column:
    return blank_to_null(full_trim(F.regexp_extract(text, PHONE_LABEL_PATTERN, 1)))


def leading_name(text: Column) -> Column:
    return blank_to_null(full_trim(F.regexp_extract(text, LEADING_NAME_PATTERN, 1)))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _group(d: Column, *cuts: tuple[int, int]) -> list[Column]:
    return [F.substring(d, start, size) for start, size in cuts]


def dashed_phone(c: Column) -> Column:
    """Ten digits as NNN-NNN-NNNN, anything else as its bare digits."""
    d = digits(c)
    return F.when(F.length(d) == 10, F.concat_ws("-", *_group(d, (1, 3), (4, 3), (7, 4)))).otherwise(blank_to_null(d))


def plus_dashed_phone(c: Column) -> Column:
    """Ten digits dashed, + and eleven digits dashed, anything else as it was."""
    d = F.regexp_replace(c, r"[^\d+]", "")
    return (
        F.when(d.rlike(r"^\d{10}$"), F.concat_ws("-", *_group(d, (1, 3), (4, 3), (7, 4))))
        .when(d.rlike(r"^\+\d{11}$"), F.concat_ws("-", *_group(d, (1, 2), (3, 3), (6, 3), (9, 99))))
        .otherwise(c)
    )


def bracketed_phone(c: Column) -> Column:
    """(NNN) NNN-NNNN, or +1 (NNN) NNN-NNNN for eleven digits that start with 1."""
    d = F.regexp_replace(c, r"[^\d+]", "")
    a, b, e = _group(d, (1, 3), (4, 3), (7, 99))
    a1, b1, e1 = _group(d, (2, 3), (5, 3), (8, 99))
    return (
        F.when((F.length(d) == 10) & ~d.startswith("+"), F.concat(F.lit("("), a, F.lit(") "), b, F.lit("-"), e))
        .when(
            (F.length(d) == 11) & d.startswith("1"), F.concat(F.lit("+1 ("), a1, F.lit(") "), b1, F.lit("-"), e1)
        )
        .otherwise(blank_to_null(c))
    )


def with_extension(phone: Column, text: Column) -> Column:
    ext = F.regexp_extract(text, EXTENSION_PATTERN, 1)
    return F.when(phone.isNotNull() & (F.coalesce(ext, F.lit("")) != ""), F.concat(phone, F.lit(" ext. "), ext)).otherwise(
        phone
    )


def title_between(text: Column, name: Column) -> Column:
    """What stands between the name and the first email or phone sign, without separators."""
    rest = full_trim(F.substr(text, F.length(name) + 1))
    at = F.nullif(F.instr(rest, "@"), F.lit(0))
    phone = F.nullif(F.regexp_instr(rest, F.lit(PHONE_START_PATTERN)), F.lit(0))
    stop = F.least(F.coalesce(at, F.length(rest) + 1), F.coalesce(phone, F.length(rest) + 1))
    cut = full_trim(F.substr(rest, F.lit(1), stop - 1))
    return blank_to_null(full_trim(F.regexp_replace(cut, r"^[,\-:\s]+|[,\-:\s]+$", "")))


def mailto_address(href: Column) -> Column:
    return blank_to_null(full_trim(F.regexp_extract(href, r"(?i)^mailto:([^?]*)", 1)))


def tel_number(href: Column) -> Column:
    return blank_to_null(full_trim(F.regexp_extract(href, r"(?i)^tel:([^?]*)", 1)))


def script_email(script: Column) -> Column:
    """Email assembled by an inline script: one variable, or two halves."""

    def variable(name: str) -> Column:
        return F.regexp_extract(script, rf"var {name} = ['\"]([^'\"]+)['\"]", 1)

    halves = F.when(
        (variable("firstHalf") != "") & (variable("secondHalf") != ""),
        F.concat(variable("firstHalf"), F.lit("@"), variable("secondHalf")),
    )
    return F.coalesce(blank_to_null(variable("full_email")), halves)


def drop_placeholder(c: Column) -> Column:
    text = full_trim(c)
    return F.when(~text.isin(PLACEHOLDERS), text)


def is_challenge_page(html: Column) -> Column:
    phrases = F.array(*[F.lit(p) for p in CHALLENGE_PHRASES])
    # The one-element array keeps the lowered text from being made anew for every phrase.
    low = F.array(F.lower(html))
    hits = F.transform(low, lambda t: F.exists(phrases, lambda p: F.contains(t, p)))
    return F.coalesce(F.try_element_at(hits, F.lit(1)), F.lit(False))
