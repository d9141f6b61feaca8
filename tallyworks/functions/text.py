"""Names, notes, patterns and display strings as column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words of a company's legal form.
LEGAL_TOKENS = ["inc", "incorporated", "llc", "llp", "lp", "plc", "ltd", "limited", "corp", "corporation", "co", "company", "companies", "gmbh", "sarl", "srl", "spa", "nv", "bv", "pty", "pte"]
# Legal forms a display name loses at its end.
_SUFFIX = r"(?i)(?:[\s,]+(?:inc|incorporated|llc|l\.l\.c|llp|lp|plc|ltd|limited|corp|corporation|co|company|gmbh|pty|pte|nv|bv)\.?\s*,*\s*)+$"
# Patterns of announcement prose.
AWARD = r"(?i)\b(?:is|was|are|were|has been|have been)\s+(?:being\s+)?award"
NAME = r"^([A-Z0-9][^,;]{2,90}?)\s*(?:,\s*\*\s+|\*\s*,?\s+|,\s+)(?=[A-Z])"
PLAIN_NAME = r"^([A-Z0-9][^,;]{2,90}?)\s*,\s+[A-Z]"
STAR = r"^[^,;]{2,90},?\*"
DOLLARS = r"(?i)\$([\d,]+(?:\.\d+)?)\s*(billion|million)?"
BRANCH_LINE = r"^(ARMY|NAVY|AIR FORCE|DEFENSE LOGISTICS AGENCY|SPACE FORCE|MARINE CORPS|DEFENSE|MISSILE DEFENSE AGENCY)\s*$"
MODIFICATION = r"(?i)\bmodification\b"
MOD_NUMBER = r"\b(P\d{5})\b"
OPTION = r"(?i)\boption\b"
IDIQ = r"(?i)indefinite-delivery/indefinite-quantity|indefinite delivery"
MULTI = r"(?i)multiple-award|multiple award|will compete for"
BIDS = r"(?i)(\d+)\s+(?:offers|bids|proposals)\s+(?:were|was)\s+received"


def clean(c: Column) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(F.trim(c), F.lit(""))


#: Characters whose case-blind form isn't their lower case (sharp s, ligatures, final sigma and the like).
_FOLDS = {chr(k): chr(k).casefold() for k in range(128, 0x10000) if not 0xD800 <= k < 0xE000 and chr(k).casefold() != chr(k).lower()}


def casefold(c: Column) -> Column:
    """The form in which texts are compared without regard to case. ASCII texts, nearly all, are lower-cased alone."""
    low = F.lower(c)
    folds = F.create_map(*[F.lit(x) for pair in _FOLDS.items() for x in pair])
    each = F.transform(F.split(low, ""), lambda ch: F.coalesce(F.try_element_at(folds, ch), ch))
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.array_join(each, "")).otherwise(low)


def normalize_name(raw: Column) -> Column:
    """The key names are compared by: lower case, "&" as and, no marks, no leading "the", no legal forms unless nothing else is left."""
    s = casefold(F.replace(F.coalesce(raw, F.lit("")), F.lit("*"), F.lit(" ")))
    s = F.replace(F.replace(s, F.lit("&"), F.lit(" and ")), F.lit("."), F.lit(""))
    s = F.regexp_replace(F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")), r"^(?:the(?: |$))+", "")
    tokens = F.filter(F.split(s, " "), lambda t: t != "")
    rest = F.filter(tokens, lambda t: ~t.isin(LEGAL_TOKENS))
    return F.array_join(F.when(F.size(rest) > 0, rest).otherwise(tokens), " ")


def display_name(raw: Column) -> Column:
    """The printed name less star, leading "The" and legal forms at the end."""
    s = F.trim(F.regexp_replace(F.trim(F.replace(F.coalesce(raw, F.lit("")), F.lit("*"), F.lit(" "))), ",+$", ""))
    s = F.regexp_replace(s, r"^[Tt]he\s+", "")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, _SUFFIX, ""), r"[,\s]+$", ""))
    return F.coalesce(F.nullif(s, F.lit("")), F.trim(raw))


def is_joint_venture(raw: Column) -> Column:
    return raw.rlike(r"(?i)\b(?:jv|joint\s+ventures?)\b")


def join_notes(existing: Column, addition: Column) -> Column:
    return F.concat_ws("; ", clean(existing), clean(addition))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 3)), F.lit("..."))).otherwise(c)


def tags(c: Column, most: int = 6, width: int = 60) -> Column:
    """At most ``most`` trimmed tags of at most ``width`` characters, blanks dropped."""
    return F.slice(F.filter(F.transform(c, lambda t: F.substring(F.trim(t), 1, width)), lambda t: t != ""), 1, most)


def fact_line(*pieces: Column) -> Column:
    return F.concat_ws(" | ", *pieces)


def numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def text_or_dash(c: Column, dash: str = "—") -> Column:
    return F.coalesce(clean(c), F.lit(dash))


def company_or_raw(parent: Column, raw: Column) -> Column:
    return F.coalesce(clean(parent), raw)


def event_kind(creating: Column, action: Column) -> Column:
    return F.when(F.coalesce(creating, F.lit(False)), "Contract created").when(action == "modification", "Modification").when(action == "option_exercise", "Option exercised").when(action == "multi_award_pool", "Pool award").otherwise("Order placed")


def place(city: Column, state: Column) -> Column:
    return F.concat_ws(", ", clean(city), clean(state))


def tier_text(tier: Column) -> Column:
    return F.coalesce(F.upper(clean(tier)), F.lit("—"))


def cell_text(c: Column) -> Column:
    """A ticker or contract number as a cell shows it, a link's text: blank without one, or where a dash stands for none."""
    return F.coalesce(F.nullif(clean(c), F.lit("—")), F.lit(""))


def competition_text(solicited: Column, received: Column) -> Column:
    """Bids asked for and received, as far as known; a single one received is a sole source."""
    number = lambda c: F.when(c.isNotNull(), F.format_string("%,d", c))  # noqa: E731  it prints nulls as text
    said = F.concat_ws(", ", F.concat(number(solicited), F.lit(" solicited")), F.concat(number(received), F.lit(" received")))
    return F.concat(said, F.when(received == 1, "  ·  sole source").otherwise(""))


def performance_text(where: Column, until: Column) -> Column:
    """Place of performance and the printed day it ends, as far as known."""
    return F.concat_ws("  ·  ", clean(where), F.concat(F.lit("through "), clean(until)))


def first_word(c: Column) -> Column:
    return F.lower(F.split_part(F.trim(c), F.lit(" "), F.lit(1)))


#: Shapes of secrets and what stands in their place.
SECRETS = [(r"sk-[A-Za-z0-9_-]{20,}", "sk-REDACTED"), (r"(?i)(api_key\s*[=:]\s*)[^\s\"']+", "$1REDACTED"), (r"(?i)(authorization\s*[=:]\s*bearer\s+)[^\s\"']+", "$1REDACTED"), (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "MAIL"), (r"\b[0-9a-f]{40}\b", "HEX")]


def scrub(c: Column) -> Column:
    for pattern, label in SECRETS:
        c = F.regexp_replace(c, pattern, label)
    return c


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Character references decoded; Spark has no function for it."""
    return s.map(html.unescape, na_action="ignore")


def page_references(s: Column) -> Column:
    """The references that the SQL of ``html_prose`` decodes, and no others: three that end as they should, then an ampersand, cut or not."""
    for name, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):
        s = F.replace(s, F.lit(name), F.lit(char))
    return F.regexp_replace(s, "&amp;?", "&")


def title_date(title: Column) -> Column:
    """Date in a title such as "Contracts for Aug. 31, 2026"; null if there is none."""
    pattern = r"([A-Za-z]{3})[a-z]*\.?\s+(\d{1,2}),\s+(\d{4})"
    months = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
    month = F.array_position(F.array(*map(F.lit, months)), F.lower(F.regexp_extract(title, pattern, 1)))
    text = F.format_string("%s-%02d-%02d", F.regexp_extract(title, pattern, 3), month, F.regexp_extract(title, pattern, 2).try_cast("int"))
    return F.when(month > 0, text.try_cast("date"))


def fragments(quote: Column) -> Column:
    """Parts of a quote around "...", white space collapsed, blanks dropped."""
    parts = F.transform(F.split(quote, r"\.\.\."), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")))
    return F.filter(parts, lambda p: p != "")


def quoted_in(quote: Column, body: Column) -> Column:
    flat = F.regexp_replace(body, r"\s+", " ")
    return F.forall(fragments(quote), lambda p: flat.contains(p))
