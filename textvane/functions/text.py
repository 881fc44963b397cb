"""Column expressions over text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

# The letter class of the cleaning tokeniser (a to z, the range from "{" to
# "æ", "ø", "å"), the letters an edit may bring in, and the letters of dictionary words.
TOKEN_CLASS = "[a-z{-æøå]"
EDIT_LETTERS = "abcdefghijklmnopqrstuvwxyz-æøå"
WORD_CLASS = "[a-zæÆøØåÕÅ]"
FREQ_WORD_CLASS = "[a-zA-ZæÆøØåÕÅ]"
# Punctuation set apart by the bag-of-words tokeniser.
BOW_PUNCTUATION = r"([?!\";|\[\].,'])"


def words(text: Column, token_class: str = TOKEN_CLASS) -> Column:
    """Lower-cased runs of the token class, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({token_class}+)"), F.lit(1))


def bow_tokens(text: Column, stopwords: Iterable[str] = ()) -> Column:
    """Blank-separated tokens with punctuation set apart; an empty text gives one empty token."""
    spaced = F.trim(F.regexp_replace(text, BOW_PUNCTUATION, " $1 "))
    spaced = F.regexp_replace(spaced, r"^\s+|\s+$", "")
    tokens = F.split(spaced, r"\s+")
    stop = sorted(set(stopwords))
    if not stop:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(stop))


def snake_case(name: Column) -> Column:
    """announcementDate -> announcement_date."""
    return F.lower(F.regexp_replace(name, r"(?<!^)([A-Z\d])", "_$1"))


def strip_prefix(text: Column, prefix: str) -> Column:
    """`text` without the leading `prefix`, unchanged when it does not start with it."""
    return F.when(F.startswith(text, F.lit(prefix)), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text)


def normalise_path(path: Column) -> Column:
    """Collapse runs of slashes and drop one trailing slash; ;params and ?query stay as they are."""
    plain = F.regexp_replace(F.regexp_extract(path, r"^[^;?]*", 0), "/+", "/")
    return F.concat(F.regexp_replace(plain, "/$", ""), F.regexp_extract(path, r"^[^;?]*(.*)$", 1))


def url_path(url: Column) -> Column:
    """Everything of a URL after its authority and before its fragment."""
    return F.regexp_extract(url, r"^[a-z]+://[^/?#;]*([^#]*)", 1)


def path_stem(path: Column) -> Column:
    """Last part of a path, its last `_` part, up to the first dot."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.element_at(F.split(F.element_at(F.split(last, "_"), -1), r"\."), 1)


def date_millis(day: Column) -> Column:
    """UTC-midnight epoch milliseconds of a yyyy-MM-dd string, null when it is not a date."""
    return F.unix_millis(F.try_to_timestamp(F.concat(day, F.lit(" +0000")), F.lit("yyyy-MM-dd Z")))
