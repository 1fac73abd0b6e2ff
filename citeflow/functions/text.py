"""Text expressions (F2-F12, F18-F20): Column -> Column, JVM side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: cleaning patterns that must equal the original's ----------
# Java's "." does not match line terminators other than "\n" unless (?d);
# with (?d) it matches like Python's "." (everything but "\n").
_FORMULA = r"(?d)\$.*?\$"
# the original's "[^A-Za-z0-9'\s]" to a space and then "\s+" to a space, in one pass: Java's search
# is some ten times slower with the ranges spelled out than with the (ASCII) class
_NOT_WORDISH = r"[^\p{Alnum}']+"
_URL = r"[a-zA-Z]+://[^\s]*[.com|.cn]"
# word of 2+ letters, digits or underscores (vectorizer default token)
TOKEN = r"([\p{L}\p{N}_]{2,})"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_all(x) -> Column:
    """Trim every kind of whitespace at both ends (Python ``str.strip``)."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def format_keyword(x) -> Column:
    """'-' -> ' ', trim, lower - in that order."""
    return F.lower(strip_all(F.regexp_replace(_c(x), "-", " ")))


def paper_text(title, abstract) -> Column:
    """title and abstract joined with no separator; nulls skipped."""
    return F.concat(F.coalesce(_c(title), F.lit("")), F.coalesce(_c(abstract), F.lit("")))


def lsa_text(title, abstract) -> Column:
    """title, a '.' unless it already ends with one, then the abstract."""
    t = F.coalesce(_c(title), F.lit(""))
    t = F.when(t.endswith("."), t).otherwise(F.concat(t, F.lit(".")))
    return F.concat(t, F.coalesce(_c(abstract), F.lit("")))


def tfidf_text(title, abstract, keywords) -> Column:
    """space-joined title, abstract and keywords (absent parts skipped)."""
    kw = F.when(_c(keywords).isNotNull(), F.array_join(_c(keywords), " "))
    return F.concat_ws(" ", _c(title), _c(abstract), kw)


def clean_text(x, remove_urls: bool = False) -> Column:
    """F6 + F7 (+ F8 when asked): formulas out, odd characters to spaces, spaces collapsed.

    In the original order the URL pattern runs after ':' and '/' are already
    gone and never matches (D7); ``remove_urls=True`` runs it first instead.
    """
    t = F.regexp_replace(_c(x), _FORMULA, "")
    if remove_urls:
        t = F.regexp_replace(t, _URL, "")
    return F.regexp_replace(t, _NOT_WORDISH, " ")


def filter_tokens(x, stopwords: list[str]) -> Column:
    """lower-case tokens; drop all-digit, length <= 2 and stop words; rejoin."""
    stop = F.array(*[F.lit(w) for w in stopwords])
    toks = F.split(F.lower(_c(x)), " ")
    keep = F.filter(toks, lambda w: (F.length(w) > 2)
                    & ~w.rlike(r"^[0-9]+$")
                    & ~F.array_contains(stop, w))
    return F.array_join(keep, " ")


def tokens(x) -> Column:
    """vectorizer tokens, lower-cased words of 2+ word characters."""
    return F.regexp_extract_all(F.lower(_c(x)), F.lit(TOKEN), 1)


def day_tag(d) -> Column:
    """day tag 'yyyy_MM_dd'."""
    return F.date_format(_c(d), "yyyy_MM_dd")


def text_to_epoch(x) -> Column:
    """'yyyy-MM-dd HH:mm:ss' text -> unix seconds (session zone), null if malformed."""
    return F.unix_timestamp(F.try_to_timestamp(_c(x), F.lit("yyyy-MM-dd HH:mm:ss")))


def topic_or_unknown(x) -> Column:
    """a topic that cannot be encoded (null or blank) becomes 'unknown'."""
    c = _c(x)
    return F.when(c.isNull() | (F.trim(c) == ""), F.lit("unknown")).otherwise(c)
