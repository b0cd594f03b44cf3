"""Text column functions (JVM-side, codegen-friendly; no Python UDFs)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from relevo.functions.fixed import ELISION_ARTICLES, QUERY_METACHARACTERS

# Word tokens: maximal runs of letters/digits (an approximation of UAX#29
# word breaking; "don't" gives "don", "t").
WORD_SPLIT = r"[^\p{L}\p{N}]+"
# Python's str.split() separators; the corpora only contain ASCII whitespace.
WHITESPACE = r"\s+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_tokens(text) -> Column:
    """Lower-cased word tokens of ``text`` as ``array<string>`` (A1)."""
    return F.filter(F.split(F.lower(_c(text)), WORD_SPLIT), lambda t: t != F.lit(""))


def whitespace_tokens(text) -> Column:
    """Whitespace-separated tokens, case kept (A6); empty strings dropped."""
    return F.filter(F.split(_c(text), WHITESPACE), lambda t: t != F.lit(""))


def keyword_token(text) -> Column:
    """The whole value as one lower-cased token."""
    return F.lower(_c(text))


def first_words(text, n: int = 8) -> Column:
    """``" ".join(text.split()[:n])`` (F-9)."""
    return F.array_join(F.slice(whitespace_tokens(text), 1, n), " ")


def strip_tags(text) -> Column:
    """Remove ``<...>`` spans, non-greedy, not crossing newlines (F-10)."""
    return F.regexp_replace(_c(text), r"<.*?>", "")


def escape_query(text) -> Column:
    """Backslash-escape query metacharacters (F-11)."""
    marks = "".join("\\" + c for c in QUERY_METACHARACTERS.split())
    return F.regexp_replace(_c(text), f"([{marks}])", r"\\$1")


def has_any_keyword(body, keywords) -> Column:
    """True when the lower-cased body contains any keyword as a substring (P5).

    NULL body counts as empty text, so it never matches.
    """
    text = F.lower(F.coalesce(_c(body), F.lit("")))
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w.lower())) for w in keywords])


def strip_ws(text) -> Column:
    """Python ``str.strip()`` for ASCII whitespace."""
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def preview(text, n: int, flatten: bool = True, always_ellipsis: bool = False) -> Column:
    """Display preview.

    ``flatten``: first ``n`` characters, newlines to spaces, stripped, ``...``
    appended when the text is longer than ``n``. ``always_ellipsis`` appends
    ``...`` unconditionally (console form).
    """
    t = F.coalesce(_c(text), F.lit(""))
    head = F.substring(t, 1, n)
    if flatten:
        head = strip_ws(F.replace(head, F.lit("\n"), F.lit(" ")))
    if always_ellipsis:
        return F.concat(head, F.lit("..."))
    return F.when(F.length(t) > n, F.concat(head, F.lit("..."))).otherwise(head)


def first_value(values) -> Column:
    """First element of a multi-valued field, else empty string."""
    return F.coalesce(F.try_element_at(_c(values), F.lit(1)), F.lit(""))


def strip_elision(text, lang: str = "fr") -> Column:
    """Strip elided articles such as ``l'`` or ``qu'`` at word starts (A4)."""
    return F.regexp_replace(_c(text), elision_pattern(lang), "$1")


def elision_pattern(lang: str = "fr") -> str:
    """Regex (Java and RE2 compatible) whose group 1 is the kept separator."""
    arts = sorted(ELISION_ARTICLES[lang], key=len, reverse=True)
    return r"(?i)(^|[^\p{L}\p{N}])(" + "|".join(arts) + r")['’]"


def strip_possessive(text) -> Column:
    """Drop a trailing English possessive ``'s`` from words (A5)."""
    return F.regexp_replace(_c(text), POSSESSIVE_PATTERN, "$1")


POSSESSIVE_PATTERN = r"(?i)['’]s([^\p{L}\p{N}]|$)"
