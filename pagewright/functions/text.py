"""Text functions: NUL removal, whitespace squashing, token truncation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The 29 code points Python's str.split() treats as whitespace
# (Unicode White_Space plus the separators U+001C..U+001F), as one regex
# class.  The \x{...} spelling is accepted by both Java regex and RE2.
WHITESPACE_RUN = (
    r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
# A word is a run of letters and digits; the text between
# words is a run of everything else.  Together they tile a string.
WORD_RUN = r"[\p{L}\p{N}]+"
TOKEN_RUNS = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"
NON_WORD_RUN = r"[^\p{L}\p{N}]+"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip_nul(col) -> Column:
    """Remove every NUL character (the page store rejects them)."""
    return F.translate(_c(col), "\u0000", "")


def squash_ws(col) -> Column:
    """Equal to Python's ``" ".join(s.split())``: runs of whitespace become one
    space and the ends are trimmed."""
    return F.trim(F.regexp_replace(_c(col), WHITESPACE_RUN, " "))


def truncate_tokens(col, n: int) -> Column:
    """Keep the first ``n`` whitespace tokens of the squashed text.

    The production model counts BPE tokens; without the rank file offline
    this counts whitespace tokens, so one token here is one or more BPE
    tokens and the limit keeps at least as much text as the model would.
    """
    words = F.split(squash_ws(col), " ")
    return F.array_join(F.slice(words, 1, n), " ")


def non_empty(col) -> Column:
    """``length(contents) > 0``; a blank page still passes, as in the model."""
    return F.length(_c(col)) > 0


def words(col) -> Column:
    """Lower-cased words (runs of letters and digits) of a text, in order.
    Splitting on the gaps is cheaper than extracting the runs."""
    return F.filter(F.split(F.lower(_c(col)), NON_WORD_RUN), lambda w: w != "")
