"""Text semantics as column expressions.

Spark's ``trim``, ``\\s`` and ``split`` only know ASCII whitespace. The study
counts, trims and splits on Unicode whitespace, so the set is spelled out once
here and used by every function below.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 whitespace code points, as characters and as a regex class body.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
WHITESPACE_CLASS = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# A sentence ends at these characters ...
SENTENCE_END = rf'[.!?]["”’)]*[{WHITESPACE_CLASS}]+'
# ... when one of these follows.
SENTENCE_START = r'[A-Z“"(\[]'

# Reasoning tags. The classes hold every character that matches the
# ASCII letter under Unicode case folding; Java's (?i) would miss three of them.
THINK_WORD = "[tT][hH][iI\u0130\u0131][nN][kK\u212a]"
THINK_OPEN = f"<{THINK_WORD}>"
THINK_CLOSE = f"</{THINK_WORD}>"


# The bytes above ASCII that some whitespace ends with in UTF-8: all up to the first, and the others.
_BLANK_ENDS = (0x8A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF)


def strip(c: Column) -> Column:
    """Trim Unicode whitespace at both ends.

    Trimming the end of a text lays out the places of all its characters. Its last byte mostly tells that
    there is nothing to trim. ``c`` is read more than once: give a column, not a costly expression.
    """
    return F.when(_ends_in_text(c), F.ltrim(c, F.lit(WHITESPACE))).otherwise(strip_once(c))


def strip_once(c: Column) -> Column:
    """``strip`` of an expression that must not be computed twice."""
    return F.trim(c, F.lit(WHITESPACE))


def _ends_in_text(c: Column) -> Column:
    """Whether the last byte already shows that no whitespace is at the end."""
    last = F.substring(c.cast("binary"), -1, 1)
    byte = [F.lit(bytes([b])) for b in _BLANK_ENDS]
    return ((last > F.lit(b" ")) & (last < F.lit(b"\x80"))) | ((last > byte[0]) & ~last.isin(*byte[1:]))


def normalize_newlines(c: Column) -> Column:
    """Universal newlines: CRLF and lone CR become LF. Literal replaces, no regex."""
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def clean(c: Column) -> Column:
    """A story's text as the rest of the library sees it."""
    return strip_once(normalize_newlines(c))


def word_count(c: Column) -> Column:
    """Number of whitespace-separated tokens.

    Mapping whitespace to a blank first lets ``split`` work on one literal
    character; a 29-member regex class costs about six times as much.
    """
    blanks = F.translate(c, WHITESPACE, " " * len(WHITESPACE))
    return F.size(F.array_remove(F.split(blanks, " "), ""))


def at_most_words(c: Column, limit: int) -> Column:
    """``word_count(c) <= limit`` without counting when the size already decides.

    n words need at least 2n-1 bytes, so up to 2*limit bytes can never exceed the
    limit. The byte length is stored with the value; only longer texts are counted.
    """
    return (F.octet_length(c) <= 2 * limit) | (word_count(c) <= limit)


def sentences(c: Column) -> Column:
    """Trimmed, non-empty sentences, in order, of an already cleaned text.

    Each match runs up to and including the next boundary; the last takes the rest.
    No marker character is inserted, so any text is safe.
    """
    piece = rf"(?s)(?:.*?{SENTENCE_END}(?={SENTENCE_START})|.+\z)"
    pieces = F.regexp_extract_all(c, F.lit(piece), F.lit(0))
    return F.array_remove(F.transform(pieces, strip), "")


def strip_reasoning(c: Column) -> Column:
    """Drop closed reasoning blocks, then all up to the first close tag left over.

    An unclosed block stays: there is no telling where the answer starts. Over many texts take
    ``without_blocks``, ``after_close`` and ``strip``, each over a column of the one before.
    """
    # Both patterns need a close tag; a byte search for its start spares most texts the regex.
    return F.when(_may_close(c), strip_once(_last_part(without_blocks(c)))).otherwise(strip(c))


def without_blocks(c: Column) -> Column:
    """The text without its closed reasoning blocks. Byte searches for the starts of both tags go first."""
    may_open = F.contains(c, F.lit("<t")) | F.contains(c, F.lit("<T"))
    return F.when(_may_close(c) & may_open, F.regexp_replace(c, f"(?s){THINK_OPEN}.*?{THINK_CLOSE}", "")).otherwise(c)


def after_close(c: Column) -> Column:
    """What follows the first close tag, or everything."""
    return F.when(_may_close(c), _last_part(c)).otherwise(c)


def _may_close(c: Column) -> Column:
    return F.contains(c, F.lit("</"))


def _last_part(c: Column) -> Column:
    """The last of at most two parts: what follows the first close tag, or everything."""
    return F.element_at(F.split(c, THINK_CLOSE, 2), -1)


def has_reasoning_tag(c: Column) -> Column:
    # A byte search for the start of a tag spares most texts the regex.
    return F.contains(c, F.lit("<")) & c.rlike(f"</?{THINK_WORD}>")


def is_blank(c: Column) -> Column:
    """``strip(c)`` is empty. Reading ends at the first character that is no whitespace."""
    return F.ltrim(c, F.lit(WHITESPACE)) == ""


def zero_fill(c: Column, width: int) -> Column:
    """Pad with zeros on the left up to a width, after a leading sign; never truncates."""
    signed = c.rlike(r"\A[+-]")
    sign = F.when(signed, F.substring(c, 1, 1)).otherwise("")
    digits = F.when(signed, F.substring(c, 2, 2**31 - 1)).otherwise(c)
    pad = F.greatest(F.lit(width) - F.length(c), F.lit(0))
    return F.concat(sign, F.repeat(F.lit("0"), pad), digits)
