"""Line-first cleaning: judge lines, remove failures, then reject documents that lost too much.

Column expressions only. Words are runs of ``[^\\x20\\x09-\\x0D]``; a null text counts as empty.

Line rules (a line without a word is neither kept nor counted as lost):

* navigation: separators such as ``|`` or ``»`` make up a fifth of its characters or there is one
  for every three words, or other symbols make up a tenth, or exclamation marks a twentieth;
* boilerplate: a short line that holds a fixed phrase (licence, rights, cookies, ...);
* punctuation: a line of fewer than ``MIN_OPEN_WORDS`` words that does not end like a sentence.

A document is kept if it passes the base rules and at least ``MIN_KEPT_SHARE`` of the
characters in its lines survive. Repeated rows are judged alike, empty tables give no rows,
further columns are carried untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Fixed values of the line rules.
SEPARATORS = "|•·»«›‹¦"
NOISE = "#*$%&<>~^=_{}\\"
SENTENCE_ENDS = ".!?…:;。！？：；\"”’'»)]"
BOILERPLATE = [
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "licensed under",
    "powered by",
    "privacy policy",
    "read more",
    "sign up for",
    "subscribe to",
    "terms of service",
    "terms of use",
]
MIN_OPEN_WORDS = 8
BOILERPLATE_CHARS = 300
MIN_KEPT_SHARE = 0.5


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, f"[{SPACES}]+")
    )


def _class(characters: str, negated: bool = False) -> str:
    """A regular expression for one character (not) in the set."""
    return ("[^" if negated else "[") + "".join(f"\\x{{{ord(c):x}}}" for c in characters) + "]"


def n_of(text: Column, characters: str) -> Column:
    """How many characters of the text are in the set."""
    return F.char_length(F.regexp_replace(text, _class(characters, negated=True) + "+", ""))


def _covered(hits: Column) -> Column:
    """Words covered by windows that start at the ascending positions ``hits``."""
    steps = F.transform(
        hits,
        lambda p, i: F.when(i + 1 < F.size(hits), F.least(F.lit(WINDOW), F.get(hits, i + 1) - p))
        .otherwise(F.lit(WINDOW)),
    )
    return F.aggregate(steps, F.lit(0), lambda total, x: total + x)


def repeated_words(words: Column) -> Column:
    """Words inside windows of eight that occur at least twice in the text.

    Windows are compared by 64-bit hash. Only a text whose window hashes repeat pays for the
    sort that brings equal windows together.
    """

    def positions(hashes: Column) -> Column:
        tagged = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return bind(
            tagged,
            lambda t: F.array_sort(
                F.transform(
                    F.filter(
                        F.transform(
                            t,
                            lambda x, i: F.struct(
                                x["p"].alias("p"),
                                (
                                    F.coalesce(F.get(t, i - 1)["h"] == x["h"], F.lit(False))
                                    | F.coalesce(F.get(t, i + 1)["h"] == x["h"], F.lit(False))
                                ).alias("twin"),
                            ),
                        ),
                        lambda x: x["twin"],
                    ),
                    lambda x: x["p"],
                )
            ),
        )

    def pairs(h: Column, gap: int) -> Column:
        return F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + gap)))

    def windows(h: Column) -> Column:  # pairs of pairs of pairs: eight words; the last seven are cut off
        eights = bind(bind(pairs(h, 1), lambda two: pairs(two, 2)), lambda four: pairs(four, 4))
        return F.slice(eights, F.lit(1), F.size(h) - (WINDOW - 1))

    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(
        bind(
            bind(F.transform(words, lambda w: F.xxhash64(w)), windows),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
                bind(positions(h), _covered)
            ),
        )
    )


def line_passes(line: Column) -> Column:
    trimmed = F.btrim(line, F.lit(SPACES))
    size = F.char_length(line)
    bars = n_of(line, SEPARATORS)
    marked = line.rlike(_class(SEPARATORS + NOISE + "!"))  # most lines have none of these
    navigation = marked & (
        (bars * 5 > size)
        | ((bars > 0) & (bars * 3 > F.size(words_of(line))))
        | (n_of(line, NOISE) * 10 > size)
        | (n_of(line, "!") * 20 > size)
    )


    def phrased(lower: Column) -> Column:
        found = F.lit(False)
        for phrase in BOILERPLATE:
            found = found | F.contains(lower, F.lit(phrase))
        return found

    boilerplate = (size <= BOILERPLATE_CHARS) & bind(F.lower(line), phrased)
    closed = F.contains(F.lit(SENTENCE_ENDS), F.right(trimmed, F.lit(1)))
    open_short = ~closed & (F.size(words_of(line)) < MIN_OPEN_WORDS)
    return ~(navigation | boilerplate | open_short)


def assess(text: Column) -> Column:
    """All measures, the cleaned text and the verdict of one text as a struct."""
    whole = F.coalesce(text, F.lit(""))
    by_words = bind(
        words_of(whole),
        lambda w: F.struct(
            F.size(w).alias("n"),
            F.char_length(F.array_join(w, "")).alias("chars"),
            repeated_words(w).alias("repeat"),
        ),
    )
    worded = F.filter(F.split(whole, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    by_lines = bind(
        worded,
        lambda lines: F.struct(
            (F.size(lines) - F.size(F.array_distinct(lines))).alias("dup"),
            F.char_length(F.array_join(lines, "")).alias("chars"),
            F.array_join(F.filter(lines, line_passes), "\n").alias("clean"),
        ),
    )

    def verdict(w: Column, v: Column) -> Column:
        failed = (w["n"] < MIN_WORDS) | (w["repeat"] * 100 > w["n"] * MAX_REPEAT_PERCENT)
        kept_chars = F.char_length(F.replace(v["clean"], F.lit("\n"), F.lit("")))
        enough = kept_chars >= v["chars"] * F.lit(MIN_KEPT_SHARE)
        return F.struct(
            w["n"].cast("long").alias("n_words"),
            w["chars"].cast("long").alias("word_chars"),
            n_of(whole, SYMBOLS).cast("long").alias("n_symbols"),
            v["dup"].cast("long").alias("n_dup_lines"),
            w["repeat"].cast("long").alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & enough).alias("kept"),
            v["clean"].alias("clean"),
        )

    return bind(by_words, lambda w: bind(by_lines, lambda v: verdict(w, v)))


MEASURES = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "base_failed",
    "kept",
]


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measures, one row per input row."""
    judged = docs.select("doc_id", F.explode(F.array(assess(F.col("text")))).alias("_q"))
    return judged.select("doc_id", *[F.col("_q")[m].alias(m) for m in MEASURES])


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents with their failed lines removed; same columns, ``n_chars`` follows."""
    packed = docs.select(F.struct("*").alias("_doc"))
    judged = packed.select("_doc", F.explode(F.array(assess(F.col("_doc")["text"]))).alias("_q"))
    kept = judged.filter(F.col("_q")["kept"])
    new = {"text": F.col("_q")["clean"]}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length(F.col("_q")["clean"]).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns])
