"""Groups of spelling variants: words one edit apart, found by pivotal grams.

A run of letters (A-Z, a-z, U+00C0 to U+00FF) counts for the word it spells once A-Z are
lower-cased and, in one of ``TYPO_EVERY`` cases told by a hash of document and run, a character
is deleted. Words have at least ``min_length`` characters and ``min_count`` occurrences.

All words' bigrams are ordered from rare to frequent. The prefix of a word is its three rarest
bigrams, with all that are as rare as the third; its pivots are two bigrams of these three that
do not overlap, chosen by dynamic programming along the word so that they are rarest together.
One edit can spoil one pivot only, so of two words one edit apart, the pivots of the one whose
prefix ends first meet the prefix of the other, in a place at most one further on or back.

Pivots are therefore indexed and prefixes look them up. Position limits make the lookup narrow:
the edit lies on one side of the common bigram, so the text on the other side is common too, at
the same distance from its end of the word; and of the side with the edit, split in the middle of
the indexed word's side, one part is common. What is looked up is a hash of lengths, place and
common text; every pair found is then verified by the edit distance.

How it is spread: runs are counted in the tasks and added up by word; the index and the lookups
are joined by their hash, so the pairs that are formed are nearly those that are near, however
many words share a bigram. The table of bigrams has at most 8,100 rows (90 letters) and is
broadcast. Roots follow forms by doubling steps; a form is ``ratio`` times more frequent than its
word, so a few steps reach every root.

Defined results: a null text has no runs; rows with equal ids, or equal rows, count each;
a null id is written as an empty string in the hash; an empty table gives no words; other columns
are not read.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from continuum.llm.store import stored
from continuum.llm.words import GOLDEN, mix, multiple
from continuum.sources.shared import cut_lineage

MIN_LENGTH = 6
MIN_COUNT = 5
RATIO = 5
TYPO_EVERY = 199
PREFIX = 3  # two letters per edit, and one more
MOST_WORDS = 400_000  # words that a task counts before it hands them on
MOST_RUNS = 2_000_000  # runs of a batch that are numbered together
#: Latin-1 bytes: letters to themselves, A-Z lower-cased, all else to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


@cache
def _zeros(n: int) -> np.ndarray:
    """Four tables: what ``n`` further zero bytes make of each byte of a CRC-32 register."""
    if n == 0:
        return np.arange(256, dtype=np.uint64) << (np.arange(4, dtype=np.uint64) * np.uint64(8))[:, None]
    # The register after n bytes is affine in the register before; the constant cancels.
    zero = zlib.crc32(bytes(n), 0)
    bits = np.array([zlib.crc32(bytes(n), 1 << b) ^ zero for b in range(32)], np.uint64)
    table = np.zeros((4, 256), np.uint64)
    for byte in range(4):
        for bit in range(8):
            has = (np.arange(256) >> bit) & 1 == 1
            table[byte, has] ^= bits[8 * byte + bit]
    return table


def joined_crc(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings in a row, from theirs and the second one's length in bytes."""
    result = second.copy()
    for n in np.unique(size).tolist():
        at = np.flatnonzero(size == n)
        table = _zeros(n)
        for byte in range(4):
            result[at] ^= table[byte][(first[at] >> np.uint64(8 * byte)) & np.uint64(255)]
    return result


class Runs(dict):
    """Run (Latin-1) to its number; keeps the CRC-32 and size of its UTF-8 form."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []
        self.crc: list[int] = []
        self.size: list[int] = []

    def __missing__(self, run: bytes) -> int:
        self[run] = number = len(self.words)
        text = run if run.isascii() else run.decode("latin-1").encode()
        self.words.append(run)
        self.crc.append(zlib.crc32(text))
        self.size.append(len(text))
        return number


def _spelled(keys: list[str], texts: list[str]) -> dict[bytes, int]:
    """Occurrences of each word (Latin-1) in some documents."""
    runs = Runs()
    ids, sizes = [], []
    for text in texts:
        found = text.encode("latin-1", "replace").translate(_FOLD).split()
        ids.append(np.fromiter(map(runs.__getitem__, found), np.int64, len(found)))
        sizes.append(len(found))
    if not runs:
        return {}
    n = len(runs.words)
    code, times = np.unique(np.repeat(np.arange(len(texts)), sizes) * n + np.concatenate(ids), return_counts=True)
    doc, run = code // n, code % n
    starts = np.array([zlib.crc32(f"{key}:".encode()) for key in keys], np.uint64)
    h = joined_crc(starts[doc], np.array(runs.crc, np.uint64)[run], np.array(runs.size)[run])
    odd = h % np.uint64(TYPO_EVERY) == 0
    counts = np.bincount(run[~odd], times[~odd], n).astype(np.int64).tolist()
    result = {w: c for w, c in zip(runs.words, counts, strict=True) if c}
    for r, value, c in zip(run[odd].tolist(), h[odd].tolist(), times[odd].tolist(), strict=True):
        word = runs.words[r]
        at = value % len(word)
        word = word[:at] + word[at + 1 :]
        result[word] = result.get(word, 0) + c
    return result


def _count(min_length: int):
    def frame(total: dict[bytes, int]) -> pd.DataFrame:
        rows = [(w.decode("latin-1"), c) for w, c in total.items()]
        return pd.DataFrame(rows, columns=["word", "n"])

    def run(batches):
        total: dict[bytes, int] = {}
        for batch in batches:
            keys, texts, load = [], [], 0
            rows = list(zip(batch["key"], batch["text"], strict=True))
            for i, (key, text) in enumerate(rows):
                keys.append(key)
                texts.append(text)
                load += len(text) // 4
                if load < MOST_RUNS and i + 1 < len(rows):
                    continue
                for word, c in _spelled(keys, texts).items():
                    if len(word) >= min_length:
                        total[word] = total.get(word, 0) + c
                keys, texts, load = [], [], 0
                if len(total) >= MOST_WORDS:
                    yield frame(total)
                    total = {}
        yield frame(total)

    return run


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``word, n``: the words of ``docs(doc_id, text)`` and their occurrences."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.coalesce("text", F.lit("")).alias("text")
    )
    counted = rows.mapInPandas(_count(min_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def pivots(places: np.ndarray, costs: np.ndarray) -> np.ndarray:
    """Two places per row of bigrams that do not overlap, with the least total cost.

    Dynamic programming along the word: the cheapest bigram up to each place, and from it the
    cheapest pair that ends there. Only the bigram one place before can overlap.
    """
    by_place = np.argsort(places, axis=1)
    place, cost = np.take_along_axis(places, by_place, 1), np.take_along_axis(costs, by_place, 1)
    rows, far = np.arange(len(place)), np.iinfo(np.int64).max // 4
    least = np.full(cost.shape, far)  # of single bigrams up to each column, and where it is
    where = np.zeros(cost.shape, np.int64)
    best, chosen = np.full(len(place), far), np.zeros((len(place), 2), np.int64)
    for k in range(place.shape[1]):
        if k:
            back = np.where(place[:, k] - place[:, k - 1] >= 2, k - 1, k - 2)
            pair = np.where(back >= 0, least[rows, back], far) + cost[:, k]
            better = pair < best
            best = np.where(better, pair, best)
            chosen[better] = np.stack([where[rows, back], place[:, k]], axis=1)[better]
        earlier = least[:, k - 1] if k else np.full(len(place), far)
        least[:, k] = np.minimum(earlier, cost[:, k])
        where[:, k] = np.where(cost[:, k] < earlier, place[:, k], where[:, k - 1])
    return chosen


class Spelled:
    """Some words as one array of characters, with hashes of any part of any word."""

    def __init__(self, words):
        self.n = np.array([len(w) for w in words], np.int64)
        self.start = np.cumsum(self.n) - self.n
        self.chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        base = 0x9E3779B97F4A7C55
        up, self.down = (
            np.cumprod(np.append(np.uint64(1), np.full(len(self.chars), x, np.uint64)))
            for x in (base, pow(base, -1, 1 << 64))
        )
        self.sums = np.append(np.uint64(0), np.cumsum(mix(self.chars + GOLDEN) * up[:-1]))

    def part(self, word: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the characters ``first`` to ``end`` of each word."""
        at = self.start[word]
        return mix((self.sums[at + end] - self.sums[at + first]) * self.down[at + first])

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word, place and code of all bigrams."""
        word = np.repeat(np.arange(len(self.n)), self.n - 1)
        place = np.arange(len(word)) - np.repeat(np.cumsum(self.n - 1) - self.n + 1, self.n - 1)
        at = self.start[word] + place
        return word, place, (self.chars[at] << np.uint64(32)) | self.chars[at + 1]


def _key(kind: int, n: np.ndarray, place: np.ndarray, *parts: np.ndarray) -> np.ndarray:
    total = (n * 4 + kind).astype(np.uint64) * multiple(3) + place.astype(np.uint64) * multiple(5)
    for x in parts:
        total = mix(total + x)
    return mix(total).view(np.int64)


def index_keys(s: Spelled, word: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and keys of pivots: what an edit on either side leaves of the word, in two ways each."""
    n, end, zero = s.n[word], place + 2, np.zeros(len(word), np.int64)
    words, keys = [], []

    def add(some, key):
        words.append(word[some])
        keys.append(key[some])

    every = np.ones(len(word), bool)
    half = (n - end) // 2  # the edit lies behind the pivot
    add(every, _key(0, n, place, s.part(word, zero, end + half)))
    add(half > 0, _key(1, n, place, s.part(word, zero, end), s.part(word, end + half, n)))
    half = place // 2  # the edit lies before the pivot
    add(every, _key(2, n, place, s.part(word, place - half, n)))
    add(half > 0, _key(3, n, place, s.part(word, place, n), s.part(word, zero, place - half)))
    return np.concatenate(words), np.concatenate(keys)


def lookup_keys(s: Spelled, word: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and keys under which words one edit from each are indexed if they share this bigram.

    ``other`` is the length of the indexed word. A part of it that this word does not reach gives
    a key that means nothing, and is left out.
    """
    n, end, zero = s.n[word], place + 2, np.zeros(len(word), np.int64)
    words, keys = [], []

    def add(some, key):
        words.append(word[some])
        keys.append(key[some])

    for change in (-1, 0, 1):
        other = n + change
        after = other - end  # the edit lies behind: the pivot has the same place
        half, ok = after // 2, after >= 0
        add(ok & (end + half <= n), _key(0, other, place, s.part(word, zero, np.minimum(end + half, n))))
        tail = np.clip(n - (after - half), end, n)
        add(ok & (half > 0), _key(1, other, place, s.part(word, zero, end), s.part(word, tail, n)))
        before = place + change  # the edit lies before: the pivot has the same place from the end
        half, ok = before // 2, before >= 0
        add(ok & (half <= place), _key(2, other, before, s.part(word, np.clip(place - half, 0, n), n)))
        head = np.clip(before - half, 0, place)
        add(ok & (half > 0), _key(3, other, before, s.part(word, place, n), s.part(word, zero, head)))
    return np.concatenate(words), np.concatenate(keys)


def _grams(word: Column) -> Column:
    places = F.sequence(F.lit(1), F.char_length(word) - 1)
    return F.transform(places, lambda p: F.substring(word, p, F.lit(2)))


def _keys(grams, sought: bool):
    """Keys of each word: those it is looked up by, or those it is indexed by."""

    def run(batches):
        codes, rank = grams.value
        for batch in batches:
            s = Spelled(batch["word"].tolist())
            word, place, code = s.bigrams()
            r = rank[np.searchsorted(codes, code)]
            order = np.lexsort((place, r, word))
            rarest = order[(np.cumsum(s.n - 1) - s.n + 1)[:, None] + np.arange(PREFIX)]
            if sought:
                prefix = r <= r[rarest[:, -1]][word]
                owner, key = lookup_keys(s, word[prefix], place[prefix])
            else:
                chosen = pivots(place[rarest], r[rarest])
                owner, key = index_keys(s, np.repeat(np.arange(len(s.n)), 2), chosen.ravel())
            rows = batch.iloc[owner]
            yield pd.DataFrame({"key": key, "word": rows["word"].to_numpy(), "n": rows["n"].to_numpy()}).drop_duplicates()

    return run


def near(words: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: all pairs of ``words(word, n)`` one edit apart, each in both orders.

    Words have at least five characters.
    """
    spark = words.sparkSession
    # At most 90 * 90 bigrams: what the words of ``vocabulary`` are made of are 90 letters.
    grams = words.select(F.explode(_grams(F.col("word"))).alias("gram")).groupBy("gram").count().collect()
    grams = sorted(grams, key=lambda r: (r["count"], r["gram"]))
    codes = np.array([(ord(g["gram"][0]) << 32) | ord(g["gram"][1]) for g in grams], np.uint64)
    by_code = np.argsort(codes)
    sent = spark.sparkContext.broadcast((codes[by_code], by_code.astype(np.int64)))
    rows = words.select("word", "n")
    index = rows.mapInPandas(_keys(sent, False), "key long, word string, n long")
    lookup = rows.mapInPandas(_keys(sent, True), "key long, word string, n long")
    index = index.toDF("key", "a", "n_a")
    lookup = lookup.toDF("key", "b", "n_b")
    found = index.join(lookup.hint("merge"), "key").filter(F.levenshtein("a", "b", 1) == 1).drop("key")
    turned = F.explode(
        F.array(F.struct("a", "n_a", "b", "n_b"), F.struct("b", "n_b", "a", "n_a").cast("struct<a:string,n_a:long,b:string,n_b:long>"))
    )
    return found.select(turned.alias("_p")).select("_p.*").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for ``forms(word, form)``: where following the forms ends."""
    state = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = state.join(further.hint("merge"), "root", "left")
        state = cut_lineage(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if state.filter("moved").isEmpty():
            return state.drop("moved")
        state = state.drop("moved")


def groups(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` of each word of ``docs(doc_id, text)``."""
    if min_length < 6:
        raise ValueError("words under six characters may have no two bigrams beside an edit")
    words = stored(vocabulary(docs, min_length, min_count), "vocabulary")
    best = F.min(F.when(F.col("n_b") >= ratio * F.col("n_a"), F.struct((-F.col("n_b")).alias("m"), F.col("b").alias("form"))))
    per_word = near(words).groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best.alias("best"))
    told = stored(per_word.select("word", "n_near", "best.form", (-F.col("best.m")).alias("form_n")), "variants")
    ends = roots(told.filter("form IS NOT NULL"))
    found = words.join(told.hint("merge"), "word", "left").join(ends.hint("merge"), "word", "left")
    return found.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        "form",
        "form_n",
        F.coalesce("root", "word").alias("root"),
    )
