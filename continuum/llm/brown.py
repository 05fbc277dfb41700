"""Language-model scores by Brown classes: class transitions times word emissions.

Tokens are the words of the text with A-Z lower-cased, then one end. Counts are taken over all
training rows. Classes are found in two steps.

1. The ``FREQUENT`` most frequent words, and ``SPELLINGS`` buckets into which every other word
   falls by its last three bytes, are clustered on the driver by the exchange algorithm: from
   classes dealt by frequency it moves one item at a time to the class that raises the likelihood
   of the class bigrams most, until a sweep moves none.
2. Every other word that occurs twice or more in training starts from the class of its bucket. In
   each of ``ROUNDS`` rounds a Spark job counts, for each of these words, the classes before and
   after it, a table that grows with the vocabulary, and moves each word to its best class by
   the exact gain of the exchange. Words of a round move at once, against the class table of its
   start; of all rounds the classes with the highest likelihood are taken.

Words seen once in training and unseen words have the class of their bucket. The end token is a
class of its own.

    P(w | before) = P(C(w) | C(before)) * (c(w) + 1) / (N(C) + V(C) + 1)

with N(C) the tokens and V(C) the different words of the class, so the unseen words of a class
share one more count, as they do in the base. Transitions are smoothed with ``PRIOR`` per class.

How it is spread: each task cuts its texts into chunks of ``CHUNK_BYTES``, which stay where they
are. A chunk's words are numbered in the order of their hashes, and its texts are kept as numbers.
The hash range is divided into parts of bounded size; a chunk sends the list of its words of each
part there once, and the part answers with what it knows of them, item, class or count, as an
array in the list's order. So words move once, and a round moves a byte per word of a chunk, and
the counts of the words that may move. Tables of counts are added up in the tasks, then in two
steps of groups, before they come to the driver; their size depends on the parameters only.

Defined results: a null text is empty and has the end token only; rows with equal ids are
rows of their own, equal rows count each time they occur; null ids are allowed; without any
training row all counts are 0 and the classes know nothing; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from continuum.llm.counts import TABLE, added, packed, slices, steps, unpacked
from continuum.llm.store import dealt, stored

CLASSES = 64
FREQUENT = 1000
SPELLINGS = 512
ROUNDS = 2
SWEEPS = 12
PRIOR = 0.5
CHUNK_BYTES = 24 << 20  # text that a task numbers at once
PAGE_TOKENS = 1 << 20  # tokens kept in one row, or one longer text
PART_BYTES = 16 << 20  # text whose words one part answers for
SLICES = 32  # rows that the table of item bigrams is dealt into
END = 1  # stands for the end token among word hashes
_MASK = 0xFFFFFFFFFFFFFFFE
_MOVES = 128  # beside the class, in a byte: the word may move


class Numbered(dict):
    """Word (bytes) to a running number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash; parts are ranges, in order."""
    return (((h >> np.uint64(33)) * np.uint64(parts)) >> np.uint64(31)).astype(np.int64)


_CHUNK = (
    "chunk long, part int, words binary, counts binary, spellings binary, "
    "keys array<string>, train array<boolean>, sizes array<int>, ids binary"
)
_CHUNK_COLUMNS = [c.split()[0] for c in _CHUNK.split(", ")]


def _number(parts: int):
    """Chunks of a task's texts: a row per part for its words, and pages of texts (part -1)."""

    def chunk_rows(number: int, seen: Numbered, texts: list[tuple[str | None, bool, np.ndarray]]):
        end = seen[b""]  # no word is empty
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) & _MASK for w in seen), np.uint64, len(seen))
        spelling = np.fromiter((zlib.crc32(w[-3:]) % SPELLINGS for w in seen), np.uint16, len(seen))
        h[end], spelling[end] = END, SPELLINGS
        order = np.argsort(h)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        h, spelling = h[order], spelling[order]
        trained = [ids for _, train, ids in texts if train]
        counts = np.bincount(place[np.concatenate([*trained, np.empty(0, np.int64)])], minlength=len(h))
        part = part_of(h, parts)
        first = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(first, np.append(first[1:], len(h)), strict=True):
            yield number, int(part[a]), h[a:b].tobytes(), packed(counts[a:b]), packed(spelling[a:b], "<u2"), None, None, None, None
        page, load = [], 0
        for i, (key, train, ids) in enumerate(texts):
            page.append((key, train, len(ids), place[ids]))
            load += len(ids)
            if load >= PAGE_TOKENS or i + 1 == len(texts):
                keys, trains, sizes, found = zip(*page, strict=True)
                yield number, -1, None, None, None, list(keys), list(trains), list(sizes), packed(np.concatenate(found))
                page, load = [], 0

    def frame(number: int, seen: Numbered, texts) -> pd.DataFrame:
        rows = list(chunk_rows(number, seen, texts))
        return pd.DataFrame(rows, columns=_CHUNK_COLUMNS).astype({"chunk": np.int64, "part": np.int32})

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        seen, texts, load = Numbered(), [], 0
        for batch in batches:
            for key, text, train in zip(batch["key"], batch["text"], batch["train"], strict=True):
                words = text.lower().split()
                ids = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
                texts.append((key, bool(train), np.append(ids, seen[b""]).astype(np.int32)))
                load += len(text) + 1
                if load >= CHUNK_BYTES:
                    yield frame(number, seen, texts)
                    number += 1
                    seen, texts, load = Numbered(), [], 0
        if texts:
            yield frame(number, seen, texts)

    return run


_LISTS = "part int, chunk long, words binary, counts binary, spellings binary, places binary"


def _meet(key, rows: pd.DataFrame) -> pd.DataFrame:
    """A part's words with their totals (chunk -1), and where the words of each chunk are among them."""
    h = [np.frombuffer(w, np.uint64) for w in rows["words"]]
    word, first, place = np.unique(np.concatenate(h), return_index=True, return_inverse=True)
    total = np.zeros(len(word), np.int64)
    np.add.at(total, place, np.concatenate([unpacked(c) for c in rows["counts"]]).astype(np.int64))
    spelling = np.concatenate([unpacked(x, "<u2") for x in rows["spellings"]])[first]
    made = [(key[0], -1, word.tobytes(), packed(total, "<i8"), packed(spelling, "<u2"), None)]
    for chunk, x in zip(rows["chunk"], np.split(place, np.cumsum([len(x) for x in h])[:-1]), strict=True):
        made.append((key[0], chunk, None, None, None, packed(steps(x))))
    return pd.DataFrame(made, columns=[c.split()[0] for c in _LISTS.split(", ")])


class Part:
    """The words of a part, from its row in the lists."""

    def __init__(self, row):
        self.words = np.frombuffer(row.words, np.uint64)
        self.counts = unpacked(row.counts, "<i8")
        self.spellings = unpacked(row.spellings, "<u2").astype(np.int64)

    def own(self, frequent: np.ndarray) -> np.ndarray:
        """The place of each word among the sorted frequent ones, -1 for any other."""
        if not len(frequent):
            return np.full(len(self.words), -1)
        i = np.minimum(np.searchsorted(frequent, self.words), len(frequent) - 1)
        return np.where(frequent[i] == self.words, i, -1)


def _parts(rows: pd.DataFrame) -> tuple[Part, list]:
    """The part of a group of lists, and its chunks' lists."""
    found = list(rows.itertuples())
    return Part(next(r for r in found if r.chunk < 0)), [r for r in found if r.chunk >= 0]


def _places(row) -> np.ndarray:
    return np.cumsum(unpacked(row.places).astype(np.int64))


_ANSWER = "chunk long, part int, n int, answer binary, counts binary"


def _answers(chunks: list, part: int, answer: np.ndarray, kind: str, counts: np.ndarray | None = None) -> pd.DataFrame:
    made = []
    for row in chunks:
        at = _places(row)
        c = None if counts is None else packed(counts[at], "<i8")
        made.append((row.chunk, part, len(at), packed(answer[at], kind), c))
    return pd.DataFrame(made, columns=["chunk", "part", "n", "answer", "counts"])


def _answered(answers: pd.DataFrame, kind: str, column: str = "answer") -> np.ndarray:
    """What the parts say about the words of a chunk, in the words' order."""
    ordered = answers.sort_values("part")[column]
    return np.concatenate([unpacked(x, kind) for x in ordered])


def _tokens(pages: pd.DataFrame):
    """The numbers of each training page's tokens, held-out texts left out."""
    for page in pages.itertuples():
        ids = unpacked(page.ids)
        yield ids[np.repeat(np.asarray(page.train, bool), np.asarray(page.sizes))]


def _before(x: np.ndarray, end: int) -> np.ndarray:
    """What stands before each token; every text ends with the end token, and so begins after one."""
    return np.append(np.full(min(1, len(x)), end, x.dtype), x[:-1])


def _bigrams(size: int, kind: str, n_slices: int):
    """Counts of pairs of neighbours, as numbers below ``size`` by what the parts say of the words."""

    def count(pages: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        of = _answered(answers, kind).astype(np.int64)
        if kind == "u1":
            of &= _MOVES - 1
        table = np.zeros(size * size, np.int64)
        for ids in _tokens(pages):
            x = of[ids]
            table += np.bincount(_before(x, size - 1) * size + x, minlength=size * size)
        return slices(table, n_slices)

    return count


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each item from the square table of bigram counts; the last item stands alone."""
    n_items = len(pairs) - 1
    mass = pairs.sum(axis=1)
    by_mass = np.argsort(-mass[:-1], kind="stable")
    of = np.empty(n_items + 1, np.int64)
    of[by_mass] = np.arange(n_items) % classes
    of[-1] = classes
    member = np.zeros((n_items + 1, classes + 1))
    member[np.arange(n_items + 1), of] = 1
    pairs = pairs.astype(float)
    right = pairs @ member  # from item to class
    left = pairs.T @ member  # from class to item
    table = member.T @ right
    diagonal = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in by_mass:
            if not mass[w]:
                continue
            old, self_ = of[w], pairs[w, w]
            r, c = right[w].copy(), left[w].copy()
            r[old] -= self_
            c[old] -= self_
            table[old] -= r
            table[:, old] -= c
            table[old, old] -= self_
            rows, columns = table[:classes], table[:, :classes].T
            gain = (_f(rows + r) - _f(rows)).sum(axis=1) + (_f(columns + c) - _f(columns)).sum(axis=1)
            own = table[diagonal, diagonal]
            r_own, c_own = r[:classes], c[:classes]
            gain -= _f(own + r_own) + _f(own + c_own) - _f(own)
            gain += _f(own + r_own + c_own + self_)
            out = table.sum(axis=1)[:classes] + c_own
            into = table.sum(axis=0)[:classes] + r_own
            gain -= _f(out + r.sum() + self_) - _f(out)
            gain -= _f(into + c.sum() + self_) - _f(into)
            new = int(gain.argmax())
            if gain[new] <= gain[old] + 1e-9:
                new = old
            table[new] += r
            table[:, new] += c
            table[new, new] += self_
            if new != old:
                moved += 1
                of[w] = new
                right[:, old] -= pairs[:, w]
                right[:, new] += pairs[:, w]
                left[:, old] -= pairs[w]
                left[:, new] += pairs[w]
        if not moved:
            break
    return of


def gains(table: np.ndarray, old: np.ndarray, right: np.ndarray, left: np.ndarray, own: np.ndarray) -> np.ndarray:
    """What ``exchange`` gains by each class for words on their own, one row per word.

    ``right`` and ``left`` count the classes after and before each word, without the ``own``
    bigrams of the word with itself; the words are still in their classes ``old`` in ``table``.
    """
    k, n = len(table) - 1, len(old)
    gain, rows = np.zeros((n, k)), np.arange(n)

    def sides(table, r, c):
        b, other = np.nonzero(r)
        if not len(b):
            return
        x, at = r[b, other], np.flatnonzero(other == old[b])
        base = table.T[other, :k]
        base[np.arange(len(b)), old[b]] -= x
        base[at] -= c[b[at], :k]
        base[at, old[b[at]]] -= own[b[at]]
        found = np.unique(b, return_index=True)
        gain[found[0]] += np.add.reduceat(_f(base + x[:, None]) - _f(base), found[1])

    sides(table, right, left)
    sides(table.T, left, right)
    r, c, own_ = right[:, :k], left[:, :k], own[:, None]
    both = np.repeat(np.diag(table)[None, :k], n, axis=0)
    both[rows, old] -= right[rows, old] + left[rows, old] + own
    gain += _f(both + r + c + own_) - _f(both + r) - _f(both + c) + _f(both)
    for axis, mass in ((1, right.sum(axis=1) + own), (0, left.sum(axis=1) + own)):
        total = np.repeat(table.sum(axis=axis)[None, :k], n, axis=0)
        total[rows, old] -= mass
        gain -= _f(total + mass[:, None]) - _f(total)
    return gain


WIDTH = 2 * (CLASSES + 1) + 1  # classes after, classes before, itself
_CONTEXTS = "part int, chunk long, words binary, sizes binary, codes binary, counts binary"
_CONTEXT_COLUMNS = [c.split()[0] for c in _CONTEXTS.split(", ")]


def _contexts(pages: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """For each part, the contexts of its words that may move: numbers in the chunk's list, codes, counts."""
    k = CLASSES + 1
    said = _answered(answers, "u1").astype(np.int64)
    c, moves = said & (_MOVES - 1), said >= _MOVES
    codes = []
    for ids in _tokens(pages):
        ids = ids.astype(np.int64)
        before = _before(c[ids], CLASSES)
        at = np.flatnonzero(moves[ids])  # never the end of a text, so a token follows
        w = ids[at]
        twin = ids[at + 1] == w
        again = np.zeros(len(at), bool)  # the second of a pair of equal words
        again[1:] = (w[1:] == w[:-1]) & (at[1:] == at[:-1] + 1)
        codes.append(w * WIDTH + np.where(twin, 2 * k, c[ids[at + 1]]))
        codes.append((w * WIDTH + k + before[at])[~again])
    code, n = np.unique(np.concatenate([*codes, np.empty(0, np.int64)]), return_counts=True)
    word, code = code // WIDTH, (code % WIDTH).astype(np.uint8)
    made = []
    low = 0
    for part, size in zip(*(answers.sort_values("part")[x] for x in ("part", "n")), strict=True):
        a, b = np.searchsorted(word, [low, low + size])
        if b > a:
            first = np.flatnonzero(np.diff(word[a:b], prepend=-1))
            sizes = np.diff(np.append(first, b - a))
            made.append((part, pages["chunk"].iloc[0], packed(steps(word[a:b][first] - low)), packed(sizes, "u1"),
                         packed(code[a:b], "u1"), packed(n[a:b])))
        low += size
    return pd.DataFrame(made, columns=_CONTEXT_COLUMNS).astype({"part": np.int32, "chunk": np.int64})


def _best(table: np.ndarray, frequent: np.ndarray):
    """The best class of each word of a part, from its contexts in all chunks."""

    def choose(key, contexts: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
        part, chunks = _parts(lists[lists["classes"].isna()])
        present = np.frombuffer(lists["classes"].dropna().iloc[0], np.uint8).astype(np.int64)
        places = {row.chunk: _places(row) for row in chunks}
        word, code, count = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for row in contexts.itertuples():
            local = np.cumsum(unpacked(row.words).astype(np.int64))
            word.append(np.repeat(places[row.chunk][local], unpacked(row.sizes, "u1")))
            code.append(unpacked(row.codes, "u1").astype(np.int64))
            count.append(unpacked(row.counts).astype(np.int64))
        word, code, count = (np.concatenate(x) for x in (word, code, count))
        order = np.argsort(word, kind="stable")
        word, code, count = word[order], code[order], count[order]
        moving = np.flatnonzero(_moves(part, frequent))
        new, k = present.copy(), CLASSES + 1
        for start in range(0, len(moving), 1024):
            some = moving[start : start + 1024]
            a, b = np.searchsorted(word, [some[0], some[-1] + 1])
            seen = np.zeros((len(some), WIDTH))  # counts are whole numbers below 2**53
            np.add.at(seen, (np.searchsorted(some, word[a:b]), code[a:b]), count[a:b])
            old = present[some]
            gain = gains(table, old, seen[:, :k], seen[:, k : 2 * k], seen[:, 2 * k])
            best, rows = gain.argmax(axis=1), np.arange(len(some))
            new[some] = np.where(gain[rows, best] > gain[rows, old] + 1e-9, best, old)
        return pd.DataFrame({"part": [key[0]], "classes": [new.astype(np.uint8).tobytes()]})

    return choose


def _moves(part: Part, frequent: np.ndarray) -> np.ndarray:
    return (part.own(frequent) < 0) & (part.counts >= 2) & (part.words != END)


def _likelihood(table: np.ndarray) -> float:
    return _f(table).sum() - _f(table.sum(axis=0)).sum() - _f(table.sum(axis=1)).sum()


class Model:
    """What scoring needs beside the words' counts and classes, of a size that depends on the parameters only."""

    def __init__(self, transitions, emission, total, different):
        self.transitions, self.emission = transitions, emission
        self.total, self.different = total, different

    def score(self, sizes, counts, c) -> dict[str, np.ndarray]:
        """Per text: tokens, known tokens, base score and score. ``counts``, ``c``: count and class of each token."""
        starts = np.cumsum(sizes) - sizes
        before = _before(c, CLASSES)
        unigram = np.log10(counts + 1.0)
        base = unigram - np.log10(self.total + self.different + 1.0)
        emitted = np.where(c == CLASSES, 0.0, unigram - self.emission[c])
        per_text = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every text has a token
        return {
            "n_tokens": sizes,
            "n_known": per_text((counts > 0).astype(np.int64)),
            "base_score": per_text(base),
            "score": per_text(self.transitions[before, c] + emitted),
        }


@dataclass
class Fitted:
    """The model, and beside it the lists and the classes of all words, part by part."""

    model: Model
    lists: DataFrame
    classes: DataFrame

    def words(self) -> DataFrame:
        """``word`` (the hash), ``c, class`` of every word."""

        def told(lists: pd.DataFrame, classes: pd.DataFrame) -> pd.DataFrame:
            part, _ = _parts(lists)
            of = np.frombuffer(classes["classes"].iloc[0], np.uint8)
            return pd.DataFrame({"word": part.words.view(np.int64), "c": part.counts, "class": of.astype(np.int32)})

        both = self.lists.groupBy("part").cogroup(self.classes.groupBy("part"))
        return both.applyInPandas(told, "word long, c long, class int")


def fit(pages: DataFrame, lists: DataFrame) -> Fitted:
    """The model from the pages of the chunks and the lists of the parts."""

    def top_of(batches):
        for batch in batches:
            for row in batch.itertuples():
                part = Part(row)
                known = np.flatnonzero((part.counts > 0) & (part.words != END))
                best = known[np.argsort(-part.counts[known], kind="stable")[:FREQUENT]]
                yield pd.DataFrame({"word": part.words[best].view(np.int64), "c": part.counts[best]})

    totals = lists.filter("chunk < 0")
    top = totals.mapInPandas(top_of, "word long, c long").orderBy(F.desc("c"), "word").limit(FREQUENT).toPandas()
    by_hash = np.argsort(top["word"].to_numpy(np.int64).view(np.uint64))
    frequent = top["word"].to_numpy(np.int64).view(np.uint64)[by_hash]
    size = len(top) + SPELLINGS + 1

    def items(key, rows: pd.DataFrame) -> pd.DataFrame:
        part, chunks = _parts(rows)
        own = part.own(frequent)
        number = np.where(own >= 0, by_hash[own] if len(by_hash) else own, len(by_hash) + part.spellings)
        return _answers(chunks, key[0], number, "<u2")

    def by_chunk(answers: DataFrame, f, schema: str) -> DataFrame:
        return pages.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(f, schema)

    known = lists.groupBy("part").applyInPandas(items, _ANSWER)
    pairs = added(by_chunk(known, _bigrams(size, "<u2", SLICES), TABLE), SLICES)
    pairs = pairs.reshape(size, size) if len(pairs) else np.zeros((size, size), np.int64)
    class_of = exchange(pairs).astype(np.uint8)
    del pairs

    def first_classes(batches):
        for batch in batches:
            for row in batch.itertuples():
                part = Part(row)
                own = part.own(frequent)
                number = np.where(own >= 0, by_hash[own] if len(by_hash) else own, len(by_hash) + part.spellings)
                yield pd.DataFrame({"part": [row.part], "classes": [class_of[number].tobytes()]})

    classes = stored(totals.mapInPandas(first_classes, "part int, classes binary"), "classes")
    none = np.zeros((CLASSES + 1) ** 2, np.int64)
    best = None
    for left in range(ROUNDS, -1, -1):  # the last one only counts
        answers = stored(class_answers(lists, classes, frequent, counts=False), "answers")
        table = added(by_chunk(answers, _bigrams(CLASSES + 1, "u1", 1), TABLE), 1)
        table = (table if len(table) else none).reshape(CLASSES + 1, CLASSES + 1).astype(float)
        if best and _likelihood(table) <= best[0]:
            break
        best = _likelihood(table), table, classes
        if not left:
            break
        others = [F.lit(-2 if c == "chunk" else None).cast(t).alias(c) for c, t in _LIST_TYPES[1:]]
        blank = classes.select("part", *others, "classes")
        told = lists.withColumn("classes", F.lit(None).cast("binary")).unionByName(blank)
        contexts = by_chunk(answers, _contexts, _CONTEXTS)
        moved = contexts.groupBy("part").cogroup(told.groupBy("part"))
        classes = stored(moved.applyInPandas(_best(table, frequent), "part int, classes binary"), "classes")

    _, table, classes = best

    def masses(lists: pd.DataFrame, classes: pd.DataFrame) -> pd.DataFrame:
        part, _ = _parts(lists)
        of = np.frombuffer(classes["classes"].iloc[0], np.uint8)
        mass = np.zeros(CLASSES + 1, np.int64)
        np.add.at(mass, of, part.counts)
        different = np.bincount(of[part.counts > 0], minlength=CLASSES + 1)
        return pd.DataFrame({"class": np.arange(CLASSES + 1, dtype=np.int32), "c": mass, "v": different})

    per_part = totals.groupBy("part").cogroup(classes.groupBy("part")).applyInPandas(masses, "class int, c long, v long")
    kinds = per_part.groupBy("class").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).toPandas()
    mass, different = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    mass[kinds["class"]], different[kinds["class"]] = kinds["c"], kinds["v"]
    table = table + PRIOR
    transitions = np.log10(table / table.sum(axis=1, keepdims=True))
    model = Model(transitions, np.log10(mass + different + 1), int(mass.sum()), int(different.sum()))
    return Fitted(model, lists, classes)


_LIST_TYPES = [tuple(c.split()) for c in _LISTS.split(", ")]


def class_answers(lists: DataFrame, classes: DataFrame, frequent: np.ndarray, counts: bool) -> DataFrame:
    """To each chunk, the class of each of its words and whether it may move; or class and count."""

    def tell(key, lists: pd.DataFrame, classes: pd.DataFrame) -> pd.DataFrame:
        part, chunks = _parts(lists)
        of = np.frombuffer(classes["classes"].iloc[0], np.uint8)
        if counts:
            return _answers(chunks, key[0], of, "u1", part.counts)
        return _answers(chunks, key[0], of + _MOVES * _moves(part, frequent).astype(np.uint8), "u1")

    both = lists.groupBy("part").cogroup(classes.groupBy("part"))
    return both.applyInPandas(tell, _ANSWER)


def chunks_of(docs: DataFrame, train) -> tuple[DataFrame, DataFrame]:
    """The pages of the chunks of ``docs``, and the lists of the parts."""
    text = F.coalesce("text", F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(8, -(-size // PART_BYTES))
    rows = docs.select(
        F.col("doc_id").cast("string").alias("key"), text.cast("binary").alias("text"), F.coalesce(train, F.lit(False)).alias("train")
    )
    chunks = dealt(rows.mapInPandas(_number(parts), _CHUNK), "chunks", ["chunk"])
    words = chunks.filter("part >= 0").select("part", "chunk", "words", "counts", "spellings")
    lists = dealt(words.groupBy("part").applyInPandas(_meet, _LISTS), "lists", ["part"])
    return chunks.filter("part < 0").select("chunk", "keys", "train", "sizes", "ids"), lists


def scores(docs: DataFrame, train) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score, train`` for each row.

    ``train`` is a condition on the columns of ``docs``: the rows to learn from.
    """
    pages, lists = chunks_of(docs, train)
    fitted = fit(pages, lists)
    model = docs.sparkSession.sparkContext.broadcast(fitted.model)

    def score(pages: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        class_, c = _answered(answers, "u1").astype(np.int64), _answered(answers, "<i8", "counts")
        made = []
        for page in pages.itertuples():
            ids, sizes = unpacked(page.ids), np.asarray(page.sizes, np.int64)
            result = model.value.score(sizes, c[ids], class_[ids])
            made.append(pd.DataFrame({"key": list(page.keys), "train": np.asarray(page.train, bool), **result}))
        return pd.concat(made) if made else pd.DataFrame(columns=["key", "train", *_MEASURES])

    # Ids travel as text: in pandas, a null beside them would turn large numbers into floats.
    kind = docs.schema["doc_id"].dataType
    schema = "key string, train boolean, n_tokens long, n_known long, base_score double, score double"
    answers = class_answers(lists, fitted.classes, np.empty(0, np.uint64), counts=True)
    scored = pages.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(score, schema)
    return scored.select(
        F.col("key").cast(kind).alias("doc_id"), "train", "n_tokens", "n_known",
        F.lit(fitted.model.total).cast("long").alias("train_tokens"), "base_score", "score",
    )


_MEASURES = ["n_tokens", "n_known", "base_score", "score"]
