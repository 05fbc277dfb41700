"""Benchmark passages, ranked search and spelling variants against plain versions and on odd tables."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from cases import prose, texts_of
from pyspark.sql import functions as F

from continuum.llm import balltree, decontaminate, variants
from continuum.llm.terms import folded

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def terms(text):
    return TERM.findall(lower(text or ""))


def test_terms_of_odd_texts():
    for text in ["", "A-b_c9 Ünï ÇA\x00x", "a b c", "9é9 ABC\t[x]`{y}~|z", "ĀB 🙂🙂x"]:
        assert [t.decode() for t in folded(text.encode())] == terms(text)


# --- 11: benchmark passages --------------------------------------------------------------


def plain_hits(text, items, window):
    w = terms(text)
    hit, found = set(), set()
    for item, t in items:
        b = terms(t)
        size = min(window, len(b))
        for i in range(len(b) - size + 1 if size else 0):
            for p in range(len(w) - size + 1):
                if w[p : p + size] == b[i : i + size]:
                    hit.update(range(p, p + size))
                    found.add("" if item is None else str(item))
    return sorted(hit), sorted(found)


def check_hits(docs, benchmark, **options):
    items = [(r.item_id, r.text) for r in benchmark.select("item_id", "text").collect()]
    got = decontaminate.occurrences(docs, benchmark, **options).collect()
    window = options.get("window", decontaminate.WINDOW)
    want = collections.Counter()
    for key, text in texts_of(docs):
        hits, found = plain_hits(text, items, window)
        want[key, len(terms(text)), tuple(hits), tuple(found)] += 1
    assert want == collections.Counter((r.doc_id, r.n_words, tuple(r.hits), tuple(r.items)) for r in got)
    return got


@pytest.fixture(scope="module")
def passages(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "Be", "see", "dee", "é", "of", "x1"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([25, 14, 10, 9, 3, 2, 1, 12, 40])]
    items += [(9, items[0][1]), (1, "zz top"), (10, None), (11, " -- "), (None, "only here Q")]
    texts = [" ".join(word() for _ in range(rng.randrange(0, 90))) for _ in range(60)]
    for i, (_, t) in enumerate(items[:9]):
        texts[i] = f"{texts[i]}, {t.upper()}. {texts[i + 1]}"
    texts += ["only\nhere... q", "only here", "zz-top", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    return docs, spark.createDataFrame(items, ITEMS)


@pytest.mark.parametrize("options", [{}, {"window": 3}, {"window": 1}, {"limit": 60}, {"limit": 1}])
def test_passages(passages, options):
    """One pass, and passes of few or single items, some of them cut into parts."""
    assert any(r.hits for r in check_hits(*passages, **options))


def test_passages_in_long_stretches(spark, monkeypatch):
    """Places of the search meet, and windows lie across their borders and those of batches."""
    monkeypatch.setattr(decontaminate, "STRETCH", 64)
    text = prose(4, 600)
    items = [(i, " ".join(text.split()[k : k + 15])) for i, k in enumerate(range(0, 580, 29))]
    block = [(str(i), folded(t.encode())) for i, t in items]
    texts = [text, "", "x y", text[100:3000], text * 2]
    places, names = decontaminate.Windows(block).search([folded(t.encode()) for t in texts])
    for t, p, n in zip(texts, places, names, strict=True):
        assert (p.tolist(), n) == plain_hits(t, items, 10)


def test_passages_odd_rows(spark, odd, none, passages):
    items = spark.createDataFrame([(1, prose(1, 30)), (2, "same same"), (3, prose(5, 9000)[-400:]), (4, None)], ITEMS)
    got = check_hits(odd, items.withColumn("hits", F.lit(1)))
    assert sum(bool(r.hits) for r in got) == 5  # two equal rows, two long texts, and the one of equal words
    assert all(not r.hits for r in check_hits(odd, items.filter("false")))
    assert decontaminate.occurrences(none, items).count() == 0
    named = odd.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert decontaminate.digests(decontaminate.occurrences(named, items)).filter("contaminated").count() == 5


# --- 12: ranked search -------------------------------------------------------------------


def plain_search(docs, items, k):
    docs = [(key, collections.Counter(terms(t))) for key, t in docs]
    sizes = [sum(c.values()) for _, c in docs]
    n_docs, total = sum(n > 0 for n in sizes), sum(sizes)
    df = collections.Counter(t for _, c in docs for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    rows = []
    for item, text in items:
        wanted = collections.Counter(terms(text))
        scored = []
        for (key, c), n in zip(docs, sizes, strict=True):
            m = 25 + (75 * n * n_docs) // max(total, 1)
            score = sum(x * weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, x in wanted.items() if t in c)
            if score > 0:
                scored.append((-score, key is None, key if key is not None else 0))
        for rank, (score, null, key) in enumerate(sorted(scored)[:k], start=1):
            rows.append((item, rank, None if null else key, -score))
    return collections.Counter(rows)


def check_search(docs, items, k=10, **options):
    got = balltree.search(docs, items, k, **options).collect()
    wanted = [(r.item_id, r.text) for r in items.select("item_id", "text").collect()]
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert collections.Counter(map(tuple, got)) == plain_search(texts, wanted, k)
    return got


@pytest.fixture(scope="module")
def library(spark):
    rng = random.Random(5)
    names = [f"t{int(rng.paretovariate(0.6)) % 400}" for _ in range(30000)]
    texts = [" ".join(names[i * 40 : i * 40 + rng.randrange(1, 60)]) for i in range(700)]
    texts[10:40] = [texts[9]] * 30  # ties
    texts[50], texts[51] = None, "..."
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    items = [(i, " ".join(rng.choices(names, k=12))) for i in range(20)] + [(20, texts[9]), (21, None), (22, "unheard of")]
    return docs, spark.createDataFrame(items + [(3, "t1 t2 t2 T2")], ITEMS)


@pytest.mark.parametrize("options", [{}, {"k": 1}, {"limit": 50}])
def test_search(library, options):
    assert len(check_search(*library, **options)) > 20


def test_bounds_hold_and_prune(library):
    """No document below a node scores more than its bound; best-first looks at part of the leaves."""
    docs, items = library
    texts = [(t or "").encode() for _, t in texts_of(docs)]
    block = [(str(r.item_id), folded((r.text or "").encode())) for r in items.collect()]
    known = balltree.Terms(block)
    n, doc, term, _ = known.vectors(texts)
    weights = balltree.Weights(known, int((n > 0).sum()), int(n.sum()), np.bincount(term, minlength=len(known.number)))
    doc, term, value, size = weights.values(texts)
    tree = balltree.Tree(doc, term, value, size, len(weights.weight))
    looked = 0
    for terms_, counts in weights.queries:
        if not len(terms_):
            continue
        norms = np.sqrt(np.bincount(terms_ % balltree.SLICES, counts.astype(float) ** 2, balltree.SLICES))
        bound = tree.bounds(list(range(2 * tree.leaves))[1:], terms_, counts, norms)
        for leaf in range(tree.leaves):
            _, scores = tree.scores(leaf, terms_, counts)
            node = leaf + tree.leaves
            while node:
                assert not len(scores) or scores.max() <= bound[node - 1]
                node //= 2
        looked += balltree.best_first(tree, terms_, counts, balltree.Best(10), [(False, i) for i in range(size)])
    assert looked < 0.9 * tree.leaves * len(weights.queries)


def test_search_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, prose(1, 30)), (2, "same SAME one"), (None, "é ü"), (4, None)], ITEMS)
    check_search(odd, items.withColumn("rank", F.lit("x")))
    assert balltree.search(none, items).count() == 0 and balltree.search(odd, items.filter("false")).count() == 0
    named = odd.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r.doc_id for r in balltree.search(named, items).collect()} <= {f"d{i}" for i in (1, 4, 5, 6, 7, 2**53 + 1)} | {None}


# --- 13: spelling variants ---------------------------------------------------------------

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_groups(docs, min_length=6, min_count=5, ratio=5):
    n = collections.Counter()
    for key, text in docs:
        for run in RUN.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= min_length and c >= min_count}
    near = {w: set() for w in n}
    for a, b in itertools.combinations(n, 2):
        if one_edit(a, b):
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w, others in near.items():
        best = min(((-n[x], x) for x in others if n[x] >= ratio * n[w]), default=None)
        form[w] = best and best[1]
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return collections.Counter(rows)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def check_groups(docs, **options):
    got = variants.groups(docs, **options).select("word", "n", "n_near", "form", "form_n", "root").collect()
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert collections.Counter(map(tuple, got)) == plain_groups(texts, **options)
    return got


def test_variants(spark):
    """Few letters, so words are near in all ways: at their ends, in repeats, in chains of forms."""
    rng = random.Random(7)
    words = ["".join(rng.choice("aé") for _ in range(rng.randrange(5, 9))) for _ in range(200)]
    words += ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "abababa", "Ñandué", "ñanduéé", "xabcdef", "abcdef", "abcdefx"]
    chosen = [w for w in words for _ in range(int(min(400, 2 * rng.paretovariate(0.5))))]
    rng.shuffle(chosen)
    rows = [(i, ", ".join(w.capitalize() if i % 2 else w for w in chosen[i * 50 : i * 50 + 50])) for i in range(len(chosen) // 50 + 1)]
    got = check_groups(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert sum(r.n_near > 2 for r in got) > 20 and any(r.form and r.root != r.form for r in got)


def test_variants_odd_rows(spark, odd, none):
    many = odd.unionByName(odd.withColumn("text", F.lit("Straße strasse strasze straßé " * 7 + "wörld wörlds worlds " * 9)))
    check_groups(many)
    check_groups(many, min_length=7, min_count=2, ratio=2)
    assert variants.groups(none).count() == 0
    with pytest.raises(ValueError):
        variants.groups(odd, min_length=5)


def test_pivots_are_the_cheapest_pair():
    rng = np.random.default_rng(1)
    for _ in range(300):
        places = np.sort(rng.choice(9, 3, replace=False))[None, rng.permutation(3)]
        costs = rng.integers(0, 6, (1, 3))
        a, b = variants.pivots(places, costs)[0].tolist()
        cost = dict(zip(places[0].tolist(), costs[0].tolist(), strict=True))
        pairs = [cost[x] + cost[y] for x, y in itertools.combinations(cost, 2) if abs(x - y) > 1]
        assert abs(a - b) > 1 and cost[a] + cost[b] == min(pairs)


def test_joined_checksums():
    rng = random.Random(0)
    for _ in range(200):
        a, b = rng.randbytes(rng.randrange(9)), rng.randbytes(rng.randrange(1, 30))
        got = variants.joined_crc(*(np.array([x], np.uint64) for x in (zlib.crc32(a), zlib.crc32(b))), np.array([len(b)]))
        assert int(got[0]) == zlib.crc32(a + b)
