"""Each operator against a plain version of itself, and on odd tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from cases import prose, texts_of
from pyspark.sql import functions as F

from continuum.llm import counts, brown, chat, html, minhash, mixing, multiset, packing, quality, suffix, tokens, toxicity, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tally(rows):
    return collections.Counter(tuple(r) for r in rows)


# --- 1: packing --------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["", "a", " a", "a  b", "a \nb", "Don't x 12 ½ é  z", "x<|endoftext|>y", "naïve œuvre", "🙂 a\x1cb", "a b c", "tab\tb  "])
def test_ids_are_the_librarys(text):
    encoder = tokens.encoder()
    want = encoder.library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.ids(text), "<u4").tolist() == want


def test_ids_of_random_texts():
    encoder = tokens.encoder()
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(" \n.,'sté1aB-“” \t|ß²") for _ in range(rng.randint(0, 40)))
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def check_packing(rows, texts, budget):
    encoder = tokens.encoder()
    by_doc = collections.Counter()
    want = collections.Counter()
    for key, text in texts:
        ids = encoder.ids(text) + b"\0\0\0\0"
        n, start, piece = len(ids) // 4, 0, 0
        stop = n if n <= budget else n % budget or budget
        while start < n:
            want[key, piece, start, stop - start, ids[4 * start : 4 * stop]] += 1
            start, stop, piece = stop, stop + budget, piece + 1
    by_doc.update((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in rows)
    assert by_doc == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= budget
    return len(sequences)


def test_packing_odd_rows(odd, none):
    packed = packing.placed(packing.pieces(odd, 512), 512)
    n = check_packing(packed.collect(), texts_of(odd), 512)
    total = sum(r.length for r in packed.collect())
    assert n <= -(-total // 512) + 3
    assert packing.placed(packing.pieces(none, 512), 512).count() == 0
    assert packing.sequences(packed).agg(F.sum("n_ids")).first()[0] == total


def test_packing_in_groups(odd):
    packed = packing.placed(packing.pieces(odd, 64), 64, group=20)
    assert check_packing(packed.collect(), texts_of(odd), 64) > 20


def test_sum_of_squares_choice():
    where, offset = packing.fill(np.array([6, 6, 5, 5, 4]), 10)
    # 6, 6 open bins with gap 4; 5 opens one and 5 fills it; 4 fills a six.
    assert len(set(where.tolist())) == 3 and offset.tolist() == [0, 0, 0, 5, 6]


# --- 2: chat -----------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["<|im_end|>\n", "<\\|", "<\\\\|x", "a<", "|", "<<||", "\\n\\", "<|im_start|>user\nx<|im_end|>"])
def test_escapes_are_undone(text):
    assert chat.unescaped(chat.escaped(text)) == text and "<|" not in chat.escaped(text)
    assert chat.unescaped_role(chat.escaped_role(text)) == text and "\n" not in chat.escaped_role(text)


def digest(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    learnt = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "Be kind. " * 40), (2, 0, "user", None), (2, 1, None, "x"), (None, None, "assistant", "n")]
    rows += [(1, i, "assistant" if i % 2 else "user", f"<|im_end|> turn {i} " * (i % 9)) for i in range(1, 60)]
    rows += [(3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (3, 1, "assistant", "long " * 3000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("key", F.lit(1))
    made = chat.windows(df, budget=300, history=80)
    want = collections.defaultdict(list)
    for key, _, role, text in sorted(rows, key=lambda r: (r[0] or 0, r[1] or 0, r[2] or "", r[3] or "")):
        want[key].append((role or "", text or ""))
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(made).collect()}
    chars = collections.Counter()
    for w in made.collect():
        chars[w.conv_id] += len(w.text)
        assert w.n_tokens <= 300 or len(chat._TURN.findall(w.text)) <= 2
        if w.conv_id == 1:
            assert w.text.startswith("<|im_start|>system\nBe kind.")
    assert got == {k: (*digest(v), chars[k]) for k, v in want.items()}
    assert chat.read_back(chat.windows(df.filter("false"))).count() == 0


# --- 3: html -----------------------------------------------------------------------------


def test_minimum_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 8)
        z = [rng.uniform(-2, 2) for _ in range(n)]
        ties = {(i, j): rng.random() * 2 for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}

        def cost(label, z=z, ties=ties):
            own = sum(max(x, 0) if not y else max(-x, 0) for x, y in zip(z, label, strict=True))
            return own + sum(w for (i, j), w in ties.items() if label[i] != label[j])

        best = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert cost(html.cut(z, ties)) == pytest.approx(best)


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body>
<header><a href=/>Site</a><p>A tagline of the site that is a fairly long sentence.</p></header>
<nav><ul><li><a href=/a>Menu one</a><li><a href=/b>Menu two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to improve everything that there is to improve.</p></div>
<div id=content><h1>Title &eacute;&nbsp;here</h1><p>First   para &amp; more text, long enough to be prose.<p>Second <b>bold</b>text &lt;tag&gt;
<ul><li>item one<li>item two</ul><div class="ad">Buy now! The best product you can get today, order here.</div><p>Short.</p>
<form><label>Name</label><input></form></div><div class=comments><p>I like this article very much, said a reader.</p></div>
<aside><p>Related things with a long text in a sidebar.</p></aside><footer>&copy; x</footer><script>var a="<p>no</p>"</script>"""


def test_main_text_of_a_page():
    assert html.main_text(PAGE).split("\n") == [
        "Title é here", "First para & more text, long enough to be prose.", "Second boldtext <tag>",
        "item one", "item two", "Short.",
    ]


LONG = "A paragraph that goes on for a while and says many things about the matter at hand. " * 4


def test_the_cut_beats_the_sign():
    """A short line without any mark of its own lies between long paragraphs, or between menus."""
    inside = f"<div><p>{LONG}</p><div>A short line.</div><p>{LONG}</p></div>"
    found = html.blocks(inside)
    assert [c > 0 for c in html.costs(found)] == [True, False, True]
    assert html.main_text(inside).split("\n") == [LONG.strip(), "A short line.", LONG.strip()]
    menus = f"<nav><p>One</p></nav><p>Short.</p><nav><p>Two</p></nav><article><p>{LONG}</p></article>"
    assert [c > 0 for c in html.costs(html.blocks(menus))] == [False, True, False, True]
    assert html.main_text(menus) == LONG.strip()
    advert = f'<article><p>{LONG}</p><p class="ad">{LONG}</p><p>{LONG}</p><section class="comments"><p>{LONG}</p></section></article>'
    assert html.main_text(advert).split("\n") == [LONG.strip()] * 2


@pytest.mark.parametrize(("page", "text"), [
    ("<article><p>A</p><svg width=1><p>B</p></article>", "A\nB"),
    ("<article><p>A <svg><title>no</title><text>no</text></svg>b <math><mi>x</mi></math> c</p></article>", "A b x c"),
    ("<article><p>A <svg/>b <math/> c</p></article>", "A b c"),
    ("<article><map name=m><p>Inside</p></map></article>", "Inside"),
    ("<article><script src=a/>var x = 1;</script><p>A</p><script src='a.js'/>no</script></article>", "A"),
    ("<article><p>A</p><video src=v><p>no</p></article><article><p>B</p></article>", "A\nB"),
    ("<article><p>A</p><noscript><p>no</p></noscript><object><object>no</object>no</object><p>B</p></article>", "A\nB"),
])
def test_what_is_drawn_or_stands_in(page, text):
    assert html.main_text(page) == text


def test_a_long_page():
    page = "<nav><a href=/>Home</a></nav><article>" + f"<p>{LONG}</p>" * 3000 + "</article><footer>End</footer>"
    assert html.main_text(page) == "\n".join([LONG.strip()] * 3000)


def test_cut_off_pages_never_fail():
    for end in range(0, len(PAGE), 7):
        html.main_text(PAGE[:end])
        html.main_text(PAGE[end:])
    assert html.main_text("") == html.main_text("<p") == ""


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    gold = re.compile(r"<article>(.*?)(?:</article>|\Z)", re.S)
    import html as H

    for r in html.texts(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.sub(r"<[^>]*\Z", "", gold.search(r.html)[1])
        parts = [" ".join(H.unescape(re.sub(r"</?b>", "", x).replace("<br>", " ")).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 1), (1, "u", "", 1)], "page_id bigint, url string, html string, text int")
    assert tally(html.texts(odd).collect()) == {(None, None, "", 0): 1, (1, "u", "", 0): 2}
    assert html.texts(odd.filter("false")).count() == 0


# --- 4: toxicity -------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit(docs.filter(~held), labels.filter(~held))
    rows = toxicity.scores(docs.filter(held), model).join(labels, "doc_id").toPandas()
    y, s = rows["toxic"].to_numpy(), rows["score"].rank().to_numpy()
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    assert (s[y == 1].sum() - n1 * (n1 + 1) / 2) / n1 / n0 > 0.93
    predicted = rows["score"] >= 0.5
    assert (predicted == (y == 1)).mean() > 0.95 and (y[predicted] == 1).mean() > 0.9


def test_toxicity_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(odd, labels)
    rows = toxicity.scores(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.fit(odd, labels.filter("toxic = 0")) is None
    assert {r.score for r in toxicity.scores(odd, None).collect()} == {0.0}
    assert toxicity.fit(none, labels) is None
    assert toxicity.scores(none, model).count() == 0


def plain_training(positive, unlabelled, n, prior, seed):
    """The classifier over dense rows, from the definition of the risk: each mean loss on its own."""
    dense = lambda rows: np.array([np.bincount(r, minlength=n) / np.sqrt(max(len(r), 1)) for r in rows])
    p, u = (np.c_[dense(x), np.ones(len(x))] for x in (positive, unlabelled))
    rng, w = np.random.default_rng(seed), np.zeros(n + 1)
    w[-1] = np.log(prior / (1 - prior))
    mean, square, step = np.zeros(n + 1), np.zeros(n + 1), 0
    batches = max(1, -(-len(u) // toxicity.BATCH))

    def loss(x, y, w):  # mean logistic loss if all rows have label y, and its gradient
        z = y * (x @ w)
        return np.logaddexp(0, -z).mean(), -(y / (1 + np.exp(z))) @ x / len(x)

    went_up = 0
    for _ in range(toxicity.EPOCHS):
        ps, us = (np.array_split(rng.permutation(len(x)), batches) for x in (p, u))
        for i, j in zip(ps, us, strict=True):
            if not len(i):
                i = rng.integers(0, len(p), 1)
            (_, g1), (r2, g2), (r3, g3) = loss(p[i], 1, w), loss(p[i], -1, w), loss(u[j], -1, w)
            below = r3 - prior * r2 < 0
            went_up += below
            g = -(g3 - prior * g2) if below else prior * g1 + g3 - prior * g2
            g = g + toxicity.DECAY * w
            step += 1
            mean += 0.1 * (g - mean)
            square += 0.001 * (g * g - square)
            w = w - toxicity.RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return w, went_up


@pytest.mark.parametrize("prior", [0.2, 0.7])
def test_training_equals_a_plain_one(monkeypatch, prior):
    monkeypatch.setattr(toxicity, "BATCH", 60)
    rng = np.random.default_rng(0)
    p = [rng.integers(0, 25, rng.integers(0, 6)) for _ in range(40)]
    u = [rng.integers(5, 50, rng.integers(0, 6)) for _ in range(200)]
    p, u = ([np.unique(x) for x in rows] for rows in (p, u))
    want, went_up = plain_training(p, u, 50, prior, 3)
    assert toxicity.train(toxicity.Rows(p), toxicity.Rows(u), 50, prior, 3) == pytest.approx(want, abs=1e-6)
    assert went_up > 0 or prior < 0.5  # the term that may not fall below zero did at the larger prior


def test_features_are_counted_over_all_rows(spark):
    """A word of few texts tells, though hardly any of them is in the sample that is fitted."""
    rows = [(i, f"common words number {i % 7} " + ("vile" if i % 100 == 0 else "kind")) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 100 == 0).cast("int").alias("toxic"))
    places, _ = toxicity.fit(docs, labels)
    assert len(toxicity.in_use(toxicity.features("vile"), places)) and not len(toxicity.in_use(toxicity.features("common number"), places))


# --- 5: mixing ---------------------------------------------------------------------------


def test_exponents(spark):
    totals = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "src string, tokens long")
    x = mixing.exponent_for_entropy(totals, 0.9)
    w = np.array([1000.0, 100, 10]) ** x
    w /= w.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(0.9, abs=1e-4)
    assert mixing.exponent_for_entropy(totals, 5.0) == 0.0
    x = mixing.exponent_for_repetitions(totals, 4.0, 2000.0)
    w = np.array([1000.0, 100, 10]) ** x
    assert w[2] / w.sum() * 2000 / 10 == pytest.approx(4, abs=1e-3)
    assert (1000 / 10) ** (1 - mixing.exponent_for_repetitions(totals, 1.5)) <= 1.5 + 1e-5


def test_mixing_by_hand(spark):
    rows = [(i, prose(i, 20), "en", s, 1) for i, s in enumerate("a" * 300 + "b" * 40 + "c" * 15)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = mixing.mixed(docs, repetitions=2.0, block=500).collect()
    times = collections.Counter(r._doc.doc_id for r in got)
    assert set(times) == set(range(355)) and all(times[i] == 1 for i in range(300))
    taken = collections.Counter()
    for r in got:
        taken[r._doc.source] += r.n_tokens
    x = mixing.exponent_for_repetitions(mixing.source_totals(docs.select(F.col("source").alias("src"), mixing.token_count(F.col("text")).alias("n_tokens"))), 2.0)
    for source, n in (("a", 300), ("b", 40), ("c", 15)):
        budget = 21 * n * (300 / n) ** (1 - x)
        assert budget - 21 < taken[source] <= budget + 1e-6
    few = mixing.mixed(docs, repetitions=2.0, budget=3000.0, block=500)
    assert 2900 <= few.agg(F.sum("n_tokens")).first()[0] <= 3000


def test_mixing_odd_rows(odd, none):
    out = mixing.remixed(odd)
    assert out.columns == odd.columns
    assert not tally(odd.collect()) - tally(out.collect())  # nothing is lost
    assert mixing.remixed(none).count() == 0


# --- 6: class n-grams --------------------------------------------------------------------


def likelihood(pairs, of, classes):
    member = np.zeros((len(pairs), classes + 1))
    member[np.arange(len(pairs)), of] = 1
    table = member.T @ pairs @ member
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    return f(table) - f(table.sum(axis=0)) - f(table.sum(axis=1))


def test_exchange_leaves_no_better_move():
    pairs = np.random.default_rng(0).poisson(1.0, (31, 31))
    of = brown.exchange(pairs, 4, 20)
    best = likelihood(pairs, of, 4)
    assert best > likelihood(pairs, brown.exchange(pairs, 4, 0), 4)
    for w, c in itertools.product(range(30), range(4)):
        other = of.copy()
        other[w] = c
        assert likelihood(pairs, other, 4) <= best + 1e-6


def check_scores(rows, texts, trained):
    tok = lambda t: [w.encode() for w in WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))] + [None]
    count = collections.Counter(w for key, t in texts if trained(key) for w in tok(t))
    n, v = sum(count.values()), len(count)
    want = collections.Counter()
    for key, t in texts:
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tok(t))
        want[key, len(tok(t)), sum(count[w] > 0 for w in tok(t)), n, round(base, 6)] += 1
    assert want == collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)


def test_scores_odd_rows(odd, none):
    rows = brown.scores(odd, F.col("doc_id") != 5).collect()
    check_scores(rows, texts_of(odd), lambda k: k is not None and k != 5)
    assert all(r.score < 0 and np.isfinite(r.score) for r in rows)
    assert brown.scores(none, F.lit(True)).count() == 0
    assert all(r.n_known == 0 for r in brown.scores(odd, F.lit(False)).collect())


def test_scores_beat_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    rows = brown.scores(docs, train).collect()
    held = [r for r in rows if not r.train]
    check_scores(rows, texts_of(docs), lambda k: zlib.crc32(str(k).encode()) % 7 != 2)
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("small", [False, True])
def test_scores_are_those_of_the_classes(spark, monkeypatch, small):
    """The score again from the words' classes and the texts alone, with one chunk and with many."""
    if small:
        for name, value in {"CHUNK_BYTES": 900, "PAGE_TOKENS": 50, "PART_BYTES": 500}.items():
            monkeypatch.setattr(brown, name, value)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(5)).unionByName(spark.createDataFrame([(-1, None), (-2, "unseen words only")], docs.schema)).coalesce(2)
    train = F.col("doc_id") % 5 != 2
    seen = {}
    fit = brown.fit
    monkeypatch.setattr(brown, "fit", lambda *a: seen.setdefault("made", fit(*a)))
    rows = brown.scores(docs, train).collect()
    check_scores(rows, texts_of(docs), lambda k: k % 5 != 2)
    told = seen["made"].words().collect()
    of, count = {r["word"]: r["class"] for r in told}, {r["word"]: r["c"] for r in told}

    def tokens(text):
        h = (words.hashes(text.encode().lower()) & np.uint64(brown._MASK)).view(np.int64).tolist()
        return [*h, brown.END]

    assert len({of[brown.END]}) == 1 and of[brown.END] == brown.CLASSES
    table = np.full((brown.CLASSES + 1, brown.CLASSES + 1), brown.PRIOR)
    for key, text in texts_of(docs):
        if key % 5 != 2:
            c = [brown.CLASSES, *(of[w] for w in tokens(text))]
            np.add.at(table, (c[:-1], c[1:]), 1)
    mass, different = collections.Counter(), collections.Counter()
    for w, c in count.items():
        mass[of[w]] += c
        different[of[w]] += c > 0
    want = collections.Counter()
    for key, text in texts_of(docs):
        before, score = brown.CLASSES, 0.0
        for w in tokens(text):
            c = of[w]
            score += math.log10(table[before, c] / table[before].sum())
            if c != brown.CLASSES:
                score += math.log10((count[w] + 1) / (mass[c] + different[c] + 1))
            before = c
        want[key, round(score, 6)] += 1
    assert want == collections.Counter((r.doc_id, round(r.score, 6)) for r in rows)


def test_packed_counts():
    for kind in ("u1", "<u2", "<u4", "<i8"):
        for n in (1, 7, 1000):
            x = np.random.default_rng(n).integers(0, 200, n)
            assert (counts.unpacked(counts.packed(x, kind), kind) == x).all()


def test_added_tables(spark):
    rows = spark.range(0, 300, 1, 150)

    def make(batches):
        for batch in batches:
            for i in batch["id"]:
                yield counts.slices(np.arange(10) * i, 3)

    assert counts.added(rows.mapInPandas(make, counts.TABLE), 3).tolist() == [44850 * i for i in range(10)]
    assert not len(counts.added(rows.filter("id < 0").mapInPandas(make, counts.TABLE), 3))


def test_gains_are_those_of_the_likelihood():
    rng = np.random.default_rng(1)
    pairs, of = rng.poisson(0.7, (21, 21)).astype(float), np.append(np.arange(20) % 4, 4)
    member = np.eye(5)[of]
    table, own = member.T @ pairs @ member, np.diag(pairs)[:20]
    right, left = (pairs @ member)[:20], (pairs.T @ member)[:20]
    right[np.arange(20), of[:20]] -= own
    left[np.arange(20), of[:20]] -= own
    got = brown.gains(table, of[:20], right, left, own)
    for w, c in itertools.product(range(20), range(4)):
        other = of.copy()
        other[w] = c
        assert got[w, c] - got[w, of[w]] == pytest.approx(likelihood(pairs, other, 4) - likelihood(pairs, of, 4), abs=1e-6)


def test_classes_of_words_that_are_not_frequent(spark, monkeypatch):
    """Two kinds of words with equal endings, told apart only by what stands around them."""
    monkeypatch.setattr(brown, "FREQUENT", 86)
    rng = random.Random(2)
    others = [f"w{i}" for i in range(80)]  # more frequent words than classes, so that none is empty
    kinds = [[f"{k}{i:03d}ing" for i in range(60)] for k in "xy"]
    pick = lambda ws: ws[0] if rng.random() < 0.5 else rng.choice(ws)
    said = [f"the {pick(kinds[0])} sat" if i % 2 else f"we {pick(kinds[1])} now" for i in range(3000)]
    said = [f"{x} {' '.join(rng.choice(others[k : k + 9]) for k in rng.sample(range(72), 4))}" for x in said]
    docs = spark.createDataFrame([(i, " ".join(said[i * 10 : i * 10 + 10])) for i in range(300)], "doc_id bigint, text string")
    seen = {}
    fit = brown.fit
    monkeypatch.setattr(brown, "fit", lambda *a: seen.setdefault("made", fit(*a)))
    check_scores(brown.scores(docs, F.lit(True)).collect(), texts_of(docs), lambda k: True)
    of = {r["word"]: r["class"] for r in seen["made"].words().collect()}
    hashed = lambda ws: {of[int(x)] for x in (words.hashes(" ".join(ws).encode()) & brown._MASK).view(np.int64)}
    assert not hashed(kinds[0]) & hashed(kinds[1])


# --- 7: quality --------------------------------------------------------------------------


def plain_measures(text):
    w = WORD.findall(text)
    windows = collections.defaultdict(list)
    for i in range(len(w) - 7):
        windows[tuple(w[i : i + 8])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_quality_odd_rows(odd, none):
    got = collections.Counter(tuple(r)[:7] for r in quality.measure(odd).collect())
    assert got == collections.Counter((k, *plain_measures(t)) for k, t in texts_of(odd))
    assert quality.measure(none).count() == 0 and quality.clean(none).count() == 0
    assert quality.clean(odd).columns == odd.columns


def test_lines_are_removed_and_documents_rejected(spark):
    good = prose(1, 120)
    menu = "Home | News | Sport | Weather | Shop | About | Contact"
    rows = [(1, good), (2, f"{menu}\n{good}\nAll rights reserved.\nShort title"), (3, "\n".join(f"{menu} {i}" for i in range(20)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_chars", F.lit(-1))
    out = {r.doc_id: r for r in quality.clean(docs).collect()}
    assert set(out) == {1, 2} and out[1].text == out[2].text == good and out[2].n_chars == len(good)


SEPARATED = [" › ".join("Home News Sport Local Weather Shop About".split()), " • ".join("Home News Sport Local Weather".split()),
             "Tags: red · green · blue · white · black", " ‹ ".join("Home News Sport Local Weather".split())]


@pytest.mark.parametrize("menu", SEPARATED)
def test_separators_outside_latin_1_mark_navigation(spark, menu):
    assert len(WORD.findall(menu)) >= 8  # so that the rule for short lines says nothing
    good = prose(1, 120)
    rows = [(1, f"{menu}\n{good}"), (2, "\n".join(f"{menu} {i}" for i in range(20)))]
    out = quality.clean(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [(r.doc_id, r.text) for r in out] == [(1, good)]


# --- 8: repeated strings -----------------------------------------------------------------


def plain_repeats(texts):
    data = [t.encode() for _, t in texts]
    count = collections.Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = collections.Counter()
    for (key, _), d in zip(texts, data, strict=True):
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if count[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, y in zip(d, gone, strict=True) if not y)
        runs = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out[key, len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_repeats_odd_rows(odd, none):
    small = odd.filter("doc_id IS NULL OR doc_id <> 5 AND doc_id <> 4")
    assert tally(suffix.digests(small).collect()) == plain_repeats(texts_of(small))
    assert suffix.digests(none).count() == 0
    assert suffix.without_repeats(odd).columns == odd.columns


def test_repeats_of_every_kind(spark):
    rng = random.Random(3)
    alphabet = "abcdeé "
    shared = "".join(rng.choice(alphabet) for _ in range(420))
    rows = []
    for i in range(60):
        own = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 500)))
        cut = shared[rng.randint(0, 120) : rng.randint(280, 420)]
        rows.append((i, own + cut * (i % 3) + own[: rng.randint(0, 50)]))
    rows += [(100, "x" * 900), (101, "xy" * 300), (102, "z" * 199), (103, "z" * 199), (104, "q" * 200), (105, "q" * 200)]
    rows += [(200 + i, rows[0][1]) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert tally(suffix.digests(docs).collect()) == plain_repeats(rows)


# --- 9: near duplicates ------------------------------------------------------------------


def plain_classes(texts, threshold=0.8):
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags = [collections.Counter(words.shingles(t.encode(), 5).tolist()) for _, t in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = sum((bags[i] & bags[j]).values())
        either = sum((bags[i] | bags[j]).values())
        if texts[i][1] == texts[j][1] or (either and both / either >= threshold):
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    members = collections.defaultdict(list)
    for i in range(len(texts)):
        members[root(i)].append(i)
    out = collections.Counter()
    for group in members.values():
        keys = [texts[i][0] for i in group]
        known = [k for k in keys if k is not None]
        for k in keys:
            out[k, min(known) if known else None, len(keys)] += 1
    return out


def test_near_duplicates_odd_rows(odd, none):
    assert tally(minhash.classes(odd).collect()) == plain_classes(texts_of(odd))
    assert minhash.classes(none).count() == 0
    once = minhash.one_per_class(odd).collect()
    assert len(once) == len({r[1] if r[1] is not None else r for r in plain_classes(texts_of(odd))})


def test_near_duplicate_groups(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for g in range(3):
        base = [f"g{g}w{i}" for i in range(150)]
        for i in range(70):
            text = list(base)
            for _ in range(rng.randint(0, 12)):
                text[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(text[: rng.choice([150, 150, rng.randrange(115, 150)])])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = plain_classes(rows)
    assert 3 < len({r[1] for r in want}) < 200
    assert tally(minhash.classes(docs).collect()) == want
    monkeypatch.setattr(minhash, "BLOCK", 16)
    assert tally(minhash.classes(docs).collect()) == want
    wider = plain_classes(rows, 0.7)
    assert len({r[1] for r in wider}) < len({r[1] for r in want})
    assert tally(minhash.classes(docs, 0.7).collect()) == wider


def test_darts_estimate_similarity():
    base = [f"w{i}" for i in range(400)]
    other = base[:340] + [f"v{i}" for i in range(60)]
    a, b = (minhash.cells(words.shingles(" ".join(x).encode(), 5)) for x in (base, other))
    sa, sb = minhash.signatures([a, b], 2048)
    share = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert (sa == sb).mean() == pytest.approx(share, abs=0.04)


# --- 10: fingerprints --------------------------------------------------------------------


def test_fingerprints_are_homomorphic():
    a, b = "One line.\nTwo lines.\n\nx", "Three.\nTwo lines."
    assert multiset.added(multiset.fingerprint(a), multiset.fingerprint(b)) == multiset.fingerprint(a + "\n" + b)
    assert multiset.added(multiset.fingerprint(a + "\n" + b), multiset.fingerprint(b), -1) == multiset.fingerprint(a)
    assert multiset.fingerprint("b\na") == multiset.fingerprint("a\nb") != multiset.fingerprint("a\n\nb")


def test_counting_lanes_hold_long_repetitive_texts():
    a, b, c = (multiset.fingerprint("\n".join(["8 bytes."] * n)) for n in (40_000, 30_000, 10_000))
    assert multiset.likeness([a], [b])[0] == pytest.approx(0.75)
    assert multiset.added(b, c) == a and multiset.added(a, c, -1) == b


def test_fingerprints_odd_rows(odd, none):
    rows = multiset.with_edits(odd).collect()
    order = sorted(set(texts_of(odd)), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).digest()))
    after = {r: order[(i + 1) % len(order)][1] for i, r in enumerate(order)}
    want = collections.Counter()
    for row in texts_of(odd):
        text = row[1]
        room = len(text) // 2
        edited = text[: len(text) - room] + after[row][:room]
        want[row[0], len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert multiset.with_edits(none).count() == 0
    one = multiset.with_edits(odd.filter("doc_id = 6")).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(6, 1.0)]
