"""Language identification, ranked search and spelling variants against brute-force versions."""
import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import common as C
from riskloom.llm import op11_language_id as o11
from riskloom.llm import op12_treap_search as o12
from riskloom.llm import op13_spelling as o13
from tests.llm.conftest import DOCS, odd_rows, para

LOWER = {c: c + 32 for c in range(65, 91)}


# --- language identification ----------------------------------------------------

WORDS = {"aa": "the and of ing tion er that with is", "bb": "le la des qui ment eau pour ère çon", "cc": "der die und ich sch ung keit für über"}


def language_rows(n=120, seed=4):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = sorted(WORDS)[k % 3]
        parts = WORDS[lang].split()
        text = " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60)))
        rows.append((k, text, lang, "s", len(text)))
    return rows


def slow_vector(text, idf):
    """The documented vector, from the text itself and gram by gram."""
    b = re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b" ", text.encode()).lower() if text else b""
    b = b" " + b.lstrip(b" ") if b.strip(b" ") else b" "
    tf = collections.Counter()
    for n in (1, 2, 3):
        for k in range(len(b) - n + 1):
            code = np.array([int.from_bytes(b[k:k + n], "big")], np.uint32)
            tf[int(o11._bucket(code, n)[0])] += 1
    v = np.zeros(o11.DIMS)
    for d, c in tf.items():
        v[d] = (1 + math.log(c)) * idf[d]
    return v / max(np.linalg.norm(v), 1e-12)


def test_op11_held_out_languages(spark):
    rows = language_rows()
    docs = spark.createDataFrame(rows, DOCS)
    got = {r.doc_id: r for r in o11.language_id(docs).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 15 and all(got[r[0]].held_out for r in held) and sum(g.held_out for g in got.values()) == len(held)
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    assert all(0 <= g.score <= 1 for g in got.values())
    # A held-out row's lang and source change nothing.
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "zz").otherwise(F.col("lang"))) \
        .withColumn("source", F.lit("other"))
    assert {r.doc_id: r for r in o11.language_id(other).collect()} == got


def test_op11_vectors_and_nearest_centroid(spark):
    rows = language_rows(40) + [(900, "İé  ß!!x\t\n", "aa", "s", 1), (901, "  lead and trail  ", "bb", "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    C.prepare(spark)
    model = o11.train(docs)
    trained = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    df = sum((slow_vector(r[1], np.ones(o11.DIMS)) > 0).astype(int) for r in trained)
    assert np.allclose(model.idf, np.log((1 + len(trained)) / (1 + df)) + 1, atol=1e-5)
    raw, off = C.string_buffers(pa.array([r[1] for r in rows]))
    fast = o11.vectors(o11.gram_counts(raw, off), model.idf)
    slow = np.array([slow_vector(r[1], model.idf) for r in rows])
    assert np.allclose(fast, slow, atol=1e-5)
    got = {r.doc_id: r for r in o11.identify(docs, model).collect()}
    for r, v in zip(rows, slow):
        cos = model.centroids.astype(float) @ v
        assert got[r[0]].score == pytest.approx(cos.max(), abs=1e-5)
        assert cos[[k for k, x in enumerate(model.langs) if x == got[r[0]].lang_pred]].max() == pytest.approx(cos.max(), abs=1e-5)


def test_op11_odd_rows(spark, odd, odd_wide, no_docs):
    got = collections.defaultdict(list)
    for r in o11.language_id(odd).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(odd_rows()) and len(got[10]) == 2 and got[10][0] == got[10][1]
    for d in (4, 5, 6):
        assert (got[d][0].lang_pred, got[d][0].score, got[d][0].rejected) == ("und", 0.0, True)
    assert all(g.lang_pred in {"en", "fr", "de", "es"} for d in got if d not in (4, 5, 6) for g in got[d])
    key = lambda rows: sorted(map(str, rows))                                                     # noqa: E731
    assert key(o11.language_id(odd_wide).collect()) == key(r for rs in got.values() for r in rs)
    assert o11.language_id(no_docs).count() == 0
    unlabelled = o11.language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"} and len(unlabelled) == len(odd_rows())


def test_op11_rejects_what_is_far_from_every_centroid(spark):
    docs = spark.createDataFrame(language_rows(90), DOCS)
    C.prepare(spark)
    model = o11.train(docs)
    far = spark.createDataFrame([(1, "zqxj kwvz qqxz jjkz", None, None, 1), (2, WORDS["aa"], None, None, 1)], DOCS)
    got = {r.doc_id: r for r in o11.identify(far, model).collect()}
    assert got[1].rejected and got[1].accepted_lang is None and got[1].lang_pred in WORDS
    assert not got[2].rejected and got[2].accepted_lang == "aa"


def test_op11_clusters_are_nearer_than_one_mean():
    rng = np.random.default_rng(1)
    x = np.abs(rng.normal(0, 0.02, (90, o11.DIMS)))
    for k in range(3):
        x[30 * k:30 * k + 30, 50 * k:50 * k + 20] += 1
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    centre, own = o11.cluster(x)
    mean = x.mean(axis=0) / np.linalg.norm(x.mean(axis=0))
    assert len({tuple(own[30 * k:30 * k + 30]) and int(own[30 * k]) for k in range(3)}) == 3
    assert (x * centre[own]).sum(axis=1).mean() > (x @ mean).mean() + 0.1


# --- ranked search -----------------------------------------------------------------

def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def brute_search(docs, items, top=50):
    own = [(d, collections.Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = collections.Counter(t for _, c in own for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for d, c in own:
            n = sum(c.values())
            score = 0
            for t in set(terms(text)):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


ITEMS = [(1, para(50, 20)), (2, para(51, 25) + " " + para(1, 30)), (2, "one two"), (3, None), (4, ""), (5, "?! -- "), (6, "Ünï 漢字 x" + "x" * 29999),
         (None, para(2, 40)), (7, "nowhereword"), (1, para(50, 20)), (8, para(1, 120) + para(52, 30) + " ONE one two")]


def test_op12_equals_brute_force(spark, odd, odd_wide, no_docs, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(r[0], r[1]) for r in odd_rows()]
    want = brute_search(rows, [x for x in ITEMS if x[1] is not None], 50)
    key = lambda df: sorted(((r["item_id"], r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)     # noqa: E731
    assert len(want) > 60 and key(o12.lexical_search(odd, items)) == want
    assert key(o12.lexical_search(odd_wide, items.withColumn("score", F.lit("clash")).withColumn("n", F.lit(1)))) == want
    # Small blocks of documents and of items: same rows.
    monkeypatch.setattr(o12, "BLOCK_DOCS", 4)
    monkeypatch.setattr(o12, "ITEM_BYTES", 400)
    assert key(o12.lexical_search(odd, items)) == want
    assert key(o12.lexical_search(odd, items, top=3)) == brute_search(rows, [x for x in ITEMS if x[1] is not None], 3)
    assert o12.lexical_search(no_docs, items).count() == 0
    assert o12.lexical_search(odd, items.limit(0)).count() == 0


def test_op12_treap_maxima_and_pruning(monkeypatch):
    monkeypatch.setattr(o12, "OPEN_MOST", 16)        # a small grid: no wider steps than at first
    rng = np.random.default_rng(3)
    cell = np.unique(rng.integers(0, 64 * 1024, 4000))
    row, col = cell // 1024, cell % 1024
    impact = rng.integers(1, 1000, len(cell)) * np.where(col < 96, 50, 1)      # a few documents are far better than the rest
    grid = np.zeros((64, 1024), np.int64)
    grid[row, col] = impact
    treap = o12.Treap(row, col, impact, 10)
    assert treap.most[0] == grid.max() and treap.none == len(treap.nibble) - 1
    # Every cell is found by its path, with the maximum of its quadrant on the way.
    node = np.zeros(len(row), np.int64)
    for depth in range(10):
        assert (treap.most[node] >= impact).all()
        bit = 9 - depth
        node = treap.children(node, 2 * (row >> bit & 1) + (col >> bit & 1))
    assert (treap.most[node] == impact).all()
    opened = 0
    children = treap.children

    def counted(node, quadrant):
        nonlocal opened
        opened += len(node)
        return children(node, quadrant)
    treap.children = counted
    ids = np.arange(1024) * 3
    empty = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    for _ in range(20):
        rows = np.sort(rng.choice(64, 4, replace=False))
        total = grid[rows].sum(axis=0)
        order = sorted((-s, i) for s, i in zip(total.tolist(), ids.tolist()) if s)[:5]
        opened = 0
        scores, docs = o12.search(treap, rows, ids, 5, empty)
        assert list(zip((-scores).tolist(), docs.tolist())) == order
        assert opened < 2 * 1024                     # visiting all documents opens 2047 states for each half
    # With bounds that say nothing every range is opened: the maxima carry the search.
    rows = np.array([1, 2, 3, 4])
    opened = 0
    o12.search(treap, rows, ids, 5, empty)
    pruned = opened
    treap.most = np.where(np.arange(len(treap.most)) < len(treap.most) - 1 - len(row), 10**9, treap.most)
    opened = 0
    o12.search(treap, rows, ids, 5, empty)
    assert pruned < 0.5 * opened


def test_op12_empty_treap_and_ties():
    none = np.zeros(0, np.int64)
    assert len(o12.search(o12.Treap(none, none, none, 3), np.array([0]), np.arange(8), 5, (none, none))[0]) == 0
    # Equal scores: the smallest ids win, whatever came first.
    treap = o12.Treap(np.zeros(8, np.int64), np.arange(8), np.full(8, 7), 3)
    best = o12.search(treap, np.array([0]), np.arange(8) + 100, 3, (np.array([7]), np.array([101])))
    assert best[1].tolist() == [100, 101, 101]


# --- spelling variants ----------------------------------------------------------------

def one_error(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_groups(counts):
    out = {}
    for w, n in counts.items():
        near = sorted((-counts[v], v) for v in counts if one_error(w, v))
        form = near[0] if near and -near[0][0] >= 5 * n else None
        out[w] = (n, len(near), form and form[1], form and -form[0])
    root = {}
    for w in counts:
        r = w
        while out[r][2]:
            r = out[r][2]
        root[w] = r
    return {(w, f, root[w], n, k, fn) for w, (n, k, f, fn) in out.items()}


def brute_words(rows):
    counts = collections.Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{d}:{w}".encode())
            if d is not None and h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def vocabulary(seed, n, alphabet="abé"):
    rng = random.Random(seed)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(6, 9))) for _ in range(n)}
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "baaaaaa", "aaaaaab", "aabaaa", "xaabaaa", "z" * 70, "z" * 71, "z" * 35 + "y" + "z" * 35, "ñandúes",
              "ñandues", "×÷×÷×÷", "×÷×÷×"  + "×÷"}
    return {w: int(5 * 6 ** rng.random() ** 4 * (1 + 40 * (rng.random() < 0.1))) for w in sorted(words)}


@pytest.mark.parametrize("hot_words,symbols", [(20_000, 1_500_000), (4, 300), (1, 40)])
def test_op13_groups_equal_brute_force(spark, monkeypatch, hot_words, symbols):
    monkeypatch.setattr(o13, "BLOCK_SYMBOLS", symbols)
    monkeypatch.setattr(o13, "SEARCHES", 57)
    counts = vocabulary(7, 260)
    words = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    got = [tuple(r) for r in o13.spelling_groups(words, hot_words).collect()]
    assert len(got) == len(counts) and set(got) == brute_groups(counts)


def test_op13_keys_split_hot_groups(spark):
    C.prepare(spark)
    counts = vocabulary(9, 400, "ab")
    words = spark.createDataFrame(sorted(counts.items()), "word string, n long")
    index, asks = o13.keyed(words, 3)
    most = index.where("length - prefix - suffix > 1").groupBy("key").count().agg(F.max("count")).first()[0]
    assert most <= 3                                 # words of one key differ in one place only, or are few
    assert index.select("word").distinct().count() == len(counts)


def test_op13_corpus_words(spark, odd, odd_wide, no_docs):
    rng = random.Random(5)
    vocab = [w for w in vocabulary(3, 40)] + ["Überzug", "ÜBERzug", "short", "naïveté"]
    rows = [(k if k % 17 else None, " ".join(rng.choice(vocab) for _ in range(60)) + rng.choice(["", "1", "'s", "x-ray", "漢字abcdefg漢", "ÿÿÿÿÿÿ"]),
             "en", "s", 1) for k in range(150)] + odd_rows()
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want = brute_words([(r[0], r[1]) for r in rows])
    got = {r.word: r.n for r in o13.corpus_words(docs).collect()}
    assert got == want and len(got) > 40
    wide = docs.withColumn("word", F.lit("clash")).withColumn("n", F.lit("clash"))
    assert {tuple(r) for r in o13.spelling_groups(o13.corpus_words(wide)).collect()} == brute_groups(want)
    assert {r.word: r.n for r in o13.corpus_words(odd_wide).collect()} == brute_words([(r[0], r[1]) for r in odd_rows()])
    assert o13.spelling_groups(o13.corpus_words(no_docs)).count() == 0


def test_op13_index_intervals_stay_in_step():
    words = sorted({w.encode("latin-1") for w in vocabulary(11, 80)})
    index = o13.BidirectionalIndex(words)
    text = b"\0" + b"\0".join(words) + b"\0"
    rng = random.Random(6)
    for _ in range(60):
        w = rng.choice(words)
        i = rng.randint(0, len(w) - 3)
        j = rng.randint(i + 2, len(w))
        lo, rlo, size = np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([len(text)])
        left, right = rng.randint(i, j - 1), None
        right = left
        while left > i or right < j:                 # grow on either side at random
            side = right < j and (left == i or rng.random() < 0.5)
            c = w[right] if side else w[left - 1]
            lo, rlo, size = index.extend(side, lo, rlo, size, np.array([index.code[c]]))
            right, left = (right + 1, left) if side else (right, left - 1)
        assert size[0] == len(re.findall(b"(?=" + re.escape(w[i:j]) + b")", text))


def test_op13_crc_of_runs():
    runs = ["abcdef", "überzug", "ÿ" * 9, "x" * 63, "y" * 64, "z" * 65, "é" * 80]
    text = np.frombuffer("".join(runs).encode("latin-1"), np.uint8)
    size = np.array([len(r) for r in runs])
    end = np.cumsum(size)
    seeds = np.array([zlib.crc32(f"{k}:".encode()) for k in range(len(runs))], np.uint32)
    assert o13._crc(text, end - size, end, seeds).tolist() == [zlib.crc32(f"{k}:{r}".encode()) for k, r in enumerate(runs)]
