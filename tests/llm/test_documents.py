"""Each operator on documents against a brute-force version, over odd rows."""
import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import (op1_ngram_join as o1, op2_packing as o2, op3_lm_scoring as o3, op4_hilbert_shards as o4, op5_quality as o5,
                          op6_licenses as o6, op7_decontaminate as o7, op8_token_counts as o8, op9_simhash as o9)
from riskloom.llm import common as C
from tests.llm.conftest import odd_rows, para

LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows):
    """component of each row index by brute force."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = {}
    for g in groups.values():
        least = min((rows[i][0] for i in g if rows[i][0] is not None), default=None)
        for i in g:
            out[i] = least if sets[i] else rows[i][0]
    return sets, out


def test_word_hashes_match_words():
    import pyarrow as pa
    texts = ["a b  a\tB", "", None, "é x y", "end", " lead"]
    raw, off = C.string_buffers(pa.array(texts))
    h, start, end, first = C.words_of(raw, off)
    seen = {}
    for r, t in enumerate(texts):
        ws = words(t)
        assert first[r + 1] - first[r] == len(ws)
        for k, w in enumerate(ws):
            assert raw[start[first[r] + k]:end[first[r] + k]].tobytes().decode().translate(LOWER) == w
            assert seen.setdefault(w, h[first[r] + k]) == h[first[r] + k]
    assert len(set(seen.values())) == len(seen)


def test_op1_odd_rows(odd_wide):
    rows = [(r[0], r[1]) for r in odd_rows()]
    sets, comp = components(rows)
    want = sorted(((d, len(sets[i]), comp[i]) for i, (d, _) in enumerate(rows)), key=str)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in o1.ngram_join(odd_wide).collect()), key=str)
    assert got == want


def test_op1_links_of_texts_without_doc_id(spark):
    def edited(seed, *at):
        w = para(seed, 100).split()
        for k in at:
            w[k] = f"edit{k}"
        return " ".join(w)
    chain = [edited(31, *range(10 * k, 10 * k + 3)) for k in range(3)]
    left, middle, right = edited(32), edited(32, 0, 1, 2, 3, 4, 5, 6), edited(32, 0, 1, 2, 3, 4, 5, 6, 93, 94, 95, 96, 97, 98, 99)
    rows = [(7, edited(30)), (None, edited(30, 50)), (None, edited(30)),         # a near and an exact copy
            (1, left), (None, middle), (2, right),                               # a chain
            (None, edited(33)), (None, edited(33, 20)), (None, edited(33)),      # a group without ids
            (None, edited(34)), (None, None), (40, edited(35)), (40, edited(30, 10))] \
        + [(50 + k if k != 1 else None, t) for k, t in enumerate(chain)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets, comp = components(rows)
    assert comp[1] == 7 and comp[5] == 1 and comp[7] is None
    want = sorted(((d, len(sets[i]), comp[i]) for i, (d, _) in enumerate(rows)), key=str)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in o1.ngram_join(df).collect()), key=str)
    assert got == want
    kept = [(r.doc_id, r.text) for r in o1.keep_one(df).collect()]
    assert sum(k in ((None, edited(33)), (None, edited(33, 20))) for k in kept) == 1
    ids = {(comp[i], d) for i, (d, _) in enumerate(rows) if comp[i] is not None and d == comp[i]}
    assert sorted((k for k in kept if k[0] is not None)) == sorted((d, t) for i, (d, t) in enumerate(rows) if (comp[i], d) in ids and comp[i] == d)
    assert sorted((k for k in kept if k[0] is None and k[1] in (None, edited(34))), key=str) == sorted([(None, None), (None, edited(34))], key=str)
    assert len(kept) == len(ids) + 3


def test_op1_groups_of_near_copies(spark):
    base = para(9, 200).split()
    rows, k = [], 0
    for g in range(4):
        own = para(100 + g, 150).split()
        for c in range(40):
            w = list(own)
            for e in range(c % 4):
                w[(c * 7 + e * 31) % 150] = f"edit{c}x{e}"
            rows.append((k, " ".join(w + base[:30 * (g % 2)])))   # half of the groups share a passage
            k += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets, comp = components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in o1.ngram_join(df).collect()}
    assert got == {d: (len(sets[i]), comp[i]) for i, (d, _) in enumerate(rows)}
    assert sorted(r.doc_id for r in o1.keep_one(df).collect()) == sorted(set(comp.values()))


def _near_rows():
    rows, k = [], 0
    for g in range(6):
        own = para(400 + g, 120).split()
        for c in range(5):
            w = list(own)
            w[c * 9:c * 9 + c] = [f"edit{c}x{e}" for e in range(c)]
            rows += [(k, " ".join(w))] * (1 + c % 2)                  # every other row comes twice
            k += 1
    return rows + [(None, para(400, 120)), (None, None), (None, None), (90, ""), (90, "")]


@pytest.mark.parametrize("bits", [8, 1 << 20])
def test_op1_rows_that_share_a_bit(spark, monkeypatch, bits):
    """Bitmaps only spare work: with nearly every bit set the results are those of the joins."""
    monkeypatch.setattr(o1, "_bitmap_bits", lambda n: bits)
    rows = _near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sets, comp = components(rows)
    want = sorted(((d, len(sets[i]), comp[i]) for i, (d, _) in enumerate(rows)), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in o1.ngram_join(df).collect()), key=str) == want
    firsts = {(d, t) for i, (d, t) in enumerate(rows) if d is not None and comp[i] == d and sets[i]}
    assert sorted(((r.doc_id, r.text) for r in o1.keep_one(df).collect()), key=str) == sorted(firsts | {(None, None), (90, "")}, key=str)


def test_op1_sets_are_made_without_moving_texts(spark, monkeypatch):
    plans, real, write = [], o1._sets_of, o1.C.materialize

    def seen(*args):
        sets, shared = real(*args)
        plans.append(sets._jdf.queryExecution().executedPlan().toString())
        return sets, shared
    monkeypatch.setattr(o1, "_sets_of", seen)
    df = spark.createDataFrame(_near_rows(), "doc_id long, text string").repartition(4)
    o1.ngram_join(write(df, "rows")).collect()
    assert plans and all("Exchange" not in p and "Join" not in p for p in plans)


def test_written_tables_leave_no_shuffle_files(spark):
    import time

    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {f for f in found.split("\n") if "/shuffle_" in f}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, kept = files(), spark.conf.get(key)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().join(spark.range(7).withColumnRenamed("id", "k").hint("merge"), "k")
    out = C.materialize(df, "freed")
    for _ in range(100):                                    # files go in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(key) == kept
    assert sorted((r.k, r["count"]) for r in out.collect()) == sorted((r.k, r["count"]) for r in df.collect())
    with pytest.raises(ZeroDivisionError), C.shuffles_freed(spark):
        1 / 0
    assert spark.conf.get(key) == kept


def test_small_tables_are_written_as_few_files(spark):
    rows = [(k % 50, None if k % 3 else f"t{k}") for k in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(30)
    assert len(C.materialize(df, "many").inputFiles()) == 30
    few = C.materialize(df, "few", rows=120)
    assert len(few.inputFiles()) == 1 and few.schema == df.schema
    assert sorted((tuple(r) for r in few.collect()), key=str) == sorted(rows, key=str)
    assert len(C.materialize(df, "large", rows=C.SMALL_ROWS + 1).inputFiles()) == 30


@pytest.mark.parametrize("hot_list", [64, 1])
def test_op1_files_do_not_follow_the_shuffle_partitions(spark, monkeypatch, hot_list):
    """Each file written costs an executor processes, so the tables between the steps have few of them."""
    files, real = {}, C.materialize

    def seen(df, name, *rows):
        out = real(df, name, *rows)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out
    monkeypatch.setattr(o1, "HOT_LIST", hot_list)
    docs = real(spark.createDataFrame(_near_rows(), "doc_id long, text string").repartition(3), "rows")
    monkeypatch.setattr(C, "materialize", seen)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = o1.keep_one(docs).collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    sets, comp = components(_near_rows())
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted({c for c in comp.values() if c is not None})
    by_input = {"op1-scan", "op1-lists"}                  # work of their own in each task
    assert {"op1-cc1", "op1-mixed", "op1-found", "op1-marked", *["op1-apart"] * (hot_list == 1)} <= set(files)
    assert all(n <= 1 for name, n in files.items() if name not in by_input), files


def test_op1_prefix_bound_holds():
    """Linked sets share at least the demanded number of prefix shingles in any order."""
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 80))
        a = set(range(n))
        b = {x for x in a if rng.random() > 0.1} | {1000 + x for x in range(int(rng.integers(0, 8)))}
        if not b or len(a & b) * 5 < len(a | b) * 4:
            continue
        order = {x: k for k, x in enumerate(rng.permutation(sorted(a | b)))}
        pre = [set(sorted(s, key=order.get)[:int(o1.prefix_length(np.array(len(s))))]) for s in (a, b)]
        need = (4 * (len(a) + len(b)) + 8) // 9 - (4 * max(len(a), len(b)) + 4) // 5 + 1
        assert len(pre[0] & pre[1]) >= need


def test_components_of_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200 + i, 200) for i in range(1, 30)], "a long, b long")
    got = {r.node: r.component for r in C.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{200 + i: 200 for i in range(30)}}


def test_op2_round_trip(odd_wide):
    from tokenizers import Tokenizer
    import public_tokenizers
    tok = Tokenizer.from_file(public_tokenizers.path(o2.TOKENIZER))
    want = []
    for d, t, *_ in odd_rows():
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(d, k // 4096, k, len(ids[k:k + 4096]), zlib.crc32(ids[k:k + 4096].tobytes())) for k in range(0, len(ids), 4096)]
    got = o2.pack_documents(odd_wide).collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    at = collections.defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for v in at.values():
        end = 0
        for o, n in sorted(v):
            assert o == end
            end += n
        assert end <= 4096


def test_op2_evolution_keeps_every_piece():
    import random
    rng = random.Random(1)
    size = [rng.randint(1, 900) for _ in range(200)]
    first = o2.first_packing(size, 1000, rng, 0.3)
    best = o2.evolve(size, [], 1000, 5)
    bins = o2._bins_of(best[0][1])
    assert sorted(i for b in bins for i in b) == list(range(200))
    assert all(sum(size[i] for i in b) <= 1000 for b in bins) and len(bins) <= len(first)
    child = o2.cross(bins, first, size, 1000, rng)
    assert sorted(i for b in child for i in b) == list(range(200))


def test_op3_brute_force(odd_wide):
    rows = [(r[0], words(r[1]) + ["</s>"]) for r in odd_rows()]
    held = [d is not None and zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in rows]
    uni, bi, docs = collections.Counter(), collections.Counter(), 0
    for (d, w), h in zip(rows, held):
        if not h:
            uni.update(w)
            bi.update(zip(["<s>"] + w, w))
            docs += 1
    n, v, followers = sum(uni.values()), len(uni), collections.Counter(a for a, _ in bi)
    seen = {**uni, "<s>": docs}
    p = lambda w: (uni[w] + 0.5) / (n + 0.5 * (v + 1))
    want = []
    for (d, w), h in zip(rows, held):
        s = 0.0
        for a, b in zip(["<s>"] + w, w):
            c, t = seen.get(a, 0), followers[a]
            s += math.log10(p(b) if c + t == 0 else (bi[a, b] + t * p(b)) / (c + t))
        want.append((d, h, len(w), sum(uni[x] > 0 for x in w), n, round(sum(math.log10(p(x)) for x in w), 6), round(s, 6)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
           for r in o3.lm_scores(odd_wide).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_op4_curve_is_continuous(spark, dims, bits):
    grid = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=dims)), ", ".join(f"c{k} int" for k in range(dims)))
    at = sorted(tuple(r) for r in grid.select(o4.hilbert_index([f"c{k}" for k in range(dims)], bits), "*").collect())
    assert [r[0] for r in at] == list(range(1 << bits * dims))
    assert all(sum(abs(x - y) for x, y in zip(a[1:], b[1:])) == 1 for a, b in zip(at, at[1:]))


def test_op4_law(odd_wide):
    got = o4.hilbert_shards(odd_wide, shards=7).collect()
    text = collections.Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in odd_rows())
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == text
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(7)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op5_learns_and_scores_all(spark, no_docs):
    rows, labels = [], []
    for k in range(240):
        junk = k % 3 == 0
        text = "".join(f"{w}%%% " for w in para(k, 40).split()) if junk else para(k, 40 + k % 200)
        rows.append((k, text))
        labels.append((k, 0 if junk else 1, 0))
    rows += [(1000, None), (1001, ""), (1002, para(5, 3000)), (None, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels + [labels[0], (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in o5.quality_scores(docs, lab).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(d, q) for d, q, _ in labels if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum(got[d].predicted == q for d, q in held) >= 0.95 * len(held)
    assert o5.quality_scores(docs, lab.limit(0)).where("predicted = 0").count() == 0
    wide = docs.withColumn("score", docs.doc_id)
    assert o5.keep_good(wide, lab).columns == wide.columns


def test_op5_chunks_cover_every_byte():
    raw = np.arange(1, 250, dtype=np.uint8).repeat(9)
    off = np.array([0, 0, 5, 520, len(raw)])
    x, row = o5.chunk_matrix(raw, off)
    for r in range(4):
        text = raw[off[r]:off[r + 1]]
        mine = x[row == r]
        joined = np.concatenate([mine[0]] + [c[o5.CHUNK - o5.STEP:] for c in mine[1:]])
        assert (joined[:len(text)] == text).all() and not joined[len(text):].any()


def test_op6_brute_force_and_templates(odd_wide):
    got = {}
    for r in o6.license_scan(odd_wide).collect():
        got.setdefault(r.doc_id, r)
    for d, t, *_ in odd_rows():
        assert got[d].n_words == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER)))
    assert got[12].base_labels == "mit" and got[12].labels == "mit,mit-notice" and got[12].score == 1.0
    assert got[5].labels == "" and got[5].first_word is None

    def labels(text):
        base, found, score = o6.scan_words(text.split(), o6.PHRASES, o6.TEMPLATES)
        return {x for x, _, _ in base}, {x for x, _, _ in found}, score
    assert labels("this work is licensed under the gnu general public license version 3") == ({"gpl"}, {"gpl-notice"}, 1.0)
    assert labels("licensed under cc by nc 4 0") == ({"cc-by"}, {"cc-by-nc-notice"}, 1.0)
    assert labels("licensed under cc by 4 0")[1] == {"cc-by-notice"}
    _, found, score = labels("licensed under the apache licence version 2 0")
    assert not found and 0 < score < 1
    m = o6.Automaton("a [[b {{x:1-2}} c]] (d|e)")
    for text, end in (("a d", 2), ("a b z c e", 5), ("a b z z c e", 6), ("a b c e", -1), ("a b z z z c e", -1), ("a x", -1)):
        assert m.match(text.split(), 0)[0] == end


def test_op6_finds_whatever_phrases_and_templates_are_passed(spark):
    rows = [(1, "this is in the Public Domain now"), (2, "all rights reserved by us"), (3, "nothing here"), (4, "free of charge"),
            (5, "under the MIT license"), (6, "no charge at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = o6.license_scan(df, {"public domain": "pd", "mit license": "mit"},
                          {"arr": "all rights reserved [[by {{who:1-3}}]]", "free": "(free|no) [[of]] charge"}).collect()
    assert {r.doc_id: r.labels for r in got} == {1: "pd", 2: "arr", 3: "", 4: "free", 5: "mit", 6: "free"}
    got = o6.license_scan(df, {}, {"choice": "(free|nothing) [[of charge]]"}).collect()
    assert {r.doc_id for r in got if r.labels} == {3, 4}
    assert set(o6.needed(o6.PHRASES, o6.TEMPLATES)) == {b"licen", b"cc", b"permission", b"redistribut"}
    assert o6.needed({}, {"any": "[[a]]"}) == (b"",)


def test_op7_brute_force(spark, odd_wide):
    items = [(1, para(71, 40)), (2, para(72, 25)), (3, para(73, 3)), (4, None), (5, ""), (None, para(75, 30))]
    hit = para(71, 40).upper().split()
    rows = [(1, "pre fix " + para(71, 40) + " tail"), (2, " ".join(hit[:20]) + " ! , " + " ".join(hit[20:])),
            (3, " ".join(hit[:38] + ["new"] + hit[39:])), (4, para(72, 25)), (5, " ".join(para(72, 25).split()[:12])),
            (6, "so " + para(73, 3) + " end"), (7, None), (8, ""), (9, para(75, 30)), (10, para(400, 3000) + " " + para(72, 25))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in o7.contamination(docs, bench).collect()}

    def norm(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    want = set()
    for d, t in rows:
        for i, u in items:
            w, x = norm(t), norm(u)
            k = min(5, len(x))
            item = collections.Counter(tuple(x[j:j + k]) for j in range(len(x) - k + 1)) if x else None
            for a in range(max(1, len(w) - len(x) + 1) if x and w else 0):
                win = w[a:a + len(x)]
                mine = collections.Counter(tuple(win[j:j + k]) for j in range(len(win) - k + 1))
                if mine and sum((mine & item).values()) >= 0.8 * sum((mine | item).values()):
                    want.add((d, -1 if i is None else i))
    assert got == want and (3, 1) in got and (5, 2) not in got
    clean = o7.clean_documents(docs, bench)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in want}
    assert o7.clean_documents(odd_wide, bench).columns == odd_wide.columns
    assert o7.contamination(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("hot_list", [64, 2])
def test_op1_long_lists_through_differences(spark, monkeypatch, hot_list):
    """Near copies of one text with 1 to 6 edits, some of them shared, some cut: every link, none more."""
    import random
    rng = random.Random(11)
    monkeypatch.setattr(o1, "HOT_LIST", hot_list)
    base = para(77, 110).split()
    rows = []
    for d in range(90):
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(len(w))
            w[at] = rng.choice(["same", f"own{d}"])
        if rng.random() < 0.2:
            w = w[rng.randint(0, 12):]
        rows.append((d, " ".join(w)))
    rows += [(200 + k, para(300 + k, 30) + " " + " ".join(base[:20])) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, want = components(rows)
    assert {r.doc_id: r.component_id for r in o1.ngram_join(docs).collect()} == {rows[i][0]: c for i, c in want.items()}
    assert 5 < len(set(want.values())) < 100


@pytest.mark.parametrize("hot_list", [64, 8, 1])
def test_op1_lines_of_many_texts(spark, monkeypatch, hot_list):
    """Texts put together from lines that a third of them hold: their sets are not taken for a group of near copies."""
    import random
    rng = random.Random(5)
    monkeypatch.setattr(o1, "HOT_LIST", hot_list)
    given, real = [], o1._differences

    def seen(long, *args):
        given.append(long.select("set_id").distinct().count())
        return real(long, *args)
    monkeypatch.setattr(o1, "_differences", seen)
    lines = [para(600 + k, 25).split() for k in range(24)]
    texts = [sum(rng.sample(lines, 8), []) for _ in range(100)]
    for k in range(30):                                     # near copies, and some cut to four fifths or so
        w = list(texts[k])
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"own{k}"
        texts.append(w[rng.choice([0, 8, 34, 36, 38, 40, 44]):])
    rows = [(d, " ".join(w)) for d, w in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, want = components(rows)
    assert {r.doc_id: r.component_id for r in o1.ngram_join(docs).collect()} == {rows[i][0]: c for i, c in want.items()}
    assert 100 < len(set(want.values())) < 130
    assert hot_list != 8 or sum(given) < 40


def test_op7_equals_all_windows(spark):
    """Swapped halves, moved parts, edits, repeats and cut ends against every window of every document."""
    import random
    rng = random.Random(8)
    items = [(k, para(700 + k, n)) for k, n in enumerate((200, 60, 40, 30, 25, 12))]

    def variant(words):
        how, n = rng.randrange(7), len(words)
        if how == 0:
            return words[n // 2:] + words[:n // 2]
        if how == 1:
            a, b = sorted(rng.sample(range(n), 2))
            return words[:a] + words[b:] + words[a:b]
        if how == 2:
            out = list(words)
            for _ in range(rng.randint(1, max(1, n // 40))):
                out[rng.randrange(n)] = "edited"
            return out
        if how == 3:
            return words[rng.randint(0, n // 8):n - rng.randint(0, n // 8)]
        if how == 4:
            return words + words
        if how == 5:
            at = rng.randrange(n)
            return words[:at] + ["put", "in"] + words[at:]
        return words
    docs = []
    for d in range(60):
        parts = []
        for _ in range(rng.randint(1, 3)):
            parts += para(5000 + 7 * d + len(parts), rng.randint(0, 40)).split() + variant(rng.choice(items)[1].split())
        docs.append((d, " ".join(parts + para(9000 + d, rng.randint(0, 30)).split())))
    docs += [(100, items[0][1]), (101, " ".join(items[0][1].split()[:185])), (102, items[3][1] + " " + items[3][1]), (102, items[3][1])]
    counts = lambda w: collections.Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))                 # noqa: E731
    want = {}
    for d, text in docs:
        w = text.split()
        for k, item in items:
            own, n = counts(item.split()), min(len(item.split()), len(w))
            for at in range(len(w) - n + 1):
                there = counts(w[at:at + n])
                both = sum((own & there).values())
                sim = both / (sum(own.values()) + sum(there.values()) - both)
                if sim >= 0.8 - 1e-12 and sim > want.get((d, k), (0,))[0] + 1e-12:
                    want[d, k] = (sim, at)
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in
           o7.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == set(want) and len(want) > 40
    for key, (sim, at) in want.items():
        assert got[key] == (pytest.approx(sim), at), key
    assert got[next(k for k in want if k[0] == 100)][0] == 1.0


def test_op7_multi_index_finds_all_within_radius():
    index = o7.ItemIndex([(k, para(k, 30)) for k in range(300)])
    rng = np.random.default_rng(1)
    for _ in range(200):
        fp = int(index.prints[rng.integers(300)]) ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 24)), replace=False))
        want = [k for k in range(300) if (int(index.prints[k]) ^ fp).bit_count() <= o7.RADIUS]
        assert index.within(fp).tolist() == want


def test_op8_equals_the_library(odd_wide):
    import public_tokenizers
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(o8.MODEL))
    count = o8.counter(o8.MODEL)
    texts = ["", " ", "a", "  a  b ", "\n\n x\n", "<s> hello </s>", "▁x▁", "\x00\t\r", "aaaa" * 50, "日本語 \U0001F600!", "é",
             "0x0A<0x0A>"] + [t or "" for _, t, *_ in odd_rows()]
    assert [count(t) for t in texts] == [len(x) for x in sp.encode(texts)]
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in o8.token_counts(odd_wide).collect()), key=str)
    want = [(d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for d, t, *_ in odd_rows()]
    assert got == sorted(want, key=str)


def test_op9_brute_force(spark, odd_wide):
    rows = [r for r in odd_rows() if r[0] != 10] + [r for r in odd_rows() if r[0] == 10][:1]
    docs = spark.createDataFrame(rows, odd_wide.select("doc_id", "text", "lang", "source", "n_chars").schema).withColumn("key", F.lit(1))
    got = {r.doc_id: r for r in o9.fingerprints(docs).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for k, (d, t, *_) in enumerate(order):
        nxt = order[(k + 1) % len(order)]
        t, u = t or "", nxt[1] or ""
        cut = len(t) // 4
        edited = t[:len(t) - cut] + u[:cut]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d].next_fp == got[nxt[0]].fp
        assert (got[d].edited_fp == got[d].fp) or edited != t
    assert got[1].fp == got[2].fp and got[4].fp == got[5].fp == 0
    assert o9.fingerprints(odd_wide).count() == len(odd_rows())      # a repeated doc_id keeps both rows


def test_op9_tables_find_all_within_radius(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(-2**63, 2**63 - 1, 40)]
    flip = lambda x, k: (x & (2**64 - 1)) ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False))
    fps = [o9._signed(flip(x, int(k))) for x in base for k in (0, 0, 1, 2, 3, 4, 5)]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = {r.fp: r.n_near for r in o9.search(df, df).collect()}
    near = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3
    assert got == {x: sum(near(x, y) for y in fps) for x in set(fps)}


@pytest.mark.parametrize("run", [o1.ngram_join, o1.keep_one, o2.pack_documents, o3.lm_scores, o4.hilbert_shards, o6.license_scan,
                                 o8.token_counts, o9.fingerprints], ids=lambda f: f.__module__.split(".")[-1] + "." + f.__name__)
def test_empty_table(no_docs, run):
    assert run(no_docs).count() == 0


@pytest.mark.parametrize("seed", [3, 7])
def test_op2_crossover_wins_back_a_bin_that_best_fit_loses(monkeypatch, seed):
    """Triplets that fill 16 bins exactly: best fit in decreasing order needs 18, islands with migration 17;
    with children that are copies of their parent (mutation alone) it stays at 18."""
    import random
    rng, sizes = random.Random(seed), []
    for _ in range(16):
        a = rng.randint(251, 499)
        b = rng.randint((1000 - a) // 2 - 100, (1000 - a) // 2 + 100)
        sizes += [a, b, 1000 - a - b]
    rng.shuffle(sizes)

    def islands():
        pops = [[], [], []]
        for epoch in range(o2.EPOCHS):
            best = [o2.evolve(sizes, pops[i], 1000, seed=10 * epoch + i) for i in range(3)]
            pops = [[g for _, g in r] + [g for _, g in best[i - 1][:o2.ELITES]] for i, r in enumerate(best)]
        return min(len(o2._bins_of(r[0][1])) for r in best)
    assert len(o2.first_packing(sizes, 1000, random.Random(0), 0.0)) == 18
    assert islands() == 17
    monkeypatch.setattr(o2, "cross", lambda a, b, *rest: [list(x) for x in a])
    assert islands() == 18


def test_op2_equal_rows_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(o2, "BLOCK", 50)
    seen = []
    real = o2.C.materialize
    monkeypatch.setattr(o2.C, "materialize", lambda df, name: seen.append((name, out := real(df, name))) or out)
    docs = spark.createDataFrame([(None, "")] * 400, "doc_id long, text string")
    assert o2.pack_documents(docs).count() == 400
    sizes = [r.n for r in next(d for n, d in seen if n == "op2-blocks0").select(F.size("items").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 100


def test_op2_ids_equal_the_library_on_random_texts():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path(o2.TOKENIZER)
    tok, table = Tokenizer.from_file(path), o2._Ids(path)
    rng = random.Random(5)
    parts = ["\u0130", "\u0130.", "a", "b", "the", "\u00c9", "e\u0301", "\u0301", "\u00df", "\u03a3", "\u039f\u0394\u039f\u03a3", "\u6f22", "1", "\uff12", "\u00b2",
             "\u00bd", ".", ",", "'", "'s", "'re", "!", "(", ")", "\"", "-", "_", "|", "<", "<|", "|>", "<|endoftext|>", "&", "%", "\u00a0", "\u200b", "\u0958",
             "\u0958.", "\ufb01", "x\u0327", "\t", "\x1c", "\u1e9e", "K", "\U0001f600", "\u0345.", "\u0149.", "\u1fb3."]
    for k in range(20_000):
        text = "".join(rng.choice(parts) + (" " if rng.random() < 0.3 else "") for _ in range(rng.randint(1, 14)))
        ws = o2._words(text)
        table.learn(set(ws))
        assert b"".join(map(table.__getitem__, ws)) == np.asarray(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
        table.drop_long()


def test_op2_full_table_keeps_what_is_asked_for_again(monkeypatch):
    import public_tokenizers
    monkeypatch.setattr(o2, "CACHE_WORDS", 5)
    table = o2._Ids(public_tokenizers.path(o2.TOKENIZER))
    for k in range(30):
        ws = {"again", f"word{k}", f"(other{k}).", "x" * 60}
        table.learn(ws)
        assert ws <= table.keys()
        table.drop_long()
        assert "x" * 60 not in table and len(table) < 40


def test_op2_word_table_equals_the_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path(o2.TOKENIZER)
    tok = Tokenizer.from_file(path)
    table = o2._Ids(path)
    texts = ["It's end. A.. b ., x., don't.", "É é. İstanbul. ſ ß. 12. a1, 漢字. é. ́. ", "<|endoftext|> x<|ENDOFTEXT|>y <|endoftext|>. a",
             "tab\tin. nbsp here, \x1c x", ".. , . a.b. ﬁn. Σας ΟΔΟΣ. ²³. x​.", "", " ", "\n\n"]
    for t in texts + [para(k, 60).replace(" ", ". ", 7) for k in range(20)]:
        ws = o2._words(t)
        table.learn(set(ws))
        assert b"".join(table[w] for w in ws) == np.asarray(tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_op2_whole_texts_equal_the_library_and_words_are_encoded_once(monkeypatch):
    import random

    import pyarrow as pa
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path(o2.TOKENIZER)
    tok = Tokenizer.from_file(path)
    rng = random.Random(9)
    parts = ["\u0130", "a", "B", "the", "\u00c9", "\u00e9", "e\u0301", "\u0301", "\u00df", "\u00d7", "\u00f7", "\u03a3", "\u6f22", "1", "42", "\uff12", "\u00b2",
             ".", ",", "...", "'", "'s", "'re", "''", "!", "(", ")", "\"", "-", "_", "|", "<", "<|", "|>", "<|endoftext|>", "&", "\u2026", "\u00a0", "\u200b", "\ufb01",
             "x\u0327", "\t", "\n", "\x1c", "K", "\U0001f600", "\u0338", "word", "wort"]
    texts = ["".join(rng.choice(parts) + (" " if rng.random() < 0.3 else "") for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    texts += [None, "", " ", "\n \n", "(word).", "'(word", "x'.s", "\u00e9.\u00e9", "\u2026.a", "x" * 60, "x" * 60]
    want = [np.asarray(tok.encode(t or "", add_special_tokens=False).ids + [7], "<u4").tolist() for t in texts]
    for known in (o2.KNOWN_WORDS, 40):
        monkeypatch.setattr(o2, "KNOWN_WORDS", known)
        table, learned = o2._Encoder(path), []
        for k in range(0, len(texts), 1500):
            ids, at = table.encode(pa.array(texts[k:k + 1500], pa.string()), 7)
            assert [ids[x:y].tolist() for x, y in zip(at, at[1:])] == want[k:k + 1500]
            assert len(table.words) <= max(known, 1500 * 14) and "x" * 60 not in table.words.cast(pa.string()).to_pylist()
    # What is known is not encoded again, whatever punctuation stands beside it.
    table = o2._Encoder(path)
    table.encode(pa.array(["some words here"]), 7)
    monkeypatch.setattr(table, "_new", lambda words: (learned.extend(words.to_pylist()), o2._Encoder._new(table, words))[1])
    table.encode(pa.array(["(some words), here. Words! here"]), 7)
    assert sorted(learned) == [b"!", b"(", b"),", b"."]
