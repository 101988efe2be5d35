"""Language-model scores, substring and near-duplicate removal, quality rules."""

import hashlib
import math
import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from graphloom.llm import quality, scoring, simhash, substrings
from graphloom.llm.queries import tokenizer_path
from tests.llm import data


def brute_scores(rows, targets, mu=scoring.MU_BIGRAM, alpha=scoring.ALPHA, vocab=50257, bos=50256):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    docs = [t.encode(r[1] or "", add_special_tokens=False).ids for r in rows]
    tables = []
    for k in (0, 1):
        uni, bi = Counter(), Counter()
        for r, d in zip(rows, docs):
            if k == 1 or r[0] in targets:
                uni.update(d)
                bi.update(zip([bos, *d], d))
        tables.append((uni, bi))
    out = []
    for r, d in zip(rows, docs):
        own_u, own_b = Counter(d), Counter(zip([bos, *d], d))
        losses = []
        for k, (uni, bi) in enumerate(tables):
            mine = k == 1 or r[0] in targets
            size = sum(uni.values()) - (len(d) if mine else 0)
            total = 0.0
            for pair, n in own_b.items():
                c2 = bi[pair] - (n if mine else 0)
                c1 = uni[pair[1]] - (own_u[pair[1]] if mine else 0)
                cb = max(uni[pair[0]] - (own_u[pair[0]] if mine else 0), c2)
                total -= n * math.log((c2 + mu * (c1 + alpha) / (size + alpha * vocab)) / (cb + mu))
            losses.append(total / len(d) if d else None)
        out.append((r[0], len(d), *losses))
    return out


@pytest.mark.parametrize("block,how", [(400, {}), (1 << 22, {}), (400, {"shards": 9, "fan": 2, "bundle": 200})])
def test_scores(spark, block, how):
    rows = data.rows()
    targets = {i for i in range(0, 60, 3)}
    ids = spark.createDataFrame([(i,) for i in targets] + [(3,)], "doc_id long")
    got = scoring.cross_entropy_difference(data.frame(spark), ids, tokenizer_path(), block_bytes=block, **how).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    for g, w in zip(sorted([tuple(r) for r in got], key=key), sorted(brute_scores(rows, targets), key=key), strict=True):
        assert g[:2] == w[:2]
        if w[1]:
            assert abs(g[2] - w[2]) < 1e-9 and abs(g[3] - w[3]) < 1e-9 and abs(g[4] - (g[2] - g[3])) < 1e-12
        else:
            assert g[2:] == (None, None, None)


def test_scores_separate_kinds(spark):
    good = [(i, "the quick brown fox jumps over the lazy dog " * 3) for i in range(20)]
    bad = [(100 + i, "zz qq ## vv kk %% jj xx " * 4) for i in range(20)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(10)], "doc_id long")
    s = {r.doc_id: r.score for r in scoring.cross_entropy_difference(df, ids, tokenizer_path()).collect()}
    assert max(s[i] for i in range(20)) < min(s[100 + i] for i in range(20))


def brute_removed(rows, width=20):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    first, out = set(), []
    for i in order:
        w = data.words_of(rows[i][1])
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            x = tuple(w[k : k + width])
            if x in first:
                gone[k : k + width] = [True] * width
            first.add(x)
        out.append((rows[i][0], len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block,how", [(300, {}), (2000, {}), (1 << 22, {}), (300, {"shards": 7, "fan": 2, "bundle": 100}), (1000, {"shards": 30, "fan": 3, "bundle": 10_000})])
def test_substrings(spark, block, how):
    rows = data.rows()
    got = substrings.repeated_spans(data.frame(spark).repartition(3), block_bytes=block, **how).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    mine = sorted([(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got], key=key)
    assert mine == sorted(brute_removed(rows), key=key)
    assert sum(x[2] for x in mine) > 200
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed


def test_substrings_within_and_overlapping(spark):
    a = " ".join(f"w{i}" for i in range(30))
    rows = [(2, a), (1, a + " tail " + a), (3, "x " + a[:100] + " " + a), (4, " ".join(["z"] * 60)), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in substrings.repeated_spans(df, block_bytes=50).collect())
    assert got == sorted(brute_removed([(*r, None) for r in rows]))


def test_occurrences_come_from_the_automata_alone(monkeypatch):
    """A block finds, removes and keeps what its automata locate, in every document, copies included."""
    passage = [f"p{i}" for i in range(100)]
    docs = [" ".join(x).encode() for x in (["a", *passage], ["b", "c", *passage, "d"], ["a", *passage], passage[:30] + ["e"] + passage[40:70], ["z"] * 50)]
    width, keys = 20, {}
    block = substrings.Block(docs, width)
    windows = np.full(len(block.ids), -1, np.int64)
    for s, n in zip(block.starts.tolist(), block.sizes.tolist()):
        for p in range(s, s + n - width + 1):
            windows[p] = keys.setdefault(tuple(block.ids[p : p + width].tolist()), len(keys))
    windows[np.bincount(windows[windows >= 0], minlength=len(keys))[windows] < 2] = -1
    got = block.covered(windows, np.zeros(len(keys), bool), np.zeros(len(block.texts), bool))
    want = []
    seen = set()
    for d in docs:
        w = d.split()
        want.append([p for p in range(len(w) - width + 1) if tuple(w[p : p + width]) in seen or seen.add(tuple(w[p : p + width]))])
    assert [x.tolist() for x in got] == want and sum(map(len, want)) > 200
    earlier = np.array([False, True, False, False])
    got = block.covered(windows, np.zeros(len(keys), bool), earlier)
    assert got[1].tolist() == list(range(len(docs[1].split()) - width + 1))
    with monkeypatch.context() as m:  # many automata of few words give the same
        m.setattr(substrings, "PATTERN_WORDS", 50)
        assert [x.tolist() for x in block.covered(windows, np.zeros(len(keys), bool), np.zeros(len(block.texts), bool))] == want
    monkeypatch.setattr(substrings, "compile_automaton", lambda patterns: None)
    assert not any(len(x) for x in block.covered(windows, np.ones(len(keys), bool), earlier))


def test_confirmed_places_alone_are_not_enough(spark, monkeypatch):
    """A window is written down at one place of its block; all others are known from the automata only."""
    rows = data.rows()
    df = data.frame(spark).coalesce(1)
    total = lambda: substrings.repeated_spans(df).agg(F.sum("n_removed")).first()[0]
    right = sum(x[2] for x in brute_removed(rows))
    assert total() == right

    def places_only(self, windows, out, tight=None):
        for d, t in enumerate(self.text_of.tolist()):
            s, n, to = int(self.starts[t]), int(self.sizes[t]), int(self.doc_starts[d])
            at = np.flatnonzero(windows[s : s + n] >= 0)
            out[to + at] = windows[s + at]

    # Tasks run in workers of their own, so a block is asked here: with its windows at all places but through the lead ones.
    docs = [" ".join(x).encode() for x in ([f"p{i}" for i in range(60)], ["a"] + [f"p{i}" for i in range(10, 50)], ["b"] + [f"p{i}" for i in range(30)])]
    block, keys = substrings.Block(docs, 20), {}
    cand = np.concatenate([np.arange(s, s + n - 19) for s, n in zip(block.starts, block.sizes)])
    number = np.array([keys.setdefault(tuple(block.ids[p : p + 20].tolist()), len(keys)) for p in cand.tolist()])
    tight = substrings.bound(cand, number, len(keys))
    first = np.unique(number, return_index=True)[1]
    windows = np.full(len(block.ids), -1, np.int64)
    windows[cand[first]] = number[first]
    windows[np.bincount(number, minlength=len(keys))[windows] < 2] = -1
    ask = lambda: [len(x) for x in block.covered(windows, np.zeros(len(keys), bool), np.zeros(3, bool), tight)]
    assert ask() == [0, 21, 11] and len(substrings.passages(windows, 20, tight)) == 3
    monkeypatch.setattr(substrings.Block, "_locate", places_only)
    assert ask() == [0, 0, 0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=30), min_size=1, max_size=6))
def test_passages_bound_together(texts):
    """Every text over few words: all repeats of windows of three words are located through the tight passages."""
    docs = [b" ".join(b"w%d" % x for x in t) for t in texts]
    block, keys = substrings.Block(docs, 3), {}
    cand = np.concatenate([np.arange(s, max(s, s + n - 2)) for s, n in zip(block.starts, block.sizes)]).astype(np.int64)
    number = np.array([keys.setdefault(tuple(block.ids[p : p + 3].tolist()), len(keys)) for p in cand.tolist()], np.int64)
    windows, tight = np.full(len(block.ids), -1, np.int64), None
    if len(cand):
        tight = substrings.bound(cand, number, len(keys))
        first = np.unique(number, return_index=True)[1]
        windows[cand[first]] = number[first]
        windows[np.bincount(number, minlength=len(keys))[windows] < 2] = -1
    got = block.covered(windows, np.zeros(len(keys), bool), np.zeros(len(block.texts), bool), tight)
    seen, want = set(), []
    for d in docs:
        w = d.split()
        want.append([p for p in range(len(w) - 2) if tuple(w[p : p + 3]) in seen or seen.add(tuple(w[p : p + 3]))])
    assert [x.tolist() for x in got] == want


def test_more_words_than_characters():
    ids = np.concatenate([np.arange(1_200_000), np.arange(1_199_000, 1_199_050)])
    to, of, n = substrings.occurrences(ids, [(1_199_000, 50)], ids, 1_200_000)
    assert sorted(to.tolist()) == [1_199_000, 1_200_000] and of.tolist() == [1_199_000] * 2 and n.tolist() == [50] * 2


def test_rows_between_blocks_and_shards_grow_in_proportion(spark):
    """At ten times the blocks and shards, the rows sent, bundled and answered are about ten times as many (times the
    depth of the tree and its branching, which the rounding moves a little), not a hundred times."""
    import uuid

    from graphloom.llm import blocks as B

    def rows_for(n):
        q = B.recurring(1)
        depth, fan = B.depth_and_fan(n, 4)
        assert fan <= 4 and fan**depth >= n
        df = spark.range(n, numPartitions=4).selectExpr("id as block")
        one = lambda t: B.table([x for k in t.column("block").to_pylist() for x in q.send(k, [B.mix64(np.arange(k * 50, k * 50 + 100, dtype=np.uint64)), np.zeros(100)], fan)])
        held = df.groupBy((F.col("block") % 4).alias("g")).applyInArrow(one, B.ROW)
        from graphloom.llm.common import materialise

        held = materialise(held, f"test{uuid.uuid4().hex}")
        seen = []
        real = B.materialise
        B.materialise = lambda d, tag, *a: seen.append(real(d, tag, *a)) or seen[-1]
        try:
            got = q.ask(held, n, 4, 1000).collect()
        finally:
            B.materialise = real
        assert sum(len(q.given({"a": r.a})[0]) for r in got) == 100 * n
        assert sum(int(q.given({"a": r.a})[0].sum()) for r in got) == 100 * n - 100  # all but the first and last halves recur
        return held.count() + sum(x.count() for x in seen), len(got)

    (few, few_back), (many, many_back) = rows_for(20), rows_for(200)
    assert many < 20 * few and many_back < 20 * few_back


def brute_fingerprint(text):
    import xxhash

    w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in data.words_of(text)]
    g = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in g]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs, radius):
    """(id, fp) rows to the smallest id that links reach."""
    best = {f: min((i for i, g in pairs if g == f and i is not None), default=None) for _, f in pairs}
    part = {f: f for f in best}

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    fs = list(best)
    for i, a in enumerate(fs):
        for b in fs[i + 1 :]:
            if bin(a ^ b).count("1") <= radius:
                part[find(a)] = find(b)
    low = {}
    for f in fs:
        r = find(f)
        if best[f] is not None:
            low[r] = min(low.get(r, best[f]), best[f])
    return [(i, f, low.get(find(f))) for i, f in pairs]


def test_simhash(spark):
    rows = data.rows()
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(data.frame(spark)).collect()), key=str)
    assert got == sorted(brute_components([(r[0], brute_fingerprint(r[1])) for r in rows], 2), key=str)


@pytest.mark.parametrize("bucket", [4, 8192])
def test_links_of_crowded_buckets(spark, bucket):
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    fps = {base}
    for _ in range(150):  # chains, balls and strangers, all in few buckets
        f = list(fps)[int(rng.integers(len(fps)))]
        for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
            f ^= 1 << int(b)
        fps.add(f)
    pairs = list(enumerate(sorted(fps)))
    signed = [(i, f - (1 << 64) if f >> 63 else f) for i, f in pairs]
    nodes = spark.createDataFrame([(f,) for _, f in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.near_links(nodes, 2, bucket)).collect()}
    group = {}
    for (i, _), (_, s) in zip(pairs, signed):
        group.setdefault(roots.get(s, s), []).append(i)
    mine = {i: min(g) for g in group.values() for i in g}
    assert mine == {i: c for i, _, c in brute_components(pairs, 2)}


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_drop_near_duplicates(spark):
    df = data.frame(spark)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    want = {c for _, _, c in brute_components([(r[0], brute_fingerprint(r[1])) for r in data.rows()], 2)}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)
    unlike = [(None, "one two three four"), (None, "red green blue white"), (3, "five six seven eight"), (3, "nine ten eleven twelve"), (3, "five six seven eight")]
    odd = spark.createDataFrame([(*r, 1) for r in unlike], "doc_id long, text string, text_hash_ int")
    assert sorted(map(tuple, simhash.drop_near_duplicates(odd).collect()), key=str) == sorted({(*r, 1) for r in unlike}, key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 63), st.integers(0, 63)), max_size=40), st.integers(0, 5), st.integers(1, 300))
def test_tiles_of_any_buckets(rows, radius, times):
    rng = np.random.default_rng(times)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    rows = [(r, int(base[r]) ^ (1 << i) ^ (1 << j)) for r, i, j in rows] + [(9, int(x)) for x in rng.integers(0, 64, times)]
    rows.sort(key=lambda x: x[0])
    run = np.unique([r for r, _ in rows], return_inverse=True)[1] if rows else np.empty(0, np.int64)
    fps = np.array([f for _, f in rows], np.uint64)
    a, b = simhash.tile_links(run, fps, radius)

    def parts(pairs):
        part = {f: f for f in fps.tolist()}

        def find(x):
            while part[x] != x:
                x = part[x]
            return x

        for x, y in pairs:
            part[find(x)] = find(y)
        return {f: min(g for g in part if find(g) == find(f)) for f in part}

    pairs = [(x, y) for i, (r, x) in enumerate(zip(run.tolist(), fps.tolist())) for s, y in list(zip(run.tolist(), fps.tolist()))[i + 1 :] if r == s and bin(x ^ y).count("1") <= radius]
    assert parts(zip(a.tolist(), b.tolist())) == parts(pairs)
    assert len(a) <= len(rows)


def brute_copies(rows, least=0.8, width=5):
    """(id, text) rows to the smallest id that links of shingle sets reach."""
    low = [re.sub("[A-Z]", lambda m: m.group().lower(), " ".join(data.words_of(t))) for _, t in rows]
    sets = []
    for t in low:
        w = t.split(" ")
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or {tuple(w)})
    part = list(range(len(rows)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in range(len(rows)):
        for k in range(i):
            if len(sets[i] & sets[k]) >= least * len(sets[i] | sets[k]):
                part[find(i)] = find(k)
    names = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            names[find(i)] = min(names.get(find(i), d), d)
    return [(d, names.get(find(i))) for i, (d, _) in enumerate(rows)]


def copies_corpus(seed=11):
    import random

    rng = random.Random(seed)
    rows = []
    for n in (12, 30, 80, 200, 700):
        for _ in range(3):
            base = [f"{x}{rng.randrange(9)}" for x in data.prose(rng, n).split(" ")]
            rows.append(" ".join(base))
            for edits in (0, 1, 1, 2, 4, 9, 30):
                w = list(base)
                for _ in range(min(edits, n // 3)):
                    w[rng.randrange(n)] = f"new{rng.randrange(10**6)}"
                rows.append(" ".join(w).upper() if edits == 0 else " ".join(w))
    rows += [None, "", "one two", "ONE  two", "one two three"]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)] + [(3, rows[3]), (5, "a repeated id with another text than before it")]


@pytest.mark.parametrize("bucket,group", [(8192, 1024), (2, 4)])
def test_near_copies(spark, bucket, group):
    rows = copies_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_copies(df, bucket=bucket, group=group).collect())
    want = sorted(brute_copies(rows))
    assert got == want and len({c for _, c in want}) < len(rows) - 30


def test_near_copies_of_awkward_rows(spark):
    df = data.frame(spark)
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_copies(df).collect()), key=str)
    want = brute_copies([(r[0], r[1]) for r in data.rows()])
    assert got == sorted(want, key=str)
    kept = simhash.drop_near_copies(df)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted({c for _, c in want}, key=str)
    assert simhash.drop_near_copies(data.empty(spark)).collect() == []


def test_forest_is_minimal():
    rng = np.random.default_rng(8)
    fps = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    fps[100:400] = fps[:1] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    a, b = simhash.spanning_forest(fps, 20)
    d = np.bitwise_count(fps[:, None] ^ fps[None, :]).astype(int)
    part = list(range(len(fps)))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    total = n = 0
    for i, k in sorted(zip(*np.nonzero(np.triu(d <= 20, 1))), key=lambda p: d[p]):
        if find(i) != find(k):
            part[find(i)] = find(k)
            total, n = total + d[i, k], n + 1
    assert len(a) == n and d[a, b].sum() == total


def brute_measures(text):
    w = data.words_of(text)
    at = {}
    for k in range(len(w) - 7):
        at.setdefault(tuple(w[k : k + 8]), []).append(k)
    cover = {i for v in at.values() if len(v) > 1 for k in v for i in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if data.WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_one_row_of_every_component_whatever_the_ids(spark):
    import random

    rng = random.Random(8)
    t = [data.prose(rng, 40) for _ in range(9)]
    near = t[3] + " end"
    rows = [(None, t[0]), (None, t[1]), (None, t[1].title()), (None, t[2]), (None, near), (7, t[3]), (7, t[3]), (7, t[4]), (7, t[5]), (8, t[5]), (9, None), (None, ""), (None, t[6]), (3, t[6])]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, place int").repartition(3)
    got = [(r.doc_id, (r.text or "").lower()) for r in simhash.drop_near_copies(df).collect()]
    want = [(None, t[0]), (None, t[1]), (None, t[2]), (7, t[3]), (7, t[4]), (7, t[5]), (9, ""), (3, t[6])]
    assert sorted(got, key=str) == sorted(((i, x.lower()) for i, x in want), key=str)


def test_quality_measures(spark):
    extra = ["# a & b <c>", "p q r s t u v w " * 6, "one line\n one line\none line\n\n", "x y z w v u t s r q " * 3 + "end"]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(data.texts() + extra)], "doc_id long, text string, source string")
    for r in quality.judge(df).collect():
        t = (data.texts() + extra)[r.id]
        want = brute_measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


def test_line_frequency(spark):
    import random

    rng = random.Random(9)
    menu = "Home  Products 12 About us and much more of the same menu text for everyone"
    docs = []
    for i in range(60):
        body = data.prose(rng, 60)
        docs.append((i, body + "\n" + menu.replace("12", str(i)) if i % 2 else body, "h1"))
    docs += [(100 + i, menu + "\n" + data.prose(rng, 5) + f" {i}", "h1") for i in range(3)]
    copied = "\n".join(data.prose(rng, 30) for _ in range(3))
    docs += [(200 + i, copied, "h2") for i in range(40)] + [(300, None, "h2"), (301, "", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    v = {r.id: r for r in quality.judge(df).collect()}
    assert all(v[i].kept and (v[i].removed_chars > 0) == bool(i % 2) for i in range(60))
    assert all(not v[100 + i].kept and not v[100 + i].base_failed for i in range(3))  # depleted
    assert all(v[200 + i].kept and v[200 + i].removed_chars == 0 for i in range(40))  # copies are not boilerplate
    assert not v[300].kept and not v[301].kept
    out = {r.doc_id: r.text for r in quality.quality_filter(df).collect()}
    assert sorted(out) == sorted(i for i, r in v.items() if r.kept)
    assert all("Home" not in out[i] for i in range(60)) and out[200] == copied


def test_documents_of_mostly_shared_lines_are_distinct(spark):
    import random

    rng = random.Random(3)
    shared = "\n".join(data.prose(rng, 30) for _ in range(9))
    docs = [(i, (shared + "\n" if i < 40 else "") + data.prose(rng, 30) + f" {i}", "h") for i in range(200)]
    v = {r.id: r for r in quality.judge(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert all(not v[i].base_failed for i in range(200))
    assert all(not v[i].kept and v[i].removed_chars == len(shared) - 8 for i in range(40))  # held by 40 of 200
    assert all(v[i].kept and v[i].removed_chars == 0 for i in range(40, 200))


def test_quality_filter_with_clashing_columns(spark):
    text = "\n".join(" ".join(f"word{i}x{k}" for k in range(8)) for i in range(6))
    df = spark.createDataFrame([(1, text, "s", 7, "a")], "doc_id long, text string, source string, v_lines_ int, V_id_ string")
    assert [tuple(r) for r in quality.quality_filter(df).collect()] == [(1, text, "s", 7, "a")]


def test_quality_filter_keeps_columns(spark):
    df = data.frame(spark)
    out = quality.quality_filter(df)
    assert out.columns == df.columns and out.count() > 0
    assert quality.quality_filter(data.empty(spark)).collect() == []


def test_empty(spark):
    e = data.empty(spark)
    ids = spark.createDataFrame([], "doc_id long")
    assert substrings.repeated_spans(e).collect() == [] and simhash.near_duplicates(e).collect() == [] and quality.judge(e).collect() == []
    assert scoring.cross_entropy_difference(e, ids, tokenizer_path()).collect() == []


def test_many_null_ids_are_no_hot_key(spark):
    """5000 rows without an id, or all with one id, of which 1500 have a near copy: every candidate text is looked up by its
    own hash, so texts met are about as many as candidates, not their product with the rows of that id."""
    rng = np.random.default_rng(8)
    base = [" ".join(f"w{x}" for x in rng.integers(0, 100_000, 40)) for _ in range(3500)]
    rows = [(None if i % 2 else 7, t) for i, t in enumerate(base + [t + " end" for t in base[:1500]])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began = time.time()
    assert simhash.drop_near_copies(df).count() == 3500
    assert time.time() - began < 200  # hashing each of 5000 rows for each of 3000 candidates takes far longer
