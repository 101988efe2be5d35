import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.llm import packing, tokens
from graphloom.llm.queries import tokenizer_path
from tests.llm import data


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab 1.,'\n\t  Ġé中\x1c<|>", max_size=40) | st.lists(st.sampled_from(["<|endoftext|>", "a", " ", "b c", "<|"]), max_size=6).map("".join), max_size=5))
def test_ids_are_the_librarys(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    got = tokens.encoder(tokenizer_path()).encode_many(texts)
    assert got == [np.asarray(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


def test_cache_generations(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    enc = tokens.Encoder(tokenizer_path())
    for x in data.texts():
        assert enc.encode_many([x, "ban kort"])[0] == np.asarray(library.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit(sizes):
    s = np.array(sizes, np.int64)
    b, o, f = packing.best_fit(s, 50)
    for k in range(len(f)):
        mine = np.flatnonzero(b == k)
        at = sorted(mine, key=lambda i: o[i])
        assert f[k] == s[mine].sum() <= 50
        assert [int(o[i]) for i in at] == np.cumsum([0, *s[at]])[:-1].tolist()
    assert sum(1 for x in f if 2 * x <= 50) <= 1  # no two of them would fit together


@pytest.mark.parametrize("capacity,parts", [(2048, 1), (64, 7)])
def test_whole_corpus(spark, library, capacity, parts):
    rows = data.rows()
    df = data.frame(spark).repartition(parts)
    got = packing.pack_documents(df, tokenizer_path(), capacity, keep_ids=True, fan=2).collect()
    want = []
    for r in rows:
        ids = np.asarray([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        cut = [0, *range(len(ids) % capacity or capacity, len(ids), capacity), len(ids)]
        want += [(str(r[0]), k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cut, cut[1:]))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        x.sort()
        assert [a for a, _ in x] == np.cumsum([0, *[n for _, n in x]])[:-1].tolist() and sum(n for _, n in x) <= capacity
    total = sum(x[3] for x in want)
    alone = packing.best_fit(np.array([x[3] for x in want]), capacity)[2]
    assert len(by) <= len(alone) + parts and len(by) >= -(-total // capacity)
    df2 = spark.createDataFrame([(r.sequence_id, r.offset, r.ids) for r in got], "sequence_id long, offset long, ids array<int>")
    assert sum(len(r.ids) for r in packing.sequences(df2).collect()) == total


def test_keep_bounds_what_goes_up(spark):
    items = spark.range(0, 500, 1, 10).selectExpr("id", "cast(600 + id % 7 as long) as length")
    got = packing.pack(items, 1000, keep=3).groupBy("sequence_id").count().collect()
    assert len(got) == 500  # nothing fits together, nothing is lost


def test_keep_costs_no_sequence(spark):
    items = spark.range(0, 3000, 1, 12).selectExpr("id", "cast(1 + pmod(xxhash64(id), 997) * pmod(xxhash64(id, 1), 997) / 997 as long) as length")
    counts = [packing.pack(items, 1000, keep=keep, fan=4).select("sequence_id").distinct().count() for keep in (4, 50, 1_000_000)]
    assert counts[0] == counts[1] == counts[2]


def test_empty(spark):
    assert packing.pack_documents(data.empty(spark), tokenizer_path()).collect() == []
