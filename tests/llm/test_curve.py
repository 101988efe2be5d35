import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.llm import curve, wordends
from graphloom.llm.queries import tokenizer_path
from tests.llm import data

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


ODD = "ab 1.,'sStT\n\t  Ġé中\x1c<|>İſßΣς́\u0085 ªº²ÀÿǅĲ#*"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.text(alphabet=ODD, max_size=40) | st.lists(st.sampled_from(["<|endoftext|>", "a", " ", "don't", "We'LL", "x9", "<|", "c,"]), max_size=6).map("".join), max_size=6))
def test_ids_are_the_librarys(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    got = wordends.word_ends(PATH).encode(pa.array(texts, pa.string())).to_pylist()
    assert got == [np.asarray(t.encode(x or "", add_special_tokens=False).ids, "<u2").tobytes() for x in texts]


def test_memory_generations(library, monkeypatch):
    monkeypatch.setattr(wordends, "KNOWN", 5)
    enc = wordends.WordEnds(PATH)
    for x in data.texts():
        assert enc.encode(pa.array([x, "ban kort"]))[0].as_py() == np.asarray(library.encode(x or "", add_special_tokens=False).ids, "<u2").tobytes()


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_hilbert_visits_every_cell_by_single_steps(dims, bits):
    cells = np.stack([g.ravel() for g in np.meshgrid(*[np.arange(1 << bits)] * dims)], 1)
    key = curve.hilbert(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_cells_stay_in_range():
    p = np.array([[-(10**9)], [0], [10**9]])
    assert curve.cells(p, np.zeros(1), np.ones(1), 3).ravel().tolist() == [0, 4, 7]
    assert curve.cells(p, np.zeros(1), np.zeros(1), 3).min() >= 0


@pytest.mark.parametrize("capacity,parts", [(2048, 1), (64, 6)])
def test_whole_corpus(spark, library, capacity, parts):
    rows = data.rows()
    got = curve.curve_pack(data.frame(spark).repartition(parts), PATH, capacity).collect()
    want = []
    for r in rows:
        want.append((str(r[0]), np.asarray([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")))
    docs = {}
    for r in got:
        docs.setdefault((str(r.id), r.row), []).append(r)
    found = []
    for (i, _), ps in docs.items():
        ps.sort(key=lambda p: p.start)
        assert [p.start for p in ps] == np.cumsum([0, *[p.length for p in ps]])[:-1].tolist() and sum(p.length for p in ps) == ps[0].doc_tokens
        found.append((i, tuple((p.start, p.length, p.ids_crc32) for p in ps)))
    assert len(found) == len(want)
    by_id = {}
    for i, ps in found:
        by_id.setdefault(i, []).append(ps)
    for i, ids in want:
        match = [ps for ps in by_id[i] if ps[-1][0] + ps[-1][1] == len(ids) and all(zlib.crc32(ids[s : s + n].tobytes()) == c for s, n, c in ps)]
        assert match
        by_id[i].remove(match[0])
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    lengths = []
    for x in seqs.values():
        x.sort()
        assert [a for a, _ in x] == np.cumsum([0, *[n for _, n in x]])[:-1].tolist()
        lengths.append(sum(n for _, n in x))
    assert all(n <= capacity and n & (n - 1) == 0 for n in lengths)  # no padding at all
    assert sum(n < capacity for n in lengths) <= 11 * 4  # a few at the end of each partition


def test_likes_are_neighbours(spark):
    """Documents of two languages of words, shuffled: along the curve nearly all neighbours are of one kind."""
    a, b = ["sun", "moon", "star", "sky", "light", "day"], ["rock", "stone", "sand", "clay", "mud", "dust"]
    rng = np.random.default_rng(3)
    docs = [(int(i), " ".join(rng.choice(a if i % 2 else b, 40))) for i in rng.permutation(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = curve.keyed(curve.encoded(df, PATH)).orderBy("key", "row").collect()
    kinds = [r.id % 2 for r in rows]
    assert sum(x != y for x, y in zip(kinds, kinds[1:])) < 40


def test_copies_spread_over_partitions(spark):
    df = spark.range(0, 4000, 1, 4).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("the same text")).otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    keyed = curve.keyed(curve.encoded(df, PATH))
    sizes = [r["count"] for r in keyed.repartitionByRange(8, "key", "row").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1200


def test_empty(spark):
    assert curve.curve_pack(data.empty(spark), PATH).collect() == []
    blank = spark.createDataFrame([(1, None), (None, ""), (1, " \n")], "doc_id long, text string")
    got = curve.curve_pack(blank, PATH).collect()
    assert sorted((str(r.id), r.start, r.length, r.doc_tokens) for r in got) == [("1", 0, 1, 1), ("1", 0, 1, 1), ("None", 0, 1, 1)]
