"""Substring removal against plain comparison, with and without anchors split over shards."""

import random

import numpy as np
import pytest

from codeloom.llm import _arrays as A
from codeloom.llm import _repeats, queries, substring_dedup, suffix_array_dedup
from codeloom.llm._anchors import sliding_min


def rows():
    rnd = random.Random(3)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("xyzé") * rnd.randrange(3)
    passage = " ".join(word() for _ in range(120))
    other = [" ".join(word() for _ in range(rnd.randrange(160))) for _ in range(12)]
    out = [(i, f"pre{i} " * rnd.randrange(3) + " \t" * rnd.randrange(2) + passage[rnd.randrange(30) : len(passage) - rnd.randrange(60)] + f" post{i}") for i in range(30)]
    out += [(100 + i, t) for i, t in enumerate(other)] + [(200 + i, t) for i, t in enumerate(other[:4])]
    out += [(300, "ab " * 700), (301, "ab " * 500), (None, passage), (None, None), (302, ""), (303, passage), (303, passage), (304, "é" * 900), (305, "a\x00" * 300)]
    return out


def ordered(xs):
    return sorted(map(tuple, xs), key=lambda x: tuple((v is None, str(v)) for v in x))


def words_removed(df):
    return queries.word_digests(substring_dedup.remove_repeated_words(df))


def strings_removed(df):
    return queries.byte_digests(suffix_array_dedup.remove_repeated_strings(df))


OPERATORS = [(words_removed, substring_dedup.brute_force), (strings_removed, suffix_array_dedup.brute_force)]


@pytest.mark.parametrize("most", [2000, 5])
@pytest.mark.parametrize("operator, plain", OPERATORS)
def test_equals_plain_comparison(spark, monkeypatch, operator, plain, most):
    monkeypatch.setattr(_repeats, "SHARD_STRETCHES", most)
    monkeypatch.setattr(suffix_array_dedup, "RANGE", most)
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "1 as anchor", "2 as content", "3 as place")
    assert ordered(operator(df).collect()) == ordered(plain(data))


@pytest.mark.parametrize("operator", [substring_dedup.remove_repeated_words, suffix_array_dedup.remove_repeated_strings])
def test_empty_table(spark, operator):
    assert operator(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_texts_and_spans(spark):
    passage = " ".join(f"p{i}" for i in range(70))
    df = spark.createDataFrame([(1, f"a {passage} é"), (2, f"x y {passage}  z"), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.remove_repeated_words(df).collect()}
    assert got[1].kept == f"a {passage} é" and got[2].kept == "x y z" and [tuple(x) for x in got[2].spans] == [(2, 72)]
    assert got[3].kept == "short" and got[3].spans == []
    long = "".join(chr(97 + i * i % 23) for i in range(300)) + passage
    df = spark.createDataFrame([(1, f"<{long}>"), (2, f"[{long}]")], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_array_dedup.remove_repeated_strings(df).collect()}
    assert bytes(got[1].kept) == b"<>" and bytes(got[2].kept) == b"[]" and [tuple(x) for x in got[2].spans] == [(1, 1 + len(long))]
    assert (got[1].n_later, got[2].n_later) == (0, len(long))


@pytest.mark.parametrize("operator, plain", OPERATORS)
def test_many_repeated_rows_without_ids(spark, operator, plain):
    text = " ".join(f"w{i * i % 61}" for i in range(150))
    data = [(None, text)] * 10_000 + [(7, text[:500]), (None, None)]
    want = {r[0] if r[0] is not None or r[1] else "null": r for r in plain([(None, text), (None, text), *data[-2:]])}
    got = operator(spark.createDataFrame(data, "doc_id long, text string")).groupBy("n_words" if operator is words_removed else "n_bytes", "n_removed", "kept_sha256").count().collect()
    assert sorted(x["count"] for x in got) == [1, 1, 10_000]
    assert {(x[0], x.n_removed) for x in got} == {(r[1], r[2]) for r in want.values()}


def test_very_long_text(spark):
    text = " ".join(f"w{i * i % 9973}x{i % 7919}" for i in range(120_000))
    df = spark.createDataFrame([(1, text[:-9]), (2, text + " end")], "doc_id long, text string")
    got = {r.doc_id: r for r in words_removed(df).collect()}
    assert got[1].n_removed == 0 and got[2].n_words - got[2].n_removed in (1, 2, 3)
    got = {r.doc_id: r for r in strings_removed(df).collect()}
    assert got[1].n_removed == len(text) - 9 and got[2].n_removed == len(text) - 9


def test_strings_are_found_by_bisection():
    highs, lows = np.array([1, 4, 4, 4, 9]), np.array([5, -2, 0, 7, 1])
    at = suffix_array_dedup.place_of(highs, lows, np.array([0, 1, 4, 4, 4, 9, 9, 10]), np.array([0, 5, -3, 0, 8, 1, 2, 0]))
    assert at.tolist() == [0, 0, 1, 2, 4, 4, 5, 5]


def test_small_groups_of_suffixes_give_the_same_classes():
    text = b" ".join([b"a b c d e f g h"] * 40)
    import pyarrow as pa

    chunk = next(A.chunks(pa.array([text, text], pa.binary())))
    n = len(text.split()) - 49
    shard = _repeats.Shard(chunk, np.array([0, 0]), np.array([n, n]), np.array([1, 1]), np.array([1, 2]), np.array([1, 2]))
    one, *_ = substring_dedup.window_classes(shard)
    two, *_ = substring_dedup.window_classes(shard, most=3)
    pairs = set(zip(one.tolist(), two.tolist()))
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(pairs) == 8


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 50, 1000).astype(np.uint64)
    for w in (1, 3, 64, 1000, 1001):
        assert sliding_min(x, w).tolist() == [min(x[i : i + w]) for i in range(len(x) - w + 1)]


def test_suffix_array_is_sorted():
    rnd = np.random.default_rng(2)
    tokens = rnd.integers(0, 3, 400)
    segment = np.repeat([0, 1], [150, 250])
    ends = np.repeat([150, 400], [150, 250])
    order, levels = A.suffix_ranks(tokens, segment, ends)
    suffix = [tokens[i : ends[i]].tolist() for i in order]
    assert suffix == sorted(suffix)
    a, b = order[:-1], order[1:]
    lcp = A.common_prefix(levels, a, b, ends[a], ends[b])
    for x, y, n in zip(suffix[:-1], suffix[1:], lcp):
        assert x[:n] == y[:n] and (len(x) == n or len(y) == n or x[n] != y[n])
