"""Quality, near duplicates, pieces, toxicity, decontamination and the pipeline against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm import _arrays as A
from codeloom.llm import decontamination, near_dedup, pieces, quality_rules, queries, toxicity

DOC = "doc_id long, text string"
ODD = [None, "", " \t\n", "one", "é x y\x0bz", "a\r\nb\r\n", "#*$ %&|<> ok", "\n\n\n"]


def docs(spark, rows):
    return spark.createDataFrame(rows, DOC).selectExpr("*", "1 as row", "2 as node", "3 as hits", "'s' as n_words")


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def repeats(text, least):
    words = (text or "").split()
    covered, longest = set(), 0
    for i in range(len(words)):
        for j in range(i + 1, len(words)):
            n = 0
            while j + n < len(words) and words[i + n] == words[j + n]:
                n += 1
            if n >= least:
                covered |= set(range(i, i + n)) | set(range(j, j + n))
                longest = max(longest, n)
    return len(covered), longest


def texts():
    rnd = random.Random(1)
    out = list(ODD)
    for _ in range(25):
        words = [rnd.choice("abcdefghijé") for _ in range(rnd.randrange(150))]
        out.append("".join(w + rnd.choice([" ", " ", "\n", "  "]) for w in words))
    p = " ".join(f"w{i}" for i in range(60))
    return [*out, f"{p} x {p}", f"{p}\n{p}\n{p}", "tok " * 300, p]


def test_quality_rules(spark):
    rows = list(enumerate(texts())) + [(None, "a b"), (0, None)]
    got = quality_rules.quality_rules(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    known = dict(rows)
    for r in got:
        want = base(known[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
        assert (r.n_covered_words, r.longest_repeat) == repeats(known[r.doc_id], quality_rules.MIN_REPEAT)
    kept = quality_rules.quality_rules(docs(spark, rows), keep_columns=True)
    assert kept.columns == docs(spark, rows).columns and kept.count() == sum(r.kept for r in got)
    assert quality_rules.quality_rules(docs(spark, []).limit(0)).count() == 0


def test_quality_limits_reject_on_their_own(spark):
    fresh = (f"u{i}" for i in range(100_000))
    take = lambda n: [next(fresh) for _ in range(n)]
    short = [take(20) for _ in range(20)]
    covered = [w for p in short for w in [*p, *take(30), *p, *take(30)]]  # 40 %, in repeats of 20 words
    once = take(220)
    longest = [*once, *take(800), *once, *take(760)]  # one repeat of 11 %, 22 % covered
    little = [*once[:190], *take(800), *once[:190], *take(820)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs(spark, [(i, " ".join(w)) for i, w in enumerate((covered, longest, little))])).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [(got[i].n_covered_words, got[i].longest_repeat) for i in range(3)] == [(800, 20), (440, 220), (380, 190)]
    assert [got[i].kept for i in range(3)] == [False, False, True]


def near_texts():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    out = []
    for g in range(12):
        own = [word() for _ in range(rnd.randrange(30, 160))]
        out.append(" ".join(own))
        for _ in range(rnd.randrange(5)):
            copy = list(own)
            for _ in range(rnd.randrange(1, 4)):
                copy[rnd.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out + out[:5] + ["a b c", "a  b c", "a b d", "", "", " "]


def test_near_duplicates(spark):
    rows = list(enumerate(near_texts())) + [(None, "zz"), (None, None), (900, None), (901, None), (902, "zz"), (902, "zz")]
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    known = [(i, t) for i, t in rows if i is not None and t is not None and i < 900]
    sets = {i: next(iter([near_dedup.shingles(c) for c in A.chunks(pa.array([t]))])) for i, t in known}
    root = {i: i for i, _ in known}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, ta in known:
        for b, tb in known:
            if a < b and (ta == tb or near_dedup.weighted_jaccard(sets[a][1:], sets[b][1:]) >= 0.8):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    classes = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert {i: find(i) for i, _ in known} == {i: classes[i] for i, _ in known}
    assert classes[900] == 900 and classes[901] == 901 and classes[902] == 902
    assert sorted(r.class_size for r in got if r.doc_id == 902) == [3, 3]
    kept = near_dedup.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.filter("text is not null").collect()) == sorted({find(i) for i, _ in known} | {902})
    assert kept.filter("text is null").count() == 3
    assert near_dedup.near_duplicates(docs(spark, rows).limit(0)).count() == 0


def test_sketches_estimate_weighted_similarity():
    rnd = np.random.default_rng(3)
    off = []
    for _ in range(60):
        key = rnd.integers(0, 2**63, 50).astype(np.uint64)
        a, b = rnd.random(50) * 3, rnd.random(50) * 3
        s = near_dedup.sketches(np.repeat([0, 1], 50), np.concatenate([key, key]), np.concatenate([a, b]), 2)
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def test_large_buckets_keep_their_links(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    monkeypatch.setattr(near_dedup, "FOLLOWERS", 2)
    common = " ".join(f"w{i}" for i in range(200))
    rows = [(i, common + f" x{i} y{i} z{i}") for i in range(12)]
    got = near_dedup.near_duplicates(docs(spark, rows)).collect()
    assert {r.class_id for r in got} == {0} and {r.class_size for r in got} == {12}


def test_pieces(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    rnd = random.Random(4)
    signs = list(" \n\t▁abcdeéÀ日本𝒳\x00\r.,!0123THE the  ing   ​﻿⁇�<>/s")
    made = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(60))) for _ in range(400)]
    rows = list(enumerate([*ODD, *made, " " * 100 + "x", "word " * 20_000]))
    got = {r.doc_id: r for r in pieces.digest_documents(docs(spark, rows), queries.tokenizer_path()).collect()}
    table = pieces.piece_table(queries.tokenizer_path())
    for i, t in rows:
        ids = model.encode(t or "")
        assert table.encode(t) == ids and table.decode(ids) == model.decode(ids)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest())
    full = {r.doc_id: (r.ids, r.decoded) for r in pieces.encode_documents(docs(spark, rows[:60]), queries.tokenizer_path()).collect()}
    assert full == {i: (model.encode(t or ""), model.decode(model.encode(t or ""))) for i, t in rows[:60]}


def test_decoding_any_ids():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    table = pieces.piece_table(queries.tokenizer_path())
    rnd = random.Random(5)
    for _ in range(500):
        ids = [rnd.randrange(32_000) if rnd.random() < 0.6 else rnd.randrange(3, 259) for _ in range(rnd.randrange(12))]
        assert table.decode(ids) == model.decode(ids)


def test_parts_cut_between_letters_and_other_signs():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    table = pieces.piece_table(queries.tokenizer_path())
    rnd = random.Random(11)
    signs = "aeinrstéßñ" * 4 + "²³½①Ⅷ٣一あа́̈" + "0189_.,;'-%& \t\n\xa0▁" * 2 + "😀﷽\u200d"
    for _ in range(1500):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randrange(1, 40)))
        ids = model.encode(text)
        assert "".join(table.parts(text)) == " " + text.replace("▁", " ") and table.encode(text) == ids
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), model.decode(ids))]
        assert pieces.digest(table, text) == (len(ids), *digests)


def test_parts_may_be_forgotten(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_PARTS", 3)
    monkeypatch.setattr(pieces, "CACHE_PAIRS", 3)
    small = pieces.PieceTable(queries.tokenizer_path())
    text = "the quick brown fox jumps over the lazy dog " * 3
    assert pieces.digest(small, text) == pieces.digest(pieces.piece_table(queries.tokenizer_path()), text)


def toxic_rows():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abdegilmnorstu") for _ in range(rnd.randrange(2, 9)))
    rows = []
    for i in range(600):
        words = [word() for _ in range(rnd.randrange(30, 120))]
        if i % 5 == 0:
            for _ in range(4):
                words.insert(rnd.randrange(len(words)), rnd.choice(["zwackel", "vexnar", "kwimpot"]))
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    some = docs(spark, [(i, t) for i, t, _ in rows] + [(None, "x"), (7000, None), (7001, ""), (1, rows[1][1])])
    got = toxicity.score_documents(some, toxicity.train(some, labels)).collect()
    assert len(got) == len(rows) + 4
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert {r.held_out for r in got if r.doc_id is None} == {False}


def test_toxicity_without_labels(spark):
    some = docs(spark, [(1, "a"), (2, None)])
    model = toxicity.train(some, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in toxicity.score_documents(some, model).collect()] == [0, 0]


def hits(own, items):
    out = set()
    for w in items:
        n = min(13, len(w))
        for k in range(max(1, len(w) - 12)) if w else ():
            out |= {p for i in range(len(own) - n + 1) if own[i : i + n] == w[k : k + n] for p in range(i, i + n)}
    return out


@pytest.mark.parametrize("block", [16 << 20, 300])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    rnd = random.Random(7)
    words = [f"W{i}é" for i in range(300)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(n))) for i, n in enumerate([40, 13, 12, 5, 1, 20, 30])] + [(7, None), (8, " .. "), (None, "null item text here"), (0, "W1é w2é")]
    bodies = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(200)))) for i in range(20)]
    bodies += [(100 + i, "Lead-in, " + t.upper().replace(" ", " - ") + ". tail " * rnd.randrange(40)) for i, t in items[:7]]
    bodies += [(200, " ".join(items[0][1].split()[:12])), (201, None), (202, ""), (203, "NULL item text-here"), (100, items[0][1]), (None, items[1][1])]
    got = decontamination.find_contamination(docs(spark, bodies), spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as doc_id"))
    want = decontamination.brute_force(bodies, items)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(map(tuple, got.drop("longest_match", "matches").collect()), key=key) == sorted(want, key=key)
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    known = {("null" if i is None else str(i), tuple(split(t))) for i, t in items}
    for r in got.filter("doc_id is not null and doc_id <> 100").collect():
        own = split(dict(bodies)[r.doc_id])
        assert r.longest_match == max([m.words for m in r.matches], default=0)
        assert {p for m in r.matches for p in range(m.start, m.start + m.words)} == hits(own, [split(t) for _, t in items])
        for m in r.matches:
            run = tuple(own[m.start : m.start + m.words])
            assert len(run) == m.words and any(m.item == i and any(w[k : k + len(run)] == run for k in range(len(w))) for i, w in known)
    kept = decontamination.find_contamination(docs(spark, bodies), spark.createDataFrame(items, "item_id long, text string"), keep_columns=True)
    assert kept.columns == docs(spark, bodies).columns and kept.count() == sum(not r[-1] for r in want)


def test_decontamination_without_items(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_hit, r.contaminated) for r in decontamination.find_contamination(docs(spark, [(1, "a b")]), none).collect()] == [(0, False)]


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    rows = queries.table(spark, folder, "documents").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, folder)
        assert out.columns == rows.columns and out.dtypes == rows.dtypes
        rows = out
    assert corpus_pipeline.STAGES[-1][1](spark, rows, folder).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def plain_fit(texts, toxic):
    """Log-count ratios of the classifier's buckets, text by text."""
    with_toxic, with_other = Counter(), Counter()
    for text, y in zip(texts, toxic):
        chunk = next(A.chunks(pa.array([text])))
        seen = {int(b) for buckets, row in toxicity._grams(chunk) for b, r in zip(buckets, row) if r >= 0}
        (with_toxic if y else with_other).update(seen)
    n, m = sum(toxic), len(toxic) - sum(toxic)
    return {b: np.log((with_toxic[b] + 0.5) / (n + 1)) - np.log((with_other[b] + 0.5) / (m + 1)) for b in {*with_toxic, *with_other}}


def test_toxicity_equals_a_plain_version():
    rows = toxic_rows()[:160]
    texts, toxic = [t or "" for _, t, _ in rows], [int(y) for *_, y in rows]
    model = toxicity.fit(pa.array(texts), np.array(toxic), rounds=4000)
    ratio = plain_fit(texts, toxic)
    used = np.flatnonzero(model.feature >= 0)
    assert len(used) and set(used.tolist()) <= set(ratio)
    # the optimum of the penalised regression: a weight that isn't 0 has a slope of the penalty's size
    grams = [{int(b) for buckets, row in toxicity._grams(next(A.chunks(pa.array([t])))) for b, r in zip(buckets, row) if r >= 0} for t in texts]
    score = np.array([model.bias + sum(model.weights[model.feature[b]] for b in g if model.feature[b] >= 0) for g in grams])
    assert np.allclose(score, np.concatenate([model.sums(c) for c in A.chunks(pa.array(texts))]))
    weight = np.where(np.array(toxic) > 0, toxicity.TOXIC_WEIGHT, 1.0)
    error = (1 / (1 + np.exp(-score)) - toxic) * weight / weight.mean()
    for b in used.tolist()[:50]:
        slope = ratio[b] * np.mean([e if b in g else 0.0 for e, g in zip(error, grams)])
        raw = model.weights[model.feature[b]] / ratio[b]
        assert abs(slope + 0.0003 * np.sign(raw)) < 0.0002


def test_sample_leaves_out_labels_without_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_POSITIVE", 20)
    monkeypatch.setattr(toxicity, "MAX_NEGATIVE", 20)
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.update(texts=texts.to_pylist(), toxic=toxic.tolist()))
    rows = [(i, f"text {i}" if i % 2 else None) for i in range(200)] + [(1, "text 1")]
    toxicity.train(docs(spark, rows), spark.createDataFrame([(i, i % 4 // 2) for i in range(200)], "doc_id long, toxic int"))
    assert Counter(seen["toxic"]) == {0: 20, 1: 20} and len(set(seen["texts"])) == 40


LONG = [
    "word " * 200_000,
    " ".join(f"w{i * i % 9973}" for i in range(150_000)),
    "あいうえお漢字" * 60_000,
]


def test_very_long_texts(spark):
    some = docs(spark, list(enumerate(LONG)))
    got = {r.doc_id: r for r in quality_rules.quality_rules(some).collect()}
    assert [got[i].longest_repeat for i in (0, 2)] == [199_999, 0] and not got[0].kept and got[1].n_words == 150_000
    assert [r.class_id for r in near_dedup.near_duplicates(some).orderBy("doc_id").collect()] == [0, 1, 2]
    model = toxicity.fit(pa.array(["bad words here"] * 9 + ["good words there"] * 9), np.array([1] * 9 + [0] * 9))
    assert toxicity.score_documents(some, model).count() == 3


def test_piece_caches_are_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_CHARS", 100)
    table = pieces.PieceTable(queries.tokenizer_path())
    plain = table.encode(LONG[2][:2000])
    for k in range(300):
        pieces.digest(table, f"some{k} other{k} words{k}")
        assert sum(map(len, table.done)) <= 100
    n, *_ = pieces.digest(table, LONG[2])
    assert n > len(plain) and not any(len(x) > pieces.CACHE_LONGEST for x in table.done)


def test_empty_tables(spark):
    none = docs(spark, []).limit(0)
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert pieces.digest_documents(none, queries.tokenizer_path()).count() == 0
    assert decontamination.find_contamination(none, bench).count() == 0
    model = toxicity.train(none, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert toxicity.score_documents(none, model).count() == 0


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, "never there " * 9)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rnd = random.Random(11)
    text = lambda: " ".join(f"{rnd.choice('abcdef')}{rnd.randrange(10**6)}" for _ in range(80))
    a, b = text(), text()
    rows = [(1, a), (1, a), (2, a), (None, a), (3, b + " token = abcdefghijkl0123"), (4, None), (None, None), (5, ""), (6, "short"), (None, b), (7, text() + " never there" * 9)]
    schema = "doc_id long, text string, node string, hits int, row int, spans string, n_words int"
    got = spark.createDataFrame([(*r, "n", 1, 2, "s", 3) for r in rows], schema)
    want = [[(1, a), (1, a), (2, a), (None, a), (3, rows[4][1]), (None, b), (7, rows[-1][1])], None, None, None]
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, got, str(tmp_path))
        assert out.dtypes == got.dtypes
        found = [(r.doc_id, r.text) for r in out.collect()]
        if want[k]:
            assert sorted(found, key=str) == sorted(want[k], key=str)
        sizes.append(len(found))
        got = spark.createDataFrame(out.collect(), out.schema)
    assert sizes == [7, 3, 2, 2]
    assert {r.text for r in got.collect()} == {a, b + " [SECRET]"}
    empty = got.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0
