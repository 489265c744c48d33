import random
import struct
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from qanat.llm import packing, topk
from qanat.llm.queries import tokenizer_path

import numpy as np
import pyarrow as pa

from qanat.llm.words import Texts


def brute_top(rows, k, every):
    import math

    fine = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            fine.setdefault((i, len(v)), []).append([math.floor(256 * x) for x in v])
    out = []
    for (q, n), vs in fine.items():
        if q % every == 0:
            scores = sorted((-max(sum(a * b for a, b in zip(v, w, strict=True)) for v in vs for w in ws), c) for (c, m), ws in fine.items() if c != q and m == n)
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, vec array<double>").repartition(3)


@pytest.mark.parametrize("blocks", [(4096, 16384), (3, 4)])
def test_top_k_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "QUERIES", blocks[0])
    monkeypatch.setattr(topk, "CANDIDATES", blocks[1])
    monkeypatch.setattr(topk, "FAN", 3)
    rnd = random.Random(1)
    rows = [(i, [rnd.choice((-1.0, -0.25, 0.0, 0.5, 0.75)) for _ in range(3)]) for i in range(90)]
    rows += [(10, [-1.0, 0.5, 0.5]), (10, [0.75, 0.0, -1.0]), (33, [0.5, -0.25, 0.75])]  # ids that name several vectors
    rows += [(200, None), (201, []), (202, [1.0, None, 0.0]), (203, [float("nan"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (204, [1.0, 0.5]), (210, [0.5, 0.5]), (89, rows[89][1])]
    got = sorted(map(tuple, topk.top_k(vectors(spark, rows), 5, F.col("id") % 10 == 0).collect()))
    assert got == brute_top(rows, 5, 10)


@pytest.mark.parametrize("candidates", [16384, 20])
def test_an_id_repeated_among_the_best_takes_one_place(spark, monkeypatch, candidates):
    monkeypatch.setattr(topk, "CANDIDATES", candidates)
    rows = [(0, [1.0])] + [(7, [float(1000 - i)]) for i in range(9)] + [(i, [float(500 - i)]) for i in range(10, 60)]
    rows += [(12, [900.0])] + [(100, [float(-i)]) for i in range(9)]
    got = sorted(map(tuple, topk.top_k(vectors(spark, rows), 5, F.col("id") == 0).collect()))
    assert got == brute_top(rows, 5, 50)[:5] and [r[2] for r in got] == [7, 12, 10, 11, 13]


def test_top_k_of_large_components(spark):
    rows = [(0, [3e5, 1.0]), (1, [3e5, 0.5]), (2, [3e5, 0.75]), (3, [-3e5, 0.0])]
    got = sorted(map(tuple, topk.top_k(vectors(spark, rows), 2, F.col("id") == 0).collect()))
    assert got == brute_top(rows, 2, 50)


def test_top_k_of_huge_and_long_vectors(spark):
    top = 1.7e308
    rows = [(0, [top, 0.0]), (1, [top, 0.0]), (2, [-top, 0.0]), (3, [1.0, 0.0])] + [(10 * i, [0.25 * (i + j) % 3 for j in range(5000)]) for i in range(1, 6)]
    got = sorted(tuple(r)[:3] for r in topk.top_k(vectors(spark, rows), 5, F.col("id") % 10 == 0).collect())
    assert [g for g in got if g[0] == 0] == [(0, 1, 1), (0, 2, 3), (0, 3, 2)]
    assert [g for g in got if g[0] > 0] == [r[:3] for r in brute_top(rows[4:], 5, 10)]
    named = vectors(spark, [(0, [1.0]), (1, [2.0])]).withColumns({"query": F.lit("x"), "block": F.lit(7), "comp": F.lit(None).cast("string")})
    assert [tuple(r) for r in topk.top_k(named, 5, F.col("id") == 0).collect()] == [(0, 1, 1, 131072)]


def test_top_k_of_nothing(spark):
    assert topk.top_k(vectors(spark, [(1, [1.0])]).limit(0), 5, F.col("id") == 1).count() == 0
    assert topk.top_k(vectors(spark, [(0, [1.0])]), 5, F.col("id") == 0).count() == 0


def test_ids_are_those_of_the_unchanged_tokenizer(docs_of):
    own = Tokenizer.from_file(tokenizer_path())
    rnd = random.Random(3)
    plain = [*"aZé É×÷ß.,'’!-(sStd…1٣² \n\t\x1c中ñÇ<|>", "'s", "'re", "I'LL", "é"]
    added = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|endof", "text|>", "word "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for parts in (plain, plain + added) for _ in range(2500)]
    ids, edges = packing.WordIds(tokenizer_path()).of(Texts(pa.array(texts), True))
    for t, a, b in zip(texts, edges[:-1], edges[1:], strict=True):
        assert ids[a:b].tolist() == own.encode(t, add_special_tokens=False).ids
    rows = [(1, "one <|endoftext|> two"), (2, "<|startoftext|> text"), (3, "plain"), (4, None), (5, "<|endof"), (6, "text|>")]
    check(packing.pack(docs_of(rows), tokenizer_path()).collect(), rows, 2048)
    assert 49407 in own.encode(rows[0][1], add_special_tokens=False).ids and own.encode(rows[1][1], add_special_tokens=False).ids[0] == 49406


def thue_morse(steps):
    """A word and its complement, which polynomials over 64 bits cannot tell apart."""
    word = "a"
    for _ in range(steps):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_very_long_words_keep_their_own_ids(docs_of):
    rows = [(2 * k + i, w) for k in (3, 6, 10, 12) for i, w in enumerate(thue_morse(k))]
    check(packing.pack(docs_of(rows), tokenizer_path()).collect(), rows, 2048)


def check(rows, texts, length):
    own = Tokenizer.from_file(tokenizer_path())
    by, fill = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, t in texts:
        ids, at = [*own.encode(t or "", add_special_tokens=False).ids, 1], 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += len(part)
        assert at == len(ids)
    for own_pieces in fill.values():
        at = 0
        for offset, n in sorted(own_pieces):
            assert offset == at
            at += n
        assert at <= length
    return sum(r["length"] for r in rows) / (length * len(fill))


def test_packing_is_an_exact_cut(documents, spark):
    texts = [(r["doc_id"], r["text"]) for r in documents.collect()]
    assert check(packing.pack(documents, tokenizer_path()).collect(), texts, 2048) > 0.98
    assert check(packing.pack(documents, tokenizer_path(), length=64, pool=50).collect(), texts, 64) > 0.9


def test_packing_cases(docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "one two " * 3000), (4, "x")]).withColumnRenamed("lang", "pool").withColumnRenamed("source", "length")
    rows = packing.pack(docs, tokenizer_path(), with_ids=True).collect()
    check(rows, [(1, None), (2, ""), (3, "one two " * 3000), (4, "x")], 2048)
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_repeated_rows_are_packed_each(docs_of):
    rows = packing.pack(docs_of([(None, "a b"), (7, "a b"), (7, "a b")]), tokenizer_path()).collect()
    assert len(rows) == 3 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3
    windows = packing.pack(docs_of([(7, "a b " * 4000)] * 3), tokenizer_path()).filter("length = 2048").collect()
    assert len(windows) == len({r["sequence_id"] for r in windows}) > 3 and all(r["offset"] == 0 for r in windows)


def test_best_fit_takes_the_tightest_window():
    sequence, offset = packing.best_fit_decreasing(np.array([7, 5, 3, 3, 2]), 10)
    assert sequence.tolist() == [0, 1, 0, 1, 1] and offset.tolist() == [0, 0, 7, 5, 8]
    rnd = random.Random(2)
    lengths = np.array([rnd.randint(1, 100) for _ in range(400)])
    room, seq = [], []
    for i in np.argsort(-lengths, kind="stable"):  # plain best fit decreasing: as many windows
        fits = [(r, j) for j, r in enumerate(room) if r >= lengths[i]]
        if fits:
            room[min(fits)[1]] -= lengths[i]
        else:
            room.append(100 - lengths[i])
        seq.append(i)
    assert packing.best_fit_decreasing(lengths, 100)[0].max() + 1 == len(room)


def test_long_texts_in_pieces_have_the_same_ids(monkeypatch):
    from qanat.llm import words

    own, known = Tokenizer.from_file(tokenizer_path()), packing.WordIds(tokenizer_path())
    rnd = random.Random(5)
    parts = [*"aZé É×÷.,'’!-(1 \n\t中ñ<|>", "<|endoftext|>", "<|startoftext|>", " word ", "x" * 30, "  \n "]
    for step in (1, 7, 64):
        monkeypatch.setattr(words, "STEP", step)
        for _ in range(150):
            text = "".join(rnd.choice(parts) for _ in range(rnd.randint(2, 60)))
            ids, edges = known.column(pa.array([text]))
            assert ids.tolist() == own.encode(text, add_special_tokens=False).ids and edges.tolist() == [0, len(ids)]
    assert [len(x) for x in known.column(pa.array([None, ""]))] == [0, 3]
