import os
import random
import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from resgov.llm import token_blocks as B
from resgov.session import shared_dir

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


def brute(tokenizer, rows, end_id=2):
    """doc_id, start, n_tokens and checksum of distinct-id rows."""
    out, at = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    cases = [rng.integers(0, 50_000, 1000), np.full(300, 7), rng.integers(0, 2**32, 700), np.array([5]), np.arange(129), np.where(rng.random(5000) < 0.03, 2**32 - 1, rng.integers(100, 140, 5000)), np.zeros(0, np.int64)]
    for ids in cases:
        for percentile in (0.0, 0.5, 0.9, 1.0):
            raw, starts = B.pack(ids.astype(np.uint32), percentile)
            assert (B.unpack(raw, starts[:-1])[:len(ids)] == ids).all() and len(starts) == -(-len(ids) // B.BLOCK) + 1
    # 3 % of outliers: exceptions keep the others at 6 bits
    raw, starts = B.pack(cases[5].astype(np.uint32))
    assert len(raw) < 0.35 * 4 * 5000 and len(B.pack(cases[5].astype(np.uint32), 1.0)[0]) > 3 * len(raw)


def test_segments_and_ranges_of_ids():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 50_000, 10_000)
    one, two = B.segment(3, 0, 0, [1, None], [4000, 6000], ids), B.segment(3, 1, 10_000, [9], [1], ids[:1])
    found = list(B.segments(one + b"\n" + two + b"\n"))
    assert [(s.part, s.number, s.before, s.size, at) for at, s in found] == [(3, 0, 0, 10_000, 0), (3, 1, 10_000, 1, len(one) + 1)]
    s = found[0][1]
    assert list(s.unnamed) == [False, True] and list(s.sizes) == [4000, 6000]
    for begin, end in ((0, 1), (127, 129), (128, 256), (5000, 9999), (9990, 20_000), (7, 7)):
        assert (s.ids(begin, end) == ids[begin:end]).all()
    with pytest.raises(ValueError):
        B.Segment(np.zeros(200, np.uint8))


def test_words_and_pieces_have_the_ids_of_the_whole(tokenizer, monkeypatch):
    with open(FILE, encoding="utf-8") as f:
        encoder = B.Encoder(f.read())
    assert encoder.cuts
    rng = random.Random(3)
    marks = ["ab", "x1", " ", " ", "  ", "\n", "é", "中", "'s", "<|endoftext|>", "!", "\t", "\x1c", "\u2003", "\u00a0", "\u3000", "\u0085", "Z", "\U0001F600", "9", "'", "À", "ɏ", "\u180e", "<|endof", "text|>"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randrange(120))) for _ in range(1500)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    lists = lambda found: [x.tolist() for x in found]
    assert lists(encoder.encode(texts)) == want and lists(encoder.encode(texts[::-1])) == want[::-1]
    assert all("".join(B.pieces(t, 10)) == t for t in texts)
    monkeypatch.setattr(B, "LONG_TEXT", 10)
    monkeypatch.setattr(B, "CACHE", 50)
    monkeypatch.setattr(B.pieces, "__defaults__", (10,))
    assert lists(encoder.encode(texts)) == want
    assert len(list(B.pieces("some words " * 1000, 100))) > 50


def test_a_run_of_texts_is_cut_as_each_of_them():
    texts = ["", " ", "a", "one two two", " lead", "two  spaces here", "tab \there", "é中 \U0001F600 x", "trail ", "one two", "中 文 a b"]
    for some in (texts, texts[:5], ["a  b"], ["a b"], texts[::-1]):
        parts, firsts, rows, counts = B.split_texts(some)
        rest, at = parts.take(pa.array(rows)).to_pylist(), 0
        got = []
        for first, n in zip(firsts, counts):
            got.append([first, *rest[at:at + n]])
            at += n
        assert got == [B.cut(t) for t in some] and at == len(rest)


def test_documents_table(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in B.stored(docs.repartition(5), FILE).collect())
    assert got == brute(tokenizer, rows)


def test_odd_rows(spark, odd, nothing, tokenizer):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted((tuple(r) for r in B.stored(odd, FILE).collect()), key=lambda r: r[1])
    order = [(None, "one two"), *sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])]
    want = []
    for i, text in order:  # rows of one doc_id are equal here
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((i, sum(w[2] for w in want), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert got == want and len(got) == odd.count()
    assert B.stored(nothing, FILE).collect() == []


def test_files_are_in_order_and_ranges_are_read_by_index(spark, tokenizer):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "x"]) for _ in range(rng.randrange(200)))) for i in rng.sample(range(10**6), 300)]
    folder = shared_dir(spark, f"token-ids-{uuid.uuid4().hex}")
    B.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), folder, FILE, segment_ids=500)
    stream = []
    for name in sorted(f for f in os.listdir(folder) if f.startswith("part-")):
        with open(os.path.join(folder, name), "rb") as f:
            for _, s in B.segments(f.read()):
                stream += s.ids().tolist()
    whole = [x for _, text in sorted(rows) for x in tokenizer.encode(text, add_special_tokens=False).ids + [2]]
    assert stream == whole
    index = B.segment_index(B.with_starts(B.read_documents(spark, folder)))
    assert index.count() > 30
    for begin, end in ((0, 10), (1234, 4321), (len(whole) - 3, len(whole) + 50), (len(whole), len(whole) + 1)):
        found = sorted(B.token_range(index, begin, end).collect())
        assert [x for r in found for x in r.ids] == whole[begin:end]
