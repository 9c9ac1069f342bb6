import hashlib
import random

import numpy as np

from resgov.llm import order_minhash as O


def brute(rows):
    """(doc_id, n_chars, edited sha256, likeness to edited, likeness to next) in descending doc_id order."""
    prints = {}

    def fp(t):
        if t not in prints:
            prints[t] = O.fingerprint(O.code_points(t))
        return prints[t]

    out = []
    for k, (i, t) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + other[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fp(t).tobytes().hex(), fp(edited).tobytes().hex(), O.likeness(fp(t), fp(edited)), O.likeness(fp(t), fp(other))))
    return out


def test_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), reverse=True)
    assert sorted(tuple(r) for r in O.edited_fingerprints(df.repartition(5)).collect()) == sorted(brute(rows))
    plain = {r.doc_id: (r.n_chars, r.fingerprint) for r in O.fingerprints(df).collect()}
    assert all(plain[i] == (n, f) for i, n, _, f, *_ in brute(rows))


def test_few_rows(spark, nothing):
    one = spark.createDataFrame([(7, "abcdef")], "doc_id long, text string")
    r = O.edited_fingerprints(one).first()
    assert r.n_chars == 6 and r.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and r.near_next == 1.0
    assert O.edited_fingerprints(nothing).collect() == []


def test_odd_rows(odd):
    got = O.edited_fingerprints(odd).collect()
    assert len(got) == odd.count()
    assert len({r.fingerprint for r in got if r.doc_id in (1, 2)}) == 1 and len({r.fingerprint for r in got if r.n_chars == 0}) == 1


def test_order_counts():
    rng = random.Random(3)
    blocks = ["".join(rng.choice("abcdefgh ") for _ in range(40)) for _ in range(30)]
    text, swapped = "".join(blocks), "".join(blocks[::-1])
    small = text[:500] + "X" + text[501:]
    fp = lambda t: O.fingerprint(O.code_points(t))
    assert O.likeness(fp(text), fp(small)) > 0.8 > 0.75 > O.likeness(fp(text), fp(swapped))


def test_occurrence_numbers():
    kmers = np.array([5, 7, 5, 9, 7, 5], dtype=np.uint64)
    assert list(O.occurrences(kmers)) == [0, 0, 1, 0, 1, 2]


def plain_fingerprint(text, k=O.K, l=O.L):
    """The definition in whole numbers: every k-mer with its occurrence number ranked by each permutation, the l least in text order hashed."""
    low = 2**64 - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & low
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & low
        return x ^ (x >> 31)

    step, k = int(O._STEP), min(k, len(text))

    def window(i, width):
        """Hash of text[i:i + width] from its longest power of two and the rest that adjoins or overlaps."""
        if width == 1:
            return mix((ord(text[i]) + step) & low)
        half = 1
        while half * 2 < width:
            half *= 2
        part = min(half, width - half)
        h = ((window(i, half) * step) & low) ^ ((window(i + part, half) + half) & low)
        return h ^ (h >> 29)

    kmers, seen, keys = [mix(window(i, k)) for i in range(len(text) - k + 1)], {}, []
    for x in kmers:
        keys.append(mix((x + seen.get(x, 0) * step) & low))
        seen[x] = seen.get(x, 0) + 1
    out = []
    for j in range(O.M):
        ranks = [((key ^ int(O._XOR[j])) * int(O._MUL[j])) & low for key in keys]
        entry = step
        for i in sorted(sorted(range(len(keys)), key=lambda i: (ranks[i], i))[:l]):
            entry = (entry * 0xD6E8FEB86659FD93 + kmers[i]) & low
            entry ^= entry >> 31
        out.append(mix(entry) >> 32)
    return out


def test_fingerprint_against_its_definition():
    rng = random.Random(8)
    texts = ["a", "ab", "aaaaaaaaaaaaaaaaaaaaaaaa", "abcabcabcabcabcabcabc", "é中\U0001F600 x é中\U0001F600 x"] + ["".join(rng.choice("ab c") for _ in range(rng.randrange(1, 120))) for _ in range(12)]
    for text in texts:
        assert O.fingerprint(O.code_points(text)).tolist() == plain_fingerprint(text), text
