import random
import re

import numpy as np
import pytest

from resgov.llm import near_dedup as N
from resgov.llm.frames import components
from resgov.llm.words import hash_words, word_hash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, k, percent):
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOW))
        sets.append(set(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else ({tuple(w)} if w else set()))
    top = list(range(len(rows)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                top[root(i)] = root(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[root(i)] = min(low.get(root(i), doc), doc)
    return [(doc, len(sets[i]), low.get(root(i))) for i, (doc, _) in enumerate(rows)]


def got(df):
    return [(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()]


def test_word_hashes():
    raw = "One  twoé one\n".encode()
    h, bounds = hash_words(np.array([0, 8, len(raw)]), np.frombuffer(raw, np.uint8))
    assert list(bounds) == [0, 2, 4] and int(h[0]) == word_hash("one") == int(h[3])
    assert hash_words(np.array([0, 0]), np.zeros(0, np.uint8))[0].size == 0


def order(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_against_brute_force(spark, k, percent):
    rng = random.Random(k)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([2, 4, 8, 60, 150]))]
        for _ in range(rng.choice([1, 3, 12])):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append(" ".join(text))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert order(got(N.near_duplicates(df, k, percent))) == order(brute(rows, k, percent))


def test_blocks_join_what_stars_miss(spark, monkeypatch):
    """With one centre a bucket and small blocks, a chain of near copies is still one component."""
    monkeypatch.setattr(N, "BLOCK", 3)
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(words[i:i + 60])) for i in range(0, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert order(got(N.near_duplicates(df, 3, 85))) == order(brute(rows, 3, 85))


def test_joining_counts_common_elements():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(20, 50))) for _ in range(40)]
    labels = list(range(40))
    found = N.joining(labels, labels, [0] * 40, sets, 50)
    top = list(range(40))
    for a, b in found:
        ra, rb = top[a], top[b]
        top = [min(ra, rb) if t in (ra, rb) else t for t in top]
    want = list(range(40))
    for i in range(40):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 50 * (len(sets[i]) + len(sets[j]) - both):
                ra, rb = want[i], want[j]
                want = [min(ra, rb) if t in (ra, rb) else t for t in want]
    assert top == want


def test_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    out = N.near_duplicates(odd, 3, 85)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert order(got(out)) == order(brute(rows, 3, 85))


def test_empty_table(spark, nothing):
    assert N.near_duplicates(nothing).collect() == []


def test_densified_minima_are_of_the_set():
    probes = N.probe_table(256)
    for size in (1, 2, 7, 5000):
        members = np.unique(np.random.default_rng(size).integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
        minima = N.bin_minima(members, 256, probes)
        assert len(minima) == 256 and np.isin(minima, members).all()


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    found = {r.node: r.label for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def near_copies(words, n, places):
    """n texts, each with one other word of its own."""
    out = []
    for i in range(n):
        text = list(words)
        text[places[i]] = f"other{i}"
        out.append(" ".join(text))
    return out


def test_null_ids_and_shared_ids(spark):
    """Near copies without id link, and of two texts under one id each has its own links."""
    a, b = ([f"{c}{i}" for i in range(150)] for c in "ab")
    rows = [(5, " ".join(a)), *((None, t) for t in near_copies(a, 4, [3, 60, 100, 140])), (7, " ".join(b)), (7, " ".join(a[:60])), (3, near_copies(a[:60], 1, [59])[0]),
            *((None, t) for t in near_copies(b, 2, [20, 90])), (8, near_copies(b, 3, [0, 1, 149])[2])]
    for _ in range(3):
        random.Random(len(rows)).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert order(got(N.near_duplicates(df, 3, 85))) == order(brute(rows, 3, 85))
        rows = rows + [(7, "one two three")]
