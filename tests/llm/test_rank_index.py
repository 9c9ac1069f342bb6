import hashlib
import random
import re

import numpy as np
import pytest

from resgov.llm import rank_index as R

LINE = re.compile(r"[^\n]*\n|[^\n]+")
TEXTS = ["", "\n", "\n\n\n", "one", "one\n", "one\ntwo", "é中\U0001F600\n\U0001F600", "a <P> mark\nb\nc", "x <S>", "<M>\n", "a\r\nb\x0bc\x85d e\nf", "<P\n>S<\n<"]


def brute(doc_id, text):
    """n, form, prefix and middle length, output by the plain rule."""
    units = LINE.findall(text)
    digest = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_index_is_exact_and_bounded():
    rng = np.random.default_rng(1)
    for steps in (rng.integers(0, 90, 5000), rng.pareto(0.6, 3000).astype(np.int64) % 10**9, np.ones(2000, np.int64), np.zeros(500, np.int64), np.array([], np.int64), rng.integers(0, 2, 3000) * 5000):
        offsets = np.concatenate([[0], np.cumsum(steps)]).astype(np.int64)
        for error in (1, 16, R.ERROR):
            index = R.fit(offsets, error)
            assert (index.offset(np.arange(len(offsets))) == offsets).all() and len(index) == len(steps)
            assert np.abs(offsets - index.predict(np.arange(len(offsets)))).max() <= error + 1
    even = R.fit(np.arange(10_000) * 37)
    assert len(even.ranks) == 1 and even.residuals.nbytes == 10_000


def test_transform_and_restore():
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice(["\n", "ab", "é", "<", "P>", "S", "<P", " "]) for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    forms = set()
    for i, text in enumerate(texts):
        index, form, output, prefix, middle = R.transform(i, text)
        assert (len(index), form, prefix, middle, output) == brute(i, text) and R.restore(output, form) == text
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}
    with pytest.raises(ValueError):
        R.restore("no marks", "psm")


def test_rates():
    text = "a\nb\nc\n"
    assert all(R.transform(i, text, rate=0)[1] == "plain" for i in range(50))
    assert all(R.transform(i, text, spm_rate=0)[1] == "psm" for i in range(50))
    assert R.transform(1, text, seed=8)[2] != R.transform(1, text)[2] or R.transform(2, text, seed=8)[2] != R.transform(2, text)[2]


def test_frames(spark, odd, nothing):
    docs = odd.unionByName(spark.createDataFrame([(100, "line\n" * 100_000, "en", "a", 0, "n", 1, 2)], odd.schema))
    rows = docs.collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted((r.doc_id if r.doc_id is not None else -1, *brute("" if r.doc_id is None else r.doc_id, r.text or "")[:2], sha(brute("" if r.doc_id is None else r.doc_id, r.text or "")[4]), sha(r.text or "")) for r in rows)
    got = R.digests(docs).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n, r.form, r.output_sha256, r.restored_sha256) for r in got) == want
    stored = {r.doc_id: r for r in R.indexed(docs).collect()}
    index = R.RankIndex(*(np.array(stored[100][c]) for c in ("ranks", "starts", "slopes")), np.frombuffer(stored[100].residuals, np.int8))
    assert list(index.offset([0, 5, 99_999, 100_000])) == [0, 25, 499_995, 500_000] and stored[3].n == 0
    for f in (R.digests, R.indexed, R.transformed):
        assert f(nothing).collect() == []
