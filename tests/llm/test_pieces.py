import random

import pytest

from resgov.llm import pieces as P
from resgov.llm.queries import MODEL_FILE

TEXTS = ["", " ", "a", " a", "a  b   c", "Hello world unbelievable", "é中\U0001F600 x", "\n\n\tfoo", "aaaaaaaaaaaaaaaaaaaa", "x,y.z!!", "▁", "a▁b", "▁▁ x ▁ "]


@pytest.fixture(scope="module")
def coder():
    return P.Coder(P.Vocabulary(MODEL_FILE))


def every(coder, text, at=0):
    """All segmentations of a segment by brute force: (score, ids)."""
    if at == len(text):
        yield 0.0, ()
        return
    for end in range(at + 1, len(text) + 1):
        piece = coder.v.ids.get(text[at:end])
        if piece is None and end == at + 1:
            piece = (None, coder.v.unknown)
        if piece is not None:
            own = (piece[0],) if piece[0] is not None else tuple(coder.v.bytes[b] for b in text[at:end].encode())
            for s, ids in every(coder, text, end):
                yield piece[1] + s, own + ids


def test_n_best_of_a_segment(coder):
    for text in ("▁unable", "▁▁the", "believe", "aaaaaaa", "▁été"):
        want = sorted((s for s, _ in every(coder, text)), reverse=True)[:7]
        got = coder.a_star(text, 7)
        assert [s for s, _ in got] == want and len({i for _, i in got}) == len(got)
        ids, best, loss = coder._best(text)
        assert best == want[0] and loss == pytest.approx(want[0] - want[1]) and ids == got[0][1]


def test_n_best_of_texts_is_the_librarys(coder):
    """The same vocabulary read as a unigram model by the library gives the same scores."""
    import sentencepiece
    with open(MODEL_FILE, "rb") as f:
        library = sentencepiece.SentencePieceProcessor(model_proto=f.read() + b"\x12\x02\x18\x01")
    rng = random.Random(1)
    texts = [t for t in TEXTS if t and "▁" not in t] + ["".join(rng.choice("ab c\né中") for _ in range(20)) for _ in range(40)]
    for text in texts:
        got = [s for s, _ in coder.n_best(text, 5)]
        want = [x.score for x in library.nbest_encode(text, nbest_size=5, return_type="proto").nbests]
        assert got == sorted(got, reverse=True) and len(got) == len(want)
        # scores are whole numbers, the library adds them up in single precision
        assert all(abs(a - b) <= 2e-6 * abs(b) for a, b in zip(got, want)), text


def test_round_trip(coder):
    rng = random.Random(2)
    for text in TEXTS + ["".join(chr(rng.choice([32, 9, 10, 65, 97, 233, 0x2581, 0x4E2D, 0x1F600, 0x3145])) for _ in range(30)) for _ in range(60)]:
        ways = coder.n_best(text, 4)
        assert all(coder.decode(ids) == text for _, ids in ways) and len({tuple(i) for _, i in ways}) == len(ways)


def test_long_segment(coder):
    assert coder.decode(coder.n_best("a" * 20_000, 3)[2][1]) == "a" * 20_000


def test_alternatives_are_the_n_best(coder):
    rng = random.Random(4)
    for text in TEXTS + ["".join(rng.choice("ab theing\né中") for _ in range(200)) for _ in range(40)]:
        ids, ways = coder.ways(text, 6)
        assert [(s, P.changed(ids, c)) for s, c in ways] == coder.n_best(text, 6) and ways[0][1] == ()
        for _, changes in ways:
            assert all(0 <= b < e <= len(ids) for b, e, _ in changes) and list(changes) == sorted(changes)


def plainly(coder, text):
    """Segments of a text one after another; a literal mark is None."""
    known = {c for name in coder.v.lattice for c in name} - {P.MARK}
    out, marks, open_ = [], P.MARK, False
    for c in text if text else ():
        if c == " ":
            marks, open_ = marks + P.MARK, False
            continue
        if c in known and open_:
            out[-1] += c
        elif c in known:
            out.append(marks + c)
        else:
            out += ([marks] if marks else []) + [None if c == P.MARK else c]
        marks, open_ = "", c in known
    return out + ([marks] if marks and text else [])


def odd_texts(seed, count):
    rng = random.Random(seed)
    return ["".join(rng.choice([" ", " ", "\n", "▁", "a", "the", "ing", "é", "中", "ㅅ", "\0", "\U0001F600"]) for _ in range(rng.randint(0, 30))) for _ in range(count)]


def test_short_segments_are_passed_over_together(coder, monkeypatch):
    """No pass of its own for a new short segment, and the same ids, score and loss as by one."""
    fresh, alone = P.Coder(coder.v), []
    monkeypatch.setattr(fresh, "_best", lambda text: alone.append(text) or coder._best(text))
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abcdeinghé") for _ in range(rng.randint(1, 30))) for _ in range(50)) for _ in range(20)]
    for text in texts:
        ids, ways = fresh.ways(text, 4)
        best = [coder._best(P.MARK + word) for word in text.split(" ")]
        assert ids == [i for b in best for i in b[0]] and ways[0][0] == sum(b[1] for b in best)
        assert ways[0][0] - ways[1][0] == min(b[2] for b in best)
    assert alone == []


def test_runs_of_texts_have_the_ids_of_their_segments(coder, monkeypatch):
    """Whatever the run, the cache and the number of segments passed over together."""
    monkeypatch.setattr(P, "CACHE", 40)
    monkeypatch.setattr(P, "TOGETHER", 7)
    monkeypatch.setattr(P, "SHORT", 6)
    fresh, texts = P.Coder(coder.v), TEXTS + odd_texts(6, 300) + ["", "a\n b", "a \nb", "  \n  ▁ ", "a" * 500 + "中" * 50]
    for begin in range(0, len(texts), 10):
        run = texts[begin:begin + 10]
        ids, ends, numbers, cuts = fresh.coded(run)
        assert fresh.decoded(ids, ends) == run
        for k, text in enumerate(run):
            best = [coder._literal() if s is None else coder._best(s) for s in plainly(coder, text)]
            assert ids[ends[k]:ends[k + 1]].tolist() == [i for b in best for i in b[0]], text
            ways = fresh.best_ways(numbers[cuts[k]:cuts[k + 1]], 2)
            assert [ways[0][0] - score for score, _ in ways[1:]] == [x for x in [min((b[2] for b in best), default=float("inf"))] if x < float("inf")]
    assert fresh.coded([])[0].tolist() == []


def test_a_known_character_without_a_piece(coder, monkeypatch):
    """Its bytes stand for it, in a run as alone."""
    vocabulary = P.Vocabulary(MODEL_FILE)
    vocabulary.lattice["é"] = (1, -1, vocabulary.unknown)
    fresh = P.Coder(vocabulary)
    ids, ways = fresh.ways("xéx é", 3)
    assert (tuple(ids), ways[0][0]) == (fresh._best("▁xéx")[0] + fresh._best("▁é")[0], fresh._best("▁xéx")[1] + fresh._best("▁é")[1])
    assert all(fresh.decode(i) == "xéx é" for _, i in fresh.n_best("xéx é", 3))


def test_decode_of_any_ids(coder):
    b = coder.v.bytes
    assert coder.decode([]) == "" and coder.decode([b[0xC3], b[0xA9], b[0x20]]) == "é " and coder.decode([b[0x20], b[0xE4], b[0x61]]) == "\ufffda"


def test_runs_are_bounded(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(P, "RUN_ROWS", 3)
    monkeypatch.setattr(P, "RUN_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"text": ["a", None, "b", "c", "x" * 30, "d", "e"]})
    assert [r.num_rows for r in P._runs(batch, 0)] == [3, 2, 2] and list(P._runs(batch.slice(0, 0), 0)) == []


def test_frames(spark, odd, nothing):
    encoded = P.encode(odd, MODEL_FILE, 3)
    back = P.decode(encoded, MODEL_FILE)
    assert sorted((r.doc_id or 0, r.text or "") for r in back.collect()) == sorted((r.doc_id or 0, r.text or "") for r in odd.collect())
    coder = P.Coder(P.Vocabulary(MODEL_FILE))
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    found = P.segmentations(odd, MODEL_FILE).collect()
    assert len(found) == odd.count() and all(r.round_trip and r.n_pieces == len(r.ids) for r in found)
    for r in found:
        ways = coder.n_best(texts[r.doc_id], P.N_BEST)
        assert [(r.score, r.ids)] + [(a.score, P.changed(r.ids, [(c.begin, c.end, c.ids) for c in a.changes])) for a in r.alternatives] == ways and r.n_chars == len(texts[r.doc_id])
    out = P.corpus(odd, MODEL_FILE)
    assert out.columns == [c for c in odd.columns if c != "text"] + list(P.NEW_COLUMNS) and out.count() == odd.count()
    assert P.segmentations(nothing, MODEL_FILE).collect() == [] and P.corpus(nothing, MODEL_FILE).collect() == [] and P.encode(nothing, MODEL_FILE).collect() == []


def test_columns_with_the_new_names_stay(spark):
    docs = spark.createDataFrame([("a b", 1.5, "x", 7, 8)], "text string, score double, ids string, _score long, `odd name` int")
    row = P.corpus(docs, MODEL_FILE).first()
    assert (row["score"], row["ids"], row["_score"], row["odd name"]) == (1.5, "x", 7, 8)
    assert row["__score"] < 0 and len(row["_ids"]) == row["n_pieces"] and row["round_trip"]
