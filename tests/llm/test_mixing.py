import pytest

from resgov.llm.mixing import mix, mixed_documents

WEIGHTS = (3, 1, 2)


def brute_targets(sizes, share, most):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        out = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if out[s] >= most * sizes[s]]
        if not over:
            return out | {s: most * sizes[s] for s in capped}
        capped |= set(over)
        if len(capped) == len(names):
            return {s: most * sizes[s] for s in capped}


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_targets_and_taken(spark, documents):
    rows = mix(documents).collect()
    size = {}
    for r in rows:
        size[r.source] = size.get(r.source, 0) + r["size"]
    want = brute_targets(size, 1.5, 2.0)
    taken, largest = {}, max(r["size"] for r in rows)
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-6 * want[r.source] and 0 <= r.copies <= 2 and r.source_size == size[r.source]
        taken[r.source] = taken.get(r.source, 0) + r["size"] * r.copies
    assert all(abs(taken[s] - want[s]) <= min(largest, 0.02 * want[s]) for s in want)
    assert sum(taken.values()) == pytest.approx(sum(want.values()), rel=0.05)
    again = mix(documents.repartition(7)).collect()
    assert sorted((r.doc_id, r.copies) for r in rows) == sorted((r.doc_id, r.copies) for r in again)


def test_tree_of_blocks_is_fair(spark, monkeypatch):
    from resgov.llm import mixing
    monkeypatch.setattr(mixing, "BLOCK", 8)
    df = spark.range(600).selectExpr("id as doc_id", "repeat('w ', cast(1 + id % 50 as int)) as text", "'s' || (id % 2) as source")
    first = {r.doc_id: r for r in mix(df, share=0.5, most=2.0).collect()}
    for s in ("s0", "s1"):
        got = sum(r["size"] * r.copies for r in first.values() if r.source == s)
        want = next(r.target for r in first.values() if r.source == s)
        assert abs(got - want) <= 50
    seen = {i: 0 for i in first}
    for seed in range(6):
        for r in mix(df, share=0.5, most=2.0, seed=seed).collect():
            seen[r.doc_id] += r.copies
    assert len({v for v in seen.values()}) > 2  # another seed takes other documents


def test_odd_rows(spark, odd, nothing):
    rows = mix(odd).collect()
    assert len(rows) == odd.count() and all(r.copies == 0 for r in rows if r["size"] == 0)
    assert sum(r.copies for r in rows) == mixed_documents(odd).count()
    assert mixed_documents(odd).columns == odd.columns
    assert mix(nothing).collect() == [] and mixed_documents(nothing).collect() == []
    blank = odd.where("text is null or trim(text) = ''")
    assert all(r.copies == 0 and r.target == 0 for r in mix(blank).collect())


def test_repeated_rows_share_their_copies(spark, monkeypatch):
    """A row that holds a third of all, with columns named like the helpers: each repeat comes as often as mix() says."""
    from resgov.llm import mixing
    monkeypatch.setattr(mixing, "NUMBERS", 64)
    names = "doc_id long, text string, source string, _row int, _words int, _copies int, copy int, copies int, step int, nth int, `rows` int, `all` int, part int"
    rows = [(1, "same words here", "a") + (7,) * 10] * 500 + [(i, "w " * (1 + i % 9), "ab"[i % 2]) + (i,) * 10 for i in range(2, 900)] + [(None, "", None) + (0,) * 10] * 300
    docs = spark.createDataFrame(rows, names).repartition(6)
    plan, out = mix(docs).collect(), mixed_documents(docs)
    assert out.columns == docs.columns and len(plan) == len(rows)
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    want = {}
    for r in plan:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    assert got == {i: n for i, n in want.items() if n} and len({r.copies for r in plan if r.doc_id == 1}) <= 2
    assert all(r._row == (7 if r.doc_id == 1 else r.doc_id) for r in out.collect())


def test_plan_is_native(spark, documents):
    plan = mix(documents)._jdf.queryExecution().toString() + mixed_documents(documents)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
