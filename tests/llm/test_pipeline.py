import os
import subprocess
import sys

import corpus_pipeline as C
import __spark_entry__ as E
from pyspark.sql import functions as F
from resgov.llm import near_dedup, pii, pieces
from resgov.llm.queries import MODEL_FILE, queries

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in queries()] == [f"op{i}" for i in range(1, 14)]
    assert set(queries()) | {"pipeline"} <= set(E.queries()) and "pipeline" not in E.oracle_sql()


def test_stages_one_by_one(spark):
    """Each stage on what the one before kept, against plain computations."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(C.STAGES)
    kept = C.written(stages["toxicity"](spark, docs, SF), "t")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} <= set(rows)
    single = C.written(stages["near_dedup"](spark, kept, SF), "t")
    want = {r.doc_id for r in near_dedup.near_duplicates(kept, 5, 80).collect() if r.kept}
    assert {r.doc_id for r in single.collect()} == want and single.columns == docs.columns
    covered = C.written(stages["personal_data"](spark, single, SF), "t")
    assert covered.columns == docs.columns
    for r in covered.collect():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
        if not pii.base_spans(rows[r.doc_id].text):
            assert "<" in r.text or r.text == rows[r.doc_id].text
    mixed = C.written(stages["mixing"](spark, covered, SF), "t")
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id").count().where("count > 2").count() == 0
    out = stages["encoding"](spark, mixed, SF).collect()
    coder, texts = pieces.Coder(pieces.Vocabulary(MODEL_FILE)), {r.doc_id: r.text for r in covered.collect()}
    assert len(out) == mixed.count() and all(coder.decode(r.ids) == texts[r.doc_id] and r.n_pieces == len(r.ids) for r in out)


def test_stages_keep_columns_of_any_name(spark):
    """Columns named like a stage's helpers or results pass every stage unchanged."""
    names = ["_row", "row", "_words", "_copies", "_copy", "copies", "node", "score", "ids", "n_pieces", "alternatives", "label", "odd name", "Size"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 120")
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.col("doc_id") * 100 + i)
    for name, stage in C.STAGES:
        docs = C.written(stage(spark, docs, SF), "t")
        rows = docs.collect()
        assert rows and all(r[n] == r["doc_id"] * 100 + i for r in rows for i, n in enumerate(names)), name
    assert docs.columns[-5:] == ["_n_pieces", "_score", "_ids", "_alternatives", "round_trip"] and all(r["round_trip"] for r in rows)


def test_mixing_and_encoding_of_odd_rows(spark, odd, nothing):
    kept = C.mixing(spark, odd, SF)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} <= {r.doc_id for r in odd.collect()}
    out = C.encoding(spark, odd, SF)
    assert out.count() == odd.count() and all(r.round_trip and len(r.alternatives) <= 3 for r in out.collect())
    for name, stage in C.STAGES:
        assert stage(spark, nothing, SF).collect() == [], name


def test_near_dedup_keeps_one_row_of_a_group(spark, odd):
    """Repeated rows, null ids and one id over two texts: one row of each group, every row without words."""
    words, other = " ".join(f"a{i}" for i in range(90)), " ".join(f"b{i}" for i in range(90))
    more = [(None, words), (None, words + " end"), (50, words + " last"), (51, other), (50, other + " end"), (None, other + " end"), (None, "one of a kind"), (None, "one of a kind"), (60, "left alone"), (60, "right alone")]
    docs = odd.unionByName(spark.createDataFrame([(i, t, "en", "a", len(t), "n", 1, 2) for i, t in more], odd.schema))
    out = C.near_dedup(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text if len(r.text or "") < 1000 else "long") for r in out.collect()), key=repr)
    single = {r.doc_id: r.text for r in odd.collect()}
    want = [(1, single[1]), (3, None), (4, ""), (5, " \t\n"), (6, "one two"), (7, "long"), (9, single[9]), (50, words + " last"), (50, other + " end"), (None, "one of a kind"), (60, "left alone"), (60, "right alone")]
    assert got == sorted(want, key=repr)


def test_entry_stands_without_the_optional_package(tmp_path):
    """With neither corpus_pipeline nor llm importable, the entry point has the other queries."""
    code = ("import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as E; q = E.queries(); "
            "assert 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and set(E.oracle_sql()) <= set(q)")
    root = os.path.dirname(os.path.abspath(C.__file__))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, env=os.environ | {"PYTHONPATH": root}, timeout=120)
