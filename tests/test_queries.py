"""Each query against its oracle on the smallest tables, in groups; and the compressor's invariants."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from sparkpress.config import MODES, Config
from sparkpress.operators import facts, selection
from sparkpress.plans import engine
from sparkpress.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def rows(table) -> list[str]:
    def plain(v):
        return round(v, 5) if isinstance(v, float) else v

    return sorted(repr({k: plain(v) for k, v in sorted(r.items())}) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, sf, name):
    assert rows(QUERIES[name](spark, sf).toArrow()) == rows(duck.sql(ORACLES[name]).to_arrow_table())


def test_personalisation_rounds_halves_as_its_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect(config={"threads": 1})  # sums in the file's order
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{folder}/lineitem.parquet')")
    assert sorted(map(tuple, QUERIES["personalisation"](spark, folder).collect())) == sorted(con.sql(ORACLES["personalisation"]).fetchall())


def test_word_boundaries_are_those_of_the_sql(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = ["Doñez ñta del el osjarr", "Do it", "Dr. Öz met Müllerdr. Äb here", "émust pay", "noß, never", "user_idé=7 and 5é 30 msé"]
    pq.write_table(pa.table({"doc_id": range(6), "conv_id": range(6), "turn": range(6), "role": ["user"] * 6, "text": texts, "lang": ["en"] * 6}), tmp_path / "conversations.parquet")
    (tmp_path / "documents.parquet").write_bytes((tmp_path / "conversations.parquet").read_bytes())
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    for name in ("record_type_counts", "document_predicates", "sentences", "protection_seed", "tighten", "literal_quantity", "literal_identifier", "fact_merge"):
        assert rows(QUERIES[name](spark, str(tmp_path)).toArrow()) == rows(con.sql(ORACLES[name]).to_arrow_table()), name


def test_terms_of_repeated_and_missing_keys(spark, tmp_path):
    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = ["Alpha beta beta, gamma_1 9x the", None, "", "alpha Delta", "beta epsilon\nÉcole beta", "Zeta x", "the of", "alpha"]
    pq.write_table(pa.table({"doc_id": [1, 1, 2, 3, 3, None, 4, None], "text": texts}), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    for name in ("term_df", "idf", "concept_weights", "top_terms", "generic_share", "information_density", "self_information", "lexical_knn"):
        assert rows(QUERIES[name](spark, str(tmp_path)).toArrow()) == rows(con.sql(ORACLES[name]).to_arrow_table()), name


def test_term_vectors_are_not_shuffled(spark, sf):
    from sparkpress.operators import terms

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    plan = terms.vectors(docs)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Join" not in plan and "Window" not in plan


def test_entry_imports_without_corpus_operators(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "sparkpress.llm", None)
    monkeypatch.setitem(sys.modules, "sparkpress.llm.queries", None)
    entry = importlib.reload(__spark_entry__)
    assert "compress_documents" in entry.queries() and not any(n.startswith("op") and n[2].isdigit() for n in entry.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


TEXT = "The limit is 30 requests. Ordinary words fill this sentence here. You must never share the api key. Other plain talk goes on and on. More filler follows in this place. Nothing else matters today. The end comes soon enough for everyone."


def corpus(spark):
    return spark.createDataFrame([(1, TEXT), (2, ""), (3, None), (4, TEXT + " " + TEXT), (5, "Short.")], "doc_id long, text string")


@pytest.mark.parametrize("mode", sorted(MODES))
def test_compressor_invariants(spark, mode):
    docs = corpus(spark)
    out = {r.doc_id: r for r in engine.compress(docs, Config(mode)).collect()}
    assert len(out) == 5
    for r in out.values():
        assert r.tokens_out <= r.tokens_in
    assert out[2].text == "" and out[3].text == ""
    assert "must never share" in out[1].text and "30 requests" in out[1].text
    source = TEXT.lower().replace(".", " ").split()
    assert set(out[1].text.lower().replace(".", " ").split()) <= set(source)


def test_compressor_is_deterministic(spark):
    once = sorted(map(str, engine.compress(corpus(spark)).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(map(str, engine.compress(corpus(spark)).collect())) == once
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_audit_sees_a_loss(spark):
    source = spark.createDataFrame([(1, "Pay 250 euros by 2024-05-01.")], "doc_id long, text string")
    broken = source.withColumn("text", F.lit("Pay 950 euros by 2024-05-01."))
    assert facts.missing(facts.facts(source), facts.facts(source)).count() == 0
    assert {r.fact for r in facts.missing(facts.facts(source), facts.facts(broken)).collect()} >= {"n:250"}
    assert [r.word for r in facts.provenance(source, broken).collect()] == ["950"]


def test_waterfill():
    import numpy as np

    value, cap = np.array([1.0, 4.0, 2.0]), np.array([50.0, 50.0, 50.0])
    share = selection.waterfill(value, cap, 60)
    assert abs(share.sum() - 60) < 1e-3 and share[1] > share[2] > share[0] and (share <= cap + 1e-9).all()
    assert (selection.waterfill(value, cap, 500) == cap).all()
    assert (selection.waterfill(value, cap, 60, np.full(3, 5.0)) >= 5 - 1e-9).all()


def test_greedy_respects_budget_and_covers():
    parts = [[("a", 1.0)], [("a", 1.0)], [("b", 1.0)], [("c", 1.0), ("d", 1.0)]]
    weight = dict.fromkeys("abcd", 1.0)
    kept = selection.lazy_greedy([10, 10, 10, 10], parts, weight, 30, [False] * 4, 0.0)
    assert kept == [0, 2, 3]
    assert 1 in selection.lazy_greedy([10, 10, 10, 10], parts, weight, 30, [False, True, False, False], 0.0)


def test_near_pairs_move_no_sets(spark, sf):
    """Sets of shingles stay where they are made; what is joined are packed prefixes, by the corpus join, which needs no corpus operator."""
    import sys

    from sparkpress.operators import jaccard_join, similarity

    assert jaccard_join.__name__ == "sparkpress.operators.jaccard_join" and not any(m.startswith("sparkpress.llm") for m in (similarity.jaccard_join.storage.__name__, similarity.jaccard_join.K.__name__))
    assert "sparkpress.operators.jaccard_join" in sys.modules
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l"), (2, "A b, c d e f 12 g h i j k l"), (3, "a b c d e f g h i j k l m"), (4, "x y"), (5, "x 7y"), (6, None), (7, "12")], "doc_id long, text string")
    assert sorted(map(tuple, similarity.jaccard_pairs(docs, 0.82).collect())) == [(1, 2, 10, 1.0), (1, 3, 10, 10 / 11), (4, 5, 1, 1.0)]
    assert sorted(map(tuple, similarity.jaccard_groups(docs, 0.82).collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
