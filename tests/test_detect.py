"""Line labels, code symbols, conversation and graph operators on small fixtures."""

from __future__ import annotations

import itertools

import numpy as np

from sparkpress.operators import code, doctype, graphs


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    scores = rng.random((4, len(doctype.LABELS))) * 5
    leave = [doctype.SWITCH + doctype.STAY.get(n, 0.0) for n in doctype.LABELS]

    def value(path):
        return sum(scores[t, p] for t, p in enumerate(path)) - sum(leave[a] for a, b in zip(path, path[1:]) if a != b)

    best = max(itertools.product(range(len(doctype.LABELS)), repeat=4), key=value)
    assert abs(value(tuple(doctype.viterbi(scores))) - value(best)) < 1e-9


def test_document_types(spark):
    from sparkpress.queries.detect import ROWS

    rows = spark.createDataFrame(ROWS, "doc_id long, n long, line string")
    found = doctype.document_type(doctype.regions(doctype.labelled(doctype.line_scores(rows))))
    kinds = {r.doc_id: r.doctype for r in found.collect()}
    assert kinds[2] == "logs" and kinds[3] == "conversation" and kinds[4] == "json" and kinds[6] == "sql" and kinds[7] == "table"


def test_symbols():
    rows = code.symbols_of(1, "def f(a, b=2):\n    '''Doc.'''\n    return g(a) if b else h(b)\n\nclass C:\n    def m(self):\n        pass\n")
    assert [(r[1], r[2], r[5]) for r in rows] == [("f", "function", "def f(a, b=2)"), ("C", "class", "class C"), ("C.m", "function", "def m(self)")]
    assert rows[0][7] == ["g", "h"] and rows[0][8] == 2
    assert code.symbols_of(1, "def broken(:") == []
    same = [code.symbols_of(i, f"def f({x}):\n    y = {x} + 1\n    return y\n")[0][9] for i, x in enumerate("ab")]
    assert same[0] == same[1] != code.symbols_of(3, "def f(a):\n    y = a + 2\n    return y\n")[0][9]


def test_pagerank_is_a_distribution(spark):
    units = spark.createDataFrame([(i,) for i in range(6)], "uid long")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (2, 0, 1.0), (3, 0, 0.5)], "src long, dst long, weight double")
    rows = graphs.pagerank(units, edges, units.selectExpr("uid", "1.0D AS p"), 4).collect()
    assert abs(sum(r.r for r in rows) - 1) < 1e-9 and all(r.r > 0 for r in rows)


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 5)], "src long, dst long")
    found = {r.uid: r.depth for r in graphs.closure(spark.createDataFrame([(1,)], "uid long"), edges, 3).collect()}
    assert found == {1: 0, 2: 1, 3: 2, 4: 3}
