"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables, and extra columns with clashing names."""

from __future__ import annotations

import pytest

from sparkpress.llm import capture_index, decontaminate, fingerprints, hmm, jaccard_join, quality, sentencepiece, sharding, style_tree, token_counts

LONG = " ".join(f"word{i % 97} tail" for i in range(6000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a"), (1, "alpha beta gamma delta epsilon zeta eta theta", "en", "a"), (2, "Alpha beta, gamma delta epsilon zeta eta theta!", "en", "b"),
    (3, None, None, None), (None, "alpha beta gamma delta", "de", None), (4, "", "en", "a"), (5, "   \n\t ", None, "b"), (6, LONG, "fr", "c"), (7, LONG + " end", "fr", "c"), (8, "x" * 70000, "en", "a"), (9, "one", "en", "a"), (10, "漢字 ünï 😀 ok", "en", "z"), (None, None, None, None),
]


def table(spark, rows=ROWS):
    """Documents with extra columns whose names the operators use inside."""
    full = [(*r, len(r[1] or ""), 1, 2, 3, "s", "h", "b", "t") for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, hash long, size int, sig long, slab string, hilbert string, bucket string, term string")


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (8, 0, 0), (9, 0, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")


def benchmark(spark, rows=((1, "gamma delta epsilon zeta"), (2, None), (None, "alpha"), (3, ""), (4, LONG[:400]))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


OPERATORS = {
    "decontaminate": lambda s, d: decontaminate.contamination(d, benchmark(s)),
    "jaccard": lambda s, d: jaccard_join.jaccard_pairs(d),
    "keep_one": lambda s, d: jaccard_join.keep_one(d),
    "token_counts": lambda s, d: token_counts.token_counts(d, chunk_chars=2000, overlap=50),
    "sentencepiece": lambda s, d: sentencepiece.encode(d),
    "hmm": lambda s, d: hmm.score(d, states=2, iterations=1),
    "fingerprints": lambda s, d: fingerprints.fingerprints(d),
    "quality": lambda s, d: quality.score(d, labels(s)),
    "accepted": lambda s, d: quality.accepted(d, labels(s)),
    "sharding": lambda s, d: sharding.hilbert_shards(d, target_chars=1000),
}
PER_ROW = {"token_counts", "sentencepiece", "hmm", "fingerprints", "quality", "sharding"}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    out = OPERATORS[name](spark, table(spark)).collect()
    if name in PER_ROW:
        assert len(out) == len(ROWS)
    if name == "jaccard":
        assert {(r.doc_a, r.doc_b) for r in out} == {(1, 2), (6, 7)}
    if name == "keep_one":
        assert sorted((r.doc_id or 0) for r in out) == [0, 0, 1, 1, 3, 4, 5, 6, 8, 9, 10]
    if name == "decontaminate":
        assert {(r.doc_id, r.item_id) for r in out} >= {(1, 1), (2, 1), (6, 4), (7, 4)}
        assert {r.doc_id for r in out} <= {1, 2, 6, 7}
    if name == "token_counts":
        assert [r.n_tokens for r in out if r.doc_id == 3] == [None]
        assert [r.n_tokens for r in out if r.doc_id == 4] == [0]
    if name == "sentencepiece":
        assert [(r.n_pieces, r.ids, r.round_trip) for r in out if r.doc_id == 3] == [(None, None, None)] and [(r.n_pieces, r.ids) for r in out if r.doc_id == 4] == [(0, [])]
        assert all(r.round_trip for r in out if r.ids is not None)
    if name == "hmm":
        assert all((r.n_words, r.log_likelihood, r.perplexity) == (0, 0.0, None) for r in out if r.doc_id in (3, 4, 5)) and [r.n_words for r in out if r.doc_id in (6, 8)] in ([12000, 1], [1, 12000])
    if name == "fingerprints":
        assert all((r.n_grams, r.fingerprint) == (0, None) for r in out if r.doc_id in (3, 4, 5)) and len({str(r.fingerprint) for r in out if r.doc_id in (1, 2)}) == 1
    if name == "sharding":
        assert {r.doc_id: r.text for r in out if r.doc_id in (3, 4)} == {3: None, 4: ""} and len({r.shard for r in out if r.doc_id == 1}) == 1
    if name == "quality":
        assert all(not r.accepted and r.score == 0 for r in out if r.doc_id in (3, 4, 5))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, table(spark, []).limit(0)).count() == 0


PAGES = [
    (1, "http://www.Example.org:80/a?b=1#x", "<html><body><p>one</p></body></html>"), (1, "http://www.Example.org:80/a?b=1#x", "<html><body><p>one</p></body></html>"), (2, "https://example.org/a?b=1", "<p>un<b>closed <p>two"),
    (3, None, "<div>no url</div>"), (4, "not a url", None), (None, "http://h.net", ""), (5, "http://h.net/" + "p" * 5000, "<div>" * 5000 + "deep"), (6, "", "text only & more &amp; <"),
]


def pages(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "k", "s", 1) for r in rows], "page_id long, url string, html string, key string, shard string, block int")


def test_pages(spark):
    found = capture_index.captures(pages(spark), block_lines=2).collect()
    assert sum(r.urlkey == "org,example)/a?b=1" for r in found) == 9
    assert {r.capture_id for r in found if r.page_id == 4} == {4}
    assert not [r for r in found if r.page_id == 3]
    out = style_tree.extract_pages(pages(spark)).collect()
    assert len(out) == len(PAGES)
    assert [r.text for r in out if r.page_id == 4] == [None]
    assert [r.text for r in out if r.page_id == 6] == ["text only & more & <"]


def test_pages_empty(spark):
    assert capture_index.captures(pages(spark).limit(0)).count() == 0
    assert style_tree.extract_pages(pages(spark).limit(0)).count() == 0
