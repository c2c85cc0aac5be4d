"""The operators against brute force, exact round trips, reference libraries and held-out accuracy."""

from __future__ import annotations

import collections
import itertools
import math
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkpress.llm import capture_index, decontaminate, fingerprints, graph, hmm, jaccard_join, quality, sentencepiece, sharding, style_tree, token_counts
from sparkpress.llm import textkernel as K


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def gram_sets(texts, n=3):
    column = pa.array([t.lower() for t in texts])
    out = []
    for a, b, data, offsets in K.blocks(column):
        hashed, doc, _, _ = K.words(data, offsets)
        gram, off = K.grams(hashed, doc, b - a, n)
        out += [frozenset(gram[off[i] : off[i + 1]].tolist()) for i in range(b - a)]
    return out


def test_words_are_runs_of_letters():
    texts = ["one, two_3 ünï", "", "--", "a" * 5000]
    hashed, doc, start, length = K.words(*K.string_buffers(pa.array(texts)))
    spelled = [texts[d].encode()[s - sum(len(t.encode()) for t in texts[:d]) :][:n] for d, s, n in zip(doc, start, length)]
    assert spelled == [b"one", b"two_3", "ünï".encode(), b"a" * 5000]
    assert len(set(hashed.tolist())) == 4


def test_bytes_1024_apart_are_not_swapped_unseen(spark):
    a, b = "a" + "e" * 1023 + "i", "i" + "e" * 1023 + "a"
    docs = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert jaccard_join.jaccard_pairs(docs).count() == 0
    assert len({str(r.fingerprint) for r in fingerprints.fingerprints(docs).collect()}) == 2
    assert decontaminate.contamination(docs, spark.createDataFrame([(7, a)], "item_id long, text string")).select("doc_id").collect() == [(1,)]
    out = sentencepiece.encode(docs)
    assert all(r.round_trip for r in out.collect())
    assert {r.doc_id: r.text for r in sentencepiece.decode(out).collect()} == {1: a, 2: b}


def test_rtree_bound_loses_no_pair(spark):
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 1 << 54, n, dtype=np.uint64) for n in rng.integers(4, 2500, 60)]
    sets = []
    for b in base:
        sets.append(np.unique(b))
        for _ in range(2):
            copy = b.copy()
            change = rng.random(len(copy)) < 0.15
            copy[change] = rng.integers(0, 1 << 54, change.sum(), dtype=np.uint64)
            sets.append(np.unique(copy))
    size = np.array([len(s) for s in sets])
    key, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    points = jaccard_join.Points(size, jaccard_join._coordinates(key, owner, size))
    a, b = jaccard_join.rtree_pairs(points, np.arange(len(sets)), 0.6, leaf=4)
    found = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    true = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.6}
    assert true and true <= found
    assert len(found) < len(sets) ** 2 / 4


def test_wide_leads_are_dealt_out_and_lose_no_pair(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base)] * 3
    for _ in range(90):  # near copies, some more than half apart
        words = list(base)
        for i in rng.integers(0, 60, rng.integers(1, 9)):
            words[i] = f"x{rng.integers(40)}"
        texts.append(" ".join(words))
    texts += [" ".join(base[:n]) for n in range(20, 60, 3)] + ["some other text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = gram_sets(texts)
    near = np.array([[len(a & b) / len(a | b) >= 0.5 for b in sets] for a in sets])
    monkeypatch.setattr(jaccard_join, "WIDE", 20)
    monkeypatch.setattr(jaccard_join, "BLOCK", 10)
    most = []
    plain = jaccard_join._blocks
    monkeypatch.setattr(jaccard_join, "_blocks", lambda *given: most.append(plain(*given).groupBy("unit").count().agg({"count": "max"}).first()[0]) or plain(*given))
    found = {r.doc_id: (r.class_id, r.links) for r in jaccard_join.classes(docs).collect()}
    reach = np.linalg.matrix_power(near.astype(float), 8) > 0
    assert found == {i: (int(np.flatnonzero(reach[i])[0]), int(near[i].sum()) - 1) for i in range(len(texts))}
    assert most and most[0] < 45  # of 107 points, in tasks of two blocks of about ten


def test_slabs_that_repeat_each_other_are_paired_once():
    lead = np.array([7] * 90 + [9] * 4)
    slab = np.concatenate([np.repeat(np.arange(30), 3), [100, 100, 101, 101]])
    node = np.concatenate([np.tile([0, 1, 2], 30), [3, 4, 3, 5]])
    node, of, at, length = jaccard_join._runs(lead, slab, node)
    assert [(int(of[i]), node[i : i + k].tolist()) for i, k in zip(at, length)] == [(7, [0, 1, 2]), (9, [3, 4]), (9, [3, 5])]


def test_jaccard_join_is_brute_force(spark, sf):
    docs = read(spark, sf, "documents")
    rows = docs.collect()
    sets = gram_sets([r.text for r in rows])
    reps: dict[frozenset, int] = {}
    for r, s in sorted(zip(rows, sets), key=lambda x: x[0].doc_id):
        reps.setdefault(s, r.doc_id)
    want = {(reps[s], r.doc_id) for r, s in zip(rows, sets) if s and reps[s] != r.doc_id}
    points = [(i, s) for s, i in reps.items() if s]
    want |= {(min(a, b), max(a, b)) for (a, s), (b, t) in itertools.combinations(points, 2) if len(s & t) >= jaccard_join.THRESHOLD * len(s | t) - 1e-9}
    assert {(r.doc_a, r.doc_b) for r in jaccard_join.jaccard_pairs(docs).collect()} == want


def test_expanded_join_lists_every_pair(spark, sf):
    docs = read(spark, sf, "documents")
    rows = docs.collect()
    sets = [(r.doc_id, s) for r, s in zip(rows, gram_sets([r.text for r in rows])) if s]
    want = {(min(a, b), max(a, b)) for (a, s), (b, t) in itertools.combinations(sets, 2) if len(s & t) >= jaccard_join.THRESHOLD * len(s | t) - 1e-9}
    found = [(r.doc_a, r.doc_b) for r in jaccard_join.jaccard_pairs(docs, expand=True).collect()]
    assert set(found) == want and len(found) == len(want)


def test_links_of_texts_under_repeated_and_null_ids_are_kept(spark):
    """Texts a, b and c of three points: a and b under one least id, whose link (2, 3) the pairs between least ids lost."""
    import duckdb

    a, b = " ".join(f"w{i}" for i in range(20)), " ".join(f"w{i}" for i in range(18)) + " x y"
    rows = [(1, a), (1, b), (2, a.upper()), (3, b + "!"), (None, a), (4, "alone here now"), (None, None), (5, "--"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = collections.Counter(map(tuple, jaccard_join.classes(docs).collect()))
    assert found == collections.Counter([(1, 1, 4), (1, 1, 4), (2, 1, 4), (3, 1, 4), (None, 1, 4), (4, 4, 0), (None, None, 0), (5, 5, 0), (6, 6, 0)])
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert collections.Counter(con.sql(jaccard_join.oracle_sql()).fetchall()) == found
    assert (2, 3) in {(r.doc_a, r.doc_b) for r in jaccard_join.jaccard_pairs(docs, expand=True).collect()}


def test_classes_are_their_sql(spark, sf):
    import duckdb

    docs = read(spark, sf, "documents")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    assert sorted(map(tuple, jaccard_join.classes(docs).collect())) == sorted(con.sql(jaccard_join.oracle_sql()).fetchall())


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (6, 5), (5, 9), (20, 21)], "a long, b long")
    found = {r.node: r.component for r in graph.components(edges).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 20: 20, 21: 20}


def test_token_counts_are_those_of_whole_texts(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "b" * 9000), (-2, " " * 5000 + "x"), (-3, "é ü" * 4000), (-4, "a\n\n\nb " * 2000)], "doc_id long, text string"))
    encoding, _ = token_counts.encoder(token_counts.VOCABULARY)
    want = {r.doc_id: len(encoding.encode_ordinary(r.text)) for r in docs.collect()}
    out = token_counts.token_counts(docs, chunk_chars=700, overlap=16).collect()
    assert {r.doc_id: r.n_tokens for r in out} == want
    assert any(r.n_chunks > 3 for r in out)


def test_sentencepiece_is_the_library(spark, sf):
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(sentencepiece.MODEL, "rb") as file:
        proto.ParseFromString(file.read())
    proto.trainer_spec.model_type = 1  # the same pieces and scores, searched as a unigram model
    for piece in proto.pieces:
        if piece.type == 1 and piece.score <= sentencepiece.NEVER:
            piece.type = 5
    library = SentencePieceProcessor()
    library.LoadFromSerializedProto(proto.SerializeToString())
    docs = read(spark, sf, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "c d  e\n\n f 漢字😀xyz "), (-2, " "), (-3, "ab" * 400), (-4, "x" * 3000 + "日本語" * 900), (-5, "=-" * 700 + "\x01ÿ")], "doc_id long, text string"))
    out = sentencepiece.encode(docs)
    text = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id: r.ids for r in out.collect()} == {i: library.encode(t) for i, t in text.items()}
    assert {r.doc_id: r.text for r in sentencepiece.decode(out).collect()} == text


def test_sentencepiece_leaves_out_only_unused_pieces(spark, sf):
    given = sentencepiece.pieces(sentencepiece.MODEL)
    left_out = {p: i for p, (i, _) in given.table.items() if p not in given.used}
    assert left_out and all(given.fold(p) != [i] for p, i in left_out.items())
    used = {i for i, _ in given.used.values()} | set(given.bytes.tolist())
    assert all(used.issuperset(given.fold(" " + r.text)) for r in read(spark, sf, "documents").where("text <> ''").orderBy(F.length("text"), "doc_id").limit(60).collect())


def test_sentencepiece_workers_load_no_model():
    """Python workers share the executor's memory: the kernels' module brings neither the model's library nor pandas."""
    code = "import sys; from sparkpress.llm import sentencepiece; assert not {'pandas', 'sentencepiece'} & set(sys.modules)"
    assert subprocess.run([sys.executable, "-c", code]).returncode == 0


def test_hmm_is_the_sum_over_paths():
    rng = np.random.default_rng(0)
    states, words = 3, 5
    model = hmm.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(words), states).T)
    docs = [rng.integers(0, words, n) for n in (4, 1, 5, 0, 3)]
    packed, active, order = hmm._packed(np.concatenate(docs), np.array([len(d) for d in docs]))
    start, move, emit, total = hmm.expected(model, packed, active)
    want_start, want_move, want_emit, want = np.zeros(states), np.zeros((states, states)), np.zeros((words, states)), 0.0
    for d in filter(len, docs):
        paths = []
        for path in itertools.product(range(states), repeat=len(d)):
            p = model.start[path[0]] * model.emit[d[0], path[0]]
            for t in range(1, len(d)):
                p *= model.move[path[t - 1], path[t]] * model.emit[d[t], path[t]]
            paths.append((path, p))
        likelihood = sum(p for _, p in paths)
        want += math.log(likelihood)
        for path, p in paths:
            want_start[path[0]] += p / likelihood
            for t, s in enumerate(path):
                want_emit[d[t], s] += p / likelihood
                if t:
                    want_move[path[t - 1], s] += p / likelihood
    assert np.allclose(start, want_start) and np.allclose(move, want_move) and np.allclose(emit, want_emit) and math.isclose(total, want)


def test_baum_welch_raises_the_likelihood(spark, sf):
    texts = read(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    _, history = hmm.train(texts, states=3, iterations=4)
    assert all(b > a for a, b in zip(history, history[1:]))


def test_baum_welch_runs_until_it_converges(spark, sf):
    texts = read(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    _, history = hmm.train(texts)
    gains = [(b - a) / abs(a) for a, b in zip(history, history[1:])]
    assert len(history) > 3 and gains[-1] < hmm.TOLERANCE and max(gains) > 10 * hmm.TOLERANCE


def test_hmm_is_plain_baum_welch(spark):
    """Rounds and scores against the same model in dense arrays, a text at a time; several tasks and blocks."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)] + ["ü" * 600]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 30)))) for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    states, rounds = 3, 4
    hashed = {w: K.words(*K.string_buffers(pa.array([w])))[0][0] for w in words}
    names = np.array(sorted({hashed[w] for _, t in rows for w in (t or "").split()}), np.uint64)
    texts = {i: np.searchsorted(names, np.array([hashed[w] for w in (t or "").split()], np.uint64)) for i, t in rows}
    emit = np.bincount(np.concatenate(list(texts.values())).astype(int), minlength=len(names))[:, None] * hmm.Model.noise(names, states) + hmm.FLOOR
    start, move = hmm.Model.first(states)
    log = {}
    for k in range(rounds + 1):
        model = hmm.Model(start, move, emit / emit.sum(0))
        sums = [np.full(states, hmm.FLOOR), np.full((states, states), hmm.FLOOR), np.full((len(names), states), hmm.FLOOR)]
        for i, x in texts.items():
            alpha = np.zeros((len(x), states))
            scale = np.ones(len(x))
            for t, w in enumerate(x):
                alpha[t] = (start if t == 0 else alpha[t - 1] @ move) * model.emit[w]
                scale[t] = alpha[t].sum()
                alpha[t] /= scale[t]
            log[i] = np.log(scale).sum()
            beta = np.ones(states)
            for t in range(len(x) - 1, -1, -1):
                gamma = alpha[t] * beta
                sums[2][x[t]] += gamma
                if t == 0:
                    sums[0] += gamma
                else:
                    behind = model.emit[x[t]] * beta / scale[t]
                    sums[1] += move * np.outer(alpha[t - 1], behind)
                    beta = move @ behind
        if k < rounds:
            start, move, emit = sums[0] / sums[0].sum(), sums[1] / sums[1].sum(1, keepdims=True), sums[2]
    got = {r.doc_id: r for r in hmm.score(docs, states=states, iterations=rounds).collect()}
    assert got.keys() == log.keys() and all(math.isclose(got[i].log_likelihood, log[i], rel_tol=1e-3, abs_tol=1e-6) for i in log)
    assert all(got[i].n_words == len(x) and (math.isclose(got[i].perplexity, math.exp(-log[i] / len(x)), rel_tol=1e-3) if len(x) else got[i].perplexity is None) for i, x in texts.items())


def test_fingerprints_are_brute_force(spark, sf):
    """Bins and densification of each text's grams, one at a time."""
    rows = read(spark, sf, "documents").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in fingerprints.fingerprints(read(spark, sf, "documents")).collect()}
    bins, low = 128, (1 << (K.GRAM_BITS - 7)) - 1
    donors = fingerprints._donors(bins, 5000).tolist()
    for r, grams in zip(rows, gram_sets([r.text for r in rows])):
        least = {}
        for g in grams:
            least[g >> (K.GRAM_BITS - 7)] = min(g & low, least.get(g >> (K.GRAM_BITS - 7), low))
        if not grams:
            assert got[r.doc_id].n_grams == 0 and got[r.doc_id].fingerprint is None
            continue
        value = [least[b] if b in least else next(least[d[b]] for d in donors if d[b] in least) for b in range(bins)]
        packed = [sum((value[16 * k + j] & 15) << (4 * j) for j in range(16)) for k in range(8)]
        assert got[r.doc_id].n_grams == len(grams) and [x % 2**64 for x in got[r.doc_id].fingerprint] == packed


def test_fingerprints_estimate_jaccard(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(4000)]
    rows, want = [], {}
    for k in range(40):
        base = list(rng.choice(words, 300))
        copy = [w if rng.random() > 0.002 * k else "new" + w for w in base]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        s, t = gram_sets([" ".join(base), " ".join(copy)])
        want[k] = len(s & t) / len(s | t)
    f = fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"))
    a, b = f.where("doc_id % 2 = 0").select((F.col("doc_id") / 2).cast("int").alias("k"), F.col("fingerprint").alias("x")), f.where("doc_id % 2 = 1").select(((F.col("doc_id") - 1) / 2).cast("int").alias("k"), F.col("fingerprint").alias("y"))
    got = {r.k: r.e for r in a.join(b, "k").select("k", fingerprints.estimate(F.col("x"), F.col("y")).alias("e")).collect()}
    error = np.array([got[k] - want[k] for k in want])
    assert abs(error.mean()) < 0.03 and np.abs(error).max() < 0.2


def brute_importance(pages):
    """Style trees built page by page and folded recursively, from (host, html)."""
    styles, parents = collections.defaultdict(collections.Counter), {}
    leaves = {}
    for host, html in pages:
        for key, style, above, _, leaf in style_tree.mark(style_tree.parse(html, {}), style_tree.xxhash.xxh64_intdigest(host)):
            styles[key][style] += 1
            parents.setdefault(above, set()).add(key)
            leaves[key] = leaf

    def composite(key):
        counts = styles[key]
        m, n = sum(counts.values()), len(counts)
        if leaves[key]:
            return 1.0 if m == 1 else 1 - sum(math.log(c) for c in counts.values()) / n / math.log(m)
        own = 1.0 if m == 1 else -sum(c / m * math.log(c / m) for c in counts.values()) / math.log(m)
        inside = sum(c / m * (np.mean([composite(k) for k in parents[s]]) if s in parents else 0.0) for s, c in counts.items())
        return (1 - style_tree.GAMMA**n) * own + style_tree.GAMMA**n * inside

    return {key: composite(key) for key in styles}


def test_style_tree_importance(spark, sf):
    template = "<body><nav><ul><li>Home</li><li>About</li></ul></nav><div class=main><h1>T{0}</h1><p>text {0} here</p>{1}</div><footer>same for all</footer></body>"
    pages = [("h.org", template.format(i, "<p>more</p>" * (i % 3))) for i in range(9)] + [("x.net", "<p>single page</p>")]
    df = spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(pages)], "page_id long, url string, html string")
    occurrences = df.select(F.regexp_extract("url", "//([^/]*)", 1).alias("host"), "html", F.lit(0).cast("long").alias("digest")).mapInArrow(style_tree._occurrences(False), "key long, style long, above long, depth int, leaf boolean")
    got = {r.key & style_tree._MASK: r.composite for r in style_tree.importance(occurrences).collect()}
    want = brute_importance(pages)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    for limit in (10**6, 0):  # broadcast, and joined
        out = {r.page_id: r.text for r in style_tree.extract_pages(df, broadcast_keys=limit).collect()}
        assert "same for all" not in out[3] and "Home" not in out[3] and "text 3 here" in out[3] and out[9] == "single page"


def test_boilerplate_nested_deep_goes(spark):
    deep = "<div class=a>" * 40
    page = "<html><head><title>t</title><body>{0}<ul><li>Home</li><li>About</li></ul>" + "</div>" * 40 + "<main>{1}</main>"
    rows = [(i, f"http://h.org/{i}", page.format(deep, f"<p>article {i} here</p>" * (1 + i % 3))) for i in range(12)]
    out = {r.page_id: r for r in style_tree.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i].text == "\n".join([f"article {i} here"] * (1 + i % 3)) and out[i].dropped == 45 for i in range(12))


def test_page_texts_are_an_independent_parsers(spark, sf):
    """Nothing dropped: the words of each page's body, by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.words, self.off = [], 0

        def handle_starttag(self, tag, attrs):
            self.off += tag in ("head", "script", "style", "noscript", "template")

        def handle_endtag(self, tag):
            self.off -= tag in ("head", "script", "style", "noscript", "template")

        def handle_data(self, data):
            if not self.off:
                self.words.append(data)

    pages = read(spark, sf, "pages")
    out = {r.page_id: r for r in style_tree.extract_pages(pages, threshold=-1.0).collect()}
    for r in pages.collect():
        reader = Reader()
        reader.feed(r.html)
        reader.close()
        assert "".join(out[r.page_id].text.split()) == "".join("".join(reader.words).split()) and out[r.page_id].dropped == 0


@pytest.mark.parametrize("html, text", [
    ("<html><head><title>t</title><body><h1>Title</h1><p>hello world</p>", "Title\nhello world"), ("<head-line>a</head-line><p>b", "a\nb"), ("<template-card>x</template-card>z", "x\nz"),
    ("<head><script>var a = '</head>'</script></head><body>ok<noscript>no</noscript> yes", "ok yes"), ("<script>never ends <p>x", ""), ("<p>one<p>two", "one\ntwo"), ("<div>" * 5000 + "deep", "deep"),
])
def test_broken_markup(html, text):
    root = style_tree.parse(html, {})
    style_tree.mark(root, 1)
    assert style_tree.extract(root, frozenset())[0] == text


def test_near_items_without_their_rarest_terms(spark):
    """A text that lacks an item's rarest terms, but holds enough of the others, is near."""
    item = " ".join(f"t{i}" for i in range(20))
    text = " ".join("gone" if i < 4 else f"t{i}" for i in range(20))
    docs = spark.createDataFrame([(1, text)] + [(2 + i, " ".join(f"t{j}" for j in range(4, 20, 3))) for i in range(5)] + [(20, "t0 t1 t2 t3")], "doc_id long, text string")
    found = decontaminate.contamination(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.near_terms) for r in found] == [(1, 16)] and found[0].phrases == 1 + 16 - 13
    kept = decontaminate.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5, 6, 20]


def test_segments_and_slices_give_one_result(spark, sf):
    docs, items = read(spark, sf, "documents"), read(spark, sf, "benchmark")
    whole = sorted(decontaminate.contamination(docs, items).collect())
    assert sorted(decontaminate.contamination(docs, items, slice_words=300).collect()) == whole


def test_machine_is_the_pairwise_sum():
    rng = np.random.default_rng(1)
    machine = quality.Machine(np.zeros(len(quality.STATS)), np.ones(len(quality.STATS)))
    machine.w[:] = rng.normal(size=quality.WIDTH)
    machine.v[:] = rng.normal(size=machine.v.shape)
    number, value = rng.choice(quality.CELLS, 12, replace=False), rng.normal(size=12)
    pairs = sum(machine.v[number[i]] @ machine.v[number[j]] * value[i] * value[j] for i, j in itertools.combinations(range(12), 2))
    assert math.isclose(machine.margins(np.array([0, 12]), number, value)[0], machine.w[number] @ value + pairs)


def test_training_rows_are_joined_without_a_copy_each():
    parts = pa.chunked_array([pa.array([np.arange(3, dtype=np.int32).tobytes(), b""]), pa.array([np.arange(5, dtype=np.int32).tobytes()])])
    flat, per = quality._flat(parts.filter(pa.array([True, False, True])), np.int32)
    assert flat.tolist() == [0, 1, 2, 0, 1, 2, 3, 4] and per.tolist() == [3, 5]


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    held = F.xxhash64("doc_id") % 3 == 0
    scored = quality.score(docs, labels.where(~held)).join(labels.where(held), "doc_id").collect()
    assert np.mean([r.accepted == (r.quality == 1) for r in scored]) > 0.95
    assert np.mean([r.accepted for r in scored if r.quality == 1]) > 0.98


def test_toxic_texts_are_rejected_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    held = F.xxhash64("doc_id") % 3 == 0
    scored = quality.score(docs, labels.where(~held), reject_toxic=True).join(labels.where(held), "doc_id").collect()
    kept = {r.doc_id for r in quality.accepted(docs, labels.where(~held)).select("doc_id").collect()}
    for accepted in ([r.accepted for r in scored], [r.doc_id in kept for r in scored]):
        assert np.mean([a for a, r in zip(accepted, scored) if r.toxic == 1]) < 0.1
        assert np.mean([a for a, r in zip(accepted, scored) if r.quality == 1 and r.toxic == 0]) > 0.97


def test_curve_visits_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    index = sharding.curve_index(cells, 3)
    assert sorted(index.tolist()) == list(range(512))
    path = cells[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("lines", [1, 7, 1000])
def test_capture_index_finds_all(spark, lines):
    rows = [(i, f"http://h{i % 5}.org/p{i % 11}", f"<p>{i}</p>") for i in range(120)]
    found = capture_index.captures(spark.createDataFrame(rows, "page_id long, url string, html string"), lines).collect()
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1]}
    assert {(r.page_id, r.capture_id) for r in found} == want and len(found) == len(want)


def test_oracles(spark, sf):
    import duckdb

    from sparkpress.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    for name, sql in ORACLES.items():
        got = QUERIES[name](spark, sf).toArrow()
        want = con.sql(sql).to_arrow_table().select(got.column_names)
        assert sorted(map(repr, got.to_pylist())) == sorted(map(repr, want.to_pylist())), name
