"""Chunks, template merging and MMR."""

from __future__ import annotations

from sparkpress.operators import kernels


def test_chunks_cover_and_survive_an_insertion():
    text = "".join(f"line {i * 7919 % 1000} of some length here\n" for i in range(2000))
    found = kernels.chunks_of(text)
    assert found[0][0] == 0 and found[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(found, found[1:]))
    assert all(b - a <= 8192 + 40 for a, b in found)
    changed = text[:3000] + "a new line\n" + text[3000:]
    before, after = ({t[a:b] for a, b in kernels.chunks_of(t)} for t in (text, changed))
    assert len(before & after) >= len(before) - 3
    assert kernels.chunks_of("") == [] and kernels.chunks_of("x") == [(0, 1)]


def test_templates_merge(spark):
    rows = [("open file alpha failed with code <num> now", "ERROR", 9), ("open file beta failed with code <num> now", "ERROR", 2), ("close socket", "INFO", 1), ("open file beta failed with code <num> now", "INFO", 1)]
    out = {(r.mask, r.level): r.merged for r in kernels.merge_templates(spark.createDataFrame(rows, "mask string, level string, lines long")).collect()}
    assert out[rows[1][0], "ERROR"] == rows[0][0] and out[rows[3][0], "INFO"] == rows[3][0] and len(out) == 4


def test_mmr_avoids_repeats(spark):
    rows = [(1, 1, "solar panels power the distant station", 8), (1, 2, "solar panels power the distant station", 8), (1, 3, "engineers repaired broken antenna hardware", 8)]
    out = [r.n for r in kernels.mmr(spark.createDataFrame(rows, "doc_id long, n long, text string, tokens long"), 16).collect()]
    assert sorted(out) == [1, 3]


def test_openings_hide_no_critical_phrase():
    import itertools

    from sparkpress.plans import kernel

    texts = "You mustn't|must NOT|can not go|cannot|don't|do not|never|Under no circumstances|have  to|has to|required|may not|encrypting it|api-key|a private key|API key|password|passphrases|credentials|isn't|without|two-factor|gdpr|lacks|other than|it's nothing|access tokens|hash passwords|confidentiality|no|nor so|notwithstanding it|obliged to|entitled to|saml|personal data|x must".split("|")
    texts += [" ".join(p) for p in itertools.permutations(["do", "not", "go"])] + ["doñ not", "émust", "plain words", "not-a", "NO_T"]
    for t in texts:
        words = kernel._WORD.findall(t.lower())
        assert not any(p.search(t) for p in kernel._CRITICAL) or any(map(kernel._OPENS.__getitem__, words)), t
    assert not any(map(kernel._OPENS.__getitem__, "noted constant company area forest".split()))
