"""Scalar text functions: Column in, Column out, all inside generated code or higher-order functions."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon

#: Pre-token pieces: contraction, letters, digits, punctuation, white space.
PIECES = r"'(ll|ve|re|[sdmt])| ?[A-Za-z\x{80}-\x{10FFFF}]+| ?[0-9]+| ?[^\sA-Za-z0-9_\x{80}-\x{10FFFF}]+|_+|\s+"


def java(pattern: str) -> str:
    """The pattern for Java, whose own ``\\b`` takes letters beyond ASCII for parts of words (and so sees no end of "do" in "doñez"); here, as in RE2, words are ASCII."""
    return pattern.replace(r"\b", r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))")


def has(text: Column, pattern: str) -> Column:
    """Whether the pattern matches anywhere."""
    return text.rlike(java(pattern))


def replaced(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, java(pattern), by)


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern, in order."""
    return F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(0))


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(java(pattern))).cast("long")


def piece_cost(piece: Column) -> Column:
    """Estimated subword tokens of one pre-token piece."""
    core = F.trim(F.regexp_replace(piece, r"[\n\t\r]", " "))
    n = F.length(core)
    newlines = F.length(piece) - F.length(F.regexp_replace(piece, "\n", ""))
    word = F.when(n <= 4, 1).otherwise(F.greatest(F.lit(1), F.floor(n / 7.8 + 0.95)) + F.when((F.lower(core) != core) & (n > 12), 1).otherwise(0))
    return (
        F.when(n == 0, newlines + F.when(F.length(piece) - newlines > 1, 1).otherwise(0))
        .when(core.rlike("^[0-9]+$"), F.floor((n + 2) / 3))
        .when(core.rlike(r"[A-Za-z\x{80}-\x{10FFFF}]"), word)
        .otherwise(F.ceil(n / 3.2))
        .cast("long")
    )


_CLASS = np.full(256, 3, np.int8)  # 0 white space, 1 letter, 2 digit, 3 punctuation, 4 underscore
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_CLASS[95] = 4


def _costs(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Estimated tokens of texts that stand one after another: runs of one class of bytes, priced as ``piece_cost`` prices pieces."""
    if not len(data):
        return np.zeros(len(offsets) - 1, np.int64)
    kind = _CLASS[data]
    edge = np.empty(len(data), bool)
    edge[0] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:])
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(edge)
    stop = np.append(start[1:], len(data))
    kind = kind[start]
    doc = np.searchsorted(offsets, start, "right") - 1
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    n = chars[stop] - chars[start]
    # an apostrophe that begins a piece takes s, d, m, t, ll, ve or re after it
    quote = np.flatnonzero((kind[:-1] == 3) & (kind[1:] == 1) & (n[:-1] == 1) & (data[start[:-1]] == 39) & (doc[:-1] == doc[1:]))
    lone = (quote > 0) & (kind[quote - 1] == 0) & (n[quote - 1] == 1) & (data[start[quote - 1]] == 32) & (doc[quote - 1] == doc[quote])
    quote = quote[~lone]
    at = start[quote + 1]
    one = np.isin(data[at], np.frombuffer(b"sdmt", np.uint8))
    pair = data[at].astype(np.int64) << 8 | data[np.minimum(at + 1, len(data) - 1)]
    two = (n[quote + 1] > 1) & np.isin(pair, [x[0] << 8 | x[1] for x in (b"ll", b"ve", b"re")])
    take = np.where(two, 2, np.where(one, 1, 0))
    n[quote + 1] -= take
    short = start.copy()
    short[quote + 1] += take
    cost = np.where(kind == 2, (n + 2) // 3, np.ceil(n / 3.2)).astype(np.int64)
    word = np.where(n <= 4, np.minimum(n, 1), np.maximum(1, np.floor(n / 7.8 + 0.95))).astype(np.int64)
    long = np.flatnonzero((kind == 1) & (n > 12))
    upper = np.concatenate([[0], np.cumsum((data > 64) & (data < 91))])
    word[long] += upper[stop[long]] > upper[short[long]]
    wide = np.concatenate([[0], np.cumsum(data > 127)])
    for i in long[(upper[stop[long]] == upper[short[long]]) & (wide[stop[long]] > wide[short[long]])]:
        piece = data[short[i] : stop[i]].tobytes().decode()
        word[i] += piece.lower() != piece
    cost = np.where(kind == 1, word, cost)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    newlines = lines[stop] - lines[start]
    cost = np.where(kind == 0, newlines + (n - newlines > 1), cost)
    rare = np.concatenate([[0], np.cumsum((data == 11) | (data == 12))])
    for i in np.flatnonzero((kind == 0) & (rare[stop] > rare[start])):  # vertical tabs and form feeds stay inside a piece when it is trimmed
        cost[i] = -(-len(data[start[i] : stop[i]].tobytes().decode().translate({9: 32, 10: 32, 13: 32}).strip(" ")) * 10 // 32)
    cost[quote] = np.where(take > 0, 1, cost[quote])
    return np.bincount(doc, cost, len(offsets) - 1).astype(np.int64)


def _token_counts(column: pa.Array) -> pa.Array:
    filled = column.fill_null("").cast(pa.large_string())
    _, offs, raw = filled.buffers()
    offsets = np.frombuffer(offs, np.int64)[filled.offset : filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    out, first = [np.zeros(0, np.int64)], 0
    while first < len(filled):  # bounded runs of texts
        last = min(max(int(np.searchsorted(offsets, offsets[first] + 1_000_000, "right")) - 1, first + 1), len(filled))
        out.append(_costs(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]))
        first = last
    return pa.array(np.concatenate(out), mask=np.array(column.is_null()))


@functools.cache
def _token_counter():
    return F.arrow_udf(_token_counts, "long")


def token_count(text: Column) -> Column:
    """Vocabulary-free estimate of the number of subword tokens; 0 for an empty text, null for null. A kernel on Arrow batches of bytes: the same sum over regex pieces costs ten times as much."""
    return _token_counter()(text)


#: Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = "Dr|Mr|Mrs|Ms|Prof|St|Sr|Jr|vs|etc|cf|al|No|Fig|Eq|Vol|pp|Inc|Ltd|Co|Corp|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec|[eE][.]g|[iI][.]e|[A-Z]"
_SHORT = rf"\b({ABBREVIATIONS})[.] "
_BREAK = r"([.!?]+[\"')\]]*)(\s+)([^a-z\s])"


def sentence_array(text: Column) -> Column:
    """Sentences with the white space before them: cut after . ! ? (and closing quotes) and white space, not after an abbreviation or an initial, not before a lower-case letter. Their lengths add up to the text's."""
    held = replaced(text, _SHORT, "$1.\u0002")
    return F.transform(F.split(F.regexp_replace(held, _BREAK, "$1\u0001$2$3"), "\u0001"), lambda s: F.translate(s, "\u0002", " "))


def sentence_sql(text: str = "text") -> str:
    """The same as DuckDB SQL."""
    quoted = lambda p: p.replace("'", "''")
    return f"[translate(x, chr(2), ' ') FOR x IN string_split(regexp_replace(regexp_replace({text}, '{quoted(_SHORT)}', '\\1.' || chr(2), 'g'), '{quoted(_BREAK)}', '\\1' || chr(1) || '\\2\\3', 'g'), chr(1))]"


def words(text: Column) -> Column:
    return matches(F.lower(text), "[a-z0-9_]+")


def content_terms(text: Column, keep_numbers: bool = False) -> Column:
    """Lower-case terms of two characters or more that are no stopwords."""
    stop = F.array(*[F.lit(w) for w in lexicon.STOPWORDS])
    kept = F.filter(words(text), lambda w: (F.length(w) >= 2) & ~F.array_contains(stop, w))
    return kept if keep_numbers else F.filter(kept, lambda w: ~w.rlike("^[0-9]"))


def bigrams(terms: Column) -> Column:
    return F.when(F.size(terms) < 2, F.array().cast("array<string>")).otherwise(F.zip_with(F.slice(terms, F.lit(1), F.size(terms) - 1), F.slice(terms, F.lit(2), F.size(terms) - 1), lambda a, b: F.concat_ws("_", a, b)))


def hash_form(text: Column) -> Column:
    """Lower case, numbers as #, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[0-9]+([.][0-9]+)?", "#"), r"\s+", " "))


def shingles(text: Column, k: int = 4) -> Column:
    """Runs of k words of the hash form; a shorter text is one run."""

    def runs(w: Column) -> Column:
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < k, F.array(F.array_join(w, " "))).otherwise(F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(k)), " ")))

    # an array of one element names the words, which would be matched again for each shingle otherwise
    return F.element_at(F.transform(F.array(matches(hash_form(text), "[a-z0-9_]+")), runs), 1)


def canonical(text: Column) -> Column:
    """Lower case without commas, single spaces, no punctuation at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), ",", ""), r"\s+", " "), r"^[ .,;:]+|[ .,;:]+$", "")


def heading_level(line: Column) -> Column:
    """1 to 6 for markdown and numbered headings, 2 for capitals, 3 for a title that ends in a colon, else 0."""
    s = F.trim(line)
    marks = F.length(F.regexp_extract(s, r"^(#{1,6})[ \t]+[^ \t]", 1))
    dots = F.regexp_extract(s, r"^([0-9]+([.][0-9]+)*)[).]?[ \t]+[A-Z]", 1)
    return (
        F.when(F.length(s) == 0, 0)
        .when(marks > 0, marks)
        .when((F.length(dots) > 0) & (F.length(s) < 120), F.least(F.lit(6), F.length(dots) - F.length(F.regexp_replace(dots, "[.]", "")) + 1))
        .when((F.length(s) < 90) & (F.upper(s) == s) & (F.lower(s) != s) & ~s.rlike("[.!?]$"), 2)
        .when((F.length(s) < 90) & s.rlike("^[A-Z][A-Za-z0-9_ /&,'-]+:$"), 3)
        .otherwise(0)
        .cast("long")
    )


def list_item(line: Column) -> Column:
    return line.rlike(r"^\s*([-*+•]|[0-9]{1,3}[.)]|[a-z][.)])\s+\S")


def hedge_ratio(text: Column) -> Column:
    """Three times the share of characters in hedging phrases, at most 1."""
    covered = F.aggregate(matches(text, lexicon.HEDGE), F.lit(0), lambda n, m: n + F.length(m))
    return F.when(F.length(text) == 0, 0.0).otherwise(F.least(F.lit(1.0), covered * 3.0 / F.length(text)))


def filler_ratio(text: Column) -> Column:
    """(fillers + 3 x hedges) per word, words counted as 6 at least, at most 1."""
    w = words(text)
    fillers = F.size(F.filter(w, lambda x: x.isin(lexicon.FILLERS)))
    return F.least(F.lit(1.0), (fillers + 3 * count_matches(text, lexicon.HEDGE)) / F.greatest(F.lit(6), F.size(w)))


def prose_fragment(text: Column) -> Column:
    """At least five words, mostly letters and spaces, balanced parentheses, no = or ;."""
    letters = F.length(F.regexp_replace(text, r"[^A-Za-z\s]", ""))
    opened, closed = (F.length(text) - F.length(F.regexp_replace(text, p, "")) for p in (r"[(]", r"[)]"))
    return (F.size(words(text)) >= 5) & (letters >= 0.72 * F.length(text)) & (opened == closed) & ~text.rlike("[=;]")


def budget_class(budget: Column) -> Column:
    """0 for no budget, else eight logarithmic classes up to a million tokens."""
    return F.when(budget <= 0, 0).otherwise(F.least(F.lit(8), F.floor(F.log2(budget.cast("double")) * 8 / 20))).cast("long")


def query_class(query: Column) -> Column:
    """Digest of the first eight of a query's sorted distinct terms."""
    return F.md5(F.array_join(F.slice(F.array_sort(F.array_distinct(content_terms(query))), 1, 8), "|"))


def trim_dangling(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)[\s,;:]+(and|or|but|because|which|that|with|for|to|of)?[\s,;:]*$", "")


def without_opener(text: Column) -> Column:
    return replaced(text, lexicon.ASSISTANT_OPENER, "")


def md5_number(text: Column) -> Column:
    """The first 60 bits of the text's md5 digest as a long: the same in every SQL engine."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
