"""Conversation memory on a literal dialogue (the shared ones have invented words without cues) and on the shared turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lexicon
from ..operators import conversation
from .registry import fixture, query, table, values
from .text import _STOP

TALK = [
    (1, 1, 1, "user", "Hi there!"), (1, 2, 1, "user", "Our database server is Postgres version twelve."), (1, 3, 2, "assistant", "Noted, Postgres version twelve it is."),
    (1, 4, 3, "user", "I prefer dark theme dashboards."), (1, 5, 3, "user", "Can you list the open tickets?"), (1, 6, 4, "assistant", "There are nine open tickets."),
    (1, 7, 5, "user", "Actually, the database server is Postgres version fourteen."), (1, 8, 6, "assistant", "Updated to version fourteen."), (1, 9, 7, "user", "I prefer light theme dashboards."),
    (1, 10, 8, "assistant", "Sure."), (1, 11, 9, "user", "We decided to ship on Friday."), (1, 12, 10, "assistant", "Which region should host it?"), (1, 13, 11, "user", "You must never log passwords."), (1, 14, 12, "user", "My favourite editor is vim today."), (1, 15, 13, "user", "My favourite editor is vim."),
    (3, 1, 1, "user", "The server region is Oslo."), (3, 2, 2, "assistant", "Noted."), (3, 3, 3, "user", "Actually, the server region is Bergen."), (3, 4, 4, "assistant", "Fine."), (3, 5, 5, "user", "Deploy it."), (3, 6, 6, "assistant", "Done."), (3, 7, 7, "user", "Good."),
    (2, 1, 1, "user", "Thanks!"), (2, 2, 2, "assistant", "The budget is 4000 euros."), (2, 3, 3, "user", "Scratch that, budget is 5000 euros."), (2, 4, 4, "assistant", "How many users do you have?"),
]
TRANSCRIPT = [(1, 1, "intro"), (1, 2, "User: hello"), (1, 3, "more"), (1, 4, "assistant: yes"), (2, 1, "agent> a"), (2, 2, "customer: b")]
_Q = lambda p: p.replace("'", "''")
_T = f"(SELECT * FROM ({values(TALK)}) t(conv, idx, turn, role, sentence))"
_KIND = f"CASE WHEN length(trim(sentence)) = 0 OR regexp_matches(sentence, '{_Q(lexicon.SMALL_TALK)}') AND length(sentence) < 80 THEN 'smalltalk' " + " ".join(f"WHEN regexp_matches(sentence, '{_Q(p)}') THEN '{n}'" for n, p in lexicon.RECORD_CUES) + f" WHEN regexp_matches(sentence, '{_Q(lexicon.QUESTION)}') THEN 'question' ELSE 'answer' END"
# DuckDB's list_distinct doesn't keep the order: the first place of each term does
_TERMS = f"[w FOR w, i IN regexp_extract_all(lower(sentence), '[a-z0-9_]+') IF length(w) >= 2 AND NOT list_contains({_STOP}, w) AND NOT regexp_matches(w, '^[0-9]') AND list_position(regexp_extract_all(lower(sentence), '[a-z0-9_]+'), w) = i]"
_R = f"r AS (SELECT *, concat_ws(':', rtype, CASE WHEN len(h) > 0 THEN array_to_string(list_sort(h[1:3]), '|') ELSE '~' END) AS subject FROM (SELECT *, [t FOR t IN terms IF length(t) > 2] AS h FROM (SELECT *, {_KIND} AS rtype, {_TERMS} AS terms FROM {_T})))"
_OV = "CASE WHEN least(len({0}), len({1})) = 0 THEN 0 ELSE len(list_intersect({0}, {1})) / least(len({0}), len({1}))::DOUBLE END"
_SAME = f"k AS (SELECT *, lead(idx) OVER w AS nidx, lead(terms) OVER w AS nterms FROM r WHERE rtype IN ('fact', 'preference', 'decision') WINDOW w AS (PARTITION BY conv, subject ORDER BY idx)), same AS (SELECT conv, idx, nidx AS superseded_by FROM k WHERE nidx IS NOT NULL AND {_OV.format('terms', 'nterms')} >= 0.5)"
_CORR = f"p AS (SELECT e.conv, e.idx, c.idx AS c_idx, round({_OV.format('e.terms', 'c.terms')} * (0.6::DOUBLE + 0.4::DOUBLE * exp(-(c.turn - e.turn) / 40.0::DOUBLE)), 9) AS score FROM r e JOIN r c ON e.conv = c.conv AND e.idx < c.idx AND c.rtype = 'correction' WHERE e.rtype NOT IN ('smalltalk', 'question', 'correction')), corr AS (SELECT conv, idx, c_idx AS superseded_by FROM (SELECT *, row_number() OVER (PARTITION BY conv, c_idx ORDER BY score DESC, idx DESC) AS n FROM p WHERE score >= 0.45) WHERE n = 1)"


def _records(spark: SparkSession) -> DataFrame:
    return conversation.records(fixture(spark, TALK, "conv long, idx long, turn long, role string, sentence string"))


@query("record_type", f"WITH {_R} SELECT conv, idx, rtype, subject FROM r")
def record_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark).select("conv", "idx", "rtype", "subject")


@query("record_type_counts", f"SELECT {_KIND} AS rtype, count(*) AS n FROM (SELECT text AS sentence FROM conversations) GROUP BY 1")
def record_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy(conversation.record_type(F.col("text")).alias("rtype")).agg(F.count(F.lit(1)).alias("n"))


@query("same_key_supersede", f"WITH {_R}, {_SAME} SELECT * FROM same")
def same_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.same_subject(_records(spark))


@query("correction_supersede", f"WITH {_R}, {_CORR} SELECT * FROM corr")
def correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.corrections(_records(spark))


@query("dead_turn_answers", f"WITH {_R}, {_SAME}, {_CORR}, d AS (SELECT conv, idx FROM same UNION SELECT conv, idx FROM corr), t AS (SELECT conv, turn, min(role) AS role, min(CASE WHEN d.idx IS NULL THEN 0 ELSE 1 END) AS dead FROM r LEFT JOIN d USING (conv, idx) GROUP BY conv, turn), pl AS (SELECT *, lag(dead) OVER (PARTITION BY conv ORDER BY turn) AS before, count(*) OVER (PARTITION BY conv) - row_number() OVER (PARTITION BY conv ORDER BY turn) AS lft FROM t) SELECT conv, turn FROM pl WHERE role = 'assistant' AND before = 1 AND lft >= 4")
def dead_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    recs = _records(spark)
    return conversation.answers_to_dead(recs, conversation.same_subject(recs).unionByName(conversation.corrections(recs)))


@query("turn_value", f"WITH {_R} SELECT conv, turn, round(sum(CASE rtype " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in lexicon.RECORD_WEIGHTS.items()) + " END), 6) AS value FROM r GROUP BY conv, turn")
def turn_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.turn_value(_records(spark)).withColumn("value", F.round("value", 6))


@query("recency_window", "SELECT conv_id, turn, round(row_number() OVER w / count(*) OVER (PARTITION BY conv_id), 6) AS recency, row_number() OVER w > count(*) OVER (PARTITION BY conv_id) - 4 AS verbatim FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.recency(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.round("recency", 6).alias("recency"), "verbatim")


@query("chat_lines", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def chat_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import requests

    return requests.chat_text(table(spark, sf_dir, "conversations"))


@query("transcript_turns", f"WITH l AS (SELECT *, nullif(lower(regexp_extract(line, '{_Q(lexicon.ROLE_MARKER)}', 1)), '') AS role FROM ({values(TRANSCRIPT)}) t(doc_id, n, line)), m AS (SELECT *, count(role) OVER (PARTITION BY doc_id ORDER BY n) AS turn FROM l) SELECT doc_id, turn, max(role) AS role, string_agg(trim(regexp_replace(line, '{_Q(lexicon.ROLE_MARKER)}', '')), chr(10) ORDER BY n) AS text FROM m WHERE turn > 0 GROUP BY doc_id, turn")
def transcript_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.turns_of(fixture(spark, TRANSCRIPT, "doc_id long, n long, line string"))
