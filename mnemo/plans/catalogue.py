"""The registered queries of the model, each beside the SQL that another engine answers it with."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo import schema
from mnemo.functions import identity, scoring, text, vectors
from mnemo.operators import distill, embedding, folds, lineage, maintenance, ordered, passes, predicates, reads, recall, timers, verdicts
from mnemo.operators.predicates import ExactScope, NamespaceWide, Scope
from mnemo.plans.access import Context
from mnemo.plans.recall_plan import RecallPlan
from mnemo.sources import events, shared, store, tables
from mnemo.sources.cells import CellIndex
from mnemo.sources.postings import FullTextIndex
from mnemo.streaming import projections, queue

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SPACE, NS, SCOPE, WORDS = "space_test", "en", Scope("en", "source", "src3"), "oning ering"
NOW = datetime(2024, 3, 1)
SINCE, UNTIL = datetime(2024, 1, 1, 10), datetime(2024, 1, 3)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def at(column: str) -> str:
    """A time as text in SQL."""
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {column}"


def shown(df: DataFrame) -> DataFrame:
    """Times as text, tags as one text."""
    times = {f.name: F.date_format(f.name, "yyyy-MM-dd HH:mm:ss") for f in df.schema if f.dataType.simpleString() == "timestamp"}
    lists = {f.name: F.array_join(f.name, ",") for f in df.schema if f.dataType.simpleString() == "array<string>"}
    return df.withColumns(times | lists)


PAD = "lpad(({})::VARCHAR, 8, '0')"
M = """memories AS (SELECT CASE WHEN {space} THEN 'space_other' ELSE 'space_test' END AS memory_space_id,
 'm_' || lpad(d.doc_id::VARCHAR, 8, '0') AS memory_id, 'agent_' || (d.doc_id % 7) AS agent_id,
 CASE WHEN d.doc_id % 3 = 0 THEN 's_' || lpad((d.doc_id % 10)::VARCHAR, 8, '0') END AS session_id, d.lang AS namespace,
 CASE WHEN d.doc_id % 4 <> 0 THEN 'source' END AS scope_kind, CASE WHEN d.doc_id % 4 <> 0 THEN d.source END AS scope_ref,
 CASE d.doc_id % 5 WHEN 0 THEN 'fact' WHEN 1 THEN 'pattern' WHEN 2 THEN 'preference' WHEN 3 THEN 'constraint' ELSE 'instruction' END AS memory_type,
 d.text AS content, (d.doc_id * 37 % 121)::INTEGER AS priority, CASE l.quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' ELSE 'medium' END AS confidence,
 d.lang || ',' || d.source AS tags, CASE d.doc_id % 10 WHEN 7 THEN 'archived' WHEN 8 THEN 'superseded' WHEN 9 THEN 'merged' ELSE 'active' END AS status,
 CASE WHEN d.doc_id % 10 IN (8, 9) THEN 'm_' || lpad((d.doc_id - d.doc_id % 10)::VARCHAR, 8, '0') END AS superseded_by,
 CASE WHEN d.doc_id % 10 = 0 THEN 'm_' || lpad((d.doc_id + 8)::VARCHAR, 8, '0') END AS supersedes, e.embedding,
 CASE WHEN d.doc_id % 2 = 0 THEN sha256(d.text) WHEN d.doc_id % 6 = 1 THEN 'stale' END AS content_hash,
 TIMESTAMP '2024-01-01' + to_hours(d.doc_id) AS created_at, TIMESTAMP '2024-01-01' + to_hours(d.doc_id + 1) AS updated_at
 FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id)"""
MEM, TENS = M.format(space="d.doc_id % 5 = 0"), M.format(space="floor(d.doc_id / 10)::BIGINT % 2 = 1")
TURNS = """turns AS (SELECT CASE WHEN floor(conv_id / 8)::BIGINT % 2 = 1 THEN 'space_other' ELSE 'space_test' END AS memory_space_id,
 's_' || lpad(conv_id::VARCHAR, 8, '0') || '-' || turn AS turn_id, 's_' || lpad(conv_id::VARCHAR, 8, '0') AS session_id, turn::INTEGER AS turn_index, role,
 text AS content, NULL::VARCHAR AS tool_summary, octet_length(encode(text))::INTEGER AS prompt_tokens, NULL::INTEGER AS output_tokens,
 TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS recorded_at FROM conversations)"""
SES = """sessions AS (SELECT CASE WHEN floor(n / 8)::BIGINT % 2 = 1 THEN 'space_other' ELSE 'space_test' END AS memory_space_id, 's_' || lpad(n::VARCHAR, 8, '0') AS session_id,
 'agent_' || (n % 7) AS agent_id, 'focus_' || (n % 4) AS focus, 'chat' AS namespace, CASE WHEN n % 3 <> 0 THEN 'topic' END AS scope_kind, CASE WHEN n % 3 <> 0 THEN 't' || (n % 3) END AS scope_ref,
 CASE WHEN n % 8 <> 0 THEN 's_' || lpad((n - 1)::VARCHAR, 8, '0') END AS previous_session_id, CASE WHEN n % 8 = 7 THEN 's_' || lpad((n - n % 8)::VARCHAR, 8, '0') END AS parent_session_id,
 CASE WHEN n % 8 = 7 THEN 1 ELSE 0 END AS delegation_depth, CASE n % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'awaiting' WHEN 2 THEN 'completed' WHEN 3 THEN 'failed' ELSE 'interactive' END AS status,
 CASE WHEN n % 5 = 1 THEN 'key_' || (n % 3) END AS awaiting_correlation_key, TIMESTAMP '2024-01-01' + to_hours(n) AS started_at FROM (SELECT DISTINCT conv_id AS n FROM conversations))"""
LOG = """log0 AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, json_extract_string(props, '$.k')::INTEGER AS k FROM events),
log AS (SELECT CASE WHEN version > 1 AND k % 11 = 0 THEN 'space_other' ELSE 'space_test' END AS memory_space_id, 'u_' || lpad(user_id::VARCHAR, 8, '0') AS stream_id, version::INTEGER AS version,
 CASE WHEN version = 1 THEN 'recorded' WHEN event_type = 'signup' THEN 'superseded' WHEN event_type = 'error' THEN 'archived' WHEN event_type = 'click' THEN 'tags' WHEN event_type = 'view' THEN 'confidence' ELSE 'merged' END AS kind,
 k, event_id, ts AS at_ FROM log0)"""
MEMCOLS = f"memory_space_id, memory_id, agent_id, session_id, namespace, scope_kind, scope_ref, memory_type, content, priority, confidence, tags, status, superseded_by, supersedes, {at('created_at')}, {at('updated_at')}"
SESCOLS = f"memory_space_id, session_id, agent_id, focus, namespace, scope_kind, scope_ref, previous_session_id, parent_session_id, delegation_depth, status, awaiting_correlation_key, {at('started_at')}"
BASE = f"memory_space_id = '{SPACE}' AND status = 'active' AND namespace = '{NS}'"
GLOBAL, ENTITY = "scope_kind IS NULL AND scope_ref IS NULL", "scope_kind = 'source' AND scope_ref = 'src3'"


def _sessions(s: SparkSession, d: str) -> DataFrame:
    return tables.sessions(s, d).drop("created_at")


# ---- named reads (S)


@query("mem_by_id", f"WITH {MEM} SELECT {MEMCOLS} FROM memories WHERE memory_space_id = '{SPACE}' AND memory_id = 'm_00000042'")
def mem_by_id(s, d):
    return shown(reads.memory_by_id(tables.memories(s, d), SPACE, "m_00000042"))


@query("mem_by_namespace", f"WITH {MEM} SELECT {MEMCOLS} FROM memories WHERE {BASE}")
def mem_by_namespace(s, d):
    return shown(reads.active_in_namespace(tables.memories(s, d), SPACE, NS))


@query("mem_by_scope_global", f"WITH {MEM} SELECT {MEMCOLS} FROM memories WHERE {BASE} AND {GLOBAL}")
def mem_by_scope_global(s, d):
    return shown(reads.active_global(tables.memories(s, d), SPACE, NS))


@query("mem_by_scope_entity", f"WITH {MEM} SELECT {MEMCOLS} FROM memories WHERE {BASE} AND {ENTITY}")
def mem_by_scope_entity(s, d):
    return shown(reads.active_by_scope(tables.memories(s, d), SPACE, SCOPE))


@query("mem_by_session", f"WITH {MEM} SELECT {MEMCOLS} FROM memories WHERE memory_space_id = '{SPACE}' AND session_id = 's_00000003'")
def mem_by_session(s, d):
    return shown(reads.by_session(tables.memories(s, d), SPACE, "s_00000003"))


@query("mem_by_type", f"WITH {MEM} SELECT {MEMCOLS} FROM memories WHERE {BASE} AND memory_type = 'preference'")
def mem_by_type(s, d):
    return shown(reads.active_by_type(tables.memories(s, d), SPACE, NS, "preference"))


@query("mem_scope_columns", f"WITH {MEM} SELECT namespace, scope_kind, scope_ref FROM memories WHERE memory_space_id = '{SPACE}' AND memory_id = 'm_00000042'")
def mem_scope_columns(s, d):
    return reads.memory_scope(tables.memories(s, d), SPACE, "m_00000042")


@query("ses_by_id", f"WITH {SES} SELECT {SESCOLS} FROM sessions WHERE memory_space_id = '{SPACE}' AND session_id = 's_00000003'")
def ses_by_id(s, d):
    return shown(reads.session_by_id(_sessions(s, d), SPACE, "s_00000003"))


@query("ses_recent", f"WITH {SES} SELECT {SESCOLS} FROM sessions WHERE memory_space_id = '{SPACE}' AND namespace = 'chat' ORDER BY sessions.started_at DESC, session_id LIMIT 20")
def ses_recent(s, d):
    return shown(reads.recent_sessions(_sessions(s, d), SPACE, "chat", 20))


@query("ses_by_scope", f"WITH {SES} SELECT {SESCOLS} FROM sessions WHERE memory_space_id = '{SPACE}' AND namespace = 'chat' AND scope_kind IS NOT DISTINCT FROM NULL AND scope_ref IS NOT DISTINCT FROM NULL")
def ses_by_scope(s, d):
    return shown(reads.sessions_by_scope(_sessions(s, d), SPACE, "chat", None, None))


@query("ses_by_focus", f"WITH {SES} SELECT {SESCOLS} FROM sessions WHERE memory_space_id = '{SPACE}' AND namespace = 'chat' AND focus = 'focus_2'")
def ses_by_focus(s, d):
    return shown(reads.sessions_by_focus(_sessions(s, d), SPACE, "chat", "focus_2"))


@query("ses_range", f"WITH {SES} SELECT {SESCOLS} FROM sessions WHERE memory_space_id = '{SPACE}' AND namespace = 'chat' AND sessions.started_at >= TIMESTAMP '{SINCE}' AND sessions.started_at < TIMESTAMP '{UNTIL}'")
def ses_range(s, d):
    return shown(reads.sessions_started(_sessions(s, d), SPACE, "chat", SINCE, UNTIL))


@query("ses_children", f"WITH {SES} SELECT {SESCOLS} FROM sessions WHERE memory_space_id = '{SPACE}' AND parent_session_id = 's_00000016'")
def ses_children(s, d):
    return shown(reads.delegation_children(_sessions(s, d), SPACE, "s_00000016"))


@query("ses_awaiting", f"WITH {SES} SELECT {SESCOLS} FROM sessions WHERE memory_space_id = '{SPACE}' AND namespace = 'chat' AND status = 'awaiting' AND awaiting_correlation_key = 'key_1'")
def ses_awaiting(s, d):
    return shown(reads.awaiting_sessions(_sessions(s, d), SPACE, "chat", "key_1"))


@query("turns_by_session", f"WITH {TURNS} SELECT memory_space_id, turn_id, session_id, turn_index, role, content, prompt_tokens, {at('recorded_at')} FROM turns WHERE memory_space_id = '{SPACE}' AND session_id = 's_00000003'")
def turns_by_session(s, d):
    return shown(reads.session_turns(tables.turns(s, d), SPACE, "s_00000003")).drop("tool_summary", "output_tokens")


@query("embedding_state", f"WITH {MEM} SELECT memory_space_id, embedding IS NOT NULL AS embedded, content_hash FROM memories WHERE memory_id = 'm_00000041' AND status = 'active'")
def embedding_state(s, d):
    return reads.embedding_state(tables.memories(s, d, vectors=True), "m_00000041")


@query("backfill_all", f"WITH {MEM} SELECT memory_space_id, memory_id, content, {at('created_at')} FROM memories WHERE status = 'active' AND (embedding IS NULL OR content_hash IS DISTINCT FROM sha256(content))")
def backfill_all(s, d):
    return shown(reads.embedding_backlog(tables.memories(s, d, vectors=True)))


@query("backfill_one_space", f"WITH {MEM} SELECT memory_space_id, memory_id, content, {at('created_at')} FROM memories WHERE status = 'active' AND memory_space_id = 'space_other' AND (embedding IS NULL OR content_hash IS DISTINCT FROM sha256(content))")
def backfill_one_space(s, d):
    return shown(reads.embedding_backlog(tables.memories(s, d, vectors=True), "space_other"))


# ---- recall (K, R, F-4 to F-10)

TARGETS = {"global": (ExactScope(Scope(NS)), f"{BASE} AND {GLOBAL}"), "entity": (ExactScope(SCOPE), f"{BASE} AND {ENTITY}"), "wide": (NamespaceWide(NS), BASE)}


#: The words of the data that have a lexeme of the queries (tests hold them against the stemmer), as SQL has no stems.
FORMS = {"one": "oned|onedly|ones|oning|oningly", "ere": "ered|eredly|eres|ering|eringly", "disgust": "disgusting", "idiot": "idiot", "thing": "thing|thinged|thinges|thinging|thingingly|thingly|thinglyed", "reed": "reed|reeded|reedes|reeding|reedly"}
TOKENS = "list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


def _places_sql(lexeme: str) -> str:
    return f"list_distinct(list_transform(list_filter(range(1, len(t) + 1), lambda i: regexp_full_match(t[i], '{FORMS[lexeme]}'))[1:255], lambda i: least(i, 16383)))"


def _near_sql(one: str, other: str) -> str:
    """The rank of a conjunction of two lexemes, from their places."""
    pair = "CASE WHEN x = y OR abs(x - y) > 100 THEN 0 ELSE ln(1 - 0.1::DOUBLE * sqrt(1 / (1.005::DOUBLE + 0.05::DOUBLE * exp(abs(x - y) / 1.5::DOUBLE - 2)))) END"
    return f"round(1 - exp(coalesce(list_sum(list_transform({one}, lambda x: list_sum(list_transform({other}, lambda y: {pair})))), 0)), 9)"


def _fts_sql(where: str) -> str:
    return f"""toks AS (SELECT memory_id, memories.created_at, {TOKENS} AS t FROM memories WHERE {where}),
found AS (SELECT memory_id, created_at, {_places_sql("one")} AS a, {_places_sql("ere")} AS b FROM toks),
scored AS (SELECT memory_id, created_at, {_near_sql("a", "b")} AS fts_score FROM found WHERE len(a) > 0 AND len(b) > 0),
fts AS (SELECT memory_id, (row_number() OVER (ORDER BY fts_score DESC, created_at DESC, memory_id))::INTEGER AS fts_rank, fts_score FROM scored QUALIFY fts_rank <= 50)"""


def indexed(s: SparkSession, d: str) -> FullTextIndex:
    """An index kept up over the memories' history: first with other contents and states of some, then with what changed, some removed and entered anew."""
    now = tables.memories(s, d)
    n = F.crc32("memory_id")
    index = FullTextIndex(s, shared.folder(s, "postings"))
    index.update(now.withColumns({"content": F.when(n % 7 == 0, F.concat(F.lit("oning ering disgusting "), "content")).otherwise(F.col("content")), "status": F.when(n % 5 == 0, "active").otherwise(F.col("status"))}))
    index.remove(now.filter(n % 11 == 0).select("memory_id"))
    index.update(now.filter((n % 7 == 0) | (n % 5 == 0) | (n % 11 == 0)))
    return index


def _vec_sql(where: str) -> str:
    return f"""q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
dist AS (SELECT memory_id, round(1 - list_dot_product(embedding::DOUBLE[], v) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v, v))), 9) AS distance FROM memories, q WHERE {where} AND embedding IS NOT NULL),
vec AS (SELECT memory_id, distance, (row_number() OVER (ORDER BY distance, memory_id))::INTEGER AS vec_rank FROM dist QUALIFY vec_rank <= 50)"""


def question(s: SparkSession, d: str) -> list[float]:
    """The query vector: one row's."""
    return [float(x) for x in tables.read(s, d, "embeddings").filter("vec_id = 0").first()["embedding"]]


for _name, (_target, _where) in TARGETS.items():

    @query(f"fts_rank_{_name}", f"WITH {MEM}, {_fts_sql(_where)} SELECT memory_id, fts_rank, fts_score FROM fts")
    def _(s, d, t=_target):
        return recall.fts_candidates(tables.memories(s, d), SPACE, t, WORDS)

    @query(f"fts_index_{_name}", f"WITH {MEM}, {_fts_sql(_where)} SELECT memory_id, fts_rank, fts_score FROM fts")
    def _(s, d, t=_target):
        return indexed(s, d).search(SPACE, t, WORDS)

    @query(f"vec_rank_{_name}", f"WITH {MEM}, {_vec_sql(_where)} SELECT memory_id, vec_rank, distance FROM vec")
    def _(s, d, t=_target):
        return recall.vec_candidates(tables.memories(s, d, vectors=True), SPACE, t, question(s, d))


_OR = f"""WITH {MEM}, toks AS (SELECT memory_id, memories.created_at, {TOKENS} AS t FROM memories WHERE {BASE}),
found AS (SELECT memory_id, created_at, {", ".join(f"{_places_sql(x)} AS {x}" for x in ("disgust", "idiot", "ere", "one"))} FROM toks),
hit AS (SELECT *, len(disgust) > 0 AND len(idiot) = 0 OR len(list_filter(ere, lambda x: list_contains(one, x + 1))) > 0 AS hit FROM found),
scored AS (SELECT memory_id, created_at, round(0.1::DOUBLE / 1.64493406685::DOUBLE / 4 * list_sum(list_transform([len(disgust), len(idiot), len(ere), len(one)], lambda n: coalesce(list_sum(list_transform(range(1, n + 1), lambda j: 1.0::DOUBLE / (j * j))), 0))), 9) AS fts_score FROM hit WHERE hit)
SELECT memory_id, (row_number() OVER (ORDER BY fts_score DESC, created_at DESC, memory_id))::INTEGER AS fts_rank, fts_score FROM scored QUALIFY fts_rank <= 50"""


@query("fts_alternatives", _OR)
def fts_alternatives(s, d):
    """A phrase, a word without another, and the rank of alternatives."""
    return indexed(s, d).search(SPACE, NamespaceWide(NS), 'the disgusting -idiot or "ering ones"')


def _recall_sql(fts: bool, vec: bool, limit: int, per: int, total: int) -> str:
    ranks = {
        (True, True): "ranks AS (SELECT coalesce(fts.memory_id, vec.memory_id) AS memory_id, fts_rank, vec_rank FROM fts FULL OUTER JOIN vec ON fts.memory_id = vec.memory_id)",
        (True, False): "ranks AS (SELECT memory_id, fts_rank, NULL::INTEGER AS vec_rank FROM fts)",
        (False, True): "ranks AS (SELECT memory_id, NULL::INTEGER AS fts_rank, vec_rank FROM vec)",
    }[fts, vec]
    cut = f"CASE WHEN length(content) <= {per} THEN content ELSE substr(content, 1, {per} - 3) || '...' END"
    return f"""WITH {MEM}, {_fts_sql(BASE)}, {_vec_sql(BASE)}, {ranks},
hits AS (SELECT m.memory_id, fts_rank, vec_rank, {cut} AS content, round(coalesce(1.0::DOUBLE / (60 + fts_rank), 0) + coalesce(1.0::DOUBLE / (60 + vec_rank), 0)
 + 0.1::DOUBLE * exp(-ln(2.0::DOUBLE) * greatest(0, epoch_us(TIMESTAMP '2024-03-01') - epoch_us(m.created_at)) / 86400000000.0::DOUBLE / 30)
 + 0.15::DOUBLE * (CASE WHEN priority <= 0 THEN 1 ELSE greatest(0, least(1, 1 - priority / 100.0::DOUBLE)) END)
 + 0.05::DOUBLE * (CASE confidence WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END), 9) AS score FROM memories m JOIN ranks USING (memory_id)),
best AS (SELECT * FROM hits ORDER BY score DESC, memory_id LIMIT {limit}),
kept AS (SELECT *, sum(length(content)) OVER (ORDER BY score DESC, memory_id ROWS UNBOUNDED PRECEDING) AS upto FROM best)
SELECT memory_id, coalesce(fts_rank, 0) AS fts_rank, coalesce(vec_rank, 0) AS vec_rank, content, round(score, 6) AS score FROM kept WHERE upto <= {total}"""


def _recall(s, d, fts, vec, limit=8, per=scoring.PER_MEMORY, total=scoring.TOTAL):
    found = recall.execute(tables.memories(s, d, vectors=vec), SPACE, NamespaceWide(NS), WORDS, question(s, d) if vec else None, RecallPlan(fts, vec, vec), NOW, limit, per, total)
    return found.select("memory_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("fts_rank", "vec_rank")], "content", F.round("score", 6).alias("score"))


for _name, _args in {"recall_keyword": (True, False, 8, 2000, 12000), "recall_embedding": (False, True, 8, 2000, 12000), "recall_hybrid": (True, True, 8, 2000, 12000), "recall_hybrid_budgeted": (True, True, 50, 400, 3000)}.items():
    query(_name, _recall_sql(*_args))(lambda s, d, a=_args: _recall(s, d, *a))


def _probed(s: SparkSession, d: str):
    """Of each target the outcome of the cell index with its exact fallback, and the rows."""
    m, vector = tables.memories(s, d, vectors=True), question(s, d)
    index = CellIndex(s, shared.folder(s, "cells")).build(m)
    for name, (target, _) in TARGETS.items():
        yield name, *recall.vec_candidates_diagnosed(m, SPACE, target, vector, index.offer(SPACE, target, vector))


@query("vec_outcomes", f"WITH {MEM}, n AS ({' UNION ALL '.join(f"SELECT '{n}' AS target, count(*) AS n FROM memories WHERE {w} AND embedding IS NOT NULL" for n, (_, w) in TARGETS.items())}) SELECT target, least(n, 50) AS approximate_rows, n < 50 AS exact_fallback, least(n, 50) AS found_rows FROM n")
def vec_outcomes(s, d):
    """What the approximate pass brings, whether the exact one follows, and what is found: the SQL holds where a namespace is read whole, as it is while it has fewer than 1000 vectors."""
    return s.createDataFrame([(n, o.approximate_rows, o.exact_fallback, o.rows) for n, o, _ in _probed(s, d)], "target string, approximate_rows bigint, exact_fallback boolean, found_rows bigint")


@query("recall_at_k", f"WITH {MEM}, {_vec_sql(BASE)}, c AS (SELECT count(*) AS wanted FROM vec WHERE vec_rank <= 10) SELECT wanted AS found, wanted, 1.0::DOUBLE AS recall FROM c")
def recall_at_k(s, d):
    """The index against a ranking of all candidates that shares nothing with it."""
    m = tables.memories(s, d, vectors=True)
    found = next(rows for name, _, rows in _probed(s, d) if name == "wide")
    here = predicates.candidates(m, SPACE, NamespaceWide(NS)).filter("embedding IS NOT NULL").join(tables.read(s, d, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("q")))
    norm = lambda v: F.sqrt(vectors.dot(F.col(v), F.col(v)))
    truth = here.select("memory_id", F.round(vectors.dot(F.col("embedding"), F.col("q")) / (norm("embedding") * norm("q")), 9).alias("cosine"))
    return recall.recall_at_k(found, truth.orderBy(F.desc("cosine"), "memory_id").limit(10).withColumn("position", F.lit(1)), 10)


@query("scoring_terms", f"""WITH {MEM} SELECT memory_id, round(exp(-ln(2.0::DOUBLE) * greatest(0, epoch_us(TIMESTAMP '2024-03-01') - epoch_us(memories.created_at)) / 86400000000.0::DOUBLE / 30), 6) AS recency,
 (CASE WHEN priority <= 0 THEN 1.0::DOUBLE ELSE greatest(0, least(1, 1 - priority / 100.0::DOUBLE)) END) AS priority_weight, CASE confidence WHEN 'high' THEN 1.0::DOUBLE WHEN 'medium' THEN 0.6::DOUBLE ELSE 0.3::DOUBLE END AS confidence_weight,
 CASE WHEN length(content) <= 40 THEN content ELSE substr(content, 1, 37) || '...' END AS short FROM memories""")
def scoring_terms(s, d):
    m = tables.memories(s, d)
    return m.select("memory_id", F.round(scoring.recency(F.col("created_at"), F.lit(NOW)), 6).alias("recency"), scoring.priority_weight(F.col("priority")).alias("priority_weight"), scoring.confidence_weight(F.col("confidence")).alias("confidence_weight"), scoring.truncated(F.col("content"), 40).alias("short"))


# ---- lineage (G)


@query("supersession_chain", f"""WITH RECURSIVE {TENS}, mine AS (SELECT * FROM memories WHERE memory_space_id = '{SPACE}'),
chain(memory_id) AS (SELECT memory_id FROM mine WHERE memory_id = 'm_00000020' UNION SELECT m.memory_id FROM chain c JOIN mine a ON a.memory_id = c.memory_id JOIN mine m ON m.memory_id = a.superseded_by OR m.memory_id = a.supersedes OR m.superseded_by = c.memory_id OR m.supersedes = c.memory_id)
SELECT memory_id, status, supersedes, superseded_by, {at('created_at')} FROM mine WHERE memory_id IN (SELECT memory_id FROM chain)""")
def supersession_chain(s, d):
    return shown(lineage.supersession_chain(tables.memories(s, d, by_tens=True), SPACE, "m_00000020"))


@query("supersession_chains", f"""WITH RECURSIVE {TENS}, e0 AS (SELECT m.memory_space_id, m.memory_id AS a, o.memory_id AS b FROM memories m JOIN memories o ON o.memory_space_id = m.memory_space_id AND (o.memory_id = m.superseded_by OR o.memory_id = m.supersedes)),
e AS MATERIALIZED (SELECT * FROM e0 UNION SELECT memory_space_id, b, a FROM e0), reach AS (SELECT memory_space_id, a AS memory_id, a AS root FROM e UNION SELECT r.memory_space_id, e.b, r.root FROM reach r JOIN e ON e.memory_space_id = r.memory_space_id AND e.a = r.memory_id)
SELECT memory_space_id, memory_id, min(root) AS chain FROM reach GROUP BY ALL""")
def supersession_chains(s, d):
    return lineage.supersession_components(tables.memories(s, d, by_tens=True))


@query("session_chain", f"""WITH RECURSIVE {SES}, chain AS (SELECT session_id, previous_session_id, started_at, [session_id] AS path FROM sessions WHERE memory_space_id = '{SPACE}' AND session_id = 's_00000022'
 UNION ALL SELECT s.session_id, s.previous_session_id, s.started_at, list_append(c.path, s.session_id) FROM chain c JOIN sessions s ON s.session_id = c.previous_session_id AND s.memory_space_id = '{SPACE}' WHERE NOT list_contains(c.path, s.session_id))
SELECT session_id, previous_session_id, {at('started_at')} FROM chain""")
def session_chain(s, d):
    return shown(lineage.session_chain(tables.sessions(s, d), SPACE, "s_00000022"))


@query("lineage_violations", f"""WITH {SES}, v AS (SELECT session_id, CASE WHEN previous_session_id = session_id THEN 'continues itself' WHEN parent_session_id = session_id THEN 'delegates to itself' WHEN x < 0 OR x > 64 THEN 'depth out of range'
 WHEN parent_session_id IS NOT NULL AND x < 1 THEN 'child at depth 0' WHEN parent_session_id IS NULL AND x > 0 THEN 'root below depth 0' END AS reason FROM (SELECT *, delegation_depth + (CASE WHEN session_id LIKE '%9' THEN 70 WHEN session_id LIKE '%7' THEN -1 ELSE 0 END) AS x FROM sessions)) SELECT * FROM v WHERE reason IS NOT NULL""")
def lineage_violations(s, d):
    bent = tables.sessions(s, d).withColumn("x", F.col("delegation_depth") + F.when(F.col("session_id").endswith("9"), 70).when(F.col("session_id").endswith("7"), -1).otherwise(0))
    reason = lineage.lineage_reason(F.col("session_id"), F.col("previous_session_id"), F.col("parent_session_id"), F.col("x"))
    return bent.select("session_id", reason.alias("reason")).filter("reason IS NOT NULL")


# ---- identities (F-11 to F-19)

ESC = "replace(replace(replace({0}, '%', '%25'), '/', '%2F'), ':', '%3A')"
IDENT = f"concat_ws('/', {ESC.format('ns')}, CASE WHEN scope_kind IS NOT NULL AND ref IS NOT NULL THEN {ESC.format('scope_kind')} END, CASE WHEN scope_kind IS NOT NULL AND ref IS NOT NULL THEN {ESC.format('ref')} END)"


@query("scope_identity", f"""WITH {MEM}, x AS (SELECT *, namespace || '/a:%' AS ns, scope_ref || ':1/2%' AS ref FROM memories), y AS (SELECT memory_space_id, memory_id, ns, scope_kind, ref, {IDENT} AS identity FROM x)
SELECT memory_id, identity, memory_space_id || ':' || identity AS correlation, 'mnemo_scene:' || identity || ':default' AS scene_id, 'mnemo_persona:' || identity AS persona_id, concat_ws('/', ns, scope_kind, ref) AS label FROM y""")
def scope_identity(s, d):
    m = tables.memories(s, d).withColumns({"ns": F.concat("namespace", F.lit("/a:%")), "ref": F.concat("scope_ref", F.lit(":1/2%"))})
    c = F.col("ns"), F.col("scope_kind"), F.col("ref")
    return m.select("memory_id", identity.scope_identity(*c).alias("identity"), identity.correlation_id(F.col("memory_space_id"), *c).alias("correlation"), identity.scene_id(*c).alias("scene_id"), identity.persona_id(*c).alias("persona_id"), identity.scope_label(*c).alias("label"))


@query("scope_slug", f"""WITH {MEM}, x AS (SELECT *, namespace || '/a:%' AS ns, scope_ref || ':1/2%' AS ref FROM memories), y AS (SELECT memory_id, memory_space_id, concat_ws('-', ns, scope_kind, ref) AS readable, {IDENT} AS identity FROM x)
SELECT memory_id, regexp_replace(readable, '[^A-Za-z0-9_-]', '-', 'g') || '-' || substr(sha256(identity), 1, 10) AS slug, regexp_replace(memory_space_id, '[^A-Za-z0-9_-]', '-', 'g') || '-' || substr(sha256(memory_space_id), 1, 10) AS directory FROM y""")
def scope_slug(s, d):
    m = tables.memories(s, d).withColumns({"ns": F.concat("namespace", F.lit("/a:%")), "ref": F.concat("scope_ref", F.lit(":1/2%"))})
    return m.select("memory_id", identity.scope_slug(F.col("ns"), F.col("scope_kind"), F.col("ref")).alias("slug"), identity.space_directory(F.col("memory_space_id")).alias("directory"))


UUID = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-5' || substr({0}, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr({0}, 17, 1)) - 1) % 4 + 1, 1) || substr({0}, 18, 3) || '-' || substr({0}, 21, 12)"


@query("uuid5_ids", f"""WITH {TURNS}, h AS (SELECT turn_id, sha1(unhex('{identity.ATOMS.hex}') || encode(session_id || ':' || content)) AS a, sha1(unhex('{identity.ATOMS.hex}') || encode('audit:' || session_id || ':' || turn_index || ':' || content)) AS b FROM turns)
SELECT turn_id, {UUID.format('a')} AS atom_uuid, 'mnemo_consolidation_decision:' || {UUID.format('b')} AS audit_id FROM h""")
def uuid5_ids(s, d):
    t = tables.turns(s, d)
    return t.select("turn_id", identity.atom_uuid(F.col("session_id"), F.col("content")).alias("atom_uuid"), identity.audit_id(F.col("session_id"), F.col("turn_index"), F.col("content")).alias("audit_id"))


_NIBBLES = "0000000100100011010001010110011110001001101010111100110111101111"
_BASE32 = f"list_aggregate(list_transform(range(26), lambda i: substr('{identity.BASE32}', {' + '.join(f'substr(b, i * 5 + {k + 1}, 1)::INTEGER * {16 >> k}' for k in range(5))} + 1, 1)), 'string_agg', '')"


@query("typeid_parse", f"""WITH {TURNS}, h AS (SELECT turn_id, sha1(unhex('{identity.ATOMS.hex}') || encode(session_id || ':' || content)) AS a FROM turns), u AS (SELECT turn_id, {UUID.format('a')} AS u FROM h),
x AS (SELECT *, '00' || list_aggregate(list_transform(string_split(replace(u, '-', ''), ''), lambda x: substr('{_NIBBLES}', 4 * (strpos('0123456789abcdef', x) - 1) + 1, 4)), 'string_agg', '') AS b FROM u)
SELECT turn_id, 'memory_' || {_BASE32} AS memory_id, u AS strict, NULL::VARCHAR AS wrong_prefix, u AS lenient FROM x""")
def typeid_parse(s, d):
    t = uuid5_ids(s, d).select("turn_id", identity.typed("memory", F.col("atom_uuid")).alias("memory_id"))
    return t.select("turn_id", "memory_id", identity.untyped(F.col("memory_id"), "memory").alias("strict"), identity.untyped(F.col("memory_id"), "session").alias("wrong_prefix"), identity.untyped(F.col("memory_id")).alias("lenient"))


@query("opaque_ids", f"""WITH {MEM}, x AS (SELECT memory_id, CASE priority % 5 WHEN 0 THEN '' WHEN 1 THEN repeat('x', 129) WHEN 2 THEN 'a b' WHEN 3 THEN 'a:b' ELSE memory_id END AS v FROM memories)
SELECT memory_id, CASE WHEN v = '' THEN 'empty' WHEN length(v) > 128 THEN 'too long' WHEN regexp_matches(v, '\\s') THEN 'white space or control character' WHEN regexp_matches(v, '[:#%/]') THEN 'reserved character' END AS problem,
 CASE WHEN v = 'mnemo:unattributed' THEN 'unattributed' WHEN v LIKE 'mnemo:legacy:%' THEN 'legacy' WHEN v LIKE 'mnemo:%' THEN 'unknown marker' ELSE 'known' END AS principal FROM x""")
def opaque_ids(s, d):
    k = F.col("priority") % 5
    v = F.when(k == 0, "").when(k == 1, F.repeat(F.lit("x"), 129)).when(k == 2, "a b").when(k == 3, "a:b").otherwise(F.col("memory_id"))
    return tables.memories(s, d).select("memory_id", identity.opaque_id_problem(v).alias("problem"), identity.principal_kind(v).alias("principal"))


# ---- folds (ST-1, ST-2, W)


def _log(s, d):
    by = F.concat(F.lit("m_"), F.col("k").cast("string"))
    return tables.event_log(s, d).withColumns({"by": by, "tags": F.concat(F.lit("t"), F.col("k").cast("string")), "confidence": F.when(F.col("k") % 2 == 0, "high").otherwise("low")})


@query("memory_fold", f"""WITH {LOG}, home AS (SELECT stream_id, memory_space_id AS h FROM log WHERE version = 1), own AS (SELECT log.* FROM log JOIN home USING (stream_id) WHERE memory_space_id = h)
SELECT memory_space_id, stream_id, coalesce(arg_max(kind, version) FILTER (kind IN ('superseded', 'archived', 'merged')), 'active') AS status, arg_max('m_' || k, version) FILTER (kind IN ('superseded', 'merged')) AS superseded_by,
 arg_max('t' || k, version) FILTER (kind IN ('recorded', 'tags')) AS tags, arg_max(CASE WHEN k % 2 = 0 THEN 'high' ELSE 'low' END, version) FILTER (kind IN ('recorded', 'confidence')) AS confidence,
 strftime(min(CASE WHEN version = 1 THEN at_ END), '%Y-%m-%d %H:%M:%S') AS created_at, strftime(arg_max(at_, version), '%Y-%m-%d %H:%M:%S') AS updated_at, count(*) AS n_events FROM own GROUP BY memory_space_id, stream_id""")
def memory_fold(s, d):
    return shown(folds.fold_memories(_log(s, d)))


@query("streaming_fold", f"""WITH {LOG}, home AS (SELECT stream_id, memory_space_id AS h FROM log WHERE version = 1), own AS (SELECT log.* FROM log JOIN home USING (stream_id) WHERE memory_space_id = h)
SELECT memory_space_id, stream_id, coalesce(arg_max(kind, version) FILTER (kind IN ('superseded', 'archived', 'merged')), 'active') AS status, arg_max('m_' || k, version) FILTER (kind IN ('superseded', 'merged')) AS superseded_by,
 arg_max('t' || k, version) FILTER (kind IN ('recorded', 'tags')) AS tags, arg_max(CASE WHEN k % 2 = 0 THEN 'high' ELSE 'low' END, version) FILTER (kind IN ('recorded', 'confidence')) AS confidence, count(*) AS n_events FROM own GROUP BY memory_space_id, stream_id""")
def streaming_fold(s, d):
    """The log written as files, the versions of a stream spread over them in no order, and folded by the stateful stream."""
    root = shared.folder(s, "streaming-fold")
    log = _log(s, d).select("memory_space_id", "stream_id", "version", "kind", "by", "tags", "confidence", "at")
    log.repartition(4, "version").write.parquet(f"{root}/log")
    stream = s.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/log")
    projections.run_available(projections.memory_projection(stream), projections.upsert_sink(f"{root}/rows", ["stream_id"]), f"{root}/checkpoint")
    return projections.latest(s, f"{root}/rows", ["stream_id"])


SESKIND = "CASE WHEN version = 1 THEN 'started' WHEN event_type = 'signup' THEN 'completed' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'click' THEN 'awaiting' WHEN event_type = 'view' THEN 'resumed' ELSE 'turn' END"


@query("session_fold", f"""WITH {LOG}, l AS (SELECT 'space_test' AS memory_space_id, 'u_' || lpad(user_id::VARCHAR, 8, '0') AS stream_id, version, {SESKIND} AS kind, 'x' || k AS text, 'key' || (k % 5) AS key, ts AS at_ FROM log0),
g AS (SELECT memory_space_id, stream_id, arg_max(kind, version) FILTER (kind <> 'turn') AS kind, arg_max(text, version) FILTER (kind <> 'turn') AS text, arg_max(key, version) FILTER (kind <> 'turn') AS key,
 min(at_) FILTER (kind = 'started') AS started_at, arg_max(at_, version) FILTER (kind IN ('completed', 'failed')) AS completed_at, arg_max(text, version) FILTER (kind = 'failed') AS error_message, arg_max(text, version) FILTER (kind = 'completed') AS summary,
 arg_max(kind, version) FILTER (kind IN ('awaiting', 'resumed')) AS wk, arg_max(text, version) FILTER (kind IN ('awaiting', 'resumed')) AS wt, max(at_) AS updated_at FROM l GROUP BY memory_space_id, stream_id)
SELECT memory_space_id, stream_id, CASE WHEN kind IN ('started', 'resumed') THEN 'running' ELSE kind END AS status, {at('started_at')}, {at('completed_at')}, error_message, summary, CASE WHEN kind = 'awaiting' THEN text END AS awaiting_reason,
 CASE WHEN kind = 'awaiting' THEN key END AS awaiting_correlation_key, CASE WHEN wk = 'resumed' THEN wt END AS resume_input, {at('updated_at')} FROM g""")
def session_fold(s, d):
    e = tables.event_log(s, d)
    kinds = {"recorded": "started", "superseded": "completed", "archived": "failed", "tags": "awaiting", "confidence": "resumed", "merged": "turn"}
    log = maintenance.renamed(e, "kind", kinds).select(F.lit(SPACE).alias("memory_space_id"), "stream_id", "version", "kind", F.concat(F.lit("x"), F.col("k").cast("string")).alias("text"), F.concat(F.lit("key"), (F.col("k") % 5).cast("string")).alias("key"), "at")
    return shown(folds.fold_sessions(log))


TWICE = f"WITH {TURNS}, again AS (SELECT session_id, turn_index, content, 1 AS n FROM turns UNION ALL SELECT session_id, turn_index, content || '!', 2 FROM turns WHERE turn_index % 2 = 0)"


def _twice(s, d):
    t = tables.turns(s, d).select("session_id", "turn_index", "content", F.lit(1).alias("n"))
    return t.unionByName(t.filter("turn_index % 2 = 0").withColumns({"content": F.concat("content", F.lit("!")), "n": F.lit(2)}))


@query("turn_last_wins", f"{TWICE} SELECT session_id, turn_index, arg_max(content, n) AS content, max(n) AS n FROM again GROUP BY session_id, turn_index")
def turn_last_wins(s, d):
    return folds.last_wins(_twice(s, d), ["session_id", "turn_index"], ["n"])


@query("audit_first_wins", f"{TWICE} SELECT session_id, turn_index, arg_min(content, n) AS content, min(n) AS n FROM again GROUP BY session_id, turn_index")
def audit_first_wins(s, d):
    return folds.first_wins(_twice(s, d), ["session_id", "turn_index"], ["n"])


@query("watermark_max", f"WITH {TURNS} SELECT session_id, greatest(max(turn_index), 0) AS last_turn_index, arg_max(memory_space_id, recorded_at) AS memory_space_id, strftime(max(recorded_at), '%Y-%m-%d %H:%M:%S') AS distilled_at FROM turns GROUP BY session_id")
def watermark_max(s, d):
    return shown(folds.advance_watermarks(tables.turns(s, d).select("memory_space_id", "session_id", F.col("turn_index").alias("last_turn_index"), F.col("recorded_at").alias("distilled_at"))))


@query("memory_upsert", f"""WITH {MEM}, c AS (SELECT memory_id, content, created_at FROM memories WHERE priority < 60), n AS (SELECT memory_id, content || '*' AS content, updated_at AS created_at FROM memories WHERE priority % 3 = 0)
SELECT coalesce(n.memory_id, c.memory_id) AS memory_id, coalesce(n.content, c.content) AS content, strftime(coalesce(c.created_at, n.created_at), '%Y-%m-%d %H:%M:%S') AS created_at FROM c FULL OUTER JOIN n USING (memory_id)""")
def memory_upsert(s, d):
    m = tables.memories(s, d)
    new = m.filter("priority % 3 = 0").select("memory_id", F.concat("content", F.lit("*")).alias("content"), F.col("updated_at").alias("created_at"))
    return shown(folds.upsert(m.filter("priority < 60").select("memory_id", "content", "created_at"), new, ["memory_id"], ("created_at",)))


@query("audit_append", f"WITH {MEM} SELECT memory_id, agent_id FROM memories WHERE priority % 3 = 0 AND priority >= 60")
def audit_append(s, d):
    m = tables.memories(s, d).select("memory_id", "agent_id", "priority")
    return folds.append_new(m.filter("priority < 60").drop("priority"), m.filter("priority % 3 = 0").drop("priority"), ["memory_id"])


@query("turns_out_of_order", f"WITH {TURNS}, x AS (SELECT session_id, turn_id, turn_index, max(turn_index) OVER (PARTITION BY session_id ORDER BY turn_index % 3, turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest_before FROM turns) SELECT * FROM x WHERE turn_index <= highest_before")
def turns_out_of_order(s, d):
    t = tables.turns(s, d).withColumn("recorded_at", F.timestamp_seconds(F.col("turn_index") % 3))
    return folds.out_of_order(t).select("session_id", "turn_id", "turn_index", "highest_before")


# ---- timers (ST-3 to ST-8, F-20, F-21)

ACT = f"{LOG}, act AS (SELECT stream_id AS session_id, CASE WHEN version = 1 THEN 'started' WHEN kind = 'archived' THEN 'failed' ELSE 'turn' END AS kind, version AS turn_index, at_ FROM log)"


def _activity(s, d):
    kind = F.when(F.col("version") == 1, "started").when(F.col("kind") == "archived", "failed").otherwise("turn")
    return tables.event_log(s, d).select(F.col("stream_id").alias("session_id"), kind.alias("kind"), F.col("version").alias("turn_index"), "at")


def _timers(s, d, reason):
    return timers.session_timers(_activity(s, d), 6 * 3600).filter(F.col("reason") == reason).select("session_id", "reason", F.unix_micros("fire_at").alias("fire_us"))


@query("idle_timers", f"WITH {ACT}, g AS (SELECT session_id, at_, lead(at_) OVER (PARTITION BY session_id ORDER BY at_) AS nxt FROM act WHERE kind IN ('started', 'turn')) SELECT session_id, 'idle' AS reason, min(epoch_us(at_)) + 21600000000 AS fire_us FROM g WHERE nxt IS NULL OR epoch_us(nxt) - epoch_us(at_) > 21600000000 GROUP BY session_id")
def idle_timers(s, d):
    return _timers(s, d, "idle")


@query("ramp_timers", f"WITH {ACT} SELECT session_id, 'ramp' AS reason, epoch_us(at_) AS fire_us FROM act WHERE kind = 'turn' AND (turn_index IN (1, 2, 4, 8, 16) OR turn_index > 16 AND turn_index % 16 = 0)")
def ramp_timers(s, d):
    return _timers(s, d, "ramp")


@query("final_timers", f"WITH {ACT} SELECT session_id, 'final' AS reason, min(epoch_us(at_)) AS fire_us FROM act WHERE kind = 'failed' GROUP BY session_id")
def final_timers(s, d):
    return _timers(s, d, "final")


@query("scene_timers", f"""WITH {MEM}, e AS (SELECT memory_space_id, memory_id, CASE priority % 6 WHEN 0 THEN 'recorded' WHEN 1 THEN 'confidence' WHEN 2 THEN 'archived' WHEN 3 THEN 'superseded' WHEN 4 THEN 'merged' ELSE 'tags' END AS kind, priority AS event_id, namespace AS ns, scope_kind, scope_ref AS ref, updated_at FROM memories)
SELECT memory_space_id || ':' || {IDENT} AS correlation_id, CASE kind WHEN 'recorded' THEN memory_id WHEN 'confidence' THEN memory_id || ':confidence:' || event_id ELSE memory_id || ':' || kind END AS source_id, epoch_us(updated_at) + 5000000 AS fire_us FROM e WHERE kind <> 'tags'""")
def scene_timers(s, d):
    m = tables.memories(s, d)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("recorded", "confidence", "archived", "superseded", "merged", "tags")]), F.col("priority") % 6 + 1)
    events = m.select("memory_space_id", "memory_id", kind.alias("kind"), F.col("priority").alias("event_id"), F.col("updated_at").alias("at"))
    return timers.scene_timers(events, m).select("correlation_id", "source_id", F.unix_micros("fire_at").alias("fire_us"))


@query("retry_delays", "SELECT n::INTEGER AS n, least(900, 30 * pow(2, n - 1))::INTEGER AS timer, CASE WHEN n <= 1 THEN 5 WHEN n = 2 THEN 20 WHEN n = 3 THEN 60 ELSE 180 END AS embedding, least(60, 5 * pow(2, n))::INTEGER AS store, round(0.2::DOUBLE * pow(2, n - 1), 6) AS provider, n IN (1, 2, 4, 8, 16) OR n > 16 AND n % 16 = 0 AS ramp FROM range(1, 41) t(n)")
def retry_delays(s, d):
    n = F.col("id").cast("int")
    return s.range(1, 41).select(n.alias("n"), scoring.timer_delay(n).alias("timer"), scoring.embedding_delay(n).alias("embedding"), scoring.store_delay(n).alias("store"), F.round(scoring.provider_delay(n), 6).alias("provider"), scoring.ramp_turn(n).alias("ramp"))


FIRED = "f AS (SELECT *, (event_id % 10)::INTEGER AS attempts, CASE event_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'retry' WHEN 2 THEN 'dead' ELSE 'foreign' END AS outcome FROM events)"


def _fired(s, d):
    e = tables.read(s, d, "events")
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("completed", "retry", "dead", "foreign")]), (F.col("event_id") % 4 + 1).cast("int"))
    return e.select("event_id", F.lpad(F.col("event_id").cast("string"), 10, "0").alias("timer_id"), F.when(F.col("user_id") % 3 > 0, SPACE).alias("memory_space_id"), F.col("ts").cast("timestamp").alias("fire_at"), (F.col("event_id") % 10).cast("int").alias("attempts"), outcome.alias("outcome"), F.lit("boom").alias("error"), F.lit("scheduled").alias("status"))


@query("timer_outcomes", f"""WITH {FIRED}, x AS (SELECT *, CASE WHEN outcome = 'dead' OR attempts + 1 > 8 THEN 'dead' WHEN outcome = 'completed' THEN 'fired' ELSE 'scheduled' END AS new_status FROM f)
SELECT event_id, new_status, attempts + 1 AS new_attempts, CASE WHEN new_status = 'scheduled' THEN epoch_us(TIMESTAMP '2024-03-01') + 1000000 * (CASE WHEN outcome = 'foreign' THEN 600 ELSE least(900, 30 * pow(2, attempts))::INTEGER END) ELSE epoch_us(ts) END AS fire_us,
 CASE WHEN new_status = 'dead' THEN '[memory space ' || (CASE WHEN user_id % 3 > 0 THEN 'space_test' ELSE 'unknown' END) || '] boom' ELSE 'boom' END AS last_error FROM x""")
def timer_outcomes(s, d):
    return timers.apply_outcomes(_fired(s, d), F.lit(NOW)).select("event_id", "new_status", "new_attempts", F.unix_micros("new_fire_at").alias("fire_us"), "last_error")


@query("due_timers", "SELECT event_id, epoch_us(ts) AS fire_us FROM events WHERE ts <= TIMESTAMP '2024-01-10'")
def due_timers(s, d):
    return timers.due(_fired(s, d), F.lit(datetime(2024, 1, 10))).select("event_id", F.unix_micros("fire_at").alias("fire_us"))


@query("debounced_timers", "SELECT 'u' || (user_id % 20) AS timer_id, max(epoch_us(ts)) AS fire_us FROM events GROUP BY 1")
def debounced_timers(s, d):
    rows = _fired(s, d).join(tables.read(s, d, "events").select("event_id", "user_id"), "event_id").select(F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("timer_id"), "fire_at")
    return timers.schedule(rows).select("timer_id", F.unix_micros("fire_at").alias("fire_us"))


# ---- distillation (A, D, F-22 to F-25)


OWN_SESSION = "'k' || substr(session_id, 2)"


@query("evidence_text", f"""WITH {TURNS}, {MEM}, line AS (SELECT *, {OWN_SESSION} AS own, '- ' || memory_type || ': ' || content AS text FROM memories),
a AS (SELECT memory_space_id, session_id, 'turns' AS source, string_agg(turn_index || '. ' || role || ': ' || content, chr(10) ORDER BY turn_index) AS text FROM turns GROUP BY ALL),
b AS (SELECT memory_space_id, own AS session_id, 'session memories' AS source, string_agg(text, chr(10) ORDER BY created_at DESC, memory_id) AS text FROM line WHERE own IS NOT NULL GROUP BY ALL),
c AS (SELECT memory_space_id, concat_ws('/', 'scope', namespace, scope_kind, scope_ref) AS session_id, 'scope memories' AS source, string_agg(text, chr(10) ORDER BY priority, created_at DESC, memory_id) AS text FROM line WHERE status = 'active' GROUP BY ALL)
SELECT memory_space_id, session_id, source, sha256(text) AS text_sha256, length(text) AS n_chars FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)""")
def evidence_text(s, d):
    """Whole texts of all three sources."""
    found = distill.evidence(*_asked(s, d))
    return found.select("memory_space_id", "session_id", "source", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"))


def _asked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sessions with turns, sessions that have memories only, and one session without either for each scope."""
    m = tables.memories(s, d).withColumn("session_id", F.concat(F.lit("k"), F.expr("substr(session_id, 2)")))
    none = F.lit(None).cast("string")
    silent = m.filter("session_id IS NOT NULL").select("memory_space_id", "session_id", F.lit("none").alias("namespace"), none.alias("scope_kind"), none.alias("scope_ref")).distinct()
    asking = m.select("memory_space_id", F.concat_ws("/", F.lit("scope"), "namespace", "scope_kind", "scope_ref").alias("session_id"), "namespace", "scope_kind", "scope_ref").distinct()
    every = tables.sessions(s, d).select(*silent.columns).unionByName(silent).unionByName(asking)
    return tables.turns(s, d), m, every


@query("session_max_turn", f"WITH {TURNS} SELECT memory_space_id, session_id, greatest(max(turn_index), 0) AS max_turn FROM turns GROUP BY ALL")
def session_max_turn(s, d):
    return distill.max_turn(tables.turns(s, d))


@query("watermark_due", f"""WITH {TURNS}, {SES}, t AS (SELECT memory_space_id, session_id, max(turn_index) AS m FROM turns GROUP BY ALL), x AS (SELECT s.memory_space_id, s.session_id, coalesce(greatest(m, 0), 0) AS max_turn, CASE WHEN s.session_id LIKE '%1' THEN NULL ELSE 3 END AS last_turn_index FROM sessions s LEFT JOIN t USING (memory_space_id, session_id))
SELECT memory_space_id, session_id, max_turn, coalesce(last_turn_index, -1) AS last_turn_index FROM x WHERE last_turn_index IS NULL OR last_turn_index < max_turn""")
def watermark_due(s, d):
    ses = tables.sessions(s, d)
    return distill.uncovered(ses, tables.turns(s, d), ses.filter("session_id NOT LIKE '%1'").select("memory_space_id", "session_id", F.lit(3).alias("last_turn_index"))).withColumn("last_turn_index", F.coalesce("last_turn_index", F.lit(-1)))


@query("atom_validation", f"""WITH {MEM}, x AS (SELECT session_id AS extraction_id, memory_id, trim(CASE WHEN priority % 29 = 0 THEN '  ' ELSE ' ' || memory_id || ' ' END) AS content, lower(trim(' ' || upper(memory_type))) AS atom_type, CASE WHEN priority % 31 = 0 THEN 'certain' ELSE confidence END AS confidence, greatest(0, least(100, priority - 10)) AS priority FROM memories WHERE session_id IS NOT NULL),
y AS (SELECT *, CASE WHEN content = '' THEN 'atom content must be non-empty' WHEN confidence NOT IN ('high', 'medium', 'low') THEN 'confidence unknown' END AS error FROM x)
SELECT *, count(error) OVER (PARTITION BY extraction_id) AS bad_atoms, count(error) OVER (PARTITION BY extraction_id) = 0 AS accepted FROM y""")
def atom_validation(s, d):
    m = tables.memories(s, d).filter("session_id IS NOT NULL")
    atoms = m.select(F.col("session_id").alias("extraction_id"), "memory_id", F.when(F.col("priority") % 29 == 0, "  ").otherwise(F.concat(F.lit(" "), "memory_id", F.lit(" "))).alias("content"), F.concat(F.lit(" "), F.upper("memory_type")).alias("atom_type"), F.when(F.col("priority") % 31 == 0, "certain").otherwise(F.col("confidence")).alias("confidence"), (F.col("priority") - 10).alias("priority"))
    return distill.validate_atoms(atoms)


DEC = f"""WITH {TENS}, dec AS (SELECT memory_space_id, memory_id AS decision_id, memory_id AS own_id, status AS own_status, session_id, CASE priority % 4 WHEN 0 THEN 'skip' WHEN 1 THEN 'store' WHEN 2 THEN 'update' ELSE 'merge' END AS action,
 CASE WHEN priority % 5 = 0 THEN [memory_id] WHEN priority % 7 = 1 THEN []::VARCHAR[] WHEN priority % 5 = 1 THEN ['m_99999999'] WHEN priority % 5 = 2 THEN ['m_99999999', coalesce(superseded_by, supersedes, memory_id)] ELSE [coalesce(superseded_by, supersedes, 'm_99999998')] END AS targets FROM memories),
o AS (SELECT *, list_filter(targets, lambda t: t <> own_id) AS others FROM dec), u AS (SELECT decision_id, o.memory_space_id, unnest(others) AS t, generate_subscripts(others, 1) AS p FROM o),
live AS (SELECT u.decision_id, string_agg(t, ',' ORDER BY p) AS live_targets, count(*) AS n FROM u JOIN memories m ON m.memory_id = u.t AND m.memory_space_id = u.memory_space_id GROUP BY u.decision_id),
app AS (SELECT o.decision_id, session_id, coalesce(live_targets, '') AS live_targets, CASE WHEN action IN ('skip', 'store') THEN action WHEN len(targets) > 0 AND len(others) = 0 THEN 'skip' WHEN own_status <> 'active' THEN 'skip' WHEN coalesce(n, 0) = 0 THEN 'store' ELSE 'merge' END AS applied,
 CASE WHEN action IN ('skip', 'store') THEN NULL WHEN len(targets) > 0 AND len(others) = 0 THEN 'only target is itself' WHEN own_status <> 'active' THEN 'winner is not active' WHEN len(targets) = 0 THEN 'no target given' WHEN coalesce(n, 0) = 0 THEN 'no target exists' WHEN n < len(others) THEN 'some targets don''t exist' END AS note FROM o LEFT JOIN live USING (decision_id))"""


def _decisions(s, d):
    m = tables.memories(s, d, by_tens=True)
    p, other = F.col("priority"), F.coalesce("superseded_by", "supersedes")
    action = F.element_at(F.array(*[F.lit(x) for x in ("skip", "store", "update", "merge")]), p % 4 + 1)
    none = F.lit("m_99999999")
    targets = F.when(p % 5 == 0, F.array("memory_id")).when(p % 7 == 1, F.array().cast("array<string>")).when(p % 5 == 1, F.array(none)).when(p % 5 == 2, F.array(none, F.coalesce(other, "memory_id"))).otherwise(F.array(F.coalesce(other, F.lit("m_99999998"))))
    return distill.apply_decisions(m.select("memory_space_id", F.col("memory_id").alias("decision_id"), F.col("memory_id").alias("own_id"), "session_id", action.alias("action"), targets.alias("targets")), m)


@query("decision_verdict", f"{DEC} SELECT decision_id, CASE WHEN applied = 'merge' THEN live_targets ELSE '' END AS live_targets, applied, note FROM app")
def decision_verdict(s, d):
    return shown(_decisions(s, d).select("decision_id", "live_targets", "applied", "note"))


@query("decision_problems", f"""{DEC} SELECT decision_id, CASE WHEN action IN ('skip', 'store') THEN '' ELSE array_to_string(targets, ',') END AS targets,
 CASE WHEN action IN ('skip', 'store') THEN NULL WHEN len(targets) = 0 THEN action || ' requires at least one target' WHEN len(list_filter(targets, lambda t: NOT regexp_full_match(t, '([a-z]([a-z_]*[a-z])?_)?[0-7][0-9a-hjkmnp-tv-z]{{25}}'))) > 0 THEN 'a target is no id' END AS problem FROM dec""")
def decision_problems(s, d):
    return shown(distill.canonical_decision(_decisions(s, d).select("decision_id", "action", "targets")).select("decision_id", "targets", "problem"))


@query("pass_summary", f"{DEC} SELECT session_id, count(*) AS extracted, count(*) FILTER (applied = 'store') AS stored, count(*) FILTER (applied = 'merge') AS merged, count(*) FILTER (applied = 'skip') AS skipped FROM app GROUP BY session_id")
def pass_summary(s, d):
    return distill.summary(_decisions(s, d))


SRC = """src AS (SELECT memory_space_id, namespace, scope_kind, scope_ref, count(*) AS n, string_agg(memory_id, ',' ORDER BY priority, created_at DESC, memory_id) AS atom_ids, string_agg('- ' || memory_id || ' (' || memory_type || ', ' || confidence || '): ' || content, chr(10) ORDER BY priority, created_at DESC, memory_id) AS text FROM memories WHERE status = 'active' GROUP BY ALL)"""


@query("scene_sources", f"WITH {MEM}, {SRC} SELECT memory_space_id, namespace, scope_kind, scope_ref, atom_ids, sha256(text) AS text_sha256 FROM src")
def scene_sources(s, d):
    return shown(distill.scene_sources(tables.memories(s, d)).select(*distill.SCOPE, "atom_ids", F.sha2("text", 256).alias("text_sha256")))


def _stored_scenes(s, d):
    """Scenes as an earlier run may have left them: some current, some stale, some of scopes without memories."""
    src = distill.scene_sources(tables.memories(s, d))
    has = src.filter("namespace <> 'de'").select(*distill.SCOPE, F.when(F.col("scope_ref").endswith("1"), "stale").otherwise(F.col("hash")).alias("source_hash"))
    return has.unionByName(has.filter("namespace = 'en'").withColumns({"namespace": F.lit("gone"), "source_hash": F.lit("old")}))


@query("scene_actions", f"""WITH {MEM}, {SRC}, st AS (SELECT memory_space_id, namespace, scope_kind, scope_ref, scope_ref LIKE '%1' AS stale FROM src WHERE namespace <> 'de'),
x AS (SELECT src.memory_space_id, src.namespace, src.scope_kind, src.scope_ref, CASE WHEN st.namespace IS NOT NULL AND NOT coalesce(st.stale, false) THEN 'keep' ELSE 'regenerate' END AS action FROM src LEFT JOIN st ON src.memory_space_id = st.memory_space_id AND src.namespace = st.namespace AND src.scope_ref IS NOT DISTINCT FROM st.scope_ref)
SELECT * FROM x UNION ALL SELECT memory_space_id, 'gone', scope_kind, scope_ref, 'delete' FROM st WHERE namespace = 'en'""")
def scene_actions(s, d):
    return distill.scene_actions(tables.memories(s, d), _stored_scenes(s, d)).select(*distill.SCOPE, "action")


@query("persona_actions", f"""WITH {MEM}, {SRC}, sc AS (SELECT memory_space_id, namespace, scope_kind, scope_ref, n FROM src) SELECT memory_space_id, namespace, scope_kind, scope_ref, CASE WHEN scope_ref LIKE '%2' THEN 'keep' ELSE 'regenerate' END AS action, 1 AS scene_count FROM sc""")
def persona_actions(s, d):
    src = distill.scene_sources(tables.memories(s, d))
    scenes = src.select(*distill.SCOPE, F.lit("default").alias("scene_key"), identity.scene_id(F.col("namespace"), F.col("scope_kind"), F.col("scope_ref")).alias("scene_id"), F.lit("Title").alias("title"), F.col("text").alias("body_md"), F.lit(NOW).alias("updated_at"))
    stored = distill.persona_sources(scenes).select(*distill.SCOPE, F.when(F.col("scope_ref").endswith("2"), F.col("hash")).otherwise("stale").alias("source_hash"))
    return distill.persona_actions(scenes, stored).select(*distill.SCOPE, "action", "scene_count")


def _leaf_sql(*fields: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(({f})::VARCHAR))::VARCHAR || ':' || ({f})::VARCHAR, '-')" for f in fields) + ")"


def _tree_sql(rows: str, key: str) -> str:
    """rows: a table of key, pos, d. The digest of each group of it, as operators.ordered defines it."""
    levels = [f"t0 AS (SELECT {key}, pos AS a, d, 1 AS n FROM {rows})"]
    levels += [f"t{i + 1} AS (SELECT {key}, a // {ordered.PIECE} AS a, sha256(string_agg(d, '' ORDER BY a)) AS d, sum(n)::BIGINT AS n FROM t{i} GROUP BY {key}, a // {ordered.PIECE})" for i in range(ordered.LEVELS)]
    return ", ".join(levels) + f" SELECT {key}, n, 'v2:' || sha256(n || ':' || d) AS hash FROM t{ordered.LEVELS}"


KEY = "memory_space_id, namespace, scope_kind, scope_ref"
ATOM = "'- ' || memory_id || ' (' || memory_type || ', ' || confidence || '): ' || content"
BY_SCOPE = f"(PARTITION BY {KEY} ORDER BY priority, memories.created_at DESC, memory_id"


@query("source_hash", f"WITH {MEM}, leaves AS (SELECT {KEY}, row_number() OVER {BY_SCOPE}) - 1 AS pos, {_leaf_sql('memory_id', 'content', 'priority', 'confidence', 'epoch_us(memories.created_at)')} AS d FROM memories WHERE status = 'active'), {_tree_sql('leaves', KEY)}")
def source_hash(s, d):
    return distill.source_hashes(distill.scene_lines(tables.memories(s, d)))


@query("scene_lines", f"WITH {MEM} SELECT {KEY}, row_number() OVER {BY_SCOPE}) - 1 AS position, coalesce(sum(length({ATOM}) + 1) OVER {BY_SCOPE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, memory_id, sha256({ATOM}) AS line_sha256 FROM memories WHERE status = 'active'")
def scene_lines(s, d):
    return distill.scene_lines(tables.memories(s, d)).select(*distill.SCOPE, "position", "start", "memory_id", F.sha2("line", 256).alias("line_sha256"))


@query("scene_budget", f"WITH {MEM}, x AS (SELECT {KEY}, memory_id, length({ATOM}) AS n, sum(length({ATOM}) + 1) OVER {BY_SCOPE}) - 1 AS upto FROM memories WHERE status = 'active') SELECT {KEY}, count(*) AS lines, sum(n)::BIGINT AS characters FROM x WHERE upto <= 200000 GROUP BY ALL")
def scene_budget(s, d):
    """What of each scope a model with so many characters reads."""
    kept = ordered.within(distill.scene_lines(tables.memories(s, d)), F.length("line"), 200_000)
    return kept.groupBy(*distill.SCOPE).agg(F.count("*").alias("lines"), F.sum(F.length("line").cast("long")).alias("characters"))


@query("evidence_lines", f"""WITH {TURNS}, {MEM}, line AS (SELECT *, {OWN_SESSION} AS own, '- ' || memory_type || ': ' || content AS text FROM memories),
a AS (SELECT memory_space_id, session_id, 'turns' AS source, turn_index || '. ' || role || ': ' || content AS text, row_number() OVER (PARTITION BY memory_space_id, session_id ORDER BY turn_index) AS k FROM turns),
b AS (SELECT memory_space_id, own AS session_id, 'session memories' AS source, text, row_number() OVER (PARTITION BY memory_space_id, own ORDER BY line.created_at DESC, memory_id) AS k FROM line WHERE own IS NOT NULL),
c AS (SELECT memory_space_id, concat_ws('/', 'scope', namespace, scope_kind, scope_ref) AS session_id, 'scope memories' AS source, text, row_number() OVER (PARTITION BY {KEY} ORDER BY priority, line.created_at DESC, memory_id) AS k FROM line WHERE status = 'active'),
e AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
SELECT memory_space_id, session_id, source, k - 1 AS position, coalesce(sum(length(text) + 1) OVER (PARTITION BY memory_space_id, session_id, source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, sha256(text) AS line_sha256 FROM e""")
def evidence_lines(s, d):
    """The evidence of evidence_text as rows."""
    turns, m, every = _asked(s, d)
    return distill.evidence_lines(turns, m, every).select("memory_space_id", "session_id", "source", "position", "start", F.sha2("line", 256).alias("line_sha256"))


@query("scene_sink", f"WITH {MEM}, {SRC} SELECT memory_space_id, namespace, scope_kind, scope_ref, 'of ' || length(text) AS title, sha256(text) AS body_md, n AS n_atoms, CASE WHEN namespace = 'de' OR scope_ref LIKE '%1' THEN 'new' ELSE 'old' END AS written FROM src")
def scene_sink(s, d):
    """The stored table once actions were applied to it twice: what is stale or missing is new, what is of no scope any more is gone."""
    root, m, old = shared.folder(s, "scene-sink"), tables.memories(s, d), _stored_scenes(s, d)
    src = distill.scene_sources(m)
    same = [src[c].eqNullSafe(old[c]) for c in distill.SCOPE]
    own = identity.scene_id(F.col("namespace"), F.col("scope_kind"), F.col("scope_ref"))
    first, text = F.lit(SINCE), F.coalesce(src["text"], F.lit("gone"))
    held = old.join(src, same, "left").select(*[old[c] for c in distill.SCOPE], old["source_hash"], F.concat(F.lit("of "), F.length(text).cast("string")).alias("title"), F.sha2(text, 256).alias("body_md"), F.coalesce("atom_ids", F.array().cast("array<string>")).alias("atom_ids"))
    store.save(held.withColumns({"scene_id": own, "scene_key": F.lit("default"), "created_at": first, "updated_at": first}).select(*schema.SCENES.names), root, "scenes")
    for _ in range(2):
        distill.sink_scenes(root, distill.scene_actions(m, store.load(s, root, "scenes")), lambda t: (f"of {len(t)}", hashlib.sha256(t.encode()).hexdigest()), NOW)
    return store.load(s, root, "scenes").select(*distill.SCOPE, "title", "body_md", F.size("atom_ids").cast("long").alias("n_atoms"), F.when(F.col("updated_at") == F.lit(NOW), "new").otherwise("old").alias("written"))


@query("distill_pass", f"""WITH {TURNS}, e AS (SELECT session_id, sha256(string_agg(turn_index || '. ' || role || ': ' || content, chr(10) ORDER BY turn_index)) AS atom, greatest(max(turn_index), 0) AS last_turn_index FROM turns WHERE memory_space_id = '{SPACE}' GROUP BY session_id)
SELECT session_id, atom AS candidate_content, CASE WHEN substr(atom, 1, 1) < '8' THEN 'store' ELSE 'skip' END AS decision, last_turn_index, CASE WHEN substr(atom, 1, 1) < '8' THEN 1 ELSE 0 END AS memories FROM e""")
def distill_pass(s, d):
    """The runner over stored tables, with a model whose one atom is a digest of the evidence: audit, watermark and memory of every session, once the pass has run twice."""
    root = shared.folder(s, "distill-pass")
    for name, df in (("sessions", _sessions(s, d)), ("turns", tables.turns(s, d)), ("memories", tables.memories(s, d).withColumn("session_id", F.lit(None).cast("string")))):
        missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.TABLES[name] if f.name not in df.columns}
        store.save(df.withColumns(missing).select(*[F.col(f.name).cast(f.dataType) for f in schema.TABLES[name]]), root, name)
    atom = lambda t: [{"content": hashlib.sha256(t.encode()).hexdigest()}]
    models = distill.Models(atom, lambda a, shown: {"action": "store" if a["content"][0] < "8" else "skip", "targets": ["stray"]})
    context = Context(SPACE, "bench", frozenset({"distill", "record", "forget"}))
    for force in (False, True):
        passes.distill_sessions(s, root, context, models, NOW, force=force)
    audit = store.load(s, root, "consolidation_decisions").select("session_id", "candidate_content", "decision", "result_memory_id")
    marks = store.load(s, root, "l1_watermarks").select("session_id", "last_turn_index")
    made = store.load(s, root, "memories").filter(F.array_contains("tags", "distilled")).groupBy(F.col("memory_id").alias("result_memory_id")).count()
    told = audit.join(marks, "session_id").join(made, "result_memory_id", "left")
    return told.select("session_id", "candidate_content", "decision", "last_turn_index", F.coalesce("count", F.lit(0)).cast("int").alias("memories"))


# ---- reads of what distillation keeps (S, ST)

SCENES = f"{MEM}, scenes AS (SELECT memory_space_id, namespace, scope_kind, scope_ref, memory_type AS scene_key, memory_id AS scene_id, agent_id AS title, content AS body_md, updated_at FROM memories WHERE status = 'active')"
HERE = f"memory_space_id = '{SPACE}' AND namespace = '{NS}' AND {ENTITY}"
PERSONAS = f"{SCENES}, personas AS (SELECT memory_space_id, namespace, scope_kind, scope_ref, max(scene_id) AS persona_id, arg_max(body_md, scene_id) AS body_md FROM scenes GROUP BY ALL)"


def _scenes(s: SparkSession, d: str) -> DataFrame:
    """Every active memory as a scene keyed by its type."""
    m = tables.memories(s, d).filter("status = 'active'")
    return m.select(*distill.SCOPE, F.col("memory_type").alias("scene_key"), F.col("memory_id").alias("scene_id"), F.col("agent_id").alias("title"), F.col("content").alias("body_md"), "updated_at")


@query("watermark_read", f"WITH {TURNS} SELECT greatest(max(turn_index), 0) AS last_turn_index FROM turns WHERE memory_space_id = '{SPACE}' AND session_id = 's_00000003' GROUP BY session_id")
def watermark_read(s, d):
    return reads.watermark(distill.max_turn(tables.turns(s, d)).withColumnRenamed("max_turn", "last_turn_index"), SPACE, "s_00000003")


@query("scenes_by_scope", f"WITH {SCENES} SELECT * REPLACE (strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at) FROM scenes WHERE {HERE}")
def scenes_by_scope(s, d):
    return shown(reads.scenes_by_scope(_scenes(s, d), SPACE, SCOPE))


@query("scene_by_key", f"WITH {SCENES} SELECT * REPLACE (strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS updated_at) FROM scenes WHERE {HERE} AND scene_key = 'constraint'")
def scene_by_key(s, d):
    return shown(reads.scene_by_key(_scenes(s, d), SPACE, SCOPE, "constraint"))


@query("persona_by_scope", f"WITH {PERSONAS} SELECT * FROM personas WHERE {HERE}")
def persona_by_scope(s, d):
    personas = _scenes(s, d).groupBy(*distill.SCOPE).agg(F.max("scene_id").alias("persona_id"), F.max_by("body_md", "scene_id").alias("body_md"))
    return reads.persona_by_scope(personas, SPACE, SCOPE)


@query("persona_scenes", f"WITH {SCENES} SELECT scene_id, title, body_md, {at('updated_at')} FROM scenes WHERE {HERE}")
def persona_scenes(s, d):
    return shown(reads.persona_scenes(_scenes(s, d), SPACE, SCOPE))


@query("persona_timers", f"""WITH {SCENES}, x AS (SELECT memory_space_id, namespace AS ns, scope_kind, scope_ref AS ref, updated_at + INTERVAL 5 SECOND AS fire FROM scenes), y AS (SELECT memory_space_id || ':' || {IDENT} AS correlation_id, fire FROM x),
h AS (SELECT correlation_id, fire, sha1(unhex('{identity.PERSONA_TIMERS.hex}') || encode('l3-persona:' || correlation_id || ':' || strftime(fire, '%Y-%m-%d %H:%M:%S'))) AS a FROM y)
SELECT {UUID.format('a')} AS timer_id, correlation_id, epoch_us(fire) AS fire_us FROM h""")
def persona_timers(s, d):
    changes = _scenes(s, d).withColumnRenamed("updated_at", "at")
    return timers.persona_timers(changes).select("timer_id", "correlation_id", F.unix_micros("fire_at").alias("fire_us"))


# ---- maintenance (M, J, P, A)


@query("space_backfill", f"WITH {TURNS}, {SES} SELECT t.turn_id, coalesce(CASE WHEN t.turn_index % 3 = 0 THEN NULL ELSE t.memory_space_id END, s.memory_space_id, 'mnemo_legacy') AS memory_space_id FROM turns t LEFT JOIN (SELECT * FROM sessions WHERE session_id NOT LIKE '%4') s ON s.session_id = t.session_id")
def space_backfill(s, d):
    t = tables.turns(s, d).withColumn("memory_space_id", F.when(F.col("turn_index") % 3 != 0, F.col("memory_space_id")))
    return maintenance.inherit_space(t, tables.sessions(s, d).filter("session_id NOT LIKE '%4'")).select("turn_id", "memory_space_id")


@query("drift_check", f"WITH {TURNS}, {SES}, x AS (SELECT turn_id, session_id, CASE WHEN turn_index % 5 = 2 THEN 'space_moved' ELSE memory_space_id END AS memory_space_id FROM turns) SELECT x.turn_id, x.memory_space_id, s.memory_space_id AS session_space FROM x JOIN sessions s USING (session_id) WHERE x.memory_space_id IS DISTINCT FROM s.memory_space_id")
def drift_check(s, d):
    t = tables.turns(s, d).withColumn("memory_space_id", F.when(F.col("turn_index") % 5 == 2, "space_moved").otherwise(F.col("memory_space_id")))
    return maintenance.space_drift(t, tables.sessions(s, d)).select("turn_id", "memory_space_id", "session_space")


@query("unattributed_count", f"WITH {MEM}, {TURNS} SELECT ((SELECT count(*) FROM memories WHERE priority % 13 = 0) + (SELECT count(*) FROM turns WHERE turn_index = 2))::BIGINT AS n")
def unattributed_count(s, d):
    m = tables.memories(s, d).withColumn("memory_space_id", F.when(F.col("priority") % 13 != 0, F.col("memory_space_id")))
    t = tables.turns(s, d).withColumn("memory_space_id", F.when(F.col("turn_index") == 2, "").otherwise(F.col("memory_space_id")))
    return maintenance.unattributed({"memories": m, "turns": t})


@query("dedupe_keep_newest", f"WITH {MEM} SELECT namespace, scope_kind, scope_ref, memory_id, strftime(max_at, '%Y-%m-%d %H:%M:%S') AS updated_at FROM (SELECT namespace, scope_kind, scope_ref, arg_max(memory_id, (memories.updated_at, memory_id)) AS memory_id, max(memories.updated_at) AS max_at FROM memories GROUP BY namespace, scope_kind, scope_ref)")
def dedupe_keep_newest(s, d):
    m = tables.memories(s, d).select("namespace", "scope_kind", "scope_ref", "memory_id", "updated_at")
    return shown(maintenance.keep_newest(m, ["namespace", "scope_kind", "scope_ref"], ["updated_at", "memory_id"]))


@query("ids_recomputed", f"WITH {MEM}, x AS (SELECT memory_id, namespace AS ns, scope_kind, CASE WHEN priority % 7 = 0 THEN scope_ref || '/x' ELSE scope_ref END AS ref FROM memories) SELECT memory_id, CASE WHEN coalesce(regexp_matches(concat(ns, scope_kind, ref), '[%/:]'), false) THEN 'mnemo_persona:' || {IDENT} ELSE 'old' END AS persona_id FROM x")
def ids_recomputed(s, d):
    m = tables.memories(s, d).withColumns({"scope_ref": F.when(F.col("priority") % 7 == 0, F.concat("scope_ref", F.lit("/x"))).otherwise(F.col("scope_ref")), "persona_id": F.lit("old")})
    return maintenance.recomputed_ids(m, "persona_id", identity.persona_id).select("memory_id", "persona_id")


@query("scope_repair", f"WITH {MEM}, x AS (SELECT memory_id, scope_kind, CASE WHEN priority % 7 = 0 THEN NULL ELSE scope_ref END AS scope_ref FROM memories) SELECT memory_id, CASE WHEN (scope_kind IS NULL) = (scope_ref IS NULL) THEN scope_kind END AS scope_kind, CASE WHEN (scope_kind IS NULL) = (scope_ref IS NULL) THEN scope_ref END AS scope_ref FROM x")
def scope_repair(s, d):
    m = tables.memories(s, d).withColumn("scope_ref", F.when(F.col("priority") % 7 != 0, F.col("scope_ref")))
    return predicates.whole_scope(m).select("memory_id", "scope_kind", "scope_ref")


@query("constraint_violations", f"""WITH {TURNS}, x AS (SELECT CASE WHEN turn_index = 1 THEN '' ELSE memory_space_id END AS memory_space_id, CASE WHEN turn_index = 3 THEN session_id ELSE turn_id END AS turn_id, session_id, turn_index % 4 AS turn_index, role, content, recorded_at FROM turns)
SELECT 'blank_space' AS violation, count(*) AS n FROM x WHERE memory_space_id = '' UNION ALL SELECT 'unique_turn_id', coalesce(sum(c - 1), 0)::BIGINT FROM (SELECT count(*) AS c FROM x GROUP BY turn_id HAVING count(*) > 1) UNION ALL SELECT 'unique_session_id_turn_index', coalesce(sum(c - 1), 0)::BIGINT FROM (SELECT count(*) AS c FROM x GROUP BY session_id, turn_index HAVING count(*) > 1) UNION ALL SELECT 'null_turn_id', count(*) FROM x WHERE turn_id IS NULL UNION ALL SELECT 'null_session_id', count(*) FROM x WHERE session_id IS NULL UNION ALL SELECT 'null_turn_index', count(*) FROM x WHERE turn_index IS NULL UNION ALL SELECT 'null_role', count(*) FROM x WHERE role IS NULL UNION ALL SELECT 'null_content', count(*) FROM x WHERE content IS NULL UNION ALL SELECT 'null_recorded_at', count(*) FROM x WHERE recorded_at IS NULL""")
def constraint_violations(s, d):
    t = tables.turns(s, d).withColumns({"memory_space_id": F.when(F.col("turn_index") == 1, "").otherwise(F.col("memory_space_id")), "turn_id": F.when(F.col("turn_index") == 3, F.col("session_id")).otherwise(F.col("turn_id")), "turn_index": F.col("turn_index") % 4})
    return schema.violations(t, "turns")


def _violations_sql(table: str, rows: str, columns: list[str]) -> str:
    """What schema.violations tells, for a table with these columns."""
    parts = ["SELECT 'blank_space' AS violation, count(*) AS n FROM x WHERE memory_space_id = '' OR memory_space_id IS NULL"]
    if "scope_kind" in columns:
        parts.append("SELECT 'half_scope', count(*) FROM x WHERE (scope_kind IS NULL) <> (scope_ref IS NULL)")
    parts += [f"SELECT 'null_{f.name}', count(*) FROM x WHERE {f.name} IS NULL" for f in schema.TABLES[table] if not f.nullable and f.name in columns and f.name != "memory_space_id"]
    parts += [f"SELECT 'unique_{'_'.join(k)}', coalesce(sum(c - 1), 0)::BIGINT FROM (SELECT count(*) AS c FROM x GROUP BY {', '.join(k)} HAVING count(*) > 1)" for k in schema.KEYS[table]]
    return f"{rows} {' UNION ALL '.join(parts)}"


_MEMCOLS = [c for c in schema.MEMORIES.names if c not in ("embedding", "embedding_model", "dimensions")]


@query("memory_constraints", _violations_sql("memories", f"WITH {MEM}, x AS (SELECT * REPLACE (CASE WHEN priority % 13 = 0 THEN 'm_x' ELSE memory_id END AS memory_id, CASE WHEN priority % 11 = 0 THEN NULL ELSE content END AS content, CASE WHEN priority % 7 = 0 THEN NULL ELSE scope_ref END AS scope_ref, CASE WHEN priority = 3 THEN '' ELSE memory_space_id END AS memory_space_id) FROM memories)", _MEMCOLS))
def memory_constraints(s, d):
    m, p = tables.memories(s, d), F.col("priority")
    bent = {"memory_id": F.when(p % 13 == 0, "m_x").otherwise(F.col("memory_id")), "content": F.when(p % 11 != 0, F.col("content")), "scope_ref": F.when(p % 7 != 0, F.col("scope_ref")), "memory_space_id": F.when(p == 3, "").otherwise(F.col("memory_space_id"))}
    return schema.violations(m.withColumns(bent), "memories")


_SESCOLS = "memory_space_id session_id agent_id focus namespace scope_kind scope_ref previous_session_id parent_session_id delegation_depth status awaiting_correlation_key started_at".split()


@query("session_constraints", _violations_sql("sessions", f"WITH {SES}, x AS (SELECT * REPLACE (CASE WHEN focus = 'focus_1' THEN NULL ELSE agent_id END AS agent_id, CASE WHEN focus = 'focus_2' THEN 's_x' ELSE session_id END AS session_id) FROM sessions)", _SESCOLS))
def session_constraints(s, d):
    focus = F.col("focus")
    bent = {"agent_id": F.when(focus != "focus_1", F.col("agent_id")), "session_id": F.when(focus == "focus_2", "s_x").otherwise(F.col("session_id"))}
    return schema.violations(_sessions(s, d).withColumns(bent), "sessions")


@query("import_preconditions", f"""WITH {TURNS}, {SES}, {MEM}, a AS (SELECT count(*) = 2 AS two_spaces FROM (SELECT memory_space_id FROM memories GROUP BY 1)), b AS (SELECT count(*) = 7 AS seven_agents FROM (SELECT agent_id FROM memories GROUP BY 1)),
c AS (SELECT NOT EXISTS (SELECT 1 FROM (SELECT memory_space_id, session_id FROM turns GROUP BY 1, 2) t LEFT JOIN sessions USING (memory_space_id, session_id) WHERE sessions.session_id IS NULL) AS turns_have_sessions),
d AS (SELECT NOT EXISTS (SELECT 1 FROM (SELECT memory_space_id, session_id FROM turns GROUP BY 1, 2) t LEFT JOIN (SELECT * FROM sessions WHERE status <> 'failed') s USING (memory_space_id, session_id) WHERE s.session_id IS NULL) AS turns_have_sound_sessions)
SELECT *, two_spaces AND seven_agents AND turns_have_sessions AND turns_have_sound_sessions AS holds FROM a, b, c, d""")
def import_preconditions(s, d):
    m, t, ses = tables.memories(s, d), tables.turns(s, d), tables.sessions(s, d)
    key = ["memory_space_id", "session_id"]
    return maintenance.preconditions(
        {"two_spaces": (m.select("memory_space_id").distinct(), 2), "seven_agents": (m.select("agent_id").distinct(), 7)},
        {"turns_have_sessions": (t, ses, key), "turns_have_sound_sessions": (t, ses.filter("status <> 'failed'"), key)},
    )


_FOCI = ["FocusWeeklyReflection", "FocusNoteHelp", "FocusElsewhere"]


@query("event_decode", f"""WITH {LOG}, x AS (SELECT event_id, k, version FROM log)
SELECT event_id, CASE k % 5 WHEN 0 THEN 'memory_recorded' WHEN 1 THEN 'memory_recorded' WHEN 2 THEN 'session_started' END AS kind, CASE k % 5 WHEN 0 THEN 'space_' || (k % 3) ELSE '{identity.LEGACY_SPACE}' END AS memory_space_id,
 CASE k % 5 WHEN 0 THEN 'n' WHEN 1 THEN 'legacy' WHEN 2 THEN 'legacy' END AS namespace, CASE k % 5 WHEN 0 THEN 'repo' WHEN 1 THEN 'habit' END AS scope_kind, CASE k % 5 WHEN 0 THEN 'r' || k WHEN 1 THEN 'h' || k END AS scope_ref,
 CASE WHEN k % 5 = 2 THEN CASE version % 3 WHEN 0 THEN 'weekly_reflection' WHEN 1 THEN 'note_help' ELSE 'FocusElsewhere' END END AS focus, CASE k % 5 WHEN 0 THEN k::VARCHAR WHEN 1 THEN '100' END AS priority, CASE k % 5 WHEN 3 THEN 'unknown type' WHEN 4 THEN 'no type' END AS malformed FROM x""")
def event_decode(s, d):
    """Payloads of the present and the older form, unknown ones and broken ones, decoded."""
    e, k = tables.event_log(s, d), F.col("k")
    at, text = F.lit("2024-01-01T00:00:00Z").alias("recordedAt"), k.cast("string")
    told = lambda kind, *fields: F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*fields).alias("data")))
    scope = F.struct(F.lit("ScopeEntity").alias("tag"), F.array(F.lit("n"), F.lit("repo"), F.concat(F.lit("r"), text)).alias("contents")).alias("scope")
    common = [F.col("stream_id").alias("memoryId"), F.lit("bob").alias("agentId"), F.lit("fact").alias("memoryType"), F.lit("c").alias("content"), F.lit("high").alias("confidence"), F.array(F.lit("t")).alias("tags"), at]
    native = told("memory_recorded", *common, F.concat(F.lit("space_"), (k % 3).cast("string")).alias("memorySpaceId"), scope, k.alias("priority"))
    older = told("agent_memory_recorded", *common, F.struct(F.lit("habit").alias("type"), F.concat(F.lit("h"), text).alias("id")).alias("anchor"))
    focus = F.element_at(F.array(*map(F.lit, _FOCI)), (F.col("version") % 3 + 1).cast("int"))
    session = told("agent_session_started", F.col("stream_id").alias("sessionId"), F.lit("bob").alias("agentId"), focus.alias("focusType"), F.lit("2024-01-01T00:00:00Z").alias("startedAt"))
    data = F.when(k % 5 == 0, native).when(k % 5 == 1, older).when(k % 5 == 2, session).when(k % 5 == 3, told("unheard_of", F.lit("m").alias("memoryId"))).otherwise("{not json")
    decoded = events.decode(e.select("event_id", "stream_id", "version", data.alias("data")))
    return decoded.select("event_id", "kind", "memory_space_id", "namespace", "scope_kind", "scope_ref", "focus", F.col("priority").cast("string").alias("priority"), "malformed")


@query("orphan_anti_join", f"WITH {TURNS}, {SES} SELECT turn_id FROM turns t WHERE NOT EXISTS (SELECT 1 FROM sessions s WHERE s.session_id = t.session_id AND s.memory_space_id = t.memory_space_id AND s.status <> 'failed')")
def orphan_anti_join(s, d):
    return maintenance.orphans(tables.turns(s, d), tables.sessions(s, d).filter("status <> 'failed'"), {"session_id": "session_id", "memory_space_id": "memory_space_id"}).select("turn_id")


@query("existing_targets", f"WITH {TENS} SELECT superseded_by AS memory_id, memory_id AS source FROM memories m WHERE superseded_by IN (SELECT memory_id FROM memories WHERE memory_space_id = '{SPACE}')")
def existing_targets(s, d):
    m = tables.memories(s, d, by_tens=True)
    ids = m.filter("superseded_by IS NOT NULL").select(F.col("superseded_by").alias("memory_id"), F.col("memory_id").alias("source"))
    return lineage.existing(ids, m, SPACE)


def _registry(s, d):
    """Read models named after users, as an old registry has them."""
    u = tables.read(s, d, "customer").select(F.col("c_custkey").alias("k"))
    expected = u.select(F.concat(F.lit("model_"), F.col("k").cast("string")).alias("name"), F.lit(3).alias("version"), F.lit("s").alias("shape"))
    stored = u.filter("k % 4 <> 0").select(F.concat(F.lit("model_"), F.col("k").cast("string")).alias("name"), F.when(F.col("k") % 5 == 0, 2).otherwise(3).alias("version"), F.when(F.col("k") % 7 == 0, "t").otherwise("s").alias("shape"), F.lit("live").alias("status"))
    return expected, stored


@query("registry_check", "SELECT 'model_' || c_custkey AS name, CASE WHEN c_custkey % 4 = 0 THEN 'registered' WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 'reconciled' ELSE 'current' END AS outcome FROM customer")
def registry_check(s, d):
    return maintenance.reconcile(*_registry(s, d))


@query("registry_complete", "SELECT count(*) = 3 AS complete, bool_and(CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 3 END = 3) AS all_live FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey IN (1, 2, 5)")
def registry_complete(s, d):
    return maintenance.registry_complete(_registry(s, d)[1], ["model_1", "model_2", "model_5"], 3)


# ---- idempotency and state machines (F-32, F-33, ST-14 to ST-16)


@query("command_verdicts", f"""WITH {MEM}, c AS (SELECT memory_space_id, memory_id, CASE WHEN priority % 4 = 1 THEN content || '?' ELSE content END AS content, CASE WHEN priority % 4 = 2 THEN 'low' ELSE confidence END AS confidence FROM memories), m AS (SELECT * FROM memories WHERE priority % 5 <> 0)
SELECT c.memory_id, CASE WHEN m.memory_id IS NULL THEN 'run' WHEN c.content IS NOT DISTINCT FROM m.content AND c.confidence = m.confidence THEN 'duplicate' ELSE 'conflict' END AS verdict, CASE WHEN m.memory_id IS NULL THEN NULL WHEN c.content IS DISTINCT FROM m.content THEN 'content' WHEN c.confidence <> m.confidence THEN 'confidence' END AS field
FROM c LEFT JOIN m ON c.memory_id = m.memory_id AND c.memory_space_id = m.memory_space_id""")
def command_verdicts(s, d):
    m = tables.memories(s, d)
    p = F.col("priority") % 4
    c = m.select("memory_space_id", "memory_id", F.when(p == 1, F.concat("content", F.lit("?"))).otherwise(F.col("content")).alias("content"), F.when(p == 2, "low").otherwise(F.col("confidence")).alias("confidence"))
    return verdicts.record_verdicts(c, m.filter("priority % 5 <> 0"), ("content", "confidence")).select("memory_id", "verdict", "field")


@query("end_verdicts", f"""WITH {MEM}, c AS (SELECT memory_space_id, memory_id, CASE priority % 3 WHEN 0 THEN 'supersede' WHEN 1 THEN 'merge' ELSE 'archive' END AS action, CASE WHEN priority % 2 = 0 THEN superseded_by ELSE 'm_x' END AS by_ FROM memories)
SELECT c.memory_id, c.action, CASE WHEN m.status = 'active' THEN 'run' WHEN (action = 'archive' AND m.status = 'archived') OR (((action = 'supersede' AND m.status = 'superseded') OR (action = 'merge' AND m.status = 'merged')) AND by_ IS NOT DISTINCT FROM m.superseded_by) THEN 'duplicate' ELSE 'conflict' END AS verdict FROM c JOIN memories m USING (memory_space_id, memory_id)""")
def end_verdicts(s, d):
    m = tables.memories(s, d)
    action = F.element_at(F.array(*[F.lit(x) for x in ("supersede", "merge", "archive")]), F.col("priority") % 3 + 1)
    c = m.select("memory_space_id", "memory_id", action.alias("action"), F.when(F.col("priority") % 2 == 0, F.col("superseded_by")).otherwise("m_x").alias("by"))
    return verdicts.end_verdicts(c, m).select("memory_id", "action", "verdict")


@query("change_verdicts", f"WITH {MEM} SELECT memory_id, CASE WHEN status <> 'active' THEN 'not active' WHEN (CASE WHEN priority % 2 = 0 THEN confidence ELSE 'high' END) = confidence THEN 'unchanged' ELSE 'run' END AS verdict FROM memories")
def change_verdicts(s, d):
    m = tables.memories(s, d)
    c = m.select("memory_space_id", "memory_id", F.when(F.col("priority") % 2 == 0, F.col("confidence")).otherwise("high").alias("confidence"))
    return verdicts.change_verdicts(c, m, "confidence").select("memory_id", "verdict")


@query("turn_verdicts", f"""WITH {TURNS}, c AS (SELECT memory_space_id, session_id, turn_id, CASE WHEN turn_index % 4 = 3 THEN turn_index + 100 ELSE turn_index END AS turn_index, CASE WHEN turn_index % 4 = 1 THEN content || '!' ELSE content END AS content FROM turns)
SELECT c.turn_id, c.turn_index, CASE WHEN h.turn_id IS NOT NULL AND h.content = c.content THEN 'duplicate' WHEN h.turn_id IS NOT NULL OR u.turn_id IS NOT NULL THEN 'conflict' ELSE 'run' END AS verdict
FROM c LEFT JOIN (SELECT * FROM turns WHERE turn_index < 5) h ON c.session_id = h.session_id AND c.turn_index = h.turn_index LEFT JOIN (SELECT * FROM turns WHERE turn_index < 5) u ON u.turn_id = c.turn_id""")
def turn_verdicts(s, d):
    t = tables.turns(s, d)
    k = F.col("turn_index") % 4
    c = t.withColumns({"content": F.when(k == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content")), "turn_index": F.when(k == 3, F.col("turn_index") + 100).otherwise(F.col("turn_index"))})
    return verdicts.turn_verdicts(c, t.filter("turn_index < 5")).select("turn_id", "turn_index", "verdict")


@query("session_verdicts", f"""WITH {SES}, c AS (SELECT session_id, unnest(['complete', 'fail', 'await', 'resume']) AS action, focus = 'focus_3' AS force, focus AS said, CASE WHEN focus = 'focus_1' THEN 'key_x' ELSE awaiting_correlation_key END AS key FROM sessions),
r AS (SELECT session_id, status, CASE WHEN agent_id = 'agent_0' THEN 'other' ELSE focus END AS said, awaiting_correlation_key AS key FROM sessions WHERE delegation_depth = 0)
SELECT c.session_id, c.action, CASE WHEN r.status IS NULL THEN 'not found'
 WHEN c.action IN ('complete', 'fail') THEN CASE WHEN r.status IN ('running', 'awaiting') THEN 'run' WHEN (c.action = 'complete' AND r.status = 'completed' OR c.action = 'fail' AND r.status = 'failed') AND c.said = r.said THEN 'duplicate' ELSE 'conflict' END
 WHEN c.action = 'await' THEN CASE WHEN r.status = 'running' THEN 'run' WHEN r.status <> 'awaiting' THEN 'not running' WHEN c.said = r.said AND c.key IS NOT DISTINCT FROM r.key THEN 'duplicate' ELSE 'conflict' END
 WHEN r.status = 'running' THEN CASE WHEN c.said = r.said THEN 'duplicate' ELSE 'conflict' END WHEN r.status <> 'awaiting' THEN 'not awaiting' WHEN NOT c.force AND c.key IS DISTINCT FROM r.key THEN 'wrong key' ELSE 'run' END AS verdict
FROM c LEFT JOIN r ON c.session_id = r.session_id""")
def session_verdicts(s, d):
    ses, none = tables.sessions(s, d), {"model_used": F.lit(None).cast("string"), "awaiting_deadline": F.lit(None).cast("timestamp")}
    texts = ("summary", "error_message", "awaiting_reason", "resume_input")
    rows = ses.filter("delegation_depth = 0").withColumns(none | {f: F.when(F.col("agent_id") == "agent_0", "other").otherwise(F.col("focus")) for f in texts})
    key = F.when(F.col("focus") == "focus_1", "key_x").otherwise(F.col("awaiting_correlation_key"))
    asked = ses.withColumns(none | {f: F.col("focus") for f in texts} | {"awaiting_correlation_key": key, "force": F.col("focus") == "focus_3"})
    commands = asked.withColumn("action", F.explode(F.array(*[F.lit(a) for a in verdicts.SESSION_FIELDS])))
    return verdicts.session_verdicts(commands, rows).select("session_id", "action", "verdict")


@query("machine_violations", f"""WITH {LOG}, x AS (SELECT *, first_value(memory_space_id) OVER w AS h, max(CASE WHEN kind IN ('superseded', 'archived', 'merged') THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY version ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM log WINDOW w AS (PARTITION BY stream_id ORDER BY version))
SELECT stream_id, version, CASE WHEN memory_space_id <> h THEN 'another space' ELSE 'after the end' END AS problem FROM x WHERE memory_space_id <> h OR ended = 1""")
def machine_violations(s, d):
    return verdicts.memory_machine_violations(tables.event_log(s, d)).select("stream_id", "version", "problem")


MACHINE = f"""{LOG}, c AS (SELECT stream_id AS session_id, version AS seq, CASE kind WHEN 'recorded' THEN 'start' WHEN 'superseded' THEN 'complete' WHEN 'archived' THEN 'await' WHEN 'confidence' THEN 'resume' ELSE 'turn' END AS command, version AS turn_index, (k % 3)::VARCHAR AS key, k % 2 = 0 AS force FROM log),
step AS (SELECT DISTINCT session_id, 0 AS seq, NULL::VARCHAR AS command, false AS accepted, 'none' AS state, NULL::VARCHAR AS key, -1 AS last FROM c
 UNION ALL SELECT session_id, seq, command, ok, CASE WHEN NOT ok OR command = 'turn' THEN state WHEN command = 'start' THEN 'running' WHEN command = 'await' THEN 'awaiting' WHEN command = 'resume' THEN 'running' ELSE 'completed' END,
  CASE WHEN ok AND command = 'await' THEN own WHEN ok AND command = 'resume' THEN NULL ELSE key END, CASE WHEN ok AND command = 'turn' THEN turn_index ELSE last END
 FROM (SELECT c.session_id, c.seq, c.command, c.turn_index, c.key AS own, s.state, s.key, s.last, CASE c.command WHEN 'start' THEN s.state = 'none' WHEN 'turn' THEN s.state = 'running' AND c.turn_index > s.last WHEN 'await' THEN s.state = 'running' WHEN 'complete' THEN s.state IN ('running', 'awaiting') ELSE s.state = 'awaiting' AND (c.force OR c.key IS NOT DISTINCT FROM s.key) END AS ok FROM step s JOIN c ON c.session_id = s.session_id AND c.seq = s.seq + 1))"""


@query("state_machine", f"WITH RECURSIVE {MACHINE} SELECT session_id, seq, command, accepted, state FROM step WHERE seq > 0")
def state_machine(s, d):
    e = tables.event_log(s, d)
    kinds = {"recorded": "start", "superseded": "complete", "archived": "await", "tags": "turn", "confidence": "resume", "merged": "turn"}
    c = maintenance.renamed(e, "kind", kinds).select(F.col("stream_id").alias("session_id"), F.col("version").alias("seq"), F.col("kind").alias("command"), F.col("version").alias("turn_index"), (F.col("k") % 3).cast("string").alias("key"), (F.col("k") % 2 == 0).alias("force"))
    return verdicts.replay_sessions(c)


@query("command_batch", f"""WITH RECURSIVE {LOG}, c AS (SELECT stream_id AS session_id, version AS seq, CASE WHEN kind IN ('recorded', 'tags') THEN 'await' WHEN kind = 'archived' THEN 'complete' WHEN kind = 'superseded' THEN 'fail' ELSE 'resume' END AS action, k % 7 = 0 AS force, CASE WHEN k % 3 = 0 THEN version - 2 END AS expected, 'v' || (k % 2) AS said, (k % 2)::VARCHAR AS own FROM log),
step AS (SELECT session_id, 0 AS seq, NULL::VARCHAR AS action, NULL::VARCHAR AS verdict, 0 AS version, CASE WHEN max(seq) % 3 > 0 THEN 'running' END AS status, NULL::VARCHAR AS summary, NULL::VARCHAR AS error, NULL::VARCHAR AS reason, NULL::VARCHAR AS key, NULL::VARCHAR AS input FROM c GROUP BY session_id
 UNION ALL SELECT session_id, seq, action, verdict, version + (verdict = 'run')::INTEGER, CASE WHEN verdict <> 'run' THEN status WHEN action = 'complete' THEN 'completed' WHEN action = 'fail' THEN 'failed' WHEN action = 'await' THEN 'awaiting' ELSE 'running' END,
  CASE WHEN verdict = 'run' AND action = 'complete' THEN said ELSE summary END, CASE WHEN verdict = 'run' AND action = 'fail' THEN said ELSE error END, CASE WHEN verdict <> 'run' THEN reason WHEN action = 'await' THEN said END, CASE WHEN verdict <> 'run' THEN key WHEN action = 'await' THEN own END, CASE WHEN verdict <> 'run' THEN input WHEN action = 'resume' THEN said WHEN action = 'await' THEN NULL ELSE input END
 FROM (SELECT *, CASE WHEN v NOT IN ('run', 'duplicate', 'not found') AND expected < version THEN 'rejected' ELSE v END AS verdict FROM (SELECT c.*, s.version, s.status, s.summary, s.error, s.reason, s.key, s.input, CASE WHEN s.status IS NULL THEN 'not found'
  WHEN c.action = 'complete' THEN CASE WHEN s.status IN ('running', 'awaiting') THEN 'run' WHEN s.status = 'completed' AND s.summary = said THEN 'duplicate' ELSE 'conflict' END WHEN c.action = 'fail' THEN CASE WHEN s.status IN ('running', 'awaiting') THEN 'run' WHEN s.status = 'failed' AND s.error = said THEN 'duplicate' ELSE 'conflict' END
  WHEN c.action = 'await' THEN CASE WHEN s.status = 'running' THEN 'run' WHEN s.status <> 'awaiting' THEN 'not running' WHEN s.reason = said AND s.key = own THEN 'duplicate' ELSE 'conflict' END
  WHEN s.status = 'running' THEN CASE WHEN s.input IS NOT DISTINCT FROM said THEN 'duplicate' ELSE 'conflict' END WHEN s.status <> 'awaiting' THEN 'not awaiting' WHEN c.force OR s.key = own THEN 'run' ELSE 'wrong key' END AS v FROM step s JOIN c ON c.session_id = s.session_id AND c.seq = s.seq + 1)))
SELECT session_id, seq, action, verdict, version::BIGINT AS version, status FROM step WHERE seq > 0""")
def command_batch(s, d):
    """Waits, resumes and ends of one batch, some by writers that are behind."""
    e, k = tables.event_log(s, d), F.col("k")
    kind = F.col("kind")
    action = F.when(kind.isin("recorded", "tags"), "await").when(kind == "archived", "complete").when(kind == "superseded", "fail").otherwise("resume")
    said, none = F.concat(F.lit("v"), (k % 2).cast("string")), F.lit(None).cast("string")
    commands = e.select(F.lit("a").alias("memory_space_id"), F.col("stream_id").alias("session_id"), F.col("version").alias("seq"), action.alias("action"), (k % 7 == 0).alias("force"), F.when(k % 3 == 0, F.col("version") - 2).alias("expected_version"),
        said.alias("summary"), said.alias("error_message"), said.alias("awaiting_reason"), said.alias("resume_input"), (k % 2).cast("string").alias("awaiting_correlation_key"), none.alias("model_used"), none.alias("awaiting_deadline"))
    there = e.groupBy("stream_id").agg(F.max("version").alias("n")).filter("n % 3 > 0")
    sessions = there.select(F.lit("a").alias("memory_space_id"), F.col("stream_id").alias("session_id"), F.lit("running").alias("status"), *[none.alias(f) for f in verdicts.SESSION_STATE if f != "status"])
    return verdicts.apply_session_commands(commands, sessions).select("session_id", "seq", "action", "verdict", "version", "status")


HASHED = "(('0x' || substr(sha256(timer_id), 1, 6))::BIGINT)"


@query("timer_queue", f"""WITH s AS (SELECT DISTINCT 's' || user_id AS timer_id, user_id FROM events), o AS (SELECT *, {HASHED} % 4 AS k FROM s)
SELECT timer_id, CASE WHEN k = 0 THEN 'dead' WHEN k = 1 THEN 'dead' ELSE 'fired' END AS status, CASE k WHEN 1 THEN 9 WHEN 2 THEN 3 ELSE 1 END AS attempts, CASE k WHEN 0 THEN '[memory space a] refused' WHEN 1 THEN '[memory space a] busy' WHEN 2 THEN 'busy' END AS last_error FROM o""")
def timer_queue(s, d):
    """Timers scheduled twice and drained until nothing is left: some complete, some at the third attempt, some are refused, some never end but by the ceiling."""
    ids = tables.read(s, d, "events").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("timer_id"), F.col("ts").cast("timestamp").alias("fire_at"))
    q = queue.Queue(s, shared.folder(s, "timers"))
    for part in (ids.groupBy("timer_id").agg(F.min("fire_at").alias("fire_at")), ids.groupBy("timer_id").agg(F.max("fire_at").alias("fire_at"))):
        q.schedule(part.withColumn("memory_space_id", F.lit("a")))
    k = F.conv(F.substr(F.sha2("timer_id", 256), F.lit(1), F.lit(6)), 16, 10).cast("long") % 4

    def fire(batch):
        outcome = F.when(k == 0, "dead").when(k == 1, "retry").when((k == 2) & (F.col("attempts") < 2), "retry").otherwise("completed")
        return batch.withColumn("outcome", outcome).withColumn("error", F.when(F.col("outcome") == "dead", "refused").when(F.col("outcome") == "retry", "busy"))

    at = datetime(2030, 1, 1)
    for n in range(10):
        q.drain(fire, at + timedelta(hours=n))
    return q.latest().select("timer_id", "status", "attempts", "last_error")


@query("embedding_delivery", "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 'dead-letter' WHEN event_id % 7 = 0 THEN 'retry' WHEN event_id % 5 = 0 THEN 'halt' WHEN event_id % 4 = 0 OR user_id % 6 = 0 THEN 'dead-letter' WHEN user_id % 2 = 1 THEN 'ok' WHEN event_id % 3 = 0 THEN 'retry' ELSE 'ok' END AS ack FROM events")
def embedding_delivery(s, d):
    n, u = F.col("event_id"), F.col("user_id")
    e = tables.read(s, d, "events").select("event_id", (n % 9 != 0).alias("decoded"), F.when(n % 7 == 0, "transient").when(n % 5 == 0, "fatal").alias("store_error"), (n % 4 == 0).alias("refused"), F.lit(True).alias("may_distill"), F.lit("a").alias("event_space"), F.when(u % 6 == 0, "b").otherwise("a").alias("row_space"), (u % 2 == 1).alias("settled"), (n % 3 == 0).alias("provider_failed"))
    return embedding.delivery(e).select("event_id", "ack")


@query("embedding_backfill", f"WITH {MEM} SELECT 'stored' AS outcome, count(*) AS n FROM memories WHERE status = 'active' AND (embedding IS NULL OR content_hash IS DISTINCT FROM sha256(content)) HAVING count(*) > 0")
def embedding_backfill(s, d):
    """The backfill with a provider that hashes: counts by outcome."""
    backlog = reads.embedding_backlog(tables.memories(s, d, vectors=True))
    return embedding.outcome_counts(embedding.embed_batch(backlog, lambda texts: [[float(len(t)), 1.0] for t in texts]))


STOPPED = "[" + ", ".join(f"'{w}'" for w in sorted(text.STOP)) + "]"


@query("stem_match", f"""WITH {MEM}, x AS (SELECT memory_id, {TOKENS} AS t FROM memories WHERE memory_space_id = '{SPACE}')
SELECT memory_id, len(list_filter(t, lambda w: NOT list_contains({STOPPED}, w))) AS n_lexemes, len(list_filter(t, lambda w: regexp_full_match(w, '{FORMS["reed"]}'))) > 0 OR len(list_filter(t, lambda w: regexp_full_match(w, '{FORMS["thing"]}'))) > 0 AND len(list_filter(t, lambda w: w = 'idiot')) = 0 AS hit FROM x""")
def stem_match(s, d):
    m = tables.memories(s, d).filter(predicates.in_space(SPACE))
    clauses = text.parse("reeding OR thing -idiot")
    toks = text.tokens(F.col("content"))
    counted = m.select("memory_id", "content", F.size(F.filter(toks, lambda t: ~t.isin(*text.STOP))).cast("long").alias("n_lexemes"))
    return text.located(counted, text.lexemes(clauses)).select("memory_id", "n_lexemes", text.matches(F.col("at"), clauses).alias("hit"))


@query("vector_parse", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS norm2 FROM embeddings")
def vector_parse(s, d):
    e = tables.read(s, d, "embeddings")
    back = vectors.parsed(F.to_json("embedding"))
    return e.select("vec_id", F.round(vectors.dot(back, back), 5).alias("norm2"))


@query("redacted", "SELECT user_id, 'host=db password=*** user=' || user_id AS keyed, 'postgresql://u:***@h/' || user_id AS url FROM (SELECT DISTINCT user_id FROM events)")
def redacted(s, d):
    u = tables.read(s, d, "events").select("user_id").distinct()
    c = F.col("user_id").cast("string")
    return u.select("user_id", identity.redact_password(F.concat(F.lit("host=db password=s3cret"), c, F.lit(" user="), c)).alias("keyed"), identity.redact_password(F.concat(F.lit("postgresql://u:p"), c, F.lit("@h/"), c)).alias("url"))
