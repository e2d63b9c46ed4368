"""The adapters of ``sources/views.py`` as SQL views for the reference results."""
from __future__ import annotations

import re

from .. import constants as K
from ..sources import views as V


def lst(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


VIEWS: dict[str, str] = {}

VIEWS["articles"] = f"""
SELECT CAST(doc_id AS VARCHAR) AS article_id,
       split_part(text, chr(10), 1) AS title,
       {lst(V.OUTLETS)}[CAST(substr(source, 4) AS INTEGER) % 20 + 1] AS source,
       'https://news.example/' || doc_id AS url,
       strftime(TIMESTAMP '2024-01-01' + to_hours(doc_id % 87600), '%Y-%m-%d %H:%M') AS published_at,
       text AS full_text,
       CASE WHEN contains(text, chr(10)) THEN split_part(text, chr(10), 2) END AS summary_text,
       CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '[]' WHEN 3 THEN '["정치 > 국회 > 홍길동", "경제"]'
            WHEN 4 THEN '["a > b", "c", "d > e > f", "g"]' ELSE 'not json' END AS keywords,
       CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 13 = 0 THEN NULL ELSE CAST((doc_id * 37) % 101 AS INTEGER) END AS trust_score,
       CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 13 = 0 THEN 'unanalyzed' WHEN (doc_id * 37) % 101 >= 70 THEN 'likely_true'
            WHEN (doc_id * 37) % 101 >= 40 THEN 'uncertain' ELSE 'likely_false' END AS trust_verdict,
       CASE WHEN doc_id % 17 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN '일반'
            ELSE {lst(K.CATEGORY_DISPLAY_ORDER)}[doc_id % 8 + 1] END AS category,
       lang
FROM documents"""

VIEWS["unit_vectors"] = """
SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS len
FROM embeddings"""

VIEWS["article_vectors"] = f"""
SELECT CAST(vec_id AS VARCHAR) AS article_id,
       list_transform(v, lambda x, j: x / len + CASE WHEN j - 1 = label THEN CAST({V.LABEL_BOOST} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS embedding
FROM unit_vectors"""

VIEWS["learned_vectors"] = "SELECT article_id, list_reverse(embedding) AS learned_embedding FROM article_vectors"

VIEWS["chunks"] = """
SELECT article_id AS chunk_id, CAST(CAST(article_id AS BIGINT) // 4 AS VARCHAR) AS article_id, 'chunk ' || article_id AS chunk_text, embedding
FROM article_vectors"""

VIEWS["ev"] = """
SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS created_at,
       CASE WHEN user_id % 5 <> 0 THEN CAST(user_id AS VARCHAR) END AS uid,
       CASE event_type WHEN 'view' THEN 'view_article_detail' WHEN 'click' THEN 'click_article' WHEN 'purchase' THEN 'click_feedback'
            WHEN 'signup' THEN 'visit_main' ELSE 'impression' END AS kind,
       CASE WHEN CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0 THEN 'personalized_recommendation' ELSE 'main' END AS surface
FROM events"""

_ITEMS = " || ',' || ".join(f"""'{{"article_id":"' || ((k + {j}) % 100) || '","position":{j}}}'""" for j in range(5))
VIEWS["event_log"] = f"""
SELECT CAST(event_id AS VARCHAR) AS log_id, user_id || '-' || strftime(ts, '%Y%m%d') AS session_id, kind AS event_type,
       CASE WHEN kind <> 'impression' THEN CAST(k AS VARCHAR) END AS article_id,
       CASE WHEN kind = 'impression' THEN '{{"source":"' || surface || '","articles":[' || {_ITEMS} || ']}}'
            WHEN kind = 'click_article' AND k % 5 <> 0 THEN '{{"source":"' || surface || '","rec_source":"' || ['encoder', 'profile', 'category', 'latest'][k % 4 + 1] || '"}}'
            ELSE '{{"source":"' || surface || '"}}' END AS event_data,
       created_at, uid AS user_id
FROM ev"""

VIEWS["shown"] = """
SELECT log_id, session_id, user_id, created_at, CAST(CAST(json_extract_string(event_data, '$.articles[0].article_id') AS INTEGER) AS INTEGER) AS k0,
       p AS position, CAST((CAST(json_extract_string(event_data, '$.articles[0].article_id') AS INTEGER) + p) % 100 AS VARCHAR) AS article_id
FROM event_log, (SELECT unnest([0, 1, 2, 3, 4]) AS p) WHERE event_type = 'impression'"""

VIEWS["users"] = "SELECT DISTINCT user_id FROM event_log WHERE user_id IS NOT NULL"

VIEWS["feedback"] = """
SELECT CAST(event_id AS VARCHAR) AS feedback_id, CAST(k AS VARCHAR) AS article_id, uid AS user_id, CAST(user_id AS VARCHAR) AS raw_user_id,
       CASE WHEN k % 2 = 0 THEN 'like' ELSE 'dislike' END AS feedback_type, created_at
FROM ev WHERE event_type = 'purchase'"""

VIEWS["performance_log"] = """
SELECT 'client_performance' AS event_type, created_at, '/' || event_type AS path, CAST(floor(value * 10) AS BIGINT) AS lcp_ms,
       floor(value) / 100 AS cls, CAST(floor(value * 3) AS BIGINT) AS max_event_ms
FROM ev"""

VIEWS["search_log"] = """
SELECT CAST(user_id AS VARCHAR) AS user_id, 'execute_search' AS event_type, ' q' || (k % 25) || ' ' AS term, created_at FROM ev"""

VIEWS["search_queries"] = """
SELECT CAST(b.item_id AS VARCHAR) AS query_id, b.text AS query, v.embedding AS query_vector
FROM benchmark b LEFT JOIN article_vectors v ON CAST(b.item_id AS VARCHAR) = v.article_id"""


def _answers() -> str:
    cols, q = [], 0
    for name, count in K.QUESTION_COUNTS.items():
        words = [f"['yes', 'no', 'uncertain'][(i * 7 + {(q + j) * 13} + i // {q + j + 2}) % 3 + 1]" for j in range(count)]
        q += count
        cols.append(f"CASE WHEN i % 29 <> 0 THEN [{', '.join(words)}] END AS {name}")
    return ("SELECT article_id, title, source, full_text, " + ", ".join(cols)
            + " FROM (SELECT *, CAST(article_id AS BIGINT) AS i FROM articles)")


VIEWS["answers"] = _answers()
VIEWS["label_rows"] = """
SELECT CAST(doc_id AS VARCHAR) AS article_id, quality * CAST(0.75 AS DOUBLE) + (1 - toxic) * CAST(0.25 AS DOUBLE) AS label FROM labels"""


def _predicates(name: str) -> str:
    n = K.QUESTION_COUNTS[name]
    value = lambda j: f"CASE {name}[{j}] WHEN 'yes' THEN CAST(1.0 AS DOUBLE) WHEN 'no' THEN CAST(0.0 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END"
    total = "CAST(0.0 AS DOUBLE)"
    for j in range(1, n + 1):
        total = f"({total} + {value(j)})"
    return f"CAST(trunc({total} / {n} * 10) AS INTEGER)"


def _tier() -> str:
    out = "CASE WHEN coalesce(source, '') IN ('', '미상') THEN 5 "
    for tier, names in K.SOURCE_TIERS.items():
        out += f"WHEN source IN ({lst(names)[1:-1]}) THEN {tier} "
    for tier, names in K.SOURCE_TIERS.items():
        out += f"WHEN len(list_filter({lst(sorted(names))}, lambda n: contains(source, n))) > 0 THEN {tier} "
    return out + "ELSE 5 END"


def _tier_reason() -> str:
    out = f"CASE WHEN coalesce(source, '') IN ('', '미상') THEN '{K.SOURCE_REASON_UNKNOWN}' "
    for tier, names in K.SOURCE_TIERS.items():
        out += f"WHEN source IN ({lst(names)[1:-1]}) THEN '{K.SOURCE_REASON_EXACT}' || source "
    for tier, names in K.SOURCE_TIERS.items():
        hit = f"list_filter({lst(sorted(names))}, lambda n: contains(source, n))"
        out += f"WHEN len({hit}) > 0 THEN '{K.SOURCE_REASON_PARTIAL}' || {hit}[1] "
    return out + f"ELSE '{K.SOURCE_REASON_UNLISTED_HEAD}' || source || '{K.SOURCE_REASON_UNLISTED_TAIL}' END"


TIER_SQL, TIER_REASON_SQL = _tier(), _tier_reason()


def score_sql(weights: list[float], cols=("c0", "c1", "c2", "c3", "c4")) -> str:
    d = lambda x: f"CAST({x} AS DOUBLE)"
    raw = " + ".join(f"{c} * {d(w)}" for c, w in zip(cols, weights))
    top = d(0.0)
    for w in weights:
        top = f"({top} + {d(w if w > 0 else 0.0)})"
    base = f"(({raw}) / ({top} * 10) * 100)"
    pen = f"(CASE WHEN {cols[2]} < 4 AND {cols[1]} < 4 THEN {base} - 10 ELSE {base} END)"
    cap = f"(CASE WHEN {cols[1]} < 4 THEN least({pen}, {d(69.0)}) ELSE {pen} END)"
    return f"CAST(trunc(greatest({d(0.0)}, least({d(100.0)}, {cap}))) AS INTEGER)"


VERDICT_SQL = "CASE WHEN score IS NULL THEN 'unanalyzed' WHEN score >= 70 THEN 'likely_true' WHEN score >= 40 THEN 'uncertain' ELSE 'likely_false' END"

VIEWS["criteria"] = f"""
SELECT article_id, source, full_text, evidence_support IS NULL AS failed, {TIER_SQL} AS c0, {_predicates('evidence_support')} AS c1,
       {_predicates('style_neutrality')} AS c2, {_predicates('logical_consistency')} AS c3, {_predicates('clickbait_risk')} AS c4
FROM answers"""
VIEWS["trust_rows"] = f"""
SELECT *, {VERDICT_SQL} AS verdict FROM (
  SELECT article_id, source, full_text, failed, CASE WHEN NOT failed THEN c0 END AS c0, CASE WHEN NOT failed THEN c1 END AS c1,
         CASE WHEN NOT failed THEN c2 END AS c2, CASE WHEN NOT failed THEN c3 END AS c3, CASE WHEN NOT failed THEN c4 END AS c4,
         CASE WHEN NOT failed THEN {score_sql(K.WEIGHT_SETS['W2'])} END AS score
  FROM criteria)"""


def clean_body_sql(text: str) -> str:
    """The cleaning of a body as SQL.

    Left out are the removals that need look-ahead; they start at marks that the given tables never hold.
    """
    from ..functions import arrow as AR
    blanks = r"' ' || chr(9) || chr(10) || chr(13)"
    out = rf"regexp_replace(trim({text}, {blanks}), '^(\s*\[[^\n\]]*\]\s*)+', '')"
    for pattern, fold in AR.BODY_PATTERNS:
        if "(?=" not in pattern:
            out = f"regexp_replace({out}, '{'(?i)' if fold else ''}{pattern}', '', 'g')"
    return rf"trim(regexp_replace(regexp_replace(trim({out}, {blanks}), '(?s)^(.*\.)[^.]*$', '\1'), '\s+', ' ', 'g'), ' ')"


def greedy_sql(name: str, rows: str, threshold: float) -> dict[str, str]:
    """Views of a greedy near-duplicate pass; rows: (id, k, toks), visited by (k, id).  {name}_drop has the dropped ids."""
    both = "list_distinct(list_concat(a.toks, b.toks))"
    return {
        f"{name}_sets": rows,
        f"{name}_reps": f"SELECT min((k, id)) AS f, toks FROM {name}_sets WHERE len(toks) > 0 GROUP BY toks",
        f"{name}_pairs": f"SELECT a.f AS e, b.f AS l FROM {name}_reps a JOIN {name}_reps b ON a.f < b.f WHERE len(list_intersect(a.toks, b.toks)) / CAST(len({both}) AS DOUBLE) >= {threshold}",
        f"{name}_nodes": f"""SELECT x.f[2] AS id, row_number() OVER (ORDER BY x.f) AS i, coalesce((SELECT list(e[2]) FROM {name}_pairs p WHERE p.l = x.f), []) AS before
          FROM (SELECT e AS f FROM {name}_pairs UNION SELECT l FROM {name}_pairs) x""",
        f"{name}_walk": f"""/*RECURSIVE_CTE*/SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS kept
          UNION ALL SELECT n.i, CASE WHEN list_has_any(w.kept, n.before) THEN w.kept ELSE list_append(w.kept, n.id) END FROM {name}_walk w JOIN {name}_nodes n ON n.i = w.i + 1""",
        f"{name}_kept": f"SELECT unnest(kept) AS id FROM (SELECT kept FROM {name}_walk ORDER BY i DESC LIMIT 1)",
        f"{name}_drop": f"""SELECT id FROM {name}_sets WHERE len(toks) > 0 AND id NOT IN (SELECT f[2] FROM {name}_reps)
          UNION SELECT id FROM {name}_nodes WHERE id NOT IN (SELECT id FROM {name}_kept)"""}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a statement with the views it names, in dependency order."""
    pool = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for word in dict.fromkeys(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", re.sub(r"'[^']*'", "", text))):
            if word in pool and word not in order and pool[word] is not text:
                visit(pool[word])
                if word not in order:
                    order.append(word)

    visit(body)
    if not order:
        return body
    recursive = "RECURSIVE " if any("RECURSIVE_CTE" in pool[w] for w in order) else ""
    head = ",\n".join(f"{w} AS ({pool[w].replace('/*RECURSIVE_CTE*/', '')})" for w in order)
    return f"WITH {recursive}{head}\n{body.strip()}"
