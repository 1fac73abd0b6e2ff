"""DuckDB definitions of the derived inputs, for the independent SQL oracle.

Each entry mirrors one method of :class:`citeflow.fixtures.Fixtures`; an
oracle query names the views it uses and :func:`with_views` prepends them
as CTEs in dependency order. Only the driver's base tables are assumed.
"""

from __future__ import annotations

import re

# Score of a paper as an integer (monotone in the distance); ts is a DATE.
SCORE_SQL = ("(GREATEST(0, COALESCE(CAST(FLOOR(date_diff('day', DATE '2000-01-01', {ts}) / 12.0) AS BIGINT), 0))"
             " + LEAST(COALESCE({c}, 0), 8000))")
DIST_SQL = "ROUND(EXP(CAST({s} AS DOUBLE) / 10000.0 - 1.0), 9)"


def dsql(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), lambda x: x[1] * x[2]))"


def nsql(a: str) -> str:
    return f"sqrt(list_sum(list_transform(CAST({a} AS DOUBLE[]), lambda x: x * x)))"


def l2sql(a: str, b: str) -> str:
    return (f"list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])),"
            f" lambda x: (x[1] - x[2]) * (x[1] - x[2])))")


def cossql(a: str, b: str) -> str:
    return f"({dsql(a, b)} / ({nsql(a)} * {nsql(b)}))"


VIEWS: dict[str, str] = {
    "paper": """
        SELECT o.o_orderkey AS paper_id, CAST(o.o_orderdate AS DATE) AS ts,
               CAST(TRUNC(q.q) AS BIGINT) AS n_citation
        FROM orders o JOIN (SELECT l_orderkey, SUM(l_quantity) AS q FROM lineitem GROUP BY l_orderkey) q
          ON o.o_orderkey = q.l_orderkey""",
    "authorship": "SELECT DISTINCT l_orderkey AS paper_id, l_suppkey AS author_id FROM lineitem",
    "author": """
        SELECT s.s_suppkey AS author_id,
               CASE WHEN s.s_acctbal >= 0 THEN s.s_name END AS name_en,
               CASE WHEN r.r_name = 'ASIA' THEN 'ZH-' || s.s_name END AS name_zh
        FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
        LEFT JOIN region r ON r.r_regionkey = n.n_regionkey""",
    "follow": """
        SELECT DISTINCT user_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS author_id
        FROM events
        WHERE event_type = 'signup'
          AND TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IN (SELECT author_id FROM author)""",
    "active": """
        SELECT DISTINCT user_id FROM events
        WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'""",
    "pool_high": "SELECT paper_id FROM paper WHERE n_citation >= 180",
    "pool_latest": "SELECT paper_id FROM paper WHERE ts > DATE '2001-08-01' - 90",
    "pool_newest": "SELECT paper_id FROM paper WHERE ts > DATE '2001-08-01' - 7",
    "paper_pv": """
        SELECT l_orderkey AS paper_id, COUNT(*) AS pv FROM lineitem
        WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')
        GROUP BY l_orderkey""",
    "paper_zone": """
        SELECT l_orderkey AS paper_id, list_sort(list_distinct(list(l_returnflag))) AS zone FROM lineitem
        WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
        GROUP BY l_orderkey""",
    "cand": f"""
        SELECT 'high' AS pool, a.author_id, a.paper_id,
               {SCORE_SQL.format(ts='p.ts', c='p.n_citation')} AS score, p.n_citation
        FROM authorship a JOIN paper p ON a.paper_id = p.paper_id
        WHERE a.paper_id IN (SELECT paper_id FROM pool_high)
        UNION ALL
        SELECT 'latest' AS pool, a.author_id, a.paper_id,
               {SCORE_SQL.format(ts='p.ts', c='p.n_citation')} AS score, p.n_citation
        FROM authorship a JOIN paper p ON a.paper_id = p.paper_id
        WHERE a.paper_id IN (SELECT paper_id FROM pool_latest)""",
    "coauthor": """
        SELECT f, t, w, rk FROM (
          SELECT f, t, w, row_number() OVER (PARTITION BY f ORDER BY w DESC, t) AS rk
          FROM (SELECT a.author_id AS f, b.author_id AS t, COUNT(*) AS w
                FROM authorship a JOIN authorship b ON a.paper_id = b.paper_id AND a.author_id <> b.author_id
                GROUP BY 1, 2)) WHERE rk <= 10""",
    "scholar_vec": """
        SELECT vec_id AS author_id, embedding FROM embeddings
        WHERE vec_id IN (SELECT author_id FROM author)""",
    "sim_edges": f"""
        SELECT f, t, sim, rk FROM (
          SELECT f, t, sim, row_number() OVER (PARTITION BY f ORDER BY sim DESC, t) AS rk
          FROM (SELECT a.author_id AS f, b.author_id AS t, {cossql('a.embedding', 'b.embedding')} AS sim
                FROM scholar_vec a JOIN scholar_vec b ON a.author_id <> b.author_id)) WHERE rk <= 10""",
    "lists_followed": """
        SELECT author_id AS followed_id, pool, 'followed_scholar' AS label, rk AS rank,
               paper_id, score, n_citation, author_id
        FROM (SELECT *, row_number() OVER (PARTITION BY author_id, pool
                                           ORDER BY score DESC, paper_id, author_id) AS rk FROM cand)
        WHERE rk <= 25""",
    "lists_coauthor": """
        SELECT f AS followed_id, pool, 'cooperation_scholar' AS label, rk AS rank,
               paper_id, score, n_citation, author_id
        FROM (SELECT e.f, c.*, row_number() OVER (PARTITION BY e.f, c.pool
                                                  ORDER BY c.score DESC, c.paper_id, c.author_id) AS rk
              FROM coauthor e JOIN cand c ON c.author_id = e.t)
        WHERE rk <= 25""",
    "lists_similar": """
        SELECT f AS followed_id, pool, 'similar_scholar' AS label, rk AS rank,
               paper_id, score, n_citation, author_id
        FROM (SELECT e.f, c.*, row_number() OVER (PARTITION BY e.f, c.pool
                                                  ORDER BY c.score DESC, c.paper_id, c.author_id) AS rk
              FROM sim_edges e JOIN cand c ON c.author_id = e.t)
        WHERE rk <= 25""",
    "lists_all": """
        SELECT * FROM lists_followed UNION ALL SELECT * FROM lists_coauthor
        UNION ALL SELECT * FROM lists_similar""",
    "enriched": f"""
        SELECT l.followed_id, l.pool, l.label, l.rank, l.paper_id,
               {DIST_SQL.format(s='l.score')} AS distance,
               (l.paper_id IN (SELECT paper_id FROM pool_newest)) AS new,
               l.n_citation, l.author_id,
               COALESCE(a.name_en, '') AS author_name_en, COALESCE(a.name_zh, '') AS author_name_zh,
               COALESCE(pv.pv, 0) AS pv, COALESCE(z.zone, CAST([] AS VARCHAR[])) AS zone
        FROM lists_all l
        LEFT JOIN author a ON a.author_id = l.author_id
        LEFT JOIN paper_pv pv ON pv.paper_id = l.paper_id
        LEFT JOIN paper_zone z ON z.paper_id = l.paper_id""",
    "followed_named": """
        SELECT f.user_id, f.author_id AS followed_id,
               COALESCE(a.name_en, a.name_zh) AS name_of_followed_author,
               COALESCE(a.name_zh, a.name_en) AS chinese_name_of_followed_author
        FROM follow f JOIN author a ON a.author_id = f.author_id
        WHERE a.name_en IS NOT NULL OR a.name_zh IS NOT NULL""",
}


def with_views(body: str) -> str:
    """Prefix ``body`` with the CTEs of every view it (transitively) names."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for name in VIEWS:
            if name not in order and re.search(rf"\b{name}\b", sql):
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(body)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in order)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
