"""Rules over rows that take their parameters as tables or lists: headings by font, lookups by id, roll-ups with parts that may be missing."""

from __future__ import annotations

from tarnsift.plans.sql import pairs

QUERIES, ORACLE_SQL = pairs({
    # type stands for font: a line is a heading if any rule has its font and a size within a half of its own
    "F5_heading_fonts": """
        SELECT p_partkey, max(CASE WHEN r.font IS NULL THEN 0 ELSE 1 END) = 1 AS is_heading FROM part
        LEFT JOIN (VALUES ('ECONOMY', 11.0), ('ECONOMY', 24.5), ('SMALL', 40.0), ('PROMO', 7.4)) AS r(font, size) ON r.font = p_type AND abs(p_size - r.size) <= 0.5 GROUP BY p_partkey""",
    # lines of an order stand for rounds: any that ended at the ceiling; an order without known ends falls back to its own field
    "F14_ceiling_hits": """
        SELECT o_orderkey, coalesce(max(CASE WHEN l_linestatus = 'O' AND l_quantity < 45 THEN NULL WHEN l_quantity >= 49 THEN 1 ELSE 0 END), CASE WHEN max(o_orderstatus) = 'P' THEN 1 ELSE 0 END) = 1 AS hit
        FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    # the ids asked for are rows of their own
    "J2_texts_of_asked_ids": """
        SELECT a.doc_id, d.source AS section, length(d.text) AS chars, d.doc_id IS NOT NULL AS found FROM (SELECT doc_id + 7 AS doc_id FROM labels WHERE doc_id % 20 = 0) a LEFT JOIN documents d ON d.doc_id = a.doc_id""",
    # all nations are groups, those without what is measured have three zeros
    "G2_spread_with_empty": """
        SELECT n_name, CAST(coalesce(min(c_custkey), 0) AS BIGINT) AS least, CAST(coalesce(median(c_custkey), 0) AS DOUBLE) AS mid, CAST(coalesce(max(c_custkey), 0) AS BIGINT) AS most
        FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9900) c ON c_nationkey = n_nationkey GROUP BY n_name""",
    # seven parts of a cost; a sum is null only if every part is
    "G24_agent_costs": """
        SELECT user_id, count(*) AS turns, round(sum(main), 7) AS main, round(sum(memory), 7) AS memory, round(sum(rewrite), 7) AS rewrite, round(sum(rerank), 7) AS rerank, round(sum(tools), 7) AS tools, round(sum(title), 7) AS title,
               round(sum(review), 7) AS review, round(avg(seconds), 6) AS mean_seconds,
               CASE WHEN count(main) + count(memory) + count(rewrite) + count(rerank) + count(tools) + count(title) + count(review) > 0 THEN
                   round(coalesce(sum(main), 0) + coalesce(sum(memory), 0) + coalesce(sum(rewrite), 0) + coalesce(sum(rerank), 0) + coalesce(sum(tools), 0) + coalesce(sum(title), 0) + coalesce(sum(review), 0), 7) END AS cost
        FROM (SELECT user_id, CASE WHEN user_id % 10 = 3 THEN NULL WHEN event_type = 'view' THEN value END AS main, CASE WHEN user_id % 10 <> 3 AND event_type = 'click' THEN value / 2 END AS memory,
                     CASE WHEN user_id % 10 <> 3 AND event_type = 'error' THEN value / 4 END AS rewrite, CASE WHEN user_id % 10 <> 3 AND event_id % 5 = 0 THEN value / 8 END AS rerank,
                     CASE WHEN user_id % 10 <> 3 AND event_id % 7 = 0 THEN value / 16 END AS tools, CASE WHEN user_id % 10 <> 3 AND event_type = 'signup' THEN value END AS title, CAST(NULL AS DOUBLE) AS review, value AS seconds FROM events) e
        GROUP BY user_id""",
    # a column's rule decides what counts as good: quality, toxicity, or both
    "G15_quality_by_column": """
        SELECT c.col, lang AS mode, count(*) AS answers, count(l.doc_id) AS judged, count(CASE WHEN l.quality = 1 AND c.col <> 'toxic' OR l.toxic = 0 AND c.col = 'toxic' THEN CASE WHEN c.col = 'both' AND l.toxic = 1 THEN NULL ELSE 1 END END) AS good
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id, (VALUES ('quality'), ('toxic'), ('both')) AS c(col) GROUP BY c.col, lang""",
    # what a guard may see: rules of its own scope and permanent ones that are active; names that are no such rule are counted apart
    "J28_conflicts_by_scope": """
        WITH rules AS (SELECT o_orderkey AS rule_id, o_custkey % 3 AS scope, o_orderstatus <> 'F' AS active FROM orders),
             named AS (SELECT l_orderkey * 2 AS rule_id, l_suppkey % 3 AS session, l_partkey AS finding FROM lineitem WHERE l_linenumber = 1)
        SELECT n.session, n.finding, count(r.rule_id) AS conflicts, count(*) - count(r.rule_id) AS unknown, count(r.rule_id) > 0 AS is_conflict
        FROM named n LEFT JOIN rules r ON r.rule_id = n.rule_id AND r.active AND (r.scope = 0 OR r.scope = n.session) GROUP BY n.session, n.finding""",
    # the first check that fails names the request's problem
    "F21_request_checks": """
        SELECT conv_id, CASE WHEN count(text) = 0 THEN 'messages is empty' WHEN count(CASE WHEN role IS NULL OR role NOT IN ('system', 'user', 'assistant') THEN 1 END) > 0 THEN 'unknown role'
                             WHEN count(CASE WHEN text IS NULL OR text LIKE '[{%' THEN 1 END) > 0 THEN 'content is not text' WHEN count(CASE WHEN trim(text) = '' THEN 1 END) > 0 THEN 'empty content'
                             WHEN conv_id % 17 = 0 THEN 'max_tokens is not positive' WHEN max_by(role, turn) <> 'user' THEN 'last message is not of the user' ELSE 'ok' END AS verdict
        FROM conversations GROUP BY conv_id""",
})
