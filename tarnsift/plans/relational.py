"""Lookups, joins, top-k, latest-per-key, snapshots and change capture.

Customers stand for users, orders for tickets, lineitem for messages. Two snapshots of the documents stand
for two crawls: the earlier one lacks the ids that end in 9, has another text for those that end in 3 and
another section for those that end in 4; the later one lacks those that end in 7.
"""

from tarnsift.plans.sql import pairs

_SNAPSHOTS = """
    previous AS (
        SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN 'moved' ELSE source END AS section,
               CASE WHEN doc_id % 10 = 3 THEN concat(text, ' old') ELSE text END AS body
        FROM documents WHERE doc_id % 10 <> 9),
    latest AS (SELECT doc_id, source AS section, text AS body FROM documents WHERE doc_id % 10 <> 7),
    before AS (SELECT doc_id, section, substr({sha}, 1, 16) AS hash FROM previous),
    after AS (SELECT doc_id, section, substr({sha}, 1, 16) AS hash FROM latest),
    both_sides AS (
        SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, b.doc_id IS NULL AS is_new, a.doc_id IS NULL AS is_gone,
               b.section AS old_section, a.section AS new_section, b.hash AS old_hash, a.hash AS new_hash
        FROM before b FULL OUTER JOIN after a ON a.doc_id = b.doc_id),
    changes AS (
        SELECT doc_id, 'new' AS kind FROM both_sides WHERE is_new
        UNION ALL SELECT doc_id, 'deleted' FROM both_sides WHERE is_gone
        UNION ALL SELECT doc_id, 'moved' FROM both_sides WHERE NOT is_new AND NOT is_gone AND old_section <> new_section
        UNION ALL SELECT doc_id, 'changed' FROM both_sides WHERE NOT is_new AND NOT is_gone AND old_hash <> new_hash)
"""


def _snapshots(body: str) -> tuple[str, str]:
    return tuple(f"WITH {_SNAPSHOTS.format(sha=sha)} {body}" for sha in ("sha2(body, 256)", "sha256(body)"))


QUERIES, ORACLE_SQL = pairs({
    "J19_user_tickets": """
        SELECT c_custkey, c_name, count(o_orderkey) AS tickets, round(coalesce(sum(o_totalprice), 0), 2) AS total
        FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name""",
    "F9_ticket_filter": """
        SELECT o_orderkey, o_custkey, o_totalprice FROM orders
        WHERE o_orderstatus = 'O' AND (o_orderpriority LIKE '%URGENT%' OR o_orderpriority LIKE '%HIGH%')""",
    "F18_ownership": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7",
    "F19_projection": "SELECT c_custkey, c_name, c_mktsegment FROM customer",
    "L2_multikey_topk": """
        SELECT o_orderkey, o_totalprice, o_orderdate FROM orders
        ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey LIMIT 20""",
    "W7_latest_per_key": """
        SELECT o_custkey, o_orderkey, o_orderstatus FROM (
            SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) x
        WHERE n = 1""",
    "J7_left_anti_new": """
        SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""",
    "J9_semi_contain": """
        SELECT o_orderkey FROM orders WHERE EXISTS (
            SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45 AND l_returnflag = 'R')""",
    "J21_first_route_wins": """
        SELECT p_brand, p_partkey, p_name FROM (
            SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) x WHERE n = 1""",
    "J24_profile_diff": """
        WITH a AS (SELECT p_brand AS mode, count(*) AS n FROM part WHERE p_size < 25 GROUP BY p_brand),
             b AS (SELECT p_brand AS mode, count(*) AS n FROM part WHERE p_retailprice > 1400 GROUP BY p_brand)
        SELECT coalesce(a.mode, b.mode) AS mode, CASE WHEN a.mode IS NULL THEN 'added' WHEN b.mode IS NULL THEN 'removed'
               WHEN a.n <> b.n THEN 'changed' ELSE 'same' END AS status FROM a FULL OUTER JOIN b ON a.mode = b.mode""",
    "J22_branch_tree": """
        WITH RECURSIVE tree AS (
            SELECT CAST(r_regionkey AS BIGINT) AS id, CAST(NULL AS BIGINT) AS parent FROM region
            UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT) FROM nation),
        up(id, root, depth) AS (
            SELECT id, id, 0 FROM tree WHERE parent IS NULL
            UNION ALL SELECT t.id, u.root, u.depth + 1 FROM tree t JOIN up u ON t.parent = u.id)
        SELECT id, root, depth FROM up""",
    "J23_reachability": """
        WITH RECURSIVE edges(src, dst) AS (
            VALUES ('none', 'planning'), ('planning', 'execution'), ('execution', 'execution'), ('execution', 'validation'),
                   ('validation', 'done'), ('validation', 'execution'), ('execution', 'planning'), ('validation', 'planning'),
                   ('planning', 'cancelled'), ('execution', 'cancelled'), ('validation', 'cancelled'), ('done', 'validation'),
                   ('done', 'planning'), ('cancelled', 'planning')),
        reach(src, dst, hops) AS (
            SELECT src, dst, 1 FROM edges
            UNION ALL SELECT r.src, e.dst, r.hops + 1 FROM reach r JOIN edges e ON r.dst = e.src WHERE r.hops < 6)
        SELECT src, dst, min(hops) AS hops FROM reach GROUP BY src, dst""",
    "U3_snapshot_diff": _snapshots("SELECT doc_id, kind FROM changes"),
    "G6_event_counts": _snapshots("""SELECT count_if(kind = 'new') AS n_new, count_if(kind = 'changed') AS n_changed,
        count_if(kind = 'moved') AS n_moved, count_if(kind = 'deleted') AS n_deleted FROM changes"""),
    "J18_full_outer_mismatch": _snapshots("SELECT count(*) AS total, count_if(old_hash IS DISTINCT FROM new_hash) AS differing FROM both_sides"),
    "U6_except": _snapshots("SELECT doc_id FROM before EXCEPT SELECT doc_id FROM after"),
    "U4_incremental": _snapshots("""SELECT CASE WHEN is_gone THEN 'deleted' WHEN old_hash = new_hash THEN 'kept' ELSE 'recomputed' END AS fate,
        count(*) AS files FROM both_sides GROUP BY 1"""),
    "U9_content_dedup": (
        "SELECT substr(sha2(text, 256), 1, 16) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
        "SELECT substr(sha256(text), 1, 16) AS hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1"),
    "J1_snapshot_text_join": _snapshots(""", texts AS (SELECT hash, min(length(body)) AS chars FROM (
        SELECT a.hash, l.body FROM after a JOIN latest l ON l.doc_id = a.doc_id) t GROUP BY hash)
        SELECT a.doc_id, a.section, t.chars FROM after a JOIN texts t ON t.hash = a.hash"""),
    "S2_fingerprint": ("SELECT doc_id, sha2(text, 256) AS sha FROM documents", "SELECT doc_id, sha256(text) AS sha FROM documents"),
    "U12_rule_book": """
        SELECT scope, n, rule FROM (
            SELECT 'permanent' AS scope, row_number() OVER (ORDER BY r_regionkey) AS n, r_name AS rule FROM region
            UNION ALL SELECT 'session', row_number() OVER (ORDER BY n_nationkey), n_name FROM nation WHERE n_regionkey = 1) x""",
    "J20_follow_up": """
        SELECT f.turn AS turn, f.conv_id, c.turn AS control, length(f.text) - length(c.text) AS longer
        FROM conversations f JOIN conversations c ON c.conv_id = f.conv_id AND c.turn = f.turn - 2 AND c.role = f.role""",
    "J26_call_lineage": ("""
        SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW)
                         - count(*) OVER (PARTITION BY user_id, event_type, ts) AS earlier FROM events""",
        """
        SELECT e.event_id, count(p.event_id) AS earlier FROM events e
        LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = e.event_type AND p.ts < e.ts AND p.ts >= e.ts - INTERVAL 1 HOUR
        GROUP BY e.event_id"""),
    "J28_rule_conflicts": """
        SELECT l.l_returnflag, count(o.o_orderkey) AS known, count(*) - count(o.o_orderkey) AS unknown
        FROM lineitem l LEFT JOIN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') o ON o.o_orderkey = l.l_orderkey GROUP BY 1""",
    "V3_unique_keys": "SELECT lower(trim(p_name)) AS k, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1",
})
