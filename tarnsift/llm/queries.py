"""The queries of the training-data operators, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, centroid_clusters, chat_format, decontaminate, filter_audit, huffman_ids, jaccard_join, line_dedup, mixture, pii, quality_rules, token_counts, weak_quality
from .common import materialize, table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op5_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.classify(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), counts=True)


def op9_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman_ids.write_and_read(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


#: A conversation that says what could be taken for control strings.
TRAP = r"\### Assistant: </turn> ok"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    turns = chat_format.canonical_turns_of_json(mixed_layouts(said.union(trap)), "record", "turn")
    return chat_format.digests(materialize(chat_format.formatted(turns), "chat-blocks"))


def mixed_layouts(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, record): every turn as a JSON object in one of three layouts, by a hash; the table has but one."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    pick = F.when(role.isin("human", "gpt"), 0).otherwise(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)))
    other = F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    records = (
        F.to_json(F.struct(role.alias("role"), text.alias("text"))),
        F.to_json(F.struct(other.alias("from"), text.alias("value"), F.lit("x").alias("unknown"))),
        F.to_json(F.struct(F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages"))),
    )
    return turns.select("conv_id", "turn", F.when(pick == 0, records[0]).when(pick == 1, records[1]).otherwise(records[2]).alias("record"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters.clusters(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_ngram_jaccard_join, op2_pii, op3_byte_bpe, op4_quality_rules, op5_weak_quality, op6_decontamination,
    op7_token_counts, op8_line_dedup, op9_huffman_ids, op10_chat_format, op11_centroid_clusters, op12_filter_audit, op13_mixture,
)}

def _rounds_sql(k: int, rounds: int, dims: int) -> str:
    """The clustering as SQL: tables c0, c1, ... of centroids, a0, a1, ... of what is nearest to them."""
    near = """a{0} AS MATERIALIZED (
        SELECT rid, vec_id, v.x, min(list_sum([(v.x[i] - c.x[i]) * (v.x[i] - c.x[i]) for i in range(1, {2})])::BIGINT * {1} + j) AS code FROM v, c{0} AS c GROUP BY rid, vec_id, v.x)"""
    move = """s{0} AS (SELECT code % {2} AS j, unnest(range(1, {3})) AS i, unnest(x) AS x FROM a{0}),
    m{0} AS (SELECT j, i, sum(x)::BIGINT AS s, count(*) AS n FROM s{0} GROUP BY j, i),
    c{1} AS MATERIALIZED (
        SELECT j, list((s - (((s % n) + n) % n)) // n ORDER BY i) AS x FROM m{0} GROUP BY j
        UNION ALL SELECT j, x FROM c{0} WHERE j NOT IN (SELECT j FROM m{0}))"""
    steps = [near.format(0, k, dims + 1)]
    for r in range(rounds):
        steps += [move.format(r, r + 1, k, dims + 1), near.format(r + 1, k, dims + 1)]
    return f"""
    WITH v AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, [floor(256 * e::DOUBLE)::BIGINT for e in embedding] AS x FROM embeddings
        WHERE len(embedding) = {dims} AND len([e for e in embedding if e IS NOT NULL AND isfinite(e)]) = {dims}),
    c0 AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS j, x FROM v WHERE vec_id IS NOT NULL QUALIFY j < {k}),
    {", ".join(steps)}
    SELECT vec_id, (code % {k})::INTEGER AS cluster, code // {k} AS distance, (sum(code // {k}) OVER (PARTITION BY code % {k}))::BIGINT AS cluster_inertia,
           (sum(code // {k}) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
    FROM a{rounds} JOIN c{rounds} AS c ON code % {k} = j"""


ORACLE_SQL: dict[str, str] = {
    "op11_centroid_clusters": _rounds_sql(centroid_clusters.K, centroid_clusters.ROUNDS, centroid_clusters.DIMS),
    "op12_filter_audit": r"""
    WITH docs AS (
        SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    marks AS (SELECT doc_id, coalesce(max((quality = 1)::INT), 0) AS good, coalesce(max((toxic = 1)::INT), 0) AS toxic FROM labels GROUP BY doc_id),
    fails AS (
        SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
                      regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE)] AS f,
               coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
        FROM docs LEFT JOIN marks USING (doc_id)),
    sets AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, f),
    l AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
    orders AS (
        SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM l AS a, l AS b, l AS c, l AS d, l AS e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
    steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
    counted AS (
        SELECT part, o, step, o[step] AS i,
               sum(n * (NOT list_bool_or([f[k] for k in o[1:step]]))::INT) AS kept,
               sum(n * (f[o[step]] AND NOT coalesce(list_bool_or([f[k] for k in o[1:step - 1]]), FALSE))::INT) AS removed,
               sum(n * (f[o[step]] AND coalesce(list_bool_or([f[k] for k in o[1:step - 1]]), FALSE))::INT) AS redundant,
               sum(n * (f[o[step]] AND list_sum([x::INT for x in f]) = 1)::INT) AS unique_fails,
               sum(good * (f[o[step]] AND NOT coalesce(list_bool_or([f[k] for k in o[1:step - 1]]), FALSE))::INT) AS good_lost,
               sum(toxic * (f[o[step]] AND NOT coalesce(list_bool_or([f[k] for k in o[1:step - 1]]), FALSE))::INT) AS toxic_lost
        FROM sets, steps GROUP BY part, o, step)
    SELECT part, array_to_string([substr('ABCDE', k, 1) for k in o], '') AS filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
           redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
           (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley
    FROM counted""",
    "op13_mixture": r"""
    WITH docs AS (
        SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
    sources AS (
        SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM docs GROUP BY source),
    filled AS (
        SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                  / (sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rate FROM sources),
    aims AS (
        SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * (SELECT max(rate) FROM filled)) AS target FROM filled),
    keys AS (
        SELECT doc_id, source, size, -ln((2 * ('0x' || substr(md5(concat(doc_id, ':', text)), 1, 13))::BIGINT + 1) / 9007199254740992.0::DOUBLE)
               / greatest(0.1::DOUBLE, (1.0::DOUBLE - least(1.0::DOUBLE, 10.0::DOUBLE * length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) / greatest(1, length(text))))
                                       * (len(list_distinct(string_split(text, chr(10))))::DOUBLE / len(string_split(text, chr(10))))) AS key
        FROM docs)
    SELECT doc_id, size, source_size, target,
           (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM (
        SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
               floor(target)::BIGINT - epochs * source_size AS rest,
               sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
        FROM keys AS k JOIN aims AS a ON k.source IS NOT DISTINCT FROM a.source)""",
    "op8_line_dedup": r"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM documents),
    masked AS (
        SELECT doc_id, line, pos, regexp_replace(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g') AS t
        FROM lines),
    cut AS (SELECT *, string_split_regex(t, '[\x20\x09-\x0D]+') AS w FROM masked WHERE regexp_matches(replace(t, '<*>', ''), '[^\x20\x09-\x0D]')),
    shaped AS (
        SELECT doc_id, pos, t, w, len(w) AS n, ceil((len(w) - 3) / 8)::BIGINT AS step,
               CASE WHEN len(w) >= 50 OR length(t) >= 300 THEN 2 WHEN len(w) >= 4 OR length(t) >= 24 THEN 3 ELSE 6 END AS need
        FROM cut),
    leaves AS (SELECT t, min(doc_id) AS first FROM shaped GROUP BY t HAVING count(DISTINCT doc_id) >= min(need)),
    paths AS (
        SELECT doc_id, pos, n, step, need, w, unnest([0, 1, 2, 3]) AS k, unnest([
            [n::VARCHAR, w[1], w[2], w[3]], [n::VARCHAR, w[1], w[2], NULL], [n::VARCHAR, w[1], NULL, w[3]], [n::VARCHAR, NULL, w[2], w[3]]]) AS path
        FROM shaped WHERE n >= 8),
    shared AS (SELECT k, path FROM paths GROUP BY k, path HAVING count(*) >= 3),
    routed AS (
        SELECT doc_id, pos, n, step, need, w, k, path FROM paths JOIN shared USING (k, path)
        QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY k) = 1),
    cells AS (
        SELECT doc_id, pos, n, step, need, k, path, unnest(range(0, (n - 4) // step + 1)) AS nth,
               unnest([w[4 + a * step : 3 + (a + 1) * step] for a in range(0, (n - 4) // step + 1)]) AS segment
        FROM routed),
    fixed AS (SELECT k, path, nth, segment FROM cells GROUP BY k, path, nth, segment HAVING count(*) >= 3),
    kept AS (
        SELECT doc_id, pos, n, need, k, path, list(struct_pack(nth := nth, segment := segment) ORDER BY nth) AS kept, sum(least(step, n - 3 - nth * step)) AS size
        FROM cells JOIN fixed USING (k, path, nth, segment) GROUP BY doc_id, pos, n, need, k, path),
    alike AS (SELECT * FROM kept WHERE size + 3 - least(k, 1) >= 0.75 * n),
    recurring AS (SELECT k, path, kept, min(doc_id) AS first FROM alike GROUP BY k, path, kept HAVING count(DISTINCT doc_id) >= min(need)),
    gone AS (
        SELECT doc_id, pos FROM shaped JOIN leaves USING (t) WHERE doc_id <> first
        UNION SELECT doc_id, pos FROM alike JOIN recurring USING (k, path, kept) WHERE doc_id <> first)
    SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL), '') AS text,
           count(*) AS n_lines, count(g.pos) AS n_dropped
    FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id""",
    "op10_chat_format": r"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum(length(role) + 6 + length(regexp_replace(text, '([\\#<])', '\\\1', 'g')) + 9)::BIGINT AS formatted_chars
    FROM turns GROUP BY conv_id""",
}
