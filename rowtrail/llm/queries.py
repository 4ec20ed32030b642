"""Registered queries of the operators in this folder, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from rowtrail.llm import alignment, ann, bpe, conversations, decontam, langid, lines, near_dups, neighbours, rollups, secrets, tokenfile, toxicity
from rowtrail.llm.common import table, written

WORD_BPE_IDS = 49_408


def op1_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf, "documents")))


def op2_token_file(spark: SparkSession, sf: str) -> DataFrame:
    read = tokenfile.round_trip(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), WORD_BPE_IDS)
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_language(spark: SparkSession, sf: str) -> DataFrame:
    model = langid.train(table(spark, sf, "documents"), "lang")
    pages = langid.page_evidence(table(spark, sf, "pages"))
    return langid.identify(pages, model).withColumnRenamed("id", "page_id")


def op4_near_dups(spark: SparkSession, sf: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf, "documents"))


def op5_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return ann.nearest(table(spark, sf, "embeddings"))


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = toxicity.train(docs, labels.filter(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    file = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe.decode(bpe.encode(table(spark, sf, "documents"), file, public_tokenizers.PATTERN), file)
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_token_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of all documents: estimates are loaded, then revised; repeated texts are deleted again."""
    counted = written(rollups.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json")))
    estimate = counted.withColumn("n_tokens", F.ceil(F.col("n_chars") / 4))
    words = counted.withColumn("n_tokens", F.col("n_words"))
    first = counted.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    again = counted.join(first, "doc_id", "left_anti")
    roll = rollups.TokenRollup(spark)
    roll.commit("load", rollups.change_rows(words, "words", "insert").unionByName(rollups.change_rows(estimate, "word_bpe_49k", "insert")))
    roll.commit("recount", rollups.change_rows(counted, "word_bpe_49k", "revise"))
    gone = rollups.change_rows(again, "words", "delete").unionByName(rollups.change_rows(again, "word_bpe_49k", "delete"))
    roll.commit("repeats", gone)
    roll.compact()
    roll.commit("repeats", gone)  # a repeated batch changes nothing
    return roll.totals()


def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op11_vector_near_dups(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.near_vectors(table(spark, sf, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, sf, "conversations")))


def op13_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.align(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_token_file, op3_language, op4_near_dups, op5_nearest, op6_toxicity, op7_byte_bpe, op8_token_rollup,
        op9_line_dedup, op10_decontamination, op11_vector_near_dups,
        op12_conversation_repair, op13_token_alignment,
    )
}

_WHITE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _more(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """A state's cheapest edits, extended by one."""
    lines = f"list_append({state}.b, {line})" if line else f"{state}.b"
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'b': {lines}}} END"


def _best(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"


def _repair_sql() -> str:
    """Least edits from the first row on: one step of the recursion takes the next row of every conversation."""
    keep = lambda q, role: f"CASE WHEN initial = '{role}' AND NOT gone THEN {_more(q, 'cut', 'K', 'line')} END"
    change = lambda q, role: f"CASE WHEN NOT gone THEN {_more(q, '1 + cut', 'R', chr(39) + role + ':' + chr(39) + ' || text')} END"
    user, reply = "'user:'", "'assistant:'"
    return f"""
        WITH RECURSIVE raw AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
        hashed AS (
            SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
                lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, d: xor(c >> 1, 3988292384 * (c & 1)))),
                4294967295::BIGINT) % 20 AS kind FROM raw),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                unnest(CASE kind WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM hashed),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
                trim(text, {_WHITE}) AS body, left(role, 1) AS initial FROM damaged),
        faulty AS (
            SELECT *, body = '' AS blank, body <> '' AND seen > 1 AS again, body <> '' AND seen = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
                lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal FROM placed),
        rows_ AS (SELECT *, blank OR again AS gone, CASE WHEN truncated THEN 5 ELSE 0 END AS cut, role || ':' || text AS line FROM faulty),
        best AS (
            SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 'b': []::VARCHAR[]}} AS s0, NULL::STRUCT(c INTEGER, a VARCHAR, b VARCHAR[]) AS s1,
                {{'c': 5, 'a': 'I', 'b': [{user}]}} AS s2, {{'c': 10, 'a': 'II', 'b': [{user}, {reply}]}} AS s3 FROM raw
            UNION ALL
            SELECT conv_id, i, n0, n1, m2, {_best('n3', _more('m2', '5', 'I', reply))} FROM (
                SELECT *, {_best('n2', _more('n0', '5', 'I', user), _more('n1', '5', 'I', user), _more('n3', '5', 'I', user))} AS m2 FROM (
                    SELECT b.conv_id, r.i, {_more('s0', '2', 'D')} AS n0, {_best(_more('s1', '2', 'D'), keep('s0', 's'))} AS n1,
                        {_best(_more('s2', '2', 'D'), *(f(q, x) for q in ('s0', 's1', 's3') for f, x in ((keep, 'u'), (change, 'user'))))} AS n2,
                        {_best(_more('s3', '2', 'D'), keep('s2', 'a'), change('s2', 'assistant'))} AS n3
                    FROM best b JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1))),
        done AS (SELECT conv_id, {_best('s0', 's3')} AS x FROM best QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
        counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (blank)::BIGINT AS blank,
                count(*) FILTER (again)::BIGINT AS duplicate, count(*) FILTER (truncated)::BIGINT AS truncated, count(*) FILTER (illegal)::BIGINT AS illegal
            FROM rows_ GROUP BY conv_id)
        SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
            coalesce(illegal, 0) AS illegal, x.c::BIGINT AS cost, x.a AS audit, sha256(array_to_string(x.b, chr(10))) AS repaired_sha256
        FROM done d LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM d.conv_id"""


ORACLES = {
    "op11_vector_near_dups": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
              AND list_cosine_similarity(a.e, b.e) >= 0.9),
        reached AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reached r JOIN l ON l.a = r.other),
        c AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id)
        SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id)::BIGINT AS n_links, component_id, c.vec_id = component_id AS kept FROM c""",
    "op12_conversation_repair": _repair_sql(),
    "op9_line_dedup": """
        WITH l AS (
            SELECT doc_id, i, x, translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
            FROM (SELECT doc_id, unnest(x) AS x, generate_subscripts(x, 1) AS i
                  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
        o AS (SELECT *, length(k) < 10 OR doc_id = min(doc_id) OVER (PARTITION BY k) AS stays FROM l)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (NOT stays)::BIGINT AS n_dropped,
            sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (stays), '')) AS kept_sha256
        FROM o GROUP BY doc_id""",
}
