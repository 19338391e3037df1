"""Registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versehall.llm import adaptive_ann, byte_bpe, consensus_html, conversation_repair, exact_topk, language_id, near_dup, prefix_trie, source_mix, surrogates, token_counts, toxicity, warc
from versehall.llm.common import own_path, table

RANKS = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, and every document with its source in the place of a host."""
    docs = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    where = language_id.address(F.col("url"))
    pages = table(spark, sf_dir, "pages").select(F.lit(None).cast("long").alias("doc_id"), "page_id", F.col("html").alias("text"), *[c.alias(k) for k, c in where.items()], language_id.declared(F.col("html")).alias("declared"))
    rows = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.concat(F.lit("source "), "source").alias("host"), none.alias("domain"), none.alias("suffix"), none.alias("code"), none.alias("declared"))
    return language_id.identify(pages.unionByName(rows), docs.select("text", "lang"), F.col("page_id").isNotNull(), F.col("page_id").isNull())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = surrogates.pseudonymise(docs, surrogates.session_key(spark))
    return done.select("doc_id", "text", "n_entities")


def op4_adaptive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_consensus_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus_html.extract(table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = own_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prefix_trie.turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(*prefix_trie.grafted(rows))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversation_repair.damaged(rows), rows)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_surrogates, op4_adaptive_ann, op5_consensus_html, op6_warc, op7_exact_topk, op8_byte_bpe, op9_source_mix, op10_near_dup, op11_prefix_trie, op12_conversation_repair, op13_token_counts)}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"



def _crc(text: str) -> str:
    """CRC-32 of a text of ASCII characters, in DuckDB's SQL."""
    bits = "list_reduce(list_prepend(xor(c, b), [0::BIGINT for _ in range(8)]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split({text}, '')]), lambda c, b: {bits}), 4294967295::BIGINT)"


def _repair_sql() -> str:
    """Costs to the end row by row from the last one, in each state with the edits and the repaired lines."""
    behind, role = [2, 2, 3, 2], ["user", "user", "assistant", "user"]
    keep = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    base, once, twice = [], [], []
    for q in range(4):
        to = "CASE" + "".join(f" WHEN x.initial = '{r}' THEN b.b{k}" for r, k in keep[q].items()) + " END"
        ways = [f"{{'c': b.b{q}.c + 4, 'a': 'D' || b.b{q}.a, 'r': b.b{q}.r}}"]
        ways += [f"CASE WHEN NOT x.must AND ({to}) IS NOT NULL THEN {{'c': ({to}).c + x.pen, 'a': 'K' || ({to}).a, 'r': chr(10) || x.role || ':' || x.text || ({to}).r}} END"]
        n = f"b.b{behind[q]}"
        ways += [f"CASE WHEN NOT x.must THEN {{'c': {n}.c + 3 + x.pen, 'a': 'R' || {n}.a, 'r': chr(10) || '{role[q]}:' || x.text || {n}.r}} END"]
        base.append(f"list_sort(list_filter([{', '.join(ways)}], lambda y: y IS NOT NULL))[1] AS b{q}")
        more = [f"list_sort([z{i}.b{q}, {{'c': z{i}.b{behind[q]}.c + 3, 'a': 'I' || z{i}.b{behind[q]}.a, 'r': chr(10) || '{role[q]}:' || z{i}.b{behind[q]}.r}}])[1] AS b{q}" for i in (1, 2)]
        once.append(more[0])
        twice.append(more[1])
    end = ["{'c': 0::BIGINT, 'a': '', 'r': ''}", "{'c': 6::BIGINT, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}", "{'c': 3::BIGINT, 'a': 'I', 'r': chr(10) || 'assistant:'}", "{'c': 0::BIGINT, 'a': '', 'r': ''}"]
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
        WITH RECURSIVE s AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations),
        d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
                     CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
              FROM (SELECT *, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) FROM s WHERE k <> 0)),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS t, rtrim(text, {space}) AS shown, left(role, 1) AS initial FROM d),
        f AS (SELECT *, CASE WHEN shown = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY t) > 1 THEN 'd' WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
                     coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY t) || initial NOT IN ('su', 'ua', 'au'), false) AS odd FROM o),
        x AS MATERIALIZED (SELECT conv_id, t, role, text, initial, fault IN ('b', 'd') AS must, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS pen FROM f),
        b AS (SELECT conv_id, max(t) + 1 AS t, {", ".join(f"{e} AS b{q}" for q, e in enumerate(end))} FROM x GROUP BY conv_id
              UNION ALL SELECT conv_id, t, {", ".join(twice)} FROM (SELECT conv_id, t, {", ".join(once)} FROM (SELECT x.conv_id, x.t, {", ".join(base)}
              FROM b JOIN x ON x.conv_id IS NOT DISTINCT FROM b.conv_id AND x.t = b.t - 1) z1) z2),
        c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                     count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (odd) AS illegal FROM f GROUP BY conv_id)
        SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(b.b0.c, 0) AS cost, coalesce(b.b0.a, '') AS audit, sha256(coalesce(substr(b.b0.r, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM i.conv_id AND b.t = 1"""


SQL: dict[str, str] = {
    "op9_source_mix": rf"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {_WORDS}))::BIGINT AS size,
                          ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS u FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS ss, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
        w AS (SELECT source, ss, [3.0::DOUBLE, 1.0, 2.0][place % 3 + 1] AS w, ss * 2.0::DOUBLE AS cap, (SELECT sum(ss) FROM s)::DOUBLE * 1.5::DOUBLE AS whole FROM s),
        o AS (SELECT *, whole - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                     sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
        c AS (SELECT *, w * rest / free > cap AS clamped FROM o),
        t AS (SELECT source, ss, CASE WHEN clamped THEN cap ELSE w * (whole - (SELECT coalesce(sum(cap), 0) FROM c WHERE clamped)) / (SELECT sum(w) FROM c WHERE NOT clamped) END AS target FROM c),
        g AS (SELECT source, u, sum(size) AS gs FROM d GROUP BY source, u),
        k AS (SELECT source, u, gs, sum(gs) OVER (PARTITION BY source ORDER BY u) AS upto FROM g)
        SELECT d.doc_id, d.size, t.ss AS source_size, t.target,
               (d.size * (floor(t.target / t.ss) + (k.upto - k.gs / 2 <= t.target - floor(t.target / t.ss) * t.ss AND t.target > floor(t.target / t.ss) * t.ss)::INT))::BIGINT AS taken
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN k ON k.u = d.u AND k.source IS NOT DISTINCT FROM d.source""",
    "op10_near_dup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
              ELSE [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] END) AS sh FROM w)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r AS (SELECT doc_id AS v, doc_id AS m FROM documents UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.v),
        m AS (SELECT v, min(m) AS m FROM r GROUP BY v)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id, doc_id = m AS kept FROM documents JOIN m ON v = doc_id LEFT JOIN n USING (doc_id)""",
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS s FROM p),
        f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY s) ELSE page_id END AS first FROM d)
        SELECT page_id, n::BIGINT AS payload_bytes, s AS payload_digest,
               CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
    "op7_exact_topk": """
        WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) for x in embedding] AS q FROM embeddings
                   WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
              FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 20""",
    "op11_prefix_trie": rf"""
        WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        d AS (SELECT *, md5(length(role) || ':' || role || text) AS d, len(regexp_extract_all(text, {_WORDS}))::BIGINT AS words FROM t),
        k AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) AS pos FROM d),
        n AS (SELECT c, count(*) AS n, {_crc("c::VARCHAR")} % 4 AS h, c - c % 20 AS base FROM k GROUP BY c),
        g AS (SELECT n.*, least(n.h, coalesce(b.n, 0)) AS nb FROM n LEFT JOIN n b ON b.c = n.base),
        r AS (SELECT g.c, k.pos AS i, k.d, k.words FROM g JOIN k ON k.c = g.base AND k.pos <= g.h
              UNION ALL SELECT g.c, k.pos - g.h + g.nb, k.d, k.words FROM g JOIN k ON k.c = g.c AND k.pos > g.h),
        p AS (SELECT c, i, words, string_agg(d, ',') OVER (PARTITION BY c ORDER BY i ROWS UNBOUNDED PRECEDING) AS path FROM r
              UNION ALL SELECT c, 0, 0, '' FROM g),
        q AS (SELECT *, CASE WHEN i > 0 THEN substr(path, 1, greatest(33 * (i - 1) - 1, 0)) END AS above FROM p),
        v AS (SELECT path, i, any_value(above) AS above, min(c) AS c, count(*) AS n_convs, any_value(words) AS words FROM q GROUP BY path, i),
        ch AS (SELECT above AS path, count(*) AS n_children FROM v WHERE i > 0 GROUP BY above),
        w AS (SELECT v.*, coalesce(ch.n_children, 0) AS n_children FROM v LEFT JOIN ch USING (path)),
        s AS (SELECT a.path, sum((w.n_children = 0)::BIGINT) AS n_leaves, sum((w.n_convs - 1) * w.words) AS saved FROM w JOIN p a ON a.c = w.c AND a.i <= w.i GROUP BY a.path),
        l AS (SELECT c, max(i) AS i FROM p GROUP BY c),
        e AS (SELECT p.path, string_agg(p.c::VARCHAR, ',' ORDER BY p.c) AS ids FROM p JOIN l USING (c, i) GROUP BY p.path)
        SELECT w.c AS conv_id, w.i AS depth, u.c AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
        FROM w JOIN s USING (path) LEFT JOIN v u ON u.path = w.above LEFT JOIN e ON e.path = w.path""",
    "op12_conversation_repair": _repair_sql(),
}
