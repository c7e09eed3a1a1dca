"""Registered queries of this subpackage: each operator over its whole table, and the pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import exact_dedup as dedup
from tidemark.llm import alignment, language, mixing, packing, prefix_trie, secrets, simhash, substrings, token_store, topk, toxicity, warc
from tidemark.llm.common import ascii_lower, crc_mod, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

WORD_TOKENIZER, WORD_END = "word_bpe_49k.json", 2
BYTE_TOKENIZER, BYTE_END = "byte_bpe_50k.json", 0
PIECE_TOKENIZER = "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    docs, held_out = table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, model, keep=[held_out.alias("held_out")])


@query("op2_language")
def op2_language(spark, sf_dir):
    docs, held_out = table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 3) == 1
    return language.predict(docs, language.fit(docs, ~held_out), keep=[held_out.alias("held_out")])


@query("op3_exact_dedup", f"""
    WITH t AS (SELECT doc_id, {_LOWER} AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY t)""")
def op3_exact_dedup(spark, sf_dir):
    digest = F.sha2(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), 256)
    out = dedup.exact_dedup(table(spark, sf_dir, "documents"), extra={"text_sha256": digest})
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op4_secret_scan")
def op4_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = secrets.find_secrets(docs, secrets.fit(secrets.labelled_strings(docs)))
    base = F.filter("found", lambda s: s["kind"] != "markov")
    return found.select("doc_id", *[secrets.count_kind(F.col("found"), k).alias(f"n_{k}") for k in secrets.BASE],
                        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("found")).alias("spans"))


@query("op5_mixing", r"""
    WITH sized AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             md5('mix' || doc_id) AS k FROM documents),
    sources AS (
      SELECT source, sum(size)::BIGINT AS s, [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS w
      FROM sized GROUP BY source),
    filled AS (
      SELECT *, sum(s) OVER o - s AS sb, sum(w) OVER o - w AS wb, sum(s) OVER () AS st, sum(w) OVER () AS wt
      FROM sources WINDOW o AS (ORDER BY s / w, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
    marked AS (SELECT *, 2 * s * (wt - wb) <= w * (1.5 * st - 2 * sb) AS is_full FROM filled),
    targets AS (
      SELECT source, s::BIGINT AS source_size, CASE WHEN is_full THEN (2 * s)::DOUBLE ELSE
        (1.5 * st - 2 * (st - sum(s) FILTER (NOT is_full) OVER ()))::DOUBLE * w / (sum(w) FILTER (NOT is_full) OVER ())::DOUBLE END AS target
      FROM marked),
    placed AS (
      SELECT doc_id, size, source_size, target, round(target)::BIGINT AS want,
             (sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before
      FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
      (CASE WHEN source_size > 0 THEN want // source_size ELSE 0 END * size
       + greatest(0, least(size, CASE WHEN source_size > 0 THEN want % source_size ELSE 0 END - before)))::BIGINT AS taken
    FROM placed""")
def op5_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op6_token_store")
def op6_token_store(spark, sf_dir):
    return token_store.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(WORD_TOKENIZER), WORD_END)


@query("op7_simhash")
def op7_simhash(spark, sf_dir):
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query("op8_warc", """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    f AS (SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN payload_bytes >= 100 AND first != page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 100 AND first != page_id THEN first END AS refers_to
    FROM f""")
def op8_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("intact")


@query("op9_topk", """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
          FROM v q JOIN v c ON c.vec_id != q.vec_id WHERE q.vec_id % 100 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op9_topk(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op10_packing")
def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER), BYTE_END)


@query("op11_substring_dedup", r"""
    WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    n AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM l),
    s AS (SELECT doc_id, word, i, string_agg(word, ' ') OVER a AS win, count(*) OVER a AS n
          FROM n WINDOW a AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
    m AS (SELECT doc_id, word, i, n = 13 AND doc_id > min(doc_id) OVER (PARTITION BY win) AS later FROM s),
    c AS (SELECT doc_id, word, i, bool_or(later) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM m),
    k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
          FROM c GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM documents d LEFT JOIN k USING (doc_id)""")
def op11_substring_dedup(spark, sf_dir):
    out = substrings.drop_repeated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op12_alignment")
def op12_alignment(spark, sf_dir):
    out = alignment.aligned(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_TOKENIZER), tokenizer_path(PIECE_TOKENIZER), digest=True)
    return out.withColumnRenamed("groups", "groups_sha256")


# crc32 of the decimal id, bit by bit
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, u: xor(v >> 1, (v & 1) * 3988292384)))"""


@query("op13_prefix_trie", rf"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
    o AS (
      SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS p, k, words
      FROM (SELECT *, sha256(length(r)::VARCHAR || ':' || r || x) AS k, len(regexp_extract_all(x, '[^ 	-
]+')) AS words FROM t)),
    c AS (
      SELECT conv_id, conv_id - conv_id % 20 AS base, xor({_CRC}, 4294967295) % 4 AS h, n
      FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id)),
    b AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(d.n, 0)) AS head FROM c LEFT JOIN c d ON d.conv_id = c.base),
    r AS (
      SELECT b.conv_id, p AS d, k, words FROM b JOIN o ON o.conv_id = b.base AND p <= head
      UNION ALL SELECT b.conv_id, p - h + head, k, words FROM b JOIN o ON o.conv_id = b.conv_id AND p > h),
    l AS (SELECT b.conv_id, count(k) AS n FROM b LEFT JOIN r USING (conv_id) GROUP BY b.conv_id),
    m AS (
      SELECT conv_id, d, words, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d) AS path, n FROM r JOIN l USING (conv_id)
      UNION ALL SELECT conv_id, 0, 0, '', n FROM l),
    nodes AS (
      SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(words) AS saved, max(n) = d AS leaf,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
      FROM m GROUP BY d, path)
    SELECT any_value(a.conv_id) AS conv_id, a.d::BIGINT AS depth, any_value(u.conv_id) AS parent_conv_id, any_value(a.n_convs) AS n_convs,
           count(*) FILTER (s.d = a.d + 1) AS n_children, count(*) FILTER (s.leaf) AS n_leaves, sum(s.saved)::BIGINT AS saved_tokens,
           any_value(a.ends_sha256) AS ends_sha256
    FROM nodes a LEFT JOIN nodes u ON u.d = a.d - 1 AND u.path = left(a.path, length(a.path) - 64)
    JOIN nodes s ON s.d >= a.d AND starts_with(s.path, a.path) GROUP BY a.d, a.path""")
def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


