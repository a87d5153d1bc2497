"""The queries opN_<name>: each applies its operator with production parameters to its whole table and returns the digest
columns of its contract. ``ORACLES`` has the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import automaton_dedup, collocations, decontam, fill_middle, jaccard_join, langid, mixing, packing, quality, suffix_dedup, token_count, topk, url_filter
from .common import id_crc, table

BLOCK, ALLOW = ["net/", "example.com/de/"], ["example.net/en/", "org/fr/"]


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each embedding whose id is divisible by 100, the 10 others that score highest. Null and broken vectors and null ids
    take no part; repeated rows are rows of their own; no embeddings, no rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors.filter(F.col("vec_id") % 100 == 0), vectors, k=10, scale=1024)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without windows of 50 words that one with a smaller id has. Null and empty texts have no
    words; rows of one id don't count against each other, and a null id neither loses nor takes; texts of any length."""
    kept = automaton_dedup.remove_substrings(table(spark, sf_dir, "documents"), min_words=50, with_text=False)
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document, learned from two thirds of the labels. Null and empty texts are scored too, equal texts
    alike; without a label of 1 every score is 0.5."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = quality.train(docs, labels, id_crc() % 3 != 1)
    scored = docs.select("doc_id", (id_crc() % 3 == 1).alias("held_out"), quality.quality_score(docs, net, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op4_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page. Null urls and those without ``://`` fit no rule and are allowed; repeated rows are judged alike."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), BLOCK, ALLOW).select("page_id", "host", "path", "rule", "verdict")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from four fifths of them. Texts that are null, empty or without a letter are
    ``und`` with score 0, as all are where nothing can be learned; repeated rows are judged alike."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(id_crc() % 5 != 0))
    found = docs.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), langid.predict(docs, model, F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document. Null and empty texts have none; texts and pre-tokens of any length count whole."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    counted = docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_count.token_count(F.col("text"), public_tokenizers.path("piece_bpe_32k.model")).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without strings of 200 bytes that occur again anywhere. Null and empty texts have no bytes;
    repeated rows lose all that is in such strings; texts of any length."""
    kept = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=200, with_text=False)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of each document by links of 85 % of four-word shingles. Null, empty and word-less texts link with nothing;
    repeated rows link as any others; a null id counts as 0."""
    groups = jaccard_join.linked_groups(table(spark, sf_dir, "documents"), width=4, percent=85)
    return groups.select("doc_id", "n_shingles", "component_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark windows in every document. Null and empty texts have no words; null items have no windows, items with a null
    id hit words but are not listed; repeated rows are judged alike."""
    docs = table(spark, sf_dir, "documents")
    found = decontam.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"), "h", with_spans=False)
    return found.select(
        "doc_id",
        "h.n_words",
        "h.n_hit",
        F.size("h.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("h.items", ",").cast("binary"), 256).alias("items_sha256"),
        decontam.is_contaminated(F.col("h")).alias("contaminated"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of every document. Null and empty texts have size 0; a null source is a source; repeated rows
    are documents of their own; no words at all, no targets."""
    mix = mixing.fair_queue(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of two or three words of each language. Null and empty texts have no words, a null language is
    ``und``; repeated rows count again, and texts of any length count whole."""
    return collocations.collocations(table(spark, sf_dir, "documents"), max_words=3, min_count=10, top=2000, percent=50)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each token of every document is packed. Null and empty texts are the end token alone; repeated rows and null ids are
    documents of their own, and texts of any length are packed whole."""
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a fill-in-the-middle example, and the text got back from it. Null and empty texts and those with a mark
    stay plain; a null id counts as an empty one, equal rows come out alike, and texts of any length are cut whole."""
    made = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"), "f", seed=1, plain_percent=10, spm_percent=20)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "f.n", "f.form", "f.prefix_chars", "f.middle_chars",
        digest(F.col("f.output")).alias("output_sha256"),
        digest(fill_middle.restored(F.col("f.output"), F.col("f.form"))).alias("restored_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_topk, op2_substring_dedup, op3_quality, op4_url_cascade, op5_langid, op6_token_count, op7_suffix_array, op8_jaccard_join, op9_decontamination, op10_mixing,
        op11_collocations, op12_packing, op13_fill_middle,
    )
}

ORACLES = {
    "op1_topk": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
""",
    "op4_url_cascade": r"""
WITH p AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(h, d, v))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM (SELECT p.*, h || d AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || d) DESC) AS n
      FROM p LEFT JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, d)) WHERE n = 1
""",
    "op10_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
i AS (SELECT *, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1 AS i FROM s),
w AS (SELECT *, (i % 3 + 1)::DOUBLE AS weight, 3 * source_size AS cap, 3 * source_size / (i % 3 + 1)::DOUBLE AS ratio FROM i),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used,
             sum(weight) OVER (ORDER BY ratio, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, (sum(source_size) OVER ())::BIGINT AS total FROM w),
l AS (SELECT (total - used) / open AS level FROM c WHERE ratio * open >= total - used ORDER BY ratio, i LIMIT 1),
t AS (SELECT source, source_size, least(cap::DOUBLE, level * weight) AS target FROM c, l),
r AS (SELECT d.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
v AS (SELECT r.*, epoch, (epoch * source_size + start + size) / target AS finish FROM r, (VALUES (0), (1), (2)) e(epoch) WHERE size > 0),
b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY finish, k, start, epoch, encode(source) NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(size) OVER () // 3 AS budget FROM v),
g AS (SELECT source, start, sum(least(size, budget - before)) AS words FROM b WHERE before < budget GROUP BY source, start)
SELECT doc_id, size, source_size, target, coalesce(words, 0)::BIGINT AS taken
FROM r LEFT JOIN g ON size > 0 AND r.source IS NOT DISTINCT FROM g.source AND r.start = g.start
""",
    "op11_collocations": r"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
           FROM (SELECT coalesce(lang, 'und') AS lang,
                        unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase
      FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM p, (VALUES (1), (2), (3)) s(m))),
f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS a FROM g GROUP BY lang, m, phrase),
t AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE m > 1 AND a >= 10),
k AS (SELECT lang, m, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:m], ' ') AS rest
      FROM c, (VALUES (1), (2)) s(k) WHERE k < m),
s AS (SELECT k.lang, k.m, k.phrase, k.a, k.k, x.a AS l, y.a AS r, 1000000 * k.a * k.a // (x.a * y.a) AS score
      FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.head JOIN f y ON y.lang = k.lang AND y.phrase = k.rest),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS i FROM s) WHERE i = 1),
h AS (SELECT lang, unnest([string_split(phrase, ' ')[1] || ' ' || string_split(phrase, ' ')[2], string_split(phrase, ' ')[2] || ' ' || string_split(phrase, ' ')[3]]) AS phrase, a FROM c WHERE m = 3),
d AS (SELECT lang, phrase, max(a) AS longest FROM h GROUP BY lang, phrase),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, encode(b.phrase)) AS rank
      FROM b LEFT JOIN d ON d.lang = b.lang AND d.phrase = b.phrase WHERE d.longest IS NULL OR 100 * d.longest < 50 * b.a)
SELECT o.lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM o JOIN t ON t.lang = o.lang WHERE rank <= 2000
""",
    "op13_fill_middle": r"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
d AS (SELECT *, ('0x' || s[1:8])::BIGINT % (n + 1) AS c1, ('0x' || s[9:16])::BIGINT % (n + 1) AS c2, ('0x' || s[17:24])::BIGINT % 100 AS h3, ('0x' || s[25:32])::BIGINT % 100 AS h4 FROM h),
f AS (SELECT *, least(c1, c2) AS x, greatest(c1, c2) AS y,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
o AS (SELECT *, substring(t, 1, x) AS p, substring(t, x + 1, y - x) AS m, substring(t, y + 1, n - y) AS e FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || e || '<M>' || m ELSE '<S>' || e || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || e END) AS restored_sha256
FROM o
""",
}
