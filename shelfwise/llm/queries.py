"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfwise.llm import embedding_dedup, exact_dedup, fim, language, mixing, ngram_join, packing, quality, sharding, spelling, substring_dedup, token_counts, warc
from shelfwise.llm.common import held_out, table
from shelfwise.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(fn):
        QUERIES[key] = fn
        if sql is not None:
            TWINS[key] = sql
        return fn

    return add


@query("op5_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
        sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


@query("op7_sharding")
def op7_sharding(spark, sf_dir):
    text = F.coalesce("text", F.lit("")).cast("binary")
    ids = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.shard(ids, shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op10_packing")
def op10_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")).drop("loss_tokens")


# e-mail addresses, long numbers, repeated marks
REDACTIONS = [(r"(?<![\w.+-])[\w.+-]+@[\w-]+\.[\w.]+", "@", "[mail]"), (r"(?<!\d)\d[\d\- ]{5,}\d", "", "[number]"), (r"[!#$%&*]{2,}", "", "")]


@query("op1_token_counts")
def op1_token_counts(spark, sf_dir):
    """Token counts of every document before and after its personal data and runs of marks are taken out."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    ranks, pattern = tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    trees = token_counts.build_trees(docs, ranks, pattern)
    return token_counts.apply_edits(trees, token_counts.redactions(docs, REDACTIONS), ranks, pattern, with_text=False)


@query("op2_mixing")
def op2_mixing(spark, sf_dir):
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"), [5.0, 2.0, 1.0])
    return mix.taken().join(F.broadcast(mix.sources.drop("source")), "source_no").select("doc_id", "size", "source_size", "target", "taken", "source")


@query("op3_embedding_dedup", """
    WITH RECURSIVE usable AS (
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER () AS k FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT a.k AS a, b.k AS b, a.vec_id AS a_id, b.vec_id AS b_id FROM usable a JOIN usable b ON a.label = b.label AND a.k <> b.k AND len(a.v) = len(b.v)
        WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
    reach AS (SELECT a_id AS vec_id, b_id AS other FROM links UNION SELECT r.vec_id, l.b_id FROM reach r JOIN links l ON l.a_id = r.other),
    least AS (SELECT vec_id, min(other) AS other FROM reach GROUP BY vec_id),
    counts AS (SELECT a_id AS vec_id, count(*) AS n FROM links GROUP BY a_id)
    SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(l.other, e.vec_id)) AS component_id,
        e.vec_id = least(e.vec_id, coalesce(l.other, e.vec_id)) AS kept
    FROM embeddings e LEFT JOIN counts c USING (vec_id) LEFT JOIN least l USING (vec_id)""")
def op3_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op4_language_id")
def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    # an eighth of the learning rows is set aside: the limit of rejection comes from texts that the model has not counted
    aside = F.coalesce(F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 4) % 8 == 0, F.lit(False)) & ~held_out()
    model = language.fit(docs.where(~held_out() & ~aside))
    scored = cut_lineage(language.identify(docs, model).withColumn("held_out", held_out()))
    return language.reject(scored, aside).select("doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected")


@query("op6_quality")
def op6_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~held_out()))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op9_ngram_join", r"""
    WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
    sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
    sizes AS (SELECT doc_id, len(s) AS n FROM sets),
    parts AS (SELECT doc_id, unnest(s) AS g FROM sets),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM parts a JOIN parts b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
    reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
    least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
    SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id FROM sizes LEFT JOIN least USING (doc_id)""")
def op9_ngram_join(spark, sf_dir):
    return ngram_join.similar_documents(table(spark, sf_dir, "documents"))


@query("op8_substring_dedup")
def op8_substring_dedup(spark, sf_dir):
    return substring_dedup.shared_passages(table(spark, sf_dir, "documents"))


@query("op11_fill_in_middle", r"""
    WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t,
        sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    drawn AS (SELECT *, len(t) AS n, list_transform(range(4), lambda i: CAST('0x' || substr(h, 1 + 8 * i, 8) AS BIGINT)) AS d FROM texts),
    formed AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 50 THEN 'plain'
        WHEN d[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b FROM drawn),
    parts AS (SELECT *, coalesce(array_to_string(t[1:a], ''), '') AS p, coalesce(array_to_string(t[a + 1:b], ''), '') AS m,
        coalesce(array_to_string(t[b + 1:], ''), '') AS s FROM formed)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
        sha256(text) AS restored_sha256 FROM parts""")
def op11_fill_in_middle(spark, sf_dir):
    out = fim.restored(fim.fill_in_middle(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


@query("op12_spelling_variants")
def op12_spelling_variants(spark, sf_dir):
    words = spelling.observed(table(spark, sf_dir, "documents"), least_length=5)  # slips only shorten
    return spelling.spelling_variants(spelling.vocabulary(words, least_length=5, least_count=3))


@query("op13_warc", """
    WITH digests AS (SELECT page_id, url, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
        first_value(page_id) OVER w AS first_id, row_number() OVER w AS nr
        FROM pages WINDOW w AS (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST, url NULLS LAST))
    SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
            1 + (((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS BIGINT)) >> (5 * (3 - i % 4))) & 31), 1)), '') AS payload_digest,
        CASE WHEN nr = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nr > 1 THEN first_id END AS refers_to
    FROM digests""")
def op13_warc(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    index = warc.write_archives(pages, warc.archive_folder(spark))
    return warc.read_archives(spark, index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
