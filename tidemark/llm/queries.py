"""The registered queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    embedding_dedup,
    jaccard_join,
    language_id,
    license_scan,
    line_frequency,
    mixing,
    packing,
    pitman_yor,
    ranked_search,
    secret_scan,
    spelling,
    token_counts,
    toxicity,
)


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All ``embeddings`` linked at a cosine of 0.9, whatever their labels."""
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"), threshold=0.9)


def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of ``documents`` linked at 90 % Jaccard similarity of 3-word shingles."""
    return jaccard_join.jaccard_classes(table(spark, folder, "documents"), width=3, percent=90)


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licences that ``documents`` are or name."""
    return license_scan.license_scan(table(spark, folder, "documents"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of ``documents`` under the 32k piece model."""
    path = tokenizer_file("piece_bpe_32k.model")
    return token_counts.count_tokens(table(spark, folder, "documents"), path, limit=4096)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity scores of ``documents``, learned from ``labels``."""
    return toxicity.toxic_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` mixed over sources, the smallest passed over at most twice for each pass over the largest."""
    mixed = mixing.mix(table(spark, folder, "documents"), max_repeat=2.0)
    return mixed.select("doc_id", "source", "n_tokens", "weight", "epoch", "block", "place")


def op7_line_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality counts and boilerplate verdicts of ``documents``; the source stands for the host."""
    return line_frequency.line_quality(table(spark, folder, "documents"))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of ``documents``, learned from their lang column outside the held-out fold."""
    return language_id.languages(table(spark, folder, "documents"))


def op9_best_two_fit(spark: SparkSession, folder: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 2048 tokens."""
    path = tokenizer_file("word_bpe_49k.json")
    pieces = packing.token_pieces(table(spark, folder, "documents"), path, capacity=2048, end_id=0)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=2048)


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in ``documents``; each distinct text is a repository and its source the owner."""
    found = secret_scan.scan_documents(table(spark, folder, "documents"))
    return found.withColumn("base_sha256", F.sha2(F.col("base_spans").cast("binary"), 256)).drop("base_spans")


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of ``documents``, some misspelt by rule, with the frequent words they are variants of."""
    return spelling.spelling_variants(spelling.noisy_word_counts(table(spark, folder, "documents")))


def op12_best_position(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 ``documents`` that rank highest for each ``benchmark`` item."""
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=20)


def op13_pitman_yor(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probabilities of ``documents`` under a Pitman-Yor model of the rows outside the held-out fold."""
    return pitman_yor.corpus_scores(table(spark, folder, "documents"))


QUERIES = {
    query.__name__: query
    for query in (
        op1_embedding_dedup,
        op2_jaccard_join,
        op3_license_scan,
        op4_token_counts,
        op5_toxicity,
        op6_mixing,
        op7_line_quality,
        op8_language_id,
        op9_best_two_fit,
        op10_secret_scan,
        op11_spelling_variants,
        op12_best_position,
        op13_pitman_yor,
    )
}

_TERMS = r"""unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"""

ORACLES: dict[str, str] = {
    "op11_spelling_variants": r"""
WITH RECURSIVE crc_steps AS (
    SELECT i, 0 AS step, i::UBIGINT AS c FROM range(256) t(i)
    UNION ALL
    SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END
    FROM crc_steps WHERE step < 8),
crc_table AS (SELECT list(c ORDER BY i) AS crc FROM crc_steps WHERE step = 8),
runs AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
    FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL HAVING length(run) >= 7),
hashed AS (
    SELECT run, n, xor(list_reduce(
        [4294967295::UBIGINT] || list_transform(
            string_split(trim(regexp_replace(hex(encode(doc_id || ':' || run)), '(..)', '\1 ', 'g')), ' '),
            lambda x: ('0x' || x)::UBIGINT),
        lambda c, b: xor(c >> 8, crc[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS h
    FROM counted, crc_table),
words AS (
    SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, n FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gaps AS (SELECT word, i, word[:i] || word[i + 2:] AS gap FROM words, unnest(range(length(word))) t(i)),
pairs AS (
    SELECT a.word, b.word AS near FROM gaps a JOIN gaps b ON a.i = b.i AND a.gap = b.gap AND a.word <> b.word
    UNION SELECT word, gap FROM gaps SEMI JOIN words w ON gap = w.word
    UNION SELECT gap, word FROM gaps SEMI JOIN words w ON gap = w.word),
nears AS (
    SELECT p.word, count(*) AS n_near, max(w.n) AS most, arg_min(near, (-w.n, near)) AS best
    FROM pairs p JOIN words w ON w.word = near GROUP BY p.word),
forms AS (
    SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 10 * n THEN best END AS form,
        CASE WHEN most >= 10 * n THEN most END AS form_n
    FROM words LEFT JOIN nears USING (word)),
chains AS (
    SELECT word, word AS tip, 0 AS step FROM forms
    UNION ALL SELECT c.word, f.form, step + 1 FROM chains c JOIN forms f ON f.word = c.tip WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(tip, step) AS root FROM chains GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
""",
    "op12_best_position": f"""
WITH words AS (SELECT doc_id, {_TERMS} FROM documents),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM lengths),
sizes AS (SELECT doc_id, 75 + (25 * n * docs) // total AS m FROM lengths, corpus),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words SEMI JOIN asked USING (term) GROUP BY ALL),
weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM postings, corpus GROUP BY term),
scored AS (
    SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM asked JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id)
    GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 20
""",
}
