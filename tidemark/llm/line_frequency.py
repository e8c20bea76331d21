"""Quality rules by cross-document line frequency, in DataFrame functions only.

Lines that many documents of a host share (menus, notices) are boilerplate: their words are taken off, and a document
with too little left is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
#: A line is boilerplate in more documents of its host than MAX_DOCS and more than this share of them.
MAX_DOCS, MAX_SHARE = 20, 0.001
#: A kept document has so many words outside boilerplate, and so large a share of its words.
MIN_WORDS, MIN_SHARE = 50, 0.5


def _texts(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    host = F.coalesce(F.col(host_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("id"), host.alias("host"), text.alias("text"), F.xxhash64(text).alias("key")
    )


def base_counts(texts: DataFrame) -> DataFrame:
    """Counts over the words and lines of each text, row by row, without a shuffle.

    Repeated words: the hashes of all 3-word windows are sorted with their places, so that equal windows are
    neighbours; their places and the two after each are the words counted.
    """
    words = F.array_remove(F.split("text", _SPACE), "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(_WORD))
    step = texts.withColumns({"words": words, "lines": lines}).withColumns(
        {
            "windows": F.when(
                F.size("words") >= 3,
                F.transform(
                    F.slice("words", F.lit(1), F.size("words") - 2),
                    lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)),
                ),
            ),
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        }
    )
    step = step.withColumn("sorted", F.sort_array("windows")).withColumn(
        "some", F.exists(F.transform("sorted", lambda h, i: F.get("sorted", i + 1) == h), lambda x: x)
    )
    step = step.withColumn(
        "places", F.when(F.col("some"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    )
    again = F.filter(
        "places",
        lambda x, i: F.coalesce(F.get("places", i - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get("places", i + 1)["h"] == x["h"], F.lit(False)),
    )
    covered = F.flatten(F.transform(again, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    repeated = F.when(F.col("some"), F.size(F.array_distinct(covered))).otherwise(0)
    return step.withColumn("n_repeat_words", repeated.cast("long")).select(
        "id", "key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"
    )


def line_quality(
    docs: DataFrame,
    max_docs: int = MAX_DOCS,
    max_share: float = MAX_SHARE,
    min_words: int = MIN_WORDS,
    min_share: float = MIN_SHARE,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """Base counts, ``n_line_words`` (words in boilerplate lines), ``base_failed`` and ``kept`` for every row.

    Lines are lower-cased, white space and digits unified, and hashed. A line is boilerplate if more than ``max_docs``
    distinct documents of its host have it, and more than ``max_share`` of its distinct documents, so the larger of the
    two limits rules; equal texts are one document, and texts without words are none. Null hosts are one host. Null and empty texts have no words and are not kept. Repeated rows come back as often as given.
    """
    texts = _texts(docs, id_col, text_col, host_col)
    normal = F.regexp_replace(F.regexp_replace(F.lower(F.trim("line")), _SPACE, " "), "[0-9]+", "0")
    lines = (
        texts.select("id", "host", "key", F.explode(F.filter(F.split("text", "\n"), lambda x: x.rlike(_WORD))).alias("line"))
        .select("id", "host", "key", F.xxhash64(normal).alias("hash"), F.size(F.array_remove(F.split("line", _SPACE), "")).alias("n"))
    )
    # Copies and texts without words are no documents of their own, here as in the counts of lines.
    worded = texts.where(F.col("text").rlike(_WORD)).select("host", "key").distinct()
    hosts = worded.groupBy("host").agg(F.count("*").alias("texts"))
    frequent = (
        lines.select("host", "hash", "key")
        .distinct()
        .groupBy("host", "hash")
        .agg(F.count("*").alias("docs"))
        .where(F.col("docs") > max_docs)
        .join(hosts, "host")
        .where(F.col("docs") > max_share * F.col("texts"))
        .select("host", "hash", F.lit(True).alias("often"))
    )
    # Shares of words are the same whether a row stands once or several times in the table.
    removed = (
        lines.join(small(frequent), ["host", "hash"], "left")
        .groupBy(F.col("id").alias("line_id"), F.col("host").alias("line_host"), F.col("key").alias("line_key"))
        .agg(F.sum("n").alias("of"), F.sum(F.when(F.col("often"), F.col("n")).otherwise(0)).alias("often"))
    )
    base = base_counts(texts.withColumn("key", F.struct("host", "key"))).select(
        "*", F.col("key.host").alias("host"), F.col("key.key").alias("text_key")
    )
    same = (
        F.col("id").eqNullSafe(F.col("line_id"))
        & (F.col("host") == F.col("line_host"))
        & (F.col("text_key") == F.col("line_key"))
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    gone = F.coalesce(F.expr("n_words * often DIV of"), F.lit(0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.col("n_line_words")
    return (
        base.join(removed, same, "left")
        .withColumns({"n_line_words": gone, "base_failed": failed})
        .withColumn("kept", ~F.col("base_failed") & (left >= min_words) & (left >= min_share * F.col("n_words")))
        .select(F.col("id").alias(id_col), *counts, "base_failed", "kept", "n_line_words")
    )
