"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Patterns find candidates in every text. Each candidate's hash is counted over distinct repositories and owners: what many
owners or very many repositories carry is a copied example, what few own and what looks random is a live credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import small

#: The kinds in their order, each with its pattern, the group that holds the credential and its least length.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}+", 0, 24),
}
#: The method's own candidates: whole runs of credential characters. Only the live ones become spans.
EXTRA = {"owned": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", 0, 20)}
#: A candidate in the hands of more owners than this is a copied example.
MAX_OWNERS = 3
#: So is one in more repositories than this, however few their owners.
MAX_REPOSITORIES = 30
#: Distinct characters that a random-looking credential has at least.
MIN_CHARACTERS = 8
_MATCH = "struct<kind:int,nth:int,gap:int,whole:int,value:string>"


def _matches(text: Column, number: int, pattern: str, group: int) -> Column:
    """A kind's matches in their order, each with the length of the gap before it.

    Spark returns matches without places; the text split at the same pattern gives the gaps between them.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(whole.alias("whole"), F.split(text, pattern, -1).alias("gap"), value.alias("value"))
    rows = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(number).alias("kind"),
            i.alias("nth"),
            F.length(x["gap"]).alias("gap"),
            F.length(x["whole"]).alias("whole"),
            x["value"].alias("value"),
        ),
    )
    # The text after the last match is a gap without a match.
    found = F.filter(rows, lambda x: x["whole"].isNotNull()).cast(f"array<{_MATCH}>")
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{_MATCH}>"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key")
    )


def secret_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repository_col: str | None = None,
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """``(id, text_key, kind, start, end, hash, owners, repositories, live)``: one row per span and distinct text of an id.

    Places count code points, ends exclusive. All matches of the base kinds are spans; runs of credential characters
    outside them are spans of the kind ``owned`` if they are live: no more than ``max_owners`` distinct owners and
    ``max_repositories`` distinct repositories have them, and they hold a digit, a letter and MIN_CHARACTERS distinct
    characters. Without ``repository_col`` each distinct text is a repository, so copies of a document add none. Owners and repositories that are null count as one. Null and empty texts have no
    spans; ``text_key`` is xxhash64 of the text, so rows of one id with different texts stay apart.
    """
    kinds = KINDS | EXTRA
    text = F.col("text")
    given = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # The owner goes by a name that no column of the table can clash with.
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        given.alias("text"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        (F.coalesce(F.col(repository_col).cast("string"), F.lit("")) if repository_col else F.xxhash64(given)).alias("repository"),
        F.xxhash64(given).alias("text_key"),
    )
    found = F.concat(*(_matches(text, n, p, g) for n, (p, g, _) in enumerate(kinds.values())))
    each = (
        rows.select("id", "text_key", "owner", "repository", F.explode(found).alias("m"))
        .select("id", "text_key", "owner", "repository", "m.*")
        .withColumn("hash", F.sha2("value", 256))
    )
    least = F.create_map(*(F.lit(x) for n, (_, _, length) in enumerate(kinds.values()) for x in (n, length)))
    characters = F.size(F.array_distinct(F.split("value", "")))
    random = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]") & (characters >= MIN_CHARACTERS)
    each = each.select(
        *(c for c in each.columns if c != "value"),
        (F.length("value") >= least[F.col("kind")]).alias("fits"),
        random.alias("random"),
    )
    owned = (
        each.where("fits")
        .groupBy("hash")
        .agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"))
    )
    # One row per match of a text: repeated rows, and a text of one id under several owners, give it once.
    order = Window.partitionBy("id", "text_key", "kind").orderBy("nth")
    end = F.sum(F.col("gap").cast("long") + F.col("whole")).over(order)
    spans = (
        each.drop("owner", "repository")
        .dropDuplicates(["id", "text_key", "kind", "nth"])
        .withColumn("end", end)
        .withColumn("start", F.col("end") - F.col("whole"))
        .where("fits")
        .join(owned, "hash")
        .withColumn("live", (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories) & F.col("random"))
    )
    base = F.col("kind") < len(KINDS)
    by_place = Window.partitionBy("id", "text_key").orderBy("start", "kind")
    reach = F.max(F.when(base, F.col("end"))).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    onward = F.min(F.when(base, F.col("start"))).over(by_place.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(reach, F.lit(0)) <= F.col("start")) & (F.coalesce(onward, F.col("end")) >= F.col("end"))
    names = F.array(*map(F.lit, kinds))
    return (
        spans.withColumn("free", free)
        .where(base | (F.col("live") & F.col("free")))
        .select(
            "id", "text_key", F.col("kind").alias("number"), names[F.col("kind")].alias("kind"), "start", "end", "hash",
            "owners", "repositories", "live",
        )
    )


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """For every row its id, the counts of each base kind, ``n_live``, ``base_spans`` and ``spans``.

    Spans read ``kind:start:end``, by start, then kind as listed, joined by commas. Repeated rows come back as often as
    given; texts without spans have zeros and empty strings. An empty table gives no rows.
    """
    # Sorted as (start, number of the kind, text), which is the order asked for.
    item = F.struct("start", "number", F.concat_ws(":", "kind", "start", "end").alias("span"))
    base = F.col("number") < len(KINDS)
    joined = lambda column: F.array_join(F.sort_array(column)["span"], ",")
    per_text = (
        secret_spans(docs, id_col, text_col, **options)
        .groupBy("id", "text_key")
        .agg(
            *(F.count_if(F.col("kind") == kind).alias(f"n_{kind}") for kind in KINDS),
            F.count_if("live").alias("n_live"),
            joined(F.collect_list(F.when(base, item))).alias("base_spans"),
            joined(F.collect_list(item)).alias("spans"),
        )
        .withColumnsRenamed({"id": "span_id", "text_key": "span_key"})
    )
    counts = [f"n_{kind}" for kind in KINDS] + ["n_live"]
    rows = _keyed(docs, id_col, text_col).select("id", "text_key")
    same = F.col("id").eqNullSafe(F.col("span_id")) & (F.col("text_key") == F.col("span_key"))
    return rows.join(per_text, same, "left").select(
        F.col("id").alias(id_col),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts),
        *(F.coalesce(c, F.lit("")).alias(c) for c in ("base_spans", "spans")),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with live spans replaced by ``mark``; copied examples and all other text stay as they are.

    Overlapping spans are replaced as one. A column ``n_chars`` follows the new text. No row is dropped.
    """
    live = (
        secret_spans(docs, id_col, text_col, **options)
        .where("live")
        .groupBy("id", "text_key")
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
        .withColumnsRenamed({"id": "_id", "text_key": "_key"})
    )
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text_col)) == F.col("_key"))
    text = F.col(text_col)
    cut = F.aggregate(
        F.col("_spans"),
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(
                x["start"] >= acc["at"],
                F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark)),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)),
    )
    out = docs.join(small(live, F.size("_spans") + 1), same, "left").withColumn(text_col, F.when(F.col("_spans").isNull(), text).otherwise(cut))
    if "n_chars" in docs.columns:
        kept = F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.length(text_col))
        out = out.withColumn("n_chars", kept.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
