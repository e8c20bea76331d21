"""Token counts without token ids: each distinct pre-token is tokenized once for the whole corpus.

A subword vocabulary says where no piece can reach across: before a run of spaces, and between characters of two classes
that no piece mixes. The text cut there falls into pre-tokens whose piece counts add up exactly. The most frequent
pre-tokens (a bounded number) go to all tasks; the long tail is joined to the per-document frequencies by a shuffle, so
the words that everybody uses never cross the network.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, saved

#: Frequent pre-tokens sent to all tasks: at most so many, each of at most so many bytes (about 20 MB in all).
HEAD, HEAD_BYTES = 1 << 18, 48
#: Distinct pre-tokens a task holds before it passes its counts on.
HELD = 300_000
#: Characters of a text that are cut up at once.
WINDOW = 1 << 20
_BAR = "▁"


class PieceModel:
    """A sentencepiece model and the pre-tokens that follow from its vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(size) if not self.library.is_byte(i)]
        self.cuts = not any(_BAR in p.lstrip(_BAR) for p in pieces)
        marks = self._marks(pieces) if self.cuts else ""
        if marks:
            kept = "".join(map(re.escape, sorted(marks)))
            self.pattern = re.compile(f"[ {_BAR}]*[{kept}]+|[ {_BAR}]*[^ {_BAR}{kept}]+|[ {_BAR}]+")
        else:
            self.pattern = re.compile(f"[ {_BAR}]*[^ {_BAR}]+|[ {_BAR}]+")
        self.marks = set(marks)
        self._lead = {x: len(self.library.encode(x)) for x in ("a", ".")}

    @staticmethod
    def _marks(pieces: list[str]) -> str:
        """Characters that no piece mixes with any other: ASCII without letters, and what stands beside those."""
        marks = {chr(i) for i in range(128) if not chr(i).isalpha() and chr(i) != " "}
        kinds = [set(p.lstrip(_BAR)) for p in pieces]
        while joined := set().union(*(k - marks for k in kinds if k & marks and k - marks)):
            marks |= joined
        return "" if any(c.isascii() and c.isalpha() for c in marks) else "".join(marks)

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text, a window at a time."""
        if not text:
            return
        text = " " + text
        if not self.cuts:
            yield [text]
            return
        at = 0
        while at < len(text):
            end = text.find(" ", at + WINDOW)
            while end > at and text[end - 1] in f" {_BAR}":
                end -= 1
            end = len(text) if end <= at else end
            yield self.pattern.findall(text, at, end)
            at = end

    def tokens(self, pre_tokens: list[str]) -> list[int]:
        """Pieces of each pre-token, as they come in the middle of a text."""
        if not self.cuts:
            return [len(x) for x in self.library.encode([p[1:] for p in pre_tokens], num_threads=1)]
        lead = ["a" if p[0] in f" {_BAR}" or p[0] in self.marks else "." for p in pre_tokens]
        found = self.library.encode([x + p for x, p in zip(lead, pre_tokens)], num_threads=1)
        return [len(ids) - self._lead[x] for ids, x in zip(found, lead)]


@lru_cache(1)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def vocabulary(texts: DataFrame, path: str) -> DataFrame:
    """``(pre_token, freq, tokens)`` over all texts; every distinct pre-token is tokenized once."""

    def count(parts):
        model, held = piece_model(path), Counter()

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["pre_token", "n"]
            )

        for batch in parts:
            for text in batch.column("text").to_pylist():
                for found in model.pre_tokens(text):
                    held.update(found)
                    if len(held) >= HELD:
                        yield flush()
                        held.clear()
        if held:
            yield flush()

    def tokenize(parts):
        model = piece_model(path)
        for batch in parts:
            found = model.tokens(batch.column("pre_token").to_pylist())
            yield batch.append_column("tokens", pa.array(found, pa.int64()))

    counted = arrow_map(texts, count, "pre_token string, n long").groupBy("pre_token").agg(F.sum("n").alias("freq"))
    return arrow_map(counted, tokenize, "pre_token string, freq long, tokens long")


def count_tokens(
    docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)`` for every row, as the model's library counts whole texts.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows come back as often as they are given; rows of one id
    with different texts are counted apart. Null ids stay null. Further columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    words = saved(vocabulary(texts.where("text <> ''").select("text"), model_path), "pre-tokens")
    head = (
        words.where(F.octet_length("pre_token") <= HEAD_BYTES)
        .orderBy(F.desc("freq"), "pre_token")
        .limit(HEAD)
        .select("pre_token", "tokens")
        .toArrow()
    )
    spread = docs.sparkSession.sparkContext.broadcast(
        dict(zip(head.column("pre_token").to_pylist(), head.column("tokens").to_pylist()))
    )

    def rows(parts):
        model, known = piece_model(model_path), spread.value.get
        for batch in parts:
            ids = batch.column("id").to_pylist()
            out: list[list] = [[], [], [], [], [], []]
            for key, text in zip(ids, batch.column("text").to_pylist()):
                text = text or ""
                data = text.encode()
                digest = int.from_bytes(blake2b(data, digest_size=8).digest(), "little", signed=True)
                freq = Counter()
                for found in model.pre_tokens(text):
                    freq.update(found)
                tail = [p for p in freq if known(p) is None]
                total = sum(n * (known(p) or 0) for p, n in freq.items())
                # The document's own row gets a key that no pre-token has, so that such rows are dealt out evenly.
                names = [f"\n\n{digest} {key}", *tail]
                for column, values in zip(
                    out,
                    (
                        [key] * len(names),
                        [digest] * len(names),
                        [len(data)] + [None] * len(tail),
                        [total] + [None] * len(tail),
                        names,
                        [0] + [freq[p] for p in tail],
                    ),
                ):
                    column.extend(values)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.int64()]
            names = ["id", "digest", "n_bytes", "known", "pre_token", "freq"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    schema = "id long, digest long, n_bytes long, known long, pre_token string, freq long"
    per_document = (
        arrow_map(texts, rows, schema)
        .join(words.select("pre_token", "tokens"), "pre_token", "left")
        .groupBy("id", "digest")
        .agg(
            F.sum(F.coalesce("known", F.col("freq") * F.col("tokens"))).alias("total"),
            F.max("n_bytes").alias("n_bytes"),
            F.count("n_bytes").alias("copies"),
        )
    )
    tokens = F.expr("total DIV copies")
    return per_document.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        F.col("id").alias(id_col), "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit")
    )
