"""Ranked lexical search by the Best Position Algorithm.

The index holds, per document, only the terms that some query has. It is read in blocks of documents. Within a block every
term has an impact list: its documents by falling contribution to a score. A query reads the lists of its terms side by
side; a document met in one list is looked up at once in all others (direct access), which gives its whole score and its
place in each list. A list's best position is where its unbroken run of seen places ends, however they were seen, so the
impact just past it bounds what the list can add to a document not seen yet. The query stops when the sum of these bounds
is strictly below the k-th best score, which a task carries on from block to block: later blocks stop at once or early.

Impacts, weights and scores are 64-bit integers; terms are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, in_bits, key_bits, list_parts, long_lists, saved, text_bytes
from tidemark.llm.shingles import binary_parts, word_hashes

#: Places of the bitmap that tells which terms queries have (8 MB).
BITS = 26
#: Terms of queries, one per query, that a pass over the index answers at most; more queries take more passes.
PAIRS = 1_000_000
#: Documents of a block, and entries of its table of direct accesses.
DOCS, CELLS = 4096, 1 << 24
#: Places read in each list in the first round; every round doubles them.
STEP = 16
_NO_ID = np.iinfo(np.int64).min
# Letters, digits and every byte of a character above ASCII stay; all else separates terms.
_BLANKED = np.arange(256, dtype=np.uint8)
_BLANKED[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of a column of texts in order, and the place of each text's first."""
    data, offsets = binary_parts(column)
    return word_hashes(np.take(_BLANKED, data), offsets)


def _counted(texts: DataFrame, flat=None) -> DataFrame:
    """``(id, n, terms, times)`` per text: its length in terms, and its distinct terms (those in a bitmap) with counts."""

    def rows(parts):
        for batch in parts:
            values, first = terms(batch.column("text"))
            lengths = np.diff(first)
            text = np.repeat(np.arange(len(lengths)), lengths)
            if flat is not None:
                known = in_bits(flat.value, values, BITS)
                values, text = values[known], text[known]
            order = np.lexsort((values, text))
            values, text = values[order], text[order]
            new = np.ones(len(values), bool)
            new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
            at = np.flatnonzero(new)
            times = np.diff(np.append(at, len(values)))
            ends = np.searchsorted(text[at], np.arange(1, len(lengths)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(lengths, pa.int64()),
                    long_lists(np.split(values[at], ends)),
                    long_lists(np.split(times.astype(np.int64), ends)),
                ],
                ["id", "n", "terms", "times"],
            )

    return arrow_map(texts, rows, "id long, n long, terms array<long>, times array<long>")


def _frequencies(index: DataFrame) -> DataFrame:
    """``(term, df)``: in how many rows each term is."""

    def count(parts):
        held, n = [], 0

        def flush():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts)], ["term", "n"])

        for batch in parts:
            held.append(list_parts(batch.column("terms"))[0].view(np.int64))
            n += len(held[-1])
            if n > 4_000_000:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    found = arrow_map(index.select("terms"), count, "term long, n long")
    return found.groupBy("term").agg(F.sum("n").alias("df"))


class Queries:
    """A pass's queries: their terms as numbers, how often each has them, and the terms' weights."""

    def __init__(self, items: np.ndarray, hashes: np.ndarray, times: np.ndarray, weights: np.ndarray):
        order = np.argsort(items, kind="stable")
        self.items, first = np.unique(items[order], return_index=True)
        self.ends = np.append(first[1:], len(items))
        self.starts = first
        self.hashes, number = np.unique(hashes.view(np.uint64), return_inverse=True)
        self.weights = np.zeros(len(self.hashes), np.int64)
        self.weights[number] = weights
        self.terms, self.times = number[order], times[order]


class Block:
    """Impact lists of a block of documents, and the place of each document in each list."""

    def __init__(self, queries: Queries, ids, m, doc, hashes, tf):
        at = np.minimum(np.searchsorted(queries.hashes, hashes), len(queries.hashes) - 1)
        known = queries.hashes[at] == hashes
        term, doc, tf = at[known], doc[known], tf[known]
        impact = queries.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        order = np.lexsort((doc, -impact, term))
        self.ids, self.doc, self.impact = ids, doc[order], impact[order]
        self.here, starts = np.unique(term[order], return_index=True)
        self.starts = starts
        self.ends = np.append(starts[1:], len(order))
        self.place = np.full((len(self.here), len(ids)), -1, np.int32)
        row = np.repeat(np.arange(len(self.here)), self.ends - self.starts)
        self.place[row, self.doc] = np.arange(len(order), dtype=np.int32)

    def best(self, terms: np.ndarray, times: np.ndarray, k: int, scores: np.ndarray, ids: np.ndarray):
        """The k best of ``(scores, ids)`` and this block's documents, and how many places were read in order."""
        if not len(self.here):
            return scores, ids, 0
        row = np.minimum(np.searchsorted(self.here, terms), len(self.here) - 1)
        there = self.here[row] == terms
        row, times = row[there], times[there]
        starts, ends = self.starts[row], self.ends[row]
        lengths = ends - starts
        # The query's lists end to end, so that their first unseen places are found together.
        base = np.cumsum(lengths) - lengths
        seen = np.zeros(int(lengths.sum()), bool)
        inside = np.arange(len(seen)) - np.repeat(base, lengths)
        met = np.zeros(len(self.ids), bool)
        best_position = np.zeros(len(row), np.int64)
        depth, step = 0, STEP
        while True:
            # What a document not seen yet can have in each list: the impact just past the best position.
            left = best_position < lengths
            bound = int((times * np.where(left, self.impact[np.minimum(starts + best_position, ends - 1)], 0)).sum())
            if not left.any() or bound <= 0 or len(scores) == k and bound < scores[-1]:
                return scores, ids, depth
            reach = np.clip(lengths - depth, 0, step)
            at = np.repeat(starts + depth, reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
            found = np.unique(self.doc[at])
            found = found[~met[found]]
            met[found] = True
            place = self.place[row[:, None], found]
            hit = place >= 0
            score = (np.where(hit, self.impact[place], 0) * times[:, None]).sum(0)
            seen[(place + (base - starts)[:, None])[hit]] = True
            best_position = np.minimum.reduceat(np.where(seen, len(seen), inside), base)
            best_position = np.minimum(best_position, lengths)
            some = score > 0
            scores, ids = np.append(scores, score[some]), np.append(ids, self.ids[found[some]])
            order = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[order], ids[order]
            depth, step = depth + step, step * 2


def _blocks(parts, queries: Queries, total: int, documents: int):
    """The index rows of a task as blocks, none with more than DOCS documents or CELLS direct accesses."""
    ids, m, hashes, tf, sizes, held = [], [], [], [], [], 0

    def block():
        count = np.concatenate(sizes)
        return Block(
            queries,
            np.concatenate(ids),
            np.concatenate(m),
            np.repeat(np.arange(len(count)), count),
            np.concatenate(hashes),
            np.concatenate(tf).view(np.int64),
        )

    most = max(64, min(DOCS, CELLS // max(1, len(queries.hashes))))
    for batch in parts:
        for start in range(0, len(batch), most):
            part = batch.slice(start, most)
            if held and held + len(part) > most:
                yield block()
                ids, m, hashes, tf, sizes, held = [], [], [], [], [], 0
            values, lengths = list_parts(part.column("terms"))
            hashes.append(values)
            sizes.append(lengths)
            tf.append(list_parts(part.column("times"))[0])
            ids.append(np.asarray(part.column("id").fill_null(_NO_ID)))
            m.append(75 + (25 * np.asarray(part.column("n")) * documents) // total)
            held += len(part)
    if held:
        yield block()


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    pairs_a_pass: int = PAIRS,
) -> DataFrame:
    """``(item_col, rank, id_col, score)``: for each item the ``k`` rows of ``docs`` that score highest for its text.

    Terms are maximal runs of ASCII letters (lower-cased) and digits and of any characters above ASCII, in whole texts.
    With N documents that have a term, L terms in all, n in a document, df documents with the term and tf in the document,
    a term weighs ``floor(1000 * ln((2N + 2) / (2df + 1)))`` and adds ``weight * (10^9 tf div (1000 tf + 12 m))``, where
    ``m = 75 + 25 n N div L``; terms that an item repeats add again. Only scores above 0 count. Equal scores go by
    ascending id, a null id first.

    Null, empty and term-less texts neither match nor ask. Repeated document rows are documents of their own. Repeated
    item rows are one item; different texts under one item id are taken together, and a null item id is an item like any
    other. Empty tables give no rows, further columns are ignored. The queries go to all tasks in passes of about
    ``pairs_a_pass`` terms; the answer does not depend on it, nor on blocks or partitions.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).cast("long").alias("id"), text_bytes(item_text_col).alias("text")).distinct()
    pairs = (
        _counted(asked)
        .select("id", F.explode(F.arrays_zip("terms", "times")).alias("x"))
        .groupBy("id", F.col("x.terms").alias("term"))
        .agg(F.sum("x.times").alias("times"))
    )
    pairs = saved(pairs, "query-terms")
    flat = key_bits(pairs, "term", BITS)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    index = saved(_counted(texts, flat).where("n > 0"), "index")
    documents, total = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequencies = saved(_frequencies(index), "frequencies")
    weighed = saved(pairs.join(frequencies, "term"), "weights")
    passes = -(-weighed.count() // pairs_a_pass)
    kinds = "item long, no_item boolean, id long, score long"
    found = None
    for turn in range(passes):
        mine = weighed.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == turn) if passes > 1 else weighed
        table = mine.toArrow()
        if not len(table):
            continue
        df = table.column("df").to_pylist()
        by_df = {x: math.floor(1000 * math.log((2 * documents + 2) / (2 * x + 1))) for x in set(df)}
        ids = table.column("id").combine_chunks()
        spread = spark.sparkContext.broadcast(
            Queries(
                np.asarray(ids.fill_null(_NO_ID)),
                np.asarray(table.column("term").combine_chunks()),
                np.asarray(table.column("times").combine_chunks()),
                np.array([by_df[x] for x in df], np.int64),
            )
        )

        def best(parts, spread=spread):
            queries = spread.value
            top = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in queries.items]
            for block in _blocks(parts, queries, total, documents):
                for i, (start, end) in enumerate(zip(queries.starts, queries.ends)):
                    top[i] = block.best(queries.terms[start:end], queries.times[start:end], k, *top[i])[:2]
            item = np.repeat(queries.items, [len(scores) for scores, _ in top])
            scores, ids = (np.concatenate([x[j] for x in top] or [np.empty(0, np.int64)]) for j in (0, 1))
            for at in range(0, len(item), 65536):
                part = slice(at, at + 65536)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(item[part], mask=item[part] == _NO_ID),
                        pa.array(item[part] == _NO_ID),
                        pa.array(ids[part], mask=ids[part] == _NO_ID),
                        pa.array(scores[part]),
                    ],
                    ["item", "no_item", "id", "score"],
                )

        part = saved(arrow_map(index, best, kinds), "best")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], kinds)
    order = Window.partitionBy("item").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
