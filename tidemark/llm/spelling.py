"""Spelling variants by asymmetric q-chunks.

One edit between two words leaves one of two disjoint chunks of the first word whole, and the second word has that chunk
as one of its positional grams, no more than one place away. So the words that share a chunk's text, place and length are
the candidates. As lengths tell the shift (0 between words of one length, 0 or 1 to a word longer by one), grams that no
chunk can meet are never made. Where too many words meet in one chunk, the rest of the word is cut into two chunks in its
turn, since the edit lies in there: again one of them is whole. That goes on until a bucket is small or its open part is one
character, so no bucket, however common its chunk, turns into all pairs. Candidates are verified by their edit distance.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, saved, text_bytes
from tidemark.llm.shingles import binary_parts, word_hashes

#: Pairs that a bucket may hold before its words are cut further.
BUCKET_PAIRS = 1024
#: Distinct words a task holds before it passes its counts on.
HELD = 400_000
#: Runs above this many bytes are looked at one by one.
_LONG = 64
_ASCII = np.zeros(256, bool)
_ASCII[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _runs(column: pa.Array):
    """The lower-cased bytes of a column and, per run of letters, its text, hash, start, end and code points."""
    data, offsets = binary_parts(column)
    # U+00C0 to U+00FF are the pairs of 0xC3 and one more byte.
    lead = data == 0xC3
    inside = _ASCII[data] | lead
    inside[1:] |= lead[:-1]
    letters = np.where(inside, np.take(_LOWER, data), 0x20).astype(np.uint8)
    hashes, first = word_hashes(letters, offsets)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    pairs = np.append(0, np.cumsum(lead))
    points = ends - starts - (pairs[ends] - pairs[starts])
    return letters, np.repeat(np.arange(len(first) - 1), np.diff(first)), hashes, starts, ends, points


def _crc(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of each run appended to the text whose CRC is ``before``."""
    state = before ^ np.uint32(0xFFFFFFFF)
    active, at = np.arange(len(starts)), starts.copy()
    short = ends - starts <= _LONG
    active = active[short]
    while len(active):
        byte = data[at[active]]
        state[active] = _CRC[(state[active] ^ byte) & 255] ^ (state[active] >> np.uint32(8))
        at[active] += 1
        active = active[at[active] < ends[active]]
    state ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(~short):
        state[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(before[i]))
    return state


def noisy_word_counts(
    docs: DataFrame,
    every: int = 31,
    min_length: int = 7,
    min_count: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(word, n)``: words of whole texts with at least ``min_length`` code points and ``min_count`` occurrences.

    Words are maximal runs of ``[A-Za-z\\u00C0-\\u00FF]``, A-Z lower-cased. Misspellings are planted: where ``every``
    divides h, the CRC-32 of ``<id>:<run>``, the run loses its code point number ``h % length``. Rows without an id keep
    their runs as they are. Null, empty and letterless texts add nothing; repeated rows count as often as given.
    """
    texts = docs.select(F.col(id_col).cast("string").alias("id"), text_bytes(text_col).alias("text"))

    def count(parts):
        held: Counter = Counter()

        def flush():
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held.keys()), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"]
            )

        for batch in parts:
            letters, doc, hashes, starts, ends, points = _runs(batch.column("text"))
            some = points >= min_length
            doc, hashes, starts, ends, points = (x[some] for x in (doc, hashes, starts, ends, points))
            if not len(doc):
                continue
            ids = batch.column("id").to_pylist()
            before = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
            named = np.array([i is not None for i in ids])
            crc = _crc(letters, starts, ends, before[doc])
            hit = (crc % np.uint32(every) == 0) & named[doc]
            raw = letters.tobytes()
            whole = np.flatnonzero(~hit)
            _, at, times = np.unique(hashes[whole], return_index=True, return_counts=True)
            at = whole[at]
            for s, e, n in zip(starts[at].tolist(), ends[at].tolist(), times.tolist()):
                held[raw[s:e]] += n
            cut = np.flatnonzero(hit & (points > min_length))
            for s, e, h, p in zip(*(x[cut].tolist() for x in (starts, ends, crc, points))):
                run, k = raw[s:e].decode(), h % p
                held[(run[:k] + run[k + 1 :]).encode()] += 1
            if len(held) >= HELD:
                yield flush()
                held.clear()
        if held:
            yield flush()

    counted = arrow_map(texts, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _text(start: Column | str, end: Column | str) -> Column:
    """The code points of ``word`` from ``start`` to before ``end``, counted from 0."""
    start, end = (F.col(x) if isinstance(x, str) else x for x in (start, end))
    return F.substring(F.col("word"), start + 1, end - start)


def _cut(rows: DataFrame) -> DataFrame:
    """Each row's open part ``[s, e)`` cut into two chunks: one row with the left chunk in its key, one with the right.

    Places are those of the shorter word; in a word longer by one (``shift`` 1) what follows the edit stands one further.
    """
    middle = F.col("s") + F.floor((F.col("e") - F.col("s")) / 2).cast("int")
    left = F.struct(F.xxhash64("key", F.lit(1), _text(F.col("s"), F.col("m"))).alias("key"), F.col("m").alias("s"), F.col("e"))
    right_text = _text(F.col("m") + F.col("shift"), F.col("e") + F.col("shift"))
    right = F.struct(F.xxhash64("key", F.lit(2), right_text).alias("key"), F.col("s"), F.col("m").alias("e"))
    halves = rows.withColumn("m", middle).withColumn("half", F.explode(F.array(left, right)))
    return halves.select("half.key", "word", "n", "shift", "length", "half.s", "half.e")


def near_pairs(words: DataFrame, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """``(a, a_n, b, b_n)``: every pair of the distinct ``words(word, n)`` one inserted, deleted or replaced code point apart.

    Each pair comes once, the shorter word (of one length: the lesser) as ``a``. ``bucket_pairs`` steers the work, not
    the result. Words need at least two code points.
    """
    length = F.length("word")
    start = F.inline(F.array(*(F.struct((length - i).alias("length"), F.lit(i).alias("shift")) for i in (0, 1))))
    rows = words.select("word", "n", start).where("length > 0").withColumns({"s": F.lit(0), "e": F.col("length")})
    rows = saved(_cut(rows.withColumn("key", F.xxhash64("length"))), "chunks")
    found = None
    while True:
        sizes = rows.groupBy("key").agg(
            F.sum(1 - F.col("shift")).alias("short"), F.sum("shift").alias("long"), F.first(F.col("e") - F.col("s")).alias("open")
        )
        # A bucket without two words to compare is done.
        sizes = sizes.where("short > 0 AND short + long > 1")
        small = F.expr(f"short * (short + long) <= {bucket_pairs} OR open <= 1")
        judged = saved(rows.join(sizes.select("key", small.alias("small")), "key"), "buckets")
        a = judged.where("small AND shift = 0").alias("a")
        b = judged.where("small").alias("b")
        # Chunks before the edit and after it can both be whole: such a pair counts only where the edit stands leftmost.
        leftmost = "a.e = a.length OR substring(a.word, a.s + 1, a.e - a.s) <> substring(b.word, a.s + 1, a.e - a.s)"
        pairs = a.join(
            b,
            F.expr(f"a.key = b.key AND (b.shift = 1 OR a.word < b.word) AND ({leftmost}) AND levenshtein(a.word, b.word, 1) = 1"),
        ).select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))
        pairs = saved(pairs, "near")
        found = pairs if found is None else found.unionByName(pairs)
        large = judged.where("NOT small").drop("small")
        if large.isEmpty():
            return found
        rows = saved(_cut(large), "chunks")


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for the words that have a form: the last of the forms that follow from it."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(onward, "root", "left")
        step = saved(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def spelling_variants(words: DataFrame, ratio: int = 10, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every row of ``words(word, n)``; words are distinct and not null.

    Two words are near if exactly one code point is inserted, deleted or replaced. A word's form is its near word of
    largest n (ties: the smallest in code-point order) if that is at least ``ratio`` times its own, else null; the root is
    the last word reached by following forms, or the word itself. No word has itself as a form, as ``ratio`` is above 1.
    An empty table gives no rows; further columns are ignored.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    words = saved(words.select("word", "n"), "words")
    pairs = near_pairs(words, bucket_pairs)
    one = F.struct(F.col("a").alias("word"), (-F.col("b_n")).alias("less"), F.col("b").alias("near"))
    other = F.struct(F.col("b").alias("word"), (-F.col("a_n")).alias("less"), F.col("a").alias("near"))
    near = (
        pairs.select(F.inline(F.array(one, other)))
        .groupBy("word")
        .agg(F.count("*").alias("n_near"), F.min(F.struct("less", "near")).alias("best"))
    )
    chosen = F.col("n_near").isNotNull() & (-F.col("best.less") >= ratio * F.col("n"))
    judged = saved(
        words.join(near, "word", "left").select(
            "word",
            F.when(chosen, F.col("best.near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(chosen, -F.col("best.less")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(judged.where("form IS NOT NULL"))
    return judged.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
