"""Best-two-fit packing of token sequences.

Texts are tokenized where they lie. Only the counts of piece lengths (at most ``capacity`` of them) are gathered; the
packing is planned on those counts, many equal bins at a time, and each piece finds its place by its rank among the
pieces of its length. Ranks are counted per length and salt, so that a length which a third of all pieces share is no
single task.
"""

from __future__ import annotations

import os
import string
from functools import lru_cache
from struct import pack as packed

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import arrow_map, text_bytes
from tidemark.session import work_folder

SALTS = 64
#: Texts that are tokenized at once; what they share is looked up once.
TEXTS = 1024
_PUNCTUATION = string.punctuation.encode()


class WordTokenizer:
    """A ``tokenizers`` file whose pre-tokenizer drops white space, with remembered words.

    Such a tokenizer treats what stands between white space on its own, so a text's ids are those of its words in a
    row. Words are remembered in two generations of at most LIMIT: when the young one is full it becomes the old one,
    and words that are met again come back from there. Forgetting costs time only.
    """

    LIMIT = 200_000
    #: New words that are encoded at once.
    PORTION = 8_192

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        vocabulary = self.library.get_vocab()
        suffix = getattr(self.library.model, "end_of_word_suffix", None) or "</w>"
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        # The model alone does for words of a-z, unless normalizer or pre-tokenizer change even these.
        probes = [w.encode() for t in vocabulary if (w := t.removesuffix(suffix)).isascii() and w.isalpha() and w.islower()]
        probes = sorted(probes)[:: max(1, len(probes) // 200)]
        self.alone = self._encode_plain(probes) == self._encode(probes)

    @staticmethod
    def _parts(word: bytes) -> tuple[bytes, bytes]:
        """The word with A-Z in lower case, cut after its last letter if only ASCII punctuation follows."""
        if word.isalpha():
            return word.lower(), b""
        # The names of special tokens are matched in the raw text, before lower case.
        if b"<|" in word:
            return word, b""
        word = word.lower()
        stem = word.rstrip(_PUNCTUATION)
        if len(stem) == len(word) or not stem:
            return word, b""
        if not stem[-1:].isalpha():
            # A letter may become a letter and a mark in lower case, and marks go with what follows.
            last = stem[-4:].decode(errors="replace")[-1].lower()
            if not last.isalpha():
                return word, b""
        return stem, word[len(stem) :]

    def _encode(self, words: list[bytes]) -> list[bytes]:
        found = self.library.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _encode_plain(self, words: list[bytes]) -> list[bytes]:
        """Ids of lower-case ASCII words by the model, without normalizer and pre-tokenizer."""
        model = self.library.model
        found = [[t.id for t in model.tokenize(w.decode())] for w in words]
        return [packed(f"<{len(ids)}I", *ids) for ids in found]

    def _encode_letters(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of letters: encoded as one text and cut after each id that ends a word."""
        out = []
        for at in range(0, len(words), 1000):
            some = words[at : at + 1000]
            whole = b" ".join(some).decode()
            ids = np.array(self.library.encode_batch_fast([whole], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist() or [0]
            data = ids.tobytes()
            cut = [data[x:y] for x, y in zip([0, *ends], ends)]
            # Letters by another Unicode version than the library's: word by word.
            out += cut if len(cut) == len(some) and ends[-1] == len(data) else self._encode(some)
        return out

    def _learn(self, words: list[bytes]) -> None:
        known, old = self.known, self.old
        new, made = set(), []
        for word in words:
            if (ids := old.get(word)) is not None:
                known[word] = ids
                continue
            stem, rest = self._parts(word)
            if rest or stem != word:
                made.append((word, stem, rest))
            for part in (stem, rest) if rest else (stem,):
                if part not in known:
                    if (ids := old.get(part)) is not None:
                        known[part] = ids
                    else:
                        new.add(part)
        if self.alone:
            plain = [w for w in new if w.isalpha() and w.islower()]
            known.update(zip(plain, self._encode_plain(plain)))
            new.difference_update(plain)
        letters = [w for w in new if w.isalpha() or w.decode().isalpha()]
        known.update(zip(letters, self._encode_letters(letters)))
        others = list(new.difference(letters))
        known.update(zip(others, self._encode(others)))
        for word, stem, rest in made:
            known[word] = known[stem] + known[rest] if rest else known[stem]

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if len(self.known) > self.LIMIT:
            self.old, self.known = self.known, {}
        # Each distinct word is looked up once among all that are known; the texts then find theirs in a small table.
        # Texts are split twice, as all their words at once take ten times their own memory.
        words: set[bytes] = set()
        for text in texts:
            if text:
                words.update(text.split())
        new = list(words.difference(self.known))
        for at in range(0, len(new), self.PORTION):
            self._learn(new[at : at + self.PORTION])
        here = dict(zip(words, map(self.known.__getitem__, words)))
        return [b"".join(map(here.__getitem__, text.split())) if text else b"" for text in texts]


@lru_cache(1)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(
    docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, piece, start, length, ids)``: every text's ids and ``end_id``, cut only where longer than ``capacity``.

    ``ids`` holds little-endian unsigned 32-bit numbers. Null and empty texts are the one id ``end_id``. Repeated rows
    give repeated pieces. Written to the shared folder, as tokenizing is the costly part.
    """
    end = int(end_id).to_bytes(4, "little")

    def cut(parts):
        tokenizer = word_tokenizer(path)
        for batch in parts:
            out: list[list] = [[], [], [], [], []]
            for key, ids in zip(batch.column("id").to_pylist(), tokenizer.ids(batch.column("text").to_pylist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for column, value in zip(out, (key, piece, at // 4, len(part) // 4, part)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
            names = ["id", "piece", "start", "length", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text"))
    made = arrow_map(texts, cut, "id long, piece int, start long, length long, ids binary", TEXTS)
    path_out = work_folder(docs.sparkSession, "pieces")
    made.write.option("compression", "zstd").parquet(path_out)
    return docs.sparkSession.read.schema(made.schema).parquet(path_out).withColumnRenamed("id", id_col)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-two-fit over counts of lengths.

    A bin takes the longest piece that fits, again and again. If room is left, its shortest piece gives way to the two
    unpacked pieces that fit the widened gap most tightly, if they fill more of it. Equal bins are planned together.
    Returns ``(length, first rank, end rank, pieces per bin, first bin, offset)``: a few thousand rows at most, as each
    plan of equal bins uses up a length or nearly so.
    """
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    taken = np.zeros_like(have)
    plan, bins, lengths = [], 0, np.arange(capacity + 1)
    while have.any():
        use: dict[int, int] = {}
        left, gap = have.copy(), capacity
        while gap and len(fits := np.flatnonzero(left[: gap + 1])):
            length = int(fits[-1])
            k = int(min(left[length], gap // length))
            use[length] = use.get(length, 0) + k
            left[length] -= k
            gap -= k * length
        if gap and use:
            shortest = min(use)
            room = gap + shortest
            below = np.maximum.accumulate(np.where(left[: room + 1] > 0, lengths[: room + 1], 0))
            one = np.flatnonzero(left[1:room]) + 1
            two = below[room - one]
            good = (two > 0) & ((two != one) | (left[one] > 1))
            if good.any():
                sums = np.where(good, one + two, 0)
                best = int(sums.argmax())
                if sums[best] > shortest:
                    use[shortest] -= 1
                    for length in (int(one[best]), int(two[best])):
                        use[length] = use.get(length, 0) + 1
        use = {length: k for length, k in use.items() if k}
        times = min(int(have[length]) // k for length, k in use.items())
        offset = 0
        for length, k in use.items():
            first = int(taken[length])
            plan.append((length, first, first + times * k, k, bins, offset))
            taken[length] += times * k
            have[length] -= times * k
            offset += k * length
        bins += times
    return plan


def pack(pieces: DataFrame, capacity: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """All columns of ``pieces(id_col, piece, length, ...)`` with ``sequence_id`` and ``offset``.

    Every piece gets one place; the pieces of a sequence lie without gaps from 0 and fill at most ``capacity``. Repeated
    pieces get places of their own. An empty table gives no rows. ``pieces`` is read twice: pass a written table.
    """
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(id_col, "piece"), F.lit(SALTS)).cast("int"))
    sums = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = sorted(plan_bins(counts, capacity))
    length, first, end, per_bin, bins, offset = (np.array(x, np.int64) for x in zip(*plan)) if plan else [[]] * 6
    # Ranks of all lengths as one number line: lengths and ranks are ordered alike in the plan.
    spread = pieces.sparkSession.sparkContext.broadcast((length, first, per_bin, bins, offset))
    order = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).drop("_n")
    rest = sorted(set(pieces.columns) - {id_col, "piece", "length"})
    rank = F.row_number().over(Window.partitionBy("length", "_salt").orderBy(id_col, "piece", *rest))
    ranked = salted.join(before, ["length", "_salt"]).withColumn("_rank", rank + F.col("_before") - 1)

    names = pieces.columns

    def place(parts):
        length, first, per_bin, bins, offset = spread.value
        step = np.int64(1) << np.int64(48)
        starts = length * step + first
        for batch in parts:
            size, rank = (np.asarray(batch.column(c)) for c in ("length", "_rank"))
            row = np.searchsorted(starts, size * step + rank, side="right") - 1
            nth = rank - first[row]
            columns = {c: batch.column(c) for c in names}
            columns["sequence_id"] = pa.array(bins[row] + nth // per_bin[row], pa.int64())
            columns["offset"] = pa.array(offset[row] + nth % per_bin[row] * size, pa.int64())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = StructType(list(pieces.schema)).add("sequence_id", "long").add("offset", "long")
    return arrow_map(ranked.select(*pieces.columns, F.col("_rank").cast("long").alias("_rank")), place, schema)
