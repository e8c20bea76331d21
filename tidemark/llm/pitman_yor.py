"""A hierarchical Pitman-Yor language model, sampled and applied over whole tables.

Every context is a Chinese restaurant: the words seen in it are customers, each distinct word a dish, and a dish is served
at one table or more. All context restaurants share one parent, whose customers are their tables; below it lies the uniform
distribution over the vocabulary and one unknown word.

``corpus_scores`` is the model of order 2: a context is the word before (a text's first token follows an end), and drops it
to back off. There are as many contexts as words, so nothing is kept per context on the driver but for the most frequent
words, whose sums are sent to all tasks (a bounded number); the sums of other words are joined by a shuffle. A pair of words
that occurs once has one table in every sample, so only pairs of two customers or more are sampled, one row each.

``train`` and ``score`` take coarser contexts, the last character of the word before (the start of a text has one of its
own). Then all of a word's dishes, in every context and in the parent, form one row, and a sweep moves none.

Gibbs sampling. In a sweep, the number of tables of every dish is drawn given all else, from the exact distribution of a
Pitman-Yor restaurant with the seating summed out (generalised Stirling numbers). Dishes are drawn side by side, given the
totals and the parent's probabilities of the sweep before; then the parent's own tables are drawn. Dishes of more than
``EXACT`` customers seat the first ``EXACT`` so and the others in steps of a sixteenth of those seated, rounded at random.
Draws are hashes of word, context and sweep: a task that is run again draws the same. A token's probability is the mean of
the predictive probabilities of the sweeps that are kept.

Scores: the most frequent pairs (in ``score``: words) go to all tasks, a bounded number of probabilities. A pair of frequent
words in a learned text that is not among those seen twice was seen once, there. The rest is joined by a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, in_bits, key_bits, list_parts, saved, text_bytes
from tidemark.llm.shingles import _LOWER, _SPACE, binary_parts, mixed, word_hashes
from tidemark.llm.toxicity import held_out

#: Sweeps that are thrown away, and sweeps whose predictive probabilities are averaged.
BURN_IN, SAMPLES = 2, 3
#: Strength of the context restaurants and of their parent; the discounts are estimated.
STRENGTH = 1.0
#: Customers of a dish up to which tables are drawn exactly.
EXACT = 256
#: Tokens a task gathers before it counts them, and rows of words it samples at once.
GATHER, ROWS = 4_000_000, 50_000
#: Rows of numbers handed to Python at once; beside texts fewer.
NUMBERS, BESIDE_TEXTS = 16_384, 1_024
#: Probabilities of frequent words that are sent to all tasks, at most (32 MB).
HOT = 1 << 21
#: Words that are known to all tasks, and the most frequent of them, whose pairs are dealt by both words.
HOT_WORDS, SPREAD = 1 << 19, 1 << 12
#: Places of the bitmap of pairs that occur twice or more.
BITS = 27
#: Stands for the end of a text; no word hashes to it in practice. The context of a first word.
END, START = np.uint64(0), 0
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xD6E8FEB86659FD93)


def _placed(column: pa.Array):
    """Text number and word hash of all tokens of a column, the places of the words among them, and the words' bytes."""
    data, offsets = binary_parts(column)
    words, first = word_hashes(data, offsets)
    lengths = np.diff(first)
    text = np.repeat(np.arange(len(lengths)), lengths + 1)
    # Word i of text k is token i + k; the ends stand between.
    place = np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)
    word = np.full(len(text), END)
    word[place] = words
    return text, word, place, data, offsets


def word_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, word hash and the hash of the token before, of all tokens; a text's first token follows an end."""
    text, word, *_ = _placed(column)
    before = np.full(len(word), END)
    before[1:] = word[:-1]
    return text, word, before


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, word hash and context of all tokens of a column, each text's end included.

    The context is the last character of the word before: the classes that ``train`` takes. ``corpus_scores`` doesn't.
    """
    text, word, place, data, offsets = _placed(column)
    data = np.take(_LOWER, data)
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    last = np.flatnonzero(ends)
    # The last character's bytes: back to the one that begins it.
    code, shift = np.zeros(len(last), np.int64), np.zeros(len(last), np.int64)
    at, open_ = last.copy(), np.arange(len(last))
    for _ in range(4):
        code[open_] = (code[open_]) | (data[at[open_]].astype(np.int64) << shift[open_])
        more = ((data[at[open_]] & 0xC0) == 0x80) & (at[open_] > 0)
        open_ = open_[more]
        at[open_] -= 1
        shift[open_] += 8
    context = np.full(len(text), START, np.int64)
    context[place + 1] = code + 1
    return text, word, context


def _types(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    return mixed(word * _ODD + context.astype(np.uint64) + np.uint64(1))


def _restaurants(texts: DataFrame) -> DataFrame:
    """``(w, ctx, c)``: per word the contexts it is seen in and its customers in each; one shuffle, by word."""

    def count(parts):
        held, n = [], 0

        def flush():
            word, context = (np.concatenate(x) for x in zip(*held))
            _, at, times = np.unique(_types(word, context), return_index=True, return_counts=True)
            for i in range(0, len(at), 1 << 17):
                some = at[i : i + (1 << 17)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word[some].view(np.int64)), pa.array(context[some]), pa.array(times[i : i + (1 << 17)])],
                    ["w", "ctx", "n"],
                )

        for batch in parts:
            _, word, context = tokens(batch.column(0))
            held.append((word, context))
            n += len(word)
            if n >= GATHER:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    counted = arrow_map(texts, count, "w long, ctx long, n long").repartition("w")
    dishes = counted.groupBy("w", "ctx").agg(F.sum("n").alias("c"))
    rows = dishes.groupBy("w").agg(F.collect_list(F.struct("ctx", "c")).alias("d"))
    return rows.select("w", F.col("d.ctx").alias("ctx"), F.col("d.c").alias("c"))


def _gathered(parts, rows: int = ROWS):
    """Small batches put together."""
    held, n = [], 0
    for batch in parts:
        held.append(batch)
        n += len(batch)
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _lists(table: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    values, sizes = list_parts(table.column(column).combine_chunks())
    return values.view(np.int64), sizes


@dataclass
class Totals:
    """Sums over a state: per context its customers and tables, and the parent's customers, tables and dishes."""

    contexts: np.ndarray
    customers: np.ndarray
    tables: np.ndarray
    root_customers: int
    root_tables: int
    words: int

    def of(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each context; 0 for one that was never seen."""
        if not len(self.contexts):
            return np.zeros(len(context), np.int64), np.zeros(len(context), np.int64)
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        known = self.contexts[at] == context
        return np.where(known, self.customers[at], 0), np.where(known, self.tables[at], 0)


def _totals(state: DataFrame, tables: str | None) -> Totals:
    """The totals of a state; without a column of tables every dish has one, and so has every word in the parent."""

    def count(parts):
        for table in _gathered(parts):
            context, sizes = _lists(table, "ctx")
            c, _ = _lists(table, "c")
            t = _lists(table, tables)[0] if tables else np.ones(len(c), np.int64)
            z = np.asarray(table.column(f"{tables}_root")).sum() if tables else len(table)
            names, at = np.unique(context, return_inverse=True)
            sums = [np.bincount(at, x, len(names)).astype(np.int64) for x in (c, t)]
            # The parent's sums come along in the first row.
            first = np.zeros((2, len(names)), np.int64)
            first[:, 0] = z, len(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (names, *sums, *first)], ["ctx", "customers", "tables", "roots", "words"]
            )

    kinds = "ctx long, customers long, tables long, roots long, words long"
    sums = [F.sum(x).alias(x) for x in ("customers", "tables", "roots", "words")]
    # One row per character that ends a word: Unicode bounds them.
    found = arrow_map(state, count, kinds).groupBy("ctx").agg(*sums).orderBy("ctx").toArrow()
    context, customers, tables_, roots, words = (np.asarray(found.column(i).combine_chunks()) for i in range(5))
    return Totals(context, customers, tables_, int(tables_.sum()), int(roots.sum()), int(words.sum()))


def _discount(ones: int, twos: int) -> float:
    return float(np.clip(ones / (ones + 2 * twos) if ones else 0.5, 0.05, 0.95))


def log_stirling(discount: float, most: int) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers ``S[c, t]``: the weight of all seatings of c customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(most + 1)
    for c in range(1, most):
        with np.errstate(divide="ignore", invalid="ignore"):
            stay = np.where(t <= c, out[c] + np.log(np.maximum(c - t * discount, 1e-300)), -np.inf)
        out[c + 1, 1:] = np.logaddexp(out[c, :-1], stay[1:])
        out[c + 1, 0] = -np.inf
    return out


def uniforms(keys: np.ndarray, turn: int) -> np.ndarray:
    """One number in (0, 1) per 64-bit key and turn."""
    step = np.uint64(turn * int(_TURN) % 2**64)
    x = mixed(mixed(keys + step) * _ODD + np.uint64(turn))
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def draw_tables(c, others, p, keys, turn: int, discount: float, strength: float, stirling: np.ndarray) -> np.ndarray:
    """Tables of dishes with ``c`` customers in restaurants that have ``others`` tables besides; ``p``: the parent's probability."""
    out = np.ones(len(c), np.int64)
    first = np.minimum(c, len(stirling) - 1)
    many = np.flatnonzero(c > 1)
    many = many[np.argsort(first[many], kind="stable")]
    sizes, at = np.unique(first[many], return_index=True)
    for size, some in zip(sizes.tolist(), np.split(many, at[1:])):
        t = np.arange(1, size + 1)
        for part in np.array_split(some, max(1, len(some) * size // 2_000_000)):
            weight = np.log(strength + discount * (others[part, None] + t - 1.0)).cumsum(1)
            weight += t * np.log(p[part])[:, None] + stirling[size, 1 : size + 1]
            chance = np.exp(weight - weight.max(1, keepdims=True)).cumsum(1)
            below = chance < uniforms(keys[part], turn)[:, None] * chance[:, -1:]
            out[part] = np.minimum(1 + below.sum(1), size)
    rest = np.flatnonzero(c > first)
    seated, step = first[rest].copy(), 1
    while len(rest):
        more = np.minimum(c[rest] - seated, np.maximum(1, seated // 16))
        opening = (strength + discount * (others[rest] + out[rest])) * p[rest]
        mean = more * opening / (opening + seated - discount * out[rest])
        out[rest] += np.minimum(np.floor(mean + uniforms(keys[rest], turn * 1_000 + step)).astype(np.int64), more)
        seated += more
        left = seated < c[rest]
        rest, seated, step = rest[left], seated[left], step + 1
    return out


@dataclass
class Settings:
    """What the samples share: discounts and strengths of the contexts (1) and of their parent (0)."""

    discount: float
    root_discount: float
    strength: float = STRENGTH
    root_strength: float = STRENGTH

    def root(self, totals: Totals, customers, tables, less=0):
        """The parent's predictive probability of a dish with so many customers and tables, ``less`` of them gone."""
        base = (self.root_strength + self.root_discount * totals.root_tables) / (totals.words + 1.0)
        customers = customers - less
        tables = np.minimum(tables, customers)
        return (customers - self.root_discount * tables + base) / (self.root_strength + totals.root_customers - less)

    def back_off(self, customers, tables):
        """The weight that a context gives its parent."""
        return (self.strength + self.discount * tables) / (self.strength + customers)


def _swept(table: pa.Table, tables: str | None, totals: Totals, settings: Settings, turn: int, stirlings):
    """New numbers of tables of each dish of a batch of words, and of the words in the parent."""
    word = np.asarray(table.column("w").combine_chunks()).view(np.uint64)
    context, sizes = _lists(table, "ctx")
    c, _ = _lists(table, "c")
    row = np.repeat(np.arange(len(word)), sizes)
    t = _lists(table, tables)[0] if tables else np.ones(len(c), np.int64)
    z = np.asarray(table.column(f"{tables}_root").combine_chunks()) if tables else np.ones(len(word), np.int64)
    customers = np.bincount(row, t, len(word)).astype(np.int64)
    _, in_context = totals.of(context)
    p = settings.root(totals, customers[row], z[row], t)
    keys = _types(word[row], context)
    t = draw_tables(c, in_context - t, p, keys, turn, settings.discount, settings.strength, stirlings[0])
    customers = np.bincount(row, t, len(word)).astype(np.int64)
    base = np.full(len(word), 1.0 / (totals.words + 1))
    z = draw_tables(
        customers, totals.root_tables - z, base, mixed(word), turn, settings.root_discount, settings.root_strength, stirlings[1]
    )
    return t, z, sizes


def _list_array(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


@dataclass
class Model:
    """``words(w, n, roots, ctx, lp)``: per word its count, the parent's probability in each sample, and the logarithm
    to base 10 of its averaged probability in each context it was seen in; and what all words share."""

    words: DataFrame
    settings: Settings
    samples: list[Totals]
    train_tokens: int
    train_words: int

    @property
    def unknown(self) -> list[float]:
        """The parent's probability, in each sample, of a word that was never seen."""
        return [float(self.settings.root(s, 0, 0)) for s in self.samples]

    def back_off(self, context: np.ndarray) -> np.ndarray:
        """The weight of the parent in each context and sample."""
        return np.stack([self.settings.back_off(*s.of(context)) for s in self.samples], 1)


def train(texts: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES) -> Model:
    """The model of the whole texts in the one column of ``texts``; null and empty ones are an end and nothing else."""
    state = saved(_restaurants(texts), "restaurants")
    totals = _totals(state, None)
    sizes = state.select(
        F.coalesce(F.sum(F.expr("size(filter(c, x -> x = 1))")), F.lit(0)),
        F.coalesce(F.sum(F.expr("size(filter(c, x -> x = 2))")), F.lit(0)),
        F.coalesce(F.sum((F.size("c") == 1).cast("int")), F.lit(0)),
        F.coalesce(F.sum((F.size("c") == 2).cast("int")), F.lit(0)),
    ).first()
    settings = Settings(_discount(*sizes[:2]), _discount(*sizes[2:]))
    stirlings = state.sparkSession.sparkContext.broadcast(
        (log_stirling(settings.discount, EXACT), log_stirling(settings.root_discount, EXACT))
    )
    kept, before = [], None
    for turn in range(1, burn_in + samples + 1):
        # Samples that count stay in the table as columns of their own.
        names = [f"t{i}" for i in range(burn_in + 1, turn)]
        now = f"t{turn}"
        old = [x for name in names for x in (name, f"{name}_root")]

        def sweep(parts, totals=totals, before=before, turn=turn, old=old, now=now):
            for table in _gathered(parts):
                t, z, sizes = _swept(table, before, totals, settings, turn, stirlings.value)
                columns = [table.column(x).combine_chunks() for x in ("w", "ctx", "c", *old)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, _list_array(t, sizes), pa.array(z)], ["w", "ctx", "c", *old, now, f"{now}_root"]
                )

        kinds = ["w long", "ctx array<long>", "c array<long>"]
        kinds += [f"{x} array<long>, {x}_root long" for x in (*names, now)]
        state = saved(arrow_map(state, sweep, ", ".join(kinds)), "sweep")
        totals, before = _totals(state, now), now
        if turn > burn_in:
            kept.append(totals)
    names = [f"t{i}" for i in range(burn_in + 1, burn_in + samples + 1)]

    def averaged(parts):
        for table in _gathered(parts):
            context, sizes = _lists(table, "ctx")
            c, _ = _lists(table, "c")
            row = np.repeat(np.arange(len(table)), sizes)
            roots, mean = [], np.zeros(len(c))
            for name, totals in zip(names, kept):
                t, _ = _lists(table, name)
                z = np.asarray(table.column(f"{name}_root").combine_chunks())
                root = settings.root(totals, np.bincount(row, t, len(table)), z)
                in_context, tables = totals.of(context)
                own = (c - settings.discount * t) / (settings.strength + in_context)
                mean += own + settings.back_off(in_context, tables) * root[row]
                roots.append(root)
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("w").combine_chunks(),
                    pa.array(np.bincount(row, c, len(table)).astype(np.int64)),
                    _list_array(np.stack(roots, 1).ravel(), np.full(len(table), len(roots))),
                    table.column("ctx").combine_chunks(),
                    _list_array(np.log10(mean / len(names)), sizes),
                ],
                ["w", "n", "roots", "ctx", "lp"],
            )

    kinds = "w long, n long, roots array<double>, ctx array<long>, lp array<double>"
    words = saved(arrow_map(state, averaged, kinds), "model")
    return Model(words, settings, kept, int(totals.customers.sum()), totals.words)


@dataclass
class Hot:
    """Frequent words: counts and probabilities, looked up in sorted arrays."""

    words: np.ndarray
    n: np.ndarray
    roots: np.ndarray
    types: np.ndarray
    lp: np.ndarray

    def lookup(self, model_back_off, word: np.ndarray, context: np.ndarray, types: np.ndarray):
        """Count (-1: not a frequent word) and logarithm of the probability of each word in its context."""
        if not len(self.words):
            return np.full(len(word), -1), np.zeros(len(word))
        at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        n = np.where(self.words[at] == word, self.n[at], -1)
        there = np.minimum(np.searchsorted(self.types, types), len(self.types) - 1)
        seen = self.types[there] == types
        lp = np.where(seen, self.lp[there], 0.0)
        new = np.flatnonzero((n >= 0) & ~seen)
        lp[new] = np.log10((model_back_off(context[new]) * self.roots[at[new]]).mean(1))
        return n, lp


def _hot(words: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The frequent words, with at most ``most`` probabilities in all, and the others; a count parts them."""
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = words.groupBy(level.alias("level")).agg(F.sum(F.size("lp")).alias("types")).collect()
    total, least = 0, 10_000
    for row in sorted(sizes, key=lambda r: -r["level"]):
        total += row["types"]
        if total > most:
            break
        least = row["level"]
    return words.where(level >= least), words.where(level < least)


def score(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", hot_types: int = HOT
) -> DataFrame:
    """``(id_col, n_tokens, n_known, base_score, score)`` for every row of ``docs``.

    ``score`` is the sum over a text's tokens of the logarithm (base 10) of the model's averaged probability,
    ``base_score`` that of the unigram ``(c + 0.1) / (N + 0.1 * (V + 1))``. Null and empty texts are an end. Repeated rows
    come back as often as they are given, null ids stay null, further columns are ignored.
    """
    spark = docs.sparkSession
    hot, cold = _hot(model.words, hot_types)
    table = hot.toArrow()
    words = np.asarray(table.column("w").combine_chunks()).view(np.uint64)
    order = np.argsort(words)
    context, sizes = _lists(table, "ctx")
    types = _types(np.repeat(words, sizes), context)
    by_type = np.argsort(types)
    roots = np.asarray(table.column("roots").combine_chunks().flatten()).reshape(len(words), len(model.samples))
    lp = np.asarray(table.column("lp").combine_chunks().flatten())
    n = np.asarray(table.column("n").combine_chunks())
    shared = spark.sparkContext.broadcast(
        (Hot(words[order], n[order], roots[order], types[by_type], lp[by_type]), model.settings, model.samples)
    )
    all_n, floor = model.train_tokens, model.train_tokens + 0.1 * (model.train_words + 1)
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("text")
    )

    def rows(parts):
        hot, settings, samples = shared.value
        back_off = Model(None, settings, samples, 0, 0).back_off
        for batch in parts:
            text, word, context = tokens(batch.column("text"))
            every = _types(word, context)
            types, at, inverse = np.unique(every, return_index=True, return_inverse=True)
            n, lp = hot.lookup(back_off, word[at], context[at], types)
            base = np.where(n >= 0, np.log10((np.maximum(n, 0) + 0.1) / floor), 0.0)
            size = len(batch)
            ids = np.asarray(batch.column("row"))
            own = [np.bincount(text, x[inverse], size) for x in ((n > 0).astype(float), base, lp)]
            # The text's own row has a word of its own that the model doesn't know, and has it 0 times.
            kinds = [
                pa.array(ids),
                batch.column("id"),
                pa.array(np.bincount(text, minlength=size)),
                pa.array(own[0].astype(np.int64)),
                pa.array(own[1]),
                pa.array(own[2]),
                pa.array(mixed(ids.view(np.uint64) + _TURN).view(np.int64)),
                pa.array(np.zeros(size, np.int64)),
                pa.array(np.zeros(size, np.int64)),
            ]
            names = ["row", "id", "n_tokens", "known", "base", "lp", "w", "ctx", "n"]
            yield pa.RecordBatch.from_arrays(kinds, names)
            missing = np.flatnonzero((n < 0)[inverse])
            if not len(missing):
                continue
            pair = inverse[missing] * size + text[missing]
            pair, times = np.unique(pair, return_counts=True)
            one, where = at[pair // size], pair % size
            none = pa.nulls(len(pair), pa.int64())
            zero = pa.array(np.zeros(len(pair)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[where]), none, none, pa.array(np.zeros(len(pair), np.int64)), zero, zero,
                    pa.array(word[one].view(np.int64)), pa.array(context[one]), pa.array(times),
                ],
                names,
            )

    kinds = "row long, id long, n_tokens long, known long, base double, lp double, w long, ctx long, n long"
    asked = arrow_map(texts, rows, kinds)
    contexts = model.samples[0].contexts if model.samples else np.empty(0, np.int64)
    weights = spark.createDataFrame(
        [(int(c), [float(x) for x in b]) for c, b in zip(contexts, model.back_off(contexts))], "ctx long, weights array<double>"
    )
    cold = cold.select("w", F.col("n").alias("c"), "roots", F.col("ctx").alias("seen"), F.col("lp").alias("found"))
    joined = asked.join(cold, "w", "left").join(F.broadcast(weights), "ctx", "left")
    some = len(model.samples)
    unknown = F.array(*[F.lit(x) for x in model.unknown])
    ones = F.array(*[F.lit(1.0)] * some)
    mean = F.aggregate(
        F.zip_with(F.coalesce("roots", unknown), F.coalesce("weights", ones), lambda a, b: a * b),
        F.lit(0.0),
        lambda a, b: a + b,
    ) / F.lit(float(some))
    at = F.coalesce(F.array_position("seen", F.col("ctx")), F.lit(0))
    own = F.when(at > 0, F.get("found", (at - 1).cast("int"))).otherwise(F.log10(mean))
    per_row = joined.select(
        "row",
        "id",
        "n_tokens",
        (F.col("known") + F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
        (F.col("base") + F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + F.lit(0.1)) / F.lit(float(floor)))).alias("base"),
        (F.col("lp") + F.when(F.col("n") > 0, F.col("n") * own).otherwise(0.0)).alias("lp"),
    )
    out = per_row.groupBy("row").agg(
        F.max("id").alias(id_col),
        F.max("n_tokens").alias("n_tokens"),
        F.sum("known").alias("n_known"),
        F.sum("base").alias("base_score"),
        F.sum("lp").alias("score"),
    )
    return out.select(id_col, "n_tokens", "n_known", F.lit(all_n).cast("long").alias("train_tokens"), "base_score", "score")


@dataclass
class Codes:
    """What words are called: a frequent word by its rank, any other by a negative number made of its hash."""

    hashes: np.ndarray
    ranks: np.ndarray

    def of(self, word: np.ndarray) -> np.ndarray:
        code = (word | np.uint64(1 << 63)).view(np.int64)
        if not len(self.hashes):
            return code
        at = np.minimum(np.searchsorted(self.hashes, word), len(self.hashes) - 1)
        return np.where(self.hashes[at] == word, self.ranks[at], code)


def _pairs(word: np.ndarray, before: np.ndarray) -> np.ndarray:
    """One 64-bit name per pair of codes."""
    return mixed(word.view(np.uint64) * _ODD + mixed(before.view(np.uint64) + _TURN))


def _word_counts(texts: DataFrame) -> DataFrame:
    """``(w, c)``: how often each word hash occurs in the learned texts, ends included."""

    def count(parts):
        held, n = [], 0
        for batch in parts:
            word = word_tokens(batch.column(0))[1]
            held.append(word)
            n += len(word)
            if n >= GATHER:
                yield _counted(held)
                held, n = [], 0
        if held:
            yield _counted(held)

    def _counted(held):
        word, times = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(times)], ["w", "n"])

    learned = texts.where("learn").select("text")
    return saved(arrow_map(learned, count, "w long, n long").groupBy("w").agg(F.sum("n").alias("c")), "words")


def _frequent_words(words: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of at most ``most`` words, frequent before rare, then by hash."""
    level = F.floor(F.log2("c") * 8).cast("int")
    total, least = 0, 10_000
    sizes = words.groupBy(level.alias("level")).count().collect()
    for row in sorted(sizes, key=lambda r: -r["level"]):
        total += row["count"]
        if total > most:
            break
        least = row["level"]
    table = words.where(level >= least).toArrow()
    word = np.asarray(table.column("w").combine_chunks()).view(np.uint64)
    c = np.asarray(table.column("c").combine_chunks())
    order = np.lexsort((word, -c))
    return word[order], c[order]


def _seen_pairs(texts: DataFrame, codes) -> DataFrame:
    """Rows of two kinds. ``sums`` false: the pairs ``(w, u, c)`` of a word, the one before and a count, of those that occur
    twice, are asked for by a text that is not learned, or have a rare word. ``sums`` true, per word ``w`` and task: the
    dishes and single customers of the word (``kw``, ``k1``) and of its restaurant (``ku``, ``s1``)."""

    def count(parts):
        held, n = [], 0

        def flush():
            word, before, learn = (np.concatenate(x) for x in zip(*held))
            word, before = codes.value.of(word), codes.value.of(before)
            names, at, inverse = np.unique(_pairs(word, before), return_index=True, return_inverse=True)
            times = np.bincount(inverse, learn, len(at)).astype(np.int64)
            asked = np.bincount(inverse, ~learn, len(at)) > 0
            word, before = word[at], before[at]
            # Rows of a word lie together, and in one task but for the most frequent words.
            spread = (word >= 0) & (word < SPREAD)
            deal = np.where(spread, names, mixed(word.view(np.uint64))).view(np.int64) & 0xFFFF
            order = np.argsort(word, kind="stable")
            for i in range(0, len(order), 1 << 17):
                some = order[i : i + (1 << 17)]
                columns = [pa.array(x[some]) for x in (deal, word, before, times, asked)]
                yield pa.RecordBatch.from_arrays(columns, ["deal", "w", "u", "n", "asked"])

        for batch in parts:
            text, word, before = word_tokens(batch.column("text"))
            learn = np.asarray(batch.column("learn").cast(pa.int8())).astype(bool)
            held.append((word, before, learn[text]))
            n += len(word)
            if n >= GATHER:
                yield from flush()
                held, n = [], 0
        if held:
            yield from flush()

    def parted(parts):
        for table in _gathered(parts, GATHER // 4):
            w, u, c = (np.asarray(table.column(x).combine_chunks()) for x in ("w", "u", "c"))
            asked = np.asarray(table.column("asked").combine_chunks().cast(pa.int8())) > 0
            keep = np.flatnonzero((c > 1) | asked | (w < 0) | (u < 0))
            none = np.zeros(len(keep), np.int64)
            columns = [pa.array(np.zeros(len(keep), bool)), *(pa.array(x[keep]) for x in (w, u, c)), *[pa.array(none)] * 4]
            names = ["sums", "w", "u", "c", "kw", "k1", "ku", "s1"]
            yield pa.RecordBatch.from_arrays(columns, names)
            dish = c > 0
            keys, at = np.unique(np.concatenate([w[dish], u[dish]]), return_inverse=True)
            of_w, of_u = np.split(at, 2)
            one = (c[dish] == 1).astype(np.int64)
            sums = [np.bincount(of_w, minlength=len(keys)), np.bincount(of_w, one, len(keys))]
            sums += [np.bincount(of_u, minlength=len(keys)), np.bincount(of_u, one, len(keys))]
            none = pa.array(np.zeros(len(keys), np.int64))
            columns = [pa.array(np.ones(len(keys), bool)), pa.array(keys), none, none]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x.astype(np.int64)) for x in sums)], names)

    counted = arrow_map(texts.select("text", "learn"), count, "deal long, w long, u long, n long, asked boolean")
    pairs = counted.repartition("deal").groupBy("deal", "w", "u").agg(F.sum("n").alias("c"), F.max("asked").alias("asked"))
    kinds = "sums boolean, w long, u long, c long, kw long, k1 long, ku long, s1 long"
    return saved(arrow_map(pairs.select("w", "u", "c", "asked"), parted, kinds, BESIDE_TEXTS), "pairs")


def _dense(found: pa.Table, column: str, size: int) -> np.ndarray:
    """A column of ``found`` by rank."""
    out = np.zeros(size, np.int64)
    out[np.asarray(found.column("key").combine_chunks())] = np.asarray(found.column(column).combine_chunks())
    return out


@dataclass
class Restaurants:
    """The sums of all words at one sweep: as arrays for frequent ones, as ``rare(key, c, k1, s1, k, t, z)`` for others.

    ``k`` are a word's customers in the parent and ``z`` its tables there, ``t`` the tables of its own restaurant.
    """

    k: np.ndarray
    t: np.ndarray
    z: np.ndarray
    totals: Totals


def _with_rare(rows: DataFrame, rare: DataFrame, of_w: list[str], of_u: list[str]) -> DataFrame:
    """The rows ``(w, u, ...)`` with what ``rare`` knows of both words, as ``w_<column>`` and ``u_<column>``.

    Only rows with a rare word are joined; frequent words have nulls, as have words that were never seen. The columns hold
    numbers: after each row Spark sets the size of an Arrow batch, which walks all null lists at its end.
    """
    for of, columns in (("w", of_w), ("u", of_u)):
        names = [f"{of}_{c}" for c in columns]
        known = rare.select(F.col("key").alias(of), *[F.col(c).alias(n) for c, n in zip(columns, names)])
        kinds = {f.name: f.dataType for f in known.schema}
        there = rows.where(F.col(of) < 0).join(known, of, "left")
        rows = rows.where(F.col(of) >= 0).select("*", *[F.lit(None).cast(kinds[n]).alias(n) for n in names]).unionByName(there)
    return rows


def _either(codes: np.ndarray, dense: np.ndarray, column: pa.Array) -> np.ndarray:
    """Of each word its entry in ``dense`` or, if it is rare, in the joined column (0: never seen)."""
    out = np.asarray(column.fill_null(0)).copy()
    hot = codes >= 0
    out[hot] = dense[codes[hot]]
    return out


@dataclass
class WordModel:
    """The sampled model of order 2. ``roots`` and ``weights`` hold, per frequent word and sample, the parent's probability
    of the word and what its restaurant gives to the parent; ``pairs(pair, w, c, lp, cw)`` the logarithms of the
    probabilities of pairs, with the count of a word that is rare (-1: frequent)."""

    codes: Codes
    counts: np.ndarray
    roots: np.ndarray
    weights: np.ndarray
    settings: Settings
    pairs: DataFrame | None
    train_tokens: int
    train_words: int


def train_words(texts: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES, hot_words: int = HOT_WORDS) -> WordModel:
    """The model of the texts ``(text, learn)`` that are to be learned, ready to score all of them."""
    spark = texts.sparkSession
    words = _word_counts(texts)
    train_tokens, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    hashes, counts = _frequent_words(words, hot_words)
    hot, by_hash = len(hashes), np.argsort(hashes)
    codes = Codes(hashes[by_hash], by_hash.astype(np.int64))
    seen = _seen_pairs(texts, spark.sparkContext.broadcast(codes))
    sums = [F.sum(x).alias(x) for x in ("kw", "k1", "ku", "s1")]
    sums = saved(seen.where("sums").groupBy(F.col("w").alias("key")).agg(*sums), "word-sums")
    pairs = seen.where("NOT sums").select("w", "u", "c")
    ones, twos, root_ones, root_twos = sums.agg(
        F.coalesce(F.sum("k1"), F.lit(0)),
        F.lit(pairs.where("c = 2").count()),
        F.coalesce(F.sum((F.col("kw") == 1).cast("int")), F.lit(0)),
        F.coalesce(F.sum((F.col("kw") == 2).cast("int")), F.lit(0)),
    ).first()
    settings = Settings(_discount(ones, twos), _discount(root_ones, root_twos))
    stirlings = spark.sparkContext.broadcast(
        (log_stirling(settings.discount, EXACT), log_stirling(settings.root_discount, EXACT))
    )
    found = sums.where("key >= 0").toArrow()
    k1, s1 = (_dense(found, x, hot) for x in ("k1", "s1"))
    code = F.col("w").bitwiseOR(F.lit(-(1 << 63)))
    frequent = words.where(F.col("c") < (int(counts[-1]) if hot else 1 << 62))
    rare = frequent.select(code.alias("key"), "c").join(sums.where("key < 0"), "key", "left").fillna(0)
    rare = rare.select("key", "c", "k1", "s1", F.col("kw").alias("k"), F.col("ku").alias("t"), F.lit(1).cast("long").alias("z"))
    rare = saved(rare.withColumns({"roots": F.array().cast("array<double>"), "weights": F.array().cast("array<double>")}), "rare")

    def totals(k, z) -> Totals:
        more = rare.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum("z"), F.lit(0))).first()
        none = np.empty(0, np.int64)
        return Totals(none, none, none, int(k.sum()) + more[0], int(z.sum()) + more[1], v)

    k, t, z = _dense(found, "kw", hot), _dense(found, "ku", hot), np.ones(hot, np.int64)
    now = Restaurants(k, t, z, totals(k, z))
    state, slices = pairs.where("c > 1"), 4 * spark.sparkContext.defaultParallelism
    kept = []
    for turn in range(1, burn_in + samples + 1):
        # Samples that count stay in the table as columns of their own.
        old = [f"t{i}" for i in range(burn_in + 1, turn)]
        name, before = f"t{turn}", f"t{turn - 1}" if turn > 1 else None
        if before and before not in old:
            carried = ["w", "u", "c", before]
        else:
            carried = ["w", "u", "c", *old]
        shared = spark.sparkContext.broadcast(now)

        def sweep(parts, shared=shared, old=old, name=name, before=before, turn=turn):
            at = shared.value
            for table in _gathered(parts):
                column = lambda x, table=table: table.column(x).combine_chunks()
                w, u, c = (np.asarray(column(x)) for x in ("w", "u", "c"))
                t = np.asarray(column(before)) if before else np.ones(len(c), np.int64)
                k, z, tables = (
                    _either(*x) for x in ((w, at.k, column("w_k")), (w, at.z, column("w_z")), (u, at.t, column("u_t")))
                )
                p = settings.root(at.totals, k, z, t)
                new = draw_tables(
                    c, tables - t, p, _pairs(w, u), turn, settings.discount, settings.strength, stirlings.value[0]
                )
                yield pa.RecordBatch.from_arrays(
                    [*(column(x) for x in ("w", "u", "c", *old)), pa.array(new)], ["w", "u", "c", *old, name]
                )

        rows = _with_rare(state.select(*carried), rare, ["k", "z"], ["t"])
        kinds = ", ".join(f"{x} long" for x in ("w", "u", "c", *old, name))
        state = saved(arrow_map(rows, sweep, kinds, NUMBERS), "word-sweep")
        both = f"stack(2, w, {name}, 0L, u, 0L, {name}) AS (key, k, t)"
        drawn = saved(state.selectExpr(both).groupBy("key").agg(F.sum("k").alias("k"), F.sum("t").alias("t")), "word-tables")
        found = drawn.where("key >= 0").toArrow()
        k, t = k1 + _dense(found, "k", hot), s1 + _dense(found, "t", hot)
        root_draw = _root_draw(k, now, settings, turn, stirlings, spark)
        z = _dense(arrow_map(spark.range(0, hot, 1, slices), root_draw, "key long, z long", NUMBERS).toArrow(), "z", hot)
        moved = drawn.select("key", F.col("k").alias("dk"), F.col("t").alias("dt"))
        rare = rare.join(moved.where("key < 0"), "key", "left").fillna(0, ["dk", "dt"])
        rare = rare.select("key", "c", "k1", "s1", (F.col("k1") + F.col("dk")).alias("k"), (F.col("s1") + F.col("dt")).alias("t"), "z", "roots", "weights")
        rare = saved(arrow_map(rare, _rare_draw(now.totals, settings, turn, stirlings), rare.schema, NUMBERS), "rare")
        now = Restaurants(k, t, z, totals(k, z))
        if turn > burn_in:
            kept.append(now)
            base = (settings.root_strength + settings.root_discount * now.totals.root_tables) / (v + 1.0)
            root = (F.col("k") - settings.root_discount * F.least("z", "k") + base) / (
                settings.root_strength + now.totals.root_customers
            )
            weight = (settings.strength + settings.discount * F.col("t")) / (settings.strength + F.col("c"))
            rare = rare.withColumns({"roots": F.concat("roots", F.array(root)), "weights": F.concat("weights", F.array(weight))})
    roots = np.stack([settings.root(x.totals, x.k, x.z) for x in kept], 1)
    weights = np.stack([settings.back_off(counts, x.t) for x in kept], 1)
    unknown = np.array([float(settings.root(x.totals, 0, 0)) for x in kept])
    model = WordModel(codes, counts, roots, weights, settings, None, int(train_tokens), int(v))
    shared = spark.sparkContext.broadcast((counts, roots, weights))
    names = [f"t{i}" for i in range(burn_in + 1, burn_in + samples + 1)]
    known = {f"{x}{i}": F.col(x)[i] for x in ("roots", "weights") for i in range(samples)}
    by_w, by_u = ([x for x in known if x.startswith(of)] for of in ("roots", "weights"))
    of_w, of_u = [f"w_{x}" for x in by_w], [f"u_{x}" for x in by_u]

    def averaged(parts):
        counts, roots, weights = shared.value
        for table in _gathered(parts):
            column = lambda x, table=table: table.column(x).combine_chunks()
            w, u, c = (np.asarray(column(x)) for x in ("w", "u", "c"))
            t = np.stack([np.asarray(column(x)) for x in names], 1)
            size = _either(u, counts, column("u_c"))
            root, weight = np.tile(unknown, (len(w), 1)), np.ones((len(w), len(names)))
            for codes_, dense, out, columns in ((w, roots, root, of_w), (u, weights, weight, of_u)):
                for i, x in enumerate(columns):
                    there = np.asarray(column(x).is_valid().cast(pa.int8())) > 0
                    out[there, i] = np.asarray(column(x).fill_null(0.0))[there]
                there = codes_ >= 0
                out[there] = dense[codes_[there]]
            lp = np.log10((_own(settings, c[:, None], t, size[:, None]) + weight * root).mean(1))
            cw = np.where(w < 0, np.asarray(column("w_c").fill_null(0)), -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_pairs(w, u).view(np.int64)), *(pa.array(x) for x in (w, c, lp, cw))], ["pair", "w", "c", "lp", "cw"]
            )

    single = pairs.where("c < 2").select("w", "u", "c", *[F.col("c").alias(x) for x in names])
    rare = rare.select("key", "c", *[x.alias(name) for name, x in known.items()])
    rows = _with_rare(state.select("w", "u", "c", *names).unionByName(single), rare, ["c", *by_w], ["c", *by_u])
    model.pairs = saved(arrow_map(rows, averaged, "pair long, w long, c long, lp double, cw long", NUMBERS), "word-model")
    return model


def _own(settings: Settings, c, t, size):
    """What a restaurant of ``size`` customers itself gives a dish."""
    return (c - settings.discount * t) / (settings.strength + size)


def _root_draw(k: np.ndarray, now: Restaurants, settings: Settings, turn: int, stirlings, spark):
    """Draws the parent's tables of the frequent words, given by rank."""
    shared = spark.sparkContext.broadcast((k, now.z, now.totals))

    def draw(parts):
        k, z, totals = shared.value
        for batch in parts:
            rank = np.asarray(batch.column(0))
            z_new = _root_tables(rank, k[rank], z[rank], totals, settings, turn, stirlings.value[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z_new)], ["key", "z"])

    return draw


def _root_tables(code, k, z, totals: Totals, settings: Settings, turn: int, stirling):
    base = np.full(len(code), 1.0 / (totals.words + 1))
    keys = mixed(code.view(np.uint64))
    return draw_tables(k, totals.root_tables - z, base, keys, turn, settings.root_discount, settings.root_strength, stirling)


def _rare_draw(totals: Totals, settings: Settings, turn: int, stirlings):
    """Draws the parent's tables of rare words, in their column ``z``."""

    def draw(parts):
        for table in _gathered(parts):
            key, k, z = (np.asarray(table.column(x).combine_chunks()) for x in ("key", "k", "z"))
            z = pa.array(_root_tables(key, k, z, totals, settings, turn, stirlings.value[1]))
            yield from table.set_column(table.column_names.index("z"), "z", z).to_batches()

    return draw


def _score_words(texts: DataFrame, model: WordModel, hot_pairs: int = HOT) -> DataFrame:
    """``(id, n_tokens, n_known, base_score, score)`` of the texts ``(id, text, learn)`` that the model was made for."""
    spark = texts.sparkSession
    level = F.floor(F.log2("c") * 8).cast("int")
    total, least = 0, 10_000
    often = model.pairs.where("c > 1 AND w >= 0")
    for row in sorted(often.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"]):
        total += row["count"]
        if total > hot_pairs:
            break
        least = row["level"]
    hot = (F.col("c") > 1) & (F.col("w") >= 0) & (level >= least)
    table = model.pairs.where(hot).select("pair", "lp").toArrow()
    names = np.asarray(table.column("pair").combine_chunks()).view(np.uint64)
    order = np.argsort(names)
    lps = np.asarray(table.column("lp").combine_chunks())[order]
    others = model.pairs.where(~F.coalesce(hot, F.lit(False)))
    twice = key_bits(others.where("c > 1"), "pair", BITS)
    shared = spark.sparkContext.broadcast(
        (names[order], lps, model.codes, model.counts, model.roots, model.weights, model.settings)
    )
    floor = model.train_tokens + 0.1 * (model.train_words + 1)

    def rows(parts):
        names, lps, codes, counts, roots, weights, settings = shared.value
        for batch in parts:
            text, word, before = word_tokens(batch.column("text"))
            size = len(batch)
            learn = np.asarray(batch.column("learn").cast(pa.int8())).astype(bool)
            word, before = codes.of(word), codes.of(before)
            every, at, inverse = np.unique(_pairs(word, before), return_index=True, return_inverse=True)
            w, u = word[at], before[at]
            lp, known = np.zeros(len(at)), np.zeros(len(at), bool)
            if len(names):
                there = np.minimum(np.searchsorted(names, every), len(names) - 1)
                known = names[there] == every
                lp[known] = lps[there[known]]
            # Of two frequent words: the probability if the pair was seen once.
            once = np.flatnonzero(~known & (w >= 0) & (u >= 0))
            own = _own(settings, 1, 1, counts[u[once]])
            lp[once] = np.log10(own + (weights[u[once]] * roots[w[once]]).mean(1))
            single = np.zeros(len(at), bool)
            single[once] = ~in_bits(twice.value, every[once], BITS)
            asked = ~known[inverse] & ~(single[inverse] & learn[text])
            frequent = w >= 0
            base = np.zeros(len(at))
            base[frequent] = np.log10((counts[w[frequent]] + 0.1) / floor)
            ids = np.asarray(batch.column("row"))
            columns = [
                pa.array(ids),
                batch.column("id"),
                pa.array(np.bincount(text, minlength=size)),
                pa.array(np.bincount(text, frequent[inverse], size).astype(np.int64)),
                pa.array(np.bincount(text, base[inverse], size)),
                pa.array(np.bincount(text, np.where(asked, 0.0, lp[inverse]), size)),
                pa.array(mixed(ids.view(np.uint64) + _TURN).view(np.int64)),
                pa.array(np.zeros(size, np.int64)),
            ]
            out = ["row", "id", "n_tokens", "known", "base", "lp", "pair", "n"]
            yield pa.RecordBatch.from_arrays(columns, out)
            missing = np.flatnonzero(asked)
            if not len(missing):
                continue
            # By text: its number repeats from row to row.
            both, times = np.unique(text[missing] * len(at) + inverse[missing], return_counts=True)
            one, where = both % len(at), both // len(at)
            zero, none = pa.array(np.zeros(len(both), np.int64)), pa.nulls(len(both), pa.int64())
            columns = [pa.array(ids[where]), none, zero, zero, pa.array(np.zeros(len(both))), pa.array(lp[one])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(every[one].view(np.int64)), pa.array(times)], out)

    texts = texts.withColumn("row", F.monotonically_increasing_id())
    asked = arrow_map(texts, rows, "row long, id long, n_tokens long, known long, base double, lp double, pair long, n long")
    answers = others.select("pair", F.col("lp").alias("found"), "cw")
    joined = asked.join(answers, "pair", "left")
    rare = (F.col("n") > 0) & (F.col("cw") >= 0)
    per_row = joined.select(
        "row",
        "id",
        "n_tokens",
        (F.col("known") + F.when(rare & (F.col("cw") > 0), F.col("n")).otherwise(0)).alias("known"),
        (F.col("base") + F.when(rare, F.col("n") * F.log10((F.col("cw") + 0.1) / F.lit(float(floor)))).otherwise(0.0)).alias("base"),
        F.when(F.col("n") > 0, F.col("n") * F.coalesce("found", "lp")).otherwise(F.col("lp")).alias("lp"),
    )
    return per_row.groupBy("row").agg(
        F.max("id").alias("id"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum("known").alias("n_known"),
        F.sum("base").alias("base_score"),
        F.sum("lp").alias("score"),
    )


def corpus_scores(docs: DataFrame, folds: int = 10, fold: int = 0, hot_pairs: int = HOT, **options) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs(doc_id, text)``.

    Learns from the rows outside the fold (``crc32`` of the id as text, modulo ``folds``); a row without an id is learned
    from. Words are runs of anything but ASCII white space, A-Z lower-cased, and every text ends with one more token. The
    probability of a token is that in the restaurant of the token before. Repeated rows count and come back as often as
    given. An empty table gives no rows.
    """
    texts = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        text_bytes("text").alias("text"),
        (~held_out("doc_id", folds, fold)).alias("learn"),
    )
    model = train_words(texts, **options)
    scores = _score_words(texts, model, hot_pairs).withColumnRenamed("id", "doc_id")
    return scores.select(
        "doc_id",
        held_out("doc_id", folds, fold).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def perplexity(scores: DataFrame, column: str = "score") -> DataFrame:
    """``(held_out, n_tokens, perplexity)``: 10 to the mean negative score per token, learned and held-out texts apart."""
    exponent = -F.sum(column) / F.sum("n_tokens")
    return scores.groupBy("held_out").agg(
        F.sum("n_tokens").alias("n_tokens"), F.pow(F.lit(10.0), exponent).alias("perplexity")
    )
