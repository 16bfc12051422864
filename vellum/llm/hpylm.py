"""Language-model scoring with a hierarchical Pitman-Yor process.

At the top stands a restaurant for each word context, which is the word before, or the text's start:
its customers are the training tokens that follow it, a text's end among them.  Every context
has one, however rare.  Their tables order their dishes, the words, from one restaurant
of words without context, whose customers they are.  Its tables order from a restaurant that
spells them: a word is its UTF-8 bytes between a start and an end symbol, every symbol drawn
in the restaurant of the symbols before it in the word (at most ``ORDER``).  The tables of such
a context order from the restaurant of the context without its oldest symbol, which all
contexts with that ending share, down to the empty context and a uniform base.  So every string
has a probability and all together have 1, unlike the base score, which gives each
unseen word the same share.

Training gathers, over all training texts:

1. Texts are read once, in runs of bounded size.  A run leaves its distinct words, with
   their training counts, and each document as the sequence of the numbers of these words.
2. Words are added up over all runs (the unigram counts of the base score), and from
   them the symbols after each context.
   Spelling learns from a table per word, so from each distinct word once.
3. Contexts with less than 1 / ``CONTEXTS`` of all symbols get no restaurant; what they
   saw counts in the longest ending that has one.  So an order has at most ``CONTEXTS``
   restaurants, whatever the corpus; that bounds the statistics that are broadcast.
4. Chains, a task each, sample the spelling restaurants' seating by blocked Gibbs: a dish's customers stand up
   and are seated again one by one (in blocks, once there are many) given all else,
   several times, and one seating is kept in proportion to its weight.  Tables of a level are the
   customers of the next one.  The word restaurant is seated the same way, all words in
   parallel, a Spark pass a sweep.  Predictive probabilities are averaged over sweeps and chains.
5. The word restaurant is seated with all tokens first.  Under these word probabilities the
   word contexts are seated: each run sends its distinct bigrams to parts, dealt by context (a
   context of more than an eighth of a part is dealt by bigram instead, and the number of its tables
   estimated in each part from the part's share).  A part adds up its bigrams over all runs and seats
   their restaurants, some sweeps.  Then the word restaurant is seated again, its customers now the
   tables of all word contexts.

Every distinct word is scored once and every distinct bigram of a part too; runs get their words' and
bigrams' shares back and add them up per document.  Counts are joined to runs, never to single occurrences.

Defined cases: a null text is empty and consists of the end alone.  Without training texts all
counts are 0, the base score is 0 * tokens and the model is uniform.  Repeated rows
get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import columns, saved
from vellum.session import ship_code

# Bytes that UTF-8 never has: word start, word end, text end.
START, END, TEXT_END = 0xFE, 0xFF, 0xFD
SYMBOLS = 258
ORDER = 5
CONTEXTS = 20_000
# Discount and concentration by context length.
DISCOUNT = (0.5, 0.6, 0.7, 0.75, 0.8, 0.8)
STRENGTH = (1.0, 1.0, 1.0, 1.0, 1.0, 1.0)
CHAINS, BURN_IN, SWEEPS, SEATINGS = 2, 2, 2, 3
# The same for the restaurants of word contexts.
AFTER_DISCOUNT, AFTER_STRENGTH = 0.8, 1.0
AFTER_BURN_IN, AFTER_SWEEPS = 1, 2
# Tokens whose bigrams make a part, and how many of the largest contexts would fill one.
PART_TOKENS, PART_CONTEXTS = 1 << 20, 8
SEED = 271_828
# The number that stands for the batch of the text end.
END_BATCH = (1 << 52) - 1
RUN_BYTES = 16 << 20
# Symbols in context remembered by a task: a bound of memory, not of input.
REMEMBERED = 300_000


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case: what ``bytes`` means
    by both."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def _runs(texts: list, most: int) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if len(texts) > start:
        yield start, len(texts)


def read_runs(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, held_out, text) as runs: a row per document with the
    numbers of its words in order, and a row per run with its words and their training counts."""
    ship_code(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    schema = columns(run=T.LongType(), doc_id=kind, held_out=T.BooleanType(), n_tokens=T.LongType(),
                     ids=T.ArrayType(T.IntegerType()),
                     words=T.ArrayType(T.BinaryType()), counts=T.ArrayType(T.LongType()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId() << 32
        for batch in batches:
            keys, held, texts = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for start, stop in _runs(texts, RUN_BYTES):
                numbers = _Numbers()
                ids = []
                for t in texts[start:stop]:
                    found = words_of(t)
                    ids.append(np.fromiter(map(numbers.__getitem__, found), dtype=np.int32, count=len(found)))
                train = [i for i in range(stop - start) if not held[start + i]]
                none = np.empty(0, np.int32)
                counts = np.bincount(np.concatenate([none, *(ids[i] for i in train)]), minlength=len(numbers)).astype(np.int64)
                rows = stop - start
                sizes = np.fromiter(map(len, ids), dtype=np.int64, count=rows)
                listed = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), type=pa.int32()),
                                                  pa.array(np.concatenate([none, *ids]), type=pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([run] * rows, type=pa.int64()), keys.slice(start, rows), pa.array(held[start:stop], type=pa.bool_()),
                     pa.array(sizes + 1, type=pa.int64()), listed, pa.nulls(rows, pa.list_(pa.binary())), pa.nulls(rows, pa.list_(pa.int64()))],
                    names=schema.names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([run], type=pa.int64()), pa.nulls(1, keys.type), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.int64()),
                     pa.nulls(1, pa.list_(pa.int32())),
                     pa.array([list(numbers)], type=pa.list_(pa.binary())), pa.array([counts], type=pa.list_(pa.int64()))],
                    names=schema.names)
                run += 1

    return docs.select("doc_id", "held_out", "text").mapInArrow(read, schema)


def spelled(word: bytes) -> bytes:
    return bytes([START]) + word + bytes([END])


def count_symbols(words: DataFrame) -> DataFrame:
    """(gram, n): a context of at most ``ORDER`` symbols and the one after it,
    from (word, n)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), type=pa.binary()), pa.array(list(seen.values()), type=pa.int64())],
                                             names=["gram", "n"])
            seen.clear()
            return out

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = spelled(word)
                for i in range(1, len(s)):
                    seen[s[max(0, i - ORDER):i + 1]] += n
            if len(seen) > 500_000:
                yield flush()
        if seen:
            yield flush()

    return (words.select("word", "n").mapInArrow(count, columns(gram=T.BinaryType(), n=T.LongType()))
            .groupBy("gram").agg(F.sum("n").alias("n")))


def kept_statistics(grams: DataFrame, contexts: int) -> dict[bytes, int]:
    """{gram: n} with every context cut to its longest ending that has at least
    1 / ``contexts`` of all symbols; at most (ORDER * contexts + 1) * SYMBOLS entries."""
    total = grams.agg(F.sum("n")).first()[0] or 0
    size = F.octet_length("gram")
    endings = grams.select("n", F.explode(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.substring("gram", i, size - i))).alias("context"))
    often = endings.groupBy("context").agg(F.sum("n").alias("n")).filter(F.col("n") * contexts >= total)
    kept = {bytes(r["context"]) for r in often.select("context").collect()}
    held = grams.sparkSession.sparkContext.broadcast(kept)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for g in batch.column(0).to_pylist():
                while len(g) > 1 and g[:-1] not in held.value:
                    g = g[1:]
                out.append(g)
            yield pa.RecordBatch.from_arrays([pa.array(out, type=pa.binary()), batch.column(1)], names=["gram", "n"])

    rows = grams.mapInArrow(cut, grams.schema).groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {bytes(r["gram"]): r["n"] for r in rows}


class Levels:
    """The dishes of all restaurants as arrays, by context length."""

    def __init__(self, statistics: dict[bytes, int]):
        self.grams: list[list[bytes]] = []
        self.direct, self.parent, self.context, self.names = [], [], [], []
        dishes = [dict() for _ in range(ORDER + 1)]
        for g, n in sorted(statistics.items()):
            dishes[len(g) - 1][g] = n
        for k in range(ORDER, 0, -1):  # each dish is ordered from the context without the oldest symbol
            for g in dishes[k]:
                dishes[k - 1].setdefault(g[1:], 0)
        for k, mine in enumerate(dishes):
            below = {g: i for i, g in enumerate(self.grams[-1])} if k else {}
            names = {c: i for i, c in enumerate(dict.fromkeys(g[:-1] for g in mine))}
            self.grams.append(list(mine))
            self.names.append(list(names))
            self.direct.append(np.array(list(mine.values()), dtype=np.int64))
            self.parent.append(np.array([below[g[1:]] for g in mine], dtype=np.int64) if k else np.zeros(len(mine), np.int64))
            self.context.append(np.array([names[g[:-1]] for g in mine], dtype=np.int64))


def _seat(c: np.ndarray, p: np.ndarray, strength: float, d: float, others: np.ndarray, rng: np.random.Generator) -> tuple:
    """Tables after seating each dish's ``c`` customers in turn, and the log
    weight of that seating; ``p`` is the dish's probability in the parent, ``others`` the
    restaurant's tables with other dishes."""
    t, weight = np.minimum(c, 1), np.zeros(len(c))
    at = np.flatnonzero(c > 1)
    i = np.ones(len(at), dtype=np.int64)
    while len(at):
        block = np.minimum(np.where(i < 16, 1, i // 8), c[at] - i)
        new = (strength + d * (others[at] + t[at])) * p[at]
        both = new + i - d * t[at]
        t[at] += rng.binomial(block, new / both)
        weight[at] += block * np.log(both)
        i += block
        on = i < c[at]
        at, i = at[on], i[on]
    return t, weight


def _weighed(c: np.ndarray, p: np.ndarray, strength: float, d: float, others: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of one of ``SEATINGS`` seatings of each dish, drawn in proportion to its weight."""
    drawn = [_seat(c, p, strength, d, others, rng) for _ in range(SEATINGS)]
    weight = np.stack([w for _, w in drawn])
    pick = (weight + rng.gumbel(size=weight.shape)).argmax(axis=0)
    return np.stack([t for t, _ in drawn])[pick, np.arange(len(c))]


def run_chain(levels: Levels, seed: int, burn_in: int = BURN_IN, sweeps: int = SWEEPS, seatings: int = SEATINGS) -> tuple[list, list]:
    """Per level: the mean of each dish's own share and of each context's share
    that goes to its parent."""
    rng = np.random.default_rng(seed)
    tables = [np.minimum(d, 1) for d in levels.direct]
    own = [np.zeros(len(d)) for d in levels.direct]
    rest = [np.zeros(len(n)) for n in levels.names]

    def shares(k: int, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, n = levels.context[k], len(levels.names[k])
        all_c, all_t = np.bincount(at, c, n), np.bincount(at, tables[k], n)
        return (c - DISCOUNT[k] * tables[k]) / (STRENGTH[k] + all_c)[at], (STRENGTH[k] + DISCOUNT[k] * all_t) / (STRENGTH[k] + all_c)

    def customers() -> list[np.ndarray]:
        out = [d.copy() for d in levels.direct]
        for k in range(ORDER, 0, -1):
            out[k - 1] += np.bincount(levels.parent[k], tables[k], len(out[k - 1])).astype(np.int64)
        return out

    for k in range(ORDER, -1, -1):  # a table each to begin with
        tables[k] = np.minimum(customers()[k], 1)
    for sweep in range(burn_in + sweeps):
        counts = customers()
        p = []  # of each dish, by level
        for k, c in enumerate(counts):
            mine, down = shares(k, c)
            below = p[k - 1][levels.parent[k]] if k else np.full(len(c), 1 / SYMBOLS)
            p.append(mine + down[levels.context[k]] * below)
        for k in range(ORDER, -1, -1):
            c = levels.direct[k] + (np.bincount(levels.parent[k + 1], tables[k + 1], len(levels.direct[k])).astype(np.int64) if k < ORDER else 0)
            below = p[k - 1][levels.parent[k]] if k else np.full(len(c), 1 / SYMBOLS)
            others = np.bincount(levels.context[k], tables[k], len(levels.names[k]))[levels.context[k]] - tables[k]
            drawn = [_seat(c, below, STRENGTH[k], DISCOUNT[k], others, rng) for _ in range(seatings)]
            weight = np.stack([w for _, w in drawn])
            pick = (weight + rng.gumbel(size=weight.shape)).argmax(axis=0) if len(c) else np.zeros(0, np.int64)
            tables[k] = np.stack([t for t, _ in drawn])[pick, np.arange(len(c))]
        if sweep >= burn_in:
            for k, c in enumerate(customers()):
                mine, down = shares(k, c)
                own[k] += mine / sweeps
                rest[k] += down / sweeps
    return own, rest


class Model:
    """Averaged predictive probabilities of symbols after contexts."""

    def __init__(self, own: dict[bytes, float], rest: dict[bytes, float]):
        self.own, self.rest = own, rest
        self.known: dict[bytes, float] = {}

    def symbol(self, context: bytes, symbol: bytes) -> float:
        p, own, rest = 1 / SYMBOLS, self.own, self.rest
        for k in range(len(context), -1, -1):
            c = context[k:]
            if c in rest:
                p = own.get(c + symbol, 0.0) + rest[c] * p
            elif k < len(context):
                break  # a context without a restaurant has no longer one with
        return p

    def spelling(self, s: bytes) -> float:
        """log10 of the probability of the symbols after the first."""
        known, total = self.known, 0.0
        for i in range(1, len(s)):
            gram = s[i - ORDER:i + 1] if i >= ORDER else s[:i + 1]
            log_p = known.get(gram)
            if log_p is None:
                if len(known) > REMEMBERED:
                    known.clear()
                log_p = known[gram] = math.log10(self.symbol(gram[:-1], gram[-1:]))
            total += log_p
        return total

    def __getstate__(self) -> tuple:
        return self.own, self.rest

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)


class Top:
    """The word restaurant: counts, spelling probabilities and seated tables."""

    def __init__(self, tokens: int, discount: float, strength: float, seed: int):
        self.tokens, self.discount, self.strength, self.seed = tokens, discount, strength, seed
        self.tables: list[float] = []  # of all words, before each sweep

    def seat(self, n: np.ndarray, log_p: np.ndarray, sweep: int, batch: int) -> np.ndarray:
        """Tables of each word after a sweep; the same for the same batch."""
        rng = np.random.default_rng([self.seed, sweep, batch])
        others = np.maximum(self.tables[sweep] - np.minimum(n, 1), 0)
        return _weighed(n, np.power(10.0, log_p), self.strength, self.discount, others, rng)

    def predict(self, n: np.ndarray, log_p: np.ndarray, batch: int) -> np.ndarray:
        """log10 of the mean predictive probability of each word."""
        p, last = np.zeros(len(n)), len(self.tables) - 1
        # What goes to the spelling is kept as a logarithm: long words underflow.
        spelled_share = np.mean([(self.strength + self.discount * t) / (self.strength + self.tokens) for t in self.tables[1:]])
        for sweep in range(last - SWEEPS, last):
            p += (n - self.discount * self.seat(n, log_p, sweep, batch)) / (self.strength + self.tokens) / SWEEPS
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(np.maximum(p, 0)), (log_p + math.log10(spelled_share)) * math.log(10)) / math.log(10)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    first = TaskContext.get().partitionId() << 20
    for i, batch in enumerate(batches):
        if batch.num_rows:
            yield first + i, batch


def seat_words(words: DataFrame, ends: int, end_log_p: float, tokens: int, seed: int) -> Top:
    """Sweeps of the word restaurant over (word, n, log_p); only the number of
    tables comes back of each."""
    once, twice, distinct = words.agg(*[F.count(F.when(test, 1)) for test in (F.col("n") == 1, F.col("n") == 2, F.col("n") > 0)]).first()
    # The usual estimate of the discount from the words seen once and twice.
    top = Top(tokens, min(0.95, max(0.1, (once + 1) / (once + 2 * twice + 2))), 1.0, seed)
    top.tables.append(float(distinct + (ends > 0)))
    spark = words.sparkSession
    for sweep in range(BURN_IN + SWEEPS):
        held = spark.sparkContext.broadcast(top)

        def count(batches: Iterator[pa.RecordBatch], sweep: int = sweep, held=held) -> Iterator[pa.RecordBatch]:
            for i, batch in _numbered(batches):
                t = held.value.seat(batch.column(0).to_numpy(), batch.column(1).to_numpy(), sweep, i)
                yield pa.RecordBatch.from_arrays([pa.array([int(t.sum())], type=pa.int64())], names=["t"])

        seated = words.select("n", "log_p").mapInArrow(count, columns(t=T.LongType())).agg(F.sum("t")).first()[0] or 0
        at_end = top.seat(np.array([ends]), np.array([end_log_p]), sweep, END_BATCH)[0]
        top.tables.append(float(seated + at_end))
    return top


def fit(words: DataFrame, ends: int, *, contexts: int = CONTEXTS, chains: int = CHAINS, seed: int = SEED) -> Model:
    """Spelling model of the distinct training words and, with ``ends``, of the
    text's end."""
    spark = words.sparkSession
    tables = words.select("word", F.lit(1).cast("long").alias("n"))
    statistics = kept_statistics(saved(count_symbols(tables), "lm-symbols"), contexts)
    if ends:
        at = bytes([START, TEXT_END])
        at = at if any(g[:-1] == at[:1] for g in statistics) else at[1:]
        statistics[at] = statistics.get(at, 0) + 1
    if not statistics:
        return Model({}, {})
    levels = Levels(statistics)
    held = spark.sparkContext.broadcast(levels)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chain in batch.column(0).to_pylist():
                own, rest = run_chain(held.value, seed + chain)
                for k in range(ORDER + 1):
                    for kind, names, values in (("own", held.value.grams[k], own[k]), ("rest", held.value.names[k], rest[k])):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([kind] * len(names), type=pa.string()), pa.array(names, type=pa.binary()), pa.array(values, type=pa.float64())],
                            names=["kind", "name", "share"])

    drawn = spark.range(0, chains, 1, chains).mapInArrow(sample, columns(kind=T.StringType(), name=T.BinaryType(), share=T.DoubleType()))
    # Bounded by the statistics: a row per dish and per restaurant.
    rows = drawn.groupBy("kind", "name").agg(F.avg("share").alias("share")).collect()
    own = {bytes(r["name"]): r["share"] for r in rows if r["kind"] == "own"}
    return Model(own, {bytes(r["name"]): r["share"] for r in rows if r["kind"] == "rest"})


def numbered(words: DataFrame) -> DataFrame:
    """``words`` (a written table with ``at``, a ``monotonically_increasing_id``) with ``number`` from 1, without gaps,
    instead of it."""
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    # A row per written partition comes to the driver.
    sizes = words.groupBy(part.alias("of")).agg(F.max(place).alias("last")).orderBy("of").collect()
    starts, start = [], 1
    for r in sizes:
        starts.append((r["of"], start))
        start += r["last"] + 1
    if start > 1 << 32:
        raise ValueError("more than 2^32 distinct words")
    known = words.sparkSession.createDataFrame(starts, "of long, start long")
    return words.join(F.broadcast(known), part == F.col("of")).withColumn("number", F.col("start") + place).drop("of", "start", "at")


class Bigrams:
    """Distinct bigrams of a run, in an order that the same documents and numbers always give.

    ids: the documents' word numbers in the run; number: of each of these words in the corpus;
    many: whether it is a context so frequent that it is dealt by bigram."""

    def __init__(self, ids: pa.ListArray, number: np.ndarray, many: np.ndarray, parts: int):
        offsets = ids.offsets.to_numpy()
        self.sizes = np.diff(offsets).astype(np.int64) + 1
        n_words, rows = len(number), len(self.sizes)
        ends = np.cumsum(self.sizes) - 1
        after = np.full(int(self.sizes.sum()), n_words, dtype=np.int64)  # behind the words stands the end, before them the start
        inside = np.ones(len(after), dtype=bool)
        inside[ends] = False
        after[inside] = ids.flatten().to_numpy()
        before = np.concatenate([np.full(min(1, rows), n_words, dtype=np.int64), after[:-1]])
        found, self.at = np.unique(before * (n_words + 1) + after, return_inverse=True)
        self.before, self.after = np.divmod(found, n_words + 1)
        self.numbers = np.append(number, 0).astype(np.uint64)
        u, w = self.numbers[self.before], self.numbers[self.after]
        mixed = np.where(np.append(many, True)[self.before], (u << np.uint64(32)) | w, u) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
        self.part = ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(parts)).astype(np.int32)
        self.order = np.argsort(self.part, kind="stable")


def seat_contexts(u: np.ndarray, n: np.ndarray, p: np.ndarray, spread: np.ndarray, seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Tables of each dish of word contexts after the last sweep, and their mean over the kept ones.

    u: the dish's context (sorted); n: its customers, at least 1; p: the word's probability;
    spread: how many times as large as what is here its context is."""
    rng = np.random.default_rng(seed)
    context = np.cumsum(np.append(0, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
    tables, mean = np.ones(len(n), dtype=np.int64), np.zeros(len(n))
    many = np.flatnonzero(n > 1)  # one customer has one table
    for sweep in range(AFTER_BURN_IN + AFTER_SWEEPS):
        others = np.bincount(context, tables)[context[many]] * spread[many] - tables[many] if len(many) else np.zeros(0)
        tables[many] = _weighed(n[many], p[many], AFTER_STRENGTH, AFTER_DISCOUNT, others, rng)
        if sweep >= AFTER_BURN_IN:
            mean += tables / AFTER_SWEEPS
    return tables, mean


class Afters:
    """How bigrams are dealt: the number of parts, and the contexts with so many customers that they are
    dealt by bigram (at most ``PART_CONTEXTS`` a part; the text's start is always)."""

    def __init__(self, words: DataFrame, tokens: int):
        self.parts = max(1, -(-tokens // PART_TOKENS))
        most = max(1, tokens // (self.parts * PART_CONTEXTS))
        self.many = np.array([0, *(r["number"] for r in words.filter(F.col("n") > most).select("number").collect())], dtype=np.int64)

    def bigrams(self, ids: pa.ListArray, number: np.ndarray) -> Bigrams:
        return Bigrams(ids, number, np.isin(number, self.many), self.parts)


def seat_afters(texts: DataFrame, placed: DataFrame, end_log_p: float, afters: Broadcast, seed: int) -> DataFrame:
    """What the restaurants of all word contexts leave:

    * ``run``, ``part``, ``shares``: customers less discount of the run's bigrams of a part, as 32-bit floats;
    * ``number``, ``ordered``, ``inside``: a word's tables in all contexts, and those of the context after it
      (number 0: the text's end and its start).

    texts: run, held_out, ids; placed: run, place, number, log_p (of the word restaurant)."""
    dealt = columns(part=T.IntegerType(), run=T.LongType(), u=T.BinaryType(), w=T.BinaryType(), n=T.BinaryType(), log_p=T.BinaryType())
    left_over = columns(run=T.LongType(), part=T.IntegerType(), shares=T.BinaryType(), number=T.LongType(), ordered=T.LongType(), inside=T.DoubleType())

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        place = right.column("place").to_numpy()
        number, log_p = np.zeros(len(place), np.int64), np.full(len(place) + 1, end_log_p)
        number[place] = right.column("number").to_numpy()
        log_p[place] = right.column("log_p").to_numpy()
        grams = afters.value.bigrams(left.column("ids").combine_chunks(), number)
        train = np.repeat(~left.column("held_out").to_numpy().astype(bool), grams.sizes)
        times = np.bincount(grams.at[train], minlength=len(grams.part))
        of = grams.order
        lists = (grams.numbers[grams.before[of]].astype(np.uint32), grams.numbers[grams.after[of]].astype(np.uint32),
                 times[of].astype(np.uint32), np.maximum(log_p, -60_000)[grams.after[of]].astype(np.float16))
        part, starts = np.unique(grams.part[of], return_index=True)
        stops = np.append(starts[1:], len(of))
        made = [pa.array([x[a:b].tobytes() for a, b in zip(starts, stops)], type=pa.binary()) for x in lists]
        return pa.Table.from_arrays([pa.array(part, type=pa.int32()), pa.array([left.column("run")[0].as_py()] * len(part), type=pa.int64()), *made],
                                    names=dealt.names)

    def seat(group: pa.Table) -> pa.Table:
        u, w, n, log_p = [np.frombuffer(b"".join(group.column(c).to_pylist()), dtype=kind)
                          for c, kind in (("u", np.uint32), ("w", np.uint32), ("n", np.uint32), ("log_p", np.float16))]
        part = group.column("part")[0].as_py()
        found, first, at = np.unique(u.astype(np.uint64) << np.uint64(32) | w, return_index=True, return_inverse=True)
        c = np.bincount(at, n).astype(np.int64)
        on = np.flatnonzero(c)
        u, w, c = (found[on] >> np.uint64(32)).astype(np.int64), (found[on] & np.uint64(0xFFFFFFFF)).astype(np.int64), c[on]
        p = np.power(10.0, log_p[first[on]].astype(np.float64))
        tables, mean = seat_contexts(u, c, p, np.where(np.isin(u, afters.value.many), afters.value.parts, 1), [seed, part])
        share = np.zeros(len(found), np.float32)
        share[on] = c - AFTER_DISCOUNT * mean
        stops = np.cumsum([len(x) // 4 for x in group.column("u").to_pylist()])
        shares = [x.tobytes() for x in np.split(share[at], stops[:-1])]
        words, of = np.unique(w, return_inverse=True)
        contexts, by = np.unique(u, return_inverse=True)
        rows, more = len(shares), len(words) + len(contexts)
        return pa.Table.from_arrays(
            [pa.chunked_array([group.column("run").combine_chunks(), pa.nulls(more, pa.int64())]),
             pa.array([part] * rows + [None] * more, type=pa.int32()), pa.array(shares + [None] * more, type=pa.binary()),
             pa.chunked_array([pa.nulls(rows, pa.int64()), pa.array(np.concatenate([words, contexts]), type=pa.int64())]),
             pa.array(np.concatenate([np.zeros(rows), np.bincount(of, tables, len(words)), np.zeros(len(contexts))]).astype(np.int64)),
             pa.array(np.concatenate([np.zeros(rows + len(words)), np.bincount(by, mean, len(contexts))]))], names=left_over.names)

    parts = texts.select("run", "held_out", "ids").groupBy("run").cogroup(placed.groupBy("run")).applyInArrow(deal, dealt)
    return parts.groupBy("part").applyInArrow(seat, left_over)


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", *, contexts: int = CONTEXTS,
          chains: int = CHAINS, seed: int = SEED) -> DataFrame:
    """Learn from the rows that aren't ``held_out`` and score all: ``doc_id``,
    ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` and
    ``perplexity`` (of the model, per token)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    runs = saved(read_runs(rows), "lm-runs")
    texts = runs.filter("words is null").select("run", "doc_id", "held_out", "n_tokens", "ids")
    # The number of a word in its run is its place in the run's list.
    listed = runs.filter("words is not null").select("run", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "one"))
    listed = listed.select(F.col("one.words").alias("word"), F.col("one.counts").alias("n"), F.struct("run", "place").alias("at"))
    # A word has a place in a run at most.
    words = listed.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list("at").alias("places"))
    words = numbered(saved(words.withColumn("at", F.monotonically_increasing_id()), "lm-words"))
    ends = texts.filter("not held_out").count()
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    tokens, distinct = sums[0] + ends, sums[1] + (ends > 0)
    model = fit(words.filter("n > 0"), ends, contexts=contexts, chains=chains, seed=seed)
    held = spark.sparkContext.broadcast(model)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logs = [held.value.spelling(spelled(w)) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(logs, type=pa.float64())], names=kinds.names)

    places = words.schema["places"].dataType
    kinds = columns(number=T.LongType(), n=T.LongType(), places=places, log_p=T.DoubleType())
    spelt = saved(words.select("word", "number", "n", "places").mapInArrow(spell, kinds), "lm-spelt")
    end_log_p = model.spelling(bytes([START, TEXT_END]))

    def predicted(words: DataFrame, top: Top) -> DataFrame:
        """``words`` with the word restaurant's log_p instead of that of the spelling."""
        known = spark.sparkContext.broadcast(top)
        n, log_p = words.columns.index("n"), words.columns.index("log_p")

        def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for i, batch in _numbered(batches):
                logs = known.value.predict(batch.column(n).to_numpy(), batch.column(log_p).to_numpy(), i)
                yield batch.set_column(log_p, "log_p", pa.array(logs, type=pa.float64()))

        return words.mapInArrow(predict, words.schema)

    def at_end(top: Top, n: int) -> float:
        return float(top.predict(np.array([n]), np.array([end_log_p]), END_BATCH)[0])

    top = seat_words(spelt, ends, end_log_p, tokens, seed)
    afters = spark.sparkContext.broadcast(Afters(words, tokens))
    first = predicted(spelt, top).select("number", F.col("log_p").cast("float").alias("log_p"), F.inline("places"))
    after = saved(seat_afters(texts, first, at_end(top, ends), afters, seed), "lm-after")
    ordered = saved(after.filter("number is not null").groupBy(F.col("number").alias("of")).agg(
        F.sum("ordered").alias("ordered"), F.sum("inside").alias("inside")), "lm-ordered", shuffled=True)
    customers = ordered.agg(F.sum("ordered")).first()[0] or 0
    end_ordered, start_inside = ordered.filter("of = 0").select("ordered", "inside").first() or (0, 0.0)
    joined = spelt.join(ordered, F.col("number") == F.col("of"), "left").select(
        F.coalesce("ordered", F.lit(0)).alias("n"), "log_p", "number", F.col("n").alias("count"), F.coalesce("inside", F.lit(0.0)).alias("inside"), "places")
    seated = saved(joined, "lm-seated")
    top = seat_words(seated, end_ordered, end_log_p, customers, seed)
    text_end = at_end(top, end_ordered)

    values = predicted(seated, top).select(F.inline("places"), "number", "count", "log_p", "inside")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(x) for x in names]
    values = values.select("*", *none("int", "part"), *none("binary", "shares")).unionByName(
        after.filter("shares is not null").select("run", *none("int", "place"), *none("long", "number", "count"), *none("double", "log_p", "inside"), "part", "shares"))
    schema = columns(doc_id=texts.schema["doc_id"].dataType, held_out=T.BooleanType(), n_tokens=T.LongType(), n_known=T.LongType(),
                     base_score=T.DoubleType(), score=T.DoubleType())
    floor = -math.log10(tokens + distinct + 1)

    def add_up(left: pa.Table, right: pa.Table) -> pa.Table:
        mine = right.filter(pc.is_valid(right.column("place")))
        place = mine.column("place").to_numpy()
        number = np.zeros(len(place), np.int64)
        count, log_p, inside = np.full(len(place) + 1, ends), np.full(len(place) + 1, text_end), np.full(len(place) + 1, start_inside)
        for to, name in ((number, "number"), (count, "count"), (log_p, "log_p"), (inside, "inside")):
            to[place] = mine.column(name).to_numpy()
        grams = afters.value.bigrams(left.column("ids").combine_chunks(), number)
        shares = right.filter(pc.is_valid(right.column("part"))).select(["part", "shares"]).sort_by("part")
        own = np.empty(len(grams.order))
        own[grams.order] = np.frombuffer(b"".join(shares.column("shares").to_pylist()), dtype=np.float32)
        all_customers = AFTER_STRENGTH + count[grams.before]
        with np.errstate(divide="ignore"):
            shorter = np.log((AFTER_STRENGTH + AFTER_DISCOUNT * inside[grams.before]) / all_customers) + log_p[grams.after] * math.log(10)
            log_after = np.logaddexp(np.log(own / all_customers), shorter) / math.log(10)
        n = len(grams.sizes)
        doc, at = np.repeat(np.arange(n), grams.sizes), grams.after[grams.at]
        total = lambda x: np.bincount(doc, x, n)
        made = [pa.array(total(count[at] > 0).astype(np.int64)), pa.array(total((np.log10(count + 1.0) + floor)[at])),
                pa.array(total(log_after[grams.at]))]
        return pa.Table.from_arrays([left.column("doc_id"), left.column("held_out"), left.column("n_tokens"), *made], names=schema.names)

    out = texts.groupBy("run").cogroup(values.groupBy("run")).applyInArrow(add_up, schema)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score",
                      F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
