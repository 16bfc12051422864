"""Near-dedup by MinHash with tensored banding, links verified on full sets.

A document's set holds its distinct ``words``-word shingles (64-bit hashes of the
ASCII-lower-cased words).  Links join sets whose Jaccard similarity reaches the threshold.

1. One pass takes each document's set digest and two collections, A and B, of
   ``rows`` keys of ``width`` minhashes.  A table key is a pair (A_i, B_j): 2 * rows *
   width minhashes make rows^2 tables with keys of 2 * width minhashes.
2. Equal sets form classes; a class goes on as one node, however many copies it has.
3. Keys of A and B that nobody shares drop out before pairs of them are formed; what
   is left is tables only of documents that share some A_i and some B_j.
4. Small buckets compare all pairs, large ones every node with the pivot, the node with
   the most company over all its buckets (the centre, in a group of copies of one text).
   In large buckets that then still hold several components, the nodes outside the largest component meet all others:
   they are dealt to blocks, and a node goes once to each block of its buckets.  So a group's work is a row per node and block.
   Buckets of more than ``CROWD`` nodes are banded again first, which links most of what links at little cost: a node's
   key goes on with the key of one more collection of ``width`` minhashes, ``SPLITS`` different ones
   for each bucket, out of ``MORE`` from a wider signature, so parts shrink geometrically
   (at 0.85, a link has ``SPLITS`` * 0.61 shared parts for each shared bucket).  Nodes of the pivot's
   component, linked already, only go on to parts that hold a node outside it.  Small parts compare all pairs, large ones meet
   a pivot of their own, for up to ``LEVELS`` levels.  Then the whole buckets are searched, whatever the parts found: the nodes
   outside the largest component meet all others that share a shingle of their prefixes, which all links do (``_prefixes``).
   So all pairs of a bucket, whatever its size, are compared or can't link.  No bucket is dropped or cut.
5. Nodes are compared with blocks of nodes on their full sets, through an index of the block's shingles; of the links
   found a cell (a block and some of its nodes) gives those that join all that they join, at most a row per node and hub.
6. Components come from contraction rounds in Spark (``components``).

A link of similarity s shares a table with probability (1 - (1 - s^width)^rows)^2:
0.9996 at 0.85 with the defaults, more above it.

Defined cases: null and empty texts and texts without words have the empty set, link
with nothing and are kept.  With fewer words than a shingle takes, the whole sequence is
the one shingle.  Rows that agree in id and text get equal results.  A null id ranks
above all others, so it only names a component that has no other.  Empty tables give
empty results; other columns are never touched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import columns, fresh, mark_keys, release_memory, saved, union_all, with_group, with_made

words_of = re.compile(r"[^\x20\x09-\x0D]+").findall

WIDTH, ROWS = 3, 9
SEED = 1_618_033
# Buckets up to this size compare all pairs.
SMALL = 12
# Collections of the wider signature, how many of them go on with a large bucket's key, and how many times.
MORE, SPLITS, LEVELS = 16, 2, 4
# Mixed buckets of more nodes are banded again before the nodes outside their largest component meet others by prefixes.
CROWD = 20_000
# Shingles are counted by so many of their first bits: a table of 1 MB on the driver and in each task.
COUNT_BITS = 18
# Parts with up to this many such nodes pair them with the others one by one, all other parts by blocks.
ODD = 16
# Nodes and bytes of full sets in a block of hubs, the least number of blocks, and bytes of nodes in a cell.
BLOCK, BLOCK_BYTES, BLOCKS, CELL_BYTES = 256, 8 << 20, 16, 2 << 20
# Words remembered by a task: a bound of memory, not of input.
REMEMBERED = 100_000


class _Words(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: str) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_known = _Words()


def forget() -> None:
    """Drops the remembered words: idle workers would keep them during later stages."""
    _known.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") if text else ""
    found = words_of(low)
    if not found:
        return np.empty(0, dtype=np.uint64)
    if len(_known) > REMEMBERED:
        _known.clear()
    h = np.fromiter(map(_known.__getitem__, found), dtype=np.uint64, count=len(found))
    span = min(words, len(h))
    out = np.full(len(h) - span + 1, span, dtype=np.uint64)
    for k in range(span):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - span + 1 + k])
    return np.unique(out)


def _minhashes(sets: list[np.ndarray], n: int, seed: int) -> np.ndarray:
    """(sets, n) minimum of each set under each of n hash functions; no set is
    empty."""
    rng = np.random.default_rng(seed)
    flip = rng.integers(0, 1 << 63, n, dtype=np.uint64)
    odd = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    every = np.concatenate(sets)
    out = np.empty((len(sets), n), dtype=np.uint64)
    for j in range(n):
        x = (every ^ flip[j]) * odd[j]
        out[:, j] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), starts)
    return out


SIGNED = columns(n_shingles=T.LongType(), set_key=T.BinaryType(), keys=T.ArrayType(T.LongType()), more=T.ArrayType(T.LongType()),
                 minhashes=T.BinaryType())


def signatures(docs: DataFrame, text: str, words: int, width: int, rows: int, seed: int) -> DataFrame:
    """``docs`` without ``text``, with ``SIGNED``: the set's size and digest,
    the A keys followed by the B keys, the keys of the wider signature, and 32 bits of each minhash."""
    n_keys = 2 * rows + MORE

    def make(texts: list[str | None]) -> list[list]:
        sets = [shingles(t, words) for t in texts]
        full = [s for s in sets if len(s)]
        lines = iter(())
        if full:
            low = _minhashes(full, n_keys * width, seed)
            keys = np.zeros((len(full), n_keys), dtype=np.uint64) + np.arange(1, n_keys + 1, dtype=np.uint64)
            grouped = low.reshape(len(full), n_keys, width)
            for k in range(width):
                keys = _mix(keys * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, k])
            lines = zip(keys.view(np.int64), (low & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        out: list[list] = [[], [], [], [], []]
        for s in sets:
            made = (len(s), None, None, None, None)
            if len(s):
                k, m = next(lines)
                made = (len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), k[:2 * rows], k[2 * rows:], m.tobytes())
            for column, value in zip(out, made):
                column.append(value)
        return out

    return with_made(docs, text, SIGNED, make, done=forget)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the same for
    all nodes that links connect.

    Each round every node goes to its smallest neighbour and the graph of those
    is what the next round sees, with a fraction of the nodes.  Both sides of every join
    are written tables, so Spark can split the partition of a hub.
    """
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    edges = saved(both.filter("u != v").distinct(), "near-edges", shuffled=True)
    labels = None
    while not edges.isEmpty():
        up = saved(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("p")), "near-parents", shuffled=True)
        if labels is None:
            labels = up.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            labels = saved(labels.join(up, F.col("root") == F.col("u"), "left").select("node", F.coalesce("p", "root").alias("root")),
                           "near-labels", shuffled=True)
        one = edges.join(up, "u").select(F.col("v").alias("u"), F.col("p").alias("q"))
        edges = saved(one.join(up, "u").select(F.col("q").alias("u"), F.col("p").alias("v")).filter("u != v").distinct(), "near-edges", shuffled=True)
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)


class _Hubs:
    """Full sets of a block's hubs as an index: shingle -> the hubs that hold it."""

    def __init__(self, nodes: np.ndarray, sets: list[np.ndarray]):
        self.nodes, self.sizes = nodes, np.array([len(s) for s in sets], dtype=np.int64)
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.found, self.starts, self.counts = np.unique(every[order], return_index=True, return_counts=True)

    def common(self, shingles: np.ndarray) -> np.ndarray:
        """How many of the shingles each hub holds."""
        place = np.minimum(np.searchsorted(self.found, shingles), len(self.found) - 1)
        place = place[self.found[place] == shingles]
        n = self.counts[place]
        at = np.repeat(self.starts[place] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.owner[at], minlength=len(self.nodes))


def _linked(threshold: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The links (a, b) between a cell's nodes and its hubs, by their full sets: of each node one to every
    group of hubs that the links before it haven't joined, which makes the same components as all of them."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made: list[tuple[int, int]] = []
        if left.num_rows and right.num_rows:
            hubs = _Hubs(right.column("node").to_numpy(), _sets(right.column("shingles")))
            group = np.arange(len(hubs.nodes))
            for node, mine in zip(left.column("node").to_pylist(), _sets(left.column("shingles"))):
                common = hubs.common(mine)
                met = np.flatnonzero((100 * common >= threshold * (len(mine) + hubs.sizes - common)) & (hubs.nodes != node))
                if len(met):
                    groups, first = np.unique(group[met], return_index=True)
                    made += [(node, int(hubs.nodes[met[i]])) for i in first]
                    group[np.isin(group, groups)] = groups[0]
        return pa.Table.from_arrays([pa.array([p[i] for p in made], type=pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _sets(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in column.to_pylist()]


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of the sets (a written table: shingles) there are by their first ``COUNT_BITS`` bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << COUNT_BITS, dtype=np.int64)
        for batch in batches:
            for mine in _sets(batch.column(0)):
                np.add.at(n, _slots(mine), 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["slot", "n"])
        release_memory()

    found = sets.select("shingles").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << COUNT_BITS, dtype=np.uint32)
    out[found.column("slot").to_numpy()] = np.minimum(found.column("n").to_numpy(), 0xFFFFFFFF)
    return out


def _prefixes(sets: DataFrame, counts: np.ndarray, threshold: int) -> DataFrame:
    """(node, token): of each set (node, shingles) the first shingles in an order that is the same for all sets, rare ones
    first: so many that sets without a common one among them can't reach the threshold.

    Of sets x and y that link, max(c(x), c(y)) shingles are common, where c(x) is the threshold's share of x, rounded up.
    The one of these that comes first has all the others behind it in both sets, so it is among the first |x| - c(x) + 1
    of x and the first |y| - c(y) + 1 of y."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = []
            for mine in _sets(batch.column(1)):
                # sets are sorted, so equal counts are in the order of the hashes
                order = np.argsort(counts[_slots(mine)], kind="stable")
                tokens.append(mine[order[:len(mine) + 1 + (-threshold * len(mine) // 100)]])
            node = np.repeat(batch.column(0).to_numpy(), [len(t) for t in tokens])
            every = np.concatenate(tokens) if tokens else np.empty(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(every.view(np.int64))], names=["node", "token"])
        release_memory()

    return sets.select("node", "shingles").mapInArrow(run, "node long, token long")


class _Linker:
    """Buckets, signatures and sets of one run, and the rounds over them.

    nodes: node, more; sets: node, shingles; buckets: key, node, and n, the key's nodes, if that is known.
    ``n_hashes`` isn't needed: pairs are compared on their full sets at once."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, buckets: DataFrame, threshold: int, n_hashes: int | None = None):
        self.nodes, self.sets, self.buckets, self.threshold = nodes, sets, buckets, threshold

    def _with_sets(self, rows: DataFrame) -> DataFrame:
        """``rows`` (a written table, a row per node) with the nodes' full sets; only sets that rows name are shuffled."""
        named = mark_keys(self.sets.select(F.col("node").alias("of_node"), "shingles"), rows, "named", [F.col("node")], F.col("of_node"))
        return rows.join(named.filter("named").drop("named"), F.col("node") == F.col("of_node")).drop("of_node")

    def _compared(self, near: DataFrame, hubs: DataFrame) -> DataFrame:
        """Links (a, b) of all components between nodes and hubs: near (node, blocks) names the blocks whose hubs a node
        meets, hubs (node, shingles, block).  The nodes of a block are dealt to cells of about ``CELL_BYTES``."""
        near = saved(self._with_sets(saved(near, "near-met", shuffled=True)), "near-met-sets")
        rows = near.select("node", "shingles", F.explode("blocks").alias("block"))
        bytes_of = near.select(F.explode("blocks").alias("of_block"), F.octet_length("shingles").alias("n"))
        cells = saved(bytes_of.groupBy("of_block").agg(F.ceil(F.sum("n") / CELL_BYTES).cast("int").alias("cells")), "near-cells", shuffled=True)
        left = rows.join(cells, F.col("block") == F.col("of_block")).select(
            "node", "shingles", "block", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int").alias("cell"))
        right = hubs.join(cells, F.col("block") == F.col("of_block")).select(
            "node", "shingles", "block", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
        links = left.groupBy("block", "cell").cogroup(right.groupBy("block", "cell")).applyInArrow(_linked(self.threshold), "a long, b long")
        return saved(links, "near-links")

    def _blocks(self, hubs: DataFrame) -> int:
        """Blocks for hubs (a written table: node, shingles) of about ``BLOCK`` nodes, or fewer large ones."""
        n, size = hubs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("shingles")), F.lit(0))).first()
        return max(BLOCKS, -(-n // BLOCK), -(-size // BLOCK_BYTES))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Links (a, b) by the full sets that join all that the links among the pairs join; b is the one that many have in common."""
        pairs = saved(pairs.filter("a != b").distinct(), "near-pairs", shuffled=True)
        hubs = saved(self._with_sets(saved(pairs.select(F.col("b").alias("node")).distinct(), "near-hubs", shuffled=True)), "near-hub-sets")
        blocks = self._blocks(hubs)
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
        near = pairs.groupBy(F.col("a").alias("node")).agg(F.collect_set(block("b")).alias("blocks"))
        return self._compared(near, hubs.withColumn("block", block("node")))

    def _crowded(self, rest: DataFrame) -> DataFrame:
        """Links between the nodes of each key (rest: key, node, root) and all its nodes outside its largest component.

        Those are dealt to blocks, together if their keys have the same largest component; a node meets the blocks of
        its keys, each once however many keys lead to it."""
        odd = saved(self._outside(rest), "near-outside", shuffled=True)
        near_main = odd.groupBy("node").agg(F.max("main").alias("main"))
        hubs = saved(self._with_sets(saved(near_main, "near-hubs", shuffled=True)), "near-hub-sets")
        sizes = hubs.groupBy(F.col("main").alias("of_main")).agg(F.greatest(
            F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.octet_length("shingles")) / BLOCK_BYTES)).alias("blocks"))
        placed = hubs.join(saved(sizes, "near-block-sizes", shuffled=True), F.col("main") == F.col("of_main")).select(
            "node", "shingles", F.xxhash64("main", F.pmod(F.xxhash64("node"), F.col("blocks"))).alias("block"))
        placed = saved(placed, "near-placed")
        of_key = odd.join(placed.select(F.col("node").alias("of_node"), "block"), F.col("node") == F.col("of_node")).groupBy(
            F.col("key").alias("of_key")).agg(F.collect_set("block").alias("blocks"))
        met = rest.join(saved(of_key, "near-key-blocks", shuffled=True), F.col("key") == F.col("of_key"))
        near = met.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_set("blocks"))).alias("blocks"))
        return self._compared(near, placed)

    def _huge(self, rest: DataFrame) -> DataFrame:
        """Links between the nodes of each key (rest: key, node, root) and all its nodes outside its largest component, as
        ``_crowded`` finds them, but a node only meets blocks that hold a node with a common shingle in both prefixes."""
        odd = saved(self._outside(rest).select("node").distinct(), "near-outside", shuffled=True)
        crowd = saved(self._with_sets(saved(rest.select("node").distinct(), "near-crowd", shuffled=True)), "near-crowd-sets")
        hubs = saved(crowd.join(odd, "node"), "near-hub-sets")
        blocks = self._blocks(hubs)
        block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
        tokens = saved(_prefixes(crowd, _counts(crowd), self.threshold), "near-prefixes")
        named = tokens.join(odd.select(F.col("node").alias("of")), F.col("node") == F.col("of"), "left")
        shared = named.groupBy(F.col("token").alias("of_token")).agg(F.count(F.lit(1)).alias("n"), F.collect_set(
            F.when(F.col("of").isNotNull(), block("of"))).alias("blocks")).filter((F.col("n") > 1) & (F.size("blocks") > 0))
        met = tokens.join(saved(shared.drop("n"), "near-token-blocks"), F.col("token") == F.col("of_token"))
        near = met.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_set("blocks"))).alias("blocks"))
        return self._compared(near, hubs.withColumn("block", block("node")))

    def _within(self, rows: DataFrame) -> DataFrame:
        """All pairs of different components within the keys of few rows (key, node, root)."""
        lists = rows.groupBy("key").agg(F.collect_list(F.struct("node", "root")).alias("m"))
        pair = lambda x, y: F.struct(F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b"))
        # Each member with those behind it in the list.
        pairs = F.flatten(F.transform("m", lambda x, i: F.transform(
            F.filter(F.slice("m", i + 2, F.size("m")), lambda y: y["root"] != x["root"]), lambda y: pair(x, y))))
        return lists.select(F.inline(pairs))

    def _pivots(self, rows: DataFrame) -> DataFrame:
        """(key, pivot, pivot_root): a pivot for each key, of the nodes with most company (rows: key, node, root, n, company,
        apart), one of the main component of the key before it if there is one: only the others pair with it."""
        pivots = rows.groupBy("key").agg(F.max(F.struct(~F.col("apart"), "company", F.xxhash64("key", "node").alias("h"), "node", "root")).alias("p"))
        return saved(pivots.select("key", F.col("p.node").alias("pivot"), F.col("p.root").alias("pivot_root")), "near-pivots", shuffled=True)

    def _split(self, rows: DataFrame, level: int) -> DataFrame:
        """(key, node, origin, apart): large buckets' keys, gone on with by ``SPLITS`` collections each.

        The nodes of a key's main component (rows: key, node, origin, root, main) are linked already; they go on
        only with the collections in which a node outside it agrees with them, or shares a bit with one that does."""
        more = mark_keys(self.nodes.select(F.col("node").alias("of"), "more"), rows, "named", [F.col("node")], F.col("of")).filter("named").drop("named")
        # the collections of a bucket: SPLITS in a row from a place of its own, the next ones a level later
        place = lambda i: F.pmod(F.xxhash64("origin") + F.lit(level * SPLITS + i), F.lit(MORE)).cast("int")
        parts = [F.xxhash64("key", F.lit(i), F.element_at("more", place(i) + 1)).alias(f"key{i}") for i in range(SPLITS)]
        apart = F.col("root") != F.col("main")
        odd = rows.filter(apart).join(more, F.col("node") == F.col("of")).select(*parts)
        sought = saved(union_all([odd.select(F.col(f"key{i}").alias("sought")) for i in range(SPLITS)]), "near-sought-parts", shuffled=True)
        keyed, n = rows.join(more, F.col("node") == F.col("of")).select("node", "origin", apart.alias("apart"), *parts), sought.count()
        for i in range(SPLITS):
            keyed = mark_keys(keyed, sought, f"met{i}", [F.col("sought")], F.col(f"key{i}"), n=n)
        on = F.filter(F.array(*[F.struct(F.col(f"key{i}").alias("key"), (F.col("apart") | F.col(f"met{i}")).alias("on")) for i in range(SPLITS)]),
                      lambda x: x["on"])
        return keyed.select("node", "origin", "apart", F.inline(on)).drop("on")

    def _outside(self, rest: DataFrame) -> DataFrame:
        """The rows of nodes outside their key's largest component, main."""
        roots = rest.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
        main = roots.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
        return rest.join(saved(main, "near-main", shuffled=True), "key").filter("root != main")

    def _odd(self, rest: DataFrame) -> DataFrame:
        """(of_key, odd): a row per key with up to ``ODD`` of its nodes, and their roots, that are outside its largest
        component; the same order for all keys, so keys that share odd nodes take the same ones at a time."""
        odd = self._outside(rest)
        first = Window.partitionBy("key").orderBy(F.xxhash64("node"), "node")
        odd = odd.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= ODD)
        lists = odd.groupBy(F.col("key").alias("of_key")).agg(F.collect_list(F.struct("node", "root")).alias("odd"))
        return saved(lists, "near-odd", shuffled=True)

    def _to_odd(self, rest: DataFrame, odd: DataFrame) -> DataFrame:
        """(node, of): each node with the odd nodes of its keys, once however many keys hold both.

        A row per key and node meets its key's list; lists are merged by node before pairs are formed."""
        apart = F.transform(F.filter("odd", lambda o: o["root"] != F.col("root")), lambda o: o["node"])
        met = rest.join(odd, F.col("key") == F.col("of_key")).select("node", apart.alias("of")).filter(F.size("of") > 0)
        return met.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("of"))).alias("of")).select("node", F.explode("of").alias("of"))

    def labels(self) -> DataFrame:
        """(node, root) for every node of a bucket."""
        nodes = saved(self.buckets.select("node").distinct(), "near-bucketed", shuffled=True)
        labels = nodes.select("node", F.col("node").alias("root"))
        sized = "n" in self.buckets.columns
        rows = self.buckets.select("key", "node", F.col("key").alias("origin"), F.lit(False).alias("apart"), *(["n"] if sized else []))
        for level in range(LEVELS + 1):
            if level or not sized:
                sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                rows = saved(rows.join(saved(sizes, "near-sizes", shuffled=True), "key"), "near-rows", shuffled=True)
            company = rows.groupBy("node").agg(F.sum(F.log2("n")).alias("company"))
            rooted = saved(company.join(labels, "node"), "near-rooted", shuffled=True)
            starred = rows if level == 0 else rows.filter(F.col("n") > SMALL)
            starred = starred.join(rooted, "node")
            pivots = self._pivots(starred)
            starred = saved(starred.join(pivots, "key"), "near-starred", shuffled=True)
            star = starred.filter("root != pivot_root").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
            few = rows.filter(F.col("n") <= SMALL).select("key", "node")
            if level == 0:  # all are apart: what links to a pivot spares the pairs of small buckets
                labels = self._joined(labels, star)
                labels = self._joined(labels, self._within(few.join(labels, "node")))
            else:
                labels = self._joined(labels, star.unionByName(self._within(few.join(labels, "node"))))
            if level == LEVELS:
                break
            rest = self._mixed(rows.filter(F.col("n") > SMALL).select("key", "node", "origin", "n"), labels, pivots)
            whole = rest if level == 0 else whole
            huge = rest.filter(F.col("n") > CROWD)
            if huge.isEmpty():
                break
            rows = self._split(huge, level)
        # The nodes outside the largest component of a bucket meet all its others; parts are only of buckets that do.
        if level:
            huge = self._mixed(whole.filter(F.col("n") > CROWD).select("key", "node", "origin"), labels)
            if not huge.isEmpty():
                labels = self._merged(labels, self._huge(huge))
        rest = self._mixed(whole.filter(F.col("n") <= CROWD).select("key", "node", "origin"), labels)
        odd = saved(self._outside(rest).groupBy(F.col("key").alias("of_key")).agg(F.count(F.lit(1)).alias("odd")), "near-odd-sizes", shuffled=True)
        of_few, of_many = (rest.join(odd.filter(test).select("of_key"), F.col("key") == F.col("of_key"), "left_semi")
                           for test in (F.col("odd") <= ODD, F.col("odd") > ODD))
        if not of_many.isEmpty():
            labels = self._merged(labels, self._crowded(saved(of_many, "near-crowded", shuffled=True)))
        rest = self._mixed(of_few.select("key", "node", "origin"), labels)
        if not rest.isEmpty():
            labels = self._joined(labels, self._to_odd(rest, self._odd(rest)).select(F.col("node").alias("a"), F.col("of").alias("b")))
        return labels

    def _mixed(self, rows: DataFrame, labels: DataFrame, pivots: DataFrame | None = None) -> DataFrame:
        """The rows, with their roots, of the keys that still hold several components; with ``pivots`` also
        main, the root of the key's pivot."""
        rest = rows.join(labels, "node")
        mixed = rest.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
        if pivots is not None:
            mains = pivots.select("key", "pivot").join(labels, F.col("pivot") == F.col("node")).select("key", F.col("root").alias("main"))
            mixed = mixed.join(mains, "key")
        return saved(rest.join(saved(mixed, "near-mixed", shuffled=True), "key"), "near-rest", shuffled=True)

    def _joined(self, labels: DataFrame, pairs: DataFrame) -> DataFrame:
        """Labels after the links among ``pairs``."""
        return self._merged(labels, self.verified(pairs))

    def _merged(self, labels: DataFrame, new: DataFrame) -> DataFrame:
        """Labels after new links."""
        if new.isEmpty():
            return labels
        ends = [labels.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab"]
        rooted = new.join(ends[0], "a").join(ends[1], "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        moved = components(rooted).select(F.col("node").alias("root"), F.col("root").alias("to"))
        labels = labels.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        return saved(labels, "near-labels", shuffled=True)


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id`` (the
    smallest id that links reach) and ``kept`` (it is the row's own)."""
    return _components_of_rows(docs, doc_id, text, **how).drop("text_hash")


def _components_of_rows(docs: DataFrame, doc_id: str, text: str, *, words: int = 5, threshold: int = 80,
                        width: int = WIDTH, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """``near_components`` with ``text_hash``, which tells rows of one id apart."""
    ided = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))
    sigs = saved(signatures(ided, "text", words, width, rows, seed).drop("minhashes"), "near-signatures")
    full = sigs.filter("set_key is not null")
    sizes = full.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"))
    # Written once, so the numbers given here hold for all later reads.
    classes = saved(sizes.withColumn("node", F.monotonically_increasing_id()), "near-classes", shuffled=True)
    # A class whose ids are all null has the rep null.
    named = classes.select("node", F.col("set_key").alias("of_set"), "rep")
    first = full.join(named, (F.col("set_key") == F.col("of_set")) & F.col("doc_id").eqNullSafe(F.col("rep"))).dropDuplicates(["node"])
    nodes = saved(first.select("node", "doc_id", "set_key", "keys", "more"), "near-nodes", shuffled=True)

    single = nodes.select("node", F.posexplode("keys").alias("at", "key"))
    shared = saved(single.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "near-shared", shuffled=True)
    found = mark_keys(single, shared, "shared", [F.col("key")], F.col("key")).filter("shared")
    halves = found.groupBy("node").agg(F.collect_list(F.when(F.col("at") < rows, F.col("key"))).alias("a"),
                                       F.collect_list(F.when(F.col("at") >= rows, F.col("key"))).alias("b"))
    tabled = saved(halves.select("node", F.explode("a").alias("a"), "b").select("node", "a", F.explode("b").alias("b"))
                   .select("node", F.xxhash64("a", "b").alias("key")), "near-tables", shuffled=True)
    company = saved(tabled.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-company", shuffled=True)
    buckets = saved(tabled.join(company, "key"), "near-buckets", shuffled=True)

    sought = saved(buckets.select("node").distinct().join(nodes.select("node", "doc_id", "set_key"), "node"), "near-sought", shuffled=True)
    again = mark_keys(ided.drop("text_hash"), sought, "sought", [F.col("doc_id")], F.col("doc_id")).filter("sought").drop("sought")
    kind = columns(set_key=T.BinaryType(), shingles=T.BinaryType())

    def make(texts: list[str | None]) -> list[list]:
        sets = [shingles(t, words) for t in texts]
        packed = [s.tobytes() for s in sets]
        return [[hashlib.blake2b(p, digest_size=16).digest() for p in packed], packed]

    wanted = sought.select("node", F.col("doc_id").alias("rep"), F.col("set_key").alias("of_set"))
    same = (F.col("set_key") == F.col("of_set")) & F.col("doc_id").eqNullSafe(F.col("rep"))
    sets = saved(with_made(again, "text", kind, make, done=forget).join(wanted, same).dropDuplicates(["node"]).select("node", "shingles"), "near-sets")

    labels = _Linker(nodes, sets, buckets, threshold).labels()
    named = saved(labels.join(classes.select("node", "rep"), "node"), "near-named", shuffled=True)
    roots = named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    linked = named.select("root", "node").join(saved(roots, "near-roots", shuffled=True), "root").select("node", "component_id")
    groups = (classes.join(linked, "node", "left").filter("members > 1 or component_id is not null")
              .select("set_key", F.coalesce("component_id", "rep").alias("component_id"), "members"))
    groups = saved(groups, "near-groups", shuffled=True)
    slim = full.select("doc_id", "text_hash", "n_shingles", "set_key")
    out = with_group(slim, groups, "set_key", "members", max(1, sigs.count())).select(
        "doc_id", "text_hash", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    empty = sigs.filter("set_key is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each component, all columns kept.

    A bit table of the ids that go lets all other rows pass straight from the
    scan; only the few marked ones are joined.
    """
    gone = _components_of_rows(docs, doc_id, text, **how).filter("not kept").select("doc_id", "text_hash").distinct()
    gone = saved(gone, "near-gone", shuffled=True)
    mark, other, hashed = fresh(docs, "marked", "gone_id", "gone_hash")
    row = (F.col(doc_id), F.xxhash64(F.col(text)))
    rows = mark_keys(docs, gone, mark, [F.col("doc_id"), F.col("text_hash")], *row)
    ids = gone.select(F.col("doc_id").alias(other), F.col("text_hash").alias(hashed))
    stay = rows.filter(F.col(mark)).join(ids, row[0].eqNullSafe(F.col(other)) & (row[1] == F.col(hashed)), "left_anti")
    return rows.filter(~F.col(mark)).select(*docs.columns).unionByName(stay.select(*docs.columns))
