"""Near-duplicates by SimHash and a self-join of the binary trie of fingerprints (operator 12).

1. A text's fingerprint has a bit for each bit of its shingles' hashes: 1 if over half of them have it.
2. Equal fingerprints are one class. The distinct ones form a binary trie; its node at depth t is what shares the first t bits.
   The join walks down pairs of nodes together, adds up the bits in which they differ, and leaves a pair at once when there
   are more than the budget allows.
3. Two fingerprints that differ in at most 4 bits differ in at most 2 of the first 32, or in at most 1 of the last 32. So two
   tries are joined, the second one of the fingerprints with their halves exchanged, each with that smaller budget for its first
   32 bits. That keeps the pairs of nodes few: a node has some hundreds of partners, however many fingerprints there are.
4. The top of a trie is walked as a table of node pairs: nodes of more than UNIT fingerprints are split further, so a
   crowded part gets deeper nodes and no task a large one. A pair of nodes that is left is one unit of work, and a task
   walks the rest of it over sorted arrays.
5. A unit sends on links that join components, at most one a fingerprint, and not all pairs. It walks with a budget of 1 bit,
   then 2 and so on, and leaves node pairs that are in one component already: groups of very many near copies come
   together in the first walks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import bound_batches, shared_checkpoint, table
from ._text import returning_memory, utf8
from .minhash_dedup import components

SHINGLE, SEED, BUDGET = 4, 42, 4
#: Fingerprints that a node of a unit may have, and node pairs that a task walks at a time.
UNIT, FRONT = 4096, 1 << 19
#: Shingles hashed before their bits are added up.
STEP = 1 << 16
_LANES = np.uint64(0x0101010101010101)
_ONE = np.uint64(1)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values have each bit, the lowest first: eight counters of a byte side by side in a word."""
    out = np.zeros((8, 8), dtype=np.int64)  # byte, bit in it
    for a in range(0, len(h), 255):
        part = h[a : a + 255]
        for bit in range(8):
            lanes = np.add.reduce((part >> np.uint64(bit)) & _LANES)
            out[:, bit] += np.frombuffer(lanes.astype("<u8").tobytes(), dtype=np.uint8)
    return out.ravel()


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text; 0 without words. bytes.lower and bytes.split know ASCII letters and white space only."""
    words = b" ".join(text.lower().split())
    if not words:
        return 0
    gaps = np.flatnonzero(np.frombuffer(words, dtype=np.uint8) == 0x20)
    start, end = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(words)]))
    k = min(k, len(start))
    start, end = start[: len(start) - k + 1], end[k - 1 :]
    counts = np.zeros(64, dtype=np.int64)
    for a in range(0, len(start), STEP):
        hashes = b"".join([xxhash.xxh64_digest(words[i:j], SEED) for i, j in zip(start[a : a + STEP].tolist(), end[a : a + STEP].tolist(), strict=True)])
        counts += bit_counts(np.frombuffer(hashes, dtype=">u8").astype(np.uint64))
    return int(np.packbits(2 * counts > len(start), bitorder="little").view("<u8")[0])


@returning_memory
def _fingerprints(batches, k: int):
    for batch in batches:
        data, at = utf8(batch.column("text"))
        found = np.array([fingerprint(data[a:b].tobytes(), k) for a, b in zip(at[:-1], at[1:], strict=True)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], names=["id", "f"])


# ---- a unit: the trie below two nodes, as ranges of sorted arrays


def united(parent: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after linking x and y: every label points at the least one of its component."""
    while True:
        x, y = parent[x], parent[y]
        apart = x != y
        if not apart.any():
            return parent
        x, y = x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]


def _split(bits: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
    """Where the second child of each node [lo, hi) of this depth begins."""
    nodes, back = np.unique(lo, return_inverse=True)  # nodes of one depth do not overlap
    end = np.zeros(len(nodes), dtype=np.int64)
    end[back] = hi
    shift = np.uint64(63 - depth)
    middle = np.searchsorted(bits, ((bits[nodes] >> shift) | _ONE) << shift)
    return np.clip(middle, nodes, end)[back]


def walk(bits: np.ndarray, half: int, depth: int, first: int, total: int, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of positions, i < j, whose fingerprints differ in at most `total` bits and at most `first` of the first 32, and
    whose labels differ. bits: sorted, distinct, bits[:half] below one node and bits[half:] below another of the same depth (or
    half = len(bits): below one node, joined with itself)."""
    n = len(bits)
    change = np.flatnonzero(label[1:] != label[:-1]) + 1
    same_until = np.append(change, n)[np.searchsorted(change, np.arange(n), side="right")]
    start = np.array([[0, n, 0, n] if half == n else [0, half, half, n]], dtype=np.int64)
    stack = [(depth, start)]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs) > FRONT:
            stack += [(depth, pairs[: len(pairs) // 2]), (depth, pairs[len(pairs) // 2 :])]
            continue
        a, b, c, d = pairs.T
        one = (label[a] == label[c]) & (same_until[a] >= b) & (same_until[c] >= d)
        small = (b - a == 1) & (d - c == 1)
        ready = small & ~one & (a < c)
        if ready.any():
            i, j = a[ready], c[ready]
            apart = bits[i] ^ bits[j]
            close = (np.bitwise_count(apart) <= total) & (np.bitwise_count(apart >> np.uint64(32)) <= first)
            if close.any():
                yield i[close], j[close]
        a, b, c, d = pairs[~one & ~small].T
        if not len(a):
            continue
        p, q = _split(bits, a, b, depth), _split(bits, c, d, depth)
        itself = a == c
        # The pair of the children 1 and 0 of a node with itself is that of 0 and 1.
        children = [(a, p, c, q), (a, p, q, d), (p, b, q, d), (p[~itself], b[~itself], c[~itself], q[~itself])]
        below = np.concatenate([np.stack(x, axis=1) for x in children])
        below = below[(below[:, 0] < below[:, 1]) & (below[:, 2] < below[:, 3])]
        depth += 1
        apart = bits[below[:, 0]] ^ bits[below[:, 2]]
        budget = first if depth <= 32 else total
        ok = np.bitwise_count(apart >> np.uint64(64 - depth)) <= budget
        if depth > 32:
            ok &= np.bitwise_count(apart >> np.uint64(32)) <= first
        stack.append((depth, below[ok]))


def links_of(bits: np.ndarray, half: int, depth: int, first: int, total: int, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) between roots that join the components of one unit: fewer than there are roots."""
    known, label = np.unique(root, return_inverse=True)
    parent = np.arange(len(known))
    for budget in range(1, total + 1):
        for i, j in walk(bits, half, depth, min(first, budget), budget, parent[label]):
            parent = united(parent, label[i], label[j])
    moved = np.flatnonzero(parent != np.arange(len(known)))
    return known[parent[moved]], known[moved]


@returning_memory
def _unit_links(batches, caps: tuple[int, int], total: int):
    """Rows come sorted by unit (trie, u, v, depth) and side; a unit is complete when the next one begins."""
    unit = ("trie", "u", "v", "depth")

    def edges(rows: pa.Table) -> np.ndarray:
        return np.flatnonzero(np.any([np.diff(rows.column(c).to_numpy()) != 0 for c in unit], axis=0)) + 1

    def send(rows: pa.Table):
        trie, u, v, depth, side, f, root = (rows.column(c).to_numpy() for c in (*unit, "side", "f", "root"))
        cuts, found = edges(rows), [(np.zeros(0, dtype=np.int64),) * 2]
        for a, b in zip([0, *cuts], [*cuts, len(u)], strict=True):
            bits, half = f[a:b].view(np.uint64), int((side[a:b] == 0).sum())
            order = np.concatenate((np.argsort(bits[:half]), half + np.argsort(bits[half:])))
            # The walk wants the side of smaller bits first; sides are nodes, so they do not overlap.
            if half < b - a and bits[half] < bits[0]:
                order, half = np.concatenate((order[half:], order[:half])), b - a - half
            found.append(links_of(bits[order], half, int(depth[a]), caps[trie[a]], total, root[a:b][order]))
        x, y = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        rows = (now if rest is None else pa.concat_tables([rest, now])).combine_chunks()
        cut = int(edges(rows).max(initial=0))
        if cut:
            yield send(rows.slice(0, cut))
        rest = rows.slice(cut)
    if rest is not None and rest.num_rows:
        yield send(rest)


# ---- the top of the tries, as tables


def _node(f: Column, depth: Column) -> Column:
    """The first `depth` bits of a fingerprint, in place."""
    return f.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), F.lit(64) - depth))


def _placed(rows: DataFrame, depth: int) -> DataFrame:
    return rows.select("trie", "f", "root", F.lit(depth).alias("depth"), _node(F.col("f"), F.lit(depth)).alias("node"))


def cut_nodes(rows: DataFrame, depth: int, unit: int) -> tuple[DataFrame, list[DataFrame]]:
    """Rows (trie, f, root) with their node (node, depth) of at most `unit` rows, and the nodes (trie, node, depth, leaf) of each level."""
    key, placed, levels = ["trie", "node", "depth"], [], []
    open_ = _placed(rows, depth)
    while True:
        levels.append(shared_checkpoint(open_.groupBy(*key).agg((F.count("*") <= unit).alias("leaf"))))
        own = open_.join(levels[-1], key)
        placed.append(own.filter("leaf").drop("leaf"))
        if levels[-1].filter("not leaf").isEmpty():
            return reduce(DataFrame.unionByName, placed), levels
        depth = min(64, depth + 4)
        open_ = shared_checkpoint(_placed(own.filter("not leaf"), depth))


def node_pairs(levels: list[DataFrame], depth: int, caps: tuple[int, int], total: int) -> DataFrame:
    """Pairs of leaves (trie, u, du, v, dv), each once, whose common bits differ within the budget; u = v included."""
    masks = [0]
    for _ in range(max(caps)):
        masks = sorted({m ^ (1 << i) for m in masks for i in range(64 - depth, 64)} | set(masks))
    masks = np.array(masks, dtype=np.uint64).view(np.int64).tolist()
    cap = F.when(F.col("trie") == 0, caps[0]).otherwise(caps[1])

    def near(at: Column) -> Column:
        x = F.col("u").bitwiseXOR(F.col("v"))
        return (F.bit_count(_node(x, at)) <= total) & (F.bit_count(_node(x, F.least(at, F.lit(32)))) <= cap)

    top = levels[0].select("trie", F.col("node").alias("u"), F.col("leaf").alias("lu"))
    reach = top.withColumn("mask", F.explode(F.array(*(F.lit(m).cast("long") for m in masks)))).withColumn("v", F.col("u").bitwiseXOR(F.col("mask")))
    pairs = reach.filter("u <= v").join(top.select("trie", F.col("u").alias("v"), F.col("lu").alias("lv")), ["trie", "v"])
    pairs = pairs.withColumns({"du": F.lit(depth), "dv": F.lit(depth)}).filter(near(F.lit(depth))).select("trie", "u", "du", "lu", "v", "dv", "lv")
    for below in levels[1:]:
        pairs = shared_checkpoint(pairs)
        above, depth = depth, min(64, depth + 4)
        child = below.select("trie", _node(F.col("node"), F.lit(above)).alias("up"), "node", "leaf")
        for side, d, leaf in (("u", "du", "lu"), ("v", "dv", "lv")):
            stay, go = pairs.filter(leaf), pairs.filter(~F.col(leaf)).withColumnRenamed(side, "up").drop(leaf)
            moved = go.join(child, ["trie", "up"]).withColumns({side: F.col("node"), leaf: F.col("leaf"), d: F.lit(depth)})
            pairs = stay.unionByName(moved.select(*pairs.columns))
        common = F.least("du", "dv")
        # A node split against itself gives the pair of two children twice.
        parents = F.when(common == depth, F.lit(above)).otherwise(common - 4)
        once = (F.col("du") != F.col("dv")) | (F.col("u") <= F.col("v")) | (_node(F.col("u"), parents) != _node(F.col("v"), parents))
        pairs = pairs.filter(near(common) & once)
    return pairs.select("trie", "u", "du", "v", "dv")


def simhash_components(classes: DataFrame, budget: int = BUDGET, unit: int = UNIT) -> DataFrame:
    """f, root: for each class (f, rep: a fingerprint and its smallest id), the smallest id reachable by links of `budget` bits."""
    classes = shared_checkpoint(classes)
    depth = min(24, max(5, int(np.ceil(np.log2(max(classes.count(), 1) / unit))) + 1))
    caps = (budget // 2, budget - budget // 2 - 1)
    swapped = F.shiftleft("f", 32).bitwiseOR(F.shiftrightunsigned("f", 32))
    both = F.array(F.struct(F.lit(0).alias("trie"), F.col("f").alias("f")), F.struct(F.lit(1).alias("trie"), swapped.alias("f")))
    rows = classes.select(F.inline(both), F.col("rep").alias("root"))
    placed, levels = cut_nodes(rows, depth, unit)
    pairs, at = node_pairs(levels, depth, caps, budget), F.least("du", "dv").alias("at")
    left = pairs.select("trie", F.col("u").alias("node"), F.col("du").alias("depth"), "u", "v", at, F.lit(0).alias("side"))
    right = pairs.filter("u <> v or du <> dv").select("trie", F.col("v").alias("node"), F.col("dv").alias("depth"), "u", "v", at, F.lit(1).alias("side"))
    units = placed.join(left.unionByName(right), ["trie", "node", "depth"]).select("trie", "u", "v", F.col("at").alias("depth"), "side", "f", "root")
    dealt = units.repartition("trie", "u", "v", "depth").sortWithinPartitions("trie", "u", "v", "depth", "side")
    links = shared_checkpoint(dealt.mapInArrow(partial(_unit_links, caps=caps, total=budget), "a long, b long").distinct())
    roots = components(links)
    return classes.join(roots, F.col("rep") == F.col("node"), "left").select("f", F.coalesce("root", "rep").alias("root"))


def simhash_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, budget: int = BUDGET, unit: int = UNIT) -> DataFrame:
    """id, fingerprint (16 lowercase hex digits), component_id (smallest id reachable by links, itself included).

    A-Z are lower-cased, shingles are k words joined by one space, repeats included; fewer words are one shingle; null
    texts and texts without words have fingerprint zero, which links like any other. Rows without an id have a
    fingerprint and no component, and link nothing. Different texts of one id count as linked: each row then has the least
    component of the id's fingerprints. Other columns are not read.
    """
    bound_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    printed = shared_checkpoint(docs.mapInArrow(partial(_fingerprints, k=k), "id long, f long"))
    classes = printed.filter("id is not null").groupBy("f").agg(F.min("id").alias("rep"))
    roots = shared_checkpoint(simhash_components(classes, budget, unit))
    several = printed.groupBy("id").agg(F.min("f").alias("f0"), F.max("f").alias("f1")).filter("f0 <> f1 and id is not null").select("id")
    tied = shared_checkpoint(printed.join(several, "id", "left_semi").join(roots, "f").select(F.col("id"), "root").distinct())
    if not tied.isEmpty():
        ties = components(tied.groupBy("id").agg(F.min("root").alias("a")).join(tied, "id").select("a", F.col("root").alias("b")))
        roots = roots.join(ties.select("node", F.col("root").alias("least")), F.col("root") == F.col("node"), "left").select("f", F.coalesce("least", "root").alias("root"))
    root = F.when(F.col("id").isNotNull(), F.col("root"))
    return printed.join(roots, "f", "left").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), root.alias("component_id"))


def op12_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_near_duplicates(table(spark, sf_dir, "documents"))
