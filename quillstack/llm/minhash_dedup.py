"""Near-duplicates by MinHash: one permutation, optimal densification, banded buckets, star edges (operator 8).

1. One pass turns each text into its set of word shingles, a 128-bit name of the set, and band keys: one hash
   a shingle fills BINS bins with minima; an empty bin copies the first filled one of its own random
   order of bins (optimal densification); ROWS bins make a band key.
2. Equal sets are one class. In each bucket of a band key, every class is paired with the smallest id
   only, so candidates grow with the members of a bucket and not with their square.
3. Pairs are confirmed on full sets. Confirmed links give components.
4. A bucket whose classes are not all in one component may hold a link that its star does not show. Such buckets are cut
   into units of at most two blocks of classes; in a unit, each class looks for partners of other components by
   size and by bitmaps, whose bound never falls below the true intersection, and sends at most STAR of the best
   untried ones to the comparison of full sets. Classes that have more are looked at again, with components grown meanwhile
   and eight times as many, until no class has an untried partner left.

Only step 2 can miss a link, by the two texts sharing no bucket: with 60 bands of 5 bins a pair at similarity 0.75 shares none
with probability below 1e-6 (for sets of many shingles; about 1e-4 for sets of a dozen).
"""

from __future__ import annotations

from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._tables import bound_batches, release_shuffles, shared_checkpoint, table
from ._text import Rolling, chunks, mix, returning_memory, utf8, word_tokens

BANDS, ROWS = 60, 5
BINS = BANDS * ROWS
#: Classes in a block of step 4, and partners that one class sends on in a round.
BLOCK, STAR = 2048, 64
#: Bitmaps have at most so many places; beyond that the bound is looser, not wrong.
MOST_PLACES = 1 << 15
#: Text bytes whose sets a task holds at once.
SLICE_BYTES = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int):
    """The sorted distinct shingle hashes of each text, A-Z lower-cased."""
    words, word_at = word_tokens(_LOWER[data] if len(data) else data, at)
    roll = Rolling(words)
    gram = roll.grams(k)
    for a, b in zip(word_at[:-1], word_at[1:], strict=True):
        if b - a >= k:
            yield np.unique(gram[a : b - k + 1])
        elif b > a:
            yield roll.slices(np.array([a]), np.array([b])) + np.uint64(b - a)
        else:
            yield np.zeros(0, dtype=np.uint64)


@cache
def _preference() -> np.ndarray:
    """For each bin, the random order in which it looks for a filled bin."""
    n = np.arange(BINS * BINS, dtype=np.uint64)
    return (mix(n * _ODD + np.uint64(99)) >> np.uint64(32)).astype(np.uint32).reshape(BINS, BINS)


def sketch(hashes: np.ndarray, preference: np.ndarray) -> np.ndarray:
    """The least value of each bin; an empty bin copies the filled one that it prefers."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    first = np.flatnonzero(np.diff(bins, prepend=np.uint64(BINS)))
    filled = bins[first].astype(np.int64)
    out = np.zeros(BINS, dtype=np.uint64)
    least = np.minimum.reduceat(mix(hashes + _ODD), first)
    out[filled] = least
    if len(filled) < BINS:
        empty = np.ones(BINS, dtype=bool)
        empty[filled] = False
        out[empty] = least[preference[np.ix_(empty, filled)].argmin(axis=1)]
    return out


def band_keys(hashes: np.ndarray, preference: np.ndarray) -> np.ndarray:
    bands = sketch(hashes, preference).reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD
    for column in bands.T:
        key = mix(key ^ column) + _ODD
    return key.view(np.int64)


def key_lists(sets) -> pa.ListArray:
    preference = _preference()
    return lists_of([band_keys(s, preference) if len(s) else np.zeros(0, dtype=np.int64) for s in sets])


def lists_of(keys: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0] + [len(x) for x in keys]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)))


def slices(batch, k: int):
    """(first, last, sets) of a batch, SLICE_BYTES of text at a time."""
    data, at = utf8(batch.column("text"))
    for first, last in chunks(at, SLICE_BYTES):
        yield first, last, list(shingle_sets(data[at[first] : at[last]], at[first : last + 1] - at[first], k))


@returning_memory
def _sketch(batches, k: int):
    for batch in batches:
        for first, last, sets in slices(batch, k):
            n, hi, lo = [], [], []
            for s in sets:
                n.append(len(s))
                m = mix(s)
                hi.append(int(np.add.reduce(m).astype(np.int64)) if len(s) else 0)
                lo.append(int(np.bitwise_xor.reduce(mix(m + _ODD)).astype(np.int64)) if len(s) else 0)
            ids = batch.column("id").slice(first, last - first)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), key_lists(sets)], names=["id", "n", "hi", "lo", "keys"])


@returning_memory
def _sets(batches, k: int):
    for batch in batches:
        for first, last, sets in slices(batch, k):
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, last - first), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "shingles"])


@returning_memory
def _compare(batches):
    for batch in batches:
        distance = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
            union = len(np.union1d(p, q))
            distance.append((len(p) + len(q) - union, union))
        shared, union = zip(*distance, strict=True) if distance else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "shared", "total"])


def occupancy(hashes: np.ndarray) -> bytes:
    """A bit for each place that an element takes; 8 places an element, a power of two in all, MOST_PLACES at most."""
    places = min(MOST_PLACES, 1 << max(6, (8 * len(hashes) - 1).bit_length()))
    bits = np.zeros(places, dtype=np.uint8)
    bits[(mix(hashes + _ODD) & np.uint64(places - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def shared_at_most(n: int, x: np.ndarray, m: np.ndarray, y: np.ndarray) -> np.ndarray:
    """An upper bound of the intersections of a set of n elements and bitmap x with sets of m and rows y: an element whose
    place the other set leaves empty is not shared."""
    while len(x) > y.shape[1]:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while y.shape[1] > len(x):
        y = y[:, : y.shape[1] // 2] | y[:, y.shape[1] // 2 :]
    return np.minimum(n - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), m - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))


@returning_memory
def _occupied(batches):
    for batch in batches:
        sets = [np.frombuffer(x, dtype=np.uint64) for x in batch.column("shingles").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([occupancy(x) for x in sets], pa.binary())], names=["id", "places"])


def partners(rows: pa.Table, percent: int, star: int) -> tuple[list, list, list]:
    """Pairs (a, b), a < b, of one unit that may be linked, at most `star` for each b; and whether b has more of them.

    A pair that shares several bands belongs to the first of them, one of two blocks to their common unit.
    """
    rep, root, n, block = (rows.column(c).to_numpy() for c in ("rep", "root", "n", "block"))
    band, crossing = int(rows.column("band")[0].as_py()), rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
    keys = np.stack(rows.column("bands").to_numpy(zero_copy_only=False)) if band else None
    seen = rows.column("seen").to_pylist()
    places = [np.frombuffer(x, dtype=np.uint8) for x in rows.column("places").to_pylist()]
    width = np.array([len(x) for x in places])
    groups = {int(w): np.flatnonzero(width == w) for w in np.unique(width)}
    bits = {w: np.stack([places[i] for i in own]) for w, own in groups.items()}
    out_a, out_b, out_more = [], [], []
    for x in range(len(rep)):
        found, bound = [], []
        for w, own in groups.items():
            y = own[(rep[own] < rep[x]) & (root[own] != root[x]) & (100 * np.minimum(n[own], n[x]) >= percent * np.maximum(n[own], n[x]))]
            if crossing:
                y = y[block[y] != block[x]]
            if not len(y):
                continue
            most = shared_at_most(n[x], places[x], n[y], bits[w][np.searchsorted(own, y)])
            hit = 100 * most >= percent * (n[x] + n[y] - most)
            y, most = y[hit], most[hit]
            if band and len(y):
                fresh = ~(keys[y][:, :band] == keys[x][:band]).any(axis=1)
                y, most = y[fresh], most[fresh]
            found.append(y)
            bound.append(most / (n[x] + n[y] - most))
        if found:
            y, most = np.concatenate(found), np.concatenate(bound)
            tried = set(seen[x] or ())
            y = [int(a) for a in rep[y[np.lexsort((rep[y], -most))]] if int(a) not in tried]
            out_a += y[:star]
            out_b += [int(rep[x])] * len(y[:star])
            out_more += [len(y) > star] * len(y[:star])
    return out_a, out_b, out_more


@returning_memory
def _units(batches, percent: int, star: int):
    """Rows come sorted by unit; a unit is complete when the next one begins."""

    def pairs(rows: pa.Table):
        edge = np.zeros(rows.num_rows, dtype=bool)
        for c in ("key", "i", "j"):
            v = rows.column(c).to_numpy()
            edge[1:] |= v[1:] != v[:-1]
        cut = [0, *np.flatnonzero(edge).tolist(), rows.num_rows]
        return [(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def send(rows: pa.Table, cuts):
        a, b, more = [], [], []
        for lo, hi in cuts:
            for have, new in zip((a, b, more), partners(rows.slice(lo, hi - lo).combine_chunks(), percent, star), strict=True):
                have += new
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(more, pa.bool_())], names=["a", "b", "more"])

    rest = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        rows = now if rest is None else pa.concat_tables([rest, now])
        cuts = pairs(rows)
        if len(cuts) > 1:
            yield send(rows, cuts[:-1])
        rest = rows.slice(cuts[-1][0])
    if rest is not None and rest.num_rows:
        yield send(rest, [(0, rest.num_rows)])


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared, total): sizes of intersection and union of the full sets of each pair."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_compare, "a long, b long, shared long, total long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (a, b): alternating large and small stars until nothing moves.

    Minima are taken by aggregates and joined back, so a node with very many neighbours is summed up before
    the shuffle. Each round is written to the shared checkpoint folder.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        moved = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = shared_checkpoint(moved.distinct())
        del both, least, large, small, moved
        release_shuffles(now.sparkSession)
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head()
        if state == seen:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        seen = state


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """id, n_shingles (long), component_id (smallest id reachable by links), kept (id = component_id).

    Texts are linked where 100 * intersection >= percent * union of their shingle sets. A text of fewer than k
    words has its whole sequence as one shingle; texts without words are linked with nothing. Rows
    without an id are linked with nothing, have no component and are kept. Different texts of one id count as
    linked. Other columns are not read.
    """
    bound_batches(df.sparkSession)
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketched = shared_checkpoint(docs.mapInArrow(partial(_sketch, k=k), "id long, n long, hi long, lo long, keys array<long>"))
    named = sketched.filter("n > 0 and id is not null")
    classes = named.groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    placed = classes.select("rep", "n", F.posexplode("keys").alias("band", "key"))
    centres = placed.groupBy("key").agg(F.min("rep").alias("centre"), F.min_by("n", "rep").alias("centre_n"), F.count("*").alias("members")).filter("members > 1")
    crowded = shared_checkpoint(placed.join(centres, "key"))
    close = f"100 * least(n, centre_n) >= {percent} * greatest(n, centre_n)"
    wanted = crowded.select(F.col("rep").alias("id")).distinct()
    sets = shared_checkpoint(docs.join(wanted, "id", "left_semi").mapInArrow(partial(_sets, k=k), "id long, shingles binary"))
    similar = f"100 * shared >= {percent} * total"
    tried = shared_checkpoint(crowded.filter("rep <> centre").filter(close).select(F.col("centre").alias("a"), F.col("rep").alias("b")).distinct())
    links = compared(tried, sets).filter(similar).select("a", "b")
    # An id with several texts ties their classes together.
    ids = named.groupBy("id").agg(F.min("hi").alias("h0"), F.max("hi").alias("h1")).filter("h0 <> h1").select("id")
    several = named.select("id", "hi", "lo").join(ids, "id", "left_semi").distinct()
    tied = several.join(classes.select("hi", "lo", "rep"), ["hi", "lo"])
    links = shared_checkpoint(links.unionByName(tied.filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))))
    roots = shared_checkpoint(components(links))

    def undecided(buckets: DataFrame) -> DataFrame:
        """Rows of buckets whose classes are not all in one component."""
        own = buckets.select("key", "band", "rep", "members").join(roots, F.col("rep") == F.col("node"), "left").withColumn("root", F.coalesce("root", "rep")).drop("node")
        mixed = own.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key")
        return own.join(mixed, "key", "left_semi")

    rows = shared_checkpoint(undecided(crowded))
    ids = rows.select(F.col("rep").alias("id")).distinct()
    occupied = sets.join(ids, "id", "left_semi").mapInArrow(_occupied, "id long, places binary")
    low = F.transform("keys", lambda x: x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    facts = shared_checkpoint(occupied.join(classes.select(F.col("rep").alias("id"), "n", low.alias("bands")), "id"))
    star = STAR
    while not rows.isEmpty():
        seen = tried.groupBy(F.col("b").alias("id")).agg(F.collect_list("a").alias("seen"))
        known = facts.join(seen, "id", "left")
        blocks = F.ceil(F.col("members") / BLOCK).cast("int")
        cut = rows.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
        units = cut.select("key", "i", "j", "block", "band", "rep", "root").join(known, F.col("rep") == F.col("id")).drop("id")
        spread = units.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
        found = shared_checkpoint(spread.mapInArrow(partial(_units, percent=percent, star=star), "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more")))
        if found.isEmpty():
            break
        pairs = found.select("a", "b")
        new = shared_checkpoint(compared(pairs, sets).filter(similar).select("a", "b"))
        tried = tried.unionByName(pairs)
        if not new.isEmpty():
            links = links.unionByName(new)
            roots = shared_checkpoint(components(links))
        # Only buckets of classes that had more partners than they could send are looked at again.
        again = found.filter("more").select(F.col("b").alias("rep")).distinct()
        if again.isEmpty():
            break
        keys = crowded.join(again, "rep", "left_semi").select("key").distinct()
        rows, star = shared_checkpoint(undecided(crowded.join(keys, "key", "left_semi"))), 8 * star
        release_shuffles(df.sparkSession)

    class_root = classes.select("hi", "lo", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("hi", "lo", F.coalesce("root", "rep").alias("root"))
    out = sketched.join(class_root, ["hi", "lo"], "left")
    root = F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("id"))
    root = F.when(F.col("id").isNotNull(), F.coalesce(root, F.col("id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(root == F.col("id"), F.lit(True)).alias("kept"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
