"""From nodes in shared buckets to components of links, without writing out all pairs of a bucket."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockline.llm.common import Scratch, arrow_map, let_go, long_lists, mixed, ship_package, sliced
from stockline.llm.components import few, joined_components
from stockline.operators.scale import checkpointed

#: A node's bits are turned by each of these; the smallest results give a bucket's hubs, of which there are so many.
#: The first round takes the first one only: it settles the buckets of copies at a quarter of the trials.
TURNS = (0, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D, 0x369DEA0F31A53F85)
#: Rounds of hubs go on while each leaves at most OPEN_LEFT of the pairs that were open; then rare elements find the rest.
HUB_ROUNDS = 6
OPEN_LEFT = 0.5
#: Open pairs are all tried only if the open buckets have at most so many times as many pairs in all.
ALL_PAIRS = 4
#: Rows (bucket, node) that a task holds to find out which are alone: 16 bytes each.
HELD_MEMBERS = 4_000_000
#: Slices of the bucket keys, by their highest bits; a power of two up to 1 << 15. A packed entry has the 32 bits that follow.
SLICES = 1 << 12
#: Nodes that a task packs at a time.
PACKED_NODES = 1 << 14
ENTRY = np.dtype([("key", "<u4"), ("node", "<i8")])
#: Counters of how many nodes have an element; a power of two.
COUNTERS = 1 << 18
#: Words of 64 bits that show which nodes are in shared buckets, at most: 16 MB; a power of two.
BIT_WORDS = 1 << 21
#: Bits of a node's marks; a power of two, at least 64.
MARK_BITS = 1 << 10


def parity_marks(elements: np.ndarray) -> np.ndarray:
    """MARK_BITS bits, as longs: each says whether an odd number of the distinct hashes fall on it.

    The marks of two sets differ in no more bits than the sets differ in elements, so they can rule out a link but never lose one.
    """
    return parity_rows(np.zeros(len(elements), dtype=np.int64), elements, 1)[0]


def parity_rows(of: np.ndarray, elements: np.ndarray, n: int) -> np.ndarray:
    """The parity marks of n sets, a row each; `of` says which set an element is of."""
    slots = of * MARK_BITS + (elements & np.uint64(MARK_BITS - 1)).astype(np.int64)
    odd = (np.bincount(slots, minlength=n * MARK_BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, MARK_BITS), axis=1).view(np.int64)


def packed_members(
    found: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray] | None],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: slice, entries (packed) of the nodes and their bucket keys (n, bands) that `found` gives for a few rows.

    An entry is 12 bytes: with some two million nodes of 32 bands, rows of a bucket and a node each are 18 bytes in a shuffle,
    and the cost of a row. Two buckets of one slice and key count as one, which adds trials but no link.
    """

    def pack(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        keys = np.concatenate([keys for _, keys in held])
        nodes = np.repeat(np.concatenate([nodes for nodes, _ in held]), keys.shape[1])
        keys = keys.reshape(-1).view(np.uint64)
        shift = 64 - SLICES.bit_length() + 1
        of_slice = (keys >> np.uint64(shift)).astype(np.uint16)
        order = np.argsort(of_slice, kind="stable")
        entries = np.empty(len(keys), dtype=ENTRY)
        entries["key"] = (keys[order] >> np.uint64(shift - 32)).astype(np.uint32)  # the lowest 32 of what is left
        entries["node"] = nodes[order]
        slices, starts = np.unique(of_slice[order], return_index=True)
        ends = np.append(starts, len(keys)).astype(np.int32) * np.int32(ENTRY.itemsize)
        packed = pa.Array.from_buffers(pa.binary(), len(slices), [None, pa.py_buffer(ends), pa.py_buffer(entries)])
        return pa.RecordBatch.from_arrays([pa.array(slices.astype(np.int32)), packed], names=["slice", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in sliced(batches):
            if (some := found(part)) is not None:
                held.append(some)
                size += len(some[0])
            if size >= PACKED_NODES:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    return run


def shared_packed(packed: DataFrame) -> DataFrame:
    """members (bucket, node) of the buckets with two nodes or more, from packed members (slice, entries); written to the shared folder.

    One shuffle by slice, after which a task reads slice by slice and throws away what is alone in its bucket. Of a slice of more than
    HELD_MEMBERS entries it holds so many at a time and lets all of them go on, each once. A second
    shuffle, of the few rows that are left, and a window keep the shared buckets.

    A bucket that was held whole is named by a hash of its nodes, so bands that bring the same nodes together are one bucket: near
    copies share most of their bands. Two sets of one hash count as one bucket, which adds trials but no link.
    """

    def together(slice_: int, held: list[bytes], whole: bool) -> pa.RecordBatch:
        entries = np.frombuffer(b"".join(held), dtype=ENTRY)
        key = np.ascontiguousarray(entries["key"])
        if whole:
            # Sorted as one number with their places, which takes less time than sorting places by keys.
            placed = (key.astype(np.uint64) << np.uint64(32)) | np.arange(len(key), dtype=np.uint64)
            placed.sort()
            key = (placed >> np.uint64(32)).astype(np.uint32)
            same = key[1:] == key[:-1]
            chosen = np.r_[same, False] | np.r_[False, same]
            key, node = key[chosen], entries["node"][placed[chosen] & np.uint64(0xFFFFFFFF)]
        else:
            node = entries["node"]
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])][: len(key)]
        key, node = key[fresh], node[fresh]
        bucket = (np.int64(slice_) << np.int64(32)) | key.astype(np.int64)
        if whole and len(key):
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.append(starts, len(key)))
            named = mixed(np.add.reduceat(mixed(node.view(np.uint64)), starts)).view(np.int64)
            chosen = np.repeat(sizes > 1, sizes)
            bucket, node = np.repeat(named, sizes)[chosen], node[chosen]
        return pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(node)], names=["bucket", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, at, whole = [], 0, None, True
        for batch in batches:
            for slice_, entries in zip(batch.column(0).to_pylist(), batch.column(1)):
                if slice_ != at or size > HELD_MEMBERS:
                    whole = whole and slice_ != at
                    if held:
                        yield together(at, held, whole)
                    if slice_ != at:
                        whole = True
                    held, size, at = [], 0, slice_
                held.append(entries.as_buffer())
                size += len(held[-1]) // ENTRY.itemsize
        if held:
            yield together(at, held, whole)

    ship_package(packed.sparkSession)
    dealt = packed.repartition("slice").sortWithinPartitions("slice")
    near = dealt.mapInArrow(run, "bucket long, node long").repartition("bucket")
    return _shared(near.distinct())


def node_bits(members: DataFrame) -> np.ndarray:
    """Words of bits, of which those of the members' nodes are set (see has_bits): 8 bits or more for each row, up to 64 * BIT_WORDS.

    The nodes are hashes. However many there are, the words are of bounded size; with more nodes, more others pass.
    """
    n_words = min(BIT_WORDS, max(1 << 10, 1 << (members.count() // 8).bit_length()))
    word = F.shiftrightunsigned("node", 6).bitwiseAND(F.lit(n_words - 1)).alias("word")
    bit = F.expr("shiftleft(1L, cast(node & 63 as int))")
    found = members.groupBy(word).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most BIT_WORDS rows
    words = np.zeros(n_words, dtype=np.int64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy()
    return words


def has_bits(words: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Whether the nodes' bits are set: true for all members' nodes, and for some others."""
    bits = words[(nodes.view(np.uint64) >> np.uint64(6)) & np.uint64(len(words) - 1)]
    return (bits >> (nodes & 63)) & 1 == 1


def shared_buckets(members: DataFrame) -> DataFrame:
    """members (bucket, node) of the buckets with two nodes or more; written to the shared folder.

    One shuffle by bucket, after which a task throws away what is alone in its bucket, HELD_MEMBERS rows at a time. What meets nobody
    among these goes on if the task has more rows, so nothing is lost and a task holds a bounded number. Of the few rows that are left a
    second shuffle and a window, which spills, keep the shared buckets.
    """

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, whole = [], 0, True
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size > HELD_MEMBERS:
                whole = False
                yield from held
                held, size = [], 0
        if not held:
            return
        table = pa.Table.from_batches(held)
        if whole:
            bucket = table["bucket"].to_numpy()
            order = np.argsort(bucket)
            bucket = bucket[order]
            same = bucket[1:] == bucket[:-1]
            table = table.take(pa.array(order[np.r_[same, False] | np.r_[False, same]]))
        yield from table.to_batches()

    ship_package(members.sparkSession)
    near = members.select("bucket", "node").repartition("bucket").mapInArrow(together, "bucket long, node long")
    return _shared(near)


def _shared(near: DataFrame) -> DataFrame:
    in_bucket = Window.partitionBy("bucket")
    ends = near.select("*", F.min("node").over(in_bucket).alias("low"), F.max("node").over(in_bucket).alias("high"))
    shared = few(ends.filter("low < high").select("bucket", "node").distinct(), 4)
    return Scratch(near.sparkSession, "buckets").write(shared)


def component_per_node(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    sizes: DataFrame | None,
    sets_of: Callable[[DataFrame], DataFrame],
    least_share: float,
    hub_rounds: int = HUB_ROUNDS,
    open_left: float = OPEN_LEFT,
    tried_per_member: int = 1,
    marks_of: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(node, component) under the links that `verify` confirms among nodes of one bucket (bucket, node).

    verify takes distinct pairs (a < b) and returns those that are linked; sizes (node, size) are those of the nodes' sets
    (without them no pair is left out for its sizes), sets_of adds `elements`, distinct longs, to given (node, component); a link has a Jaccard similarity of `least_share`.
    marks_of gives (node, marks), see parity_marks, of given (node), or of all for None: pairs whose marks differ in more bits than the
    sets of a link can differ in elements are not tried. Where all open pairs are, they are ruled out as they meet.
    In each round a few nodes of a bucket are its hubs and are tried against all its nodes; a bucket of copies thus costs
    a few pairs per member. What a hub has to do with its bucket is then settled, and it leaves. Pairs inside a component
    need no trial. When the open pairs are at most tried_per_member times the members of the start, they are all tried.
    With marks_of, a pair that meets costs little: after the first round all open pairs of the buckets with at most tried_per_member pairs
    for each row are tried, whatever their sum, and only larger buckets go on.
    When hubs settle little more, what is left in open buckets are mostly nodes with a part in common, say a
    passage, that is too short for a link. Of these, `rare_pairs` gives all that can be linked, and they are tried. So
    every pair of a bucket is tried, inside one component, or cannot be linked.
    """
    spark = members.sparkSession
    scratch = Scratch(spark, "hubs")
    near = lambda one, other: F.least(one, other) >= least_share * F.greatest(one, other)
    short = lambda df: few(df, 4)
    labels, hubs, before = None, None, float("inf")
    if sizes is None:
        active = members.select("bucket", "node", F.lit(1).cast("long").alias("size"))
    else:
        active = scratch.write(short(members.join(sizes, "node").select("bucket", "node", "size")))
    n_members = active.count()
    for round_ in range(hub_rounds + 1):
        if labels is not None:
            active = short(_open_buckets(_placed(active, labels))).join(hubs, "bucket").filter(~F.array_contains("hubs", F.col("node")))
            active = scratch.write(short(active.drop("hubs")))
            let_go(spark)
            open_pairs, all_pairs = _open_pairs(active)
            if not open_pairs:
                break
            if marks_of is not None and round_ == 1:
                small, large = _by_size(active, 1 + 2 * tried_per_member)
                labels = joined_components(labels, verify(_pairs_across(small, near, least_share, marks_of)))
                if large is None:
                    break
                labels, tried_per_member = checkpointed(few(labels)), 0
                active = scratch.write(short(_placed(large, labels)))
                open_pairs, all_pairs = _open_pairs(active)
                if not open_pairs:
                    break
            most = tried_per_member * n_members
            if open_pairs <= most and all_pairs <= ALL_PAIRS * most:
                labels = joined_components(labels, verify(_pairs_across(active, near, least_share, marks_of)))
                break
            if round_ == hub_rounds or open_pairs > open_left * before:
                left = checkpointed(few(_open_buckets(active).select("node", "component").distinct()))
                tried = rare_pairs(sets_of(left), least_share, marks_of is not None)
                labels = joined_components(labels, verify(tried))
                break
            before = open_pairs
        turns = TURNS[:1] if labels is None else TURNS
        lows = [F.min(F.col("node").bitwiseXOR(F.lit(turn))).bitwiseXOR(F.lit(turn)) for turn in turns]
        hubs = checkpointed(few(active.groupBy("bucket").agg(F.array_distinct(F.array(*lows)).alias("hubs"))))
        with_hubs = active.join(hubs, "bucket")
        ends = with_hubs.select("*", F.explode("hubs").alias("hub")).filter("node <> hub")
        # Most bands of a group of copies name the same few pairs.
        ends = short(short(ends.drop("bucket", "hubs")).distinct())
        if sizes is not None:
            ends = ends.join(sizes.toDF("hub", "_size"), "hub").filter(near("size", "_size"))
        if labels is not None:
            of_hub = labels.toDF("hub", "_in_hub")
            ends = ends.join(of_hub, "hub", "left").filter(F.col("component") != F.coalesce("_in_hub", "hub"))
        both = [] if marks_of is None else [(F.col("size") + F.col("_size")).alias("sizes")]
        tried = ends.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"), *both)
        tried = short(short(tried).distinct())
        if marks_of is not None:
            tried = _not_ruled_out(tried, marks_of(None), least_share)
        labels = checkpointed(few(joined_components(labels, verify(tried))))
        let_go(spark)
    return labels


def _side(rows: DataFrame, on: str, side: str) -> DataFrame:
    """rows as one side of a join on that column: node as `side`, size as `_side`, any other as `_name_side`; marks word by word.

    A condition on words of an array makes code that is too long for the JVM to compile.
    """
    words = _words(side) if "marks" in rows.columns else []
    named = {on: on, "node": side, "size": f"_{side}"}
    return rows.select(*[F.col(c).alias(named.get(c, f"_{c}_{side}")) for c in rows.columns if c != "marks"], *words)


def _words(side: str) -> list[Column]:
    return [F.col("marks")[i].alias(f"_mark{i}_{side}") for i in range(MARK_BITS // 64)]


def _marks_alike(least_share: float, sizes: Column | None = None) -> Column:
    """That the marks of two sides, of sets of sizes _a and _b (or of those sizes in all), do not rule out a link.

    Of sets of similarity t, at most (1 - t) / (1 + t) of the elements of both are not common.
    """
    words = [F.bit_count(F.col(f"_mark{i}_a").bitwiseXOR(F.col(f"_mark{i}_b"))) for i in range(MARK_BITS // 64)]
    return (1 + least_share) * reduce(add, words) <= (1 - least_share) * (F.col("_a") + F.col("_b") if sizes is None else sizes)


def _not_ruled_out(pairs: DataFrame, marks: DataFrame, least_share: float) -> DataFrame:
    """The pairs (a, b) of pairs (a, b, sizes in all) that marks (node, marks) do not rule out."""
    with_a = few(pairs.join(marks.select(F.col("node").alias("a"), *_words("a")), "a"), 4)
    alike = with_a.join(marks.select(F.col("node").alias("b"), *_words("b")), "b")
    return few(alike.filter(_marks_alike(least_share, F.col("sizes"))).select("a", "b"), 4)


def rare_pairs(sets: DataFrame, least_share: float, marked: bool = False) -> DataFrame:
    """Distinct pairs (a < b) across components of sets (node, component, elements), among them all of that similarity.

    Elements are put in one order, the rarest first, as COUNTERS counters show it: an element's counter is that of its low
    bits, so the counters have one size whatever the input, and a poor estimate costs trials but no pair. Two sets of Jaccard
    similarity t share an element within the first size - ceil(t * size) + 1 of each, and what follows their first common
    element is long enough for the overlap they need. With `marked`, pairs whose parity marks differ too much are ruled out as
    they meet.
    """

    def counted(part: pa.RecordBatch) -> dict:
        slots, n = np.unique(part.column(0).flatten().to_numpy() & (COUNTERS - 1), return_counts=True)
        return {"slot": slots, "n": n}

    counts = few(arrow_map(sets.select("elements"), counted, "slot long, n long")).groupBy("slot").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # at most COUNTERS rows
    counters = np.zeros(COUNTERS, dtype=np.int64)
    counters[found["slot"].to_numpy()] = found["n"].to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counters)

    def first(part: pa.RecordBatch) -> dict:
        rows, chosen, sizes, places, marks = [], [], [], [], []
        for i, elements in enumerate(part.column(2)):
            values = elements.values.to_numpy()
            n = shared.value[values & (COUNTERS - 1)]
            order = np.lexsort((values, n))[: len(values) - math.ceil(least_share * len(values)) + 1]
            at = np.flatnonzero(n[order] > 1)  # others have a counter, hence an element, of their own
            rows.append(np.full(len(at), i))
            chosen.append(values[order[at]])
            sizes.append(np.full(len(at), len(values)))
            places.append(at + 1)
            if marked:
                marks.append(parity_marks(values.view(np.uint64)))
        of = pa.array(np.concatenate(rows))
        return {
            "element": np.concatenate(chosen), "node": part.column(0).take(of), "component": part.column(1).take(of),
            "size": np.concatenate(sizes), "place": np.concatenate(places),
            "marks": long_lists(np.stack(marks)).take(of) if marked else None,
        }

    schema = "element long, node long, component long, size long, place long" + marked * ", marks array<long>"
    rare = few(arrow_map(sets.select("node", "component", "elements"), first, schema), 4)
    rare = Scratch(sets.sparkSession, "rare").write(rare)  # a node's marks recur, so they are short in Parquet
    common = 1 + F.least(F.col("_a") - F.col("_place_a"), F.col("_b") - F.col("_place_b"))
    enough = (1 + least_share) * common >= least_share * (F.col("_a") + F.col("_b"))
    across = (F.col("a") < F.col("b")) & (F.col("_component_a") != F.col("_component_b")) & enough
    if marked:
        across &= _marks_alike(least_share)
    met = _side(rare, "element", "a").join(_side(rare, "element", "b"), "element").filter(across)
    return few(few(met.select("a", "b"), 4).distinct(), 4)


def _placed(active: DataFrame, labels: DataFrame) -> DataFrame:
    """active (bucket, node, size) with the component of each node."""
    placed = active.select("bucket", "node", "size").join(labels, "node", "left")
    return placed.select("bucket", "node", "size", F.coalesce("component", "node").alias("component"))


def _by_size(placed: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of the buckets with at most so many rows, and those of the others, if there are any."""
    large = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most)
    large = checkpointed(few(large.select("bucket")))
    if large.isEmpty():
        return placed, None
    return placed.join(large, "bucket", "left_anti"), placed.join(large, "bucket", "left_semi")


def _open_buckets(placed: DataFrame) -> DataFrame:
    """The rows of the buckets that hold more than one component."""
    ends = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return placed.join(ends.filter("low < high").select("bucket"), "bucket", "left_semi")


def _open_pairs(placed: DataFrame) -> tuple[float, float]:
    """(pairs across components, all pairs of the buckets that have such), counted per bucket."""
    sizes = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).cast("double").alias("n"))
    squares = sizes.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("s"))
    across, n = (F.col("n") * F.col("n") - F.col("s")) / 2, F.col("n")
    found = squares.filter(across > 0).agg(F.sum(across), F.sum(n * (n - 1) / 2)).first()
    return found[0] or 0, found[1] or 0


def _pairs_across(
    placed: DataFrame, near: Callable, least_share: float, marks_of: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Distinct pairs (a < b) of a bucket that lie in different components; for short lists of pairs only.

    With marks_of a pair is named by the first bucket that it meets in alone: near copies share most of their buckets.
    """
    alike = near("_a", "_b")
    if marks_of is not None:
        in_order = Window.partitionBy("node").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        placed = _open_buckets(placed).withColumn("earlier", F.collect_list("bucket").over(in_order))  # as many as bands at most
        placed = few(placed.join(marks_of(checkpointed(few(placed.select("node").distinct()))), "node"), 4)
        alike &= _marks_alike(least_share) & ~F.arrays_overlap("_earlier_a", "_earlier_b")
    across = (F.col("a") < F.col("b")) & (F.col("_component_a") != F.col("_component_b")) & alike
    met = _side(placed, "bucket", "a").join(_side(placed, "bucket", "b"), "bucket").filter(across)
    return few(met.select("a", "b"), 4).distinct()
