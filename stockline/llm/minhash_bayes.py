"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact verification.

A text's words are its runs of other than ASCII white space, A-Z lower-cased; its set are the distinct runs of five
words (with fewer words, the whole sequence). Two documents are linked if 100 * intersection >= 75 * union.

* Documents of equal sets form a class (by two independent 64-bit sums over the set and its size), of which the one
  with the smallest id goes on. Candidates are classes that share a bucket of any band; buckets are worked by hubs
  (see buckets.py), so a bucket of copies costs a pair per member.
* A candidate pair's signatures are compared batch by batch. After each batch the posterior of the similarity given
  the matches so far (uniform prior) decides: if the chance of similarity >= 0.75 is below `miss`, the pair goes.
* Survivors are verified on their full sets of 64-bit shingle hashes.

Null or wordless text: an empty set, linked with nothing. Null doc_id: a copy of the documents of an equal set, not
kept, if one of these has an id; else its own group, component_id null, kept. Rows that repeat a doc_id are one document;
each row is returned. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm.buckets import component_per_node, shared_buckets
from stockline.llm.common import arrow_map, band_keys, long_lists, mixed, only_ids, permutations, row_key
from stockline.llm.components import few
from stockline.llm.stats import beta_cdf
from stockline.operators.scale import checkpointed

WORDS = 5
THRESHOLD = 75  # per cent
BANDS, ROWS = 32, 4  # a pair of similarity 0.75 shares a bucket with probability 0.999995
BATCH = 16  # signature values compared at a time
MISS = 1e-6  # a pair is pruned when it is linked with less than this probability
CHUNK = 4096  # shingles hashed at a time

_SEED = 20_260_517


def shingle_hashes(data: bytes | None) -> np.ndarray:
    """The distinct 64-bit hashes of the 5-word shingles of a UTF-8 text, sorted."""
    words = (data or b"").lower().split()  # on bytes: A-Z only, and the six ASCII white space characters
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    width = min(n, WORDS)
    shingles = np.full(n - width + 1, width, dtype=np.uint64)
    for i in range(width):
        shingles = shingles * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n - width + 1 + i]
    return np.unique(mixed(shingles))


def signature(shingles: np.ndarray, factors: np.ndarray, summands: np.ndarray) -> np.ndarray:
    """The minima of the shingles under each permutation."""
    low = None
    for start in range(0, len(shingles), CHUNK):
        x = shingles[start : start + CHUNK].astype(np.uint32)  # the low half of a mixed hash
        part = (x[None, :] * factors[:, None] + summands[:, None]).min(axis=1)
        low = part if low is None else np.minimum(low, part)
    return low


def features(docs: DataFrame) -> DataFrame:
    """doc_id, row (its row key), n_shingles, set_a, set_b (sums that tell sets apart), signature, bands."""
    factors, summands = permutations(BANDS * ROWS, _SEED)

    def work(part: pa.RecordBatch) -> dict:
        sizes, sums_a, sums_b, rows = [], [], [], np.zeros((part.num_rows, BANDS * ROWS), dtype=np.uint32)
        for i, text in enumerate(part.column(1)):
            shingles = shingle_hashes(text.as_py())
            sizes.append(len(shingles))
            sums_a.append(int(mixed(shingles).sum(dtype=np.uint64).view(np.int64)))
            sums_b.append(int(mixed(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64)))
            if len(shingles):
                rows[i] = signature(shingles, factors, summands)
        return {
            "doc_id": part.column(0), "row": part.column(2), "n_shingles": sizes, "set_a": sums_a, "set_b": sums_b,
            "signature": [row.tobytes() for row in rows], "bands": long_lists(band_keys(rows, ROWS)),
        }

    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"),
        row_key(F.col("doc_id"), F.col("text")).alias("row"),
    )
    schema = "doc_id long, row long, n_shingles long, set_a long, set_b long, signature binary, bands array<long>"
    return arrow_map(texts, work, schema)


def least_matches(threshold: float, width: int, batch: int, miss: float) -> list[tuple[int, int]]:
    """(n, m): after n compared values, a pair with fewer than m matches is pruned."""
    looks = []
    for n in range(batch, width + 1, batch):
        m = next(m for m in range(n + 1) if 1 - beta_cdf(threshold, m + 1, n - m + 1) >= miss)
        looks.append((n, m))
    return looks


def pruned(pairs: DataFrame, signatures: DataFrame, miss: float = MISS) -> DataFrame:
    """The pairs (a, b) that no look at their signatures rules out."""
    looks = least_matches(THRESHOLD / 100, BANDS * ROWS, BATCH, miss)

    def work(part: pa.RecordBatch) -> dict | None:
        left, right = (
            np.frombuffer(b"".join(part.column(c).to_pylist()), dtype=np.uint32).reshape(part.num_rows, -1)
            for c in ("signature_a", "signature_b")
        )
        alive, matches, done = np.arange(part.num_rows), np.zeros(part.num_rows, dtype=np.int64), 0
        for n, least in looks:
            matches[alive] += (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
            alive, done = alive[matches[alive] >= least], n
        chosen = part.take(pa.array(alive))
        return {"a": chosen.column("a"), "b": chosen.column("b")} if len(alive) else None

    with_a = few(pairs.join(signatures.toDF("a", "signature_a"), "a"), 4)
    both = with_a.join(signatures.toDF("b", "signature_b"), "b")
    return few(arrow_map(both.select("a", "b", "signature_a", "signature_b"), work, "a long, b long"), 4)


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, shingles (the full set, as 64-bit hashes) of the documents among ids (doc_id)."""

    def work(part: pa.RecordBatch) -> dict:
        sets = [shingle_hashes(text.as_py()).view(np.int64) for text in part.column(1)]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
        return {"doc_id": part.column(0), "shingles": lists}

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return arrow_map(only_ids(texts, ids, "doc_id"), work, "doc_id long, shingles array<long>")


def exactly_linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the threshold."""
    sets = shingle_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    sized = both.select("a", "b", common.alias("common"), (F.size("set_a") + F.size("set_b")).alias("sizes"))
    linked = sized.filter(100 * F.col("common") >= THRESHOLD * (F.col("sizes") - F.col("common")))
    return linked.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept, for each row of docs."""
    return near_duplicate_rows(docs, miss).drop("row")


def near_duplicate_rows(docs: DataFrame, miss: float = MISS) -> DataFrame:
    """The columns of near_duplicates and row, the row key."""
    of_set = ["set_a", "set_b", "n_shingles"]
    found = checkpointed(features(docs))
    classes = found.filter("n_shingles > 0").groupBy(*of_set).agg(F.min("doc_id").alias("node"))
    classes = classes.filter("node is not null")
    chosen = classes.select(F.col("node").alias("doc_id"))
    first = found.filter("n_shingles > 0").join(chosen, "doc_id", "left_semi")
    members = shared_buckets(first.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("node")))
    crowded = members.select(F.col("node").alias("doc_id")).distinct()
    chosen = first.select("doc_id", "signature", "n_shingles").join(crowded, "doc_id", "left_semi")
    chosen = checkpointed(few(chosen, 4))
    signatures, sizes = chosen.select("doc_id", "signature"), chosen.select(F.col("doc_id").alias("node"), "n_shingles")

    def verify(pairs: DataFrame) -> DataFrame:
        return exactly_linked(checkpointed(few(pruned(pairs, signatures, miss).distinct())), docs)

    def sets_of(nodes: DataFrame) -> DataFrame:
        # Of rows that repeat an id, one: the same text.
        sets = shingle_sets(docs, nodes.select(F.col("node").alias("doc_id"))).groupBy("doc_id")
        sets = sets.agg(F.max("shingles").alias("elements")).withColumnRenamed("doc_id", "node")
        return checkpointed(few(sets.join(nodes, "node"), 4))

    sizes = checkpointed(few(sizes.groupBy("node").agg(F.max("n_shingles").alias("size"))))
    reached = component_per_node(members, verify, sizes, sets_of, THRESHOLD / 100)
    placed = classes.join(reached, "node", "left").select(
        *of_set, F.coalesce("component", "node").alias("component_id")
    )
    rows = found.select("doc_id", "row", *of_set).join(placed, of_set, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "row", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
