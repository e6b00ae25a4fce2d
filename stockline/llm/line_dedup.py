"""Fuzzy line deduplication: MinHash of character shingles, banding, exact Jaccard, one line kept per component.

Lines are the \\n-split parts of a text, lower-cased; their white space counts as single spaces between words. Lines of equal form
are one node, however short. Two nodes of `min_chars` characters or more are linked if their sets of 5-character shingles have Jaccard
similarity >= 0.75. Of each component the line of the smallest (doc_id, line number) stays and the others go. Lines of
fewer than `min_chars` characters have too few shingles: what links them is but a character more or less at an end. They are
compared by equal form only. Lines of nothing but white space are no lines to compare and stay.

Candidates come from signatures of 8-character shingles, which lines alike by chance hardly share (of the pairs in a bucket by
5-character shingles 3 % were links on the check tool's tables): an edit touches at most 8 of these where it touches 5 of
the others, so at a similarity of 0.75 theirs is 0.63, and three functions a band in 32 bands miss 1.2e-4 of such pairs.

Nodes are 64-bit hashes of the form; shingles are compared by 55 bits of 64-bit hashes. Null text: no lines, returned
as it is. Null doc_id: its lines are neither compared nor removed. Repeated rows of a doc_id count as one document, whose rows are treated alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm.buckets import component_per_node, has_bits, node_bits, packed_members, parity_rows, shared_packed
from stockline.llm.common import (
    SLICE_ROWS, Scratch, arrow_map, band_keys, let_go, long_lists, mixed, only_ids, permutations, positional, ship_package,
)
from stockline.llm.components import few
from stockline.operators.scale import checkpointed

MIN_CHARS = 14  # so that a line has ten shingles and six of those of its signature
SHINGLE = 5  # characters; longer ones lose the link of lines of 50 to 78 characters at one changed character
SIGNATURE_SHINGLE = 8
THRESHOLD = 75  # per cent
BANDS, ROWS = 32, 3
TRIED_PER_MEMBER = 1 << 13  # pairs for each line of a bucket, up to which all are tried: a comparison of marks each; beyond, see buckets.rare_pairs
BROADCAST_LINES = 1_000_000  # numbers of removed lines that are broadcast, after a count: 4 bytes each
SEEN = 100_000  # forms a task remembers so as not to send them again
HELD_CHARS = 1 << 16  # characters of forms that a task compares at a time
HASH_BITS = 55  # by which shingles are compared: 8 more are the place in a slice, 1 the side of a pair

_SEED = 7_919
_UNEVEN = ("  ", "\t", "\r", "\v", "\f", "\xa0")  # white space that makes a text's lines uneven


def line_key(text: str) -> int:
    key = xxhash.xxh3_64_intdigest(text.encode())
    return key - (1 << 64) if key >> 63 else key


def forms(text: str | None, min_chars: int) -> list[tuple[int, str]]:
    """(line number, form) of the lines that are compared."""
    text = (text or "").lower()
    plain = not any(space in text for space in _UNEVEN)
    found = [(i, line) for i, line in enumerate(text.split("\n")) if len(line) >= min_chars]
    found = [(i, line.strip(" ") if plain else " ".join(line.split())) for i, line in found]
    return [(i, line) for i, line in found if len(line) >= max(min_chars, 1)]


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of each line's shingles, one line after the other, and where each line's begin."""
    lengths = np.array([len(x) for x in lines], dtype=np.int64)
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(points) - SIGNATURE_SHINGLE + 1
    hashes = np.zeros(n, dtype=np.uint32)
    for i in range(SIGNATURE_SHINGLE):
        hashes *= np.uint32(0x9E3779B1)
        hashes += points[i : n + i]
    hashes ^= hashes >> np.uint32(16)
    hashes *= np.uint32(0x85EBCA6B)
    hashes ^= hashes >> np.uint32(13)
    hashes *= np.uint32(0xC2B2AE35)
    hashes ^= hashes >> np.uint32(16)
    own = lengths - SIGNATURE_SHINGLE + 1
    return hashes[whole_shingles(lengths, SIGNATURE_SHINGLE, n)], np.cumsum(own) - own


def whole_shingles(lengths: np.ndarray, shingle: int, n: int) -> np.ndarray:
    """Of the n shingles of the joined lines, whether each lies in one line."""
    whole, ends = np.ones(n, dtype=bool), np.cumsum(lengths)[:-1]  # the last line ends with the array
    for i in range(1, shingle):
        over = ends - i
        whole[over[(over >= 0) & (over < n)]] = False
    return whole


def signatures(lines: list[str], factors: np.ndarray, summands: np.ndarray) -> np.ndarray:
    hashes, starts = shingle_hashes(lines)
    out, turned = np.empty((len(factors), len(lines)), dtype=np.uint32), np.empty_like(hashes)
    for q in range(len(factors)):
        np.multiply(hashes, factors[q], out=turned)
        turned += summands[q]
        np.minimum.reduceat(turned, starts, out=out[q])
    return out.T


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).filter(
        "doc_id is not null"
    )


def banded_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """slice, entries (see buckets.packed_members) of the bands of each form, at least once."""
    factors, summands = permutations(BANDS * ROWS, _SEED)
    seen: set[int] = set()

    def found(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray] | None:
        fresh: dict[int, str] = {}
        for text in part.column(0):
            for _, line in forms(text.as_py(), min_chars):
                if (key := line_key(line)) not in seen:
                    fresh[key] = line
                    seen.add(key)
        if len(seen) > SEEN:
            seen.clear()
        if not fresh:
            return None
        keys = band_keys(signatures(list(fresh.values()), factors, summands), ROWS)
        return np.fromiter(fresh, dtype=np.int64, count=len(fresh)), keys

    ship_package(docs.sparkSession)
    return _texts(docs).select("text").mapInArrow(packed_members(found), "slice int, entries binary")


def placed_lines(docs: DataFrame, words: np.ndarray, min_chars: int = MIN_CHARS) -> DataFrame:
    """node, doc_id, line, form of each line. form is null but for forms of min_chars characters or more whose nodes' bits are set
    in words (see buckets.node_bits): these are sent at least once."""
    wanted = docs.sparkSession.sparkContext.broadcast(words)
    sent: set[int] = set()

    def work(part: pa.RecordBatch) -> dict:
        ids, numbers, nodes, lines = [], [], [], []
        for doc, text in zip(part.column(0).to_pylist(), part.column(1)):
            for i, line in forms(text.as_py(), 1):
                ids.append(doc)
                numbers.append(i)
                nodes.append(line_key(line))
                lines.append(line)
        keys = np.array(nodes, dtype=np.int64)
        for at, hit in enumerate(has_bits(wanted.value, keys).tolist()):
            if hit and len(lines[at]) >= min_chars and nodes[at] not in sent:
                sent.add(nodes[at])
            else:
                lines[at] = None
        if len(sent) > SEEN:
            sent.clear()
        return {"node": keys, "doc_id": ids, "line": numbers, "form": lines}

    return arrow_map(_texts(docs), work, "node long, doc_id long, line int, form string")


def sized_forms(lines: DataFrame) -> DataFrame:
    """node, form, size (distinct shingles), marks (see buckets.parity_marks) of the nodes whose form is given, each once."""
    last = [None]

    def sized(part: pa.RecordBatch) -> dict | None:
        nodes = part.column(0).to_numpy()
        fresh = np.r_[nodes[0] != last[0], nodes[1:] != nodes[:-1]]
        last[0] = nodes[-1]
        part = part.filter(pa.array(fresh))
        if not part.num_rows:
            return None
        own, sizes, marks = part.column(1).to_pylist(), [], []
        for start, end in portions(own):
            found = sizes_and_marks(own[start:end])
            sizes.append(found[0])
            marks.append(found[1])
        marks = long_lists(np.concatenate(marks))
        return {"node": part.column(0), "form": part.column(1), "size": np.concatenate(sizes), "marks": marks}

    given = lines.filter("form is not null").select("node", "form").repartition("node").sortWithinPartitions("node")
    return arrow_map(given, sized, "node long, form string, size long, marks array<long>")


def portions(lines: list[str]) -> list[tuple[int, int]]:
    """Bounds of runs of at most SLICE_ROWS lines and, but for a longer line, HELD_CHARS characters."""
    found, start, held = [], 0, 0
    for i, line in enumerate(lines):
        if i > start and (held + len(line) > HELD_CHARS or i - start == SLICE_ROWS):
            found.append((start, i))
            start, held = i, 0
        held += len(line)
    return [*found, (start, len(lines))] if lines else found


def tagged_shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each line's shingles, its highest HASH_BITS bits, and the place of its line, one below the other; in the lines' order."""
    lengths = np.array([len(x) for x in lines], dtype=np.int64)
    hashes = hashed("".join(lines))
    whole = whole_shingles(lengths, SHINGLE, len(hashes))
    of = np.repeat(np.arange(len(lines)), lengths)[: len(hashes)]
    return (hashes >> np.uint64(64 - HASH_BITS))[whole], of[whole]


def sizes_and_marks(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The number of distinct shingles of each of up to SLICE_ROWS lines, and their parity marks."""
    hashes, of = tagged_shingles(lines)
    keys = hashes | (of.astype(np.uint64) << np.uint64(HASH_BITS))
    keys.sort()
    keys = keys[np.r_[True, keys[1:] != keys[:-1]][: len(keys)]]
    of = (keys >> np.uint64(HASH_BITS)).astype(np.int64)
    return np.bincount(of, minlength=len(lines)), parity_rows(of, keys >> np.uint64(HASH_BITS - 16), len(lines))


def hashed(text: str) -> np.ndarray:
    """64-bit hashes of the shingles at each character; the highest bits are the best."""
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    if len(p) < SHINGLE:
        return np.empty(0, dtype=np.uint64)
    c = 0x9E3779B97F4A7C15
    two = p[:-1] * np.uint64(c)
    two += p[1:]
    five = two[:-3] * np.uint64(c * c % (1 << 64))  # of four characters so far
    five += two[2:-1]
    five *= np.uint64(c)
    five += p[4:]
    five *= np.uint64(0xBF58476D1CE4E5B9)
    five ^= five >> np.uint64(32)
    five *= np.uint64(0x94D049BB133111EB)
    return five


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The distinct shingles of each form, as sorted 64-bit hashes."""
    hashes, found, start = hashed("".join(lines)), [], 0
    for line in lines:
        own = np.sort(hashes[start : max(start + len(line) - SHINGLE + 1, start)])
        found.append(own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own)
        start += len(line)
    return found


def shingle_set(line: str) -> np.ndarray:
    return shingle_sets([line])[0]


def with_shingles(lines: DataFrame) -> DataFrame:
    """node, component, elements (the shingle set) of node, component, form."""

    def work(part: pa.RecordBatch) -> dict:
        sets = [own.view(np.int64) for own in shingle_sets(part.column(2).to_pylist())]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
        return {"node": part.column(0), "component": part.column(1), "elements": lists}

    return arrow_map(lines, work, "node long, component long, elements array<long>")


def linked(forms_a: list[str], forms_b: list[str]) -> np.ndarray:
    """Whether the shingle sets of the forms at each place reach the threshold; compared by HASH_BITS bits of a hash."""
    found = [np.empty(0, dtype=bool)]
    for start, end in portions([a + b for a, b in zip(forms_a, forms_b)]):
        hashes, of = tagged_shingles([x for both in zip(forms_a[start:end], forms_b[start:end]) for x in both])
        of = of.astype(np.uint64)  # the pair's place, then the hash, then the side
        keys = ((of >> np.uint64(1)) << np.uint64(HASH_BITS + 1)) | (hashes << np.uint64(1)) | (of & np.uint64(1))
        keys.sort()
        keys = keys[np.r_[True, keys[1:] != keys[:-1]][: len(keys)]] >> np.uint64(1)
        bounds = np.searchsorted(keys >> np.uint64(HASH_BITS), np.arange(end - start + 1, dtype=np.uint64))
        common = np.diff(np.searchsorted(np.flatnonzero(keys[1:] == keys[:-1]), bounds))
        found.append(100 * common >= THRESHOLD * (np.diff(bounds) - common))
    return np.concatenate(found)


def exactly_linked(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets reach the threshold; lines: node, form."""

    def compare(part: pa.RecordBatch) -> dict:
        forms_a, forms_b = part.column("form_a").to_pylist(), part.column("form_b").to_pylist()
        chosen = part.filter(pa.array(linked(forms_a, forms_b)))
        return {"a": chosen.column("a"), "b": chosen.column("b")}

    pairs = checkpointed(few(pairs, 4))
    lines = only_ids(lines, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")
    both = pairs.join(lines.toDF("a", "form_a"), "a").join(lines.toDF("b", "form_b"), "b")
    return arrow_map(both.select("a", "b", "form_a", "form_b"), compare, "a long, b long")


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, removed (sorted numbers of the lines that go), for documents that lose lines."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    members = shared_packed(banded_lines(docs, min_chars))
    let_go(spark)
    words = node_bits(members)
    let_go(spark)  # once more: until Spark has noted the end of a query, its shuffle files stay
    lines = scratch.write(placed_lines(docs, words, min_chars))
    crowded = scratch.write(sized_forms(lines))
    of_form, marks = crowded.select("node", "form"), crowded.select("node", "marks")
    let_go(spark)
    reached = component_per_node(
        members,
        lambda pairs: checkpointed(few(exactly_linked(pairs, of_form), 4)),
        crowded.select("node", "size"),
        lambda nodes: with_shingles(of_form.join(nodes, "node").select("node", "component", "form")),
        THRESHOLD / 100,
        tried_per_member=TRIED_PER_MEMBER,
        marks_of=lambda nodes: marks if nodes is None else only_ids(marks, nodes, "node"),
    )
    reached = scratch.write(reached)
    scratch.drop(members, crowded)
    placed = lines.select("node", "doc_id", "line").join(reached, "node", "left")
    placed = placed.select(F.coalesce("component", "node").alias("component"), "doc_id", "line")
    of_docs, lines = lines, scratch.write(placed)
    scratch.drop(of_docs)
    # First within each document, then between documents: a line that recurs everywhere is summed where it is read.
    within = lines.groupBy("component", "doc_id").agg(F.min("line").alias("first_line"), F.count(F.lit(1)).alias("n"))
    keepers = within.groupBy("component").agg(
        F.min("doc_id").alias("first_doc"), F.min_by("first_line", "doc_id").alias("first_line"), F.sum("n").alias("n")
    )
    gone = lines.join(keepers.filter("n > 1"), "component").filter("doc_id <> first_doc or line <> first_line")
    removed = scratch.write(gone.groupBy("doc_id").agg(F.sort_array(F.collect_set("line")).alias("removed")))
    scratch.drop(reached, lines)
    return removed


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """docs with the remaining lines as text, plus n_lines and n_removed (both long, in place of columns
    of these names); all other columns as they are."""
    placed, names = positional(docs)
    removed = repeated_lines(docs, min_chars).toDF("gone_id", "gone")
    n_gone = removed.agg(F.sum(F.array_size("gone"))).first()[0] or 0
    removed = F.broadcast(removed) if n_gone <= broadcast_lines else removed.hint("shuffle_hash")
    joined = placed.join(removed, F.col(names["doc_id"]).cast("long") == F.col("gone_id"), "left")
    text = F.col(names["text"])
    rest = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains("gone", i)), "\n")
    kept = F.when(F.col("gone").isNull(), text).otherwise(rest)
    n_lines = 1 + F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    return joined.select(
        *[
            (kept if n == "text" else F.col(place)).alias(n)
            for n, place in names.items() if n not in ("n_lines", "n_removed")
        ],
        F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
