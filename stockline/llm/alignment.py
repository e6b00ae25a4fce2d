"""Alignment of two tokenizers over the same bytes: an associative fragment monoid, reduced by a tree for very long documents.

Both tokenizers' tokens cover the bytes of space + text: A is a byte-level BPE of the tokenizers library, B a sentencepiece model
with byte fallback, which puts the space there itself. Byte offsets where a token of A and one of B both end cut the tokens into
groups; an A and a B token whose byte ranges overlap are linked.

A `Fragment` is what is known of a byte range: the open prefix up to the first common end inside, the closed groups between, and the
open suffix after the last. `composed` joins neighbours: the suffix of one and the prefix of the next are looked
at together. It is associative, so ranges can be joined in any grouping. A text of up to CHUNK_BYTES is one
range. A longer one is cut into ranges of about that size, which go to different tasks; FANIN neighbours are composed at a
time until one fragment per document is left, whose ends are the document's.

Ranges and the units within them are cut before a space that follows a character other than white space: there A's pattern starts
afresh, and no piece of B holds a space after another character (both are checked when the files are loaded). So a
range's tokens are those of the whole text. A text without such a place is one range. A task works on BATCH_CHARS at a time and
looks at each distinct unit of these once.

How often an id pair is linked is counted over all documents. Up to BROADCAST_PAIRS distinct pairs are sent to all tasks, after
a count; beyond that each document's pairs are joined with the counts by shuffle.

Null and empty texts, and texts whose joined token bytes differ from space + text (say with U+2581 in them), have no tokens: zeros
and the digest ''. Special tokens' strings in texts are plain text. Null ids and repeated rows: treated like any row, each row is
returned and counts. Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm.common import Scratch, row_key, ship_package, sliced
from stockline.llm.token_counts import Counter
from stockline.operators.scale import checkpointed

CHUNK_BYTES = 1 << 16
FANIN = 16
BATCH_CHARS = 600_000  # text whose distinct units a task holds at a time
JOINED_CHARS = 1 << 16
KNOWN_CHARS = 2_500_000  # characters of units that a worker remembers, so as not to look at them again
BROADCAST_PAIRS = 2_000_000  # 32 MB

_CUT = re.compile(r"\S(?= )")
_UNEVEN = re.compile(r"\s ")


# ---- the monoid ----


class Open(NamedTuple):
    """Tokens whose group is not known to be whole: ids and end offsets of each tokenizer, in order."""

    a: tuple[int, ...] = ()
    a_ends: tuple[int, ...] = ()
    b: tuple[int, ...] = ()
    b_ends: tuple[int, ...] = ()

    def followed_by(self, other: Open) -> Open:
        return Open(*(mine + theirs for mine, theirs in zip(self, other)))


class Closed(NamedTuple):
    """Whole groups: how many tokens and groups, the groups written out, and the linked pairs (a, b), one after the other."""

    n_a: int
    n_b: int
    texts: tuple[str, ...]
    links: tuple[int, ...]

    def followed_by(self, other: Closed) -> Closed:
        return Closed(*(mine + theirs for mine, theirs in zip(self, other)))


class Fragment(NamedTuple):
    """prefix: up to and with the first common end, or everything if there is none; then closed is None and suffix empty."""

    prefix: Open
    closed: Closed | None
    suffix: Open


NOTHING = Closed(0, 0, (), ())


def group(tokens: Open) -> Closed:
    """One whole group: both sides start and end together."""
    links, i, j = [], 0, 0
    while i < len(tokens.a) and j < len(tokens.b):
        links += (tokens.a[i], tokens.b[j])
        end, other = tokens.a_ends[i], tokens.b_ends[j]
        i, j = i + (end <= other), j + (other <= end)
    text = f"{','.join(map(str, tokens.a))}|{','.join(map(str, tokens.b))}"
    return Closed(len(tokens.a), len(tokens.b), (text,), tuple(links))


def fragment(tokens: Open) -> Fragment:
    """Tokens of a byte range, cut at their common ends."""
    common = sorted(set(tokens.a_ends).intersection(tokens.b_ends))
    if not common:
        return Fragment(tokens, None, Open())
    parts, i, j = [], 0, 0
    place_a, place_b = {e: n for n, e in enumerate(tokens.a_ends, 1)}, {e: n for n, e in enumerate(tokens.b_ends, 1)}
    for end in common:
        to_a, to_b = place_a[end], place_b[end]
        parts.append(Open(tokens.a[i:to_a], tokens.a_ends[i:to_a], tokens.b[j:to_b], tokens.b_ends[j:to_b]))
        i, j = to_a, to_b
    suffix = Open(tokens.a[i:], tokens.a_ends[i:], tokens.b[j:], tokens.b_ends[j:])
    return Fragment(parts[0], _sum(map(group, parts[1:])), suffix)


def _sum(parts: Iterator[Closed]) -> Closed:
    columns = list(zip(*parts)) or [(), (), (), ()]
    n_a, n_b, texts, links = columns
    return Closed(sum(n_a), sum(n_b), tuple(t for x in texts for t in x), tuple(k for x in links for k in x))


def composed(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""
    met = fragment((left.prefix if left.closed is None else left.suffix).followed_by(right.prefix))
    if left.closed is None:
        prefix, closed = met.prefix, met.closed
    else:
        prefix = left.prefix
        closed = left.closed if met.closed is None else _sum(iter((left.closed, group(met.prefix), met.closed)))
    suffix = met.suffix if met.closed is not None else met.prefix if left.closed is not None else Open()
    if right.closed is None:
        return Fragment(prefix, closed, suffix)
    return Fragment(prefix, _sum(iter((closed, right.closed))), right.suffix)


def whole(document: Fragment) -> Closed:
    """The groups of a whole document: its ends are common ends."""
    if document.closed is None:
        return group(document.prefix) if document.prefix.a else NOTHING
    return _sum(iter((group(document.prefix), document.closed)))


# ---- tokens ----


def units_of(text: str) -> list[str]:
    """Space + text, cut before each space that follows a character other than white space, without the units' first spaces."""
    parts = text.split(" ")
    if not text.startswith(" ") and not _UNEVEN.search(text) and parts[-1]:
        return parts
    found, head = [], parts[0]
    before = " " + head
    for part in parts[1:]:
        if before[-1].isspace():
            head = f"{head} {part}"
        else:
            found.append(head)
            head = part
        before = " " + head
    found.append(head)
    return found


def _byte_of_character() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 and up, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in set(printable)]
    return {chr(x): x for x in printable} | {chr(256 + i): x for i, x in enumerate(others)}


def pair_type(size_a: int, size_b: int) -> type:
    """The least type that holds an id pair as a * size_b + b."""
    return np.uint32 if size_a * size_b <= 1 << 32 else np.uint64


def packed(links: tuple[int, ...], size_b: int, kind: type) -> np.ndarray:
    """The pairs of a Closed as numbers."""
    ids = np.array(links, dtype=np.int64)
    return (ids[0::2] * size_b + ids[1::2]).astype(kind)


class Units(NamedTuple):
    """Distinct units: the place of each, and by place what its whole groups hold; n_groups is 0 where bytes differ."""

    place: dict[str, int]
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    texts: list[str]  # the groups, each with a ";" behind
    links: np.ndarray  # pairs a * (pieces of B) + b
    links_from: np.ndarray

    def of(self, units: list[str]) -> tuple[int, int, int, str, np.ndarray] | None:
        """(n_a, n_b, n_groups, text, links) of units in a row; None if the bytes of one differ."""
        at = np.fromiter(map(self.place.__getitem__, units), dtype=np.int64, count=len(units))
        if not self.n_groups[at].all():
            return None
        starts = self.links_from[at]
        sizes = self.links_from[at + 1] - starts
        links = self.links[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
        text = "".join(map(self.texts.__getitem__, at.tolist()))[:-1]
        return int(self.n_a[at].sum()), int(self.n_b[at].sum()), int(self.n_groups[at].sum()), text, links

    def with_more(self, more: Units) -> Units:
        """These and more, which are other units; `place` and `texts` are this object's own, made longer."""
        n = len(self.texts)
        self.place.update((unit, n + i) for unit, i in more.place.items())
        self.texts.extend(more.texts)
        counts = (np.concatenate(sides) for sides in zip(self[1:4], more[1:4]))
        links_from = np.concatenate((self.links_from, self.links_from[-1] + more.links_from[1:]))
        return Units(self.place, *counts, self.texts, np.concatenate((self.links, more.links)), links_from)


_LOADED: dict[tuple[str, str], Tokens] = {}


class Tokens:
    """Both tokenizers' ids of texts that start with a space; one per task."""

    def __init__(self, path_a: str, path_b: str) -> None:
        from sentencepiece import SentencePieceProcessor

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        self.a = Counter(path_a).tokenizer  # refuses other kinds of tokenizers
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", name) for name in names) or self.b.encode("a", out_type=str)[0][0] != "▁":
            raise ValueError("texts can be cut only for models with no space inside a piece that put one in front")
        letters = _byte_of_character()
        size = self.a.get_vocab_size()
        self.bytes_a = [bytes(letters.get(c, 63) for c in self.a.id_to_token(i) or "") for i in range(size)]
        self.bytes_b = [
            bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()
            for i, name in enumerate(names)
        ]
        self.size_a, self.size_b = (np.array([len(x) for x in side]) for side in (self.bytes_a, self.bytes_b))
        self.pair = pair_type(size, len(names))
        # Each id written out with what can follow it: for A "," or "|", for B "," or ";".
        forms = [f"{i}{sign}" for side, signs in ((size, ",|"), (len(names), ",;")) for sign in signs for i in range(side)]
        self.forms = np.array(forms, dtype=object)
        self.space = self.b.piece_to_id("▁")
        self.known, self.known_chars = self.units(set()), 0

    def ids(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of texts, each of which starts with a space."""
        of_a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        rest = [text[1:] for text in texts]  # B puts the space in front itself, but for a text that is nothing else
        return of_a, [ids if text else [self.space] for text, ids in zip(rest, self.b.encode(rest, num_threads=1))]

    @classmethod
    def of(cls, path_a: str, path_b: str) -> Tokens:
        """The worker's own, which it keeps for its next tasks."""
        if (path_a, path_b) not in _LOADED:
            _LOADED[path_a, path_b] = cls(path_a, path_b)
        return _LOADED[path_a, path_b]

    def sound(self, text: str, a: list[int], b: list[int]) -> bool:
        """Whether the joined bytes of both sides' tokens are the text's."""
        sides = b"".join(map(self.bytes_a.__getitem__, a)), b"".join(map(self.bytes_b.__getitem__, b))
        return sides[0] == sides[1] == text.encode()

    def first(self, unit: str, base: int) -> Fragment | None:
        """The fragment of one unit, whose start is not known to be a common end; None if its bytes differ."""
        (a,), (b,) = self.ids([" " + unit])
        if not self.sound(" " + unit, a, b):
            return None
        ends = [tuple((np.cumsum(size[ids]) + base).tolist()) for size, ids in ((self.size_a, a), (self.size_b, b))]
        return fragment(Open(tuple(a), ends[0], tuple(b), ends[1]))

    def known_units(self, found: set[str]) -> Units:
        """Units that hold all those found: what earlier batches have left, up to KNOWN_CHARS, and what is new."""
        if self.known_chars > KNOWN_CHARS:
            self.known, self.known_chars = self.units(set()), 0
        new = found.difference(self.known.place)
        if new:
            self.known = self.known.with_more(self.units(new))
            self.known_chars += sum(map(len, new))
        return self.known

    def units(self, found: set[str]) -> Units:
        """The whole groups of distinct units, given without their first spaces.

        Units are encoded joined, JOINED_CHARS at a time, which is far cheaper than one by one. Those that may not be joined
        (white space at the end, U+2581) and those of a joined text whose bytes differ are encoded alone.
        """
        joined, alone, held, size = [], [], [], 0
        for unit in found:
            if not unit or unit[-1].isspace() or "▁" in unit:
                alone.append(unit)
                continue
            held.append(unit)
            size += len(unit)
            if size >= JOINED_CHARS:
                joined.append(held)
                held, size = [], 0
        joined += [held] if held else []
        parts, odd = [], []
        for part in joined:
            (a,), (b,) = self.ids([text := " " + " ".join(part)])
            if self.sound(text, a, b):
                parts.append((part, np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)))
            else:
                alone += part
        for unit, a, b in zip(alone, *self.ids([" " + unit for unit in alone])):
            if self.sound(" " + unit, a, b):
                parts.append(([unit], np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)))
            else:
                odd.append(unit)
        return self._aligned(parts, odd)

    def _aligned(self, parts: list[tuple], odd: list[str]) -> Units:
        """All parts (units, ids of A, ids of B of the units joined) in one go; odd units, without tokens, come last."""
        names = [unit for units, *_ in parts for unit in units]
        a, b = (np.concatenate([np.empty(0, dtype=np.int64), *(part[side] for part in parts)]) for side in (1, 2))
        ends = np.cumsum([1 + (len(unit) if unit.isascii() else len(unit.encode())) for unit in names])
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        starts_a, starts_b = ends_a - self.size_a[a], ends_b - self.size_b[b]
        cut_a, cut_b = np.isin(ends_a, ends_b, assume_unique=True), np.isin(ends_b, ends_a, assume_unique=True)
        unit_a, unit_b = np.searchsorted(ends, ends_a), np.searchsorted(ends, ends_b)
        total = len(names) + len(odd)
        n_a, n_b = np.bincount(unit_a, minlength=total), np.bincount(unit_b, minlength=total)
        n_groups = np.bincount(unit_a[cut_a], minlength=total)
        # Of B's tokens those overlap with a token of A that end behind its start and start before its end.
        low, high = np.searchsorted(ends_b, starts_a, side="right"), np.searchsorted(starts_b, ends_a)
        sizes = high - low
        at_b = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        links = (np.repeat(a, sizes) * len(self.bytes_b) + b[at_b]).astype(self.pair)
        of_unit = np.bincount(unit_a, weights=sizes, minlength=total).astype(np.int64)
        forms = np.r_[a + len(self.bytes_a) * cut_a, 2 * len(self.bytes_a) + b + len(self.bytes_b) * cut_b]
        # A group's tokens of A, then its tokens of B.
        group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
        written = self.forms[forms[np.argsort(np.r_[2 * group_a, 2 * group_b + 1], kind="stable")]].tolist()
        bounds = np.cumsum(np.r_[0, n_a + n_b]).tolist()
        texts = ["".join(written[i:j]) for i, j in zip(bounds, bounds[1:])]
        place = {unit: i for i, unit in enumerate([*names, *odd])}
        return Units(place, n_a, n_b, n_groups, texts, links, np.cumsum(np.r_[0, of_unit]))


# ---- ranges of documents ----


def ranges(text: str, size: int) -> Iterator[str]:
    """Space + text, cut at the first safe place from each `size` characters on."""
    text, start = " " + text, 0
    while start < len(text):
        cut = _CUT.search(text, start + size - 1)
        end = cut.end() if cut else len(text)
        yield text[start:end]
        start = end


_SUMMARY = (
    "doc_id long, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
)
_NO_TOKENS = (0, 0, 0, 0, "", b"")


def _summary(n_a: int, n_b: int, n_groups: int, text: str, links: np.ndarray) -> tuple:
    digest = hashlib.sha256(text.encode()).hexdigest() if n_groups else ""
    return n_a, n_b, n_groups, len(links), digest, links.tobytes()


def _summaries(doc_ids: pa.Array, rows: pa.Array, found: list[tuple]) -> pa.RecordBatch:
    n_a, n_b, n_groups, n_links, digests, links = zip(*found)
    longs = [pa.array(x, type=pa.int64()) for x in (n_a, n_b, n_groups, n_links)]
    columns = [doc_ids, rows, *longs, pa.array(digests, type=pa.string()), pa.array(links, type=pa.binary())]
    return pa.RecordBatch.from_arrays(columns, [field.split()[0] for field in _SUMMARY.split(", ")])


def _by_size(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches (.., .., text) with about so many bytes of text, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False)
        parts = np.cumsum(sizes) // chars
        starts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if len(parts) else []
        for start, end in zip(starts, [*starts[1:], batch.num_rows]):
            yield batch.slice(int(start), int(end - start))


def short_summaries(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The summaries (columns of _SUMMARY) of documents (doc_id, row, text), each of which is one range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.of(path_a, path_b)
        for part in _by_size(batches, BATCH_CHARS):
            cut = [units_of(text) if text else [] for text in part.column(2).to_pylist()]
            known = tokens.known_units(set().union(*cut))
            groups = [known.of(units) if units else None for units in cut]
            found = [_NO_TOKENS if x is None else _summary(*x) for x in groups]
            yield _summaries(part.column(0), part.column(1), found)

    ship_package(docs.sparkSession)
    return docs.select("doc_id", "row", "text").mapInArrow(run, _SUMMARY)


#: A fragment as a row: its open ends (for each tokenizer how many tokens, then ids and ends), its groups joined by ";", the counts of
#: its closed part (null where there is no common end), and its links.
_FRAGMENT = (
    "row long, place long, sound boolean, prefix array<long>, suffix array<long>, n_a long, n_b long, n_groups long, "
    "text string, links binary"
)


def _flat(tokens: Open) -> list[int]:
    return [len(tokens.a), *tokens.a, *tokens.a_ends, *tokens.b, *tokens.b_ends]


def _unflat(values: list[int]) -> Open:
    n = values[0]
    m = (len(values) - 1 - 2 * n) // 2
    cuts = np.cumsum([1, n, n, m, m])
    return Open(*(tuple(values[i:j]) for i, j in zip(cuts, cuts[1:])))


class Rows:
    """Fragments as rows, for a vocabulary of B of so many pieces."""

    def __init__(self, size_b: int, kind: type) -> None:
        self.size_b, self.kind = size_b, kind

    def links(self, closed: Closed | None) -> bytes:
        return packed(closed.links if closed else (), self.size_b, self.kind).tobytes()

    def of(self, row: int, place: int, found: Fragment | None, more: tuple | None = None) -> dict:
        """A fragment, followed by whole groups `more` (n_a, n_b, n_groups, text, links)."""
        sound = found is not None
        found = found or Fragment(Open(), None, Open())
        closed = found.closed
        own = (closed.n_a, closed.n_b, len(closed.texts), ";".join(closed.texts)) if closed else (0, 0, 0, "")
        parts = [own, more[:4]] if sound and more else [own]
        n_a, n_b, n_groups = (sum(p[i] for p in parts) for i in range(3))
        return {
            "row": row, "place": place, "sound": sound, "prefix": _flat(found.prefix), "suffix": _flat(found.suffix),
            "n_a": None if closed is None else n_a, "n_b": n_b, "n_groups": n_groups,
            "text": ";".join(p[3] for p in parts if p[2]),
            "links": self.links(closed) + (more[4].tobytes() if sound and more else b""),
        }

    def composed(self, rows: list[dict]) -> dict:
        """Neighbouring fragments of one document, as rows in order, as one; only their open ends are looked at again."""
        if not all(row["sound"] for row in rows):
            return self.of(rows[0]["row"], 0, None)
        out = dict(rows[0])
        texts, links = [out["text"]], [out["links"]]
        for row in rows[1:]:
            left, right = (
                Fragment(_unflat(x["prefix"]), None if x["n_a"] is None else NOTHING, _unflat(x["suffix"])) for x in (out, row)
            )
            met = composed(left, right)  # what its closed part holds are the groups closed between the two
            new = met.closed or NOTHING
            texts += [";".join(new.texts), row["text"]]
            links += [self.links(new), row["links"]]
            counts = [(out[c] or 0) + (row[c] or 0) for c in ("n_a", "n_b", "n_groups")]
            n_a, n_b, n_groups = (x + y for x, y in zip(counts, (new.n_a, new.n_b, len(new.texts))))
            out |= {
                "prefix": _flat(met.prefix), "suffix": _flat(met.suffix), "n_a": None if met.closed is None else n_a,
                "n_b": n_b, "n_groups": n_groups,
            }
        return out | {"text": ";".join(filter(None, texts)), "links": b"".join(links)}

    def finished(self, row: dict) -> tuple:
        """The summary of a whole document's row: the document's start closes the prefix."""
        if not row["sound"]:
            return _NO_TOKENS
        head = group(_unflat(row["prefix"]))
        links = np.frombuffer(self.links(head) + row["links"], dtype=self.kind)
        counts = row["n_a"] + head.n_a, row["n_b"] + head.n_b, row["n_groups"] + 1
        return _summary(*counts, ";".join(filter(None, (*head.texts, row["text"]))), links)


def _arrow_schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(field.split()[0], kinds[field.split()[1]]) for field in text.split(", ")])


def range_fragments(docs: DataFrame, path_a: str, path_b: str, size: int) -> DataFrame:
    """The fragments (columns of _FRAGMENT) of documents (row, text), by place; ranges go to tasks of their own."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 1):
            row, base = part.column(0)[0].as_py(), 0
            for place, text in enumerate(ranges(part.column(1)[0].as_py(), size)):
                columns = [pa.array([x]) for x in (row, place, base, text)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "place", "base", "text"])
                base += len(text.encode())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.of(path_a, path_b)
        for part in sliced(batches, 1):
            row, place, base, text = (part.column(c)[0].as_py() for c in range(4))
            first, *units = units_of(text[1:])
            # The first unit ends with a common end, so what follows are whole groups.
            more = tokens.units(set(units)).of(units)
            found = None if more is None else tokens.first(first, base)
            row = Rows(len(tokens.bytes_b), tokens.pair).of(row, place, found, more)
            yield pa.RecordBatch.from_pylist([row], schema=_arrow_schema(_FRAGMENT))

    ship_package(docs.sparkSession)
    parts = docs.select("row", "text").mapInArrow(cut, "row long, place long, base long, text string")
    return parts.repartition("row", "place").mapInArrow(run, _FRAGMENT)


def long_summaries(
    docs: DataFrame, path_a: str, path_b: str, chunk: int, rows: Rows, fanin: int = FANIN
) -> DataFrame:
    """The summaries of documents (doc_id, row, text) of more than one range, by a tree of compositions."""
    schema = _arrow_schema(_FRAGMENT)

    def compose(table: pa.Table) -> pa.Table:
        parts = table.sort_by("place").to_pylist()
        place = parts[0]["place"] // fanin
        return pa.Table.from_pylist([rows.composed(parts) | {"place": place}], schema=schema)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 1):
            yield _summaries(pa.nulls(1, pa.int64()), part.column(0), [rows.finished(part.to_pylist()[0])])

    once = docs.dropDuplicates(["row"])
    found = range_fragments(once, path_a, path_b, chunk)
    left = -(-(docs.agg(F.max(F.length("text"))).first()[0] or 0) // chunk)
    while left > 0:
        found = found.groupBy("row", F.floor(F.col("place") / fanin)).applyInArrow(compose, _FRAGMENT)
        left = 0 if left <= fanin else -(-left // fanin)
    summed = found.mapInArrow(finish, _SUMMARY).drop("doc_id")
    return docs.select("doc_id", "row").join(summed, "row").select("doc_id", *summed.columns)


# ---- counts over all documents ----


def pair_counts(summaries: DataFrame, rows: Rows) -> DataFrame:
    """pair, n, best: how often each pair is linked, and whether that is its B id's most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 1024):
            pairs, n = np.unique(np.frombuffer(b"".join(part.column(0).to_pylist()), dtype=rows.kind), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(n)], ["pair", "n"])

    counted = summaries.select("links").mapInArrow(count, "pair long, n long")
    counts = checkpointed(counted.groupBy("pair").agg(F.sum("n").alias("n")))
    with_b = counts.withColumn("b", F.col("pair") % rows.size_b)
    most = with_b.groupBy("b").agg(F.max("n").alias("most"))
    return with_b.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


_OUT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def scored(summaries: DataFrame, counts: DataFrame, rows: Rows, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """The summaries with n_best and count_sum."""
    if counts.count() > broadcast_pairs:
        return _scored_by_join(summaries, counts, rows)
    table = counts.orderBy("pair").toArrow()
    columns = (table[c].to_numpy() for c in ("pair", "n", "best"))
    shared = summaries.sparkSession.sparkContext.broadcast(tuple(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        for part in sliced(batches):
            n_best, count_sum = [], []
            for links in part.column("links"):
                at = np.searchsorted(keys, np.frombuffer(links.as_buffer(), dtype=rows.kind))
                n_best.append(int(best[at].sum()))
                count_sum.append(int(n[at].sum()))
            added = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
            yield pa.RecordBatch.from_arrays([added.get(c) if c in added else part.column(c) for c in _OUT], _OUT)

    schema = ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in _OUT)
    return summaries.mapInArrow(run, schema)


def _scored_by_join(summaries: DataFrame, counts: DataFrame, rows: Rows) -> DataFrame:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 1):
            pairs, n = np.unique(np.frombuffer(part.column(1)[0].as_buffer(), dtype=rows.kind), return_counts=True)
            row = pa.array(np.full(len(pairs), part.column(0)[0].as_py(), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([row, pa.array(pairs.astype(np.int64)), pa.array(n)], ["row", "pair", "times"])

    once = summaries.select("row", "links").dropDuplicates(["row"])
    linked = once.mapInArrow(spread, "row long, pair long, times long").join(counts, "pair")
    sums = linked.groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    joined = summaries.drop("links").join(sums, "row", "left").fillna(0, ["n_best", "count_sum"])
    return joined.select(*_OUT)


def vocabulary(path_a: str, path_b: str) -> Rows:
    """Rows for these two tokenizers."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    size_b = SentencePieceProcessor(model_file=path_b).get_piece_size()
    return Rows(size_b, pair_type(Tokenizer.from_file(path_a).get_vocab_size(), size_b))


def aligned(
    docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK_BYTES, broadcast_pairs: int = BROADCAST_PAIRS
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs (doc_id, text)."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("row"),
        F.col("text").cast("string").alias("text"),
    )
    rows = vocabulary(path_a, path_b)
    long = F.coalesce(F.length("text"), F.lit(0)) > chunk
    short = short_summaries(texts.filter(~long), path_a, path_b)
    composed_ = long_summaries(texts.filter(long), path_a, path_b, chunk, rows)
    summaries = Scratch(docs.sparkSession, "alignment").write(short.unionByName(composed_))
    return scored(summaries, pair_counts(summaries, rows), rows, broadcast_pairs)
