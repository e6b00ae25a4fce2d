"""Benchmark passages in documents, found with a budget of edits.

An item's form (lower-cased words joined by single spaces) is split into budget + 1 pieces. If a document holds the
item with at most `budget` edits (inserted, deleted or changed characters), at least one piece is there unchanged. The
pieces of many items are looked up in one pass (Aho-Corasick); around each hit, Myers' bit-parallel algorithm gives the
least edit distance of the item to any passage there. The budget is `edit_rate` of the item's characters, rounded down.

The items are read in blocks of at most BLOCK_CHARS characters, each a scan of the documents with an automaton of
bounded size; documents are never shuffled. Items of fewer than `min_chars` characters in form are searched without edits and
between word borders only, as chance would find them otherwise; null items, and those without a word, are not searched. Null text:
no match. Null doc_id: matched like any. Repeated rows, and texts that repeat an item id: the best match for each pair, of equal
distances the one that ends first. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm.common import arrow_map

EDIT_RATE = 0.05
MIN_CHARS = 30
BLOCK_CHARS = 2_000_000
_SCHEMA = "doc_id long, item_id long, distance long, end_char long"


def form(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def split_pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece) of budget + 1 pieces of almost equal length."""
    bounds = [len(text) * i // (budget + 1) for i in range(budget + 2)]
    return [(start, text[start:end]) for start, end in zip(bounds, bounds[1:])]


class Pattern:
    """A text to be found with edits; bit i of a mask stands for its character i."""

    def __init__(self, text: str) -> None:
        self.length, self.masks = len(text), {}
        for i, char in enumerate(text):
            self.masks[char] = self.masks.get(char, 0) | 1 << i

    def best(self, text: str) -> tuple[int, int]:
        """(least distance to any passage of text, its first end), after Myers (1999)."""
        every, top = (1 << self.length) - 1, 1 << (self.length - 1)
        plus, minus, score = every, 0, self.length
        best = (score, 0)
        for end, char in enumerate(text, 1):
            same = self.masks.get(char, 0)
            vertical = same | minus
            across = (((same & plus) + plus) ^ plus) | same
            up, down = minus | (every & ~(across | plus)), plus & across
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = (up << 1) & every, (down << 1) & every
            plus, minus = down | (every & ~(vertical | up)), up & vertical
            if score < best[0]:
                best = (score, end)
        return best


class Index:
    """Pieces and patterns of a block of items."""

    def __init__(self, items: list[tuple[int, str]], edit_rate: float, min_chars: int = MIN_CHARS) -> None:
        budget = lambda text: int(edit_rate * len(text)) if len(text) >= min_chars else 0
        self.min_chars = min_chars
        self.items = [(item, Pattern(text), budget(text)) for item, text in items]
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(items):
            for offset, piece in split_pieces(text, self.items[k][2]):
                places.setdefault(piece, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.automaton.make_automaton()

    def matches(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item_id, distance, end) of the best match of each item within its budget."""
        spans: dict[int, list[list[int]]] = {}
        for end, (size, found) in self.automaton.iter(text):
            for k, offset in found:
                _, pattern, budget = self.items[k]
                start = end + 1 - size - offset
                if pattern.length < self.min_chars:
                    if text[start - 1 : start] in ("", " ") and text[end + 1 : end + 2] in ("", " "):
                        spans.setdefault(k, []).append([start, end + 1])
                    continue
                low, high = max(0, start - budget), start + pattern.length + budget
                own = spans.setdefault(k, [])
                if own and low <= own[-1][1] and low >= own[-1][0]:  # overlapping windows are read once
                    own[-1][1] = max(own[-1][1], high)
                else:
                    own.append([low, high])
        for k, windows in spans.items():
            item, pattern, budget = self.items[k]
            best = min((d, low + end) for low, high in windows for d, end in [pattern.best(text[low:high])])
            if best[0] <= budget:
                yield item, *best


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """(item_id, form) in blocks; one partition of the benchmark at a time is with the driver."""
    chosen = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null")
    block, size = [], 0
    for item, text in chosen.toLocalIterator():
        if not (text := form(text)):
            continue
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text)
    if block:
        yield block


def contaminated(
    docs: DataFrame, benchmark: DataFrame, edit_rate: float = EDIT_RATE, min_chars: int = MIN_CHARS,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """doc_id, item_id, distance, end_char (of the match, in the document's form), one row per pair."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    out = spark.createDataFrame([], _SCHEMA)
    for block in item_blocks(benchmark, block_chars):
        shared = spark.sparkContext.broadcast(block)  # at most block_chars, or one item
        state: dict[str, Index] = {}

        def work(part: pa.RecordBatch, shared=shared, state=state) -> dict | None:
            index = state.get("") or state.setdefault("", Index(shared.value, edit_rate, min_chars))
            rows = [
                (doc, *match)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1))
                for match in index.matches(form(text.as_py()))
            ]
            return dict(zip(("doc_id", "item_id", "distance", "end_char"), zip(*rows))) if rows else None

        out = out.union(arrow_map(texts, work, _SCHEMA))
    best = F.min(F.struct("distance", "end_char")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")
