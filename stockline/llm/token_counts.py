"""Token counts by a public tokenizer in Arrow functions that return lengths only.

A text is cut at safe boundaries: before a space that follows a character other than white space. There the tokenizer's
pattern starts afresh, so the pieces' counts add up to the text's. A task counts each distinct piece once while it
remembers it, and hands unknown pieces to the tokenizer in batches of about BATCH_BYTES, however long the texts are.
This holds for byte-level tokenizers that split text by the common pattern before merging and whose added tokens hold
no white space, which `Counter` checks. A text without a safe boundary is one piece.

Null and empty text: no bytes, no tokens. Null doc_id and repeated rows: counted like any row. Other columns are ignored.
"""

from __future__ import annotations

import json
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm.common import arrow_map

LIMIT = 1024
BATCH_BYTES = 1 << 18
#: Characters of remembered pieces per task; the memory is emptied when it is full.
MEMORY_CHARS = 4_000_000


def pieces(text: str) -> list[str]:
    """The text, cut before every space that follows a character other than white space."""
    parts = text.split(" ")
    found, head = [], parts[0]
    for part in parts[1:]:
        if head and not head[-1].isspace():
            found.append(head)
            head = " " + part
        else:
            head = f"{head} {part}"
    found.append(head)
    return found


class Counter:
    """Counts tokens of texts; one per task."""

    def __init__(self, path: str, memory_chars: int = MEMORY_CHARS) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec["pre_tokenizer"] or {}
        whole = spec["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"]
        if not whole or split["add_prefix_space"]:
            raise ValueError("texts can be cut only for byte-level tokenizers with the common pattern")
        if any(c.isspace() for token in spec["added_tokens"] for c in token["content"]):
            raise ValueError("an added token holds white space")
        if any(token["lstrip"] or token["rstrip"] or token["single_word"] for token in spec["added_tokens"]):
            raise ValueError("an added token looks at its surroundings")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel ones
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.memory_chars, self.used, self.known = memory_chars, 0, {"": 0}

    def _learn(self, unknown: list[str]) -> None:
        batch, size = [], 0
        for piece in unknown:
            batch.append(piece)
            size += len(piece.encode())
            if size >= BATCH_BYTES:
                self._encode(batch)
                batch, size = [], 0
        if batch:
            self._encode(batch)

    def _encode(self, batch: list[str]) -> None:
        found = self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)
        self.known.update(zip(batch, map(len, found)))

    def __call__(self, texts: list[str]) -> list[int]:
        cut = [pieces(text) for text in texts]
        unknown = {piece for text in cut for piece in text}.difference(self.known)
        self.used += sum(map(len, unknown))
        self._learn(list(unknown))
        totals = [sum(map(self.known.__getitem__, text)) for text in cut]
        if self.used > self.memory_chars:
            self.used, self.known = 0, {"": 0}
        return totals


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; path: a tokenizers file that every executor has."""
    state: dict[str, Counter] = {}

    def work(part: pa.RecordBatch) -> dict:
        counter = state.get("") or state.setdefault("", Counter(path))
        totals = counter([text or "" for text in part.column(1).to_pylist()])
        return {"doc_id": part.column(0), "n_bytes": part.column(2), "n_tokens": totals,
                "over_limit": [n > limit for n in totals]}

    columns = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
    )
    return arrow_map(columns, work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
