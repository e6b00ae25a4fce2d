"""BPE encoding and decoding by rounds of merges over one flat numpy array.

The distinct chunks of many texts (runs without white space) are cut into words by the tokenizer's pattern; the symbols
of all words that a task does not remember lie in one array. Each round finds the rank of every adjacent pair by binary
search over the sorted pair keys, takes each word's lowest rank and merges its occurrences from the left; a word without
a known pair leaves the array. If the symbol that a merge makes takes part in a merge of lower rank, only the leftmost
occurrence is merged in a round, so the order is that of one merge at a time.

Read are tokenizer files of the kind: NFC, white space made plain, lower case; pattern split without white space; byte
level; BPE with an end-of-word suffix; no decoder, so tokens are decoded as their strings joined by spaces. Anything
else is refused. Special tokens inside texts are found before all of this, as the library does by default.

Null text: as empty, no ids. Null doc_id and repeated rows: coded like any row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.llm.common import arrow_map

#: Characters of remembered chunks per task; the memory is emptied when it is full.
MEMORY_CHARS = 4_000_000
#: Symbols in the flat array of one call, or a single longer word.
FLAT_SYMBOLS = 1 << 20

# The white space of the tokenizer's pattern; str.split() has four control characters more.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_MORE_SPACE = re.compile("[\x1c-\x1f]")
_NONE = np.iinfo(np.int64).max


def byte_symbols() -> list[str]:
    """The printable character that byte-level tokenizers write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str, memory_chars: int = MEMORY_CHARS) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        steps = [step["type"] for step in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        known = (
            steps == ["NFC", "Replace", "Lowercase"] and split["behavior"] == "Removed" and split["invert"]
            and level["type"] == "ByteLevel" and not level["add_prefix_space"] and not level["use_regex"]
            and model["type"] == "BPE" and not model["continuing_subword_prefix"] and spec["decoder"] is None
            and not model.get("ignore_merges") and not model.get("byte_fallback") and not model.get("dropout")
        )
        if not known:
            raise ValueError("not a tokenizer of this kind")
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.word = regex.compile(split["pattern"]["Regex"])
        self.tokens = {i: token for token, i in vocab.items()}
        self.tokens |= {token["id"]: token["content"] for token in spec["added_tokens"]}
        self.added = {token["content"]: token["id"] for token in spec["added_tokens"]}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if self.added else None
        self.first = np.array([vocab[s] for s in byte_symbols()], dtype=np.int64)
        self.last = np.array([vocab[s + suffix] for s in byte_symbols()], dtype=np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        # The lowest rank of a merge that a symbol takes part in.
        soonest = np.full(max(self.tokens) + 1, _NONE, dtype=np.int64)
        for side in (keys >> 32, keys & 0xFFFFFFFF):
            np.minimum.at(soonest, side, np.arange(len(keys)))
        self.one_at_a_time = soonest[made] < np.arange(len(keys))
        self.memory_chars, self.used, self.known = memory_chars, 0, {}

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, number of ids of each word); words are not empty."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols, owner = self.first[data], np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[data[ends]]
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbols):
            rank = np.full(len(symbols), _NONE, dtype=np.int64)
            pairs = symbols[:-1] << 32 | symbols[1:]
            place = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
            found = (self.keys[place] == pairs) & (owner[:-1] == owner[1:])
            rank[:-1][found] = self.ranks[place[found]]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(symbols)])
            best = np.repeat(lowest, lengths)
            over = best == _NONE
            if over.any():
                done.append((owner[over], symbols[over]))
            at = np.flatnonzero((rank == best) & ~over)
            if not len(at):
                break
            same_word = np.r_[False, owner[at[1:]] == owner[at[:-1]]]
            # Of overlapping occurrences (a run at neighbouring places) every second one is merged.
            run = np.maximum.accumulate(np.where(same_word & (np.diff(at, prepend=-9) == 1), 0, np.arange(len(at))))
            chosen = (np.arange(len(at)) - run) % 2 == 0
            chosen &= ~(same_word & self.one_at_a_time[rank[at]])
            at = at[chosen]
            symbols[at] = self.made[rank[at]]
            stay = ~over
            stay[at + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        owners = np.concatenate([o for o, _ in done])
        order = np.argsort(owners, kind="stable")
        ids = np.concatenate([s for _, s in done])[order]
        return ids, np.bincount(owners, minlength=len(words))

    def _learn(self, chunks: list[str]) -> None:
        """Remember the ids (as little-endian 32-bit integers) of chunks, whose words share flat arrays."""
        words = [[w.encode() for w in self.word.findall(chunk)] for chunk in chunks]
        flat = list(dict.fromkeys(w for found in words for w in found))
        coded: dict[bytes, bytes] = {}
        start = 0
        while start < len(flat):
            end, size = start, 0
            while end < len(flat) and (end == start or size + len(flat[end]) <= FLAT_SYMBOLS):
                size += len(flat[end])
                end += 1
            ids, lengths = self.merged(flat[start:end])
            data, bounds = ids.astype("<u4").tobytes(), (4 * np.r_[0, np.cumsum(lengths)]).tolist()
            coded.update((w, data[a:b]) for w, a, b in zip(flat[start:end], bounds, bounds[1:]))
            start = end
        self.known.update((chunk, b"".join(map(coded.__getitem__, found))) for chunk, found in zip(chunks, words))

    def _chunks(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower case character by character, not by place in the word
            text = text.replace("Σ", "σ")
        text = text.lower()
        return [c for c in _SPACE.split(text) if c] if _MORE_SPACE.search(text) else text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        cut = []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            cut.append([(i % 2, part if i % 2 else self._chunks(part)) for i, part in enumerate(parts)])
        wanted = {c for parts in cut for special, part in parts if not special for c in part}
        unknown = list(wanted.difference(self.known))
        self.used += sum(map(len, unknown))
        self._learn(unknown)
        found = [
            b"".join(
                self.added[part].to_bytes(4, "little") if special else b"".join(map(self.known.__getitem__, part))
                for special, part in parts
            )
            for parts in cut
        ]
        if self.used > self.memory_chars:
            self.used, self.known = 0, {}
        return found

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def coded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian 32-bit integers), n_tokens; path: a tokenizer file that every executor has."""
    state: dict[str, WordBpe] = {}

    def work(part: pa.RecordBatch) -> dict:
        bpe = state.get("") or state.setdefault("", WordBpe(path))
        ids = bpe.encode([text or "" for text in part.column(1).to_pylist()])
        return {"doc_id": part.column(0), "ids": ids, "n_tokens": [len(x) // 4 for x in ids]}

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(texts, work, "doc_id long, ids binary, n_tokens long")


def decoded(codes: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (of the decoded text) of rows with ids."""
    state: dict[str, WordBpe] = {}

    def work(part: pa.RecordBatch) -> dict:
        bpe = state.get("") or state.setdefault("", WordBpe(path))
        ids = part.column(1).to_pylist()
        return {
            "doc_id": part.column(0), "n_tokens": part.column(2),
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids],
        }

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(codes.select("doc_id", "ids", "n_tokens"), work, schema)
