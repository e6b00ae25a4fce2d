"""Alignment of two tokenizers against plain offsets and loops, and the fragment monoid's laws."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from functools import reduce

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stockline.llm import alignment as al
from stockline.llm.token_counts import pieces
from tests.llm.test_counts import TRICKY, noise

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RESULTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
NONE = (0, 0, 0, 0, 0, 0, "")


def spans(parts: list[bytes]) -> list[tuple[int, int]]:
    ends = [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
    return [(end - len(part), end) for part, end in zip(parts, ends)]


def brute(texts: list[str | None]) -> list[tuple]:
    """The contract, text by text, with whole texts given to both libraries."""
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    letters = {c: x for x, c in enumerate_bytes()}
    found = []
    for text in texts:
        a = first.encode(f" {text}", add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in first.id_to_token(x)) for x in a]
        names = [second.id_to_piece(x) for x in b]
        bytes_b = [bytes([int(n[3:5], 16)]) if second.is_byte(x) else n.replace("▁", " ").encode() for x, n in zip(b, names)]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == f" {text}".encode():
            found.append(None)
            continue
        of_a, of_b = spans(bytes_a), spans(bytes_b)
        links = [(x, y) for x, (s, e) in zip(a, of_a) for y, (t, f) in zip(b, of_b) if s < f and t < e]
        groups, start = [], 0
        for end in sorted({e for _, e in of_a} & {e for _, e in of_b}):
            inside = [[str(x) for x, (s, e) in zip(ids, of) if s >= start and e <= end] for ids, of in ((a, of_a), (b, of_b))]
            groups.append("|".join(map(",".join, inside)))
            start = end
        found.append((len(a), len(b), groups, links))
    counts = Counter(link for f in found if f for link in f[3])
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [
        (f[0], f[1], len(f[2]), len(f[3]), sum(counts[x] == most[x[1]] for x in f[3]), sum(counts[x] for x in f[3]),
         hashlib.sha256(";".join(f[2]).encode()).hexdigest())
        if f else NONE
        for f in found
    ]


def enumerate_bytes():
    """(byte, its letter) by the tokenizers library itself."""
    from tokenizers.pre_tokenizers import ByteLevel

    plain = ByteLevel(add_prefix_space=False, use_regex=False)
    for char in map(chr, [*range(0x80), *range(0x80, 0x800, 0x40), *range(0x80, 0xC0), *range(0x800, 0x10000, 0x800)]):
        if not 0xD800 <= ord(char) < 0xE000:
            yield from zip(char.encode(), plain.pre_tokenize_str(char)[0][0])
    yield from zip("\U00010000\U00040000\U00080000\U000c0000\U00100000".encode(), plain.pre_tokenize_str("\U00010000\U00040000\U00080000\U000c0000\U00100000")[0][0])


TEXTS = [
    *TRICKY, "trailing ", "two  ", " leading", "  two", "a \n b", "lower one eighth ▁ block", "<s> hi </s> <0x41> <unk>",
    "\x00 null", "a\x1c b\x85 c　d", "don't  stop.  Now   ", "".join(map(chr, range(33, 127))) * 3,
]


def results(frame) -> dict:
    return {r.doc_id: tuple(r[c] for c in RESULTS) for r in frame.collect()}


@pytest.mark.parametrize(("chunk", "pairs"), [(1 << 16, 1 << 20), (40, 1 << 20), (40, 0)])
def test_alignment_equals_plain_loops(documents, chunk, pairs):
    texts = TEXTS + noise(60)
    found = results(al.aligned(documents(*texts), A, B, chunk, pairs))
    for text, got, want in zip(texts, (found[i] for i in range(len(texts))), brute(texts)):
        assert got == want, text


def test_very_long_text_is_composed_across_tasks(documents):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdeéß日.,\n") for _ in range(rng.randrange(1, 9))) for _ in range(30_000))
    one, many = (results(al.aligned(documents(text, "x" * 50_000), A, B, chunk)) for chunk in (10**9, 3000))
    assert one == many and one[0][0] > 50_000
    # The library's own count of the whole text.
    assert one[0][0] == len(Tokenizer.from_file(A).encode(" " + text, add_special_tokens=False).ids)


def test_rows_nulls_clashing_columns_and_empty_table(spark, documents, clashing):
    again = documents((None, "some words here"), (None, "some words here"), (1, None), (1, "some words here"), (1, "some words here"))
    for pairs, chunk in ((0, 5), (1 << 20, 1 << 16)):
        rows = al.aligned(again, A, B, chunk, pairs).collect()
        assert len(rows) == 5 and sorted((r.doc_id or 0, r.n_a) for r in rows) == [(0, 3), (0, 3), (1, 0), (1, 3), (1, 3)]
        assert {r.count_sum for r in rows if r.n_a} == {12}  # three links, each met four times
        assert al.aligned(documents(), A, B, chunk, pairs).count() == 0
    odd = clashing.withColumns({c: F.lit("x") for c in ("row", "links", "pair", "place", "n_a", "groups_sha256", "n_best")})
    assert results(al.aligned(odd, A, B)) == results(al.aligned(clashing.select("doc_id", "text"), A, B))


def streams(draw_a: list[int], draw_b: list[int]) -> al.Open:
    """Two token streams over the same bytes, from token lengths."""
    total = min(sum(draw_a), sum(draw_b))
    sides = []
    for lengths in (draw_a, draw_b):
        ends = [e for e in (sum(lengths[: i + 1]) for i in range(len(lengths))) if e < total] + [total]
        sides += [tuple(range(len(ends))), tuple(ends)]
    return al.Open(*sides)


def cut(tokens: al.Open, at: list[int]) -> list[al.Fragment]:
    """Fragments of byte ranges that end anywhere: a token belongs to the range in which it ends."""
    parts = []
    for low, high in zip([-1, *at], [*at, 1 << 30]):
        sides = []
        for ids, ends in ((tokens.a, tokens.a_ends), (tokens.b, tokens.b_ends)):
            chosen = [(i, e) for i, e in zip(ids, ends) if low < e <= high]
            sides += [tuple(i for i, _ in chosen), tuple(e for _, e in chosen)]
        parts.append(al.fragment(al.Open(*sides)))
    return parts


LENGTHS = st.lists(st.integers(1, 5), min_size=1, max_size=30)


@settings(max_examples=200, deadline=None)
@given(LENGTHS, LENGTHS, st.lists(st.integers(0, 120), max_size=6), st.randoms())
def test_composition_is_associative_for_ranges_that_end_anywhere(a, b, at, rng):
    tokens = streams(a, b)
    parts = cut(tokens, sorted(at))
    left = reduce(al.composed, parts)
    while len(parts) > 1:
        i = rng.randrange(len(parts) - 1)
        parts[i : i + 2] = [al.composed(parts[i], parts[i + 1])]
    assert parts[0] == left == al.fragment(tokens)
    assert al.whole(left) == al.whole(al.fragment(tokens))


@settings(max_examples=100, deadline=None)
@given(LENGTHS, LENGTHS, st.lists(st.integers(0, 120), min_size=1, max_size=5))
def test_rows_of_fragments_compose_like_fragments(a, b, at):
    tokens = streams(a, b)
    kind = al.Rows(1000, np.uint32)
    rows = [kind.of(1, i, part) for i, part in enumerate(cut(tokens, sorted(at)))]
    nested = kind.composed([kind.composed(rows[:2]), *rows[2:]])
    flat = kind.composed(rows)
    assert nested == flat
    want = al.fragment(tokens)
    assert (al._unflat(flat["prefix"]), flat["text"], al._unflat(flat["suffix"])) == (
        want.prefix, ";".join(want.closed.texts), want.suffix
    )
    assert flat["links"] == al.packed(want.closed.links, 1000, np.uint32).tobytes()
    none = kind.composed([rows[0], kind.of(1, 1, None)])
    assert not none["sound"] and kind.finished(none) == al._NO_TOKENS


def test_unfit_tokenizers_are_refused():
    with pytest.raises((ValueError, TypeError)):
        al.Tokens(public_tokenizers.path("word_bpe_49k.json"), B)


def test_small_batches_and_joins_change_nothing(documents, monkeypatch):
    texts = [*TEXTS, *noise(20)]
    plain = results(al.aligned(documents(*texts), A, B))
    monkeypatch.setattr(al, "BATCH_CHARS", 50)
    monkeypatch.setattr(al, "JOINED_CHARS", 9)
    assert results(al.aligned(documents(*texts).repartition(3), A, B)) == plain


def test_units_hold_their_own_groups_only():
    tokens = al.Tokens(A, B)
    units = ["one", "two\n", "▁", "é", "don't", " ", "", "日本"]
    together = tokens.units(set(units))
    for unit in units:
        assert str(together.of([unit])) == str(tokens.units({unit}).of([unit])), unit
    assert together.of(["one", "▁"]) is None and together.of([])[:4] == (0, 0, 0, "")


def test_units_are_looked_at_once_as_long_as_they_are_known(monkeypatch):
    tokens, asked = al.Tokens(A, B), []
    units = tokens.units
    monkeypatch.setattr(tokens, "units", lambda found: asked.append(set(found)) or units(found))
    batches = [["the", "cat", "a\u2581b", "", "的猫"], ["cat", "dog", "the", "x\u2581"], ["dog", "", "a\u2581b"], ["naïve", "dog"]]
    of = lambda known, row: (x := known.of(row)) and (*x[:4], x[4].tolist())
    for batch in batches:
        known = tokens.known_units(set(batch))
        for row in [[unit] for unit in batch] + [[u for u in batch if "\u2581" not in u]]:
            assert of(known, row) == of(units(set(row)), row)
    assert asked == [{"the", "cat", "a\u2581b", "", "的猫"}, {"dog", "x\u2581"}, {"naïve"}]
    monkeypatch.setattr(al, "KNOWN_CHARS", 5)
    assert set(tokens.known_units({"cat", "bird"}).place) == {"cat", "bird"}  # what was known is let go


def test_units_are_those_of_the_pattern():
    for text in [t for t in TEXTS + noise(300) if t]:
        assert [" " + unit for unit in al.units_of(text)] == pieces(" " + text), text
