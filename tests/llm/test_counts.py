"""Quality rules, token counts and BPE against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stockline.llm import bpe, quality_rules, token_counts
from stockline.llm.stats import beta_cdf, binomial_cdf

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TRICKY = [
    None, "", " ", "\n\n", "a", "  a  b ", "x\xa0 y", "a\xa0\xa0 b\xa0\nc", "tab\tand\x0bmore\x1cor\x1d less\x85end",
    "<|endoftext|>", "a <|endoftext|> b<|startoftext|>c <|ENDOFTEXT|>", "it's I'LL we'd 'S", "ΣΑΣ ΟΔΟΣ Σ", "İstanbul ﬁ é é",
    "日本語 テキスト", "🙂🙃 12345 ½ ²", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "a" * 5000, "word " * 3000, "no" + "space" * 4000,
    "a b　c​d᠎e", "### $$$ !!! ???", "the the  the\n the\t the", "é ́x", "a b " + "́",
]


def noise(n: int) -> list[str]:
    rng = random.Random(5)
    letters = "aabbcdeéßΣñ '’.,!?<|>endoftext 0129\n\t\xa0\x1c 　日本🙂"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 200))) for _ in range(n)]


def test_token_counts_equal_the_library(documents):
    texts = TRICKY + noise(400)
    library = Tokenizer.from_file(BYTES)
    found = {r.doc_id: r for r in token_counts.token_counts(documents(*texts), BYTES, 50).collect()}
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (found[i].n_bytes, found[i].n_tokens, found[i].over_limit) == (len((text or "").encode()), n, n > 50), text


def test_small_memory_changes_nothing():
    texts = [t or "" for t in TRICKY + noise(50)]
    plain, forgetful = token_counts.Counter(BYTES), token_counts.Counter(BYTES, memory_chars=10)
    assert [plain([t])[0] for t in texts] == [forgetful([t])[0] for t in texts] == plain(texts)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.Counter(WORDS)
    with pytest.raises((ValueError, TypeError)):
        bpe.WordBpe(BYTES)


def test_bpe_equals_the_library(documents):
    texts = TRICKY + noise(400)
    library = Tokenizer.from_file(WORDS)
    frame = bpe.decoded(bpe.coded(documents(*texts), WORDS), WORDS)
    found = {r.doc_id: r for r in frame.collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        packed = hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert found[i].ids_sha256 == packed, repr(text)
        assert found[i].n_tokens == len(ids)
        assert found[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest(), repr(text)


def test_bpe_in_small_arrays(monkeypatch):
    texts = [t or "" for t in TRICKY + noise(60)]
    whole = bpe.WordBpe(WORDS).encode(texts)
    monkeypatch.setattr(bpe, "FLAT_SYMBOLS", 5)
    assert bpe.WordBpe(WORDS, memory_chars=3).encode(texts) == whole


def test_tails():
    for n, p in ((1, 0.3), (20, 0.05), (300, 0.02)):
        for k in range(0, n + 1, max(1, n // 7)):
            exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert binomial_cdf(k, n, p) == pytest.approx(exact, abs=1e-10)
    assert beta_cdf(0.5, 7, 7) == pytest.approx(0.5)
    assert (binomial_cdf(-1, 5, 0.1), binomial_cdf(5, 5, 0.1)) == (0.0, 1.0)


def plain_counts(text: str | None) -> tuple:
    text = text or ""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    words = word.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, marked, lines, repeats = Counter(windows), set(), set(), 0
    for i, window in enumerate(windows):
        if often[window] > 1:
            marked |= {i, i + 1, i + 2}
    for line in text.split("\n"):
        if word.search(line):
            repeats += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(marked)


def test_counts_of_a_text():
    rng = random.Random(3)
    texts = TRICKY + [" ".join(rng.choice("abc\n") for _ in range(rng.randrange(60))) for _ in range(200)]
    for text in texts:
        assert quality_rules.text_counts(text)[:5] == plain_counts(text)


def labelled(spark, n: int, noisy: int = 0):
    good = "plain words about many different things " * 3
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = [f"w{i}x{j}" for j in range(60)]
        text = " ".join(w + "###" for w in words) if bad or i < noisy else " ".join(words) + " " + good
        rows.append((i, text, "en" if i % 2 else None, "s", len(text)))
        labels.append((i, 0 if bad else 1, 0))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules_are_certified_with_enough_labels_only(spark):
    docs, labels = labelled(spark, 1200)
    found = {r.doc_id: r for r in quality_rules.judged(docs, labels).collect()}
    # Odd ids ("en") hold no bad document, so nothing is proposed there; the null stratum rejects exactly the bad ones.
    assert {i for i, r in found.items() if not r.kept} == {i for i in range(1200) if i % 4 == 0}
    docs, labels = labelled(spark, 60)
    assert all(r.kept for r in quality_rules.judged(docs, labels).collect())


def test_rules_that_lose_too_much_are_off(spark):
    docs, labels = labelled(spark, 1200, noisy=400)
    kept = [r.kept for r in quality_rules.judged(docs, labels).collect()]
    assert all(kept)


def test_rules_without_labels_or_documents(spark, documents, clashing):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = quality_rules.judged(documents(None, "", "a " * 60, (None, "b c"), " ".join(map(str, range(99)))), none)
    assert sorted((r.n_words, r.base_failed, r.kept) for r in found.collect()) == [
        (0, True, False), (0, True, False), (2, True, False), (60, True, False), (99, False, True)
    ]
    nulls = spark.createDataFrame([(None, 1, None), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert quality_rules.judged(clashing, nulls).count() == 6
    assert quality_rules.judged(documents(), none).count() == 0


def test_empty_tables_and_clashing_names(documents, clashing):
    assert token_counts.token_counts(documents(), BYTES).count() == 0
    assert token_counts.token_counts(clashing, BYTES).count() == 6
    assert bpe.coded(documents(), WORDS).count() == 0
    assert bpe.coded(clashing, WORDS).count() == 6
