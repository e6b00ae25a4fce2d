"""Language identification in two steps: the family first, then one-versus-one linear SVMs inside the family.

Features are the square roots of the shares of hashed two- and three-byte sequences of the whole lower-cased text, white space, digits and
ASCII punctuation being one character. Families are told apart by one-versus-rest linear support vector machines, the
languages of a family by one machine per pair, whose votes (then margins) decide. The machines only compare languages. So
the score, a product of their certainties, is lowered for a text whose sequences are rare in every learned language: by
how far their mean logarithmic frequency is below a cutoff from labelled texts that the frequencies were not taken from.
A language of too few texts for a cutoff lowers no score of its texts.

Training takes at most TRAIN_ROWS distinct labelled texts, in equal shares for each language, those with the smallest
text hashes; their features, not their texts, go to the driver. Everything else runs over all rows. The id and the label
of a document are no inputs of its prediction.

Null text or a text without a letter: `und`, score 0. Null language: not learned. Nothing to learn from: all `und`.
Null doc_id: predicted like any row; as an id it is not held out. Repeated rows: predicted alike. Other columns are
ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockline.llm.common import arrow_map

WIDTH = 2048
TRAIN_ROWS = 4000
EPOCHS = 40
COST = 10.0
#: A text's mean deviates as if it were of this many sequences at most: texts differ in their words however long they are.
STEADY = 300.0
#: Texts of a language that set its cutoff, at least; with fewer no text of it is taken for unusual.
LEAST_HELD = 20
#: The cutoff is so many times as far below the median as the lowest hundredth of the held-out texts, which are clean mostly.
LENIENCE = 3.0
#: Language families of the languages most often met; another language is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}

_TABLE = np.arange(256, dtype=np.uint32)
_TABLE[[b for b in range(128) if not chr(b).isalpha()]] = 32


def shares(texts: list[bytes]) -> np.ndarray:
    """(texts, WIDTH) square roots of the shares of hashed byte pairs and triples; a row of zeros for a text of fewer than two bytes."""
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    codes = _TABLE[np.frombuffer(b"".join(texts).lower(), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(texts), dtype=np.uint32), lengths)
    if len(codes) < 2:
        return out
    total = np.zeros(len(texts) * WIDTH)
    pairs = codes[:-1] * np.uint32(256) + codes[1:]
    for size, grams in ((2, pairs), (3, pairs[:-1] * np.uint32(256) + codes[2:])):
        slot = (grams * np.uint32(0x9E3779B1)) >> np.uint32(21)  # 2 ** 11 = WIDTH slots
        inside = owner[: len(grams)] == owner[size - 1 :]
        total += np.bincount(owner[: len(grams)][inside] * np.uint32(WIDTH) + slot[inside], minlength=len(total))
    total = total.reshape(len(texts), WIDTH)
    sums = total.sum(axis=1, keepdims=True)
    return np.sqrt(np.divide(total, sums, out=total, where=sums > 0)).astype(np.float32)


def svm(rows: np.ndarray, signs: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (the last one the bias) of a linear SVM with squared hinge loss, by dual coordinate descent.

    Rows of the smaller class weigh more, so that both classes weigh the same.
    """
    share = np.where(signs > 0, (signs > 0).mean(), (signs < 0).mean())
    slack = share / cost  # 1 / (2 C) of each row
    # One row at a time in double precision, with its bias: a copy of all rows would take twice the memory of the rows.
    x = np.ones(rows.shape[1] + 1)
    norms = np.empty(len(rows))
    for i, row in enumerate(rows):
        x[:-1] = row
        norms[i] = (x * x).sum() + slack[i]
    weights, alpha, rng = np.zeros(len(x)), np.zeros(len(rows)), np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x[:-1] = rows[i]
            slope = signs[i] * (x @ weights) - 1 + slack[i] * alpha[i]
            new = max(0.0, alpha[i] - slope / norms[i])
            if new != alpha[i]:
                weights += (new - alpha[i]) * signs[i] * x
                alpha[i] = new
    return weights


def gram_counts(sizes: np.ndarray) -> np.ndarray:
    """Byte pairs and triples of texts of these bytes."""
    return np.maximum(2.0 * np.asarray(sizes) - 3, 1)


class Usual:
    """How frequent the sequences of a text are in one language, from rows of shares and sizes in bytes of its texts."""

    def __init__(self, rows: np.ndarray, held_rows: np.ndarray, held_sizes: np.ndarray) -> None:
        frequency = (rows.astype(np.float64) ** 2).mean(axis=0) + 1e-4
        frequency /= frequency.sum()
        self.weights = np.log(frequency * WIDTH).astype(np.float32)
        self.middle, self.cutoff = 0.0, 0.0
        spread = np.sqrt(frequency @ (self.weights - frequency @ self.weights) ** 2)
        self.middle = float(np.median(held_rows**2 @ self.weights))
        lowest = np.quantile(self.over(held_rows, held_sizes), 0.01)
        self.cutoff = LENIENCE * min(float(lowest), -2.33 * float(spread))  # as for independent sequences, at least

    def over(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Deviations above the cutoff, on a scale on which short and long texts vary alike; negative: unusual."""
        return (rows**2 @ self.weights - self.middle) / np.sqrt(1 / gram_counts(sizes) + 1 / STEADY) - self.cutoff


class Hierarchy:
    """The trained machines; `predict` gives a language and a score in 0 to 1 for rows of shares and sizes of texts."""

    def __init__(
        self, rows: np.ndarray, sizes: np.ndarray, langs: list[str], families: dict[str, tuple[str, ...]]
    ) -> None:
        family_of = {lang: name for name, members in families.items() for lang in members}
        langs_, rows = np.array(langs), rows.astype(np.float32, copy=False)
        self.langs = sorted(set(langs))
        kin = np.array([family_of.get(lang, lang) for lang in langs])
        self.families = sorted(set(kin))
        self.members = {f: sorted(set(langs_[kin == f])) for f in self.families}
        many = len(self.families) > 1
        heads = [svm(rows, np.where(kin == f, 1, -1)) for f in self.families] if many else []
        self.pairs = [(f, a, b) for f in self.families for a, b in combinations(self.members[f], 2)]
        for _, a, b in self.pairs:
            chosen = (langs_ == a) | (langs_ == b)
            heads.append(svm(rows[chosen], np.where(langs_[chosen] == a, 1, -1)))
        self.weights = np.array(heads).reshape(len(heads), WIDTH + 1).T.astype(np.float32)
        self.usual: dict[str, Usual] = {}
        found = np.array(self.predict(rows, sizes)[0])  # a text that is found in another language may be labelled wrongly
        for lang in self.langs:
            own = np.flatnonzero(langs_ == lang)
            held = own[1::2][found[own[1::2]] == lang]
            if len(held) >= LEAST_HELD:
                self.usual[lang] = Usual(rows[own[::2]], rows[held], sizes[held])

    def predict(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[list[str], list[float]]:
        margins = rows @ self.weights[:-1] + self.weights[-1]
        n = len(self.families) if len(self.families) > 1 else 0
        top = margins[:, :n].argmax(axis=1) if n else np.zeros(len(rows), dtype=np.int64)
        sure = 1 / (1 + np.exp(-3 * margins[np.arange(len(rows)), top])) if n else np.ones(len(rows))
        langs, scores = [], []
        for i, f in enumerate(top):
            family = self.families[f]
            votes = {lang: [0, 0.0, 1.0] for lang in self.members[family]}
            for j, (own, a, b) in enumerate(self.pairs):
                if own == family:
                    m = float(margins[i, n + j])
                    for lang, sign in ((a, 1), (b, -1)):
                        won = 1 / (1 + np.exp(-3 * sign * m))
                        votes[lang] = [votes[lang][0] + (sign * m > 0), votes[lang][1] + sign * m, votes[lang][2] * won]
            best = max(votes, key=lambda lang: (*votes[lang][:2], lang))
            langs.append(best)
            scores.append(float(sure[i]) * float(votes[best][2]))
        if self.usual:
            over = np.max([usual.over(rows, sizes) for usual in self.usual.values()], axis=0)
            lowered = np.exp(np.minimum(over, 0.0))
            scores = [s * float(f) if lang in self.usual else s for lang, s, f in zip(langs, scores, lowered)]
        return langs, scores


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame, train_rows: int = TRAIN_ROWS, families: dict[str, tuple[str, ...]] = FAMILIES
) -> Hierarchy | None:
    """A hierarchy from the text and lang of docs; None without a labelled text of a letter."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), "text").filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    keyed = rows.withColumn("key", F.xxhash64("text"))
    names = [row.lang for row in rows.select("lang").distinct().collect()]  # the language codes
    if not names:
        return None
    share = max(1, train_rows // len(names))
    # Distinct texts by hash: a group of copies takes one place. The rank filter is applied before the shuffle too.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = keyed.select("lang", "key").distinct().withColumn("place", place).filter(F.col("place") <= share)
    sample = keyed.join(F.broadcast(chosen.select("lang", "key")), ["lang", "key"], "left_semi")  # train_rows rows
    sample = sample.dropDuplicates(["lang", "key"]).select("lang", "key", F.col("text").cast("binary").alias("text"))

    def work(part: pa.RecordBatch) -> dict:
        texts = part.column(2).to_pylist()
        return {
            "lang": part.column(0), "key": part.column(1), "shares": [row.tobytes() for row in shares(texts)],
            "size": [len(text) for text in texts],
        }

    found = arrow_map(sample, work, "lang string, key long, shares binary, size long").collect()  # at most train_rows rows
    found.sort(key=lambda row: (row.key, row.lang))
    langs, sizes = [row.lang for row in found], np.array([row.size for row in found])
    matrix = np.empty((len(found), WIDTH), dtype=np.float32)
    for i in range(len(found) - 1, -1, -1):  # each row goes as it is placed, so that the driver holds them once
        matrix[i] = np.frombuffer(found.pop().shares, dtype=np.float32)
    return Hierarchy(matrix, sizes, langs, families)


def predicted(docs: DataFrame, model: Hierarchy | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH weights per machine

    def work(part: pa.RecordBatch) -> dict:
        n, lettered = part.num_rows, np.array(part.column(3).to_pylist())
        langs, scores = ["und"] * n, [0.0] * n
        if lettered.any() and shared.value is not None:
            texts = [text.as_py() or b"" for text in part.column(2)]
            langs, scores = shared.value.predict(shares(texts), np.array([len(text) for text in texts]))
        return {
            "doc_id": part.column(0), "held_out": part.column(1),
            "lang_pred": [x if ok else "und" for x, ok in zip(langs, lettered)],
            "score": [x if ok else 0.0 for x, ok in zip(scores, lettered)],
        }

    columns = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
        F.col("text").cast("binary").alias("data"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("ok"),
    )
    return arrow_map(columns, work, "doc_id long, held_out boolean, lang_pred string, score double")


def learned(docs: DataFrame) -> Hierarchy | None:
    """The machines from the labelled documents that are not held out."""
    return train(docs.filter(~held_out(F.col("doc_id"))))


def identified(docs: DataFrame) -> DataFrame:
    """Learn from the labelled documents that are not held out, predict all."""
    return predicted(docs, learned(docs))
