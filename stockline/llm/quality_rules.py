"""Quality rules whose thresholds are set by risk: a bounded share of good documents is lost, per stratum.

Each rule is a score (higher is worse) with a fixed ladder of cutoffs. Labelled documents are split by a hash of their id
into a tuning half and a holdout.

* On the tuning half each stratum chooses, per rule, the cutoff that catches most bad documents less good ones lost (the
  most lenient of equals; none if no cutoff gains), and orders its rules by that gain. The candidates are the first rule,
  the first two together, and so on.
* On the holdout a candidate is certified if, were its true rate of good documents lost above `alpha`, so few losses
  would be seen with probability at most delta / number of strata: the exact binomial bound, corrected for the strata by
  Bonferroni. A stratum's candidates are tested in their fixed order up to the first failure, which needs no further
  correction. The last certified candidate is in force.

So with probability 1 - delta, no stratum loses more than `alpha` of its good documents to the rules; a stratum with too
few labels to show this keeps what the base rules keep.

Null text: no words, base_failed. A null stratum is a stratum of its own. Null labels are not used; a document labelled
twice counts twice. Null doc_id: never labelled. Repeated rows are treated alike. Columns of the documents other than
doc_id, text and the stratum are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockline.llm.common import arrow_map
from stockline.llm.stats import binomial_cdf
from stockline.operators.scale import checkpointed

ALPHA = 0.05  # of a stratum's good documents may be lost
DELTA = 0.05
MIN_WORDS = 50
#: Cutoffs per mille, from lenient to strict.
LADDER = (900, 800, 700, 600, 500, 450, 400, 350, 300, 250, 200, 150, 120, 100, 80, 60, 50, 40, 30, 20, 10)
RULES = ("symbols", "upper", "dup_lines", "repeats", "long_words")

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_COUNTS = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"


def repeat_words(words: list[str]) -> int:
    """Words inside 3-word windows that the text holds twice or more, the first one included."""
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    if len(often) == len(windows):
        return 0
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if often[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of _COUNTS for one text."""
    text = text or ""
    words = _WORD.findall(text)
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return (
        len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)),
        repeat_words(words), len(lines), sum(map(str.isupper, words)),
    )


def counts(docs: DataFrame, stratum: str) -> DataFrame:
    def work(part: pa.RecordBatch) -> dict:
        rows = [text_counts(text.as_py()) for text in part.column(2)]
        return {"doc_id": part.column(0), "stratum": part.column(1), **dict(zip(_COUNTS, zip(*rows)))}

    columns = F.col("doc_id").cast("long").alias("doc_id"), F.col(stratum).cast("string").alias("stratum"), "text"
    schema = "doc_id long, stratum string, " + ", ".join(f"{name} long" for name in _COUNTS)
    return arrow_map(docs.select(*columns), work, schema)


def scores() -> dict[str, Column]:
    """The rules, in per mille of words, lines or a fixed word length."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": 1000 * F.col("n_symbols") / n,
        "upper": 1000 * F.col("n_upper") / n,
        "dup_lines": 1000 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeats": 1000 * F.col("n_repeat_words") / n,
        "long_words": 20 * F.col("word_chars") / n,  # 1000 at a mean of 50 characters
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _labelled(scored: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").alias("_quality"))
    return scored.join(known.filter("_quality in (0, 1)"), F.col("doc_id") == F.col("_id")).withColumn(
        "tuning", F.pmod(F.xxhash64("_id"), F.lit(2)) == 0
    )


def proposals(tuning: DataFrame) -> DataFrame:
    """stratum, rules (array of rule, cutoff; best first), from labelled and scored documents.

    Documents are counted per stratum, rule, label and rung before they are brought together.
    """
    ladder = F.array(*[F.lit(cut) for cut in LADDER])
    rung = lambda rule: F.size(F.filter(ladder, lambda cut: F.col(rule) > cut))  # noqa: E731  rungs below the score
    each = F.array(*[F.struct(F.lit(rule).alias("rule"), rung(rule).alias("rung")) for rule in RULES])
    spread = tuning.select("stratum", "_quality", F.inline(each))
    sums = spread.groupBy("stratum", "_quality", "rule", "rung").agg(F.count(F.lit(1)).alias("n"))
    packed = sums.groupBy("stratum").agg(F.collect_list(F.struct("rule", "_quality", "rung", "n")).alias("counts"))

    def choose(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"stratum": [], "place": [], "rule": [], "cutoff": []}
        for row in part.to_pylist():
            gains: dict[str, list[int]] = {rule: [0] * len(LADDER) for rule in RULES}
            for count in row["counts"]:  # a score above `rung` cutoffs is above the last ones of the ladder
                for i in range(len(LADDER) - count["rung"], len(LADDER)):
                    gains[count["rule"]][i] += count["n"] if count["_quality"] == 0 else -count["n"]
            best = sorted((-max(g), rule, LADDER[g.index(max(g))]) for rule, g in gains.items() if max(g) > 0)
            for place, (_, rule, cut) in enumerate(best):
                for name, value in zip(out, (row["stratum"], place, rule, cut)):
                    out[name].append(value)
        return out

    return arrow_map(packed, choose, "stratum string, place int, rule string, cutoff int")


def certified(proposed: DataFrame, holdout: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The proposed rules that are in force (columns of `proposals`): per stratum those of the last certified candidate."""
    wide = _wide(proposed)
    good = holdout.filter("_quality = 1").join(wide, F.col("stratum").eqNullSafe(F.col("_stratum")))
    # A good document is lost from the candidate on that adds the first rule it fails.
    first = F.least(*[F.when(F.col(r) > F.col(f"_{r}"), F.col(f"_{r}_place")) for r in RULES], F.lit(len(RULES)))
    sums = good.groupBy("_stratum", first.alias("lost_from")).agg(F.count(F.lit(1)).alias("n"))
    packed = sums.groupBy("_stratum").agg(F.collect_list(F.struct("lost_from", "n")).alias("counts"))
    strata = proposed.select("stratum").distinct().agg(F.count(F.lit(1)).alias("n_strata"))  # one row

    def test(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {"stratum": [], "last": []}
        for row in part.to_pylist():
            n_good, last = sum(c["n"] for c in row["counts"]), -1
            for place in range(len(RULES)):
                lost = sum(c["n"] for c in row["counts"] if c["lost_from"] <= place)
                if binomial_cdf(lost, n_good, alpha) > delta / row["n_strata"]:
                    break
                last = place
            out["stratum"].append(row["_stratum"])
            out["last"].append(last)
        return out

    ends = arrow_map(packed.join(F.broadcast(strata)), test, "stratum string, last int").toDF("_stratum", "last")
    joined = proposed.join(ends, F.col("stratum").eqNullSafe(F.col("_stratum")))
    return joined.filter("place <= last").select("stratum", "place", "rule", "cutoff")


def _wide(rules: DataFrame) -> DataFrame:
    """One row per stratum: _stratum, and _<rule> (its cutoff) and _<rule>_place for each rule, null if it is off."""
    of = lambda rule, name: F.max(F.when(F.col("rule") == rule, F.col(name)))
    columns = [of(rule, "cutoff").alias(f"_{rule}") for rule in RULES]
    columns += [of(rule, "place").alias(f"_{rule}_place") for rule in RULES]
    return rules.groupBy(F.col("stratum").alias("_stratum")).agg(*columns)


def judged(
    docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA
) -> DataFrame:
    """doc_id, the counts, base_failed, kept and failed_rules, for each row of docs."""
    counted = counts(docs, stratum).withColumn("base_failed", base_failed())
    scored = checkpointed(counted.select("*", *[value.alias(rule) for rule, value in scores().items()]))
    labelled = checkpointed(_labelled(scored.filter(~F.col("base_failed")), labels))
    proposed = checkpointed(proposals(labelled.filter("tuning")))
    in_force = _wide(certified(proposed, labelled.filter("not tuning"), alpha, delta))
    joined = scored.join(in_force, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    failed = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"_{r}"), F.lit(r)) for r in RULES]))
    kept = ~F.col("base_failed") & (F.size("failed_rules") == 0)
    return joined.withColumn("failed_rules", failed).select(
        "doc_id", *_COUNTS[:5], "base_failed", kept.alias("kept"), "failed_rules"
    )
