"""Near duplicates, line deduplication and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stockline.llm import buckets, line_dedup, minhash_bayes, queries
from stockline.llm.components import components, joined_components


def union_find(nodes, edges) -> dict:
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        if a is None or b is None or a == b:
            continue
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)]
    edges += [(200, 200 + i) for i in range(20)] + [(5, 5)]
    frame = spark.createDataFrame(edges + edges[:5] + [(None, 3)], "a long, b long")
    nodes = lambda es: {n for a, b in es if a != b for n in (a, b)}
    expected = union_find(nodes(edges), edges)
    assert {r.node: r.component for r in components(frame).collect()} == expected
    first, rest = spark.createDataFrame(edges[:30], frame.schema), spark.createDataFrame(edges[30:], frame.schema)
    found = {r.node: r.component for r in joined_components(components(first), rest).collect()}
    assert {n: c for n, c in found.items() if n in expected} == expected
    assert components(frame.filter("false")).count() == 0


def jaccard(a, b) -> float:
    return len(a & b) / len(a | b)


def sets_with_a_common_part(seed: int) -> dict[int, set[int]]:
    """Some near copies of a few sets, and sets that are alike in a part too small for a link."""
    rng = random.Random(seed)
    fresh = lambda n: {rng.randrange(-(2**62), 2**62) for _ in range(n)}
    common, sets = fresh(30), {}
    bases = [fresh(rng.randrange(1, 40)) for _ in range(8)] + [common | fresh(k) for k in (2, 8, 14)]
    for node in range(120):
        base = rng.choice(bases) if node % 3 else common | fresh(rng.randrange(4, 40))
        sets[node] = {x for x in base if rng.random() < 0.93} | fresh(rng.randrange(3)) or fresh(1)
    return sets


@pytest.mark.parametrize("seed, rounds, left", [(1, 6, 0.9), (2, 1, 0.9), (3, 6, 0.0), (4, 2, 1e9), (5, 6, 0.9)])
def test_every_pair_of_a_bucket_is_settled(spark, seed, rounds, left):
    rng, sets = random.Random(seed), sets_with_a_common_part(seed)
    members = {(b, node) for b in range(8) for node in sets if rng.random() < 0.8}
    linked = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.75}
    pairs = {(a, b) for a, b in linked if any((k, a) in members and (k, b) in members for k in range(8))}
    known = spark.createDataFrame(sorted(linked), "a long, b long")
    frame = spark.createDataFrame(sorted(members), "bucket long, node long")
    held = spark.createDataFrame([(n, sorted(s)) for n, s in sets.items()], "node long, elements array<long>")
    found = buckets.component_per_node(
        buckets.shared_buckets(frame), lambda tried: tried.join(known, ["a", "b"]),
        held.select("node", F.size("elements").alias("size")), lambda nodes: nodes.join(held, "node"), 0.75, rounds, left,
    )
    expected = union_find({n for p in pairs for n in p}, pairs)
    assert expected == union_find({n for p in linked for n in p}, linked)  # as here nearly all pairs meet
    assert {r.node: r.component for r in found.collect()} == expected


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rare_pairs_hold_all_links_and_few_others(spark, seed):
    sets = sets_with_a_common_part(seed)
    linked = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.75}
    held = spark.createDataFrame([(n, n, sorted(s)) for n, s in sets.items()], "node long, component long, elements array<long>")
    found = {tuple(r) for r in buckets.rare_pairs(held, 0.75).collect()}
    assert linked <= found
    assert all(jaccard(sets[a], sets[b]) > 0.3 for a, b in found)
    assert buckets.rare_pairs(held.withColumn("component", F.lit(0).cast("long")), 0.75).count() == 0
    assert buckets.rare_pairs(held.filter("false"), 0.75).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_marks_lose_no_link_and_rule_out_sets_with_a_part_in_common(spark, seed):
    rng = random.Random(seed)
    fresh = lambda n: {rng.randrange(2**64) for _ in range(n)}
    common, sets = fresh(120), sets_with_a_common_part(seed)
    sets = {n: {x % 2**64 for x in s} for n, s in sets.items()} | {200 + i: common | fresh(180) for i in range(60)}
    base = fresh(300)
    sets |= {300 + i: set(list(base)[7 * i :]) | fresh(7 * i) for i in range(8)}
    marks = {n: buckets.parity_marks(np.array(sorted(s), dtype=np.uint64)) for n, s in sets.items()}
    rows = [(0, n, len(s), n) for n, s in sets.items()]
    active = spark.createDataFrame(rows, "bucket long, node long, size long, component long")
    held = spark.createDataFrame([(n, m.tolist()) for n, m in marks.items()], "node long, marks array<long>")
    near = lambda one, other: F.least(one, other) >= 0.75 * F.greatest(one, other)
    linked = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.75}
    found = {tuple(r) for r in buckets._pairs_across(active, near, 0.75, lambda nodes: held.join(nodes, "node")).collect()}
    plain = {tuple(r) for r in buckets._pairs_across(active, near, 0.75).collect()}
    assert linked <= found <= plain
    assert not any(200 <= a and b < 300 for a, b in found)
    assert len([1 for a, b in plain if 200 <= a and b < 300]) == 60 * 59 / 2


@pytest.mark.parametrize("seed", [1, 2])
def test_marked_rare_pairs_hold_all_links_and_hardly_others(spark, seed):
    rng = random.Random(seed)
    fresh = lambda n: {rng.randrange(-(2**63), 2**63) for _ in range(n)}
    pool, base = sorted(fresh(400)), fresh(300)
    sets = {i: set(rng.sample(pool, 240)) for i in range(60)}  # similarities of 0.43
    sets |= {100 + i: set(sorted(base)[7 * i :]) | fresh(7 * i) for i in range(8)}
    linked = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.75}
    held = spark.createDataFrame([(n, n, sorted(s)) for n, s in sets.items()], "node long, component long, elements array<long>")
    found = {tuple(r) for r in buckets.rare_pairs(held, 0.75, marked=True).collect()}
    plain = {tuple(r) for r in buckets.rare_pairs(held, 0.75).collect()}
    assert linked and linked <= found <= plain
    assert not any(b < 100 for _, b in found)
    assert sum(b < 100 for _, b in plain) > 1000
    assert buckets.rare_pairs(held.filter("false"), 0.75, marked=True).count() == 0


@pytest.mark.parametrize("held, nodes", [(4_000_000, 1 << 14), (50, 300)])
def test_packed_members_keep_the_shared_buckets(spark, documents, monkeypatch, held, nodes):
    monkeypatch.setattr(buckets, "HELD_MEMBERS", held)
    monkeypatch.setattr(buckets, "PACKED_NODES", nodes)
    monkeypatch.setattr(buckets, "SLICES", 16)
    rng = np.random.default_rng(held)
    keys = rng.integers(-(2**63), 2**63, 400)[rng.integers(0, 400, (900, 3))]
    rows = spark.createDataFrame([(n % 800, k.tolist()) for n, k in enumerate(keys)], "node long, bands array<long>")
    found = lambda part: (part.column(0).to_numpy(), np.array(part.column(1).to_pylist()))
    packed = rows.repartition(3).mapInArrow(buckets.packed_members(found), "slice int, entries binary")
    assert packed.agg(F.sum(F.length("entries"))).first()[0] == 12 * keys.size
    together: dict[int, set[int]] = {}
    for n, bands in enumerate(keys):
        for k in bands:
            together.setdefault(int(k), set()).add(n % 800)
    shared = {}
    for r in buckets.shared_packed(packed).collect():
        shared.setdefault(r.bucket, []).append(r.node)
    assert sorted(map(sorted, shared.values())) == sorted(sorted(x) for x in together.values() if len(x) > 1)
    banded = line_dedup.banded_lines(documents("one line that is long enough\nanother line of this text"))
    assert banded.agg(F.sum(F.length("entries"))).first()[0] == 12 * 2 * line_dedup.BANDS


def test_bands_that_bring_the_same_lines_together_are_one_bucket(documents):
    line = "a line of which there is a near copy, and which is long enough to share most of its bands"
    rows = buckets.shared_packed(line_dedup.banded_lines(documents(line, line + "!", "another line, alike to none of these")))
    nodes = sorted([line_dedup.line_key(line), line_dedup.line_key(line + "!")])
    assert sorted(r.node for r in rows.collect()) == nodes  # before: a bucket for each of the bands


def test_bits_of_nodes_lose_none_and_pass_few_others(spark, monkeypatch):
    rng = np.random.default_rng(5)
    nodes, others = rng.integers(-(2**63), 2**63, (2, 20_000))
    members = spark.createDataFrame([(n % 7, int(node)) for n, node in enumerate(nodes)], "bucket long, node long")
    words = buckets.node_bits(members)
    assert buckets.has_bits(words, nodes).all() and buckets.has_bits(words, others).mean() < 0.2
    monkeypatch.setattr(buckets, "BIT_WORDS", 1 << 4)
    assert buckets.has_bits(buckets.node_bits(members), nodes).all()
    assert not buckets.has_bits(buckets.node_bits(members.filter("false")), nodes).any()


@pytest.mark.parametrize("held", [1 << 16, 150])
def test_lines_are_compared_in_portions_as_by_sets(monkeypatch, held):
    monkeypatch.setattr(line_dedup, "HELD_CHARS", held)
    rng = random.Random(held)
    lines = ["".join(rng.choice("abcdeéж漢😀 ") for _ in range(rng.choice([14, 15, 40, 200]))) for _ in range(300)]
    lines += ["aaaaaaaaaaaaaaaaaaaa", "abababababababababab"]
    others = [edited(rng, line, rng.randrange(0, 4)) for line in lines]
    cut = lambda line: {line[i : i + 5] for i in range(len(line) - 4)}
    expected = [100 * len(cut(a) & cut(b)) >= 75 * len(cut(a) | cut(b)) for a, b in zip(lines, others)]
    assert line_dedup.linked(lines, others).tolist() == expected and 0 < sum(expected) < len(lines)
    for start, end in line_dedup.portions(lines):
        sizes, marks = line_dedup.sizes_and_marks(lines[start:end])
        assert sizes.tolist() == [len(cut(line)) for line in lines[start:end]]
        assert all(n >= int(np.bitwise_count(row.view(np.uint64)).sum()) for n, row in zip(sizes, marks))


def test_many_lines_with_a_passage_in_common_are_not_compared(documents, monkeypatch):
    rng, tried = random.Random(7), []
    fresh = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvw ") for _ in range(n))
    passage = fresh(250)
    lines = [fresh(100) + passage + fresh(100) for _ in range(120)]
    lines += [edited(rng, line, 2) for line in lines[:5]]
    verify = line_dedup.exactly_linked

    def counted(pairs, forms):
        tried.append(pairs.count())
        return verify(pairs, forms)

    monkeypatch.setattr(line_dedup, "exactly_linked", counted)
    monkeypatch.setattr(line_dedup, "TRIED_PER_MEMBER", 0)  # so that rare elements name the pairs
    found = line_dedup.repeated_lines(documents(*lines)).collect()
    assert sorted((r.doc_id, list(r.removed)) for r in found) == [(120 + i, [0]) for i in range(5)]
    assert tried[-1] < 120


def test_lines_with_a_passage_in_common_are_not_compared_one_by_one(documents, monkeypatch):
    rng, tried = random.Random(6), []
    fresh = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvw ") for _ in range(n))
    passage = fresh(250)
    lines = [fresh(100) + passage + fresh(100) for _ in range(60)]
    lines += [edited(rng, line, 2) for line in lines[:5]]
    verify = line_dedup.exactly_linked

    def counted(pairs, forms):
        tried.append(pairs.count())
        return verify(pairs, forms)

    monkeypatch.setattr(line_dedup, "exactly_linked", counted)
    monkeypatch.setattr(line_dedup, "TRIED_PER_MEMBER", 1000)
    found = line_dedup.repeated_lines(documents(*lines)).collect()
    assert sorted((r.doc_id, list(r.removed)) for r in found) == [(60 + i, [0]) for i in range(5)]
    assert tried[-1] < 60


def sentences(rng, n) -> list[str]:
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def near_texts(seed: int) -> list[str]:
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        base = sentences(rng, rng.randrange(5, 150))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = "Changed"
            texts.append("\n".join(copy) if rng.random() < 0.3 else " ".join(copy).upper())
    return texts + ["", " \n ", "a b", "A  B", "b a", "a b c d", texts[0], "É b c d e", "é b c d e"]


def brute_near(texts: list[str | None]) -> dict[int, tuple]:
    sets = []
    for text in texts:
        words = (text or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    edges = [
        (i, j) for i, a in enumerate(sets) for j, b in enumerate(sets)
        if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b)
    ]
    found = union_find(range(len(texts)), edges)
    return {i: (len(sets[i]), c, c == i) for i, c in found.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(documents, seed):
    texts = [*near_texts(seed), None]
    found = minhash_bayes.near_duplicates(documents(*texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute_near(texts)


def test_large_group_of_near_copies(documents):
    rng = random.Random(4)
    base = sentences(rng, 80)
    texts = [" ".join(f"c{i}" if j == i % 80 or j == i // 80 else w for j, w in enumerate(base)) for i in range(150)]
    found = minhash_bayes.near_duplicates(documents(*texts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute_near(texts)


def test_near_duplicates_of_odd_rows(documents, clashing):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(7, long), (3, long + " end"), (None, "a b c d e f"), (9, "a b c d e f"), (9, "a b c d e f"), (None, None)]
    found = minhash_bayes.near_duplicates(documents(*rows)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in found) == [
        (-1, -1, True), (-1, 9, False), (3, 3, True), (7, 3, False), (9, 9, True), (9, 9, True)
    ]
    assert minhash_bayes.near_duplicates(documents()).count() == 0
    assert minhash_bayes.near_duplicates(clashing).filter("kept").count() == 5


def test_pruning_bounds():
    looks = minhash_bayes.least_matches(0.75, 128, 16, 1e-6)
    assert [n for n, _ in looks] == list(range(16, 129, 16))
    rng = np.random.default_rng(0)  # at similarity 0.75 hardly any pair is pruned at any look, at 0.3 almost all are
    for similarity, low, high in ((0.75, 0, 0.001), (0.3, 0.95, 1)):
        agree = rng.random((20_000, 128)) < similarity
        lost = np.any([agree[:, :n].sum(axis=1) < m for n, m in looks], axis=0).mean()
        assert low <= lost <= high


def brute_lines(texts: list[str | None], min_chars: int) -> set[tuple[int, int]]:
    places: dict[str, list] = {}
    for i, text in enumerate(texts):
        for n, line in enumerate((text or "").split("\n")):
            form = " ".join(line.lower().split())
            if form:
                places.setdefault(form, []).append((i, n))
    forms = list(places)
    sets = [{f[i : i + 5] for i in range(len(f) - 4)} if len(f) >= min_chars else set() for f in forms]
    edges = [
        (i, j) for i, a in enumerate(sets) for j, b in enumerate(sets)
        if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b)
    ]
    groups: dict[int, list] = {}
    for i, c in union_find(range(len(forms)), edges).items():
        groups.setdefault(c, []).extend(places[forms[i]])
    return {place for group in groups.values() for place in sorted(group)[1:]}


def test_fuzzy_lines(spark, documents):
    rng = random.Random(8)
    lines = ["".join(rng.choice("abcdefgh  ") for _ in range(rng.randrange(30, 300))).strip() for _ in range(25)]
    for line in lines[:15]:
        for _ in range(3):
            at = rng.randrange(len(line))
            lines.append(line[:at] + rng.choice("xyz  ") + line[at + 1 :])
    # One or two edits more: linked by 5-character shingles, by 10-character ones not.
    lines += [edited(rng, line, 1 + (len(line) > 120)) for line in lines[:25] if len(line) > 45]
    lines += ["short", "short", "shorT", "no", lines[0].upper(), "\t" + lines[1] + "  "]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 6))) for _ in range(40)] + [None, "", "\n\n"]
    docs = documents(*texts)
    gone = {(r.doc_id, i) for r in line_dedup.repeated_lines(docs).collect() for i in r.removed}
    assert gone == brute_lines(texts, line_dedup.MIN_CHARS)
    assert gone == {(r.doc_id, i) for r in line_dedup.repeated_lines(docs.repartition(7)).collect() for i in r.removed}
    by_shuffle = line_dedup.without_repeated_lines(docs, broadcast_lines=0).collect()
    for r in [*line_dedup.without_repeated_lines(docs).collect(), *by_shuffle]:
        text = texts[r.doc_id]
        if text is None:
            assert (r.text, r.n_lines, r.n_removed) == (None, 0, 0)
            continue
        rest = [x for i, x in enumerate(text.split("\n")) if (r.doc_id, i) not in gone]
        assert (r.text, r.n_lines, r.n_removed) == ("\n".join(rest), len(text.split("\n")), len(text.split("\n")) - len(rest))


def test_lines_of_odd_rows(documents, clashing):
    line = "a line that is long enough to be compared with others"
    rows = [(5, line), (5, line), (None, line), (6, f"{line}\n{line}"), (7, "x" * 200_000 + "\n" + "y " * 60_000)]
    found = line_dedup.without_repeated_lines(documents(*rows)).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in found) == [(-1, 0), (5, 0), (5, 0), (6, 2), (7, 0)]
    assert line_dedup.without_repeated_lines(documents()).count() == 0
    result = line_dedup.without_repeated_lines(clashing)
    assert result.count() == 6 and dict(result.dtypes)["n_removed"] == "bigint"
    assert result.select(F.sum("n_removed")).first()[0] == 1  # two of its texts are equal lines


def test_short_lines_and_near_copies_of_short_lines(spark, documents, tmp_path):
    notice, near = "All rights reserved.", "All rights reserved!"
    texts = [f"{notice}\nand\nfirst\n1", f"all  rights RESERVED.\nand\n{near}\nAn", f"{notice}\n\n{notice}\n \nsecond\n1", None]
    documents(*texts).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.text for r in queries.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert found == {0: texts[0], 1: "An", 2: "\n \nsecond", 3: None}  # blank lines stay
    stage = corpus_pipeline.distinct_lines(spark, documents(*texts), "").collect()
    assert {r.doc_id: r.text for r in stage} == found


def edited(rng, line: str, edits: int) -> str:
    for _ in range(edits):
        at = rng.randrange(5, len(line) - 5)
        line = line[:at] + rng.choice("xyz") + line[at + rng.randrange(2) :]
    return line


def test_lines_with_one_or_two_edits(documents):
    rng = random.Random(21)
    fresh = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvw ") for _ in range(n)).strip().ljust(n, "q")
    lines = [(line, edited(rng, line, 1 + (n >= 80))) for n in range(50, 151, 4) for line in [fresh(n)]]
    shingles = lambda line: {form[i : i + 5] for form in [" ".join(line.split())] for i in range(len(form) - 4)}
    linked = [jaccard(shingles(a), shingles(b)) >= 0.75 for a, b in lines]
    assert all(linked)
    found = line_dedup.repeated_lines(documents("\n".join(a for a, _ in lines), "\n".join(b for _, b in lines))).collect()
    assert [(r.doc_id, list(r.removed)) for r in found] == [(1, list(range(len(lines))))]


def test_bands_lose_hardly_any_link():
    rng, pairs = random.Random(5), []
    while len(pairs) < 4000:
        line = "".join(rng.choice("abcdefghijklmnopqrstuvw ") for _ in range(80))
        copy = edited(rng, line, 2)
        sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in (line, copy)]
        if 0.75 <= jaccard(*sets) < 0.78:
            pairs.append((line, copy))
    turns = line_dedup.permutations(line_dedup.BANDS * line_dedup.ROWS, line_dedup._SEED)
    left, right = (
        line_dedup.band_keys(line_dedup.signatures(list(lines), *turns), line_dedup.ROWS) for lines in zip(*pairs)
    )
    assert (~(left == right).any(axis=1)).sum() <= 2


def test_pairs_of_small_buckets_are_all_tried_however_many(spark, documents, monkeypatch):
    """Open pairs grow with the square of the lines: none of the buckets they are in may go on to rare elements for their sum."""
    rng, named = random.Random(9), []
    fresh = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvw ") for _ in range(n))
    passages = [fresh(250) for _ in range(3)]
    lines = [fresh(100) + passages[i % 3] + fresh(100) for i in range(210)]
    lines += [edited(rng, line, 2) for line in lines[:5]]
    rare = buckets.rare_pairs
    monkeypatch.setattr(buckets, "rare_pairs", lambda *a: named.append(a) or rare(*a))
    found = line_dedup.repeated_lines(documents(*lines)).collect()
    assert sorted((r.doc_id, list(r.removed)) for r in found) == [(210 + i, [0]) for i in range(5)] and not named
    monkeypatch.setattr(line_dedup, "TRIED_PER_MEMBER", 20)  # buckets of up to 41 rows are tried, the others go on
    again = line_dedup.repeated_lines(documents(*lines)).collect()
    assert sorted((r.doc_id, list(r.removed)) for r in again) == [(210 + i, [0]) for i in range(5)] and named


@pytest.mark.parametrize("seed, tried", [(1, 0), (2, 20), (3, 45), (4, 1000)])
def test_every_pair_of_a_bucket_is_settled_with_marks(spark, seed, tried):
    rng, sets = random.Random(seed), sets_with_a_common_part(seed)
    members = [(b, n) for b in range(8) for n in sets if rng.random() < (0.8 if b < 4 else 0.3)]
    marks = {n: buckets.parity_marks(np.array(sorted(x % 2**64 for x in s), dtype=np.uint64)).tolist() for n, s in sets.items()}
    linked = {(a, b) for a in sets for b in sets if a < b and jaccard(sets[a], sets[b]) >= 0.75}
    known = spark.createDataFrame(sorted(linked), "a long, b long")
    frame = spark.createDataFrame(members, "bucket long, node long")
    held = spark.createDataFrame(
        [(n, sorted(s), marks[n]) for n, s in sets.items()], "node long, elements array<long>, marks array<long>"
    )
    found = buckets.component_per_node(
        buckets.shared_buckets(frame), lambda pairs: pairs.join(known, ["a", "b"]),
        held.select("node", F.size("elements").alias("size")),
        lambda nodes: nodes.join(held.select("node", "elements"), "node").select("node", "component", "elements"), 0.75,
        tried_per_member=tried,
        marks_of=lambda nodes: held.select("node", "marks") if nodes is None else held.select("node", "marks").join(nodes, "node"),
    )
    pairs = {(a, b) for a, b in linked if any((k, a) in set(members) and (k, b) in set(members) for k in range(8))}
    assert {r.node: r.component for r in found.collect()} == union_find({n for p in pairs for n in p}, pairs)


def test_a_pair_is_named_by_one_of_its_buckets(spark, monkeypatch):
    """The first that both are in, also where each is in others: the join makes a row for each pair."""
    sets = {n: set(range(100)) | {1000 + n} for n in range(6)}
    marks = {n: buckets.parity_marks(np.array(sorted(s), dtype=np.uint64)).tolist() for n, s in sets.items()}
    members = [(b, n) for b in range(9) for n in sets if (b + n) % 3 or b == 7]
    active = spark.createDataFrame([(b, n, 101, n) for b, n in members], "bucket long, node long, size long, component long")
    held = spark.createDataFrame(list(marks.items()), "node long, marks array<long>")
    near = lambda one, other: F.least(one, other) >= 0.75 * F.greatest(one, other)
    made = []
    monkeypatch.setattr(buckets, "few", lambda df, ratio=16: made.append(df) or df)
    found = buckets._pairs_across(active, near, 0.75, lambda nodes: held.join(nodes, "node"))
    expected = [(a, b) for a in sets for b in sets if a < b]
    assert sorted(map(tuple, found.collect())) == expected
    assert made[-1].columns == ["a", "b"] and made[-1].count() == len(expected)
