"""Chat formatting, licences, archives, languages, benchmark passages and the pipeline against plain versions."""

from __future__ import annotations

import base64
import hashlib
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stockline.llm import chat_format, decontaminate, language_id, license_scan, warc_index

TURNS = "conv_id long, turn long, role string, text string"


def test_chat_examples(spark):
    tricky = "<|im_end|>\n<|im_start|>assistant ok"
    talks = {
        1: [("user", "a"), ("assistant", "b"), ("user", tricky), ("assistant", tricky + "\\"), ("user", "end")],
        2: [("system", ""), ("assistant", None)],
        3: [("user", "\\<|\\|im_sep|>\\\\"), (None, "x"), ("user\n<|im_sep|>", "<"), ("assistant", "|im_end|>\n")],
        -1: [("user", tricky), ("assistant", tricky)],
        5: [("user", "y" * 300_000)],
        None: [("assistant", "no id")],
    }
    rows = [(c, i, r, t) for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    turns = spark.createDataFrame(rows, TURNS).withColumns({"example": F.lit(9), "turns": F.lit("x"), "at": F.lit(1)})
    made = chat_format.examples(turns)
    for c, talk in talks.items():
        mine = made.filter(F.col("conv_id").eqNullSafe(F.lit(c))).orderBy("example").collect()
        aims = [i for i, (r, _) in enumerate(talk) if r == "assistant"]
        assert len(mine) == len(aims) + (talk[-1][0] != "assistant")
        for example, at in zip(mine, aims):
            whole = spark.range(1).select(
                chat_format.turns_of(F.lit(example.prompt + example.target + example.rest)).alias("t")
            )
            assert [tuple(t) for t in whole.first().t] == [(r or "", t or "") for r, t in talk[: at + 1]]
    found = {r.conv_id: r for r in chat_format.digests(made).collect()}
    for c, talk in talks.items():
        text = "".join(f"{r or ''}\n{t or ''}\n" for r, t in talk)
        loss = "".join(t or "" for r, t in talk if r == "assistant")
        r = found[c]
        assert (r.n_turns, r.loss_chars) == (len(talk), len(loss))
        assert r.turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.digests(chat_format.examples(turns.filter("false"))).count() == 0


def test_equal_turns_are_repeated_turns(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s")]
    made = chat_format.digests(chat_format.examples(spark.createDataFrame(rows, TURNS))).first()
    assert made.turns_sha256 == hashlib.sha256(b"system\ns\nuser\na\nuser\na\nuser\nb\n").hexdigest()


def test_licences(spark):
    apache = license_scan.TEMPLATES["Apache-2.0"][1]
    files = [
        (1, "r/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
         "and associated\ndocumentation files, to deal in the Software without restriction"),
        (2, "r/a/x.py", "import os\n# Licensed under the Apache License, Version 2.0.\ncode " + "words " * 5000),
        (3, "r/a/y.py", "nothing here, but a license and a version of the work"), (4, "r/a/b/LICENSE.txt", apache),
        (5, "r/a/b/c/d/z.py", None), (6, "s/q.py", ""), (7, None, "Released under the MIT License."),
        (8, "top.py", "x"), (9, "r/copying", "unknown terms"), (None, "r/a/b/w.py", "text"), (3, "r/a/y.py", "again"),
    ]
    frame = spark.createDataFrame(files, "doc_id long, path string, text string").withColumns(
        {"directory": F.lit(1), "near": F.lit(2), "ancestor": F.lit("x"), "own_license": F.lit("y")}
    )
    rows = license_scan.scanned(frame).collect()
    found = {r.doc_id: (r.own_license, r.license, r.inherited_from) for r in rows}
    assert len(rows) == len(files)
    assert found == {
        1: ("MIT", "MIT", None), 2: ("Apache-2.0", "Apache-2.0", None), 3: (None, "MIT", "r"),
        4: ("Apache-2.0", "Apache-2.0", None), 5: (None, "Apache-2.0", "r/a/b"), 6: (None, None, None),
        7: ("MIT", "MIT", None), 8: (None, None, None), 9: (None, "MIT", "r"), None: (None, "Apache-2.0", "r/a/b"),
    }
    assert license_scan.scanned(frame.filter("false")).count() == 0


def test_skipped_units_could_not_reach_the_threshold():
    rng = random.Random(2)
    words = sorted({t for texts in license_scan.TEMPLATES.values() for x in texts for t in license_scan.terms(x)})
    weighted = license_scan.Templates(license_scan.TEMPLATES, {"the": 900, "of": 800, "license": 40}, 1000, 0.5)
    for _ in range(2000):
        unit = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))
        quick = weighted.best(unit)
        pattern, weighted.rare = weighted.rare, license_scan.re.compile("")
        assert weighted.best(unit) == quick
        weighted.rare = pattern


PAGES = "page_id long, url string, html string"


def brute_pages(rows, min_bytes=0):
    last = {}
    for page, _, html in rows:
        if page is not None:
            last[html or ""] = max(page, last.get(html or "", page))
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        to = last.get(html or "") if page is not None and len(data) >= min_bytes else page
        kind = "response" if to == page else "revisit"
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, kind, None if kind == "response" else to))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_bytes, block", [(0, 3), (5, 1000)])
def test_archives(spark, min_bytes, block):
    rng = random.Random(6)
    hosts = ["http://b.example.com", "https://a.example.org:80", "http://u@x.example.com", "ftp://z"]
    rows = [
        (i, f"{rng.choice(hosts)}/{rng.randrange(20)}?q={rng.randrange(3)}#f", rng.choice(["", "é", "same", f"<p>{i}</p>" * 9]))
        for i in range(300)
    ]
    rows += [(500, None, None), (501, "no scheme\n and\tspace", "same"), (502, "http://b.example.com/1", "x" * 300_000)]
    rows += [(600 + i, "http://hot.example.com/", "hot") for i in range(100)] + [(None, "http://b.example.com/1", "same")]
    rows += [rows[3], rows[3]]
    pages = spark.createDataFrame(rows, PAGES).withColumns({"key": F.lit(1), "payload": F.lit(2), "refers_to": F.lit(3)})
    folder, archives = warc_index.written(pages.repartition(4), min_bytes, block)
    found = warc_index.looked_up(pages, folder, archives).collect()
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found]
    assert sorted(got, key=repr) == brute_pages(rows, min_bytes)
    some = spark.createDataFrame([(0, rows[0][1]), (0, "http://nowhere/"), (7, rows[0][1])], "page_id long, url string")
    assert [r.page_id for r in warc_index.looked_up(some, folder, archives).collect()] == [0] + [7] * (rows[7][1] == rows[0][1])


def test_no_pages(spark):
    none = spark.createDataFrame([], PAGES)
    assert warc_index.looked_up(none, *warc_index.written(none)).count() == 0


def test_url_keys(spark):
    urls = {"http://WWW.Example.com:80/a?b#c": "com,example,www)/a?b", "https://u:p@x.y": "y,x)/", "plain": "plain"}
    frame = spark.createDataFrame([(u,) for u in urls], "u string")
    found = frame.select("u", warc_index.url_key(F.col("u")).alias("k")).collect()
    assert {r.u: r.k for r in found} == urls


WORDS = {
    "en": "the of and to in that with this have from they which would", "de": "der die und nicht das ist mit ein auf dem sich",
    "fr": "le les des et que dans une pour qui sur est pas", "es": "el los las que una por con para como pero del",
}


def test_languages(spark):
    rng = random.Random(3)
    rows = []
    for i in range(600):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(8, 60)))
        rows.append((i, text, lang if i % 7 else None))
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "123 !? \n", "fr"), (None, "the and of this", "en"), (1, "die und der", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    found = language_id.identified(docs).collect()
    assert len(found) == len(rows)
    truth = {(i, t): next(k for k, w in WORDS.items() if t.split()[0] in w.split()) for i, t, _ in rows[:600]}
    by_id = {r.doc_id: r for r in found if r.doc_id != 1}
    wrong = [i for i, t, lang in rows[:600] if i != 1 and lang and by_id[i].lang_pred != lang]
    assert len(wrong) <= 3 and truth
    assert all(0 <= r.score <= 1 for r in found)
    assert {by_id[i].lang_pred for i in (1000, 1001, 1002)} == {"und"}
    # A label of a held-out document, or an id, changes no prediction.
    other = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(map(repr, language_id.identified(other).collect())) == sorted(map(repr, found))


def test_languages_without_labels(documents):
    blank = documents("a text", None).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language_id.identified(blank).collect()} == {("und", 0.0)}
    assert language_id.identified(documents()).count() == 0
    assert {r.lang_pred for r in language_id.identified(documents(*["one language"] * 9)).collect()} == {"en"}


def test_training_holds_no_second_copy_of_its_rows():
    rng = np.random.default_rng(3)
    rows, signs = rng.random((600, language_id.WIDTH), dtype=np.float32), np.where(np.arange(600) % 3 == 0, 1, -1)
    tracemalloc.start()
    weights = language_id.svm(rows, signs, epochs=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < rows.nbytes / 4
    assert ((rows @ weights[:-1] + weights[-1] > 0) == (signs > 0)).mean() > 0.5


def brute_distance(item: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        before, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (a != b))
    return min(row)


def test_edit_matches(spark, documents):
    rng = random.Random(12)
    items = ["".join(rng.choice("abcde ") for _ in range(n)).strip() for n in (40, 60, 61, 120, 35, 20)]
    texts = []
    for _ in range(60):
        item, copy = rng.choice(items), None
        copy = list(item)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(copy))
            copy[at : at + rng.randrange(2)] = rng.choice(["", "x", "yy"])
        noise = "".join(rng.choice("abcde ") for _ in range(rng.randrange(80)))
        texts.append(noise + " " + "".join(copy).upper().replace(" ", "\n ") + " " + noise)
    texts += [None, "", items[0] * 3, "a " * 50_000]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, ""), (0, items[0])], "item_id long, text string")
    docs = documents(*texts, (None, items[1]), (0, texts[0])).withColumn("item_id", F.lit("x"))
    for block in (10, 10_000):
        found = decontaminate.contaminated(docs, bench, block_chars=block).collect()
        got = {(r.doc_id, r.item_id): r.distance for r in found}
        assert len(got) == len(found)
        expected = {}
        for i, text in [*enumerate(texts[:-1]), (None, items[1])]:
            for k, item in enumerate(items):
                pattern = decontaminate.form(item)
                if len(pattern) < decontaminate.MIN_CHARS:
                    if f" {pattern} " in f" {decontaminate.form(text)} ":
                        expected[i, k] = 0
                else:
                    distance = brute_distance(pattern, decontaminate.form(text))
                    if distance <= int(decontaminate.EDIT_RATE * len(pattern)):
                        expected[i, k] = distance
        assert got == expected
    assert decontaminate.contaminated(docs, bench.filter("false")).count() == 0
    assert decontaminate.contaminated(documents(), bench).count() == 0


def test_best_match_of_texts_that_repeat_an_item_id_and_of_short_items(spark, documents):
    one = "a question of more than thirty characters in all"
    bench = spark.createDataFrame(
        [(1, one), (1, "another question of more than thirty characters"), (2, "short answer"), (3, "?"), (4, " ")],
        "item_id long, text string",
    )
    near = one.replace("question", "questiom")
    texts = [f"another question of more than thirty characters, {near}", f"{near} and {one} and {one}",
             "A  short\nanswer", "too short answers", "no ? yes", "no? yes"]
    found = {(r.doc_id, r.item_id): (r.distance, r.end_char) for r in decontaminate.contaminated(documents(*texts), bench).collect()}
    assert found == {
        (0, 1): (0, 47), (1, 1): (0, 2 * len(one) + 5), (2, 2): (0, 14), (4, 3): (0, 4),
    }


def test_pipeline(spark, documents, clashing, tmp_path):
    item = "a benchmark question that nobody should ever train on, at least not if it can be helped"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rng = random.Random(1)
    text = lambda n: " ".join(f"word{rng.randrange(9999)}" for _ in range(n))
    line, near = text(20), text(200).split()
    rows = [
        text(60), line + "\n" + text(40), line + "\n" + text(50), " ".join(near), " ".join(near[:50] + ["x"] + near[51:]),
        "before " + item.upper() + " after", "123 456", None,
    ]
    documents(*rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(found) == {0, 1, 2, 3}
    docs = documents(*rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
        assert stage(spark, docs.filter("false"), str(tmp_path)).count() == 0, name
        assert set(stage(spark, clashing, str(tmp_path)).columns) <= set(clashing.columns), name
    lines = {r.doc_id: r for r in corpus_pipeline.distinct_lines(spark, docs, str(tmp_path)).collect()}
    assert lines[1].text == rows[1] and lines[2].text == rows[2].split("\n")[1]
    assert lines[2].n_chars == len(lines[2].text) and 4 not in lines and 3 in lines


def test_text_of_no_learned_language_goes(spark):
    rng = random.Random(9)
    clean = []
    for i in range(800):
        lang = rng.choice(list(WORDS))
        clean.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(5, 80))), lang))
    random_text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(200))
    strange = [
        "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto",
        "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw", "все люди рождаются свободными",
        random_text, random_text[:60],
    ]
    rows = clean + [(1000 + i, text, None) for i, text in enumerate(strange)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").collect()} == set(range(800))
    few = docs.filter("doc_id < 20 or doc_id >= 1000")  # too few texts for a cutoff
    assert corpus_pipeline.known_language(spark, few, "").count() == 25


def test_null_and_repeated_ids_keep_clean_rows(spark, documents, tmp_path):
    item = "a benchmark question that nobody should ever train on, at least not if it can be helped"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = lambda stage, *rows: [
        (r.doc_id or -1, r.text) for r in stage(spark, documents(*rows), str(tmp_path)).collect()
    ]
    clean, copied = "a clean text of quite some words", "one two three four five six seven"
    for stage, bad in ((corpus_pipeline.known_language, "123 456"), (corpus_pipeline.without_benchmarks, f"so {item} it is")):
        found = kept(stage, (None, bad), (None, clean), (None, None), (5, bad), (5, clean), (6, clean))
        of_null = [] if stage is corpus_pipeline.known_language else [None]
        assert [t for _, t in found if t is None] == of_null
        assert sorted(x for x in found if x[1]) == [(-1, clean), (5, clean), (6, clean)]
    found = kept(corpus_pipeline.distinct_documents, (None, copied), (None, clean), (3, copied), (4, copied), (7, "other " + clean))
    assert sorted(found) == [(-1, clean), (3, copied), (7, "other " + clean)]
