"""The pipeline's stages against plain versions, on one small corpus."""

import os
import random
from array import array
from zlib import crc32

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from groupwise.llm.tokens import default_vocabulary
from tests.llm import brute

WORDS = {"en": "the and of with house water garden morning river stone letter window bread".split(), "de": "der und von mit haus wasser garten morgen fluss stein brief fenster brot".split()}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(4)
    say = lambda lang, n: " ".join(r.choices(WORDS[lang], k=n))
    rows, passage = [], say("en", 60)
    for i in range(160):
        lang = "en" if i % 3 else "de"
        text = say(lang, r.randint(20, 80))
        if i % 10 == 5:
            text = f"{text} {passage} {say('en', 5)}"
        if i % 8 == 7:
            w = rows[-2][1].split() if rows[-2][1] else ["x"]
            w[len(w) // 2] = "changed"
            text = " ".join(w) if i % 16 == 7 else rows[-2][1]
        rows.append((i, text, lang, "s", len(text or "")))
    rows += [(200, None, "en", "s", None), (201, "", "en", "s", 0), (202, "12345 !!", "en", "s", 8), (203, rows[3][1], None, None, None)]
    return rows


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(rows in, rows out) of each stage."""
    folder = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(folder))
        made.write.parquet(f"{folder}/{k}")
        after = spark.read.parquet(f"{folder}/{k}")
        out.append((sorted(map(tuple, docs.collect()), key=str), sorted(map(tuple, after.collect()), key=str), docs.columns, after.columns))
        docs = after
    return str(folder), out


def test_columns(stages):
    for _, _, before, after in stages[1][:-1]:
        assert before == after == corpus_pipeline.COLUMNS


def test_language_stage_keeps_all_text_with_a_language(stages):
    before, after, *_ = stages[1][0]
    assert after == [r for r in before if r[1] and any(map(str.isalpha, r[1]))]


def test_language_stage_keeps_short_and_mixed_texts(spark):
    r = random.Random(6)
    fr = "le et de avec maison eau jardin matin riviere pierre lettre fenetre pain".split()
    say = lambda lang, n: " ".join(r.choices(fr if lang == "fr" else WORDS[lang], k=n))
    rows = [(i, say(lang := ("en", "de", "fr")[i % 3], 60), lang, "s", 1) for i in range(300)]
    rows += [(1000 + i, " ".join(say(x, n) for x in ("en", "de", "fr")), "en", "s", 1) for i, n in enumerate([15, 30, 60] * 4)]
    rows += [(2000 + i, say("en", 1 + i), "en", "s", 1) for i in range(10)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, corpus_pipeline.language_id(spark, docs, "").collect())) == sorted(rows)


def test_join_stage_keeps_the_smallest_of_each_group(stages):
    before, after, *_ = stages[1][1]
    classes = brute.jaccard_classes([(r[0], r[1]) for r in before], 5, 4, 5)
    kept = {i for i, _, c in classes if i == c}
    assert {r[0] for r in after} == kept and len(kept) < len(before)


def test_join_stage_judges_rows_where_ids_repeat_or_are_null(spark):
    r = random.Random(8)
    a, b, c, d, e = (" ".join(r.choices([f"w{k}" for k in range(500)], k=40)) for _ in range(5))
    near = f"{a} end"
    rows = [(0, a), (1, near), (1, b), (2, c), (2, c), (None, d), (None, d), (None, a), (None, e), (3, e), (4, near), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA).repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.ngram_join(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(0, a), (1, b), (2, c), (3, e), (None, d), (None, None), (None, None)], key=str)


def test_passage_stage_removes_what_an_earlier_document_has(stages):
    before, after, *_ = stages[1][2]
    removed = {d: n for d, _, n, *_ in brute.removed_bytes([(r[0], r[1]) for r in before])}
    assert sum(removed.values()) > 500
    texts = {r[0]: r for r in after}
    assert all(len(texts[r[0]][1].encode()) == len(r[1].encode()) - removed[r[0]] == texts[r[0]][4] for r in before)


def test_packing_stage_holds_every_token_once(stages):
    before, after, *_ = stages[1][3]
    library = Tokenizer.from_file(default_vocabulary())
    pieces = {}
    for doc_id, start, length, crc, *_ in after:
        pieces.setdefault(doc_id, []).append((start, length, crc))
    assert pieces.keys() == {r[0] for r in before}
    for r in before:
        ids, at = [*library.encode(r[1], add_special_tokens=False).ids, 1], 0
        for start, length, crc in sorted(pieces[r[0]]):
            assert start == at and crc == crc32(array("I", ids[start : start + length]).tobytes())
            at += length
        assert at == len(ids)


def test_run_gives_the_last_stage(spark, stages):
    folder, out = stages
    found = corpus_pipeline.run(spark, folder)
    assert sorted((r[0], r[1], r[2], r[3]) for r in found.collect()) == sorted(r[:4] for r in out[-1][1])


CLASH = ["key", "row", "text_hash", "digest", "lang_pred", "score", "__text", "sig", "component", "spans", "none", "c0", "shingles", "uid"]


def test_repeated_rows_and_extra_columns_in_all_stages(spark):
    """Rows that repeat, null ids and texts, and columns with the names that operators use inside."""
    r = random.Random(9)
    say = lambda lang, n: " ".join(r.choices(WORDS[lang], k=n))
    passage = say("en", 30)
    rows = [(i, say(("en", "de")[i % 2], 40), ("en", "de")[i % 2], "s", 1) for i in range(80)]
    rows += [rows[3], rows[3], (None, rows[4][1], "en", None, None), (None, None, None, None, None), (90, None, "en", "s", 0), (90, "", "en", "s", 0), (91, "123", None, "s", 3)]
    rows += [(92, f"{say('en', 30)} {passage}", "en", "s", 1), (93, f"{passage} {say('en', 30)}", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", *[f"{k} as `{c}`" for k, c in enumerate(CLASH)]).repartition(3)
    more = tuple(range(len(CLASH)))
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, "")
        assert out.columns == docs.columns, name
        assert {tuple(x)[5:] for x in out.collect()} == {more}, name
        if stage is corpus_pipeline.language_id:
            assert sorted(str(tuple(x)[:5]) for x in out.collect()) == sorted(str(x) for x in rows if x[1] and any(map(str.isalpha, x[1])))
    left = {}
    for x in out.collect():
        left.setdefault(x["doc_id"], []).append(x["text"])
    assert all(len(v) == 1 for v in left.values()) and None not in left and set(left) == {*range(80), 92, 93}
    assert left[92][0].endswith(passage) and passage not in left[93][0]
    pieces = corpus_pipeline.pack(spark, out, "").collect()
    assert {x["doc_id"] for x in pieces} == set(left)


def test_tables_of_the_stages_are_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("groupwise.llm.common.shared_dir", lambda spark: f"file://{tmp_path}/scratch")
    spark.createDataFrame(corpus(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    left = os.listdir(f"{tmp_path}/scratch/groupwise")
    assert found.count() > 100 and len(left) == 1 and left[0].startswith("stage3"), left
    assert os.path.exists(f"{tmp_path}/documents.parquet/_SUCCESS")


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
