import hashlib
import os
import random
from array import array
from zlib import crc32

import pytest
from tokenizers import Tokenizer

from groupwise.llm import bpe, packing, token_output
from groupwise.llm.common import fresh_path
from groupwise.llm.tokens import default_vocabulary, encoder
from tests.llm.fixtures import TEXTS, documents, empty


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library(library):
    e = encoder(default_vocabulary())
    for t in TEXTS.values():
        assert e.encode(t) == array("I", ids_of(library, t)).tobytes()


def test_codec_equals_the_library(library):
    c = bpe.codec(default_vocabulary())
    for t in [*TEXTS.values(), "aaaaaaaaaaaaaaaa", "don't  'll\n \n x"]:
        ids = ids_of(library, t)
        assert c.encode(t) == ids
        assert c.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_digests(spark, library):
    docs = documents(spark)
    found = bpe.digests(docs, default_vocabulary()).collect()
    assert len(found) == docs.count()
    for r in found:
        if r["doc_id"] is not None:
            ids = ids_of(library, TEXTS[r["doc_id"]])
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256((TEXTS[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe.digests(empty(docs), default_vocabulary()).count() == 0


def test_encode_then_decode(spark):
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(documents(spark), default_vocabulary()), default_vocabulary()).collect()}
    assert all(back[i] == (t or "") for i, t in TEXTS.items())


def test_token_files(spark, library):
    docs = documents(spark)
    folder = fresh_path(spark, "t")
    manifest = token_output.write(docs, folder, default_vocabulary(), end_id=2, length=64)
    rows = sorted(token_output.read_digests(manifest, folder).collect(), key=lambda r: r["start"])
    assert len(rows) == docs.count()
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
        if r["doc_id"] is not None:
            ids = [*ids_of(library, TEXTS[r["doc_id"]]), 2]
            assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), crc32(array("I", ids).tobytes()))
    order = [r["doc_id"] for r in rows]
    assert order[0] is None and order[1:] == sorted(order[1:])
    part = manifest.first()
    reader, _ = token_output.open_part(folder, part["name"])
    ids, mask = token_output.sequence(reader, 0)
    assert len(ids) == len(mask) == 64
    folder = fresh_path(spark, "t")
    manifest = token_output.write(empty(docs), folder, default_vocabulary())
    assert token_output.read_digests(manifest, folder).count() == 0


def test_packing(spark, library):
    docs = documents(spark)
    rows = packing.pack(docs, default_vocabulary(), end_id=1, capacity=256).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert len(by_doc) == len(TEXTS) + 1
    for i, t in TEXTS.items():
        ids, at = [*ids_of(library, t), 1], 0
        for r in sorted(by_doc[i], key=lambda r: r["start"])[:: 2 if i == 5 else 1]:
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == crc32(array("I", ids[r["start"] : at]).tobytes())
        assert at == len(ids)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert packing.pack(empty(docs), default_vocabulary()).count() == 0


def plain_best_fit(lengths, capacity):
    """Longest first, earlier ones of equal length first; the fullest sequence with room, of equals the one filled last."""
    rooms, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [(room, -when, s) for s, (room, when) in enumerate(rooms) if room >= lengths[i]]
        if fits:
            s = min(fits)[2]
        else:
            s = len(rooms)
            rooms.append((capacity, 0))
        out[i] = (s, capacity - rooms[s][0])
        rooms[s] = (rooms[s][0] - lengths[i], i_placed := sum(o is not None for o in out))
    return [o[0] for o in out], [o[1] for o in out], len(rooms)


def test_best_fit_decreasing_against_a_plain_search():
    r = random.Random(3)
    for _ in range(200):
        capacity = r.choice([1, 7, 10, 64, 100])
        lengths = [r.randint(1, capacity) for _ in range(r.randint(0, 60))]
        assert packing.best_fit_decreasing(lengths, capacity) == plain_best_fit(lengths, capacity)
    assert packing.best_fit_decreasing([6, 5, 4, 5, 10, 1], 10)[2] == 4


@pytest.mark.parametrize("partitions", [1, 8, 200])
def test_padding_does_not_depend_on_partitions(spark, monkeypatch, partitions):
    monkeypatch.setattr(packing, "GROUP", 300)
    r = random.Random(1)
    docs = spark.createDataFrame([(i, "word " * r.choice([r.randint(1, 60), r.randint(60, 400)])) for i in range(1200)], "doc_id long, text string")
    rows = packing.pack(docs.repartition(partitions), default_vocabulary(), capacity=256).collect()
    used = {}
    for row in rows:
        used[row["sequence_id"]] = used.get(row["sequence_id"], 0) + row["length"]
    assert len({row["doc_id"] for row in rows}) == 1200 and max(used.values()) <= 256
    assert 1 - sum(used.values()) / (256 * len(used)) < 0.02


def test_token_files_leave_other_files_alone(spark, tmp_path):
    docs, vocabulary = documents(spark), default_vocabulary()
    folder = f"{tmp_path}/tokens"
    os.makedirs(f"{folder}/sub")
    for name in ("precious.txt", "sub/more.arrow"):
        open(f"{folder}/{name}", "w").close()
    first = token_output.write(docs, folder, vocabulary)
    expected = sorted(map(str, token_output.read_digests(first, folder).collect()))
    again = token_output.write(docs, f"file://{folder}", vocabulary)
    assert sorted(map(str, token_output.read_digests(first, folder).collect())) == expected
    assert sorted(map(str, token_output.read_digests(again, folder).collect())) == expected
    assert os.path.exists(f"{folder}/precious.txt") and os.path.exists(f"{folder}/sub/more.arrow")
    # what an attempt that did not end well has left goes, in the write's own folder alone
    own = first.first()["name"].split("/")[0]
    for name in (f"{own}/lost.arrow", "lost.arrow"):
        open(f"{folder}/{name}", "w").close()
    token_output._remove_lost(first, folder, own)
    assert not os.path.exists(f"{folder}/{own}/lost.arrow") and os.path.exists(f"{folder}/lost.arrow")
    assert sorted(map(str, token_output.read_digests(first, folder).collect())) == expected


def test_token_files_need_a_known_store(spark):
    for folder in ("dbfs:/x", "nowhere://a/b"):
        with pytest.raises(ValueError):
            token_output.write(documents(spark), folder, default_vocabulary())
    store, path = token_output._open("s3a://bucket/some/folder?region=us-east-1")
    assert (store.type_name, path) == ("s3", "bucket/some/folder")


def test_one_repeated_id_is_spread_over_files(spark):
    docs = spark.createDataFrame([(7 if i % 3 else None, f"text {i % 50}") for i in range(600)], "doc_id long, text string")
    folder = fresh_path(spark, "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_output.write(docs, folder, default_vocabulary())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() >= 3 and max(r["n_docs"] for r in manifest.collect()) < 400
    rows = sorted(token_output.read_digests(manifest, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None] * 200 + [7] * 400
