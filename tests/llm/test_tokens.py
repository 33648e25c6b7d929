"""BPE, token files and packing against the tokenizers library."""

from __future__ import annotations

import hashlib
import io
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from accordant.llm import bpe, packing, token_files
from accordant.llm.common import keep, shared_uri

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", "   \n", "ΑΣ ΣΑΣ Σ", "İstanbul ǅ ß ﬁ", "don't I'LL we've 's", "<|endoftext|>x<|startoftext|> <|x|>",
    "a\x1cb \x1d\x85c\xa0d", "aaaaaaaaaaaaaaaaaa", "é ́e", "½²Ⅷ३4512", "日本語 한국어", "😀👍🏽", "\x00\x01\x7f",
    "same text", "same text", "x" * 3000, "word, " * 5000, "Ɓ Ⱥ ɐ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_words_equal_library(library):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aeiotnshr") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcxyz'</w>.,!0123 éèΣ") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for text, got in zip(texts, bpe.WordBpe(PATH).encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == ids_of(library, text), text


def test_long_words_equal_library(library):
    rng = random.Random(9)
    words = ["".join(rng.choice("aeiotnshr") for _ in range(n)) for n in (300, 2000, 30000)] + ["ab" * 4000, "z" * 5000, "é" * 3000]
    for text, got in zip(words, bpe.WordBpe(PATH).encode(words)):
        assert np.frombuffer(got, "<u4").tolist() == ids_of(library, text)
    start = time.perf_counter()
    bpe.WordBpe(PATH).encode(["".join(rng.choice("aeiotnshr") for _ in range(1_000_000))])
    assert time.perf_counter() - start < 60


def test_words_beside_each_other_equal_library(library):
    rng = random.Random(3)
    texts = ["".join(rng.choice("aeRstvemldD'''  !.,09éÉİ²½ \x85\xa0\x1c\n\tſŸŉß<|>") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["don't'", "''s", "'s't'rest", "x'", "'", "l'", "'r", "é'sé'Lé'", None, "<|endoftext|>'s", "a<", "|b"]
    for text, got in zip(texts, bpe.WordBpe(PATH).encode(pa.array(texts)), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids_of(library, text), text


def test_new_words_are_encoded_side_by_side(monkeypatch, library):
    rng, calls, get = random.Random(4), [], bpe.Lookup.get
    texts = [" ".join("".join(rng.choices(["th", "er", "on", "an", "re", "he"], k=rng.randint(2, 7))) for _ in range(100)) for _ in range(200)]
    coder = bpe.WordBpe(PATH)
    monkeypatch.setattr(bpe.Lookup, "get", lambda self, keys: calls.append(len(keys)) or get(self, keys))
    found = coder.encode(texts)
    assert len(calls) < 300  # for some 15,000 different words
    assert found[0] == np.array(ids_of(library, texts[0]), "<u4").tobytes()


def test_proposals_are_verified():
    coder = bpe.WordBpe(PATH)
    words = ["".join(w) for w in zip(*[random.Random(i).choices("aeiotnshr", k=400) for i in range(9)])]
    exact = coder.merge_exactly(words)
    assert coder.encode_words(words) == exact
    assert any(np.array(coder.propose(w), "<u4").tobytes() != e for w, e in zip(words, exact))  # some had to be merged


def test_round_trip_of_odd_texts(spark, library):
    rows = [(i, t, "theirs") for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")  # a clashing name
    out = bpe.encode(docs, PATH, decoded_col="decoded")
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    again = {r["doc_id"]: r["decoded"] for r in bpe.decode(out.drop("decoded"), PATH).collect()}
    for r in out.collect():
        ids = ids_of(library, r["text"])
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False) == again[r["doc_id"]]
    assert bpe.encode(docs.limit(0), PATH).count() == 0


def test_registered_query(spark, library):
    import __spark_entry__ as contract

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in contract.queries()["op1_bpe"](spark, sf).collect():
        ids = ids_of(library, texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# --- files ---------------------------------------------------------------------------


def test_file_holds_documents_and_notices_damage():
    documents = [(None, b""), (3, b"abcd" * 9), (3, b"efgh"), (7, bytes(4000))]
    out = io.BytesIO()
    made = token_files.write_file(out, documents)
    assert made["n_docs"] == 4 and made["first_id"] == 3 and made["n_tokens"] == 9 + 1 + 1000
    frames = token_files.read_frames(out, made["n_bytes"])
    assert [(f.doc_id, token_files.read_document(out, f)) for f in frames] == documents
    whole = bytearray(out.getvalue())
    whole[frames[1].offset + 6] ^= 255
    with pytest.raises(token_files.Damaged):
        token_files.read_document(io.BytesIO(whole), frames[1])
    with pytest.raises(token_files.Damaged):
        token_files.read_frames(io.BytesIO(whole[:-1]), len(whole) - 1)


def test_files_round_trip(spark, library):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (4, "again four")], "doc_id long, text string").repartition(3)
    manifest = keep(token_files.write(docs, shared_uri(spark, "files"), PATH, files=4), "manifest")
    got = token_files.read(manifest).orderBy("start").collect()
    want = sorted(((i, t or "") for i, t in [*enumerate(ODD), (None, "no id"), (4, "again four")]), key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    start = 0
    for r, (i, t) in zip(got, want, strict=True):
        ids = np.array([*ids_of(library, t), 1], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    some = token_files.read(manifest, wanted=spark.createDataFrame([(3,), (17,), (999,)], "doc_id long"), ids=True).collect()
    assert {r["doc_id"]: len(r["ids"]) // 4 for r in some} == {i: len(ids_of(library, ODD[i])) + 1 for i in (3, 17)}
    empty = keep(token_files.write(docs.limit(0), shared_uri(spark, "files"), PATH, files=2), "manifest")
    assert token_files.read(empty).count() == 0


# --- packing -------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_closest_fill_is_best(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 40): rng.randint(1, 4) for _ in range(6)}
    room = rng.randint(1, 120)
    reach = {0}
    for length, n in counts.items():
        reach = {s + k * length for s in reach for k in range(n + 1)}
    taken = packing.closest_fill(counts, room)
    assert all(0 < n <= counts[length] for length, n in taken.items())
    assert sum(length * n for length, n in taken.items()) == max(s for s in reach if s <= room)


def check_packing(pieces, lengths, capacity):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for doc_id, length in lengths.items():
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == length
            at += p["length"]
        assert at == length
    totals = []
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        totals.append(at)
    assert all(t == capacity or t & (t - 1) == 0 and t < capacity for t in totals)
    return totals


def test_packing_of_odd_texts(spark, library):
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(ODD)], "doc_id long, text string, length int").repartition(2)
    pieces = packing.pack(docs, PATH, capacity=64).collect()
    lengths = {i: len(ids_of(library, t)) + 1 for i, t in enumerate(ODD)}
    check_packing(pieces, lengths, 64)
    for p in pieces:
        ids = np.array([*ids_of(library, ODD[p["doc_id"]]), 1], "<u4")[p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(ids.tobytes())
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_equal_lengths_are_cut(monkeypatch):
    monkeypatch.setattr(packing, "WAITING", 8)
    packer = packing.Packer(100, 0)
    for i in range(50):
        packer.add(i, bytes(4 * 75))
    packer.finish()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    totals = check_packing([dict(zip(names, p)) for p in packer.pieces], {i: 75 for i in range(50)}, 100)
    assert sum(totals) == 3750 and totals.count(100) == 37


# --- registered queries against the library ------------------------------------------


def library_ids(spark, library, sf):
    return {r["doc_id"]: [*ids_of(library, r["text"]), 1] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_packing_query(spark, library, size):
    import __spark_entry__ as contract

    sf = f"/root/testdata/{size}"
    every = library_ids(spark, library, sf)
    rows = contract.queries()["op5_packing"](spark, sf).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r["doc_tokens"] == len(every[r["doc_id"]])
        assert r["ids_crc32"] == crc(every[r["doc_id"]][r["start"] : r["start"] + r["length"]])
        by_doc.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert by_doc.keys() == every.keys()
    for pieces, total in ((p, len(every[i])) for i, p in by_doc.items()):
        at = 0
        for start, length in sorted(pieces):
            assert start == at and length > 0
            at += length
        assert at == total
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_token_file_query(spark, library, size):
    import __spark_entry__ as contract

    sf = f"/root/testdata/{size}"
    every = library_ids(spark, library, sf)
    want, at = set(), 0
    for doc_id in sorted(every):
        want.add((doc_id, at, len(every[doc_id]), crc(every[doc_id])))
        at += len(every[doc_id])
    assert {(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in contract.queries()["op9_token_files"](spark, sf).collect()} == want
