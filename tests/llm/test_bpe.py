from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from taxaflow.llm import bpe
from taxaflow.llm.vocabulary import codec, tokenizer_path

PIECES = ["a", "b", " ", "\n", "é", "  ", "'s", "'re", "1", "23", "...", "\t", "<|endoftext|>", "\u3000", "日本", "#", " the", "ing", "🙂", "x" * 30]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_codec_is_the_library(library):
    draw = random.Random(3)
    for _ in range(200):
        text = "".join(draw.choices(PIECES, k=60))
        ids = codec(tokenizer_path()).encode(text)
        assert list(ids) == expected(library, text)[0]
        assert codec(tokenizer_path()).decode(ids) == library.decode(list(ids), skip_special_tokens=False)


@pytest.mark.parametrize("limits", [(256, 10, 8192), (16, 4, 64), (8, 3, 24)])
def test_joins_are_repaired(monkeypatch, limits):
    for name, value in zip(("LEAST", "MASK_BITS", "MOST"), limits, strict=True):
        monkeypatch.setattr(bpe, name, value)
    coder, draw = codec(tokenizer_path()), random.Random(5)
    for _ in range(150):
        text = "".join(draw.choices(PIECES, k=draw.choice([3, 200, 1200])))
        raw = text.encode()
        bounds, names = bpe.chunks_of(raw)
        assert not raw or bounds[-1] == len(raw)
        ready = {n: coder.encode(raw[a:b].decode()) for a, b, n in zip([0, *bounds], bounds, names, strict=False) if draw.random() < 0.6}
        assert list(bpe.assemble(coder, raw, ready)) == list(coder.encode(text))


@pytest.mark.parametrize("limits", [(256, 10, 8192), (16, 4, 64), (8, 3, 24)])
@pytest.mark.parametrize("signs", ["", "。，", "a;(é's -\u0e31|"])
def test_joins_without_blanks(monkeypatch, limits, signs):
    for name, value in zip(("LEAST", "MASK_BITS", "MOST"), limits, strict=True):
        monkeypatch.setattr(bpe, name, value)
    coder, draw = codec(tokenizer_path()), random.Random(7)
    common = "日本語中国的是在不了有和人這中大のをにはアンกนา가한" + signs
    for turn in range(120):
        size = draw.choice([40, 900, 4000])
        letters = common if turn % 2 else "".join(chr(draw.randint(0x4E00, 0x9FA5)) for _ in range(300)) + signs
        text = "".join(draw.choices(letters, k=size))
        raw = text.encode()
        bounds, names = bpe.chunks_of(raw)
        ready = {n: coder.encode(raw[a:b].decode()) for a, b, n in zip([0, *bounds], bounds, names, strict=False) if draw.random() < 0.6}
        assert list(bpe.assemble(coder, raw, ready)) == list(coder.encode(text))


def test_repairs_of_long_texts_without_blanks_stay_local():
    coder, draw = codec(tokenizer_path()), random.Random(9)
    raw = "".join(chr(draw.randint(0x4E00, 0x9FA5)) for _ in range(60_000)).encode()
    bounds, names = bpe.chunks_of(raw)
    ready = {n: coder.encode(raw[a:b].decode()) for a, b, n in zip([0, *bounds], bounds, names, strict=False)}
    encoded, plain = [], coder.encode

    class Counted:
        special, lengths, decode_bytes = coder.special, coder.lengths, staticmethod(coder.decode_bytes)

        @staticmethod
        def encode(text):
            encoded.append(len(text))
            return plain(text)

    assert list(bpe.assemble(Counted, raw, ready)) == list(plain(raw.decode()))
    assert len(encoded) < 4 * len(bounds) and sum(encoded) < 60_000


def test_wrong_chunk_ids_change_nothing():
    coder, text = codec(tokenizer_path()), "some words that are shared " * 100
    names = bpe.chunks_of(text.encode())[1]
    assert list(bpe.assemble(coder, text.encode(), dict.fromkeys(names, coder.encode("other")))) == list(coder.encode(text))


def test_shared_passages(spark, library):
    draw = random.Random(8)
    passage = " ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 9))) for _ in range(3000))
    rows = [(i, f"{i} own start {draw.random()} {passage if i % 2 else passage[7000:]} own end {i}") for i in range(12)]
    docs = spark.createDataFrame(rows + rows[:2], "doc_id long, text string")
    keyed = docs.withColumn("key", docs["doc_id"])
    marks = bpe.shared_chunks(keyed)
    assert marks.where("owner").select("chunk").distinct().count() == marks.select("chunk").distinct().count() > 5
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], bytes(r["ids"])) for r in bpe.encode(docs).collect())
    want = sorted((i, len(ids), digest, np.array(ids, "<u4").tobytes()) for i, t in rows + rows[:2] for ids, digest in [expected(library, t)])
    assert got == want
    texts = {(r["doc_id"], r["text"]) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert texts == set(rows)


@pytest.mark.parametrize("owners", [bpe.BROADCAST_OWNERS, 0])
def test_repeated_rows_share_each_chunk_once(spark, library, monkeypatch, owners):
    monkeypatch.setattr(bpe, "BROADCAST_OWNERS", owners)
    draw = random.Random(12)
    passage = " ".join("".join(draw.choices("abcdefgh", k=draw.randint(2, 9))) for _ in range(2000))
    rows = [(i, f"{i} {passage} {i}") for i in (1, 2)]
    docs = spark.createDataFrame(rows * 20 + [(3, f"3 {passage} 3")], "doc_id long, text string")
    for key in (docs["doc_id"], -docs["doc_id"]):
        keyed = docs.withColumn("key", key)
        marks = bpe.shared_chunks(keyed)
        assert marks.count() == marks.select("key", "chunk").distinct().count() > 5
        ready = {r["key"]: [c["chunk"] for c in r["ready"]] for r in bpe.ready_chunks(keyed, marks, tokenizer_path()).collect()}
        assert len(ready) == 3 and all(len(c) == len(set(c)) == marks.count() / 3 for c in ready.values())
    got = sorted((r["doc_id"], r["ids_sha256"]) for r in bpe.encode(docs).collect())
    assert got == sorted((r["doc_id"], expected(library, r["text"])[1]) for r in docs.collect())


def test_edges(edge_docs, no_docs, library):
    rows = edge_docs.select("doc_id", "text").collect()
    got = sorted((str(r[0]), r[1], r[2], r[3]) for r in bpe.encode(edge_docs, with_ids=False).collect())
    want = sorted((str(i), len(ids), digest, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows for ids, digest in [expected(library, t)])
    assert got == want
    assert bpe.encode(no_docs).count() == 0
