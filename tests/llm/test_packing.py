import itertools
import random
import zlib

import numpy as np
import pytest

from citeloom.llm import packing
from citeloom.llm.queries import tokenizer_path


def test_fill_is_the_best_subset_sum():
    draw = random.Random(3)
    for _ in range(300):
        lengths = [draw.randint(1, 12) for _ in range(draw.randint(0, 9))]
        capacity = draw.randint(0, 30)
        counts = {x: lengths.count(x) for x in lengths}
        used = packing.fill(counts, capacity)
        best = max(s for n in range(len(lengths) + 1) for c in itertools.combinations(lengths, n) if (s := sum(c)) <= capacity)
        assert sum(k * v for k, v in used.items()) == best
        assert all(v <= counts[k] for k, v in used.items())


def check(pieces, ids_of, capacity):
    """Every id in one piece, offsets gapless, sums right, no padding but to a power of two."""
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p[0], []).append(p)
        by_sequence.setdefault(p[5], []).append(p)
    assert set(by_doc) == set(ids_of)
    for key, own in by_doc.items():
        ids, at = np.asarray(ids_of[key], "<u4"), 0
        for _, start, length, crc, total, *_ in sorted(own, key=lambda p: p[1]):
            assert start == at and length > 0 and total == len(ids)
            assert crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p[6]):
            assert p[6] == at
            at += p[2]
        assert at <= capacity and at & (at - 1) == 0


def test_packer_places_every_id_once(monkeypatch):
    monkeypatch.setattr(packing, "POOL_HIGH", 500)
    monkeypatch.setattr(packing, "POOL_LOW", 100)
    draw = random.Random(5)
    for trial in range(40):
        ids = {k: [draw.randint(0, 9999) for _ in range(draw.choice([1, 2, 63, 64, 65, 200, draw.randint(1, 150)]))] for k in range(draw.randint(1, 60))}
        packer = packing.Packer(64)
        for k, v in ids.items():
            packer.add(k, np.asarray(v, "<u4").tobytes())
        packer.finish()
        check(packer.pieces(), ids, 64)


def test_word_cache_equals_the_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    plain = tokenizers.Tokenizer.from_file(tokenizer_path())
    encode = packing.word_encoder(tokenizer_path())
    for text in ["", "  ", "Hello, World's best\tcafé—ñ é", "a b\x1cc d\x85e", "ΣΑΣ ß İstanbul 123 4.5", "<|endoftext|> x<|startoftext|>y", "it's they'll !!?? ***", "日本語 テキスト"]:
        got = np.frombuffer(encode(text), "<u4").tolist()
        assert got == plain.encode(text, add_special_tokens=False).ids, text


def test_pack_over_a_table(spark):
    tokenizers = pytest.importorskip("tokenizers")
    plain = tokenizers.Tokenizer.from_file(tokenizer_path())
    rows = [(i, "word and more words " * (i % 50) + str(i), None) for i in range(200)] + [(900, None, 1), (901, "", 2), (902, "long text, " * 9000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    pieces = [tuple(r) for r in packing.pack(docs, tokenizer_path()).collect()]
    check(pieces, {k: plain.encode(t or "", add_special_tokens=False).ids + [2] for k, t, _ in rows}, 4096)
    twice = packing.pack(spark.createDataFrame([(None, "x", 1)] * 2, "doc_id long, text string, length int"), tokenizer_path()).collect()
    assert sum(r.length for r in twice) == 4 and {r.doc_id for r in twice} == {None}
    assert packing.pack(docs.limit(0), tokenizer_path()).count() == 0


def test_words_without_ids(spark):
    """Lone spaces of other kinds than ASCII's are words that the tokenizer gives no ids for."""
    tokenizers = pytest.importorskip("tokenizers")
    plain = tokenizers.Tokenizer.from_file(tokenizer_path())
    rows = [(i, f"word{i} {c} tail {c} {c} w{i}") for i, c in enumerate(["\u00a0", "\u2003", "\u3000", "\u00a0\u2003", "\u200b"] * 40)]
    encode = packing.word_encoder(tokenizer_path())
    for _, text in rows:
        assert np.frombuffer(encode(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
    pieces = [tuple(r) for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), tokenizer_path()).collect()]
    check(pieces, {k: plain.encode(t, add_special_tokens=False).ids + [2] for k, t in rows}, 4096)


def test_piece_encoder_equals_the_tokenizer():
    import json

    tokenizers = pytest.importorskip("tokenizers")
    plain = tokenizers.Tokenizer.from_file(tokenizer_path())
    encode = packing.piece_encoder(tokenizer_path())
    with open(tokenizer_path(), encoding="utf-8") as f:
        words = [t[:-4] for t in json.load(f)["model"]["vocab"] if t.endswith("</w>")]
    draw = random.Random(4)
    pieces = [w for w in words if w.isascii() and w.isalpha() and w.islower()]
    pieces += ["".join(draw.choice("abcdefghijklmnopqrstuvwxyzéßäñç") for _ in range(draw.randint(1, 14))) for _ in range(20000)]
    pieces += ["".join(draw.sample(pieces[:20000], 2)) for _ in range(20000)] + ["!" * n for n in range(1, 30)] + list("0123456789¼×")
    for p, e in zip(pieces, plain.encode_batch(pieces, add_special_tokens=False)):
        assert np.frombuffer(encode(p), "<u4").tolist() == e.ids, p
