import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from klaxon.llm import bpe, sharding, wavelet
from support_llm import documents, rows

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "a", " a", "a ", "  a  b", "\n", "aaa aaaa aaaaaa", "<|endoftext|>", "x<|endoftext|> y <|ENDOFTEXT|>.", "don't we'll, I'VE 'tis",
       "é tést", "١٢ abc ½", "\x1c a\x1db", "a\x85b \x85", "日本語 テ", "\U0001f44d\U0001f3fd ok", "tab\tsep \tx",
       "a" * 3000, "ab " * 3000, " \n a \n\n  b", "İstanbul İ. ΟΔΟΣ.", "é ́ ̈a", "ﬁ Å.", "'S. 's.", "., ,."]
TEXTS = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (7, None), (7, None), (3, "twice"), (3, "twice")]


def noise(n, seed=1):
    rnd = random.Random(seed)
    pool = [chr(c) for c in range(0x20, 0x3000)] + [" "] * 3000 + ["\n"] * 300 + list("'sdtremvl<|>.,") * 50
    return ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 60))) for _ in range(n)]


def test_bpe_equals_library():
    own, library = bpe.ByteBpe(BYTE), Tokenizer.from_file(BYTE)
    texts = ODD + noise(600) + [s.format(chr(c)) for c in range(0x3001) if not 0xD800 <= c < 0xE000 for s in ("a {}b", "a{} b", "x{}")]
    found = own.encode(texts)
    for text, ids, e in zip(texts, found, library.encode_batch(texts, add_special_tokens=False)):
        assert list(ids) == e.ids, text
        assert own.decode(ids) == library.decode(e.ids, skip_special_tokens=False) == text


def test_full_store_is_refilled():
    own = bpe.ByteBpe(BYTE)
    own.segments.kept = 5
    texts = ["one two three four", "five six seven eight nine", "one two ten"]
    assert [list(i) for i in own.encode(texts) for _ in [0]] == [list(own.encode([t])[0]) for t in texts]


def test_bpe_documents(spark):
    docs = documents(spark, TEXTS)
    library = Tokenizer.from_file(BYTE)
    want = []
    for i, t in TEXTS:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4")
        want.append((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert rows(bpe.digests(docs, BYTE), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=str)
    back = bpe.decode_documents(bpe.encode_documents(docs, BYTE), BYTE)
    assert back.columns == [*docs.columns, "token_ids", "decoded"]
    assert back.where("decoded <> coalesce(text, '')").count() == 0
    once = bpe.encode_documents(docs, BYTE, decoded="decoded")
    assert once.columns == back.columns and rows(once, "doc_id", "token_ids", "decoded") == rows(back, "doc_id", "token_ids", "decoded")
    assert bpe.digests(docs.limit(0), BYTE).count() == 0


def test_word_ids_equal_library():
    own, library = wavelet.WordEncoder(WORD), Tokenizer.from_file(WORD)
    texts = ODD + noise(800, 2)
    for text, ids in zip(texts, own.encode(texts)):
        assert list(ids) == library.encode(text, add_special_tokens=False).ids, text


def test_batches_hold_little_text():
    import tracemalloc

    texts = [" ".join(f"w{i}x{k}" for k in range(400)) for i in range(1000)]
    own = bpe.ByteBpe(BYTE)
    tracemalloc.start()
    for _, part in bpe.batches(pa.array(texts)):
        own.encode(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000_000, peak


def test_words_of_many_slices_equal_library():
    texts = [None, "a,b c. \n d", "", "Ünal, x.", *ODD * 3]
    own, library = wavelet.WordEncoder(WORD), Tokenizer.from_file(WORD)
    own.whole.kept = 20
    parts = list(wavelet.slices(pa.array(["skipped", *texts]).slice(1), 10))
    assert [s for s, _ in parts] == list(np.cumsum([0] + [len(p) for _, p in parts])[:-1]) and len(parts) > len(ODD)
    found = [ids for _, part in parts for ids in own.encode(part)]
    assert [list(f) for f in found] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_wavelet_matrix(monkeypatch):
    import io

    monkeypatch.setattr(wavelet, "BLOCK_BITS", 64)
    rnd = np.random.default_rng(3)
    ids = rnd.integers(0, 300, 1000).astype(np.uint32)
    shard = wavelet.Shard(io.BytesIO(wavelet.dump(ids, [5, None, 9], np.array([10, 10, 1000]))))
    assert (shard.ids() == ids).all()
    docs, ends = shard.documents()
    assert docs == [5, None, 9] and list(ends) == [10, 10, 1000]
    for position in (0, 63, 64, 500, 999):
        token = int(ids[position])
        before = int((ids[:position] == token).sum())
        assert (shard.access(position), shard.rank(token, position), shard.select(token, before)) == (token, before, position)
    assert shard.count(299) == (ids == 299).sum() and shard.count(5000) == 0
    with pytest.raises(IndexError):
        shard.select(299, int((ids == 299).sum()))
    one = wavelet.Shard(io.BytesIO(wavelet.dump(np.array([0], np.uint32), [1], np.array([1]))))
    assert list(one.ids()) == [0] and one.access(0) == 0


def test_wavelet_documents(spark, monkeypatch):
    docs, library = documents(spark, TEXTS), Tokenizer.from_file(WORD)
    got = wavelet.documents_through_shards(docs, WORD).collect()
    coded = {t: np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for _, t in TEXTS}
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(
        (i is not None, i or 0, len(coded[t]), zlib.crc32(coded[t])) for i, t in TEXTS)
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == list(np.cumsum([0] + [r["n_tokens"] for r in got])[:-1])
    assert [r["doc_id"] or -1 for r in got] == sorted(-1 if i is None else i or -1 for i, _ in TEXTS)
    assert wavelet.documents_through_shards(docs.limit(0), WORD).count() == 0


def jump(key, n):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * sharding.MULTIPLIER + 1) % (1 << 64)
        j = int((b + 1) * (2147483648.0 / ((key >> 33) + 1)))
    return b


def test_jump_hash(spark):
    keys = [0, 1, -1, 2**63 - 1, -(2**63), 12345, *random.Random(4).sample(range(10**12), 60)]
    frame = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long")
    for n in (1, 2, 16, 17, 1000):
        got = frame.select("k", sharding.jump_hash(frame["k"], n).alias("s")).collect()
        assert {r["k"]: r["s"] for r in got} == {k: jump(k or 0, n) for k in [*keys, None]}


def test_shards(spark):
    docs = documents(spark, TEXTS)
    got = sharding.shard_documents(docs).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted(
        (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    for s in range(16):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert all(r["shard"] == jump(r["doc_id"] or 0, 16) and r["grown_shard"] in (r["shard"], 16) for r in got)
    assert sharding.shard_documents(docs.limit(0)).count() == 0
