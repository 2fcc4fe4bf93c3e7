"""Token files and packing: exact round trips against the tokenizers library."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from loomstrata.llm import common, packing, token_store, tokens

BYTE, WORD = tokens.tokenizer_path("byte_bpe_50k.json"), tokens.tokenizer_path("word_bpe_49k.json")
ODD = ["", "\n", "a  b", "a\n\nb ", " x", "x ", "<|endoftext|> a", "foo's bar.' 'tis, X.!? éa éb", "a\x1cb\tc", "ΑΣ ΑΣ. ß İstanbul 12,3. ...", "__a__ b_,", "日本語. ab", "é É. ÉA", "x\n. y", "ǅa ﬁ.", "1. a1 ²", "a　b c", "don't. a's", "A|B| C|", "a.b,c d"]


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize("most", [3, 700_000])
def test_encoder(odd, path, most):
    mine, library = tokens.Encoder(path, most), Tokenizer.from_file(path)
    texts = [*ODD, *(r.text for r in odd.filter("text is not null").collect()), *ODD]
    for group in (1, 64):
        for t, got in zip(texts, mine.encode(texts, group)):
            assert np.frombuffer(got, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, t[:80]


def test_file_format():
    rng = np.random.default_rng(0)
    docs = [(i if i % 7 else None, rng.integers(0, 50_000, n).astype("<u2")) for i, n in enumerate([0, 1, 5, 400_000, 3, 0, 700_000, 900_000, 2, 0])]
    w = token_store.Writer(3)
    for d, x in docs:
        w.add(d, x.tobytes())
    raw = w.done()
    r = token_store.Reader.of(raw)
    assert r.ordinal == 3 and len(r.sums) >= 3
    assert [(d, x.tolist()) for d, _, x in r.every()] == [(d, x.tolist()) for d, x in docs]
    read = []
    lazy = token_store.Reader(lambda at, n: read.append(n) or raw[at : at + n], len(raw))
    tables = sum(read)
    assert lazy.document(8).tolist() == docs[8][1].tolist() and lazy.document(99) is None and lazy.ids(6).tolist() == docs[6][1].tolist()
    assert sum(read) < len(raw) and tables < 2000
    import zstandard

    whole = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(raw[: int(r.at[-1])])
    assert whole == b"".join(x.tobytes() for _, x in docs)
    broken = bytearray(raw)
    broken[int(r.at[1]) + 40] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_store.Reader.of(bytes(broken)).frame(1)
    assert list(token_store.Reader.of(token_store.Writer(0).done()).every()) == []


def test_store(spark, odd, empty):
    library = Tokenizer.from_file(BYTE)
    got = token_store.token_digest(odd, BYTE).collect()
    want = Counter()
    for r in odd.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert ids == sorted(ids)
    assert token_store.token_digest(empty, BYTE).count() == 0
    path = common.scratch_path(spark, "files")
    token_store.write_tokens(odd, path, BYTE, file_bytes=1 << 14)
    assert spark.read.format("binaryFile").load(path).filter("length > 0").count() > 4


def test_packing(odd, empty):
    library = Tokenizer.from_file(WORD)
    docs = Counter((r.doc_id, tuple([*library.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in odd.collect())
    rows = packing.pack(odd, WORD, length=64).collect()
    sequences: dict[int, list] = {}
    for r in rows:
        assert len(r.ids) == 4 * r.length
        sequences.setdefault(r.sequence_id, []).append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64 and at & (at - 1) == 0
    pieces: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        key = (r.doc_id, r.doc_tokens)
        pieces.setdefault(key, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for (doc, n), parts in pieces.items():
        copies = sum(c for (d, ids), c in docs.items() if d == doc and len(ids) == n)
        if copies == 1:
            ids = [x for _, p in sorted(parts) for x in p]
            assert docs[doc, tuple(ids)] == 1
    assert sum(r.length for r in rows) == sum(len(ids) * c for (_, ids), c in docs.items())
    assert packing.pack(empty, WORD).count() == 0


@pytest.mark.parametrize(("n", "bits"), [(2, 3), (3, 3), (4, 2)])
def test_hilbert(n, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
    keys = packing.hilbert_key(grid, bits)
    assert sorted(keys.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def test_requested_documents(spark, data, tmp_path):
    """Only the asked ids come back, equal to what the whole files hold; a reader of one reads one frame."""
    path = f"file://{tmp_path}/tokens"
    docs = common.read(spark, data, "documents")
    token_store.write_tokens(docs, path, tokens.tokenizer_path("byte_bpe_50k.json"))
    rows = [(i,) for i in range(0, 200, 17)] + [(3,), (3,), (None,), (10**9,)]
    got = token_store.read_documents(spark, path, spark.createDataFrame(rows, "doc_id long")).collect()
    library = Tokenizer.from_file(tokens.tokenizer_path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    want = {i: [*library.encode(texts[i], add_special_tokens=False).ids, 0] for i in {r[0] for r in rows} & texts.keys()}
    assert {r.doc_id: r.ids for r in got} == want and len(got) == len(want) > 10
    assert token_store.read_documents(spark, path, spark.createDataFrame([], "doc_id long")).collect() == []


def test_one_document_costs_one_frame(monkeypatch):
    w = token_store.Writer(0)
    monkeypatch.setattr(token_store, "FRAME_BYTES", 1000)
    for i in range(500):
        w.add(i, bytes(range(100)))
    content, asked = w.done(), []
    r = token_store.Reader(lambda at, n: asked.append(n) or content[at : at + n], len(content))
    tables = len(asked)
    assert r.document(250).tobytes() == bytes(range(100)) and len(asked) <= tables + 2 and len(r.sums) >= 50


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_random_strings(path):
    """50,000 short strings over all planes, with marks, blanks, digits, case and joiners beside each other."""
    rng = np.random.default_rng(11)
    special = [*" \t\n\r\x0b\x0c\x1c\x85  　‍️̧́̈'’._-,!?|/0123456789²½Ⅷ", "'s", "'ll", "  ", "\n\n", "ǅ", "ß", "İ", "ς", "ﬁ", "👩", "🏽", "한", "각"]
    planes = [c for c in map(chr, [*rng.integers(0x20, 0x250, 300), *rng.integers(0x250, 0xD800, 1500), *rng.integers(0xE000, 0x10000, 300), *rng.integers(0x10000, 0x110000, 900)])]
    words = ["the", "The", "THE", "don", "été", "straße", "abc", "a", "I", "x1", "日本"]
    pools = [special, planes, words]
    texts = ["".join(pools[k][int(rng.integers(len(pools[k])))] for k in rng.choice(3, size=int(rng.integers(1, 9)), p=[0.45, 0.25, 0.3])) for _ in range(50_000)]
    mine, library = tokens.Encoder(path, 700_000), Tokenizer.from_file(path)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    for text, got, ids in zip(texts, mine.encode(texts), want):
        assert np.frombuffer(got, "<u2").tolist() == ids, repr(text)
