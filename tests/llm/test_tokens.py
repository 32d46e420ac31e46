"""Packing, token files and BPE against the libraries."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm import bitplane, bpe, packing, tokens
from tidemark.llm.common import scratch
from tidemark.llm.queries import QUERIES
from tidemark.llm.tokens import LibraryUnits, WordStore

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["a", "b", "the", "ing", " ", "  ", "\n", "\t", "'s", "'", "é", "ß", "日", "١", "²", "\x1c", "\x85", " ", "!", "..", "12", "\U0001f600", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts(n=1500):
    rng = random.Random(5)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50))) for _ in range(n)] + ["", "a" * 3000, " " * 400 + "x"]


def raw(ids):
    return np.array(ids, "<u4").tobytes()


def test_units_equal_whole_texts(library):
    units = LibraryUnits(JSON)
    units.limit = 500  # forgets on the way
    for text in odd_texts():
        assert units.ids(text) == raw(library(text)), text


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a ", "a  b", "a \n b", "a\n b c", "x\ty z\n\nw v", " \t ", "a\u3000 b", "a \x1cb c", "it's 12 34\r\nok then", "w " * 50])
def test_pieces_between_blanks(library, text):
    units = LibraryUnits(JSON)
    for _ in range(2):  # unknown, then known
        assert units.ids(text) == raw(library(text)), text


def test_segment_tree_equals_library(reference):
    units = bpe.RankUnits(RANKS, P.PATTERN)
    units.limit = 500
    texts = odd_texts()
    for start in range(0, len(texts), 200):
        part = texts[start : start + 200]
        for text, ids in zip(part, units.texts(part), strict=True):
            assert ids == raw(reference.encode_ordinary(text)), text
            assert units.decode(ids) == text.encode()


def test_segment_tree_takes_leftmost_of_equal_ranks():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"aab": 257}
    merges = bpe.Merges(ranks)
    assert bpe.encode_words([b"aaa", b"aaab", b"aaaaa"], merges) == [raw([256, 97]), raw([256, 97, 98]), raw([256, 256, 97])]


def test_bpe_round_trip(spark, edge, empty, reference):
    rows = {(r.doc_id, r.ids_sha256, r.n_tokens, r.decoded_sha256) for r in bpe.round_trip(edge, RANKS, P.PATTERN).collect()}
    want = set()
    for r in edge.collect():
        ids = reference.encode_ordinary(r.text or "")
        want.add((r.doc_id, hashlib.sha256(raw(ids)).hexdigest(), len(ids), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert rows == want
    both = bpe.decode(bpe.encode(edge, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert sorted(bytes(r.decoded) for r in both) == sorted((r.text or "").encode() for r in edge.collect())
    assert bpe.round_trip(empty, RANKS, P.PATTERN).count() == 0


def check_packing(pieces, docs, library, size, end):
    """Every id once, crc of every piece, gapless offsets; returns the share of padding."""
    texts = defaultdict(list)
    for r in docs:
        texts[r.doc_id].append(library(r.text) + [end])
    copies = {d: len(t) for d, t in texts.items()}
    covered, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = texts[p.doc_id][0]
        assert p.doc_tokens == len(ids) and 0 < p.length <= size
        assert p.ids_crc32 == zlib.crc32(raw(ids[p.start : p.start + p.length]))
        covered[p.doc_id].append((p.start, p.length))
        windows[p.sequence_id].append((p.offset, p.length))
    assert covered.keys() == texts.keys()
    for d, spans in covered.items():
        assert sum(n for _, n in spans) == copies[d] * len(texts[d][0])
        if copies[d] == 1:
            at = 0
            for start, n in sorted(spans):
                assert start == at
                at += n
    for spans in windows.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= size
    used = sum(n for s in windows.values() for _, n in s)
    return 1 - used / (len(windows) * size)


def test_packing_of_edge_cases(edge, empty, library):
    for open_windows, size in ((1, 64), (4, 256)):
        pieces = packing.pack(edge, JSON, 1, size, open_windows=open_windows, least=8, tasks_per_merge=2).collect()
        check_packing(pieces, edge.collect(), library, size, 1)
    assert packing.pack(empty, JSON, 1).count() == 0


def test_packing_keeps_large_ids_beside_nulls(spark, library):
    big = 1152921504606846977
    rows = [(big, "a b"), (big + 2, "c d"), (None, "e f"), (-big, "g"), (2**63 - 1, "h i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pieces = packing.pack(docs, JSON, 1, 64, tasks_per_merge=2).collect()
    assert sorted((r.doc_id for r in pieces), key=str) == sorted((d for d, _ in rows), key=str)
    check_packing(pieces, docs.collect(), library, 64, 1)


def test_packing_query(spark, sf, documents, library):
    assert check_packing(QUERIES["op1_packing"](spark, sf).collect(), documents.collect(), library, 2048, 1) < 0.03


def test_windows_place_best_fit():
    w = packing.Windows(10, 2, 0)
    for doc, n in enumerate([6, 7, 3, 4]):  # 3 fits the second window exactly, 4 the first
        w.put((doc, 0, n, 0, n))
    assert [(r[0], r[5], r[6]) for r in w.done] == [(1, 1, 0), (2, 1, 7), (0, 0, 0), (3, 0, 6)]
    w = packing.Windows(10, 2, 0)
    for doc, n in enumerate([6, 7, 8]):  # nothing fits: the fullest goes
        w.put((doc, 0, n, 0, n))
    assert [r[0] for r in w.done] == [1] and [r[0] for r in w.leftovers()] == [2, 0]


@pytest.mark.parametrize("mode", ["bit", "byte"])
@pytest.mark.parametrize("ids", [[], [0], [0, 0, 0], [50256, 1, 2], [2**32 - 1, 7], list(range(1000))])
def test_planes_round_trip(mode, ids):
    x = np.array(ids, "<u4")
    assert bitplane.from_planes(bitplane.to_planes(x, mode), len(x), mode).tolist() == ids


@pytest.mark.parametrize("mode", ["bit", "byte"])
def test_plane_file_round_trip(mode):
    rng = np.random.default_rng(1)
    docs = [(i if i != 3 else None, rng.integers(0, 50257, n).astype("<u4").tobytes()) for i, n in enumerate([0, 5, 64, 1, 200, 0, 33])]
    out = bitplane.PlaneFile(mode, block=64)
    for d in docs:
        out.add(*d)
    data = out.finish()
    assert [(d, b"".join(p)) for d, p in bitplane.documents_of(data)] == docs
    with pytest.raises(ValueError):
        list(bitplane.documents_of(data[:-3]))


def test_token_files(spark, edge, empty, library, monkeypatch):
    for mode in ("bit", "byte"):
        path = scratch(spark, "t")
        files = bitplane.write_ids(edge, path, JSON, 2, mode)
        got = sorted((r.start, r.n_tokens, r.doc_id, r.ids_crc32) for r in bitplane.read_ids(spark, path).collect())
        rows = sorted(edge.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
        want, start = [], 0
        for r in rows:
            ids = library(r.text) + [2]
            want.append((start, len(ids), r.doc_id, zlib.crc32(raw(ids))))
            start += len(ids)
        assert got == want
        assert sum(r.ids for r in files.collect()) == start
    assert bitplane.write_ids(empty, scratch(spark, "t"), JSON, 2).count() == 0


def test_token_file_query(spark, sf, documents, library):
    start = 0
    got = {r.doc_id: r for r in QUERIES["op6_bit_planes"](spark, sf).collect()}
    for r in documents.orderBy("doc_id").collect():
        ids = library(r.text) + [2]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(raw(ids)))
        start += len(ids)
    assert len(got) == documents.count()


def test_bpe_query(spark, sf, documents, reference):
    got = {r.doc_id: r for r in QUERIES["op7_byte_bpe"](spark, sf).collect()}
    for r in documents.collect():
        ids = reference.encode_ordinary(r.text or "")
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(raw(ids)).hexdigest() and got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


# --- added tokens, as the unmodified library matches them --------------------------------------------------------------


@pytest.fixture(scope="module")
def unmodified():
    t = Tokenizer.from_file(JSON)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_units_equal_the_unmodified_library(unmodified):
    units = LibraryUnits(JSON, encode_special_tokens=False)
    assert units.ids("a <|endoftext|> b") == raw([64, 220, 50256, 275])
    for text in [*odd_texts(), "<|endoftext|>", "<|endoftext|><|endoftext|> \n<|endoftext", "x<|endoftext|>'s"]:
        assert units.ids(text) == raw(unmodified(text)), text


def test_queries_match_added_tokens(spark, unmodified):
    import corpus_pipeline

    sf = scratch(spark, "added")
    rows = [(1, "a <|endoftext|> b"), (2, "<|endoftext|>" * 3000), (3, "plain words"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{sf}/documents.parquet")
    for pieces in (QUERIES["op1_packing"](spark, sf), corpus_pipeline.pack_documents(spark, docs, sf)):
        check_packing(pieces.collect(), docs.collect(), unmodified, 2048, 1)
    start = 0
    for r in sorted(QUERIES["op6_bit_planes"](spark, sf).collect()):
        ids = unmodified(rows[r.doc_id - 1][1]) + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(raw(ids)))
        start += len(ids)


def test_new_words_are_encoded_once(library):
    units, texts = LibraryUnits(JSON), [t for t in odd_texts(300)]
    texts += [None, "the ant, the bee.\nthe ant, the bee.", "the ant  the bee", " the ant", "bee", "the <|endoftext|> bee"]
    array = pa.array(["skipped", *texts], pa.large_string()).slice(1)
    assert units.texts(array) == [raw(library(t)) for t in texts]
    asked = []
    encode, units._tokenized = units._tokenized, lambda word: asked.append(word) or encode(word)
    assert units.texts(array) == [raw(library(t)) for t in texts]
    assert not asked
    lines = [f"the ant, gnat{i % 7}.\nbee the" for i in range(50)]
    assert units.texts(pa.array(lines)) == [raw(library(t)) for t in lines]
    assert len(asked) == len(set(asked)) <= 16


def test_word_store_forgets_what_was_not_asked_for():
    store, asked = WordStore(), []
    encode = lambda word: asked.append(word) or raw([len(word)] * len(word))
    for turn in range(30):
        words = ["often", *[f"w{turn}-{i}" for i in range(20)]]
        rows = store.rows(pa.array(words), encode, 50)
        for word, row in zip(words, rows, strict=True):
            assert store.ids[store.starts[row] : store.starts[row] + store.lengths[row]].tolist() == [len(word)] * len(word)
        assert len(store.words) == len(store.lengths) == len(store.used) <= 50 + 21
    assert asked.count("often") == 1


def test_rows_are_encoded_a_bounded_number_of_bytes_at_a_time(library, monkeypatch):
    monkeypatch.setattr(tokens, "TOGETHER", 40)
    texts = ["a bee " * 30, None, "ant", "", "the bee", "x" * 39, "y", "an ant " * 9]
    batch = pa.record_batch({"doc_id": pa.array([5, None, 7, 8, 9, 10, 11, 12]), "text": texts})
    parts = list(tokens.encoded_rows(iter([batch, batch.slice(2, 3), batch.slice(0, 0)]), LibraryUnits(JSON)))
    assert [d for ids, _ in parts for d in ids] == [5, None, 7, 8, 9, 10, 11, 12, 7, 8, 9]
    assert [t for _, found in parts for t in found] == [raw(library(t)) for t in [*texts, *texts[2:5]]]
    assert len(parts) > 4
