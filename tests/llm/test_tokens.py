"""Byte-level BPE against its definition and the tiktoken library; token files against the tokenizers library."""

import hashlib
import random
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidebook.llm import bpe, queries, token_files, words

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SF_DIR = "/root/testdata/sf0.001"
PARTS = ["a", "b", "aa", " ", "  ", "\n", "\t", "'s", "'", "é", "ñ", "1", "22", ".", "--", "　", "\x1c", "\x85", "日本", "🙂", "²", "\r\n", " the"]


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = bpe.ranks_of(f.read())
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n):
    draw = random.Random(3)
    return ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 40))) for _ in range(n)]


def test_split_is_the_pattern():
    import regex

    assert words.PATTERN == public_tokenizers.PATTERN
    whole = regex.compile(words.PATTERN)
    for text in random_texts(2000):
        assert words.splitter(words.PATTERN)(text) == whole.findall(text)


def plain_merges(word, ranks):
    """One word, always the leftmost pair of lowest rank."""
    parts = [bytes([b]) for b in word]
    if word in ranks:
        return [ranks[word]]
    while True:
        found = [(ranks.get(a + b, 1 << 40), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
        if not found or min(found)[0] == 1 << 40:
            return [ranks[p] for p in parts]
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


@pytest.mark.parametrize("seed", range(6))
def test_replay_with_any_ranks(seed):
    """Vocabularies whose merges come up out of rank order, as trained ones never have them."""
    draw = random.Random(seed)
    ranks = {bytes([b]): b for b in range(256)}
    tokens = {bytes(draw.choice(b"abc") for _ in range(draw.randint(2, 5))) for _ in range(40)}
    order = sorted(tokens)
    draw.shuffle(order)
    ranks |= {t: 256 + k for k, t in enumerate(order)}
    texts = [bytes(draw.choice(b"abc") for _ in range(draw.randint(0, 30))) for _ in range(300)] + [b"a" * 99]
    assert bpe.Replay(ranks).encode(texts) == [plain_merges(t, ranks) if t else [] for t in texts]


def test_encode_and_decode(spark, library):
    texts = [*random_texts(200), None, "", "a" * 5000, "ab" * 3000, "same", "same"]
    rows = [(k, t, "kept", 1) for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids int")
    encoded = bpe.encode(frame, RANKS, words.PATTERN)
    assert encoded.columns == ["doc_id", "text", "decoded", "ids"]
    for row in bpe.decode(encoded, RANKS).collect():
        text = texts[row.doc_id] or ""
        assert row.ids == library.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()
    assert bpe.decode(bpe.encode(frame.limit(0), RANKS, words.PATTERN), RANKS).collect() == []


def test_encode_and_decode_in_one_pass(spark):
    rows = [(k, t) for k, t in enumerate([None, "", *random_texts(40)])]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    both = bpe.encode(frame, RANKS, public_tokenizers.PATTERN, decoded="text")
    got = {r.doc_id: (r.ids, bytes(r.text)) for r in both.collect()}
    ids = {r.doc_id: r.ids for r in bpe.encode(frame, RANKS, public_tokenizers.PATTERN).collect()}
    assert got == {k: (ids[k], (t or "").encode("utf-8", "surrogatepass")) for k, t in rows}


def test_small_memory_gives_the_same(library):
    with open(RANKS, "rb") as f:
        replay = bpe.Replay(bpe.ranks_of(f.read()))
    own = words.Encoder(words.splitter(words.PATTERN), lambda new: replay.encode([w.encode() for w in new]), most=3)
    for text in random_texts(50):
        sizes, flat = own.encode([text, text])
        assert flat[: sizes[0]].tolist() == library.encode_ordinary(text) == flat[sizes[0] :].tolist()


def test_op10(spark, library):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op10_byte_bpe(spark, SF_DIR).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = library.encode_ordinary(text or "")
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def expected(docs):
    own = Tokenizer.from_file(VOCABULARY)
    own.encode_special_tokens = True
    out, start = [], 0
    for doc_id, text in docs:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_op9(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op9_token_files(spark, SF_DIR).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == expected(sorted(map(tuple, docs)))


def test_token_files(spark, tmp_path):
    rows = [(5, "five words are in here"), (None, "no id"), (2, None), (2, ""), (7, "long " * 3000), (9, "x"), (9, "x")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    manifest = token_files.write(frame, f"file://{tmp_path}/files", VOCABULARY, length=64, shards=3)
    got = sorted(map(tuple, token_files.documents(manifest).collect()), key=lambda r: r[1])
    want = expected(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)))
    assert [r[1:] for r in got] == [r[1:] for r in want]
    assert [r[0] for r in got] == [None, 2, 2, 5, 7, 9, 9]
    total = 0
    for shard in manifest.collect():
        own = token_files.Sequences(shard.path)
        assert len(own) == shard.n_sequences
        real = 0
        for k in range(len(own)):
            ids, mask = own[k]
            assert len(ids) == 64 and len(mask) == 8 and not ids.flags.owndata and not mask.flags.owndata
            bits = np.unpackbits(mask, bitorder="little")
            assert (ids[bits == 0] == 0).all()
            real += int(bits.sum())
        assert real == shard.n_ids
        total += real
        assert isinstance(own.source, pa.MemoryMappedFile)
    assert total == sum(r[2] for r in want)
    nothing = token_files.write(frame.limit(0), f"file://{tmp_path}/none", VOCABULARY)
    assert token_files.documents(nothing).collect() == []


def test_added_tokens_are_the_librarys(spark, tmp_path):
    """Against the library as it comes, which reads an added token's literal as that token."""
    library = Tokenizer.from_file(VOCABULARY)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "plain", "", "<|endoftext|><|endoftext|> the\n\n<|endoftext|>x", "<|endoftext", "|>", None, " é<|endoftext|>🙂"]
    want, start = [], 0
    for k, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = token_files.documents(token_files.write(frame, f"file://{tmp_path}/files", VOCABULARY, shards=2))
    assert sorted(map(tuple, got.collect())) == want


def test_sequences_of_a_store_that_is_not_mapped(tmp_path, monkeypatch):
    draw = np.random.default_rng(2)
    writer = token_files.ShardWriter(f"file://{tmp_path}/s/a.arrow", 8, pa.uint16(), pa.int64())
    for k in range(7):
        sizes = draw.integers(1, 900, 4)
        writer.append(pa.array(range(4 * k, 4 * k + 4)), sizes, draw.integers(0, 60000, sizes.sum()))
    writer.close()
    local = token_files.Sequences(f"file://{tmp_path}/s/a.arrow")
    store = SimpleNamespace(from_uri=lambda path: (pa.fs.SubTreeFileSystem(str(tmp_path), pa.fs.LocalFileSystem()), path))
    monkeypatch.setattr(token_files, "fs", SimpleNamespace(FileSystem=store, LocalFileSystem=pa.fs.LocalFileSystem))
    far = token_files.Sequences("s/a.arrow")
    assert not isinstance(far.source, pa.MemoryMappedFile)
    assert len(far) == len(local) == writer.n_sequences > 5 * token_files.BATCH // 4
    for k in draw.permutation(len(local)).tolist():
        assert all((a == b).all() for a, b in zip(far[k], local[k], strict=True))
