"""Token ids on disk: Arrow stream-file format with fixed-size-list batches.

All ids of a corpus, in ascending order of document, form one row of ids, cut into shards. A shard is an Arrow IPC
file: each row is a sequence of ``length`` ids and the mask of those that are real (one bit each, lowest bit first;
only a shard's last sequence is filled up, with id 0). Batches hold fixed-size lists, so in a memory-mapped file any
sequence and its mask is a slice of the mapped bytes: nothing is decoded or copied. Files of other stores are read by
ranges, the batch of a sequence at a time; all batches of a shard but the last are of equal length. Beside each shard stands a second
Arrow file with a row for each document: its id, where its ids begin in the shard, how many there are.

A task writes under a name of its own attempt; only the manifest, a Parquet table that Spark commits, says which
files count. A task that is run again, after a lost executor or beside a slow one, therefore leaves no half results.

Rows: null text counts as the empty text; a null id orders first; repeated rows are written each, those of one id in
the order of a hash of their texts; an empty table gives an empty manifest. Other columns are not stored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator, Sequence
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidebook.llm.frames import tidied
from tidebook.llm.words import PATTERN, Encoder, in_parts, splitter

LENGTH = 1024
BATCH = 256
#: Words that a worker remembers.
REMEMBERED = 500_000
MANIFEST = "shard int, path string, n_docs long, n_ids long, n_sequences long"


class WholeTexts(Encoder):
    """Texts that hold an added token of the vocabulary go whole to the library, which cuts them there before its
    pattern does; no word of another text holds one."""

    def __init__(self, tokenizer: Tokenizer):
        def solve(new: list[str]) -> list[list[int]]:
            return [e.ids for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)]

        super().__init__(splitter(PATTERN), solve, REMEMBERED)
        added = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = [k for k, t in enumerate(texts) if self.added and self.added.search(t)]
        if not whole:
            return super().encode(texts)
        rest = list(texts)
        for k in whole:
            rest[k] = ""
        sizes, flat = super().encode(rest)
        found = self.solve([texts[k] for k in whole])
        own = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.insert(flat, np.repeat(np.cumsum(sizes)[whole], own), np.concatenate([np.array(f, flat.dtype) for f in found]))
        sizes[whole] = own
        return sizes, flat


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """The tokenizers library behind a memory of words; one for each worker process.

    A byte-level tokenizer without added prefix encodes the words of its pattern each by itself, so encoding every
    new word once gives the ids of encoding whole texts, but for those with added tokens. Tasks share the cores already: the library's own threads
    would only get in each other's way.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WholeTexts(Tokenizer.from_str(vocabulary))


class ShardWriter:
    """One shard: ids are appended in order, full batches go to the file at once."""

    def __init__(self, path: str, length: int, kind: pa.DataType, doc_kind: pa.DataType):
        store, at = fs.FileSystem.from_uri(path)
        store.create_dir(at.rpartition("/")[0], recursive=True)
        self.length, self.kind = length, kind
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.uint8(), length // 8))], metadata={"batch": str(BATCH)})
        self.docs = pa.schema([("doc_id", doc_kind), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [store.open_output_stream(at), store.open_output_stream(at + ".docs")]
        self.files = [ipc.new_file(self.sinks[0], self.schema), ipc.new_file(self.sinks[1], self.docs)]
        self.pending: list[np.ndarray] = []
        self.waiting = self.n_docs = self.n_ids = self.n_sequences = 0

    def append(self, doc_ids: pa.Array, sizes: np.ndarray, flat: np.ndarray) -> None:
        starts = self.n_ids + np.cumsum(sizes) - sizes
        columns = [doc_ids, pa.array(starts), pa.array(sizes.astype(np.int64))]
        self.files[1].write_batch(pa.RecordBatch.from_arrays(columns, schema=self.docs))
        self.n_docs += len(sizes)
        self.n_ids += len(flat)
        self.pending.append(flat.astype(self.kind.to_pandas_dtype()))
        self.waiting += len(flat)
        if self.waiting >= BATCH * self.length:
            row = np.concatenate(self.pending)
            full = len(row) // (BATCH * self.length) * BATCH * self.length
            self._write(row[:full], full)
            self.pending, self.waiting = [row[full:]], len(row) - full

    def _write(self, row: np.ndarray, real: int) -> None:
        mask = np.packbits(np.arange(len(row)) < real, bitorder="little")
        lists = [
            pa.FixedSizeListArray.from_arrays(pa.array(row), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length // 8),
        ]
        batch = pa.RecordBatch.from_arrays(lists, schema=self.schema)
        for begin in range(0, batch.num_rows, BATCH):
            self.files[0].write_batch(batch.slice(begin, BATCH))
        self.n_sequences += batch.num_rows

    def close(self) -> None:
        row = np.concatenate([*self.pending, np.zeros(0, self.kind.to_pandas_dtype())])
        if real := len(row):
            row = np.concatenate([row, np.zeros(-real % self.length, row.dtype)])
            self._write(row, real)
        for f in [*self.files, *self.sinks]:
            f.close()


class Sequences:
    """Random access to a shard's sequences; over a mapped file without copies, elsewhere by reading their batch."""

    def __init__(self, path: str):
        store, at = fs.FileSystem.from_uri(path)
        local = isinstance(store, fs.LocalFileSystem)
        self.source = pa.memory_map(at) if local else store.open_input_file(at)
        self.file = ipc.open_file(self.source)
        self.last: tuple[int, pa.RecordBatch | None] = (-1, None)
        self.equal = not local and int((self.file.schema.metadata or {}).get(b"batch", 0))

    @cached_property
    def ends(self) -> np.ndarray:
        """Sequences up to the end of each batch; of a file that isn't mapped, only the last batch is read for it."""
        n = self.file.num_record_batches
        if self.equal and n:
            return np.append(np.arange(1, n) * self.equal, (n - 1) * self.equal + self._batch(n - 1).num_rows)
        return np.cumsum([self.file.get_batch(k).num_rows for k in range(n)])

    def _batch(self, k: int) -> pa.RecordBatch:
        if self.last[0] != k:
            self.last = (k, self.file.get_batch(k))
        return self.last[1]

    def __len__(self) -> int:
        return int(self.ends[-1]) if len(self.ends) else 0

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask bits of sequence k, as views of the file or of its batch."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        number = int(np.searchsorted(self.ends, k, "right"))
        batch = self._batch(number)
        row = k - (int(self.ends[number - 1]) if number else 0)
        ids, mask = (batch.column(c).slice(row, 1).flatten().to_numpy(zero_copy_only=True) for c in ("ids", "mask"))
        return ids, mask

    def chunks(self) -> Iterator[np.ndarray]:
        """The real ids, batch after batch."""
        for k in range(self.file.num_record_batches):
            batch = self._batch(k)
            ids = batch.column("ids").flatten().to_numpy()
            mask = batch.column("mask").flatten().to_numpy()
            if mask[-1] != 255:
                ids = ids[np.unpackbits(mask, bitorder="little").astype(bool)]
            yield ids


def write(
    frame: DataFrame,
    folder: str,
    vocabulary_path: str,
    end_id: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    shards: int | None = None,
) -> DataFrame:
    """Encodes the texts and writes the shards; returns the manifest. The vocabulary, read once by the driver, is of
    fixed size. Ids take two bytes where the vocabulary allows it. Rows are dealt out by range of (id, hash of text)."""
    if length % 8:
        raise ValueError("the length of sequences is a multiple of 8")
    with open(vocabulary_path, encoding="utf-8") as f:
        content = f.read()
    spark = frame.sparkSession
    vocabulary = spark.sparkContext.broadcast(content)
    kind = pa.uint16() if Tokenizer.from_str(content).get_vocab_size() <= 1 << 16 else pa.uint32()
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    attempt = uuid.uuid4().hex[:8]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary.value)
        shard = TaskContext.get().partitionId()
        path = f"{folder}/shards/{attempt}-{shard:06d}-{uuid.uuid4().hex[:8]}.arrow"
        writer = None
        for batch in batches:
            writer = writer or ShardWriter(path, length, kind, batch.schema.field(0).type)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for begin, end in in_parts(texts):
                sizes, flat = own.encode(texts[begin:end])
                with_end = np.insert(flat, np.cumsum(sizes), end_id)
                writer.append(batch.column(0).slice(begin, end - begin), sizes + 1, with_end)
        if writer:
            writer.close()
            row = [shard, path, writer.n_docs, writer.n_ids, writer.n_sequences]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, [pa.int32(), pa.string(), *[pa.int64()] * 3], strict=True)],
                names=["shard", "path", "n_docs", "n_ids", "n_sequences"],
            )

    rows = frame.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    key = ["doc_id", F.xxhash64("text")]
    manifest = rows.repartitionByRange(n, *key).sortWithinPartitions(*key).mapInArrow(tidied(run), MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def documents(manifest: DataFrame) -> DataFrame:
    """Read back: a row for each document with ``start`` (ids of all documents before it), ``n_tokens`` and
    ``ids_crc32`` of its ids as little-endian unsigned 32-bit integers. The manifest has one row for each shard."""
    spark = manifest.sparkSession
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                yield from read_shard(path, base)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return placed.select("path", "base").repartition(n).mapInArrow(tidied(run), schema)


def read_shard(path: str, base: int) -> Iterator[pa.RecordBatch]:
    ids = Sequences(path).chunks()
    store, at = fs.FileSystem.from_uri(path)
    held, held_from = np.zeros(0, np.uint16), 0
    with store.open_input_file(at + ".docs") as source:
        index = ipc.open_file(source)
        for k in range(index.num_record_batches):
            docs = index.get_batch(k)
            sums = []
            for start, n in zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True):
                if start + n > held_from + len(held):
                    parts = [held[start - held_from :]]
                    held_from = start
                    while sum(map(len, parts)) < n:
                        parts.append(next(ids))
                    held = np.concatenate(parts)
                own = held[start - held_from : start - held_from + n]
                sums.append(zlib.crc32(own.astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [
                    docs.column("doc_id").cast(pa.int64()),
                    pa.array(docs.column("start").to_numpy() + base),
                    docs.column("n_tokens"),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )
