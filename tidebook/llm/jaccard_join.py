"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Documents are sets of word shingles, in one global order, rare ones first. Two sets that are similar enough share at
least ``overlap`` shingles, by their sizes. So their prefixes of ``n - overlap + l`` shingles have at least l in common,
for every l. A prefix longer by one costs more index entries to read but asks for one more match before a pair is
verified; each document takes the l whose estimated cost is least (``levels``), and a pair goes by the smaller l of the
two. Prefixes are stored for the smallest partner that a set can have; what is too long for a pair's own sizes the join
leaves out. Verification compares whole sets.

* The order comes from a table of counts of hashed shingles over all documents, of fixed width. Any order is right.
* Equal sets are one vertex, so copies are never paired with each other.
* Groups of near copies would share nearly all their entries. A first round takes up to ``PILOT`` prefix entries of
  each document, frequent ones if it has any, pairs it only with the document of each entry that has the fewest rare
  shingles, verifies these pairs and finds their components. The full round leaves out pairs inside one component,
  which another link could not change; it loses no link between classes.

Rows: a document without words has an empty set, size 0, and stays alone; rows with a null id get a size but no
component; rows that share an id are one vertex (linked as soon as any of them is); an empty table gives an empty
result; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.components import components, kept
from tidebook.llm.frames import small_batches, tidied

SHINGLE = 5
THRESHOLD = 75
LEVELS = 6
PILOT = 8
#: Slots of the table of counts, and those that one row of it holds.
WIDTH = 1 << 20
ROW = 1 << 12
#: Bits of the table that says which documents are in a pair.
MEMBERS = 1 << 23
#: What verifying a pair costs for each shingle of the document, in index entries read.
VERIFY = 0.1

LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
ODD = np.uint64(0x9E3779B97F4A7C15)


#: Bytes of text that are hashed together; a longer text is hashed by itself.
HASHED = 1 << 21
#: What each byte stands for in a word's hash, and what its place in the word does.
BYTES = np.random.default_rng(17).integers(1, 1 << 63, 256, np.uint64)
PLACE = np.uint64(0xD1342543DE82EF95)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def is_space(row: np.ndarray) -> np.ndarray:
    return (row == 32) | ((row >= 9) & (row <= 13))


def word_hashes(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a row of bytes begin, and 64-bit hashes of them: bytes by their places, added up and mixed.
    Words are runs without ASCII white space. Long rows are cut at the next space after so many bytes."""
    found, begin = [], 0
    while begin < len(row) or not found:
        end = min(begin + HASHED, len(row))
        while end < len(row):
            near = np.flatnonzero(is_space(row[end : end + ROW]))
            end = min(end + (int(near[0]) if len(near) else ROW), len(row))
            if len(near):
                break
        begins, h = _word_hashes(row[begin:end])
        found.append((begins + begin, h))
        begin = max(end, 1)
    return tuple(map(np.concatenate, zip(*found, strict=True)))


def _word_hashes(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = is_space(row)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    begins, ends = edges[::2], edges[1::2]
    if not len(begins):
        return begins, np.zeros(0, np.uint64)
    sizes = ends - begins
    own = np.flatnonzero(~space)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(own)) - np.repeat(first, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), PLACE))
    return begins, mixed(np.add.reduceat(BYTES[row[own]] * powers[place], first) + sizes.astype(np.uint64))


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """For each text the hashes of its distinct shingles, sorted. A to Z are lower-cased; fewer words than ``size`` are
    one shingle."""
    out: list[np.ndarray] = []
    coded: list[bytes] = []
    held = 0
    for k, text in enumerate(texts):
        coded.append((text or "").encode("utf-8", "surrogatepass"))
        held += len(coded[-1])
        if held >= HASHED or k == len(texts) - 1:
            out += _sets(coded, size)
            coded, held = [], 0
    return out


def _sets(coded: list[bytes], size: int) -> list[np.ndarray]:
    row = np.frombuffer(b"\n".join(coded).translate(LOWER), np.uint8)
    begins, h = word_hashes(row)
    text_begins = np.cumsum([0, *(len(c) + 1 for c in coded)])
    cuts = np.searchsorted(begins, text_begins).tolist()
    whole = np.full(max(0, len(h) - size + 1), np.uint64(size), np.uint64)
    for k in range(size):
        whole = whole * ODD + h[k : k + len(whole)]
    whole = mixed(whole)
    out = []
    for begin, end in pairwise(cuts):
        if end - begin >= size:
            out.append(np.unique(whole[begin : end - size + 1]))
        elif end == begin:
            out.append(np.zeros(0, np.uint64))
        else:
            short = np.full(1, np.uint64(end - begin), np.uint64)
            for k in range(begin, end):
                short = short * ODD + h[k]
            out.append(mixed(short))
    return out


def least(n, threshold: int = THRESHOLD, of: int = 100):
    """Shingles that a set of n shares at least with any partner; with ``of`` 100 more than ``threshold``, and n the
    sum of their sizes, those that two sets share at least."""
    return -(-threshold * n // of)


def _added_up(rows: DataFrame, width: int, op: Callable, kind: str) -> np.ndarray:
    """Rows of (slot, values), combined by slot: each task keeps one array for each of its slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            values = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            for slot, own in zip(batch.column(0).to_pylist(), values, strict=True):
                total[slot] = op(total[slot], own) if slot in total else own.copy()
        for slot, own in total.items():
            yield table_row(slot, own)

    out = np.zeros(width, kind)
    for r in rows.repartition("slot").mapInArrow(run, "slot int, held array<long>").toLocalIterator():
        out[r.slot * len(r.held) : (r.slot + 1) * len(r.held)] = r.held
    return out


def table_row(slot: int, values: np.ndarray) -> pa.RecordBatch:
    held = pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values.astype(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), held], names=["slot", "held"])


def in_slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def set_mark(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def slots(hashes: np.ndarray, width: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)


def survey(docs: DataFrame, size: int, width: int = WIDTH) -> tuple[DataFrame, np.ndarray]:
    """One reading of all documents: (doc_id, n, mark), mark a 128-bit fingerprint of the set; and how many documents
    have a shingle in each slot, an upper bound for each shingle, of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in in_slices(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), size)
            total += np.bincount(slots(np.concatenate([*sets, np.zeros(0, np.uint64)]), width), minlength=width)
            n = pa.array(list(map(len, sets)), pa.int64())
            marks = pa.array([set_mark(s) for s in sets], pa.binary())
            none = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), n, marks, *none], names=names)
        for slot, own in enumerate(total.reshape(-1, ROW)):
            if own.any():
                none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, *table_row(slot, own).columns], names=names)

    names = ["doc_id", "n", "mark", "slot", "held"]
    both = kept(docs.mapInArrow(tidied(run), "doc_id long, n long, mark binary, slot int, held array<long>"), "survey")
    table = _added_up(both.where("slot is not null").select("slot", "held"), width, np.add, "int64")
    return both.where("slot is null").select("doc_id", "n", "mark"), np.minimum(table, 2**31 - 1).astype(np.int32)


def levels(freq: np.ndarray, first: int, most: int, n: int) -> int:
    """The level with the least estimated cost; ``freq``: of the document's shingles in their order, ``first``: length
    of the prefix of level 1 for a partner of the same size. A candidate of level l took l entries, so there are at most
    a l-th as many."""
    read = np.cumsum(freq)[first - 1 : first - 1 + most]
    cost = read + VERIFY * n * read / np.arange(1, len(read) + 1)
    return 1 + int(np.argmin(cost))


def prefixes(docs: DataFrame, table, marked, size: int, threshold: int, most: int) -> DataFrame:
    """doc_id, n, level, the prefix of level ``most``, some entries of it for the first round (``pilot``), how many
    entries nobody else seems to have (``rare``), and the fingerprint of the set if ``marked`` may hold the document
    (``mark``), for every document with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot_counts = table.value
        usual = int(np.median(slot_counts))
        often = usual + 4 * int(np.sqrt(usual)) + 1
        for batch in in_slices(batches):
            ids, n, level, rare, prefix, pilot, mark = [], [], [], [], [], [], []
            held = in_table(marked.value, batch.column(2)).tolist()
            sets = shingle_sets(batch.column(1).to_pylist(), size)
            for doc_id, own, known in zip(batch.column(0).to_pylist(), sets, held, strict=True):
                if not len(own):
                    continue
                mark.append(set_mark(own) if known else None)
                freq = slot_counts[slots(own, len(slot_counts))]
                order = np.argsort(freq, kind="stable")
                own, freq = own[order], freq[order]
                shared = int(least(len(own), threshold))
                first, top = len(own) - shared + 1, min(most, shared)
                ids.append(doc_id)
                n.append(len(own))
                alike = len(own) - int(least(2 * len(own), threshold, 100 + threshold)) + 1
                level.append(levels(np.maximum(freq - usual, 1), alike, top, len(own)))
                prefix.append(own[: first + top - 1])
                rare.append(int((freq[: len(prefix[-1])] <= often).sum()))
                common = prefix[-1][rare[-1] :]
                pilot.append(np.sort(common if len(common) else prefix[-1])[:PILOT])
            columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(level, pa.int32()), pa.array(rare, pa.int32())]
            columns += [lists_of(prefix), lists_of(pilot), pa.array(mark, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n", "level", "rare", "prefix", "pilot", "mark"]
    schema = "doc_id long, n long, level int, rare int, prefix array<long>, pilot array<long>, mark binary"
    return docs.select("doc_id", "text", F.xxhash64("doc_id")).mapInArrow(tidied(run), schema)


def lists_of(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def marked_ids(ids: DataFrame) -> np.ndarray:
    """A table of bits, of fixed size, that has all the ids (one column), and by chance some others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(MEMBERS, bool)
        for batch in batches:
            bits[batch.column(0).to_numpy().view(np.uint64) % np.uint64(MEMBERS)] = True
        for slot, own in enumerate(np.packbits(bits).view(np.int64).reshape(-1, ROW)):
            if own.any():
                yield table_row(slot, own)

    rows = ids.select(F.xxhash64(*ids.columns)).mapInArrow(run, "slot int, held array<long>")
    return _added_up(rows, MEMBERS // 64, np.bitwise_or, "int64")


def in_table(table: np.ndarray, hashes: pa.Array) -> np.ndarray:
    at = hashes.to_numpy().view(np.uint64) % np.uint64(MEMBERS)
    return table.view(np.uint8)[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1 == 1


def _members(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The documents that may be in a pair, and by chance some others."""
    table = marked_ids(pairs.select(F.explode(F.array("a", "b")).alias("id")))
    held = docs.sparkSession.sparkContext.broadcast(table)

    def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = pa.array(in_table(held.value, batch.column(2)))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["doc_id", "text"]).filter(known)

    known = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id"))
    return known.mapInArrow(tidied(among), "doc_id long, text string")


def verified(pairs: DataFrame, docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets are similar enough."""
    texts = _members(pairs, docs)
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 200):
            keep = []
            texts = batch.column(3).to_pylist()
            new = [k for k, t in enumerate(texts) if not k or t != texts[k - 1]]  # pairs of one partner come together
            partners = shingle_sets([texts[k] for k in new], size)
            at = np.cumsum(np.isin(np.arange(len(texts)), new)) - 1
            for x, which in zip(shingle_sets(batch.column(2).to_pylist(), size), at.tolist(), strict=True):
                y = partners[which]
                both = np.sort(np.concatenate([x, y]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(common > 0 and 100 * common >= threshold * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(tidied(run), "a long, b long")


def _entries(sets: DataFrame) -> DataFrame:
    """A row for each prefix entry, with its place in the order."""
    return sets.select("doc_id", "class", "n", "level", F.posexplode("prefix").alias("pos", "token"))


def links(
    docs: DataFrame, members: DataFrame, counts: np.ndarray, size: int = SHINGLE, threshold: int = THRESHOLD, most: int = LEVELS
) -> DataFrame:
    """Verified links (a, b) that connect all documents which similarity connects, one document for each set."""
    table = docs.sparkSession.sparkContext.broadcast(counts)
    copies = kept(members.where("doc_id <> rep").select("doc_id", "mark").distinct(), "copies")
    marked = docs.sparkSession.sparkContext.broadcast(marked_ids(copies.select("doc_id")))
    sets = kept(prefixes(docs.where("doc_id is not null"), table, marked, size, threshold, most), "prefixes")
    table.unpersist()
    marked.unpersist()
    # An id may stand for several texts; only those that are copies of another id's are left out.
    some = sets.where("mark is not null").join(copies, ["doc_id", "mark"], "left_anti")
    sets = sets.where("mark is null").unionByName(some).drop("mark")

    pilot = sets.select("doc_id", "rare", F.explode("pilot").alias("token"))
    hub = F.min(F.struct("rare", "doc_id"))["doc_id"].alias("b")
    hubs = kept(pilot.groupBy("token").agg(hub, F.count("*").alias("f")).where("f > 1").drop("f"), "hubs")
    near = pilot.join(hubs, "token").where("doc_id <> b")
    near = near.select(F.greatest("doc_id", "b").alias("a"), F.least("doc_id", "b").alias("b")).distinct()
    found = kept(verified(kept(near, "pilot-pairs"), docs, size, threshold), "pilot-links")
    classes = components(found)

    sets = sets.join(classes.withColumnRenamed("vertex", "doc_id"), "doc_id", "left")
    sets = sets.withColumn("class", F.coalesce("component", "doc_id")).select("doc_id", "n", "level", "class", "prefix")
    r, s = _entries(sets).alias("r"), _entries(sets).alias("s")
    larger = F.struct("r.n", "r.doc_id") > F.struct("s.n", "s.doc_id")
    # Of two sets that share so much, either prefix of n - overlap + level has at least level shingles of the other's.
    overlap = F.ceil((F.col("r.n") + F.col("s.n")) * threshold / (100 + threshold))
    level = F.least("r.level", "s.level")
    inside = (F.col("r.n") - F.col("r.pos") > overlap - level) & (F.col("s.n") - F.col("s.pos") > overlap - level)
    pairs = (
        r.join(s, F.col("r.token") == F.col("s.token"))
        .where(larger & (F.col("r.class") != F.col("s.class")) & (F.col("s.n") * 100 >= F.col("r.n") * threshold))
        .where(inside)
        .groupBy(F.col("r.doc_id").alias("a"), F.col("s.doc_id").alias("b"))
        .agg(F.count("*").alias("shared"), F.max(level).alias("level"))
        .where("shared >= level")
        .select("a", "b")
    )
    more = verified(kept(pairs, "pairs"), docs, size, threshold)
    return found.unionByName(kept(more, "links"))


def clusters(
    docs: DataFrame, size: int = SHINGLE, threshold: int = THRESHOLD, most: int = LEVELS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, and component_id, the smallest doc_id reachable by links, for every row of ``docs``."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    marked, counts = survey(docs, size)
    reps = marked.where("n > 0 and doc_id is not null").groupBy("mark").agg(F.min("doc_id").alias("rep"))
    members = kept(marked.join(kept(reps, "classes"), "mark", "left"), "members")
    span = members.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("top"))
    several = members.join(span.where("b <> top"), "doc_id").select(F.col("rep").alias("a"), "b")
    found = components(links(docs, members, counts, size, threshold, most).unionByName(several))
    joined = members.join(found.withColumnRenamed("vertex", "rep"), "rep", "left")
    own = F.coalesce("component", F.when(F.col("n") > 0, F.col("rep")), "doc_id")
    return joined.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id")
    )
