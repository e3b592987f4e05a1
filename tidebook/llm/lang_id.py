"""Language ID by prediction by partial matching.

For each language a variable-order tree of byte contexts, of up to ``ORDER`` bytes, holds how often each byte followed
each context in training texts. A text is scored by its exact code length under each language's frozen counts: a byte
that followed the longest known context n(byte) times costs ``log2((n + d) / n(byte))`` bits (n bytes and d different
ones seen there, escape method C); otherwise the escape costs ``log2((n + d) / d)`` bits and the next shorter context
is asked; below the empty context every byte costs 8 bits. Contexts never seen cost nothing. There are no exclusions.
The language with the shortest code wins; the score is its share if all languages were equally likely beforehand.

Training reads a sample of labelled documents: ``TRAIN_BYTES`` of text in all, the same share for each language, drawn
in pieces of ``PIECE`` characters by a hash of the id and the piece's number, and at least one piece for each language. So
the trees are bounded however large the corpus or one of its texts. Counting is a Spark job; only the counts of the sample
come to the driver. Scoring reads whole texts, and nothing is shuffled.

Rows: null text, or text without a letter, is ``und`` with score 0 and no bits; a null label is not learned from;
ties go to the first language in alphabetical order; repeated rows are scored each (and learned each); without any
labelled text everything is ``und``; other columns stay, except those that the result names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.llm.frames import replaced, small_batches, tidied, with_field
from tidebook.llm.words import in_parts

ORDER = 3
TRAIN_BYTES = 8_000_000
PIECE = 8192
DRAWS = 1 << 40
#: What stands before a text.
BEFORE = b"\n" * ORDER
#: Characters of text that are scored together.
SCORED_CHARS = 500_000
#: Byte sequences whose costs a worker remembers.
REMEMBERED = 500_000
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All sequences of ORDER + 1 bytes, as numbers, of the texts one after the other; where each text's begin and
    end among them (those between two texts belong to none)."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    row = np.frombuffer(b"".join(x for c in coded for x in (BEFORE, c)), np.uint8)
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    begins = np.cumsum(sizes + ORDER) - sizes - ORDER
    codes = np.zeros(max(0, len(row) - ORDER), np.uint32)
    for k in range(ORDER + 1):
        codes = codes << np.uint32(8) | row[k : k + len(codes)]
    return codes, begins, begins + sizes


class Tree:
    """The context tree of one language."""

    def __init__(self, codes: np.ndarray, n: np.ndarray):
        self.levels = []  # from the empty context to the longest: sequences, counts, contexts, totals, different bytes
        for order in range(ORDER + 1):
            own, which = np.unique(codes & np.uint32((1 << 8 * (order + 1)) - 1), return_inverse=True)
            counts = np.bincount(which, n, minlength=len(own))
            contexts, which, different = np.unique(own >> np.uint32(8), return_inverse=True, return_counts=True)
            self.levels.append((own, counts, contexts, np.bincount(which, counts, minlength=len(contexts)), different))

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each sequence after the bytes before it."""
        cost = np.zeros(len(codes))
        left = np.arange(len(codes))
        for order in range(ORDER, -1, -1):
            own, counts, contexts, totals, different = self.levels[order]
            code = codes[left] & np.uint32((1 << 8 * (order + 1)) - 1)
            at, known = place(contexts, code >> np.uint32(8))
            below = left[~known]
            left, code, at = left[known], code[known], at[known]
            both = totals[at] + different[at]
            where, seen = place(own, code)
            cost[left] += np.log2(both / np.where(seen, counts[where], different[at]))
            left = np.sort(np.concatenate([below, left[~seen]]))
        cost[left] += 8
        return cost


def place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Model:
    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.languages = sorted(counts)
        self.trees = [Tree(*counts[x]) for x in self.languages]
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint32)
        self.costs = np.zeros((0, len(self.languages)), np.float32)

    def _costs(self, codes: np.ndarray) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self._forget()
        new = np.sort(codes[~place(self.known, codes)[1]] if len(self.known) else codes)
        if len(new):
            costs = np.stack([t.bits(new) for t in self.trees], 1).astype(np.float32)
            at = np.searchsorted(self.known, new)
            self.known = np.insert(self.known, at, new)
            self.costs = np.insert(self.costs, at, costs, axis=0)
        return self.costs[np.searchsorted(self.known, codes)]

    def bits(self, texts: list[str]) -> np.ndarray:
        """Code length of each text under each language."""
        codes, begins, ends = grams(texts)
        which, different = pd.factorize(codes)
        costs = self._costs(different)
        out = np.empty((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            upto = np.concatenate([[0], np.cumsum(costs[:, k][which], dtype=np.float64)])
            out[:, k] = upto[ends] - upto[begins]
        return out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", train_bytes: int = TRAIN_BYTES) -> Model:
    """Learns from documents with a label; ``doc_id`` only draws the sample."""
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("id"), F.octet_length(text).alias("bytes"))

    def draw(piece: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit("sample"), "id", piece), F.lit(DRAWS))

    pieces = F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / PIECE).cast("int") - 1, F.lit(0)))
    totals = rows.groupBy("lang").agg(F.sum("bytes").alias("bytes"), F.min(F.array_min(F.transform(pieces, draw))).alias("least")).collect()
    share = train_bytes / max(1, len(totals))
    limits = [F.when(F.col("lang") == r.lang, F.lit(max(int(DRAWS * min(1.0, share / max(1, r.bytes))), r.least + 1))) for r in totals]
    limit = F.coalesce(*limits, F.lit(0))
    drawn = F.filter(pieces, lambda k: draw(k) < limit)
    sample = rows.select("lang", "text", drawn.alias("drawn")).where(F.size("drawn") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[str, list[str]] = {}
            for name, whole, numbers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own.setdefault(name, []).extend(whole[k * PIECE : (k + 1) * PIECE] for k in numbers)
            for name, found in sorted(own.items()):
                codes, begins, ends = grams(found)
                edge = np.zeros(len(codes) + 1, np.int8)
                np.add.at(edge, begins, 1)
                np.add.at(edge, ends, -1)
                seen, n = np.unique(codes[np.cumsum(edge[:-1]) > 0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(seen)), pa.array(seen.astype(np.int64)), pa.array(n)], names=["lang", "gram", "n"]
                )

    counted = sample.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = counted.toPandas()  # at most a row for each byte of the sample
    return Model({x: (g["gram"].to_numpy(np.uint32), g["n"].to_numpy(np.float64)) for x, g in found.groupby("lang")})


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``bits`` (code length in the predicted language) and ``bytes``."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("bits", T.DoubleType()), ("bytes", T.LongType())]
    schema = docs.schema
    for name, kind in fields:
        schema = with_field(schema, name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for begin, end in in_parts([t or "" for t in texts], SCORED_CHARS):
                part = texts[begin:end]
                known = [bool(own.languages and t and LETTER.search(t)) for t in part]
                pred, score, bits = [UNKNOWN] * len(part), np.zeros(len(part)), [None] * len(part)
                at = np.flatnonzero(known)
                if len(at):
                    lengths = own.bits([part[k] for k in at])
                    best = lengths.argmin(1)
                    shortest = lengths.min(1)
                    score[at] = 1 / np.exp2(shortest[:, None] - lengths).sum(1)
                    for k, b, n in zip(at.tolist(), best.tolist(), shortest.tolist(), strict=True):
                        pred[k], bits[k] = own.languages[b], n
                sizes = [len((t or "").encode("utf-8", "surrogatepass")) for t in part]
                rows = batch.slice(begin, end - begin)
                for name, column in (("lang_pred", pa.array(pred)), ("score", pa.array(score))):
                    rows = replaced(rows, name, column)
                rows = replaced(rows, "bits", pa.array(bits, pa.float64()))
                yield replaced(rows, "bytes", pa.array(sizes, pa.int64()))
        own._forget()

    return docs.mapInArrow(tidied(run), schema)
