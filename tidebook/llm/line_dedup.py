"""Line dedup over overlapping three-line windows, in DataFrame functions only.

Each document is a list of lines. Every window of ``WINDOW`` consecutive lines is hashed (128 bits, of the trimmed
lines); windows that occur more than once anywhere have one first occurrence, the smallest by (id, hash of the text,
line), and all others are later ones. The lines that later occurrences cover are merged into ranges and removed.
A removed line always stands in an equal window that comes earlier, so some equal line is kept.

Windows of blank lines only count for nothing, and a document with fewer lines than a window has no window and is
kept whole.

How it scales: counting windows is an aggregation with map-side combine; a window that stands in a third of all
documents is one row of it. Later occurrences are found by a join of windows with the repeated ones' first places, which
are read from a written table, so that Spark may split a hot window over tasks. No group is ever collected but one
document's own lines.

Rows: null text stays null with 0 lines; a null id orders first; rows that share id and text are one document to the
order and are treated alike (neither is a later occurrence of the other); an empty table gives an empty result; other
columns stay, except that ``n_lines``, ``removed`` and the text itself replace columns of these names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.components import kept

WINDOW = 3


def _hashes(lines: Column, window: int) -> Column:
    """A struct of two 64-bit hashes for each window; null for windows of blank lines."""

    def one(start: Column) -> Column:
        # Lengths keep the boundaries between lines.
        own = F.transform(F.slice(lines, start, window), lambda x: F.trim(x))
        both = F.concat(F.array_join(F.transform(own, F.length), ","), F.lit("\n"), F.array_join(own, "\n"))
        filled = F.exists(own, lambda x: x != "")
        return F.when(filled, F.struct(F.xxhash64(both).alias("h"), F.xxhash64(F.lit(1), both).alias("g")))

    return F.transform(F.sequence(F.lit(1), F.size(lines) - window + 1), one)


def repeated_lines(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, starts): the first lines, counted from 0, of each document's later occurrences, sorted. ``mark``
    is a hash of the text, which tells documents of one id apart."""
    lines = F.split(text, "\n", -1)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), lines.alias("lines"))
    rows = rows.where(F.size("lines") >= window)
    rows = rows.select("doc_id", "mark", F.posexplode(_hashes(F.col("lines"), window)).alias("line", "window"))
    windows = rows.where("window is not null").select(
        F.col("window.h").alias("h"), F.col("window.g").alias("g"), F.struct("doc_id", "mark", "line").alias("place")
    )
    first = windows.groupBy("h", "g").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    first = kept(first.where("first <> last").select("h", "g", "first"), "repeated-windows")
    later = windows.join(first, ["h", "g"]).where("place <> first").select("place.*")
    return later.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("line")).alias("starts"))


def covered(starts: Column, window: int = WINDOW) -> Column:
    """Ranges of lines, ends exclusive, that the windows at these sorted places cover together."""
    begins = F.filter(starts, lambda x, k: (k == 0) | (x - F.element_at(starts, F.greatest(k, F.lit(1))) > window))
    last = F.size(starts) - 1
    following = lambda k: F.element_at(starts, F.least(k + 2, F.size(starts)))
    ends = F.filter(starts, lambda x, k: (k == last) | (following(k) - x > window))
    return F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), (b + window).alias("end")))


def dedup(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text without the lines that repeat earlier ones, ``n_lines`` (before) and ``removed``, the
    ranges of lines taken out."""
    empty = F.array().cast("array<struct<start:int,end:int>>")
    found = repeated_lines(docs, window, doc_id, text)
    found = found.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), covered(F.col("starts"), window).alias("_cut"))
    own = docs.drop("n_lines", "removed").withColumn("_own", F.xxhash64(text))
    joined = own.join(found, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_mark")), "left")
    lines, cut = F.split(text, "\n", -1), F.col("_cut")

    def before(k: Column) -> Column:
        """The lines between the range before range k and range k; k may be one past the last."""
        start = F.when(k == 0, F.lit(0)).otherwise(F.element_at(cut, F.greatest(k, F.lit(1)))["end"])
        end = F.when(k == F.size(cut), F.size("_lines")).otherwise(F.element_at(cut, F.least(k + 1, F.size(cut)))["start"])
        return F.slice("_lines", start + 1, end - start)

    rest = F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut)), before))
    return (
        joined.withColumn("_lines", lines)
        .withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size("_lines")).cast("long"))
        .withColumn("removed", F.coalesce(cut, empty))
        .withColumn(text, F.when(cut.isNull(), F.col(text)).otherwise(F.array_join(rest, "\n")))
        .drop("_own", "_id", "_mark", "_cut", "_lines")
    )
