"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by its content: the SHA-256 of its text is its blob. The ledger is a Parquet
folder with a row for each blob and rule version that has been scanned, with the spans found (often none). A scan
looks up which pairs of blob and rule version the ledger lacks, reads the text of only those blobs, once each, appends
what it finds, and joins the findings back to all paths. A new version of a rule leaves the other rules' entries as
they are; a path that comes back to an old content costs nothing.

Positions are in code points. Spark gives the texts of a pattern's matches and, by splitting, the texts between them;
a running sum over their lengths, per blob and rule, gives the places. Only matches are exploded, never texts.

Copies: one text of each blob is kept map-side before the shuffle. Paths are joined with findings on the blob; both
sides are read from files or scans, so that Spark can split a blob that a third of all paths hold.

Rows: null text counts as the empty text; null and repeated paths are reported each; an empty table gives an empty
result; other columns stay, except that ``spans`` replaces a column of that name. A failed or repeated append may leave
a pair in the ledger twice; readers take one.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.components import kept
from tidebook.llm.marks import marks_of, with_marks

LEDGER = "blob string, rule string, version int, spans array<struct<start:long,end:long>>"


class Rule(NamedTuple):
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group`` has at least ``least`` characters.
    ``hint`` matches in every text in which the pattern does, and is quicker to look for."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hint: str = ""


#: The base kinds, in the order in which findings at one place are listed.
BASE = (
    Rule(
        "assign",
        1,
        r"""(?:((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""",
        2,
        6,
        "(?i)pass|secret|token|api_?key",
    ),
    Rule("access", 1, r"(AKIA[A-Z0-9]+)", 1, 20, "AKIA"),
    Rule("hex", 1, r"([0-9a-f]+)", 1, 24, "[0-9a-f]{24}"),
)
#: What the base kinds don't cover: headers of private keys, and tokens of three parts.
MORE = (
    Rule("pem", 1, r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 0, "-----BEGIN "),
    Rule("jwt", 1, r"(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 1, 0, "eyJ"),
)
RULES = BASE + MORE


def blob(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def _matches(rule: Rule) -> Column:
    """(gap, size, measured) for each match: characters since the match before, of the match, of the group."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split("text", rule.pattern, -1), F.length)
    sizes = F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), F.length)
    measured = F.transform(F.regexp_extract_all("text", pattern, F.lit(rule.group)), F.length)
    found = F.arrays_zip(F.slice(gaps, 1, F.size(sizes)).alias("gap"), sizes.alias("size"), measured.alias("measured"))
    none = F.lit(None).cast("array<struct<gap:int,size:int,measured:int>>")
    return F.when(F.col("text").rlike(rule.hint) & F.array_contains("rules", rule.name), found).otherwise(none)


def find(texts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule, version, spans) for every blob of ``texts`` (blob, text, rules) and each rule named in its
    ``rules``."""
    version = F.create_map(*(F.lit(x) for r in rules for x in (r.name, r.version)))
    least = F.create_map(*(F.lit(x) for r in rules for x in (r.name, r.least)))
    found = F.map_from_arrays(F.array(*(F.lit(r.name) for r in rules)), F.array(*(_matches(r) for r in rules)))
    per_rule = texts.select("blob", found.alias("found"), "rules").select(
        "blob", F.explode("rules").alias("rule"), F.col("found")[F.col("rule")].alias("matches")
    )
    rows = per_rule.select("blob", "rule", F.posexplode_outer("matches").alias("k", "m"))
    upto = Window.partitionBy("blob", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(upto)
    spans = rows.select("blob", "rule", "m", end.alias("end"))
    ok = F.col("m.measured") >= least[F.col("rule")]
    span = F.when(ok, F.struct((F.col("end") - F.col("m.size")).alias("start"), F.col("end").alias("end")))
    return spans.groupBy("blob", "rule").agg(F.array_sort(F.collect_list(span)).alias("spans")).select(
        "blob", "rule", version[F.col("rule")].alias("version"), "spans"
    )


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...], text: str) -> DataFrame:
    """(blob, text, rules): each blob once, with the names of the rules whose version the ledger lacks for it. The ledger is
    asked for hashes alone; only then are texts fetched, those of blobs that it may lack something for."""
    blobs = versions.select(blob(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    once = F.first("text").alias("text")
    if ledger is None:
        return blobs.groupBy("blob").agg(once).withColumn("rules", F.array(*(F.lit(r.name) for r in rules)))
    wanted = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules))
    done = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("done"))
    left = versions.select(blob(text).alias("blob")).distinct().join(done, "blob", "left")
    todo = F.when(F.col("done").isNull(), wanted).otherwise(F.array_except(wanted, F.coalesce("done", F.array())))
    need = left.select("blob", F.transform(todo, lambda x: x["rule"]).alias("rules")).where(F.size("rules") > 0)
    need = kept(need, "unseen")
    texts = with_marks(blobs, "blob", marks_of(need, "blob"), "_held").where("_held").groupBy("blob").agg(once)
    return texts.join(need, "blob")


def scan(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Brings the ledger up to date and returns ``versions`` with ``spans``: (start, end, kind) of all findings, sorted
    by start, then in the order of the rules."""
    spark = versions.sparkSession
    ledger = spark.read.schema(LEDGER).parquet(ledger_path) if _exists(spark, ledger_path) else None
    find(unseen(versions, ledger, rules, text), rules).write.mode("append").parquet(ledger_path)

    order = F.create_map(*(F.lit(x) for k, r in enumerate(rules) for x in (r.name, k)))
    current = [(F.col("rule") == r.name) & (F.col("version") == r.version) for r in rules]
    any_of = current[0]
    for c in current[1:]:
        any_of |= c
    rows = spark.read.schema(LEDGER).parquet(ledger_path).where(any_of & (F.size("spans") > 0))
    rows = rows.select("blob", "rule", F.explode("spans").alias("s"))
    span = F.struct(F.col("s.start").alias("start"), order[F.col("rule")].alias("o"), F.col("s.end").alias("end"), F.col("rule").alias("kind"))
    found = rows.groupBy("blob").agg(F.array_sort(F.collect_set(span)).alias("f"))
    found = kept(found, "findings")
    paths = versions.drop("spans").withColumn("_blob", blob(text))
    joined = paths.join(found.withColumnRenamed("blob", "_b"), F.col("_blob") == F.col("_b"), "left")
    plain = F.transform("f", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    return joined.withColumn("spans", F.coalesce(plain, none)).drop("_blob", "_b", "f")


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
