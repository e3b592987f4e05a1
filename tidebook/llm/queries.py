"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import (
    bpe,
    decontaminate,
    html_extract,
    jaccard_join,
    lang_id,
    line_dedup,
    multi_index,
    preference,
    runs,
    secret_scan,
    token_files,
    warc,
    whitening,
)
from tidebook.llm.components import kept
from tidebook.session import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.train(docs.where(~held_out()))
    return lang_id.identify(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    ranges = F.transform("removed", lambda r: F.concat_ws("-", r["start"], r["end"]))
    return found.select(
        "doc_id",
        "n_lines",
        n_removed.alias("n_removed"),
        F.array_join(ranges, ",").alias("removed"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.scan(docs, scratch(spark, "blob-ledger")).select("doc_id", "spans")
    base = [r.name for r in secret_scan.BASE]

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    of_base = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id",
        *map(count, base),
        F.sha2(joined_spans(of_base), 256).alias("base_sha256"),
        joined_spans(F.col("spans")).alias("spans"),
    )


def op4_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = preference.conversations(table(spark, sf_dir, "conversations"))
    found = preference.format_pairs(preference.mismatched(turns))

    def text(side: str) -> Column:
        return F.array_join(F.transform(f"{side}_completion", lambda s: s["text"]), "").alias(side)

    def mask(side: str) -> Column:
        runs = F.transform(f"{side}_completion", lambda s: F.concat_ws(":", F.length(s["text"]), s["trained"].cast("int")))
        return F.array_join(runs, ",").alias(f"{side}_mask")

    return found.select(
        "conv_id",
        F.col("n_shared").cast("long").alias("n_shared"),
        "prompt",
        text("chosen"),
        mask("chosen"),
        text("rejected"),
        mask("rejected"),
    )


def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.clusters(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write(table(spark, sf_dir, "pages"), scratch(spark, "warc"))
    fields = F.col("metadata.fields")
    # The archives are read once: without payloads, what they hold is small.
    records = kept(warc.read(manifest).drop("payload"), "records")
    return warc.assemble(records).select(
        F.expr("try_cast(metadata.fields['pageId'] AS bigint)").alias("page_id"),
        F.coalesce("payload_bytes", fields["payloadBytes"].cast("long")).alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.expr("try_cast(split_part(refers_to, ':', 3) AS bigint)").alias("refers_to"),
        (F.col("request.record_id").isNotNull() & F.col("metadata.record_id").isNotNull()).alias("complete"),
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.documents(token_files.write(docs, scratch(spark, "token-files"), vocabulary))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "ids")
    return bpe.decode(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def made_periodic(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth document, by a hash of its id, repeats a part of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size(words), F.floor(h / 10)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), times)), F.lit(1), n - a)
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), repeated), " ")
    return docs.select("doc_id", F.when((h % 10 == 0) & (n > 0), made).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapse(made_periodic(table(spark, sf_dir, "documents")))
    fall = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    top = found.withColumn("top", F.array_max(fall))
    return top.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_preference": op4_preference,
    "op5_multi_index": op5_multi_index,
    "op6_decontamination": op6_decontamination,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_warc": op8_warc,
    "op9_token_files": op9_token_files,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_whitening": op11_whitening,
    "op12_html_extract": op12_html_extract,
    "op13_periodic_runs": op13_periodic_runs,
}
