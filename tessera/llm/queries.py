"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, clusters, credentials, crf, embeddings, licenses, minhash, mixing, pages, pii, rules, search, tokens


#: For the registered query where the session names no secret one: pseudonyms under it can be undone by anybody.
PUBLIC_KEY = "no secret"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), size=2)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, totals = mixing.mix(_table(spark, sf_dir, "documents"))
    joined = rows.withColumn("source", F.col("sources")[0]).join(totals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    return joined.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.find_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "learned")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"), number("learned"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(_table(spark, sf_dir, "documents"))
    start = F.transform("base", lambda b: b["at"])
    end = F.transform("base", lambda b: b["at"])
    base = F.transform("base", lambda b: b["label"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(start).cast("long").alias("first_word"),
        F.array_max(end).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, "labels")), ",").alias("labels"),
        F.greatest("score", F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.lit(0.0))).alias("score"),
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"), spark.conf.get("spark.tessera.pii.key", PUBLIC_KEY))
    number = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", F.size("found").cast("long").alias("n_found"), *(number(k) for k in pii.FORMATS), "found", "text")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.ledger(_table(spark, sf_dir, "documents"))
    base_failed = ~rules.passes(rules.BASE)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & rules.passes(rules.DEFAULT)).alias("kept"), "failed")


def op10_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = crf.train(docs, labels.where(~crf.held_out(F.col("doc_id"))))
    scored = crf.score(docs, model)
    return scored.select("doc_id", crf.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= crf.BORDER).cast("int").alias("predicted"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster_vectors(_table(spark, sf_dir, "embeddings"))


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_mixing": op2_mixing,
    "op3_secrets": op3_secrets,
    "op4_licenses": op4_licenses,
    "op5_pii": op5_pii,
    "op6_tokens": op6_tokens,
    "op7_embeddings": op7_embeddings,
    "op8_bpe": op8_bpe,
    "op9_rules": op9_rules,
    "op10_crf": op10_crf,
    "op11_centroids": op11_centroids,
    "op12_html": op12_html,
    "op13_search": op13_search,
}
