"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A store is a folder of committed batches. A batch holds changes (doc_id, op, source, lang, text), op being
insert, delete or revise, for one tokenizer version. Its document rows say what each change replaced
(the state after earlier batches) and what holds now; its totals are the signed sums of those rows. Totals
of all batches add up to the rollup, so no batch ever reads old texts or counts again.

Both parts of a batch are written whole or not at all, the totals last: a batch with totals is committed, and
committing its number again changes nothing; one broken off before is done anew from what is there.

An insert of a known document is a revision, a delete of an unknown one changes nothing; of several changes
of one document in a batch, one counts: delete before revise before insert, then the largest count and
source. Null text has no tokens. A null doc_id is one document like any other; null source or language
are groups of their own. Other columns are ignored.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepoint.llm.catalog import query
from tidepoint.llm.common import new_folder, table

TOKENIZERS = "/opt/tokenizers"
# Fixed value: the word pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEY = ["source", "lang", "tokenizer"]
TOTALS = "source string, lang string, tokenizer string, docs_in long, docs_out long, tokens_in long, tokens_out long"


def count_tokens(docs: DataFrame, vocabulary: str, folder: str = TOKENIZERS) -> DataFrame:
    """doc_id, op, source, lang, tokens for `docs` (doc_id, op, source, lang, text)."""
    def run(batches):
        import tiktoken

        with open(f"{folder}/{vocabulary}", "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        coder = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            tokens = [len(coder.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "op", "source", "lang")] + [pa.array(tokens, pa.int64())],
                ["doc_id", "op", "source", "lang", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "op", "source", "lang", "text")
    return rows.mapInArrow(run, "doc_id long, op string, source string, lang string, tokens long")


def _has(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def state(spark: SparkSession, store: str, batches: list[int]) -> DataFrame | None:
    """doc_id, tokenizer, source, lang, tokens of every live document after `batches`."""
    if not batches:
        return None
    rows = spark.read.option("basePath", f"{store}/documents").parquet(*[f"{store}/documents/batch={b}" for b in batches])
    last = rows.groupBy("doc_id", "tokenizer").agg(F.max_by(F.struct("live", "source", "lang", "tokens"), "batch").alias("s"))
    return last.where("s.live").select("doc_id", "tokenizer", "s.source", "s.lang", "s.tokens")


def commit(spark: SparkSession, store: str, batch: int, changes: DataFrame, vocabulary: str, earlier: list[int]) -> None:
    """Commit changes (doc_id, op, source, lang, text) as a batch that follows the batches `earlier`."""
    documents, totals = f"{store}/documents/batch={batch}", f"{store}/totals/batch={batch}"
    if _has(spark, totals):
        return
    if not _has(spark, documents):
        order = F.when(F.col("op") == "delete", 2).when(F.col("op") == "revise", 1).otherwise(0)
        new = count_tokens(changes, vocabulary).groupBy("doc_id").agg(
            F.max(F.struct(order.alias("order"), "tokens", "source", "lang")).alias("n"))
        old = state(spark, store, earlier)
        if old is None:
            joined = new.withColumn("o", F.lit(None).cast("struct<source:string,lang:string,tokens:long>"))
        else:
            old = old.where(F.col("tokenizer") == vocabulary).select(
                F.col("doc_id").alias("_d"), F.struct("source", "lang", "tokens").alias("o"))
            joined = new.join(old, F.col("doc_id").eqNullSafe(F.col("_d")), "left")
        live = F.col("n.order") < 2
        joined.where(live | F.col("o").isNotNull()).select(
            "doc_id", F.lit(vocabulary).alias("tokenizer"), live.alias("live"),
            F.when(live, F.col("n.source")).alias("source"), F.when(live, F.col("n.lang")).alias("lang"),
            F.when(live, F.col("n.tokens")).alias("tokens"), F.col("o").isNotNull().alias("had"),
            F.col("o.source").alias("old_source"), F.col("o.lang").alias("old_lang"), F.col("o.tokens").alias("old_tokens"),
        ).write.mode("overwrite").parquet(documents)
    rows = spark.read.parquet(documents)
    signed = rows.where("live").select(*KEY, F.lit(1).alias("i"), F.lit(0).alias("o"), "tokens", F.lit(0).cast("long").alias("gone")).union(
        rows.where("had").select(F.col("old_source"), F.col("old_lang"), "tokenizer", F.lit(0), F.lit(1), F.lit(0).cast("long"), "old_tokens"))
    signed.groupBy(*KEY).agg(
        F.sum("i").alias("docs_in"), F.sum("o").alias("docs_out"), F.sum("tokens").alias("tokens_in"), F.sum("gone").alias("tokens_out"),
    ).write.mode("overwrite").parquet(totals)


def rollup(spark: SparkSession, store: str, batches: list[int]) -> DataFrame:
    """The totals after `batches`: what went in and out, and what is there."""
    rows = spark.read.schema(TOTALS).parquet(*[f"{store}/totals/batch={b}" for b in batches])
    return rows.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in ("docs_in", "docs_out", "tokens_in", "tokens_out")]).withColumns({
        "docs": F.col("docs_in") - F.col("docs_out"), "tokens": F.col("tokens_in") - F.col("tokens_out"),
    })


@query("op9_token_rollup")
def token_rollup(spark, sf):
    """All documents under two tokenizers, the first batch sent twice; then those labelled toxic are deleted."""
    store = new_folder(spark, "token-rollup")
    docs = table(spark, sf, "documents").select("doc_id", F.lit("insert").alias("op"), "source", "lang", "text")
    gone = table(spark, sf, "labels").where("toxic = 1").select(
        "doc_id", F.lit("delete").alias("op"), *[F.lit(None).cast("string").alias(c) for c in ("source", "lang", "text")])
    one, two = "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"
    commit(spark, store, 1, docs, one, [])
    commit(spark, store, 1, docs, one, [])
    commit(spark, store, 2, docs, two, [1])
    commit(spark, store, 3, gone, one, [1, 2])
    commit(spark, store, 4, gone, two, [1, 2, 3])
    return rollup(spark, store, [1, 2, 3, 4])
