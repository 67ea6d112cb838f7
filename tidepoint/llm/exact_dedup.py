"""Exact duplicates by a tree merge of sorted digest runs.

Each text becomes a SHA-256 digest with its byte length and an independent 64-bit checksum; entries are one
only if all three agree, at every level. Every scan partition sorts its entries into a run and merges equal ones
to (retained identifier, count). The runs then meet in rounds: the nodes of a k-ary hypercube exchange, in round r,
the parts of their runs by the r-th digit of each digest's home node, so a node merges the sorted parts of k runs and
keeps a k-th of the digests. After the last round each digest lies merged at its home. No node ever holds more than its
share of the distinct digests, and a text with any number of copies is one entry of each run.

Defined results: a null text counts as the empty text; texts of any length are read whole; among equal texts the row with
the smallest (or largest) id stays, rows without id only if all rows of the text lack one, and of rows that also share the
id exactly one; repeated rows are copies of each other; empty tables give empty tables; columns beside id and text pass
through `deduplicated` whatever their names, and the operator's own tables never read them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepoint.llm.catalog import query
from tidepoint.llm.common import fresh, stored, table

FAN_IN = 8  # runs merged at once at most
HEAVY = 4096  # groups with a 4096th of all rows are at most 4096, so they can be broadcast
KEY = ["digest", "size", "check"]


def digests(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, digest, size, check, row of every row, stored. `row` names rows of this table only."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    return stored(docs.select(
        F.col(id_column).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.octet_length(text).alias("size"),
        F.xxhash64(text).alias("check"), F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("row"),
    ), "digests")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each stretch of sorted entries with equal node and key the first, with the sum of counts."""
    keys, held = ["node", *KEY], None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if held is not None:
            rows = pa.concat_tables([held, rows])
        if not len(rows):
            continue
        rows, heads = rows.combine_chunks(), np.ones(len(rows), bool)
        same = np.ones(len(rows) - 1, bool)
        for key in keys:
            column = rows[key].combine_chunks()
            same &= pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        heads[1:] = ~same
        at = np.flatnonzero(heads)
        out = rows.take(at)
        n = pa.array(np.add.reduceat(rows["n"].to_numpy(), at))
        out = out.set_column(out.schema.get_field_index("n"), batch.schema.field("n"), n)
        held = out.slice(len(out) - 1)
        yield from out.slice(0, len(out) - 1).combine_chunks().to_batches()
    if held is not None:
        yield from held.combine_chunks().to_batches()


def fan_in(nodes: int) -> tuple[int, int]:
    """(k, rounds): the least k-ary tree of at least two rounds and at most FAN_IN runs a merge that has `nodes` leaves."""
    rounds = max(2, math.ceil(round(math.log(max(nodes, 1), FAN_IN), 9)))
    k = 2
    while k ** rounds < nodes:
        k += 1
    return k, rounds


def tree_merge(entries: DataFrame, keep: str = "smallest", nodes: int | None = None) -> DataFrame:
    """digest, size, check, keep, keep_row, n of each distinct text in a table of `digests`."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    spark = entries.sparkSession
    k, rounds = fan_in(nodes or int(spark.conf.get("spark.sql.shuffle.partitions")))
    count = k ** rounds
    first = F.col("keep").asc_nulls_last() if keep == "smallest" else F.col("keep").desc_nulls_last()
    order = ["node", *KEY, first, "keep_row"]

    def merged(runs: DataFrame) -> DataFrame:
        return runs.sortWithinPartitions(*order).mapInArrow(_merge, runs.schema)

    runs = merged(entries.select(
        F.pmod("run", F.lit(count)).cast("int").alias("node"), F.pmod(F.xxhash64("digest"), F.lit(count)).cast("int").alias("home"), *KEY,
        F.col("id").alias("keep"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("n"),
    ))
    for place in (k ** r for r in range(rounds)):
        runs = merged(runs.withColumn("node", F.col("node") + (_digit("home", place, k) - _digit("node", place, k)) * place)
                      .repartitionById(count, F.col("node")))
    return stored(runs.drop("node", "home"), "texts")


def _digit(column: str, place: int, k: int) -> Column:
    return F.pmod(F.floor(F.col(column) / place).cast("int"), F.lit(k))


def classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest") -> DataFrame:
    """id, keep_id, group_size, kept, digest of every row.

    Texts that occur once need no answer. Those that hold a HEAVY-th of all rows or more are HEAVY at most and are
    broadcast; the rest meet their rows by digest, and no such key has more rows than that.
    """
    rows = digests(docs, id_column, text_column)
    texts = tree_merge(rows, keep)
    total = texts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    many = texts.where("n > 1")
    heavy, light = many.where(F.col("n") * HEAVY >= total), many.where(F.col("n") * HEAVY < total)
    met = rows.join(F.broadcast(heavy), KEY, "left")
    answered = met.where("n is not null").unionByName(
        met.where("n is null").drop("keep", "keep_row", "n").join(light, KEY, "left"))
    return answered.select(
        "id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), (F.col("n").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "digest",
    )


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of `docs` that stay, with all their columns; of rows equal in id and text any one."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    kept = classes(docs, id_column, text_column, keep).where("kept").select(
        F.col("digest").alias("_digest"), F.col("keep_id").alias("_keep"))
    named = docs.withColumn("_digest", F.unhex(F.sha2(text, 256))).withColumn("_keep", F.col(id_column))
    met = named.join(kept.withColumnsRenamed({"_digest": "_d", "_keep": "_k"}),
                     (F.col("_digest") == F.col("_d")) & F.col("_keep").eqNullSafe(F.col("_k")), "left_semi")
    return met.dropDuplicates(["_digest", "_keep"]).select(*docs.columns)


@query("op11_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op11_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = fresh(table(spark, sf, "documents"), "doc_id", "text")
    return classes(docs, keep="largest").select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
