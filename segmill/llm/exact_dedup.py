"""Exact deduplication by content hash, with bytes compared, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, whole_text


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest=None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are grouped by a 128-bit hash *and* by their bytes: the aggregation's hash table compares whole keys, so two
    texts that share a hash fall in two classes.  Copies are combined on the map side, so a group with any share of all
    rows reaches the shuffle as one row per task.  Classes are written to a scratch table without their texts; documents
    then find their class by hash, in a join whose sides both come from a plain exchange, so that Spark splits hot
    hashes.  Only if some hash has several classes are those few hashes' texts joined by hash and bytes.

    ``keep``: which id of a group stays, ``smallest`` or ``largest``.  ``digest`` gives the 128-bit hash of a string
    column as binary (MD5 by default; tests pass a poor one to force collisions).
    Null text counts as empty; empty texts are copies of each other; very long texts are compared whole.  A repeated id counts once per row.
    A row without an id counts in its group but never stays: its kept is null, as is keep_id where the whole group has no id.  Ids in one group are
    ordered, so there are no ties but repeated rows, which all stay or go.  An empty table gives no rows.  Other columns are ignored.
    """
    digest = digest or (lambda c: F.unhex(F.md5(c.cast("binary"))))
    best = {"smallest": F.min, "largest": F.max}[keep]
    scratch = Scratch(docs.sparkSession, "exact")
    base = whole_text(docs, id_col, text_col).withColumn("h", digest(F.col("text")))

    def classes_of(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h", "text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))

    sha = F.sha2(F.col("text").cast("binary"), 256)
    classes = scratch.write(classes_of(base).select("h", "keep_id", "group_size", F.unhex(sha).alias("sha")), "classes")
    shared = classes.groupBy("h").count().where("count > 1").select("h")
    out = ["doc_id", "keep_id", "group_size", "sha"]
    collided = not shared.isEmpty()
    alone = classes.join(shared, "h", "left_anti") if collided else classes
    found = base.select("doc_id", "h").join(alone, "h").select(*out)
    if collided:
        few = base.join(shared, "h", "left_semi")
        found = found.unionByName(few.join(classes_of(few).withColumn("sha", F.unhex(sha)), ["h", "text"]).select(*out))
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
