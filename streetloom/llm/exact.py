"""Exact dedup: counting quotient filters find repeated fingerprints, bytes decide."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILE, ROW, SPACES, chunks_of, materialize, stored, with_row_key
from .cqf import CountingQuotientFilter

#: Up to so many repeated fingerprints (24 bytes a row) are broadcast; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000


def _keyed(docs: DataFrame) -> DataFrame:
    """Row key, doc_id, normalised text, its digests, code points of the original."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = with_row_key(docs, "doc_id", F.translate(text, SPACES, "").alias("norm"), F.char_length(text).alias("points"))
    rows = rows.withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256))
    return rows.withColumn("fp", F.xxhash64("norm"))


def repeated_fingerprints(rows: DataFrame) -> DataFrame:
    """(fp) that rows hold more than once: a filter a partition, merged by ranges of the fingerprint."""
    parts = max(1, (chunks_of(rows.sparkSession) - 1).bit_length())

    def build(batches):
        held = [b.column(0).to_numpy() for b in batches]
        fp, n = np.unique(np.concatenate(held).view(np.uint64), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        cut = np.searchsorted(fp >> np.uint64(64 - parts), np.arange((1 << parts) + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(cut))
        blobs = [CountingQuotientFilter.from_counts(fp[cut[k]:cut[k + 1]] << np.uint64(parts), n[cut[k]:cut[k + 1]]).to_bytes() for k in some]
        yield pa.record_batch({"part": pa.array(some, pa.int32()), "filter": pa.array(blobs, pa.binary())})

    def merge(key, table):
        whole = CountingQuotientFilter.merge([CountingQuotientFilter.from_bytes(x.as_py()) for x in table.column("filter")])
        fp, n = whole.items()
        fp = (fp[n > 1] >> np.uint64(parts)) | (np.uint64(key[0].as_py()) << np.uint64(64 - parts))
        return pa.table({"fp": fp.view(np.int64)})

    return rows.select("fp").mapInArrow(build, "part int, filter binary").groupBy("part").applyInArrow(merge, "fp long")


def dedup_rows(docs: DataFrame) -> DataFrame:
    """One row per document, keyed by row: doc_id, keep_id, group_size, kept, text_sha256 and the row key.

    Texts are equal if their bytes are after deleting ASCII white space; null counts as empty, and all empty texts
    are one group. The row with most code points in the original stays, then the smallest doc_id (null last), then
    the first row: of wholly repeated rows exactly one stays. Empty table: no rows. A very long text is read
    whole; doc_id is a whole number. Other columns are ignored.
    """
    docs = stored(docs)
    narrow = materialize(_keyed(docs).drop("norm"), "digests")
    again = materialize(repeated_fingerprints(narrow), "repeated")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    best = F.struct("points", F.col("doc_id").isNotNull().alias("has"), F.bitwise_not("doc_id").alias("low"), F.bitwise_not(FILE).alias("f"), F.bitwise_not(ROW).alias("r"))
    seen = _keyed(docs).join(again, "fp", "left_semi")
    groups = seen.groupBy("sha", "norm").agg(F.first("fp").alias("gfp"), F.count("*").alias("n"), F.max(best).alias("best")).where("n > 1")
    groups = materialize(groups.select(F.col("sha").alias("gsha"), "gfp", "n", F.bitwise_not("best.low").alias("keep"), F.bitwise_not("best.f").alias("kf"), F.bitwise_not("best.r").alias("kr")), "groups")
    out = narrow.join(groups, (F.col("sha") == F.col("gsha")) & (F.col("fp") == F.col("gfp")), "left")
    return out.select("doc_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                      F.coalesce((F.col(FILE) == F.col("kf")) & (F.col(ROW) == F.col("kr")), F.lit(True)).alias("kept"), F.col("sha").alias("text_sha256"), FILE, ROW)


def keep_first_copies(docs: DataFrame) -> DataFrame:
    """docs, with its own columns, without the rows whose text an other row keeps."""
    docs = stored(docs)
    gone = dedup_rows(docs).where("not kept").select(F.col(FILE).alias("__lw_f"), F.col(ROW).alias("__lw_r"))
    d = with_row_key(docs)
    return d.join(gone, (d[FILE] == gone["__lw_f"]) & (d[ROW] == gone["__lw_r"]), "left_anti").select(*(d[c] for c in docs.columns))
