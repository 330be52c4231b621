"""WARC archives: writing with revisit records, and reading by boundary chains.

Writing: payloads of at least ``MIN_REVISIT`` bytes that occur more than once
are stored with the largest id; the others become revisit records.  The choice
is made on (id, digest) rows alone and written as a small table, which the
planner broadcasts if it is small and joins by shuffle otherwise, so payloads
are shuffled only where they must be.

Reading: archives are read in byte ranges, cut at the record magic.  Each
piece gives a candidate record: its offset, and by its headers the offset of
its successor.  A magic inside a payload gives a candidate too.  Per archive
the (offset, successor) pairs are gathered, without payloads (tens of bytes a
candidate, bounded by the archive's size), and pointer jumping from the file's
start keeps the records that the chain reaches.  A reached record whose payload
holds the magic is put together from its pieces in a second pass over these
alone.

Defined results: a null payload is empty; ids may be null or repeat (of equal
ids with equal payloads all are responses if theirs is the largest; null counts
as less than any id); line ends and null in a URL become blanks; candidates
behind a broken link are not reached; extra columns are ignored; an empty
table gives an empty archive.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from creditlake.llm.common import cut_lineage, shared_dir

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
MIN_REVISIT = 1000
MAX_RECORDS = 20_000
DATE = "2000-01-01T00:00:00Z"


def decisions(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the records that revisit another."""
    keys = pages.select("page_id", "payload_digest", "payload_bytes").where(F.col("payload_bytes") >= min_bytes)
    many = keys.groupBy("payload_digest", "payload_bytes").agg(
        F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    return keys.join(many, ["payload_digest", "payload_bytes"]).where(
        ~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "payload_digest", "refers_to").distinct()


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_bytes: int = MIN_REVISIT, max_records: int = MAX_RECORDS) -> None:
    """One record for each row into plain WARC files below ``path``, of at most ``max_records`` records each."""
    text = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    url = F.translate(F.coalesce(F.col(url_col).cast("string"), F.lit("")), "\r\n", "  ")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), text.alias("payload"),
                        F.sha1(text.cast("binary")).alias("payload_digest"),
                        F.octet_length(text).cast("long").alias("payload_bytes"))
    dup = cut_lineage(decisions(rows, min_bytes), "warc-revisits")
    d = dup.select(F.col("page_id").alias("d_id"), F.col("payload_digest").alias("d_digest"), "refers_to")
    rows = rows.join(d, F.col("page_id").eqNullSafe(F.col("d_id")) & (F.col("payload_digest") == F.col("d_digest")), "left")
    again = F.col("refers_to").isNotNull()
    uuid = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    record = F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _header("WARC-Record-ID", uuid(F.col("page_id"))),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(again, _header("WARC-Refers-To", uuid(F.col("refers_to")))).otherwise(F.lit("")),
        _header("Content-Type", F.lit("text/html; charset=utf-8")),
        _header("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("payload_bytes")).cast("string")),
        F.lit("\r\n"),
        F.when(again, F.lit("")).otherwise(F.col("payload")))
    (rows.select(record.alias("value")).write.option("lineSep", END)
     .option("maxRecordsPerFile", max_records).text(path))


def _field(name: str) -> Column:
    return F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)


def _long(c: Column) -> Column:
    return c.try_cast("long")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """Every stretch of the archives between two magics, with its place: file, range, row in the task."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nr"), F.col("value"))


def _chain(group: pa.Table) -> pa.Table:
    """The reachable records of one archive, by pointer jumping over its candidates."""
    group = group.sort_by([("block", "ascending"), ("nr", "ascending")])
    size = group.column("size").to_numpy() + len(MAGIC)
    begin = np.cumsum(size) - size - len(MAGIC)  # where each piece's magic stands
    n = len(size)
    end = int(size.sum()) - len(MAGIC)
    whole = group.column("record_size").to_numpy(zero_copy_only=False)  # NaN: no record
    ok = ~np.isnan(whole)
    succ = np.where(ok, begin + np.nan_to_num(whole), -1).astype(np.int64)
    # as indices: n is the file's end, n + 1 nowhere; both stay where they are
    nxt = np.searchsorted(begin, succ)
    hit = (nxt < n) & (begin[np.minimum(nxt, n - 1)] == succ) & ok
    jump = np.append(np.where(hit, nxt, np.where(ok & (succ == end), n, n + 1)), [n, n + 1])
    reached = np.zeros(n + 2, np.bool_)
    first = np.flatnonzero(begin == 0)
    reached[first] = True
    while True:
        to = jump[np.flatnonzero(reached)]
        if reached[to].all():
            break
        reached[to] = True
        jump = jump[jump]
    keep = np.flatnonzero(reached[:n] & ok)
    out = group.take(pa.array(keep)).drop_columns(["size", "record_size"])
    last = np.where(hit[keep], nxt[keep], n)  # the piece with which the next record begins
    for name, col in (("offset", begin[keep]), ("piece", keep), ("pieces", last - keep)):
        out = out.append_column(name, pa.array(col.astype(np.int64)))
    return out


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each reachable record: file, offset, record_type, page_id, url, payload_bytes,
    payload_digest (of the payload as stored; of a revisit's as its headers say), refers_to."""
    pieces = _pieces(spark, path)
    head = pieces.withColumn("head", F.substring_index("value", END, 1)).select(
        "*", F.octet_length("value").cast("long").alias("size"),
        (F.octet_length("head") + len(END)).cast("long").alias("head_size"),
        _long(_field("Content-Length")).alias("length"))
    # a record runs from its magic over head and payload to the line ends behind it
    record = F.when(F.col("size") >= F.col("head_size"), F.col("head_size") + F.col("length") + len(END))
    page = _long(F.regexp_extract(_field("WARC-Record-ID"), r"(-?\d+)", 1))
    body = F.substring(F.col("value").cast("binary"), F.col("head_size").cast("int") + 1, F.col("length").cast("int"))
    narrow = head.select(
        "file", "block", "nr", "size", "head_size", "length",
        (record + len(MAGIC)).cast("double").alias("record_size"),
        _field("WARC-Type").alias("record_type"), page.alias("page_id"), _field("WARC-Target-URI").alias("url"),
        _long(F.regexp_extract(_field("WARC-Refers-To"), r"(-?\d+)", 1)).alias("refers_to"),
        _long(_field("X-Payload-Length")).alias("told_bytes"),
        F.regexp_extract(_field("WARC-Payload-Digest"), "sha1:([0-9a-f]+)", 1).alias("told_digest"),
        F.when(F.col("size") == record, F.sha1(body)).alias("digest"))
    kept = "file string, block long, nr long, head_size long, length long, record_type string, page_id long, url string, refers_to long, told_bytes long, told_digest string, digest string"
    chain = cut_lineage(narrow.groupBy("file").applyInArrow(_chain, f"{kept}, offset long, piece long, pieces long"), "warc-chain")
    split = chain.where("pieces > 1")
    if not split.isEmpty():
        chain = chain.where("pieces <= 1").unionByName(_joined(pieces, chain, split))
    again = F.col("record_type") == "revisit"
    return chain.select(
        "file", "offset", "record_type", "page_id", "url", "refers_to",
        F.when(again, F.col("told_bytes")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(again, F.col("told_digest")).otherwise(F.col("digest")).alias("payload_digest"))


def _joined(pieces: DataFrame, chain: DataFrame, split: DataFrame) -> DataFrame:
    """``split`` with the digests of payloads that hold the magic, from a second read of their files."""
    files = split.select("file").distinct()
    own = split.select("file", "piece", "pieces", "head_size", "length")
    # pieces of these files are numbered again, as in the chain, without their bytes; then only those needed are read
    places = pieces.join(files, "file", "left_semi").select("file", "block", "nr").withColumn(
        "k", F.row_number().over(Window.partitionBy("file").orderBy("block", "nr")) - 1)
    wanted = places.join(own, "file").where("k >= piece and k < piece + pieces").select("file", "block", "nr", "k", "piece", "head_size", "length")
    parts = pieces.join(wanted, ["file", "block", "nr"]).groupBy("file", "piece", "head_size", "length").agg(
        F.array_sort(F.collect_list(F.struct("k", F.col("value").cast("binary").alias("v")))).alias("parts"))
    whole = F.aggregate(F.slice("parts", 2, F.size("parts")), F.col("parts")[0]["v"],
                        lambda acc, x: F.concat(acc, F.lit(MAGIC).cast("binary"), x["v"]))
    body = F.substring(whole, F.col("head_size").cast("int") + 1, F.col("length").cast("int"))
    digests = parts.select("file", "piece", F.sha1(body).alias("full"))
    return split.join(digests, ["file", "piece"]).withColumn("digest", F.col("full")).select(chain.columns)


def archived(pages: DataFrame, **kw) -> DataFrame:
    """Write ``pages`` below the shared folder and read the archives back."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archives(pages, path, **kw)
    return read_archives(spark, path)
