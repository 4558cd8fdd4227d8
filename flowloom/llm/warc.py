"""WARC archives written by Spark and read back with boundary-chain verification.

Writing: one record for each page; of records with equal payloads of at least MIN_REVISIT bytes the one with the
largest page_id is a response and the others are revisits that name it. Each task writes one archive.

Reading: a record starts with the magic ``WARC/1.1`` CRLF, but a payload may hold that magic, too, or even a whole
record. Tasks split the archives' blocks at every magic and emit candidates: (record offset, successor offset by
Content-Length). Within a block, each candidate's chain is followed to where it leaves the block; between blocks,
pointer jumping from the start of each file keeps only the entries that are reachable, and thereby only true records.
A record whose payload holds the magic is put together from its pieces afterwards.

Nulls: a null html is an empty payload, a null url leaves out the target, a null page_id is kept as such.
Repeated rows are records of their own; those that carry the largest page_id of a group are all responses.
Further columns are ignored. An empty table gives an archive without records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowloom.llm.support import scratch_path, ship, written

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, refers_to (null: a response)."""
    body = F.coalesce("html", F.lit(""))
    pages = pages.select("page_id", "url", body.alias("html"), F.sha1(body.cast("binary")).alias("digest"))
    large = pages.where(F.octet_length("html") >= MIN_REVISIT)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    groups = written(groups, "warc_groups")  # read anew, so that Spark knows its size and can split a group with many copies
    joined = pages.join(groups, "digest", "left")
    is_copy = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.withColumn("refers_to", F.when(is_copy, F.col("original"))).drop("original")


def records(typed: DataFrame) -> DataFrame:
    """The text of each record, without the blank lines that end it."""
    again = F.col("refers_to").isNotNull()
    # control characters of a url would end its header line
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), _line("Content-Length", F.octet_length("html").cast("string")), F.lit("\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    head = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Date", F.lit(DATE)),
        F.when(url.isNotNull(), _line("WARC-Target-URI", url)).otherwise(F.lit("")),
        F.when(again, _line("WARC-Refers-To", _urn(F.col("refers_to")))).otherwise(F.lit("")),
        F.when(again, _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
    )
    return typed.select(head.alias("head"), block.alias("block")).select(
        F.concat("head", _line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"), "block").alias("value")
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """A file of WARC records for each task."""
    records(with_types(pages)).write.option("lineSep", END).text(path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """The archives' text, split at every magic, with the block that each piece was read with."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


HEAD_COLUMNS = "file string, block long, size long, length long, page string, type string, refers string, digest string, payload_bytes long, payload_sha1 string"


def _parsed(pieces: DataFrame) -> DataFrame:
    """What a piece says about itself if it is a record; payload_sha1 only where the piece holds the whole record."""
    head = F.substring_index("value", END, 1)
    field = lambda name: F.regexp_extract(F.col("head"), rf"(?m)^{name}: ([^\r\n]*)\r?$", 1)
    at = pieces.withColumn("head", head).withColumn("size", F.octet_length("value").cast("long"))
    at = at.withColumn("length", F.col("size").cast("long") * 0 + field("Content-Length").try_cast("long"))
    binary = F.col("value").cast("binary")
    start = F.octet_length("head") + len(END)
    # the header of the block ends at its first blank line, wherever that is
    at = at.withColumn("http", F.substring_index(F.substring(binary, start + 1, F.col("length").cast("int")).cast("string"), END, 1))
    full = F.col("size") >= start + F.col("length") + len(END)
    skip = start + F.octet_length("http") + len(END)
    payload = F.substring(binary, skip + 1, (start + F.col("length") - skip).cast("int"))
    stated = F.regexp_extract(F.col("http"), r"(?m)^Content-Length: (\d+)\r?$", 1).try_cast("long")
    return at.select(
        "file", "block", "size",
        # from the magic to the next record
        (F.lit(len(MAGIC)) + start + F.col("length") + len(END)).cast("long").alias("length"),
        field("WARC-Record-ID").alias("page"), field("WARC-Type").alias("type"), field("WARC-Refers-To").alias("refers"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("digest"), stated.alias("payload_bytes"),
        F.when(full, F.sha1(payload)).alias("payload_sha1"),
    )


def _place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Offsets within the block, from the order of its pieces; pieces of a block come one after another."""
    last, at = None, 0
    for f in frames:
        offsets = []
        for file, block, size in zip(f["file"], f["block"], f["size"], strict=True):
            if (file, block) != last:
                last, at = (file, block), 0
            offsets.append(at)
            at += size + len(MAGIC)
        f["offset"] = offsets
        yield f


def _exits(f: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a block, the first offset of its chain that is no candidate of this block."""
    f = f.sort_values("offset")
    leads: dict[int, int] = {}
    for at, to in zip(reversed(f["offset"].tolist()), reversed(f["next"].tolist()), strict=True):
        leads[at] = leads.get(to, to)
    f["exit"] = [leads[x] for x in f["offset"]]
    return f[["file", "block", "offset", "exit"]]


def _walk(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a block that its entry leads to."""
    to = dict(zip(left["offset"].tolist(), left["next"].tolist(), strict=True))
    hits = set()
    for at in right["offset"].tolist():
        while at in to and at not in hits:
            hits.add(at)
            at = to[at]
    return left[left["offset"].isin(hits)][["file", "offset"]]


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, offset) of the candidates (file, block, offset, next) on the chain from offset 0 of each file."""
    narrow = candidates.select("file", "block", "offset", "next")
    exits = written(narrow.groupBy("file", "block").applyInPandas(_exits, "file string, block long, offset long, exit long"), "warc_exits")
    # entries of blocks: the start of a file, and where chains of other blocks lead. Their number follows the blocks.
    targets = exits.select("file", F.col("exit").alias("offset")).union(exits.select("file", F.lit(0).cast("long").alias("offset"))).distinct()
    jumps = written(exits.join(targets, ["file", "offset"], "left_semi").select("file", "offset", F.col("exit").alias("to")), "warc_jumps")
    found = jumps.where("offset = 0").select("file", "offset").distinct()
    known = 0
    while True:
        step = jumps.join(found, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        grown = written(found.union(step.join(jumps.select("file", "offset"), ["file", "offset"], "left_semi")).distinct(), "warc_found")
        n = grown.count()
        if n == known:
            break
        known, found = n, grown
        # twice as far with the next jump
        far = jumps.select("file", F.col("offset").alias("to"), F.col("to").alias("beyond"))
        jumps = written(jumps.join(far, ["file", "to"], "left").select("file", "offset", F.coalesce("beyond", "to").alias("to")), "warc_jumps")
    entries = exits.join(found, ["file", "offset"], "left_semi").select("file", "block", "offset")
    return narrow.groupBy("file", "block").cogroup(entries.groupBy("file", "block")).applyInPandas(_walk, "file string, offset long")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives: page, type, refers, digest (as stated), payload_bytes, payload_sha1 (as read; null for revisits)."""
    ship(spark)
    placed = _parsed(_chunks(spark, path)).mapInPandas(_place, HEAD_COLUMNS + ", offset long")
    placed = written(placed, "warc_pieces")
    # a piece's own magic stands before it; where a block starts: after the pieces of the blocks before
    totals = placed.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", "block", (F.coalesce(F.sum("bytes").over(before), F.lit(0)) - len(MAGIC)).alias("start"))
    at = placed.join(starts, ["file", "block"]).withColumn("offset", F.col("offset") + F.col("start")).drop("start")
    at = written(at.withColumn("next", F.col("offset") + F.col("length")), "warc_candidates")
    candidates = at.where("next is not null and offset >= 0")
    true = written(candidates.join(reachable(candidates), ["file", "offset"], "left_semi"), "warc_records")
    broken = true.where("payload_sha1 is null").select("file", "offset", "next")
    whole = true.where("payload_sha1 is not null").drop("file", "block", "size", "length", "offset", "next")
    if not broken.isEmpty():
        whole = whole.unionByName(_mended(spark, path, at, true, broken))
    return whole.withColumn("payload_sha1", F.when(F.col("type") == "response", F.col("payload_sha1")))


def _mended(spark: SparkSession, path: str, at: DataFrame, true: DataFrame, broken: DataFrame) -> DataFrame:
    """Records whose payload holds the magic, put together from their pieces in a second reading."""
    # a piece belongs to the last record that starts at or before it
    starts = true.select("file", "offset", F.col("offset").alias("start"))
    last = F.last("start", ignorenulls=True).over(Window.partitionBy("file").orderBy("offset"))
    owned = at.select("file", "block", "offset").join(starts, ["file", "offset"], "left").withColumn("owner", last)
    pieces = owned.join(broken.withColumnRenamed("offset", "owner"), ["file", "owner"]).where("offset < next")
    # both readings give a block's pieces in the same order
    order = Window.partitionBy("file", "block").orderBy("offset")
    rank = at.select("file", "block", "offset", F.row_number().over(order).alias("nth"))
    wanted = pieces.select("file", "block", "offset", "owner").join(rank, ["file", "block", "offset"])
    blocks = wanted.select("file", "block").distinct()
    text = _chunks(spark, path).withColumn("id", F.monotonically_increasing_id()).join(blocks, ["file", "block"], "left_semi")
    text = text.withColumn("nth", F.row_number().over(Window.partitionBy("file", "block").orderBy("id"))).drop("id")
    parts = text.join(wanted, ["file", "block", "nth"]).groupBy("file", "owner").agg(F.min("block").alias("block"), F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("parts"))
    joined = parts.select("file", "block", F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC).alias("value"))
    return _parsed(joined).drop("file", "block", "size", "length")


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write pages as WARC archives to the shared folder and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The digest of a response is that of the payload as read, the one of a revisit as its record states it.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return read_archives(spark, path).select(
        number(F.col("page")).alias("page_id"),
        F.col("payload_bytes").cast("long").alias("payload_bytes"),
        F.coalesce("payload_sha1", "digest").alias("payload_digest"),
        F.col("type").alias("record_type"),
        number(F.col("refers")).alias("refers_to"),
    )
