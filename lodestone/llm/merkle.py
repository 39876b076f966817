"""Fixity audit of WARC replicas by Merkle trees.

Records are hashed; records whose offsets fall into the same range of an archive make a leaf, and sixteen neighbouring
nodes make a node of the next level, up to one root an archive. Two replicas are compared root by root; only below
branches that differ are the next levels compared, down to ranges and then to single records.

Edge cases: a null payload is an empty record; null ids and urls are written as empty; repeated rows are records of
their own; empty replicas give an empty table, and a replica that lacks an archive has all its records missing; a record that only the
replica has is reported as extra; columns besides those named are not read. A node has sixteen children and a range as many records as fit into it, at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lodestone.sources.scratch import written

RANGE = 64 * 1024
FANOUT = 16
RECORDS_PER_ARCHIVE = 1000
PARTS = 256  # of the records of one hash


def record(id_: Column, url: Column, payload: Column) -> Column:
    """A WARC/1.0 resource record as text."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    body = text(payload)
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), text(id_), F.lit(">\r\nWARC-Target-URI: "), text(url),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def digests(records: DataFrame) -> DataFrame:
    """(archive, offset, length, sha256) of records (archive, offset, record)."""
    return records.select("archive", "offset", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256"))


def placed(records: DataFrame, archives: int) -> DataFrame:
    """Records (id, length, sha256) with their archive and offset; only lengths and hashes move.

    Archives are dealt by a hash of a record's place in the table, so each has about as many records as any other, equal ones too.
    """
    archive = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(archives))
    before = Window.partitionBy("archive").orderBy("id", "sha256").rowsBetween(Window.unboundedPreceding, -1)
    found = written(records.withColumn("archive", archive), "placed")
    return found.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def numbered(records: DataFrame) -> DataFrame:
    """``records`` with ``k``, a number from 1 among those of one ``key``; a key's records are dealt to ``PARTS``, so that none is counted in one task."""
    dealt = written(records.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))), "dealt")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = dealt.groupBy("key", "part").agg(F.count("*").alias("n"))
    offset = counted.select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # PARTS rows a key at most
    own = dealt.withColumn("own", F.row_number().over(Window.partitionBy("key", "part").orderBy("part")))
    return own.join(offset, ["key", "part"]).withColumn("k", F.col("before") + F.col("own")).drop("part", "own", "before")


def _joined_hash(order: str, value: Column) -> Column:
    """Hash over the values of a node's children in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), value.alias("v"))))
    return F.sha2(F.array_join(F.transform(pairs, lambda x: F.concat_ws(":", x["at"].cast("string"), x["v"])), ";"), 256)


def tree(records: DataFrame, levels: int) -> list[DataFrame]:
    """Levels of nodes (archive, node, hash), ranges first, of records (archive, offset, length, sha256)."""
    ranges = records.withColumn("node", F.floor(F.col("offset") / RANGE)).groupBy("archive", "node").agg(_joined_hash("offset", F.concat_ws(":", F.col("length").cast("string"), "sha256")).alias("hash"))
    found = [written(ranges, "ranges")]
    for _ in range(levels):
        above = found[-1].withColumn("up", F.floor(F.col("node") / FANOUT))
        found.append(written(above.groupBy("archive", F.col("up").alias("node")).agg(_joined_hash("node", F.col("hash")).alias("hash")), "nodes"))
    return found


def levels_for(*replicas: DataFrame) -> int:
    """Levels above the ranges that bring the longest archive of any replica to one root."""
    last = max(r.agg(F.coalesce(F.max("offset"), F.lit(0))).first()[0] for r in replicas) // RANGE
    n = 0
    while last:
        last, n = last // FANOUT, n + 1
    return n


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Records (archive, offset, length, sha256) that two replicas don't share: archive, offset, and each one's hash."""
    n = levels_for(left, right)
    a, b = tree(left, n), tree(right, n)
    suspects: DataFrame | None = None
    for x, y in zip(reversed(a), reversed(b), strict=True):
        if suspects is not None:
            parents = suspects.select("archive", F.col("node").alias("up"))
            x, y = (z.withColumn("up", F.floor(F.col("node") / FANOUT)).join(parents, ["archive", "up"], "left_semi").drop("up") for z in (x, y))
        both = x.withColumnRenamed("hash", "l").join(y.withColumnRenamed("hash", "r"), ["archive", "node"], "full_outer")
        suspects = written(both.where(~F.col("l").eqNullSafe(F.col("r"))).select("archive", "node"), "suspects")
    inside = lambda z: z.withColumn("node", F.floor(F.col("offset") / RANGE)).join(suspects, ["archive", "node"], "left_semi")
    l, r = inside(left), inside(right)
    key = ["archive", "offset"]
    found = l.select(*key, F.struct("length", "sha256").alias("l")).join(r.select(*key, F.struct("length", "sha256").alias("r")), key, "full_outer")
    return found.where(~F.col("l").eqNullSafe(F.col("r"))).select(*key, F.col("l.sha256").alias("sha256"), F.col("r.sha256").alias("replica_sha256"))


def stored_copy(pages: DataFrame) -> DataFrame:
    """A second replica with known damage: (id, named, record) written to the shared folder and read again.

    By the first two digits of the id's SHA-256, 00 to 02 lose the first character of their payload to an X, and 03 are
    left out. ``named`` is the hash under which the record was stored, whatever it holds now.
    """
    lot = F.substring(F.sha2(F.coalesce(F.col("page_id").cast("string"), F.lit("")), 256), 1, 2)
    spoilt = F.when(lot <= "02", F.concat(F.lit("X"), F.substring(F.col("html"), 2, 1 << 30))).otherwise(F.col("html"))
    named = F.sha2(record(F.col("page_id"), F.col("url"), F.col("html")), 256)
    return written(pages.where(lot != "03").select(F.col("page_id").alias("id"), named.alias("named"), record(F.col("page_id"), F.col("url"), spoilt).alias("record")), "replica")


def page_audit(pages: DataFrame, copy: DataFrame | None = None) -> DataFrame:
    """Every page's record, and whether the copy (id, named, record) holds it: page_id, record_bytes, sha256 and status, which is
    ok, corrupt, missing, or extra for a record that only the copy has; without a copy, that of ``stored_copy``."""
    archives = max(1, -(-pages.count() // RECORDS_PER_ARCHIVE))
    own = pages.select(F.col("page_id").alias("id"), record(F.col("page_id"), F.col("url"), F.col("html")).alias("record"))
    left = written(placed(own.select("id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256")), archives), "left")
    # A copy keeps the offsets of its records, so their places come from the index of the first replica.
    keyed = lambda d, name: d.withColumn("key", F.concat_ws(":", name, F.col("id").cast("string")))
    index = numbered(keyed(left, "sha256").select("key", "archive", "offset"))
    other = keyed(stored_copy(pages) if copy is None else copy, "named")
    other = numbered(other.select("key", "id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha256")))
    right = written(other.join(index, ["key", "k"], "left"), "right")
    known = right.where(F.col("archive").isNotNull()).select("archive", "offset", "length", "sha256")
    damaged = audit(left.select("archive", "offset", "length", "sha256"), known).select("archive", "offset", F.struct("replica_sha256").alias("damage"))
    status = F.when(F.col("damage").isNull(), "ok").when(F.col("damage.replica_sha256").isNull(), "missing").otherwise("corrupt")
    found = left.join(damaged, ["archive", "offset"], "left").select(F.col("id").alias("page_id"), F.col("length").alias("record_bytes"), "sha256", status.alias("status"))
    return found.unionByName(right.where(F.col("archive").isNull()).select(F.col("id").alias("page_id"), F.col("length").alias("record_bytes"), "sha256", F.lit("extra").alias("status")))


#: The same by comparing every record directly.
SQL = r"""
WITH r AS (
  SELECT page_id, url, coalesce(html, '') AS html, substr(sha256(coalesce(CAST(page_id AS VARCHAR), '')), 1, 2) AS lot,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || chr(13) || chr(10)
      || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' AS head
  FROM pages
), w AS (
  SELECT page_id, lot, head || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS a,
    head || strlen('X' || substr(html, 2)) || chr(13) || chr(10) || chr(13) || chr(10) || 'X' || substr(html, 2) || chr(13) || chr(10) || chr(13) || chr(10) AS b
  FROM r
)
SELECT page_id, CAST(strlen(a) AS BIGINT) AS record_bytes, sha256(a) AS sha256,
  CASE WHEN lot = '03' THEN 'missing' WHEN lot <= '02' AND a <> b THEN 'corrupt' ELSE 'ok' END AS status
FROM w
"""
