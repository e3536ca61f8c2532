"""Deterministic sharded WARC archives of pages, and the way back.

Pages are sorted by id and cut into shards of equal payload bytes; the cut depends on the data alone, not on how Spark
partitions it. A task writes its shards record by record (one gzip member each, fixed times, ids and headers made from
the content), rolls to a new file by compressed size, and commits each file by a rename. The manifest, written by Spark
when all tasks are done, names the files that count, with their size and hash.
"""

from __future__ import annotations

import gzip
import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from contextlib import ExitStack
from uuid import UUID, uuid5

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postmill.llm.storage import committed, opened
from postmill.operators.ordering import materialize
from postmill.schema import quoted

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard's name space for URLs
DATE = "2000-01-01T00:00:00Z"  # fixed, so that equal input gives equal bytes
LEAST_REVISIT = 100
SMALLEST_SHARD, LARGEST_SHARD, SHARDS = 16 << 20, 1 << 30, 256


def record_id(page: object) -> str:
    return f"<urn:uuid:{uuid5(_NAMES, f'page:{page}')}>"


def record(page: object, url: str | None, payload: bytes, digest: str, refers_to: object, date: str = DATE) -> bytes:
    """One WARC/1.1 record. A revisit keeps the response's head and leaves the payload out."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(page),
        "WARC-Date": date,
        "WARC-Target-URI": "".join((url or "").split()) or "about:blank",
        "WARC-Page-ID": "" if page is None else str(page),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Payload-Length": str(len(payload)),
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
    }
    if revisit:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "WARC-Refers-To-Page-ID": str(refers_to)}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _shard_starts(sizes: DataFrame, shard_bytes: int | None) -> list:
    """First id of each shard but the first. ``sizes``: ``id, bytes`` of every page with an id, written before.

    Ids are range-sorted; running totals add the sums of the partitions before to those within a partition. The driver
    gets one id per shard, whose number the size of a shard bounds.
    """
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    shard_bytes = shard_bytes or min(LARGEST_SHARD, max(SMALLEST_SHARD, total // SHARDS))
    shards = -(-total // shard_bytes)
    if shards < 2:
        return []
    ranged = materialize(sizes.orderBy("id").withColumn("part", F.spark_partition_id()), "ranges")
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    sums = ranged.groupBy("part").agg(F.sum("bytes").alias("sum"))
    sums = sums.select("part", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    within = W.partitionBy("part").orderBy("id").rangeBetween(W.unboundedPreceding, W.currentRow)
    running = ranged.withColumn("running", F.sum("bytes").over(within)).join(F.broadcast(sums), "part")
    shard = F.floor((F.col("before") + F.col("running") - F.col("bytes")) / F.lit(total / shards))
    starts = running.groupBy(shard.alias("shard")).agg(F.min("id").alias("id")).filter("shard > 0")
    return sorted(r.id for r in starts.collect())


def decide(pages: DataFrame, id: str = "page_id", html: str = "html") -> DataFrame:
    """``id, bytes, digest, refers_to`` of every page: of equal payloads of 100 bytes and more the smallest id responds.

    Rows that share the smallest id with an equal payload all respond. Null ids come last: such a page refers to any
    page with an id, and responds where there is none.
    """
    payload = F.encode(F.coalesce(F.col(quoted(html)), F.lit("")), "UTF-8")
    facts = pages.select(F.col(quoted(id)).alias("id"), F.octet_length(payload).cast("long").alias("bytes"), F.sha2(payload, 256).alias("digest"))
    facts = materialize(facts, "pages")
    shared = facts.filter(F.col("bytes") >= LEAST_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = materialize(shared.filter("n > 1").drop("n"), "shared")
    found = facts.join(shared, "digest", "left")
    return found.select("id", "bytes", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(
    pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html",
    shard_bytes: int | None = None, roll_bytes: int = 64 << 20, date: str = DATE,
) -> DataFrame:
    """Write all pages below ``folder`` and return the manifest: ``shard, file, records, bytes, sha256``.

    Null payloads are empty, null urls ``about:blank``; null ids come first and read back as null. Rows that repeat an id
    are written one after the other, equal payloads together. Payloads are shuffled once, by shard; the decisions travel
    beside them. An empty table gives an empty manifest. A record may be larger than ``roll_bytes``; it then has a file
    of its own. The folder must be new. Other columns are not read.
    """
    decisions = materialize(decide(pages, id, html), "decisions")
    starts = _shard_starts(decisions.filter("id is not null").select("id", "bytes"), shard_bytes)
    kind = pages.schema[id].dataType.simpleString()

    def shard_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [0 if x is None else bisect_right(starts, x) for x in batch.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32())], names=[*batch.schema.names, "shard"])

    html_bytes = F.encode(F.coalesce(F.col(quoted(html)), F.lit("")), "UTF-8")
    nothing = F.lit(None)
    payloads = pages.select(
        F.col(quoted(id)).alias("id"), F.lit(1).alias("kind"), F.col(quoted(url)).cast("string").alias("url"), html_bytes.alias("payload"),
        F.sha2(html_bytes, 256).alias("digest"), nothing.cast(kind).alias("refers_to"),
    )
    referring = decisions.filter("refers_to is not null").distinct()
    referring = referring.select("id", F.lit(0).alias("kind"), nothing.cast("string").alias("url"), nothing.cast("binary").alias("payload"), "digest", "refers_to")
    rows = payloads.unionByName(referring)
    rows = rows.mapInArrow(shard_of, f"id {kind}, kind int, url string, payload binary, digest string, refers_to {kind}, shard int")
    order = ["shard", "id", "digest", "kind", "url"]
    rows = rows.repartition(len(starts) + 1, "shard").sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, count, size, digest, stream, refers = None, 0, 0, 0, None, None, None
        done: list[tuple] = []
        with ExitStack() as stack:

            def close() -> None:
                if stream is not None:
                    stack.close()
                    done.append((shard, f"shard-{shard:05d}-{number:05d}.warc.gz", count, size, digest.hexdigest()))

            for batch in batches:
                for row in batch.to_pylist():
                    if row["kind"] == 0:
                        refers = (row["id"], row["digest"], row["refers_to"])
                        continue
                    target = refers[2] if refers and refers[:2] == (row["id"], row["digest"]) else None
                    data = gzip.compress(record(row["id"], row["url"], row["payload"], row["digest"], target, date), 6, mtime=0)
                    if row["shard"] != shard or size + len(data) > roll_bytes:
                        close()
                        number = number + 1 if row["shard"] == shard else 0
                        shard, count, size, digest = row["shard"], 0, 0, hashlib.sha256()
                        stream = stack.enter_context(committed(folder, f"shard-{shard:05d}-{number:05d}.warc.gz"))
                    stream.write(data)
                    digest.update(data)
                    count, size = count + 1, size + len(data)
            close()
        if done:
            types = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "file", "records", "bytes", "sha256"])

    manifest = rows.mapInArrow(write, "shard int, file string, records long, bytes long, sha256 string")
    manifest.write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and payload of each record of an archive, one after the other."""
    with gzip.GzipFile(fileobj=stream) as data:
        while line := data.readline():
            if not line.strip():
                continue
            fields = {}
            while (line := data.readline()).strip():
                name, _, value = line.decode().partition(":")
                fields[name] = value.strip()
            block = data.read(int(fields["Content-Length"]))
            if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:"):
                raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
            yield fields, block.partition(b"\r\n\r\n")[2]


def read_archives(spark: SparkSession, folder: str, id_type: str = "long") -> DataFrame:
    """``id, url, record_type, payload, payload_bytes, payload_digest, refers_to`` of every record that the manifest lists.

    Length and digest of a response are worked out anew from what was read; a revisit has no payload here and states
    those of the page that it refers to. Block digests are checked.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    files = manifest.select("file").repartition(max(1, manifest.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
        types = [pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string()]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for file in batch.column("file").to_pylist():
                rows, held = [], 0
                with opened(folder, file) as stream:
                    for fields, payload in records(stream):
                        revisit = fields["WARC-Type"] == "revisit"
                        size = int(fields["WARC-Payload-Length"]) if revisit else len(payload)
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                        rows.append((
                            fields["WARC-Page-ID"] or None, fields["WARC-Target-URI"], fields["WARC-Type"], None if revisit else payload,
                            size, digest, fields.get("WARC-Refers-To-Page-ID"),
                        ))
                        held += len(payload)
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    out = files.mapInArrow(
        read, "id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string"
    )
    return out.withColumns({"id": F.col("id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})
