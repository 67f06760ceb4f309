"""WARC archives and their two-level capture index (operator 4).

Writing: each page becomes one WARC/1.1 record in a gzip member of its own.
Of pages with equal payloads the one with the largest id carries it; the
others are revisit records that name it. The group of a payload is reduced to
its winner before anything is joined, and the page rows are joined with the
winners by digest, which the join may split where copies abound.

The archives are written by Spark's own text writer and committer, so they go
to any store Spark knows. A member always ends with a zero byte (the top byte
of its length; longer records are cut into members of ``MEMBER`` bytes), and
that byte is what the writer puts between rows: the files are plain .warc.gz
streams, byte for byte.

Reading: files are read whole in tasks (``records_per_file`` bounds them),
members are walked one by one, and payloads are checked against their digests.

Index: captures sorted by reversed-host key are packed, ``BLOCK_LINES`` to a
block, into compressed blocks; the directory holds one row a block. A lookup
finds the last directory row at or before the key by binary search, reads
that block and the next ones that may hold the key, searches their lines, and
reads the record by offset and length. Many urls at once (``lookup_all``) are
merged with the directory, a part of ``PART_BLOCKS`` rows at a time, and then
with the blocks found, which alone are read; both merges stream over sorted
rows, so nothing is held but one part's directory rows or one block. The query
takes its rows this way.

Defined results: null html is an empty payload; a null url has no target
header and the empty key; null page ids come before all others; of repeated
rows with the largest id one is the response; an empty table writes archives
without records and an empty index; a very long payload is one record, read
whole; control characters of a url are percent-encoded, in the record and when
it is looked up; extra columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furlong.llm.common import pick, read_table, store, with_uid
from furlong.session import scratch_path

DATE = "2024-01-01T00:00:00Z"
MEMBER = 8 << 20  # under 2**24, so that a member's last byte is zero
STEP = 1 << 14
RECORDS_PER_FILE = 2000
BLOCK_LINES = 512
DIRECTORY_ROWS = 1 << 18
PART_BLOCKS = 256  # directory rows for each key that every task holds: a key for 131,072 captures
NAMESPACE = uuid.UUID("b6f7c0de-0000-4000-8000-000000000000")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, archive string, offset long, length long, surt string"


def surt(url: str | None) -> str:
    """Reversed-host key: http://www.a.org:80/x?q#f -> org,a)/x?q"""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").removeprefix("www."), u.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    key = ",".join(reversed(host.split(".")))
    if port and (u.scheme, port) not in (("http", 80), ("https", 443)):
        key += f":{port}"
    return f"{key}){u.path or '/'}" + (f"?{u.query}" if u.query else "")


def bare_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_text(url: str) -> str:
    return "".join(quote(c) if c < " " or c == "\x7f" else c for c in url)


def record(page_id: str | None, uid: int, url: str | None, payload: bytes, refers_to: str | None, revisit: bool) -> bytes:
    digest = bare_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{uid}')}>",
             f"WARC-Date: {DATE}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_text(url)}")
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if revisit:
        lines.append(f"WARC-Profile: {REVISIT}")
        if refers_to is not None:
            lines.append(f"Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(data: bytes) -> bytes:
    """Gzip members of at most ``MEMBER`` bytes each."""
    out = []
    for i in range(0, len(data), MEMBER):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(z.compress(data[i : i + MEMBER]) + z.flush())
    return b"".join(out)


def _rows_to_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, held = [], 0
        cols = [batch.column(c) for c in ("page_id", "uid", "url", "payload", "refers_to", "revisit")]
        for i in range(batch.num_rows):
            member = pack(record(*[c[i].as_py() for c in cols]))
            out.append(member[:-1])  # the writer adds the zero byte
            held += len(member)
            if held > MEMBER:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])
                out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])


def write_archives(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """One record a row of ``pages`` (page_id, url, html)."""
    p = with_uid(pick(pages, page_id="page_id", url="url", html="html"))
    p = p.withColumn("payload", F.coalesce(F.col("html").cast("binary"), F.lit(b""))).withColumn("digest", F.sha1("payload"))
    seen = p.select("page_id", "uid", "digest").groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("first"))
    top = seen.groupBy("digest").agg(F.max(F.struct("page_id", "n", "first")).alias("top"))
    rows = p.join(top, "digest")
    leads = F.col("page_id").eqNullSafe(F.col("top.page_id")) & ((F.col("top.n") == 1) | (F.col("uid") == F.col("top.first")))
    members = rows.select(F.col("page_id").cast("string").alias("page_id"), "uid", "url", "payload", F.col("top.page_id").cast("string").alias("refers_to"), (~leads).alias("revisit"))
    (members.mapInArrow(_rows_to_members, "member binary").select(F.col("member").cast("string").alias("value"))
     .write.option("lineSep", "\u0000").option("maxRecordsPerFile", records_per_file).text(path))


def _members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, bytes) of each gzip member."""
    at = 0
    view = memoryview(data)
    while at < len(data):
        z, out, to = zlib.decompressobj(31), [], at
        while not z.eof:
            if to >= len(data):
                raise ValueError("the archive ends inside a member")
            out.append(z.decompress(view[to : to + STEP]))
            to = min(len(data), to + STEP)
        used = to - at - len(z.unused_data)
        yield at, used, b"".join(out)
        at += used


def _parse(raw: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, block, and the bytes still missing."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    size = int(headers["Content-Length"])
    return headers, rest[:size], size + 4 - len(rest)


def parse_records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an archive."""
    begin, raw = 0, b""
    for at, used, out in _members(data):
        if not raw:
            begin = at
        raw += out
        headers, block, missing = _parse(raw)
        if missing <= 0:
            yield begin, at + used - begin, headers, block
            raw = b""
    if raw:
        raise ValueError("the archive ends inside a record")


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (c.split() for c in CAPTURE.split(", "))])
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            rows = []
            for offset, length, headers, block in parse_records(content.as_py()):
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                response = headers["WARC-Type"] == "response"
                if response and (len(payload) != size or bare_digest(payload) != digest):
                    raise ValueError(f"payload of {headers['WARC-Record-ID']} doesn't match its digest")
                url = headers.get("WARC-Target-URI")
                rows.append((headers.get("Page-ID"), url, headers["WARC-Type"], headers.get("Refers-To-Page-ID"), size, digest, path.as_py(), offset, length, surt(url)))
            cols = list(zip(*rows, strict=True)) or [[]] * len(kind)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind, strict=True)], schema=kind)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the archives under ``path``."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_captures, CAPTURE)


def _blocks(lines: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []

        def block(rows: list[tuple[str, str]]) -> pa.RecordBatch:
            body = "\n".join(f"{k}\t{v}" for k, v in rows).encode()
            return pa.RecordBatch.from_arrays([pa.array([rows[0][0]]), pa.array([rows[-1][0]]), pa.array([len(rows)], pa.int32()), pa.array([zlib.compress(body, 6)], pa.binary())], names=["first_key", "last_key", "n", "block"])

        for batch in batches:
            held += zip(batch.column("surt").to_pylist(), batch.column("line").to_pylist(), strict=True)
            while len(held) >= lines:
                yield block(held[:lines])
                held = held[lines:]
        if held:
            yield block(held)
    return run


@dataclass
class Index:
    blocks: DataFrame  # block_id, first_key, last_key, n, block
    directory: DataFrame  # block_id, first_key, last_key


def build_index(captures: DataFrame, block_lines: int = BLOCK_LINES) -> Index:
    """Sorted compressed blocks and their directory, as stored tables."""
    key = F.translate("surt", "\t\n", "")
    line = F.to_json(F.struct(*[c for c in captures.columns if c != "surt"]))
    ordered = captures.select(key.alias("surt"), F.col("page_id"), line.alias("line")).repartitionByRange("surt", "page_id", "line").sortWithinPartitions("surt", "page_id", "line")
    packed = ordered.select("surt", "line").mapInArrow(_blocks(block_lines), "first_key string, last_key string, n int, block binary")
    blocks = store(with_uid(packed, "block_id"), "capture-blocks")
    directory = store(blocks.select("block_id", "first_key", "last_key").repartitionByRange("first_key", "block_id").sortWithinPartitions("first_key", "block_id"), "capture-directory")
    return Index(blocks, directory)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in batch.column("block"):
            rows = [x.split("\t", 1) for x in zlib.decompress(block.as_py()).decode().split("\n")]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([v for _, v in rows])], names=["surt", "line"])


def scan_index(index: Index) -> DataFrame:
    """All captures, from the blocks."""
    return _captures_of(index.blocks.select("block").mapInArrow(_lines, "surt string, line string"))


def _captures_of(lines: DataFrame) -> DataFrame:
    plain = ", ".join(c for c in CAPTURE.split(", ") if not c.startswith("surt"))
    return lines.select("surt", F.from_json("line", plain).alias("c")).select("surt", "c.*")


def _key(url: str | None) -> str:
    """As it was written."""
    return surt(None if url is None else _header_text(url))


def _keys_by_part(leaders: list[str]):
    """Each key with the parts that may hold it: the last that begins below it, and all that begin with it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key in {_key(u) for u in batch.column("url").to_pylist()}:
                out += [(k, key) for k in range(max(0, bisect.bisect_left(leaders, key) - 1), bisect.bisect_right(leaders, key))]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([key for _, key in out], pa.string())], names=["part", "key"])
    return run


def _merge_directory(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block_id, key) of the blocks that may hold each key, from directory rows and keys sorted by part and key."""
    part, near = None, []  # the part's blocks that end at or after the key
    for batch in batches:
        out = []
        for at, key, last, block in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "last_key", "block_id")), strict=True):
            if at != part:
                part, near = at, []
            near = [x for x in near if x[0] >= key]
            if block is None:
                out += [(b, key) for _, b in near]
            else:
                near.append((last, block))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([k for _, k in out], pa.string())], names=["block_id", "key"])


def _merge_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of the keys, searched in the block that comes before them."""
    keys: list[str] = []
    values: list[str] = []
    for batch in batches:
        found = []
        for key, block in zip(batch.column("key").to_pylist(), batch.column("block").to_pylist(), strict=True):
            if block is not None:
                rows = [x.split("\t", 1) for x in zlib.decompress(block).decode().split("\n")]
                keys, values = [k for k, _ in rows], [v for _, v in rows]
            else:
                found += [(key, v) for v in values[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())], names=["surt", "line"])


def lookup_all(index: Index, urls: DataFrame, part_blocks: int = PART_BLOCKS) -> DataFrame:
    """All captures of the urls of ``urls`` (url), each once however often its url is asked; a url that has none adds no row."""
    leads = F.col("block_id").bitwiseAND(F.lit((1 << 33) - 1)) % part_blocks == 0  # numbers are in key order, and begin anew in each written partition
    top = sorted((r.block_id, r.first_key) for r in index.directory.filter(leads).select("block_id", "first_key").collect())
    ids = [b for b, _ in top]

    def part_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect.bisect_right(ids, b) - 1 for b in batch.column("block_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(batch.column(c) for c in ("first_key", "last_key", "block_id"))], names=["part", "key", "last_key", "block_id"])

    directory = index.directory.select("block_id", "first_key", "last_key").mapInArrow(part_of, "part int, key string, last_key string, block_id long")
    asked = urls.select("url").mapInArrow(_keys_by_part([k for _, k in top]), "part int, key string").distinct()
    near = directory.unionByName(asked.withColumns({"last_key": F.lit(None).cast("string"), "block_id": F.lit(None).cast("long")}))
    hits = near.repartition("part").sortWithinPartitions("part", "key", F.col("block_id").asc_nulls_last()).mapInArrow(_merge_directory, "block_id long, key string")
    hits = store(hits, "capture-hits")
    wanted = index.blocks.select("block_id", "block").join(hits.select("block_id").distinct(), "block_id", "left_semi")
    both = wanted.withColumn("key", F.lit(None).cast("string")).unionByName(hits.withColumn("block", F.lit(None).cast("binary")))
    lines = both.repartition("block_id").sortWithinPartitions("block_id", F.col("key").asc_nulls_first()).select("key", "block").mapInArrow(_merge_blocks, "surt string, line string")
    return _captures_of(lines)


def lookup(index: Index, url: str | None) -> list[dict]:
    """Captures of one url, in order. The directory is searched in memory up to
    ``DIRECTORY_ROWS`` rows, and by a pushed-down range filter beyond that."""
    key = _key(url)
    rows = index.directory.orderBy("first_key", "block_id").limit(DIRECTORY_ROWS + 1).collect()
    if len(rows) > DIRECTORY_ROWS:
        ids = [r.block_id for r in index.directory.filter((F.col("first_key") <= key) & (F.col("last_key") >= key)).collect()]
    else:
        at = max(0, bisect.bisect_left([r.first_key for r in rows], key) - 1)
        end = bisect.bisect_right([r.first_key for r in rows], key)
        ids = [r.block_id for r in rows[at:end]]
    found = []
    for r in index.blocks.filter(F.col("block_id").isin(ids)).orderBy("first_key", "block_id").collect() if ids else []:
        lines = [x.split("\t", 1) for x in zlib.decompress(r.block).decode().split("\n")]
        keys = [k for k, _ in lines]
        found += [json.loads(v) for _, v in lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]]
    return found


def read_record(spark: SparkSession, archive: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record, by a range read of its bytes."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(archive)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        stream.seek(offset)
        data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()
    (_, _, headers, block), = parse_records(data)
    return headers, block


def archive_pages(pages: DataFrame) -> Index:
    """Write, read back and index ``pages`` under the shared folder."""
    spark = pages.sparkSession
    path = scratch_path(spark, "llm", f"warc-{uuid.uuid4().hex[:12]}")
    write_archives(pages, path)
    return build_index(store(read_captures(spark, path), "captures"))


def q_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    found = lookup_all(archive_pages(pages), pages)
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


#: Base 32 of a digest: five hexadecimal digits are four letters.
ORACLE_WARC = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(encode(coalesce(html, ''))) AS hex FROM pages
), g AS (
  SELECT hex, max(page_id) AS lead FROM p GROUP BY hex
)
SELECT page_id, octet_length(body) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((CAST('0x' || substr(hex, 5 * (k // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> lead THEN lead END AS refers_to
FROM p JOIN g USING (hex)
"""


