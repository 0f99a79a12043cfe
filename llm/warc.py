"""WARC archives: records of captures written as compressed files, read back as a stream of records, and assembled into one nested row per capture.

Records are made of native expressions and written by Spark's own text writer, whose line end is the end of a record, so that tasks commit their files as any table's. The reader splits at the
same mark, and each task puts together what a payload that holds the mark itself has cut: lengths decide. A task holds one record at a time, whatever the size of a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from llm._common import fresh, join_counted, materialize

END = "\r\n\r\n"
MARK = END + "WARC/"
#: Payloads of fewer bytes are written again each time.
LEAST = 100
#: Bytes of payload in a batch that a reading task hands on.
BATCH = 4 << 20
#: Records with one of these types are what the others of a capture are about.
CAPTURED = ("response", "revisit", "resource", "conversion")
RECORD = (
    "record_id string, type string, date string, uri string, concurrent_to array<string>, refers_to string, headers map<string,string>, http_status int, http_headers map<string,string>, "
    "payload binary, payload_bytes long, payload_digest string, intact boolean, fields map<string,string>"
)


def _urn(kind: str, *parts: Column) -> Column:
    """A record id by a digest of what tells the record from others."""
    h = F.sha2(F.concat_ws("\n", F.lit(kind), *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: Column, ident: Column, date: str, headers: dict[str, Column], block: Column) -> Column:
    """The bytes of a record up to, but without, the mark of its end. Headers that are null are left out."""
    named = [F.concat(F.lit(f"{k}: "), v) for k, v in headers.items()]
    head = F.concat_ws("\r\n", F.concat(F.lit("WARC/1.1\r\nWARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), ident), F.lit(f"WARC-Date: {date}"), *named, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head.cast("binary"), F.lit(END).cast("binary"), block)


def shared_payloads(pages: DataFrame, digest: str, size: str, page_id: str, least: int = LEAST) -> DataFrame:
    """The payloads of ``least`` bytes or more that several rows have: digest, the smallest page id, null only if all are null, and the number of rows."""
    return pages.where(F.col(size) >= least).groupBy(digest).agg(F.min(page_id).alias("_first"), F.count("*").alias("_rows")).where("_rows > 1")


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z", least: int = LEAST, most: int = 100_000) -> None:
    """Writes a request, a response or revisit, and a metadata record for each row as gzip files below ``path``, at most ``most`` rows a file.

    Of rows with equal payloads of at least ``least`` bytes that of the smallest id is the response, and the others are revisits without payload that refer to it. Rows that repeat this smallest
    id and its payload are further requests and metadata records of the one response, whose record each of them writes again under its one id. A null id comes after all others, and payloads that only rows without an id
    have are responses all. A null payload is empty; a null url has no header. Line ends in a url are escaped. An empty table gives no records. The metadata record holds the id, if there is one.
    Other columns aren't written, whatever their names.
    """
    slim = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary").alias("payload"))
    slim = slim.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    shared = materialize(shared_payloads(slim.drop("payload"), "digest", "size", "page_id", least), "payloads")
    known = join_counted(slim, shared, ["digest"], "_rows", how="left", salt=F.xxhash64("page_id", "url"))
    first, own = F.col("_first"), F.col("page_id")
    revisit = first.isNotNull() & ~own.eqNullSafe(first)
    # only ids that a revisit refers to are made of the payload; any other is its row's own
    row = F.concat_ws(".", F.spark_partition_id(), F.monotonically_increasing_id(), F.xxhash64("page_id", "url"))
    marked = known.withColumn("row", row).withColumn("revisit", revisit)
    response = F.when(F.col("_first").isNotNull() & ~F.col("revisit"), _urn("response", own, F.col("digest"))).otherwise(_urn("capture", own, F.col("digest"), F.col("row")))
    safe = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    named = marked.withColumns({
        "response": response, "request": _urn("request", own, F.col("digest"), F.col("row")), "about": _urn("metadata", own, F.col("digest"), F.col("row")), "safe": safe,
        "refers": F.when(F.col("revisit"), _urn("response", first, F.col("digest"))),
    })
    binary = lambda c: c.cast("binary")
    http = binary(F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END)))
    kind, uri = F.when(F.col("revisit"), "revisit").otherwise("response"), {"WARC-Target-URI": F.col("safe")}
    profile = F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    got = _record(kind, F.col("response"), date, uri | {"WARC-Payload-Digest": F.concat(F.lit("sha256:"), F.col("digest")), "WARC-Profile": profile, "WARC-Refers-To": F.col("refers"), "Content-Type": F.lit("application/http;msgtype=response")},
                  F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("payload"))))
    host, rest = F.regexp_extract("safe", r"://([^/?#]*)", 1), F.regexp_extract("safe", r"://[^/?#]*([^#]*)", 1)
    line = F.concat(F.lit("GET "), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    asked = _record(F.lit("request"), F.col("request"), date, uri | {"WARC-Concurrent-To": F.col("response"), "Content-Type": F.lit("application/http;msgtype=request")}, binary(F.coalesce(line, F.lit("GET / HTTP/1.1" + END))))
    about = _record(F.lit("metadata"), F.col("about"), date, uri | {"WARC-Concurrent-To": F.col("response"), "Content-Type": F.lit("application/warc-fields")}, binary(F.coalesce(F.concat(F.lit("page_id: "), own.cast("string"), F.lit("\r\n")), F.lit(""))))
    rows = named.select(F.explode(F.array(asked, got, about)).alias("record"))
    rows.select(F.col("record").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 3 * most).text(path)


def _headers(head: bytes) -> tuple[str, list[tuple[str, str]]]:
    """The first line, and the names, lower-cased, and values below it; a line that begins with white space goes on from the one before."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = out[-1][0], f"{out[-1][1]} {line.strip()}"
        elif line:
            name, _, value = line.partition(":")
            out.append((name.strip().lower(), value.strip()))
    return first, out


def _whole(text: bytes, file: str) -> tuple[list[tuple[str, str]], int, int]:
    """The headers of a record, where its block begins, and how long it is; an error if it isn't a record."""
    at = text.find(END.encode())
    named = _headers(text[: at if at >= 0 else len(text)])[1]
    head = dict(named)
    length = head.get("content-length", "")
    if at < 0 or not length.isdigit() or "warc-record-id" not in head or "warc-type" not in head:
        raise ValueError(f"not a WARC record with an id, a type and a length: {file}")
    return named, at + len(END), int(length)


def _parsed(named: list[tuple[str, str]], block: bytes, file: str) -> dict:
    import hashlib

    head: dict[str, str] = {}
    for k, v in named:
        head.setdefault(k, v)
    row = {
        "record_id": head["warc-record-id"], "type": head["warc-type"].lower(), "date": head.get("warc-date"), "uri": head.get("warc-target-uri"), "concurrent_to": [v for k, v in named if k == "warc-concurrent-to"],
        "refers_to": head.get("warc-refers-to"), "headers": list(head.items()), "http_status": None, "http_headers": None, "fields": None,
    }
    kind, payload, fields = head.get("content-type", "").lower(), block, {}
    if kind.startswith("application/http"):
        top, _, payload = block.partition(END.encode())
        first, lines = _headers(top)
        for k, v in lines:
            fields.setdefault(k, v)
        status = first.split(" ")[1:2]
        row |= {"http_headers": list(fields.items()), "http_status": int(status[0]) if first.startswith("HTTP/") and status and status[0].isdigit() else None}
    elif kind.startswith("application/warc-fields"):
        for k, v in _headers(b"\r\n" + block)[1]:
            fields.setdefault(k, v)
        row["fields"] = list(fields.items())
    declared = head.get("warc-payload-digest", "")
    told = declared[len("sha256:"):].lower() if declared.lower().startswith("sha256:") else None
    if row["type"] == "revisit":  # what isn't there is known by its headers only
        size = fields.get("content-length", "")
        return row | {"payload": None, "payload_bytes": int(size) if size.isdigit() else None, "payload_digest": told, "intact": None}
    digest = hashlib.sha256(payload).hexdigest()
    return row | {"payload": payload, "payload_bytes": len(payload), "payload_digest": digest, "intact": None if told is None else told == digest}


_ARROW = pa.schema([
    ("record_id", pa.string()), ("type", pa.string()), ("date", pa.string()), ("uri", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("http_status", pa.int32()),
    ("http_headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()), ("fields", pa.map_(pa.string(), pa.string())),
])


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of parts between marks, in the order of their files. A part that is shorter than its record's length goes on in the next ones."""
    kept, rows, size = None, [], 0  # kept: the parts of a record so far, its file, and how many bytes are missing

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    def take(text: bytes, file: str, known=None) -> None:
        """The records of a part, of which there are several where the splitting reader has overlooked a mark: it can, where a block ends like a mark's beginning."""
        nonlocal kept, size
        while text:
            named, start, length = known or _whole(text, file)
            if start + length > len(text):
                kept = [[text], file, start + length - len(text), (named, start, length)]
                return
            rows.append(_parsed(named, text[start : start + length], file))
            size += length + 500
            text, known = text[start + length :], None
            if text.startswith(MARK.encode()):
                text = text[len(MARK) :]
            elif text.strip(b"\r\n"):
                raise ValueError(f"a WARC record is longer than it says: {file}")
            else:
                return

    for part in batches:
        for value, file in zip(part.column(0), part.column(1), strict=True):
            text, file = value.as_py(), file.as_py()
            if kept and kept[1] != file:
                raise ValueError(f"a WARC record is cut off, or lies across splits of a file that isn't compressed: {kept[1]}")
            if kept:
                kept[0].append(MARK.encode() + text)
                kept[2] -= len(MARK) + len(text)
                if kept[2] <= 0:
                    parts, known = kept[0], kept[3]
                    kept = None
                    take(b"".join(parts), file, known)
            elif text.strip():
                take(text, file)
            if size > BATCH:
                yield batch()
                rows.clear()
                size = 0
    if kept:
        raise ValueError(f"a WARC record is cut off, or lies across splits of a file that isn't compressed: {kept[1]}")
    if rows:
        yield batch()


def read_warc(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The records of WARC files, gzip-compressed as a whole or record by record, or plain: a row for each with the columns `RECORD`.

    Header names are lower-cased, and of a repeated one the first counts, but for ``WARC-Concurrent-To``. The payload of an HTTP message is what follows its own header. A revisit has none; its size and digest are those that its headers tell.
    ``intact`` says whether the payload has the SHA-256 that its record tells. Empty files have no records. What isn't a record, or is cut off, is an error, as is a record of a plain file whose payload holds
    the beginning of a record where Spark splits the file.
    """
    lines = spark.read.option("lineSep", MARK).text(paths)
    block = F.concat_ws("@", "_metadata.file_path", "_metadata.file_block_start")
    return lines.select(F.col("value").cast("binary").alias("value"), block.alias("file")).mapInArrow(_records, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture: ``record_id``, ``type``, ``uri``, ``date``, the ``capture`` itself as a struct, and its ``requests`` and ``metadata`` as arrays of structs.

    A capture is a response, revisit, resource or conversion, with the requests and metadata records that name it, that it names, or that do so through one record in between. A record that leads to no capture is
    in a row of its own without a ``capture``. Records that repeat an id are one record. Structs have the columns that ``records`` has, so that payloads which aren't needed can be left out before. ``records`` is read several
    times and should be a written table. An empty table gives no rows.
    """
    inner = [c for c in records.columns if c != "record_id"]
    once = records.groupBy("record_id").agg(*(F.first(c).alias(c) for c in inner))
    slim = once.select("record_id", F.col("type").isin(*CAPTURED).alias("captured"), "concurrent_to")
    said = slim.select(F.col("record_id").alias("a"), F.explode("concurrent_to").alias("b")).where("a != b")
    links = said.union(said.select("b", "a")).distinct()
    anchors = slim.where("captured").select(F.col("record_id").alias("b"))
    others = slim.where("not captured").select(F.col("record_id").alias("a"))
    near = links.join(anchors, "b").join(others, "a").groupBy("a").agg(F.min("b").alias("anchor"))
    through = links.join(near.select(F.col("a").alias("b"), "anchor"), "b").join(others.join(near, "a", "left_anti"), "a").groupBy("a").agg(F.min("anchor").alias("anchor"))
    placed = near.union(through).withColumnRenamed("a", "record_id")
    (own,) = fresh(records, "own")
    struct = F.struct("record_id", *inner)
    rest = once.where(~F.coalesce(F.col("type").isin(*CAPTURED), F.lit(False))).join(placed, "record_id", "left").select(F.coalesce("anchor", "record_id").alias("key"), "type", struct.alias(own))
    members = rest.groupBy("key").agg(
        F.collect_list(F.when(F.col("type") == "request", F.col(own))).alias("requests"),
        F.collect_list(F.when(F.col("type") != "request", F.col(own))).alias("metadata"),
    )
    by_id = lambda c: F.array_sort(F.coalesce(F.col(c), F.array().cast(members.schema[c].dataType)), lambda x, y: F.when(x["record_id"] < y["record_id"], -1).when(x["record_id"] > y["record_id"], 1).otherwise(0))
    captured = once.where(F.col("type").isin(*CAPTURED)).select(F.col("record_id").alias("key"), struct.alias("capture"))
    joined = captured.join(members, "key", "full")
    lone = F.coalesce(F.get("requests", F.lit(0)), F.get("metadata", F.lit(0)))
    told = lambda c: F.coalesce(F.col(f"capture.{c}"), lone[c]).alias(c)
    return joined.select(F.col("key").alias("record_id"), *(told(c) for c in ("type", "uri", "date") if c in inner), "capture", by_id("requests").alias("requests"), by_id("metadata").alias("metadata"))
