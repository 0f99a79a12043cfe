"""Readers of DNS records and the view of the test tables as DNS events."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.operators.events import settled
from tracewell.schema import FEATURES, RAW


def read_json(spark: SparkSession, paths: str | list[str], keep_raw: bool = False) -> DataFrame:
    """JSON lines, plain or compressed; blank, ``#`` and malformed lines are left out. ``keep_raw`` adds ``__raw_line``."""
    lines = spark.read.text(paths).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    parsed = lines.select(F.from_json("value", RAW, {"mode": "PERMISSIVE"}).alias("e"), F.col("value").alias("__raw_line"))
    kept = parsed.where(F.col("e").isNotNull() & (F.size(F.json_object_keys("__raw_line")) >= 0))
    return kept.select("e.*", *(["__raw_line"] if keep_raw else []))


def _objects(text: bytes, file: str) -> list[str]:
    """The JSON objects of a whole document, each as text; an error if it is anything else, or text follows it."""
    try:
        found = json.loads(text.decode("utf-8-sig"))
    except ValueError as e:
        raise ValueError(f"not JSON objects: {file}: {e}") from e
    items = found if isinstance(found, list) else [found]
    if not items or not all(isinstance(x, dict) for x in items):
        raise ValueError(f"not JSON objects: {file}")
    return [json.dumps(x, ensure_ascii=False) for x in items]


def _is_object(line: bytes, file: str) -> bool:
    try:
        return isinstance(json.loads(line.decode("utf-8")), dict)
    except UnicodeDecodeError as e:
        raise ValueError(f"not JSON objects: {file}: {e}") from e
    except ValueError:
        return False


def _count_objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, list[int]] = {}
    for batch in batches:
        for file, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            told = seen.setdefault(file, [0, 0])
            if (text := line.as_py().strip()):
                told[0 if _is_object(text, file) else 1] += 1
    yield pa.RecordBatch.from_pydict({"file": list(seen), "objects": [n for n, _ in seen.values()], "others": [n for _, n in seen.values()]}, schema=pa.schema([("file", pa.string()), ("objects", pa.int64()), ("others", pa.int64())]))


def _take_objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield pa.RecordBatch.from_pydict({"item": _objects(text.as_py(), file)})


def _plain_path(url: str) -> str:
    """A file's URL as a path for a reader: not encoded, and without patterns."""
    return re.sub(r"([\\*?{}\[\]])", r"\\\1", unquote(url))


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files that hold an object of JSON on each line, one JSON object, or an array of objects; blank lines and a byte-order mark are skipped.

    A file that is empty or holds anything else, be it after a document's end or bytes that aren't UTF-8, is an error. Lines are told from documents by a first pass over all lines, after which files of lines are
    read as such, split over tasks; any other file is one document, held by one task. The driver knows the files' names.
    """
    lines = spark.read.text(paths)
    placed = lambda df: df.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))
    told = placed(lines).mapInArrow(_count_objects, "file string, objects long, others long").groupBy("file").agg(F.sum("objects").alias("objects"), F.sum("others").alias("others")).collect()
    listed = lines.inputFiles()
    bare = lambda url: re.sub(r"^(\w+):///", r"\1:/", unquote(url))
    empty = {bare(f) for f in listed} - {bare(r.file) for r in told}
    if empty or not listed:
        raise ValueError(f"not JSON objects: {sorted(empty)[:3] or paths} are empty")
    by_line, whole = ([_plain_path(r.file) for r in told if (r.objects > 0 and not r.others) is kind] for kind in (True, False))
    items = []
    if by_line:
        items.append(spark.read.text(by_line).where(F.trim("value") != "").select(F.col("value").alias("item")))
    if whole:
        items.append(placed(spark.read.text(whole, wholetext=True)).mapInArrow(_take_objects, "item string"))
    return reduce(DataFrame.unionByName, items).select(F.from_json("item", RAW).alias("e")).select("e.*")


Header = tuple[str | None, str | None, str | None]


def header(line: str, above: Header) -> Header:
    """What holds below a line, given what held above it: the separator, the last ``#fields`` line, and the separator of its names. None is what isn't told yet."""
    sep, fields, own = above
    if line.startswith("#separator"):
        named = line[len("#separator"):].strip()
        code = re.match(r"\\x([0-9A-Fa-f]{2})", named)
        return chr(int(code[1], 16)) if code else "\t" if not named or named.startswith("\\x") else named, fields, own
    return (sep, line, sep) if line.startswith("#fields") else above


_HEADED = pa.schema([("value", pa.string()), ("file", pa.string()), ("split", pa.int64()), ("sep", pa.string()), ("fields", pa.string()), ("fields_sep", pa.string())])


def _under_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each line of data with the header above it in its own split; lines come in their order."""
    at, held = None, (None, None, None)
    for batch in batches:
        rows = []
        for value, file, split in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if at != (file, split):
                at, held = (file, split), (None, None, None)
            if value.startswith("#"):
                held = header(value, held)
            elif value:
                rows.append((value, file, split, *held))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _HEADED, strict=True)], schema=_HEADED)


def read_tsv(spark: SparkSession, paths: str | list[str], keep_invalid: bool = False) -> DataFrame:
    """Tab-separated records whose columns the last ``#fields`` line above them names; ``#separator`` may name another separator, as ``\\x09``.

    Lines that hold a JSON object are read as such. Short rows are padded with the null marker ``-``, long rows are cut, of a name that repeats the last column counts, and
    rows above any header and broken JSON are invalid. Invalid rows are left out, or with ``keep_invalid`` kept as nulls beside a column ``valid``. Columns are text, as in `read_json`.

    A task follows the headers of its split in one pass; what holds where a split begins is found from the header lines alone and joined by file and split, so that no key has more rows than a split.
    """
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")]
    lines = spark.read.text(paths).select(F.regexp_replace("value", r"\r+$", "").alias("value"), *at)
    rows = lines.mapInArrow(_under_headers, "value string, file string, split long, sep string, fields string, fields_sep string")
    heads = lines.where(F.col("value").startswith("#separator") | F.col("value").startswith("#fields")).withColumn("line", F.monotonically_increasing_id())

    def carry(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held, out = (None, None, None), []
        for _, own in pdf.sort_values(["split", "line"]).groupby("split", sort=True):
            for line in own["value"]:
                held = header(line, held)
            out.append((key[0], int(own["split"].iloc[0]), *held))
        return pd.DataFrame(out, columns=["file", "split", "c_sep", "c_fields", "c_fields_sep"])

    ended = heads.groupBy("file").applyInPandas(carry, "file string, split long, c_sep string, c_fields string, c_fields_sep string")
    began = lines.groupBy("file", "split").agg(F.lit(None).cast("string").alias("c_sep"), F.lit(None).cast("string").alias("c_fields"), F.lit(None).cast("string").alias("c_fields_sep"), F.lit(0).alias("end"))
    before = Window.partitionBy("file").orderBy("split", "end")  # a row or two for each split
    held = F.last(F.when(F.col("end") == 1, F.struct("c_sep", "c_fields", "c_fields_sep")), ignorenulls=True).over(before)
    carried = began.unionByName(ended.withColumn("end", F.lit(1))).withColumn("held", held).where("end = 0").select("file", "split", "held.*")
    joined = rows.join(carried, ["file", "split"], "left")
    named = joined.select(
        "value", F.coalesce("sep", "c_sep").alias("sep"), F.coalesce("fields", "c_fields").alias("fields"), F.when(F.col("fields").isNotNull(), F.coalesce("fields_sep", "c_sep")).otherwise(F.col("c_fields_sep")).alias("fields_sep")
    )
    return parse_lines(named, keep_invalid)


def parse_lines(rows: DataFrame, keep_invalid: bool = False) -> DataFrame:
    """Records of lines ``value`` with the header that holds for them: ``sep, fields, fields_sep``; see `read_tsv`. On a table or a stream.

    Lines are cut, and names looked up in their header, once: filters on fields stay above the cutting, and each name's place is a column of its own. In one expression they would be worked out again for each field.
    """
    cut = lambda c, by: F.split(c, F.concat(F.lit("\\Q"), F.coalesce(by, F.lit("\t")), F.lit("\\E")), -1)
    own = cut(F.col("fields"), F.col("fields_sep"))
    own = F.when(F.size(own) > 1, own).otherwise(F.split("fields", r"\s+"))
    names = F.when(F.col("fields").isNotNull(), F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(0))))
    rows = rows.where(~F.col("value").startswith("#") & (F.col("value") != "")).select("value", "sep", names.alias("names"), F.ltrim("value").startswith("{").alias("is_json"))
    rows = rows.withColumns({"found": cut(F.col("value"), F.col("sep")), "json": F.when(F.col("is_json") & F.json_object_keys("value").isNotNull(), F.from_json("value", RAW))})
    valid = F.when(F.col("is_json"), F.col("json").isNotNull()).otherwise(F.coalesce(F.size("names") > 0, F.lit(False)))
    rows = settled(rows.select("found", "json", "is_json", F.reverse("names").alias("names"), F.size("names").alias("n"), valid.alias("valid")))
    rows = rows if keep_invalid else rows.where("valid")
    rows = rows.select("found", "json", "is_json", "n", "valid", *(F.array_position("names", name).alias(f"_{k}") for k, name in enumerate(RAW.names)))

    def field(k: int, name: str) -> Column:
        back = F.col(f"_{k}")
        text = F.when(back > 0, F.coalesce(F.get("found", (F.col("n") - back).cast("int")), F.lit("-")))
        return F.when(F.col("is_json"), F.col("json").getField(name)).otherwise(text).alias(name)

    return rows.select(*(field(k, name) for k, name in enumerate(RAW.names)), *(["valid"] if keep_invalid else []))


def source_manifest(spark: SparkSession, root: str, pattern: str = "dns*") -> DataFrame:
    """Path, size and time of change of every file below ``root``, oldest first. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select("path", "length", "modificationTime").where(F.lower("path").rlike(r"[.](log|log[.]gz|json|jsonl)$")).orderBy("modificationTime", "path")


def manifest_signature(manifest: DataFrame) -> str:
    """One SHA-256 for a manifest: it changes when a file is added, removed or rewritten. Files' digests are summed in 16 parts of 16 bits each, which no order of rows changes, so that no task holds a list of all files."""
    each = F.sha2(F.concat_ws("|", "path", "length", F.unix_micros("modificationTime").cast("string")), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring(each, 1 + 4 * k, 4), 16, 10).cast("long")), F.lit(0)).cast("string") for k in range(16)]
    return manifest.agg(F.sha2(F.concat_ws(",", F.count("*").cast("string"), *parts), 256)).first()[0]


#: Digests of lines are four values below this prime.
PRIME = (1 << 61) - 1
#: Fixed powers of the digest, one for each value: the first digits of a SHA-256 of each number.
BASES = tuple(int(hashlib.sha256(str(k).encode()).hexdigest()[:15], 16) for k in range(4))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split of a file: its lines, records, and the values of the polynomial whose coefficients are its lines' digests."""
    told: dict[tuple[str, int], list] = {}
    for batch in batches:
        for file, split, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            own = told.setdefault((file, split), [0, 0, [0] * 4])
            text = line.as_py()
            h = hashlib.sha256(text).digest()
            own[0] += 1
            own[1] += bool(text.strip()) and not text.strip().startswith(b"#")
            own[2] = [(v * r + int.from_bytes(h[8 * k : 8 * k + 8], "big")) % PRIME for k, (v, r) in enumerate(zip(own[2], BASES, strict=True))]
    rows = [(f, s, n, m, *v) for (f, s), (n, m, v) in told.items()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, [pa.string(), *[pa.int64()] * 7], strict=True)], ["path", "split", "lines", "records", "v0", "v1", "v2", "v3"])


def line_digests(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``path, lines, records, digest`` of each file that has lines. Records are lines that aren't blank or comments.

    The digest is of the lines, compressed or not, whatever their ends, and the same however a file is split: each split's lines are folded into four values of 61 bits, which are put together in the order of splits, and only these
    come together by file. It tells changed files apart; it isn't made to withstand one who forges lines on purpose.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))
    parts = lines.mapInArrow(_folded, "path string, split long, lines long, records long, v0 long, v1 long, v2 long, v3 long")

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values, lines = [0] * 4, 0
        for r in pdf.sort_values("split").itertuples():
            values = [(v * pow(b, r.lines, PRIME) + x) % PRIME for v, b, x in zip(values, BASES, (r.v0, r.v1, r.v2, r.v3), strict=True)]
            lines += r.lines
        return pd.DataFrame([(key[0], lines, int(pdf["records"].sum()), hashlib.sha256(f"{lines}:{values}".encode()).hexdigest())], columns=["path", "lines", "records", "digest"])

    return parts.groupBy("path").applyInPandas(join, "path string, lines long, records long, digest string")


def input_manifest(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Path, digest of the lines, bytes and number of records, lines that aren't blank or comments, of each file. No file is held in one row."""
    sizes = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", r"^(\w+):/+", r"$1:/").alias("path"), F.col("length").alias("bytes"))
    told = line_digests(spark, paths).select(F.regexp_replace("path", r"^(\w+):/+", r"$1:/").alias("path"), "digest", "records")
    return sizes.join(told, "path", "left").withColumn("records", F.coalesce("records", F.lit(0))).select("path", "digest", "bytes", "records")


def output_digest(spark: SparkSession, path: str) -> str:
    """One digest of a folder of text: of its files' digests in the order of their names."""
    rows = line_digests(spark, path).orderBy("path").collect()  # a row for each file
    return hashlib.sha256("|".join(r.digest for r in rows).encode()).hexdigest()


def consolidate(spark: SparkSession, root: str, out: str, pattern: str = "dns*") -> int:
    """Writes the lines of all segments below ``root``, oldest first, as compressed text, and returns how many records there are."""
    at = F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("at")
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root).select("value", at).where(F.trim("value") != "")
    lines.orderBy("at").select("value").write.mode("overwrite").option("compression", "gzip").text(out)
    return spark.read.text(out).where(~F.col("value").startswith("#")).count()


def write_events(df: DataFrame, path: str) -> None:
    """JSON lines in the order of time."""
    df.orderBy("ts").write.mode("overwrite").json(path)


def write_features(windows: DataFrame, path: str) -> None:
    """The feature table with its keys, replaced as a whole."""
    windows.select("window_start", "src_ip", *FEATURES).write.mode("overwrite").parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows over at least as many partitions as there are cores: a small file is one split, and one task would work on all of it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def from_event_table(events: DataFrame, pooled: bool = True) -> DataFrame:
    """DNS-shaped rows from the generic event table: four kinds of users misbehave in one way each, one asks unusual resolvers, five are ordinary.

    ``pooled`` makes one source of all users of a kind, of which there are ten, so that a day's window holds enough events for the rules; else each user is a source.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    user = F.col("user_id")
    source = F.concat(F.lit("10.0.0."), (user % 10).cast("string")) if pooled else F.concat_ws(".", F.lit("10"), *((F.shiftright(user, n) % 256).cast("string") for n in (16, 8, 0)))
    base = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", source.alias("source"), (user % 10).cast("int").alias("r"), k.alias("k"), F.sha2(F.col("event_id").cast("string"), 256).alias("h"))
    r, k = F.col("r"), F.col("k")
    text = lambda c: c.cast("string")
    query = (
        F.when(r == 0, F.concat(F.expr("substr(h, 1, 20 + k % 9)"), F.lit(".dga.example.com")))
        .when(r == 1, F.concat(F.substring("h", 1, 52), F.lit("."), F.substring("h", 3, 40), F.lit(".t.example.net")))
        .when(r == 2, F.concat(F.lit("node-"), text(1000 + F.col("event_id") % 9000), F.lit(".edge.example.com")))
        .otherwise(F.concat(F.upper("event_type"), F.lit("-"), text(k % 20), F.lit(".Example.org.")))
    )
    qtype = F.when((r == 1) & (k % 5 < 4), "TXT").when(F.col("event_type") == "click", "AAAA").when(F.col("event_type") == "signup", "MX").otherwise("A")
    rcode = F.when((r == 0) & (k % 10 < 9), "NXDOMAIN").when((r == 3) & (k % 10 < 8), "SERVFAIL").otherwise("NOERROR")
    n = F.when(F.col("rcode_name") != "NOERROR", 0).when(r == 2, 4 + k % 5).otherwise(1 + k % 2)
    ttl = F.when(r == 2, 15 + k % 16).otherwise(120 + 60 * (k % 5))
    shaped = base.withColumns({"query": query, "qtype_name": qtype, "rcode_name": rcode}).withColumn("n", n.cast("int"))
    places = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    return shaped.select(
        "ts", F.concat(F.lit("C"), text(F.col("event_id"))).alias("uid"), F.col("source").alias("src_ip"),
        F.when(r == 4, F.concat(F.lit("203.0.113."), text(1 + k % 6))).otherwise(F.concat(F.lit("192.0.2."), text(1 + k % 2))).alias("dns_server"),
        "query", "qtype_name", "rcode_name", (F.col("value") / 1000).alias("rtt"),
        F.transform(places, lambda i: F.concat(F.lit("198.51.100."), text((F.col("event_id") * 7 + i) % 250))).alias("answers"),
        F.transform(places, lambda i: ttl.cast("double")).alias("ttls"),
    )


def dns_events(spark: SparkSession, sf_dir: str, pooled: bool = True) -> DataFrame:
    return from_event_table(spread(spark.read.parquet(f"{sf_dir}/events.parquet")), pooled)
