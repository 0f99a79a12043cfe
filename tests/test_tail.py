"""Logs that grow, are rotated, cut and written anew: each line once, over restarts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tracewell.sources.records import parse_lines, read_tsv
from tracewell.sources.tail import TailReader, tail


class Turns:
    """A stream that is started again and again from its checkpoint, and the lines that each turn read."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.at, self.options, self.seen = spark, tmp_path, options, 0
        (tmp_path / "logs").mkdir()

    def __call__(self):
        out = f"{self.at}/out"
        lines = tail(self.spark, f"{self.at}/logs", **self.options)
        query = lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{self.at}/check").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        all_rows = sorted((r.path, r.at, r.value) for r in self.spark.read.schema("value string, path string, at long").parquet(out).collect())
        new, self.seen = len(all_rows) - self.seen, len(all_rows)
        self.values = sorted(v for _, _, v in all_rows)
        return new


def test_a_growing_and_rotated_log_is_read_once(spark, tmp_path):
    turn, log = Turns(spark, tmp_path), tmp_path / "logs" / "dns.log"
    log.write_text("a1\na2\npart")
    assert turn() == 2 and turn() == 0
    with log.open("a") as f:
        f.write("ial\na4\n")
    assert turn() == 2 and "partial" in turn.values
    with log.open("a") as f:  # written before the rotation, read after it
        f.write("a5\na6\n")
    log.rename(tmp_path / "logs" / "dns.2024.log")
    log.write_text("b1\n")
    (tmp_path / "logs" / "other.txt").write_text("no\n")
    assert turn() == 3
    with log.open("a") as f:
        f.write("b2\n")
    assert turn() == 1 and turn() == 0
    assert turn.values == sorted(["a1", "a2", "partial", "a4", "a5", "a6", "b1", "b2"])
    log.write_text("c1\n")  # cut and written anew under the same inode
    assert turn() == 1
    log.write_text("d1 is longer than what was there before\nd2\n")
    assert turn() == 2 and turn.values.count("d2") == 1
    os.remove(tmp_path / "logs" / "dns.2024.log")
    assert turn() == 0


def test_splits_read_each_line_once(tmp_path):
    rng = random.Random(1)
    (tmp_path / "dns1.log").write_bytes(b"".join(bytes(rng.choice(b"abc") for _ in range(rng.randrange(30))) + b"\n" for _ in range(300)) + b"open")
    want = [x.decode() for x in (tmp_path / "dns1.log").read_bytes().split(b"\n")[:-1]]
    for size in (1, 7, 100, 10_000):
        reader = TailReader({"path": str(tmp_path), "splitBytes": size})
        end = reader.latestOffset()
        rows = [r for p in reader.partitions({}, end) for b in reader.read(p) for r in b.to_pylist()]
        assert [r["value"] for r in rows] == want and [r["at"] for r in rows] == sorted({r["at"] for r in rows})
        assert [b for p in reader.partitions(end, end) for b in reader.read(p)] == []


def test_lost_lines_are_an_error_or_left_out(tmp_path):
    (tmp_path / "dns1.log").write_text("a\nb\n")
    reader, lax = (TailReader({"path": str(tmp_path), "failOnDataLoss": x}) for x in ("true", "false"))
    pieces, loose = reader.partitions({}, end := reader.latestOffset()), lax.partitions({}, end)
    (tmp_path / "dns1.log").unlink()
    with pytest.raises(OSError, match="dns1.log"):
        list(reader.read(pieces[0]))
    assert list(lax.read(loose[0])) == [] and reader.latestOffset() == {}


def test_headers_hold_over_restarts(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    log = tmp_path / "logs" / "dns.log"
    log.write_text("#separator \\x09\n#fields\tts\tuid\n1\ta\n")
    def turn():
        rows = parse_lines(tail(spark, f"{tmp_path}/logs"))
        rows.select("ts", "uid", "query").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination(120)
        return sorted((r.ts, r.uid, r["query"]) for r in spark.read.schema("ts string, uid string, query string").parquet(f"{tmp_path}/out").collect())
    assert turn() == [("1", "a", None)]
    with log.open("a") as f:
        f.write('2\tb\n#fields\tquery\tts\nx.org\t3\n{"ts": "4", "uid": "d"}\n{broken\n')
    assert turn() == [("1", "a", None), ("2", "b", None), ("3", None, "x.org"), ("4", "d", None)]


def test_many_headers_and_splits_in_one_file(spark, tmp_path):
    parts, want = [], {}
    for k in range(10_000):
        flip = k % 2
        parts.append(f"#fields\t{'uid' if flip else 'ts'}\t{'ts' if flip else 'uid'}\n")
        for j in range(k % 3):
            parts.append(f"u{k}.{j}\t{k}\n" if flip else f"{k}\tu{k}.{j}\n")
            want[f"u{k}.{j}"] = str(k)
    (tmp_path / "dns.log").write_text("".join(parts) + "".join(f"u-{k}\t9999\n" for k in range(20_000)))  # no header in the last splits
    want |= {f"u-{k}": "9999" for k in range(20_000)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")
    try:
        table = read_tsv(spark, f"{tmp_path}/dns.log")
        assert spark.read.text(f"{tmp_path}/dns.log").select(F.col("_metadata.file_block_start")).distinct().count() > 5
        assert {r.uid: r.ts for r in table.select("uid", "ts").collect()} == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
