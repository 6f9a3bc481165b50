"""Radio captures: packet files read in splits, decoded into rows, and found and grouped into recordings.

The data source `capture` cuts files into byte ranges, so a file of any size is read
by many tasks: each finds the first record of its range by following the lengths in
record headers. Header fields are column expressions; samples are unpacked by one
numpy view for each Arrow batch.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

# Fixed values of the formats: capture file magics (little and big endian, micro- and nanoseconds), payload marks, the longest record.
CAPTURE_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1e-6), b"\xa1\xb2\xc3\xd4": (">", 1e-6), b"\x4d\x3c\xb2\xa1": ("<", 1e-9), b"\xa1\xb2\x3c\x4d": (">", 1e-9)}
PAYLOAD_MARKS = (b"\x11\x11\x11\x11", b"\x11\x11")
HEADER, LONGEST = 14, 262_144
#: Bytes and records over which a chain must hold before it counts: more than a packet, in which another capture may lie.
MARGIN, LINKS = 128 << 10, 16
#: Seconds that a record may lie before or after its file's first.
SPAN = 10 * 366 * 86_400

RECORDS = "path string, at long, ts double, mac string, payload binary"


# ---------------------------------------------------------------- records in a range of bytes
class Records:
    """The records that begin in bytes [start, end) of a capture; `read(at, size)` gives bytes of the file."""

    def __init__(self, read, size: int, start: int, end: int):
        head = read(0, 28)
        self.known = head[:4] in CAPTURE_MAGIC
        if not self.known:
            return
        order, self.unit = CAPTURE_MAGIC[head[:4]]
        self.header = struct.Struct(order + "4I")
        self.first = struct.unpack(order + "I", head[24:28])[0] if len(head) == 28 else 0
        self.start, self.end, self.size = max(start, 24), min(end, size), size
        self.base = 24 if start <= 24 else max(24, start - MARGIN)
        self.data = read(self.base, min(size, end + 16 + LONGEST) - self.base) if self.base < size else b""

    def _sound(self, at: int) -> int:
        """Where the record after the one at `at` (in data) begins; -1 if there is no likely record header."""
        if at + 16 > len(self.data):
            return -1
        seconds, part, size, whole = self.header.unpack_from(self.data, at)
        likely = 0 < size <= min(whole, LONGEST) and part * self.unit < 1 and abs(seconds - self.first) <= SPAN
        return at + 16 + size if likely else -1

    def _begin(self) -> int:
        """The first record of the range, in data.

        At the file's head it is known. Elsewhere chains are tried from every byte, from
        MARGIN before the range on. The first that holds for LINKS records and MARGIN bytes
        is the file's: one that starts within a packet would have to leave it at a record.
        Near the end of what was read, the chain of most records that gets there is.
        """
        if self.base == 24 and self.start == 24:
            return 0
        most, best = 0, len(self.data)
        for at in range(len(self.data)):
            to, links = at, 0
            while (after := self._sound(to)) >= 0 and not (links >= LINKS and to >= at + MARGIN):
                to, links = after, links + 1
            if after >= 0 or to + 16 > len(self.data) and links > most:
                most, best = links, at
                if after >= 0:
                    break
        while best + self.base < self.start and best + 16 <= len(self.data):
            best += 16 + self.header.unpack_from(self.data, best)[2]
        return best

    def __iter__(self) -> Iterator[tuple[int, float, int, int]]:
        """(position in the file, timestamp, begin and end of the frame in data); a cut-off or overlong record ends the file."""
        if not self.known:
            return
        at = self._begin()
        while at + 16 <= len(self.data) and self.base + at < self.end:
            seconds, part, size, _ = self.header.unpack_from(self.data, at)
            if size > LONGEST or self.base + at + 16 + size > self.size:
                return
            yield self.base + at, seconds + part * self.unit, at + 16, at + 16 + size
            at += 16 + size


def sample_packets(records: Records, path: str, mac: bytes | None = None, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """UDP payloads of Ethernet IPv4 frames that carry a sample mark, of one sender if mac is given."""
    found = list(records)
    for i in range(0, len(found), rows):
        at, ts, begin, end = map(np.array, zip(*found[i : i + rows]))
        data = np.frombuffer(records.data, np.uint8)
        byte = lambda k: data[np.minimum(begin + k, len(data) - 1)]
        ok = (end - begin >= 42) & (byte(12) == 8) & (byte(13) == 0) & (byte(14) >> 4 == 4) & (byte(23) == 17)
        begin = begin + 22 + 4 * (byte(14) & 15).astype(np.int64)
        ones = np.minimum.accumulate([byte(k) == 0x11 for k in range(4)])
        mark = np.where(ones[3], 4, 2)
        ok &= ones[1] & (end - begin >= mark + HEADER)
        if mac is not None:
            for k, b in enumerate(mac):
                ok &= byte(mark + k) == b
        kept = np.flatnonzero(ok)
        raw = records.data
        macs = [raw[a : a + 6].hex(":") for a in (begin + mark)[kept].tolist()]
        payloads = [raw[a:b] for a, b in zip(begin[kept].tolist(), end[kept].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(kept), pa.string()), pa.array(at[kept], pa.int64()), pa.array(ts[kept], pa.float64()), pa.array(macs, pa.string()), pa.array(payloads, pa.binary())], ["path", "at", "ts", "mac", "payload"])


# ---------------------------------------------------------------- the data source
def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Ranges(InputPartition):
    """Byte ranges that one task reads: a piece of a large file, or many small files."""

    ranges: list[tuple[str, int, int, int]]  # path, size of the file, start, end


class CaptureReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", 64 << 20))
        self.mac = options.get("mac")

    def partitions(self) -> list[Ranges]:
        store, inner = located(self.path)
        info = store.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(inner, recursive=True)) if f.is_file]
        out, held, weight = [], [], 0
        for f in sorted(files, key=lambda f: f.path):
            name = f.path.rpartition("/")[2]
            if name.startswith((".", "_")):
                continue
            for start in range(0, f.size, self.split):
                end = min(start + self.split, f.size)
                held.append((f.path, f.size, start, end))
                weight += end - start
                if weight >= self.split:
                    out, held, weight = [*out, Ranges(held)], [], 0
        return [*out, Ranges(held)] if held else out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = located(self.path)
        mac = bytes.fromhex(self.mac.replace(":", "")) if self.mac else None
        for path, size, start, end in partition.ranges:
            with store.open_input_file(path) as file:
                records = Records(lambda at, n: file.read_at(n, at), size, start, end)
            yield from sample_packets(records, path, mac)


class PushingReader(CaptureReader):
    """Takes an equality on mac into the reader, so that other senders' packets never become rows."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802  Spark's name
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("mac",) and self.mac in (None, f.value) and _is_mac(f.value):
                self.mac = f.value
            else:
                yield f


def _is_mac(value) -> bool:
    """Of the form in which the source writes senders."""
    try:
        return bytes.fromhex(value.replace(":", "")).hex(":") == value and len(value) == 17
    except (ValueError, AttributeError):
        return False


class CaptureSource(DataSource):
    """spark.read.format("capture").load(path): path, at, ts, mac, payload of every sample packet under path.

    Options: split (bytes of a range), mac (a sender, as aa:bb:cc:dd:ee:ff). With
    spark.sql.python.filterPushdown.enabled an equality on mac reaches the reader too.
    """

    @classmethod
    def name(cls) -> str:
        return "capture"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema) -> DataSourceReader:
        from pyspark.sql import SparkSession

        session = SparkSession.getActiveSession()
        pushes = self.options.get("pushdown") or (session and session.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
        return (PushingReader if pushes == "true" else CaptureReader)(self.options)


def packets(spark: SparkSession, path: str, mac: str | None = None, split: int = 64 << 20) -> DataFrame:
    """path, at (position in its file), ts, mac, payload; a file that is no capture gives no rows.

    Where Arrow knows no way to the store, files come whole through Spark's own reader.
    """
    try:
        located(path)
    except pa.ArrowInvalid:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

        def run(batches):
            for batch in batches:
                for name, content in zip(*(c.to_pylist() for c in batch.columns)):
                    yield from sample_packets(Records(lambda at, n, c=content: c[at : at + n], len(content), 0, len(content)), name)

        rows = files.mapInArrow(run, RECORDS)
        return rows if mac is None else of_mac(rows, mac)
    spark.dataSource.register(CaptureSource)
    reader = spark.read.format("capture").option("split", split).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    reader = reader if mac is None else reader.option("mac", mac.lower())
    return reader.load(path)


# ---------------------------------------------------------------- payloads
def unpack(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed samples: two 16-bit halves of sign, 9-bit mantissa (less 512 if signed) and 6-bit exponent."""
    w = words.astype(np.int64)

    def half(h: np.ndarray) -> np.ndarray:
        mantissa = ((h >> 6) & 0x1FF) - 512 * ((h >> 15) & 1)
        return mantissa * np.exp2((h & 0x3F) - 31.0)

    # the upper half holds sign 31, mantissa 30..22 and exponent 21..16
    return half(w >> 16), half(w & 0xFFFF)


def _after_mark(payload: Column) -> Column:
    """Bytes of the mark that a payload begins with; null if it is no sample packet."""
    out = F.lit(None).cast("int")
    for mark in reversed(PAYLOAD_MARKS):
        out = F.when(F.substring(payload, 1, len(mark)) == F.lit(mark), len(mark)).otherwise(out)
    return out


def _begins(payload: Column, mac: str) -> Column:
    """Whether a payload is a mark and this sender; of two marks that fit, the longer counts."""
    if not _is_mac(mac.lower()):
        return F.lit(False)
    sender = bytes.fromhex(mac.replace(":", ""))
    first, *others = (F.startswith(payload, F.lit(mark + sender)) for mark in PAYLOAD_MARKS)
    for other in others:
        first |= other & ~F.startswith(payload, F.lit(PAYLOAD_MARKS[0]))
    return first


def headers(packets: DataFrame, payload: str, bins: int = 64, mac: str | None = None) -> DataFrame:
    """packets plus mac, seq, core; rows whose payload is null, no sample packet or too short for its bins go.

    With a sender's mac, in whatever case, its packets alone: the payload's first bytes are
    compared, so Spark, which takes a filter to its input and writes out every column in it,
    decodes no other sender's header.
    """
    p, at = F.col(payload), _after_mark(F.col(payload))
    rows = packets if mac is None else packets.where(_begins(p, mac))
    rows = rows.where(F.octet_length(p) >= at + HEADER + 4 * bins)
    digits = F.lower(F.hex(F.substring(p, at + 1, F.lit(10))))
    byte = lambda i: F.substring(digits, 2 * i + 1, 2)
    number = lambda *i: F.conv(F.concat(*map(byte, i)), 16, 10).cast("int")
    return rows.withColumns({"mac": F.concat_ws(":", *map(byte, range(6))), "seq": number(7, 6), "core": number(8).bitwiseAND(F.lit(7))})


def samples(packets: DataFrame, payload: str, bins: int = 64) -> DataFrame:
    """Rows of headers() with re and im in place of the payload."""
    keep = [c for c in packets.columns if c != payload]
    rows = packets.select(*keep, payload)
    schema = T.StructType([*rows.select(*keep).schema.fields, *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("re", "im"))])

    def run(batches):
        for batch in batches:
            bodies = batch.column(len(keep)).cast(pa.large_binary())
            offs = np.frombuffer(bodies.buffers()[1], np.int64)[bodies.offset : bodies.offset + len(bodies) + 1]
            data = np.frombuffer(bodies.buffers()[2] or b"", np.uint8)
            mark = np.where(np.all([data[offs[:-1] + k] == 0x11 for k in range(4)], axis=0), 4, 2) if len(bodies) else offs[:0]
            words = data[(offs[:-1] + mark + HEADER)[:, None] + np.arange(4 * bins)].view("<u4") if len(bodies) else np.zeros((0, bins), "<u4")
            ends = pa.array(np.arange(len(bodies) + 1) * bins, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in unpack(words))], [*keep, "re", "im"])

    return rows.mapInArrow(run, schema)


def read_captures(spark: SparkSession, path: str, mac: str | None = None, bins: int = 64, split: int = 64 << 20) -> DataFrame:
    """path, seq (position in its file), ts, mac, core, re, im of all sample packets under path; packets too short for their bins are skipped."""
    rows = headers(packets(spark, path, mac, split).drop("mac"), "payload", bins)
    return samples(rows.select("path", F.col("at").alias("seq"), "ts", "mac", "core", "payload"), "payload", bins)


def of_mac(packets: DataFrame, mac: str) -> DataFrame:
    """The packets of one sender, in whatever case it is written; for payloads not yet decoded see headers()."""
    return packets.where(F.lower("mac") == mac.lower())


#: person, room, setup, trajectory and receiver come from anchored path parts; the activity from the file's stem alone.
PARTS = {"person": r"(?:^|/)person_([^/]+)/", "room": r"(?:^|/)room_([^/]+)/", "setup": r"(?:^|/)setup_([^/]+)/", "trajectory": r"(?:^|/)trajectory_([^/]+)/"}


def recordings(files: DataFrame, suffix: str = "pcap", fallback: bool = False, activities: tuple[str, ...] | None = None, rule: str = "last") -> DataFrame:
    """path -> recording_id, person, room, setup, trajectory, activity, repetition, rx0, rx1, rx2, copied.

    The id is the whole path less the receiver, so equal stems of two persons
    stay apart. All three receivers are needed, or, with `fallback`, the first
    stands in where the second is missing. The activity is the stem without its
    repetition, or, with a list of activities, the one that the path names by the rule.
    """
    from ..operators.split import activity_of, receiver_triplets

    rx = F.regexp_extract("path", rf"_rx([0-2])\.{suffix}$", 1)
    rows = files.select("path").withColumn("rx", rx).where("rx <> ''").withColumn("rx", F.col("rx").cast("int"))
    rows = rows.withColumn("recording_id", F.regexp_replace("path", rf"_rx[0-2]\.{suffix}$", ""))
    wide = receiver_triplets(rows, ["recording_id"], "rx", "path", fallback)
    stem = F.regexp_extract("recording_id", r"([^/]+)$", 1)
    for name, pattern in PARTS.items():
        wide = wide.withColumn(name, F.nullif(F.regexp_extract("recording_id", pattern, 1), F.lit("")))
    activity = F.regexp_replace(F.lower(stem), r"_?rep[0-9]+$", "") if activities is None else activity_of(F.col("recording_id"), activities, rule)
    return wide.withColumn("activity", activity).withColumn("repetition", F.regexp_extract(stem, r"rep([0-9]+)$", 1))
