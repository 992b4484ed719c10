"""Dictionary-compressed WARC writing.

A shard is one WARC file: a skippable frame that holds a Zstandard dictionary, then one Zstandard frame a record, each
compressed on its own with that dictionary, so that any record can be read by its offset. Every shard trains its own
dictionary on chunks evenly spaced over all bytes of its records; tasks need nothing from one another, and nothing is shuffled.
A task buffers at most ``shard_bytes`` of records (and one record more) before it closes a shard.

Record ids are derived from the record, dates are a parameter: a task that runs again writes the same bytes.

Defined results: a null html is an empty payload, a null url an empty target, both flagged by a missing WARC-Target-URI or
a Content-Length of 0; line ends within a url are escaped; a null page_id has no X-Page-Id; repeated rows are repeated
records; a record of any length is one frame; an empty table has no shards; shards of too little or too uniform text to
train on take their records' own bytes as a raw dictionary; a page_id that doesn't cast to bigint is an error; other columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches

MAGIC = 0x184D2A5D  # the skippable frame that marks a dictionary at the head of a .warc.zst


@dataclass(frozen=True)
class Params:
    shard_bytes: int = 64 << 20
    dictionary_bytes: int = 64 << 10
    sample_factor: int = 40  # bytes to train on, at most, as a multiple of the dictionary
    chunk_bytes: int = 4 << 10  # of the chunks to train on
    level: int = 3
    date: str = "2024-01-01T00:00:00Z"


def record(page_id: int | None, url: str | None, html: str | None, date: str) -> bytes:
    """A WARC/1.1 resource record."""
    payload = b"" if html is None else html.encode("utf-8", "surrogatepass")
    target = "" if url is None else "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in url)
    digest = hashlib.sha1(payload).hexdigest()
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}\n{target}\n{digest}")
    head = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}"]
    if target:
        head.append(f"WARC-Target-URI: {target}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def dictionary(records: list[bytes], p: Params) -> bytes:
    """A dictionary trained on chunks of whole records: all, or every n-th where they are over ``sample_factor`` dictionaries;
    of raw bytes where training can't be done."""
    import zstandard

    wanted, total = p.dictionary_bytes * p.sample_factor, sum(map(len, records))
    step, number, sample = -(-total // wanted), 0, []
    for r in records:
        for at in range(0, len(r), p.chunk_bytes):
            if number % step == 0:
                sample.append(r[at : at + p.chunk_bytes])
            number += 1
    size = min(p.dictionary_bytes, max(256, total // 8))
    try:
        return zstandard.train_dictionary(size, sample, level=p.level).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[: p.dictionary_bytes] or b"WARC/1.1\r\n"


def header(data: bytes) -> bytes:
    """The skippable frame: magic, length, and the dictionary, itself a Zstandard frame."""
    import zstandard

    packed = zstandard.ZstdCompressor(level=19).compress(data)
    return struct.pack("<II", MAGIC, len(packed)) + packed


def read_dictionary(head: bytes) -> tuple[bytes, int]:
    """(dictionary, length of the leading frame) of a file's first bytes."""
    import zstandard

    magic, length = struct.unpack_from("<II", head)
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    packed = head[8 : 8 + length]
    return (zstandard.ZstdDecompressor().decompress(packed) if packed[:4] == b"\x28\xb5\x2f\xfd" else packed), 8 + length


def read(data: bytes) -> list[bytes]:
    """The records of a file."""
    import zstandard

    raw, at = read_dictionary(data)
    engine = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    out = []
    while at < len(data):
        one = engine.decompressobj()
        out.append(one.decompress(data[at:]))
        at = len(data) - len(one.unused_data)
    return out


def _shards(batches: Iterator[pa.RecordBatch], p: Params) -> Iterator[tuple[list[int | None], list[bytes]]]:
    ids: list[int | None] = []
    records: list[bytes] = []
    size = 0
    for batch in batches:
        for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
            ids.append(page)
            records.append(record(page, url, html, p.date))
            size += len(records[-1])
            if size >= p.shard_bytes:
                yield ids, records
                ids, records, size = [], [], 0
    if records:
        yield ids, records


FRAMES = "shard string, position int, page_id bigint, offset bigint, length int, record_bytes bigint, frame binary"


def frames(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """The frames of all shards. Position 0 is the dictionary's; a shard's frames in order of position are its file."""
    bound_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        task = TaskContext.get()
        number = task.partitionId() if task else 0
        for n, (ids, records) in enumerate(_shards(batches, p)):
            data = dictionary(records, p)
            shared = zstandard.ZstdCompressionDict(data)
            shared.precompute_compress(level=p.level)
            compress = zstandard.ZstdCompressor(level=p.level, dict_data=shared, write_checksum=True, write_content_size=True).compress
            name, offset, start = f"part-{number:05d}-{n:04d}", 0, 0
            made = [(None, len(data), header(data))]
            while made or start < len(records):
                size = sum(len(f) for *_, f in made)
                while start < len(records) and size < 4 << 20:
                    made.append((ids[start], len(records[start]), compress(records[start])))
                    size += len(made[-1][2])
                    start += 1
                lengths = [len(f) for *_, f in made]
                offsets = []
                for length in lengths:
                    offsets.append(offset)
                    offset += length
                first = start - sum(1 for _ in made) + 1  # position 0 is the dictionary
                yield pa.record_batch(
                    [pa.array([name] * len(made)), pa.array(range(first, first + len(made)), pa.int32()), pa.array([m[0] for m in made], pa.int64()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int32()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.binary())],
                    ["shard", "position", "page_id", "offset", "length", "record_bytes", "frame"],
                )
                made = []

    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, FRAMES)


def write(pages: DataFrame, folder: str, p: Params = Params()) -> DataFrame:
    """Write <folder>/<shard>.warc.zst from the executors; (shard, records, bytes) of the files.

    ``folder`` is one that all executors share: a path, or a URI of any file system that pyarrow knows. A file appears under its name only once it is complete, so a task that is
    repeated replaces it by the same bytes.
    """
    made = frames(pages, p)
    place = folder if "://" in folder else f"file://{os.path.abspath(folder)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(place)
        files.create_dir(root, recursive=True)
        current, out, temporary, rows, size, done = None, None, "", 0, 0, []

        def close():
            out.close()
            files.move(temporary, f"{root}/{current}.warc.zst")
            done.append((current, rows, size))

        for batch in batches:
            for name, position, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(6)):
                if name != current:
                    if out is not None:
                        close()
                    current, rows, size = name, 0, 0
                    temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
                    out = files.open_output_stream(temporary)
                data = frame.as_buffer()
                out.write(data)
                size += len(data)
                rows += position > 0
        if out is not None:
            close()
        if done:
            yield pa.record_batch([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], ["shard", "records", "bytes"])

    return made.mapInArrow(run, "shard string, records bigint, bytes bigint")
