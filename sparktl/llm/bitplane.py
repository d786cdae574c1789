"""Token files: fixed-size id blocks shuffled into bit planes, each plane compressed by itself.

``BitPlaneSource`` is a Spark data source ("bitplane"). Each writing task makes one file; a manifest,
written when the job commits, names the files of the tasks that counted, ordered by their first id.
A file holds

    b"TBP1"
    blocks   BLOCK ids each (the last may be shorter): byte planes of the 32-bit ids, split into
             bit planes; every plane is one zstandard frame; planes of zeros are left out
    index    one zstandard frame of int64: blocks (offset, ids, length of each of 32 planes),
             then documents (doc_id, ids)
    trailer  int64 offset of the index, blocks, documents, and b"TBP1"

Documents run on from block to block; the index gives where each block is and which ids each
document has, so one document can be read from its blocks alone.

Defined results: no rows make a table of no files, which reads back empty; a null doc_id is stored as
the smallest long and read as null; rows that share an id stay apart, in the order of a hash of their
texts; other columns of the input are not read.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from sparktl.llm.common import new_path, table
from sparktl.llm.tokens import encoded

MAGIC = b"TBP1"
BLOCK = 1 << 16
MANIFEST = "_manifest.json"
NO_ID = -(1 << 63)
SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def transposed(x: np.ndarray) -> np.ndarray:
    """Transpose the 8 by 8 bits in each 64-bit integer; doing it twice gives x."""
    for shift, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        s, m = np.uint64(shift), np.uint64(mask)
        t = (x ^ (x >> s)) & m
        x = x ^ t ^ (t << s)
    return x


def shuffled(ids: np.ndarray, level: int = 3) -> list[bytes]:
    """The 32 compressed bit planes of the ids; b"" for a plane of zeros."""
    pack, out = zstandard.ZstdCompressor(level=level), []
    padded = np.zeros(-(-len(ids) // 8) * 8, "<u4")
    padded[: len(ids)] = ids
    octets = padded.view(np.uint8).reshape(-1, 4)
    for k in range(4):
        lane = np.ascontiguousarray(octets[:, k])
        if not lane.any():
            out += [b""] * 8
            continue
        planes = transposed(lane.view("<u8")).view(np.uint8).reshape(-1, 8).T
        out += [pack.compress(np.ascontiguousarray(p)) if p.any() else b"" for p in planes]
    return out


def unshuffled(planes: list[bytes], n: int) -> np.ndarray:
    unpack, rows = zstandard.ZstdDecompressor(), -(-n // 8)
    octets = np.zeros((rows * 8, 4), np.uint8)
    for k in range(4):
        mine = planes[8 * k : 8 * k + 8]
        if any(mine):
            bits = np.zeros((rows, 8), np.uint8)
            for b, p in enumerate(mine):
                if p:
                    bits[:, b] = np.frombuffer(unpack.decompress(p), np.uint8)
            octets[:, k] = transposed(bits.reshape(-1).view("<u8")).view(np.uint8)
    return octets.reshape(-1).view("<u4")[:n]


@dataclass
class Written(WriterCommitMessage):
    file: str
    first: int
    documents: int
    tokens: int


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        place, folder = fs.FileSystem.from_uri(self.path)
        name, first, docs, counts, blocks = f"part-{uuid.uuid4().hex}.tbp", None, [], [], []
        out, at, left = None, len(MAGIC), []
        held = 0

        def put(ids: np.ndarray) -> None:
            nonlocal at
            planes = shuffled(ids)
            blocks.append([at, len(ids), *map(len, planes)])
            for p in planes:
                out.write(p)
                at += len(p)

        for batch in iterator:
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if out is None:
                    place.create_dir(folder, recursive=True)
                    out, first = place.open_output_stream(posixpath.join(folder, name)), NO_ID if doc is None else doc
                    out.write(MAGIC)
                ids = np.frombuffer(ids.as_buffer(), "<u4")
                docs.append(NO_ID if doc is None else doc)
                counts.append(len(ids))
                left.append(ids)
                held += len(ids)
                while held >= BLOCK:
                    every = np.concatenate(left)
                    put(every[:BLOCK])
                    left, held = [every[BLOCK:]], held - BLOCK
        if out is None:
            return Written("", 0, 0, 0)
        if held:
            put(np.concatenate(left))
        index = np.concatenate([np.array(blocks, "<i8").reshape(-1), np.array([docs, counts], "<i8").T.reshape(-1)])
        out.write(zstandard.ZstdCompressor().compress(index.tobytes()))
        out.write(np.array([at, len(blocks), len(docs)], "<i8").tobytes() + MAGIC)
        out.close()
        return Written(name, first, len(docs), sum(counts))

    def commit(self, messages: list[Written | None]) -> None:
        place, folder = fs.FileSystem.from_uri(self.path)
        place.create_dir(folder, recursive=True)
        rows = sorted((m.first, m.file, m.documents, m.tokens) for m in messages if m and m.file)
        with place.open_output_stream(posixpath.join(folder, MANIFEST)) as out:
            out.write(json.dumps(rows).encode())

    def abort(self, messages: list[Written | None]) -> None:
        place, folder = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m and m.file:
                place.delete_file(posixpath.join(folder, m.file))


@dataclass
class Part(InputPartition):
    file: str
    start: int


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Part]:
        place, folder = fs.FileSystem.from_uri(self.path)
        with place.open_input_stream(posixpath.join(folder, MANIFEST)) as f:
            rows, parts, start = json.loads(f.read()), [], 0
        for _, file, _, tokens in rows:
            parts.append(Part(file, start))
            start += tokens
        return parts or [Part("", 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        place, folder = fs.FileSystem.from_uri(self.path)
        with place.open_input_file(posixpath.join(folder, partition.file)) as f:
            f.seek(f.size() - 28)
            tail = f.read(28)
            at, n_blocks, n_docs = np.frombuffer(tail[:24], "<i8")
            if tail[24:] != MAGIC:
                raise ValueError(f"{partition.file} is not a token file")
            f.seek(int(at))
            index = np.frombuffer(zstandard.ZstdDecompressor().decompress(f.read(f.size() - 28 - int(at))), "<i8")
            blocks = index[: 34 * n_blocks].reshape(-1, 34)
            docs = index[34 * n_blocks :].reshape(-1, 2)
            start, left, done, rows = partition.start, np.zeros(0, "<u4"), 0, []
            for doc, n in docs:
                parts, held = [left], len(left)
                while held < n:
                    f.seek(int(blocks[done, 0]))
                    lengths = blocks[done, 2:]
                    raw, ends = f.read(int(lengths.sum())), np.cumsum(lengths)
                    parts.append(unshuffled([raw[e - k : e] for e, k in zip(ends, lengths)], int(blocks[done, 1])))
                    held, done = held + len(parts[-1]), done + 1
                every = np.concatenate(parts) if len(parts) > 1 else left
                rows.append((None if doc == NO_ID else int(doc), start, int(n), every[:n].tobytes()))
                left, start = every[n:], start + int(n)
                if len(rows) == 500:
                    yield self.batch(rows)
                    rows = []
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["doc_id", "start", "n_tokens", "ids"])


class BitPlaneSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bitplane"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])


def write_tokens(spark: SparkSession, docs: DataFrame, path: str, file: str, end_id: int, blanks: bool) -> None:
    """Encode docs (doc_id, text) in ascending doc_id order and write the token files.

    One range shuffle of the texts by doc_id, and by a hash of the text where many rows share an id (or
    have none), gives the order; encoding and writing follow in the same tasks, so ids are never shuffled.
    """
    spark.dataSource.register(BitPlaneSource)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    ordered = keyed.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text")
    encoded(ordered, file, end_id, blanks).write.format("bitplane").mode("append").save(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the token files; start counts the ids of all documents before."""
    spark.dataSource.register(BitPlaneSource)
    return spark.read.format("bitplane").load(path)


def op4_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(spark, table(spark, sf_dir, "documents"), path, "byte_bpe_50k.json", 0, True)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
