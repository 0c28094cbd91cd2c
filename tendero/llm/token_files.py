"""Token ids in seekable files: independent Zstandard frames and a seek table at the end.

A file is a row of frames of ``FRAME_IDS`` little-endian unsigned 32-bit ids each, every
frame with a content checksum, followed by one skippable frame with the seek table of the
public "seekable format" (sizes and a checksum of every frame, frame count, magic
number); ordinary Zstandard tools read it too. A table beside the files says for
every document where its ids start in which file, so a reader opens a file, reads its last
bytes, and decompresses only the frames that hold wanted documents.

Writing sorts documents by id over ranges of ids: one file per range, so the files in
order hold the documents in order. A lost task writes its file again under a new name;
the table of documents, committed by Spark, names only finished files.

Rows: null counts as empty (the end id alone); null ids come first; rows of one id are
ordered by a hash of the text; long texts are taken whole and may span frames.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as Wd
from pyspark.sql import functions as F

from tendero.llm import words as W

FRAME_IDS = 1 << 17
# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80


class FileWriter:
    """Frames one after the other, then the seek table."""

    def __init__(self, out, level: int = 1):
        self.out, self.table, self.waiting, self.held = out, [], [], 0
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= FRAME_IDS:
            every = np.concatenate(self.waiting)
            for at in range(0, self.held - FRAME_IDS + 1, FRAME_IDS):
                self._frame(every[at:at + FRAME_IDS])
            rest = every[self.held // FRAME_IDS * FRAME_IDS:]
            self.waiting, self.held = [rest], len(rest)

    def _frame(self, ids: np.ndarray) -> None:
        raw = ids.astype("<u4").tobytes()
        packed = self.packer.compress(raw)
        self.out.write(packed)
        self.table.append(struct.pack("<III", len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.held:
            self._frame(np.concatenate(self.waiting))
        rows = b"".join(self.table)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(rows) + 9) + rows
                       + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC))


class FileReader:
    """Ids of any stretch of a file; ``frames_read`` counts decompressed frames."""

    def __init__(self, source, size: int):
        self.source, self.frames_read, self.held = source, 0, (-1, None)
        source.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("not a seekable file with checksums")
        source.seek(size - 9 - 12 * count)
        self.table = np.frombuffer(source.read(12 * count), "<u4").reshape(count, 3)
        self.packed = np.concatenate(([0], np.cumsum(self.table[:, 0], dtype=np.int64)))
        self.upto = np.concatenate(([0], np.cumsum(self.table[:, 1], dtype=np.int64))) // 4
        self.unpacker = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            self.source.seek(int(self.packed[k]))
            raw = self.unpacker.decompress(self.source.read(int(self.table[k, 0])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
                raise ValueError(f"frame {k} doesn't have its checksum")
            self.held, self.frames_read = (k, np.frombuffer(raw, "<u4")), self.frames_read + 1
        return self.held[1]

    def ids(self, at: int, n: int) -> np.ndarray:
        parts, k = [], int(np.searchsorted(self.upto, at, "right")) - 1
        while n > 0:
            part = self.frame(k)[at - self.upto[k]:][:n]
            parts.append(part)
            at, n, k = at + len(part), n - len(part), k + 1
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> W.WordMemo:
    import os

    from tokenizers import Tokenizer
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)

    def encode(spans: list[bytes]) -> list[list[int]]:
        texts = [s.decode("utf-8", "replace") for s in spans]
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return W.WordMemo(encode)


def encoded(column: pa.Array, path: str, end_id: int):
    """(first row, ids, edges) of slices of a text column, each text with the end id.

    The tokenizer drops white space and never joins over it, so it is asked for each
    different stretch between white space once a process.
    """
    memo = _tokenizer(path)
    for first, end, data, offsets in W.slices(column):
        starts, ends, bounds = W.word_spans(data, offsets)
        flat, counts = memo.ids(data, starts, ends) if len(starts) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        edges = np.concatenate(([0], np.cumsum(counts)))[bounds] + np.arange(end - first + 1)
        ids = np.empty(edges[-1], np.uint32)
        last = np.zeros(len(ids), bool)
        last[edges[1:] - 1] = True
        ids[last], ids[~last] = end_id, flat
        yield first, ids, edges


def write(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Files of all documents' ids in ascending id order under ``folder``/data, and ``folder``/documents."""
    def run(batches):
        part = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        name, out, writer, at = f"data/part-{part:05d}-{uuid.uuid4().hex}.ids.zst", None, None, 0
        for batch in batches:
            for first, ids, edges in encoded(batch.column(1), tokenizer, end_id):
                if out is None:
                    store.create_dir(f"{base}/data", recursive=True)
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                    writer = FileWriter(out)
                writer.add(ids)
                n = len(edges) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array([part] * n, pa.int32()), pa.array([name] * n),
                     pa.array(edges[:-1] + at), pa.array(np.diff(edges))], ["doc_id", "part", "file", "at", "n_tokens"])
                at += len(ids)
        if out is not None:
            writer.close()
            out.close()

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, "doc_id long, part int, file string, at long, n_tokens long").write.parquet(f"{folder}/documents")


def read(spark: SparkSession, folder: str, wanted: DataFrame | None = None, *, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, or of those in ``wanted`` (doc_id).

    ``start`` counts the ids of all documents before. ``digest``: the unsigned crc32 of
    the ids' bytes, ``ids_crc32``, in place of the ids.
    """
    table = spark.read.parquet(f"{folder}/documents")
    # one row per file: their number is that of the ranges, not of the documents
    files = table.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = files.select("part", (F.sum("held").over(Wd.orderBy("part")) - F.col("held")).alias("before"))
    rows = table if wanted is None else table.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    rows = (rows.join(before, "part").select("doc_id", "file", "at", "n_tokens", (F.col("before") + F.col("at")).alias("start"))
            .repartitionByRange("file", "at").sortWithinPartitions("file", "at"))

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        name, reader = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, out = batch.slice(lo, 256), []
                for file, at, n in zip(*(part.column(k).to_pylist() for k in (1, 2, 3))):
                    if file != name:
                        source = store.open_input_file(f"{base}/{file}")
                        name, reader = file, FileReader(source, source.size())
                    ids = reader.ids(at, n)
                    out.append(zlib.crc32(ids.tobytes()) if digest else ids)
                last = pa.array(out, pa.int64()) if digest else pa.array([x.astype(np.int64) for x in out], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(4), part.column(3), last],
                                                 ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>"))
