"""Token ids in files of independent zstandard frames with a trailing seek table and a checksum a frame.

A file: frames of whole documents' ids (unsigned 32-bit, little endian), a skippable frame with the documents' index,
a skippable frame with the seek table in the public seekable layout: of each frame the compressed size, the size and
the low half of XXH64 of its content; then the number of frames, a descriptor byte, the magic number.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FILE, ROW, new_path, text_groups, with_row_key
from .tokens import END, GROUP_CHARS, encoder

#: Pieces that a writing worker keeps before the oldest go; a writer holds little else.
WRITER_PIECES = 700_000

# Fixed values of the public seekable format.
SKIPPABLE_INDEX, SKIPPABLE_TABLE, SEEKABLE, CHECKSUMS = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1, 0x80
#: A frame is closed at this many bytes of ids; one longer document is a frame by itself.
FRAME_BYTES = 1 << 17


class Writer:
    """Writes documents to one binary stream, one after the other."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 1):
        self.out, self.frame_bytes = out, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.held, self.size = [], 0
        self.table, self.index = [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.frame_bytes:
            self._close_frame()
        self.index.append((doc_id, len(self.table), self.size // 4, len(ids) // 4))
        self.held.append(ids)
        self.size += len(ids)

    def _close_frame(self) -> None:
        raw = b"".join(self.held)
        frame = self.packer.compress(raw)
        self.out.write(frame)
        self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.size = [], 0

    def close(self) -> None:
        if self.held:
            self._close_frame()
        n = len(self.index)
        body = struct.pack("<I", n)
        body += np.array([x[0] is None for x in self.index], np.uint8).tobytes() + np.array([x[0] or 0 for x in self.index], "<i8").tobytes()
        body += b"".join(np.array([x[k] for x in self.index], "<u4").tobytes() for k in (1, 2, 3))
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        self.table.append((len(body) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE_TABLE, len(body)) + body)


class Reader:
    """Reads documents from a seekable stream of known size; decompresses only the frames that are asked for."""

    def __init__(self, source, size: int):
        self.source = source
        frames, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("not a file of token ids")
        self.table = np.frombuffer(self._at(size - 9 - 12 * frames, 12 * frames), "<u4").reshape(frames, 3)
        self.begin = np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])
        body = self._at(int(self.begin[-2]) + 8, int(self.table[-1, 0]) - 8)
        (n,) = struct.unpack_from("<I", body)
        null = np.frombuffer(body, np.uint8, n, 4)
        ids = np.frombuffer(body, "<i8", n, 4 + n)
        self.doc_ids = [None if x else int(i) for x, i in zip(null, ids)]
        self.frame, self.first, self.length = (np.frombuffer(body, "<u4", n, 4 + 9 * n + 4 * n * k) for k in range(3))
        self.last: tuple[int, bytes] | None = None

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def read_frame(self, k: int) -> bytes:
        if self.last is None or self.last[0] != k:
            size, raw_size, check = map(int, self.table[k])
            raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.begin[k]), size), max_output_size=raw_size)
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            self.last = k, raw
        return self.last[1]

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, i: int) -> memoryview:
        """The bytes of the ids of the file's document i."""
        a = 4 * int(self.first[i])
        return memoryview(self.read_frame(int(self.frame[i])))[a: a + 4 * int(self.length[i])]


def write_token_files(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Encodes docs in ascending doc_id order (null first, then repeated rows by row key) into files of folder.

    Returns the manifest, a row a file in order: part, file, docs, ids, start (ids in the files before). A task that
    runs again writes a new file; only files of the manifest count.
    """
    def write(batches):
        from pyspark import TaskContext

        enc, part, file, n, total, writer = encoder(tokenizer, WRITER_PIECES), TaskContext.get().partitionId(), "", 0, 0, None
        store, at = pafs.FileSystem.from_uri(folder)
        for b in batches:
            texts, ids = [t or "" for t in b.column(1).to_pylist()], b.column(0).to_pylist()
            if writer is None and texts:
                store.create_dir(at, recursive=True)
                file = f"part-{part:06d}-{uuid.uuid4().hex}.ids.zst"
                out = store.open_output_stream(f"{at}/{file}", compression=None)
                writer = Writer(out)
            for lo, hi in text_groups(texts, GROUP_CHARS):
                for i, raw in zip(range(lo, hi), enc.encode(texts[lo:hi])):
                    writer.add(ids[i], raw + END)
                    n += 1
                    total += len(raw) // 4 + 1
        if writer:
            writer.close()
            out.close()
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "file": [file], "docs": pa.array([n], pa.int64()), "ids": pa.array([total], pa.int64())})

    spark = docs.sparkSession
    rows = with_row_key(docs, F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.asc_nulls_first("doc_id"), F.asc(FILE), F.asc(ROW)]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    files, start = [], 0
    for r in sorted(rows.mapInArrow(write, "part int, file string, docs long, ids long").collect()):  # a row a file
        files.append((*r, start))
        start += r["ids"]
    return spark.createDataFrame(files, "part int, file string, docs long, ids long, start long")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files, read back frame by frame."""

    def read(batches):
        store, at = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with store.open_input_file(f"{at}/{file}") as source:
                    r = Reader(source, source.size())
                    crc = [zlib.crc32(r.ids(i)) for i in range(len(r))]
                    n = r.length.astype(np.int64)
                    yield pa.record_batch({"doc_id": pa.array(r.doc_ids, pa.int64()), "start": start + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": pa.array(crc, pa.int64())})

    n = max(1, manifest.count())
    return manifest.select("file", "start").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes all documents to token files in the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are the end id alone; null ids come first; repeated rows are documents of their own. An empty
    table writes no file and gives no rows. A very long text is one frame by itself. doc_id is a whole number, or text of one. Other columns are ignored.
    """
    folder = new_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer, folder), folder)
