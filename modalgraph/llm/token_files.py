"""Token-id files: Arrow IPC files whose batches hold fixed-size lists of ids and masks.

Each part of the id order is one file.  Its columns are ``ids: fixed_size_list<uint16|uint32>[width]`` and
``mask: fixed_size_list<bool>[width]``; all batches but the last have ``BATCH`` sequences, so token ``t`` of a file lies in
batch ``t // (width * BATCH)`` at a computed place and is read from the memory map without copying.  Only the last
sequence of a file is padded (id 0, mask false).  An index table (part, doc_id, first, n_tokens) names each document's place.

Defined results: a null or empty text is the end id alone; null doc_ids come first; equal doc_ids and repeated rows are
each written, ordered by a hash of their text; an empty table gives an empty index; other columns are ignored.
A task that runs again writes the same file under a name of its own and renames it, so a lost executor leaves no half file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, saved, source_table, work_path
from .tokens import encoded

WIDTH, BATCH = 2048, 64
INDEX = "part int, doc_id long, first long, n_tokens long"


class Writer:
    """Appends ids to a file in whole batches of sequences; memory holds one batch."""

    def __init__(self, sink, width: int = WIDTH, wide: bool = False):
        self.kind, self.width, self.rest = (np.uint32 if wide else np.uint16), width, []
        self.held = self.written = 0
        item = pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema([("ids", pa.list_(item, width)), ("mask", pa.list_(pa.bool_(), width))])
        self.out = pa.ipc.new_file(sink, self.schema)

    def append(self, ids: np.ndarray) -> int:
        """Adds ids; returns the place of the first.  Ids that do not fit are an error."""
        if self.kind is np.uint16 and len(ids) and int(ids.max()) > 0xFFFF:
            raise ValueError(f"id {int(ids.max())} needs a file of wide ids")
        place = self.written + self.held
        self.rest.append(ids.astype(self.kind))
        self.held += len(ids)
        if self.held >= (full := self.width * BATCH):
            data = np.concatenate(self.rest)
            cut = len(data) // full * full
            for i in range(0, cut, full):
                self._batch(data[i : i + full], full)
            self.rest, self.held, self.written = [data[cut:]], len(data) - cut, self.written + cut
        return place

    def _batch(self, data: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(data)) < real)
        lists = [pa.FixedSizeListArray.from_arrays(x, self.width) for x in (pa.array(data), mask)]
        self.out.write_batch(pa.record_batch([a.cast(f.type) for a, f in zip(lists, self.schema, strict=True)], schema=self.schema))

    def close(self) -> None:
        data = np.concatenate([*self.rest, np.zeros(0, self.kind)])
        if len(data):
            self._batch(np.concatenate([data, np.zeros(-len(data) % self.width, self.kind)]), len(data))
        self.out.close()


class Reader:
    """Random access to a token file: slices of the mapped batches, copied only where a slice spans two."""

    def __init__(self, files: fs.FileSystem, path: str):
        local = isinstance(files, fs.LocalFileSystem)
        self.file = pa.ipc.open_file(pa.memory_map(path) if local else files.open_input_file(path))
        self.width = self.file.schema.field("ids").type.list_size
        self.at, self.batch = -1, None

    def _flat(self, k: int) -> np.ndarray:
        if self.at != k:
            self.at, self.batch = k, self.file.get_batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
        return self.batch

    def slices(self, first: int, count: int) -> Iterator[np.ndarray]:
        full = self.width * BATCH
        while count > 0:
            k, at = divmod(first, full)
            got = self._flat(k)[at : at + count]
            yield got
            first, count = first + len(got), count - len(got)

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of one fixed-length sequence."""
        batch = self.file.get_batch(i // BATCH)
        ids, mask = (batch.column(c)[i % BATCH].values for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)


def _name(part: int) -> str:
    return f"part-{part:07d}.arrow"


def _write(batches: Iterator[pa.RecordBatch], folder: str, tokenizer: str, end_id: int, wide: bool) -> Iterator[pa.RecordBatch]:
    files, root = fs.FileSystem.from_uri(folder)
    part, own = TaskContext.get().partitionId(), f"{root}/.{uuid.uuid4().hex}"
    writer = sink = None
    for rows, ids in encoded(batches, tokenizer, end_id, "text"):
        if writer is None:
            files.create_dir(root, recursive=True)
            sink = files.open_output_stream(own)
            writer = Writer(sink, wide=wide)
        places = [writer.append(x) for x in ids]
        yield pa.record_batch([pa.array([part] * len(ids), pa.int32()), rows.column(0), pa.array(places, pa.int64()), pa.array([len(x) for x in ids], pa.int64())], names=["part", "doc_id", "first", "n_tokens"])
    if writer:
        writer.close()
        sink.close()
        files.move(own, f"{root}/{_name(part)}")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", wide: bool = False) -> DataFrame:
    """Writes the ids of all texts in ascending id order to ``folder`` (a URI all executors reach); returns the index.

    The order is dealt by range, so each task writes one file of neighbouring documents; ``wide`` stores ids over 65,535.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order)
    return saved(dealt.mapInArrow(partial(_write, folder=folder, tokenizer=tokenizer, end_id=end_id, wide=wide), INDEX), "token-index")


def _read(batches: Iterator[pa.RecordBatch], folder: str, before: dict[int, int]) -> Iterator[pa.RecordBatch]:
    files, root = fs.FileSystem.from_uri(folder)
    at, reader = None, None
    for rows in batches:
        parts, firsts, counts = (rows.column(c).to_numpy() for c in ("part", "first", "n_tokens"))
        sums = []
        for part, first, count in zip(parts.tolist(), firsts.tolist(), counts.tolist(), strict=True):
            if part != at:
                at, reader = part, Reader(files, f"{root}/{_name(part)}")
            crc = 0
            for ids in reader.slices(first, count):
                crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
            sums.append(crc)
        start = firsts + np.array([before[p] for p in parts.tolist()], np.int64)
        yield pa.record_batch([rows.column("doc_id"), pa.array(start, pa.int64()), rows.column("n_tokens"), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(index: DataFrame, folder: str) -> DataFrame:
    """Each document's place, size and checksum from the files: doc_id, start, n_tokens, ids_crc32.

    Only the totals of the parts, one number for each file, pass the driver.
    """
    totals = sorted((r["part"], r["n"]) for r in index.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, total = {}, 0
    for part, n in totals:
        before[part], total = total, total + n
    return index.mapInArrow(partial(_read, folder=folder, before=before), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = work_path(spark, "token-files")
    index = write(source_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read(index, folder)
