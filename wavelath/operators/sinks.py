"""Sinks that end after a number of bytes, to the byte."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery

from ..functions import packets as P
from ..shared import fresh_path
from .framing import before

MANIFEST = "manifest.json"


def limited(rows: DataFrame, num_bytes: int, data: str = "data", seq: str = "seq") -> DataFrame:
    """Rows in seq order until num_bytes bytes of data, the last one cut; 0 keeps none. Adds at, the bytes before."""
    size = F.coalesce(F.length(data), F.lit(0))
    sized = before(rows, size, "at", seq, (data,), num_bytes).where((F.col("at") < num_bytes) & (size > 0))
    return sized.withColumn(data, F.substring(F.col(data), F.lit(1), F.least(F.length(data).cast("long"), num_bytes - F.col("at")).cast("int")))


def payloads(packets: DataFrame) -> DataFrame:
    """channel, seq, data of VITA-49 data packets."""
    return P.parse(packets, "vita49").select("channel", "seq", F.col("payload").alias("data"))


def memory(frames: DataFrame) -> DataFrame:
    """channel, frame, data: memory of frames, little-endian, complex numbers interleaved."""
    cols = [c for c in ("re", "im", "x", "psd") if c in frames.columns]

    def run(batches):
        for b in batches:
            out = []
            for row in zip(*(b.column(c) for c in cols), strict=True):
                parts = [v.values.to_numpy(zero_copy_only=False) for v in row]
                out.append(np.stack(parts, 1).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("channel"), b.column("frame"), pa.array(out, pa.binary())], ["channel", "frame", "data"])

    return frames.select("channel", "frame", *cols).mapInArrow(run, "channel string, frame long, data binary")


def file_bytes(packets: DataFrame, num_bytes: int) -> DataFrame:
    """channel, seq, at, data: payloads of VITA-49 data packets up to num_bytes."""
    return limited(payloads(packets), num_bytes)


def frame_bytes(frames: DataFrame, num_bytes: int) -> DataFrame:
    """channel, frame, at, data: memory of frames up to num_bytes."""
    return limited(memory(frames), num_bytes, seq="frame")


def storage(path: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a folder named by a URI or a local path."""
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)


def manifest(path: str) -> dict:
    """What a folder's writes have committed: parts (name, first byte, bytes, batch) in order."""
    fs, root = storage(path)
    if fs.get_file_info(f"{root}/{MANIFEST}").type == pa.fs.FileType.NotFound:
        return {"parts": []}
    with fs.open_input_file(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class Parts(WriterCommitMessage):
    parts: list


class RawWriter(DataSourceArrowWriter):
    """Each task writes its rows' bytes as a part; a write counts once the manifest names its parts.

    Overwriting truncates: parts of earlier writes go. Appending keeps them, but for those of the same batch, which is then written again.
    """

    def __init__(self, path: str, overwrite: bool, batch: int):
        self.path, self.overwrite, self.batch, self.write_id = path, overwrite, batch, uuid.uuid4().hex

    def write(self, batches) -> WriterCommitMessage:
        rows = sorted((at, data) for b in batches for at, data in zip(b.column("at").to_pylist(), b.column("data").to_pylist(), strict=True))
        if not rows:
            return Parts([])
        fs, root = storage(self.path)
        fs.create_dir(root, recursive=True)
        name = f"part-{rows[0][0]:020d}-{self.write_id}-{uuid.uuid4().hex[:8]}.dat"
        with fs.open_output_stream(f"{root}/{name}") as f:
            for _, data in rows:
                f.write(data)
        return Parts([[name, rows[0][0], sum(len(d) for _, d in rows), self.batch]])

    def commit(self, messages) -> None:
        fs, root = storage(self.path)
        fs.create_dir(root, recursive=True)
        old = [] if self.overwrite else [p for p in manifest(self.path)["parts"] if self.batch < 0 or p[3] != self.batch]
        parts = sorted(old + [p for m in messages if m for p in m.parts], key=lambda p: p[1])
        with fs.open_output_stream(f"{root}/{MANIFEST}.{self.write_id}") as f:
            f.write(json.dumps({"parts": parts}).encode())
        fs.move(f"{root}/{MANIFEST}.{self.write_id}", f"{root}/{MANIFEST}")
        named = {p[0] for p in parts}
        for info in fs.get_file_info(pa.fs.FileSelector(root)):
            if info.base_name.endswith(".dat") and info.base_name not in named:
                fs.delete_file(info.path)

    def abort(self, messages) -> None:
        fs, root = storage(self.path)
        for p in (p for m in messages if m for p in m.parts):
            fs.delete_file(f"{root}/{p[0]}")


class RawSink(DataSource):
    """Format "wavelath_raw": rows (at, data) as ordered parts of raw bytes in a folder that all tasks reach (path or URI)."""

    @classmethod
    def name(cls) -> str:
        return "wavelath_raw"

    def schema(self) -> str:
        return "at long, data binary"

    def writer(self, schema, overwrite: bool) -> RawWriter:
        return RawWriter(self.options["path"], overwrite, int(self.options.get("batch", "-1")))


def write_raw(rows: DataFrame, path: str, mode: str = "overwrite", batch: int = -1) -> None:
    """Writes limited rows (at, data) of one channel as ordered parts; what the folder held before goes, as a file opened for writing is cut."""
    rows.sparkSession.dataSource.register(RawSink)
    rows.select("at", "data").repartitionByRange("at").sortWithinPartitions("at").write.format("wavelath_raw").option("batch", str(batch)).mode(mode).save(path)


def read_raw(path: str) -> bytes:
    """All parts of a small capture."""
    fs, root = storage(path)
    return b"".join(fs.open_input_file(f"{root}/{p[0]}").read() for p in manifest(path)["parts"])


class Capture:
    """A stream's bytes, up to num_bytes, written micro-batch by micro-batch; the query ends once they are all there.

    A batch that is run again replaces its parts, and the total stands in the manifest, so a restart goes on where it was.
    """

    def __init__(self, rows: Callable[[DataFrame], DataFrame], path: str, num_bytes: int, seq: str = "seq"):
        self.rows, self.path, self.num_bytes, self.seq = rows, path, num_bytes, seq
        self.full = threading.Event()

    def total(self, other_than: int = -1) -> int:
        return sum(p[2] for p in manifest(self.path)["parts"] if p[3] != other_than)

    def add(self, df: DataFrame, batch: int) -> None:
        done = self.total(batch)
        if done < self.num_bytes:
            rows = limited(self.rows(df), self.num_bytes - done, seq=self.seq).withColumn("at", F.col("at") + done)
            write_raw(rows, self.path, "append", batch)
        if self.total() >= self.num_bytes:
            self.full.set()

    def start(self, stream: DataFrame, checkpoint: str | None = None) -> StreamingQuery:
        """Starts the query, and a watcher that stops it at the limit. Without a checkpoint folder the capture begins anew."""
        if checkpoint is None:
            checkpoint = fresh_path(stream.sparkSession, "capture")
            fs, root = storage(self.path)
            fs.create_dir(root, recursive=True)
            fs.delete_dir_contents(root)
        query = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).start()

        def watch() -> None:
            while query.isActive:
                if self.full.wait(0.2):
                    query.stop()

        threading.Thread(target=watch, daemon=True).start()
        return query
