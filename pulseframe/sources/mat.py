"""Recordings in binary matrix files (level 5): an index by name, and samples of the files that are wanted.

Files come through Spark's binary source, so they may lie wherever Spark reads. Names are
chosen before any file is opened; a file is then parsed in the task that reads it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.sources.signals import list_recordings

#: Fixed values of the format: element types as numpy's, the types of a matrix and of a compressed element, array classes of numbers.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED = 14, 15
NUMERIC_CLASSES = range(6, 16)
#: Columns of the data set that are zero throughout; the others are read by default.
PADDING = (8, 9)
CHANNELS = tuple(c for c in range(16) if c not in PADDING)
SAMPLES = "source string, subject_id string, session_id string, sample_idx long, label int, repetition int, ch array<double>, error string"
#: Rows of an Arrow batch, and files that may be named to one read.
ROWS, MOST_FILES = 20_000, 100_000


def elements(data: memoryview, order: str) -> Iterator[tuple[int, memoryview]]:
    """(type, content) of the tagged elements one after the other; contents are padded to 8 bytes, compressed ones aren't."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(f"{order}II", data, at)
        if kind >> 16:  # a small element: size and type share a word, up to four bytes follow
            kind, size, begin, step = kind & 0xFFFF, kind >> 16, at + 4, 8
        else:
            begin, step = at + 8, 8 + size + (0 if kind == COMPRESSED else -size % 8)
        if begin + size > len(data):
            raise ValueError("it ends inside an element")
        yield kind, data[begin : begin + size]
        at += step


def read_variables(content: bytes, wanted: set[str] | None = None) -> dict[str, np.ndarray | None]:
    """name -> matrix of real numbers (None: of another kind, or not among the wanted ones)."""
    if len(content) < 128:
        raise ValueError("it has no header")
    mark = content[126:128]
    if mark not in (b"IM", b"MI"):
        raise ValueError("it is no file of level 5")
    order, out = "<" if mark == b"IM" else ">", {}
    for kind, data in elements(memoryview(content)[128:], order):
        if kind == COMPRESSED:
            kind, data = next(elements(memoryview(zlib.decompress(data)), order))
        if kind != MATRIX:
            continue
        parts = elements(data, order)
        flags = struct.unpack_from(f"{order}I", next(parts)[1])[0]
        shape = np.frombuffer(next(parts)[1], f"{order}i4")
        name = bytes(next(parts)[1]).decode("ascii", "replace")
        out[name] = None
        if flags & 0xFF in NUMERIC_CLASSES and (wanted is None or name in wanted):
            kind, values = next(parts, (None, None))
            if kind not in NUMBERS:
                raise ValueError(f"{name} has no numbers")
            values = np.frombuffer(values, np.dtype(NUMBERS[kind]).newbyteorder(order))
            if len(values) != np.prod(shape):
                raise ValueError(f"{name} has {len(values)} values for a shape of {shape.tolist()}")
            out[name] = values.reshape(shape, order="F")
    return out


def recording(content: bytes, label_field: str, channels: tuple[int, ...] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Signal (samples by channels), labels and repetitions (None: the file has none) of a file."""
    repetition_field = "rerepetition" if label_field == "restimulus" else "repetition"
    found = read_variables(content, {"emg", label_field, repetition_field})
    for name in ("emg", label_field):
        if found.get(name) is None:
            raise KeyError(f"no {name!r} among {sorted(found)}")
    signal, labels, repetitions = found["emg"], found[label_field].ravel(order="F"), found.get(repetition_field)
    if channels is not None:
        if max(channels) >= signal.shape[1]:
            raise ValueError(f"no channel {max(channels)} among {signal.shape[1]}")
        signal = signal[:, list(channels)]
    repetitions = None if repetitions is None else repetitions.ravel(order="F")
    if len(labels) != len(signal) or repetitions is not None and len(repetitions) != len(signal):
        raise ValueError(f"{len(signal)} samples, {len(labels)} labels")
    return signal.astype(float), labels.astype(int), None if repetitions is None else repetitions.astype(int)


def read_recordings(
    spark: SparkSession, root: str, subjects: list[str] | None = None, sessions: list[str] | None = None, label_field: str = "restimulus", channels: tuple[int, ...] | None = CHANNELS, source: str = "ninapro_db6", errors: str = "raise"
) -> DataFrame:
    """Samples of the wanted subjects and sessions (None: all): source, subject_id, session_id, sample_idx, label, repetition, ch, error.

    Files of others are not opened: names are listed first, and only those wanted are read. Repetitions are null where a file has none.
    A file that can't be read stops the job with its name (errors="raise") or gives one row whose error says why (errors="column").
    No wanted file gives no rows; a root without any is an error. A file is parsed whole in a task.
    """
    index = list_recordings(spark, root)
    for column, wanted in (("subject_id", subjects), ("session_id", sessions)):
        index = index if wanted is None else index.filter(F.col(column).isin(list(wanted)))
    names = {r.path: (r.subject_id, r.session_id) for r in index.limit(MOST_FILES + 1).collect()}
    if len(names) > MOST_FILES:
        raise ValueError(f"more than {MOST_FILES} files; name subjects or sessions")
    if not names:
        return spark.createDataFrame([], SAMPLES)
    files = spark.read.format("binaryFile").load(sorted(names)).select("path", "content")
    files = files.join(F.broadcast(spark.createDataFrame([(p, *k) for p, k in names.items()], "path string, subject_id string, session_id string")), "path")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                path, content, subject, session = (batch.column(c)[k].as_py() for c in ("path", "content", "subject_id", "session_id"))
                try:
                    signal, labels, repetitions = recording(content, label_field, channels)
                except (ValueError, KeyError, StopIteration, struct.error, zlib.error) as e:
                    if errors == "raise":
                        raise ValueError(f"{path}: {e}") from e
                    yield rows(subject, session, 0, np.full((1, 0), 0.0), None, None, f"{path}: {e}")
                    continue
                for at in range(0, len(signal), ROWS):
                    part = slice(at, at + ROWS)
                    yield rows(subject, session, at, signal[part], labels[part], None if repetitions is None else repetitions[part], None)

    def rows(subject, session, at, signal, labels, repetitions, error) -> pa.RecordBatch:
        n, width = signal.shape
        same = lambda v: pa.array([v] * n, pa.string())
        numbers = lambda v: pa.nulls(n, pa.int32()) if v is None else pa.array(v, pa.int32())
        lists = pa.nulls(n, pa.list_(pa.float64())) if error else pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(signal).ravel()))
        return pa.RecordBatch.from_arrays(
            [same(source), same(subject), same(session), pa.nulls(n, pa.int64()) if error else pa.array(np.arange(at, at + n)), numbers(labels), numbers(repetitions), lists, same(error)],
            ["source", "subject_id", "session_id", "sample_idx", "label", "repetition", "ch", "error"],
        )

    return files.mapInArrow(parse, SAMPLES)


def matrix(name: str, values: np.ndarray, compress: bool = True) -> bytes:
    """A matrix of doubles as an element."""
    def element(kind: int, data: bytes) -> bytes:
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    body = element(6, struct.pack("<II", 6, 0)) + element(5, np.array(values.shape, "<i4").tobytes()) + element(1, name.encode()) + element(9, np.asarray(values, "<f8").tobytes(order="F"))
    whole = element(MATRIX, body)
    packed = zlib.compress(whole, 1)
    return struct.pack("<II", COMPRESSED, len(packed)) + packed if compress else whole


def file_of(variables: dict[str, np.ndarray], compress: bool = True) -> bytes:
    return b"recording".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + b"".join(matrix(k, v, compress) for k, v in variables.items())


def write_recordings(df: DataFrame, root: str, file: str = "file") -> DataFrame:
    """Write each recording (rows file, sample_idx, label, repetition, ch) to <root>/<file>.mat, and give (file, n_samples, n_bytes).

    The files are written when the result is read, through Arrow's file systems. A file holds a recording whole, and so does the task that writes it.
    """

    def write(table: pa.Table) -> pa.Table:
        from pyarrow import fs

        table = table.sort_by("sample_idx")
        name, label, repetition = table.column("file")[0].as_py(), table.column("label").to_numpy(), table.column("repetition")
        variables = {"emg": np.array(table.column("ch").to_pylist(), float), "restimulus": label.reshape(-1, 1)}
        if not repetition.null_count:
            variables["rerepetition"] = repetition.to_numpy().reshape(-1, 1)
        content = file_of(variables)
        store, at = fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")
        store.create_dir(at, recursive=True)
        with store.open_output_stream(f"{at}/{name}.mat") as out:
            out.write(content)
        return pa.table({"file": [name], "n_samples": [table.num_rows], "n_bytes": [len(content)]})

    rows = df.select(F.col(file).alias("file"), "sample_idx", F.col("label").cast("double").alias("label"), F.col("repetition").cast("double").alias("repetition"), "ch")
    return rows.groupBy("file").applyInArrow(write, "file string, n_samples long, n_bytes long")
