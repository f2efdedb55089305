"""Document trees as a Spark data source: {category}/{document}/ folders of JSON files and of vectors in .npy files with a JSON list beside them.

    spark.dataSource.register(DocumentTree)
    spark.read.format("document_tree").option("kind", "vectors").load(path).where("category = 'law'")

Kinds and their files in a document's folder:
    documents   {document}_structured.json; a row a file, its text as column value
    vectors     any .npy file of a matrix with a .json list of objects beside it; a row a vector, with its object's fields

Filters on category and document (=, in) are taken over by the source in sessions with spark.sql.python.filterPushdown.enabled (option pushdown):
folders that they exclude are not listed, let alone read. Files are planned into partitions of bounded bytes, and a large .npy
file into several of whole rows, of which each task reads its own bytes only.
"""

from __future__ import annotations

import ast
import json
import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

#: Bytes of files that one partition reads.
PARTITION_BYTES = 64 << 20
SCHEMAS = {
    "documents": "category string, document string, file string, size bigint, value string",
    "vectors": "category string, document string, file string, position bigint, embedding array<float>, metadata map<string,string>",
}
SUFFIX = {"documents": "_structured.json", "vectors": ".npy"}
MAGIC = b"\x93NUMPY"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


@dataclass(frozen=True)
class Header:
    """What the header of a .npy file says, and where its values begin."""

    dtype: np.dtype
    by_columns: bool
    rows: int
    width: int
    start: int


def npy_header(file) -> Header:
    """The header of a .npy file that is open for reading; only matrices of real numbers are taken."""
    head = file.read(8)
    if head[:6] != MAGIC:
        raise ValueError("not a .npy file")
    size = struct.unpack("<H", file.read(2))[0] if head[6] == 1 else struct.unpack("<I", file.read(4))[0]
    said = ast.literal_eval(file.read(size).decode("latin-1" if head[6] < 3 else "utf-8"))
    dtype, shape = np.dtype(said["descr"]), said["shape"]
    if dtype.kind not in "fiu" or len(shape) != 2:
        raise ValueError(f"a matrix of numbers is needed, not {dtype} of {len(shape)} dimensions")
    return Header(dtype, said["fortran_order"], shape[0], shape[1], file.tell())


def npy_rows(file, h: Header, first: int, n: int) -> np.ndarray:
    """n rows of a .npy file from row first on; nothing else of the file is read."""
    if not h.by_columns:
        file.seek(h.start + first * h.width * h.dtype.itemsize)
        return np.frombuffer(file.read(n * h.width * h.dtype.itemsize), h.dtype).reshape(n, h.width)
    out = np.empty((n, h.width), h.dtype)
    for column in range(h.width):
        file.seek(h.start + (column * h.rows + first) * h.dtype.itemsize)
        out[:, column] = np.frombuffer(file.read(n * h.dtype.itemsize), h.dtype)
    return out


@dataclass
class Piece:
    """A file, or some rows of one."""

    category: str
    document: str
    path: str
    size: int
    first: int = 0
    rows: int = -1


class Files(InputPartition):
    def __init__(self, pieces: list[Piece]):
        super().__init__([p.path for p in pieces])
        self.pieces = pieces


class TreeReader(DataSourceReader):
    """Reads what only allows: values of category and of document."""

    def __init__(self, path: str, kind: str, bytes_each: int, only: dict[str, set[str]] | None = None):
        self.path, self.kind, self.bytes_each = path, kind, bytes_each
        self.only = only or {}

    def _folders(self, store: fs.FileSystem, path: str, name: str) -> list[str]:
        """The folders below path, or those of them that the filters name."""
        if name in self.only:
            wanted = [posixpath.join(path, v) for v in sorted(v for v in self.only[name] if v)]
            return [f.path for f in store.get_file_info(wanted) if f.type == fs.FileType.Directory]
        return sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.Directory and not f.base_name.startswith((".", "_")))

    def partitions(self):
        store, root = _store(self.path)
        pieces: list[Piece] = []
        for category in self._folders(store, root, "category"):
            for document in self._folders(store, category, "document"):
                found = {f.path: f for f in store.get_file_info(fs.FileSelector(document)) if f.is_file}
                for path in sorted(p for p in found if p.endswith(SUFFIX[self.kind])):
                    names = posixpath.basename(category), posixpath.basename(document)
                    if self.kind == "documents":
                        if posixpath.basename(path) == names[1] + SUFFIX["documents"]:
                            pieces.append(Piece(*names, path, found[path].size))
                    elif path[: -len(".npy")] + ".json" in found:  # a matrix without its list is passed over
                        pieces += self._rows(store, Piece(*names, path, found[path].size))
        held, size, out = [], 0, []
        for p in pieces:
            if held and size + p.size > self.bytes_each:
                out.append(Files(held))
                held, size = [], 0
            held.append(p)
            size += p.size
        return [*out, Files(held)] if held or not out else out

    def _rows(self, store: fs.FileSystem, whole: Piece) -> list[Piece]:
        if whole.size <= self.bytes_each:
            return [whole]
        with store.open_input_file(whole.path) as file:
            h = npy_header(file)
        step = max(1, self.bytes_each // max(h.width * h.dtype.itemsize, 1))
        return [Piece(whole.category, whole.document, whole.path, step * h.width * h.dtype.itemsize, k, min(step, h.rows - k)) for k in range(0, h.rows, step)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        for p in partition.pieces:
            yield from (_document if self.kind == "documents" else _vectors)(store, p)


class PushedReader(TreeReader):
    """Takes filters over; Spark calls for it only in sessions that allow that."""

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute in (("category",), ("document",)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.only[name] = self.only[name] & values if name in self.only else values
            elif isinstance(f, IsNotNull) and f.attribute in (("category",), ("document",), ("file",)):
                continue  # they never are
            else:
                yield f


def _document(store: fs.FileSystem, p: Piece) -> Iterator[pa.RecordBatch]:
    with store.open_input_file(p.path) as file:
        text = file.read().decode("utf-8", "replace")
    columns = [[p.category], [p.document], [p.path], [p.size], [text]]
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k == 3 else pa.string()) for k, c in enumerate(columns)], ["category", "document", "file", "size", "value"])


def _vectors(store: fs.FileSystem, p: Piece, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    with store.open_input_file(p.path[: -len(".npy")] + ".json") as beside:
        metadata = json.loads(beside.read())
    with store.open_input_file(p.path) as file:
        h = npy_header(file)
        end = h.rows if p.rows < 0 else p.first + p.rows
        for first in range(p.first, end, rows):
            x = npy_rows(file, h, first, min(rows, end - first)).astype(np.float32)
            n = len(x)
            about = [metadata[k] if k < len(metadata) else None for k in range(first, first + n)]
            texts = [None if m is None else [(str(k), v if v is None or isinstance(v, str) else json.dumps(v)) for k, v in m.items()] for m in about]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * h.width, pa.int32()), pa.array(x.ravel()))
            same = [pa.array([v] * n, pa.string()) for v in (p.category, p.document, p.path)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(first, first + n)), lists, pa.array(texts, pa.map_(pa.string(), pa.string()))], ["category", "document", "file", "position", "embedding", "metadata"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class TreeWriter(DataSourceArrowWriter):
    """Writes rows of SCHEMAS' columns (file and size aside), those of a document together and in order of position.

    Files get their names when all tasks have ended; of tasks that ran twice one counts.
    """

    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        aside, files, held = posixpath.join(root, "_aside", uuid.uuid4().hex), [], []
        store.create_dir(aside, recursive=True)

        def put(name: str, content: bytes) -> None:
            at = f"{aside}/{len(files)}"
            with store.open_output_stream(at) as out:
                out.write(content)
            files.append((at, f"{root}/{name}"))

        def flush() -> None:
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks()
            category, document = rows.column("category")[0].as_py(), rows.column("document")[0].as_py()
            stem = f"{category}/{document}/{document}"
            if self.kind == "documents":
                put(stem + SUFFIX["documents"], rows.column("value")[0].as_py().encode())
            else:
                lists = rows.column("embedding").combine_chunks()
                x = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1), "<f4")
                said = f"{{'descr': '<f4', 'fortran_order': False, 'shape': {x.shape}, }}".encode("latin-1")
                said += b" " * (-(len(said) + 11) % 64) + b"\n"
                put(stem + ".npy", MAGIC + b"\x01\x00" + struct.pack("<H", len(said)) + said + x.tobytes())
                put(stem + ".json", json.dumps([dict(m or []) for m in rows.column("metadata").to_pylist()]).encode())
            held.clear()

        for b in iterator:
            names = list(zip(b.column("category").to_pylist(), b.column("document").to_pylist(), strict=True))
            at = 0
            for k in range(1, len(names) + 1):
                if k == len(names) or names[k] != names[at]:
                    if held and (held[0].column("category")[0].as_py(), held[0].column("document")[0].as_py()) != names[at]:
                        flush()
                    held.append(b.slice(at, k - at))
                    at = k
        flush()
        return Written(files)

    def commit(self, messages) -> None:
        store, root = _store(self.path)
        made = set()
        for m in messages:
            for at, to in m.files if m else []:
                folder = posixpath.dirname(to)
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                store.move(at, to)
        self.abort(messages)

    def abort(self, messages) -> None:
        store, root = _store(self.path)
        if store.get_file_info(f"{root}/_aside").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/_aside")


class DocumentTree(DataSource):
    """See the module. Options: path, kind (documents or vectors), partition_bytes, category and document (JSON lists of those to read), pushdown."""

    @classmethod
    def name(cls) -> str:
        return "document_tree"

    def _kind(self) -> str:
        kind = self.options.get("kind", "documents")
        if kind not in SCHEMAS:
            raise ValueError(f"kind is one of {', '.join(SCHEMAS)}")
        return kind

    def schema(self) -> str:
        return SCHEMAS[self._kind()]

    def reader(self, schema) -> TreeReader:
        only = {name: set(json.loads(self.options[name])) for name in ("category", "document") if name in self.options}
        make = PushedReader if self.options.get("pushdown") == "true" else TreeReader
        return make(self.options["path"], self._kind(), int(self.options.get("partition_bytes", PARTITION_BYTES)), only)

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"], self._kind())


def read_tree(spark: SparkSession, path: str, kind: str = "documents", partition_bytes: int = PARTITION_BYTES, only: dict[str, list[str]] | None = None) -> DataFrame:
    """A tree's documents or vectors; only names the values of category or document to read. Where the session allows it the source takes filters over."""
    spark.dataSource.register(DocumentTree)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format("document_tree").option("kind", kind).option("partition_bytes", str(partition_bytes)).option("pushdown", pushdown)
    return reader.options(**{name: json.dumps(values) for name, values in (only or {}).items()}).load(path)


def write_tree(df: DataFrame, path: str, kind: str = "documents") -> None:
    """Writes documents (category, document, value), or vectors (category, document, position, embedding, metadata), of which each document is one task's.

    Rows with a null category or document have no place in a tree and are an error, as are names with a slash. Files of the same names are replaced.
    """
    columns = ["category", "document", "value"] if kind == "documents" else ["category", "document", "position", "embedding", "metadata"]
    spark = df.sparkSession
    spark.dataSource.register(DocumentTree)
    named = df.select(*columns).selectExpr(*(f"CASE WHEN {c} IS NULL OR contains({c}, '/') OR {c} = '' THEN raise_error('a document needs the name of a folder') ELSE {c} END AS {c}" for c in columns[:2]), *columns[2:])
    ordered = named.repartition("category", "document").sortWithinPartitions("category", "document", *columns[2:3])
    ordered.write.format("document_tree").option("kind", kind).mode("append").save(path)
