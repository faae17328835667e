"""Token ids of documents in Arrow files of equal-length sequences.

``write_tokens`` range-partitions the documents by doc_id; each partition becomes a file pair in ascending order:

* ``part-*.arrow``: Arrow's file format, record batches of ``ids`` (fixed-size lists of 16- or 32-bit unsigned numbers) and
  ``mask`` (fixed-size lists of booleans, false for padding). Memory-mapped, any sequence is a view without a copy.
  A file is a stream of ids cut into sequences; only its last sequence is padded.
* ``part-*.index.arrow``: doc_id, start and n_tokens of each document in that stream.

``_manifest.json`` names the files in order with the number of ids in each, which gives global offsets. A task
writes under a name of its own and the manifest only has those of tasks that succeeded, so a lost or repeated task leaves no trace in
what is read. Files are reached by Arrow's file systems, local paths and URIs alike.

Null texts count as empty; an empty document has the end id alone. Documents with a null doc_id come first, rows with
equal doc_ids by text; repeated rows are written each. An empty table gives a manifest without files. Nothing is truncated; a very long text is encoded in one
worker. Texts with one of the tokenizer's added tokens are encoded as the library does it. Only doc_id (a long) and text are read, so other columns may have any name.
The files of a run are the caller's to remove, with their folder; what lost tasks left is removed once the manifest is there.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections import defaultdict
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_BYTES, pieces, release

LENGTH, END, ROWS = 2048, 2, 128
#: Strings whose ids a worker keeps; beyond, it starts anew (which changes no result).
KEPT_STRINGS = 800_000

#: A space before anything but letters, numbers and visible ASCII; such texts, and those with NUL, are cut by ``_CUT``.
_ODD = r" (?:[^\p{L}\p{N}\x21-\x7e]|$)|\x00"
_CUT = re.compile(r"(?= \S)")
#: Other places where the tokenizer's pattern always begins a new string: after a word, and around a single line feed.
_WORD_END = r"([\p{L}\p{N}])([^\s\p{L}\p{N}\x00])"
_LINE_END = r"([^\s\x00])\n(\p{L})"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _file_system(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else os.path.abspath(folder))


class Encoder:
    """Encodes each distinct string between spaces once.

    The tokenizer's own pattern starts a new string at every space before a character that isn't white space, after
    every word and around a single line feed, and merges never cross such strings, so encoding them one by one gives the ids
    of the whole text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ["RAYON_NUM_THREADS"] = "1"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = "|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values())
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.clear()

    def clear(self) -> None:
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.flat, self.offset = np.zeros(0, np.uint32 if self.wide else np.uint16), np.zeros(1, np.int32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the number of each. Nulls count as empty."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, self.added) if self.added else None
        if whole is None or not pc.any(whole).as_py():
            return self._encode(texts)
        # an added token may be cut; such texts are left to the library
        ids, sizes = self._encode(pc.if_else(whole, "", texts))
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
            parts[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, self.flat.dtype)
        return np.concatenate(parts), np.array([len(x) for x in parts])

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > KEPT_STRINGS:
            self.clear()
        odd = pc.match_substring_regex(texts, _ODD)
        if pc.any(odd).as_py():
            cut = pa.array([_CUT.split(t) if o else [t if i == 0 else f" {t}" for i, t in enumerate(t.split(" "))] for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)], pa.list_(pa.string()))
        else:
            cut = pc.replace_substring_regex(pc.replace_substring(texts, " ", "\0 "), _WORD_END, "\\1\0\\2")
            cut = pc.split_pattern(pc.replace_substring_regex(cut, _LINE_END, "\\1\0\n\0\\2"), "\0")
        strings = cut.flatten().dictionary_encode()
        had, get = len(self.known), self.known.__getitem__
        number = np.fromiter(map(get, strings.dictionary.to_pylist()), np.int32, len(strings.dictionary))
        fresh = list(islice(self.known, had, None))
        flats, offsets = [self.flat], [self.offset]
        for i in range(0, len(fresh), 5_000):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(fresh[i : i + 5_000], add_special_tokens=False)]
            offsets.append((offsets[-1][-1] + np.cumsum(np.fromiter(map(len, ids), np.int32, len(ids)))).astype(np.int32))
            flats.append(np.fromiter(chain.from_iterable(ids), self.flat.dtype))
        self.flat, self.offset = np.concatenate(flats), np.concatenate(offsets)
        lists = pa.ListArray.from_arrays(pa.array(self.offset), pa.array(self.flat))
        taken = lists.take(pa.array(number[strings.indices.to_numpy()]))
        ends = taken.offsets.to_numpy()[cut.offsets.to_numpy() - cut.offsets[0].as_py()]
        return taken.flatten().to_numpy(), np.diff(ends)


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """One for each worker; its strings serve later tasks."""
    return Encoder(path)


class _Writer:
    def __init__(self, fs: pa.fs.FileSystem, path: str, wide: bool, length: int):
        self.length = length
        self.kind = pa.uint32() if wide else pa.uint16()
        self.dtype = self.kind.to_pandas_dtype()
        self.ids = pa.ipc.new_file(fs.open_output_stream(f"{path}.arrow"), self.schema)
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.index = pa.ipc.new_file(fs.open_output_stream(f"{path}.index.arrow"), self.index_schema)
        self.held: list[np.ndarray] = []
        self.waiting = self.total = 0
        self.docs: list[tuple[int | None, int, int]] = []

    @property
    def schema(self) -> pa.Schema:
        return pa.schema([("ids", pa.list_(pa.field("item", self.kind, nullable=False), self.length)), ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), self.length))])

    def add(self, doc_id: int | None, ids: np.ndarray, end: int) -> None:
        n = len(ids) + 1
        self.docs.append((doc_id, self.total, n))
        self.total += n
        self.waiting += n
        self.held += [ids, np.array([end], self.dtype)]
        if self.waiting >= ROWS * self.length:
            stream = np.concatenate(self.held)
            whole = len(stream) // (ROWS * self.length) * ROWS * self.length
            for i in range(0, whole, ROWS * self.length):
                self._batch(stream[i : i + ROWS * self.length])
            self.held, self.waiting = [stream[whole:]], len(stream) - whole
        if len(self.docs) >= 10_000:
            self._index()

    def _batch(self, stream: np.ndarray) -> None:
        rows = -(-len(stream) // self.length)
        ids = np.zeros(rows * self.length, self.dtype)
        ids[: len(stream)] = stream
        mask = np.arange(len(ids)) < len(stream)
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x, f.type.value_type), type=f.type) for x, f in zip((ids, mask), self.schema, strict=True)]
        self.ids.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def _index(self) -> None:
        if self.docs:
            self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*self.docs, strict=True)], schema=self.index_schema))
            self.docs = []

    def close(self) -> None:
        rest = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        if len(rest):
            self._batch(rest)
        self._index()
        for w in (self.ids, self.index):
            w.close()


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, length: int = LENGTH, end: int = END) -> None:
    """Write ``docs`` (doc_id, text) to ``folder``, which all executors must share."""
    path = tokenizer or default_tokenizer()
    fs, root = _file_system(folder)
    fs.create_dir(root, recursive=True)
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        fs, root = _file_system(folder)
        encoder = writer = None
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        count = 0
        for batch in batches:
            for part in pieces(batch, limit=2 * BATCH_BYTES):
                if writer is None:
                    encoder = _encoder(path)
                    writer = _Writer(fs, f"{root}/{name}", encoder.wide, length)
                ids, sizes = encoder.encode(part.column("text"))
                for doc_id, one in zip(part.column("doc_id").to_pylist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                    writer.add(doc_id, one, end)
                    count += 1
            release()
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "docs": pa.array([count], pa.int64()), "ids": pa.array([writer.total], pa.int64())})

    done = sorted(tuple(r) for r in ordered.mapInArrow(write, "part int, name string, docs long, ids long").collect())  # a row for each file
    with fs.open_output_stream(f"{root}/_manifest.json") as f:
        f.write(json.dumps({"length": length, "end": end, "files": [{"name": n, "docs": d, "ids": i} for _, n, d, i in done]}).encode())
    kept = {f"{n}{end}" for _, n, *_ in done for end in (".arrow", ".index.arrow")}
    for found in fs.get_file_info(pyarrow.fs.FileSelector(root)):
        if found.base_name.startswith("part-") and found.base_name not in kept:
            fs.delete_file(found.path)


class TokenFile:
    """One file pair, memory-mapped where its file system allows it."""

    def __init__(self, folder: str, name: str):
        fs, root = _file_system(folder)
        def opened(x):
            return pa.ipc.open_file(pa.memory_map(x) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(x))
        self.file, self.index = opened(f"{root}/{name}.arrow"), opened(f"{root}/{name}.index.arrow")
        self.length = self.file.schema.field("ids").type.list_size
        self.held: tuple[int, np.ndarray] | None = None

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """The i-th sequence and its mask, without a copy of the file's data."""
        batch = self.file.get_batch(i // ROWS)
        return batch.column("ids")[i % ROWS].values.to_numpy(), batch.column("mask")[i % ROWS].values

    def _stream(self, i: int) -> np.ndarray:
        if self.held is None or self.held[0] != i:
            self.held = i, self.file.get_batch(i).column("ids").flatten().to_numpy()
        return self.held[1]

    def ids(self, start: int, n: int) -> np.ndarray:
        size, parts = ROWS * self.length, []
        while n:
            part = self._stream(start // size)[start % size : start % size + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of each document's ids as little-endian 32-bit numbers, read from the files."""
    fs, root = _file_system(folder)
    with fs.open_input_stream(f"{root}/_manifest.json") as f:
        files = json.loads(f.read())["files"]
    rows, base = [], 0
    for x in files:
        rows.append((x["name"], base))
        base += x["ids"]
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long"
    listed = spark.createDataFrame(rows, "name string, base long").repartition(max(1, len(rows)), "base")

    def read(batches):
        for batch in batches:
            for name, base in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist(), strict=True):
                file = TokenFile(folder, name)
                for i in range(file.index.num_record_batches):
                    docs = file.index.get_batch(i)
                    start, n = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                    crc = [zlib.crc32(np.ascontiguousarray(file.ids(a, k), "<u4").tobytes()) for a, k in zip(start.tolist(), n.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(start + base), docs.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return listed.mapInArrow(read, kind)
