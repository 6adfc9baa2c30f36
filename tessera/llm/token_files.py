"""Operator 2 — token ids as Arrow stream files of equal-length sequences.

``write`` encodes each whole text, appends the end id, and lays the ids of all documents end to end
in ascending id order.  Each range of documents is one pair of files in the shared folder, or several
where it holds more than ``FILE_TOKENS`` ids (a document is never cut):

* ``*.tokens.arrow``: an Arrow stream whose batches have two fixed-size-list columns of ``length``,
  ``ids`` (uint16 where the vocabulary fits, else uint32) and ``mask`` (bit-packed, false on the
  padding that fills the file's last sequence).  Batches are not compressed and have ``BATCH`` rows
  each, so a memory-mapped reader reaches any sequence or mask without a copy;
* ``*.index.arrow``: an Arrow stream with each document's id, first position in the file and length.

A task writes its files under names of its own and reports them; what a lost or doubled attempt wrote
is never read.  ``TokenFile`` is the random-access reader; ``read`` gives a row per document and goes
through a file batch by batch.  The folder may be on ``file``, ``hdfs``, ``s3`` (``s3a``) or ``gs``.

Words repeat, so a worker keeps the ids of at most ``CACHE`` words between blanks.  The tokenizer
removes white space before it merges, and none of its patterns crosses a blank or a line feed, so
the ids of a text are the ids of its blank-separated words, end to end.

Defined results: a null text is empty and has the end id alone; a null id comes first; rows with one
id lie in order of their text; further columns are ignored; no rows give no files and no rows.
"""

from __future__ import annotations

import os
import uuid
import zlib
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, shuffle_partitions, tidy

LENGTH = 1024
BATCH = 256
CACHE = 400_000
LONG_WORD = 64
LINE = 1000
WORD_END = "</w>"
TAIL = ".,;:!?*%$#&-_()[]{}\"/+=<>"  # signs that the tokenizer never joins to letters
MARK = "\x01"  # stands between words that are learnt together
FILE_TOKENS = 1 << 26  # ids of one file: 128 MB of uint16
RUN = 1 << 21
END_ID = 1
META = "part int, file int, path string, n_docs long, n_tokens long"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Texts -> ids, through a bounded cache of words whose ids lie end to end in one array."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a run of letters
        self.closing[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(WORD_END)]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {"": 0}  # word -> its number
        self.ids = np.empty(1 << 16, self.dtype)
        self.ends = np.zeros(2, np.int64)  # number + 1 -> end of the word's ids

    def _keep(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        used, n = int(self.ends[-1]), len(self.ends) - 1
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[used : used + len(ids)] = ids
        self.ends = np.concatenate([self.ends, used + np.cumsum(sizes)])
        self.known.update(zip(words, range(n, n + len(words))))

    def _learn_letters(self, words: list[str]) -> None:
        """Each word is one run of letters, so its last id closes it."""
        long = [w for w in words if len(w) > LONG_WORD]
        words = [w for w in words if len(w) <= LONG_WORD]
        lines = [words[i : i + LINE] for i in range(0, len(words), LINE)]
        for line, found in zip(lines, self.tokenizer.encode_batch([" ".join(x) for x in lines], add_special_tokens=False)):
            ids = np.array(found.ids, self.dtype)
            last = np.flatnonzero(self.closing[ids])
            if len(last) == len(line) and (not len(last) or last[-1] == len(ids) - 1):
                self._keep(line, ids, np.diff(np.r_[-1, last]))
            else:  # some letter is more than one run in lower case
                self._learn_any(line)
        self._learn_any(long)

    def _learn_any(self, words: list[str]) -> None:
        """Words of any kind, with a mark between them that none of them holds."""
        plain = [w for w in words if len(w) <= LONG_WORD and MARK not in w] if len(self.mark) == 1 else []
        lines = [plain[i : i + LINE] for i in range(0, len(plain), LINE)]
        for line, found in zip(lines, self.tokenizer.encode_batch([f" {MARK} ".join(x) for x in lines], add_special_tokens=False)):
            ids = np.array(found.ids, self.dtype)
            here = ids == self.mark[0]
            cuts = np.r_[-1, np.flatnonzero(here), len(ids)]
            self._keep(line, ids[~here], np.diff(cuts) - 1)
        done = set(plain)
        for w in (w for w in words if w not in done):
            ids = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, self.dtype)
            self._keep([w], ids, np.array([len(ids)]))

    def _gather(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the numbered words end to end, how many each has)."""
        starts = self.ends[number]
        sizes = self.ends[number + 1] - starts
        after = np.cumsum(sizes)
        at = np.repeat((starts - after + sizes).astype(np.int32 if len(self.ids) < 1 << 30 and len(after) and after[-1] < 1 << 30 else np.int64), sizes)
        at += np.arange(len(at), dtype=at.dtype)
        return self.ids[at], sizes

    def _numbers(self, words: pa.DictionaryArray) -> np.ndarray:
        kinds = words.dictionary.to_pylist()
        new = [w for w in kinds if w not in self.known]
        self._learn_letters([w for w in new if w.isalpha()])
        self._learn_any([w for w in new if not w.isalpha()])
        return np.fromiter(map(self.known.__getitem__, kinds), np.int64, len(kinds))[words.indices.to_numpy()]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, how many each has); new words of a run of texts are learnt together.

        A word is looked up as its core and its tail of signs, which never merge behind a letter or a digit.
        """
        if len(self.known) > CACHE or self.ends[-1] > 16 * CACHE:
            self.clear()
        lists = pc.split_pattern(pc.ascii_lower(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " ")), " ")
        words = lists.flatten()
        cores = pc.utf8_rtrim(words, TAIL)
        kinds = cores.dictionary_encode()
        joins = pc.invert(pc.match_substring_regex(kinds.dictionary, r"[\p{L}\p{N}]$|^$"))
        if pc.any(joins).as_py():  # these end in another sign, which may merge with the tail
            cores = pc.if_else(joins.take(kinds.indices), words, cores)
            kinds = cores.dictionary_encode()
        sizes = np.diff(_offsets(words)) - np.diff(_offsets(cores))
        number = np.zeros((len(words), 2), np.int64)  # number 0 is the empty word
        number[:, 0] = self._numbers(kinds)
        tailed = np.flatnonzero(sizes)
        if len(tailed):
            ends = np.cumsum(sizes[tailed])
            at = np.repeat(_offsets(words)[1:][tailed] - ends, sizes[tailed]) + np.arange(ends[-1])
            tails = pa.LargeStringArray.from_buffers(len(tailed), pa.py_buffer(np.r_[0, ends]), pa.py_buffer(np.frombuffer(words.buffers()[2], np.uint8)[at]))
            number[tailed, 1] = self._numbers(tails.dictionary_encode())
        out, sizes = self._gather(number.ravel())
        return out, np.diff(np.r_[0, np.cumsum(sizes)][2 * _offsets(lists)])


def _offsets(x: pa.Array) -> np.ndarray:
    """Where the values of a string or list array start and end, as 64-bit numbers."""
    wide = pa.types.is_large_string(x.type) or pa.types.is_large_list(x.type)
    return np.frombuffer(x.buffers()[1], np.int64 if wide else np.int32)[x.offset : x.offset + len(x) + 1].astype(np.int64)


def runs(texts: list[str], most: int = RUN):
    """Runs of texts of a bounded size, any one text whole."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class TokenFile:
    """Random access to the equal-length sequences and masks of one file, without copies where it is local."""

    def __init__(self, uri: str):
        files, path = _place(uri)
        self.source = pa.memory_map(path) if urlparse(uri).scheme in ("", "file") else files.open_input_file(path)
        with pa.ipc.open_stream(self.source) as reader:
            self.batches = list(reader)
            self.length = reader.schema.field("ids").type.list_size
            self.rows = int((reader.schema.metadata or {}).get(b"batch", BATCH))

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> np.ndarray:
        b, at = self.batches[i // self.rows], i % self.rows * self.length
        return b.column(0).flatten()[at : at + self.length].to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> pa.Array:
        b, at = self.batches[i // self.rows], i % self.rows * self.length
        return b.column(1).flatten()[at : at + self.length]


def documents(uri: str):
    """(index batch, ids of each of its documents) of a pair of files, reading one batch of tokens at a time."""
    files, path = _place(uri)
    with files.open_input_stream(path + ".tokens.arrow") as tokens, pa.ipc.open_stream(tokens) as batches, files.open_input_stream(path + ".index.arrow") as places, pa.ipc.open_stream(places) as index:
        held, first = np.empty(0, np.uint16), 0  # ids not yet passed, and the place of their first
        for k in index:
            found = []
            for s, n in zip(k.column(1).to_pylist(), k.column(2).to_pylist()):
                parts, have = [held[s - first :]], first + len(held) - s
                while have < n:
                    parts.append(batches.read_next_batch().column(0).flatten().to_numpy(zero_copy_only=True))
                    have += len(parts[-1])
                held, first = np.concatenate(parts) if len(parts) > 1 else parts[0], s
                found.append(held[:n])
            yield k, found


class _File:
    """One pair of files being written."""

    def __init__(self, uri: str, dtype: np.dtype, length: int, end_id: int):
        self.uri, self.dtype, self.length = uri, dtype, length
        files, local = _place(uri)
        files.create_dir(os.path.dirname(local), recursive=True)
        schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))], metadata={"batch": str(BATCH), "end_id": str(end_id)})
        self.schema, self.total, self.docs = schema, 0, 0
        self.sinks = [files.open_output_stream(f"{local}.{kind}.arrow") for kind in ("tokens", "index")]
        self.out = pa.ipc.new_stream(self.sinks[0], schema)
        self.index = pa.ipc.new_stream(self.sinks[1], pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
        self.waiting: list[np.ndarray] = []
        self.held = 0

    def add(self, keys: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        starts = self.total + np.cumsum(counts) - counts
        self.index.write_batch(pa.RecordBatch.from_arrays([keys, pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], ["id", "start", "n_tokens"]))
        self.total, self.docs, self.held = self.total + len(ids), self.docs + len(counts), self.held + len(ids)
        self.waiting.append(ids)
        if self.held >= BATCH * self.length:
            self._put(False)

    def _put(self, final: bool) -> None:
        flat = np.concatenate(self.waiting) if self.waiting else np.empty(0, self.dtype)
        block, at = BATCH * self.length, 0
        while len(flat) - at >= block or final and at < len(flat):
            n = min(block, len(flat) - at)
            rows = -(-n // self.length)
            ids = np.zeros(rows * self.length, self.dtype)
            ids[:n] = flat[at : at + n]
            bits = np.packbits(np.arange(rows * self.length) < n, bitorder="little")
            mask = pa.Array.from_buffers(pa.bool_(), rows * self.length, [None, pa.py_buffer(bits.tobytes())])
            self.out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(x, self.length) for x in (pa.array(ids), mask)], schema=self.schema))
            at += n
        self.waiting, self.held = [flat[at:]], len(flat) - at

    def close(self) -> None:
        self._put(True)
        for x in (self.out, self.index, *self.sinks):
            x.close()


def _writer(path: str, folder: str, end_id: int, length: int, most: int):
    def run(batches):
        from pyspark import TaskContext

        enc, part, number, out = None, TaskContext.get().partitionId(), 0, None

        def done():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([out.uri]), pa.array([out.docs]), pa.array([out.total])], ["part", "file", "path", "n_docs", "n_tokens"])

        for b in batches:
            enc = enc or encoder(path)
            at = 0
            for texts in runs([t or "" for t in b.column(1).to_pylist()]):
                ids, counts = enc.encode(texts)
                ends = np.cumsum(counts)
                if out is not None and out.total + len(ids) + len(texts) > most:
                    yield done()
                    out, number = None, number + 1
                if out is None:
                    out = _File(f"{folder}/{part:06d}-{number}-{uuid.uuid4().hex}", enc.dtype, length, end_id)
                out.add(b.column(0).slice(at, len(texts)), np.insert(ids, ends, end_id), counts + 1)
                at += len(texts)
        if out is not None:
            yield done()

    return run


def write(df: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, length: int = LENGTH, most: int = FILE_TOKENS) -> DataFrame:
    """Write the files; lazily gives a row per pair of files (``META``), which the caller must materialise once."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.repartitionByRange(shuffle_partitions(df.sparkSession), "id").sortWithinPartitions("id", "text")
    return rows.mapInArrow(tidy(_writer(tokenizer, folder, end_id, length, most)), META)


def _reader(batches):
    for b in batches:
        for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for k, found in documents(uri):
                crcs = [zlib.crc32(ids.astype("<u4")) for ids in found]
                yield pa.RecordBatch.from_arrays([k.column(0), pc.add(k.column(1), base), k.column(2), pa.array(crcs, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])


def read(files: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files; ``start`` counts the ids of all documents before."""
    earlier = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row per pair of files
    placed = files.select("path", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("base"))
    return placed.repartition(shuffle_partitions(files.sparkSession), "path").mapInArrow(tidy(_reader), "id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    files = scratch.save(write(docs, scratch.path("files"), vocabulary_path()), "meta")
    return read(files).withColumnRenamed("id", "doc_id")
