"""Operator 7: token ids in files, compressed by a static range asymmetric numeral system.

One frequency table, counted over all documents, serves all blocks. A block holds whole documents and
can be decoded alone: its ids are dealt in turn to LANES interleaved coders, whose end states are the
checkpoint, and a checksum of the ids guards it. The files are Parquet files of such blocks, written
by Spark's committer, so that a lost task leaves no half file; a block tells its part (in order of
doc_id), the place of its first id in the part, its documents and their lengths. Beside the folder
``blocks`` lie ``counts`` (id, n), from which the frequency table follows, and ``parts`` (part, base: ids
of all parts before it): whoever has the folder can decode it.

A block's payload, little-endian: numbers of ids, lanes and checkpoints (uint32); for each checkpoint the
place of its id and of its word (uint32); the lanes' states at the start and at each checkpoint (uint64); then the
words (uint32) in the order in which the decoder asks for them. Checkpoints stand every MARK steps, so that a
long document's block can be decoded from several places at once.

Token ids come from the tokenizers library, once for each distinct piece of text (``bytepieces``).
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slicewin.llm.bytepieces import Encoder
from slicewin.llm.common import discard, folder, materialize, store, table
from slicewin.llm.textscan import portions

BITS, LANES, BLOCK = 20, 512, 1 << 16
MARK = 128
END = 0
U = np.uint64
LOW = U(1 << 31)


def frequencies(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Counts scaled to the sum 2**bits, at least 1 for each id that occurs."""
    seen = counts > 0
    out = np.zeros(len(counts), np.int64)
    if not seen.any():
        return out
    spare = (1 << bits) - int(seen.sum())
    out[seen] = 1 + np.floor(counts[seen] / counts.sum() * spare).astype(np.int64)
    out[int(np.argmax(counts))] += (1 << bits) - int(out.sum())
    return out


class Coder:
    def __init__(self, freq: np.ndarray, bits: int = BITS):
        self.bits, self.f = bits, freq.astype(U)
        self.c = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(U)
        self.of = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        k = max(1, min(LANES, n // 64))
        x, words, b, written, marks = np.full(k, LOW, U), [], U(self.bits), 0, []
        for step in range((n - 1) // k, -1, -1):
            s = ids[step * k : (step + 1) * k]
            f, y = self.f[s], x[: len(s)]
            full = y >= f << U(63 - self.bits)
            words.append((y[full] & U(0xFFFFFFFF)).astype("<u4"))
            written += len(words[-1])
            y = np.where(full, y >> U(32), y)
            q = y // f
            x[: len(s)] = (q << b) + (y - q * f) + self.c[s]
            if step and step % MARK == 0:
                marks.append((step * k, written, x.copy()))
        places = [v for at, w, _ in reversed(marks) for v in (at, written - w)]
        states = [x, *[m[2] for m in reversed(marks)]]
        return np.array([n, k, len(marks), *places], "<u4").tobytes() + np.concatenate(states).astype("<u8").tobytes() + b"".join(w.tobytes() for w in reversed(words))

    def decode(self, data: bytes, mark: int = 0, until: int | None = None) -> np.ndarray:
        """The ids from checkpoint ``mark`` (0: the start) up to checkpoint ``until`` (None: the end)."""
        n, k, m = (int(v) for v in np.frombuffer(data, "<u4", 3))
        places = np.concatenate([[0, 0], np.frombuffer(data, "<u4", 2 * m, 12)]).astype(np.int64).reshape(m + 1, 2)
        head = 12 + 8 * m
        x = np.frombuffer(data, "<u8", k, head + 8 * k * mark).copy()
        words = np.frombuffer(data[head + 8 * k * (m + 1) :], "<u4")
        first, p = (int(v) for v in places[mark])
        last = n if until is None else int(places[until, 0])
        out, b, mask = np.empty(last - first, np.uint32), U(self.bits), U((1 << self.bits) - 1)
        for at in range(first, last, k):
            y = x[: min(k, last - at)]
            slot = y & mask
            s = self.of[slot]
            out[at - first : at - first + len(s)] = s
            y = self.f[s] * (y >> b) + slot - self.c[s]
            low = np.flatnonzero(y < LOW)
            y[low] = y[low] << U(32) | words[p : p + len(low)]
            p += len(low)
            x[: len(s)] = y
        return out


def tokenize(docs: DataFrame, tokenizer: str, id_col: str, text_col: str) -> DataFrame:
    """(part, at, doc_id, ids) in ascending doc_id order; at: ids of the part before the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        coder, part, at = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        for b in portions(batches):
            ids = [np.append(x, np.uint32(END)) for x in coder.encode(b.column(1))]
            starts = at + np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            at = int(starts[-1])
            small = [x.astype("<u2" if int(x.max()) < 1 << 16 else "<u4").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), pa.array(starts[:-1], pa.int64()), b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(small, pa.binary())],
                names=["part", "at", "doc_id", "n", "ids"],
            )

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return rows.mapInArrow(run, f"part int, at long, doc_id {kind}, n long, ids binary")


def unpack(ids: bytes, n: int) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")


def count_ids(tokens: DataFrame, vocabulary: int) -> DataFrame:
    """(id, n): occurrences of each id over all documents; at most as many rows as the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            for x, n in zip(b.column(1), b.column(0).to_pylist(), strict=True):
                ids = unpack(x.as_py(), n)
                if n > 4096:
                    total += np.bincount(ids, minlength=vocabulary)
                else:
                    np.add.at(total, ids, 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return tokens.select("n", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def table_of(counts: DataFrame) -> np.ndarray:
    """The frequency table; all that comes to the driver, of the vocabulary's size."""
    found = counts.toArrow()
    out = np.zeros(int(found["id"].to_numpy().max()) + 1 if len(found) else 0, np.int64)
    out[found["id"].to_numpy()] = found["n"].to_numpy()
    return frequencies(out)


def encode_blocks(tokens: DataFrame, freq: np.ndarray) -> DataFrame:
    kind = dict(tokens.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        names = ["part", "at", "doc_ids", "lengths", "checksum", "payload"]
        group: list = []

        def block() -> pa.RecordBatch:
            ids = np.concatenate([g[3] for g in group]).astype("<u4")
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([group[0][0]], pa.int32()),
                    pa.array([group[0][1]], pa.int64()),
                    pa.array([[g[2] for g in group]], pa.list_(type_)),
                    pa.array([[len(g[3]) for g in group]], pa.list_(pa.int64())),
                    pa.array([zlib.crc32(ids.tobytes())], pa.int64()),
                    pa.array([coder.encode(ids)], pa.binary()),
                ],
                names=names,
            )

        size, follow = 0, (-1, -1)
        for b in batches:
            type_ = b.schema.field("doc_id").type
            for i in range(b.num_rows):
                part, at, doc, n = (b.column(c)[i].as_py() for c in range(4))
                if group and (size >= BLOCK or follow != (part, at)):
                    yield block()
                    group, size = [], 0
                group.append((part, at, doc, unpack(b.column(4)[i].as_py(), n)))
                size, follow = size + n, (part, at + n)
        if group:
            yield block()

    return tokens.mapInArrow(run, f"part int, at long, doc_ids array<{kind}>, lengths array<long>, checksum long, payload binary")


def decode_blocks(blocks: DataFrame, freq: np.ndarray) -> DataFrame:
    """(part, at, doc_id, n_tokens, ids_crc32) from the files; a block that fails its checksum raises."""
    kind = dict(blocks.dtypes)["doc_ids"][6:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for b in batches:
            for i in range(b.num_rows):
                lengths = np.array(b.column(3)[i].as_py(), np.int64)
                ids = coder.decode(b.column(5)[i].as_py()).astype("<u4")
                if zlib.crc32(ids.tobytes()) != b.column(4)[i].as_py():
                    raise ValueError("a block of token ids fails its checksum")
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, lengths, strict=True)]
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b.column(0)[i].as_py()] * n, pa.int32()), pa.array(b.column(1)[i].as_py() + ends - lengths), b.column(2)[i].values, pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["part", "at", "doc_id", "n_tokens", "ids_crc32"],
                )

    return blocks.mapInArrow(run, f"part int, at long, doc_id {kind}, n_tokens long, ids_crc32 long")


def write_files(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ``path``/blocks, counts and parts for the token ids of all rows, in ascending order of the id.

    A null or empty text is the end id alone. Null ids come first; repeated rows follow one another,
    rows with equal ids in order of text; a very long text is one block with checkpoints. Other columns are not
    read; an empty table gives files without rows.
    """
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)
    tokens = materialize(tokenize(docs, tokenizer, id_col, text_col), "ids")
    counts = store(count_ids(tokens, vocabulary).coalesce(1), f"{path}/counts")
    parts = tokens.groupBy("part").agg(F.sum("n").alias("n"))
    store(parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")), f"{path}/parts")
    store(encode_blocks(tokens, table_of(counts)), f"{path}/blocks")
    discard(tokens)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    counts, parts, blocks = (spark.read.parquet(f"{path}/{name}") for name in ("counts", "parts", "blocks"))
    rows = decode_blocks(blocks, table_of(counts)).join(parts, "part")
    return rows.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``read_files`` gives of the files that ``write_files`` has written to the shared folder."""
    path = folder(docs.sparkSession, "tokens")
    write_files(docs, tokenizer, path, id_col, text_col)
    return read_files(docs.sparkSession, path)


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
