"""Token-id files with canonical, length-limited Huffman codes from the counts of the whole corpus.

One file holds the documents of one range of ids, in ascending order:

    magic "TIDH0001"
    bits       every document's codes, each document from a whole byte on, highest bit first
    footer     NumPy arrays: symbols and code lengths; each document's id, null mark and number of ids;
               each block's first bit and number of ids
    trailer    place and size of the footer, magic

A block has ``BLOCK`` ids of one document, fewer at its end, and its first bit is its checkpoint, so
blocks decode independently and side by side with one table look-up for each id.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.llm.common import frugal, open_fs, partitions
from sentrylake.llm.tokens import unpack_ids

MAGIC = b"TIDH0001"
BLOCK = 512
#: Longest code in bits: the decoding table has 2**LIMIT entries, and more than 2**LIMIT ids in use are refused.
LIMIT = 18
#: Ids that are packed or unpacked at once; a memory bound.
AT_ONCE = 1 << 18


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge); all counts are positive."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} different ids don't fit codes of {limit} bits")
    lengths = np.zeros(n, np.uint8)
    if n < 2:
        return lengths + 1
    order = np.argsort(counts, kind="stable")
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        weights = np.concatenate([leaves, packages])
        at = np.argsort(weights, kind="stable")
        levels.append(at < n)
        weights = weights[at]
        packages = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
    take, by_rank = 2 * n - 2, np.zeros(n, np.uint8)
    for leaf in reversed(levels):
        own = int(leaf[:take].sum())
        by_rank[:own] += 1
        take = 2 * (take - own)
    lengths[order] = by_rank
    return lengths


def canonical_codes(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the symbols by length, then by place, and the code of each symbol."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    for k in range(1, int(lengths.max(initial=0)) + 1):
        same = order[lengths[order] == k]
        code <<= k - before
        codes[same] = code + np.arange(len(same), dtype=np.uint64)
        code, before = code + len(same), k
    return order, codes


class Code:
    """A code for ids that occur: ``symbols`` ascending, and the length of each one's code."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        self.symbols, self.lengths = symbols.astype(np.uint32), lengths.astype(np.uint8)
        self.order, self.codes = canonical_codes(self.lengths)
        self.width = int(self.lengths.max(initial=1))

    @classmethod
    def from_counts(cls, symbols: np.ndarray, counts: np.ndarray, limit: int = LIMIT) -> Code:
        return cls(symbols, code_lengths(counts, limit))

    @cached_property
    def by_id(self) -> tuple[np.ndarray, np.ndarray]:
        """Length, 0 for ids without a code, and code by id."""
        size = int(self.symbols.max(initial=0)) + 1
        lengths, codes = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        lengths[self.symbols], codes[self.symbols] = self.lengths, self.codes
        return lengths, codes

    def pack(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Bits of documents of ``sizes`` ids each, the bytes of each, and the first bit of each id in its document."""
        lengths, codes = self.by_id
        if len(ids) and int(ids.max()) >= len(lengths):
            raise ValueError("an id has no code: the counts are not those of these documents")
        bits, code = lengths[ids], codes[ids]
        if len(ids) and not bits.min():
            raise ValueError("an id has no code: the counts are not those of these documents")
        ends = np.cumsum(sizes)
        total = np.concatenate([[0], np.cumsum(bits)])
        used = (total[ends] - total[ends - sizes] + 7) // 8
        base = np.cumsum(used) - used
        own = total[:-1] - np.repeat(total[ends - sizes], sizes)
        place = own + np.repeat(base * 8, sizes)
        # every code, moved to its place in the 64 bits in which it begins, and the rest of it, if any, in the next ones; bits
        # never overlap, so sums are unions
        word, room = place >> 6, 64 - (place & 63) - bits
        over = np.flatnonzero(room < 0)
        window = code << np.maximum(room, 0).astype(np.uint64)
        window[over] = code[over] >> (-room[over]).astype(np.uint64)
        size = int(used.sum())
        out = np.zeros(size // 8 + 2, np.uint64)
        if len(ids):
            firsts = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[firsts]] = np.add.reduceat(window, firsts)
            out[word[over] + 1] += code[over] << (64 + room[over]).astype(np.uint64)
        return out.astype(">u8").tobytes()[:size], used, own

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and length for each value of the next ``width`` bits."""
        lengths = self.lengths[self.order]
        times = np.left_shift(1, self.width - lengths.astype(np.int64))
        symbols, steps = np.repeat(self.symbols[self.order], times), np.repeat(lengths, times)
        rest = (1 << self.width) - len(symbols)  # a code of one symbol leaves half the table free
        return np.pad(symbols, (0, rest)), np.pad(steps, (0, rest), constant_values=1)

    def unpack(self, data: np.ndarray, first_bits: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Ids of independent blocks, decoded side by side; ``data`` has four spare bytes behind the last code."""
        symbols, steps = self.table
        out = np.zeros(int(sizes.sum()), np.uint32)
        if not len(out):
            return out
        windows = np.zeros(len(data) - 3, np.uint32)  # the 32 bits from each byte on
        for k in range(4):
            windows |= data[k : len(windows) + k].astype(np.uint32) << np.uint32(24 - 8 * k)
        order = np.argsort(-sizes, kind="stable")  # long blocks first, so that those not at their end stand in front
        at, place = first_bits[order].astype(np.int64), (np.cumsum(sizes) - sizes)[order]
        longest, shift = int(sizes.max()), np.uint32(32 - self.width)
        for n in np.searchsorted(-sizes[order], -np.arange(longest), "left").tolist():
            at, place = at[:n], place[:n]
            peek = windows[at >> 3] << (at & 7).astype(np.uint32) >> shift
            out[place] = symbols[peek]
            at += steps[peek]
            place += 1
        return out


def count_ids(tokens: DataFrame) -> DataFrame:
    """``id, n`` over all rows of a token table; tasks add up their own rows before the shuffle."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                own = np.bincount(unpack_ids(packed.as_py()))
                if len(own) > len(total):
                    total = np.pad(total, (0, len(own) - len(total)))
                total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    return tokens.select("ids").mapInArrow(frugal(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_of(counts: DataFrame, limit: int = LIMIT) -> Code:
    """The code of the whole corpus; the rows fetched are bounded by the vocabulary, hence by 2**limit."""
    rows = counts.orderBy("id").limit((1 << limit) + 1).toArrow()
    return Code.from_counts(rows["id"].to_numpy(), rows["n"].to_numpy(), limit)


class _Writer:
    """One file; ``close`` gives its row of the manifest."""

    def __init__(self, folder: str, code: Code):
        self.path = f"{folder}/ids-{uuid.uuid4().hex}.tidh"  # a new name for each attempt, so a lost task leaves no half file in use
        fs, at = open_fs(self.path)
        fs.create_dir(at.rpartition("/")[0], recursive=True)
        self.out, self.code = fs.open_output_stream(at), code
        self.out.write(MAGIC)
        self.bytes, self.n_tokens, self.docs, self.nulls, self.sizes = len(MAGIC), 0, [], [], []
        self.first_bits: list[np.ndarray] = []
        self.block_sizes: list[np.ndarray] = []

    def add(self, doc_ids: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        data, used, own = self.code.pack(ids, sizes)
        starts = np.cumsum(sizes) - sizes
        blocks = -(-sizes // BLOCK)
        nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        base = self.bytes + np.cumsum(used) - used
        self.first_bits.append(own[np.repeat(starts, blocks) + nth * BLOCK] + np.repeat(base, blocks) * 8)
        self.block_sizes.append(np.minimum(BLOCK, np.repeat(sizes, blocks) - nth * BLOCK).astype(np.uint16))
        self.docs += [0 if x is None else x for x in doc_ids]
        self.nulls += [x is None for x in doc_ids]
        self.sizes.append(sizes)
        self.n_tokens += len(ids)
        self.out.write(data)
        self.bytes += len(data)

    def close(self) -> tuple[str, int, int]:
        arrays = {
            "symbols": self.code.symbols, "lengths": self.code.lengths, "doc_ids": np.array(self.docs, np.int64),
            "nulls": np.array(self.nulls, bool), "sizes": np.concatenate([np.zeros(0, np.int64), *self.sizes]),
            "first_bits": np.concatenate([np.zeros(0, np.int64), *self.first_bits]),
            "block_sizes": np.concatenate([np.zeros(0, np.uint16), *self.block_sizes]),
        }
        np.savez_compressed(footer := io.BytesIO(), **arrays)
        self.out.write(footer.getvalue())
        self.out.write(struct.pack("<QQ", self.bytes, len(footer.getvalue())) + MAGIC)
        self.out.close()
        return self.path, len(self.docs), self.n_tokens


def write_files(tokens: DataFrame, code: Code, folder: str, file_bytes: int = 256 << 20) -> DataFrame:
    """Write a token table as files in ascending order of document id, and return the manifest.

    ``part, seq, path, n_docs, n_tokens``, in the order of the documents by ``part, seq``. Only files of
    tasks that ended well are in it. Null ids stand first; equal ids are ordered by their content. The
    manifest must be written before it is read twice: each evaluation writes its own files.
    """

    def run(batches):
        part, seq, writer = TaskContext.get().partitionId(), 0, None
        done = []
        for batch in batches:
            ids, names, sizes, n = [], [], [], 0
            for i, (doc_id, packed) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                ids.append(unpack_ids(packed.as_py()))
                names.append(doc_id)
                sizes.append(len(ids[-1]))
                n += sizes[-1]
                if n >= AT_ONCE or i + 1 == batch.num_rows:
                    writer = writer or _Writer(folder, code)
                    writer.add(names, np.concatenate(ids), np.array(sizes, np.int64))
                    ids, names, sizes, n = [], [], [], 0
                    if writer.bytes >= file_bytes:
                        done.append((part, seq, *writer.close()))
                        seq, writer = seq + 1, None
        if writer:
            done.append((part, seq, *writer.close()))
        columns = list(zip(*done, strict=True)) or [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(columns, kinds, strict=True)], ["part", "seq", "path", "n_docs", "n_tokens"])

    ordered = tokens.repartitionByRange(partitions(tokens), "doc_id").sortWithinPartitions("doc_id", "ids")
    return ordered.select("doc_id", "ids").mapInArrow(frugal(run), "part int, seq int, path string, n_docs long, n_tokens long")


def read_file(path: str) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Document ids, number of ids of each, and all their ids, for some documents of a file at a time."""
    fs, at = open_fs(path)
    with fs.open_input_file(at) as f:
        size = f.size()
        place, length = struct.unpack("<QQ", f.read_at(16, size - 24))
        if f.read_at(8, size - 8) != MAGIC or f.read_at(8, 0) != MAGIC:
            raise ValueError(f"{path} is no file of token ids, or was cut")
        x = dict(np.load(io.BytesIO(f.read_at(length, place))))
        code = Code(x["symbols"], x["lengths"])
        sizes, blocks = x["sizes"], -(-x["sizes"] // BLOCK)
        upto, block_end = np.cumsum(sizes), np.cumsum(blocks)
        i = 0
        while i < len(sizes):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] - sizes[i] + 4 * AT_ONCE, "right")))
            lo, hi = int(block_end[i] - blocks[i]), int(block_end[j - 1])
            if lo < hi:
                begin = int(x["first_bits"][lo]) // 8
                end = int(x["first_bits"][hi]) // 8 if hi < len(x["first_bits"]) else place
                data = np.frombuffer(f.read_at(end - begin, begin) + bytes(4), np.uint8)
                ids = code.unpack(data, x["first_bits"][lo:hi] - begin * 8, x["block_sizes"][lo:hi].astype(np.int64))
            else:
                ids = np.zeros(0, np.uint32)
            names = [None if null else int(v) for v, null in zip(x["doc_ids"][i:j], x["nulls"][i:j], strict=True)]
            yield names, sizes[i:j], ids
            i = j


def read_files(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens`` and ``ids`` from the files; with ``digest``, ``ids_crc32`` in place of the ids.

    ``start`` is the number of ids of all documents before, over all files.
    """
    import zlib

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for names, sizes, ids in read_file(path):
                    ends = np.cumsum(sizes)
                    parts = [ids[e - n : e] for e, n in zip(ends, sizes, strict=True)]
                    last = pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64()) if digest else pa.array([p.astype(np.int64) for p in parts], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(start + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
                    start += int(ends[-1])

    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    files = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    files = files.repartition(partitions(manifest), "path")
    return files.mapInArrow(frugal(run), "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>"))
