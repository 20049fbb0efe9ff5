"""Byte-level BPE of whole texts: overlapping chunks, cut where their pre-tokens agree, and back to bytes."""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.llm.common import frugal, pick

#: Characters of a chunk before its overlap with the next one, and of that overlap.
CHUNK, OVERLAP = 1 << 16, 1 << 11
#: Characters that the pattern may look at behind a pre-token; boundaries nearer to a chunk's cut end don't count.
LOOK_AHEAD = 8
_codecs: dict[tuple[str, str], tuple] = {}


def codec(ranks_path: str, pattern: str):
    """The encoding of a rank file and the bytes of each id, once for each worker."""
    if (ranks_path, pattern) not in _codecs:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        back = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            back[i] = piece
        _codecs[ranks_path, pattern] = (encoding, back)
    return _codecs[ranks_path, pattern]


def encode_text(text: str, ranks_path: str, pattern: str) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers."""
    return codec(ranks_path, pattern)[0].encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def boundaries(text: str, pattern: str, start: int, low: int, high: int) -> list[int]:
    """Ends of pre-tokens in ``[low, high]`` of the whole text, for a chunk that begins at ``start``.

    Only those behind a character that isn't white space: what the pattern does with white space
    depends on what follows it, so a cut there could change the pre-tokens before the cut.
    """
    import regex

    found = []
    for m in regex.finditer(pattern, text):
        end = m.end() + start
        if end > high:
            break
        if end >= low and not text[m.end() - 1].isspace():
            found.append(end)
    return found


def _pieces(docs: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """``key, part, doc_id, text``: long texts in pieces that begin and end between two pre-tokens."""

    def cut(batches):
        for batch in batches:
            for key, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = []
                for k, start in enumerate(range(0, len(text), chunk)):
                    part = text[start : start + chunk + overlap]
                    end = start + len(part)
                    last = len(text) if end == len(text) else end - LOOK_AHEAD
                    left = boundaries(part, pattern, start, start + 1, start + overlap) if k else []
                    right = boundaries(part, pattern, start, start + chunk + 1, last) if end < len(text) or len(part) > chunk else []
                    rows.append((key, k, doc_id, start, part, left, right))
                for i in range(0, len(rows), 64):
                    columns = list(zip(*rows[i : i + 64], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)

    def stitch(pdf):
        pdf = pdf.sort_values("k")
        first, last = pdf.iloc[0], pdf.iloc[-1]
        text, end = first["text"], first["start"] + len(first["text"])
        parts = [text]
        for start, more in zip(pdf["start"].iloc[1:], pdf["text"].iloc[1:], strict=True):
            parts.append(more[end - start :])
            end = max(end, start + len(more))
        text = "".join(parts)
        begin = int(first["sync"]) if first["k"] else 0
        stop = end if np.isnan(last["next_sync"]) else int(last["next_sync"])
        out = pdf.iloc[:1][["key", "k", "doc_id"]].copy()
        out["text"] = [text[begin - int(first["start"]) : stop - int(first["start"])]]
        return out

    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["key", "k", "doc_id", "start", "text", "left", "right"]
    kinds = [pa.int64(), pa.int32(), pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    chunks = docs.mapInArrow(frugal(cut), f"key long, k int, doc_id {id_type}, start long, text string, left array<long>, right array<long>")
    w = Window.partitionBy("key").orderBy("k")
    # where a chunk and the one before agree; null if they don't, then both stay in one piece
    synced = chunks.withColumn("sync", F.array_min(F.array_intersect("left", F.lag("right").over(w)))).drop("left", "right")
    synced = synced.withColumn("run", F.sum(F.when(F.col("sync").isNotNull(), 1).otherwise(0)).over(w)).withColumn("next", F.lead("sync").over(w))
    runs = synced.select("key", "run", "k", "doc_id", "start", "text", F.col("sync").cast("double").alias("sync"), F.col("next").cast("double").alias("next_sync"))
    return runs.groupBy("key", "run").applyInPandas(stitch, f"key long, k int, doc_id {id_type}, text string")


def encode(docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, ids``: the ids of each whole text as little-endian unsigned 32-bit integers.

    A text longer than ``chunk`` characters is cut into chunks that overlap; each chunk finds its
    pre-tokens alone, neighbours are cut apart at the first pre-token boundary that both have in their
    overlap, and the pieces are encoded in parallel. The pattern has no memory, so behind a common
    boundary both would go on alike. Chunks that never agree (one endless pre-token) stay in one piece.
    Null and empty texts have no ids; every row is a document, also repeated ones and those with a null id.
    """
    if not 0 < overlap < chunk:
        raise ValueError("the overlap must be shorter than a chunk")
    rows = pick(docs, doc_id=doc_id, text=text).withColumn("text", F.coalesce("text", F.lit("")))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def whole(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [encode_text(x, ranks_path, pattern) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    def piece(batches):
        for batch in batches:
            ids = [encode_text(x, ranks_path, pattern) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(ids, pa.binary())], ["key", "k", "doc_id", "ids"])

    def joined(pdf):
        pdf = pdf.sort_values("k")
        out = pdf.iloc[:1][["doc_id"]].copy()
        out["ids"] = [b"".join(pdf["ids"])]
        return out

    short = rows.where(F.length("text") <= chunk).mapInArrow(frugal(whole), f"doc_id {id_type}, ids binary")
    long = rows.where(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    pieces = _pieces(long, pattern, chunk, overlap).mapInArrow(frugal(piece), f"key long, k int, doc_id {id_type}, ids binary")
    return short.unionByName(pieces.groupBy("key").applyInPandas(joined, f"doc_id {id_type}, ids binary"))


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, bytes``: the bytes of the ids, one after another."""
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        back = codec(ranks_path, pattern)[1]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                data = [b"".join(map(back.__getitem__, np.frombuffer(x.as_py(), "<u4").tolist())) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(data, pa.binary())], ["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(frugal(run), f"doc_id {id_type}, ids binary, bytes binary")
