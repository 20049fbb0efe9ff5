"""Token ids of whole texts from a public tokenizer file, computed where the documents lie."""

from __future__ import annotations

import codecs
import json
import os
import re
from array import array
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrylake.llm.common import frugal, pick

#: Pieces that a worker remembers, half of them since it forgot others; a memory bound, without effect on results.
REMEMBERED = 1_000_000
#: Bytes of text that are split at once, but for a longer text; a memory bound.
AT_ONCE = 4 << 20
_encoders: dict[tuple[str, bool], "PieceEncoder"] = {}
#: Pre-tokens of the byte-level pattern in texts of these characters alone, the first one with the space before it: letters,
#: digits, other signs of ASCII but those of contractions and of names of special tokens, and breaks but for the last of a run.
_KINDS = ["A-Za-zÀ-ÖØ-öø-ſЀ-ҁҊ-ԯ", "0-9", r"!-&(-/:;=?@\[-`{}~"]
_PRE_TOKENS = re.compile("|".join([*(f" ?[{x}]+" for x in _KINDS), r"\n+(?=\n)|\n", rf" ?[^{''.join(_KINDS)}\n ]+"]))
_PLAIN = frozenset(re.findall(rf"[{''.join(_KINDS)}\n]", "".join(map(chr, range(0x530)))))


def byte_letters() -> str:
    """The letter of each byte in the byte-level alphabet."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


_LETTERS = byte_letters()


def _spans_of(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids of all spans, one after another."""
    ends = np.cumsum(sizes)
    return ids[np.repeat(starts - ends + sizes, sizes) + np.arange(int(sizes.sum()))]


class PieceEncoder:
    """A ``tokenizers`` file, applied piece by piece with a memory of pieces seen.

    A byte-level tokenizer splits text before each space that stands between two characters which are
    no white space, whatever is around; so the ids of a text are the ids of the pieces between such
    spaces, one after another. A text in which a space touches other white space goes to the tokenizer
    as a whole. Pre-tokens of a piece of plain characters go to the tokenizer's model one by one, each
    one once; other pieces go through the whole tokenizer.
    """

    def __init__(self, path: str, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        size = self.tokenizer.get_vocab_size(True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        # ids of tokens that begin with a space, in the letters of the byte-level alphabet
        self._begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        # ids of pre-tokens, and behind two spaces of pieces of other than plain characters, and those that were met before the
        # last of them were forgotten; no bytes for a run of other characters, which has no ids of its own
        self._after_space: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._plain = self._is_plain(json.loads(self.tokenizer.to_str()), special_as_text)
        self._model = self.tokenizer.model

    @staticmethod
    def _is_plain(made: dict, special_as_text: bool) -> bool:
        """Whether the tokenizer gives its model the byte-level pre-tokens of the text as it is, and nothing is added to the ids."""
        before = made["pre_tokenizer"] or {}
        return (
            made["normalizer"] is None and made["truncation"] is None and made["padding"] is None
            and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
            and made["model"].get("type") == "BPE" and not made["model"].get("dropout")
            and all(x["special"] and special_as_text for x in made["added_tokens"])
        )

    def _of_model(self, pre_token: str) -> bytes:
        """Ids of one pre-token of plain characters."""
        if pre_token.isascii() and pre_token[0] == " ":
            pre_token = "\u0120" + pre_token[1:]
        elif not pre_token.isascii() or pre_token[0] == "\n":
            pre_token = codecs.charmap_decode(pre_token.encode("utf-8"), "strict", _LETTERS)[0]
        return array(self._code, [x.id for x in self._model.tokenize(pre_token)]).tobytes()

    def _ids_of_plain(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which pieces after a space are of plain characters, the ids of those by their pre-tokens, and how many each one has."""
        plain = np.array([bool(x) and x[0] > " " and x[-1] > " " for x in pieces], bool)
        parts = _PRE_TOKENS.findall("".join([" " + x for x in compress(pieces, plain.tolist())]))
        known, before = self._after_space, self._before
        for x in set(parts).difference(known):
            ids = before.get(x)
            if ids is None:
                ids = self._of_model(x) if x[-1] in _PLAIN else b""
            known[x] = ids
        if not parts:
            return plain, np.zeros(0, self.dtype), np.zeros(0, np.int64)
        found = list(map(known.__getitem__, parts))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        firsts = np.flatnonzero(np.array([x[0] == " " for x in parts], bool))
        fits, own = np.minimum.reduceat(sizes, firsts) > 0, np.add.reduceat(sizes, firsts)
        ids = np.frombuffer(b"".join(found), self.dtype)
        if not fits.all():
            plain[np.flatnonzero(plain)[~fits]] = False
            ids, own = ids[np.repeat(fits, own)], own[fits]
        return plain, ids, own

    def _ids_of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different pieces after a space, where those of each piece start, and their number, -1 for pieces that only whole texts have."""
        if len(self._after_space) > REMEMBERED // 2:
            self._before, self._after_space = self._after_space, {}
        starts, sizes = np.zeros(len(pieces), np.int64), np.full(len(pieces), -1)
        plain, ids = np.zeros(len(pieces), bool), np.zeros(0, self.dtype)
        if self._plain:
            plain, ids, own = self._ids_of_plain(pieces)
            sizes[plain], starts[plain] = own, np.cumsum(own) - own
        others = [i for i in np.flatnonzero(~plain).tolist() if self._apart(pieces[i])]
        if others:
            known, before = self._after_space, self._before
            names = ["  " + pieces[i] for i in others]
            known.update((x, before[x]) for x in names if not known.get(x) and before.get(x))
            new = [x for x in names if not known.get(x)]
            known.update(zip(new, self._ids_after_space([x[2:] for x in new]), strict=True))
            found = [known[x] for x in names]
            own = np.array([len(x) // self.dtype.itemsize for x in found], np.int64)
            sizes[others], starts[others] = own, len(ids) + np.cumsum(own) - own
            ids = np.concatenate([ids, np.frombuffer(b"".join(found), self.dtype)])
        return ids, starts, sizes

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in found]

    def _ids_after_space(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece with a space before it, for pieces without a space inside.

        Many go to the tokenizer as one text; the tokens that begin with a space tell them apart.
        """
        out: list[bytes] = []
        for at in range(0, len(pieces), 4096):
            part = pieces[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            starts = np.flatnonzero(self._begins[ids])
            if len(starts) == len(part):
                ends = [*starts[1:].tolist(), len(ids)]
                data, w = ids.tobytes(), self.dtype.itemsize
                out += [data[a * w : b * w] for a, b in zip(starts.tolist(), ends, strict=True)]
            else:
                out += self._ids([" " + x for x in part])
        return out

    @staticmethod
    def _apart(piece: str) -> bool:
        return bool(piece) and not (piece[0].isspace() or piece[-1].isspace() or piece[0] == "᠎" or piece[-1] == "᠎")

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where those of each text end; a null text has those of the empty text."""
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        split = pc.split_pattern(pc.fill_null(texts, ""), " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        names, nth = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        bounds -= bounds[0]
        heads = bounds[:-1]
        after_space = np.ones(len(nth), bool)
        after_space[heads] = False
        used = np.zeros(len(names), bool)
        used[nth[after_space]] = True
        starts, sizes = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        ids, starts[used], sizes[used] = self._ids_of_pieces(list(compress(names, used.tolist())))
        starts, sizes = starts[nth], sizes[nth]
        # first pieces, each one once, and as a whole the texts with pieces that aren't apart
        of_head = nth[heads].tolist()
        fits = np.array([self._apart(names[i]) for i in of_head]) | (np.diff(bounds) == 1)
        fits[np.searchsorted(bounds, np.flatnonzero((sizes < 0) & after_space), "right") - 1] = False
        whole = np.flatnonzero(~fits).tolist()
        alone = {i: k for k, i in enumerate(dict.fromkeys(compress(of_head, fits.tolist())))}
        found = self._ids([names[i] for i in alone]) + self._ids([texts[i].as_py() or "" for i in whole])
        which = np.zeros(len(heads), np.int64)
        which[fits] = [alone[i] for i in compress(of_head, fits.tolist())]
        which[~fits] = len(alone) + np.arange(len(whole))
        for i in whole:
            sizes[bounds[i] : bounds[i + 1]] = 0
        own = np.array([len(x) // self.dtype.itemsize for x in found], np.int64)
        sizes[heads], starts[heads] = own[which], (len(ids) + np.cumsum(own) - own)[which]
        ids = np.concatenate([ids, np.frombuffer(b"".join(found), self.dtype)])
        return _spans_of(ids, starts, sizes), np.cumsum(sizes)[bounds[1:] - 1]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as packed integers of ``dtype``."""
        ids, ends = self.encode_array(pa.array(texts, pa.large_string()))
        return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)]


def encoder(path: str, special_as_text: bool = True) -> PieceEncoder:
    """One encoder for each worker and file."""
    if (path, special_as_text) not in _encoders:
        _encoders[path, special_as_text] = PieceEncoder(path, special_as_text)
    return _encoders[path, special_as_text]


def _parts_of(batch: pa.RecordBatch):
    """The rows of a batch, at most ``AT_ONCE`` bytes of its second column or one longer text, and 4,096 rows, at a time."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, "right")))
        end = min(end, at + 4096)
        yield batch.slice(at, end - at)
        at = end


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int | None = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, counts``: the ids of each whole text, ``end_id`` behind them, as compressed 32-bit integers.

    Null and empty texts have the end id alone. Every row is a document, also repeated ones and those
    with a null id. The last row of a task is no document: it has nulls, and in ``counts`` how often each id
    occurs in the task's rows (``documents`` and ``counted`` tell the two apart).
    """

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        encode = encoder(tokenizer_path)
        tail = b"" if end_id is None else np.array([end_id], encode.dtype).tobytes()
        width, first = encode.dtype.itemsize, bytes([encode.dtype.itemsize])
        total, kind = np.zeros(0, np.int64), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for part in _parts_of(batch):
                ids, ends = encode.encode_array(part.column(1))
                own = np.bincount(ids, minlength=max(len(total), 0 if end_id is None else end_id + 1))
                own[: len(total)] += total
                if end_id is not None:
                    own[end_id] += len(ends)
                total, data, ends = own, ids.tobytes(), ends * width
                packed = [first + pack.compress(data[a:b] + tail) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False)]
                n = (np.diff(ends, prepend=0) + len(tail)) // width
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(packed, pa.binary()), pa.nulls(len(n), pa.binary())], names)
        if len(total):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([pack.compress(total.tobytes())], pa.binary())], names)

    names = ["doc_id", "n_tokens", "ids", "counts"]
    rows = pick(docs, doc_id=doc_id, text=text)
    return rows.mapInArrow(frugal(run), "doc_id " + rows.schema["doc_id"].dataType.simpleString() + ", n_tokens long, ids binary, counts binary")


def documents(tokens: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids`` of a written token table."""
    return tokens.where("counts is null").drop("counts")


def counted(tokens: DataFrame) -> DataFrame:
    """``id, n`` over all rows of a written token table, from the counts of its tasks."""

    def run(batches):
        for batch in batches:
            for packed in batch.column(0):
                total = np.frombuffer(zstandard.decompress(packed.as_py()), np.int64)
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    found = tokens.where("counts is not null").select("counts").mapInArrow(frugal(run), "id long, n long")
    return found.groupBy("id").agg(F.sum("n").alias("n"))


def unpack_ids(packed: bytes) -> np.ndarray:
    """The ids of one row of a token table."""
    return np.frombuffer(zstandard.decompress(packed[1:]), f"<u{packed[0]}")
