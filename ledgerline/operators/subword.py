"""Label ids by a subword tokenizer (T6, T7, I2): the vocabulary file of a public tokenizer plus the format's own tokens.

``Subwords.load`` reads a vocabulary file (``*.json`` of the tokenizers library, ``*.model`` of
sentencepiece) through Spark, so it may lie in any store. Tokens of the format that the vocabulary lacks get
the ids after it, in order (T6). A text is cut at those and at the vocabulary's own markers among the format's tokens (of
several that start at one place, at the longest); what lies between is cut into subwords by the library. Texts travel in Arrow batches, whose
stretches are encoded about a megabyte at a time, and each Python worker parses the vocabulary once.
Byte-level vocabularies with the usual word pattern never join what stands before white space with what follows,
so there a text is cut before white space, each distinct piece is encoded once, and a worker keeps the ids of recent pieces.

A NULL text has NULL labels, the empty text none but the padding.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import EOS_TOKEN
from .sequence import IGNORE_ID, MAX_LENGTH, SEP, vocabulary

MAX_FILE = 64 << 20  # bytes of a vocabulary file, which is broadcast
CALL_CHARS = 1 << 20  # of the texts of one call, but for a longer text: what the library returns is far larger than the text
PIECES_AT_ONCE, IDS_AT_ONCE = 1 << 12, 1 << 16  # of one call of the library, which returns about a kilobyte for each; ids decoded at once
KEPT_PIECES, KEPT_CHARS = 1 << 17, 64  # pieces whose ids a worker keeps, and the longest such piece
# Cut where a character that is no white space in any sense precedes white space of ASCII.
PIECE = re.compile(r"\s*+\S++(?:(?![ \t\n\r\f\v])\s++\S*+)*+|\s++")
CUT = re.compile(r"(?<=\S)(?=[ \t\n\r\f\v])")


@lru_cache(maxsize=4)
def _kept(kind: str, content: bytes) -> dict[str, list[int]] | None:
    """Ids of pieces that this worker has met; None where a vocabulary may join words with white space after them."""
    if kind != "json":
        return None
    told = json.loads(content)
    words = told.get("pre_tokenizer") or {}
    apart = (words.get("type") == "ByteLevel" and words.get("use_regex", True) and not words.get("add_prefix_space", True)
             and not any(told.get(k) for k in ("normalizer", "truncation", "padding"))
             and all(t["special"] for t in told.get("added_tokens", ())))
    return {} if apart else None


def _ids_by_pieces(known, kept: dict[str, list[int]], texts: list[str]) -> list[list[int]]:
    """Ids of each text from those of its pieces; a long text goes stretch by stretch."""

    def some(stretches: list[str]) -> list[list[int]]:
        pieces = [PIECE.findall(s) for s in stretches]
        new = list(set(chain.from_iterable(pieces)).difference(kept))
        for at in range(0, len(new), PIECES_AT_ONCE):
            few = new[at:at + PIECES_AT_ONCE]
            kept.update(zip(few, (e.ids for e in known.encode_batch_fast(few, add_special_tokens=False))))
        out = [list(chain.from_iterable(map(kept.__getitem__, row))) for row in pieces]
        if len(kept) > KEPT_PIECES:
            kept.clear()
        else:
            for piece in new:
                if len(piece) > KEPT_CHARS:
                    del kept[piece]
        return out

    if sum(map(len, texts)) <= 2 * CALL_CHARS:
        return some(texts)
    out = []
    for text in texts:
        ids, at = [], 0
        while at < len(text):
            end = CUT.search(text, at + CALL_CHARS)
            end = end.start() if end else len(text)
            ids += some([text[at:end]])[0]
            at = end
        out.append(ids)
    return out


def _cut(rows: pa.Array, sizes: pa.Array, most: int) -> Iterator[pa.Array]:
    """``rows`` in stretches whose sizes come to about ``most``; a larger row is a stretch of its own."""
    ends, at = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False)), 0
    while at < len(rows):
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")) - at)
        yield rows.slice(at, n)
        at += n


@lru_cache(maxsize=4)
def _bytes_of(kind: str, content: bytes, tokens: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(bytes of all tokens, each id's start in them, its length) of a byte-level vocabulary, where a text's bytes are those
    of its tokens in a row; None for others. Ids without a token have no bytes."""
    if kind != "json" or (json.loads(content).get("decoder") or {}).get("type") != "ByteLevel":
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values: bytes that stand for themselves
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
    size = _library(kind, content).get_vocab_size()
    entries = {i: t for t, i in _library(kind, content).get_vocab().items()}
    found = {i: bytes(map(byte_of.__getitem__, t)) if set(t) <= byte_of.keys() else t.encode() for i, t in entries.items()}
    found |= {i: t.encode() for i, t in tokens}
    rows = [found.get(i, b"") for i in range(max(size, *found) + 1)]
    lengths = np.array([len(r) for r in rows], np.int64)
    return np.frombuffer(b"".join(rows), np.uint8), np.cumsum(lengths) - lengths, lengths


def _joined(table: tuple[np.ndarray, np.ndarray, np.ndarray], rows: pa.ListArray) -> pa.Array | None:
    """The text of each row of ids from its tokens' bytes; None if some row's aren't valid UTF-8."""
    held, starts, lengths = table
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(rows).fill_null(0).to_numpy(zero_copy_only=False))])
    ids = rows.flatten().to_numpy(zero_copy_only=False)
    ids = np.where((ids >= 0) & (ids < len(lengths)), ids, len(lengths))  # others have no bytes
    starts, lengths = np.append(starts, 0), np.append(lengths, 0)
    out = []
    for at in range(0, len(ids), IDS_AT_ONCE):
        some = ids[at:at + IDS_AT_ONCE]
        n = lengths[some]
        out.append(held[np.arange(n.sum()) + np.repeat(starts[some] - (np.cumsum(n) - n), n)])
    data = np.concatenate(out) if out else np.zeros(0, np.uint8)
    offsets = np.concatenate([[0], np.cumsum(lengths[ids])])[ends].astype(np.int32)
    valid = pc.is_valid(rows)
    found = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    try:
        return pc.if_else(valid, found.cast(pa.string()), pa.scalar(None, pa.string()))
    except pa.ArrowInvalid:
        return None


@lru_cache(maxsize=4)
def _library(kind: str, content: bytes):
    if kind == "json":
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        t = Tokenizer.from_buffer(content)
        t.encode_special_tokens = True  # a special token's string in a text is text
        return t
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=content)


@dataclass
class Subwords:
    """A subword vocabulary with added tokens.

    ``added`` maps the tokens that a text is cut at to their ids, ``held`` the others, which are ordinary entries of the vocabulary.
    """

    kind: str
    shared: object  # broadcast content of the vocabulary file
    base_size: int
    added: dict[str, int]
    held: dict[str, int]
    new_tokens: list[str]

    @classmethod
    def load(cls, spark: SparkSession, path: str, tokens: list[str] | None = None) -> Subwords:
        """Tokens (the format's vocabulary, if None) that the file lacks are numbered from its size on, in order."""
        kind = path.rsplit(".", 1)[-1]
        if kind not in ("json", "model"):
            raise ValueError(f"{path}: a vocabulary file ends in .json or .model")
        file = spark.read.format("binaryFile").load(path)
        size = file.select("length").first()["length"]
        if size > MAX_FILE:
            raise ValueError(f"{path}: {size} bytes are no vocabulary file to broadcast")
        content = bytes(file.select("content").first()["content"])
        known = _library(kind, content)
        if kind == "json":
            base, number, marker = known.get_vocab_size(), known.token_to_id, known.get_added_tokens_decoder().__contains__
        else:
            base, marker = known.get_piece_size(), known.is_control
            number = lambda t: known.piece_to_id(t) if known.id_to_piece(known.piece_to_id(t)) == t else None
        added, held, new = {}, {}, []
        for token in dict.fromkeys([*vocabulary(), SEP, EOS_TOKEN] if tokens is None else tokens):
            there = number(token)
            if there is None:
                added[token] = base + len(new)
                new.append(token)
            else:
                (added if marker(there) else held)[token] = there
        return cls(kind, spark.sparkContext.broadcast(content), base, added, held, new)

    @property
    def size(self) -> int:
        return self.base_size + len(self.new_tokens)

    def ids(self, text: Column) -> Column:
        """Token ids of a text, none added."""
        kind, shared, added = self.kind, self.shared, self.added
        pattern = "(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")" if added else None

        @F.arrow_udf("array<int>")
        def run(texts: pa.Array) -> pa.Array:
            known = _library(kind, shared.value)
            out = [encoded(known, rows.to_pylist()) for rows in _cut(texts, pc.binary_length(texts), CALL_CHARS)]
            return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))

        def encoded(known, texts: list) -> pa.Array:
            """Ids of each text; what lies between the tokens of all is encoded once for each distinct stretch."""
            cut = [() if t is None else re.split(pattern, t) if pattern else (t,) for t in texts]  # odd ones are tokens
            between = list({part for parts in cut for part in parts[::2]})
            kept = _kept(kind, shared.value)
            if kept is not None:
                found = _ids_by_pieces(known, kept, between)
            elif kind == "json":
                found = [e.ids for e in known.encode_batch_fast(between, add_special_tokens=False)]
            else:
                found = known.encode(between, num_threads=1) if between else []
            ids = dict(zip(between, found)) | {t: [i] for t, i in added.items()}
            rows = [list(map(ids.__getitem__, parts)) for parts in cut]
            ends = np.cumsum([0] + [sum(map(len, row)) for row in rows])
            flat = np.fromiter(chain.from_iterable(chain.from_iterable(rows)), np.int32, ends[-1])
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array([t is None for t in texts]))

        return run(text)

    def label_ids(self, df: DataFrame, seq: str, max_length: int = MAX_LENGTH) -> DataFrame:
        """``df`` with labels (cut at ``max_length``, padded with IGNORE_ID), n_tokens_full and truncated."""
        df = df.withColumn("_ids", self.ids(F.col(seq))).withColumn("n_tokens_full", F.size("_ids"))
        cut = F.slice("_ids", 1, max_length)
        labels = F.concat(cut, F.array_repeat(F.lit(IGNORE_ID), F.lit(max_length) - F.size(cut)))
        return df.withColumn("labels", labels).withColumn("truncated", F.col("n_tokens_full") > max_length).drop("_ids")

    def decode(self, ids: Column) -> Column:
        """Ids back to text; ignored positions are left out. Exact for byte-level vocabularies, up to white space for others."""
        kind, shared = self.kind, self.shared
        token = {i: t for t, i in self.added.items()}
        tokens = np.array(sorted(token), np.int64)

        @F.arrow_udf("string")
        def run(rows: pa.Array) -> pa.Array:
            known = _library(kind, shared.value)
            text = lambda some: (known.decode(some, skip_special_tokens=False) if kind == "json" else known.decode(some)) if some else ""

            def one(row) -> str | None:
                if row is None:
                    return None
                row = np.array(row, np.int64)
                row = row[row >= 0]
                at = np.flatnonzero(np.isin(row, tokens))
                if not len(at):
                    return text(row.tolist())
                between = [text(part.tolist()) for part in np.split(row, np.repeat(at, 2) + np.tile([0, 1], len(at)))[::2]]
                return between[0] + "".join(token[i] + after for i, after in zip(row[at].tolist(), between[1:]))

            table = _bytes_of(kind, shared.value, tuple(token.items()))
            out = []
            for some in _cut(rows, pc.list_value_length(rows), CALL_CHARS):
                whole = _joined(table, some) if table and not some.flatten().null_count else None
                out.append(pa.array(map(one, some.to_pylist()), pa.string()) if whole is None else whole)
            return pa.concat_arrays(out) if out else pa.array([], pa.string())

        return run(F.array_remove(ids, F.lit(IGNORE_ID)))  # so the padding isn't sent

    def tokens_df(self, spark: SparkSession) -> DataFrame:
        """(token, token_id, is_new) of the format's tokens: a row for each."""
        new = set(self.new_tokens)
        return spark.createDataFrame([(t, i, t in new) for t, i in (self.added | self.held).items()], "token string, token_id int, is_new boolean")
