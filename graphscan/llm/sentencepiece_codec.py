"""Operator 8: SentencePiece models on the tokenizers library.

The model file's protobuf is parsed here (no protobuf package needed): pieces
with scores and types, trainer and normaliser settings.  From these a
tokenizers-library tokenizer is rebuilt: the normaliser's character map, the
dummy prefix and white-space marker, unigram scores (or, for a BPE model, its
merges in score order), byte fallback and the decoder.

Encoding.  No piece of such models holds the marker after another character,
so a text is cut before each marker that follows one, and each part has its
own best segmentation; for a model where that does not hold, texts are encoded
whole.  The distinct parts of a slice are encoded in one multithreaded batch
call (threads as ``RAYON_NUM_THREADS`` allows, 2 if it is not set), kept in a
bounded cache of the worker, and compared there with the SentencePiece
library's own result (``verify``); a text with a part that this library never
sees alone (a marker with nothing behind it) is compared whole.

Cases.  A null or empty text has no ids and decodes to the empty text; texts
of any length are encoded whole; repeated documents are each reported, null
doc_ids included; an empty table gives no rows; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import PieceCache, bounded_batches, code_points, library_threads, map_arrow, once, pieces_of, ragged, string_slices

MARK = "▁"
#: Bytes of text encoded at once.
SLICE = 1_000_000
#: Marks of parts: not as the SentencePiece library has them; not to be compared alone.
UNLIKE, OPEN = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protobuf message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


def parse_model(data: bytes) -> dict:
    """pieces [(piece, score, type)], model_type (1 unigram, 2 BPE), byte_fallback, normaliser settings."""
    model = {"pieces": [], "model_type": 1, "byte_fallback": False, "charsmap": b"", "dummy_prefix": True, "remove_extra": True, "escape": True, "suffix": False}
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    (score,) = struct.unpack("<f", v)
                elif n == 3:
                    kind = v
            model["pieces"].append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    model["model_type"] = v
                elif n == 24:
                    model["suffix"] = bool(v)
                elif n == 35:
                    model["byte_fallback"] = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                key = {2: "charsmap", 3: "dummy_prefix", 4: "remove_extra", 5: "escape"}.get(n)
                if key:
                    model[key] = v if key == "charsmap" else bool(v)
    return model


def build_tokenizer(model: dict):
    """The tokenizers-library tokenizer of a parsed model."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    pieces = model["pieces"]
    unknown = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
    if model["model_type"] == 1:
        core = models.Unigram([(p, s) for p, s, _ in pieces], unk_id=unknown, byte_fallback=model["byte_fallback"])
    elif model["model_type"] == 2:
        vocabulary = {p: i for i, (p, _, _) in enumerate(pieces)}
        usable = {p for p, _, kind in pieces if kind in (NORMAL, USER_DEFINED)}
        merges = []
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == NORMAL and len(piece) > 1:
                halves = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in usable and piece[k:] in usable]
                merges += [(-score, i, vocabulary[a], vocabulary[b], a, b) for a, b in halves]
        merges.sort()
        core = models.BPE(vocabulary, [(m[4], m[5]) for m in merges], unk_token=pieces[unknown][0], fuse_unk=True, byte_fallback=model["byte_fallback"])
    else:
        raise ValueError("only unigram and BPE models")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model["charsmap"])] if model["charsmap"] else []
    if model["remove_extra"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model["dummy_prefix"]:
        steps.append(normalizers.Prepend(" "))
    if model["escape"]:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tail = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(tail + ([decoders.Strip(" ", 1, 0)] if model["dummy_prefix"] else []))
    return tokenizer


class Codec:
    """Encodes and decodes batches of texts with one model file."""

    #: Distinct parts kept per worker (about 40 bytes each).
    CACHE = 400_000

    def __init__(self, path: str, verify: bool = False):
        library_threads()
        with open(path, "rb") as source:
            data = source.read()
        self.model = parse_model(data)
        self.tokenizer = build_tokenizer(self.model)
        self.by_part = self.model["escape"] and not self.model["suffix"] and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.model["pieces"] if kind in (NORMAL, USER_DEFINED))
        self._prepare = self.tokenizer.normalizer
        self.tokenizer.normalizer = None
        self.reference = None
        if verify:
            import sentencepiece

            self.reference = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.cache = PieceCache(self.CACHE)
        forms, self.is_byte = [], np.zeros(len(self.model["pieces"]), bool)
        for i, (piece, _, kind) in enumerate(self.model["pieces"]):
            self.is_byte[i] = kind == BYTE
            shown = b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode("utf-8")
            forms.append(bytes([int(piece[3:5], 16)]) if kind == BYTE else shown)
        self.form = np.frombuffer(b"".join(forms), np.uint8)
        self.form_size = np.array([len(f) for f in forms], np.int64)
        self.form_start = np.cumsum(self.form_size) - self.form_size

    def normalise(self, text: str) -> str:
        """The text as the model sees it, marker included."""
        plain = not self.model["charsmap"] and not self.model["remove_extra"]
        if plain and self.model["escape"]:
            return (MARK if self.model["dummy_prefix"] and text else "") + text.replace(" ", MARK)
        return self._prepare.normalize_str(text) if text else ""

    def _cuts(self, cps: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Edges between the parts of normalised texts."""
        edge = np.zeros(len(cps) + 1, bool)
        edge[offsets] = True
        if self.by_part and len(cps):
            mark = cps == ord(MARK)
            edge[1:-1] |= mark[1:] & ~mark[:-1]
        return np.flatnonzero(edge)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids one after another, ids per text, and parts per text that differ from the SentencePiece library's."""
        normal = [self.normalise(t) for t in texts]
        whole = "".join(normal)
        cps = code_points(whole)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in normal])))
        edges = self._cuts(cps, offsets)
        # a text's ids lie between the ids of its first and of the next text's first part
        entries = self.cache.lookup(pieces_of(whole, cps, edges), self._fresh) if len(edges) > 1 else np.empty(0, np.int64)
        ids, counts = self.cache.ids(entries)
        first = np.searchsorted(edges[:-1], offsets)
        bounds = np.concatenate(([0], np.cumsum(counts)))[first]
        flag = self.cache.flag[entries]
        wrong = np.diff(np.concatenate(([0], np.cumsum(flag == UNLIKE)))[first])
        for i in np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(flag == OPEN)))[first])).tolist():
            wrong[i] += self.reference.encode(texts[i]) != ids[bounds[i] : bounds[i + 1]].tolist()
        return ids.astype(np.int32), np.diff(bounds).astype(np.int64), wrong.astype(np.int64)

    def _fresh(self, unseen: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = unseen.cast(pa.string()).to_pylist()
        got = [x.ids for lo in range(0, len(parts), 20_000) for x in self.tokenizer.encode_batch_fast(parts[lo : lo + 20_000], add_special_tokens=False)]
        flags = np.zeros(len(parts), np.int8)
        if self.reference is not None:
            prefix = self.model["dummy_prefix"]
            for i, part in enumerate(parts):
                if prefix and not (part.startswith(MARK) and len(part) > 1):
                    flags[i] = OPEN
            at = np.flatnonzero(flags == 0).tolist()
            for i, own in zip(at, self.reference.encode([parts[i][prefix:].replace(MARK, " ") for i in at], num_threads=1)):
                if own != got[i]:
                    flags[i] = UNLIKE
        sizes = np.array([len(x) for x in got], np.int64)
        return np.fromiter((i for x in got for i in x), np.uint32, int(sizes.sum())), sizes, flags

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of ids: pieces' bytes in a row, the marker a space, the dummy prefix dropped."""
        length = self.form_size[ids]
        data = self.form[ragged(self.form_start[ids], length)].tobytes()
        ends = np.concatenate(([0], np.cumsum(length)))[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        drop = self.model["dummy_prefix"]
        out = []
        for a, b in zip(ends, ends[1:]):
            raw = data[a + 1 : b] if drop and data[a : a + 1] == b" " and b > a else data[a:b]
            out.append(raw.decode("utf-8", "replace"))
        return out


def encode_documents(documents: DataFrame, model_path: str, verify: bool = True) -> DataFrame:
    """Per document: ids, their number, byte-fallback ids, decoded text's CRC and whether it restores the normalised text, parts unlike the SentencePiece library's."""
    bounded_batches(documents.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = once(("codec", model_path, verify), lambda: Codec(model_path, verify))
        ids, sizes, wrong, fallback, crc, same = [], [], [], [], [], []
        for _, _, texts in string_slices(batch.column(1), SLICE):
            got, n, bad = codec.encode(texts)
            bounds = np.concatenate(([0], np.cumsum(n)))
            fallback.append(np.diff(np.concatenate(([0], np.cumsum(codec.is_byte[got])))[bounds]))
            for text, back in zip(texts, codec.decode(got, n)):
                crc.append(zlib.crc32(back.encode()))
                same.append(back == text or MARK + back.replace(" ", MARK) == codec.normalise(text))
            ids.append(got)
            sizes.append(n)
            wrong.append(bad)
        n = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32), pa.int32()))
        flat = lambda x: pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), lists, pa.array(n, pa.int64()), flat(fallback), pa.array(crc, pa.int64()), pa.array(same, pa.bool_()), flat(wrong)],
            ["doc_id", "ids", "n_tokens", "n_fallback", "decoded_crc32", "round_trip", "n_unlike"],
        )

    schema = "doc_id long, ids array<int>, n_tokens long, n_fallback long, decoded_crc32 long, round_trip boolean, n_unlike long"
    return map_arrow(documents.selectExpr("cast(doc_id as long) as doc_id", "text"), work, schema)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""
    bounded_batches(encoded.sparkSession)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = once(("codec", model_path, False), lambda: Codec(model_path))
        lists = [x or [] for x in batch.column(1).to_pylist()]
        texts = codec.decode(np.array([i for x in lists for i in x], np.int64), np.array([len(x) for x in lists], np.int64)) if lists else []
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.selectExpr("cast(doc_id as long) as doc_id", "ids"), work, "doc_id long, text string")
