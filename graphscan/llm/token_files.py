"""Operator 9: token ids as files of patched frame-of-reference blocks.

Format.  The ids of a file are cut into blocks of 128.  A block stores its
minimum, the width that covers a percentile of its values less the minimum
(that of ``PERCENTILES`` which makes the block smallest), those values' low
bits packed at that width, and a list of exceptions (position and high bits)
for the rest.  The blocks come first, so a file is written as its ids come;
behind them a table of block starts, with minimum, width and exception count,
allows any block to be read alone, and a table of documents holds each
document's id and first id position.

Tokenising.  Byte-level BPE works on each piece of a fixed pre-split alone, so
a text is split by vectorised character classes, its distinct pieces are
encoded by the tokenizers library (kept in a bounded cache of the worker), and
the ids are gathered by piece.  Documents with characters outside the classes
that are handled, with contractions, or with the literal of an added token
(which has its own id, as the library gives it), go through the library whole.

Scale.  One range partitioning by doc_id (then by a hash of the text and a
random number, so that a hot or null id is split too), into as many parts as
the table's size asks for; each task sorts, encodes and writes its own file,
under a name no other attempt uses, and reports it; only reported files are
read.  A task holds one group of blocks, not its file.  Positions before a
file come from sums per file; each file is read by ranges of blocks.

Cases.  A null text is empty (only the end id); null doc_ids come first;
repeated doc_ids stand in the order of a hash of their text; an empty table
gives no rows; texts of any length are encoded whole; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import io
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import PieceCache, bounded_batches, code_points, estimated_bytes, library_threads, once, persist, pieces_of, ragged, shared_dir, string_slices

BLOCK = 128
#: Percentiles of a block's values whose widths are tried; the smallest block wins.
PERCENTILES = (75, 90, 95, 98, 100)
MAGIC = b"PFOR0002"
#: Bytes of text encoded at once, and bytes of input (as the optimiser sees them) that a task should get.
SLICE, PART_BYTES = 1_000_000, 128 << 20

# ---------------------------------------------------------------- blocks


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values below 2**width as rows of 16 * width bytes."""
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(len(values), BLOCK, 4), axis=2, bitorder="little", count=width)
    return np.packbits(bits.reshape(len(values), BLOCK * width), axis=1, bitorder="little")


def unpack_bits(rows: np.ndarray, width: int) -> np.ndarray:
    if not width:
        return np.zeros((len(rows), BLOCK), np.uint32)
    at = np.arange(BLOCK, dtype=np.int64) * width
    padded = np.concatenate([rows, np.zeros((len(rows), 5), np.uint8)], axis=1)
    first = at >> 3
    total = np.zeros((len(rows), BLOCK), np.uint64)
    for j in range((width + 14) // 8):
        total |= padded[:, first + j].astype(np.uint64) << np.uint64(8 * j)
    return ((total >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


def _bit_length(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


#: Ids that are packed at once, which bounds the temporary arrays.
GROUP = BLOCK << 10


def encode_blocks(ids: np.ndarray) -> bytes:
    """A file of ids without documents."""
    out = io.BytesIO()
    writer = FileWriter(out)
    writer.add([], np.empty(0, np.int64), np.ascontiguousarray(ids, np.uint32))
    writer.close()
    return out.getvalue()


class FileWriter:
    """Writes a token file to a stream as ids come; it holds less than a group of them, and the tables."""

    def __init__(self, out):
        self.out, self.held, self.n_held = out, [], 0
        self.n_ids, self.n_docs, self.body = 0, 0, 0
        self.blocks: list[tuple[np.ndarray, bytes, bytes, bytes]] = []
        self.has: list[bytes] = []
        self.ids: list[bytes] = []
        self.firsts: list[bytes] = []
        out.write(MAGIC)

    def add(self, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> None:
        self.has.append(np.array([x is not None for x in doc_ids], np.uint8).tobytes())
        self.ids.append(np.array([x or 0 for x in doc_ids], "<i8").tobytes())
        self.firsts.append((self.n_ids + np.cumsum(lengths) - lengths).astype("<u8").tobytes())
        self.n_docs += len(doc_ids)
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= GROUP:
            self._pack(self.n_held // GROUP * GROUP)

    def _pack(self, n: int) -> None:
        whole = np.concatenate(self.held)
        for lo in range(0, n, GROUP):
            sizes, low, width, n_out, body = _pack_group(whole[lo : min(n, lo + GROUP)])
            self.blocks.append((sizes, low, width, n_out))
            self.out.write(body)
            self.body += len(body)
        self.held, self.n_held = [whole[n:].copy()], len(whole) - n

    def close(self) -> None:
        if self.n_held:
            self._pack(self.n_held)
        sizes = np.concatenate([b[0] for b in self.blocks]) if self.blocks else np.empty(0, np.int64)
        self.out.write((np.cumsum(sizes) - sizes).astype("<u8").tobytes())
        for k in (1, 2, 3):
            self.out.write(b"".join(b[k] for b in self.blocks))
        for table in (self.has, self.ids, self.firsts):
            self.out.write(b"".join(table))
        self.out.write(struct.pack(TRAILER, self.n_ids, len(sizes), self.n_docs, self.body) + MAGIC)


#: Ids, blocks, documents and bytes of all blocks, before a second MAGIC at the end.
TRAILER = "<QQQQ"


def _pack_group(ids: np.ndarray) -> tuple[np.ndarray, bytes, bytes, bytes, bytes]:
    """Sizes, minima, widths, exception counts and bodies of some blocks."""
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    grid = np.concatenate([ids, np.full(n_blocks * BLOCK - n, ids[-1], np.uint32)]).reshape(n_blocks, BLOCK)
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    ordered = np.sort(rest, axis=1)
    widths = np.stack([_bit_length(ordered[:, BLOCK * p // 100 - 1]) for p in PERCENTILES])
    cost = np.stack([16 * w.astype(np.int64) + 5 * (rest.astype(np.uint64) >> w.astype(np.uint64)[:, None] > 0).sum(axis=1) for w in widths])
    width = widths[np.argmin(cost, axis=0), np.arange(n_blocks)]
    outlier = rest.astype(np.uint64) >> width.astype(np.uint64)[:, None]
    where, position = np.nonzero(outlier)
    n_out = np.bincount(where, minlength=n_blocks).astype(np.uint8)
    sizes = 16 * width.astype(np.int64) + 5 * n_out
    starts = np.cumsum(sizes) - sizes
    body = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        packed = pack_bits(rest[rows] & np.uint32((1 << w) - 1), w)
        body[ragged(starts[rows], np.full(len(rows), 16 * w))] = packed.ravel()
    patch = np.empty((len(where), 5), np.uint8)
    patch[:, 0] = position
    patch[:, 1:] = outlier[where, position].astype("<u4")[:, None].view(np.uint8).reshape(-1, 4)
    body[ragged(starts + 16 * width.astype(np.int64), 5 * n_out.astype(np.int64))] = patch.ravel()
    return sizes, low.astype("<u4").tobytes(), width.tobytes(), n_out.tobytes(), body.tobytes()


class BlockReader:
    """Reads any run of blocks or ids of a seekable file; of the rest it holds the tables only."""

    def __init__(self, source):
        tail = struct.calcsize(TRAILER) + len(MAGIC)
        source.seek(0, 2)
        end = source.tell()
        source.seek(max(0, end - tail))
        last = source.read(tail)
        if end < tail + len(MAGIC) or last[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a token file")
        self.source = source
        self.n, k, n_docs, self.size = struct.unpack(TRAILER, last[: -len(MAGIC)])
        self.n_blocks = k
        source.seek(len(MAGIC) + self.size)
        data = source.read(14 * k + 17 * n_docs)
        self.starts = np.append(np.frombuffer(data, "<u8", k).astype(np.int64), self.size)
        self.low = np.frombuffer(data, "<u4", k, 8 * k)
        self.width = np.frombuffer(data, np.uint8, k, 12 * k)
        self.n_out = np.frombuffer(data, np.uint8, k, 13 * k)
        at = 14 * k
        self.has = np.frombuffer(data, np.uint8, n_docs, at).astype(bool)
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at + n_docs)
        #: Where each document's ids begin, and where the last one's end.
        self.firsts = np.append(np.frombuffer(data, "<u8", n_docs, at + 9 * n_docs).astype(np.int64), self.n)

    def blocks(self, lo: int, hi: int) -> np.ndarray:
        """Ids of blocks lo..hi-1 (the last block's padding left out)."""
        begin, end = int(self.starts[lo]), int(self.starts[hi])
        self.source.seek(len(MAGIC) + begin)
        body = np.frombuffer(self.source.read(end - begin), np.uint8)
        starts, width, n_out = self.starts[lo:hi] - begin, self.width[lo:hi], self.n_out[lo:hi].astype(np.int64)
        out = np.zeros((hi - lo, BLOCK), np.uint32)
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            packed = body[ragged(starts[rows], np.full(len(rows), 16 * w))].reshape(len(rows), 16 * w)
            out[rows] = unpack_bits(packed, w)
        if n_out.sum():
            patch = body[ragged(starts + 16 * width.astype(np.int64), 5 * n_out)].reshape(-1, 5)
            block = np.repeat(np.arange(hi - lo), n_out)
            high = np.ascontiguousarray(patch[:, 1:]).view("<u4").ravel().astype(np.uint64) << width[block].astype(np.uint64)
            out[block, patch[:, 0]] |= high.astype(np.uint32)
        out += self.low[lo:hi, None]
        return out.ravel()[: self.n - lo * BLOCK]

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids first..last-1, reading only the blocks that hold them."""
        lo, hi = first // BLOCK, -(-last // BLOCK)
        return self.blocks(lo, hi)[first - lo * BLOCK : last - lo * BLOCK] if last > first else np.empty(0, np.uint32)

    def crc(self, first: int, last: int, step: int = 1 << 20) -> int:
        """crc32 of ids first..last-1 as little-endian 32-bit integers, some at a time."""
        value = 0
        for lo in range(first, last, step):
            value = zlib.crc32(self.ids(lo, min(last, lo + step)).astype("<u4").tobytes(), value)
        return value


# ------------------------------------------------------------- tokenising

_LETTER, _NUMBER, _SPACE, _OTHER, _UNKNOWN = 1, 2, 3, 0, 9


def _classes() -> np.ndarray:
    """Class of code points below 0x530 and of general punctuation; the rest is unknown."""
    table = np.full(0x110000, _UNKNOWN, np.uint8)
    spaces = {*range(9, 14), 0x20, 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F}
    for cp in (*range(0x530), *range(0x2000, 0x2070)):
        kind = unicodedata.category(chr(cp))
        table[cp] = _SPACE if cp in spaces else _LETTER if kind[0] == "L" else _NUMBER if kind[0] == "N" else _UNKNOWN if kind == "Cn" else _OTHER
    return table


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it is printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class PieceEncoder:
    """Ids of texts by one tokenizers-library file, piece by piece."""

    #: Distinct pieces kept per worker (about 40 bytes each).
    CACHE = 600_000

    def __init__(self, path: str):
        library_threads(1)
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values() if x.content]
        pre = self.tokenizer.pre_tokenizer
        self.by_piece = pre is not None and "ByteLevel(add_prefix_space=False" in repr(pre) and self.tokenizer.normalizer is None
        self.classes = _classes()
        self.cache = PieceCache(self.CACHE)
        #: The same model for pieces that are split already, parted by blanks (which the byte letters lack).
        self.split = Tokenizer(self.tokenizer.model)
        self.split.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        if hasattr(self.split.model, "_resize_cache"):
            self.split.model._resize_cache(0)  # pieces are told apart here; the library's own cache would only grow
        self.letters = byte_letters()
        #: Bytes of each id's token, by which the ids of pieces in a row are told apart.
        size = self.tokenizer.get_vocab_size()
        self.token_size = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text."""
        if not self.by_piece:
            got = self.library(texts)
            return np.fromiter((i for x in got for i in x), np.uint32), np.array([len(x) for x in got], np.int64)
        whole = "\n".join(texts)
        cps = code_points(whole)
        sizes = np.array([len(t) for t in texts], np.int64)
        offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
        kind = self.classes[cps]
        ends = offsets[1:] - 1  # the separators' places
        odd = np.zeros(len(texts), bool)
        if (kind == _UNKNOWN).any():
            odd[np.searchsorted(offsets, np.flatnonzero(kind == _UNKNOWN), "right") - 1] = True
        quote = np.flatnonzero(cps == 39)
        quote = quote[quote + 1 < len(cps)]
        if len(quote):
            quote = quote[np.isin(cps[quote + 1], [115, 116, 109, 100, 114, 118, 108])]
            odd[np.searchsorted(offsets, quote, "right") - 1] = True
        for token in self.added:
            at = whole.find(token)
            while at >= 0:
                i = int(np.searchsorted(offsets, at, "right")) - 1
                odd[i] = True
                at = whole.find(token, max(at + 1, int(ends[i]) + 1 - len(token)))
        edges, keep = self._pieces(cps, kind, offsets, ends)
        doc = np.searchsorted(offsets, edges[:-1], "right") - 1
        if odd.any():
            keep &= ~odd[doc]
        doc = doc[keep]
        ids, counts = self.cache.ids(self.cache.lookup(pieces_of(whole, cps, edges).filter(pa.array(keep)), self._fresh))
        per_text = np.bincount(doc, counts, len(texts)).astype(np.int64)
        if odd.any():
            which = np.flatnonzero(odd)
            got = self.library([texts[i] for i in which])
            parts, at = [], np.concatenate(([0], np.cumsum(per_text)))
            last = 0
            for i, x in zip(which.tolist(), got):
                parts += [ids[at[last] : at[i]], np.array(x, np.uint32)]
                per_text[i], last = len(x), i + 1
            ids = np.concatenate([*parts, ids[at[last] :]])
        return ids, per_text

    @staticmethod
    def _pieces(cps, kind, offsets, ends):
        """Edges between the pieces (letter, number and other runs, each with one space before it; runs of white space), and which are no separators."""
        n = len(cps)
        cut = np.zeros(n + 1, bool)
        if n:
            cut[1:n] = kind[1:] != kind[:-1]
        cut[0] = cut[n] = True
        doc_edge = np.zeros(n + 1, bool)
        doc_edge[np.minimum(offsets, n)] = True
        doc_edge[np.minimum(ends, n)] = True
        cut |= doc_edge
        space = kind == _SPACE
        # The last blank before a word (in the same document) is cut off its run; a plain space also joins the word.
        before = np.zeros(n, bool)
        if n > 1:
            before[:-1] = space[:-1] & ~space[1:] & ~doc_edge[1:n]
        cut[:n] |= before
        joined = np.flatnonzero(before & (cps == 32)) + 1
        cut[joined] = False
        edges = np.flatnonzero(cut)
        separator = np.zeros(n + 1, bool)
        separator[ends[:-1]] = True
        return edges, ~separator[edges[:-1]]

    def _fresh(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and their number for each piece, which are given to the library in its byte letters, many to a text."""
        n = len(pieces)
        bounds = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + n + 1]
        data = pieces.buffers()[2].to_pybytes()[bounds[0] : bounds[-1]].decode("latin-1").translate(self.letters)
        at = (bounds - bounds[0]).tolist()
        ids = []
        for lo in range(0, n, 16_384):
            some = [" ".join([data[a:b] for a, b in zip(at[i : i + 64], at[i + 1 : min(i + 64, n) + 1])]) for i in range(lo, min(n, lo + 16_384), 64)]
            ids.append(np.concatenate([np.array(x.ids, np.uint32) for x in self.split.encode_batch_fast(some, add_special_tokens=False)]))
        flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        ends = np.cumsum(self.token_size[flat])
        last = np.searchsorted(ends, bounds[1:] - bounds[0])
        if n and (last[-1] + 1 != len(ends) or not np.array_equal(ends[last], bounds[1:] - bounds[0])):
            raise RuntimeError("a token spans two pieces")
        return flat, np.diff(last, prepend=-1), np.zeros(n, bool)


# ----------------------------------------------------------------- Spark


def write_token_files(documents: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 2, part_bytes: int = PART_BYTES) -> DataFrame:
    """Encode documents in ascending doc_id order into files; a manifest row per file.

    Columns: part (file number in order), path, n_docs, n_ids.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    folder = folder or shared_dir(spark, "tokens")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-estimated_bytes(documents) // part_bytes))
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", F.xxhash64("text").alias("key"), "text", F.rand(7).alias("salt"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "key", "salt").sortWithinPartitions("doc_id", "key").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = once(("token encoder", tokenizer_path), lambda: PieceEncoder(tokenizer_path))
        writer, stream, path = None, None, ""
        for batch in batches:
            if writer is None and batch.num_rows:
                path = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.pfor"
                fs, local = pafs.FileSystem.from_uri(path)
                fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
                stream = fs.open_output_stream(local)
                writer = FileWriter(stream)
            doc_ids = batch.column(0).to_pylist()
            for lo, hi, texts in string_slices(batch.column(1), SLICE):
                got, sizes = encoder.encode(texts)
                out = np.full(len(got) + len(sizes), end_id, np.uint32)
                out[ragged(np.cumsum(sizes + 1) - sizes - 1, sizes)] = got
                writer.add(doc_ids[lo:hi], sizes + 1, out)
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "path": [path], "n_docs": [writer.n_docs], "n_ids": [writer.n_ids]})

    return persist(ordered.mapInArrow(run, "part long, path string, n_docs long, n_ids long"), "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    # One row per file; the running sum over them is the only step in one task, 16 bytes a file.
    before = manifest.select("part", "path", "n_ids").collect()
    files, total = [], 0
    for row in sorted(before, key=lambda r: r.part):
        files.append((row.path, total))
        total += row.n_ids
    spark = manifest.sparkSession
    if not files:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    placed = spark.createDataFrame(files, "path string, start long").repartition(len(files), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, local = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(local) as source:
                    yield from _documents(BlockReader(source), base)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(reader: BlockReader, base: int, step: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Rows of a file's documents; about ``step`` ids are in memory at a time, also of one long document."""
    firsts, lo = reader.firsts, 0
    while lo < len(reader.doc_ids):
        hi = max(lo + 1, int(np.searchsorted(firsts, firsts[lo] + step, "right")) - 1)
        if hi == lo + 1:
            crcs = [reader.crc(int(firsts[lo]), int(firsts[hi]), step)]
        else:
            raw = memoryview(reader.ids(int(firsts[lo]), int(firsts[hi])).astype("<u4").tobytes())
            at = (4 * (firsts[lo : hi + 1] - firsts[lo])).tolist()
            crcs = [zlib.crc32(raw[a:b]) for a, b in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(reader.doc_ids[lo:hi], pa.int64(), mask=~reader.has[lo:hi]), pa.array(base + firsts[lo:hi], pa.int64()), pa.array(np.diff(firsts[lo : hi + 1]), pa.int64()),
                pa.array(crcs, pa.int64()),
            ],
            ["doc_id", "start", "n_tokens", "ids_crc32"],
        )
        lo = hi


def token_files(documents: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 2) -> DataFrame:
    """Write the files and report each document as read back from them."""
    return read_token_files(write_token_files(documents, tokenizer_path, folder, end_id))
