"""Token-id output as one wavelet-matrix file per shard.

Documents are range-partitioned by key, so each task holds one run of keys; it
encodes the run and writes one file.  A file stores its ids as a wavelet matrix:
the distinct ids of the shard are numbered densely, and one bit plane per bit of
that number keeps the sequence stably sorted by the bits above.  With counts of
ones at block starts, ``access``, ``rank``, ``select``, ``count`` and
``occurrences`` work from the planes without unpacking the sequence.

File layout (little endian): ``MAGIC``, then a uint32 length and that many bytes
of JSON header (tokens, documents, bits, zeros per plane, and the place and
length of every section), then sections, each compressed on its own: alphabet
(uint32), document keys (int64), key-is-null flags (uint8), document lengths
(int64), and per plane its bits in chunks of ``CHUNK`` bytes, so that a single
access reads a few chunks.  Ranks at chunk starts are in the header.

Files go to ``<folder>/shard-<n>.wm`` through pyarrow's file systems (the shared
folder may be local, HDFS or an object store) under a temporary name first; a
task that runs again writes the same bytes.  Reading uses Spark's binary reader.

Defined cases: a null text is the empty text (its ids are the end id alone); a
null key sorts first; repeated keys keep one entry per row (ordered by text);
an empty table writes no file and yields no rows.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import key_and_text, lean, scratch_path
from .tokens import encoder, tokenizer_path, with_end

MAGIC = b"WMIDS001"
CHUNK = 1 << 13
#: UTF-8 bytes of text a shard is made for; a task holds its ids (about as many bytes) and their planes.
SHARD_BYTES = 24 << 20
END_ID = 0


def build(ids: np.ndarray, keys: list[int | None], lengths: np.ndarray) -> bytes:
    """One file's bytes for the ids of some documents."""
    present = np.bincount(ids, minlength=1)
    alphabet = np.flatnonzero(present).astype("<u4")
    dense = np.zeros(len(present), np.uint32)
    dense[alphabet] = np.arange(len(alphabet))
    seq = dense[ids].astype(np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
    bits = max(1, int(len(alphabet) - 1).bit_length()) if len(alphabet) else 0
    pack = zstandard.ZstdCompressor(level=1).compress
    sections: list[bytes] = []
    at = 0

    def put(raw: bytes) -> list[int]:
        nonlocal at
        sections.append(pack(raw))
        at += len(sections[-1])
        return [at - len(sections[-1]), len(sections[-1]), len(raw)]

    head = {"tokens": len(seq), "documents": len(keys), "bits": bits, "chunk": CHUNK,
            "alphabet": put(alphabet.tobytes()),
            "keys": put(np.array([k or 0 for k in keys], "<i8").tobytes()),
            "nulls": put(np.array([k is None for k in keys], "u1").tobytes()),
            "lengths": put(np.asarray(lengths, "<i8").tobytes()), "planes": []}
    for level in range(bits - 1, -1, -1):
        one = (seq >> level & 1).view().astype(bool)
        raw = np.packbits(one).tobytes()
        parts = [raw[k:k + CHUNK] for k in range(0, len(raw), CHUNK)]
        ones = np.cumsum([0, *(int(one[k:k + CHUNK * 8].sum()) for k in range(0, len(one), CHUNK * 8))])
        head["planes"].append({"zeros": int(len(seq) - ones[-1]), "ranks": ones.tolist(), "parts": [put(p) for p in parts]})
        if level:
            seq = np.concatenate([seq[~one], seq[one]])
    text = json.dumps(head, separators=(",", ":")).encode()
    return b"".join([MAGIC, struct.pack("<I", len(text)), text, *sections])


class WaveletFile:
    """Reader over a file's bytes; planes are decompressed chunk by chunk when asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet-matrix id file")
        size = struct.unpack_from("<I", data, 8)[0]
        self.head = json.loads(data[12:12 + size])
        self.data, self.base = data, 12 + size
        self.tokens, self.bits = self.head["tokens"], self.head["bits"]
        self.alphabet = np.frombuffer(self._section(self.head["alphabet"]), "<u4")
        null = np.frombuffer(self._section(self.head["nulls"]), "u1")
        keys = np.frombuffer(self._section(self.head["keys"]), "<i8").tolist()
        self.keys = [None if n else k for k, n in zip(keys, null, strict=True)]
        self.lengths = np.frombuffer(self._section(self.head["lengths"]), "<i8")
        self._kept: dict[tuple[int, int], np.ndarray] = {}

    def _section(self, place: list[int]) -> bytes:
        at, size, raw = place
        return zstandard.ZstdDecompressor().decompress(self.data[self.base + at:self.base + at + size], max_output_size=raw)

    def _chunk(self, plane: int, k: int) -> np.ndarray:
        if (plane, k) not in self._kept:
            raw = self._section(self.head["planes"][plane]["parts"][k])
            self._kept[plane, k] = np.unpackbits(np.frombuffer(raw, "u1"))
        return self._kept[plane, k]

    def _bit(self, plane: int, i: int) -> int:
        return int(self._chunk(plane, i // (CHUNK * 8))[i % (CHUNK * 8)])

    def _ones(self, plane: int, i: int) -> int:
        """Ones before position i."""
        k, rest = divmod(i, CHUNK * 8)
        return self.head["planes"][plane]["ranks"][k] + (int(self._chunk(plane, k)[:rest].sum()) if rest else 0)

    def _select(self, plane: int, bit: int, n: int) -> int:
        """Position of the n-th (from 0) ``bit`` of a plane."""
        ranks = np.array(self.head["planes"][plane]["ranks"])
        have = ranks if bit else np.minimum(np.arange(len(ranks)) * CHUNK * 8, self.tokens) - ranks
        k = int(np.searchsorted(have, n, "right")) - 1
        inside = np.flatnonzero(self._chunk(plane, k)[:min(CHUNK * 8, self.tokens - k * CHUNK * 8)] == bit)
        return k * CHUNK * 8 + int(inside[n - int(have[k])])

    def access(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = 0
        for plane in range(self.bits):
            bit = self._bit(plane, i)
            ones = self._ones(plane, i)
            i = self.head["planes"][plane]["zeros"] + ones if bit else i - ones
            value = value << 1 | bit
        return int(self.alphabet[value])

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where occurrences of ``token`` before ``end`` lie below the last plane."""
        code = int(np.searchsorted(self.alphabet, token))
        if code == len(self.alphabet) or self.alphabet[code] != token:
            return 0, 0
        low, high = 0, end
        for plane in range(self.bits):
            a, b = self._ones(plane, low), self._ones(plane, high)
            if code >> (self.bits - 1 - plane) & 1:
                zeros = self.head["planes"][plane]["zeros"]
                low, high = zeros + a, zeros + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, end: int) -> int:
        """Occurrences of ``token`` before position ``end``."""
        low, high = self._range(token, min(end, self.tokens))
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.tokens)

    def select(self, token: int, n: int) -> int:
        """Position of the n-th (from 0) occurrence of ``token``."""
        low, high = self._range(token, self.tokens)
        if not 0 <= n < high - low:
            raise IndexError(n)
        at, code = low + n, int(np.searchsorted(self.alphabet, token))
        for plane in range(self.bits - 1, -1, -1):
            if code >> (self.bits - 1 - plane) & 1:
                at = self._select(plane, 1, at - self.head["planes"][plane]["zeros"])
            else:
                at = self._select(plane, 0, at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, n) for n in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids in order, from the last plane up."""
        out = np.zeros(self.tokens, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for level, plane in enumerate(reversed(self.head["planes"])):
            raw = b"".join(self._section(p) for p in plane["parts"])
            one = np.unpackbits(np.frombuffer(raw, "u1"), count=self.tokens).view(bool)
            up = np.empty_like(out)
            up[~one] = out[:plane["zeros"]]
            up[one] = out[plane["zeros"]:] | (1 << level)
            out = up
        return self.alphabet[out] if self.tokens else out.astype("<u4")


def _write_file(folder: str, name: str, data: bytes) -> None:
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    final = f"{root}/{name}"
    part = f"{final}.{zlib.crc32(data):08x}.part"
    with files.open_output_stream(part) as out:
        out.write(data)
    files.move(part, final)


def _writer(folder: str, path: str):
    def run(batches):
        from pyspark import TaskContext

        enc = encoder(path, 4)
        keys: list[int | None] = []
        parts, counts = [], []
        for b in batches:
            ids, n = enc.batch(b.column(1))
            parts.append(with_end(ids, n, END_ID))
            counts.append(n + 1)
            keys += b.column(0).to_pylist()
        if keys:
            lengths = np.concatenate(counts)
            ids = np.concatenate(parts)
            del parts
            n = TaskContext.get().partitionId()
            _write_file(folder, f"shard-{n:06d}.wm", build(ids, keys, lengths))
            yield pa.RecordBatch.from_pydict({"shard": pa.array([n], pa.int32()), "tokens": pa.array([int(lengths.sum())], pa.int64())})

    return run


def write_ids(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", path: str | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the shard files; (shard, tokens) of each comes back as a written table."""
    rows = key_and_text(docs, key, text)
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    run = _writer(folder, path or tokenizer_path())
    done = (rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text")
            .mapInArrow(lean(run), "shard int, tokens long"))
    index = scratch_path(docs.sparkSession, "wavelet-index")
    done.write.parquet(index)
    return docs.sparkSession.read.schema("shard int, tokens long").parquet(index)


def _reader(batches):
    for b in batches:
        for data, base in zip(b.column(0), b.column(1).to_pylist(), strict=True):
            f = WaveletFile(data.as_buffer().to_pybytes())
            raw = f.decode().astype("<u4").tobytes()
            ends = np.cumsum(f.lengths)
            starts = ends - f.lengths
            sums = [zlib.crc32(raw[4 * a:4 * e]) for a, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(f.keys, pa.int64()), "start": pa.array(starts + base, pa.int64()),
                "n_tokens": pa.array(f.lengths, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})


def read_documents(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Per document, from the files alone but for the shards' first positions."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = index.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder)
             .select("content", F.regexp_extract("path", r"shard-(\d+)\.wm$", 1).cast("int").alias("shard")))
    return (files.join(F.broadcast(base), "shard").select("content", "base")
            .mapInArrow(lean(_reader), "doc_id long, start long, n_tokens long, ids_crc32 long"))


def wavelet_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, folder: str | None = None) -> DataFrame:
    """Encode, write the files, read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "wavelet")
    index = write_ids(docs, folder, key, text, path)
    if index.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_documents(spark, folder, index)
