"""Token ids as binary shards, with a minimal perfect hash index for keyed access.

Layout under one folder of the shared file system::

    ids/shard-NNNNNN.bin     raw ids, little-endian unsigned 16- or 32-bit, document after document
    index/part-NNNNNN.npz    one minimal perfect hash per bucket of keys

Documents are sorted by id over all shards (nulls first), so shard numbers and positions follow the
ids. Each document ends with the end id. A key is ``(doc_id, copy)``: rows that repeat an id are its
copies 0, 1, ... in the order of their texts. The index of a bucket is a cascade of bit arrays: a
key that is alone on its bit at some level is placed there, and its rank among the set bits is its
slot, so ``n`` keys fill slots 0 .. n-1. A slot holds a 32-bit fingerprint, the shard, the offset and
the number of ids, so a look-up reads one slot and tells a foreign key by its fingerprint.

Files are written under a name of their own and renamed, so a task that runs twice leaves one whole
file. Encoding: a batch is cut into units (a word with the single space before it, or a run of
other white space) at places where the tokenizer cuts as well, and each distinct unit is encoded
once; a text with white space beyond ASCII's is encoded whole.

Defined results: null and empty texts hold the end id alone; an empty table gives an empty folder
and no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import io
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memo import KeyTable
from .scan import EXACT, SPACE, groups, mix, segment_keys, utf8
from .spark_io import staged, text_rows

END_ID = 0
#: Mean keys in a bucket of the index, units a worker remembers, text bytes aimed at per shard.
BUCKET_KEYS, KNOWN_UNITS, SHARD_BYTES = 50_000, 1 << 20, 64 << 20
#: Units or texts that the tokenizer gets at once.
ENCODE_AT_ONCE = 1024
_U = np.uint64
#: White space beyond ASCII's that the pre-tokenizer knows: U+0085, U+00A0, U+1680, U+2000 to
#: U+200A, U+2028, U+2029, U+202F, U+205F, U+3000, and the separators 0x1C to 0x1F.
_RARE = b"\xc2\x85|\xc2\xa0|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|[\x1c-\x1f]"

_LEADS = np.zeros(256, bool)
_LEADS[[0xC2, 0xE1, 0xE2, 0xE3, *range(0x1C, 0x20)]] = True


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write_once(uri: str, raw: bytes | memoryview) -> None:
    """Write a whole file under a passing name, then rename it."""
    store, path = file_system(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    passing = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(passing) as out:
        out.write(raw)
    store.move(passing, path)


class Encoder:
    """Ids of texts, by way of the distinct units in them."""

    def __init__(self, path: str) -> None:
        import os
        import re

        from tokenizers import Tokenizer

        # A task has one core; threads of the tokenizer's own would each keep memory in the worker.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.rare = re.compile(_RARE)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.type = np.uint32 if self.wide else np.uint16
        self.known = KeyTable(KNOWN_UNITS)
        self.at = np.zeros(self.known.size, np.int64)
        self.size = np.zeros(self.known.size, np.int32)
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        self.flat, self.end = np.empty(1 << 16, self.type), 0

    def _encode(self, texts: list[str]) -> list[list[int]]:
        found = []
        for p in range(0, len(texts), ENCODE_AT_ONCE):
            some = texts[p : p + ENCODE_AT_ONCE]
            found += [x.ids for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
        return found

    def _units_ids(self, data, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many units, and their number for each."""
        raw = [data[a:b].tobytes().decode() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        found = self._encode(raw)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), self.type, int(sizes.sum())), sizes

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the units of consecutive texts."""
        lo, hi = int(offsets[0]), int(offsets[-1])
        body = data[lo:hi]
        space = SPACE[body]
        first = np.zeros(len(body) + 1, bool)
        first[offsets - lo] = True
        edge = first[:-1]
        before = np.ones(len(body), bool)
        before[1:] = space[:-1]
        word = ~space & (before | edge)  # where a word begins
        # A word takes the one space before it along; else it begins where it begins.
        led = word & ~edge
        led[1:] &= body[:-1] == 0x20
        led[:1] = False
        starts = word & ~led
        starts[:-1] |= led[1:]
        # A run of white space begins a unit, and the last of several, if no space, is its own.
        run = space.copy()
        run[1:] &= ~space[:-1] | edge[1:]
        starts |= run
        lone = np.zeros(len(body), bool)
        lone[:-1] = space[:-1] & (word & ~led)[1:] & ~first[1:-1]
        starts |= lone
        starts |= edge
        begin = np.flatnonzero(starts) + lo
        return begin, np.append(begin[1:], hi)[: len(begin)]

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts without the end id, and their number for each text."""
        n = len(offsets) - 1
        body = data[offsets[0] : offsets[-1]]
        if _LEADS[body].any() and self.rare.search(memoryview(body)):
            found = self._encode([data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
            sizes = np.array([len(x) for x in found], np.int64)
            return np.array([i for x in found for i in x], self.type), sizes
        start, end = self.units(data, offsets)
        keys = segment_keys(data, start, end)
        slot = self.known.find(keys)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new, first = np.unique(keys[missing], return_index=True)
            if not self.known.room(len(new)):
                self._forget()
                new, first = np.unique(keys, return_index=True)
                missing = np.arange(len(keys))
            self._learn(new, missing[first], data, start, end)
            slot[missing] = self.known.find(keys[missing])
        size, at = self.size[slot].astype(np.int64), self.at[slot]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        take = np.arange(total) + np.repeat(at - stop + size, size)
        bounds = np.concatenate([[0], stop])[np.searchsorted(start, offsets, "left")]
        return self.flat[take], np.diff(bounds) if n else np.empty(0, np.int64)


    def _learn(self, new: np.ndarray, place: np.ndarray, data, start, end) -> None:
        """Encode units that were not known."""
        flat, sizes = self._units_ids(data, start[place], end[place])
        total = len(flat)
        while self.end + total > len(self.flat):
            self.flat = np.append(self.flat, np.empty(len(self.flat), self.type))
        self.flat[self.end : self.end + total] = flat
        slots = self.known.add(new)
        self.at[slots], self.size[slots] = self.end + np.cumsum(sizes) - sizes, sizes
        self.end += total


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def key_hash(doc: np.ndarray, copy: np.ndarray, null: np.ndarray) -> np.ndarray:
    key = mix(doc.astype(np.int64).view(_U) ^ EXACT[1]) + null.astype(_U) * EXACT[2]
    return mix(key + copy.astype(np.int64).view(_U) * EXACT[3])


def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    step = _U((level + 1) * int(EXACT[5]) % (1 << 64))
    return (mix(keys + step) % _U(size)).astype(np.int64)


def build_index(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bit arrays of the levels, and the slot of each of the distinct keys."""
    levels, slot, left, placed = [], np.empty(len(keys), np.int64), np.arange(len(keys)), 0
    while len(left):
        size = 2 * len(left) + 1
        bit = _bit(keys[left], len(levels), size)
        alone = np.bincount(bit, minlength=size) == 1
        rank = np.cumsum(alone) - 1
        lucky = alone[bit]
        slot[left[lucky]] = placed + rank[bit[lucky]]
        placed += int(alone.sum())
        left = left[~lucky]
        levels.append(alone)
        if len(levels) > 200:
            raise ValueError("equal keys in one bucket")
    return levels, slot


def find_slots(keys: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Slot of each key, -1 for one that no level holds."""
    slot, left, placed = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for k, alone in enumerate(levels):
        bit = _bit(keys[left], k, len(alone))
        hit = alone[bit]
        rank = np.cumsum(alone) - 1
        slot[left[hit]] = placed + rank[bit[hit]]
        placed += int(alone.sum())
        left = left[~hit]
    return slot


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ EXACT[7]) >> _U(32)).astype(np.uint32)


class Index:
    """One bucket of the index."""

    def __init__(self, raw: bytes) -> None:
        z = np.load(io.BytesIO(raw))
        ends = np.cumsum(z["bits"])
        flat = np.unpackbits(z["levels"], count=int(ends[-1]) if len(ends) else 0).astype(bool)
        self.levels = np.split(flat, ends[:-1]) if len(ends) else []
        self.fingerprint, self.shard, self.offset, self.size = (z[c] for c in ("f", "s", "o", "n"))

    @staticmethod
    def pack(keys, shard, offset, size) -> bytes:
        levels, slot = build_index(keys)
        order = np.argsort(slot)
        out = io.BytesIO()
        np.savez(
            out, bits=np.array([len(x) for x in levels], np.int64),
            levels=np.packbits(np.concatenate(levels)) if levels else np.empty(0, np.uint8),
            f=_fingerprint(keys)[order], s=shard[order].astype(np.int32),
            o=offset[order].astype(np.int64), n=size[order].astype(np.int64),
        )
        return out.getvalue()

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """Whether each key is held, and its shard, offset and number of ids."""
        slot = find_slots(keys, self.levels)
        held = slot >= 0
        held[held] = self.fingerprint[slot[held]] == _fingerprint(keys[held])
        slot = np.where(held, slot, 0)
        none = np.zeros(len(keys), np.int64)
        if not len(self.shard):
            return held, none, none, none
        return held, self.shard[slot], self.offset[slot], self.size[slot]


def shard_name(uri: str, shard: int) -> str:
    return f"{uri}/ids/shard-{shard:06d}.bin"


def index_name(uri: str, bucket: int) -> str:
    return f"{uri}/index/part-{bucket:06d}.npz"


def write_shards(docs: DataFrame, uri: str, tokenizer: str, shards: int) -> DataFrame:
    """Write the id payloads in order of ``doc_id``; one row per document tells where its ids are."""
    names = ["doc_id", "copy", "shard", "offset", "n_tokens"]

    def run(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encode, last, copy, offset = encoder(tokenizer), object(), 0, 0
        store, path = file_system(shard_name(uri, shard))
        store.create_dir(path.rpartition("/")[0], recursive=True)
        passing = f"{path}.{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(passing) as out:
            for rows in batches:
                data, offsets = utf8(rows.column("text"))
                ids_of = rows.column("doc_id").to_pylist()
                for i, j in groups(offsets):
                    ids, sizes = encode(data, offsets[i : j + 1])
                    stop = np.cumsum(sizes + 1)
                    whole = np.full(int(stop[-1]), END_ID, encode.type)
                    body = np.ones(len(whole), bool)
                    body[stop - 1] = False
                    whole[body] = ids
                    out.write(whole.astype(whole.dtype.newbyteorder("<"), copy=False).tobytes())
                    copies = []
                    for doc in ids_of[i:j]:
                        copy = copy + 1 if doc == last else 0
                        last = doc
                        copies.append(copy)
                    begin = offset + stop - sizes - 1
                    offset += int(stop[-1])
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("doc_id").slice(i, j - i), pa.array(copies, pa.int64()),
                         pa.array(np.full(j - i, shard, np.int64)), pa.array(begin), pa.array(sizes + 1)],
                        names,
                    )
        store.move(passing, path)

    ordered = (
        text_rows(docs, F.col("doc_id").cast("long"))
        .repartitionByRange(shards, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    )
    return ordered.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def write_index(manifest: DataFrame, uri: str, buckets: int) -> DataFrame:
    """Build and write the buckets of the index; one row per bucket with its number of keys."""

    def build(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        col = lambda c: rows.column(c).to_numpy()
        raw = Index.pack(_hashes(rows), col("shard"), col("offset"), col("n_tokens"))
        write_once(index_name(uri, bucket), raw)
        return pa.table({"n_keys": [rows.num_rows]})

    keyed = manifest.withColumn("bucket", bucket_of(buckets))
    return keyed.groupBy("bucket").applyInArrow(build, "n_keys long")


def bucket_of(buckets: int):
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(buckets)).cast("int")


def _hashes(rows) -> np.ndarray:
    doc = rows.column("doc_id")
    null = doc.is_null().to_numpy(zero_copy_only=False)
    copy = rows.column("copy").to_numpy(zero_copy_only=False)
    return key_hash(doc.fill_null(0).to_numpy(zero_copy_only=False), copy, np.asarray(null))


def find(keys: DataFrame, uri: str, buckets: int) -> DataFrame:
    """Look keys (``doc_id``, ``copy``) up in the index; keys that no document has are left out."""

    def look(rows: pa.Table) -> pa.Table:
        store, path = file_system(index_name(uri, rows.column("bucket")[0].as_py()))
        with store.open_input_file(path) as f:
            held, shard, offset, size = Index(f.read()).find(_hashes(rows))
        found = rows.select(["doc_id", "copy"])
        for c, v in (("shard", shard), ("offset", offset), ("n_tokens", size)):
            found = found.append_column(c, pa.array(v, pa.int64()))
        return found.filter(pa.array(held))

    return keys.withColumn("bucket", bucket_of(buckets)).groupBy("bucket").applyInArrow(
        look, "doc_id long, copy long, shard long, offset long, n_tokens long"
    )


def read_ids(found: DataFrame, uri: str, tokenizer: str, shards: int) -> DataFrame:
    """Read the ids of looked-up documents from the shards, in file order, and their checksum."""
    names = ["doc_id", "copy", "shard", "offset", "n_tokens", "ids_crc32"]

    def run(batches):
        kind = np.dtype(encoder(tokenizer).type).newbyteorder("<")
        opened, at = None, None
        for rows in batches:
            shard, offset, size = (rows.column(c).to_pylist() for c in ("shard", "offset", "n_tokens"))
            sums = []
            for s, o, n in zip(shard, offset, size, strict=True):
                if s != at:
                    if opened is not None:
                        opened.close()
                    store, path = file_system(shard_name(uri, s))
                    opened, at = store.open_input_file(path), s
                crc = 0
                for p in range(o, o + n, 1 << 18):
                    q = min(o + n, p + (1 << 18))
                    raw = opened.read_at((q - p) * kind.itemsize, p * kind.itemsize)
                    crc = zlib.crc32(np.frombuffer(raw, kind).astype("<u4").tobytes(), crc)
                sums.append(crc)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(sums, pa.int64())], names)
        if opened is not None:
            opened.close()

    return (
        found.repartitionByRange(shards, "shard", "offset").sortWithinPartitions("shard", "offset")
        .mapInArrow(run, ", ".join(f"{c} long" for c in names))
    )


class Output:
    """What ``write`` has written."""

    def __init__(self, uri, tokenizer, shards, buckets, manifest) -> None:
        self.uri, self.tokenizer, self.shards, self.buckets = uri, tokenizer, shards, buckets
        self.manifest: DataFrame = manifest

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """Documents by key (all that were written, if none are given), read from the files."""
        keys = self.manifest.select("doc_id", "copy") if keys is None else keys
        return read_ids(find(keys, self.uri, self.buckets), self.uri, self.tokenizer, self.shards)

    def starts(self) -> DataFrame:
        """Ids in the shards before each shard; one row per shard."""
        spark: SparkSession = self.manifest.sparkSession
        totals = self.manifest.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()
        base, rows = 0, []
        for shard, n in sorted((r.shard, r.n) for r in totals):
            rows.append((shard, base))
            base += n
        schema = T.StructType([T.StructField(c, T.LongType()) for c in ("shard", "base")])
        return spark.createDataFrame(rows, schema)


def write(docs: DataFrame, uri: str, tokenizer: str) -> Output:
    """Encode all documents and write shards and index below ``uri``."""
    n, size = docs.select(F.count("*"), F.sum(F.octet_length(F.coalesce("text", F.lit(""))))).first()
    shards = int(max(1, -(-(size or 0) // SHARD_BYTES), min(docs.sparkSession.sparkContext.defaultParallelism * 2, n // 64)))
    buckets = int(max(1, n // BUCKET_KEYS))
    manifest = staged(write_shards(docs, uri, tokenizer, shards), "manifest")
    write_index(manifest, uri, buckets).agg(F.sum("n_keys")).collect()
    return Output(uri, tokenizer, shards, buckets, manifest)


def documents_of(output: Output) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids_crc32``."""
    return output.read().join(output.starts(), "shard").select(
        "doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32"
    )
