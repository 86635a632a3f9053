"""Token ids in shards compressed by a Re-Pair grammar, with random access.

A shard holds documents of adjoining ids. Rounds replace its frequent pairs of ids by nonterminals:
each round counts all pairs of the sequence exactly, takes the most frequent ones (up to PAIRS) and
replaces their occurrences from left to right; rounds go on until no pair occurs LEAST times. The
container keeps the rules, the length of every symbol's expansion (found again from the rules on
opening) and the sum of expansion lengths at every STRIDE-th symbol, so that a range of tokens is
decoded without the ones before it.

Layout of a container (little-endian): magic "RPG2", then unsigned 32-bit numbers of rules, symbols,
documents and checkpoints, the base (first nonterminal), unsigned 64-bit number of tokens; rules as
pairs of unsigned 32-bit symbols; a byte that tells the bits of a symbol, then the sequence packed
with that many bits for each symbol, lowest bits first, and eight bytes of padding; unsigned 64-bit
token offsets at the checkpoints; unsigned 32-bit token counts of documents.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import encoder
from tessera.llm.common import at_work, bounded_batches, read_table, remove_at_exit, shared_dir

#: Symbols between two checkpoints of a container.
STRIDE = 1024
#: Tokens after which a shard's container is closed; bounds the memory of a task.
CONTAINER_TOKENS = 4_000_000
#: Bytes of text that are encoded at a time, from as many batches as it takes.
GROUP_BYTES = 8_000_000
#: Shards whose first tokens are broadcast (64 bytes each); beyond it the join is shuffled. Shards added up in one task.
BROADCAST_SHARDS, SHARDS = 1_000_000, 1024
#: Pairs replaced in a round, and the least count of a pair.
PAIRS, LEAST = 8192, 12
_HEAD = struct.Struct("<4sIIIIIQ")


def _keys(seq: np.ndarray, narrow: bool) -> np.ndarray:
    """One number for each adjoining pair; 32 bits where all symbols have 16."""
    return (seq[:-1] << np.uint32(16)) | seq[1:] if narrow else (seq[:-1].astype(np.uint64) << np.uint64(32)) | seq[1:]


def _slots(keys: np.ndarray) -> np.ndarray:
    """A 20-bit hash of each key."""
    if keys.dtype == np.uint32:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(12)
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)


def _replace(seq: np.ndarray, keys: np.ndarray, at: np.ndarray | None, pairs: np.ndarray, first: int) -> np.ndarray:
    """seq with the occurrences of the sorted pairs replaced by first, first + 1, ..., from left to right. at: the places where they can be."""
    number_of = np.full(2**20, -1, np.int16 if len(pairs) < 2**15 else np.int32)
    number_of[_slots(pairs)] = np.arange(len(pairs))
    number = number_of[_slots(keys if at is None else keys[at])]
    hit = np.flatnonzero(number >= 0)
    number = number[hit].astype(np.int64)
    hit = hit if at is None else at[hit]
    other = np.flatnonzero(pairs[number] != keys[hit])  # slots that pairs share with others
    number[other] = np.minimum(np.searchsorted(pairs, keys[hit[other]]), len(pairs) - 1)
    ok = pairs[number] == keys[hit]
    hit, number = hit[ok], number[ok]
    # of a run of overlapping hits, every second one is taken
    breaks = np.flatnonzero(np.diff(hit) != 1) + 1
    run_start = np.zeros(len(hit), np.int64)
    run_start[breaks] = breaks
    ok = (np.arange(len(hit)) - np.maximum.accumulate(run_start)) % 2 == 0
    hit, number = hit[ok], number[ok]
    out = seq.copy()
    out[hit] = first + number
    keep = np.ones(len(seq), bool)
    keep[hit + 1] = False
    return out[keep]


def compress(seq: np.ndarray, lengths: list[int]) -> bytes:
    """A container of the token sequence of documents with these lengths."""
    seq = np.ascontiguousarray(seq, np.uint32)
    total = len(seq)
    base = first = int(seq.max()) + 1 if total else 1
    rules, newest = [], 0
    while len(seq) >= LEAST:
        narrow = first < 65_536
        room = min(PAIRS, 65_536 - first) if narrow else PAIRS
        keys = _keys(seq, narrow)
        # when all frequent pairs have been replaced, only those with a symbol of the last round can have become frequent
        at = np.flatnonzero((seq[1:] >= newest) | (seq[:-1] >= newest)) if newest else None
        ordered = np.sort(keys if at is None else keys[at])
        # a pair that occurs LEAST times is equal to itself LEAST - 1 places on
        often = ordered[: max(len(ordered) - LEAST + 1, 0)]
        often = often[often == ordered[LEAST - 1 :]]
        often = often[np.diff(often, prepend=~often[:1]) != 0]
        if not len(often):
            break
        whole = len(often) <= room
        if not whole:
            counts = np.searchsorted(ordered, often, side="right") - np.searchsorted(ordered, often)
            often = np.sort(often[np.argsort(-counts, kind="stable")[:room]])
        shift, mask = (np.uint32(16), np.uint32(0xFFFF)) if narrow else (np.uint64(32), np.uint64(0xFFFFFFFF))
        rules.append(np.stack([often >> shift, often & mask], axis=1).astype("<u4"))
        seq = _replace(seq, keys, at, often, first)
        newest = first if whole else 0
        first += len(often)
    rule = np.concatenate(rules) if rules else np.empty((0, 2), "<u4")
    spans = _expansion_lengths(rule, base)[seq] if total else np.empty(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(spans)])[: len(seq) + 1 : STRIDE].astype("<u8")
    bits = max(first - 1, 1).bit_length()
    return b"".join([_HEAD.pack(b"RPG2", len(rule), len(seq), len(lengths), len(offsets), base, total), rule.tobytes(), bytes([bits]), _packed(seq, bits), offsets.tobytes(), np.array(lengths, "<u4").tobytes()])


def _packed(seq: np.ndarray, bits: int) -> bytes:
    """Symbols of so many bits one after the other, and eight bytes of padding."""
    parts = []
    for at in range(0, len(seq), 65_536):  # a multiple of eight symbols fills whole bytes
        part = seq[at : at + 65_536].astype("<u4")
        parts.append(np.packbits(np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes())
    return b"".join(parts) + bytes(8)


def _unpacked(data: np.ndarray, bits: int, start: int, stop: int) -> np.ndarray:
    """Symbols start to stop of packed bytes."""
    at = np.arange(start, stop, dtype=np.int64) * bits
    first = at >> 3
    word = np.zeros(len(at), np.uint64)
    for k in range((bits + 14) // 8):
        word |= data[first + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


def _expansion_lengths(rule: np.ndarray, base: int) -> np.ndarray:
    """Tokens that each symbol stands for. A rule refers to earlier symbols only."""
    size = np.ones(base + len(rule), np.int64)
    done = 0
    while done < len(rule):  # all rules that refer to finished symbols, at once
        ready = rule[done:].max(axis=1) < base + done
        upto = done + (len(ready) if ready.all() else int(ready.argmin()))
        upto = max(upto, done + 1)
        size[base + done : base + upto] = size[rule[done:upto, 0]] + size[rule[done:upto, 1]]
        done = upto
    return size


class Container:
    """Random access to a container's tokens."""

    def __init__(self, data: bytes):
        magic, n_rules, n_symbols, n_docs, n_offsets, self.base, self.tokens = _HEAD.unpack_from(data)
        if magic != b"RPG2":
            raise ValueError("not a container of tokens")
        at = _HEAD.size
        self.rules = np.frombuffer(data, "<u4", 2 * n_rules, at).reshape(-1, 2)
        at += 8 * n_rules
        self.bits, self.n_symbols = data[at], n_symbols
        size = -(-n_symbols * self.bits // 8) + 8
        self.packed = np.frombuffer(data, np.uint8, size, at + 1)
        at += 1 + size
        self.offsets = np.frombuffer(data, "<u8", n_offsets, at)
        self.lengths = np.frombuffer(data, "<u4", n_docs, at + 8 * n_offsets)
        self.sizes = _expansion_lengths(self.rules, self.base)
        self.flat = None

    def _flat(self) -> tuple[np.ndarray, np.ndarray]:
        """All rules' expansions one after the other, and where each symbol's begins; plain ids come first."""
        if self.flat is None:
            starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
            flat = np.arange(int(self.sizes.sum()), dtype=np.uint32)
            for k, (a, b) in enumerate(self.rules.tolist()):
                at, n, m = starts[self.base + k], self.sizes[a], self.sizes[b]
                flat[at : at + n] = flat[starts[a] : starts[a] + n]
                flat[at + n : at + n + m] = flat[starts[b] : starts[b] + m]
            self.flat = flat, starts
        return self.flat

    def _expanded(self, symbols: np.ndarray) -> np.ndarray:
        flat, starts = self._flat()
        sizes = self.sizes[symbols]
        ends = np.cumsum(sizes)
        if not len(ends):
            return np.empty(0, np.uint32)
        return flat[np.repeat(starts[symbols] - (ends - sizes), sizes) + np.arange(ends[-1])]

    def symbols(self, start: int, stop: int) -> np.ndarray:
        return _unpacked(self.packed, self.bits, start, min(stop, self.n_symbols))

    def read(self, start: int, stop: int) -> np.ndarray:
        """Tokens start to stop of the shard; symbols outside the range's checkpoints are not touched."""
        if stop <= start:
            return np.empty(0, np.uint32)
        block = int(np.searchsorted(self.offsets, start, side="right")) - 1
        last = int(np.searchsorted(self.offsets, stop, side="left"))
        symbols = self.symbols(block * STRIDE, last * STRIDE)
        ends = int(self.offsets[block]) + np.cumsum(self.sizes[symbols])
        a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left"))
        begin = int(ends[a] - self.sizes[symbols[a]])
        return self._expanded(symbols[a : b + 1])[start - begin : stop - begin]

    def documents(self) -> Iterator[np.ndarray]:
        """All documents' tokens in order."""
        whole, at = self._expanded(self.symbols(0, self.n_symbols)), 0
        for n in self.lengths.tolist():
            yield whole[at : at + n]
            at += n


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Ids and texts of batches put together until they have GROUP_BYTES."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(1).nbytes
        if size >= GROUP_BYTES:
            yield tuple(pa.concat_arrays([b.column(k) for b in held]) for k in range(2))
            held, size = [], 0
    if held:
        yield tuple(pa.concat_arrays([b.column(k) for b in held]) for k in range(2))


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, tokenizer: str | None = None) -> None:
    """Encode whole texts, append end_id to each, and write containers in ascending doc_id order.

    The rows go to range partitions of doc_id (and of a hash of the text, so that a hot id is split);
    each task writes its containers through Spark's own writer, so any store works and a repeated task
    leaves no second copy. Files have a row for each container: shard (partition), number (of the
    container in it), before (tokens of the shard's containers before it), tokens, doc_ids and data.
    Null and empty texts give end_id alone. Null ids come first; rows of equal ids follow each other
    in the order of a hash of their texts. Texts of any length are encoded whole. Other columns are not
    read, whatever their names. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = docs.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at_work(__name__)
        shard, number, held, before = TaskContext.get().partitionId(), 0, 0, 0
        ids, parts, lengths = [], [], []

        def closed() -> pa.RecordBatch:
            data = compress(np.concatenate(parts), lengths)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([held], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([data], pa.binary())], names=["shard", "number", "before", "tokens", "doc_ids", "data"])

        for doc_ids, texts in _groups(batches):
            pieces, sizes = encoder(tokenizer).spans(texts, end_id)
            piece, at = np.empty(0, "<u4"), 0
            for doc_id, n in zip(doc_ids.to_pylist(), sizes.tolist()):
                ids.append(doc_id)
                lengths.append(n)
                held += n
                while n:
                    if at == len(piece):
                        piece, at = next(pieces), 0
                    parts.append(piece[at : at + n])
                    at, n = at + len(parts[-1]), n - len(parts[-1])
                if held >= CONTAINER_TOKENS:
                    yield closed()
                    number, before, held, ids, parts, lengths = number + 1, before + held, 0, [], [], []
        if ids:
            yield closed()

    ordered.mapInArrow(run, "shard int, number int, before long, tokens long, doc_ids array<long>, data binary").write.parquet(path)


def _starts(stored: DataFrame) -> DataFrame:
    """(shard, start): the tokens of all shards before. Shards are added up by SHARDS, then these sums, so that no task gets a row for each container."""
    totals = stored.groupBy("shard").agg(F.sum("tokens").alias("tokens")).withColumn("of", F.floor(F.col("shard") / SHARDS))
    within = Window.partitionBy("of").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sums = totals.groupBy("of").agg(F.sum("tokens").alias("tokens"))
    over = sums.select("of", F.coalesce(F.sum("tokens").over(Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return totals.select("shard", "of", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("inner")).join(over, "of").select("shard", (F.col("base") + F.col("inner")).alias("start"))


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) from the files: start is the number of tokens of all documents before."""
    stored = spark.read.parquet(path)
    starts = _starts(stored)
    # a narrow row for each partition of the writing stage
    starts = F.broadcast(starts) if starts.limit(BROADCAST_SHARDS + 1).count() <= BROADCAST_SHARDS else starts
    placed = stored.join(starts, "shard").select((F.col("start") + F.col("before")).alias("start"), "doc_ids", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at, ids, data = (batch.column(c)[k].as_py() for c in range(3))
                rows = []
                for doc_id, tokens in zip(ids, Container(data).documents()):
                    rows.append((doc_id, at, len(tokens), tokens.astype("<u4").tobytes()))
                    at += len(tokens)
                    if len(rows) == 512:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    ids, starts, lengths, data = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(data, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def op10_token_store(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files, which go when the process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    remove_at_exit(spark, path)
    write_tokens(read_table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
