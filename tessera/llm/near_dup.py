"""Near-duplicate documents by SetSketch registers.

Each document's set of word shingles is sketched by registers of exponentially spaced truncated
minima (base b, rate a): register = floor(1 - log_b(smallest exponential hash)), held between 0 and
q + 1. The registers of a union are the larger registers of its parts, so sketches can be merged.
Two sets share a register with a probability close to their Jaccard similarity.

1. Equal sets collapse into one class, whose node is the smallest doc_id.
2. Bands of registers give buckets. Each node is first paired with one hub: of the smallest nodes of its
   buckets the one that it shares most buckets with. Then it is paired with the smallest and the largest
   node of each of its buckets that are in other components so far, so that a large group, which one
   hub has joined, gives no more than a pair for each node.
3. A pair whose joint likelihood (counts of larger, smaller and equal registers, given both exact set
   sizes) speaks strongly against the threshold is dropped; the others are confirmed on full sets. A
   hub's text goes out once for every PARTNERS of its partners, not once with each.
4. Confirmed links give components; later links join these, so that each round looks at its own links
   only. While buckets of over BLOCK nodes hold several components, their
   nodes are paired with new hubs, drawn by hash, as long as that joins components: each round again
   gives rows in proportion to the nodes, and what is near to many others is joined after a few.
5. Buckets that still hold several components are searched completely within tasks, between
   components only, each pair in the first bucket that it shares. A bucket's largest component is
   never compared with itself: blocks of the other nodes meet each other and all blocks of it, so m
   nodes outside of it among n give about m * n / BLOCK rows. That is in proportion to n where few are
   outside; it grows with the square only for a large bucket of nodes that share a band and yet are
   not linked with each other, as then all pairs have to be told apart. Full sets are compared within
   tasks too, and of the links found there those are returned that join components.

The registers' hashes are affine maps of 32 bits of a mixed 64-bit hash: pairwise independent, so minima
are only about independent of each other. Recall is therefore measured against brute force, not assumed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, checkpointed, has_caches, map_arrow, read_table, release
from tessera.llm.graph import components, joined, labelled

#: Registers, registers in a band; sketch base, rate and largest value less one.
REGISTERS, BAND = 128, 4
BASE, RATE, LIMIT = 1.001, 20.0, 2**16 - 2
#: A pair is dropped where twice the log-likelihood ratio against the threshold is over this (5.5 standard errors).
AGAINST = 30.0
#: Nodes of one block in the complete search of a bucket; partners of a hub that share a copy of its text; rounds of new hubs at most.
BLOCK, PARTNERS, ROUNDS = 256, 256, 8

_RNG = np.random.default_rng(7_2024)
_MULTIPLY = (_RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32) | np.uint32(1))[:, None]
_ADD = _RNG.integers(0, 2**32, REGISTERS, dtype=np.uint32)[:, None]
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))


def _finish(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class WordHashes(dict):
    """64-bit hashes of words, with a bounded memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_WORDS = WordHashes()
has_caches(__name__, _WORDS.clear)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles of `size` words; ASCII letters are lower-cased first."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    get = _WORDS.__getitem__
    h = np.array([get(w) for w in words], np.uint64)
    if len(h) < size:
        short = np.uint64(len(h))
        for x in h.tolist():
            short = np.uint64((int(short) * 0x9E3779B97F4A7C15 + x) % 2**64)
        return _finish(np.array([short], np.uint64))
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ (h[k : k + n] * _MIX[k % 4])) * _MIX[(k + 1) % 4] + np.uint64(k + 1)
    return np.unique(_finish(out))


def registers(shingles: np.ndarray) -> np.ndarray:
    """The SetSketch registers of a set of hashes, unsigned 16-bit."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, np.uint32(2**32 - 1))
    for at in range(0, len(x), 1024):
        h = _MULTIPLY * x[at : at + 1024]
        h += _ADD
        np.minimum(least, h.min(axis=1), out=least)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LIMIT + 1).astype("<u2")


def merged(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(left, right)


def _share(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def similarity(larger: np.ndarray, smaller: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The likeliest Jaccard similarity given counts of larger and smaller registers and exact set sizes, and twice the log-likelihood ratio of it against `least`."""
    u = (n_left / (n_left + n_right))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    grid = np.concatenate([np.linspace(0, 1, 41)[None, :] * top, np.minimum(least, top)], axis=1)
    more, less = _share(u - v * grid), _share(v - u * grid)
    tiny = 1e-9
    likelihood = larger[:, None] * np.log(np.maximum(more, tiny)) + smaller[:, None] * np.log(np.maximum(less, tiny)) + (REGISTERS - larger - smaller)[:, None] * np.log(np.maximum(1 - more - less, tiny))
    best = likelihood.argmax(axis=1)
    rows = np.arange(len(best))
    return grid[rows, best], 2 * (likelihood[rows, best] - likelihood[:, -1])


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of register rows may reach the threshold."""
    found, against = similarity((a > b).sum(axis=1), (a < b).sum(axis=1), n_a.astype(float), n_b.astype(float), percent / 100)
    sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return sizes & ((found >= percent / 100) | (against <= AGAINST))


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(doc_id, n_shingles, key, registers): key is a 128-bit digest of the set, null for an empty one."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, keys, regs = [], [], []
        for text in batch.column(1).to_pylist():
            s = shingle_set(text, size)
            n.append(len(s))
            keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            regs.append(registers(s).tobytes() if len(s) else None)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "n_shingles", "key", "registers"])

    return map_arrow(docs, of, f"doc_id {dict(docs.dtypes)['doc_id']}, n_shingles long, key binary, registers binary")


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches don't rule the threshold out."""
    left = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("registers").alias("r_a"))
    right = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("registers").alias("r_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")

    def of(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not batch.num_rows:
            return None
        r_a, r_b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, REGISTERS) for k in (4, 5))
        ok = plausible(r_a, r_b, batch.column(2).to_numpy(), batch.column(3).to_numpy(), percent)
        return batch.select(["a", "b"]).filter(pa.array(ok))

    return map_arrow(both, of, "a long, b long")


def _alike(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sets of sorted distinct hashes reach the threshold."""
    if not len(s) or not len(t) or 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
        return False
    at = np.searchsorted(t, s)
    at[at == len(t)] = 0
    common = int((t[at] == s).sum())
    return 100 * common >= percent * (len(s) + len(t) - common)


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the threshold: a is the hub, whose text comes before those of its partners."""
    shares = checkpointed(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("shares")))
    hubs = shares.join(texts.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("b"), "text")
    partners = pairs.join(shares, "a").select("a", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"), "b").join(texts.withColumnRenamed("node", "b"), "b").select("a", "share", "b", "text")
    rows = hubs.union(partners).repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
    bounded_batches(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets = None, []
        for batch in batches:
            out = []
            for a, share, b, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if (a, share) != at:
                    at, sets = (a, share), []
                if b is None:
                    sets.append(shingle_set(text, size))
                else:
                    own = shingle_set(text, size)
                    if any(_alike(s, own, percent) for s in sets):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Documents are linked where 100 * shared shingles >= percent * all shingles of both. component_id
    is the smallest doc_id reachable, kept tells whether it is the document's own. A text with fewer
    than `size` words is one shingle; null and blank texts have none, are linked with nothing and
    kept. Rows that share a doc_id are one document. A row with a null doc_id can't take part: its
    component_id is null and it is kept. Whole texts are read, however long. doc_id must be an integer;
    other columns are not read, whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = checkpointed(sketches(docs, "doc_id", "text", size))
    whole = rows.where("key is not null and doc_id is not null")
    classes = whole.groupBy("key").agg(F.min("doc_id").alias("node"))
    nodes = checkpointed(classes.join(whole.select(F.col("doc_id").alias("node"), "key", "n_shingles", "registers"), ["key", "node"]).dropDuplicates(["key"]))

    bands = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1))).alias("band"), "registers").select(F.xxhash64("band", F.expr(f"substring(registers, {2 * BAND} * band + 1, {2 * BAND})")).alias("bucket"), "band", "node")
    buckets = bands.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low < high")
    members = checkpointed(bands.join(buckets, "bucket"))

    same_id = whole.groupBy("doc_id").agg(F.min("key").alias("k0"), F.max("key").alias("k1")).where("k0 != k1").select("doc_id")
    copies = whole.join(same_id, "doc_id").join(classes, "key").select(F.col("doc_id").alias("a"), F.col("node").alias("b")).where("a != b")

    involved = members.select("node").distinct()
    texts = checkpointed(docs.where("doc_id is not null and text is not null").join(involved.withColumnRenamed("node", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text").distinct())
    release(spark)
    links = checkpointed(_confirmed(_estimated(_first_hubs(members), nodes, percent), texts, size, percent).union(copies).distinct())
    labels = None if links.isEmpty() else components(links)
    for k in range(-1, ROUNDS):
        release(spark)
        pairs = checkpointed(_hubs(members, labels) if k < 0 else _drawn(members, labels, k))
        new = None if pairs.isEmpty() else checkpointed(_confirmed(_estimated(pairs, nodes, percent), texts, size, percent))
        if new is not None and not new.isEmpty():
            labels = joined(labels, new)
        elif k >= 0:
            break

    release(spark)
    more = checkpointed(_between(members, nodes, texts, labels, size, percent))
    if not more.isEmpty():
        labels = joined(labels, more)

    of_key = labelled(classes, labels).select("key", "component")
    found = rows.join(of_key, "key", "left") if labels is not None else rows.join(classes.select("key", F.col("node").alias("component")), "key", "left")
    found = found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _first_hubs(members: DataFrame) -> DataFrame:
    """Pairs (a, b): for each node the smallest node of its buckets that it shares most buckets with, the smaller one of equals."""
    shared = members.where("node != low").select("node", "low").repartition("node").groupBy("node", "low").agg(F.count("*").alias("n"))
    best = shared.groupBy("node").agg(F.max(F.struct(F.col("n"), (-F.col("low")).alias("minus"))).alias("best"))
    return best.select((-F.col("best.minus")).alias("a"), F.col("node").alias("b"))


def _hubs(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Pairs (a, b) of the smallest and the largest node of each bucket and its nodes that are in other components so far."""
    of = labelled(members.select("bucket", "node"), labels)
    node = F.struct("node", "component")
    ends = of.groupBy("bucket").agg(F.min(node).alias("x"), F.max(node).alias("y"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1")
    ends = ends.select("bucket", F.explode(F.array("x", "y")).alias("hub")).select("bucket", F.col("hub.node").alias("a"), F.col("hub.component").alias("c"))
    # a pair of the two hubs themselves is told once
    pairs = of.join(ends, "bucket").where("component != c").select(F.least("a", "node").alias("x"), F.greatest("a", "node").alias("y"), F.col("a"), F.col("node").alias("b"))
    return pairs.groupBy("x", "y").agg(F.min("a").alias("a")).select("a", F.when(F.col("a") == F.col("x"), F.col("y")).otherwise(F.col("x")).alias("b"))


def _drawn(members: DataFrame, labels: DataFrame | None, k: int) -> DataFrame:
    """Pairs (a, b) of new hubs and the nodes of their bucket that are in other components so far, for buckets of over BLOCK nodes."""
    of = labelled(members.where(F.col("n") > BLOCK), labels)
    draw = F.struct(F.xxhash64(F.lit(k), "node").alias("h"), "node", "component")
    hubs = of.groupBy("bucket").agg(F.min(draw).alias("x"), F.max(draw).alias("y"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1")
    hubs = hubs.select("bucket", F.explode(F.array("x", "y")).alias("hub")).select("bucket", F.col("hub.node").alias("a"), F.col("hub.component").alias("c"))
    return of.join(hubs, "bucket").where("component != c").select("a", F.col("node").alias("b")).distinct()


def _between(members: DataFrame, nodes: DataFrame, texts: DataFrame, labels: DataFrame | None, size: int, percent: int) -> DataFrame:
    """Links (a, b) that join nodes which share a bucket and are in different components so far."""
    of = checkpointed(labelled(members, labels))
    parts = of.groupBy("bucket", "component").agg(F.count("*").alias("m"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("m", "component")).alias("main"), F.sum("m").alias("n"), F.count("*").alias("several")).where("several > 1")
    # buckets of a block or less go to one task; of others the largest component has blocks of its own
    split = F.col("n") > BLOCK
    mixed = mixed.select("bucket", F.when(split, F.col("main.component")).alias("main"), F.when(split, F.ceil((F.col("n") - F.col("main.m")) / BLOCK)).otherwise(1).cast("int").alias("blocks"), F.when(split, F.ceil(F.col("main.m") / BLOCK)).otherwise(0).cast("int").alias("main_blocks"))
    left = of.drop("n").join(mixed, "bucket").withColumn("is_main", F.col("component").eqNullSafe(F.col("main")))
    left = left.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("main_blocks")).otherwise(F.col("blocks"))).cast("int"))
    # tasks are told by i, a block of other nodes, and j, another such block or -1 less a block of the largest component
    with_others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least("own", x).alias("i"), F.greatest("own", x).alias("j")))
    with_main = F.when(F.col("main_blocks") > 0, F.transform(F.sequence(F.lit(1), F.col("main_blocks")), lambda x: F.struct(F.col("own").alias("i"), (-x).alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    of_main = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(x.alias("i"), (-1 - F.col("own")).alias("j")))
    dealt = left.withColumn("task", F.explode(F.when(F.col("is_main"), of_main).otherwise(F.concat(with_others, with_main)))).select("bucket", "task.i", "task.j", "own", "is_main", "band", "node", "component")
    dealt = dealt.join(nodes.select("node", "n_shingles", "registers"), "node").select("bucket", "i", "j", "own", "is_main", "band", "node", "component", "n_shingles", "registers")

    def searched(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own, node, component, n = (table.column(c).to_numpy() for c in ("own", "node", "component", "n_shingles"))
        is_main = table.column("is_main").to_numpy(zero_copy_only=False)
        regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), "<u2").reshape(-1, REGISTERS)
        band, i, j = (table.column(c)[0].as_py() for c in ("band", "i", "j"))
        earlier = np.ascontiguousarray(regs).view("<u8")[:, :band]
        partners: dict[int, list[int]] = {}
        for k in np.flatnonzero(~is_main & (own == i)).tolist():
            at = np.flatnonzero((component != component[k]) & (is_main if j < 0 else own == j if i != j else node > node[k]))
            at = at[(regs[at] == regs[k]).sum(axis=1) >= REGISTERS * (percent / 100 - 0.25)]
            at = at[~(earlier[at] == earlier[k]).any(axis=1)]
            if len(at):
                at = at[plausible(np.broadcast_to(regs[k], (len(at), REGISTERS)), regs[at], np.full(len(at), n[k]), n[at], percent)]
            if len(at):
                partners.setdefault(k, []).extend(node[at].tolist())
                for x in at.tolist():
                    partners.setdefault(x, [])
        rows = sorted(partners)
        found = table.select(["bucket", "i", "j", "node", "component"]).take(pa.array(rows, pa.int64()))
        return found.append_column("partners", pa.array([partners[k] for k in rows], pa.list_(pa.int64())))

    wanted = dealt.groupBy("bucket", "i", "j").applyInArrow(searched, "bucket long, i int, j int, node long, component long, partners array<long>")

    def confirmed(table: pa.Table) -> pa.Table:
        rows = table.select(["node", "component", "partners", "text"]).to_pylist()
        sets = {}
        for r in rows:
            sets.setdefault(r["node"], []).append(shingle_set(r["text"], size))
        top = {r["node"]: r["component"] for r in rows}
        joined: dict[int, int] = {}

        def root(x: int) -> int:
            while joined.get(x, x) != x:
                x = joined[x] = joined.get(joined[x], joined[x])
            return x

        out = set()
        for r in rows:
            for b in r["partners"]:
                a = r["node"]
                x, y = root(top[a]), root(top[b])
                if x != y and any(_alike(s, t, percent) for s in sets[a] for t in sets[b]):
                    joined[max(x, y)] = min(x, y)
                    out.add((min(a, b), max(a, b)))
        return pa.table({"a": pa.array([a for a, _ in sorted(out)], pa.int64()), "b": pa.array([b for _, b in sorted(out)], pa.int64())})

    return wanted.join(texts, "node").select("bucket", "i", "j", "node", "component", "partners", "text").groupBy("bucket", "i", "j").applyInArrow(confirmed, "a long, b long")


def op2_near_dup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept by 4-word shingles at 80 percent."""
    return near_duplicates(read_table(spark, sf_dir, "documents"), size=4, percent=80)
