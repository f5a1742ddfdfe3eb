"""SimHash near-duplicate classes found by anchor-point covering.

Fingerprints
    A-Z are lower-cased, words are runs of anything but space and tab..CR, the
    shingles are three words joined by a space (repeats count; a shorter text
    is one shingle of all its words). A bit is 1 if it is set in more than half
    of the shingles' XXH64 values (seed 42). A text without words has
    fingerprint zero and links like any other.

Covering
    Two fingerprints within three bits agree to one bit in at least one of
    their two 32-bit halves. In each half the anchors are the words of the
    perfect (31, 26) Hamming code, with the last bit free: covering radius 1.
    A fingerprint goes to every anchor within radius plus threshold,
    1 + 1 = 2, of a half: at most 17. Its nearest anchor is its home, and of
    any two halves within one bit the one reaches the other's home. So each
    linking pair meets at the home anchor of one of them, and a comparison at
    an anchor needs one partner at home there.

Scale
    Only distinct fingerprints are compared, so a group of exact copies of any
    size is one node. Anchors with more than ``BLOCK`` members are cut into
    blocks that meet pairwise in separate keys. Each task reduces the links it
    finds to a forest, a star through each class that it sees, so links grow
    with the nodes, never with the square of a group. Components are joined by
    hooking and pointer jumping over tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm._scratch import Scratch, schema

SEED = 42
SHINGLE = 3
THRESHOLD = 3
#: Members of an anchor that are compared as one group; larger anchors are cut into blocks of about this size.
BLOCK = 1024
#: A table of hot anchors of at most this many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
#: Shingles hashed at a time, which bounds the memory a long text takes.
SLICE = 65_536

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_POSITION = np.arange(1, 32, dtype=np.uint32)
_SHIFT = np.arange(31, dtype=np.uint32)


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a text; null counts as empty."""
    # bytes.split() parts words at exactly space and \t..\r.
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)
    n = len(words) - SHINGLE + 1
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, SLICE):
        part = words[at : at + SLICE + SHINGLE - 1]
        hashes = np.fromiter((digest(b"%b %b %b" % three, SEED) for three in zip(part, part[1:], part[2:])), dtype=np.uint64, count=len(part) - SHINGLE + 1)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def _syndrome(half: np.ndarray) -> np.ndarray:
    """Hamming syndrome of bits 0..30: the position, from 1, of the bit to flip to reach the code, 0 for code words."""
    out = np.zeros(half.shape, dtype=np.uint32)
    for at in range(31):
        out ^= ((half >> np.uint32(at)) & np.uint32(1)) * np.uint32(at + 1)
    return out


def anchors_of(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors within two bits of each 32-bit half, home first; (n, 17) values and a mask of those that exist."""
    syndrome = _syndrome(half)
    flip = np.where(syndrome > 0, np.uint32(1) << (np.maximum(syndrome, 1) - 1).astype(np.uint32), np.uint32(0)).astype(np.uint32)
    home = half ^ flip
    out = np.empty((len(half), 18), dtype=np.uint32)
    there = np.zeros(out.shape, dtype=bool)
    out[:, 0], there[:, 0] = home, True
    out[:, 1], there[:, 1] = home ^ np.uint32(1 << 31), True  # the free bit flipped: at most two bits away
    # Positions p < q with p xor q equal to the syndrome: flipping both reaches another code word.
    other = _POSITION[None, :] ^ syndrome[:, None]
    pairs = (other > _POSITION[None, :]) & (syndrome[:, None] > 0)
    rank = np.cumsum(pairs, axis=1) + 1
    rows, at = np.nonzero(pairs)
    out[rows, rank[rows, at]] = half[rows] ^ (np.uint32(1) << _SHIFT[at]) ^ (np.uint32(1) << (other[rows, at] - 1).astype(np.uint32))
    there[rows, rank[rows, at]] = True
    return out, there


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        all_prints = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for at in range(0, len(all_prints), 8192):
            signed = all_prints[at : at + 8192]
            prints = signed.view(np.uint64)
            keys, owners, homes = [], [], []
            for part in (0, 1):
                values, there = anchors_of(((prints >> np.uint64(32 * part)) & np.uint64(0xFFFFFFFF)).astype(np.uint32))
                rows, columns = np.nonzero(there)
                keys.append(values[rows, columns].astype(np.int64) * 2 + part)
                owners.append(signed[rows])
                homes.append(columns == 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(owners)), pa.array(np.concatenate(homes))], names=["anchor", "fp", "home"])


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes over the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        root = new
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _links(key: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars, centred on the smallest fingerprint, of the classes that comparisons within equal neighbouring keys link."""
    node, at = np.unique(fp, return_inverse=True)
    lefts, rights = [], []
    prints = fp.view(np.uint64)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    lengths = np.diff(np.r_[starts, len(key)])
    step, alive = 1, np.arange(len(key))
    small = np.repeat(lengths, lengths) <= 32
    alive = alive[small]
    while len(alive):
        alive = alive[alive + step < len(key)]
        alive = alive[key[alive] == key[alive + step]]
        near = (np.bitwise_count(prints[alive] ^ prints[alive + step]) <= threshold) & (home[alive] | home[alive + step])
        lefts.append(at[alive[near]])
        rights.append(at[alive[near] + step])
        step += 1
    for start, n in zip(starts[lengths > 32], lengths[lengths > 32]):
        members = np.arange(start, start + n)
        locals_ = members[home[members]]
        for cut in range(0, len(locals_), 256):
            mine = locals_[cut : cut + 256]
            i, j = np.nonzero(np.bitwise_count(prints[mine][:, None] ^ prints[members][None, :]) <= threshold)
            a, b = at[mine[i]], at[members[j]]
            # Of one block of comparisons only a forest is kept.
            used, index = np.unique(np.r_[a, b], return_inverse=True)
            root = _roots(len(used), index[: len(a)], index[len(a) :])
            lefts.append(used)
            rights.append(used[root])
    if not lefts:
        return fp[:0], fp[:0]
    root = _roots(len(node), np.concatenate(lefts), np.concatenate(rights))
    leaf = np.flatnonzero(root != np.arange(len(node)))
    return node[root[leaf]], node[leaf]


def _compare(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key. Whole keys are gathered to about 200,000 rows; a key has a few blocks at most."""
        held: list[list[np.ndarray]] = []

        def flush(columns):
            a, b = _links(*columns, threshold)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, block, fp = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            home = np.asarray(batch.column(3).to_numpy(zero_copy_only=False), dtype=bool)
            held.append([anchor, block, fp, home])
            if sum(len(x[0]) for x in held) < 200_000:
                continue
            anchor, block, fp, home = (np.concatenate(x) for x in zip(*held))
            key = np.cumsum(np.r_[0, (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])])
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield flush((key[:last], fp[:last], home[:last]))
            held = [[anchor[last:], block[last:], fp[last:], home[last:]]]
        if held:
            anchor, block, fp, home = (np.concatenate(x) for x in zip(*held))
            key = np.cumsum(np.r_[0, (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1])])
            yield flush((key, fp, home))

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp bigint) of every row of ``docs``; no shuffle."""
    return docs.select(F.col("doc_id"), F.col("text").cast("string")).mapInArrow(_fingerprints, schema([docs.schema["doc_id"]], "fp bigint"))


def links(prints: DataFrame, scratch: Scratch, threshold: int = THRESHOLD) -> DataFrame:
    """(a, b) pairs of distinct fingerprints whose closure is that of all links within ``threshold`` bits."""
    if threshold > 3:
        raise ValueError("the covering of two halves holds to a threshold of 3")
    replicas = prints.select("fp").mapInArrow(_replicas, "anchor bigint, fp bigint, home boolean")
    # Members and homes of each anchor, added up before the shuffle; where none is at home nothing is compared.
    hot = scratch.keep(replicas.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK), "hot")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    hot = hot.select(F.col("anchor"), blocks.alias("blocks"))
    if hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hot = F.broadcast(hot)
    # Block i meets block j in the key (min, max); one block means one key.
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cells = F.when(F.col("blocks").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least(mine, j).cast("long") * 1_000_000 + F.greatest(mine, j))
    )
    keyed = replicas.join(hot, "anchor", "left").select("anchor", F.explode(cells).alias("block"), "fp", "home")
    keyed = keyed.repartition("anchor", "block").sortWithinPartitions("anchor", "block")
    return keyed.mapInArrow(_compare(threshold), "a bigint, b bigint").distinct()


def components(nodes: DataFrame, pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, label): the smallest node that each of ``nodes`` (column v) reaches over ``pairs`` (a, b).

    Each round hooks every class to the smallest label next to it and halves
    the way to the root; both tables lie in the shared folder, so the joins
    shuffle plain scans and Spark can split a hub's rows. Links inside one
    class are dropped, and the rounds end when none is left.
    """
    labels = scratch.keep(nodes.select("v", F.col("v").alias("label")), "labels-0")
    pairs = scratch.keep(pairs, "pairs-0")
    n = 0
    while not pairs.isEmpty():
        # A class hooks to the smallest class next to it, if that is smaller.
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = scratch.keep(both.groupBy("a").agg(F.min("b").alias("to")).where("to < a").select(F.col("a").alias("label"), "to"), f"hooks-{n}-0")
        # Hooks form trees; jump until every hook leads to a root.
        jumps, moved = 0, True
        while moved:
            step = hooks.select(F.col("label").alias("to"), F.col("to").alias("on"))
            hooks = hooks.select("label", "to").join(step, "to", "left").select("label", F.coalesce("on", "to").alias("to"), F.col("on").isNotNull().alias("moved"))
            jumps += 1
            hooks = scratch.keep(hooks, f"hooks-{n}-{jumps}")
            moved = not hooks.where("moved").isEmpty()
            scratch.drop(f"hooks-{n}-{jumps - 1}")
        hooks = hooks.select("label", "to")
        labels = scratch.keep(labels.join(hooks, "label", "left").select("v", F.coalesce("to", "label").alias("label")), f"labels-{n + 1}")
        left = hooks.select(F.col("label").alias("a"), F.col("to").alias("ra"))
        right = hooks.select(F.col("label").alias("b"), F.col("to").alias("rb"))
        moved_pairs = pairs.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        pairs = scratch.keep(moved_pairs.where("a <> b").distinct(), f"pairs-{n + 1}")
        scratch.drop(f"labels-{n}", f"pairs-{n}", f"hooks-{n}-{jumps}")
        n += 1
    return labels


def _classes(prints: DataFrame, first, scratch: Scratch, threshold: int) -> DataFrame:
    """(fp, first): for each fingerprint of ``prints`` the least of what ``first`` aggregates over its class."""
    distinct = scratch.keep(prints.groupBy("fp").agg(first.alias("first")), "distinct")
    pairs = links(distinct, scratch, threshold)
    # Nodes are fingerprints; a class is named by the smallest of its fingerprints.
    labels = components(distinct.select(F.col("fp").alias("v")), pairs, scratch)
    named = labels.select(F.col("v").alias("fp"), "label").join(distinct, "fp")
    names = scratch.keep(named.groupBy("label").agg(F.min("first").alias("first")), "names")
    return scratch.keep(labels.select(F.col("v").alias("fp"), "label").join(names, "label").select("fp", "first"), "classes")


def simhash_classes(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of at most
    ``threshold`` differing bits, the document's own included. Null and empty
    texts have fingerprint zero. Repeated rows come back repeated. A null
    doc_id keeps its row and takes part in its class, but cannot name it: the
    id of a class without any doc_id is null. Other columns are ignored, and an
    empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.keep(fingerprints(docs), "prints")
    classes = _classes(prints, F.min("doc_id"), scratch, threshold)
    scratch.drop_all_but("prints", "classes")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


def keep_one(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: of each class of texts one row.

    It is the row with the smallest doc_id, null last, and of rows repeated
    under that id the one whose text has the smallest XXH64; of rows equal in
    both any one. Each row is judged by its own text: a doc_id with texts in
    two classes may keep a row of each. Null and empty texts are one class.
    Other columns are not looked at; an empty table stays empty.
    """
    scratch = Scratch(docs.sparkSession, "keep-one")
    text = F.xxhash64(F.col("text").cast("string"))
    rows = docs.select(F.struct("doc_id", text.alias("text")).alias("doc_id"), "text")
    prints = scratch.keep(fingerprints(rows), "prints").select("doc_id.doc_id", F.col("doc_id.text").alias("text"), "fp")
    row = F.struct(F.col("doc_id").isNull(), "doc_id", "text")
    classes = _classes(prints, F.min(row), scratch, threshold)
    judged = prints.join(classes, "fp").select("doc_id", "text", (row == F.col("first")).alias("stays"))
    judged = judged.groupBy("doc_id", "text").agg(F.first("stays").alias("stays"), F.count("*").alias("n")).where("not stays or n > 1")
    # Those that go or are repeated; all other rows only meet this list.
    listed = scratch.keep(judged.select(F.col("doc_id").alias("_bitloom_id"), F.col("text").alias("_bitloom_hash"), F.col("stays").alias("_bitloom_stays")), "listed")
    scratch.drop_all_but("listed")
    same = F.col("doc_id").eqNullSafe(F.col("_bitloom_id")) & (text == F.col("_bitloom_hash"))
    kept = docs.join(listed, same, "left_anti")
    repeated = listed.where("_bitloom_stays")
    if repeated.isEmpty():
        return kept
    # Only rows that are repeated are shuffled to find one of each.
    once = docs.join(repeated, same, "left_semi").withColumn("_bitloom_hash", text).dropDuplicates(["doc_id", "_bitloom_hash"])
    return kept.unionByName(once.drop("_bitloom_hash"))
