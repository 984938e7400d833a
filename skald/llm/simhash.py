"""SimHash near-duplicates with bit-sliced comparison.

A document's fingerprint has a bit set where over half of its word shingles' XXH64 hashes have it
set. Fingerprints link at ``radius`` or fewer differing bits; components are the classes that links
reach. Distinct fingerprints (copies collapse here) are cut into ``radius + 2`` blocks of bits: two
that link agree on at least two blocks, so every pair of blocks is a bucket key and no link is
lost. A bucket's members are compared bit-sliced: planes hold one bit of 64 fingerprints to the
word, vertical counters add the differing bits plane by plane with carry-save steps, and a block
is abandoned once all its counters exceed the radius. Only a spanning set of links leaves a
bucket, never all pairs. Buckets of more than ``BUCKET`` members are split into sub-blocks whose
pairs are separate groups. Components come from alternating star contraction over written tables.

Defined results: null, empty and white-space texts have the fingerprint zero and link like any
other; fewer words than a shingle give the one shingle of all words; equal rows share a component;
``component_id`` is the smallest doc_id reached (null only if all are null); empty tables give no
rows; extra columns are left out.

``first_of_classes`` asks for similarity instead: shingle sets (of five words) whose Jaccard is at
least ``similarity`` link. Candidates share one of ``BANDS`` keys of ``ROWS`` least hashes and lie
within ``WIDE`` bits, found by the same bit-sliced search; a pair of Jaccard 0.8 shares no key with
a chance of 0.04 %. Each class of candidates is then searched again with whole shingle sets, by exact
Jaccard, so that only true links make classes. Sets are known by 64-bit hashes of their sorted
hashes; texts without words are one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skald.llm.shared import give_back, materialize, text_slices, whole_text

BITS = 64
BUCKET = 4096
#: Members up to which a bucket's pairs are compared side by side with those of other buckets.
SMALL = 16
PROBES = 256
#: Keys of least hashes, hashes to a key, and differing bits up to which sharers are candidates.
BANDS, ROWS, WIDE = 20, 5, 24
#: Members and shingles of a group whose sets are compared in one worker.
GROUP, GROUP_SHINGLES = 512, 4_000_000
_ODD = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """The hash of each shingle in the text's order."""
    tokens = text.encode().lower().split()  # bytes: A-Z only, and white space 0x20, 0x09-0x0D
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    last = ends[words - 1 :].tolist() or [len(joined)]
    first = (ends - sizes)[: len(last)].tolist()
    return np.fromiter((xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(first, last, strict=True)), np.uint64, len(last))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of ``hashes`` have set."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    return majority(shingle_hashes(text, words, seed))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            found = np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(found)], schema=schema)

    return whole_text(docs).mapInArrow(run, "doc_id long, fp long")


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes, 64 values to the word: shape (64, words)."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near(differ: Iterator[np.ndarray], shape: tuple[int, ...], radius: int) -> np.ndarray:
    """Words with a bit for each place where at most ``radius`` of the planes ``differ`` are set.

    Each digit of the vertical counters waits for a second plane of its weight and takes both in
    one full adder (carry-save), whose carry goes on to the next digit."""
    digits = radius.bit_length() + 1
    counters = [np.zeros(shape, np.uint64) for _ in range(digits)]
    waiting: list[np.ndarray | None] = [None] * digits
    over = np.zeros(shape, np.uint64)
    everything = np.uint64(0xFFFFFFFFFFFFFFFF)

    def add(digit: int, plane: np.ndarray, settle: bool = False) -> None:
        nonlocal over
        while digit < digits:
            first = waiting[digit]
            if first is None and not settle:
                waiting[digit] = plane
                return
            waiting[digit] = None
            if first is None:
                first = np.uint64(0)
            half = counters[digit] ^ first
            plane, counters[digit] = counters[digit] & first | half & plane, half ^ plane
            digit += 1
        over = over | plane

    for b, plane in enumerate(differ):
        add(0, plane)
        if b % 8 == 7:
            for d in range(digits):
                if (late := waiting[d]) is not None:
                    waiting[d] = None
                    add(d, late, settle=True)
            above, equal = over.copy(), np.full(shape, everything)
            for d in range(digits - 1, -1, -1):
                if radius >> d & 1:
                    equal &= counters[d]
                else:
                    above |= equal & counters[d]
                    equal &= ~counters[d]
            if (above == everything).all():
                return np.zeros(shape, np.uint64)
    return ~above


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(words.view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def group_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning set of links among ``values``, as pairs of places: each component as a star."""
    n, own = len(values), planes(values)
    rows: list[int] = []
    for k in range(0, n, PROBES):
        probes = values[k : k + PROBES]
        ones = np.uint64(0) - (probes[:, None] >> np.arange(BITS, dtype=np.uint64)[None, :] & np.uint64(1))
        mask = near((own[b][None, :] ^ ones[:, b][:, None] for b in range(BITS)), (len(probes), own.shape[1]), radius)
        rows += [int.from_bytes(r.tobytes(), "little") for r in mask]
    rest = (1 << n) - 1
    links = []
    while rest:
        root = (rest & -rest).bit_length() - 1
        rest &= ~(1 << root)
        front = rows[root] & rest
        while front:
            rest &= ~front
            reached = 0
            while front:
                i = (front & -front).bit_length() - 1
                front &= front - 1
                links.append((root, i))
                reached |= rows[i]
            front = reached & rest
    return links


def links_of(keys: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each run of equal ``keys``, as pairs of places in ``values``."""
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    sizes = np.diff(edges)
    left, right = [], []
    small = np.repeat(sizes <= SMALL, sizes)
    inside = np.arange(len(keys)) - np.repeat(edges[:-1], sizes)
    remaining = np.repeat(sizes, sizes) - inside
    for d in range(1, SMALL):
        at = np.flatnonzero(small & (remaining > d))
        if not len(at):
            break
        differ = planes(values[at] ^ values[at + d])
        hit = at[unpack(near(iter(differ), differ.shape[1:], radius), len(at))]
        left.append(hit)
        right.append(hit + d)
    for a, n in zip(edges[:-1][sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        pairs = np.array(group_links(values[a : a + n], radius), np.int64).reshape(-1, 2) + a
        left.append(pairs[:, 0])
        right.append(pairs[:, 1])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def bucket_keys(fp: Column, radius: int) -> Column:
    """An array of (table, bits) keys: two fingerprints within ``radius`` share at least one."""
    blocks = radius + 2
    edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
    return F.array(*(F.struct(F.lit(t).alias("t"), F.shiftleft(part[i], 32).bitwiseOR(part[j]).alias("bits")) for t, (i, j) in enumerate(combinations(range(blocks), 2))))


def links(distinct: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """``a, b``: links among distinct fingerprints that connect every component."""
    rows = distinct.select("fp", F.explode(bucket_keys(F.col("fp"), radius)).alias("key")).select("fp", "key.t", "key.bits")
    return bucket_links(rows, radius, bucket)


def bucket_links(rows: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """``a, b``: links inside the buckets of ``fp, t, bits``, between the rows' ``node`` if they have one, else ``fp``."""
    own = ["node"] if "node" in rows.columns else []
    # Written first: a join fed by shuffles alone can be split where a bucket is hot.
    sizes = materialize(rows.groupBy("t", "bits").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / bucket).cast("int")))
    mine = F.pmod(F.xxhash64(*own or ["fp"]), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    # A member of a split bucket goes to the groups of its sub-block with each sub-block.
    dealt = rows.join(sizes, ["t", "bits"]).select("fp", *own, "t", "bits", F.explode(F.transform(others, lambda o: F.least(mine, o) * F.col("parts") + F.greatest(mine, o))).alias("pair"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, ...] | None = None

        def found(keys: tuple[np.ndarray, ...], fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            run_of = np.cumsum(np.r_[0, reduce(np.logical_or, (np.diff(k) != 0 for k in keys)).astype(np.int64)])
            a, b = links_of(run_of, fp.view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], schema=schema)

        for batch in batches:
            columns = tuple(c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
            if held is not None:
                columns = tuple(np.concatenate(x) for x in zip(held, columns, strict=True))
            if not len(columns[0]):
                continue
            whole = np.flatnonzero(reduce(np.logical_or, (c != c[-1] for c in columns[:3])))
            cut = whole[-1] + 1 if len(whole) else 0  # the last key's members may go on in the next batch
            held = tuple(c[cut:] for c in columns)
            if cut:
                yield found(tuple(c[:cut] for c in columns[:3]), columns[3][:cut], columns[-1][:cut])
        if held is not None and len(held[0]):
            yield found(held[:3], held[3], held[-1])
        held = None
        give_back()

    near_by = dealt.repartition("t", "bits", "pair").sortWithinPartitions("t", "bits", "pair").select("t", "bits", "pair", "fp", *own)
    return near_by.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: connected components by alternating large-star and small-star steps.

    The least neighbours are written before they are joined: a join of written tables can be split
    where a node has very many edges, one that shares its stage with an aggregation can't."""
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), low, edges)
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = materialize(small, low, large)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id``."""
    found = materialize(fingerprints(docs, words))
    distinct = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = components(links(distinct.select("fp"), radius))
    rooted = materialize(distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), distinct)
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = materialize(rooted.join(least, "root").select("fp", "component_id"), rooted, least)
    return found.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: sets of Jaccard ``j`` share one with a chance of ``j ** ROWS``."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(0, len(hashes), 1024):
        np.minimum(low, (hashes[k : k + 1024, None] * _ODD).min(0), out=low)
    return (low.reshape(BANDS, ROWS) * _ODD[:ROWS]).sum(1, dtype=np.uint64)


def shingle_set(text: str, words: int) -> tuple[int, np.ndarray]:
    """The sorted distinct hashes of a text's shingles, and what they are known by."""
    found = np.unique(shingle_hashes(text, words))
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).view(np.int64)), found


def sketches(docs: DataFrame, words: int, row: str) -> DataFrame:
    """``doc_id, row, node, n, fp, keys``: a shingle set's name, size, fingerprint and band keys (none if empty)."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            sets = [shingle_set(t, words) for t in texts]
            fp = np.array([majority(s) for _, s in sets], np.uint64).view(np.int64)
            keys = [band_keys(s).view(np.int64) if len(s) else [] for _, s in sets]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column(row), pa.array([n for n, _ in sets], pa.int64()), pa.array([len(s) for _, s in sets], pa.int64()), pa.array(fp), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return whole_text(docs, row).mapInArrow(run, "doc_id long, row long, node long, n long, fp long, keys array<long>")


def set_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning set of the pairs of ``sets`` with a Jaccard of ``similarity`` or more, as pairs of places."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    _, ids, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = np.repeat(np.arange(len(sets)), sizes)[np.argsort(ids, kind="stable")]
    starts = np.cumsum(counts) - counts
    rest = np.ones(len(sets), bool)
    links = []
    for root in range(len(sets)):
        if not rest[root]:
            continue
        rest[root], front = False, [root]
        while front and rest.any():
            i = front.pop()
            mine = ids[ends[i] - sizes[i] : ends[i]]
            held = counts[mine]
            at = np.repeat(starts[mine] - (np.cumsum(held) - held), held) + np.arange(held.sum())
            common = np.bincount(holders[at], minlength=len(sets))
            reached = np.flatnonzero(rest & (common / (sizes + sizes[i] - common) >= similarity))
            rest[reached] = False
            links += [(i, j) for j in reached.tolist()]
            front += reached.tolist()
    return links


def verified_links(docs: DataFrame, distinct: DataFrame, parts: DataFrame, words: int, similarity: float, row: str, group: int = GROUP) -> DataFrame:
    """``a, b``: true links inside the candidate classes ``parts`` (node, root) that connect every true class."""
    members = parts.unionByName(parts.select(F.col("root").alias("node"), "root").distinct()).join(distinct.select("node", "n", "least"), "node")
    members = materialize(members)
    many = F.ceil(F.greatest(F.count("*") / group, F.sum("n") / GROUP_SHINGLES)).cast("int")
    sizes = materialize(members.groupBy("root").agg(many.alias("parts")))
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = members.join(sizes, "root").select("node", "root", F.explode(F.transform(others, lambda o: F.least(mine, o) * F.col("parts") + F.greatest(mine, o))).alias("pair"))
    needed = members.select(F.col("least.row").alias("needed")).distinct()
    texts = docs.join(needed, docs[row] == needed.needed, "left_semi")
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in text_slices(batches):
            sets = [shingle_set(t, words) for t in found]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in sets], pa.int64()), pa.array([s.tobytes() for _, s in sets], pa.binary())], schema=schema)

    sets = whole_text(texts).mapInArrow(build, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))
    near_by = dealt.join(materialize(sets), "node").repartition("root", "pair").sortWithinPartitions("root", "pair").select("root", "pair", "node", "shingles")
    pairs = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, held = None, [], []

        def found() -> pa.RecordBatch:
            got = set_links(held, similarity)
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in got], pa.int64()), pa.array([nodes[j] for _, j in got], pa.int64())], schema=pairs)

        for batch in batches:
            for root, pair, node, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (root, pair):
                    if held:
                        yield found()
                    key, nodes, held = (root, pair), [], []
                nodes.append(node)
                held.append(np.frombuffer(shingles, np.uint64))
        if held:
            yield found()
        nodes, held = [], []
        give_back()

    return near_by.mapInArrow(run, "a long, b long")


def first_of_classes(docs: DataFrame, row: str, words: int = 5, similarity: float = 0.8, radius: int = WIDE) -> DataFrame:
    """``kept``: of each class that links of ``similarity`` or more make, the ``row`` with the smallest doc_id.

    ``row`` is a column of ``docs`` that tells every row from all others, equal ones too; among
    equal doc_ids the smallest decides, null doc_ids come last."""
    found = sketches(docs, words, row)
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    distinct = materialize(found.groupBy("node").agg(F.min(place).alias("least"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    rows = distinct.select("fp", "node", F.posexplode("keys").alias("t", "bits"))
    candidates = components(bucket_links(rows, radius))
    true = components(verified_links(docs, distinct, candidates, words, similarity, row))
    rooted = distinct.select("node", "least").join(true, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    return rooted.groupBy("root").agg(F.min("least").alias("first")).select(F.col("first.row").alias("kept"))


def without_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that ``first_of_classes`` keeps: one row of each class, also of equal rows or doc_ids; all columns stay."""
    row = next(c for c in ("skald_row", "skald_row_of_near_dedup", *map("skald_row_{}".format, range(len(docs.columns) + 1))) if c not in docs.columns)
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    keep = materialize(first_of_classes(rows, row, words, similarity))
    return rows.join(keep, rows[row] == keep.kept, "left_semi").drop(row)


