"""Documents whose sets of word n-grams are alike, joined by a prefix tree.

Sets are put in one global order, in which n-grams that very many documents
share come last. Two sets as alike as asked share an n-gram among their first
few, so the children of the tree's root are the n-grams of those prefixes and
only sets under a common child can match. There, sizes and counts of n-grams by
bucket bound what two sets can share. The pairs that remain are joined by the
tree: candidates of a probe lie in lexicographic order, one descent shares the
overlap that neighbours have in common, and a branch is left as soon as what
remains of it cannot reach the overlap needed.

Equal sets stand for one another from the start. Links are sought in
passes: every set is first joined with its nearest partner, then with its
least and its nearest one of those not yet joined with it, which unites large groups of
copies without forming their pairs; last, all pairs that may match and that the
links found so far have not joined are verified."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, _arrow_schema, cut, drop, scope, small_batches
from .components import components
from .passages import BYTE, _mix, _powers

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: At most so many of the most frequent n-grams come last in the global order, by how often they are met; any number gives the same links.
FREQUENT = 1 << 20
#: Bytes of texts handled at once.
BUFFER = 1 << 20
#: Least and most buckets, as powers of 2, of the counts that bound overlaps.
LEAST_LEVEL, LEAST_FINE, MOST_LEVEL = 4, 6, 9
#: Times as many buckets have the counts of what the first pass leaves, where sets are alike but not alike enough.
FINER = 8
#: Groups under one n-gram beyond this are compared with a few pivots in the first pass.
WIDE = 256
#: Bucket counts handled at once, a byte each, so that comparing groups takes little memory beside the group's own counts, however wide it is.
PIECE = 1 << 20


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams of the texts, one after the other, and where each text's begin (and the last end).

    Letters A-Z are lower-cased; words are runs of bytes other than ASCII white
    space. A text of fewer words has its whole sequence as one n-gram, one
    without words none."""
    data = LOWER[np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)]
    n = len(data)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    ends_of_text = np.cumsum(sizes)
    gap = SEPARATOR[data]
    word = ~gap
    first = np.flatnonzero(word & np.concatenate([[True], gap[:-1]]))
    last = np.flatnonzero(word & np.concatenate([gap[1:], [True]])) + 1
    up, down = _powers.get(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE[data] * up[:n], out=total[1:])
        h = _mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    edge = np.concatenate([[0], np.searchsorted(first, ends_of_text)])
    count = np.diff(edge)
    out = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(out)])
    spread = np.arange(begin[-1]) - np.repeat(begin[:-1], out) + np.repeat(edge[:-1], out)
    take = np.repeat(np.minimum(count, words), out)
    with np.errstate(over="ignore"):
        s = np.full(len(spread), 0x1234567, dtype=np.uint64)
        for k in range(words):
            more = take > k
            s = np.where(more, _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(spread + k, max(0, len(h) - 1))]) if len(h) else s, s)
    return s, begin


def _buffers(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BUFFER:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if texts:
        yield at, texts[at:]


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _ordered(grams: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Distinct n-grams in the global order: by hash, the frequent ones last and by rank among themselves."""
    s = np.unique(grams)
    if len(frequent) and len(s):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        late = frequent[at] == s
        if late.any():
            last = s[late]
            s = np.concatenate([s[~late], last[np.argsort(rank[at[late]], kind="stable")]])
    return s


def _count_frequent(words: int, least: int):
    """Times of the n-grams met `least` times or more among a task's neighbouring texts; those met once in a buffer are not counted there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            u, back = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
            c = np.bincount(back, np.concatenate([t for _, t in held])).astype(np.int64)
            many = c >= least
            return pa.RecordBatch.from_arrays([pa.array(u[many].view(np.int64)), pa.array(c[many])], names=["gram", "times"])

        for batch in batches:
            for _, part in _buffers(_texts(batch)):
                s, _ = shingles(part, words)
                u, c = np.unique(s, return_counts=True)
                held.append((u[c > 1], c[c > 1]))
                size += len(held[-1][0])
                if size > BUFFER:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _level(n: int, percent: int, finer: int = 1) -> int:
    """Buckets (a power of 2) whose counts tell unlike sets of this size apart: their difference grows with the root of size times buckets, what likeness leaves room for with the size."""
    enough = 7 * finer * n * ((100 - percent) / (100 + percent)) ** 2
    return min(MOST_LEVEL, max(LEAST_LEVEL, int(np.ceil(np.log2(max(1.0, enough))))))


def _counts(s: np.ndarray, level: int) -> bytes:
    buckets = 1 << level
    return np.minimum(np.bincount((s >> np.uint64(20)).astype(np.int64) & (buckets - 1), minlength=buckets), 255).astype(np.uint8).tobytes()


def _describe(words: int, percent: int, frequent: np.ndarray, rank: np.ndarray, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows: list[list] = [[] for _ in schema]
            for at, part in _buffers(_texts(batch)):
                grams, begin = shingles(part, words)
                for i in range(len(part)):
                    s = _ordered(grams[begin[i] : begin[i + 1]], frequent, rank)
                    n = len(s)
                    with np.errstate(over="ignore"):
                        a, b = int(_mix(s).sum().view(np.int64)) if n else 0, int(_mix(s ^ np.uint64(0x5555555555555555)).sum().view(np.int64)) if n else 0
                    prefix = s[: n - -(-percent * n // 100) + 1]
                    counts = _counts(s, _level(n, percent)), _counts(s, max(LEAST_FINE, _level(n, percent, FINER)))
                    for column, value in zip(rows, (ids[at + i], n, a, b, prefix.view(np.int64), *counts), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return run


def _binary(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each value's begin (and the last end)."""
    rows = column.cast(pa.large_binary()).combine_chunks()  # large: two gigabytes are no bound
    _, offsets, data = rows.buffers()
    begin = np.frombuffer(offsets, dtype=np.int64)[rows.offset : rows.offset + len(rows) + 1] if len(rows) else np.zeros(1, dtype=np.int64)
    return np.frombuffer(data or b"", dtype=np.uint8), begin


class _Group:
    """Rows under one or several n-grams, in order, with their bounds; a row's counts are held at a byte a bucket, some two bytes with all their folds."""

    def __init__(self, rows: pa.Table, percent: int):
        self.rows = rows
        get = lambda c: rows.column(c).to_numpy()
        self.gram, self.rep, self.n = get("gram"), get("rep"), get("n")
        self.part = get("component") if "component" in rows.column_names else None
        data, begin = _binary(rows.column("vector"))
        self.level = np.log2(np.diff(begin)).astype(np.int64)
        #: By level: each row's line in the counts of that level, and the counts.
        self.counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for level in np.unique(self.level)[::-1].tolist():
            wide = 1 << level
            own = np.flatnonzero(self.level == level)
            finer = np.flatnonzero(self.level > level)
            line = np.full(rows.num_rows, -1, dtype=np.int64)
            line[own], line[finer] = np.arange(len(own)), len(own) + np.arange(len(finer))
            grid = np.empty((len(own) + len(finer), wide), dtype=np.uint8)
            for at in _pieces(len(own), wide):
                grid[at] = data[begin[own[at], None] + np.arange(wide)]
            if len(finer):  # wider rows fold down: the low bits of a bucket's number are those of the coarser bucket
                above, full = self.counts[min(self.counts)]
                for at in _pieces(len(finer), full.shape[1]):
                    folded = full[above[finer[at]]].reshape(-1, full.shape[1] // wide, wide).sum(axis=1, dtype=np.uint32)
                    grid[len(own) + at.start : len(own) + at.stop] = np.minimum(folded, 255)
            self.counts[level] = line, grid
        self.percent = percent

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many n-grams two rows are known not to share, by their bucket counts; -1 where sizes or counts leave no room for the likeness asked."""
        ni, nj = self.n[i], self.n[j]
        out = np.full(len(i), -1, dtype=np.int64)
        fit = 100 * np.minimum(ni, nj) >= self.percent * np.maximum(ni, nj)
        common = np.minimum(self.level[i], self.level[j])
        for level, (line, grid) in self.counts.items():
            k = np.flatnonzero(fit & (common == level))
            for at in _pieces(len(k), 1 << level):
                q = k[at]
                # union - overlap = what the two don't share, at most (100 - percent)/100 of the union
                room = (100 - self.percent) * (ni[q] + nj[q]) // (100 + self.percent)
                one, other = grid[line[i[q]]], grid[line[j[q]]]
                d = (np.maximum(one, other) - np.minimum(one, other)).sum(axis=1, dtype=np.int64)
                out[q] = np.where(d <= room, d, -1)
        return out


def _pieces(rows: int, width: int) -> Iterator[slice]:
    """Slices of so many rows that their counts are PIECE at most."""
    step = max(1, PIECE // width)
    return (slice(s, min(rows, s + step)) for s in range(0, rows, step))


def _grouped(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.Table]:
    """Batches cut where the n-gram changes, some groups at once."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        gram = batch.column("gram").to_numpy()
        if held and size >= rows:
            before = held[-1].column("gram")[-1].as_py()
            new = np.flatnonzero(gram != before)
            if len(new):
                whole = pa.Table.from_batches([*held, batch.slice(0, int(new[0]))]).combine_chunks()
                batch, held, size = batch.slice(int(new[0])), [], 0
                yield whole
        held.append(batch)
        size += batch.num_rows
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        held = []
        yield whole


def _walk(g: _Group, other_part: bool):
    """Pairs of rows under one n-gram that may match, and their distance by counts; with other_part, only of rows not joined yet.

    Groups up to WIDE are compared in full, and so are the rows of wider ones
    that the largest joined part does not hold; without other_part wider groups
    meet a few pivots only."""
    border = np.concatenate([[0], np.flatnonzero(np.diff(g.gram)) + 1, [len(g.gram)]])
    size = np.diff(border)
    start, length = np.repeat(border[:-1], size), np.repeat(size, size)
    row = np.arange(len(g.gram))
    narrow = row[length <= WIDE]

    def near(i: np.ndarray, j: np.ndarray):
        if other_part:
            differ = g.part[i] != g.part[j]
            i, j = i[differ], j[differ]
        d = g.apart(i, j)
        fit = d >= 0
        return i[fit], j[fit], d[fit]

    for d in range(1, int(size[size <= WIDE].max(initial=1))):
        narrow = narrow[narrow + d < start[narrow] + length[narrow]]
        if not len(narrow):
            break
        yield near(narrow, narrow + d)
    if not other_part:
        wide = row[length > WIDE]
        for step in range(8):  # by size, a few along the group
            pivot = start[wide] + length[wide] * step // 8
            yield near(wide[pivot != wide], pivot[pivot != wide])
        return
    for k in np.flatnonzero(size > WIDE):
        rows = np.arange(border[k], border[k + 1])
        names, times = np.unique(g.part[rows], return_counts=True)
        if len(names) > 1:
            for i in rows[g.part[rows] != names[times.argmax()]]:
                yield near(np.full(len(rows) - 1, i), rows[rows != i])


def _partners(percent: int, other_part: bool):
    """For each row with a partner that may match: its least and its nearest one, so that a group gives at most a row for each it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _grouped(batches):
            g = _Group(whole, percent)
            n = len(g.gram)
            none = np.iinfo(np.int64).max
            least, nearest = np.full(n, none), np.full(n, none)
            distance = np.full(n, none)
            for i, j, d in _walk(g, other_part):
                for a, b in ((i, j), (j, i)):
                    np.minimum.at(least, a, g.rep[b])
                    best = distance.copy()
                    np.minimum.at(best, a, d)
                    win = (d == best[a]) & (d < distance[a])
                    nearest[a[win]] = g.rep[b[win]]
                    distance = best
            live = least != none
            if not other_part:  # what has met a few of its group only stays for the next pass
                change = np.concatenate([[0], np.flatnonzero(np.diff(g.gram)) + 1, [n]])
                live |= np.repeat(np.diff(change) > WIDE, np.diff(change))
            none_found = least == none
            least, nearest = np.where(none_found, g.rep, least), np.where(none_found, g.rep, nearest)
            out = g.rows.select(["gram", "rep", "n", "vector"])
            for name, x in (("least", least), ("distance", distance), ("nearest", nearest)):
                out = out.append_column(name, pa.array(x))
            del g
            yield from out.filter(pa.array(live)).to_batches(max_chunksize=BATCH_ROWS)

    return run


def _remaining(percent: int):
    """Pairs of rows under a common n-gram that may match and are not yet joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _grouped(batches):
            g = _Group(whole, percent)
            found = [(np.minimum(g.rep[i], g.rep[j]), np.maximum(g.rep[i], g.rep[j])) for i, j, _ in _walk(g, True)]
            pairs = np.stack([np.concatenate([x[s] for x in found]) if found else np.zeros(0, np.int64) for s in (0, 1)])
            pairs = np.unique(pairs, axis=1) if pairs.size else pairs
            del g, found
            yield from pa.table([pairs[0], pairs[1]], names=["a", "b"]).to_batches(max_chunksize=BUFFER)

    return run


def _packed(grams: np.ndarray) -> bytes:
    """48 bits of each n-gram's hash, in order: a chance agreement within a pair of sets of 1,000 has odds of 1 in 10^8."""
    return np.ascontiguousarray(grams.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(np.uint64)


#: Up to so many wanted documents are told apart by a bit map of 16 bits each, 32 MB at most; beyond, texts and ids are joined.
MAPPED = 1 << 24


def _slot(ids: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(ids.astype(np.int64).view(np.uint64) + np.uint64(0x51ED27)) & np.uint64(bits - 1)).astype(np.int64)


def _slots(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_slot(batch.column("doc_id").to_numpy(), bits)))], names=["slot"])

    return run


def _map_of(ids: DataFrame, bits: int) -> np.ndarray:
    """Bit map of the ids' slots; its words are put together by the executors."""
    slots = ids.mapInArrow(_slots(bits), "slot long")
    words = slots.groupBy(F.shiftright("slot", 5).alias("word")).agg(F.bit_or(F.pow(F.lit(2), F.pmod("slot", F.lit(32))).cast("long")).alias("bits")).toArrow()
    out = np.zeros(bits // 32, dtype=np.uint32)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out


def _among(wanted, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(batch.column("doc_id").is_valid()))
            slot = _slot(batch.column("doc_id").to_numpy(), bits)
            yield batch.filter(pa.array((wanted.value[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1 == 1))

    return run


def _sets(words: int, frequent: np.ndarray, rank: np.ndarray, only):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in only(batches):
            ids, sets = batch.column("doc_id"), []
            for _, part in _buffers(_texts(batch)):
                grams, begin = shingles(part, words)
                sets += [_packed(_ordered(grams[begin[i] : begin[i + 1]], frequent, rank)) for i in range(len(part))]
            yield pa.RecordBatch.from_arrays([ids, pa.array(sets, type=pa.binary())], names=["rep", "grams"])

    return run


def _sets_of(docs: DataFrame, pairs: DataFrame, words: int, frequent: np.ndarray, rank: np.ndarray) -> DataFrame:
    """The sets of the documents that the pairs name (and of few others), read anew from their texts, so that no others are moved."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
    many = 2 * pairs.count()  # at most; the distinct ones are counted only where this is too many
    if many > MAPPED:
        ids = ids.distinct()
        many = ids.count()
    if many > MAPPED:
        return cut(docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_sets(words, frequent, rank, iter), "rep long, grams binary"))
    bits = 1 << max(10, (16 * many - 1).bit_length())
    wanted = docs.sparkSession.sparkContext.broadcast(_map_of(ids, bits))
    out = cut(docs.mapInArrow(_sets(words, frequent, rank, _among(wanted, bits)), "rep long, grams binary"))
    wanted.destroy()
    return out


class Descent:
    """A probe's way through the tree of its candidates, which come in lexicographic order, so that a subtree's are neighbours.

    The path from the root to where the last candidate was left is kept with the
    overlap down to each depth. A candidate is taken up where it leaves that path;
    below a node that was given up, nothing of it is looked at."""

    STRIDE = 64

    def __init__(self, probe: np.ndarray, percent: int):
        self.sorted, self.size, self.percent = np.sort(probe), len(probe), percent
        self.path = np.zeros(0, dtype=np.uint64)
        #: Overlap of the probe with the path down to each depth.
        self.overlap = np.zeros(1, dtype=np.int64)
        #: The node given up last, as the bytes from the root down to it, and the overlap there.
        self.given_up, self.shared = b"", 0

    def reach(self, depth: int, have: int, n: int) -> bool:
        """Whether a candidate of size n that shares `have` down to this depth can still be as alike as asked."""
        return have + min(n - depth, self.size - have) >= -(-self.percent * (self.size + n) // (100 + self.percent))

    def matches(self, packed: bytes) -> bool:
        n = len(packed) // 6
        if self.given_up and packed.startswith(self.given_up) and not self.reach(len(self.given_up) // 6, self.shared, n):
            return False
        candidate = _unpacked(packed)
        k = min(n, len(self.path), len(self.overlap) - 1)
        apart = np.flatnonzero(self.path[:k] != candidate[:k])
        depth = int(apart[0]) if len(apart) else k
        overlap = [self.overlap[: depth + 1]]
        have = int(self.overlap[depth])
        while depth < n and self.reach(depth, have, n):
            step = candidate[depth : depth + self.STRIDE]
            at = np.minimum(np.searchsorted(self.sorted, step), self.size - 1)
            sums = have + np.cumsum(self.sorted[at] == step)
            overlap.append(sums)
            have, depth = int(sums[-1]), depth + len(step)
        self.path, self.overlap = candidate, np.concatenate(overlap)
        if depth < n:
            self.given_up, self.shared = packed[: 6 * depth], have
        return depth == n and 100 * have >= self.percent * (self.size + n - have)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, descent = None, None
        for batch in batches:
            out: list[list] = [[], []]
            for a, b, probe, grams in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("probe"), batch.column("grams").to_pylist(), strict=True):
                if descent is None or at != a:
                    at, descent = a, Descent(_unpacked(probe.as_py()), percent)
                if descent.matches(grams):
                    out[0].append(a)
                    out[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in out], names=["a", "b"])

    return run


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs that are as alike as asked. Joins deal a probe with many candidates out anew; a part of them is a tree of its own."""
    candidates = pairs.join(sets.withColumnRenamed("rep", "b"), "b")
    both = candidates.join(sets.select(F.col("rep").alias("a"), F.col("grams").alias("probe")), "a")
    return both.select("a", "b", "probe", "grams").sortWithinPartitions("a", "grams").mapInArrow(_verify(percent), "a long, b long")


def _pairs(rows: DataFrame, *partners: str) -> DataFrame:
    """A row's best partners over all n-grams: at most one pair for each kind and row."""
    best = rows.groupBy("rep").agg(F.min("least").alias("least"), F.min(F.struct("distance", "nearest"))["nearest"].alias("nearest"))
    both = best.select("rep", F.explode(F.array(*partners)).alias("with")).where("rep != with")
    return both.select(F.least("rep", "with").alias("a"), F.greatest("rep", "with").alias("b")).distinct()


def _not_joined(rows: DataFrame, joined: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows of the groups that hold more than one component, each with its own and with its counts."""
    labelled = rows.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    apart = labelled.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("gram")
    return labelled.join(apart, "gram", "left_semi").join(vectors, ["rep", "n"]).select("gram", "rep", "n", "vector", "component")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs: its set's size and the least doc_id that links reach.

    A set is the distinct word n-grams of the whole text (A-Z lower-cased; a text
    of fewer words has its whole sequence as one); two rows link if their sets'
    overlap is at least percent/100 of their union. Rows without words (null,
    empty or blank texts) have size 0 and link with nothing. Repeated rows are
    linked with one another; rows of equal doc_id but different text keep
    their own sets and share whatever their id is linked to. Rows with a null
    doc_id are in no group: their component is null. Other columns are not
    read. An empty table gives no rows. Exact at any skew; bounds and the
    global order change the work alone."""
    if not 1 <= percent <= 100 or words < 1:
        raise ValueError("percent must be from 1 to 100 and words positive")
    spark = docs.sparkSession
    small_batches(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    docs = docs.select("doc_id", "text")
    with scope() as outlive:
        counted = docs.select("text").mapInArrow(_count_frequent(words, 3), "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times"))
        top = counted.orderBy(F.desc("times"), "gram").limit(FREQUENT).toArrow()
        by_hash = np.argsort(top.column("gram").to_numpy().view(np.uint64)) if top.num_rows else np.zeros(0, dtype=np.int64)
        frequent = top.column("gram").to_numpy().view(np.uint64)[by_hash] if top.num_rows else np.zeros(0, dtype=np.uint64)
        rank = (top.num_rows - by_hash).astype(np.int32)  # rows came by falling frequency
        schema = "doc_id long, n long, a long, b long, prefix array<long>, vector binary, fine binary"
        info = cut(docs.mapInArrow(_describe(words, percent, frequent, rank, _arrow_schema(spark, schema)), schema))
        sizes = outlive(cut(info.select("doc_id", "n", "a", "b")))
        known = sizes.where("n > 0 AND doc_id IS NOT NULL")
        reps = known.groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep"))
        chosen = info.join(reps.select(F.col("rep").alias("doc_id"), "n", "a", "b"), ["doc_id", "n", "a", "b"], "left_semi").withColumnRenamed("doc_id", "rep")
        under = chosen.select("rep", "n", F.explode("prefix").alias("gram"))
        shared = cut(under.withColumn("many", F.count("*").over(Window.partitionBy("gram"))).where("many > 1").select("gram", "rep", "n"))
        vectors = chosen.select(F.col("rep").alias("vrep"), F.col("n").alias("vn"), "vector")
        active = cut(shared.join(vectors, (F.col("rep") == F.col("vrep")) & (F.col("n") == F.col("vn"))).select("gram", "rep", "n", "vector"), shared)
        in_groups = lambda df: df.repartition(parts, "gram").sortWithinPartitions("gram", "n", "rep")
        partners = "gram long, rep long, n long, vector binary, least long, distance long, nearest long"
        verified = lambda pairs: cut(_links(pairs, (sets := _sets_of(docs, pairs, words, frequent, rank)), percent), pairs, sets)
        edges = lambda joined, *more: reduce(DataFrame.union, [joined.select(F.col("node").alias("a"), F.col("component").alias("b")), *more])
        found = cut(in_groups(active).mapInArrow(_partners(percent, False), partners), active)
        joined = components(links := verified(cut(_pairs(found, "nearest"))))
        drop(links)
        live = found.select("gram", "rep", "n")
        fine = cut(chosen.select("rep", "n", F.col("fine").alias("vector")).join(live.select("rep", "n").distinct(), ["rep", "n"], "left_semi"), info)
        rows = _not_joined(live, joined, fine)
        links = verified(cut(_pairs(in_groups(rows).mapInArrow(_partners(percent, True), partners), "least", "nearest")))
        joined = components(edges(joined, links))
        drop(links)
        rows = _not_joined(live, joined, fine)
        links = verified(cut(in_groups(rows).mapInArrow(_remaining(percent), "a long, b long").distinct(), found, fine))
        same_set = known.join(reps, ["n", "a", "b"]).where("doc_id != rep").select(F.col("doc_id").alias("b"), F.col("rep").alias("a"))
        final = outlive(components(edges(joined, links, same_set.select("a", "b"))))
    return sizes.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with the document of least doc_id of each group; all columns stay.

    Groups are those of near_groups with each distinct text of a doc_id (null
    as empty) a document of its own: unlike texts of one id all stay, of equal
    rows one does, and among near copies of one id a hash decides. Documents
    without words and rows without doc_id are in no group and stay."""
    keyed = docs.where("doc_id IS NOT NULL").withColumn("_key", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    groups = near_groups(keyed.select(F.col("_key").alias("doc_id"), "text"), words, percent).select(F.col("doc_id").alias("_key"), "component_id")
    members = groups.distinct().join(keyed.select("_key", "doc_id").distinct(), "_key")
    heads = members.groupBy("component_id").agg(F.min(F.struct("doc_id", "_key"))["_key"].alias("_key")).select("_key")
    kept = keyed.join(heads, "_key", "left_semi").dropDuplicates(["_key"])
    return kept.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))
