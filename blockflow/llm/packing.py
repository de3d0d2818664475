"""Packing token sequences: first-fit decreasing by a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, Vocabulary
from .common import _arrow_schema, arrow_map, small_batches


class CapacityTree:
    """Tournament tree: each inner node holds the larger capacity below it, so the first bin with room is found from the root."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [0] * self.leaves + [capacity] * bins + [0] * (self.leaves - bins)
        for i in range(self.leaves - 1, 0, -1):
            self.room[i] = max(self.room[2 * i], self.room[2 * i + 1])

    def put(self, size: int) -> int:
        """The first bin that has room for size; its capacity shrinks."""
        i, room = 1, self.room
        while i < self.leaves:
            i = 2 * i if room[2 * i] >= size else 2 * i + 1
        found = i - self.leaves
        room[i] -= size
        while i > 1:
            i >>= 1
            best = max(room[2 * i], room[2 * i + 1])
            if room[i] == best:
                break
            room[i] = best
        return found


def pack(lengths: list[int], capacity: int, least_cut: int = 32) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, sequence, offset) of the pieces of one group.

    What an item has beyond multiples of the capacity is packed whole, first-fit
    decreasing. Then the emptiest sequences are taken apart to fill holes of
    least_cut or more in the others, and what is left over goes to sequences
    of powers of two, which need no padding."""
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    rest = []
    for item, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((item, start, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((n % capacity, item, n - n % capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    bins: list[list[tuple[int, int, int]]] = []
    if rest:
        tree = CapacityTree(len(rest), capacity)
        bins = [[] for _ in rest]
        for n, item, start in rest:
            bins[tree.put(n)].append((item, start, n))
        bins = [b for b in bins if b]
    used = [sum(p[2] for p in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda i: (used[i], i))
    holes = [i for i in reversed(order) if least_cut <= capacity - used[i] < capacity]
    gone: set[int] = set()
    left: list[tuple[int, int, int]] = []
    for donor in order:
        if not holes or capacity - used[donor] < least_cut:
            break
        holes = [i for i in holes if i != donor]
        gone.add(donor)
        left = [*bins[donor]]
        while left and holes:
            item, start, n = left.pop()
            into = holes[0]
            take = min(n, capacity - used[into])
            bins[into].append((item, start, take))
            used[into] += take
            if take < n:
                left.append((item, start + take, n - take))
            if capacity - used[into] < least_cut:
                holes.pop(0)
        if left:
            break
    for i, b in enumerate(bins):
        if i not in gone:
            offset = 0
            for item, start, n in b:
                pieces.append((item, start, n, sequence, offset))
                offset += n
            sequence += 1
    total, offset, room = sum(p[2] for p in left), 0, 0
    for item, start, n in left:
        while n:
            if not room:
                room = 1 << (total.bit_length() - 1)
                total -= room
                offset = 0
            take = min(n, room)
            pieces.append((item, start, take, sequence, offset))
            start, n, offset, room = start + take, n - take, offset + take, room - take
            if not room:
                sequence += 1
    return pieces


_encodings: dict[str, tuple] = {}


def _encoding(path: str):
    if path not in _encodings:
        import tiktoken

        v = Vocabulary(path)
        by_rank = [made for made, _ in sorted(v.made_by.items(), key=lambda x: x[1][0])]
        if by_rank != sorted(by_rank):
            raise ValueError("ids of merged tokens must follow the merges' order")
        ranks = {v.tokens[i]: i for i in v.plain}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=v.special), set(v.special), len(v.tokens)
    return _encodings[path]


def ids_of(text: str, path: str) -> np.ndarray:
    encoding, special, _ = _encoding(path)
    return np.frombuffer(encoding._core_bpe.encode_to_tiktoken_buffer(text, special), dtype="<u4")


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 1, group_rows: int = 1024) -> DataFrame:
    """The pieces into which the documents' token ids are cut, each with its place in a sequence.

    Each row of docs (repeated rows and ids too) is packed on its own; a null
    text counts as empty and has just end_id. Rows are dealt to groups of about
    group_rows by a hash of their place in the input, so neither a hot source
    nor repeated ids fill a group, and a task holds one group at a time.
    sequence_id is unique over all groups. An empty table gives no rows."""
    spark = docs.sparkSession
    groups = max(1, math.ceil(docs.count() / group_rows))
    vocabulary = len(Vocabulary(tokenizer_file).tokens)
    if not 0 <= end_id < 1 << 32:
        raise ValueError("end_id must be an unsigned 32-bit integer")
    narrow = "<u2" if max(vocabulary - 1, end_id) < 1 << 16 else "<u4"

    def tokenise(cols: dict[str, list]) -> dict[str, list]:
        end = np.array([end_id], dtype=narrow)
        ids = [np.concatenate([ids_of(t or "", tokenizer_file).astype(narrow), end]).tobytes() for t in cols["text"]]
        return {"doc_id": cols["doc_id"], "row": cols["row"], "grp": cols["grp"], "ids": ids}

    row = F.monotonically_increasing_id()
    dealt = docs.select("doc_id", "text", row.alias("row")).withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
    ids = arrow_map(dealt, tokenise, "doc_id long, row long, grp long, ids binary")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sorted_ids = ids.repartition(parts, "grp").sortWithinPartitions("grp", "row")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    fields = _arrow_schema(spark, schema)
    small_batches(spark)

    def rows_of(group: int, doc_ids: list, ids: list[bytes]) -> pa.RecordBatch:
        arrays = [np.frombuffer(x, dtype=narrow) for x in ids]
        pieces = pack([len(a) for a in arrays], capacity)
        columns: list[list] = [[] for _ in fields]
        for item, start, n, sequence, offset in pieces:
            crc = zlib.crc32(arrays[item][start : start + n].astype("<u4").tobytes())
            for column, value in zip(columns, (doc_ids[item], start, n, crc, len(arrays[item]), group << 32 | sequence, offset), strict=True):
                column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, doc_ids, held = None, [], []
        for batch in batches:
            for group, doc_id, x in zip(batch.column("grp").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if group != at and held:
                    yield rows_of(at, doc_ids, held)
                    doc_ids, held = [], []
                at = group
                doc_ids.append(doc_id)
                held.append(x)
        if held:
            yield rows_of(at, doc_ids, held)

    return sorted_ids.mapInArrow(run, schema)
