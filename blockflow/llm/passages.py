"""Removal of byte strings of a given length that occur more than once in the corpus, by prefix-free parsing.

Rolling-hash triggers cut every text into overlapping phrases: a trigger is the
position whose hash of `gram` bytes is the least among the positions of some
window, so every string of the asked length holds the trigger it chooses, and
equal strings choose alike wherever they stand. Triggers met once in the corpus
cannot lie in a repeat and fall away.

The parse keeps of each occurrence of the others what the strings that choose
it cover: the end of the phrase before the trigger and the continuation after
it, as a number of 64 bits. Equal occurrences are counted, not gathered, so that
a passage in very many texts is one row. The dictionary holds the bytes of the
distinct ones under a trigger that has several. As every string holds its
trigger, the corpus' suffixes fall into one group for each trigger, and there
two suffix arrays give their order: that of the dictionary, in which phrases are
sorted from the trigger backwards, and that of the parse, in which continuations
are sorted forwards. A string that begins d bytes before its trigger occurs
twice if neighbours in the one order agree on d bytes and in the other on the
rest, which the arrays of common prefixes tell for all d.

Triggers with very many distinct surroundings are taken apart by d: strings of a
slice of places share the bytes that all of the slice hold, what lies outside
those is compared as a number, and only where that leaves several are the
slice's strings counted one by one. All of that is counting, with no group held
anywhere. Identical texts stand for one another from the start."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, cut, drop, scope, small_batches

BASE = np.uint64(0x9E3779B97F4A7C15)
BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Triggers with more distinct surroundings than this are taken apart by slices of places; any number gives the same result.
HOT_TEXTS = 20_000
SLICES = 8
#: Bytes handled at once; a longer text is handled alone.
BUFFER = 1 << 20
#: Rows of the dictionary that are put in order at once, if no trigger has more.
ORDERED = 4096


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


class _Powers:
    """Powers of the base and of its inverse modulo 2^64."""

    def __init__(self):
        self.inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                self.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, BASE, dtype=np.uint64))])
                self.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, self.inverse, dtype=np.uint64))])
        return self.up, self.down


_powers = _Powers()


class Phrases:
    """Several texts in one buffer with the trigger that every string of `length` bytes chooses."""

    def __init__(self, texts: list[bytes], length: int, gram: int):
        self.length = length
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        n = len(data)
        up, down = _powers.get(n + 1)
        with np.errstate(over="ignore"):
            self.prefix = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(BYTE[data] * up[:n], out=self.prefix[1:])
            windows = max(0, n - length + 1)
            grams = max(0, n - gram + 1)
            self.gram = _mix((self.prefix[gram : gram + grams] - self.prefix[:grams]) * down[:grams])
        #: Strings that lie within one text.
        self.string = self.chosen = self.text = np.zeros(0, dtype=np.int64)
        if not windows:
            return
        low = (self.gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(grams, dtype=np.uint64)
        wide, span = length - gram + 1, 1
        while 2 * span <= wide:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if wide > span:
            low = np.minimum(low[: -(wide - span)], low[wide - span :])
        place = np.arange(windows)
        text = np.repeat(np.arange(len(texts)), sizes)[:windows]
        inside = place + length <= self.start[text + 1]
        self.string = place[inside]
        self.chosen = (low[:windows][inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        self.text = text[inside]

    def hashed(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from begin to end, wherever they stand."""
        _, down = _powers.get(len(self.prefix))
        with np.errstate(over="ignore"):
            return _mix((self.prefix[end] - self.prefix[begin]) * down[begin])

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """text, trigger, first string and last string of the runs of strings that choose the same trigger."""
        if not len(self.string):
            e = np.zeros(0, dtype=np.int64)
            return e, e, e, e
        new = np.flatnonzero((np.diff(self.chosen) != 0) | (np.diff(self.string) != 1)) + 1
        first, last = np.concatenate([[0], new]), np.concatenate([new - 1, [len(self.string) - 1]])
        return self.text[first], self.chosen[first], self.string[first], self.string[last]


def _buffers(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Neighbouring texts that fit one buffer, with the index of the first."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BUFFER:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if texts:
        yield at, texts[at:]


def _merge(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _spans_of(owner: np.ndarray, first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings first..last of each owner as merged spans of bytes."""
    if not len(owner):
        return owner, first, last
    order = np.lexsort((first, owner))
    owner, a, b = owner[order], first[order], last[order] + length
    new = np.ones(len(a), dtype=bool)
    # spans of an owner overlap or touch what came before if they begin within the farthest end so far
    far = np.maximum.accumulate(b + np.cumsum(np.concatenate([[0], (np.diff(owner) != 0)])) * (1 << 40))
    reach = far - np.cumsum(np.concatenate([[0], (np.diff(owner) != 0)])) * (1 << 40)
    new[1:] = (owner[1:] != owner[:-1]) | (a[1:] > reach[:-1])
    heads = np.flatnonzero(new)
    tails = np.concatenate([heads[1:] - 1, [len(a) - 1]])
    return owner[heads], a[heads], reach[tails]


def _triggers(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column("h").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
            unique = dict(zip(names, texts, strict=True))
            names = np.array(list(unique), dtype=np.int64)
            for at, part in _buffers(list(unique.values())):
                p = Phrases(part, length, gram)
                text, trigger, _, _ = p.runs()
                pairs = np.stack([p.gram[trigger].view(np.int64), names[at + text]]) if len(text) else np.zeros((2, 0), np.int64)
                order = np.lexsort(pairs)
                pairs = pairs[:, order]
                head = np.flatnonzero(np.concatenate([[True], (np.diff(pairs[0]) != 0) | (np.diff(pairs[1]) != 0)])) if len(order) else order
                times = np.diff(np.concatenate([head, [len(order)]])) if len(order) else order
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0, head]), pa.array(pairs[1, head]), pa.array(times > 1)], names=["trigger", "h", "again"])

    return run


def _parse(length: int, gram: int):
    """Occurrences of repeated triggers: the strings from lo to hi bytes before the trigger at place choose it; context stands for all that they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("h").to_numpy()
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            lists = batch.column("triggers")
            wanted, edges = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum([len(x) for x in lists])])
            for at, part in _buffers(texts):
                p = Phrases(part, length, gram)
                text, trigger, first, last = p.runs()
                key = p.gram[trigger].view(np.int64) if len(text) else text
                keep = np.zeros(len(text), dtype=bool)
                edge = np.searchsorted(text, np.arange(len(part) + 1))
                for i in range(len(part)):
                    keep[edge[i] : edge[i + 1]] = np.isin(key[edge[i] : edge[i + 1]], wanted[edges[at + i] : edges[at + i + 1]])
                text, trigger, first, last, key = (x[keep] for x in (text, trigger, first, last, key))
                lo, hi = trigger - last, trigger - first
                context = p.hashed(first, last + length) ^ _mix((lo << 32 | hi).astype(np.uint64))
                columns = (key, context.view(np.int64), names[at + text], trigger - p.start[text], lo, hi)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["trigger", "context", "h", "place", "lo", "hi"])

    return run


def _each(fn, schema: pa.Schema):
    """Rows that fn gives for each text and each of its wanted occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for h, text, wanted in zip(batch.column("h").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                for w in wanted:
                    for row in fn(h, text, **w):
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _number(*parts: bytes | int) -> int:
    whole = b"".join(p if isinstance(p, bytes) else p.to_bytes(8, "little", signed=True) for p in parts)
    return int.from_bytes(hashlib.blake2b(whole, digest_size=8).digest(), "little", signed=True)


def _surroundings(length: int, gram: int):
    """The dictionary's bytes: before the trigger, from it backwards, and after it."""

    def rows(h: int, text: bytes, trigger: int, place: int, lo: int, hi: int):
        yield trigger, h, place, lo, hi, text[place - hi : place][::-1], text[place + gram : place - lo + length]

    return rows


def _slices(length: int, gram: int):
    """A hot trigger's strings by slices of places: key for the bytes that all strings of the slice hold, outer for all that this one's cover."""
    reach = length - gram
    wide = -(-(reach + 1) // SLICES)

    def rows(h: int, text: bytes, trigger: int, place: int, lo: int, hi: int):
        for low in range(0, reach + 1, wide):
            high = min(reach, low + wide - 1)
            x, y = max(lo, low), min(hi, high)
            if x <= y:
                yield _number(trigger, low, text[place - low : place - high + length]), _number(x, y, text[place - y : place - x + length]), h, place, x, y

    return rows


def _strings(length: int):
    def rows(h: int, text: bytes, place: int, lo: int, hi: int):
        for at in range(place - hi, place - lo + 1):
            s = text[at : at + length]
            yield _number(s), _number(b"second", s), h, at

    return rows


def _common(rows: list[bytes], wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows as lines of a grid, padded by zeros, and as sortable strings."""
    grid = np.zeros((len(rows), max(1, wide)), dtype=np.uint8)
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.frombuffer(b"".join(rows), dtype=np.uint8)
    line = np.repeat(np.arange(len(rows)), sizes)
    grid[line, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return grid, grid.view(f"S{grid.shape[1]}").ravel()


def _ranked(key: np.ndarray, rows: list[bytes], wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the rows within their triggers, and the bytes each has in common with the one before (-1: another trigger)."""
    grid, strings = _common(rows, wide)
    order = np.lexsort((strings, key))
    common = np.full(len(rows), -1, dtype=np.int64)
    if len(rows) > 1:
        same = key[order[1:]] == key[order[:-1]]
        unlike = grid[order[1:]] != grid[order[:-1]]
        common[1:] = np.where(same, np.where(unlike.any(axis=1), unlike.argmax(axis=1), grid.shape[1]), -1)
    return order, common


def _repeats(length: int, gram: int, schema: pa.Schema):
    """Of the dictionary in order of its triggers: the strings that occur twice or more, as spans of their texts."""
    reach = length - gram

    def resolve(part: pa.RecordBatch) -> pa.RecordBatch:
        key, names, place, lo, hi = (part.column(c).to_numpy() for c in ("trigger", "h", "place", "lo", "hi"))
        n = len(key)
        by_end, end_common = _ranked(key, part.column("before").to_pylist(), reach)
        by_rest, rest_common = _ranked(key, part.column("after").to_pylist(), reach)
        ends, rests = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for d in range(int(lo.min()), int(hi.max()) + 1):
            ends[by_end] = np.cumsum(end_common < d)  # rows that agree on the d bytes before the trigger
            rests[by_rest] = np.cumsum(rest_common < reach - d)  # and on what the string has after it
            rows = np.flatnonzero((lo <= d) & (hi >= d))
            both = ends[rows] * (n + 1) + rests[rows]
            order = np.argsort(both, kind="stable")
            equal = np.diff(both[order]) == 0
            twice = np.zeros(len(rows), dtype=bool)
            twice[order[1:][equal]] = True
            twice[order[:-1][equal]] = True
            found.append((rows[twice], place[rows[twice]] - d))
        rows, at = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        text, back = np.unique(names[rows], return_inverse=True)
        owner, a, b = _spans_of(back, at, at, length)
        return pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (text[owner], a, b)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while batch.num_rows:
                key = batch.column("trigger").to_numpy()
                ends = np.concatenate([np.flatnonzero(np.diff(key)) + 1, [len(key)]])
                if size >= ORDERED:  # the last trigger's rows may go on
                    more = int(ends[0]) if held[-1].column("trigger")[-1].as_py() == key[0] else 0
                    if more == len(key):
                        held.append(batch)
                        break
                    yield resolve(_joined([*held, batch.slice(0, more)]))
                    held, size, batch = [], 0, batch.slice(more)
                    continue
                take = int(ends[min(np.searchsorted(ends, ORDERED - size), len(ends) - 1)])
                held.append(batch.slice(0, take))
                size += take
                batch = batch.slice(take)
        if held:
            yield resolve(_joined(held))

    return run


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _kept(schema: pa.Schema, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]
            for h, text, spans, wider in zip(batch.column("h").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), batch.column("covered").to_pylist(), strict=True):
                merged = _merge([(s["lo"], s["hi"]) for s in spans or ()])
                kept, at = [], 0
                for a, b in merged:
                    kept.append(text[at:a])
                    at = b
                rest = b"".join([*kept, text[at:]])
                covered = sum(b - a for a, b in _merge([(s["lo"], s["hi"]) for s in wider or ()]))
                row = (h, False, sum(b - a for a, b in merged), len(merged), hashlib.sha256(rest).hexdigest(), covered, *((rest.decode("utf-8", "replace"),) if with_text else ()))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def _key() -> Column:
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.xxhash64(text, F.octet_length(text))


def _spans(shared: DataFrame, length: int, gram: int) -> DataFrame:
    """h and spans (lo, hi; some overlap) of the bytes that strings of `length` bytes occurring twice or more cover, of texts with their repeated triggers."""
    spark = shared.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    mapped = lambda rows, fn, schema: rows.mapInArrow(_each(fn, _arrow_schema(spark, schema)), schema)
    texts = shared.select("h", "text")
    parse = cut(shared.select("h", "text", "triggers").mapInArrow(_parse(length, gram), "trigger long, context long, h long, place long, lo long, hi long"))
    contexts = cut(parse.groupBy("trigger", "context").agg(F.count("*").alias("times"), F.min_by("place", "h").alias("place"), F.min("h").alias("h"), F.min("lo").alias("lo"), F.min("hi").alias("hi")))
    span = lambda lo, hi: (F.col("h"), (F.col("place") - F.col(hi)).alias("lo"), (F.col("place") - F.col(lo) + length).alias("hi"))
    whole = parse.join(contexts.where("times > 1").select("trigger", "context"), ["trigger", "context"]).select(*span("lo", "hi"))
    mixed = contexts.groupBy("trigger").agg(F.count("*").alias("many")).where("many > 1")
    several = cut(contexts.join(mixed, "trigger").select("trigger", "h", "place", "lo", "hi", (F.col("many") > HOT_TEXTS).alias("hot")))
    listed = lambda rows, *fields: texts.join(rows.groupBy("h").agg(F.collect_list(F.struct(*fields)).alias("wanted")), "h").select("h", "text", "wanted")
    dictionary = mapped(listed(several.where("NOT hot"), "trigger", "place", "lo", "hi"), _surroundings(length, gram), "trigger long, h long, place long, lo long, hi long, before binary, after binary")
    result = "h long, lo long, hi long"
    few = dictionary.repartition(parts, "trigger").sortWithinPartitions("trigger").mapInArrow(_repeats(length, gram, _arrow_schema(spark, result)), result)
    slices = cut(mapped(listed(several.where("hot"), "trigger", "place", "lo", "hi"), _slices(length, gram), "key long, outer long, h long, place long, lo long, hi long"))
    kinds = slices.groupBy("key", "outer").agg(F.count("*").alias("times"), F.min_by("place", "h").alias("place"), F.min("h").alias("h"), F.min("lo").alias("lo"), F.min("hi").alias("hi"))
    sliced = slices.join(kinds.where("times > 1").select("key", "outer"), ["key", "outer"]).select(*span("lo", "hi"))
    unlike = kinds.join(kinds.groupBy("key").agg(F.count("*").alias("many")).where("many > 1"), "key").select("h", "place", "lo", "hi")
    strings = cut(mapped(listed(unlike, "place", "lo", "hi"), _strings(length), "k long, l long, h long, at long"))
    twice = strings.groupBy("k", "l").agg(F.count("*").alias("times")).where("times > 1").select("k", "l")
    single = strings.join(twice, ["k", "l"]).select("h", F.col("at").alias("lo"), (F.col("at") + length).alias("hi"))
    found = reduce(DataFrame.union, [whole, few, sliced, single])
    return cut(found.groupBy("h").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), parse, contexts, several, slices, strings)


def _outcome(docs: DataFrame, length: int, covered: int, with_text: bool) -> DataFrame:
    """h, copies (whether identical texts stand elsewhere), n_removed, n_spans, kept_sha256, n_covered and perhaps kept_text of the texts that may hold repeats; of copies the first two alone."""
    if not 8 <= covered <= length:
        raise ValueError("length must be 8 or more")
    spark = docs.sparkSession
    small_batches(spark)
    gram = covered * 2 // 5
    with scope() as outlive:
        keyed = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), _key().alias("h"))
        long = keyed.where(F.octet_length("text") >= covered)
        triggers = cut(long.select("h", "text").mapInArrow(_triggers(covered, gram), "trigger long, h long, again boolean"))
        repeated = triggers.groupBy("trigger").agg(F.min("h").alias("a"), F.max("h").alias("b"), F.max("again").alias("again")).where((F.col("a") != F.col("b")) | F.col("again")).select("trigger")
        per_text = triggers.select("trigger", "h").join(repeated, "trigger").groupBy("h").agg(F.collect_set("trigger").alias("triggers"))
        copies = cut(long.groupBy("h").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep")))
        flagged = per_text.join(copies, "h").withColumnRenamed("h", "fh")
        shared = cut(long.join(flagged, (F.col("h") == F.col("fh")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("h", "text", "triggers", "copies"), triggers)
        spans = _spans(shared, length, gram)
        wider = _spans(shared, covered, gram) if covered < length else spans
        result = "h long, copies boolean, n_removed long, n_spans long, kept_sha256 string, n_covered long" + (", kept_text string" if with_text else "")
        per_text = spans.join(wider.withColumnRenamed("spans", "covered"), "h", "full")
        single = shared.where("copies = 1").join(per_text, "h").select("h", "text", "spans", "covered").mapInArrow(_kept(_arrow_schema(spark, result), with_text), result)
        none = [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in result.split(", ")[2:]]
        return outlive(cut(single.unionByName(copies.where("copies > 1").select("h", F.lit(True).alias("copies"), *none))))


def remove_repeats(docs: DataFrame, length: int = 400, covered: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs; with `covered`, n_covered besides.

    Texts count as UTF-8 bytes; each byte covered by a string of `length` bytes
    that also starts elsewhere, in the same or another row, goes. Overlaps
    count, no string crosses texts, and strings are judged on the input. A null
    text counts as empty and texts under `length` bytes lose nothing; repeated
    rows and ids are rows of their own, so equal long texts go whole. n_covered
    is what strings of `covered` bytes (at most `length`) that start elsewhere
    too would cover. Other columns are not read. An empty table gives no rows."""
    text = F.coalesce(F.col("text"), F.lit(""))
    all_docs = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), _key().alias("h"), F.sha2(text.cast("binary"), 256).alias("sha"))
    joined = all_docs.join(_outcome(docs, length, covered or length, False), "h", "left")
    copy = F.coalesce("copies", F.lit(False))
    gone = copy & (F.col("n_bytes") >= length)
    count = lambda name: F.coalesce(name, F.lit(0)).cast("long")
    return joined.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(count("n_removed")).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(count("n_spans")).cast("long").alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        *([F.when(copy & (F.col("n_bytes") >= covered), F.col("n_bytes")).otherwise(count("n_covered")).alias("n_covered")] if covered else []),
    )


def without_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs, each text without what remove_repeats takes from it; documents that lose everything go.

    A character cut in two becomes U+FFFD. All columns stay, n_chars follows the
    text if it is there; null and short texts stay as they are."""
    outcome = _outcome(docs, length, length, True).select(F.col("h").alias("_h"), F.col("copies").alias("_copies"), F.col("n_removed").alias("_removed"), F.col("kept_text").alias("_kept"))
    joined = docs.withColumn("_own", _key()).join(outcome, F.col("_own") == F.col("_h"), "left")
    changed = F.coalesce(F.col("_copies"), F.lit(False)) | (F.coalesce(F.col("_removed"), F.lit(0)) != 0)
    joined = joined.where(~changed | (F.length("_kept") > 0)).withColumn("text", F.when(changed, F.col("_kept")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(changed, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return joined.select(*docs.columns)
