"""Scores of texts by prediction by partial matching over bytes, beside those of a word-frequency base.

The model is a trie of byte contexts up to `order` bytes with the counts of the
symbols that follow, gathered from every training text. A symbol's probability
comes from the longest context that knows it; each context that doesn't costs
an escape (estimated from its number of distinct symbols, method C) and
excludes its symbols further down. A shorter context knows all that a longer
one knows, so what is excluded depends on the context alone and its sums are
kept with the trie. Every distinct n-gram of the corpus gets its probability
once, in parts of the trie that share the last bytes of their contexts; the
frequent ones go to all workers, the others' are joined to the texts. Begin and
end of a text are bytes that UTF-8 never uses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _arrow_schema, cut, small_batches
from .near import _buffers, _texts, shingles

BEGIN, END = 0xFE, 0xFF
#: Bytes of context.
ORDER = 5
#: N-grams whose probabilities go to all workers, at most so many, the most frequent; the others' are joined.
NODES = 1_000_000
#: Last bytes of a context that deal the trie out; shorter contexts have 256 ** SHARED entries at most and go to all parts.
SHARED = 2
#: Words whose counts go to all workers; the others' counts are joined.
COMMON_WORDS = 500_000
#: The end of a text as a token.
END_TOKEN = 1


def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each symbol of each text and its end: the `order` bytes before it and itself in one integer; and where texts begin."""
    pad = bytes([BEGIN]) * order
    data = np.frombuffer(b"".join(pad + t + bytes([END]) for t in texts), dtype=np.uint8).astype(np.uint64)
    code = np.zeros(max(0, len(data) - order), dtype=np.uint64)
    for k in range(order + 1):
        code = (code << np.uint64(8)) | data[k : k + len(code)]
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    keep = np.arange(begin[-1]) + np.repeat(np.arange(len(texts)) * order, sizes)
    return code[keep], begin


class Trie:
    """Counts by context length; entry (context, symbol) is the integer context * 256 + symbol."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.code = [c for c, _ in levels]
        self.count = [n.astype(np.float64) for _, n in levels]
        self.context, self.total, self.kinds, self.hidden = [], [], [], []
        for j, (code, n) in enumerate(zip(self.code, self.count, strict=True)):
            context, first = np.unique(code >> np.uint64(8), return_index=True)
            total = np.add.reduceat(n, first) if len(first) else n
            kinds = np.diff(np.concatenate([first, [len(code)]])).astype(np.float64)
            hidden = np.zeros(len(context))
            if j and len(code):  # what the next shorter context has of the symbols known here
                shorter = code & np.uint64((1 << (8 * j)) - 1)
                at = np.minimum(np.searchsorted(self.code[j - 1], shorter), len(self.code[j - 1]) - 1)
                if not np.array_equal(self.code[j - 1][at], shorter):
                    raise ValueError("a shorter context must know what a longer one knows")
                hidden = np.add.reduceat(self.count[j - 1][at], first)
            for store, x in ((self.context, context), (self.total, total), (self.kinds, kinds), (self.hidden, hidden)):
                store.append(x)

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 of the probability of each n-gram's last symbol after the others."""
        out = np.zeros(len(code))
        open_, gone_total, gone_kinds = np.arange(len(code)), np.zeros(len(code)), np.zeros(len(code))
        for j in range(len(self.code) - 1, -1, -1):
            if not len(open_) or not len(self.code[j]):
                continue
            own = code[open_] & np.uint64((1 << (8 * (j + 1))) - 1)
            c = np.minimum(np.searchsorted(self.context[j], own >> np.uint64(8)), len(self.context[j]) - 1)
            seen = self.context[j][c] == own >> np.uint64(8)
            total, kinds = self.total[j][c] - gone_total[open_], self.kinds[j][c] - gone_kinds[open_]
            e = np.minimum(np.searchsorted(self.code[j], own), len(self.code[j]) - 1)
            hit = seen & (self.code[j][e] == own)
            out[open_[hit]] += np.log10(self.count[j][e[hit]] / (total[hit] + kinds[hit]))
            miss = seen & ~hit
            pay = miss & (kinds > 0)
            out[open_[pay]] += np.log10(kinds[pay] / (total[pay] + kinds[pay]))
            gone_total[open_[miss]], gone_kinds[open_[miss]] = self.hidden[j][c[miss]], self.kinds[j][c[miss]]
            if j == 0:
                gone_kinds[open_[miss]] = self.kinds[0][c[miss]]
            open_ = open_[~hit]
        out[open_] -= np.log10(256 - gone_kinds[open_])
        return out


def _gather(order: int):
    """Counts of n-grams (level 0) and of words (level 1) in the training texts, and n-grams of the held out with count 0; each batch in buffers, summed a task at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for level, parts in enumerate(held):
                if parts:
                    code, n = summed(parts)
                    for i in range(0, len(code), 200_000):
                        c = code[i : i + 200_000]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), level, dtype=np.int32)), pa.array(c.view(np.int64)), pa.array(n[i : i + 200_000])], names=["level", "code", "times"])
                parts.clear()

        for batch in batches:
            texts, aside = _texts(batch), batch.column("held_out").to_pylist()
            for trains in (True, False):
                for _, part in _buffers([t for t, h in zip(texts, aside, strict=True) if h != trains]):
                    codes = [grams(part, order)[0]]
                    if trains:
                        codes.append(np.concatenate([shingles(part, 1)[0], np.full(len(part), END_TOKEN, dtype=np.uint64)]))
                    for parts, code in zip(held, codes, strict=False):
                        u, n = np.unique(code, return_counts=True)
                        parts.append((u, n.astype(np.int64) * trains))
                        size += len(u)
                if size > 4_000_000:
                    before = size
                    for parts in held:
                        parts[:] = [summed(parts)]
                    size = sum(len(p[0][0]) for p in held)
                    if size > before // 2:
                        yield from flush()
                        size = 0
        yield from flush()

    return run


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    code = np.concatenate([c for c, _ in parts])
    n = np.concatenate([n for _, n in parts])
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else order
    return code[first], np.add.reduceat(n, first) if len(first) else n


def _lower(code: np.ndarray, n: np.ndarray, longest: int, shortest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The trie's entries for context lengths shortest to longest, from those of the longest."""
    levels = [summed([(code, n)])]
    for j in range(longest - 1, shortest - 1, -1):
        c, m = levels[-1]
        levels.append(summed([(c & np.uint64((1 << (8 * (j + 1))) - 1), m)]))
    return levels[::-1]


def _probabilities(order: int, shared: int, short: list[tuple[np.ndarray, np.ndarray]]):
    """log10 of each n-gram's probability. A part of them holds all that end in the same `shared` bytes of context, so its counts of longer contexts are whole; `short` has the shorter ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("code").to_numpy().view(np.uint64), b.column("times").to_numpy()) for b in batches if b.num_rows]
        if not held:
            return
        code, n = (np.concatenate(x) for x in zip(*held, strict=True))
        trains = n > 0
        value = Trie(short + _lower(code[trains], n[trains], order, shared)).log10(code)
        for i in range(0, len(code), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000]) for x in (code.view(np.int64), n, value)], names=["code", "times", "value"])

    return run


def _model(counts: DataFrame, order: int) -> DataFrame:
    """code, times and value (log10 of the probability) of every n-gram of the corpus; counts has times 0 where only held-out texts have it."""
    shared = min(SHARED, order)
    short = []
    if shared:
        tail = F.col("code").bitwiseAND(F.lit((1 << (8 * shared)) - 1)).alias("code")
        t = counts.where("times > 0").groupBy(tail).agg(F.sum("times").alias("times")).toArrow()
        short = _lower(t.column("code").to_numpy().view(np.uint64), t.column("times").to_numpy(), shared - 1, 0)
    part = F.shiftright("code", 8).bitwiseAND(F.lit((1 << (8 * shared)) - 1)).alias("part")
    dealt = counts.select("code", "times", part).repartition("part").select("code", "times")
    return cut(dealt.mapInArrow(_probabilities(order, shared, short), "code long, times long, value double"))


def _frequent(model: DataFrame, nodes: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and values of at most `nodes` n-grams, the most frequent by classes of their counts."""
    size = F.floor(8 * F.log2("times")).cast("int")
    by_size = model.where("times > 0").groupBy(size.alias("size")).agg(F.count("*").alias("entries")).toArrow().to_pylist()
    floor = None
    for r in sorted(by_size, key=lambda r: -r["size"]):
        if r["entries"] > nodes:
            break
        nodes, floor = nodes - r["entries"], r["size"]
    t = model.where((F.col("times") > 0) & (size >= F.lit(floor))).select("code", "value").toArrow()
    code, value = t.column("code").to_numpy().view(np.uint64), t.column("value").to_numpy()
    at = np.argsort(code)
    return code[at], value[at]


def _score(model, order: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, chance, common, times, all_tokens, kinds = model.value
        scale = np.log10(all_tokens + 0.5 * (kinds + 1))
        weight = np.log10(times + 0.5) - scale
        end = np.searchsorted(common, np.uint64(END_TOKEN))
        ended = len(common) > end and common[end] == END_TOKEN
        for batch in batches:
            texts = _texts(batch)
            rows: list[list] = [[], [], [], [], [], [], []]
            for _, part in _buffers(texts):
                code, begin = grams(part, order)
                u, back = np.unique(code, return_inverse=True)
                g = np.minimum(np.searchsorted(frequent, u), max(0, len(frequent) - 1))
                found = frequent[g] == u if len(frequent) else np.zeros(len(u), dtype=bool)
                total = np.add.reduceat(np.where(found, chance[g], 0.0)[back] if len(frequent) else np.zeros(len(code)), begin[:-1])
                at_rare = np.flatnonzero(~found[back])
                pair, times_in = np.unique((np.searchsorted(begin, at_rare, side="right") - 1) * len(u) + back[at_rare], return_counts=True)
                rare = u[pair % len(u)].view(np.int64)
                ends = np.searchsorted(pair // len(u), np.arange(len(part) + 1))
                word, at = shingles(part, 1)
                k = np.minimum(np.searchsorted(common, word), max(0, len(common) - 1))
                hit = common[k] == word if len(common) else np.zeros(len(word), dtype=bool)
                value = np.concatenate([[0.0], np.cumsum(np.where(hit, weight[k], 0.0) if len(common) else np.zeros(len(word)))])
                known = np.concatenate([[0], np.cumsum(hit)])
                n = np.diff(at)
                rows[0] += (n + 1).tolist()
                rows[1] += (known[at[1:]] - known[at[:-1]] + ended).tolist()
                rows[2] += (value[at[1:]] - value[at[:-1]] + (weight[end] if ended else np.log10(0.5) - scale)).tolist()
                rows[3] += total.tolist()
                rows[4] += [word[a:b][~hit[a:b]].view(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]
                rows[5] += [rare[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                rows[6] += [times_in[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            columns = [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), *rows]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def score_texts(docs: DataFrame, held_out, order: int = ORDER, nodes: int = NODES, common_words: int = COMMON_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    held_out is a Boolean column (null counts as false); rows where it is false
    train. A null text counts as empty: one token, its end. Repeated rows train
    and score each. With nothing to train on every base score is 0 and the model
    is uniform over bytes. Other columns are not read; an empty table gives no
    rows. Words are told apart by 64-bit hashes. The model has every n-gram and
    word of the training texts; nodes and common_words bound what is sent to
    all workers, not the results."""
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    gathered = own.select("text", "held_out").mapInArrow(_gather(order), "level int, code long, times long")
    counts = cut(gathered.groupBy("level", "code").agg(F.sum("times").alias("times")), partition_by="level")
    chances = _model(counts.where("level = 0").select("code", "times"), order)
    words = counts.where("level = 1").select("code", "times")
    all_tokens, kinds = words.agg(F.coalesce(F.sum("times"), F.lit(0)), F.count("*")).first()
    top = words.orderBy(F.desc("times"), "code").limit(common_words).toArrow()
    code, times = top.column("code").to_numpy().view(np.uint64), top.column("times").to_numpy()
    at = np.argsort(code)
    model = spark.sparkContext.broadcast((*_frequent(chances, nodes), code[at], times[at], all_tokens, kinds))
    schema = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>, grams array<long>, uses array<long>"
    numbered = own.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    scored = cut(numbered.mapInArrow(_score(model, order, _arrow_schema(spark, schema)), schema))
    rare = scored.select("row", F.explode("rare").alias("code")).join(words, "code", "left")
    scale = float(np.log10(all_tokens + 0.5 * (kinds + 1)))
    more = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("times", F.lit(0)) + 0.5) - F.lit(scale)).alias("more_score"), F.count("times").alias("more_known"))
    used = scored.select("row", F.explode(F.arrays_zip("grams", "uses")).alias("g")).select("row", F.col("g.grams").alias("code"), F.col("g.uses").alias("uses"))
    grams_more = used.join(chances.select("code", "value"), "code").groupBy("row").agg(F.sum(F.col("uses") * F.col("value")).alias("gram_score"))
    return scored.join(more, "row", "left").join(grams_more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(int(all_tokens)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_score", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("gram_score", F.lit(0.0))).alias("score"),
    )
