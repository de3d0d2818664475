"""Removal of lines that stand, equal or nearly so, earlier in the corpus; DataFrame functions alone.

Lines within `edits` edits of one another share one of edits + 1 segments, as
each edit spoils one at most. Every distinct line is indexed by its segments
under its length, and probes the lengths up to `edits` shorter with the
substrings that a segment can have moved to (each segment's edits to the left
and to the right bound its shift). These keys are made of the lines alone that
share one of fewer, coarser keys with another line, as any two near lines do
(`_windows`). A line under a key meets the key's earliest
line first, one pair a key; what that proves to be a repeat asks no further, as
one near line that stands earlier is enough. The rest meet the other lines under
their keys, where numbers of some characters leave room for the edits. A compiled
distance lets few of the pairs that meet through; those are decided by an automaton whose states
for all diagonals of the band are the bits of one integer for each number of
edits; a character moves them all at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_SEPARATORS, cut, scope
from .native import let, span

#: Lines of fewer code points, in which two edits change too much of what they say, go only for equal ones; blank lines stay.
LEAST_CHARS = 20
#: Up to so many ids (of 8 bytes) are broadcast to pick the lines that have anything to meet; more are joined.
BROADCAST_IDS = 1 << 20
#: Characters whose numbers tell lines apart that share a key but more than the edits.
COUNTED = "etaoinsrludm "
_COUNTS = [f"n{k}" for k in range(len(COUNTED))]


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether the edit distance of two strings (code points) is at most `edits`; banded and bit-parallel.

    Bit d + edits of state e says: e edits turn what was read of a into as much of b, and d more."""
    wide = 2 * edits + 1
    band = (1 << wide) - 1

    def body(x: Column, y: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            match = F.lit(0)
            for d in range(-edits, edits + 1):
                match = match.bitwiseOR(F.when(F.get(x, i) == F.get(y, i + d), 1 << (d + edits)).otherwise(0))
            return let(match, lambda m: moved(state, m))

        def moved(state: Column, m: Column) -> Column:
            new = [F.get(state, F.lit(0)).bitwiseAND(m)]
            for e in range(1, edits + 1):
                before = F.get(state, F.lit(e - 1))
                kept = F.get(state, F.lit(e)).bitwiseAND(m)
                # a changed character stays on its diagonal, one of a dropped falls back by one, one of b added goes on by one
                new.append(kept.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(new[e - 1], 1).bitwiseAND(F.lit(band))))
            return F.array(*new)

        start = F.array(*[F.lit(((1 << (e + 1)) - 1) << edits & band) for e in range(edits + 1)])
        ends = F.size(y) - F.size(x)
        last = F.aggregate(span(0, F.size(x) - 1), start, step)
        reached = F.call_function("shiftright", F.get(last, F.lit(edits)), ends + edits).bitwiseAND(F.lit(1)) == 1
        return F.when(F.abs(ends) > edits, F.lit(False)).otherwise(reached)

    chars = lambda s: F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))
    return let(F.struct(chars(a).alias("x"), chars(b).alias("y")), lambda p: body(p["x"], p["y"]))


def _segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment i of a line: the later segments take what an even cut leaves over."""
    base, longer = F.floor(length / (edits + 1)).cast("int"), F.pmod(length, F.lit(edits + 1))
    from_longer = F.lit(i - edits - 1) + longer
    return base * i + F.greatest(F.lit(0), from_longer), base + F.when(from_longer >= 0, 1).otherwise(0)


def with_segments(lines: DataFrame, edits: int) -> DataFrame:
    """lines with their length n, and start and size of the segments of lines as long and up to `edits` shorter.

    As columns they are worked out once a line, and at 2 edits the code that makes
    the keys stays within the 8,000 bytes beyond which the JVM leaves a method
    interpreted."""
    parts = {}
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            parts[f"start_{shorter}_{i}"], parts[f"size_{shorter}_{i}"] = _segment(F.col("n") - shorter, i, edits)
    return lines.withColumn("n", F.length("line")).withColumns(parts)


def _key(shorter: int, i: int, shift: int = 0) -> Column:
    """Key of segment i of the lines `shorter` than this one, found `shift` further on in it."""
    start = F.col(f"start_{shorter}_{i}") + shift + 1
    return F.xxhash64(F.col("n") - shorter, F.lit(i), F.substr(F.col("line"), start, F.col(f"size_{shorter}_{i}")))


def index_keys(edits: int) -> Column:
    """A line's own keys."""
    return F.array(*[_key(0, i) for i in range(edits + 1)])


def probe_keys(edits: int) -> Column:
    """Keys of the indexed lines up to `edits` shorter that this one may be near, beside its own index keys; null where a substring would leave the line."""
    out = []
    for shorter in range(edits + 1):
        for i in range(edits + 1):
            start = F.col(f"start_{shorter}_{i}")
            for o in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
                if shorter or o:
                    inside = (start + o >= 0) & (start + o + F.col(f"size_{shorter}_{i}") <= F.col("n"))
                    out.append(F.when(inside, _key(shorter, i, o)))
    return F.array(*out)


def _occurrences(docs: DataFrame, with_line: bool = True) -> DataFrame:
    """doc_id, version, place, h, g (together the line's identity, 96 bits of hash) and line of every line that is not blank. All is made before the texts are taken apart, so that no text is carried or hashed along with each of its lines."""

    def rows(version: Column) -> Column:
        fields = lambda x, i: F.struct(version.alias("version"), i.alias("place"), F.when(F.btrim(x, F.lit(WORD_SEPARATORS)) != "", F.xxhash64(x)).alias("h"), F.hash(x).alias("g"), *([x.alias("line")] if with_line else []))
        return F.filter(F.transform(F.split(text, "\n"), fields), lambda r: r["h"].isNotNull())

    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.explode(let(F.xxhash64(text), rows)).alias("r")).select("doc_id", "r.*")


def distinct_lines(docs: DataFrame) -> DataFrame:
    """id, h, g, times, first (doc_id, version, place) and line of the distinct lines, as a cut: the ids last no longer than it."""
    found = _occurrences(docs).groupBy("h", "g").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "version", "place", "line")).alias("m"))
    first = F.struct("m.doc_id", "m.version", "m.place").alias("first")
    return cut(found.select(F.monotonically_increasing_id().alias("id"), "h", "g", "times", first, "m.line"))


def _keyed(lines: DataFrame, edits: int) -> tuple[DataFrame, DataFrame]:
    """id, at (what orders lines) and key of the lines under their own keys; key, id and indexed (false) under those they probe."""
    long = with_segments(lines.where(F.length("line") >= LEAST_CHARS), edits)
    order = F.coalesce("first.doc_id", F.lit(-(1 << 63)))
    index = long.select("id", order.alias("at"), F.explode(index_keys(edits)).alias("key"))
    return index, long.select(F.explode(probe_keys(edits)).alias("key"), "id", F.lit(False).alias("indexed")).where("key IS NOT NULL")


def _windows(edits: int) -> Column:
    """Keys of which two lines within the edits share one, if they stand in a band of lengths together; of n, line, band and least (no line there is shorter).

    Cut the shorter line into edits + 1 segments. The first segment i that ends
    with at most i edits so far has none of its own, i before it and at most
    edits - i behind it, so from the nearer end of the line it has moved by
    min(i, edits - i) at most. Segments have that much room beyond a window whose
    size is the band's: the window at a segment's outer end in one of the lines
    is one of those up to so much further in of the other."""
    room = [min(i, edits - i) for i in range(edits + 1)]
    size = F.greatest(F.lit(0), F.floor((F.col("least") - sum(room)) / (edits + 1)).cast("int"))
    out = []
    for i, r in enumerate(room):
        for further in range(r + 1):
            if i <= edits - i:
                start = size * i + sum(room[:i]) + further
            else:
                start = F.col("n") - size * (edits - i + 1) - sum(room[i + 1 :]) - further
            out.append(F.xxhash64("band", F.lit(i), F.substr(F.col("line"), start + 1, size)))
    return F.array(*out)


def _windowed(lines: DataFrame, edits: int) -> DataFrame:
    """id and key of the lines under the keys of _windows, in their band of lengths and that of lines up to `edits` shorter."""
    wide = max(1, 4 * edits)
    band = lambda n: F.floor(n / wide).cast("int")
    long = lines.select("id", "line", F.length("line").alias("n")).where(F.col("n") >= LEAST_CHARS)
    banded = long.select("id", "line", "n", F.explode(F.sequence(band(F.col("n") - edits), band(F.col("n")))).alias("band"))
    return banded.withColumn("least", F.greatest(F.col("band") * wide, F.lit(LEAST_CHARS))).select("id", F.explode(_windows(edits)).alias("key"))


def _of_ids(lines: DataFrame, ids: DataFrame) -> DataFrame:
    return lines.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def companions(lines: DataFrame, edits: int) -> DataFrame:
    """id, first and line, as a cut, of the lines that share a key of _windows with another one: all that have a near line, and some more."""
    same = Window.partitionBy("key")
    shared = _windowed(lines, edits).select("id", (F.min("id").over(same) != F.max("id").over(same)).alias("shared"))
    ids = cut(shared.where("shared").select("id").distinct())
    return cut(_of_ids(lines.select("id", "first", "line"), ids), ids)


def _meetings(lines: DataFrame, edits: int) -> DataFrame:
    """key, id, indexed, pivot and many: the lines under keys that hold another one, with the key's earliest indexed line and their number."""
    index, probes = _keyed(lines, edits)
    pivots = index.groupBy("key").agg(F.count("*").alias("many"), F.min_by("id", "at").alias("pivot"))
    rows = index.select("key", "id", F.lit(True).alias("indexed")).union(probes)
    return cut(rows.join(pivots, "key").where("many > 1 OR pivot != id").select("key", "id", "indexed", "pivot", "many"))


def near_repeats(lines: DataFrame, edits: int) -> DataFrame:
    """id of the distinct lines within `edits` edits of one whose first place is earlier."""
    some = companions(lines, edits)
    met = _meetings(some, edits)
    ids = met.select("id").union(met.select(F.col("pivot").alias("id"))).distinct()
    lines = cut(_of_ids(some, ids).select("id", "first", "line", *[(F.length("line") - F.length(F.translate("line", c, ""))).alias(f"n{k}") for k, c in enumerate(COUNTED)]), some)
    proven = cut(_later(met.where("id != pivot").select("id", F.col("pivot").alias("other")), lines, edits))
    others = met.where("many > 1 AND id != pivot").select("key", "id", "indexed")  # the pivot has met all under its key
    side = lambda x: lines.select("id", *[F.col(c).alias(f"{x}_{c}") for c in ("first", *_COUNTS)])
    x = others.join(proven, "id", "left_anti").join(side("x"), "id").withColumnsRenamed({"id": "x", "indexed": "x_indexed"})
    y = others.join(side("y"), "id").withColumnsRenamed({"id": "y", "indexed": "y_indexed"})
    unlike = reduce(Column.__add__, [F.abs(x[f"x_{c}"] - y[f"y_{c}"]) for c in _COUNTS])  # an edit changes two counts by one at most
    meet = (x["key"] == y["key"]) & (x["x_indexed"] | y["y_indexed"]) & (y["y_first"] < x["x_first"]) & (unlike <= 2 * edits)
    pairs = cut(x.join(y, meet).select(F.col("x").alias("id"), F.col("y").alias("other")).distinct())
    return cut(_later(pairs, lines, edits).union(proven).distinct(), pairs, met, lines, proven)


def _later(pairs: DataFrame, lines: DataFrame, edits: int) -> DataFrame:
    """id of the later line of each pair (id, other) within the edits; the compiled distance lets few pairs through to the automaton, which decides."""
    ordered = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    side = lambda x: lines.select(F.col("id").alias(x), F.col("first").alias(f"{x}_first"), F.col("line").alias(f"{x}_line"))
    texts = ordered.join(side("a"), "a").join(side("b"), "b")
    near = texts.where((F.levenshtein(F.col("a_line"), F.col("b_line"), edits) >= 0) & within_edits(F.col("a_line"), F.col("b_line"), edits))
    return near.select(F.when(F.col("a_first") < F.col("b_first"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct()


def repeated_lines(docs: DataFrame, edits: int = 2) -> DataFrame:
    """doc_id, version and the places (from 0, ascending) of the lines to remove, for documents that have any.

    A line goes if an equal one, or one within `edits` edits (code points),
    stands earlier in the corpus: in a document of lesser doc_id (null first)
    or, in the same one, higher up. Lines of under LEAST_CHARS code points go for
    equal ones alone, blank lines never. version is a hash of the text: rows of
    equal doc_id and text share their result, rows of equal doc_id and other
    text are ordered by it. An empty table gives no rows; other columns are not
    read."""
    with scope() as outlive:
        lines = distinct_lines(docs)
        near = near_repeats(lines, edits).withColumn("gone", F.lit(True))
        decided = outlive(cut(lines.drop("line").join(near, "id", "left").where("times > 1 OR gone").select("h", "g", "first", F.coalesce("gone", F.lit(False)).alias("gone"))))
    all_lines = _occurrences(docs, with_line=False)
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("version") == F.col("first.version")) & (F.col("place") == F.col("first.place"))
    removed = all_lines.join(decided, ["h", "g"]).where(F.col("gone") | ~own).select("doc_id", "version", "place")
    return removed.distinct().groupBy("doc_id", "version").agg(F.sort_array(F.collect_list("place")).alias("removed"))


def _with_removed(docs: DataFrame, edits: int, *columns: str) -> DataFrame:
    removed = repeated_lines(docs, edits).withColumnsRenamed({"doc_id": "_doc", "version": "_version", "removed": "_removed"})
    own = docs.select(*columns, F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_own"), *(() if "text" in columns else (F.size(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("_lines"),)))
    return own.join(removed, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_own") == F.col("_version")), "left")


def removed_lines(docs: DataFrame, edits: int = 2) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (places from 0) of every row of docs, by the rule of repeated_lines.

    A null or empty text is one empty line, which stays. Repeated rows give a
    row each; an empty table gives no rows; other columns are not read."""
    none = F.array().cast("array<int>")
    out = _with_removed(docs, edits, "doc_id")
    return out.select("doc_id", F.col("_lines").cast("long").alias("n_lines"), F.size(F.coalesce("_removed", none)).cast("long").alias("n_removed"), F.coalesce("_removed", none).alias("removed"))


def without_repeated_lines(docs: DataFrame, edits: int = 2) -> DataFrame:
    """docs, each text without its repeated lines (the rule of repeated_lines); documents that lose every line go.

    All columns stay, n_chars follows the text if it is there. Null and empty texts
    stay as they are, repeated rows are treated alike, an empty table gives no rows."""
    out = _with_removed(docs, edits, *docs.columns)
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_removed", i))
    out = out.withColumn("_kept", F.when(F.col("_removed").isNotNull(), kept)).where("_removed IS NULL OR size(_kept) > 0")
    text = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_removed").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select(*docs.columns)
