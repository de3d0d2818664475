import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from blockflow.llm import components, fingerprints, language_model, lines, near, passages, quality_model, quality_rules
from blockflow.llm.queries import fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def vocabulary(rng, n=300, letters="abcdeéABC"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n)]


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


# -- repeated passages


def repeats(rows, length):
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "hot"), [(400, 20_000), (40, 2), (9, 1)])
def test_repeats_match_brute_force(spark, monkeypatch, length, hot):
    monkeypatch.setattr(passages, "HOT_TEXTS", hot)
    rng = random.Random(length)
    words = vocabulary(rng, 60)
    shared = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 120))) for _ in range(5)]
    part = [lambda: rng.choice(shared), lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 90))), lambda: "ab " * rng.randint(1, 300)]
    rows = [(i, " ".join(rng.choice(part)() for _ in range(rng.randint(0, 4)))) for i in range(70)]
    rows += [(7, None), (8, rows[3][1]), (3, rows[3][1]), (None, "x" * 900), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS n_removed", "'x' AS h")
    same(passages.remove_repeats(df, length).collect(), repeats(rows, length))
    if length == 40:
        kept = passages.without_repeats(df, length)
        assert kept.columns == df.columns
        want = [(d, n, gone, sha) for (d, _), (_, n, gone, _, sha) in zip(rows, repeats(rows, length), strict=True) if not n or gone < n]
        got = kept.collect()
        assert Counter(r.doc_id for r in got) == Counter(w[0] for w in want)
        shas = defaultdict(set)
        for w in want:
            shas[w[0]].add(w[3])
        assert all(hashlib.sha256((r.text or "").encode()).hexdigest() in shas[r.doc_id] for r in got if "�" not in (r.text or ""))
        covered = {(r.doc_id, r.n_bytes, r.n_removed): r.n_covered for r in passages.remove_repeats(df, length, covered=length // 2).collect()}
        assert {(d, n, gone): c for (d, n, gone, _, _), (_, _, c, _, _) in zip(repeats(rows, length), repeats(rows, length // 2), strict=True)} == covered
    assert passages.remove_repeats(df.limit(0), length).count() == 0


# -- near duplicates


def groups(rows, words, percent):
    def grams(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset([tuple(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [tuple(w)] if w else [])

    sets = [(d, grams(t)) for d, t in rows]
    head = {d: d for d, _ in sets if d is not None}

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if a and b and d is not None and e is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(d), root(e)
                head[max(x, y)] = min(x, y)
    return [(d, len(g), root(d) if d is not None else None) for d, g in sets]


@pytest.mark.parametrize(("seed", "words", "percent", "wide"), [(1, 3, 90, 256), (2, 5, 80, 4)])
def test_groups_match_brute_force(spark, monkeypatch, seed, words, percent, wide):
    monkeypatch.setattr(near, "WIDE", wide)
    rng = random.Random(seed)
    pool = vocabulary(rng)
    rows, base = [], []
    for i in range(110):
        if rng.random() < 0.4 or not base:
            w = [rng.choice(pool) for _ in range(rng.randint(0, 200))]
            base.append(w)
        else:
            w = list(base[0] if rng.random() < 0.5 else rng.choice(base))
            for _ in range(rng.randint(0, 6)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(pool)
        rows.append((i * 3, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(1000, None), (1001, "  "), (1002, "one"), (1003, "ONE"), (1004, "one two"), (9, rows[3][1]), (None, rows[4][1]), (1005, rows[6][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 AS n", "2 AS component", "3 AS a")
    want = groups(rows, words, percent)
    same(near.near_groups(df, words, percent).collect(), want)
    if seed == 2:
        kept = near.one_of_each_group(df, words, percent)
        assert kept.columns == df.columns
        same([(r.doc_id,) for r in kept.collect()], [(d,) for d in {d for d, _, c in want if d is not None and d == c}] + [(None,)])
        assert near.near_groups(df.limit(0), words, percent).count() == 0


def test_unlike_texts_of_one_id_all_stay(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, b + " more"), (3, c), (3, c + " more"), (3, c), (4, None), (4, "x y"), (None, a)]
    for parts in (1, 5):
        kept = [tuple(r) for r in near.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()]
        assert sum(d == 3 for d, _ in kept) == 1 and {t for d, t in kept if d == 3} <= {c, c + " more"}
        same([r for r in kept if r[0] != 3], [(1, a), (1, b), (4, None), (4, "x y"), (None, a)])


@pytest.mark.parametrize("groups", [1, 200])
def test_comparing_groups_takes_little_beside_their_counts(groups):
    rng = np.random.default_rng(3)
    n, base = 20_000, rng.poisson(3, 512).astype(np.uint8)
    vectors = [np.bincount(rng.integers(0, 512, 4), minlength=512).astype(np.uint8) + base for _ in range(n)]
    rows = pa.table({"gram": np.arange(n) * groups // n, "rep": np.arange(n), "n": np.full(n, 1540), "vector": pa.array([v.tobytes() for v in vectors], pa.binary())})
    tracemalloc.start()
    out = [b for b in near._partners(80, False)(iter(rows.to_batches(max_chunksize=1000)))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * n * 512
    got = pa.Table.from_batches(out)
    assert got.num_rows == n and max(b.num_rows for b in out) <= 1000
    for i in (0, n // 2, n - 1):
        j = got.column("nearest")[i].as_py()
        assert got.column("distance")[i].as_py() == np.abs(vectors[i].astype(int) - vectors[j]).sum()


def test_counts_of_unlike_width_are_compared_alike_in_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    n = 300
    vectors = [rng.integers(0, 200, 1 << rng.integers(4, 10)).astype(np.uint8) for _ in range(n)]
    rows = pa.table({"gram": np.zeros(n, dtype=np.int64), "rep": np.arange(n), "n": rng.integers(5_000, 5_500, n), "vector": pa.array([v.tobytes() for v in vectors], pa.binary())})

    def fold(v, width):  # by halves of the levels that the group holds, each held to a byte
        while len(v) > width:
            v = np.minimum(v.astype(int).reshape(-1, len(v) // 2).sum(axis=0), 255)
        return v.astype(int)

    i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(n)))
    want = []
    for a, b in zip(i, j, strict=True):
        width = min(len(vectors[a]), len(vectors[b]))
        d = np.abs(fold(vectors[a], width) - fold(vectors[b], width)).sum()
        na, nb = rows.column("n")[int(a)].as_py(), rows.column("n")[int(b)].as_py()
        want.append(d if d <= 60 * (na + nb) // 140 else -1)
    for piece in (1, 5_000, near.PIECE):
        monkeypatch.setattr(near, "PIECE", piece)
        assert (near._Group(rows, 40).apart(i, j) == want).all()


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(7, 7)]
    head = {}

    def root(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for a, b in links:
        x, y = root(a), root(b)
        head[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: root(n) for n in head if n in got} and {n for n in head if root(n) != n} <= set(got)


@pytest.mark.parametrize("in_one_task", [1 << 20, 0])
def test_components_in_one_task_and_by_rounds(spark, monkeypatch, in_one_task):
    monkeypatch.setattr(components, "IN_ONE_TASK", in_one_task)
    cuts = []
    monkeypatch.setattr(components, "cut", lambda df, *spent, cut=components.cut: cuts.append(1) or cut(df, *spent))
    order = random.Random(5).sample(range(64), 64)
    links = [*zip(order, order[1:]), *((1000 + i, 999) for i in range(50)), *((2000 + i, 2100 + i % 7) for i in range(40)), (999, 1001), (-5, 5000), (3, 3), (6000, 6000), (None, 1)]
    got = components.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()
    want = {n: 0 for n in order} | {n: 999 for n in range(999, 1050)} | {n: 2000 + (n - 2100 if n >= 2100 else n - 2000) % 7 for n in [*range(2000, 2040), *range(2100, 2107)]} | {-5: -5, 5000: -5}
    same(got, want.items())
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert len(cuts) == 4 if in_one_task else len(cuts) > 4  # links and result of each graph: a small one takes no rounds


# -- lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_key_code_is_small_enough_for_the_jvm_to_compile(spark):
    docs = spark.createDataFrame([(1, "a line of more than twenty characters\nand another one, é, of more than those")], "doc_id long, text string")
    found = lines.distinct_lines(docs)
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    for keyed, keys in zip(lines._keyed(found, 2), (3, 9), strict=True):
        sizes = re.findall(r"maxMethodCodeSize:(\d+)", keyed._jdf.queryExecution().explainString(mode))
        assert sizes and max(map(int, sizes)) < 8000
        assert {r.n for r in keyed.groupBy("id").agg(F.count("*").alias("n")).collect()} == {keys}


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_lines_match_brute_force(spark, edits):
    rng = random.Random(edits)
    base = ["".join(rng.choice("ab é") for _ in range(rng.randint(15, 40))) for _ in range(10)]

    def line():
        s = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            j, how = rng.randrange(len(s)), rng.randrange(3)
            s[j : j + (how != 2)] = [] if how == 0 else [rng.choice("abc")]
        return "".join(s)

    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 4)))) for i in range(30)] + [(100, None), (101, ""), (102, "x" * 30 + "\n" + "x" * 30), (None, "x" * 30), (103, "short\n \nshort\n \nshorn"), (104, "short")]
    seen, gone = [], defaultdict(list)
    for d, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        for i, s in enumerate((t or "").split("\n")):
            if WORD.search(s):
                if any(s == o or (min(len(s), len(o)) >= lines.LEAST_CHARS and abs(len(s) - len(o)) <= edits and distance(s, o) <= edits) for o in seen):
                    gone[d].append(i)
                seen.append(s)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "9 AS place", "length(text) + 0L AS n_chars")
    same([(r[0], r[1], r[2], tuple(r[3])) for r in lines.removed_lines(df, edits).collect()], [(d, len((t or "").split("\n")), len(gone[d]), tuple(gone[d])) for d, t in rows])
    if edits == 2:
        want = [(d, t if not gone[d] else "\n".join(s for i, s in enumerate((t or "").split("\n")) if i not in gone[d])) for d, t in rows if not gone[d] or len(gone[d]) < len((t or "").split("\n"))]
        out = lines.without_repeated_lines(df, edits)
        assert out.columns == df.columns
        same([(r.doc_id, r.text) for r in out.collect()], want)
        assert lines.removed_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("edits", [0, 2, 3, 5])
def test_near_lines_share_a_window_and_few_others_are_keyed(spark, monkeypatch, edits):
    rng = random.Random(edits)
    base = ["".join(rng.choice("abcdefgh éß語") for _ in range(n)) for n in range(20, 70)]

    def edited(s):
        s = list(s)
        for _ in range(edits):
            j, how = rng.choice([0, len(s), rng.randrange(len(s))]), rng.randrange(3)
            s[j : j + (how != 2)] = [] if how == 0 else [rng.choice("xyz")]
        return "".join(s)

    pairs = [(s, e) for s in base for e in {edited(s) for _ in range(6)} if len(e) >= lines.LEAST_CHARS]
    texts = {s: i for i, s in enumerate({s for p in pairs for s in p})}
    keys = defaultdict(set)
    for r in lines._windowed(spark.createDataFrame([(i, s) for s, i in texts.items()], "id long, line string"), edits).collect():
        keys[r.id].add(r.key)
    near = [(a, b) for a, b in pairs if distance(a, b) <= edits]
    assert len(near) == len(pairs) and all(keys[texts[a]] & keys[texts[b]] for a, b in near)

    made, keyed = lines._keyed, []
    monkeypatch.setattr(lines, "_keyed", lambda found, edits: keyed.extend(r.line for r in found.collect()) or made(found, edits))
    unlike = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60)) for _ in range(300)]
    twin = "z" + unlike[7][1:] if edits else unlike[7]
    out = lines.removed_lines(spark.createDataFrame([(1, "\n".join(unlike)), (2, twin)], "doc_id long, text string"), edits)
    assert {r.doc_id: r.n_removed for r in out.collect()} == {1: 0, 2: 1}
    assert set(keyed) == ({unlike[7], twin} if edits else set())


def test_window_code_is_small_enough_for_the_jvm_to_compile(spark):
    rows = spark.createDataFrame([(1, "a line of more than twenty characters")], "id long, line string")
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    windowed = lines._windowed(rows, 2)
    sizes = re.findall(r"maxMethodCodeSize:(\d+)", windowed._jdf.queryExecution().explainString(mode))
    assert sizes and max(map(int, sizes)) < 8000 and windowed.count() <= 8


# -- language model


def test_scores_match_brute_force(spark):
    rng, order = random.Random(3), 3
    pool = vocabulary(rng, 80)
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(100, None), (101, ""), (102, "zz\x01qq 日本")]
    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    tokens = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), None]
    padded = lambda t: b"\xfe" * order + (t or "").encode() + b"\xff"
    words, trie = Counter(), [defaultdict(Counter) for _ in range(order + 1)]
    for d, t in rows:
        if not held(d):
            words.update(tokens(t))
            b = padded(t)
            for i in range(order, len(b)):
                for j in range(order + 1):
                    trie[j][b[i - j : i]][b[i]] += 1
    total, kinds = sum(words.values()), len(words)

    def p(context, symbol):
        gone, out = set(), 1.0
        for j in range(order, -1, -1):
            live = {s: n for s, n in trie[j].get(context[len(context) - j :], {}).items() if s not in gone}
            if live:
                if symbol in live:
                    return out * live[symbol] / (sum(live.values()) + len(live))
                out *= len(live) / (sum(live.values()) + len(live))
                gone |= set(live)
        return out / (256 - len(gone))

    got = {r.doc_id: r for r in language_model.score_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), fold(5) == 1, order=order, common_words=20).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        r, own, b = got[d], tokens(t), padded(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), len(own), sum(words[w] > 0 for w in own), total)
        assert r.base_score == pytest.approx(sum(math.log10((words[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own))
        assert r.score == pytest.approx(sum(math.log10(p(b[i - order : i], b[i])) for i in range(order, len(b))))
    one = [language_model.Trie([]), None]
    assert one[0].code == []


def test_scores_do_not_depend_on_what_is_broadcast(spark):
    rng = random.Random(9)
    pool = vocabulary(rng, 200)
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 80)))) for i in range(40)] + [(50, None), (51, "ñ 日本 never met")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole, few, none = ({r.doc_id: r.score for r in language_model.score_texts(df, fold(5) == 1, nodes=n).collect()} for n in (10**6, 40, 0))
    assert len(whole) == len(rows) and few == pytest.approx(whole) and none == pytest.approx(whole)
    for order in (0, 1, 2):
        a, b = ({r.doc_id: r.score for r in language_model.score_texts(df, fold(5) == 1, order=order, nodes=n).collect()} for n in (10**6, 3))
        assert a == pytest.approx(b)
    held = language_model.score_texts(df, fold(1) == 0)
    assert {r.doc_id: r.score for r in held.collect()} == pytest.approx({d: -math.log10(256) * (len((t or "").encode()) + 1) for d, t in rows})
    assert language_model.score_texts(df.limit(0), fold(5) == 1).count() == 0


# -- quality


def test_rule_counts_match_brute_force(spark):
    rng = random.Random(8)
    texts = [None, "", "a a a a", "x\ny\nx\n \nx", "#$ <b> A!", "  a b c a b c d  "] + [" ".join(rng.choice("abcd") + rng.choice(["", "\n", "#"]) for _ in range(rng.randint(1, 160))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'en' AS lang", "1 AS kept")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (3, None)], "doc_id long, quality int")
    for r in quality_rules.apply_rules(df, labels).collect():
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        times, inside = Counter(zip(w, w[1:], w[2:], strict=False)), set()
        for i in range(len(w) - 2):
            if times[w[i], w[i + 1], w[i + 2]] > 1:
                inside |= {i, i + 1, i + 2}
        own = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(own) - len(set(own)), len(inside))
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and r.kept == (not r.base_failed)


def test_binomial_bound_and_cutoffs(spark):
    from pyspark.sql import functions as F

    for n, k, p in ((10, 0, 0.3), (200, 3, 0.05), (5000, 210, 0.05), (100_000, 900, 0.01)):
        got = spark.range(1).select(quality_rules.binomial_cdf(F.lit(k), F.lit(n), p)).first()[0]
        log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(k + 1)]
        assert got == pytest.approx(sum(map(math.exp, log)), rel=1e-6)
    rows = [("en", 1, 3 if i % 400 == 0 else 0) for i in range(4000)] + [("en", 0, 40 + i % 20) for i in range(300)] + [("fr", 1, 0)] * 20 + [("fr", 0, 50)] * 20
    df = spark.createDataFrame(rows, "stratum string, quality int, symbols int")
    for r in quality_rules.RULES:
        df = df if r == "symbols" else df.withColumn(r, F.lit(0))
    got = {r.stratum: r for r in quality_rules.cutoffs(df, 0.05, 0.05, 3.0).collect()}
    assert got["en"].symbols == 40 and got["en"].upper == quality_rules.STEPS + 1 and "fr" not in got


def test_every_stratum_gets_its_cutoffs(spark):
    n = 1200
    docs = spark.range(n * 13).selectExpr("id AS doc_id", f"concat('l', id % {n}) AS lang", f"id < {n} AS bad").selectExpr("doc_id", "lang", "bad", "concat(concat_ws(' ', transform(sequence(1, 60), i -> concat('w', i))), if(bad, repeat('#', 200), '')) AS text")
    labels = docs.selectExpr("doc_id", "if(bad, 0, 1) AS quality")
    kept = {r.doc_id: r.kept for r in quality_rules.apply_rules(docs, labels, alpha=4.5).collect()}
    assert kept == {i: i >= n for i in range(n * 13)}


def plain_fit(x, y, m):
    """Cyclic boosting by plain loops: the score of each row after all rounds."""
    n, k = len(x), len(x[0])
    quantile = lambda values, q: (lambda s, at: s[int(at)] + (at - int(at)) * ((s[int(at) + 1] if int(at) + 1 < len(s) else s[int(at)]) - s[int(at)]))(sorted(values), q * (len(values) - 1))
    cuts = lambda f, bins: sorted({quantile([r[f] for r in x], i / bins) for i in range(1, bins)})
    place = lambda c, v: sum(v >= e for e in c)
    score = [math.log((sum(y) + 1) / (n - sum(y) + 1))] * n
    chance = lambda s: 1 / (1 + math.exp(-s))

    def sums(rows):
        return sum(y[i] - chance(score[i]) for i in rows), sum(chance(score[i]) * (1 - chance(score[i])) for i in rows)

    def worth(rows):
        g, h = sums(rows)
        return g * g / (h + 1)

    for _ in range(m.rounds):
        for f in range(k):
            c = cuts(f, m.bins)
            parts = [list(range(n))]
            spans = [(0, len(c) + 1)]
            for _ in range(2):
                best = None
                for j, (rows, (a, b)) in enumerate(zip(parts, spans, strict=True)):
                    for e in range(a + 1, b):
                        left, right = [i for i in rows if place(c, x[i][f]) < e], [i for i in rows if place(c, x[i][f]) >= e]
                        if min(len(left), len(right)) >= m.least:
                            gain = worth(left) + worth(right) - worth(rows)
                            if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                                best = gain, j, e, left, right
                if best is None:
                    break
                _, j, e, left, right = best
                parts[j : j + 1], spans[j : j + 1] = [left, right], [(spans[j][0], e), (e, spans[j][1])]
            if len(parts) > 1:
                steps = [m.rate * sums(rows)[0] / (sums(rows)[1] + 1) for rows in parts]
                for rows, step in zip(parts, steps, strict=True):
                    for i in rows:
                        score[i] += step

    def quadrants(i, j):
        ci, cj = cuts(i, m.coarse), cuts(j, m.coarse)
        best = None
        for a in range(1, len(ci) + 1):
            for b in range(1, len(cj) + 1):
                four = [[r for r in range(n) if (place(ci, x[r][i]) >= a) == p and (place(cj, x[r][j]) >= b) == q] for p in (False, True) for q in (False, True)]
                if min(map(len, four)) >= m.least:
                    gain = sum(map(worth, four))
                    if best is None or gain > best[0] + 1e-12:
                        best = gain, four
        return best

    gains = sorted(((best[0], i, j) for i in range(k) for j in range(i) if (best := quadrants(i, j))), reverse=True)
    for _ in range(m.rounds // 4):
        for _, i, j in gains[: m.pairs]:
            best = quadrants(i, j)
            steps = [m.rate * sums(rows)[0] / (sums(rows)[1] + 1) for rows in best[1]]
            for rows, step in zip(best[1], steps, strict=True):
                for r in rows:
                    score[r] += step
    return [chance(s) for s in score]


def test_quality_model_matches_plain_boosting():
    import numpy as np

    rng = random.Random(12)
    x = [[rng.random(), rng.randrange(6) / 3, rng.gauss(0, 1)] for _ in range(70)]
    y = [int(r[0] + (r[1] > 1) * (r[2] > 0) + rng.gauss(0, 0.3) > 0.9) for r in x]
    m = quality_model.AdditiveModel(bins=9, rounds=8, rate=0.3, pairs=2, coarse=4, least=5)
    assert m.fit(np.array(x), np.array(y, dtype=float)).score(np.array(x)).tolist() == pytest.approx(plain_fit(x, y, m))


def test_quality_model_separates_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality_model.score_quality(docs, labels, fold(4) == 2).collect()
    assert len(got) == docs.count()
    scored = [(r.score, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    good, bad = ([s for s, q in scored if q == v] for v in (1, 0))
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) > 0.97 * len(good) * len(bad)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    kept = quality_model.keep_good(docs.selectExpr("*", "1 AS score"), labels, fold(4) == 2)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted} and kept.columns == [*docs.columns, "score"]
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "a\nb " * 50_000)], "doc_id long, text string")
    assert quality_model.score_quality(odd, labels.limit(0), fold(4) == 2).count() == 3
    assert quality_model.score_quality(odd.limit(0), labels, fold(4) == 2).count() == 0


# -- fingerprints


def test_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 7)
    rng = random.Random(6)
    pool = vocabulary(rng)
    rows = [(rng.randrange(-(10**12), 10**12), " ".join(rng.choice(pool) for _ in range(rng.randint(0, 120)))) for _ in range(80)]
    rows += [(5, ""), (6, "one"), (7, "one"), (8, rows[0][1]), (9, "é" * 7), (None, None), (5, "twice")]
    got = {(r.doc_id, r.n_chars): r for r in fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS bucket", "2 AS fp")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)

    def grams(t):
        w = WORD.findall(t.lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    errors = []
    for k, (d, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        e = t[: n - n // 2] + nxt[: n // 2]
        r = got[d, n]
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        a, b = grams(t), grams(e)
        if a and b:
            errors.append(abs(r.near_edited - len(a & b) / len(a | b)))
        assert 0 <= r.near_next <= 1
    assert sum(errors) / len(errors) < 0.05 and max(errors) < 0.3
    prints = defaultdict(set)
    for d, t in rows:
        prints[t].add(got[d, len(t or "")].fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    empty = fingerprints.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0
    alone = fingerprints.edited_fingerprints(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0 and alone.n_chars == 15
