"""Every operator on one table of odd rows: nulls, blanks, repeated rows and ids, long texts, columns whose names clash."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from blockflow.llm import bpe, common, fingerprints, language_model, lines, near, packing, passages, quality_model, quality_rules, token_count
from blockflow.llm.queries import fold

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG_WORD = "x" * 300_000
MANY_WORDS = " ".join(f"w{i % 977}q{i % 31}" for i in range(60_000))
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "a line that is long enough to matter\na line that is long enough to matter"), (5, MANY_WORDS), (5, MANY_WORDS), (6, MANY_WORDS + " end"), (7, LONG_WORD), (None, "no id at all"), (8, "é日🙂 " * 40), (9, "same id"), (9, "other text")]
CLASHES = ["1 AS h", "'x' AS row", "2 AS n", "'t' AS trigger", "3.5 AS score", "'k' AS key", "4 AS kept", "'f' AS fp", "7 AS bucket", "'g' AS grp", "9 AS id", "'i' AS ids", "0 AS place", "'v' AS version", "'l' AS line", "true AS held_out", "5 AS n_tokens", "6 AS n_removed", "'c' AS component_id"]
held = lambda d, m, k: d is not None and zlib.crc32(str(d).encode()) % m == k


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).selectExpr("*", "'en' AS lang", *CLASHES)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, 0, 0), (None, 1, 1), (6, None, 0), (7, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")


def same(got, want):
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


OPERATORS = {
    "op1": lambda d, lab: fingerprints.edited_fingerprints(d),
    "op2": quality_rules.apply_rules,
    "op3": lambda d, lab: quality_model.score_quality(d, lab, fold(4) == 2),
    "op4": lambda d, lab: token_count.token_counts(d, PIECES),
    "op5": lambda d, lab: lines.removed_lines(d),
    "op6": lambda d, lab: language_model.score_texts(d, fold(5) == 1),
    "op7": lambda d, lab: near.near_groups(d, 3, 90),
    "op8": lambda d, lab: bpe.digests(d, BYTES),
    "op9": lambda d, lab: packing.pack_documents(d, BYTES),
    "op10": lambda d, lab: passages.remove_repeats(d, covered=300),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, odd, labels, name):
    empty = spark.createDataFrame([], odd.schema)
    assert OPERATORS[name](empty, labels).collect() == []
    if name in ("op2", "op3"):
        assert OPERATORS[name](odd, labels.limit(0)).count() == len(ROWS)


def test_fingerprints(odd):
    got = fingerprints.edited_fingerprints(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in ROWS)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    for r in got:
        if r.doc_id in (1, 2, 3, 4, 7, 8):
            k = next(i for i, (d, _) in enumerate(order) if d == r.doc_id)
            t, following = order[k][1] or "", order[(k + 1) % len(order)][1] or ""
            n = len(t)
            assert r.n_chars == n and r.edited_sha256 == hashlib.sha256((t[: n - n // 2] + following[: n // 2]).encode()).hexdigest()
    assert len({r.fingerprint for r in got if r.doc_id == 5}) == 1


def test_quality_rules(odd, labels):
    for r in quality_rules.apply_rules(odd, labels).collect():
        n = {len(WORD.findall(t or "")) for d, t in ROWS if d == r.doc_id}
        assert r.n_words in n and (r.n_words >= 50 or (r.base_failed and not r.kept))
    by = {r.doc_id: r for r in quality_rules.apply_rules(odd.selectExpr("doc_id", "text", "CAST(null AS string) AS lang"), labels).collect()}
    assert by[7].word_chars == len(LONG_WORD) and by[5].n_repeat_words > 0 and by[4].n_dup_lines == 1


def test_quality_model(odd, labels):
    got = quality_model.score_quality(odd, labels, fold(4) == 2).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in ROWS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == held(r.doc_id, 4, 2) for r in got)
    assert len({r.score for r in got if r.doc_id == 5}) == 1
    kept = quality_model.keep_good(odd, labels, fold(4) == 2, threshold=0.0)
    assert kept.columns == odd.columns and kept.count() == len(ROWS)


def test_lines(odd):
    got = {(r.doc_id, r.n_lines): tuple(r.removed) for r in lines.removed_lines(odd).collect()}
    assert got[4, 2] == (1,) and got[1, 1] == () and got[2, 1] == () and got[3, 2] == () and got[7, 1] == ()
    assert len(lines.removed_lines(odd).collect()) == len(ROWS)
    kept = lines.without_repeated_lines(odd)
    assert kept.columns == odd.columns and Counter(r.doc_id for r in kept.collect()) == Counter(d for d, _ in ROWS)


def test_large_family_of_lines(spark):
    base = "the quick brown fox jumps over the lazy dog and then it goes home to sleep for long"
    made = ["".join(c if (i * 7 + k * 13) % 97 else "#" for k, c in enumerate(base)) for i in range(400)]
    out = {r.doc_id: r.n_removed for r in lines.removed_lines(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()}

    def near_one(i):
        return any(sum(a != b for a, b in zip(made[i], made[j], strict=True)) <= 2 for j in range(i))

    assert {i for i, n in out.items() if n} >= {i for i in range(400) if near_one(i)}


def test_language_model(odd):
    got = language_model.score_texts(odd, fold(5) == 1).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in ROWS)
    words = Counter(w for d, t in ROWS if not held(d, 5, 1) for w in [*re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())), None])
    total, kinds = sum(words.values()), len(words)
    for r in got:
        texts = [t for d, t in ROWS if d == r.doc_id]
        wants = [sum(math.log10((words[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()), None]) for t in texts]
        assert any(r.base_score == pytest.approx(w) for w in wants) and r.train_tokens == total and r.score < 0 and r.held_out == held(r.doc_id, 5, 1)


def test_ngram_join(odd):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near.near_groups(odd, 3, 90).collect()}
    grams = len({tuple(w[i : i + 3]) for w in [MANY_WORDS.split()] for i in range(len(w) - 2)})
    assert got[1, 0] == 1 and got[2, 0] == 2 and got[3, 0] == 3 and got[7, 1] == 7
    assert got[5, grams] == 5 and got[6, grams + 1] == 5 and got[None, 2] is None


def test_bpe(odd):
    tk = Tokenizer.from_file(BYTES)
    want = []
    for d, t in ROWS:
        ids = tk.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    same(bpe.digests(odd, BYTES).collect(), want)


def test_packing(odd):
    tk = Tokenizer.from_file(BYTES)
    got = packing.pack_documents(odd, BYTES).collect()
    whole = Counter()
    for d, t in ROWS:
        whole[d, len(tk.encode(t or "", add_special_tokens=False).ids) + 1] += 1
    pieces = Counter()
    places = defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert pieces == Counter({k: k[1] * n for k, n in whole.items()})
    for own in places.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048


def test_passages(odd):
    got = {(r.doc_id, r.n_bytes): r for r in passages.remove_repeats(odd, covered=300).collect()}
    n = len(MANY_WORDS)
    empty = hashlib.sha256(b"").hexdigest()
    assert got[5, n].n_removed == n and got[5, n].kept_sha256 == empty and got[6, n + 4].n_removed >= n and got[6, n + 4].n_covered >= n
    assert got[7, len(LONG_WORD)].n_removed == len(LONG_WORD) and got[1, 0].n_removed == 0 and got[2, 0].kept_sha256 == empty
    assert got[None, len("no id at all")].n_removed == 0


def test_cuts_go_with_their_last_reader(spark, tmp_path):
    from pathlib import Path

    def alive():
        return {p.name for p in Path(common.shared_dir(spark).removeprefix("file://")).glob("cut-*")}

    before = alive()
    a = common.cut(spark.range(3))
    b = common.cut(a.selectExpr("id + 1 AS id"), a)
    assert len(alive() - before) == 1 and b.count() == 3
    with common.scope() as outlive:
        c = outlive(common.cut(b.selectExpr("id * 2 AS id")))
        common.cut(b)
        with common.scope():
            common.cut(b)
        assert len(alive() - before) == 3
    assert len(alive() - before) == 2 and sorted(r.id for r in c.collect()) == [2, 4, 6]
    common.drop(b, c, spark.range(1))
    assert alive() == before


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    from types import SimpleNamespace

    from blockflow.runtime.durable import shared_dir

    def session(master, **conf):
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: conf))

    assert shared_dir(session("local[4]")).startswith("file:///tmp") and shared_dir(session("spark://x:7077", **{"spark.checkpoint.dir": "hdfs://y/z/"})) == "hdfs://y/z"
    for master in ("spark://x:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(session(master))
