import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import tokenizers
from blockflow.llm import lines, quality_model
from blockflow.llm.common import table
from blockflow.llm.queries import fold

DATA = "/root/testdata/sf0.001"
SPACE = "[^\\x20\\x09-\\x0D]+"


def near(a, b, edits=2):
    """Whether two lines are within the edits, by a plain band."""
    if abs(len(a) - len(b)) > edits:
        return False
    row = {j: j for j in range(edits + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - edits), min(len(b), i + edits) + 1):
            ways = [row[j] + 1] if j in row else []
            ways += [new[j - 1] + 1] if j - 1 in new else []
            ways += [row[j - 1] + (x != b[j - 1])] if j and j - 1 in row else []
            new[j] = min(ways)
        row = new
        if min(row.values()) > edits:
            return False
    return row.get(len(b), edits + 1) <= edits


def without_lines(rows):
    out, equal, by_length = [], set(), defaultdict(list)
    for d, t in sorted(rows, key=lambda r: r[0]):
        kept = []
        for s in (t or "").split("\n"):
            if not re.search(SPACE, s):
                kept.append(s)
                continue
            gone = s in equal or (len(s) >= lines.LEAST_CHARS and any(near(s, o) for n in range(len(s) - 2, len(s) + 3) for o in by_length[n] if n >= lines.LEAST_CHARS))
            if s not in equal:
                equal.add(s)
                by_length[len(s)].append(s)
            if not gone:
                kept.append(s)
        if kept:
            out.append((d, t if len(kept) == len((t or "").split("\n")) else "\n".join(kept)))
    return out


def without_copies(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(SPACE, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    head = {d: d for d in sets}

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                head[max(x, y)] = min(x, y)
    return [(d, t) for d, t in rows if root(d) == d]


def without_passages(rows, length):
    seen = Counter(b[i : i + length] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        if not any(gone):
            out.append((d, t))
        elif not all(gone):
            out.append((d, bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "replace")))
    return out


def test_run_matches_plain_stages(spark):
    docs = table(spark, DATA, "documents")
    good = {r.doc_id for r in quality_model.score_quality(docs, table(spark, DATA, "labels"), fold(4) == 2).collect() if r.predicted}
    want = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    for stage in (without_lines, without_copies, lambda rows: without_passages(rows, corpus_pipeline.PASSAGE_BYTES)):
        before, want = len(want), stage(want)
        assert 0.5 * before < len(want) <= before
    pieces = defaultdict(list)
    places = defaultdict(list)
    for r in corpus_pipeline.run(spark, DATA).collect():
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == {d for d, _ in want}
    tokenizer = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    for d, t in want:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_keep_the_columns(spark):
    docs = table(spark, DATA, "documents").withColumnsRenamed({"lang": "h", "source": "trigger"})
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = spark.createDataFrame(stage(spark, docs, DATA).collect(), docs.schema)
        assert docs.columns == columns and docs.count(), i


def test_stages_take_odd_rows(spark):
    text = "one line of words that is long enough to be looked at " * 30
    rows = [(1, None, "a", 1, 0.5), (2, "", "a", None, None), (None, text, None, 2, 0.1), (3, text, "b", 2, 0.1), (3, text, "b", 2, 0.1), (4, " ".join(f"w{i}" for i in range(40_000)), "c", 3, 0.3), (5, " \n\t\n", "", 0, 0.0)]
    schema = "doc_id long, text string, lang string, n_chars long, score double"
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, spark.createDataFrame(rows, schema), DATA).collect()
        assert name in ("quality", "pack") or {r.doc_id for r in out} >= {1, 2, 4, 5}, name
        assert name != "pack" or sum(r.start == 0 for r in out) == len(rows)
        assert stage(spark, spark.createDataFrame([], schema), DATA).count() == 0, name


def test_no_cut_outlives_the_run(spark, tmp_path):
    from pathlib import Path

    from blockflow.llm import common

    folder = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(folder.glob("cut-*")) if folder.exists() else set()
    out = corpus_pipeline.run(spark, DATA)
    left = set(folder.glob("cut-*")) - before
    assert len(left) <= 2 and out.count()  # what the last stage reads, and what it made of it
