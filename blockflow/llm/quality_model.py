"""Quality scores by a generalised additive model with pairwise interactions.

Cyclic boosting gives every feature in turn a shallow tree on the residuals,
each round a small step; the trees of a feature add up to a look-up table over
its bins. The pairs of features that explain most of what is left get tables of
two dimensions in the same way. A score is a sum of table entries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map
from .near import SEPARATOR, _buffers, shingles

FEATURES = ("words", "word_bytes", "symbols", "upper", "digits", "stops", "marks", "other_bytes", "distinct", "repeats", "dup_lines", "line_words", "same_as_last", "bare", "short")
#: Labelled rows used at most: those whose ids hash least.
SAMPLE = 20_000

_CLASS = {"symbols": b"#*$%&|<>", "upper": bytes(range(65, 91)), "digits": bytes(range(48, 58)), "stops": b".,;:", "marks": b"!?", "other_bytes": bytes(range(128, 256))}
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text; zeros where there is nothing to count."""
    out = np.zeros((len(texts), len(FEATURES)))
    for at, part in _buffers(texts):
        data = np.frombuffer(b"\n".join([*part, b""]), dtype=np.uint8)
        sizes = np.array([len(t) for t in part], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        block = out[at : at + len(part)]
        per_text = lambda flags: np.add.reduceat(flags.astype(np.int64), begin)
        for name, chars in _CLASS.items():
            table = np.zeros(256, dtype=bool)
            table[list(chars)] = True
            block[:, FEATURES.index(name)] = per_text(table[data]) / np.maximum(sizes, 1)
        gap = SEPARATOR[data]
        first = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        last = np.flatnonzero(~gap & np.concatenate([gap[1:], [True]])) + 1
        letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
        bare = (letters[last] - letters[first]) == 0
        word, edge = shingles(part, 1)
        gram, gram_edge = shingles(part, 3)
        length = last - first
        for i in range(len(part)):
            a, b = edge[i], edge[i + 1]
            if a == b:
                continue
            w, n = word[a:b], b - a
            lines = [x for x in part[i].split(b"\n") if x.strip(b" \t\x0b\x0c\r")]
            g = gram[gram_edge[i] : gram_edge[i + 1]]
            block[i, 0] = np.log2(1 + n)
            block[i, 1] = length[a:b].mean()
            block[i, 8:] = (len(np.unique(w)) / n, 1 - len(np.unique(g)) / len(g), 1 - len(set(lines)) / len(lines), np.log2(1 + n / len(lines)), (w[1:] == w[:-1]).mean() if n > 1 else 0, bare[a:b].mean(), (length[a:b] <= 3).mean())
    return out


class AdditiveModel:
    """Fits and scores; all state is small arrays."""

    def __init__(self, bins: int = 64, rounds: int = 400, rate: float = 0.08, pairs: int = 8, coarse: int = 12, least: int = 10):
        self.bins, self.rounds, self.rate, self.pairs, self.coarse, self.least = bins, rounds, rate, pairs, coarse, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        n, k = x.shape if x.size else (0, len(FEATURES))
        good = float(y.sum()) if n else 0.0
        self.base = np.log((good + 1) / (n - good + 1))
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for f in range(k)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pair_tables: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        if not n or good in (0, n):
            return self
        at = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)]
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            for f in range(k):
                p = 1 / (1 + np.exp(-score))
                step = self._tree(np.bincount(at[f], y - p, len(self.tables[f])), np.bincount(at[f], p * (1 - p), len(self.tables[f])), np.bincount(at[f], minlength=len(self.tables[f])))
                if step is not None:
                    self.tables[f] += step
                    score += step[at[f]]
        coarse = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.coarse + 1)[1:-1])) for f in range(k)]
        small = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(coarse)]
        p = 1 / (1 + np.exp(-score))
        gains = []
        for i in range(k):
            for j in range(i):
                cell, shape = small[i] * (len(coarse[j]) + 1) + small[j], (len(coarse[i]) + 1, len(coarse[j]) + 1)
                best = self._quadrants(np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape), np.bincount(cell, minlength=shape[0] * shape[1]).reshape(shape))
                if best:
                    gains.append((best[0], i, j))
        chosen = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in sorted(gains, reverse=True)[: self.pairs]]
        for _ in range(self.rounds // 4):
            for i, j, _, cj, t in chosen:
                p = 1 / (1 + np.exp(-score))
                cell = small[i] * (len(cj) + 1) + small[j]
                best = self._quadrants(*(np.bincount(cell, v, t.size).reshape(t.shape) for v in (y - p, p * (1 - p), np.ones(n))))
                if best:
                    t += best[1]
                    score += best[1].ravel()[cell]
        self.pair_tables = chosen
        return self

    def _tree(self, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray | None:
        """Up to two cuts of a feature's bins; None if no cut leaves enough rows on both sides."""
        cuts: list[int] = []
        for _ in range(2):
            best = None
            edges = [0, *sorted(cuts), len(g)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a < 2:
                    continue
                G, H, N = np.cumsum(g[a:b]), np.cumsum(h[a:b]), np.cumsum(n[a:b])
                ok = (N[:-1] >= self.least) & (N[-1] - N[:-1] >= self.least)
                if ok.any():
                    gain = np.where(ok, G[:-1] ** 2 / (H[:-1] + 1) + (G[-1] - G[:-1]) ** 2 / (H[-1] - H[:-1] + 1) - G[-1] ** 2 / (H[-1] + 1), -1)
                    i = int(gain.argmax())
                    if gain[i] > 1e-9 and (best is None or gain[i] > best[0]):
                        best = (gain[i], a + i + 1)
            if best is None:
                break
            cuts.append(best[1])
        if not cuts:
            return None
        step = np.zeros(len(g))
        edges = [0, *sorted(cuts), len(g)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            step[a:b] = self.rate * g[a:b].sum() / (h[a:b].sum() + 1)
        return step

    def _quadrants(self, g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray] | None:
        """The cut of each of two features whose four quadrants gain most."""
        if min(g.shape) < 2:
            return None
        G, H, N = (v.cumsum(0).cumsum(1) for v in (g, h, n))
        total = 0.0
        fits = True
        parts = []
        for v in (G, H, N):
            a = v[:-1, :-1]
            parts.append((a, v[:-1, -1:] - a, v[-1:, :-1] - a, v[-1, -1] - v[:-1, -1:] - v[-1:, :-1] + a))
        for q in range(4):
            total = total + parts[0][q] ** 2 / (parts[1][q] + 1)
            fits = fits & (parts[2][q] >= self.least)
        if not np.any(fits):
            return None
        gain = np.where(fits, total, -1)
        r, c = np.unravel_index(int(gain.argmax()), gain.shape)
        step = np.zeros(g.shape)
        values = [self.rate * parts[0][q][r, c] / (parts[1][q][r, c] + 1) for q in range(4)]
        step[: r + 1, : c + 1], step[: r + 1, c + 1 :], step[r + 1 :, : c + 1], step[r + 1 :, c + 1 :] = values
        return float(gain[r, c]), step

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (c, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += t[np.searchsorted(c, x[:, f], side="right")]
        for i, j, ci, cj, t in self.pair_tables:
            total += t[np.searchsorted(ci, x[:, i], side="right"), np.searchsorted(cj, x[:, j], side="right")]
        return 1 / (1 + np.exp(-total))


def train(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> AdditiveModel:
    """The model of labels.quality on at most `sample` labelled documents (a bound of training alone) for which `usable` holds; of an id with several texts the one of least features trains."""
    truth = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(usable).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    chosen = truth.select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(cols: dict[str, list]) -> dict[str, list]:
        return {"doc_id": cols["doc_id"], "quality": cols["quality"], "x": features([t or b"" for t in cols["text"]]).tolist()}

    got = arrow_map(rows.select("doc_id", "quality", "text"), run, "doc_id long, quality int, x array<double>", binary_text=True).toArrow()
    ids, rows = got.column("doc_id").to_pylist(), got.column("x").to_pylist()
    got = got.take(pa.array(sorted(range(got.num_rows), key=lambda i: (ids[i], rows[i])), type=pa.int64()))
    x = np.array(got.column("x").to_pylist(), dtype=np.float64).reshape(-1, len(FEATURES))
    y = got.column("quality").to_numpy().astype(np.float64)
    seen: dict[int, int] = {}
    for i, d in enumerate(got.column("doc_id").to_pylist()):  # repeated ids train once
        seen.setdefault(d, i)
    once = np.array(list(seen.values()), dtype=np.int64)
    return AdditiveModel().fit(x[once], y[once])


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from threshold on) of every row of docs.

    held_out is a Boolean column of doc_id (null counts as false); labels of
    rows where it holds are never looked at. Scores come from the text alone. A
    null text counts as empty and is scored like any other. Labels that differ
    for an id, or are null, are not used; with none left, or only one kind,
    every score is the labels' share of good ones. Repeated rows give a row
    each; other columns are not read; an empty table gives no rows."""
    out = F.coalesce(held_out, F.lit(False))
    model = train(docs, labels, ~out)

    def run(cols: dict[str, list]) -> dict[str, list]:
        score = model.score(features([t or b"" for t in cols["text"]]))
        return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "score": score.tolist(), "predicted": (score >= threshold).astype(int).tolist()}

    own = docs.select("doc_id", out.alias("held_out"), "text")
    return arrow_map(own, run, "doc_id long, held_out boolean, score double, predicted int", binary_text=True)


def keep_good(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score_quality predicts to be good, with all their columns as they are.

    Null and empty texts are scored like any others, repeated rows alike; an empty
    table gives no rows."""
    model = train(docs, labels, ~F.coalesce(held_out, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            yield batch.filter(pa.array(model.score(features([t or b"" for t in texts])) >= threshold))

    return docs.mapInArrow(run, docs.schema)
