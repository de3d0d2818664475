"""Token counts of a score-ordered BPE model (a sentencepiece .model) by rank-synchronous array merging."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from .common import arrow_map

#: Pre-tokens whose counts a worker remembers; when full, the memory starts anew.
REMEMBERED = 400_000


class RaggedCounter:
    """Counts tokens of pre-tokens held as rows of symbols.

    A pre-token is a run of word marks and what follows up to the next mark: no
    piece of a vocabulary split at white space has a mark after another
    character, so no merge crosses from one pre-token to the next."""

    MARK = "▁"

    def __init__(self, model_file: str, remembered: int = REMEMBERED):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        usable = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        pieces = [sp.id_to_piece(i) for i in usable]
        if any(self.MARK in p.lstrip(self.MARK) for p in pieces):
            raise ValueError("pieces of this model span words")
        if sp.normalize("A  ﬁ ①") != "▁A▁▁ﬁ▁①":
            raise ValueError("only models with identity normalisation and a leading word mark are supported")
        self.symbol = {p: k for k, p in enumerate(pieces)}
        #: Equal scores share a rank; ties then go to the leftmost pair.
        rank = np.unique(-np.array([sp.get_score(i) for i in usable]), return_inverse=True)[1]
        merges: dict[tuple[int, int], int] = {}
        for p, k in self.symbol.items():
            for cut in range(1, len(p)):
                a, b = self.symbol.get(p[:cut]), self.symbol.get(p[cut:])
                if a is not None and b is not None:
                    merges[a, b] = k
        keys = np.array([(a << 20) | b for a, b in merges], dtype=np.int64)
        made = np.array(list(merges.values()), dtype=np.int64)
        order = np.argsort(keys)
        self.pair_key, self.pair_made, self.pair_rank = keys[order], made[order], rank[made[order]]
        #: Characters outside the vocabulary take symbols above it; they never merge.
        self.outside = len(pieces)
        self.known: dict[str, int] = {}
        self.remembered = remembered
        self.pre = re.compile(f"{self.MARK}*[^{self.MARK}]+|{self.MARK}+")

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or a huge number) and result of each pair of symbols."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = (self.pair_key[at] == key) & (left < self.outside) & (right < self.outside)
        return np.where(hit, self.pair_rank[at], 1 << 40), self.pair_made[at]

    def count_many(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token; every round applies the lowest-rank pair of every row that has one."""
        total = np.zeros(len(words), dtype=np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((1, 8), (9, 16), (17, 32), (33, 64), (65, 256)):  # rows of similar length share a rectangle
            rows = np.flatnonzero((lengths >= low) & (lengths <= high))
            for start in range(0, len(rows), step := max(1, 400_000 // high)):
                part = rows[start : start + step]
                total[part] = self._rectangle([words[i] for i in part], high)
        for i in np.flatnonzero(lengths > 256):
            total[i] = self._long(words[i])
        return total

    def _rectangle(self, words: list[str], width: int) -> np.ndarray:
        n = len(words)
        syms = np.full((n, width + 1), self.outside, dtype=np.int64)
        extra = np.zeros(n, dtype=np.int64)
        lengths = np.fromiter(map(len, words), np.int64, n)
        chars = list("".join(words))
        ids = [self.symbol.get(c, -1) for c in chars]
        flat = np.array(ids, dtype=np.int64)
        row = np.repeat(np.arange(n), lengths)
        col = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        strange = np.flatnonzero(flat < 0)
        for i in strange:
            extra[row[i]] += len(chars[i].encode("utf-8", "surrogatepass")) - 1
        flat[strange] = self.outside
        syms[row, col] = flat
        live, count = np.arange(n), lengths.copy()
        ranks, made = self._pairs(syms[:, :-1], syms[:, 1:])
        while len(live):
            at = ranks.argmin(axis=1)
            k = np.arange(len(live))
            go = ranks[k, at] < 1 << 40
            if not go.all():
                live, syms, ranks, made, at = live[go], syms[go], ranks[go], made[go], at[go]
                k = np.arange(len(live))
                if not len(live):
                    break
            new = made[k, at]
            place = np.arange(width + 1)
            shift = np.minimum(place + (place > at[:, None]), width)
            syms = np.take_along_axis(syms, shift, 1)
            syms[:, width] = self.outside
            syms[k, at] = new
            gap = np.minimum(np.arange(width) + (np.arange(width) > at[:, None]), width - 1)
            ranks, made = np.take_along_axis(ranks, gap, 1), np.take_along_axis(made, gap, 1)
            ranks[:, width - 1] = 1 << 40
            ranks[k, at], made[k, at] = self._pairs(new, syms[k, np.minimum(at + 1, width)])
            has = at > 0
            if has.any():
                j = k[has]
                ranks[j, at[has] - 1], made[j, at[has] - 1] = self._pairs(syms[j, at[has] - 1], new[has])
            count[live] -= 1
        return count + extra

    def _long(self, word: str) -> int:
        """One very long pre-token: a heap of pairs over a linked row of symbols, so time stays near linear."""
        import heapq

        syms = [self.symbol.get(c, -1) for c in word]
        extra = sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c, s in zip(word, syms, strict=True) if s < 0)
        n = len(syms)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        table = self._merges()
        heap = []

        def push(i: int) -> None:
            j = following[i]
            if j < n and (hit := table.get((syms[i], syms[j]))):
                heapq.heappush(heap, (hit[0], i, syms[i], syms[j], hit[1]))

        for i in range(n - 1):
            push(i)
        left = n
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = following[i]
            if syms[i] != a or j >= n or syms[j] != b:
                continue
            syms[i], syms[j] = new, -2
            following[i] = following[j]
            if following[j] < n:
                before[following[j]] = i
            left -= 1
            push(i)
            if before[i] >= 0:
                push(before[i])
        return left + extra

    def _merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        if not hasattr(self, "_table"):
            self._table = {(int(k) >> 20, int(k) & 0xFFFFF): (int(r), int(m)) for k, r, m in zip(self.pair_key, self.pair_rank, self.pair_made, strict=True)}
        return self._table

    def count_texts(self, texts: list[str]) -> list[int]:
        if len(self.known) > self.remembered:
            self.known.clear()
        cut, fresh = [], set()
        for text in texts:
            marked = self.MARK + text.replace(" ", self.MARK) if text else ""
            if self.MARK * 2 in marked or marked.endswith(self.MARK) or "▁" in text:
                words = self.pre.findall(marked)
            else:  # single marks only: the words are what lies between them
                words = [self.MARK + w for w in marked[1:].split(self.MARK)] if marked else []
            cut.append(words)
            fresh.update(words)
        known = self.known
        if new := [w for w in fresh if w not in known]:
            known.update(zip(new, self.count_many(new).tolist(), strict=True))
        get = known.__getitem__
        return [sum(map(get, words)) for words in cut]


_counters: dict[str, RaggedCounter] = {}


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and repeated
    ids give a row each; other columns of docs are not read. Special strings in
    a text are ordinary text. An empty table gives no rows."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        counter = _counters.get(model_file)
        if counter is None:
            counter = _counters[model_file] = RaggedCounter(model_file)
        texts = [t or "" for t in cols["text"]]
        n: list[int] = []
        for i in range(0, len(texts), 200):
            n += counter.count_texts(texts[i : i + 200])
        return {"doc_id": cols["doc_id"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [x > limit for x in n]}

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
