"""Byte-level BPE: a backtracking encoder and a decoder by an offset table.

The encoder takes, at each position, the longest vocabulary token that an
Aho-Corasick automaton finds there, and keeps it only if it may stand after the
token before it; else it tries the next shorter token, and with none left takes
back the previous one. Every position is given up once at most, so the time is
linear; a pair may stand together if undoing both tokens' merges step by step
never shows a merge across their border that would have come first. The result
is exactly what applying the merges in rank order gives."""

from __future__ import annotations

import hashlib
import json
from array import array

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import arrow_map

#: Fixed values of byte-level vocabularies: the pre-token pattern, and the printable stand-ins of bytes.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))
#: Chunks whose ids a worker remembers; when full, the memory starts anew.
REMEMBERED = 400_000


def stand_ins() -> dict[str, int]:
    """The byte behind each printable stand-in: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [b for span in PRINTABLE for b in span]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """A tokenizers .json of kind byte-level BPE: token bytes, merges, special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("only plain byte-level BPE without normaliser and prefix space is supported")
        byte = stand_ins()
        self.tokens = [b""] * (max([*model["vocab"].values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for shown, i in model["vocab"].items():
            self.tokens[i] = bytes(byte[c] for c in shown)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for shown, i in self.special.items():
            self.tokens[i] = shown.encode()
        self.plain = set(model["vocab"].values())
        #: (left id, right id) -> (rank, merged id); merged id -> its parts
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[model["vocab"][a], model["vocab"][b]] = (rank, model["vocab"][a + b])
        self.made_by = {m: (rank, *pair) for pair, (rank, m) in self.merges.items()}


class BacktrackingEncoder:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        import ahocorasick

        self.vocab = v = Vocabulary(path)
        self.automaton = ahocorasick.Automaton()
        for i in v.plain:
            self.automaton.add_word(v.tokens[i].decode("latin-1"), (len(v.tokens[i]), i))
        self.automaton.make_automaton()
        ids = {v.tokens[i]: i for i in v.plain}
        self.single = [ids[bytes([b])] for b in range(256)]
        #: The longest token that begins another token and is shorter, or -1.
        self.shorter = [-1] * len(v.tokens)
        for i in v.plain:
            t = v.tokens[i]
            self.shorter[i] = next((ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ids), -1)
        self.length = [len(t) for t in v.tokens]
        #: The pair-compatibility table, filled as pairs come up.
        self.may_follow: dict[int, bool] = {}
        #: Tokens that merging their own bytes gives.
        self.reachable: set[int] = set()
        for i in sorted(v.plain, key=lambda i: (made := v.made_by.get(i)) and made[0] or -1):
            made = v.made_by.get(i)
            if made is None or made[1] in self.reachable and made[2] in self.reachable and self.compatible(made[1], made[2], made[0]):
                self.reachable.add(i)
        self.pre = regex.compile(PATTERN)
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, v.special)) + ")") if v.special else None
        self.remembered = remembered
        self.chunks = _Memory(self, " ")
        self.pieces = _Memory(self, "")
        self.words: dict[str, bytes] = {}

    def compatible(self, left: int, right: int, bound: int = 1 << 40) -> bool:
        """Whether right may stand after left: no merge across their border comes before those inside them, or before the rank `bound`."""
        made, merges = self.vocab.made_by, self.vocab.merges
        while True:
            across = merges.get((left, right))
            if across is not None and across[0] < bound:
                return False
            a, b = made.get(left), made.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                bound, left = a[0], a[2]
            else:  # of equal merges the left one comes first, so one across the border at this very rank wins
                bound, right = b[0] + 1, b[1]

    def encode_bytes(self, text: str) -> list[int]:
        """Ids of one pre-token, given as one character a byte."""
        size = len(text)
        longest: list[int] = [-1] * size
        reach = [0] * size
        for end, (n, token) in self.automaton.iter(text):
            if n > reach[end - n + 1]:
                reach[end - n + 1], longest[end - n + 1] = n, token
        whole = longest[0]
        if reach[0] == size and whole in self.reachable:
            return [whole]
        open_at = [True] * (size + 1)
        out: list[int] = []
        lengths, shorter, known = self.length, self.shorter, self.may_follow
        at, token, last = 0, whole, -1
        while at < size:
            if token < 0:  # nothing fits here any more: take the token before back
                open_at[at] = False
                last = out.pop()
                at -= lengths[last]
                token = shorter[last]
                last = out[-1] if out else -1
                continue
            end = at + lengths[token]
            if open_at[end]:
                if last < 0:
                    fits = token in self.reachable
                else:
                    fits = known.get(last << 32 | token)
                    if fits is None:
                        fits = token in self.reachable and self.compatible(last, token)
                        known[last << 32 | token] = fits
                if fits:
                    out.append(token)
                    last, at = token, end
                    if at < size:
                        token = longest[at]
                    continue
            token = shorter[token]
        return out

    def word(self, pre_token: str) -> bytes:
        known = self.words.get(pre_token)
        if known is None:
            if len(self.words) > self.remembered:
                self.words.clear()
            if len(self.may_follow) > 1_000_000:
                self.may_follow.clear()
            ids = self.encode_bytes(pre_token.encode("utf-8", "surrogatepass").decode("latin-1"))
            known = self.words[pre_token] = array("I", ids).tobytes()
        return known

    def plain(self, text: str) -> bytes:
        """Ids of text without special tokens, as little-endian 32-bit integers.

        A space before another character always begins a pre-token if single
        spaces alone separate; such chunks are encoded once and remembered."""
        if not text:
            return b""
        if "  " in text or text[0] == " " or text[-1] == " ":
            return b"".join(map(self.word, self.pre.findall(text)))
        first, *rest = text.split(" ")
        return self.pieces[first] + b"".join(map(self.chunks.__getitem__, rest))

    def encode(self, text: str) -> bytes:
        if self.cut_special is None or not any(s in text for s in self.vocab.special):
            return self.plain(text)
        parts = self.cut_special.split(text)
        return b"".join(int(self.vocab.special[p]).to_bytes(4, "little") if k % 2 else self.plain(p) for k, p in enumerate(parts))


class _Memory(dict):
    """Chunk -> ids, filled on demand."""

    def __init__(self, encoder: BacktrackingEncoder, before: str):
        super().__init__()
        self.encoder, self.before = encoder, before

    def __missing__(self, chunk: str) -> bytes:
        e = self.encoder
        if len(self) > e.remembered:
            self.clear()
        ids = self[chunk] = b"".join(map(e.word, e.pre.findall(self.before + chunk)))
        return ids


class OffsetDecoder:
    """Token bytes in one array, found by an offset table."""

    def __init__(self, vocab: Vocabulary):
        self.blob = np.frombuffer(b"".join(vocab.tokens), dtype=np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(t) for t in vocab.tokens])]).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        start, size = self.offset[ids], self.offset[ids.astype(np.int64) + 1] - self.offset[ids]
        before = np.cumsum(size) - size
        return self.blob[np.arange(int(size.sum())) + np.repeat(start - before, size)].tobytes()


_encoders: dict[str, tuple[BacktrackingEncoder, OffsetDecoder]] = {}


def encoder_of(path: str) -> tuple[BacktrackingEncoder, OffsetDecoder]:
    if path not in _encoders:
        encoder = BacktrackingEncoder(path)
        _encoders[path] = encoder, OffsetDecoder(encoder.vocab)
    return _encoders[path]


def encode_decode(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian 32-bit), decoded (string) of every whole text.

    A null text counts as empty: no ids, decoded "". The strings of special
    tokens in a text become those tokens, as by the library's default.
    Repeated rows and ids give a row each; other columns are not read."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        encoder, decoder = encoder_of(tokenizer_file)
        ids = [encoder.encode(t or "") for t in cols["text"]]
        text = [decoder.decode(np.frombuffer(i, dtype="<u4")).decode("utf-8", "replace") for i in ids]
        return {"doc_id": cols["doc_id"], "n_tokens": [len(i) // 4 for i in ids], "ids": ids, "decoded": text}

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids binary, decoded string")


def digests(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """encode_decode with SHA-256 digests in place of ids and text, made where they arise so that neither moves.

    A null text counts as empty: 0 tokens and the digests of nothing. Repeated rows
    and ids give a row each, special strings in a text become special ids as the
    library has it, other columns are not read, an empty table gives no rows."""

    def run(cols: dict[str, list]) -> dict[str, list]:
        encoder, decoder = encoder_of(tokenizer_file)
        out: dict[str, list] = {"doc_id": cols["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in cols["text"]:
            ids = encoder.encode(t or "")
            text = decoder.decode(np.frombuffer(ids, dtype="<u4"))
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(text.decode("utf-8", "replace").encode()).hexdigest())
        return out

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
