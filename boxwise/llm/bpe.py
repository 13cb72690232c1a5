"""Operator 9: byte-level BPE, speculate and verify.

Texts are cut into words by the tokenizer's own pattern. For words not yet known, greedy longest match proposes tokens; all
adjacent pairs of all proposals are then checked at once: a pair stands if no merge across its border would come before
the merges that use up the pieces beside the border. A proposal whose pairs all stand, and whose tokens encode to themselves,
is the encoding; only words that fail are merged exactly. Results are remembered per word, up to a bound in bytes and no
longer than a partition lasts.

Edge cases: a null text is an empty text with no token; special tokens in a text become their ids, as the library does; lone
surrogates can't occur in Spark's strings; repeated rows give equal rows; further columns are ignored."""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxwise.llm.common import BLOCK_BYTES, mapped, text_blocks

#: Fixed value: the public pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = 1 << 30


def _byte_of() -> dict[str, int]:
    """The vocabulary's letter for each byte: printable Latin-1 characters stand for themselves, the rest follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizer:
    """Vocabulary, merges and spines of a byte-level BPE file."""

    #: Bytes of words in a generation; two are remembered, and what is met again moves to the younger. Verdicts on pairs.
    REMEMBERED, PAIRS = 32 << 20, 200_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        if (data.get("normalizer"), data["pre_tokenizer"]) != (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}):
            raise ValueError("only byte-level files without normalizer and prefix space are read")
        letters = _byte_of()
        text_of = {i: t for t, i in data["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.bytes_of = {i: bytes(letters[c] for c in t) for i, t in text_of.items() if t not in self.special}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        vocab = data["model"]["vocab"]
        self.n = max(self.bytes_of) + 1
        self.rank: dict[int, int] = {}
        self.made = [vocab[a + b] for a, b in merges]
        made: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            self.rank.setdefault(vocab[a] * self.n + vocab[b], r)
            made.setdefault(self.made[r], (r, vocab[a], vocab[b]))
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        self.reach: dict[bytes, int] = {}
        for b in self.id_of:
            self.reach[b[:2]] = max(self.reach.get(b[:2], 0), len(b))
        keys = np.fromiter(self.rank, np.int64, len(self.rank))
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.fromiter(self.rank.values(), np.int64, len(keys))[order]
        self._spines(made)
        self.word = regex.compile(PATTERN)
        self.cut_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.forget()
        self.trusted = {i for i, b in self.bytes_of.items() if len(b) == 1 or self.exact(b) == [i]}

    def forget(self) -> None:
        """Drop what was remembered of words and pairs."""
        self.known: dict[str, tuple[str, bytes]] = {}
        self.before: dict[str, tuple[str, bytes]] = {}
        self.good: dict[int, bool] = {}
        self.held = 0

    def _spines(self, made: dict[int, tuple[int, int, int]]) -> None:
        """For each token the pieces at its right (left) edge and the rank at which each is merged into the next."""

        def spine(i: int, side: int) -> list[tuple[int, int]]:
            out, until = [(i, NONE)], NONE
            while i in made:
                until, i = made[i][0], made[i][side]
                out.append((i, until))
            return out

        sides = [[spine(i, side) if i in self.bytes_of else [] for i in range(self.n)] for side in (2, 1)]
        deep = [max(map(len, s)) for s in sides]
        self.edge = [np.full((self.n, d), -1, np.int32) for d in deep]
        self.until = [np.full((self.n, d), -1, np.int32) for d in deep]
        for side in (0, 1):
            for i, s in enumerate(sides[side]):
                for k, (piece, until) in enumerate(s):
                    self.edge[side][i, k], self.until[side][i, k] = piece, until

    def exact(self, word: bytes) -> list[int]:
        """Merge by rank, leftmost first."""
        single, rank, n = self.single, self.rank.get, self.n
        parts = [single[b] for b in word]
        ranks = [rank(a * n + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            r = min(ranks)
            if r == NONE:
                break
            k = ranks.index(r)
            m = parts[k] = self.made[r]
            del parts[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank(parts[k - 1] * n + m, NONE)
            if k < len(ranks):
                ranks[k] = rank(m * n + parts[k + 1], NONE)
        return parts

    def greedy(self, word: bytes) -> list[int]:
        out, at, n, reach = [], 0, len(word), self.reach.get
        while at < n:
            end = min(n, at + reach(word[at : at + 2], 1))
            while (i := self.id_of.get(word[at:end])) is None:
                end -= 1
            out.append(i)
            at = end
        return out

    def pairs_stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays apart when its bytes are encoded together."""
        x, xu = self.edge[0][a][:, :, None], self.until[0][a][:, :, None]
        y, yu = self.edge[1][b][:, None, :], self.until[1][b][:, None, :]
        key = x.astype(np.int64) * self.n + y
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        crosses = (self.keys[at] == key) & (x >= 0) & (y >= 0)
        r = self.ranks[at]
        return ~(crosses & (r < xu) & (r <= yu)).any(axis=(1, 2))

    def learn(self, words: list[str]) -> None:
        """Encode new words: speculate, verify all pairs at once, merge the rest exactly."""
        data = [w.encode("utf-8", "surrogatepass") for w in words]
        proposed = [self.greedy(b) for b in data]
        new = {p[k] * self.n + p[k + 1] for p in proposed for k in range(len(p) - 1)} - self.good.keys()
        if new:
            if len(self.good) + len(new) > self.PAIRS:
                self.good = {}
                new = {p[k] * self.n + p[k + 1] for p in proposed for k in range(len(p) - 1)}
            pairs = np.fromiter(new, np.int64, len(new))
            for lo in range(0, len(pairs), 1024):
                part = pairs[lo : lo + 1024]
                self.good.update(zip(part.tolist(), self.pairs_stand(part // self.n, part % self.n).tolist(), strict=True))
        for w, b, p in zip(words, data, proposed, strict=True):
            if not (all(self.good[p[k] * self.n + p[k + 1]] for k in range(len(p) - 1)) and all(i in self.trusted for i in p)):
                p = self.exact(b) if len(b) <= 400 else self._long(b)
            self._keep(w, (",".join(map(str, p)), b"".join(map(self.bytes_of.__getitem__, p))))

    def _long(self, word: bytes) -> list[int]:
        """Exact merging of a very long word with a heap, in n log n."""
        import heapq

        ids = [self.id_of[bytes([b])] for b in word]
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := self.rank.get(ids[k] * self.n + ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = right[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j], right[k] = self.made[r], -1, right[j]
            if right[j] >= 0:
                left[right[j]] = k
            for u, v in ((left[k], k), (k, right[k])):
                if u >= 0 and v >= 0 and (r := self.rank.get(ids[u] * self.n + ids[v])) is not None:
                    heapq.heappush(heap, (r, u, ids[u], ids[v]))
        return [i for i in ids if i >= 0]

    def _pieces(self, text: str) -> list[str]:
        """Words of a text; a special token is a piece of its own, marked by a leading NUL and its id."""
        if self.cut_special is None or not self.cut_special.search(text):
            return self.word.findall(text)
        out, at = [], 0
        for m in self.cut_special.finditer(text):
            out += self.word.findall(text[at : m.start()])
            out.append(_MARK + m[0])
            at = m.end()
        return out + self.word.findall(text[at:])

    def _keep(self, word: str, found: tuple[str, bytes]) -> None:
        self.known[word] = found
        self.held += 330 + len(word) + len(found[0]) + len(found[1])

    def encode(self, texts: list[str]) -> list[list[tuple[str, bytes]]]:
        """For each text its words as (ids joined by commas, their bytes decoded from the ids)."""
        split = [self._pieces(t) for t in texts]
        if self.held > self.REMEMBERED:
            self.before, self.known, self.held = self.known, {}, 0
        new = {w for own in split for w in own} - self.known.keys()
        for w in new & self.before.keys():
            self._keep(w, self.before[w])
            new.discard(w)
        for w in [w for w in new if w.startswith(_MARK)]:
            i = self.special[w[len(_MARK) :]]
            self._keep(w, (str(i), self.bytes_of[i]))
            new.discard(w)
        self.learn(list(new))
        get = self.known.__getitem__
        return [list(map(get, own)) for own in split]

    def ids(self, text: str) -> list[int]:
        return [int(i) for own, _ in self.encode([text])[0] for i in own.split(",")]

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


#: Leads a special token among the words; no word of PATTERN mixes letters, spaces and noncharacters like this.
_MARK = "﷐ x﷐"
_LOADED: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def encoded(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with with_ids the ids and the decoded text."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for ids, texts in text_blocks(batches, limit=BLOCK_BYTES // 2):
            columns: list[list] = [[] for _ in names]
            for i, words in zip(ids, own.encode(texts), strict=True):
                joined = ",".join([w[0] for w in words])
                decoded = b"".join([w[1] for w in words]).decode("utf-8", "replace")
                row = [i, joined.count(",") + 1 if joined else 0, sha256(joined.encode()).hexdigest(), sha256(decoded.encode("utf-8")).hexdigest()]
                if with_ids:
                    row += [[int(x) for x in joined.split(",")] if joined else [], decoded]
                for c, x in zip(columns, row, strict=True):
                    c.append(x)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema, lambda: tokenizer(path).forget())
