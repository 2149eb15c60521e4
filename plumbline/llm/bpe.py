"""BPE by a pair occurrence index over all distinct pre-tokens of a partition's batch.

Every adjacent pair that the vocabulary can merge is indexed: its rank maps to
all its positions in the batch.  Active ranks are taken in ascending order from
a heap; all live positions of the rank are merged, and the pairs that the merges
make are added to the lists of their own ranks.  Long lists are merged with numpy
at once, short ones and pairs of equal symbols one by one from the left.  A merge
that makes a pair of lower rank (the vocabulary could, in principle, merge it
first) marks its pre-token, which is then encoded by itself, lowest rank first.

Nulls and empty texts have no ids; the digest columns are those of the empty
string.  Repeated rows are answered each.  Empty tables give no rows.  Only
doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import shared, tokens

#: From this many positions on, a rank's list is merged with numpy.
AT_ONCE = 48


def byte_letters() -> list[str]:
    """The printable stand-in of every byte: itself where it prints, else the next free one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(prints) else chr(next(rest)) for b in range(256)]


class PairIndexEncoder:
    """Encoder and decoder for a word-end BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocabulary, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (max([*vocabulary.values(), *self.special.values()]) + 1)
        for t, i in [*vocabulary.items(), *self.special.items()]:
            self.names[i] = t
        letters = byte_letters()
        self.inner = np.array([vocabulary[c] for c in letters], np.int64)
        self.final = np.array([vocabulary[c + suffix] for c in letters], np.int64)
        self.size = len(self.names)
        pairs, made = [], []
        for left, right in spec["model"]["merges"]:
            pairs.append(vocabulary[left] * self.size + vocabulary[right])
            made.append(vocabulary[left + right])
        self.left, self.right = np.array(pairs) // self.size, np.array(pairs) % self.size
        self.made = np.array(made, np.int64)
        order = np.argsort(pairs)
        self.keys, self.ranks = np.array(pairs)[order], order.astype(np.int64)
        self.rank_of = dict(zip(pairs, range(len(pairs)), strict=True))
        rules = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = regex.compile(rules)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.memo = tokens.Memo()

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; the number of merges where a pair has none."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], len(self.keys))

    def _alone(self, symbols: list[int]) -> list[int]:
        """One pre-token: the leftmost pair of the lowest rank, until none is left."""
        none = len(self.keys)
        while len(symbols) > 1:
            ranks = [self.rank_of.get(a * self.size + b, none) for a, b in zip(symbols, symbols[1:], strict=False)]
            r = min(ranks)
            if r == none:
                break
            i = ranks.index(r)
            symbols[i : i + 2] = [int(self.made[r])]
        return symbols

    def merge(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens, ids of each)."""
        raw = [x.encode() for x in pretokens]
        sizes = np.array([len(x) for x in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        n, none = len(data), len(self.keys)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(raw), np.int64)
        ends = np.cumsum(sizes)
        full = sizes > 0
        sym = np.append(self.inner[data], -1)
        sym[ends[full] - 1] = self.final[data[ends[full] - 1]]
        start = sym[:n].copy()
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends[full] - 1], before[(ends - sizes)[full]] = n, n
        word = np.repeat(np.arange(len(raw)), sizes)
        ranks = self.rank(sym[:n], sym[after[:n]])
        at = np.flatnonzero(ranks < none)
        at = at[np.argsort(ranks[at].astype(np.uint16) if none < 1 << 16 else ranks[at], kind="stable")]
        active, first = np.unique(ranks[at], return_index=True)
        index: dict[int, list[np.ndarray]] = {int(r): [p] for r, p in zip(active, np.split(at, first[1:]), strict=True)} if len(active) else {}
        heap = active.tolist()
        odd: set[int] = set()

        def add(r: np.ndarray, p: np.ndarray, now: int) -> None:
            live = r < none
            if not live.any():
                return
            r, p = r[live], p[live]
            if (r < now).any():
                odd.update(word[p[r < now]].tolist())
            order = np.argsort(r, kind="stable")
            r, p = r[order], p[order]
            values, cuts = np.unique(r, return_index=True)
            for v, part in zip(values.tolist(), np.split(p, cuts[1:]), strict=True):
                if v not in index:
                    index[v] = []
                    heapq.heappush(heap, v)
                index[v].append(part)

        size, rank_of = self.size, self.rank_of
        while heap:
            r = heapq.heappop(heap)
            a, b, c = int(self.left[r]), int(self.right[r]), int(self.made[r])
            lists = index.pop(r)
            p = lists[0] if len(lists) == 1 else np.sort(np.concatenate(lists))
            if len(p) >= AT_ONCE and a != b:
                p = p[(sym[p] == a) & (sym[after[p]] == b)]
                q = after[p]
                sym[p], sym[q] = c, -2
                after[p] = after[q]
                inside = p[after[p] < n]
                before[after[inside]] = inside
                left = before[p]
                left = left[left < n]
                add(self.rank(sym[left], sym[after[left]]), left, r)
                add(self.rank(sym[inside], sym[after[inside]]), inside, r)
                continue
            for i in p.tolist():
                j = int(after[i])
                if sym[i] != a or sym[j] != b:
                    continue
                sym[i], sym[j] = c, -2
                k = int(after[j])
                after[i] = k
                if k < n:
                    before[k] = i
                for x, y in ((int(before[i]), i), (i, k)):
                    if x < n and y < n:
                        s = rank_of.get(int(sym[x]) * size + int(sym[y]))
                        if s is not None:
                            if s < r:
                                odd.add(int(word[x]))
                            if s not in index:
                                index[s] = []
                                heapq.heappush(heap, s)
                            index[s].append(np.array([x]))
        sym = sym[:n]
        for w in odd:
            lo, hi = int(ends[w] - sizes[w]), int(ends[w])
            own = self._alone(start[lo:hi].tolist())
            sym[lo:hi] = -2
            sym[lo : lo + len(own)] = own
        live = sym >= 0
        return sym[live].astype(np.uint32), np.bincount(word[live], minlength=len(raw)).astype(np.int64)

    def pretokens(self, word: str) -> list[str | int]:
        """A word by the vocabulary's rules; whole numbers are special tokens."""
        out: list[str | int] = []
        for part in self.at_special.split(word) if self.at_special else [word]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                text = "".join(c.lower() for c in unicodedata.normalize("NFC", part))
                # Code points that Unicode has not assigned are neither letters nor digits.
                masked = text if text.isascii() else "".join("\uffff" if unicodedata.category(c) == "Cn" else c for c in text)
                out += [text[m.start() : m.end()] for m in self.cut.finditer(masked)]
        return out

    def word_runs(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, starts, lengths) of distinct words without white space."""
        names, odd, codes, offsets = tokens.units(words)
        cut = [self.pretokens(w) for w in odd]
        extra = list(dict.fromkeys(x for c in cut for x in c))
        flat, starts, lengths = self.memo.runs(names + [x for x in extra if isinstance(x, str)], self.merge)
        place = {x: len(names) + i for i, x in enumerate(x for x in extra if isinstance(x, str))}
        special = [x for x in extra if isinstance(x, int)]
        place |= {x: len(starts) + i for i, x in enumerate(special)}
        starts = np.concatenate([starts, len(flat) + np.arange(len(special))])
        lengths = np.concatenate([lengths, np.ones(len(special), np.int64)])
        flat = np.concatenate([flat, np.array(special, np.uint32)])
        # Odd words name several units; plain words one or two.
        counts = np.diff(offsets)
        lists = np.split(codes, offsets[1:-1]) if odd else None
        if lists is not None:
            is_odd = np.flatnonzero(codes[offsets[:-1]] >= len(names))
            for w in is_odd.tolist():
                lists[w] = np.array([place[x] for x in cut[int(codes[offsets[w]]) - len(names)]], np.int64)
                counts[w] = len(lists[w])
            codes, offsets = np.concatenate(lists), np.concatenate([[0], np.cumsum(counts)])
        ids, bounds = tokens.gather(codes, starts, lengths, flat, offsets)
        return ids, bounds[:-1], np.diff(bounds)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets of the texts)."""
        codes, words, offsets = tokens.split_words(texts)
        flat, starts, lengths = self.word_runs(words)
        return tokens.gather(codes, starts, lengths, flat, offsets)

    def decode(self, ids) -> str:
        """The vocabulary has no decoder: its tokens, joined by blanks; special ones stay."""
        return " ".join([self.names[i] for i in ids])


_ENCODERS: dict[str, PairIndexEncoder] = {}


def encoder(path: str) -> PairIndexEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PairIndexEncoder(path)
    return _ENCODERS[path]


def encode(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and ids (array<int>) of every text of ``documents`` (doc_id, text)."""

    def run(batches):
        own = encoder(vocabulary)
        for held in tokens.text_batches(batches, 4 << 20):
            ids, offsets = own.encode(tokens.column(held, "text"))
            yield pa.RecordBatch.from_pydict({"doc_id": tokens.column(held, "doc_id"), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))})

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of every row of ``encoded`` (doc_id, ids)."""

    def run(batches):
        own = encoder(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array([own.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(documents: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; ids and decoded text are written out once a distinct word."""

    def run(batches):
        own = encoder(vocabulary)
        sha = lambda parts: hashlib.sha256(" ".join(parts).encode()).hexdigest()
        for held in tokens.text_batches(batches):
            codes, words, offsets = tokens.split_words(tokens.column(held, "text"))
            flat, starts, lengths = own.word_runs(words)
            listed, ends = flat.tolist(), (starts + lengths).tolist()
            runs = [listed[a:b] for a, b in zip(starts.tolist(), ends, strict=True)]
            numbers = [" ".join(map(str, x)) for x in runs]
            decoded = [own.decode(x) for x in runs]
            counts = np.concatenate([[0], np.cumsum(lengths[codes])])
            keep = lengths[codes] > 0
            offsets_kept = np.concatenate([[0], np.cumsum(keep)])[offsets]
            kept = codes[keep]
            out_ids, out_text = [], []
            for lo, hi in zip(offsets_kept[:-1].tolist(), offsets_kept[1:].tolist(), strict=True):
                own_words = kept[lo:hi].tolist()
                out_ids.append(sha([numbers[w] for w in own_words]))
                out_text.append(sha([decoded[w] for w in own_words]))
            yield pa.RecordBatch.from_pydict({"doc_id": tokens.column(held, "doc_id").cast(pa.int64()), "n_tokens": pa.array(np.diff(counts[offsets]), pa.int64()), "ids_sha256": pa.array(out_ids, pa.string()), "decoded_sha256": pa.array(out_text, pa.string())})

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(shared.table(spark, sf_dir, "documents"), tokens.vocabulary_path())
