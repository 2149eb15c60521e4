"""Word-wise use of the public word-level BPE vocabulary inside Spark tasks.

The vocabulary's normaliser and pre-tokeniser never join characters across a
blank or a line feed, so a text's ids are those of its blank-separated words,
one after the other.  A batch of texts is split and dictionary-encoded by Arrow,
each distinct word is encoded once, and the ids of all texts are gathered with
numpy.  A *plain* word (Latin-1 letters, then ASCII marks or nothing) is its
lower-case letters, one pre-token, and the marks, another; every other word goes
through the vocabulary's own rules as it stands.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PLAIN = r"^[A-Za-zÀ-ÖØ-öø-ÿ]+[!-/:-@\[-`{-~]*$"
#: Units whose ids a worker keeps between batches; beyond it new ones are encoded each time.
MEMO_UNITS = 500_000
#: Bytes of text that a task holds as one batch.
BATCH_BYTES = 24 << 20


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(word number of every word, distinct words, offsets of the texts); nulls are empty texts.

    Texts are cut at runs of ASCII white space, which never have ids of their own.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    words = lists.flatten().dictionary_encode()
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    return np.asarray(words.indices), words.dictionary, offsets - offsets[0]


def gather(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the runs ``flat[starts:starts+lengths]`` of ``codes``; also where each of ``offsets`` falls."""
    counts = lengths[codes]
    ends = np.cumsum(counts, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64)
    at += np.repeat(starts[codes] - ends + counts, counts)
    return flat[at], np.concatenate([np.zeros(1, np.int64), ends])[offsets]


def units(words: pa.Array) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """Cut distinct words into units: (plain units, odd words, unit codes, offsets of the words).

    Codes below ``len(plain)`` name plain units (letters, or one mark), the others odd words.
    """
    plain = np.asarray(pc.match_substring_regex(words, PLAIN))
    lower = pc.utf8_lower(words.filter(pa.array(plain)))
    bare = pc.utf8_rtrim(lower, MARKS)
    stems = bare.dictionary_encode()
    tails = pc.replace_substring_regex(lower, "^[a-zà-öø-ÿß]+", "").dictionary_encode()
    names = stems.dictionary.to_pylist() + tails.dictionary.to_pylist()
    odd = words.filter(pa.array(~plain)).to_pylist()
    first, second = np.empty(len(words), np.int64), np.full(len(words), -1, np.int64)
    first[plain] = np.asarray(stems.indices)
    first[~plain] = len(names) + np.arange(len(odd))
    second[plain] = np.where(np.asarray(pc.equal(lower, bare)), -1, len(stems.dictionary) + np.asarray(tails.indices))
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(1 + (second >= 0))])
    codes = np.empty(offsets[-1], np.int64)
    codes[offsets[:-1]] = first
    codes[offsets[1:][second >= 0] - 1] = second[second >= 0]
    return names, odd, codes, offsets


class Memo:
    """Id runs of units, kept between batches up to a bound."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = 0

    def runs(self, names: list[str], encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, starts, lengths) of ``names``; ``encode(missing)`` gives (flat ids, lengths)."""
        get = self.number.get
        at = np.fromiter((get(x, -1) for x in names), np.int64, len(names))
        missing = np.flatnonzero(at < 0)
        new = [names[i] for i in missing]
        flat, lengths = encode(new)
        keep = min(len(new), max(0, MEMO_UNITS - len(self.number)))
        kept = int(lengths[:keep].sum())
        while self.used + kept > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        starts = np.cumsum(lengths) - lengths
        self.flat[self.used : self.used + kept] = flat[:kept]
        self.number.update(zip(new[:keep], range(len(self.starts), len(self.starts) + keep), strict=True))
        self.starts = np.concatenate([self.starts, self.used + starts[:keep]])
        self.lengths = np.concatenate([self.lengths, lengths[:keep]])
        self.used += kept
        hit = at >= 0
        out_s, out_l = np.empty(len(names), np.int64), np.empty(len(names), np.int64)
        out_s[hit], out_l[hit] = self.starts[at[hit]], self.lengths[at[hit]]
        out_s[missing], out_l[missing] = self.used + starts, lengths
        return np.concatenate([self.flat[: self.used], flat]), out_s, out_l


class LibraryEncoder:
    """Ids by the tokenizers library, each distinct unit encoded once."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.memo = Memo()

    def _plain(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Plain units are encoded many at a time: each is one pre-token and ends with its only end-of-word id."""
        names_at = [i for i, x in enumerate(names) if x]
        full = [names[i] for i in names_at]
        flat = np.concatenate([np.zeros(0, np.uint32), *(np.array(self.tokenizer.encode(" ".join(full[lo : lo + 2000]), add_special_tokens=False).ids, np.uint32) for lo in range(0, len(full), 2000))])
        ends = np.flatnonzero(self.ends[flat])
        if len(ends) != len(full):
            raise ValueError("the vocabulary does not end every word with one end-of-word id")
        lengths = np.zeros(len(names), np.int64)
        lengths[names_at] = np.diff(np.concatenate([[-1], ends]))
        return flat, lengths

    def _odd(self, odd: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [np.array(e.ids, np.uint32) for lo in range(0, len(odd), 2000) for e in self.tokenizer.encode_batch_fast(odd[lo : lo + 2000], add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *found]), np.array([len(x) for x in found], np.int64)

    def unit_runs(self, names: list[str], odd: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat, starts, lengths = self.memo.runs(names, self._plain)
        more, counts = self._odd(odd)
        return np.concatenate([flat, more]), np.concatenate([starts, len(flat) + np.cumsum(counts) - counts]), np.concatenate([lengths, counts])

    def word_runs(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        names, odd, codes, offsets = units(words)
        flat, starts, lengths = self.unit_runs(names, odd)
        flat, bounds = gather(codes, starts, lengths, flat, offsets)
        return flat, bounds[:-1], np.diff(bounds)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids as uint32, offsets of the texts)."""
        codes, words, offsets = split_words(texts)
        flat, starts, lengths = self.word_runs(words)
        return gather(codes, starts, lengths, flat, offsets)


_ENCODERS: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    """The worker's encoder for a vocabulary; kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = LibraryEncoder(path)
    return _ENCODERS[path]


def text_batches(batches, size: int = BATCH_BYTES):
    """Regroup Arrow batches with a ``text`` column into tables of about ``size`` bytes of text (one text at least)."""
    held, total = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64()))
        lo, ends = 0, np.cumsum(lengths)
        while lo < batch.num_rows:
            base = ends[lo] - lengths[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, base + size - total, side="right")))
            held.append(batch.slice(lo, hi - lo))
            total += int(ends[hi - 1] - base)
            lo = hi
            if total >= size or lo < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    """A column of a combined table as one array."""
    c = table.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)
