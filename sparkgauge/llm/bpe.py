"""BPE by speculation and verification.

A word is first cut by greedy longest match over the vocabulary.  A cut is the BPE cut
exactly if every adjacent pair of its tokens is compatible, that is, if BPE cuts the two
tokens' joined text into these two.  All pairs of a batch of words are tested together in
NumPy against a table of known pairs; only words with an incompatible pair are merged
exactly, by merge rank.

The vocabulary file gives everything (tokens, merges, special tokens, splitting pattern); it is
read on each worker from ``path``, never copied.  Texts are cut at special tokens, normalised
(NFC, lower case by character) and split into words by the pattern, in every script; the fixed
values below name the characters that the vocabulary's own library knows from another Unicode
version than Python does.  No tokenizer library is called.  Recent words are remembered in a
cache of bounded size, so a worker's memory does not grow with its input.

Null texts count as empty: no tokens.  Long texts are encoded whole.  Repeated rows stay
repeated; null ids stay null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Recent, arrow_type, text_slices, worker_state

#: Words of a cache's generation, of which two are kept, and pairs kept in all.
CACHE_WORDS = 150_000
CACHE_PAIRS = 500_000
#: Words of more letters than this are merged with a heap, and not remembered.
LONG_WORD = 200

# How the vocabulary's library differs from Python 3.13 and the regex module.
# Marks that it does not reorder or compose (code points, ranges by "-").
STARTERS = """
07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC
10EFD-10EFF 10F46-10F50 10F82-10F85 11070 1133B 1145E 11839-1183A 11930 1193D-1193E 11943 119E0 11A34 11A47
11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF 1E4EC-1E4EF
"""
# Later letters and numbers, which it takes for neither.
NO_LETTERS = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF
10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF
18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81
1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F
2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
NO_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
# Capitals that it lower-cases and Python does not: first, last, what to add.
LATER_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)


def _class(ranges: str) -> str:
    """Ranges of code points as the inside of a character class."""
    return "".join("-".join(f"\\U{int(x, 16):08X}" for x in r.split("-")) for r in ranges.split())


AT_STARTERS = regex.compile(f"([{_class(STARTERS)}])")
LOWER_LATER = {c: c + add for first, last, add in LATER_CAPITALS for c in range(first, last + 1)}
#: Texts without these need no normalising but lower case, and have the letters and numbers of LATIN only.
BEYOND_LATIN = regex.compile("[^\\x00-\\x7f\\xa0-\u017f\u2010-\u2027\u2030-\u205e]")
LATIN = {r"\p{L}": "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": "\\t-\\r \xa0"}


def normal(text: str) -> str:
    """NFC and lower case of a text, as the vocabulary's library does them."""
    if AT_STARTERS.search(text):
        text = "".join([unicodedata.normalize("NFC", x) for x in AT_STARTERS.split(text)])
    else:
        text = unicodedata.normalize("NFC", text)
    # by character: no rule for a letter's place in its word
    return "".join(map(str.lower, text)).translate(LOWER_LATER)


def _byte_letters() -> dict[int, str]:
    """The printable stand-in for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens and merges of a byte-level word BPE with an end-of-word suffix."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.path = path
        self.ids: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        latin = pattern
        for kind, inside in LATIN.items():  # all stand inside character classes
            latin = latin.replace(kind, inside)
        self.latin = re.compile(latin)
        for kind, later in (("L", NO_LETTERS), ("N", NO_NUMBERS)):
            pattern = pattern.replace(rf"\p{{{kind}}}", rf"[\p{{{kind}}}--[{_class(later)}]]")
        self.pieces = regex.compile("(?V1)" + pattern)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.letters = _byte_letters()
        self.table = {b: self.letters[b] for b in range(256)}
        # Word-final tokens are found by their letters; others by their letters as a prefix.
        n = len(self.suffix)
        self.last = {t[:-n]: i for t, i in self.ids.items() if n and t.endswith(self.suffix)}
        self.inner = {t: i for t, i in self.ids.items() if not (n and t.endswith(self.suffix))}
        # How far a token that begins with these three letters can reach.
        self.reach: dict[str, int] = {}
        for t in self.inner:
            self.reach[t[:3]] = max(self.reach.get(t[:3], 0), len(t))
        self.reach_last: dict[str, int] = {}
        for t in self.last:
            self.reach_last[t[:3]] = max(self.reach_last.get(t[:3], 0), len(t))
        self.texts = [""] * (max(self.ids.values()) + 1)
        for t, i in self.ids.items():
            self.texts[i] = t

    def merged(self, word: str, suffix: str | None = None) -> list[int]:
        """The exact cut of a word (in stand-in letters): merge the leftmost lowest rank until none is left."""
        parts = list(word)
        parts[-1] += self.suffix if suffix is None else suffix
        if len(parts) > LONG_WORD:
            return self._merged_long(parts)
        get, far = self.ranks.get, 1 << 60
        ranks = [get(p, far) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == far:
                break
            i = ranks.index(best)
            joined = parts[i] + parts[i + 1]
            parts[i : i + 2] = [joined]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], joined), far)
            if i < len(ranks):
                ranks[i] = get((joined, parts[i + 1]), far)
        ids = self.ids
        return [ids[p] for p in parts]

    def _merged_long(self, parts: list[str]) -> list[int]:
        """The same with a heap of candidate merges over a linked list, for very long words."""
        right = [*range(1, len(parts)), -1]
        left = [*range(-1, len(parts) - 1)]
        heap = [(r, i, p) for i, p in enumerate(zip(parts, parts[1:])) if (r := self.ranks.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = right[i]
            if j < 0 or (parts[i], parts[j]) != pair:
                continue  # one side was merged meanwhile
            parts[i], parts[j] = parts[i] + parts[j], ""
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
            for a, b in ((left[i], i), (i, k)):
                if a >= 0 and b >= 0 and (r := self.ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a, (parts[a], parts[b])))
        return [self.ids[p] for p in parts if p]

    def speculated(self, word: str) -> list[int]:
        """Greedy longest match."""
        out, at, end = [], 0, len(word)
        last, inner, reach, reach_last = self.last, self.inner, self.reach.get, self.reach_last.get
        while True:
            head = word[at : at + 3]
            if at + reach_last(head, 2) >= end and (i := last.get(word[at:end])) is not None:
                out.append(i)
                return out
            # a token inside the word may not reach its end: the last letter carries the suffix
            stop = min(at + reach(head, 2), end - 1)
            while (i := inner.get(word[at:stop])) is None:
                stop -= 1
            out.append(i)
            at = stop

    def compatible(self, a: int, b: int) -> bool:
        """Does BPE cut the two tokens' joined text into just these two?"""
        word = self.texts[a] + self.texts[b]
        n = len(self.suffix)
        if n and word.endswith(self.suffix):
            return self.merged(word[:-n]) == [a, b]
        return self.merged(word, "") == [a, b]


class Encoder:
    """Encodes and decodes texts on one worker."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.cuts: Recent = Recent(CACHE_WORDS)  # word, as the pattern splits them -> ids
        self.pair_keys = np.zeros(0, np.int64)
        self.pair_good = np.zeros(0, bool)
        self.failed = self.tried = 0

    def split(self, text: str) -> list[str]:
        """The vocabulary's words of a text without special tokens, normalised."""
        if BEYOND_LATIN.search(text):
            return self.vocab.pieces.findall(normal(text))
        return self.vocab.latin.findall(text.lower())

    def prepare(self, new: list[str]) -> dict[str, bytes]:
        """Cut words: speculate, verify all pairs together, mend failures."""
        if not new:
            return {}
        letters = [w if w.isascii() and w.isalpha() else _stand_in(w, self.vocab) for w in new]
        guess = [self.vocab.speculated(w) for w in letters]
        size = np.fromiter(map(len, guess), np.int64, len(guess))
        flat = np.fromiter((i for g in guess for i in g), np.int64, int(size.sum()))
        ends = size.cumsum()
        inside = np.ones(len(flat), bool)
        inside[ends - 1] = False  # no pair starts at a word's last token
        at = np.flatnonzero(inside)
        good = self._pairs_good((flat[at] << 20) | flat[at + 1])
        bad = np.unique(np.searchsorted(ends, at[~good], side="right"))
        self.tried += len(new)
        self.failed += len(bad)
        for k in bad.tolist():
            guess[k] = self.vocab.merged(letters[k])
        return {w: array("I", g).tobytes() for w, g in zip(new, guess)}

    def _pairs_good(self, keys: np.ndarray) -> np.ndarray:
        """Look all pairs up in the sorted table of known ones; judge each new pair once."""
        if len(self.pair_keys) > CACHE_PAIRS:
            self.pair_keys, self.pair_good = self.pair_keys[:0], self.pair_good[:0]
        wanted, back = np.unique(keys, return_inverse=True)
        at = np.searchsorted(self.pair_keys, wanted)
        known = at < len(self.pair_keys)
        known[known] = self.pair_keys[at[known]] == wanted[known]
        good = np.zeros(len(wanted), bool)
        good[known] = self.pair_good[at[known]]
        fresh = wanted[~known]
        if len(fresh):
            judged = np.fromiter((self.vocab.compatible(k >> 20, k & 0xFFFFF) for k in fresh.tolist()), bool, len(fresh))
            good[~known] = judged
            keys_all = np.concatenate([self.pair_keys, fresh])
            order = keys_all.argsort(kind="stable")
            self.pair_keys, self.pair_good = keys_all[order], np.concatenate([self.pair_good, judged])[order]
        return good[back]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        special, cuts = self.vocab.special, self.cuts
        split = []
        for t in texts:
            if self.vocab.at_special and self.vocab.at_special.search(t):
                parts = self.vocab.at_special.split(t)  # every second part is a special token
                split.append([w for i, x in enumerate(parts) for w in ([x] if i % 2 else self.split(x))])
                cuts.update((x, array("I", [special[x]]).tobytes()) for x in parts[1::2])  # no word reads like one
            else:
                split.append(self.split(t))
        fresh = self.prepare(cuts.missing(set().union(*split)))
        cuts.update(fresh)
        get = cuts.__getitem__
        out = [b"".join(map(get, s)) for s in split]
        for w in fresh:
            if len(w) > LONG_WORD:
                del cuts[w]
        cuts.turn()
        return out

    @property
    def shown(self) -> list[str]:
        """Each id's text in the decoded form: this vocabulary names no decoder, so tokens
        are joined by a space as they stand, stand-in letters and suffix included."""
        if not hasattr(self, "_shown"):
            v = self.vocab
            top = max([len(v.texts) - 1, *v.special.values()])
            self._shown = v.texts + [""] * (top + 1 - len(v.texts))
            for t, i in v.special.items():
                self._shown[i] = t
        return self._shown

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.shown.__getitem__, array("I", ids)))


def _stand_in(piece: str, v: Vocabulary) -> str:
    return piece.encode().decode("latin-1").translate(v.table)


def encoder(path: str) -> Encoder:
    """A worker's encoder, kept between tasks."""
    return worker_state(("bpe", path), lambda: Encoder(path))


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, columns: str, row) -> DataFrame:
    """One row a document: its id and what ``row(encoder, ids)`` gives, as Arrow batches."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {columns}"
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            for start, texts in text_slices(batch.column(1)):
                made = [row(enc, g) for g in enc.encode_batch(texts)]
                arrays = [pa.array(x, arrow_type(c)) for x, c in zip(zip(*made), columns.split(", "))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *arrays], ["doc_id", *names])

    return source.mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, the token ids, and the decoded text."""
    return _mapped(docs, path, id_col, text_col, "ids array<int>, decoded string", lambda enc, g: (array("I", g), enc.decode(g)))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: token count and digests of ids and decoded text, without moving either."""
    return _mapped(
        docs,
        path,
        id_col,
        text_col,
        "n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda enc, g: (len(g) // 4, hashlib.sha256(g).hexdigest(), hashlib.sha256(enc.decode(g).encode()).hexdigest()),
    )
