"""BPE encoding and decoding by batched numpy merge rounds.

``WordBpe`` reads a public BPE file whose words end in ``</w>`` and gives the ids that the
tokenizers library gives. The characters of many texts lie in one flat array: their classes
mark where pieces begin, and a bounded table holds the ids of pieces seen before: a hash from
prefix sums finds the entry, whose whole text is then compared, letter by letter over all pieces.
The others are encoded together: the symbols of all of them lie in one flat array, each round
finds every adjacent pair's rank by binary search over sorted pair keys, takes the lowest rank
of each piece and merges all its occurrences.

Defined results: null or empty text has no ids and decodes to the empty string; the special
tokens' strings inside a text become their single ids; equal texts give equal ids; rows are
kept as they are (also repeated ones), extra columns are left out.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skald.llm.shared import text_slices, whole_text

#: White space as Unicode's White_Space has it.
SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_OTHER, _LETTER, _NUMBER, _BLANK = range(4)
#: Endings that follow an apostrophe and form a piece with it.
_ONE, _TWO = [ord(c) for c in "stmd"], [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_NONE = np.int64(1) << 40
#: Rounds over one piece take time in proportion to its symbols times its merges; beyond so many, a heap gives the same ids.
LONG = 8192
#: Pieces, of similar length, and symbols that one series of rounds merges: their arrays stay in the processor's cache.
ROUND_WORDS, ROUND_SYMBOLS = 4000, 64_000
#: Pieces whose ids are kept, and their letters; a full table is emptied.
CACHE, LETTERS = 800_000, 12_000_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """The printable letter that byte-level BPE writes for each byte: itself if printable, else the next from U+0100."""
    own = {b for lo, hi in ((33, 126), (161, 172), (174, 255)) for b in range(lo, hi + 1)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


@functools.cache
def char_kinds() -> np.ndarray:
    """The class of each character as the file's pattern tells them apart."""
    kinds = np.zeros(0x110000, np.uint8)
    for first in range(0, len(kinds), 1 << 14):  # a string object for each character at once would take 100 MB
        every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(first, first + (1 << 14)))
        for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
            kinds[[first + m.start() for m in regex.finditer(pattern, every)]] = kind
    kinds[SPACE] = _BLANK
    return kinds


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the hash's odd base modulo 2**64, and of its inverse."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16) * 5 // 4
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64)))]
    return _POWERS[0][:n], _POWERS[1][:n]


def spans(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``begin, begin + 1, ...`` of each span, one span after the other."""
    total = np.cumsum(sizes)
    return np.repeat(begin - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0)


class WordBpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        end = spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.size = max(*vocab.values(), *self.special.values()) + 1
        self.strings = [""] * self.size
        for token, i in (vocab | self.special).items():
            self.strings[i] = token
        self._forget()

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def _rounds(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (not empty), as little-endian unsigned 32-bit integers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols, word = self.inner[raw], np.repeat(np.arange(len(words)), sizes)
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[raw[ends]]
        rank = np.full(len(symbols), _NONE)
        inside = np.flatnonzero(word[:-1] == word[1:])
        rank[inside] = self._rank(symbols[inside], symbols[inside + 1])
        done_word, done_symbol = [], []
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[starts, len(symbols)])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            over = lowest == _NONE
            if over.any():
                done_word.append(word[over])
                done_symbol.append(symbols[over])
                symbols, word, rank, lowest = symbols[~over], word[~over], rank[~over], lowest[~over]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == lowest)
            # A pair that overlaps the one before it (as in "aaa") waits: every second one of a run merges.
            run = np.r_[True, np.diff(at) != 1] | np.r_[True, word[at[1:]] != word[at[:-1]]]
            offset = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[offset % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep)[at] - 1
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            touched = np.zeros(len(symbols) + 1, bool)
            touched[moved] = touched[moved - 1] = True
            changed = np.flatnonzero(touched[:-1])
            rank[changed] = _NONE
            changed = changed[changed + 1 < len(symbols)]
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed] = self._rank(symbols[changed], symbols[changed + 1])
        word, symbols = np.concatenate(done_word), np.concatenate(done_symbol)
        order = np.argsort(word, kind="stable")
        ids = symbols[order].astype("<u4").tobytes()
        cut = (np.cumsum(np.bincount(word, minlength=len(words))) * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *cut], cut, strict=False)]

    @functools.cached_property
    def _rank_of(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))

    def _long(self, word: bytes) -> bytes:
        """The same for one long word: a heap of pairs by rank and place over a linked list."""
        raw = np.frombuffer(word, np.uint8)
        symbols = self.inner[raw].tolist()
        symbols[-1] = int(self.last[raw[-1]])
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        known = self._rank_of
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := known.get(symbols[i] << 20 | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if symbols[i] == a else n
            if j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := known.get(symbols[x] << 20 | symbols[y])) is not None:
                    heapq.heappush(heap, (r, x, symbols[x], symbols[y]))
        return np.array([s for s in symbols if s >= 0], "<u4").tobytes()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.at, self.count, self.first, self.size_of = (np.zeros(0, np.int64) for _ in range(4))
        self.flat, self.letters = np.zeros(0, np.uint32), np.zeros(0, np.uint32)

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of ``pieces`` has, and all of them in order."""
        raw = [p.encode() for p in pieces]
        ids: list[bytes] = [b""] * len(raw)
        short = sorted((i for i, r in enumerate(raw) if len(r) <= LONG), key=lambda i: len(raw[i]))
        begin = size = 0
        for k, i in enumerate([*short, -1]):
            size += len(raw[i]) if i >= 0 else 0
            if k > begin and (i < 0 or k - begin == ROUND_WORDS or size > ROUND_SYMBOLS):
                for j, x in zip(short[begin:k], self._rounds([raw[j] for j in short[begin:k]]), strict=True):
                    ids[j] = x
                begin, size = k, len(raw[i])
        for i, r in enumerate(raw):
            if len(r) > LONG:
                ids[i] = self._long(r)
        return np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), "<u4")

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Put new pieces, in the order of their hashes, into the table."""
        count, ids = self._ids(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        at, first = len(self.flat) + np.cumsum(count) - count, len(self.letters) + np.cumsum(sizes) - sizes
        self.flat = np.concatenate([self.flat, ids])
        self.letters = np.concatenate([self.letters, np.frombuffer("".join(pieces).encode("utf-32-le"), "<u4")])
        place = np.searchsorted(self.hashes, hashes)
        own = (self.hashes, self.at, self.count, self.first, self.size_of)
        self.hashes, self.at, self.count, self.first, self.size_of = (np.insert(a, place, x) for a, x in zip(own, (hashes, at, count, first, sizes), strict=True))

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of sorted hashes in the table, and which of them it has."""
        place = np.searchsorted(self.hashes, hashes)
        held = place < len(self.hashes)
        held[held] = self.hashes[place[held]] == hashes[held]
        return place, held

    def _unlike(self, entry: np.ndarray, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The pieces whose text is not that of their ``entry``."""
        sizes = end - begin
        same = self.size_of[entry] == sizes
        alike = np.flatnonzero(same)
        differ = codes[spans(begin[alike], sizes[alike])] != self.letters[spans(self.first[entry[alike]], sizes[alike])]
        if differ.any():
            same[alike[np.searchsorted(np.cumsum(sizes[alike]), np.flatnonzero(differ), "right")]] = False
        return np.flatnonzero(~same)

    @staticmethod
    def _plain(text: str) -> str:
        if text.isascii():
            return text.lower()
        text = text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # else Python writes a final sigma

    @staticmethod
    def _cut(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin and end: runs of letters, single numbers, runs of others, apostrophe endings."""
        kind = char_kinds()[codes]
        first = np.ones(len(codes) + 1, bool)
        first[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        apostrophe = np.flatnonzero((codes[:-2] == 39) & first[:-3])
        if len(apostrophe):
            one = apostrophe[np.isin(codes[apostrophe + 1], _ONE)]
            two = np.concatenate([apostrophe[(codes[apostrophe + 1] == a) & (codes[apostrophe + 2] == b)] for a, b in _TWO])
            first[one + 1] = first[two + 1] = False
            first[one + 2] = first[two + 3] = True
        edges = np.flatnonzero(first)
        begin, end = edges[:-1], edges[1:]
        full = kind[begin] != _BLANK
        return begin[full], end[full]

    def _encode(self, texts: list[str]) -> list[bytes]:
        plain = [self._plain(t) for t in texts]
        sizes = np.fromiter(map(len, plain), np.int64, len(plain)) + 1
        joined = "\n".join([*plain, "\n\n"])
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        begin, end = self._cut(codes)
        if not len(begin):
            return [b""] * len(texts)
        power, inverse = powers(len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes + np.uint64(1)) * _MIX * power, out=sums[1:])
        hashes = (sums[end] - sums[begin]) * inverse[begin]
        hashes ^= hashes >> np.uint64(29)
        hashes *= _MIX
        distinct, which = np.unique(hashes, return_inverse=True)
        place, held = self._find(distinct)
        if not held.all():
            some = np.zeros(len(distinct), np.int64)
            some[which] = np.arange(len(which))
            if len(self.hashes) + len(distinct) > CACHE or len(self.letters) > LETTERS:
                self._forget()
                held[:] = False
            new = some[~held]
            self._learn(distinct[~held], [joined[a:b] for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)])
            place, _ = self._find(distinct)
        entry = place[which]
        at, count, flat = self.at[entry], self.count[entry], self.flat
        unlike = self._unlike(entry, codes, begin, end)
        if len(unlike):  # another piece has their hash: encoded without the table
            texts_of = [joined[a:b] for a, b in zip(begin[unlike].tolist(), end[unlike].tolist(), strict=True)]
            own = {t: i for i, t in enumerate(dict.fromkeys(texts_of))}
            number, ids_of = self._ids(list(own))
            mine = np.array([own[t] for t in texts_of], np.int64)
            at[unlike], count[unlike] = (len(flat) + np.cumsum(number) - number)[mine], number[mine]
            flat = np.concatenate([flat, ids_of])
        total = np.cumsum(count)
        ids = flat[spans(at, count)].astype("<u4").tobytes()
        last = np.searchsorted(begin, np.cumsum(sizes))
        cut = (np.concatenate([[0], total])[last] * 4).tolist()
        return [ids[a:b] for a, b in zip([0, *cut], cut, strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(texts)
        marked = [i for i, t in enumerate(texts) if self._special and self._special.search(t)]
        whole = sorted(set(range(len(texts))).difference(marked))
        for i, ids in zip(whole, self._encode([texts[i] for i in whole]) if whole else [], strict=True):
            out[i] = ids
        for i in marked:
            begin, ids = 0, []
            for m in self._special.finditer(texts[i]):
                ids += [*self._encode([texts[i][begin : m.start()]]), np.array([self.special[m[0]]], "<u4").tobytes()]
                begin = m.end()
            out[i] = b"".join([*ids, *self._encode([texts[i][begin:]])])
        return out

    def decode(self, ids: bytes) -> str:
        """Tokens joined by a space, as the library does for a file without a decoder."""
        return " ".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_OPEN: dict[str, WordBpe] = {}


def opened(path: str) -> WordBpe:
    """One tokenizer per worker process."""
    if path not in _OPEN:
        _OPEN[path] = WordBpe(path)
    return _OPEN[path]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``ids``, the little-endian unsigned 32-bit ids of the whole text."""
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(path)
        for rows, texts in text_slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(bpe.encode(texts), pa.binary())], schema=schema)

    return whole_text(docs).mapInArrow(run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded``, the text that the ids decode to."""
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(path)
        for rows in batches:
            step = max(1, 8_000_000 * rows.num_rows // max(1, rows.nbytes))
            for k in range(0, rows.num_rows, step):
                part = rows.slice(k, step)
                ids = part.column("ids")
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, pa.array([bpe.decode(x or b"") for x in ids.to_pylist()], pa.string())], schema=schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded string")


def encode_and_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded``: both steps in one worker, which holds the tokenizer once."""
    path = path or default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = opened(path)
        for rows, texts in text_slices(batches, budget=700_000):
            ids = bpe.encode(texts)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], schema=schema)

    return whole_text(docs).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
