"""BPE encoding and decoding: speculate and verify.

A word's greedy longest-match tokens are proposed in one scan over all new words of a batch. A sequence of tokens is what
the merges would give exactly if no merge ever crosses the border of two neighbours, and whether one does is a matter of
the two alone; so every distinct adjacent pair is tested, all pairs at once, against the merge table along the right edge
of the left token and the left edge of the right one. Only words with a failing pair go through the merges one by one.

The vocabulary file is that of the `tokenizers` library (BPE with word ends, NFC, lower case, white space dropped); its
path is a parameter and must exist on the executors.

Defined results: a null text counts as empty and gives no tokens; texts are encoded whole, whatever their length; strings of
special tokens inside a text become those tokens, as in the library with its defaults; rows that share a doc_id, and repeated
rows, are each returned; other columns, of whatever name, play no part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landfold.llm.common import table, text_of

VOCABULARY = "word_bpe_49k.json"
#: Stands for the word end; no byte of a word, which are kept as the characters 0 to 255, is this character.
END = "Ā"
#: White space of str.split() that the library's \s doesn't know; texts with it are split by a pattern.
ODD_BLANKS = ("\x1c", "\x1d", "\x1e", "\x1f")
#: What a worker remembers of words that it has seen: up to twice so many, the older half forgotten at once.
CACHE_WORDS = 150_000
#: Letters beyond which a word is merged by itself, with a heap.
LONG_WORD = 512
NEVER = np.int64(1 << 62)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, str]:
    """The printable character of each byte in byte-level vocabularies -> the character with the byte's number."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): chr(b) for b in plain} | {chr(256 + k): chr(b) for k, b in enumerate(other)}


class Memory:
    """Values by key in two generations: a full one becomes the older one, and what is asked for again moves up."""

    def __init__(self, size: int = CACHE_WORDS):
        self.size, self.now, self.before = size, {}, {}

    def missing(self, keys: set) -> set:
        """Those of keys that aren't known; all others are in `now` after this."""
        if len(self.now) > self.size:
            self.before, self.now = self.now, {}
        now, before, missing = self.now, self.before, set()
        for k in [k for k in keys if k not in now]:  # a difference with keys() would go through all that is known
            if k in before:
                now[k] = before[k]
            else:
                missing.add(k)
        return missing


def word_splitter() -> Callable[[str], list[str]]:
    """A piece without white space to its words, as the vocabulary's normaliser and splitter leave them."""
    import regex

    words_of = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall

    def split(piece: str) -> list[str]:
        if piece.isascii():  # most pieces: a word, perhaps with one sign after it
            if piece.isalpha():
                return [piece.lower()]
            if piece[:-1].isalpha() and not piece[-1].isdigit():
                return [piece[:-1].lower(), piece[-1]]
        else:
            if not unicodedata.is_normalized("NFC", piece):
                piece = unicodedata.normalize("NFC", piece)
            # lower() would write a final sigma by its place; the library lowers each character alone
            piece = piece.replace("Σ", "σ")
        return words_of(piece.lower())

    return split


class Codec:
    """One vocabulary. encode_chunks() takes pieces of text without white space."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        suffix = spec["model"]["end_of_word_suffix"]
        letters = _byte_letters()

        def plain(token: str) -> str:
            ends = token.endswith(suffix)
            return "".join(letters[c] for c in (token[: -len(suffix)] if ends else token)) + (END if ends else "")

        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.size = size
        self.width = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.written = [b""] * size  # a token as decode() writes it
        for t, i in [*vocab.items(), *self.special.items()]:
            self.written[i] = t.encode()
        self.by_text = {plain(t): i for t, i in vocab.items()}
        self.rank = np.full(size, -1, np.int64)  # of the merge that makes a token; -1: none
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        twice = set()
        for r, (a, b) in enumerate(merges):
            a, b = self.by_text[plain(a)], self.by_text[plain(b)]
            made = self.by_text[self.text_of(a, vocab, plain) + self.text_of(b, vocab, plain)]
            self.merges[a, b] = (r, made)
            if self.rank[made] >= 0:
                twice.add(made)
            else:
                self.rank[made], self.left[made], self.right[made] = r, a, b
        keys = np.array([a * size + b for a, b in self.merges], np.int64)
        ranks = np.array([r for r, _ in self.merges.values()], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], ranks[order]
        self.made = np.array([m for _, m in sorted(self.merges.values())], np.int64)
        self.letter = np.array([self.by_text[chr(b)] for b in range(256)], np.int64)
        self.last_letter = np.array([self.by_text[chr(b) + END] for b in range(256)], np.int64)
        made = np.flatnonzero(self.rank >= 0)
        #: The pair test needs a token to be made later than its parts, and in one way only.
        self.testable = not twice and bool((self.rank[self.left[made]] < self.rank[made]).all() and (self.rank[self.right[made]] < self.rank[made]).all())
        reached = np.ones(size, bool)
        if self.testable:
            reached[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
            for t in made[np.argsort(self.rank[made])]:
                reached[t] &= reached[self.left[t]] and reached[self.right[t]]
        self.known_pairs, self.pair_fits = np.zeros(0, np.int64), np.zeros(0, bool)
        self.finder = ahocorasick.Automaton()
        for t, i in self.by_text.items():
            if reached[i]:
                self.finder.add_word(t, i)
        self.finder.make_automaton()
        self.words_of = word_splitter()
        self.blanks = regex.compile(r"\s+").split
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words, self.chunks = Memory(), Memory()

    def text_of(self, i: int, vocab: dict, plain: Callable) -> str:
        if not hasattr(self, "_texts"):
            self._texts = {n: plain(t) for t, n in vocab.items()}
        return self._texts[i]

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NEVER)

    def compatible(self, left: np.ndarray, right: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the border of left and right (before rank `until`).

        A part x at the right edge of left is there until the merge of the part around it, likewise y in right. The merge
        of x and y crosses if its rank comes before both; of two equal ranks the one further left goes first.
        """
        fits = np.ones(len(left), bool)
        limit = np.full(len(left), NEVER) if until is None else until
        x, x_until, rows = left.copy(), limit.copy(), np.arange(len(left))
        while len(rows):
            y, y_until, own, xs, xu = right[rows], limit[rows], rows, x, x_until
            while len(own):
                rank = self.merge_rank(xs, y)
                fits[own[(rank < xu) & (rank <= y_until) & (rank < limit[own])]] = False
                go = self.left[y] >= 0
                own, y_until, xs, xu, y = own[go], self.rank[y[go]], xs[go], xu[go], self.left[y[go]]
            go = (self.right[x] >= 0) & fits[rows]
            rows, x_until, x = rows[go], self.rank[x[go]], self.right[x[go]]
        return fits

    def pairs_fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """compatible(), remembered by pair."""
        keys, back = np.unique(left * self.size + right, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known_pairs, keys), max(0, len(self.known_pairs) - 1))
        known = self.known_pairs[at] == keys if len(self.known_pairs) else np.zeros(len(keys), bool)
        fits = np.zeros(len(keys), bool)
        if known.any():
            fits[known] = self.pair_fits[at[known]]
        new = keys[~known]
        if len(new):
            fits[~known] = found = self.compatible(new // self.size, new % self.size)
            if len(self.known_pairs) < 4_000_000:
                both = np.concatenate([self.known_pairs, new])
                order = np.argsort(both, kind="stable")
                self.known_pairs, self.pair_fits = both[order], np.concatenate([self.pair_fits, found])[order]
        return fits[back]

    def merged(self, words: list[str]) -> list[np.ndarray]:
        """The exact merges of words (bytes as characters, END last): in each word the lowest rank first, of equals the
        leftmost. Words of like length are merged side by side, a step of each at a time."""
        out: list[np.ndarray] = [np.zeros(0, self.width)] * len(words)
        order = sorted(range(len(words)), key=lambda k: len(words[k]))
        while order and len(words[order[-1]]) > LONG_WORD:  # steps side by side cost the square of a word's length
            k = order.pop()
            out[k] = self._merged_long(words[k])
        start = 0
        while start < len(order):
            stop, longest = start, len(words[order[start]]) + 3
            while stop < len(order) and stop - start < 4096 and len(words[order[stop]]) <= longest:
                stop += 1
            rows = order[start:stop]
            for k, ids in zip(rows, self._merged([words[k] for k in rows]), strict=True):
                out[k] = ids
            start = stop
        return out

    def _merged_long(self, word: str) -> np.ndarray:
        """The same for one word, by a linked list of its parts and a heap of their merges."""
        ids = self.letter[np.frombuffer(word[:-1].encode("latin-1"), np.uint8)].tolist()
        ids[-1] = int(self.last_letter[ord(word[-2])])
        n, found = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        pairs = ((found(pair), k) for k, pair in enumerate(zip(ids, ids[1:], strict=False)))
        heap = [(hit[0], k, ids[k], ids[k + 1]) for hit, k in pairs if hit is not None]
        heapify(heap)
        while heap:
            _, at, a, b = heappop(heap)
            right = after[at]
            if right < 0 or ids[at] != a or ids[right] != b:
                continue  # one of the two has been merged since
            ids[at], ids[right] = found((a, b))[1], -1
            after[at] = after[right]
            if after[right] >= 0:
                before[after[right]] = at
            for left in (before[at], at):
                if left >= 0 and after[left] >= 0 and (hit := found((ids[left], ids[after[left]]))) is not None:
                    heappush(heap, (hit[0], left, ids[left], ids[after[left]]))
        whole = np.array(ids)
        return whole[whole >= 0].astype(self.width)

    def _merged(self, words: list[str]) -> list[np.ndarray]:
        sizes = np.array([len(w) - 1 for w in words])
        width = int(sizes.max()) + 1
        column = np.arange(width)
        ids = np.full((len(words), width), -1, np.int64)
        ids[column < sizes[:, None]] = self.letter[np.frombuffer("".join([w[:-1] for w in words]).encode("latin-1"), np.uint8)]
        last = np.array([ord(w[-2]) for w in words])
        ids[np.arange(len(words)), sizes - 1] = self.last_letter[last]
        ranks = np.where((ids[:, :-1] >= 0) & (ids[:, 1:] >= 0), self.merge_rank(ids[:, :-1], ids[:, 1:]), NEVER)
        out: list = [None] * len(words)
        own = np.arange(len(words))
        while True:
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(own)), at]
            for k in np.flatnonzero(best == NEVER).tolist():
                out[own[k]] = ids[k][ids[k] >= 0].astype(self.width)
            go = best < NEVER
            if not go.any():
                return out
            own, ids, ranks, at, best = own[go], ids[go], ranks[go], at[go], best[go]
            rows = np.arange(len(own))
            ids[:, :-1] = np.where(column[:-1] <= at[:, None], ids[:, :-1], ids[:, 1:])
            ids[:, -1] = -1
            ids[rows, at] = self.made[best]
            ranks[:, :-1] = np.where(column[: width - 2] < at[:, None], ranks[:, :-1], ranks[:, 1:])
            ranks[:, -1] = NEVER
            for k in (at - 1, at):
                there = rows[(k >= 0) & (k < width - 1)]
                k = k[there]
                a, b = ids[there, k], ids[there, k + 1]
                ranks[there, k] = np.where(b >= 0, self.merge_rank(a, b), NEVER)

    def encode_words(self, words: list[str]) -> None:
        """Remembers the ids of distinct words."""
        plain = [w.encode().decode("latin-1") + END for w in words]
        found = list(self.finder.iter_long("".join(plain)))
        ends, ids = np.array(found, np.int64).reshape(-1, 2).T
        word_end = np.cumsum([len(w) for w in plain]) - 1
        stop = np.searchsorted(ends, word_end, side="right")  # each word's tokens end here
        of = np.repeat(np.arange(len(words)), np.diff(np.concatenate([[0], stop])))
        failing = ends[stop - 1] != word_end  # the last letter was taken without the word end
        inner = np.flatnonzero(of[:-1] == of[1:])
        if self.testable:
            failing[of[inner[~self.pairs_fit(ids[inner], ids[inner + 1])]]] = True
        else:
            failing[of[inner]] = True
        start = 0
        ids = ids.astype(self.width)
        for word, end in zip(words, stop.tolist(), strict=True):
            self.words.now[word] = ids[start:end].tobytes()
            start = end
        again = np.flatnonzero(failing).tolist()
        for k, exact in zip(again, self.merged([plain[k] for k in again]), strict=True):
            self.words.now[words[k]] = exact.tobytes()

    def encode_chunks(self, chunks: set[str]) -> None:
        """Remembers the ids of new chunks."""
        lists = {c: self.words_of(c) for c in chunks}
        new = list(self.words.missing({w for ws in lists.values() for w in ws}))
        if new:
            self.encode_words(new)
        for c, ws in lists.items():
            self.chunks.now[c] = b"".join([self.words.now[w] for w in ws])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as bytes of self.width."""
        split = []
        for text in texts:
            pieces: list[str | int] = [text]
            if self.specials and any(s in text for s in self.special):
                pieces, at = [], 0
                for m in self.specials.finditer(text):
                    pieces += [text[at : m.start()], self.special[m[0]]]
                    at = m.end()
                pieces.append(text[at:])
            split.append([p if isinstance(p, int) else [c for c in self.blanks(p) if c] if any(b in p for b in ODD_BLANKS) else p.split() for p in pieces])
        new = self.chunks.missing(set().union(*(p for pieces in split for p in pieces if not isinstance(p, int))))
        if new:
            self.encode_chunks(new)
        look = self.chunks.now.__getitem__
        return [b"".join([self.width.type(p).tobytes() if isinstance(p, int) else b"".join(map(look, p)) for p in pieces]) for pieces in split]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of what the library's decode(ids, skip_special_tokens=False) gives: this vocabulary has no decoder, so
        tokens are written as they stand, a space between."""
        return b" ".join(map(self.written.__getitem__, ids.tolist()))


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One for each worker process and path."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """A batch in parts of a few rows, with the texts as strings."""
    for k in range(0, batch.num_rows, rows):
        part = batch.slice(k, rows)
        yield part, part.column(column).to_pylist()


def encode(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array of int)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for part, texts in slices(batch):
                ids = [np.frombuffer(x, own.width) for x in own.encode_batch(texts)]
                columns = [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(own.decode(x)).hexdigest() for x in ids], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), vocabulary_path(), with_ids=False)


QUERIES: dict[str, Callable] = {"op7_bpe": op7_bpe}
ORACLE_SQL: dict[str, str] = {}
