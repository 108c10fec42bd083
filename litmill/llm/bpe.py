"""Exact byte-pair encoding and decoding with a given vocabulary file.

The encoder does not replay merges.  An Aho-Corasick automaton over all tokens
gives the longest token at every position of a piece.  Each one is checked
against the token before it in a table of compatible pairs; where a pair does
not fit, the next shorter token is tried, or the encoder steps back.  Two tokens
are compatible if no merge would ever have crossed the border between them; a
sequence whose neighbours are all compatible is exactly what merging gives.
Positions that led nowhere are marked, so time is linear.

Texts are cut into pieces many at a time, as arrays of code points; each
distinct piece of a section is encoded once.  Decoding gathers token bytes from
one blob by an offset table.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import kernel

#: Encoded pieces, and pairs of tokens, that a Python worker remembers (about 200 and 100 bytes each).
CACHE, PAIRS = 400_000, 1 << 18
#: Texts whose results are handed on together.
ROWS = 1024
#: Letters of texts that are cut into pieces at a time.
SECTION = 1 << 20

_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_SPACE = regex.compile(r"\p{White_Space}")
#: What a code point is to the cutter of pieces; ODD ones are left to the tokenizer library.
NEW, LETTER, DIGIT, MARK, GAP, ODD = range(6)


#: Endings that a quote takes with it, of one and of two letters.
ENDINGS = {1: [ord(c) for c in "stmd"], 2: [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]}


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class Codec:
    """Encoder and decoder of one tokenizer file with word-end BPE over bytes."""

    def __init__(self, source: str):
        spec = json.loads(source)
        self.library = Tokenizer.from_str(source)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        self.alphabet = _byte_alphabet()
        # A symbol is one character: a byte, or a byte that ends a word.
        self.as_symbol = {}
        for b, c in enumerate(self.alphabet):
            self.as_symbol[c] = chr(b)
            self.as_symbol[c + self.end] = chr(256 + b)
        self.ids = {}
        spelled = {}
        for token, i in vocab.items():
            word = token.endswith(self.end) and token != self.end
            body = token[: -len(self.end)] if word else token
            if not all(c in self.as_symbol for c in body):
                continue
            symbols = "".join(self.as_symbol[c] for c in body)
            if word:
                symbols = symbols[:-1] + chr(ord(symbols[-1]) + 256)
            self.ids[symbols] = i
            spelled[token] = i
        self.merge, self.made = {}, {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = spelled[left], spelled[right]
            self.merge[a, b] = rank
            self.made[spelled[left + right]] = (rank, a, b)
        self.symbols = {i: s for s, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.ids.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.shorter = {i: self._below(s) for s, i in self.ids.items()}
        self.length = {i: len(s) for i, s in self.symbols.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        texts = {i: t.encode() for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        size = max(texts) + 1
        # Decoding puts a space between tokens, as there is no decoder in the file: each entry ends with one.
        parts = [texts.get(i, b"") + b" " for i in range(size)]
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.offset = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.kind = np.zeros(0x110000, np.uint8)
        self.lower = np.arange(0x110000, dtype=np.uint32)
        self.plain: set[str] = set()

    def _below(self, s: str) -> int | None:
        for k in range(len(s) - 1, 0, -1):
            if s[:k] in self.ids:
                return self.ids[s[:k]]
        return None

    def _spine(self, token: int, side: int):
        """Tokens at one border of a token as it is taken apart, each with the rank of the merge that takes it in."""
        until = float("inf")
        while True:
            yield token, until
            if token not in self.made:
                return
            until, token = self.made[token][0], self.made[token][side]

    def _compatible(self, a: int, b: int) -> bool:
        """No merge of a token that ends a and one that starts b comes before both are taken in; of equal ranks the left goes first."""
        right = list(self._spine(b, 1))
        for x, x_until in self._spine(a, 2):
            for y, y_until in right:
                rank = self.merge.get((x, y))
                if rank is not None and rank < x_until and rank <= y_until:
                    return False
        return True

    def fits(self, a: int, b: int) -> bool:
        """The table of compatible pairs, filled as pairs are met."""
        found = self.pairs.get((a, b))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[a, b] = self._compatible(a, b)
        return found

    def encode_piece(self, raw: bytes) -> array:
        """Ids of one pre-token."""
        s = raw.decode("latin-1")
        if self.end:
            s = s[:-1] + chr(256 + raw[-1])
        whole = self.ids.get(s)
        if whole is not None:  # a token of the vocabulary that merging reaches is its own encoding
            return array("I", (whole,))
        greedy = [token for _, token in self.automaton.iter_long(s)]
        before = greedy[0]
        for k in range(1, len(greedy)):
            token = greedy[k]
            if not (self.pairs.get((before, token)) or self.fits(before, token)):
                return self._backtracked(s, greedy[:k])
            before = token
        return array("I", greedy)

    def _backtracked(self, s: str, begun: list[int]) -> array:
        """The encoding of s; the longest tokens fit as far as they are given in begun."""
        size, shorter, pairs, fits, n = self.length, self.shorter, self.pairs, self.fits, len(s)
        longest = array("I", bytes(4 * n))  # matches come by their end, so the longest of a start comes last
        for end, token in self.automaton.iter(s):
            longest[end + 1 - size[token]] = token
        out, dead = array("I", begun), bytearray(n + 1)
        at = sum([size[t] for t in begun])
        before, token = begun[-1], longest[at]
        while True:
            while token is not None and (dead[at + size[token]] or (out and not (pairs.get((before, token)) or fits(before, token)))):
                token = shorter[token]
            if token is None:
                dead[at] = 1
                token = out.pop()
                before = out[-1] if out else -1
                at -= size[token]
                token = shorter[token]
                continue
            out.append(token)
            before = token
            at += size[token]
            if at == n:
                return out
            token = longest[at]

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece; those met lately are remembered, in two generations of which the elder is dropped."""
        found = self.young.get(piece)
        if found is None:
            found = self.old.get(piece)
            if found is None:
                found = self.encode_piece(piece.encode()).tobytes()
            if len(self.young) >= CACHE // 2:
                self.old, self.young = self.young, {}
            self.young[piece] = found
        return found

    def _learn(self, code: int) -> None:
        """Ask the tokenizer library, whose Unicode tables decide, what a character is; ODD unless it is plain in every respect."""
        c = chr(code)
        self.kind[code] = ODD
        # Marks, and the Hangul vowels and finals, may be moved or composed with what stands before them.
        if 0xD800 <= code < 0xE000 or 0x1160 <= code < 0x1200 or unicodedata.category(c)[0] == "M" or unicodedata.category(c) == "Cn" or unicodedata.combining(c):
            return
        if _SPACE.match(c):
            if [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(f"a{c}b"))] == ["a", "b"]:
                self.kind[code] = GAP
                self.plain.add(c)
            return
        low = c.lower()
        probe = f"a{low}!{low}1{low}{low}"
        if len(low) != 1 or self.library.normalizer.normalize_str(c) != low or self.library.normalizer.normalize_str(f"a{c}") != "a" + low:
            return
        cut = [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(probe)]
        for kind, want in ((LETTER, [f"a{low}", "!", low, "1", low + low]), (DIGIT, ["a", low, "!", low, "1", low, low]), (MARK, ["a", f"{low}!{low}", "1", low + low])):
            if cut == ["".join(self.alphabet[b] for b in p.encode()) for p in want]:
                self.kind[code], self.lower[code] = kind, ord(low)
                self.plain.add(c)

    def pieces_of(self, texts: list[str]) -> tuple[pa.StringArray, np.ndarray] | None:
        """The pieces of all texts, and how many each has; None if an odd character is among them."""
        line = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = self.kind[line]
        if not kind.all():
            for code in np.unique(line[kind == NEW]).tolist():
                self._learn(code)
            kind = self.kind[line]
        if (kind == ODD).any():
            return None
        low = self.lower[line]
        start = np.empty(len(line), bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == DIGIT
        start &= kind != GAP
        # A quote that starts a piece takes one of the short endings with it.
        quote = np.flatnonzero((low == 0x27) & start)
        if len(quote):
            after = low[np.minimum(quote[:, None] + np.arange(1, 3), len(low) - 1)]
            one = np.isin(after[:, 0], ENDINGS[1])
            two = np.zeros(len(quote), bool)
            for a, b in ENDINGS[2]:
                two |= (after[:, 0] == a) & (after[:, 1] == b)
            for took, size in ((one, 2), (two & ~one, 3)):
                start[quote[took] + 1] = False
                rest = quote[took] + size
                start[rest] = kind[rest] != GAP
        solid = kind != GAP
        ends = np.cumsum([len(t) + 1 for t in texts])
        counts = np.diff(np.cumsum(start)[ends - 1], prepend=0)
        solid_low = low[solid]
        width = 1 + (solid_low > 0x7F) + (solid_low > 0x7FF) + (solid_low > 0xFFFF)
        at = np.concatenate(([0], np.cumsum(width)))
        offsets = np.append(at[np.flatnonzero(start[solid])], at[-1]).astype(np.int32)
        data = solid_low.tobytes().decode("utf-32-le").encode()
        return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data)), counts

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        found = None if any("<|" in t for t in texts) else self.pieces_of(texts)
        if found is None:
            if len(texts) > 1:
                halves = [self.encode_all(half) for half in (texts[: len(texts) // 2], texts[len(texts) // 2 :])]
                return tuple(map(np.concatenate, zip(*halves, strict=True)))
            ids = np.frombuffer(self.encode(texts[0]), "<u4")
            return ids, np.array([len(ids)])
        pieces, counts = found
        if not len(pieces):
            return np.zeros(0, "<u4"), counts
        named = pieces.dictionary_encode()
        young, piece = self.young, self._piece
        raw = [young.get(p) or piece(p) for p in named.dictionary.to_pylist()]
        size = np.array([len(r) for r in raw]) // 4
        ids, sizes = gathered(np.frombuffer(b"".join(raw), "<u4"), np.concatenate(([0], np.cumsum(size))), named.indices.to_numpy())
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(counts)]
        return ids, np.diff(ends, prepend=0)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers, chunk by chunk."""
        if self.special_split is not None and "<|" in text:
            parts = [int(self.special[p]).to_bytes(4, "little") if p in self.special else self._plain(p) for p in self.special_split.split(text)]
            return b"".join(parts)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        """What a chunk is made of never depends on what stands beyond white space; the library cuts chunks with odd characters."""
        chunks = [c for c in _SPACE.split(text) if c]
        names = list(dict.fromkeys(chunks))
        for c in set(text) - self.plain:
            if not self.kind[ord(c)]:
                self._learn(ord(c))
        known, plain = {}, []
        for chunk in names:
            if self.plain.issuperset(chunk):
                plain.append(chunk)
                continue
            found = []
            for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk)):
                found.append(self._piece(bytes(ord(self.as_symbol[c]) for c in piece).decode()))
            known[chunk] = b"".join(found)
        if plain:
            pieces, counts = self.pieces_of(plain)
            pieces, at = pieces.to_pylist(), 0
            for chunk, n in zip(plain, counts.tolist(), strict=True):
                known[chunk] = b"".join(map(self._piece, pieces[at : at + n]))
                at += n
        return b"".join([known[c] for c in chunks])

    def forget(self) -> None:
        """Drop what was remembered; the worker may do other work next."""
        self.young.clear()
        self.old.clear()
        self.pairs.clear()

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the texts of ids, each with the space that follows it, and the size of each."""
        return gathered(self.blob, self.offset, ids)


def gathered(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of flat that an offset table names, one after the other, and the size of each."""
    start = offsets[which]
    size = offsets[which + 1] - start
    end = np.cumsum(size)
    if not len(end):
        return flat[:0], size
    return flat[np.arange(end[-1]) + np.repeat(start - (end - size), size)], size


def sections(texts: list[str]):
    """(row, part, last) of texts, long ones cut at white space, in lists of about SECTION letters."""
    held, letters = [], 0
    for row, text in enumerate(texts):
        at = 0
        while True:
            to = len(text)
            if to - at > SECTION:
                gap = _SPACE.search(text, at + SECTION)
                to = gap.start() if gap else to
            held.append((row, text[at:to], to == len(text)))
            letters += to - at + 1
            if letters >= SECTION:
                yield held
                held, letters = [], 0
            at = to
            if at == len(text):
                break
    if held:
        yield held


@functools.lru_cache(maxsize=2)
def codec(source: str) -> Codec:
    return Codec(source)


def encoded(docs: DataFrame, vocabulary: str, ids_column: str | None = None) -> DataFrame:
    """docs' doc_id, with n_tokens, ids_sha256, decoded_sha256 of each whole text, a row per row.

    vocabulary is the text of a tokenizer file (BPE over bytes with word ends,
    no decoder).  A null text counts as empty: no tokens.  Repeated rows and
    null doc_ids get a row each, an empty table gives none; other columns are
    not looked at.  Memory is bounded by the longest word, not the longest
    text.  With ids_column the ids themselves follow in a column of that name,
    as array<int>.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(vocabulary)  # one file, of fixed size

    def run(batches):
        c = codec(shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                yield rows(c, whole.slice(lo, ROWS))
        c.forget()

    def rows(c: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        n = np.zeros(batch.num_rows, np.int64)
        ids_sha, text_sha, all_ids = [], [], []
        of_ids, of_text, kept = hashlib.sha256(), hashlib.sha256(), []
        for section in sections([t or "" for t in batch.column("text").to_pylist()]):
            ids, counts = c.encode_all([part for _, part, _ in section])
            text, sizes = c.decode(ids)
            ends = np.cumsum(counts)
            text_ends = np.concatenate(([0], np.cumsum(sizes)))[ends]
            begun = text_begun = 0
            for (row, _, last), end, text_end in zip(section, ends.tolist(), text_ends.tolist(), strict=True):
                if end > begun:
                    if n[row]:
                        of_text.update(b" ")
                    n[row] += end - begun
                    of_ids.update(ids[begun:end])
                    of_text.update(text[text_begun : text_end - 1])
                    if ids_column:
                        kept.append(ids[begun:end].astype(np.int32))
                if last:
                    ids_sha.append(of_ids.hexdigest())
                    text_sha.append(of_text.hexdigest())
                    all_ids.append(np.concatenate(kept) if kept else np.zeros(0, np.int32))
                    of_ids, of_text, kept = hashlib.sha256(), hashlib.sha256(), []
                begun, text_begun = end, text_end
        columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n), "ids_sha256": ids_sha, "decoded_sha256": text_sha}
        if ids_column:
            columns[ids_column] = pa.array(all_ids, pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(columns)

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(kernel.tidy(run), _DDL + (f", {ids_column} array<int>" if ids_column else ""))


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
