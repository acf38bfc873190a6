"""BPE encoding and decoding (operator 1).

A word's adjacent pairs are the leaves of a segment tree whose nodes keep the smallest (rank, position).
The root therefore names the leftmost pair of the lowest rank; merging it changes at most three leaves,
each put right on its way up in logarithmic time, until the root says that nothing can be merged.

Words of up to 64 symbols are merged many at a time, one tree per row of a matrix; longer words use the
same tree on plain lists. The tokenizer file is read on the driver and broadcast (its size is checked).
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Sequence
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from procurelake.llm.shared import append_columns, text_or_empty
from procurelake.llm.words import KNOWN_WORDS

NONE = np.int64(1) << np.int64(62)
#: No pair, in the trees of matrices: codes are rank * width + place there, so merges of up to 2^25 fit.
NO_PAIR = np.int32(2**31 - 1)
WIDEST = 64  # symbols of the words that are merged in matrices
MAX_TOKENIZER_BYTES = 16 << 20  # what may be broadcast

#: Ranges of code points that are letters or numbers only since Unicode 17, which the tokenizer
#: library's tables (Unicode 16) do not have yet, and upper-case letters of Unicode 16 and 17 with their lower case,
#: which Python's tables lack.
LATER = (
    "558-558 58B-58C 88F-88F C5C-C5C CDC-CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4 A7DD-A7DD A7E2-A7E2 A7F1-A7F1 AB6C-AB6D"
    " 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A 11DB0-11DDB 11DE0-11DE9 11DF1-11DF1 1246F-1246F 12475-1247F 12550-12686"
    " 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168-1B168"
    " 1D6A6-1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF"
    " 2B73A-2B73F 2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5}
NEW_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
LEAST_NEW = min(NEW_LOWER)


#: The split pattern of the tokenizer (shortened forms, runs of letters, single numbers, runs of others),
#: with white space as Unicode defines it.
SHORTENED = "'s|'t|'re|'ve|'m|'ll|'d"
SPACE, LETTER, NUMBER, OTHER = range(4)


def kind_patterns() -> list[str]:
    """Character classes by kind, with the letters and numbers that the library knows."""
    later = "[" + "".join("-".join(rf"\U{int(c, 16):08X}" for c in r.split("-")) for r in LATER.split()) + "]"
    letter, number = rf"[\p{{L}}--{later}]", rf"[\p{{N}}--{later}]"
    return [r"\p{White_Space}", letter, number, rf"[^\p{{White_Space}}{letter}{number}]"]


OTHER_SPACE = regex.compile(r"[\p{White_Space}--\x20]", regex.V1)


def byte_symbols() -> list[str]:
    """The printable character for each byte: visible Latin-1 characters stand for themselves, the others follow from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in visible)
    out = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [out[b] for b in range(256)]


class PairTree:
    """Segment tree over one word's adjacent pairs, on plain lists; for words of any length."""

    def __init__(self, codes: Sequence[int]):
        self.size = 1 << max(1, (len(codes) - 1).bit_length())
        none = int(NONE)
        self.nodes = [none] * self.size + list(codes) + [none] * (self.size - len(codes))
        for i in range(self.size - 1, 0, -1):
            self.nodes[i] = min(self.nodes[2 * i], self.nodes[2 * i + 1])

    def root(self) -> int:
        return self.nodes[1]

    def put(self, leaf: int, code: int) -> None:
        i, nodes = leaf + self.size, self.nodes
        nodes[i] = code
        while i > 1:
            i >>= 1
            low = min(nodes[2 * i], nodes[2 * i + 1])
            if nodes[i] == low:
                break
            nodes[i] = low


class WordBpe:
    """A tokenizer file's vocabulary and merges, with a bounded table of encoded words."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        vocab: dict[str, int] = model["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        suffix = model["model"].get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.tokens: dict[int, str] = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.top = max(self.tokens) + 1
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.top + right
        order = np.argsort(keys, kind="stable")
        # the last entry is never met: every look-up ends at an entry
        self.keys, self.ranks = np.append(keys[order], NONE), np.append(order.astype(np.int64), NONE)
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        patterns = kind_patterns()
        self.kinds, self.patterns = np.full(0x110000, -1, np.int8), [regex.compile(k, regex.V1) for k in patterns]
        self.pieces = regex.compile(f"{SHORTENED}|{patterns[LETTER]}+|{patterns[NUMBER]}|{patterns[OTHER]}+", regex.V1)
        self.shortened = re.compile(SHORTENED)
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, NONE where there is no such merge."""
        key = left * self.top + right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys.take(at) == key, self.ranks.take(at), NONE)

    def merge_long(self, symbols: list[int]) -> list[int]:
        n = len(symbols)
        ranks = self.rank(np.array(symbols[:-1], np.int64), np.array(symbols[1:], np.int64))
        codes = np.where(ranks < NONE, ranks * n + np.arange(n - 1), NONE).tolist()
        by_pair = self.pairs()
        tree, none = PairTree(codes), int(NONE)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)

        def code(i: int, j: int) -> int:
            r = by_pair.get(symbols[i] * self.top + symbols[j])
            return none if r is None else r * n + i

        while (root := tree.root()) < none:
            rank, i = divmod(root, n)
            j = after[i]
            symbols[i], gone[j] = int(self.merged[rank]), 1
            k = after[i] = after[j]
            if j < n - 1:
                tree.put(j, none)
            if k < n:
                before[k] = i
                tree.put(i, code(i, k))
            else:
                tree.put(i, none)
            if (p := before[i]) >= 0:
                tree.put(p, code(p, i))
        return [s for s, dead in zip(symbols, gone, strict=True) if not dead]

    def pairs(self) -> dict[int, int]:
        if not hasattr(self, "_pairs"):
            self._pairs = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        return self._pairs

    def merge_block(self, sym: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the words in the rows of ``sym``, whose width is a power of two; gives all ids in row order and the number in each row."""
        w, m = sym.shape
        shift, place = m.bit_length() - 1, np.arange(m)
        trees = np.full((w, 2 * m), NO_PAIR, np.int32)
        ranks = self.rank(sym[:, :-1], sym[:, 1:])
        real = (place[None, :-1] + 1 < length[:, None]) & (ranks < NONE)
        trees[:, m : 2 * m - 1] = np.where(real, ranks << shift | place[:-1], NO_PAIR)
        for size in (1 << i for i in reversed(range(shift))):
            np.minimum(trees[:, 2 * size : 4 * size : 2], trees[:, 2 * size + 1 : 4 * size : 2], out=trees[:, size : 2 * size])
        after, before = np.tile(place + 1, w), np.tile(place - 1, w)
        alive = place[None, :] < length[:, None]
        tree, symbols, living = trees.ravel(), sym.ravel(), alive.ravel()

        row, last = np.arange(w), length
        while True:
            root = tree.take(row * (2 * m) + 1)
            live = root < NO_PAIR
            if not live.all():
                row, root, last = row[live], root[live], last[live]
            if not len(row):
                break
            first, i = row << shift, (root & (m - 1)).astype(np.int64)
            j = after.take(first + i)
            symbols[first + i] = merged = self.merged.take(root >> shift)
            living[first + j] = False
            k = after[first + i] = after.take(first + j)
            on = k < last
            k = np.minimum(k, m - 1)
            before[(first + k)[on]] = i[on]
            # three leaves change: the merged pair's right neighbour has none, the merged symbol and the one before it have new pairs
            p = before.take(first + i)
            back = np.flatnonzero(p >= 0)
            first_b, p = first.take(back), p.take(back)
            ranks = self.rank(np.concatenate([merged, symbols.take(first_b + p)]), np.concatenate([symbols.take(first + k), merged.take(back)]))
            real = ranks < NONE
            real[: len(on)] &= on
            leaf = np.concatenate([i, p])
            code = np.where(real, ranks << shift | leaf, NO_PAIR)
            base, node = 2 * np.concatenate([first, first, first_b]), np.concatenate([j, leaf]) + m
            tree[base + node] = np.concatenate([np.full(len(j), NO_PAIR), code])
            for _ in range(shift):
                node >>= 1
                two = base + 2 * node
                tree[base + node] = np.minimum(tree.take(two), tree.take(two + 1))
        return symbols[living], alive.sum(1)

    def kinds_of(self, points: np.ndarray) -> np.ndarray:
        """The kind of each code point; each is looked up once and kept."""
        kind = self.kinds[points]
        if (kind < 0).any():
            for c in np.unique(points[kind < 0]).tolist():
                self.kinds[c] = next(k for k, pattern in enumerate(self.patterns) if pattern.fullmatch(chr(c)))
            kind = self.kinds[points]
        return kind

    def cut(self, words: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(the words' bytes, the end of each piece in them, the word of each piece) of words without shortened forms."""
        points = np.frombuffer("\n".join(words).encode("utf-32-le"), "<u4")
        kind = self.kinds_of(points)
        gap = kind == SPACE
        first = np.flatnonzero(~gap & ((kind == NUMBER) | (np.diff(kind, prepend=np.int8(SPACE)) != 0)))
        width = np.where(gap, 0, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
        ends = np.cumsum(width)
        return ["".join(words).encode()], ends[np.append(first[1:], len(ends))[: len(first)] - 1], np.cumsum(gap)[first]

    def encode_words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of single distinct words (no white space, no special tokens) as little-endian unsigned 32-bit numbers."""
        odd = [w for w in words if "'" in w and self.shortened.search(w)]
        if odd:
            words = list(set(words).difference(odd))
        raw, ends, owner = self.cut(words)
        if odd:
            found = [(at, piece.encode()) for at, w in enumerate(odd, len(words)) for piece in self.pieces.findall(w)]
            words += odd
            raw += [piece for _, piece in found]
            ends = np.append(ends, len(raw[0]) + np.cumsum([len(piece) for _, piece in found]))
            owner = np.append(owner, [at for at, _ in found])
        flat, size = np.frombuffer(b"".join(raw), np.uint8), np.diff(ends, prepend=0)
        counts = np.ones(len(size), np.int64)
        done = [(mine := np.flatnonzero(size == 1), self.last[flat[ends[mine] - 1]])]
        floor = 1
        for width in (2, 4, 8, 16, 32, WIDEST):
            mine = np.flatnonzero((size > floor) & (size <= width))
            floor = width
            if len(mine):
                length = size[mine]
                inside = np.arange(width)[None, :] < length[:, None]
                at = np.where(inside, (ends[mine] - length)[:, None] + np.arange(width)[None, :], 0)
                sym = np.where(inside, self.inner[flat[at]], 0)
                sym[np.arange(len(mine)), length - 1] = self.last[flat[ends[mine] - 1]]
                out, counts[mine] = self.merge_block(sym, length)
                done.append((mine, out))
        for k in np.flatnonzero(size > WIDEST).tolist():
            symbols = self.inner[flat[ends[k] - size[k] : ends[k]]].tolist()
            symbols[-1] = int(self.last[flat[ends[k] - 1]])
            out = self.merge_long(symbols)
            counts[k] = len(out)
            done.append((np.array([k]), np.array(out)))
        stop = np.cumsum(counts)
        ids = np.empty(stop[-1] if len(stop) else 0, "<u4")
        for mine, out in done:
            n = counts[mine]
            ids[np.repeat(stop[mine] - np.cumsum(n), n) + np.arange(len(out))] = out
        cuts = [0, *(4 * stop[np.searchsorted(owner, np.arange(len(words)), "right") - 1]).tolist()]
        ids = ids.tobytes()
        return {w: ids[lo:hi] for w, lo, hi in zip(words, cuts, cuts[1:], strict=False)}

    def chunks(self, text: str) -> list[str]:
        """Normalise (composed form, plain spaces, lower case) and cut at the spaces; words never cross them."""
        if not text.isascii():
            text = OTHER_SPACE.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()
            if np.frombuffer(text.encode("utf-32-le"), "<u4").max(initial=0) >= LEAST_NEW:
                text = text.translate(NEW_LOWER)
            return text.split(" ")
        for c in "\t\n\v\f\r":
            if c in text:
                text = text.replace(c, " ")
        return text.lower().split(" ")

    def segments(self, text: str) -> list[list[str] | bytes]:
        """The text's words, and between them the ids of special tokens written out in it."""
        if not any(s in text for s in self.special):
            return [self.chunks(text)]
        parts = self.split_special.split(text)
        return [np.array([self.special[p]], "<u4").tobytes() if i % 2 else self.chunks(p) for i, p in enumerate(parts)]

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > KNOWN_WORDS // 2:
            self.known, self.older = {"": b""}, self.known  # words that come again are taken over
        cut = [self.segments(t) for t in texts]
        new: set[str] = set()
        for part in (p for parts in cut for p in parts if isinstance(p, list)):
            new.update(compress(part, map(not_, map(self.known.get, part))))
        new.discard("")  # known, but its ids are as empty as none
        again = new.intersection(self.older)
        self.known.update((w, self.older[w]) for w in again)
        todo = list(new.difference(again))
        for lo in range(0, len(todo), 20_000):
            self.known.update(self.encode_words(todo[lo : lo + 20_000]))
        get = self.known.__getitem__
        return [b"".join(p if isinstance(p, bytes) else b"".join(map(get, p)) for p in parts) for parts in cut]

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by spaces, special ones kept; ids that the vocabulary lacks are left out (the file names no decoder)."""
        table = self.tokens
        try:
            return " ".join(map(table.__getitem__, ids.tolist()))
        except KeyError:
            return " ".join(table[i] for i in ids.tolist() if i in table)


_LOADED: dict[int, WordBpe] = {}


def load(spec: str) -> WordBpe:
    """One tokenizer per worker and file."""
    key = hash(spec)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(spec)
    return _LOADED[key]


def tokenizer_broadcast(df: DataFrame, tokenizer: str):
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"a tokenizer file of {len(spec)} bytes is not broadcast; the bound is {MAX_TOKENIZER_BYTES}")
    return df.sparkSession.sparkContext.broadcast(spec)


def encode(df: DataFrame, text: str = "text", out: str = "ids", *, tokenizer: str, packed: bool = False, drop: Sequence[str] = ()) -> DataFrame:
    """Append the ids of each whole text (special tokens written in a text count, none are added).

    ``out`` is array<int>, or with ``packed`` binary: the ids as little-endian unsigned 32-bit numbers.
    A null or empty text has no ids. Rows, repeated or not, are encoded on their own and other columns pass
    through; a column already named ``out`` is replaced; an empty table stays empty. Texts of any length are
    encoded whole. No shuffle.
    """
    spec = tokenizer_broadcast(df, tokenizer)

    def make():
        bpe = load(spec.value)

        def compute(texts: pa.Array):
            encoded = bpe.encode_texts([t.as_py() or "" for t in texts])
            if packed:
                return [pa.array(encoded, pa.binary())]
            offsets = np.zeros(len(encoded) + 1, np.int32)
            np.cumsum([len(e) // 4 for e in encoded], out=offsets[1:])
            values = np.frombuffer(b"".join(encoded), "<u4").astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]

        return compute

    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    return append_columns(df, [text_or_empty(text)], [T.StructField(out, kind)], make, drop=drop)


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", *, tokenizer: str, drop: Sequence[str] = ()) -> DataFrame:
    """Append the decoded text of ``ids`` (array<int>, or binary as ``encode(packed=True)`` gives).

    Null or empty ids decode to the empty text; null entries and unknown ids are left out. Other columns pass
    through; a column already named ``out`` is replaced. No shuffle.
    """
    spec = tokenizer_broadcast(df, tokenizer)
    packed = isinstance(df.schema[ids].dataType, T.BinaryType)

    def make():
        bpe = load(spec.value)

        def compute(column: pa.Array):
            if packed:
                return [pa.array([bpe.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in column], pa.string())]
            return [pa.array([bpe.decode(np.array([i for i in x.as_py() or [] if i is not None], np.int64)) for x in column], pa.string())]

        return compute

    return append_columns(df, [ids], [T.StructField(out, T.StringType())], make, drop=drop)


def round_trip(df: DataFrame, text: str = "text", ids: str = "ids", decoded: str = "decoded", *, tokenizer: str, drop: Sequence[str] = ()) -> DataFrame:
    """Append the packed ids of each whole text and what they decode to, in one pass: as ``decode(encode(...))`` does, but with one Python worker a task.

    Null and empty texts have no ids and decode to the empty text; other columns pass through, those named
    ``ids`` or ``decoded`` are replaced; repeated rows are encoded each; an empty table stays empty. No shuffle.
    """
    spec = tokenizer_broadcast(df, tokenizer)

    def make():
        bpe = load(spec.value)

        def compute(texts: pa.Array):
            encoded = bpe.encode_texts([t.as_py() or "" for t in texts])
            return [pa.array(encoded, pa.binary()), pa.array((bpe.decode(np.frombuffer(e, "<u4")) for e in encoded), pa.string())]

        return compute

    return append_columns(df, [text_or_empty(text)], [T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())], make, drop=drop)


def op1_bpe(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Encode and decode every document; digests of both."""
    import public_tokenizers

    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = round_trip(docs, tokenizer=tokenizer, drop=["text"])
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
