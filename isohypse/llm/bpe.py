"""Byte-pair encoding by segment trees over adjacent pair ranks.

A word's tree has a leaf for each pair of neighbouring symbols, holding the pair's merge rank and
place; each inner node holds the least of its two children. So the root is the leftmost pair of
the lowest rank. A merge changes three leaves (the pair's own, its left neighbour's, and the
absorbed one), each a point update along one path to the root; a word is done when its root holds
no rank. Trees of equal size are kept as rows of one matrix, and all of a batch's words take
their next merge together. Words beyond the matrices' width take a tree of their own.

Texts are cut at ASCII white space; no rule of the tokenizer looks across it (its normalizer
makes each run of white space one blank, its splitter drops blanks), so a piece's ids don't depend
on its surroundings. The pieces are encoded once a batch, and the most recent ones are remembered.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import flat, hash_strings, views

NONE = np.int32(1 << 20)
#: Words of more symbols have a tree of their own.
WIDEST = 65


class PairRanks:
    """Rank of a pair of symbol ids: two hash tables, the second for what collides in the first."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        assert max(left.max(), right.max()) < 1 << 16, "symbol ids of more than 16 bits"
        key = self._key(left, right)
        shift, first = np.uint32(32 - 20), self._table(key, np.arange(len(key)), 0x9E3779B1)
        rest = np.delete(np.arange(len(key)), first[2])
        for factor in range(0x85EBCA6B, 0x85EBCA6B + 2000, 2):  # until no two of the rest collide
            second = self._table(key, rest, factor)
            if len(second[2]) == len(rest):
                break
        else:
            raise ValueError("no factor separates the pairs")
        self.shift, self.tables = shift, [(np.uint32(0x9E3779B1), *first[:2]), (np.uint32(factor), *second[:2])]

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint32) << np.uint32(16)) | (right.astype(np.uint32) & np.uint32(0xFFFF))

    @staticmethod
    def _table(key: np.ndarray, which: np.ndarray, factor: int):
        slot = (key[which] * np.uint32(factor)) >> np.uint32(12)
        _, first = np.unique(slot, return_index=True)
        keys, ranks = np.full(1 << 20, np.uint32(0xFFFFFFFF)), np.full(1 << 20, NONE)
        keys[slot[first]], ranks[slot[first]] = key[which[first]], which[first]
        return keys, ranks, which[first]

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where the pair has no rank or a symbol is negative."""
        key = self._key(left, right)
        (f, keys, ranks), (g, more_keys, more_ranks) = self.tables
        slot = (key * f) >> self.shift
        out = np.where(keys[slot] == key, ranks[slot], NONE)
        lost = out == NONE
        slot = (key[lost] * g) >> self.shift
        out[lost] = np.where(more_keys[slot] == key[lost], more_ranks[slot], NONE)
        out[(left < 0) | (right < 0)] = NONE
        return out


#: Bits of a pair's place in a word; with the rank above it, a tree's entry.
PLACE_BITS = 36


class SegmentTree:
    """Least (rank, place) over the pairs of one word; for words too long for the matrices."""

    def __init__(self, ranks: np.ndarray):
        self.size = 1 << max(1, int(len(ranks) - 1).bit_length())
        level = np.full(self.size, int(NONE) << PLACE_BITS)
        level[: len(ranks)] = (ranks.astype(np.int64) << PLACE_BITS) | np.arange(len(ranks))
        levels = [level]
        while len(level) > 1:
            level = np.minimum(level[0::2], level[1::2])
            levels.append(level)
        self.tree = [0, *np.concatenate(levels[::-1]).tolist()]

    def set(self, place: int, rank: int) -> None:
        tree, node = self.tree, self.size + place
        tree[node] = (rank << PLACE_BITS) | place
        node >>= 1
        while node:
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b
            node >>= 1

    def least(self) -> tuple[int, int]:
        return self.tree[1] >> PLACE_BITS, self.tree[1] & ((1 << PLACE_BITS) - 1)


class Tokenizer:
    """A byte-level BPE with word ends, read from the file of a public tokenizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for token, i in (*vocab.items(), *self.special.items()):
            self.tokens[i] = token
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int32)
        right = np.array([vocab[b] for _, b in pairs], np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.rank = PairRanks(left, right)
        signs = _byte_signs()
        self.inner = np.array([vocab[c] for c in signs], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in signs], np.int32)
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+|\n")
        self.marks = regex.compile("(" + "|".join(regex.escape(x) for x in self.special) + ")") if self.special else None

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and how many each has. Pieces hold no ASCII white space."""
        # a special token is no word: \0 and its number stand for it until the words are encoded
        words: list[str] = []
        owner: list[int] = []
        marked = {i: self.marks.split(x) for i, x in enumerate(pieces) if "<|" in x} if self.marks else {}
        marked = {i: x for i, x in marked.items() if len(x) > 1}
        if marked:
            for i, x in enumerate(pieces):
                for part in marked.get(i, (x,)):
                    found = [part] if part in self.special else self._words(part)
                    words += found
                    owner += [i] * len(found)
        else:
            found = self._words("\n".join(pieces), keep=True)
            ends = np.fromiter((x == "\n" for x in found), bool, len(found))
            owner = np.cumsum(ends)[~ends]
            words = [x for x in found if x != "\n"]
        distinct: dict[str, int] = {}
        code = np.fromiter((distinct.setdefault(x, len(distinct)) for x in words), np.int64, len(words))
        ids, counts = self.encode_words(list(distinct))
        starts = np.concatenate(([0], np.cumsum(counts)))
        size = counts[code] if len(code) else np.empty(0, np.int64)
        out = ids[_ranges(starts[code], size)] if len(code) else np.empty(0, np.int32)
        per = np.bincount(np.asarray(owner, np.int64), weights=size, minlength=len(pieces)).astype(np.int64) if len(code) else np.zeros(len(pieces), np.int64)
        return out, per

    def _words(self, text: str, keep: bool = False) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # each character by itself: no final sigma
        found = self.cut.findall(text.lower())
        return found if keep else [x for x in found if x != "\n"]

    def encode_words(self, words: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words in a row, and the number of each."""
        words = words if isinstance(words, pa.Array) else pa.array(words, pa.large_string())
        if not len(words):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        offsets, data = views(words)
        size = np.diff(offsets)
        symbols = self.inner[data]
        if len(data):
            symbols[offsets[1:][size > 0] - 1] = self.last[data[offsets[1:][size > 0] - 1]]
        for x, i in self.special.items():  # a token of its own, not to be merged
            for at in np.flatnonzero(pc.equal(words, x).to_numpy(zero_copy_only=False)):
                symbols[offsets[at]], size[at] = i, 1
        counts = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for top in (1, 2, 3, 5, 9, 17, 33, WIDEST):
            own = np.flatnonzero((size > low) & (size <= top))
            low = top
            step = max(512, (1 << 17) // top)  # a block of trees stays in the processor's cache
            for at in range(0, len(own), step):
                rows = own[at : at + step]
                block = np.full((len(rows), top), -1, np.int32)
                inside = np.arange(top)[None, :] < size[rows][:, None]
                block[inside] = symbols[_ranges(offsets[rows], size[rows])]
                if top > 1:
                    block = self._merge(block)
                kept = block >= 0
                counts[rows] = kept.sum(1)
                parts.append((rows, block[kept]))
        for i in np.flatnonzero(size > WIDEST):
            ids = self._merge_long(symbols[offsets[i] : offsets[i + 1]])
            counts[i] = len(ids)
            parts.append((np.array([i]), ids))
        starts = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(starts[-1], np.int32)
        for rows, ids in parts:
            out[_ranges(starts[rows], counts[rows])] = ids
        return out, counts

    def _merge(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols, -1 behind each word's end; merges all rows in step, one merge a round."""
        n, width = symbols.shape
        leaves = 1 << max(1, int(width - 2).bit_length()) if width > 2 else 1
        bits, low = np.int32(8), np.int32(255)
        none = NONE << bits
        tree = np.full((n, 2 * leaves), none)
        ranks = self.rank(symbols[:, :-1], symbols[:, 1:])
        tree[:, leaves : leaves + width - 1] = (ranks << bits) | np.arange(width - 1, dtype=np.int32)
        node = leaves
        while node > 1:
            half = node // 2
            tree[:, half:node] = np.minimum(tree[:, node : 2 * node : 2], tree[:, node + 1 : 2 * node : 2])
            node = half
        # column `width` is the end: no symbol there, and it is its own neighbour
        span = width + 1
        sym = np.concatenate((symbols, np.full((n, 1), -1, np.int32)), 1).ravel()
        nxt = np.tile(np.minimum(np.arange(1, span + 1, dtype=np.int32), width), (n, 1)).ravel()
        prv = np.tile(np.arange(-1, width, dtype=np.int32), (n, 1)).ravel()
        flat_tree = tree.ravel()
        rows = np.arange(n)
        while len(rows):
            root = flat_tree[rows * (2 * leaves) + 1]
            live = root < none
            rows, root = rows[live], root[live]
            if not len(rows):
                break
            place, rank = root & low, root >> bits
            at = rows * span
            gone = nxt[at + place]
            after = nxt[at + gone]
            new = self.merged[rank]
            sym[at + place] = new
            sym[at + gone] = -1
            nxt[at + place] = after
            prv[at + after] = place
            before = prv[at + place]
            base = rows * (2 * leaves)
            ahead = sym[at + after]
            flat_tree[base + leaves + place] = (self.rank(new, ahead) << bits) | place
            inner = gone < leaves  # the last symbol starts no pair
            flat_tree[base[inner] + leaves + gone[inner]] = none
            has = before >= 0
            flat_tree[base[has] + leaves + before[has]] = (self.rank(sym[at[has] + before[has]], new[has]) << bits) | before[has]
            for own, leaf in ((base, place), (base[inner], gone[inner]), (base[has], before[has])):
                node = (leaf + leaves) >> 1
                while len(node) and node[0] > 0:
                    flat_tree[own + node] = np.minimum(flat_tree[own + 2 * node], flat_tree[own + 2 * node + 1])
                    node = node >> 1
        return sym.reshape(n, span)[:, :width]

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        n = len(symbols)
        tree = SegmentTree(self.rank(symbols[:-1], symbols[1:]))
        sym, nxt, prv = [*symbols.tolist(), -1], [*range(1, n + 1), n], [*range(-1, n)]
        known: dict[tuple[int, int], int] = {}
        none = int(NONE)

        def rank(a: int, b: int) -> int:
            if b < 0:
                return none
            if (r := known.get((a, b))) is None:
                r = known[a, b] = int(self.rank(np.array([a]), np.array([b]))[0])
            return r

        while True:
            r, place = tree.least()
            if r >= none:
                return np.array([x for x in sym[:n] if x >= 0], np.int32)
            gone = nxt[place]
            after = nxt[gone]
            sym[place], sym[gone] = int(self.merged[r]), -1
            nxt[place] = after
            prv[after] = place
            tree.set(place, rank(sym[place], sym[after]))
            if gone < n - 1:
                tree.set(gone, none)
            if (before := prv[place]) >= 0:
                tree.set(before, rank(sym[before], sym[place]))


def _byte_signs() -> list[str]:
    """The printable sign of each byte: its own where it has one, else the next free from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def _ranges(starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of size[0] numbers, then those of the next."""
    total = int(size.sum())
    ends = np.cumsum(size)
    return np.arange(total) + np.repeat(np.asarray(starts) - (ends - size), size)


_open: dict[str, Tokenizer] = {}
#: Words that a Python worker remembers, the latest first.
REMEMBERED = 400_000


def tokenizer(path: str) -> Tokenizer:
    if path not in _open:
        _open[path] = Tokenizer(path)
    return _open[path]


#: Bytes of words that need no Unicode rule: letters of ASCII and of the block behind the lead byte
#: C3, and what may stand behind them as one run.
_LEAD = 0xC3
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_ENDING = np.zeros(256, bool)
_ENDING[[ord(c) for c in ".,;:!?"]] = True


def _plain(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each piece, whether it is letters and then endings only, and the number of endings' bytes."""
    kind = np.where(_LETTER[data], 1, np.where(_ENDING[data], 2, 0)).astype(np.int8)
    lead = np.flatnonzero(data == _LEAD)
    lead = lead[lead + 1 < len(data)]
    low = data[lead + 1]
    fine = (low >= 0x80) & (low <= 0xBF) & (low != 0x97) & (low != 0xB7)
    kind[lead[fine]] = kind[lead[fine] + 1] = 1
    size = np.diff(offsets)
    n = len(size)
    letters, endings = np.zeros(n, np.int64), np.zeros(n, np.int64)
    full = size > 0
    at = offsets[:-1][full]
    if len(at):
        letters[full] = np.add.reduceat((kind == 1).astype(np.int64), at)
        endings[full] = np.add.reduceat((kind == 2).astype(np.int64), at)
    # in order: as many changes from ending to letter as none
    back = np.zeros(len(data), np.int64)
    back[1:] = (kind[1:] == 1) & (kind[:-1] == 2)
    turns = np.zeros(n, np.int64)
    if len(at):
        back[at] = 0
        turns[full] = np.add.reduceat(back, at)
    return full & (letters + endings == size) & (turns == 0), endings


def _lower(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    tail = np.flatnonzero((data[:-1] == _LEAD) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)) + 1
    out[tail] += 32
    return out


class _Memory:
    """Ids of words by the words' hashes, in numpy arrays."""

    def __init__(self):
        self.hashes, self.starts, self.size, self.ids = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def look_up(self, hashes: np.ndarray) -> np.ndarray:
        """Place of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def put(self, hashes: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Hashes that aren't here yet; when too many, the new ones replace all."""
        if len(self.hashes) + len(hashes) > REMEMBERED:
            self.__init__()
        starts = np.cumsum(size) - size
        order = np.argsort(all_hashes := np.concatenate((self.hashes, hashes)), kind="stable")
        self.hashes = all_hashes[order]
        self.starts = np.concatenate((self.starts, starts + len(self.ids)))[order]
        self.size = np.concatenate((self.size, size))[order]
        self.ids = np.concatenate((self.ids, ids))


_memory: dict[str, _Memory] = {}


def _encode_distinct(path: str, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words in a row, and the number of each."""
    tok, memory = tokenizer(path), _memory.setdefault(path, _Memory())
    hashes = hash_strings(words)
    at = memory.look_up(hashes)
    lost = np.flatnonzero(at < 0)
    ids, size = tok.encode_words(words.take(pa.array(lost)))
    counts = np.zeros(len(words), np.int64)
    known = np.flatnonzero(at >= 0)
    counts[known], counts[lost] = memory.size[at[known]], size
    starts = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int32)
    out[_ranges(starts[known], counts[known])] = memory.ids[_ranges(memory.starts[at[known]], counts[known])]
    out[_ranges(starts[lost], size)] = ids
    memory.put(hashes[lost], size, ids)
    return out, counts


def encode_distinct_pieces(path: str, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces in a row, and the number of each."""
    tok = tokenizer(path)
    offsets, data = views(pieces)
    plain, endings = _plain(offsets, data)
    size = np.diff(offsets)
    counts = np.zeros(len(pieces), np.int64)
    odd = np.flatnonzero(~plain)
    odd_ids, counts[odd] = tok.encode_pieces(pieces.take(pa.array(odd)).to_pylist())
    own = np.flatnonzero(plain)
    # the words of a plain piece: its letters, its endings
    begin = np.stack((offsets[own], offsets[own] + size[own] - endings[own]), 1).ravel()
    length = np.stack((size[own] - endings[own], endings[own]), 1).ravel()
    body = _lower(data[_ranges(begin, length)]) if len(own) else data[:0]
    ends = np.concatenate(([0], np.cumsum(length)))
    words = pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(body)])
    coded = pc.dictionary_encode(words)
    ids, n = _encode_distinct(path, coded.dictionary)
    starts, code = np.cumsum(n) - n, coded.indices.to_numpy()
    counts[own] = n[code].reshape(-1, 2).sum(1)
    at = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), np.int32)
    out[_ranges(at[own], counts[own])] = ids[_ranges(starts[code], n[code])]
    out[_ranges(at[odd], counts[odd])] = odd_ids
    return out, counts


def ids_bytes(_: Tokenizer, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Each piece's ids as little-endian unsigned 32-bit integers."""
    ends = np.concatenate(([0], np.cumsum(counts))) * 4
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(ids.astype("<u4"))])


def ids_decimal(tok: Tokenizer, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Each piece's ids in decimal, a blank before each."""
    return _joined([b" %d" % i for i in range(len(tok.tokens))], ids, counts)


def ids_tokens(tok: Tokenizer, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Each piece's tokens, a blank before each: the file names no decoder, so decoding joins tokens by blanks."""
    return _joined([b" " + x.encode() for x in tok.tokens], ids, counts)


def _joined(table: list[bytes], ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets, data = views(pa.array(table, pa.large_binary()).take(pa.array(ids)))
    ends = offsets[np.concatenate(([0], np.cumsum(counts)))]
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def encode_texts(path: str, texts: pa.Array, forms=(ids_bytes,)) -> list[pa.Array]:
    """For each form a binary array with a value for each text (without nulls): its pieces' forms in a row."""
    tok = tokenizer(path)
    split = pc.ascii_split_whitespace(flat(texts).cast(pa.large_string()))
    coded = pc.dictionary_encode(split.flatten())
    ids, counts = encode_distinct_pieces(path, coded.dictionary)
    ends = np.asarray(split.offsets)
    ends = ends - ends[0]
    out = []
    for form in forms:
        offsets, body = views(form(tok, ids, counts).take(coded.indices))
        out.append(pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets[ends]), pa.py_buffer(np.ascontiguousarray(body))]))
    return out
