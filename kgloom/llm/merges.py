"""Byte-pair merges from a tokenizer file: pre-tokens, merge queue, decoding.

A vocabulary is read once on the driver into plain tables (``load``) and sent to
the tasks as one broadcast; its size is that of the file. A task turns the tables
into an ``Encoder``. Nothing is trained here.
"""
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from string import punctuation
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

# bytes of pre-tokens and of pieces that a task keeps; a full cache is emptied, so memory stays bounded for any corpus
KEPT_WORDS = 64 << 20
KEPT_PIECES = 24 << 20
# bytes of an entry besides its key and value
ENTRY = 200
# marks that end most pieces; any other piece is split by the pattern
SINGLE_MARKS = frozenset(".,;:!?)")
# longer pieces are encoded anew each time instead of being kept
CACHE_PIECE = 200
# a queue entry is a rank above this many bits of position
AT_BITS = 40
AT_MASK = (1 << AT_BITS) - 1

# fixed values: white space as Unicode defines it, contractions and split patterns of the public tokenizer files
WHITE = "\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
SPACED = rf"{CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
WORDS = rf"{CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in names)
    names.update({b: chr(256 + i) for i, b in enumerate(rest)})
    return [names[b] for b in range(256)]


def load(path: str) -> dict:
    """Plain tables of a tokenizer file: vocabulary by id, ranked merges, ids of single bytes, special strings."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model = spec["model"]
    vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    ranks, made_by = {}, []
    for rank, pair in enumerate(model["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        ranks.setdefault(vocab[left], {})[vocab[right]] = rank
        made_by.append(vocab[left + right])
    names = byte_symbols()
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    strings = {i: s for s, i in [*vocab.items(), *specials.items()]}
    return {
        "strings": [strings.get(i, "") for i in range(max(strings) + 1)], "ranks": ranks, "made_by": made_by, "specials": specials,
        "bytes": [vocab[n] for n in names], "last": [vocab[n + suffix] for n in names], "lower": bool(suffix),
    }


class Kept(dict):
    """A memo of bounded bytes: missing keys are computed and kept, and a full memo is emptied."""

    def __init__(self, make, limit):
        self.make, self.limit, self.held = make, limit, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= CACHE_PIECE:
            self.held += ENTRY + len(key) + (len(value) if isinstance(value, bytes) else 0)
            if self.held > self.limit:
                self.clear()
                self.held = 0
            self[key] = value
        return value


class Encoder:
    """Token ids of texts by the tables of ``load``."""

    def __init__(self, tables: dict):
        none = {}
        self.ranks, self.made_by = [tables["ranks"].get(i, none) for i in range(len(tables["strings"]))], tables["made_by"]
        self.first, self.last = tables["bytes"], tables["last"]
        self.specials, self.strings, self.lower = tables["specials"], tables["strings"], tables["lower"]
        self.split_specials = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.find = regex.compile(WORDS if self.lower else SPACED).findall
        self.words = Kept(self.merge, KEPT_WORDS)
        self.pieces = Kept(self.piece_ids, KEPT_PIECES)

    def merge(self, word: str) -> bytes:
        """Ids of one pre-token, as little-endian 32-bit integers.

        Symbols form a doubly linked list. A queue holds rank and position of
        adjacent pairs that merge, as one number; an entry is stale, and is
        skipped, when its left symbol is gone or the pair there now merges into
        something else.
        """
        data = word.encode("utf-8")
        first, ranks, made_by = self.first, self.ranks, self.made_by
        ids = [first[b] for b in data]
        ids[-1] = self.last[data[-1]]
        n = len(ids)
        queue = [(rank << AT_BITS) | at for at, (a, b) in enumerate(zip(ids, ids[1:])) if (rank := ranks[a].get(b)) is not None]
        if not queue:
            return pack(f"<{n}I", *ids)
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        while queue:
            entry = heappop(queue)
            at = entry & AT_MASK
            left = ids[at]
            right = after[at]
            if left < 0 or right == n:
                continue
            made = made_by[entry >> AT_BITS]
            rank = ranks[left].get(ids[right])
            if rank is None or made_by[rank] != made:
                continue
            ids[at], ids[right] = made, -1
            right = after[at] = after[right]
            before[right] = at
            if right < n and (rank := ranks[made].get(ids[right])) is not None:
                heappush(queue, (rank << AT_BITS) | at)
            left = before[at]
            if left >= 0 and (rank := ranks[ids[left]].get(made)) is not None:
                heappush(queue, (rank << AT_BITS) | left)
        ids = [i for i in ids if i >= 0]
        return pack(f"<{len(ids)}I", *ids)

    def piece_ids(self, piece: str) -> bytes:
        """Ids, as little-endian 32-bit integers, of a string whose pre-tokens depend on nothing around it."""
        if self.lower:
            piece = lower_nfc(piece)
            if piece.isalpha():
                return self.words[piece]
            if piece[:-1].isalpha() and piece[-1] in SINGLE_MARKS:
                return self.words[piece[:-1]] + self.words[piece[-1]]
        return b"".join([self.words[w] for w in self.find(piece)])

    def parts(self, text: str):
        """(string, special id or None) in order; special strings of the file stand alone."""
        if self.split_specials is None:
            return [(text, None)]
        return [(p, self.specials.get(p)) for p in self.split_specials.split(text) if p]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers.

        A file whose tokens end words drops white space, so each run between
        white space is encoded, and remembered, on its own.
        """
        out = []
        for part, special in self.parts(text):
            if special is not None:
                out.append(pack("<I", special))
            elif self.lower:
                out.extend(map(self.pieces.__getitem__, blank_split(part)))
            else:
                out.append(self.piece_ids(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Vocabulary strings put together with single spaces, as files without a decoder give them."""
        flat = array("I")
        flat.frombytes(ids)
        return " ".join(map(self.strings.__getitem__, flat))


# words of more bytes, and words of a length that few others have, are merged one by one
SHORT_WORD = 48
FEW_WORDS = 8
# strings that are looked up at a time
BLOCK = 1 << 19
# strings that are held singly before they become an array
PART = 1 << 14
# no pair of symbols has this rank
NO_RANK = 1 << 30


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every run, one run after the other."""
    # places of a block fit into 32 bits, which halves its arrays
    before = np.cumsum(counts) - counts
    runs = np.repeat((starts - before).astype(np.int32), counts)
    runs += np.arange(len(runs), dtype=np.int32)
    return runs


class BulkEncoder(Encoder):
    """The same ids for many texts at a time: the distinct words of a block are merged together, as arrays, and nothing is kept between blocks."""

    def __init__(self, tables: dict):
        super().__init__(tables)
        pairs = sorted((left, right, rank) for left, by_right in tables["ranks"].items() for right, rank in by_right.items())
        left, right, rank = np.array(pairs, dtype=np.int64).reshape(-1, 3).T
        # a last key that no pair has
        self.keys, self.rank_of = np.append(left << 32 | right, np.iinfo(np.int64).max), np.append(rank, NO_RANK).astype(np.int32)
        self.made, self.first_ids, self.last_ids = (np.array(t, dtype=np.int32) for t in (self.made_by, self.first, self.last))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """``encode`` of each text; those that hold special strings are encoded one by one."""
        single = [not self.lower or (self.split_specials is not None and self.split_specials.search(t) is not None) for t in texts]
        counts, blocks = [], []
        # the strings of a part become an array at once, those of a block are looked up together
        for arrays in self.gathered(texts, single, counts):
            blocks.append(self.block(pa.concat_arrays(arrays).dictionary_encode()))
        ids = np.concatenate([np.zeros(0, dtype="<u4"), *[b[0] for b in blocks]])
        after = np.concatenate([[0], *[b[1] for b in blocks]]).cumsum()
        ends = after[np.cumsum([0, *counts])].tolist()
        for text, alone, a, b in zip(texts, single, ends, ends[1:]):
            yield self.encode(text) if alone else ids[a:b].tobytes()

    def gathered(self, texts: list[str], single: list[bool], counts: list[int]) -> Iterator[list[pa.StringArray]]:
        """Pieces of the texts in arrays, about ``BLOCK`` at a time; the number of pieces of each text is added to ``counts``."""
        pieces, arrays, held = [], [], 0
        for text, alone in zip(texts, single):
            split = [] if alone else blank_split(text)
            counts.append(len(split))
            for at in range(0, len(split), BLOCK):
                pieces += split[at:at + BLOCK]
                if len(pieces) >= PART:
                    arrays.append(pa.array(pieces, pa.string()))
                    held, pieces = held + len(pieces), []
                if held >= BLOCK:
                    yield arrays
                    arrays, held = [], 0
        if pieces or arrays:
            yield [*arrays, pa.array(pieces, pa.string())]

    def block(self, coded: pa.DictionaryArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has."""
        piece, distinct = coded.indices.to_numpy(), coded.dictionary
        # a piece of ASCII letters is one word; others are split into theirs
        plain = pc.ascii_is_alpha(distinct).to_numpy(zero_copy_only=False) & pc.string_is_ascii(distinct).to_numpy(zero_copy_only=False)
        words = list(map(self.words_of, distinct.filter(pa.array(~plain)).to_pylist()))
        n_words = np.ones(len(distinct), dtype=np.int64)
        n_words[~plain] = list(map(len, words))
        first = np.zeros(len(distinct), dtype=np.int64)
        first[plain] = np.arange(plain.sum())
        first[~plain] = plain.sum() + np.cumsum(n_words[~plain]) - n_words[~plain]
        said = pa.concat_arrays([pc.ascii_lower(distinct.filter(pa.array(plain))), pa.array([w for ws in words for w in ws], pa.string())]).dictionary_encode()
        at, count, ids = self.merge_all(said.dictionary)
        word = said.indices.to_numpy()[_runs(first[piece], n_words[piece])]
        per_piece = np.concatenate([[0], count[word].cumsum()])[np.concatenate([[0], n_words[piece].cumsum()])]
        return ids[_runs(at[word], count[word])], np.diff(per_piece)

    def words_of(self, piece: str) -> tuple | list:
        """Pre-tokens of a piece; a word with any marks after it is not searched by the pattern."""
        piece = lower_nfc(piece)
        if piece.isalpha():
            return (piece,)
        word = piece.rstrip(punctuation)
        return (word, piece[len(word):]) if word.isalpha() else self.find(piece)

    def merge_all(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the first id, number of ids) of each word, and the ids."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        # a word has at most an id per byte
        at, count, ids = offsets[:-1], np.zeros(len(words), dtype=np.int64), np.zeros(len(data), dtype="<u4")
        lengths = np.diff(offsets)
        for length, many in zip(*np.unique(lengths, return_counts=True)):
            rows = np.flatnonzero(lengths == length)
            if length > SHORT_WORD or many < FEW_WORDS:
                for row in rows.tolist():
                    merged = np.frombuffer(self.merge(words[row].as_py()), "<u4")
                    count[row] = len(merged)
                    ids[at[row]:at[row] + len(merged)] = merged
            else:
                self.merge_rows(rows, data[at[rows][:, None] + np.arange(length)], at, count, ids)
        return at, count, ids

    def merge_rows(self, rows: np.ndarray, data: np.ndarray, at: np.ndarray, count: np.ndarray, out: np.ndarray) -> None:
        """Puts number and ids of words of one length, given as rows of bytes, into ``count`` and ``out``.

        In a round each row merges the leftmost of its adjacent pairs of least rank, so
        the rows stay of one length; rows without a pair that merges are done.
        """
        ids = np.concatenate([self.first_ids[data[:, :-1]], self.last_ids[data[:, -1:]]], axis=1)
        near = self.ranks_of(ids[:, :-1], ids[:, 1:])
        while len(rows):
            n = ids.shape[1]
            place = near.argmin(axis=1) if n > 1 else np.zeros(len(rows), dtype=np.int64)
            least = near[np.arange(len(rows)), place] if n > 1 else np.full(len(rows), NO_RANK, dtype=np.int32)
            more = least != NO_RANK
            done = rows[~more]
            count[done] = n
            out[at[done][:, None] + np.arange(n)] = ids[~more]
            rows, place, least = rows[more], place[more], least[more]
            line = np.arange(len(rows))
            kept = np.ones((len(rows), n), dtype=bool)
            kept[line, place + 1] = False
            ids, near = ids[more][kept].reshape(len(rows), n - 1), near[more][kept[:, 1:]].reshape(len(rows), max(n - 2, 0))
            made = ids[line, place] = self.made[least]
            inner = np.flatnonzero(place > 0)
            near[inner, place[inner] - 1] = self.ranks_of(ids[inner, place[inner] - 1], made[inner])
            inner = np.flatnonzero(place < n - 2)
            near[inner, place[inner]] = self.ranks_of(made[inner], ids[inner, place[inner] + 1])

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, ``NO_RANK`` if it does not merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank_of[at], np.int32(NO_RANK))


_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_WHITE_RUN = re.compile(f"[{WHITE}]+")


def blank_split(text: str) -> list[str]:
    """Runs without white space; the information separators, which str.split() also cuts at, are not white space here."""
    if _SEPARATORS.search(text) is None:
        return text.split()
    return [p for p in _WHITE_RUN.split(text) if p]


def lower_nfc(piece: str) -> str:
    """Composed form in lower case, each character by itself (no final sigma rule)."""
    if piece.isascii():
        return piece.lower()
    piece = unicodedata.normalize("NFC", piece)
    return piece.lower() if "Σ" not in piece else "".join([c.lower() for c in piece])
