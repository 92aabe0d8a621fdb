"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For the bytes of one pattern match the last token of the encoding of every prefix is stored. It is unique: of the tokens
that end there exactly one can follow the stored last token of the prefix before it, namely the one for which merging the
pair by rank gives the pair back. So a table needs one pass, appending only adds entries, and after an edit entries are
worked out anew only until they agree with the shifted old ones for as many bytes as the longest token has. The encoding
is read backwards from the last entry.

A merge never crosses a pattern match, so matches are encoded one by one, and the ids of frequent matches are kept in a
bounded table of each Python worker. Nothing is shuffled: a text is encoded and decoded where it is read.

Defined cases: a null text is the empty text, with no ids and the digest of nothing; an empty table gives an empty
result; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weaklabel.llm.common import raw_texts, slices, whole

SLICE_BYTES = 4 << 20
KEPT_PIECES = 400_000
KEPT_PAIRS = 1_000_000


class Vocabulary:
    """Ranks of byte strings. Ranks are ids; a token made by a merge ranks after both of its parts."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.rank = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """Read a rank file: a line for each token, its base64 and its rank."""
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(b): int(i) for b, i in pairs})

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for one that no merge makes."""
        if token not in self._parts:
            whole_token = self.bytes[token]
            made = self._merged(whole_token, token) if len(whole_token) > 1 else []
            self._parts[token] = (made[0], made[1]) if len(made) == 2 else None
        return self._parts[token]

    def _merged(self, data: bytes, below: int) -> list[int]:
        """Merge the lowest-ranked neighbours with a rank under ``below`` until there are none."""
        at = [data[i : i + 1] for i in range(len(data))]
        while len(at) > 1:
            rank, i = min((self.rank.get(at[i] + at[i + 1], below), i) for i in range(len(at) - 1))
            if rank >= below:
                break
            at[i : i + 2] = [at[i] + at[i + 1]]
        return [self.rank[b] for b in at]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``left`` then ``right`` is the encoding of their bytes together.

        Both tokens are taken apart again, the one merged last first; at no step may the two pieces that meet at the
        border form a token that would have been merged before one of them was.
        """
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= KEPT_PAIRS:
                self._fits.clear()
            known = self._fits[key] = self._check(left, right)
        return known

    def _check(self, a: int, b: int) -> bool:
        token_bytes, rank = self.bytes, self.rank
        # a merge across the border wins if it ranks before `until`, the rank of the next piece to be made at the border;
        # at equal rank the left one is made first
        until_left = until_right = None
        while True:
            across = rank.get(token_bytes[a] + token_bytes[b])
            if across is not None:
                if until_left is None and until_right is None:
                    return False
                if until_right is not None and across <= until_right:
                    return False
                if until_left is not None and across < until_left:
                    return False
            parts_a, parts_b = self.parts(a), self.parts(b)
            if parts_a is None and parts_b is None:
                return True
            if parts_b is None or (parts_a is not None and a > b):
                until_left, until_right, a = a, None, parts_a[1]
            else:
                until_left, until_right, b = None, b, parts_b[0]


class PrefixTable:
    """The last token of every prefix of some bytes: ``last[i]`` belongs to the first ``i`` bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary = vocabulary
        self.data = bytearray()
        self.last: list[int] = [-1]
        self.append(data)

    def _entry(self, i: int) -> int:
        v, data, last = self.vocabulary, self.data, self.last
        rank, fits = v.rank, v.fits
        for j in range(max(0, i - v.longest), i):
            token = rank.get(bytes(data[j:i]))
            if token is not None and (j == 0 or fits(last[j], token)):
                return token
        raise ValueError(f"no token for byte {data[i - 1]}")

    def append(self, more: bytes) -> None:
        for x in more:
            self.data.append(x)
            self.last.append(-1)
            self.last[-1] = self._entry(len(self.data))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of the bytes ``start`` to ``stop``; returns how many entries were worked out."""
        tail = self.last[stop + 1 :]
        rest = bytes(self.data[stop:])
        del self.data[start:], self.last[start + 1 :]
        self.append(new)
        self.data.extend(rest)
        at, agreed, done = len(self.last) - 1, 0, len(new)
        for k, old in enumerate(tail):
            if agreed >= self.vocabulary.longest:  # every token that can end further on starts among agreed entries
                self.last.extend(tail[k:])
                break
            self.last.append(-1)
            at += 1
            self.last[at] = self._entry(at)
            agreed = agreed + 1 if self.last[at] == old else 0
            done += 1
        return done

    def tokens(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i])
            i -= len(self.vocabulary.bytes[self.last[i]])
        return out[::-1]


def encode_piece(v: Vocabulary, data: bytes) -> list[int]:
    """The ids of one pattern match, by the same rule as ``PrefixTable``.

    A token is its own encoding. The one token that can end a prefix is mostly short, so short ones are tried first.
    """
    rank, fits, longest = v.rank.get, v.fits, v.longest
    known = rank(data)
    if known is not None:
        return [known]
    n = len(data)
    last, checked = [-1] * (n + 1), v._fits.get
    for i in range(1, n + 1):
        for j in range(i - 1, i - longest - 1 if i > longest else -1, -1):
            token = rank(data[j:i])
            if token is not None:
                if not j:
                    last[i] = token
                    break
                before = last[j]
                ok = checked((before, token))
                if fits(before, token) if ok is None else ok:
                    last[i] = token
                    break
        else:
            raise ValueError(f"no token for byte {data[i - 1]}")
    out, i = [], n
    while i:
        out.append(last[i])
        i -= len(v.bytes[last[i]])
    return out[::-1]


class _Pieces(dict):
    """Ids of pattern matches as decimal text, worked out when first asked for."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> str:
        if len(self) >= KEPT_PIECES:
            self.clear()
        ids = " ".join(map(str, encode_piece(self.vocabulary, piece.encode())))
        if len(piece) <= 64:
            self[piece] = ids
        return ids


@lru_cache(maxsize=4)
def _loaded(path: str, pattern: str):
    v = Vocabulary.read(path)
    return regex.compile(pattern), _Pieces(v), {str(i): b for i, b in v.bytes.items()}


def encode(texts: Iterable[str], path: str, pattern: str) -> Iterator[list[int]]:
    """The ids of each text."""
    split, pieces, _ = _loaded(path, pattern)
    for text in texts:
        yield [int(i) for piece in split.findall(text) for i in pieces[piece].split()]


def decode(ids: Iterable[int], path: str, pattern: str) -> bytes:
    """The bytes of a list of ids."""
    _, _, token_bytes = _loaded(path, pattern)
    return b"".join([token_bytes[str(i)] for i in ids])


def encode_decode(docs: DataFrame, path: str, pattern: str, keep: list[str], text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """Columns ``keep`` of ``docs`` with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded (bytes).

    ``path`` is a rank file that every executor can read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, pieces, token_bytes = _loaded(path, pattern)
        for part in slices(batches, "__text", SLICE_BYTES):
            counts, id_shas, shas, lists, datas = [], [], [], [], []
            for raw in raw_texts(part.column("__text")):
                line = " ".join([pieces[p] for p in split.findall(str(raw, "utf-8"))])
                ids = line.split(" ") if line else []
                data = b"".join([token_bytes[i] for i in ids])
                counts.append(len(ids))
                id_shas.append(hashlib.sha256(line.encode()).hexdigest())
                shas.append(hashlib.sha256(data).hexdigest())
                if with_ids:
                    lists.append([int(i) for i in ids])
                    datas.append(data)
            made = [pa.array(counts, pa.int64()), pa.array(id_shas, pa.string()), pa.array(shas, pa.string())]
            made += [pa.array(lists, pa.list_(pa.int32())), pa.array(datas, pa.binary())] if with_ids else []
            yield pa.record_batch([*(part.column(c) for c in keep), *made], names=[*keep, *names])

    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])]
    kept = docs.select(*keep, whole(text_column).alias("__text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    more = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string", *(["ids array<int>", "decoded binary"] if with_ids else [])]
    return kept.mapInArrow(work, ", ".join([*kinds, *more]))
