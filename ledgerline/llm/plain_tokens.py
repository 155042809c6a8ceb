"""Plain texts cut into tokens as arrays, and a bounded table of the tokens that a worker has met.

Tokens of many texts are told apart by the classes of their bytes, all at once; Arrow finds the distinct
ones, and only those that the table lacks are computed. No token becomes a Python object.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerline.llm.pieces import LONGEST, PLAIN, batches_by_size

#: Bytes of a worker's table of tokens and their ids.
TABLE_SIZE = 16 << 20
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
def _class(char: str) -> int:
    if not PLAIN.fullmatch(char) and char < "\u0250":
        return 0
    return SPACE if char in " \n" else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(char)[0], OTHER)


#: Of all characters of at most two bytes, as small letters of plain capitals may lie beyond the plain ones.
_CLASS = np.array([_class(chr(i)) for i in range(0x800)], dtype=np.uint8)
_BYTE_CLASS = np.concatenate([_CLASS[:0x80], np.zeros(0x80, dtype=np.uint8)])
#: The small letter of a character where that is one character of as many bytes, else 0.
_SMALL = np.array([ord(x) if len(x) == 1 and len(x.encode()) == len(chr(i).encode()) else 0 for i in range(0x250) for x in [chr(i).lower()]])
_BYTE_SMALL = np.concatenate([_SMALL[:0x80], np.arange(0x80, 0x100)]).astype(np.uint8)


def _all_of(codes) -> str:
    """Texts of these characters, in the dialect of Arrow's patterns."""
    return "^[" + "".join([f"\\x{{{i:x}}}" for i in codes]) + "]*$"


_PLAIN = _all_of(np.flatnonzero(_CLASS[:0x250]))
_PLAIN_SMALL = _all_of(np.flatnonzero((_CLASS[:0x250] > 0) & (_SMALL > 0)))


def plain_texts(texts: pa.Array, special: list[str], small: bool = False) -> np.ndarray:
    """Which texts have plain characters alone, for ``small`` such as lowered() changes in place, and spell out no ``special`` token."""
    ok = pc.match_substring_regex(texts, _PLAIN_SMALL if small else _PLAIN).to_numpy(zero_copy_only=False)
    for token in special:
        ok = ok & ~pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
    return ok


def bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all large_binary or large_string values, one behind the other, and where each begins and ends."""
    if not len(values):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(values) + 1, offset=8 * values.offset)
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def binary_of(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Values that lie in ``data`` one behind the other, without a copy."""
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64, copy=False)), pa.py_buffer(np.ascontiguousarray(data))])


def _two_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where characters of two bytes begin, and their numbers."""
    lead = np.flatnonzero(data >= 0xC0)
    return lead, (data[lead].astype(np.int64) & 0x1F) << 6 | data[lead + 1] & 0x3F


def lowered(data: np.ndarray) -> np.ndarray:
    """Plain texts in small letters."""
    out = _BYTE_SMALL[data]
    lead, code = _two_bytes(data)
    code = _SMALL[code]
    out[lead], out[lead + 1] = 0xC0 | code >> 6, 0x80 | code & 0x3F
    return out


def token_starts(data: np.ndarray, ends: np.ndarray, spaced: bool) -> tuple[np.ndarray, np.ndarray]:
    r"""At which bytes the tokens of plain texts begin, and each one's class.

    ``spaced``: '(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+, as byte-level vocabularies split. Otherwise
    '(?:s|t|re|ve|m|ll|d)|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+, with white space between as tokens of class SPACE.
    """
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    kind = _BYTE_CLASS[data]
    lead, code = _two_bytes(data)
    kind[lead] = kind[lead + 1] = _CLASS[code]
    edge = np.zeros(n + 1, dtype=bool)  # a text begins, or all have ended
    edge[ends] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    if spaced:
        # The last white character before another one is a token, or the beginning of one if it is a space.
        white = np.flatnonzero(kind == SPACE)
        white = white[~edge[white + 1]]
        white = white[kind[white + 1] != SPACE]
        start[white] = True
        start[white[data[white] == 0x20] + 1] = False
    else:
        digit = kind == NUMBER
        digit[lead + 1] = False
        start |= digit
    quote = np.flatnonzero(data == 0x27)
    quote = quote[start[quote]]
    if len(quote):
        at = np.minimum(quote + 1, n - 1)
        a = np.where(edge[quote + 1], 0, data[at])
        b = np.where((a == 0) | edge[at + 1], 0, data[np.minimum(at + 1, n - 1)])
        one = np.isin(a, np.frombuffer(b"stmd", dtype=np.uint8))
        two = np.isin(a.astype(np.int64) << 8 | b, [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")])
        start[quote[one | two] + 1] = False
        after = np.concatenate([quote[one] + 2, quote[two] + 3])
        start[after[after < n]] = True
    starts = np.flatnonzero(start)
    return starts, kind[starts]


class TokenTable:
    """Ids of tokens that a worker has met. Beyond ``most`` bytes, those go that weren't met since the last time, or all where that is too little.

    ``compute`` tells the ids of new tokens, as bytes. Tokens of more than LONGEST bytes are computed each time.
    """

    def __init__(self, compute, most: int = TABLE_SIZE):
        self.compute, self.most = compute, most
        self._keep(pa.array([], pa.large_binary()), pa.array([], pa.large_binary()))

    def _keep(self, tokens: pa.Array, ids: pa.Array) -> None:
        self.tokens, self.ids, self.met = tokens, ids, np.zeros(len(tokens), dtype=bool)

    def values(self, distinct: pa.Array) -> pa.Array:
        """Ids of distinct tokens."""
        if self.tokens.nbytes + self.ids.nbytes > self.most:
            used = pa.array(self.met)
            tokens, ids = self.tokens.filter(used), self.ids.filter(used)
            if tokens.nbytes + ids.nbytes > self.most // 2:
                tokens, ids = tokens[:0], ids[:0]
            self._keep(tokens, ids)
        # Which of the table's tokens these are: Arrow hashes the fewer.
        here = pc.index_in(self.tokens, value_set=distinct).fill_null(-1).to_numpy(zero_copy_only=False)
        held = np.flatnonzero(here >= 0)
        at = np.full(len(distinct), -1, dtype=np.int64)
        at[here[held]] = held
        self.met[held] = True
        lacking = at < 0
        if not lacking.any():
            return self.ids.take(pa.array(at))
        new = distinct.filter(pa.array(lacking))
        made = self.compute(new)
        at[lacking] = len(self.ids) + np.arange(len(new))
        ids = pa.concat_arrays([self.ids, made])
        out = ids.take(pa.array(at))
        short = pc.less_equal(pc.binary_length(new), LONGEST)
        if not pc.all(short).as_py():
            new, made = new.filter(short), made.filter(short)
            ids = pa.concat_arrays([self.ids, made])
        self.tokens, self.ids = pa.concat_arrays([self.tokens, new]), ids
        self.met = np.concatenate([self.met, np.ones(len(new), dtype=bool)])
        return out


def distinct_tokens(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Each token's code, and the distinct tokens by code."""
    coded = binary_of(data, np.append(starts, len(data))).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def encoded(table: TokenTable, data: np.ndarray, ends: np.ndarray, spaced: bool) -> list[bytes]:
    """Each plain text's ids, as bytes; ``ends`` is where each text begins and ends."""
    starts, _ = token_starts(data, ends, spaced)
    if not len(starts):
        return [b""] * (len(ends) - 1)
    codes, distinct = distinct_tokens(data, starts)
    ids, at = bytes_of(table.values(distinct).take(pa.array(codes)))
    cut = at[np.searchsorted(starts, ends)].tolist()
    ids = memoryview(ids)
    return [ids[a:b].tobytes() for a, b in zip(cut, cut[1:])]


def text_slices(texts: pa.Array, limit: int = 1 << 22):
    """(begin, end, texts) of runs that pass ``limit`` bytes together; a null text is an empty one."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, ends = bytes_of(texts)
    a = 0
    while a < len(texts):
        b = min(len(texts), max(a + 1, int(np.searchsorted(ends, ends[a] + limit))))
        yield a, b, texts.slice(a, b - a)
        a = b


def in_two_ways(texts: pa.Array, plain: np.ndarray, by_arrays, by_pieces) -> list[bytes]:
    """Ids of each text, of plain ones by ``by_arrays`` (an array), of others by ``by_pieces`` (a list), 1 MB of characters at a time."""
    if plain.all():
        return by_arrays(texts)
    found = iter(by_arrays(texts.filter(pa.array(plain))))
    rest = texts.filter(pa.array(~plain)).to_pylist()
    others = iter([ids for a, b in batches_by_size(rest, 1 << 20) for ids in by_pieces(rest[a:b])])
    return [next(found) if p else next(others) for p in plain.tolist()]
