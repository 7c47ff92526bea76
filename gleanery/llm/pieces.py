"""Texts cut into pieces whose tokens do not depend on what stands around them.

The pre-token pattern never lets a token run across a single space between two non-spaces, except as that token's first
character. So a text cut in front of such spaces can be encoded piece by piece, and equal pieces are encoded once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
import regex

#: White space as the pattern's \s has it, and \x1c-\x1f, which cost nothing but a slower cut.
_WHITE = r"\t-\r \x1c-\x1f\x85\xa0  -     　"
_UNEVEN = re.compile(rf" [{_WHITE}]|[{_WHITE}] ")
_CUT = re.compile(rf"(?<=[^{_WHITE}])(?= [^{_WHITE}])")


_WHITE_BYTES = [bytes([b]) for b in (*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0)]


def _uneven(text: str) -> bool:
    """Whether white space stands beside a space. Most texts fit in one byte a character: plain searches tell at once."""
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return _UNEVEN.search(text) is not None
    return b"  " in raw or any(white in raw and (b" " + white in raw or white + b" " in raw) for white in _WHITE_BYTES)


def _even(text: str) -> bool:
    """Whether every space of the text is a cut."""
    return not text.startswith(" ") and not text.endswith(" ") and not _uneven(text)


def split_pieces(text: str) -> tuple[list[str], bool]:
    """The pieces, and whether all but the first have lost the space that they begin with."""
    return (text.split(" "), True) if _even(text) else (_CUT.split(text), False)


def split_many(texts: list[str]) -> tuple[list[list[str]], pa.ListArray]:
    """Of each text the pieces as they stand (the first, or all where a space is no cut) and those that have lost their space."""
    whole, rests = [], []
    for text in texts:
        first, _, rest = text.partition(" ") if _even(text) else ("", "", "")
        whole.append([first] if first or not text else _CUT.split(text))
        rests.append(rest or None)
    return whole, pc.split_pattern(pa.array(rests, pa.large_string()), " ")


#: The pre-token pattern for texts of these signs alone, many at once, each with _STOP behind it, which is no such sign.
_STOP = "\x00"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_OTHER_SIGN = re.compile(rf"[^\t\n\r -~{_LETTERS}]")
_MANY = re.compile(rf"{_STOP}|'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s{_LETTERS}0-9{_STOP}]+|\s+(?![^\s{_STOP}])|\s+")


def pretokens_of_many(pieces: list[str], find: Callable[[str], list[str]]) -> list[list[str]]:
    """The pre-tokens of each piece: by one search through all that have only common signs, by `find` of the others."""
    uncommon = {piece for piece in pieces if _OTHER_SIGN.search(piece)} if _OTHER_SIGN.search("\n".join(pieces)) else ()
    common = [piece for piece in pieces if piece not in uncommon] if uncommon else pieces
    found = _MANY.findall(_STOP.join([*common, ""]))
    ends = [k for k, token in enumerate(found) if token == _STOP]
    cut = (found[start:end] for start, end in zip([0, *(end + 1 for end in ends)], ends))
    return [find(piece) if piece in uncommon else next(cut) for piece in pieces] if uncommon else list(cut)


#: Signs that are a pre-token by themselves behind letters.
_STOPS = frozenset(",.;:!?")

#: Pieces of more letters are not remembered: they hardly come again, and one may be as long as its text.
LONGEST_KEPT = 64
#: Bytes that a kept piece takes at most: two objects and a place in a table, four bytes a letter and twelve for its ids.
_SLOT, _LETTER = 250, 16


class PieceEncoder:
    """Values (bytes or counts) of whole texts from the values of their pre-tokens.

    `encode_many` maps a list of distinct pre-tokens to their values; `total` adds the values of consecutive pre-tokens up.
    What it made of pieces of at most LONGEST_KEPT letters is kept for later texts, in at most `capacity` bytes; beyond that it
    starts afresh, so memory is bounded by that and the current batch of texts.
    `special` are strings that are pre-tokens of their own wherever they stand.
    """

    def __init__(self, pattern: str, encode_many: Callable[[list[str]], Iterable], total: Callable, special: Sequence[str] = (), capacity: int = 256 << 20):
        self._find = regex.compile(pattern).findall
        self._strings = tuple(special)
        self._special = re.compile(f"({'|'.join(map(re.escape, sorted(special, key=len, reverse=True)))})") if special else None
        self._encode_many, self._total, self._capacity = encode_many, total, capacity
        self._tokens: dict[str, object] = {}
        self._plain: dict[str, object] = {}
        self._spaced: dict[str, object] = {}
        self._held = 0

    def _pretokens(self, lead: str, piece: str, special: bool) -> list[str]:
        if piece.isalpha():  # letters alone, as most pieces: one pre-token
            return [lead + piece]
        if piece and piece[-1] in _STOPS and piece[:-1].isalpha():
            return [lead + piece[:-1], piece[-1]]
        if not special or self._special.search(piece) is None:
            return self._find(lead + piece)
        parts = self._special.split(lead + piece)  # every second part is a special string
        return [token for k, part in enumerate(parts) for token in ([part] if k % 2 else self._find(part))]

    def _learn(self, book: dict, pieces: list[str], lead: str, special: bool) -> None:
        cut = [self._pretokens(lead, piece, special) for piece in pieces]
        new = list(set().union(*cut) - self._tokens.keys())
        if new:
            self._tokens.update(zip(new, self._encode_many(new)))
        value, total = self._tokens.__getitem__, self._total
        for piece, tokens in zip(pieces, cut):
            if len(tokens) == 2:
                book[piece] = value(tokens[0]) + value(tokens[1])
            else:
                book[piece] = value(tokens[0]) if len(tokens) == 1 else total(map(value, tokens))

    def encode(self, texts: list[str]) -> list:
        """The value of each text."""
        books = (self._tokens, self._plain, self._spaced)
        if self._held > self._capacity:
            self._held = 0
            for book in books:
                book.clear()
        known = [len(book) for book in books]
        special = any(string in text for string in self._strings for text in texts)
        plain: set[str] = set()
        spaced: set[str] = set()
        cut = []
        for text in texts:
            pieces, lost = split_pieces(text)
            first = pieces if not lost else pieces[:1]
            rest = pieces[1:] if lost else []
            plain.update(first)
            spaced.update(rest)
            cut.append((first, rest))
        for book, seen, lead in ((self._plain, plain, ""), (self._spaced, spaced, " ")):
            if missing := list(seen - book.keys()):
                self._learn(book, missing, lead, special)
        total, one, other = self._total, self._plain.__getitem__, self._spaced.__getitem__
        found = [total((total(map(one, first)), total(map(other, rest)))) for first, rest in cut]
        for book, n in zip(books, known):
            new = list(islice(reversed(book), len(book) - n))  # the last that came
            for piece in [piece for piece in new if len(piece) > LONGEST_KEPT]:
                del book[piece]
            kept = list(islice(reversed(book), len(book) - n))
            self._held += _SLOT * len(kept) + _LETTER * sum(map(len, kept))
        return found


class PieceBook(dict):
    """Values (bytes) of pieces.

    A book of more than `capacity` pieces is followed by an empty one, which takes over what is asked for again: common pieces
    stay, rare ones go, and memory is bounded by two books of pieces of at most LONGEST_KEPT letters.
    """

    def __init__(self, capacity: int, old: dict | None = None):
        super().__init__()
        self.capacity, self.old = capacity, old or {}

    def following(self) -> PieceBook:
        """This book, or the one that follows it once it is full."""
        if len(self) <= self.capacity:
            return self
        self.old = {}
        return PieceBook(self.capacity, self)

    def known(self, pieces: list[str]) -> list[bytes | None]:
        """The value of each piece, None for those in neither book."""
        found = list(map(self.get, pieces))
        if self.old and None in found:
            for k in [k for k, value in enumerate(found) if value is None]:
                if (value := self.old.get(pieces[k])) is not None:
                    found[k] = self[pieces[k]] = value
        return found

    def keep(self, pieces: list[str], values: Iterable[bytes]) -> None:
        kept = zip(pieces, values)
        self.update(kept if max(map(len, pieces), default=0) <= LONGEST_KEPT else [x for x in kept if len(x[0]) <= LONGEST_KEPT])
