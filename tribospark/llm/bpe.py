"""BPE encoding and decoding as streams, with a bounded lookahead.

Encoding reads symbols from left to right. For each end position it keeps the last token of the
encoding of the text so far: the longest token whose neighbour on the left, which is known, stays apart from it
under the merge list. So all encodings of prefixes form a tree, and a token is stable once every
position that a later token may start from descends from it. How far a later symbol can reach back
follows from the merge list (Berglund and van der Merwe, 2023): ``lookahead`` is the longest chain of
merges of which each, being of higher priority, takes away a symbol from the one before.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces in each of the two generations that a worker remembers, and neighbour tests, at most.
PIECES, NEIGHBOURS = 150_000, 150_000
#: Texts encoded into one result batch, which bounds a task's memory.
ROWS = 500
END = "</w>"
NEVER = 1 << 40


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if it is printable Latin-1, else the next letter from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


LETTERS = byte_letters()
TO_LETTERS = dict(enumerate(LETTERS))
FROM_LETTERS = {letter: bytes([b]) for b, letter in enumerate(LETTERS)}


@dataclass(frozen=True)
class Vocabulary:
    """What a tokenizer file says: tokens by id, merges by priority, the piece pattern, whole-text tokens."""

    tokens: tuple[str, ...]
    merges: tuple[tuple[str, str], ...]
    pattern: str
    specials: tuple[tuple[str, int], ...]
    digest: str


def read_vocabulary(path: str) -> Vocabulary:
    """Reads a BPE file with word ends, as JSON, where the driver runs; tasks get the result."""
    with open(path, encoding="utf-8") as file:
        content = file.read()
    data = json.loads(content)
    ids = dict(data["model"]["vocab"])
    specials = tuple((t["content"], t["id"]) for t in data["added_tokens"])
    ids.update(specials)
    tokens = [""] * (max(ids.values()) + 1)
    for token, at in ids.items():
        tokens[at] = token
    split = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
    merges = tuple(tuple(m.split(" ") if isinstance(m, str) else m) for m in data["model"]["merges"])
    return Vocabulary(tuple(tokens), merges, split, specials, hashlib.sha256(content.encode()).hexdigest())


class Merges:
    """Ids, spines and neighbour tests of a merge list."""

    def __init__(self, vocabulary: Vocabulary):
        special = {at for _, at in vocabulary.specials}
        self.ids = {t: i for i, t in enumerate(vocabulary.tokens) if t and i not in special}
        self.rank, self.parts, self.birth = {}, {}, {}
        for rank, (left, right) in enumerate(vocabulary.merges):
            a, b, made = self.ids[left], self.ids[right], self.ids[left + right]
            self.rank[a, b] = rank
            self.parts.setdefault(made, (a, b))
            self.birth.setdefault(made, rank)
        self.size = {i: len(t.removesuffix(END)) for t, i in self.ids.items()}
        self.longest = max(self.size.values())
        self.reach, self.reach_end = self._reach("", END), self._reach(END, "")
        self.right = {i: self._spine(i, 1) for i in self.ids.values()}
        self.left = {i: self._spine(i, 0) for i in self.ids.values()}
        self.lookahead = self._lookahead()
        self.known: dict[int, bool] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols at one edge while the token is put together, each with the rank that ends it."""
        out, ends = [(token, NEVER)], NEVER
        while token in self.parts:
            ends, token = self.birth[token], self.parts[token][side]
            out.append((token, ends))
        return out

    def _reach(self, end: str, other: str) -> dict[str, int]:
        """For the last three symbols of a token, with or without a word end, the length of the longest such token."""
        out: dict[str, int] = {}
        for token in self.ids:
            if token.endswith(end) and not (other and token.endswith(other)):
                plain = token.removesuffix(END) if end else token
                if len(plain) > 2:
                    out[plain[-3:]] = max(out.get(plain[-3:], 0), len(plain))
        return out

    def _lookahead(self) -> int:
        """Symbols to the right that can still change a token's end.

        A merge of u and v is undone only if a merge of higher priority takes v's right edge, which a yet
        higher one may undo: its reach is v and the farthest reach of those.
        """
        farthest: dict[int, int] = {}
        for a, b in self.rank:  # in order of priority
            beyond = max((farthest.get(edge, 0) for edge, _ in self.right[b]), default=0)
            farthest[a] = max(farthest.get(a, 0), self.size[b] + beyond)
        return max(farthest.values(), default=0) + self.longest

    def apart(self, a: int, b: int) -> bool:
        """Whether a and b stay two tokens side by side: no merge joins their edges before both are made.

        Of two equal merges the left one goes first: b's own merge of that rank comes too late, a's does not.
        """
        key = a << 20 | b
        found = self.known.get(key)
        if found is None:
            found = True
            for x, x_ends in self.right[a]:
                for y, y_ends in self.left[b]:
                    rank = self.rank.get((x, y))
                    if rank is not None and rank < x_ends and rank <= y_ends:
                        if self.birth.get(x, -1) < y_ends and self.birth.get(y, -1) < x_ends:
                            found = False
            if len(self.known) >= NEIGHBOURS:
                self.known.clear()
            self.known[key] = found
        return found


class Encoder:
    """Feeds on the symbols of one piece and gives back tokens as soon as they are stable."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.tail = ""  # the last symbols, as many as the longest token has
        self.nodes: list[tuple[int, int]] = [(-1, -1)]  # (last token, where it starts) of each open end
        self.first = 0  # the position of nodes[0], up to which all is given back
        self.checked = 0

    def _end(self, end: str) -> None:
        merges, at = self.merges, self.first + len(self.nodes)
        for size in range(min(len(self.tail), merges.longest), 0, -1):
            start = at - size
            if start < self.first:
                continue
            token = merges.ids.get(self.tail[-size:] + end)
            if token is None:
                continue
            before = self.nodes[start - self.first][0]
            if before < 0 or merges.apart(before, token):
                self.nodes.append((token, start))
                return
        self.nodes.append((-1, -1))  # no prefix encoding ends here: only before the first symbol of a final piece

    def _stable(self, ends: Iterable[int]) -> list[int]:
        """Tokens up to the nearest common ancestor of the given positions; forgets what is before it."""
        open_ = {e for e in ends if e == self.first or self.nodes[e - self.first][1] >= 0}
        while len(open_) > 1:
            last = max(open_)
            open_.discard(last)
            open_.add(self.nodes[last - self.first][1])
        at = common = open_.pop()
        out = []
        while at > self.first:
            token, at = self.nodes[at - self.first]
            out.append(token)
        self.nodes = self.nodes[common - self.first :]
        self.first = common
        return out[::-1]

    def feed(self, symbol: str) -> list[int]:
        self.tail = (self.tail + symbol)[-self.merges.longest :]
        self._end("")
        at = self.first + len(self.nodes) - 1
        if at - self.checked < self.merges.lookahead:
            return []
        self.checked = at
        return self._stable(range(max(self.first, at - self.merges.longest), at + 1))

    def finish(self, symbol: str) -> list[int]:
        """The last symbol of the piece, which carries the word end."""
        self.tail = (self.tail + symbol)[-self.merges.longest :]
        self._end(END)
        return self._stable([self.first + len(self.nodes) - 1])


def encode_window(symbols: str, merges: Merges) -> list[int]:
    """A piece no longer than the lookahead: the same transducer, all given back at its end."""
    n = len(symbols)
    last, start = [-1] * (n + 1), [0] * (n + 1)
    ids, known, reach = merges.ids, merges.known, merges.reach
    for at in range(1, n + 1):
        if at == n:
            symbols, reach = symbols + END, merges.reach_end
        stop = at if at < n else len(symbols)
        first = at - reach.get(symbols[at - 3 : at], 2) if at > 2 else 0
        for begin in range(first if first > 0 else 0, at):
            token = ids.get(symbols[begin:stop])
            if token is None:
                continue
            before = last[begin]
            if begin == 0 or before >= 0 and (known[k] if (k := before << 20 | token) in known else merges.apart(before, token)):
                last[at], start[at] = token, begin
                break
    out, at = [], n
    while at > 0:
        out.append(last[at])
        at = start[at]
    return out[::-1]


def encode_piece(piece: str, merges: Merges) -> list[int]:
    """Token ids of one piece; long pieces are streamed and take constant memory besides the result."""
    symbols = piece if piece.isascii() else piece.encode().decode("latin-1").translate(TO_LETTERS)
    if piece.isascii() and not piece.isprintable():
        symbols = piece.translate(TO_LETTERS)
    if len(symbols) <= merges.lookahead:
        return encode_window(symbols, merges)
    encoder, out = Encoder(merges), []
    for symbol in symbols[:-1]:
        out += encoder.feed(symbol)
    return out + encoder.finish(symbols[-1])


class Pieces(dict):
    """Ids, as bytes, of pieces met before. When full it becomes the older generation, from which pieces
    that are met again come back, so frequent ones stay in bounded memory."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = np.array(encode_piece(piece, self.merges), np.int32).tobytes()
        if len(self) >= PIECES:
            self.older = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Tokenizer:
    def __init__(self, vocabulary: Vocabulary):
        self.pieces = Pieces(Merges(vocabulary))
        self.pattern = regex.compile(vocabulary.pattern)
        names = [regex.escape(name) for name, _ in vocabulary.specials]
        self.special = regex.compile("(" + "|".join(names) + ")") if names else None
        self.special_ids = {name: np.array([at], np.int32).tobytes() for name, at in vocabulary.specials}
        self.names = vocabulary.specials

    def _plain(self, text: str) -> bytes:
        """Composed, lower-cased letter by letter (a final sigma like any other), cut into pieces."""
        lower = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(lower)))

    def encode(self, text: str) -> bytes:
        """Ids of a text as int32 bytes. Special tokens in the text become their ids."""
        if not any(name in text for name, _ in self.names):
            return self._plain(text)
        return b"".join(self.special_ids.get(part) or self._plain(part) for part in self.special.split(text))


class Speller:
    """What ids stand for; needs no merges."""

    def __init__(self, vocabulary: Vocabulary):
        special = {name for name, _ in vocabulary.specials}
        self.token_bytes = pa.array([t.encode() + b" " for t in vocabulary.tokens], pa.large_binary())
        self.spelled = [
            t.encode() if t in special else b"".join(FROM_LETTERS[c] for c in t.removesuffix(END)) + b" " * t.endswith(END)
            for t in vocabulary.tokens
        ]

    def decode_tokens(self, ids: pa.Array) -> bytes:
        """The tokens themselves with a space between them, as a decoder without rules joins them."""
        taken = pc.take(self.token_bytes, ids)
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
        return memoryview(taken.buffers()[2])[ends[0] : ends[-1] - 1].tobytes() if len(taken) else b""

    def decode_bytes(self, ids: Iterable[int]) -> Iterator[bytes]:
        """The bytes that the tokens stand for; word ends become spaces."""
        spelled = self.spelled
        return (spelled[i] for i in ids)


class Utf8Stream:
    """Bytes in, text out: keeps an unfinished character until its other bytes come; what is no UTF-8 becomes U+FFFD."""

    def __init__(self):
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self.machine.decode(data)

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


def decode_text(speller: Speller, ids: Iterable[int]) -> Iterator[str]:
    """Text of a stream of ids, piece by piece; a token may end inside a character."""
    stream = Utf8Stream()
    for data in speller.decode_bytes(ids):
        if part := stream.feed(data):
            yield part
    if part := stream.finish():
        yield part


def decode_ids(speller: Speller, ids: pa.Array, words: bool) -> str:
    if words:
        return "".join(decode_text(speller, ids.to_pylist()))
    stream = Utf8Stream()
    return stream.feed(speller.decode_tokens(ids)) + stream.finish()


_READY: dict[tuple[type, str], object] = {}


def ready(kind: type, vocabulary: Vocabulary):
    """One tokenizer or speller for each Python worker and vocabulary."""
    key = (kind, vocabulary.digest)
    if key not in _READY:
        _READY[key] = kind(vocabulary)
    return _READY[key]


def encode(
    documents: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", keep_text: bool = True, decoded: str | None = None
) -> DataFrame:
    """The columns of ``documents`` and ``ids`` array<int>; a null text counts as empty, which has no ids.

    A column of ``documents`` named as ``ids`` or ``decoded`` is replaced; the text is left out unless ``keep_text``. With
    ``decoded`` the ids are decoded again in the same pass, as ``decode`` does it.
    """
    added = [ids] + [decoded] * bool(decoded)
    kept = [f for f in documents.schema.fields if f.name not in added and (keep_text or f.name != text)]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = ready(Tokenizer, vocabulary)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                rows = [tokenizer.encode(t.as_py() or "") for t in batch.column("__text")]
                ends = np.cumsum([0, *map(len, rows)]) // 4
                values = pa.array(np.frombuffer(b"".join(rows), np.int32))
                columns = [*(batch.column(f.name) for f in kept), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)]
                if decoded:
                    speller = ready(Speller, vocabulary)
                    spans = zip(ends[:-1].tolist(), ends[1:].tolist())
                    columns.append(pa.array([decode_ids(speller, values.slice(a, b - a), False) for a, b in spans], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in kept), *added])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + f"`{ids}` array<int>" + (f", `{decoded}` string" if decoded else "")
    source = documents.select(*[f"`{f.name}`" for f in kept], F.col(f"`{text}`").alias("__text"))
    return source.mapInArrow(make, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", decoded: str = "decoded", words: bool = False) -> DataFrame:
    """The columns of ``encoded`` and ``decoded`` string.

    By default the tokens as they are, joined by spaces, which is what the library's decode gives for a
    file without a decoder. ``words`` gives the text that they stand for. No ids, or null, give an empty text.
    """
    kept = [f for f in encoded.schema.fields if f.name != decoded]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = ready(Speller, vocabulary)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                lists = (v.values if v.is_valid else pa.array([], pa.int32()) for v in batch.column(ids))
                texts = pa.array([decode_ids(speller, own, words) for own in lists], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), texts], names=[*(f.name for f in kept), decoded])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return encoded.mapInArrow(make, f"{schema}, `{decoded}` string")
