"""Exact SentencePiece BPE encoding and decoding by backtracking over a merge vocabulary.

The encoder never runs merges over a whole text.  An Aho-Corasick automaton over the
vocabulary gives the longest piece that starts at a position; a piece may follow another
only if merging the two pieces' text again yields just these two (``compatible``); where
none may follow, the position is marked in a bitfield of failed positions and the last
piece gives way to the next shorter one.  A sequence whose neighbours are all compatible
is the sequence that merging gives, because every merge step is local to two neighbours.

Runs of U+2581 share one merge score, so ties go by place and not by rank.  They come last
of all merges: the text after a run is encoded with one U+2581 before it, and what remains
of the run is merged from the left (``_run``).  No piece holds U+2581 after another
character, so a text falls apart before each run, and also where a mark meets
another character if no piece has both; the parts are encoded alone and kept in a
bounded cache.

Null text counts as empty; an empty text has no ids and decodes to an empty text.  Rows
with a null id are encoded like others; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame

from ._frames import column, field, map_batches, text_or_empty

SPACE = "▁"
#: Marks, symbols and controls, as the inside of a regular expression's set.
MARKS = r"!-/:-@\[-`{-~\x00-\x1f\x7f\xa1-\xa9\xab-\xb4\xb6-\xb9\xbb-\xbf\u2010-\u2027\u2030-\u205e"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Parts whose ids are kept, in each of two generations, and the longest part worth keeping.
CACHE_PARTS, CACHE_CHARS = 200_000, 64
Part = tuple[int, str, tuple[int, ...], bytes]


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = s = 0
    while True:
        c = b[i]
        i += 1
        x |= (c & 127) << s
        if c < 128:
            return x, i
        s += 7


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol buffer message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 1:
            v, i = b[i : i + 8], i + 8
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        elif kind == 5:
            v, i = b[i : i + 4], i + 4
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, v


codecs.register_error("widecairn_each", lambda e: ("\ufffd", e.start + 1))  # a mark for each byte that is part of no character


class Vocabulary:
    """What the encoder needs of a model file: pieces, scores, kinds, normaliser flags."""

    def __init__(self, model: bytes):
        import struct

        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.add_prefix, self.strip_extra, self.escape = True, True, True
        charsmap, model_type, self.byte_fallback = b"", 1, False
        for tag, v in _fields(model):
            if tag == 1:
                p = {1: b"", 2: struct.pack("<f", 0), 3: NORMAL} | dict(_fields(v))
                self.pieces.append(p[1].decode("utf-8"))
                self.scores.append(struct.unpack("<f", p[2])[0])
                self.kinds.append(p[3])
            elif tag == 2:
                t = dict(_fields(v))
                model_type, self.byte_fallback = t.get(3, 1), bool(t.get(35, 0))
                if t.get(24, 0):
                    raise ValueError("white space as a suffix is not supported")
            elif tag == 3:
                n = dict(_fields(v))
                charsmap = n.get(2, b"")
                self.add_prefix, self.strip_extra, self.escape = bool(n.get(3, 1)), bool(n.get(4, 1)), bool(n.get(5, 1))
        if model_type != 2:
            raise ValueError("not a BPE model")
        if charsmap or self.strip_extra or not self.escape or not self.add_prefix or USER in self.kinds:
            raise ValueError("only identity normalisation with a dummy prefix and no user-defined pieces is supported")


_encoders: dict[bytes, tuple[Encoder, Decoder]] = {}


def coder(model: bytes) -> tuple[Encoder, Decoder]:
    """One pair for each worker process and model, so that its cache of parts outlives a task."""
    key = hashlib.sha256(model).digest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = (enc := Encoder(model)), enc.decoder
    return _encoders[key]


class Encoder:
    def __init__(self, model: bytes):
        v = self.v = Vocabulary(model)
        self.decoder = Decoder(model)
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        for i, (p, s, k) in enumerate(zip(v.pieces, v.scores, v.kinds)):
            if k in (NORMAL, UNUSED):
                self.rank[p], self.id[p] = s, i
        self.unk = v.kinds.index(UNKNOWN)
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(v.pieces, v.kinds)) if k == BYTE}
        inner = [p for p in self.rank if SPACE in p.lstrip(SPACE)]
        runs = {len(p): self.rank[p] for p in self.rank if len(p) > 1 and not p.strip(SPACE)}
        words = {p: s for p, s in self.rank.items() if p.strip(SPACE)}
        if inner or any(p.startswith(SPACE * 2) for p in words):
            raise ValueError("a piece goes over the start of a word")
        scores = [s for p, s in words.items() if len(p) > 1]
        if len(set(scores)) < len(scores) or (runs and max(runs.values()) >= min(scores)) or len(set(runs.values())) > 1:
            raise ValueError("two merges of words share a score, or runs of spaces come before words")
        mark = re.compile(f"[{MARKS}]").match
        mixed = any(a != SPACE and bool(mark(a)) != bool(mark(b)) for p in words for a, b in zip(p, p[1:]))
        self._split = self._coarse if mixed else self._fine
        self.runs = set(runs) | {1}
        #: Pieces have numbers from 1; characters that are no piece get theirs when they first occur.
        self.number: dict[str, int] = {}
        self.text: list[str] = [""]
        self.length: list[int] = [0]
        self.out: list[tuple[int, ...]] = [()]
        #: The longest proper prefix of a piece that is a piece or a lone character; 0 for none.
        self.shorter: list[int] = [0]
        self.automaton = ahocorasick.Automaton()
        for p in sorted({*words, *(SPACE * n for n in self.runs)}, key=len):
            number = self._number(p)
            if p in words or p == SPACE:
                self.automaton.add_word(p[::-1], number)
        self.automaton.make_automaton()
        self.ok: dict[int, bool] = {}
        self.cache: dict[str, Part] = {}
        self.older: dict[str, Part] = {}

    def _number(self, piece: str) -> int:
        k = self.number.get(piece)
        if k is None:
            shorter = next((n for n in range(len(piece) - 1, 1, -1) if piece[:n] in self.rank), 1)
            below = self._number(piece[:shorter]) if len(piece) > 1 else 0
            i = self.id.get(piece)
            ids = (i,) if i is not None else tuple(self.byte[b] for b in piece.encode("utf-8")) if self.v.byte_fallback else (self.unk,)
            k = self.number[piece] = len(self.text)
            self.text.append(piece)
            self.length.append(len(piece))
            self.out.append(ids)
            self.shorter.append(below)
        return k

    # -- pieces ---------------------------------------------------------------------

    def _merge(self, text: str) -> list[str]:
        """What merging gives for a short text: highest score first, leftmost on a tie."""
        parts = list(text)
        while len(parts) > 1:
            at, best = -1, float("-inf")
            for i in range(len(parts) - 1):
                s = self.rank.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    at, best = i, s
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' text again yields these two pieces."""
        if len(self.ok) > CACHE_PARTS:
            self.ok.clear()
        a, b = self.text[left], self.text[right]
        found = self.ok[left << 32 | right] = self._merge(a + b) == [a, b]
        return found

    def _longest(self, text: str) -> list[int]:
        """The longest piece that starts at each position: matches of the reversed pieces in the reversed text."""
        n = len(text)
        out, length = [0] * n, self.length
        for end, k in self.automaton.iter(text[::-1]):
            at = n - 1 - end
            if length[k] > length[out[at]]:
                out[at] = k
        if 0 in out:
            for at, k in enumerate(out):
                if not k:
                    out[at] = self._number(text[at])
        return out

    def _word(self, text: str) -> list[int]:
        """Pieces of a text in which U+2581 can only be first, by backtracking."""
        n = len(text)
        longest = self._longest(text)
        piece, length = longest[0], self.length
        if length[piece] == n and (n == 1 or self._merge(text) == [text]):
            return [piece]
        shorter, ok, compatible = self.shorter, self.ok, self.compatible
        failed = bytearray(n // 8 + 1)
        out: list[int] = []
        last = at = 0
        while True:
            end = at + length[piece]
            if not failed[end >> 3] >> (end & 7) & 1:
                fits = not last or ok.get(last << 32 | piece)
                if fits is None:
                    fits = compatible(last, piece)
                if fits:
                    out.append(piece)
                    if end == n:
                        return out
                    last, at, piece = piece, end, longest[end]
                    continue
            piece = shorter[piece]
            while not piece:  # nothing may start here after the last piece
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= length[piece]
                last = out[-1] if out else 0
                piece = shorter[piece]

    def _run(self, n: int) -> list[int]:
        """Pieces of n times U+2581: equal scores, so the leftmost pair that can merge does."""
        parts: list[int] = []
        longest, runs = max(self.runs), self.runs
        whole, rest = divmod(n, longest) if n > 8 * longest else (0, n)
        if whole > 4:  # the run's start is settled: only its last few pieces depend on its length
            parts, rest = [longest] * (whole - 4), rest + 4 * longest
        tail = [1] * rest
        again = True
        while again:
            again = False
            for i in range(len(tail) - 1):
                if tail[i] + tail[i + 1] in runs:
                    tail[i : i + 2] = [tail[i] + tail[i + 1]]
                    again = True
                    break
        return [self.number[SPACE * k] for k in parts + tail]

    def _part(self, part: str) -> tuple[int, ...]:
        """Ids of a run of U+2581 and what follows it up to the next."""
        body = part.lstrip(SPACE)
        n = len(part) - len(body)
        if not body:
            pieces = self._run(n)
        elif n < 2:
            pieces = self._word(part)
        else:
            pieces = self._word(SPACE + body)
            if pieces[0] == self.number[SPACE]:
                pieces = self._run(n) + pieces[1:]
            else:
                pieces = self._run(n - 1) + pieces
        out = self.out
        return tuple([i for k in pieces for i in out[k]])

    #: Parts of a text with spaces for U+2581: before each run of spaces, and where marks meet letters or digits.
    _coarse = re.compile("[ ]+[^ ]*|[^ ]+").findall
    _fine = re.compile(f"[ ]+(?:[^ {MARKS}]+|[{MARKS}]+)?|[^ {MARKS}]+|[{MARKS}]+").findall

    def parts(self, text: str) -> list[Part]:
        """(number of ids, ids in decimal joined by commas, ids, bytes that they decode to) of each part."""
        if not text:
            return []
        cache, out = self.cache, []
        for part in self._split(" " + text.replace(SPACE, " ")):
            found = cache.get(part)
            if found is None:
                found = self.older.get(part)
                if found is None:
                    ids = self._part(part.replace(" ", SPACE))
                    found = len(ids), ",".join(map(str, ids)), ids, self.decoder.raw(ids)
                if len(part) <= CACHE_CHARS:
                    if len(cache) >= CACHE_PARTS:
                        self.older, cache = cache, {}
                        self.cache = cache
                    cache[part] = found
            out.append(found)
        return out

    def encode(self, text: str | None) -> list[int]:
        return [i for part in self.parts(text or "") for i in part[2]]


class Decoder:
    def __init__(self, model: bytes):
        v = Vocabulary(model)
        self.bytes: list[bytes] = []
        self.is_byte = bytes(k == BYTE for k in v.kinds)
        for p, k in zip(v.pieces, v.kinds):
            if k == BYTE:
                self.bytes.append(bytes([int(p[3:5], 16)]))
            elif k == CONTROL:
                self.bytes.append(b"")
            elif k == UNKNOWN:
                self.bytes.append(" ⁇ ".encode())
            else:
                self.bytes.append(p.replace(SPACE, " ").encode("utf-8"))

    def raw(self, ids) -> bytes:
        table = self.bytes
        return b"".join([table[i] for i in ids])

    def finish(self, raw: bytes, ids) -> str:
        """Text of the bytes of pieces, given the first ids: bytes that make no character become U+FFFD, one dummy prefix is taken off."""
        out = raw.decode("utf-8", "widecairn_each")
        first = next((i for i in ids if self.bytes[i]), 0)
        return out[1:] if self.bytes[first][:1] == b" " and not self.is_byte[first] else out

    def decode(self, ids: list[int]) -> str:
        return self.finish(self.raw(ids), ids)


def encode_decode(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", with_output: bool = True) -> DataFrame:
    """Ids of every whole text and the text that they decode to.

    ``model`` is the content of a model file (a fixed file of under a MB, so it may travel
    with the tasks).  Returns the id column, ids array<int>, n_tokens long, decoded string,
    and the digests ids_sha256 and decoded_sha256; without ``with_output`` only the counts
    and digests.  One row per row, repeated or not; other columns of any name are ignored.
    """
    names = f"{field(df, id_col)}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_output

    def run(batches):
        enc, dec = coder(model)
        for b in batches:
            out = {n: [] for n in ("n", "i", "d", "ids", "text")}
            for text in b["_text"]:
                parts = enc.parts(text)
                # Decoding strings bytes of pieces together, so a part's bytes can be kept as its ids are.
                text = dec.finish(b"".join([p[3] for p in parts]), parts[0][2] if parts else ())
                out["n"].append(sum([p[0] for p in parts]))
                out["i"].append(hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest())
                out["d"].append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                if with_output:
                    out["ids"].append([i for p in parts for i in p[2]])
                    out["text"].append(text)
            yield {id_col: b["_id"], "n_tokens": out["n"], "ids_sha256": out["i"], "decoded_sha256": out["d"], "ids": out["ids"], "decoded": out["text"]}

    return map_batches(df.select(column(id_col).alias("_id"), text_or_empty(text_col).alias("_text")), run, names)
