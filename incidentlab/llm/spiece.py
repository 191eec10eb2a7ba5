"""SentencePiece BPE encoding by backtracking, and decoding.

BPE merges the adjacent pair with the best score (leftmost on ties) until none
is left.  A token sequence is the result of that if and only if each token is
what merging its own characters gives and every two neighbours stay apart when
their characters are merged together.  So the encoder takes the longest
matching piece at each place (all matches come from one Aho-Corasick pass),
checks it against the token before by re-merging the two (kept per pair), falls
back to the next shorter piece, and on a dead end steps back one token, marking
the place as failed in a bitfield so that it is entered once only.

No piece of the supported models has the space mark after another character, so
a text is cut before each run of space marks and every cut part is encoded on
its own and remembered, whatever the text's length.

Edge cases: null counts as empty and gives begin and end ids only; very long
texts and very long runs without spaces are encoded whole; characters outside
the vocabulary become byte pieces.  Rows and other columns do not influence each
other; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_text, map_rows

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: remembered parts per worker process; beyond, the memory starts anew
MEMO_ENTRIES = 700_000
#: longer parts are encoded without being remembered
MEMO_CHARS = 48


def _fields(data: bytes):
    """(field number, value) pairs of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield number, data[at:at + size]
        at += size


class Model:
    """Pieces and settings of a SentencePiece BPE model file's bytes."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer: dict = {}
        normalizer: dict = {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.bos, self.eos, self.unk = trainer.get(41, 1), trainer.get(42, 2), trainer.get(40, 0)
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.types[i] == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.types[i] == BYTE}
        odd = [what for what, bad in (
            ("model type", trainer.get(3, 1) != 2), ("byte fallback", len(self.byte_ids) != 256),
            ("character map", bool(normalizer.get(2))), ("white space removal", normalizer.get(4, 1) != 0),
            ("user-defined or unused pieces", bool({USER, UNUSED} & set(self.types))),
            ("space inside a piece", any(SPACE in p.lstrip(SPACE) for p in self.ids)),
            ("piece with a character that is no piece", any(c not in self.ids for p in self.ids for c in p)),
        ) if bad]
        if odd:
            raise ValueError(f"unsupported SentencePiece model: {', '.join(odd)}")


class Codec:
    """Encoder and decoder over a Model; keeps what it has worked out."""

    def __init__(self, data: bytes):
        self.model = m = Model(data)
        self._automaton = ahocorasick.Automaton()
        for piece, i in m.ids.items():
            self._automaton.add_word(piece, (len(piece) - 1, i))
        self._automaton.make_automaton()
        self._fits: dict[tuple[int, int], bool] = {}
        self._grown: dict[int, tuple | None] = {}
        self._shorter: dict[int, int] = {}
        self._length = {i: len(p) for p, i in m.ids.items()}
        # what is neither text nor byte is no UTF-8 either, and so goes the stepwise way
        self._raw = [bytes([int(p[3:5], 16)]) if k == BYTE else
                     p.replace(SPACE, " ").encode() if k == NORMAL else b"\xff"
                     for p, k in zip(m.pieces, m.types)]
        self._plain_breaks = m.dummy_prefix and "\n" not in m.ids
        self._parts = _Memo(self._packed)

    @staticmethod
    def _pack(ids) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    # -- encoding

    def merged(self, text: str, stop: int = 1) -> list[str]:
        """Plain BPE over a short text, by definition; down to ``stop`` parts."""
        ids, scores, parts = self.model.ids, self.model.scores, list(text)
        while len(parts) > stop:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _growth(self, token: int) -> tuple[list[str], list[float], list[str], list[float]] | None:
        """How the token grows at its right edge and at its left edge when its
        characters are merged: the pieces that hold the edge, from the single
        character up, and the score at which each is merged into the next.
        None if its own characters merge to something else."""
        if token in self._grown:
            return self._grown[token]
        ids, scores, pieces = self.model.ids, self.model.scores, self.model.pieces
        piece, grown = pieces[token], None
        if len(piece) == 1:
            grown = ([piece], [], [piece], [])
        else:
            halves = self.merged(piece, stop=2)
            if len(halves) == 2:
                left, right = (self._growth(ids[h]) for h in halves)
                score = scores[token]
                grown = (right[0] + [piece], right[1] + [score], left[2] + [piece], left[3] + [score])
        self._grown[token] = grown
        return grown

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are beside each other; ``left``
        -1: whether ``right`` is what its own characters merge to.

        Only pieces at the common edge can merge across it, so the two edges
        are re-merged step by step, always the better score first; the tokens
        fall together if a piece across the edge comes before either's next
        step (on equal scores the leftmost merge comes first).
        """
        known = self._fits.get((left, right))
        if known is not None:
            return known
        b = self._growth(right)
        a = self._growth(left) if left >= 0 else b
        known = a is not None and b is not None
        if known and left >= 0:
            ids, scores = self.model.ids, self.model.scores
            (edge_a, next_a, _, _), (_, _, edge_b, next_b) = a, b
            i = j = 0
            while True:
                up_a = next_a[i] if i < len(next_a) else None
                up_b = next_b[j] if j < len(next_b) else None
                across = ids.get(edge_a[i] + edge_b[j])
                if across is not None:
                    score = scores[across]
                    if (up_a is None or score > up_a) and (up_b is None or score >= up_b):
                        known = False
                        break
                if up_a is None and up_b is None:
                    break
                if up_b is None or (up_a is not None and up_a >= up_b):
                    i += 1
                else:
                    j += 1
        if len(self._fits) > MEMO_ENTRIES:
            self._fits.clear()
        self._fits[left, right] = known
        return known

    def _next_shorter(self, token: int) -> int:
        """The longest piece that is a proper prefix of the token's, or -1."""
        known = self._shorter.get(token)
        if known is None:
            piece, known = self.model.pieces[token], -1
            for n in range(len(piece) - 1, 0, -1):
                if piece[:n] in self.model.ids:
                    known = self.model.ids[piece[:n]]
                    break
            self._shorter[token] = known
        return known

    def _known(self, text: str) -> list[int]:
        """Token ids of a text all of whose characters are pieces."""
        n, length, fits = len(text), self._length, self._fits
        longest = [-1] * n
        for end, (back, i) in self._automaton.iter(text):
            longest[end - back] = i                     # a start's matches come shortest first
        open_ = None                                    # bit p: place p has not failed yet
        tokens: list[int] = []
        place, last, token = 0, -1, longest[0]
        while place < n:
            while token >= 0:
                end = place + length[token]
                if open_ is None or open_[end >> 3] >> (end & 7) & 1:
                    fit = fits.get((last, token))
                    if fit or (fit is None and self._compatible(last, token)):
                        break
                token = self._next_shorter(token)
            if token >= 0:
                tokens.append(token)
                place, last = end, token
                token = longest[place] if place < n else -1
            else:                                       # dead end: one token back, try a shorter one
                if open_ is None:
                    open_ = bytearray(b"\xff" * (n // 8 + 1))
                open_[place >> 3] &= ~(1 << (place & 7)) & 255
                token = tokens.pop()
                place -= length[token]
                token = self._next_shorter(token)
                last = tokens[-1] if tokens else -1
        return tokens

    def _part(self, part: str) -> list[int]:
        ids = self.model.ids
        if all(map(ids.__contains__, part)):
            return self._known(part)
        out, lo = [], 0
        for k, c in enumerate(part):
            if c not in ids:
                if k > lo:
                    out += self._known(part[lo:k])
                out += [self.model.byte_ids[b] for b in c.encode()]
                lo = k + 1
        if lo < len(part):
            out += self._known(part[lo:])
        return out

    def _packed(self, key: str) -> bytes:
        """Ids of a part; a space mark goes before keys that do not start with
        one or with a line break."""
        return self._pack(self._part(key if key[:1] in (SPACE, "\n") else SPACE + key))

    def encode_parts(self, text: str) -> list[bytes]:
        """The ids of a text part by part, as little-endian 32-bit integers,
        without begin and end ids."""
        if not text:
            return []
        parts = self._parts
        if (self._plain_breaks and "  " not in text and " \n" not in text and SPACE not in text
                and text[0] != " "):
            # single spaces only; a line break is no piece, so a part may start at it
            return [parts[p] for p in text.replace("\n", " \n").split(" ")]
        text = text.replace(" ", SPACE)
        if self.model.dummy_prefix:
            text = SPACE + text
        elif text[0] != SPACE:                          # the first part has no space mark to share
            cut = (text + SPACE).index(SPACE)
            return [self._pack(self._part(text[:cut])), *(parts[p] for p in _PART.findall(text[cut:]))]
        return [parts[p] for p in _PART.findall(text)]

    def encode(self, text: str) -> list[int]:
        packed = b"".join(self.encode_parts(text))
        return [self.model.bos, *struct.unpack(f"<{len(packed) // 4}I", packed), self.model.eos]

    # -- decoding

    def decode(self, ids) -> str:
        """Text of the ids: pieces joined, space marks as spaces without the
        prefix space, runs of byte pieces as UTF-8 (a bad byte as U+FFFD)."""
        m = self.model
        lo, hi = int(len(ids) > 0 and ids[0] == m.bos), len(ids)
        hi -= hi > lo and ids[hi - 1] == m.eos
        try:
            text = b"".join(map(self._raw.__getitem__, ids[lo:hi])).decode()
        except UnicodeDecodeError:
            return self._decode_stepwise(ids[lo:hi])
        marked = m.dummy_prefix and text.startswith(" ") and m.types[ids[lo]] == NORMAL
        return text[1:] if marked else text

    def _decode_stepwise(self, ids) -> str:
        m, out, raw = self.model, [], b""
        at_start = m.dummy_prefix
        for i in (*ids, m.eos):
            kind = m.types[i]
            if kind == BYTE:
                raw += self._raw[i]
                at_start = False
                continue
            out.append(_replaced(raw))
            raw = b""
            if kind == CONTROL:
                continue
            piece = " ⁇ " if kind == UNKNOWN else m.pieces[i]
            if at_start and piece.startswith(SPACE):
                piece = piece[1:]
            at_start = False
            out.append(piece.replace(SPACE, " "))
        return "".join(out)


_PART = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _replaced(raw: bytes) -> str:
    """UTF-8 with every byte that is part of no character as one U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at:at + e.start].decode() + "\ufffd")
            at += e.start + 1
    return "".join(out)


class _Memo(dict):
    """Remembers what ``make`` gave for short keys; starts anew when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[key] = value
        return value


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = True) -> DataFrame:
    """One row per document: id, ``n_tokens`` (begin and end ids counted),
    ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers),
    ``decoded_sha256`` (of the decoded text), and with ``with_ids`` the
    ``ids`` and the ``decoded`` text themselves.

    The model file is read by the driver and shipped as bytes; its size, not
    the corpus, bounds the broadcast.
    """
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast({"model": f.read()})

    def make():
        kept = shared.value                     # lives as long as the worker process
        codec = kept.get("codec") or kept.setdefault("codec", Codec(kept["model"]))
        bos, eos = (struct.pack("<I", i) for i in (codec.model.bos, codec.model.eos))

        def work(ids, texts):
            out = {"id": ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            if with_ids:
                out |= {"ids": [], "decoded": []}
            for text in map(pa.StringScalar.as_py, texts):
                packed = b"".join([bos, *codec.encode_parts(text), eos])
                tokens = struct.unpack(f"<{len(packed) // 4}I", packed)
                decoded = codec.decode(tokens)
                out["n_tokens"].append(len(tokens))
                out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    out["ids"].append(tokens)
                    out["decoded"].append(decoded)
            return out
        return work

    slim = docs.select(F.col(id_col).cast("long").alias("id"), clean_text(text_col).alias("t"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"
    return map_rows(slim, schema, make).withColumnRenamed("id", id_col)
