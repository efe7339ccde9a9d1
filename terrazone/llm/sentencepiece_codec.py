"""Operator 8: SentencePiece encoding and decoding by streaming Viterbi.

The vocabulary at hand is a BPE model, whose ids are what a sequence of merges leaves, not the sequence of greatest total
score. The lattice is therefore searched with the transition rule that makes both agree: piece b may follow piece a
only if merging the text of a and b together leaves just a and b. Each prefix of a text then has one surviving
path, that of its own BPE encoding, and one backpointer. The search keeps the backpointers of the last positions alone, and of those
a piece may end at; whenever the paths of all of them meet at one boundary, what lies before it is
committed and dropped. No piece holds a space mark after another character, so all paths always meet before a space mark
that follows another character; the stretch between two such boundaries is looked up among those a worker has met
already (a bounded table) before it is searched.

A unigram model (pieces with log probabilities) has ids of greatest total score. UnigramCodec finds them by the Viterbi search as it
is known: every position keeps the best score of a path that ends there and its backpointer, over the window of the longest
piece, and what all paths from the window have in common is committed and dropped. (In a text that repeats one run for ever, paths of equal
score may never meet; it is then kept whole.)

Decoding joins pieces, puts bytes together, turns space marks to spaces and drops the leading one.

Defined cases: null text is empty and has no pieces; characters outside the vocabulary are their UTF-8 bytes; a space mark
in a text (U+2581) is a space, as in the library, so such a text doesn't come back as it was; of unigram paths of equal score the one whose
last piece is longest is taken; repeated rows are encoded each; other columns, whatever their names, are ignored; texts may be of
any length that a row can have, one is held by a worker at a time with its ids, and the search's window doesn't grow with it;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from terrazone.llm.common import map_texts, released

MARK = "▁"
#: Stretches and pairs of pieces that a worker keeps, the longest stretch it keeps, and the positions between two looks for a commit.
KEPT, KEPT_CHARS, LOOK = 250_000, 48, 64
_SPACED = re.compile(" *[^ ]+| +")


class PieceCodec:
    """Pieces of a BPE model file with byte fallback and without normalisation rules."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in plain}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(not sp.is_byte(i) for i in self.byte_ids):
            raise ValueError(f"{path}: a model with byte fallback is needed")
        self.data = [b""] * sp.vocab_size()  # control and unknown pieces stand for no text
        for piece, i in self.ids.items():
            self.data[i] = piece.encode()
        for b, i in enumerate(self.byte_ids):
            self.data[i] = bytes([b])
        # every piece and every character of a piece, by a number; characters outside the vocabulary have numbers from vocab_size on
        self.texts: dict[int, str] = {i: p for p, i in self.ids.items()}
        for c in sorted({c for p in self.ids for c in p} - self.ids.keys()):
            self.texts[sp.vocab_size() + len(self.texts)] = c
        self.automaton = ahocorasick.Automaton()
        for i, p in self.texts.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.texts.values()))
        self.alone = self.span = max(self.texts) + 1  # number of the start and of characters in no piece, and the numbers in all, less one
        self.crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        # by number: its ids, or those of its bytes, as little-endian 32-bit numbers
        self.codes = [b""] * self.alone
        for i, p in self.texts.items():
            self.codes[i] = struct.pack("<i", i) if i < sp.vocab_size() else self.fallback(p)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def fallback(self, text: str) -> bytes:
        """The ids of the bytes of a text, packed."""
        return b"".join(struct.pack("<i", self.byte_ids[b]) for b in text.encode())

    def merge(self, text: str) -> list[str]:
        """Plain BPE of a short text: the best-ranked neighbours merge, the leftmost of equals first."""
        parts = list(text)
        rank = self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, a: int, b: int) -> bool:
        """Whether piece b may follow piece a, or the start or a character in no piece."""
        left, right = self.texts.get(a, ""), self.texts[b]
        if len(self.pairs) >= 4 * KEPT:
            self.pairs.clear()
        found = self.pairs[a * self.span + b] = self.merge(left + right) == ([left, right] if left else [right])
        return found

    def search(self, text: str) -> bytes:
        """Streaming Viterbi over one stretch: its ids, packed.

        The automaton names the pieces that end at each position, longest first; the first that may follow the path to where it
        starts is the last piece of the path to its end. Characters in no piece end a piece of their own.
        """
        done: list[bytes] = []
        base = 0  # committed up to here; start and last hold the positions from here on
        start, last = [0], [self.alone]  # by position: where its last piece starts, and that piece's number
        pairs, span, alone, settled, due = self.pairs, self.span, self.alone, 0, LOOK
        for end, (piece, size) in self.automaton.iter(text):
            if end < settled:
                continue
            while settled < end:
                start.append(settled)
                last.append(alone)
                settled += 1
            at = end + 1 - size
            before = last[at - base]
            stands = pairs.get(before * span + piece)
            if stands is None:
                stands = self.stands(before, piece)
            if not stands:
                continue
            start.append(at)
            last.append(piece)
            settled += 1
            if settled >= due:
                # the last boundary on the paths of all positions from which a later piece may start
                heads = set(range(max(base, settled + 1 - self.longest), settled + 1))
                while len(heads) > 1:
                    head = max(heads)
                    heads.remove(head)
                    heads.add(start[head - base])
                meet = heads.pop()
                if meet > base:
                    done += self._back(text, start, last, base, meet)
                    del start[: meet - base], last[: meet - base]
                    base = meet
                due = settled + LOOK
        for at in range(settled, len(text)):
            start.append(at)
            last.append(alone)
        return b"".join(done + self._back(text, start, last, base, len(text)))

    def _back(self, text: str, start: list[int], last: list[int], base: int, at: int) -> list[bytes]:
        """The ids of the pieces of the path from base to at."""
        found = []
        while at > base:
            piece = last[at - base]
            found.append(self.fallback(text[at - 1]) if piece == self.alone else self.codes[piece])
            at = start[at - base]
        return found[::-1]

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        if not text:
            return b""
        stretches = self.stretches(text.replace(MARK, " "))
        found = list(map(self.known.get, stretches))
        if None in found:
            for i, ids in enumerate(found):
                if ids is None:
                    found[i] = self._met(stretches[i])
        return b"".join(found)

    def stretches(self, text: str) -> list[str]:
        """The stretches of a text between boundaries that all paths meet at; each begins with a space, which is left out."""
        if self.crossing:
            return [text]
        if "  " in f" {text} ":
            return [x[1:] for x in _SPACED.findall(" " + text)]
        return text.split(" ")

    def _met(self, stretch: str) -> bytes:
        """The ids of a stretch that isn't among those met lately."""
        found = self.known.get(stretch) or self.older.get(stretch) or self.search(MARK + stretch.replace(" ", MARK))
        if len(stretch) <= KEPT_CHARS:
            if len(self.known) >= KEPT:
                self.older, self.known = self.known, {}
            self.known[stretch] = found
        return found

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<i4").tolist()

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.data.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


class UnigramCodec:
    """Ids of greatest total score under a unigram model; the pieces' places are their ids. Characters in no piece are `unknown`, at a penalty under the least score."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int = 0, penalty: float = 10.0, look: int = LOOK):
        import ahocorasick

        self.texts, self.unknown, self.look = [p for p, _ in pieces], unknown, look
        self.missing = min((score for _, score in pieces), default=0.0) - penalty
        self.automaton = ahocorasick.Automaton()
        for i, (p, score) in enumerate(pieces):
            if p and i != unknown:
                self.automaton.add_word(p, (i, len(p), score))
        self.automaton.make_automaton()
        self.longest = max((len(p) for p, _ in pieces), default=1)

    def ends(self, text: str):
        """For each position the pieces that end there, longest first."""
        at, held = 0, []
        found = self.automaton.iter(text) if len(self.automaton) else ()
        for end, piece in found:
            while at < end:
                yield at, held
                at, held = at + 1, []
            held.append(piece)
        while at < len(text):
            yield at, held
            at, held = at + 1, []

    def encode(self, text: str, widest: list[int] | None = None) -> list[int]:
        """Ids of the text; the largest window is appended to widest."""
        done: list[int] = []
        base = 0  # committed up to here; the lists hold the positions from here on
        best, start, last = [0.0], [0], [self.unknown]
        for at, pieces in self.ends(text):
            score, begin, number = best[at - base] + self.missing, at, self.unknown
            found = None
            for i, size, worth in pieces:
                if at + 1 - size < base:
                    continue
                total = best[at + 1 - size - base] + worth
                if found is None or total > found[0]:
                    found = total, at + 1 - size, i
            if found is not None and found[0] >= score:
                score, begin, number = found
            best.append(score)
            start.append(begin)
            last.append(number)
            if (at + 1) % self.look == 0:
                # the last boundary on the paths of all positions from which a later piece may start
                heads = set(range(max(base, at + 2 - self.longest), at + 2))
                while len(heads) > 1:
                    head = max(heads)
                    heads.remove(head)
                    heads.add(start[head - base])
                meet = heads.pop()
                if widest is not None:
                    widest.append(len(best))
                if meet > base:
                    done += self._back(start, last, base, meet)
                    del best[: meet - base], start[: meet - base], last[: meet - base]
                    base = meet
        return done + self._back(start, last, base, len(text))

    @staticmethod
    def _back(start: list[int], last: list[int], base: int, at: int) -> list[int]:
        ids = []
        while at > base:
            ids.append(last[at - base])
            at = start[at - base]
        return ids[::-1]

    def decode(self, ids: list[int]) -> str:
        """The text of the ids; what was unknown is lost."""
        return "".join(self.texts[i] for i in ids if i != self.unknown)


@lru_cache(2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def encode_documents(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_pieces, ids, ids_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256 (of what the ids decode to), round_trip."""
    kind = dict(df.dtypes)[id_col]

    def make():
        pieces = codec(model)

        def step(part: pa.RecordBatch) -> dict:
            texts = [t or "" for t in part.column("text").to_pylist()]
            packed = [pieces.packed(t) for t in texts]
            ids = [np.frombuffer(i, "<i4") for i in packed]
            back = [pieces.decode(i.tolist()) for i in ids]
            flat = pa.array(np.frombuffer(b"".join(packed), "<i4"))
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            return {id_col: part.column("id"), "n_pieces": [len(i) for i in ids], "ids": pa.ListArray.from_arrays(pa.array(ends), flat), "ids_sha256": [hashlib.sha256(i).hexdigest() for i in packed], "decoded_sha256": [hashlib.sha256(b.encode()).hexdigest() for b in back], "round_trip": [b == t for b, t in zip(back, texts)]}

        return step

    picked = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return map_texts(picked, make, f"{id_col} {kind}, n_pieces long, ids array<int>, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def decode_documents(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id, text (null ids: empty)."""
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        pieces = codec(model)
        for batch in released(batches):
            yield pa.RecordBatch.from_pydict({id_col: batch.column("id"), "text": pa.array([pieces.decode(i or []) for i in batch.column("ids").to_pylist()], pa.string())})

    return df.select(df[id_col].alias("id"), df[ids_col].alias("ids")).mapInArrow(run, f"{id_col} {kind}, text string")
