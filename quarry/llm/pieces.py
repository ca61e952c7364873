"""SentencePiece (merge-type) encoding by backtracking, and decoding.

Encoding finds, from left to right, the longest piece that starts at each position (Aho-Corasick), takes it if
it is compatible with the piece before it, else tries that piece's shorter prefixes, and goes back one piece
when none fits; a field of flags keeps the positions from which no encoding goes on. Two adjacent pieces are
compatible if merging the characters of both again, best score first, yields just these two.

A text is cut where no piece can span: at white space marks, and between two characters that
never stand side by side in any piece. The cuts change no result; they let words be encoded once and kept.

Null and empty texts have no ids. Characters outside the vocabulary become byte pieces. Texts of any length
are encoded whole, in time that grows with their length. Rows with null ids, repeated rows and rows with other columns,
whatever their names, are encoded like any other. What a Python worker keeps is bounded in bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from .common import texts, trimmed

MARK = "▁"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Bytes of words and their ids in a generation of those that a Python worker keeps, and pairs whose compatibility it knows.
BYTES_KEPT, PAIRS_KEPT = 32 << 20, 200_000


class PieceModel:
    """The vocabulary of a merge-type model with byte fallback, and its exact encoder and decoder."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) for i in range(len(self.pieces))]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.scores = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.bytes = {}
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.hidden = {i for i in range(len(self.pieces)) if sp.is_control(i)}
        self.unknown = sp.unk_id()
        self.letters = frozenset("".join(self.ids))
        self.id_text = {p: str(i) for p, i in self.ids.items()}
        self.beside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self._pairs: dict[str, dict[str, bool]] = defaultdict(dict)
        self._known_pairs = 0
        #: pieces that merging their own characters yields; no other piece is ever the outcome
        self.whole = {p for p in self.ids if len(p) == 1 or len(self.merge(p)) == 1}
        #: the next shorter piece that a piece begins with
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.whole), None) for p in self.whole}
        self.trie = ahocorasick.Automaton()
        for p in self.whole:
            self.trie.add_word(p, p)
        self.trie.make_automaton()

    # -- merging, for compatibility checks ---------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """Merges neighbours, best score first and leftmost among equals, until no pair is a piece."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = scores.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        known = self._pairs[left].get(right)
        if known is None:
            if self._known_pairs > PAIRS_KEPT:
                self._pairs.clear()
                self._known_pairs = 0
            # no piece may even span the seam: then both stay
            known = (left[-1] + right[0]) not in self.beside or self.merge(left + right) == [left, right]
            self._pairs[left][right] = known
            self._known_pairs += 1
        return known

    # -- encoding ----------------------------------------------------------------------------------------

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a text whose characters are all in the vocabulary.

        Longest matches are read from left to right; where another piece was taken, the reading starts anew behind it.
        """
        n, pairs, shorter, read = len(text), self._pairs, self.shorter, self.trie.iter_long
        open_at = bytearray(b"\1" * (n + 1))  # whether an encoding may still go on from each position
        out: list[str] = []
        pos, last = 0, None
        matches = read(text)
        p, own = next(matches)[1], True
        while True:
            end = pos + len(p)
            fits = open_at[end]
            if fits and last is not None:
                fits = pairs[last].get(p)
                if fits is None:
                    fits = self.compatible(last, p)
            if fits:
                out.append(p)
                if end == n:
                    return out
                pos, last = end, p
                if not own:
                    matches, own = read(text, pos), True
                p = next(matches)[1]
                continue
            own = False
            p = shorter[p]
            while p is None:  # none fits here: one piece back
                if not out:
                    raise ValueError(f"no encoding of {text!r}")
                open_at[pos] = 0
                p = out.pop()
                pos -= len(p)
                last = out[-1] if out else None
                p = shorter[p]

    def segment(self, text: str) -> list[int]:
        """Ids of a segment: marks then characters, cut wherever no piece spans."""
        out: list[int] = []
        for part in self.parts(text):
            out += self.part(part)
        return out

    def parts(self, text: str) -> list[str]:
        """The text cut between all neighbours that stand side by side in no piece."""
        beside, cuts = self.beside, [0]
        cuts += [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in beside]
        cuts.append(len(text))
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def part(self, part: str) -> list[int]:
        """Ids of a part without further cuts."""
        ids = self.ids
        if len(part) > 1:
            return [ids[p] for p in ([part] if part in self.whole else self.backtrack(part))]
        if part in ids:
            return [ids[part]]
        return [self.bytes[b] for b in part.encode("utf-8", "surrogatepass")]

    def segments(self, text: str) -> list[str]:
        """The text with its mark in front and spaces as marks, cut before each run of marks."""
        if not text:
            return []
        if "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        marked = MARK + text.replace(" ", MARK)
        return [s[1:] if s[0] == MARK and s[1:2] != MARK and len(s) > 1 else "\0" + s for s in re.findall(f"{MARK}+[^{MARK}]*", marked)]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for s in self.segments(text):
            out += self.segment(self.marked(s))
        return out

    @staticmethod
    def marked(seg: str) -> str:
        """segments() gives words bare; what begins with several marks, or is marks alone, has a zero byte in front."""
        return seg[1:] if seg[:2] == "\0" + MARK else MARK + seg

    # -- decoding ----------------------------------------------------------------------------------------

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, marks as spaces, without the one in front; byte pieces as UTF-8, each bad byte as U+FFFD."""
        out: list[str] = []
        run = bytearray()
        front = True
        for i in ids:
            b = self.of_byte.get(i)
            if b is not None:
                run.append(b)
                front = False
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i in self.hidden:
                continue
            p = " ⁇ " if i == self.unknown else self.pieces[i]
            if front and p.startswith(MARK):
                p = p[1:]
            front = False
            out.append(p.replace(MARK, " ") if i != self.unknown else p)
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)


def _utf8(run: bytes) -> str:
    """UTF-8, where each byte that begins no valid character becomes U+FFFD by itself."""
    out, k = [], 0
    while k < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[k : k + size].decode("utf-8"))
                k += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            k += 1
    return "".join(out)


class _Words:
    """Segment -> (its ids as text, their number, decoded text), kept in two generations."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.young: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}
        self.size = 0

    def all(self, segments: list[str]) -> list[tuple[str, int, str]]:
        """What each segment stands for."""
        young = self.young
        found = list(map(young.get, segments))
        size = 0
        for k, x in enumerate(found):
            if x is None:
                seg = segments[k]
                x = self.old.get(seg) or self.segment(seg)
                found[k] = young[seg] = x
                size += len(seg) + len(x[0]) + len(x[2]) + 250
        self.size += size
        if self.size > BYTES_KEPT:
            self.old, self.young, self.size = young, {}, 0
        return found

    def segment(self, seg: str) -> tuple[str, int, str]:
        model = self.model
        text = model.marked(seg)
        if model.letters.issuperset(text):
            found = model.backtrack(text)
            return ",".join([model.id_text[p] for p in found]), len(found), text.replace(MARK, " ")
        # end marks that no piece joins to what stands before them
        end = len(text)
        while end > 1 and text[end - 2 : end] not in model.beside and text[end - 1] != MARK:
            end -= 1
        known = self.part(text[:end])
        if end < len(text):
            parts = [known, *map(self.part, text[end:])]
            known = (",".join([f[0] for f in parts]), sum([f[1] for f in parts]), "".join([f[2] for f in parts]))
        return known

    def part(self, text: str) -> tuple[str, int, str]:
        """The same of a part; parts do not depend on what stands beside them."""
        model = self.model
        if model.letters.issuperset(text):
            found = [text] if text in model.whole else model.backtrack(text)
            return ",".join([model.id_text[p] for p in found]), len(found), text.replace(MARK, " ")
        ids = model.segment(text)
        # decoded behind another word, so that the mark stays a space
        return ",".join(map(str, ids)), len(ids), model.decode([model.ids[MARK], *ids])


_words: dict[str, _Words] = {}


def words_of(path: str) -> _Words:
    """A model and the words that it has encoded, kept for all tasks of a Python worker."""
    if path not in _words:
        _words[path] = _Words(PieceModel(path))
    return _words[path]


def _plain(ts: pa.Array) -> np.ndarray:
    """Texts whose segments are what stands between single spaces."""
    odd = pc.or_(pc.match_substring(ts, "  "), pc.match_substring(ts, MARK))
    odd = pc.or_(odd, pc.or_(pc.starts_with(ts, " "), pc.ends_with(ts, " ")))
    return ~np.asarray(pc.or_(odd, pc.equal(ts, "")))


def _encoded(words: _Words, ts: pa.Array) -> Iterator[tuple[str, int, str]]:
    """Ids as text, their number, and the decoded text with a space in front, of each text in turn."""
    plain = _plain(ts)
    lists = pc.split_pattern(ts.filter(pa.array(plain)), " ")
    coded = lists.flatten().dictionary_encode()
    found = words.all(coded.dictionary.to_pylist())
    table = np.empty((3, len(found)), object)
    for k in range(3):
        table[k] = [f[k] for f in found]
    which, ends = coded.indices.to_numpy(), lists.offsets.to_numpy().tolist()
    at = 0
    for k, p in enumerate(plain.tolist()):
        if p:
            i = which[ends[at] : ends[at + 1]]
            at += 1
            yield ",".join(table[0][i]), sum(table[1][i]), "".join(table[2][i])
        else:
            own = words.all(words.model.segments(ts[k].as_py()))
            yield ",".join([w[0] for w in own]), sum([w[1] for w in own]), "".join([w[2] for w in own])


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of each whole text; see the module for odd input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(model_path)
        for b in batches:
            n, enc, dec = [], [], []
            for ids, number, text in _encoded(words, b.column(1)):
                n.append(number)
                enc.append(hashlib.sha256(ids.encode()).hexdigest())
                dec.append(hashlib.sha256(text[1:].encode("utf-8", "surrogatepass")).hexdigest())
            if n:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(enc), pa.array(dec)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(trimmed(run), SCHEMA)
