"""Operator 9, SentencePiece encoding and decoding with a merge-type prefix table.

For merge-type (BPE) vocabularies every prefix of a text has exactly one last token in the encoding
of that prefix. Walking the matches of an Aho-Corasick automaton that end at a position, longest
first, the last token is the match whose predecessor, the last token of the prefix before it, is
compatible with it: the two, side by side, encode to themselves. Ids are read backwards from the last
prefix. Compatibility is tested once per pair of tokens by merging their characters in order of score.

A merge never crosses a place whose two characters stand side by side in no piece, so texts are cut
there first, and pieces of text seen before come from a bounded cache. Whole texts are encoded: a
null text is an empty one and has the begin and end ids only. Repeated rows are encoded each.

Supports models with an identity normaliser, a dummy prefix and byte fallback; ``load`` checks it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from itertools import islice
from operator import add

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import CACHE_ENTRIES, chunks, record_batch

SPACE = "▁"
OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                 ("decoded_sha256", pa.string())])
PROBES = ("a  b", " a ", "ﬁ ①", "Ａ", "é", "a\tb\n c", " x　y", "")


class Codec:
    """One model's tables; built once per Python worker from the pieces and scores of the model."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
                                             or model.is_unused(i))]
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {i: model.get_score(i) for i in plain}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.begin, self.end = model.bos_id(), model.eos_id()
        if len(self.byte_id) != 256 or any(model.decode(model.encode(p)) != p for p in PROBES) \
                or not model.encode("a", out_type=str)[0].startswith(SPACE):
            raise ValueError("only models with identity normaliser, dummy prefix and byte fallback are supported")
        self.joined = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        # pieces of text between spaces and newlines; spaces lead a word, a newline stands alone
        if any(a != SPACE and b == SPACE or "\n" in (a, b) for a, b in self.joined):
            self.unit = re.compile(r"(?s).+")
        else:
            self.unit = re.compile(r"▁*[^▁\n]+|\n|▁+")
        self.four_bytes = [i.to_bytes(4, "little") for i in range(n)]
        # what an id alone decodes to; byte ids have no entry: they are decoded together
        self.text_of = {i: self.pieces[i].replace(SPACE, " ") if i in self.score else "" for i in range(n) if i not in self.byte_of}
        self.pair_ok: dict[int, bool] = {}
        self.alone_ok: dict[int, bool] = {}
        self.atom_ids: dict[str, tuple[int, ...]] = {}
        self.packed: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}

    def merge(self, text: str) -> list[int]:
        """Ids by merging the best-scored neighbours again and again, leftmost first; for short texts."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return [self.ids[p] for p in parts]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, left: int, right: int) -> bool:
        if len(self.pair_ok) >= CACHE_ENTRIES:
            self.pair_ok.clear()
        ok = self.pair_ok[left << 32 | right] = self.merge(self.pieces[left] + self.pieces[right]) == [left, right]
        return ok

    def reachable(self, token: int) -> bool:
        ok = self.alone_ok.get(token)
        if ok is None:
            ok = self.alone_ok[token] = self.merge(self.pieces[token]) == [token]
        return ok

    def encode_atom(self, atom: str) -> tuple[int, ...]:
        """Ids of a stretch without a safe cut, by the prefix table."""
        if len(atom) == 1 and atom not in self.ids:
            return tuple(self.byte_id[b] for b in atom.encode())
        last, length = [-1] * (len(atom) + 1), [0] * (len(atom) + 1)
        known, done = self.pair_ok.get, -1
        for end, (token, n) in self.automaton.iter(atom):  # at each end, longest first
            if end == done:
                continue
            at = end + 1
            before = at - n
            if before:
                left = last[before]
                if left < 0:
                    continue
                ok = known(left << 32 | token)
                if ok is None:
                    ok = self.compatible(left, token)
            else:
                ok = self.reachable(token)
            if ok:
                last[at], length[at], done = token, n, end
        out, at = [], len(atom)
        while at:
            out.append(last[at])
            at -= length[at]
        return tuple(reversed(out))

    def encode_unit(self, unit: str) -> Sequence[int]:
        if self.joined.issuperset(map(add, unit, islice(unit, 1, None))):  # no safe cut; the caller keeps what it gets
            return self.encode_atom(unit)
        out: list[int] = []
        start = 0
        for k in range(1, len(unit) + 1):
            if k < len(unit) and unit[k - 1:k + 1] in self.joined:
                continue
            atom = unit[start:k]
            start = k
            ids = self.atom_ids.get(atom)
            if ids is None:
                if len(self.atom_ids) >= CACHE_ENTRIES:
                    self.atom_ids.clear()
                ids = self.atom_ids[atom] = self.encode_atom(atom)
            out.extend(ids)
        return out

    def decode_ids(self, ids: Sequence[int]) -> str:
        """Pieces joined, spaces restored, bytes read as UTF-8; control ids give nothing."""
        try:
            return "".join(map(self.text_of.__getitem__, ids))
        except KeyError:  # byte ids
            pass
        out: list[str] = []
        held = bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i in self.score:
                out.append(self.pieces[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def _fill(self, units: list[str]) -> None:
        """Ids of new units, and what they decode to where that is not the unit itself."""
        new = set(units).difference(self.packed)
        if len(self.packed) + len(new) > 2 * CACHE_ENTRIES:  # no text is kept with the ids, so there is room
            self.packed.clear()
            self.decoded.clear()
            new = set(units)
        for unit in new:
            ids = self.encode_unit(unit)
            self.packed[unit] = b"".join(map(self.four_bytes.__getitem__, ids))
            decoded = self.decode_ids(ids)
            if decoded != unit.replace(SPACE, " "):
                self.decoded[unit] = decoded

    def encode_packed(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian unsigned 32-bit integers with begin and end, decoded text)."""
        ids, decoded = b"", ""
        if text:
            units = self.unit.findall(SPACE + text.replace(" ", SPACE))
            parts, words = [], []
            for k in range(0, len(units), 50_000):  # no more than the cache holds
                mine = units[k:k + 50_000]
                self._fill(mine)
                parts += map(self.packed.__getitem__, mine)
                if self.decoded:
                    mine = [self.decoded.get(u, u) for u in mine]
                words += mine
            ids, decoded = b"".join(parts), "".join(words).replace(SPACE, " ")[1:]  # without the dummy prefix
        return self.four_bytes[self.begin] + ids + self.four_bytes[self.end], decoded

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text)[0], "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ``encode``'s ids: without the space that the dummy prefix put in front."""
        text = self.decode_ids(ids)
        return text[1:] if text.startswith(" ") else text


_LOADED: dict[str, Codec] = {}


def load(path: str) -> Codec:
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, number of ids, digest of the ids and of the text that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(model_path)
        for ids, texts in chunks(batches):
            counts, digests, back = [], [], []
            for t in texts:
                packed, decoded = codec.encode_packed(t or "")
                counts.append(len(packed) // 4)
                digests.append(hashlib.sha256(packed).hexdigest())
                back.append(hashlib.sha256(decoded.encode()).hexdigest())
            yield record_batch(OUT, ids, counts, digests, back)

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
