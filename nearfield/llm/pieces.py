"""Exact encoding and decoding with the BPE models of the sentencepiece library.

The library joins the adjacent pair whose joined piece has the best score, again and again. The same
result comes from left to right: at each position take the longest matching piece; a piece may stand
after another only if re-merging the two gives just these two; where none fits, mark the position as
failed in a bitfield, step back and take the next shorter prefix. Longest matches of all positions come
from one Aho-Corasick pass over the reversed text, which is linear in its length.

A text is first cut where no piece can span: before a run of the white space mark, around white space
that no piece holds, and between a letter and a character that follows a letter in no piece. Results of short cuts are kept in a bounded table.

Defined cases. A null text counts as empty; an empty text has no ids but the begin and end ids, where these are asked for
and the model has them. Characters without a piece are encoded as the bytes of their UTF-8. Rows are independent, so ties and repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.runs import trimmed
from nearfield.session import ship

MARK = "▁"
#: Entries that the table of results, and that of pairs, may hold.
TABLE = 180_000
#: Longer cuts are not kept.
SHORT = 48


class Pieces:
    """One model's vocabulary and its exact encoder; read from the model once in each Python process."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes: dict[int, int] = {}
        self.of_byte: list[int] = [-1] * 256
        self.text: list[str | None] = []
        rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[i] = int(piece[3:5], 16)
                self.of_byte[self.bytes[i]] = i
            self.text.append(None if sp.is_byte(i) else " ⁇ " if sp.is_unknown(i) else "" if sp.is_control(i) else piece.replace(MARK, " "))
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[piece] = i
                rank[piece] = -sp.get_score(i)
        self.rank = rank
        self.unknown = sp.unk_id()
        #: Begin and end ids, packed; empty where the model has none.
        self.ends = tuple(_packed([i] if i >= 0 else []) for i in (sp.bos_id(), sp.eos_id()))
        self.name = {i: p for p, i in self.id.items()}
        #: Pieces that merging reaches; others never appear in an encoding.
        reached = {p for p in self.id if len(p) == 1 or self.merge(list(p)) == [p]}
        self.whole = {p: [self.id[p]] for p in reached}
        self.automaton = ahocorasick.Automaton()
        for p in reached:
            self.automaton.add_word(p[::-1], self.id[p])
        self.automaton.make_automaton()
        self.length = [len(self.name.get(i, "")) for i in range(len(self.text))]
        self.shorter: list[int] = [-1] * len(self.text)
        for p in reached:
            self.shorter[self.id[p]] = next((self.id[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in reached), -1)
        self.cut = re.compile(self._cuts()).findall
        self.pairs: dict[int, bool] = {}  # by first id * 2**32 + second
        self.table = _Table(self)
        self.odd: dict[str, str] = {}

    def _cuts(self) -> str:
        """A pattern of the parts of a text across whose ends no piece spans."""
        if any(MARK in p.lstrip(MARK) for p in self.id):
            return "(?s:.+)"
        held = {c for p in self.id for c in p}
        alone = re.escape("".join(c for c in "\n\t\r\x0b\x0c" if c not in held)) or MARK
        letter = "[" + "".join(re.escape(c) for c in sorted(held) if c.isalpha()) + "]"
        joined = {m[1] for p in self.id for m in re.finditer(f"(?<={letter})(.)", p, re.S)}
        #: No piece has one of these after a letter.
        ends = re.escape("".join(sorted(c for c in held if not c.isalpha() and c != MARK and c not in joined)))
        other = f"[^{letter[1:-1]}{MARK}{alone}]"
        on = f"(?:[^{letter[1:-1]}{MARK}{alone}{ends}]{other}*+)?"
        words = f"(?:{letter}++{on})++"
        return f"{MARK}*+(?:{words}|{other}++(?:{words})?)|{MARK}++|[{alone}]"

    def merge(self, parts: list[str]) -> list[str]:
        """Best pair first, leftmost among equals: the library's own order, for short texts."""
        rank = self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether the two pieces, written one after the other, merge into just these two again."""
        x, y = self.name[a], self.name[b]
        ok = self.merge(list(x + y)) == [x, y]
        if len(self.pairs) >= TABLE // 2:
            self.pairs.clear()
        self.pairs[a << 32 | b] = ok
        return ok

    def ids_of(self, cut: str) -> list[int]:
        """Ids of a text in which white space is marked already."""
        whole = self.whole.get(cut)
        if whole is not None:
            return whole
        n = len(cut)
        longest = [-1] * n
        for end, piece in self.automaton.iter(cut[::-1]):
            at = n - 1 - end
            if longest[at] < 0:  # at one position the longest match comes first
                longest[at] = piece
        out: list[int] = []
        start = 0
        while start < n:  # characters without a piece part what stands on either side
            if longest[start] < 0:
                out += self._as_bytes(cut[start])
                start += 1
                continue
            end = start
            while end < n and longest[end] >= 0:
                end += 1
            out += self._search(longest, start, end)
            start = end
        return out

    def _search(self, longest: list[int], start: int, end: int) -> list[int]:
        length, shorter, pairs = self.length, self.shorter, self.pairs
        open_ = bytearray(b"\x01") * (end - start + 1)
        out: list[int] = []
        at, piece = start, longest[start]
        while True:
            while piece >= 0:
                to = at + length[piece]
                if to <= end and open_[to - start]:
                    ok = True if not out else pairs.get(out[-1] << 32 | piece)
                    if ok is None:
                        ok = self.fits(out[-1], piece)
                    if ok:
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                at = to
                if at == end:
                    return out
                piece = longest[at]
            else:
                open_[at - start] = 0
                piece = out.pop()
                at -= length[piece]

    def _as_bytes(self, c: str) -> list[int]:
        ids = [self.of_byte[b] for b in c.encode()]
        return ids if min(ids) >= 0 else [self.unknown]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text)[0], "<u4").tolist()

    def encoded(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the text that they decode to."""
        if not text:
            return b"", ""
        marked = MARK + text.replace(" ", MARK)
        cuts = self.cut(marked)
        ids = b"".join(map(self.table.__getitem__, cuts))
        if self.odd:
            decoded = "".join([self.odd.get(c) or c.replace(MARK, " ") for c in cuts])
        else:  # every cut's ids have been decoded and gave the cut
            decoded = marked.replace(MARK, " ")
        return ids, decoded[1:] if decoded[:1] == " " else decoded

    def pieces_to_text(self, ids: list[int]) -> str:
        """Text of ids without the removal of the first space; bytes that are no UTF-8 become U+FFFD each."""
        if not any(map(self.bytes.__contains__, ids)):
            return "".join([self.text[i] for i in ids])
        out, raw = [], bytearray()
        for i in [*ids, None]:
            if i is not None and i in self.bytes:
                raw.append(self.bytes[i])
                continue
            if raw:
                out.append(_decode_bytes(bytes(raw)))
                raw.clear()
            if i is not None:
                out.append(self.text[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        text = self.pieces_to_text(ids)
        first = next((i for i in ids if self.text[i] != ""), None)
        return text[1:] if first is not None and (self.text[first] or "")[:1] == " " and first != self.unknown else text


def _decode_bytes(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        b = raw[at]
        n = 1 if b < 0x80 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
        try:
            out.append(raw[at : at + n].decode() if n and len(raw) >= at + n else "�")
            at += n if n and len(raw) >= at + n else 1
        except UnicodeDecodeError:
            out.append("�")
            at += 1
    return "".join(out)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Table(dict):
    """Ids of cuts, as bytes. A cut whose ids decode to anything but itself goes to ``pieces.odd`` with that text.

    When half the room is taken the entries become the old ones, and those of before are dropped; what is asked for again comes back.
    """

    def __init__(self, pieces: Pieces) -> None:
        super().__init__()
        self.pieces = pieces
        self.old: dict[str, bytes] = {}

    def __missing__(self, cut: str) -> bytes:
        out = self.old.get(cut)
        if out is not None:
            return self._keep(cut, out)
        ids = self.pieces.ids_of(cut)
        out, back = _packed(ids), self.pieces.pieces_to_text(ids)
        if back != cut.replace(MARK, " "):
            self.pieces.odd[cut] = back
        return self._keep(cut, out) if len(cut) <= SHORT else out

    def _keep(self, cut: str, out: bytes) -> bytes:
        if len(self) >= TABLE // 2:
            self.old = dict(self)
            self.clear()
        self[cut] = out
        return out


_models: dict[str, Pieces] = {}


def pieces(model: str) -> Pieces:
    if model not in _models:
        _models[model] = Pieces(model)
    return _models[model]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_digests: bool = False, with_ends: bool = False) -> DataFrame:
    """(doc_id, n_tokens, [ids array<int>], [ids_sha256, decoded_sha256]), a row for each row of docs; with_ends puts the begin and end ids round each text's."""
    ship(docs.sparkSession)
    id_type = docs.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(model)
        begin, end = m.ends if with_ends else (b"", b"")
        for b in batches:
            for part in (b.slice(i, 1000) for i in range(0, b.num_rows, 1000)):
                done = [(begin + x + end, t) for x, t in (m.encoded(x or "") for x in part.column(1).to_pylist())]
                columns = [part.column(0), pa.array([len(x) // 4 for x, _ in done], pa.int64())]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x, _ in done], pa.list_(pa.int32())))
                if with_digests:
                    columns += [pa.array([hashlib.sha256(x).hexdigest() for x, _ in done]), pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in done])]
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_tokens", *["ids"] * with_ids, *["ids_sha256", "decoded_sha256"] * with_digests]
    schema = f"doc_id {id_type}, n_tokens long" + ", ids array<int>" * with_ids + ", ids_sha256 string, decoded_sha256 string" * with_digests
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(trimmed(run), schema)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text); null ids count as none."""
    ship(encoded.sparkSession)
    id_type = encoded.select(F.col(id_col)).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pieces(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"doc_id {id_type}, text string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False, with_digests=True, with_ends=True)
