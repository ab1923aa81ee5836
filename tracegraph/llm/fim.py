"""Fill-in-the-middle with a piece table: a document is a list of descriptors over immutable buffers, never a copied text.

A descriptor is ``(buffer, start, length)``: buffer 0 is the text, the others are the sentinels. Cutting splits a descriptor, an
arrangement orders pieces and puts sentinels between them, its inverse permutation restores the text's order, and hashes are fed piece by piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import fresh

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Of each form: the order of prefix (0), middle (1) and suffix (2), and the sentinel before each piece.
FORMS = {"psm": ((0, 2, 1), (PREFIX, SUFFIX, MIDDLE)), "spm": ((2, 0, 1), (SUFFIX, PREFIX, MIDDLE))}
PIECE = pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])
PIECES = "array<struct<buffer:int,start:long,length:long>>"


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


class PieceTable:
    """``buffers`` are never changed; ``pieces`` say what of them stands in which order."""

    def __init__(self, buffers: tuple[str, ...], pieces: list[Piece] | None = None):
        self.buffers = buffers
        self.pieces = [Piece(0, 0, len(buffers[0]))] if pieces is None else pieces

    def cut(self, at: int) -> PieceTable:
        """The same content with a piece boundary before character ``at`` (also where that makes an empty piece)."""
        out, left = [], at
        for k, p in enumerate(self.pieces):
            if 0 <= left <= p.length and (left < p.length or k == len(self.pieces) - 1):
                return PieceTable(self.buffers, [*out, Piece(p.buffer, p.start, left), Piece(p.buffer, p.start + left, p.length - left), *self.pieces[k + 1 :]])
            out.append(p)
            left -= p.length
        raise IndexError(at)

    def arranged(self, order: tuple[int, ...], before: tuple[int, ...]) -> PieceTable:
        """The pieces in ``order``, each behind the whole of the buffer ``before`` names."""
        marks = [Piece(b, 0, len(self.buffers[b])) for b in before]
        return PieceTable(self.buffers, [x for mark, k in zip(marks, order) for x in (mark, self.pieces[k])])

    def restored(self, order: tuple[int, ...]) -> PieceTable:
        """What ``arranged`` was made of: sentinels go, the inverse permutation orders the rest."""
        own = self.pieces[1::2]
        inverse = sorted(range(len(order)), key=order.__getitem__)
        return PieceTable(self.buffers, [own[k] for k in inverse])

    def slices(self) -> Iterator[str]:
        for b, start, length in self.pieces:
            yield self.buffers[b][start : start + length]

    def text(self) -> str:
        return "".join(self.slices())

    def sha256(self) -> str:
        """Hex digest of the content's UTF-8, a piece after the other."""
        h = hashlib.sha256()
        for s in self.slices():
            h.update(s.encode())
        return h.hexdigest()


_UNIT = np.zeros(128, bool)
_UNIT[ord("A") : ord("Z") + 1] = _UNIT[ord("a") : ord("z") + 1] = True


def unit_starts(text: str) -> np.ndarray:
    """Where the units ``[A-Za-z]+|[^A-Za-z]`` start, in code points."""
    if text.isascii():
        code = np.frombuffer(text.encode(), np.uint8)
        letter = _UNIT[code]
    else:
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        letter = _UNIT[np.where(code < 128, code, 0)]
    inside = np.zeros(len(letter), bool)
    inside[1:] = letter[1:] & letter[:-1]
    return np.flatnonzero(~inside)


def draws(key: int | None) -> tuple[int, int, int, int]:
    """The four numbers that decide a document's cuts and form: the first 32-bit groups of the SHA-256 of ``1:`` and its id (nothing for none)."""
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def arrange(text: str, key: int | None, rate: int = 90, spm_rate: int = 20) -> tuple[int, str, PieceTable]:
    """``(units, form, table)`` of one text; its table is the text alone where the form is plain."""
    starts = unit_starts(text)
    n = len(starts)
    h1, h2, h3, h4 = draws(key)
    table = PieceTable((text, *SENTINELS))
    if n == 0 or h3 % 100 >= rate or any(s in text for s in SENTINELS):
        return n, "plain", table
    form = "spm" if h4 % 100 < spm_rate else "psm"
    ends = [int(starts[k]) if k < n else len(text) for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
    order, marks = FORMS[form]
    # the later cut first: the earlier one then splits the first piece
    return n, form, table.cut(ends[1]).cut(ends[0]).arranged(order, tuple(1 + SENTINELS.index(m) for m in marks))


def parse(output: str, form: str) -> PieceTable:
    """The table of an output, from it and its form alone: pieces over the output, cut at its sentinels.

    The text held none of them, and none can arise across a border, so the first of each marks its place."""
    table = PieceTable((output, *SENTINELS))
    if form == "plain":
        return table
    order, marks = FORMS[form]
    at = [output.index(m) for m in marks]
    ends = [*at[1:], len(output)]
    pieces = []
    for start, mark, end in zip(at, marks, ends):
        pieces += [Piece(0, start, len(mark)), Piece(0, start + len(mark), end - start - len(mark))]
    return PieceTable((output, *SENTINELS), pieces)


def restore(output: str, form: str) -> PieceTable:
    """The original text of an output as a table over it."""
    table = parse(output, form)
    return table if form == "plain" else table.restored(FORMS[form][0])


def transformed(docs: DataFrame, rate: int = 90, spm_rate: int = 20, output: bool = True) -> DataFrame:
    """``docs(doc_id, text)`` with ``n`` (units), ``form`` (plain, psm, spm), ``prefix_chars, middle_chars``, ``pieces`` (descriptors; buffer 0 is the
    text, 1 to 3 the sentinels), ``output`` (left out on request), ``output_sha256`` and ``restored_sha256`` (of the text rebuilt from output and form).

    ``rate`` of 100 documents are transformed, ``spm_rate`` of 100 of those with the suffix first. One pass without a shuffle, one text after the other.
    A null text is the empty one; empty texts and texts that hold a sentinel stay plain; a null id has draws of its own; repeated rows give equal rows.
    Other columns of ``docs`` are not carried.
    """
    names = ["n", "form", "prefix_chars", "middle_chars", "pieces", *(["output"] if output else []), "output_sha256", "restored_sha256"]
    kinds = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "pieces": PIECES, "output": "string", "output_sha256": "string", "restored_sha256": "string"}
    arrow = {"n": pa.int64(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "pieces": pa.list_(PIECE)}

    def one(key, text):
        text = text or ""
        n, form, table = arrange(text, key, rate, spm_rate)
        whole = table.text()
        if form == "plain":
            chars = (None, None)
        else:
            order = FORMS[form][0]
            own = table.pieces[1::2]
            chars = own[order.index(0)].length, own[order.index(1)].length
        row = {"n": n, "form": form, "prefix_chars": chars[0], "middle_chars": chars[1], "pieces": [p._asdict() for p in table.pieces], "output": whole, "output_sha256": table.sha256()}
        return row | {"restored_sha256": restore(whole, form).sha256()}

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # so that few outputs are held at a time
                part = batch.slice(at, 256)
                rows = [one(k.as_py(), t.as_py()) for k, t in zip(part.column(0), part.column(1))]
                cols = [pa.array([r[c] for r in rows], arrow.get(c, pa.string())) for c in names]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", *names])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias(fresh(docs.select("doc_id"), "text")))
    return own.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} {kinds[c]}" for c in names))
