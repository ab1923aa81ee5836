"""Byte-level BPE: words are merged by a fold of Spark's higher-order functions over their bytes; documents are put together from the words.

A rank file gives each byte string that is a token its rank, which is its id. A word is a whole token, or else its bytes are merged: of all neighbours whose
concatenation is a token those of the lowest rank (the first of equals) become one, until none is left.

The words of all documents are counted, and the fold takes the most frequent ones, most of what any text consists of, once each; all tasks hold their ids (a table of at most
``FREQUENT`` words, all of at most ``LONG`` bytes). A word that the table lacks is merged by the task that meets it, by the same rule. One pass over the documents counts
words and one encodes texts; nothing is shuffled but counted words.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from ._common import fresh

#: Longer words are merged with a heap, as a plain merge's work grows with the square of a word's length. They are in no table that tasks hold.
LONG = 64
FREQUENT = 1 << 18
#: So many words that the table lacks are remembered by a task.
REMEMBERED = 1 << 16
BUCKETS = 1 << 13
OTHER, LETTER, NUMBER, SPACE, BORDER = range(5)
#: Texts are cut into words so many bytes at a time (one text at least).
SLICE = 2 << 20
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def read_ranks(path: str) -> dict[bytes, int]:
    """Lines of a token in base64 and its rank. A vocabulary is small and is read by the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


# -- words of texts ---------------------------------------------------------------------------------------------------------------------------

_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """The kind of every code point; made once a process."""
    if not _kinds:
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        out = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                a, b = (k if k < 0xD800 else k + 0x800 for k in (m.start(), m.end() - 1))
                out[a : b + 1] = kind
        _kinds.append(out)
    return _kinds[0]


def word_starts(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a word starts at each code point of texts that stand one behind the other; ``first`` marks where a text starts.

    The words are the matches of ``'s|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|spaces before no non-space|spaces``: runs of one kind, the last
    space of a run going its own way (before its word if it is U+0020), contractions cut from the letters behind them.
    """
    n = len(code)
    kind = kinds()[code]
    before = np.empty(n, np.uint8)
    before[1:] = kind[:-1]
    before[first] = BORDER
    after = np.full(n, BORDER, np.uint8)
    after[:-1] = np.where(first[1:], BORDER, kind[1:])
    space, blank = kind == SPACE, code == 32
    joined = np.zeros(n, bool)  # behind a U+0020 that goes with what follows
    joined[1:] = blank[:-1] & ~space[1:] & ~first[1:]
    start = (kind != before) & ~joined
    start |= space & (after != SPACE) & (after != BORDER)  # the last of a run of spaces
    quotes = np.flatnonzero((code == 39) & start)
    if len(quotes):
        text_of = np.cumsum(first)
        padded, owner = np.append(code, [0, 0]), np.append(text_of, [-1, -1])
        for letters in CONTRACTIONS:
            k = len(letters)
            same = owner[np.minimum(quotes + k, n + 1)] == text_of[quotes]
            for j, c in enumerate(letters, 1):
                same &= padded[np.minimum(quotes + j, n + 1)] == ord(c)
            hit = quotes[same]
            start[hit + 1] = False
            end = hit + k + 1
            start[end[end < n]] = True
    return start


class Words(NamedTuple):
    """Words of some texts in order; text k has those from ``ends[k - 1]`` to ``ends[k]``."""

    words: pa.StringArray
    ends: np.ndarray


def words_of(texts: pa.StringArray) -> Words:
    """Null texts have none."""
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    if not len(data):
        return Words(pa.array([], pa.string()), np.zeros(len(texts), np.int64))
    offsets = offsets - offsets[0]
    at = np.flatnonzero((data & 0xC0) != 0x80)  # the byte of each code point
    code = data if len(at) == len(data) else np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    first = np.zeros(len(code), bool)
    first[np.searchsorted(at, offsets[:-1][offsets[:-1] < offsets[1:]])] = True
    begin = at[word_starts(code, first)]
    words = pa.StringArray.from_buffers(len(begin), pa.py_buffer(np.append(begin, len(data)).astype(np.int32)), pa.py_buffer(data.tobytes()))
    return Words(words, np.searchsorted(begin, offsets[1:]))


def _slices(batch: pa.RecordBatch, column: int):
    """Parts of a batch with at most SLICE bytes of text, or one row."""
    size = np.cumsum(np.array([v or 0 for v in pc.binary_length(batch.column(column)).to_pylist()], np.int64))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + SLICE, "right")))
        yield batch.slice(at, end - at)
        at = end


# -- merging --------------------------------------------------------------------------------------------------------------------------------------


def _bound(value: Column, use) -> Column:
    """``use(value)``, ``value`` being evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def folded(word: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of a word: a fold over its bytes (each a character of one byte) that merges the pair of the lowest rank at each step.

    The rank map is one literal: an array of small maps, of which the checksum of a piece picks one, as a lookup in a map goes through its keys. The state is the
    pieces, the rank of each piece with the next (null where they are no token) and the pair to merge, null pieces at both ends. For words of at most LONG bytes.
    """
    maps: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        text = token.decode("latin-1")
        maps[zlib.crc32(text.encode()) % BUCKETS][text] = rank
    literal = F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")

    def over(table):
        def rank(piece):
            return F.try_element_at(F.get(table, F.crc32(piece).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), piece)

        def step(state, look):
            """In turn: look for the lowest pair (pair i, from 1, is piece i with piece i + 1); merge it."""
            pieces, pairs, i = state["pieces"], state["pairs"], state["i"]
            found = F.struct(pieces.alias("pieces"), pairs.alias("pairs"), F.array_position(pairs, F.array_min(pairs)).cast("int").alias("i"))
            a, b, c, d = (F.get(pieces, i + k) for k in (-2, -1, 0, 1))
            near = F.array(rank(F.concat(a, b, c)), rank(F.concat(b, c, d)))
            merged = F.struct(
                F.concat(F.slice(pieces, F.lit(1), i - 1), F.array(F.concat(b, c)), F.slice(pieces, i + 2, F.lit(LONG))).alias("pieces"),
                F.concat(F.slice(pairs, F.lit(1), i - 2), near, F.slice(pairs, i + 2, F.lit(LONG))).alias("pairs"), F.lit(None).cast("int").alias("i"),
            )
            return F.when(look, found).otherwise(F.when(i.isNull(), state).otherwise(merged))

        def fold(text):
            def start(pieces):
                beside = F.zip_with(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.slice(pieces, F.lit(2), F.size(pieces) - 1), lambda a, b: rank(F.concat(a, b)))
                return F.struct(pieces.alias("pieces"), beside.alias("pairs"), F.lit(None).cast("int").alias("i"))

            nothing = F.array(F.lit(None).cast("string"))
            state = _bound(F.concat(nothing, F.split(text, ""), nothing), start)
            turns = F.flatten(F.array_repeat(F.array(F.lit(True), F.lit(False)), F.length(text) - 1))
            ids = lambda s: F.transform(F.slice(s["pieces"], F.lit(2), F.size(s["pieces"]) - 2), rank)
            return F.coalesce(F.when(rank(text).isNotNull(), F.array(rank(text))), F.aggregate(turns, state, step, ids))

        return _bound(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), fold)

    return F.when(F.length(word) == 0, F.array().cast("array<int>")).otherwise(_bound(literal, over))


def merged_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same in plain steps, for a word that the table lacks."""
    if piece in ranks:
        return [ranks[piece]]
    pieces, none = [piece[k : k + 1] for k in range(len(piece))], 1 << 62
    pairs = [ranks.get(a + b, none) for a, b in zip(pieces, pieces[1:])]
    while pairs and (low := min(pairs)) < none:
        k = pairs.index(low)
        pieces[k : k + 2] = [pieces[k] + pieces[k + 1]]
        del pairs[k]
        if k:
            pairs[k - 1] = ranks.get(pieces[k - 1] + pieces[k], none)
        if k < len(pairs):
            pairs[k] = ranks.get(pieces[k] + pieces[k + 1], none)
    return [ranks[p] for p in pieces]


def merged_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a word of any length: pairs wait in a heap by rank and place, pieces are linked both ways."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, back, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
    heap = [(ranks[piece[k : k + 2]], k, k + 2) for k in range(n - 1) if piece[k : k + 2] in ranks]
    heapq.heapify(heap)

    def offer(k):
        if k >= 0 and end[k] < n:
            until = end[end[k]]
            r = ranks.get(piece[k:until])
            if r is not None:
                heapq.heappush(heap, (r, k, until))

    while heap:
        _, k, until = heapq.heappop(heap)
        if gone[k] or end[k] >= n or end[end[k]] != until:
            continue  # one of the two has been merged since
        gone[end[k]] = True
        end[k] = until
        if until < n:
            back[until] = k
        offer(k)
        offer(back[k])
    out, k = [], 0
    while k < n:
        out.append(ranks[piece[k : end[k]]])
        k = end[k]
    return out


def distinct_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, n``: every word of every text and how often it stands there. Tasks count before they send."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch, 0):
                counts = words_of(part.column(0)).words.value_counts()
                yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], names=["word", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def encode_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``words(word)``, of at most LONG bytes each, with ``ids array<int>``."""
    return words.select("word", folded(F.col("word"), ranks).alias("ids"))


# -- documents ------------------------------------------------------------------------------------------------------------------------------------


def _frequent(docs: DataFrame, text: str, ranks: dict[bytes, int], most: int, sample: int | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words that stand most often in all documents (of about ``sample`` where it is given), ``most`` at the most, the most frequent first: the words, where each one's ids
    end, all ids."""
    if sample is not None and (n := docs.count()) > sample:
        docs = docs.sample(sample / n, seed=7)
    words = distinct_words(docs, text).where(F.octet_length("word") <= LONG)
    level = F.floor(F.log2(F.col("n").cast("double")) * 16)
    low, total = None, 0
    words = cut(words)
    for r in words.groupBy(level.alias("level")).agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect():  # counts in classes, 1024 at most
        if total + r.k > most:
            break
        low, total = r.level, total + r.k
    got = cut(encode_words(words.where(level >= (1 << 20 if low is None else low)), ranks)).join(words, "word").toArrow().combine_chunks()
    got = got.sort_by([("n", "descending"), ("word", "ascending")]).combine_chunks()
    one = lambda c, kind: c.chunk(0) if c.num_chunks else pa.array([], kind)
    ids = one(got.column("ids"), pa.list_(pa.int32()))
    return one(got.column("word"), pa.string()).cast(pa.string()), np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False)).astype(np.int64), ids.flatten().to_numpy(zero_copy_only=False).astype(np.int32)


class Encoder:
    """Ids of the texts of a task: the table's words, and those it has merged itself."""

    def __init__(self, words: pa.Array, ends: np.ndarray, flat: np.ndarray, ranks: dict[bytes, int]):
        self.words, self.ends, self.flat, self.ranks, self.own = words, ends, flat, ranks, {}

    def _merged(self, word: str) -> list[int]:
        ids = self.own.get(word)
        if ids is None:
            piece = word.encode()
            ids = merged_short(piece, self.ranks) if len(piece) <= LONG else merged_long(piece, self.ranks)
            if len(self.own) >= REMEMBERED:
                self.own.clear()
            if len(piece) <= LONG:
                self.own[word] = ids
        return ids

    def lists(self, texts: pa.StringArray) -> pa.ListArray:
        """The ids of each text; all words of all texts are looked up at once, distinct ones once."""
        part = words_of(texts)
        coded = part.words.dictionary_encode()
        place = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        more = [self._merged(w) for w in coded.dictionary.take(pa.array(new)).to_pylist()]
        place[new] = len(self.ends) + np.arange(len(new))
        stop = np.append(self.ends, len(self.flat) + np.cumsum([len(x) for x in more], dtype=np.int64))
        every = np.concatenate([self.flat, np.array([i for x in more for i in x], np.int32)])
        code = place[coded.indices.to_numpy(zero_copy_only=False)] if len(place) else np.zeros(0, np.int64)
        begin = np.append(0, stop[:-1])[code]
        length = stop[code] - begin
        done = np.cumsum(length)
        ids = every[np.repeat(begin - (done - length), length) + np.arange(done[-1] if len(done) else 0)]
        last = np.append(0, done)[part.ends]
        return pa.ListArray.from_arrays(pa.array(np.append(0, last), pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, rank_path: str, keep: list[str], text: str = "text", frequent: int = FREQUENT, sample: int | None = None) -> DataFrame:
    """``keep`` columns of every row of ``docs`` and ``ids array<int>``: the tokens of its whole text, special tokens being ordinary text.

    Null and empty texts have none. Rows stay as often as they are there; names of columns may be anything. ``rank_path`` is read by the driver, and all tasks hold
    the ids of at most ``frequent`` words, the most frequent of all documents (of about ``sample`` of them where it is given). A text of any length is encoded in one task, in time that grows with its length.
    """
    ranks = read_ranks(rank_path)
    table = docs.sparkSession.sparkContext.broadcast((*_frequent(docs, text, ranks, frequent, sample), ranks))
    kept = F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in keep)).alias("kept")
    rows = docs.select(kept, F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches):
        encoder = Encoder(*table.value)
        for batch in batches:
            for part in _slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.lists(part.column(1))], names=["kept", "ids"])

    out = rows.mapInArrow(run, f"kept {rows.schema['kept'].dataType.simpleString()}, ids array<int>")
    ids = fresh(docs.select(*(f"`{c}`" for c in keep)), "ids")
    return out.select(*(F.col("kept")[c].alias(c) for c in keep), F.col("ids").alias(ids))


def decode(df: DataFrame, rank_path: str, ids: str = "ids", name: str = "bytes") -> DataFrame:
    """``df`` with the bytes that a column of ids stands for: their binary pieces, one behind the other. Null for null; ids that the file lacks give nothing."""
    ranks = read_ranks(rank_path)
    names = {rank: token for token, rank in ranks.items()}
    most = max(names) + 1
    pieces = pa.array([*(names.get(k, b"") for k in range(most)), b""], pa.large_binary())  # the last one for ids that are none

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):  # so that few texts are held at a time
                part = batch.column(1).slice(k, 512)
                flat = part.flatten().to_numpy(zero_copy_only=False)
                joined = pieces.take(pa.array(np.where((flat >= 0) & (flat < most), flat, most), pa.int64()))
                data = memoryview(joined.buffers()[2] or b"")
                ends = np.append(0, np.cumsum(pc.binary_length(joined).to_numpy(zero_copy_only=False)))
                cuts = ends[np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False)))]
                done = [None if null else bytes(data[a:b]) for a, b, null in zip(cuts, cuts[1:], part.is_null().to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 512), part, pa.array(done, pa.binary())], names=["row", "ids", "bytes"])

    rest = [c for c in df.columns if c != ids]
    packed = df.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in rest)).alias("row"), F.col(f"`{ids}`").cast("array<int>").alias("ids"))
    out = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, ids array<int>, bytes binary")
    return out.select(*(F.col("row")[c].alias(c) for c in rest), F.col("ids").alias(ids), F.col("bytes").alias(name))
