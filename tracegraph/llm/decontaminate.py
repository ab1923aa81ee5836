"""Benchmark decontamination by template windows: typed placeholders, hash join, slot consistency."""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, whole

TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+|[.!?\n]")
# Unit words, taken as such right after a number.
UNITS = set(
    "mm cm m km in ft yd mi mg g kg lb lbs oz t ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week"
    " weeks month months year years meter meters metre metres kilometer kilometers mile miles inch inches foot feet gram grams"
    " kilogram kilograms pound pounds ounce ounces liter liters litre litres percent dollar dollars cent cents euro euros degree"
    " degrees kmh mph c f k hz khz mhz ghz w kw v a j kj cal kcal".split()
)
WORD, NUMBER, UNIT, NAME, END = range(5)
NUMBER_HASH, UNIT_HASH, NAME_HASH = (np.uint64(xxhash.xxh64_intdigest(f"<{x}>")) for x in ("number", "unit", "name"))
STEP = np.uint64(0x9E3779B97F4A7C15)
BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
FILTER_BITS = 20


class Codes(dict):
    """Token to a dense number; kind and literal hash of each number stand in ``k`` and ``h``. Forgets all beyond ``most`` tokens."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most, self.k, self.h = most, np.zeros(1024, np.int8), np.zeros(1024, np.uint64)

    def __missing__(self, token: str) -> int:
        low = token.lower()
        if token[0].isdigit():
            kind = NUMBER
        elif token in ".!?\n":
            kind = END
        elif low in UNITS:
            kind = UNIT
        else:
            kind = NAME if token[0].isupper() and token[1:] == low[1:] and len(token) > 1 else WORD
        code = len(self)
        if code == len(self.k):
            self.k, self.h = np.resize(self.k, 2 * code), np.resize(self.h, 2 * code)
        self[token], self.k[code], self.h[code] = code, kind, xxhash.xxh64_intdigest(low)
        return code

    def arrays(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > self.most:
            self.clear()
        several = pa.array(tokens, pa.string()).dictionary_encode()
        codes = np.fromiter(map(self.__getitem__, several.dictionary.to_pylist()), np.int64)[several.indices.to_numpy()]
        return self.k[codes], self.h[codes]


def template(kind: np.ndarray, h: np.ndarray, names: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place of each word among the tokens, its template hash, whether it is a slot, whether it is a name).

    Slots: numbers, unit words right after a number, and, with ``names`` 1, capitalised words that do not open a sentence; with 2 all
    capitalised words, a run of them as one slot.
    """
    before = np.r_[np.int8(END), kind[:-1]]
    number, unit = kind == NUMBER, (kind == UNIT) & (before == NUMBER)
    name = (kind == NAME) & ((before != END) | (names == 2)) & bool(names)
    t = np.where(number, NUMBER_HASH, np.where(unit, UNIT_HASH, np.where(name, NAME_HASH, h)))
    keep = np.flatnonzero((kind != END) & ~(name & (before == NAME) & (names == 2)))
    return keep, t[keep], (number | unit | name)[keep], name[keep]


def windows(t: np.ndarray, slot: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of the windows of ``size`` words that lie in one text and of which half at least are no slots."""
    n = len(t) - size + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * STEP + t[k : k + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    slots = np.r_[0, np.cumsum(slot)]
    at = np.flatnonzero((2 * (slots[size:] - slots[:-size]) <= size) & (text[:n] == text[size - 1 :]))
    return at, h[at]


def runs(h: np.ndarray, text: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each run of ``size`` words of one text, taken as they are."""
    n = len(h) - size + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    power = np.r_[np.uint64(1), np.cumprod(np.full(len(h), STEP))]
    sums[1:] = np.cumsum(h * power[:-1])
    out = (sums[size:] - sums[:-size]) * np.r_[np.uint64(1), np.cumprod(np.full(n, BACK))][:n]  # as if each began the text
    out ^= out >> np.uint64(29)
    out = out * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(size)
    at = np.flatnonzero(text[:n] == text[size - 1 :])
    return at, (out ^ out >> np.uint64(32))[at]


def _find(size: int, least: int, wanted: bytes | None, lengths: list[int] = ()):
    """Rows ``(key, variant, pos, word, h, slots)`` of the windows whose hash the filter lets through; without one, of items.

    Variants 0 to 2 are the templates; 3 is the whole literal text of items with few windows, in documents all runs of their ``lengths``.
    Texts are worked on by the hundred, as one array of tokens with a sentence end before each text.
    """
    open_to = None if wanted is None else np.unpackbits(np.frombuffer(wanted, np.uint8)).astype(bool)
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))

    def let(at, h):
        if open_to is None or not len(h):
            return at, h
        ok = open_to[h >> np.uint64(64 - FILTER_BITS)]
        return at[ok], h[ok]

    def solve(codes, keys, tokens, counts):
        out = tuple([] for _ in kinds)
        add = lambda *row: [col.append(v) for col, v in zip(out, row)]
        text = np.repeat(np.arange(len(keys)), counts)
        kind, h = codes.arrays(tokens)
        for variant in (0, 1, 2):
            place, t, slot, name = template(kind, h, variant)
            inside = text[place]
            first = np.searchsorted(inside, np.arange(len(keys)))
            at, x = windows(t, slot, inside, size)
            if variant:  # a text without names is as in variant 0
                named = np.zeros(len(keys), bool)
                named[inside[name]] = True
                ok = named[inside[at]]
                at, x = at[ok], x[ok]
            else:
                words, word_text, word_first = place, inside, first
                few = np.bincount(inside[at], minlength=len(keys)) < least
            at, x = let(at, x)
            for a, v in zip(at.tolist(), x.view(np.int64).tolist()):
                values = []
                for k in (a + np.flatnonzero(slot[a : a + size])).tolist():
                    stop = place[k] + 1
                    if variant == 2:
                        end = place[k + 1] if k + 1 < len(place) else len(tokens)
                        while stop < end and tokens[stop] not in ".!?\n":
                            stop += 1
                    values.append(" ".join(tokens[place[k] : stop]).lower())
                d = int(inside[a])
                add(keys[d], variant, a - int(first[d]), int(np.searchsorted(words, place[a])) - int(word_first[d]), v, values)
        literal = h[words]
        if wanted is None:
            length = np.bincount(word_text, minlength=len(keys))
            todo = [(n, few & (length == n)) for n in np.unique(length[few & (length > 0)]).tolist()]
        else:
            todo = [(n, None) for n in lengths]
        for n, which in todo:
            at, x = runs(literal, word_text, n)
            if which is not None:
                ok = which[word_text[at]]
                at, x = at[ok], x[ok]
            at, x = let(at, x)
            for a, v in zip(at.tolist(), x.view(np.int64).tolist()):
                begin, last = words[a], words[a + n - 1]
                alone = tokens[begin - 1] in ".!?\n" and (last + 1 == len(tokens) or tokens[last + 1] in ".!?\n")
                if wanted is None or alone or 2 * n >= size:
                    at_word = a - int(word_first[word_text[a]])
                    add(keys[word_text[a]], 3, at_word, at_word, v, [tokens[k].lower() for k in words[a : a + n]])
        return pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(out, kinds)], names=["key", "variant", "pos", "word", "h", "slots"])

    def run(batches):
        codes = Codes()
        keys, tokens, counts = [], [], []
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                own = TOKEN.findall(text or "")
                keys.append(key), counts.append(len(own) + 1)
                tokens.append("\n")
                tokens += own
                if len(tokens) > 1 << 17:
                    yield solve(codes, keys, tokens, counts)
                    keys, tokens, counts = [], [], []
        if keys:
            yield solve(codes, keys, tokens, counts)

    return run


TURNS = 2000


def consistent(found: list[tuple], need: int) -> list[tuple]:
    """The most of the windows ``(bpos, dpos, word, slot pairs)`` whose slot values map one to one together; none if under ``need``.

    Windows agree if each two of them do, so this is a heaviest clique. Windows none of whose pairs clash with any are in it; the others are one node for each set of clashing pairs,
    as heavy as they are many. The search begins with the best of greedy cliques, one from each node, and goes on by branch and bound (nodes that clash with each other can
    give but one): without a limit until ``need`` is reached, so that no item is lost, and from there for ``TURNS`` turns, beyond which the number is a lower bound.
    """
    to: dict = {}
    back: dict = {}
    for w in found:
        for x, y in w[3]:
            to.setdefault(x, set()).add(y)
            back.setdefault(y, set()).add(x)
    free, groups = [], {}
    for w in found:
        clashing = frozenset((x, y) for x, y in w[3] if len(to[x]) > 1 or len(back[y]) > 1)
        if clashing:
            groups.setdefault(clashing, []).append(w)
        else:
            free.append(w)
    if not groups:
        return found if len(found) >= need else []
    if len(found) < need:
        return []
    nodes = sorted(groups, key=lambda g: (-len(groups[g]), sorted(g)))
    weight = [len(groups[g]) for g in nodes]
    holds: dict = {}
    for k, g in enumerate(nodes):
        for pair in g:
            holds[pair] = holds.get(pair, 0) | 1 << k
    beside = []
    for k, g in enumerate(nodes):
        clash = 1 << k
        for x, y in g:
            for z in to[x]:
                clash |= holds.get((x, z), 0) if z != y else 0
            for z in back[y]:
                clash |= holds.get((z, y), 0) if z != x else 0
        beside.append(((1 << len(nodes)) - 1) & ~clash)

    def bits(mask):
        while mask:
            low = mask & -mask
            yield low.bit_length() - 1
            mask ^= low

    best, top = [], -1
    for k in range(len(nodes)):  # greedy: the heaviest that still agrees
        chosen, left = [k], beside[k]
        while left:
            k = (left & -left).bit_length() - 1
            chosen.append(k)
            left &= beside[k]
        if (total := sum(weight[k] for k in chosen)) > top:
            best, top = chosen, total
    turns = 0

    def search(chosen, total, left):
        nonlocal best, top, turns
        if total > top:
            best, top = chosen, total
        turns += 1
        # classes of nodes that all clash with each other: at most one of each can join
        classes, rest, bound = [], left, 0
        while rest:
            own, room = [], rest
            while room:
                k = (room & -room).bit_length() - 1
                own.append(k)
                room &= ~beside[k] & ~(1 << k)
                rest ^= 1 << k
            bound += max(weight[k] for k in own)
            classes.append((bound, own))
        for bound, own in reversed(classes):
            for k in own:
                if total + bound <= top or (turns > TURNS and len(free) + top >= need):
                    return
                search([*chosen, k], total + weight[k], left & beside[k])
                left &= ~(1 << k)

    search([], 0, (1 << len(nodes)) - 1)
    out = free + [w for k in sorted(best) for w in groups[nodes[k]]]
    return sorted(out, key=lambda w: w[:3]) if len(out) >= need else []


def in_order(found: list[tuple]) -> list[tuple]:
    """The longest chain of windows that come one after the other in item and document."""
    ends, at, before = [], [], []
    found = sorted(found, key=lambda w: (w[0], -w[1]))
    for i, w in enumerate(found):
        k = bisect_left(ends, w[1])
        ends[k : k + 1], at[k : k + 1] = [w[1]], [i]
        before.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(found[i])
        i = before[i]
    return out[::-1]


def aligned(found: list[tuple], need: int, drift: int) -> tuple[int, bool, int] | None:
    """(windows, whether exact, first word) of the best place: at one shift, or over shifts that are ``drift`` words apart at most."""
    shifts: dict[int, list] = {}
    for w in set(found):
        shifts.setdefault(w[1] - w[0], []).append(w)
    ways, near = list(shifts.values()), []
    for s in sorted(shifts):
        if near and s - near[-1] > drift:
            ways += [in_order([w for n in near for w in shifts[n]])] if len(near) > 1 else []
            near = []
        near.append(s)
    ways += [in_order([w for n in near for w in shifts[n]])] if len(near) > 1 else []
    best = None
    for way in ways:
        part = consistent(sorted(way, key=lambda w: w[:3]), max(need, best[0] if best else 0))
        if part:
            key = (len(part), all(x == y for w in part for x, y in w[3]), -min(w[2] for w in part))
            best = max(best, key) if best else key
    return best


def _align_batches(drift: int):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    names = ["doc_id", "item_id", "n_windows", "item_windows", "first_word", "exact"]

    def run(batches):
        for batch in batches:
            out = tuple([] for _ in kinds)
            for r in batch.to_pylist():
                found = [(w["bpos"], w["dpos"], w["word"], frozenset((z["x"], z["y"]) for z in w["slots"])) for w in r["found"]]
                if got := aligned(found, r["need"], drift):
                    for col, v in zip(out, (r["doc_id"], r["item_id"], got[0], r["item_windows"], -got[2], got[1])):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return run


FOUND = "key long, variant int, pos int, word int, h long, slots array<string>"


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, least: int = 6, drift: int = 3) -> DataFrame:
    """``doc_id, item_id, n_windows, item_windows, first_word, exact``: benchmark items that stand in documents.

    Both sides become templates; their windows of ``window`` words are joined on the hash. A window counts if its
    slot values can be mapped one to one onto the item's; an item is found in a document where ``least`` windows
    (all, if it has fewer) stand at one distance, or in order at distances ``drift`` words apart at most, and their slots are
    consistent together; windows that clash with the most that agree are left out. ``exact``: the values of the windows
    counted are the same too; otherwise the question was given new parameters. Texts are compared without names, with
    capitalised words inside sentences as slots, and with all capitalised words and runs of them as slots. An item with under
    ``least`` windows is also found where its whole text stands word for word (``n_windows`` is 1); one of under half a window's words
    only as a sentence or line of its own. Null texts and ids are ignored; repeated rows and ties give one row per
    (doc_id, item_id). The benchmark's hashes are filtered by a bitmap of fixed size (2**20 bits) before any shuffle; it decides nothing.
    """
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("key"), "text").distinct()
    items = cut(items.mapInArrow(_find(window, least, None), FOUND).distinct())
    bits = np.zeros(1 << FILTER_BITS, bool)
    used = items.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("b")).distinct()  # 2**20 at most
    bits[[r.b for r in used.collect()]] = True
    totals = items.groupBy("key", "variant").agg(F.countDistinct("pos").alias("item_windows"))
    lengths = sorted(r.n for r in items.where("variant = 3").select(F.size("slots").alias("n")).distinct().collect())
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("key"), "text")
    hits = rows.mapInArrow(_find(window, least, np.packbits(bits).tobytes(), lengths), FOUND)
    pair = hits.alias("d").join(items.alias("b"), ["h", "variant"]).select(
        F.col("d.key").alias("doc_id"), F.col("b.key").alias("item_id"), "variant", F.col("d.pos").alias("dpos"), F.col("b.pos").alias("bpos"), F.col("d.word").alias("word"),
        F.arrays_zip(F.col("b.slots").alias("x"), F.col("d.slots").alias("y")).alias("slots"),
    )
    count = lambda c: F.size(F.array_distinct(c))
    one_to_one = lambda s: (count(s) == count(F.transform(s, lambda z: z["x"]))) & (count(s) == count(F.transform(s, lambda z: z["y"])))
    slots = F.col("slots")
    same = (F.col("variant") < 3) | F.forall("slots", lambda z: z["x"].eqNullSafe(z["y"]))
    lined = (
        pair.where(one_to_one(slots) & same)
        .groupBy("doc_id", "item_id", "variant")  # windows of one document
        .agg(F.collect_set(F.struct("bpos", "dpos", "word", "slots")).alias("found"))
        .join(totals.withColumnRenamed("key", "item_id"), ["item_id", "variant"])
        .withColumn("need", F.least(F.lit(least), F.col("item_windows")))
        .where(F.size("found") >= F.col("need"))
        .mapInArrow(_align_batches(drift), "doc_id long, item_id long, n_windows long, item_windows long, first_word long, exact boolean")
    )
    best = F.struct("n_windows", "exact", (-F.col("first_word")).alias("f"), "item_windows")
    return lined.groupBy("doc_id", "item_id").agg(F.max(best).alias("m")).select(
        "doc_id", "item_id", "m.n_windows", "m.item_windows", (-F.col("m.f")).alias("first_word"), F.col("m.exact").alias("exact"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item was found; columns as given, whatever their names. Rows with null ids are told apart by a hash of their text."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    bad = contaminated(docs.select(key.alias("doc_id"), "text"), benchmark, **parameters).select(F.col("doc_id").alias("ident")).distinct()
    return docs.select(whole(docs), key.alias("ident")).join(bad, "ident", "left_anti").select("doc.*")
