"""License scans: Aho-Corasick over normalised words, shunting-yard over licence expressions."""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The phrases of the contract, then notice phrases and tags of public licences.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by",
    "released into the public domain": "public-domain",
    "all rights reserved": "proprietary",
}
PERMISSIVE = {"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "cc0-1.0", "0bsd", "bsl-1.0", "cc-by-4.0"}
TAG = "spdx license identifier"
TAG_START = re.compile(rb"spdx-license-identifier:", re.I)
LINE_END = re.compile(rb"[\r\n]|\Z")
TOKEN = re.compile(r"\s*(\(|\)|,|/|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
RANK = {",": 0, "or": 1, "/": 1, "and": 2, "with": 3}
SAID = {",": "and", "/": "or"}  # a list names licences that all hold; a slash offers a choice
# Licence identifiers that an expression may name, and exceptions behind "with".
IDS = set(
    "0bsd afl-2.1 afl-3.0 apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause"
    " bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 bzip2-1.0.6 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1"
    " cecill-b cecill-c cpl-1.0 curl ecl-2.0 epl-1.0 epl-2.0 eupl-1.0 eupl-1.1 eupl-1.2 ftl hpnd icu ijg ipl-1.0 isc libpng libpng-2.0 lppl-1.3c mit"
    " mit-0 mit-cmu mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 ofl-1.0 ofl-1.1 openssl osl-3.0"
    " php-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sgi-b-2.0 sleepycat sspl-1.0 tcl unicode-3.0 unicode-dfs-2016 unlicense"
    " upl-1.0 vim w3c wtfpl x11 zlib zlib-acknowledgement zpl-2.0 zpl-2.1".split()
)
EXCEPTIONS = set(
    "autoconf-exception-2.0 autoconf-exception-3.0 bison-exception-2.2 bootloader-exception classpath-exception-2.0 font-exception-2.0"
    " freertos-exception-2.0 gcc-exception-2.0 gcc-exception-3.1 gpl-cc-1.0 libtool-exception linux-syscall-note llvm-exception mif-exception"
    " ocaml-lgpl-linking-exception openjdk-assembly-exception-1.0 qt-gpl-exception-1.0 qt-lgpl-exception-1.1 swift-exception u-boot-exception-2.0"
    " universal-foss-exception-1.0 wxwindows-exception-3.1".split()
)
FAMILIES = re.compile(
    r"(?:(?:gpl-[123]\.0|lgpl-(?:2\.0|2\.1|3\.0)|agpl-[13]\.0|gfdl-1\.[123])(?:-only|-or-later)?|cc-by(?:-nc)?(?:-sa|-nd)?-[1-4]\.0"
    r"|cdla-(?:permissive|sharing)-[12]\.0|bsd-[1-4]-clause-[a-z0-9-]+|hpnd-[a-z0-9-]+|mit-[a-z]+|mpl-[12]\.[01]|(?:epl|osl|afl|artistic|ecl|ofl)-\d\.\d"
    r"|(?:documentref-[a-z0-9.-]+:)?licenseref-[a-z0-9.-]+)"
)

# What a licence that is not in the list looks like: parts between hyphens, a version, or a name in capitals. Prose has none of them.
IDENTIFIER = re.compile(r"[A-Za-z0-9][A-Za-z0-9.]*(?:-[A-Za-z0-9.]+)+\+?|[A-Za-z]+-?\d[\d.]*\+?|[A-Z][A-Z0-9]{2,}\+?")

_LOW = bytes(range(65, 91))
TABLE = bytes(
    (b + 32 if b in _LOW else b) if (0x30 <= b <= 0x39 or b in _LOW or 0x61 <= b <= 0x7A or b >= 0x80) else 32 for b in range(256)
)


def expressions(text: bytes):
    """What stands behind each tag, up to the end of its line or the next tag."""
    tags = list(TAG_START.finditer(text))
    for m, after in zip(tags, [m.start() for m in tags[1:]] + [len(text)]):
        yield text[m.end() : LINE_END.search(text, m.end(), after).start()]


def written(tree) -> str:
    """The text of nested ``(left, operator, right)``, without recursion, as lines may be long."""
    out, todo = [], [tree]
    while todo:
        at = todo.pop()
        if isinstance(at, str):
            out.append(at)
        else:
            left, op, right = at
            todo += [right, " with ", left] if op == "with" else [")", right, f" {op} ", left, "("]
    return "".join(out)


def known(name: str) -> bool:
    """Whether a licence is so called, ``+`` for later versions left aside; own names start with ``LicenseRef-``."""
    name = name.lower().removesuffix("+")
    return name in IDS or bool(FAMILIES.fullmatch(name))


def evaluate(expression: str) -> tuple[str, frozenset[str], bool] | None:
    """``(normalised text, licences named, whether permissive terms can be had)`` of an expression.

    Shunting-yard: ``with`` binds tightest (licence with exception), then ``and``, then ``or``. ``or`` offers
    a choice, so one permissive side is enough; ``and`` needs both; an exception leaves its licence's terms. A comma joins like ``and``,
    but loosest of all, a slash like ``or``. Names are licence identifiers (:func:`known`); another that looks like one (``IDENTIFIER``) is an operand too, of unknown terms, which are
    not permissive, and gives no label, as prose gives none. What follows a well-formed expression is prose too. None where the expression is not well
    formed or names no licence that is known.
    """
    out: list[tuple] = []  # nested text, licences, whether permissive
    ops: list[str] = []

    def apply() -> bool:
        op = ops.pop()
        if op == "(" or len(out) < 2:
            return False
        (bt, bl, bp), (at, al, ap) = out.pop(), out.pop()
        if op == "with":
            if not isinstance(at, str) or not isinstance(bt, str):
                return False
            out.append(((at, op, bt), al, ap))
        else:
            few, many = sorted((al, bl), key=len)
            many |= few
            op = SAID.get(op, op)
            out.append(((at, op, bt), many, (ap or bp) if op == "or" else (ap and bp)))
        return True

    operand, at = True, 0
    while m := TOKEN.match(expression, at):
        token, at = m[1], m.end()
        low = token.lower()
        if low in RANK:
            if operand:
                return None
            while ops and ops[-1] != "(" and RANK[ops[-1]] >= RANK[low]:
                if not apply():
                    return None
            ops.append(low)
            operand = True
        elif token == "(":
            if not operand:
                break  # prose after the expression
            ops.append(token)
        elif token == ")":
            if operand:
                return None
            while ops and ops[-1] != "(":
                if not apply():
                    return None
            if not ops:
                return None
            ops.pop()
        else:
            if not operand:
                break  # prose after the expression
            behind = ops[-1] if ops else ""
            sure = low in EXCEPTIONS if behind == "with" else known(low)
            if not sure and not IDENTIFIER.fullmatch(token):
                if behind not in (",", "/"):
                    return None
                break
            out.append((low, {low} if sure else set(), sure and low in PERMISSIVE))
            operand = False
    if operand and ops and ops[-1] in (",", "/"):  # a comma or slash that no licence follows
        ops.pop()
        operand = False
    while ops:
        if not apply():
            return None
    return (written(out[0][0]), frozenset(out[0][1]), out[0][2]) if len(out) == 1 and not operand and out[0][1] else None


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            a.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    a.make_automaton()
    return a


def scan(text: bytes, machine: ahocorasick.Automaton) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions)."""
    words = text.translate(TABLE).split()
    flat = (b" " + b" ".join(words) + b" ").decode("latin-1")
    base, labels, starts, kinds, found = set(), set(), [], set(), []
    for end, (kind, label, size) in machine.iter(flat):
        kinds.add(kind)
        if kind == "base":
            base.add(label)
            starts.append(end - size + 1)
        if label:
            labels.add(label)
    if "tag" in kinds:
        for expression in expressions(text):
            if value := evaluate(expression.decode("utf-8", "replace")):
                found.append(f"{value[0]}: {'permissive' if value[2] else 'restricted'}")
                labels |= value[1]
    first = flat.count(" ", 0, min(starts)) if starts else None
    last = flat.count(" ", 0, max(starts)) if starts else None
    score = 1.0 if found else 0.9 if base else 0.7 if labels else 0.0
    return (
        len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score, sorted(set(found)),
    )


OUT = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())),
    ]
)


def _scan_batches(batches):
    machine = automaton()
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            rows = [scan(t or b"", machine) for t in part.column("text").to_pylist()]
            cols = list(zip(*rows)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([part.column("doc_id")] + [pa.array(c, t.type) for c, t in zip(cols, list(OUT)[1:])], schema=OUT)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Licence labels of every document, in one pass with no shuffle.

    Base phrases, notice phrases and tags are found by one automaton over the lower-cased words of the
    whole text; where a tag stands, the expression after it is parsed and adds its licences. ``score``: 1
    for a parsed expression, 0.9 for a base phrase, 0.7 for a notice, else 0. Null text counts as empty; repeated
    rows are scanned alike; expressions that do not parse add nothing; other columns are not read.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        _scan_batches,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>",
    )
