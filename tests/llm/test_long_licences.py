"""Licence expressions of any length."""

from tracegraph.llm.license import automaton, evaluate, scan, scan_licenses


def test_long_expression():
    names = [f"licenseref-{k}" for k in range(3000)]
    text = "x\nSPDX-License-Identifier: (" + " AND ".join(names) + ") OR MIT\nSPDX-License-Identifier: ISC SPDX-License-Identifier: Zlib\r\nGPL-2.0"
    got = scan(text.encode(), automaton())
    assert set(got[5].split(",")) == {*names, "mit", "isc", "zlib"} and got[6] == 1.0 and len(got[7]) == 3
    assert evaluate("Ruby AND GPL-2.0+ with LLVM-exception or X11") == ("((ruby and gpl-2.0+ with llvm-exception) or x11)", {"ruby", "gpl-2.0+", "x11"}, False)
    assert evaluate("(mit or isc) with llvm-exception") is None and evaluate("mit with llvm-exception with llvm-exception") is None


# (what stands behind the tag, labels, whether permissive terms can be had)
CASES = [
    ("MIT", "mit", True), ("MIT */", "mit", True), ("MIT -->", "mit", True), ("(MIT)", "mit", True), ("MIT see the file", "mit", True),
    ("see file for details", "", None), ("NotALicence-9.9", "", None), ("MIT OR NotALicence-9.9", "mit", True), ("MIT WITH nothing-known", "mit", True),
    ("GPL-2.0-only, MIT", "gpl-2.0-only,mit", False), ("MIT, ISC unlike others", "isc,mit", True), ("MIT and others", "", None), ("MIT, see LICENSE", "mit", True), ("MIT/Apache-2.0", "apache-2.0,mit", True),
    ("GPL-3.0-or-later WITH GCC-exception-3.1", "gpl-3.0-or-later", False), ("mit and (isc or agpl-3.0)", "agpl-3.0,isc,mit", True), ("mit and isc and agpl-3.0", "agpl-3.0,isc,mit", False),
    ("MIT)", "", None), ("(MIT", "", None), ("AND MIT", "", None), ("", "", None), ("CC-BY-SA-4.0", "cc-by-sa-4.0", False), ("LicenseRef-My-Own", "licenseref-my-own", False),
]


def test_table_of_labels(spark):
    """Labels, score and expressions of a table, row by row."""
    notices = [("This is under the MIT license.", "mit", "mit", 0.9), ("Mozilla Public License", "", "mpl", 0.7), ("cc by nc, all rights reserved", "cc-by-nc", "cc-by-nc,proprietary", 0.9), ("words only", "", "", 0.0), (None, "", "", 0.0)]
    rows = [(f"// SPDX-License-Identifier: {said}\nSPDX-License-Identifier is a tag", "", labels, 1.0 if labels else 0.0, free) for said, labels, free in CASES]
    rows += [(*n, None) for n in notices] + [("under the mit license\nSPDX-License-Identifier: ISC", "mit", "isc,mit", 1.0, True)]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(df).collect()}
    for i, (text, base, labels, score, free) in enumerate(rows):
        r = got[i]
        assert (r.base_labels, r.labels, r.score) == (base, labels, score), (text, r)
        assert [e.rsplit(": ", 1)[1] == "permissive" for e in r.expressions] == ([] if free is None else [free]), text
