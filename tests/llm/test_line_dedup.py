"""Line dedup against a plain version."""

import hashlib
from collections import defaultdict

from tessellar.llm import line_dedup

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(rows, min_docs, min_chars=1):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(("id", i) if i is not None else ("text", t))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def digests(rows):
    return sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in rows), key=str)


def test_equals_plain(spark, odd_docs, odd_rows):
    for min_docs in (1, 2, 3):
        got = sorted(map(tuple, line_dedup.report(odd_docs, min_docs).collect()), key=str)
        assert got == digests(plain(odd_rows, min_docs))


def test_shared_lines(spark):
    footer = ["  Terms OF use\t", "terms of USE", "TERMS OF USE\r"]
    rows = [(i, f"own {i}\n{footer[i % 3]}\n\n{'x' if i < 9 else 'y'}\nÉ É\n") for i in range(20)]
    rows += [(100, "terms of use\n" * 3000 + "last"), (101, "É é"), (102, "terms of use"), (102, "terms of use"), (None, "y"), (None, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, line_dedup.report(docs).collect()), key=str) == digests(plain(rows, 10))
    texts = sorted(((r.doc_id, r.text) for r in line_dedup.clean(docs).collect()), key=str)
    assert texts == sorted(((i, t) for i, _, _, t in plain(rows, 10)), key=str)
    long = dict(t for t in texts if t[0] is not None)
    assert long[100] == "last" and "x" in long[3] and "y" not in long[15].replace("own", "")


def test_light_and_heavy_keys(spark, monkeypatch):
    rows = [(i, f"a\nb{i % 3}\nc{i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for heavy in (1, 3, 4096):
        monkeypatch.setattr(line_dedup, "HEAVY", heavy)
        assert sorted(map(tuple, line_dedup.report(docs).collect()), key=str) == digests(plain(rows, 10))


def test_columns_and_empty(spark, odd_docs, no_docs):
    assert line_dedup.clean(odd_docs).columns == odd_docs.columns
    assert line_dedup.report(no_docs).count() == 0 and line_dedup.clean(no_docs).count() == 0
    clash = odd_docs.selectExpr("doc_id", "text", "1 AS _lines", "2 AS _drop", "3 AS _u1", "4 AS h1")
    out = line_dedup.clean(clash)
    assert out.columns == clash.columns and out.count() == odd_docs.count()
    row = out.first()
    assert (row["_lines"], row["_drop"], row["_u1"], row["h1"]) == (1, 2, 3, 4)
