"""Source divergence against a plain version in Python's integers."""

import random
import re
from collections import Counter

import pytest
from tessellar.llm import source_divergence as sd

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, min_docs=10, k=10):
    docs, counts = Counter(), Counter()
    groups = set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]
        docs.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    kept = {}
    for (lang, t), n in docs.items():
        if n >= min_docs:
            kept.setdefault(lang, []).append(t)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang in {g[0] for g in groups}:
        terms, sources = kept.get(lang, []), sorted(s for l, s in groups if l == lang)
        table = {s: {t: counts[lang, s, t] for t in terms} for s in sources}
        whole = {t: sum(table[s][t] for s in sources) for t in terms}
        chance = lambda c: {t: 1 + sd.SCALE * (c[t] + 2) // (sum(c.values()) + 2 * len(terms)) for t in terms}
        p, q = {s: chance(table[s]) for s in sources}, chance(whole)
        for s in sources:
            values = [(sum(f(p[s][t], p[o][t]) for t in terms), o) for o in sources if o != s]
            top = [(f(p[s][t], q[t]), t) for t in terms if table[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", values, len(values)), ("term", top, k)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i + 1) for i, (v, item) in enumerate(found[:most])]
    return sorted(out)


def rows_of(seed, n=220):
    rng = random.Random(seed)
    vocabulary = [a + b for a in ("al", "be", "Ga", "é", "日", "ß") for b in ("pha", "ta", "MMA", "x", "ñ", "")]
    rows = []
    for i in range(n):
        own = rng.sample(vocabulary, 12)
        source = rng.choice(["s1", "s2", "s3", "s10", "", None, "É"])
        text = " ".join(rng.choice(own) + rng.choice(["", ",", "1", "-b", "'s"]) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "en", "de", None]), source, rng.choice([text, text, text, None, ""]) if i % 9 else text))
    return rows + [("xx", "only", None), ("xx", "two", "rare words here"), ("yy", "lone", "w " * 30)] + [("yy", "lone", "w")] * 12


def columns(rows):
    return [(i, t, l, s, 1, "x") for i, (l, s, t) in enumerate(rows)]


SCHEMA = "doc_id bigint, text string, lang string, source string, place int, term string"


@pytest.mark.parametrize("seed, block, first", [(1, 512, 4), (2, 2, 1)])
def test_equals_plain(spark, monkeypatch, seed, block, first):
    monkeypatch.setattr(sd, "FIRST", first)
    monkeypatch.setattr(sd, "GROW", 2)
    rows = rows_of(seed)
    out = sd.report(spark.createDataFrame(columns(rows), SCHEMA), block=block)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, out.collect())) == plain(rows)


def test_many_sources(spark):
    """More sources than a block holds: the grid of blocks adds up to the same sums."""
    rng = random.Random(7)
    rows = [("en", f"s{i % 53}", " ".join(rng.choice(["a", "b", "c", "d"]) for _ in range(5))) for i in range(212)]
    counts = sd.Counts(spark.createDataFrame(columns(rows), SCHEMA))
    names = {r.place: r.source for r in counts.groups.collect()}
    got = {(names[r.x], names[r.y]): r.value for r in sd.pairs(counts, 16).collect()}
    expected = {(s, item): v for _, s, part, item, v, _ in plain(rows) if part == "pair"}
    assert got == expected


def test_words_are_bytes():
    text = "Naïve café-Ünï 日本語 x1Y\x00z [A]Ab_c"
    assert [w.decode() for w in sd.words(text.encode())] == ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text)]


def test_flushes(spark, monkeypatch):
    rows = rows_of(4)
    batches = spark.createDataFrame(columns(rows), SCHEMA).selectExpr("coalesce(lang,'')", "coalesce(source,'')", "coalesce(text,'')").toArrow().to_batches()
    monkeypatch.setattr(sd, "HELD", 10**9)
    whole, parts = Counter(), Counter()
    for b in sd._count(batches):
        for r in b.to_pylist():
            whole[r["lang"], r["source"], r["term"]] += r["n"] * 10**6 + r["docs"]
    monkeypatch.setattr(sd, "HELD", 5)
    for b in sd._count(batches):
        for r in b.to_pylist():
            parts[r["lang"], r["source"], r["term"]] += r["n"] * 10**6 + r["docs"]
    assert whole == parts


def test_empty(spark, no_docs):
    assert sd.report(no_docs).count() == 0
