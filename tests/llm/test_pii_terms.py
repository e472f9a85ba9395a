"""Disclosing terms of rare values, against counts in plain Python."""

import math
import re
import time

from tessellar.llm import pii, queries


def filler(i, n=12):
    return " ".join("".join(chr(97 + (i * 7 + j * (k + 3) + k * k) % 26) for k in range(6)) for j in range(n))


def marked(df, rows):
    texts = dict(rows)
    return {r.doc_id: {texts[r.doc_id][int(a) : int(b)].lower() for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "term"} for r in df.collect()}


def test_values_in_few_documents(spark):
    """Two mentions of a value, and values of one mention each on one domain, are judged wherever the term stands; copies prove nothing of a word out of reach."""
    rows = [(i, filler(i)) for i in range(400)]
    rows += [(1000 + i, f"{filler(500 + i)} zorblatt {filler(600 + i, 20)} write to kim@corp.com for it {filler(700 + i)}") for i in range(2)]
    rows += [(1100 + i, f"{filler(800 + i)} quuxley {filler(820 + i, 20)} ask p{i}@pool.org {filler(840 + i)}") for i in range(3)]
    rows += [(1200 + i, f"farword {filler(900, 20)} copyword x@once.net {filler(901)}") for i in range(6)]
    got = marked(pii.report(spark.createDataFrame(rows, "doc_id bigint, text string")), rows)
    assert all("zorblatt" in got[1000 + i] for i in range(2)) and all("quuxley" in got[1100 + i] for i in range(3))
    assert all("copyword" in got[1200 + i] and "farword" not in got[1200 + i] for i in range(6)) and not any(got[i] for i in range(400))


def test_near_terms_in_plain_python(spark):
    """Rare words within reach are marked by the smoothed estimate, common ones are not; repeated rows count as rows."""
    rows = [(i, f"ask about common things number{i}") for i in range(200)]
    rows += [(500, "common zorblatt kim@corp.com things")] * 3 + [(501, "common quux lee@corp.org things"), (502, "quux alone")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = marked(pii.report(docs), rows)
    n, words = len(rows), lambda t: set(re.findall(r"\w+", t))
    for doc, near in ((500, ["common", "zorblatt", "things"]), (501, ["common", "quux", "things"])):
        n_e = sum(r[0] == doc for r in rows)
        for w in near:
            n_t = sum(w in words(t) for _, t in rows)
            told = math.log(n * (n_e + pii.SMOOTHING * n_e / n) / (n_e * (n_t + pii.SMOOTHING)))
            assert (w in got[doc]) == (told >= pii.DISCLOSURE * math.log(n / n_e)), w
    assert "zorblatt" in got[500] and not {"common", "things"} & got[500] and not got[502]


def test_texts_with_very_many_matches(spark):
    """Cost grows in proportion to the matches, valid or not."""
    docs = spark.createDataFrame([(1, "12 , " * 1_000_000), (2, " ".join(f"u{i}@m{i % 7}.example.com" for i in range(5000)))], "doc_id bigint, text string")
    began = time.time()
    got = {r.doc_id: (r.n_card, r.n_email) for r in pii.report(docs).select("doc_id", "n_card", "n_email").collect()}
    assert got == {1: (0, 0), 2: (0, 5000)} and time.time() - began < 60


def test_chance_bounds_the_hypergeometric_tail(spark):
    cases = [(c, k, t, n) for n in (50.0, 400.0) for c in (2, 5, 9) for k in range(1, c + 1) for t in (k, k + 3, 20)]
    df = spark.createDataFrame(cases, "c int, k int, t int, n double")
    from pyspark.sql import functions as F

    for (c, k, t, n), r in zip(cases, df.select(pii.log_chance(F.col("c"), F.col("k"), F.col("t"), F.col("n")).alias("p")).collect()):
        tail = sum(math.comb(t, j) * math.comb(int(n) - t, c - j) for j in range(k, min(c, t) + 1)) / math.comb(int(n), c)
        assert tail <= math.exp(r.p) * (1 + 1e-9)


def test_whole_texts_short_names_codes_and_unsegmented_scripts(spark):
    """A name far from the address, a code and a name within an unsegmented run are marked wherever they stand."""
    rows = [(i, filler(i) + " 今日は天気がいいので山へ行く") for i in range(300)]
    rows += [(1000 + i, f"Kim {filler(500 + i, 30)} KIM x7y9 {filler(600 + i, 30)} 今日は龍馬が来た。龍馬 {filler(650 + i)} at kx@corp.com {filler(700 + i)}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    spans = {r.doc_id: [s.split(":")[1:] for s in r.spans.split(",") if s.startswith("term")] for r in pii.report(docs).collect()}
    for i, text in rows[-4:]:
        found = [(int(a), int(b)) for a, b in spans[i]]
        covered = {p for a, b in found for p in range(a, b)}
        for name in ("Kim", "KIM", "x7y9", "龍馬"):
            places = [m.start() for m in re.finditer(name, text)]
            assert places and all(set(range(p, p + len(name))) <= covered for p in places), name
        day = text.index("今日")
        assert not {day, day + 1} & covered
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert not any(re.search("kim|x7y9|龍馬|corp", clean[1000 + i], re.I) for i in range(4)) and clean[5] == rows[5][1]


def test_words_in_plain_python(spark):
    """Distinct terms, by an independent reading."""
    from pyspark.sql import functions as F

    texts = ["ann lee a1-b2 é", "日本語 x日本y 語", "", "ไทย foo", "a_b naïve"]
    got = [set(r[0]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(pii.words(F.col("t"))).collect()]
    assert got == [{"ann", "lee", "a1", "b2", "é"}, {"日本", "本語", "x", "y", "語"}, set(), {"ไท", "ทย", "foo"}, {"a", "b", "naïve"}]


def test_odd_rows_and_empty_tables(odd_docs, no_docs):
    assert pii.report(odd_docs).count() == odd_docs.count() == pii.sanitise(odd_docs).count()
    assert pii.report(no_docs).count() == 0
