"""Stages against plain versions; the outlier search, the mixture and the token shards have theirs in the operators' tests."""

import re
from collections import Counter

import corpus_pipeline


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0


def test_run_gives_all_slots(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


BLANK, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_near_duplicates_in_plain_python(spark, odd_docs, odd_rows):
    """One row of each component stays, the least by id; wordless texts stay; identical rows are one."""
    rows = list(dict.fromkeys(odd_rows))
    sets = []
    for _, t in rows:
        w = BLANK.findall(lower(t))
        sets.append({tuple(w[a : a + 5]) for a in range(max(len(w) - 4, 1))} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    rank = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    kept = Counter(rows[min((i for i in range(len(rows)) if group[i] == g), key=rank)][0] for g in set(group))
    got = corpus_pipeline.near_duplicates(spark, odd_docs, "")
    assert Counter(r.doc_id for r in got.collect()) == kept


def test_decontaminate_in_plain_python(spark, odd_docs, odd_rows, tmp_path):
    """Passages are cut out until none is left; rows left without text go, all others stay as they are."""
    items = [(1, odd_rows[5][1][:120]), (2, "one two"), (3, None), (4, odd_rows[0][1])]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    windows = set()
    for _, t in items:
        w = ALNUM.findall(lower(t))
        windows |= {tuple(w[a : a + 10]) for a in range(max(len(w) - 9, 1) if w else 0)}

    def cut(t):
        while True:
            found = list(ALNUM.finditer(lower(t)))
            w = [m[0] for m in found]
            spans = [(found[a].start(), found[a + len(k) - 1].end()) for k in windows for a in range(len(w) - len(k) + 1) if tuple(w[a : a + len(k)]) == k]
            if not spans:
                return t
            t = "".join(c for p, c in enumerate(t) if not any(a <= p < b for a, b in spans))

    expected = Counter()
    for i, t in odd_rows:
        after = cut(t) if t is not None else None
        if after == t or after.strip():
            expected[(i, after)] += 1
    got = corpus_pipeline.decontaminate(spark, odd_docs, str(tmp_path))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == expected


def test_stages_on_empty_tables(spark, no_docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0, name
