"""Operators against brute force over the same odd rows, and on empty tables."""

import base64
import gzip
import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessellar.llm import decontamination, kernels, mixing, ngram_join, permutation, pii, quality_classifier, quality_rules, queries, substring_dedup, token_counts, token_ids, warc

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_kernels_cut_words_and_windows():
    texts = ["a bc  d", None, "", " x ", "yy zz"]
    data, offsets = kernels.utf8(pa.array(texts))
    starts, ends, rows = kernels.words(data, offsets, kernels.BLANK_SEPARATED)
    assert [bytes(data[a:b]).decode() for a, b in zip(starts, ends)] == ["a", "bc", "d", "x", "yy", "zz"]
    assert rows.tolist() == [0, 3, 3, 3, 4, 6] and kernels.window_starts(rows, 2).tolist() == [0, 1, 4]
    h = kernels.word_hashes(data, starts, ends)
    assert len(set(h.tolist())) == 6
    assert kernels.unpack_bytes(kernels.pack_bytes(h, 8), 8).tolist() == h.tolist()


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000])
def test_feistel_is_a_permutation(n):
    assert sorted(permutation.feistel(np.arange(n), n, 5).tolist()) == list(range(n))


def test_decontamination(spark, odd_docs, odd_rows, no_docs):
    items = [(1, odd_rows[5][1][:120]), (2, "one two"), (3, None), (4, "..."), (None, "naïve café"), (12, odd_rows[0][1]), (12, odd_rows[0][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    wins = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        for a in range(max(len(w) - 9, 1) if w else 0):
            wins[tuple(w[a : a + 10])].add("" if i is None else str(i))
    expected = []
    for i, t in odd_rows:
        w, hit, names = ALNUM.findall(lower(t)), set(), set()
        for k, v in wins.items():
            for a in range(len(w) - len(k) + 1):
                if tuple(w[a : a + len(k)]) == k:
                    hit |= set(range(a, a + len(k)))
                    names |= v
        expected.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    assert rows_of(decontamination.report(odd_docs, bench)) == sorted(expected, key=repr)
    cleaned = decontamination.clean(odd_docs, bench)
    assert cleaned.columns == odd_docs.columns and not decontamination.report(cleaned, bench).where("contaminated").count()
    assert decontamination.report(no_docs, bench).count() == 0
    assert decontamination.report(odd_docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.Blocks(bench, "item_id", "text", 10, 100).n > 1
    again = decontamination.clean(odd_docs, bench, block_bytes=100)
    assert not decontamination.report(again, bench).where("contaminated").count() and again.count() == cleaned.count()
    assert rows_of(decontamination.report(odd_docs, bench, block_bytes=100)) == sorted(expected, key=repr)


def test_substring_dedup(odd_docs, odd_rows, no_docs):
    rank = lambda i: (i is None, i or 0)
    first = {}
    for i, t in odd_rows:
        w = BLANK.findall(t or "")
        for a in range(len(w) - 12):
            k = tuple(w[a : a + 13])
            first[k] = min(first.get(k, rank(i)), rank(i))
    expected = []
    for i, t in odd_rows:
        w = BLANK.findall(t or "")
        gone = set()
        for a in range(len(w) - 12):
            if first[tuple(w[a : a + 13])] < rank(i):
                gone |= set(range(a, a + 13))
        kept = " ".join(x for a, x in enumerate(w) if a not in gone)
        expected.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert rows_of(substring_dedup.report(odd_docs)) == sorted(expected, key=repr)
    assert rows_of(substring_dedup.report(odd_docs, print_bits=0)) == sorted(expected, key=repr)
    assert substring_dedup.report(no_docs).count() == 0


def test_ngram_join(odd_docs, odd_rows, no_docs):
    sets = []
    for _, t in odd_rows:
        w = BLANK.findall(lower(t))
        sets.append({tuple(w[a : a + 5]) for a in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, _) in enumerate(odd_rows):
        if i is not None:
            least[find(a)].append(i)
    expected = [(i, len(sets[a]), min(least[find(a)], default=None)) for a, (i, _) in enumerate(odd_rows)]
    assert rows_of(ngram_join.report(odd_docs)) == sorted(expected, key=repr)
    found, members = ngram_join.links(odd_docs)
    head = {r.uid: r.head for r in members.collect()}
    of = {(r.doc_id, r.uid) for r in members.collect()}
    pairs = {frozenset((r.u, r.v)) for r in found.collect()}
    linked = {frozenset((repr(a), repr(b))) for a, _ in of for b, _ in of if any(frozenset((head[x], head[y])) in pairs or (head[x] == head[y] and x != y) for c, x in of if c == a for d, y in of if d == b)}
    ids = [i for i, _ in odd_rows]
    exact = {frozenset((repr(ids[a]), repr(ids[b]))) for a in range(len(sets)) for b in range(a) if odd_rows[a] != odd_rows[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert linked == exact
    left = ngram_join.representatives(odd_docs)
    assert left.columns == odd_docs.columns and ngram_join.report(left).where("doc_id <> component_id").count() == 0
    assert ngram_join.report(no_docs).count() == 0


def test_ngram_join_chain_of_near_copies(spark):
    """Each text shares enough with its neighbours only: the component must still be one."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[i * 8 : i * 8 + 100])) for i in range(30)]
    got = ngram_join.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_ngram_join_against_brute_force_near_the_bound(spark):
    """Random sets whose overlaps lie around three quarters, of many sizes: every link, and none besides."""
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(120):
        words = list(base[: rng.integers(5, 60)])
        for _ in range(rng.integers(0, 4)):
            words[rng.integers(0, len(words))] = f"x{rng.integers(0, 6)}"
        texts.append(" ".join(words))
    sets = [{tuple(w[a : a + 5]) for a in range(len(w) - 4)} for w in (t.split() for t in texts)]
    exact = {frozenset((a, b)) for a in range(120) for b in range(a) if sets[a] != sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    found, members = ngram_join.links(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    rows = defaultdict(list)
    for r in members.collect():
        rows[r.head].append(r.doc_id)
    got = {frozenset((a, b)) for r in found.collect() for a in rows[r.u] for b in rows[r.v]}
    assert got == exact and len(exact) > 100


def test_ngram_join_template_costs_its_length(spark):
    """Pages that share most of a template and do not link: their lists are not met with themselves."""
    words = " ".join(f"t{i}" for i in range(84))
    rows = [(i, f"{words} " + " ".join(f"p{i}q{j}" for j in range(20))) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    *_, lists = ngram_join.indexed(docs)
    assert lists.count() > 6000 and ngram_join._reachable(ngram_join._labelled(lists, None)).count() == 0
    assert ngram_join.report(docs).where("doc_id <> component_id").count() == 0


def test_mixing(odd_docs, odd_rows, no_docs):
    first, again = rows_of(mixing.report(odd_docs, block_len=16)), rows_of(mixing.report(odd_docs, block_len=16))
    assert first == again and len(first) == len(odd_rows)
    source = [None if k % 5 == 0 else f"s{k % 3}" for k in range(len(odd_rows))]
    size = Counter()
    for s, (_, t) in zip(source, odd_rows):
        size[s] += len(BLANK.findall(t or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, free = sum(size.values()), {}, set(order)
    while True:
        left = total - sum(3 * size[s] for s in order if s not in free)
        target = {s: left * weight[s] / sum(weight[x] for x in free) if s in free else 3 * size[s] for s in order}
        over = {s for s in free if target[s] > 3 * size[s]}
        if not over:
            break
        free -= over
    got = {r.source_size: r.target for r in mixing.report(odd_docs, block_len=16).collect()}
    assert got == pytest.approx({size[s]: target[s] for s in order})
    assert all(r[4] <= 3 * r[1] for r in first)
    assert abs(sum(r[4] for r in first) - total) < 0.05 * total
    taken = Counter()
    for r in mixing.report(odd_docs, block_len=16).collect():
        taken[r.source_size] += r.taken
    for s in order:  # rounding to whole blocks, and the last block of a source
        assert abs(taken[size[s]] - target[s]) <= 3 * 16 + 1, s
    mixed = mixing.mix(odd_docs, block_len=16)
    assert mixed.columns == odd_docs.columns
    words = sum(len(BLANK.findall(r.text)) for r in mixed.collect())
    assert words == sum(taken.values())  # repeated rows are taken as the report says
    assert mixing.report(no_docs).count() == 0


def test_draws_meet_the_quota():
    quota = np.array([0, 5, 1000, 37])
    rows = list(mixing.draws(quota, 64, 3))
    assert [sum(r[3] for r in rows if r[1] == s) for s in range(4)] == quota.tolist()
    assert len({r[0] for r in rows}) == -(-1042 // 64) and rows == [r for a in range(17) for r in mixing.draws(quota, 64, 3, a, a + 1)]
    assert all(sum(r[3] for r in rows if r[0] == a) == 64 for a in range(16))
    for s in range(4):  # slots of a source follow one another without a gap
        spans = sorted((r[2], r[3]) for r in rows if r[1] == s)
        assert [a for a, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))]


def test_token_counts(odd_docs, odd_rows, no_docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    pieces = token_counts.read_pieces(token_counts.default_vocabulary())
    exact = Tokenizer(models.Unigram([("<unk>", 0.0)] + [(f"<0x{i:02X}>", 0.0) for i in range(256)] + pieces, unk_id=0, byte_fallback=True))
    exact.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    got = rows_of(token_counts.report(odd_docs).select("doc_id", "n_chars", "n_tokens"))
    assert got == sorted(((i, len(t or ""), len(exact.encode(t or "").ids)) for i, t in odd_rows), key=repr)
    assert token_counts.report(no_docs).count() == 0


def test_token_count_ties():
    counter = token_counts.Counter([("a", -1.0), ("b", -1.0), ("ab", -2.0), ("abc", -3.0), ("c", -1.0)], byte_fallback=False)
    assert counter.count("abc") == (1, 0)  # all segmentations tie: the earliest start stays
    assert counter.count("zzab") == (2, 1) and counter.count("") == (0, 0)


def test_token_shards(spark, odd_docs, odd_rows, no_docs, tmp_path):
    manifest = token_ids.materialise(odd_docs, str(tmp_path / "a"), seq_len=64, shard_slots=16, stable=False).orderBy("slot").collect()
    assert [r.slot for r in manifest] == list(range(len(manifest)))
    coder, end = token_ids.encoding(*token_ids.default_tokenizer())
    assert sum(r.n_tokens for r in manifest) == sum(len(coder.encode_ordinary(t or "")) + 1 for _, t in odd_rows)
    for r in manifest:
        ids = token_ids.read(r.path, r.slot, 1, seq_len=64, shard_slots=16)[0]
        assert hashlib.sha256(ids.tobytes()).hexdigest() == r.tokens_sha256
        assert r.byte_offset == r.slot % 16 * 128
    # the shards, read in the order before the permutation, hold every document whole
    order = permutation.feistel(np.arange(len(manifest)), len(manifest), token_ids.SEED)
    ids = np.concatenate([token_ids.read(manifest[s].path, s, 1, seq_len=64, shard_slots=16)[0][: manifest[s].n_tokens] for s in order.tolist()])
    ends = np.flatnonzero(ids == end)
    texts = [coder.decode(x[:-1].tolist()) for x in np.split(ids, ends + 1)[:-1]]
    assert sorted(texts) == sorted(t or "" for _, t in odd_rows) and ends[-1] == len(ids) - 1
    assert token_ids.materialise(no_docs, str(tmp_path / "b"), stable=False).count() == 0


def test_token_ids_that_do_not_fit(monkeypatch):
    monkeypatch.setattr(token_ids, "encoding", lambda *_: (None, 1 << 16))
    with pytest.raises(ValueError):
        token_ids.BatchCoder(("", ""))


def test_batch_coder_is_exact():
    coder = token_ids.BatchCoder(token_ids.default_tokenizer())
    texts = ["a b", " a  b", "", None, "x ", " x", "it's 's\n\n y", "a  b", "日本  語", "\n\nq r\n", "don't   stop", " "]
    counts, ids = coder.encode(pa.array(texts))
    exact = [coder.coder.encode_ordinary(t or "") for t in texts]
    assert counts.tolist() == [len(x) for x in exact] and ids.tolist() == [y for x in exact for y in x]


def test_warc(spark, tmp_path):
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "a b\r\nc", "é" * 200_000), (6, "", "é" * 200_000), (7, "u", "WARC/1.1\r\n\r\n"), (None, "n", "only")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id bigint, url string, html string, payload string")
    first = {}
    for i, _, h in sorted(rows[:-1]) + rows[-1:]:
        first.setdefault(h or "", i)
    expected = []
    for i, _, h in rows:
        data = (h or "").encode()
        other = first[h or ""] != i
        expected.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if other else "response", first[h or ""] if other else None, True))
    assert rows_of(warc.report(pages)) == sorted(expected, key=repr)
    files, folder = warc.archive(pages, str(tmp_path / "w"), chunk=1000)
    chunks = warc.read_chunks(files, folder, chunk=4096)
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] <= 4096 and chunks.where("chunk_no > 0").count() > 90
    assert warc.report(pages.limit(0)).count() == 0
    raw = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "w").glob("*.gz")))
    ids = re.findall(rb"WARC-Record-ID: (\S+)", raw)
    assert raw.count(b"WARC-Type: response") == sum(e[3] == "response" for e in expected) and len(set(ids)) == len(ids) == len(rows)
    assert set(re.findall(rb"WARC-Refers-To: (\S+)", raw)) <= set(ids)
    assert chunks.rdd.getNumPartitions() == files.count()


def test_warc_repeated_rows_and_many_copies(spark):
    rows = [(1, "u", "same")] * 3 + [(2, "u", "same")] * 2 + [(i, "u", None) for i in range(10, 60)]
    got = Counter(tuple(r) for r in warc.report(spark.createDataFrame(rows, "page_id bigint, url string, html string")).select("page_id", "record_type", "refers_to", "verified").collect())
    assert got[(1, "response", None, True)] == 3 and got[(2, "revisit", 1, True)] == 2 and got[(10, "response", None, True)] == 1 and got[(59, "revisit", 10, True)] == 1 and sum(got.values()) == 55


def test_warc_of_another_writer(spark, tmp_path):
    """Types, payloads and lengths as the archive states them, without private headers."""
    record = lambda kind, headers, block: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{kind}>\r\n{headers}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    http = "Content-Type: application/http;msgtype=response\r\n"
    parts = [record("warcinfo", "Content-Type: application/warc-fields\r\n", b"software: x\r\n"), record("request", "Content-Type: application/http;msgtype=request\r\n", b"GET / HTTP/1.1\r\n\r\n"), record("response", http, b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody"), record("revisit", http, b"HTTP/1.1 304\r\n\r\n"), record("resource", "", b"")]
    path = tmp_path / "other.warc.gz"
    path.write_bytes(b"".join(gzip.compress(p) for p in parts))
    got = warc.read_chunks(spark.createDataFrame([(str(path),)], "path string"), str(tmp_path)).orderBy("record_no").collect()
    assert [(r.record_type, r.payload_bytes, r.page_id) for r in got] == [("warcinfo", 13, None), ("request", 18, None), ("response", 4, None), ("revisit", None, None), ("resource", 0, None)]
    assert bytes(got[2].data) == b"body" and got[2].running_sha1 == base64.b32encode(hashlib.sha1(b"body").digest()).decode()


def test_quality_rules_base(odd_docs, odd_rows, no_docs):
    expected = []
    for i, t in odd_rows:
        t = t or ""
        w = BLANK.findall(t)
        lines = [x for x in t.split("\n") if BLANK.search(x)]
        c = Counter(tuple(w[a : a + 3]) for a in range(len(w) - 2))
        again = {a + j for a in range(len(w) - 2) if c[tuple(w[a : a + 3])] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        expected.append((i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(again), failed))
    assert rows_of(quality_rules.report(odd_docs).drop("distance", "kept")) == sorted(expected, key=repr)
    assert quality_rules.select(odd_docs).columns == odd_docs.columns
    assert quality_rules.report(no_docs).count() == 0


def test_quality_rules_reject_the_outliers(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(3, 8))) for _ in range(120)), "en", "s") for i in range(200)]
    rows += [(1000 + i, " ".join("ab###$$$" for _ in range(20)) + " " + " ".join(f"z{i}q{j}%%" for j in range(60)), "en", "s") for i in range(20)]
    kept = {r.doc_id: r.kept for r in quality_rules.report(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")).collect()}
    assert all(kept[i] for i in range(200)) and not any(kept[1000 + i] for i in range(20))


def test_pii_base(odd_docs, no_docs, spark):
    texts = ["a@b.c%x@y.z 1.2.3.4.5 256.1.1.1 001.2.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (415) 555-2671 é q@w.fr.", "x" * 50_000 + "@h.io", "." * 30_000, "1" * 30_000, "@@ a@b a@b..c", None, ""]
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda v: [int(c) for c in v if c in "0123456789"]
    luhn = lambda d: sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d[::-1])) % 10 == 0
    valid = {"email": lambda v: True, "ip": lambda v: all(int(x) <= 255 for x in v.split(".")), "card": lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v)), "phone": lambda v: 9 <= len(digits(v)) <= 15}
    expected = []
    for i, t in enumerate(texts):
        spans = [(k, m.start(), m.end()) for k in patterns for m in (re.finditer(patterns[k], t or "") if len(t or "") < 10_000 else []) if valid[k](m[0])]
        if i == 3:
            spans = [("email", 0, len(t))]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        expected.append((i, *[sum(s[0] == k for s in spans) for k in patterns], hashlib.sha256(listed.encode()).hexdigest(), listed, 0))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert rows_of(pii.report(docs)) == sorted(expected, key=repr)
    assert pii.sanitise(docs).where("doc_id = 2").first().text == "[PHONE] é [EMAIL]."
    assert pii.report(no_docs).count() == 0 and pii.sanitise(odd_docs).count() == odd_docs.count()


def test_pii_terms_that_disclose(spark):
    rows = [(i, f"{'abcdefgh'[i]}{i} zorblatt wrote from kim@corp.com about item{i} today") for i in range(8)]
    rows += [(100 + i, f"about other things today number {i}") for i in range(60)]
    report = pii.report(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = {r.doc_id: r.spans for r in report.collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    con.execute(queries.ORACLE_SQL["op8_pii"])
    names = [d[0] for d in con.description]
    assert rows_of(report.select(*names)) == sorted(con.fetchall(), key=repr)
    text = rows[0][1]
    a = text.index("zorblatt")
    assert f"term:{a}:{a + 8}" in got[0].split(",") and "today" not in [text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in got[0].split(",")]
    assert all(got[100 + i] == "" for i in range(60))


def test_classifier_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    graded = labels.select("doc_id", quality_classifier.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    model = quality_classifier.train(docs, graded.where("doc_id % 3 <> 0"), 3)
    assert (np.diff(model.thresholds) > 0).all()
    held = quality_classifier.score(docs, model).join(graded.where("doc_id % 3 = 0"), "doc_id")
    rows = held.select("grade", "selected", "expected_grade").collect()
    right = np.mean([r.selected == (r.grade == 2) for r in rows])
    means = [np.mean([r.expected_grade for r in rows if r.grade == g]) for g in range(3)]
    assert right > 0.85 and means[0] < means[2] and means[1] < means[2]


def test_classifier_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, None, 0), (20, 1, 1), (999, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert quality_classifier.report(odd_docs, labels).count() == odd_docs.count()
    assert quality_classifier.report(no_docs, labels).count() == 0
    even = quality_classifier.report(odd_docs, labels.limit(0)).where("n_words = 0").first()
    assert even.expected_grade == pytest.approx(1, abs=0.01)
