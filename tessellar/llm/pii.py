"""Personal data, and the terms that give it away (native).

Base: e-mail addresses, IP addresses, card and phone numbers by pattern and
check rule. Their values are the protected entities e, of information content
IC(e) = log(N / n(e)); a term t tells PMI(e; t) = log(P(e | t) / P(e)) of it and
discloses e from `disclosure` of IC(e) on: it is generalised, or removed from
`removal` on. All counts are rows of the corpus (repeated rows count each time).

Two estimates of the co-occurrence, the same at every corpus size:

Near. Of a term within REACH code points of a span, P(e | t) is the smoothed
(n(e, t) + m P(e)) / (n(t) + m), m = SMOOTHING: so the rare word beside an
address that occurs once is judged, and a common one is not.

Anywhere in the text. A word that merely shares the document must recur: with k
of the entity's c distinct contexts in documents that hold t,

    P(k or more) <= C(c, k) n(t)...(n(t) - k + 1) / (N...(N - k + 1))

(or Chernoff's bound where that is less), times the number of terms of more than
one row (no other can pass), must be at most `alpha`. Copies of a context are
one, so copies of a document prove nothing. An entity that no term could prove
even if it stood with it always and nowhere else is judged as its pool: the
e-mail's domain, the first three parts of the address, the card's issuer, the
phone number without its last four digits.

Terms are words of letters and digits of any length; runs in scripts without
spaces are read as overlapping pairs of characters. Every occurrence of a
disclosing term is marked in the rows that hold the entity. Base spans always
stay; terms never overlap them.

Scale: everything is DataFrame expressions. Pairs and terms combine before the
shuffle; only spans and the texts that hold any cross it. Positions are added up
block by block, so a text's cost is linear in its length and its matches, and no
pattern backtracks over more than its own match. Rows are keyed by 128 bits.

Defined cases: a null text is empty and has no spans; identical rows get
identical results; an entity or term of any frequency is counted as is; a very
long text is read like any other; an empty table gives an empty result; extra
columns, also of clashing names, are ignored by `report` and carried by `sanitise`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, fresh, stored, wide_key

#: fixed patterns. Possessive, and anchored where a run begins: an earlier start in the same run would match or fail alike
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: cheap tests that a text may hold the pattern at all
GATES = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
KINDS = list(PATTERNS)
#: order of blanking: a kind before those it may enclose
MASKED = ("email", "phone", "ip", "card")
REACH = 80
SMOOTHING = 0.5
ALPHA = 0.05
DISCLOSURE = 0.9
REMOVAL = 0.98
#: factors of the bound; a smaller k bounds a larger one
FACTORS = 64
#: items of a list, and code points of a text, that one inner loop handles
BLOCK = 256
PIECE = 512
#: scripts written without spaces: their runs are read as overlapping pairs of characters
RUN = r"\u0E01-\u0E3A\u0E40-\u0E4E\u0E50-\u0E59\u0E81-\u0ED9\u0EDC-\u0EDF\u1000-\u1049\u1050-\u109F\u1780-\u17D3\u17E0-\u17E9\u3005-\u3007\u3041-\u3096\u3099-\u309F\u30A1-\u30FA\u30FC-\u30FF\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{1B000}-\x{1B16F}\x{20000}-\x{3FFFF}"
PLAIN = r"[\p{L}\p{M}\p{N}]++"
WORD = rf"[\p{{L}}\p{{M}}\p{{N}}&&[^{RUN}]]++"
PAIR = rf"(?=([{RUN}]{{2}}))"
LONE = rf"(?<![{RUN}])[{RUN}](?![{RUN}])"
TOKEN = rf"[{RUN}]++|{WORD}"

SPANS = "array<struct<start:int,stop:int,value:string>>"
MARKS = "array<struct<start:int,stop:int,action:string>>"
HELD = "array<struct<value:string,pool:string,context:bigint,near:array<string>>>"

_DIGITS = {"card", "phone"}
POOL = {
    "email": lambda v: F.substring_index(v, "@", -1),
    "ip": lambda v: F.substring_index(v, ".", 3),
    "card": lambda v: F.substring(v, 1, 6),
    "phone": lambda v: F.substring(v, F.lit(1), F.length(v) - 4),
}


def bound(value: Column, use) -> Column:
    """`use(value)` with `value` computed once."""
    return F.transform(F.array(value), use)[0]


def running(items: Column, step, kind: str) -> Column:
    """All that `step` gives along `items`, whose `at` it advances: step(at, item) -> (next at, array of type `kind`).

    Results gather per block of items, then per list of blocks, so nothing long is copied at each step.
    """

    def inside(it: Column, at: Column) -> Column:
        def one(state: Column, item: Column) -> Column:
            after, made = step(state["at"], item)
            return F.struct(after.alias("at"), F.when(F.size(made) > 0, F.concat(state["out"], made)).otherwise(state["out"]).alias("out"))

        return F.aggregate(it, F.struct(at.alias("at"), F.array().cast(kind).alias("out")), one)

    def over(it: Column) -> Column:
        def block(state: Column, b: Column) -> Column:
            return bound(inside(F.slice(it, b * BLOCK + 1, F.lit(BLOCK)), state["at"]), lambda r: F.struct(r["at"].alias("at"), F.when(F.size(r["out"]) > 0, F.array_append(state["out"], r["out"])).otherwise(state["out"]).alias("out")))

        blocks = F.sequence(F.lit(0), F.floor(F.size(it) / BLOCK).cast("int"))
        return F.flatten(F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")), block)["out"])

    return bound(items, over)


def _between(text: Column, pattern: str, found: Column) -> Column:
    """What lies before each match, and after the last one."""
    return F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found) + 1)


def located(text: Column, pattern: str, valid=lambda v: F.lit(True)) -> Column:
    """Valid matches with their code-point bounds: lengths of matches and of what lies between them, added up."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = lambda f: F.slice(F.transform(_between(text, pattern, f), F.length), F.lit(1), F.size(f))
    items = bound(found, lambda f: F.zip_with(f, gaps(f), lambda v, g: F.struct(v.alias("value"), F.length(v).alias("length"), g.alias("gap"), valid(v).alias("ok"))))

    def step(at: Column, item: Column) -> tuple[Column, Column]:
        a = at + item["gap"]
        b = a + item["length"]
        span = F.array(F.struct(a.alias("start"), b.alias("stop"), item["value"].alias("value")))
        return b, F.when(item["ok"], span).otherwise(F.array().cast(SPANS))

    return running(items, step, SPANS)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.transform(F.split(F.reverse(_digits(value)), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(digits, F.lit(0), lambda a, d: a + d) % 10 == 0


def _octet(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+", "")
    return (F.length(short) <= 3) & (F.coalesce(F.when(F.length(short).between(1, 3), short).cast("int"), F.lit(0)) <= 255)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _octet),
    "card": lambda v: F.when(F.length(v).between(13, 37) & F.length(_digits(v)).between(13, 19), _luhn(v)).otherwise(False),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def base_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, uid, text, email, ip, card, phone): arrays of valid spans."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.select("doc_id", wide_key("doc_id", "text").alias("uid"), F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast(SPANS)
    spans = [F.when(F.col("text").rlike(GATES[k]), located(F.col("text"), PATTERNS[k], VALID[k])).otherwise(none).alias(k) for k in KINDS]
    return rows.select("doc_id", "uid", "text", *spans)


def masked(text: Column, sizes: dict[str, Column]) -> Column:
    """The text with the valid matches of every kind that has any blanked; positions stay."""

    def blanked(kind: str, t: Column) -> Column:
        def joined(found: Column) -> Column:
            shown = F.transform(found, lambda v: F.when(VALID[kind](v), F.repeat(F.lit(" "), F.length(v))).otherwise(v))
            return F.array_join(F.flatten(F.zip_with(_between(t, PATTERNS[kind], found), shown, lambda g, v: F.array(g, F.coalesce(v, F.lit(""))))), "")

        return bound(F.regexp_extract_all(t, F.lit(PATTERNS[kind]), 0), joined)

    def one(kind: str, t: Column) -> Column:
        return bound(t, lambda x: F.when(sizes[kind] > 0, blanked(kind, x)).otherwise(x))

    return reduce(lambda t, kind: one(kind, t), MASKED, text)


def words(text: Column) -> Column:
    """Distinct terms of a lower-case text: words of any length, and pairs of characters (or a lone one) in runs without spaces."""
    every = lambda pattern, group=0: F.regexp_extract_all(text, F.lit(pattern), group)
    return F.array_distinct(F.when(text.rlike(f"[{RUN}]"), F.concat(every(WORD), every(PAIR, 1), every(LONE))).otherwise(every(PLAIN)))


def _cut_out(pieces: Column, a: Column, b: Column) -> Column:
    """Code points [a, b) of a text in pieces of PIECE code points; b - a < PIECE."""
    i, j = F.floor(a / PIECE).cast("int"), F.floor(F.greatest(b - 1, a) / PIECE).cast("int")
    both = F.concat(F.coalesce(F.get(pieces, i), F.lit("")), F.when(j > i, F.coalesce(F.get(pieces, j), F.lit(""))).otherwise(F.lit("")))
    return F.substring(both, a - i * PIECE + 1, b - a)


def _held(kind: str, pieces: Column, length: Column) -> Column:
    """Entity, pool, context and near terms (those cut by the reach left out) of each span of a kind."""

    def one(span: Column) -> Column:
        value = _digits(span["value"]) if kind in _DIGITS else F.lower(span["value"])
        first, last = F.greatest(span["start"] - REACH, F.lit(0)), F.least(span["stop"] + REACH, length)
        around = F.struct(_cut_out(pieces, first, span["start"]).alias("left"), _cut_out(pieces, span["stop"], last).alias("right"))

        def entry(c: Column) -> Column:
            left = F.when(first > 0, F.regexp_replace(c["left"], rf"^{PLAIN}", "")).otherwise(c["left"])
            right = F.when(last < length, F.regexp_replace(c["right"], r"[\p{L}\p{M}\p{N}]++$", "")).otherwise(c["right"])
            near = bound(F.lower(F.concat_ws(" ", left, right)), words)
            return F.struct(F.concat(F.lit(f"{kind}:"), value).alias("value"), F.concat(F.lit(f"{kind} pool:"), POOL[kind](value)).alias("pool"), F.xxhash64(c["left"], c["right"]).alias("context"), near.alias("near"))

        return bound(around, entry)

    return F.transform(kind, one)


def _base_table(docs: DataFrame, **columns) -> DataFrame:
    """Base spans, and of texts that have any, the entities and the blanked text."""
    every = F.concat(*KINDS)
    listed = lambda kind: F.transform(kind, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["stop"]))
    base = F.array_join(F.concat(*map(listed, KINDS)), ",")
    found = base_spans(docs, **columns)
    blank = F.when(F.size(every) > 0, masked(F.col("text"), {k: F.size(k) for k in KINDS}))
    table = found.select("doc_id", "uid", *KINDS, base.alias("base"), blank.alias("masked"))
    parts = F.struct(F.regexp_extract_all(F.col("masked"), F.lit(rf"(?s).{{1,{PIECE}}}"), 0).alias("pieces"), F.length("masked").alias("length"))
    held = bound(parts, lambda p: F.concat(*[_held(k, p["pieces"], p["length"]) for k in KINDS]))
    return stored(table.withColumn("held", F.when(F.col("masked").isNotNull(), held).cast(HELD)), "pii-base")


def log_chance(c: Column, k: Column, n_t: Column, n: Column) -> Column:
    """Logarithm of a bound on the chance that k or more of c contexts stand in the n_t of n rows with a term."""
    c, k, n_t = (x.cast("double") for x in (c, k, n_t))
    steps = F.sequence(F.lit(0), F.least(k.cast("int"), F.lit(FACTORS)) - 1)
    union = F.aggregate(steps, F.lit(0.0), lambda a, i: a + F.log((c - i) * F.greatest(n_t - i, F.lit(1.0)) / ((i + 1) * F.greatest(n - i, F.lit(1.0)))))
    mean = c * n_t / n
    chernoff = F.when(k > mean, k - mean - k * F.log(k / mean)).otherwise(0.0)
    return F.least(union, chernoff)


def _acted(told: Column, content: Column, removal: float) -> Column:
    return F.when(told >= removal * content, "remove").otherwise("generalise")


def disclosing(docs: DataFrame, base: DataFrame, *, text_col: str = "text", smoothing: float = SMOOTHING, alpha: float = ALPHA, disclosure: float = DISCLOSURE, removal: float = REMOVAL) -> DataFrame:
    """(uid, terms): the disclosing terms, with their actions, of the entities that a row holds."""
    frequency = cut(docs.select(F.explode(words(F.lower(F.col(text_col).cast("string")))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")))
    tests, n = F.lit(float(max(frequency.where("n_t > 1").count(), 1))), F.lit(float(max(base.count(), 1)))
    some = base.where("masked IS NOT NULL")
    # identical rows share a key: `copies` keeps every count a count of rows
    texts = some.groupBy("uid").agg(F.count("*").alias("copies"), F.min("masked").alias("masked"), F.min("held").alias("held"))
    held = cut(texts.select("uid", "copies", F.explode("held").alias("h")).select("uid", "copies", "h.*"))
    mentions = held.groupBy("uid", "copies", "value", "pool").agg(F.min("context").alias("context"))
    both = mentions.select("uid", "copies", "context", F.explode(F.array("value", "pool")).alias("entity")).groupBy("uid", "copies", "entity").agg(F.min("context").alias("context"))
    counts = cut(both.groupBy("entity").agg(F.sum("copies").alias("n_e"), F.count_distinct("context").alias("c")))
    content = F.log(n / F.col("n_e"))

    # near: smoothed
    beside = held.select("uid", "copies", F.col("value").alias("entity"), F.explode("near").alias("term")).distinct()
    n_near = beside.groupBy("entity", "term").agg(F.sum("copies").alias("n_et"))
    smoothed = F.log(n * (F.col("n_et") + smoothing * F.col("n_e") / n) / (F.col("n_e") * (F.greatest("n_t", "n_et") + smoothing)))
    near = n_near.join(counts.select("entity", "n_e"), "entity").join(frequency, "term").where((content > 0) & (smoothed >= disclosure * content)).select("entity", "term", _acted(smoothed, content, removal).alias("action"))
    told_near = mentions.select("uid", F.col("value").alias("entity")).distinct().join(near, "entity").select("uid", "term", "action")

    # anywhere: significant recurrence
    able = cut(counts.where(log_chance(F.col("c"), F.col("c"), F.col("c"), n) + F.log(tests) <= F.log(F.lit(alpha))))
    names = able.select("entity")
    proven = mentions.join(names.select(F.col("entity").alias("value"), F.lit(True).alias("able")), "value", "left")
    judged = cut(proven.select("uid", F.when(F.col("able"), F.col("value")).otherwise(F.col("pool")).alias("entity")).distinct().join(names, "entity", "left_semi"))
    # counts of a pool include all its values
    members = both.join(judged.select("entity").distinct(), "entity", "left_semi").groupBy("uid").agg(F.collect_list(F.struct("entity", "context", "copies")).alias("members"))
    pairs = texts.select("uid", words(F.lower("masked")).alias("words")).join(members, "uid").select("members", F.explode("words").alias("term")).select(F.explode("members").alias("m"), "term").select("m.*", "term")
    seen = pairs.groupBy("entity", "term", "context").agg(F.sum("copies").alias("n")).groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count("*").alias("k"))
    rated = seen.join(able, "entity").where(log_chance(F.col("c"), F.col("k"), F.col("k"), n) + F.log(tests) <= F.log(F.lit(alpha))).join(frequency, "term")
    often = F.greatest("n_t", "n_et")
    told = F.log(n * F.col("n_et") / (F.col("n_e") * often))
    sure = log_chance(F.col("c"), F.col("k"), often, n) + F.log(tests) <= F.log(F.lit(alpha))
    far = rated.where((content > 0) & (told >= disclosure * content) & sure).select("entity", "term", _acted(told, content, removal).alias("action"))
    told_far = judged.join(far, "entity").select("uid", "term", "action")

    each = told_near.unionByName(told_far).groupBy("uid", "term").agg(F.max("action").alias("action"))
    return each.groupBy("uid").agg(F.collect_list(F.struct("term", "action")).alias("terms"))


def _marks(text: Column, words_: Column, removed: Column) -> Column:
    """Bounds and actions of every occurrence of the words; those of `removed` are removed."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), 0)
    gaps = lambda f: F.slice(F.transform(_between(text, TOKEN, f), F.length), F.lit(1), F.size(f))
    tokens = bound(found, lambda f: F.zip_with(f, gaps(f), lambda v, g: F.struct(F.lower(v).alias("value"), F.length(v).alias("length"), g.alias("gap"))))

    def step(at: Column, token: Column) -> tuple[Column, Column]:
        a, value, length = at + token["gap"], token["value"], token["length"]
        whole = F.array(F.struct(a.alias("start"), (a + length).alias("stop"), value.alias("word")))
        pairs = F.transform(F.sequence(F.lit(0), length - 2), lambda i: F.struct((a + i).alias("start"), (a + i + 2).alias("stop"), F.substring(value, i + 1, F.lit(2)).alias("word")))
        hits = F.filter(F.when((length > 2) & value.rlike(f"^[{RUN}]"), pairs).otherwise(whole), lambda p: F.array_contains(words_, p["word"]))
        return a + length, F.transform(hits, lambda p: F.struct(p["start"].alias("start"), p["stop"].alias("stop"), F.when(F.array_contains(removed, p["word"]), "remove").otherwise("generalise").alias("action")))

    return running(tokens, step, MARKS)


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Base table with `terms`, the sorted disclosing spans of each row (empty where none)."""
    base = _base_table(docs, id_col=id_col, text_col=text_col)
    told = disclosing(docs, base, text_col=text_col, **options)
    names = lambda terms: F.array_intersect(words(F.lower("masked")), F.transform(terms, lambda t: t["term"]))
    texts = base.where("masked IS NOT NULL").dropDuplicates(["uid"]).select("uid", "masked", *KINDS).join(told, "uid")
    present = texts.select("uid", "masked", *KINDS, names(F.col("terms")).alias("words"), names(F.filter("terms", lambda t: t["action"] == "remove")).alias("removed")).where(F.size("words") > 0)
    marked = present.select("uid", *KINDS, _marks(F.col("masked"), F.col("words"), F.col("removed")).alias("terms"))
    # only where spans of two kinds overlap may a rest of one be left unblanked
    several = F.size(F.filter(F.array(*[F.size(k) for k in KINDS]), lambda x: x > 0)) > 1
    free = F.filter("terms", lambda t: ~F.exists(F.concat(*KINDS), lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"])))
    added = marked.select("uid", F.when(several, free).otherwise(F.col("terms")).alias("terms"))
    return base.drop("held", "masked").join(added, "uid", "left").withColumn("terms", F.coalesce("terms", F.array().cast(MARKS)))


def report(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms."""
    found = spans(docs, **options)
    terms = F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["stop"]))
    everything = F.array_join(F.concat(F.filter(F.split("base", ","), lambda x: x != ""), terms), ",")
    return found.select("doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS], F.sha2("base", 256).alias("base_sha256"), everything.alias("spans"), F.size("terms").cast("bigint").alias("n_terms"))


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with base spans and generalised terms replaced by their kind in brackets, and removed terms gone."""
    found = spans(docs, id_col=id_col, text_col=text_col, **options)

    def tags(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("a"), s["stop"].alias("b"), F.lit(f"[{kind.upper()}]").alias("new")))

    tagged = F.sort_array(F.concat(*map(tags, KINDS), F.transform("terms", lambda s: F.struct(s["start"].alias("a"), s["stop"].alias("b"), F.when(s["action"] == "remove", "").otherwise("[TERM]").alias("new")))))
    key, made = fresh(docs, "uid"), fresh(docs, "edits")
    edits = found.select(F.col("uid").alias(key), tagged.alias(made)).where(F.size(made) > 0).dropDuplicates([key])
    text = F.col(text_col)
    edit = "struct<a:int,b:int,new:string>"

    # edits without those that begin inside an earlier one
    def step(at: Column, e: Column) -> tuple[Column, Column]:
        return F.greatest(at, e["b"]), F.when(e["a"] >= at, F.array(e)).otherwise(F.array().cast(f"array<{edit}>"))

    def whole(kept: Column) -> Column:
        before = F.transform(kept, lambda e, i: F.struct(F.coalesce(F.get(kept, i - 1)["b"], F.lit(0)).alias("from"), e["a"].alias("a"), e["new"].alias("new")))
        parts = F.transform(before, lambda e: F.concat(F.substring(text, e["from"] + 1, e["a"] - e["from"]), e["new"]))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(kept, -1)["b"] + 1, F.length(text)))

    edited = F.when(F.col(made).isNull(), text).otherwise(bound(running(F.col(made), step, f"array<{edit}>"), whole))
    return docs.withColumn(key, wide_key(id_col, text_col)).join(edits, key, "left").withColumn(text_col, edited).select(*docs.columns)
