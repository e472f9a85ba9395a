"""Thin queries over whole tables, one per operator, with production parameters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, decontamination, line_dedup, mixing, ngram_join, pii, quality_classifier, quality_rules, source_divergence, substring_dedup, token_counts, token_ids, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.materialise(table(spark, sf_dir, "documents")).drop("path")


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.report(table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.report(table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.report(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op5_token_counts": op5_token_counts,
    "op6_quality_rules": op6_quality_rules,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_pii": op8_pii,
    "op9_token_ids": op9_token_ids,
    "op10_ngram_join": op10_ngram_join,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op11_source_divergence": op11_source_divergence,
    "op12_line_dedup": op12_line_dedup,
    "op13_conversation_repair": op13_conversation_repair,
}

#: DuckDB RE2 classes of the words in the contracts, and texts with ASCII capitals lowered
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quality_sql() -> str:
    """The search written out, one set of common table expressions per step."""
    q = quality_rules
    dims, pairs = range(q.DIMENSIONS), q._PAIRS
    means, covs = ", ".join(q._MEANS), ", ".join(q._COVS)

    def sums(keys: str) -> str:
        parts = ["sum(n) AS n"] + [f"sum(n * x{i}) AS s{i}" for i in dims] + [f"sum(n * x{i} * x{j}) AS q{i}{j}" for i, j in pairs]
        return f"{keys}, {', '.join(parts)}"

    def moments(source: str, keys: str, factor: float) -> str:
        rows = f"SELECT {keys}, CAST(n AS DOUBLE) AS n, {', '.join(f'CAST(s{i} AS DOUBLE) / CAST(n AS DOUBLE) AS m{i}' for i in dims)}, {', '.join(f'CAST(q{i}{j} AS DOUBLE) / CAST(n AS DOUBLE) AS q{i}{j}' for i, j in pairs)} FROM ({source})"
        cov = [f"greatest(q{i}{j} - m{i} * m{j}, 0e0) * {factor!r}e0 + {float(q.FLOORS[i] ** 2)!r}e0 AS v{i}{j}" if i == j else f"(q{i}{j} - m{i} * m{j}) * {factor!r}e0 AS v{i}{j}" for i, j in pairs]
        return f"SELECT {keys}, n, {means}, {', '.join(cov)} FROM ({rows})"

    def factored(source: str) -> str:
        columns = []
        for i, j in pairs:
            value = f"v{i}{j}" + "".join(f" - l{i}{p} * l{j}{p}" for p in range(j))
            columns.append(f"sqrt(greatest({value}, 1e0)) AS l{i}{j}" if i == j else f"({value}) / l{j}{j} AS l{i}{j}")
        return f"SELECT *, {', '.join(columns)}, round({' + '.join(f'ln(l{i}{i})' for i in dims)}, 9) AS logdet FROM ({source})"

    def placed(rows: str) -> str:
        columns = [f"(x{i} - m{i}{''.join(f' - l{i}{p} * y{p}' for p in range(i))}) / l{i}{i} AS y{i}" for i in dims]
        return f"SELECT *, {', '.join(columns)}, {' + '.join(f'y{i} * y{i}' for i in dims)} AS d2 FROM {rows}"

    def step(current: str, bins: int) -> str:
        binned = f"SELECT *, coalesce(sum(n) OVER (PARTITION BY g, k ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, ceil({q.SHARE}e0 * sum(n) OVER (PARTITION BY g, k)) AS h FROM (SELECT {sums('g, k, bin')} FROM (SELECT *, CAST(floor({bins} * ln(d2 + 1e-3)) AS INTEGER) AS bin FROM ({placed(f'vec JOIN (SELECT * EXCLUDE (n) FROM {current}) USING (g)')})) GROUP BY g, k, bin)"
        kept = ", ".join(f"CAST(coalesce(sum({c}) FILTER (below + n <= h), 0) AS DOUBLE) + coalesce(max({c} * ((h - below) / CAST(n AS DOUBLE))) FILTER (below + n > h AND below < h), 0e0) AS {c}" for c in q._SUMS)
        return factored(moments(f"SELECT g, k, {kept} FROM ({binned}) GROUP BY g, k", "g, k", q.CONSISTENT))

    def least(current: str, n: int) -> str:
        return f"SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY logdet, k) AS place FROM {current}) WHERE place <= {n}"

    def shrunk(name: str, source: str) -> list[str]:
        mixed = ", ".join(f"(n * e.{c} + {q.PRIOR} * w.{c}) / (n + {q.PRIOR}) AS {c}" for c in q._MEANS + q._COVS)
        out = [f"{name}0 AS (SELECT g, {means}, {covs} FROM ({source}) WHERE g = 'all')"]
        for level in (1, 2):
            out.append(f"{name}{level} AS (SELECT e.g, {mixed} FROM ({source}) e JOIN parents p ON p.g = e.g AND level = {level} JOIN {name}{level - 1} w ON w.g = p.parent)")
        return out + [f"{name} AS MATERIALIZED ({factored(' UNION ALL '.join(f'SELECT * FROM {name}{level}' for level in range(3)))})"]

    first = f"i // {q.DRAWN} * {q.DRAWN}"
    drawn = f"SELECT g, 1 + i // {q.DRAWN} AS k, x0, x1, x2, x3, 1 AS n FROM (SELECT g, i, ({first} + i % {q.DRAWN} * (1 + ({first}) // m)) % m + 1 AS r FROM (SELECT g, least(count(*), {q.SAMPLE}) AS m FROM vec GROUP BY g), range({q.SAMPLE}) t(i)) JOIN (SELECT g, x0, x1, x2, x3, row_number() OVER (PARTITION BY g ORDER BY md5(concat_ws('-', x0, x1, x2, x3)), x0, x1, x2, x3) AS r FROM vec) USING (g, r)"
    steps = [f"c0 AS MATERIALIZED ({factored(moments(f'SELECT {sums("g, k")} FROM (SELECT g, 0 AS k, x0, x1, x2, x3, n FROM vec UNION ALL {drawn}) GROUP BY g, k', 'g, k', 1.0))})"]
    total = q.FIRST_STEPS + q.STEPS
    for i in range(1, total + 1):
        steps.append(f"c{i} AS MATERIALIZED ({step(f'c{i - 1}', q.COARSE if i <= q.FIRST_STEPS else q.BINS)})")
        if i == q.FIRST_STEPS:
            steps[-1] = steps[-1].replace(f"c{i} AS", f"every{i} AS", 1)
            steps.append(f"c{i} AS MATERIALIZED ({least(f'every{i}', q.BEST)})")
    steps += shrunk("raw", least(f"c{total}", 1))
    near = moments(f"SELECT {sums('g')} FROM (SELECT * FROM ({placed('vec JOIN raw USING (g)')}) WHERE d2 <= {q.NEAR}) GROUP BY g", "g", q.REWEIGHTED)
    steps.append(f"counted AS MATERIALIZED (SELECT r.g, coalesce(c.n, 0e0) AS n, {', '.join(f'coalesce(c.{c}, r.{c}) AS {c}' for c in q._MEANS + q._COVS)} FROM raw r LEFT JOIN ({near}) c ON c.g = r.g)")
    steps += shrunk("final", "SELECT * FROM counted")
    return rf"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t, coalesce('=' || lang, 'null') AS lang, coalesce('=' || lang, 'null') || chr(1) || coalesce('=' || source, 'null') AS g, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM doc WHERE len(w) >= 3)),
twice AS (SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1),
again AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM win JOIN twice USING (doc_id, k)) GROUP BY doc_id),
base AS (SELECT doc_id, g, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(translate(t, '{q.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ 	-
]')) AS lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words FROM doc LEFT JOIN again USING (doc_id)),
st AS MATERIALIZED (SELECT doc_id, g, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  CAST(round({q.SCALE} * ln(greatest(word_chars, 1) / greatest(n_words, 1))) AS BIGINT) AS x0, CAST(round({q.SCALE} * ln(1 + 100 * n_symbols / greatest(word_chars, 1))) AS BIGINT) AS x1,
  CAST(round({q.SCALE} * ln(1 + n_dup_lines)) AS BIGINT) AS x2, CAST(round({q.SCALE} * ln(1 + 100 * n_repeat_words / greatest(n_words, 1))) AS BIGINT) AS x3 FROM base),
own AS MATERIALIZED (SELECT g, lang, x0, x1, x2, x3, count(*) AS n FROM st WHERE NOT base_failed GROUP BY ALL),
parents AS MATERIALIZED (SELECT DISTINCT 2 AS level, g, 'lang' || lang AS parent FROM own UNION SELECT 1, 'lang' || lang, 'all' FROM own UNION SELECT 0, 'all', NULL FROM own),
vec AS MATERIALIZED (SELECT g, x0, x1, x2, x3, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest([g, 'lang' || lang, 'all']) AS g, x0, x1, x2, x3, n FROM own) GROUP BY ALL),
{", ".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, CASE WHEN NOT base_failed THEN round(d2, 6) END AS distance, NOT base_failed AND NOT coalesce(distance > {q.CUTOFF}, FALSE) AS kept
FROM ({placed("st LEFT JOIN final USING (g)")})
"""


def _pii_sql() -> str:
    """Spans from lengths of matches and gaps, validity, contexts, and both disclosure rules."""
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({digits}), i, 1) AS INTEGER) ELSE (2 * CAST(substr(reverse({digits}), i, 1) AS INTEGER)) % 10 + CAST(substr(reverse({digits}), i, 1) AS INTEGER) // 5 END)) % 10 = 0"
    valid = {
        "email": "TRUE",
        "ip": "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(ltrim(x, '0') AS INTEGER), 0) > 255)) = 0",
        "card": f"length({digits}) BETWEEN 13 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
    }

    def located(rows: str, keys: str, text: str, pattern: str) -> str:
        """Matches of `text` in `rows` with code-point bounds."""
        order = f"(PARTITION BY {keys} ORDER BY i"
        return f"""SELECT {keys}, v, CAST(sum(length(gap)) OVER {order} ROWS UNBOUNDED PRECEDING) + coalesce(sum(length(v)) OVER {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, start + length(v) AS stop
    FROM (SELECT {keys}, unnest(m) AS v, unnest(gaps[1:len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {keys}, regexp_extract_all({text}, '{pattern}') AS m, regexp_split_to_array({text}, '{pattern}') AS gaps FROM {rows}))"""

    kinds = " UNION ALL ".join(f"SELECT doc_id, {no} AS no, '{k}' AS kind, v, start, stop FROM ({located('doc', 'doc_id', 't', patterns[k])}) WHERE {valid[k]}" for no, k in enumerate(pii.KINDS))
    run = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", pii.RUN)
    letters = r"\p{L}\p{M}\p{N}"
    plain = "regexp_replace(v, '[^0-9]', '', 'g')"
    pool = f"CASE kind WHEN 'email' THEN list_extract(string_split(lower(v), '@'), -1) WHEN 'ip' THEN array_to_string(string_split(v, '.')[1:3], '.') WHEN 'card' THEN substr({plain}, 1, 6) ELSE substr({plain}, 1, length({plain}) - 4) END"
    value = f"CASE WHEN kind IN ('card', 'phone') THEN {plain} ELSE lower(v) END"

    def tokens(text: str) -> str:
        return f"flatten(list_transform(regexp_extract_all({text}, '[{letters}{run}]+'), lambda x: regexp_extract_all(x, '[{run}]+|[^{run}]+')))"

    def words(text: str) -> str:
        return f"list_distinct(flatten(list_transform({tokens(text)}, lambda x: CASE WHEN length(x) > 2 AND regexp_matches(x, '^[{run}]') THEN list_transform(range(1, length(x)), lambda i: substr(x, i, 2)) ELSE [x] END)))"

    def chance(c: str, k: str, t: str) -> str:
        union = f"list_sum(list_transform(range(0, least({k}, {pii.FACTORS})), lambda i: ln(({c} - i) * greatest(CAST({t} AS DOUBLE) - i, 1) / ((i + 1) * greatest(n - i, 1)))))"
        mean = f"({c} * CAST({t} AS DOUBLE) / n)"
        return f"least({union}, CASE WHEN {k} > {mean} THEN {k} - {mean} - {k} * ln({k} / {mean}) ELSE 0 END) + ln(tests) <= ln({pii.ALPHA})"

    token = f"[{run}]+|[^{run}]+"
    return f"""
WITH doc AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents), span AS MATERIALIZED ({kinds}),
blank AS MATERIALIZED (SELECT doc_id, length(t) AS size, array_to_string(list_transform(string_split(t, ''), lambda ch, i: CASE WHEN list_bool_or(list_transform(s, lambda x: x[1] < i AND i <= x[2])) THEN ' ' ELSE ch END), '') AS m FROM doc JOIN (SELECT doc_id, list([start, stop]) AS s FROM span GROUP BY doc_id) USING (doc_id)),
around AS MATERIALIZED (SELECT doc_id, kind || ':' || {value} AS value, kind || ' pool:' || {pool} AS pool, start > {pii.REACH} AS cut_l, stop + {pii.REACH} < size AS cut_r, substr(m, greatest(start - {pii.REACH}, 0) + 1, start - greatest(start - {pii.REACH}, 0)) AS l, substr(m, stop + 1, least(stop + {pii.REACH}, size) - stop) AS r FROM span JOIN blank USING (doc_id)),
mention AS MATERIALIZED (SELECT doc_id, value, pool, min(l || chr(0) || r) AS context FROM around GROUP BY ALL),
freq AS MATERIALIZED (SELECT term, count(*) AS n_t FROM (SELECT unnest({words("lower(t)")}) AS term FROM doc) GROUP BY term),
total AS (SELECT CAST(greatest(count(*), 1) AS DOUBLE) AS n, (SELECT CAST(greatest(count(*), 1) AS DOUBLE) FROM freq WHERE n_t > 1) AS tests FROM doc),
held AS MATERIALIZED (SELECT doc_id, entity, min(context) AS context FROM (SELECT doc_id, value AS entity, context FROM mention UNION ALL SELECT doc_id, pool, context FROM mention) GROUP BY ALL),
size AS MATERIALIZED (SELECT entity, count(*) AS n_e, count(DISTINCT context) AS c FROM held GROUP BY entity),
beside AS (SELECT DISTINCT doc_id, value AS entity, unnest({words(f"lower(concat_ws(' ', CASE WHEN cut_l THEN regexp_replace(l, '^[{letters}]+', '') ELSE l END, CASE WHEN cut_r THEN regexp_replace(r, '[{letters}]+$', '') ELSE r END))")}) AS term FROM around),
near AS (SELECT entity, term FROM (SELECT entity, term, count(*) AS n_et FROM beside GROUP BY ALL) JOIN size USING (entity) JOIN freq USING (term), total
  WHERE ln(n / n_e) > 0 AND ln(n * (n_et + {pii.SMOOTHING} * n_e / n) / (n_e * (greatest(n_t, n_et) + {pii.SMOOTHING}))) >= {pii.DISCLOSURE} * ln(n / n_e)),
able AS MATERIALIZED (SELECT entity, n_e, c FROM size, total WHERE {chance("c", "c", "c")}),
judged AS MATERIALIZED (SELECT DISTINCT doc_id, entity FROM (SELECT doc_id, CASE WHEN value IN (SELECT entity FROM able) THEN value ELSE pool END AS entity FROM mention) WHERE entity IN (SELECT entity FROM able)),
seen AS (SELECT entity, term, count(*) AS n_et, count(DISTINCT context) AS k FROM (SELECT doc_id, unnest({words("lower(m)")}) AS term FROM blank) JOIN held USING (doc_id) WHERE entity IN (SELECT entity FROM judged) GROUP BY ALL),
far AS (SELECT entity, term FROM seen JOIN able USING (entity) JOIN freq USING (term), total WHERE ln(n / n_e) > 0 AND {chance("c", "k", "k")} AND {chance("c", "k", "greatest(n_t, n_et)")} AND ln(n * n_et / (n_e * greatest(n_t, n_et))) >= {pii.DISCLOSURE} * ln(n / n_e)),
told AS MATERIALIZED (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, value AS entity FROM mention UNION SELECT doc_id, entity FROM judged) JOIN (SELECT *, TRUE AS close FROM near UNION ALL SELECT *, FALSE FROM far) USING (entity) WHERE NOT close OR (doc_id, entity) IN (SELECT doc_id, value FROM mention)),
rough AS ({located("(SELECT doc_id, m FROM blank WHERE doc_id IN (SELECT doc_id FROM told))", "doc_id", "m", f"[{letters}{run}]+")}),
fine AS (SELECT doc_id, x, base + coalesce(sum(length(x)) OVER (PARTITION BY doc_id, base ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM (SELECT doc_id, start AS base, unnest(p) AS x, unnest(range(len(p))) AS i FROM (SELECT doc_id, start, regexp_extract_all(v, '{token}') AS p FROM rough))),
place AS (SELECT doc_id, lower(x) AS term, CAST(a AS BIGINT) AS start, CAST(a + length(x) AS BIGINT) AS stop FROM fine WHERE length(x) <= 2 OR NOT regexp_matches(x, '^[{run}]')
  UNION ALL SELECT doc_id, lower(substr(x, i, 2)), CAST(a + i - 1 AS BIGINT), CAST(a + i + 1 AS BIGINT) FROM (SELECT doc_id, x, a, CAST(unnest(range(1, length(x))) AS BIGINT) AS i FROM fine WHERE length(x) > 2 AND regexp_matches(x, '^[{run}]'))),
terms AS (SELECT doc_id, start, stop FROM place p JOIN told USING (doc_id, term) WHERE NOT EXISTS (SELECT 1 FROM span s WHERE s.doc_id = p.doc_id AND s.start < p.stop AND p.start < s.stop)),
b AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY no, start) AS base, {", ".join(f"count(*) FILTER (no = {no}) AS n_{k}" for no, k in enumerate(pii.KINDS))} FROM span GROUP BY doc_id),
c AS (SELECT doc_id, string_agg('term:' || start || ':' || stop, ',' ORDER BY start, stop) AS added, count(*) AS n_terms FROM terms GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in pii.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, concat_ws(',', base, added) AS spans, coalesce(n_terms, 0) AS n_terms FROM doc LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def _repair_sql() -> str:
    """One step per turn over the four states, each with its least (cost, audit) and the lines that it keeps."""
    blank = r"[^\x20\x09-\x0D]"
    # reachable by one edit that sets a role: state from, initial, state to
    moves = [(0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2)]
    element = "{{'cost': {0}, 'audit': {1}, 'lines': {2}}}".format

    def after(s: str, cost: str, edit: str, line: str | None) -> str:
        lines = f"{s}.lines" if line is None else f"{s}.lines || [{line}]"
        return element(f"{s}.cost + {cost}", f"{s}.audit || '{edit}'", lines)

    def steps(columns: list[str], source: str) -> str:
        """Each insertion as a subselect of its own, so that expressions stay short."""
        for n in range(3):
            sets = []
            for t in range(4):
                options = [f"s{t}"] + [f"CASE WHEN s{a} IS NOT NULL THEN {after(f's{a}', '2', 'I', repr('user:' if r == 'u' else 'assistant:'))} END" for a, r, b in moves if b == t and r != "s"]
                sets.append(f"list_sort(list_filter([{', '.join(options)}], lambda e: e IS NOT NULL))[1] AS s{t}" if len(options) > 1 else f"s{t}")
            source = f"SELECT {', '.join(columns)}, {', '.join(sets)} FROM ({source})"
        return source

    turned = []
    for t in range(4):
        options = [f"CASE WHEN s{t} IS NOT NULL THEN {after(f's{t}', '3', 'D', None)} END"]
        for a, r, b in moves:
            if b == t:
                late = "CAST(fault = 'truncated' AS INTEGER)"
                options.append(f"CASE WHEN s{a} IS NOT NULL AND fault NOT IN ('blank', 'duplicate') AND left(role, 1) = '{r}' THEN {after(f's{a}', late, 'K', 'role || chr(58) || text')} END")
                if r != "s":
                    name = "user" if r == "u" else "assistant"
                    options.append(f"CASE WHEN s{a} IS NOT NULL AND fault NOT IN ('blank', 'duplicate') THEN {after(f's{a}', f'2 + {late}', 'R', f'{name!r} || chr(58) || text')} END")
        turned.append(f"list_sort(list_filter([{', '.join(options)}], lambda e: e IS NOT NULL))[1] AS s{t}")
    columns = ["conv_id", "rn"]
    seen = steps(["conv_id", "rn", "role", "text", "fault"], "SELECT w.conv_id, t.rn, role, text, fault, s0, s1, s2, s3 FROM walk w JOIN turn t ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.rn = w.rn + 1")
    ended = steps(columns, "SELECT w.* FROM walk w JOIN size z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.n = w.rn")
    empty = element("CAST(0 AS BIGINT)", "''", "CAST([] AS VARCHAR[])")
    none = f"CASE WHEN FALSE THEN {empty} END"
    return rf"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([CAST(i AS UBIGINT)] || [CAST(0 AS UBIGINT) FOR j IN range(8)], lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS UBIGINT)) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
plain AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
kind AS (SELECT * EXCLUDE (name, t), xor(list_reduce([CAST(4294967295 AS UBIGINT)] || [CAST(ascii(c) AS UBIGINT) FOR c IN string_split(name, '')], lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS INTEGER) + 1])), CAST(4294967295 AS UBIGINT)) % 20 AS k FROM plain, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM kind WHERE k <> 0),
placed AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS rn FROM hurt),
turn AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '{blank}') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 THEN 'duplicate'
  WHEN regexp_extract(text, '({blank})[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, left(lag(role) OVER (PARTITION BY conv_id ORDER BY rn), 1) || left(role, 1) AS two FROM placed),
size AS MATERIALIZED (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM turn GROUP BY conv_id),
walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS rn, {empty} AS s0, {none} AS s1, {none} AS s2, {none} AS s3 FROM size UNION ALL SELECT conv_id, rn, {', '.join(turned)} FROM ({seen})),
ended AS (SELECT conv_id, list_sort(list_filter([s0, s3], lambda e: e IS NOT NULL))[1] AS best FROM ({ended}))
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
  CAST(coalesce(best.cost, 0) AS BIGINT) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN size z ON z.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


ORACLE_SQL = {
    "op13_conversation_repair": _repair_sql(),
    "op12_line_dedup": rf"""
WITH doc AS (SELECT doc_id, text, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT r, coalesce('id' || doc_id, 'text' || coalesce(text, '')) AS holder, unnest(lines) AS x, unnest(range(len(lines))) AS i FROM doc),
keyed AS MATERIALIZED (SELECT r, holder, i, x, {_LOWER.format("trim(x, E' \\t\\n\\x0b\\x0c\\r')")} AS k FROM line),
shared AS (SELECT k FROM keyed WHERE length(k) >= {line_dedup.MIN_CHARS} GROUP BY k HAVING count(DISTINCT holder) >= {line_dedup.MIN_DOCS}),
kept AS (SELECT r, count(*) AS n, string_agg(x, chr(10) ORDER BY i) AS t FROM keyed ANTI JOIN shared USING (k) GROUP BY r)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256 FROM doc LEFT JOIN kept USING (r)
""",
    "op11_source_divergence": rf"""
WITH doc AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
word AS MATERIALIZED (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS d FROM (SELECT r, lang, source, unnest(w) AS term FROM doc) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM word GROUP BY ALL HAVING sum(d) >= {source_divergence.MIN_DOCS}),
lang AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
grp AS MATERIALIZED (SELECT DISTINCT lang, source FROM doc),
cell AS (SELECT g.lang, g.source, k.term, coalesce(w.n, 0) AS n FROM grp g JOIN kept k USING (lang) LEFT JOIN word w USING (lang, source, term)),
p AS MATERIALIZED (SELECT lang, source, term, n, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS BIGINT) AS p FROM cell JOIN lang USING (lang)),
q AS (SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 2)) // (total + 2 * v) AS BIGINT) AS q FROM kept JOIN lang USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every QUALIFY part = 'pair' OR rank <= {source_divergence.TOP}
""",
    "op8_pii": _pii_sql(),
    "op6_quality_rules": _quality_sql(),
    "op4_decontamination": rf"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item AS (
  SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), phrase AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), size AS (SELECT DISTINCT n FROM phrase), place AS (
  SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM doc, size WHERE len(w) >= n
), hit AS (
  SELECT doc_id, i, h.n, item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM place) h JOIN phrase USING (n, p)
), word AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op2_warc": r"""
WITH page AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), least AS (SELECT html, min(page_id) AS first FROM page GROUP BY html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, TRUE AS verified
FROM page JOIN least USING (html)
""",
    "op7_substring_dedup": r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM doc WHERE len(w) >= 13)),
least AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (k) WHERE doc_id > m),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM doc),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN hit USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM doc LEFT JOIN kept USING (doc_id)
""",
    "op10_ngram_join": rf"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (k) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT x, y FROM pair JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(doc_id, r) AS (SELECT DISTINCT x, x FROM both_ UNION SELECT reach.doc_id, y FROM reach JOIN both_ ON x = r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM doc LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
""",
}
