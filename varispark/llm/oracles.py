"""DuckDB SQL for the registered queries that SQL can express. Each is a plain statement of the result, not of the plan."""

from __future__ import annotations

import math

from varispark.llm import importance, line_dedup, mixing, secrets, warc

_SIZE = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(kind: str, rank: int, pattern: str, keep: str = "true") -> str:
    """List of structs of the pattern's matches: pieces and matches alternate."""
    p = _quoted(pattern)
    at = "CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT)"
    return (
        f"(SELECT list_filter(list_transform(range(1, len(m) + 1), lambda i: {{'start': {at}, 'rank': {rank}, 'end': {at} + length(m[i]), 'kind': '{kind}', 'text': m[i], 'g': g[i]}}), lambda s: {keep}) "
        f"FROM (SELECT string_split_regex(t.text, {p}) AS p, regexp_extract_all(t.text, {p}) AS m, regexp_extract_all(t.text, {p}, {2 if kind == 'assign' else 0}) AS g))"
    )


def op1() -> str:
    strip = "{'start': s.start, 'rank': s.rank, 'end': s.end, 'kind': s.kind}"
    base = [_spans("assign", 0, secrets.ASSIGN, f"length(s.g) >= {secrets.MIN_ASSIGN}"), _spans("access", 1, secrets.ACCESS), _spans("hex", 2, secrets.HEX)]
    more = []
    for k, (kind, alphabet, pattern, window, bits) in enumerate(secrets.CLASSES):
        sums = "[" + ", ".join(str(round(c * math.log2(c) * secrets.SCALE) if c else 0) for c in range(window + 1)) + "]"
        most = int((math.log2(window) - bits) * window * secrets.SCALE)
        allowed = " OR ".join(f"(regexp_matches(s.text, {_quoted(a)})" + (f" AND NOT regexp_matches(s.text, {_quoted(never)}))" if never else ")") for a, never in secrets.ALLOW)
        runs = f"list_filter({_spans(kind, 3 + k, pattern)}, lambda s: NOT ({allowed}))"
        entropy = f"list_sum(list_transform(string_split({_quoted(alphabet)}, ''), lambda a: ({sums})[{window} - length(replace(substring(s.text, o + 1, {window}), a, '')) + 1]))"
        hot = f"list_filter(range(0, length(s.text) - {window} + 1), lambda o: {entropy} <= {most})"
        spans = f"list_transform({runs}, lambda s: {{'start': s.start + list_min({hot}), 'rank': {3 + k}, 'end': s.start + list_max({hot}) + {window}, 'kind': '{kind}'}})"
        more.append(f"list_filter({spans}, lambda s: s.start IS NOT NULL)")
    listed = lambda c: f"array_to_string(list_transform({c}, lambda s: s.kind || ':' || s.start || ':' || s.end), ',')"
    n = lambda kind: f"CAST(len(list_filter(base, lambda s: s.kind = '{kind}')) AS BIGINT) AS n_{kind}"
    cat = lambda parts: f"list_sort(list_transform({' || '.join(parts)}, lambda s: {strip}))"
    return (
        f"WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), "
        f"b AS (SELECT doc_id, text, {cat(base)} AS base, {cat(more)} AS every FROM t), "
        "e AS (SELECT *, list_filter(every, lambda s: len(list_filter(base, lambda x: x.start <= s.start AND s.end <= x.end)) = 0) AS extra FROM b) "
        f"SELECT doc_id, {n('assign')}, {n('access')}, {n('hex')}, sha256({listed('base')}) AS base_sha256, {listed('list_sort(base || extra)')} AS spans, CAST(len(extra) AS BIGINT) AS n_entropy FROM e"
    )


def op3() -> str:
    weights = "[" + ", ".join(map(str, mixing.WEIGHTS)) + "]"
    cases = []
    for k, (a, b, c) in enumerate(mixing.SCHEDULES):
        k0, k1, k2 = mixing.KNOTS
        area0, area1 = (k1 - k0) * (a + b) / 2, (k2 - k1) * (b + c) / 2
        seg = lambda lo, h0, h1, w, r: f"{lo}e0 + 2 * ({r}) / ({h0}e0 + sqrt(greatest({h0 * h0}e0 + {2 * (h1 - h0) / w}e0 * ({r}), 0)))"
        r0, r1 = f"start / target * {area0 + area1}e0", f"start / target * {area0 + area1}e0 - {area0}e0"
        cases.append(f"WHEN tier = {k} THEN CASE WHEN {r0} <= {area0}e0 THEN {seg(k0, a, b, k1 - k0, r0)} ELSE {seg(k1, b, c, k2 - k1, r1)} END")
    taken = " + ".join(f"greatest(least(size, floor(target) - ({p} * source_size + start)), 0)" for p in range(mixing.REPEATS + 1))
    return f"""
    WITH d AS (SELECT doc_id, source, {_SIZE} AS size, md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', coalesce(md5(text), ''))) AS key FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(mixing.WEIGHTS)} AS tier FROM d GROUP BY source),
    w AS (SELECT *, CAST(({weights})[tier + 1] AS DOUBLE) AS weight, CAST({mixing.REPEATS} * source_size AS DOUBLE) AS most FROM s),
    o AS (SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER b, 0) AS words_left, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weight_left FROM w WINDOW b AS (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    g AS (SELECT *, words_left / weight_left * weight >= most AS isfull FROM o),
    x AS (SELECT source, source_size, tier, CASE WHEN isfull THEN most ELSE (SELECT arg_max(words_left / weight_left, words_left) FROM g WHERE NOT isfull) * weight END AS target FROM g),
    p AS (SELECT d.doc_id, d.size, x.source_size, x.target, x.tier, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN x ON d.source IS NOT DISTINCT FROM x.source),
    k AS (SELECT *, CAST({taken} AS BIGINT) AS taken FROM p)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, taken, CASE WHEN taken > 0 AND start < floor(target) THEN round(CASE {' '.join(cases)} END, 9) END AS time FROM k"""


def op6() -> str:
    trim = "trim(x, chr(32) || chr(9) || chr(13) || chr(11) || chr(12))"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
    n AS (SELECT source, count(*) AS pages FROM d GROUP BY 1),
    l AS (SELECT source, unnest(list_distinct(list_transform(lines, lambda x: {trim}))) AS line FROM d),
    c AS (SELECT source, line, count(*) AS k FROM l WHERE length(line) >= {line_dedup.MIN_CHARS} GROUP BY 1, 2 HAVING count(*) >= {line_dedup.MIN_PAGES}),
    b AS (SELECT c.source, list(line) AS gone FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source WHERE k > {line_dedup.RATIO}e0 * pages GROUP BY 1),
    r AS (SELECT doc_id, text, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), {trim})) AS kept FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
    SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
      CAST(length(coalesce(array_to_string(kept, chr(10)), '')) AS BIGINT) AS kept_chars, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM r"""


def op9() -> str:
    return """
    WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.row, a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score, b.row AS other FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.row <> b.row),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST, other) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def op12() -> str:
    """crc32 is spelt out by halves of bytes, the lower one first, over each different feature once."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = r"regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')" % (upper, upper.lower())
    run = lambda k: " || ' ' || ".join(["x", *[f"lead(x, {j}) OVER (PARTITION BY rid ORDER BY i)" for j in range(1, k + 1)]])
    runs = lambda rows: " UNION ALL ".join(f"SELECT * FROM (SELECT rid, {run(k)} AS f FROM (SELECT rid, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM {rows})) WHERE f IS NOT NULL" for k in range(importance.RUNS))
    b, nibbles = importance.BUCKETS, list(range(16))
    for _ in range(4):
        nibbles = [n >> 1 ^ (0xEDB88320 if n & 1 else 0) for n in nibbles]
    return f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
    e AS (SELECT row_number() OVER () AS rid, {words} AS w FROM benchmark),
    df AS MATERIALIZED ({runs('d')}),
    ef AS MATERIALIZED ({runs('e')}),
    u AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM ef)),
    n AS (SELECT f, list_transform(range(1, CAST(length(h) AS BIGINT) + 1), lambda i: instr('0123456789ABCDEF', h[i + 1 - 2 * ((i + 1) % 2)]) - 1) AS halves FROM u),
    c AS MATERIALIZED (SELECT f, xor(4294967295, list_reduce(list_concat([4294967295], halves), lambda a, x: xor(a >> 4, ({nibbles})[(xor(a, x) & 15) + 1]))) % {b} AS bucket FROM n),
    s AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS s FROM df JOIN c USING (f) GROUP BY 1),
    g AS (SELECT bucket, CAST(count(*) AS DOUBLE) AS t FROM ef JOIN c USING (f) GROUP BY 1),
    gains AS (SELECT s.bucket, floor(1000e0 * ln((coalesce(t, 0) + 1) * ((SELECT count(*) FROM df) + {b}e0) / ((s.s + 1) * ((SELECT count(*) FROM ef) + {b}e0)))) AS gain FROM s LEFT JOIN g USING (bucket)),
    p AS (SELECT rid, count(*) AS n, floor(sum(gain) / count(*)) AS weight FROM df JOIN c USING (f) JOIN gains USING (bucket) GROUP BY 1),
    v AS (SELECT doc_id, len(w) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
      CAST('0x' || substr(sha256('{importance.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN p USING (rid)),
    x AS (SELECT *, weight + CAST(floor(-1000e0 * ln(-ln((h + 0.5e0) / 4294967296e0))) AS BIGINT) AS score FROM v),
    r AS (SELECT *, row_number() OVER (PARTITION BY words >= {importance.MIN_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place FROM x)
    SELECT doc_id, n_features, weight, score, CASE WHEN words >= {importance.MIN_WORDS} AND place <= {importance.SHARE} * (SELECT count(*) FROM x WHERE words >= {importance.MIN_WORDS}) // 100 THEN place END AS rank FROM r"""


def op13() -> str:
    return f"""
    WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, encode(coalesce(html, '')) AS payload FROM pages),
    r AS (SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first FROM p WINDOW w AS (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS LAST)),
    s AS (SELECT *, place > 1 AND octet_length(payload) >= {warc.LEAST} AS revisit FROM r)
    SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN first END AS refers_to FROM s"""


ORACLE_SQL = {"op1_secret_scan": op1(), "op3_source_mixing": op3(), "op6_line_dedup": op6(), "op9_top_k": op9(), "op12_importance_resampling": op12(), "op13_warc": op13()}
