"""The URL filter as one SQL statement, for the comparison of its whole result."""

from __future__ import annotations

from .urls import ORDER, SYMBOLS, Rule


def filter_urls_sql(rules: list[Rule], folds: int = 4) -> str:
    """page_id, host, path, rule and verdict of every row of `pages`, by rules, models and cut as in filter_urls."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    listed = ", ".join(f"('{r.host}', '{r.path}', {str(r.allow).lower()})" for r in rules)
    orders = range(ORDER + 1)
    own = " UNION ALL ".join(f"SELECT {o} AS o, g % {SYMBOLS ** (o + 1)} AS g, sum(n1) AS n1, sum(n0) AS n0 FROM counted GROUP BY 2" for o in orders)
    step, before = "", "wanted"
    for o in orders:
        shorter = {c: f"b.p{c}" if o else f"1.0::DOUBLE / {SYMBOLS}" for c in (1, 0)}
        mixed = ", ".join(f"CASE WHEN t.t{c} > 0 THEN (coalesce(w.n{c}, 0) + t.q{c} * {shorter[c]}) / (t.t{c} + t.q{c}) ELSE {shorter[c]} END AS p{c}" for c in (1, 0))
        size = SYMBOLS ** (o + 1)
        step += f"""
        order{o} AS (SELECT b.g, {mixed} FROM {before} b LEFT JOIN own w ON w.o = {o} AND w.g = b.g % {size}
            LEFT JOIN totals t ON t.o = {o} AND t.h = (b.g % {size}) // {SYMBOLS}),"""
        before = f"order{o}"
    places = " + ".join([f"coalesce(lag(s, {k}) OVER w, {SYMBOLS - 1}) * {SYMBOLS**k}" for k in range(ORDER, 0, -1)])
    return f"""
        WITH RECURSIVE given AS (
            SELECT row_number() OVER () AS k, page_id, coalesce(url, '') AS url,
                   translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{upper}', '{lower}') AS host,
                   regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path,
                   regexp_replace(translate(coalesce(url, ''), '{upper}', '{lower}'), '^[a-z]*://', '') AS bare
            FROM pages
        ), rules(rule_host, rule_path, allow) AS (VALUES {listed}),
        fitting AS (
            SELECT k, rule_host || rule_path AS rule, allow FROM given JOIN rules
            ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        ), ruled AS (SELECT k, max_by(rule, length(rule)) AS rule, max_by(allow, length(rule)) AS allow FROM fitting GROUP BY k),
        entries AS (
            SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS e
            FROM (SELECT unnest(range(256)) AS n)
        ), crc AS (
            SELECT k, hex(encode(url)) AS bytes, 1 AS i, 4294967295 AS c FROM given JOIN ruled USING (k)
            UNION ALL SELECT k, bytes, i + 2, xor(c >> 8, e) FROM crc
            JOIN entries ON n = xor(c & 255, CAST('0x' || substr(bytes, i, 2) AS BIGINT)) WHERE i < length(bytes)
        ), folded AS (SELECT k, allow, xor(c, 4294967295) % {folds} AS fold FROM crc JOIN ruled USING (k) WHERE i > length(bytes)),
        letters AS (
            SELECT k, generate_subscripts(string_split(bare, ''), 1) AS i, ascii(unnest(string_split(bare, ''))) AS a FROM given WHERE bare <> ''
        ), coded AS (
            SELECT k, i, CASE WHEN a BETWEEN 97 AND 122 THEN a - 97 WHEN a BETWEEN 48 AND 57 THEN 26 WHEN a = 47 THEN 27 WHEN a = 46 THEN 28
                WHEN a IN (45, 95) THEN 29 WHEN a IN (35, 37, 38, 43, 58, 61, 63) THEN 30 ELSE 31 END AS s FROM letters
        ), grams AS (SELECT k, {places} + s AS g FROM coded WINDOW w AS (PARTITION BY k ORDER BY i)),
        counted AS (
            SELECT g, count(*) FILTER (allow) AS n1, count(*) FILTER (NOT allow) AS n0 FROM grams JOIN folded USING (k) WHERE fold <> 0 GROUP BY g
        ), own AS ({own}),
        totals AS (
            SELECT o, g // {SYMBOLS} AS h, sum(n1) AS t1, sum(n0) AS t0, count(*) FILTER (n1 > 0) AS q1, count(*) FILTER (n0 > 0) AS q0
            FROM own GROUP BY 1, 2
        ), wanted AS (SELECT DISTINCT g FROM grams),{step}
        scored AS (SELECT k, sum(CAST(CAST(log2(p1 / p0) AS FLOAT) AS DOUBLE)) / count(*) AS score FROM grams JOIN {before} USING (g) GROUP BY k),
        bins AS (
            SELECT round(score * 1000) AS b, count(*) FILTER (allow) AS n1, count(*) FILTER (NOT allow) AS n0
            FROM scored JOIN folded USING (k) WHERE fold = 0 GROUP BY 1
        ), parted AS (
            SELECT b, sum(n1) OVER () AS t1, sum(n0) OVER () AS t0,
                   coalesce(sum(n1) OVER below, 0) AS b1, coalesce(sum(n0) OVER below, 0) AS b0
            FROM bins WINDOW below AS (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), best AS (
            SELECT (b - 0.5) / 1000 AS edge FROM parted WHERE t1 > 0 AND t0 > 0
            ORDER BY CAST(b0 AS DOUBLE) / t0 - CAST(b1 AS DOUBLE) / t1 DESC, abs(b), b LIMIT 1
        ), cut AS (
            SELECT coalesce((SELECT edge FROM best), 0) AS edge, (SELECT count(DISTINCT allow) FROM ruled) = 2 AS taught
        )
        SELECT page_id, host, path, rule,
               CASE WHEN coalesce(allow, CASE WHEN taught THEN score >= edge END, true) THEN 'allow' ELSE 'block' END AS verdict
        FROM given LEFT JOIN ruled USING (k) LEFT JOIN scored USING (k) CROSS JOIN cut
    """
