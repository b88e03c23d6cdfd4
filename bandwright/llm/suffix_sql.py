"""Repeated strings within a table's texts as plain SQL: every place of every text is compared, by its digest."""

from __future__ import annotations


def remove_repeats_sql(length: int = 400) -> str:
    """What remove_repeats returns for `documents`, worked out without a cover: two places are alike if the 128-bit
    digests of the strings that start there are equal.  Texts are hex digits meanwhile, two a byte, in blocks of 256 places."""
    return f"""
        WITH texts AS (
            SELECT row_number() OVER () AS line, doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents
        ), sized AS (
            SELECT *, length(digits) // 2 AS n_bytes FROM texts
        ), blocks AS (
            SELECT line, n_bytes, unnest(range(0, n_bytes - {length - 1}, 256)) AS base, digits FROM sized WHERE n_bytes >= {length}
        ), parts AS (
            SELECT line, base, least(256, n_bytes - {length - 1} - base) AS n, substr(digits, 2 * base + 1, {2 * (length + 255)}) AS part FROM blocks
        ), starts AS (
            SELECT line, base, unnest(range(0, n)) AS step, part FROM parts
        ), digests AS (
            SELECT line, base + step AS place, md5_number(substr(part, 2 * step + 1, {2 * length})) AS digest FROM starts
        ), repeated AS (
            SELECT line, place FROM digests WHERE digest IN (SELECT digest FROM digests GROUP BY digest HAVING count(*) > 1)
        ), opened AS (
            SELECT *, CASE WHEN place <= lag(place) OVER (PARTITION BY line ORDER BY place) + {length} THEN 0 ELSE 1 END AS opens FROM repeated
        ), named AS (
            SELECT *, sum(opens) OVER (PARTITION BY line ORDER BY place) AS span FROM opened
        ), spans AS (
            SELECT line, min(place) AS low, max(place) + {length} AS high FROM named GROUP BY line, span
        ), gaps AS (
            SELECT line, low, high, coalesce(lag(high) OVER (PARTITION BY line ORDER BY low), 0) AS past FROM spans
        ), heads AS (
            SELECT line, string_agg(substr(digits, 2 * past + 1, 2 * (low - past)), '' ORDER BY low) AS head,
                   max(high) AS past, sum(high - low) AS n_removed, count(*) AS n_spans
            FROM gaps JOIN sized USING (line) GROUP BY line
        )
        SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
               CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(head, '') || substr(digits, 2 * coalesce(past, 0) + 1))) AS kept_sha256
        FROM sized LEFT JOIN heads USING (line)
    """
