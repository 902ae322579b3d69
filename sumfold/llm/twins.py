"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

#: A table t with one list: the 256 remainders of CRC-32, by its rule.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t"


def crc32(text: str, t: str = "t") -> str:
    """CRC-32 of a string's UTF-8 bytes; 0 for null and empty. t: the list of CRC_TABLE."""
    octets = f"list_transform(string_split(trim(regexp_replace(hex(encode({text})), '(..)', '\\1 ', 'g')), ' '), lambda h: ('0x' || h)::BIGINT)"
    return f"CASE WHEN coalesce({text}, '') = '' THEN 0 ELSE xor(list_reduce({octets}, lambda c, b: xor({t}[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) END"


def curve(source: str, axes: list[str], bits: int) -> str:
    """source (a table or a query in brackets) plus `curve`, the index on the Hilbert curve, by Skilling's transform step by step."""
    n, out = len(axes), f"SELECT *, {', '.join(f'{a}::BIGINT AS x{i}' for i, a in enumerate(axes))} FROM {source}"
    replace = lambda q, **new: f"SELECT * REPLACE ({', '.join(f'{e} AS {x}' for x, e in new.items())}) FROM ({q})"
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        for i in range(n):
            first = f"CASE WHEN x{i} & {q} <> 0 THEN xor(x0, {q - 1}) ELSE xor(x0, xor(x0, x{i}) & {q - 1}) END"
            other = {f"x{i}": f"CASE WHEN x{i} & {q} <> 0 THEN x{i} ELSE xor(x{i}, xor(x0, x{i}) & {q - 1}) END"} if i else {}
            out = replace(out, x0=first, **other)
    for i in range(1, n):
        out = replace(out, **{f"x{i}": f"xor(x{i}, x{i - 1})"})
    turn = "0"
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        turn = f"xor({turn}, CASE WHEN x{n - 1} & {q} <> 0 THEN {q - 1} ELSE 0 END)"
    out = f"SELECT * EXCLUDE (turn) REPLACE ({', '.join(f'xor(x{i}, turn) AS x{i}' for i in range(n))}) FROM (SELECT *, {turn} AS turn FROM ({out}))"
    index = " + ".join(f"(((x{i} >> {b}) & 1) << {b * n + n - 1 - i})" for b in range(bits) for i in range(n))
    return f"SELECT * EXCLUDE ({', '.join(f'x{i}' for i in range(n))}), ({index})::BIGINT AS curve FROM ({out})"


def hilbert_shards(n_shards: int, bits: int) -> str:
    cell = lambda c: f"((rank() OVER (ORDER BY {c} NULLS FIRST) - 1) * {1 << bits} // count(*) OVER ()) AS q_{c}"
    return f"""
        WITH tab AS ({CRC_TABLE}), texts AS (SELECT text, {crc32('text')} AS c FROM (SELECT DISTINCT text FROM documents), tab),
        meta AS (SELECT doc_id, coalesce(strlen(d.text), 0) + 8 AS size, c AS text_crc32, source, lang FROM documents d JOIN texts x ON d.text IS NOT DISTINCT FROM x.text),
        cells AS (SELECT *, {cell('source')}, {cell('lang')}, {cell('size')} FROM meta),
        placed AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, size, doc_id NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM ({curve('cells', ['q_source', 'q_lang', 'q_size'], bits)})),
        cutup AS (SELECT *, r * {n_shards} // n AS shard FROM placed)
        SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard, (r - (shard * n + {n_shards - 1}) // {n_shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard, curve FROM cutup
    """


def temperature_mixture(max_rounds: float, flatten: float, block: int, seed: int) -> str:
    return f"""
        WITH RECURSIVE slim AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS tokens,
                   ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS draw FROM documents),
        totals AS (SELECT source, sum(tokens) AS tokens, sum(tokens) / sum(sum(tokens)) OVER () AS share FROM slim GROUP BY 1),
        known AS (SELECT list(share) AS p, max(share) / min(share) AS spread, -sum(share * ln(share)) AS own, ln(count(*)) AS flat FROM totals),
        target AS (SELECT p, spread, own + {flatten} * (flat - own) AS most FROM known),
        halves AS (
            SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.0::DOUBLE AS a FROM target
            UNION ALL
            SELECT step + 1, lo, hi, (lo + hi) / 2 FROM (
                SELECT step, CASE WHEN good THEN lo ELSE a END AS lo, CASE WHEN good THEN a ELSE hi END AS hi FROM (
                    SELECT *, ln(z) - a * l / z <= most + 1e-12 AND (1 - a) * ln(spread) <= ln({max_rounds}) + 1e-12 AS good FROM (
                        SELECT step, lo, hi, a, most, spread, list_sum(list_transform(p, lambda x: pow(x, a))) AS z, list_sum(list_transform(p, lambda x: pow(x, a) * ln(x))) AS l FROM halves, target WHERE step <= 30 AND lo < hi)))),
        found AS (SELECT hi AS a FROM halves WHERE step > 0 ORDER BY step DESC LIMIT 1),
        raw AS (SELECT source, tokens, share, pow(share, a) AS raw, a FROM totals, found),
        weights AS (SELECT source, tokens AS all_tokens, a, raw / sum(raw) OVER () AS weight, round(raw / sum(raw) OVER () * (sum(tokens) OVER () * max(share / raw) OVER () * sum(raw) OVER ()))::BIGINT AS budget FROM raw),
        reached AS (SELECT -sum(weight * ln(weight)) AS entropy FROM weights),
        laid AS (
            SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY draw % greatest(1, n // {block}), draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - tokens AS start
            FROM (SELECT *, count(*) OVER () AS n FROM slim))
        SELECT doc_id, l.source, l.tokens::BIGINT AS tokens, round(weight, 9) AS weight, budget, start::BIGINT AS start, (budget // all_tokens + (start < budget % all_tokens)::INTEGER)::BIGINT AS copies,
               round(a, 9) AS exponent, round(entropy, 9) AS entropy
        FROM laid l JOIN weights w ON l.source IS NOT DISTINCT FROM w.source, reached
    """
