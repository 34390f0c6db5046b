"""DuckDB SQL for the queries of this subpackage that SQL can state."""

from __future__ import annotations

DECONTAMINATION = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM items WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM sized)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM words, lengths WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.n, p.s, v.item_id FROM places p JOIN windows v ON p.n = v.n AND p.win = v.win),
covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(f.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)
"""


def _crc_table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def crc32(blob: str) -> str:
    """SQL for the unsigned CRC-32 of a blob, byte by byte."""
    return f"xor(list_reduce(list_transform(regexp_extract_all(hex({blob}), '..'), lambda h: ('0x' || h)::BIGINT), lambda acc, x: xor(acc >> 8, {_crc_table()}[1 + (xor(acc, x) & 255)]), 4294967295::BIGINT), 4294967295)"


def _drawn(path: str, weight: float) -> str:
    return f"(-ln((('0x' || substr(md5(concat('tree-1|', {path}, '|', doc_id)), 1, 13))::BIGINT::DOUBLE + 1.0) / 4503599627370497.0) / {weight})"


#: Two regions of two racks of two shards, and a ninth shard as a region of its own, drawn for each document.
SHARDING = f"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {crc32("encode(coalesce(text, ''))")} AS text_crc32,
  {_drawn("'/r0'", 4.0)} AS r0, {_drawn("'/r1'", 4.0)} AS r1, {_drawn("'/r8x'", 1.0)} AS r8,
  [{', '.join(f"[{', '.join(_drawn(chr(39) + f'/r{r}/k{k}' + chr(39), 2.0) for k in (0, 1))}]" for r in (0, 1))}] AS racks,
  [{', '.join(_drawn(chr(39) + f'/r{i // 4}/k{i // 2 % 2}/{i}' + chr(39), 1.0) for i in range(8))}] AS shards FROM documents),
r AS (SELECT *, CASE WHEN r0 <= r1 THEN 0 ELSE 1 END AS region FROM d),
k AS (SELECT *, 4 * region + CASE WHEN racks[region + 1][1] <= racks[region + 1][2] THEN 0 ELSE 2 END AS first FROM r),
s AS (SELECT *, first + CASE WHEN shards[first + 1] <= shards[first + 2] THEN 0 ELSE 1 END AS shard FROM k),
p AS (SELECT *, ('0x' || substr(md5(concat(doc_id, '|', text_crc32)), 1, 8))::BIGINT % 4096 AS part FROM s)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY part, doc_id, text_crc32, size) - 1 AS slot, CASE WHEN r8 < least(r0, r1) THEN 8 ELSE shard END::INT AS grown_shard FROM p
"""



def _filled(level: int) -> str:
    """Shares of the nodes of a level: what their parents got, poured in until each is full or the level is even."""
    names = ", ".join(("domain", "lang", "source")[:level])
    parents = ", ".join(("domain", "lang", "source")[: level - 1])
    over = f"PARTITION BY {parents}" if parents else ""
    join = f"JOIN g{level - 1} USING ({parents})" if parents else "CROSS JOIN g0"
    return f"""c{level} AS (SELECT {names}, sum(cap) AS cap FROM leaves GROUP BY {names}),
  l{level} AS (SELECT {names}, cap, (got - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (count(*) OVER ({over}) - (row_number() OVER w - 1)) AS lev FROM c{level} {join} WINDOW w AS ({over} ORDER BY cap, {names})),
  g{level} AS (SELECT {names}, greatest(0.0, least(cap, max(lev) OVER ({over}))) AS got FROM l{level})"""


#: Three fifths of all tokens, shared down domain, language and source, then taken in seeded order in up to two epochs.
MIXING = f"""
WITH r AS (SELECT doc_id, concat('domain', {crc32("encode(coalesce(source, '-'))")} % 4) AS domain, coalesce(lang, '-') AS lang, coalesce(source, '-') AS source, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS tokens, {crc32("encode(text)")} AS mark FROM documents WHERE text IS NOT NULL),
  rows AS (SELECT * FROM r WHERE tokens > 0), leaves AS (SELECT domain, lang, source, (sum(tokens) * 2)::DOUBLE AS cap FROM rows GROUP BY ALL),
  g0 AS (SELECT least((SELECT sum(cap) FROM leaves), floor((SELECT sum(tokens) FROM rows) * 0.6::DOUBLE)) AS got), {_filled(1)}, {_filled(2)}, {_filled(3)},
  drawn AS (SELECT rows.*, epoch, md5(concat('mix-1|', epoch, '|', doc_id, '|', mark)) AS draw FROM rows, (VALUES (1), (2)) AS e(epoch)),
  placed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY epoch, draw, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM drawn)
SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, epoch::INT AS epoch, start::BIGINT AS start, least(tokens, budget - start)::BIGINT AS take, budget::BIGINT AS budget FROM placed JOIN (SELECT domain, lang, source, floor(got + 1e-6) AS budget FROM g3) USING (domain, lang, source) WHERE start < budget
"""

#: Every pair of adjacent lines that stands at an earlier place which shares no line with it; ids stand for rows.
LINES = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
  p AS (SELECT doc_id, pos, ls[pos + 1] AS a, ls[pos + 2] AS b FROM (SELECT doc_id, ls, unnest(range(len(ls) - 1)) AS pos FROM d WHERE len(ls) > 1)),
  f AS (SELECT a, b, min({'d': doc_id, 'pos': pos}) AS first FROM p GROUP BY a, b HAVING count(*) > 1),
  g AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1]) AS i FROM p JOIN f USING (a, b) WHERE doc_id <> first.d OR pos > first.pos + 1),
  r AS (SELECT doc_id, min(i) AS low, count(*) AS n FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM g) GROUP BY doc_id, island),
  s AS (SELECT doc_id, sum(n) AS n, string_agg(concat(low, '+', n), ',' ORDER BY low) AS removed FROM r GROUP BY doc_id), h AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, k: NOT list_contains(gone, k - 1)), chr(10)) END AS text, CASE WHEN text IS NULL THEN 0 ELSE len(ls) END::BIGINT AS n_lines, coalesce(s.n, 0)::BIGINT AS n_removed, coalesce(removed, '') AS removed
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN h USING (doc_id)
"""

SQL: dict[str, str] = {"op2_linededup": LINES, "op3_sharding": SHARDING, "op5_mixing": MIXING, "op8_decontamination": DECONTAMINATION}
