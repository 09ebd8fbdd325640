"""The derived tables in DuckDB's SQL, and hashes as SQL text."""

from __future__ import annotations

from ..functions.hashing import CRC32C_TABLE, MURMUR2_SEED

_MASK = 4294967295
_M = 1540483477


def byte_list(blob: str) -> str:
    return f"[CAST(('0x' || substr(hex({blob}), CAST(i * 2 + 1 AS BIGINT), 2)) AS BIGINT) FOR i IN range(octet_length({blob}))]"


def murmur2(key: str) -> str:
    """Of a VARCHAR expression; meant for few distinct keys."""
    blob = f"encode({key})"
    b, n = byte_list(blob), f"octet_length({blob})"

    def word(i: str, size: int) -> str:
        return " + ".join(f"({b})[CAST({i} + {k + 1} AS BIGINT)] * {256**k}" for k in range(size))

    def times(x: str) -> str:
        return f"((({x}) * {_M}) & {_MASK})"

    k1 = times(word("j * 4", 4))
    blocks = f"[{times(f'xor({k1}, {k1} >> 24)')} FOR j IN range({n} // 4)]"
    body = f"list_reduce(list_concat([xor({MURMUR2_SEED}, {n})], {blocks}), lambda h, k : xor({times('h')}, k))"
    tail = f"({n} // 4) * 4"
    cases = " ".join(f"WHEN {r} THEN {times(f'xor(h1, {word(tail, r)})')}" for r in (1, 2, 3))
    return (
        f"(SELECT xor(h3, h3 >> 15) & 2147483647 FROM (SELECT {times('xor(h2, h2 >> 13)')} AS h3 FROM "
        f"(SELECT CASE {n} % 4 {cases} ELSE h1 END AS h2 FROM (SELECT {body} AS h1))))"
    )


def crc32c(blob: str) -> str:
    table = "[" + ",".join(map(str, CRC32C_TABLE)) + "]"
    return f"xor(list_reduce(list_concat([CAST({_MASK} AS BIGINT)], {byte_list(blob)}), lambda c, b : xor(c >> 8, ({table})[CAST((xor(c, b) & 255) + 1 AS BIGINT)])), {_MASK})"


def fnv1a32(text: str) -> str:
    return f"list_reduce(list_concat([CAST(2166136261 AS BIGINT)], {byte_list(f'encode({text})')}), lambda h, b : (xor(h, b) * 16777619) & {_MASK})"


def hex_of(number: str, width: int) -> str:
    """The low ``width`` bytes of a BIGINT as upper-case hex."""
    return f"right(lpad(CASE WHEN {number} < 0 THEN hex(CAST({number} AS HUGEINT) + 18446744073709551616) ELSE hex({number}) END, 16, '0'), {2 * width})"


def valid_name(name: str) -> str:
    return f"coalesce(regexp_full_match({name}, '[a-zA-Z0-9._-]+') AND length({name}) BETWEEN 1 AND 249 AND {name} NOT IN ('.', '..'), false)"


_CTES = {
    "rec": "rec AS (SELECT event_type AS topic, CAST(user_id AS VARCHAR) AS key, props AS value, epoch_us(ts) // 1000 AS ts_ms, ts, event_id FROM events)",
    "hashed": f"hashed AS MATERIALIZED (SELECT key, {murmur2('key')} AS hash FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS key FROM events))",
    "log": """log AS MATERIALIZED (SELECT topic, CAST(hash % 4 AS INTEGER) AS "partition", key, value, ts_ms, ts, event_id,
  row_number() OVER (PARTITION BY topic, hash % 4 ORDER BY ts, event_id) - 1 AS "offset",
  CAST(33 + octet_length(encode(key)) + octet_length(encode(value)) AS INTEGER) AS encoded_size FROM rec JOIN hashed USING (key))""",
    "log1": """log1 AS MATERIALIZED (SELECT 'events' AS topic, CAST(hash % 4 AS INTEGER) AS "partition", key, value, ts_ms, ts, event_id,
  row_number() OVER (PARTITION BY hash % 4 ORDER BY ts, event_id) - 1 AS "offset",
  CAST(33 + octet_length(encode(key)) + octet_length(encode(value)) AS INTEGER) AS encoded_size FROM rec JOIN hashed USING (key))""",
    "ends": """ends AS (SELECT topic, "partition", min("offset") AS log_start, max("offset") + 1 AS leo, max("offset") - 9 AS hw FROM log GROUP BY ALL)""",
    "ends1": """ends1 AS (SELECT topic, "partition", min("offset") AS log_start, max("offset") + 1 AS leo, max("offset") - 9 AS hw FROM log1 GROUP BY ALL)""",
    "commits": """commits AS (SELECT 'g' || (o_custkey % 5) AS group_id, o_orderstatus AS topic, CAST(o_orderkey % 4 AS INTEGER) AS "partition", o_orderkey AS "offset", o_orderdate AS committed_at, o_orderkey AS k FROM orders)""",
    "committed": """committed AS (SELECT group_id, topic, "partition", "offset" FROM (SELECT *, row_number() OVER (PARTITION BY group_id, topic, "partition" ORDER BY committed_at DESC, k DESC) AS rn FROM commits) WHERE rn = 1)""",
    "members": "members AS (SELECT DISTINCT 'g' || (c_nationkey % 5) AS group_id, c_mktsegment AS member_id FROM customer)",
    "ranked": "ranked AS (SELECT group_id, member_id, row_number() OVER (PARTITION BY group_id ORDER BY member_id) - 1 AS i, count(*) OVER (PARTITION BY group_id) AS k FROM members)",
    "topics": "topics AS (SELECT DISTINCT event_type AS name, CAST(4 + length(event_type) % 3 AS INTEGER) AS num_partitions FROM events)",
    "places": """places AS (SELECT name AS topic, CAST(p AS INTEGER) AS "partition" FROM topics, LATERAL (SELECT unnest(range(num_partitions)) AS p))""",
    "reports": """reports AS MATERIALIZED (SELECT 't' AS topic, CAST(l_suppkey % 4 AS INTEGER) AS "partition", CAST(l_linenumber % 3 + 1 AS INTEGER) AS broker_id, epoch_us(l_shipdate) // 1000 AS ts,
  row_number() OVER (PARTITION BY l_suppkey % 4 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS seq,
  row_number() OVER (PARTITION BY l_suppkey % 4, l_linenumber % 3 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS leo FROM lineitem)""",
    "caught": """caught AS (SELECT topic, "partition", broker_id, max(leo) AS leo, max(CASE WHEN own >= coalesce(lead_end, 0) THEN ts END) AS last_caught_up_ms FROM (
  SELECT *, max(CASE WHEN broker_id = 1 THEN leo END) OVER (PARTITION BY topic, "partition" ORDER BY seq) AS lead_end, max(leo) OVER (PARTITION BY topic, "partition", broker_id ORDER BY seq) AS own FROM reports) GROUP BY ALL)""",
    "lat": "lat AS (SELECT CAST(user_id % 16 AS INTEGER) AS worker, CAST(round(value * 100) AS BIGINT) AS us, epoch_us(ts) // 1000 AS ts_ms, ts, event_id FROM events)",
}
_NEEDS = {"log": ["rec", "hashed"], "log1": ["rec", "hashed"], "ends": ["log"], "ends1": ["log1"], "committed": ["commits"], "ranked": ["members"], "places": ["topics"], "caught": ["reports"]}


def sql(body: str, *ctes: str, recursive: bool = False, more: str = "") -> str:
    """``body`` under the derived tables it names, each after what it needs, then ``more`` ones of its own."""
    order: list[str] = []

    def need(name: str):
        for n in _NEEDS.get(name, []):
            need(n)
        if name not in order:
            order.append(name)

    for c in ctes:
        need(c)
    parts = [_CTES[c] for c in order] + ([more] if more else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}\n{body}" if parts else body
