"""Each catalogue query again, in DuckDB's SQL."""

from __future__ import annotations

from keystrata.plans.catalog import FILTER, FLUSH_BYTES, FLUSH_KEYS, FLUSHED, LEVEL0_THRESHOLD, PICK_LIMIT, ROLL_AT, WRITERS
from keystrata.sources.tables import RUN_ROWS

LOG = f"""L AS (
  SELECT CAST(user_id AS VARCHAR) AS key, event_id + 1 AS seq, event_type = 'error' AS tombstone,
         CASE WHEN event_type = 'error' THEN NULL ELSE props END AS value, event_id // {RUN_ROWS} AS run_id,
         CAST(CASE (event_id // {RUN_ROWS}) % 4 WHEN 3 THEN 0 WHEN 0 THEN 2 ELSE 1 END AS BIGINT) AS level
  FROM events)"""
SIZE = "strlen(key) + coalesce(strlen(value), 0)"


def latest(source: str, extra: str = "") -> str:
    return f"(SELECT key, seq, tombstone, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM {source} {extra}) WHERE rn = 1)"


RUNS = f"""{LOG}, R AS (
  SELECT run_id, level, count(*) AS entries, CAST(sum({SIZE}) AS BIGINT) AS data_size,
         min(key) AS min_key, max(key) AS max_key, max(seq) AS max_seq
  FROM L GROUP BY run_id, level)"""
ASKED = "Q AS (SELECT DISTINCT CAST(s_suppkey * 3 AS VARCHAR) AS key FROM supplier)"
SCORE = f"""{RUNS}, S AS (
  SELECT a.run_id, a.data_size, count(b.run_id) AS n_overlaps
  FROM R a LEFT JOIN R b ON b.level = 2 AND a.min_key <= b.max_key AND a.max_key >= b.min_key
  WHERE a.level = 1 GROUP BY a.run_id, a.data_size)"""
PICK = f"""{SCORE}, G AS (
  SELECT run_id, data_size, n_overlaps FROM (
    SELECT *, sum(data_size) OVER () AS total, sum(data_size) OVER w AS cum, row_number() OVER w AS rn
    FROM S WINDOW w AS (ORDER BY n_overlaps, run_id ROWS UNBOUNDED PRECEDING))
  WHERE total >= {PICK_LIMIT} AND (rn = 1 OR total - (cum - data_size) > {PICK_LIMIT}))"""
LN = f"""{PICK}, I AS (
  SELECT run_id FROM G UNION ALL
  SELECT run_id FROM R WHERE level = 2
    AND min_key <= (SELECT max(max_key) FROM R WHERE run_id IN (SELECT run_id FROM G))
    AND max_key >= (SELECT min(min_key) FROM R WHERE run_id IN (SELECT run_id FROM G)))"""
MANIFEST = f"""{LOG}, M AS (
  SELECT DISTINCT run_id + 1 AS commit_id, 0 AS pos, 'add' AS op, run_id FROM L
  UNION ALL SELECT DISTINCT run_id + 5, 1, 'remove', run_id FROM L WHERE run_id % 3 = 0
  UNION ALL SELECT DISTINCT run_id + 9, 2, 'add', run_id FROM L WHERE run_id % 6 = 0)"""
SNAP = """(SELECT run_id, last_commit AS commit_id FROM (
  SELECT run_id, op, max(commit_id) OVER (PARTITION BY run_id) AS last_commit,
         row_number() OVER (PARTITION BY run_id ORDER BY commit_id DESC, pos DESC) AS rn FROM M) WHERE rn = 1 AND op = 'add')"""
DOC = "D AS (SELECT lpad(CAST(doc_id AS VARCHAR), 12, '0') AS key, doc_id + 1 AS seq, text AS value, doc_id // 100 AS run_id FROM documents)"


def rolled(source: str, by: str, number: str, full: str) -> str:
    """The fold that counts up before a record with which the written bytes are full."""
    return f"""N AS (SELECT *, CAST({SIZE} + 4 AS BIGINT) AS size, row_number() OVER (PARTITION BY {by} ORDER BY key, seq) AS rn FROM {source}),
  Y AS (SELECT {by}, key, rn, size AS written, CAST(0 AS BIGINT) AS {number} FROM N WHERE rn = 1
    UNION ALL SELECT n.{by}, n.key, n.rn, CASE WHEN {full} THEN n.size ELSE y.written + n.size END, CASE WHEN {full} THEN y.{number} + 1 ELSE y.{number} END
    FROM Y y JOIN N n ON n.{by} = y.{by} AND n.rn = y.rn + 1)"""


BLOCKS = f"""{DOC}, {rolled("D", "run_id", "block_id", "y.written + n.size > 4096")}, B AS (SELECT run_id, key, block_id FROM Y)"""
# keys of twelve bytes: 341 of them fill a block
RESTARTS = """D AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS key, o_orderkey // 1000 AS run_id FROM orders),
  B AS (SELECT run_id, key, (row_number() OVER (PARTITION BY run_id ORDER BY key) - 1) // 341 AS block_id FROM D),
  T AS (SELECT *, (row_number() OVER (PARTITION BY run_id, block_id ORDER BY key) - 1) % 16 = 0 AS restart FROM B)"""
BITS = " ".join(f"UNION ALL SELECT *, ('0x' || substr(md5(key), 1, 8))::BIGINT + ('0x' || substr(md5(key), 9, 8))::BIGINT * {i} AS h FROM X" for i in range(FILTER[1])).removeprefix("UNION ALL ")


def deletes(step: int) -> str:
    return f"""{LOG}, X AS (SELECT key, seq, tombstone, value FROM L UNION ALL
      SELECT CAST(s_suppkey * {step} AS VARCHAR), s_suppkey + 1000000000, true, NULL FROM supplier)"""


ORACLES = {
    "q_live": f"WITH {LOG} SELECT key, value, seq FROM {latest('L')} WHERE NOT tombstone",
    "q_point_get": f"WITH {LOG} SELECT '7' AS key, count(*) > 0 AS found, max(value) AS value FROM {latest('L')} WHERE key = '7' AND NOT tombstone",
    "q_get_missing": "SELECT 'no such key' AS key, false AS found, CAST(NULL AS VARCHAR) AS value",
    "q_multi_get": f"WITH {LOG}, {ASKED} SELECT q.key, v.key IS NOT NULL AS found, v.value FROM Q q LEFT JOIN (SELECT * FROM {latest('L')} WHERE NOT tombstone) v USING (key)",
    "q_put_overwrite": f"WITH {LOG} SELECT key, count(*) AS versions, arg_min(value, seq) AS first_value, arg_max(value, seq) AS last_value FROM L WHERE NOT tombstone GROUP BY key HAVING count(*) > 1",
    "q_delete": f"WITH {deletes(3)} SELECT key, value, seq FROM {latest('X')} WHERE NOT tombstone",
    "q_delete_missing": f"WITH {deletes(7000)} SELECT key, seq FROM {latest('X')} WHERE tombstone",
    "q_tombstones": f"WITH {LOG} SELECT key, seq FROM {latest('L')} WHERE tombstone",
    "q_scan_all": f"WITH {LOG} SELECT key, seq, tombstone, value FROM L",
    "q_scan_sorted": f"WITH {LOG} SELECT run_id, key, seq, row_number() OVER (PARTITION BY run_id ORDER BY key, seq) - 1 AS ordinal FROM L",
    "q_multi_run": f"WITH {LOG} SELECT * FROM {latest('L')}",
    "q_memtable_scan": f"WITH {LOG} SELECT * FROM {latest('L', f'WHERE seq > {FLUSHED}')}",
    "q_memtable_size": f"WITH {LOG} SELECT count(*) AS entries, CAST(coalesce(sum({SIZE}), 0) AS BIGINT) AS bytes FROM {latest('L', f'WHERE seq > {FLUSHED}')}",
    "q_wal_replay": f"WITH {LOG} SELECT * FROM {latest('L')}",
    "q_max_seq": f"WITH {LOG} SELECT coalesce(max(seq), 0) AS max_seq FROM L",
    "q_flush_runs": f"""WITH RECURSIVE {LOG}, M AS (
        SELECT CAST(key AS BIGINT) % {WRITERS} AS writer, key, seq, {SIZE} AS size, row_number() OVER (PARTITION BY CAST(key AS BIGINT) % {WRITERS} ORDER BY seq) AS rn FROM L),
      Z AS (
        SELECT writer, rn, seq, CAST(0 AS BIGINT) AS flush_id, [key] AS seen, [size] AS sizes FROM M WHERE rn = 1
        UNION ALL
        SELECT writer, rn, seq, CASE WHEN is_full THEN flush_id + 1 ELSE flush_id END,
          CASE WHEN is_full THEN [key] WHEN place > 0 THEN seen ELSE list_append(seen, key) END,
          CASE WHEN is_full THEN [size] WHEN place > 0 THEN list_concat(list_concat(sizes[1:place - 1], [size]), sizes[place + 1:]) ELSE list_append(sizes, size) END
        FROM (SELECT m.*, z.flush_id, z.seen, z.sizes, len(z.seen) >= {FLUSH_KEYS} OR list_sum(z.sizes) >= {FLUSH_BYTES} AS is_full, coalesce(list_position(z.seen, m.key), 0) AS place
              FROM Z z JOIN M m ON m.writer = z.writer AND m.rn = z.rn + 1))
      SELECT writer, seq, flush_id FROM Z""",
    "q_run_props": f"WITH {RUNS} SELECT run_id, entries, data_size, min_key, max_key, max_seq FROM R",
    "q_level_files": f"WITH {RUNS} SELECT level, count(*) AS files FROM R GROUP BY level",
    "q_level_size": f"WITH {RUNS} SELECT level, CAST(sum(data_size) AS BIGINT) AS bytes FROM R GROUP BY level",
    "q_level_hull": f"WITH {RUNS} SELECT level, min(min_key) AS min_key, max(max_key) AS max_key FROM R GROUP BY level",
    "q_level_threshold": f"""WITH {RUNS} SELECT level, CAST(sum(data_size) AS BIGINT) AS bytes,
        CAST(CASE level WHEN 1 THEN 10 WHEN 2 THEN 100 WHEN 3 THEN 1000 WHEN 4 THEN 10000 ELSE 100000 END AS BIGINT) * 1048576 AS level_limit,
        CAST(CASE level WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 20 WHEN 3 THEN 200 WHEN 4 THEN 2000 ELSE 200000 END AS BIGINT) * 1048576 AS file_target FROM R GROUP BY level""",
    "q_fence_prune": f"WITH {RUNS}, {ASKED} SELECT q.key, r.run_id FROM Q q JOIN R r ON q.key BETWEEN r.min_key AND r.max_key",
    "q_bloom_candidates": f"""WITH {RUNS}, {ASKED}, F AS (SELECT DISTINCT run_id, h % {FILTER[0]} AS place FROM (WITH X AS (SELECT DISTINCT run_id, key FROM L) {BITS})),
      C AS (SELECT q.key, r.run_id FROM Q q JOIN R r ON q.key BETWEEN r.min_key AND r.max_key),
      P AS (SELECT key, run_id, h % {FILTER[0]} AS place FROM (WITH X AS (SELECT * FROM C) {BITS}))
      SELECT p.key, p.run_id FROM P p LEFT JOIN F f ON f.run_id = p.run_id AND f.place = p.place GROUP BY ALL HAVING count(f.place) = count(*)""",
    "q_block_assign": f"WITH RECURSIVE {BLOCKS} SELECT run_id, key, block_id FROM B",
    "q_restart_points": f"WITH {RESTARTS} SELECT run_id, key, block_id, restart FROM T",
    "q_restart_search": f"""WITH {RESTARTS}, X AS (SELECT run_id, block_id, max(key) AS last_key FROM B GROUP BY ALL),
      A AS (SELECT lpad(CAST(s_suppkey * 7 AS VARCHAR), 12, '0') || CASE WHEN s_suppkey % 2 = 1 THEN 'x' ELSE '' END AS key, s_suppkey * 7 // 1000 AS run_id FROM supplier),
      S AS (SELECT a.key, a.run_id, min(x.block_id) AS block_id FROM A a JOIN X x ON a.run_id = x.run_id AND x.last_key >= a.key GROUP BY ALL)
      SELECT s.*, (SELECT max(t.key) FROM T t WHERE t.restart AND t.run_id = s.run_id AND t.block_id = s.block_id AND t.key <= s.key) AS point,
        EXISTS (SELECT 1 FROM B b WHERE b.run_id = s.run_id AND b.block_id = s.block_id AND b.key = s.key) AS found FROM S s""",
    "q_block_seek": f"""WITH RECURSIVE {BLOCKS}, X AS (SELECT run_id, block_id, max(key) AS last_key FROM B GROUP BY ALL),
      A AS (SELECT lpad(CAST(s_suppkey * 7 AS VARCHAR), 12, '0') AS key, CAST(floor(s_suppkey * 7 / 100) AS BIGINT) AS run_id FROM supplier)
      SELECT a.key, a.run_id, min(x.block_id) AS block_id FROM A a JOIN X x ON a.run_id = x.run_id AND x.last_key >= a.key GROUP BY ALL""",
    "q_file_roll": f"""WITH RECURSIVE {DOC}, E AS (SELECT *, (seq - 1) // 500 AS writer FROM D),
      {rolled("E", "writer", "file_id", f"CAST(floor(y.written * 1.2::DOUBLE) AS BIGINT) + n.size > {ROLL_AT}")} SELECT writer, key, file_id FROM Y""",
    "q_composite_key": "SELECT concat_ws('|', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR)) AS key, strlen(concat_ws('|', CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR))) + coalesce(strlen(text), 0) AS bytes FROM conversations",
    "q_overlap_join": f"WITH {RUNS} SELECT a.run_id, b.run_id AS other_id FROM R a JOIN R b ON a.run_id < b.run_id AND a.min_key <= b.max_key AND a.max_key >= b.min_key",
    "q_overlap_score": f"WITH {SCORE} SELECT * FROM S",
    "q_range_sort": f"WITH {RUNS} SELECT run_id, min_key, max_key FROM R ORDER BY 2, 3, 1",
    "q_l0_inputs": f"""WITH {RUNS} SELECT run_id FROM R WHERE (SELECT count(*) FROM R WHERE level = 0) >= {LEVEL0_THRESHOLD} AND (level = 0 OR level = 1
      AND min_key <= (SELECT max(max_key) FROM R WHERE level = 0) AND max_key >= (SELECT min(min_key) FROM R WHERE level = 0))""",
    "q_ln_inputs": f"WITH {LN} SELECT run_id FROM I",
    "q_excluded_runs": f"WITH {LN} SELECT run_id FROM R WHERE run_id NOT IN (SELECT run_id FROM I)",
    "q_greedy_pick": f"WITH {PICK} SELECT * FROM G",
    "q_compact_merge": f"WITH {LOG} SELECT * FROM {latest('L', 'WHERE level < 2')}",
    "q_obsolete_anti": f"WITH {LOG} SELECT * FROM {latest('L', 'WHERE level = 2')} m WHERE NOT EXISTS (SELECT 1 FROM L x WHERE x.level = 0 AND x.key = m.key AND x.seq >= m.seq)",
    "q_manifest_snapshot": f"WITH {MANIFEST} SELECT * FROM {SNAP}",
    "q_manifest_next_run": f"WITH {LOG} SELECT max(run_id) + 1 AS next_run FROM L",
    "q_manifest_checkpoint": f"WITH {MANIFEST} SELECT run_id FROM {SNAP}",
    "q_snapshot_diff": f"""WITH {MANIFEST}, O AS (SELECT DISTINCT run_id FROM L WHERE level < 2)
      SELECT coalesce(o.run_id, c.run_id) AS run_id, CASE WHEN c.run_id IS NULL THEN 'close' WHEN o.run_id IS NULL THEN 'open' ELSE 'keep' END AS action
      FROM O o FULL JOIN {SNAP} c ON o.run_id = c.run_id""",
    "q_seq_assign": "SELECT o_orderkey, 100 + row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq FROM orders",
    "q_version_rank": f"WITH {LOG} SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rank FROM L",
    "q_version_history": f"WITH {LOG} SELECT key, seq, lag(seq) OVER w AS prev_seq, lead(seq) OVER w AS next_seq FROM L WINDOW w AS (PARTITION BY key ORDER BY seq)",
    "q_as_of": f"WITH {LOG} SELECT key, value, seq FROM {latest('L', f'WHERE seq <= {FLUSHED}')} WHERE NOT tombstone",
    "q_key_scan": f"WITH {LOG} SELECT key, value, seq FROM {latest('L')} WHERE NOT tombstone AND key >= '1' AND key < '3'",
    "q_key_order": """SELECT o_orderkey - 100 AS n, lpad(hex(CAST(CAST(o_orderkey - 100 AS HUGEINT) + 9223372036854775808 AS UBIGINT)), 16, '0') AS key_hex,
      row_number() OVER (ORDER BY o_orderkey) AS rank FROM orders""",
    "q_checksum": f"WITH {LOG} SELECT key, seq FROM L WHERE seq % 7 <> 0",
    "q_store_live": f"WITH {LOG} SELECT key, value, seq FROM {latest('L')} WHERE NOT tombstone",
    "q_store_recovery": "SELECT CAST(s_suppkey AS VARCHAR) AS key, CASE WHEN s_suppkey = 2 THEN 'new' ELSE s_name END AS value FROM supplier WHERE s_suppkey <> 3 UNION ALL SELECT 'first', '1'",
    "q_stream_live": f"WITH {LOG} SELECT key, value, seq FROM {latest('L')} WHERE NOT tombstone",
}
