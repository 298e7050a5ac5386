"""DuckDB SQL of the catalogue's queries: the oracle of each."""

from __future__ import annotations

#: What a map keyed by a hash holds after sets with conflict hashes.
MAP_SET = """WITH e AS (SELECT user_id % 50 AS h, CASE WHEN user_id % 101 = 0 THEN 0 ELSE user_id % 3 + 1 END AS conflict, event_id AS seq, value AS v FROM events), f AS (SELECT h, arg_min(conflict, seq) AS c, min(CASE WHEN conflict = 0 THEN seq END) AS z FROM e GROUP BY h) SELECT e.h, e.conflict, e.seq, e.v FROM e JOIN f USING (h) WHERE e.conflict = 0 OR (e.conflict = f.c AND (f.z IS NULL OR e.seq < f.z)) QUALIFY row_number() OVER (PARTITION BY e.h ORDER BY e.seq DESC) = 1"""

#: Frames of the documents' texts, a log per source: one step a frame.
FRAMES = """WITH RECURSIVE d AS (SELECT source AS log, doc_id AS pos, strlen(text) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE strlen(text) > 0), r AS (SELECT log, pos, n, rn, CAST(0 AS BIGINT) AS frag, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS off, CAST(least(n, 32761) AS BIGINT) AS len, CAST(least(n, 32761) AS BIGINT) AS done FROM d WHERE rn = 1 UNION ALL SELECT log, pos, n, rn, frag, CASE WHEN frag = 0 THEN off ELSE start END, off, len, before + len FROM (SELECT *, CAST(least(n - before, 32768 - off % 32768 - 7) AS BIGINT) AS len FROM (SELECT d.log, d.pos, d.n, d.rn, CASE WHEN r.done < r.n THEN r.frag + 1 ELSE 0 END AS frag, r.start, CASE WHEN r.done < r.n THEN r.done ELSE 0 END AS before, r.off + 7 + r.len + CASE WHEN 32768 - (r.off + 7 + r.len) % 32768 < 7 THEN 32768 - (r.off + 7 + r.len) % 32768 ELSE 0 END AS off FROM r JOIN d ON d.log IS NOT DISTINCT FROM r.log AND d.rn = r.rn + CASE WHEN r.done < r.n THEN 0 ELSE 1 END)))"""

ORACLES: dict[str, str] = {
    # S-01,S-03,C-05,C-17,C-20
    "kv_scan": """SELECT c_name AS k, c_mktsegment AS v FROM customer""",
    # P-01,P-02,F-12
    "kv_point_get": """SELECT c_name AS k, c_mktsegment AS v FROM customer WHERE c_name = 'Customer#000000042'""",
    # P-01,K-13
    "kv_multi_get": """SELECT p.k, c.c_name IS NOT NULL AS found, c.c_mktsegment AS v FROM (VALUES ('Customer#000000001'),('Customer#000000042'),('Customer#999999999'),('')) p(k) LEFT JOIN customer c ON c.c_name = p.k""",
    # C-06,C-14,C-21,C-24
    "kv_seek_ceiling": """SELECT p.t, min(c.c_name) AS k FROM (VALUES ('Customer#000000041x'),(''),('Customer#000000042'),('zzz')) p(t) LEFT JOIN customer c ON c.c_name >= p.t GROUP BY p.t""",
    # C-18,C-25
    "kv_floor_strict": """SELECT p.t, max(c.c_name) AS k FROM (VALUES ('Customer#000000041x'),(''),('Customer#000000042'),('zzz')) p(t) LEFT JOIN customer c ON c.c_name < p.t GROUP BY p.t""",
    # C-03,C-12,C-19
    "kv_range_forward": """SELECT c_name AS k, c_mktsegment AS v FROM customer WHERE c_name >= 'Customer#000000100' ORDER BY c_name LIMIT 20""",
    # C-04,C-11
    "kv_range_reverse": """SELECT c_name AS k, c_mktsegment AS v FROM customer WHERE c_name <= 'Customer#000000100' ORDER BY c_name DESC LIMIT 20""",
    # C-07,C-08,C-15,C-16,C-22,C-23,C-26
    "kv_first_last": """SELECT min(c_name) AS first_k, max(c_name) AS last_k FROM customer""",
    # C-03,C-04,C-18,C-19
    "kv_neighbors": """SELECT c_name AS k, lag(c_name) OVER (ORDER BY c_name) AS prev_k, lead(c_name) OVER (ORDER BY c_name) AS next_k FROM customer""",
    # M-02,M-03,F-10
    "mem_versions": """SELECT user_id AS k, event_id AS seq, CASE WHEN event_type='error' THEN 0 ELSE 1 END AS vtype, event_id*256 + CASE WHEN event_type='error' THEN 0 ELSE 1 END AS tag, value AS v FROM events""",
    # F-14,K-03
    "mem_latest": """SELECT user_id AS k, event_id AS seq, event_type='error' AS deleted, value AS v FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
    # P-21,M-01
    "mem_live": """SELECT user_id AS k, event_id AS seq, value AS v FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'""",
    # P-21,P-22
    "mem_get_status": """SELECT p.k, CASE WHEN e.user_id IS NULL THEN 'ABSENT' WHEN e.event_type='error' THEN 'DELETED' ELSE 'FOUND' END AS status FROM (SELECT range AS k FROM range(0,200)) p LEFT JOIN (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) e ON e.user_id = p.k""",
    # M-05
    "set_insert_unique": """SELECT min(doc_id) AS doc_id, strlen(text) AS n_bytes FROM documents GROUP BY text""",
    # M-05 DuplicateEntry
    "set_duplicate_rejects": """SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1""",
    # P-20,P-07 exact,P-22
    "set_contains": """SELECT o_orderkey AS k, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS present FROM orders""",
    # M-06
    "set_len": """SELECT count(DISTINCT l_orderkey) AS n FROM lineitem""",
    # M-04,M-07,F-08
    "mem_usage": """SELECT count(*) AS n, CAST(sum(16 + strlen(c_name) + strlen(c_mktsegment)) AS BIGINT) AS bytes FROM customer""",
    # S-09..S-14,S-25,D-36
    "sst_blocks": """SELECT block_id, min(k) AS base_key, count(*) AS entries, block_id*(85*48+8) AS offset_start, block_id*(85*48+8) + count(*)*48+8 AS offset_end FROM (SELECT c_name AS k, (row_number() OVER (ORDER BY c_name)-1)//85 AS block_id FROM customer) GROUP BY block_id""",
    # P-05,P-06,P-08,C-27
    "sst_find_block": """SELECT p.t, max(b.block_id) AS block_id FROM (VALUES ('Customer#000000041x'),('A'),('Customer#000000085'),('zzz')) p(t) LEFT JOIN (SELECT block_id, min(k) AS base_key FROM (SELECT c_name AS k, (row_number() OVER (ORDER BY c_name)-1)//85 AS block_id FROM customer) GROUP BY block_id) b ON b.base_key <= p.t GROUP BY p.t""",
    # P-03,P-04
    "sst_value_offsets": """SELECT k, block_id, i*44 AS entry_offset, block_id*(85*48+8) + i*44 + 8 + 18 AS value_start FROM (SELECT c_name AS k, (row_number() OVER (ORDER BY c_name)-1)//85 AS block_id, (row_number() OVER (ORDER BY c_name)-1)%85 AS i FROM customer)""",
    # S-11
    "sst_blocks_variable": """WITH RECURSIVE o AS (SELECT row_number() OVER (ORDER BY c_name) AS rn, c_name AS k, 8+strlen(c_name)+strlen(c_mktsegment) AS sz FROM customer), r AS (SELECT rn, k, sz AS used, 1 AS n, 0 AS block_id FROM o WHERE rn=1 UNION ALL SELECT o.rn, o.k, CASE WHEN r.used+o.sz+4*r.n+8>4096 THEN o.sz ELSE r.used+o.sz END, CASE WHEN r.used+o.sz+4*r.n+8>4096 THEN 1 ELSE r.n+1 END, CASE WHEN r.used+o.sz+4*r.n+8>4096 THEN r.block_id+1 ELSE r.block_id END FROM r JOIN o ON o.rn=r.rn+1) SELECT block_id, min(k) AS base_key, count(*) AS entries FROM r GROUP BY block_id""",
    # P-13
    "bloom_hash": """SELECT k, CAST(xor(h, h>>16) AS BIGINT) AS h FROM (SELECT o_orderkey AS k, CAST((((2785903480::HUGEINT + o_orderkey) % 4294967296) * 3332679571) % 4294967296 AS BIGINT) AS h FROM orders)""",
    # P-10,P-11,P-12
    "bloom_probe": """WITH hh AS (SELECT k, xor(h, h>>16) AS h FROM (SELECT o_orderkey AS k, CAST((((2785903480::HUGEINT + o_orderkey) % 4294967296) * 3332679571) % 4294967296 AS BIGINT) AS h FROM orders)), pos AS (SELECT k, ((h + i*((h>>17) | ((h<<15) & 4294967295))) % 4294967296) % (SELECT greatest(64, (count(*)*10+7)//8*8) FROM orders WHERE o_orderkey%2=0) AS p FROM hh, range(0,6) t(i)), bits AS (SELECT DISTINCT p FROM pos WHERE k%2=0) SELECT pos.k, count(bits.p)=6 AS may_contain FROM pos LEFT JOIN bits USING (p) GROUP BY pos.k""",
    # K-04,K-06,K-13,D-20
    "cache_live_at": """SELECT user_id AS k, value AS v FROM (SELECT *, CASE WHEN event_id%10=0 THEN NULL ELSE ts + to_hours(event_id%10) END AS exp FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)=1) WHERE exp IS NULL OR exp >= TIMESTAMP '2024-01-15 00:00:00'""",
    # K-19,K-21,K-22
    "ttl_buckets": """SELECT epoch_us(ts + to_hours(event_id%10))//5000000 + 1 AS bucket, count(*) AS n FROM events WHERE event_id%10<>0 GROUP BY 1""",
    # K-18,K-20
    "ttl_sweep": """SELECT user_id AS k, event_id AS seq FROM (SELECT * FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)=1) WHERE event_id%10<>0 AND ts + to_hours(event_id%10) < TIMESTAMP '2024-01-15 00:00:00'""",
    # K-09,X-02,X-03
    "cache_metrics": """SELECT sum(CASE WHEN rn>1 THEN 1 ELSE 0 END)::BIGINT AS hits, sum(CASE WHEN rn=1 THEN 1 ELSE 0 END)::BIGINT AS misses, sum(CASE WHEN rn>1 THEN 1 ELSE 0 END)::DOUBLE/count(*) AS hit_ratio FROM (SELECT row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)""",
    # E-17..E-19
    "cms_estimate": """WITH s AS (SELECT * FROM (VALUES (0,11),(1,22),(2,37),(3,56)) s(r,seed)), c AS (SELECT r, xor(CAST(l_partkey AS BIGINT), CAST(seed AS BIGINT)) & 63 AS b, least(count(*),15) AS c FROM lineitem, s GROUP BY 1,2) SELECT k, min(c.c) AS est FROM (SELECT DISTINCT l_partkey AS k FROM lineitem) JOIN s ON true JOIN c ON c.r=s.r AND c.b = xor(CAST(k AS BIGINT), CAST(seed AS BIGINT)) & 63 GROUP BY k""",
    # E-17..E-19
    "cms_estimate_orders": """WITH s AS (SELECT * FROM (VALUES (0,11),(1,22),(2,37),(3,56)) s(r,seed)), c AS (SELECT r, xor(CAST(l_orderkey AS BIGINT), CAST(seed AS BIGINT)) & 4095 AS b, least(count(*),15) AS c FROM lineitem, s GROUP BY 1,2) SELECT k, min(c.c) AS est FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) JOIN s ON true JOIN c ON c.r=s.r AND c.b = xor(CAST(k AS BIGINT), CAST(seed AS BIGINT)) & 4095 GROUP BY k""",
    # E-13,E-14,E-15
    "lfu_estimate": """SELECT user_id AS k, least(count(*)-1,15)+1 AS est FROM events GROUP BY 1""",
    # E-09
    "lfu_victims": """SELECT user_id AS k, least(count(*)-1,15)+1 AS est FROM events GROUP BY 1 ORDER BY est, k LIMIT 5""",
    # E-16,E-20
    "lfu_halved": """SELECT user_id AS k, least(count(*)-1,15)>>1 AS freq FROM events GROUP BY 1""",
    # K-11
    "shard_histogram": """SELECT o_orderkey % 256 AS shard, count(*) AS n FROM orders GROUP BY 1""",
    # K-24
    "key_hash_int": """SELECT k, CAST(CASE WHEN k<0 THEN 18446744073709551616::HUGEINT + k ELSE k END AS DECIMAL(20,0)) AS h FROM (VALUES (-1::BIGINT),(0),(1),(-128),(127)) t(k)""",
    # K-25,K-26,E-22,E-23
    "ring_batches": """SELECT batch, count(*) AS n, min(event_id) AS first_id FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id)-1)//64 AS batch FROM events) GROUP BY batch HAVING count(*)=64""",
    # K-16
    "cache_replace_old_value": """SELECT user_id AS k, event_id AS seq, value AS v, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS old_v FROM events""",
    # E-03,E-05,E-08
    "policy_room": """SELECT p_partkey AS k, p_size AS cost, 1000 - CAST(sum(p_size) OVER (ORDER BY p_partkey) AS BIGINT) AS room FROM part""",
    # K-07,K-15,E-02
    "cache_remove": """SELECT o_orderkey AS k FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
    # K-08,E-04,E-12
    "cache_update_cost": """SELECT p_partkey AS k, CASE WHEN p_partkey%7=0 THEN 100 ELSE p_size END AS cost FROM part""",
    # F-03..F-07,F-11,S-23
    "codec_fixed32": """SELECT o_orderkey AS k, o_orderkey & 255 AS b0, (o_orderkey>>8) & 255 AS b1, (o_orderkey>>16) & 255 AS b2, (o_orderkey>>24) & 255 AS b3, (o_orderkey & 255) + ((o_orderkey>>8) & 255)*256 + ((o_orderkey>>16) & 255)*65536 + ((o_orderkey>>24) & 255)*16777216 AS decoded FROM orders""",
    # F-08,F-09
    "mem_entry_layout": """SELECT c_name AS k, strlen(c_name)+8 AS key_size, strlen(c_mktsegment) AS value_size, 4+strlen(c_name) AS tag_offset, 16+strlen(c_name) AS value_offset, 16+strlen(c_name)+strlen(c_mktsegment) AS total FROM customer""",
    # K-05,F-15
    "cache_cost_and_exp": """SELECT event_id AS seq, CASE WHEN event_id%3>0 THEN event_id%3 ELSE strlen(props) END AS cost, CASE WHEN event_id%10=0 THEN NULL ELSE ts + to_hours(event_id%10) END AS exp FROM events""",
    # K-14
    "cache_expiration": """SELECT user_id AS k, CASE WHEN event_id%10=0 THEN TIMESTAMP '1970-01-01 00:00:00' ELSE ts + to_hours(event_id%10) END AS exp FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)=1""",
    # K-22,K-23
    "ttl_buckets_current": """SELECT epoch_us(ts + to_hours(event_id%10))//5000000 + 1 AS bucket, user_id AS k FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)=1) WHERE event_id%10<>0""",
    # P-09,P-14,P-15,P-19
    "bloom_sizing": """SELECT n, CAST(ceil(n*ln(0.01)/(-8*ln(2)*ln(2))) AS BIGINT) AS bytes, CAST(greatest(1, ceil(CAST(ceil(n*ln(0.01)/(-8*ln(2)*ln(2))) AS BIGINT)*8.0/n*ln(2))) AS BIGINT) AS k FROM (VALUES (100),(1000),(10000),(1000000)) t(n)""",
    # S-04,S-06,C-10
    "sst_get_block": """SELECT k FROM (SELECT c_name AS k, (row_number() OVER (ORDER BY c_name)-1)//85 AS block_id FROM customer) WHERE block_id=1""",
    # S-02,S-07,S-08,S-26,S-27,F-13
    "sst_roundtrip": """SELECT c_name AS k, c_mktsegment AS v FROM customer""",
    # P-16,P-17,P-18
    "doorkeeper_seen": """SELECT event_id AS seq, user_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 AS seen FROM events""",
    # X-05,K-29
    "residency_histogram": """SELECT (epoch_us(nxt)-epoch_us(ts))//3600000000 AS hours, count(*) AS n FROM (SELECT ts, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events) WHERE nxt IS NOT NULL GROUP BY 1""",
    # K-17,K-12,E-21
    "cache_clear": """SELECT user_id AS k, max(event_id) AS seq, 'evict' AS event FROM events GROUP BY user_id""",
    # S-28
    "mem_load": """SELECT c_name AS k, 0 AS seq, 1 AS vtype, 1 AS tag, c_mktsegment AS v FROM customer""",
    # S-29
    "sst_codecs": """SELECT codec, c_name AS k, c_mktsegment AS v FROM customer, (VALUES ('snappy'),('zstd'),('lz4')) t(codec)""",
    # E-23
    "ring_gets": """SELECT count(*)//64*64 AS kept, 0 AS dropped, count(*)%64 AS waiting FROM events""",
    # X-01
    "metrics_stripes": """SELECT user_id % 25 * 10 AS stripe, count(*) AS value FROM events GROUP BY 1""",
    # X-06,X-07
    "metrics_report": """SELECT 'hit: ' || h || ' miss: ' || m || ' keys-added: 0 keys-updated: 0 keys-evicted: 0 cost-added: 0 cost-evicted: 0 sets-dropped: 0 sets-rejected: 0 gets-dropped: 0 gets-kept: 0 gets-total: ' || (h+m) || ' hit-ratio: ' || printf('%.2f', h::DOUBLE/(h+m)) AS report FROM (SELECT count(*) - count(DISTINCT user_id) AS h, count(DISTINCT user_id) AS m FROM events)""",
    # M-01
    "mem_put": """SELECT k, seq, 1 AS vtype, seq*256+1 AS tag, v, 16 + strlen(k) + strlen(v) AS bytes FROM (SELECT r_name AS k, row_number() OVER (ORDER BY r_regionkey) - 1 AS seq, r_name AS v FROM region UNION ALL SELECT n_name, (SELECT count(*) FROM region) + row_number() OVER (ORDER BY n_nationkey) - 1, n_name FROM nation)""",
    # P-02,P-06,P-12
    "sst_point_get": """SELECT p.t, c.c_name IS NOT NULL AS found, c.c_mktsegment AS v FROM (SELECT c_name AS t FROM customer UNION ALL SELECT c_name || 'x' FROM customer) p LEFT JOIN customer c ON c.c_name = p.t""",
    # X-03,D-27
    "cache_ratio": """SELECT hits, misses, hits::DOUBLE/(hits+misses) AS hit_ratio, hits::DOUBLE/misses AS hit_miss_ratio FROM (SELECT count(*) - count(DISTINCT user_id) AS hits, count(DISTINCT user_id) AS misses FROM events)""",
    # K-12
    "map_set": MAP_SET,
    # K-13
    "map_get": f"""SELECT p.h, p.conflict, m.seq, m.v FROM (SELECT range AS h, range % 4 AS conflict FROM range(60)) p LEFT JOIN ({MAP_SET}) m ON m.h = p.h AND (p.conflict = 0 OR p.conflict = m.conflict)""",
    # K-15
    "map_remove": f"""SELECT m.*, h % 2 = 0 AND (h % 4 = 0 OR h % 4 = conflict) AS removed FROM ({MAP_SET}) m""",
    # K-20
    "ttl_clean": """SELECT user_id AS k FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)=1) WHERE event_id%10<>0 AND epoch_us(ts + to_hours(event_id%10))//5000000 = (SELECT max(epoch_us(ts + to_hours(event_id%10))) FROM events WHERE event_id%10<>0)//5000000""",
    # E-05
    "policy_cost": """SELECT p_partkey AS k, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE -1 END AS cost FROM part""",
    # F-07,S-23
    "codec_read_exact": """SELECT c_name AS k, substr(c_name, 10, 9) AS part FROM customer""",
    # F-11
    "codec_cache_key": """SELECT o_orderkey AS k, printf('%02x%02x%02x%02x%02x%02x%02x%02x', o_orderkey & 255, (o_orderkey>>8) & 255, (o_orderkey>>16) & 255, (o_orderkey>>24) & 255, (o_orderkey>>32) & 255, (o_orderkey>>40) & 255, (o_orderkey>>48) & 255, (o_orderkey>>56) & 255) || repeat('00', 8) AS cache_key FROM (SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey FROM orders)""",
    # S-15..S-17
    "wal_frames": f"""{FRAMES} SELECT log, pos, CAST(frag AS INTEGER) AS frag, start AS "begin", off, CAST(CASE WHEN frag = 0 AND done = n THEN 1 WHEN frag = 0 THEN 2 WHEN done = n THEN 4 ELSE 3 END AS INTEGER) AS typ, CAST(len AS INTEGER) AS len FROM r""",
    # S-18,S-22
    "wal_checksum": f"""{FRAMES} SELECT log, pos, CAST(frag AS INTEGER) AS frag, true AS intact FROM r""",
    # S-20,S-21
    "wal_stream": """SELECT 'OK' AS status, text AS record FROM documents WHERE strlen(text) > 0""",
    # K-04,K-10,K-18
    "stream_evictions": """SELECT user_id AS k, event_id AS seq FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC)=1) WHERE event_id%10<>0 AND epoch_ms(ts + to_hours(event_id%10)) < (SELECT epoch_ms(max(ts)) FROM events)""",
}

# queries with the result of another one, by another way
ORACLES["stream_latest"] = ORACLES["mem_latest"]
ORACLES["stream_ttl"] = ORACLES["cache_live_at"]
ORACLES["stream_ttl_buckets"] = ORACLES["ttl_buckets"]
ORACLES["bloom_hash_bytes"] = ORACLES["bloom_hash"]
ORACLES["sst_block_roundtrip"] = ORACLES["kv_scan"]
ORACLES["mem_entry_roundtrip"] = "SELECT c_name AS k, c_custkey AS seq, 1 AS vtype, c_mktsegment AS v FROM customer"
ORACLES["wal_replay"] = "SELECT source AS log, doc_id AS pos, 'OK' AS status, text AS record FROM documents WHERE strlen(text) > 0"
