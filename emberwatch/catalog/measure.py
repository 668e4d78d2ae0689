"""Queries: metrics, evaluation, audit scans, retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import metrics as M
from ..operators import retrieve as R
from .base import EV, canon, query, table

LAT = "value / 100.0"


def _now():
    return F.lit("2024-01-20 12:00:00").cast("timestamp")


@query("throughput_windows", "SELECT epoch_us(time_bucket(INTERVAL '5 seconds', ts)) AS window_start, count(*) AS events, round(count(*) / 5.0::double, 6) AS events_per_second FROM events GROUP BY 1")
def _(spark, sf):
    return M.throughput_windows(table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("timestamp")))


@query("events_per_second", "SELECT round_even(count(*) / 5.0::double, 2) AS events_per_second FROM events WHERE ts BETWEEN timestamp '2024-01-20 12:00:00' - INTERVAL '1 hour' AND timestamp '2024-01-20 12:00:00'".replace("5.0", "3600.0"))
def _(spark, sf):
    return M.events_per_second(table(spark, sf, "events"), _now(), "ts", window_sec=3600)


NTH = "max(CASE WHEN rn = least(cast(floor(n * {p}) AS bigint), n - 1) + 1 THEN v END)"


@query("latency_stats", f"WITH s AS (SELECT value AS v, row_number() OVER (ORDER BY value) AS rn, count(*) OVER () AS n FROM events) SELECT round_even(avg(v), 3) AS avg_ms, round_even(min(v), 3) AS min_ms, round_even(max(v), 3) AS max_ms, round_even({NTH.format(p=0.95)}, 3) AS p95_ms, round_even({NTH.format(p=0.99)}, 3) AS p99_ms FROM s")
def _(spark, sf):
    return M.latency_stats(table(spark, sf, "events"), "value")


@query("order_statistics", f"WITH s AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS rn, count(*) OVER () AS n FROM lineitem) SELECT {NTH.format(p=0.0)} AS lowest, {NTH.format(p=0.5)} AS middle, {NTH.format(p=0.9)} AS p90, {NTH.format(p=1.0)} AS top FROM s")
def _(spark, sf):
    return M.order_statistics(table(spark, sf, "lineitem"), "l_extendedprice", {"lowest": 0.0, "middle": 0.5, "p90": 0.9, "top": 1.0})


@query("order_statistics_ties", f"WITH s AS (SELECT l_quantity AS v, row_number() OVER (ORDER BY l_quantity) AS rn, count(*) OVER () AS n FROM lineitem) SELECT {NTH.format(p=0.25)} AS q1, {NTH.format(p=0.5)} AS q2, {NTH.format(p=0.99)} AS p99 FROM s")
def _(spark, sf):
    return M.order_statistics(table(spark, sf, "lineitem"), "l_quantity", {"q1": 0.25, "q2": 0.5, "p99": 0.99})


@query("recent_latency", """WITH l AS (SELECT value AS v FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000), s AS (SELECT v, row_number() OVER (ORDER BY v) AS rn, count(*) OVER () AS n FROM l)
 SELECT round(avg(v), 6) AS avg_latency_ms, max(CASE WHEN rn = n // 2 + 1 THEN v END) AS p50_latency_ms, max(CASE WHEN rn = cast(floor(n * 0.95) AS bigint) + 1 THEN v END) AS p95_latency_ms, max(CASE WHEN rn = cast(floor(n * 0.99) AS bigint) + 1 THEN v END) AS p99_latency_ms, max(v) AS max_latency_ms FROM s""")
def _(spark, sf):
    return M.recent_latency(table(spark, sf, "events"), "value", "ts", "event_id")


@query("performance_profile", f"WITH s AS (SELECT l_extendedprice AS v, l_returnflag AS f, row_number() OVER (ORDER BY l_extendedprice) AS rn, count(*) OVER () AS n FROM lineitem) SELECT count(*) AS total_events, round(count(*) / 60.0::double, 6) AS events_per_second, round(avg(v), 6) AS avg_latency_ms, max(v) AS max_latency_ms, round(count(*) FILTER (WHERE f = 'R') / count(*)::double, 6) AS error_rate, {NTH.format(p=0.5)} AS p50_latency_ms, {NTH.format(p=0.95)} AS p95_latency_ms, {NTH.format(p=0.99)} AS p99_latency_ms FROM s")
def _(spark, sf):
    return M.performance_profile(table(spark, sf, "lineitem"), "l_extendedprice", 60, F.col("l_returnflag") == "R")


@query("recent_error_rate", "SELECT count(*) AS samples, round(count(*) FILTER (WHERE event_type = 'error') / count(*)::double, 6) AS error_rate FROM events WHERE ts > timestamp '2024-01-20 12:00:00' - INTERVAL '86400 seconds'")
def _(spark, sf):
    return M.recent_error_rate(table(spark, sf, "events"), _now(), F.col("event_type") == "error", "ts", window_sec=86400)


@query("mean_throughput", "SELECT round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS ops_per_second FROM events")
def _(spark, sf):
    return M.mean_throughput(table(spark, sf, "events").withColumn("timestamp", F.col("ts").cast("timestamp")), F.lit(1))


@query("latency_histogram", f"SELECT event_type, le, count(*) FILTER (WHERE v <= cast(le AS double)) AS cumulative_count FROM (SELECT event_type, {LAT}::double AS v, unnest(['0.001','0.005','0.01','0.025','0.05','0.1','0.25','0.5','1.0','2.5','5.0']) AS le FROM events) GROUP BY ALL UNION ALL SELECT event_type, '+Inf', count(*) FROM events GROUP BY event_type")
def _(spark, sf):
    return M.latency_histogram(table(spark, sf, "events"), F.expr("value / 100.0D"), "event_type")


@query("counters", "SELECT event_type, user_id % 3 AS shard, count(*) AS total FROM events GROUP BY ALL")
def _(spark, sf):
    return M.counters(table(spark, sf, "events").withColumn("shard", F.col("user_id") % 3), "event_type", "shard")


CM = "count(*) FILTER (WHERE p AND a) AS tp, count(*) FILTER (WHERE p AND NOT a) AS fp, count(*) FILTER (WHERE NOT p AND NOT a) AS tn, count(*) FILTER (WHERE NOT p AND a) AS fn"
RATES = """tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives, round(coalesce(tp / nullif(tp + fp, 0)::double, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::double, 0), 6) AS recall,
 round((tp + tn) / nullif(tp + fp + tn + fn, 0)::double, 6) AS accuracy, round(coalesce(fp / nullif(fp + tn, 0)::double, 0), 6) AS false_positive_rate, round(coalesce(fn / nullif(fn + tp, 0)::double, 0), 6) AS false_negative_rate, round(coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_score"""


@query("confusion_matrix", f"WITH m AS (SELECT {CM} FROM (SELECT quality = 1 AS p, toxic = 1 AS a FROM labels)) SELECT {RATES} FROM m")
def _(spark, sf):
    return M.confusion(table(spark, sf, "labels"), F.col("quality") == 1, F.col("toxic") == 1)


@query("evaluate_runs", f"""WITH {EV}, l AS (SELECT user_id % 5 AS run_id, event_id, severity IN ('high', 'critical') AS a, timestamp, value FROM ev), d AS (SELECT DISTINCT user_id % 5 AS run_id, event_id FROM ev WHERE status = 'denied' OR k % 10 = 1 UNION SELECT user_id % 5, event_id + 1000000 FROM ev WHERE k = 7),
 j AS (SELECT coalesce(l.run_id, d.run_id) AS run_id, d.event_id IS NOT NULL AS p, coalesce(a, false) AS a, l.event_id IS NOT NULL AS seen, timestamp, value FROM l FULL JOIN d ON l.run_id = d.run_id AND l.event_id = d.event_id),
 m AS (SELECT run_id, {CM}, count(*) FILTER (WHERE seen) AS events_processed, count(*) FILTER (WHERE p) AS detections_count, count(*) FILTER (WHERE seen) / ((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6) AS thr, avg(value) AS lat FROM j GROUP BY run_id)
 SELECT run_id, events_processed, detections_count, round(thr, 6) AS throughput_eps, round(lat, 6) AS avg_latency_ms, {RATES} FROM m""")
def _(spark, sf):
    return _runs(spark, sf)


def _runs(spark, sf):
    ev = canon(spark, sf).withColumn("run_id", F.col("user_id") % 5)
    labels = ev.select("run_id", "event_id", F.col("severity").isin("high", "critical").alias("expected"), F.col("timestamp").alias("processed_at"), F.col("value").alias("latency_ms"))
    hits = ev.filter("status = 'denied' or k % 10 = 1").select("run_id", "event_id").unionByName(ev.filter("k = 7").select("run_id", (F.col("event_id") + 1000000).alias("event_id")))
    return M.evaluate_runs(labels, hits)


@query("evaluation_report", f"""WITH {EV}, l AS (SELECT user_id % 5 AS run_id, event_id, severity IN ('high', 'critical') AS a, timestamp FROM ev), d AS (SELECT DISTINCT user_id % 5 AS run_id, event_id FROM ev WHERE status = 'denied' OR k % 10 = 1 UNION SELECT user_id % 5, event_id + 1000000 FROM ev WHERE k = 7),
 j AS (SELECT coalesce(l.run_id, d.run_id) AS run_id, d.event_id IS NOT NULL AS p, coalesce(a, false) AS a, l.event_id IS NOT NULL AS seen, timestamp FROM l FULL JOIN d ON l.run_id = d.run_id AND l.event_id = d.event_id), m AS (SELECT run_id, {CM}, count(*) FILTER (WHERE seen) AS n, count(*) FILTER (WHERE p) AS h, count(*) FILTER (WHERE seen) / ((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6) AS thr FROM j GROUP BY run_id)
 SELECT count(*) AS total_runs, cast(sum(n) AS bigint) AS total_events_processed, cast(sum(h) AS bigint) AS total_detections, round(avg(tp / (tp + fp)::double), 6) AS avg_precision, round(avg(tp / (tp + fn)::double), 6) AS avg_recall, round(avg(2.0::double * tp / (2 * tp + fp + fn)), 6) AS avg_f1_score, round(avg(thr), 6) AS avg_throughput_eps FROM m""")
def _(spark, sf):
    return M.evaluation_report(_runs(spark, sf))


# ---- audit ---------------------------------------------------------------------------------------------------
def _sq(p: str) -> str:
    return "'" + p.replace("'", "''") + "'"


@query("audit_secrets", " UNION ALL ".join(f"SELECT doc_id, '{d}' AS title, len(regexp_extract_all(text, {_sq(p)})) AS instances, concat('Found ', len(regexp_extract_all(text, {_sq(p)})), ' instance(s) of {d.lower()}') AS description FROM documents WHERE regexp_matches(text, {_sq(p)})" for p, d in A.SECRET_PATTERNS))
def _(spark, sf):
    return A.secret_findings(table(spark, sf, "documents"), "text", "doc_id").select("doc_id", "title", "instances", "description")


# code-like texts: every page's markup with a marker by id
@query("audit_injection", "WITH c AS (SELECT page_id, concat(html, CASE page_id % 5 WHEN 0 THEN ' cur.execute(q %s)' WHEN 1 THEN ' f\"SELECT a FROM {t}' WHEN 2 THEN ' \"x\".format(a) + SELECT' WHEN 3 THEN ' q + request' ELSE '' END) AS code FROM pages) " + " UNION ALL ".join(
    f"SELECT page_id, '{d}' AS description, 'CWE-89' AS cwe_id FROM c WHERE regexp_matches(code, {_sq(p.replace(chr(92) + '%s', '%s'))})" for p, d in A.SQL_PATTERNS))
def _(spark, sf):
    code = table(spark, sf, "pages").selectExpr("page_id", "concat(html, case page_id % 5 when 0 then ' cur.execute(q %s)' when 1 then ' f\"SELECT a FROM {t}' when 2 then ' \"x\".format(a) + SELECT' when 3 then ' q + request' else '' end) as code")
    return A.injection_findings(code, "code", "page_id").select("page_id", "description", "cwe_id")


def _checks(spark, sf):
    return canon(spark, sf).select(F.col("user_id").alias("report_id"), F.expr("k % 9 <> 0").alias("passed"), F.expr("case when k % 11 < 10 then 'low' else 'high' end").alias("severity"), F.expr("case when k % 2 = 0 then array('soc2:a', 'gdpr:b') else array('hipaa:c', 'odd') end").alias("compliance_refs"))


CKS = f"{EV}, c AS (SELECT user_id AS report_id, k % 9 <> 0 AS ok, CASE WHEN k % 11 < 10 THEN 'low' ELSE 'high' END AS sev, k FROM ev)"


@query("audit_report", f"""WITH {CKS}, g AS (SELECT report_id, count(*) FILTER (WHERE ok) AS p, count(*) FILTER (WHERE NOT ok) AS f, count(*) FILTER (WHERE NOT ok AND sev = 'high') AS h FROM c GROUP BY report_id), s AS (SELECT *, p / (p + f)::double * 100 AS sc FROM g)
 SELECT report_id, p AS checks_passed, f AS checks_failed, round(sc, 6) AS overall_score, CASE WHEN h > 2 THEN 'high' WHEN h > 0 OR sc < 70 THEN 'medium' WHEN sc < 90 THEN 'low' ELSE 'minimal' END AS risk_rating FROM s""")
def _(spark, sf):
    return A.audit_report(_checks(spark, sf)).select("report_id", "checks_passed", "checks_failed", "overall_score", "risk_rating")


@query("audit_compliance", f"""WITH {CKS}, fw AS (SELECT unnest(['soc2','nist_csf','iso_27001','pci_dss','hipaa','gdpr','cis_benchmarks']) AS framework), e AS (SELECT report_id, framework, count(*) FILTER (WHERE NOT ok AND ((k % 2 = 0 AND framework IN ('soc2', 'gdpr')) OR (k % 2 = 1 AND framework = 'hipaa'))) AS failed FROM c, fw GROUP BY ALL)
 SELECT report_id, framework, greatest(10, failed) AS controls_checked, greatest(10, failed) - failed AS controls_passed, failed AS controls_failed, round((greatest(10, failed) - failed) / greatest(10, failed)::double * 100, 6) AS compliance_pct FROM e""")
def _(spark, sf):
    return A.compliance_status(_checks(spark, sf))


@query("audit_counts", f"WITH f AS (SELECT doc_id, text FROM documents), s AS ({' UNION ALL '.join(f'SELECT doc_id FROM f WHERE regexp_matches(text, {_sq(p)})' for p, d in A.SECRET_PATTERNS)}) SELECT 'severity' AS dimension, 'critical' AS value, count(*) AS n FROM s HAVING count(*) > 0 UNION ALL SELECT 'category', 'secrets', count(*) FROM s HAVING count(*) > 0 UNION ALL SELECT 'status', 'open', count(*) FROM s HAVING count(*) > 0 UNION ALL SELECT 'total', NULL, count(*) FROM s")
def _(spark, sf):
    return A.finding_counts(A.secret_findings(table(spark, sf, "documents"), "text", "doc_id"))


@query("audit_resolved", "WITH f AS (" + " UNION ALL ".join(f"SELECT doc_id, '{d}' AS title FROM documents WHERE regexp_matches(text, {_sq(p)})" for p, d in A.SECRET_PATTERNS) + ") SELECT concat(doc_id, '|', title) AS finding_id, CASE WHEN doc_id % 3 = 0 THEN 'resolved' WHEN doc_id % 3 = 1 THEN 'accepted' ELSE 'open' END AS status, CASE WHEN doc_id % 3 < 2 THEN concat('note ', doc_id) END AS resolution_notes FROM f")
def _(spark, sf):
    found = A.secret_findings(table(spark, sf, "documents"), "text", "doc_id").withColumn("finding_id", F.concat_ws("|", "doc_id", "title"))
    log = found.filter("doc_id % 3 < 2").select("finding_id", F.when(F.col("doc_id") % 3 == 0, "resolved").otherwise("accepted").alias("status"), F.concat(F.lit("note "), F.col("doc_id")).alias("resolution_notes"), _now().alias("changed_at"))
    return A.finding_state(found, log).select("finding_id", "status", "resolution_notes")


# ---- retrieval -----------------------------------------------------------------------------------------------
# fold over paragraphs: the list keeps finished chunks, its last entry is the open one
def _chunks_sql(tab: str, key: str) -> str:
    return f"""pp AS (SELECT {key} AS id, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS n, unnest(string_split(text, chr(10) || chr(10))) AS para FROM {tab}),
 cw(id, n, cur, done) AS (SELECT id, n, concat(para, chr(10), chr(10)), NULL::varchar FROM pp WHERE n = 1
  UNION ALL SELECT p.id, p.n, CASE WHEN length(c.cur) + length(p.para) < 500 THEN concat(c.cur, p.para, chr(10), chr(10)) ELSE concat(p.para, chr(10), chr(10)) END, CASE WHEN length(c.cur) + length(p.para) < 500 THEN NULL ELSE c.cur END FROM cw c JOIN pp p ON p.id = c.id AND p.n = c.n + 1),
 lastn AS (SELECT id, max(n) AS mn FROM cw GROUP BY id),
 raw AS (SELECT id, n, regexp_replace(done, '^\\s+|\\s+$', '', 'g') AS content FROM cw WHERE done IS NOT NULL UNION ALL SELECT cw.id, cw.n + 1, regexp_replace(cur, '^\\s+|\\s+$', '', 'g') FROM cw JOIN lastn ON cw.id = lastn.id AND cw.n = mn WHERE regexp_replace(cur, '\\s', '', 'g') <> ''),
 chunks AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS position, content FROM raw)"""


@query("chunk_documents", f"WITH RECURSIVE {_chunks_sql('documents', 'doc_id')} SELECT id AS doc_id, position, substr(md5(content), 1, 16) AS chunk_id, substr(md5(concat('doc_', id)), 1, 16) AS document_id, length(content) AS chars FROM chunks")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    out = R.make_chunks(docs, "text", F.concat(F.lit("doc_"), F.col("doc_id")), F.lit("document"), ("doc_id",), vectors=False)
    return out.select("doc_id", "position", "chunk_id", "document_id", F.length("content").alias("chars"))


@query("chunk_conversations", "WITH RECURSIVE p AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id), " + _chunks_sql("p", "conv_id") + " SELECT id AS conv_id, count(*) AS chunks, cast(sum(length(content)) AS bigint) AS chars FROM chunks GROUP BY id")
def _(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    conv = turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))
    return R.make_chunks(conv, "text", F.col("conv_id").cast("string"), F.lit("chat"), ("conv_id",), vectors=False).groupBy("conv_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("chars"))


HEX = "cast(concat('0x', substr(md5(tok), {a}, 8)) AS bigint)"
SLOTS = f"((({HEX.format(a=1)} % 384 + {HEX.format(a=9)} % 384 + {HEX.format(a=17)} % 384) * 256 + {HEX.format(a=25)}) % 384)"


def _vec_sql(name: str, src: str, key: str, text: str) -> str:
    return f"{name}t AS (SELECT {key} AS id, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+')) AS tok FROM {src}), {name}c AS (SELECT id, {SLOTS} AS slot, count(*) AS n FROM {name}t GROUP BY ALL), {name} AS (SELECT id, slot, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS w FROM {name}c)"


@query("embed_documents", f"WITH {_vec_sql('v', 'documents', 'doc_id', 'text')} SELECT id AS doc_id, slot, round(w, 6) AS weight FROM v")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", R.embed("text").alias("e"))
    return docs.select("doc_id", F.posexplode("e").alias("slot", "weight")).filter("weight > 0")


@query("top_k_documents", f"""WITH {_vec_sql('v', 'documents', 'doc_id', 'text')}, {_vec_sql('q', 'benchmark', 'item_id', 'text')}, s AS (SELECT q.id AS query_id, v.id AS doc_id, sum(q.w * v.w) AS score FROM q JOIN v ON q.slot = v.slot GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", R.embed("text").alias("embedding"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), R.embed("text").alias("embedding"))
    return R.top_k(asked, docs, 5, key="doc_id").select("query_id", "doc_id", "rank", "score")


@query("retrieve_chunks", f"""WITH RECURSIVE {_chunks_sql('documents', 'doc_id')}, dc AS (SELECT substr(md5(content), 1, 16) AS cid, min(content) AS content FROM chunks GROUP BY 1), {_vec_sql('v', 'dc', 'cid', 'content')}, {_vec_sql('q', 'benchmark', 'item_id', 'text')},
 s AS (SELECT q.id AS query_id, v.id AS chunk_id, sum(q.w * v.w) AS score FROM q JOIN v ON q.slot = v.slot GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rn FROM s)
 SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rn) AS rank, round(score, 6) AS score FROM r WHERE rn <= 10 AND score >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rn) <= 5""")
def _(spark, sf):
    chunks = R.make_chunks(table(spark, sf, "documents"), "text", F.concat(F.lit("doc_"), F.col("doc_id")), F.lit("document"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return R.retrieve(asked, chunks, 5, 0.3).select("query_id", "chunk_id", "rank", "score")


@query("nearest_to_label_means", """WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::double AS x FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM e GROUP BY ALL), s AS (SELECT m.label AS query_id, e.vec_id, sum(m.x * e.x) AS score FROM m JOIN e USING (i) GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s) SELECT cast(query_id AS bigint) AS query_id, vec_id, rank, round(score, 4) AS score FROM r WHERE rank <= 3""")
def _(spark, sf):
    vec = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    # one mean vector per label: as many queries as labels
    cells = vec.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    means = cells.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("c")).select(F.col("label").alias("query_id"), F.transform("c", lambda c: c["x"]).alias("embedding"))
    return R.top_k(means, vec, 3, key="vec_id").select("query_id", "vec_id", "rank", F.round("score", 4).alias("score"))
