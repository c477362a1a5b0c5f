"""Registered queries of queue, ledger, planner, training, prompts and reports."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from .catalog import QUEUE, TIE, query, queue, r6, results, t
from .functions import parsing
from .plans import ledger as L, queue as Q, training
from .sources import sinks
from .streaming import guard

#: The queue as it was: what runs was pending, and every ninth entry was running.
def was():
    return F.when(F.col("pos") % 9 == 0, "running").when(F.col("status") == "running", "pending").otherwise(F.col("status"))


WAS_SQL = "was AS (SELECT pos, name, CASE WHEN pos % 9 = 0 THEN 'running' WHEN status = 'running' THEN 'pending' ELSE status END AS status FROM queue)"


@query(f"WITH {QUEUE}, {WAS_SQL} SELECT q.name, w.status AS was, q.status FROM queue q JOIN was w USING (name) WHERE q.status <> w.status")
def j5_changed(spark, sf):
    q = queue(spark, sf)
    return Q.changed(q.withColumn("status", was()), q)


@query(f"WITH {QUEUE}, {WAS_SQL} SELECT q.name FROM queue q JOIN was w USING (name) WHERE q.status <> w.status UNION SELECT name FROM queue WHERE status = 'running'")
def u2_touched(spark, sf):
    q = queue(spark, sf)
    return Q.touched(q.withColumn("status", was()), q)


@query(f"WITH {QUEUE} SELECT count(*) AS n FROM queue WHERE status = 'pending'")
def a26_pending(spark, sf):
    return Q.pending(queue(spark, sf))


@query(f"WITH {QUEUE}, one AS (SELECT min(pos) AS p FROM queue WHERE status = 'running') SELECT pos, CASE WHEN pos = p THEN 500.0::DOUBLE ELSE heartbeat END AS heartbeat FROM queue, one")
def c2_heartbeat(spark, sf):
    q = queue(spark, sf)
    first = q.where("status = 'running'").orderBy("pos").first()
    return Q.heartbeat(q, first["name"], first["owner"], 500.0).select("pos", "heartbeat")


def new_entries(spark, sf):
    """Entries of which some are there, and some names come twice."""
    return queue(spark, sf).where("pos % 4 = 0").withColumns({"name": F.when(F.col("pos") % 8 == 0, F.col("name")).otherwise(F.concat(F.lit("new-"), F.floor(F.col("pos") / 24)))})


NEW_SQL = "entries AS (SELECT pos, CASE WHEN pos % 8 = 0 THEN name ELSE 'new-' || pos // 24 END AS name FROM queue WHERE pos % 4 = 0), fresh AS (SELECT * FROM entries WHERE name NOT IN (SELECT name FROM queue))"


@query(f"WITH {QUEUE}, {NEW_SQL}, first AS (SELECT name, min(pos) AS p FROM fresh GROUP BY name) SELECT name, pos FROM queue UNION ALL SELECT name, row_number() OVER (ORDER BY p) + (SELECT max(pos) FROM queue) FROM first")
def c4_extended(spark, sf):
    return Q.extended(queue(spark, sf), new_entries(spark, sf)).select("name", "pos")


@query(f"WITH {QUEUE}, {NEW_SQL} SELECT name, pos FROM queue UNION ALL SELECT name, pos FROM fresh")
def j8_merged(spark, sf):
    return Q.merged(queue(spark, sf), new_entries(spark, sf)).select("name", "pos")


@query(f"WITH {QUEUE}, {NEW_SQL} SELECT name, count(*) AS n FROM fresh GROUP BY name HAVING count(*) > 1")
def a28_duplicates(spark, sf):
    q = queue(spark, sf)
    return Q.duplicates(Q.merged(q, new_entries(spark, sf)))


STEPS = (250, 1000, 4000)
CONFIG = """arms AS (SELECT o_orderkey AS id, o_orderpriority AS hypothesis, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'failed' ELSE 'done' END AS status, o_orderdate AS created_at, o_orderkey % 7 AS r,
  CASE WHEN o_orderkey % 7 < 4 THEN 250 WHEN o_orderkey % 7 < 6 THEN 1000 ELSE 4000 END AS steps, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS score FROM orders),
led AS (SELECT *, '{"arm": ' || id // 3 || ', "max_steps": ' || steps || '}' AS config_json FROM arms)"""


def arms(spark, sf):
    o, k = t(spark, sf, "orders"), F.col("o_orderkey")
    steps = F.when(k % 7 < 4, STEPS[0]).when(k % 7 < 6, STEPS[1]).otherwise(STEPS[2])
    config = F.format_string('{"arm": %d, "max_steps": %d}', F.floor(k / 3), steps)
    return o.select(
        k.alias("id"), F.col("o_orderpriority").alias("hypothesis"), F.when(F.col("o_orderstatus") == "O", "failed").otherwise("done").alias("status"), config.alias("config_json"), F.sha1(config).alias("config_hash"),
        F.col("o_orderdate").alias("created_at"), F.when(k % 13 != 0, F.col("o_totalprice")).alias("score"),
    )


@query(f"""WITH {CONFIG}, own AS (SELECT *, CASE steps WHEN 250 THEN 0 WHEN 1000 THEN 1 ELSE 2 END AS rung FROM led WHERE status = 'done' AND hypothesis = '1-URGENT'),
p AS (SELECT *, row_number() OVER (PARTITION BY rung ORDER BY score NULLS LAST, created_at, id) AS place, count(*) OVER (PARTITION BY rung) AS n FROM own WHERE rung < 2),
up AS (SELECT id, rung, place, '{{"arm": ' || id // 3 || ', "max_steps": ' || CASE rung WHEN 0 THEN 1000 ELSE 4000 END || '}}' AS config_json FROM p WHERE place <= greatest(1, n // 3))
SELECT id, CAST(rung AS INTEGER) AS rung, CAST(place AS INTEGER) AS place, config_json, sha1(config_json) AS config_hash FROM up WHERE config_json NOT IN (SELECT config_json FROM led)""")
def c8_promotions(spark, sf):
    return L.promotions(arms(spark, sf), "1-URGENT", STEPS, "score", 3)


@query("SELECT o_orderkey AS id, o_totalprice AS score FROM orders ORDER BY o_totalprice, o_orderdate, o_orderkey LIMIT 1")
def o2_best(spark, sf):
    return L.frontier(results(spark, sf), F.col("score"), 1, False, ("created_at", "id")).select("id", "score")


@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS score FROM orders WHERE o_orderpriority = '2-HIGH'")
def s16_scanned(spark, sf):
    return L.scanned(results(spark, sf), "2-HIGH").select("id", "status", "score")


@query("SELECT o_orderkey AS id, lower(o_orderpriority) || '-train-' || substr(sha1(CAST(o_custkey % 50 AS VARCHAR)), 1, 10) AS name FROM orders")
def f3_experiment_name(spark, sf):
    r = results(spark, sf)
    return r.select("id", L.experiment_name(F.col("hypothesis"), F.lit("train"), F.col("config_hash")).alias("name"))


@query("""SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'r' || p_size WHEN 1 THEN 'cur=' || p_name WHEN 2 THEN 'vocab=' || p_brand ELSE 'size' || p_size END AS said FROM part""")
def f2_coordinates(spark, sf):
    k = F.col("p_partkey") % 4
    key = F.when(k == 0, "lora.rank").when(k == 1, "curriculum.schedule").when(k == 2, "datagen.vocab_mode").otherwise("a.b.size")
    label = L.axis_label(key)
    value = F.when(k == 1, F.col("p_name")).when(k == 2, F.col("p_brand")).otherwise(F.col("p_size").cast("string"))
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(k.isin(0, 3), L.coordinate(label, value, True)).otherwise(L.coordinate(label, value, False)).alias("said"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 7 END AS rank, CASE WHEN p_size % 3 = 0 THEN 1 WHEN p_size % 2 = 0 THEN p_size ELSE NULL END AS merged,
  CASE WHEN p_size % 2 = 0 THEN 'a,rank' ELSE 'a' END AS unknown FROM part""")
def f14_settings(spark, sf):
    """Defaults, maps put over each other, and keys that no setting has."""
    rank, over = F.col("p_size").cast("int"), F.create_map(F.lit("rank"), F.lit(1))
    config = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("rank"), rank, F.lit("a"), F.lit(0), F.lit("lr"), F.lit(0))).otherwise(F.create_map(F.lit("lr"), F.lit(0), F.lit("a"), F.lit(0)))
    both = F.when(F.col("p_size") % 3 == 0, L.merged(config, over)).otherwise(config)
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), L.setting(config, "rank", F.lit(7)).alias("rank"), F.try_element_at(both, F.lit("rank")).alias("merged"), F.array_join(L.unknown_keys(config, ("lr",)), ",").alias("unknown"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y%m%dT%H%M%SZ') AS stamp, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00') AS iso, round(date_diff('hour', TIMESTAMP '1992-01-01', o_orderdate), 6) AS gone, round(100000.0 - date_diff('hour', TIMESTAMP '1992-01-01', o_orderdate), 6) AS remaining FROM orders")
def f21_stamps(spark, sf):
    at = F.col("o_orderdate")
    gone, rest = parsing.hours_left(F.lit("1992-01-01").cast("timestamp_ntz"), at, 100000.0)
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), parsing.stamp(at).alias("stamp"), parsing.stamp(at, "iso").alias("iso"), F.round(gone, 6).alias("gone"), F.round(rest, 6).alias("remaining"))


def one_of(forms: tuple[str, ...], share: str) -> str:
    return f"CASE CAST(least({len(forms)}, floor({share} * {len(forms)}) + 1) AS INTEGER) " + " ".join(f"WHEN {i + 1} THEN '{x}'" for i, x in enumerate(forms)) + " END"


@query(f"""WITH d AS (SELECT p_partkey AS id, p_name AS category, CASE WHEN p_size % 5 > 0 THEN p_brand END AS other, (p_partkey * 37 % 1000) / 1000.0::DOUBLE AS x FROM part), f AS (
  SELECT *, CASE WHEN other IS NOT NULL AND x < 0.4 THEN {one_of(parsing.RELATIONS, '(x / 0.4::DOUBLE)')} ELSE {one_of(parsing.QUERIES, 'greatest(CASE WHEN other IS NOT NULL THEN (x - 0.4::DOUBLE) / 0.6::DOUBLE ELSE x END, 0.0::DOUBLE)')} END AS form FROM d)
SELECT id, CASE WHEN other IS NOT NULL AND x < 0.4 THEN replace(replace(form, '{{category}}', category), '{{other}}', other) ELSE replace(form, '{{category}}', category) END AS query FROM f""")
def f1_queries(spark, sf):
    other = F.when(F.col("p_size") % 5 > 0, F.col("p_brand"))
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), parsing.generated_query(F.col("p_name"), other, (F.col("p_partkey") * 37 % 1000) / 1000.0).alias("query"))


@query("""SELECT p_partkey AS id, 'Locate the object described as: ''' || p_name || '''. Respond with ONLY a JSON object of the form {"bbox_2d": [x_min, y_min, x_max, y_max]} using pixel coordinates in the ' || (p_size * 10) || 'x' || (p_size * 7) || ' image.' AS prompt FROM part""")
def e6_prompts(spark, sf):
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), parsing.prompt(F.col("p_name"), F.col("p_size") * 10, F.col("p_size") * 7).alias("prompt"))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN p_name ELSE 'Geometric context: ' || p_brand || printf(' Estimated distance: %.2f m.', p_retailprice / 1000 + 1e-11::DOUBLE) || chr(10) || p_name END AS prompt FROM part")
def e7_context(spark, sf):
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), parsing.with_context(F.col("p_name"), F.when(F.col("p_size") % 4 != 0, F.col("p_brand")), F.col("p_retailprice") / 1000 + TIE).alias("prompt"))


@query("SELECT DISTINCT split_part(list_extract(string_split(url, '/'), -1), '.', 1) AS stem FROM pages")
def f6_stems(spark, sf):
    return t(spark, sf, "pages").select(parsing.stem(F.col("url")).alias("stem")).distinct()


@query("SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'OFF' || chr(10) || p_size || ' 1 0' ELSE 'OFF' || chr(10) || p_size || ' 2 0' END AS text FROM part")
def f8_off_headers(spark, sf):
    k = F.col("p_size")
    said = F.when(k % 3 == 0, F.format_string("﻿ OFF%d 1 0", k)).when(k % 3 == 1, F.format_string("OFF  %d 2 0", k)).otherwise(F.format_string("OFF\n%d 2 0", k))
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), parsing.repaired_off(said).alias("text"))


@query("""WITH g AS (SELECT conv_id, list(coalesce(length(text), 0) ORDER BY turn, text) AS ids, min(turn) + 1 AS plen FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_transform(ids, lambda x, i: CASE WHEN i <= plen OR x = 0 THEN -100 ELSE x END), ',') AS labels FROM g""")
def e10_masked_labels(spark, sf):
    c = t(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n")))), lambda x: x["n"]).alias("ids"), (F.min("turn") + 1).alias("plen"))
    return c.select("conv_id", F.array_join(training.masked_labels(F.col("ids"), F.col("plen"), 0).cast("array<string>"), ",").alias("labels"))


@query(f"SELECT CAST(e AS INTEGER) AS epoch, round(0.001::DOUBLE * CASE WHEN e < 5 THEN 0.1 + 0.9::DOUBLE * e / 5 ELSE (1 + cos({math.pi!r}::DOUBLE * (e - 5) / 115)) / 2 END, 10) AS rate FROM range(120) r(e)")
def w11_rates(spark, sf):
    return spark.range(120).select(F.col("id").cast("int").alias("epoch"), F.round(training.rate(F.col("id")), 10).alias("rate"))


@query("SELECT user_id % 10 AS epoch, round(coalesce(sum(CASE WHEN event_type <> 'error' THEN value END), 0.0) / greatest(count(CASE WHEN event_type <> 'error' THEN value END), 1), 6) AS loss FROM events GROUP BY 1")
def a32_mean_loss(spark, sf):
    return t(spark, sf, "events").groupBy((F.col("user_id") % 10).alias("epoch")).agg(F.round(training.mean_loss(F.when(F.col("event_type") != "error", F.col("value"))), 6).alias("loss"))


@query("SELECT round(count(*) FILTER (WHERE toxic = 1 - quality) / CAST(greatest(count(*), 1) AS DOUBLE), 6) AS accuracy FROM labels")
def e11_accuracy(spark, sf):
    return t(spark, sf, "labels").agg(F.round(training.accuracy(F.col("toxic"), 1 - F.col("quality")), 6).alias("accuracy"))


SHARDS = 5
TURNS = ", ".join(f"({e}, {int(s)}, {k})" for e in range(3) for k, s in enumerate(np.random.default_rng(4 + e).permutation(SHARDS)))


@query(f"""WITH own AS (SELECT p_partkey AS id, p_partkey % {SHARDS} AS shard FROM part WHERE p_size % 3 > 0), turns(epoch, shard, turn) AS (VALUES {TURNS}),
o AS (SELECT epoch, id, row_number() OVER (ORDER BY epoch, turn, id) - 1 AS "at" FROM own JOIN turns USING (shard)) SELECT epoch, id, "at" FROM o WHERE "at" >= 17""")
def s9_epochs(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % SHARDS).alias("shard"), F.col("p_partkey").alias("pos"), F.when(F.col("p_size") % 3 == 0, "heldout").when(F.col("p_size") % 3 == 1, "train").alias("split"))
    return training.epochs(p, 3, 4, "train", 17).select("epoch", "id", "at")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS r FROM events) WHERE r > 100")
def w8_resumed(spark, sf):
    return training.resumed(t(spark, sf, "events"), ["event_id"], 100).select("event_id")


@query("SELECT name, r FROM (SELECT 'step_' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS name, row_number() OVER (ORDER BY event_id DESC) AS r0, CAST(event_id AS BIGINT) AS r FROM events) WHERE r0 <= 3 OR name = 'step_000000007'")
def o6_kept(spark, sf):
    dirs = t(spark, sf, "events").select(F.concat(F.lit("step_"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("name"), F.col("event_id").alias("r"))
    return L.kept_checkpoints(dirs, 3, "step_000000007")


@query("SELECT time_bucket(INTERVAL 60 SECONDS, ts, TIMESTAMP '1970-01-01') AS at, count(value) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY 1")
def t7_sampled(spark, sf):
    return guard.sampled(t(spark, sf, "events"), "ts", "value").select("at", "n", *r6("mean"), "most")


@query("""SELECT c_custkey AS session_id, c_custkey || printf(': %.1f min, exit %d, changed %s, done %s, stale %s, GPU %s, %.1f h left', CAST(c_custkey % 60 AS DOUBLE), CAST(c_nationkey AS INTEGER), CASE WHEN c_nationkey % 2 = 0 THEN 'a, b' ELSE 'none' END,
  CASE WHEN c_nationkey % 3 = 0 THEN c_name ELSE 'none' END, 'none', CASE WHEN c_nationkey % 4 = 0 THEN 'n/a' ELSE printf('%.1f%%', CAST(c_nationkey AS DOUBLE)) END, CAST(24 - c_nationkey AS DOUBLE)) AS line FROM customer""")
def k12_session_lines(spark, sf):
    n = F.col("c_nationkey")
    some = lambda c, *x: F.when(c, F.array(*x)).otherwise(F.array().cast("array<string>"))
    s = t(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("session_id"), (F.col("c_custkey") % 60).cast("double").alias("elapsed_minutes"), n.alias("exit_code"), some(n % 2 == 0, F.lit("a"), F.lit("b")).alias("changed"),
        some(n % 3 == 0, F.col("c_name")).alias("done"), F.array().cast("array<string>").alias("stale"), F.when(n % 4 != 0, n.cast("double")).alias("util"), (24.0 - n).alias("hours_left"),
    )
    return sinks.session_lines(s).select(F.col("session_id").cast("long").alias("session_id"), "line")
