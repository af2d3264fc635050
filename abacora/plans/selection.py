"""Queries that choose, merge and report on items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import selection as S
from ..sources.files import catalogue_verdicts, multiset_digest
from ..views import SEED, Views
from .registry import query

_COLUMNS = ("item_id", "topic_id", "grade", "level", "source_id", "item_hash")
_LIST = ", ".join(_COLUMNS)


@query(f"""SELECT {_LIST} FROM v_item i WHERE eligible AND active AND NOT EXISTS (SELECT 1 FROM v_exposure e WHERE e.user_id = 1 AND e.item_id = i.item_id)
AND NOT EXISTS (SELECT 1 FROM v_attempt a JOIN v_answer r USING (attempt_id) WHERE a.user_id = 1 AND r.item_hash = i.item_hash)""")
def anti_unseen_pool(v: Views):
    seen = v.exposure.where("user_id = 1")
    hashes = v.attempt.where("user_id = 1").join(v.answer_unnumbered, "attempt_id")
    return S.unseen(S.unseen(v.item.where("eligible AND active"), seen, "item_id"), hashes, "item_hash").select(*_COLUMNS)


@query(f"SELECT {_LIST} FROM v_item i WHERE source_id IS NULL OR NOT EXISTS (SELECT 1 FROM v_attempt a JOIN v_answer r USING (attempt_id) WHERE a.user_id = 1 AND r.source_id = i.source_id)")
def anti_null_tolerant(v: Views):
    return S.unseen_sources(v.item, v.attempt.where("user_id = 1").join(v.answer_unnumbered, "attempt_id")).select(*_COLUMNS)


@query(f"SELECT {_LIST} FROM v_item WHERE item_id NOT IN (1, 2, 3, 5, 8) AND (source_id IS NULL OR source_id NOT IN ('S1', 'S2')) AND topic_id NOT IN ('Brand#1')")
def anti_literal_lists(v: Views):
    return S.excluding(v.item, item_id=[1, 2, 3, 5, 8], source_id=["S1", "S2"], topic_id=["Brand#1"]).select(*_COLUMNS)


@query(f"SELECT item_id, topic_id FROM v_item WHERE active ORDER BY sha256('{SEED}|' || CAST(item_id AS VARCHAR)), item_id LIMIT 25")
def seeded_sample(v: Views):
    return S.hash_sample(v.item.where("active"), "item_id", SEED, 25).select("item_id", "topic_id")


@query(f"SELECT topic_id, item_id, pick FROM (SELECT topic_id, item_id, row_number() OVER (PARTITION BY topic_id ORDER BY sha256('{SEED}|' || CAST(item_id AS VARCHAR)), item_id) AS pick FROM v_item) WHERE pick <= 10")
def hash_order_sample(v: Views):
    return S.hash_sample(v.item, "item_id", SEED, 10, "topic_id").select("topic_id", "item_id", "pick")


@query(f"""SELECT item_id, race FROM (SELECT item_id, round(-ln((CAST(('0x' || substr(sha256('{SEED}|' || CAST(item_id AS VARCHAR)), 1, 8)) AS BIGINT) + 1.0) / 4294967297.0) / (1 + level), 6) AS race FROM v_item) ORDER BY race, item_id LIMIT 25""")
def weighted_sample_es(v: Views):
    return S.weighted_sample(v.item.withColumn("weight", 1 + F.col("level")), "item_id", "weight", SEED, 25).select("item_id", "race")


@query("""SELECT item_id, item_hash FROM v_item i WHERE NOT EXISTS (SELECT 1 FROM v_item s WHERE s.item_id % 3 <> 0 AND s.item_id = i.item_id AND (CASE WHEN s.item_id % 7 = 0 THEN 'changed' ELSE s.item_hash END) = i.item_hash)""")
def upsert_pending_only(v: Views):
    stored = v.item.where("item_id % 3 <> 0").select("item_id", F.when(F.col("item_id") % 7 == 0, "changed").otherwise(F.col("item_hash")).alias("item_hash"))
    return S.upsert_pending(v.item.select("item_id", "item_hash"), stored, "item_id", "item_hash")


@query("""WITH b AS (SELECT topic_name, item_id, topic_id, eligible, active, CASE WHEN item_id % 2 = 0 THEN 0 ELSE 1 END AS new FROM v_item),
f AS (SELECT topic_name, bool_or(eligible) AS eligible, bool_or(active) AS active FROM b GROUP BY topic_name),
k AS (SELECT topic_name, item_id, topic_id FROM (SELECT *, row_number() OVER (PARTITION BY topic_name ORDER BY new, item_id, topic_id) AS n FROM b) WHERE n = 1)
SELECT topic_name, item_id, topic_id, eligible, active FROM k JOIN f USING (topic_name)""")
def pool_upsert_merge(v: Views):
    rows = v.item.select("topic_name", "item_id", "topic_id", "eligible", "active")
    return S.pool_upsert(rows.where("item_id % 2 = 0"), rows.where("item_id % 2 = 1"), "topic_name", ("eligible", "active"))


@query("""WITH g AS (SELECT topic_id, level FROM (SELECT DISTINCT topic_id FROM v_item) CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5, 6]) AS level)), h AS (SELECT topic_id, level, count(*) AS have FROM v_item GROUP BY topic_id, level)
SELECT topic_id, level, coalesce(have, 0) AS n_items, coalesce(have, 0) < 21 AS short FROM g LEFT JOIN h USING (topic_id, level)""")
def bucket_gap_report(v: Views):
    levels = v.spark.range(1, 7).select(F.col("id").cast("int").alias("level"))
    return S.bucket_gaps(v.item, v.item, levels)


@query("SELECT grade, topic_id, level, count(*) AS n, CAST(sum(CASE WHEN eligible THEN 1 ELSE 0 END) AS BIGINT) AS n_eligible, CAST(sum(CASE WHEN active THEN 1 ELSE 0 END) AS BIGINT) AS n_active FROM v_item GROUP BY grade, topic_id, level")
def pool_status_counts(v: Views):
    return v.item.groupBy("grade", "topic_id", "level").agg(F.count("*").alias("n"), F.count_if("eligible").alias("n_eligible"), F.count_if("active").alias("n_active"))


@query("SELECT topic_name, topic_id, item_id FROM (SELECT topic_name, topic_id, item_id, row_number() OVER (PARTITION BY topic_name ORDER BY item_id) AS n FROM v_item) WHERE n = 1")
def dedup_exact_first(v: Views):
    return S.first_by(v.item.select("topic_name", "topic_id", "item_id"), ["topic_name"], ["item_id"])


@query("""WITH u AS (SELECT grade, topic_id, topic_name, 0 AS priority, item_id FROM v_item WHERE active UNION ALL SELECT grade, topic_id, topic_name, 1, item_id FROM v_item WHERE NOT active)
SELECT grade, topic_id, topic_name, priority FROM (SELECT *, row_number() OVER (PARTITION BY grade, topic_id ORDER BY priority, item_id) AS n FROM u) WHERE n = 1""")
def union_distinct_priority(v: Views):
    u = v.item.where("active").withColumn("priority", F.lit(0)).unionByName(v.item.where("NOT active").withColumn("priority", F.lit(1)))
    return S.first_by(u, ["grade", "topic_id"], ["priority", "item_id"]).select("grade", "topic_id", "topic_name", "priority")


@query("SELECT topic_name FROM v_item EXCEPT SELECT topic_name FROM v_item WHERE item_id % 5 = 0 AND active")
def set_except(v: Views):
    return v.item.select("topic_name").subtract(v.item.where("item_id % 5 = 0 AND active").select("topic_name"))


@query("""WITH l AS (SELECT DISTINCT topic_name FROM v_item WHERE item_id % 25 = 1), r AS (SELECT DISTINCT topic_name FROM v_item WHERE item_id % 25 = 2)
SELECT topic_name, 'missing' AS side FROM l WHERE topic_name NOT IN (SELECT topic_name FROM r) UNION ALL SELECT topic_name, 'unexpected' FROM r WHERE topic_name NOT IN (SELECT topic_name FROM l)""")
def set_symmetric_diff(v: Views):
    a, b = (v.item.where(f"item_id % 25 = {k}").select("topic_name").distinct() for k in (1, 2))
    return a.join(b, "topic_name", "left_anti").withColumn("side", F.lit("missing")).union(b.join(a, "topic_name", "left_anti").withColumn("side", F.lit("unexpected")))


@query("SELECT topic_name FROM v_item WHERE grade = 7 INTERSECT SELECT topic_name FROM v_item WHERE grade = 8")
def set_intersect(v: Views):
    return v.item.where("grade = 7").select("topic_name").intersect(v.item.where("grade = 8").select("topic_name"))


@query("SELECT topic_name, count(*) AS n FROM v_item GROUP BY topic_name HAVING count(*) > 1")
def having_duplicates(v: Views):
    return v.item.groupBy("topic_name").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT p_brand, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY p_brand")
def agg_collect_set(v: Views):
    return v.table("part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("types"))


@query("SELECT grade FROM (SELECT unnest([5, 6, 7, 8, 9, 10, 11, 12]) AS grade) WHERE grade NOT IN (SELECT grade FROM v_item)")
def coverage_missing_groups(v: Views):
    required = v.spark.range(5, 13).select(F.col("id").cast("int").alias("grade"))
    return required.join(v.item.select("grade").distinct(), "grade", "left_anti")


_PIECES = " || '|' || ".join(f"CAST(sum(CAST(('0x' || substr(item_hash, {12 * i + 1}, 12)) AS BIGINT)) AS VARCHAR)" for i in range(5))


@query(f"SELECT sha256(CAST(count(*) AS VARCHAR) || '|' || {_PIECES}) AS fingerprint, count(*) AS n FROM v_item")
def table_fingerprint(v: Views):
    return v.item.agg(multiset_digest(F.col("item_hash")).alias("fingerprint"), F.count("*").alias("n"))


@query("""WITH d AS (SELECT topic_id, grade, topic_name, min(item_id) AS ord FROM v_item GROUP BY topic_id, grade, topic_name)
SELECT topic_id, grade, topic_name, place FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY ord) AS place FROM d) WHERE place <= 6""")
def topk_distinct_plan(v: Views):
    first = v.item.groupBy("topic_id", "grade", "topic_name").agg(F.min("item_id").alias("ord"))
    w = Window.partitionBy("topic_id").orderBy("ord")
    return first.withColumn("place", F.row_number().over(w)).where("place <= 6").select("topic_id", "grade", "topic_name", "place")


@query("SELECT topic_name, grade, string_agg(DISTINCT topic_id, ',' ORDER BY topic_id) AS subtopics FROM v_item GROUP BY topic_name, grade")
def nested_catalog(v: Views):
    return v.item.groupBy("topic_name", "grade").agg(F.array_join(F.array_sort(F.collect_set("topic_id")), ",").alias("subtopics"))


@query("SELECT n_nationkey, n_name, coalesce(names, '') AS suppliers FROM nation LEFT JOIN (SELECT s_nationkey, string_agg(s_name, ',' ORDER BY s_name) AS names FROM supplier GROUP BY s_nationkey) ON n_nationkey = s_nationkey")
def lookup_collect_list(v: Views):
    names = v.table("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_join(F.array_sort(F.collect_list("s_name")), ",").alias("names"))
    return v.table("nation").select("n_nationkey", "n_name").join(names, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("names", F.lit("")).alias("suppliers"))


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def level_lookup(v: Views):
    names = v.table("nation").join(v.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "r_name")
    return v.table("supplier").join(names, "s_nationkey", "left").select("s_suppkey", "s_name", "n_name", "r_name")


@query("""WITH c AS (SELECT lower(trim(topic_name)) AS norm, grade, min(topic_id) AS canonical FROM v_item WHERE active GROUP BY lower(trim(topic_name)), grade)
SELECT DISTINCT i.grade, coalesce(c.canonical, i.topic_id) AS topic_id, i.topic_name FROM v_item i LEFT JOIN c ON c.grade = i.grade AND c.norm = lower(trim(i.topic_name))""")
def canonicalise_left_join(v: Views):
    norm = F.lower(F.trim("topic_name")).alias("norm")
    c = v.item.where("active").groupBy("grade", norm).agg(F.min("topic_id").alias("canonical"))
    return v.item.withColumn("norm", F.lower(F.trim("topic_name"))).join(c, ["grade", "norm"], "left").select("grade", F.coalesce("canonical", "topic_id").alias("topic_id"), "topic_name").distinct()


@query("""WITH r AS (SELECT p_partkey % 100 AS ref_id, p_partkey AS ord, p_name AS ref FROM part), l AS (SELECT ref_id, arg_max(ref, ord) AS ref FROM r GROUP BY ref_id)
SELECT s_suppkey, ref FROM supplier LEFT JOIN l ON s_suppkey = ref_id""")
def attach_refs(v: Views):
    last = v.table("part").groupBy((F.col("p_partkey") % 100).alias("s_suppkey")).agg(F.max_by("p_name", "p_partkey").alias("ref"))
    return v.table("supplier").select("s_suppkey").join(last, "s_suppkey", "left")


@query("SELECT status, count(*) AS n FROM (SELECT CASE WHEN s.s_suppkey IS NULL THEN 'missing' WHEN p_size % 2 = 0 THEN 'accepted' ELSE 'held' END AS status FROM part LEFT JOIN supplier s ON s.s_suppkey = p_partkey) GROUP BY status")
def import_audit_counts(v: Views):
    known = v.table("supplier").select(F.col("s_suppkey").alias("p_partkey"), F.lit(True).alias("known"))
    status = F.when(F.col("known").isNull(), "missing").when(F.col("p_size") % 2 == 0, "accepted").otherwise("held")
    return v.table("part").join(known, "p_partkey", "left").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


_BANK = """WITH b AS (SELECT p_partkey AS ord, 'q' || CAST(p_partkey % 1900 AS VARCHAR) AS question_id, p_name || '  ' || CAST(p_partkey % 700 AS VARCHAR) AS question, 'c' || CAST(p_partkey % 28 AS VARCHAR) AS concept_id,
CASE WHEN p_partkey % 9 = 0 THEN 'other' ELSE ' nation_' || CAST(p_partkey % 28 AS VARCHAR) END AS concept_name, CAST(6 + p_partkey % 28 % 6 + CASE WHEN p_partkey % 11 = 0 THEN 1 ELSE 0 END AS INTEGER) AS grade, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(p_partkey % 4 AS VARCHAR) END AS level FROM part),
c AS (SELECT 'c' || CAST(n_nationkey AS VARCHAR) AS concept_id, lower(n_name) AS name, CAST(6 + n_nationkey % 6 AS INTEGER) AS g, CASE WHEN n_nationkey % 3 = 0 THEN [] ELSE ['1', '2'] END AS levels FROM nation),
i AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY ord) AS nid, regexp_replace(lower(question), '\\s+', ' ', 'g') AS t FROM b), x AS (SELECT *, CASE WHEN nid = 1 THEN row_number() OVER (PARTITION BY t, nid = 1 ORDER BY ord) END AS nt FROM i)"""


@query(f"""{_BANK} SELECT ord, question_id, CASE WHEN nid > 1 THEN 'duplicate question_id' WHEN nt > 1 THEN 'duplicate text' WHEN name IS NULL THEN 'unknown concept_id' WHEN grade <> g THEN 'another grade than the concept''s'
WHEN trim(concept_name) <> name THEN 'another name than the concept''s' WHEN level <> '' AND len(levels) > 0 AND NOT list_contains(levels, level) THEN 'a level that the concept does not have' ELSE 'valid' END AS verdict FROM x LEFT JOIN c USING (concept_id)""")
def bank_referential_errors(v: Views):
    """A bank against its catalogue, the first failing rule of each record."""
    n, text = F.col("p_partkey"), lambda c: c.cast("string")
    bank = v.table("part").select(
        n.alias("ord"), F.concat(F.lit("q"), text(n % 1900)).alias("question_id"), F.concat("p_name", F.lit("  "), text(n % 700)).alias("question"), F.concat(F.lit("c"), text(n % 28)).alias("concept_id"),
        F.when(n % 9 == 0, "other").otherwise(F.concat(F.lit(" nation_"), text(n % 28))).alias("concept_name"), (6 + n % 28 % 6 + F.when(n % 11 == 0, 1).otherwise(0)).cast("int").alias("grade"), F.when(n % 5 == 0, "").otherwise(text(n % 4)).alias("competency_level"),
    )
    key = F.col("n_nationkey")
    levels = F.when(key % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("1"), F.lit("2")))
    catalogue = v.table("nation").select(F.concat(F.lit("c"), text(key)).alias("concept_id"), F.col("n_name").alias("name"), (6 + key % 6).cast("int").alias("grade"), levels.alias("competency_levels"))
    return catalogue_verdicts(bank, catalogue)


@query("""WITH b AS (SELECT item_id, item_id % 1500 AS rec, topic_name, grade FROM v_item), d AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY item_id) AS nid FROM b),
t AS (SELECT *, row_number() OVER (PARTITION BY topic_name, grade ORDER BY item_id) AS ntext FROM d WHERE nid = 1)
SELECT item_id, 'duplicate id' AS error FROM d WHERE nid > 1 UNION ALL SELECT item_id, 'duplicate text' FROM t WHERE ntext > 1""")
def bank_duplicates(v: Views):
    rows = v.item.select("item_id", (F.col("item_id") % 1500).alias("rec"), "topic_name", "grade")
    ids = rows.withColumn("n", F.row_number().over(Window.partitionBy("rec").orderBy("item_id")))
    texts = ids.where("n = 1").withColumn("m", F.row_number().over(Window.partitionBy("topic_name", "grade").orderBy("item_id")))
    return ids.where("n > 1").select("item_id", F.lit("duplicate id").alias("error")).union(texts.where("m > 1").select("item_id", F.lit("duplicate text")))


@query("SELECT count(*) AS n_records, count(DISTINCT topic_id) AS n_concepts, CAST(sum(CASE WHEN source_id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_without_source, min(grade) AS low_grade, max(grade) AS high_grade FROM v_item")
def bank_summary(v: Views):
    return v.item.agg(F.count("*").alias("n_records"), F.countDistinct("topic_id").alias("n_concepts"), F.count_if(F.col("source_id").isNull()).alias("n_without_source"), F.min("grade").alias("low_grade"), F.max("grade").alias("high_grade"))


@query("SELECT item_id, topic_id, topic_name, level FROM v_item WHERE grade = 8 AND active")
def scan_partition_filter(v: Views):
    return v.item.where("grade = 8 AND active").select("item_id", "topic_id", "topic_name", "level")


@query("SELECT attempt_id, user_id FROM v_attempt WHERE quiz_kind = 'practice' ORDER BY attempt_id DESC LIMIT 100")
def scan_filter_project(v: Views):
    return v.attempt.where("quiz_kind = 'practice'").select("attempt_id", "user_id").orderBy(F.desc("attempt_id")).limit(100)


@query("SELECT item_id, topic_name, grade, level FROM v_item")
def public_projection(v: Views):
    return v.item.select("item_id", "topic_name", "grade", "level")


@query("""WITH r AS (SELECT item_id, topic_id, level, eligible, row_number() OVER (PARTITION BY topic_id, level ORDER BY item_id) AS n FROM v_item WHERE active AND eligible AND level IN (3, 4, 5))
SELECT item_id, topic_id, level, n FROM r WHERE n <= 3""")
def readmit_with_caps(v: Views):
    w = Window.partitionBy("topic_id", "level").orderBy("item_id")
    return v.item.where("active AND eligible AND level IN (3, 4, 5)").withColumn("n", F.row_number().over(w)).where("n <= 3").select("item_id", "topic_id", "level", "n")


@query("SELECT attempt_id, bool_and(source_id IS NOT NULL AND level >= 2) AS valid FROM v_answer GROUP BY attempt_id")
def paper_all_valid(v: Views):
    return v.answer_unnumbered.groupBy("attempt_id").agg(F.bool_and(F.col("source_id").isNotNull() & (F.col("level") >= 2)).alias("valid"))


@query("""SELECT item_id, topic_id, least(6, greatest(2, level)) AS clamped FROM v_item""")
def clamp(v: Views):
    return v.item.select("item_id", "topic_id", F.least(F.lit(6), F.greatest(F.lit(2), "level")).alias("clamped"))


@query("""WITH n AS (SELECT topic_id, item_id, row_number() OVER (PARTITION BY topic_id ORDER BY sha256('""" + SEED + """|' || CAST(item_id AS VARCHAR)), item_id) AS rn FROM v_item)
SELECT topic_id, item_id, (rn - 1) % 4 AS position, CAST(floor((rn - 1) / 5) AS BIGINT) AS batch FROM n""")
def batch_slices(v: Views):
    order = F.sha2(F.concat_ws("|", F.lit(SEED), F.col("item_id").cast("string")), 256)
    rn = F.row_number().over(Window.partitionBy("topic_id").orderBy(order, "item_id"))
    return v.item.select("topic_id", "item_id", rn.alias("rn")).select("topic_id", "item_id", ((F.col("rn") - 1) % 4).cast("long").alias("position"), F.floor((F.col("rn") - 1) / 5).alias("batch"))


@query("""WITH n AS (SELECT topic_id, item_id, row_number() OVER (PARTITION BY topic_id ORDER BY sha256('""" + SEED + """|' || CAST(item_id AS VARCHAR)), item_id) AS rn FROM v_item),
c AS (SELECT topic_id, (rn - 1) % 4 AS p, count(*) AS c FROM n GROUP BY topic_id, (rn - 1) % 4)
SELECT topic_id, CAST(sum(c) AS BIGINT) AS n, max(c) - min(c) <= 1 AS balanced FROM c GROUP BY topic_id""")
def balanced_positions(v: Views):
    placed = batch_slices(v).groupBy("topic_id", "position").agg(F.count("*").alias("c"))
    return placed.groupBy("topic_id").agg(F.sum("c").alias("n"), ((F.max("c") - F.min("c")) <= 1).alias("balanced"))
