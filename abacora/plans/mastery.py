"""Queries on attempts, mistakes, progress, streaks and badges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gamify as G
from ..operators import mastery as M
from ..operators import selection as S
from ..views import AS_OF, Views
from .registry import query

_WRONG = "v_attempt JOIN v_answer USING (attempt_id) WHERE NOT is_correct"


@query(f"""WITH m AS (SELECT topic_id, level, count(*) AS n_mistakes FROM {_WRONG} GROUP BY topic_id, level),
t AS (SELECT topic_id, CAST(sum(n_mistakes) AS BIGINT) AS topic_mistakes FROM m GROUP BY topic_id ORDER BY topic_mistakes DESC, topic_id LIMIT 5),
r AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY n_mistakes DESC, level) AS rank FROM m)
SELECT topic_id, topic_mistakes, level, n_mistakes, rank FROM r JOIN t USING (topic_id) WHERE rank <= 3""")
def recommend_core(v: Views):
    return M.recommend_core(v.attempt, v.answer_unnumbered)


@query("SELECT attempt_id, question_index, user_id, item_id, topic_id, level FROM v_attempt JOIN v_answer USING (attempt_id) WHERE NOT is_correct")
def join_mistakes(v: Views):
    return M.mistakes(v.attempt, v.answer).select("attempt_id", "question_index", "user_id", "item_id", "topic_id", "level")


@query(f"SELECT topic_id, count(*) AS n_mistakes FROM {_WRONG} GROUP BY topic_id")
def agg_mistakes_by_topic(v: Views):
    return M.mistakes_by(M.mistakes(v.attempt, v.answer_unnumbered), "topic_id")


@query(f"SELECT level, count(*) AS n_mistakes FROM {_WRONG} GROUP BY level")
def agg_mistakes_by_level(v: Views):
    return M.mistakes_by(M.mistakes(v.attempt, v.answer_unnumbered), "level")


@query(f"SELECT topic_id, level, count(*) AS n_mistakes FROM {_WRONG} GROUP BY topic_id, level")
def agg_topic_level(v: Views):
    return M.mistakes_by(M.mistakes(v.attempt, v.answer_unnumbered), "topic_id", "level")


@query(f"SELECT topic_id, count(*) AS n_mistakes FROM {_WRONG} GROUP BY topic_id ORDER BY n_mistakes DESC, topic_id LIMIT 5")
def topk_weakest_topics(v: Views):
    return M.weakest(M.mistakes(v.attempt, v.answer_unnumbered))


@query(f"""WITH m AS (SELECT topic_id, level, count(*) AS n_mistakes FROM {_WRONG} GROUP BY topic_id, level)
SELECT * FROM (SELECT topic_id, level, n_mistakes, row_number() OVER (PARTITION BY topic_id ORDER BY n_mistakes DESC, level) AS rank FROM m) WHERE rank <= 3""")
def topk_levels_per_topic(v: Views):
    counts = M.mistakes_by(M.mistakes(v.attempt, v.answer_unnumbered), "topic_id", "level")
    return M.ranked_within(counts, "topic_id", "level", "n_mistakes", 3).select("topic_id", "level", "n_mistakes", "rank")


@query("SELECT user_id, string_agg(CAST(CAST(score * 10 AS BIGINT) AS VARCHAR), ',' ORDER BY created_at, attempt_id) AS trend FROM v_score GROUP BY user_id")
def agg_score_trend(v: Views):
    tenths = F.transform("trend", lambda x: F.rint(x * 10).cast("long").cast("string"))  # halves to even, as SQL casts
    return M.score_trend(v.score).select("user_id", F.array_join(tenths, ",").alias("trend"))


@query("SELECT attempt_id, user_id, total, correct, total - correct AS incorrect, score FROM v_score")
def score_attempts(v: Views):
    return v.score.select("attempt_id", "user_id", "total", "correct", (F.col("total") - F.col("correct")).alias("incorrect"), "score")


@query("SELECT user_id, count(*) AS n_attempts, CAST(sum(CASE WHEN quiz_kind = 'diagnostic' THEN 1 ELSE 0 END) AS BIGINT) AS n_kind, coalesce(max(attempt_id), 0) AS latest_attempt_id FROM v_attempt GROUP BY user_id")
def agg_user_counts(v: Views):
    return M.user_counts(v.attempt)


@query("""WITH h AS (SELECT user_id, topic_id, attempt_id, level, is_correct, dense_rank() OVER (PARTITION BY user_id, topic_id ORDER BY attempt_id DESC) AS back FROM v_attempt JOIN v_answer USING (attempt_id)),
a AS (SELECT user_id, topic_id, attempt_id, back, avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END) AS acc,
  avg(CASE WHEN level >= 3 THEN CASE WHEN is_correct THEN 1.0 ELSE 0.0 END END) AS a4, avg(CASE WHEN level >= 4 THEN CASE WHEN is_correct THEN 1.0 ELSE 0.0 END END) AS a5
  FROM h WHERE back <= 2 GROUP BY user_id, topic_id, attempt_id, back),
b AS (SELECT user_id, topic_id, max(CASE WHEN back = 1 THEN acc END) AS latest, count(*) = 2 AND bool_and(acc >= 0.8 AND coalesce(a4 >= 0.8, false)) AS ok4, count(*) = 2 AND bool_and(acc >= 0.8 AND coalesce(a5 >= 0.8, false)) AS ok5 FROM a GROUP BY user_id, topic_id)
SELECT user_id, topic_id, round(latest, 6) AS latest_accuracy, CASE WHEN ok5 THEN 5 WHEN ok4 THEN 4 ELSE 3 END AS next_level FROM b""")
def topic_progress(v: Views):
    return M.topic_progress(v.attempt.select("attempt_id", "user_id").join(v.answer_unnumbered, "attempt_id"))


@query("""SELECT * FROM (SELECT topic_id, attempt_id, question_index, is_correct, row_number() OVER (PARTITION BY topic_id ORDER BY attempt_id DESC, question_index DESC) AS topic_position FROM v_answer) WHERE topic_position <= 50""")
def win_last50_per_topic(v: Views):
    return M.last_per_topic(v.answer).select("topic_id", "attempt_id", "question_index", "is_correct", "topic_position")


@query("SELECT user_id, attempt_id, dense_rank() OVER (PARTITION BY user_id ORDER BY attempt_id) AS attempt_number FROM (SELECT DISTINCT user_id, attempt_id FROM v_attempt JOIN v_answer USING (attempt_id))")
def win_attempt_number(v: Views):
    return M.attempt_numbers(v.attempt.join(v.table("lineitem").select(F.col("l_orderkey").alias("attempt_id")), "attempt_id", "left_semi"))


@query("SELECT user_id, attempt_id, count(*) OVER (PARTITION BY user_id) - row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, attempt_id DESC) + 1 AS number FROM v_attempt")
def win_reverse_number(v: Views):
    return M.history_listing(v.attempt)


@query("SELECT user_id, attempt_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, attempt_id DESC) AS n FROM v_attempt) WHERE n = 1")
def latest_per_user(v: Views):
    return M.latest_attempt(v.attempt)


@query("SELECT user_id, round(avg(score), 4) AS mean_score, round(arg_max(score, (created_at, attempt_id)), 4) AS last_score FROM v_score GROUP BY user_id")
def dashboard_avg_last(v: Views):
    return M.averages(v.score)


_ISLANDS = """d AS (SELECT DISTINCT user_id, day FROM v_activity), r AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS n FROM d),
i AS (SELECT user_id, min(day) AS first_day, max(day) AS last_day, count(*) AS days FROM r GROUP BY user_id, day - CAST(n AS INTEGER))"""


@query(f"WITH {_ISLANDS} SELECT user_id, max(days) AS best_streak FROM i GROUP BY user_id")
def streak_best(v: Views):
    return G.best_streak(v.activity)


@query(f"WITH {_ISLANDS} SELECT user_id, CAST(max(CASE WHEN first_day <= DATE '{AS_OF}' AND last_day >= DATE '{AS_OF}' THEN DATE '{AS_OF}' - first_day + 1 ELSE 0 END) AS BIGINT) AS current_streak FROM i GROUP BY user_id")
def streak_current(v: Views):
    return G.current_streak(v.activity, AS_OF)


@query("WITH s AS (SELECT user_id, score - lag(score) OVER (PARTITION BY user_id ORDER BY created_at, attempt_id) AS gain FROM v_score) SELECT user_id, coalesce(bool_or(gain >= 20), false) AS comeback FROM s GROUP BY user_id")
def win_lag_comeback(v: Views):
    return G.comebacks(v.score)


_STATS = """SELECT user_id, count(*) AS n, CAST(sum(correct) AS BIGINT) AS total_correct, CAST(sum(CASE WHEN score >= 99.5 THEN 1 ELSE 0 END) AS BIGINT) AS perfect,
CAST(sum(CASE WHEN score >= 90 THEN 1 ELSE 0 END) AS BIGINT) AS high, bool_or(score >= 99.5 AND total >= 20) AS marathon, count(DISTINCT CAST(created_at AS DATE)) AS days FROM v_score GROUP BY user_id"""


@query(_STATS)
def gamification_stats(v: Views):
    return G.statistics(v.score)


@query("SELECT user_id, CAST(day AS VARCHAR) AS day, count(*) AS n FROM v_activity GROUP BY user_id, day")
def agg_by_day(v: Views):
    return G.daily(v.activity).withColumn("day", F.col("day").cast("string"))


_RULES = ", ".join(f"('{b}', {rule.replace('best_streak', 'bs').replace('comeback', 'cb')})" for b, rule in G.BADGES)


@query(f"""WITH st AS ({_STATS}), d AS (SELECT DISTINCT user_id, CAST(created_at AS DATE) AS day FROM v_score),
r AS (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS n FROM d),
bs AS (SELECT user_id, max(c) AS bs FROM (SELECT user_id, count(*) AS c FROM r GROUP BY user_id, day - CAST(n AS INTEGER)) GROUP BY user_id),
g AS (SELECT user_id, score - lag(score) OVER (PARTITION BY user_id ORDER BY created_at, attempt_id) AS gain FROM v_score),
cb AS (SELECT user_id, coalesce(bool_or(gain >= 20), false) AS cb FROM g GROUP BY user_id),
f AS (SELECT * FROM st JOIN bs USING (user_id) JOIN cb USING (user_id))
{" UNION ALL ".join(f"SELECT user_id, '{b}' AS badge, {rule.replace('best_streak', 'bs').replace('comeback', 'cb')} AS earned FROM f" for b, rule in G.BADGES)}""")
def badges_unpivot(v: Views):
    return G.badges(v.score)


@query("SELECT * FROM (SELECT item_id, topic_id, attempt_id, user_id FROM v_attempt JOIN v_answer USING (attempt_id) WHERE user_id = 1 ORDER BY attempt_id DESC, item_id LIMIT 500)")
def join_recent_stems(v: Views):
    rows = v.attempt.where("user_id = 1").join(v.answer_unnumbered, "attempt_id")
    return rows.orderBy(F.desc("attempt_id"), "item_id").limit(500).select("item_id", "topic_id", "attempt_id", "user_id")


@query("SELECT DISTINCT user_id, source_id FROM v_attempt JOIN v_answer USING (attempt_id) WHERE source_id IS NOT NULL")
def join_prior_sources(v: Views):
    return v.attempt.join(v.answer_unnumbered.where("source_id IS NOT NULL"), "attempt_id").select("user_id", "source_id").distinct()


@query("SELECT attempt_id, user_id, topic_id, level, count(*) AS n_mistakes, min(item_id) AS first_item FROM v_attempt JOIN v_answer USING (attempt_id) WHERE NOT is_correct GROUP BY attempt_id, user_id, topic_id, level")
def score_fanout_mistakes(v: Views):
    wrong = M.mistakes(v.attempt, v.answer_unnumbered)
    return wrong.groupBy("attempt_id", "user_id", "topic_id", "level").agg(F.count("*").alias("n_mistakes"), F.min("item_id").alias("first_item"))


@query("""SELECT topic_id, item_id, CAST(floor(100 / count(*) OVER (PARTITION BY topic_id)) AS BIGINT) + CASE WHEN row_number() OVER (PARTITION BY topic_id ORDER BY item_id) <= 100 % count(*) OVER (PARTITION BY topic_id) THEN 1 ELSE 0 END AS share FROM v_item""")
def share_remainder(v: Views):
    return S.shares(v.item, "topic_id", "item_id")


@query("""WITH b AS (SELECT * FROM (SELECT p_brand, p_partkey, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS place FROM part) WHERE place <= 8),
s AS (SELECT *, CAST(floor(100 * p_size / CAST(sum(p_size) OVER (PARTITION BY p_brand) AS DOUBLE)) AS BIGINT) AS share FROM b)
SELECT p_brand, p_partkey, place AS "at", CASE WHEN place = 1 THEN share + 100 - CAST(sum(share) OVER (PARTITION BY p_brand) AS BIGINT) ELSE share END AS share FROM s""")
def share_proportional(v: Views):
    return S.proportional(v.table("part"), "p_brand", "p_partkey", "p_size")
