"""Queries whose order or exactness SQL cannot express; tests hold them against worked examples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import solvers as V
from ..operators import adaptive as D
from ..operators import pairs as P
from ..operators.chunking import chunk_pack as pack
from ..operators.chunking import structure_units
from ..views import SEED, Views
from .registry import query


@query()
def chunk_pack(v: Views):
    lines = v.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", "pos", F.trim("line").alias("line"))
    units = structure_units(lines).select(F.col("doc_id").cast("string").alias("source"), F.col("unit").alias("ord"), "text")
    return pack(units, low=300, target=360, high=450, overlap=60)


@query()
def evidence_passages(v: Views):
    return v.table("documents").select("doc_id", F.posexplode(D.evidence_passages(F.col("text"))).alias("place", "passage"))


@query()
def budget_fill(v: Views):
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    turns = v.table("conversations").groupBy("conv_id").agg(F.transform(parts, lambda x: x["text"]).alias("parts"))
    return turns.select("conv_id", D.budget_fill(F.col("parts"), F.col("conv_id") % 3).alias("window"))


@query()
def adaptive_select(v: Views):
    """Each customer's choice from the catalogue of brands, by what they answered before."""
    topics = v.item.groupBy("topic_id").agg(F.min("grade").alias("g"), F.array_sort(F.collect_set(F.col("level").cast("string"))).alias("families"), F.count("*").alias("periods"))
    catalogue = [{"topic_id": r["topic_id"], "grade": 10 + r["g"] % 2, "families": r["families"], "periods": r["periods"]} for r in topics.orderBy("topic_id").collect()]  # a curriculum
    answers = v.attempt.select("attempt_id", "user_id", "created_at").join(v.answer_unnumbered, "attempt_id")
    seen = answers.groupBy("user_id", "topic_id").agg(F.avg(F.col("is_correct").cast("double")).alias("accuracy"), F.countDistinct("attempt_id").cast("int").alias("last_attempt"))
    history = seen.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("topic_id", "accuracy", "last_attempt"))).alias("history"))  # at most one entry a topic
    students = v.table("customer").select(F.col("c_custkey").alias("student_id")).join(history.withColumnRenamed("user_id", "student_id"), "student_id", "left")
    return D.adaptive_select(students, catalogue, SEED, 10)


def _one_of(n, *forms):
    """The form that a number picks."""
    return F.element_at(F.array(*forms), (1 + n % len(forms)).cast("int"))


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 2 AS odd, (p_partkey // 2) % 6 AS form FROM part)
SELECT p_partkey,
       CAST(CASE WHEN form < 2 THEN 3 - odd WHEN form IN (2, 4) THEN 1 WHEN form = 5 THEN odd ELSE 0 END AS INTEGER) AS n_matching,
       CASE WHEN form IN (2, 4) THEN 'D' WHEN form = 5 AND odd = 1 THEN 'C' END AS letter
FROM part JOIN p USING (p_partkey)
""")
def answer_match(v: Views):
    """fractions, decimals, per cents, units, labels and sets that say the same."""
    n, size = F.col("p_partkey"), F.col("p_size").cast("string")
    many = (25 * F.col("p_size")).cast("string")
    third = F.concat(many, F.when(n % 2 == 0, "%").otherwise(" m"))
    options = F.array(F.concat(size, F.lit("/4")), F.concat(F.lit("A) "), (F.col("p_size") / 4).cast("string")), third, F.lit("{2, 1}"))
    said = _one_of(F.floor(n / 2), F.concat(size, F.lit("/4")), F.concat(F.lit("$\\frac{"), size, F.lit("}{4}$")), F.lit("{1,2}"), size, F.lit("(D) {2,1}."), F.concat(many, F.lit("m")))
    return v.table("part").select(n, said.alias("said"), options.alias("o")).select("p_partkey", A.answer_match("said", "o").alias("n_matching"), A.answer_letter("said", "o").alias("letter"))


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 6 AS form, CAST(p_size AS HUGEINT) AS s, CAST(p_partkey % 7 AS HUGEINT) AS k FROM part),
q AS (SELECT p_partkey,
             CASE form WHEN 0 THEN (2 * s + 5) * (2 * s + 5) WHEN 1 THEN 4 * s - 3 * k WHEN 2 THEN -((s - k) * (s - k) * (s - k)) WHEN 3 THEN s WHEN 5 THEN s END AS num,
             CASE form WHEN 0 THEN 4 * k WHEN 1 THEN 4 WHEN 2 THEN 1 WHEN 3 THEN CAST(1 AS BIGINT) << CAST(k AS BIGINT) WHEN 5 THEN 2 * k END AS den
      FROM p)
SELECT p_partkey,
       CASE WHEN den > 0 THEN CAST(num // gcd(abs(num), den) AS VARCHAR) || CASE WHEN den // gcd(abs(num), den) = 1 THEN '' ELSE '/' || CAST(den // gcd(abs(num), den) AS VARCHAR) END END AS value
FROM q
""")
def arith_eval(v: Views):
    """powers, signs, order of operations; null for a division by nought and for a stem that asks something else."""
    s, k = F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string")
    stem = _one_of(
        F.col("p_partkey"),
        F.concat(F.lit("Calculate ("), s, F.lit(" + 2.5)^2 / "), k, F.lit("?")), F.concat(F.lit("What is "), s, F.lit(" − 3 × "), k, F.lit(" ÷ 4")), F.concat(F.lit("evaluate -("), s, F.lit("-"), k, F.lit(")**3!")),
        F.concat(F.lit("Compute 2^-"), k, F.lit(" * "), s, F.lit(".")), F.concat(F.lit("Name the value of "), s), F.concat(F.lit("Find the value of "), s, F.lit(" / "), k, F.lit(" / 2 ?")),
    )
    return v.table("part").select("p_partkey", A.arith_eval(stem).alias("value"))


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 5 AS form, list_distinct(['1', '2', CAST(p_size AS VARCHAR)]) AS a, list_distinct(['2', CAST(p_size AS VARCHAR), '60']) AS b FROM part),
q AS (SELECT p_partkey, form,
             CASE form WHEN 0 THEN list_filter(list_distinct(list_concat(a, b)), lambda x: NOT (list_contains(a, x) AND list_contains(b, x)))
                       WHEN 1 THEN list_filter(a, lambda x: NOT list_contains(b, x))
                       WHEN 2 THEN list_concat(list_filter(a, lambda x: list_contains(b, x)), ['15/2', 'x'])
                       WHEN 4 THEN list_filter(b, lambda x: NOT list_contains(a, x)) END AS found
      FROM p)
SELECT p_partkey, CASE WHEN form <> 3 THEN coalesce(array_to_string(list_sort(found), ','), '') END AS members FROM q
""")
def set_eval(v: Views):
    """unions, intersections, differences in three spellings, decimals and letters as members; null for an unknown set."""
    size = F.col("p_size").cast("string")
    asked = map(F.lit, ("Find (A ∪ B) \\ (A ∩ B)?", "Determine A \\setminus B.", "What is A ∩ B ∪ C?", "Calculate A ∪ D", "find B − A ?"))
    stem = F.concat(F.lit("A = {1, 2, "), size, F.lit("}, B = {2, "), size, F.lit(", 60}, C = {7.50, x}. "), _one_of(F.col("p_partkey"), *asked))
    return v.table("part").select("p_partkey", F.array_join(A.set_eval(stem), ",").alias("members"))


def _pseudonym_sql() -> str:
    inner, outer = (bytes(x ^ pad for x in SEED.encode().ljust(64, b"\0")).hex() for pad in (0x36, 0x5C))
    return f"SELECT c_custkey, substr(sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode('user:' || c_name)))), 1, 16) AS ref FROM customer"


@query(_pseudonym_sql())
def pseudonymise(v: Views):
    return v.table("customer").select("c_custkey", D.pseudonym(SEED.encode(), "user")(F.col("c_name")).alias("ref"))


@query("""
WITH p AS (SELECT p_partkey, p_partkey % 6 AS form, p_name AS n, CAST(p_size AS VARCHAR) AS s FROM part)
SELECT p_partkey,
       CASE form WHEN 0 THEN '[{"name": "' || n || '", "size": ' || s || '}]'
                 WHEN 1 THEN '{"name": "' || n || '", "ok": true, "size": ' || s || '}'
                 WHEN 5 THEN '{"name": "\\\\alpha ' || n || '", "ok": true, "size": ' || s || '}'
                 WHEN 4 THEN NULL
                 ELSE '{"name": "' || n || '", "size": ' || s || '}' END AS value
FROM p
""")
def json_salvage(v: Views):
    """fences and trailing commas, Python literals, talk around, answers cut short, no answer, stray backslashes."""
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    text = _one_of(
        F.col("p_partkey"),
        F.concat(F.lit("Here it is:\n```json\n[{\"name\": \""), name, F.lit("\", \"size\": "), size, F.lit(",},]\n```")), F.concat(F.lit("{'size': "), size, F.lit(", 'name': '"), name, F.lit("', 'ok': True}")),
        F.concat(F.lit("Sure. {\"size\": "), size, F.lit(", \"name\": \""), name, F.lit("\"} rather than {\"size\": 0}")), F.concat(F.lit("[{\"name\": \""), name, F.lit("\", \"size\": "), size, F.lit("}, {\"name\": \"cut")),
        F.concat(F.lit("No answer for "), name), F.concat(F.lit("{\"name\": \"\\alpha "), name, F.lit("\", \"ok\": true, \"size\": "), size, F.lit("}")),
    )
    return v.table("part").select("p_partkey", D.json_salvage(text).alias("value"))


@query()
def near_dup_stems(v: Views):
    """J18 exact: similarity and data rule for pairs of one concept that reach the threshold, by a prefix filter."""
    stems = v.question.select(F.col("topic_id").alias("concept"), F.col("question_id").alias("id"), F.col("question").alias("text"))
    return P.similar_pairs(stems)


@query()
def dedup_questions(v: Views):
    """D1 in full: the ordered pass over the questions of each grade."""
    first = v.item.withColumn("n", F.row_number().over(Window.partitionBy("grade", "topic_name").orderBy("item_id"))).where("n = 1")
    return P.keep_first_stems(first.select(F.concat_ws("|", "grade", "topic_id").alias("concept"), F.col("item_id").alias("id"), F.col("topic_name").alias("text")))


#: Stems for each closed-form solver, with s for a part's size; options are s + 12, s / 10, 2, (x + s)^3 and the like.
_STEMS = (
    "In an arithmetic progression the first term is {s} and the second term is {t}. What is the fifth term?",
    "What is {s} when rounded to the nearest multiple of 10?",
    "Find the turning point of y = 2x² + {s}",
    "Write (x + {s})(x + {s})(x + {s}) as the cube of a binomial",
    "What is log({s}00/{s})?",
    "In a class of 100 students, {s} play cricket, 30 play chess and {s} students play both. How many play neither?",
    "There are {s} girls, 20 boys in biological stream and 30 girls, 40 boys in mathematics stream. One is selected at random. Find the probability that the student is a girl following the mathematics stream.",
    "Which condition ensures that quadrilateral ABCD is a parallelogram?",
    "Calculate ({s} + 1)^2 / 4?",
    "A = {{1, 2, {t}}}, B = {{2, {t}, 99}}. Find A ∩ B?",
)


def _solvable(v: Views):
    """Questions for all solvers over all parts."""
    size, text = F.col("p_size"), lambda c: c.cast("string")
    filled = [F.format_string(stem.replace("{s}", "%1$s").replace("{t}", "%2$s").replace("{{", "{").replace("}}", "}"), text(size), text(size + 3)) for stem in _STEMS]
    tens = text((F.floor((size + 5) / 10) * 10).cast("long"))
    by_kind = [
        F.array(text(size + 12), text(size + 15), text(size + 9), text(size)), F.array(tens, text(size), F.lit("7"), F.lit("1000")), F.array(F.concat(F.lit("(0, "), text(size), F.lit(")")), F.lit("(1, 1)"), F.lit("(0, 0)"), F.lit("(2, 0)")),
        F.array(F.concat(F.lit("(x+"), text(size), F.lit(")^2")), F.concat(F.lit("(x + "), text(size), F.lit(")³")), F.lit("x^3"), F.lit("3x")), F.array(F.lit("2"), F.lit("10"), F.lit("1"), F.lit("3")), F.array(F.lit("70"), F.lit("100"), F.lit("0"), F.lit("30")),
        F.array(F.concat(F.lit("30/"), text(size + 90)), F.lit("1/2"), F.lit("1/3"), F.lit("9")), F.array(F.lit("AB = CD"), F.lit("AB = CD and BC = DA"), F.lit("AC = BD"), F.lit("AB = BC")),
        F.array(text(size), F.concat(text((size + 1) * (size + 1)), F.lit("/4")), F.lit("1"), F.lit("0.5")), F.array(F.concat(F.lit("{2,"), text(size + 3), F.lit("}")), F.lit("{1}"), F.lit("{}"), F.lit("{99}")),
    ]
    kind = (1 + F.col("p_partkey") % len(_STEMS)).cast("int")
    return v.table("part").select("p_partkey", F.element_at(F.array(*filled), kind).alias("stem"), F.element_at(F.array(*by_kind), kind).alias("options"))


@query()
def closed_form_solvers(v: Views):
    """F16: all ten kinds of stems."""
    return _solvable(v).select("p_partkey", V.solved_letters("stem", "options").alias("solved"))


@query()
def explanation_errors(v: Views):
    """explanations of several forms, against keys that are right or wrong."""
    n = F.col("p_partkey")
    letter = F.element_at(F.array(*map(F.lit, "ABCD")), (1 + n % 4).cast("int"))
    said = F.array(F.lit("The correct answer is B."), F.concat(F.lit("So option "), letter, F.lit(" correctly follows.")), F.lit("Wait, the first option is correct."), F.concat(F.lit("The result is "), F.element_at("options", 1)), F.concat(F.lit("It gives "), F.element_at("options", 2), F.lit(".")))
    rows = _solvable(v).withColumn("said", F.element_at(said, (1 + n % 5).cast("int")))
    return rows.select("p_partkey", F.array_join(V.explanation_errors("stem", "options", letter, F.element_at("options", (1 + n % 3).cast("int")), "said"), "; ").alias("errors"))


@query()
def explanation_remap(v: Views):
    """mentions of options under another order of letters."""
    n = F.col("p_partkey")
    order = F.element_at(F.array(F.lit("DCBA"), F.lit("BCDA"), F.lit("ABCD")), (1 + n % 3).cast("int"))
    text = F.concat(F.lit("Options A/"), F.element_at(F.array(*map(F.lit, "BCD")), (1 + n % 3).cast("int")), F.lit(" fail; the second option is correct, so the correct answer is B."))
    return v.table("part").select(n, A.remapped(text, order).alias("text"))
