"""Every function of the engine under a name that SQL can call.

Column functions become temporary SQL functions (Catalyst inlines them), exact ones Arrow-batched UDFs, and those that give
several rows table functions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import answers, mcq, similarity, solvers

#: Arrow-batched functions.
BATCHED = (
    answers.answer_match, answers.answer_letter, answers.arith_eval, answers.set_eval, answers.canonical_number, answers.answer_keys, answers.remapped, mcq.answer_key, mcq.option_spread,
    similarity.stem_similarity, similarity.is_too_similar, solvers.solved_letters, solvers.explanation_errors,
)
#: name(parameters) -> SQL over them. Word characters and folded texts follow functions/text.py.
_NORMAL = r"trim(regexp_replace(regexp_replace(lower(coalesce(t, '')), r'[^a-z0-9√π%+\-*/=.^∪∩∈∉⊂⊆⊃⊇≤≥≠<>²³{}\[\]]+', ' '), r'\s+', ' '))"
_SLUG = "regexp_replace(regexp_replace(lower(t), '[^a-z0-9]+', '_'), '^_+|_+$', '')"
INLINE = {
    "normal_text(t STRING) RETURNS STRING": _NORMAL,
    "text_fingerprint(t STRING) RETURNS STRING": f"sha2({_NORMAL}, 256)",
    "option_text(t STRING) RETURNS STRING": r"trim(regexp_replace(trim(t), r'(?i)^\s*(?:(?:option|choice)\s*)?(?:\([A-D]\)|\[[A-D]\]|[A-D]\s*[.)\]:-])\s*', ''))",
    "topic_slug(t STRING) RETURNS STRING": f"CASE WHEN {_SLUG} = '' THEN 'topic' ELSE {_SLUG} END",
    "first_code(t STRING) RETURNS STRING": r"CASE WHEN regexp_extract(t, r'(\d+\.\d+)', 1) <> '' THEN regexp_extract(t, r'(\d+\.\d+)', 1) ELSE trim(t) END",
    "safe_image_url(t STRING) RETURNS BOOLEAN": r"coalesce(trim(t) RLIKE r'(?s)^/static/quiz_images/(.*/)?[a-f0-9]{32}\.png$', false)",
    "stable_seed(t STRING) RETURNS BIGINT": "cast(conv(substring(sha2(t, 256), 1, 8), 16, 10) as bigint) % 2147483648",
    "digest(t STRING) RETURNS STRING": "sha2(t, 256)",
}


def register(spark: SparkSession) -> list[str]:
    """Makes all functions available to SQL; returns their names."""
    for f in BATCHED:
        spark.udf.register(f.__name__, f)
    for head, body in INLINE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("parse_mcqs", mcq.parse_mcqs)
    return [*(f.__name__ for f in BATCHED), *(h.split("(")[0] for h in INLINE), "parse_mcqs"]
