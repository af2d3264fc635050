"""Text functions as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs that normalised text keeps beside a-z and 0-9. Fixed value.
KEPT = r"√π%+\-*/=.^∪∩∈∉⊂⊆⊃⊇≤≥≠<>²³{}\[\]"
#: Fixed patterns of line types, in the order they are tried.
EXAMPLE = r"(?i)^(worked\s+)?example\b"
EXERCISE = r"(?i)^(exercise|activity|review|questions?)\b"
DEFINITION = r"(?i)^(definition|theorem|property|note|remember|summary)\b"
HEADING = r"(?i)^(unit|chapter|lesson|topic|section|[0-9]+(\.[0-9]+){0,3})\b"
MATH_SIGNS = "=+-×÷√∠π²³"
SECRET = r"(?i)(authorization|cookie|password|token|api[_-]?key)([\s:=]+)([^\s,;]+)"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@([A-Z0-9.-]+\.[A-Z]{2,})\b"
OPTION_LABEL = r"(?i)^\s*((option|choice)\s*)?(\([A-D]\)|\[[A-D]\]|[A-D]\s*[.)\]:-])\s*"


def terms(text: Column) -> Column:
    """lower-case words and runs of operators; one final s goes from words of more than four letters."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+|[=+\-*/^√π]+)"), F.lit(1))
    return F.transform(found, lambda x: F.when((F.length(x) > 4) & x.endswith("s"), F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x))


def normalise(text: Column) -> Column:
    """lower case, kept signs only, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"[^a-z0-9{KEPT}]+", " "))


def fingerprint(text: Column) -> Column:
    """sha256 of the normalised text."""
    return F.sha2(normalise(text), 256)


def bigrams(text: Column) -> Column:
    """distinct pairs of neighbouring tokens of the normalised text; a single token stands alone, none give none."""
    t = F.split(normalise(text), " ")
    pairs = F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(normalise(text) == "", F.array().cast("array<string>")).when(F.size(t) < 2, t).otherwise(F.array_distinct(pairs))


def jaccard(a: Column, b: Column) -> Column:
    """F5 (set part): shared over all elements of two distinct arrays; 0 when both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0))


def strip_label(text: Column) -> Column:
    """F8: without one leading option label."""
    return F.trim(F.regexp_replace(F.trim(text), OPTION_LABEL, ""))


def normalise_answer(text: Column) -> Column:
    """without label, spaces and mark-up, lower case, one form of minus, times and divide."""
    x = F.translate(strip_label(text), "−×÷", "-*/")
    x = F.regexp_replace(x, r"\\(dfrac|tfrac|frac)\s*\{([^{}]+)\}\s*\{([^{}]+)\}", "$2/$3")
    x = F.regexp_replace(x, r"\\(text|mathrm)\{([^{}]+)\}", "$2")
    x = F.regexp_replace(x, r"\\\(|\\\)|\$", "")
    return F.regexp_replace(F.lower(F.regexp_replace(x, r"\s+", "")), r"[.;]+$", "")


def line_type(line: Column) -> Column:
    """example, exercise, definition, heading, formula or prose, the first rule that fits."""
    v = F.trim(line)
    signs = F.length(v) - F.length(F.translate(v, MATH_SIGNS, ""))
    shouted = (F.length(v) <= 90) & (F.size(F.split(v, r"\s+")) <= 10) & (F.upper(v) == v) & v.rlike(r"[A-Z]")
    return (
        F.when(v.rlike(EXAMPLE), "example").when(v.rlike(EXERCISE), "exercise").when(v.rlike(DEFINITION), "definition")
        .when(v.rlike(HEADING) | shouted, "heading").when((signs >= 2) & (F.length(v) <= 180), "formula").otherwise("prose")
    )


def clean_lines(text: Column) -> Column:
    """runs of blanks squeezed in each line, lines trimmed, runs of empty lines made one."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t]{2,}", " ")))
    kept = F.filter(lines, lambda x: ~x.contains("Multiple definitions in dictionary at byte"))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def slug(text: Column) -> Column:
    """lower-case words joined by underscores, "topic" if there are none."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.when(s != "", s), F.lit("topic"))


def topic_id(grade: Column, term: Column, number: Column, name: Column) -> Column:
    """g{grade}_t{term}_{two digits}_{slug}."""
    return F.concat(F.lit("g"), grade.cast("string"), F.lit("_t"), term.cast("string"), F.lit("_"), F.lpad(number.cast("string"), 2, "0"), F.lit("_"), slug(name))


def first_code(text: Column) -> Column:
    """the first d.d of a text, else the text."""
    found = F.regexp_extract(text, r"(\d+\.\d+)", 1)
    return F.when(found != "", found).otherwise(F.trim(text))


def safe_image_url(url: Column) -> Column:
    """Whether a URL is a quiz image of our own: below its folder, 32 hexadecimal digits and .png as its name."""
    return F.coalesce(F.trim(url).rlike(r"(?s)^/static/quiz_images/(.*/)?[a-f0-9]{32}\.png$"), F.lit(False))


def redact(text: Column) -> Column:
    """values of secrets and local parts of e-mail addresses hidden."""
    return F.regexp_replace(F.regexp_replace(text, SECRET, "$1$2[REDACTED]"), EMAIL, "[REDACTED]@$1")


def file_grade(name: Column, low: int = 6, high: int = 11) -> Column:
    """the grade that a file name states, if it is between low and high."""
    found = F.regexp_extract(F.lower(name), r"(^|[^a-z0-9])(e?gr|g|grade)[\s_-]?(\d{1,2})([^0-9]|$)", 3)
    n = F.when(found != "", found).cast("int")
    return F.when(n.between(low, high), n)


def time_limit(periods: Column, level: Column) -> Column:
    """minutes by teaching periods, or by level where there are none."""
    by_level = F.when(level == 1, 12).when(level == 2, 15).otherwise(20)
    return F.when(periods <= 0, by_level).when(periods <= 4, 12).when(periods <= 7, 15).when(periods <= 10, 18).when(periods <= 14, 20).otherwise(25)


def stable_seed(text: Column) -> Column:
    """the first four bytes of sha256, modulo 2**31."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % (2**31)


def head_tail(a: Column, head: int = 8, tail: int = 4) -> Column:
    """Long arrays shortened to their first and last elements."""
    return F.when(F.size(a) > head + tail, F.concat(F.slice(a, 1, head), F.slice(a, -tail, tail))).otherwise(a)


def windows(a: Column, size: int, step: int) -> Column:
    """[start, slice] of every window, until one reaches the end. The array is bound once, not once per window."""

    def cut(x: Column) -> Column:
        n = F.size(x)
        kept = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda s: (s == 0) | (s - step + size < n))
        return F.transform(kept, lambda s: F.struct(s.alias("start"), F.slice(x, s + 1, size).alias("tokens")))

    return F.flatten(F.transform(F.array(a), cut))


def parse_number(text: Column) -> Column:
    """F9 (decimals): the value of a plain decimal, fraction or per cent answer, else null."""
    t = normalise_answer(text)
    decimal = r"^[+-]?(\d+(\.\d+)?|\.\d+)$"
    ratio = r"^([+-]?\d+)/([+-]?\d+)$"
    share = r"^[+-]?(\d+(\.\d+)?|\.\d+)%$"
    top, low = F.regexp_extract(t, ratio, 1), F.regexp_extract(t, ratio, 2)
    return (
        F.when(t.rlike(decimal), t.try_cast("double"))
        .when(t.rlike(share), F.regexp_replace(t, "%", "").try_cast("double") / 100)
        .when(t.rlike(ratio), F.try_divide(top.try_cast("double"), low.try_cast("double")))
    )
