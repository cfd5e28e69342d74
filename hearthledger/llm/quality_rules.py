"""Quality rules: a threshold table compiled into one Spark projection; built-in functions only.

Every rule is a row of ``RULES``: a ratio of two counters, a bound, and the least number of words from
which it applies.  ``measured`` adds the counters, ``verdict`` folds the table into one boolean column.

Defined cases: null text counts as empty (no words, hence rejected by the word minimum); repeated rows are
judged one by one; an empty table gives an empty table; columns of the input that clash with counters are
untouched by ``passing`` (it works under reserved names) and replaced in ``judge``'s own result.  Windows of
eight words are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GAP_RE

SYMBOLS = "#*$%&|<>"  # fixed by the contract
SPACES = " \t\n\x0b\f\r"  # fixed: what separates words
WINDOW = 8
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = """the of and to in a is that it for on with was as be are by this at from or an not have has
der die das und in den von zu mit ist im des auf ein eine nicht dem sich für
le la les de des et en un une du dans que qui est pour au pas par sur il
el los las y del se por con una su para no al lo como más o""".split()
P = "__hl_q_"  # reserved prefix of working columns


class Rule(NamedTuple):
    name: str
    over: str  # counter in the numerator
    under: str  # counter in the denominator
    least: float | None  # reject below
    most: float | None  # reject above
    from_words: int = 0


RULES = (
    Rule("word_length_short", "word_chars", "n_words", 2.0, None, 20),
    Rule("word_length_long", "word_chars", "n_words", None, 14.0, 20),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("shouting", "n_marks", "n_words", None, 0.5),
    Rule("stuttering", "n_echo_words", "n_words", None, 0.25),
    Rule("stop_words", "n_stop_words", "n_words", 0.01, None, 100),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
)


def stays() -> Column:
    """Always true.  A projection that names the partition stays below a filter; else the optimiser would write the
    counters' whole expressions into the filter's condition again and again."""
    return F.spark_partition_id() >= 0


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the counters under reserved names (prefix ``P``)."""
    c = lambda name: F.col(P + name)
    d = docs.withColumn(P + "text", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn(P + "words", F.filter(F.split(c("text"), GAP_RE), lambda w: w != ""))
    d = d.withColumn(P + "lines", F.filter(F.split(c("text"), "\n"), lambda x: F.translate(x, SPACES, "") != ""))
    d = d.withColumns(
        {
            P + "n_words": F.size(c("words")).cast("long"),
            P + "word_chars": F.length(F.translate(c("text"), SPACES, "")).cast("long"),
            P + "n_symbols": (F.length(c("text")) - F.length(F.translate(c("text"), SYMBOLS, ""))).cast("long"),
            P + "n_marks": (F.length(c("text")) - F.length(F.translate(c("text"), "!", ""))).cast("long"),
            P + "n_lines": F.size(c("lines")).cast("long"),
            P + "n_dup_lines": (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
            P + "n_stop_words": F.size(F.filter(c("words"), lambda w: F.lower(w).isin(STOP_WORDS))).cast("long"),
            P + "hashes": F.transform(c("words"), lambda w: F.xxhash64(w)),
        }
    ).drop(P + "words", P + "lines")
    d = d.withColumn(
        P + "windows",
        F.when(
            F.size(c("hashes")) > WINDOW,
            F.transform(F.sequence(F.lit(1), F.size(c("hashes")) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(c("hashes"), i, WINDOW))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # Only texts with an equal pair of windows are sorted.
    d = d.withColumn(
        P + "sorted",
        F.when(
            F.size(F.array_distinct(c("windows"))) < F.size(c("windows")),
            F.sort_array(F.transform(c("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    twin = lambda x, at: F.coalesce(F.get(c("sorted"), at)["h"] == x["h"], F.lit(False))
    d = d.withColumn(P + "repeats", F.sort_array(F.transform(F.filter(c("sorted"), lambda x, j: twin(x, j - 1) | twin(x, j + 1)), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform(c("repeats"), lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(c("repeats"), j + 1) - x, F.lit(WINDOW)))),
        F.lit(0),
        lambda a, x: a + x,
    )
    echo = F.size(F.filter(c("hashes"), lambda h, i: F.coalesce(F.get(c("hashes"), i - 1) == h, F.lit(False))))
    d = d.withColumns({P + "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"), P + "n_echo_words": echo.cast("long")})
    return d.drop(P + "text", P + "hashes", P + "windows", P + "sorted", P + "repeats")


def base_failed() -> Column:
    return (F.col(P + "n_words") < 20) | (F.lit(100) * F.col(P + "n_repeat_words") > F.lit(30) * F.col(P + "n_words"))


def broken(rule: Rule) -> Column:
    ratio = F.col(P + rule.over).cast("double") / F.greatest(F.col(P + rule.under), F.lit(1)).cast("double")
    out = F.lit(False)
    if rule.least is not None:
        out = out | (ratio < F.lit(float(rule.least)))
    if rule.most is not None:
        out = out | (ratio > F.lit(float(rule.most)))
    return out & (F.col(P + "n_words") >= rule.from_words)


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The whole table as one boolean: true if no rule is broken."""
    out = ~base_failed()
    for rule in rules:
        out = out & ~broken(rule)
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: the counters, the base verdict and the table's verdict."""
    d = measured(docs.select(F.col(key).alias(key), F.col(text).alias(P + "in")), P + "in")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return d.select(
        key,
        *(F.col(P + n).alias(n) for n in names),
        base_failed().alias("base_failed"),
        (verdict(rules) & stays()).alias("kept"),
        F.filter(F.array(*(F.when(broken(r), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull()).alias("broken_rules"),
    )


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of `docs` that pass, with all their columns."""
    judged = measured(docs, text).withColumn(P + "ok", verdict(rules) & stays())
    return judged.where(P + "ok").select(*(F.col(f"`{n}`") for n in docs.columns))


def _oracle() -> str:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    bad = []
    for r in RULES:
        ratio = f"{r.over}::double / greatest({r.under}, 1)::double"
        test = " or ".join([f"{ratio} < {r.least}"] * (r.least is not None) + [f"{ratio} > {r.most}"] * (r.most is not None))
        bad.append((r.name, f"(({test}) and n_words >= {r.from_words})"))
    listed = ", ".join(f"case when {t} then '{n}' end" for n, t in bad)
    return rf"""
with t as (select doc_id, coalesce(text, '') as x, row_number() over () as rid from documents),
w as (select rid, doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') as words,
             list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines from t),
u as (select rid, unnest(words) as word, generate_subscripts(words, 1) as i from w),
g as (select rid, i, word, lag(word) over p as before, lead(word, 7) over p as last,
             concat_ws(' ', word, lead(word, 1) over p, lead(word, 2) over p, lead(word, 3) over p, lead(word, 4) over p,
                       lead(word, 5) over p, lead(word, 6) over p, lead(word, 7) over p) as win
      from u window p as (partition by rid order by i)),
k as (select rid, i, last is not null and count(*) over (partition by rid, win, last is not null) > 1 as twice,
             word = before as echo, lower(word) in ({stop}) as stopped from g),
m as (select rid, max(case when twice then 1 else 0 end) over (partition by rid order by i rows between 7 preceding and current row) as rep,
             echo, stopped from k),
s as (select rid, sum(rep)::bigint as n_repeat_words, count(*) filter (echo) as n_echo_words, count(*) filter (stopped) as n_stop_words from m group by rid),
f as (select doc_id, len(words)::bigint as n_words, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
             (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
             (length(x) - length(replace(x, '!', '')))::bigint as n_marks,
             len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
             coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(n_echo_words, 0) as n_echo_words,
             coalesce(n_stop_words, 0) as n_stop_words
      from w left join s using (rid)),
b as (select *, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or {" or ".join(t for _, t in bad)}) as kept,
       list_filter([{listed}], lambda x: x is not null) as broken_rules
from b"""


ORACLE_SQL = _oracle()
