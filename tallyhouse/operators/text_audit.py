"""Audit of generated answers against the figures that they quote, in bulk.

An answer is JSON text with a summary and suggestions. Rules are tried in order, and the first that fails gives the
verdict: structure, causal words, promises, figures that are not in the findings, sample sizes that are not, small
samples that are not called so, suggestions without hedging.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions import descent

#: Word lists and limits.
CAUSAL_WORDS = ("caused", "because", "due to", "effect of", "leads to", "drives")
PROMISES = ("will increase", "will grow", "will raise", "will boost", "guarantee", "ensure", "certainly", "definitely", "forecast", "predict")
HEDGES = ("may", "might", "could", "suggests", "consider testing")
SMALL_SAMPLE = "small sample"
MAX_SUMMARY, MAX_TEXT, MAX_SUGGESTIONS = 600, 400, 5
#: The signs and codes of currencies.
SIGNS = ("$", "€", "£", "¥", "₹")
CODES = ("USD", "EUR", "GBP", "KHR", "DKK", "SEK", "NOK", "CHF", "JPY", "CNY", "THB", "VND", "AUD", "CAD", "INR")
#: The fields that hold sample sizes, besides counts of days.
SIZE_FIELDS = ("numerator", "denominator", "records_used")
RULES = ("structure", "causal", "promise", "figures", "sample_size", "small_sample", "hypothesis")


def _unfenced(text: Column) -> Column:
    """Text between code fences: a first line of three backticks, perhaps with json, and a last one of three backticks."""
    first = F.substring_index(text, "\n", 1)
    fenced = first.rlike(r"(?i)^`{3}(json)?[ \t\r]*$") & F.endswith(text, F.lit("```")) & (F.length(text) >= F.length(first) + 4)
    return F.when(fenced, F.substr(text, F.length(first) + 2, F.length(text) - F.length(first) - 4)).otherwise(text)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _any(values: tuple[str, ...], test) -> Column:
    return F.exists(F.array(*map(F.lit, values)), test)


def _words_apart(text: Column) -> Column:
    """A text in small letters whose words stand between single blanks: every other character but a blank is a bar between blanks."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"(?U)[^\w ]", " | "), F.lit(" "))


def promises(text: Column) -> Column:
    """Whether a text has a phrase of PROMISES, with any ending: a final e goes, and what begins with the rest is an inflection."""
    known = _words_apart(F.regexp_replace(text, r"(?U)\s+", " "))
    return _any(PROMISES, lambda p: F.contains(known, F.concat(F.lit(" "), F.regexp_replace(p, "e$", ""))))


def hedged(text: Column) -> Column:
    """Whether a text has a phrase of HEDGES, as whole words with one blank between them."""
    known = _words_apart(text)
    return _any(HEDGES, lambda p: F.contains(known, F.concat(F.lit(" "), p, F.lit(" "))))


#: Where a number run is set apart in a text; no text has this character afterwards.
_MARK = "\x01"


def canonical(number: Column) -> Column:
    """A number's one way of writing: no commas, no zeros that say nothing. Equal numbers of any size and any number of places are equal texts."""
    plain = F.regexp_replace(F.replace(number, F.lit(",")), r"^0+(?=\d)", "")
    return F.when(F.contains(plain, F.lit(".")), F.rtrim(F.rtrim(plain, F.lit("0")), F.lit("."))).otherwise(plain)


def amounts(text: Column) -> Column:
    """The numbers of a text that stand before a per cent sign or word, or beside a sign or code of a currency, canonical.

    The text is split into runs of digits with points and commas between them and what lies between the runs; a run's
    neighbours say whether it is an amount. Groups of thousands are three digits after a comma. Of a run that is no
    number as a whole, what fits next to the sign counts. A code is a word of its own.
    """
    apart = F.split(F.regexp_replace(F.translate(text, _MARK, " "), r"(\d+(?:[.,]\d+)*)", rf"{_MARK}$1{_MARK}"), _MARK)
    places = F.filter(F.sequence(F.lit(0), F.size(apart) - 1), lambda i: i % 2 == 1)
    number = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"

    def beside(i: Column) -> Column:
        before, run, after = F.get(apart, i - 1), F.get(apart, i), F.get(apart, i + 1)
        behind, ahead = F.regexp_replace(after, r"(?U)^\s+", ""), F.regexp_replace(before, r"(?U)\s+$", "")
        code = lambda side, where: F.regexp_extract(side, where, 1).isin(*CODES)
        counts_before = F.startswith(F.lower(behind), F.lit("%")) | F.startswith(F.lower(behind), F.lit("percent")) | F.left(behind, F.lit(1)).isin(*SIGNS) | code(after, r"(?U)^\s+(\w+)")
        counts_after = F.right(ahead, F.lit(1)).isin(*SIGNS) | code(before, r"(?U)(\w+)\s+$")
        return F.array(F.when(counts_before, F.regexp_extract(run, f"({number})$", 1)), F.when(counts_after, F.regexp_extract(run, f"^({number})", 1)))

    return F.transform(F.filter(F.flatten(F.transform(places, beside)), lambda n: n.isNotNull()), canonical)


def parse(answers: DataFrame) -> DataFrame:
    """answers (answer_id, answer_text, ...) with summary, suggestions and structure (false: it is not as asked for)."""
    text = _stripped(F.col("answer_text"))
    rows = answers.withColumn("_record", F.try_parse_json(_unfenced(text)))
    string = lambda v, p, limit: F.when((F.schema_of_variant(F.variant_get(v, p, "variant")) == "STRING") & F.length(_stripped(F.try_variant_get(v, p, "string"))).between(1, limit), _stripped(F.try_variant_get(v, p, "string")))
    size = lambda v: F.when(F.schema_of_variant(F.variant_get(v, "$.sample_size", "variant")) == "BIGINT", F.try_variant_get(v, "$.sample_size", "bigint"))
    items = F.try_variant_get("_record", "$.improvement_suggestions", "array<variant>")
    one = lambda v: F.struct(string(v, "$.suggestion", MAX_TEXT).alias("suggestion"), string(v, "$.evidence", MAX_TEXT).alias("evidence"), size(v).alias("sample_size"))
    rows = rows.withColumn("summary", string(F.col("_record"), "$.executive_summary", MAX_SUMMARY)).withColumn("suggestions", F.transform(items, one))
    fine = F.forall("suggestions", lambda s: s["suggestion"].isNotNull() & s["evidence"].isNotNull() & F.coalesce(s["sample_size"] >= 1, F.lit(False)))
    whole = F.col("summary").isNotNull() & F.coalesce(F.size("suggestions"), F.lit(0)).between(1, MAX_SUGGESTIONS) & fine
    return rows.withColumn("structure", F.coalesce(whole, F.lit(False))).drop("_record")


def check(parsed: DataFrame, minimum: int = 30) -> DataFrame:
    """parsed (with figures and sizes, as facts() gives them) with one flag per rule (true: it holds), null after a structure that fails."""
    texts = F.concat(F.array("summary"), F.flatten(F.transform("suggestions", lambda s: F.array(s["suggestion"], s["evidence"]))))
    rows = parsed.withColumn("texts", F.when(F.col("structure"), texts))
    each = lambda test: F.when(F.col("structure"), F.forall("suggestions", test))
    return rows.select(
        *parsed.columns,
        (~F.exists("texts", lambda t: _any(CAUSAL_WORDS, lambda w: F.contains(F.lower(t), w)))).alias("causal"),
        (~F.exists("texts", promises)).alias("promise"),
        (F.size(F.array_except(F.flatten(F.transform("texts", amounts)), F.col("figures"))) == 0).alias("figures_known"),
        each(lambda s: F.array_contains("sizes", s["sample_size"])).alias("sample_size"),
        each(lambda s: (s["sample_size"] >= minimum) | F.contains(F.lower(s["evidence"]), F.lit(SMALL_SAMPLE))).alias("small_sample"),
        each(lambda s: hedged(s["suggestion"])).alias("hypothesis"),
    )


def _failed() -> Column:
    """The first rule that fails, over the columns of check()."""
    flags = [F.col("structure"), F.col("causal"), F.col("promise"), F.col("figures_known"), F.col("sample_size"), F.col("small_sample"), F.col("hypothesis")]
    return F.coalesce(*[F.when(~flag, F.lit(rule)) for rule, flag in zip(RULES, flags, strict=True)])


def verdict(checked: DataFrame) -> DataFrame:
    """(answer_id, accepted, first_failed_rule)."""
    return checked.select("answer_id", _failed().isNull().alias("accepted"), _failed().alias("first_failed_rule"))


def causal_words(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with their first causal word in list order, or null."""
    low = F.lower(F.col(text))
    return texts.withColumn("causal_word", F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in CAUSAL_WORDS]))


def insight_status(checked: DataFrame, *keep: str) -> DataFrame:
    """(answer_id, status, reason, keep...) from check(): available, unavailable with GUARDRAIL_REJECTED or BAD_STRUCTURE, or not_applicable without an answer."""
    none, failed = F.col("answer_text").isNull(), _failed()
    status = F.when(none, "not_applicable").when(failed.isNull(), "available").otherwise("unavailable")
    reason = F.when(none | failed.isNull(), None).when(failed == "structure", "BAD_STRUCTURE").otherwise("GUARDRAIL_REJECTED")
    return checked.select("answer_id", status.alias("status"), reason.alias("reason"), *keep)


def status_counts(statuses: DataFrame) -> DataFrame:
    """(status, reason, answers) of insight_status()."""
    return statuses.groupBy("status", "reason").agg(F.count("*").alias("answers"))


def _is_size(key: Column) -> Column:
    days = F.endswith(key, F.lit("_days")) & ~F.startswith(key, F.lit("median_")) & ~F.startswith(key, F.lit("mean_"))
    return key.isin(*SIZE_FIELDS) | days


def facts(findings: DataFrame, text: str = "findings_text") -> DataFrame:
    """findings with figures (every number in the text, canonical) and sizes (its sample sizes), as check() takes them.

    The text is JSON with findings and data_quality. Sample sizes are whole numbers, alone or in lists, under numerator,
    denominator, records_used or a name that ends in _days, medians and means apart, and the record count. What is an
    object under such a name is not looked into.
    """
    record, json = F.try_parse_json(text), F.col(text)
    seen = descent.nodes(F.try_variant_get(record, "$.findings", "variant"), descent.levels(json), lambda n: _is_size(n["key"]) & descent.is_object(n["value"]))
    sized = F.filter(seen, lambda n: _is_size(n["key"]) & descent.is_integer(n["value"]))
    count = descent.whole(F.try_variant_get(record, "$.data_quality", "variant"), "record_count")
    sizes = F.concat(F.transform(sized, lambda n: F.try_variant_get(n["value"], "$", "bigint")), F.array(count))
    figures = F.transform(F.regexp_extract_all(json, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), canonical)
    distinct = lambda c: F.array_sort(F.array_distinct(F.filter(c, lambda x: x.isNotNull())))
    return findings.withColumn("figures", distinct(figures)).withColumn("sizes", distinct(sizes))


def finding_words(findings: DataFrame, text: str = "findings_text") -> DataFrame:
    """findings with causal_words: the causal words in any key or string of a JSON text, in list order. What is no JSON has none."""
    low = F.lower(F.col(text))
    # a word is in the text itself, or written with escapes; other texts need no walk
    likely = _any(CAUSAL_WORDS, lambda w: F.contains(low, w)) | F.contains(F.col(text), F.lit("\\"))
    seen = descent.nodes(F.try_parse_json(text), descent.levels(F.col(text)), lambda n: F.lit(False))
    own = F.flatten(F.transform(seen, lambda n: F.array(n["key"], F.when(F.schema_of_variant(n["value"]) == "STRING", F.try_variant_get(n["value"], "$", "string")))))
    # one text, so that it is made once and not for every word; no word holds a line break
    rows = findings.withColumn("_strings", F.when(likely, F.lower(F.array_join(own, "\n"))))
    words = F.array_compact(F.array(*[F.when(F.contains("_strings", F.lit(w)), F.lit(w)) for w in CAUSAL_WORDS]))
    return rows.withColumn("causal_words", words).drop("_strings")


def prompt_context(findings: DataFrame, longest: int = 60) -> DataFrame:
    """(analysis, context): the figures as one JSON text per analysis, with labels cut to longest characters."""
    entry = F.struct(F.left("group_label", F.lit(longest)).alias("group"), "numerator", "denominator", "small_sample")
    return findings.groupBy("analysis").agg(F.to_json(F.sort_array(F.collect_list(entry))).alias("context"))
