"""Verified edits: locate, replace, recount, and keep the original where the result cannot be proved."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docbatch.functions import text as T
from docbatch.functions.rows import joined_list

CONTEXT = 18
#: Characters of the stretches in which matches and segments meet.
STRETCH = 4096


def occurrences(rows: DataFrame, find: str, text_col: str = "text") -> DataFrame:
    """Adds one row per match of ``find`` in any spelling: ordinal, start and end (code points, end exclusive), the match and its context.

    Gaps between matches come from splitting, so start positions are running sums of lengths: no Python and no
    shuffle. A text without a match gives no row.
    """
    return occurrences_of(rows, T.flexible_pattern(find), text_col)


def occurrences_of(rows: DataFrame, pattern: str, text_col: str = "text") -> DataFrame:
    """The same for a regular expression that never matches an empty string."""
    found = rows.withColumn("_m", F.expr("regexp_extract_all({c}, {p}, 0)".format(c=text_col, p=_sql_string(pattern)))).filter(F.size("_m") > 0)
    # one pass: where a match starts is where the last one ended, and the gap before it
    step = lambda a, z: F.struct((a["at"] + F.length(z["g"]) + F.length(z["m"])).alias("at"), F.concat(a["starts"], F.array(a["at"] + F.length(z["g"]))).alias("starts"))
    gaps = F.arrays_zip(F.slice(F.split(text_col, pattern, -1), F.lit(1), F.size("_m")).alias("g"), F.col("_m").alias("m"))
    starts = F.aggregate(gaps, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), step, lambda a: a["starts"])
    found = found.select("*", F.posexplode(F.arrays_zip(starts.alias("start"), F.col("_m").alias("match"))).alias("_i", "_o"))
    start, end = F.col("_o.start"), F.col("_o.start") + F.length("_o.match")
    text = F.col(text_col)
    return found.select(
        *rows.columns,
        (F.col("_i") + 1).alias("ordinal"),
        start.alias("start"),
        end.alias("end"),
        F.col("_o.match").alias("match"),
        F.substring(text, F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT))).alias("before"),
        F.substring(text, end + 1, F.lit(CONTEXT)).alias("after"),
    )


def occurrence_id(find: str, *place: str) -> Column:
    """A stable name of an occurrence: 16 hexadecimal digits for the folded text that was looked for and the occurrence's place."""
    return F.substring(F.md5(F.concat_ws("|", T.flexible_key(F.lit(find)), *(F.col(p).cast("string") for p in place))), 1, 16)


def replaced_first(text: Column, pattern: str, replace: str, most: Column) -> Column:
    """The first ``most`` matches of a pattern replaced, the others left."""
    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    put = lambda z, i: F.concat(z["g"], F.when(z["m"].isNull(), "").when(i < most, replace).otherwise(z["m"]))
    return F.array_join(F.transform(pieces, put), "")


def cascade(rows: DataFrame, find: str, replace: str, text_col: str = "text") -> DataFrame:
    """Adds expected, direct, by_fallback and ``done``: the exact replacement first, then the flexible one for as many as are still expected.

    What the replacement itself brings in is not replaced again, since the fallback stops at the expected number.
    """
    text, pattern = F.col(text_col), T.flexible_pattern(find)
    direct, expected = T.count_of(text, F.lit(find)), F.regexp_count(text, F.lit(pattern)).cast("long")
    first = F.replace(text, F.lit(find), F.lit(replace))
    open_ = F.greatest(expected - direct, F.lit(0))
    done = replaced_first(first, pattern, replace, open_)
    by_fallback = F.least(open_, F.regexp_count(first, F.lit(pattern)).cast("long"))
    return rows.select("*", expected.alias("expected"), direct.alias("direct"), by_fallback.alias("by_fallback"), done.alias("done"))


def spliced(text: Column, edits: Column) -> Column:
    """A text in which the pieces from ``a`` to ``b`` (code points) are ``s``, for an array of (a, b, s) in order of place that do not overlap.

    One pass joins the gaps and the replacements, so the work follows the length of the text and not its product
    with the number of edits. Texts without edits, an empty array or null, stay where they are.
    """

    @F.pandas_udf("string")
    def joined(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        def one(text: str | None, own) -> str | None:
            if text is None or own is None:
                return None
            out, at = [], 0
            for e in own:
                out += (text[at : e["a"]], e["s"])
                at = e["b"]
            return "".join((*out, text[at:]))

        return pd.Series([one(t, c) for t, c in zip(texts, cuts, strict=True)])

    some = F.size(edits) > 0
    return F.coalesce(joined(F.when(some, text), F.when(some, edits)), text)


def apply_selected(rows: DataFrame, found: DataFrame, selected: DataFrame, replace: str, key: str = "doc_id") -> DataFrame:
    """(key, found, selected, applied, missing, reason, text): each text with just the chosen occurrences replaced.

    ``rows`` has (key, text), ``found`` (key, occurrence_id, start, end, match), ``selected`` (key, occurrence_id).
    Ids that no occurrence has are missing; where the number applied is not the number selected, nothing is
    changed and the reason says so.
    """
    chosen = selected.select(key, "occurrence_id").distinct().withColumn("_chosen", F.lit(True))
    cut = F.struct("start", "end", F.coalesce("_chosen", F.lit(False)).alias("chosen"))
    cuts = found.join(chosen, [key, "occurrence_id"], "left").groupBy(key).agg(F.sort_array(F.collect_list(cut)).alias("cuts"))
    asked = chosen.groupBy(key).agg(F.count(F.lit(1)).alias("selected"))
    missing = chosen.join(found, [key, "occurrence_id"], "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("missing"))
    out = rows.join(cuts, key, "left").join(asked, key, "left").join(missing, key, "left").na.fill(0, ["selected", "missing"])
    took = F.coalesce(F.filter("cuts", lambda c: c["chosen"]), F.array().cast(out.schema["cuts"].dataType))
    applied = F.size(took).cast("long")
    pieces = F.transform(took, lambda c: F.struct(c["start"].cast("int").alias("a"), c["end"].cast("int").alias("b"), F.lit(replace).alias("s")))
    done = spliced(F.col("text"), pieces)
    reason = F.when(F.col("missing") > 0, "missing ids").when(applied != F.col("selected"), "not all applied").when(F.col("selected") == 0, "nothing selected")
    return out.select(key, F.greatest(F.size("cuts"), F.lit(0)).cast("long").alias("found"), "selected", applied.alias("applied"), "missing", reason.alias("reason"), F.when(reason.isNull(), done).otherwise(F.col("text")).alias("text"))


def _sql_string(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def replaced(text: Column, find: str, replace: str) -> Column:
    """All spellings of ``find`` replaced by the literal ``replace``."""
    return F.regexp_replace(text, T.flexible_pattern(find), T.literal(replace))


def replaced_in_order(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Rules one after the other: each sees what the one before has left."""
    return reduce(lambda s, r: F.replace(s, F.lit(r[0]), F.lit(r[1])), rules, text)


def capped(found: DataFrame, remaining: Column, keys: list[str]) -> DataFrame:
    """The first occurrences per key, as many as remain to be done."""
    order = Window.partitionBy(*keys).orderBy("start")
    return found.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= remaining).drop("_r")


def segment_bases(segments: DataFrame) -> DataFrame:
    """Adds base: where each segment begins in the concatenated text of its document."""
    before = Window.partitionBy("doc_id").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("base", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)))


def segment_replace(segments: DataFrame, find: str, replace: str) -> DataFrame:
    """``segment_replace_pattern`` for all spellings of a literal."""
    return segment_replace_pattern(segments, T.flexible_pattern(find), replace)


def segment_replace_pattern(segments: DataFrame, pattern: str, replace: str) -> DataFrame:
    """Replaces matches that may span segments; each segment takes its share of the replacement.

    A match is found in the concatenated text of its document. A segment that holds the part
    [a, b) of a match of length n gets the replacement's characters from round(a/n * r) to round(b/n * r),
    rounding halves up, so the shares add up to the replacement.
    """
    based = segment_bases(segments)
    whole = based.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg_no", "text"))), lambda s: s["text"]), "").alias("text"))
    hits = occurrences_of(whole, pattern).select("doc_id", F.col("start").alias("m0"), F.col("end").alias("m1"))
    # hits and segments meet in the stretches of text that they touch, not all with all of a document
    stretch = lambda lo, hi: F.explode(F.sequence(F.floor(lo / STRETCH), F.floor(hi / STRETCH)))
    near = hits.withColumn("_s", stretch(F.col("m0"), F.col("m1") - 1)).join(based.filter(F.length("text") > 0).withColumn("_s", stretch(F.col("base"), F.col("base") + F.length("text") - 1)), ["doc_id", "_s"])
    # a pair that meets in several stretches counts in the first of them
    first = F.col("_s") == F.greatest(F.floor(F.col("m0") / STRETCH), F.floor(F.col("base") / STRETCH))
    touched = near.filter((F.col("m0") < F.col("base") + F.length("text")) & (F.col("m1") > F.col("base")) & first)
    a = F.greatest(F.col("m0"), F.col("base"))
    b = F.least(F.col("m1"), F.col("base") + F.length("text"))
    n = F.col("m1") - F.col("m0")
    cut = lambda x: F.floor((x - F.col("m0")) * len(replace) / n + 0.5).cast("int")
    share = F.substring(F.lit(replace), cut(a) + 1, cut(b) - cut(a))
    edits = touched.groupBy("doc_id", "seg_no").agg(F.sort_array(F.collect_list(F.struct((a - F.col("base")).cast("int").alias("a"), (b - F.col("base")).cast("int").alias("b"), share.alias("s")))).alias("edits"))
    out = segments.join(edits, ["doc_id", "seg_no"], "left")
    return out.select("doc_id", "seg_no", spliced(F.col("text"), F.col("edits")).alias("text"))


def reconciled(baseline: DataFrame, current: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Rows of either side that the other lacks or that differ in a field, with what is wrong."""
    b = baseline.select(*keys, F.struct(*fields).alias("b"))
    c = current.select(*keys, F.struct(*fields).alias("c"))
    what = F.when(F.col("b").isNull(), "added").when(F.col("c").isNull(), "missing").otherwise("changed")
    return b.join(c, keys, "full").filter(~F.col("b").eqNullSafe(F.col("c"))).select(*keys, what.alias("problem"))


# --- proofs, retries and totals ------------------------------------------------------------------


def proved_edits(before: Column, after: Column, find: Column, replace: Column) -> Column:
    """Edits that a recount proves: old text gone and new text come, whichever is fewer."""
    gone = T.count_of(before, find) - T.count_of(after, find)
    come = T.count_of(after, replace) - T.count_of(before, replace)
    return F.least(F.greatest(gone, F.lit(0)), F.greatest(come, F.lit(0)))


def better_retry(first: Column, second: Column, heavy: Column) -> Column:
    """(kept, edits): the second strategy is kept only if it is strictly better, and never for heavy documents."""
    better = ~heavy & (second > first)
    return F.struct(F.when(better, "retry").otherwise("first").alias("kept"), F.when(better, second).otherwise(first).alias("edits"))


def first_strategy(expected: Column, *tried: tuple[str, Column]) -> Column:
    """The name of the first strategy whose count is the expected one, or "unsupported"."""
    return F.coalesce(*(F.when(count == expected, name) for name, count in tried), F.lit("unsupported"))


def loops(rule_find: Column, rule_replace: Column) -> Column:
    """Whether a replacement holds what it replaces, so that the absence of the old text proves nothing."""
    return F.contains(T.rule_key(rule_replace), T.rule_key(rule_find))


def post_verified(docs: DataFrame, rules: DataFrame, text_col: str = "text") -> DataFrame:
    """(rule_id, docs, proved, unresolved) for rules of (rule_id, find, replace): an edit counts as done only if its rule cannot bring the old text back and a recount finds none of it.

    Documents meet only the rules whose text they hold.
    """
    listed = rules.select("rule_id", "find", "replace", loops(F.col("find"), F.col("replace")).alias("loops"))
    had = joined_list(docs.select(F.col(text_col).alias("_text")), listed, F.contains("_text", "find"))
    bad = F.col("loops") | F.contains(F.replace("_text", F.col("find"), F.col("replace")), F.col("find"))
    done = had.groupBy("rule_id").agg(F.count(F.lit(1)).alias("docs"), F.count_if(~bad).alias("proved"), F.count_if(bad).alias("unresolved"))
    return rules.select("rule_id").join(done, "rule_id", "left").na.fill(0, ["docs", "proved", "unresolved"])


def failsafe(original: Column, edited: Column, failed: Column) -> Column:
    """(failed, text): the original where an edit cannot be proved. A null verdict is a failure."""
    bad = F.coalesce(failed, F.lit(True))
    return F.struct(bad.alias("failed"), F.when(bad, original).otherwise(edited).alias("text"))


def all_or_nothing(original: Column, edited: Column, proved: Column, raw: Column) -> Column:
    """(reason, text): the edited text only if every raw hit is a proved one."""
    reason = F.when(raw == 0, "no hit").when(proved != raw, "not all proved")
    return F.struct(reason.alias("reason"), F.when(proved == raw, edited).otherwise(original).alias("text"))


def whole_job(applied: DataFrame, keys: list[str]) -> DataFrame:
    """``applied`` with ``job``: "done", or "failed" for all rows of a job if one that asked for edits was refused. A failed job changes no text.

    ``applied`` has the job's keys, original, text, selected and reason, as ``apply_selected`` gives them.
    """
    refused = applied.filter("selected > 0 and reason is not null").select(*keys).distinct().withColumn("_refused", F.lit(True))
    failed = F.col("_refused").isNotNull()
    return applied.join(refused, keys, "left").withColumns({"job": F.when(failed, "failed").otherwise("done"), "text": F.when(failed, F.col("original")).otherwise(F.col("text"))}).drop("_refused")


def skip_reasons(docs: DataFrame, rules: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, rule_id, reason): a row for every rule that a document refuses: blank, nothing to put, not verifiable, or no hit."""
    why = F.when(T.norm(F.col("find")) == "", "blank").when(F.col("replace") == "", "nothing to put").when(loops(F.col("find"), F.col("replace")), "not verifiable")
    listed = rules.select("rule_id", "find", why.alias("why"))
    own = docs.select("doc_id", F.col(text_col).alias("_text"))
    met = joined_list(own, listed, F.col("why").isNotNull() | ~F.contains("_text", "find"))
    return met.select("doc_id", "rule_id", F.coalesce("why", F.lit("no hit")).alias("reason"))


def kept_invariants(before: Column, after: Column, find: Column, replace: Column) -> Column:
    """(old_gone, new_present, rest_unchanged): old text gone, new text present where the old was, all else unchanged."""
    return F.struct(
        (~F.contains(after, find)).alias("old_gone"),
        (F.contains(before, find) == F.contains(after, replace)).alias("new_present"),
        (F.md5(F.replace(after, replace, find)) == F.md5(before)).alias("rest_unchanged"),
    )


def apply_totals(applied: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, outputs, failures, edits, unresolved, bytes_before, bytes_after) of (before, after, expected, edits, failed).

    A failed document gives no edits and its original; an unresolved one has edits left to do.
    """
    ok = ~F.col("failed")
    return applied.groupBy(*keys).agg(
        F.count_if(ok).alias("outputs"),
        F.count_if("failed").alias("failures"),
        F.sum(F.when(ok, F.col("edits")).otherwise(0)).alias("edits"),
        F.count_if(ok & (F.col("expected") > F.col("edits"))).alias("unresolved"),
        F.sum(F.octet_length("before")).alias("bytes_before"),
        F.sum(F.when(ok, F.octet_length("after")).otherwise(F.octet_length("before"))).alias("bytes_after"),
    )


def unresolved(applied: DataFrame, names: list[str]) -> DataFrame:
    """(*names, state, open): documents that failed or have edits left to do, each by its name."""
    state = F.when(F.col("failed"), "failed").when(F.col("expected") > F.col("edits"), "unresolved")
    return applied.select(*names, state.alias("state"), F.when(~F.col("failed"), F.col("expected") - F.col("edits")).otherwise(F.col("expected")).alias("open")).filter("state is not null")
