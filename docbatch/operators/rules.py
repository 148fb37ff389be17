"""Rules over documents: which rules apply, where they hit, and how exact and flexible counts combine."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docbatch.functions import text as T
from docbatch.functions.rows import held, in_parts

#: Needles that are looked for one by one, each by an expression; longer lists are compiled to an automaton.
FEW = 24
#: Needles of one automaton. A longer list makes several, and the rows are read once for each.
MOST_COMPILED = 100_000


def distinct_rules(rules: DataFrame) -> DataFrame:
    """Rules that are not blank, the first of each folded key."""
    kept = rules.filter(T.norm(F.col("find")) != "").withColumn("rule_key", T.rule_key(F.col("find")))
    first = Window.partitionBy("rule_key").orderBy("rule_id")
    return kept.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r")


def active_rules(rules: DataFrame) -> DataFrame:
    """Rules that may be applied: something to find and something to put."""
    return rules.filter((T.norm(F.col("find")) != "") & (F.coalesce(F.col("replace"), F.lit("")) != ""))


class NeedleCounter:
    """Counts the non-overlapping occurrences of many needles in one pass over a text, by an Aho-Corasick automaton."""

    def __init__(self, needles: Iterable[tuple[int, str]]):
        names: dict[str, list[int]] = {}
        for rule, needle in needles:
            if needle:
                names.setdefault(needle, []).append(rule)
        self.automaton = ahocorasick.Automaton()
        for place, (needle, rules) in enumerate(names.items()):
            self.automaton.add_word(needle, (place, len(needle), rules))
        self.automaton.make_automaton() if names else None

    def counts(self, text: str) -> Iterator[tuple[int, int]]:
        """(rule, occurrences). Of occurrences of one needle that overlap the first counts, as a search from left to right finds them."""
        if not len(self.automaton):
            return
        found: dict[int, list] = {}
        for last, (place, size, rules) in self.automaton.iter(text):
            seen = found.get(place)
            if seen is None:
                found[place] = [last, 1, rules]
            elif last - size >= seen[0]:
                seen[0] = last
                seen[1] += 1
        for _, n, rules in found.values():
            for rule in rules:
                yield rule, n


@lru_cache(maxsize=1)
def _compiled(name: str, sent) -> NeedleCounter:
    """The automaton of one list, built once in each worker."""
    return NeedleCounter(sent.value)


def needle_counts(rows: DataFrame, keys: list[str], text: str, needles: DataFrame) -> DataFrame:
    """(*keys, rule_id, n): how often each needle of (rule_id, needle) occurs in the texts of each key; needles that do not are left out.

    A list of ``FEW`` needles at most becomes expressions. A longer one is sent to the executors and compiled there, and
    each text is read once, whatever the number of needles; beyond ``MOST_COMPILED`` it is once for each part of the
    list. What a batch finds is added up before it is shuffled.
    """
    some = needles.limit(FEW + 1).collect()
    if len(some) <= FEW:
        counts = F.array(*(F.struct(F.lit(r.rule_id).alias("rule_id"), F.when(F.contains(F.col(text), F.lit(r.needle)), T.count_of(F.col(text), F.lit(r.needle))).otherwise(0).alias("n")) for r in some))
        found = rows.select(*keys, F.explode(F.filter(counts, lambda c: c["n"] > 0) if some else F.expr("cast(array() as array<struct<rule_id: int, n: bigint>>)")).alias("c")).select(*keys, "c.*")
    else:
        parts = -(-needles.count() // MOST_COMPILED)
        part = F.pmod(F.xxhash64("rule_id", "needle"), F.lit(parts))
        found = reduce(DataFrame.unionByName, (_counted(rows, keys, text, needles.filter(part == i) if parts > 1 else needles) for i in range(parts)))
    return found.groupBy(*keys, "rule_id").agg(F.sum("n").alias("n"))


def _counted(rows: DataFrame, keys: list[str], text: str, needles: DataFrame) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast([(r.rule_id, r.needle) for r in needles.select("rule_id", "needle").collect()])
    name, kind = uuid.uuid4().hex, needles.schema["rule_id"].dataType.simpleString()
    given = rows.select(*keys).schema

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _compiled(name, sent)
        for batch in batches:
            own = list(zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True))
            total: dict[tuple, list[int]] = {}
            for i, value in enumerate(batch.column(len(keys))):
                for rule, n in counter.counts(value.as_py() or ""):
                    held = total.setdefault((own[i], rule), [i, 0])
                    held[1] += n
            at = pa.array([i for i, _ in total.values()], pa.int64())
            columns = [batch.column(k).take(at) for k in range(len(keys))]
            rules = pa.array([rule for _, rule in total], pa.int64()).cast(pa.int32() if kind == "int" else pa.int64())
            yield pa.RecordBatch.from_arrays([*columns, rules, pa.array([n for _, n in total.values()], pa.int64())], names=[*keys, "rule_id", "n"])

    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given)
    return rows.select(*keys, text).mapInArrow(run, f"{shape}, rule_id {kind}, n long")


def line_hits(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, rule_id, page_no, n): exact hits of every rule by page; a line is one unit of search."""
    needles = distinct_rules(rules).select("rule_id", T.norm(F.col("find")).alias("needle"))
    return needle_counts(lines.withColumn("s", T.norm(F.col("line"))), ["doc_id", "page_no"], "s", needles).select("doc_id", "rule_id", "page_no", "n")


def page_hits(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, rule_id, page_no, n): flexible hits, in which separators do not count and lines do not end a match."""
    needles = distinct_rules(rules).select("rule_id", T.flexible_key(F.col("find")).alias("needle")).filter("needle <> ''")
    return needle_counts(pages.withColumn("s", T.flexible_key(F.col("text"))), ["doc_id", "page_no"], "s", needles).select("doc_id", "rule_id", "page_no", "n")


def frequent_openings(lines: DataFrame, words: int, most: int) -> DataFrame:
    """(rule_id, find, replace): the ``most`` most frequent first words of lines, numbered by their rank, to be replaced by nothing."""
    # fewer words: what stands before the last space that is wanted is the whole line
    rows = held(lines, "s", T.norm(F.col("line")))
    found = (rows.filter(F.substring_index("s", " ", words - 1) != F.col("s")) if words > 1 else rows).select(F.substring_index("s", " ", words).alias("find"))
    top = found.groupBy("find").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "find").limit(most)
    ranked = top.withColumn("rule_id", F.row_number().over(Window.orderBy(F.desc("n"), "find")))  # ``most`` rows
    return ranked.select("rule_id", "find", F.lit("").alias("replace"))


def by_document(hits: DataFrame) -> DataFrame:
    """(doc_id, rule_id, hits, pages): sums and the list of pages with hits."""
    return hits.groupBy("doc_id", "rule_id").agg(F.sum("n").alias("hits"), F.array_join(F.sort_array(F.collect_set("page_no")), ",").alias("pages"))


def reinforced(exact: DataFrame, flexible: DataFrame) -> DataFrame:
    """Flexible counts replace exact ones where they find more; ``added`` says how many."""
    both = exact.withColumnsRenamed({"hits": "exact_hits", "pages": "exact_pages"}).join(flexible.withColumnsRenamed({"hits": "flex_hits", "pages": "flex_pages"}), ["doc_id", "rule_id"], "full")
    e, f = F.coalesce("exact_hits", F.lit(0)), F.coalesce("flex_hits", F.lit(0))
    return both.select("doc_id", "rule_id", F.greatest(e, f).alias("hits"), F.when(f > e, F.col("flex_pages")).otherwise(F.col("exact_pages")).alias("pages"), F.greatest(f - e, F.lit(0)).alias("added"))


def without_hit(docs: DataFrame, rules: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, *columns of rules): for each document the rules of which ``hits`` (doc_id, rule_id) has none.

    The rules that a document has come together at it and are taken from the list, which is counted and goes along in parts
    if it is long; only rules without a hit become rows.
    """
    has = hits.groupBy("doc_id").agg(F.collect_set("rule_id").alias("_has"))
    held = docs.select("doc_id").join(has, "doc_id", "left").withColumn("_has", F.coalesce("_has", F.array().cast(has.schema["_has"].dataType)))
    out = []
    for part in in_parts(rules):
        listed = part.agg(F.sort_array(F.collect_list(F.struct(*rules.columns))).alias("_rules"))
        open_ = F.filter("_rules", lambda r: ~F.array_contains("_has", r["rule_id"]))
        out.append(held.join(F.broadcast(listed)).select("doc_id", F.explode(open_).alias("_rule")).select("doc_id", "_rule.*"))
    return reduce(DataFrame.unionByName, out)


def first_pages(docs: DataFrame, *hits: DataFrame) -> DataFrame:
    """(doc_id, page_no): the page to show first: of the first rule with hits, the first page of the first kind of hits that it has; 1 without hits.

    Each of ``hits`` has (doc_id, rule_id, page_no), in order of kind: text, annotations, recognised text.
    """
    every = reduce(DataFrame.unionByName, (h.select("doc_id", F.struct("rule_id", F.lit(kind).alias("kind"), "page_no").alias("at")) for kind, h in enumerate(hits)))
    first = every.groupBy("doc_id").agg(F.min("at").alias("at"))
    return docs.select("doc_id").join(first, "doc_id", "left").select("doc_id", F.coalesce("at.page_no", F.lit(1)).alias("page_no"))


def reasons(hits: DataFrame, *named: tuple[str, F.Column]) -> DataFrame:
    """(doc_id, reasons): for each document the names of the first condition that each of its rows meets, once and in order, or "none"."""
    reason = F.coalesce(*(F.when(condition, name) for name, condition in named))
    found = F.array_join(F.sort_array(F.collect_set(reason)), ", ")
    return hits.groupBy("doc_id").agg(F.coalesce(F.nullif(found, F.lit("")), F.lit("none")).alias("reasons"))


def ambiguous_patterns(patterns: DataFrame, letters: int = 16) -> DataFrame:
    """(prefix, n, finds, replaces, ambiguous) of search texts of (find, replace) that share their first letters: one text with several replacements is refused."""
    rows = patterns.filter(F.length("find") >= letters).withColumn("prefix", F.substring("find", 1, letters))
    out = rows.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("find").alias("finds"), F.countDistinct("replace").alias("replaces"))
    return out.filter("n > 1").withColumn("ambiguous", F.col("replaces") > 1)


def spaced_counts(text: F.Column, find: str, most: int = 4) -> F.Column:
    """(n, exact): hits of a text in which a space stands for one to ``most`` spaces, and of the text as it is."""
    pattern = T.quoted(find).replace(" ", f" {{1,{most}}}")
    return F.struct(F.regexp_count(text, F.lit(pattern)).cast("long").alias("n"), T.count_of(text, F.lit(find)).alias("exact"))
