"""Pairing and corpus metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.catalog.base import docs, sql_words
from corpusloom.functions.text import words
from corpusloom.operators.evaluation import (
    MAX_ORDER, bleu, combine, corpus_stats, gram_stats, log_metrics, metric_log, pair, rouge_l, rouge_n, sacrebleu, tokens_13a,
    tokens_rouge, unpaired,
)
from corpusloom.operators.language_model import perplexity
from corpusloom.operators.sampling import with_split
from corpusloom.plans.model_eval import metric_suites
from corpusloom.plans.ranking import with_rank
from corpusloom.session import materialize, scratch_path
from corpusloom.sources.documents import table

ORDERS = range(1, MAX_ORDER + 1)


def text_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as reference; the prediction misses each seventh word."""
    return as_pairs(docs(spark, sf))


def as_pairs(rows: DataFrame) -> DataFrame:
    kept = F.filter(words(F.col("text")), lambda w, i: i % 7 != 3)
    return rows.select(
        "doc_id", F.array_join(kept, " ").alias("generated_text"), F.col("text").alias("reference_text")
    )


_PAIRS = (
    f"pairs AS (SELECT doc_id, array_to_string(list_filter({sql_words('text')}, lambda w, i: (i - 1) % 7 <> 3), ' ') AS generated_text, "
    "text AS reference_text FROM documents)"
)


def _sql_13a(x: str) -> str:
    for old, new in (("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"), ("'&quot;'", "'\"'"),
                     ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'")):
        x = f"replace({x}, {old}, {new})"
    x = f"(' ' || {x} || ' ')"
    for pattern, out in (("([\\{-\\~\\[-\\` -\\&\\(-\\+\\:-\\@\\/])", " \\1 "), ("([^0-9])([\\.,])", "\\1 \\2 "),
                         ("([\\.,])([^0-9])", " \\1 \\2"), ("([0-9])(-)", "\\1 \\2 ")):
        x = f"regexp_replace({x}, '{pattern}', '{out}', 'g')"
    return sql_words(x)


def _sql_rouge(x: str) -> str:
    return sql_words(f"regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g')")


def _sql_stats(tokenize, orders) -> str:
    """CTEs up to per_pair(doc_id, n, matches, total, ref_total)."""
    ahead = "".join(f", lead(w, {i}) OVER o AS w{i}" for i in range(1, max(orders)))
    grams = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS n, side, " + " || ' ' || ".join(["w", *(f"w{i}" for i in range(1, n))]) + " AS gram FROM ahead"
        + (f" WHERE w{n - 1} IS NOT NULL" if n > 1 else "")
        for n in orders
    )
    values = ", ".join(f"({n})" for n in orders)
    return (
        f"{_PAIRS}, sides AS (SELECT doc_id, 'p' AS side, {tokenize('generated_text')} AS t FROM pairs UNION ALL "
        f"SELECT doc_id, 'r', {tokenize('reference_text')} FROM pairs), "
        "flat AS (SELECT doc_id, side, unnest(t) AS w, generate_subscripts(t, 1) AS pos FROM sides), "
        f"ahead AS (SELECT doc_id, side, w{ahead} FROM flat WINDOW o AS (PARTITION BY doc_id, side ORDER BY pos)), grams AS ({grams}), "
        "counts AS (SELECT doc_id, n, gram, count(*) FILTER (side = 'p') AS p, count(*) FILTER (side = 'r') AS r FROM grams GROUP BY ALL), "
        "sums AS (SELECT doc_id, n, sum(least(p, r)) AS m, sum(p) AS p, sum(r) AS r FROM counts GROUP BY ALL), "
        f"per_pair AS (SELECT d.doc_id, v.n, coalesce(m, 0)::BIGINT AS matches, coalesce(p, 0)::BIGINT AS total, coalesce(r, 0)::BIGINT AS ref_total "
        f"FROM pairs d CROSS JOIN (VALUES {values}) v(n) LEFT JOIN sums s ON s.doc_id = d.doc_id AND s.n = v.n)"
    )


_BLEU_STATS = (
    f"{_sql_stats(_sql_13a, ORDERS)}, stats AS (SELECT n, sum(matches)::BIGINT AS matches, sum(total)::BIGINT AS total, "
    "sum(ref_total)::BIGINT AS ref_total FROM per_pair GROUP BY n), "
    "wide AS (SELECT " + ", ".join(f"max(matches) FILTER (n = {n}) AS m{n}, max(total) FILTER (n = {n}) AS t{n}" for n in ORDERS)
    + ", max(ref_total) FILTER (n = 1) AS ref_len FROM stats), "
    "bp AS (SELECT *, t1 AS pred_len, CASE WHEN t1 > ref_len THEN 1.0 ELSE exp(1 - ref_len / t1::DOUBLE) END AS bp FROM wide)"
)
_BLEU = ("bp * exp((" + " + ".join(f"ln(m{n} / t{n})" for n in ORDERS) + ") / 4)")


@query("eval_pair", f"WITH {_PAIRS} SELECT doc_id, generated_text, reference_text FROM pairs")
def eval_pair(spark: SparkSession, sf: str) -> DataFrame:
    rows = text_pairs(spark, sf)
    return pair(rows.select("doc_id", "generated_text"), rows.select("doc_id", "reference_text"), "doc_id")


@query("eval_unpaired", "SELECT CASE WHEN l.doc_id IS NULL THEN 'reference_only' ELSE 'both' END AS side, count(*) AS n "
                        "FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1")
def eval_unpaired(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id")
    return unpaired(table(spark, sf, "labels").select("doc_id").distinct(), rows, "doc_id")


def bleu_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = text_pairs(spark, sf)
    p, r = tokens_13a(F.col("generated_text")), tokens_13a(F.col("reference_text"))
    return corpus_stats(gram_stats(rows, "doc_id", p, r, ORDERS))


@query("met_bleu_stats", f"WITH {_BLEU_STATS} SELECT n, matches, total, ref_total FROM stats")
def met_bleu_stats(spark: SparkSession, sf: str) -> DataFrame:
    return bleu_stats(spark, sf)


def rounded(rows: DataFrame, digits: int = 9) -> DataFrame:
    doubles = {f.name for f in rows.schema if f.dataType.typeName() == "double"}
    return rows.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in rows.columns])


@query("met_bleu", f"WITH {_BLEU_STATS} SELECT round({_BLEU}, 9) AS bleu, "
                   + ", ".join(f"round(m{n} / t{n}, 9) AS precision_{n}" for n in ORDERS)
                   + ", round(bp, 9) AS brevity_penalty, round(pred_len / ref_len, 9) AS length_ratio, "
                     "pred_len AS translation_length, ref_len AS reference_length FROM bp")
def met_bleu(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bleu(bleu_stats(spark, sf)))


@query("met_sacrebleu", f"WITH {_BLEU_STATS} SELECT round(100 * {_BLEU}, 9) AS score, "
                        + ", ".join(f"m{n} AS counts_{n}, t{n} AS totals_{n}, round(100.0 * m{n} / t{n}, 9) AS precision_{n}" for n in ORDERS)
                        + ", round(bp, 9) AS bp, pred_len AS sys_len, ref_len FROM bp")
def met_sacrebleu(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(sacrebleu(bleu_stats(spark, sf)))


def rouge12(spark: SparkSession, sf: str) -> DataFrame:
    rows = text_pairs(spark, sf)
    p, r = tokens_rouge(F.col("generated_text")), tokens_rouge(F.col("reference_text"))
    return rouge_n(gram_stats(rows, "doc_id", p, r, (1, 2)), "doc_id")


_ROUGE = (
    f"{_sql_stats(_sql_rouge, (1, 2))}, f AS (SELECT doc_id, n, CASE WHEN total + ref_total = 0 THEN 0.0 ELSE "
    "2 * matches / (total + ref_total) END AS f FROM per_pair)"
)


@query("met_rouge12", f"WITH {_ROUGE} SELECT doc_id, n, round(f, 9) AS f FROM f")
def met_rouge12(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rouge12(spark, sf))


@query("met_rouge_corpus", f"WITH {_ROUGE} SELECT n, count(*) AS n_pairs, round(avg(f), 6) AS f FROM f GROUP BY n")
def met_rouge_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return rouge12(spark, sf).groupBy("n").agg(F.count("*").alias("n_pairs"), F.round(F.avg("f"), 6).alias("f"))


def line_pairs(rows: DataFrame) -> DataFrame:
    """Every text as reference; the prediction misses each seventh word of every line."""
    kept = F.transform(F.split("text", "\n"), lambda line: F.array_join(F.filter(words(line), lambda w, i: i % 7 != 3), " "))
    return rows.select("doc_id", F.array_join(kept, "\n").alias("generated_text"), F.col("text").alias("reference_text"))


# A prediction that misses words is a subsequence of its reference: its LCS is the prediction itself, as a whole and line by line.
@query("met_rougeL", "WITH cut AS (SELECT doc_id, text, array_to_string(list_transform(string_split(text, chr(10)), lambda l: array_to_string("
                     f"list_filter({sql_words('l')}, lambda w, i: (i - 1) % 7 <> 3), ' ')), chr(10)) AS kept FROM documents), "
                     f"n AS (SELECT doc_id, len({_sql_rouge('kept')}) AS p, len({_sql_rouge('text')}) AS r FROM cut) SELECT doc_id, "
                     "round(CASE WHEN p = 0 THEN 0.0 ELSE 2 * p / (p + r) END, 9) AS rouge_l, "
                     "round(CASE WHEN p = 0 THEN 0.0 ELSE 2 * p / (p + r) END, 9) AS rouge_lsum FROM n")
def met_rouge_l(spark: SparkSession, sf: str) -> DataFrame:
    rows = line_pairs(docs(spark, sf))
    return rounded(rouge_l(rows, "doc_id", F.col("generated_text"), F.col("reference_text")))


# The table of the LCS, a row at a time: each cell is the running maximum of the cell above and, on equal words, one more than the
# cell before that.
@query("met_rougeL_pairs", "WITH RECURSIVE items AS (SELECT item_id, text, coalesce(lead(text) OVER (ORDER BY item_id), first_value(text) OVER "
                           f"(ORDER BY item_id)) AS other FROM benchmark), toks AS (SELECT item_id, {_sql_rouge('text')} AS r, "
                           f"{_sql_rouge('other')} AS p FROM items), dp AS (SELECT item_id, 0 AS i, list_transform(p, lambda w: 0) AS cells FROM toks "
                           "UNION ALL SELECT item_id, i, list_transform(range(1, len(up) + 1), lambda j: list_max(up[1:j])) FROM (SELECT d.item_id, "
                           "d.i + 1 AS i, list_transform(t.p, lambda w, j: greatest(d.cells[j], CASE WHEN w = t.r[d.i + 1] THEN 1 + "
                           "CASE WHEN j > 1 THEN d.cells[j - 1] ELSE 0 END ELSE 0 END)) AS up FROM dp d JOIN toks t USING (item_id) WHERE d.i < len(t.r))) "
                           "SELECT t.item_id, round(2 * d.cells[-1] / (len(t.p) + len(t.r)), 9) AS rouge_l, "
                           "round(2 * d.cells[-1] / (len(t.p) + len(t.r)), 9) AS rouge_lsum FROM toks t JOIN dp d ON d.item_id = t.item_id AND d.i = len(t.r)")
def met_rouge_l_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Whole benchmark texts, as one line each, against the next item's."""
    items = table(spark, sf, "benchmark").select("item_id", F.translate("text", "\n", " ").alias("text"))
    ranked = with_rank(items.select("item_id"), ["item_id"])
    numbered = materialize(items.join(ranked, "item_id"), "items")
    n = numbered.count()
    others = numbered.select((F.col("rank") % n + 1).alias("next"), F.col("text").alias("reference_text"), "item_id")
    pairs = others.join(numbered.select(F.col("rank").alias("next"), F.col("text").alias("generated_text")), "next")
    return rounded(rouge_l(pairs, "item_id", F.col("generated_text"), F.col("reference_text")))


_PERPLEXITY = (
    "ranked AS (SELECT *, row_number() OVER (ORDER BY md5('3:' || doc_id::VARCHAR), doc_id) AS r, count(*) OVER () AS n FROM documents), "
    f"toks AS (SELECT doc_id, r <= ceil(round(n * 0.05, 9)) AS test, {sql_words('lower(text)')} AS t FROM ranked), "
    "uni AS (SELECT unnest(t) AS a, count(*) AS c FROM toks WHERE NOT test GROUP BY 1), "
    "grams AS (SELECT doc_id, test, unnest(t[1 : len(t) - 1]) AS a, unnest(t[2 : len(t)]) AS b FROM toks WHERE len(t) > 1), "
    "bi AS (SELECT a, b, count(*) AS c FROM grams WHERE NOT test GROUP BY ALL), "
    "scored AS (SELECT g.doc_id, ln((coalesce(bi.c, 0) + 1) / (coalesce(uni.c, 0) + (SELECT count(*) FROM uni))) AS lp "
    "FROM grams g LEFT JOIN bi ON bi.a = g.a AND bi.b = g.b LEFT JOIN uni ON uni.a = g.a WHERE g.test), "
    "ppl AS (SELECT doc_id, count(*) AS n_bigrams, exp(-avg(lp)) AS perplexity FROM scored GROUP BY doc_id)"
)


def held_out_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize(with_split(docs(spark, sf).select("doc_id", "text"), "doc_id"), "split")
    return perplexity(rows.where("split = 'train'"), rows.where("split = 'test'"), "doc_id")


@query("met_perplexity", f"WITH {_PERPLEXITY} SELECT doc_id, n_bigrams, round(perplexity, 4) AS perplexity FROM ppl")
def met_perplexity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(held_out_perplexity(spark, sf), 4)


def _sql_long(suite: str, source: str, cells: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{suite}' AS suite, '{suite}_{name}' AS metric, round(({x})::DOUBLE, 6) AS value FROM {source}" for name, x in cells.items()
    )


_COMBINED = _sql_long("bleu", "bp", {
    "bleu": _BLEU, **{f"precision_{n}": f"m{n} / t{n}" for n in ORDERS}, "brevity_penalty": "bp",
    "length_ratio": "pred_len / ref_len", "translation_length": "pred_len", "reference_length": "ref_len",
}) + " UNION ALL " + _sql_long("sacrebleu", "bp", {
    "score": f"100 * {_BLEU}", **{f"counts_{n}": f"m{n}" for n in ORDERS}, **{f"totals_{n}": f"t{n}" for n in ORDERS},
    **{f"precision_{n}": f"100.0 * m{n} / t{n}" for n in ORDERS}, "bp": "bp", "sys_len": "pred_len", "ref_len": "ref_len",
})


@query("met_combined", f"WITH {_BLEU_STATS} {_COMBINED}")
def met_combined(spark: SparkSession, sf: str) -> DataFrame:
    stats = materialize(bleu_stats(spark, sf), "grams")
    return rounded(combine(("bleu", bleu(stats)), ("sacrebleu", sacrebleu(stats))), 6)


# Every part has its own query with SQL; here they run as one suite.
@query("met_suites")
def met_suites(spark: SparkSession, sf: str) -> DataFrame:
    rows = materialize(with_split(docs(spark, sf).select("doc_id", "text"), "doc_id"), "split")
    test = as_pairs(rows.where("split = 'test'"))
    return rounded(metric_suites(test, "doc_id", training=rows.where("split = 'train'")), 6)


@query("met_history", f"WITH {_BLEU_STATS}, one AS ({_COMBINED}) SELECT suite, metric, value, 'run' AS run, s.step::INT AS step "
                      "FROM one, (VALUES (1000), (2000)) s(step)")
def met_history(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "metrics")
    metrics = materialize(met_combined(spark, sf), "combined")
    # The evaluation of the first step is repeated.
    for step in (1000, 2000, 1000):
        log_metrics(metrics, path, "run", step)
    return metric_log(spark, path)
