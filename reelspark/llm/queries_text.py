"""Queries on packing, mixing and spam pages. Tokenizers and page rules have no SQL form, the measures of a page have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.llm import mixing, packing, spam
from reelspark.llm.spam import SPAM_SHARE, page_measures, spam_pages, spam_shares
from reelspark.llm.tokens import with_token_counts
from reelspark.session import materialize, spread, table


def _capacities(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    rows = table(spark, sf_dir, "pack_capacities").select("capacity_id", "capacity_tokens").limit(packing.MAX_CAPACITIES + 1).collect()
    return [(r[0], r[1]) for r in rows]


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = with_token_counts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), out="doc_tokens")
    return packing.pack(sizes, _capacities(spark, sf_dir))


def p8_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contents of every container: which part of which document lies where."""
    return _packed(spark, sf_dir)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every container with its used and unused tokens."""
    return packing.containers(_packed(spark, sf_dir))


def p8_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers, lower bound over all parts, used and unused tokens."""
    packed = materialize(_packed(spark, sf_dir))
    known = F.create_map(*[F.lit(x) for i, n in packing.bounds(packed).items() for x in (i, n)])
    return (
        packing.containers(packed)
        .groupBy("capacity_id", "capacity")
        .agg(
            F.count(F.lit(1)).alias("n_containers"),
            F.count(F.when(F.col("certified"), 1)).alias("n_certified"),
            F.sum("n_parts").alias("n_parts"),
            F.sum("used_tokens").alias("used_tokens"),
            F.sum("unused_tokens").alias("unused_tokens"),
        )
        .withColumn("lower_bound", known[F.col("capacity_id")].cast("bigint"))
    )


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(with_token_counts(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix with their number of uses."""
    return mixing.mix(_sized(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted and actual shares of the sources for a quarter, a half and all of the largest mix."""
    docs, targets = _sized(spark, sf_dir), table(spark, sf_dir, "mix_targets")
    return mixing.shares(mixing.mix(docs, targets, (0.25, 0.5, 1.0)), docs, targets)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword-stuffed, link-list and product-tag pages."""
    return spam_pages(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")))


def p10_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, spam pages and junk characters per language told from the text."""
    shares = spam_shares(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")))
    return shares.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count(F.when(F.col("junk_share") > SPAM_SHARE, 1)).alias("n_spam"),
        F.sum("n_chars").alias("n_chars"),
        F.sum("junk_chars").alias("junk_chars"),
    )


def p10_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the thresholds of spam pages apply to: words, forms, separators and recurring phrases and lines of every page."""
    return page_measures(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")))


QUERIES = {
    "p8_contents": p8_contents,
    "p8_containers": p8_containers,
    "p8_summary": p8_summary,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_by_language": p10_by_language,
    "p10_measures": p10_measures,
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _replaced(column: str, pattern: str, by: str) -> str:
    return f"regexp_replace({column}, {_quoted(pattern)}, {_quoted(by)}, 'g')"


def _phrases(name: str, words: int) -> str:
    """Words of each page in recurring phrases of so many words."""
    w = spam.PHRASE_WINDOW
    key = " || chr(1) || ".join(["tok", *[f"lead(tok, {i}) OVER o" for i in range(1, words)]])
    return f"""
{name}_all AS (SELECT rid, ord, pos, line, {key} AS k, lead(line, {words - 1}) OVER o AS last FROM plain WINDOW o AS (PARTITION BY rid ORDER BY ord)
), {name}_hot AS (
  SELECT rid, ord, lead(pos, 2) OVER k - pos <= {w} OR lead(pos, 1) OVER k - lag(pos, 1) OVER k <= {w} OR pos - lag(pos, 2) OVER k <= {w} AS hot
  FROM {name}_all WHERE last = line WINDOW k AS (PARTITION BY rid, k ORDER BY pos)
), {name} AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(ord, ord + {words})) FROM {name}_hot WHERE hot) GROUP BY 1)"""


def _measures_sql() -> str:
    mark = spam._OPEN, spam._CLOSE, spam._FORM, spam._STOP, spam._LINE
    opened, closed, form, stop, line = mark
    clean = _replaced("nfc_normalize(coalesce(text, ''))", f"[{opened}-{line}]", " ")
    marked = _replaced("t", spam.FORM, f"{opened}\\0{closed}")
    steps = [(f"{opened}[^{closed}]*{closed}", form), ("\n", line), (r"[.!?…]+[\"”»’)\]]*(?:[ \t]|$)", stop), (r"[|»«·•›‹~_¦/]|[ \t][-–—][ \t]", "|"), ("[,;]", ",")]
    text = "m"
    for pattern, by in steps:
        text = _replaced(text, pattern, f" {by} ")
    text = _replaced(text, f"[^\\p{{L}}\\p{{M}}\\p{{N}}|,{form}-{line}]+", " ")
    special = ", ".join(_quoted(x) for x in (form, stop, line, "|", ","))
    return f"""WITH a AS (SELECT row_number() OVER () AS rid, doc_id, {clean} AS t FROM documents
), b AS (SELECT rid, doc_id, {marked} AS m FROM a
), c AS (SELECT rid, doc_id, {text} AS m,
  coalesce(list_sum(list_transform(regexp_extract_all(m, {_quoted(f"{opened}[^{closed}]*{closed}")}), lambda x: length({_replaced("x", r"\s+", "")}) - 2)), 0) AS form_chars FROM b
), tok AS (SELECT rid, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS i FROM (SELECT rid, regexp_extract_all(lower(m), '[^ ]+') AS toks FROM c)
), kinds AS (SELECT *, sum(CASE WHEN tok = {_quoted(line)} THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS line, tok NOT IN ({special}) AS word FROM tok
), words AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY i) AS pos, regexp_matches(tok, '^\p{{N}}+$') AS num FROM kinds WHERE word
), plain AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY i) AS ord FROM words WHERE NOT num
), {_phrases("bi", 2)}, {_phrases("tri", 3)}, lines AS (
  SELECT rid, n, count(*) OVER (PARTITION BY rid, k) AS times FROM (SELECT rid, line, count(*) AS n, string_agg(tok, ' ' ORDER BY ord) AS k FROM plain GROUP BY ALL)
), again AS (SELECT rid, sum(n) AS n FROM lines WHERE times >= {spam.RECURS} GROUP BY 1
), top AS (SELECT rid, max(n) AS n FROM (SELECT rid, tok, count(*) AS n FROM plain GROUP BY ALL) GROUP BY 1
), sized AS (SELECT rid, count(*) FILTER (NOT num) AS n, count(DISTINCT line) AS lines, sum(length(tok)) AS chars FROM words GROUP BY 1
), sep AS (SELECT rid, count(*) AS n FROM tok WHERE tok IN ('|', ',') GROUP BY 1)
SELECT doc_id, CAST(coalesce(sized.n, 0) AS BIGINT) AS n_words, CAST(coalesce(sized.lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(sep.n, 0) AS BIGINT) AS n_separators,
       CAST(form_chars AS BIGINT) AS form_chars, CAST(coalesce(sized.chars, 0) AS BIGINT) AS word_chars, CAST(coalesce(top.n, 0) AS BIGINT) AS top_word_n,
       CAST(coalesce(bi.n, 0) AS BIGINT) AS bigram_words, CAST(coalesce(tri.n, 0) AS BIGINT) AS trigram_words, CAST(coalesce(again.n, 0) AS BIGINT) AS line_words
FROM c LEFT JOIN sized USING (rid) LEFT JOIN sep USING (rid) LEFT JOIN top USING (rid) LEFT JOIN bi USING (rid) LEFT JOIN tri USING (rid) LEFT JOIN again USING (rid)"""


ORACLES = {"p10_measures": _measures_sql()}
