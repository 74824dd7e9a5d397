"""Sections of a research report: each a small table made by one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane import constants as C
from corvane.sources.shared import if_small, written


def grade(text: Column, error: Column, method: Column) -> Column:
    """full, thin or snippet by the trimmed length; errors and raw texts are snippets."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(error.isNotNull() | method.eqNullSafe("raw"), "snippet").when(n >= C.FULL_CHARS, "full").when(n >= C.THIN_CHARS, "thin").otherwise("snippet")


def graded(documents: DataFrame) -> DataFrame:
    """documents with grade, worthy and the reason where they are not."""
    df = documents.withColumn("grade", grade(F.col("text"), F.col("error"), F.col("method")))
    bad = F.col("verdict").eqNullSafe("unlikely")
    why = F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), "error")).when(bad, "not relevant").when(F.col("method") == "raw", "search snippet only").when(F.col("grade") != "full", F.format_string("short: %d characters", F.length(F.trim("text"))))
    return df.withColumn("worthy", (F.col("grade") == "full") & ~bad).withColumn("reason", why)


def quality_summary(documents: DataFrame) -> DataFrame:
    """Counts by grade, share of full texts, worthy ones and those left out as irrelevant."""
    df = graded(documents)
    n = F.count("*")
    return df.agg(n.alias("total"), *[F.count_if(F.col("grade") == g).alias(g) for g in ("full", "thin", "snippet")], F.coalesce(F.count_if(F.col("grade") == "full") / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("body_ratio"), F.count_if("worthy").alias("packable"), F.count_if((F.col("grade") == "full") & F.col("verdict").eqNullSafe("unlikely")).alias("irrelevant"))


def relevance_summary(documents: DataFrame) -> DataFrame:
    return documents.agg(F.count("verdict").alias("judged"), F.count_if(F.col("verdict") == "unlikely").alias("unlikely"))


def date_coverage(documents: DataFrame) -> DataFrame:
    """Dated documents, all, their ratio (0 if there are none), first and last date."""
    return documents.agg(F.count("published").alias("known"), F.count("*").alias("total"), F.coalesce(F.count("published") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("ratio"), F.min("published").alias("first"), F.max("published").alias("last"))


def method_tally(documents: DataFrame, methods: tuple[str, ...] = ("subtitle", "api", "readability", "browser", "raw")) -> DataFrame:
    """Documents by method, methods without any included as 0."""
    return documents.agg(*[F.count_if(F.col("method") == m).alias(m) for m in methods])


def site_distribution(documents: DataFrame) -> DataFrame:
    """Documents, texts and errors of each site, and whether a note is due: errors, or fewer texts than documents."""
    df = documents.groupBy("site").agg(F.count("*").alias("n"), F.count_if(F.length(F.trim("text")) > 0).alias("with_text"), F.count("error").alias("errors"))
    return df.withColumn("note", (F.col("errors") > 0) | (F.col("with_text") < F.col("n")))


def kinds(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def excluded(documents: DataFrame) -> DataFrame:
    """Why documents are left out, with counts."""
    return graded(documents).where("NOT worthy").groupBy(F.regexp_replace(F.coalesce("reason", F.lit("other")), r":? ?\d+.*$", "").alias("reason")).agg(F.count("*").alias("n"))


def failures(documents: DataFrame) -> DataFrame:
    """Errors by their first 40 characters."""
    return documents.where("error IS NOT NULL").groupBy(F.substring("error", 1, 40).alias("error")).agg(F.count("*").alias("n"))


def groups(rows: DataFrame, column: str, last: str) -> DataFrame:
    """Groups with their places: largest first, the one called `last` at the end."""
    n = rows.groupBy(F.coalesce(F.col(column), F.lit(last)).alias("name")).agg(F.count("*").alias("n"))
    return n.withColumn("place", F.row_number().over(W.orderBy(F.col("name") == last, F.desc("n"), "name")))  # one row a group


def provider_coverage(results: DataFrame) -> DataFrame:
    return results.groupBy("provider").agg(F.count("*").alias("total"), F.count("published").alias("known"), F.min("rank").alias("best_rank"))


def package(documents: DataFrame) -> DataFrame:
    """Manifest of a package: the path of each worthy document and its front matter."""
    df = graded(documents).where("worthy")
    head = F.concat(F.lit("---\ntitle: "), F.to_json(F.struct("title")), F.lit("\nsite: "), "site", F.lit("\n---\n\n"))
    return df.select("doc_id", F.concat(F.lit("articles/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.length(F.concat(head, "text")).cast("long").alias("n_chars"))


def data_as_of(documents: DataFrame) -> DataFrame:
    """When the newest document was fetched."""
    return documents.agg(F.max("fetched").alias("as_of"))


def date_span(rows: DataFrame, column: str = "published") -> DataFrame:
    """Dated and undated rows, and the months of the first and last date: one month if they are equal, empty without any."""
    month = lambda c: F.date_format(c, "yyyy-MM")
    out = rows.agg(F.count(column).alias("dated"), F.count_if(F.col(column).isNull()).alias("undated"), month(F.min(column)).alias("a"), month(F.max(column)).alias("b"))
    return out.select("dated", "undated", F.when(F.col("a").isNull(), "").when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.concat("a", F.lit(" ~ "), "b")).alias("span"))


def unused(documents: DataFrame, used: DataFrame) -> DataFrame:
    """Documents that are in no graph, with the reason: only a snippet, or too short."""
    rows = documents.join(used.select("doc_id"), "doc_id", "left_anti")
    why = F.when(F.col("method") == "raw", "正文没抓到，只有搜索摘要").otherwise(F.format_string("正文过短（%d 字）", "word_count"))
    return rows.select("doc_id", "title", "site", "method", why.alias("reason"))


def unused_methods(documents: DataFrame, used: DataFrame) -> DataFrame:
    """How many documents of each method are in no graph."""
    return kinds(unused(documents, used), "method")


def overview(documents: DataFrame, copies: DataFrame, concepts: DataFrame, graphed: DataFrame) -> DataFrame:
    """Rows (name, n) of a report's overview; that of copies only if there are any."""
    one = lambda df, name, c: df.agg(c.alias("n")).select(F.lit(name).alias("name"), "n")
    n = F.count("*")
    rows = one(documents, "documents", n).unionByName(one(documents, "sites", F.countDistinct("site"))).unionByName(one(graphed, "graphed", n)).unionByName(one(concepts, "concepts", n))
    return rows.unionByName(one(copies, "copies", n).where("n > 0"))


def sources(results: DataFrame, documents: DataFrame, copies: DataFrame) -> DataFrame:
    """Every result with what was fetched for it: body (grade and words, and whose copy it is) or that nothing was.

    documents: doc_id, title, grade, word_count; copies: doc_id, duplicate_of;
    results: doc_id of the document to look for. All are equi-joins on ids. Titles
    are found for the copies among the results only: a title can be a whole text,
    and documents that are no copy would meet under one null.
    """
    copies = written(copies.join(results.select("doc_id").distinct(), "doc_id", "left_semi"), "copies")
    firsts = if_small(written(copies.select("duplicate_of").distinct(), "firsts"))
    titles = documents.select(F.col("doc_id").alias("duplicate_of"), F.col("title").alias("first_title")).join(firsts, "duplicate_of", "left_semi")
    docs = documents.select("doc_id", "grade", "word_count").join(copies.join(titles, "duplicate_of", "left"), "doc_id", "left")
    note = F.when(F.col("duplicate_of").isNotNull(), F.concat(F.lit(" · 与《"), F.coalesce("first_title", F.lit("…")), F.lit("》同源"))).otherwise("")
    label = F.when(F.col("grade") == "full", "正文完整").when(F.col("grade") == "thin", "正文很短").otherwise("仅摘要")
    body = F.when(F.col("grade").isNull(), "未抓取").otherwise(F.concat(label, F.lit(" "), F.col("word_count").cast("string"), F.lit(" 字"), note))
    rows = results.join(docs, "doc_id", "left")
    return rows.select(*results.columns, body.alias("body"), "duplicate_of")


def healthy(checks: DataFrame) -> DataFrame:
    """Whether all required checks (name, ok, required) are ok; so they are if none is required."""
    return checks.agg(F.coalesce(F.bool_and(F.when(F.col("required"), F.col("ok"))), F.lit(True)).alias("healthy"), F.count_if(~F.col("ok")).alias("failed"))


def stale(sessions: DataFrame, now: str, days: int = 7) -> DataFrame:
    """Sessions with results that are `days` old or older."""
    return sessions.where((F.col("n_results") > 0) & (F.datediff(F.lit(now).cast("date"), F.col("updated").cast("date")) >= days))


def markdown(documents: DataFrame) -> str:
    """A report of bounded size: summaries and the largest groups as Markdown tables."""
    def table(df: DataFrame, most: int = 50) -> str:
        rows = df.limit(most).collect()
        cell = lambda v: str("" if v is None else v).replace("|", "\\|").replace("\n", " ")
        return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])

    parts = (("Quality", quality_summary(documents)), ("Relevance", relevance_summary(documents)), ("Dates", date_coverage(documents)), ("Sites", site_distribution(documents).orderBy(F.desc("n"), "site")), ("Left out", excluded(documents).orderBy(F.desc("n"), "reason")))
    return "# Report\n\n" + "\n\n".join(f"## {name}\n\n{table(df)}" for name, df in parts) + "\n"
