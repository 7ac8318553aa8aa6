"""Commits and issues as documents: search, file history, related commits and output within a token budget.

Documents delivered twice count once by doc_id; null texts match nothing and cost nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions.embedding import embed, hashed
from codeloom.operators import vectors as V
from codeloom.operators.texts import once, relevance, title_and_body


def file_history(docs: DataFrame, renames: DataFrame | None = None, n: int = 20) -> DataFrame:
    """(file, position, doc_id, created_at): the newest n commits of each file. With `renames` (path, previous_path) the
    commits of a file's earlier names count as its own, names being followed until no earlier one is known."""
    c = once(docs).filter("kind = 'commit' and file is not null").select("doc_id", "file", "created_at")
    if renames is not None:
        c = c.join(earlier_names(renames), c["file"] == F.col("earlier"), "left")
        c = c.select("doc_id", F.explode(F.array_distinct(F.array("file", F.coalesce("path", "file")))).alias("file"), "created_at").distinct()
    w = Window.partitionBy("file").orderBy(F.desc("created_at"), F.desc("doc_id"))
    return c.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= n).select("file", "position", "doc_id", "created_at")


def earlier_names(renames: DataFrame) -> DataFrame:
    """(path, earlier): every name that each path had before, by joins of doubling reach until nothing is added."""
    from codeloom.io import stored

    step = stored(renames.filter("path is not null and previous_path is not null and path <> previous_path").select("path", F.col("previous_path").alias("earlier")).distinct(), "renames")
    n = step.count()
    while True:
        further = step.select("path", F.col("earlier").alias("mid")).join(step.select(F.col("path").alias("mid"), "earlier"), "mid").select("path", "earlier")
        step = stored(step.unionByName(further).filter("path <> earlier").distinct(), "renames")
        grown = step.count()
        if grown == n:
            return step
        n = grown


def _stripped(text):
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def search_query(title: str = "title", body: str = "body"):
    """The title and the first 500 characters of the body without code blocks, link targets and marks."""
    t = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.substring(F.coalesce(F.col(body), F.lit("")), 1, 500))
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)```.*?```", ""), r"\[([^\]]+)\]\([^)]+\)", "$1")
    return _stripped(F.regexp_replace(t, r"[#*_`]", ""))


def clean_description(body):
    """Without HTML comments; three and more line feeds become two."""
    return _stripped(F.regexp_replace(F.regexp_replace(body, r"(?s)<!--.*?-->", ""), r"\n{3,}", "\n\n"))


def acceptance_criteria(docs: DataFrame) -> DataFrame:
    """(doc_id, position, criterion): the open check-boxes of the section 'Acceptance Criteria', or of the whole text if
    it has none there."""
    box = F.lit(r"- \[ \] ([^\n\r]+)")
    section = F.regexp_extract("text", r"(?is)##\s*Acceptance Criteria\s*\n(.*?)(?=\n##|\z)", 1)
    there, anywhere = (F.regexp_extract_all(t, box, F.lit(1)) for t in (section, F.col("text")))
    found = F.when(F.size(there) > 0, there).otherwise(anywhere)
    return once(docs).filter("text is not null").select("doc_id", F.posexplode(found).alias("position", "c")).select("doc_id", "position", F.trim("c").alias("criterion"))


def vector_documents(docs: DataFrame, text=None, provider=hashed) -> DataFrame:
    """(doc_id, embedding) of each document's text."""
    return once(docs).select("doc_id", embed(F.col("text") if text is None else text, provider).alias("embedding"))


def commit_search(docs: DataFrame, query: str, n: int = 10, provider=hashed) -> DataFrame:
    """The n commits nearest to a query, with distance and score."""
    v = vector_documents(docs.filter("kind = 'commit'"), provider=provider)
    return V.top_k(v, provider([query])[0].tolist(), n, 0.0, "doc_id", "embedding").drop("embedding")


def related_commits(issues: DataFrame, docs: DataFrame, n: int = 5, provider=hashed) -> DataFrame:
    """(query_id, doc_id, rank, relevance): for each issue (a stated query set) the n commits nearest to its search query;
    relevance falls by a tenth a rank, to a half at least."""
    q = vector_documents(title_and_body(issues), search_query(), provider)
    v = vector_documents(docs.filter("kind = 'commit'"), provider=provider)
    x = V.top_k_per_query(v, q, n, "doc_id", "embedding")
    return x.select("query_id", "doc_id", "rank", F.greatest(F.lit(0.5), F.round(1 - (F.col("rank") - 1) * 0.1, 1)).alias("relevance"))


def related_by_title(docs: DataFrame, doc_id: int, n: int = 5) -> DataFrame:
    """The n documents of most relevance to a document's title, itself excluded. The title is looked up first."""
    row = title_and_body(docs.filter(F.col("doc_id") == doc_id)).select("title").first()
    if row is None or not row.title:
        return docs.limit(0).select("doc_id", F.lit(0).cast("long").alias("relevance"))
    x = title_and_body(once(docs)).filter(F.col("doc_id") != doc_id)
    x = x.withColumn("relevance", relevance(F.col("title"), F.col("body"), row.title)).filter("relevance > 0")
    return x.orderBy(F.desc("relevance"), "doc_id").limit(n).select("doc_id", "relevance")


def commit_budget(docs: DataFrame, by: str, budget: int, reserved: int = 50) -> DataFrame:
    """(by, rank, doc_id, tokens, used): the newest commits of each group that fit, the first with its body, the others
    with their subject; `reserved` tokens stay free, and the first commit always comes out."""
    c = title_and_body(once(docs).filter("kind = 'commit'")).filter(F.col(by).isNotNull())
    c = c.select(by, "doc_id", "created_at", T.estimate_tokens(F.col("title")).alias("short"), T.estimate_tokens(F.concat_ws("\n", "title", "body")).alias("long"))
    w = Window.partitionBy(by).orderBy(F.desc("created_at"), F.desc("doc_id"))
    c = c.withColumn("rank", F.row_number().over(w) - 1).withColumn("tokens", F.when(F.col("rank") == 0, F.col("long")).otherwise(F.col("short")))
    c = c.withColumn("used", F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # What is used only grows, so the commits that fit are those before the first that doesn't.
    return c.filter((F.col("rank") == 0) | (F.col("used") + reserved <= budget)).select(by, "rank", "doc_id", "tokens", "used")


def insights(vectors: DataFrame, queries: DataFrame, group_col: str, threshold: float = 0.6, hits: int = 100, groups: int = 10, n: int = 10) -> DataFrame:
    """(query_id, count, groups): of the `hits` nearest to each pattern those that reach the score, counted, with the first
    groups (files) in order of nearness; the n patterns of most hits."""
    x = V.top_k_per_query(vectors, queries, hits, "vec_id", "embedding").withColumn("score", V.score(F.col("distance"))).filter(F.col("score") >= threshold)
    x = x.join(vectors.select("vec_id", F.col(group_col).alias("g")), "vec_id")
    per = x.groupBy("query_id", "g").agg(F.count("*").alias("c"), F.min("rank").alias("r"))
    g = per.groupBy("query_id").agg(F.sum("c").alias("count"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("r", "g"))), lambda s: s.g), 1, groups).alias("groups"))
    return g.orderBy(F.desc("count"), "query_id").limit(n)


def incremental_updates(snapshots: DataFrame, most: int = 10) -> DataFrame:
    """repository_path, updates, warning: updates since the last full index of each checkout; more than `most` ask for one."""
    s = snapshots.filter("id is not null and repository_path is not null").select("id", "repository_path", "ts", "trigger").distinct()
    full = s.filter("trigger = 'index'").groupBy("repository_path").agg(F.max("ts").alias("full"))
    x = s.join(full, "repository_path", "left").filter("trigger = 'update' and (full is null or ts > full)")
    x = s.select("repository_path").distinct().join(x.groupBy("repository_path").agg(F.count("*").alias("n")), "repository_path", "left")
    return x.select("repository_path", F.coalesce("n", F.lit(0)).alias("updates"), (F.coalesce("n", F.lit(0)) > most).alias("warning"))
