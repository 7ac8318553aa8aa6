"""References, keywords and relevance in issues, commits and other texts.

Documents delivered twice count once by doc_id. Null texts have no references and no keywords.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T


def once(docs: DataFrame) -> DataFrame:
    return docs.dropDuplicates(["doc_id"])


def references(docs: DataFrame) -> DataFrame:
    """doc_id, issues, pulls, others, urls: what each text refers to; texts without any reference are left out."""
    t = F.col("text")
    x = docs.select("doc_id", T.issue_references(t).alias("issues"), T.pull_references(t).alias("pulls"), T.plain_references(t).alias("others"), T.urls(t).alias("urls"))
    return x.filter((F.size("issues") > 0) | (F.size("pulls") > 0) | (F.size("urls") > 0)).dropDuplicates(["doc_id"])


def referenced_numbers(docs: DataFrame) -> DataFrame:
    """number, documents: how many documents of each repository name an issue number; counted once a document."""
    x = docs.select("doc_id", "repository", F.explode(T.issue_references(F.col("text"))).alias("number")).distinct()
    return x.groupBy("repository", "number").agg(F.count("*").alias("documents"))


def related(docs: DataFrame, numbered: DataFrame) -> DataFrame:
    """doc_id, related: the documents whose number a text names, in order of the numbers; unknown numbers fall out, and so
    does the document itself. numbered: (number, doc_id, repository)."""
    n = numbered.select("number", F.col("doc_id").alias("related_id"), "repository")
    x = docs.select("doc_id", "repository", F.explode(T.issue_references(F.col("text"))).alias("number")).distinct()
    x = x.join(n, ["repository", "number"]).filter("doc_id <> related_id").select("doc_id", "number", "related_id").distinct()
    rows = F.array_sort(F.collect_list(F.struct("number", "related_id")))
    return x.groupBy("doc_id").agg(F.transform(rows, lambda r: r.related_id).alias("related"))


def related_with_pulls(docs: DataFrame, numbered: DataFrame) -> DataFrame:
    """doc_id, issues, pulls: the documents whose number a text names as an issue or as a pull request, in order of their
    ids; a number may stand in both."""
    n = numbered.select("number", F.col("doc_id").alias("related_id"), "repository")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("numbers")) for k, v in (("issue", T.issue_references(F.col("text"))), ("pull", T.pull_references(F.col("text"))))])
    x = docs.select("doc_id", "repository", F.explode(kinds).alias("k")).select("doc_id", "repository", "k.kind", F.explode("k.numbers").alias("number")).distinct()
    x = x.join(n, ["repository", "number"]).filter("doc_id <> related_id").select("doc_id", "kind", "related_id").distinct()
    of = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("related_id")))).alias(f"{k}s")
    return x.groupBy("doc_id").agg(of("issue"), of("pull"))


def keywords(docs: DataFrame, n: int = 10) -> DataFrame:
    """doc_id, rank, word, times: the most frequent words of each text, the first seen first among equals."""
    x = once(docs.select("doc_id", "text")).select("doc_id", F.posexplode(T.words(F.col("text"))).alias("pos", "word"))
    x = x.groupBy("doc_id", "word").agg(F.count("*").alias("times"), F.min("pos").alias("first"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("times"), "first")
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).select("doc_id", "rank", "word", "times")


def topic_words(docs: DataFrame, by: str, n: int = 10) -> DataFrame:
    """by, rank, word, documents: the words in most texts of a group, counted once a text. The distinct pairs are
    combined before the shuffle, so a group that holds a third of all texts brings one row a word and task."""
    x = once(docs.select("doc_id", "text", by)).select(by, F.explode(F.array_distinct(T.words(F.col("text")))).alias("word"))
    x = x.groupBy(by, "word").agg(F.count("*").alias("documents"))
    w = Window.partitionBy(by).orderBy(F.desc("documents"), "word")
    return x.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def title_and_body(docs: DataFrame) -> DataFrame:
    """docs with title (the first line) and body (the rest)."""
    return docs.withColumns({"title": F.substring_index("text", "\n", 1), "body": F.trim(F.regexp_replace("text", r"^[^\n]*\n?", ""))})


def relevance(title: Column, body: Column, query: str, labels: Column | None = None, pattern: bool = False) -> Column:
    """20 for each hit in the title, 5 in the body, 10 for each label that holds the query, 20 more if the title is the
    query. The query is plain text; with `pattern` hits are those of a regular expression, as the contract has it."""
    q = F.lit(query.lower())
    hits = lambda c: F.regexp_count(F.lower(c), q) if pattern else (F.length(c) - F.length(F.replace(F.lower(c), q, F.lit("")))) / len(query)
    none = F.lit("")
    t, b = F.coalesce(title, none), F.coalesce(body, none)
    named = F.lit(0) if labels is None else F.coalesce(F.size(F.filter(labels, lambda x: F.contains(F.lower(x), q))), F.lit(0))
    return (hits(t) * 20 + hits(b) * 5 + named * 10 + F.when(F.lower(t) == q, 20).otherwise(0)).cast("long")


def ranked(docs: DataFrame, query: str, limit: int = 20, labels: str | None = None, pattern: bool = False) -> DataFrame:
    score = relevance(F.col("title"), F.col("body"), query, None if labels is None else F.col(labels), pattern)
    x = title_and_body(once(docs)).withColumn("relevance", score)
    return x.filter("relevance > 0").orderBy(F.desc("relevance"), "doc_id").limit(limit)


def matching(docs: DataFrame, query: str, *more: str) -> DataFrame:
    """Documents that hold the query in their text, kind, repository, number or the columns named (labels, author)."""
    hay = F.lower(F.concat_ws(" ", "text", *more, "kind", "repository", F.col("doc_id").cast("string"), F.concat(F.lit("#"), F.col("doc_id").cast("string"))))
    return once(docs).filter(F.contains(hay, F.lit(query.lower())))


def commits(docs: DataFrame) -> DataFrame:
    """doc_id, kind, scope, breaking, subject, body: commit texts by the conventional form; other subjects have no kind."""
    x = title_and_body(once(docs).filter("kind = 'commit'"))
    form = r"^(\w+)(?:\(([^)]*)\))?(!)?: (.*)$"
    got = lambda i: F.nullif(F.regexp_extract("title", form, i), F.lit(""))
    return x.select("doc_id", got(1).alias("commit_kind"), got(2).alias("scope"), got(3).isNotNull().alias("breaking"), F.coalesce(got(4), "title").alias("subject"), "body")


def commit_documents(docs: DataFrame) -> DataFrame:
    """doc_id, embed_text: subject, body and the file of a commit, as they are embedded."""
    x = title_and_body(once(docs).filter("kind = 'commit'"))
    keep = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    return x.select("doc_id", F.concat_ws("\n\n", keep("title"), keep("body"), keep("file")).alias("embed_text"))


def counts_by(docs: DataFrame) -> DataFrame:
    """kind, source, documents, characters: with subtotals by kind and a grand total (nulls are all)."""
    return once(docs).rollup("kind", "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("characters"), F.grouping_id().alias("level"))


def checkboxes(docs: DataFrame) -> DataFrame:
    """doc_id, done, open: check-boxes of each text that has any."""
    count = lambda p: F.regexp_count("text", F.lit(p))
    x = once(docs).select("doc_id", count(r"(?m)^\s*[-*] \[[xX]\]").alias("done"), count(r"(?m)^\s*[-*] \[ \]").alias("open"))
    return x.filter("done + open > 0")


def late(docs: DataFrame, hours: int = 24) -> DataFrame:
    """kind, documents, late: rows ingested more than so many hours after they were written."""
    x = once(docs).groupBy("kind").agg(F.count("*").alias("documents"), F.count_if(F.unix_timestamp("ingested_at") - F.unix_timestamp("created_at") > hours * 3600).alias("late"))
    return x


def parse_numstat(lines: DataFrame, *keep: str) -> DataFrame:
    """line to path, previous_path, status, additions, deletions. '-' counts as 0; renames come as 'a => b' and as
    'dir/{a => b}/file'; everything else is 'modified'. Lines with fewer than three fields fall out; the columns named are carried along."""
    p = F.split("line", "\t", 3)
    n = lambda i: F.coalesce(F.try_to_number(F.element_at(p, i), F.lit("9999999999")).cast("long"), F.lit(0))
    # The two ways in which such a line writes a rename.
    path, brace = F.element_at(p, 3), r"^(.*?)\{(.+?)\s*=>\s*(.+?)\}(.*)$"
    plain = r"^(.+?)\s*=>\s*(.+)$"
    joined = lambda i: F.regexp_replace(F.concat(F.regexp_extract(path, brace, 1), F.regexp_extract(path, brace, i), F.regexp_extract(path, brace, 4)), "/+", "/")
    new = F.when(path.rlike(brace), joined(3)).when(path.rlike(plain), F.trim(F.regexp_extract(path, plain, 2))).otherwise(path)
    old = F.when(path.rlike(brace), joined(2)).when(path.rlike(plain), F.trim(F.regexp_extract(path, plain, 1)))
    x = lines.filter(F.size(p) >= 3)
    return x.select(*keep, new.alias("path"), old.alias("previous_path"), F.when(old.isNotNull(), "renamed").otherwise("modified").alias("status"), n(1).alias("additions"), n(2).alias("deletions"))
