"""The reference behaviour on small hand-written tables, and edge cases."""

import math
import subprocess

import pytest
from pyspark.sql import functions as F

from codeloom.functions import classes as C
from codeloom.functions import text as T
from codeloom.operators import budget as B
from codeloom.operators import files as Fi
from codeloom.operators import metrics as M
from codeloom.operators import requests as R
from codeloom.operators import snapshot_changes as S
from codeloom.operators import stats as St
from codeloom.operators import structure as Sr
from codeloom.operators import texts as X
from codeloom.operators import vectors as V


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("text", "want"),
    [("Fix #123 and #456", [123, 456]), ("See GH-789 and GH-101", [101, 789]), ("Relates to #123, GH-456, and issue #789", [123, 456, 789]), ("#123 and #123 again", [123]), ("#abc #0 #-1", []), ("", []), ("version 1.2.3 and port 8080", []), (None, [])],
)
def test_issue_references(spark, text, want):
    assert one(spark, T.issue_references, text) == want


def test_references_of_commits(spark):
    assert one(spark, T.pull_references, "Merge pull request #45, see PR #9 and #3") == [45, 9]
    assert one(spark, T.plain_references, "Merge pull request #45, see PR #9 and #3") == [3]
    assert one(spark, T.mentions, "thanks @ann-b and me@site.org, @bob.") == ["ann-b"]
    assert one(spark, T.urls, "a https://x.org/a b http://y.z https://x.org/a") == ["https://x.org/a", "http://y.z"]
    assert one(spark, T.file_paths, "see `src/a.ts` and packages/core/b.go here") == ["packages/core/b.go", "src/a.ts"]


def test_scores(spark):
    d = spark.createDataFrame([(0.0,), (0.1,), (0.5,), (2.0,), (3.0,), (float("inf"),), (None,)], "d double")
    s = [r.s for r in d.select(V.score(F.col("d")).alias("s")).collect()]
    assert s[0] == 1 and s[1] > 0.99 and s[2] > 0.7 and s[3] < 0.02 and s[4] < 0.001 and s[5] == 0 and s[6] == 1


def test_vectors(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0], "a"), (2, [1.0, 0.0], "a"), (3, [0.0, 0.5], "b"), (4, None, "b"), (5, [1.0], "b")], "vec_id long, embedding array<float>, label string")
    assert [r.vec_id for r in V.top_k_by_id(v, 1, 10).collect()] == [1, 3, 2]
    assert [r.vec_id for r in V.top_k_by_id(v, 1, 10, threshold=0.7).collect()] == [1, 3]
    assert V.top_k_by_id(v, 99, 10).count() == 0
    assert [r.vec_id for r in V.similar_outside_group(v, 1, "label", 2).collect()] == [3]
    got = {(r.query_id, r.vec_id, r["rank"]) for r in V.top_k_per_query(v.filter("vec_id < 4"), v.filter("vec_id in (1, 2)"), 1).collect()}
    assert got == {(1, 3, 1), (2, 1, 1)}
    assert V.top_k_per_query(v, v.limit(0), 1).count() == 0
    up = V.upsert(v, spark.createDataFrame([(2, [9.0, 9.0], "z"), (7, [1.0, 1.0], "n"), (7, [1.0, 1.0], "n")], v.schema), "vec_id")
    assert {(r.vec_id, r.label) for r in up.collect()} == {(1, "a"), (2, "z"), (3, "b"), (4, "b"), (5, "b"), (7, "n")}
    assert {r.vec_id for r in V.delete(v, v.filter("label = 'a'"), "vec_id").collect()} == {3, 4, 5}


def test_file_metrics(spark):
    m = spark.createDataFrame(
        [("s", "src/very-active.ts", 100, 1, 2000, 50, 20), ("s", "src/medium-active.ts", 30, 3, 500, 15, 10), ("s", "./src\\low-active.ts", 5, 5, 100, 5, 3), ("s", "src/low-active.ts", 5, 5, 100, 5, 3)],
        "snapshot_id string, file_path string, commit_count long, author_count long, lines_of_code long, num_functions long, num_imports long",
    ).withColumn("last_modified", F.lit(None).cast("timestamp"))
    x = M.file_metrics(m)
    got = {(r.file_path, r.activity, r["size"], r.ownership, r.risk_score) for r in x.collect()}
    assert got == {("src/very-active.ts", "very-high", "very-large", "single", 200000.0), ("src/medium-active.ts", "medium", "medium", "small-team", 5000.0), ("src/low-active.ts", "low", "small", "small-team", 100.0)}
    s = M.snapshot_summary(x).first()
    assert (s.total_files, s.total_loc, s.total_functions, s.avg_loc, s.very_active, s.highly_active_percent, s.single_author) == (3, 2600, 70, 867, 1, 33, 1)
    old = m.limit(0).select("snapshot_id", "file_path", "commit_count", "author_count", "lines_of_code", "num_functions", "num_imports").withColumn("risk_score", F.lit(0.0))
    both = M.append_code_metadata(M.append_code_metadata(old, m), m)
    assert both.count() == 3


def test_diff(spark):
    b = spark.createDataFrame([("typescript", 80, 10000), ("javascript", 20, 2000)], "language string, files long, lines long")
    a = spark.createDataFrame([("typescript", 90, 11000), ("javascript", 20, 2000), ("go", 10, 1500)], b.schema)
    got = {(r.language, r.metric): (r.absolute, r.percent, r.status) for r in St.diff(b, a, "language", ["files", "lines"]).collect()}
    assert got["typescript", "files"] == (10, 12.5, "changed") and got["go", "files"] == (10, 100, "added") and got["javascript", "lines"] == (0, 0, "unchanged")
    assert St.overall_trend(b, a).first().trend == "growing"


def test_percentiles(spark):
    e = spark.range(1, 21).select(F.lit("t").alias("tool"), F.col("id").cast("double").alias("value"))
    r = R.latency(e, ["tool"]).first()
    assert (r.p50, r.p95, r.p99, r.requests, r["mean"]) == (10, 19, 20, 20, 10.5)
    assert R.latency(e.limit(0), ["tool"]).count() == 0


def test_map_and_calls(spark):
    rows = [("scan.ts", "class", "TypeScriptScanner", 19), ("scan.ts", "method", "scan", 45)]
    rows = [(f"packages/core/src/{f}:{n}:{s}", f"packages/core/src/{f}", t, n, s, True, "typescript", s + 5) for f, t, n, s in rows]
    rows += [("packages/cli/src/cli.ts:main:5", "packages/cli/src/cli.ts", "function", "main", 5, True, None, 9), ("packages/core/u.ts:p:10", "packages/core/u.ts", "function", "p", 10, False, "TYPESCRIPT", 12)]
    c = spark.createDataFrame(rows, "id string, file string, type string, name string, start_line long, exported boolean, language string, end_line long")
    n = {r.path: (r.components, r.own_components) for r in Sr.directory_rollup(c.union(c)).collect()}
    assert n[""] == (4, 0) and n["packages"] == (4, 0) and n["packages/core"] == (3, 1) and n["packages/core/src"] == (2, 2)
    assert {r.path for r in Sr.smart_prune(Sr.directory_rollup(c), 5, 3).collect()} == {"", "packages", "packages/core", "packages/cli", "packages/core/src"}
    k = spark.createDataFrame(
        [("a", "src/planner.ts", "createPlan", [("fetchIssue", "src/github.ts", 15), ("analyzeCode", None, 20)]), ("b", "src/executor.ts", "runPlan", [("createPlan", "src/planner.ts", 10), ("this.createPlan", None, 12)]), ("c", "src/cli.ts", "main", None)],
        "id string, file string, name string, callees array<struct<name string, file string, line long>>",
    ).withColumns({"language": F.lit("typescript"), "start_line": F.lit(1)})
    t = spark.createDataFrame([("a", "createPlan")], "id string, name string")
    # A component of the target's name in another file is a caller, the target itself is not.
    k = k.union(spark.createDataFrame([("d", "src/other.ts", "createPlan", [("createPlan", "src/planner.ts", 3)], "typescript", 1), ("a", "src/planner.ts", "createPlan", [("createPlan", None, 9)], "typescript", 1)], k.schema).filter("id = 'd'"))
    assert {(r.target, r.caller_id, r.line) for r in Sr.callers(Sr.call_edges(k), t).collect()} == {("createPlan", "b", 10), ("createPlan", "d", 3)}
    assert [r.callee_name for r in Sr.callees(k, t).orderBy("position").collect()] == ["fetchIssue", "analyzeCode"]


def _snap(spark, rows):
    s = spark.createDataFrame([(i, p, f"2024-01-{d:02d} 00:00:00", n) for i, p, d, n in rows[0]], "id string, repository_path string, ts string, total_files long").withColumn("ts", F.to_timestamp("ts")).withColumn("stats", F.lit(None).cast("string"))
    m = spark.createDataFrame(rows[1], "snapshot_id string, file_path string, commit_count long, lines_of_code long")
    none = {c: F.lit(None).cast("long") for c in ("author_count", "num_functions", "num_imports")}
    return s, m.withColumns(none).withColumn("last_modified", F.lit(None).cast("timestamp")).withColumn("risk_score", F.rand())


def test_snapshot_changes(spark):
    snaps = [("1", "r", 1, 2), ("2", "r", 2, 2), ("3", "r", 3, 5), ("4", "r", 4, 0), ("5", "r", 5, 1), ("1", "r", 1, 2), ("x", "q", 1, 1), (None, "r", 9, 1), ("n", None, 3, 1)]
    meta = [("1", "a", 0, 1), ("1", "b", 1, 1), ("2", "./a", None, 1), ("2", "b", 1, 2), ("2", "b", 1, 2), ("5", "b", 1, 2), ("x", "a", 1, 1), ("9", "a", 1, 1), ("5", None, 1, 1), (None, "z", 1, 1)]
    s, m = _snap(spark, (snaps, meta))
    got = {(r.snapshot_id, r.file_path, r.change_kind) for r in S.change_events(s, m).collect()}
    # 3 promised files and brought none: lost. 4 is empty. a is the same in 1 and 2, as 0 equals null.
    assert got == {("2", "b", "changed"), ("4", "a", "removed"), ("4", "b", "removed"), ("5", "b", "added")}
    assert {(r.snapshot_id, r.n_removed) for r in S.change_counts(s, m).collect()} == {("2", 0), ("4", 2), ("5", 0)}
    assert S.change_events(s.limit(0), m).count() == 0 and S.change_events(s, m.limit(0)).count() == 0
    extra = m.withColumns({"series": F.lit(1), "seq": F.lit(2), "row_hash": F.lit(3), "island": F.lit(4)})
    assert S.change_events(s.withColumn("seq", F.lit(1)), extra).count() == 4


def test_hot_series(spark):
    """One series holds nearly all rows: keys spread it."""
    s, m = _snap(spark, ([(str(i), "hot", i, 300) for i in range(1, 11)], [(str(i), f"f{k}", 1, i // 5 if k % 3 else 1) for i in range(1, 11) for k in range(300)]))
    got = S.change_events(s, m).groupBy("change_kind").count().collect()
    assert {r.change_kind: r["count"] for r in got} == {"changed": 400}


def test_files(spark):
    f = spark.createDataFrame(
        [("a/x.ts", "import a\nexport function one(a: string) {\n", 3), ("a/x.test.ts", "", 0), ("node_modules/p/y.ts", "x", 1), ("b.go", "// Code generated by z. DO NOT EDIT.\nfunc A() {\n", 5), ("c.go", "package c\n\n// Says a\n// lot\nfunc (t *T) Run() {\n", 9), ("d.py", "﻿async def go(a):\r\n  pass", 1), (None, "x", 1), ("e.md", "# One\ntext\n```\n# no\n```\n## Two\n- list\n# Three\nmore", 3)],
        "path string, content string, length long",
    ).withColumns({"repository": F.lit("r"), "language": F.lit("typescript")})
    assert {r.path for r in Fi.discover(f).collect()} == {"a/x.ts", "a/x.test.ts", "b.go", "c.go", "d.py", "e.md"}
    assert {(r.path, r.test) for r in Fi.related_tests(f).collect() if r.test} == {("a/x.ts", "a/x.test.ts")}
    assert {(r.id, r.type, r.exported) for r in Fi.declarations(f).collect()} == {("a/x.ts:one:2", "function", True), ("c.go:T.Run:5", "method", True), ("d.py:go:1", "function", True)}
    assert [(r.file, r.line_no, r.doc) for r in Fi.doc_lines(f).filter("file = 'c.go'").collect()] == [("c.go", 5, "Says a\nlot")]
    assert {(r.id, r.docstring) for r in Fi.markdown_sections(f).collect()} == {("e.md:one:1", "text\n\n```\n# no\n```"), ("e.md:three:8", "more")}
    lines = spark.createDataFrame([("line 1\nline 2\nline 3\n",)], "c string").select(Fi.line_count(F.col("c")).alias("n")).first().n
    assert lines == 4
    state = spark.createDataFrame([("a/x.ts", "old"), ("gone.ts", "h")], "path string, hash string")
    assert {(r.path, r.change) for r in Fi.detect_changes(state, f).collect() if r.path in ("a/x.ts", "gone.ts", "c.go")} == {("a/x.ts", "changed"), ("gone.ts", "deleted"), ("c.go", "added")}


def test_numstat(spark):
    rows = [("10\t5\tsrc/a.ts",), ("-\t-\timg.png",), ("1\t0\told.ts => new.ts",), ("2\t2\tsrc/{a => b}/c.ts",), ("0\t0\tsrc/{ => x}/c.ts",), ("bad",), (None,)]
    got = [(r.path, r.previous_path, r.status, r.additions, r.deletions) for r in X.parse_numstat(spark.createDataFrame(rows, "line string")).collect()]
    assert got[:4] == [("src/a.ts", None, "modified", 10, 5), ("img.png", None, "modified", 0, 0), ("new.ts", "old.ts", "renamed", 1, 0), ("src/b/c.ts", "src/a/c.ts", "renamed", 2, 2)]


def test_tokens_and_formats(spark):
    assert one(spark, T.estimate_tokens, None) == 0 and one(spark, T.estimate_tokens, "  \n ") == 0 and one(spark, T.estimate_tokens, "one two  three four") == max(math.ceil(18 / 4.5), 5)
    assert one(spark, T.slug, "Hello, World! v2") == "hello-world-v2"
    assert one(spark, T.remote_key, "git@host.org:Owner/Repo.git") == "owner/repo" == one(spark, T.remote_key, "https://host.org/Owner/Repo/")
    assert one(spark, C.human_bytes, 1536, "long") == "1.5 KB" and one(spark, C.human_bytes, 0, "long") == "0 Bytes"
    assert one(spark, C.language_of, "a/b.TSX") == "typescript" and one(spark, C.language_of, None) == "unknown"


def test_git(spark, tmp_path):
    from codeloom.sources.git import GitBlame, GitLog, change_frequency, commit_files, commit_of, commits, parse_blame

    def git(*a):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=T", "-c", "user.email=t@x.org", *a], check=True, capture_output=True)

    git("init", "-q")
    for i, message in enumerate(["Initial commit", "feat: add file1 #123", "fix: bug fix PR #456"]):
        (tmp_path / "file1.ts").write_text("line\n" * (i + 1))
        git("add", ".")
        git("commit", "-qm", message)
    spark.dataSource.register(GitLog)
    c = commits(spark.read.format("git_log").option("repository", str(tmp_path)).option("block", "2").load())
    got = {r.subject: (r.issue_refs, r.pr_refs) for r in c.collect()}
    assert got == {"Initial commit": ([], []), "feat: add file1 #123": ([123], []), "fix: bug fix PR #456": ([], [456])}
    f = change_frequency(commit_files(c)).first()
    assert (f.path, f.commits, f.authors) == ("file1.ts", 3, 1)
    raw = subprocess.run(["git", "-C", str(tmp_path), "blame", "--porcelain", "file1.ts"], capture_output=True, text=True).stdout.split("\n")
    b = parse_blame(spark.createDataFrame([("file1.ts", i, x) for i, x in enumerate(raw)], "file string, n long, line string"))
    assert [(r.line_no, r.author, r.content) for r in b.orderBy("line_no").collect()] == [(1, "T", "line"), (2, "T", "line"), (3, "T", "line")]
    spark.dataSource.register(GitBlame)
    part = parse_blame(spark.read.format("git_blame").option("repository", str(tmp_path)).option("path", "file1.ts").option("first", "2").option("last", "3").load())
    assert [r.line_no for r in part.orderBy("line_no").collect()] == [2, 3]
    first = c.filter("subject = 'Initial commit'").first()
    assert commit_of(c, first.short_hash).first().hash == first.hash and commit_of(c, "0" * 40).count() == 0


def test_issues_and_tables(spark, tmp_path):
    import json

    from codeloom.sources import issues as I
    from codeloom.sources import tables as Tb
    from codeloom.sources.trees import read_tree

    (tmp_path / "i.json").write_text(json.dumps([{"number": 42, "title": "Add login", "body": "see #7 and https://h.org/o/r/pull/9 `src/a.ts` @ann #42", "state": "OPEN", "labels": [{"name": "feature"}], "author": {"login": "bob"}, "createdAt": "2024-01-01T00:00:00Z", "comments": [{"body": "x"}]}, {"number": 43, "title": None, "state": "CLOSED", "mergedAt": "2024-02-01T00:00:00Z"}]))
    d = I.to_documents(I.read_export(spark, str(tmp_path / "i.json")), "pull_request", "o/r")
    a, b = d.orderBy("number").collect()
    assert (a.state, a.related_issues, a.related_prs, a.linked_files, a.mentions, a.comments, a.labels) == ("open", [7], [9], ["src/a.ts"], ["ann"], 1, ["feature"])
    assert (b.state, b.body, b.labels, b.comments) == ("merged", "", [], 0)
    assert I.search(d, labels=["feature"], since="2023-01-01").count() == 1 and I.state_counts(d).first().merged == 1
    t = str(tmp_path / "t")
    Tb.save(spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), t, "k")
    Tb.upsert_into(spark, t, spark.createDataFrame([(2, "c")], "k long, v string"), "k")
    Tb.delete_from(spark, t, spark.createDataFrame([(1,)], "k long"), "k")
    assert [tuple(r) for r in spark.read.parquet(t).collect()] == [(2, "c")]
    Tb.clear(spark, t)
    assert spark.read.parquet(t).columns == ["k", "v"] and spark.read.parquet(t).count() == 0
    both = I.all_documents(I.read_export(spark, str(tmp_path / "i.json")), I.read_export(spark, str(tmp_path / "i.json")), "o/r")
    assert {(r.type, r.number) for r in both.collect()} == {(k, n) for k in ("issue", "pull_request") for n in (42, 43)}
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.ts").write_text("x")
    r = read_tree(spark, str(tmp_path / "src"), "o/r", "*.ts").first()
    assert (r.path, r.language, r.content) == ("a.ts", "typescript", "x")


def test_rate_limit(spark, tmp_path):
    from codeloom.streaming.replay import read_table_stream, replayed
    from codeloom.streaming.state import rate_limited

    import random

    rnd = random.Random(3)
    rows = sorted((f"2024-01-01 00:{rnd.randrange(10):02d}:{rnd.randrange(60):02d}", k) for k in "ab" for _ in range(100))
    spark.createDataFrame([(i, t, k) for i, (t, k) in enumerate(rows)], "event_id long, t string, key string").select("event_id", F.to_timestamp("t").alias("ts"), "key").coalesce(1).write.parquet(str(tmp_path / "ev.parquet"))
    got = {r.event_id: r.allowed for r in replayed(rate_limited(read_table_stream(spark, str(tmp_path), "ev"), "key", 5, 0.05)).collect()}
    want, bucket = {}, {}
    for i, (t, k) in enumerate(rows):
        at = int(t[14:16]) * 60 + int(t[17:])
        tokens, last = bucket.get(k, (5.0, at))
        tokens = min(5.0, tokens + (at - last) * 0.05)
        want[i] = tokens >= 1
        bucket[k] = (tokens - want[i], at)
    assert got == want and 0 < sum(got.values()) < 200


def test_budgets_see_every_row_of_a_large_file(spark, tmp_path):
    """A file of 400 components: detail levels have no limit, and the cuts stop at the budget only."""
    from codeloom.plans import budget as P

    n = 400
    rows = [(f"i{k:03d}", "a.ts", "function", "f", k, "f()", None) for k in range(n)] + [("z", "b.ts", "function", "f", 1, "f()", "word " * 3000)]
    c = spark.createDataFrame(rows, "id string, file string, type string, name string, start_line long, signature string, snippet string")
    c.write.parquet(f"{tmp_path}/components.parquet")
    level = lambda k: "full" if k < 3 else "signature" if k < 7 else "minimal"
    assert {(r.id, r["rank"], r.level) for r in P.detail_levels(spark, str(tmp_path)).collect()} == {(r[0], r[4], level(r[4])) for r in rows[:n]} | {("z", 0, "full")}
    ranked = {r.id: r for r in P._ranked(spark, str(tmp_path)).collect()}
    cut, adaptive, used, spent = {"z"}, {("z", "full")}, 0, 0
    for k in range(n):
        r = ranked[f"i{k:03d}"]
        used += r.t_full
        left = P.BUDGET - spent
        form = "full" if k < 3 and left > 300 else "signature" if k < 7 and left > 100 else "minimal"
        spent += r[f"t_{form}"]
        cut |= {r.id} if used <= P.BUDGET else set()
        adaptive |= {(r.id, form)} if spent <= P.BUDGET else set()
    assert len(cut) > 60 and len(adaptive) > 60
    assert {r.id for r in P.token_budget_cut(spark, str(tmp_path)).collect()} == cut
    assert {(r.id, r.level) for r in P.token_budget_adaptive(spark, str(tmp_path)).collect()} == adaptive
    assert B.rank_rows(c, ["file"], [F.col("id")], 50).count() == 51


def test_queries_in_blocks_give_the_same_neighbours(spark, monkeypatch):
    import random

    rnd = random.Random(2)
    v = spark.createDataFrame([(i, [rnd.choice([0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(200)] + [(900, None), (901, [1.0])], "vec_id long, embedding array<float>")
    q = v.filter("vec_id % 10 = 0")
    one = {(r.query_id, r.vec_id, r["rank"]) for r in V.top_k_per_query(v, q, 4).collect()}
    monkeypatch.setattr(V, "QUERY_BLOCK", 6)
    monkeypatch.setattr(V, "ROW_TILE", 30)
    assert {(r.query_id, r.vec_id, r["rank"]) for r in V.top_k_per_query(v, q, 4).collect()} == one and len(one) == 80


def test_running_totals_over_ranges(spark):
    from codeloom.io import running_total

    rows = [("a" if i % 3 else None, i % 17, 1 + i % 2) for i in range(300)]
    per = spark.createDataFrame(rows, "g string, v long, n long").groupBy("g", "v").agg(F.sum("n").alias("n"))
    got = {(r.g, r.v): (r.upto, r.total) for r in running_total(per, ["g"], ["v"], "n").collect()}
    want = {(g, v): (sum(n for h, w, n in rows if h == g and w <= v), sum(n for h, _, n in rows if h == g)) for g, v, _ in rows}
    assert got == want and running_total(per.limit(0), [], ["v"], "n").count() == 0


def test_shared_folder_and_small_tables(spark, monkeypatch):
    from codeloom import io

    class Far:
        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.master": "yarn"}.get(key, default)

    with pytest.raises(ValueError):
        io.shared_dir(Far)
    df = spark.createDataFrame([("x" * 100, [1, 2])] * 20, "s string, a array<int>")
    broadcast = lambda d: "broadcast" in d._jdf.queryExecution().logical().toString().lower()
    assert broadcast(io.broadcast_small(df)) and not broadcast(io.broadcast_small(df, 1000))
    import os

    io.WRITTEN.clear()
    io.stored(df, "gone")
    path = io.WRITTEN[0]
    assert os.path.isdir(path)
    io.clear_stored(spark)
    assert not os.path.exists(path) and not io.WRITTEN


def test_spans(spark):
    from codeloom.operators import scanner as N

    ts = "// Adds one.\n// @internal\nexport const useAdd = async (\n  a: number,\n): Promise<number> => {\n  return a;\n};\n\nexport const LIST = [\n  1,\n];\nexport type T = 'a';\n\ninterface I {\n  x: number;\n}\n"
    py = 'class A:\n    """Says what it is."""\n\n    def run(self):\n        return 1\n\n\n# about f\ndef f(\n    a,\n):\n    return a\n'
    go = "package a\n\n// Kind of thing.\ntype Kind int\n\ntype S[T any, K comparable] struct {\n\tA int\n}\n\nconst (\n\tOne Kind = iota\n\ttwo\n)\n\nconst Max = 3 // most\n"
    f = spark.createDataFrame([("a.ts", ts, 1), ("b.py", py, 1), ("c.go", go, 1), ("a.ts", ts, 1), ("n.ts", None, 0), (None, "x", 1)], "path string, content string, length long").withColumn("language", F.lit(None).cast("string"))
    got = {r.name: r for r in N.spans(f).collect()}
    assert {(n, r.start_line, r.end_line) for n, r in got.items()} == {("useAdd", 3, 7), ("LIST", 9, 11), ("T", 12, 12), ("I", 14, 16), ("A", 1, 5), ("f", 9, 12), ("S", 6, 8)}
    assert got["useAdd"].docstring == "Adds one." and got["A"].docstring == "Says what it is." and got["I"].docstring is None
    assert (got["useAdd"].is_async, got["useAdd"].is_arrow_function, got["useAdd"].is_hook, got["useAdd"].is_constant) == (True, True, True, False)
    assert (got["LIST"].is_constant, got["LIST"].constant_kind) == (True, "array") and got["f"].snippet.endswith("return a")
    assert {(r.name, r.type, r.exported) for r in N.go_members(f).collect()} == {("Kind", "type", True), ("One", "variable", True), ("Max", "variable", True)}
    assert one(spark, N.type_parameters, "type S[T any, K comparable] struct") == ["T any", "K comparable"] and one(spark, N.type_parameters, "func f()") == []
    assert {(r.language, r.error, r.files) for r in N.scan_errors(f).collect()} == {("typescript", "empty", 1)}
    assert N.spans(f.limit(0)).count() == 0


def test_spans_agree_with_delivered_components(spark):
    import os

    from codeloom.io import table
    from codeloom.operators import scanner as N

    base = os.environ.get("CODELOOM_TESTDATA", "/root/testdata/sf0.001")
    if not os.path.isdir(base):
        pytest.skip("no test tables")
    rows = N.span_agreement(table(spark, base, "source_files"), table(spark, base, "components")).collect()
    found = sum(r.found for r in rows)
    assert found > 50 and sum(r.same_end for r in rows) == found and sum(r.same_snippet for r in rows) >= 0.97 * found


def test_history(spark):
    from codeloom.operators import history as H

    rows = [(i, f"feat: step {i}\n\n" + "body " * 200, "commit", f"f{i % 2}.ts", "r", f"2024-01-{i + 1:02d}") for i in range(25)] + [(90, None, "commit", "old.ts", "r", "2023-01-01"), (91, "x", "issue", "f0.ts", "r", "2024-01-01"), (92, "note", "commit", None, None, None)]
    d = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, kind string, file string, repository string, t string").withColumn("created_at", F.to_timestamp("t"))
    got = {(r.file, r.position): r.doc_id for r in H.file_history(d, n=3).collect()}
    assert got == {("f0.ts", 1): 24, ("f0.ts", 2): 22, ("f0.ts", 3): 20, ("f1.ts", 1): 23, ("f1.ts", 2): 21, ("f1.ts", 3): 19, ("old.ts", 1): 90}
    renames = spark.createDataFrame([("f0.ts", "mid.ts"), ("mid.ts", "old.ts"), ("old.ts", "older.ts")], "path string, previous_path string")
    assert {tuple(r) for r in H.earlier_names(renames).filter("path = 'f0.ts'").collect()} == {("f0.ts", "mid.ts"), ("f0.ts", "old.ts"), ("f0.ts", "older.ts")}
    assert {r.doc_id for r in H.file_history(d, renames, 30).filter("file = 'f0.ts'").collect()} == {i for i in range(25) if i % 2 == 0} | {90}
    cut = H.commit_budget(d.filter("doc_id < 25"), "repository", 330).orderBy("rank").collect()
    assert cut[0].doc_id == 24 and cut[0].tokens > 200 and all(r.tokens < 10 for r in cut[1:]) and cut[-1].used + 50 <= 330 < cut[-1].used + 50 + 10
    assert {r.criterion for r in H.acceptance_criteria(spark.createDataFrame([(1, "- [ ] other\n## Acceptance Criteria\n- [ ] one\n- [x] two\n- [ ] three\n## Notes\n- [ ] four"), (2, None)], "doc_id long, text string")).collect()} == {"one", "three"}
    q = spark.createDataFrame([("Title #1", "see [docs](http://x) and `code`\n```\nhidden\n```\nend")], "title string, body string").select(H.search_query().alias("q")).first().q
    assert q == "Title 1 see docs and code\n\nend"
    assert one(spark, H.clean_description, " a<!-- x\ny -->\n\n\n\nb ") == "a\n\nb"
    assert H.commit_search(d.limit(0), "x").count() == 0 and H.related_by_title(d, 12345).count() == 0


def test_components(spark):
    from codeloom.operators import components as K

    rows = [("a", "x.ts", "function", "TypeScript", True, "f", ["m", "n"], 2, 3), ("b", "x.ts", "class", None, None, "C", ["m"], 1, 1), ("c", "y.go", "Function", "go", False, None, None, None, None)]
    c = spark.createDataFrame(rows + rows[:1], "id string, file string, type string, language string, exported boolean, name string, imports array<string>, start_line long, end_line long")
    ids = lambda d: sorted({r.id for r in d.collect()})
    assert ids(K.by_export(c)) == ["a"] and ids(K.by_export(c, False)) == ["c"] and ids(K.by_types(c, ["function"])) == ["a"] and ids(K.by_languages(c, ["typescript"])) == ["a"]
    f = spark.createDataFrame([("x.ts", "l1\nl2\nl3"), ("x.ts", "l1\nl2\nl3"), ("y.go", None)], "path string, content string")
    ch = spark.createDataFrame([("x.ts", 3, 2, None)], "file_path string, commit_count long, author_count long, last_modified timestamp")
    got = {r.file_path: (r.num_components, r.num_functions, r.num_imports, r.lines_of_code, r.commit_count, r.author_count) for r in K.code_metadata(c, f, ch).collect()}
    assert got == {"x.ts": (2, 1, 2, 3, 3, 2), "y.go": (1, 0, 0, 1, 0, 0)}
    assert {r.id: r.lines for r in K.component_lines(c.withColumn("x", F.lit(1)), f).collect()} == {"a": "l2\nl3", "b": "l1"}
    s = spark.createDataFrame([("x.ts", "2024-01-01 00:00:00"), ("z", None), (None, None)], "path string, t string").withColumn("last_indexed", F.to_timestamp("t"))
    now = F.to_timestamp(F.lit("2024-01-01 00:15:00"))
    assert {(r.path, r.stale) for r in K.stale(s, now).collect()} == {("x.ts", False), ("z", True)}


def test_one_scan_of_texts_for_all_pattern_modes(spark):
    """The contents are matched once, and one aggregate gives all modes."""
    from codeloom.operators import patterns as P

    rows = [(f"p{i}.ts", "import a\n" if i % 3 else "require('x')", "r" if i < 8 else None) for i in range(10)]
    f = spark.createDataFrame([(p, t, r, "typescript", len(t)) for p, t, r in rows], "path string, content string, repository string, language string, length long")
    t = spark.createDataFrame([], "file string, coverage string")
    x = P.compare(P.file_patterns(f), t, ["repository"])
    p = x._jdf.queryExecution().optimizedPlan().toString()
    assert "content" not in p
    assert {(r.repository, r.common_import_style, r.common_coverage) for r in x.collect()} == {("r", "esm", "none"), (None, "esm", "none")}


def test_scanners_of_ones_own(spark):
    from codeloom.operators import scanner as N

    def scan(path, content):
        if "bad" in content:
            raise ValueError("no")
        for n, line in enumerate(content.split("\n"), 1):
            yield {"name": line, "start_line": n}

    f = spark.createDataFrame([("a.ts", "x\ny"), ("a.ts", "x\ny"), ("b.ts", "bad"), ("c.go", "z"), ("n.ts", None), (None, "x")], "path string, content string")
    got = {(r.file, r.name, r.start_line, r.type, r.error) for r in N.scan_with(f, scan, ["ts"]).collect()}
    assert got == {("a.ts", "x", 1, None, None), ("a.ts", "y", 2, None, None), ("b.ts", None, None, None, "ValueError: no"), ("n.ts", "", 1, None, None)}
    assert N.scan_with(f.limit(0), scan, ["ts"]).count() == 0


def test_worst_status(spark):
    e = spark.createDataFrame([("u", "a"), ("u", "b"), ("v", "b"), ("w", None), (None, "a")], "user_id string, event_type string")
    assert {(r.user_id, r.status) for r in R.worst_status(e, "user_id", {"a": 2, "b": 1}).collect()} == {("u", "unhealthy"), ("v", "degraded"), ("w", "healthy"), (None, "unhealthy")}
