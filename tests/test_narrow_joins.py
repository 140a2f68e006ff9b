"""What is sent to joins of commits with commits, and of files with commits."""

from auditlake.operators import lookup, policies, publishing
from auditlake.plans import audit as plan
from auditlake.sources import inventory

from . import frames


def _small_fleet(spark):
    tree = {("o/r", sha): [("LICENSE", None), ("README.md", f"Data source {sha}")] for sha in "abc"}
    tree |= {("o/s", "d"): [("src/x.py", None), ("tests/t.py", None)], ("o/s", "e"): []}
    files, commits = frames.files(spark, tree), frames.commits(spark, list(tree))
    raw = frames.raw_policies(spark, {"o/r": '{"minimum_score":60}', "o/s": '{"required_files":["LICENSE"]}'})
    return files, commits, policies.policy_table(raw)


def _plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_rows_are_sifted_before_a_semi_join(spark):
    facts = spark.range(20_000).selectExpr("concat('o/r', id DIV 10) AS repository", "CAST(id AS STRING) AS sha", "id AS seq")
    targets = facts.filter("seq % 500 = 0").select("repository", "sha")
    left = lookup.sifted(facts, targets, ["repository", "sha"])
    assert left.count() < 2_000 and left.join(targets, ["repository", "sha"], "left_semi").count() == 40
    restricted = inventory.restrict_to(facts, targets)
    assert restricted.count() == 40 and "LeftSemi" in _plan(restricted) and "_place" in _plan(restricted)
    nulls = facts.selectExpr("IF(seq % 2 = 0, NULL, repository) AS repository", "sha", "seq")
    assert inventory.restrict_to(nulls, nulls.select("repository", "sha")).count() == 10_000
    assert inventory.restrict_to(facts, targets.limit(0)).count() == 0


def test_check_runs_meet_their_commits_before_reports_are_made(spark):
    files, commits, typed = _small_fleet(spark)
    previous = commits.selectExpr("repository", "sha", "IF(sha < 'c', 40, NULL) AS previous_score")
    report = plan.reports(plan.commit_signals(files, commits, typed, "js"), "js")
    plain = publishing.check_runs(report, "js", files=files, previous=previous)
    signals = plan.commit_signals(files, commits, typed, "js", beside=[previous, publishing.readme_paths(files)])
    runs = publishing.check_runs(plan.reports(signals, "js"), "js", files=files, previous=previous)
    assert sorted(runs.collect(), key=str) == sorted(plain.collect(), key=str)
    assert runs.count() == 5 and _plan(runs).count("Join") == _plan(signals).count("Join")


def test_evidence_is_counted_before_reports_are_made(spark):
    files, commits, typed = _small_fleet(spark)
    evidence = plan.file_evidence(files, typed)
    plain = publishing.report_documents(plan.reports(plan.commit_signals(files, commits, typed)), evidence)
    signals = plan.commit_signals(files, commits, typed, beside=[publishing.evidence_counts(evidence)])
    documents = publishing.report_documents(plan.reports(signals), evidence)
    assert sorted(publishing.report_json(documents).collect()) == sorted(publishing.report_json(plain).collect())
    assert _plan(documents).count("Join") == _plan(signals).count("Join")
    counts = {(r.sha, c.key): c.evidence_count for r in documents.collect() for c in r.checks}
    assert (counts["a", "license"], counts["d", "tests"], counts["e", "tests"]) == (1, 1, 0)


def test_defaults_of_policies_are_not_sent(spark, monkeypatch):
    raw = frames.raw_policies(spark, {"o/r": "{}", "o/s": '{"minimum_score":60,"privacy_terms":["x"]}'})
    sent, join = [], policies.lookup
    monkeypatch.setattr(policies, "lookup", lambda rows, table, *a, **b: join(rows, sent.append(table) or table, *a, **b))
    rows = spark.createDataFrame([("o/r", "a"), ("o/s", "b"), ("o/t", "c")], "repository string, sha string")
    found = {r.sha: r for r in policies.with_policy(rows, policies.validate_policies(raw), ["sha"]).collect()}
    assert {r.repository: (r.minimum_score, r.privacy_terms) for r in sent[0].collect()} == {"o/r": (None, None), "o/s": (60, ["x"])}
    assert (found["a"].minimum_score, found["b"].minimum_score) == (80, 60)
    assert found["a"].privacy_terms == found["c"].privacy_terms and found["b"].privacy_terms == ["x"]


def test_signals_that_are_kept_are_not_computed_again(spark):
    files, commits, typed = _small_fleet(spark)
    kept = plan.commit_signals(files, commits, typed, keep=True)
    assert sorted(kept.collect(), key=str) == sorted(plan.commit_signals(files, commits, typed).collect(), key=str)
    assert "Aggregate" not in _plan(kept)
