import json

from pyspark.sql import functions as F

from auditlake.operators import files as fo
from auditlake.operators import fleet, publishing
from auditlake.operators import policies as po
from auditlake.plans import audit as plan

from . import frames

KEY = ("o/r", "1")

MARKDOWN = """## Repository Quality: 0/100 (F)

Policy threshold: **60/100** · Result: **Needs work**

| Check | Result | Points |
|---|---:|---:|
| License | ❌ Needs work | 0/10 |

### Required files

- Missing required file: `a`
- Missing required file: `b`

### Recommended next steps

- **License:** Add a LICENSE and clarify whether data have separate reuse terms.%s

### Policy warnings

- `ignore_paths` must be a list of paths or check keys.

_This automated review supports maintainers; it does not certify scientific validity, privacy compliance, or research ethics._"""
POLICY = json.dumps(
    {
        "minimum_score": 60,
        "required_files": ["a", "b"],
        "ignore_paths": 1,
        "disabled_checks": [
            "readme", "citation", "dependencies", "reproduction", "tests", "data_dictionary",
            "provenance", "privacy", "ethics",
        ],
    }
)


def report(spark, entries, policy=POLICY, dialect="py", key=KEY):
    typed = po.validate_policies(frames.raw_policies(spark, {key[0]: policy}), dialect)
    files = frames.files(spark, {key: entries})
    return plan.audit(files, frames.commits(spark, [key]), typed, dialect), files


def test_markdown_layout(spark):
    for dialect, link in (("py", ""), ("js", " [Guidance](README.md#license)")):
        frame, _ = report(spark, [("x", None)], dialect=dialect)
        assert publishing.markdown_reports(frame, dialect).first().markdown == MARKDOWN % link


def test_markdown_without_findings(spark):
    frame, _ = report(spark, [("LICENSE", None)], POLICY.replace('"a", "b"', ""))
    markdown = publishing.markdown_reports(frame, title="100% good").first().markdown
    assert markdown.startswith("## 100% good: 100/100 (A)\n")
    assert "- All configured quality checks passed." in markdown
    assert "- All configured required files are present." in markdown


def test_check_run_py_and_js(spark):
    frame, _ = report(spark, [("LICENSE", None)])
    run = publishing.check_runs(frame).first()
    assert (run.head_sha, run.status, run.conclusion) == ("1", "completed", "failure")
    assert run.output.title == "Quality score: 100/100 (A)"
    assert run.output.annotations == []
    frame, files = report(spark, [("src/x", None), ("readme.RST", "")], dialect="js")
    run = publishing.check_runs(frame, "js", files=files).first()
    assert run.output.summary.endswith("\n\nPrevious audited commit: **not available**")
    (note,) = run.output.annotations
    assert (note.path, note.start_line, note.end_line) == ("readme.RST", 1, 1)
    assert (note.annotation_level, note.title) == ("warning", "License")
    assert note.raw_details == "README.md#license"


def test_annotations_use_the_first_path_or_nothing(spark):
    def notes(entries):
        frame, files = report(spark, entries, dialect="js")
        return [n.path for n in publishing.annotations(frame, files).first().annotations]

    assert notes([("src/b", None), ("src/a", None)]) == ["src/b"]
    assert notes([("docs/README.md", None), ("README.md", None)]) == ["README.md"]
    assert notes([]) == []


def test_previous_score_and_delta(spark):
    commits = spark.createDataFrame(
        [("o/r", "2", ["1", "9"]), ("o/r", "3", ["2"]), ("o/r", "4", []), ("o/r", "5", ["4"])],
        "repository string, sha string, p array<string>",
    ).selectExpr("repository", "sha", "transform(p, s -> named_struct('sha', s)) AS parents")
    runs = spark.createDataFrame(
        [
            ("o/r", "1", "Repository Quality", "Quality score: 70/100 (C)", 1),
            ("o/r", "1", "Repository Quality", "Quality score: 90/100 (A)", 2),
            ("o/r", "2", "Other", "Quality score: 50/100 (F)", 1),
            ("o/r", "4", "Repository Quality", "no score", 1),
            ("o/r", "4", "Repository Quality", "Quality score: 90/100 (A)", 2),
        ],
        "repository string, head_sha string, name string, title string, run_seq int",
    )
    previous = publishing.previous_scores(commits, runs)
    assert {(r.sha, r.previous_score) for r in previous.collect()} == {
        ("2", 70), ("3", None), ("4", None), ("5", None),
    }
    scores = spark.createDataFrame([(75, 70), (70, 70), (60, 70), (60, None)], "score int, previous_score int")
    lines = [r.t for r in scores.selectExpr(f"{publishing.score_delta()} AS t").collect()]
    prefix = "\n\nScore change from previous audited commit: **"
    assert lines == [
        prefix + "+5** (70 → 75)",
        prefix + "+0** (70 → 70)",
        prefix + "-10** (70 → 60)",
        "\n\nPrevious audited commit: **not available**",
    ]


def test_report_json(spark):
    frame, files = report(spark, [("LICENSE", None), ("x/license.MD", None)], '{"minimum_score":5}')
    documents = publishing.report_documents(frame, plan.file_evidence(files))
    (row,) = publishing.report_json(documents).collect()
    document = json.loads(row.report)
    assert list(document) == [
        "repository", "score", "grade", "passed", "minimum_score", "missing_required_files",
        "policy_warnings", "checks",
    ]
    assert (document["score"], document["passed"]) == (10, True)
    license = document["checks"][1]
    assert list(license) == [
        "key", "title", "passed", "points", "recommendation", "term_evidence", "evidence_count",
    ]
    assert (license["term_evidence"], license["evidence_count"]) == ([], 2)


def test_content_is_attached_to_selected_files_only(spark):
    files = frames.files(
        spark, {KEY: [("README.md", None), ("docs/codebook.md", None), ("src/a", None)]}
    ).drop("content")
    blobs = spark.createDataFrame(
        [("o/r", "1", "README.md", "YWJj\nZGVm/w=="), ("o/r", "1", "src/a", "YQ==")],
        "repository string, sha string, path string, content_base64 string",
    )

    def content(dialect):
        return {r.path: r.content for r in fo.attach_content(files, blobs, dialect).collect()}

    assert content("py") == {"README.md": "abcdef�", "docs/codebook.md": "", "src/a": None}
    assert content("js") == {"README.md": "abcdef�", "docs/codebook.md": None, "src/a": None}


def test_tree_blobs_keep_the_position(spark):
    trees = spark.createDataFrame(
        [("o/r", "1", [("src", "tree"), ("a", "blob"), ("m", "commit"), ("b", "blob")]), ("o/r", "2", None)],
        "repository string, sha string, tree array<struct<path:string,type:string>>",
    )
    rows = {(r.sha, r.seq, r.path) for r in fo.tree_blobs(trees).collect()}
    assert rows == {("1", 1, "a"), ("1", 3, "b")}


def test_fleet_listing_and_requests(spark):
    installations = spark.createDataFrame(
        [
            (2, [(False, "o/b", "main", "u"), (True, "o/secret", "main", "u")]),
            (1, [(None, "o/B", "dev", "u"), (False, "o/b", "dev", "u"), (False, "o/a", "main", "u")]),
        ],
        "id bigint, repositories array<struct<private:boolean,full_name:string,"
        "default_branch:string,html_url:string>>",
    )
    listed = [r.full_name for r in fleet.public_repositories(installations).collect()]
    assert listed == ["o/a", "o/b", "o/b", "o/B"]
    assert "installation_id" not in fleet.repository_listing(installations).columns
    requests = spark.createDataFrame(
        [(1, "o/b"), (2, "o/secret"), (3, ""), (4, None), (5, "o/a")], "id int, repository string"
    )
    heads = spark.createDataFrame(
        [("o/b", "main", "s1"), ("o/b", "dev", "s2")], "repository string, branch string, sha string"
    )
    rows = fleet.resolve_requests(requests, installations, heads).collect()
    assert sorted((r.id, r.status, r.installation_id, r.sha) for r in rows) == [
        (1, "ready", 1, "s2"),
        (2, "Repository is not a public App installation", None, None),
        (3, "Repository is required", None, None),
        (4, "Repository is required", None, None),
        (5, "ready", 1, None),
    ]


def test_files_without_path_and_broken_contents_stay(spark):
    files = frames.files(spark, {KEY: [(None, None), ("README.md", None), ("README.rst", None)]})
    blobs = spark.createDataFrame(
        [("o/r", "1", "README.md", "not base64!"), ("o/r", "1", "README.rst", "YQ==")],
        "repository string, sha string, path string, content_base64 string",
    )
    rows = fo.attach_content(files.drop("content"), blobs).collect()
    assert {(r.path, r.content, r.content_error) for r in rows} == {
        (None, None, None),
        ("README.md", "", "content is not base64"),
        ("README.rst", "a", None),
    }


def test_annotations_point_to_the_first_readme_as_it_is_spelled(spark):
    trees = {
        ("r", "1"): ["a.py", "ReadMe.RST", "README.md"],
        ("r", "2"): ["docs/README.md", "b.py", "rEADME.mD"],
        ("r", "3"): ["z/first.py", "a.py", "readme.md.bak"],
        ("r", "4"): ["README.rst"],
        ("r", "5"): ["", "x"],
        ("s", "3"): ["é.py", "readme.MD"],
    }
    files = frames.files(spark, {key: [(path, None) for path in found] for key, found in trees.items()})
    files = files.orderBy(F.desc("seq"))
    found = {(r.repository, r.sha): r.annotation_path for r in publishing.readme_paths(files).collect()}
    assert found == {
        ("r", "1"): "ReadMe.RST", ("r", "2"): "rEADME.mD", ("r", "3"): "z/first.py", ("r", "4"): "README.rst",
        ("r", "5"): "", ("s", "3"): "readme.MD",
    }
    plan_ = publishing.readme_paths(files)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan_ and "ObjectHashAggregate" not in plan_
