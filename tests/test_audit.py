"""The audit: one table of cases for the rules, then policies, dialects and sizes."""

import random

import pytest

from auditlake import catalog, schemas
from auditlake.functions import strings
from auditlake.operators import files as fo
from auditlake.operators import policies as po
from auditlake.operators import publishing, scoring
from auditlake.plans import audit as plan

from . import frames

KEY = ("org/survey", "c0ffee")
# Passes every check by its second or third way.
RIVER_SURVEY = [
    ("docs/variables/CODEBOOK.MD", "station,depth"),
    ("/ReadMe.rst/", "Source data: river gauges. All values are de-identified. Consent was given."),
    ("legal/COPYING", ""),
    ("codemeta.json", "{}"),
    ("env/environment.yml", None),
    ("workflow/Snakefile", "rule all:"),
    ("TESTS/depths.R", "stopifnot(TRUE)"),
]
ALL = set(catalog.CHECK_KEYS)


def run(spark, entries, policy=None, dialect="py"):
    typed = None
    if policy is not None:
        typed = po.validate_policies(frames.raw_policies(spark, {KEY[0]: policy}), dialect)
    report = plan.audit(
        frames.files(spark, {KEY: entries}), frames.commits(spark, [KEY]), typed, dialect
    )
    (row,) = report.collect()
    return row


def passed(row):
    return {check.key for check in row.checks if check.passed}


# name: files, checks that pass, points.  Written from the tables of the README.
CASES = {
    "everything": (RIVER_SURVEY, ALL, 100),
    "nothing": ([], set(), 0),
    "unrelated": ([("src/main.c", "int main"), ("notes/readme.md", "ethics")], set(), 0),
    "readme only": ([("README.md", "A survey.")], {"readme"}, 12),
    "blank readme": ([("README.md", " \t\n")], set(), 0),
    "readme not loaded": ([("README.md", None)], set(), 0),
    "phrases": (
        [("README.md", "HOW TO REPRODUCE: run it. Data Description below.")],
        {"readme", "reproduction", "data_dictionary"},
        36,
    ),
    "command": ([("readme.rst", "type make reproduce")], {"readme", "reproduction"}, 26),
    "near misses": (
        [("LICENSES", ""), ("my-makefile", ""), ("tests", ""), ("src/tests/a.py", ""), ("codebook", "")],
        set(),
        0,
    ),
    "anywhere": ([("a/b/LICENSE.txt", None), ("x/Makefile", None)], {"license", "reproduction"}, 24),
    "root folders": ([("tests/x", None)], {"tests"}, 12),
    "workflows": ([(".github/workflows/lint.yml", None)], {"tests"}, 12),
    "outer slashes": ([("//LICENSE//", None)], {"license"}, 10),
    "repeated": ([("LICENSE", None)] * 3 + [("license", None)], {"license"}, 10),
}


def test_rules(spark):
    repositories = {(name, "1"): files for name, (files, _, _) in CASES.items()}
    report = plan.audit(frames.files(spark, repositories), frames.commits(spark, repositories))
    rows = frames.by_key(report, "repository")
    assert {name: (passed(rows[(name,)]), rows[(name,)].score) for name in CASES} == {
        name: (keys, points) for name, (_, keys, points) in CASES.items()
    }
    best, worst = rows[("everything",)], rows[("nothing",)]
    assert (best.grade, best.passed) == ("A", True)
    assert (worst.grade, worst.passed, len(worst.checks)) == ("F", False, 10)


def test_a_policy_sets_threshold_checks_files_and_paths(spark):
    files = [entry for entry in RIVER_SURVEY if entry[0] != "legal/COPYING"]
    files += [("third_party/lib/LICENSE", None), ("protocols/Field.md", None)]
    policy = (
        '{"minimum_score": 70, "disabled_checks": ["citation"], "ignore_paths": ["third_party/"],'
        ' "required_files": ["Protocols/field.md", "data/sites.csv"]}'
    )
    row = run(spark, files, policy)
    assert (row.policy_warnings, row.minimum_score) == ([], 70)
    assert {check.key for check in row.checks} == ALL - {"citation"}
    assert passed(row) == ALL - {"citation", "license"}
    assert (row.earned, row.possible, row.score) == (82, 92, 89)
    assert (row.missing_required_files, row.passed) == (["data/sites.csv"], False)


@pytest.mark.parametrize("dialect", catalog.DIALECTS)
def test_own_privacy_terms_replace_the_defaults(spark, dialect):
    policy = '{"privacy_terms": ["River Gauges", "unheard of"]}'
    signals = plan.commit_signals(
        frames.files(spark, {KEY: RIVER_SURVEY, ("other", "1"): RIVER_SURVEY}),
        frames.commits(spark, [KEY, ("other", "1")]),
        po.validate_policies(frames.raw_policies(spark, {KEY[0]: policy}), dialect),
        dialect,
    )
    found = frames.by_key(plan.check_results(signals, dialect, keys=("privacy",)), "repository")
    assert found[(KEY[0],)].term_evidence == ["river gauges"]
    assert found[("other",)].term_evidence == ["de-ident"]


@pytest.mark.parametrize(
    "paths, ignored, kept",
    [
        (["vendor/LICENSE"], "vendor", False),
        (["vendors/LICENSE"], "vendor", True),
        (["LICENSE"], "license", False),
        (["a/vendor/LICENSE"], "vendor", True),
    ],
)
def test_ignored_prefix_ends_at_a_slash(spark, paths, ignored, kept):
    row = run(spark, [(p, None) for p in paths], f'{{"ignore_paths":["{ignored}"]}}')
    assert {c.key: c.passed for c in row.checks}["license"] is kept


def test_readme_choice_differs_between_dialects(spark):
    both = [("README.rst", "ethics"), ("README.md", "data source")]
    null_first = [("README.md", None), ("README.rst", "ethics")]
    empty_first = [("README.md", ""), ("README.rst", "ethics")]

    def passes(entries, dialect):
        return {c.key for c in run(spark, entries, dialect=dialect).checks if c.passed}

    assert passes(both, "py") == {"readme", "ethics"}
    assert passes(both, "js") == {"readme", "provenance"}
    assert passes(null_first, "py") == set()
    assert passes(null_first, "js") == {"readme", "ethics"}
    assert passes(empty_first, "py") == passes(empty_first, "js") == set()


def test_last_content_wins_at_first_position(spark):
    entries = [("README.md", "ethics"), ("readme.rst", "consent"), ("/Readme.md/", "data source")]
    keys = {c.key for c in run(spark, entries).checks if c.passed}
    assert keys == {"readme", "provenance"}


def test_blank_readme_fails_with_evidence(spark):
    (row,) = plan.check_results(
        plan.commit_signals(
            frames.files(spark, {KEY: [("README.md", " \n ")]}), frames.commits(spark, [KEY])
        ),
        keys=("readme",),
    ).collect()
    assert (row.passed, row.term_evidence) == (False, ["README"])


def test_rounding_differs_between_dialects(spark):
    rows = [("r", f"{e}/{p}", e, p) for p in range(0, 101) for e in range(0, p + 1)]
    frame = spark.createDataFrame(rows, "repository string, sha string, earned int, possible int")
    from auditlake.functions import scoring as fs

    out = frame.selectExpr(
        "*", f"{fs.score('earned', 'possible')} AS py", f"{fs.score('earned', 'possible', 'js')} AS js"
    )
    import math

    for row in out.collect():
        ratio = row.earned / row.possible * 100 if row.possible else 0
        assert row.py == round(ratio)
        assert row.js == math.floor(ratio + 0.5)


def test_disabling_everything_scores_zero(spark):
    policy = '{"disabled_checks":[%s]}' % ",".join(f'"{k}"' for k in catalog.CHECK_KEYS)
    row = run(spark, RIVER_SURVEY, policy)
    assert (row.score, row.grade, row.checks) == (0, "F", [])


def test_long_policy_lists_keep_every_entry(spark):
    names = ",".join(f'"need/{n}.txt"' for n in range(200))
    terms = ",".join(f'"word{n}"' for n in range(150))
    policy = '{"required_files":[%s],"privacy_terms":[%s]}' % (names, terms)
    files = [("need/199.txt", None), ("README.md", "word149")]
    for dialect in catalog.DIALECTS:
        row = run(spark, files, policy, dialect)
        assert row.missing_required_files == [f"need/{n}.txt" for n in range(199)]
        assert passed(row) == {"readme", "privacy"}
        assert row.policy_warnings == []


def test_a_list_limit_is_a_choice(spark):
    raw = frames.raw_policies(spark, {"r": '{"required_files":["a", 1, "b", "c"]}'})
    for dialect, kept in (("py", ["a"]), ("js", ["a", "b"])):
        assert po.validate_policies(raw, dialect, list_limit=2).first().required_files == kept


def test_evidence_is_whole_and_never_counted_twice(spark):
    """A commit with 20,000 license paths, and a third of all files in one commit."""
    many = [(f"d{n}/LICENSE", None) for n in range(20_000)] + [(f"tests/{n}", None) for n in range(9)]
    repositories = {KEY: many, ("small", "1"): [("LICENSE", None), ("license", None)], ("none", "2"): []}
    files, commits = frames.files(spark, repositories), frames.commits(spark, repositories)
    signals = plan.commit_signals(files, commits)
    evidence = plan.file_evidence(files)
    assert evidence.count() == 20_000 + 9 + 1
    results = plan.results_with_evidence(plan.check_results(signals), evidence)
    counts = frames.by_key(results, "repository", "key")
    assert len(counts) == 30
    assert counts[(KEY[0], "license")].evidence_count == 20_000
    assert counts[(KEY[0], "tests")].evidence_count == 9
    assert counts[("small", "license")].evidence_count == 1
    assert counts[("none", "license")].evidence_count == 0
    scored = frames.by_key(scoring.score_results(results), "repository")
    assert {key[0]: (row.earned, row.possible) for key, row in scored.items()} == {
        KEY[0]: (22, 100), "small": (10, 100), "none": (0, 100),
    }
    documents = publishing.report_documents(plan.reports(signals), evidence).collect()
    assert {d.repository: {c.key: c.evidence_count for c in d.checks}["license"] for d in documents} == {
        KEY[0]: 20_000, "small": 1, "none": 0,
    }
    assert publishing.evidence_json(evidence).filter("sha = '1'").first().line == (
        '{"repository":"small","sha":"1","key":"license","path":"license"}'
    )


def test_stored_results_score_like_the_audit(spark):
    repositories = {("o/a", "1"): RIVER_SURVEY, ("o/b", "2"): RIVER_SURVEY[2:], ("o/c", "3"): []}
    files = frames.files(spark, repositories)
    typed = po.validate_policies(
        frames.raw_policies(spark, {"o/b": '{"disabled_checks":["privacy","tests"]}'})
    )
    signals = plan.commit_signals(files, frames.commits(spark, repositories), typed)
    stored = scoring.enabled_checks(plan.check_results(signals), typed)
    scores = {(r.repository, r.score, r.grade) for r in scoring.score_results(stored).collect()}
    assert scores == {(r.repository, r.score, r.grade) for r in plan.reports(signals).collect()}


def test_commit_policies_win_over_nothing_else(spark):
    """A policies table with a sha column applies to that commit only."""
    keys = [("o/a", "1"), ("o/a", "2")]
    files = frames.files(
        spark, {keys[0]: [(".repo-quality.yml", '{"minimum_score":0}')], keys[1]: []}
    )
    typed = po.validate_policies(po.pick_policy(files))
    rows = frames.by_key(plan.audit(files, frames.commits(spark, keys), typed), "sha")
    assert (rows[("1",)].minimum_score, rows[("1",)].passed) == (0, True)
    assert (rows[("2",)].minimum_score, rows[("2",)].passed) == (80, False)


def test_long_lists_of_ignored_and_required_paths(spark):
    """Lists too long to be walked by every file give what a plain loop over them gives."""
    random_ = random.Random(4)
    folders = [f"{a}{n}" for a in "abcdef" for n in range(40)]

    def some_path():
        return "/".join(random_.choice(folders) for _ in range(random_.randint(1, 4)))

    ignored, required = [some_path() for _ in range(3000)], [some_path() for _ in range(2500)]
    policies = {
        "long": (sorted(set(ignored)), list(dict.fromkeys(required))),
        "short": (ignored[:3], required[:5]),
        "mixed": (sorted(set(ignored)), required[:5]),
        "other": (ignored[:3], list(dict.fromkeys(required))),
        "none": ([], []),
    }
    stored = {
        (name, sha): list(dict.fromkeys(some_path() for _ in range(300)))
        + list(dict.fromkeys(random_.sample(required, 200) + random_.sample(ignored, 50)))
        + ["README.md", "license"]
        for name in policies
        for sha in ("1", "2")
    }
    files = frames.files(spark, {key: [(path, None) for path in found] for key, found in stored.items()})
    rows = [(n, 80, [], r, i, ["confidential"], []) for n, (i, r) in policies.items()]
    typed = spark.createDataFrame(rows, schemas.POLICIES)

    def visible(key):
        prefixes = policies[key[0]][0]
        norm = [path.strip("/").lower() for path in stored[key]]
        return [p for p in norm if not any(p == x or p.startswith(x + "/") for x in prefixes)]

    kept = fo.drop_ignored(fo.normalised(files), typed).collect()
    found = {}
    for row in kept:
        found.setdefault((row.repository, row.sha), []).append(row.path_norm)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(visible(k)) for k in stored}
    report = frames.by_key(plan.audit(files, frames.commits(spark, stored), typed), "repository", "sha")
    for key in stored:
        present = set(visible(key))
        expected = [path for path in policies[key[0]][1] if path not in present]
        assert report[key].missing_required_files == expected
        passed = {c.key: c.passed for c in report[key].checks}
        assert passed["license"] is ("license" in present)


def test_own_terms_follow_the_readme_that_counts(spark):
    """Of two versions of one README the later counts, of two READMEs the first (py) or Markdown (js)."""
    entries = [("README.rst", "has alpha"), ("readme.md", "has beta"), ("README.MD", "has gamma"), ("x", None)]
    files = frames.files(spark, {("r", "1"): entries, ("r", "2"): entries[1:], ("r", "3"): [("readme.md", None), *entries[:1]]})
    typed = spark.createDataFrame([("r", 80, [], [], [], ["beta", "alpha", "gamma", "alp"], [])], schemas.POLICIES)
    commits = frames.commits(spark, [("r", "1"), ("r", "2"), ("r", "3"), ("r", "4")])
    expected = {"py": [["alpha", "alp"], ["gamma"], [], []], "js": [["gamma"], ["gamma"], ["alpha", "alp"], []]}
    for dialect, terms in expected.items():
        report = frames.by_key(plan.audit(files, commits, typed, dialect), "sha")
        found = [next(c for c in report[(sha,)].checks if c.key == "privacy") for sha in "1234"]
        assert [c.term_evidence for c in found] == terms
        assert [c.passed for c in found] == [bool(t) for t in terms]


def test_long_lists_of_privacy_terms(spark):
    """One pass over the text finds what looking for each term finds, overlapping and nested terms included."""
    random_ = random.Random(6)
    terms = list(dict.fromkeys("".join(random_.choice("abé ") for _ in range(random_.randint(1, 6))).strip() for _ in range(900)))
    terms = [t for t in terms if t]
    assert len(terms) > strings.SHORT_LIST
    texts = ["".join(random_.choice("abcé \n") for _ in range(random_.randint(0, 80))) for _ in range(40)] + [None, ""]
    files = frames.files(spark, {("r", str(k)): [("README.md", text)] for k, text in enumerate(texts)} | {("s", "0"): [("README.md", "ab")]})
    rows = [("r", 80, [], [], [], terms, []), ("s", 80, [], [], [], ["zz", "b"], [])]
    typed = spark.createDataFrame(rows, schemas.POLICIES)
    commits = frames.commits(spark, [("r", str(k)) for k in range(len(texts))] + [("s", "0")])
    report = frames.by_key(plan.audit(files, commits, typed), "repository", "sha")
    for k, text in enumerate(texts):
        check = next(c for c in report["r", str(k)].checks if c.key == "privacy")
        assert check.term_evidence == [t for t in terms if t in (text or "").lower()]
    assert next(c for c in report["s", "0"].checks if c.key == "privacy").term_evidence == ["b"]
    readmes = fo.select_readme(files.filter("repository = 'r'"))
    matched = {r.sha: r.matched for r in fo.readme_terms(readmes, tuple(terms)).collect()}
    assert matched == {str(k): [t for t in terms if t in (text or "").lower()] for k, text in enumerate(texts)}
