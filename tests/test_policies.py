import json

import pytest

from auditlake import catalog
from auditlake.operators import policies as po

from . import frames


def typed(spark, text, dialect="py"):
    return po.validate_policies(frames.raw_policies(spark, {"o/r": text}), dialect).first()


def test_invalid_values_fall_back_and_warn(spark):
    text = '{"minimum_score":101,"disabled_checks":["unknown"],"required_files":"invalid"}'
    for dialect in catalog.DIALECTS:
        row = typed(spark, text, dialect)
        assert row.minimum_score == 80
        assert (row.disabled_checks, row.required_files, row.ignore_paths) == ([], [], [])
        assert row.privacy_terms == list(catalog.DEFAULT_PRIVACY_TERMS)
        assert row.policy_warnings == [
            "`minimum_score` must be an integer from 0 to 100.",
            "Unknown disabled check: `unknown`.",
            "`required_files` must be a list of paths or check keys.",
        ]


@pytest.mark.parametrize(
    "value, py, js",
    [
        ("80.0", None, 80),
        ("0", 0, 0),
        ("100", 100, 100),
        ("-1", None, None),
        ("8e1", None, 80),
        ("79.5", None, None),
        ("true", None, None),
        ("null", None, None),
        ('"90"', None, None),
        ("123456789012345678901234567890", None, None),
        ("[90]", None, None),
    ],
)
def test_minimum_score(spark, value, py, js):
    for dialect, expected in (("py", py), ("js", js)):
        row = typed(spark, f'{{"minimum_score":{value}}}', dialect)
        assert row.minimum_score == (80 if expected is None else expected)
        assert len(row.policy_warnings) == (expected is None)


@pytest.mark.parametrize(
    "text, py, js",
    [
        (None, 0, 0),
        ("", 0, 1),
        ("  \n", 0, 1),
        ("null", 0, 1),
        (" null ", 0, 1),
        ("{}", 0, 0),
        ("[1]", 1, 1),
        ("5", 1, 1),
        ("not json {", 1, 1),
        ('{"minimum_score":1}}', 1, 1),
        ('{"minimum_score":1},{}', 1, 1),
        ('{"minimum_score":1}] x', 1, 1),
        ('{"minimum_score":1}} x', 1, 1),
        ('{"a":1,"a":2}', 1, 1),
    ],
)
def test_document_warnings(spark, text, py, js):
    for dialect, expected in (("py", py), ("js", js)):
        row = typed(spark, text, dialect)
        assert len(row.policy_warnings) == expected, (text, dialect)
        assert row.minimum_score == 80


def test_lists_are_whole_unless_a_limit_is_given(spark):
    entries = [1] * 10 + [f"f{n}" for n in range(60)]
    raw = frames.raw_policies(spark, {"r": json.dumps({"required_files": entries})})
    for limit, expected in ((None, {"py": 60, "js": 60}), (50, {"py": 40, "js": 50})):
        for dialect, kept in expected.items():
            row = po.validate_policies(raw, dialect, list_limit=limit).first()
            assert (len(row.required_files), len(row.policy_warnings)) == (kept, 10)


def test_cleaning_and_order(spark):
    text = json.dumps(
        {
            "required_files": [" /Docs/A.md/ ", "docs/a.md", "B", " C "],
            "ignore_paths": ["/Gen/", "gen"],
            "privacy_terms": [" Aggregate ", "IRB", "irb"],
            "disabled_checks": ["ethics", " ethics", "citation", "ethics", {}],
        }
    )
    row = typed(spark, text)
    assert row.required_files == ["docs/a.md", "b", "c"]
    assert row.ignore_paths == ["gen"]
    assert row.privacy_terms == ["aggregate", "irb"]
    assert row.disabled_checks == ["ethics", "citation"]
    assert row.policy_warnings == [
        "`disabled_checks` contains a non-string or empty value.",
        "Unknown disabled check: ` ethics`.",
    ]


def test_blank_entries_depend_on_the_dialect(spark):
    # U+001C is whitespace in py only, U+FEFF in js only.
    text = json.dumps({"required_files": ["\x1c", "﻿"]})
    assert typed(spark, text).required_files == ["﻿"]
    assert typed(spark, text, "js").required_files == ["\x1c"]


def test_null_is_not_the_same_as_absent(spark):
    for dialect in catalog.DIALECTS:
        row = typed(spark, '{"required_files":null,"privacy_terms":{"a":1}}', dialect)
        assert row.policy_warnings == [
            "`required_files` must be a list of paths or check keys.",
            "`privacy_terms` must be a list of paths or check keys.",
        ]
        assert row.privacy_terms == list(catalog.DEFAULT_PRIVACY_TERMS)


def test_pick_policy(spark):
    yml, yaml = catalog.POLICY_FILES
    files = frames.files(
        spark,
        {
            ("o", "both"): [(yaml, "Y"), (yml.upper(), "X")],
            ("o", "nested"): [("docs/" + yml, "X")],
            ("o", "null"): [(yml, None), (yaml, "Y")],
        },
    )

    def picked(**options):
        return {r.sha: r.policy_text for r in po.pick_policy(files, **options).collect()}

    assert picked() == {"both": "X", "null": None}
    assert picked(dialect="js") == {"both": "Y", "null": None}
    assert picked(exact_case=True) == {"both": "Y", "null": "Y"}
    assert picked(policy_files=("docs/" + yml,)) == {"nested": "X"}


def test_js_names_an_unreadable_policy(spark):
    raw = po.pick_policy(frames.files(spark, {("o", "1"): [(".repo-quality.yml", "a: [1")]}), "js")
    (row,) = po.validate_policies(raw, "js").collect()
    assert row.policy_warnings == ["Could not parse `.repo-quality.yml`: it is not one JSON value."]
    assert po.validate_policies(raw).first().policy_warnings == [catalog.WARN_UNPARSABLE]
