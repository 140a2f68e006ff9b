"""Engine inputs derived from the star-schema test tables.

Every input is a row-local projection of one test table, so it grows with that
table.  It is written once per session to the shared folder and read from
there, the way an inventory or a landing table is read in production.
FIXTURES.md describes the mapping.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.catalog import POLICY_FILES
from auditlake.functions.literals import text
from auditlake.functions.signature import hmac_sha256_hex
from auditlake.session import freed, shared_folder

Input = Callable[[SparkSession, str], DataFrame]
_LANDED: dict[tuple[str, str, str], str] = {}


def landed_folder(spark: SparkSession, sf_dir: str, build: Input) -> str:
    """Folder of an input; written when a session asks for it first."""
    key = (spark.sparkContext.applicationId, sf_dir, build.__name__)
    if key not in _LANDED:
        folder = shared_folder(spark)
        build(spark, sf_dir).write.option("compression", "zstd").parquet(folder)
        freed(spark)
        _LANDED[key] = folder
    return _LANDED[key]


def landed(build: Input) -> Input:
    """Makes an input a table that is written once and then read."""

    @wraps(build)
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.read.parquet(landed_folder(spark, sf_dir, build))

    read.build = build
    return read

SECRET = "fleet-secret"

# Path catalogue (index 0-47), with traps such as case, outer
# slashes and blanks, ignored folders, nested tests and near-miss names.
PATHS = (
    "README.md",
    "/readme.rst",
    "LICENSE",
    "docs/License.md",
    "CITATION.cff",
    "codemeta.json",
    "Requirements.txt",
    "env/environment.yml",
    "Makefile",
    "workflow/Snakefile",
    "tests/test_a.py",
    "test/b.R",
    ".github/workflows/ci.yml",
    "docs/CodeBook.md",
    "data/data-dictionary.csv",
    "readme.md/",
    "generated/tests/x.py",
    "vendor/LICENSE",
    "generated/Makefile",
    "vendors/COPYING",
    " README.rst",
    "src/tests/c.py",
    "docs/license.md.bak",
    "docs/README.md",
    *(f"src/m{n}.py" for n in range(12)),
    *(f"tests/unit/test_{n}.py" for n in range(6)),
    *(f"Data/raw_{n}.csv" for n in range(6)),
)

# README phrases (index 0-7).
PHRASES = (
    "",
    "Data source: survey.",
    "Data provenance notes.",
    "Privacy: aggregate.",
    "IRB not required.",
    "How to reproduce: run it.",
    "Data description below.",
    "Ethics and consent. Source data.",
)

# Policy documents (index 0-15); None is "no policy file".
# 200 required files, one of which is there, and 100 privacy terms.
LONG_POLICY = (
    '{"required_files":[' + ",".join(f'"need/file{n}.txt"' for n in range(199)) + ',"LICENSE"],'
    '"privacy_terms":[' + ",".join(f'"term{n}"' for n in range(99)) + ',"irb"]}'
)
POLICIES = (
    None,
    "{}",
    '{"minimum_score":60}',
    '{"minimum_score":80.0}',
    '{"minimum_score":101}',
    '{"minimum_score":true}',
    '{"disabled_checks":["ethics","citation","ethics"]}',
    '{"disabled_checks":["privacy","tests"]}',
    '{"disabled_checks":["unknown",3,""]}',
    '{"required_files":["CITATION.cff"," /docs/Protocol.md/ "],"ignore_paths":["generated","vendor"]}',
    '{"privacy_terms":["Aggregate"," IRB "],"required_files":"x"}',
    "[1]",
    '{"minimum_score":null}',
    "not json {",
    "",
    "null",
    LONG_POLICY,
)


def _pick(values: tuple[str | None, ...], index: str) -> str:
    items = ", ".join("NULL" if value is None else text(value) for value in values)
    return f"element_at(array({items}), CAST(({index}) % {len(values)} + 1 AS INT))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rows of a test table that one task turns into rows of an input.
ROWS_PER_TASK = 500_000


def spread(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """Columns of a test table, its rows dealt out by a hash of their key; the test tables are single files,
    which only one task can read.

    What is dealt out are the few columns asked for, before an input is made of them, to as many tasks as the rows need.
    """
    rows = table(spark, sf_dir, name).select(key, *columns)
    tasks = max(spark.sparkContext.defaultParallelism, rows.count() // ROWS_PER_TASK + 1)
    return rows.repartition(tasks, key)


def lines(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the order lines, those of an order together unless they are too many for a task."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", *columns).hint("rebalance", F.col("l_orderkey"))


def repository_name(key: str) -> str:
    """Ten consecutive orders are the commits of one repository."""
    return f"concat('org/repo', ({key}) DIV 10)"


@landed
def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One commit per order; the parent is the order before in the repository."""
    parent = "named_struct('sha', CAST(o_orderkey - 1 AS STRING))"
    merged = "named_struct('sha', CAST(o_orderkey - 2 AS STRING))"
    parents = (
        "CASE WHEN o_orderkey % 10 = 0 THEN CAST(array() AS ARRAY<STRUCT<sha: STRING>>)"
        f" WHEN o_orderkey % 10 = 5 THEN array({parent}, {merged}) ELSE array({parent}) END"
    )
    return spread(spark, sf_dir, "orders", "o_orderkey").selectExpr(
        f"{repository_name('o_orderkey')} AS repository",
        "CAST(o_orderkey AS STRING) AS sha",
        f"{parents} AS parents",
    )


# Catalogue index of the four file rows of an order line.
_SLOTS = (
    "l_partkey % 48",
    "l_suppkey % 48",
    "(l_orderkey * 7 + l_linenumber * 5) % 48",
    "(l_orderkey + l_linenumber) % 16",
)
_SEQ = "((l_linenumber * 1000000000L + l_partkey) * 100000000L + l_suppkey) * 4L + slot"


def _readme_text() -> str:
    shift = "IF(lower(path) LIKE '%rst%', 3, 0)"
    keys = ("l_partkey", "l_suppkey", "l_linenumber", "l_orderkey")
    phrases = ", ".join(_pick(PHRASES, f"{key} + {shift}") for key in keys)
    return (
        "CASE WHEN (l_orderkey + seq) % 11 = 0 THEN NULL"
        " WHEN (l_orderkey + seq) % 13 = 0 THEN ''"
        r" WHEN (l_orderkey + seq) % 17 = 0 THEN ' \n\t '"
        f" ELSE concat_ws(' ', {phrases}, concat('copy ', seq)) END"
    )


@landed
def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File inventory of all commits; only root READMEs carry text."""
    is_readme = "btrim(lower(path), ' /') IN ('readme.md', 'readme.rst')"
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return (
        lines(spark, sf_dir, *keys[1:])
        .selectExpr(
            *keys,
            f"posexplode(array({', '.join(_SLOTS)})) AS (slot, index)",
        )
        .selectExpr("*", f"{_SEQ} AS seq", f"{_pick(PATHS, 'index')} AS path")
        .selectExpr(
            f"{repository_name('l_orderkey')} AS repository",
            "CAST(l_orderkey AS STRING) AS sha",
            "seq",
            "path",
            f"IF({is_readme}, {_readme_text()}, NULL) AS content",
        )
    )


@landed
def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tree snapshots: one per order line, with folders and submodules mixed in.

    The snapshot name is the commit plus the line, because a line is the unit
    that can hold an array without grouping.
    """

    def entry(path: str, kind: str) -> str:
        return f"named_struct('path', {path}, 'type', {kind})"

    entries = [
        entry("'src'", "'tree'"),
        entry(_pick(PATHS, "l_partkey"), "'blob'"),
        entry(_pick(PATHS, "l_suppkey"), "IF(l_suppkey % 3 = 0, 'tree', 'blob')"),
        entry("'lib'", "'commit'"),
        entry(_pick(PATHS, _SLOTS[2]), "'blob'"),
    ]
    sha = (
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,"
        " CAST(l_extendedprice AS BIGINT))"
    )
    rows = lines(spark, sf_dir, "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return rows.selectExpr(
        f"{repository_name('l_orderkey')} AS repository",
        f"{sha} AS sha",
        f"IF(l_partkey % 97 <> 0, array({', '.join(entries)}), NULL) AS tree",
    )


# Paths that have a blob (index 0-2).
BLOB_PATHS = ("README.md", "/readme.rst", "docs/CodeBook.md")


@landed
def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base64 contents of the README rows, one per (repository, sha, path).

    Some are missing, some have a byte that is not UTF-8, some are not base64.
    """
    both = f"concat_ws(' ', {_pick(PHRASES, 'o_orderkey')}, {_pick(PHRASES, 'o_orderkey + n')})"
    raw = f"encode(concat({both}, {text(' é')}), 'UTF-8')"
    encoded = f"base64(IF(o_orderkey % 5 = 0, concat({raw}, X'FF'), {raw}))"
    named = ", ".join(text(path) for path in BLOB_PATHS)
    return (
        spread(spark, sf_dir, "orders", "o_orderkey")
        .selectExpr("o_orderkey", f"posexplode(array({named})) AS (n, path)")
        .filter("(o_orderkey + n) % 4 <> 0")
        .selectExpr(
            f"{repository_name('o_orderkey')} AS repository",
            "CAST(o_orderkey AS STRING) AS sha",
            "path",
            f"CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '!none!'"
            f" ELSE {encoded} END AS content_base64",
        )
    )


@landed
def raw_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy document of each repository, one per customer."""
    return spread(spark, sf_dir, "customer", "c_custkey").selectExpr(
        "concat('org/repo', c_custkey) AS repository",
        f"{_pick(POLICIES, 'c_custkey')} AS policy_text",
    )


@landed
def policy_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File rows of policy documents: per order up to two candidates and one
    other file, in an order and a spelling that depend on the key."""
    yml, yaml = POLICY_FILES
    first = f"IF(o_orderkey % 3 = 0, {text(yaml)}, {text(yaml.upper())})"
    second = f"IF(o_orderkey % 5 = 0, {text(yml)}, {text('docs/' + yml)})"
    rows = ", ".join(
        f"named_struct('seq', {seq}, 'path', {path}, 'content', {_pick(POLICIES, index)})"
        for seq, path, index in (
            ("1L", first, "o_orderkey"),
            ("2L", second, "o_orderkey + 3"),
            ("3L", "'src/README.md'", "o_orderkey + 5"),
        )
    )
    return spread(spark, sf_dir, "orders", "o_orderkey").selectExpr(
        f"{repository_name('o_orderkey')} AS repository",
        "CAST(o_orderkey AS STRING) AS sha",
        f"inline(array({rows}))",
    )


def _signed(rows: DataFrame) -> DataFrame:
    """Adds body and signature; broken or missing for some ids."""
    signature = (
        "CASE WHEN event_id % 13 = 0 THEN 'sha256=00'"
        " WHEN event_id % 17 = 0 THEN NULL"
        " WHEN event_id % 19 = 0 THEN digest"
        " ELSE concat('sha256=', digest) END"
    )
    staged = rows.selectExpr("*", "encode(payload, 'UTF-8') AS body").selectExpr(
        "*", f"{hmac_sha256_hex('body', SECRET)} AS digest"
    )
    return staged.selectExpr(
        "CAST(event_id AS STRING) AS delivery_id",
        "ts AS received_at",
        "event_header",
        f"{signature} AS signature",
        "body",
    )


# Actions of pull-request events (index 0-5); None leaves it out.
ACTIONS = ("opened", "reopened", "synchronize", "ready_for_review", "closed", None)


@landed
def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed push, pull-request and other deliveries, one per event."""
    header = (
        "CASE WHEN event_id % 7 IN (0, 5) THEN 'push'"
        " WHEN event_id % 7 IN (1, 6) THEN 'pull_request'"
        " WHEN event_id % 7 = 2 THEN 'ping' WHEN event_id % 7 = 3 THEN 'issues' END"
    )
    target = (
        """concat('"installation":{"id":', user_id, '},"repository":{"full_name":"',"""
        f""" IF(event_id % 23 <> 0, {repository_name('event_id + 1')}, ''), '"}}')"""
    )
    push = (
        """concat('{"deleted":', IF(event_id % 7 = 5, 'true', 'false'),"""
        f""" ',"after":"', event_id + 1, '",', {target}, '}}')"""
    )
    action = _pick(ACTIONS, "event_id DIV 7")
    head = """IF(event_id % 29 <> 0, concat(',"head":{"sha":"', event_id + 1, '"}'), '')"""
    pull = (
        f"""concat('{{', coalesce(concat('"action":"', {action}, '",'), ''),"""
        """ '"pull_request":{"draft":', IF(event_id % 7 = 6, 'true', 'false'),"""
        f""" {head}, '}},', {target}, '}}')"""
    )
    payload = (
        f"CASE event_header WHEN 'push' THEN {push} WHEN 'pull_request' THEN {pull}"
        """ ELSE concat('{"zen":', event_id, '}') END"""
    )
    rows = spread(spark, sf_dir, "events", "event_id", "user_id", "ts").selectExpr(
        "event_id", "user_id", "ts", f"{header} AS event_header"
    )
    return _signed(
        rows.selectExpr("*", f"concat({payload}, IF(event_id % 31 = 0, '}}', '')) AS payload")
    )


@landed
def marketplace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = (
        "CASE event_id % 5 WHEN 0 THEN 'ping' WHEN 1 THEN 'push'"
        " ELSE 'marketplace_purchase' END"
    )
    account = """concat('"account":{"login":"user', user_id, '"}')"""
    purchase = (
        f"""CASE event_id % 5 WHEN 2 THEN concat({account}, ',"plan":{{"name":"basic"}}')"""
        f""" WHEN 3 THEN {account} ELSE '"plan":{{"name":null}}' END"""
    )
    payload = (
        """concat('{', IF(event_id % 3 = 0, '"action":"purchased",', ''),"""
        f""" '"marketplace_purchase":{{', {purchase}, '}}}}')"""
    )
    return _signed(
        spread(spark, sf_dir, "events", "event_id", "user_id", "ts").selectExpr(
            "event_id", "ts", f"{header} AS event_header", f"{payload} AS payload"
        )
    )


@landed
def installations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One installation per customer row with two repositories: the customer's
    own, and one that two neighbouring customers share."""

    def repository(key: str, private: str) -> str:
        name = f"concat('org/repo', {key})"
        return (
            f"named_struct('private', {private}, 'full_name', {name},"
            f" 'default_branch', 'main', 'html_url', concat('https://git.example/', {name}))"
        )

    own = repository("c_custkey", "c_mktsegment = 'MACHINERY'")
    shared = repository("(c_custkey DIV 2) * 2", "IF(c_custkey % 5 <> 0, false, NULL)")
    return spread(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").selectExpr(
        "c_custkey + 1 AS id", f"array({own}, {shared}) AS repositories"
    )


@landed
def branch_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each repository is the head of its main branch."""
    return (
        table(spark, sf_dir, "orders")
        .selectExpr(f"{repository_name('o_orderkey')} AS repository", "o_orderkey")
        .groupBy("repository")
        .agg({"o_orderkey": "max"})
        .selectExpr("repository", "'main' AS branch", "CAST(`max(o_orderkey)` AS STRING) AS sha")
    )


@landed
def audit_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual audit requests, one per event; some blank, some for unknown names."""
    name = (
        "CASE event_id % 9 WHEN 0 THEN '' WHEN 1 THEN NULL"
        " WHEN 2 THEN concat('other/repo', event_id) ELSE concat('org/repo', user_id) END"
    )
    return spread(spark, sf_dir, "events", "event_id", "user_id").selectExpr(
        "event_id AS request_id", f"{name} AS repository"
    )


# Privacy terms searched in whole documents.
LONG_TEXT_TERMS = ("license", "privacy", "copyright", "email", "the")


@landed
def long_readmes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as README files, one commit per document."""
    return spread(spark, sf_dir, "documents", "doc_id", "source", "text").selectExpr(
        "concat('doc/', source) AS repository",
        "CAST(doc_id AS STRING) AS sha",
        "0L AS seq",
        "'README.md' AS path",
        "text AS content",
    )


@landed
def long_text_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy with its own privacy terms for every document source."""
    terms = ",".join(f'"{term}"' for term in LONG_TEXT_TERMS)
    document = f'{{"privacy_terms":[{terms}]}}'
    return (
        table(spark, sf_dir, "documents")
        .selectExpr("concat('doc/', source) AS repository")
        .distinct()
        .selectExpr("repository", f"'{document}' AS policy_text")
    )


@landed
def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of web pages: the URL without scheme, host, query and fragment."""
    tail = "regexp_replace(url, '^[a-z]+://[^/]*', '')"
    return spread(spark, sf_dir, "pages", "page_id", "url").selectExpr(
        "'web' AS repository",
        "CAST(page_id AS STRING) AS sha",
        "page_id AS seq",
        f"regexp_replace({tail}, '[?#].*$', '') AS path",
    )


@landed
def url_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One policy, for the repository of the web pages."""
    return (
        table(spark, sf_dir, "pages")
        .selectExpr("'web' AS repository")
        .distinct()
        .selectExpr("repository", """'{"ignore_paths":["de","/En/5/"]}' AS policy_text""")
    )
