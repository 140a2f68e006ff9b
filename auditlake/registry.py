"""Every operator as a query over the test tables.

Each query takes ``(spark, sf_dir)`` and runs over whole tables.  Arrays are
rendered as text, so that results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import catalog
from auditlake import fixtures as fx
from auditlake.functions import paths
from auditlake.operators import events as ev
from auditlake.operators import files as fo
from auditlake.operators import fleet, policies, publishing, scoring
from auditlake.plans import audit as plan
from auditlake.session import shared_folder
from auditlake.sources import check_runs as run_table
from auditlake.sources import checkouts
from auditlake.sources.events import raw_event_stream
from auditlake.streaming.audits import stream_audit

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
COMMIT = fo.COMMIT


def _register(name: str) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        return query

    return add


def _joined(array: str, alias: str | None = None) -> str:
    """An array rendered as text."""
    return f"array_join({array}, ' | ') AS {alias or array}"


def _typed_policies(spark: SparkSession, sf_dir: str, dialect: str = "py") -> DataFrame:
    return policies.policy_table(fx.raw_policies(spark, sf_dir), dialect)


def _signals(
    spark: SparkSession, sf_dir: str, dialect: str = "py", typed: DataFrame | None = None, beside: Sequence[DataFrame] = ()
) -> DataFrame:
    typed = _typed_policies(spark, sf_dir, dialect) if typed is None else typed
    return plan.commit_signals(fx.files(spark, sf_dir), fx.commits(spark, sf_dir), typed, dialect, beside)


def _reports(
    spark: SparkSession, sf_dir: str, dialect: str = "py", typed: DataFrame | None = None, beside: Sequence[DataFrame] = ()
) -> DataFrame:
    return plan.reports(_signals(spark, sf_dir, dialect, typed, beside), dialect)


def _report_columns(report: DataFrame) -> DataFrame:
    checks = "transform(checks, check -> concat(check.key, '=', check.passed))"
    return report.selectExpr(
        *COMMIT,
        "score",
        "grade",
        "passed",
        "minimum_score",
        _joined("missing_required_files"),
        _joined("policy_warnings"),
        _joined(checks, "checks"),
    )


# --- flagship -------------------------------------------------------------


@_register("audit")
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report_columns(_reports(spark, sf_dir))


@_register("audit_js")
def audit_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report_columns(_reports(spark, sf_dir, "js"))


@_register("audit_default_policy")
def audit_default_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report_columns(plan.audit(fx.files(spark, sf_dir), fx.commits(spark, sf_dir)))


@_register("audit_commit_policies")
def audit_commit_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every commit is judged by the policy file it contains itself."""
    files = fx.files(spark, sf_dir).unionByName(fx.policy_files(spark, sf_dir))
    typed = policies.policy_table(policies.pick_policy(files))
    return _report_columns(plan.audit(files, fx.commits(spark, sf_dir), typed))


@_register("audit_documents")
def audit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as README files, with configured privacy terms."""
    files = fx.long_readmes(spark, sf_dir)
    typed = policies.policy_table(fx.long_text_policies(spark, sf_dir))
    return _report_columns(plan.audit(files, files.select(*COMMIT), typed))


# --- sources and sinks ----------------------------------------------------


# What working copies may take in the shared folder at once, and what a file or folder takes there at least.
CHECKOUT_BYTES, BLOCK_BYTES = 1 << 30, 4096
# Files and folders of the working copy of a document.
CHECKOUT_ENTRIES = 14


@_register("scan_checkouts")
def scan_checkouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes one working copy per document, then scans them; in rounds, each of as many as fit ``CHECKOUT_BYTES``.

    Texts are dealt out once; a round takes its share of the partitions, and its working copies are deleted when their
    rows are in a table.
    """
    import os

    folder, found = shared_folder(spark), shared_folder(spark)
    local = folder.removeprefix("file://").removeprefix("file:")

    def writer(top: str):
        def write(rows):
            os.makedirs(top, exist_ok=True)
            for row in rows:
                root = os.path.join(top, f"doc{row.doc_id}")
                texts = {
                    "README.md": row.text,
                    "docs/CodeBook.md": row.lang,
                    "src/main.py": row.source,
                    ".github/workflows/ci.yml": "on: push",
                    ".git/config": "[core]",
                    "lib/.venv/README.md": "skipped",
                }
                for path, text in texts.items():
                    target = os.path.join(root, path)
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    with open(target, "w", encoding="utf-8", newline="") as handle:
                        handle.write(text)
            return iter(())

        return write

    documents = fx.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    size = documents.agg(F.expr(f"coalesce(sum(octet_length(text)), 0L) + count(*) * {CHECKOUT_ENTRIES * BLOCK_BYTES}L"))
    rounds = size.first()[0] // CHECKOUT_BYTES + 1
    # One document's rows come together, also if there are several.
    dealt = documents.repartition(rounds * spark.sparkContext.defaultParallelism, "doc_id").rdd
    parts = dealt.getNumPartitions()
    for k in range(rounds):
        share = range(parts * k // rounds, parts * (k + 1) // rounds)
        top = os.path.join(local, str(k))
        spark.sparkContext.runJob(dealt, writer(top), share)
        rows = checkouts.scan_checkouts(spark, top).select("repository", "path", "content")
        rows.write.mode("append").option("compression", "zstd").parquet(found)
        checkouts.remove_checkouts(spark, top)
    return spark.read.schema(rows.schema).parquet(found)


@_register("tree_blobs")
def tree_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.tree_blobs(fx.trees(spark, sf_dir))


@_register("select_content_paths")
def select_content_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.select_content_paths(fx.files(spark, sf_dir)).select(*COMMIT, "seq", "path")


@_register("select_content_paths_js")
def select_content_paths_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.select_content_paths(fx.files(spark, sf_dir), "js").select(*COMMIT, "seq", "path")


@_register("attach_content")
def attach_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some files have no path, some contents are missing or broken."""
    files = fx.files(spark, sf_dir)
    files = files.withColumn("path", F.expr("IF(pmod(seq, 23) = 0, NULL, path)"))
    return fo.attach_content(files, fx.blobs(spark, sf_dir))


@_register("report_json")
def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = _typed_policies(spark, sf_dir)
    evidence = plan.file_evidence(fx.files(spark, sf_dir), typed)
    report = _reports(spark, sf_dir, typed=typed, beside=[publishing.evidence_counts(evidence)])
    documents = publishing.report_documents(report, evidence)
    return publishing.report_json(documents)


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    landing = fx.landed_folder(spark, sf_dir, fx.raw_events.build)
    return raw_event_stream(spark, landing)


@_register("raw_event_source")
def raw_event_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drains the landed deliveries as a stream into a table."""
    out, state = shared_folder(spark), shared_folder(spark)
    stream = _event_stream(spark, sf_dir).selectExpr(
        "delivery_id", "event_header", "signature", "CAST(body AS STRING) AS body"
    )
    writer = stream.writeStream.format("parquet").option("checkpointLocation", state)
    writer.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def _flat_runs(runs: DataFrame) -> DataFrame:
    return runs.selectExpr(
        "repository",
        "head_sha",
        "name",
        "status",
        "conclusion",
        "output.title AS title",
        "output.summary AS summary",
    )


@_register("check_run_sink")
def check_run_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batch written twice, then another source's runs of every second
    commit; each commit keeps its latest run."""
    folder = shared_folder(spark)
    typed = _typed_policies(spark, sf_dir)
    signals = plan.commit_signals(fx.files(spark, sf_dir), fx.commits(spark, sf_dir), typed, keep=True)
    runs = publishing.check_runs(plan.reports(signals))
    run_table.write_check_runs(runs, folder, "job", 1)
    run_table.write_check_runs(runs, folder, "job", 1)
    again = runs.filter("CAST(head_sha AS BIGINT) % 2 = 0").withColumn("status", F.lit("rerun"))
    run_table.write_check_runs(again, folder, "other job", 1)
    return _flat_runs(run_table.read_check_runs(spark, folder))


# --- paths and texts ------------------------------------------------------


@_register("normalize_path")
def normalize_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.normalised(fx.files(spark, sf_dir)).select(*COMMIT, "seq", "path", "path_norm")


@_register("normalize_path_js")
def normalize_path_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.normalised(fx.files(spark, sf_dir), "js").select(*COMMIT, "seq", "path", "path_norm")


@_register("dedupe_paths")
def dedupe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.dedupe_paths(fx.files(spark, sf_dir))


@_register("dedupe_paths_js")
def dedupe_paths_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.dedupe_paths(fx.files(spark, sf_dir), "js")


@_register("ignore_paths")
def ignore_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fo.normalised(fx.files(spark, sf_dir)).drop("content")
    kept = fo.drop_ignored(files, _typed_policies(spark, sf_dir))
    return kept.select(*COMMIT, "seq", "path_norm")


@_register("ignore_paths_urls")
def ignore_paths_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fo.normalised(fx.url_paths(spark, sf_dir))
    typed = policies.policy_table(fx.url_policies(spark, sf_dir))
    return fo.drop_ignored(files, typed).select("sha", "path_norm")


@_register("basename")
def basename(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = paths.basename(paths.normalize_path("path"))
    return fx.url_paths(spark, sf_dir).selectExpr("sha", "path", f"{name} AS basename")


@_register("select_readme")
def select_readme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.select_readme(fx.files(spark, sf_dir))


@_register("select_readme_js")
def select_readme_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fo.select_readme(fx.files(spark, sf_dir), "js")


@_register("basename_in")
def basename_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fo.named_files(fo.normalised(fx.files(spark, sf_dir)), catalog.LICENSE_NAMES)
    return found.select(*COMMIT, "path")


@_register("terms_in_text")
def terms_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each README against the privacy terms of its repository's policy."""
    readmes = fo.select_readme(fx.files(spark, sf_dir))
    with_terms = policies.with_policy(readmes, _typed_policies(spark, sf_dir), ["sha"])
    found = fo.readme_terms(with_terms, "privacy_terms")
    return found.selectExpr(*COMMIT, _joined("matched"))


@_register("terms_in_documents")
def terms_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    readmes = fo.select_readme(fx.long_readmes(spark, sf_dir))
    found = fo.readme_terms(readmes, fx.LONG_TEXT_TERMS)
    return found.selectExpr("sha", _joined("matched"))


# --- the ten checks -------------------------------------------------------


def _check_query(key: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        typed = _typed_policies(spark, sf_dir)
        results = plan.check_results(_signals(spark, sf_dir, typed=typed), keys=(key,))
        if key in plan.FILE_FLAGS:
            evidence = plan.file_evidence(fx.files(spark, sf_dir), typed, keys=(key,))
            results = plan.results_with_evidence(results, evidence)
        else:
            results = results.selectExpr("*", "size(term_evidence) AS evidence_count")
        return results.selectExpr(
            *COMMIT, "key", "passed", "points", "evidence_count", _joined("term_evidence")
        )

    return query


for _key in catalog.CHECK_KEYS:
    QUERIES[f"check_{_key}"] = _check_query(_key)


@_register("check_results_js")
def check_results_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = plan.check_results(_signals(spark, sf_dir, "js"), "js")
    return results.drop("term_evidence")


@_register("file_evidence")
def file_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All file evidence in long form, one row per path."""
    return plan.file_evidence(fx.files(spark, sf_dir), _typed_policies(spark, sf_dir))


# --- scoring --------------------------------------------------------------


def _enabled(spark: SparkSession, sf_dir: str, dialect: str) -> DataFrame:
    typed = _typed_policies(spark, sf_dir, dialect)
    results = plan.check_results(_signals(spark, sf_dir, dialect, typed), dialect)
    return scoring.enabled_checks(results, typed)


@_register("drop_disabled_checks")
def drop_disabled_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enabled(spark, sf_dir, "py").select(*COMMIT, "key", "passed", "points")


def _score_columns(scored: DataFrame) -> DataFrame:
    return scored.selectExpr(
        *COMMIT, "CAST(earned AS INT) AS earned", "CAST(possible AS INT) AS possible", "score"
    )


@_register("score")
def score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _score_columns(scoring.score_results(_enabled(spark, sf_dir, "py")))


@_register("score_js")
def score_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _score_columns(scoring.score_results(_enabled(spark, sf_dir, "js"), "js"))


@_register("grade")
def grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir).select(*COMMIT, "score", "grade")


@_register("missing_required_files")
def missing_required_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = scoring.missing_required_files(_signals(spark, sf_dir))
    return missing.selectExpr(*COMMIT, _joined("missing_required_files"))


@_register("verdict")
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir).select(*COMMIT, "minimum_score", "passed")


# --- policies -------------------------------------------------------------


def _policy_text(picked: DataFrame) -> DataFrame:
    return picked.select(*COMMIT, "policy_text")


@_register("pick_policy_file")
def pick_policy_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy_text(policies.pick_policy(fx.policy_files(spark, sf_dir)))


@_register("pick_policy_file_js")
def pick_policy_file_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _policy_text(policies.pick_policy(fx.policy_files(spark, sf_dir), "js"))


@_register("pick_policy_file_checkout")
def pick_policy_file_checkout(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fx.policy_files(spark, sf_dir)
    return _policy_text(policies.pick_policy(files, exact_case=True))


def _status_query(dialect: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        status = policies.policy_document_status(fx.raw_policies(spark, sf_dir), dialect)
        return status.selectExpr(
            "repository", "document_kind", _joined("document_warnings", "warnings")
        )

    return query


QUERIES["policy_document_status"] = _status_query("py")
QUERIES["policy_document_status_js"] = _status_query("js")


def _minimum_query(dialect: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        parsed = policies.parse_policies(fx.raw_policies(spark, sf_dir), dialect)
        return parsed.selectExpr(
            "repository", "minimum_score", _joined("minimum_score_warnings", "warnings")
        )

    return query


QUERIES["validate_minimum_score"] = _minimum_query("py")
QUERIES["validate_minimum_score_js"] = _minimum_query("js")


def _string_list_query(dialect: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        parsed = policies.parse_policies(fx.raw_policies(spark, sf_dir), dialect)
        columns = []
        for key in policies.LIST_FIELDS:
            columns += [_joined(f"{key}_items"), _joined(f"{key}_warnings")]
        return parsed.selectExpr("repository", *columns)

    return query


QUERIES["validate_string_list"] = _string_list_query("py")
QUERIES["validate_string_list_js"] = _string_list_query("js")


@_register("validate_disabled_checks")
def validate_disabled_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = "disabled_checks_items"
    return policies.parse_policies(fx.raw_policies(spark, sf_dir)).selectExpr(
        "repository",
        _joined(policies.known_checks(items), "disabled_checks"),
        _joined(policies.unknown_check_warnings(items), "unknown_warnings"),
    )


@_register("clean_policy_paths")
def clean_policy_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.parse_policies(fx.raw_policies(spark, sf_dir)).selectExpr(
        "repository",
        _joined(policies.clean_paths("required_files_items"), "required_files"),
        _joined(policies.clean_paths("ignore_paths_items"), "ignore_paths"),
    )


@_register("resolve_privacy_terms")
def resolve_privacy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = policies.privacy_terms("privacy_terms_items")
    parsed = policies.parse_policies(fx.raw_policies(spark, sf_dir))
    return parsed.selectExpr("repository", _joined(terms, "privacy_terms"))


def _validate_query(dialect: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        typed = policies.validate_policies(fx.raw_policies(spark, sf_dir), dialect)
        lists = (*policies.LIST_FIELDS, "policy_warnings")
        return typed.selectExpr("repository", "minimum_score", *[_joined(n) for n in lists])

    return query


QUERIES["validate_policy"] = _validate_query("py")
QUERIES["validate_policy_js"] = _validate_query("js")


# --- events ---------------------------------------------------------------


@_register("signature_valid")
def signature_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev.with_signature(fx.raw_events(spark, sf_dir), fx.SECRET)
    return rows.select("delivery_id", "signature", "signature_valid")


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev.parse_deliveries(fx.raw_events(spark, sf_dir), fx.SECRET)
    return rows.filter("parsed")


@_register("route_event")
def route_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev.route_event(fx.raw_events(spark, sf_dir))
    return rows.select("delivery_id", "route", "event")


@_register("route_event_js")
def route_event_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev.route_event(fx.raw_events(spark, sf_dir), "js")
    return rows.select("delivery_id", "route", "event")


@_register("drop_deleted_ref")
def drop_deleted_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.drop_deleted_refs(_deliveries(spark, sf_dir)).select("delivery_id", "event_header")


@_register("pull_request_action_filter")
def pull_request_action_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ev.keep_audited_actions(_deliveries(spark, sf_dir))
    return kept.select("delivery_id", "event_header", "action")


@_register("drop_draft")
def drop_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.drop_drafts(_deliveries(spark, sf_dir)).select("delivery_id", "event_header")


@_register("audit_target")
def audit_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev.with_target(_deliveries(spark, sf_dir))
    return rows.select("delivery_id", "installation_id", "repository", "head_sha", "target_valid")


def _event_query(dialect: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = ev.event_status(fx.raw_events(spark, sf_dir), fx.SECRET, dialect)
        return rows.select(
            "delivery_id", "status", "event", "installation_id", "repository", "head_sha"
        )

    return query


QUERIES["event_status"] = _event_query("py")
QUERIES["event_status_js"] = _event_query("js")


@_register("route_marketplace")
def route_marketplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ev.route_marketplace(fx.marketplace_events(spark, sf_dir), fx.SECRET)
    return rows.select("delivery_id", "status", "event", "action", "account", "plan")


@_register("stream_audit")
def stream_audit_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams all deliveries through the audit and reads the check runs back."""
    folder, state = shared_folder(spark), shared_folder(spark)
    stream_audit(
        _event_stream(spark, sf_dir),
        fx.files(spark, sf_dir),
        folder,
        state,
        fx.SECRET,
        _typed_policies(spark, sf_dir),
        available_now=True,
    ).awaitTermination()
    return _flat_runs(run_table.read_check_runs(spark, folder))


# --- publishing -----------------------------------------------------------


@_register("check_run")
def check_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_runs(publishing.check_runs(_reports(spark, sf_dir)))


@fx.landed
def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published check runs: those of every third commit have another name, those
    of every fifth come twice, the second time with another score."""
    name = f"IF(CAST(sha AS BIGINT) % 3 = 0, 'Other check', '{catalog.REPORT_TITLE}') AS name"
    title = f"{publishing.check_run_title()} AS title"
    runs = _reports(spark, sf_dir, "js").selectExpr(
        "repository", "sha AS head_sha", name, title, "1 AS run_seq"
    )
    again = "format_string('Quality score: 1/100 (F)') AS title"
    later = runs.filter("CAST(head_sha AS BIGINT) % 5 = 0")
    later = later.selectExpr("repository", "head_sha", "name", again, "2 AS run_seq")
    return runs.union(later)


def _previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publishing.previous_scores(fx.commits(spark, sf_dir), _published(spark, sf_dir))


@_register("check_run_js")
def check_run_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With annotations and the score change since the parent commit."""
    previous, files = _previous(spark, sf_dir), fx.files(spark, sf_dir)
    report = _reports(spark, sf_dir, "js", beside=[previous, publishing.readme_paths(files)])
    runs = publishing.check_runs(report, "js", files=files, previous=previous)
    notes = "transform(output.annotations, note -> concat_ws(':', note.path, note.title))"
    return runs.selectExpr(
        "repository",
        "head_sha",
        "conclusion",
        "output.title AS title",
        "output.summary AS summary",
        _joined(notes, "annotations"),
    )


@_register("report_markdown")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publishing.markdown_reports(_reports(spark, sf_dir))


@_register("report_markdown_js")
def report_markdown_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publishing.markdown_reports(_reports(spark, sf_dir, "js"), "js")


@_register("annotations")
def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = publishing.annotations(_reports(spark, sf_dir, "js"), fx.files(spark, sf_dir))
    return rows.selectExpr(*COMMIT, "inline(annotations)")


@_register("previous_score")
def previous_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _previous(spark, sf_dir)


@_register("score_delta")
def score_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    report, previous = _reports(spark, sf_dir, "js"), _previous(spark, sf_dir)
    change = f"{publishing.score_delta()} AS score_change"
    return report.join(previous.hint("merge"), COMMIT, "left").selectExpr(*COMMIT, change)


@_register("next_steps")
def next_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publishing.next_steps(_reports(spark, sf_dir))


@_register("next_steps_js")
def next_steps_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publishing.next_steps(_reports(spark, sf_dir, "js"), "js")


# --- fleet ----------------------------------------------------------------


@_register("public_repositories")
def public_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.public_repositories(fx.installations(spark, sf_dir))


@_register("repository_listing")
def repository_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.repository_listing(fx.installations(spark, sf_dir))


@_register("resolve_audit_request")
def resolve_audit_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.resolve_requests(
        fx.audit_requests(spark, sf_dir),
        fx.installations(spark, sf_dir),
        fx.branch_heads(spark, sf_dir),
    )


@_register("audit_summary")
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.audit_summary(_reports(spark, sf_dir))
