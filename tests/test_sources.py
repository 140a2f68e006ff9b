import os

import pytest

from auditlake import registry, schemas
from auditlake.operators import publishing
from auditlake.plans import audit as plan
from auditlake.sources import check_runs as run_table
from auditlake.sources import checkouts, inventory
from auditlake.sources.events import raw_event_stream
from auditlake.streaming.audits import audit_batch, stream_audit

from . import frames
from .test_events import PUSH, SECRET, deliveries, pull


def write(root, files):
    for path, content in files.items():
        target = os.path.join(root, path)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "wb") as handle:
            handle.write(content)


def test_scan_checkouts(spark, tmp_path):
    write(
        tmp_path,
        {
            "one/README.md": b"# One \xff",
            "one/.github/workflows/ci.yml": b"on: push",
            "one/.repo-quality.yml": b"{}",
            "one/.git/config": b"x",
            "one/sub/.venv/README.md": b"x",
            "one/sub/deep/deeper/data_dictionary.md": b"terms",
            "one/sub/deep/my_data_dictionary.md": b"other name",
            "one/.gitignore": b"x",
            "two/readme.rst": b"# Two",
            "stray.txt": b"x",
        },
    )
    rows = checkouts.scan_checkouts(spark, str(tmp_path)).collect()
    assert {(r.repository, r.path, r.content) for r in rows} == {
        ("one", "README.md", "# One �"),
        ("one", ".github/workflows/ci.yml", None),
        ("one", ".repo-quality.yml", "{}"),
        ("one", "sub/deep/deeper/data_dictionary.md", "terms"),
        ("one", "sub/deep/my_data_dictionary.md", None),
        ("one", ".gitignore", None),
        ("two", "readme.rst", "# Two"),
    }
    assert len({(r.repository, r.seq) for r in rows}) == len(rows)
    single = checkouts.scan_checkouts(spark, str(tmp_path / "one"), single="true", splitDepth="0")
    assert {r.path for r in single.collect()} == {r.path for r in rows if r.repository == "one"}
    again = checkouts.scan_checkouts(spark, str(tmp_path), maxPartitions="3")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_checkouts_as_a_data_source(spark, tmp_path):
    tree = {f"r{k}/{'/'.join('abc'[:depth])}/f{depth}.py".replace("//", "/"): b"x" for k in range(9) for depth in range(4)}
    write(tmp_path, tree | {"r1/README.md": b"one", "r1/z/README.md": b"two"})
    scanned = checkouts.scan_checkouts(spark, str(tmp_path), maxPartitions=5)
    rows = sorted(map(tuple, scanned.collect()))
    assert len(rows) == 9 * 4 + 2
    by_seq = sorted((r for r in rows if r[0] == "r1"), key=lambda r: r[2])
    assert by_seq[0][3] == "README.md"  # files of the checkout itself come first
    text = scanned._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") + text.count("REPARTITION_BY_NUM") >= 2
    checkouts.register(spark)
    source = spark.read.format("checkouts").option("maxPartitions", "4").load(str(tmp_path))
    assert sorted(map(tuple, source.collect())) == rows
    chosen = source.filter("repository IN ('r1', 'r2') AND path LIKE '%.py'")
    assert sorted(map(tuple, chosen.collect())) == [r for r in rows if r[0] in ("r1", "r2") and r[3].endswith(".py")]
    assert source.filter("repository = 'r5'").count() == 4
    reader = checkouts.CheckoutReader(str(tmp_path), False, 1, frozenset())
    kept = list(reader.pushFilters([checkouts.In(("repository",), ("r1", "r2")), checkouts.EqualTo(("repository",), "r2")]))
    assert len(kept) == 2 and reader.repositories == {"r2"}
    assert {r for b in reader.read(checkouts.Share(0, 1)) for r in b.column(0).to_pylist()} == {"r2"}


def test_checkouts_can_be_audited(spark, tmp_path):
    write(tmp_path, {"r/README.md": b"Data source", "r/LICENSE": b"", "r/tests/t.py": b""})
    files = checkouts.scan_checkouts(spark, str(tmp_path))
    report = plan.audit(files, files.select("repository", "sha").distinct()).first()
    assert (report.repository, report.score) == ("r", 12 + 10 + 12 + 8)


FILES = {
    ("o/r", "a"): [("README.md", "data source"), ("LICENSE", None)],
    ("o/r", "b"): [("LICENSE", None)],
    ("o/x", "c"): [("Makefile", None)],
}


def test_inventory_round_trip_and_pruning(spark, tmp_path):
    files = frames.files(spark, FILES)
    inventory.write_inventory(files, str(tmp_path / "files"), buckets=16)
    stored = inventory.read_inventory(spark, str(tmp_path / "files"))
    assert stored.count() == files.count()
    targets = spark.createDataFrame([("o/r", "a"), ("o/r", "zzz")], "repository string, sha string")
    kept = inventory.restrict_to(stored, targets, buckets=16)
    assert {(r.sha, r.path) for r in kept.collect()} == {("a", "README.md"), ("a", "LICENSE")}
    pruned = inventory.restrict_to(stored, targets.filter("sha <> 'b'"), buckets=16)
    assert "dynamicpruning" in pruned._jdf.queryExecution().executedPlan().toString()


def _runs(spark, keys):
    files = {key: FILES.get(key, []) for key in keys}
    return publishing.check_runs(plan.audit(frames.files(spark, files), frames.commits(spark, keys)))


def test_check_runs_are_idempotent(spark, tmp_path):
    folder = str(tmp_path / "runs")
    runs = _runs(spark, list(FILES))
    for batch in (0, 0, 1):
        run_table.write_check_runs(runs, folder, "job", batch)
    stored = run_table.read_check_runs(spark, folder)
    assert stored.count() == 3
    assert stored.schema.simpleString() == schemas.CHECK_RUNS.simpleString()
    assert run_table.read_all_check_runs(spark, folder).count() == 6


def test_no_write_loses_the_runs_of_another(spark, tmp_path):
    folder = str(tmp_path / "runs")
    for source, sha in (("one", "a"), ("two", "b"), ("three", "c")):
        run_table.write_check_runs(_runs(spark, [("o/r", sha)]), folder, source, 0)
    run_table.write_check_runs(_runs(spark, [("o/r", "a")]).limit(0), folder, "one", 0)
    assert {r.head_sha for r in run_table.read_check_runs(spark, folder).collect()} == {"a", "b", "c"}


def test_the_latest_run_is_decided_by_time(spark, tmp_path):
    from pyspark.sql import functions as F

    folder = str(tmp_path / "runs")
    runs = _runs(spark, [("o/r", "a")])
    for batch, day, status in ((7, "2024-05-01", "old"), (1, "2024-06-01", "new")):
        when = F.lit(day).cast("timestamp")
        run_table.write_check_runs(runs.withColumn("status", F.lit(status)), folder, "job", batch, when)
    assert [r.status for r in run_table.read_check_runs(spark, folder).collect()] == ["new"]


def _shape(rows):
    return sorted((r.head_sha, r.run_source, r.batch_id, r.status) for r in rows.collect())


def test_merging_keeps_every_run_and_bounds_the_files_of_a_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    folder = str(tmp_path / "runs")
    runs = _runs(spark, list(FILES)).cache()
    parents = spark.createDataFrame([("o/r", "a")], "repository string, head_sha string")
    expected, opened = [], []
    for batch in range(31):
        run_table.write_check_runs(runs.withColumn("status", F.lit(str(batch))), folder, "job", batch)
        if batch % 3 == 0:
            run_table.write_check_runs(runs.limit(1), folder, "other", batch)
        run_table.merge_check_runs(spark, folder, "job", batches=3, spans=2)
        expected += [(r.head_sha, "job", batch, str(batch)) for r in runs.collect()]
        if batch % 5 == 4:
            wanted = run_table.read_check_runs_of(spark, folder, parents)
            others = {f for f in wanted.inputFiles() if f"run_key={run_table.source_key('other')}" in f}
            opened.append(len(set(wanted.inputFiles()) - others))
            stored = run_table.read_all_check_runs(spark, folder).filter("run_source = 'job'")
            assert _shape(stored) == sorted(expected)
            assert _shape(wanted.filter("run_source = 'job'")) == [r for r in sorted(expected) if r[0] == "a"]
    assert max(opened) < 31  # at most three batches and a span of each size, not one file for each batch
    assert opened[-1] <= opened[1] + 4
    found = run_table.layout(spark, folder, run_table.source_key("job"))
    assert len(found.batches) <= 4 and len(found.spans) <= 4
    plan_ = wanted._jdf.queryExecution().executedPlan().toString()
    assert "run_bucket" in plan_.split("PartitionFilters: [")[1] + plan_.split("PartitionFilters: [")[-1]
    with pytest.raises(ValueError, match="has been merged"):
        run_table.write_check_runs(runs, folder, "job", 0)
    latest = run_table.read_check_runs(spark, folder).filter("status <> 'completed'")
    assert {r.status for r in latest.collect()} <= {"30"}


def test_a_merge_that_stopped_half_way_changes_nothing(spark, tmp_path):
    from pyspark.sql import functions as F

    folder = str(tmp_path / "runs")
    runs = _runs(spark, [("o/r", "a")]).cache()
    for batch in range(4):
        run_table.write_check_runs(runs, folder, "job", batch)
    before = _shape(run_table.read_all_check_runs(spark, folder))
    run_table.merge_check_runs(spark, folder, "job", batches=3)
    key = run_table.source_key("job")
    span = run_table._merged(folder, key, (0, 2))
    assert run_table.layout(spark, folder, key).spans == [(0, 2)]
    assert len(run_table.layout(spark, folder, key).covered) == 3  # still there, but not read
    assert _shape(run_table.read_all_check_runs(spark, folder)) == before
    os.remove(f"{span}/_SUCCESS")  # as if the job had ended before
    assert run_table.layout(spark, folder, key).batches == [0, 1, 2, 3]
    assert _shape(run_table.read_all_check_runs(spark, folder)) == before
    # the newest batch is repeated, then the merge
    run_table.write_check_runs(runs.withColumn("status", F.lit("again")), folder, "job", 3)
    for _ in range(2):
        run_table.merge_check_runs(spark, folder, "job", batches=3)
        found = _shape(run_table.read_all_check_runs(spark, folder))
        assert found == [*before[:3], ("a", "job", 3, "again")]
    assert run_table.layout(spark, folder, key).covered == []


def test_a_new_checkpoint_keeps_earlier_runs(spark, tmp_path):
    target = {"repository": {"full_name": "o/r"}, "installation": {"id": 1}}
    out, files = str(tmp_path / "out"), frames.files(spark, FILES)
    for name, shas in (("first", "wx"), ("second", "yz")):
        events = [("push", {**PUSH, **target, "after": sha}) for sha in shas]
        deliveries(spark, events).write.parquet(str(tmp_path / name))
        stream = raw_event_stream(spark, str(tmp_path / name))
        state = str(tmp_path / f"state {name}")
        stream_audit(stream, files, out, state, SECRET, available_now=True).awaitTermination()
    assert {r.head_sha for r in run_table.read_check_runs(spark, out).collect()} == set("wxyz")


def _landing(spark, folder):
    target = {"repository": {"full_name": "o/r"}, "installation": {"id": 1}}
    rows = [
        ("push", {**PUSH, **target, "after": "a"}),
        ("push", {**PUSH, **target, "after": "a"}),
        ("pull_request", pull(**target, pull_request={"head": {"sha": "b"}})),
        ("push", {**PUSH, **target, "after": "nofiles"}),
        ("push", {**PUSH, **target, "after": "c", "deleted": True}),
        ("ping", b"{}"),
    ]
    events = deliveries(spark, rows)
    events.repartition(3).write.parquet(folder)
    return events


def test_stream_equals_batch(spark, tmp_path):
    from auditlake.operators.events import event_status

    events = _landing(spark, str(tmp_path / "events"))
    files = frames.files(spark, FILES)
    stream = raw_event_stream(spark, str(tmp_path / "events"), maxFilesPerTrigger="1")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream_audit(stream, files, out, state, SECRET, available_now=True).awaitTermination()
    streamed = run_table.read_check_runs(spark, out).collect()
    batch = audit_batch(event_status(events, SECRET), files).collect()
    assert sorted(map(str, streamed)) == sorted(map(str, batch))
    assert {r.head_sha: r.output.title for r in streamed} == {
        "a": "Quality score: 30/100 (F)",
        "b": "Quality score: 10/100 (F)",
        "nofiles": "Quality score: 0/100 (F)",
    }
    # A restart finds nothing new and changes nothing.
    stream_audit(stream, files, out, state, SECRET, available_now=True).awaitTermination()
    assert run_table.read_check_runs(spark, out).count() == 3


def test_js_stream_compares_with_earlier_batches(spark, tmp_path):
    target = {"repository": {"full_name": "o/r"}, "installation": {"id": 1}}
    landing, out, state = (str(tmp_path / name) for name in ("events", "out", "state"))
    commits = spark.createDataFrame(
        [("o/r", "a", ["b"]), ("o/r", "b", [])], "repository string, sha string, p array<string>"
    ).selectExpr("repository", "sha", "transform(p, s -> named_struct('sha', s)) AS parents")
    files = frames.files(spark, FILES)
    for sha in ("b", "a"):
        event = deliveries(spark, [("push", {**PUSH, **target, "after": sha})])
        event.write.mode("append").parquet(landing)
        stream = raw_event_stream(spark, landing)
        stream_audit(
            stream, files, out, state, SECRET, dialect="js", commits=commits, available_now=True
        ).awaitTermination()
    rows = {r.head_sha: r.output for r in run_table.read_check_runs(spark, out).collect()}
    assert rows["b"].summary.endswith("**not available**")
    assert rows["a"].summary.endswith("**+20** (10 → 30)")
    assert {note.path for note in rows["a"].annotations} == {"README.md"}


def test_working_copies_lie_there_a_share_at_a_time(spark, tmp_path, monkeypatch):
    texts = [(k, f"text {k}", "en" if k % 2 else "de", f"s{k}") for k in range(40)]
    spark.createDataFrame([*texts, texts[3]], "doc_id long, text string, lang string, source string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    folders, scan = [], checkouts.scan_checkouts
    there = lambda: sum(len(os.listdir(folder)) for folder in folders)
    most = []

    def counted(session, folder, **options):
        folders.append(folder)
        most.append(there())
        return scan(session, folder, **options)

    monkeypatch.setattr(registry.checkouts, "scan_checkouts", counted)
    monkeypatch.setattr(registry, "CHECKOUT_BYTES", 10 * registry.CHECKOUT_ENTRIES * registry.BLOCK_BYTES, raising=False)
    rows = registry.QUERIES["scan_checkouts"](spark, str(tmp_path)).collect()
    assert max(most) < 40 and sum(most) == 40 and there() == 0
    expected = {(f"doc{k}", "README.md", text) for k, text, _, _ in texts} | {(f"doc{k}", "docs/CodeBook.md", lang) for k, _, lang, _ in texts}
    expected |= {(f"doc{k}", path, None) for k in range(40) for path in ("src/main.py", ".github/workflows/ci.yml")}
    assert len(rows) == 160 and {(r.repository, r.path, r.content) for r in rows} == expected
