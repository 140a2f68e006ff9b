"""Shapes of physical plans that matter at scale."""

import re

from auditlake import fixtures as fx
from auditlake.operators import events as ev
from auditlake.operators import files as fo
from auditlake.operators import policies as po
from auditlake.operators import publishing as pb
from auditlake.operators.lookup import lookup
from auditlake.plans import audit as plan

SF_DIR = "/root/testdata/sf0.001"


def physical(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def audit(spark):
    typed = po.validate_policies(fx.raw_policies(spark, SF_DIR))
    return plan.audit(fx.files(spark, SF_DIR), fx.commits(spark, SF_DIR), typed)


def nodes(frame):
    """(name, text, names of the nodes above it) of every node of the first plan."""
    found, todo = [], [(frame._jdf.queryExecution().executedPlan(), ())]
    while todo:
        node, above = todo.pop()
        name = node.nodeName().split(" (")[0]
        if name == "AdaptiveSparkPlan":
            todo.append((node.initialPlan(), above))
            continue
        text = node.verboseStringWithOperatorId() if name == "Filter" else node.simpleString(1000)
        found.append((name, text, above))
        below = node.children()
        todo += [(below.apply(k), (*above, (name, text))) for k in range(below.length())]
    return found


def aggregates_over_files(frame):
    """For each scan of the files: the kinds of aggregates above it, and whether only rows that policies ask for reach them."""
    found = []
    for name, text, above in nodes(frame):
        if name.startswith("Scan parquet") and re.search(r"\bpath#", text):
            kinds = {n for n, _ in above if n.endswith("Aggregate")}
            found.append((kinds, any(n.endswith("Join") and ", Inner" in t for n, t in above)))
    return found


def test_all_files_meet_in_one_hash_aggregation(spark):
    files, commits = fx.files(spark, SF_DIR), fx.commits(spark, SF_DIR)
    text = physical(plan.audit(files, commits))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert not re.search(r"SortAggregate|ObjectHashAggregate|Join|Python", text)
    repository = po.policy_table(fx.raw_policies(spark, SF_DIR))
    own = po.policy_table(po.pick_policy(fx.policy_files(spark, SF_DIR)))
    for typed in (repository, own):
        frame = plan.audit(files, commits, typed)
        scans = aggregates_over_files(frame)
        assert sorted(only for _, only in scans) == [False, True]  # all files; READMEs under own terms
        for kinds, asked_for in scans:
            assert kinds == ({"ObjectHashAggregate"} if asked_for else {"HashAggregate"})
        text = physical(frame)
        assert len(re.findall(r"Exchange hashpartitioning", text)) == 2
        assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|Python|parse_json", text)


def test_policies_are_picked_and_parsed_once(spark):
    files, commits = fx.files(spark, SF_DIR), fx.commits(spark, SF_DIR)
    typed = po.policy_table(po.pick_policy(fx.policy_files(spark, SF_DIR)))
    text = physical(plan.reports(plan.commit_signals(files, commits, typed)))
    assert "parse_json" not in text.lower() and "min_by" not in text
    assert len([1 for name, _, _ in nodes(plan.audit(files, commits, typed)) if name.startswith("Scan ExistingRDD")]) >= 3


def test_score_only_reads_no_more_than_it_needs(spark):
    scanned = physical(audit(spark).select("repository", "sha", "score"))
    commit_scan = [s for s in re.findall(r"ReadSchema: struct<([^>]*)>", scanned) if "parents" in s]
    assert commit_scan == []


def test_large_policy_tables_are_joined_with_salt(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = physical(audit(spark))
        assert "Broadcast" not in text
        assert re.search(r"SortMergeJoin \[repository#\d+, _salt#\d+\]", text)
        expected = audit(spark).groupBy("grade").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(expected) == sorted(audit(spark).groupBy("grade").count().collect())


def test_lookup_spreads_a_hot_key(spark):
    facts = spark.range(10_000).selectExpr("'hot' AS k", "id")
    table = spark.createDataFrame([("hot", 1)], "k string, v int")
    joined = lookup(facts, table, ["k"], ["id"])
    assert joined.count() == 10_000
    assert joined.filter("v IS NULL").count() == 0
    spread = facts.selectExpr("pmod(xxhash64(id), 8) AS salt").groupBy("salt").count().collect()
    assert len(spread) == 8 and max(r["count"] for r in spread) < 1500


def test_policy_validation_and_routing_do_not_shuffle(spark):
    for frame in (
        po.validate_policies(fx.raw_policies(spark, SF_DIR)),
        ev.event_status(fx.raw_events(spark, SF_DIR), fx.SECRET),
    ):
        text = physical(frame)
        assert "Exchange" not in text and "Python" not in text


def test_ping_and_foreign_events_skip_json(spark):
    """Bodies are parsed behind the signature and header conditions."""
    text = physical(ev.event_status(fx.raw_events(spark, SF_DIR), fx.SECRET))
    assert re.search(r"if \(\(?signature_valid#\d+ AND", text)


def test_evidence_is_one_aggregation(spark):
    text = physical(plan.file_evidence(fx.files(spark, SF_DIR), None, keys=("tests",)))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert not re.search(r"Window|Union|Sort", text)


def exchanged(frame) -> list[set[str]]:
    """The columns below each shuffle, and which scans lie there."""
    plan_ = frame._jdf.queryExecution().executedPlan()
    found, todo = [], [plan_]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.initialPlan())
            continue
        if name.startswith("Exchange"):
            out = node.output()
            found.append({out.apply(k).name() for k in range(out.length())})
        below = node.children()
        todo += [below.apply(k) for k in range(below.length())]
    return found


def test_no_shuffle_carries_the_text_of_files(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        files, commits = fx.files(spark, SF_DIR), fx.commits(spark, SF_DIR)
        repository = po.policy_table(fx.raw_policies(spark, SF_DIR))
        own = po.policy_table(po.pick_policy(fx.policy_files(spark, SF_DIR)))
        for typed in (repository, own):
            shuffles = exchanged(plan.audit(files, commits, typed))
            assert len(shuffles) > 3
            assert not any("content" in columns for columns in shuffles)
            # README texts meet the privacy terms in a branch of their own
            wide = [columns for columns in shuffles if "readme" in columns]
            assert len(wide) == 1 and not wide[0] & {"hits", "phrases", "base"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_long_lists_take_no_scan_of_a_list_by_row(spark):
    long = spark.createDataFrame([("r", [f"d{k}" for k in range(300)])], "repository string, ignore_paths array<string>")
    rows = spark.createDataFrame([("r", "s", "d7/x")], "repository string, sha string, path_norm string")
    text = physical(fo.drop_ignored(rows, long))
    assert re.search(r"LeftSemi", text) and re.search(r"LeftAnti", text)
    short = long.selectExpr("repository", "slice(ignore_paths, 1, 5) AS ignore_paths")
    assert not re.search(r"LeftSemi|LeftAnti", physical(fo.drop_ignored(rows, short)))


def test_blobs_are_selected_before_they_are_decoded(spark):
    found = nodes(fo.attach_content(fx.files(spark, SF_DIR), fx.blobs(spark, SF_DIR)))
    scans = [above for name, text, above in found if name.startswith("Scan parquet") and "content_base64" in text]
    assert len(scans) == 1
    below_decoding = [k for k, (_, text) in enumerate(scans[0]) if "try_to_binary" in text.lower() or "unbase64" in text.lower()]
    filters = [k for k, (name, text) in enumerate(scans[0]) if name == "Filter" and "readme.md" in text]
    assert filters and below_decoding and min(filters) > max(below_decoding)  # the last is the nearest to the scan


def wide_policies(spark, repositories):
    """Policies that are estimated at few bytes, as a list counts as one entry, and take many."""
    text = "concat('{\"required_files\":[', array_join(transform(sequence(1, 100), k -> concat('\"need/file', k, '.txt\"')), ','), ']}')"
    raw = spark.range(repositories).selectExpr("concat('org/repo', id) AS repository", f"{text} AS policy_text")
    return po.policy_table(raw)


def test_what_is_broadcast_is_measured_not_estimated(spark):
    from auditlake.operators.lookup import BROADCAST_BYTES, measured

    policies = wide_policies(spark, 30_000)
    count, size = measured(policies.select("repository", "required_files"))
    assert count == 30_000 and size > BROADCAST_BYTES
    files = fx.files(spark, SF_DIR)
    # the table as a whole isn't sent to executors, with whatever estimate; hashes of its keys are
    text = physical(plan.audit(files, fx.commits(spark, SF_DIR), policies))
    sent = re.findall(r"BroadcastHashJoin \[([^\]]*)\]", text)
    assert sent and all("xxhash64" in keys for keys in sent)
    assert re.search(r"SortMergeJoin \[repository#\d+, _salt#\d+\]", text)


def test_shuffled_lookups_find_what_broadcast_ones_find(spark, monkeypatch):
    from auditlake.operators import lookup as module

    files = spark.createDataFrame(
        [("a", "s1", 1), ("a", "s2", 2), ("b", "s1", 3), ("c", None, 4), (None, "s1", 5), ("a", "s1", 1)],
        "repository string, sha string, seq int",
    )
    table = spark.createDataFrame([("a", ["x", None]), ("c", None), (None, ["y"]), ("d", [])], "repository string, names array<string>")
    for how in ("left", "inner"):
        for scanned in (False, True):
            found = []
            for limit in (1 << 20, 200, 0):  # sent whole, by the hashes of its keys, not at all
                monkeypatch.setattr(module, "BROADCAST_BYTES", limit)
                joined = module.lookup(files, table, ["repository"], ["seq"], how=how, scanned=scanned)
                assert joined.columns == ["repository", "sha", "seq", "names"]
                found.append(sorted(map(str, joined.collect())))
            assert found[0] == found[1] == found[2]
            assert len(found[0]) == (6 if how == "left" else 4)


def test_policies_of_single_commits_are_not_copied(spark, monkeypatch):
    from auditlake.operators import lookup as module

    monkeypatch.setattr(module, "BROADCAST_BYTES", 0)
    rows = spark.createDataFrame([("r", "s", 1)], "repository string, sha string, score int")
    table = spark.createDataFrame([("r", "s", 2)], "repository string, sha string, least int")
    joined = lookup(rows, table, ["repository", "sha"], ["sha"])
    assert "explode" not in physical(joined) and joined.collect()[0].least == 2


def test_inputs_are_dealt_out_before_they_are_made(spark):
    """What is shuffled for an input are columns of the test table, not the longer rows that come of them."""
    for build, kept in (
        (fx.files.build, {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"}),
        (fx.trees.build, {"l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"}),
        (fx.policy_files.build, {"o_orderkey"}),
        (fx.raw_policies.build, {"c_custkey"}),
    ):
        shuffles = exchanged(build(spark, SF_DIR))
        assert shuffles == [kept]


def test_inputs_are_dealt_out_to_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    assert fx.raw_policies.build(spark, SF_DIR).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(fx, "ROWS_PER_TASK", 10)
    assert fx.raw_policies.build(spark, SF_DIR).rdd.getNumPartitions() >= 16


def test_texts_are_sorted_by_sha_first(spark):
    """All repositories of an owner begin alike, and sorts compare first bytes first."""
    text = physical(fo.dedupe_paths(fx.files(spark, SF_DIR)))
    assert re.search(r"Sort \[sha#", text) and not re.search(r"Sort \[repository#", text)
    text = physical(po.pick_policy(fx.policy_files(spark, SF_DIR)))
    assert re.search(r"Sort \[sha#", text) and not re.search(r"Sort \[repository#", text)


def test_joins_of_commits_with_commits_are_not_broadcast(spark):
    files, commits = fx.files(spark, SF_DIR), fx.commits(spark, SF_DIR)
    runs = commits.selectExpr("repository", "sha AS head_sha", "'n' AS name", "'Quality score: 1/100 (F)' AS title", "1 AS run_seq")
    previous = pb.previous_scores(commits, runs, "n")
    report = plan.audit(files, commits)
    found = nodes(pb.check_runs(report, "js", files=files, previous=previous))
    left = [name for name, text, _ in found if name.endswith("Join") and "LeftOuter" in text]
    assert left == ["SortMergeJoin"] * 3
