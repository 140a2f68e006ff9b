import hashlib
import hmac
import json

import pytest

from auditlake import schemas
from auditlake.functions.signature import hmac_sha256_hex, signature_valid
from auditlake.operators import events as ev
from auditlake.sources.events import raw_events_from_messages

SECRET = "secret"


def sign(body: bytes, secret: str = SECRET) -> str:
    return "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def deliveries(spark, rows):
    """rows: (header, payload or bytes[, signature])."""
    out = []
    for n, (header, payload, *signature) in enumerate(rows):
        body = payload if isinstance(payload, bytes) else json.dumps(payload).encode()
        out.append((str(n), None, header, signature[0] if signature else sign(body), body))
    return spark.createDataFrame(out, schemas.RAW_EVENTS)


def statuses(spark, rows, dialect="py"):
    found = ev.event_status(deliveries(spark, rows), SECRET, dialect).collect()
    found.sort(key=lambda row: int(row.delivery_id))
    return [(row.status, row.event) for row in found]


@pytest.mark.parametrize("secret", ["secret", "k" * 64, "long " * 40, "ünïcode"])
@pytest.mark.parametrize("size", [0, 1, 55, 64, 1000])
def test_hmac_matches_the_standard_library(spark, secret, size):
    body = bytes(range(256)) * 4
    frame = spark.createDataFrame([(body[:size],)], "body binary")
    digest = frame.selectExpr(f"{hmac_sha256_hex('body', secret)} AS d").first().d
    assert digest == hmac.new(secret.encode(), body[:size], hashlib.sha256).hexdigest()


def test_signature_verification(spark):
    body = b'{"zen":"Keep it simple"}'
    frame = spark.createDataFrame(
        [(body, sign(body)), (body, None), (body, sign(body)[7:]), (body, sign(body, "other"))],
        "body binary, signature string",
    )

    def valid(secret, dialect="py"):
        check = signature_valid("body", "signature", secret, dialect)
        return [r.v for r in frame.selectExpr(f"{check} AS v").collect()]

    assert valid("secret") == [True, False, False, False]
    assert valid("wrong") == [False] * 4
    assert valid("") == [False] * 4
    with pytest.raises(Exception, match="not configured"):
        valid("", "js")


def pull(action="synchronize", draft=False, **changes):
    payload = {
        "action": action,
        "installation": {"id": 7},
        "repository": {"full_name": "owner/repo"},
        "pull_request": {"draft": draft, "head": {"sha": "abc123"}},
    }
    payload.update(changes)
    return payload


PUSH = {"after": "abc", "installation": {"id": 7}, "repository": {"full_name": "o/r"}}


def test_pull_request_uses_the_head_sha(spark):
    rows = ev.event_status(deliveries(spark, [("pull_request", pull())]), SECRET)
    assert [tuple(r) for r in ev.audit_targets(rows).collect()] == [(7, "owner/repo", "abc123")]


def test_draft_is_ignored_even_without_a_head(spark):
    payload = pull("opened", pull_request={"draft": True})
    assert statuses(spark, [("pull_request", payload)]) == [("ignored", "draft-pull-request")]


def test_precedence(spark):
    rows = [
        ("push", PUSH, "sha256=00"),
        ("ping", b"not json"),
        ("issues", b"not json"),
        (None, PUSH),
        ("", PUSH),
        ("push", b"not json"),
        ("push", {**PUSH, "deleted": True}),
        ("pull_request", pull("closed", draft=True)),
        ("pull_request", pull("opened", draft=True)),
        ("push", {**PUSH, "installation": {}}),
        ("push", {**PUSH, "installation": {"id": 0}}),
        ("push", {**PUSH, "after": ""}),
        ("push", {**PUSH, "repository": None}),
        ("push", PUSH),
        ("push", json.dumps(PUSH).encode() + b"}"),
    ]
    expected = [
        ("rejected", None),
        ("pong", None),
        ("ignored", "issues"),
        ("ignored", "unknown"),
        ("ignored", "unknown"),
        ("invalid", None),
        ("ignored", "deleted-ref"),
        ("ignored", "pull_request.closed"),
        ("ignored", "draft-pull-request"),
        *[("invalid", None)] * 4,
        ("accepted", None),
        ("invalid", None),
    ]
    assert statuses(spark, rows) == expected
    expected[3], expected[4] = ("ignored", None), ("ignored", "")
    assert statuses(spark, rows, "js") == expected


@pytest.mark.parametrize(
    "value, py, js",
    [
        (None, False, False), (False, False, False), (True, True, True), (0, False, False),
        (0.0, False, False), (1, True, True), ("", False, False), ("0", True, True),
        ([], False, True), ({}, False, True), ([0], True, True), ({"a": 0}, True, True),
    ],
)
def test_deleted_follows_the_truth_rules_of_the_dialect(spark, value, py, js):
    rows = [("push", {**PUSH, "deleted": value})]
    ignored, accepted = [("ignored", "deleted-ref")], [("accepted", None)]
    assert statuses(spark, rows) == (ignored if py else accepted)
    assert statuses(spark, rows, "js") == (ignored if js else accepted)


def test_missing_action(spark):
    rows = [("pull_request", pull(None)), ("pull_request", pull(""))]
    unknown, empty = ("ignored", "pull_request.unknown"), ("ignored", "pull_request.")
    assert statuses(spark, rows) == [unknown, unknown]
    assert statuses(spark, rows, "js") == [unknown, empty]


def test_marketplace(spark):
    full = {"action": "purchased", "marketplace_purchase": {"account": {"login": "a"}, "plan": {"name": "p"}}}
    rows = [
        ("ping", b"x"),
        ("push", PUSH),
        ("marketplace_purchase", full),
        ("marketplace_purchase", {"marketplace_purchase": {"plan": None}}),
        ("marketplace_purchase", full, None),
    ]
    found = ev.route_marketplace(deliveries(spark, rows), SECRET).collect()
    found.sort(key=lambda row: int(row.delivery_id))
    assert [(r.status, r.event, r.action, r.account, r.plan) for r in found] == [
        ("pong", None, None, None, None),
        ("ignored", "push", None, None, None),
        ("accepted", None, "purchased", "a", "p"),
        ("accepted", None, "unknown", "unknown", "unknown"),
        ("rejected", None, None, None, None),
    ]


def test_messages_become_raw_events(spark):
    messages = spark.createDataFrame(
        [(b"id-1", b"{}", None, [("X-GitHub-Event", b"push"), ("x-hub-signature-256", b"s")]), (None, b"{}", None, [])],
        "key binary, value binary, timestamp timestamp, headers array<struct<key:string,value:binary>>",
    )
    rows = raw_events_from_messages(messages).collect()
    assert [(r.delivery_id, r.event_header, r.signature, bytes(r.body)) for r in rows] == [
        ("id-1", "push", "s", b"{}"),
        (None, None, None, b"{}"),
    ]
