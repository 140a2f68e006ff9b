"""Webhook event operators: stateless projections, for batch and streaming.

Input columns: ``event_header``, ``signature`` and ``body`` (binary).  A body is
parsed only when signature and header say that it matters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from auditlake import catalog
from auditlake.functions.documents import with_document
from auditlake.functions.literals import one_of
from auditlake.functions.signature import signature_valid

# Values of the ``status`` column.
REJECTED, PONG, IGNORED, INVALID, ACCEPTED = "rejected", "pong", "ignored", "invalid", "accepted"
# Value of the ``route`` column for events that may start an audit.
AUDITED = "audited"

# Payload fields the rules look at: column name to path in the document.
_FIELDS = {
    "deleted": "deleted",
    "action": "action",
    "draft": "pull_request.draft",
    "installation": "installation.id",
    "repository": "repository.full_name",
    "pull_sha": "pull_request.head.sha",
    "push_sha": "after",
}


def _as(value: str, kind: str) -> str:
    return f"try_variant_get({value}, '$', '{kind}')"


def _truthy(value: str, dialect: str) -> str:
    """Truth value of a JSON value: null, false, 0 and '' are false, in the py
    dialect empty lists and objects too."""
    kind = f"schema_of_variant({value})"
    empty = ""
    if dialect == "py":
        empty = f" WHEN {_as(value, 'string')} IN ('[]', '{{}}') THEN false"
    return (
        f"coalesce(CASE WHEN {kind} = 'VOID' THEN false"
        f" WHEN {kind} = 'BOOLEAN' THEN {_as(value, 'boolean')}"
        f" WHEN {kind} = 'STRING' THEN {_as(value, 'string')} <> ''{empty}"
        f" ELSE coalesce({_as(value, 'double')} <> 0, {value} IS NOT NULL) END, false)"
    )


def _present_text(value: str, dialect: str) -> str:
    """The value as text where it counts as present, else NULL."""
    return f"IF({_truthy(value, dialect)}, {_as(value, 'string')}, NULL)"


def with_signature(events: DataFrame, secret: str, dialect: str = "py") -> DataFrame:
    """Adds ``signature_valid``."""
    valid = signature_valid("body", "signature", secret, dialect)
    return events.selectExpr("*", f"{valid} AS signature_valid")


def _with_payload(events: DataFrame, wanted: str) -> DataFrame:
    """Adds ``_payload`` for the deliveries whose body is wanted."""
    text = f"IF({wanted}, make_valid_utf8(CAST(body AS STRING)), NULL)"
    return with_document(events, text, "_payload")


def route_event(events: DataFrame, dialect: str = "py") -> DataFrame:
    """Adds ``route`` and ``event`` by the event header alone: ``pong``,
    ``ignored`` (with the event name) or ``audited``."""
    route = (
        f"CASE WHEN event_header = 'ping' THEN '{PONG}'"
        f" WHEN event_header IN ('push', 'pull_request') THEN '{AUDITED}' ELSE '{IGNORED}' END"
    )
    name = "event_header"
    if catalog.require_dialect(dialect) == "py":
        name = "coalesce(nullif(event_header, ''), 'unknown')"
    return events.selectExpr("*", f"{route} AS route").selectExpr(
        "*", f"IF(route = '{IGNORED}', {name}, NULL) AS event"
    )


def parse_deliveries(events: DataFrame, secret: str, dialect: str = "py") -> DataFrame:
    """Adds what the audit rules look at: ``signature_valid``, ``route``,
    ``event``, ``parsed``, ``deleted``, ``action``, ``draft``,
    ``installation_id``, ``repository`` and ``head_sha``.

    Values that count as missing (also 0 and '') are NULL.  For the action
    that holds in the py dialect only; js takes just null for missing.
    """
    routed = route_event(with_signature(events, secret, dialect), dialect)
    kept = [*events.columns, "signature_valid", "route", "event"]
    fields = [
        f"try_variant_get(_payload, '$.{path}', 'variant') AS _{name}"
        for name, path in _FIELDS.items()
    ]
    staged = _with_payload(routed, f"signature_valid AND route = '{AUDITED}'").selectExpr(
        *kept, "_payload IS NOT NULL AS parsed", *fields
    )
    action = _present_text("_action", "py") if dialect == "py" else _as("_action", "string")
    pull_sha, push_sha = (_present_text(name, dialect) for name in ("_pull_sha", "_push_sha"))
    installation = f"IF({_truthy('_installation', dialect)}, {_as('_installation', 'bigint')}, NULL)"
    return staged.selectExpr(
        *kept,
        "parsed",
        f"{_truthy('_deleted', dialect)} AS deleted",
        f"{action} AS action",
        f"{_truthy('_draft', dialect)} AS draft",
        f"{installation} AS installation_id",
        f"{_present_text('_repository', dialect)} AS repository",
        f"IF(event_header = 'pull_request', {pull_sha}, {push_sha}) AS head_sha",
    )


# Conditions on parsed deliveries.
_DELETED_REF = "coalesce(event_header = 'push' AND deleted, false)"
_OTHER_ACTION = (
    "coalesce(event_header = 'pull_request', false)"
    f" AND NOT coalesce({one_of('action', catalog.AUDITED_ACTIONS)}, false)"
)
_DRAFT = "coalesce(event_header = 'pull_request' AND draft, false)"
_HAS_TARGET = (
    "(installation_id IS NOT NULL AND repository IS NOT NULL AND head_sha IS NOT NULL)"
)


def drop_deleted_refs(deliveries: DataFrame) -> DataFrame:
    """Parsed deliveries without pushes that delete their ref."""
    return deliveries.filter(f"NOT {_DELETED_REF}")


def keep_audited_actions(deliveries: DataFrame) -> DataFrame:
    """Parsed deliveries without pull-request actions that start no audit."""
    return deliveries.filter(f"NOT ({_OTHER_ACTION})")


def drop_drafts(deliveries: DataFrame) -> DataFrame:
    """Parsed deliveries without draft pull requests."""
    return deliveries.filter(f"NOT {_DRAFT}")


def with_target(deliveries: DataFrame) -> DataFrame:
    """Adds ``target_valid``: installation, repository and commit are known."""
    return deliveries.selectExpr("*", f"{_HAS_TARGET} AS target_valid")


def event_status(events: DataFrame, secret: str, dialect: str = "py") -> DataFrame:
    """Adds ``status``, ``event``, ``installation_id``, ``repository`` and
    ``head_sha``.

    Rules in order: signature, ping, other events, unreadable body, deleted
    ref, pull-request action, draft, missing target.  The last three columns
    are filled for accepted deliveries only.
    """
    # Each step: condition, status, event.
    steps = [
        ("NOT signature_valid", REJECTED, "NULL"),
        (f"route = '{PONG}'", PONG, "NULL"),
        (f"route = '{IGNORED}'", IGNORED, "event"),
        ("NOT parsed", INVALID, "NULL"),
        (_DELETED_REF, IGNORED, "'deleted-ref'"),
        (_OTHER_ACTION, IGNORED, "concat('pull_request.', coalesce(action, 'unknown'))"),
        (_DRAFT, IGNORED, "'draft-pull-request'"),
        (f"NOT {_HAS_TARGET}", INVALID, "NULL"),
    ]
    status = " ".join(f"WHEN {condition} THEN '{name}'" for condition, name, _ in steps)
    event = " ".join(f"WHEN {condition} THEN {reason}" for condition, _, reason in steps)
    targets = ("installation_id", "repository", "head_sha")
    staged = parse_deliveries(events, secret, dialect).selectExpr(
        *events.columns,
        "signature_valid",
        f"CASE {status} ELSE '{ACCEPTED}' END AS status",
        f"CASE {event} END AS event",
        *targets,
    )
    return staged.selectExpr(
        *events.columns,
        "signature_valid",
        "status",
        "event",
        *[f"IF(status = '{ACCEPTED}', {name}, NULL) AS {name}" for name in targets],
    )


def audit_targets(statuses: DataFrame) -> DataFrame:
    """Installation, repository and commit of the accepted deliveries."""
    return statuses.filter(f"status = '{ACCEPTED}'").select(
        "installation_id", "repository", "head_sha"
    )


def route_marketplace(events: DataFrame, secret: str) -> DataFrame:
    """Adds ``status``, ``event``, ``action``, ``account`` and ``plan`` to
    marketplace deliveries; absent names become ``unknown``."""
    purchase = "coalesce(event_header = 'marketplace_purchase', false)"
    # This route never fails on an empty secret, in either dialect.
    signed = with_signature(events, secret, "py")
    status = (
        f"CASE WHEN NOT signature_valid THEN '{REJECTED}'"
        f" WHEN event_header = 'ping' THEN '{PONG}' WHEN NOT {purchase} THEN '{IGNORED}'"
        f" WHEN _payload IS NULL THEN '{INVALID}' ELSE '{ACCEPTED}' END"
    )
    staged = _with_payload(signed, f"signature_valid AND {purchase}").selectExpr(
        "*", f"{status} AS status"
    )
    names = {
        "action": "action",
        "account": "marketplace_purchase.account.login",
        "plan": "marketplace_purchase.plan.name",
    }
    columns = [
        f"IF(status = '{ACCEPTED}',"
        f" coalesce(try_variant_get(_payload, '$.{path}', 'string'), 'unknown'), NULL) AS {name}"
        for name, path in names.items()
    ]
    return staged.selectExpr(
        *events.columns,
        "signature_valid",
        "status",
        f"IF(status = '{IGNORED}', event_header, NULL) AS event",
        *columns,
    )
