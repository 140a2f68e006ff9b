"""Webhook signature expressions (HMAC-SHA256), without any Python UDF."""

from __future__ import annotations

import hashlib

from auditlake import catalog
from auditlake.functions.literals import text

SIGNATURE_PREFIX = "sha256="
_BLOCK = 64


def hmac_sha256_hex(body: str, secret: str) -> str:
    """Lowercase hex HMAC-SHA256 of a binary column (RFC 2104).

    The pads are derived from the secret and become literals of the query plan,
    which the sessions of ``auditlake.session`` redact where plans are shown.
    """
    key = secret.encode("utf-8")
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    inner_pad = bytes(byte ^ 0x36 for byte in key).hex()
    outer_pad = bytes(byte ^ 0x5C for byte in key).hex()
    inner = f"unhex(sha2(concat(X'{inner_pad}', {body}), 256))"
    return f"sha2(concat(X'{outer_pad}', {inner}), 256)"


def signature_valid(body: str, signature: str, secret: str, dialect: str = "py") -> str:
    """Whether a delivery is signed with the secret.

    A missing signature or one without the ``sha256=`` prefix is not valid.
    With an empty secret nothing is valid; js fails on the first signature that
    has the prefix.
    """
    prefix = text(SIGNATURE_PREFIX)
    has_prefix = f"coalesce(startswith({signature}, {prefix}), false)"
    if not secret:
        if catalog.require_dialect(dialect) == "py":
            return "false"
        failure = "CAST(raise_error('the webhook secret is not configured') AS BOOLEAN)"
        return f"IF({has_prefix}, {failure}, false)"
    expected = f"concat({prefix}, {hmac_sha256_hex(body, secret)})"
    return f"({has_prefix} AND coalesce({signature} = {expected}, false))"
