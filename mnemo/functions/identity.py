"""Identities: escaped scope paths, slugs, correlation ids, deterministic UUIDs, typed ids, principals."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix of the ids and markers of this deployment.
PRODUCT = "mnemo"
LEGACY_SPACE = f"{PRODUCT}_legacy"

# Name spaces of the deterministic ids, this deployment's own.
ATOMS = uuid.UUID("1136f2fb-1747-5650-8711-e8e438be043b")
SESSION_TIMERS = uuid.UUID("ce58b73a-bf87-55a3-a296-cb1b0adce668")
SCENE_TIMERS = uuid.UUID("3d5ed464-498e-5f8e-a0f6-9f09af66acbe")
PERSONA_TIMERS = uuid.UUID("cd20e951-b605-503c-866e-382dbe1f66d8")

# The alphabet of typed ids (Crockford's base 32, lower case).
BASE32 = "0123456789abcdefghjkmnpqrstvwxyz"


def escape_component(c: Column) -> Column:
    """% first, then the two separators."""
    for raw, code in (("%", "%25"), ("/", "%2F"), (":", "%3A")):
        c = F.replace(c, F.lit(raw), F.lit(code))
    return c


def _both(kind: Column, ref: Column) -> Column:
    return kind.isNotNull() & ref.isNotNull()


def scope_identity(namespace: Column, kind: Column, ref: Column) -> Column:
    """Escaped parts joined by /; a half-null scope is global."""
    whole = _both(kind, ref)
    return F.concat_ws("/", escape_component(namespace), F.when(whole, escape_component(kind)), F.when(whole, escape_component(ref)))


def scope_label(namespace: Column, kind: Column, ref: Column) -> Column:
    """For people and prompts: not escaped."""
    return F.concat_ws("/", namespace, kind, ref)


def slug(readable: Column, identity: Column) -> Column:
    """A path-safe name: the readable part made safe, and ten hex digits of the identity's SHA-256."""
    return F.concat(F.regexp_replace(readable, "[^A-Za-z0-9_-]", "-"), F.lit("-"), F.substring(F.sha2(identity, 256), 1, 10))


def scope_slug(namespace: Column, kind: Column, ref: Column) -> Column:
    return slug(F.concat_ws("-", namespace, kind, ref), scope_identity(namespace, kind, ref))


def space_directory(space: Column) -> Column:
    return slug(space, space)


def scene_id(namespace: Column, kind: Column, ref: Column, key: str = "default") -> Column:
    return F.concat(F.lit(f"{PRODUCT}_scene:"), scope_identity(namespace, kind, ref), F.lit(f":{key}"))


def persona_id(namespace: Column, kind: Column, ref: Column) -> Column:
    return F.concat(F.lit(f"{PRODUCT}_persona:"), scope_identity(namespace, kind, ref))


def correlation_id(space: Column, namespace: Column, kind: Column, ref: Column) -> Column:
    return F.concat(space, F.lit(":"), scope_identity(namespace, kind, ref))


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """Version 5 from built-in SHA-1: its first 16 bytes with the version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, 1)
    parts = [F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)]
    return F.concat_ws("-", *parts)


def atom_uuid(session: Column, content: Column) -> Column:
    """Of the candidate's own content, so that a rewrite on retry doesn't change it."""
    return uuid5(ATOMS, F.concat(session, F.lit(":"), content))


def audit_id(session: Column, max_turn: Column, content: Column) -> Column:
    return F.concat(F.lit(f"{PRODUCT}_consolidation_decision:"), uuid5(ATOMS, F.concat(F.lit("audit:"), session, F.lit(":"), max_turn.cast("string"), F.lit(":"), content)))


def type_id(prefix: str, value: uuid.UUID) -> str:
    n = value.int
    return f"{prefix}_" + "".join(BASE32[n >> 5 * i & 31] for i in range(25, -1, -1))


def parse_type_id(text: str | None, prefix: str | None = None) -> uuid.UUID | None:
    """The UUID of a typed id. With a prefix only that prefix is taken; without one any prefix or none."""
    if not text:
        return None
    head, _, tail = text.rpartition("_")
    if prefix is not None and head != prefix or len(tail) != 26 or tail[0] > "7" or any(c not in BASE32 for c in tail):
        return None
    if head and (not all(c.islower() and c.isascii() or c == "_" for c in head) or head.startswith("_") or len(head) > 63):
        return None
    n = 0
    for c in tail:
        n = n * 32 + BASE32.index(c)
    return uuid.UUID(int=n)


def _bits(text: Column, digit: Column, width: int) -> Column:
    """Characters of a text as groups of bits; digit: of a character x, its value."""
    return F.array_join(F.transform(F.split(text, ""), lambda x: F.lpad(F.conv(digit(x).cast("string"), 10, 2), width, "0")), "")


def typed(prefix: str, value: Column) -> Column:
    """Text UUIDs as typed ids."""
    bits = F.concat(F.lit("00"), _bits(F.lower(F.replace(value, F.lit("-"), F.lit(""))), lambda x: F.instr(F.lit("0123456789abcdef"), x) - 1, 4))
    each = F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: F.substr(F.lit(BASE32), F.conv(F.substr(bits, i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1)))
    return F.when(value.isNotNull(), F.concat(F.lit(f"{prefix}_"), F.array_join(each, "")))


def untyped(value: Column, prefix: str | None = None) -> Column:
    """Typed ids as text UUIDs; null where they don't parse. With a prefix only that prefix is taken; without one any prefix or none."""
    tail = F.regexp_extract(value, f"^{f'{prefix}_' if prefix is not None else '(?:(?:[a-z][a-z_]{0,62})?_)?'}([0-7][{BASE32}]{{25}})$", 1)
    bits = F.substr(_bits(tail, lambda x: F.instr(F.lit(BASE32), x) - 1, 5), F.lit(3), F.lit(128))
    digits = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.lower(F.conv(F.substr(bits, i * 4 + 1, F.lit(4)), 2, 16))), "")
    return F.when(tail != "", F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def opaque_id_problem(value: Column, forbidden: str = ":#%/", longest: int = 128) -> Column:
    """What is wrong with an opaque id, null if nothing."""
    return (
        F.when(value.isNull() | (value == ""), "empty")
        .when(F.length(value) > longest, "too long")
        .when(value.rlike(r"[\s\p{Cc}]"), "white space or control character")
        .when(value.rlike("[" + forbidden + "]"), "reserved character")
    )


def principal_kind(value: Column) -> Column:
    """unattributed, legacy, unknown marker or known."""
    return F.when(value == f"{PRODUCT}:unattributed", "unattributed").when(value.startswith(f"{PRODUCT}:legacy:"), "legacy").when(value.startswith(f"{PRODUCT}:"), "unknown marker").otherwise("known")


def principal_text(kind: Column, name: Column) -> Column:
    return F.when(kind == "unattributed", f"{PRODUCT}:unattributed").when(kind == "legacy", F.concat(F.lit(f"{PRODUCT}:legacy:"), name)).otherwise(name)


def redact_password(conninfo: Column) -> Column:
    """Passwords in key=value and URL connection strings."""
    keyed = F.regexp_replace(conninfo, r"(?i)(password\s*=\s*)('(?:[^'\\]|\\.)*'|\S+)", "$1***")
    return F.regexp_replace(keyed, r"(://[^:/@\s]+:)[^@\s]*@", "$1***@")
