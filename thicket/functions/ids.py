"""Dot-path ids, status domains and text functions, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses, those that end work, and node types by depth.
STATUSES = ["open", "in_progress", "blocked", "done", "deferred", "cancelled", "invalidated"]
TERMINAL = ["done", "cancelled", "invalidated"]
NODE_TYPES = ["epic", "story", "issue", "micro"]


def project(id_: Column) -> Column:
    """What is before the last dash of the first segment."""
    return F.regexp_extract(F.substring_index(id_, ".", 1), r"^(.*)-[^-]*$", 1)


def parent(id_: Column) -> Column:
    return F.when(F.instr(id_, ".") > 0, F.regexp_extract(id_, r"^(.*)\.[^.]*$", 1))


def depth(id_: Column) -> Column:
    return F.length(id_) - F.length(F.replace(id_, F.lit("."), F.lit("")))


def node_type(d: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, NODE_TYPES)), F.least(d, F.lit(3)) + 1)


def under(id_: Column, root: str) -> Column:
    """The node itself and all below it: the dot keeps P-1 and P-12 apart."""
    return (id_ == root) | id_.startswith(f"{root}.")


def natural(id_: Column) -> Column:
    """Sorts by prefix, then by each segment's number, parents first; a provisional segment sorts after numbers."""
    last = F.substring_index(id_, "-", -1)
    numbers = F.transform(F.split(last, r"\."), lambda x: F.struct(F.coalesce(F.try_to_number(F.when(x.rlike("^[0-9]{1,18}$"), x), F.lit("9" * 18)).cast("bigint"), F.lit(2**62)).alias("n"), F.when(~x.rlike("^[0-9]+$"), x).alias("s")))
    return F.struct(F.regexp_extract(id_, r"^(.*)-[^-]*$", 1).alias("prefix"), numbers.alias("numbers"))


def ancestors(id_: Column) -> Column:
    """All prefixes of a path, root first, itself included."""
    parts = F.split(id_, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def provisional(id_: Column) -> Column:
    return id_.rlike(r"(^|[.-])u[0-9a-f]{12}(\.|$)")


def valid_prefix(p: Column) -> Column:
    return p.rlike("^[A-Z][A-Z0-9-]{0,19}$")


def valid_id(id_: Column) -> Column:
    return id_.rlike(r"^[A-Z][A-Z0-9-]{0,19}-([0-9]+|u[0-9a-f]{12})(\.([0-9]+|u[0-9a-f]{12}))*$")


def canonical_json(json: Column) -> Column:
    """JSON with the five characters escaped that the wire format escapes in strings."""
    for plain, code in (("<", "003c"), (">", "003e"), ("&", "0026"), ("\u2028", "2028"), ("\u2029", "2029")):
        json = F.replace(json, F.lit(plain), F.lit(f"\\u{code}"))
    return json


def content_hash(title: Column, description: Column, prompt: Column, acceptance: Column, labels: Column) -> Column:
    """sha-256 of the compact JSON of the content fields, keys and labels in order."""
    empty = F.lit("")
    fields = F.struct(F.coalesce(acceptance, empty).alias("acceptance"), F.coalesce(description, empty).alias("description"), F.sort_array(F.coalesce(labels, F.array().cast("array<string>"))).alias("labels"), F.coalesce(prompt, empty).alias("prompt"), F.coalesce(title, empty).alias("title"))
    return F.sha2(canonical_json(F.to_json(fields)), 256)


def mention(text: Column) -> Column:
    """The first @agent at a boundary, else empty."""
    return F.regexp_extract(text, r"(?:^|[^\w@])@([a-z0-9_-]{1,64})", 1)


def sanitise(text: Column) -> Column:
    """Control characters but tab and newline become U+FFFD."""
    return F.regexp_replace(text, r"[\p{Cc}&&[^\t\n]]", "�")


def tokens(text: Column) -> Column:
    """A quarter of the bytes, as the estimate of tokens."""
    return F.floor(F.octet_length(text) / 4)


def semver(version: Column) -> Column:
    """major, minor, patch, whether it's a release, and the pre-release tag, which sort as versions do; null if it's no version.

    One leading ``v`` may stand before it; build data after a plus don't count.
    """
    form = r"^v?(\d{1,9})\.(\d{1,9})\.(\d{1,9})(?:-([^+]+))?(?:\+.*)?$"
    numbers = [F.try_to_number(F.nullif(F.regexp_extract(version, form, i), F.lit("")), F.lit("999999999")).cast("int").alias(f"n{i}") for i in (1, 2, 3)]
    tag = F.regexp_extract(version, form, 4)
    return F.when(version.rlike(form), F.struct(*numbers, (tag == "").alias("release"), tag.alias("tag")))


def redact_dsn(text: Column) -> Column:
    """Passwords of connection strings become stars."""
    return F.regexp_replace(F.regexp_replace(text, r"(://[^:/@\s]+):[^@\s]+@", "$1:***@"), r"(?i)(password\s*=\s*)\S+", "$1***")
