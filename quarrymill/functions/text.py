"""Strings: addresses, paths, counts, cuts, hashes and JSON in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks an address as generic.
GENERIC_EMAIL_PARTS = (
    "noreply",
    "no-reply",
    "donotreply",
    "do-not-reply",
    "bot@",
    "github-actions",
    "dependabot",
    "renovate",
    "notifications@github.com",
    "support@github.com",
    "users.noreply.github.com",
    "actions@github.com",
    "action@github.com",
)
EMAIL_FORM = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"
_GENERIC = "|".join(p.replace(".", r"\.") for p in GENERIC_EMAIL_PARTS)


def is_generic_email_lenient(email: Column) -> Column:
    """Empty, or with a generic part; the form is not looked at."""
    e = F.coalesce(email, F.lit(""))
    return (e == "") | F.lower(e).rlike(_GENERIC)


def is_generic_email(email: Column) -> Column:
    """Empty, not of an address's form, or with a generic part."""
    e = F.coalesce(email, F.lit(""))
    return ~e.rlike(EMAIL_FORM) | F.lower(e).rlike(_GENERIC)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    """What is before the last /; '.' without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def first_dir(path: Column) -> Column:
    """The first directory; '' for a file at the top."""
    return F.when(F.instr(path, "/") > 0, F.split(path, "/")[0]).otherwise("")


def suffix(path: Column, missing: str = "[no ext]") -> Column:
    """The last .x of the file name. A dot at its very start or end doesn't begin one."""
    found = F.regexp_extract(file_name(path), r"[^/](\.[^.]+)$", 1)
    return F.when(found == "", missing).otherwise(found)


def contains_folded(text: Column, part: Column) -> Column:
    """Whether `part` is in `text`, case-insensitively."""
    return F.contains(F.lower(text), F.lower(part))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of `part`; 0 for an empty one."""
    n = (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)
    return F.when(F.length(part) > 0, n.cast("long")).otherwise(F.lit(0).cast("long"))


def head(text: Column, n: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, n)


def squeeze(text: Column, limit: int = 8000, marker: str = "\n...\n") -> Column:
    """A long text as its first and last limit/2 characters with a marker between."""
    half = limit // 2
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, half), F.lit(marker), F.right(text, F.lit(half)))).otherwise(text)


def lines(text: Column, limit: int | None = None) -> Column:
    """Lines by \\n or \\r\\n, at most `limit`."""
    parts = F.split(F.coalesce(text, F.lit("")), r"\r?\n", -1)
    return F.slice(parts, 1, limit) if limit else parts


#: Least and greatest length of what counts as an identifier, a string literal, a matched block.
LENGTHS = {"identifier": (1, 199), "literal": (1, 500), "match": (101, None)}


def sane_length(text: Column, kind: str) -> Column:
    """Whether a text has a length that its kind may have."""
    low, high = LENGTHS[kind]
    return F.length(text) >= low if high is None else F.length(text).between(low, high)


def literal_class(value: Column) -> Column:
    """'url', 'endpoint', 'queue' or null, in this order of precedence."""
    return (
        F.when(value.rlike(r"^(https?://|[A-Za-z][A-Za-z0-9+.\-]*://)"), "url")
        .when(value.rlike(r"^/[A-Za-z0-9/_\-{}.]+$"), "endpoint")
        .when(value.rlike(r"\w+\.(queue|topic|exchange|channel)"), "queue")
    )


def fingerprint(values: Column, length: int | None = None) -> Column:
    """SHA-256 in hexadecimal of the sorted values put together; its first `length` digits if given."""
    whole = F.sha2(F.array_join(F.sort_array(values), ""), 256)
    return F.substring(whole, 1, length) if length else whole


def safe_file_name(text: Column) -> Column:
    return F.regexp_replace(text, r'[/\\:*?"<>|\s]+', "_")


def json_block(text: Column) -> Column:
    """The JSON object in a free text: a fence tagged json, any fence with an object, the first balanced object (one
    level of nesting), the whole text; null if there is none."""
    t = F.trim(F.regexp_replace(F.trim(text), r"(?i)^assistant:\s*", ""))
    tagged = F.trim(F.regexp_extract(t, r"(?is)```json(.*?)```", 1))
    fenced = F.trim(F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1))
    first = F.regexp_extract(t, r"(?s)(\{(?:[^{}]|\{[^{}]*\})*\})", 1)
    return F.coalesce(F.when(tagged.startswith("{"), tagged), F.when(fenced != "", fenced), F.when(first != "", first), F.when(t.startswith("{") & t.endswith("}"), t))


def json_repaired(raw: Column, schema: str) -> Column:
    """`raw` parsed: as it is; without commas before a closing bracket; from its first { to its last }; else null."""
    strict = lambda c: F.from_json(F.when(F.try_parse_json(c).isNotNull(), c), schema)
    no_commas = F.regexp_replace(raw, r",\s*([}\]])", "$1")
    middle = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.coalesce(strict(raw), strict(no_commas), strict(middle))


def yaml_block(text: Column) -> Column:
    """The YAML in a free text: a fence tagged yaml, any fence, else the run of lines from the first `key:`."""
    stripped = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    tagged = stripped(F.regexp_extract(text, r"(?is)```ya?ml\s*\n(.*?)```", 1))
    fenced = stripped(F.regexp_extract(text, r"(?s)```\s*\n(.*?)```", 1))
    keys = F.regexp_extract(text, r"(?m)((?:^[A-Za-z_][\w ]*:.*(?:\n[ \t-].*)*\n?)+)", 1)
    return F.coalesce(F.when(tagged != "", tagged), F.when(fenced != "", fenced), F.when(keys != "", stripped(keys)))
