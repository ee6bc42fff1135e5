"""Code names and content-derived ids, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_LENGTH = 16
#: What stands for null in an id, and what stands between its parts.
NULL_MARK, PART_MARK = "\x00", "\x1f"
#: One part of a name, lower-cased.
PART_PATTERN = r"^[a-z0-9]+([_-][a-z0-9]+)*\z"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def family_of(name) -> Column:
    """What stands before the first hyphen."""
    return F.substring_index(_col(name), "-", 1)


def sub_of(name) -> Column:
    """What stands after the first hyphen, else empty."""
    n = _col(name)
    return F.when(F.instr(n, "-") > 0, F.substring(n, F.instr(n, "-") + 1, F.length(n))).otherwise(F.lit(""))


def split_name(name) -> Column:
    return F.struct(family_of(name).alias("family"), sub_of(name).alias("sub"))


def content_hash(text, length: int = HASH_LENGTH) -> Column:
    return F.substring(F.sha2(_col(text).cast("string"), 256), 1, length)


def digest_parts(*parts) -> Column:
    """Hash of parts in order; null and empty text stay apart, and booleans are spelled out."""
    return content_hash(F.concat_ws(PART_MARK, *[F.coalesce(_col(p).cast("string"), F.lit(NULL_MARK)) for p in parts]))


def mint(prefix: str, *parts) -> Column:
    return F.concat(F.lit(prefix + "-"), digest_parts(*parts))


def code_id(name) -> Column:
    return F.concat(F.lit("code-"), content_hash(name))


def checkpoint_id(run_id, at_response_count, trigger, base_snapshot_id, ordinal) -> Column:
    """The ordinal counts only from the second checkpoint with the same fields on."""
    plain = mint("ckpt", run_id, at_response_count, trigger, base_snapshot_id)
    return F.when(_col(ordinal) > 0, mint("ckpt", run_id, at_response_count, trigger, base_snapshot_id, ordinal)).otherwise(plain)


def grammar_reasons(name) -> Column:
    """Why a name breaks the grammar: white space in it, or a part that is no word of the pattern."""
    n = _col(name)
    bad = lambda part: ~F.lower(part).rlike(PART_PATTERN)
    parts = bad(family_of(n)) | ((F.instr(n, "-") > 0) & bad(sub_of(n)))
    listed = F.array(F.when(n.rlike(r"(?U)[\s\x1c-\x1f]"), F.lit("whitespace")), F.when(parts, F.lit("part_pattern")))
    return F.filter(listed, lambda x: x.isNotNull())


def code_text(name, description) -> Column:
    """How a code is shown to an embedding: its name, with the description if there is one."""
    d = F.coalesce(_col(description), F.lit(""))
    return F.when(d != "", F.concat(_col(name), F.lit(": "), d)).otherwise(_col(name))
