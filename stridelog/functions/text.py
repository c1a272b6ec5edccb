"""Readings of recorded text as expressions: what readers do for one record, over a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exit_code_of(text: Column) -> Column:
    """The number after ``Exit code:``, else null."""
    said = F.regexp_extract(text, r"(?i)\bExit code:\s*(-?\d+)\b", 1)
    return F.when(said != "", said.cast("int"))


def test_signal(text: Column, code: Column) -> Column:
    """``N passed`` before ``N failed``; a bad exit alone is one failure; else empty."""
    low = F.lower(text)
    passed = F.regexp_extract(low, r"\b(\d+)\s+passed\b", 1)
    failed = F.regexp_extract(low, r"\b(\d+)\s+(?:failed|failures|errors?)\b", 1)
    return F.when(passed != "", F.concat(passed, F.lit(" passed"))).when(failed != "", F.concat(failed, F.lit(" failed"))).when(F.coalesce(code != 0, F.lit(False)), "1 failed").otherwise("")


test_signal.__test__ = False


def patch_targets(text: Column) -> Column:
    """Sorted distinct paths that a patch names."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^\*\*\* (?:Add File|Update File|Delete File|Move to): ([^\r\n]*)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(F.transform(found, F.trim), lambda x: x != "")))


def is_fixture(path: Column) -> Column:
    return F.concat(F.lit("/"), _slashed(path)).rlike(r"/tests/fixtures/")


def _slashed(path: Column) -> Column:
    return F.replace(F.lower(path), F.lit("\\"), F.lit("/"))


def history_of(path: Column) -> Column:
    """The history dialect that a file's name tells, else null."""
    name = F.element_at(F.split(_slashed(path), "/"), -1)
    return F.when(name.rlike("swe[_-]agent"), F.when(F.contains(name, F.lit("mini")), "mini-swe-agent").otherwise("swe-agent")).when(F.contains(name, F.lit("openhands")), "openhands")


def source_of(path: Column) -> Column:
    """Where a recording is from, by its path: a tool's own folder, a fixture (of a dialect), else a journal."""
    low, dialect = _slashed(path), history_of(path)
    return (
        F.when(F.contains(low, F.lit("/.codex/")), "codex").when(F.contains(low, F.lit("/.claude/")), "claude")
        .when(is_fixture(path), F.coalesce(F.concat(F.lit("foreign-"), dialect), F.lit("fixture"))).otherwise("journal")
    )


def is_candidate(path: Column) -> Column:
    """Is it read at all: JSON lines anywhere, whole documents among fixtures only."""
    return F.lower(path).rlike(r"\.jsonl$") | (is_fixture(path) & F.lower(path).rlike(r"\.(json|traj)$"))


#: Ends of file names in a form's folders; whole histories stand beside a manifest, which is none.
SUFFIXES = {"calls": "jsonl", "linked": "jsonl", "action": "traj|json", "editor": "json", "fenced": "json|jsonl|traj", "chat": "json"}


def is_read(path: Column, form: str) -> Column:
    """Is a file of a folder read in this form: by its name's end; in ``auto``, candidates and this library's own journals."""
    if form == "auto":
        return is_candidate(path) | path.rlike("/run_id=[^/]*/part-[^/]*$")
    return F.lower(path).rlike(rf"\.({SUFFIXES[form]})$") & ~path.rlike(r"(^|/)manifest\.json$")


def form_by_name(path: Column) -> Column:
    """The reader of the dialect that a file's name tells, else null."""
    dialect = history_of(path)
    return F.when(dialect == "swe-agent", "action").when(dialect == "openhands", "editor").when(dialect == "mini-swe-agent", "fenced")


def safe_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_")
