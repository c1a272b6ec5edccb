"""What the shell expressions must find, as a loop over one command's words."""

from __future__ import annotations

import re
import shlex
from collections.abc import Callable
from typing import NamedTuple


#: Characters that make a command or a path ambiguous.
AMBIGUOUS = r"[|&;\n\r$`*?\[{}~]"
_NOT_PATH = re.compile(r"[$`*?\[\]{}~|;&<>]|://")
#: Flags of test runners, without and with a value.
TEST_FLAGS, TEST_VALUES = ("-q", "-s", "-v", "-x", "--quiet", "--verbose"), ("-k", "-m", "--maxfail", "--tb")


class Unclear(Exception):
    """The command's files cannot be told."""


class Reading(NamedTuple):
    reads: set[str]
    writes: set[str]


def is_path(word: str, bare_tests: bool = False) -> bool:
    """A literal path: it has a directory or a suffix, and nothing to expand."""
    if not word or word in (".", "..") or word[0] == "-" or _NOT_PATH.search(word):
        return False
    parts = word.replace("\\", "/").split("/")
    if len(parts) > 1:
        return parts[-1] != "..."
    return (bare_tests and word in ("test", "tests")) or _suffix(word) != ""


def _suffix(word: str) -> str:
    name = word.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1]
    stem, dot, rest = name.rpartition(".")
    return dot + rest if stem.strip(".") and rest else ""


def _paths(words: list[str], bare_tests: bool = False) -> set[str]:
    if not all(is_path(w, bare_tests) for w in words):
        raise Unclear
    return set(words)


def _operands(args: list[str], flag: Callable[[str], bool] = lambda a: False, value: Callable[[str, str | None], bool] = lambda a, b: False) -> list[str]:
    """Arguments left when known flags, and flags with their values, are taken out."""
    out, rest = [], iter(range(len(args)))
    for i in rest:
        follower = args[i + 1] if i + 1 < len(args) else None
        if value(args[i], follower):
            if follower is None:
                raise Unclear
            next(rest)
        elif flag(args[i]):
            continue
        elif args[i].startswith("-"):
            raise Unclear
        else:
            out.append(args[i])
    return out


def _tests(args: list[str]) -> Reading:
    flag = lambda a: a == "--" or a in TEST_FLAGS or a.split("=", 1)[0] in TEST_VALUES and "=" in a
    files = _operands(args, flag, lambda a, _: a in TEST_VALUES)
    return Reading(_paths([f.split("::", 1)[0] for f in files], bare_tests=True), set())


def _reads(args: list[str]) -> Reading:
    return Reading(_paths(_operands(args)), set())


def _ends(args: list[str]) -> Reading:
    """head and tail: -n N, -nN and -N are counts."""

    files, counted = [], False
    for a in args:
        if counted and not a.isdigit():
            raise Unclear
        if not (counted or a == "-n" or re.fullmatch(r"-n?\d+", a)):
            files.append(a)
        counted = a == "-n" and not counted
    if counted:
        raise Unclear
    return Reading(_paths(files), set())


def _writes(*flags: str) -> Callable[[list[str]], Reading]:
    return lambda args: Reading(set(), _paths(_operands(args, lambda a: a in flags)))


def _copy(moves: bool) -> Callable[[list[str]], Reading]:
    def run(args: list[str]) -> Reading:
        if len(args) != 2:
            raise Unclear
        _paths(_operands(args))
        source, to = args
        return Reading({source}, {source, to} if moves else {to})

    return run


def _sed(args: list[str]) -> Reading:
    """Only in place does sed write; its script is the first operand, unless -e gives one before it."""
    state = {"in_place": False, "script": False}

    def value(a: str, b: str | None) -> bool:
        if a == "-e":
            state["script"] = True
            return True
        if a == "-i":
            state["in_place"] = True
            return b == ""
        return False

    def flag(a: str) -> bool:
        if a.startswith("-i"):
            state["in_place"] = True
            return True
        if a.startswith("-") or state["script"]:
            return False
        state["script"] = True
        return True

    files = _operands(args, flag, value)
    if not state["in_place"] or not files:
        return Reading(set(), set())
    own = _paths(files)
    return Reading(own, own)


def _script(args: list[str], suffixes: tuple[str, ...]) -> Reading:
    if not args:
        return Reading(set(), set())
    if not is_path(args[0]) or _suffix(args[0]) not in suffixes:
        raise Unclear
    return Reading({args[0]}, set())


def _python(args: list[str]) -> Reading:
    if args[:1] == ["-m"] and args[1:2] in (["pytest"], ["unittest"]):
        return _tests(args[2:])
    while args and args[0] in ("-u", "-B"):
        args = args[1:]
    return _script(args, (".py",))


def _npm(args: list[str]) -> Reading:
    after = args[1:] if args[:1] == ["test"] else args[2:] if args[:2] == ["run", "test"] else None
    if after is None and args:
        raise Unclear
    return _tests(after[1:] if after and after[0] == "--" else [])


def _go(args: list[str]) -> Reading:
    if args[:1] != ["test"]:
        raise Unclear
    return _tests(args[1:])


COMMANDS: dict[str, Callable[[list[str]], Reading]] = {
    "cat": _reads, "less": _reads, "head": _ends, "tail": _ends, "tee": _writes("-a"), "cp": _copy(False), "mv": _copy(True),
    "rm": _writes("-f", "-r", "-R", "-rf", "-fr", "-Rf", "-fR"), "touch": _writes(), "mkdir": _writes("-p"), "sed": _sed,
    "python": _python, "python3": _python, "py": _python, "node": lambda a: _script(a, (".js", ".mjs", ".cjs")),
    "pytest": _tests, "go": _go, "npm": _npm,
}


def _redirected(words: list[str]) -> tuple[list[str], set[str]]:
    """Words without output redirections, and the files those write."""
    left, writes, rest = [], set(), iter(range(len(words)))
    for i in rest:
        word = words[i]
        if word.startswith("<"):
            raise Unclear
        if not word.startswith(">"):
            left.append(word)
            continue
        to = word[2:] if word.startswith(">>") else word[1:]
        if not to:
            to = words[next(rest)] if i + 1 < len(words) else ""
        writes |= _paths([to])
    return left, writes


def targets(command: str | None) -> Reading:
    """What a command reads and writes; empty where unclear. Redirections stand even if the command is unknown."""
    none = Reading(set(), set())
    if not command or not command.strip() or re.search(AMBIGUOUS, command):
        return none
    try:
        words, written = _redirected(shlex.split(command))
    except (ValueError, Unclear):
        return none
    if not words:
        return Reading(set(), written)
    name = re.split(r"[/\\]", words[0])[-1].lower().removesuffix(".exe")
    try:
        reads, writes = COMMANDS.get(name, _unknown)(words[1:])
    except Unclear:
        return Reading(set(), written)
    return Reading(reads, writes | written)


def _unknown(args: list[str]) -> Reading:
    raise Unclear
