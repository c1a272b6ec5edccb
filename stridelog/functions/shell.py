"""Files that a literal shell command surely reads and writes, as expressions.

A command that could mean more than it says (pipes, expansion, several commands)
has no targets. Words are split as a POSIX shell would. Every argument then becomes
one letter, so a command's grammar is a regular expression over its letters, and an
option takes its value by a replacement in them. A command takes time linear in its length.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that make a command or a path ambiguous.
AMBIGUOUS = r"[|&;\n\r$`*?\[{}~]"
_NOT_PATH = r"[$`*?\[\]{}~|;&<>]|://"
#: Flags of test runners, without and with a value.
TEST_FLAGS, TEST_VALUES = ("-q", "-s", "-v", "-x", "--quiet", "--verbose"), ("-k", "-m", "--maxfail", "--tb")

#: Pieces of a word, each possessive: nothing is tried twice and nothing recurses.
_PLAIN, _SINGLE, _DOUBLE, _ESCAPED = r"""[^ \t\r\n'"\\]++""", r"'[^']*+'", r'"(?:[^"\\]++|\\.)*+"', r"\\."
_PIECE = rf"{_PLAIN}|{_SINGLE}|{_DOUBLE}|{_ESCAPED}"
_WORD, _BLANK = f"(?:{_PIECE})++", r"[ \t\r\n]*+"


def words_of(command: Column) -> Column:
    """The words of a command, quotes and escapes resolved; null where a quote or an escape does not end."""

    def said(p: Column) -> Column:
        inner = F.substring(p, F.lit(2), F.length(p) - 2)
        return F.when(p.startswith("'"), inner).when(p.startswith('"'), F.regexp_replace(inner, r'\\(["\\])', "$1")).when(p.startswith("\\"), F.substring(p, F.lit(2), F.lit(2))).otherwise(p)

    whole = command.rlike(rf"(?s)\A{_BLANK}(?:{_WORD}{_BLANK})*+\z")
    raw = F.regexp_extract_all(command, F.lit(f"(?s){_WORD}"), F.lit(0))
    return F.when(whole, F.transform(raw, lambda w: F.when(w.rlike(r"""['"\\]"""), F.array_join(F.transform(F.regexp_extract_all(w, F.lit(f"(?s){_PIECE}"), F.lit(0)), said), "")).otherwise(w)))


def is_path(word: Column, bare_tests: bool = False) -> Column:
    """A literal path: it has a directory or a suffix, and nothing to expand."""
    named = r"(?s)[/\\]|\A\.*+[^.].*\.[^.]+\z" + (r"|\Atests?\z" if bare_tests else "")
    return ~word.rlike(rf"(?s)\A-|\A\.{{0,2}}\z|[/\\]\.\.\.\z|{_NOT_PATH}") & word.rlike(named)


def _script(suffixes: str) -> Callable[[Column], Column]:
    """A literal path of a script, by its last part's suffix."""
    return lambda word: is_path(word) & word.rlike(rf"(?s)(?:\A|[/\\])\.*+[^./\\][^/\\]*\.(?:{suffixes})[/\\]*\z")


class Form(NamedTuple):
    """How commands of one form take their arguments."""

    names: tuple[str, ...]
    #: a letter for each argument that matches, first wins; then w for an operand, x for anything else
    letters: tuple[tuple[str, str], ...] = ()
    #: letters replaced in this order: options take their values, and only operands stay w
    rewrites: tuple[tuple[str, str], ...] = ()
    #: what the letters of a clear command are then
    grammar: str = r"[fw]*+"
    operand: Callable[[Column], Column] = is_path
    reads: bool = False
    writes: bool = False


def _any(words: tuple[str, ...]) -> str:
    return rf"\A(?:{'|'.join(words)})\z"


_PYTHON = ("python", "python3", "py")
FORMS = {
    "tests": Form((), (("f", rf"\A--\z|{_any(TEST_FLAGS)}|\A(?:{'|'.join(TEST_VALUES)})="), ("v", _any(TEST_VALUES))), (("v.", "ff"),), operand=lambda w: is_path(F.substring_index(w, "::", 1), True), reads=True),
    "read": Form(("cat", "less"), grammar=r"w*+", reads=True),
    "ends": Form(("head", "tail"), (("n", r"\A-n\z"), ("d", r"\A\p{Nd}+\z"), ("c", r"\A-n?\p{Nd}+\z")), grammar=r"(?:nd|[cw])*+", reads=True),
    "tee": Form(("tee",), (("f", r"\A-a\z"),), writes=True),
    "remove": Form(("rm",), (("f", r"\A-(?:[frR]|rf|fr|Rf|fR)\z"),), writes=True),
    "touch": Form(("touch",), grammar=r"w*+", writes=True),
    "folder": Form(("mkdir",), (("f", r"\A-p\z"),), writes=True),
    "copy": Form(("cp",), grammar="ww", reads=True, writes=True),
    "move": Form(("mv",), grammar="ww", reads=True, writes=True),
    # an empty word after -i is its suffix; the first operand is the script unless -e gives one before it; only in place are files written
    "sed": Form(
        ("sed",), (("i", r"\A-i\z"), ("I", r"(?s)\A-i."), ("e", r"\A-e\z"), ("E", r"\A\z"), ("-", r"\A-")), (("e.", "ss"), ("iE", "ii"), (r"\A([iI]*+)[wxE]", "$1s")),
        r"(?=[^iI]*+[iI])[iIsw]*+", reads=True, writes=True,
    ),
    "python": Form(_PYTHON, (("u", r"\A-[uB]\z"),), grammar=r"u*+w.*+", operand=_script("py"), reads=True),
    "node": Form(("node",), grammar=r"w.*+", operand=_script("js|mjs|cjs"), reads=True),
}
#: Of these the first operand counts, whatever follows it.
_FIRST = ("python", "node")


def _form(name: Column, args: Column) -> Column:
    """The form of a command and how many arguments come before those that it is about."""
    at = lambda i: F.get(args, F.lit(i))
    pair = lambda form, skip: F.struct(F.lit(form).alias("form"), F.lit(skip).alias("skip"))
    run = (at(0) == "run") & (at(1) == "test")
    found = (
        F.when(name == "pytest", pair("tests", 0)).when((name == "go") & (at(0) == "test"), pair("tests", 1))
        .when(name.isin(*_PYTHON) & (at(0) == "-m") & at(1).isin("pytest", "unittest"), pair("tests", 2))
        .when((name == "npm") & (at(0) == "test") & (at(1) == "--"), pair("tests", 2)).when((name == "npm") & run & (at(2) == "--"), pair("tests", 3))
    )
    for form, f in FORMS.items():
        found = found.when(name.isin(*f.names), pair(form, 0)) if f.names else found
    return found


def _letters(f: Form, args: Column) -> Column:
    def letter(word: Column) -> Column:
        out = F.when(F.lit(False), "")
        for mark, pattern in f.letters:
            out = out.when(word.rlike(pattern), mark)
        return out.when(f.operand(word), "w").otherwise("x")

    return F.array_join(F.transform(args, letter), "")


def _by_form(value: Callable[[str, Form], Column]) -> Column:
    out = F.when(F.lit(False), None)
    for name, f in FORMS.items():
        out = out.when(F.col("shell form.form") == name, value(name, f))
    return out


def _operands(name: str, f: Form) -> Column:
    """The arguments that are operands, where the letters say that the command is clear."""
    said = F.col("shell letters")
    for pattern, by in f.rewrites:
        said = F.regexp_replace(said, pattern, by)
    clear = said.rlike(rf"\A(?:{f.grammar})\z")
    each = F.filter(F.arrays_zip(F.col("shell args").alias("word"), F.split(said, "").alias("letter")), lambda z: z["letter"] == "w")
    words = F.transform(each, lambda z: F.substring_index(z["word"], "::", 1) if name == "tests" else z["word"])
    return F.when(clear, F.slice(words, 1, 1) if name in _FIRST else words)


def _sorted(words: Column) -> Column:
    return F.array_sort(F.array_distinct(words))


def with_shell(rows: DataFrame, command: Column) -> DataFrame:
    """Adds ``shell``: struct of reads and writes of a command, null where there are none. Redirections stand even if the command is unknown."""
    none, words = F.array().cast("array<string>"), F.col("shell words")
    kept = rows.columns
    # between these steps the plan keeps what is read twice; nothing inside a lambda refers to a column
    rows = rows.withColumn("shell words", words_of(F.when(~command.rlike(AMBIGUOUS), command)))
    pairs = F.arrays_zip(words.alias("word"), F.concat(F.array(F.lit("")), words).alias("before"))
    bare = lambda w: w.isin(">", ">>")
    to = F.transform(F.filter(F.arrays_zip(words.alias("word"), F.concat(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), F.array(F.lit(""))).alias("next")), lambda z: z["word"].startswith(">")), lambda z: F.when(bare(z["word"]), z["next"]).otherwise(F.regexp_replace(z["word"], r"\A>>?", "")))
    rows = rows.withColumns({"shell to": to, "shell left": F.transform(F.filter(pairs, lambda z: z["word"].isNotNull() & ~z["word"].startswith(">") & ~bare(z["before"])), lambda z: z["word"])})
    plain = ~F.exists(words, lambda w: w.startswith("<")) & F.forall("shell to", lambda w: is_path(w))
    rows = rows.withColumn("shell left", F.when(plain, F.col("shell left")))
    name = F.regexp_replace(F.lower(F.substring_index(F.translate(F.get("shell left", F.lit(0)), "\\", "/"), "/", -1)), r"\.exe\z", "")
    rows = rows.withColumns({"shell name": name, "shell rest": F.slice("shell left", F.lit(2), F.size("shell left"))})
    rows = rows.withColumn("shell form", _form(F.col("shell name"), F.col("shell rest")))
    rows = rows.withColumn("shell args", F.slice("shell rest", F.col("shell form.skip") + 1, F.size("shell rest")))
    rows = rows.withColumn("shell letters", _by_form(lambda _, f: _letters(f, F.col("shell args"))))
    rows = rows.withColumn("shell operands", _by_form(_operands))
    own, form = F.col("shell operands"), F.col("shell form.form")
    files = lambda does: F.when(form.isin(*[n for n, f in FORMS.items() if getattr(f, does)]), own)
    reads = F.when(form.isin("copy", "move"), F.slice(own, 1, 1)).otherwise(files("reads"))
    writes = F.when(form == "copy", F.slice(own, 2, 1)).otherwise(files("writes"))
    written = F.when(F.col("shell left").isNotNull(), F.col("shell to"))
    rows = rows.withColumns({"shell reads": _sorted(F.coalesce(reads, none)), "shell writes": _sorted(F.concat(F.coalesce(writes, none), F.coalesce(written, none)))})
    found = F.when((F.size("shell reads") > 0) | (F.size("shell writes") > 0), F.struct(F.col("shell reads").alias("reads"), F.col("shell writes").alias("writes")))
    # one row each: a filter on what was found does not pass this, else the plan would repeat every step above inside it
    return rows.withColumn("shell", F.explode_outer(F.array(found))).select(*[F.col(f"`{c}`") for c in kept], "shell")


def with_targets(activities: DataFrame) -> DataFrame:
    """Adds ``shell``: struct of reads and writes for shell and test steps, null where there are none.

    Recorded runs repeat their commands, so each distinct one is read once; what is ambiguous for sure meets no shuffle.
    """
    shell = F.col("kind").isin("opaque_shell", "test_run") & F.col("command").isNotNull()
    plain = activities.where(shell & ~F.col("command").rlike(AMBIGUOUS)).select(F.col("command").alias("said")).distinct()
    return activities.join(with_shell(plain, F.col("said")).where("shell IS NOT NULL"), shell & (F.col("command") == F.col("said")), "left").drop("said")


__all__ = ["FORMS", "Form", "is_path", "with_shell", "with_targets", "words_of"]
