"""Shell targets as expressions against a loop over the words."""

import random

from pyspark.sql import functions as F
from shell_by_hand import targets
from stridelog.functions.shell import with_shell, words_of

WORDS = [
    "a.py", "b/c", "tests", "README", "-", "--", "-n", "-n5", "-3", "7", "-i", "-i.bak", "''", '""', "-e", "s/a/b/", "-q", "-k", "-m", "--tb", "--tb=x", "--maxfail=2", "-a", "-f", "-rf", "-p", "-u", "-B", "test", "run", "pytest", "unittest", ">", ">>", ">o.txt", ">>o/p", "<", "<x.py", ">>>z.y",
    "t.py::T::m", "::x", ".", "..", "...", "a/...", ".bashrc", "..x", "x.", "a.b.", "http://x/y.py", "a\\ b.py", "'c d.py'", '"e\\"f.py"', '"g\\h.py"', "x'y'.py", "\\>", "'>'", "d.js/", "e.mjs", "/.py", "a..py", "q.PY", "é.py", "\u2028.py", "C:\\\\w\\\\x.py", "!", "#c.py", "a]b.py", "", "'open", '"open', "end\\",
]
NAMES = ["cat", "less", "head", "tail", "tee", "cp", "mv", "rm", "touch", "mkdir", "sed", "python", "python3", "py", "node", "pytest", "go", "npm", "make", "/usr/bin/CAT.exe", "C:\\\\bin\\\\Sed.EXE", "go test", "npm test --", "npm run test --", "npm run test", "python -m pytest", "py -m unittest", "'sed'", "> o.txt cat", "\t"]


def native(spark, commands):
    rows = spark.createDataFrame(list(enumerate(commands)), "n int, said string").repartition(8)
    found = with_shell(rows, F.col("said")).collect()
    return {r.n: (set(r.shell.reads), set(r.shell.writes)) if r.shell else (set(), set()) for r in found}


def test_expressions_find_what_a_loop_finds(spark):
    rng = random.Random(3)
    commands = [" ".join([rng.choice(NAMES), *rng.choices(WORDS, k=rng.randint(0, 5))]) for _ in range(30_000)]
    # the many words that rule a command out leave few clear ones: these are made of the words that its form takes
    own = {"sed": ["-i", "''", "-e", "s/a/b/", "a.py", "b/c", "-i.b"], "pytest": ["-k", "-q", "t.py::x", "tests", "--tb", "--tb=x", "--"], "head": ["-n", "5", "-n5", "-3", "a.py"], "python": ["-u", "-B", "a.py", "b/c", "x.py", "-m", "pytest"], "cp": ["a.py", "b/c"], "mv": ["a.py", "b/c"], "cat": ["a.py", ">", ">>o.t", "b/c"]}
    commands += [" ".join([name, *rng.choices(words, k=rng.randint(0, 6))]) for name, words in own.items() for _ in range(1_500)]
    commands += [None, "", "  ", "cat a.py | wc", "cat *.py", "echo $X", "cat a.py\nls", "\x0b", "cat \x0ba.py", "'", "\\"]
    got, said = native(spark, commands), [targets(c) for c in commands]
    assert [(c, got[i], tuple(t)) for i, (c, t) in enumerate(zip(commands, said)) if got[i] != tuple(t)] == []
    assert sum(bool(t.reads) for t in said) > 3_000 and sum(bool(t.writes) for t in said) > 2_000


def test_long_commands_take_linear_time(spark):
    long = ["cat " + "a/b " * 50_000, "cat '" + "x" * 500_000 + ".py'", 'cat "' + "\\\\" * 200_000 + '.py"', "cat " + "\\x" * 200_000 + ".py", "sed -i " + "-e s " * 30_000 + "f.py", "pytest " + "-k -k " * 30_000, "cat " + "a." * 200_000, "cat " + "." * 300_000, "x" * 500_000 + " a/b", "cat a.py " + "> o.txt " * 30_000, "cat 'open" + "x" * 400_000]
    got = native(spark, long)
    assert got[0] == ({"a/b"}, set()) and len(next(iter(got[1][0]))) == 500_003 and got[4] == ({"f.py"}, {"f.py"}) and got[5] == (set(), set()) and got[9] == ({"a.py"}, {"o.txt"})
    assert {i: got[i] for i in (2, 3, 6, 7, 8, 10)} == {i: tuple(targets(long[i])) for i in (2, 3, 6, 7, 8, 10)}


def test_words(spark):
    said = ["a 'b c' \"d \\\" e\" f\\ g ''", "a'b'\"c\"\\d", "", "'x", 'y"', "z\\", None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, said string").select("i", words_of(F.col("said")).alias("w")).orderBy("i").collect()
    assert [r.w for r in rows] == [["a", "b c", 'd " e', "f g", ""], ["abcd"], [], None, None, None, None]


def test_no_python_no_shuffle_and_clashing_columns(spark):
    rows = spark.createDataFrame([("cat a.py > b.py", "kept", 1)], "said string, `x.y` string, name int")
    out = with_shell(rows, F.col("said"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == ["said", "x.y", "name", "shell"] and "Python" not in plan and "Exchange" not in plan
    assert out.first().shell == (["a.py"], ["b.py"])
