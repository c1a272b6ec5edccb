"""A shell command made up for every event, and what SQL says that it reads and writes.

The query sees the commands only; their files stand beside them for the SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shell import with_shell

#: Command, files read, files written. {f} and {g}: files of the event's number; {w}: a word of it.
COMMANDS = [
    ("cat {f} {g}", "{f} {g}", ""), ("less {f}", "{f}", ""), ("cat -n {f}", "", ""), ("cat {f} {w}", "", ""), ("cat {f} | wc", "", ""), ("cat < {f}", "", ""), ("cat src/*.py", "", ""),
    ("head -n 5 {f}", "{f}", ""), ("head -n5 -2 {f}", "{f}", ""), ("tail -3 {f} {g}", "{f} {g}", ""), ("tail {f} -n", "", ""), ("head -n -3 5 {f}", "", ""),
    ("tee -a {f}", "", "{f}"), ("tee {f} {g}", "", "{f} {g}"), ("tee -i {f}", "", ""), ("cp {f} {g}", "{f}", "{g}"), ("cp -r {f} {g}", "", ""), ("mv {f} {g}", "{f}", "{f} {g}"), ("mv {f}", "", ""),
    ("rm -rf {f} {g}", "", "{f} {g}"), ("rm -i {f}", "", ""), ("touch {f}", "", "{f}"), ("touch -c {f}", "", ""), ("mkdir -p lib/{w}", "", "lib/{w}"), ("mkdir {w}", "", ""),
    ("sed -i s/a/b/ {f}", "{f}", "{f}"), ("sed s/a/b/ {f}", "", ""), ("sed -i '' -e s/a/b/ {f} {g}", "{f} {g}", "{f} {g}"), ("sed -i s/a/b/ -e s/c/d/ {f}", "{f}", "{f}"), ("sed -i.bak s/a/b/ {f} > out/log", "{f}", "out/log {f}"), ("sed -n p {f}", "", ""), ("sed -i {f}", "", ""),
    ("python -u {f} arg", "{f}", ""), ("python3 {w}", "", ""), ("python -c 1", "", ""), ("py -m unittest {f} -v", "{f}", ""), ("python -m pytest tests -k {w}", "tests", ""), ("node lib/{w}.mjs x", "lib/{w}.mjs", ""), ("node {f}", "", ""),
    ("pytest {f}::test_{w} -q --tb=short", "{f}", ""), ("pytest --maxfail", "", ""), ("pytest -k -k {f}", "{f}", ""), ("go test ./pkg/{w} -v", "./pkg/{w}", ""), ("go build ./pkg/{w}", "", ""), ("npm test -- {f}", "{f}", ""), ("npm run test -- {f} {g}", "{f} {g}", ""), ("npm run test {f}", "", ""), ("npm install {f}", "", ""),
    ("make all > out/{w}.txt", "", "out/{w}.txt"), ("make >>{f} > {g}", "", "{f} {g}"), ("make > {w}", "", ""), ("curl http://x/{w}.py > {f}", "", "{f}"), ("/usr/bin/CAT.exe \"lib/a {w}.py\"", "lib/a {w}.py", ""), ("cat '{f}", "", ""), ("cat lib/a\\ {w}.py", "lib/a {w}.py", ""), ("cat {f} 2 >", "", ""), ("cat http://x/{w}.py", "", ""), ("echo $HOME {f}", "", ""),
]


def _number() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def shell_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each event's command reads and writes, as words joined by spaces."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", _number().alias("k"))
    texts = F.array(*[F.lit(c) for c, _, _ in COMMANDS])
    said = F.get(texts, (F.col("event_id") % len(COMMANDS)).cast("int"))
    for name, put in (("{f}", F.format_string("src/f%d.py", F.col("k") % 5)), ("{g}", F.format_string("src/g%d.py", F.col("k") % 7)), ("{w}", F.format_string("w%d", F.col("k")))):
        said = F.replace(said, F.lit(name), put)
    found = with_shell(events.select("event_id", said.alias("command")), F.col("command"))
    return found.select("event_id", "command", *[F.coalesce(F.array_join(f"shell.{c}", " "), F.lit("")).alias(c) for c in ("reads", "writes")])


def _put(column: str) -> str:
    return f"replace(replace(replace({column}, '{{f}}', 'src/f' || k % 5 || '.py'), '{{g}}', 'src/g' || k % 7 || '.py'), '{{w}}', 'w' || k)"


_ROWS = ", ".join(f"({n}, '{c.replace(chr(39), chr(39) * 2)}', '{r}', '{w}')" for n, (c, r, w) in enumerate(COMMANDS))
SHELL_FORMS_SQL = f"""SELECT event_id, {_put("command")} AS command, {_put("reads")} AS reads, {_put("writes")} AS writes
 FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e JOIN (VALUES {_ROWS}) AS c(n, command, reads, writes) ON event_id % {len(COMMANDS)} = n"""
