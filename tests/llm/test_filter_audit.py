"""Filter interactions against a loop over all orders, on odd rows and on the smallest table."""

import re
from itertools import permutations

import duckdb
import pytest

from stridelog.llm import filter_audit
from stridelog.llm.queries import SQL

WORDY = " ".join(f"w{i}" for i in range(120))
DOCS = [
    (1, WORDY, "en"), (2, WORDY, "de"), (3, "A" * 50, "en"), (4, "A" * 50, "en"), (5, None, None), (6, "", ""), (7, "a #1 " * 200, "en"), (None, WORDY, "en"), (None, WORDY, "en"),
    (8, WORDY + " $", "de"), (9, "same " * 150, "de"), (9, "same " * 150, "de"), (10, "same " * 150, "xx"), (11, "ÉÉ 　x", "en"), (12, WORDY + "\x00", "en"), (13, "A b\v" * 99, "fr"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, 0), (9, 1, 1), (10, 0, 1), (99, 1, 1), (None, 1, 1), (6, None, 1), (12, 1, 0)]


def brute(docs, labels):
    text_of = [(i, t or "", p or "") for i, t, p in docs]
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    facts = []
    for i, t, part in text_of:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and u == t for j, u, _ in text_of)
        facts.append((part, {x for x in fails if fails[x]}, i in good, i in toxic))
    out, removed_of = [], {}
    for part in {f[0] for f in facts}:
        for order in permutations("ABCDE"):
            for step, x in enumerate(order, 1):
                earlier = set(order[: step - 1])
                mine = [f for f in facts if f[0] == part]
                here = [f for f in mine if x in f[1] and not earlier & f[1]]
                removed_of[part, x] = removed_of.get((part, x), 0) + len(here)
                out.append((part, "".join(order), step, sum(not (earlier | {x}) & f[1] for f in mine), len(here), sum(x in f[1] and bool(earlier & f[1]) for f in mine), sum(f[1] == {x} for f in mine), sum(f[2] for f in here), sum(f[3] for f in here)))
    return sorted((*r, removed_of[r[0], r[1][r[2] - 1]]) for r in out)


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
#: Extra columns have names that the operator uses.
SCHEMA = "doc_id long, text string, lang string, own string, part int, mask string, digest string, n string"


def frames(spark, docs, labels):
    return spark.createDataFrame([(*d, "x", 1, "y", "z", "w") for d in docs], SCHEMA), spark.createDataFrame([(*x, "x", "y") for x in labels], "doc_id long, quality int, toxic_ int, known string, own string").withColumnRenamed("toxic_", "toxic")


def audit(docs, labels):
    found = filter_audit.interactions(filter_audit.mask_cells(docs, labels))
    return sorted(tuple(r) for r in found.select(*COLUMNS).collect())


def test_odd_rows(spark):
    assert audit(*frames(spark, DOCS, LABELS)) == brute(DOCS, LABELS)


def test_shared_copies_in_any_partitioning(spark):
    rows = [(i, "A" * (i % 3), ["en", "de"][i % 2]) for i in range(600)]
    docs, labels = frames(spark, rows, [(i, i % 2, int(i % 5 == 0)) for i in range(0, 600, 3)])
    assert audit(docs.repartition(7), labels) == brute(rows, [(i, i % 2, int(i % 5 == 0)) for i in range(0, 600, 3)])


def test_empty(spark):
    docs, labels = frames(spark, DOCS[:1], LABELS[:1])
    assert audit(docs.where("false"), labels) == []
    assert audit(docs, labels.where("false")) == brute(DOCS[:1], [])


def test_the_row_limit_is_put_back(spark):
    before = spark.conf.get(filter_audit.ROW_LIMIT)
    audit(*frames(spark, DOCS[:1], LABELS[:1]))
    assert spark.conf.get(filter_audit.ROW_LIMIT) == before


def test_query(spark, data):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS FROM '{data}/{t}.parquet'")
    got = filter_audit.op11_filter_audit(spark, data)
    want = con.sql(SQL["op11_filter_audit"])
    assert set(got.columns) == set(want.columns)
    assert sorted(tuple(r) for r in got.select(*COLUMNS).collect()) == sorted(want.select(*COLUMNS).fetchall())
    assert dict(got.dtypes)["step"] == "int"


@pytest.mark.parametrize("letters", ["A", "AB"])
def test_fewer_letters(spark, letters):
    cells = spark.createDataFrame([("p", 0, 5, 1, 1), ("p", 1, 3, 2, 0), ("p", 3, 1, 0, 1)], "part string, mask int, n long, good long, toxic long")
    found = filter_audit.interactions(cells, letters).collect()
    assert len(found) == (1 if letters == "A" else 4)
    assert {r["kept"] for r in found if r["step"] == len(letters)} == {5}
