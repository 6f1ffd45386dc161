import random

import pyarrow.parquet as pq

from cinderlake.llm.line_dedup import LineRuns, dedup_lines, sorted_scans

SCHEMA = "doc_id long, text string, owner int, high string, lines int"
BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows):
    first = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            first[key(line)] = min(first.get(key(line), 1 << 70), 1 << 63 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or first[key(x)] == (1 << 63 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x", 1) for i, t in rows], SCHEMA)


def test_random_lines_with_compaction(spark):
    rng = random.Random(3)
    pool = [f"  Line number {k} of the pool\t" for k in range(40)] + ["short", "", "ÉÉÉÉ école ÉÉÉ", "line NUMBER 3 of the pool"]
    rows = [(i * 3, "\n".join(rng.choice(pool) for _ in range(rng.randrange(9)))) for i in range(80)]
    rows += [(500, None), (501, ""), (None, "Line number 1 of the pool\nonly with the null id"), (3, "only in the second row of id 3\nshort")]
    rows += [(600, "\n".join(f"a line that is repeated {k % 50}" for k in range(4000))), (601, "\n".join(f"A LINE that is repeated {k % 70}" for k in range(4000)))]
    assert result(dedup_lines(frame(spark, rows), batches=5, fanout=2)) == brute(rows)
    assert result(dedup_lines(frame(spark, rows), batches=1)) == brute(rows)


def test_empty_table(spark):
    assert dedup_lines(frame(spark, [])).count() == 0


def test_runs_are_compacted(spark):
    runs = LineRuns(spark, buckets=3, fanout=2)
    for k in range(4):
        runs.add(frame(spark, [(k, "\n".join([f"a line for batch {k}, number {n}" for n in range(200)] + ["the common line of all"]))]))
        for name in runs.runs:  # one file a bucket, each sorted
            files = [f.removeprefix("file:").removeprefix("//") for f in spark.table(name).inputFiles()]
            assert len(files) == 3
            for f in files:
                held = pq.read_table(f).to_pydict()
                assert list(zip(held["high"], held["low"], strict=True)) == sorted(zip(held["high"], held["low"], strict=True))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    assert spark.table(runs.runs[0]).count() == 801
    assert {r.owner: r["count"] for r in spark.table(runs.runs[0]).groupBy("owner").count().collect()} == {0: 201, 1: 200, 2: 200, 3: 200}


def test_runs_are_merged_as_they_lie(spark):
    """Neither an anti-join nor a compaction shuffles or sorts a run."""
    runs = LineRuns(spark, buckets=3, fanout=9)
    for k in range(2):
        runs.add(frame(spark, [(k, f"a line for batch {k}\nand the common line of all")]))
    with sorted_scans(spark):
        plans = [runs._merged(*runs.runs), runs._unseen(spark.table(runs.runs[0]))]
        plans = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
    assert all("SortMergeJoin" in p and "Exchange" not in p and "Sort [" not in p and "Bucketed: true" in p for p in plans), plans


def test_nothing_stays_in_the_catalog(spark):
    before = {t.name for t in spark.catalog.listTables()}
    out = dedup_lines(frame(spark, [(1, "one long line here"), (2, "one long line here\nand another one")]))
    assert {t.name for t in spark.catalog.listTables()} == before and out.count() == 2
