import importlib

import corpus_pipeline
from cinderlake.llm.common import Scratch, table
from cinderlake.llm.decontaminate import contamination
from cinderlake.llm.mixing import mix
from cinderlake.llm.quality import score, trained

from .test_decontaminate import brute as brute_leaks
from .test_jaccard_join import brute as brute_classes

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    columns, steps = docs.columns, dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "shard"]

    good = steps["quality"](spark, docs, SF)
    scores = {r.doc_id: r.score for r in score(docs, trained(docs, table(spark, SF, "labels"))).collect()}
    assert good.columns == columns and ids(good) == sorted(i for i, s in scores.items() if s >= 0.3)
    good = good.cache()

    single = steps["near_duplicates"](spark, good, SF)
    classes = brute_classes([(r.doc_id, r.text) for r in good.collect()])
    assert single.columns == columns and ids(single) == sorted(i for i, c in classes.items() if c[1] == i)
    single = single.cache()

    clean = steps["decontaminate"](spark, single, SF)
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    leaks = {d for d, _, _ in brute_leaks([(r.doc_id, r.text) for r in single.collect()], items)}
    assert clean.columns == columns and ids(clean) == [i for i in ids(single) if i not in leaks]

    mixed = steps["mix"](spark, clean, SF)
    assert mixed.columns == columns and ids(mixed) == ids(clean)

    sharded = steps["shard"](spark, mixed, SF)
    assert sharded.columns == [*columns, "shard", "slot"] and ids(sharded) == ids(clean)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() and out.groupBy("shard", "slot").count().filter("count > 1").count() == 0
    assert contamination(out, table(spark, SF, "benchmark")).count() == 0


def test_registered():
    names = importlib.import_module("__spark_entry__").queries()
    assert {"pipeline", *(f"op{n}" for n in range(1, 11))} <= {n.split("_")[0] for n in names}


def staged(spark, docs, sf_dir, names):
    """Stages as ``run`` takes them: each result is written and read again."""
    scratch, steps = Scratch(spark, "test-stages"), dict(corpus_pipeline.STAGES)
    for name in names:
        docs = scratch.keep(steps[name](spark, docs, sf_dir), name)
    return docs


def test_a_shards_slots_follow_the_mix(spark):
    """Prefixes of each shard hold the sources by weight, not by their share of the documents; without the mix they do not."""
    rows = [(i, f"{s} {i} " + "words " * 8, s) for s, lo, n in (("a", 0, 6400), ("b", 6400, 1600), (None, 8000, 400)) for i in range(lo, lo + n)]
    docs = spark.createDataFrame([*rows, (None, None, "b"), (5, rows[5][1], "a"), (5, rows[5][1], "b")], "doc_id long, text string, source string")
    at = {}
    for r in sorted(mix(docs).collect(), key=lambda r: (r.slot, r.place)):
        at.setdefault((r.doc_id, r.source), []).append((r.slot, r.place))

    def shards_of(names):
        shards = {}
        for r in staged(spark, docs, SF, names).collect():
            shards.setdefault(r.shard, []).append(r)
        for one in shards.values():
            one.sort(key=lambda r: r.slot)
            assert [r.slot for r in one] == list(range(len(one)))
        assert sum(map(len, shards.values())) == len(rows) + 3 and len(shards) == 8
        return shards.values()

    def worst(shards):
        return max(abs(sum(r.source == s for r in one[:n]) / n - size[s] ** 0.5 / total) for one in shards for n in (150, 250) for s in size)

    mixed = shards_of(["mix", "shard"])
    size = {s: sum(len(r.text or "") + 1 for one in mixed for r in one if r.source == s) for s in ("a", "b", None)}
    total = sum(v**0.5 for v in size.values())
    for one in mixed:
        assert all(min(at[a.doc_id, a.source]) <= max(at[b.doc_id, b.source]) for a, b in zip(one, one[1:], strict=False))
    assert worst(mixed) < 0.12 < 0.3 < worst(shards_of(["shard"]))


def test_edges_through_all_stages(spark, tmp_path):
    """Null ids and texts, repeated rows, a very long text, columns with the operators' own names; then an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars int, score double, slot string, shard string, fp_a int, size int, crate int, at int, block int"
    good = "The committee met on Tuesday and agreed that the old bridge should be repaired before the winter"
    more = (None, 0.5, "s", "t", 1, 2, 3, 4, 5)
    rows = [(1, good, "en", "a", *more[:1], *more[1:]), (1, good, "en", "a", *more), (2, good, "en", None, *more), (None, good, None, "b", *more), (None, None, None, None, *more), (3, "", "en", "a", *more), (4, None, "en", "b", *more)]
    rows += [(5, " ".join(f"{w} {k}" for k in range(40_000) for w in good.split()[:5]), "en", "a", *more)]
    docs = spark.createDataFrame(rows, schema)
    for name in ("labels", "benchmark"):
        table(spark, SF, name).write.parquet(f"{tmp_path}/{name}.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    for frame in (docs, docs.limit(0)):
        now = frame
        for name in names[:-1]:
            now = staged(spark, now, str(tmp_path), [name])
            assert now.columns == frame.columns
        out = staged(spark, now, str(tmp_path), ["shard"])
        assert sorted(out.columns) == sorted(frame.columns) and out.count() == now.count()
        assert out.groupBy("shard", "slot").count().filter("count > 1").count() == 0
    kept = staged(spark, docs, str(tmp_path), ["near_duplicates"]).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 1, 3, 5] and sum(r.doc_id is None for r in kept) == 2
