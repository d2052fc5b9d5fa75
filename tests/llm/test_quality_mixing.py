import collections
import re

import fixtures
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, quality


def metrics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = collections.Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_metrics_by_brute_force(spark):
    extra = ["a b c d e a b c d e", "a b c d e", "x\nx\n x\n\n\ny", "# * $ % & | < >", "a b c d e f\x0bg\x0ca b c d e f", "😀 😀", "a b a b a b a b a b a b"]
    docs = fixtures.frame(spark).select("doc_id", "text", "n").unionByName(spark.createDataFrame([(100 + i, t, 1) for i, t in enumerate(extra)], "doc_id long, text string, n long"))
    rows = quality.measured(docs).collect()
    assert len(rows) == len(fixtures.rows()) + len(extra)
    for r in rows:
        want = metrics(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.text
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    kept = sorted(r.text for r in rows if r.kept)
    assert sorted(r.text for r in quality.keep_good(docs).collect()) == kept and kept


def test_order_is_by_rejection_per_cost_and_does_not_matter(spark):
    docs = spark.createDataFrame([(i, fixtures.prose(i, 40) if i % 2 else "short") for i in range(60)], "doc_id long, text string")
    order = quality.fit_order(docs)
    assert sorted(r.name for r in order) == sorted(r.name for r in quality.RULES)
    assert order.index(quality.RULES[0]) < 3  # cheap, and rejects half
    assert quality.measured(docs, rules=quality.RULES[::-1]).where("kept").count() == quality.measured(docs).where("kept").count() == 30
    assert quality.measured(fixtures.empty(spark)).count() == 0


def test_rules_after_a_rejection_are_not_evaluated(spark, monkeypatch):
    """A metric that raises an error where it is evaluated: only texts that reach its rule may not be there."""
    monkeypatch.setitem(quality.METRICS, "trap", lambda t: F.when(t.contains("trap"), F.raise_error(F.lit("evaluated")).cast("long")).otherwise(0))
    good, symbols = fixtures.prose(1, 40), " ".join(f"#{i}$" for i in range(40))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([good, "few words trap", fixtures.prose(3, 10) + " trap " * 60, symbols + " trap"] * 3)], "doc_id long, text string")
    trap = quality.Rule("trap", ("trap",), lambda n: n > 0)
    monkeypatch.setattr(quality, "fit_order", lambda df, text, rules, **_: (*[r for r in rules if r.name != "trap"], trap))
    assert quality.measured(docs, rules=(*quality.RULES, trap)).where("kept").count() == 3
    monkeypatch.setattr(quality, "fit_order", lambda df, text, rules, **_: (trap, *[r for r in rules if r.name != "trap"]))
    with pytest.raises(Exception, match="evaluated"):
        quality.measured(docs, rules=(*quality.RULES, trap)).where("kept").count()


def test_extra_metrics_are_not_projected(spark):
    docs = spark.createDataFrame([(i, fixtures.prose(i, 40)) for i in range(20)], "doc_id long, text string")
    plan = quality.measured(docs)._jdf.queryExecution().optimizedPlan().toString()
    top = next(x for x in plan.splitlines() if "Project" in x)
    assert "[A-Z]" in top and "CASE WHEN" in top
    assert all("[A-Z]" not in x for x in plan.splitlines() if x != top)
    assert "[A-Z]" in top[top.index("CASE WHEN") :] and "[A-Z]" not in top[: top.index("CASE WHEN")]


def test_a_text_repeated_without_end_is_sampled_row_by_row(spark):
    docs = spark.range(30_000).selectExpr("id as doc_id", "'the same text again' as text")
    assert 0 < quality._sample(docs, "text", 500).count() <= 1000
    assert quality.keep_good(docs).count() == 0


def filled(sizes, weights):
    """Targets by resharing until none is above its cap."""
    budget, caps = 1.5 * sum(sizes), [2 * s for s in sizes]
    capped = set()
    while True:
        left = budget - sum(caps[i] for i in capped)
        open_ = [i for i in range(len(sizes)) if i not in capped]
        total = sum(weights[i] for i in open_)
        share = {i: left * weights[i] / total for i in open_}
        over = {i for i in open_ if share[i] > caps[i]}
        if not over:
            return [caps[i] if i in capped else share[i] for i in range(len(sizes))]
        capped |= over


def by_quotients(votes, most, house):
    """Sainte-Lague by listing all quotients."""
    listed = sorted((-v / (2 * k + 1), i, k) for i, (v, m) in enumerate(zip(votes, most, strict=True)) for k in range(min(m, house)))[:house]
    return [sum(i == j for _, i, _ in listed) for j in range(len(votes))]


def test_apportionment_by_brute_force(spark):
    import random

    r = random.Random(4)
    cases = [([9_000_000.0] + [1000.0] * 1000, [10**6] * 1001, 1000), ([5.0, 5.0, 5.0], [9, 9, 9], 4), ([0.0, 0.0], [0, 0], 0), ([1.0] * 7, [1] * 7, 7), ([8.0, 1.0, 1.0], [3, 9, 9], 9)]
    cases += [([float(r.choice([1, 3, 50, 900])) for _ in range(n)], [r.randrange(1, 40) for _ in range(n)], r.randrange(0, 3 * n)) for n in (1, 4, 30, 60)]
    parties = [(g, i, v, m) for g, (votes, most, _) in enumerate(cases) for i, (v, m) in enumerate(zip(votes, most, strict=True))]
    houses = spark.createDataFrame([(g, min(h, sum(most))) for g, (_, most, h) in enumerate(cases)], "group int, house long")
    got = mixing.apportioned(spark.createDataFrame(parties, "group int, party int, votes double, most long").repartition(5), houses).collect()
    seats = {(x.group, x.party): x.seats for x in got}
    assert len(seats) == len(got) == len(parties)
    for g, (votes, most, house) in enumerate(cases):
        assert [seats[g, i] for i in range(len(votes))] == by_quotients(votes, most, min(house, sum(most))), g


def test_one_key_of_many_rows_is_dealt_out(spark):
    rows = [(7, "five words in each text", "hot")] * 3000 + [(i, fixtures.prose(i, 20), "b") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.mix(docs, docs_per_shard=50)
    assert got.count() == len(rows)
    by = {r.source: r for r in got.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()}
    assert all(abs(r.taken - r.target) <= 256 for r in by.values())


def test_targets_and_quotas(spark):
    rows = [(i, fixtures.prose(i, 5 + i % 90), f"src{i % 7}" if i % 11 else None) for i in range(900)] + [(900 + i, fixtures.prose(i, 60), "src0") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, block=16).toPandas()
    again = mixing.mix(docs.repartition(5), block=16).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    by = got.groupby("source", dropna=False).agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    by = by.loc[sorted([x for x in by.index if isinstance(x, str)]) + [x for x in by.index if not isinstance(x, str)]]
    want = filled(by["size"].tolist(), [(5, 2, 1)[i % 3] for i in range(len(by))])
    assert by.target.tolist() == pytest.approx(want)
    assert ((by.taken - by.target).abs() <= 16).all()
    assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()


def test_mixing_edges(spark):
    docs = fixtures.frame(spark)
    got = mixing.mix(docs)
    assert got.count() == docs.count()
    assert got.where("taken > 2 * size or taken < 0 or target is null").count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(fixtures.empty(spark)).count() == 0
    nothing = mixing.mix(docs.where("text is null or text = ''")).collect()
    assert nothing and all(r.taken == 0 and r.target == 0 for r in nothing)


def test_sources_below_half_a_block_get_their_words(spark):
    rows = [(i, fixtures.prose(i, 40), "hot") for i in range(800)]
    for k in range(40):  # a tail of 40 to 235 words a source
        rows += [(1000 + 100 * k + i, fixtures.prose(1000 + k, 5), f"tail{k:02}") for i in range(8 + k)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = mixing.mix(docs).groupBy("source").agg({"taken": "sum", "target": "max"}).toPandas().set_index("source")
    small = by[by["max(target)"] < 128]
    assert len(small) >= 5
    assert (by["sum(taken)"] >= by["max(target)"].map(int)).all()
    assert (by["sum(taken)"] <= by["max(target)"] + 128).all()
    assert {r.source for r in mixing.mixed_documents(docs).select("source").distinct().collect()} == set(by.index)
    weighted = mixing.mix(docs, share=0.3).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(int(r["max(target)"]) <= r["sum(taken)"] <= r["max(target)"] + 128 for r in weighted)
    few = {r.source: r["sum(size)"] for r in mixing.mixed_documents(docs, share=0.3).withColumn("size", mixing.word_count("text")).groupBy("source").agg({"size": "sum"}).collect()}
    assert all(abs(few.get(r.source, 0) - r["sum(taken)"]) <= 5 for r in weighted if r.source != "hot")
