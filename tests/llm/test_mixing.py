import pytest
from conftest import rows

from cipherledger.llm.mixing import mix_sources, mixture_report, running_total, token_counts
from pyspark.sql import functions as F

TARGET = "source string, target_share double, max_repeats int"


def documents(spark, **sizes):
    data = [(i * 100 + n, "word " * (5 + n % 7), s, 3) for i, (s, k) in enumerate(sizes.items()) for n in range(k)]
    return spark.createDataFrame([*data, (9001, None, "a", 1), (9002, "", "a", 1), (9003, "lost words", None, 1)], "doc_id long, text string, source string, tokens int")


def targets(spark, *rows_):
    return spark.createDataFrame(list(rows_), TARGET)


def test_shares_are_reached_and_repeats_capped(spark):
    d = documents(spark, a=90, b=30, c=10)
    t = targets(spark, ("a", 0.5, 2), ("b", 0.3, 2), ("c", 0.18, 3), ("ghost", 0.02, 4), ("b", 0.3, 2))
    got = {r.source: r for r in mixture_report(d, t).collect()}
    assert got["ghost"].tokens == 0 and set(got) == {"a", "b", "c", "ghost"}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.18)):
        assert abs(got[s].reached_share - share / 0.98) < 0.03 and got[s].most_copies <= {"a": 2, "b": 2, "c": 3}[s]


def test_selection_is_a_prefix_of_the_virtual_finish_order_within_budget(spark):
    d = documents(spark, a=60, b=40)
    selection, _, _ = mix_sources(d, targets(spark, ("a", 0.75, 1), ("b", 0.25, 3)), budget=300)
    got = sorted((r.position, r.finish, r.tokens) for r in selection.collect())
    assert [f for _, f, _ in got] == sorted(f for _, f, _ in got)
    total = 0
    for position, _, tokens in got:
        total += tokens
        assert position == total
    assert 290 <= total <= 300
    assert rows(selection.filter("source = 'a'").groupBy("doc_id").count().filter("count > 1"), "doc_id") == []


def test_a_source_that_runs_out_leaves_its_place(spark):
    d = documents(spark, a=50, b=2)
    selection, _, _ = mix_sources(d, targets(spark, ("a", 0.5, 1), ("b", 0.5, 1)), budget=10_000)
    every = token_counts(d).filter("tokens > 0 and source is not null")
    assert selection.agg(F.sum("tokens")).first()[0] == every.agg(F.sum("tokens")).first()[0]


@pytest.mark.parametrize("share,repeats", [(0.0, 3), (None, 3), (0.5, 0), (-1.0, 2)])
def test_no_share_or_no_repeats(spark, share, repeats):
    selection, _, _ = mix_sources(documents(spark, a=5), targets(spark, ("a", share, repeats)))
    assert selection.count() == 0


def test_empty_tables(spark):
    d = documents(spark)
    assert mixture_report(d.limit(0), targets(spark, ("a", 1.0, 1))).first().tokens == 0
    assert mixture_report(d, targets(spark)).count() == 0


def test_token_counts_of_whole_texts(spark):
    long = "harbour ledger " * 40_000
    got = dict(rows(token_counts(spark.createDataFrame([(1, long, "s"), (2, None, "s"), (3, "", "s"), (4, "<|endoftext|>", "s")], "doc_id long, text string, source string")), "doc_id", "tokens"))
    assert got[1] > 80_000 and got[2] == got[3] == 0 and got[4] > 1


def test_running_total_over_buckets(spark):
    df = spark.range(200).select((F.col("id") % 2).alias("k"), "id", (F.col("id") % 5 + 1).alias("v"))
    out = running_total(df, ["k"], F.floor(F.col("id") / 17), [F.col("id")], "v", "total")
    for k in (0, 1):
        total = 0
        for r in sorted(out.filter(F.col("k") == k).collect(), key=lambda r: r.id):
            total += r.v
            assert r.total == total
