import random

import pytest
from conftest import rows

from cipherledger.llm.contamination import PassageIndex, cut_stretches, item_passages, leaks, leaks_in, passages_of, redacted, without_leaks, words

random.seed(5)
VOCABULARY = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400)]


def text(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCABULARY) for _ in range(n)]


PASSAGES = [text(60, i) for i in range(6)]
ITEMS = [(i, f"Read the passage and choose the best answer.\n\n{' '.join(p).capitalize()}.\n\nQuestion: Which? (A) x") for i, p in enumerate(PASSAGES)]
ITEMS.append((6, f"Select one option.\n\n{' '.join(PASSAGES[0]).capitalize()}.\nQuestion: Other? (A) y"))
ITEMS.append((7, "Select one option.\n\n" + " ".join(text(50, 77)) + "."))


def found(spark, docs, items=ITEMS, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string, words int")
    i = spark.createDataFrame(items, "item_id long, text string")
    return rows(leaks(d, i, **how), "doc_id", "item_id")


def filler(seed, n=80):
    return " ".join(text(n, 1000 + seed))


def test_instructions_and_questions_are_no_passage():
    p = {tuple(ids): w for w, _, ids in passages_of(ITEMS)}
    assert p[(0, 6)] == [w for w in PASSAGES[0]] and len(p) == 7


def altered(part, every, how):
    out = []
    for i, w in enumerate(part):
        if i % every == every - 1:
            if how == "change":
                out.append("zzz")
            continue_ = how == "drop"
            if continue_ or how == "change":
                continue
        out.append(w)
    return out


@pytest.mark.parametrize("how", ["change", "drop"])
@pytest.mark.parametrize("at", [0, 11, 30])
def test_stretches_with_one_word_in_ten_altered_or_left_out(how, at):
    index = PassageIndex(passages_of(ITEMS))
    part = altered(PASSAGES[1][at : at + 28], 10, how)
    got = leaks_in(index, [f"{filler(1)} {' '.join(part)} {filler(2)}"])
    assert [index.items[k] for _, k, *_ in got] == [[1]]


@pytest.mark.parametrize("n,leaked", [(12, False), (19, False), (20, True), (40, True)])
def test_length_of_a_quote(n, leaked):
    index = PassageIndex(passages_of(ITEMS))
    assert bool(leaks_in(index, [f"{filler(3)} {' '.join(PASSAGES[2][5 : 5 + n])} {filler(4)}"])) == leaked


def test_every_third_word_altered_is_no_leak():
    index = PassageIndex(passages_of(ITEMS))
    assert leaks_in(index, [" ".join(altered(PASSAGES[2], 3, "change"))]) == []


def test_markup_case_and_layout(spark):
    part = PASSAGES[3][10:45]
    shown = "<p>" + "</p>\n<p>".join(" ".join(part[i : i + 7]).upper() for i in range(0, 35, 7)) + "</p>"
    starred = " ".join(f"**{w}**," for w in part)
    wrapped = "\n   ".join(part)
    assert found(spark, [(1, shown, 1), (2, starred, 1), (3, wrapped, 1), (4, "Read the passage and choose the best answer.", 1)]) == [(1, 3), (2, 3), (3, 3)]


def test_shared_passages_nulls_repeats_blocks_and_empty(spark):
    body = filler(9) + " " + " ".join(PASSAGES[0][:30])
    docs = [(1, body, 1), (1, body, 1), (2, None, 1), (3, "", 1), (None, body, 1), (4, filler(5, 30_000) + " " + " ".join(PASSAGES[4]) + " " + filler(6, 30_000), 1)]
    want = [(1, 0), (1, 6), (4, 4)]
    assert found(spark, docs) == want
    assert found(spark, docs, [*ITEMS, (None, "x"), (9, None), (10, "")], block_items=3) == want
    assert found(spark, docs, []) == [] and found(spark, []) == []


def test_brute_force_agrees_on_whole_stretches(spark):
    docs = [(i, " ".join(text(30, 50 + i) + PASSAGES[i % 6][i : i + 15 + i] + text(20, 90 + i)), 0) for i in range(24)]
    every = {i: {" ".join(p[k : k + 20]) for k in range(len(p) - 19)} for i, p in enumerate(PASSAGES)}
    every[6] = every[0]
    want = sorted(((d, i) for d, t, _ in docs for i, parts in every.items() if any(x in " ".join(words(t)) for x in parts)), key=repr)
    assert found(spark, docs) == want
    d = spark.createDataFrame(docs, "doc_id long, text string, words int")
    i = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert without_leaks(d, i).count() == len(docs) - len({x for x, _ in want})


def test_instructions_are_found_over_all_items(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {}
    for r in item_passages(items).collect():
        got.setdefault(r.passage_id, [words(r.passage), []])[1].append(r.item_id)
    assert sorted((w, sorted(ids)) for w, ids in got.values()) == sorted((w, ids) for w, _, ids in passages_of(ITEMS))


@pytest.mark.parametrize("how", [{"block_items": 1}, {"block_items": 7}, {"block_items": 20_000}, {"block_bytes": 500}])
def test_blocks_never_change_the_result(spark, how):
    told = "Consider the following text with care and then decide which one of the four answers given below it fits best of all in your view."
    items = [(100 + i, f"{told} {' '.join(text(40, 300 + i))}. Question: x") for i in range(2)] + ITEMS
    docs = [(1, filler(1) + " " + told + " " + filler(2), 1), (2, filler(3) + " " + " ".join(text(40, 300)) + " " + filler(4), 1), (3, " ".join(PASSAGES[0]), 1)]
    many = [(20 + i, f"{told} {' '.join(text(40, 400 + i))}.") for i in range(4)]
    assert found(spark, docs, [*items, *many], **how) == [(2, 100), (3, 0), (3, 6)]


def test_stretches_are_cut_out_and_the_rest_stays(spark):
    index = PassageIndex(passages_of(ITEMS))
    part = " ".join(f"**{w.upper()}**" for w in PASSAGES[1][5:40])
    assert cut_stretches(index, f"Before it, {part} and after.") == ("Before it, **** and after.", 1, 35)
    twice = f"One {' '.join(PASSAGES[1][:25])} two, {' '.join(PASSAGES[1][:25])} three {' '.join(PASSAGES[2][20:50])}."
    assert cut_stretches(index, twice) == ("One  two,  three .", 3, 80)
    assert cut_stretches(index, "Nothing here.") == ("Nothing here.", 0, 0)
    docs = spark.createDataFrame([(1, twice, 1), (2, "Nothing here.", 1), (3, None, 1), (None, twice, 1)], "doc_id long, text string, words int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for how in ({}, {"block_items": 2}):
        assert rows(redacted(docs, items, **how), "doc_id", "text", "stretches", "words_removed") == [(1, "One  two,  three .", 3, 80), (2, "Nothing here.", 0, 0)]
    assert redacted(docs.limit(0), items).count() == 0
