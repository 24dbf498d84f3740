"""What must not grow faster than the tables: broadcasts, texts read twice, Python's memory."""

import datetime as dt
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F


from docsieve.functions import vocabulary
from docsieve.operators import addresses, issuers, joins, keywords, reident, similarity, spans, structure
from docsieve.plans import catalogue


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_calendar_is_never_broadcast(spark):
    docs = spark.createDataFrame([(1, dt.date(2024, 1, 10), "Blue Rail"), (2, None, "Blue Rail")], "doc_id long, document_date date, text string")
    calendar = spark.createDataFrame([(7, dt.date(2024, 1, 12)), (7, dt.date(2024, 1, 12)), (7, dt.date(2024, 1, 11)), (7, None), (8, None)], "issuer_id long, announced_on date")
    out = issuers.blackouts(docs, spark.createDataFrame([(7, "Blue Rail Ltd")], "issuer_id long, name string"), calendar)
    assert "strategy=merge" in _plan(out)
    assert [(r["doc_id"], r["announced_on"], r["days_left"], r["intent"]) for r in out.collect()] == [(1, dt.date(2024, 1, 11), 1, False)]


def _found(spark, rows):
    return spark.createDataFrame([(i, r, "PII", "low", 25.0, s, e, "x") for i, r, s, e in rows], "doc_id long, rule string, category string, severity string, score double, start_char int, end_char int, matched_text string")


def test_spans_are_made_once_for_joins_with_their_own_document(spark):
    found = _found(spark, [(1, "weak", 300, 305), (1, "t", 0, 100), (2, "weak", 300, 305), (2, "t", 0, 99), (None, "weak", 0, 5), (None, "t", 0, 5), (3, "weak", 5, 6)])
    lifted = joins.amplified(found, ["weak"], ["t"])
    assert sorted((r["doc_id"] or 0, r["severity"], r["score"]) for r in lifted.where("rule = 'weak'").collect()) == [(0, "low", 25.0), (1, "medium", 55.0), (2, "low", 25.0), (3, "low", 25.0)]
    left = joins.outside(found, "weak", ["t"])
    assert sorted((r["doc_id"] or 0, r["rule"]) for r in left.collect()) == [(0, "t"), (0, "weak"), (1, "t"), (1, "weak"), (2, "t"), (2, "weak"), (3, "weak")]
    inside = joins.outside(_found(spark, [(1, "weak", 3, 5), (1, "weak", 3, 6), (1, "t", 3, 5)]), "weak", ["t"])
    assert sorted((r["rule"], r["end_char"]) for r in inside.collect()) == [("t", 5), ("weak", 6)]
    for out in (lifted, left):
        assert _plan(out).count("LogicalRDD") == 1 and "Join" not in _plan(out) and lifted.columns == found.columns


def test_tree_matches_what_the_alternatives_match():
    rng = random.Random(5)
    parts = ["ab", "a b", "abc", "ab-c", "(x)", "个人", "b", "B a", "c.", "9%"]
    for phrases in ([*vocabulary.events()], [" ".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(40)]):
        own, other = (re.compile(x, re.ASCII) for x in (vocabulary.tree(phrases), vocabulary.either(phrases)))
        for _ in range(300):
            text = "".join(rng.choice([x, x.upper()]) + rng.choice([" ", "", "  ", "\t", "_", ", "]) for x in rng.choices([*phrases, *parts], k=12))
            assert [m.span() for m in own.finditer(text)] == [m.span() for m in other.finditer(text)]
    assert vocabulary.tree([f"share price {k}" for k in range(50)]).count("price") == 1


def test_seeds_read_spans_once_and_group_no_rows_in_python(spark):
    found = _found(spark, [(1, r, s, s + 2) for s, r in enumerate("abcab")] + [(2, r, s, s + 9) for r, s in (("a", 0), ("b", 400), ("a", 450), ("c", 501), ("d", 900))] + [(None, r, 0, 1) for r in "abc"])
    out = reident.seeds(found)
    assert sorted(map(tuple, out.collect())) == [(1, 0, 6, 3), (2, 400, 909, 4)]
    assert out.columns == ["doc_id", "start_char", "end_char", "n_rules"] and _plan(out).count("LogicalRDD") == 1 and "FlatMapGroupsInPandas" not in _plan(out)


def test_weights_of_distinct_rules(spark):
    found = _found(spark, [(1, "named_person", 0, 1), (1, "named_person", 5, 6), (1, "us_ssn", 8, 9), (1, "date_of_birth", 8, 9), (2, "other", 0, 1)])
    assert sorted(map(tuple, reident.weights(found).collect())) == [(1, 1.9, 2, True), (2, 0.0, 0, False)]


def test_hits_leave_python_in_pieces():
    texts = ["token " * 3000, None, "", "a token"] + ["token token"] * 2000
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])
    out = list(keywords.pieces(iter([batch]), keywords.automaton(["token"]), 4, 4))
    assert max(b.num_rows for b in out) <= 1024 and sum(b.num_rows for b in out) == 7001
    assert sorted((i, s) for b in out for i, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)) == sorted([(0, 6 * k) for k in range(3000)] + [(3, 2)] + [(k, s) for k in range(4, 2004) for s in (0, 6)])


def test_nearest_shuffles_texts_and_not_their_tokens(spark):
    docs = spark.createDataFrame([(1, "alpha beta beta"), (1, "gamma"), (2, "delta"), (3, None), (None, "alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "beta beta"), (4, "beta"), (6, "gamma"), (7, None)], "item_id long, text string")
    out = similarity.nearest(docs, items, "doc_id", "item_id")
    assert [tuple(r) for r in out.collect()] == [(1, 4, 0.816497)]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    whole = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Exchange hashpartitioning(token" not in whole and "Exchange hashpartitioning(doc_id" in whole and ", token#" not in "".join(x for x in whole.splitlines() if "Exchange hashpartitioning" in x)


def test_lines_and_terms_are_told_beside_their_texts(spark):
    texts = ["one\ntwo\n\nfour", "", "\n", "a"]
    rows = spark.createDataFrame([(t, k) for t in texts for k in range(len(t))], "text string, at int")
    assert all(r["n"] == r["text"][: r["at"]].count("\n") for r in rows.select("text", "at", structure.line_no(F.col("text"), F.col("at")).alias("n")).collect())
    for name in ("singling_out_units", "defined_term_suppression"):
        plan = _plan(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001"))
        assert "Join" not in plan and "Window" not in plan and plan.count("Relation [") == 1, name


def test_lines_of_an_address_are_cut_once(spark):
    docs = spark.createDataFrame([(1, "Home address: 12 Station Road,\nSingapore 569933\nPhone: 1\nMr Tan, x")], "doc_id long, text string")
    assert _plan(addresses.find(docs)).count("regexp_extract(") < 10
    assert [tuple(r)[2:] for r in addresses.find(docs).collect()] == [("labelled", 14, 47, "12 Station Road,\nSingapore 569933")]


def test_split_is_given_no_pattern(spark):
    """But for texts that hold the character put in place of a match, whose spans are right all the same."""
    texts = ["a-1 b\U0001f600-22 c", "\x01 a-1 \x01 b-22", "x-3", "é\U0001f600 x-3", "\x01x-3", "none", "", None, "-7 " * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for cap, pattern in ((False, "-[0-9]+"), (True, "-([0-9]+)")):
        found = docs.select("doc_id", F.explode(spans.matches("text", pattern, cap)).alias("x")).select("doc_id", "x.*")
        assert "regexp_replace(" in _plan(found)
        expected = [(k, m.start(int(cap)), m.end(int(cap)), m[int(cap)]) for k, t in enumerate(texts) for m in re.finditer(pattern, t or "")]
        assert sorted(tuple(r) for r in found.collect()) == expected
