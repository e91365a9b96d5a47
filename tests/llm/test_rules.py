import re
from collections import Counter

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from sievemill.llm import rules


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.lists(st.sampled_from(["a", "b", "#", " é", "\n", "\x1c"]), max_size=80).map(" ".join)))
def test_measurements(text):
    assert rules.measure(text)[:5] == by_hand(text)


def test_odd_rows(spark):
    long = "word " * 200_000
    clean = " ".join(f"word{i} and{i}" for i in range(30))
    texts = [None, "", "\n \n", "a " * 19, clean, clean, long, "# " * 40 + clean, "\n".join(["same line"] * 30) + "\n" + clean, clean.upper(), "😀 " * 30 + " ".join(map(str, range(900)))]
    df = spark.createDataFrame([(i if i else None, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, failed int, kept string")
    got = {r.doc_id: r for r in rules.apply_policies(rules.rule_ledger(df), rules.BASE, rules.PLAIN, rules.FULL).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert tuple(got[i or None])[1:6] == by_hand(t)
    names = list(rules.RULES)
    failed = {i: {n for k, n in enumerate(names) if got[i or None].failed >> k & 1} for i in range(len(texts))}
    assert failed == {0: {"few_words"}, 1: {"few_words"}, 2: {"few_words"}, 3: {"few_words", "repeated_words", "short_words"}, 4: set(), 5: set(), 6: {"repeated_words", "many_words"}, 7: {"repeated_words", "symbols", "letterless"}, 8: {"repeated_words", "repeated_lines"}, 9: {"loud"}, 10: {"letterless"}}
    assert got[9].kept_plain and not got[9].kept_full and got[4].kept_full and not got[6].kept_base
    assert rules.rule_ledger(df.limit(0)).count() == 0 and {r.n_failed for r in rules.ablations(rules.rule_ledger(df.limit(0)), rules.FULL).collect()} == {0}


def test_policies_and_ablations(spark):
    bits = [0, 1, 1, 3, 4, 8, 9, 16, 48, 64, 192, 448]
    ledger = spark.createDataFrame([(b,) for b in bits], "failed long")
    for policy in (rules.BASE, rules.FULL, rules.Policy("doubt", ("few_words",), ("short_words", "long_words", "letterless"), 2)):
        names = policy.reject + policy.doubt

        def keeps(b, skip=None, policy=policy):
            on = {n for k, n in enumerate(rules.RULES) if b >> k & 1} - {skip}
            return not on & set(policy.reject) and len(on & set(policy.doubt)) < policy.limit

        want = {(policy.version, n, sum(bool(b & rules.mask((n,))) for b in bits), sum(b & rules.mask(names) == rules.mask((n,)) for b in bits), sum(map(keeps, bits)), sum(keeps(b, n) for b in bits)) for n in names}
        assert {tuple(r) for r in rules.ablations(ledger, policy).collect()} == want


def test_equals_sql_and_keeps_the_good(spark, sf):
    df = rules.query(spark, sf)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(rules.ORACLE)
    assert want.columns == df.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 AND toxic = 0")
    assert df.join(good, "doc_id").where("NOT kept AND NOT base_failed").isEmpty()
