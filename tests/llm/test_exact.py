import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sievemill.llm import exact


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ", max_size=12).map(str.encode), max_size=40), st.sampled_from([1, 900, 3000, 1 << 20]))
def test_owners_with_spill(keys, memory):
    owners = exact.SpillingOwners(memory)
    for i, k in enumerate(keys):
        owners.add(k, (False, i, i), 1)
    want: dict[bytes, list] = {}
    for i, k in enumerate(keys):
        want.setdefault(k, []).append(i)
    assert sorted(sorted(o[2] for o, _ in g) for g in owners.groups()) == sorted(want.values())


def test_odd_rows(spark):
    rows = [(3, "a  b"), (1, "a\tb"), (2, "a b "), (None, "a b"), (7, None), (6, ""), (5, "x" * 200_000), (4, "x" * 200_000), (4, "x" * 200_000), (9, "a b"), (8, " "), (10, "\n\n")]
    df = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, keep_id string, rid int")
    groups: dict[str, list] = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append(d)
    got = exact.exact_dedup(df).collect()
    assert len(got) == len(rows)
    for text, ids in groups.items():
        mine = [r for r in got if r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()]
        least = min((i for i in ids if i is not None), default=None)
        assert sorted(map(str, (r.doc_id for r in mine))) == sorted(map(str, ids))
        assert {(r.keep_id, r.group_size) for r in mine} == {(least, len(ids))}
        assert [r.doc_id for r in mine if r.kept] == [least]
    kept = exact.drop_copies(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(min(i for i in ids if i is not None) for ids in groups.values())
    assert exact.exact_dedup(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ", max_size=12).map(str.encode), max_size=40), st.sampled_from([1, 900, 3000, 1 << 20]))
def test_terminal_nodes_hold_one_owner(keys, memory):
    owners = exact.SpillingOwners(memory, smallest=True)
    for i, k in enumerate(keys):
        owners.add(k, (False, -i, i), 2)
    want = {k: [((False, -(len(keys) - 1 - keys[::-1].index(k)), len(keys) - 1 - keys[::-1].index(k)), 2 * keys.count(k))] for k in keys}
    assert dict(owners.keyed()) == want
