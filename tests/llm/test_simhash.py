import random

import numpy as np
import pytest
import xxhash

from tapeloom.llm.common import kept
from tapeloom.llm.components import components
from tapeloom.llm.simhash import fingerprint, near_duplicates, near_links, one_of_each

from .conftest import EDGES


def by_definition(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(values, most=4):
    values = list(dict.fromkeys(values))
    seen, out = set(), {}
    for v in values:
        if v in seen:
            continue
        group, todo = set(), [v]
        while todo:
            a = todo.pop()
            if a not in group:
                group.add(a)
                todo += [b for b in values if (a ^ b).bit_count() <= most]
        seen |= group
        out |= {a: group for a in group}
    return out


def signed(x):
    return x - 2**64 if x >= 2**63 else x


def test_fingerprint_follows_its_definition():
    rng = random.Random(1)
    for n in [0, 1, 3, 4, 5, 200]:
        text = " ".join(rng.choice(["A", "bé", "C\x0bd", "e"]) for _ in range(n))
        assert fingerprint(text.encode()) == by_definition(text)


def test_links_span_all_near_fingerprints(spark):
    rng = random.Random(2)
    values = {rng.getrandbits(64) for _ in range(300)}
    for _ in range(40):  # chains and dense groups
        v = rng.getrandbits(64)
        for _ in range(rng.choice([2, 5, 60])):
            values.add(v)
            v ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 3, 4, 5])))
    groups = reachable(values)
    table = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    links = near_links(table)
    for a, b in links.collect():
        assert ((a % 2**64) ^ (b % 2**64)).bit_count() <= 4
    got = {r.node % 2**64: r.component % 2**64 for r in components(links, "a", "b").collect()}
    for v in values:
        assert {w for w in values if got.get(w, w) == got.get(v, v)} == groups[v]


def test_large_groups_are_cut_and_stay_whole(spark, monkeypatch):
    monkeypatch.setattr("tapeloom.llm.simhash.GROUP", 40)
    rng = np.random.default_rng(3)
    values = {int(1) << int(b) | int(1) << int(c) for b, c in rng.integers(0, 64, (500, 2))}
    links = near_links(spark.createDataFrame([(signed(v),) for v in values], "fp bigint"))
    got = components(links, "a", "b").collect()
    assert len(got) == len(values) and len({r.component for r in got}) == 1


def test_edges(edges, nothing):
    got = near_duplicates(edges).collect()
    assert len(got) == len(EDGES)
    fps = [by_definition(r[1]) for r in EDGES]
    groups = reachable(fps)
    for r in got:
        ids = [e[0] for e, f in zip(EDGES, fps) if f in groups[r.fp % 2**64] and e[0] is not None]
        assert r.component_id == min(ids, default=None)
    assert near_duplicates(nothing).count() == 0 and one_of_each(nothing).count() == 0


def test_no_table_of_fingerprints_is_broadcast(spark, docs_of, monkeypatch):
    plans = []

    def planned(df, name="table"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)

    for module in ("simhash", "components"):
        monkeypatch.setattr(f"tapeloom.llm.{module}.kept", planned)
    monkeypatch.setattr("tapeloom.llm.components.SENT", 0, raising=False)
    rng = random.Random(4)
    text = " ".join(str(rng.randrange(1000)) for _ in range(500))
    assert 0 < (by_definition(text) ^ by_definition(text + " end")).bit_count() <= 4
    rows = [(k, text + (" end" if k % 2 else ""), "en", "a") for k in range(40)] + [(40, None, "en", "a"), (None, "an other text", "en", "a")]
    got = planned(near_duplicates(docs_of(rows))).collect()
    assert sorted((r.doc_id, r.component_id) for r in got if r.doc_id is not None) == [(k, 0) for k in range(40)] + [(40, 40)]
    assert len(got) == 42 and sum("SortMergeJoin" in p for p in plans) >= 5 and not any("Broadcast" in p for p in plans)


def test_one_of_each_group_stays(docs_of):
    docs = docs_of([*EDGES, (None, "quite another text, without an id of its own", "en", "a")] + [(None, "quite another text, without an id of its own", "en", "a")])
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id or -1 for r in kept.collect())
    assert ids == [-1, 3, 7, 10, 11, 12, 13]


@pytest.mark.parametrize("links", [[], [(1, 1)], [(None, 2)]])
def test_components_of_nothing(spark, links):
    assert components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").count() == 0


def test_components_of_paths_and_stars(spark):
    path = [(k, k + 1) for k in range(100, 160)]
    star = [(900, k) for k in range(901, 960)]
    got = components(spark.createDataFrame(path + star + path[::-1], "a bigint, b bigint"), "a", "b").collect()
    assert {r.node: r.component for r in got} == {k: 100 for k in range(100, 161)} | {k: 900 for k in range(900, 960)}
