"""Places where an operator once did less than its whole job."""

import numpy as np

from wavelath.llm import common, near_dedup, repair


def test_tiles_give_every_link():
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(words), " ".join([*words, "more"]), " ".join(words[30:] * 3), " ".join([*words[30:] * 3, "x"]), "a b c d e f"]
    tile = {"left": [True, False, True, False, True], "right": [True] * 5, "comp": [1, 2, 3, 4, 5], "text": texts}
    links = sorted(near_dedup.links_in(tile, near_dedup.Idf()))
    own = near_dedup.shingles(texts)
    want = [(i + 1, j + 1) for i in range(5) for j in range(i + 1, 5) if near_dedup.similarity(own[i], own[j], near_dedup.Idf()) >= 0.8]
    assert links == want == [(1, 2), (3, 4)]
    assert near_dedup.links_in(tile | {"comp": [1, 1, 3, 3, 5]}, near_dedup.Idf()) == []
    assert near_dedup.links_in(tile | {"left": [False] * 5}, near_dedup.Idf()) == []


def counted(sym, end):
    """Occurrences of each pair within documents, those of one symbol twice at alternate places."""
    seen, k = {}, 0
    while k < len(sym) - 1:
        pair = (sym[k], sym[k + 1])
        if not end[k]:
            seen[pair] = seen.get(pair, 0) + 1
        k += 2 if not end[k] and pair[0] == pair[1] and k + 2 < len(sym) and sym[k + 2] == pair[0] and not end[k + 1] else 1
    return seen


def test_grammar_goes_on_until_no_pair_is_frequent():
    r = np.random.default_rng(4)
    passage = r.integers(0, 900, 500)
    ids = np.concatenate([np.full(9001, 7), *([passage] * 40), r.zipf(1.4, 6000).clip(max=899)]).astype(np.uint32)
    ends = np.zeros(len(ids), bool)
    ends[[9000, len(ids) - 1]] = True
    for steep in (1, repair.STEEP, 10**9):
        sym, end, rules = repair.compress(ids, ends, 1000, steep=steep)
        assert repair.expand(sym, rules, 1000).tolist() == ids.tolist()
        assert max(counted(sym.tolist(), end.tolist()).values()) < repair.LEAST
        assert np.flatnonzero(end)[0] < 40


def test_rounds_tell_only_those_pairs_apart_that_they_may_replace():
    bucket = np.repeat(np.arange(6), [5000, 60, 49, 16, 15, 1])
    rare, may = repair.sifted(bucket, 3, least=16, steep=100)
    assert sorted(set(bucket[rare].tolist())) == [4, 5] and rare.sum() == 16
    # All 5125 places of pairs that aren't rare were told apart before; those under a hundredth of 5000 wait.
    assert may.tolist() == list(range(5060))
    assert len(repair.sifted(bucket, 3, least=16, steep=10**9)[1]) == 5125


def test_few_edges_are_joined_in_one_task(spark, monkeypatch):
    r = np.random.default_rng(5)
    pairs = [(k, k + 1) for k in range(300)] + [(1000 + int(a), 1000 + int(b)) for a, b in r.integers(0, 200, (150, 2))] + [(-5, 900), (6, 6), (None, 3)]
    edges, calls, own = spark.createDataFrame(pairs, "a long, b long"), [], common.staged
    monkeypatch.setattr(common, "staged", lambda df, tag: calls.append(tag) or own(df, tag))
    one = sorted(map(tuple, common.components(edges).collect()))
    assert len(calls) == 1  # a round writes, deals out and broadcasts anew, which fills the driver
    assert one == sorted(map(tuple, common.components(edges, few=0).collect())) and len(calls) > 2
    assert sorted(map(tuple, common.components(edges, few=250).collect())) == one
    assert common.components(edges.where("a = b")).collect() == []


def test_texts_that_miss_the_first_one_meet_each_other(spark):
    base = [f"w{k}" for k in range(200)]
    texts = [" ".join(["other"] * 2 + base[:110])] + [" ".join([*base, f"x{k}"]) for k in range(40)] + ["no link at all to any of them"]
    rows = spark.createDataFrame(list(enumerate(texts)), "v long, text string")
    pairs = spark.createDataFrame([(0, k) for k in range(1, len(texts))], "a long, b long")
    idf = spark.sparkContext.broadcast(near_dedup.Idf())
    found = [tuple(x) for x in near_dedup.verified(pairs, rows, idf).collect()]
    ids, least = common.least_reachable(*np.array(found, int).reshape(-1, 2).T)
    # The text numbered 0 links with none: all else was left to tiles, of which a group has as many as the square of what is left.
    assert ids.tolist() == list(range(1, 41)) and set(least.tolist()) == {1} and len(found) == 39
