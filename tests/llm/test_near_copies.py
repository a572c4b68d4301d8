"""Near copies by five-word shingles against all pairs."""

import random
from itertools import combinations

import pytest

from tessella.llm import near_copies, simhash
from tests.llm.test_operators import ODD, docs, lower

WORDS = [f"w{i}" for i in range(5000)]
SEEDS = [46, 138, 555, 1221, 1632, 1846]


def shingles(t):
    w = [x for x in near_copies.WORD.findall(lower(t))]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(texts):
    """All pairs of ids of similarity 0.8 or more."""
    sets = {i: shingles(t) for i, t in texts.items()}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}


def groups(links, ids):
    root = {i: i for i in ids}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def edited(rng, words, n):
    out = list(words)
    for p in rng.sample(range(len(out)), n):
        out[p] = rng.choice(WORDS)
    return " ".join(out)


def test_links_equal_all_pairs(spark):
    rng = random.Random(3)
    texts = {}
    for _ in range(40):
        base = rng.choices(WORDS, k=rng.choice([4, 30, 200, 600]))
        for n in (0, 1, len(base) // 50, len(base) // 30):
            texts[len(texts)] = edited(rng, base, n)
    want = alike(texts)
    got = {tuple(r) for r in near_copies.near_copy_links(docs(spark, list(texts.items()))).collect()}
    assert len(want) > 60 and got <= want and len(got) >= 0.98 * len(want)


def test_copies_with_a_repeated_line(spark):
    """Fingerprints weigh a shingle by its repeats; similarity is over sets."""
    rng = random.Random(5)
    texts, far = {}, 0
    for times in (50, 100, 300) * 4:
        base = [" ".join(rng.choices(WORDS, k=12)) for _ in range(40)]
        texts[len(texts)] = "\n".join(base)
        texts[len(texts)] = "\n".join(base[:20] + base[20:21] * times + base[21:])
        prints = [simhash.majority(near_copies.shingle_hashes(texts[len(texts) - i])) for i in (1, 2)]
        far += (prints[0] ^ prints[1]).bit_count() > 22
    want = alike(texts)
    assert far > 2 and len(want) == len(texts) // 2
    assert {tuple(r) for r in near_copies.near_copy_links(docs(spark, list(texts.items()))).collect()} == want


def test_no_link_is_lost(spark):
    """Pairs close to the limit, none of which may depend on chance."""
    rng = random.Random(8)
    texts = {}
    for _ in range(400):
        base = rng.choices(WORDS, k=rng.choice([60, 150, 300]))
        texts[len(texts)] = " ".join(base)
        start = rng.randrange(len(base) // 2)
        changed = rng.choices(WORDS, k=round(len(base) * rng.uniform(0.07, 0.12)))
        texts[len(texts)] = " ".join(base[:start] + changed + base[start + len(changed) :])
    want = alike(texts)
    assert 100 < len(want) < 390
    assert {tuple(r) for r in near_copies.near_copy_links(docs(spark, list(texts.items()))).collect()} == want


def test_pairs_that_share_no_band(spark):
    """Pairs of similarity 0.806 that 16 bands of 5 minima do not bring together."""
    texts = {}
    for seed in SEEDS:
        rng = random.Random(seed)
        base = rng.choices(WORDS, k=200)
        texts[len(texts)] = " ".join(base)
        texts[len(texts)] = " ".join(base[:100] + rng.choices(WORDS, k=17) + base[117:])
    want = alike(texts)
    assert len(want) == len(SEEDS)
    assert {tuple(r) for r in near_copies.near_copy_links(docs(spark, list(texts.items()))).collect()} == want


def test_links_through_members_of_a_large_group(spark):
    """Copies of a leader, and copies of those that the leader itself is not alike to."""
    rng = random.Random(6)
    base = rng.choices(WORDS, k=300)
    texts = {i: edited(rng, base, 1) for i in range(20)}
    for i in range(60):
        at = 10 * (i % 10)
        near = base[:at] + rng.choices(WORDS, k=19) + base[at + 19 :]
        texts[len(texts)] = " ".join(near)
        texts[len(texts)] = " ".join(near[:200] + rng.choices(WORDS, k=19) + near[219:])
    want = alike(texts)
    assert len(set(groups(want, texts).values())) == 1
    got = {tuple(r) for r in near_copies.near_copy_links(docs(spark, list(texts.items()))).collect()}
    assert got <= want and groups(got, texts) == groups(want, texts)


def test_chain_of_versions_stays_whole(spark):
    """Neighbours are alike, ends far apart, and all share what leads to large buckets."""
    rng = random.Random(4)
    texts = {}
    for chain in range(4):
        base = rng.choices(WORDS, k=300)
        for v in range(40):
            base[v * 7 : v * 7 + 7] = rng.choices(WORDS, k=7)
            texts[chain + 4 * v] = " ".join(base)
    want = alike(texts)
    assert (0, 4 * 39) not in want and len(set(groups(want, texts).values())) == 4
    for cap in (2, 16):
        got = {tuple(r) for r in near_copies.near_copy_links(docs(spark, list(texts.items())), pair_cap=cap).collect()}
        assert got <= want and groups(got, texts) == groups(want, texts)


@pytest.mark.parametrize("cap", [2, 16])
def test_large_groups_stay_whole(spark, cap):
    rng = random.Random(cap)
    texts = {}
    for edits in (1, 3):  # copies edited apart from each other, their source among them
        base = rng.choices(WORDS, k=250)
        for n in [edits] * 80 + [0] + [edits] * 40:
            texts[len(texts)] = edited(rng, base, n)
    shared = rng.choices(WORDS, k=120)  # a passage that clean documents share
    for _ in range(60):
        texts[len(texts)] = " ".join(shared + rng.choices(WORDS, k=120))
    found = near_copies.near_copy_links(docs(spark, list(texts.items())), pair_cap=cap)
    assert {tuple(r) for r in found.collect()} <= alike(texts)
    assert groups([tuple(r) for r in found.collect()], texts) == groups(alike(texts), texts)


def test_odd_tables(spark):
    rows = ODD + [(8, ""), (9, "The cat sat on the mat and looked at the big red dog again.")]
    df = docs(spark, rows)
    got = {r["doc_id"]: r["group_id"] for r in near_copies.near_copy_groups(df).collect()}
    assert got == {1: 1, 2: 1, 9: 1, 3: 3, 4: 3, 8: 3}
    kept = near_copies.stage_near_dedup(spark, df, "")
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 7]
    assert near_copies.near_copy_groups(docs(spark, [])).count() == 0
    assert near_copies.stage_near_dedup(spark, docs(spark, []), "").count() == 0


def test_frequent_passages_and_their_copies(spark):
    """Passages that more documents share than a bucket lists, near copies among their holders, and documents
    that consist of such passages."""
    rng = random.Random(12)
    passages = [rng.choices(WORDS, k=60) for _ in range(5)]
    texts = {}
    for i in range(70):
        own = rng.choices(WORDS, k=120)
        words = own[:40] + passages[i % 5] + own[40:80] + passages[(i + 1) % 5] + own[80:]
        texts[len(texts)] = " ".join(words)
        if i % 3 == 0:
            texts[len(texts)] = edited(rng, words, 3)
    for i in range(12):
        mixed = [passages[j] for j in rng.sample(range(5), 3)]
        texts[len(texts)] = " ".join(w for p in mixed for w in p) + f" end{i}"
    want = alike(texts)
    assert len(want) > 24
    for cap in (3, 16):
        got = {tuple(r) for r in near_copies.near_copy_links(docs(spark, list(texts.items())), pair_cap=cap).collect()}
        assert got <= want and groups(got, texts) == groups(want, texts)


def test_join_instead_of_a_list_gives_the_same(spark, monkeypatch):
    rng = random.Random(2)
    passage = rng.choices(WORDS, k=80)
    texts = {i: " ".join(rng.choices(WORDS, k=60) + passage + rng.choices(WORDS, k=60)) for i in range(40)}
    texts[40] = texts[7] + " more"
    df = docs(spark, list(texts.items()))
    one = {tuple(r) for r in near_copies.near_copy_links(df, pair_cap=4).collect()}
    monkeypatch.setattr(near_copies, "SENT_KEYS", 0)
    assert {tuple(r) for r in near_copies.near_copy_links(df, pair_cap=4).collect()} == one == alike(texts)


def test_passes_do_not_follow_from_what_is_frequent(spark, monkeypatch):
    """Documents of nothing but shared passages: their texts are read for the order once or twice, and what follows
    reads written prefixes, not the steps that led to them."""
    rng = random.Random(21)
    passages = [rng.choices(WORDS, k=40) for _ in range(12)]
    texts = {i: " ".join(w for j in rng.sample(range(12), 3) for w in passages[j]) + f" end{i}" for i in range(90)}
    for i in range(30):
        texts[len(texts)] = " ".join(rng.choices(WORDS, k=100) + passages[i % 12] + rng.choices(WORDS, k=100))
    reads, orders = [], []
    read, order, placed = near_copies.sets_of, near_copies._frequent_last, near_copies._placed

    def ordered(*args):
        before = len(reads)
        out = order(*args)
        orders.append(len(reads) - before)
        return out

    def from_files(sketches, *args):
        if orders:
            assert "LeftAnti" not in sketches._jdf.queryExecution().optimizedPlan().toString()
        return placed(sketches, *args)

    monkeypatch.setattr(near_copies, "sets_of", lambda *args: reads.append(1) or read(*args))
    monkeypatch.setattr(near_copies, "_frequent_last", ordered)
    monkeypatch.setattr(near_copies, "_placed", from_files)
    want = alike(texts)
    got = {tuple(r) for r in near_copies.near_copy_links(docs(spark, list(texts.items())), pair_cap=4).collect()}
    assert orders and max(orders) <= 2
    assert got <= want and groups(got, texts) == groups(want, texts)
