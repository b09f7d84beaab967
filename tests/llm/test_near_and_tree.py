import hashlib
import random

import numpy as np
import pytest
import xxhash

from sievekit.llm import merkle, simhash_gray
from sievekit.llm.components import components


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, distance):
    label = list(ids)
    while True:
        new = [min(label[j] for j in range(len(ids)) if bin(fps[i] ^ fps[j]).count("1") <= distance) for i in range(len(ids))]
        if new == label:
            return label
        label = new


@pytest.fixture(scope="module")
def copies(make):
    rng = random.Random(2)
    rows = []
    for i in range(40):
        words = [rng.choice("abcdefghijklmnopqrst") * 2 for _ in range(rng.randint(0, 120))]
        rows.append((i, " ".join(words), "en"))
        for j in range(rng.randint(0, 3)):
            other = list(words)
            if other:
                other[rng.randrange(len(other))] = "zz"
            rows.append((1000 + 10 * i + j, " ".join(other).upper(), "en"))
    return make(rows + [(5000, None, "en"), (5001, "É é", "fr")])


@pytest.mark.parametrize("hot", [400_000, 3])
def test_groups_equal_brute_force(copies, hot):
    rows = copies.collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = dict(zip([r.doc_id for r in rows], zip([f"{f:016x}" for f in fps], brute_components([r.doc_id for r in rows], fps, 4))))
    got = simhash_gray.near_groups(copies, hot_rows=hot).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want


def test_a_family_around_one_centre_is_dealt_in_bounded_groups(spark):
    """Splitting by blocks twice leaves most of it in one group; every pair still meets."""
    rng, hot = random.Random(5), 40
    centre = rng.getrandbits(63)
    family = sorted({centre ^ sum(1 << b for b in rng.sample(range(63), rng.randint(1, 3))) for _ in range(500)})
    keyed = spark.createDataFrame([(f, k) for f in family for k in (1, 2)] + [(f, 3) for f in family[:hot]], "fp long, key long")
    dealt, rows = simhash_gray.run_pairs(keyed, hot)
    groups = {}
    for r in dealt.collect():
        groups.setdefault(r.key, []).append(r.fp)
    assert sorted(groups.pop(3)) == family[:hot]  # a group within the bound stays
    assert rows == sum(map(len, groups.values())) and max(map(len, groups.values())) <= 2 * hot
    met = {}
    for members in groups.values():
        for f in members:
            met.setdefault(f, set()).update(members)
    assert all(met[f] == set(family) for f in family)


@pytest.mark.parametrize("hot", [30, 100])
def test_components_of_a_family_equal_brute_force(spark, hot, monkeypatch):
    rng, dealt = random.Random(7), []
    real = simhash_gray.run_pairs
    monkeypatch.setattr(simhash_gray, "run_pairs", lambda keyed, hot_rows: dealt.append(real(keyed, hot_rows)) or dealt[-1])
    centre = rng.getrandbits(63)
    fps = sorted({centre ^ sum(1 << b for b in rng.sample(range(63), rng.randint(1, 7))) for _ in range(400)} | {rng.getrandbits(63) for _ in range(100)})
    got = simhash_gray.fp_components(spark.createDataFrame([(f,) for f in fps], "fp long"), 4, hot).collect()
    want = dict(zip(fps, brute_components(fps, fps, 4)))
    least = {}
    for r in got:
        least[r.root] = min(least.get(r.root, r.fp), r.fp)
    assert {r.fp: least[r.root] for r in got} == want and dealt[0][1] > 0


def test_one_of_each_group_stays(copies, odd, empty):
    twice = copies.unionByName(copies).withColumnRenamed("source", "__fp")
    out = simhash_gray.keep_one(twice)
    names = {r.component_id for r in simhash_gray.near_groups(copies).collect()}
    assert out.columns == twice.columns and sorted(r.doc_id for r in out.collect()) == sorted(names)
    assert simhash_gray.near_groups(odd).count() == odd.count()
    assert simhash_gray.keep_one(empty).count() == simhash_gray.near_groups(empty).count() == 0


def test_index_over_dense_groups():
    rng = np.random.default_rng(4)
    fp = rng.integers(0, 1 << 62, 30, dtype=np.uint64)
    fp = np.unique(np.concatenate([fp ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for _ in range(40)]))
    group = rng.integers(0, 2, len(fp))
    order = np.lexsort((simhash_gray.gray_rank(fp), group))
    fp, group = fp[order], group[order]
    near = (np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4) & (group[:, None] == group[None, :])
    want = np.arange(len(fp))
    while True:
        new = np.array([want[n].min() for n in near])
        if (new == want).all():
            break
        want = new
    assert (simhash_gray.GrayIndex(group, fp).links(4) == want).all()


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(500, j) for j in range(501, 560)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{j: 500 for j in range(501, 560)}}


def test_tree_covers_the_text_and_round_trips():
    for text in ["", "\n", "\n\n", "a", "One. Two!\nThree\n\nFour | five", "x " * 500, "no-space" * 300, "a\r\nb\n"]:
        node = merkle.tree(text)
        assert node.length == len(text) and merkle.write(merkle.read(merkle.write(node))) == merkle.write(node)
        assert merkle.likeness(node, merkle.tree(text)) == 1.0


def test_edits_are_located():
    lines = [f"Line {k} has a few words of its own." for k in range(200)]
    a = "\n".join(lines)
    b = "\n".join([*lines[:120], "Something else was put here.", *lines[121:]])
    spans = merkle.edited_branches(merkle.tree(a), merkle.tree(b))
    assert spans and all("Something" in b[s - 40 : s + n] or "else" in b[s - 60 : s + n] for s, n in spans)
    assert 0.98 < merkle.likeness(merkle.tree(a), merkle.tree(b)) < 1


def test_next_documents_equal_brute_force(odd, empty, make):
    docs = odd.where("doc_id IS NOT NULL AND doc_id <> 4").unionByName(make([(20 + i, f"text {i}. " * i, "en") for i in range(30)]))
    rows = sorted([(r.doc_id, r.text or "") for r in docs.collect()], reverse=True)
    want = {}
    for (i, t), (_, following) in zip(rows, rows[1:] + rows[:1]):
        new = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = merkle.tree(t), merkle.tree(new), merkle.tree(following)
        want[i] = (len(t), hashlib.sha256(new.encode()).hexdigest(), a.digest, b.digest, merkle.likeness(a, b), merkle.likeness(a, c))
    for parts in (docs, docs.repartition(1)):
        got = merkle.with_next(parts).collect()
        assert {r.doc_id: tuple(r)[1:7] for r in got} == want and len(got) == len(rows)
    assert merkle.with_next(odd).count() == odd.count() and merkle.with_next(empty).count() == 0
    assert merkle.with_next(make([(1, "alone. here", "en")])).first().near_next == 1.0
