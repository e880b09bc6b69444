import random

import numpy as np
import xxhash

from locusgrid.llm import simhash as S


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
             .translate({i: " " for i in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, bits=2):
    """Smallest index reachable, by brute force."""
    root = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(len(fps)):
                if root[j] < root[i] and bin(fps[i] ^ fps[j]).count("1") <= bits:
                    root[i], changed = root[j], True
    return root


def unsigned(x):
    return x & (1 << 64) - 1


def test_fingerprint_is_the_majority_of_shingle_bits():
    r = random.Random(3)
    texts = [None, "", " \t\n", "One", "One TWO", "É é Ab", "a b c d e f a b c d e f"]
    texts += [" ".join(r.choices("abcdefgÄ", k=r.randint(3, 60))) for _ in range(40)]
    for t in texts:
        assert unsigned(S.fingerprint(t)) == slow_fingerprint(t), t
    long = " ".join(f"w{i}" for i in range(S.CHUNK + 10))
    h = [xxhash.xxh64_intdigest(f"w{i} w{i + 1} w{i + 2}".encode(), seed=42) for i in range(S.CHUNK + 8)]
    bits = np.unpackbits(np.array(h, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)
    assert unsigned(S.fingerprint(long)) == sum(1 << i for i in range(64) if 2 * bits[i] > len(h))


def near(r, fp, bits):
    for b in r.sample(range(64), bits):
        fp ^= 1 << b
    return fp


def check_links(spark, fps, hot_cell):
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(S._signed(f),) for f in fps], "fp long")
    found = {(r.node, r.root) for r in S.roots(S.links(nodes, hot_cell)).collect()}
    named = dict(found)
    want = components(fps)
    groups = {}
    for f, root in zip(fps, want):
        groups.setdefault(root, []).append(S._signed(f))
    for own in groups.values():
        assert {named.get(f, f) for f in own} == {min(own)}


def test_links_join_what_brute_force_joins(spark):
    r = random.Random(5)
    fps = [0, (1 << 64) - 1, 1, 3, 7]
    for _ in range(25):
        fps.append(r.getrandbits(64))
        for _ in range(r.randint(0, 6)):
            fps.append(near(r, fps[-1], r.randint(1, 4)))
    check_links(spark, fps, S.HOT_CELL)


def test_crowded_cells_lose_no_link(spark):
    r = random.Random(6)
    base = r.getrandbits(64)
    fps = {near(r, base, k) for k in (1, 2, 2, 3) for _ in range(40)} | {r.getrandbits(64) for _ in range(20)}
    check_links(spark, fps, 4)
    check_links(spark, fps, 10_000)


def test_a_chain_is_one_component(spark):
    chain = [0]
    for b in range(0, 60, 2):
        chain.append(chain[-1] ^ 3 << b)
    check_links(spark, chain, S.HOT_CELL)


def test_null_empty_repeated_and_clashing(spark, docs):
    rows = [(9, None), (7, ""), (8, " "), (3, "a b c d"), (3, "a b c d"), (5, "A B  c\td"), (None, "a b c d"),
            (None, "lonely words here now"), (6, "entirely other words of a text")]
    got = [tuple(r) for r in S.near_duplicates(docs(rows)).collect()]
    assert len(got) == len(rows)
    by = {}
    for doc, fp, comp in got:
        by.setdefault(doc, set()).add((fp, comp))
    assert {c for _, c in by[9] | by[7] | by[8]} == {7} and {f for f, _ in by[9]} == {0}
    assert {c for _, c in by[3] | by[5]} == {3}
    assert {c for _, c in by[None]} == {3, None}
    kept = S.keep_one(docs(rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None) == [
        (3, "a b c d"), (6, "entirely other words of a text"), (7, "")]
    assert [r.text for r in kept if r.doc_id is None] == ["lonely words here now"]  # the other repeats 3
    assert S.keep_one(docs(rows)).columns == docs(rows).columns and {r["row"] for r in kept} == {"clash"}
    assert S.near_duplicates(docs([])).count() == 0 and S.keep_one(docs([])).count() == 0


def test_a_repeated_id_doesnt_cost_another_text(spark, docs):
    rows = [(1, "a b c d e"), (3, "a b c d e"), (3, "quite another text of words")]
    assert sorted((r.doc_id, r.text) for r in S.keep_one(docs(rows)).collect()) == [
        (1, "a b c d e"), (3, "quite another text of words")]


def test_keep_one_equals_brute_force_with_repeated_ids(spark, docs):
    r = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    base = [" ".join(r.choice(words) for _ in range(60)) for _ in range(12)] + ["", None]
    rows = [(r.choice([None, *range(9)]), r.choice(base)) for _ in range(150)]
    fp = {t: S.fingerprint(t) for _, t in rows}
    root = {f: f for f in fp.values()}
    find = lambda f: f if root[f] == f else find(root[f])
    for a in root:
        for b in root:
            if bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2:
                root[find(a)] = find(b)
    groups = {}
    for i, t in rows:
        groups.setdefault(find(fp[t]), []).append((i is None, i))
    kept = S.keep_one(docs(rows)).collect()
    got = {}
    for k in kept:
        got.setdefault(find(fp[k.text]), []).append((k.doc_id is None, k.doc_id))
    assert got == {g: [min(own, key=lambda x: (x[0], x[1] or 0))] for g, own in groups.items()}
