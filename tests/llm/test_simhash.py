import random

import xxhash

from tessera.llm import simhash
from tessera.llm.components import components
from tessera.llm.scratch import Scratch


def brute_fingerprint(text):
    words = [w for w in _split((text or "").translate({c: c + 32 for c in range(65, 91)}))]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def _split(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text)


def brute_components(rows):
    prints = {i: brute_fingerprint(t) for i, t in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(40)]
    rows = list(enumerate([*base, *base[:10], base[0].upper(), base[1] + " ", "", " \n\t", None, "one", "one two", "Éa b c d", "éa b c d"]))
    long = " ".join(rng.choices(words, k=400)).split()
    for k in range(15):
        changed = list(long)
        changed[rng.randrange(400)] = "zz"
        rows.append((200 + k, " ".join(changed)))
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "'x' as root", "2 as component_id")
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert found == brute_components(rows)


def test_hot_keys_link_alike(spark, monkeypatch):
    prints = [(p,) for p in {(7 << 40) ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(0, 64, 5)}]
    prints = [(p - (1 << 64) if p >> 63 else p,) for (p,) in prints]
    frame = spark.createDataFrame(prints, "fp long")
    by = {}
    for most in (2, 10**6):
        monkeypatch.setattr(simhash, "PAIRWISE_MOST", most)
        scratch = Scratch(spark, "t")
        by[most] = sorted(map(tuple, components(simhash.links(frame, scratch), scratch).collect()))
    assert by[2] == by[10**6] and by[2]


def test_one_of_each_keeps_columns_and_one_row(spark):
    rows = [(3, "a b c d e", "x"), (1, "a b c d e", "y"), (1, "a b c d e", "y"), (None, "q r s t u v", "z"), (None, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(["Row(doc_id=1, text='a b c d e', fp='y')", "Row(doc_id=None, text='q r s t u v', fp='z')", "Row(doc_id=None, text=None, fp='n')"]) or kept.count() == 3


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    found = {r["node"]: r["root"] for r in components(edges, Scratch(spark, "t")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {101: 100}
