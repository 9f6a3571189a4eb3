import random
import re

import pytest

from tessera.llm import jaccard


def _set(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set()


def brute(rows, percent=90):
    sets = [_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        least.setdefault(find(i), []).append(name)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(((name, len(s), least[find(i)]) for i, ((name, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = [None, "", " \n\t", "one", "One", "one two", "a b c", "A  b\nc", "Éa b c d", "éa b c d"]
    for n in (5, 9, 11, 12, 20, 21, 30, 60, 200, 900):
        for _ in range(3):
            base = rng.choices(words, k=n)
            texts.append(" ".join(base))
            for _ in range(12):
                changed = list(base)
                for _ in range(rng.randint(0, max(1, n // 40))):
                    k = rng.randrange(len(changed))
                    changed[k : k + 1] = rng.choice([[], [rng.choice(words)], [changed[k], rng.choice(words)]])
                texts.append(" ".join(changed + rng.choices(words, k=rng.randint(0, n // 9))))
    rng.shuffle(texts)
    return [*enumerate(texts), (3, "a b c"), (None, "a b c"), (None, "alone here and there"), (None, None), (7, "x y z"), (7, "x y z")]


@pytest.mark.parametrize("most", [32, 2])
def test_matches_brute_force(spark, monkeypatch, most):
    """Also with all but the rarest blocks taken for hot ones, and groups so small that a block has many."""
    monkeypatch.setattr(jaccard, "PAIRWISE_MOST", most)
    monkeypatch.setattr(jaccard, "GROUP", 1000 if most == 2 else jaccard.GROUP)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as node", "'y' as key", "1 as n", "2 as component_id")
    found = sorted(map(tuple, jaccard.link_documents(docs).collect()), key=repr)
    assert found == brute(rows)


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_other_similarities(spark, percent):
    rows = corpus(percent)
    found = sorted(map(tuple, jaccard.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).collect()), key=repr)
    assert found == brute(rows, percent)


def test_linked_sets_share_a_key():
    rng = random.Random(1)
    bands = jaccard.Bands(90)
    for _ in range(3000):
        a = rng.randint(1, 400)
        x = {rng.getrandbits(64) for _ in range(a)}
        y = set(list(x)[rng.randint(0, a // 12) :]) | {rng.getrandbits(64) for _ in range(rng.randint(0, a // 12))}
        both = len(x & y)
        if x != y and 100 * both >= 90 * (len(x) + len(y) - both):
            keys = [set(bands.keys(jaccard.np.array(sorted(s), "uint64")).tolist()) for s in (x, y)]
            assert keys[0] & keys[1]


def test_empty_table(spark):
    assert jaccard.link_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
