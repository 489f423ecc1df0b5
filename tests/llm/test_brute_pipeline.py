"""run() against a plain version of its first three stages, on null, repeated and clashing ids."""

import random
import re
from collections import Counter
from itertools import combinations

import corpus_pipeline
from tests.llm.conftest import make


def brute(rows, bench):
    """What quality rules without labels, near-duplicate removal and decontamination leave, as (doc_id, text)."""
    from tests.llm.test_operators import brute_repeat_words

    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    rows = [(i, t) for i, t in rows if len(split(t)) >= 20 and 100 * brute_repeat_words(split(t)) <= 30 * len(split(t))]
    sets = [set(zip(*(split(t)[k:] for k in range(5)), strict=False)) for _, t in rows]
    group = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            group = [group[a] if g == group[b] else g for g in group]
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    windows = {tuple(w[i : i + 13]) for w in map(fold, bench) if w for i in range(max(1, len(w) - 12))}
    out = []
    for g in set(group):
        own = [r for r, x in zip(rows, group, strict=True) if x == g]
        least = min((i is None, i or 0) for i, _ in own)
        doc = {r for r in own if (r[0] is None, r[0] or 0) == least}
        words = {r: fold(r[1]) for r in doc}
        hit = {r: {k for i in range(len(w)) for n in {len(x) for x in windows} if tuple(w[i : i + n]) in windows for k in range(i, i + n)} for r, w in words.items()}
        out.append({r for r in doc if not (hit[r] and 20 * len(hit[r]) >= len(words[r]))} or None if len(doc) == 1 else doc)
    return [x for x in out if x]


def test_first_stages_match_a_plain_version(spark, no_labels, tmp_path):
    rng = random.Random(31)
    base = [[f"w{k}x{rng.randint(0, 400)}" for _ in range(rng.choice([8, 40, 90]))] for k in range(25)]
    bench = [" ".join(f"b{rng.randint(0, 300)}" for _ in range(20)) for _ in range(3)]
    rows = []
    for i in range(140):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(len(words))] = f"y{rng.randint(0, 99)}"
        if rng.random() < 0.15:
            words += rng.choice(bench).split()
        if rng.random() < 0.05:
            words = ["again and again"] * 12
        rows.append((rng.choice([None, *range(60)]), rng.choice([" ", "\n"]).join(words)))
    rows += [(None, None), (3, ""), (3, rows[0][1]), rows[1], rows[1]]
    sf = str(tmp_path)
    make(spark, [(i, t, "en", "abc"[k % 3]) for k, (i, t) in enumerate(rows)]).write.parquet(f"{sf}/documents.parquet")
    no_labels.write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(k, t) for k, t in enumerate(bench)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf)
    got = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    want = brute(rows, bench)
    assert sum(got.values()) == len(got) == len(want)  # one row a class
    assert all(sum(r in w for r in got) == 1 for w in want)
    shards = corpus_pipeline.run(spark, sf).collect()
    sizes = Counter(r["shard"] for r in shards)
    assert {r["doc_id"] for r in shards} <= {i for i, _ in got} and max(sizes.values()) - min([*sizes.values(), *([0] if len(sizes) < 16 else [])]) <= 1
