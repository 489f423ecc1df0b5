"""Every operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import make
from webloom.llm import decontaminate, html_cut, langid, mixing, ngram_join, pii, quality_rules, sharding, suffix_dedup, weak_quality
from webloom.llm.components import components


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# 1: quality rules.


def brute_repeat_words(words, k=8):
    seen = Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return len({j for i in range(len(words) - k + 1) if seen[tuple(words[i : i + k])] > 1 for j in range(i, i + k)})


def test_base_measures_match_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    got = {r["doc_id"]: r for r in quality_rules.measures(docs).collect()}
    for r in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        lines = [x for x in r["text"].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", r["text"])), len(lines) - len(set(lines)), brute_repeat_words(words))
        g = got[r["doc_id"]]
        assert (g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) == want


def test_repeat_words_on_small_alphabets():
    rng = random.Random(3)
    for _ in range(200):
        words = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 60))]
        assert quality_rules.repeat_words(words) == brute_repeat_words(words)


def test_binomial_bound_is_exact():
    assert quality_rules.binom_cdf(0, 10, 0.1) == pytest.approx(0.9**10)
    assert quality_rules.binom_cdf(10, 10, 0.3) == 1.0
    assert not quality_rules.rejects_few(0, 50, 0.01, 0.01) and quality_rules.rejects_few(0, 500, 0.01, 0.01)


def test_levels_reject_bad_and_respect_the_risk():
    names = quality_rules.strata(("en",))
    counts = {("length 0", 0, False): 300, ("length 0", 7, True): 5000, ("length 150", 0, True): 4000, ("length 150", 0, False): 300, ("language en", 2, False): 50, ("language en", 7, True): 60}
    chosen = quality_rules.choose_levels(counts, names, alpha=0.05, delta=0.05)
    assert chosen["length 0"] == (1, 7, 5000)
    assert chosen["length 150"] == (0, 0, 4000)  # every good document would go
    assert chosen["language en"] == (0, 0, 60)  # sixty documents show nothing about one in twenty
    assert chosen["language other"] == (0, 0, 0)


def test_path_runs_from_lax_to_strict():
    top = len(quality_rules.CUTOFFS)
    counts = {("symbols", 0, True): 900, ("symbols", 20, True): 1, ("symbols", top, False): 50, ("symbols", 10, False): 50, ("toxic", 0, True): 901}
    path = quality_rules.make_path(counts)
    assert all(list(cuts) == sorted(cuts, reverse=True) for cuts in path.values())
    assert set(path["toxic"]) == {2.0}
    assert path["symbols"][0] > path["symbols"][-1]  # one good document lies between


def test_verdicts_match_brute_force(spark, sf):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    rules, chosen = quality_rules.learn(docs, labels, 0.05, 0.05)
    got = {r["doc_id"]: r["kept"] for r in quality_rules.apply_quality_rules(docs, labels).collect()}
    for r in docs.collect():
        text = r["text"]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        chars, n = sum(map(len, words)), len(words)
        letters = re.findall(r"[a-z\x80-\U0010FFFF]+", text.lower())
        toxic = sum(w.encode() in rules.lexicon or len(w.encode()) > 6 and w.encode()[:6] + b"*" in rules.lexicon for w in letters)
        ratios = {
            "symbols": len(re.findall(r"[#*$%&|<>]", text)) / max(1, chars),
            "shouting": max(sum(map(str.isupper, text)) / max(1, chars), min(1, text.count("!") / max(1, n)) / 2),
            "repeats": brute_repeat_words(words) / max(1, n),
            "dup_lines": (len(lines) - len(set(lines))) / max(1, len(lines)),
            "toxic": toxic / max(1, n),
        }
        length = "length 450" if n >= 450 else "length 150" if n >= 150 else "length 0"
        levels = min(chosen[length][0], chosen[f"language {r['lang'] if r['lang'] in rules.languages else 'other'}"][0])
        want = n >= 20 and 100 * brute_repeat_words(words) <= 30 * n and not any(ratios[k] > c for k in ratios for c in rules.path[k][:levels])
        assert got[r["doc_id"]] == want, r["doc_id"]


def test_few_good_documents_are_rejected(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    chosen = quality_rules.power(docs, labels)
    assert all(admitted for s, (_, admitted, good) in chosen.items() if good > 200)
    seen = labels.filter("doc_id % 2 = 0")
    out = {r["doc_id"]: r for r in quality_rules.apply_quality_rules(docs, seen).select("doc_id", "kept", "base_failed", "rejected_by").collect()}
    held = [(out[r["doc_id"]], r) for r in labels.filter("doc_id % 2 = 1").collect()]
    good = [o for o, r in held if r["quality"] and not r["toxic"]]
    junk = [o["kept"] for o, r in held if not r["quality"]]
    assert np.mean([o["rejected_by"] is not None and not o["base_failed"] for o in good]) <= 0.05
    assert np.mean(junk) < 0.1


def test_copies_are_one_trial(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(i, text if i < 3000 else f"{text} {i}", "en", "s") for i in range(3060)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3060)], "doc_id long, quality int, toxic int")
    assert quality_rules.power(make(spark, rows), labels)["length 0"][2] <= 61


def test_quality_rules_keep_clean_documents(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "omega", "river", "stone", "cloud", "light", "paper"]
    good = lambda: " ".join(rng.choice(words) + str(rng.randint(0, 999)) for _ in range(60))
    rows = [(i, good() + (" " + "$$$$ %%%% " * 20 if i % 10 == 0 else ""), "en", "s") for i in range(4000)]
    labels = spark.createDataFrame([(i, 0 if i % 10 == 0 else 1, 0) for i in range(4000)], "doc_id long, quality int, toxic int")
    out = quality_rules.apply_quality_rules(make(spark, rows), labels).collect()
    assert not any(r["kept"] for r in out if r["doc_id"] % 10 == 0)
    assert all(r["kept"] for r in out if r["doc_id"] % 10)


# 2: sharding.


def test_rows_law_and_groups(spark, sf):
    docs = table(spark, sf, "documents")
    out = sharding.shard_documents(docs).collect()
    sizes = Counter(r["shard"] for r in out)
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    where = {}
    for r in out:
        t = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "rows", None)
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(x) == 1 for x in where.values())


def test_group_larger_than_a_shard(spark):
    rows = [(i, "same text" if i < 300 else f"text {i}", "en", "s") for i in range(480)]
    out = sharding.shard_documents(make(spark, rows)).collect()
    assert set(Counter(r["shard"] for r in out).values()) == {30}
    held = Counter(r["shard"] for r in out if r["doc_id"] < 300)
    assert sum(n for _, n in held.most_common(10)) >= 255  # ten shards hold 300 rows at best
    again = sharding.shard_documents(make(spark, rows)).collect()
    assert len(again) == 480


def test_all_linked_in_odd_groups(spark):
    rows = [(i, f"group {i // 7}", "en", "s") for i in range(331)]
    out = sharding.shard_documents(make(spark, rows)).collect()
    sizes = Counter(r["shard"] for r in out)
    assert len(out) == 331 and max(sizes.values()) - min(sizes.values()) <= 1


def test_several_hubs_pull_together(spark):
    links = spark.createDataFrame([(i, f"a{i // 4}") for i in range(64)] + [(i, f"b{i // 8}") for i in range(64)], "rid long, hub string")
    out = {r["rid"]: r["shard"] for r in sharding.propagate(links, [32] * 4, rounds=6).collect()}
    assert len(out) == 64 and max(Counter(out.values()).values()) <= 32
    cut = sum(out[a] != out[b] for g in range(16) for a, b in combinations(range(g * 4, g * 4 + 4), 2))
    assert cut <= 24


def test_deal_fills_exactly():
    rng = random.Random(5)
    for _ in range(200):
        room = [rng.randint(0, 9) for _ in range(6)]
        left, counts = sum(room), []
        while left:
            counts.append(rng.randint(0, left))
            left -= counts[-1]
        rows = sharding.deal(counts, room)
        assert [sum(r) for r in rows] == counts and [sum(c) for c in zip(*rows, strict=True)] == room if rows else not sum(room)


# 3: HTML.


def brute_cut(scores, edges):
    best = None
    for bits in range(1 << len(scores)):
        lab = [bits >> i & 1 for i in range(len(scores))]
        cost = sum(abs(s) for s, x in zip(scores, lab, strict=True) if (s > 0) != bool(x) and s) + sum(w for a, b, w in edges if lab[a] != lab[b])
        best = cost if best is None else min(best, cost)
    return best


def test_min_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randint(1, 9)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 2)) for _ in range(rng.randint(0, 14))]
        edges = [e for e in edges if e[0] != e[1]]
        lab = html_cut.min_cut(scores, edges)
        cost = sum(abs(s) for s, x in zip(scores, lab, strict=True) if (s > 0) != x) + sum(w for a, b, w in edges if lab[a] != lab[b])
        assert cost == pytest.approx(brute_cut(scores, edges))


def test_article_of_stored_pages(spark, sf):
    from html import unescape

    pages = table(spark, sf, "pages")
    got = {r["page_id"]: r for r in html_cut.extract_main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        want = re.sub(r"\s+", " ", unescape(re.sub("<[^>]*>", " ", re.sub(r"</?b>", "", inner)))).strip()
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


PAGE = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<div id="top-nav" class="menu"><a href="/">Home</a> <a href="/b">About us</a></div><header class="site-header"><p>The Daily Site, all the news that fits a small site header.</p></header>
<div class="content"><h1>A title of an article</h1><p>The first paragraph is long enough to be prose, with commas, and it ends properly.</p>
<div class="ad-box">Buy now, very cheap, while stocks last and the offer stands.</div><p>Second &eacute; paragraph &lt;tag&gt; with &#8220;quotes&#8221; goes on for a good while as well.</p>
<form><label>Your mail address please</label><input></form></div>
<aside><p>Related reading: ten other long articles which you may like as much as this one.</p></aside>
<div id="comments"><p>I read the whole article and have an opinion about it that I share here at length.</p></div>
<div class="cookie-notice"><p>We use cookies on this site to improve your experience, and so on and on.</p></div><footer><p>Copyright and a long list of legal sentences that nobody reads.</p></footer></body></html>"""


def test_boilerplate_goes_and_prose_stays():
    want = "A title of an article The first paragraph is long enough to be prose, with commas, and it ends properly. Second é paragraph <tag> with “quotes” goes on for a good while as well."
    assert html_cut.main_text(PAGE) == want


ARTICLE = "<html><body><article><h1>A title of an article</h1><p>The first paragraph is long enough to be prose, with commas, and it ends properly.</p>{}<p>And the last paragraph is prose as well, at some length, and it ends here.</p></article>{}</body></html>"
LONG = "This is quite a long text, of several clauses, which reads like prose, goes on for a while, and ends as prose does, with a full stop."


@pytest.mark.parametrize(
    "inside, after",
    [
        ("", f'<section id="comments"><article class="comment"><p>{LONG}</p><p>{LONG}</p></article></section>'),
        (f"<aside><p>{LONG}</p></aside>", ""),
        (f'<div class="advert"><p>{LONG}</p></div>', ""),
        (f"<form><p>{LONG}</p><label>{LONG}</label></form>", ""),
        (f"<footer><p>{LONG}</p></footer>", ""),
        (f'<div class="comments"><div class="content"><p>{LONG}</p></div></div>', f"<main><footer><p>{LONG}</p></footer></main>"),
    ],
)
def test_boilerplate_inside_an_article_goes(inside, after):
    want = "A title of an article The first paragraph is long enough to be prose, with commas, and it ends properly. And the last paragraph is prose as well, at some length, and it ends here."
    assert html_cut.main_text(ARTICLE.format(inside, after)) == want


def test_an_article_in_a_wrapper_named_after_its_sidebar_stays():
    page = f'<body><div class="has-sidebar"><main><p>{LONG}</p><p>Short one.</p></main><div class="sidebar"><a href="/">Home</a></div></div></body>'
    assert html_cut.main_text(page) == f"{LONG} Short one."


def plain_pages(spark, sf):
    """Stored articles in plain markup without telling elements or names: (html, content paragraphs, boilerplate blocks)."""
    rng = random.Random(4)
    for r in table(spark, sf, "pages").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        own = [" ".join(re.sub("<[^>]*>", " ", x).split()) for x in re.split(r"<p>|<br>", inner)]
        own = [x for x in own if x and "&" not in x]
        words = " ".join(own).split()
        if len(own) < 3:
            continue
        menu = [rng.choice(words) for _ in range(8)]
        low = [" ".join(rng.choices(words, k=4)) for _ in range(4)] + [" ".join(rng.choices(words, k=9)) + "."]
        parts = [f"<div>{x}</div>" + ('<div><a href="/x">more</a></div>' if rng.random() < 0.2 else "") for x in own]
        html = "<div><div>" + "".join(f'<div><a href="/{w}">{w}</a></div>' for w in menu) + "</div><div>" + "".join(parts) + "</div><div><div>" + "</div><div>".join(low) + "</div></div></div>"
        yield html, own, [*menu, *low]


def test_the_cut_betters_the_classifier(spark):
    sf = "/root/testdata/sf0.01"
    costs = html_cut.fit_costs(table(spark, sf, "pages"))
    scores, flipped, total = {}, 0, 0
    for smooth in (True, False):
        hit = false = missed = 0
        for html, own, _ in plain_pages(spark, sf):
            labelled = html_cut.label_blocks(html, costs, smooth)
            content = Counter(own)
            for b, kept in labelled:
                wanted = content[b.text] > 0
                content[b.text] -= wanted
                hit, false, missed = hit + (kept and wanted), false + (kept and not wanted), missed + (wanted and not kept)
                if smooth:
                    total += 1
                    flipped += kept != (html_cut.log_odds(b, costs) > 0)
        scores[smooth] = 2 * hit / (2 * hit + false + missed)
    assert flipped > 0.01 * total
    assert scores[True] > scores[False] > 0.5, scores


def test_costs_are_fitted_and_fall_with_distance(spark, sf):
    costs = html_cut.fit_costs(table(spark, sf, "pages"))
    assert costs != html_cut.Costs() and list(costs.edges) == sorted(costs.edges, reverse=True) and costs.text[1] > 0 > costs.text[2]
    nothing = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_cut.fit_costs(nothing).text == html_cut.Costs().text


def test_flow_of_a_large_page_ends(spark):
    rng = random.Random(6)
    n = 20_000
    scores = [rng.uniform(-1, 1) for _ in range(n)]
    edges = [(i, i + 1, 0.7) for i in range(n - 1)] + [(i, i + 3, 0.4) for i in range(0, n - 3, 2)]
    assert len(html_cut.min_cut(scores, edges)) == n


# 4: decontamination.


def brute_contamination(text, items):
    words = decontaminate.words_of(text)
    hit, found = set(), set()
    for item, t in items:
        for w in decontaminate.windows_of(decontaminate.words_of(t)):
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_contamination_matches_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("a b c d e f É zz Q1 x-y".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 13, 20])))) for i in range(8)]
    docs = [(i, " ".join([word() for _ in range(rng.randint(0, 60))] + items[i % 8][1].upper().split() * (i % 2) + [word() for _ in range(9)]), "en", "s") for i in range(60)]
    out = decontaminate.contamination(make(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    texts = {d[0]: d[1] for d in docs}
    for r in out:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == brute_contamination(texts[r["doc_id"]], items)
        assert r["contaminated"] == (r["n_hit"] > 0 and 20 * r["n_hit"] >= r["n_words"])


def test_large_vocabularies_use_the_bit_map(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MOST_WORDS", 2)
    items = [(1, "red green blue white black"), (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen")]
    docs = [(1, "x red green blue white black y", "en", "s"), (2, "one two three four five six seven eight nine ten eleven twelve", "en", "s")]
    out = {r["doc_id"]: r["n_hit"] for r in decontaminate.contamination(make(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert out == {1: 5, 2: 0}


# 5: languages.


def test_held_out_languages(spark, sf):
    docs = table(spark, sf, "documents")
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    rows = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert rows and all(got[r["doc_id"]]["held_out"] for r in rows)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows]) > 0.95
    assert all(0 <= g["score"] <= 1 for g in got.values())


def test_filter_has_no_false_negatives_and_many_languages():
    rng = np.random.default_rng(0)
    keys = [rng.integers(0, 1 << 62, 300, dtype=np.uint64) for _ in range(70)]
    f = langid.MaskFilter([f"l{i:02}" for i in range(70)], keys)
    for n, own in enumerate(keys):
        assert ((f.masks(own)[n // f.width] >> f.table.dtype.type(n % f.width)) & f.table.dtype.type(1)).all()


# 6: repeats.


def brute_repeats(texts, size=200):
    raw = {k: t.encode() for k, t in texts.items()}
    seen = Counter(b[i : i + size] for b in raw.values() for i in range(len(b) - size + 1))
    out = {}
    for k, b in raw.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                gone[i : i + size] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out[k] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


def test_repeats_match_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    piece = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [piece(n) for n in (199, 200, 201, 260, 700, 1500)]
    texts = {i: "".join(piece(rng.randint(0, 150)) + rng.choice(shared) for _ in range(rng.randint(0, 5))) + piece(20) for i in range(60)}
    texts |= {100: "z" * 900, 101: "ab" * 400, 102: shared[4] * 3, 103: shared[5][:900], 104: shared[5][300:]}
    docs = make(spark, [(k, t, "en", "s") for k, t in texts.items()])
    want = brute_repeats(texts)
    for many, pieces in ((3000, 1 << 18), (1, 300)):  # the second cuts anchors further and texts into pieces
        monkeypatch.setattr(suffix_dedup, "MANY", many)
        monkeypatch.setattr(suffix_dedup, "PIECE", pieces)
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs).collect()}
        assert got == want


def test_difference_cover_ranks_sort_suffixes():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 120))
        x = rng.integers(1, 3, n).astype(np.int64)
        assert list(np.argsort(suffix_dedup.dc_ranks(x, 6), kind="stable")) == sorted(range(n), key=lambda i: list(x[i:]))


# 7: PII.

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, p in BASE.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 8 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_the_plain_patterns(spark, sf):
    rng = random.Random(7)
    bits = ["a@b.co", "@x.y", "u@x.y@z.w", "a@b", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "4111 1111-1111 1111", "+1 (555) 555-0199", "+12", " ", "x", ".", "-", "7", "+", "@", "%", "\n", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(3000)] + [r["text"] for r in table(spark, sf, "documents").collect()]
    for t in texts:
        assert pii.base_spans(t) == plain_base(t), t


CASES = [
    ("write to john dot smith at example dot com today", "email", "john dot smith at example dot com"),
    ("mail jane [at] example.com now", "email", "jane [at] example.com"),
    ("mail ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ now", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("mail jаne@exаmple.com now", "email", "jаne@exаmple.com"),
    ("call plus one five five five one two three four five six seven ok", "phone", "plus one five five five one two three four five six seven"),
    ("pay four one one one one one one one one one one one one one one one thanks", "card", "four one one one one one one one one one one one one one one one"),
    ("host one nine two dot one six eight dot one dot one up", "ip", "one nine two dot one six eight dot one dot one"),
    ("a​@​b.co", "email", "a​@​b.co"),
    ("host 192[.]168[.]1[.]1 is up", "ip", "192[.]168[.]1[.]1"),
    ("host 192 (dot) 168 dot 1 [.] 1 is up", "ip", "192 (dot) 168 dot 1 [.] 1"),
    ("host 1 9 2 . 1 6 8 . 1 . 1 is up", "ip", "1 9 2 . 1 6 8 . 1 . 1"),
    ("pay 4111-one one one one-1111-1111 now", "card", "4111-one one one one-1111-1111"),
    ("call +one (two) three four five six seven eight nine now", "phone", "+one (two) three four five six seven eight nine"),
    ("call plus four four double seven one two three four five ok", "phone", "plus four four double seven one two three four five"),
    ("call plus forty-two twenty-one one two three four ok", "phone", "plus forty-two twenty-one one two three four"),
    ("Ruf an: plus neunundvierzig eins zwei drei vier fünf sechs bitte", "phone", "plus neunundvierzig eins zwei drei vier fünf sechs"),
    ("mail bob&#64;example.com now", "email", "bob&#64;example.com"),
    ("mail bob%40example.com now", "email", "bob%40example.com"),
    ("mail b o b at mail dot org now", "email", "b o b at mail dot org"),
    ("mail b o b @ m a i l . o r g", "email", "b o b @ m a i l . o r g"),
    ("mail " + "x" * 90 + " [at] a.b.c.d.e.f.g.h.example.com now", "email", "x" * 90 + " [at] a.b.c.d.e.f.g.h.example.com"),
]


@pytest.mark.parametrize(("text", "kind", "found"), CASES)
def test_disguises_map_back_to_the_source(text, kind, found):
    base, added = pii.find_spans(text)
    assert [(k, text[a:b]) for k, a, b in base + added] == [(kind, found)]


def test_clean_text_gains_nothing(spark, sf):
    plain = ["look at me dot dot dot ok", "good at math dot or", "look at example dot com", "see 50% of 240 and A&B", "1. one 2. two 3. three", "in 1 . 2 . 3 . 4 we show", "twenty two of them, forty-two in all"]
    for t in ["meet at noon, dot the i", "six sept huit neuf", "one, two or three of them", "at example.com we ship", *plain] + [r["text"] for r in table(spark, sf, "documents").limit(50).collect()]:
        assert pii.find_spans(t)[1] == []


def disguise(rng, kind):
    """(disguised, plain) of a random identifier."""
    words = "zero one two three four five six seven eight nine".split()
    say = lambda digits: " ".join(words[int(d)] for d in digits)
    if kind == "email":
        name, host, end = rng.choice(["ann", "bob.lee", "carl_77", "dora-x"]), rng.choice(["mail", "post.example", "corp"]), rng.choice(["com", "org", "de", "co.uk"])
        at, dot = rng.choice([(" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("&#64;", "."), ("%40", "."), ("＠", "．"), (" {at} ", ".")])
        return f"{name.replace('.', dot if dot.strip() else '.')}{at}{f'{host}.{end}'.replace('.', dot)}"
    if kind == "ip":
        parts = [str(rng.randint(0, 255)) for _ in range(4)]
        return rng.choice([" dot ".join(parts), "[.]".join(parts), " dot ".join(map(say, parts)), "(dot)".join(parts), " . ".join(" ".join(p) for p in [*parts[:3], "250"])])
    if kind == "card":
        digits = "".join(str(rng.randint(0, 9)) for _ in range(15))
        digits = next(digits + c for c in "0123456789" if pii.luhn(digits + c))
        return rng.choice([say(digits), f"{digits[:4]} {say(digits[4:8])} {digits[8:12]} {digits[12:]}", "-".join([digits[:4], say(digits[4:8]), digits[8:12], digits[12:]])])
    digits = "".join(str(rng.randint(1, 9)) for _ in range(rng.randint(9, 12)))
    return rng.choice(["plus " + say(digits), "+" + say(digits), f"+{digits[:2]} {say(digits[2:6])} {digits[6:]}", f"plus ({say(digits[:3])}) {say(digits[3:])}"])


def test_recall_and_precision_of_added_spans(spark, sf):
    rng = random.Random(12)
    prose = [w for r in table(spark, sf, "documents").filter("lang = 'en'").limit(60).collect() for w in re.findall(r"[A-Za-z]{2,}", r["text"])]
    prose += "look at the dot on the i and meet me at noon or at home one two or three of them good at math dot".split() * 20
    hits = wanted = found = 0
    for _ in range(1500):
        kind = rng.choice(pii.KINDS) if rng.random() < 0.6 else None
        before, after = " ".join(rng.choices(prose, k=12)), " ".join(rng.choices(prose, k=12))
        # a word of its own on either side, so that where a disguise ends isn't a matter of taste
        own = disguise(rng, kind) if kind else "nothing"
        text = f"{before} is: {own}; {after}"
        base, added = pii.find_spans(text)
        spans = [(k, text[a:b]) for k, a, b in base + added]
        wanted += kind is not None
        found += len(spans)
        hits += (kind, own) in spans
    assert hits / wanted > 0.9 and hits / found > 0.95, (hits, wanted, found)


def test_long_disguises_cost_no_more(spark):
    import time

    t = time.perf_counter()
    for text in ("a dot " * 40_000, "a at " * 40_000, "b o " * 40_000, "one-" * 40_000, "1 . " * 40_000, "&#" * 60_000, "[at]" * 40_000, "x" * 200_000 + " [at] "):
        pii.find_spans(text)
    assert time.perf_counter() - t < 20


def test_redaction_and_digest(spark):
    docs = make(spark, [(1, "a@b.co or 1.2.3.4", "en", "s")])
    assert pii.redact(docs).first()["text"] == "<email> or <ip>"
    row = pii.pii_digest(docs).first()
    assert row["spans"] == "email:0:6,ip:10:17" and row["base_sha256"] == hashlib.sha256(row["spans"].encode()).hexdigest() and (row["n_email"], row["n_ip"], row["n_card"]) == (1, 1, 0)


# 8: n-gram join.


def test_links_match_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(rng.choice([3, 30, 80]))] for _ in range(12)]
    rows = []
    for i in range(150):
        words = list(base[i % 12])
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 9)}"
        rows.append((i, " ".join(words), "en", "s"))
    sets = {i: set(map(tuple, (t.split()[k : k + 5] for k in range(max(1, len(t.split()) - 4))))) for i, t, _, _ in rows}
    links, parent = Counter(), {i: i for i in sets}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a, b in combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    for block in (256, 4):  # the second cuts clusters and buckets into blocks
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.jaccard_classes(make(spark, rows), block=block, bucket_block=block).collect()}
        assert got == {i: (root(i), links[i]) for i in sets}


def test_a_shared_footer_ties_nothing(spark):
    from webloom.llm.common import written

    footer = " ".join(f"foot{i}" for i in range(120))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(100 + i % 30)) + " " + footer, "en", "s") for i in range(3000)]
    rows += [(5000 + i, rows[i][1] + " tail", "en", "s") for i in range(20)]
    signed = ngram_join.signatures(make(spark, rows))
    classes = written(signed.select(F.xxhash64("node").alias("short"), "size", "bands", "sig"), "t")
    buckets = classes.select("short", F.explode("bands").alias("key")).groupBy("key").count().filter("count > 2").count()
    ties = ngram_join.candidate_ties(classes, 0.8, ngram_join.fewest_matches()).distinct().collect()
    assert buckets > 10 and len(ties) == 20  # buckets hold false candidates, and none of them survives


def test_pruning_rarely_loses_a_link():
    least = ngram_join.fewest_matches()
    rng = np.random.default_rng(0)
    lost = 0
    for _ in range(20_000):
        equal = rng.random(ngram_join.BANDS * ngram_join.ROWS) < 0.8
        lost += any(equal[:n].sum() < m for n, m in least.items())
    assert lost <= 4


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 201)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(41)) and all(out[100 + k] == 100 for k in range(30)) and out[201] == 200 and len(out) == 73


# 9: mixing.


def fill(sizes, weights=(5, 2, 1), cap=3):
    """Water-filling step by step: clamp what is above its cap, reshare the rest by weight."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed = {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = sum(sizes.values()) - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix_meets_its_targets(spark):
    rng = random.Random(9)
    for trial in range(3):
        rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40])) if rng.random() > 0.05 else None, "en", rng.choice(["a", "b", "B", "é", None, "z"][: 3 + trial])) for i in range(300)]
        out = mixing.mix(make(spark, rows)).collect()
        size = {i: len((t or "").split()) for i, t, _, _ in rows}
        src = {i: s for i, _, _, s in rows}
        totals = Counter()
        for i in size:
            totals[src[i]] += size[i]
        want = fill({s: totals[s] for s in set(src.values())})
        taken = Counter()
        for r in out:
            assert r["size"] == size[r["doc_id"]] and r["source_size"] == totals[src[r["doc_id"]]] and 0 <= r["taken"] <= 3 * r["size"]
            assert r["target"] == pytest.approx(want[src[r["doc_id"]]])
            taken[src[r["doc_id"]]] += r["taken"]
        assert all(abs(taken[s] - want[s]) <= 1 for s in want)
        assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.mix(make(spark, rows)).collect()), key=str)


def test_mixed_documents_hold_what_is_taken(spark):
    rows = [(i, "  one two\tthree  four\nfive ", "en", "abc"[i % 3]) for i in range(60)]
    docs = make(spark, rows)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    words = Counter()
    for r in mixing.mixed_documents(docs).collect():
        words[r["doc_id"]] += len(r["text"].split())
        assert r["text"] == rows[0][1] or "one two\tthree  four\nfive".startswith(r["text"])
    assert words == Counter({k: v for k, v in taken.items() if v})


def test_mix_plan_is_native(spark):
    docs = make(spark, [(1, "a b", "en", "s")])
    for df in (mixing.mix(docs), mixing.mixed_documents(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# 10: weak labels.


def test_em_finds_the_accuracies():
    rng = np.random.default_rng(3)
    truth = rng.random(20_000) < 0.2
    accuracy = [0.95, 0.8, 0.7, 0.9]
    pattern = np.zeros(len(truth), np.int64)
    for k, a in enumerate(accuracy):
        right = rng.random(len(truth)) < a
        vote = np.where(right == truth, weak_quality.BAD, weak_quality.GOOD)
        vote[rng.random(len(truth)) < 0.2] = weak_quality.ABSTAIN
        pattern += vote * 3**k
    ids, counts = np.unique(pattern, return_counts=True)
    post, estimated, prior = weak_quality.em(ids, counts.astype(float), 4)
    assert prior == pytest.approx(0.2, abs=0.03)
    for k, a in enumerate(accuracy):
        assert estimated[k, 1, weak_quality.BAD] / (1 - estimated[k, 1, weak_quality.ABSTAIN]) == pytest.approx(a, abs=0.05)
    assert np.mean((post[np.searchsorted(ids, pattern)] > 0.5) == truth) > 0.93


def direct_em(rows, n, trusted, rounds=200):
    """The same model, document by document."""
    post = []
    for v in rows:
        bad, good = v.count(weak_quality.BAD), v.count(weak_quality.GOOD)
        post.append(min(0.98, max(0.02, 1 - 0.4**bad if bad else 0.3 / (good + 1))))
    for _ in range(rounds):
        post = [{weak_quality.BAD: 0.99, weak_quality.GOOD: 0.01}.get(v[trusted], p) for v, p in zip(rows, post, strict=True)]
        table = [[[4.0, 16.0, 4.0], [4.0, 4.0, 16.0]] for _ in range(n)]
        for v, p in zip(rows, post, strict=True):
            for k in range(n):
                table[k][0][v[k]] += 1 - p
                table[k][1][v[k]] += p
        prior = min(0.5, max(0.001, (sum(post) + 1) / (len(rows) + 2)))
        post = []
        for v in rows:
            odds = prior / (1 - prior)
            for k in range(n):
                if k != trusted:
                    odds *= table[k][1][v[k]] / sum(table[k][1]) / (table[k][0][v[k]] / sum(table[k][0]))
            post.append(odds / (1 + odds))
    return [{weak_quality.BAD: 0.99, weak_quality.GOOD: 0.01}.get(v[trusted], p) for v, p in zip(rows, post, strict=True)]


def test_em_matches_a_direct_version_on_real_votes(spark):
    from webloom.llm.common import written

    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), quality_rules.clean_labels(table(spark, sf, "labels"))
    measured = written(weak_quality.measures(docs, weak_quality.lexicons(docs, labels, 1000)).withColumn("rid", F.monotonically_increasing_id()), "t")
    voted = weak_quality.weak_labels(measured, labels, weak_quality.learned_cutoffs(measured, labels, 1000)).collect()
    for name, labellers in (("junk", weak_quality.JUNK), ("toxic", weak_quality.TOXIC)):
        n = len(labellers)
        rows = [[r[name] // 3**k % 3 for k in range(n)] for r in voted]
        post, _ = weak_quality.posteriors(Counter(r[name] for r in voted), labellers)
        assert [post[r[name]] for r in voted] == pytest.approx(direct_em(rows, n, n - 1), abs=1e-4)


def test_labels_that_were_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = {r["doc_id"]: r["kept"] for r in weak_quality.classify(docs, labels.filter("doc_id % 2 = 0")).collect()}
    held = [r for r in labels.collect() if r["doc_id"] % 2]
    assert np.mean([got[r["doc_id"]] for r in held if not r["quality"]]) < 0.1
    assert np.mean([got[r["doc_id"]] for r in held if r["toxic"]]) < 0.1
    assert np.mean([got[r["doc_id"]] for r in held if r["quality"] and not r["toxic"]]) > 0.95
