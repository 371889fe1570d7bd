"""The corpus operators: edge cases, brute force and round trips on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ndspark.llm import archives, decontaminate, embedding_dedup, html_text, language_id, licenses, mixing, near_dup, passage_dedup, quality
from ndspark.llm.common import Scratch, WordHashes, connected_components, overlaps, shingles, words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, component string, id string"
WORDS = ["".join(random.Random(i).choices("abcdefghijklmnopqrstuvwxyz", k=4 + i % 5)) for i in range(3000)]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = r.choices(WORDS, k=n)
    for i in range(0, n, 9):
        words[i] = words[i].capitalize()
        words[max(0, i - 1)] += "."
    return " ".join(words)


def edited(text: str, every: int, seed: int = 0) -> str:
    r, words = random.Random(seed), text.split()
    for i in range(every, len(words), every):
        words[i] = r.choice(WORDS)
    return " ".join(words)


def table(spark, texts, first=0):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(first + i, t, "en", f"s{i % 2}", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


AWKWARD = [None, "", " ", "\n\n", "a", "A. B. C.", "é" * 50_000, "word " * 20_000, "\u0000 ퟿", "!!! ???", prose(1, 60), prose(1, 60)]


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ---- near duplicates ----------------------------------------------------------------------


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance_is_the_plain_one():
    r = random.Random(3)
    for _ in range(1500):
        a = [r.randrange(3) for _ in range(r.randrange(15))]
        b = list(a)
        for _ in range(r.randrange(6)):
            if b and r.random() < 0.5:
                b.pop(r.randrange(len(b)))
            else:
                b.insert(r.randrange(len(b) + 1), r.randrange(3))
        most, plain = r.randrange(9), levenshtein(a, b)
        assert near_dup.edit_distance(np.array(a, np.uint32), np.array(b, np.uint32), most) == min(plain, most + 1)


def test_order_matters_to_the_sketch():
    h = WordHashes().of(prose(5, 200).split())
    first, same, turned = near_dup.order_min_hashes(np.concatenate([h, h, h[100:], h[:100]]), np.array([200, 400, 600]), 60)
    assert (first == same).all() and (first == turned).mean() < 0.8


def plain_sketch(words, sketches, k=5, picked=2):
    """Order MinHash of one text without arrays over several texts."""
    from ndspark.llm import common

    h = WordHashes().of(words)
    g = common.windows(h, k) if len(h) >= k else common.windows(np.concatenate([h, np.repeat(h[-1:], k - len(h))]), k)
    seen, labelled = {}, []
    for x in g:
        n = seen[int(x)] = seen.get(int(x), -1) + 1
        labelled.append(common.mix(x + np.uint64(n) * near_dup._C) if n else x)
    out = []
    for m, s in zip(common.seeds(sketches, 1), common.seeds(sketches, 2)):
        order = []
        for i, x in enumerate(labelled):
            y = (x ^ s) * m
            y ^= y >> np.uint64(29)
            order.append((int(y * near_dup._C) >> 28, i))
        at, acc = sorted(i for _, i in sorted(order)[:picked]), np.zeros(1, np.uint64)
        for i in [*at, *[None] * (picked - len(at))]:
            acc = common.mix(acc * near_dup._C + np.array([0 if i is None else labelled[i]], np.uint64) + np.uint64(1))
        out.append(int(common.mix(acc ^ s).view(np.int64)[0]))
    return out


def test_sketches_of_many_texts_are_those_of_each():
    texts = [words_of(t) for t in ("a b a b a b a b a b a b", "one two", "", prose(3, 40), "x", prose(3, 40) + " more", "a b c d e")]
    h = WordHashes().of([w for t in texts for w in t])
    found = near_dup.order_min_hashes(h, np.cumsum([len(t) for t in texts]), 7)
    with np.errstate(over="ignore"):
        assert all(found[i].tolist() == (plain_sketch(t, 7) if t else [0] * 7) for i, t in enumerate(texts))


@pytest.mark.parametrize("similarity, least", [(0.8, 0.85), (0.85, 0.95), (0.9, 0.98), (0.95, 0.99), (1.0, 1.0)])
def test_recall_of_the_sketches(similarity, least):
    """Edits spread at random: substitutions, insertions and deletions."""
    hits, pairs = 0, 120
    for i in range(pairs):
        r = random.Random(i)
        a = [r.randrange(2**62) for _ in range(150)]
        b = list(a)
        for at in r.sample(range(150), round((1 - similarity) * 150)):
            b[at] = r.choice([[], [r.randrange(2**62)], [a[at], r.randrange(2**62)]]) if r.random() < 0.5 else [r.randrange(2**62)]
        b = [y for x in b for y in (x if isinstance(x, list) else [x])]
        x, y = near_dup.order_min_hashes(np.array(a + b, np.uint64), np.array([len(a), len(a) + len(b)]), near_dup.sketches_for())
        hits += (x == y).any()
    assert hits / pairs >= least


def test_signatures_bound_the_edits():
    from ndspark.llm.common import signatures

    r = random.Random(8)
    for _ in range(100):
        a = [r.randrange(2**63) for _ in range(200)]
        b = [x if r.random() < 0.8 else r.randrange(2**63) for x in a]
        sign = signatures(np.array(a + b, np.uint64), np.repeat([0, 1], 200), 2)
        assert np.bitwise_count(sign[0] & ~sign[1]).sum() <= len(set(a) - set(b))


def test_brute_force_over_the_whole_range_of_similarities(spark):
    """Groups of edited copies between 0.75 and 1: links of all pairs, and nearly all are found."""
    texts = []
    for g in range(25):
        base = prose(2000 + g, 120).split()
        texts.append(" ".join(base))
        for i, share in enumerate((0.02, 0.06, 0.1, 0.14, 0.18, 0.24)):
            r, w = random.Random(10 * g + i), list(base)
            for at in r.sample(range(120), round(share * 120)):
                w[at] = r.choice(WORDS)
            texts.append(" ".join(w))
    found = by_id(near_dup.near_duplicates(table(spark, texts)))
    words, label = [words_of(t) for t in texts], list(range(len(texts)))
    pairs = [(i, j) for g in range(25) for i in range(7 * g, 7 * g + 7) for j in range(7 * g, i)]
    links = [(i, j) for i, j in pairs if 1 - levenshtein(words[i], words[j]) / max(len(words[i]), len(words[j])) >= 0.8]
    for _ in range(7):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    together = sum(found[i]["component_id"] == found[j]["component_id"] for i, j in links)
    assert together >= 0.97 * len(links) and len(links) > 200
    assert all(label[found[i]["component_id"]] == label[i] for i in range(len(texts)))


def test_near_duplicates_match_brute_force(spark):
    texts = [prose(i, 120 + i) for i in range(12)]
    texts += [texts[0], texts[0].upper(), edited(texts[0], 40), edited(texts[1], 30), edited(edited(texts[1], 30), 50, 9), *AWKWARD]
    found = by_id(near_dup.near_duplicates(table(spark, texts)))
    assert len(found) == len(texts)
    words = [words_of(t) for t in texts]
    label = list(range(len(texts)))
    for _ in range(4):
        for i, a in enumerate(words):
            for j, b in enumerate(words[:i]):
                if a and b and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and len(a) < 1000 and (a == b or 1 - levenshtein(a, b) / max(len(a), len(b)) >= 0.8):
                    label[i] = label[j] = min(label[i], label[j])
    assert [found[i]["component_id"] for i in range(len(texts))] == label
    assert all(r["kept"] == (r["component_id"] == i) for i, r in found.items())


def test_a_large_group_that_only_chains(spark):
    texts = [edited(prose(7, 100), 24, i) for i in range(80)] + [prose(100 + i, 90) for i in range(20)]
    found = by_id(near_dup.near_duplicates(table(spark, texts)))
    assert {found[i]["component_id"] for i in range(80)} == {0}
    assert all(found[i]["kept"] for i in range(80, 100))


def test_rows_that_repeat_an_id(spark):
    rows = [(1, prose(1, 80)), (1, prose(2, 80)), (2, prose(2, 80)), (3, edited(prose(1, 80), 40)), (3, edited(prose(1, 80), 40)), (4, prose(4, 80))]
    found = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in found) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 4, True)]


def test_near_duplicates_of_nothing(spark):
    assert near_dup.near_duplicates(table(spark, []).limit(0)).count() == 0


def test_connected_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(50)] + [(200 + r.randrange(40), 200 + r.randrange(40)) for _ in range(30)]
    label = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    with Scratch(spark) as scratch:
        found = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert found == label


def test_overlaps_count_multisets():
    a, b = np.array([1, 1, 2, 3], np.uint64), np.array([1, 2, 2, 9], np.uint64)
    both, sizes = overlaps([a, b, np.zeros(0, np.uint64)])
    assert both[0, 1] == 2 and both[0, 0] == 4 and both[2].sum() == 0 and list(sizes) == [4, 4, 0]


# ---- language -----------------------------------------------------------------------------


def test_language_words_then_grams(spark):
    en, fr = ["the cat sat on the mat", "the dog is in the house"] * 20, ["le chat est dans la maison", "la maison est grande"] * 20
    rows = [(i, t, "en" if i < 40 else "fr") for i, t in enumerate(en + fr)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["en", "fr"]
    docs = table(spark, ["the cat", "le chat", "maisonette", "12 !", *AWKWARD])
    found = by_id(language_id.predict(docs, model))
    assert [found[i]["lang_pred"] for i in range(4)] == ["en", "fr", "fr", "und"]
    assert all(found[4 + i]["lang_pred"] == "und" for i in (0, 1, 2, 3, 9)) and found[3]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_language_without_anything_to_learn_from(spark):
    model = language_id.fit(spark.createDataFrame([(1, None, "en"), (2, "x", None)], "doc_id long, text string, lang string"))
    assert {r["lang_pred"] for r in language_id.predict(table(spark, ["hello", None]), model).collect()} == {"und"}


def test_language_model_is_counted_by_spark(spark):
    from collections import Counter

    texts = [("naïve cat 猫猫 𝔘x", "en"), ("cat a the", "en"), ("le chat 猫", "fr"), ("a", "fr")]
    model = language_id.fit(spark.createDataFrame([(i, *r) for i, r in enumerate(texts * 2)], "doc_id long, text string, lang string"))
    assert "row" not in vars(model.words) and not any("row" in vars(g) for g in model.grams)  # the driver holds no dictionaries
    words = [(w, k) for text, k in texts * 2 for w in language_id.LETTERS.findall(text.lower())]
    for n in range(6):
        made = Counter((g, k) for w, k in words for g in (language_id._grams(w, n) if n else [w]))
        logs, names = (model.grams[n - 1] if n else model.words), sorted({g for g, _ in made})
        counts = np.array([[made[g, k] for k in ("en", "fr")] for g in names], float)
        assert sorted(logs.names.to_pylist()) == names
        assert np.allclose([logs.matrix[logs.row[g]] for g in names], np.log((counts + 0.5) / (counts.sum(0) + 1 + 0.5 * len(names))))


def test_held_out_is_a_fifth_by_checksum(spark):
    import zlib

    rows = spark.range(200).select(F.col("id").alias("doc_id")).withColumn("h", language_id.held_out())
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows.collect())


# ---- pages --------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies and it is the law of the land.</div>
<article><h1>A &amp; B</h1><p><b>First &lt;para&gt; with   spaces<br><p>Short.</p><aside>Side of the story</aside><form>Name <input></form>
<div class="comments"><p>The reader says that it is the best of all.</p></div><!-- hidden <p>no</p> --></article><footer>&copy; X</footer></body></html>"""


def test_article_text():
    assert html_text.main_text(PAGE) == "A & B\nFirst <para> with spaces\nShort."


def test_a_script_does_not_close_itself():
    assert html_text.main_text("<article><p>One text.</p><script src=/a/b/>var x = 1;</script><svg/><p>Two of it.</p></article>") == "One text.\nTwo of it."


def test_marked_paragraphs_and_articles():
    page = """<header><h2>Site</h2></header><main><article class="post"><p class="ad-banner">Buy it now</p><p>The text of it.</p><div id="sidebar">By the way</div></article>
    <article class="comment">I was the first to say that it is so.</article></main>"""
    assert html_text.main_text(page) == "The text of it."


def test_page_without_article_inherits_from_neighbours():
    long = "It is the story of the man that was in the house and of the dog that was with him. " * 4
    page = f"<body><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><p>{long}</p><p>Yes.</p><p>{long}</p><div><a href=3>Imprint</a></div></body>"
    assert html_text.main_text(page).split("\n")[1] == "Yes."
    assert "Imprint" not in html_text.main_text(page) and "One" not in html_text.main_text(page)


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "a < b", "<script>", "</p></div>", "<a " + "'" * 50, "<p>" * 2000, "&#x110000;&bogus;"])
def test_broken_pages(page):
    assert isinstance(html_text.main_text(page), str)


def test_pages_of_a_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (2, None, None, "x")], "page_id long, url string, html string, text string")
    rows = html_text.extract(pages).orderBy("page_id").collect()
    assert [r["n_chars"] for r in rows] == [len(rows[0]["text"]), 0, 0] and rows[1]["text"] == ""


# ---- mixing -------------------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), total=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] if sizes[s] else 0 for i, s in enumerate(names)}
    left, open_, out = total * sum(sizes.values()), {s for s in names if sizes[s]}, dict.fromkeys(names, 0.0)
    while open_:
        share = {s: left * weight[s] / sum(weight[t] for t in open_) for s in open_}
        full = {s for s in open_ if share[s] >= most * sizes[s]}
        if not full:
            out |= share
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixture(spark):
    r = random.Random(4)
    rows = [(i, " ".join(["w"] * r.randrange(1, 60)), r.choice(["a", "b", "c", "d", None, "é"])) for i in range(800)]
    rows += [(1000, None, "a"), (1001, "", "empty"), (None, "x y", "a"), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = plain_targets(sizes)
    taken = {}
    for x in found:
        assert x["source_size"] == sizes[x["source"]] and x["taken"] <= 2 * x["size"]
        assert x["target"] == pytest.approx(want[x["source"]])
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))


def test_inclusion_follows_the_odds(spark):
    """Over many seeds a document is sampled about as often as its inclusion odds say, and the sample keeps its size."""
    r = random.Random(9)
    rows = [(i, " ".join(["w"] * r.choice([5, 20, 80])), "a") for i in range(120)] + [(1000, " ".join(["w"] * 4000), "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    sizes = {i: len(t.split()) for i, t, s in rows if s == "a"}
    total, seen, seeds = sum(sizes.values()), dict.fromkeys(sizes, 0), 24
    for seed in range(seeds):
        found = [x for x in mixing.mix(docs, weights=(1, 8, 1), total_share=0.4, seed=f"s{seed}").collect() if x["source"] == "a"]
        missing = found[0]["target"] % total
        assert abs(sum(x["taken"] for x in found) - found[0]["target"]) <= 80
        for x in found:
            seen[x["doc_id"]] += x["copies"] - int(x["target"] // total)
    low, high = 1e-6, 1e6
    for _ in range(100):
        scale = (low * high) ** 0.5
        p = {i: scale * n**0.5 / (1 + scale * n**0.5) for i, n in sizes.items()}
        low, high = (scale, high) if sum(p[i] * n for i, n in sizes.items()) < missing else (low, scale)
    for n in (5, 20, 80):
        group = [i for i in sizes if sizes[i] == n]
        assert sum(seen[i] for i in group) / seeds / len(group) == pytest.approx(p[group[0]], abs=0.08), n


def test_mixture_of_nothing(spark):
    assert mixing.mix(table(spark, []).limit(0)).count() == 0


# ---- embeddings ---------------------------------------------------------------------------


def test_embedding_links_match_brute_force(spark):
    g = np.random.default_rng(2)
    base = g.standard_normal((30, 16))
    vectors = np.concatenate([base, base[:10] + 0.03 * g.standard_normal((10, 16)), np.repeat(base[:1], 5, 0), base[0] + 0.05 * g.standard_normal((60, 16))])
    labels = [0] * 45 + [0] * 50 + [1] * 10
    rows = [(i, v.tolist(), l, "x") for i, (v, l) in enumerate(zip(vectors, labels))]
    rows += [(200, None, 0, "x"), (201, [0.0] * 16, 0, "x"), (202, [float("nan")] * 16, 0, "x"), (203, base[0].tolist(), None, "x"), (204, [], 0, "x"), (205, [None] * 16, 0, "x"), (206, [1.0, 2.0], 0, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, h1 string")
    found = by_id(embedding_dedup.near_duplicates(df, block=16), "vec_id")
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    link = (unit @ unit.T >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(link, False)
    component = np.arange(len(vectors))
    for _ in range(len(vectors)):
        component = np.minimum(component, np.where(link, component[None, :], 10**9).min(1))
    for i in range(len(vectors)):
        assert (found[i]["n_links"], found[i]["component_id"]) == (link[i].sum(), component[i])
    assert all(found[i]["n_links"] == 0 and found[i]["kept"] for i in range(200, 207))
    assert all(embedding_dedup.missed(0.98, *embedding_dedup.parameters(n)) <= 1e-5 for n in (0, 10, 10**4, 10**9))


def test_embeddings_of_any_magnitude(spark):
    v = np.random.default_rng(4).standard_normal(16)
    rows = [(i, (v * m).tolist(), 1) for i, m in enumerate((1.0, 1e200, 1e-200, 1e307, -1.0))]
    found = by_id(embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")), "vec_id")
    assert [(found[i]["n_links"], found[i]["component_id"]) for i in range(5)] == [(3, 0)] * 4 + [(0, 4)]


def test_embeddings_of_nothing(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# ---- decontamination ----------------------------------------------------------------------


def test_contamination_matches_brute_force(spark):
    items = [(i, prose(500 + i, n)) for i, n in enumerate([3, 7, 16, 25, 40, 59, 120])] + [(50, None), (51, "")]
    texts = [prose(i, 300) for i in range(20)]
    for k, (i, item) in enumerate(items[:7]):
        words = texts[k].split()
        texts[k] = " ".join(words[:100] + [item.upper() if k % 2 else item] + words[100:])
    texts[8] = texts[8] + " " + edited(items[6][1], 70)
    texts[9] = items[6][1][: len(items[6][1]) // 2]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(table(spark, texts + AWKWARD), spark.createDataFrame(items, "item_id long, text string"), block_words=60).collect()}
    assert found == {(i, i) for i in range(7)} | {(8, 6)}
    kept = decontaminate.without_contaminated(table(spark, texts), spark.createDataFrame(sorted(found), "doc_id long, item_id long"))
    assert {r["doc_id"] for r in kept.collect()} == set(range(20)) - {0, 1, 2, 3, 4, 5, 6, 8}


def test_hamming_index_finds_all_within_radius():
    g = np.random.default_rng(0)
    prints = g.integers(0, 2**63, 50, dtype=np.uint64)
    asked = prints.copy()
    for i in range(50):
        for bit in g.choice(64, i % 8, replace=False):
            asked[i] ^= np.uint64(1) << np.uint64(bit)
    left, right = decontaminate.HammingIndex(prints).probe(asked)
    assert set(range(50)) <= {int(a) for a, b in zip(left, right) if a == b}
    assert (np.bitwise_count(asked[left] ^ prints[right]) <= 7).all()


def test_long_items_and_many_equal_words(spark):
    """Counters hold more than 65,535 words, and a long item takes no longer than its length."""
    import time

    assert decontaminate.bit_sums(np.full(70_000, 2**64 - 1, np.uint64))[-1].tolist() == [70_000] * 64
    long = " ".join(random.Random(77).choices(WORDS, k=20_000))
    began = time.time()
    found = decontaminate.contaminated(table(spark, [prose(1, 500) + " " + long + " " + prose(2, 300), prose(3, 900)]), spark.createDataFrame([(1, long, "x", 5)], "item_id long, text string, id string, similarity int")).collect()
    assert [(r["doc_id"], r["item_id"], r["similarity"], r["start_word"]) for r in found] == [(0, 1, 1.0, 500)] and time.time() - began < 60


def test_sliding_counts_are_the_plain_ones():
    from collections import Counter

    r = random.Random(5)
    for _ in range(200):
        h = np.array([r.randrange(4) for _ in range(r.randrange(6, 60))], np.uint64)
        n = r.randrange(1, len(h) + 1)
        want = Counter(shingles(np.array([r.randrange(4) for _ in range(n)], np.uint64)).tolist())
        starts = sorted({r.randrange(len(h) - n + 1) for _ in range(5)})
        plain = []
        for s in starts:
            have = Counter(shingles(h[s : s + n]).tolist())
            both = sum((want & have).values())
            plain.append(both / (sum(want.values()) + sum(have.values()) - both))
        got, at = decontaminate.best_span(h, want, n, starts)
        assert got == pytest.approx(max(plain)) and (not got or plain[starts.index(at)] == pytest.approx(got))


def test_contamination_of_nothing(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(table(spark, ["a b c d e"]), empty).count() == 0


# ---- licences -----------------------------------------------------------------------------


def test_licences(spark):
    texts = ["Some text.\nLicensed under CC BY-NC 4.0.", "RELEASED under the MIT License!", "the MIT License is fine to talk about", "Licensed under the Apache License, Version 2.0.\nThis work is licensed under the GNU General Public License, version 3.", *AWKWARD]
    found = by_id(licenses.scan(table(spark, texts)))
    assert len(found) == len(texts)
    assert [found[i]["licences"] for i in range(4)] == [["CC-BY-NC-4.0"], ["MIT"], [], ["Apache-2.0", "GPL-3.0"]]
    assert all(found[4 + i]["licences"] == [] for i in range(len(AWKWARD)))


def test_the_shortcut_drops_no_sentence():
    assert all(any(sign in s for sign in licenses.SIGNS) for _, s in licenses.SENTENCES)


def test_rules_need_their_order(spark):
    a, b, c = (s for n, s in licenses.SENTENCES if n in ("gpl-free", "gpl-hope", "gpl-see"))
    found = by_id(licenses.scan(table(spark, [f"{a}.\n{b}. x y.\n{c}.", f"{c}.\n{b}.\n{a}."])))
    assert found[0]["rules"] == ["gpl-3.0-header"] and found[1]["rules"] == []
    assert all(x in {n for n, _ in licenses.SENTENCES} for _, _, ids in licenses.RULES for x in ids)


# ---- archives -----------------------------------------------------------------------------


def digest(payload):
    import hashlib

    return hashlib.sha256(payload).hexdigest()


def test_a_changed_payload_is_noticed():
    import io

    row = {"page_id": 1, "url": "u", "record_type": "response", "payload_digest": digest(b"abc"), "payload_bytes": 3, "refers_to": None}
    (content,) = archives.package([(row, b"abd")])
    with pytest.raises(ValueError, match="payload"):
        list(archives.read_file(io.BytesIO(content)))


@pytest.mark.parametrize("zip64", [False, True])
def test_package_round_trip(zip64, tmp_path):
    import zipfile

    rows = [({"page_id": i, "url": f"http://x/{i}", "record_type": "response", "payload_digest": digest(b"x" * (5 + i)), "payload_bytes": 5 + i, "refers_to": None}, b"x" * (5 + i)) for i in range(50)]
    (content,) = archives.package(rows, zip64=zip64)
    path = tmp_path / "a.wacz"
    path.write_bytes(content)
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {0}
    with path.open("rb") as f:
        back = list(archives.read_file(f, {3, 49}))
    assert [(r["page_id"], r["payload"]) for r in back] == [(3, b"x" * 8), (49, b"x" * 54)]


def test_only_ranges_are_read():
    rows = [({"page_id": i, "url": "u", "record_type": "response", "payload_digest": digest(random.Random(i).randbytes(2000)), "payload_bytes": 2000, "refers_to": None}, random.Random(i).randbytes(2000)) for i in range(200)]
    (content,) = archives.package(rows)
    read = []

    def read_at(at, n):
        read.append(n)
        return content[at : at + n]

    assert next(archives.read_package(read_at, len(content), {7}))["page_id"] == 7
    assert sum(read) < len(content) / 3


def test_archives_of_a_table(spark, tmp_path):
    big, small = "p" * 150, "p" * 20
    pages = spark.createDataFrame([(5, "u", big), (3, "u", big), (9, None, big), (1, "u", small), (2, "u", small), (7, "u", None), (8, "u\r\nX: y", "é" * 80)], "page_id long, url string, html string")
    found = by_id(archives.read_packages(archives.write_packages(archives.plan_records(pages), f"file:{tmp_path}", 300)), "page_id")
    assert {k: r["refers_to"] for k, r in found.items()} == {5: 3, 3: None, 9: 3, 1: None, 2: None, 7: None, 8: None}
    assert found[8]["payload_bytes"] == 160 and found[9]["payload_bytes"] == 150 and found[9]["payload"] is None
    assert bytes(found[8]["payload"]).decode() == "é" * 80
    assert archives.read_packages(archives.write_packages(archives.plan_records(pages.limit(0)), f"file:{tmp_path}")).count() == 0


def test_broken_packages():
    with pytest.raises(ValueError):
        archives.ZipRanges(lambda at, n: b"x" * n, 100)


# ---- quality ------------------------------------------------------------------------------


def test_quality_and_toxicity(spark):
    r = random.Random(6)
    texts, labels = [], []
    for i in range(600):
        t, bad, toxic = prose(i, 80), i % 4 == 0, i % 5 == 0
        if bad:
            t = " ".join(w + r.choice(["%%%", "###"]) for w in t.split())
        if toxic:
            t = t.replace(" ", " slurword ", 1) + " vileterm."
        texts.append(t)
        labels.append((i, int(not bad), int(toxic)))
    docs = table(spark, texts)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = by_id(quality.classify(docs, marks.where("doc_id < 300")))
    held = [(i, found[i]) for i in range(300, 600)]
    assert sum(x["accepted"] == (i % 4 != 0 and i % 5 != 0) for i, x in held) >= 295


def test_quality_edge_cases(spark):
    docs = table(spark, AWKWARD)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["accepted"] for r in quality.classify(docs, none).collect())
    odd = spark.createDataFrame([(0, 1, 0), (1, 1, None), (None, 0, 1), (10, None, None)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, odd).count() == len(AWKWARD)
    assert quality.classify(docs.limit(0), odd).count() == 0


def test_sparse_sites_shrink_to_the_global_rate(spark):
    rows = [("big", "en", 3.0)] * 400 + [("other", "en", -3.0)] * 400 + [("tiny", "fr", -3.0)]
    scored = spark.createDataFrame(rows, "site string, path string, logit_x double")
    out = {(r["site"]): r["p"] for r in quality.with_priors(scored, "logit_x", 0.5, "p").collect()}
    plain = 1 / (1 + np.exp(3.0))
    assert out["big"] > 0.99 and out["other"] < plain and out["other"] < out["tiny"] < 0.5


# ---- passages -----------------------------------------------------------------------------


def test_passages_inside_and_as_paragraphs(spark):
    passage, para = prose(900, 70), prose(901, 90).replace("\n", " ")
    texts = [prose(i, 150) for i in range(8)]
    for i in (1, 4, 6):
        words = texts[i].split()
        texts[i] = " ".join(words[:60]) + " " + passage + " " + " ".join(words[60:])
    for i in (2, 5):
        texts[i] += "\n" + para + "\nTail of text."
    texts[7] += "\n" + edited(para, 60)
    docs = table(spark, [*texts, *AWKWARD])
    removals, components = passage_dedup.repeated(docs)
    rows = by_id(passage_dedup.report(docs, removals, components))
    changed = {i for i, r in rows.items() if r["removed_words"]}
    # the two equal texts at the end are also the beginning of the second one
    assert changed == {4, 6, 5, 7, 18, 19}
    assert rows[4]["component_id"] == rows[6]["component_id"] == 1 and rows[5]["component_id"] == rows[7]["component_id"] == 2
    out = by_id(passage_dedup.remove(docs, removals))
    inner = passage.split(". ", 1)[1].rsplit(". ", 1)[0]
    assert sum(inner in (r["text"] or "") for r in out.values()) == 1
    assert sum(para in (r["text"] or "") for r in out.values()) == 1
    assert out[5]["text"].endswith("\nTail of text.") and out[5]["n_chars"] == len(out[5]["text"])
    assert all(out[i]["text"] == texts[i] for i in (0, 1, 2, 3)) and set(rows) - set(out) == {19}


def test_short_repeats_stay(spark):
    texts = [prose(i, 60) + "\nAll rights are reserved by the people who own them. Read the terms." for i in range(5)]
    removals, _ = passage_dedup.repeated(table(spark, texts))
    assert removals.count() == 0


def test_nothing_unverified_goes(spark):
    """What lies between repeated stock lines stays, and stock from different documents makes no passage."""
    header, footer, *stock = (" ".join(random.Random(700 + i).choices(WORDS, k=25)).capitalize() + "." for i in range(4))
    body = "\n".join(" ".join(random.Random(800 + i).choices(WORDS, k=4)).capitalize() + "." for i in range(12))
    texts = [f"{header}\n{prose(1, 60)}\n{footer}", f"{header}\n{body}\n{footer}", f"{stock[0]} {prose(2, 60)}", f"{stock[1]} {prose(3, 60)}", f"{prose(4, 60)} {stock[0]} {stock[1]} {prose(5, 60)}"]
    removals, _ = passage_dedup.repeated(table(spark, texts))
    assert removals.count() == 0


GERMAN = "Der Bundestag hat am Donnerstag über den Haushalt der Regierung beraten, und die Opposition warf dem Minister vor, die Lage der Gemeinden im Osten des Landes zu verkennen. Nach Angaben des Ministeriums fehlen den Städten und Kreisen in diesem Jahr rund sechs Milliarden Euro, vor allem für Schulen, Straßen und Krankenhäuser. Der Minister kündigte Gespräche mit den Ländern an, nannte aber keinen Termin und keine Summe für die Hilfe des Bundes."
SHORT = " ".join(" ".join(random.Random(500 + i).choices(WORDS, k=4)).capitalize() + "." for i in range(15))


@pytest.mark.parametrize("passage", [GERMAN, SHORT, GERMAN.title(), " ".join(random.Random(600).choices(WORDS, k=60))])
def test_passages_whatever_their_sentences(spark, passage):
    """Capital nouns, short sentences, title case and one long sentence, pasted into paragraphs that differ."""
    texts = [f"{prose(10 + i, 70)} {passage} {prose(20 + i, 70)}" for i in range(3)]
    docs = table(spark, texts)
    out = by_id(passage_dedup.remove(docs, passage_dedup.repeated(docs)[0]))
    assert [passage in out[i]["text"] for i in range(3)] == [True, False, False]
    assert out[0]["text"] == texts[0] and all(len(words_of(out[i]["text"])) in range(135, 147) for i in (1, 2))

def test_an_edited_sentence_is_bridged(spark):
    words = random.Random(610).choices(WORDS, k=60)
    changed = [*words[:30], "elsewise", *words[31:]]
    texts = [f"{prose(30 + i, 70)} {' '.join(w)} {prose(40 + i, 70)}" for i, w in enumerate((words, changed))]
    docs = table(spark, texts)
    out = by_id(passage_dedup.remove(docs, passage_dedup.repeated(docs)[0]))
    assert "elsewise" not in out[1]["text"] and len(words_of(out[1]["text"])) in range(138, 141) and out[0]["text"] == texts[0]


def test_edits_are_bridged_only_where_the_rest_agrees():
    h = WordHashes().of([f"w{i}" for i in range(400)])
    x, y, other = h[:100], h[100:200], h[200:]
    assert passage_dedup.shared_runs(np.concatenate([x[:30], other[:9], x[30:60]]), x) == [(0, 69)]
    assert passage_dedup.shared_runs(np.concatenate([x[:30], other[:20], x[30:60]]), x) == []
    assert passage_dedup.shared_runs(np.concatenate([x[30:60], x[:30]]), x) == []
    assert passage_dedup.shared_runs(np.concatenate([x[:30], y[:30]]), np.concatenate([x[:30], other[:9], y[:30]])) == [(0, 60)]
    assert passage_dedup.shared_runs(np.concatenate([y[:5], x[:41], y[5:]]), x) == [(5, 46)]
    assert passage_dedup.shared_runs(np.repeat(x[:1], 5000), np.repeat(x[:1], 3000)) == [(0, 5000)]


def test_wrapped_paragraphs_with_edits(spark):
    import textwrap

    para = prose(620, 90)
    copy = edited(para, 15)
    texts = [f"{prose(50, 20)}\n\n{textwrap.fill(para, 70)}\n\n{prose(51, 20)}", f"{prose(52, 20)}\n\n{textwrap.fill(copy, 45)}\n\n{prose(53, 20)}"]
    x, y = (set(shingles(WordHashes().of(words_of(t))).tolist()) for t in (para, edited(para, 45)))
    texts.append(f"{prose(54, 20)}\n\n{textwrap.fill(edited(para, 45), 30)}\n\n{prose(55, 20)}")
    assert len(x & y) / len(x | y) >= 0.8
    docs = table(spark, texts)
    out = by_id(passage_dedup.remove(docs, passage_dedup.repeated(docs)[0]))
    assert out[0]["text"] == texts[0] and out[2]["text"] == f"{prose(54, 20)}\n{prose(55, 20)}"


def test_passages_of_nothing(spark):
    docs = table(spark, []).limit(0)
    removals, components = passage_dedup.repeated(docs)
    assert passage_dedup.remove(docs, removals).count() == 0 and passage_dedup.report(docs, removals, components).count() == 0


def test_without_spans():
    assert passage_dedup.without_spans("aa bb cc", [(3, 5)]) == "aa cc"
    assert passage_dedup.without_spans("aa\nbb\ncc", [(3, 5)]) == "aa\ncc"
    assert passage_dedup.without_spans("aa bb", [(0, 2)]) == "bb" and passage_dedup.without_spans("aa", [(0, 2)]) == ""


def test_rows_that_repeat_an_id_are_cut_each_by_its_text(spark):
    passage = prose(930, 60)
    first, second, third = f"{prose(60, 80)} {passage} {prose(61, 80)}", f"{prose(62, 30)} {passage} {prose(63, 90)}", prose(64, 200)
    rows = [(1, first), (5, second), (5, third), (5, third), (6, third), (7, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    removals, components = passage_dedup.repeated(docs)
    out = [(r["doc_id"], r["text"]) for r in passage_dedup.remove(docs, removals).collect()]
    assert sorted(out, key=str) == sorted([(1, first), *[(5, t) for t in (third, third)], (7, None), (7, ""), *[x for x in out if x[0] == 5 and x[1] != third]], key=str)
    (cut,) = [t for i, t in out if i == 5 and t != third]
    assert passage not in cut and cut.startswith(prose(62, 20)) and len(words_of(cut)) in range(115, 127)
    rows = sorted((r["doc_id"], r["kept"], r["component_id"]) for r in passage_dedup.report(docs, removals, components).collect())
    assert rows == [(1, True, 1), (5, False, 1), (5, True, 1), (5, True, 1), (6, False, 1), (7, True, 7), (7, True, 7)]


def plain_repeats(texts, run_words):
    """Words of each text that lie in a run of ``run_words`` words which an earlier text holds: all runs against all."""
    seen, out = {}, []
    for i, t in enumerate(texts):
        w = words_of(t)
        runs = [tuple(w[k : k + run_words]) for k in range(len(w) - run_words + 1)]
        marked = set()
        for k, r in enumerate(runs):
            if seen.get(r, i) < i:
                marked.update(range(k, k + run_words))
        for r in runs:
            seen.setdefault(r, i)
        out.append(marked)
    return out


def test_passages_match_brute_force(spark):
    """Exact passages of 50 to 120 words between unlike text: what goes is what a plain search over all runs finds."""
    r = random.Random(12)
    passages = [random.Random(950 + i).choices(WORDS, k=50 + 10 * i) for i in range(8)]
    texts = []
    for i in range(40):
        parts = [random.Random(1000 + i).choices(WORDS, k=r.randrange(30, 150))]
        for p in r.sample(passages, r.randrange(3)):
            parts += [p, r.choices(WORDS, k=r.randrange(25, 80))]
        texts.append(" ".join(w for p in parts for w in p))
    docs = table(spark, texts)
    out = by_id(passage_dedup.remove(docs, passage_dedup.repeated(docs)[0]))
    for i, (t, gone) in enumerate(zip(texts, plain_repeats(texts, passage_dedup.RUN_WORDS))):
        assert words_of(out[i]["text"]) == [w for k, w in enumerate(words_of(t)) if k not in gone], i


def test_paragraphs_match_brute_force(spark):
    """Paragraphs edited at random: those of a Jaccard similarity of 0.8 with an earlier one go, directly or by a chain."""
    r, texts, label = random.Random(13), [], []
    for g in range(10):
        base = random.Random(1100 + g).choices(WORDS, k=90)
        for share in (0.0, 0.01, 0.02, 0.03, 0.05):
            w = [r.choice(WORDS) if r.random() < share else x for x in base]
            texts.append(" ".join(w) + "\n\n" + " ".join(r.choices(WORDS, k=15)))
    sets = [{tuple(w[k : k + 5]) for k in range(86)} for w in (t.split("\n")[0].split() for t in texts)]
    label = list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for _ in range(5):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    docs = table(spark, texts)
    out = by_id(passage_dedup.remove(docs, passage_dedup.repeated(docs)[0]))
    gone = [len(words_of(out[i]["text"])) <= 16 for i in range(len(texts))]
    assert all(gone[i] for i in range(len(texts)) if label[i] < i)
    # others may go by alignment, never the first
    assert not any(gone[5 * g] for g in range(10))


def test_min_hash_recall():
    cache, hits, n = WordHashes(), 0, 0
    for i in range(60):
        a = prose(i, 100)
        b = edited(a, 55)
        x, y = (cache.of(words_of(t)) for t in (a, b))
        sx, sy = set(shingles(x).tolist()), set(shingles(y).tolist())
        if len(sx & sy) / len(sx | sy) >= 0.8:
            n += 1
            keys = passage_dedup.min_hashes(np.concatenate([x, y]), np.array([0, len(x)]), np.array([len(x), len(x) + len(y)]))
            hits += (keys[0] == keys[1]).any()
    assert n > 30 and hits / n > 0.95
