"""Every operator against a plain form of its definition, over a fixture of odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sitestance.llm import (
    common, line_frequency, minhash, mixing, packing, registry, secrets, sharding, simhash, site_tree,
    suffix_dedup, toxicity,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def near(rows):
    """Fingerprints by definition, and the least id of everything linked."""
    prints = []
    for _, text, _ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = WORD.findall(low)
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    label = [r[0] if r[0] is not None else 1 << 60 for r in rows]
    while True:
        new = [min(label[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 3) for p in prints]
        if new == label:
            return prints, [None if x == 1 << 60 else x for x in label]
        label = new


def test_simhash(docs, rows):
    prints, label = near(rows)
    expected = sorted(((r[0], f"{p:016x}", c) for r, p, c in zip(rows, prints, label)), key=repr)
    assert pairs(simhash.digest(docs)) == expected


def test_one_of_each(docs, rows):
    _, label = near(rows)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for c in label if c is not None})
    assert ids.count(None) == 1


def test_one_of_each_by_likeness(spark, words):
    """Copies with some words replaced go although their fingerprints lie further apart."""
    draw = random.Random(8)
    rows = []
    for i in range(60):
        text = draw.choices(words, k=200)
        near = list(text)
        for at in (60, 130):
            near[at] = "changed"
        rows += [(i, " ".join(text)), (100 + i, " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {i: int.from_bytes(simhash.fingerprint(t), "big") for i, t in rows}
    assert sum((prints[i] ^ prints[100 + i]).bit_count() > 3 for i in range(60)) > 5
    kept = {r.doc_id for r in simhash.one_of_each(docs, likeness=0.8).collect()}
    assert kept == set(range(60))


def test_one_of_each_with_reused_ids(spark, words):
    """An id that comes with two texts goes only with the text that another row stands for."""
    draw = random.Random(9)
    a, b = (" ".join(draw.choices(words, k=200)) for _ in range(2))
    docs = spark.createDataFrame([(5, a), (5, b), (1, b.upper())], "doc_id long, text string")
    assert pairs(simhash.one_of_each(docs)) == sorted([(1, b.upper()), (5, a)], key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_ball_hashing_finds_every_link(spark, seed):
    draw = np.random.default_rng(seed)
    prints = set()
    for base in draw.integers(0, 1 << 64, 12, dtype=np.uint64):
        for n in range(20):
            block = simhash.BLOCKS[n % 3]
            low, high = block if n < 9 else (0, 64)
            x = int(base)
            for bit in draw.choice(range(low, high), int(draw.integers(1, 5)), replace=False):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in prints], "fp long")
    nodes = {r.node: r.root for r in common.components(simhash.links(df), "test").collect()}
    label = list(range(len(prints)))
    while True:
        new = [min(label[j] for j, q in enumerate(prints) if (p ^ q).bit_count() <= 3) for p in prints]
        if new == label:
            break
        label = new
    signed = [int(np.uint64(x).astype(np.int64)) for x in prints]
    found = [nodes.get(x, x) for x in signed]
    assert len(set(zip(found, label))) == len(set(found)) == len(set(label))


def test_line_frequency(docs, rows):
    found = defaultdict(list)
    for r in line_frequency.digest(docs).collect():
        found[r.doc_id].append(r)
    for doc_id, text, _ in rows:
        text = text or ""
        words = WORD.findall(text)
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        own = (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered), failed,
        )
        assert own in {tuple(r)[1:7] for r in found[doc_id]}
        assert all(r.kept <= (not r.base_failed) for r in found[doc_id])
    # The footer that 20 documents share goes; copies lose no line, near copies are not rejected.
    assert all(r.removed_words == 5 and r.kept for i in range(400, 420) for r in found[i])
    assert all(r.removed_words == 0 for i in range(200, 212) for r in found[i])
    assert all(r.kept for i in range(100, 130) for r in found[i])


def test_clean_removes_lines_and_documents(docs, rows):
    out = line_frequency.clean(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r for r in out.collect()}
    before = {r[0]: r[1] for r in rows}
    assert 300 not in texts and 303 not in texts
    assert texts[400].text == before[400].replace("Shared footer of this host\n", "")
    assert texts[400].n_chars == len(texts[400].text)
    assert texts[200].text == before[200]


def test_depleted_documents_are_rejected(spark):
    filler = ["\n".join(f"u{i}x{n} own words" for n in range(6)) for i in range(40)]
    shared = "\n".join(" ".join(f"shared{n}w{k}" for k in range(30)) for n in range(2))
    df = spark.createDataFrame([(i, f"{shared}\n{f}", "h") for i, f in enumerate(filler)], "doc_id long, text string, source string")
    assert [r.kept for r in line_frequency.digest(df).collect()] == [False] * 40


@pytest.mark.parametrize("shared, own, copies", [(1, 5, 45), (5, 5, 0), (10, 5, 0), (3, 1, 0)])
def test_shared_lines_of_distinct_documents_are_found(spark, words, shared, own, copies):
    """Copies and near copies of one document hide no line, and mostly shared pages lose theirs."""
    draw = random.Random(shared)
    line = lambda: " ".join(draw.choices(words, k=20))
    footer = [line() for _ in range(shared)]
    texts = ["\n".join(footer + [line() for _ in range(own)]) for _ in range(60)]
    texts += [texts[0]] * copies
    texts += [f"{texts[0]} changed{i}" for i in range(copies)]
    df = spark.createDataFrame([(i, t, "h") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    removed = {r.removed_words for r in line_frequency.digest(df).collect()}
    assert removed == {20 * shared}


def spans_of(text, rules):
    out = []
    for rank, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                out.append((m.start(), rank, m.end(), rule.kind))
    return sorted(out)


def test_secrets(docs, rows):
    expected = []
    for doc_id, text, _ in rows:
        spans = spans_of(text, secrets.RULES)
        listed = [f"{k}:{s}:{e}" for s, _, e, k in spans]
        base = ",".join(x for x, s in zip(listed, spans) if s[1] < 3)
        counts = [sum(s[1] == n for s in spans) for n in range(3)]
        expected.append((doc_id, *counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(listed)))
    assert pairs(secrets.digest(docs)) == sorted(expected, key=repr)
    assert any(x[1] and x[3] for x in expected)


def test_redact(docs, rows):
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[500] == '[SECRET]" é [SECRET]'
    assert texts[501] == "secret=token:abcdef password: 'xy' ü [SECRET]"
    assert texts[300] is None and texts[303] == "x" * 30_000


def test_many_secrets_in_a_text(spark):
    text = " ".join(f"token={i:08d}" for i in range(1000))
    row = secrets.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.spans == ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans_of(text, secrets.RULES))


def test_trigram_queries():
    assert secrets.trigrams("[0-9a-f]{24,}") is None
    assert secrets.trigrams("AKIA[A-Z]+") == {frozenset({"aki", "kia"})}
    assert frozenset({"tok", "oke", "ken"}) in secrets.trigrams(secrets.BASE[0].pattern)


def water(sizes, weights, total):
    """Shares by weight with bounds, the excess shared again until none is above."""
    target = dict.fromkeys(sizes, 0.0)
    free, left = set(sizes), float(total)
    while free:
        level = left / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 3 * sizes[s]}
        if not over:
            return target | {s: level * weights[s] for s in free}
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mixing(docs, rows):
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = water(sizes, weights, sum(sizes.values()))
    taken, most = Counter(), Counter()
    by_id = {r[0]: r[2] for r in rows}
    for r in found:
        assert r.taken <= 3 * r.size
        if r.doc_id != 7:
            source = by_id[r.doc_id]
            assert r.source_size == sizes[source] and abs(r.target - target[source]) < 1e-6
            most[source] = max(most[source], r.size)
    for r in found:
        taken[(r.source_size, r.target)] += r.taken
    for s in order:
        assert abs(taken[(sizes[s], target[s])] - target[s]) <= max(most[s] * 2, 1) or not sizes[s]
    assert pairs(mixing.mix(docs.repartition(3))) == sorted(map(tuple, found), key=repr)
    assert mixing.apply(docs).columns == docs.columns


def test_packing(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    found = packing.pack(docs).toPandas()
    texts = defaultdict(list)
    for doc_id, text, _ in rows:
        texts[-1 if doc_id is None else doc_id].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [0])
    found["doc_id"] = found.doc_id.fillna(-1)
    for doc_id, group in found.groupby("doc_id"):
        ids = texts[doc_id]
        assert group.length.sum() == sum(map(len, ids))
        for p in group.itertuples():
            options = [x[p.start : p.start + p.length] for x in ids if len(x) == p.doc_tokens]
            assert p.ids_crc32 in {zlib.crc32(np.array(x, "<u4").tobytes()) for x in options}
    ordered = found.sort_values(["sequence_id", "offset"])
    filled = ordered.groupby("sequence_id").length
    assert (filled.cumsum() - ordered.length == ordered.offset).all()
    assert list(filled.sum().index) == list(range(ordered.sequence_id.nunique()))
    assert (filled.sum() < packing.WINDOW).sum() <= 1 and filled.sum().max() <= packing.WINDOW


def test_packing_repeats_never_exceed_the_histogram():
    draw = np.random.default_rng(1)
    histogram = np.zeros(1025, np.int64)
    histogram[1:1024] = draw.integers(0, 50, 1023)
    histogram[700] = 5000
    combos, times = packing.repeats(histogram)
    used = Counter()
    for combo, n in zip(combos, times.tolist()):
        assert sum(combo) == 1024
        for length in combo:
            used[length] += n
    assert all(n <= histogram[length] for length, n in used.items())
    others = int((np.arange(1025) * histogram).sum()) - 700 * 5000
    assert sum(length * n for length, n in used.items() if length != 700) > 0.5 * others


@pytest.mark.parametrize("ranges", [4, 64])
def test_sharding(docs, rows, ranges):
    found = sharding.assign(docs, ranges=ranges).collect()
    sizes = sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in found) == sizes
    by_shard = defaultdict(list)
    for r in found:
        by_shard[r.shard].append(r)
    for group in by_shard.values():
        assert sorted(r.slot for r in group) == list(range(len(group)))
    most = max(s for _, s, _ in sizes)
    share = sum(s for _, s, _ in sizes) / 16
    assert all(abs(sum(r.size for r in by_shard[k]) - share) <= 2 * most for k in range(16))
    assert pairs(sharding.assign(docs.repartition(2), ranges=ranges)) == sorted(map(tuple, found), key=repr)


def test_minhash(docs, rows):
    key = lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42))
    signed = lambda r: key(r)[:2] + ((key(r)[2] + (1 << 63)) % (1 << 64),)
    ordered = [(i, t or "") for i, t, _ in sorted(rows, key=signed)]
    sig = lambda t: minhash.signature(minhash.shingle_hashes(minhash.words_of(t)))
    expected = []
    for i, (doc_id, text) in enumerate(ordered):
        following = ordered[(i + 1) % len(ordered)][1]
        edited = minhash.edit(text, following)
        expected.append(
            (
                doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), minhash._hex(sig(text)), minhash._hex(sig(edited)),
                minhash.likeness(sig(text), sig(edited)), minhash.likeness(sig(text), sig(following)),
            )
        )
    assert pairs(minhash.digest(docs)) == sorted(expected, key=repr)


def test_minhash_search(docs, rows):
    def shingles(text):
        words = (text or "").split()
        return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))) if words else frozenset()

    texts = [(r[0], shingles(r[1])) for r in rows if r[0] is not None]
    wanted = {i: s for i, s in texts if i in (3, 105, 300)}
    expected = set()
    for q, a in wanted.items():
        for d, b in texts:
            if (1.0 if not a | b else len(a & b) / len(a | b)) >= 0.8:
                expected.add((q, d))
    chosen = docs.where("doc_id in (3, 105, 300)")
    found = {(r.query_id, r.doc_id) for r in minhash.search(chosen, docs.where("doc_id is not null")).collect()}
    assert found == expected


def test_suffix_dedup(spark, docs, rows):
    assert {(a - b) % 273 for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(273))
    long = rows[35][1] * 2
    more = [(600 + n, rows[38][1][:50] + long[20 : 20 + n] + "~" + rows[36][1], "s") for n in (399, 400, 401, 700)]
    more += [(700, "ab" * 450, "s"), (701, "q" * 401, "s")]
    every = rows + more
    texts = [(r[0], (r[1] or "").encode()) for r in every]
    seen = Counter(t[p : p + 400] for _, t in texts for p in range(len(t) - 399))
    expected = []
    for doc_id, t in texts:
        mask = np.zeros(len(t), bool)
        for p in range(len(t) - 399):
            if seen[t[p : p + 400]] > 1:
                mask[p : p + 400] = True
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~mask])
        expected.append((doc_id, len(t), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest()))
    extra = spark.createDataFrame(more, "doc_id long, text string, source string")
    both = docs.select("doc_id", "text", "source").union(extra)
    assert pairs(suffix_dedup.dedup(both)) == sorted(expected, key=repr)


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def test_site_tree(spark):
    pages = [
        (1, page('<nav><a>menu</a></nav><div class="ad">buy</div><article><h1>A &amp; B</h1><p><b>one\n two<br>three<p>four</article><footer>f</footer>'), "A & B\n\none two three\n\nfour"),
        (2, page("<script>var t='</p>';</script><p>x &lt; y</p><form><p>mail</p></form><aside>side</aside>"), "x < y"),
        (3, None, ""),
        (4, "", ""),
        (5, page('<p title="a > b">kept</p><!-- <p>no</p> --><section class="comments"><p>c</p></section>'), "kept"),
        (6, "<p>cut <b>off", "cut off"),
    ]
    df = spark.createDataFrame([(i, f"http://h{i}.org/", h) for i, h, _ in pages], "page_id long, url string, html string")
    df = df.withColumns({"row": F.lit(1), "text": F.lit("x"), "host": F.lit("y")})
    assert pairs(site_tree.extract(df)) == sorted(((i, f"http://h{i}.org/", t, len(t)) for i, _, t in pages), key=repr)


def test_site_tree_removes_what_a_host_repeats(spark):
    html = [page(f'<div id="info"><p>Our office is open</p></div><div id="x"><h1>T{i}</h1><p>story {i}</p></div>') for i in range(8)]
    copies = [page('<div id="x"><h1>Same</h1><p>same</p></div>')] * 9
    rows = [(i, "http://a.org/x", h) for i, h in enumerate(html)]
    rows += [(100 + i, "http://b.org/x", h) for i, h in enumerate(copies)]
    out = {r.page_id: r.text for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"T{i}\n\nstory {i}" for i in range(8))
    assert all(out[100 + i] == "Same\n\nsame" for i in range(9))


@pytest.mark.parametrize("html", [
    '<body class="sidebar-right"><p>told</p></body>', '<body class="menu-open"><p>told</p></body>',
    '<html class="sidebar"><body><p>told</p></body></html>', '<main id="social"><p>told</p></main>',
    '<article class="comments-open"><p>told</p></article>', '<div id="social-policy"><p>told</p></div>',
    "<html><head><title>t</title><body><p>told</p></body></html>", "<head><meta name=a><p>told</p>", "<head><title>t</title>told",
])
def test_content_holders_are_no_furniture(html):
    assert [b["text"] for b in site_tree.parse(html)[0]] == ["told"]


def test_compound_names_of_furniture():
    for name in ("cookie-banner", "nav_menu", "related-posts", "sidebar-right"):
        assert not site_tree.parse(f'<div class="{name}"><p>no</p></div>')[0]


def test_nodes_have_the_same_content_where_their_texts_are_the_same():
    def contents(html):
        return {n["node"]: n["content"] for n in site_tree.parse(html)[1]}

    one = contents("<div><p>a</p><p>b</p></div>")
    assert one == contents("<div><p>a</p></div><div><p>b</p></div>") and one != contents("<div><p>b</p><p>a</p></div>")
    assert one == contents("<ol></ol><div>\n <p> a</p><p>b</p></div>") != contents("<div><p>ab</p></div>")
    blocks, nodes, _ = site_tree.parse("<p>top</p>x<div><ul><li>a<li>b</ul></div>")
    above = [[nodes[b["node"]]["parent"] if b["node"] >= 0 else None] for b in blocks]
    assert [b["text"] for b in blocks] == ["top", "x", "a", "b"] and above[1] == [None] and above[2] == above[3] != [-1]
    assert [b["text"] for b in site_tree.parse("<p>text with <label>inline</label> label</p>")[0]] == ["text with inline label"]


def test_importance_by_definition(spark):
    """What a host repeats, against entropies counted in plain Python."""
    import math
    from collections import Counter, defaultdict

    bodies = [f'<div id="n"><p>same</p><p>v{i % 2}</p></div><div id="t"><p>own {i}</p></div><p>foot</p>' for i in range(9)]
    html = [page(b) for b in bodies] + [page(bodies[0])]
    seen = defaultdict(dict)
    for text in html:
        _, nodes, key = site_tree.parse(text)
        for n in nodes:
            seen[n["node"]][key] = (n["presentation"], n["content"])

    def entropy(values):
        counts = Counter(values).values()
        return sum(c * math.log(sum(counts) / c) for c in counts) / sum(counts) / math.log(sum(counts))

    low = {n for n, by in seen.items() if len(by) >= site_tree.MIN_PAGES
           and max(entropy([v[k] for v in by.values()]) for k in (0, 1)) < site_tree.LOW_IMPORTANCE}
    expected = []
    for i, text in enumerate(html):
        blocks, nodes, _ = site_tree.parse(text)
        kept = []
        for b in blocks:
            n, out = b["node"], False
            while n >= 0:
                out, n = out or nodes[n]["node"] in low, nodes[n]["parent"]
            kept += [] if out else [b["text"]]
        expected.append((i, "\n\n".join(kept)))
    frame = spark.createDataFrame([(i, "http://a.org/", t) for i, t in enumerate(html)], "page_id long, url string, html string")
    assert low and pairs(site_tree.extract(frame).select("page_id", "text")) == sorted(expected, key=repr)


def test_hostile_html_takes_linear_time():
    import time

    deep, items = "<div>" * 4_000, "<ul>" * 4_000
    nested = (deep + "<p>x</p>" * 4_000, deep + "<li>x" * 4_000, deep + "x</p>" * 4_000, items + "<li>x</ul>" * 4_000)
    for text in (*nested, "<p " * 20_000, "<h1>" * 3_000, '<b x="' * 20_000, "<!--" * 20_000, "<script" * 20_000):
        start = time.perf_counter()
        site_tree.parse(text)
        assert time.perf_counter() - start < 3


def test_toxicity(spark, sf_dir):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(90_001, None), (90_002, ""), (None, "x")], "doc_id long, text string")
    out = toxicity.score(docs.select("doc_id", "text").union(odd), labels).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in held) / len(held) > 0.9


def test_grammar_reads_clauses():
    grammar = toxicity.Grammar({"fool": 3.0, "idio*": 4.0})
    named = lambda text: dict(zip(toxicity.PATTERNS, grammar.read(text)))
    assert named("you are a fool")["target"] > 0 == named("you are a fool")["plain"]
    assert named("not a fool. a nice day")["negated"] > 0
    assert named("he said: idiots, all")["reported"] > 0
    assert named("i will kill you")["threat"] > 0 == named("kill time")["threat"]
    assert not any(grammar.read(None)) and not any(grammar.read("a fine day"))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    source = "/root/testdata/sf0.001"
    for table in ("documents", "pages", "labels"):
        spark.read.parquet(f"{source}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert registry.QUERIES[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_sql(spark, sf_dir, name):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    expected = db.sql(registry.ORACLE[name])
    columns = sorted(expected.columns)
    found = registry.QUERIES[name](spark, sf_dir)
    assert sorted(found.columns) == columns
    theirs = expected.df()[columns].itertuples(index=False, name=None)
    assert sorted(found.toPandas()[columns].itertuples(index=False, name=None), key=repr) == sorted(theirs, key=repr)


def test_look_up_both_ways(spark):
    rows = spark.range(500).selectExpr("id", "if(id % 3 = 0, null, if(id % 2 = 0, 'hot', cast(id as string))) as k")
    table = spark.sql("select * from values ('hot', 1), (null, 2), ('7', 3) as t(k, v)")
    small = common.look_up(rows, table, ["k"], spread=["id"])
    large = common.look_up(rows, table, ["k"], spread=["id"], most=0)
    assert pairs(small) == pairs(large) and small.count() == 500
