"""Spelling variants, HyperMinHash near-duplicates and phrase mining against brute force."""

import collections
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitestance.llm import common, hyper_minhash, phrases, spelling

SCHEMA = "doc_id long, text string, lang string"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def table(spark, rows):
    """With columns whose names clash with those that the operators use."""
    extra = {n: F.lit(1) for n in ("word", "n", "node", "key", "content", "shard", "need", "phrase", "size", "k")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(extra).repartition(3)


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.fixture(scope="module")
def odd():
    """Nulls, empty and long texts, ties, repeated rows, copies and words of all kinds."""
    draw = random.Random(8)
    names = ["colour", "color", "colours", "Éclairage", "éclairage", "letter", "lettre", "better", "bettter"]
    names += ["".join(draw.choices("abÀÿ", k=draw.randint(5, 9))) for _ in range(60)]
    out = []
    for i in range(120):
        words = draw.choices(names, k=draw.choice([1, 3, 40, 90]))
        out.append((i, draw.choice([" ", ", ", " x1 "]).join(words), draw.choice(["en", "fr", None])))
    base = draw.choices(names, k=120)
    for i in range(40):
        near = list(base)
        for _ in range(draw.randint(0, 4)):
            near[draw.randrange(len(near))] = draw.choice(names)
        out.append((200 + i, " ".join(near), "en"))
    out += [(300 + i, out[5][1].upper(), "en") for i in range(9)] + [out[7], out[7]]
    out += [(400, None, "en"), (401, "", None), (402, " \n\t", "de"), (403, "z" * 70_000, "de"), (404, "one two", "de")]
    out += [(405, "ONE  two", "de"), (None, "colour colour colour", "en"), (None, None, None), (406, "日本 ½ \x85 don't" * 9, "und")]
    return out


def brute_words(rows):
    counts = collections.Counter()
    for doc_id, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 5}


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def brute_variants(rows):
    words = brute_words(rows)
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        if best and words[best] >= 5 * words[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(
        repr((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w)))) for w, n in words.items()
    )


def test_spelling(spark, odd):
    assert rows_of(spelling.variants(table(spark, odd))) == brute_variants(odd)
    assert rows_of(spelling.variants(table(spark, odd[:0]))) == []


def test_spelling_chains(spark):
    counts = {"abcdefgh": 3200, "abcdefg": 640, "abcdef": 128, "abcdeg": 25, "abxdeg": 5, "zzzzzz": 4}
    rows = [(i, " ".join([w] * n), None) for i, (w, n) in enumerate(counts.items())]
    found = {r.word: r for r in spelling.variants(table(spark, rows)).collect()}
    assert rows_of(spelling.variants(table(spark, rows))) == brute_variants(rows)
    assert found["abxdeg"].root == "abcdefgh" and found["abxdeg"].form == "abcdeg" and "zzzzzz" not in found


def test_one_edit_keeps_a_chunk():
    draw = random.Random(2)
    for length in range(6, 15):
        for _ in range(40):
            word = "".join(draw.choices("ab", k=length))
            others = {word[:i] + c + word[i:] for i in range(length + 1) for c in "abc"}
            for longer in others:
                assert spelling.chunk_keys(word) & spelling.gram_keys(longer)
            for i, c in itertools.product(range(length), "abc"):
                assert spelling.chunk_keys(word) & spelling.gram_keys(word[:i] + c + word[i + 1 :])


def brute_components(rows):
    sets = []
    for _, text, _ in rows:
        words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        grams = zip(*(words[i:] for i in range(4))) if len(words) >= 4 else [tuple(words)] if words else []
        sets.append(frozenset(grams))
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    least = {}
    for (doc_id, *_), g in zip(rows, group):
        least[g] = min((x for x in (least.get(g), doc_id) if x is not None), default=None)
    return sorted(repr((r[0], len(s), least[g], r[0] == least[g])) for r, s, g in zip(rows, sets, group))


def test_components_are_united_by_their_roots(spark):
    def edges(pairs):
        return spark.createDataFrame(pairs, "a bigint, b bigint")

    first = [(1, 2), (2, 3), (4, 5), (6, 7), (8, 9), (11, 12)]
    roots = hyper_minhash.components(edges(first), "test-components")
    for more in ([(3, 5), (9, 7)], [(10, 3), (10, 5)], [(2, 3)], [(0, 9), (0, 20), (7, 21)], []):
        found = sorted(hyper_minhash._united(roots, edges(more)).collect())
        expected = hyper_minhash.components(edges(first + more), "test-components")
        assert found == sorted(expected.collect()), more


def test_components_end_at_stars(spark, monkeypatch):
    """Components of chains, trees and repeated edges; stars take no turn."""
    written = []
    stored = common.stored
    monkeypatch.setattr(common, "stored", lambda df, name, *options: written.append(name) or stored(df, name, *options))
    draw = random.Random(3)
    chain = [(i, i + 1) for i in range(20)]
    mixed = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)]
    for pairs in ([(1, 2), (3, 1), (4, 5), (2, 1)], chain, mixed, []):
        group = {x: x for p in pairs for x in p if p[0] != p[1]}
        for _ in group:
            for a, b in pairs:
                if a != b:
                    group[a] = group[b] = min(group[a], group[b])
        written.clear()
        found = common.components(spark.createDataFrame(pairs, "a bigint, b bigint"), "test-components")
        assert sorted(map(tuple, found.collect())) == sorted(group.items())
        assert pairs in (chain, mixed) or len(written) == 1


def test_hyper_minhash(spark, odd):
    assert rows_of(hyper_minhash.near_duplicates(table(spark, odd))) == brute_components(odd)
    assert rows_of(hyper_minhash.near_duplicates(table(spark, odd[:0]))) == []


def test_links_across_components(spark, monkeypatch):
    """Chains of near copies whose ends are far apart, in blocks of a few texts."""
    monkeypatch.setattr(hyper_minhash, "BLOCK", 4)
    draw = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for chain in range(6):
        text = draw.choices(words, k=100)
        for step in range(30):
            rows.append((1000 * chain + step, " ".join(text), "en"))
            text = list(text)
            for at in draw.sample(range(100), 2):
                text[at] = draw.choice(words)
    draw.shuffle(rows)
    assert rows_of(hyper_minhash.near_duplicates(table(spark, rows))) == brute_components(rows)


def test_rows_follow_texts_not_pairs(spark, monkeypatch):
    """Many texts a little less alike than 0.8, with one long chain of links through them."""
    draw = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    base = draw.choices(words, k=140)
    rows = []
    for i in range(220):
        text = list(base)
        for at in draw.sample(range(140), 4):
            text[at] = draw.choice(words)
        rows.append((i, " ".join(text), "en"))
    made = {}
    stored = hyper_minhash.stored

    def counting(df, name, *options):
        out = stored(df, name, *options)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(hyper_minhash, "stored", counting)
    monkeypatch.setattr(hyper_minhash, "BLOCK", 64)
    # Five cells, so that links of one component are found in several.
    monkeypatch.setattr(hyper_minhash, "CELL", 50, raising=False)
    found = rows_of(hyper_minhash.near_duplicates(table(spark, rows)))
    assert found == brute_components(rows)
    assert made["hyper-across"] <= 8 * len(rows), made


def test_coarse_registers_give_up_no_pair():
    """Whatever whole registers keep, registers of four bits keep as well."""
    draw = np.random.default_rng(9)
    sets = []
    for size in (1, 3, 9, 30, 150, 2000):
        pool = np.unique(draw.integers(0, 1 << 63, 2 * size, dtype=np.uint64) << np.uint64(1))
        sets += [np.sort(draw.choice(pool, size, replace=False)) for _ in range(5)]
        sets += [np.sort(np.append(draw.choice(pool[:size], max(1, size - 1 - size // 10), replace=False), pool[-1])) for _ in range(9)]
    rows = pa.RecordBatch.from_pydict(
        {"node": list(range(len(sets))), "n": [len(x) for x in sets], "sketch": [hyper_minhash.sketch(x) for x in sets]}
    )
    (packed,) = hyper_minhash._coarse(iter([rows, rows.slice(0, 0)]))
    member = [{"comp": r["node"], "few": True, **r} for r in packed.to_pylist()]
    lists = pa.array([[], member, None], pa.list_(pa.array(member).type))
    blocks = pa.RecordBatch.from_arrays([lists.take(pa.array([2])), lists.take(pa.array([1]))], ["some", "others"])
    kept = {(r["a"], b) for part in hyper_minhash._compare(iter([blocks])) for r in part.to_pylist() for b in r["bs"]}
    whole = np.stack([np.frombuffer(s, "<u2") for s in rows.column(2).to_pylist()])
    n = rows.column(1).to_numpy()
    a, b = np.triu_indices(len(sets), 1)
    expected = hyper_minhash.likely(whole[a], whole[b], n[a], n[b])[0]
    pairs = set(zip(a[expected].tolist(), b[expected].tolist()))
    assert len(pairs) > 20 and pairs <= kept and len(kept) < len(a) / 2


def test_short_texts_do_not_meet_by_a_common_line(spark):
    """Texts that share one line of five shingles, and nothing else, seldom share bands; those alike do."""
    draw = np.random.default_rng(3)
    line = draw.integers(0, 1 << 63, 5, dtype=np.uint64) << np.uint64(1)
    sets = []
    for size in [14, 20, 33, 50, 70, 100] * 100:
        own = draw.integers(0, 1 << 63, size, dtype=np.uint64) << np.uint64(1)
        sets.append(np.unique(np.append(own, line)))
    unlike = len(sets)
    for x in sets[:90]:
        # Alike by 0.8 or a little more.
        gone = len(x) // 9
        new = draw.integers(0, 1 << 63, gone, dtype=np.uint64) << np.uint64(1)
        sets.append(np.unique(np.append(x[gone:], new)))
    rows = [(i, len(x), bytearray(hyper_minhash.sketch(x))) for i, x in enumerate(sets)]
    texts = spark.createDataFrame(rows, "node bigint, n bigint, sketch binary")
    bands = collections.defaultdict(set)
    for r in hyper_minhash._members(texts).collect():
        bands[r.key].add(r.node)
    met = {p for b in bands.values() for p in itertools.combinations(sorted(b), 2)}
    assert all((i, unlike + i) in met for i in range(90))
    assert len([p for p in met if p[1] < unlike]) < 8 * unlike, len(met)


def test_bands_of_all_sizes(spark):
    """Each size has its bands, of all its registers, and pairs of neighbouring classes meet."""
    draw = np.random.default_rng(2)
    sets, pairs = [], []
    for size in (1, 2, 4, 5, 6, 9, 10, 11, 15, 16, 17, 23, 24, 26, 35, 36, 40, 52, 60, 75, 76, 90, 110, 111, 130, 300, 2000):
        x = np.unique(draw.integers(0, 1 << 63, size, dtype=np.uint64) << np.uint64(1))
        # The least subset that is alike.
        sets += [x, np.sort(draw.permutation(x)[: -(-8 * len(x) // 10)])]
        pairs.append((len(sets) - 2, len(sets) - 1))
    rows = [(i, len(x), bytearray(hyper_minhash.sketch(x))) for i, x in enumerate(sets)]
    texts = spark.createDataFrame(rows, "node bigint, n bigint, sketch binary")
    bands = collections.defaultdict(set)
    for r in hyper_minhash._members(texts).collect():
        bands[r.key].add(r.node)
    met = {p for b in bands.values() for p in itertools.combinations(sorted(b), 2)}
    assert met == set(pairs)


def test_families_in_many_blocks(spark, monkeypatch):
    """Texts around one text, many a little less alike than 0.8, in blocks of a few texts; likely pairs stay few rows."""
    draw = random.Random(11)
    words = [f"w{i}" for i in range(900)]
    base = draw.choices(words, k=160)
    rows = []
    for i in range(260):
        text = list(base)
        for at in draw.sample(range(160), draw.randint(1, 6)):
            text[at] = draw.choice(words)
        rows.append((i, " ".join(text), "en"))
    made = {}
    stored = hyper_minhash.stored

    def counting(df, name, *options):
        out = stored(df, name, *options)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(hyper_minhash, "stored", counting)
    monkeypatch.setattr(hyper_minhash, "MOST", 40, raising=False)
    assert rows_of(hyper_minhash.near_duplicates(table(spark, rows))) == brute_components(rows)
    assert made["hyper-across"] <= len(rows) // 4, made


def test_joining_pairs_come_once():
    """Of texts that are all alike, a task gives one pair fewer than there are, however often they meet."""
    draw = np.random.default_rng(8)
    base = np.unique(draw.integers(0, 1 << 63, 400, dtype=np.uint64) << np.uint64(1))
    sketches = [hyper_minhash.sketch(np.delete(base, i)) for i in range(12)]
    rows = pa.RecordBatch.from_pydict({"node": range(12), "n": [len(base) - 1] * 12, "sketch": sketches})
    (packed,) = hyper_minhash._coarse(iter([rows]))
    member = [{"comp": r["node"], "few": True, **r} for r in packed.to_pylist()]
    lists = pa.array([member, None], pa.list_(pa.array(member).type))
    blocks = pa.RecordBatch.from_arrays([lists.take(pa.array([1])), lists.take(pa.array([0]))], ["some", "others"])
    empty = pa.RecordBatch.from_arrays([lists.take(pa.array([1])), lists.take(pa.array([1]))], ["some", "others"])
    found = [r for part in hyper_minhash._joining(iter([blocks, blocks.slice(0, 0), empty, blocks])) for r in part.to_pylist()]
    assert len(found) == 11 and {x for r in found for x in r.values()} == set(range(12))


def test_shared_members_are_counted(monkeypatch):
    draw = np.random.default_rng(1)
    for dense, columns, compared in ((1, 7, 10), (20, 64, 1000), (128, 1024, 1 << 15), (10**9, 1, 1)):
        for name, value in (("DENSE", dense), ("COLUMNS", columns), ("COMPARED", compared)):
            monkeypatch.setattr(hyper_minhash, name, value)
        for _ in range(10):
            pool = np.unique(draw.integers(0, 1 << 63, 60, dtype=np.uint64))
            one, other = (
                [np.sort(draw.choice(pool, draw.integers(1, len(pool)), replace=False)) for _ in range(k)] for k in (9, 30)
            )
            expected = [[len(np.intersect1d(a, b)) for b in other] for a in one]
            assert (hyper_minhash._shared(one, other) == expected).all()


def test_likely_keeps_what_is_alike():
    """No pair of likeness 0.8 or a little more is given up, whatever its size; estimates are near."""
    draw = np.random.default_rng(4)
    for size in (4, 9, 30, 100, 400, 3000):
        lost, errors = 0, []
        for _ in range(300):
            shared = -(-8 * size // 10)
            pool = draw.integers(0, 1 << 63, size + 2, dtype=np.uint64) << np.uint64(1)
            cut = int(draw.integers(0, size - shared + 1))
            a, b = np.unique(pool[: shared + cut]), np.unique(np.concatenate([pool[:shared], pool[shared + cut : size]]))
            sketches = [np.frombuffer(hyper_minhash.sketch(x), "<u2")[None, :] for x in (a, b)]
            keep, near = hyper_minhash.likely(*sketches, np.array([len(a)]), np.array([len(b)]))
            lost += not keep[0]
            errors.append(near[0] - shared / size)
        assert lost == 0 and abs(np.mean(errors)) < 0.03


def test_chance_matches_are_taken_off():
    draw = np.random.default_rng(6)
    same, expected = 0, 0.0
    for _ in range(400):
        a, b = (draw.integers(0, 1 << 63, 5000, dtype=np.uint64) << np.uint64(1) for _ in range(2))
        a, b = (np.frombuffer(hyper_minhash.sketch(np.unique(x)), "<u2") for x in (a, b))
        same += int((a == b).sum())
        expected += float(hyper_minhash.chance(np.array([5000]), np.array([5000]))[0]) * hyper_minhash.REGISTERS
    assert 0.5 * expected < same < 1.6 * expected


def brute_phrases(rows, support, top):
    counts, totals = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for k in range(1, 6):
                counts.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {p: a for p, a in counts.items() if a >= support and len(p[1]) >= 2}
    out = []
    for (lang, words), a in found.items():
        if any(
            found.get((lang, other)) == a
            for l, other in found
            if l == lang and len(other) == len(words) + 1 and words in (other[1:], other[:-1])
        ):
            continue
        n = totals[lang]
        cuts = [(1000 * a * n // (counts[lang, words[:k]] * counts[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, counts[lang, words[:k]], counts[lang, words[k:]], n, score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranked = []
    for lang, group in itertools.groupby(out, key=lambda r: r[0]):
        ranked += [(lang, rank, *r[1:]) for rank, r in enumerate(itertools.islice(group, top), 1)]
    return sorted(map(repr, ranked))


@pytest.mark.parametrize("support, top, shards", [(5, 2000, 8), (3, 7, 3), (40, 2000, 1)])
def test_phrases(spark, odd, support, top, shards):
    found = phrases.collocations(table(spark, odd), support, top, shards)
    assert rows_of(found) == brute_phrases(odd, support, top)


def test_phrases_in_small_portions(spark, odd, monkeypatch):
    """Tasks that hand over often, remember little and meet full filters find the same."""
    monkeypatch.setattr(phrases, "POSITIONS", 50)
    monkeypatch.setattr(phrases, "WORDS", 20)
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    assert rows_of(phrases.collocations(table(spark, odd), 4)) == brute_phrases(odd, 4, 2000)
    assert rows_of(phrases.collocations(table(spark, odd[:0]))) == []


def test_equal_hashes_are_told_apart(spark, odd, monkeypatch):
    whole = phrases.phrase_hashes
    # Longer phrases have one of eight hashes, so most of those that meet are different.
    monkeypatch.setattr(
        phrases, "phrase_hashes", lambda *of: ((h if k == 0 else h & np.uint64(7), w) for k, (h, w) in enumerate(whole(*of)))
    )
    assert rows_of(phrases.collocations(table(spark, odd), 4)) == brute_phrases(odd, 4, 2000)


@pytest.mark.parametrize("positions", [1 << 21, 40])
def test_chunks_give_words_back(monkeypatch, positions):
    """Stored hashes and places spell every text, piece by piece, and levels count from them alone."""
    import pyarrow as pa

    monkeypatch.setattr(phrases, "POSITIONS", positions)
    texts = ["", "a b. a b c", "b c a b", *(f"w{i} a b" for i in range(30))]
    batch = pa.RecordBatch.from_pydict({"lang": ["x", "y"] * 16 + ["x"], "shard": [0] * 33, "need": [1] * 33, "text": texts})
    parts = list(phrases._gather(phrases._numbered)(iter([batch])))
    found = []
    for row in (r for part in parts for r in part.to_pylist()):
        words = np.frombuffer(row["words"], "<u8")
        places = np.frombuffer(row["places"], f"<u{row['width']}")
        found += [(row["lang"], int(words[at - 1]) if at else 0) for at in places]
    names = {phrases.xxhash.xxh64_intdigest(w) | 1: w for t in texts for w in phrases.tokens(t)}
    spelled = sorted((lang, names[h]) for lang, h in found if h)
    assert spelled == sorted((l, w) for l, t in zip(["x", "y"] * 17, texts) for w in phrases.tokens(t) if w != b".")
    counted = [r["n"] for part in phrases._local((1,), None)(iter(parts)) for r in part.to_pylist()]
    assert sum(counted) == len(spelled)


def test_scores_pass_64_bits(spark):
    rows = spark.sql(
        "select 9000000000000l a, 8000000000000000l total, 9000000000001l l, 9100000000000l r"
    )
    wide = "cast({} as decimal(38,0))"
    score = f"({wide.format(1000)} * {wide.format('a')} * {wide.format('total')}) div ({wide.format('l')} * {wide.format('r')})"
    exact = 1000 * 9000000000000 * 8000000000000000 // (9000000000001 * 9100000000000)
    assert rows.selectExpr(f"{score} s").first().s == exact


def test_phrase_sql(spark, sf_dir):
    """The query's SQL on the given table."""
    with duckdb.connect() as db:
        db.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
        expected = sorted(map(repr, db.sql(phrases.ORACLE_SQL).fetchall()))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rows_of(phrases.collocations(docs)) == expected


@pytest.mark.parametrize("hashes, positions", [(None, 1 << 21), (7, 1 << 21), (None, 40), (7, 40)])
def test_exact_counts_in_this_process(monkeypatch, hashes, positions):
    """Counts of a task, also where most phrases share a hash (workers do not see what a test replaces)."""
    import random
    from collections import Counter

    import pyarrow as pa

    whole = phrases.mix
    if hashes:
        monkeypatch.setattr(phrases, "mix", lambda h: whole(h) & hashes)
    monkeypatch.setattr(phrases, "POSITIONS", positions)
    draw = random.Random(3)
    texts = ["", "a", *(" ".join(draw.choice(["a", "b", "c", "d.", "e"]) for _ in range(draw.randrange(30))) for _ in range(40))]
    batch = pa.RecordBatch.from_pydict({"lang": ["x"] * len(texts), "shard": [0] * len(texts), "need": [1] * len(texts), "text": texts})
    found, expected = Counter(), Counter()
    for part in phrases._exact(b"\xff" * 8)(iter([batch])):
        for row in part.to_pylist():
            found[row["phrase"], row["k"]] += row["n"]
    for text in texts:
        for piece in text.split("."):
            words = piece.split()
            expected["", 0] += len(words)
            expected.update((" ".join(words[i : i + k]), k) for k in range(1, 6) for i in range(len(words) - k + 1))
    assert +found == expected
