"""Operators 1, 4, 5 and 7 against brute force and planted cases."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, imatch, jaccard, suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def table(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in range(len(ids)):
        for b in range(a):
            x, y = sets[ids[a]], sets[ids[b]]
            n = len(x & y)
            if x and y and 100 * n >= percent * (len(x) + len(y) - n):
                p, q = sorted((find(ids[a]), find(ids[b])))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.fixture(scope="module")
def near(spark):
    rng = random.Random(7)
    texts = [None, "", "  \t ", "one", "one two", "ONE two", "one two three", "one two three four"]
    for size in (5, 9, 10, 12, 19, 25, 40, 75, 150, 400):
        for _ in range(3):
            base = words(rng, size)
            texts.append(" ".join(base))
            for _ in range(6):
                x = list(base)
                for _ in range(rng.randrange(0, max(2, size // 25) + 1)):
                    at = rng.randrange(len(x))
                    x[at : at + rng.randrange(0, 2)] = words(rng, rng.randrange(0, 3))
                texts.append(" ".join(x))
    shared = words(rng, 40)
    texts += [" ".join(shared + words(rng, 8)) for _ in range(60)]  # a common passage: alike, but not enough
    return table(spark, texts)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard_join_equals_brute_force(near, k, percent):
    want = brute_components([(r.doc_id, r.text) for r in near.collect()], k, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(near, jaccard.Params(k, percent)).collect()}
    assert got == want


def test_large_buckets_need_a_rare_shingle(near, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 1)
    want = brute_components([(r.doc_id, r.text) for r in near.collect()], 3, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(near).collect()}
    assert got == want


def test_one_of_each_group_stays(spark, near):
    p = jaccard.Params(5, 80)
    want = brute_components([(r.doc_id, r.text) for r in near.collect()], 5, 80)
    kept = sorted(r.doc_id for r in jaccard.one_of_each(near, p).collect())
    assert kept == sorted(i for i, (_, c) in want.items() if c == i)
    twice = table(spark, ["a b c d e f", "x"]).unionByName(table(spark, ["a b c d e f", "another text"]))
    assert sorted((r.doc_id, r.text) for r in jaccard.one_of_each(twice, p).collect()) == [(0, "a b c d e f"), (1, "another text"), (1, "x")]


def test_rows_go_by_their_own_text(spark):
    copied, other = "a b c d e f", "quite another text of seven words"
    rows = [(5, copied), (None, copied), (None, other), (None, "still another text"), (7, copied), (7, "b b text"), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in [(0, copied), *rows[1:]] if i is not None] + [(None, x, "en", "s", 1) for x in (other, "still another text")], SCHEMA)
    kept = jaccard.one_of_each(docs, jaccard.Params(5, 80)).collect()
    assert {(r.doc_id, r.text) for r in kept} == {(0, copied), (7, "b b text"), (7, None), (None, other), (None, "still another text")} and len(kept) == 5


def test_empty_and_single(spark):
    none = table(spark, [])
    assert jaccard.join(none).count() == 0
    assert jaccard.one_of_each(none).count() == 0
    assert suffix.repeats(none).count() == 0
    assert imatch.fingerprints(none).count() == 0
    assert [tuple(r) for r in jaccard.join(table(spark, ["a b c"])).collect()] == [(0, 1, 0)]


def brute_repeats(rows, least):
    seen = {}
    w = {i: WORD.findall(lower(t or "")) for i, t in rows}
    for i, x in w.items():
        for j in range(len(x) - least + 1):
            seen.setdefault(tuple(x[j : j + least]), set()).add(i)
    out = {}
    for i, x in w.items():
        for name, ok in (("passages", lambda s, i=i: len(s) > 1), ("copied", lambda s, i=i: min(s) < i)):
            cover = []
            for j in range(len(x) - least + 1):
                if ok(seen[tuple(x[j : j + least])]):
                    if cover and cover[-1][1] >= j:
                        cover[-1][1] = j + least
                    else:
                        cover.append([j, j + least])
            if cover:
                out.setdefault(i, {})[name] = cover
    return out


def test_repeated_passages_equal_brute_force(spark):
    rng = random.Random(3)
    p1, p2, p3 = words(rng, 60), words(rng, 130), words(rng, 49)
    texts = [" ".join(words(rng, 40) + p1 + words(rng, 30)), " ".join(p2), " ".join(words(rng, 10) + p1 + p2), None, "", " ".join(p3), " ".join(words(rng, 5) + p3), " ".join(p2[20:100]), " ".join(words(rng, 3000) + p1), " ".join(p1).upper() + "!"]
    docs = table(spark, texts)
    want = brute_repeats(list(enumerate(texts)), 50)
    got = {r.doc_id: ([list(x) for x in r.passages], [list(x) for x in r.copied]) for r in suffix.repeats(docs).collect()}
    assert got == {i: (x["passages"], x.get("copied", [])) for i, x in want.items() if "passages" in x}
    cut = {r.doc_id: r.text for r in suffix.without_copies(docs).collect()}
    assert cut[0] == texts[0] and cut[1] == texts[1]
    assert cut[2].split() == texts[2].split()[:10]
    assert 7 not in cut  # no word was left
    assert cut[8].split() == texts[8].split()[:3000]
    hot = {r.doc_id for r in suffix.repeats(docs, suffix.Params(hot=2)).collect()}
    assert hot == set(got)


def test_hot_grams_lose_no_passage(spark):
    rng = random.Random(17)
    # the lowest of many hashes, so that the gram is selected wherever it stands
    common = min((words(rng, 25) for _ in range(400)), key=lambda x: int(suffix.grams(next(suffix.blocks(pa.array([" ".join(x)]))).hash, 25)[0]))
    texts = [" ".join(words(rng, 20) + common + words(rng, 40)) for _ in range(150)]
    for size in range(25, 40):
        tail = words(rng, size)
        texts += [" ".join(words(rng, 20) + common + tail + words(rng, 20)) for _ in range(2)]
    rng.shuffle(texts)
    docs = table(spark, texts).unionByName(spark.createDataFrame([(None, texts[3], "en", "s", 1)], SCHEMA))
    want = brute_repeats([(-1, texts[3]), *enumerate(texts)], 50)
    want = {None if i < 0 else i: (x["passages"], x.get("copied", [])) for i, x in want.items()}
    for hot in (50_000, 20):
        got = {r.doc_id: ([list(x) for x in r.passages], [list(x) for x in r.copied]) for r in suffix.repeats(docs, suffix.Params(hot=hot)).collect()}
        assert got == want, hot


def test_both_sides_of_a_repeat_come_from_one_document(spark):
    rng = random.Random(13)
    texts = []
    for _ in range(60):
        x, g, y = words(rng, 20), words(rng, 25), words(rng, 20)
        texts += [" ".join(words(rng, 30) + part + words(rng, 30)) for part in (x + g, g + y, x + g + y)]
    true = words(rng, 55)
    texts += [" ".join(words(rng, 9) + true), " ".join(true + words(rng, 9))]
    want = brute_repeats(list(enumerate(texts)), 50)
    got = {r.doc_id: ([list(x) for x in r.passages], [list(x) for x in r.copied]) for r in suffix.repeats(table(spark, texts)).collect()}
    assert got == {i: (x["passages"], x.get("copied", [])) for i, x in want.items()}
    assert set(got) == {180, 181}


def test_rows_sharing_an_id_stay_whole(spark):
    rng = random.Random(5)
    p = " ".join(words(rng, 80))
    docs = table(spark, [p, p]).unionByName(table(spark, ["short text"], 1))
    assert sorted((r.doc_id, r.text) for r in suffix.without_copies(docs).collect()) == sorted([(0, p), (1, p), (1, "short text")])


def test_leaks_are_found_in_spite_of_replaced_words(spark):
    rng = random.Random(11)
    item = words(rng, 60)
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(item[:9])), (2, None), (3, "")], "item_id long, text string")
    replaced = list(item)
    for at in range(4, 55, 9):
        replaced[at] = "other"
    texts = [" ".join(words(rng, 50) + item[5:40] + words(rng, 50)), " ".join(words(rng, 20) + replaced).upper(), " ".join(words(rng, 400)), None, "", " ".join(item[:5])]
    docs = table(spark, texts)
    found = {(r.doc_id, r.item_id): r for r in decontaminate.overlaps(docs, bench).collect()}
    assert {d for d, _ in found} == {0, 1}
    assert (found[0, 0].start, found[0, 0].end, found[0, 0].n_equal) == (50, 85, 35)
    assert (found[1, 0].start, found[1, 0].end, found[1, 0].n_equal) == (20, 80, 54)
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [2, 3, 4, 5]
    assert decontaminate.overlaps(docs, bench.limit(0)).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == 6
    assert decontaminate.clean(docs, bench).columns == docs.columns


def test_short_items_are_found_with_a_word_replaced_anywhere(spark):
    rng = random.Random(19)
    items, texts, want = [], [], set()
    for size in range(8, 21):
        item = words(rng, size)
        for at in range(size) if size > 8 else ():
            want.add((len(texts), len(items)))
            texts.append(" ".join(words(rng, 30) + [*item[:at], "other", *item[at + 1 :]] + words(rng, 30)))
        items.append(" ".join(item))
    item = words(rng, 15)
    want.add((len(texts), len(items)))
    texts.append(" ".join([item[0], "other", *item[2:13], "other", item[14]]))
    items.append(" ".join(item))
    item = words(rng, 60)  # an exact run of 11 words, and 12 equal with 4 replaced
    want.add((len(texts), len(items)))
    texts.append(" ".join([*item[:11], *words(rng, 20), *[x if i % 7 not in (3, 6) or i > 13 else "other" for i, x in enumerate(item[31:47])], *words(rng, 13)]))
    items.append(" ".join(item))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(table(spark, texts), bench).collect()} == want


def brute_leaks(texts, items, p=decontaminate.Params()):
    """Pairs of a text and an item of which some alignment has a mask's words equal, and enough equal words in some run or the whole item."""
    looked = [[j for j, x in enumerate(m) if x == "1"] for m in decontaminate.MASKS]
    out = set()
    for i, t in texts:
        w = WORD.findall(lower(t or ""))
        for k, item in items:
            v = WORD.findall(lower(item or ""))
            for at in range(1 - len(v), len(w)):
                equal = [w[at + j] == x if 0 <= at + j < len(w) else None for j, x in enumerate(v)]
                if sum(x is True for x in equal) < 6:
                    continue
                inside = lambda lo, n, e=equal: lo + n <= len(e) and None not in e[lo : lo + n]
                if not any(inside(lo, m[-1] + 1) and all(equal[lo + j] for j in m) for m in looked for lo in range(len(v))):
                    continue
                here = [x for x in equal if x is not None]
                total = list(itertools.accumulate(here, initial=0))
                run = any(total[z] - total[a] >= p.min_equal and total[z] - total[a] >= p.min_share * (z - a) for a in range(len(here)) for z in range(a + p.min_equal, len(here) + 1))
                if run or (len(here) == len(v) and total[-1] >= max(p.whole_item, p.min_share * len(v))):
                    out.add((i, k))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(23)
    items = [" ".join(words(rng, rng.choice((7, 8, 9, 12, 16, 30, 60)), 40)) for _ in range(25)] + [None, "", "Same Words " * 8]
    texts = [None, "", "same words " * 9]
    for k in range(90):
        v = items[k % 25].split()
        lo = rng.choice((0, 0, rng.randrange(len(v))))
        piece = [x if rng.random() > rng.choice((0, 0.1, 0.25, 0.35)) else f"w{rng.randrange(40)}" for x in v[lo:]]
        texts.append(" ".join(words(rng, rng.randrange(25), 40) + piece + words(rng, rng.randrange(25), 40)))
    want = brute_leaks(list(enumerate(texts)), list(enumerate(items)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = table(spark, texts)
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()} == want
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == set(range(len(texts))) - {i for i, _ in want}
    assert 20 < len({i for i, _ in want}) < 85


def test_pipeline_equals_brute_force(spark, small):
    import public_tokenizers
    import tiktoken

    import corpus_pipeline as c
    from tidemark.llm import bpe, language

    docs = language.accepted(c.documents(spark, small))
    rows = {r.doc_id: r.text for r in docs.collect()}
    rows = {i: rows[i] for i, (_, low) in brute_components(rows.items(), 5, 80).items() if i == low}
    for i, found in brute_repeats(sorted(rows.items()), 50).items():
        at = [m.start() for m in WORD.finditer(rows[i])] + [len(rows[i])]
        for lo, hi in reversed(found.get("copied", [])):
            rows[i] = rows[i][: at[lo]] + rows[i][at[hi] :]
    rows = {i: t for i, t in rows.items() if t is None or t == "" or t.strip()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    grams_ = lambda t: {x for w in [WORD.findall(lower(t))] for x in w}
    near_items = {i: [x for x in items if len(grams_(x[1]) & grams_(t or "")) >= 6] for i, t in rows.items()}
    leaked = {i for i, t in rows.items() if brute_leaks([(i, t)], near_items[i])}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.MULTI_50K)), special_tokens={})
    want = sorted((i, len(enc.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows.items() if i not in leaked)
    assert leaked and len(want) > 100
    assert sorted((r.doc_id, r.n_tokens, r.decoded_sha256) for r in c.run(spark, small).collect()) == want


def test_passes_over_a_large_benchmark(spark, monkeypatch):
    rng = random.Random(2)
    items = [words(rng, 30) for _ in range(5)]
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    docs = table(spark, [" ".join(x) for x in items])
    monkeypatch.setattr(decontaminate, "PASS_WORDS", 40)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()) == [(i, i) for i in range(5)]


def test_every_term_of_the_band_is_in_the_lexicon(spark):
    rng = random.Random(23)
    docs = table(spark, [" ".join(rng.sample([f"w{i}" for i in range(100)], 30)) for _ in range(50)])
    lex = imatch.lexicon(docs, imatch.Params(low=0.01, high=1.0))
    assert len(lex.terms) == 100 and len(lex.first) == 101
    assert np.diff(lex.first).max() > 1  # subsets overlap
    near = table(spark, ["a b c d", "a b c e", "d e", "d e"])
    prints = {r.doc_id: r.fingerprint for r in imatch.fingerprints(near, imatch.Params(low=0.01, high=1.0)).collect()}
    assert prints[2] == prints[3] and prints[0] != prints[2]


def brute_fingerprints(texts, p):
    """Fingerprint of each text, in plain Python integers; only the words' hashes are the module's."""
    mask = (1 << 64) - 1

    def mixed(x):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> 33)) * factor & mask
        return x ^ (x >> 33)

    def sequence(terms):
        return mixed(sum(mixed(t) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, t in enumerate(terms)) + len(terms) & mask)

    def bag(t):
        found = WORD.findall(lower(t))
        return sorted({int(next(suffix.blocks(pa.array([w], pa.large_string()))).hash[0]) for w in found})

    bags = {t: bag(t) for t in {*texts}}
    df = Counter(x for t in texts[: p[1]] for x in bags[t])
    p, n = p
    band = {x for x, k in df.items() if max(2, p.low * n) <= k <= max(2, p.high * n)}

    def of(t):
        out = []
        for k in range(p.subsets):
            seed = mixed((k + 1) * 0x9E3779B97F4A7C15 & mask)
            mine = [x for x in bags[t] if x in band and mixed(x ^ seed) < int(p.density(k) * 2**64)]
            out.append(f"{sequence(mine) >> 40:06x}" if mine else "------")
        if {*out} != {"------"}:
            return "".join(out)
        return f"words:{sequence(bags[t]) if bags[t] else 0:016x}"

    return {t: of(t) for t in bags}


def likeness(a, b):
    if a.startswith("words:") and b.startswith("words:"):
        return float(a == b)
    a, b = ([x[i : i + 6] if not x.startswith("words:") else "------" for i in range(0, 96 * 6, 6)] for x in (a, b))
    either = [(x, y) for x, y in zip(a, b, strict=True) if x != "------" or y != "------"]
    return sum(x == y for x, y in either) / len(either)


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(9)
    base = [" ".join(words(rng, 200, 600)) for _ in range(60)]
    texts = [*base, base[3], None, "", base[5] + " tail", "x", "é 😀 z", " ".join(words(rng, 30_000, 900)), "q1 q2", "q1 q2"]
    docs = table(spark, texts).withColumns({c: F.lit("clash") for c in ("bucket", "borrowed", "first", "lender", "at", "fingerprint", "n_tokens", "low")})
    p = imatch.Params(low=0.01, high=0.6)
    got = {r.doc_id: r for r in imatch.fingerprints(docs, p).collect()}
    assert len(got) == len(texts)
    plain = [t or "" for t in texts]
    edited = [t[: len(t) - len(t) // 2] + plain[(i + 1) % len(plain)][: len(t) // 2] for i, t in enumerate(plain)]
    prints = brute_fingerprints(plain + edited, (p, len(plain)))
    for i, (t, e) in enumerate(zip(plain, edited, strict=True)):
        nxt = plain[(i + 1) % len(plain)]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (prints[t], prints[e]), i
        assert got[i].near_edited == pytest.approx(likeness(prints[t], prints[e]))
        assert got[i].near_next == pytest.approx(likeness(prints[t], prints[nxt]))
    assert sum(r.near_edited for r in got.values()) > sum(r.near_next for r in got.values())
    repeated = docs.unionByName(docs.limit(1)).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    assert imatch.fingerprints(repeated, p).count() == len(texts) + 2


CLASHES = ("lower", "letters", "_lower", "gone", "again", "gone_id", "id", "class", "copied_", "copy_of", "ranges", "unlike", "h", "c", "s", "v", "n", "root", "low", "bucket", "item_id", "words", "component_id")


def test_stages_bear_clashing_columns_nulls_and_long_texts(spark):
    from tidemark.llm import language

    rng = random.Random(29)
    p = words(rng, 80)
    texts = [" ".join(p), " ".join(p), None, "", " ".join(words(rng, 60_000)), " ".join(p + words(rng, 40)), " ".join(words(rng, 12))]
    docs = table(spark, texts).unionByName(table(spark, texts[:3])).withColumns({c: F.lit("clash") for c in CLASHES})
    docs = docs.unionByName(docs.where("doc_id = 6").withColumn("doc_id", F.lit(None).cast("long")))
    bench = spark.createDataFrame([(0, " ".join(p[10:50]))], "item_id long, text string").withColumn("lower", F.lit(1))
    plain = docs.drop(*CLASHES)
    for stage in (language.accepted, lambda d: jaccard.one_of_each(d, jaccard.Params(5, 80)), suffix.without_copies, lambda d: decontaminate.clean(d, bench)):
        got, want = stage(docs), stage(plain)
        assert got.columns == docs.columns
        assert sorted(map(str, got.drop(*CLASHES).collect())) == sorted(map(str, want.collect()))
        assert stage(docs.limit(0)).count() == 0
    assert sorted((r.doc_id, r.text) for r in decontaminate.clean(docs, bench).where("doc_id is not null and text is not null").collect()) == [(3, ""), (4, texts[4]), (6, texts[6])]
    assert jaccard.join(docs).drop("doc_id").columns == ["n_shingles", "component_id"]
    assert suffix.repeats(docs).count() == imatch.fingerprints(plain).join(suffix.repeats(plain).select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id").distinct().count()
