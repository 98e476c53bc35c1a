"""Language profiles, importance resampling and lexical search against plain versions, and their edges."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import importance, language_id, lexical_search, terms

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def frame(spark, rows, parts=3):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, id int, score string").repartition(parts)


def plain_words(text):
    return WORD.findall((text or "").translate(LOWER))


ODD = [(0, None, "en"), (1, "", "en"), (2, "12 !?\n", "de"), (3, "a", None), (4, "ÉÀ İstanbul é", "fr"), (4, "ÉÀ İstanbul é", "fr"), (None, "the und and", "en"), (5, "the " * 300_000, "en"), (6, "字" * 50_000, "zh"), (7, "x́y", "en")]


# language profiles


def plain_bundle(text, n, d):
    symbols, letter = language_id.alphabet()
    s = [0, *(int(symbols[ord(c)]) for c in text), 0]
    s = [x for i, x in enumerate(s) if x or i == 0 or s[i - 1]]
    vector = {x: language_id.letter_vectors(np.array([x]), d)[0].astype(int) for x in set(s)}
    out = np.zeros(d, int)
    for i in range(len(s) - n + 1):
        g = np.ones(d, int)
        for j in range(n):
            g = g * np.roll(vector[s[i + j]], n - 1 - j)
        out += g
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_bundles_against_a_loop(n):
    rng = random.Random(n)
    texts = ["", "a", "!", "x y", "  Ab  ", "é́z", "字字"] + ["".join(rng.choice("abCÉß .\n字") for _ in range(rng.randrange(60))) for _ in range(20)]
    got = language_id.Profile(texts, n).bundles(np.arange(len(texts)), len(texts), 200)
    for t, v in zip(texts, got, strict=True):
        assert (v == plain_bundle(t, n, 200)).all(), t


def test_bundles_of_many_different_grams(monkeypatch):
    rng = random.Random(1)
    texts = ["".join(chr(rng.randrange(0x4E00, 0x5E00)) for _ in range(400)) for _ in range(5)]
    want = language_id.Profile(texts, 3).bundles(np.array([0, 1, 0, 1, 2]), 3, 100)
    monkeypatch.setattr(language_id, "GRAMS", 64)
    monkeypatch.setattr(language_id, "BOUND", 16)
    assert (language_id.Profile(texts, 3).bundles(np.array([0, 1, 0, 1, 2]), 3, 100) == want).all()
    assert (want[0] == plain_bundle(texts[0], 3, 100) + plain_bundle(texts[2], 3, 100)).all()


def test_letter_vectors_are_balanced_and_unrelated():
    v = language_id.letter_vectors(np.arange(97, 123), 1024).astype(float)
    assert (np.abs(v) == 1).all() and np.abs(v @ v.T / 1024 - np.eye(26)).max() < 0.2


def test_language_predictions_against_a_loop(spark, data):
    docs = [(r.doc_id, r.text[:600], r.lang) for r in spark.read.parquet(f"{data}/documents.parquet").collect()][:120] + ODD
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 3
    small = [(i, t[:2000] if t else t, x) for i, t, x in docs]
    sums = defaultdict(lambda: np.zeros(language_id.DIMENSIONS, int))
    for i, t, x in small:
        if crc(i) != 1 and x and t is not None:
            sums[x] += plain_bundle(t, 3, language_id.DIMENSIONS)
    langs = sorted(k for k, v in sums.items() if v.any())
    want = []
    for i, t, _ in small:
        if not t or not any(c.isalpha() for c in t):
            want.append((i, crc(i) == 1, "und", 0.0))
            continue
        v = plain_bundle(t, 3, language_id.DIMENSIONS)
        cos = [v @ sums[x] / np.linalg.norm(v) / np.linalg.norm(sums[x]) for x in langs]
        k = int(np.argmax(cos))
        want.append((i, crc(i) == 1, langs[k], round(float(max(0.0, cos[k])), 9)))
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in language_id.identify(frame(spark, small)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id").filter("lang is not null")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 250 and right / n >= 0.99


def test_language_edges(spark):
    got = {r.doc_id: r for r in language_id.identify(frame(spark, ODD)).collect()}
    assert language_id.identify(frame(spark, ODD)).count() == len(ODD)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2))
    assert all(0 <= r.score <= 1 for r in got.values()) and got[5].lang_pred in ("en", "fr")
    none = frame(spark, [(1, "abc def", None), (2, "ghi", None)])
    assert {(r.lang_pred, r.score) for r in language_id.identify(none).collect()} == {("und", 0.0)}
    assert language_id.identify(frame(spark, ODD).limit(0)).count() == 0


def test_language_labels_and_names_of_held_out_rows_change_nothing(spark):
    rows = [(i, random.Random(i).choice(["the cat and the dog", "der hund und die katze"]) * 3, "en" if random.Random(i).random() < 0.5 else "de") for i in range(60)]
    other = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 3 == 1 else x) for i, t, x in rows]
    a, b = (sorted(map(tuple, language_id.identify(frame(spark, r, p)).collect())) for r, p in ((rows, 1), (other, 5)))
    assert a == b


# terms


def test_terms_by_chunks(monkeypatch):
    rng = random.Random(3)
    texts = ["", "A", "é", "x" * 50] + ["".join(rng.choice("aB9 é.\n 字") for _ in range(rng.randrange(200))) for _ in range(60)]
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(terms, "CHUNK", size)
        for t in texts:
            assert [w.decode() for some in terms.terms(t.encode()) for w in some] == plain_words(t)


# importance resampling


def plain_resampled(docs, target, percent=10, size=1, n_buckets=10_000, least=20, seed="2024"):
    def of(text):
        w = plain_words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % n_buckets for n in range(1, size + 1) for i in range(len(w) - n + 1)], len(w)

    src, tgt = Counter(b for _, t in docs for b in of(t)[0]), Counter(b for t in target for b in of(t)[0])
    s_all, t_all = sum(src.values()), sum(tgt.values())
    out = []
    for i, t in docs:
        bs, n = of(t)
        g = sum(math.floor(1000 * math.log((tgt[b] + 1) * (s_all + n_buckets) / ((src[b] + 1) * (t_all + n_buckets)))) for b in bs)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = g // len(bs) if bs else 0
        out.append([i, len(bs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n >= least])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = k
    return sorted(map(str, (tuple(r[:5]) for r in out)))


@pytest.mark.parametrize("size, percent, least", [(1, 10, 20), (2, 35, 5), (3, 100, 1), (1, 50, 0)])
def test_resampled_against_a_loop(spark, monkeypatch, size, percent, least):
    monkeypatch.setattr(terms, "CHUNK", 40)
    rng = random.Random(size)
    docs = [(i, " ".join(rng.choice(["Ab", "cd", "é", "e9", "x-y", "z" * 30]) for _ in range(rng.randrange(60)))) for i in range(150)]
    docs += [(1000, None), (1001, ""), (1002, "the " * 3000), (None, "ab " * 30)]
    target = ["ab é ab e9", None, "", "cd"]
    got = importance.resample(frame(spark, [(*r, "en") for r in docs]), spark.createDataFrame([(t,) for t in target], "text string"), percent, size, 50, least)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(str, map(tuple, got.collect()))) == plain_resampled(docs, target, percent, size, 50, least)


def test_resampled_rows_that_repeat(spark):
    """A third of all rows are one row; each has a rank of its own."""
    docs = [(7, "ab " * 25)] * 100 + [(i, "cd ef " * 15) for i in range(100, 300)]
    got = importance.resample(frame(spark, [(*r, "en") for r in docs], 5), spark.createDataFrame([("ab",)], "text string"), 50).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"])
    assert len(got) == 300 and ranks == list(range(1, 151))
    by = sorted(((r["rank"] or 10**6, -r["score"], r["doc_id"]) for r in got))
    assert [x[1:] for x in by[:150]] == sorted(x[1:] for x in by)[:150]


def test_bracket_is_widened_until_it_holds_the_cutoff(spark):
    rows = spark.range(1000).select(F.expr("if(id < 700, 5, id)").alias("score")).cache()
    for take in (1, 2, 150, 299, 300, 301, 999, 1000):
        for accuracy in (1, 10, 2000):
            low, high, above = importance.bracket(rows, 1000, take, 1e-6, accuracy)
            scores = sorted((r.score for r in rows.collect()), reverse=True)
            assert low <= scores[take - 1] <= high and above == sum(s > high for s in scores) < take


def test_resampled_empty(spark):
    some = spark.createDataFrame([("ab",)], "text string")
    assert importance.resample(frame(spark, []), some).count() == 0
    docs = [(i, f"w{i} " * 30) for i in range(40)]
    got = importance.resample(frame(spark, [(*r, "en") for r in docs]), some.limit(0)).collect()
    assert sorted(map(str, map(tuple, got))) == plain_resampled(docs, [])


# lexical search


def plain_search(docs, items, top=20):
    docs = [(i, Counter(plain_words(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms, df = len(docs), sum(n for *_, n in docs), Counter(t for _, c, _ in docs for t in c)
    q = defaultdict(Counter)
    for i, t in items:
        q[i].update(plain_words(t))
    out = []
    for item, c in q.items():
        found = []
        for i, d, n in docs:
            m = 100 - 25 + 25 * n * n_docs // n_terms
            s = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * d[t] // (1000 * d[t] + 12 * m)) for t, k in c.items() if t in d)
            if s > 0:
                found.append((-s, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:top], 1)]
    return sorted(map(str, out))


def searched(spark, docs, items, top=20, parts=3):
    got = lexical_search.search(frame(spark, [(*r, "en") for r in docs], parts), spark.createDataFrame([(*r, 1, "x") for r in items], "item_id long, text string, rank int, item string"), top)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(str, map(tuple, got.collect())))


def some_texts(seed, n):
    rng = random.Random(seed)
    words = ["Ab", "cd", "é", "e9", "x-y", "z" * 20, *(f"w{k}" for k in range(40))]
    return [" ".join(rng.choices(words, k=rng.randrange(1, 25))) for _ in range(n)]


@pytest.mark.parametrize("top", [1, 3, 20])
def test_search_against_a_loop(spark, monkeypatch, top):
    for name, size in (("DOCS", 16), ("ITEMS", 3), ("TERMS", 8)):
        monkeypatch.setattr(lexical_search, name, size)
    docs = [*enumerate(some_texts(1, 200)), (300, None), (301, ""), (302, "!!"), (303, "ab " * 5000), (None, "ab cd"), (5, "ab cd"), (5, "ab cd")]
    items = [*enumerate(some_texts(2, 10)), (20, None), (21, ""), (22, "nowhere at all"), (23, "ab"), (23, "cd cd"), (None, "e9 w3")]
    assert searched(spark, docs, items, top) == plain_search(docs, items, top)


def test_search_ties_go_to_the_smaller_id_in_any_partition(spark):
    docs = [(i, "same words here") for i in range(400)] + [(1000 + i, "others") for i in range(50)]
    want = plain_search(docs, [(1, "same here"), (2, "words")])
    assert len(want) == 40 and all(searched(spark, docs, [(1, "same here"), (2, "words")], parts=p) == want for p in (1, 7))


def test_search_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_PAIRS", 20)
    docs, items = list(enumerate(some_texts(5, 80))), list(enumerate(some_texts(6, 12)))
    assert searched(spark, docs, items) == plain_search(docs, items)


def test_products_never_reach_two_to_the_53():
    rng = random.Random(9)
    for most in (10, 10**7, 10**10, 10**12):
        entries = [(i, {rng.randrange(50): rng.randrange(1, most) for _ in range(30)}) for i in range(4)]
        t = lexical_search.tiles(entries)[0]
        total = np.zeros((len(t.ids), 4), object)
        for run, parts in t.products():
            for p in parts:
                assert p.sum(0).max() * lexical_search.IMPACT < lexical_search.EXACT
                total[run] += p.astype(np.int64)
        want = np.zeros((len(t.ids), 4), object)
        for i, (_, e) in enumerate(entries):
            for k, v in e.items():
                want[list(t.ids).index(k), i] = v
        assert (total == want).all()


def test_search_with_scores_beyond_exact_doubles(spark):
    docs, items = list(enumerate(some_texts(7, 30))), [(1, "ab cd " * 400_000 + "w1"), (2, "w2")]
    assert searched(spark, docs, items) == plain_search(docs, items)


def test_search_empty(spark):
    for docs, items in (([], [(1, "ab")]), ([(1, "ab")], []), ([(1, None)], [(1, "ab")])):
        assert searched(spark, docs, items) == []
