"""Cases that once went wrong: odd white space, text starts, items of nothing, licences at any layout."""

import random

import numpy as np
import pytest

from tests.llm.test_operators import documents, edit_distance
from tidemark.llm import decontamination, license_scan, packing, scratch


def test_long_white_space_packs(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t, rng = Tokenizer.from_file(path("byte_bpe_50k.json")), random.Random(3)
    texts = [" " * 10**6, " \n" * 500_000, "a b " * 1000 + " " * 10**6 + "word", "\t" * 300_000 + "x" + "　" * 10**6 + "y. z", "".join(rng.choice("   \n\ta.") for _ in range(300_000))]
    encode = packing.encoder("byte_bpe_50k")
    for text in texts:
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
    pieces = packing.pack(documents(spark, list(enumerate(texts))), with_ids=False).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {r[0]: r[1] for r in pieces} == {i: len(encode(x)) + 1 for i, x in enumerate(texts)}


def test_an_item_without_its_first_letter():
    item = "abcdefghijklmnopqrst"
    for text in (item[1:], item[1:] + " and more", "x " + item[1:], item[:-1], item[:7] + item[8:]):
        assert [h[1] for h in decontamination.Matcher([(1, item)], 0.05).hits(text)] == [1], text
    assert decontamination.Matcher([(1, item)], 0.05).hits(item[2:]) == []


def test_items_against_edit_distance_at_every_place():
    rng, letters = random.Random(4), "abcdefghijklmnopqrstuvwxyz "
    items = [(k, decontamination.normal("".join(rng.choice(letters) for _ in range(rng.randrange(8, 60))))) for k in range(12)]
    m = decontamination.Matcher(items, 0.1)
    for _ in range(150):
        _, item = rng.choice(items)
        t = list(item)
        for _ in range(rng.randrange(0, 5)):
            i = rng.randrange(len(t))
            t[i : i + 1] = rng.choice(["", rng.choice(letters), t[i] + rng.choice(letters)])
        before, after = ("".join(rng.choice(letters) for _ in range(rng.choice([0, 0, 3, 20]))) for _ in "ab")
        text = decontamination.normal(before + "".join(t) + after)
        want = {k: d for k, x in items if (d := edit_distance(x, text)) <= decontamination.budget(len(x), 0.1)}
        assert {k: d for k, d, _ in m.hits(text)} == want


@pytest.mark.parametrize("rate", [0.0, 0.05, 0.1, 0.2, 0.3])
@pytest.mark.parametrize("letters", ["ab", "abcdé𝄞 ", "abcdefghijklmnopqrstuvwxyz "])
def test_thinned_hits_over_many_stretches(monkeypatch, rate, letters):
    """Places looked up 16 at a time; items longer than that, repeated items, few letters: every item within its budget is found."""
    monkeypatch.setattr(decontamination, "STEP", 16)
    rng = random.Random(f"{rate} {letters}")
    items = [(k, decontamination.normal("".join(rng.choice(letters) for _ in range(rng.randrange(1, 90))))) for k in range(10)]
    items += [(100 + k, x) for k, x in items[:3]]
    m = decontamination.Matcher(items, rate)
    for _ in range(25):
        t = ""
        for _ in range(rng.randrange(1, 4)):
            part = list(rng.choice(items)[1])
            for _ in range(rng.randrange(0, 12)):
                if part:
                    i = rng.randrange(len(part))
                    part[i : i + 1] = rng.choice(["", rng.choice(letters), part[i] + rng.choice(letters)])
            t += "".join(part) + "".join(rng.choice(letters) for _ in range(rng.choice([0, 3, 30])))
        text = decontamination.normal(t)
        want = {k: d for k, x in items if x and (d := edit_distance(x, text)) <= decontamination.budget(len(x), rate)}
        assert {k: d for k, d, _ in m.hits(text)} == want


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    """Items in one block, in several and read once: the same rows; a rate that lets everything match is an error."""
    docs = documents(spark, [(i, f"text {i} holds the quick brown fox number {i} and then jumps over lazy dog {i % 7}") for i in range(40)] + [(90, None), (91, "")])
    bench = spark.createDataFrame([(k, f"quick brown fox number {k} and then") for k in range(0, 60, 3)] + [(None, "quick brown fox"), (5, None)], "item_id long, text string")
    one = sorted(map(tuple, decontamination.contaminated(docs, bench, 0.1).collect()))
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 100)
    assert len(list(decontamination.item_blocks(bench, "item_id", "text"))) > 5
    assert sorted(map(tuple, decontamination.contaminated(docs, bench, 0.1).collect())) == one and len(one) >= 14
    with pytest.raises(ValueError):
        decontamination.Matcher([(1, "a")], 1.0)


def test_items_of_marks_alone(spark):
    b = spark.createDataFrame([(1, "́̂"), (2, "́ one two three four five"), (3, None), (4, "")], "item_id long, text string")
    got = decontamination.contaminated(documents(spark, [(1, "so one two three four five"), (2, "́"), (3, None)]), b, 0.05).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 2)]


def test_contaminated_against_brute_force(spark, data):
    """Both directions, over the given tables: texts cut to those around each item's length keep plain edit distance affordable."""
    docs = [(r.doc_id, decontamination.normal(r.text)) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    bench = [(r.item_id, decontamination.normal(r.text)) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    rng = random.Random(6)
    rng.shuffle(bench)
    some = [(i, t) for i, t in docs if len(t) < 2500][:60]
    items = bench[:6]
    got = {(r.doc_id, r.item_id, r.distance) for r in decontamination.contaminated(documents(spark, some), spark.createDataFrame(items, "item_id long, text string"), 0.05).collect()}

    def least(item, text):  # Sellers' rows, by numpy: the same recurrence as edit_distance
        n = len(text)
        codes, row, steps = np.array([ord(c) for c in text] or [0])[:n], np.zeros(n + 1, int), np.arange(n + 1)
        for i, c in enumerate(item, 1):
            new = np.empty(n + 1, int)
            new[0] = i
            new[1:] = np.minimum(row[1:] + 1, row[:-1] + (codes != ord(c)))
            row = np.minimum.accumulate(new - steps) + steps
        return int(row.min())

    assert least("abcd", "xxabdxx") == edit_distance("abcd", "xxabdxx") == 1
    want = {(i, k, d) for i, t in some for k, x in items if (d := least(x, t)) <= decontamination.budget(len(x), 0.05)}
    assert got == want


@pytest.mark.parametrize("text", ["Licensed\tunder\tthe\tMIT\tLicense.", "Licensed under the MIT License.", "Licensed under the MIT License." + " " * 30_000, "*" * 30_000 + "Licensed under the MIT License.", "We ship code. Licensed under the MIT License. See the docs for more on this and on that."])
def test_a_notice_in_odd_layout(text):
    assert set(license_scan.Scanner(license_scan.TEMPLATES, 0.9).scan(text)) == {"MIT"}


def test_scan_against_all_windows_and_templates(spark):
    """Licences of short texts with one notice each, possibly changed, against every window and template."""
    few = {k: [t for t in v if len(t.split()) < 25] for k, v in license_scan.TEMPLATES.items()}
    few = {k: v for k, v in few.items() if v}
    rng, plain = random.Random(8), [f"plain{i}" for i in range(50)]
    rows = []
    for k in range(120):
        name = rng.choice(sorted(few))
        w = rng.choice(few[name]).split()
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = rng.choice(plain)
        text = "".join(x + rng.choice([" ", " ", "\t", "\n", "  "]) for x in rng.choices(plain, k=rng.randrange(6)) + w + rng.choices(plain, k=rng.randrange(6)))
        rows.append((k, text))
    got = {i: {} for i, _ in rows}
    for r in license_scan.scan_licenses(documents(spark, rows), few).collect():
        got[r.doc_id][r.license] = r.dice
    for i, text in rows:
        words = license_scan.normal_words(text)
        best = {}
        for name, ts in few.items():
            for t in ts:
                b = license_scan.bigrams(license_scan.normal_words(t))
                size = sum(b.values())
                for a in range(len(words)):
                    for z in range(a + 2, len(words) + 1):
                        shared = sum((license_scan.bigrams(words[a:z]) & b).values())
                        best[name] = max(best.get(name, 0), 2 * shared / (max(z - a - 1, min(size, len(words) - 1)) + size))
        top = max(best.values(), default=0)
        want = {k for k, v in best.items() if v == top and v >= 0.9}
        # a part of a line or paragraph may come nearer than any window; the nearest licence is the same
        assert want <= set(got[i]) and (want or not got[i] or max(got[i].values()) >= 0.9), (text, best, got[i])
        if top < 0.8:
            assert not got[i]


def test_no_folder_of_one_machine_on_a_cluster(spark):
    class Elsewhere:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda *_: None)

    with pytest.raises(ValueError):
        scratch.shared_folder(Elsewhere)
