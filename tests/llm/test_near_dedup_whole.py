"""Near duplicates in a dense family, where the forest alone misses links."""

import random

from tests.llm.test_operators import documents
from tidemark.llm import near_dedup


def family(n_pairs, n_single, passage=100, tail=14, shared=2):
    """One-word shingles: all documents share a passage and stay just below 80 % but for pairs that also share a few words."""
    common, out = [f"c{i}" for i in range(passage)], []
    for p in range(n_pairs):
        both = [f"p{p}x{i}" for i in range(shared)]
        out += [both + [f"p{p}{side}{i}" for i in range(tail - shared)] for side in "ab"]
    out += [[f"s{k}y{i}" for i in range(tail)] for k in range(n_single)]
    rows = [(i, " ".join(common + words)) for i, words in enumerate(out)]
    random.Random(5).shuffle(rows)
    return rows


def test_links_in_a_dense_family(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 700)  # several blocks, compared by differences from a centre
    got = near_dedup.near_duplicates(documents(spark, family(700, 1700)), 80, 1).select("doc_id", "component_id").collect()
    want = {i: i - i % 2 if i < 1400 else i for i in range(3100)}
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_pairs_among_documents_of_one_template(spark):
    """1,300 documents of one template of 600 words with 13 edits each, 6 of them shared by pairs: all links, none else."""
    rng, rows, want = random.Random(7), [], {}
    template = [f"w{rng.randrange(3000)}" for _ in range(600)]
    for p in range(650):
        places = rng.sample(range(600), 20)
        for side, own in ((0, places[6:13]), (1, places[13:])):
            w = list(template)
            for i in places[:6]:
                w[i] = f"c{p}x{i}"
            for i in own:
                w[i] = f"u{p}x{side}x{i}"
            rows.append((2 * p + side, " ".join(w)))
            want[2 * p + side] = 2 * p

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    for p in range(650):
        a, b = shingles(rows[2 * p][1]), shingles(rows[2 * p + 1][1])
        if 100 * len(a & b) < 85 * len(a | b):
            want[2 * p + 1] = 2 * p + 1
    got = near_dedup.near_duplicates(documents(spark, rows), 85, 3).select("doc_id", "component_id").collect()
    found = {r["doc_id"]: r["component_id"] for r in got}
    assert sum(want[i] != i for i in want) > 600
    assert all(found[i] == want[i] for i in want)


def test_shared_counts_against_sets():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 9000, rng.integers(0, 6000))).astype(np.uint64) for _ in range(12)]
    got = near_dedup.shared(sets[:5], sets[5:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]
    assert near_dedup.shared([sets[0][:0]], [sets[0][:0]]).tolist() == [[0]]


def test_links_from_differences_equal_those_of_whole_sets():
    """Any centre, the empty one too, gives the links that full sets give."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(50, 61)], rng.integers(0, 2**63, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(40)]
    for middle in (near_dedup.centre(sets[:7]), sets[3], sets[0][:0], np.sort(rng.integers(0, 2**63, 30).astype(np.uint64))):
        rows = [(9, 4, None, middle.tobytes()), *[(9, 4, i, s.tobytes()) for i, s in enumerate(sets)]]
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(4)], ["family", "portion", "id", "shingles"])
        away = [r for b in near_dedup._differences([batch]) for r in b.to_pylist()]
        assert [len(r["shingles"]) // 8 for r in away] == [len(np.setxor1d(s, middle)) for s in sets]
        cols = [[1] * 40, [9] * 40, [i % 2 for i in range(40)], list(range(40)), list(range(40)), [len(s) for s in sets], [r["shingles"] for r in away]]
        got = {(r["a"], r["b"]) for b in near_dedup._family_links(80)([pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [f"c{i}" for i in range(7)])]) for r in b.to_pylist()}
        link = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        every = {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 2 != b % 2 and link(sets[a], sets[b])}
        assert got and got <= every

        def classes(links):
            top = list(range(40))
            for _ in range(40):
                for a, b in links:
                    top[a] = top[b] = min(top[a], top[b])
            return top

        assert classes(got) == classes(every)


def test_differences_without_a_centre_and_of_two_portions():
    import numpy as np
    import pyarrow as pa

    one, two = np.array([1, 2, 3], np.uint64), np.array([2, 3, 4], np.uint64)
    rows = [(1, 0, None, two.tobytes()), (1, 0, 5, one.tobytes()), (1, 1, 6, one.tobytes())]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows]) for i in range(4)], ["family", "portion", "id", "shingles"])
    got = [(r["id"], np.frombuffer(r["shingles"], np.uint64).tolist()) for b in near_dedup._differences([batch]) for r in b.to_pylist()]
    assert got == [(5, [1, 4]), (6, [1, 2, 3])]
