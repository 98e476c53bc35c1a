"""Each operator against a plain version of it, and its edges: nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import chat_format, components, decontamination, html_extraction, license_scan, near_dedup, packing, quality_classifier, quality_rules, queries, sharding, substring_dedup

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text):
    return WORD.findall((text or "").encode())


def documents(spark, texts, **more):
    """A table with clashing extra columns."""
    rows = [(i, t, "x", 1.0, 0) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, chunk string, part double, id int").withColumnsRenamed(more)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    vocabulary = ["The", "the", "of", "a", "b#", "c|", "é", "ü!", " ", "x y"]
    base = " ".join(rng.choice(vocabulary) + str(rng.randrange(50)) for _ in range(120))
    long = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    texts = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "one"), (5, "One two"), (6, base), (7, base), (7, base), (8, base + "\n" + base), (9, base.replace("7", "8", 3)), (10, long), (None, base), (None, None), (11, "one " * 80), (12, "x" * 50_000), (13, "ONE"), (14, "a\nb\na\n\na"), (-5, base.lower())]
    return texts


def test_substrings(spark, odd):
    def brute(rows, n):
        count, out = Counter(), []
        for _, t in rows:
            w = words(t)
            count.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        for i, t in rows:
            w = words(t)
            gone = set()
            for p in range(len(w) - n + 1):
                if count[tuple(w[p : p + n])] > 1:
                    gone.update(range(p, p + n))
            out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
        return sorted(out, key=str)

    for n, first in ((35, None), (35, 5), (7, 2), (1, None)):
        got = substring_dedup.remove_repeats(documents(spark, odd), n, first).collect()
        assert sorted(map(tuple, got), key=str) == brute(odd, n), (n, first)
    empty = documents(spark, [])
    assert substring_dedup.remove_repeats(empty, carry=("chunk", "part")).columns == ["doc_id", "chunk", "part", "n_words", "n_removed", "kept_text"]
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert substring_dedup.level_lengths(35) == [18, 35] and substring_dedup.level_lengths(35, 4) == [4, 8, 16, 32, 35]


def shingles(text, n):
    w = (text or "").encode().translate(LOWER)
    w = WORD.findall(w)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent, n):
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def test_near_duplicates(spark, odd):
    rng = random.Random(2)
    rows = [(i, t) for i, t in odd if i is not None]
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    for k in range(60):  # a star: some within reach of one another, some only of the middle
        w = list(base)
        for _ in range(rng.randrange(6)):
            w[rng.randrange(150)] = f"e{rng.randrange(9999)}"
        rows.append((100 + k, " ".join(w)))
    rows += [(300 + k, " ".join(f"v{rng.randrange(10**6)}" for _ in range(5))) for k in range(20)]
    got = near_dedup.near_duplicates(documents(spark, rows), 85, 3)
    assert sorted(map(tuple, got.collect())) == brute_components(rows, 85, 3)
    nulls = near_dedup.near_duplicates(documents(spark, odd), 85, 3).filter("doc_id is null").collect()
    assert [(r.component_id, r.kept) for r in nulls] == [(None, True)] * 2
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0


def test_near_duplicates_of_given_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for percent, n in ((85, 3), (80, 5)):
        assert sorted(map(tuple, near_dedup.near_duplicates(docs, percent, n).collect())) == brute_components(rows, percent, n)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 100), (200, 201)], "a long, b long")
    got = {r.node: r.label for r in components.components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[201] == 200 and 100 not in got


def test_sharding(spark, odd):
    rows = odd + [(i, f"t{i}") for i in range(1000, 4000)]
    docs = documents(spark, rows)
    got = sharding.assign(docs, sharding.even_tree(16), sharding.even_tree(17)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) == set(range(16))
    moved = sum(r.grown_shard == 16 for r in got) / len(got)
    assert 0.04 < moved < 0.08 and max(map(len, by.values())) < 1.5 * min(map(len, by.values()))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert sharding.assign(documents(spark, []), sharding.even_tree(3)).count() == 0


def test_sharding_descends_by_draws(spark):
    """Every row's shard against a descent of plain Python."""
    import math

    import xxhash

    tree = [sharding.Leaf(0, 0, 0, 1.0), sharding.Leaf(0, 0, 1, 2.0), sharding.Leaf(0, 1, 2, 0.5), sharding.Leaf(1, 2, 3, 4.0), sharding.Leaf(1, 3, 4, 0.0), sharding.Leaf(2, 4, 5, 1.0), sharding.Leaf(2, 4, 6, 1.0), sharding.Leaf(2, 5, 7, 3.0)]

    def drawn(key, path):
        h = 42
        for v in (key, *path):
            h = xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), h) if v is not None else h
        return -math.log(((h >> 11) + 0.5) / 2**53) / sum(x.weight for x in tree if x.path[: len(path)] == path)

    def descend(key):
        path = ()
        while len(path) < 3:
            below = {x.path[: len(path) + 1] for x in tree if x.path[: len(path)] == path and x.weight > 0}
            path = min(below, key=lambda p: (drawn(key, p), p[-1]))
        return path[-1]

    got = sharding.assign(documents(spark, [(i, "") for i in range(-200, 2000)] + [(None, "")]), tree).collect()
    assert all(r.shard == descend(r.doc_id) for r in got)
    share = Counter(r.shard for r in got)
    for x in tree:
        assert abs(share[x.shard] / len(got) - x.weight / 12.5) < 0.03


def test_movement_stays_in_the_subtrees_whose_weights_change(spark):
    docs = documents(spark, [(i, "") for i in range(5000)])
    tree = sharding.even_tree(20, 20, 3, 2)
    at = {x.shard: x for x in tree}
    place = lambda t: {r.doc_id: r.shard for r in sharding.assign(docs, t).collect()}
    old = place(tree)
    for weight in (3.0, 0.0):
        new = place([sharding.Leaf(x.region, x.rack, x.shard, weight if x.shard == 7 else 1.0) for x in tree])
        moves = [(at[a], at[new[k]]) for k, a in old.items() if a != new[k]]
        assert moves
        for a, z in moves:
            into, out_of = (z, a) if weight > 1 else (a, z)
            assert into.region == at[7].region
            if a.region == z.region:
                assert into.rack == at[7].rack
                if a.rack == z.rack:
                    assert into.shard == 7
        now = Counter(new.values())[7] / Counter(old.values())[7]
        assert 2 < now < 4 if weight else now == 0
    with pytest.raises(ValueError):
        sharding.with_shard(docs, "doc_id", [], "shard")
    for n in (16, 17, 23):
        a, b = place(sharding.even_tree(n)), place(sharding.even_tree(n + 1))
        assert {b[k] for k in a if a[k] != b[k]} == {n}


def test_packing(spark, odd):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = [(k, x) for k, (_, x) in enumerate(odd)] + [(100, "a<|endoftext|>b"), (101, "é 漢字 😀  x")]
    pieces = packing.pack(documents(spark, rows), width=64).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        seq[p.sequence_id].append((p.offset, p.length))
    for i, text in rows:
        want = t.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(by[i], key=lambda p: p.start)
        assert b"".join(p.ids for p in own) == np.array(want, "<u4").tobytes()
        assert {p.doc_tokens for p in own} == {len(want)} and all(zlib.crc32(p.ids) == p.ids_crc32 for p in own)
    for k, v in seq.items():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at == 64 or k == max(seq)
    assert sorted(seq) == list(range(len(seq)))
    assert packing.pack(documents(spark, [])).count() == 0


def test_both_tokenizers_agree_on_every_code_point():
    import unicodedata

    from public_tokenizers import path
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(path("byte_bpe_50k.json")), packing.encoder("byte_bpe_50k")
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    for make in (lambda c: f"a{c}1 {c}b  {c}",):
        for k in range(0, len(points), 4000):
            texts = [make(c) for c in points[k : k + 4000]]
            for text, got in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True):
                assert got.ids == e(text).tolist(), ascii(text)


def test_classifier(spark, data, odd):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.9
    r = quality_classifier.classify(documents(spark, odd), labels).collect()
    assert len(r) == len(odd) and all(np.isfinite(x.score) for x in r)
    assert len({x.score for x in r if x.doc_id in (1, 2, 3)}) == 1
    assert quality_classifier.classify(documents(spark, []), labels).count() == 0
    assert {x.score for x in quality_classifier.classify(documents(spark, odd), labels.limit(0)).collect()} == {0.5}


def test_discriminant_is_the_log_density_difference():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(400, 3)), rng.normal(2, 3, size=(300, 3))
    m = quality_classifier.discriminant(np.array([400.0, 300.0]), np.stack([a.sum(0), b.sum(0)]), np.stack([a.T @ a, b.T @ b]))

    def density(x, k):
        c = m.lower[k] @ m.lower[k].T
        z = x - m.mean[k]
        return -0.5 * np.einsum("ni,ij,nj->n", z, np.linalg.inv(c), z) - 0.5 * np.linalg.slogdet(c)[1] + np.log([4 / 7, 3 / 7][k])

    x = rng.normal(size=(20, 3))
    assert np.allclose(m.margin(x), density(x, 1) - density(x, 0))


def edit_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=20), st.integers(0, 4))
@settings(max_examples=200, deadline=None)
def test_myers(item, text, k):
    assert decontamination.distance(item, text, k) == min(edit_distance(item, text), k + 1)


@given(st.text("ab ", min_size=1, max_size=14), st.text("ab ", max_size=40), st.sampled_from([0.0, 0.1, 0.25]))
@settings(max_examples=200, deadline=None)
def test_pigeonhole_finds_all(item, text, rate):
    k = decontamination.budget(len(item), rate)
    want = edit_distance(item, text) <= k
    assert bool(decontamination.Matcher([(1, item)], rate).hits(text)) == want


def test_contaminated(spark, data, odd):
    docs, bench = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench, 0.05).collect()}
    items = [(r.item_id, decontamination.normal(r.text)) for r in bench.collect()]
    exact = {(r.doc_id, k) for r in docs.collect() for k, t in items if t in decontamination.normal(r.text)}
    assert exact and exact <= got
    item = " ".join(f"word{i}" for i in range(30))
    rows = odd + [(50, "x " + item.replace("word7", "wrd7").upper() + "!"), (51, item.replace("word", "w"))]
    b = spark.createDataFrame([(1, item), (2, None), (None, "one two three"), (3, " .. "), (1, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.distance) for r in decontamination.contaminated(documents(spark, rows), b, 0.1).collect()] == [(50, 1, 1)]
    assert decontamination.contaminated(documents(spark, []), b).count() == 0 == decontamination.contaminated(documents(spark, rows), b.limit(0)).count()


def base_counts(text):
    w = [x.decode() for x in words(text)]
    where = defaultdict(list)
    for i in range(len(w) - 7):
        where[tuple(w[i : i + 8])].append(i)
    again = {k for v in where.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if words(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again)


def test_quality_rules(spark, data, odd):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    crf = quality_rules.fit(docs, labels)
    for rows in (odd, [(r.doc_id, r.text) for r in docs.collect()]):
        got = quality_rules.judge(documents(spark, rows), crf).collect()
        assert sorted([(r.doc_id, *tuple(r)[1:6]) for r in got], key=str) == sorted([(i, *base_counts(t)) for i, t in rows], key=str)
        assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got) and not any(r.kept and r.base_failed for r in got)
    kept = {r.doc_id: r.kept for r in got}
    for quality in (0, 1):
        right = [kept[r.doc_id] == r.quality for r in labels.collect() if r.quality == quality]
        assert np.mean(right) > 0.9, quality
    # the whole verdict, by a decoder that tries every step
    for r, (_, text) in zip(sorted(got, key=lambda r: r.doc_id), sorted((r.doc_id, r.text) for r in docs.collect()), strict=True):
        lines, _ = quality_rules.lines_of(text or "")
        share = sum(n for (n, _), y in zip(lines, plain_viterbi(crf, [b for _, b in lines]), strict=True) if y) / max(sum(n for n, _ in lines), 1)
        assert r.kept == (not r.base_failed and share >= 0.5) and abs(share - r.content_share) < 1e-12
    assert quality_rules.judge(documents(spark, []), crf).count() == 0
    assert quality_rules.fit(docs, labels.limit(0)).emission[0, 1] == 1.0


def plain_viterbi(crf, bits):
    """Best labels by scores and whole paths, ties to content."""
    best = None
    for b in bits:
        e = np.array([b >> i & 1 for i in range(len(quality_rules.FEATURES))]) @ crf.emission
        if best is None:
            best = [(e[0], []), (e[1], [])]
            paths = [[0], [1]]
            continue
        steps = [[best[j][0] + crf.transition[j, k] for j in (0, 1)] for k in (0, 1)]
        pick = [0 if s[0] > s[1] else 1 for s in steps]
        paths = [paths[pick[k]] + [k] for k in (0, 1)]
        best = [(steps[k][pick[k]] + e[k], None) for k in (0, 1)]
    return [] if best is None else paths[1] if best[1][0] >= best[0][0] else paths[0]


def test_likelihood_and_gradient_against_all_label_sequences():
    import itertools

    rng = np.random.default_rng(5)
    f = len(quality_rules.FEATURES)
    for _ in range(10):
        lengths, theta = rng.integers(1, 6, 5), rng.normal(size=quality_rules.N_ALL)
        seq = [rng.integers(0, 2**f, n) for n in lengths]
        y, w = rng.integers(0, 2, 5), rng.random(5)

        def value(theta, seq=seq, y=y, w=w):
            em, tr, total = theta[: 2 * f].reshape(f, 2), theta[2 * f :].reshape(2, 2), 0.0
            for s, label, weight in zip(seq, y, w, strict=True):
                e = np.array([[b >> i & 1 for i in range(f)] for b in s]) @ em
                score = lambda ls, e=e: sum(e[t, k] for t, k in enumerate(ls)) + sum(tr[a, b] for a, b in zip(ls, ls[1:], strict=False))
                total += weight * (score([label] * len(s)) - np.log(sum(np.exp(score(ls)) for ls in itertools.product((0, 1), repeat=len(s)))))
            return total

        starts = np.zeros(lengths.sum(), bool)
        starts[np.cumsum(lengths) - lengths] = True
        got = quality_rules.chain_sums(np.concatenate(seq), starts, np.repeat(y, lengths), np.repeat(w, lengths), theta)
        slope = [(value(theta + h) - value(theta - h)) / 2e-5 for h in np.eye(len(theta)) * 1e-5]
        assert np.isclose(got[0], value(theta)) and np.allclose(got[1:], slope, atol=1e-5)


def test_the_maximum_of_a_concave_function():
    a = np.diag([1.0, 10.0, 100.0]) + 0.5
    want = np.array([1.0, -2.0, 3.0])
    got = quality_rules.maximum(lambda x: (-0.5 * (x - want) @ a @ (x - want), -a @ (x - want)), 3)
    assert np.allclose(got, want, atol=1e-5)


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(1)
    f = len(quality_rules.FEATURES)
    for _ in range(50):
        crf = quality_rules.Crf(rng.normal(size=(f, 2)), rng.normal(size=(2, 2)))
        bits = rng.integers(0, 2**f, 7).tolist()

        def score(y, crf=crf, bits=bits):
            e = sum((np.array([b >> i & 1 for i in range(f)]) @ crf.emission)[k] for b, k in zip(bits, y, strict=True))
            return e + sum(crf.transition[a, b] for a, b in zip(y, y[1:], strict=False))

        best = max(([n >> i & 1 for i in range(7)] for n in range(128)), key=score)
        assert crf.decode([(1, b) for b in bits], {}) == best


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p {margin:0}</style></head><body class="page"><header><h1>Site</h1></header>
<nav><ul><li><a href=/a>Home</a></ul></nav><div class="cookie-notice">We use cookies.</div><script>var t="</p><p>no";</script>
{}<form><input value="x"><label>Mail</label></form><section id="comments"><p>First reader comment that is long enough to matter.</p></section>
<aside>Other stories</aside><footer>&copy; me</footer></body></html>"""


def test_html():
    body = "<h1>Head &amp; line</h1><p>One  \n two<b>bold</b> <a href=x>link</a> &lt;tag&gt; &#233;<p>Three<br>four<!-- no --><ul><li>item<li>other</ul><div class='ad'>Buy</div>"
    want = "Head & line One twobold link <tag> é Three four item other"
    assert html_extraction.main_text(PAGE.replace("{}", f"<article>{body}</article>")) == want
    assert html_extraction.main_text(PAGE.replace("{}", f"<div class=post>{body}</div>")) == want
    assert html_extraction.main_text(PAGE.replace("{}", f"<article>{body}</article>")[: PAGE.index("{}") + len(body) - 20]).startswith("Head & line One twobold")
    assert html_extraction.main_text(None) == "" == html_extraction.main_text("") == html_extraction.main_text("<script>x</script>")
    assert html_extraction.main_text("just text &amp; more") == "just text & more"
    assert html_extraction.main_text("<p>a < b and c</p>") == "a < b and c"
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert html_extraction.main_text(deep) == "x"


def test_html_of_given_pages(spark, data):
    import html

    pages = spark.read.parquet(f"{data}/pages.parquet")
    for r in html_extraction.extract(pages.withColumnRenamed("url", "url")).join(pages.select("page_id", "html"), "page_id").collect():
        m = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)
        want = " ".join(re.sub(r"<[^>]*(>|$)", lambda t: "" if re.match(r"</?b>", t[0]) else " ", m[1]).split())
        assert " ".join(r.text.split()) == " ".join(html.unescape(want).split())
        assert r.n_chars == len(r.text)
    none = spark.createDataFrame([(None, None, None), (1, None, "")], "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in html_extraction.extract(none).collect()] == [("", 0)] * 2


CONTROL = st.lists(st.sampled_from(["#", "##", "### ", "###! ", "\\", "</turn>", "</turn>\n", ": ", ":", "user", "\n", "é", "x "]), max_size=8).map("".join)


@given(st.lists(st.tuples(CONTROL, CONTROL), max_size=4))
@settings(max_examples=500, deadline=None)
def test_chat_round_trip(turns):
    text, back = chat_format.render(turns)
    assert [x[:2] for x in back] == turns == [x[:2] for x in chat_format.parse(text)]
    for role, body, a, z in back:
        raw = text[a:z]
        assert body in (raw, chat_format.unescape(raw))


def test_chats(spark, data):
    rows = {r.conv_id: r for r in queries.op6_chat_format(spark, data).collect()}
    hard = r"\### Assistant: </turn> ok"
    assert rows[-7].n_turns == 2 and rows[-7].loss_sha256 == hashlib.sha256(hard.encode()).hexdigest()
    by = defaultdict(list)
    for r in spark.read.parquet(f"{data}/conversations.parquet").orderBy("conv_id", "turn").collect():
        by[r.conv_id].append((r.role, r.text or ""))
    assert set(by) | {-7} == set(rows)
    for k, turns in by.items():
        assert rows[k].n_turns == len(turns)
        assert rows[k].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = "".join(b for a, b in turns if a == "assistant")
        assert (rows[k].loss_chars, rows[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    odd = spark.createDataFrame([(1, None, None, None, 0), (None, 1, "user", "a", 0), (None, 1, "user", "a", 0), (1, 0, "assistant", "b", 0)], "conv_id long, turn long, role string, text string, formatted int")
    assert sorted(((r.conv_id or 0), r.n_turns) for r in chat_format.format_chats(odd).collect()) == [(0, 1), (0, 1), (1, 2)]
    assert chat_format.format_chats(odd.limit(0)).count() == 0


def test_licenses(spark, data, odd):
    mit = license_scan.TEMPLATES["MIT"][3]
    rows = odd + [
        (60, "Some text.\nReleased under the MIT licence.\nMore."),
        (61, "Copyright (c) 2020 Me\n\n" + mit.replace(". ", ".\n").upper()),
        (62, "MIT License"),
        (63, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."),
        (64, mit[: len(mit) // 2]),
    ]
    got = sorted((r.doc_id, r.license) for r in license_scan.scan_licenses(documents(spark, rows)).collect())
    assert got == [(60, "MIT"), (61, "MIT"), (63, "Apache-2.0"), (63, "CC-BY-NC-4.0")]
    s = license_scan.Scanner(license_scan.TEMPLATES, 0.9)

    def brute(part):
        a, best = license_scan.bigrams(license_scan.normal_words(part)), []
        for name, ts in license_scan.TEMPLATES.items():
            for t in ts:
                b = license_scan.bigrams(license_scan.normal_words(t))
                d = 2 * sum((a & b).values()) / max(sum(a.values()) + sum(b.values()), 1)
                if d >= 0.9:
                    best.append((-d, name))
        return (min(best)[1], -min(best)[0]) if best else None

    lines = {x for r in spark.read.parquet(f"{data}/documents.parquet").collect() for x in r.text.split("\n")}
    for x in sorted(lines)[:300] + [t for ts in license_scan.TEMPLATES.values() for t in ts] + ["Licensed under the MIT License", "Licensed under the Apache License, Version 2"]:
        assert s.best(license_scan.normal_words(x)) == brute(x)
    assert license_scan.scan_licenses(documents(spark, [])).count() == 0
