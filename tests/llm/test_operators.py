"""The corpus operators against brute force on small tables with nulls, ties, repeats, long texts and extra columns."""

import bisect
import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from fathomline.llm import common, components, decontamination, embeddings, htmltext, langid, minhash, packing, quality, sharding, substrings, toxicity  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_shingles int, shard string, kept string"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["été", "Straße", "the", "of"]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage = text(60)
    out = [text(rng.choice((1, 2, 3, 40, 120))) for _ in range(n)]
    for i in range(0, n, 5):
        w = text(200).split()
        out.append(" ".join(w))
        w[rng.randrange(200)] = "edited"
        out.append("\t".join(w))
    out += [out[0], out[0], text(30) + " " + passage + "\n" + text(5), passage + " " + text(50), text(3) + " " + passage, None, "", " \n ", passage + " " + passage, "a b " * 5000]
    return [(i, t, "en", "src0", None, 1, "x", "y") for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def groups(n, pairs):
    parent = {i: i for i in n}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in n}


@pytest.mark.parametrize("k,num,bands", [(3, 85, 20), (5, 80, 30)])
def test_near_duplicates(docs, rows, k, num, bands):
    sets = {}
    for i, t, *_ in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = groups(sets, pairs)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, k, num, 100, bands).collect()}
    assert len(pairs) > 10 and set(got) == set(sets)
    for i in sets:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), want[i], want[i] == i)


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components.connected(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_near_copies_that_only_meet_through_others(spark):
    """A chain of copies in which the first and the last are not linked stays one group."""
    rng = random.Random(4)
    w = ["v%d" % rng.randrange(10**6) for _ in range(300)]
    chain = []
    for i in range(30):
        w = list(w)
        for j in range(4):
            w[rng.randrange(300)] = f"e{i}-{j}"
        chain.append((i, " ".join(w)))
    got = minhash.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string"), 3, 85, 100, 20).collect()
    assert {r.component_id for r in got} == {0}


def removed(texts: list, width: int) -> list[tuple]:
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        left = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("shard", [1000, 1])
def test_substrings(docs, rows, shard):
    want = dict(zip((r[0] for r in rows), removed([r[1] for r in rows], 35), strict=True))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.kept_words(docs, shard_segments=shard).collect()}
    assert got == want and sum(x[1] for x in want.values()) > 1000


def test_substrings_with_repeated_and_null_ids(spark):
    t = " ".join(f"x{i}" for i in range(50))
    data = [(1, t), (1, "z " + t), (None, t[:40]), (None, None)]
    got = substrings.kept_words(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(removed([x[1] for x in data], 35))


def test_automaton_counts():
    rng = random.Random(5)
    seqs = [[rng.choice("ab") for _ in range(rng.randrange(1, 30))] for _ in range(20)]
    sam = substrings.Automaton()
    for s in seqs:
        sam.add(s, 1)
    sam.finish()
    for width in (1, 3, 6):
        seen = Counter(tuple(s[i : i + width]) for s in seqs for i in range(len(s) - width + 1))
        for s in seqs:
            bits = sam.repeated(s, width)
            assert [bool(bits >> i & 1) for i in range(len(s) - width + 1)] == [seen[tuple(s[i : i + width])] > 1 for i in range(len(s) - width + 1)]


def test_packing_round_trip(docs, rows):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), group_rows=20).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append(r)
    assert set(pieces) == {r[0] for r in rows}
    for i, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    padding = total = 0
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
        total += at
        padding += (2048 - at) if at & (at - 1) else 0
    assert padding < 0.02 * total


def test_odd_texts_tokenise_as_the_library_does():
    import pyarrow as pa

    ids = packing.tokeniser(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["", "  ", "hello  world \n\n x", " don't I'LL 123abc\t\tq", "a b", "x　　 y", "<|endoftext|> z", "tail \n ", "\n\nlead", "😀😀 ok", "a\x1cb", "I've we'll  's", None]
    for t, got in zip(odd, ids.batch(pa.array(odd), 1), strict=True):
        assert got.tolist() == [*ids.whole(t or "").tolist(), 1]


def test_first_fit_decreasing_by_tournament():
    rng = random.Random(6)
    sizes = [rng.randrange(0, 5000) for _ in range(300)]
    got = packing.pack(sizes)
    assert Counter({i: sum(k for j, _, k, _, _ in got if j == i) for i in range(300)}) == Counter(dict(enumerate(sizes)))
    tree = packing.Tournament(5, 10)
    for need, want in ((7, 0), (7, 1), (3, 0), (4, 2), (11, -1)):
        at = tree.first(need)
        assert at == want
        if at >= 0:
            tree.take(at, need)


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href=x>Menu</a></li></ul></nav>
<div class="ad">Buy now</div><article><h1>Head &amp; line</h1><p>First <b>bold</b>
 text<br>goes on.<p>Second &eacute;.</p><!-- no --><form><input>Send</form></article><div id="comments"><p>Nice post</p></div><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    data = [(1, "u", PAGE, 0), (2, None, None, 0), (3, "u", "", 0), (1, "u", PAGE, 0), (None, "v", "<p>plain words only</p>", 0)]
    got = htmltext.extract(spark.createDataFrame(data, "page_id long, url string, html string, text int")).collect()
    want = "Head & line\n\nFirst bold text goes on.\n\nSecond é."
    assert sorted((r.text, r.n_chars) for r in got) == sorted([(want, len(want))] * 2 + [("", 0)] * 2 + [("plain words only", 16)])


def test_html_without_an_article_keeps_the_dense_blocks():
    page = "<body><ul class=menu><li>a</li></ul><div>" + "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(4)) + "</div><div class='sidebar'>links</div></body>"
    assert htmltext.main_text(page).count("\n\n") == 3 and "links" not in htmltext.main_text(page)
    assert html.unescape("&amp;") in htmltext.main_text("<p>" + "x &amp; y " * 20 + "</p>")


def test_html_keeps_captions_inside_the_article():
    page = "<body><nav>Menu</nav><article><p>Some text here.</p><figure><img src=x><figcaption>A caption.</figcaption></figure></article></body>"
    assert htmltext.main_text(page).split() == "Some text here. A caption.".split()


def brute_capacity(sizes, shards):
    c = max(sizes)
    while len(sharding.greedy(sizes, c)) > shards:
        c += 1
    return c


def test_capacity_is_the_smallest():
    rng = random.Random(7)
    for _ in range(50):
        sizes = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 30))]
        k = rng.randrange(1, 8)
        assert sharding.smallest_capacity(sizes, k) == brute_capacity(sizes, k)


@pytest.mark.parametrize("first,fetch", [(14, 100_000), (2, 5)])
def test_cuts_do_not_depend_on_how_ranges_are_refined(spark, monkeypatch, first, fetch):
    monkeypatch.setattr(sharding, "FIRST_BITS", first)
    monkeypatch.setattr(sharding, "FETCH", fetch)
    rng = random.Random(8)
    g = sorted({rng.getrandbits(63): rng.randrange(1, 500) for _ in range(300)}.items())
    sizes = [s for _, s in g]
    want = sharding.greedy(sizes, sharding.smallest_capacity(sizes, 7))[1:]
    cuts = sharding.minimax_cuts(spark.createDataFrame(g, "place long, bytes long"), 7)
    assert [bisect.bisect_left([p for p, _ in g], c) for c in cuts] == want


def test_sharding(docs, rows):
    got = sharding.shard(docs, 6, slot_rows=4).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    size = {r[0]: len((r[1] or "").encode()) + 8 for r in rows}
    by = defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (size[r.doc_id], zlib.crc32((rows[r.doc_id][1] or "").encode()), "bytes", None)
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(6))
    assert len({r.shard for r in got if rows[r.doc_id][1] == rows[0][1]}) == 1


def test_decontamination(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(40))) for i in range(20)] + [(90, None), (91, ""), (92, "short item")]
    noise = lambda n: " ".join(word() for _ in range(n))
    edited = items[3][1].split()
    for j in range(0, 40, 6):
        edited[j] = "changed"
    del edited[10]
    data = [(0, noise(300)), (1, noise(50) + " " + items[2][1].upper() + ". " + noise(30)), (2, noise(20) + " " + " ".join(edited)), (3, None), (4, ""), (5, items[5][1]), (5, items[5][1]), (6, " ".join(items[7][1].split()[:8]) + " " + noise(99))]
    data += [(10 + i, noise(5) + " " + items[11][1]) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(spark.createDataFrame(data, "doc_id long, text string"), bench).collect()}
    assert set(got) == {(1, 2), (2, 3), (5, 5)} | {(10 + i, 11) for i in range(30)}
    assert got[1, 2] == 1 and 0.5 < got[2, 3] < 1
    sliced = decontamination.contaminated(spark.createDataFrame(data, "doc_id long, text string"), bench, slice_items=5).collect()
    assert {(r.doc_id, r.item_id): r.score for r in sliced} == got


def test_decontamination_of_many_copies_of_an_edited_item(spark):
    """A fifth of the words replaced leaves under half of the seeds; a group of such copies is found like a single one."""
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(40)]
    edited = [word() if j % 5 in (0, 2) and j > 14 else w for j, w in enumerate(item)]
    seeds = lambda w: {tuple(w[i : i + 4]) for i in range(37)}
    assert len(seeds(item) & seeds(edited)) < 37 / 2
    data = [(i, " ".join([word() for _ in range(20)] + edited + [word() for _ in range(20)])) for i in range(30)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = decontamination.contaminated(spark.createDataFrame(data + [(99, "none of it")], "doc_id long, text string"), bench).collect()
    assert {r.doc_id for r in got} == set(range(30)) and all(0.5 < r.score < 1 for r in got)
    assert decontamination.contaminated(spark.createDataFrame(data[:1], "doc_id long, text string"), bench).first().score == min(r.score for r in got)


def test_shared_words_bound_the_alignment():
    rng = np.random.default_rng(19)
    for _ in range(30):
        a, b = rng.integers(0, 6, 12).astype(np.uint64), rng.integers(0, 6, 20).astype(np.uint64)
        assert decontamination.align(a, b)[0] <= decontamination.MATCH * decontamination.shared_words(a, b)


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(10)
    for _ in range(30):
        a, b = rng.integers(0, 4, 12).astype(np.uint64), rng.integers(0, 4, 20).astype(np.uint64)
        h = np.zeros((13, 21), int)
        for i in range(12):
            for j in range(20):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontamination.align(a, b)[0] == h.max()


def vectors(seed=11):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 16))
    near = base[:10] + 0.05 * rng.normal(size=(10, 16))
    hot = base[0] + 0.02 * rng.normal(size=(30, 16))
    x = [v.tolist() for v in np.concatenate([base, near, hot, base[:5], 3 * base[5:8]])]
    bad = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0] * 8, [1.0] * 8]
    return [(i, v, 0, 9) for i, v in enumerate(x + bad)]


@pytest.mark.parametrize("tile", [8192, 7])
def test_embeddings(spark, tile):
    rows = vectors()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int"), tile=tile).collect()}
    ok = {i: np.array(v) for i, v, *_ in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    pairs = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= 0.95]
    n, root = Counter(i for p in pairs for i in p), groups([r[0] for r in rows], pairs)
    assert got == {r[0]: (n[r[0]], root[r[0]], root[r[0]] == r[0]) for r in rows}


LANGS = {"en": ("thing", "ation", "ly"), "de": ("ungen", "keit", "sch"), "fr": ("eaux", "ment", "ique")}


def lingual(seed=12, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(LANGS))
        out.append((i, " ".join(rng.choice(LANGS[lang]) + rng.choice(LANGS[lang]) for _ in range(rng.randrange(3, 60))), lang, "s", 0))
    return out


def test_language(spark):
    data = lingual() + [(900, None, "en", "s", 0), (901, "12 34 !", "en", "s", 0), (902, "ungenkeit", None, "s", 0), (None, "eauxment", "fr", "s", 0)]
    got = langid.identify(spark.createDataFrame(data, "doc_id long, text string, lang string, source string, score int"), 80).collect()
    assert len(got) == len(data) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[900].lang_pred == by[901].lang_pred == "und" and by[902].lang_pred == "de"
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(300))
    assert sum(by[i].lang_pred == lang for i, _, lang, *_ in data[:300] if by[i].held_out) >= 0.97 * sum(by[i].held_out for i in range(300))


def test_toxicity(spark):
    rng = random.Random(13)
    words, rude = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)], ["grr%d" % i for i in range(6)]
    data, labels = [], []
    for i in range(600):
        toxic = rng.random() < 0.3
        w = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(rude)
        data.append((i, " ".join(w), "en"))
        labels.append((i, 1, int(toxic)))
    data += [(700, None, "en"), (701, "", "en"), (None, words[0], None)]
    docs, lab = spark.createDataFrame(data, "doc_id long, text string, predicted string"), spark.createDataFrame(labels + [(None, 1, 1), (9999, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, lab)).collect()}
    held = [(got[i].score, y) for i, _, y in labels if got[i].held_out]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in pos for b in neg]) > 0.95
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert toxicity.score(docs, toxicity.train(docs, lab.where("toxic = 0"))).where("score > 0").isEmpty()


def test_toxicity_keeps_every_expression_that_stands_out(spark):
    rng = random.Random(15)
    words = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(150_000)})
    data, labels = [], []
    for i in range(60):
        w = words[i % 2 :: 2]
        rng.shuffle(w)
        data.append((i, " ".join(w)))
        labels.append((i, i % 2))
    model = toxicity.train(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert sum(len(t.key) for t in (model.of.short, model.of.long, model.of.word)) > 1 << 17


def test_toxicity_learns_from_texts_that_share_a_passage(spark, monkeypatch):
    """Texts with one shared passage are no copies, and a toxic copy of an ordinary text is learned from."""
    rng = random.Random(17)
    passage = " ".join("licence%d" % i for i in range(400))
    data = [(i, "%s %s" % (passage, " ".join("v%d" % rng.randrange(10**6) for _ in range(3)))) for i in range(100)]
    labels = [(i, i % 2) for i in range(100)]
    data += [(1000 + i, "same text") for i in range(40)]
    labels += [(1000 + i, i % 2) for i in range(40)]
    seen = []

    def kept(df, saved=toxicity.saved):
        out = saved(df)
        seen.append(out)
        return out

    monkeypatch.setattr(toxicity, "saved", kept)
    toxicity.train(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = {(r.doc_id, r.toxic) for r in seen[0].select("doc_id", "toxic").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    assert {x for x in rows if x[0] < 1000} == {x for x in labels if x[0] < 1000 and not held(x[0])}
    assert sorted(y for i, y in rows if i >= 1000) == [0, 1]


def test_toxicity_sets_aside_no_more_than_the_calibration_reads(spark, monkeypatch):
    data = [(i, "%s t%d" % ("bad" if i % 2 else "good", i)) for i in range(4000)]
    labels = [(i, i % 2) for i in range(4000)]
    seen = []
    monkeypatch.setattr(toxicity, "_counted", lambda rows, keys_of, counted=toxicity._counted: seen.append(rows) or counted(rows, keys_of))
    toxicity.train(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), calibrate=100)
    learning = sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(4000))
    assert learning - 260 < seen[0].count() < learning - 140


def test_toxicity_does_not_depend_on_slices_of_bigrams(spark):
    rng = random.Random(16)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    data, labels = [], []
    for i in range(600):
        w = [rng.choice(words) for _ in range(40)]
        toxic = i % 2
        data.append((i, " ".join([*w[:20], *(("gr%d zz%d" % (k, (k + toxic) % 6)) for k in range(6)), *w[20:]])))
        labels.append((i, toxic))
    docs, lab = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    one, many = (toxicity.train(docs, lab, slice_pairs=n) for n in (1 << 22, 3))
    assert one.parts == 1 and many.parts > 1 and len(one.fetch(0).key)
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, m).collect()} for m in (one, many))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)
    assert all((a[i] > 0.5) == bool(y) for i, y in labels)


def test_quality(spark):
    rng = random.Random(14)
    good = lambda: " ".join(rng.choice(["the", "of", "and", "report", "market", "price", "series", "long,", "short."]) for _ in range(80))
    bad = [lambda: " | ".join("x%d" % rng.randrange(999) for _ in range(60)), lambda: " ".join(w.upper() + "!!" for w in good().split()), lambda: " ".join(["word"] * 90), lambda: " ".join(w + "$$$" for w in good().split())]
    data = [(i, good(), 1, "a") for i in range(300)] + [(1000 + i, bad[i % 4](), 2, "b") for i in range(60)] + [(2000, None, 3, "c"), (2001, " ", 3, "c"), (None, good(), 1, "a")]
    out = quality.classify(spark.createDataFrame(data, "doc_id long, text string, quality_score int, other string"))
    got = {r.doc_id: r.quality_keep for r in out.collect()}
    assert out.columns == ["doc_id", "text", "other", "quality_posterior", "quality_score", "quality_keep"]
    assert sum(got[i] for i in range(300)) >= 297 and sum(got[1000 + i] for i in range(60)) <= 2 and not got[2000] and not got[2001]


def test_empty_tables(spark, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vec = spark.createDataFrame([], "vec_id long, embedding array<float>")
    for out in (minhash.near_duplicates(empty), packing.pack_documents(empty, path), htmltext.extract(pages), sharding.shard(empty), decontamination.contaminated(empty, bench), toxicity.score(empty, toxicity.train(empty, labels)), substrings.kept_words(empty), quality.classify(empty), langid.identify(empty), embeddings.link(vec)):
        assert out.isEmpty()


def test_stages_keep_the_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline

    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.saved(stage(spark, docs, data))
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = out
    labels = spark.read.parquet(f"{data}/labels.parquet")
    kept = docs.join(labels, "doc_id")
    assert kept.where("quality = 0").count() <= 1
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert pieces.groupBy("doc_id").agg((F.sum("length") == F.first("doc_tokens")).alias("whole")).where("not whole").isEmpty()
