"""Cases of the corpus operators: planted groups, hostile input, repeated and missing ids, clashing columns, whole queries."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from fathomline.llm import common, decontamination, embeddings, htmltext, langid, minhash, packing, quality, queries, sharding, substrings, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
ID, TEXT = "doc_id long, text string", "doc_id long, text string, row string, packed string, kept string, component_id string, quality_score int, left_text string"


def shingles(text: str, k: int) -> set:
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(texts: dict, k: int, num: int) -> dict:
    """By all pairs."""
    s, parent = {i: shingles(t, k) for i, t in texts.items()}, {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= num * len(s[i] | s[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


def edited(rng, base: list[str], n: int) -> str:
    w = list(base)
    for i in rng.sample(range(len(w)), n):
        w[i] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("k", "num", "bands"), [(3, 85, 20), (5, 80, 30)])
def test_one_large_group_round_the_threshold(spark, k, num, bands):
    """Edits of one text, from copies to well under the threshold: no link is lost, none is made up."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    texts = {i: edited(rng, base, rng.randrange(0, 9)) for i in range(400)}
    texts |= {1000 + i: edited(rng, [f"c{i % 3}_{j}" for j in range(60)], i % 4) for i in range(60)}
    want = components(texts, k, num)
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), ID).repartition(5), k, num, 100, bands).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert 1 < len(set(want.values())) < 300


def test_a_group_under_the_threshold_makes_few_candidates(spark, monkeypatch):
    """Texts that share most of their shingles, each with too many of its own, give no pairs to confirm."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(100)]
    texts = {i: edited(rng, base, 6) for i in range(300)}
    seen = []
    across = minhash._across
    monkeypatch.setattr(minhash, "_across", lambda *a: seen.append(across(*a)) or seen[-1])
    counts = []
    confirmed = minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda pairs, *a: counts.append(pairs.count()) or confirmed(pairs, *a))
    got = minhash.near_duplicates(spark.createDataFrame(list(texts.items()), ID), 3, 85, 100, 20).collect()
    assert {r.doc_id: r.component_id for r in got} == components(texts, 3, 85)
    assert counts[1] < 300 * 5


def test_rows_of_one_id_are_one_document(spark):
    rng = random.Random(7)
    base = [f"b{i}" for i in range(200)]
    long = " ".join(f"z{rng.randrange(10**9)}" for _ in range(3000))
    data = [(1, " ".join(base)), (1, long), (2, edited(rng, base, 1)), (3, long + " end"), (4, "alone here now"), (None, " ".join(base)), (4, "alone here now"), (5, None), (5, "")]
    got = minhash.near_duplicates(spark.createDataFrame(data, ID), 3, 85, 100, 20).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got) == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True), (5, 5, True), (5, 5, True)]


def thue_morse(n: int) -> str:
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_collide_under_polynomials_have_hashes_of_their_own():
    a = thue_morse(1024)
    b = a.translate(str.maketrans("ab", "ba"))
    words = [a, b, "x", "xy", "x\0", "abcdefgh", "abcdefghi", "abcdefghabcdefgh", "a" * 64, "a" * 65, "a" * 66]
    buf, offs = common.raw(pa.array(words, pa.large_string()))
    assert len(set(common.hash_spans(buf, offs[:-1], offs[1:]).tolist())) == len(words)
    alone = [common.hash_spans(*(lambda x, o: (x, o[:-1], o[1:]))(*common.raw(pa.array([w], pa.large_string()))))[0] for w in words]
    assert alone == common.hash_spans(buf, offs[:-1], offs[1:]).tolist()
    ids = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    assert ids.batch(pa.array([f"{a} {b} {a}"]), 1)[0][:-1].tolist() == ids.whole(f"{a} {b} {a}").tolist()


def test_units_with_one_hash_are_told_apart_by_their_bytes(monkeypatch):
    monkeypatch.setattr(packing, "hash_spans", lambda buf, s, e: np.minimum(e - s, 4).astype(np.uint64))
    ids = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one two six", "ten two one", None, "", "a longer text with words"]
    assert [x[:-1].tolist() for x in ids.batch(pa.array(texts), 1)] == [ids.whole(t or "").tolist() for t in texts]


def test_packing_of_repeated_rows_and_missing_ids(spark):
    data = [(1, "some words here")] * 40 + [(None, "no id"), (None, None), (2, "w " * 5000)]
    got = packing.pack_documents(spark.createDataFrame(data, ID), public_tokenizers.path("byte_bpe_50k.json"), group_rows=8).collect()
    assert sum(r.length for r in got if r.doc_id == 1) == 40 * got[[r.doc_id for r in got].index(1)].doc_tokens
    for _, pieces in by_sequence(got).items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def by_sequence(rows):
    out: dict = {}
    for r in rows:
        out.setdefault(r.sequence_id, []).append(r)
    return out


def kept_by_loops(weight, window, surge):
    block = [sum(weight[i : i + window]) for i in range(len(weight))]
    if not block or max(block) == 0:
        return set()
    surge = min(surge, max(block))
    out, on, run = set(), False, []
    for i, b in enumerate([*block, 0]):
        if not on and b >= surge and b > 0:
            on, run = True, []
        if on and b == 0:
            while run and weight[run[0]] == 0:
                run.pop(0)
            while run and weight[run[-1]] == 0:
                run.pop()
            out |= set(run)
            on = False
        if on:
            run.append(i)
    return out


def test_line_blocks_against_loops():
    rng = random.Random(8)
    for _ in range(400):
        weight = [float(rng.choice((0, 0, 0, 2, 10, 30, 90))) for _ in range(rng.randrange(0, 25))]
        window, surge = rng.randrange(1, 5), rng.choice((20, 60, 100))
        assert {k for a, z in htmltext.kept_lines(weight, window, surge) for k in range(a, z)} == kept_by_loops(weight, window, surge)


def test_the_curve_decides_on_pages_without_an_article():
    menu = "".join(f"<div><a href='/{i}'>Link {i}</a></div>" for i in range(6))
    text = "".join(f"<p>{'words of the text ' * 6}{i}</p>" for i in range(3)) + "<p><a href='/x'>A paragraph that is one link.</a></p><p>Short.</p>" + f"<p>{'more words here ' * 6}</p>"
    page = f"<html><body>{menu}<h1>Title</h1>{text}{menu}<div>© 2024</div></body></html>"
    got = htmltext.main_text(page).split("\n\n")
    assert got[0] == "Title" and "A paragraph that is one link." in got and "Short." in got and not any(x.startswith(("Link", "©")) for x in got)
    assert htmltext.main_text(page, window=1) != htmltext.main_text(page)


def test_an_article_holds_its_page_and_a_teaser_does_not():
    line = "<p>Sentence of the story, number %d, long enough.</p>"
    story = "".join(line % i for i in range(8))
    assert htmltext.main_text(f"<article><h1>A</h1><p>B</p>{story}<p>End.</p></article><p>Posted in News by someone, all rights.</p>").split("\n\n")[-1] == "End."
    page = f"<article><p>Read this too.</p></article><div>{story}{story}</div>"
    assert htmltext.main_text(page).count("Sentence of the story") == 16
    assert htmltext.main_text("<article>Hi.</article>") == "Hi." and htmltext.main_text("plain words") == "plain words"


@pytest.mark.parametrize("page", ["<a '" * 100_000, '<a ">"<a">"' * 30_000, "<![CDATA[" * 60_000, "<div>" * 40_000 + "</p>" * 40_000, "&#" + "9" * 9000 + ";", "<script>" * 40_000, "<p>word " * 40_000])
def test_hostile_pages_take_linear_time(page):
    import time

    began = time.process_time()
    htmltext.main_text(page)
    assert time.process_time() - began < 5


def test_languages_need_letters(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog" if i % 2 else "der Hund und die Katze", "en" if i % 2 else "de") for i in range(40)] + [(100, "½ ²", None), (101, "12 — !", None), (102, None, "de"), (103, "", None), (104, "ß", None), (105, "der Hund " * 30_000, None), (105, "der Hund und die Katze", None)], "doc_id long, text string, lang string")
    got = [(r.doc_id, r.lang_pred) for r in langid.identify(docs).where("doc_id >= 100").collect()]
    assert sorted(got) == [(100, "und"), (101, "und"), (102, "und"), (103, "und"), (104, dict(got)[104]), (105, "de"), (105, "de")] and dict(got)[104] != "und"


def test_shared_folder_is_named_on_clusters():
    class Conf:
        def get(self, *_):
            return None

    class Spark:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(Conf)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Spark())


def test_filters_never_hold_back_a_row(spark):
    rows = spark.range(0, 3_000_000, 17).selectExpr("id * 7919 - 5000 as row")
    bits = common.row_filter(rows, "row")
    texts = spark.range(0, 60_000, 3).selectExpr("id * 7919 - 5000 as row", "cast(id as string) as text")
    got = {r.row for r in common.squeezed(texts, "row", bits).select("row").collect()}
    assert got >= {r.row for r in texts.join(rows, "row").collect()} and len(got) < texts.count() / 5


def dirty(spark):
    rng = random.Random(9)
    words = ["the", "of", "and", "report", "market", "price", "series", "long,", "short."]
    good = lambda: " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(80))
    shared, one = good(), good()
    texts = [(i % 50, good()) for i in range(60)] + [(7, one), (7, one), (None, one), (None, good()), (8, None), (9, ""), (None, None), (70, f"{shared} {good()}"), (71, f"{good()} {shared}"), (71, good()), (72, "tiny " * 30_000)]
    return spark.createDataFrame([(i, t, "r", "p", "k", "c", 3, "l") for i, t in texts], TEXT)


@pytest.mark.parametrize("name", ["quality", "near_duplicates", "substrings", "decontamination", "packing"])
def test_stages_on_dirty_rows(spark, name):
    """Nulls, empty and very long texts, repeated rows and ids, no rows, and columns with the operators' own names."""
    import corpus_pipeline

    stage, docs = dict(corpus_pipeline.STAGES)[name], dirty(spark)
    out = common.saved(stage(spark, docs, SF))
    empty = stage(spark, docs.where("false"), SF)
    assert empty.isEmpty()
    if name == "packing":
        assert out.where("start = 0").count() == docs.count()
        return
    assert out.columns == docs.columns and empty.columns == docs.columns
    before, after = [(r.doc_id, r.text) for r in docs.collect()], [(r.doc_id, r.text) for r in out.collect()]
    if name == "quality":
        assert set(after) <= set(before)
    if name == "near_duplicates":
        assert len({t for _, t in after if t}) == len([t for _, t in after if t]) and {t for _, t in after} == {t for _, t in before}
    if name == "substrings":
        assert sum(i == 7 for i, _ in after) == 2 and sum(i is None for i, _ in after) == 2  # the three copies of one text lose all and go
        assert {t for i, t in after if i == 71} != {t for i, t in before if i == 71} and all(not t or t in dict.fromkeys(x for _, x in before) or i in (70, 71) for i, t in after)
    if name == "decontamination":
        assert sorted(map(str, after)) == sorted(map(str, before))


def test_stage_texts_of_repeated_ids_stay_apart(spark):
    import corpus_pipeline

    passage = " ".join(f"p{i}" for i in range(40))
    data = [(1, f"{passage} first own words"), (1, "second text stays"), (2, f"{passage} other"), (None, f"null {passage}")]
    got = corpus_pipeline.without_repeats(spark, spark.createDataFrame(data, ID), SF).collect()
    assert sorted(r.text for r in got) == ["first own words", "null", "other", "second text stays"]


def test_decontamination_against_all_pairs(spark):
    rng = random.Random(10)
    vocabulary = [f"v{i}" for i in range(500)]
    items = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (1, 3, 12, 20, 30)]
    docs = []
    for i in range(80):
        w = [rng.choice(vocabulary) for _ in range(60)]
        if i % 3 == 0:
            own = rng.choice(items[2:]).split()
            for _ in range(rng.randrange(0, len(own) // 4)):
                own[rng.randrange(len(own))] = "changed"
            w[20:20] = own
        docs.append((i, " ".join(w)))
    docs += [(90, None), (91, ""), (92, items[2]), (92, items[2])]
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(spark.createDataFrame(docs, ID), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    want = {}
    for i, t in docs:
        for k, item in enumerate(items):
            d, q = np.array([zlib.crc32(x.encode()) for x in (t or "").split()]), np.array([zlib.crc32(x.encode()) for x in item.split()])
            seeds = {tuple(q[j : j + 4]) for j in range(max(1, len(q) - 3))}
            hit = any(tuple(d[j : j + len(s)]) == s for s in seeds for j in range(len(d) - len(s) + 1))
            best = decontamination.align(q, d)[0] / (2 * len(q)) if len(d) else 0
            if hit and best >= 0.5:
                want[i, k] = best
    assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_sharding_is_contiguous_minimax_and_keeps_groups(spark):
    rng = random.Random(11)
    texts = [None, ""] + [f"t{rng.randrange(30)} " * rng.randrange(1, 30) for _ in range(200)]
    docs = spark.createDataFrame([(None if i == 5 else i, t) for i, t in enumerate(texts)] + [(1, ""), (7, texts[7])], ID)
    got = sharding.shard(docs, 6).collect()
    assert len(got) == 204 and all(r.size == len((dict(enumerate(texts)).get(r.doc_id) or "").encode()) + 8 for r in got if r.doc_id is not None)
    for s in range(6):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    loads = [sum(r.size for r in got if r.shard == s) for s in range(6)]
    assert max(loads) - min(loads) <= 2 * max(r.size for r in got)


def test_embeddings_with_repeated_and_missing_ids(spark):
    data = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.001]), (None, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [0.0, 1.0])]
    got = embeddings.link(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 8
    of = {r.vec_id: r for r in got}
    assert of[2].component_id == 1 and of[3].n_links == of[4].n_links == of[5].n_links == of[6].n_links == 0


def test_quality_and_toxicity_of_long_and_repeated_rows(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)]
    data = [(i, " ".join(rng.choice(words) for _ in range(30)) + (" grr grr2" if i % 3 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    docs = spark.createDataFrame([*data, *data[:5], (900, "w1 " * 200_000), (901, "w2 " * 100_000 + "grr"), (902, "x" * 300_000)], ID)
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 308 and np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in got if r.doc_id < 300]) > 0.98
    assert quality.classify(docs).count() == 308


def test_toxicity_discounts_by_standard_errors():
    o, t = np.array([90.0, 88.0, 0.0, 3.0, 50.0]), np.array([10.0, 12.0, 40.0, 1.0, 50.0])
    r, d = toxicity.tilted(o, t, 0.0, (900, 100), 3.0)
    assert r[0] == r[1] == r[3] == 0 and r[2] > 3 and d[2] == pytest.approx(40 - 4 - 3 * np.sqrt(40 * 0.09 + 0.25)) and r[4] > 0
    below, _ = toxicity.tilted(o, t, np.array([0.5] * 5), (900, 100), 3.0)
    assert below[0] == 0.5  # no evidence of its own: the lower order's ratio


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_registered_queries_cover_their_tables(spark, name):
    out = common.saved(queries.QUERIES[name](spark, SF))
    source = {"op3_html": ("pages", "page_id"), "op10_embeddings": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    rows = common.table(spark, SF, source[0])
    if name == "op5_decontamination":
        assert out.join(rows, "doc_id", "left_anti").isEmpty()
    elif name == "op2_packing":
        assert out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).where("n = t").count() == rows.count()
    else:
        assert out.count() == rows.count() and rows.join(out.select(source[1]), source[1], "left_anti").isEmpty()


def test_substrings_by_row_with_clashing_columns(spark):
    passage = " ".join(f"p{i}" for i in range(35))
    docs = spark.createDataFrame([(1, f"a {passage}", 5), (2, f"{passage} b", 6)], "doc_id long, text string, row int")
    assert sorted((r.doc_id, r.kept) for r in substrings.kept_words(docs).collect()) == [(1, "a"), (2, "b")]
