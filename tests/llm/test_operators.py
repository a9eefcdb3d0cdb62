"""The corpus operators against plain versions, on small inputs with every odd case."""

import math
import random
import zlib

import duckdb
import pandas as pd
import pytest
import zstandard
from pyspark.sql import functions as F

from tempora.llm import columnwise, decontamination, embeddings, langid, lines, minhash, mixing, recompression, sharding, spans, toxicity
from tests.llm import brute

DOC = "doc_id long, text string, lang string, source string, n_chars long, size long, anchor string, rep string, n int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [words(rng, rng.choice([3, 40, 120, 400])) for _ in range(40)]
    out = dict(enumerate(base))
    out |= {40: None, 41: "", 42: " \t\n ", 43: "x", 44: base[3], 45: base[3], 46: base[4].upper(), 47: "a " * 300, 48: "a " * 310, 49: "ab" * 4000}
    for k in range(50, 90):  # edited copies, and passages inside other texts
        w = base[k % 40].split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "edited"
        out[k] = " ".join(w)
    passage = words(rng, 90)
    out |= {90 + k: f"{words(rng, 30)}\n{passage}\n{words(rng, 20)}" for k in range(8)}
    out |= {98: "line one is here to stay\nline two is here to stay\n" * 3, 99: "line one is here to stax\nline ne is here to stay!\n\nshort"}
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Rows with clashing extra columns; one row repeats, one has no id."""
    rows = [(k, t, None if k % 9 == 0 else "en", None if k % 11 == 0 else f"s{k % 3}", 1, 7, "a", "r", 3) for k, t in texts.items()]
    return spark.createDataFrame([*rows, rows[44], (None, texts[90], "en", "s1", 1, 7, "a", "r", 3)], DOC).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


def test_substring_dedup_by_words(docs, texts, nothing):
    cut = lambda d: spans.finished(d, recompression.covered_words(d), recompression._cut, "n_words long, n_removed long, kept_sha256 string")
    want = brute.substring_words(list(texts.items()))
    got = by_id(cut(docs))
    assert {k: tuple(r)[1:] for k, r in got.items()} == want
    assert sum(r.n_removed for r in got.values()) > 500
    assert cut(nothing).count() == 0 and cut(docs).count() == len(texts) + 2


def test_substring_dedup_by_bytes(docs, texts, nothing, monkeypatch):
    cut = lambda d: spans.finished(d, columnwise.covered_bytes(d), columnwise._cut, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    want = brute.substring_bytes(list(texts.items()))
    assert {k: tuple(r)[1:] for k, r in by_id(cut(docs)).items()} == want
    monkeypatch.setattr(columnwise, "HOT", 0)  # every anchor is cut into windows
    monkeypatch.setattr(columnwise, "BUCKET", 50)
    assert {k: tuple(r)[1:] for k, r in by_id(cut(docs)).items()} == want
    assert cut(nothing).count() == 0


def test_a_hot_passage_stays_out_of_the_buckets(spark, monkeypatch):
    """Each document has its own text around one passage, so that no row of it is settled as a whole."""
    rng = random.Random(8)
    passage = words(rng, 30)
    rows = [(k, f"{words(rng, 12)} {passage} {words(rng, 12)}") for k in range(300)]
    late = columnwise._late_windows

    def bounded(size):
        run = late(size)

        def only(pdf):
            if len(pdf) > 200:
                raise ValueError(f"{len(pdf)} strings in a bucket")
            return run(pdf)

        return only

    monkeypatch.setattr(columnwise, "HOT", 20)
    monkeypatch.setattr(columnwise, "BUCKET", 50)
    monkeypatch.setattr(columnwise, "_late_windows", bounded)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = spans.finished(df, columnwise.covered_bytes(df), columnwise._cut, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    assert {k: tuple(r)[1:] for k, r in by_id(got).items()} == brute.substring_bytes(rows)


def test_collection_transform():
    rng = random.Random(1)
    for trial in range(60):
        strings = [bytes(rng.choice(b"ab" + b"c" * (trial % 2)) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 12))]
        depth = rng.randint(2, 8)
        _, lcp, who, rem = columnwise.collection_transform(strings, depth)
        got = [strings[w][len(strings[w]) - r:] for w, r in zip(who, rem, strict=True)]
        assert got == sorted(s[j:] for s in strings for j in range(len(s) + 1))
        for k in range(1, len(got)):
            n = next((i for i, (a, b) in enumerate(zip(got[k], got[k - 1], strict=False)) if a != b), min(len(got[k]), len(got[k - 1])))
            assert lcp[k] == min(n, depth)


def test_a_bucket_goes_by_blocks_of_whole_anchors(monkeypatch):
    """Three documents tell each of twelve strings; blocks hold four strings, so two anchors at most, and late ranges are told whole."""
    rng = random.Random(5)
    rows = [(k, doc, 10 * k, text) for k in range(12) for text in [words(rng, 20).encode()[:60]] for doc in (1, 2, 3)]
    rng.shuffle(rows)
    seen, transform = [], columnwise.collection_transform
    monkeypatch.setattr(columnwise, "BLOCK", 4)
    monkeypatch.setattr(columnwise, "collection_transform", lambda strings, depth: seen.append(len(strings)) or transform(strings, depth))
    out = columnwise._late_windows(50)(pd.DataFrame(rows, columns=["anchor", "doc_id", "start", "part"]))
    assert sum(seen) == 36 and max(seen) <= 6
    assert sorted(map(tuple, out.to_numpy().tolist())) == sorted((doc, 10 * k, 10 * k + 60) for k in range(12) for doc in (2, 3))


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, texts, nothing, width, percent):
    want = brute.near_dups(list(texts.items()), width, percent)
    got = by_id(minhash.near_duplicates(docs, width, percent))
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (r.component_id == k) for k, r in got.items())
    assert minhash.near_duplicates(nothing, width, percent).count() == 0


def test_near_duplicates_of_one_large_group(spark):
    """Many copies of one text with few and many edits: regions beyond what neighbours cover."""
    rng = random.Random(3)
    base = words(rng, 120).split()
    rows = []
    for k in range(160):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 6, 9])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    want = brute.near_dups(rows, 3, 85)
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85))
    assert {k: r.component_id for k, r in got.items()} == {k: v[1] for k, v in want.items()}


def test_embeddings(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.standard_normal((30, 16))
    rows = []
    for k in range(600):
        v = centres[k % 30] + rng.standard_normal(16) * rng.choice([0.1, 0.2, 0.3])
        rows.append((k, [float(x) for x in v], k % 3 if k % 50 else None))
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [1.0] * 15 + [None], 1), (603, [1.0] * 15 + [float("nan")], 1), (604, rows[1][1], 1), (605, [1.0, 2.0], 1), (606, [2.0, 4.0], 1), (607, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("copies", F.lit("x"))
    out = embeddings.near_vectors(df).collect()
    want = brute.near_vectors(rows, 0.93)
    got = {r.vec_id: (r.n_links, r.component_id) for r in out}
    found, there = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert len(out) == len(rows) and there > 500 and there * 0.97 <= found <= there  # recall; never a link too many
    assert all(got[k][0] == 0 and got[k][1] == k for k in (600, 601, 602, 603, 607)) and got[605] == (1, 605) and got[606] == (1, 605)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_lines(docs, texts, nothing):
    want = brute.near_lines(list(texts.items()), 16)
    got = by_id(lines.dedup_lines(docs, 16).withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)))
    got.pop(44), want.pop(44)  # the repeated row shares its places with its twin
    assert {k: (r.n_lines, r.n_removed, r.sha) for k, r in got.items()} == want
    assert lines.dedup_lines(nothing, 16).count() == 0


def test_short_lines_go_if_equal(spark):
    rows = [(1, "Les.\n\nPage 1\nLes."), (2, "Page 2\n\nLes.\n \nx"), (3, "Page 1\nx\n\n "), (None, "Les."), (4, None)]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in got} == {
        1: ("Les.\n\nPage 1", 4, 1), 2: ("Page 2\n\n \nx", 5, 1), 3: ("", 4, 3), None: ("Les.", 1, 0), 4: (None, 0, 0)}


def test_lines_one_edit_apart(spark):
    rng = random.Random(9)
    rows = []
    for k in range(60):
        s = "".join(rng.choice("abcd ") for _ in range(rng.choice([16, 17, 40, 900])))
        i = rng.randrange(len(s))
        rows += [(3 * k, s), (3 * k + 1, rng.choice([s[:i] + "z" + s[i + 1:], s[:i] + s[i + 1:] + "", s[:i] + "z" + s[i:]])), (3 * k + 2, s[::-1])]
    want = brute.near_lines(rows, 16)
    got = by_id(lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), 16))
    assert {k: r.n_removed for k, r in got.items()} == {k: v[1] for k, v in want.items()}
    assert sum(v[1] for v in want.values()) >= 55


def test_decontamination(spark, docs, texts, nothing):
    rng = random.Random(4)
    items = [(1, " ".join(texts[90].split()[30:70])), (2, words(rng, 30)), (3, None), (4, "two words"), (5, texts[5]), (6, texts[47])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    got = {(r.doc_id, r.item_id): (round(r.similarity, 5), r.start) for r in decontamination.find_leaks(docs, bench).collect() if r.doc_id is not None}
    want = {k: (round(s, 5), p) for k, (s, p) in brute.leaks(list(texts.items()), items).items()}
    assert got == want and len(want) > 8
    clean = decontamination.without_leaks(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(texts) - {d for d, _ in want}
    assert decontamination.find_leaks(nothing, bench).count() == 0 and decontamination.find_leaks(docs, bench.limit(0)).count() == 0


def test_short_items_word_for_word(spark):
    """Items under five words are found where they stand, at their first place; letters' case and marks don't matter, nulls match nothing."""
    items = [(1, "Yes!"), (2, "red fox"), (2, "Red, fox."), (3, "a b c d"), (4, ""), (5, None), (6, "one two three four five")]
    rows = [(1, "no yes, yes"), (2, "the RED-fox and the red fox"), (3, "a b c"), (4, "x a b c d a b c d"), (4, "red foxes"), (None, "yes"),
            (5, ""), (6, None), (7, "redfox yesterday"), (1, "no yes, yes"), (8, "one two three four five yes"), (9, "w " * 50_000 + "red fox")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("s", F.lit(1)).withColumn("q", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r) for r in decontamination.find_leaks(docs, bench).collect()}
    assert got == {(1, 1, 1, 1, 1.0), (2, 2, 1, 2, 1.0), (4, 3, 1, 4, 1.0), (None, 1, 0, 1, 1.0), (8, 6, 0, 5, 1.0), (8, 1, 5, 1, 1.0), (9, 2, 50_000, 2, 1.0)}
    clean = decontamination.without_leaks(docs, bench).select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in clean), key=str) == sorted([(3, "a b c"), (4, "red foxes"), (5, ""), (6, None), (7, "redfox yesterday")], key=str)


def test_mix(spark, docs, texts, nothing):
    out = mixing.mix_to_targets(docs).collect()
    sizes = {k: len(brute.WORD.findall(t or "")) for k, t in texts.items()}
    assert len(out) == len(texts) + 2 and all(r.size == sizes[r.doc_id] for r in out if r.doc_id is not None)
    assert all(r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
    weights = dict(zip([*sorted(s for s in by if s is not None), None], [5, 2, 1, 5], strict=True))
    total, left, target = sum(r.size for r in out), dict(weights), {}
    source_size = {s: sum(r.size for r in rs) for s, rs in by.items()}
    while left:  # reshare what capped sources can't take
        room = total - sum(target.values())
        level = room / sum(left.values())
        full = [s for s in left if left[s] * level > 3 * source_size[s]]
        for s in full or list(left):
            target[s] = 3 * source_size[s] if full else left[s] * level
            del left[s]
    for s, rs in by.items():
        assert all(r.source_size == source_size[s] and r.target == pytest.approx(target[s]) for r in rs)
        assert abs(sum(r.taken for r in rs) - target[s]) <= max(0.02 * target[s], 40)  # a short document of these
    again = {(r.doc_id, r.taken) for r in mixing.mix_to_targets(docs.repartition(7, "text")).collect()}
    assert again == {(r.doc_id, r.taken) for r in out}
    whole = mixing.repeated(docs)
    assert whole.columns == docs.columns and whole.count() == sum(r.copies for r in out)
    assert mixing.mix_to_targets(nothing).count() == 0


def test_balance_goes_on_until_it_holds(spark, monkeypatch):
    """One huge document among many tiny ones; a target next to the bound; rates against a plain bisection."""
    monkeypatch.setattr(mixing, "NEWTON_ROUNDS", 2)
    hist = [("a", 1, 1000), ("a", 1000, 1), ("b", 3, 7), ("b", 500, 2), ("c", 10, 5)]
    targets = [("a", 2000, 2900.0), ("b", 1021, 3 * 1021 * 0.999999), ("c", 50, 1.0)]
    state = mixing.balance(spark.createDataFrame(hist, "source string, size long, n long"), spark.createDataFrame(targets, "source string, source_size long, target double")).collect()
    assert len(state) == 3 and all(r.done for r in state)
    for r in state:
        mine = [(size, n) for s, size, n in hist if s == r.source]
        mean = sum(size * n for size, n in mine) / sum(n for _, n in mine)
        got = lambda lam: sum(size * n * min(3.0, math.exp(min(50.0, lam * size / mean))) for size, n in mine)  # noqa: B023,E731
        lo, hi = -1e7, 1e7
        for _ in range(200):
            lo, hi = (lo, (lo + hi) / 2) if got((lo + hi) / 2) > r.target else ((lo + hi) / 2, hi)
        assert r.lam == pytest.approx(lo, rel=1e-6) and got(r.lam) == pytest.approx(r.target, rel=1e-8)


def test_shards(docs, texts, nothing):
    out = sharding.shard_documents(docs, shards=7, vnodes=8, bin_rows=3).collect()
    assert len(out) == len(texts) + 2
    for r in out:
        if r.doc_id is not None:
            raw = (texts[r.doc_id] or "").encode()
            assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(7)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.shard_documents(nothing, shards=7).count() == 0


def test_flows_fill_every_quota():
    flows = list(sharding._flows({0: 10, 2: 1}, [(0, 0), (5, 1), (9, 2)], [4, 4, 3]))
    assert sum(hi - lo for _, lo, hi, _, _ in flows) == 11
    assert [(a, s) for a, _, _, s, _ in flows] == [(0, 0), (2, 2), (0, 1), (0, 2)]


def test_language(spark, docs, nothing, sf_dir):
    sample = {"en": "the cat sat on the mat with the other cats " * 50, "de": "die katze sitzt auf der matte und schläft dort " * 50}
    df = spark.createDataFrame([(1, "The mat and THE cats"), (2, "der schlaf auf der matte"), (3, None), (4, ""), (5, "12 34 !!"), (6, "日本語のテキスト"), (7, "the mat " * 5000)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(df, sample).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 5, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert got[6].lang_pred in sample and all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(df, {}).collect()} == {"und"}
    kept = langid.recognised(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.doc_id is not None} == {r.doc_id for r in docs.collect() if r.doc_id is not None and any(c.isalpha() for c in r.text or "")}
    assert langid.recognised(nothing).count() == 0


def test_language_held_out(spark, sf_dir):
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{sf_dir}/documents.parquet'").fetchall())
    out = [r for r in langid.op10_cross_parsing_language(spark, sf_dir).collect()]
    assert len(out) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)


def test_cross_parsing_counts_longest_phrases():
    p = langid.CrossParser({"x": "abcab"})
    cost, _ = p.costs(["abab", "cabx", "zz"])
    assert [round(c / p.weights[0]) for c in cost[:, 0]] == [2, 2, 2]  # ab|ab, cab|x, z|z


def test_toxicity(spark, nothing):
    rng = random.Random(6)
    bad = ["scum", "moron", "trash", "idiot"]
    rows, labels = [], []
    for k in range(300):
        w = words(rng, 60).split()
        if k % 5 == 0:
            for _ in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((k, " ".join(w)))
        labels.append((k, int(k % 5 == 0)))
    rows += [(300, None), (301, "")]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(*toxicity.sample(docs, lab, F.col("doc_id") % 3 != 1))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [k for k in range(300) if k % 3 == 1]
    assert sum((got[k] >= 0.7) == (k % 5 == 0) for k in held) >= 0.95 * len(held)
    assert got[300] == got[301] < 0.7
    none = toxicity.fit(*toxicity.sample(docs, lab.limit(0), F.lit(True)))
    assert none is None and {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(nothing, model).count() == 0


def test_toxicity_by_hand(spark):
    """Scores against windows compressed one by one; repeated rows, clashing columns and a long text included."""
    rng = random.Random(12)
    rows = [(k, " ".join([words(rng, 40), "vile scum moron" if k % 3 == 0 else "fine kind friend", words(rng, 40)])) for k in range(120)]
    model = toxicity.fit([t for _, t in rows], [int(k % 3 == 0) for k, _ in rows])
    rows += [(3, rows[3][1]), (500, words(rng, 60_000) + " vile scum moron"), (501, "Ä" * 50), (502, "")]
    df = spark.createDataFrame([(*r, 0.5, 9) for r in rows], "doc_id long, text string, score double, predicted int")
    got = sorted((r.doc_id, r.score) for r in toxicity.score(df, model).collect())

    def size(window, content):
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(window))

    def score(text):
        raw, hits, n, at = text.lower().encode(), 0, 0, 0
        while raw and (at == 0 or at + 16 < len(raw)):  # a window every 16 bytes until the last byte is covered
            hits += size(raw[at:at + 32], model.ordinary) - size(raw[at:at + 32], model.toxic) >= model.margin
            n, at = n + 1, at + 16
        v = model.curve[0] + model.curve[1] * math.log(1 + hits) + model.curve[2] * math.log((hits + 0.2) / (n + 40))
        return 1 / (1 + math.exp(-v))

    assert len(got) == len(rows)
    plain = {r: score(r[1]) for r in rows if r[0] in (0, 1, 2, 3, 7, 501, 502)}
    assert {k for k, _ in got} == {k for k, _ in rows} and [s for k, s in got if k == 3] == [plain[rows[3]]] * 2
    for (k, _), want in plain.items():
        assert all(s == pytest.approx(want, abs=1e-12) for i, s in got if i == k)
