"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and columns with clashing names."""

import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slidelake.llm import ann, decontaminate, license_scan, license_texts, line_dedup, lm, mixing, quality, similar, simhash, substring_dedup, toxicity

SCHEMA = "doc_id long, text string, source string, row string, words string, n int, `key` string, label int"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = []
    for k in range(40):
        own = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 160)))
        texts.append((f"{own} {passage} {own[::-1]}" if k % 3 == 0 else own).replace(" ", "\n" if k % 4 == 0 else " ", 3))
    texts += [None, "", " \t\n ", "one", "two words", texts[3], texts[3], texts[6], " ".join(rng.choice(vocabulary) for _ in range(30_000)), "é ÉÀ ß \x0b x", "a " * 200, "menu\nhome\nbody one", "menu\nhome\nbody two"]
    out = []
    for i, t in enumerate(texts):
        out.append((i if i % 11 else None, t, [None, "b", "a", "", "é"][min(4, i % 7)], "x", None, i, "k", 1))
    return [*out, out[5], out[5]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def some(xs):
    return sorted(xs, key=repr)


def test_simhash(docs, none, rows):
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert some(got) == some(brute.near_duplicates([(r[0], r[1]) for r in rows]))
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert sorted(ids) == sorted({c for _, _, c in got if c is not None})


def test_similar(spark, docs, none, rows):
    """Edited copies at both sides of 0.8, a large family of them, and every odd row."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [[word() for _ in range(120)] for _ in range(12)]
    texts = [" ".join(b) for b in base]
    for b in base:
        for edits in (1, 2, 3, 5, 8):
            own = list(b)
            for k in rng.sample(range(120), edits):
                own[k] = word()
            texts.append(" ".join(own))
    texts += [" ".join([*base[0][:100], *[word() for _ in range(6)]]) for _ in range(60)]
    table = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n int").repartition(3)
    kept = similar.keep_one_similar(table)
    roots = brute.similar(texts)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, r in enumerate(roots) if i == r]
    odd = similar.keep_one_similar(docs)
    assert odd.columns == docs.columns and similar.keep_one_similar(none).count() == 0
    groups: dict = {}
    for r, root in zip(rows, brute.similar([r[1] for r in rows]), strict=True):
        groups.setdefault(root, []).append(r[0])
    want = [min((i for i in ids if i is not None), default=None) for ids in groups.values()]
    assert some(r.doc_id for r in odd.collect()) == some(want)


def test_fingerprints_of_random_points():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 400, dtype=np.uint64)
    near = base[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    ball = base[0] ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    points = np.unique(np.concatenate([base, near, ball]))
    want = brute.groups(len(points), lambda i, j: int(points[i] ^ points[j]).bit_count() <= 2)
    assert simhash.links(points, leaf=16).tolist() == want
    nodes = simhash.top_tree(points, 32, 2)
    met = {(i, j) for _, at in simhash.route(points, nodes, 2) for i in at for j in at if i < j and int(points[i] ^ points[j]).bit_count() <= 2}
    assert len(nodes) > 3 and met == {(i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if int(points[i] ^ points[j]).bit_count() <= 2}


@pytest.mark.parametrize("most", [2000, 1])
def test_substring_dedup(docs, none, rows, most, monkeypatch):
    """most = 1: every anchor of several segments is dealt to several automata and several streams."""
    monkeypatch.setattr(substring_dedup.repeats, "__defaults__", (35, 2000, 2 if most == 1 else 20_000))
    got = substring_dedup.remove_repeats(docs, most_in_shard=most)
    assert some(tuple(r) for r in got.collect()) == some(brute.remove_repeats([(r[0], r[1]) for r in rows]))
    assert substring_dedup.remove_repeats(none).count() == 0


def test_substring_dedup_unique_ids(spark, rows):
    own = [(i, r[1]) for i, r in enumerate(rows)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(own, "doc_id long, text string"), size=8)
    assert some(tuple(r) for r in got.collect()) == some(brute.remove_repeats(own, 8))


def test_mixing(docs, none, rows):
    got = mixing.mix(docs).collect()
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len(brute.words(r[1]))
    want = brute.targets(sizes)
    assert some((r.doc_id, r.size) for r in got) == some((r[0], len(brute.words(r[1]))) for r in rows)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in sizes)
    again = mixing.mix(docs.repartition(5), bucket_rows=3).collect()
    assert some((r.doc_id, r.size, r.taken) for r in got) == some((r.doc_id, r.size, r.taken) for r in again)
    assert mixing.mix(none).count() == 0


def test_line_dedup(docs, none, rows):
    got = line_dedup.drop_boilerplate(docs, least_pages=2, ratio=0.2)
    assert got.columns == [*[c for c in docs.columns], "n_lines", "n_dropped"]
    want = brute.line_dedup([(r[2], r[1]) for r in rows], 0.2, 2)
    assert some((r.n, r.text) for r in got.collect()) == some((r[5], t) for r, t in zip(rows, want, strict=True))
    assert any(a != r[1] for a, r in zip(want, rows, strict=True))
    assert line_dedup.drop_boilerplate(none).count() == 0
    own = line_dedup.drop_boilerplate(docs.withColumn("n_dropped", F.lit("mine")))
    assert own.columns == [*docs.columns, "n_dropped", "n_lines", "_n_dropped"] and own.where("n_dropped <> 'mine'").count() == 0


def test_line_dedup_on_small_hosts(spark):
    """A footer goes from hosts of any number of pages; what one page alone has stays, ties at the ratio too."""
    hosts = {"one": 1, "two": 2, "nine": 9, "ten": 10, "twenty": 20}
    pages = [(h, f"{h} body {k}\nfooter of {h}" + ("\ntwice" if k < 2 else "")) for h, n in hosts.items() for k in range(n)]
    got = line_dedup.drop_boilerplate(spark.createDataFrame(pages, "source string, text string"))
    assert some((r.source, r.text) for r in got.collect()) == some(zip([h for h, _ in pages], brute.line_dedup(pages), strict=True))
    left = {h: [r.text for r in got.where(F.col("source") == h).collect()] for h in hosts}
    assert left["one"] == [pages[0][1]] and all("footer" not in t for h in hosts if h != "one" for t in left[h])
    assert all("twice" not in t for t in left["nine"] + left["ten"]) and sum("twice" in t for t in left["twenty"]) == 2


def test_decontaminate(spark, docs, none, rows):
    texts = [r[1] for r in rows]
    items = [(1, " ".join(texts[0].split()[:40])), (2, None), (3, ""), (4, "one"), (5, "two, WORDS!"), (6, " ".join(texts[9].split()[5:50]) + " extra extra2"), (7, "absent words that nobody wrote at all"), (8, texts[48][200:500])]
    table = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, doc_id string")
    got = decontaminate.leaks(docs, table)
    want = brute.leaks([(r[0], r[1]) for r in rows], items)
    assert {(r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in got.collect()} == want and len({i for _, i, _, _ in want}) >= 4
    assert got.count() == len(want)
    shuffled = decontaminate.leaks(docs, table, most_broadcast=0)
    assert {(r.doc_id, r.item_id) for r in shuffled.collect()} == {w[:2] for w in want}
    left = decontaminate.decontaminate(docs, table)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r[0] for r in rows} - {w[0] for w in want}
    assert decontaminate.leaks(none, table).count() == 0 and decontaminate.leaks(docs, table.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs, table.limit(0)).count() == len(rows)


def test_entire_licenses(spark):
    from pathlib import Path

    t = license_texts
    rights = "BSD 3-Clause License\n\nCopyright (c) 2020, Someone\nAll rights reserved.\n\n" + t.BSD_3
    rows = [("Unlicense", t.UNLICENSE + "\n\nFor more information, please refer to <https://unlicense.org/>\n"), ("BSD-3-Clause", rights)]
    assert "recognize copyright laws" in t.UNLICENSE and "WARRANTY OF ANY KIND" in t.UNLICENSE
    for name, file in (("Apache-2.0", "Apache-2.0"), ("GPL-3.0", "GPL-3")):
        path = Path("/usr/share/common-licenses") / file
        rows += [(name, path.read_text())] if path.exists() else []
    rows += [("Apache-2.0", t.APACHE_2.replace("[yyyy] [name of copyright owner]", "2020 Someone"))]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert len(got) == len(rows) and all(r.doc_id == r.license_id for r in got)


def test_license(spark, none):
    mit = "Copyright (c) 2020 Someone\n\n" + license_texts.MIT.replace("sublicense", "sublicence").replace('"', "'").upper()
    rows = [(1, mit), (2, "some text\nReleased  under the MIT licence!\nmore"), (3, None), (4, ""), (None, license_texts.ISC), (1, "Licensed under CC BY-NC 4.0."), (6, license_texts.MIT + " extra")]
    got = license_scan.scan(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string"))
    found = some((r.doc_id, r.license_id, r.notices, r.digest is None) for r in got.collect())
    assert found == some([(1, "MIT", "CC-BY-NC-4.0", False), (2, None, "MIT", False), (3, None, "", True), (4, None, "", False), (None, "ISC", "", False), (1, None, "CC-BY-NC-4.0", False), (6, None, "", False)])
    assert license_scan.scan(none).count() == 0


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(len(rows))] + [(None, 1, 1), (4, None, None), (4, 0, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality(spark, docs, none, rows, labels):
    model = quality.fit(docs, labels)
    got = quality.score_quality(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_text = {r[1]: model.scores([None if r[1] is None else r[1].encode()])[0] for r in rows}
    kept = quality.keep_good(docs, model, threshold=0.5)
    assert kept.columns == docs.columns and some(r.text for r in kept.collect()) == some(r[1] for r in rows if by_text[r[1]] >= 0.5)
    assert quality.score_quality(none, quality.fit(none, labels.limit(0))).count() == 0
    one = quality.fit(docs, labels.where("quality = 1"))
    assert {round(r.score, 6) for r in quality.score_quality(docs, one).collect()} != {0.0}


def test_chain_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    chain = quality.Chain(rng.normal(size=4), rng.normal(size=(2, 2)))
    sizes = np.array([3, 1, 4])
    x = rng.normal(size=(8, 4))
    good, pair = chain.run(x, sizes)
    at, want, pairs = 0, [], np.zeros((2, 2))
    for n in sizes:
        total, marg, p2 = 0.0, np.zeros(n), np.zeros((2, 2))
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            s = np.exp(sum(x[at + k] @ chain.w * y[k] for k in range(n)) + sum(chain.trans[y[k], y[k + 1]] for k in range(n - 1)))
            total += s
            marg += s * np.array(y)
            for k in range(n - 1):
                p2[y[k], y[k + 1]] += s
        want += (marg / total).tolist()
        pairs += p2 / total
        at += n
    assert good == pytest.approx(want) and pair == pytest.approx(pairs)


def test_toxicity(docs, none, rows, labels):
    model = toxicity.fit(docs, labels)
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score_toxicity(none, toxicity.fit(none, labels.limit(0))).count() == 0


def best_by_enumeration(classes, values):
    """The best of all runs of the composed grammar over a clause, one by one."""
    t = toxicity.grammar()
    owing = lambda s: isinstance(s, tuple) and (s[:1] == ("owes",) or any(owing(x) for x in s))
    best = [float("-inf")]

    def go(state, at, total):
        if at == len(classes):
            if not owing(state):
                best[0] = max(best[0], total)
            return
        for to, _, weight in t.steps(state, classes[at]):
            go(to, at + 1, total + sum(values[p] for p in weight))

    go(t.start, 0, 0.0)
    return best[0]


def test_best_paths_match_enumeration():
    rng = random.Random(3)
    values = np.array([rng.uniform(-2, 2) for _ in toxicity.PARAMS])
    clauses = [[rng.choice(toxicity.CLASSES) for _ in range(rng.randint(1, 9))] for _ in range(150)]
    cls = np.array([toxicity.CLASSES.index(c) for x in clauses for c in x])
    number = np.repeat(np.arange(len(clauses)), [len(x) for x in clauses])
    got, used = toxicity.best_paths(*toxicity.machine(), cls, number, values)
    assert got == pytest.approx([best_by_enumeration(x, values) for x in clauses])
    assert used @ values == pytest.approx(got)


def test_grammar():
    m = toxicity.ToxicityModel(frozenset({"blorg"}), frozenset({"snarf"}))
    score = lambda *texts: m.scores(pa.array(texts, pa.string())).round(6).tolist()
    plain, aimed, negated, reported, bare, nothing, none = score("What a Blorg!", "you are a blorg", "you are not a blorg", "she said you are a blorg", "such an idiot", "nothing of it", None)
    assert aimed > plain > nothing == none and negated < plain and reported < plain and bare < plain
    assert score("you idiot")[0] > bare  # a seed counts by its aim
    assert score("he said, you are a blorg")[0] == aimed and score("not today. a blorg")[0] == plain  # a clause ends
    assert score("blorg you are")[0] == aimed and score("snarfling here")[0] > nothing
    idle = " ".join(["word"] * 50)
    assert score(f"you {idle} blorg {idle} not")[0] == plain and score("")[0] == none
    assert score(*["you are a blorg"] * 3) == [aimed] * 3
    two = m.scores(pa.array(["you are a blorg"] * 2 + [None, "x" * 3_000_000]))
    assert two[0] == two[1] and two[2] == two[3]


def test_negation_and_reports_turn_the_verdict(spark):
    """Learned from labels alone: the same word is toxic said, and not when denied or reported."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(word() for _ in range(20)) for _ in range(300)]
    texts = [f"{t}. you are a blorg {word()}" if i % 3 == 0 else t for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int"))
    assert "blorg" in model.lexicon
    said, denied, reported = model.scores(pa.array([f"{word()}. {t}" for t in ("you are a blorg", "you are not a blorg", "she said you are a blorg")]))
    assert said >= 0.5 > max(denied, reported)


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_held_out_labels_change_nothing(spark, docs, labels, module, label):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    turned = labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label)))
    assert labels.where(held & F.col("doc_id").isNotNull()).count() > 3
    texts = [r.text for r in docs.collect()]
    a, b = (module.fit(docs, x) for x in (labels, turned))
    get = lambda m: m.scores(pa.array(texts, pa.string())) if module is toxicity else m.scores([None if t is None else t.encode() for t in texts])
    assert get(a).tolist() == get(b).tolist()


def test_lm(spark, docs, none, rows):
    train = docs.where(F.coalesce(F.col("doc_id"), F.lit(0)) % 3 != 0).select("doc_id", "text")
    model = lm.fit(train, head=50)
    got = lm.score(docs.select("doc_id", "text"), model).collect()
    from collections import Counter
    from math import log10

    kept = [r for r in rows if (r[0] or 0) % 3]
    c = Counter(w for r in kept for w in (r[1] or "").encode().lower().split())
    n, v = sum(c.values()) + len(kept), len(c) + 1
    p = lambda k: log10((k + 1) / (n + v + 1))

    def base(t):
        w = (t or "").encode().lower().split()
        return (len(w) + 1, sum(x in c for x in w) + 1, round(sum(p(c[x]) for x in w) + p(len(kept)), 6))

    assert some((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == some((r[0], *base(r[1])) for r in rows)
    assert all(r.score < 0 for r in got)
    empty = lm.fit(none.select("doc_id", "text"))
    assert len(lm.score(docs.select("doc_id", "text"), empty).collect()) == len(rows)


def test_lm_attention_reads_every_document(spark, monkeypatch):
    """Each document holds subwords of its own: their values move only if its windows are trained on. Here all windows are
    taken; in production every document gives one in ONE_IN of its windows."""
    monkeypatch.setattr(lm, "PER_LEARNER", 500)
    monkeypatch.setattr(lm, "ONE_IN", 1)
    tok = lm.tokenizer_of(lm.read_file(spark, lm.TOKENIZER))
    single = [w for w in (bytes([97 + a, 97 + b, 97 + c]) for a in range(26) for b in range(26) for c in range(26)) if len(tok.ids(w)) == 1][:400]
    filler = " ".join(w.decode() for w in single[:60])
    rows = [(k, f"{filler} {w.decode()} {filler}") for k, w in enumerate(single[60:])]
    model = lm.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    first = lm.first_weights(len(model.tables.kind), model.tables.outer.shape[1])
    own = [model.tables.place[tok.ids(w)[0]] for w in single[60:]]
    assert len(set(own)) == len(own)
    assert (np.abs(model.weights["v"][own] - first["v"][own]).max(axis=1) > 0).all()


def test_lm_is_a_distribution():
    """Over all ways to go on from a context, classes and places add up to one; windows score each target once."""
    pairs = np.array([(-1, 3, 5), (3, 4, 4), (4, -1, 4), (3, -1, 1), (-1, 7, 2), (7, -1, 2)])
    real = np.zeros(10)
    for _, b, k in pairs:
        if b >= 0:
            real[b] += k
    t = lm.tables_of(pairs, real, 3, n_places=2, n_classes=8)
    p = np.exp(t.inner + t.outer[:, t.kind])
    assert p[:, : t.pad].sum(axis=1) == pytest.approx(1, abs=1e-4)
    assert np.exp(t.rare[t.place == t.end - 1]).sum() == pytest.approx(1, abs=1e-4)
    flat, sizes = np.arange(70) % 3, np.array([0, 50, 1, 19])
    x, y, of, padded = lm.windows_of(flat, sizes, t.end, t.pad)
    assert np.bincount(of, weights=(y >= 0).sum(axis=1)).tolist() == (sizes + 1).tolist()
    w = {k: a + np.float32(0.1) for k, a in lm.first_weights(len(t.kind), t.outer.shape[1]).items()}
    whole = lm.score_windows(w, t, x, y, padded)
    for k in (1, 3):  # a target's probability does not see what comes after it
        z = x.copy()
        z[k, -1] = (z[k, -1] + 1) % 3
        assert lm.score_windows(w, t, z, y, padded)[k, :-1] == pytest.approx(whole[k, :-1], abs=1e-5)


def test_gradients():
    rng = np.random.default_rng(0)
    pairs = np.array([(-1, 3, 5), (3, 4, 4), (4, -1, 4), (-1, 7, 2), (7, 4, 2)])
    real = np.zeros(10)
    for _, b, k in pairs:
        if b >= 0:
            real[b] += k
    t = lm.tables_of(pairs, real, 3, n_classes=8)
    flat = rng.integers(0, 3, 900)
    x, y, _, padded = lm.windows_of(flat, np.array([900]), t.end, t.pad)
    loss = lambda w: -lm.score_windows(w, t, x, y, padded)[y >= 0].mean()
    first = lm.first_weights(len(t.kind), t.outer.shape[1])
    assert loss(lm.train(first, t, x, y, steps=60)) < loss(first) - 0.01


def test_nearest(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 24)) * rng.uniform(0.5, 2, (3000, 1))
    v[100:130] = v[100]
    rows = [(i, [float(x) for x in r], "c") for i, r in enumerate(v)]
    odd = [(5001, None, "c"), (5020, [0.0] * 24, "c"), (5040, [float("nan")] + [1.0] * 23, "c"), (5060, [None] + [1.0] * 23, "c"), (5080, [float("inf")] * 24, "c"), (None, [1.0] * 24, "c"), (5100, [1.0] * 3, "c"), (5101, [2.0, 0.0, 1.0], "c")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, query_id string")
    got = {}
    for r in ann.nearest(df, shard=1000, block=64).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.pop(5100) == [(1, 5101, 3.0)]  # another length: an index of its own
    assert set(got) == set(range(0, 3000, 20))
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        exact = v @ v[q]
        assert [f[2] for f in found] == pytest.approx([exact[f[1]] for f in found])
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        order = [i for i in np.lexsort((np.arange(len(v)), -exact.round(12))) if i != q][:20]
        hit += len(set(order) & {f[1] for f in found})
    assert hit / (20 * len(got)) >= 0.9
    few = ann.nearest(df.where("vec_id < 5")).collect()
    assert [(r.query_id, r.rank) for r in few] == [(0, k) for k in range(1, 5)]
    assert ann.nearest(df.where("vec_id = 5001")).count() == 0 and ann.nearest(df.limit(0)).count() == 0


def test_copies_take_no_other_vector_s_place(spark):
    """A third of all rows are one vector: the queries elsewhere find what they find without it."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=(1500, 24))
    v[500:1000] = v[500]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "vec_id long, embedding array<double>")
    assert ann.entries(ann.valid(df, "vec_id", "embedding"), 20).where("size(ids) > 21").count() == 0
    got = {}
    for r in ann.nearest(df, shard=400).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    exact = lambda q: [i for i in np.lexsort((np.arange(1500), -(v @ v[q]).round(12))) if i != q][:20]
    assert got[500] == exact(500) == list(range(501, 521)) and got[520] == [*range(500, 520)]
    assert sum(len(set(got[q]) & set(exact(q))) for q in got) / (20 * len(got)) >= 0.9


def test_similar_finds_links_that_no_named_text_has(spark):
    """All texts share the one fingerprint, which names two of them; the links of all others are found as well."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = [word() for _ in range(60)]
    texts = ["", "one", "one two three four five", "a b c d e f", "a b c d e f g", "a b c d e f g h"]
    for _ in range(40):  # 0.6 and less between families, chains of links around 0.8 within one
        own = [*shared, *[word() for _ in range(24)]]
        for _ in range(4):
            texts.append(" ".join(own))
            k = rng.randrange(60, 84)
            own = [*own[:k], word(), *own[k + rng.randrange(2) :], *[word() for _ in range(rng.randrange(5))]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = similar.set_rows(table, "doc_id", "text", 5).withColumnRenamed("doc_id", "rep")
    classes = similar.written(rows.withColumn("fps", F.expr("array(7L)")))
    hubs, met, sets = similar.hub_links(classes, table, 0.8, "doc_id", "text", 5)
    groups = similar.components(hubs)
    few = {tuple(r) for r in similar.rest_links(groups, met, sets, 0.8, buckets=7).collect()}
    assert len(few) > 20 and few == {tuple(r) for r in similar.rest_links(groups, met, sets, 0.8).collect()}
    key = {r.key: r.rep for r in classes.collect()}
    roots = brute.similar(texts)
    got: dict = {}
    for r in similar.similar_groups(classes, table).collect():
        got.setdefault(r.root, set()).add(key[r.node])
    want: dict = {}
    for i, r in enumerate(roots):
        want.setdefault(r, set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_similar_crowds_make_no_rows_by_pair(spark, monkeypatch):
    """Many near copies, each link of which the named texts miss: every group is found, and pairs are no rows of a join."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(150):  # one or two edits from the base: pairs lie on both sides of 0.8
        own = list(base)
        for k in rng.sample(range(120), rng.randrange(1, 3)):
            own[k] = word() if rng.random() < 0.5 else "x"
        texts.append(" ".join(own))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = similar.set_rows(table, "doc_id", "text", 5).withColumnRenamed("doc_id", "rep")
    classes = similar.written(rows.dropDuplicates(["key"]).withColumn("fps", F.expr("array(7L)")))
    _, met, sets = similar.hub_links(classes, table, 0.8, "doc_id", "text", 5)
    none = spark.createDataFrame([], "node long, root long")
    hubs = {r.key for r in met.select(F.explode(F.array("one.key", "two.key")).alias("key")).collect()}
    seen = []
    plain = similar.verified
    monkeypatch.setattr(similar, "verified", lambda pairs, *a: seen.append(pairs.count()) or plain(pairs, *a))
    crowd = similar.crowd_links
    monkeypatch.setattr(similar, "crowd_links", lambda *a: crowd(*a, block=40))  # several blocks
    links = [tuple(r) for r in similar.rest_links(none, met, sets, 0.8).collect()]
    held = {r.key: np.frombuffer(r.set, np.uint64) for r in sets.collect() if r.key not in hubs}
    alike = lambda a, b: (n := len(np.intersect1d(held[a], held[b]))) >= 0.8 * (len(held[a]) + len(held[b]) - n) - 1e-9
    edges = [(a, b) for a in held for b in held if a < b and alike(a, b)]
    assert len(edges) > len(held) and set(links) <= set(edges) and sum(seen) <= 8 * len(held)

    def roots(pairs):
        up = {k: k for k in held}
        for a, b in pairs:
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[max(a, b)] = min(a, b)
        out = {}
        for k in held:
            r = k
            while up[r] != r:
                r = up[r]
            out[k] = r
        return out

    assert roots(links) == roots(edges)
    a, b = similar.links_within(np.array(sorted(held)), np.array(sorted(held)), None, [held[k] for k in sorted(held)], 0.8)
    assert len(a) < len(edges) + 1 and roots(zip(a, b, strict=True)) == roots(edges)


def test_lm_trains_on_every_window_as_shipped():
    """No window is left out, and rows become bytes unchanged."""
    assert lm.ONE_IN == 1
    rows = np.random.default_rng(0).integers(0, 2000, (7, 56)).astype(np.int16)
    assert lm.binaries(rows).to_pylist() == [r.tobytes() for r in rows] and len(lm.binaries(rows[:0])) == 0


def test_components_take_few_jobs_and_match_brute_force(spark):
    """Edges that a task holds are contracted there, so few edges take few jobs; dealt over tasks they lead as far."""
    from slidelake.llm import components

    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randrange(-400, 0), rng.randrange(-400, 0)) for _ in range(250)] + [(-1000, k) for k in range(1000, 1060)] + [(5000, 5000)]
    up = {x: x for e in edges if e[0] != e[1] for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            up[max(root(a), root(b))] = min(root(a), root(b))
    want = {x: root(x) for x in up}
    table = spark.createDataFrame(edges, "a long, b long").repartition(5)
    spark.sparkContext.setJobGroup("few edges", "")
    few = components.components(table).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few edges"))
    spark.sparkContext.setJobGroup("", "")
    assert len(few) == len(want) and {r.node: r.root for r in few} == want
    assert jobs <= 20
    assert not components.settled(table) and components.settled(spark.createDataFrame([(3, 1), (2, 1), (5, 4)], "a long, b long"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        dealt = components.components(table).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(dealt) == len(want) and {r.node: r.root for r in dealt} == want


def test_windows_are_dealt_in_one_row_for_each_learner():
    """A row holds all of a run's windows for a learner; their order in training does not depend on how they were parted."""
    rng = np.random.default_rng(2)
    rows = rng.integers(-1, 5, (3000, 56)).astype(np.int16)
    who = rng.integers(0, 7, len(rows))
    parts = [lm.dealt(who[k], rows[k]) for k in (slice(0, 900), slice(900, 900), slice(900, 3000))]
    assert [len(names) for names, _ in parts] == [7, 0, 7]
    for learner in range(7):
        held = pa.chunked_array([[xy[list(names).index(learner)].as_py() for names, xy in parts if learner in names]], pa.binary())
        assert lm.in_order(held, 56).tobytes() == b"".join(sorted(r.tobytes() for r in rows[who == learner]))


def test_lm_graphs_give_the_same_sums_as_numpy():
    """Training and scoring by graphs, padded windows and steep scores included; all the windows' targets count."""
    from slidelake.llm import graph

    rng = np.random.default_rng(4)
    ids = rng.integers(0, 40, 3000)
    pairs = np.stack([ids[:-1], ids[1:], np.ones(2999, np.int64)], axis=1)
    t = lm.tables_of(pairs, np.bincount(ids, minlength=50).astype(float), 3, n_places=30, n_classes=16)
    x, y, _, padded = lm.windows_of(t.place[ids], np.array([0, 2000, 1, 999]), t.end, t.pad)
    w = lm.first_weights(len(t.kind), t.outer.shape[1])
    a, b = (lm.train(w, t, x, y, steps=30, native=k) for k in (False, True))
    assert all(np.abs(a[k] - w[k]).max() > 0.01 and a[k] == pytest.approx(b[k], abs=2e-3) for k in w)
    for scale in (1, 30):
        steep = {k: v * np.float32(scale) for k, v in a.items()}
        run = lm.scorer_of(steep, t)
        assert run is not None and graph.PARTS > 1
        want, got = lm.score_windows(steep, t, x, y, padded), lm.score_windows(steep, t, x, y, padded, run=run)
        assert np.isfinite(got).all() and got[y >= 0] == pytest.approx(want[y >= 0], rel=1e-4, abs=1e-4)


def test_words_are_encoded_in_bulk_as_one_by_one():
    """White space beyond the six characters stays inside words."""
    tok = lm.Tokenizer(open(lm.TOKENIZER, "rb").read())
    words = [w.encode() for w in ("the", "a b", " ", "x\x1cy", "naïve", "日本語", "...", "the", "a" * 300)]
    for some in (words, words[:1], []):
        flat, size = tok.flat_ids(some)
        assert np.split(flat, np.cumsum(size))[:-1] == [] if not some else [p.tolist() for p in np.split(flat, np.cumsum(size)[:-1])] == [tok.ids(w) for w in some]
    assert lm.pieces(pa.array(words, pa.binary()).slice(2, 4)) == words[2:6] and lm.pieces(pa.array([], pa.binary())) == []
