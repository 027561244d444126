"""Operators that SQL can't express, against plain versions."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import imatch, jaccard_join, langid, licenses, mixing, secrets, toxicity

WORDS = [f"w{i}" for i in range(400)]


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# op1
def test_labels_of_other_documents_have_no_effect(spark):
    rng = random.Random(3)
    fill = lambda n: " ".join("".join(rng.choices(["ba", "do", "ke", "li", "mu", "ra", "ti"], k=rng.randint(1, 3))) for _ in range(n))
    bad = ["grumpflesnort", "wibblezark", "quonkity"]
    rows = [(i, f"{fill(60)} {rng.choice(bad)} {fill(20)} {rng.choice(bad)} {fill(20)}" if i % 4 == 0 else fill(100)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    kept = docs.where(~toxicity.held_out())
    changed = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(kept, x) for x in (labels, changed))
    assert a.toxic == b.toxic and a.limits == b.limits and np.array_equal(a.weights, b.weights)
    got = toxicity.toxicity(docs, a).join(docs.select("doc_id", toxicity.held_out().alias("out")), "doc_id").where("out").collect()
    right = [(r.score >= toxicity.KEEP) == (r.doc_id % 4 == 0) for r in got]
    assert len(got) > 150 and np.mean(right) > 0.95


def test_compressed_lengths_and_windows():
    import zstandard

    texts = ["", "one two three " * 30, "x" * 5000, "é" * 100]
    buf, spans, of = toxicity.windows(texts)
    raw = buf.tobytes()
    assert b"".join(raw[a : a + n] for a, n in spans.tolist()) == raw and np.all(np.diff(of) >= 0)
    lengths = toxicity.Lengths(b"one two three four five " * 20)(buf, spans)
    plain = [len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b"one two three four five " * 20, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(raw[a : a + n])) for a, n in spans.tolist()]
    # other parameters and no header, so lengths go along with the library's plain ones
    assert len(lengths) == len(spans) and np.corrcoef(lengths, plain)[0, 1] > 0.95


# op3
def test_kneser_ney_against_counts():
    """Log-probabilities of words from dictionaries of counts."""
    train = {"aa": ["banana bandana ana nab", "nan ban"], "bb": ["tik tok kitkit oti", "koti"]}
    model = langid.fit(train)
    order = langid.ORDER
    alphabet = max(2, len({c for texts in train.values() for t in texts for c in t.replace(" ", "")} | {"$"}) + 1)

    def grams(word, n):
        """n-grams that end at a character or the boundary after the word, with one boundary before it."""
        padded = "$" + word + "$"
        return [padded[i - n + 1 : i + 1] for i in range(1, len(padded)) if i - n + 1 >= 0]

    for j, lang in enumerate(model.langs):
        words = " ".join(train[lang]).split()
        raw = [Counter(g for w in words for g in grams(w, n)) for n in range(1, order + 1)]
        counts = []
        for n in range(order):
            follow = Counter(g[1:] for g in raw[n + 1]) if n + 1 < order else {}
            counts.append({g: follow.get(g, c) for g, c in raw[n].items()} if n + 1 < order else dict(raw[n]))

        def p(g):
            n = len(g)
            if n == 0:
                return 1 / alphabet
            table = counts[n - 1]
            n1, n2 = sum(c == 1 for c in table.values()), sum(c == 2 for c in table.values())
            d = min(0.95, n1 / (n1 + 2 * n2)) if n1 else 0.5
            same = [c for x, c in table.items() if x[:-1] == g[:-1]]
            if not same:
                return p(g[1:])
            return max(table.get(g, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * p(g[1:])

        for word in ["banana", "kit", "nab", "zzz", "tokban"]:
            padded = "$" + word + "$"
            want = sum(np.log(p(padded[max(0, i - order + 1) : i + 1])) for i in range(1, len(padded)))
            points, start, length, _ = langid.to_words([word])
            assert model.word_logs(points, start, length)[0, j] == pytest.approx(want, abs=1e-6), (lang, word)


def test_language_of_other_text_is_rejected_when_asked():
    rng = random.Random(5)
    lang = {"aa": "ban kal mer tiv".split(), "bb": "xo quy zin wup".split()}
    make = lambda parts, n: " ".join("".join(rng.choices(parts, k=2)) for _ in range(n))
    model = langid.fit({x: [make(v, 2000)] for x, v in lang.items()})
    own = [make(v, 30) for v in lang.values() for _ in range(100)]
    other = [make("gdp hrj fsl çöü".split(), 30) for _ in range(100)]
    assert np.mean([x == "und" for x in model.predict(own, None)[0]]) < 0.05 and np.mean([x == "und" for x in model.predict(other, None)[0]]) > 0.95
    assert "und" not in model.predict(other)[0]


# op4
def _hash(*values, seed=42):
    """Spark's xxhash64 of values one after the other: strings, ints (4 bytes) and longs (8)."""
    for v, size in values:
        raw = v.encode() if isinstance(v, str) else int(v).to_bytes(size, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed=seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def test_fingerprints_and_likeness(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(WORDS[:150], k=80)) for _ in range(30)]
    texts[11] = texts[10] + " tail"
    terms = lambda t: {_hash((w, 0)) for w in re.findall(r"[^\W_]+", t.lower())}
    df = Counter(h for t in texts for h in terms(t))
    lexicon, usual = imatch.lexicon(docs_of(spark, texts), low=0.1, high=0.5)
    # the two near copies count as one of 29 documents for the upper bound
    share = {h: c - (h in terms(texts[10])) for h, c in df.items()}
    assert set(lexicon) == {h for h, c in df.items() if c >= 3 and share[h] <= 0.5 * 29} and set(usual) == {h for h, c in df.items() if c >= 3 and share[h] > 0.5 * 29}

    def plain(t):
        marks = sorted(terms(t) & set(lexicon))
        assert len(marks) >= imatch.FEW
        out = []
        for k in range(imatch.SUBSETS):
            bits = (4, 6, 8)[k % 3]
            some = [h for h in marks if ((h % (1 << 64)) >> (5 * k % 56)) & ((1 << bits) - 1) == 0]
            out.append(_hash((k, 4), *((h, 8) for h in some)) if some else None)
        return out

    want = [plain(t) for t in texts]
    got = {r.doc_id: r for r in imatch.edited_fingerprints(docs_of(spark, texts), low=0.1, high=0.5).collect()}
    for i, p in enumerate(want):
        assert got[i].fingerprint == ":".join("-" if x is None else f"{x % (1 << 64):x}" for x in p)
        pairs = [(a, b) for a, b in zip(p, want[(i + 1) % 30], strict=True) if a is not None or b is not None]
        assert got[i].near_next == pytest.approx(sum(a == b for a, b in pairs) / len(pairs))
    assert got[10].near_next > 0.7


# op6
def test_random_strings_are_found_by_the_models(spark):
    rng = random.Random(6)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = "con ver tion data sing form able pre ter ment user file name state list view load".split()
    name = lambda: "".join(rng.choices(syllables, k=rng.randint(2, 3)))
    random_strings = ["".join(rng.choices(letters, k=rng.randint(24, 40))) for _ in range(120)]
    random_strings = [x if any(c.isdigit() for c in x) else x + "7" for x in random_strings]
    identifiers = [f"{name()}_{name()}_{rng.randint(1, 99)}" for _ in range(120)]
    texts = [f"{' '.join(name() for _ in range(40))} see {x} and {y} {' '.join(name() for _ in range(10))}" for x, y in zip(random_strings, identifiers, strict=True)]
    hit = wrong = 0
    for r in secrets.secrets(docs_of(spark, texts)).collect():
        t = texts[r.doc_id]
        found = {t[int(a) : int(b)] for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "markov"}
        assert r.n_markov == len(found)
        hit += random_strings[r.doc_id] in found
        wrong += identifiers[r.doc_id] in found
    assert hit >= 0.9 * 120 and wrong <= 0.05 * 120


# op8
def test_components_with_hot_columns_and_odd_ids(spark, monkeypatch):
    """A text of which near copies are half of all rows, a passage that all others share, repeated and null ids; columns in parts."""
    rng = random.Random(8)
    monkeypatch.setattr(jaccard_join._runs, "__defaults__", (40,))
    base, passage = rng.choices(WORDS, k=60), rng.choices(WORDS, k=12)
    rows = []
    for i in range(160):
        w = list(base) if i % 2 else rng.choices(WORDS, k=rng.randint(20, 40)) + passage
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((None if i % 40 == 7 else i // 2 if i % 31 == 0 else i, " ".join(w)))
    rows += [(500, "one two"), (500, " ".join(base)), (501, "ONE two")]
    sets = [frozenset(tuple(w[k : k + 4]) for k in range(len(w) - 3)) if len(w := t.lower().split()) >= 4 else frozenset([tuple(w)]) for _, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (x, _) in enumerate(rows):
        for j, (y, _) in enumerate(rows[:i]):
            if x is not None and y is not None and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = Counter((i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_columns_in_parts_give_the_same_entries(spark, monkeypatch):
    rng = random.Random(9)
    entries = spark.createDataFrame([(g, d, n := rng.randint(10, 14), rng.randint(0, n // 3)) for g in range(6) for d in range(rng.choice((1, 5, 60)))], "gram long, doc_id long, n int, place int")
    whole = {(r.gram, r.doc_id) for r in jaccard_join.shared_columns(entries, 85, 1).collect()}
    monkeypatch.setattr(jaccard_join._runs, "__defaults__", (7,))
    parts = jaccard_join.shared_columns(entries, 85, 1).collect()
    assert whole <= {(r.gram, r.doc_id) for r in parts}
    assert all(len({r.lead for r in parts if r.gram == g}) <= 1 for g in range(6))


# op9
def test_targets_against_water_filling(spark):
    rng = random.Random(10)
    for _ in range(4):
        sizes = {f"s{i:02}": rng.choice((1, 10, 100, 1000, 10_000)) * rng.randint(1, 9) for i in range(rng.randint(1, 12))} | {None: 50}
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (1.0, 2.0, 3.0)[k % 3] for k, s in enumerate(names)}
        target, left, total = {}, set(names), float(sum(sizes.values()))
        while True:
            share = (total - sum(target.values())) / sum(weight[s] for s in left)
            full = {s for s in left if weight[s] * share > 3 * sizes[s]}
            target |= {s: 3.0 * sizes[s] for s in full}
            left -= full
            if not full:
                break
        target |= {s: weight[s] * share for s in left}
        got = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        assert {r.source: pytest.approx(r.target) for r in got} == target


def test_mix_against_its_own_draws(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randint(0, 90))), rng.choice("aaabc")) for i in range(300)]
    m = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), block=16)
    draws, pieces, sources = m.draws.collect(), m.pieces.collect(), {r.source_id: r for r in m.sources.collect()}
    times = Counter((d.source_id, d.block) for d in draws)
    for s in sources.values():
        own = [d for d in draws if d.source_id == s.source_id]
        assert len(own) == s.draws and len({(d.epoch, d.block) for d in own}) == len(own) and all(0 <= d.block < s.blocks for d in own)
    assert sorted(d.slot for d in draws) == list(range(len(draws)))
    # blocks cover each source's words once
    words = defaultdict(list)
    for p in pieces:
        words[p.doc_id].append((p.w_from, p.w_to))
    for i, t, _ in rows:
        spans = sorted(words[i])
        assert [a for a, _ in spans] == [0, *[b for _, b in spans]][: len(spans)] and (spans[-1][1] if spans else 0) == len(t.split())
    taken = Counter()
    for p in pieces:
        taken[p.doc_id] += (p.w_to - p.w_from) * times[(p.source_id, p.block)]
    assert {r.doc_id: r.taken for r in m.taken().collect()} == {i: taken[i] for i, _, _ in rows}
    # the documents of the mix hold the words that were taken
    mixed = Counter()
    for r in mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long")), block=16).collect():
        mixed[r.doc_id] += len(r.text.split())
    assert +mixed == +taken


# op10
def test_licenses_against_containment_in_every_window(spark):
    rng = random.Random(12)
    library = {f"t{i}": " ".join(rng.choices(WORDS, k=rng.choice((3, 9, 30)))) for i in range(6)}
    texts = []
    for _ in range(60):
        w = rng.choices(WORDS, k=rng.randint(0, 80))
        for t in rng.sample(sorted(library), rng.randint(0, 2)):
            copy = library[t].split()
            if rng.random() < 0.4:
                copy[rng.randrange(len(copy))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = copy
        texts.append(" ".join(w))
    got = {r.doc_id: {x.split(":")[0] for x in r.licenses.split(",") if x} for r in licenses.licenses(docs_of(spark, texts), library).collect()}
    for i, text in enumerate(texts):
        w, want = text.split(), set()
        for name, _, window, piece, shingles in licenses.parts(library):
            size = min(licenses.WORDS, len(piece))
            at = [(" ".join(w[k : k + size]), k) for k in range(len(w) - size + 1)]
            starts = range(0, max(1, len(w)), window // 2)
            if any(len({s for s, k in at if a <= k and k + size <= a + window} & set(shingles)) >= 0.8 * len(shingles) for a in starts):
                want.add(name)
        assert got[i] == want, text
