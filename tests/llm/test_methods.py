"""The methods inside the operators, against plain versions of them."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from formwork.llm import bpe, components, jaccard, licences, mixing, neighbours, personal, quality, queries, toxicity, windows
from formwork.llm.oracles import ORACLES

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, data, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = queries.QUERIES[name](spark, data)
    columns = sorted(got.columns)
    want = duck.sql(ORACLES[name])
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.project(",".join(columns)).fetchall())


# ------------------------------------------------------------------------------------ op1


@pytest.mark.parametrize("scale", [1e200, 1e-200, 1.0])
def test_vectors_of_any_magnitude(spark, scale):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) * scale for x in rng.normal(size=7)]) for i in range(60)]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, 3, candidate_block=16, query_block=4).collect()
    unit = {i: np.array(v) / scale for i, v in rows}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    for q in range(0, 60, 10):
        near = sorted((-float(unit[q] @ v), i) for i, v in unit.items() if i != q)[:3]
        own = sorted((r["rank"], r.vec_id, r.score) for r in found if r.query_id == q)
        assert [x[1] for x in own] == [i for _, i in near] and np.allclose([x[2] for x in own], [-s for s, _ in near])


# ------------------------------------------------------------------------------------ op2


def _hash(*parts):
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def test_resemblance_against_brute_force(spark, data):
    cells = 1 << 16
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    token = __import__("regex").compile(quality.TOKEN.replace(r"\s", r" \t\n\x0b\f\r"))
    grams = {}
    for i, text in docs.items():
        t = token.findall(text)
        grams[i] = [_hash(x) % cells for x in t] + [_hash(a, b) % cells for a, b in zip(t, t[1:])]
    held = {r.of for r in spark.createDataFrame([(i,) for i in labels], "of long").filter(F.pmod(F.xxhash64("of", F.lit("held out")), F.lit(5)) == 0).collect()}
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if labels.get(i) == 1 and i not in held:
            target.update(g)
    n, m = sum(raw.values()) + cells / 2, sum(target.values()) + cells / 2
    weight = lambda c: round((np.log((target[c] + 0.5) / m) - np.log((raw[c] + 0.5) / n)) * (1 << 20))
    score = {i: sum(map(weight, g)) / len(g) / (1 << 20) if g else 0.0 for i, g in grams.items()}
    rows = {r.doc_id: r for r in queries.op2_quality_rules(spark, data).collect()}
    assert all(abs(rows[i].score - s) < 1e-9 for i, s in score.items())
    chosen = [(rows[i].score, labels[i]) for i in held if i in rows and not rows[i].base_failed]
    good, bad = sum(g for _, g in chosen), sum(not g for _, g in chosen)
    assert good and bad
    rate = lambda least: sum(s >= least for s, g in chosen if g) / good + sum(s < least for s, g in chosen if not g) / bad
    bins = sorted({int(np.floor(s * 256)) for s, _ in chosen})
    best = max(bins, key=lambda b: (round(rate(b / 256), 12), -b))
    below = max((b for b in bins if b < best), default=best - 1)
    threshold = (best + below + 1) / 512
    assert all(rows[i].kept == (not rows[i].base_failed and rows[i].score >= threshold) for i in docs)


def test_every_held_out_label_chooses_the_threshold(spark):
    """Trusted rows of a lower score, which are the last by hash, move the threshold, too."""
    good = spark.range(29_000).select("id", (F.pmod(F.xxhash64("id", F.lit("held out")), F.lit(5)) == 0).alias("held")).orderBy(F.xxhash64("id"), "id").collect()
    held = [r.id for r in good if r.held]
    assert len(held) > 5_500
    late = set(held[5_000:])
    words = lambda x, z: " ".join([f"x{i}" for i in range(x)] + [f"z{i}" for i in range(z)])
    rows = [(r.id, words(4, 12) if r.id in late else words(16, 0), 1) for r in good] + [(i, words(0, 16), 0) for i in range(29_000, 29_600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    kept = {r.doc_id: r.kept for r in quality.resemblance(docs.drop("quality"), docs.drop("text")).collect()}
    assert kept == {i: q == 1 for i, _, q in rows}


def test_without_labels_only_the_rules_reject(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.resemblance(docs, none).filter("kept = base_failed or score <> 0").count() == 0


# ------------------------------------------------------------------------------------ op3


def test_licences_against_a_full_scan(spark):
    """Every passage with enough of a template's shingles, edited notices among prose."""
    rng = random.Random(2)
    fold = re.compile(r"[a-z0-9]+")
    filler = [f"word{i}" for i in range(500)] + "license this the to of software under version permission".split()
    templates = {k: fold.findall(t.lower()) for k, t in licences.TEMPLATES.items()}
    docs = {}
    for i in range(400):
        name = rng.choice(list(templates))
        words = list(templates[name])
        for _ in range(rng.randrange(0, 1 + len(words) // 12)):
            words[rng.randrange(len(words))] = rng.choice(filler)
        prose = lambda: [rng.choice(filler) for _ in range(rng.randrange(0, 80))]
        docs[i] = " ".join([*prose(), *words, *prose()])
    got = {(r.doc_id, r.licence) for r in licences.scan(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    want = set()
    for i, text in docs.items():
        words = text.split()
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        for name, t in templates.items():
            own = {tuple(t[k : k + 5]) for k in range(len(t) - 4)}
            at = [k for k, g in enumerate(grams) if g in own]
            runs = np.split(np.array(at), np.flatnonzero(np.diff(at) > len(own)) + 1) if at else []
            if any(len({grams[k] for k in run}) >= 0.8 * len(own) for run in runs):
                want.add((i, name))
    assert got <= want and len(want) > 120 and len(got) >= 0.99 * len(want)


def test_bands_collide_with_high_probability():
    b = licences.Bands()
    assert 1 - (1 - 0.5**b.rows) ** b.bands > 0.998


# ------------------------------------------------------------------------------------ op4


def test_ordinal_regression_finds_the_least_loss():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2, (900, 6)).astype(float)
    z = x @ np.array([2.0, -1.5, 1.0, 0, 0, 0])
    y = np.digitize(z + rng.logistic(size=900), [0.5, 2.0])
    penalty = 0.002
    w, cuts = toxicity.fit_ordinal(x, y, 3, penalty=penalty, rounds=3000)

    def loss(w, cuts):
        edges = np.array([-1e3, *cuts, 1e3])
        s = lambda b: 1 / (1 + np.exp(np.clip(x @ w - b, -500, 500)))
        return -np.log(np.maximum(s(edges[y + 1]) - s(edges[y]), 1e-12)).mean() + penalty * np.abs(w).sum()

    assert cuts[0] < cuts[1] and np.abs(w[:3] - [2, -1.5, 1]).max() < 0.5 and np.abs(w[3:]).max() < 0.3
    least = loss(w, cuts)
    for k in range(8):
        for d in (-0.02, 0.02):
            step = np.zeros(8)
            step[k] = d
            assert loss(w + step[:6], cuts + step[6:]) >= least - 1e-6


def test_ordered_labels_and_repeated_ids(spark):
    words = {0: "calm blue", 1: "rude calm", 2: "rude vile"}
    docs = spark.createDataFrame([(i, f"{words[i % 3]} w{i % 7}") for i in range(300)] + [(0, "other text")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3) for i in range(300)] + [(2, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model == toxicity.fit(docs.repartition(7), labels.repartition(5)) and len(model.cuts) == 2
    got = toxicity.grade(spark.createDataFrame([(k, w) for k, w in words.items()], "doc_id long, text string"), model).collect()
    severity = [r.severity for r in sorted(got, key=lambda r: r.doc_id)]
    assert [r["grade"] for r in sorted(got, key=lambda r: r.doc_id)] == [0, 1, 2] and severity == sorted(severity)


# ------------------------------------------------------------------------------------ op5


def _bits(n):
    return max(1, n.bit_length())


def _mixed(docs, seed="mix"):
    """(id, source, text) -> copies of each distinct document, by the rule in plain Python."""
    size = lambda t: len(WORDS.findall(t or ""))
    units = Counter(docs)
    sources = sorted({s for _, s, _ in units}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n * size(t) for (_, o, t), n in units.items() if o == s) for s in sources}
    w = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(sources)}
    full, level = set(), 0.0
    while True:
        rest = [s for s in sources if s not in full]
        if not rest:
            break
        level = (1.5 * sum(total.values()) - sum(2.0 * total[s] for s in full)) / sum(w[s] for s in rest)
        more = {s for s in sources if 2.0 * total[s] <= level * w[s]}
        if more == full:
            break
        full = more
    target = {s: min(2.0 * total[s], level * w[s]) if len(full) < len(sources) else 2.0 * total[s] for s in sources}
    copies = {}
    for s in sources:
        own = [(u, n) for u, n in units.items() if u[1] == s]
        held = Counter()
        for (_, _, t), n in own:
            held[_bits(size(t)) + 8] += n * size(t)
        spent, each, order = 0, {}, sorted(held, reverse=True)
        for k, c in enumerate(order):
            after = sum(x * held[x] for x in order[k:])
            if after and (level_c := (target[s] - 2.0 * spent) / after) * c <= 2.0:
                each = {x: min(2.0, level_c * x) for x in order[k:]}
                break
            spent += held[c]
        ranks, certain = [], 0
        for u, n in own:
            z = size(u[2])
            e = each.get(_bits(z) + 8, 2.0) * n if held[_bits(z) + 8] else 0.0
            copies[u] = int(e)
            certain += int(e) * z
            p = e - int(e)
            if p > 0 and z > 0:
                draw = int(hashlib.md5(f"{seed}:{'null' if u[0] is None else u[0]}:{u[2] or ''}".encode()).hexdigest()[:12], 16)
                r = (draw + 0.5) / 2**48
                ranks.append(((r / (1 - r)) / (p / (1 - p)), u, z))
        before = 0
        for _, u, z in sorted(ranks, key=lambda x: x[0]):
            copies[u] += before + z / 2 <= target[s] - certain
            before += z
    return copies, target


def test_pareto_sample_against_brute_force(spark):
    rng = random.Random(8)
    docs = [(i if i % 9 else None, rng.choice(["b", "a", "ü", None, "hot", "hot", "hot"]), " ".join(["w"] * rng.choice([0, 1, 3, 10, 40, 200]))) for i in range(500)]
    docs += [(7, "hot", "same words each time")] * 101 + [(8, "a", None)] * 3
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, source string, text string, __size string, copies int")
    copies, target = _mixed([(i, s, t or "") for i, s, t in docs])
    got = Counter()
    for r in mixing.mix(table.select("doc_id", "source", "text", "__size", "copies")).collect():
        got[r.doc_id, r.source, r["size"]] += r.copies
        assert abs(r.target - target[r.source]) < 1e-6 and r.taken == r.copies * r["size"] <= 2 * r["size"]
    want = Counter()
    for (i, s, t), n in copies.items():
        want[i, s, len(t.split())] += n
    assert +got == +want
    assert len({round(copies[i, s, t] / n, 3) for (i, s, t), n in Counter((i, s, t or "") for i, s, t in docs).items() if s == "hot" and n > 50}) == 1
    rows = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in mixing.mixed_rows(table).collect())
    assert rows == Counter({k: n for k, n in want.items() if n and k[2]})
    assert mixing.mixed_rows(table).columns == table.columns


def test_targets_of_very_many_sources(spark):
    sizes = [(f"s{i:04d}" if i else None, (i * 7919) % 1000) for i in range(3000)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long").repartition(5)).collect()}
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    w = {s: (3, 1, 2)[k % 3] for k, (s, _) in enumerate(order)}
    most, total, level = {s: 2 * n for s, n in sizes}, sum(n for _, n in sizes), 0.0
    for _ in range(100):
        full = {s for s in most if most[s] <= level * w[s]}
        level = (1.5 * total - sum(most[s] for s in full)) / sum(w[s] for s in most if s not in full)
    assert all(abs(got[s] - min(most[s], level * w[s])) < 1e-6 for s in most)


# ------------------------------------------------------------------------------------ op7


def test_transducer_against_whole_merges():
    rng = random.Random(6)
    for _ in range(150):
        letters, pairs, length = rng.randrange(1, 4), {}, {}
        length = dict.fromkeys(range(letters), 1)
        for rank in range(rng.randrange(1, 12)):
            a, b = rng.choice(list(length)), rng.choice(list(length))
            if a << 20 | b not in pairs:
                new = letters + rank
                pairs[a << 20 | b] = rank << 20 | new
                length[new] = length[a] + length[b]
        m = bpe.Merges(pairs, length)
        for _ in range(20):
            text = [rng.randrange(letters) for _ in range(rng.choice([0, 1, 5, 60, 300]))]
            assert list(m.stream(text, step=rng.choice([1, 3, 64]))) == m.merge(list(text))


def test_transducer_holds_a_window():
    import public_tokenizers

    m = bpe.loaded(public_tokenizers.path("word_bpe_49k.json"))
    most, taken, given = 0, 0, 0

    def symbols():
        nonlocal given, most
        for _ in range(200_000):
            given += 1
            most = max(most, given - taken)
            yield m.inner[97 + given * given % 13 % 5]

    for t in m.merges.stream(symbols()):
        taken += m.merges.length[t]
    assert taken == 200_000 and most <= m.merges.lookahead + m.merges.longest + 2 * 64


def test_decoder_gives_characters_when_complete(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    t = bpe.loaded(path)
    text = "grüße 日本 😀 é!"
    ids = np.frombuffer(t.encode(text), np.int32).tolist()
    machine, seen = bpe.Decoder(t, joined=False), ""
    for i in ids:
        seen += machine.feed([i])
        assert "�" not in seen
    assert (seen + machine.end()).replace(" ", "") == text.replace(" ", "")
    assert bpe.Decoder(t, joined=False).text([t.inner[0xE6], t.inner[0x97]]) == "�"
    (row,) = bpe.decode(spark.createDataFrame([(1, ids)], "doc_id long, ids array<int>"), path, joined=False).collect()
    assert row.decoded.replace(" ", "") == text.replace(" ", "")
    assert [r.decoded for r in bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), path).collect()] == ["", ""]


# ------------------------------------------------------------------------------------ op8


def _classes(links, nodes):
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in nodes}


def _similar(texts, n, percent):
    sets = {}
    for i, t in texts.items():
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    ids = sorted(i for i in sets if sets[i])
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, _classes(links, sets)


@pytest.mark.parametrize("n, percent, block", [(3, 90, 512), (3, 90, 4), (5, 80, 3), (2, 60, 3), (3, 100, 4)])
def test_near_copies_above_the_block(spark, n, percent, block):
    """Groups of near copies larger than a block, chains of links, and texts that share much but too little."""
    rng = random.Random(percent + block)
    texts = {}
    for g in range(12):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([3, 20, 60, 200]))]
        for _ in range(rng.choice([1, 5, 25])):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, len(words) // 10])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(30)}"
            texts[len(texts)] = " ".join(words)
            if rng.random() < 0.3:
                base = words
    texts |= {1000: "", 1001: None, 1002: "a b", 1003: "A  b", 1004: "a"}
    sets, least = _similar(texts, n, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), n, percent, block).collect()}
    assert got == {i: (len(s), least[i]) for i, s in sets.items()}


@pytest.mark.parametrize("block", [512, 64])
def test_texts_that_share_nearly_all_make_no_row_a_pair(spark, monkeypatch, block):
    """300 texts of one origin, few of which link: components are right, and no table has a row for each pair."""
    rng = random.Random(block)
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(300):
        words = list(base)
        for k in rng.sample(range(5, 145), 2):
            words[k] = f"x{i}"
        texts[i] = " ".join(words)
    for i in range(300, 320):  # copies with one more edit, which link with their originals
        words = texts[i - 300].split()
        words[0] = f"y{i}"
        texts[i] = " ".join(words)
    sets, least = _similar(texts, 3, 90)
    assert len(set(least.values())) > 150
    made, written = [], jaccard.written

    def counted(df):
        found = written(df)
        made.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "written", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 3, 90, block).collect()}
    assert got == {i: (len(s), least[i]) for i, s in sets.items()}
    assert max(made) < 320 * 30, made


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(200)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame([*edges, (None, 4)], "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == _classes([e for e in edges if e[0] != e[1]], nodes)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------------------------ op9


def test_transform_against_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        letters, width = rng.choice([1, 2, 4, 200]), rng.choice([1, 2, 3, 5, 8])
        strings = [bytes(rng.randrange(letters) for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(1, 12))]
        strings += strings[: rng.randrange(2)]
        count = Counter(s[k : k + width] for s in strings for k in range(len(s) - width + 1))
        for s, got in zip(strings, windows.column_wise(strings, width, piece=rng.choice([1, 2, 7, 50, 1 << 20]))):
            assert got.tolist() == [count[s[k : k + width]] > 1 for k in range(len(s) - width + 1)]


# ----------------------------------------------------------------------------------- op10

_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    doubled = [int(d) * 2 if k % 2 else int(d) for k, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def _base_spans(text):
    out = []
    for kind, pattern in _BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(digits) <= 19 and _luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if fine:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_against_brute_force(spark, tmp_path):
    rng = random.Random(10)
    parts = ["+1 (743) 555-3824", "4111 1111 1111 1111", "4111-1111-1111-1112", "10.0.0.1", "1.2.3.4.5.6.7.8", "256.1.1.1", "a@b.c", "a@b@c.de", "x@y.z.w-", "+12 34", "+1.2", "1 2 3", "é", "日本", "..", "@", "+", "-", "0", "123456789012345678901234567890"]
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    texts |= {100_000 + i: "".join(rng.choice(parts) + rng.choice(["", " ", "-", "x"]) for _ in range(rng.randrange(1, 12))) for i in range(600)} | {-1: "", -2: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.op10_personal_data(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = _base_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k + ":") for s in base) for k in _BASE]
        assert set(base) <= set(r.spans.split(","))  | ({""} if not base else set())


def _planted(rng):
    """Sentences with other spellings of personal data (True) and with what only looks like it."""
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    return rng.choice(
        [
            lambda: (True, "write to ", f"{name()} (at) {name()} (dot) com", " soon"),
            lambda: (True, "contact ", f"{name()} at {name()} dot org", ", please"),
            lambda: (True, "the server address ", ":".join(hexed(4) for _ in range(8)), " answers"),
            lambda: (True, "phone ", f"({digit(3)}) {digit(3)}-{digit(4)}", " after noon"),
            lambda: (True, "tel. ", f"0{digit(3)}-{digit(4)}-{digit(4)}", ", ask for me"),
            lambda: (True, 'token = "', hexed(40), '" in the file'),
            lambda: (True, 'api_key: "', "sk-" + "".join(rng.choice("abcXYZ0123456789") for _ in range(32)), '" works'),
            lambda: (False, "see commit ", hexed(40), " of the code"),
            lambda: (False, "sha256 ", hexed(64), " of the archive"),
            lambda: (False, "release version ", f"{digit(3)}-{digit(3)}-{digit(4)}", " is out"),
            lambda: (False, "the path ", f"{name()}/{name()}/{name()}{digit(2)}/index", " is long"),
            lambda: (False, "meet at noon by the old ", f"{name()}", " dot it was"),
            lambda: (False, "we counted ", digit(9), " of them"),
        ]
    )()


def test_spans_beyond_the_base_on_planted_text(spark):
    """The classifier is trained on one half of the planted sentences' votes and judged on the other."""
    rng = random.Random(12)
    made = [_planted(rng) for _ in range(1600)]
    df = spark.createDataFrame([(i, a + b + c) for i, (_, a, b, c) in enumerate(made)], "doc_id long, text string")
    found = df.select("doc_id", personal.candidates(F.col("text")).alias("candidates"))
    model = personal.fit(found.filter("doc_id % 2 = 0"))
    context = dict(zip(personal.LABELERS, model.weights[personal.KINDS.index("secret")]))["context"]
    assert context[1] > 0 > context[0]
    hits, wrong, missed = 0, 0, 0
    for r in found.filter("doc_id % 2 = 1").select("doc_id", personal.decide(F.col("candidates"), model).alias("spans")).collect():
        real, a, b, _ = made[r.doc_id]
        spans = [(s.start, s.end) for s in r.spans if not s.base]
        right = (len(a), len(a) + len(b)) in spans
        hits, wrong, missed = hits + (real and right), wrong + len(spans) - (real and right), missed + (real and not right)
    assert hits / (hits + wrong) > 0.95 and hits / (hits + missed) > 0.9, (hits, wrong, missed)


# ------------------------------------------------------------------------------- pipeline


def test_pipeline_against_plain_stages(spark, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "ngram_jaccard_join", "personal_data", "mixing", "bpe"]
    model = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    calm = stages["toxicity"](spark, docs, data)
    rows = {r.doc_id: r for r in docs.collect()}
    above = {i: model.above(toxicity.word_counts(r.text)) for i, r in rows.items()}
    calm_rows = {r.doc_id: r for r in calm.collect()}
    assert calm_rows == {i: r for i, r in rows.items() if (above[i] < 0.5).all()} and len(calm_rows) < len(rows)

    _, least = _similar({i: r.text for i, r in calm_rows.items()}, 5, 80)
    single = spark.createDataFrame([r for i, r in calm_rows.items() if least[i] == i], docs.schema)
    assert sorted(stages["ngram_jaccard_join"](spark, calm, data).collect()) == sorted(single.collect())

    spans = {r.doc_id: r.spans for r in personal.find(single).collect()}

    def masked(text, spans):
        out, at = "", 0
        for s in sorted(spans, key=lambda s: (s.start, s.end)):
            if s.start >= at:
                out += text[at : s.start] + f"<{s.kind.upper()}>"
            at = max(at, s.end)
        return out + text[at:]

    clean = stages["personal_data"](spark, single, data)
    clean_rows = {r.doc_id: r for r in clean.collect()}
    want = {r.doc_id: masked(r.text, spans[r.doc_id]) for r in single.collect()}
    assert {i: (r.text, r.n_chars) for i, r in clean_rows.items()} == {i: (t, len(t)) for i, t in want.items()} and clean.columns == docs.columns

    copies, _ = _mixed([(i, r.source, r.text) for i, r in clean_rows.items()])
    mixed = stages["mixing"](spark, clean, data)
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for (i, _, t), n in copies.items() if n and WORDS.search(t)})

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: library.encode(r.text, add_special_tokens=False).ids for i, r in clean_rows.items()}
    wanted = Counter((i, len(ids[i]), tuple(ids[i])) for (i, _, _), n in copies.items() for _ in range(n))
    assert Counter((r.doc_id, r.n_tokens, tuple(r.ids)) for r in corpus_pipeline.run(spark, data).collect()) == Counter({k: n for k, n in wanted.items() if k[1]})


# ------------------------------------------------------------------------- hints of personal data


def _made(rng, kind, loose):
    """A text that is shaped like a match."""
    pick, digits = rng.choice, lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda n: "".join(rng.choice("abcXYZ09") for _ in range(n))
    if kind == "email":
        at, dot = (pick([" at ", "(at)", " [AT] ", "{at} "]), pick([" dot ", "(dot)", " [Dot] ", "{dot}"])) if loose else ("@", ".")
        return word(3) + at + word(4) + dot + word(2) + pick(["", dot + "de"])
    if kind == "ip":
        return ":".join(word(rng.randrange(1, 5)).lower().translate(str.maketrans("xyz", "abc")) for _ in range(8)) if loose else ".".join(digits(rng.randrange(1, 4)) for _ in range(4))
    if kind == "card":
        sep = pick("._/") if loose else pick(["", " ", "-"])
        return sep.join(digits(4) for _ in range(4))
    if kind == "phone":
        if not loose:
            return "+" + digits(1) + pick([" ", "(", ".", "-", "1"]) + digits(rng.randrange(5, 12))
        return pick([f"({digits(rng.randrange(2, 6))}){pick(['', ' '])}", f"0{digits(rng.randrange(1, 5))}{pick(' ./-')}", f"{digits(3)}{pick('.-')}"]) + digits(rng.randrange(3, 5)) + pick(" .-") + digits(rng.randrange(3, 6))
    return "".join(pick("abcXYZ_+/-019") for _ in range(rng.randrange(19, 40))) + pick(["", "=", "=="])


@pytest.mark.parametrize("loose", [False, True])
def test_each_match_holds_its_hint(loose):
    """A text with a match is searched, whatever else it has."""
    rng = random.Random(17)
    patterns, hints = (personal.LOOSE, personal.LOOSE_HINT) if loose else (personal.BASE, personal.HINT)
    for kind, pattern in patterns.items():
        plain, hint, found = regex.compile(pattern.replace(r"(?:\G|", "(?:")), regex.compile(hints[kind]), 0
        for _ in range(3000):
            text = pick_text(rng, _made(rng, kind, loose))
            for m in plain.finditer(text):
                found += 1
                assert hint.search(m[0]), (kind, m[0])
        assert found > 1000, kind


def pick_text(rng, made):
    """The text, sometimes with one character changed or put among others."""
    if rng.random() < 0.3:
        i = rng.randrange(len(made))
        made = made[:i] + rng.choice(" .-/()0a:") + made[i + 1 :]
    return rng.choice(["", "call ", "x (", "\n"]) + made + rng.choice(["", " now", ".", ")"])


def test_spans_do_not_depend_on_other_parts(spark):
    """What is found in a text is found in it beside other text, too: candidates are the same."""
    texts = ["Telefon 030/1234 5678", "token: abcdEFGHijklMNOPqrst1", "call (030) 123 45678", "visa 4111.1111.1111.1111", "ann (at) mail (dot) org", "key: ABCDEFGHIJKLMNOPQRST0"]
    others = ["030 1234 5678", "9abcdefghij", "1.2", "nothing"]
    rows = [(i, t + tail) for i, (t, tail) in enumerate((t, tail) for t in texts for tail in ["", *(f"\n\n\n and then {o}" for o in others)])]
    found = spark.createDataFrame(rows, "i int, text string").select("i", "text", personal.candidates(F.col("text")).alias("c")).collect()
    for r in found:
        own = texts[r.i // (1 + len(others))]
        alone = {(c.kind, c.start, c.end) for c in found[r.i - r.i % (1 + len(others))].c}
        assert alone and alone <= {(c.kind, c.start, c.end) for c in r.c if c.end <= len(own)}
