"""The operators against brute force and on odd tables."""

import dataclasses
import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from formwork.llm import alignment, bpe, common, jaccard, licences, mixing, neighbours, personal, quality, queries, toxicity, urls, whitening, windows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside, as columns of the user's.
CLASHES = "spans n row own unit token node key_a key_b candidates size draw copies part tile words kept score of good severity batch removed ids decoded rank dim cb qb asks __id __row __text __words __time __size __copies __spans __one __rejected url host path rule ruled verdict blocked fold value urls a b groups salt most packed vector component grade".split()
ODD = "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHES)
EMAIL = "write to ann.lee@mail.example.com or +1 (743) 555-3824, card 4111 1111 1111 1111, host 10.1.2.3"


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, EMAIL), (2, None), (3, ""), (4, " \n\t"), (5, long), (6, long), (6, long), (None, "x y z " * 20), (7, "Released under the MIT License."), (5, "other text of the same id")]
    return spark.createDataFrame([(i, t, s, *[f"clash {c}" for c in CLASHES]) for (i, t), s in zip(rows, ["a", None, "b"] * 4)], ODD)


def _labels(d, name):
    return d.select("doc_id", F.pmod(F.hash("doc_id"), F.lit(2)).alias(name))


OPERATORS = {
    "quality": lambda d: quality.resemblance(d, _labels(d, "quality")),
    "licences": licences.scan,
    "toxicity": lambda d: toxicity.grade(d, toxicity.fit(d, _labels(d, "toxic")), prefix="new_"),
    "accepted": lambda d: toxicity.accepted(d, toxicity.fit(d, _labels(d, "toxic"))),
    "nearest": lambda d: neighbours.nearest(d.withColumn("embedding", F.when(F.length("text") > 0, F.array(F.length("text").cast("double"), F.lit(1.0)))), F.lit(True), 2, id_column="doc_id"),
    "bpe": lambda d: bpe.decode(bpe.encode(d, public_tokenizers.path("word_bpe_49k.json")), public_tokenizers.path("word_bpe_49k.json")),
    "mixing": mixing.mix,
    "mixed": mixing.mixed_rows,
    "words": windows.remove_repeated_words,
    "bytes": windows.remove_repeated_bytes,
    "jaccard": jaccard.near_duplicates,
    "one": jaccard.keep_one,
    "personal": personal.find,
    "aligned": lambda d: alignment.aligned(d, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")),
    "whitened": lambda d: whitening.whitened(d.withColumn("embedding", F.array(F.coalesce(F.length("text"), F.lit(0)) / 7)), id_column="doc_id"),
    "judged": lambda d: urls.judged(d, id_column="doc_id", url_column="text"),
    "redact": personal.redact,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_and_empty_tables(odd, name):
    """Nulls, blank and long texts, repeated rows and ids, clashing names, ids that aren't numbers, no rows."""
    run = OPERATORS[name]
    named = odd.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    counts = []
    for table in (odd, named):
        found = run(table)
        rows = found.collect()
        counts.append(len(rows))
        if name in ("toxicity", "accepted", "mixed", "one", "redact"):  # these return the table's own columns
            assert found.columns[: len(odd.columns)] == odd.columns
            assert all(r[c] == f"clash {c}" for r in rows for c in CLASHES)
    assert counts[0] == counts[1] or name in ("toxicity", "accepted", "mixed")
    if name not in ("licences", "accepted", "mixed", "one", "nearest"):
        assert counts == [odd.count()] * 2
    assert run(odd.filter("false")).count() == 0


def test_defined_results_on_odd_rows(odd):
    sizes = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(odd).collect()}
    assert {(2, 0, 2), (3, 0, 3), (4, 0, 4)} <= sizes and any(i == 6 and c == 5 for i, _, c in sizes)
    kept = jaccard.keep_one(odd).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id) == [1, 2, 3, 4, 5, 5, 7]
    assert [(r.doc_id, r.licence) for r in licences.scan(odd).collect()] == [(7, "MIT")]
    masked = {r.doc_id: r.text for r in personal.redact(odd).collect()}
    assert masked[1] == "write to <EMAIL> or <PHONE>, card <CARD>, host <IP>" and masked[2] is None
    removed = {(r.doc_id, r.n_words): r.n_removed for r in windows.remove_repeated_words(odd).collect()}
    assert removed[6, 30_000] == 30_000


def test_nearest_against_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet")
    extra = spark.createDataFrame([(9001, None, 0), (9002, [0.0] * 64, 0), (9003, [float("nan")] * 64, 0)], rows.schema)
    held = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    got = Counter()
    for r in neighbours.nearest(rows.unionByName(extra), F.col("vec_id") % 5 == 0, 5, candidate_block=16, query_block=4).collect():
        got[r.query_id, r["rank"], r.vec_id] += 1
    for q, x in held.items():
        if q % 5 == 0:
            near = sorted(((-float(x @ y) / float(np.linalg.norm(x) * np.linalg.norm(y)), i) for i, y in held.items() if i != q))[:5]
            assert all(got[q, k + 1, i] == 1 for k, (_, i) in enumerate(near))


def test_base_rules_against_brute_force(spark, data):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in queries.op2_quality_rules(spark, data).collect():
        text = docs[r.doc_id]
        w = WORDS.findall(text)
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {p for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in text.split("\n") if WORDS.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text), len(lines) - len(set(lines)), len(covered))


def _without(seqs, width, join):
    count = Counter(s[k : k + width] for s in seqs.values() for k in range(len(s) - width + 1))
    out = {}
    for i, s in seqs.items():
        gone = {p for k in range(len(s) - width + 1) if count[s[k : k + width]] > 1 for p in range(k, k + width)}
        out[i] = (len(s), len(gone), hashlib.sha256(join.join(x if isinstance(x, bytes) else bytes([x]) for p, x in enumerate(s) if p not in gone)).hexdigest())
    return out


def test_repeated_windows_against_brute_force(spark, data):
    docs = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    words = {i: tuple(re.findall(rb"[^\x20\x09-\x0D]+", x)) for i, x in docs.items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op6_substring_dedup(spark, data).collect()} == _without(words, 35, b" ")
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in queries.op9_suffix_dedup(spark, data).collect()} == _without(docs, 200, b"")


def test_jaccard_against_brute_force(spark, data):
    docs = {r.doc_id: WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text)) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    sets = {i: {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set() for i, w in docs.items()}
    root = {i: i for i in sets}

    def find(i):
        return i if root[i] == i else find(root[i])

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8_ngram_jaccard_join(spark, data).collect()} == {i: (len(s), find(i)) for i, s in sets.items()}


def test_tokens_against_the_library(spark, data):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()] + [(-1, "a" * 5000), (-2, "ΣΑΣ <|endoftext|> é́ \x1c 日本"), (-3, None)]
    texts = dict(rows)
    for r in bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), path), path).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids == ids and r.decoded == library.decode(ids, skip_special_tokens=False)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels.filter("doc_id % 3 <> 0"))
    held = toxicity.grade(docs, model).join(labels.filter("doc_id % 3 = 0"), "doc_id").select("toxic", "rejected").collect()
    assert np.mean([r.toxic == r.rejected for r in held]) > 0.9


def test_mix_meets_targets(spark, data):
    rows = queries.op5_mixing(spark, data).collect()
    assert all(r.taken <= 2 * r["size"] for r in rows)
    taken, target, largest = Counter(), {}, Counter()
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in rows:
        s = sources[r.doc_id]
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    assert sorted(rows) == sorted(queries.op5_mixing(spark, data).collect())


def test_spans_of_each_kind(spark):
    text = EMAIL + " 4111111111111112 999.1.1.1 +12 a_b@c.d_x@y.zz"
    (row,) = personal.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    got = [(s.kind, text[s.start : s.end]) for s in row.spans if s.base]
    assert got == [("email", "ann.lee@mail.example.com"), ("email", "a_b@c.d"), ("email", "_x@y.zz"), ("ip", "10.1.2.3"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (743) 555-3824")]


@pytest.mark.parametrize("shared_id", [None, 7])
def test_texts_under_one_id_stay_apart(spark, shared_id):
    a = "a6949 " + " ".join(f"p{k}" for k in range(40))
    b = "b48448 " + " ".join(f"q{k}" for k in range(60))
    both = spark.createDataFrame([(shared_id, a), (shared_id, b)], "doc_id long, text string")
    assert len({r[0] for r in both.select(F.hash("text", F.col("doc_id").isNull())).collect()}) == 1  # equal in 32 bits
    assert {r.text for r in jaccard.keep_one(both).collect()} == {a, b}
    assert sorted(r.n_shingles for r in jaccard.near_duplicates(both).collect()) == [39, 59]
    three = both.unionByName(spark.createDataFrame([(shared_id, "c" + a[5:])], both.schema))
    assert sorted((r.n_words, r.n_removed) for r in windows.remove_repeated_words(three).collect()) == [(41, 40), (41, 40), (61, 0)]
    plan = windows.Plan(width=100, part=32, words=False, per_bucket=4_000_000)
    assert {r.n_bytes: r.n_removed for r in windows.remove_repeated_bytes(three, plan).collect()}[len(b)] == 0


def test_each_licence_alone_in_its_chunk(spark):
    notices = list(licences.TEMPLATES.items())
    long = "word " * 210_000
    alone = spark.sparkContext.parallelize([(i, t) for i, (_, t) in enumerate(notices)], len(notices)).toDF("doc_id long, text string")
    between = [(-1, long), *(x for i, (_, t) in enumerate(notices) for x in ((i, t), (-1, long)))]
    for table in (alone, spark.createDataFrame(between, "doc_id long, text string").coalesce(1)):
        found = {(r.doc_id, r.licence) for r in licences.scan(table).collect() if r.containment == 1.0}
        assert {(i, name) for i, (name, _) in enumerate(notices)} <= found


@pytest.mark.parametrize("plan", [windows.WORD_PLAN, windows.BYTE_PLAN], ids=["words", "bytes"])
def test_hot_groups_are_divided(spark, plan):
    rng = np.random.default_rng(5)
    symbols = lambda n: [f"{x:05d}" for x in rng.integers(0, 100_000, n)]
    passage = symbols(90)
    docs = {i: " ".join(symbols(70) + passage[i % 3 :] + symbols(70)).encode() for i in range(60)}
    table = common.keyed(spark.createDataFrame([(i, x.decode()) for i, x in docs.items()], "doc_id long, text string").coalesce(2))
    ids = {(r.key_a, r.key_b): r.doc_id for r in table.collect()}
    least = dataclasses.replace(plan, per_group=20)
    judge = windows.sorted_windows(plan.width) if plan.words else windows.suffix_blocks(plan.width, plan.part)

    def watched(strings, groups, offsets):
        if np.unique(groups, return_counts=True)[1].max(initial=0) > least.per_group:
            raise ValueError("a hot group came whole")
        return judge(strings, groups, offsets)

    with pytest.raises(Exception, match="a hot group came whole"):
        windows.repeated_spans(table, dataclasses.replace(plan, per_group=1 << 40), watched).collect()
    covered = {i: set() for i in docs}
    for r in windows.repeated_spans(table, least, watched).collect():
        covered[ids[r.key_a, r.key_b]].update(range(r.begin, r.end))
    texts = {i: tuple(x.split()) if plan.words else x for i, x in docs.items()}
    count = Counter(s[k : k + plan.width] for s in texts.values() for k in range(len(s) - plan.width + 1))
    assert covered == {i: {p for k in range(len(s) - plan.width + 1) if count[s[k : k + plan.width]] > 1 for p in range(k, k + plan.width)} for i, s in texts.items()}


def test_frequent_pieces_begin_at_a_fixed_count():
    assert windows.sketch_cells(1 << 20) == windows.sketch_cells(1 << 29) == 1 << 16
    assert all(8 * n // windows.sketch_cells(n) <= 1 << 16 for n in (30 * 10**9, 130 * 10**9))


@pytest.mark.parametrize("plan", [windows.WORD_PLAN, windows.BYTE_PLAN], ids=["words", "bytes"])
def test_what_tasks_hold_is_bounded(plan):
    """Counts, bits and the list of hot minimisers, at any input: 100 TB, 10 PB."""
    for n in (10**9, 10**12, 10**14, 10**16):
        cells = windows.sketch_cells(n)
        assert 4 * cells <= 64 << 20 and cells // 8 <= 2 << 20 and 8 * windows.MOST_HOT <= 8 << 20
        assert windows.hot_from(n, plan) >= plan.per_group
    assert windows.hot_from(10**10, plan) == plan.per_group
    assert windows.hot_from(10**14, plan) < 1.4e7  # strings in a group that travels whole


@pytest.mark.parametrize("plan", [windows.WORD_PLAN, windows.BYTE_PLAN], ids=["words", "bytes"])
def test_bounds_change_no_result(spark, data, plan, monkeypatch):
    """Few cells and one hot minimiser give the spans that many give."""
    table = common.keyed(spark.read.parquet(f"{data}/documents.parquet"))
    judge = windows.sorted_windows(plan.width) if plan.words else windows.suffix_blocks(plan.width, plan.part)

    def covered():
        found = {}
        for r in windows.repeated_spans(table, dataclasses.replace(plan, per_group=5), judge).collect():
            found.setdefault((r.key_a, r.key_b), set()).update(range(r.begin, r.end))
        return found

    many = covered()
    monkeypatch.setattr(windows, "MOST_HOT", 1)
    assert covered() == many


@pytest.mark.parametrize("plan", [windows.WORD_PLAN, windows.BYTE_PLAN], ids=["words", "bytes"])
def test_pieces_of_long_texts_hold_each_window_once(plan):
    plan = dataclasses.replace(plan, longest=700)
    rng = np.random.default_rng(8)
    for n in (1, 150, 200, 701, 900, 5000):
        text = bytes(rng.choice(np.frombuffer(b"ab cd\n e", np.uint8), n))
        whole = text.split() if plan.words else text
        got = []
        for begin, piece in windows._overlapping(text, plan):
            part = piece.split() if plan.words else piece
            got += [(begin + k, part[k : k + plan.width]) for k in range(len(part) - plan.width + 1)]
        assert got == [(k, whole[k : k + plan.width]) for k in range(len(whole) - plan.width + 1)]


def test_long_texts_in_pieces_change_no_result(spark, data):
    """Divided texts lose what whole ones lose: texts of the table, some joined to a long one."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    joined = docs.groupBy((F.col("doc_id") % 7).alias("doc_id")).agg(F.concat_ws(" ", F.sort_array(F.collect_list("text"))).alias("text"))
    both = docs.unionByName(joined.withColumn("doc_id", F.col("doc_id") + 10_000))
    for operator, plan in ((windows.remove_repeated_words, windows.WORD_PLAN), (windows.remove_repeated_bytes, windows.BYTE_PLAN)):
        whole, divided = (sorted(map(tuple, operator(both, dataclasses.replace(plan, longest=n), whole=False).collect())) for n in (4 << 20, 900))
        assert whole == divided
