"""Whitening, URL filters and tokenizer alignment against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from formwork.llm import alignment, queries, urls, whitening
from formwork.llm.boosting import boosted

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


# ------------------------------------------------------------------------------ whitening


def _plain_whitening(vectors, k=4):
    x = {i: [math.floor(256 * float(c)) for c in v] for i, v in vectors.items()}
    fit = sorted(set(map(tuple, x.values())))
    n, dims = len(fit), len(fit[0])
    s = [sum(v[d] for v in fit) for d in range(dims)]
    y = [[Fraction(v[d]) - Fraction(s[d], n) for d in range(dims)] for v in fit]
    cov = np.array([[float(sum(v[i] * v[j] for v in y) / n) for j in range(dims)] for i in range(dims)])
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1][:k], w[:, ::-1][:, :k]
    white = {i: (np.array([c - t / n for c, t in zip(v, s)]) @ w) / np.sqrt(e) for i, v in x.items()}
    return n, {i: sum((n * c - t) ** 2 for c, t in zip(v, s)) for i, v in x.items()}, white, e / np.trace(cov)


def _same_whitening(rows, vectors):
    n, deviation, white, explained = _plain_whitening(vectors)
    k = len(explained)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(got) == k * len(vectors)
    signs = [np.sign(sum(got[i, c + 1].whitened * white[i][c] for i in vectors)) for c in range(k)]
    for i in vectors:
        for c in range(k):
            r = got[i, c + 1]
            assert (r.n, int(r.deviation)) == (n, deviation[i])
            assert r.whitened * signs[c] == pytest.approx(white[i][c], abs=1e-6) and r.explained == pytest.approx(explained[c], rel=1e-9)
            assert r.identity_error < 1e-9


def test_whitening_against_fractions(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id", F.slice("embedding", 1, 12).alias("embedding"))
    again = table.filter("vec_id < 40").withColumn("vec_id", F.col("vec_id") + 10_000)
    odd = spark.createDataFrame([(-1, None), (-2, [None] * 12), (-3, [float("nan")] * 12), (-4, [float("inf")] * 12), (-5, [])], table.schema)
    both = table.unionByName(again)
    _same_whitening(whitening.whitened(both.unionByName(odd).repartition(7)).collect(), {r.vec_id: r.embedding for r in both.collect()})


def test_whole_query_has_one_fit(spark, data):
    rows = queries.op11_embedding_whitening(spark, data).collect()
    _same_whitening(rows, {r.vec_id: r.embedding for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()})
    assert len({r.identity_error for r in rows}) == 1


def test_whitening_of_odd_spaces(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [5.0, 2.0]), (4, [1e30, -1e30, 0.5]), (5, [2.0, 3.0, 0.5]), (6, [-7.0, 3.0, 0.25]), (7, [9.0])]
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = {(r.vec_id, r.component): r for r in found}
    assert len(found) == 3 * 2 + 3 * 3 + 1
    assert got[1, 1].whitened == pytest.approx(-1.0) and got[None, 1].whitened == pytest.approx(1.0) and got[1, 1].n == 2
    assert got[1, 2].whitened is None and got[1, 2].explained == 0.0  # one direction only
    top, low, n = 2**63 - 1, -(2**63), 3
    s = [top + 512 - 1792, low + 768 + 768, 128 + 128 + 64]
    assert int(got[4, 1].deviation or 0) == 0 and sum((n * c - t) ** 2 for c, t in zip((top, low, 128), s)) >= 10**38
    assert int(got[7, 1].deviation) == 0 and got[7, 1].whitened is None and got[7, 1].explained is None and got[7, 1].identity_error is None


def test_residues_of_large_numbers():
    rng = random.Random(3)
    x = np.array([[rng.randrange(-(2**62), 2**62) for _ in range(5)] for _ in range(9000)], dtype=np.int64)
    ps = whitening.primes_for(9000 * 2**124)
    assert len(set(ps)) == len(ps) and all(p < 1 << 20 and all(p % q for q in range(2, 1024)) for p in ps)
    exact = x.astype(object).T @ x.astype(object)
    assert (whitening.from_residues(whitening.residue_products(x, ps), ps) == exact).all()


# ------------------------------------------------------------------------------------ URLs

ODD_URLS = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.ORG", "http://a.org?x", "http://org/x", "http://xorg/y", "https://a.b.COM/de/1?q=://com/fr/", "http://example.org/es/", "http://m.example.org/en/12#f", "http://notexample.org/es/1", "http://a.com/frx", "ftp://u@h.net:80/a%20b/../c.tar.GZ?a=1&b=2;c", "http://é.com/de/" + "x" * 50_000, "http://a\nb.com/fr/\n"]


def _plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def test_rules_against_plain_code(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url")
    both = pages.unionByName(spark.createDataFrame(list(enumerate(ODD_URLS, 100_000)), pages.schema))
    given = {r.page_id: r.url for r in both.collect()}
    found = urls.judged(both).collect()
    assert len(found) == len(given)
    for r in found:
        host, path, rule, verdict = _plain_rule(given[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score > 0 else "allow"))


def test_features_and_trees_against_plain_code(spark):
    """Entropy, ratios and counts by counting, and the expression's scores by walking the trees."""
    texts = [u for u in ODD_URLS if u and len(u) < 1000]
    host, path = urls.host_and_path(F.col("url"))
    rows = urls._prepared(spark.createDataFrame([(u,) for u in texts], "url string").select("url", host.alias("host"), path.alias("path"))).collect()
    entropy = lambda t: sum(-n / len(t) * math.log2(n / len(t)) for n in Counter(t).values()) if t else 0.0
    share = lambda t: sum(c in "0123456789" for c in t) / len(t) if t else 0.0
    for r in rows:
        assert r.x_entropy == pytest.approx(entropy(r.url), abs=1e-9) and r.x_host_entropy == pytest.approx(entropy(r.host), abs=1e-9)
        assert (r.x_digit_ratio, r.x_host_digit_ratio) == (pytest.approx(share(r.url)), pytest.approx(share(r.host)))
        query = re.match(r"[^?#]*\?([^#]*)", r.url)
        assert (r.x_length, r.x_depth, r.x_parameters) == (len(r.url), len(re.findall("/[^/]", r.path)), len([p for p in re.split("[&;]", query[1] if query else "") if p]))
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(600, 4)), 2)
    y = ((x[:, 0] > 0.2) ^ (x[:, 2] > 0)).astype(float)
    model = boosted(x, y, ("a", "b", "c", "d"), 0.0, trees=20)
    assert ((model.score(x) > 0) == y).mean() > 0.97
    table = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double, d double")
    assert [r.s for r in table.select(model.column().alias("s")).collect()] == pytest.approx(model.score(x).tolist(), abs=1e-12)


def test_url_model_on_held_out_labels(spark):
    """A third of labelled URLs is withheld: the model blocks three quarters of the bad, and few others.

    No feature sees the number that a path ends in, so what ``example.org/en/1`` blocks is beyond it."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    host, path = urls.host_and_path(F.col("url"))
    rows = pages.select("url", host.alias("host"), path.alias("path"))
    for_all = urls.judged(pages).filter("rule is not null").select("host", "path", "verdict").distinct()
    known = rows.join(for_all, ["host", "path"]).withColumn("held", F.pmod(F.hash("url"), F.lit(3)) == 0)
    model = urls.fit(known.select("url", "host", "path", F.when(~F.col("held"), F.col("verdict") == "block").alias("blocked")))
    got = Counter((r.verdict, r.s > 0) for r in model.featured(urls._prepared(known.filter("held")), False).select("verdict", model.trees.column().alias("s")).collect())
    bad, good = got["block", True] + got["block", False], got["allow", True] + got["allow", False]
    assert bad > 50 and got["block", True] / bad > 0.75 and got["allow", True] / good < 0.05, got


def test_urls_without_labels(spark):
    table = spark.createDataFrame([(1, "http://a.net/x"), (None, None), (1, "http://a.net/x")], "page_id long, url string")
    assert [(r.verdict, r.score) for r in urls.judged(table).collect()] == [("allow", None)] * 3
    assert [r.verdict for r in urls.judged(table.limit(1), (urls.Rule("block", "a.net", "/"),)).collect()] == ["block"]
    assert urls.judged(table.filter("false")).collect() == []


# ------------------------------------------------------------------------------- tokenizers


def _plain_alignment(texts):
    """Tokens, groups and links of whole texts, by loops over tokens."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = alignment._byte_of()
    assert ByteLevel().decode([k for k, v in back.items() if v < 128]) == "".join(chr(v) for v in back.values() if v < 128)
    out = {}
    for i, text in texts.items():
        whole = (" " + (text or "")).encode()
        ids = a.encode(whole.decode(), add_special_tokens=False).ids, b.encode(text or "")
        tokens = [bytes(back[c] for c in a.id_to_token(t)) for t in ids[0]], [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids[1])]
        if not text or any(b"".join(t) != whole for t in tokens):
            out[i] = ([], [], "", [])
            continue
        ends = []
        for t in tokens:
            at, e = 0, []
            for x in t:
                at += len(x)
                e.append(at)
            ends.append(e)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [[",".join(str(t) for t, x in zip(ids[s], ends[s]) if low < x <= high) for s in (0, 1)] for low, high in zip([0, *cuts], cuts)] if len(whole) < 3000 else None
        at = {x: t for t, x in zip(ids[1], ends[1])}
        out[i] = (*ids, groups and ";".join("|".join(g) for g in groups), [(t, at[x]) for t, x in zip(ids[0], ends[0]) if x in at])
    return out


def _same_alignment(rows, texts):
    plain = _plain_alignment(texts)
    counts = Counter(link for *_, links in plain.values() for link in links)
    top = {}
    for (_, b), n in counts.items():
        top[b] = max(n, top.get(b, 0))
    assert len(rows) == len(texts)
    for r in rows:
        a, b, groups, links = plain[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(links), len(links)), texts[r.doc_id][:200]
        assert (r.n_best, r.count_sum) == (sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links))
        if groups is not None:
            assert (r.groups if "groups" in r else r.groups_sha256) == (groups if "groups" in r or not groups else hashlib.sha256(groups.encode()).hexdigest())


def test_alignment_of_all_documents(spark, data):
    _same_alignment(queries.op13_cross_tokenizer_alignment(spark, data).collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()})


def test_alignment_of_odd_texts(spark):
    rng = random.Random(7)
    pool = ["a", "Zz", " ", "  ", "\n", "\t", "é", "ÿ", "€", "日本", " ", "　", " ", "<|endoftext|>", "</s>", "<0x41>", "1", "'s", "don't", "_", "🙂", "́", "​", "ﬁ", "\x00", "\x85", "word", "Über"]
    texts = ["", " ", "  x", "▁", "a ▁ b", "x" * 5000, " " * 300, "word " * 3000, None, "a b", "a b", *("".join(rng.choice(pool) for _ in range(rng.randrange(1, 40))) for _ in range(400))]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    _same_alignment(alignment.aligned(table, A, B).collect(), {i: t or "" for i, t in enumerate(texts)})


def test_pair_counts_are_bounded(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    pairs = alignment.pair_counts(docs, A, B).collect()
    assert len(pairs) == len({(r.a, r.b) for r in pairs}) <= alignment.pairs_at_most(A, B) < 1_000_000
    held = alignment.pair_of(A, B)
    assert all(held.a_bytes[r.a].endswith(held.b_bytes[r.b]) or held.b_bytes[r.b].endswith(held.a_bytes[r.a]) for r in pairs)


def test_links_of_tokens_without_bytes():
    """Offsets at which several tokens end link all of them."""
    cuts, a_group, b_group, a_at, b_at, cut = alignment.align(np.arange(4), np.arange(3), np.array([1, 0, 2, 1]), np.array([3, 0, 1]))
    assert cuts.tolist() == [3, 4] and a_group.tolist() == [0, 0, 0, 1] and b_group.tolist() == [0, 0, 1]
    assert list(zip(a_at.tolist(), b_at.tolist(), cut.tolist())) == [(2, 0, 0), (2, 1, 0), (3, 2, 1)]
